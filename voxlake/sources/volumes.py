"""Voxel rows, chunk rows and volume facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.operators.joins import VOXEL, fact_join

# Fixed value: chunk shape (z, y, x) of a lazily read volume.
CHUNK_SHAPE = (16, 256, 256)


def to_chunks(dense: DataFrame, volumes: DataFrame, shape: tuple[int, int, int] = CHUNK_SHAPE) -> DataFrame:
    """Dense voxel rows (volume_id, z, y, x, v) to one row per chunk with its values in raster order."""
    dims = volumes.select("volume_id", "nz", "ny", "nx")
    rows = fact_join(dense, dims, ["volume_id"])
    for axis, size in zip(VOXEL, shape):
        rows = rows.withColumn(f"c{axis}", F.floor(F.col(axis) / size).cast("int"))
        rows = rows.withColumn(f"{axis}0", F.col(f"c{axis}") * size)
        rows = rows.withColumn(f"d{axis}", F.least(F.lit(size), F.col(f"n{axis}") - F.col(f"{axis}0")))
    at = ((F.col("z") - F.col("z0")) * F.col("dy") + F.col("y") - F.col("y0")) * F.col("dx") + F.col("x") - F.col("x0")
    keys = ["volume_id", "cz", "cy", "cx", "z0", "y0", "x0", "dz", "dy", "dx"]
    cells = F.array_sort(F.collect_list(F.struct(at.alias("i"), F.col("v").cast("float").alias("v"))))
    return rows.groupBy(*keys).agg(F.transform(cells, lambda s: s["v"]).alias("data"))


def from_chunks(chunks: DataFrame) -> DataFrame:
    """Chunk rows back to voxel rows."""
    i = F.col("i")
    area = F.col("dy") * F.col("dx")
    return chunks.select("volume_id", "z0", "y0", "x0", "dy", "dx", F.posexplode("data").alias("i", "v")).select(
        "volume_id",
        (F.col("z0") + F.floor(i / area)).cast("int").alias("z"),
        (F.col("y0") + F.floor(i % area / F.col("dx"))).cast("int").alias("y"),
        (F.col("x0") + i % F.col("dx")).cast("int").alias("x"),
        F.col("v").cast("double").alias("v"),
    )


def volume_facts(voxels: DataFrame, value: str = "v", keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Extent, stored voxels and value range of each volume."""
    extent = [(F.max(a) + 1).alias(f"n{a}") for a in VOXEL]
    return voxels.groupBy(*keys).agg(
        *extent, F.count("*").alias("voxels"), F.min(value).alias("vmin"), F.max(value).alias("vmax")
    )


def to_runs(labels: DataFrame, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Label voxels to runs along x (gaps and islands inside one image line)."""
    line = Window.partitionBy(*keys, "z", "y", "label").orderBy("x")
    rows = labels.withColumn("_island", F.col("x") - F.row_number().over(line))
    return (
        rows.groupBy(*keys, "z", "y", "label", "_island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_island")
    )


def from_runs(runs: DataFrame) -> DataFrame:
    return runs.select("*", F.explode(F.sequence("x0", "x1")).alias("x")).drop("x0", "x1")
