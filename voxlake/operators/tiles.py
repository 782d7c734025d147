"""Tile grids, tile voxels, batch prediction, stitching, discretising."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.operators.geometry import undo_view
from voxlake.operators.components import connected_components
from voxlake.operators.joins import VOXEL, box_join, fact_join
from voxlake.operators.voxel import zscore

TILE = ("volume_id", "z0", "y0", "x0")


def _tiles(volumes: DataFrame, starts: dict[str, Column], size: tuple[int, int, int]) -> DataFrame:
    rows = volumes
    for axis in VOXEL:
        rows = rows.withColumn(f"{axis}0", F.explode(starts[axis]))
    length = [F.least(F.lit(s), F.col(f"n{a}") - F.col(f"{a}0")).alias(f"d{a}") for a, s in zip(VOXEL, size)]
    return rows.select(*TILE, *length)


def ragged_tiles(volumes: DataFrame, size: tuple[int, int, int], stride: tuple[int, int, int]) -> DataFrame:
    """Starts 0, stride, ... below the size of the volume; the last tiles are cut short."""
    starts = {a: F.sequence(F.lit(0), F.col(f"n{a}") - 1, F.lit(s)) for a, s in zip(VOXEL, stride)}
    return _tiles(volumes, starts, size)


def _clamped_starts(n: Column, size: int, stride: int) -> Column:
    last = F.greatest(n - size, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def clamped_tiles(volumes: DataFrame, size: tuple[int, int, int], stride: tuple[int, int, int]) -> DataFrame:
    """Full tiles only: a last tile that would stick out starts earlier instead."""
    starts = {a: _clamped_starts(F.col(f"n{a}"), s, st) for a, s, st in zip(VOXEL, size, stride)}
    return _tiles(volumes, starts, size)


def slab_tiles(volumes: DataFrame, size: int) -> DataFrame:
    """z slabs with half overlap over the full plane: starts below n - size, then the last full slab."""
    last = F.greatest(F.col("nz") - size, F.lit(0))
    step = max(size // 2, 1)
    starts = F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0), last, F.lit(step)), lambda s: s < last), F.array(last)))
    rows = volumes.withColumn("z0", F.explode(starts))
    return rows.select(
        "volume_id", "z0", F.lit(0).alias("y0"), F.lit(0).alias("x0"), F.least(F.lit(size), "nz").alias("dz"), F.col("ny").alias("dy"), F.col("nx").alias("dx")
    )


def overlap_tiles(volumes: DataFrame, size: tuple[int, int, int], overlap: float) -> DataFrame:
    """Tiles with a fractional overlap: stride = whole part of size x (1 - overlap), at least 1, ends clamped."""
    return clamped_tiles(volumes, size, tuple(max(int(s * (1 - overlap)), 1) for s in size))


def tiles_with_foreground(tiles: DataFrame, mask: DataFrame) -> DataFrame:
    """Only the tiles that hold a mask voxel, so that a model never sees empty ones."""
    hit = box_join(tiles, mask.select("volume_id", *VOXEL)).select(*TILE).distinct()
    return tiles.join(hit, list(TILE), "left_semi")


def slab_boxes(mask: DataFrame, volumes: DataFrame, size: int) -> DataFrame:
    """z slabs with half overlap, each a square box around the mask's mean place inside the slab; empty slabs are left out."""
    hit = box_join(slab_tiles(volumes, size), mask.select("volume_id", *VOXEL))
    mean = hit.groupBy("volume_id", "z0", "dz").agg(F.avg("y").cast("int").alias("_y"), F.avg("x").cast("int").alias("_x"))
    rows = mean.join(volumes.select("volume_id", "ny", "nx"), "volume_id")
    cols = []
    for axis in ("y", "x"):
        n = F.col(f"n{axis}")
        start = F.least(F.greatest(F.col(f"_{axis}") - size // 2, F.lit(0)), F.greatest(n - size, F.lit(0)))
        cols += [start.alias(f"{axis}0"), F.least(F.lit(size), n).alias(f"d{axis}")]
    return rows.select("volume_id", "z0", "dz", *cols)


def extract_tiles(tiles: DataFrame, voxels: DataFrame, size: tuple[int, int, int], normalise: bool = True, parts: int | None = None) -> DataFrame:
    """Tile voxels with coordinates from the tile corner, z-scored before the (absent, zero) padding."""
    rows = box_join(tiles, voxels, parts=parts).select(*TILE, *[(F.col(a) - F.col(f"{a}0")).alias(f"p{a}") for a in VOXEL], "v")
    return zscore(rows, TILE) if normalise else rows


def tile_arrays(tile_voxels: DataFrame, size: tuple[int, int, int], parts: int | None = None) -> DataFrame:
    """One row per tile: positions and values, the shape a model wants; a tile has a fixed greatest size."""
    at = (F.col("pz") * size[1] + F.col("py")) * size[2] + F.col("px")
    cells = F.array_sort(F.collect_list(F.struct(at.alias("i"), F.col("v"))))
    rows = tile_voxels.repartition(parts, *TILE) if parts else tile_voxels
    packed = rows.groupBy(*TILE).agg(cells.alias("_c"))
    return packed.select(*TILE, F.transform("_c", lambda s: s["i"]).alias("at"), F.transform("_c", lambda s: s["v"]).alias("data"))


def predict(
    tiles: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str
) -> DataFrame:
    """Run the caller's model over tile rows; ``load`` is called once per task, the result once per batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            model = load() if model is None else model
            yield model(pdf)

    return tiles.mapInPandas(run, schema)


def predict_guarded(
    tiles: DataFrame,
    load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    keys: Sequence[str],
    schema: str,
    fallback: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
) -> DataFrame:
    """Like ``predict``, but a failing row gives status ``failed`` with the error text, and the batch goes on.

    The model gets whole batches; only a batch that fails is given again row by row. A failed row's results are those of
    ``fallback`` (such as ``zero_mask``), or empty.
    """
    types = T._parse_datatype_string(schema)
    names = [f.name for f in types.fields]
    key_types = dict(tiles.dtypes)
    full = ", ".join([f"`{k}` {key_types[k]}" for k in keys]) + f", {schema}, status string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None

        def answer(pdf: pd.DataFrame) -> pd.DataFrame:
            out = model(pdf)[names].reset_index(drop=True)
            if len(out) != len(pdf):
                raise ValueError(f"{len(out)} results for {len(pdf)} rows")
            return out.assign(status="ok", error=None)

        def one(row: pd.DataFrame) -> pd.DataFrame:
            try:
                return answer(row)
            except Exception as e:  # noqa: BLE001 - one bad item must not stop the batch
                out = fallback(row)[names].reset_index(drop=True) if fallback else pd.DataFrame([dict.fromkeys(names)])
                return out.assign(status="failed", error=str(e))

        for pdf in batches:
            if not len(pdf):
                continue
            model = load() if model is None else model
            pdf = pdf.reset_index(drop=True)
            try:
                out = answer(pdf)
            except Exception:  # noqa: BLE001 - the rows are tried one by one
                out = pd.concat([one(pdf.iloc[i : i + 1]) for i in range(len(pdf))], ignore_index=True)
            for k in keys:
                out[k] = pdf[k]
            yield out[[*keys, *names, "status", "error"]]

    return tiles.mapInPandas(run, full)


def zero_mask(row: pd.DataFrame) -> pd.DataFrame:
    """The tile without foreground."""
    return row.assign(data=[np.zeros(len(d)) for d in row["data"]])


def tile_voxels(tiles: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """Tile arrays (at, data) to one row per cell, with coordinates from the tile's corner."""
    at = F.col("_c.at")
    plane = size[1] * size[2]
    place = [F.floor(at / plane), F.floor(at % plane / size[2]), at % size[2]]
    rows = tiles.select(*TILE, F.explode(F.arrays_zip("at", "data")).alias("_c"))
    return rows.select(*TILE, *(p.cast("int").alias(f"p{a}") for p, a in zip(place, VOXEL)), F.col("_c.data").alias("v"))


def unpack_tiles(predicted: DataFrame, size: tuple[int, int, int], value: str = "data") -> DataFrame:
    """Predicted tile arrays (at, data) back to volume voxels."""
    rows = predicted.select(*TILE, F.explode(F.arrays_zip("at", value)).alias("_c"))
    at = F.col("_c.at")
    plane = size[1] * size[2]
    return rows.select(
        "volume_id",
        (F.col("z0") + F.floor(at / plane)).cast("int").alias("z"),
        (F.col("y0") + F.floor(at % plane / size[2])).cast("int").alias("y"),
        (F.col("x0") + at % size[2]).cast("int").alias("x"),
        F.col(f"_c.{value}").alias("v"),
        *[(F.floor(at / plane) if a == "z" else F.floor(at % plane / size[2]) if a == "y" else at % size[2]).alias(f"p{a}") for a in VOXEL],
    )


def stitch(rows: DataFrame, weight: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Overlapping predictions to one value per voxel: mean, or weighted mean.

    ``by`` are columns that follow from the voxel and by which the rows lie together, such as ``CELL``: then nothing is dealt anew.
    """
    w = F.lit(1.0) if weight is None else weight
    return rows.groupBy("volume_id", *by, *VOXEL).agg((F.sum(w * F.col("v")) / F.sum(w)).alias("v")).drop(*by)


def gaussian_weight(size: tuple[int, int, int], sigma_scale: float = 0.125) -> Column:
    """Weight of a tile voxel (pz, py, px): falls off from the tile centre."""
    total = F.lit(0.0)
    for axis, s in zip(VOXEL, size):
        total = total + F.pow((F.col(f"p{axis}") - (s - 1) / 2.0) / (s * sigma_scale), 2)
    return F.exp(-total / 2.0)


def vote(rows: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Mean of hard 0/1 votes above the threshold."""
    return stitch(rows, by=by).filter(F.col("v") > threshold).select("volume_id", *VOXEL, F.lit(1).alias("label"))


def sigmoid(value: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-value))


def argmax_channel(rows: DataFrame, value: str = "v") -> DataFrame:
    """Channel of the greatest value per voxel; the lowest channel wins a tie."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col("c")).alias("c")))
    return rows.groupBy("volume_id", *VOXEL).agg(best.alias("_b")).select("volume_id", *VOXEL, (-F.col("_b.c")).cast("int").alias("label"))


def merge_channels(rows: DataFrame) -> DataFrame:
    """Four class probabilities to background 1 - (p2 + p3) and foreground p2 + p3."""
    fg = F.sum(F.when(F.col("c").isin(2, 3), F.col("v")).otherwise(0.0))
    merged = rows.groupBy("volume_id", *VOXEL).agg(fg.alias("_f"))
    both = F.array(F.struct(F.lit(0).alias("c"), (1.0 - F.col("_f")).alias("v")), F.struct(F.lit(1).alias("c"), F.col("_f").alias("v")))
    return merged.select("volume_id", *VOXEL, F.explode(both).alias("_p")).select("volume_id", *VOXEL, "_p.c", "_p.v")


def view_vote(view_masks: DataFrame, views: DataFrame) -> DataFrame:
    """Masks of permuted views (view, a, b, c) to voxels kept by a majority of the views the volume has."""
    present = views.groupBy("volume_id").agg(F.countDistinct("view").alias("_k"))
    votes = undo_view(view_masks).groupBy("volume_id", *VOXEL).agg(F.countDistinct("view").alias("votes"))
    return fact_join(votes, present, ["volume_id"]).filter(F.col("votes") * 2 > F.col("_k")).drop("_k")


def view_consensus(view_masks: DataFrame, views: DataFrame, volumes: DataFrame, connectivity: int = 3) -> DataFrame:
    """Objects of the voxels that most views hold, for the volumes that every view in use has.

    ``views`` lists (volume_id, view); a view that no volume has plays no part.
    """
    in_use = views.select("view").distinct().agg(F.count("*").alias("_all"))
    held = views.groupBy("volume_id").agg(F.countDistinct("view").alias("_own"))
    # One number, so this is a constant column and no product of tables.
    common = held.join(F.broadcast(in_use), F.col("_own") == F.col("_all")).select("volume_id")
    voted = view_vote(fact_join(view_masks, common, ["volume_id"], "left_semi"), views)
    return connected_components(voted.select("volume_id", *VOXEL, F.lit(1).alias("label")), volumes, connectivity)


def parameter_grid(spark, params: dict[str, Sequence]) -> DataFrame:
    """Every combination of the listed parameter values, one column per parameter."""
    return sweep(spark.range(1), params).drop("id")


def sweep(rows: DataFrame, params: dict[str, Sequence]) -> DataFrame:
    """Repeat each row for every parameter combination (the grid is constant, so no join is made)."""
    for name, values in params.items():
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return rows
