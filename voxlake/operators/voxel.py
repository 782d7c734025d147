"""Voxel value operators: masks, scaling, windows, scores, labels, intensity changes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from voxlake.operators import whole as wh
from voxlake.operators.joins import VOXEL, box_join, densify, fact_join
from voxlake.operators.ranks import exact_percentiles, hash_unit

KEYS = ("volume_id",)


def uint8_violations(voxels: DataFrame, value: str = "v") -> DataFrame:
    """Rows that are not whole numbers in 0..255."""
    v = F.col(value)
    return voxels.filter(v.isNull() | (v < 0) | (v > 255) | (v != F.floor(v)))


def require_uint8(voxels: DataFrame, value: str = "v") -> DataFrame:
    """Raise at run time on the first row that breaks the uint8 contract; no extra pass."""
    v = F.col(value)
    bad = v.isNull() | (v < 0) | (v > 255) | (v != F.floor(v))
    text = F.concat(F.lit("not a uint8 value: "), v.cast("string"))
    return voxels.withColumn(value, F.when(bad, F.raise_error(text)).otherwise(v))


def binarize(voxels: DataFrame, value: str = "v") -> DataFrame:
    return voxels.withColumn(value, F.when(F.col(value) > 0, 1).otherwise(0))


def with_range(voxels: DataFrame, value: str = "v", keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds vmin and vmax of the volume to each voxel."""
    stats = voxels.groupBy(*keys).agg(F.min(value).alias("vmin"), F.max(value).alias("vmax"))
    return fact_join(voxels, stats, keys)


def to_uint8(voxels: DataFrame, value: str = "v", kind: str = "float") -> DataFrame:
    """``float``/``any``: min-max to 0..255, cut towards zero, flat volumes to 0. ``int``: clip to 0..255.

    ``frame``: as float, but flat volumes keep their values.
    """
    v = F.col(value)
    if kind == "int":
        return voxels.withColumn(value, F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("int"))
    rows = with_range(voxels, value)
    span = F.col("vmax") - F.col("vmin")
    flat = v.cast("int") if kind == "frame" else F.lit(0)
    scaled = F.when(span == 0, flat).otherwise(((v - F.col("vmin")) / span * 255).cast("int"))
    return rows.withColumn(value, scaled).drop("vmin", "vmax")


def normalize(voxels: DataFrame, low: float, high: float, mode: str = "minmax", axis: str | None = None, value: str = "v") -> DataFrame:
    """Scale to [low, high] over the whole volume or along one axis.

    ``minmax`` reaches both ends; ``as_computed`` leaves the minimum in. A flat range counts as 1. An axis
    window covers one image line, so it stays small for any volume.
    """
    v = F.col(value)
    if axis is None:
        rows = with_range(voxels, value)
    else:
        line = Window.partitionBy("volume_id", *[a for a in VOXEL if a != axis])
        rows = voxels.withColumn("vmin", F.min(value).over(line)).withColumn("vmax", F.max(value).over(line))
    span = F.col("vmax") - F.col("vmin")
    span = F.when(span == 0, 1.0).otherwise(span)
    start = v - F.col("vmin") if mode == "minmax" else v
    return rows.withColumn(value, start / span * (high - low) + low).drop("vmin", "vmax")


def clip_scale(value: Column, low: float, high: float) -> Column:
    """Fixed window to 0..1, clipped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


def percentile_window(voxels: DataFrame, low: float = 0.00001, high: float = 0.99999, top: float = 1000.0, parts: int | None = None, volumes: DataFrame | None = None) -> DataFrame:
    """Map the percentile window of finite non-zero voxels to 0..top, clamped.

    Volumes whose window is empty or flat use all finite voxels; then (0, 1). With ``volumes`` the voxels are sparse, absent cells and
    values are zeros, and every cell is given: volumes that fit a task are made dense and mapped in one visit.
    """
    if volumes is not None:
        small, large, tasks = wh.told_apart(volumes)
        mapped = None if small is None else _whole_windows(voxels, small, low, high, top, tasks)
        if large is None:
            return mapped
        others = percentile_window(densify(voxels, large, {"v": 0.0}), low, high, top, parts)
        return others if mapped is None else mapped.unionByName(others)
    v = F.col("v")
    finite = voxels.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    groups = F.when(v != 0, F.array(F.lit("nonzero"), F.lit("all"))).otherwise(F.array(F.lit("all")))
    both = finite.select(*KEYS, "v", F.explode(groups).alias("_g"))
    pct = exact_percentiles(both, [*KEYS, "_g"], "v", [low, high], "_p", parts)
    usable = F.when((F.col("_g") == "nonzero") & (F.col("_p")[0] < F.col("_p")[1]), F.col("_p"))
    window = pct.groupBy(*KEYS).agg(
        F.coalesce(F.max(usable), F.max(F.when(F.col("_g") == "all", F.col("_p")))).alias("_p")
    )
    rows = fact_join(voxels, window, KEYS, "left", parts)
    lo, hi = F.coalesce(F.col("_p")[0], F.lit(0.0)), F.coalesce(F.col("_p")[1], F.lit(1.0))
    out = F.when(v <= lo, 0.0).when(v >= hi, top).otherwise((v - lo) / (hi - lo) * top)
    return rows.withColumn("v", out).drop("_p")


def _whole_windows(sparse: DataFrame, volumes: DataFrame, low: float, high: float, top: float, parts: int) -> DataFrame:
    """``percentile_window`` of all cells of volumes that fit a task each: one shuffle of the sparse voxels."""

    def window(values: np.ndarray, of: np.ndarray, volumes: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.zeros(volumes), np.ones(volumes)
        finite = np.isfinite(values)
        seen = finite & (values != 0)
        many, (a, b) = wh.percentiles(values[finite], of[finite], volumes, (low, high))
        lo, hi = np.where(many > 0, a, lo), np.where(many > 0, b, hi)
        many, (a, b) = wh.percentiles(values[seen], of[seen], volumes, (low, high))
        usable = (many > 0) & (a < b)
        return np.where(usable, a, lo), np.where(usable, b, hi)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in wh.groups(batches, KEYS):
            if not len(g.heads):
                continue
            rows, cell, first, many = wh.cells(g, 1)
            absent = np.ones(many.sum(), bool)
            absent[cell] = False
            # Cells that come twice are rows of their own.
            cell = np.concatenate([cell, np.flatnonzero(absent)])
            v = np.concatenate([g.column("v", rows), np.zeros(len(cell) - len(rows))])
            of, z, y, x = wh.places(g, cell, first, many)
            lo, hi = (w[of] for w in window(v, of, len(many)))
            with np.errstate(invalid="ignore", divide="ignore"):
                # A number that isn't one counts as the greatest.
                out = np.where(v <= lo, 0.0, np.where((v >= hi) | np.isnan(v), top, (v - lo) / (hi - lo) * top))
            cols = [pa.array(c.astype(np.int32)) for c in (z, y, x)]
            yield from pa.table([*g.keys(KEYS, of), *cols, pa.array(out)], names=[*KEYS, *VOXEL, "v"]).to_batches()

    heads = volumes.select(*KEYS, *(F.col(n).cast("int").alias(n) for n in wh.SIZE))
    rows = sparse.filter(F.col("volume_id").isNotNull()).select(*KEYS, *VOXEL, F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v"))
    kind = dict(volumes.dtypes)["volume_id"]
    return wh.beside(heads, [rows], KEYS, parts).mapInArrow(run, f"volume_id {kind}, z int, y int, x int, v double")


def zscore(rows: DataFrame, keys: Sequence[str], value: str = "v", eps: float = 1e-6) -> DataFrame:
    """(v - mean) / (population std + eps) inside each tile; a tile has a fixed greatest size."""
    w = Window.partitionBy(*keys)
    v = F.col(value)
    return rows.withColumn(value, (v - F.avg(v).over(w)) / (F.stddev_pop(v).over(w) + eps))


def foreground_zscore(voxels: DataFrame, boxes: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Mean and sample std of v > 0 inside one box per volume, applied to the whole volume.

    A volume without foreground in its box has mean 0; one with fewer than two such voxels has std 1.
    """
    inside = box_join(boxes, voxels.filter("v > 0"))
    stats = inside.groupBy(*KEYS).agg(F.avg("v").alias("_m"), F.stddev_samp("v").alias("_s"))
    rows = fact_join(voxels, stats, KEYS, "left")
    scaled = (F.col("v") - F.coalesce("_m", F.lit(0.0))) / F.coalesce(F.col("_s") + eps, F.lit(1.0))
    return rows.withColumn("v", scaled).drop("_m", "_s")


def remap_labels(labels: DataFrame, wanted: Sequence[int], channels: int | None = None) -> DataFrame:
    """The i-th wanted label becomes i (from 1), all others 0."""
    if channels is not None and channels != len(wanted):
        raise ValueError("one label per channel is needed")
    new = F.lit(0)
    for i, label in reversed(list(enumerate(wanted, 1))):
        new = F.when(F.col("label") == label, i).otherwise(new)
    return labels.withColumn("label", new)


def class_masks(labels: DataFrame) -> DataFrame:
    """One binary mask per class: the class becomes a key column."""
    return labels.filter("label <> 0").withColumn("class", F.col("label"))


def merge_classes(masks: DataFrame) -> DataFrame:
    """Per-class masks to one label volume; the larger class overwrites."""
    return masks.groupBy("volume_id", *VOXEL).agg(F.max("class").alias("label"))


def _voxel_unit(tag: str, seed: int) -> Column:
    return hash_unit(F.concat_ws("|", *[F.col(c).cast("string") for c in ("volume_id", *VOXEL)], F.lit(tag), F.lit(str(seed))))


def hash_normal(tag: str, seed: int) -> Column:
    """Standard normal draw per voxel from its own key (Box-Muller), the same on every run."""
    u1, u2 = _voxel_unit(tag + "1", seed), _voxel_unit(tag + "2", seed)
    # Never null; said so, as a join on what is made of it would else draw all of it twice to leave nulls out.
    return F.coalesce(F.sqrt(-2.0 * F.log(1.0 - u1)) * F.cos(2.0 * math.pi * u2), F.lit(0.0))


def draw(low: float, high: float, tag: str, seed: int) -> Column:
    """One number in [low, high) per volume."""
    return low + (high - low) * hash_unit(F.concat_ws("|", F.col("volume_id").cast("string"), F.lit(tag), F.lit(str(seed))))


def scale_gamma(voxels: DataFrame, seed: int, scale=(0.8, 1.2), gamma=(0.7, 1.5)) -> DataFrame:
    v = F.greatest(F.col("v") * draw(*scale, "scale", seed), F.lit(1e-6))
    return voxels.withColumn("v", F.pow(v, draw(*gamma, "gamma", seed)))


def gaussian_noise(voxels: DataFrame, seed: int, share: float = 0.01) -> DataFrame:
    """Adds noise of share x the volume's population std."""
    stats = voxels.groupBy(*KEYS).agg(F.stddev_pop("v").alias("_s"))
    rows = fact_join(voxels, stats, KEYS)
    return rows.withColumn("v", F.col("v") + hash_normal("noise", seed) * share * F.col("_s")).drop("_s")


def poisson_noise(voxels: DataFrame, seed: int) -> DataFrame:
    """Poisson draw with mean max(v, 0): the count where the running probability passes the voxel's own number.

    That number has 32 bits, so the count lies within 7 deviations of the mean; the running sums start and end further out
    (all the way down for small means). The work for a mean grows as its square root, and equal means share it.
    """

    @pandas_udf("double")
    def quantile(mean: pd.Series, u: pd.Series) -> pd.Series:
        means, place = np.unique(mean.to_numpy(), return_inverse=True)
        want, out = u.to_numpy(), np.zeros(len(mean))
        order = np.argsort(place, kind="stable")
        ends = np.searchsorted(place[order], np.arange(len(means) + 1))
        for lam, a, b in zip(means, ends, ends[1:]):
            if lam > 0:
                reach = 12 * math.sqrt(lam) + 40
                first = max(0, math.floor(lam - reach))
                k = np.arange(first + 1, math.ceil(lam + reach) + 1)
                log_first = -lam if first == 0 else first * math.log(lam) - lam - math.lgamma(first + 1)
                log_p = np.concatenate([[log_first], log_first + np.cumsum(math.log(lam) - np.log(k))])
                out[order[a:b]] = first + np.searchsorted(np.cumsum(np.exp(log_p)), want[order[a:b]], "left")
        return pd.Series(out)

    return voxels.withColumn("v", quantile(F.greatest("v", F.lit(0.0)), _voxel_unit("poisson", seed)))


def expand_channels(voxels: DataFrame, channels: int = 3) -> DataFrame:
    """Single-channel voxels repeated over channels 0..n-1."""
    return voxels.withColumn("c", F.explode(F.array(*[F.lit(i) for i in range(channels)])))


def truncate_channels(voxels: DataFrame, channels: int = 3) -> DataFrame:
    return voxels.filter(F.col("c") < channels)
