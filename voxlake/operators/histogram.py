"""Histograms, thresholds, local statistics and volume reductions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from voxlake.operators.joins import VOXEL, fact_join
from voxlake.operators.ranks import exact_percentiles
from voxlake.session import cut_lineage, dealt

BINS = 256


def cell_count(volumes: DataFrame, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Number of grid cells per key: whole volumes, or slices when z is a key."""
    rows = volumes.select("volume_id", "nz", "ny", "nx")
    if "z" not in keys:
        return rows.select("volume_id", (F.col("nz").cast("bigint") * F.col("ny") * F.col("nx")).alias("cells"))
    rows = rows.filter("nz > 0").withColumn("z", F.explode(F.sequence(F.lit(0), F.col("nz") - 1)))
    return rows.select("volume_id", "z", (F.col("ny").cast("bigint") * F.col("nx")).alias("cells"))


def histogram(
    voxels: DataFrame, kind: str | None = "int", keys: Sequence[str] = ("volume_id",), volumes: DataFrame | None = None, value: str = "v",
    parts: int | None = None,
) -> DataFrame:
    """(keys, bin, center, n, bins, lo, hi, spread) of non-empty bins.

    ``int``: one bin per value, and an error on a fraction; ``float``: 256 equal bins from minimum to maximum, named by
    their centre. ``None`` takes the kind from the column's type.
    With ``volumes`` the voxels are sparse and the absent cells count as zeros without being made. ``parts`` is for keys of bounded
    size, such as slices that fit a task: an ``int`` histogram then deals whole keys over so many partitions, in one shuffle.
    """
    keys = list(keys)
    v = F.col(value)
    if kind is None:
        kind = "int" if isinstance(voxels.schema[value].dataType, IntegralType) else "float"
    if kind == "int":
        return _value_histogram(voxels.select(*keys, v.cast("double").alias("v")), keys, volumes, parts)
    data = voxels.select(*keys, v.cast("double").alias("v"), *[c for c in VOXEL if c in voxels.columns and c not in keys])
    stored = data.groupBy(*keys).agg(F.count("*").alias("_have"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    zero = None
    if volumes is not None:
        every = cell_count(volumes, keys).join(stored, keys, "left").na.fill({"_have": 0})
        absent = F.col("cells") - F.col("_have")
        stored = every.select(
            *keys,
            F.when(absent > 0, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("lo"),
            F.when(absent > 0, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("hi"),
            absent.alias("_absent"),
        )
        zero = stored.filter("_absent > 0").select(*keys, F.lit(0.0).alias("v"), "lo", "hi", F.col("_absent").alias("n"))
    facts = stored.select(*keys, "lo", "hi")
    rows = fact_join(data, facts, keys)
    rows = rows.select(*keys, "v", "lo", "hi", F.lit(1).cast("bigint").alias("n"))
    if zero is not None:
        rows = rows.unionByName(zero)
    span = F.col("hi") - F.col("lo")
    bin_ = F.least(F.floor((F.col("v") - F.col("lo")) / span * BINS), F.lit(BINS - 1)).cast("int")
    bin_ = F.when(span > 0, bin_).otherwise(0)
    center = F.when(span > 0, F.col("lo") + (F.col("bin") + 0.5) * span / BINS).otherwise(F.col("lo"))
    bins = F.when(span > 0, F.lit(BINS)).otherwise(1)
    counted = rows.withColumn("bin", bin_).groupBy(*keys, "lo", "hi", "bin").agg(F.sum("n").alias("n"))
    return counted.select(*keys, "bin", center.alias("center"), "n", bins.alias("bins"), "lo", "hi", F.lit(True).alias("spread"))


def _value_histogram(data: DataFrame, keys: list[str], volumes: DataFrame | None, parts: int | None = None) -> DataFrame:
    """One pass: count per value, then minimum and maximum from the counts."""
    if parts:
        rows = data.select(*keys, "v", F.lit(1).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("_have"))
        if volumes is not None:
            rows = rows.unionByName(cell_count(volumes, keys).select(*keys, F.lit(0.0).alias("v"), F.col("cells").alias("n"), F.lit(0).cast("bigint").alias("_have")))
        counts = dealt(rows, parts, *keys).groupBy(*keys, "v").agg(F.sum("n").alias("n"), F.sum("_have").alias("_have"))
        whole = Window.partitionBy(*keys)
        if volumes is not None:
            # Every stored row takes one cell away from the zeros of its key.
            counts = counts.withColumn("_all", F.sum("_have").over(whole)).withColumn("n", F.col("n") - F.when(F.col("v") == 0, F.col("_all")).otherwise(0))
        counts = counts.select(*keys, "v", "n").filter("n > 0")
        return _value_bins(counts.withColumn("lo", F.min("v").over(whole)).withColumn("hi", F.max("v").over(whole)), keys)
    counts = data.groupBy(*keys, "v").agg(F.count("*").alias("n"))
    if volumes is not None:
        # Every stored row takes one cell away from the zeros of its key, so the voxels are read once.
        pair = F.array(F.struct("v", "n"), F.struct(F.lit(0.0).alias("v"), (-F.col("n")).alias("n")))
        signed = counts.select(*keys, F.explode(pair).alias("_p")).select(*keys, "_p.v", "_p.n")
        cells = cell_count(volumes, keys).select(*keys, F.lit(0.0).alias("v"), F.col("cells").alias("n"))
        counts = signed.unionByName(cells).groupBy(*keys, "v").agg(F.sum("n").alias("n")).filter("n > 0")
    return _value_bins(fact_join(counts, counts.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi")), keys), keys)


def _value_bins(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Bins of ``histogram`` from counted values with their key's extremes."""
    fraction = F.concat(F.lit("an int histogram needs whole numbers, not "), F.col("v").cast("string"))
    return rows.select(
        *keys,
        F.when(F.col("v") == F.floor("v"), (F.col("v") - F.col("lo")).cast("int")).otherwise(F.raise_error(fraction)).alias("bin"),
        F.col("v").alias("center"),
        "n",
        (F.col("hi") - F.col("lo") + 1).cast("int").alias("bins"),
        "lo",
        "hi",
        F.lit(False).alias("spread"),
    )


def otsu(hist: DataFrame, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Threshold with the greatest variance between the two classes; the lower bin wins a tie.

    Runs on the histogram alone; a constant image gives its value.
    """
    keys = list(keys)
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    weighted = F.col("n") * F.col("center")
    rows = hist.select(
        *keys,
        "bin",
        "center",
        F.sum("n").over(up).alias("w1"),
        F.sum(weighted).over(up).alias("s1"),
        F.sum("n").over(whole).alias("w"),
        F.sum(weighted).over(whole).alias("s"),
    )
    w2 = F.col("w") - F.col("w1")
    gap = F.col("s1") / F.col("w1") - (F.col("s") - F.col("s1")) / w2
    score = F.when(w2 > 0, F.col("w1") * w2 * gap * gap).otherwise(-1.0)
    best = F.max(F.struct(score.alias("score"), (-F.col("bin")).alias("b"), F.col("center")))
    return rows.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.center").alias("threshold"))


#: Whole numbers of one coarse bin.
RADIX = 1 << 16


def otsu_values(voxels: DataFrame, keys: Sequence[str] = ("volume_id",), volumes: DataFrame | None = None, value: str = "v") -> DataFrame:
    """``otsu`` of whole numbers of any width, one bin for each value, without a window over all of a key's values.

    Coarse bins of ``RADIX`` numbers come first. The difference of the classes grows up to the mean and falls after it, so a
    bin's edges bound the score inside it; only bins that could hold the greatest one are looked at value by value, each in a
    window of its own. With ``volumes`` the voxels are sparse and the absent cells are zeros.
    """
    keys = list(keys)
    counts = voxels.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    if volumes is not None:
        held = voxels.groupBy(*keys).agg(F.count("*").alias("_have"))
        absent = cell_count(volumes, keys).join(held, keys, "left").select(*keys, F.lit(0.0).alias("v"), (F.col("cells") - F.coalesce("_have", F.lit(0))).alias("n"))
        counts = counts.unionByName(absent.filter("n > 0")).groupBy(*keys, "v").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts.withColumn("part", F.floor(F.col("v") / RADIX)))
    parts = counts.groupBy(*keys, "part").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("s"))
    up = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    rows = parts.select(
        *keys, "part", F.sum("n").over(whole).alias("w"), F.sum("s").over(whole).alias("all"), F.sum("n").over(up).alias("w1"), F.sum("s").over(up).alias("s1"),
        (F.sum("n").over(up) - F.col("n")).alias("w0"), (F.sum("s").over(up) - F.col("s")).alias("s0"),
    )
    rows = rows.withColumn("best", F.max(_between(F.col("w1"), F.col("s1"), F.col("w"), F.col("all"))).over(whole))
    mean = F.col("all") / F.col("w")
    off = lambda w, s: F.abs(F.col(s) - F.col(w) * mean)
    room = F.least(F.col("w0") * (F.col("w") - F.col("w0")), F.col("w1") * (F.col("w") - F.col("w1")))
    bound = F.when((mean >= (F.col("part") + 1) * RADIX) & (room > 0), off("w1", "s1")).when((mean < F.col("part") * RADIX) & (room > 0), off("w0", "s0"))
    bound = F.pow(bound * F.col("w"), 2) / room
    # No bound where the mean lies, or at either end of the values; a margin for rounding.
    open_parts = rows.filter(bound.isNull() | (bound * (1 + 1e-9) >= F.col("best"))).select(*keys, "part", "w", "all", "w0", "s0")
    inside = fact_join(counts, open_parts, [*keys, "part"])
    upto = Window.partitionBy(*keys, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.select(*keys, "v", "w", "all", (F.col("w0") + F.sum("n").over(upto)).alias("w1"), (F.col("s0") + F.sum(F.col("n") * F.col("v")).over(upto)).alias("s1"))
    score = _between(F.col("w1"), F.col("s1"), F.col("w"), F.col("all"))
    return inside.groupBy(*keys).agg(F.max(F.struct(score.alias("score"), (-F.col("v")).alias("v"))).alias("_b")).select(*keys, (-F.col("_b.v")).alias("threshold"))


def _between(w1: Column, s1: Column, w: Column, s: Column) -> Column:
    """Variance between the classes of w1 values (their sum s1) and the rest, times w x w; -1 without a rest."""
    gap = s1 / w1 - F.try_divide(s - s1, w - w1)
    return F.when(w > w1, w1 * (w - w1) * gap * gap).otherwise(-1.0)


def otsu_of(voxels: DataFrame, volumes: DataFrame, keys: Sequence[str] = ("volume_id",), value: str = "v") -> DataFrame:
    """Otsu's threshold of sparse voxels: by value for whole numbers, by 256 bins for others."""
    if isinstance(voxels.schema[value].dataType, IntegralType):
        return otsu_values(voxels, keys, volumes, value)
    return otsu(histogram(voxels, "float", keys, volumes, value), keys)


def triangle(hist: DataFrame, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Bin furthest from the line between the histogram's peak and the end of its longer tail.

    Whole-number distances, so ties are exact; the first bin from the tail wins. Over a run of empty bins the
    distance only grows, so the run's last bin stands for all of it and empty bins are never made.
    """
    keys = list(keys)
    whole = Window.partitionBy(*keys)
    rows = hist.select(
        *keys,
        *["bin", "n", "bins", "lo", "hi", "spread"],
        F.max(F.struct("n", (-F.col("bin")).alias("b"))).over(whole).alias("_p"),
        F.min("bin").over(whole).alias("_first"),
        F.max("bin").over(whole).alias("_last"),
    )
    peak = -F.col("_p.b")
    flip = (peak - F.col("_first")) < (F.col("_last") - peak)
    turn = lambda c: F.when(F.col("_flip"), F.col("bins") - 1 - c).otherwise(c)
    rows = rows.withColumn("_flip", flip).select(
        *keys,
        *["n", "bins", "lo", "hi", "spread", "_flip"],
        turn(F.col("bin")).alias("j"),
        turn(peak).alias("_peak"),
        F.when(F.col("_flip"), F.col("bins") - 1 - F.col("_last")).otherwise(F.col("_first")).alias("_low"),
        F.col("_p.n").alias("_high"),
    )
    before = F.lag("j").over(Window.partitionBy(*keys).orderBy("j"))
    last_empty = F.when(before < F.col("j") - 1, F.struct((F.col("j") - 1).alias("j"), F.lit(0).cast("bigint").alias("n")))
    rows = rows.withColumn("_e", last_empty)
    rows = rows.withColumn("_s", F.explode(F.array_compact(F.array(F.struct("j", "n"), F.col("_e")))))
    j = F.col("_s.j")
    dist = F.col("_high") * (j - F.col("_low")) - (F.col("_peak") - F.col("_low")) * F.col("_s.n")
    valid = (j >= F.col("_low")) & (j < F.col("_peak"))
    best = F.max(F.when(valid, F.struct(dist.alias("d"), (-j).alias("j"), turn(j).alias("bin"))))
    found = rows.groupBy(*keys, "lo", "hi", "spread").agg(best.alias("_b"))
    step = (F.col("hi") - F.col("lo")) / BINS
    at = F.coalesce("_b.bin", F.lit(0))
    center = F.when(F.col("spread") & (step > 0), F.col("lo") + (at + 0.5) * step).otherwise(F.col("lo") + at)
    return found.select(*keys, center.alias("threshold"))


def above(
    voxels: DataFrame, thresholds: DataFrame, keys: Sequence[str] = ("volume_id",), value: str = "v", keep: Sequence[str] = (), parts: int | None = None
) -> DataFrame:
    """Foreground rows: value greater than the threshold of the key; with the columns ``keep`` of the thresholds' table."""
    rows = fact_join(voxels, thresholds.select(*keys, "threshold", *keep), list(keys), parts=parts)
    return rows.filter(F.col(value) > F.col("threshold")).select("volume_id", *VOXEL, F.lit(1).alias("label"), *keep)


def triangle_of(values: np.ndarray) -> float:
    """``triangle`` of the ``float`` histogram of an array that holds all cells of its key."""
    lo, hi = float(values.min()), float(values.max())
    if not hi > lo:
        return lo
    n = np.bincount(np.minimum(np.floor((values.ravel() - lo) / (hi - lo) * BINS), BINS - 1).astype(np.int64), minlength=BINS)
    step, full, peak = (hi - lo) / BINS, np.flatnonzero(n), int(n.argmax())
    flip = peak - full[0] < full[-1] - peak
    if flip:
        n, peak = n[::-1], BINS - 1 - peak
    low = int(BINS - 1 - full[-1] if flip else full[0])
    at = 0
    if low < peak:
        j = np.arange(low, peak)
        at = low + int((n[peak] * (j - low) - (peak - low) * n[low:peak]).argmax())
        at = BINS - 1 - at if flip else at
    return lo + (at + 0.5) * step


def otsu_of_rows(values: np.ndarray) -> np.ndarray:
    """``otsu`` of the ``float`` histogram of each row, which holds all cells of a key."""
    if len(values) > 4096:
        return np.concatenate([otsu_of_rows(values[i : i + 4096]) for i in range(0, len(values), 4096)])
    lo, hi = values.min(1, keepdims=True), values.max(1, keepdims=True)
    span = hi - lo
    wide = np.where(span > 0, span, 1.0)
    bins = np.where(span > 0, np.minimum(np.floor((values - lo) / wide * BINS), BINS - 1), 0).astype(np.int64)
    n = np.bincount((np.arange(len(values))[:, None] * BINS + bins).ravel(), minlength=len(values) * BINS).reshape(-1, BINS)
    center = np.where(span > 0, lo + (np.arange(BINS) + 0.5) * span / BINS, lo)
    w1, s1 = np.cumsum(n, 1), np.cumsum(n * center, 1)
    w2 = w1[:, -1:] - w1
    gap = s1 / np.maximum(w1, 1) - (s1[:, -1:] - s1) / np.maximum(w2, 1)
    score = np.where(n > 0, np.where(w2 > 0, w1 * w2 * gap * gap, -1.0), -np.inf)
    return center[np.arange(len(n)), score.argmax(1)]


def percentile_mask(voxels: DataFrame, percentile: float = 90.0, keys: Sequence[str] = ("volume_id",), value: str = "v") -> DataFrame:
    """Voxels above an exact percentile of their volume or slice."""
    pct = exact_percentiles(voxels, keys, value, [percentile / 100.0], "_p")
    return above(voxels, pct.select(*keys, F.col("_p")[0].alias("threshold")), keys, value)


def _mirrored(rows: DataFrame, axis: str, reach: int) -> DataFrame:
    """Adds the mirror copies (edge cell not repeated) that lie within ``reach`` outside the line."""
    n, i = F.col(f"n{axis}"), F.col(axis)
    period = F.greatest(2 * (n - 1), F.lit(1))
    turns = F.sequence(-F.ceil(F.lit(reach) / period).cast("int") - 1, F.ceil(F.lit(reach) / period).cast("int") + 1)
    spots = F.flatten(F.transform(turns, lambda k: F.array(i + k * period, k * period - i)))
    inside = F.filter(F.array_distinct(spots), lambda p: (p >= -reach) & (p < n + reach))
    return rows.withColumn(axis, F.explode(inside))


def box_moments(dense: DataFrame, volumes: DataFrame, window: int, value: str = "v") -> DataFrame:
    """Mean and standard deviation in a square window of each slice, mirrored at the border.

    Two sliding sums, along x and then along y; each window runs over one image line.
    """
    reach = window // 2
    dims = volumes.select("volume_id", "ny", "nx")
    rows = fact_join(dense.select("volume_id", *VOXEL, F.col(value).alias("v")), dims, ["volume_id"])
    rows = rows.withColumn("s1", F.col("v")).withColumn("s2", F.col("v") * F.col("v"))
    for axis, other in (("x", "y"), ("y", "x")):
        line = Window.partitionBy("volume_id", "z", other).orderBy(axis).rangeBetween(-reach, reach)
        wide = _mirrored(rows, axis, reach)
        v = F.when((F.col(axis) >= 0) & (F.col(axis) < F.col(f"n{axis}")), F.col("v"))
        rows = wide.select(
            "volume_id", *VOXEL, "ny", "nx", v.alias("v"), F.sum("s1").over(line).alias("s1"), F.sum("s2").over(line).alias("s2")
        ).filter((F.col(axis) >= 0) & (F.col(axis) < F.col(f"n{axis}")))
    cells = float(window * window)
    mean = F.col("s1") / cells
    var = F.greatest(F.col("s2") / cells - mean * mean, F.lit(0.0))
    return rows.select("volume_id", *VOXEL, "v", mean.alias("mean"), F.sqrt(var).alias("std"))


def sauvola(dense: DataFrame, volumes: DataFrame, window: int = 25, k: float = 0.2, r: float = 127.5) -> DataFrame:
    """Foreground above mean x (1 + k (std / R - 1)) of the local window, slice by slice."""
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    rows = box_moments(dense, volumes, window)
    return rows.withColumn("threshold", F.col("mean") * (1 + k * (F.col("std") / r - 1)))


def label_set(labels: DataFrame) -> DataFrame:
    """The distinct labels of each volume with their voxel counts and coordinate sums, one row per label."""
    return labels.groupBy("volume_id", "label").agg(F.count("*").alias("voxels"), *[F.sum(a).alias(f"sum_{a}") for a in VOXEL])


def foreground_stats(labels: DataFrame, volumes: DataFrame) -> DataFrame:
    """Foreground fraction, number of labels and whole-number centroid (``label_set`` lists the labels)."""
    n = cell_count(volumes)
    stats = label_set(labels).groupBy("volume_id").agg(
        F.sum("voxels").alias("voxels"), F.count("*").alias("labels"), *[F.sum(f"sum_{a}").alias(a) for a in VOXEL]
    )
    rows = n.join(stats, "volume_id", "left")
    return rows.select(
        "volume_id",
        F.coalesce("voxels", F.lit(0)).alias("voxels"),
        (F.coalesce("voxels", F.lit(0)) / F.col("cells")).alias("fraction"),
        F.coalesce("labels", F.lit(0)).alias("labels"),
        *[(F.col(a) / F.col("voxels")).cast("int").alias(f"c{a}") for a in VOXEL],
    )


def pool(voxels: DataFrame, volumes: DataFrame, factor: int, value: str = "v") -> DataFrame:
    """Average pooling of sparse voxels; cells cut by the border are dropped and absent voxels are zero."""
    rows = fact_join(voxels, volumes.select("volume_id", "nz", "ny", "nx"), ["volume_id"])
    keep = F.lit(True)
    cols = []
    for axis in VOXEL:
        cell = F.floor(F.col(axis) / factor).cast("int")
        keep = keep & (cell < F.floor(F.col(f"n{axis}") / factor))
        cols.append(cell.alias(axis))
    kept = rows.filter(keep).select("volume_id", *cols, F.col(value).alias("v"))
    return kept.groupBy("volume_id", *VOXEL).agg((F.sum("v") / float(factor**3)).alias("v"))


def multiscale_l1(a: DataFrame, b: DataFrame, volumes: DataFrame, parts: int | None = None) -> DataFrame:
    """L1 + 0.5 L1 at half size + 0.25 L1 at quarter size.

    Pooling is linear, so the difference is pooled once per scale and empty cells never appear.
    """
    minus = b.select("volume_id", *VOXEL, (-F.col("v")).alias("v"))
    both = a.select("volume_id", *VOXEL, "v").unionByName(minus)
    both = both.repartition(parts, "volume_id", *VOXEL) if parts else both
    diff = both.groupBy("volume_id", *VOXEL).agg(F.sum("v").alias("v"))
    out = volumes.select("volume_id", "nz", "ny", "nx")
    total = F.lit(0.0)
    for factor, weight in ((1, 1.0), (2, 0.5), (4, 0.25)):
        level = diff if factor == 1 else pool(diff, volumes, factor)
        sums = level.groupBy("volume_id").agg(F.sum(F.abs("v")).alias(f"_s{factor}"))
        cells = F.lit(1)
        for axis in VOXEL:
            cells = cells * F.floor(F.col(f"n{axis}") / factor)
        out = out.join(sums, "volume_id", "left")
        total = total + F.when(cells > 0, weight * F.coalesce(F.col(f"_s{factor}"), F.lit(0.0)) / cells).otherwise(0.0)
    return out.select("volume_id", total.alias("loss"))


def running_average(log: DataFrame, keys: Sequence[str], order: str, bucket: Column, value: str, weight: str) -> DataFrame:
    """Weighted average of all rows so far; ``bucket`` rises with the order and keeps windows short."""
    keys = list(keys)
    rows = log.withColumn("_b", bucket).withColumn("_vw", F.col(value) * F.col(weight))
    sums = rows.groupBy(*keys, "_b").agg(F.sum("_vw").alias("_s"), F.sum(weight).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    base = sums.select(*keys, "_b", zero("_s").alias("_s0"), zero("_n").alias("_n0"))
    inner = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    part = rows.withColumn("_s", F.sum("_vw").over(inner)).withColumn("_n", F.sum(weight).over(inner)).join(base, [*keys, "_b"])
    n = F.col("_n0") + F.col("_n")
    avg = F.when(n > 0, (F.col("_s0") + F.col("_s")) / n).otherwise(F.col("_s0") + F.col("_s"))
    return part.withColumn("average", avg).drop("_b", "_vw", "_s", "_n", "_s0", "_n0")


def _match_points(voxels: DataFrame, keys: list[str], points: int, name: str, one: bool = False) -> DataFrame:
    """Minimum, mean, ``points`` evenly spaced percentiles of the values above the mean, and maximum, as one array."""
    facts = voxels.groupBy(*keys).agg(F.min("v").alias("_low"), F.avg("v").alias("_mean"), F.max("v").alias("_high"))
    bright = fact_join(voxels, facts.select(*keys, "_mean"), keys, one=one).filter(F.col("v") > F.col("_mean"))
    inner = exact_percentiles(bright, keys, "v", [i / (points + 1) for i in range(1, points + 1)], "_inner", one=one)
    flat = F.array_repeat(F.col("_high"), points)
    both = fact_join(facts, inner, keys, "left", one=one)
    return both.select(*keys, F.concat(F.array("_low", "_mean"), F.coalesce("_inner", flat), F.array("_high")).alias(name))


def match_histogram(voxels: DataFrame, template: DataFrame, points: int = 7) -> DataFrame:
    """Values of each volume mapped so that its histogram follows the template's.

    The map is linear between matching points of both: minimum, mean, percentiles above the mean, maximum. Both inputs are
    dense (every voxel a row) with v as double; a flat piece of the source maps to the template's value at its start.
    """
    rows = voxels.withColumn("v", F.col("v").cast("double"))
    one = template.select(F.lit(0).alias("_pool"), F.col("v").cast("double").alias("v"))
    own = _match_points(rows, ["volume_id"], points, "_x")
    goal = _match_points(one, ["_pool"], points, "_y", True)
    # The template has one row. As equal constants the keys would make a product of both sides, each made anew for every pair of parts.
    nodes = own.crossJoin(F.broadcast(goal.drop("_pool")))
    at = fact_join(rows, nodes, ["volume_id"])
    # The last node at or below the value, but never the final one.
    at = at.withColumn("_i", F.greatest(F.size(F.filter(F.slice("_x", 1, points + 2), lambda x: x <= F.col("v"))), F.lit(1)))
    node = lambda c, step: F.element_at(c, F.col("_i") + step)
    share = F.coalesce(F.try_divide(F.col("v") - node("_x", 0), node("_x", 1) - node("_x", 0)), F.lit(0.0))
    return at.withColumn("v", node("_y", 0) + share * (node("_y", 1) - node("_y", 0))).drop("_x", "_y", "_i")
