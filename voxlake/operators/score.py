"""Mask against mask: overlap counts, object matching, boundary and count scores, leaderboard."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.operators.components import SPAN, contract, object_runs, spans
from voxlake.operators.joins import VOXEL, offset_array, offsets, fact_join
from voxlake.operators.ranks import exact_percentiles, sorted_rank
from voxlake.session import cut_lineage

PAIR = ("model", "volume_id")


def pair_by_position(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """i-th ground truth with i-th prediction of each model, cut to the shorter list."""
    g = sorted_rank(gt.select(F.col("volume_id").alias("gt_volume")), [], ["gt_volume"], "position")
    p = sorted_rank(pred.select("model", F.col("volume_id").alias("pred_volume")), ["model"], ["pred_volume"], "position")
    return p.join(g, "position").select("model", "position", "gt_volume", "pred_volume")


def model_pairs(gt: DataFrame, models: Sequence[str], key: str = "volume_id") -> DataFrame:
    """Each ground-truth row under each compared model, without a join."""
    return gt.select(F.explode(F.array(*[F.lit(m) for m in models])).alias("model"), key)


def pair_by_name(gt: DataFrame, pred: DataFrame, models: Sequence[str]) -> DataFrame:
    """Pairs with equal names, with a status for the ones found on one side only."""
    want = model_pairs(gt, models).withColumn("in_gt", F.lit(True))
    got = pred.select(*PAIR).withColumn("in_pred", F.lit(True))
    status = (
        F.when(F.col("in_gt") & F.col("in_pred"), "paired").when(F.col("in_gt"), "no_prediction").otherwise("no_ground_truth")
    )
    return want.join(got, list(PAIR), "full_outer").select(*PAIR, status.alias("status"))


def overlap_counts(gt: DataFrame, pred: DataFrame, pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n_gt, n_pred, n_both per pair; pairs with nothing on either side stay, with zeros.

    One pass over the predictions of all models against one copy of the ground truth.
    """
    truth = gt.select("volume_id", *by, *VOXEL).withColumn("_hit", F.lit(1))
    hits = (
        pred.select(*PAIR, *by, *VOXEL)
        .join(truth, ["volume_id", *by, *VOXEL], "left")
        .groupBy(*PAIR, *by)
        .agg(F.count("*").alias("n_pred"), F.count("_hit").alias("n_both"))
    )
    area = gt.groupBy("volume_id", *by).agg(F.count("*").alias("n_gt"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        pairs.join(area, ["volume_id", *by], "left")
        .join(hits, [*PAIR, *by], "left")
        .select(*PAIR, *by, zero("n_gt"), zero("n_pred"), zero("n_both"))
    )


def dice(counts: DataFrame) -> DataFrame:
    total = F.col("n_gt") + F.col("n_pred")
    value = F.when(total == 0, 1.0).otherwise(2.0 * F.col("n_both") / total)
    return counts.withColumn("dice", value)


def soft_dice(counts: DataFrame, eps: float = 1e-6) -> DataFrame:
    value = (2.0 * F.col("n_both") + eps) / (F.col("n_gt") + F.col("n_pred") + eps)
    return counts.withColumn("dice", value).withColumn("loss", 1.0 - value)


def class_dice(gt: DataFrame, pred: DataFrame, classes: DataFrame) -> DataFrame:
    """Dice per class of one prediction; classes missing on both sides give null and are left out of means."""
    truth = gt.select("volume_id", "label", *VOXEL).withColumn("_hit", F.lit(1))
    hits = (
        pred.select("volume_id", "label", *VOXEL)
        .join(truth, ["volume_id", "label", *VOXEL], "left")
        .groupBy("volume_id", "label")
        .agg(F.count("*").alias("n_pred"), F.count("_hit").alias("n_both"))
    )
    area = gt.groupBy("volume_id", "label").agg(F.count("*").alias("n_gt"))
    joined = classes.join(area, ["volume_id", "label"], "left").join(hits, ["volume_id", "label"], "left")
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_gt", "n_pred", "n_both")}
    total = n["n_gt"] + n["n_pred"]
    value = F.when(total > 0, 2.0 * n["n_both"] / total)
    return joined.select("volume_id", "label", *[c.alias(k) for k, c in n.items()], value.alias("dice"))


def macro_dice(per_class: DataFrame) -> DataFrame:
    """Mean Dice over the classes a volume has on either side."""
    return per_class.groupBy("volume_id").agg(F.avg("dice").alias("dice"), F.count("dice").alias("classes"))


def object_pairs(gt_objects: DataFrame, pred_objects: DataFrame) -> DataFrame:
    """Overlapping object pairs with joint counts, areas and IoU; background never appears."""
    g = gt_objects.select("volume_id", *VOXEL, F.col("object_id").alias("gt_id"))
    p = pred_objects.select(*PAIR, *VOXEL, F.col("object_id").alias("pred_id"))
    both = p.join(g, ["volume_id", *VOXEL]).groupBy(*PAIR, "gt_id", "pred_id").agg(F.count("*").alias("n_both"))
    g_area = g.groupBy("volume_id", "gt_id").agg(F.count("*").alias("gt_area"))
    p_area = p.groupBy(*PAIR, "pred_id").agg(F.count("*").alias("pred_area"))
    union = F.col("gt_area") + F.col("pred_area") - F.col("n_both")
    return (
        both.join(g_area, ["volume_id", "gt_id"])
        .join(p_area, [*PAIR, "pred_id"])
        .select(*PAIR, "gt_id", "pred_id", "n_both", "gt_area", "pred_area", (F.col("n_both") / union).alias("iou"))
    )


def run_object_pairs(gt_runs: DataFrame, pred_runs: DataFrame) -> DataFrame:
    """``object_pairs`` of runs (z, y, x0, x1, object_id): joint counts are the lengths of overlaps, line by line."""
    g = gt_runs.select("volume_id", "z", "y", F.col("x0").alias("g0"), F.col("x1").alias("g1"), F.col("object_id").alias("gt_id"))
    p = pred_runs.select(*PAIR, "z", "y", F.col("x0").alias("p0"), F.col("x1").alias("p1"), F.col("object_id").alias("pred_id"))
    met = spans(p, F.col("p0"), F.col("p1")).join(spans(g, F.col("g0"), F.col("g1")), ["volume_id", "z", "y", "span"])
    first, last = F.greatest("p0", "g0"), F.least("p1", "g1")
    # An overlap counts in the piece of the line where it begins.
    met = met.filter((first <= last) & (F.floor(first / SPAN) == F.col("span")))
    both = met.groupBy(*PAIR, "gt_id", "pred_id").agg(F.sum(last - first + 1).cast("bigint").alias("n_both"))
    g_area = g.groupBy("volume_id", "gt_id").agg(F.sum(F.col("g1") - F.col("g0") + 1).cast("bigint").alias("gt_area"))
    p_area = p.groupBy(*PAIR, "pred_id").agg(F.sum(F.col("p1") - F.col("p0") + 1).cast("bigint").alias("pred_area"))
    joined = both.join(g_area, ["volume_id", "gt_id"]).join(p_area, [*PAIR, "pred_id"])
    union = F.col("gt_area") + F.col("pred_area") - F.col("n_both")
    return joined.select(*PAIR, "gt_id", "pred_id", "n_both", "gt_area", "pred_area", (F.col("n_both") / union).alias("iou"))


def match_objects(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Each ground-truth object in id order takes the best unused prediction with IoU >= threshold.

    At 0.5 and above an object has at most two candidates and ties cannot chain, so two rankings give
    the same pairs. Below that, only objects linked through shared candidates can turn each other down: the linked sets are
    dealt out, and each is walked in order as a sorted stream.
    """
    union = F.col("gt_area") + F.col("pred_area") - F.col("n_both")
    if threshold == 0.5:
        able = pairs.filter(2 * F.col("n_both") >= union)
    else:
        able = pairs.filter(F.col("iou") >= threshold)
    if threshold >= 0.5:
        per_gt = Window.partitionBy(*PAIR, "gt_id").orderBy(F.desc("iou"), "pred_id")
        per_pred = Window.partitionBy(*PAIR, "pred_id").orderBy("gt_id")
        first = able.withColumn("_g", F.row_number().over(per_gt)).filter("_g = 1")
        return first.withColumn("_p", F.row_number().over(per_pred)).filter("_p = 1").drop("_g", "_p")
    able = cut_lineage(able)
    node = F.col("gt_id") * 2
    links = contract(able.select(*PAIR, node.alias("u"), (F.col("pred_id") * 2 + 1).alias("v")), PAIR)
    linked = fact_join(able.withColumn("u", node), links, [*PAIR, "u"], "left").withColumn("_set", F.coalesce("m", "u")).drop("u", "m")
    # A prediction is forgotten once no later object can want it.
    last = able.groupBy(*PAIR, "pred_id").agg(F.max("gt_id").alias("_last"))
    rows = fact_join(linked, last, [*PAIR, "pred_id"])
    ordered = rows.repartition(*PAIR, "_set").sortWithinPartitions(*PAIR, "_set", "gt_id", F.desc("iou"), "pred_id")
    return ordered.mapInPandas(_first_free, rows.schema).drop("_set", "_last")


def _first_free(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows in order of set, object and preference those in which an object gets its best unused prediction."""
    now, served, used = None, None, {}
    for pdf in batches:
        kept = []
        for i, (model, volume, group, gt, pred, last) in enumerate(zip(*(pdf[c].tolist() for c in (*PAIR, "_set", "gt_id", "pred_id", "_last")))):
            if (model, volume, group) != now:
                now, served, used = (model, volume, group), None, {}
            if gt != served and pred not in used:
                kept.append(i)
                served = gt
                used = {p: x for p, x in used.items() if x > gt}
                used[pred] = last
        yield pdf.iloc[kept]


def object_scores(gt_objects: DataFrame, pred_objects: DataFrame, matches: DataFrame, pairs: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of objects (mean object F1 and panoptic F1 are the same number)."""
    n_gt = gt_objects.groupBy("volume_id").agg(F.countDistinct("object_id").alias("n_gt"))
    n_pred = pred_objects.groupBy(*PAIR).agg(F.countDistinct("object_id").alias("n_pred"))
    n_match = matches.groupBy(*PAIR).agg(F.count("*").alias("tp"))
    joined = pairs.join(n_gt, "volume_id", "left").join(n_pred, list(PAIR), "left").join(n_match, list(PAIR), "left")
    filled = joined.select(*PAIR, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_gt", "n_pred", "tp")])
    tp, g, p = F.col("tp"), F.col("n_gt"), F.col("n_pred")
    f1 = F.when(g + p == 0, 1.0).when((g == 0) | (p == 0), 0.0).otherwise(2.0 * tp / (g + p))
    return filled.select(
        *PAIR,
        "n_gt",
        "n_pred",
        "tp",
        (p - tp).alias("fp"),
        (g - tp).alias("fn"),
        F.when(p > 0, tp / p).alias("precision"),
        F.when(g > 0, tp / g).alias("recall"),
        f1.alias("f1"),
    )


def inner_boundary(mask: DataFrame, volumes: DataFrame, keys: Sequence[str] = ("volume_id",), parts: int | None = None) -> DataFrame:
    """Foreground voxels with an in-bounds face neighbour outside the mask; the volume edge alone does not count.

    Neighbours are counted by adding each voxel's six reach points to the mask rows and grouping once:
    a voxel is inner when it is reached as often as it has in-bounds neighbours.
    """
    keys = list(keys)
    reach = offset_array([(0, 0, 0), *offsets(1)], ("dz", "dy", "dx"))
    moved = mask.select(*keys, *VOXEL, F.explode(reach).alias("m")).select(
        *keys,
        *[(F.col(a) + F.col(f"m.d{a}")).alias(a) for a in VOXEL],
        ((F.col("m.dz") == 0) & (F.col("m.dy") == 0) & (F.col("m.dx") == 0)).cast("int").alias("self"),
    )
    moved = moved.repartition(parts, *keys, *VOXEL) if parts else moved
    seen = moved.groupBy(*keys, *VOXEL).agg(F.sum("self").alias("self"), F.count("*").alias("n")).filter("self = 1")
    dims = volumes.select("volume_id", "nz", "ny", "nx")
    inb = F.lit(0)
    for axis in VOXEL:
        inb = inb + (F.col(axis) > 0).cast("int") + (F.col(axis) < F.col(f"n{axis}") - 1).cast("int")
    return fact_join(seen, dims, ["volume_id"]).filter((F.col("n") - 1) < inb).select(*keys, *VOXEL)


def boundary_f1(gt: DataFrame, pred: DataFrame, volumes: DataFrame, pairs: DataFrame, parts: int | None = None) -> DataFrame:
    """F1 of the exact boundary voxels; zero denominators give zero."""
    counts = overlap_counts(inner_boundary(gt, volumes, parts=parts), inner_boundary(pred, volumes, PAIR, parts), pairs)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p = ratio(F.col("n_both"), F.col("n_pred"))
    r = ratio(F.col("n_both"), F.col("n_gt"))
    out = counts.withColumn("precision", p).withColumn("recall", r)
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^.]+$", "")


def object_counts(pred: DataFrame, volumes: DataFrame, pairs: DataFrame, connectivity: int = 2) -> DataFrame:
    """Number of objects per (model, volume); predictions with an empty mask count zero."""
    comp = object_runs(pred, volumes, connectivity, PAIR)
    n = comp.groupBy(*PAIR).agg(F.countDistinct("object_id").alias("n"))
    return pairs.join(n, list(PAIR), "left").select(*PAIR, F.coalesce("n", F.lit(0)).cast("double").alias("pred_count"))


def match_counts(counts: DataFrame, predicted: DataFrame, models: Sequence[str]) -> DataFrame:
    """Ground-truth counts (file, counts) with predictions (model, file, pred_count): equal name first, then equal stem."""
    exact = counts.join(predicted, "file").select("model", "file", "counts", "pred_count")
    wanted = counts.select(F.explode(F.array(*[F.lit(m) for m in models])).alias("model"), "file", "counts")
    open_rows = wanted.join(exact, ["model", "file"], "left_anti")
    by_stem = predicted.groupBy("model", file_stem(F.col("file")).alias("stem")).agg(F.min_by("pred_count", "file").alias("pred_count"))
    rest = open_rows.withColumn("stem", file_stem(F.col("file"))).join(by_stem, ["model", "stem"])
    return exact.unionByName(rest.select("model", "file", "counts", "pred_count"))


def count_fit(matched: DataFrame) -> DataFrame:
    """Slope through the origin and Pearson r of predicted against true counts, per model.

    Null where they don't exist: no slope if all true counts are 0, no r if either kind of count is the same for every file.
    """
    x, y = F.col("counts"), F.col("pred_count")
    return matched.groupBy("model").agg(
        F.count("*").alias("n"),
        F.try_divide(F.sum(x * y), F.sum(x * x)).alias("slope"),
        F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("r"),
    )


def box_summary(scores: DataFrame, value: str, by: Sequence[str] = ("model",)) -> DataFrame:
    """Quartiles, mean and 1.5 IQR whiskers (the furthest scores within reach), as a box plot draws."""
    keys = list(by)
    q = exact_percentiles(scores, keys, value, [0.25, 0.5, 0.75], "q")
    q = q.select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    v = F.col(value)
    joined = fact_join(scores, q, keys)
    return joined.groupBy(*keys, "q1", "median", "q3").agg(
        F.avg(v).alias("mean"),
        F.min(F.when(v >= F.col("q1") - 1.5 * iqr, v)).alias("whisker_low"),
        F.max(F.when(v <= F.col("q3") + 1.5 * iqr, v)).alias("whisker_high"),
        F.sum(F.when((v < F.col("q1") - 1.5 * iqr) | (v > F.col("q3") + 1.5 * iqr), 1).otherwise(0)).alias("outliers"),
    )


def leaderboard_totals(scores: DataFrame, value: str) -> DataFrame:
    """Mean score per (dataset, model) with totals per dataset and over all."""
    return scores.rollup("dataset", "model").agg(F.avg(value).alias("mean_score"), F.count("*").alias("volumes"))


def leaderboard(scores: DataFrame, value: str, fits: DataFrame | None = None) -> DataFrame:
    """Mean score per model, best first; models are few, so one window ranks them.

    ``fits`` (of ``count_fit``) adds slope and r, null for a model without counts.
    """
    mean = scores.groupBy("model").agg(F.avg(value).alias("mean_score"), F.count("*").alias("volumes"))
    if fits is not None:
        mean = mean.join(fits.select("model", "slope", "r"), "model", "left")
    order = Window.orderBy(F.desc("mean_score"), "model")
    return mean.withColumn("rank", F.rank().over(order))
