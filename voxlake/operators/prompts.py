"""Annotation log: prompts folded into labels, instance filters, clicks, navigation, run history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.operators.joins import VOXEL, fact_join
from voxlake.operators.ranks import sorted_rank
from voxlake.session import cut_lineage

WRITES = ("click", "box", "propagate")
NEVER = 2**62
BUCKET = 4096


def square_masks(prompts: DataFrame, volumes: DataFrame, reach: int = 1) -> DataFrame:
    """(seq, volume_id, z, y, x): a square around each writing prompt, clipped to the slice."""
    rows = fact_join(
        prompts.filter(F.col("op").isin(*WRITES)), volumes.select("volume_id", "ny", "nx"), ["volume_id"]
    )
    step = F.sequence(F.lit(-reach), F.lit(reach))
    rows = rows.withColumn("_dy", F.explode(step)).withColumn("_dx", F.explode(step))
    y, x = F.col("y") + F.col("_dy"), F.col("x") + F.col("_dx")
    inside = (y >= 0) & (x >= 0) & (y < F.col("ny")) & (x < F.col("nx"))
    return rows.filter(inside).select("seq", "volume_id", "z", y.alias("y"), x.alias("x"))


def with_lifespan(prompts: DataFrame) -> DataFrame:
    """Adds ``until``: when what a prompt wrote is cleared (next click of the object on the slice, or a reset).

    The log is written and dealt once, by volume and range of sequence numbers. Rows look ahead inside their range, for all
    three kinds of clearing; beyond it they look at the first clearing of each later range.
    """
    log = cut_lineage(prompts.select("seq", "volume_id", "op", "obj_id", "z"))
    rows = log.withColumn("_b", F.floor(F.col("seq") / BUCKET))
    found = rows.repartition("volume_id", "_b")
    clears = [(["volume_id", "z", "obj_id"], "click"), (["volume_id", "obj_id"], "reset_object"), (["volume_id"], "reset_all")]
    ends = []
    for i, (keys, op) in enumerate(clears):
        near = Window.partitionBy(*keys, "_b").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
        found = found.withColumn(f"_near{i}", F.min(F.when(F.col("op") == op, F.col("seq"))).over(near))
    for i, (keys, op) in enumerate(clears):
        firsts = rows.groupBy(*keys, "_b").agg(F.min(F.when(F.col("op") == op, F.col("seq"))).alias("_first"))
        later = Window.partitionBy(*keys).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
        beyond = firsts.select(*keys, "_b", F.min("_first").over(later).alias(f"_beyond{i}"))
        found = fact_join(found, beyond, [*keys, "_b"])
        ends.append(F.coalesce(f"_near{i}", f"_beyond{i}", F.lit(NEVER)))
    return found.select(*log.columns, F.least(*ends).alias("until"))


def fold_prompts(prompts: DataFrame, masks: DataFrame) -> DataFrame:
    """Labels after all prompts, in sequence order.

    A click clears its object on the slice and writes over anything; a box writes over anything; a propagated
    mask only fills empty voxels; resets clear one object or all. Clearing is worked out per prompt,
    not per voxel. A voxel is decided by its last overwriting prompt while that lasts; only after it was
    cleared are the later propagated prompts of that voxel walked in order.
    """
    spans = with_lifespan(prompts).filter(F.col("op").isin(*WRITES)).select("seq", "op", "obj_id", "until")
    writes = masks.join(spans, "seq")
    cell = ["volume_id", *VOXEL]
    fact = F.struct("seq", "obj_id", "until")
    over = F.col("op") != "propagate"
    last = writes.groupBy(*cell).agg(F.max(F.when(over, fact)).alias("_w"))
    alive = last.filter(F.col("_w.until") == NEVER).select(*cell, F.col("_w.obj_id").alias("label"))
    open_cells = last.filter(F.col("_w").isNull() | (F.col("_w.until") < NEVER))
    free_from = F.coalesce(F.col("_w.until"), F.lit(-1)).alias("_free")
    fills = writes.filter(~over).join(open_cells.select(*cell, free_from), cell).filter(F.col("seq") > F.col("_free"))
    turns = fills.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct("seq", "obj_id", "until"))).alias("_turns"))
    start = F.struct(F.lit(None).cast(prompts.schema["obj_id"].dataType).alias("label"), F.lit(-1).cast("bigint").alias("until"))
    take = lambda now, w: F.when(w["seq"] > now["until"], F.struct(w["obj_id"].alias("label"), w["until"].alias("until"))).otherwise(now)
    filled = turns.select(*cell, F.aggregate("_turns", start, take).alias("_end")).filter(F.col("_end.until") == NEVER)
    return alive.unionByName(filled.select(*cell, F.col("_end.label").alias("label")))


def confident(instances: DataFrame, keys: Sequence[str], threshold: float, fallback: bool = True) -> DataFrame:
    """Instances with prob >= threshold; a group with none keeps its single best (lowest seq on a tie)."""
    keep = instances.filter(F.col("prob") >= threshold)
    if not fallback:
        return keep
    best = instances.groupBy(*keys).agg(F.max(F.struct("prob", (-F.col("seq")).alias("s"))).alias("_b"))
    lone = best.filter(F.col("_b.prob") < threshold).select(*keys, (-F.col("_b.s")).alias("seq"))
    return keep.unionByName(fact_join(instances, lone, [*keys, "seq"], "left_semi"))


def mask_union(masks: DataFrame) -> DataFrame:
    """Voxels covered by any instance, with the number of instances that cover them."""
    return masks.groupBy("volume_id", *VOXEL).agg(F.countDistinct("seq").alias("instances"))


def best_mask(candidates: DataFrame, keys: Sequence[str], index: str, score: str) -> DataFrame:
    """Index of the highest score per group; the lowest index wins a tie."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(index)).alias("i")))
    return candidates.groupBy(*keys).agg(best.alias("_b")).select(*keys, (-F.col("_b.i")).alias(index), F.col("_b.s").alias(score))


def click_objects(clicks: DataFrame, labels: DataFrame) -> DataFrame:
    """Object under each click, else one more than the highest label of the volume."""
    top = labels.groupBy("volume_id").agg(F.max("label").alias("_top"))
    under = labels.select("volume_id", *VOXEL, F.col("label").alias("_l"))
    rows = fact_join(clicks.join(under, ["volume_id", *VOXEL], "left"), top, ["volume_id"], "left")
    found = F.when(F.col("_l") != 0, F.col("_l"))
    return rows.withColumn("object", F.coalesce(found, F.coalesce("_top", F.lit(0)) + 1)).drop("_l", "_top")


def classify_drags(drags: DataFrame, limit: float, width: float, height: float) -> DataFrame:
    """Short drags are points scaled to the image, longer ones are boxes with sorted corners."""
    dist = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    point = dist < limit
    return drags.select(
        "*",
        F.when(point, "point").otherwise("box").alias("kind"),
        F.when(point, F.col("x0") / width).alias("px"),
        F.when(point, F.col("y0") / height).alias("py"),
        *[F.when(~point, F.least(f"{a}0", f"{a}1")).alias(f"low_{a}") for a in "xy"],
        *[F.when(~point, F.greatest(f"{a}0", f"{a}1")).alias(f"high_{a}") for a in "xy"],
    )


def neighbours_in_session(items: DataFrame) -> DataFrame:
    """(session_id, position, path) with the next and previous path; null at the ends."""
    ranked = sorted_rank(items.select("session_id", "position", "path"), ["session_id"], ["position"], "_r")
    other = lambda step, name: ranked.select("session_id", (F.col("_r") + step).alias("_r"), F.col("path").alias(name))
    keys = ["session_id", "_r"]
    return ranked.join(other(-1, "next_path"), keys, "left").join(other(1, "previous_path"), keys, "left").drop("_r")


def run_record(runs: DataFrame, params: Sequence[str]) -> DataFrame:
    """Run log rows: time-stamped name, parameters as a map, path and shape."""
    pairs = [c for p in params for c in (F.lit(p), F.col(p).cast("string"))]
    name = F.concat("algorithm", F.lit("_"), F.date_format("ts", "yyyyMMdd_HHmmss"))
    return runs.select(name.alias("run"), F.create_map(*pairs).alias("params"), "path", "shape")


def append_history(records: DataFrame, folder: str) -> None:
    records.write.mode("append").parquet(folder)
