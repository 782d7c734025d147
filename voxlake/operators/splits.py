"""Train/validation splits, patches and sampling; every random order is an md5 order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions import paths as fp
from voxlake.operators.joins import VOXEL, box_join, fact_join
from voxlake.operators.ranks import hash_order, hash_rank, hash_unit, sorted_rank
from voxlake.session import cut_lineage


def group_split(files: DataFrame, ratio: float = 0.8, seed: int = 42, rounding: str = "floor") -> DataFrame:
    """Files of one base key stay together; floor (or half-even round) of ratio x keys go to train."""
    if not 0.0 < ratio < 1.0:
        raise ValueError("ratio must be strictly between 0 and 1")
    rows = files.withColumn("base", fp.base_key(F.col("path")))
    ranked = hash_rank(rows.select("base").distinct(), [], F.col("base"), seed, "_r", "_n")
    share = F.lit(ratio) * F.col("_n")
    limit = F.floor(share) if rounding == "floor" else F.bround(share, 0)
    side = F.when(F.col("_r") <= limit, "train").otherwise("val")
    return rows.join(ranked.select("base", side.alias("split")), "base")


def read_split(split_list: DataFrame, split: str) -> DataFrame:
    return split_list.filter(F.col("split") == split).select("id", "image", "label")


def _axis_key(seed: int, axis: str, *parts: Column) -> Column:
    return F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(axis), F.lit(str(seed)))


def crop_boxes(volumes: DataFrame, patches: int, size: tuple[int, int, int], seed: int) -> DataFrame:
    """``patches`` boxes per volume, origin even in [0, dim - size], size clipped to the volume."""
    rows = volumes.select("volume_id", "nz", "ny", "nx", F.explode(F.sequence(F.lit(0), F.lit(patches - 1))).alias("patch"))
    cols = []
    for axis, s in zip(VOXEL, size):
        d = F.least(F.lit(s), F.col(f"n{axis}"))
        u = hash_unit(_axis_key(seed, axis, F.col("volume_id"), F.col("patch")))
        cols += [d.alias(f"d{axis}"), F.floor(u * (F.col(f"n{axis}") - d + 1)).cast("int").alias(f"{axis}0")]
    return rows.select("volume_id", "patch", *cols)


def random_crops(voxels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Voxels of each box with their place inside it; use the same boxes for image and mask."""
    inside = box_join(boxes, voxels)
    local = [(F.col(a) - F.col(f"{a}0")).alias(f"p{a}") for a in VOXEL]
    rest = [c for c in voxels.columns if c not in ("volume_id", *VOXEL)]
    return inside.select("volume_id", "patch", *local, *rest)


def foreground_boxes(mask: DataFrame, boxes: DataFrame, min_fraction: float) -> DataFrame:
    """First box (by patch number) with enough foreground, else the last one, per volume."""
    hits = box_join(boxes, mask.select("volume_id", *VOXEL)).groupBy("volume_id", "patch").agg(F.count("*").alias("_n"))
    rows = boxes.join(hits, ["volume_id", "patch"], "left")
    share = F.coalesce("_n", F.lit(0)) / (F.col("dz") * F.col("dy") * F.col("dx"))
    fact = F.struct("patch", share.alias("fraction"), *[f"{a}0" for a in VOXEL])
    best = rows.groupBy("volume_id").agg(
        F.min(F.when(share >= min_fraction, fact)).alias("ok"), F.max(fact).alias("last")
    )
    pick = F.coalesce("ok", "last")
    return best.select(
        "volume_id", (pick["patch"] + 1).alias("tries"), pick["fraction"].alias("fraction"), *[pick[f"{a}0"].alias(f"{a}0") for a in VOXEL]
    )


def _voxel_key() -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in ("volume_id", *VOXEL)])


def foreground_centred(mask: DataFrame, volumes: DataFrame, size: tuple[int, int, int], seed: int) -> DataFrame:
    """A box around one foreground voxel, clipped to the volume; a random box when the mask is empty."""
    point = F.struct(hash_order(_voxel_key(), seed).alias("h"), *VOXEL)
    pick = mask.groupBy("volume_id").agg(F.min(point).alias("p"))
    rows = volumes.select("volume_id", "nz", "ny", "nx").join(pick, "volume_id", "left")
    cols = []
    for axis, s in zip(VOXEL, size):
        n = F.col(f"n{axis}")
        room = F.greatest(n - s, F.lit(0))
        u = hash_unit(_axis_key(seed, axis, F.col("volume_id")))
        centred = F.least(F.greatest(F.col(f"p.{axis}") - s // 2, F.lit(0)), room)
        cols.append(F.coalesce(centred, F.floor(u * (room + 1)).cast("int")).alias(f"{axis}0"))
    return rows.select("volume_id", F.col("p").isNotNull().alias("centred"), *cols)


def class_centres(labels: DataFrame, per_class: int, seed: int) -> DataFrame:
    """``per_class`` centres for each non-background class of a volume.

    The rank filter lets Spark cut each task to its first rows before the shuffle.
    """
    rows = labels.filter("label <> 0").withColumn("_h", hash_order(_voxel_key(), seed))
    w = Window.partitionBy("volume_id", "label").orderBy("_h", *VOXEL)
    return rows.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= per_class).drop("_h")


def rank_stride(items: DataFrame, order: str, replicas: int) -> DataFrame:
    """Pad the sorted items to a multiple of ``replicas`` by repeating the head; item i goes to i mod replicas."""
    ranked = sorted_rank(items, [], [order], "_r", "_n").withColumn("position", F.col("_r") - 1)
    total = F.ceil(F.col("_n") / replicas) * replicas
    copies = F.floor((total - 1 - F.col("position")) / F.col("_n"))
    every = ranked.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), copies)))
    at = F.col("position") + F.col("_k") * F.col("_n")
    return every.select(order, at.alias("position"), F.pmod(at, F.lit(replicas)).cast("int").alias("replica"))


def error_clicks(gt: DataFrame, pred: DataFrame, volumes: DataFrame, seed: int) -> DataFrame:
    """One wrong voxel per volume (label 1 if missed, 0 if extra); else a true voxel; else the centre."""
    g = gt.select("volume_id", *VOXEL, F.lit(True).alias("g"))
    p = pred.select("volume_id", *VOXEL, F.lit(True).alias("p"))
    both = g.join(p, ["volume_id", *VOXEL], "full_outer")
    h = hash_order(_voxel_key(), seed)
    point = F.struct(h.alias("h"), *VOXEL, F.col("g").isNotNull().cast("int").alias("label"))
    wrong = F.col("g").isNull() | F.col("p").isNull()
    picks = both.groupBy("volume_id").agg(
        F.min(F.when(wrong, point)).alias("e"), F.min(F.when(F.col("g"), point)).alias("t")
    )
    rows = volumes.select("volume_id", "nz", "ny", "nx").join(picks, "volume_id", "left")
    centre = F.struct(
        F.lit("").alias("h"), *[F.floor(F.col(f"n{a}") / 2).cast("int").alias(a) for a in VOXEL], F.lit(1).alias("label")
    )
    c = F.coalesce("e", "t", centre)
    kind = F.when(F.col("e").isNotNull(), "error").when(F.col("t").isNotNull(), "truth").otherwise("centre")
    return rows.select("volume_id", *[c[a].alias(a) for a in VOXEL], c["label"].alias("label"), kind.alias("kind"))


def enough_labels(mask: DataFrame, minimum: int) -> DataFrame:
    return mask.groupBy("volume_id").agg(F.count("*").alias("voxels")).filter(F.col("voxels") >= minimum)


def keep_labelled(rows: DataFrame, mask: DataFrame, minimum: int = 1000, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Rows of the volumes whose mask has at least ``minimum`` voxels."""
    return fact_join(rows, enough_labels(mask, minimum).select(*keys), list(keys), "left_semi")


def _random_cuboids(grids: DataFrame, seed: int) -> DataFrame:
    """Boxes 0 .. ``boxes`` - 1 of each grid: sides from 1 to under half the grid's, placed anywhere inside it."""
    rows = grids.withColumn("box", F.explode(F.expr("sequence(0, int(boxes) - 1)")))
    cols = []
    for axis in VOXEL:
        n = F.col(f"n{axis}")
        draw = lambda what: hash_unit(_axis_key(seed, f"{axis}{what}", F.col("volume_id"), F.col("box")))  # noqa: B023, E731
        side = (1 + F.floor(draw("size") * (F.greatest(F.floor(n / 2), F.lit(2)) - 1))).cast("int")
        cols += [side.alias(f"d{axis}"), F.floor(draw("start") * (n - side + 1)).cast("int").alias(f"{axis}0")]
    return rows.select("volume_id", "box", *cols)


def cuboid_masks(grids: DataFrame, ratio: float, seed: int, boxes: int = 32) -> DataFrame:
    """(volume_id, z, y, x): cells of each grid (volume_id, nz, ny, nx) hidden by random boxes, for training on what is left.

    Boxes are laid down in order until they cover the whole part of ``ratio`` x cells; the box that reaches it is laid down
    whole. A cell is hidden by the first box that holds it, so the order's prefixes are counted without laying any down twice.
    Grids whose boxes don't suffice get twice as many.
    """
    if not 0 <= ratio <= 1:
        raise ValueError("the ratio must lie in 0..1")
    size = F.col("nz").cast("bigint") * F.col("ny") * F.col("nx")
    open_grids = grids.select("volume_id", "nz", "ny", "nx", F.floor(size * ratio).alias("wanted"), F.lit(boxes).alias("boxes")).filter("wanted > 0")
    done = None
    while True:
        cells = _random_cuboids(open_grids, seed)
        for axis in VOXEL:
            cells = cells.withColumn(axis, F.explode(F.sequence(F.col(f"{axis}0"), F.col(f"{axis}0") + F.col(f"d{axis}") - 1)))
        first = cut_lineage(cells.groupBy("volume_id", *VOXEL).agg(F.min("box").alias("box")))
        # A row for each box: the cells that it is the first to hide.
        new = first.groupBy("volume_id", "box").agg(F.count("*").alias("new"))
        upto = Window.partitionBy("volume_id").orderBy("box").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hidden = fact_join(new.withColumn("hidden", F.sum("new").over(upto)), open_grids.select("volume_id", "wanted"), ["volume_id"])
        last = cut_lineage(hidden.groupBy("volume_id").agg(F.min(F.when(F.col("hidden") >= F.col("wanted"), F.col("box"))).alias("last")))
        found = fact_join(first, last, ["volume_id"]).filter("box <= last").select("volume_id", *VOXEL)
        done = found if done is None else done.unionByName(found)
        short = last.filter("last is null").select("volume_id")
        if short.isEmpty():
            return done
        open_grids = cut_lineage(fact_join(open_grids, short, ["volume_id"], "left_semi").withColumn("boxes", F.col("boxes") * 2))
