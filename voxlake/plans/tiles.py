"""Tile, predict and stitch queries."""

import numpy as np
from pyspark.sql import functions as F

from voxlake.extensions import TRANSFORMS, Parameter, model, predict
from voxlake.operators import chunks as ch
from voxlake.operators import geometry as ge
from voxlake.operators import tiles as ti
from voxlake.operators.joins import CELL, box_join
from voxlake.plans.registry import query
from voxlake.plans.score import cc_sql
from voxlake.plans.voxel import VOX, _TILES, r6

SIZE, STRIDE = (5, 8, 8), (4, 6, 6)
#: Chunks smaller than the volumes; tiles cross them.
CHUNK = (4, 8, 8)


@query(
    "q_tiles_ragged",
    """SELECT volume_id, CAST(a.z AS INT) AS z0, CAST(b.y AS INT) AS y0, CAST(c.x AS INT) AS x0, CAST(least(5, 7 - a.z) AS INT) AS dz, CAST(least(8, 12 - b.y) AS INT) AS dy,
CAST(least(8, 12 - c.x) AS INT) AS dx FROM fx_volumes, range(0, 7, 4) a(z), range(0, 12, 6) b(y), range(0, 12, 6) c(x)""",
)
def q_tiles_ragged(fx):
    return ti.ragged_tiles(fx.volumes, SIZE, STRIDE)


@query(
    "q_tiles_clamped",
    """SELECT volume_id, a.z AS z0, b.y AS y0, c.x AS x0, 5 AS dz, 8 AS dy, 8 AS dx FROM fx_volumes, (VALUES (0), (2)) a(z), (VALUES (0), (4)) b(y), (VALUES (0), (4)) c(x)""",
)
def q_tiles_clamped(fx):
    return ti.clamped_tiles(fx.volumes, SIZE, STRIDE)


@query("q_tiles_slabs", "SELECT volume_id, a.z AS z0, 0 AS y0, 0 AS x0, 4 AS dz, 12 AS dy, 12 AS dx FROM fx_volumes, (VALUES (0), (2), (3)) a(z)")
def q_tiles_slabs(fx):
    return ti.slab_tiles(fx.volumes, 4)


@query(
    "q_tiles_overlap",
    """SELECT volume_id, a.z AS z0, b.y AS y0, c.x AS x0, 4 AS dz, 8 AS dy, 8 AS dx FROM fx_volumes, (VALUES (0), (1), (2), (3)) a(z), (VALUES (0), (3), (4)) b(y), (VALUES (0), (3), (4)) c(x)""",
)
def q_tiles_overlap(fx):
    return ti.overlap_tiles(fx.volumes, (4, 8, 8), 0.625)


@query(
    "q_tiles_nonempty",
    f"""WITH {_TILES} SELECT DISTINCT volume_id, z0, y0, x0 FROM tv WHERE v > 44""",
)
def q_tiles_nonempty(fx):
    tiles = ti.ragged_tiles(fx.volumes, SIZE, STRIDE)
    return ti.tiles_with_foreground(tiles, fx.gt).select("volume_id", "z0", "y0", "x0")


@query(
    "q_slab_boxes",
    """SELECT volume_id, a.z AS z0, 4 AS dz, least(greatest(CAST(trunc(avg(g.y)) AS INT) - 2, 0), 8) AS y0, 4 AS dy, least(greatest(CAST(trunc(avg(g.x)) AS INT) - 2, 0), 8) AS x0, 4 AS dx
FROM fx_gt g, (VALUES (0), (2), (3)) a(z) WHERE g.z >= a.z AND g.z < a.z + 4 GROUP BY volume_id, a.z""",
)
def q_slab_boxes(fx):
    return ti.slab_boxes(fx.gt, fx.volumes, 4)


@query(
    "q_tile_extract",
    f"""WITH {_TILES} SELECT volume_id, z0, y0, x0, z - z0 AS pz, y - y0 AS py, x - x0 AS px, round((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-6), 6) AS v
FROM tv WINDOW w AS (PARTITION BY volume_id, z0, y0, x0)""",
)
def q_tile_extract(fx):
    return r6(ti.tile_voxels(ch.tiles(fx.sparse, fx.volumes, SIZE, ch.ragged_starts(STRIDE), shape=CHUNK), SIZE))


def load_demo():
    """Stands in for a network: half the value, minus one."""

    def run(pdf):
        return pdf.assign(data=[np.asarray(d) * 0.5 - 1.0 for d in pdf["data"]])

    return run


@model("demo")
def demo_model():
    return load_demo


@model("fussy", limit=Parameter(4000.0, 0.0))
def fussy_model(limit):
    """As above, but fails on tiles whose sum is too high."""

    def load():
        def run(pdf):
            if max(float(np.asarray(d).sum()) for d in pdf["data"]) > limit:
                raise ValueError("tile too bright")
            return load_demo()(pdf)

        return run

    return load


_TILE_SCHEMA = "volume_id bigint, z0 int, y0 int, x0 int, at array<int>, data array<double>"


def _predicted(fx):
    tiles = ch.tiles(fx.sparse, fx.volumes, SIZE, ch.ragged_starts(STRIDE), normalise=False, shape=CHUNK, parts=fx.parts)
    out = predict("demo", tiles, _TILE_SCHEMA)
    return ti.unpack_tiles(out, SIZE)


@query("q_predict_demo", f"WITH {_TILES} SELECT volume_id, z, y, x, count(*) AS tiles, round(avg(v * 0.5 - 1.0), 6) AS v FROM tv GROUP BY ALL")
def q_predict_demo(fx):
    rows = _predicted(fx).repartition(fx.parts, "volume_id", "z", "y", "x")
    return rows.groupBy("volume_id", "z", "y", "x").agg(F.count("*").alias("tiles"), F.round(F.avg("v"), 6).alias("v"))


@query(
    "q_batch_status",
    f"""WITH {_TILES} SELECT volume_id, z0, y0, x0, CASE WHEN sum(v) > 4000 THEN 'failed' ELSE 'ok' END AS status,
CASE WHEN sum(v) > 4000 THEN 'tile too bright' END AS error, CAST(count(*) AS INT) AS cells,
round(CASE WHEN sum(v) > 4000 THEN 0 ELSE sum(v * 0.5 - 1.0) END, 4) AS total FROM tv GROUP BY ALL""",
)
def q_batch_status(fx):
    """A failed tile has a zero mask of its size."""
    tiles = ti.tile_arrays(ti.extract_tiles(ti.ragged_tiles(fx.volumes, SIZE, STRIDE), fx.dense, SIZE, normalise=False, parts=fx.parts), SIZE, fx.parts)
    out = predict("fussy", tiles, "data array<double>", ["volume_id", "z0", "y0", "x0"])
    total = F.aggregate("data", F.lit(0.0), lambda a, x: a + x)
    return out.select("volume_id", "z0", "y0", "x0", "status", "error", F.size("data").alias("cells"), F.round(total, 4).alias("total"))


def _tile_logits(fx):
    """Overlapping per-tile logits: the voxel logit shifted by the tile's corner."""
    rows = box_join(ti.clamped_tiles(fx.volumes, SIZE, STRIDE), fx.logits, parts=fx.parts, listed=True)
    shifted = F.col("logit") + (F.col("z0") - F.col("x0")) / 10.0
    local = [(F.col(a) - F.col(f"{a}0")).alias(f"p{a}") for a in ("z", "y", "x")]
    return rows.select("volume_id", "z", "y", "x", *CELL, *local, shifted.alias("v"))


_LOGITS = """l AS (SELECT g.volume_id, g.z, g.y, g.x, g.z - a.z AS pz, g.y - b.y AS py, g.x - c.x AS px, logit + (a.z - c.x) / 10.0::DOUBLE AS v
FROM fx_logits g, (VALUES (0), (2)) a(z), (VALUES (0), (4)) b(y), (VALUES (0), (4)) c(x)
WHERE g.z >= a.z AND g.z < a.z + 5 AND g.y >= b.y AND g.y < b.y + 8 AND g.x >= c.x AND g.x < c.x + 8)"""


@query("q_stitch_mean", f"WITH {_LOGITS} SELECT {VOX}, round(avg(v), 6) AS v FROM l GROUP BY ALL")
def q_stitch_mean(fx):
    return r6(ti.stitch(_tile_logits(fx), by=CELL))


@query("q_stitch_vote", f"WITH {_LOGITS} SELECT {VOX}, 1 AS label FROM l GROUP BY ALL HAVING avg(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END) > 0.5")
def q_stitch_vote(fx):
    votes = _tile_logits(fx).withColumn("v", F.when(F.col("v") > 0, 1.0).otherwise(0.0))
    return ti.vote(votes, by=CELL)


@query(
    "q_stitch_gauss",
    f"""WITH {_LOGITS}, w AS (SELECT *, exp(-(pow((pz - 2) / 0.625::DOUBLE, 2) + pow((py - 3.5) / 1.0::DOUBLE, 2) + pow((px - 3.5) / 1.0::DOUBLE, 2)) / 2) AS w FROM l)
SELECT {VOX}, round(sum(w * v) / sum(w), 6) AS v FROM w GROUP BY ALL""",
)
def q_stitch_gauss(fx):
    return r6(ti.stitch(_tile_logits(fx), ti.gaussian_weight(SIZE), CELL))


@query("q_sigmoid_mask", f"SELECT {VOX}, round(1 / (1 + exp(-logit)), 6) AS p, CAST(logit > 0 AS INT) AS hard, CAST(1 / (1 + exp(-logit)) > 0.5 AS INT) AS label FROM fx_logits")
def q_sigmoid_mask(fx):
    p = ti.sigmoid(F.col("logit"))
    return fx.logits.select(
        "volume_id", "z", "y", "x", F.round(p, 6).alias("p"), (F.col("logit") > 0).cast("int").alias("hard"), (p > 0.5).cast("int").alias("label")
    )


_CH = "c AS (SELECT volume_id, z, y, x, CAST(k.c AS INT) AS c, CASE k.c WHEN 0 THEN v / 100 WHEN 1 THEN d WHEN 2 THEN t * 2 ELSE (d + t) / 2 END AS v FROM fx_voxels, range(4) k(c))"


def _channels(fx):
    values = F.array(F.col("v") / 100, F.col("d"), F.col("t") * 2, (F.col("d") + F.col("t")) / 2)
    return fx.voxels.select("volume_id", "z", "y", "x", F.posexplode(values).alias("c", "v"))


@query("q_argmax", f"WITH {_CH} SELECT {VOX}, c AS label FROM c QUALIFY row_number() OVER (PARTITION BY {VOX} ORDER BY v DESC, c) = 1")
def q_argmax(fx):
    return ti.argmax_channel(_channels(fx))


@query(
    "q_argmax_merged",
    f"WITH {_CH} SELECT {VOX}, CASE WHEN sum(v) FILTER (c IN (2, 3)) > 1 - sum(v) FILTER (c IN (2, 3)) THEN 1 ELSE 0 END AS label FROM c GROUP BY ALL",
)
def q_argmax_merged(fx):
    return ti.argmax_channel(ti.merge_channels(_channels(fx)))


@query(
    "q_view_vote",
    f"""WITH k AS (SELECT volume_id, CASE WHEN volume_id % 3 = 0 THEN 2 ELSE 3 END AS k FROM fx_volumes),
v AS (SELECT {VOX}, CAST(v > 20 AS INT) + CAST(d > 0.03 AS INT) + CASE WHEN volume_id % 3 = 0 THEN 0 ELSE CAST(t > 0.03 AS INT) END AS votes FROM fx_voxels)
SELECT {VOX}, CAST(votes AS BIGINT) AS votes FROM v JOIN k USING (volume_id) WHERE votes * 2 > k""",
)
def q_view_vote(fx):
    return ti.view_vote(*_views(fx))


def _views(fx):
    masks = {"XY": F.col("v") > 20, "XZ": F.col("d") > 0.03, "YZ": (F.col("t") > 0.03) & (F.col("volume_id") % 3 != 0)}
    rows = None
    for view, keep in masks.items():
        part = ge.multiview(fx.voxels.filter(keep).select("volume_id", "z", "y", "x"), [view])
        rows = part if rows is None else rows.unionByName(part)
    names = F.when(F.col("volume_id") % 3 == 0, F.array(F.lit("XY"), F.lit("XZ"))).otherwise(F.array(*[F.lit(v) for v in masks]))
    return rows, fx.volumes.select("volume_id", F.explode(names).alias("view"))


@query(
    "q_view_consensus",
    f"""WITH m AS (SELECT {VOX}, 1 AS label FROM fx_voxels WHERE volume_id % 3 <> 0 AND CAST(v > 40 AS INT) + CAST(d > 0.07 AS INT) + CAST(t > 0.06 AS INT) >= 2),
{cc_sql('m', 1)} SELECT {VOX}, object_id FROM comp""",
)
def q_view_consensus(fx):
    """By name; only volumes that all three views have take part."""
    masks = {"XY": F.col("v") > 40, "XZ": F.col("d") > 0.07, "YZ": F.col("t") > 0.06}
    rows = None
    for view, keep in masks.items():
        part = ge.multiview(fx.voxels.filter(keep).select("volume_id", "z", "y", "x"), [view])
        rows = part if rows is None else rows.unionByName(part)
    return TRANSFORMS.run("view consensus", rows, _views(fx)[1], fx.volumes, connectivity=1).drop("label")


@query(
    "q_param_grid",
    f"""WITH g AS (SELECT s.s AS threshold, m.m AS min_d FROM (VALUES (10.0::DOUBLE), (25.0::DOUBLE), (40.0::DOUBLE)) s(s), (VALUES (0.02::DOUBLE), (0.06::DOUBLE)) m(m))
SELECT volume_id, threshold, min_d, count(*) FILTER (v > threshold AND d > min_d) AS voxels FROM fx_voxels, g GROUP BY ALL""",
)
def q_param_grid(fx):
    """Sweep a two-parameter mask over all volumes: the grid is a constant array on each row, not a join."""
    rows = ti.sweep(fx.voxels.select("volume_id", "v", "d"), {"threshold": [10.0, 25.0, 40.0], "min_d": [0.02, 0.06]})
    keep = (F.col("v") > F.col("threshold")) & (F.col("d") > F.col("min_d"))
    return rows.groupBy("volume_id", "threshold", "min_d").agg(F.count(F.when(keep, 1)).alias("voxels"))
