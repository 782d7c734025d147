"""Scoring queries."""

from pyspark.sql import functions as F

from voxlake.extensions import benchmark
from voxlake.operators import components as cc
from voxlake.operators import score as sc
from voxlake.plans.registry import query
from voxlake.session import cut_lineage

MODELS = ("model_a", "model_b", "model_c")
#: Bundles smaller than the volumes, so that objects cross them.
LINES = (4, 5)

# Pairs reached through neighbouring voxels of one mask; the smallest index reached is the object.
def cc_sql(mask: str, kind: int, keys: str = "volume_id", name: str = "comp", planar: bool = False) -> str:
    same = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    t_e = " AND ".join(f"t.{k.strip()} = e.{k.strip()}" for k in keys.split(","))
    a_keys = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    t_keys = ", ".join(f"t.{k.strip()}" for k in keys.split(","))
    plane = " AND a.z = b.z" if planar else ""
    return f"""
{name}_m AS (SELECT {keys}, z, y, x, label, (z * 12 + y) * 12 + x AS r FROM {mask}),
{name}_e AS (SELECT {a_keys}, a.r AS a, b.r AS b FROM {name}_m a JOIN {name}_m b
  ON {same} AND a.label = b.label AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1{plane}
  AND abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) BETWEEN 1 AND {kind}),
{name}_reach AS (SELECT {keys}, r AS a, r AS b FROM {name}_m UNION
  SELECT {t_keys}, t.a, e.b FROM {name}_reach t JOIN {name}_e e ON {t_e} AND t.b = e.a),
{name} AS (SELECT {keys}, b AS r, CAST(b // 144 AS INT) AS z, CAST(b // 12 % 12 AS INT) AS y, CAST(b % 12 AS INT) AS x,
  CAST(min(a) AS BIGINT) AS object_id FROM {name}_reach GROUP BY ALL)"""


_OVERLAP = """
h AS (SELECT p.model, p.volume_id, count(*) AS n_pred, count(g.label) AS n_both FROM fx_pred p
  LEFT JOIN fx_gt g ON p.volume_id = g.volume_id AND p.z = g.z AND p.y = g.y AND p.x = g.x GROUP BY ALL),
a AS (SELECT volume_id, count(*) AS n_gt FROM fx_gt GROUP BY ALL),
o AS (SELECT s.model, s.volume_id, coalesce(n_gt, 0) AS n_gt, coalesce(n_pred, 0) AS n_pred, coalesce(n_both, 0) AS n_both
  FROM fx_pairs s LEFT JOIN a USING (volume_id) LEFT JOIN h USING (model, volume_id))"""

_DICE = f"""{_OVERLAP},
s AS (SELECT *, CASE WHEN n_gt + n_pred = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * n_both / (n_gt + n_pred) END AS dice FROM o)"""

_OBJECTS = f"""
{cc_sql('fx_gt', 3, 'volume_id', 'gc')},
{cc_sql('fx_pred', 3, 'model, volume_id', 'pc')},
ga AS (SELECT volume_id, object_id AS gt_id, count(*) AS gt_area FROM gc GROUP BY ALL),
pa AS (SELECT model, volume_id, object_id AS pred_id, count(*) AS pred_area FROM pc GROUP BY ALL),
io AS (SELECT p.model, p.volume_id, g.object_id AS gt_id, p.object_id AS pred_id, count(*) AS n_both
  FROM pc p JOIN gc g ON p.volume_id = g.volume_id AND p.r = g.r GROUP BY ALL),
pr AS (SELECT io.*, gt_area, pred_area, n_both / (gt_area + pred_area - n_both)::DOUBLE AS iou
  FROM io JOIN ga USING (volume_id, gt_id) JOIN pa USING (model, volume_id, pred_id))"""

_MATCH = f"""{_OBJECTS},
f1 AS (SELECT * FROM pr WHERE 2 * n_both >= gt_area + pred_area - n_both
  QUALIFY row_number() OVER (PARTITION BY model, volume_id, gt_id ORDER BY iou DESC, pred_id) = 1),
mt AS (SELECT * FROM f1 QUALIFY row_number() OVER (PARTITION BY model, volume_id, pred_id ORDER BY gt_id) = 1)"""

_OBJ_SCORE = f"""{_MATCH},
ng AS (SELECT volume_id, count(DISTINCT gt_id) AS n_gt FROM ga GROUP BY ALL),
np AS (SELECT model, volume_id, count(DISTINCT pred_id) AS n_pred FROM pa GROUP BY ALL),
nm AS (SELECT model, volume_id, count(*) AS tp FROM mt GROUP BY ALL),
os AS (SELECT model, volume_id, coalesce(n_gt, 0) AS n_gt, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp
  FROM fx_pairs LEFT JOIN ng USING (volume_id) LEFT JOIN np USING (model, volume_id) LEFT JOIN nm USING (model, volume_id))"""


def _dice(fx):
    return sc.dice(sc.overlap_counts(fx.gt, fx.pred, fx.pairs))


@query("q_dice", f"WITH {_DICE} SELECT model, volume_id, n_gt, n_pred, n_both, round(dice, 6) AS dice FROM s")
def q_dice(fx):
    return _dice(fx).withColumn("dice", F.round("dice", 6))


@query(
    "q_leaderboard_totals",
    f"""WITH {_DICE} SELECT CASE WHEN volume_id % 3 = 0 THEN 'set_a' ELSE 'set_b' END AS dataset, model, round(avg(dice), 6) AS mean_score, count(*) AS volumes
FROM s GROUP BY ROLLUP (1, 2)""",
)
def q_leaderboard_totals(fx):
    named = _dice(fx).withColumn("dataset", F.when(F.col("volume_id") % 3 == 0, "set_a").otherwise("set_b"))
    return sc.leaderboard_totals(named, "dice").withColumn("mean_score", F.round("mean_score", 6))


@query(
    "q_dice_soft",
    f"""WITH {_OVERLAP}, e AS (SELECT *, (2.0::DOUBLE * n_both + 1e-6::DOUBLE) / (n_gt + n_pred + 1e-6::DOUBLE) AS d FROM o)
SELECT model, round(avg(d), 6) AS dice, round(avg(1 - d), 6) AS loss,
  round(avg(CASE WHEN n_gt = 0 THEN 0.0::DOUBLE ELSE d END), 6) AS dice_empty_zero FROM e GROUP BY model""",
)
def q_dice_soft(fx):
    soft = sc.soft_dice(sc.overlap_counts(fx.gt, fx.pred, fx.pairs))
    return soft.groupBy("model").agg(
        F.round(F.avg("dice"), 6).alias("dice"),
        F.round(F.avg("loss"), 6).alias("loss"),
        F.round(F.avg(F.when(F.col("n_gt") == 0, 0.0).otherwise(F.col("dice"))), 6).alias("dice_empty_zero"),
    )


_CLASS_DICE = """WITH k AS (SELECT volume_id, c AS label FROM fx_volumes, (VALUES (1), (2), (3), (4)) t(c)),
a AS (SELECT volume_id, label, count(*) AS n_gt FROM fx_class_gt GROUP BY ALL),
b AS (SELECT volume_id, label, count(*) AS n_pred FROM fx_class_pred GROUP BY ALL),
i AS (SELECT g.volume_id, g.label, count(*) AS n_both FROM fx_class_gt g JOIN fx_class_pred p USING (volume_id, label, z, y, x) GROUP BY ALL)
SELECT volume_id, label, coalesce(n_gt, 0) AS n_gt, coalesce(n_pred, 0) AS n_pred, coalesce(n_both, 0) AS n_both,
  CASE WHEN coalesce(n_gt, 0) + coalesce(n_pred, 0) > 0
    THEN round(2.0::DOUBLE * coalesce(n_both, 0) / (coalesce(n_gt, 0) + coalesce(n_pred, 0)), 6) END AS dice
FROM k LEFT JOIN a USING (volume_id, label) LEFT JOIN b USING (volume_id, label) LEFT JOIN i USING (volume_id, label)"""


@query("q_dice_class", _CLASS_DICE)
def q_dice_class(fx):
    return _class_dice(fx).withColumn("dice", F.round("dice", 6))


def _class_dice(fx):
    classes = fx.volumes.select("volume_id", F.explode(F.array(*[F.lit(c) for c in (1, 2, 3, 4)])).alias("label"))
    return sc.class_dice(fx.class_gt, fx.class_pred, classes)


@query("q_dice_macro", f"SELECT volume_id, round(avg(dice), 4) AS dice, count(dice) AS classes FROM ({_CLASS_DICE}) GROUP BY volume_id")
def q_dice_macro(fx):
    return sc.macro_dice(_class_dice(fx)).withColumn("dice", F.round("dice", 4))


def _objects(fx):
    """Objects of both sides as runs, written once because areas, overlaps and counts all read them."""
    gt = cut_lineage(cc.object_runs(fx.gt, fx.volumes, 3, lines=LINES))
    pred = cut_lineage(cc.object_runs(fx.pred, fx.volumes, 3, sc.PAIR))
    return gt, pred


@query("q_iou_pairs", f"WITH {_OBJECTS} SELECT model, volume_id, gt_id, pred_id, n_both, gt_area, pred_area, round(iou, 6) AS iou FROM pr")
def q_iou_pairs(fx):
    return sc.run_object_pairs(*_objects(fx)).withColumn("iou", F.round("iou", 6))


@query("q_match", f"WITH {_MATCH} SELECT model, volume_id, gt_id, pred_id, n_both, gt_area, pred_area, round(iou, 6) AS iou FROM mt")
def q_match(fx):
    return sc.match_objects(sc.run_object_pairs(*_objects(fx))).withColumn("iou", F.round("iou", 6))


@query(
    "q_match_low",
    f"""WITH {_OBJECTS}, cd AS (SELECT model, volume_id, gt_id, list(pred_id ORDER BY iou DESC, pred_id) AS able,
  row_number() OVER (PARTITION BY model, volume_id ORDER BY gt_id) AS k FROM pr WHERE iou >= 0.2::DOUBLE GROUP BY model, volume_id, gt_id),
wk AS (SELECT model, volume_id, 0::BIGINT AS k, NULL::BIGINT AS gt_id, NULL::BIGINT AS pred_id, []::BIGINT[] AS used FROM cd WHERE k = 1
  UNION ALL SELECT model, volume_id, k, gt_id, got, CASE WHEN got IS NULL THEN used ELSE list_append(used, got) END
  FROM (SELECT c.model, c.volume_id, c.k, c.gt_id, list_filter(c.able, lambda p: NOT list_contains(w.used, p))[1] AS got, w.used
    FROM wk w JOIN cd c ON c.model = w.model AND c.volume_id = w.volume_id AND c.k = w.k + 1))
SELECT model, volume_id, gt_id, pred_id, n_both, round(iou, 6) AS iou FROM wk JOIN pr USING (model, volume_id, gt_id, pred_id)""",
)
def q_match_low(fx):
    """Below one half a prediction can be wanted by several objects, in chains."""
    found = sc.match_objects(sc.run_object_pairs(*_objects(fx)), 0.2)
    return found.select("model", "volume_id", "gt_id", "pred_id", "n_both", F.round("iou", 6).alias("iou"))


@query(
    "q_metrics",
    f"""WITH {_OBJ_SCORE}, h AS (SELECT p.model, p.volume_id, count(*) AS np, count(g.label) AS nb FROM fx_pred p LEFT JOIN fx_gt g ON p.volume_id = g.volume_id AND p.z = g.z AND p.y = g.y AND p.x = g.x GROUP BY ALL),
a AS (SELECT volume_id, count(*) AS ng FROM fx_gt GROUP BY ALL),
w AS (SELECT s.model, s.volume_id, coalesce(ng, 0) AS ng, coalesce(np, 0) AS np, coalesce(nb, 0) AS nb FROM fx_pairs s LEFT JOIN a USING (volume_id) LEFT JOIN h USING (model, volume_id))
SELECT 'Average Dice' AS metric, model, volume_id, round(CASE WHEN ng + np = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * nb / (ng + np) END, 6) AS value FROM w
UNION ALL SELECT m.m, model, volume_id, round(CASE WHEN n_gt + n_pred = 0 THEN 1.0::DOUBLE WHEN n_gt = 0 OR n_pred = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * tp / (n_gt + n_pred) END, 6)
FROM os, (VALUES ('Mean Object F1'), ('Panoptic F1')) m(m)""",
)
def q_metrics(fx):
    """A benchmark by the metrics' names."""
    rows = benchmark(["Average Dice", "Mean Object F1", "Panoptic F1"], fx.gt, fx.pred, fx.pairs, fx.volumes)
    return rows.select("metric", "model", "volume_id", F.round("value", 6).alias("value"))


def _object_scores(fx):
    gt, pred = _objects(fx)
    return sc.object_scores(gt, pred, sc.match_objects(sc.run_object_pairs(gt, pred)), fx.pairs)


_F1 = "CASE WHEN n_gt + n_pred = 0 THEN 1.0::DOUBLE WHEN n_gt = 0 OR n_pred = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * tp / (n_gt + n_pred) END"


@query(
    "q_object_f1",
    f"""WITH {_OBJ_SCORE} SELECT model, volume_id, n_gt, n_pred, tp, round(CASE WHEN n_pred > 0 THEN tp / n_pred::DOUBLE END, 6) AS precision,
  round(CASE WHEN n_gt > 0 THEN tp / n_gt::DOUBLE END, 6) AS recall, round({_F1}, 6) AS f1 FROM os""",
)
def q_object_f1(fx):
    s = _object_scores(fx)
    return s.select("model", "volume_id", "n_gt", "n_pred", "tp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "q_panoptic_f1",
    f"""WITH {_OBJ_SCORE}, t AS (SELECT *, n_pred - tp AS fp, n_gt - tp AS fn FROM os)
SELECT model, volume_id, tp, fp, fn, round(CASE WHEN tp + fp + fn = 0 THEN 1.0::DOUBLE ELSE tp / (tp + 0.5::DOUBLE * fp + 0.5::DOUBLE * fn) END, 6) AS f1 FROM t""",
)
def q_panoptic_f1(fx):
    return _object_scores(fx).select("model", "volume_id", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


_EDGE = """SELECT DISTINCT {k} FROM {m} a, (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(dz,dy,dx)
  WHERE a.z + dz BETWEEN 0 AND 6 AND a.y + dy BETWEEN 0 AND 11 AND a.x + dx BETWEEN 0 AND 11
  AND NOT EXISTS (SELECT 1 FROM {m} b WHERE {same} AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx)"""
_GT_EDGE = _EDGE.format(k="a.volume_id, a.z, a.y, a.x", m="fx_gt", same="a.volume_id = b.volume_id")
_PRED_EDGE = _EDGE.format(k="a.model, a.volume_id, a.z, a.y, a.x", m="fx_pred", same="a.model = b.model AND a.volume_id = b.volume_id")


@query("q_boundary", _GT_EDGE)
def q_boundary(fx):
    return sc.inner_boundary(fx.gt, fx.volumes, parts=fx.parts)


@query(
    "q_boundary_f1",
    f"""WITH ge AS ({_GT_EDGE}), pe AS ({_PRED_EDGE}),
a AS (SELECT volume_id, count(*) AS n_gt FROM ge GROUP BY ALL), b AS (SELECT model, volume_id, count(*) AS n_pred FROM pe GROUP BY ALL),
i AS (SELECT pe.model, volume_id, count(*) AS n_both FROM pe JOIN ge USING (volume_id, z, y, x) GROUP BY ALL),
o AS (SELECT model, volume_id, coalesce(n_gt, 0) AS n_gt, coalesce(n_pred, 0) AS n_pred, coalesce(n_both, 0) AS n_both FROM fx_pairs
  LEFT JOIN a USING (volume_id) LEFT JOIN b USING (model, volume_id) LEFT JOIN i USING (model, volume_id))
SELECT *, CASE WHEN n_both = 0 THEN 0.0::DOUBLE ELSE round(2.0::DOUBLE * n_both / (n_gt + n_pred), 6) END AS f1 FROM o""",
)
def q_boundary_f1(fx):
    s = sc.boundary_f1(fx.gt, fx.pred, fx.volumes, fx.pairs, fx.parts)
    return s.select("model", "volume_id", "n_gt", "n_pred", "n_both", F.round("f1", 6).alias("f1"))


_COUNTED = f"""{cc_sql('fx_pred', 2, 'model, volume_id', 'pc')},
n AS (SELECT model, volume_id, count(DISTINCT object_id) AS n FROM pc GROUP BY ALL),
p AS (SELECT model, concat('vol_', lpad(CAST(volume_id AS VARCHAR), 6, '0'), CASE WHEN volume_id % 4 = 0 THEN '.tif' ELSE '.tiff' END) AS pfile,
  coalesce(n, 0)::DOUBLE AS pred_count FROM fx_pairs LEFT JOIN n USING (model, volume_id)),
j AS (SELECT model, counts, pred_count FROM fx_counts JOIN p ON regexp_replace(file, '\\.[^.]+$', '') = regexp_replace(pfile, '\\.[^.]+$', ''))"""


@query(
    "q_count_compare",
    f"""WITH {_COUNTED}
SELECT model, count(*) AS n, round(sum(counts * pred_count) / sum(counts * counts), 6) AS slope, round(corr(counts, pred_count), 6) AS r
FROM j GROUP BY model""",
)
def q_count_compare(fx):
    return _fits(fx).select("model", "n", F.round("slope", 6).alias("slope"), F.round("r", 6).alias("r"))


def _fits(fx):
    counted = sc.object_counts(fx.pred, fx.volumes, fx.pairs)
    ext = F.when(F.col("volume_id") % 4 == 0, ".tif").otherwise(".tiff")
    named = counted.select("model", F.concat(F.lit("vol_"), F.lpad(F.col("volume_id").cast("string"), 6, "0"), ext).alias("file"), "pred_count")
    return sc.count_fit(sc.match_counts(fx.counts, named, MODELS))


@query(
    "q_leaderboard",
    f"""WITH {_DICE}, m AS (SELECT model, avg(dice) AS mean_score, count(*) AS volumes FROM s GROUP BY model), {_COUNTED},
f AS (SELECT model, sum(counts * pred_count) / sum(counts * counts) AS slope, corr(counts, pred_count) AS r FROM j GROUP BY model)
SELECT model, round(mean_score, 6) AS mean_score, volumes, round(slope, 6) AS slope, round(r, 6) AS r,
  CAST(rank() OVER (ORDER BY mean_score DESC, model) AS INT) AS rank FROM m LEFT JOIN f USING (model)""",
)
def q_leaderboard(fx):
    ranked = sc.leaderboard(_dice(fx), "dice", _fits(fx))
    return ranked.select("model", "volumes", "rank", *[F.round(c, 6).alias(c) for c in ("mean_score", "slope", "r")])


@query(
    "q_boxplot",
    f"""WITH {_DICE}, q AS (SELECT model, quantile_cont(dice, 0.25) AS q1, quantile_cont(dice, 0.5) AS median, quantile_cont(dice, 0.75) AS q3
  FROM s GROUP BY model)
SELECT model, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(avg(dice), 6) AS mean,
  round(min(dice) FILTER (dice >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low, round(max(dice) FILTER (dice <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  count(*) FILTER (dice < q1 - 1.5 * (q3 - q1) OR dice > q3 + 1.5 * (q3 - q1)) AS outliers
FROM s JOIN q USING (model) GROUP BY model, q1, median, q3""",
)
def q_boxplot(fx):
    b = sc.box_summary(_dice(fx), "dice")
    cols = ("q1", "median", "q3", "mean", "whisker_low", "whisker_high")
    return b.select("model", *[F.round(c, 6).alias(c) for c in cols], "outliers")


@query(
    "q_pair_positional",
    """WITH g AS (SELECT volume_id AS gt_volume, row_number() OVER (ORDER BY volume_id) AS position FROM fx_volumes),
p AS (SELECT model, volume_id AS pred_volume, row_number() OVER (PARTITION BY model ORDER BY volume_id) AS position
  FROM (SELECT DISTINCT model, volume_id FROM fx_pred))
SELECT model, position, gt_volume, pred_volume FROM p JOIN g USING (position)""",
)
def q_pair_positional(fx):
    return sc.pair_by_position(fx.volumes, fx.pred.select("model", "volume_id").distinct())


@query(
    "q_pair_name",
    """WITH p AS (SELECT DISTINCT model, volume_id FROM fx_pred),
w AS (SELECT model, volume_id FROM fx_volumes, (SELECT DISTINCT model FROM p))
SELECT model, volume_id, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.model = w.model AND p.volume_id = w.volume_id)
  THEN 'paired' ELSE 'no_prediction' END AS status FROM w""",
)
def q_pair_name(fx):
    return sc.pair_by_name(fx.volumes, fx.pred.select("model", "volume_id").distinct(), MODELS)
