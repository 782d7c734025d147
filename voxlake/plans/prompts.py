"""Annotation log queries."""

from pyspark.sql import functions as F

from voxlake.operators import prompts as pr
from voxlake.plans.registry import query
from voxlake.plans.voxel import VOX

_FOLD = f"""lp AS (SELECT p.*, least(
  coalesce((SELECT min(c.seq) FROM fx_prompts c WHERE c.volume_id = p.volume_id AND c.z = p.z AND c.obj_id = p.obj_id AND c.op = 'click' AND c.seq > p.seq), 1e9),
  coalesce((SELECT min(c.seq) FROM fx_prompts c WHERE c.volume_id = p.volume_id AND c.obj_id = p.obj_id AND c.op = 'reset_object' AND c.seq > p.seq), 1e9),
  coalesce((SELECT min(c.seq) FROM fx_prompts c WHERE c.volume_id = p.volume_id AND c.op = 'reset_all' AND c.seq > p.seq), 1e9)) AS until FROM fx_prompts p),
wr AS (SELECT p.seq, p.op, p.obj_id, p.until, p.volume_id, p.z, CAST(p.y + a.d AS INT) AS y, CAST(p.x + b.d AS INT) AS x FROM lp p JOIN fx_volumes v USING (volume_id), range(-1, 2) a(d), range(-1, 2) b(d)
  WHERE op IN ('click', 'box', 'propagate') AND p.y + a.d BETWEEN 0 AND 11 AND p.x + b.d BETWEEN 0 AND 11),
wn AS (SELECT *, row_number() OVER (PARTITION BY {VOX} ORDER BY seq) AS rn FROM wr),
st AS (SELECT {VOX}, rn, obj_id AS label, until FROM wn WHERE rn = 1
  UNION ALL SELECT w.volume_id, w.z, w.y, w.x, w.rn, CASE WHEN w.op <> 'propagate' OR w.seq > s.until THEN w.obj_id ELSE s.label END,
    CASE WHEN w.op <> 'propagate' OR w.seq > s.until THEN w.until ELSE s.until END
  FROM st s JOIN wn w ON w.volume_id = s.volume_id AND w.z = s.z AND w.y = s.y AND w.x = s.x AND w.rn = s.rn + 1)"""
FOLD_SQL = f"""WITH {_FOLD}, fi AS (SELECT {VOX}, arg_max(label, rn) AS label, arg_max(until, rn) AS until FROM st GROUP BY {VOX})
SELECT {VOX}, label FROM fi WHERE until = 1e9"""


@query("q_prompt_fold", FOLD_SQL)
def q_prompt_fold(fx):
    return pr.fold_prompts(fx.prompts, pr.square_masks(fx.prompts, fx.volumes))


_KEPT = """kp AS (SELECT seq, volume_id, z, y, x, obj_id, prob FROM fx_prompts WHERE op IN ('click', 'box', 'propagate')),
kf AS (SELECT * FROM kp QUALIFY prob >= 0.8 OR (max(prob) OVER (PARTITION BY volume_id, z) < 0.8 AND row_number() OVER (PARTITION BY volume_id, z ORDER BY prob DESC, seq) = 1))"""


def _kept(fx):
    rows = fx.prompts.filter(F.col("op").isin(*pr.WRITES)).select("seq", "volume_id", "z", "y", "x", "obj_id", "prob", "op")
    return pr.confident(rows, ["volume_id", "z"], 0.8)


@query("q_conf_filter", f"WITH {_KEPT} SELECT seq, volume_id, z, obj_id, round(prob, 6) AS prob FROM kf")
def q_conf_filter(fx):
    return _kept(fx).select("seq", "volume_id", "z", "obj_id", F.round("prob", 6).alias("prob"))


@query(
    "q_mask_union",
    f"""WITH {_KEPT} SELECT volume_id, z, CAST(y + a.d AS INT) AS y, CAST(x + b.d AS INT) AS x, count(DISTINCT seq) AS instances FROM kf JOIN fx_volumes USING (volume_id), range(-1, 2) a(d), range(-1, 2) b(d)
WHERE y + a.d BETWEEN 0 AND 11 AND x + b.d BETWEEN 0 AND 11 GROUP BY volume_id, z, y + a.d, x + b.d""",
)
def q_mask_union(fx):
    return pr.mask_union(pr.square_masks(_kept(fx), fx.volumes))


@query(
    "q_best_mask",
    """SELECT volume_id, z, obj_id, prob FROM (SELECT volume_id, z, obj_id, round(prob, 6) * 100 + (5 - obj_id) AS prob FROM fx_prompts)
QUALIFY row_number() OVER (PARTITION BY volume_id, z ORDER BY prob DESC, obj_id) = 1""",
)
def q_best_mask(fx):
    score = F.round("prob", 6) * 100 + (5 - F.col("obj_id"))
    return pr.best_mask(fx.prompts.withColumn("prob", score), ["volume_id", "z"], "obj_id", "prob")


@query(
    "q_click_object",
    """WITH t AS (SELECT volume_id, max(label) AS top FROM fx_class_gt GROUP BY volume_id)
SELECT p.seq, p.volume_id, coalesce(nullif(g.label, 0), coalesce(top, 0) + 1) AS object FROM fx_prompts p LEFT JOIN fx_class_gt g USING (volume_id, z, y, x) LEFT JOIN t USING (volume_id) WHERE op = 'click'""",
)
def q_click_object(fx):
    clicks = fx.prompts.filter("op = 'click'").select("seq", "volume_id", "z", "y", "x")
    return pr.click_objects(clicks, fx.class_gt).select("seq", "volume_id", "object")


_DRAG = "dr AS (SELECT seq, x AS x0, y AS y0, CAST(seq * 7 % 12 AS INT) AS x1, CAST(seq * 5 % 12 AS INT) AS y1 FROM fx_prompts), dk AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) < 4.5 AS pt FROM dr)"


@query(
    "q_click_kind",
    f"""WITH {_DRAG} SELECT seq, CASE WHEN pt THEN 'point' ELSE 'box' END AS kind, round(CASE WHEN pt THEN x0 / 24.0::DOUBLE END, 6) AS px, round(CASE WHEN pt THEN y0 / 48.0::DOUBLE END, 6) AS py,
CASE WHEN NOT pt THEN least(x0, x1) END AS low_x, CASE WHEN NOT pt THEN least(y0, y1) END AS low_y, CASE WHEN NOT pt THEN greatest(x0, x1) END AS high_x, CASE WHEN NOT pt THEN greatest(y0, y1) END AS high_y FROM dk""",
)
def q_click_kind(fx):
    end = lambda k: (F.col("seq") * k % 12).cast("int")
    drags = fx.prompts.select("seq", F.col("x").alias("x0"), F.col("y").alias("y0"), end(7).alias("x1"), end(5).alias("y1"))
    out = pr.classify_drags(drags, 4.5, 24.0, 48.0).drop("x0", "y0", "x1", "y1")
    return out.withColumn("px", F.round("px", 6)).withColumn("py", F.round("py", 6))


@query(
    "q_nav",
    """SELECT session_id, position, path, lead(path) OVER w AS next_path, lag(path) OVER w AS previous_path FROM fx_session WINDOW w AS (PARTITION BY session_id ORDER BY position)""",
)
def q_nav(fx):
    return pr.neighbours_in_session(fx.session)


@query(
    "q_history",
    """SELECT concat(op, '_', strftime(ts, '%Y%m%d_%H%M%S')) AS run, concat('{"z":"', z, '","obj_id":"', obj_id, '"}') AS params, concat('vol_', volume_id) AS path, '7x12x12' AS shape FROM fx_prompts""",
)
def q_history(fx):
    runs = fx.prompts.select(
        F.col("op").alias("algorithm"), "ts", "z", "obj_id", F.concat(F.lit("vol_"), F.col("volume_id").cast("string")).alias("path"), F.lit("7x12x12").alias("shape")
    )
    return pr.run_record(runs, ["z", "obj_id"]).withColumn("params", F.to_json("params"))
