"""Histogram, threshold and reduction queries."""

from pyspark.sql import functions as F

from voxlake.operators import chunks as ch
from voxlake.operators import components as cc
from voxlake.operators import histogram as hi
from voxlake.operators import morphology as mo
from voxlake.plans.registry import query
from voxlake.plans.score import cc_sql
from voxlake.plans.voxel import VOX, r6

#: Chunks smaller than the volumes, so that every neighbourhood crosses them.
CHUNK = (4, 8, 8)


def int_hist_sql(src: str, keys: str, name: str) -> str:
    """One bin per value."""
    return f"""{name}_f AS (SELECT {keys}, min(v) AS lo, max(v) AS hi FROM {src} GROUP BY {keys}),
{name} AS (SELECT {keys}, CAST(v - lo AS INT) AS bin, v AS center, count(*) AS n, CAST(hi - lo + 1 AS INT) AS bins, lo, hi FROM {src} JOIN {name}_f USING ({keys}) GROUP BY ALL)"""


def float_hist_sql(src: str, keys: str, name: str) -> str:
    return f"""{name}_f AS (SELECT {keys}, min(v) AS lo, max(v) AS hi FROM {src} GROUP BY {keys}),
{name}_b AS (SELECT {keys}, lo, hi, CASE WHEN hi > lo THEN CAST(least(floor((v - lo) / (hi - lo) * 256), 255) AS INT) ELSE 0 END AS bin FROM {src} JOIN {name}_f USING ({keys})),
{name} AS (SELECT {keys}, bin, CASE WHEN hi > lo THEN lo + (bin + 0.5::DOUBLE) * (hi - lo) / 256 ELSE lo END AS center, count(*) AS n,
  CASE WHEN hi > lo THEN 256 ELSE 1 END AS bins, lo, hi FROM {name}_b GROUP BY ALL)"""


def otsu_sql(hist: str, keys: str, name: str) -> str:
    return f"""{name}_w AS (SELECT {keys}, bin, center, sum(n) OVER u AS w1, sum(n * center) OVER u AS s1, sum(n) OVER (PARTITION BY {keys}) AS w, sum(n * center) OVER (PARTITION BY {keys}) AS s
  FROM {hist} WINDOW u AS (PARTITION BY {keys} ORDER BY bin)),
{name} AS (SELECT {keys}, center AS threshold FROM {name}_w QUALIFY row_number() OVER (PARTITION BY {keys}
  ORDER BY CASE WHEN w > w1 THEN w1 * (w - w1) * pow(s1 / w1 - (s - s1) / (w - w1), 2) ELSE -1 END DESC, bin) = 1)"""


def triangle_sql(hist: str, keys: str, name: str, floating: bool) -> str:
    center = "CASE WHEN hi > lo THEN lo + (coalesce(bin, 0) + 0.5::DOUBLE) * (hi - lo) / 256 ELSE lo END" if floating else "lo + coalesce(bin, 0)"
    on = " AND ".join(f"f.{k.strip()} = h.{k.strip()}" for k in keys.split(","))
    fk = ", ".join(f"f.{k.strip()}" for k in keys.split(","))
    return f"""{name}_p AS (SELECT {keys}, bins, lo, hi, min(bin) AS first, max(bin) AS last, max(n) AS high, arg_max(bin, n * 1000 - bin) AS peak FROM {hist} GROUP BY ALL),
{name}_f AS (SELECT *, peak - first < last - peak AS flip FROM {name}_p),
{name}_j AS (SELECT f.*, unnest(range(CASE WHEN flip THEN bins - 1 - last ELSE first END, CASE WHEN flip THEN bins - 1 - peak ELSE peak END)) AS j FROM {name}_f f),
{name}_d AS (SELECT {fk}, f.j, CASE WHEN flip THEN bins - 1 - j ELSE j END AS bin,
  high * (j - CASE WHEN flip THEN bins - 1 - last ELSE first END) - abs(CASE WHEN flip THEN last - peak ELSE peak - first END) * coalesce(n, 0) AS d
  FROM {name}_j f LEFT JOIN (SELECT {keys}, bin, n FROM {hist}) h ON {on} AND h.bin = CASE WHEN flip THEN bins - 1 - j ELSE j END),
{name}_b AS (SELECT {keys}, bin FROM {name}_d QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY d DESC, j) = 1),
{name} AS (SELECT {keys}, {center} AS threshold FROM {name}_p LEFT JOIN {name}_b USING ({keys}))"""


_DT = f"dt AS (SELECT {VOX}, d + t AS v FROM fx_voxels)"


def _dt(fx):
    return fx.voxels.select("volume_id", "z", "y", "x", (F.col("d") + F.col("t")).alias("v"))


@query("q_histogram", f"WITH {int_hist_sql('fx_dense', 'volume_id', 'h')} SELECT volume_id, bin, center, CAST(n AS BIGINT) AS n FROM h")
def q_histogram(fx):
    return hi.histogram(fx.sparse, "int", volumes=fx.volumes).select("volume_id", "bin", "center", "n")


@query("q_histogram_float", f"WITH {_DT}, {float_hist_sql('dt', 'volume_id', 'h')} SELECT volume_id, bin, round(center, 6) AS center, CAST(n AS BIGINT) AS n FROM h")
def q_histogram_float(fx):
    return hi.histogram(_dt(fx), "float").select("volume_id", "bin", F.round("center", 6).alias("center"), "n")


_OTSU_V = f"{int_hist_sql('fx_dense', 'volume_id', 'h')}, {otsu_sql('h', 'volume_id', 'o')}"


_WIDE = f"wd AS (SELECT {VOX}, CAST(v * 40000003 + z * 1000 + y * 37 + x AS BIGINT) AS v FROM fx_dense WHERE v > 0), wh AS (SELECT volume_id, CAST(v - min(v) OVER (PARTITION BY volume_id) AS BIGINT) AS bin, v AS center, count(*) AS n FROM wd GROUP BY volume_id, v), {otsu_sql('wh', 'volume_id', 'o')}"


@query("q_otsu_wide", f"WITH {_WIDE} SELECT volume_id, CAST(threshold AS DOUBLE) AS threshold FROM o")
def q_otsu_wide(fx):
    """Values of 32 bits, nearly all different."""
    wide = F.col("v") * 40000003 + F.col("z") * 1000 + F.col("y") * 37 + F.col("x")
    return hi.otsu_values(fx.sparse.select("volume_id", "z", "y", "x", wide.cast("bigint").alias("v")))


@query("q_otsu_volume", f"WITH {_OTSU_V} SELECT volume_id, threshold FROM o")
def q_otsu_volume(fx):
    return hi.otsu(hi.histogram(fx.sparse, "int", volumes=fx.volumes))


@query("q_otsu_float", f"WITH {_DT}, {float_hist_sql('dt', 'volume_id', 'h')}, {otsu_sql('h', 'volume_id', 'o')} SELECT volume_id, round(threshold, 6) AS threshold FROM o")
def q_otsu_float(fx):
    return r6(hi.otsu(hi.histogram(_dt(fx), "float")), "threshold")


@query("q_otsu_slice", f"WITH {int_hist_sql('fx_dense', 'volume_id, z', 'h')}, {otsu_sql('h', 'volume_id, z', 'o')} SELECT volume_id, z, threshold FROM o")
def q_otsu_slice(fx):
    keys = ["volume_id", "z"]
    return hi.otsu(hi.histogram(fx.sparse, "int", keys, fx.volumes), keys)


def _otsu_mask(fx):
    return hi.above(fx.sparse, hi.otsu(hi.histogram(fx.sparse, "int", volumes=fx.volumes)))


@query("q_otsu_mask", f"WITH {_OTSU_V} SELECT {VOX}, 1 AS label FROM fx_voxels JOIN o USING (volume_id) WHERE v > threshold")
def q_otsu_mask(fx):
    return _otsu_mask(fx)


@query(
    "q_otsu_segment",
    f"""WITH {_OTSU_V}, om AS (SELECT {VOX}, 1 AS label FROM fx_voxels JOIN o USING (volume_id) WHERE v > threshold), {cc_sql('om', 1, 'volume_id', 'c')},
b AS (SELECT volume_id, object_id FROM c GROUP BY ALL HAVING count(*) > 4) SELECT {VOX}, 1 AS label FROM c JOIN b USING (volume_id, object_id)""",
)
def q_otsu_segment(fx):
    """Otsu, then drop face-connected objects of at most four voxels."""
    cut = hi.otsu(hi.histogram(fx.sparse, "int", volumes=fx.volumes))
    return cc.remove_small(hi.above(fx.sparse, cut), fx.volumes, 4)


@query("q_triangle", f"WITH {int_hist_sql('fx_dense', 'volume_id', 'h')}, {triangle_sql('h', 'volume_id', 't', False)} SELECT volume_id, threshold FROM t")
def q_triangle(fx):
    return hi.triangle(hi.histogram(fx.sparse, "int", volumes=fx.volumes))


@query("q_triangle_float", f"WITH {_DT}, {float_hist_sql('dt', 'volume_id', 'h')}, {triangle_sql('h', 'volume_id', 't', True)} SELECT volume_id, round(threshold, 6) AS threshold FROM t")
def q_triangle_float(fx):
    return r6(hi.triangle(hi.histogram(_dt(fx), "float")), "threshold")


@query(
    "q_percentile_mask",
    f"WITH p AS (SELECT volume_id, z, quantile_cont(v, 0.9) AS t FROM fx_dense GROUP BY ALL) SELECT {VOX}, 1 AS label FROM fx_dense JOIN p USING (volume_id, z) WHERE v > t",
)
def q_percentile_mask(fx):
    return hi.percentile_mask(fx.dense, 90.0, ["volume_id", "z"])


@query("q_value_percentiles", "SELECT volume_id, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.9) AS p90 FROM fx_voxels GROUP BY volume_id")
def q_value_percentiles(fx):
    from voxlake.operators.ranks import value_percentiles

    p = value_percentiles(fx.sparse, ["volume_id"], "v", [0.25, 0.9])
    return p.select("volume_id", F.col("pct")[0].alias("q1"), F.col("pct")[1].alias("p90"))


def _mir(e: str, n: int) -> str:
    return f"CASE WHEN {e} < 0 THEN -({e}) WHEN {e} > {n - 1} THEN {2 * (n - 1)} - ({e}) ELSE {e} END"


_SAUVOLA = f"""m AS (SELECT g.{VOX.replace(', ', ', g.')}, any_value(g.v) AS v, avg(w.v) AS m, avg(w.v * w.v) AS q FROM fx_dense g, range(-3, 4) a(k), range(-3, 4) b(k), fx_dense w
  WHERE w.volume_id = g.volume_id AND w.z = g.z AND w.y = {_mir('g.y + a.k', 12)} AND w.x = {_mir('g.x + b.k', 12)} GROUP BY ALL),
s AS (SELECT *, m * (1 + 0.2::DOUBLE * (sqrt(greatest(q - m * m, 0)) / 127.5 - 1)) AS threshold FROM m)"""


@query("q_sauvola", f"WITH {_SAUVOLA} SELECT {VOX}, round(threshold, 6) AS threshold, CAST(v > threshold AS INT) AS label FROM s")
def q_sauvola(fx):
    rows = ch.to_voxels(ch.sauvola(fx.sparse, fx.volumes, 7, shape=CHUNK), ("data", "threshold"), ("v", "threshold"))
    return rows.select("volume_id", "z", "y", "x", F.round("threshold", 6).alias("threshold"), (F.col("v") > F.col("threshold")).cast("int").alias("label"))


_AREAS = f"""sm AS (SELECT {VOX}, 1 AS label FROM fx_voxels WHERE v > 38), {cc_sql('sm', 2, 'volume_id', 'c', True)},
a AS (SELECT volume_id, z, object_id, count(*) AS area FROM c GROUP BY ALL)"""


@query("q_object_areas", f"WITH {_AREAS} SELECT volume_id, z, object_id, area FROM a")
def q_object_areas(fx):
    return mo.object_areas(mo.slice_objects(fx.sparse.filter("v > 38").drop("v"), fx.volumes))


@query("q_mean_areas", f"WITH {_AREAS} SELECT volume_id, z, count(*) AS objects, round(avg(area), 6) AS mean_area FROM a GROUP BY ALL")
def q_mean_areas(fx):
    areas = mo.object_areas(mo.slice_objects(fx.sparse.filter("v > 38").drop("v"), fx.volumes))
    return r6(mo.mean_areas(areas), "mean_area")


@query(
    "q_fg_stats",
    """SELECT volume_id, count(label) AS voxels, round(count(label) / 1008.0::DOUBLE, 6) AS fraction, count(DISTINCT label) AS labels,
CAST(trunc(avg(z)) AS INT) AS cz, CAST(trunc(avg(y)) AS INT) AS cy, CAST(trunc(avg(x)) AS INT) AS cx
FROM fx_volumes LEFT JOIN (SELECT * FROM fx_class_gt) g USING (volume_id) GROUP BY volume_id""",
)
def q_fg_stats(fx):
    return r6(hi.foreground_stats(fx.class_gt, fx.volumes), "fraction")


@query(
    "q_label_set",
    """SELECT volume_id, label, count(*) AS voxels, CAST(sum(z) AS BIGINT) AS sum_z, CAST(sum(y) AS BIGINT) AS sum_y, CAST(sum(x) AS BIGINT) AS sum_x
FROM fx_class_gt GROUP BY volume_id, label""",
)
def q_label_set(fx):
    return hi.label_set(fx.class_gt)


@query(
    "q_pyramid",
    f"""SELECT volume_id, CAST(z // 2 AS INT) AS z, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, round(avg(v), 6) AS v FROM fx_dense WHERE z < 6 GROUP BY ALL
HAVING max(v) > 0""",
)
def q_pyramid(fx):
    return r6(hi.pool(fx.sparse, fx.volumes, 2))


def _l1(f: int, z: int) -> str:
    return f"SELECT volume_id, avg(abs(d)) AS l FROM (SELECT volume_id, avg(v) AS d FROM e WHERE z < {z} GROUP BY volume_id, z // {f}, y // {f}, x // {f}) GROUP BY volume_id"


@query(
    "q_multiscale_l1",
    f"""WITH e AS (SELECT d.volume_id, d.z, d.y, d.x, d.v - coalesce(w.v, 0) AS v FROM fx_dense d LEFT JOIN (SELECT {VOX}, d * 400 AS v FROM fx_voxels) w USING (volume_id, z, y, x)),
l1 AS ({_l1(1, 7)}), l2 AS ({_l1(2, 6)}), l4 AS ({_l1(4, 4)})
SELECT volume_id, round(l1.l + 0.5 * l2.l + 0.25 * l4.l, 6) AS loss FROM l1 JOIN l2 USING (volume_id) JOIN l4 USING (volume_id)""",
)
def q_multiscale_l1(fx):
    other = fx.voxels.select("volume_id", "z", "y", "x", (F.col("d") * 400).alias("v"))
    return r6(hi.multiscale_l1(fx.sparse, other, fx.volumes, fx.parts), "loss")


@query(
    "q_running_avg",
    """SELECT event_id, event_type, sum(CAST(round(value * 100) AS BIGINT) * (1 + user_id % 3)) OVER w / CAST(sum(1 + user_id % 3) OVER w AS DOUBLE) AS average FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)
def q_running_avg(fx):
    log = fx.table("events").select("event_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("value"), (1 + F.col("user_id") % 3).alias("weight"))
    out = hi.running_average(log, ["event_type"], "event_id", F.floor(F.col("event_id") / 1000), "value", "weight")
    return out.select("event_id", "event_type", "average")


_MATCH = f"""{_DT}, xm AS (SELECT volume_id, min(v) AS a, avg(v) AS m, max(v) AS b FROM fx_voxels GROUP BY volume_id),
xq AS (SELECT s.volume_id, list_concat([any_value(a), any_value(m)], quantile_cont(s.v, [0.25, 0.5, 0.75]), [any_value(b)]) AS xa FROM fx_voxels s JOIN xm USING (volume_id) WHERE s.v > m GROUP BY s.volume_id),
ym AS (SELECT min(v) AS a, avg(v) AS m, max(v) AS b FROM dt), yq AS (SELECT list_concat([any_value(a), any_value(m)], quantile_cont(v, [0.25, 0.5, 0.75]), [any_value(b)]) AS ya FROM dt, ym WHERE v > m),
mi AS (SELECT {VOX}, v, xa, ya, greatest(len(list_filter(xa[1:5], lambda e: e <= v)), 1) AS i FROM fx_voxels JOIN xq USING (volume_id), yq)"""


@query(
    "q_match_histogram",
    f"WITH {_MATCH} SELECT {VOX}, round(ya[i] + CASE WHEN xa[i + 1] > xa[i] THEN (v - xa[i]) / (xa[i + 1] - xa[i]) ELSE 0 END * (ya[i + 1] - ya[i]), 6) AS v FROM mi",
)
def q_match_histogram(fx):
    """All fractions of the table are the template."""
    return r6(hi.match_histogram(fx.sparse, _dt(fx), 3))
