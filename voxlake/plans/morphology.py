"""Components, boundary, blur, distance, opening and edge queries."""

from pyspark.sql import functions as F

from voxlake.extensions import SEGMENTERS
from voxlake.operators import chunks as ch
from voxlake.operators import components as cc
from voxlake.operators import morphology as mo
from voxlake.plans.histogram import float_hist_sql, int_hist_sql, otsu_sql, triangle_sql
from voxlake.plans.registry import query
from voxlake.plans.score import cc_sql
from voxlake.plans.voxel import VOX, r6
from voxlake.sources.volumes import from_runs

#: Chunks smaller than the volumes, so that every neighbourhood crosses them.
CHUNK = (4, 8, 8)


def _components(kind: int, connectivity: int):
    @query(f"q_components_{kind}", f"WITH {cc_sql('fx_gt', connectivity)} SELECT {VOX}, object_id FROM comp")
    def run(fx):
        # Chunks smaller than the volume, so that objects cross their faces.
        return cc.connected_components(fx.gt, fx.volumes, connectivity, chunk=(4, 5, 7)).drop("label")

    return run


q_components_6 = _components(6, 1)
q_components_18 = _components(18, 2)
q_components_26 = _components(26, 3)


@query("q_components_class", f"WITH {cc_sql('fx_class_gt', 1)} SELECT {VOX}, object_id FROM comp")
def q_components_class(fx):
    """Several labels in one volume: only equal labels connect; small chunks make objects cross chunk faces."""
    return cc.connected_components(fx.class_gt, fx.volumes, 1, chunk=(4, 5, 7)).drop("label")


@query("q_object_runs", f"WITH {cc_sql('fx_class_gt', 2)} SELECT {VOX}, object_id FROM comp")
def q_object_runs(fx):
    """Objects as runs, in bundles smaller than the volumes; the voxels are the runs' cells."""
    runs = cc.object_runs(fx.class_gt, fx.volumes, 2, lines=(3, 5))
    return from_runs(runs).select("volume_id", "z", "y", "x", "object_id")


@query(
    "q_object_ids",
    f"""WITH {cc_sql('fx_gt', 3)}, o AS (SELECT volume_id, object_id, count(*) AS area FROM comp GROUP BY ALL)
SELECT volume_id, object_id, area, row_number() OVER (PARTITION BY volume_id ORDER BY object_id) AS number FROM o""",
)
def q_object_ids(fx):
    objects = cc.object_table(cc.connected_components(fx.gt, fx.volumes, 3))
    return cc.object_numbers(objects, fx.volumes).select("volume_id", "object_id", "area", "number")


@query(
    "q_object_table",
    f"""WITH {cc_sql('fx_gt', 3)} SELECT volume_id, object_id, count(*) AS area, min(z) AS min_z, max(z) AS max_z, min(y) AS min_y, max(y) AS max_y,
min(x) AS min_x, max(x) AS max_x FROM comp GROUP BY volume_id, object_id""",
)
def q_object_table(fx):
    return cc.object_table(cc.connected_components(fx.gt, fx.volumes, 3)).drop("label")


@query(
    "q_remove_small",
    f"""WITH {cc_sql('fx_gt', 1)}, b AS (SELECT volume_id, object_id FROM comp GROUP BY ALL HAVING count(*) > 2)
SELECT {VOX}, 1 AS label FROM comp JOIN b USING (volume_id, object_id)""",
)
def q_remove_small(fx):
    return cc.remove_small(fx.gt, fx.volumes, 2)


@query(
    "q_segment_otsu",
    f"""WITH dt AS (SELECT {VOX}, s.d + s.t AS v FROM fx_voxels s
  UNION ALL SELECT g.volume_id, g.z, g.y, g.x, 0.0::DOUBLE FROM fx_dense g ANTI JOIN fx_voxels s USING (volume_id, z, y, x)),
{float_hist_sql('dt', 'volume_id', 'h')}, {otsu_sql('h', 'volume_id', 'o')}, m AS (SELECT volume_id, z, y, x, 1 AS label FROM dt JOIN o USING (volume_id) WHERE v > threshold),
{cc_sql('m', 1)}, b AS (SELECT volume_id, object_id FROM comp GROUP BY ALL HAVING count(*) > 2) SELECT {VOX}, 1 AS label FROM comp JOIN b USING (volume_id, object_id)""",
)
def q_segment_otsu(fx):
    """The segmenter by name on fractions: its histogram has 256 bins."""
    image = fx.voxels.select("volume_id", "z", "y", "x", (F.col("d") + F.col("t")).alias("v"))
    return SEGMENTERS.run("otsu", image, fx.volumes, remove_small_objects=2)


@query(
    "q_remove_small_label",
    f"""WITH b AS (SELECT volume_id, label FROM fx_class_gt GROUP BY ALL HAVING count(*) > 70) SELECT {VOX}, label FROM fx_class_gt JOIN b USING (volume_id, label)""",
)
def q_remove_small_label(fx):
    return cc.remove_small(fx.class_gt, fx.volumes, 70, by="label")


@query(
    "q_largest",
    f"""WITH {cc_sql('fx_gt', 3)}, b AS (SELECT volume_id, object_id FROM comp GROUP BY volume_id, object_id QUALIFY row_number() OVER (PARTITION BY volume_id ORDER BY count(*) DESC, object_id) = 1)
SELECT {VOX}, object_id FROM comp JOIN b USING (volume_id, object_id)""",
)
def q_largest(fx):
    return cc.largest_component(fx.gt, fx.volumes, 3).drop("label")


def _blur(src: str, out: str, axis: str, n: int, reach: int, sigma: str, extra: str = "") -> str:
    others = [a for a in "zyx" if a != axis]
    on = " AND ".join(f"w.{a} = g.{a}" for a in others)
    return f"""{out}_k AS (SELECT k, exp(-0.5 * pow(k / {sigma}, 2)) AS e FROM range(-{reach}, {reach + 1}) r(k)),
{out} AS (SELECT g.volume_id, g.z, g.y, g.x, sum(w.v * e) / (SELECT sum(e) FROM {out}_k) AS v FROM {src} g, {out}_k k, {src} w
  WHERE w.volume_id = g.volume_id AND {on} AND w.{axis} = least(greatest(g.{axis} + k.k, 0), {n - 1}) GROUP BY ALL)"""


@query(
    "q_gaussian",
    f"""WITH {_blur('fx_dense', 'bx', 'x', 12, 4, '1.0::DOUBLE')}, {_blur('bx', 'b_y', 'y', 12, 4, '1.0::DOUBLE')}, {_blur('b_y', 'bz', 'z', 7, 4, '1.0::DOUBLE')}
SELECT {VOX}, round(v, 6) AS v FROM bz""",
)
def q_gaussian(fx):
    return r6(ch.to_voxels(ch.gaussian(fx.sparse, fx.volumes, 1.0, shape=CHUNK)))


_BG = f"bg AS (SELECT {VOX} FROM fx_dense WHERE v <= 5), fg AS (SELECT {VOX} FROM fx_dense WHERE v > 5)"


@query(
    "q_edt",
    f"""WITH {_BG} SELECT f.volume_id, f.z, f.y, f.x, CAST(min((f.y - b.y) * (f.y - b.y) + (f.x - b.x) * (f.x - b.x)) AS BIGINT) AS d2
FROM fg f JOIN bg b ON f.volume_id = b.volume_id AND f.z = b.z GROUP BY ALL""",
)
def q_edt(fx):
    return mo.distance_to_background(fx.sparse.filter("v > 5"), fx.volumes)


_BALL1 = "(a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 2.25"


@query(
    "q_opening",
    f"""WITH f AS (SELECT {VOX} FROM fx_dense WHERE v <= 46), g AS (SELECT {VOX} FROM fx_dense WHERE v > 46),
e AS (SELECT * FROM f a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE a.volume_id = b.volume_id AND {_BALL1} AND abs(a.z - b.z) < 2))
SELECT DISTINCT a.volume_id, a.z, a.y, a.x FROM fx_dense a JOIN e b ON a.volume_id = b.volume_id AND {_BALL1}""",
)
def q_opening(fx):
    return ch.opening(fx.dense.filter("v <= 46"), fx.volumes, 1, CHUNK)


@query(
    "q_fill_holes",
    f"""WITH w AS (SELECT volume_id, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM fx_voxels WHERE v > 5 GROUP BY volume_id),
em AS (SELECT {VOX}, 1 AS label FROM fx_dense WHERE v <= 5),
ee AS (SELECT a.volume_id, a.z, a.y, a.x, b.z AS bz, b.y AS b_y, b.x AS bx FROM em a JOIN em b ON a.volume_id = b.volume_id AND abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1),
rd AS (SELECT {VOX} FROM em JOIN w USING (volume_id) WHERE z IN (0, 6) OR y IN (0, 11) OR x IN (0, 11)
  UNION SELECT ee.volume_id, bz, b_y, bx FROM rd JOIN ee ON rd.volume_id = ee.volume_id AND rd.z = ee.z AND rd.y = ee.y AND rd.x = ee.x)
SELECT {VOX} FROM fx_dense EXCEPT SELECT {VOX} FROM rd""",
)
def q_fill_holes(fx):
    return mo.fill_holes(fx.sparse.filter("v > 5"), fx.volumes)


_SMOOTH = """bk AS (SELECT k, exp(-0.5 * k * k / 1.0::DOUBLE) AS e FROM range(-4, 5) r(k)),
b1 AS (SELECT g.volume_id, g.z, g.y, g.x, sum(w.v * e) / sum(e) AS v FROM fx_dense g, bk, fx_dense w WHERE w.volume_id = g.volume_id AND w.z = g.z AND w.y = g.y AND w.x = g.x + k GROUP BY ALL),
b2 AS (SELECT g.volume_id, g.z, g.y, g.x, sum(w.v * e) / sum(e) AS v FROM b1 g, bk, b1 w WHERE w.volume_id = g.volume_id AND w.z = g.z AND w.x = g.x AND w.y = g.y + k GROUP BY ALL),
n1 AS (SELECT g.volume_id, g.z, g.y, g.x, any_value(g.v) AS v,
  sum(a.k * (2 - abs(b.k)) * w.v) AS gi, sum(b.k * (2 - abs(a.k)) * w.v) AS gj FROM b2 g, range(-1, 2) a(k), range(-1, 2) b(k), b2 w
  WHERE w.volume_id = g.volume_id AND w.z = g.z AND w.y = least(greatest(g.y + a.k, 0), 11) AND w.x = least(greatest(g.x + b.k, 0), 11) GROUP BY ALL),
gr AS (SELECT volume_id, z, y, x, gi, gj, sqrt(gi * gi + gj * gj) AS m FROM n1)"""


@query("q_sobel", f"WITH {_SMOOTH} SELECT {VOX}, round(gi, 6) AS gi, round(gj, 6) AS gj, round(m, 6) AS m FROM gr")
def q_sobel(fx):
    g = mo.sobel(mo.smooth_inside(fx.dense, fx.volumes, 1.0))
    return g.select("volume_id", "z", "y", "x", *[F.round(c, 6).alias(c) for c in ("gi", "gj", "m")])


_NMS = """nb AS (SELECT g.*, max(w.m) FILTER (a.k = -1 AND b.k = -1) AS p00, max(w.m) FILTER (a.k = -1 AND b.k = 0) AS p01, max(w.m) FILTER (a.k = -1 AND b.k = 1) AS p02,
  max(w.m) FILTER (a.k = 0 AND b.k = -1) AS p10, max(w.m) FILTER (a.k = 0 AND b.k = 1) AS p12, max(w.m) FILTER (a.k = 1 AND b.k = -1) AS p20,
  max(w.m) FILTER (a.k = 1 AND b.k = 0) AS p21, max(w.m) FILTER (a.k = 1 AND b.k = 1) AS p22
  FROM gr g, range(-1, 2) a(k), range(-1, 2) b(k), gr w WHERE w.volume_id = g.volume_id AND w.z = g.z AND w.y = g.y + a.k AND w.x = g.x + b.k
  AND g.y BETWEEN 1 AND 10 AND g.x BETWEEN 1 AND 10 GROUP BY g.volume_id, g.z, g.y, g.x, g.gi, g.gj, g.m),
nm AS (SELECT *, gi * gj >= 0 AS same, abs(gi) AS ai, abs(gj) AS aj FROM nb),
nw AS (SELECT *, CASE WHEN same THEN ai > aj ELSE ai >= aj END AS steep FROM nm),
nt AS (SELECT *, CASE WHEN steep THEN aj / ai WHEN aj > 0 THEN ai / aj ELSE 0 END AS w FROM nw),
th AS (SELECT volume_id, z, y, x, m, 1 AS label FROM nt WHERE m >= 25
  AND (CASE WHEN same THEN p22 ELSE p02 END) * w + (CASE WHEN same AND steep THEN p21 WHEN same THEN p12 WHEN steep THEN p01 ELSE p12 END) * (1 - w) <= m
  AND (CASE WHEN same THEN p00 ELSE p20 END) * w + (CASE WHEN same AND steep THEN p01 WHEN same THEN p10 WHEN steep THEN p21 ELSE p10 END) * (1 - w) <= m)"""


@query(
    "q_canny",
    f"""WITH {_SMOOTH}, {_NMS}, {cc_sql('th', 2, 'volume_id', 'c', True)},
g AS (SELECT DISTINCT c.volume_id, c.object_id FROM c JOIN th USING (volume_id, z, y, x) WHERE m >= 45)
SELECT {VOX} FROM c JOIN g USING (volume_id, object_id)""",
)
def q_canny(fx):
    # A voxel without a place or value is zero, as in the dense volume.
    return mo.canny(fx.sparse.dropna(), fx.volumes, 1.0, 25.0, 45.0, fx.parts)


_ORG_SLICES = f"""{int_hist_sql('fx_dense', 'volume_id, z', 'oh')}, {otsu_sql('oh', 'volume_id, z', 'oo')},
ol AS (SELECT volume_id, max(threshold) AS threshold FROM oo GROUP BY volume_id),
om AS (SELECT {VOX}, 1 AS label FROM fx_voxels JOIN ol USING (volume_id) WHERE v > threshold), {cc_sql('om', 2, 'volume_id', 'oc', True)},
oa AS (SELECT volume_id, z, object_id, count(*) AS area FROM oc GROUP BY ALL),
ok AS (SELECT oc.* FROM oc JOIN oa USING (volume_id, z, object_id) JOIN (SELECT volume_id, z, avg(area) AS mean FROM oa GROUP BY ALL) USING (volume_id, z) WHERE area > mean)"""


@query(
    "q_organoid",
    f"""WITH {_ORG_SLICES},
og AS (SELECT d.volume_id, d.z, d.y, d.x, CASE WHEN k.z IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS v FROM fx_dense d
  LEFT JOIN ok k ON k.volume_id = d.volume_id AND k.z = d.z AND k.y = d.y AND k.x = d.x),
{_blur('og', 'o1', 'x', 12, 4, '1.0::DOUBLE')}, {_blur('o1', 'o2', 'y', 12, 4, '1.0::DOUBLE')},
o3 AS (SELECT volume_id, z, y, x, v FROM o2), {float_hist_sql('o3', 'volume_id, z', 'th')}, {triangle_sql('th', 'volume_id, z', 't', True)}
SELECT {VOX}, 1 AS label FROM o3 JOIN t USING (volume_id, z) WHERE v > threshold""",
)
def q_organoid(fx):
    return mo.organoid_mask(fx.sparse, fx.volumes, None, 1.0, "int", fx.parts)


def _slice_blur(src: str, out: str, axis: str, n: int) -> str:
    """Blur along one axis with the width of each slice (table ow)."""
    others = " AND ".join(f"w.{a} = g.{a}" for a in "zyx" if a != axis)
    return f"""{out} AS (SELECT g.volume_id, g.z, g.y, g.x, sum(w.v * e) / any_value(total) AS v FROM {src} g JOIN ow USING (volume_id, z) JOIN oe USING (sigma), {src} w
  WHERE w.volume_id = g.volume_id AND {others} AND w.{axis} = least(greatest(g.{axis} + oe.k, 0), {n - 1}) GROUP BY g.volume_id, g.z, g.y, g.x)"""


@query(
    "q_organoid_auto",
    f"""WITH {_ORG_SLICES},
od AS (SELECT f.volume_id, f.z, f.y, f.x, min((f.y - b.y) * (f.y - b.y) + (f.x - b.x) * (f.x - b.x)) AS d2 FROM om f
  JOIN (SELECT {VOX} FROM fx_dense EXCEPT SELECT {VOX} FROM om) b ON f.volume_id = b.volume_id AND f.z = b.z GROUP BY ALL),
ow AS (SELECT volume_id, z, sqrt(max(d2)) AS sigma FROM od GROUP BY volume_id, z),
ox AS (SELECT sigma, unnest(range(-CAST(floor(4 * sigma + 0.5) AS BIGINT), CAST(floor(4 * sigma + 0.5) AS BIGINT) + 1)) AS k FROM (SELECT DISTINCT sigma FROM ow)),
oe AS (SELECT sigma, k, exp(-0.5 * pow(k / sigma, 2)) AS e, sum(exp(-0.5 * pow(k / sigma, 2))) OVER (PARTITION BY sigma) AS total FROM ox),
og AS (SELECT d.volume_id, d.z, d.y, d.x, CASE WHEN k.z IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS v FROM fx_dense d
  LEFT JOIN ok k ON k.volume_id = d.volume_id AND k.z = d.z AND k.y = d.y AND k.x = d.x),
{_slice_blur('og', 'o1', 'x', 12)}, {_slice_blur('o1', 'o3', 'y', 12)}, {float_hist_sql('o3', 'volume_id, z', 'th')}, {triangle_sql('th', 'volume_id, z', 't', True)}
SELECT {VOX}, 1 AS label FROM o3 JOIN t USING (volume_id, z) WHERE v > threshold""",
)
def q_organoid_auto(fx):
    """Size limit and blur width both picked per slice."""
    return mo.organoid_mask(fx.sparse, fx.volumes, kind="int", parts=fx.parts)
