"""Queries about volumes in space: orientation, back-projection, affine augmentation, fused views, superpixels."""

from pyspark.sql import functions as F

from voxlake.extensions import SEGMENTERS, TRANSFORMS
from voxlake.operators import affine as af
from voxlake.operators import chunks as ch
from voxlake.operators import geometry as ge
from voxlake.operators import superpixels as su
from voxlake.plans.registry import query
from voxlake.plans.score import cc_sql
from voxlake.plans.voxel import VOX, _draw

#: Chunks smaller than the volumes, so that every neighbourhood crosses them.
CHUNK = (4, 8, 8)

#: Four scanners' affines, by volume: right-front-up; left-back-up; up-front-right; tilted front-left-down.
_AFFINES = [
    [1.5, 0, 0, -8, 0, 1.5, 0, -9, 0, 0, 3, 10, 0, 0, 0, 1],
    [-1.5, 0, 0, 20, 0, -1.5, 0, 5, 0, 0, 3, 0, 0, 0, 0, 1],
    [0, 0, 3, 0, 0, 1.5, 0, 0, 1.5, 0, 0, 0, 0, 0, 0, 1],
    [0.2, -1.4, 0.1, 7, 1.45, 0.2, 0, -3, 0, 0.1, -2.9, 2, 0, 0, 0, 1],
]


def _frames(fx):
    kinds = [F.array(*[F.lit(float(v)) for v in a]) for a in _AFFINES]
    at = F.pmod("volume_id", F.lit(4))
    return af.frames(fx.volumes, F.when(at == 0, kinds[0]).when(at == 1, kinds[1]).when(at == 2, kinds[2]).otherwise(kinds[3]))


_TURNED = """k AS (SELECT volume_id, z, y, x, v, volume_id % 4 AS k FROM fx_voxels),
c AS (SELECT volume_id, z, y, x, v, CASE k WHEN 2 THEN x WHEN 3 THEN 6 - z ELSE z END AS cz, CASE k WHEN 1 THEN 11 - y WHEN 3 THEN x ELSE y END AS cy,
  CASE k WHEN 1 THEN 11 - x WHEN 2 THEN z WHEN 3 THEN 11 - y ELSE x END AS cx FROM k)"""


@query(
    "q_axis_codes",
    """SELECT volume_id, CASE volume_id % 4 WHEN 0 THEN 'RAS' WHEN 1 THEN 'LPS' WHEN 2 THEN 'SAR' ELSE 'ALI' END AS old_codes,
CAST(CASE WHEN volume_id % 4 = 2 THEN nx ELSE nz END AS INT) AS nz, ny, CAST(CASE WHEN volume_id % 4 = 2 THEN nz ELSE nx END AS INT) AS nx,
round(CASE volume_id % 4 WHEN 0 THEN -8 WHEN 1 THEN 20 - 1.5::DOUBLE * 11 WHEN 2 THEN 0 ELSE 7 - 1.4::DOUBLE * 11 + 0.1::DOUBLE * 6 END, 6) AS right,
round(CASE volume_id % 4 WHEN 0 THEN -9 WHEN 1 THEN 5 - 1.5::DOUBLE * 11 WHEN 2 THEN 0 ELSE -3 + 0.2::DOUBLE * 11 END, 6) AS front,
round(CASE volume_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE 2 + 0.1::DOUBLE * 11 - 2.9::DOUBLE * 6 END, 6) AS up FROM fx_volumes""",
)
def q_axis_codes(fx):
    """The axes' directions, and the frame of the volume turned to right-front-up."""
    origin = [F.round(F.get("affine", F.lit(i)), 6).alias(n) for i, n in ((3, "right"), (7, "front"), (11, "up"))]
    return af.orientations(_frames(fx)).select("volume_id", "old_codes", "nz", "ny", "nx", *origin)


@query("q_reorient", f"WITH {_TURNED} SELECT volume_id, cz AS z, cy AS y, cx AS x, v FROM c")
def q_reorient(fx):
    return TRANSFORMS.run("canonical orientation", fx.sparse, _frames(fx))


@query(
    "q_backproject",
    f"""WITH {_TURNED}, b AS (SELECT volume_id, CAST(floor((min(cz) + max(cz) + 1 - 4) / 2) AS INT) AS z0, CAST(floor((min(cy) + max(cy) + 1 - 7) / 2) AS INT) AS y0,
  CAST(floor((min(cx) + max(cx) + 1 - 8) / 2) AS INT) AS x0 FROM c WHERE v > 47 GROUP BY volume_id)
SELECT {VOX}, CAST(v AS BIGINT) AS label FROM c JOIN b USING (volume_id) WHERE cz >= z0 AND cz < z0 + 4 AND cy >= y0 AND cy < y0 + 7 AND cx >= x0 AND cx < x0 + 8""",
)
def q_backproject(fx):
    """Turned, cropped about the mask, and put back: the first grid, inside the crop. Whole values stand for a prediction's labels."""
    frames = _frames(fx)
    cropped, where = af.canonical_crop(fx.sparse, fx.sparse.filter("v > 47"), frames, (4, 7, 8))
    return af.back_to(cropped.withColumnRenamed("v", "label"), where, frames, CHUNK)


def _affine_sql() -> str:
    """sc: for each target cell the place in the source, from the same draws."""
    turn = {a: _draw(-0.26, 0.26, f"turn {a}", 5) for a in "xyz"}
    size = {a: _draw(0.8, 1.2, f"scale {a}", 5) for a in "xyz"}
    draws = ", ".join([*(f"{f}({turn[a]}) AS {f[0]}{a}" for a in "xyz" for f in ("cos", "sin")), *(f"{size[a]} AS k{a}" for a in "xyz")])
    # The product of the turns about x, y and z, and the factors.
    m = [
        ["cy * cz * kx", "-cy * sz * ky", "sy * kz"],
        ["(cx * sz + sx * sy * cz) * kx", "(cx * cz - sx * sy * sz) * ky", "-sx * cy * kz"],
        ["(sx * sz - cx * sy * cz) * kx", "(sx * cz + cx * sy * sz) * ky", "cx * cy * kz"],
    ]
    place = ", ".join(f"{c} + ({m[i][0]}) * (x - 5.5) + ({m[i][1]}) * (y - 5.5) + ({m[i][2]}) * (z - 3.0) AS p{a}" for i, (a, c) in enumerate((("x", 5.5), ("y", 5.5), ("z", 3.0))))
    return f"""dr AS (SELECT volume_id, {draws} FROM fx_volumes),
pl AS (SELECT g.volume_id, g.z, g.y, g.x, {place} FROM fx_dense g JOIN dr USING (volume_id)),
sc AS (SELECT * FROM pl WHERE px >= -0.5 AND px < 11.5 AND py >= -0.5 AND py < 11.5 AND pz >= -0.5 AND pz < 6.5),
qc AS (SELECT *, least(greatest(px, 0), 11) AS qx, least(greatest(py, 0), 11) AS qy, least(greatest(pz, 0), 6) AS qz FROM sc),
li AS (SELECT q.volume_id, q.z, q.y, q.x, sum(v.v * (CASE i.i WHEN 1 THEN qx - floor(qx) ELSE 1 - (qx - floor(qx)) END) * (CASE j.j WHEN 1 THEN qy - floor(qy) ELSE 1 - (qy - floor(qy)) END)
  * (CASE k.k WHEN 1 THEN qz - floor(qz) ELSE 1 - (qz - floor(qz)) END)) AS v
  FROM qc q, range(2) i(i), range(2) j(j), range(2) k(k), fx_voxels v WHERE v.volume_id = q.volume_id AND v.x = least(floor(qx) + i.i, 11) AND v.y = least(floor(qy) + j.j, 11) AND v.z = least(floor(qz) + k.k, 6) GROUP BY ALL),
ne AS (SELECT s.volume_id, s.z, s.y, s.x, g.label FROM sc s JOIN fx_class_gt g ON g.volume_id = s.volume_id AND g.x = floor(px + 0.5) AND g.y = floor(py + 0.5) AND g.z = floor(pz + 0.5))"""


@query(
    "q_affine_pair",
    f"""WITH {_affine_sql()}
SELECT volume_id, z, y, x, round(coalesce(li.v, 0), 5) AS v, CAST(coalesce(ne.label, 0) AS INT) AS label FROM li FULL JOIN ne USING (volume_id, z, y, x) WHERE coalesce(li.v, 0) > 0.001 OR ne.label > 0""",
)
def q_affine_pair(fx):
    """Image and label under one random turn and scale: linear for the one, nearest for the other."""
    frames = af.frames(fx.volumes)
    target = af.random_affine(frames, 5, share=1.0)
    image = ch.to_voxels(af.resample_to(fx.sparse, frames, target, "linear", shape=CHUNK))
    label = ch.to_voxels(af.resample_to(fx.class_gt, frames, target, "nearest", shape=CHUNK, value="label"), names=("label",))
    both = image.join(label, ["volume_id", "z", "y", "x"]).filter("v > 0.001 or label > 0")
    return both.select("volume_id", "z", "y", "x", F.round("v", 5).alias("v"), F.col("label").cast("int").alias("label"))


def _view_labels(fx):
    """Each view's slices with objects of their own, from one pass over the voxels."""
    masks = {"XY": F.col("v") > 20, "XZ": F.col("d") > 0.03, "YZ": (F.col("t") > 0.03) & (F.col("volume_id") % 3 != 0)}
    seen = [F.when(keep, F.struct(F.lit(view).alias("view"), *(F.col(s).alias(t) for s, t in zip(ge.VIEWS[view], "abc")))) for view, keep in masks.items()]
    rows = fx.voxels.select("volume_id", F.col("cls").alias("label"), F.explode(F.array_compact(F.array(*seen))).alias("_p"))
    rows = rows.select("volume_id", "label", "_p.view", "_p.a", "_p.b", "_p.c")
    names = F.when(F.col("volume_id") % 3 == 0, F.array(F.lit("XY"), F.lit("XZ"))).otherwise(F.array(*[F.lit(v) for v in masks]))
    return rows, fx.volumes.select("volume_id", F.explode(names).alias("view"))


_PLANE = {"XY": ("z", "y", "x"), "XZ": ("y", "z", "x"), "YZ": ("x", "z", "y")}


def _flow_sql() -> str:
    mask = {"XY": "v > 20", "XZ": "d > 0.03", "YZ": "t > 0.03 AND g.volume_id % 3 <> 0"}
    parts, fields = [], []
    for view, (s, a, b) in _PLANE.items():
        n = view.lower()
        parts.append(f"""{n}o AS (SELECT g.volume_id, g.z, g.y, g.x, CASE WHEN {mask[view]} THEN cls ELSE 0 END AS label FROM fx_dense g LEFT JOIN fx_voxels w ON g.volume_id = w.volume_id AND g.z = w.z AND g.y = w.y AND g.x = w.x)""".replace("CASE WHEN v >", "CASE WHEN w.v >"))
        parts.append(f"""{n}d AS (SELECT p.volume_id, p.z, p.y, p.x, p.label, sqrt(coalesce(min((p.{a} - q.{a}) * (p.{a} - q.{a}) + (p.{b} - q.{b}) * (p.{b} - q.{b})) FILTER (q.label <> p.label), 1)::DOUBLE) AS d
  FROM {n}o p JOIN {n}o q ON p.volume_id = q.volume_id AND p.{s} = q.{s} WHERE p.label > 0 GROUP BY ALL)""")
        side = lambda axis, by: " AND ".join(["w.volume_id = p.volume_id", "w.label = p.label", *(f"w.{c} = p.{c}{by if c == axis else ''}" for c in "zyx")])
        slope = lambda axis: f"coalesce((SELECT d FROM {n}d w WHERE {side(axis, ' + 1')}), 0) * 0.5 - coalesce((SELECT d FROM {n}d w WHERE {side(axis, ' - 1')}), 0) * 0.5"  # noqa: B023, E731
        fields.append("SELECT volume_id, z, y, x, " + ", ".join(f"{slope(c) if c in (a, b) else 'NULL::DOUBLE'} AS g{c}" for c in "zyx") + f" FROM {n}d p")
    return f"""{", ".join(parts)},
gv AS ({" UNION ALL ".join(fields)}),
ga AS (SELECT volume_id, z, y, x, coalesce(avg(gz), 0) AS gz, coalesce(avg(gy), 0) AS gy, coalesce(avg(gx), 0) AS gx FROM gv GROUP BY ALL),
mk AS (SELECT w.volume_id, w.z, w.y, w.x FROM (SELECT volume_id, z, y, x, CAST(v > 20 AS INT) + CAST(d > 0.03 AS INT) + CASE WHEN volume_id % 3 = 0 THEN 0 ELSE CAST(t > 0.03 AS INT) END AS votes FROM fx_voxels) w
  WHERE votes * 2 > CASE WHEN volume_id % 3 = 0 THEN 2 ELSE 3 END),
st AS (SELECT m.*, sqrt(gz * gz + gy * gy + gx * gx) AS s, gz, gy, gx FROM mk m JOIN ga USING (volume_id, z, y, x)),
tg AS (SELECT volume_id, z, y, x, CAST(z + CASE WHEN s > 0 THEN round(gz / s) ELSE 0 END AS INT) AS tz, CAST(y + CASE WHEN s > 0 THEN round(gy / s) ELSE 0 END AS INT) AS ty,
  CAST(x + CASE WHEN s > 0 THEN round(gx / s) ELSE 0 END AS INT) AS tx FROM st),
sp AS (SELECT t.volume_id, t.z, t.y, t.x, coalesce(m.z, t.z) AS tz, coalesce(m.y, t.y) AS ty, coalesce(m.x, t.x) AS tx FROM tg t LEFT JOIN mk m ON m.volume_id = t.volume_id AND m.z = t.tz AND m.y = t.ty AND m.x = t.tx),
wk AS (SELECT *, 1 AS n FROM sp UNION ALL SELECT w.volume_id, w.z, w.y, w.x, sp.tz, sp.ty, sp.tx, n + 1 FROM wk w JOIN sp ON sp.volume_id = w.volume_id AND sp.z = w.tz AND sp.y = w.ty AND sp.x = w.tx WHERE n < 32),
en AS (SELECT * FROM wk WHERE n = 32),
rs AS (SELECT DISTINCT volume_id, tz AS z, ty AS y, tx AS x, 1 AS label FROM en),
{cc_sql('rs', 3, 'volume_id', 'ms')}"""


@query("q_flow_fusion", f"WITH RECURSIVE {_flow_sql()} SELECT en.volume_id, en.z, en.y, en.x, object_id FROM en JOIN ms ON ms.volume_id = en.volume_id AND ms.z = tz AND ms.y = ty AND ms.x = tx")
def q_flow_fusion(fx):
    return TRANSFORMS.run("view fusion by flow", *_view_labels(fx), fx.volumes)


@query("q_superpixels")
def q_superpixels(fx):
    """No SQL: rounds that depend on each other; ``tests/test_space.py`` compares them with a plain version."""
    return su.superpixels(fx.sparse, fx.volumes, 100.0, 0.5, 20, CHUNK)


@query("q_segment_superpixels")
def q_segment_superpixels(fx):
    return SEGMENTERS.run("felzenszwalb", fx.sparse, fx.volumes, min_size=30)
