"""Queries that move voxels."""

from pyspark.sql import functions as F

from voxlake.operators import geometry as ge
from voxlake.operators.joins import densify
from voxlake.plans.registry import query
from voxlake.plans.voxel import VOX, _BOX, _draw, _normal, r6


def _lits(z, y, x):
    return {"z": F.lit(z), "y": F.lit(y), "x": F.lit(x)}


@query(
    "q_multiview",
    """SELECT volume_id, v, 'XY' AS view, z AS a, y AS b, x AS c FROM fx_voxels UNION ALL SELECT volume_id, v, 'XZ', y, z, x FROM fx_voxels
UNION ALL SELECT volume_id, v, 'YZ', x, z, y FROM fx_voxels""",
)
def q_multiview(fx):
    return ge.multiview(fx.sparse)


@query("q_mip", "SELECT volume_id, y, x, max(v) AS v FROM fx_dense GROUP BY ALL")
def q_mip(fx):
    return ge.max_projection(fx.dense)


@query("q_mid_slice", "SELECT volume_id, y, x, label FROM fx_class_gt WHERE z = 3")
def q_mid_slice(fx):
    return ge.middle_slice(fx.class_gt, fx.volumes)


_M = {"z": (7, 11), "y": (12, 9), "x": (12, 5)}


def _half(a):
    n, m = _M[a]
    return f"greatest(0.0::DOUBLE, least({n} - 1.0::DOUBLE, (t{a}.t + 0.5::DOUBLE) * {n} / {m} - 0.5::DOUBLE))"


def _corner(a):
    n, m = _M[a]
    return f"(t{a}.t * {n - 1}::DOUBLE / {m - 1})"


_GRID = "range(11) tz(t), range(9) ty(t), range(5) tx(t)"


@query(
    "q_resample_nearest",
    f"""WITH g AS (SELECT volume_id, CAST(tz.t AS INT) AS z, CAST(ty.t AS INT) AS y, CAST(tx.t AS INT) AS x,
  CAST(floor((tz.t + 0.5::DOUBLE) * 7 / 11) AS INT) AS sz, CAST(floor((ty.t + 0.5::DOUBLE) * 12 / 9) AS INT) AS sy, CAST(floor((tx.t + 0.5::DOUBLE) * 12 / 5) AS INT) AS sx
  FROM fx_volumes, {_GRID})
SELECT g.volume_id, g.z, g.y, g.x, c.label FROM g JOIN fx_class_gt c ON c.volume_id = g.volume_id AND c.z = sz AND c.y = sy AND c.x = sx""",
)
def q_resample_nearest(fx):
    return ge.resample_nearest(fx.class_gt, fx.volumes, _lits(11, 9, 5))


def _linear_sql(at, n_out=6):
    return f"""WITH g AS (SELECT volume_id, CAST(tz.t AS INT) AS z, CAST(ty.t AS INT) AS y, CAST(tx.t AS INT) AS x, {at('z')} AS sz, {at('y')} AS sy, {at('x')} AS sx
  FROM fx_volumes, {_GRID}),
k AS (SELECT g.*, floor(sz) + a.k AS kz, floor(sy) + b.k AS ky, floor(sx) + c.k AS kx,
  (1 - abs(sz - floor(sz) - a.k)) * (1 - abs(sy - floor(sy) - b.k)) * (1 - abs(sx - floor(sx) - c.k)) AS w FROM g, range(2) a(k), range(2) b(k), range(2) c(k))
SELECT k.volume_id, k.z, k.y, k.x, round(sum(w * d.v), {n_out}) AS v FROM k JOIN fx_dense d ON d.volume_id = k.volume_id AND d.z = kz AND d.y = ky AND d.x = kx GROUP BY ALL"""


@query("q_resample_linear", _linear_sql(_half))
def q_resample_linear(fx):
    return r6(ge.resample_linear(fx.dense, fx.volumes, _lits(11, 9, 5)))


@query("q_resample_corners", _linear_sql(_corner))
def q_resample_corners(fx):
    return r6(ge.resample_linear(fx.dense, fx.volumes, _lits(11, 9, 5), True))


@query(
    "q_resample_spacing",
    """WITH g AS (SELECT volume_id, CAST(tz.t AS INT) AS z, CAST(ty.t AS INT) AS y, CAST(tx.t AS INT) AS x FROM fx_volumes, range(13) tz(t), range(11) ty(t), range(11) tx(t))
SELECT g.volume_id, g.z, g.y, g.x, c.label FROM g JOIN fx_gt c ON c.volume_id = g.volume_id AND c.z = floor(3.5::DOUBLE + (g.z - 6.5::DOUBLE) * 1.6 / 3 + 0.5)
AND c.y = floor(6::DOUBLE + (g.y - 5.5::DOUBLE) * 1.6 / 1.5 + 0.5) AND c.x = floor(6::DOUBLE + (g.x - 5.5::DOUBLE) * 1.6 / 1.5 + 0.5)""",
)
def q_resample_spacing(fx):
    return ge.resample_spacing(fx.gt, fx.volumes, 1.6, "nearest", "label")


@query(
    "q_center_crop_pad",
    """WITH g AS (SELECT volume_id, CAST(tz.t AS INT) AS z, CAST(ty.t AS INT) AS y, CAST(tx.t AS INT) AS x FROM fx_volumes, range(10) tz(t), range(7) ty(t), range(15) tx(t))
SELECT g.volume_id, g.z, g.y, g.x, coalesce(v.v, 0) AS v FROM g LEFT JOIN fx_voxels v ON v.volume_id = g.volume_id AND v.z = g.z - 1 AND v.y = g.y + 2 AND v.x = g.x - 1""",
)
def q_center_crop_pad(fx):
    shape = _lits(10, 7, 15)
    moved = ge.centre_crop_or_pad(fx.sparse, fx.volumes, shape)
    sized = fx.volumes.select("volume_id", *[v.alias(f"n{a}") for a, v in shape.items()])
    return densify(moved, sized, {"v": 0.0})


@query(
    "q_mask_crop",
    f"""WITH {_BOX} SELECT volume_id, z - z0 AS z, y - y0 AS y, x - x0 AS x, v FROM fx_voxels JOIN b USING (volume_id)
WHERE z BETWEEN z0 AND z0 + 4 AND y BETWEEN y0 AND y0 + 5 AND x BETWEEN x0 AND x0 + 5""",
)
def q_mask_crop(fx):
    return ge.crop(fx.sparse, ge.mask_boxes(fx.gt, fx.volumes, (5, 6, 6)))


@query(
    "q_mask_crop_pad",
    """WITH b AS (SELECT volume_id, CAST(floor((coalesce(min(g.z) + max(g.z) + 1, 7) - 5) / 2) AS INT) AS z0, CAST(floor((coalesce(min(g.y) + max(g.y) + 1, 12) - 16) / 2) AS INT) AS y0,
  CAST(floor((coalesce(min(g.x) + max(g.x) + 1, 12) - 9) / 2) AS INT) AS x0 FROM fx_volumes LEFT JOIN fx_gt g USING (volume_id) GROUP BY volume_id)
SELECT volume_id, z - z0 AS z, y - y0 AS y, x - x0 AS x, v FROM fx_voxels JOIN b USING (volume_id) WHERE z - z0 BETWEEN 0 AND 4 AND y - y0 BETWEEN 0 AND 15 AND x - x0 BETWEEN 0 AND 8""",
)
def q_mask_crop_pad(fx):
    return ge.crop(fx.sparse, ge.crop_or_pad_boxes(fx.gt, fx.volumes, (5, 16, 9)))


@query(
    "q_bbox_crop",
    """WITH b AS (SELECT volume_id, greatest(coalesce(min(s.z) - 1, 0), 0) AS z0, greatest(coalesce(min(s.y) - 1, 0), 0) AS y0, greatest(coalesce(min(s.x) - 1, 0), 0) AS x0,
  least(coalesce(max(s.z) + 1, 6), 6) AS z1, least(coalesce(max(s.y) + 1, 11), 11) AS y1, least(coalesce(max(s.x) + 1, 11), 11) AS x1
  FROM fx_volumes LEFT JOIN fx_gt s USING (volume_id) GROUP BY volume_id)
SELECT volume_id, z - z0 AS z, y - y0 AS y, x - x0 AS x, v FROM fx_voxels JOIN b USING (volume_id) WHERE z BETWEEN z0 AND z1 AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1""",
)
def q_bbox_crop(fx):
    return ge.crop(fx.sparse, ge.bounding_boxes(fx.gt, fx.volumes, 1))


@query("q_shift", f"SELECT volume_id, CAST(z + volume_id % 5 - 2 AS INT) AS z, y, x, v FROM fx_voxels WHERE z + volume_id % 5 - 2 BETWEEN 0 AND 6")
def q_shift(fx):
    return ge.shift(fx.sparse, fx.volumes, "z", F.col("volume_id") % 5 - 2)


@query("q_roll", "SELECT volume_id, CAST((z + volume_id % 3 - 1 + 7) % 7 AS INT) AS z, y, x, v FROM fx_voxels")
def q_roll(fx):
    return ge.roll(fx.sparse, fx.volumes, "z", F.col("volume_id") % 3 - 1)


@query("q_flip", "SELECT volume_id, z, 11 - y AS y, 11 - x AS x, v FROM fx_voxels")
def q_flip(fx):
    return ge.flip(fx.sparse, fx.volumes, ["y", "x"])


@query("q_drop_slices", f"SELECT {VOX}, v FROM fx_voxels WHERE z <> volume_id % 7")
def q_drop_slices(fx):
    return ge.drop_slices(fx.sparse, fx.volumes.select("volume_id", (F.col("volume_id") % 7).cast("int").alias("z")))


def _zoomed(a, n):
    return f"CAST(round_even({n} * {_draw(0.9, 1.1, 'zoom' + a, 6)}, 0) AS INT) AS m{a}"


@query(
    "q_zoom_pair",
    f"""WITH d AS (SELECT volume_id, {_zoomed('z', 7)}, {_zoomed('y', 12)}, {_zoomed('x', 12)} FROM fx_volumes),
g AS (SELECT volume_id, z.t AS tz, y.t AS ty, x.t AS tx, mz, my, mx, z.t * 6::DOUBLE / (mz - 1) AS sz, y.t * 11::DOUBLE / (my - 1) AS sy, x.t * 11::DOUBLE / (mx - 1) AS sx
  FROM d, range(9) z(t), range(15) y(t), range(15) x(t) WHERE z.t < mz AND y.t < my AND x.t < mx),
k AS (SELECT g.*, floor(sz) + a.k AS kz, floor(sy) + b.k AS ky, floor(sx) + c.k AS kx,
  (1 - abs(sz - floor(sz) - a.k)) * (1 - abs(sy - floor(sy) - b.k)) * (1 - abs(sx - floor(sx) - c.k)) AS w FROM g, range(2) a(k), range(2) b(k), range(2) c(k)),
i AS (SELECT k.volume_id, tz, ty, tx, mz, my, mx, sum(w * v.v) AS v FROM k JOIN fx_dense v ON v.volume_id = k.volume_id AND v.z = kz AND v.y = ky AND v.x = kx GROUP BY ALL),
m AS (SELECT g.volume_id, tz, ty, tx, v.label FROM g JOIN fx_gt v ON v.volume_id = g.volume_id AND v.z = floor(sz + 0.5) AND v.y = floor(sy + 0.5) AND v.x = floor(sx + 0.5)),
j AS (SELECT i.*, coalesce(label, 0) AS label FROM i LEFT JOIN m USING (volume_id, tz, ty, tx)),
p AS (SELECT volume_id, tz - greatest(mz - 7, 0) // 2 + greatest(7 - mz, 0) // 2 AS z, ty - greatest(my - 12, 0) // 2 + greatest(12 - my, 0) // 2 AS y,
  tx - greatest(mx - 12, 0) // 2 + greatest(12 - mx, 0) // 2 AS x, v, label FROM j)
SELECT volume_id, CAST(z AS INT) AS z, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(v, 6) AS v, label FROM p
WHERE z BETWEEN 0 AND 6 AND y BETWEEN 0 AND 11 AND x BETWEEN 0 AND 11""",
)
def q_zoom_pair(fx):
    both = ge.zoom_pair(fx.sparse, fx.gt, fx.volumes, 6, together=True)
    return r6(both.withColumn("label", F.coalesce("label", F.lit(0))))


def _moved(a):
    return f"{a} + 2.0::DOUBLE * {_normal('move' + a, 8)} AS s{a}"


def _mirror(e, n):
    k = f"((CAST({e} AS BIGINT) % {2 * n} + {2 * n}) % {2 * n})"
    return f"CASE WHEN {k} >= {n} THEN {2 * n - 1} - {k} ELSE {k} END"


_POINTS = f"p AS (SELECT {VOX}, {_moved('z')}, {_moved('y')}, {_moved('x')} FROM fx_dense)"


@query(
    "q_jitter_image",
    f"""WITH {_POINTS}, k AS (SELECT {VOX}, {_mirror('floor(sz) + a.k', 7)} AS kz, {_mirror('floor(sy) + b.k', 12)} AS ky, {_mirror('floor(sx) + c.k', 12)} AS kx,
  (1 - abs(sz - floor(sz) - a.k)) * (1 - abs(sy - floor(sy) - b.k)) * (1 - abs(sx - floor(sx) - c.k)) AS w FROM p, range(2) a(k), range(2) b(k), range(2) c(k))
SELECT k.volume_id, k.z, k.y, k.x, round(sum(w * d.v), 5) AS v FROM k JOIN fx_dense d ON d.volume_id = k.volume_id AND d.z = kz AND d.y = ky AND d.x = kx GROUP BY ALL""",
)
def q_jitter_image(fx):
    return ge.displace_image(fx.sparse.dropna(), fx.volumes, ge.displaced(fx.volumes, 8), parts=fx.parts).withColumn("v", F.round("v", 5))


@query(
    "q_jitter_mask",
    f"""WITH {_POINTS} SELECT p.volume_id, p.z, p.y, p.x, g.label FROM p JOIN fx_gt g ON g.volume_id = p.volume_id AND g.z = {_mirror('floor(sz + 0.5)', 7)}
AND g.y = {_mirror('floor(sy + 0.5)', 12)} AND g.x = {_mirror('floor(sx + 0.5)', 12)}""",
)
def q_jitter_mask(fx):
    return ge.displace_mask(fx.gt, ge.displaced(fx.volumes, 8))
