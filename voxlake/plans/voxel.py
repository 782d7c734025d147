"""Voxel value queries."""

from pyspark.sql import functions as F

from voxlake.extensions import TRANSFORMS
from voxlake.operators import geometry as ge
from voxlake.operators import voxel as vx
from voxlake.operators.tiles import ragged_tiles
from voxlake.operators.joins import box_join
from voxlake.plans.registry import query
from voxlake.plans.splits import _unit

VOX = "volume_id, z, y, x"
_RANGE = "r AS (SELECT volume_id, min(v) AS lo, max(v) AS hi FROM {t} GROUP BY volume_id)"


def r6(df, col="v"):
    return df.withColumn(col, F.round(col, 6))


@query("q_binarize", f"SELECT {VOX}, CASE WHEN v > 0 THEN 1 ELSE 0 END AS v FROM fx_dense")
def q_binarize(fx):
    return vx.binarize(vx.require_uint8(fx.dense))


@query("q_uint8_violations", f"SELECT {VOX}, v FROM (SELECT {VOX}, v * 6 - 3.5 * (x % 2) AS v FROM fx_voxels) WHERE v < 0 OR v > 255 OR v <> floor(v)")
def q_uint8_violations(fx):
    return vx.uint8_violations(fx.sparse.withColumn("v", F.col("v") * 6 - 3.5 * (F.col("x") % 2)))


@query(
    "q_uint8_float",
    f"""WITH s AS (SELECT {VOX}, d + t AS v FROM fx_voxels), {_RANGE.format(t='s')}
SELECT {VOX}, CASE WHEN hi = lo THEN 0 ELSE CAST(trunc((v - lo) / (hi - lo) * 255) AS INT) END AS v FROM s JOIN r USING (volume_id)""",
)
def q_uint8_float(fx):
    return vx.to_uint8(fx.voxels.select("volume_id", "z", "y", "x", (F.col("d") + F.col("t")).alias("v")))


@query("q_uint8_int", f"SELECT {VOX}, CAST(greatest(0, least(255, v * 7 - 20)) AS INT) AS v FROM fx_voxels")
def q_uint8_int(fx):
    return vx.to_uint8(fx.sparse.withColumn("v", (F.col("v") * 7 - 20).cast("int")), kind="int")


@query(
    "q_uint8_any",
    f"""WITH s AS (SELECT {VOX}, CASE WHEN volume_id % 10 = 3 THEN 5.0::DOUBLE ELSE v END AS v FROM fx_dense), {_RANGE.format(t='s')}
SELECT {VOX}, CASE WHEN hi = lo THEN 0 ELSE CAST(trunc((v - lo) / (hi - lo) * 255) AS INT) END AS v FROM s JOIN r USING (volume_id)""",
)
def q_uint8_any(fx):
    return vx.to_uint8(fx.dense.withColumn("v", F.when(F.col("volume_id") % 10 == 3, 5.0).otherwise(F.col("v"))), kind="any")


_NORM = "round({start} / (CASE WHEN hi = lo THEN 1 ELSE hi - lo END) * 2.0::DOUBLE - 1.0::DOUBLE, 6)"


@query("q_norm_volume", f"WITH {_RANGE.format(t='fx_dense')} SELECT {VOX}, {_NORM.format(start='(v - lo)')} AS v FROM fx_dense JOIN r USING (volume_id)")
def q_norm_volume(fx):
    return r6(TRANSFORMS.run("normalize range", fx.dense))


@query(
    "q_norm_as_computed",
    f"WITH {_RANGE.format(t='fx_voxels')} SELECT {VOX}, {_NORM.format(start='v')} AS v FROM fx_voxels JOIN r USING (volume_id)",
)
def q_norm_as_computed(fx):
    return r6(vx.normalize(fx.sparse, -1.0, 1.0, "as_computed"))


@query(
    "q_norm_axis",
    f"""WITH r AS (SELECT volume_id, y, x, min(v) AS lo, max(v) AS hi FROM fx_dense GROUP BY ALL)
SELECT {VOX}, {_NORM.format(start='(v - lo)')} AS v FROM fx_dense JOIN r USING (volume_id, y, x)""",
)
def q_norm_axis(fx):
    return r6(vx.normalize(fx.dense, -1.0, 1.0, axis="z"))


@query("q_hu_clip", f"SELECT {VOX}, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (v * 80 - 1500 + 1024) / 3072)), 6) AS v, v * 80 / 10000.0::DOUBLE AS tenth FROM fx_voxels")
def q_hu_clip(fx):
    hu = F.col("v") * 80
    return fx.sparse.select(
        "volume_id", "z", "y", "x", F.round(vx.clip_scale(hu - 1500, -1024.0, 2048.0), 6).alias("v"), (hu / 10000.0).alias("tenth")
    )


@query(
    "q_percentile_window",
    f"""WITH s AS (SELECT {VOX}, CASE WHEN volume_id % 10 = 3 THEN 0.0::DOUBLE ELSE v END AS v FROM fx_dense),
p AS (SELECT volume_id, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM s WHERE v <> 0 GROUP BY volume_id)
SELECT {VOX}, CASE WHEN v <= coalesce(lo, 0) THEN 0.0::DOUBLE WHEN v >= coalesce(hi, 0) THEN 1000.0::DOUBLE ELSE round((v - lo) / (hi - lo) * 1000, 6) END AS v
FROM s LEFT JOIN p USING (volume_id)""",
)
def q_percentile_window(fx):
    rows = fx.sparse.withColumn("v", F.when(F.col("volume_id") % 10 == 3, 0.0).otherwise(F.col("v")))
    return r6(vx.percentile_window(rows, 0.05, 0.95, parts=fx.parts, volumes=fx.volumes))


_TILES = """t AS (SELECT volume_id, CAST(a.z AS INT) AS z0, CAST(b.y AS INT) AS y0, CAST(c.x AS INT) AS x0 FROM fx_volumes, range(0, 7, 4) a(z), range(0, 12, 6) b(y), range(0, 12, 6) c(x)),
tv AS (SELECT t.*, v.z, v.y, v.x, v.v FROM t JOIN fx_dense v ON t.volume_id = v.volume_id AND v.z >= z0 AND v.z < z0 + 5 AND v.y >= y0 AND v.y < y0 + 8 AND v.x >= x0 AND v.x < x0 + 8)"""


@query(
    "q_zscore",
    f"""WITH {_TILES} SELECT volume_id, z0, y0, x0, z, y, x, round((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-6), 6) AS v FROM tv WINDOW w AS (PARTITION BY volume_id, z0, y0, x0)""",
)
def q_zscore(fx):
    rows = box_join(ragged_tiles(fx.volumes, (5, 8, 8), (4, 6, 6)), fx.dense)
    out = vx.zscore(rows, ["volume_id", "z0", "y0", "x0"])
    return r6(out.select("volume_id", "z0", "y0", "x0", "z", "y", "x", "v"))


_BOX = """b AS (SELECT volume_id, least(greatest(CAST(trunc(avg(z)) AS INT) - 2, 0), 2) AS z0, least(greatest(CAST(trunc(avg(y)) AS INT) - 3, 0), 6) AS y0,
  least(greatest(CAST(trunc(avg(x)) AS INT) - 3, 0), 6) AS x0 FROM fx_gt GROUP BY volume_id)"""


@query(
    "q_zscore_fg",
    f"""WITH {_BOX}, s AS (SELECT volume_id, avg(v) AS m, stddev_samp(v) AS sd FROM fx_voxels JOIN b USING (volume_id)
  WHERE v > 0 AND z BETWEEN z0 AND z0 + 4 AND y BETWEEN y0 AND y0 + 5 AND x BETWEEN x0 AND x0 + 5 GROUP BY volume_id)
SELECT {VOX}, round((v - m) / (sd + 1e-8), 6) AS v FROM fx_dense JOIN s USING (volume_id)""",
)
def q_zscore_fg(fx):
    return r6(vx.foreground_zscore(fx.dense, ge.mask_boxes(fx.gt, fx.volumes, (5, 6, 6))))


@query("q_label_remap", f"SELECT {VOX}, CASE label WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS label FROM fx_class_gt")
def q_label_remap(fx):
    return vx.remap_labels(fx.class_gt, [3, 1], 2)


@query(
    "q_class_merge",
    f"SELECT {VOX}, max(label) AS label FROM (SELECT * FROM fx_class_gt UNION ALL SELECT * FROM fx_class_pred) GROUP BY ALL",
)
def q_class_merge(fx):
    return vx.merge_classes(vx.class_masks(fx.class_gt.unionByName(fx.class_pred)))


def _draw(low: float, high: float, tag: str, seed: int) -> str:
    key = f"concat(volume_id, '|{tag}|{seed}')"
    return f"({low}::DOUBLE + ({high}::DOUBLE - {low}::DOUBLE) * {_unit(key)})"


@query(
    "q_gamma",
    f"SELECT {VOX}, round(pow(greatest(v * {_draw(0.8, 1.2, 'scale', 1)}, 1e-6), {_draw(0.7, 1.5, 'gamma', 1)}), 5) AS v FROM fx_dense",
)
def q_gamma(fx):
    return vx.scale_gamma(fx.dense, 1).withColumn("v", F.round("v", 5))


def _normal(tag: str, seed: int) -> str:
    key = "concat({a}, '|', {b}, '|', {c}, '|', {d}, '|{t}{i}|{s}')"
    u1 = _unit(key.format(a="volume_id", b="z", c="y", d="x", t=tag, i=1, s=seed))
    u2 = _unit(key.format(a="volume_id", b="z", c="y", d="x", t=tag, i=2, s=seed))
    return f"(sqrt(-2.0 * ln(1.0 - {u1})) * cos(2.0 * pi() * {u2}))"


@query(
    "q_gauss_noise",
    f"""WITH s AS (SELECT volume_id, stddev_pop(v) AS sd FROM fx_dense GROUP BY volume_id)
SELECT {VOX}, round(v + {_normal('noise', 2)} * 0.01 * sd, 6) AS v FROM fx_dense JOIN s USING (volume_id)""",
)
def q_gauss_noise(fx):
    return r6(vx.gaussian_noise(fx.dense, 2))


_POISSON_KEY = "concat(volume_id, '|', z, '|', y, '|', x, '|poisson|4')"


@query(
    "q_poisson_noise",
    f"""WITH p AS (SELECT {VOX}, greatest(v, 0) AS lam, {_unit(_POISSON_KEY)} AS u FROM fx_dense),
c AS (SELECT lam, k, sum(exp(-lam + k * ln(lam) - lgamma(k + 1))) OVER (PARTITION BY lam ORDER BY k) AS cdf FROM (SELECT DISTINCT lam FROM p WHERE lam > 0), range(180) r(k))
SELECT {VOX}, CAST(min(k) AS DOUBLE) AS v FROM p JOIN c USING (lam) WHERE cdf >= u GROUP BY {VOX} UNION ALL SELECT {VOX}, 0.0::DOUBLE FROM p WHERE lam = 0""",
)
def q_poisson_noise(fx):
    return vx.poisson_noise(fx.dense, 4)


@query("q_channels", f"SELECT {VOX}, v, CAST(c.c AS INT) AS c FROM fx_voxels, range(3) c(c) WHERE c.c < 2")
def q_channels(fx):
    return vx.truncate_channels(vx.expand_channels(fx.sparse, 3), 2)
