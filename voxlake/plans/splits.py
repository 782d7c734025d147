"""Split and sampling queries."""

from pyspark.sql import functions as F

from voxlake.operators import splits as sp
from voxlake.plans.catalog import _PARTS
from voxlake.plans.registry import query
from voxlake.sources import catalog as ct


def _split_sql(limit: str) -> str:
    return f"""WITH {_PARTS}, k AS (SELECT base, row_number() OVER (ORDER BY md5(concat(base, '42')), base) AS r, count(*) OVER () AS n
  FROM (SELECT DISTINCT base FROM p2 WHERE ok))
SELECT base, path, CASE WHEN r <= {limit} THEN 'train' ELSE 'val' END AS split FROM p2 JOIN k USING (base) WHERE ok"""


@query("q_group_split", _split_sql("floor(n * 0.8)"))
def q_group_split(fx):
    return sp.group_split(ct.scan_filter(fx.files).select("path"), 0.8, 42)


@query("q_split_round", _split_sql("round_even(n * 0.75, 0)"))
def q_split_round(fx):
    return sp.group_split(ct.scan_filter(fx.files).select("path"), 0.75, 42, "round")


@query(
    "q_split_list",
    f"""WITH {_PARTS}, k AS (SELECT base, row_number() OVER (ORDER BY md5(concat(base, '7')), base) AS r, count(*) OVER () AS n
  FROM (SELECT DISTINCT i.base FROM p2 i JOIN p2 m ON i.dir = m.dir AND i.base = m.base AND i.ext = m.ext WHERE i.ok AND m.ok AND NOT i.is_mask AND m.is_mask))
SELECT i.base AS id, i.path AS image, m.path AS label FROM p2 i JOIN p2 m ON i.dir = m.dir AND i.base = m.base AND i.ext = m.ext JOIN k ON k.base = i.base
WHERE i.ok AND m.ok AND NOT i.is_mask AND m.is_mask AND r > floor(n * 0.8)""",
)
def q_split_list(fx):
    pairs = ct.pair_images(fx.files)[0]
    split = sp.group_split(pairs.select(F.col("image").alias("path"), "mask"), 0.8, 7)
    listed = split.select(F.col("base").alias("id"), F.col("path").alias("image"), F.col("mask").alias("label"), "split")
    return sp.read_split(listed, "val")


def _unit(key: str) -> str:
    return f"(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def _boxes_sql(name: str, patches: int, size, seed: int) -> str:
    cols = []
    for a, s, n in zip("zyx", size, (7, 12, 12)):
        d = min(s, n)
        u = _unit(f"concat(volume_id, '|', patch, '|{a}|{seed}')")
        cols.append(f"{d} AS d{a}, CAST(floor({u} * ({n} - {d} + 1)) AS INT) AS {a}0")
    return f"""{name} AS (SELECT volume_id, patch, {', '.join(cols)} FROM (SELECT volume_id, CAST(k AS INT) AS patch FROM fx_volumes, range({patches}) r(k)))"""


_IN = "v.z >= z0 AND v.z < z0 + dz AND v.y >= y0 AND v.y < y0 + dy AND v.x >= x0 AND v.x < x0 + dx"


@query(
    "q_random_crop",
    f"""WITH {_boxes_sql('b', 4, (3, 5, 20), 11)} SELECT b.volume_id, patch, v.z - z0 AS pz, v.y - y0 AS py, v.x - x0 AS px, v.v
FROM b JOIN fx_voxels v ON v.volume_id = b.volume_id AND {_IN}""",
)
def q_random_crop(fx):
    return sp.random_crops(fx.sparse, sp.crop_boxes(fx.volumes, 4, (3, 5, 20), 11))


@query(
    "q_fg_patch",
    f"""WITH {_boxes_sql('b', 10, (3, 4, 4), 5)}, f AS (SELECT b.volume_id, patch, z0, y0, x0, count(v.z) / 48.0::DOUBLE AS fraction
  FROM b LEFT JOIN fx_gt v ON v.volume_id = b.volume_id AND {_IN} GROUP BY ALL),
k AS (SELECT volume_id, coalesce(min(patch) FILTER (fraction >= 0.15), 9) AS patch FROM f GROUP BY volume_id)
SELECT volume_id, patch + 1 AS tries, round(fraction, 6) AS fraction, z0, y0, x0 FROM k JOIN f USING (volume_id, patch)""",
)
def q_fg_patch(fx):
    boxes = sp.crop_boxes(fx.volumes, 10, (3, 4, 4), 5)
    return sp.foreground_boxes(fx.gt, boxes, 0.15).withColumn("fraction", F.round("fraction", 6))


_VK = "concat(volume_id, '|', z, '|', y, '|', x, '{seed}')"


#: Each model's masks as volumes of their own; a model without a prediction for a volume has an empty mask there.
_EACH = """vv AS (SELECT concat(model, ':', volume_id) AS volume_id FROM fx_pairs), pp AS (SELECT concat(model, ':', volume_id) AS volume_id, z, y, x FROM fx_pred),
g AS (SELECT concat(model, ':', volume_id) AS volume_id, z, y, x FROM fx_pairs JOIN fx_gt USING (volume_id))"""


def _each(fx, rows):
    """Rows with a model, the volume named by model and id."""
    return rows.withColumn("volume_id", F.concat("model", F.lit(":"), "volume_id")).drop("model")


def _each_volume(fx):
    return _each(fx, fx.pairs.join(fx.volumes, "volume_id").select("model", *fx.volumes.columns))


@query(
    "q_fg_centered",
    f"""WITH {_EACH}, p AS (SELECT volume_id, z, y, x FROM pp QUALIFY row_number() OVER (PARTITION BY volume_id ORDER BY md5({_VK.format(seed=3)}), z, y, x) = 1)
SELECT volume_id, p.z IS NOT NULL AS centred,
  CAST(coalesce(least(greatest(p.z - 1, 0), 4), floor({_unit("concat(volume_id, '|z|3')")} * 5)) AS INT) AS z0,
  CAST(coalesce(least(greatest(p.y - 2, 0), 7), floor({_unit("concat(volume_id, '|y|3')")} * 8)) AS INT) AS y0,
  CAST(coalesce(least(greatest(p.x - 3, 0), 6), floor({_unit("concat(volume_id, '|x|3')")} * 7)) AS INT) AS x0
FROM vv LEFT JOIN p USING (volume_id)""",
)
def q_fg_centered(fx):
    return sp.foreground_centred(_each(fx, fx.pred), _each_volume(fx), (3, 5, 6), 3)


@query(
    "q_class_centers",
    f"""SELECT volume_id, z, y, x, label, CAST(row_number() OVER (PARTITION BY volume_id, label ORDER BY md5({_VK.format(seed=9)}), z, y, x) AS INT) AS pick
FROM fx_class_gt QUALIFY pick <= 3""",
)
def q_class_centers(fx):
    return sp.class_centres(fx.class_gt, 3, 9)


@query(
    "q_rank_stride",
    f"""WITH {_PARTS}, o AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS i, count(*) OVER () AS n FROM p2 WHERE ok),
a AS (SELECT path, i AS position FROM o UNION ALL SELECT path, n + i FROM o WHERE i < (7 - n % 7) % 7)
SELECT path, position, CAST(position % 7 AS INT) AS replica FROM a""",
)
def q_rank_stride(fx):
    return sp.rank_stride(ct.scan_filter(fx.files).select("path"), "path", 7)


@query(
    "q_error_click",
    f"""WITH {_EACH},
e AS (SELECT *, 1 AS label FROM (SELECT * FROM g EXCEPT SELECT * FROM pp) UNION ALL SELECT *, 0 AS label FROM (SELECT * FROM pp EXCEPT SELECT * FROM g)),
c AS (SELECT *, 'error' AS kind, 1 AS pr FROM e UNION ALL SELECT *, 1, 'truth', 2 FROM g UNION ALL SELECT volume_id, 3, 6, 6, 1, 'centre', 3 FROM vv)
SELECT volume_id, z, y, x, label, kind FROM c QUALIFY row_number() OVER (PARTITION BY volume_id ORDER BY pr, md5({_VK.format(seed=1)}), z, y, x) = 1""",
)
def q_error_click(fx):
    truth = _each(fx, fx.pairs.join(fx.gt, "volume_id"))
    return sp.error_clicks(truth, _each(fx, fx.pred), _each_volume(fx), 1)


@query("q_min_label", "SELECT volume_id, count(*) AS n FROM fx_gt WHERE volume_id IN (SELECT volume_id FROM fx_gt GROUP BY 1 HAVING count(*) >= 70) GROUP BY 1")
def q_min_label(fx):
    return sp.keep_labelled(fx.gt, fx.gt, 70).groupBy("volume_id").agg(F.count("*").alias("n"))


def _cuboid_sql(ratio: float, seed: int, boxes: int) -> str:
    cols = []
    for a, n in zip("zyx", (7, 12, 12)):
        size, start = (_unit(f"concat(volume_id, '|', box, '|{a}{what}|{seed}')") for what in ("size", "start"))
        side = f"CAST(1 + floor({size} * ({max(n // 2, 2)} - 1)) AS INT)"
        cols.append(f"{side} AS d{a}, CAST(floor({start} * ({n} - {side} + 1)) AS INT) AS {a}0")
    return f"""WITH b AS (SELECT volume_id, box, {', '.join(cols)} FROM (SELECT volume_id, CAST(k AS INT) AS box FROM fx_volumes, range({boxes}) r(k))),
f AS (SELECT g.volume_id, g.z, g.y, g.x, min(box) AS box FROM fx_dense g JOIN b ON g.volume_id = b.volume_id AND g.z >= z0 AND g.z < z0 + dz AND g.y >= y0 AND g.y < y0 + dy AND g.x >= x0 AND g.x < x0 + dx GROUP BY ALL),
h AS (SELECT volume_id, box, sum(count(*)) OVER (PARTITION BY volume_id ORDER BY box) AS hidden FROM f GROUP BY volume_id, box),
l AS (SELECT volume_id, min(box) AS last FROM h WHERE hidden >= floor(1008 * {ratio}) GROUP BY volume_id)
SELECT volume_id, z, y, x FROM f JOIN l USING (volume_id) WHERE box <= last"""


@query("q_cuboid_mask", _cuboid_sql(0.4, 9, 512))
def q_cuboid_mask(fx):
    """Grids whose first 32 boxes hide too little get more of the same series."""
    return sp.cuboid_masks(fx.volumes, 0.4, 9)
