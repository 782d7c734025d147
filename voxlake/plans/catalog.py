"""Catalogue queries."""

from pyspark.sql import functions as F

from voxlake.extensions import TRANSFORMS
from voxlake.plans.registry import query
from voxlake.plans.score import _DICE, MODELS, _dice
from voxlake.sources import catalog as ct
from voxlake.sources import sinks, volumes as vo

_PARTS = r"""
p0 AS (SELECT path, length, regexp_extract(path, '[^/]*$') AS name, regexp_replace(path, '/?[^/]*$', '') AS dir FROM fx_files),
p1 AS (SELECT *, lower(regexp_extract(name, '(?i)(\.nii\.gz|\.[^./]+)$')) AS ext, regexp_replace(name, '(?i)(\.nii\.gz|\.[^./]+)$', '') AS stem FROM p0),
p2 AS (SELECT *, regexp_replace(stem, '(?i)_seg$', '') AS base, lower(stem) LIKE '%\_seg' ESCAPE '\' AS is_mask,
  name[1] <> '.' AND ext IN ('.tif', '.tiff', '.nii', '.nii.gz') AS ok FROM p1)"""


@query("q_scan_filter", f"WITH {_PARTS} SELECT path, name, length FROM p2 WHERE ok")
def q_scan_filter(fx):
    return ct.scan_filter(fx.files)


@query("q_base_key", f"WITH {_PARTS} SELECT path, dir, stem, ext, base, is_mask FROM p2")
def q_base_key(fx):
    return ct.with_path_parts(fx.files).drop("length")


@query(
    "q_pair_inner",
    f"""WITH {_PARTS} SELECT i.dir, i.base, i.ext, i.path AS image, m.path AS mask FROM p2 i JOIN p2 m
ON i.dir = m.dir AND i.base = m.base AND i.ext = m.ext WHERE i.ok AND m.ok AND NOT i.is_mask AND m.is_mask""",
)
def q_pair_inner(fx):
    return ct.pair_images(fx.files)[0]


@query(
    "q_pair_unpaired",
    f"""WITH {_PARTS} SELECT i.dir, i.base, i.ext, i.path AS image FROM p2 i WHERE i.ok AND NOT i.is_mask AND NOT EXISTS
(SELECT 1 FROM p2 m WHERE i.dir = m.dir AND i.base = m.base AND i.ext = m.ext AND m.ok AND m.is_mask)""",
)
def q_pair_unpaired(fx):
    return ct.pair_images(fx.files)[1]


@query(
    "q_pair_fallback",
    f"""WITH {_PARTS}, m AS (SELECT * FROM p2),
c AS (SELECT i.path AS image, (SELECT min(path) FROM m WHERE m.is_mask AND m.dir = i.dir AND m.base = i.stem) AS m1,
  (SELECT min(path) FROM m WHERE NOT m.is_mask AND m.dir = i.dir AND m.name = i.name) AS m2 FROM p2 i WHERE ok AND NOT is_mask)
SELECT image, coalesce(m1, m2) AS mask, CASE WHEN m1 IS NOT NULL THEN 'stem' ELSE 'name' END AS matched_by FROM c WHERE coalesce(m1, m2) IS NOT NULL""",
)
def q_pair_fallback(fx):
    parts = ct.with_path_parts(fx.files)
    images = ct.scan_filter(fx.files).join(parts.filter("is_mask").select("path"), "path", "left_anti").select("path")
    return ct.pair_any_extension(images, parts.select("path"))


@query(
    "q_pair_intersect",
    f"""WITH {_PARTS}, k AS (SELECT dir, base FROM p2 WHERE NOT is_mask INTERSECT SELECT dir, base FROM p2 WHERE is_mask)
SELECT dir, base, min(path) FILTER (NOT is_mask) AS image, min(path) FILTER (is_mask) AS label FROM p2 JOIN k USING (dir, base) GROUP BY ALL""",
)
def q_pair_intersect(fx):
    return ct.pair_by_intersection(fx.files)


@query("q_chunk_roundtrip", "SELECT volume_id, z, y, x, v FROM fx_dense")
def q_chunk_roundtrip(fx):
    return vo.from_chunks(vo.to_chunks(fx.dense, fx.volumes, (4, 5, 8)))


@query(
    "q_chunk_facts",
    """SELECT volume_id, CAST(z // 4 AS INT) AS cz, CAST(y // 5 AS INT) AS cy, CAST(x // 8 AS INT) AS cx,
CAST(count(*) AS INT) AS cells, sum(v) AS total FROM fx_dense GROUP BY ALL""",
)
def q_chunk_facts(fx):
    chunks = vo.to_chunks(fx.dense, fx.volumes, (4, 5, 8))
    total = F.aggregate("data", F.lit(0.0), lambda a, b: a + b.cast("double"))
    return chunks.select("volume_id", "cz", "cy", "cx", F.size("data").alias("cells"), total.alias("total"))


@query(
    "q_volume_meta",
    """SELECT volume_id, max(z) + 1 AS nz, max(y) + 1 AS ny, max(x) + 1 AS nx, count(*) AS voxels, min(v) AS vmin, max(v) AS vmax
FROM fx_voxels GROUP BY volume_id""",
)
def q_volume_meta(fx):
    return vo.volume_facts(fx.sparse)


@query(
    "q_runs",
    """WITH i AS (SELECT volume_id, z, y, x, label, x - row_number() OVER (PARTITION BY volume_id, z, y, label ORDER BY x) AS g FROM fx_class_gt)
SELECT volume_id, z, y, label, min(x) AS x0, max(x) AS x1 FROM i GROUP BY volume_id, z, y, label, g""",
)
def q_runs(fx):
    return vo.to_runs(fx.class_gt)


@query(
    "q_channel_names",
    """WITH c AS (SELECT p_partkey, p_size % 4 AS index, CASE WHEN p_size % 3 = 0 THEN CAST(p_size % 4 AS VARCHAR) ELSE p_type END AS channel FROM part)
SELECT concat('img_', p_partkey) AS stem, index, channel, concat('img_', p_partkey, '_',
  regexp_replace(CASE WHEN channel = CAST(index AS VARCHAR) THEN concat('C', index) ELSE channel END, '[^A-Za-z0-9_-]', '_', 'g'), '.tiff') AS file FROM c""",
)
def q_channel_names(fx):
    index = F.col("p_size") % 4
    rows = fx.table("part").select(
        F.concat(F.lit("img_"), F.col("p_partkey").cast("string")).alias("stem"),
        index.alias("index"),
        F.when(F.col("p_size") % 3 == 0, index.cast("string")).otherwise(F.col("p_type")).alias("channel"),
    )
    return ct.channel_files(rows)


@query(
    "q_slice_names",
    """SELECT volume_id, CAST(r.z AS INT) AS z, concat('vol_', volume_id, '_z', r.z, '.tiff') AS image, concat('vol_', volume_id, '_z', r.z, '_seg.tiff') AS mask,
lpad(CAST(r.z AS VARCHAR), length(CAST(nz - 1 AS VARCHAR))::INT, '0') AS frame FROM fx_volumes, range(7) r(z)""",
)
def q_slice_names(fx):
    return ct.slice_files(fx.volumes, F.concat(F.lit("vol_"), F.col("volume_id").cast("string")))


_EXISTING = "ex AS (SELECT concat(source, '_', printf('%03d', doc_id % 50), '_000', doc_id % 3, '.tiff') AS name FROM documents)"
_CASES = f"""{_EXISTING}, cs AS (SELECT regexp_extract(name, '^(.+)_(\\d+)_000(\\d+)\\.', 1) AS set,
  CAST(regexp_extract(name, '^(.+)_(\\d+)_000(\\d+)\\.', 2) AS BIGINT) AS c, CAST(regexp_extract(name, '^(.+)_(\\d+)_000(\\d+)\\.', 3) AS BIGINT) AS channel FROM ex)"""


def _existing(fx):
    docs = fx.table("documents")
    return docs.select(F.format_string("%s_%03d_000%d.tiff", "source", F.col("doc_id") % 50, F.col("doc_id") % 3).alias("name"))


@query(
    "q_case_numbering",
    f"""WITH {_PARTS}, {_CASES}, l AS (SELECT set, max(c) AS m FROM cs GROUP BY set),
f AS (SELECT dir AS set, path, row_number() OVER (PARTITION BY dir ORDER BY path) AS rn FROM p2 WHERE ok AND NOT is_mask),
n AS (SELECT set, path, coalesce(m + 1, 0) + rn - 1 AS "case" FROM f LEFT JOIN l USING (set))
SELECT set, path, "case", concat(set, '_', printf('%03d', "case"), '_0000.tiff') AS new_name FROM n""",
)
def q_case_numbering(fx):
    parts = ct.with_path_parts(ct.scan_filter(fx.files)).filter(~F.col("is_mask"))
    return ct.number_cases(parts.select(F.col("dir").alias("set"), "path"), _existing(fx))


@query(
    "q_name_mapping",
    f"""WITH {_PARTS}, {_CASES}, l AS (SELECT set, max(c) AS m FROM cs GROUP BY set),
f AS (SELECT dir AS set, path, row_number() OVER (PARTITION BY dir ORDER BY path) AS rn FROM p2 WHERE ok AND NOT is_mask),
n AS (SELECT set, path, concat(set, '_', printf('%03d', coalesce(m + 1, 0) + rn - 1), '_0000.tiff') AS new_name FROM f LEFT JOIN l USING (set))
SELECT set, path, new_name, concat('{{"', path, '":"', new_name, '"}}') AS line FROM n""",
)
def q_name_mapping(fx):
    """By name: cases numbered after those in use, with their original names."""
    parts = ct.with_path_parts(ct.scan_filter(fx.files)).filter(~F.col("is_mask"))
    return TRANSFORMS.run("number cases", parts.select(F.col("dir").alias("set"), "path"), _existing(fx))


@query(
    "q_manifest",
    f"""WITH {_CASES}, g AS (SELECT set, count(DISTINCT c) AS cases, max(channel) AS last FROM cs GROUP BY set)
SELECT set, cases, last + 1 AS channels, concat('{{"channel_names":{{', array_to_string(list_transform(range(0, last + 1), lambda i: concat('"Channel ', i, '":"', i, '"')), ','),
  '}},"labels":{{"background":0,"foreground":1}},"cases":', cases, ',"file_ending":".tiff"}}') AS manifest FROM g""",
)
def q_manifest(fx):
    return ct.manifest(_existing(fx))


@query("q_next_dataset", "SELECT coalesce(max(doc_id % 900), 0) + 1 AS next_id FROM documents WHERE doc_id % 5 <> 0")
def q_next_dataset(fx):
    number = F.format_string("%03d", F.col("doc_id") % 900)
    prefix = F.when(F.col("doc_id") % 5 == 0, "Old").otherwise("Dataset")
    return ct.next_dataset_id(fx.table("documents").select(F.concat(prefix, number, F.lit("_"), "source").alias("name")))


_RUN_PATHS = """rp AS (SELECT concat('/data/Dataset', printf('%03d', doc_id % 1000), '_', source, '/Trainer', lang, '__plans__',
  CASE WHEN doc_id % 2 = 0 THEN '2d' ELSE '3d_fullres' END, '/fold_', doc_id % 5, '/checkpoint.pth') AS path, * FROM documents)"""


@query(
    "q_path_attrs",
    f"""WITH {_RUN_PATHS} SELECT path, printf('%03d', doc_id % 1000) AS dataset_id, source AS dataset_name, concat('Trainer', lang) AS trainer,
CASE WHEN doc_id % 2 = 0 THEN '2d' ELSE '3d_fullres' END AS config, CAST(doc_id % 5 AS VARCHAR) AS fold FROM rp""",
)
def q_path_attrs(fx):
    config = F.when(F.col("doc_id") % 2 == 0, "2d").otherwise("3d_fullres")
    path = F.format_string(
        "/data/Dataset%03d_%s/Trainer%s__plans__%s/fold_%d/checkpoint.pth",
        F.col("doc_id") % 1000, F.col("source"), F.col("lang"), config, F.col("doc_id") % 5,
    )
    return ct.path_attributes(fx.table("documents").select(path.alias("path")))


@query(
    "q_subject_catalog",
    """SELECT concat('/bids/sub-', c_custkey, '_ses-', c_nationkey, '_', CASE WHEN c_custkey % 3 = 0 THEN 'T2w' ELSE 'T1w' END, '.nii.gz') AS path,
CAST(c_custkey AS VARCHAR) AS subject, CAST(c_nationkey AS VARCHAR) AS session, CASE WHEN c_custkey % 3 = 0 THEN 'T2w' ELSE 'T1w' END AS suffix,
concat('sub-', c_custkey, '_ses-', c_nationkey) AS stem, concat('/out/sub-', c_custkey, '/ses-', c_nationkey, '/anat') AS out_dir,
CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS quality FROM customer""",
)
def q_subject_catalog(fx):
    rows = fx.table("customer").select(
        F.format_string(
            "/bids/sub-%d_ses-%d_%s.nii.gz", "c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 == 0, "T2w").otherwise("T1w")
        ).alias("path"),
        F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("QI is "), F.col("c_acctbal").cast("string"), F.lit(" of all")))
        .otherwise("no value")
        .alias("quality_text"),
    )
    return ct.subject_catalog(rows, "/out")


@query(
    "q_sidecar",
    f"""WITH {_PARTS} SELECT m.path, concat('{{"Sources":["bids:raw:', i.path, '","bids:raw:', m.path, '"],"SpatialReference":"bids:raw:', i.path, '","SkullStripped":', CASE WHEN m.length % 3 = 0 THEN 'false' ELSE 'true' END,
  CASE WHEN m.length % 2 = 1 THEN concat(',"QI":{{"value":', m.length, '.0,"description":"{ct.QUALITY_TEXT}"}}') ELSE '' END, ',"Type":"Brain"}}') AS sidecar
FROM p2 i JOIN p2 m ON i.dir = m.dir AND i.base = m.base AND i.ext = m.ext WHERE i.ok AND m.ok AND NOT i.is_mask AND m.is_mask""",
)
def q_sidecar(fx):
    pairs = ct.pair_images(fx.files)[0].select(F.col("mask").alias("path"), F.col("image").alias("source"))
    rows = pairs.join(fx.files, "path")
    length = F.col("length")
    return ct.sidecars(rows, F.when(length % 2 == 1, length), F.array("source", "path"), length % 3 != 0, F.lit("Brain"))


@query(
    "q_label_placement",
    f"""WITH {_PARTS}, l AS (SELECT concat(source, '/vol_', lpad(CAST(doc_id AS VARCHAR), 6, '0'), '.tif') AS path, source AS dir,
  concat('vol_', lpad(CAST(doc_id AS VARCHAR), 6, '0')) AS stem FROM documents),
s AS (SELECT l.path, concat(l.dir, '/', l.stem, '_seg.tif') AS target, EXISTS (SELECT 1 FROM p2 d WHERE d.dir = l.dir AND d.stem = l.stem AND NOT d.is_mask) AS known FROM l),
t AS (SELECT *, EXISTS (SELECT 1 FROM fx_files f WHERE f.path = s.target) AS taken FROM s)
SELECT path, CASE WHEN known THEN target END AS target, CASE WHEN NOT known THEN 'skip' WHEN taken THEN 'conflict' ELSE 'move' END AS status FROM t""",
)
def q_label_placement(fx):
    name = F.concat("source", F.lit("/vol_"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(".tif"))
    labels = fx.table("documents").select(name.alias("path"))
    data = ct.with_path_parts(fx.files).filter("not is_mask").select("path")
    return ct.place_labels(labels, data, fx.files)


@query(
    "q_scores_pivot",
    f"""WITH {_DICE} SELECT row_number() OVER (ORDER BY volume_id) - 1 AS sample_index, max(round(dice, 6)) FILTER (model = 'model_a') AS model_a,
max(round(dice, 6)) FILTER (model = 'model_b') AS model_b, max(round(dice, 6)) FILTER (model = 'model_c') AS model_c FROM s GROUP BY volume_id""",
)
def q_scores_pivot(fx):
    return sinks.score_table(_dice(fx).withColumn("dice", F.round("dice", 6)), "dice", MODELS)


@query(
    "q_unique_names",
    """WITH f AS (SELECT concat('/pred/', lang, '/', source, '/run', doc_id % 13) AS path, min(doc_id) AS seq FROM documents GROUP BY 1),
b AS (SELECT path, seq, regexp_extract(path, '[^/]*$') AS base FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY seq) - 1 AS i FROM b)
SELECT path, seq, CASE WHEN i = 0 THEN base ELSE concat(base, ' (', i, ')') END AS display_name FROM r""",
)
def q_unique_names(fx):
    rows = fx.table("documents").select(
        F.format_string("/pred/%s/%s/run%d", "lang", "source", F.col("doc_id") % 13).alias("path"), F.col("doc_id").alias("seq")
    )
    return ct.unique_names(rows)
