"""Voxel, mask, catalogue and event views over the driver tables.

``FX_SQL`` holds the views as DuckDB text for the SQL twins; ``Fixtures`` builds the same rows
with DataFrames. Volumes are 7 x 12 x 12; only their number grows with the data.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.operators.joins import densify
from voxlake.operators.score import model_pairs
from voxlake.session import parts_for

NZ, NY, NX = 7, 12, 12

FX_SQL = {
    "fx_voxels": """
SELECT l_suppkey AS volume_id, CAST(l_linenumber - 1 AS INT) AS z,
       CAST(l_partkey % 12 AS INT) AS y, CAST(l_orderkey % 12 AS INT) AS x,
       MAX(l_quantity) AS v, MAX(l_discount) AS d, MAX(l_tax) AS t,
       MIN(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) AS cls
FROM lineitem
GROUP BY l_suppkey, CAST(l_linenumber - 1 AS INT), CAST(l_partkey % 12 AS INT), CAST(l_orderkey % 12 AS INT)""",
    "fx_volumes": """
SELECT DISTINCT l_suppkey AS volume_id, 7 AS nz, 12 AS ny, 12 AS nx,
       CAST(3.0 AS DOUBLE) AS spacing_z, CAST(1.5 AS DOUBLE) AS spacing_y, CAST(1.5 AS DOUBLE) AS spacing_x
FROM lineitem""",
    "fx_dense": """
SELECT g.volume_id, CAST(g.z AS INT) AS z, CAST(g.y AS INT) AS y, CAST(g.x AS INT) AS x,
       COALESCE(s.v, CAST(0.0 AS DOUBLE)) AS v
FROM (SELECT volume_id, tz.z, ty.y, tx.x
      FROM fx_volumes CROSS JOIN range(7) AS tz(z) CROSS JOIN range(12) AS ty(y) CROSS JOIN range(12) AS tx(x)) g
LEFT JOIN fx_voxels s ON g.volume_id = s.volume_id AND g.z = s.z AND g.y = s.y AND g.x = s.x""",
    "fx_gt": "SELECT volume_id, z, y, x, 1 AS label FROM fx_voxels WHERE v > 44",
    "fx_pred": """
SELECT 'model_a' AS model, volume_id, z, y, x, 1 AS label FROM fx_voxels WHERE v > 42 AND d < 0.09
UNION ALL
SELECT 'model_b' AS model, volume_id, z, y, x, 1 AS label FROM fx_voxels WHERE v > 41 AND t > 0.01
UNION ALL
SELECT 'model_c' AS model, volume_id, z, y, x, 1 AS label FROM fx_voxels WHERE v > 44 AND volume_id % 10 <> 3""",
    "fx_class_gt": "SELECT volume_id, z, y, x, cls AS label FROM fx_voxels WHERE v > 30",
    "fx_class_pred": """
SELECT volume_id, z, y, x, CASE WHEN d < 0.08 THEN cls ELSE 1 + cls % 3 END AS label FROM fx_voxels WHERE v > 28""",
    "fx_logits": "SELECT volume_id, z, y, x, v / 10.0 - 3.0 AS logit FROM fx_dense",
    "fx_files": """
SELECT CONCAT(source, '/', CASE WHEN doc_id % 97 = 96 THEN '.' ELSE '' END, 'vol_', LPAD(CAST(doc_id AS STRING), 6, '0'),
              CASE doc_id % 4 WHEN 0 THEN '.tif' WHEN 1 THEN '.tiff' WHEN 2 THEN '.nii.gz' ELSE '.nii' END) AS path,
       n_chars AS length
FROM documents
UNION ALL
SELECT CONCAT(s.source, '/', 'vol_', LPAD(CAST(l.doc_id AS STRING), 6, '0'), '_seg',
              CASE WHEN l.doc_id % 10 = 0 THEN '.png'
                   ELSE CASE l.doc_id % 4 WHEN 0 THEN '.tif' WHEN 1 THEN '.tiff' WHEN 2 THEN '.nii.gz' ELSE '.nii' END END) AS path,
       CAST(100 + l.quality AS BIGINT) AS length
FROM labels l JOIN documents s ON l.doc_id = s.doc_id""",
    "fx_prompts": """
SELECT event_id AS seq, ts, user_id AS volume_id,
       CASE WHEN event_id % 50 = 0 THEN 'reset_all' WHEN event_type = 'error' THEN 'reset_object'
            WHEN event_type = 'view' THEN 'propagate' WHEN event_type = 'purchase' THEN 'box' ELSE 'click' END AS op,
       CAST(1 + event_id % 5 AS INT) AS obj_id, CAST(event_id % 7 AS INT) AS z,
       CAST(FLOOR(value) AS INT) % 12 AS y, CAST(REGEXP_EXTRACT(props, '([0-9]+)', 1) AS INT) % 12 AS x,
       value - FLOOR(value) AS prob
FROM events""",
    "fx_counts": """
SELECT CONCAT('vol_', LPAD(CAST(volume_id AS STRING), 6, '0'), '.tiff') AS file, CAST(COUNT(*) AS DOUBLE) AS counts
FROM fx_voxels WHERE v > 46 GROUP BY volume_id""",
    "fx_session": """
SELECT conv_id AS session_id, turn AS position,
       CONCAT('s', CAST(conv_id AS STRING), '/img_', CAST(turn AS STRING), '.tiff') AS path
FROM conversations""",
    "fx_pairs": """
SELECT m.model, v.volume_id FROM fx_volumes v, (VALUES ('model_a'), ('model_b'), ('model_c')) m(model)""",
}


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def parts(self) -> int:
        """Partitions for the voxels and what is made of them, by the table's size."""
        return parts_for(self.spark, self.table("lineitem").count())

    @cached_property
    def voxels(self) -> DataFrame:
        flag = F.col("l_returnflag")
        return (
            self.table("lineitem")
            .select(
                F.col("l_suppkey").alias("volume_id"),
                (F.col("l_linenumber") - 1).cast("int").alias("z"),
                (F.col("l_partkey") % 12).cast("int").alias("y"),
                (F.col("l_orderkey") % 12).cast("int").alias("x"),
                "l_quantity",
                "l_discount",
                "l_tax",
                F.when(flag == "A", 1).when(flag == "N", 2).otherwise(3).alias("c"),
            )
            .repartition(self.parts, "volume_id", "z", "y", "x")
            .groupBy("volume_id", "z", "y", "x")
            .agg(
                F.max("l_quantity").alias("v"),
                F.max("l_discount").alias("d"),
                F.max("l_tax").alias("t"),
                F.min("c").alias("cls"),
            )
        )

    @cached_property
    def volumes(self) -> DataFrame:
        return (
            self.table("lineitem")
            .select(F.col("l_suppkey").alias("volume_id"))
            .distinct()
            .select(
                "volume_id",
                F.lit(NZ).alias("nz"),
                F.lit(NY).alias("ny"),
                F.lit(NX).alias("nx"),
                F.lit(3.0).alias("spacing_z"),
                F.lit(1.5).alias("spacing_y"),
                F.lit(1.5).alias("spacing_x"),
            )
        )

    @cached_property
    def sparse(self) -> DataFrame:
        return self.voxels.select("volume_id", "z", "y", "x", "v")

    @cached_property
    def dense(self) -> DataFrame:
        return densify(self.sparse, self.volumes, fill={"v": 0.0})

    @cached_property
    def gt(self) -> DataFrame:
        return self.voxels.filter("v > 44").select("volume_id", "z", "y", "x", F.lit(1).alias("label"))

    @cached_property
    def pred(self) -> DataFrame:
        """All models in one pass over the voxels; the model is a column, not a union of scans."""
        hits = F.array_compact(
            F.array(
                F.when((F.col("v") > 42) & (F.col("d") < 0.09), F.lit("model_a")),
                F.when((F.col("v") > 41) & (F.col("t") > 0.01), F.lit("model_b")),
                F.when((F.col("v") > 44) & (F.col("volume_id") % 10 != 3), F.lit("model_c")),
            )
        )
        return self.voxels.filter("v > 41").select(
            F.explode(hits).alias("model"), "volume_id", "z", "y", "x", F.lit(1).alias("label")
        )

    @cached_property
    def pairs(self) -> DataFrame:
        return model_pairs(self.volumes, ("model_a", "model_b", "model_c"))

    @cached_property
    def class_gt(self) -> DataFrame:
        return self.voxels.filter("v > 30").select("volume_id", "z", "y", "x", F.col("cls").alias("label"))

    @cached_property
    def class_pred(self) -> DataFrame:
        label = F.when(F.col("d") < 0.08, F.col("cls")).otherwise(1 + F.col("cls") % 3)
        return self.voxels.filter("v > 28").select("volume_id", "z", "y", "x", label.alias("label"))

    @cached_property
    def logits(self) -> DataFrame:
        return self.dense.select("volume_id", "z", "y", "x", (F.col("v") / 10.0 - 3.0).alias("logit"))

    @cached_property
    def files(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", "source", "n_chars")
        kind = F.col("doc_id") % 4
        ext = F.when(kind == 0, ".tif").when(kind == 1, ".tiff").when(kind == 2, ".nii.gz").otherwise(".nii")
        stem = F.concat(F.lit("vol_"), F.lpad(F.col("doc_id").cast("string"), 6, "0"))
        images = docs.select(
            F.concat("source", F.lit("/"), F.when(F.col("doc_id") % 97 == 96, ".").otherwise(""), stem, ext).alias("path"),
            F.col("n_chars").alias("length"),
        )
        mask_ext = F.when(F.col("doc_id") % 10 == 0, ".png").otherwise(ext)
        masks = (
            self.table("labels")
            .select("doc_id", "quality")
            .join(docs.select("doc_id", "source"), "doc_id")
            .select(
                F.concat("source", F.lit("/"), stem, F.lit("_seg"), mask_ext).alias("path"),
                (100 + F.col("quality")).cast("bigint").alias("length"),
            )
        )
        return images.unionByName(masks)

    @cached_property
    def prompts(self) -> DataFrame:
        event = F.col("event_type")
        return self.table("events").select(
            F.col("event_id").alias("seq"),
            "ts",
            F.col("user_id").alias("volume_id"),
            F.when(F.col("event_id") % 50 == 0, "reset_all")
            .when(event == "error", "reset_object")
            .when(event == "view", "propagate")
            .when(event == "purchase", "box")
            .otherwise("click")
            .alias("op"),
            (1 + F.col("event_id") % 5).cast("int").alias("obj_id"),
            (F.col("event_id") % 7).cast("int").alias("z"),
            (F.floor("value").cast("int") % 12).alias("y"),
            (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 12).alias("x"),
            (F.col("value") - F.floor("value")).alias("prob"),
        )

    @cached_property
    def counts(self) -> DataFrame:
        name = F.concat(F.lit("vol_"), F.lpad(F.col("volume_id").cast("string"), 6, "0"), F.lit(".tiff"))
        return (
            self.voxels.filter("v > 46")
            .groupBy("volume_id")
            .agg(F.count("*").cast("double").alias("counts"))
            .select(name.alias("file"), "counts")
        )

    @cached_property
    def session(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").alias("session_id"),
            F.col("turn").alias("position"),
            F.concat(F.lit("s"), F.col("conv_id").cast("string"), F.lit("/img_"), F.col("turn").cast("string"), F.lit(".tiff")).alias("path"),
        )
