"""The corpus pipeline: language ID, line dedup, near-duplicate removal, benchmark decontamination, byte-level BPE.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs. All but the last return the columns they got.

Every row is decided by itself, whatever its id: stages 1 and 4 by its text, stage 3 by a number of its own (of rows with
equal texts one stays, also if their ids are equal or null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm import bpe_codec, decontaminate, language_id, line_dedup, simhash
from voxlake.llm.common import cut_lineage, table


def _row(docs: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's language is predicted by words and backoff; a row stays if it is told surely enough.

    Texts without letters go (``und``), those between languages, and those of which the model knows too little: noise and languages
    that weren't learned.
    """
    return language_id.recognised(docs, language_id.fit(docs))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go from the texts; n_chars, if there is one, follows."""
    out = line_dedup.dedup_lines(docs, counts=False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the first row stays (smallest id, null last); texts without words are copies of each other."""
    # Written once, so that each row keeps its number; the row is one struct, so no name of its columns clashes.
    rows = cut_lineage(docs.select(F.monotonically_increasing_id().alias("n"), _row(docs).alias("row")))
    found = simhash.near_duplicates(rows.select("n", F.col("row.text").alias("text")), id_col="n", unique=True).select(F.col("doc_id").alias("n"), "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "n")
    placed = cut_lineage(found.join(rows.select("n", F.col("row.doc_id").alias("doc_id")), "n").select("n", "component_id", place.alias("place")))
    first = placed.groupBy("component_id").agg(F.min("place").alias("first"))
    gone = placed.join(first, "component_id").filter("place > first").select("n")
    return rows.join(gone, "n", "left_anti").select("row.*")


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go; rows with equal texts go together."""
    # 128 bits of the text stand for it.
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("second"), "text").alias("b"))
    found = decontaminate.contaminated(docs.select(key.alias("_text"), "text"), table(spark, sf_dir, "benchmark"), id_col="_text")
    gone = found.select(F.col("doc_id").alias("key")).distinct()
    return docs.select(key.alias("key"), _row(docs).alias("row")).join(gone, "key", "left_anti").select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the SHA-256 of ids and of the decoded bytes."""
    import public_tokenizers

    ranks = bpe_codec.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe_codec.decode(bpe_codec.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", by_language),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmarks),
    ("byte_level_bpe", encoded),
]

#: Fitted models and fingerprints have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
