"""Line dedup by winnowing over line hashes, in DataFrame operations only.

Each window of ``lines`` lines gives its smallest line hash as a fingerprint, so every run of that many lines holds one. Only
fingerprints that occur again are followed up: from their positions the match is extended both ways, to the windows of
``lines`` lines around the position that select it. A window that occurred earlier (smaller document id, then earlier in the document) is a
repeat, overlapping repeats join into runs, and the lines of the later runs are deleted. A line of at least ``long_words``
words is a window of its own.

Windows are compared with the first one of their kind, never with each other, so groups of copies make no pairs; hashes
have 128 bits.

Defined results: blank lines are not compared and stay; a null text stays null and has no lines; rows with equal ids are
ordered by a hash of their text, and rows that are equal in both are one document with one result each; a null id counts as
smaller than any other; a text of any length is split whole, a row a line; an empty table gives no rows; extra columns come
back as they were, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.common import cut_lineage

LEAST = -(1 << 63)


def line_windows(docs: DataFrame, lines: int, long_words: int) -> DataFrame:
    """One row for each window: its lines' places, a hash of 128 bits, and the fingerprint it selects.

    ``fresh`` marks one of the windows that share a fingerprint at the same place. Sorting runs inside one document.
    """
    line = docs.select("k1", "k2", F.posexplode(F.split("text", "\n", -1)).alias("place", "line")).filter(F.regexp_replace("line", "[ \t\r]", "") != "")
    words = F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    unit = line.select("k1", "k2", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), (words >= long_words).alias("long"))
    # Rows that are equal in id and text would mix their lines: one of them stands for all.
    unit = unit.repartition("k1", "k2").dropDuplicates(["k1", "k2", "place"])
    order = Window.partitionBy("k1", "k2").orderBy("place")
    ahead = lambda c: [F.lead(c, i).over(order) if i else F.col(c) for i in range(lines)]
    # The rightmost of the smallest line hashes in the window.
    low = F.min(F.struct("h1", (-F.col("place")).alias("at"))).over(order.rowsBetween(0, lines - 1))
    runs = unit.select("k1", "k2", F.col("place").alias("first"), F.xxhash64(*ahead("h1")).alias("w1"), F.xxhash64(*ahead("h2")).alias("w2"), F.array(*ahead("place")).alias("places"), low.alias("low"),
                       F.lead("place", lines - 1).over(order).isNotNull().alias("whole") if lines > 1 else F.lit(True).alias("whole")).filter("whole")
    before = F.lag("low").over(Window.partitionBy("k1", "k2").orderBy("first"))
    runs = runs.select("k1", "k2", "first", F.lit(lines).alias("len"), "w1", "w2", "places", F.col("low.h1").alias("print"), (before.isNull() | (before != F.col("low"))).alias("fresh"))
    long = unit.filter("long").select("k1", "k2", F.col("place").alias("first"), F.lit(0).alias("len"), F.xxhash64("h1").alias("w1"), F.xxhash64("h2").alias("w2"), F.array("place").alias("places"), F.col("h1").alias("print"), F.lit(True).alias("fresh"))
    return runs.unionByName(long)


def repeated_lines(docs: DataFrame, lines: int = 2, long_words: int = 50) -> DataFrame:
    """(k1, k2, gone): for each document with repeats, the places of the lines to delete. ``docs`` has k1, k2, text."""
    windows = line_windows(docs, lines, long_words)
    again = cut_lineage(windows.filter("fresh").groupBy("print", "len").count().filter("count > 1").select("print", "len"))
    # The positions of fingerprints that occur again, each extended to the lines of the windows around it.
    hits = cut_lineage(windows.join(again, ["print", "len"], "left_semi").select("k1", "k2", "first", "len", "w1", "w2", "places"))
    firsts = hits.groupBy("w1", "w2", "len").agg(F.min(F.struct("k1", "k2", "first")).alias("origin"), F.count("*").alias("times"))
    firsts = cut_lineage(firsts.filter("times > 1").select("w1", "w2", "len", "origin"))
    later = hits.join(firsts, ["w1", "w2", "len"]).filter(F.struct("k1", "k2", "first") > F.col("origin"))
    return later.select("k1", "k2", F.explode("places").alias("place")).groupBy("k1", "k2").agg(F.collect_set("place").alias("gone"))


def dedup_lines(docs: DataFrame, lines: int = 2, long_words: int = 50, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """All columns of ``docs`` with the text without later repeated runs; with ``counts`` also ``_n_lines`` and ``_n_removed``."""
    key = [F.coalesce(F.col(id_col).cast("bigint"), F.lit(LEAST)).alias("k1"), F.xxhash64(text_col).alias("k2")]
    gone = cut_lineage(repeated_lines(docs.select(*key, F.col(text_col).alias("text")), lines, long_words))
    # The same plan at every size: the texts are dealt by key once. The row is one struct, so no name of its columns clashes.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *key).join(gone.hint("merge"), ["k1", "k2"], "left")
    own = lambda c: F.col(f"row.`{c}`")
    rows = rows.withColumn("lines", F.split(own(text_col), "\n", -1))
    new = F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\\n')")
    more = [F.when(own(text_col).isNull(), 0).otherwise(F.size("lines")).cast("bigint").alias("_n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("_n_removed")]
    text = F.when(F.col("gone").isNull() | own(text_col).isNull(), own(text_col)).otherwise(new)
    return rows.select(*(text.alias(c) if c == text_col else own(c).alias(c) for c in docs.columns), *(more if counts else []))
