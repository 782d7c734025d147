"""Quality rules: statistics of each text, and the lines that a host repeats across its documents.

Lines are normalised (lower case, digits as one digit, white space as one space) and hashed; for each host the distinct
documents that hold a line are counted. A line above the host's limit is taken out, and a document that loses too large a
part of its words is rejected. The limit is a share of the host's documents, ``min_docs`` at least, so it means the same at
every size. Documents with equal texts count once: copies don't make a host's lines frequent.

Counting is a distinct count in two shuffles of hashes, combined before each; a line that a third of all documents hold is
one counter a task. The frequent lines come back by a join on a struct key, which adaptive execution splits where one line
is hot, or broadcasts on its measured size.

Defined results: a null or empty text has no words and fails; a null host is a host of its own; rows that are equal in id,
host and text have one verdict each; rows with equal or null ids are judged each by its own text; lines without a word are
never counted; a text of any length is read whole, one text at a time; an empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import cut_lineage
from voxlake.operators.joins import fact_join

#: The symbols that count, and the white space that parts words.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list, window: int = 3) -> int:
    """Words inside windows of ``window`` words that the text holds twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    code = ids[:n]
    for k in range(1, window):
        # Codes stay below n, so a code and a word's number fit in 64 bits.
        code = np.unique(code * len(numbers) + ids[k : k + n], return_inverse=True)[1]
    again = np.bincount(code)[code] > 1
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : k + n] |= again
    return int(covered.sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """``STATS`` of one text."""
    if not text:
        return (0,) * len(STATS)
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


def with_stats(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with the columns of ``STATS`` instead of the text; the others must be plain columns."""
    kept = [c for c in rows.columns if c != text_col]
    schema = F.struct(*kept, *(F.lit(0).cast("bigint").alias(s) for s in STATS))
    schema = rows.select(schema.alias("s")).schema["s"].dataType

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(0, part.num_rows, 256):
                piece = part.slice(i, 256)
                stats = [text_stats(t.as_py()) for t in piece.column(text_col)]
                cols = [piece.column(c) for c in kept] + [pa.array(c, pa.int64()) for c in zip(*stats, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, *STATS])

    return rows.mapInArrow(run, schema)


def normalised_lines(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` without the text, once for each line that holds a word: its place, its words and a hash of 128 bits."""
    kept = [c for c in rows.columns if c != text_col]
    lines = rows.select(*kept, F.posexplode(F.split(text_col, "\n", -1)).alias("place", "line"))
    plain = F.trim(F.regexp_replace(F.translate(F.lower("line"), "123456789", "000000000"), "[ \t\r\x0b\x0c]+", " "))
    lines = lines.select(*kept, "place", plain.alias("line")).filter("line <> ''")
    words = F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    return lines.select(*kept, "place", words.cast("bigint").alias("words"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))


def frequent_lines(texts: DataFrame, min_docs: int, share: float) -> DataFrame:
    """(host, h1, h2, docs) of the lines in at least ``min_docs`` and ``share`` of the host's distinct texts.

    ``texts`` has host, t1 and t2 (a hash of the text) and text.
    """
    lines = normalised_lines(texts, "text").groupBy("host", "h1", "h2").agg(F.countDistinct("t1", "t2").alias("docs")).filter(F.col("docs") >= min_docs)
    hosts = texts.filter("text is not null").groupBy("host").agg(F.countDistinct("t1", "t2").alias("host_docs"))
    return fact_join(lines, hosts, ["host"]).filter(F.col("docs") >= share * F.col("host_docs")).select("host", "h1", "h2", "docs")


def judge(
    docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", min_docs: int = 10, share: float = 0.01,
    min_words: int = 50, repeated_percent: int = 50, least_left: float = 0.5,
) -> DataFrame:
    """(doc_id, host, t1, t2, statistics, base_failed, n_frequent_lines, n_words_removed, gone, kept) for each row of ``docs``.

    ``gone`` has the places of the lines to take out (null if there are none); t1 and t2 hash the text. ``base_failed``: fewer
    than ``min_words`` words, or more than ``repeated_percent`` of them in repeated windows. A document is depleted, and not
    kept, if less than ``least_left`` of its words stays.
    """
    texts = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit("second"), text_col).alias("t2"), F.col(text_col).alias("text")
    )
    frequent = cut_lineage(frequent_lines(texts.drop("doc_id"), min_docs, share))
    row = ["doc_id", "host", "t1", "t2"]
    hits = fact_join(normalised_lines(texts, "text"), frequent.drop("docs"), ["host", "h1", "h2"])
    # Equal rows give equal lines, which the set holds once.
    gone = hits.groupBy(*row).agg(F.array_sort(F.collect_set(F.struct("place", "words"))).alias("lines"))
    gone = gone.select(*row, F.col("lines.place").alias("gone"), F.aggregate("lines.words", F.lit(0).cast("bigint"), lambda a, w: a + w).alias("lost"))
    judged = fact_join(with_stats(texts, "text"), gone, row, "left")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeated_percent)
    lost = F.coalesce("lost", F.lit(0).cast("bigint"))
    return judged.select(
        *row, *STATS, failed.alias("base_failed"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_frequent_lines"), lost.alias("n_words_removed"), "gone",
        (~failed & (F.col("n_words") - lost >= F.col("n_words") * least_left)).alias("kept"),
    )


def clean(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, their texts without the frequent lines."""
    verdicts = judge(docs, id_col, host_col, text_col, **limits).filter("kept").select("doc_id", "host", "t1", "t2", "gone").distinct()
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit("second"), text_col).alias("t2"))
    rows = fact_join(whole, verdicts, ["doc_id", "host", "t1", "t2"]).withColumn("lines", F.split(F.col(f"row.`{text_col}`"), "\n", -1))
    new = F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\\n')")
    own = lambda c: F.col(f"row.`{c}`")
    return rows.select(*(F.when(F.col("gone").isNull(), own(c)).otherwise(new).alias(c) if c == text_col else own(c).alias(c) for c in docs.columns))
