"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A mask is laid on every position of a text; the words under its ones are hashed and those under its zeros ignored. Test and
training hashes are joined; what is left of the hits are the distinct alignments of a document with an item, without any
words. These are written, and only for them the passages are compared word by word at that alignment. A document holds an
item if some ``WINDOW`` consecutive words of the item (all of a shorter one) differ from it in at most ``allowed`` words.

The mask 11011 meets every such overlap: in 16 words with 3 substitutions, or in 12 with 2 or 7 with 1, there is always a
place where the mask's ones fall on equal words. The longer mask adds seeds of more words around two substitutions.

Items with equal words are one item, listed under the smallest id (null only without any other). The items' hashes are broadcast while their number is
under a bound that is checked; beyond it the join shuffles.

Defined results: words are runs of letters and digits, in any case; items and documents with fewer than five words (or null)
are never matched; rows with equal document ids are one document; texts of any length are searched whole, and a text of one
word over and over gives at most as many alignments as it has words; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import cut_lineage

MASKS = ("11011", "11010011")
WINDOW = 16
#: Of 16 bytes each; more are joined by a shuffle.
BROADCAST_SEEDS = 1_000_000
#: Alignments, of some 100 bytes each.
BROADCAST_HITS = 200_000


def allowed(words: int) -> int:
    """Substitutions in an overlap of so many words."""
    return 3 if words >= 16 else 2 if words >= 12 else 1 if words >= 7 else 0


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(rows: DataFrame) -> DataFrame:
    """rows with (words, n) -> one row for each position and mask, with its hash ``seed`` and place ``at``."""
    each = rows.filter(F.col("n") >= 5).withColumn("at", F.explode(F.expr("sequence(0, n - 5)")))
    made = []
    for k, mask in enumerate(MASKS):
        under = [F.get("words", F.col("at") + i) for i, c in enumerate(mask) if c == "1"]
        made.append(F.when(F.col("at") + len(mask) <= F.col("n"), F.xxhash64(F.lit(k), *under)))
    return each.withColumn("seed", F.explode(F.array(*made))).filter("seed is not null")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, matched, of, start): the best overlap of each document with each item that it holds.

    ``matched`` of ``of`` words agree; ``start`` is the word of the document at which the item would begin (it can be
    negative if the document has only a later part of the item).
    """
    own = items.select(F.col(item_id_col).alias("item_id"), word_hashes(F.col(item_text_col)).alias("words")).filter(F.size("words") >= 5)
    own = own.groupBy("words").agg(F.min("item_id").alias("item_id")).withColumn("n", F.size("words"))
    # 128 bits of the words stand for an item, so that a null id is no matter.
    own = own.withColumns({"k1": F.xxhash64("words"), "k2": F.xxhash64(F.lit("second"), "words")})
    test = seeds(own).select("seed", "k1", "k2", F.col("at").alias("item_at"), F.col("n").alias("item_n")).distinct()
    if test.count() <= BROADCAST_SEEDS:
        test = F.broadcast(test)
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit("second"), text_col).alias("t2")).alias("doc"), word_hashes(F.col(text_col)).alias("words"))
    train = rows.withColumn("n", F.size("words"))
    hits = seeds(train).select("doc", "seed", "at").join(test, "seed")
    # Many hits of one alignment, or of equal rows, are one row before the shuffle.
    hits = cut_lineage(hits.select("doc", "k1", "k2", "item_n", (F.col("at") - F.col("item_at")).alias("start")).distinct())
    # Their documents' words are needed once more: without a shuffle while there are few alignments, else dealt by document.
    found = rows.join(F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits, "doc")
    seen = F.transform(F.expr("sequence(0, item_n - 1)"), lambda i: F.get("words", F.col("start") + i))
    hits = found.select(F.col("doc.id").alias("doc_id"), "k1", "k2", "start", seen.alias("seen"))
    both = hits.join(own.select("k1", "k2", "item_id", F.col("words").alias("item_words"), "n"), ["k1", "k2"])
    same = both.withColumn("same", F.zip_with("seen", "item_words", lambda a, b: F.when(a == b, 1).otherwise(0))).withColumn("of", F.least("n", F.lit(WINDOW)))
    best = same.withColumn("matched", F.array_max(F.transform(F.expr("sequence(0, n - of)"), lambda s: F.aggregate(F.slice("same", s + 1, F.col("of")), F.lit(0), lambda a, x: a + x))))
    few = F.when(F.col("of") >= 16, 3).when(F.col("of") >= 12, 2).when(F.col("of") >= 7, 1).otherwise(0)
    kept = best.filter(F.col("matched") + few >= F.col("of"))
    top = F.max(F.struct("matched", (-F.col("start")).alias("back"), "of"))
    return kept.groupBy("doc_id", "k1", "k2", "item_id").agg(top.alias("t")).select("doc_id", "item_id", F.col("t.matched").alias("matched"), F.col("t.of").alias("of"), (-F.col("t.back")).alias("start"))
