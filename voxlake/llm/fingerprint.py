"""Document fingerprints: a homomorphic multiset hash, in DataFrame operations only.

A paragraph (a line) is hashed into a wide vector; a document's fingerprint is the sum of its paragraphs' vectors, each lane
modulo a power of two. So the order of paragraphs plays no part, and a paragraph is inserted or deleted by adding or
subtracting its vector. The vector has two kinds of lanes:

- ``EXACT`` lanes of 32 bits, hashes of the whole paragraph: equal sums mean equal multisets of paragraphs;
- ``LIKE`` lanes of 32 bits, one bit for each clause of the paragraph: of two sums, the cosine of the lanes (as sums of +1 and
  -1) estimates how much of the multisets of clauses is shared. A clause of more than ``LONG`` words counts as its runs of
  ``RUN`` words, so that a text without any signs is made of many units too.

Lane sums are kept in 64 bits during aggregation, as many as a text can have paragraphs fit, and reduced at the end.

Defined results: a null text is an empty one (one empty paragraph); null ids count as smaller than any other; rows with
equal ids are ordered by text; a table of one row is its own next document; texts of any length are split whole; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT, LIKE = 8, 128
#: Words of a clause that is cut up, and of the runs it is cut into.
LONG, RUN = 16, 8
#: Documents with ids in the same 1,024 numbers are ordered in one task.
NEIGHBOURS = 10

_PAIR = 0x0000000100000001


def _lanes(unit: Column, whole: Column) -> list[Column]:
    """Lane sums over the units of a document; ``whole`` marks paragraphs, the other units are clauses."""
    out = []
    for i in range(EXACT // 2):
        h = F.xxhash64(F.lit(f"paragraph {i}"), unit)
        out += [F.sum(F.when(whole, part).otherwise(0)) for part in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]
    for i in range(LIKE // 64):
        h = F.xxhash64(F.lit(f"clause {i}"), unit)
        # Two bits at a time, 32 apart: both sums fit in one 64-bit lane.
        out += [F.sum(F.when(whole, 0).otherwise(F.shiftrightunsigned(h, j).bitwiseAND(_PAIR))) for j in range(32)]
    return out


def vectors(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, vector (array of lanes), clauses (their number). ``text`` is a column without nulls."""
    paragraphs = F.split(F.col(text), "\n", -1)
    runs = lambda c: F.when(F.size(F.split(c, " ")) > LONG, F.split(F.regexp_replace(c, rf"((?:[^ ]+ +){{{RUN - 1}}}[^ ]+) +", "$1\n"), "\n")).otherwise(F.array(c))
    clauses = F.filter(F.split(F.col(text), "[.,;:!?|\n]+"), lambda c: F.trim(c) != "")
    clauses = F.flatten(F.transform(clauses, lambda c: runs(F.trim(c))))
    units = F.concat(F.transform(paragraphs, lambda p: F.struct(p.alias("unit"), F.lit(True).alias("whole"))), F.transform(clauses, lambda c: F.struct(c.alias("unit"), F.lit(False).alias("whole"))))
    one = rows.select(*keys, F.explode(units).alias("u")).select(*keys, "u.unit", "u.whole")
    lanes = _lanes(F.col("unit"), F.col("whole"))
    summed = one.groupBy(*keys).agg(F.sum(F.when(F.col("whole"), 0).otherwise(1)).alias("clauses"), *(x.alias(f"l{i}") for i, x in enumerate(lanes)))
    exact = [F.col(f"l{i}").bitwiseAND(0xFFFFFFFF) for i in range(EXACT)]
    low = [F.col(f"l{EXACT + i}") for i in range(LIKE // 2)]
    like = [x.bitwiseAND(0xFFFFFFFF) for x in low] + [F.shiftrightunsigned(x, 32) for x in low]
    return summed.select(*keys, "clauses", F.array(*exact, *like).alias("vector"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector with the paragraphs of ``b`` inserted (or, with sign -1, deleted)."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: F.pmod(x["a"] + sign * x["b"], F.lit(1 << 32)))


def to_text(vector: Column, clauses: Column) -> Column:
    """Hexadecimal digits of all lanes, and of the number of clauses."""
    lane = F.transform(vector, lambda x: F.lpad(F.hex(x), 8, "0"))
    return F.lower(F.concat(F.array_join(lane, ""), F.lpad(F.hex(F.pmod(clauses, F.lit(1 << 32))), 8, "0")))


def likeness(a: Column, n_a: Column, b: Column, n_b: Column) -> Column:
    """Estimated cosine of two multisets of clauses, 0 to 1; 1 if the vectors are equal."""

    def signed(v: Column, n: Column) -> Column:
        # 2 x - n is the sum of +1 and -1; both are known modulo 2^32, so the result is read as a signed number.
        return F.transform(F.slice(v, EXACT + 1, LIKE), lambda x: F.pmod(2 * x - n + (1 << 31), F.lit(1 << 32)) - (1 << 31))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)

    x, y = signed(a, n_a), signed(b, n_b)
    share = F.try_divide(dot(x, y), F.sqrt(dot(x, x) * dot(y, y)))
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0)))))


def successors(keys: DataFrame, first: int, high: int) -> DataFrame:
    """(key, following): for each of the distinct keys (not negative) the next larger one; ``first`` for the last, ``high``.

    Keys are ordered inside runs of 1,024 numbers; the last of a run takes the first key of the next run that has any, which
    is the same question for the runs.
    """
    run = F.shiftright("key", NEIGHBOURS)
    inside = keys.select("key", run.alias("run"), F.lead("key").over(Window.partitionBy(run).orderBy("key")).alias("after"))
    if high >> NEIGHBOURS == 0:
        return inside.select("key", F.coalesce("after", F.lit(first)).alias("following"))
    firsts = keys.groupBy(run.alias("run")).agg(F.min("key").alias("first"))
    nexts = successors(firsts.select(F.col("run").alias("key")), first >> NEIGHBOURS, high >> NEIGHBOURS)
    reach = nexts.join(firsts.withColumnRenamed("run", "following"), "following").select(F.col("key").alias("run"), "first")
    return inside.join(reach, "run").select("key", F.coalesce("after", "first").alias("following"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = (0, 0) if low is None else (low, high)
    # From 1 on, so that null ids have 0.
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id") - low + 1, F.lit(0))).withColumn("run", F.shiftright("key", NEIGHBOURS))
    ordered = Window.partitionBy("run").orderBy("key", "text")
    # The runs in use, each with the one that follows; its first document goes to the last one of this run.
    runs = rows.select(F.col("run").alias("key")).distinct()
    after = successors(runs, 0, (high - low + 1) >> NEIGHBOURS)
    placed = rows.select("run", "doc_id", "text", F.row_number().over(ordered).alias("at"), F.lead("text").over(ordered).alias("next_text"))

    def from_next(firsts: DataFrame, value: str) -> DataFrame:
        """(run, first value of the next run)."""
        return after.join(firsts.withColumnRenamed("run", "following"), "following").select(F.col("key").alias("run"), F.col(value).alias("far"))

    firsts = placed.filter("at = 1").select("run", "text")
    whole = placed.join(from_next(firsts, "text"), "run", "left")
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("substring(coalesce(next_text, far, text), 1, cast(floor(length(text) / 2) as int))"))
    both = whole.select("run", "doc_id", "at", n.cast("bigint").alias("n_chars"), F.col("text"), edited.alias("edited"))
    each = both.select("run", "doc_id", "at", "n_chars", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")))).alias("b"))
    each = each.select("run", "doc_id", "at", "n_chars", "b.kind", F.when(F.col("b.kind") == 1, F.sha2("b.body", 256)).alias("sha"), "b.body")
    made = vectors(each, ["run", "doc_id", "at", "n_chars", "kind", "sha"], "body")
    pick = lambda kind, what: F.max(F.when(F.col("kind") == kind, F.col(what)))
    pair = made.groupBy("run", "doc_id", "at", "n_chars").agg(pick(1, "sha").alias("edited_sha256"), *(F.first(F.when(F.col("kind") == k, F.struct("vector", "clauses")), True).alias(v) for k, v in ((0, "own"), (1, "changed"))))
    after_own = F.lead("own").over(Window.partitionBy("run").orderBy("at"))
    pair = pair.withColumn("near", after_own)
    last = from_next(pair.filter("at = 1").select("run", "own"), "own")
    full = pair.join(last, "run", "left").withColumn("near", F.coalesce("near", "far", "own"))
    v = lambda c: (F.col(f"{c}.vector"), F.col(f"{c}.clauses"))
    return full.select("doc_id", "n_chars", "edited_sha256", to_text(*v("own")).alias("fingerprint"), to_text(*v("changed")).alias("edited_fingerprint"),
                       likeness(*v("own"), *v("changed")).alias("near_edited"), likeness(*v("own"), *v("near")).alias("near_next"))
