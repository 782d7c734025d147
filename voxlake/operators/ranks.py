"""Exact ranks and percentiles that never gather one hot group in a single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.operators.joins import fact_join
from voxlake.session import cut_lineage, num_partitions

BUCKETS = 4096
ACCURACY = 10000
PARTS = 1024


def bucket_rank(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str = "rank", total: str | None = None
) -> DataFrame:
    """1-based rank inside each key, given a bucket that rises with the order; ``total`` adds the key's row count.

    Ranks are made inside (key, bucket) and shifted by the rows of the earlier buckets, so the only
    window over a whole key runs on its bucket counts.
    """
    rows = df.withColumn("_b", bucket)
    counts = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    more = [F.sum("_n").over(Window.partitionBy(*keys)).alias(total)] if total else []
    starts = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"), *more)
    inner = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    ranked = rows.withColumn("_rn", inner).join(starts, [*keys, "_b"])
    return ranked.withColumn(name, F.col("_rn") + F.col("_start")).drop("_rn", "_start", "_b")


def hash_order(key: Column, seed: int) -> Column:
    """md5(key || seed): the repeatable stand-in for a random order."""
    return F.md5(F.concat(key.cast("string"), F.lit(str(seed))))


def hash_rank(
    df: DataFrame, keys: Sequence[str], key: Column, seed: int, name: str = "rank", total: str | None = None
) -> DataFrame:
    """Rank by md5; the first three hex digits are an even, order-keeping bucket."""
    rows = df.withColumn("_h", hash_order(key, seed))
    return bucket_rank(rows, keys, F.substring("_h", 1, 3), [F.col("_h"), key], name, total).drop("_h")


def hash_unit(key: Column) -> Column:
    """A repeatable number in [0, 1) from the first 32 bits of md5(key)."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0


def sorted_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank", total: str | None = None
) -> DataFrame:
    """Rank by any sort order: range partitions are the buckets.

    The range cut points come from sampling, so the partitioned rows are written once to the
    checkpoint folder before they are counted and ranked.
    """
    spark = df.sparkSession
    by = [*keys, *order]
    cut = df.repartitionByRange(num_partitions(spark), *by).withColumn("_pid", F.spark_partition_id())
    return bucket_rank(cut_lineage(cut), keys, F.col("_pid"), [F.col(c) for c in order], name, total).drop("_pid")


def value_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], name: str = "pct") -> DataFrame:
    """Percentiles of whole numbers from value counts.

    Linear interpolation between order statistics; one array column, one entry per probability.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    # The values' own range is the bracket, so only the part of it that holds a wanted rank is ordered.
    facts = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    whole = fact_join(counts, facts, keys)
    return _pick(whole.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(probs) - 1)))), keys, value, probs, name)


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], name: str = "pct", parts: int | None = None, one: bool = False) -> DataFrame:
    """Percentiles of any numeric data, exact, in two bounded steps.

    A mergeable sketch gives, for each probability, a bracket that surely holds the wanted ranks
    (error bound 1/accuracy of the rows); the second pass orders only the values inside the bracket and counts
    the rows below it. Keys with few rows take all their values as the bracket. ``one``: all rows have one key.
    """
    if not keys:
        whole = exact_percentiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs, name, one=True)
        return whole.drop("_all")
    data = df.filter(F.col(value).isNotNull()).select(*keys, value)
    margin = 5.0 / ACCURACY
    low = [max(p - margin, 0.0) for p in probs]
    high = [min(p + margin, 1.0) for p in probs]
    sketch = data.groupBy(*keys).agg(
        F.percentile_approx(value, low, ACCURACY).alias("_lo"),
        F.percentile_approx(value, high, ACCURACY).alias("_hi"),
        F.min(value).alias("_min"),
        F.max(value).alias("_max"),
        F.count("*").alias("_total"),
    )
    small = F.col("_total") <= ACCURACY
    bounds = []
    for i, p in enumerate(probs):
        lo = F.when(small | F.lit(p - margin <= 0), F.col("_min")).otherwise(F.col("_lo")[i])
        hi = F.when(small | F.lit(p + margin >= 1), F.col("_max")).otherwise(F.col("_hi")[i])
        bounds += [lo.alias(f"_lo{i}"), hi.alias(f"_hi{i}")]
    brackets = sketch.select(*keys, "_total", *bounds)
    seen = fact_join(data, brackets, keys, parts=parts, one=one)
    v = F.col(value)
    sent = [
        F.when(v <= F.col(f"_hi{i}"), F.struct(F.lit(i).alias("i"), F.when(v >= F.col(f"_lo{i}"), v).alias("v"), F.col(f"_lo{i}").cast("double").alias("lo"), F.col(f"_hi{i}").cast("double").alias("hi")))
        for i in range(len(probs))
    ]
    places = sent[0] if len(sent) == 1 else F.explode(F.array(*sent))
    rows = seen.select(*keys, "_total", places.alias("_s")).filter("_s is not null")
    place = [F.col(f"_s.{c}").alias(n) for c, n in (("i", "_i"), ("lo", "_lo"), ("hi", "_hi"), ("v", value))]
    counts = rows.groupBy(*keys, "_total", *place).agg(F.count("*").alias("_n"))
    return _pick(counts, keys, value, probs, name, one)


def _pick(counts: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], name: str, one: bool = False) -> DataFrame:
    """Values at the wanted ranks from value counts in brackets (_i, _lo, _hi); a null value stands for the rows below.

    A bracket is cut into equal parts; only their totals are summed in order, and only the parts that hold a wanted rank
    have their values ordered.
    """
    v = F.col(value)
    part = F.coalesce(F.floor(F.try_divide(v.cast("double") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * PARTS), F.lit(0))
    rows = counts.withColumn("_b", F.when(v.isNull(), -1).otherwise(part).cast("int"))
    ranks = [F.lit(0)] * (2 * len(probs))
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_total") - 1)
        ranks[2 * i], ranks[2 * i + 1] = F.floor(at), F.ceil(at)
    pick = lambda odd: F.element_at(F.array(*[ranks[2 * i + odd] for i in range(len(probs))]), F.col("_i") + 1)
    totals = rows.groupBy(*keys, "_total", "_i", "_b").agg(F.sum("_n").alias("_in"))
    before = Window.partitionBy(*keys, "_i").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    holds = lambda rank, start, n: (rank >= start) & (rank < start + n)
    wanted = starts.filter(holds(pick(0), F.col("_start"), F.col("_in")) | holds(pick(1), F.col("_start"), F.col("_in")))
    inside = fact_join(rows, wanted.select(*keys, "_i", "_b", "_start"), [*keys, "_i", "_b"], one=one)
    upto = Window.partitionBy(*keys, "_i", "_b").orderBy(v.asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_from", F.col("_start") + F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    aggs = []
    for i in range(len(probs)):
        for odd, tag in enumerate("lh"):
            hit = (F.col("_i") == i) & holds(ranks[2 * i + odd], F.col("_from"), F.col("_n"))
            aggs.append(F.max(F.when(hit, v.cast("double"))).alias(f"_{tag}{i}"))
    out = inside.groupBy(*keys).agg(F.max("_total").alias("_t"), *aggs)
    parts = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_t") - 1)
        lo, hi = F.col(f"_l{i}"), F.col(f"_h{i}")
        parts.append(lo + (hi - lo) * (at - F.floor(at)))
    return out.select(*keys, F.array(*parts).alias(name))
