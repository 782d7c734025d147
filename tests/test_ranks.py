"""Exact percentiles and ranks against numpy, also beyond the sketch's exact range and on a hot key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import ranks as rk


def test_percentiles_exact_on_hot_key(spark):
    n = 60_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50 + 2).alias("k"), (F.hash("id").cast("double") / 1000).alias("v")
    )
    probs = [0.0, 0.001, 0.25, 0.5, 0.9, 0.99999, 1.0]
    got = {r.k: r.pct for r in rk.exact_percentiles(df, ["k"], "v", probs).collect()}
    pdf = df.toPandas()
    for k, part in pdf.groupby("k"):
        assert got[k] == pytest.approx(np.percentile(part["v"], [p * 100 for p in probs]).tolist(), rel=1e-12)
    whole = rk.exact_percentiles(df, [], "v", [0.5]).first().pct[0]
    assert whole == pytest.approx(np.percentile(pdf["v"], 50), rel=1e-12)


def test_percentile_between_two_values_and_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, 10.0), (2, 5.0)], "k int, v double")
    for fn in (rk.exact_percentiles, rk.value_percentiles):
        got = {r.k: r.pct for r in fn(df, ["k"], "v", [0.5, 0.9]).collect()}
        assert got[1] == pytest.approx([2.0, 7.6]) and got[2] == [5.0, 5.0]


def test_ranks_are_dense_and_ordered(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.md5(F.col("id").cast("string")).alias("p"))
    pdf = rk.sorted_rank(df, ["k"], ["p"], "r", "n").toPandas().sort_values(["k", "r"])
    for _, part in pdf.groupby("k"):
        assert part["r"].tolist() == list(range(1, len(part) + 1))
        assert part["p"].tolist() == sorted(part["p"]) and set(part["n"]) == {len(part)}
    h = rk.hash_rank(df, [], F.col("p"), 1).toPandas()
    assert sorted(h["rank"]) == list(range(1, 5001))
