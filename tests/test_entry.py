"""Every named query runs on the smallest data and gives the rows of its SQL twin."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["q_leaderboard", "q_pair_inner", "q_group_split", "q_uint8_any", "q_resample_nearest", "q_otsu_slice", "q_triangle_float",
          "q_components_class", "q_largest", "q_match", "q_stitch_gauss", "q_prompt_fold", "q_knee", "q_fill_holes"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_names(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    res = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert Counter(tuple(r) for r in df.select(*cols).collect()) == Counter(res)
