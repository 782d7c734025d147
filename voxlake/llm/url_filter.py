"""URL filter: rules by host and path, then a list of canonical URLs behind a blocked Bloom filter.

The Bloom filter is a table of 256-bit blocks (four 64-bit words, one bit in each) built by ``bit_or``. A URL looks up one
block; only possible hits go on to the exact hash join with the list, which removes the false positives. All steps are
DataFrame operations, and the engine picks broadcast or shuffle for the block table by its measured size.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed; repeated rows
each give a row; an empty list blocks nothing and an empty table gives no rows; a URL of any length is read whole; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import lower_ascii

WORDS = 4


def _piece(url: Column, group: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", group)


def host(url: Column) -> Column:
    return lower_ascii(_piece(url, 1))


def path(url: Column) -> Column:
    return _piece(url, 2)


def canonical(url: Column) -> Column:
    """Host without www. or m., path without a closing slash, query without tracking parameters; no scheme, no fragment."""
    kept = F.filter(F.split(_piece(url, 3), "&"), lambda x: (x != "") & ~x.rlike("^(utm_[^=]*|ref)(=.*)?$"))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(F.regexp_replace(host(url), r"^(www|m)\.", ""), F.regexp_replace(path(url), "/+$", ""), query)


def rule_of(host_col: Column, path_col: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; rules are (verdict, host, path)."""
    rule = verdict = F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tried first
        fits = ((host_col == rule_host) | host_col.endswith("." + rule_host)) & path_col.startswith(rule_path)
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _bits(url: str) -> list[Column]:
    """One bit for each word of the block, from six bits each of a second hash."""
    return [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64('bit', {url}), {6 * w}) & 63 as int))") for w in range(WORDS)]


def bloom_blocks(listed: DataFrame, n_blocks: int, url: str = "canon") -> DataFrame:
    """The filter as a table: (block, w0 .. w3)."""
    keyed = listed.select(F.pmod(F.xxhash64(url), F.lit(n_blocks)).alias("block"), *(b.alias(f"b{w}") for w, b in enumerate(_bits(url))))
    return keyed.groupBy("block").agg(*(F.bit_or(f"b{w}").alias(f"w{w}") for w in range(WORDS)))


def filter_urls(pages: DataFrame, listed_urls: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", bits_per_url: int = 16) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for each page. ``listed_urls`` has one column of URLs to block."""
    listed = listed_urls.select(canonical(F.col(listed_urls.columns[0])).alias("canon")).filter("canon <> ''").distinct()
    n_blocks = max(1, -(-listed.count() * bits_per_url // 256))
    blocks = bloom_blocks(listed, n_blocks)
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host(url).alias("host"), path(url).alias("path"), canonical(url).alias("canon"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("canon"), F.lit(n_blocks)))
    hit = F.lit(True)
    for w, bit in enumerate(_bits("canon")):
        hit = hit & (F.col(f"w{w}").bitwiseAND(bit) == bit)
    probed = rows.join(blocks, "block", "left").select("page_id", "host", "path", "canon", F.coalesce(hit, F.lit(False)).alias("possible"))
    exact = probed.filter("possible").join(listed.select("canon", F.lit(True).alias("listed")).hint("shuffle_hash"), "canon", "left")
    every = exact.select("page_id", "host", "path", F.coalesce("listed", F.lit(False)).alias("listed")).unionByName(probed.filter("not possible").select("page_id", "host", "path", F.lit(False).alias("listed")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return every.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
