"""The named queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm import bpe_codec, decontaminate, fingerprint, language_id, line_dedup, merkle, quality, secret_scan, simhash, suffix_dedup, token_files, trie, url_filter
from voxlake.llm.common import cut_lineage, lower_ascii, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Host labels whose pages' canonical URLs make the block list of op7.
LISTED_LABELS = ("spam-farm", "cheap-pills", "free-bets", "casino-win", "adult-x")


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.select("url").filter(url_filter.host(F.col("url")).rlike(rf"(^|\.)({'|'.join(LISTED_LABELS)})\."))
    return url_filter.filter_urls(pages, listed, RULES)


_KEPT = "list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_full_match(x, '(utm_[^=]*|ref)(=.*)?'))"
_CANON = rf"regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len({_KEPT}) > 0 THEN '?' || array_to_string({_KEPT}, '&') ELSE '' END"
SQL["op7_url_filter"] = rf"""
WITH u AS (SELECT page_id,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?', 2) AS path,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?', 3) AS q FROM pages),
c AS (SELECT page_id, host, path, {_CANON} AS canon FROM u),
l AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(host, '(^|\.)({'|'.join(LISTED_LABELS)})\.')),
r(rank, what, h, p) AS (VALUES {', '.join(f"({len(h + p)}, '{w}', '{h}', '{p}')" for w, h, p in RULES)}),
f AS (SELECT page_id, host, path, canon,
  (SELECT arg_max(h || p, rank) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
  (SELECT arg_max(what, rank) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS fit FROM c)
SELECT page_id, host, path, rule, coalesce(fit, CASE WHEN canon IN (SELECT canon FROM l) THEN 'block' ELSE 'allow' END) AS verdict,
  canon IN (SELECT canon FROM l) AS listed FROM f"""


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = language_id.fit(docs.filter(~F.coalesce(held_out, F.lit(False))))
    out = language_id.predict(docs, model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.token_folder(spark)
    with open(_tokenizer("byte_bpe_50k.json"), encoding="utf-8") as f:
        manifest = token_files.write_shards(table(spark, sf_dir, "documents"), f.read(), folder, split_special=False)
    return token_files.read_shards(manifest, folder)


@query
def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe_codec.load_ranks(_tokenizer("byte_bpe_50k.tiktoken"))
    coded = bpe_codec.decode(bpe_codec.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, threshold=4, search_seeds=())
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"))


SQL["op4_line_dedup"] = r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
f AS (SELECT *, length(line) - length(replace(line, ' ', '')) + 1 >= 50 AS long FROM l WHERE trim(regexp_replace(line, '[\t\r]', '', 'g')) <> ''),
u AS (SELECT *, row_number() OVER o AS pos, lead(line) OVER o AS line2, lead(place) OVER o AS place2 FROM f WINDOW o AS (PARTITION BY doc_id, text ORDER BY place)),
w AS (SELECT doc_id, text, pos, 2 AS len, line || chr(10) || line2 AS body, [place, place2] AS places FROM u WHERE line2 IS NOT NULL
  UNION ALL SELECT doc_id, text, pos, 1, line, [place] FROM u WHERE long),
r AS (SELECT doc_id, text, unnest(places) AS place FROM (SELECT *, row_number() OVER (PARTITION BY len, body ORDER BY doc_id, text, pos) AS nth FROM w) WHERE nth > 1),
g AS (SELECT DISTINCT doc_id, text, place FROM r),
k AS (SELECT l.doc_id, l.text, string_agg(CASE WHEN g.place IS NULL THEN line END, chr(10) ORDER BY l.place) AS kept, count(*) AS n_lines, count(g.place) AS n_removed
  FROM l LEFT JOIN g USING (doc_id, text, place) GROUP BY l.doc_id, l.text)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM documents d LEFT JOIN k USING (doc_id, text)"""


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = lambda text: merkle.leaf(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), text)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select(F.struct("source").alias("tree"), "doc_id", own(F.col("text")).alias("digest"), F.when(tampered, own(lower_ascii(F.col("text")))).alias("altered"))
    found = merkle.all_proofs(*merkle.manifest(leaves, ["doc_id", "digest"], ["doc_id", "altered"]))
    found = found.withColumn("folded_root", merkle.fold(F.coalesce("altered", "digest"), F.col("path")))
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: crc32 of the decimal digits of a number: the register is shifted by one input bit after the other.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}::VARCHAR, ''), lambda ch: list_transform(range(8), lambda k: ((ascii(ch) >> k) & 1)::BIGINT)))), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _FIELD + ")"
_SIDE = "coalesce(string_agg(node, '') OVER (PARTITION BY {0} l, i // 16 ORDER BY i ROWS BETWEEN {1}), '')"
_BEFORE, _AFTER = "UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING"
SQL["op11_merkle_manifest"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_LEAF.format("text")} AS leaf,
  CASE WHEN {_CRC.format("doc_id")} % 5 = 0 THEN {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS altered FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
t AS (SELECT source, 0 AS l, i, leaf AS node, n FROM o
  UNION ALL SELECT source, l + 1, i // 16, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 15) // 16 FROM t WHERE n > 1 GROUP BY source, l, i // 16),
r AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS l, i, subroot AS node, n FROM r
  UNION ALL SELECT l + 1, i // 16, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 15) // 16 FROM u WHERE n > 1 GROUP BY l, i // 16),
s AS (SELECT source, l, i, {_SIDE.format("source,", _BEFORE)} AS b, {_SIDE.format("source,", _AFTER)} AS a FROM t WHERE n > 1),
v AS (SELECT l, i, {_SIDE.format("", _BEFORE)} AS b, {_SIDE.format("", _AFTER)} AS a FROM u WHERE n > 1),
g AS (SELECT doc_id, source, leaf, 0 AS l, i, n, coalesce(altered, leaf) AS node, '' AS proof FROM o
  UNION ALL SELECT doc_id, g.source, leaf, g.l + 1, g.i // 16, (n + 15) // 16, sha256(b || node || a), proof || b || a FROM g JOIN s ON g.source IS NOT DISTINCT FROM s.source AND g.l = s.l AND g.i = s.i WHERE n > 1),
h AS (SELECT doc_id, leaf, subroot, 0 AS l, r.i, r.n, node, proof FROM g JOIN r ON g.source IS NOT DISTINCT FROM r.source WHERE g.n = 1
  UNION ALL SELECT doc_id, leaf, subroot, h.l + 1, h.i // 16, (n + 15) // 16, sha256(b || node || a), proof || b || a FROM h JOIN v ON h.l = v.l AND h.i = v.i WHERE n > 1)
SELECT doc_id, leaf, subroot, u.node AS root, sha256(proof) AS proof_sha256, h.node AS folded_root, h.node = u.node AS verified FROM h, u WHERE h.n = 1 AND u.n = 1"""


@query
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality.STATS, "base_failed", "kept", "n_frequent_lines", "n_words_removed")


SQL["op12_quality_rules"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS own FROM documents),
p AS (SELECT doc_id, i, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2)),
q AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w1, w2, w3) AS times FROM p),
m AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) FROM q WHERE times > 1) GROUP BY doc_id),
l AS (SELECT doc_id, source, text, place, trim(regexp_replace(translate(lower(line), '123456789', '000000000'), '[ \t\r\x0b\x0c]+', ' ', 'g')) AS line
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d)),
k AS (SELECT source, count(DISTINCT documents.text) AS docs FROM documents GROUP BY source),
f AS (SELECT l.source, line FROM l JOIN k ON l.source IS NOT DISTINCT FROM k.source WHERE line <> '' GROUP BY l.source, line, docs HAVING count(DISTINCT text) >= greatest(10, 0.01 * docs)),
g AS (SELECT doc_id, count(*) AS n, sum(length(line) - length(replace(line, ' ', '')) + 1) AS lost FROM l JOIN f USING (line) WHERE l.source IS NOT DISTINCT FROM f.source GROUP BY doc_id),
b AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(own) - len(list_distinct(own)) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n, 0) AS n_frequent_lines, coalesce(lost, 0)::BIGINT AS n_words_removed FROM d LEFT JOIN m USING (doc_id) LEFT JOIN g USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_words_removed >= 0.5 * n_words AS kept, n_frequent_lines, n_words_removed FROM b"""


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = cut_lineage(trie.turn_lists(table(spark, sf_dir, "conversations")))
    # The first turns (crc32 mod 6 of them) come from the conversation that begins the hundred.
    first = lists.select(F.col("conv_id").alias("base"), F.slice("tokens", 1, 5).alias("head"))
    own = lists.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 100, "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")})
    rest = F.slice("tokens", F.col("h") + 1, F.greatest(F.size("tokens") - F.col("h"), F.lit(0)))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<string>"))
    return trie.prefix_trie(own.join(first, "base", "left").select("conv_id", F.concat(head, rest).alias("tokens")))


SQL["op13_conversation_trie"] = f"""
WITH o AS (SELECT conv_id, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
c AS (SELECT conv_id, t, {_CRC.format("conv_id")} % 6 AS h FROM o),
p AS (SELECT c.conv_id, list_concat(coalesce(b.t[1:h], []), c.t[h + 1:]) AS t FROM c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 100),
m AS (SELECT conv_id, d AS depth, t[1:d] AS path, len(t) AS own, CASE WHEN d = 0 THEN 0 ELSE length(t[d][2]) END AS chars FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM p)),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE own = depth), '') AS ends FROM m GROUP BY depth, path),
k AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.depth = k.depth AND n.path = k.path),
s AS (SELECT a AS depth, path[1:a] AS path, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM f) GROUP BY ALL)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN s ON f.depth = s.depth AND f.path = s.path LEFT JOIN f q ON q.depth = f.depth - 1 AND q.path = f.path[1:f.depth - 1]"""
