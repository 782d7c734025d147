"""Token-id files, the BPE codec and the pipeline: against the tokenizer libraries and a plain run of the stages."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.data import rows, table
from voxlake.llm import bpe_codec, language_id, token_files

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = bpe_codec.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ODD = [(90, "two  spaces"), (91, "tab\t and\n newline"), (92, " a"), (93, "b "), (94, "it's we'll, don't."), (95, "x  y　z"), (96, "<|endoftext|> text"), (97, "ümläut, é. 日本語. 12,5 a.b,c"), (98, "\U0001f600 \U0001f600, ²½ Ⅷ"), (99, "a\x1cb \x1c c")]


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 3 * token_files.BLOCK + 5, dtype=np.uint64).astype(np.uint32)
    docs = [ids[:10], ids[10:10], ids[10:9000], ids[9000:]]
    shard = token_files.Shard(token_files.shard_bytes([3, None, 5, -7], docs, bits))
    assert [(d, a) for d, a, _ in shard.documents()] == [(3, 0), (None, 10), (5, 10), (-7, 9000)]
    assert all((x == y).all() for (_, _, x), y in zip(shard.documents(), docs))
    assert (shard.ids(4000, 4200) == ids[4000:4200]).all() and len(shard.body) == 4 * token_files.BLOCK * bits // 8
    assert token_files.width(1 << bits) == bits


@pytest.mark.parametrize("shard_tokens", [1 << 23, 700])
def test_token_files(spark, shard_tokens):
    made = [(r[0], r[1]) for r in rows()] + ODD
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    want, start = Counter(), 0
    for d, t in sorted(made, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[d, start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    docs = spark.createDataFrame([(d, t, 0) for d, t in made], "doc_id bigint, text string, start int")
    folder = token_files.token_folder(spark)
    with open(JSON, encoding="utf-8") as f:
        manifest = token_files.write_shards(docs, f.read(), folder, shard_tokens=shard_tokens)
    out = token_files.read_shards(manifest, folder).collect()
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out) == want
    assert (manifest.count() > 10) == (shard_tokens == 700)


def test_special_tokens_in_the_text_keep_their_ids(spark):
    """The library's default, which the query takes: a written-out added token has its own id, and so do texts around it."""
    made = [(i, t) for i, t in enumerate(["a <|endoftext|> text", "<|endoftext|>", "x<|endoftext|>y <|endoftext|>", "<|endoftext|", "a text", "", None, "end\n<|endoftext|>\n\nnext"])]
    tok = Tokenizer.from_file(JSON)
    want, start = [], 0
    for d, t in made:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    folder = token_files.token_folder(spark)
    with open(JSON, encoding="utf-8") as f:
        manifest = token_files.write_shards(spark.createDataFrame(made, "doc_id bigint, text string"), f.read(), folder, split_special=False)
    assert sorted(map(tuple, token_files.read_shards(manifest, folder).collect())) == want
    assert tok.encode("a <|endoftext|> text", add_special_tokens=False).ids == [64, 220, 50256, 2420]


def test_a_piece_is_looked_up_once_for_many_texts(monkeypatch):
    """Pieces are looked up by their distinct values, not for each time they occur; marks kept by an earlier task still count."""
    with open(JSON, encoding="utf-8") as f:
        made = f.read()
    token_files.text_encoder(made, False)
    key = zlib.crc32(made.encode()), False

    class Counting(dict):
        asked = 0

        def get(self, *a):
            Counting.asked += 1
            return super().get(*a)

    kept = token_files.sys._token_pieces[key]
    monkeypatch.setitem(token_files.sys._token_pieces, key, (kept[0], Counting({"a": bytes(bytearray(token_files._ODD))}), {}, {}, {}))
    encode, _ = token_files.text_encoder(made, False)
    texts = ["alpha beta, gamma\nalpha beta\ndelta 12 " + "alpha beta " * 50 + "end", "", "a b", " two  spaces ", "x\n\ny <|endoftext|> z", *["alpha beta, gamma"] * 400]
    got = [x.tolist() for x in encode(texts)]
    assert got == [e.ids for e in kept[0].encode_batch_fast(texts, add_special_tokens=False)]
    assert Counting.asked < 40


def test_texts_are_encoded_in_bounded_runs(monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK_CHARS", 10)
    texts = ["abc", "", "defghijk", "x" * 50, "", "y"]
    assert list(token_files._chunks(texts)) == [(0, 3), (3, 4), (4, 6)] and list(token_files._chunks([])) == []


def test_token_files_of_nothing(spark):
    folder = token_files.token_folder(spark)
    with open(JSON, encoding="utf-8") as f:
        assert token_files.read_shards(token_files.write_shards(table(spark, []), f.read(), folder), folder).count() == 0


@pytest.mark.parametrize("block_chars", [1 << 22, 500])
def test_bpe_codec(spark, block_chars):
    made = [(r[0], r[1]) for r in rows()] + ODD
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    ids = {t: np.array(codec.encode_ordinary(t or ""), "<u4").tobytes() for _, t in made}
    docs = spark.createDataFrame([(d, t, "x") for d, t in made], "doc_id bigint, text string, ids string")
    out = bpe_codec.decode(bpe_codec.encode(docs, RANKS, public_tokenizers.PATTERN, block_chars=block_chars), RANKS).collect()
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in out) == Counter((d, len(ids[t]) // 4, ids[t], (t or "").encode()) for d, t in made)


def test_bpe_codec_of_nothing(spark):
    assert bpe_codec.encode(table(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    """Every stage keeps the columns, and what it removes has a reason in its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, "12 + 34 = 46", None, "src0", 12), (9002, None, "en", None, None), (9003, "", None, "src1", 0)], docs.schema)
    copy = docs.filter("doc_id = 12").withColumn("doc_id", F.lit(9004).cast("bigint"))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first().text
    leak = spark.createDataFrame([(9005, f"Before it. {item} After it.", "en", "src2", 0)], docs.schema)
    now = docs.unionByName(extra).unionByName(copy).unionByName(leak)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, now, SF).persist()
        before, after = {r.doc_id for r in now.select("doc_id").collect()}, {r.doc_id for r in new.select("doc_id").collect()}
        seen[name] = before - after
        assert after <= before
        if name != corpus_pipeline.STAGES[-1][0]:
            assert new.dtypes == now.dtypes
        now = new
    assert seen["language_id"] == {9001, 9002, 9003}
    assert seen["line_dedup"] == set() and seen["byte_level_bpe"] == set()
    assert 9004 in seen["simhash_near_dedup"] and 12 not in seen["simhash_near_dedup"]
    assert 9005 in seen["benchmark_decontamination"]
    assert all(r.decoded_sha256 and r.n_tokens == len(r.ids) // 4 for r in now.collect())


def test_language_stage_rejects_what_the_model_does_not_know(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    noise = np.random.default_rng(1).integers(97, 123, (80, 7), np.uint8)
    odd = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "Все люди рождаются свободными и равными", " ".join(bytes(w).decode() for w in noise)]
    extra = spark.createDataFrame([(9100 + i, t, ("en", None)[i % 2], "s", len(t)) for i, t in enumerate(odd)], docs.schema)
    before = {r.doc_id for r in docs.filter(r"text rlike '\\p{L}'").select("doc_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.by_language(spark, docs.unionByName(extra), SF).collect()} == before


def test_language_stage_decides_by_the_predicted_language(spark):
    """A text half in one language and half in another is known word by word, but in no language (F5 of round 3)."""
    left, right = "alpha beta gamma delta", "uno dos tres cuatro"
    made = [(i, left, "aa") for i in range(3)] + [(i + 10, right, "bb") for i in range(3)]
    made += [(20, f"{left} {right}", None), (21, f"{left} {left} {left}", None), (22, f"{right} {right} uno", "aa"), (23, "12", "aa"), (24, None, "bb")]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, lang string")
    model = language_id.fit(docs.filter("doc_id < 20"))
    assert language_id.evidence(model, f"{left} {right}") == 1.0
    kept = lambda **more: {r.doc_id for r in language_id.recognised(docs.filter("doc_id >= 20"), model, **more).collect()}
    assert kept() == {21, 22} and kept(langs=["bb"]) == {22} and kept(score=0.0) == {20, 21, 22}
    assert {r.doc_id for r in corpus_pipeline.by_language(spark, docs.filter("doc_id <> 22"), SF).collect()} == {0, 1, 2, 10, 11, 12, 21}


def test_language_stage_keeps_an_unlabelled_corpus(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (None, "other words", None), (None, "!!", None)], "doc_id bigint, text string, lang string")
    assert sorted(r.text for r in corpus_pipeline.by_language(spark, docs, SF).collect()) == ["other words", "some words"]


def test_rows_are_decided_by_themselves(spark):
    """Clean rows that share an id (or a null one) with a rejected text stay, and one row of each group of copies."""
    some = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars between 1500 and 6000").orderBy("doc_id").limit(5).collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first().text
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = lambda made: spark.createDataFrame([(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(made)], schema)
    left = lambda out: sorted((r.source, r.doc_id) for r in out.collect())
    made = [(None, some[0]), (None, "12 + 34"), (5, some[1]), (5, "!!")]
    assert left(corpus_pipeline.by_language(spark, docs(made), SF)) == [("s0", None), ("s2", 5)]
    made = [(None, some[0]), (None, f"{some[1]} {item} end"), (5, some[1]), (5, item)]
    assert left(corpus_pipeline.without_benchmarks(spark, docs(made), SF)) == [("s0", None), ("s2", 5)]
    near = some[0].replace(" ", " edited ", 1)
    out = left(corpus_pipeline.without_near_copies(spark, docs([(None, some[0]), (None, near), (None, some[1]), (7, some[2]), (7, some[2]), (8, some[3]), (8, some[4]), (3, some[4]), (None, some[4])]), SF))
    assert len(out) == 5 and [x[1] for x in out].count(None) == 2 and ("s2", None) in out
    assert ("s5", 8) in out and ("s7", 3) in out and [x[1] for x in out].count(7) == 1


def test_pipeline_takes_an_empty_table(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert now.count() == 0


def test_pipeline_query_is_the_stages(spark):
    import __spark_entry__ as entry

    out = entry.queries()["pipeline"](spark, SF).collect()
    now = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, SF)
    assert Counter((r.doc_id, r.decoded_sha256) for r in out) == Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in now.collect())
