"""Repeated rows, repetitive texts, clashing names and plain versions for the older text operators."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.data import rows, table
from voxlake.llm import decontaminate, fingerprint, language_id, line_dedup, secret_scan


def test_repeated_rows_do_not_mix_their_lines(spark):
    made = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (2, "a\na"), (3, "a\nb"), (None, "b\nb"), (None, "b\nb")], "doc_id bigint, text string")
    got = Counter((r.doc_id, r.text, r._n_removed) for r in line_dedup.dedup_lines(made).collect())
    assert got == Counter([(1, "a\nb", 0), (1, "a\nb", 0), (2, "a\na", 0), (3, "", 2), (None, "b\nb", 0), (None, "b\nb", 0)])


def test_names_of_the_callers_columns_come_back(spark):
    names = ["_k1", "_k2", "_lines", "_gone", "_row", "_a", "_b", "k1", "k2", "gone", "lines", "row", "n", "key", "place", "group", "words", "a.b"]
    lines = "\n".join(f"line {k} with some words of its own" for k in range(30))
    made = spark.createDataFrame([(i, lines if i < 4 else f"{i} " * 9, None, "s", 1, *(f"{c}{i}" for c in names)) for i in range(8)], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in names))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[1:4]):
        out = stage(spark, made, "/root/testdata/sf0.001")
        assert out.columns == made.columns, name
        assert all(r[f"{c}"] == f"{c}{r.doc_id}" for r in out.collect() for c in names), name
    assert [c for c in line_dedup.dedup_lines(made).columns if c not in made.columns] == ["_n_lines", "_n_removed"]


def test_one_word_over_and_over(spark):
    docs = spark.createDataFrame([(1, "na " * 3000), (1, "na " * 3000), (2, "la " * 3000), (None, "na " * 20)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "na " * 300), (8, "na " * 310), (9, "na " * 4)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.matched, r.of) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 7, 16, 16), (1, 8, 16, 16), (None, 7, 16, 16), (None, 8, 16, 16)}


def near(spark, first, second):
    docs = spark.createDataFrame([(1, first), (2, second)], "doc_id bigint, text string")
    return next(r for r in fingerprint.fingerprint_edits(docs).collect() if r.doc_id == 1)


def test_likeness_of_very_many_equal_clauses(spark):
    assert near(spark, "same;" * 40_000, "").near_edited > 0.9


def test_likeness_of_a_text_without_signs(spark):
    rng = random.Random(1)
    first, second = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(800)) for _ in range(2))
    got = near(spark, first, second)
    assert 0.3 < got.near_edited < 0.7 and got.near_next < 0.3


def plain_vector(text):
    """Multisets of the paragraphs and of the units that the likeness counts."""
    units = []
    for c in re.split("[.,;:!?|\n]+", text):
        c = c.strip(" ")
        parts = c.split(" ")
        if len(parts) > fingerprint.LONG:
            c = re.sub(rf"((?:[^ ]+ +){{{fingerprint.RUN - 1}}}[^ ]+) +", "\\1\n", c)
        units += c.split("\n") if c else []
    return Counter(text.split("\n")), Counter(units)


def test_fingerprints_follow_the_multisets(spark):
    """Equal where the multisets are equal, different elsewhere; the likeness is near the cosine of the counts."""
    rng = random.Random(2)
    texts = [t or "" for _, t in ((r[0], r[1]) for r in rows())]
    texts += ["\n".join(rng.sample(t.split("\n"), len(t.split("\n")))) for t in texts if t.count("\n") > 1]
    made = {r.i: r for r in fingerprint.vectors(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), ["i"], "text").collect()}
    plain = [plain_vector(t) for t in texts]
    for i in range(len(texts)):
        assert made[i].clauses == sum(plain[i][1].values())
        for j in range(i):
            assert (made[i].vector[: fingerprint.EXACT] == made[j].vector[: fingerprint.EXACT]) == (plain[i][0] == plain[j][0])
    pairs = [(i, j) for i in range(0, len(texts), 3) for j in range(i) if made[i].clauses and made[j].clauses]
    v = lambda i: (made[i].vector, made[i].clauses)
    frame = spark.createDataFrame([(*v(i), *v(j), k) for k, (i, j) in enumerate(pairs)], "a array<bigint>, m bigint, b array<bigint>, n bigint, k int")
    got = {r.k: r.x for r in frame.select("k", fingerprint.likeness(F.col("a"), F.col("m"), F.col("b"), F.col("n")).alias("x")).collect()}
    norm = lambda c: math.sqrt(sum(x * x for x in c.values()))
    off = [abs(got[k] - sum(plain[i][1][u] * plain[j][1][u] for u in plain[i][1]) / norm(plain[i][1]) / norm(plain[j][1])) for k, (i, j) in enumerate(pairs)]
    # 128 signs: the estimate's deviation is under 1 / sqrt(128).
    assert sum(off) / len(off) < 0.09 and max(off) < 0.5


LANGS = {"aa": "the of and that with from this have", "bb": "der und die das mit von dieser haben"}


def language_rows(n, ids):
    rng = random.Random(6)
    return [(ids(i), " ".join(rng.choice(LANGS[lang].split()) + rng.choice(["", "s", "en"]) for _ in range(12)) + f" {lang}{i}", lang) for i in range(n) for lang in LANGS]


@pytest.mark.parametrize("ids", [lambda i: i, lambda i: None, lambda i: 5], ids=["own", "null", "equal"])
def test_the_sample_is_bounded_whatever_the_ids(spark, ids):
    made = spark.createDataFrame(language_rows(400, ids) * 3, "doc_id bigint, text string, lang string")
    model = language_id.fit(made, docs_per_lang=100, least=1)
    learned = sum(bool(re.fullmatch(r"(aa|bb)", w)) for w in model["grams"][0])
    assert model["langs"] == ["aa", "bb"] and learned == 2
    words = made.select("text", "lang", F.xxhash64("doc_id", "text").alias("h")).distinct()
    kept = words.filter(F.pmod("h", F.lit(1 << 30)) < 0.25 * (1 << 30)).count()
    assert 100 < kept < 300  # about a quarter of 800 different rows, copies not counted


def plain_fit(made, least):
    counts = {n: {lang: Counter() for lang in LANGS} for n in (0, *language_id.ORDERS)}
    for _, text, lang in set(made):
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f"_{word}_"
            for n in counts:
                counts[n][lang].update([word] if n == 0 else [padded[i : i + n] for i in range(len(padded) - n + 1)])
    out = {}
    for n, by in counts.items():
        seen = {g for c in by.values() for g in c if sum(x[g] for x in by.values()) >= least}
        out[n] = {g: [math.log((by[lang][g] + 0.5) / (sum(by[lang].values()) + len(by[lang]))) for lang in LANGS] for g in seen}
    return out


def test_fit_and_predict_are_those_of_the_plain_version(spark):
    made = language_rows(60, lambda i: i)
    docs = spark.createDataFrame(made, "doc_id bigint, text string, lang string")
    model, plain = language_id.fit(docs, least=2), plain_fit(made, 2)
    for n, grams in plain.items():
        assert set(model["grams"][n]) == set(grams)
        assert all(abs(a - b) < 1e-5 for g in grams for a, b in zip(model["grams"][n][g], grams[g]))
    texts = [t for _, t, _ in language_rows(3, lambda i: i)] + ["unseen thewords hier", "x", "", None, "12", "dasthe"]

    def score(text):
        total, seen = [0.0, 0.0], 0
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            seen += 1
            padded = f"_{word}_"
            found = plain[0].get(word)
            for k, n in enumerate(language_id.ORDERS, 1):
                if found is None:
                    known = [plain[n][padded[i : i + n]] for i in range(len(padded) - n + 1) if padded[i : i + n] in plain[n]]
                    found = [sum(x) / len(known) + k * math.log(0.4) for x in zip(*known)] if known else None
            total = [a + b for a, b in zip(total, found or [0, 0])]
        if not seen:
            return "und", 0.0
        best = max(range(2), key=lambda i: total[i])
        belief = [math.exp((x - total[best]) / math.sqrt(seen)) for x in total]
        return list(LANGS)[best], belief[best] / sum(belief)

    out = language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()
    assert len(out) == len(texts)
    for r in out:
        lang, s = score(texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - s) < 1e-4, texts[r.doc_id]


def plain_secrets(text):
    """Base spans by the stated rules: (start, end, kind)."""
    assign = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m.group(1)) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def test_base_secrets_are_those_of_the_plain_version(spark):
    rng = random.Random(11)
    parts = ["password", "PassWd", "api_key", "APIKEY", "secret", "token", ":", "=", " ", "  ", "'", '"', "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef" * 3, "short", "value_9", "é", "\n", ".", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(1500)] + [None, "", "x" * 100_000 + " token=abcdef"]
    out = secret_scan.scan_secrets(spark.createDataFrame([(i, t, f"s{i % 7}", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, source string, spans int")).collect()
    assert len(out) == len(texts)
    for r in out:
        want = plain_secrets(texts[r.doc_id] or "")
        kinds = Counter(k for k, _, _ in want)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(r.spans.split(","))


@pytest.mark.parametrize("same", [None, 3])
def test_very_many_null_or_equal_ids(spark, same):
    made = [(same, t, "en", "s", 1, "s", "k", 1) for _, t in ((r[0], r[1]) for r in rows()) for _ in range(6)]
    docs = table(spark, made)
    assert line_dedup.dedup_lines(docs).count() == secret_scan.scan_secrets(docs).count() == fingerprint.fingerprint_edits(docs).count() == len(made)
    assert language_id.predict(docs, language_id.fit(docs)).count() == len(made)
