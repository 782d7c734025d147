"""Line dedup, decontamination, substring dedup and SimHash against brute force on the odd rows and on planted cases."""

import hashlib
import itertools
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tests.llm.data import rows, table
from voxlake.llm import decontaminate, graph, line_dedup, simhash, suffix_dedup

LEAST = -(1 << 63)


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def _order(made):
    """Distinct (id, text) in the order of line dedup: id (null first), then the hash of the text."""
    return sorted({(d, t) for d, t in made}, key=lambda r: (LEAST if r[0] is None else r[0], _signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)) if r[1] is not None else 42))


def brute_lines(made, lines, long_words):
    seen, out = set(), {}
    for d, t in _order(made):
        if t is None:
            out[d, t] = None
            continue
        each = t.split("\n")
        units = [i for i, x in enumerate(each) if x.replace("\t", "").replace("\r", "").strip(" ")]
        windows = [tuple(units[i : i + lines]) for i in range(len(units) - lines + 1)] + [(i,) for i in units if each[i].count(" ") + 1 >= long_words]
        gone = set()
        for w in sorted(set(windows)):
            body = tuple(each[i] for i in w)
            if body in seen:
                gone.update(w)
            seen.add(body)
        out[d, t] = "\n".join(x for i, x in enumerate(each) if i not in gone)
    return out


@pytest.mark.parametrize("lines, long_words", [(2, 50), (1, 50), (3, 20)])
def test_line_dedup(spark, lines, long_words):
    made = [(r[0], r[1]) for r in rows()] + [(80, "a b\nc d\na b\nc d\na b\nc d"), (81, "c d\na b\nx\nc d\na b")]
    want = brute_lines(made, lines, long_words)
    docs = spark.createDataFrame([(d, t, t) for d, t in made], "doc_id bigint, text string, k1 string")
    out = line_dedup.dedup_lines(docs, lines, long_words).collect()
    assert Counter((r.doc_id, r.k1, r.text) for r in out) == Counter((d, t, want[d, t]) for d, t in made)
    assert sum(r._n_removed for r in out) > 0
    assert line_dedup.dedup_lines(docs.filter("false")).count() == 0


def _words(t):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]


def brute_leaks(docs, items):
    own = {}
    for i, t in sorted(items, key=lambda x: x[0]):
        w = tuple(_words(t))
        if len(w) >= 5:
            own.setdefault(w, i)
    out = {}
    for (d, t), (y, i) in itertools.product(docs, own.items()):
        x = _words(t)
        if len(x) < 5:
            continue
        m = min(16, len(y))
        for shift in range(-len(y), len(x)):
            same = [0 <= shift + j < len(x) and x[shift + j] == y[j] for j in range(len(y))]
            best = max(sum(same[s : s + m]) for s in range(len(y) - m + 1))
            if best + decontaminate.allowed(m) >= m:
                out[d, i] = max(out.get((d, i), 0), best)
    return out


def test_decontaminate(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
    w = item.split()
    edit = lambda at: " ".join("changed" if i in at else x for i, x in enumerate(w))
    docs = [(1, f"lead in {item} and out"), (2, edit({3, 7, 11})), (3, edit({0, 4, 8, 12, 16})), (4, " ".join(w[1:17])), (5, " ".join(w[:9])), (6, None), (7, ""), (8, "ONE, two; Three-four five"), (9, "alpha beta gamma delta"),
            (10, f"{item} {edit({2})}"), (1, "nothing here at all"), (None, item), (11, "seven short words make up this item"), (12, "seven short words make up that item")]
    items = [(1, item), (2, item.upper()), (3, "alpha beta gamma delta"), (4, "seven short words make up this item"), (5, None), (6, "one two three four five")]
    out = decontaminate.contaminated(spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, words string"), spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, seed string"))
    got = {(r.doc_id, r.item_id): r.matched for r in out.collect()}
    assert got == brute_leaks(docs, items)
    assert {d for d, i in got if i == 1} == {1, 2, 4, 10, None} and (12, 4) in got
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(table(spark), none).count() == 0


def test_items_without_an_id_are_found(spark):
    docs = spark.createDataFrame([(1, "so one two three four five six it goes"), (2, "then red green blue black white ends"), (3, "none of these")], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, "one two three four five six"), (None, "red green blue black white"), (4, "red green blue black white")], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} == {(1, None), (2, 4)}


def test_the_first_mask_meets_every_overlap():
    mask = [i for i, c in enumerate(decontaminate.MASKS[0]) if c == "1"]
    for m in range(5, 17):
        for gone in itertools.combinations(range(m), decontaminate.allowed(m)):
            assert any(all(s + i not in gone for i in mask) for s in range(m - len(decontaminate.MASKS[0]) + 1)), (m, gone)


def brute_bytes(made, depth):
    key = lambda r: (LEAST if r[0] is None else r[0], _signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)))
    seen, out = set(), {}
    for d, t in sorted({(d, t or "") for d, t in made}, key=key):
        raw = t.encode()
        hit = np.zeros(len(raw) + 1, int)
        for s in range(len(raw) - depth + 1):
            if raw[s : s + depth] in seen:
                hit[s] += 1
                hit[s + depth] -= 1
            seen.add(raw[s : s + depth])
        gone = np.cumsum(hit)[:-1] > 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[d, t] = (len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("depth, hot", [(100, 50_000), (100, 1), (60, 3)])
def test_substring_dedup(spark, depth, hot):
    made = [(r[0], r[1]) for r in rows()]
    want = brute_bytes(made, depth)
    out = suffix_dedup.remove_repeats(table(spark).withColumn("t1", F.lit("clash")), depth, hot).collect()
    assert Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in out) == Counter((d, want[d, t or ""]) for d, t in made)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in out)


def test_substring_dedup_of_nothing(spark):
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0


def brute_components(prints, threshold):
    """The smallest id in each component of fingerprints (tuples of 64-bit words)."""
    distinct = sorted(set(prints.values()))
    x = np.array(distinct, np.uint64)
    near = sum(np.bitwise_count(x[:, None, k] ^ x[None, :, k]).astype(int) for k in range(x.shape[1])) <= threshold
    label = np.arange(len(x))
    while True:
        low = np.where(near, label[None, :], len(x)).min(1)
        if (low == label).all():
            break
        label = low
    root = dict(zip(distinct, label.tolist()))
    return root


def test_simhash_components(spark):
    made = [(r[0], r[1]) for r in rows()]
    want = {}
    for i, (d, t) in enumerate(made):
        w = regex.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        want[i] = (sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)),)
    root = brute_components(want, 4)
    lowest = {}
    for i, (d, _) in enumerate(made):
        if d is not None:
            lowest[root[want[i]]] = min(lowest.get(root[want[i]], d), d)
    out = simhash.near_duplicates(table(spark), 4, 4, ()).collect()
    assert Counter((r.doc_id, r.f0 % (1 << 64), r.component_id) for r in out) == Counter((d, want[i][0], lowest.get(root[want[i]])) for i, (d, _) in enumerate(made))
    assert simhash.near_duplicates(table(spark, []), 4, 4, ()).count() == 0


@pytest.mark.parametrize("chunk", [1024, 7])
def test_links_keep_every_component(spark, chunk):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    x = {int(c) for c in centre}
    for c in centre.tolist():  # chains and stars of close fingerprints, and one dense group
        for _ in range(12 if c != centre[0] else 150):
            c = c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), False)) if rng.random() < 0.5 else c ^ (1 << int(rng.integers(64)))
            x.add(int(c))
    prints = {i: (v,) for i, v in enumerate(sorted(x))}
    members = spark.createDataFrame([(_signed(v),) for (v,) in prints.values()], "f0 bigint")
    edges = simhash.links(members, ["f0"], ["f0"], 4, chunk=chunk)
    got = {r.node: r.root for r in graph.components(edges.select(F.xxhash64("a0").alias("a"), F.xxhash64("b0").alias("b"))).collect()}
    root = brute_components(prints, 4)
    node = {r.f0 % (1 << 64): r.node for r in members.select("f0", F.xxhash64("f0").alias("node")).collect()}
    mine = {v: got.get(node[v[0]], node[v[0]]) for v in root}
    assert len(set(mine.values())) == len(set(root.values())) == len({(mine[v], root[v]) for v in root})


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(200, 200), (300, 301), (301, 300)]
    df = spark.createDataFrame(edges, "x bigint, y bigint").select(F.xxhash64("x").alias("a"), F.xxhash64("y").alias("b"))
    names = {r.h: r.i for r in spark.range(400).select(F.col("id").alias("i"), F.xxhash64("id").alias("h")).collect()}
    groups = {}
    for r in graph.components(df).collect():
        groups.setdefault(r.root, set()).add(names[r.node])
    assert sorted(map(sorted, groups.values())) == [list(range(61)), list(range(100, 150)), [300, 301]]


def test_near_copies_of_real_documents(spark):
    """With the production settings, edits that leave a similarity of 0.8 or more are found and unrelated texts left alone."""
    base = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars between 1500 and 6000").orderBy("doc_id").limit(150).collect()]
    rng, made, similar = np.random.default_rng(1), [], []
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    for d, t in base:
        w = t.split(" ")
        for at in rng.choice(len(w), max(1, len(w) // 80), False):
            w[at] = "edited" + str(at)
        a, b = shingles(t), shingles(" ".join(w))
        made += [(d, t), (d + 100_000, " ".join(w))]
        if len(a & b) >= 0.8 * len(a | b):
            similar.append(d)
    out = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(made, "doc_id bigint, text string")).collect()}
    assert len(similar) > 100 and sum(out[d] == out[d + 100_000] for d in similar) >= 0.95 * len(similar)


def test_similarity_limit_is_kept_on_both_sides(spark):
    """Links are those of a Jaccard similarity of at least 0.8: none under it, and few over it are missed."""
    base = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars between 1500 and 6000").orderBy("doc_id").limit(150).collect()]
    rng, made, near, far = np.random.default_rng(2), [], [], []
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    for k, (d, t) in enumerate(base):
        w = t.split(" ")
        if k % 3 == 0:  # a passage replaced
            m = int(len(w) * (0.08 if k % 2 else 0.15))
            at = int(rng.integers(0, len(w) - m))
            w[at : at + m] = [f"new{k}x{i}" for i in range(m)]
        elif k % 3 == 1:  # the end cut off
            w = w[: int(len(w) * (0.84 if k % 2 else 0.7))]
        else:  # scattered edits
            for i in rng.choice(len(w), len(w) // (45 if k % 2 else 26), False):
                w[i] = f"edited{i}"
        made.append((d + 100_000, " ".join(w)))
        a, b = shingles(t), shingles(" ".join(w))
        share = len(a & b) / len(a | b)
        (near if share >= 0.8 else far).append(d)
    # Over half of the shingles (with repeats) are one phrase, the rest differs: equal fingerprints of unequal texts.
    phrase = "again and again and again " * 40
    made += [(900_001, phrase + " ".join(f"left{i}" for i in range(60))), (900_002, phrase + " ".join(f"right{i}" for i in range(60)))]
    out = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(base + made, "doc_id bigint, text string")).collect()}
    found = sum(out[d] == out[d + 100_000] for d in near)
    print(len(near), found, len(far), sum(out[d] == out[d + 100_000] for d in far))
    assert len(near) > 40 and found >= 0.98 * len(near)
    assert len(far) > 40 and not any(out[d] == out[d + 100_000] for d in far)
    assert out[900_001] != out[900_002]


def test_compared_sets_are_those_of_plain_python():
    rng = np.random.default_rng(4)
    base = rng.choice(9000, 6000, False)
    sets = [base[: int(n)] for n in rng.integers(1, 6000, 40)] + [base[:4], base[:5], np.arange(0), np.arange(0)]
    got = simhash._near_sets([x.astype(np.uint64) for x in sets], 0.8)
    own = [set(x.tolist()) for x in sets]
    assert all(got[i, j] == (i == j or 5 * len(a & b) >= 4 * len(a | b)) for i, a in enumerate(own) for j, b in enumerate(own))
