"""Merkle manifest, quality rules and the conversation trie against plain versions of the same rules."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.data import SCHEMA, rows, table
from voxlake.llm import merkle, quality, queries, trie

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def shown(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    """All levels of a tree over a list of digests, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    """(left, right) siblings of leaf i, level by level."""
    for level in tree[:-1]:
        a = i - i % 16
        yield level[a:i], level[i + 1 : a + 16]
        i //= 16


def plain_manifest(made):
    """Counter of the rows of op11 over (doc_id, text, lang, source, n_chars)."""
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = lambda r, t: sha("".join(map(shown, (r[0], r[3], r[2], r[4], t))))
    groups = defaultdict(list)
    for r in made:
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, low(r[1])) if tampered else None))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = Counter()
    for at, s in enumerate(names):
        for i, (named, doc, own, altered) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = [*siblings(trees[s], i), *siblings(top, at)]
            node = altered or own
            for a, b in path:
                node = sha("".join([*a, node, *b]))
            proof = sha("".join("".join(a) + "".join(b) for a, b in path))
            out[doc if named else None, own, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]] += 1
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("tables")


def run(spark, folder, query, name, made, schema):
    at = folder / f"{query.__name__}-{random.random()}"
    spark.createDataFrame(made, schema).write.parquet(f"{at}/{name}.parquet")
    return query(spark, str(at))


def sized(n, source):
    return [(i, f"Text {i}", "en", source, 6 + len(str(i)), "s", "k", 1) for i in range(n)]


@pytest.mark.parametrize("made", [rows(), sized(700, "hot") + sized(1, None) + sized(17, "a") + sized(256, "Ä"), [x for k in range(40) for x in sized(3, f"s{k}")], sized(1, None), sized(1, "z") * 30], ids=["odd", "sizes", "sources", "one", "equal"])
def test_manifest_is_that_of_the_plain_version(spark, folder, made):
    out = run(spark, folder, queries.op11_merkle_manifest, "documents", made, SCHEMA).collect()
    assert Counter(tuple(r) for r in out) == plain_manifest(made)


def test_manifest_of_an_empty_table(spark, folder):
    assert run(spark, folder, queries.op11_merkle_manifest, "documents", [], SCHEMA).count() == 0


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 256, 257, 700, 4500])
def test_nodes_lie_in_postorder(spark, n):
    leaves = spark.range(n).select(F.struct(F.lit("t").alias("source")).alias("tree"), F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    got = {r.position: (r.level, r["index"], r.digest) for r in merkle.build(leaves, ["id"]).nodes().collect()}
    tree = levels([sha(str(i)) for i in range(n)])
    want = []

    def walk(level, i):
        if level:
            for k in range(16 * i, min(16 * i + 16, len(tree[level - 1]))):
                walk(level - 1, k)
        want.append((level, i, tree[level][i]))

    walk(len(tree) - 1, 0)
    assert got == dict(enumerate(want))


def plain_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    held = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:i] for i, x in enumerate(lines)), len(held)


def plain_quality(made, min_docs, share):
    """For each row: statistics, base_failed, kept, text without the frequent lines."""
    norm = lambda x: re.sub(r"[ \t\r\x0b\x0c]+", " ", re.sub("[1-9]", "0", x.lower())).strip(" ")
    texts, held = defaultdict(set), defaultdict(set)
    for r in made:
        texts[r[3]].add(r[1])
        for x in (r[1] or "").split("\n"):
            held[r[3], norm(x)].add(r[1])
    # A null text is no text that could be counted.
    size = {s: len(t - {None}) for s, t in texts.items()}
    for r in made:
        stats = plain_stats(r[1])
        gone = [bool(norm(x)) and len(held[r[3], norm(x)]) >= max(min_docs, share * size[r[3]]) for x in (r[1] or "").split("\n")]
        lost = sum(len(norm(x).split(" ")) for x, g in zip((r[1] or "").split("\n"), gone) if g)
        failed = stats[0] < 50 or 100 * stats[4] > 50 * stats[0]
        left = "\n".join(x for x, g in zip((r[1] or "").split("\n"), gone) if not g)
        yield r, (*stats, failed, not failed and stats[0] - lost >= 0.5 * stats[0], sum(gone), lost), left


def boiled():
    """Documents of two hosts: one line in all of them, one in a few, some that are little else."""
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    out = []
    for i in range(80):
        lines = [say(40), say(30), "Home | About  us | Page 12" if i % 2 else "home | ABOUT us | page 98"]
        if i % 9 == 0:
            lines = [say(20), say(10), *(f"the notice of the house number {k} says that nothing here may be copied by anyone at all" for k in range(4))]
        out.append((i, "\n".join(lines), "en", "big" if i % 3 else "small", 1, "s", "k", 1))
    return out + [out[9], (81, out[9][1], "en", "big", 1, "s", "k", 1), (200, None, "en", "big", 1, "s", "k", 1)]


@pytest.mark.parametrize("made, limits", [(rows(), (3, 0.01)), (boiled(), (5, 0.01)), (boiled(), (2, 0.2)), ([], (10, 0.01))], ids=["odd", "few", "share", "empty"])
def test_quality_rules(spark, made, limits):
    want = list(plain_quality(made, *limits))
    out = quality.judge(table(spark, made), min_docs=limits[0], share=limits[1]).collect()
    got = Counter((r.doc_id, *(r[s] for s in quality.STATS), r.base_failed, r.kept, r.n_frequent_lines, r.n_words_removed) for r in out)
    assert got == Counter((r[0], *v) for r, v, _ in want)
    left = quality.clean(table(spark, made), min_docs=limits[0], share=limits[1])
    assert left.columns == table(spark, []).columns
    assert Counter((r.doc_id, r.text, r.source) for r in left.collect()) == Counter((r[0], t, r[3]) for r, v, t in want if v[6])


def test_quality_of_very_many_equal_and_null_ids(spark):
    made = [(None, f"{t}\nshared line of the host", "en", None, 1, "s", "k", 1) for _ in range(300) for t in ("x " * 60, "the " + " ".join(f"q{i}" for i in range(70)))]
    got = Counter((r.kept, r.n_frequent_lines) for r in quality.judge(table(spark, made), min_docs=2).collect())
    assert got == {(False, 1): 300, (True, 1): 300}


def test_repeated_words_of_a_long_text():
    words = [str(i) for i in range(30_000)] * 2
    assert quality.repeated_words(words) == 60_000 and quality.repeated_words(["a", "b"]) == 0 and quality.repeated_words(["a"] * 3) == 0 and quality.repeated_words(["a"] * 4) == 4


def plain_trie(paths):
    """Counter of NODE rows over {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = lambda p: sha(",".join(str(c) for c in sorted(members[p]) if len(paths[c]) == len(p)))
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


def conversations(seed, n, deep, kinds):
    rng = random.Random(seed)
    out = {c: [(rng.choice("ua"), rng.choice(kinds)) for _ in range(rng.randrange(deep))] for c in rng.sample(range(3 * n), n)}
    for c in range(3 * n, 3 * n + n // 3):  # a third of them equal
        out[c] = [("u", "hello"), ("a", "ß" * 7)]
    return out


@pytest.mark.parametrize("shards, waiting, sets", [(1, 20_000, (0, 2)), (4, 3, (0,)), (60, 20_000, (1, 3)), (60, 0, (0,))])
def test_trie_is_that_of_the_plain_version(spark, shards, waiting, sets):
    every = [conversations(1, 120, 7, ["", "x", "yy"]), conversations(2, 40, 40, ["long " * 9, "q"]), {5: []}, {7: [("u", "a")]}]
    for paths in (every[k] for k in sets):
        turns = [(c, t, r, x, "k") for c, path in paths.items() for t, (r, x) in enumerate(path)]
        lists = trie.turn_lists(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, key string"))
        empty = spark.createDataFrame([(c, []) for c, p in paths.items() if not p], "conv_id bigint, tokens array<string>")
        out = trie.prefix_trie(lists.unionByName(empty), shards, waiting).collect()
        assert Counter(tuple(r) for r in out) == plain_trie(paths)


def plain_rebuilt(made):
    own = defaultdict(list)
    for c, t, role, text in sorted((r for r in made if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    out = {}
    for c, path in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + path[h:]
    return out


def test_trie_query(spark, folder):
    rng = random.Random(8)
    made = [(c, t, rng.choice(["user", None, "a"]), rng.choice(["", None, "x", "yy zz", "é"])) for c in [*range(0, 330, 3), 100, 1000] for t in range(rng.randrange(1, 9))]
    made = list({(c, t): (c, t, r, x) for c, t, r, x in made}.values())
    made += [(500 + k, None, "user", "no turn") for k in range(5)] + [(None, 0, "user", "nobody")] + [(900, t, "u", "long " * 300) for t in range(300)]
    schema = "conv_id bigint, turn bigint, role string, text string"
    out = run(spark, folder, queries.op13_conversation_trie, "conversations", made, schema).collect()
    assert Counter(tuple(r) for r in out) == plain_trie(plain_rebuilt(made))
    assert run(spark, folder, queries.op13_conversation_trie, "conversations", [], schema).count() == 0


def test_equal_turns_are_rows_of_their_own(spark):
    twice = spark.createDataFrame([(1, 0, "u", "a"), (1, 0, "u", "a"), (2, 0, "u", "a")], "conv_id bigint, turn bigint, role string, text string")
    assert {(r.depth, r.n_convs) for r in trie.prefix_trie(trie.turn_lists(twice)).collect()} == {(0, 2), (1, 2), (2, 1)}
