"""Near duplicates by SimHash and anchor points of a covering code.

Two fingerprints within ``threshold`` bits differ in at most ``threshold // 3`` bits of one of three blocks. On each block
the anchors are the words of a covering code of radius 1 (a [15, 11] Hamming code on the first 15 bits, every value on the
others). A fingerprint goes to every anchor within the radius plus that block threshold, so two such fingerprints meet at
the anchor nearest to either. Each anchor's members are compared in full, and only the links of a spanning forest leave it.

Equal fingerprints are one member. An anchor with more than ``chunk`` members is dealt out as pairs of chunks, so that no
task holds a hot anchor and no two members go uncompared.

With ``search_seeds`` the links of these fingerprints only group the texts; ``verified`` then compares the sets of shingles.

Defined results: a text without words (or null) has fingerprint zero and links like any other; a text with fewer words than
a shingle is one shingle; repeated rows each give a row; a null id is never a component's id unless it has no other; an
empty table gives no rows; a text of any length gives one fingerprint of all its words; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import cut_lineage
from voxlake.llm.graph import components

BLOCKS = ((0, 21), (21, 21), (42, 22))
SEED = 42


def shingle_hashes(text: str | None, n: int, wide: bool = False) -> np.ndarray:
    """One row of 64 bits for each shingle. ``wide``: 128 bits, and one row for each different shingle, in ascending order."""
    import xxhash

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros((0, 1 + wide), np.uint64)
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    first = (ends - lens)[: max(1, len(words) - n + 1)].tolist()
    last = ends[min(n, len(words)) - 1 :].tolist()
    if wide:
        hashes = np.frombuffer(b"".join(xxhash.xxh128_digest(joined[a:b], SEED) for a, b in zip(first, last)), ">u8").astype(np.uint64).reshape(-1, 2)
        return hashes[np.unique(hashes[:, 0], return_index=True)[1]]
    return np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first, last)], np.uint64)[:, None]


def shingle_bits(text: str | None, n: int, wide: bool = False) -> np.ndarray:
    """Words of 64 bits: a bit is 1 if over half of the shingles' hashes have it. ``wide``: 128 bits of the different ones."""
    return _majority(shingle_hashes(text, n, wide))


def word_bits(text: str | None, seeds: tuple[int, ...]) -> np.ndarray:
    """One 64-bit fingerprint of the set of words for each seed: few edits move it little."""
    import xxhash

    words = set((text or "").encode().translate(_LOWER).split())
    if not words:
        return np.zeros(len(seeds), np.uint64)
    return _majority(np.array([[xxhash.xxh64_intdigest(w, s) for s in seeds] for w in words], np.uint64))


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _majority(hashes: np.ndarray) -> np.ndarray:
    ones = np.zeros(64 * hashes.shape[1], np.int64)
    for i in range(0, len(hashes), 4096):
        part = np.ascontiguousarray(hashes[i : i + 4096])
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, words: int, search_seeds: tuple[int, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f0 ..., s0 ...): f are compared; s find them (the same as f without ``search_seeds``, else f has 128 bits).

    With ``search_seeds`` also z0, z1 (a hash of the set of shingles) and size (their number).
    """
    import xxhash

    names = ["f0"] + (["f1", *(f"s{i}" for i in range(len(search_seeds))), "z0", "z1", "size"] if search_seeds else [])

    def wide(text: str | None) -> np.ndarray:
        own = shingle_hashes(text, words, True)
        z = np.frombuffer(xxhash.xxh128_digest(np.ascontiguousarray(own).tobytes()), np.uint64)
        return np.concatenate([_majority(own), word_bits(text, search_seeds), z, np.array([len(own)], np.uint64)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                texts = part.column(1).to_pylist()
                made = np.array([wide(t) if search_seeds else shingle_bits(t, words) for t in texts], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(made[:, i]).view(np.int64)) for i in range(len(names)))], ["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{n} bigint" for n in names))


def _errors(bits: int, radius: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each bit's syndrome, and for each syndrome the changes of at most ``radius`` bits that lead to an anchor."""
    syndrome = np.array([i + 1 if i < 15 else 0 for i in range(bits)], np.uint64)
    lists: list[list[int]] = [[] for _ in range(16)]
    for k in range(radius + 1):
        for at in combinations(range(bits), k):
            lists[int(np.bitwise_xor.reduce(syndrome[list(at)]) if at else 0)].append(sum(1 << i for i in at))
    return syndrome, [np.array(x, np.uint64) for x in lists]


def to_anchors(members: DataFrame, search: list[str], compared: list[str], threshold: int) -> DataFrame:
    """(anchor, f0 ...): each member once at every anchor within the covering radius plus the block threshold."""
    own = [c for c in search if c not in compared]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {bits: _errors(bits, 1 + threshold // len(BLOCKS)) for _, bits in BLOCKS}
        for part in parts:
            column = {n: part.column(i).to_numpy().view(np.uint64) for i, n in enumerate([*compared, *own])}
            for k, name in enumerate(search):
                for b, (low, bits) in enumerate(BLOCKS):
                    piece = column[name] >> np.uint64(low) & np.uint64((1 << bits) - 1)
                    syndrome = np.zeros(len(piece), np.uint64)
                    for i, s in enumerate(tables[bits][0]):
                        syndrome ^= (piece >> np.uint64(i) & np.uint64(1)) * s
                    for s, changes in enumerate(tables[bits][1]):
                        at = np.flatnonzero(syndrome == s)
                        if len(at):
                            anchor = (piece[at][:, None] ^ changes[None, :]).ravel() | np.uint64((k * len(BLOCKS) + b) << 32)
                            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), *(pa.array(np.repeat(column[c][at], len(changes)).view(np.int64)) for c in compared)], ["anchor", *compared])

    return members.select(*compared, *own).mapInArrow(run, "anchor bigint, " + ", ".join(f"{c} bigint" for c in compared))


def _near_bits(x: np.ndarray, threshold: int) -> np.ndarray:
    """Which rows of x differ in at most ``threshold`` bits."""
    return sum(np.bitwise_count(x[:, None, k] ^ x[None, :, k]).astype(np.uint16) for k in range(x.shape[1])) <= threshold


def _near_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sets (arrays of different numbers) have a Jaccard similarity of at least ``similarity``."""
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, at = owner[times[at] > 1], (np.cumsum(times > 1) - 1)[at[times[at] > 1]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        a, b = np.searchsorted(at, [low, low + 4096])
        held = np.zeros((len(sets), min(4096, int(at[b - 1]) + 1 - low)), np.float32)
        held[owner[a:b], at[a:b] - low] = 1
        both += held @ held.T
    np.fill_diagonal(both, size)
    # Whole numbers on both sides, so that 4 of 5 is 0.8.
    near = np.round(both.astype(np.float64) * 1e6) >= np.round(similarity * 1e6) * (size[:, None] + size[None, :] - both)
    return near | np.eye(len(sets), dtype=bool)


def _forest(near: np.ndarray) -> np.ndarray | None:
    """For each row the row that it links to (itself for a root); None without links."""
    if int(near.sum()) == len(near):
        return None
    label = np.arange(len(near))
    while True:
        low = np.where(near, label[None, :], len(near)).min(1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def links(members: DataFrame, search: list[str], compared: list[str], threshold: int, search_threshold: int | None = None, chunk: int = 1024) -> DataFrame:
    """(a0 ..., b0 ...): links of a spanning forest of each anchor's members (all different)."""
    at = to_anchors(members, search, compared, threshold if search_threshold is None else search_threshold)
    hot = cut_lineage(at.groupBy("anchor").count().filter(F.col("count") > chunk))
    dealt = at.join(hot.select("anchor", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")), "anchor", "left")
    own = F.pmod(F.xxhash64(*compared), F.coalesce("chunks", F.lit(1))).cast("int")
    dealt = dealt.select("anchor", *compared, own.alias("c"), F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("o"))
    dealt = dealt.select("anchor", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), *compared)
    w = len(compared)
    names = [f"{s}{i}" for s in "ab" for i in range(w)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in parts:
            rows = np.stack([part.column(i).to_numpy().astype(np.int64) for i in range(3 + w)], 1)
            held = rows if held is None else np.concatenate([held, rows])
            last = int(np.flatnonzero((held[:, :3] != held[-1, :3]).any(1))[-1]) + 1 if (held[:, :3] != held[-1, :3]).any() else 0
            yield from compare(held[:last])
            held = held[last:]
        if held is not None:
            yield from compare(held)

    def compare(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(1)])) if len(rows) else np.zeros(0, int)
        values, out = np.ascontiguousarray(rows[:, 3:]).view(np.uint64), []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
            if b - a > 1:
                x = values[a:b]
                label = _forest(_near_bits(x, threshold))
                if label is not None:
                    at = np.flatnonzero(label != np.arange(b - a))
                    out.append(np.concatenate([x[at], x[label[at]]], 1))
        if out:
            found = np.concatenate(out).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in range(2 * w)], names)

    grouped = dealt.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    return grouped.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


#: Texts and shingles of a group that one task compares with as many others.
SET_CHUNK, SHINGLE_CHUNK = 512, 500_000


def verified(docs: DataFrame, reps: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): links of at least ``similarity`` between texts of a group, enough to connect all that such links connect.

    ``docs`` has n (unique) and text; ``reps`` has n, node, group and size, one row for each different set of shingles.
    Every pair of a group is compared by its sets. A large group is dealt out as pairs of chunks.
    """
    chunks = F.greatest(F.ceil(F.count("*") / SET_CHUNK), F.ceil(F.sum("size") / SHINGLE_CHUNK)).cast("int")
    groups = reps.groupBy("group").agg(F.count("*").alias("members"), chunks.alias("chunks")).filter("members > 1")
    rows = docs.join(cut_lineage(reps.join(groups, "group").select("n", "node", "group", "chunks")), "n").select("text", "node", "group", "chunks")

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(0, part.num_rows, 256):
                some = part.slice(i, 256)
                sets = [np.ascontiguousarray(shingle_hashes(t, words, True)[:, 0]).tobytes() for t in some.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), *some.columns[1:]], ["shingles", "node", "group", "chunks"])

    made = rows.mapInArrow(hashed, "shingles binary, node bigint, group bigint, chunks int")
    dealt = made.withColumn("c", F.pmod("node", "chunks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("group", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "node", "shingles")

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets = None, [], []

        def found() -> Iterator[pa.RecordBatch]:
            label = _forest(_near_sets(sets, similarity)) if len(sets) > 1 else None
            if label is not None:
                at, own = np.flatnonzero(label != np.arange(len(sets))), np.array(nodes, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(own[label[at]])], ["a", "b"])

        for part in parts:
            for k, node, data in zip(zip(*(part.column(c).to_pylist() for c in range(3))), part.column(3).to_pylist(), part.column(4)):
                if k != key:
                    yield from found()
                    key, nodes, sets = k, [], []
                nodes.append(node)
                sets.append(np.frombuffer(data.as_py(), np.uint64))
        yield from found()

    return dealt.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(compare, "a bigint, b bigint")


def _roots(members: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """``members`` with ``name``, the root of their node."""
    roots = components(edges).withColumnRenamed("root", "_root")
    return members.join(roots, "node", "left").withColumn(name, F.coalesce("_root", "node")).drop("_root")


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = 33, search_seeds: tuple[int, ...] = (1, 2), search_threshold: int = 5, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, unique: bool = False) -> DataFrame:
    """(doc_id, f0 ..., component_id): component_id is the smallest id that links lead to, the document's own included.

    Without ``search_seeds`` fingerprints of 64 bits link at ``threshold`` or fewer differing bits, and none is missed up to
    5. With them, documents link if the Jaccard similarity of their sets of shingles is at least ``similarity``. Fingerprints
    only choose what is compared: those of 128 bits at most ``threshold`` bits apart, found through fingerprints of the words
    alone, one for each seed, form groups, and in each group all pairs are compared by their sets. So no link is under
    ``similarity``; a pair over it is missed if its fingerprints fall into different groups. ``unique``: the ids are unique
    whole numbers and ``docs`` gives the same rows each time it is read (else the rows are numbered and written first).
    """
    if not search_seeds:
        prints = cut_lineage(fingerprints(docs, words, (), id_col, text_col))
        members = cut_lineage(prints.groupBy("f0").agg(F.min("doc_id").alias("first")).withColumn("node", F.xxhash64("f0")))
        found = links(members, ["f0"], ["f0"], threshold)
        roots = components(found.select(F.xxhash64("a0").alias("a"), F.xxhash64("b0").alias("b")))
        joined = members.join(roots, "node").select("f0", "first", "root")
        lowest = joined.groupBy("root").agg(F.min("first").alias("low"))
        of = cut_lineage(joined.join(lowest, "root").select("f0", "low"))
        own = members.join(of, "f0", "left").select("f0", F.coalesce("low", "first").alias("component_id"))
        return prints.select("doc_id", "f0").join(own, "f0").select("doc_id", "f0", "component_id")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("n", F.col("id")) if unique else cut_lineage(rows.withColumn("n", F.monotonically_increasing_id()))
    prints = cut_lineage(fingerprints(rows, words, search_seeds, "n", "text").withColumnRenamed("doc_id", "n").withColumn("node", F.xxhash64("z0", "z1")))
    compared, search = ["f0", "f1"], [f"s{i}" for i in range(len(search_seeds))]
    members = cut_lineage(prints.groupBy(*compared).agg(*(F.min(s).alias(s) for s in search)).withColumn("node", F.xxhash64(*compared)))
    ends = [F.xxhash64(*(f"{s}{i}" for i in range(len(compared)))).alias(s) for s in "ab"]
    groups = _roots(members.select("node", *compared), links(members, search, compared, threshold, search_threshold).select(*ends), "group")
    # Equal sets have equal fingerprints, so each set is in one group.
    sets = prints.groupBy("node").agg(*(F.min(c).alias(c) for c in (*compared, "size", "n")))
    reps = cut_lineage(sets.join(groups.drop("node"), compared).select("n", "node", "group", "size"))
    linked = _roots(reps.select("node"), verified(rows.select("n", "text"), reps, words, similarity), "root")
    out = prints.select("n", "node", *compared).join(linked, "node")
    if unique:
        out = out.withColumn("id", F.col("n"))
    else:
        out = out.join(rows.select("n", "id"), "n")
    out = cut_lineage(out.select("id", *compared, "root"))
    lowest = out.groupBy("root").agg(F.min("id").alias("component_id"))
    return out.join(lowest, "root").select(F.col("id").alias("doc_id"), *compared, "component_id")
