"""Exact substring dedup by depth-limited radix sort of suffixes.

Suffixes are ordered only through their first ``depth`` bytes, by passes over digits from the most significant on, and a
suffix that is alone in its group drops out at once; the groups that are left after the last pass are exactly the repeated
windows. So that not every suffix crosses the network, the first pass is over sync points: each window has a smallest hash of
``GRAM`` consecutive bytes in it, at a place that only its content decides, so equal windows share the sync gram and the
distance to it. Windows whose sync gram occurs once in the corpus are alone. For the others the sync points travel with the
bytes around them, all windows of equal grams meet in one task, and the passes over the digits run there.

Later copies of a whole text take no part. A gram with more than ``hot`` sync points isn't brought into one task: its windows are
numbered by 128-bit hashes of all their bytes, and the earliest of each is a grouped minimum with partial sums.

Defined results: a null text is an empty one; order is by id, null ids first, then by text for rows with equal ids; rows equal
in both count as one document and get the result of the first; texts shorter than ``depth`` bytes lose nothing; an empty table
gives no rows; a text of any length is one document, whose sync points alone are sorted; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import batches, cut_lineage, python_rows

GRAM, DIGITS = 24, 4
#: Bits of a gram's hash that travel: rows are smaller, and a chance repeat only means some work in vain.
GRAM_MASK = (1 << 48) - 1
SALT = 0x5DEECE66D
LEAST = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Roller:
    """Hashes of all windows of a byte string; tables of powers grow as texts need."""

    def __init__(self, seed: int = 7):
        self.up, self.down = _powers(1 << 14)
        rng = np.random.default_rng(seed)
        self.byte = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            self.up, self.down = _powers(len(data) * 5 // 4)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.byte[data] * self.up[: len(data)], out=out[1:])
        return out

    def windows(self, sums: np.ndarray, length: int) -> np.ndarray:
        n = len(sums) - length
        h = (sums[length:] - sums[:n]) * self.down[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ h >> np.uint64(29)


def sync_points(roller: Roller, data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, gram hash, first window, last window) of each sync point: the leftmost smallest gram of those windows."""
    gram = roller.windows(roller.sums(data), GRAM)
    order = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    span, low, have = depth - GRAM + 1, order, 1
    while have < span:  # minima over 1, 2, 4 ... grams, then over the span
        step = min(have, span - have)
        low, have = np.minimum(low[: len(low) - step], low[step:]), have + step
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [len(place)]]) - 1
    return place[first], gram[place[first]].view(np.int64), first, last


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def _sync_table(rows: DataFrame, depth: int) -> DataFrame:
    """(k1, gram, place) of every sync point."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for part in parts:
            for lo in range(0, part.num_rows, 256):
                some, out = part.slice(lo, 256), []
                for i, text in enumerate(some.column(1).to_pylist()):
                    data = _bytes(text)
                    if len(data) >= depth:
                        place, gram, _, _ = sync_points(roller, data, depth)
                        out.append((gram, np.full(len(gram), i), place))
                if out:
                    gram, i, place = (np.concatenate(x) for x in zip(*out))
                    k1 = some.column(0).to_numpy(zero_copy_only=False)[i]
                    yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(gram & GRAM_MASK), pa.array(place.astype(np.int32))], ["k1", "gram", "place"])

    return rows.select("k1", "text").mapInArrow(run, "k1 bigint, gram bigint, place int")


_POINT = "k1 bigint, t1 bigint, gram bigint, place int, first int, last int, around binary"


def _contexts(texts: DataFrame, places: DataFrame, depth: int) -> DataFrame:
    """The sync points at ``places``, each with the bytes of all its windows, which begin at ``first`` to ``last``."""
    schema = pa.schema([("k1", pa.int64()), ("t1", pa.int64()), ("gram", pa.int64()), ("place", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("around", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()

        def rows():
            for part in parts:
                for k1, t1, text, wanted in python_rows(part):
                    data, raw = _bytes(text), text.encode()
                    if len(data) < depth:
                        continue
                    place, gram, first, last = sync_points(roller, data, depth)
                    at = np.flatnonzero(np.isin(place, wanted))
                    for p, g, a, b in zip(place[at].tolist(), gram[at].tolist(), first[at].tolist(), last[at].tolist()):
                        yield k1, t1, g, p, a, b, raw[a : b + depth]

        return batches(rows(), schema)

    wanted = places.groupBy("k1").agg(F.collect_list("place").alias("places"))
    return texts.join(wanted, "k1").filter("not copy").select("k1", "t1", "text", "places").mapInArrow(run, _POINT)


def radix_repeats(gram: np.ndarray, shift: np.ndarray, rows: np.ndarray, start: np.ndarray, sums: np.ndarray, roller: Roller, depth: int) -> np.ndarray:
    """Marks of the windows that are not the first of their kind.

    Window i lies in sync point ``rows[i]`` (ordered by position in the corpus), begins at ``start[i]`` of the joined bytes and
    ``shift[i]`` bytes before its sync gram. Groups begin as (gram, shift) and are split by one digit of depth / DIGITS bytes
    after another; windows alone in their group drop out.
    """
    repeated = np.zeros(len(rows), bool)
    alive = np.arange(len(rows))
    group = gram.astype(np.int64) * depth + shift
    digit = depth // DIGITS
    edges = [*range(0, depth - digit + 1, digit)][:DIGITS]
    for k, at in enumerate(edges):
        size = digit if k + 1 < len(edges) else depth - at
        where = start[alive] + at
        value = (sums[where + size] - sums[where]) * roller.down[where]
        order = np.lexsort((value, group))
        g, v = group[order], value[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])]) if len(g) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        shared = np.bincount(number)[number] > 1 if len(g) else new
        alive, group = alive[order[shared]], number[shared]
        if not len(alive):
            return repeated
    order = np.lexsort((rows[alive], group))
    g = group[order]
    repeated[alive[order[np.concatenate([[False], g[1:] == g[:-1]])]]] = True
    return repeated


_RUN = "k1 bigint, t1 bigint, first int, last int"


def _cold(points: DataFrame, depth: int) -> DataFrame:
    """(k1, t1, first, last): runs of windows that are repeats, found by radix passes in tasks that hold whole gram groups."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()

        def solve(t: pa.Table) -> pa.RecordBatch:
            k1, t1, gram, place, first, last = (t.column(i).to_numpy() for i in range(6))
            order = np.lexsort((first, t1, k1))
            k1, t1, gram, place, first, last = (x[order].astype(np.int64) for x in (k1, t1, gram, place, first, last))
            gram = np.unique(gram, return_inverse=True)[1]
            around = t.column(6).to_pylist()
            around = [around[i] for i in order.tolist()]
            lens = np.fromiter(map(len, around), np.int64, len(around))
            begin = np.cumsum(lens) - lens
            data = np.frombuffer(b"".join(around), np.uint8)
            count = last - first + 1
            rows = np.repeat(np.arange(len(k1)), count)
            offset = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
            again = radix_repeats(gram[rows], place[rows] - first[rows] - offset, rows, begin[rows] + offset, roller.sums(data), roller, depth)
            at = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (again[1:] != again[:-1])]))
            stop = np.concatenate([at[1:], [len(rows)]]) - 1
            at, stop = at[again[at]], stop[again[at]]
            r = rows[at]
            return pa.RecordBatch.from_arrays([pa.array(k1[r]), pa.array(t1[r]), pa.array((first[r] + offset[at]).astype(np.int32)), pa.array((first[r] + offset[stop]).astype(np.int32))], ["k1", "t1", "first", "last"])

        held: list[pa.RecordBatch] = []
        for part in parts:
            held.append(part)
            if sum(x.num_rows for x in held) >= 10_000:  # sorted by gram; the last group waits for its other rows
                t = pa.Table.from_batches(held)
                grams = t.column(2).to_numpy()
                cut = int(np.searchsorted(grams, grams[-1]))
                if cut:
                    yield solve(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
        if sum(x.num_rows for x in held):
            yield solve(pa.Table.from_batches(held))

    return points.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, _RUN)


def _hot(points: DataFrame, depth: int) -> DataFrame:
    """The same for grams with very many sync points: a row for each window, grouped by a hash of all its bytes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rollers = Roller(), Roller(8)
        for part in parts:
            for lo in range(0, part.num_rows, 256):
                k1, t1, _, _, first, last, around = part.slice(lo, 256).columns
                hashes = [np.concatenate([r.windows(r.sums(np.frombuffer(x, np.uint8)), depth) for x in around.to_pylist()]).view(np.int64) for r in rollers]
                first, count = first.to_numpy().astype(np.int64), last.to_numpy().astype(np.int64) - first.to_numpy() + 1
                rows = np.repeat(np.arange(len(first)), count)
                at = first[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
                yield pa.RecordBatch.from_arrays([*(pa.array(x.to_numpy()[rows]) for x in (k1, t1)), pa.array(at.astype(np.int32)), *map(pa.array, hashes)], ["k1", "t1", "first", "w1", "w2"])

    windows = points.mapInArrow(run, "k1 bigint, t1 bigint, first int, w1 bigint, w2 bigint")
    origin = windows.groupBy("w1", "w2").agg(F.min(F.struct("k1", "t1", "first")).alias("origin"), F.count("*").alias("n")).filter("n > 1")
    # Keys made anew, so that the join deals both sides itself and can split a hot one.
    origin = origin.select(F.col("w1").bitwiseXOR(SALT).alias("w1"), F.col("w2"), "origin")
    later = windows.withColumn("w1", F.col("w1").bitwiseXOR(SALT)).join(origin, ["w1", "w2"]).filter(F.struct("k1", "t1", "first") > F.col("origin"))
    return later.select("k1", "t1", "first", F.col("first").alias("last"))


def remove_repeats(docs: DataFrame, depth: int = 100, hot: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans): ``spans`` are the removed (start, end) bytes."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LEAST)).alias("k1"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("t1", F.xxhash64("text"))
    # Sync points whose gram occurs again. Only its number travels, so that each side of the join is dealt for it alone.
    points = _sync_table(rows, depth)
    again = points.groupBy("gram").count().filter("count > 1").select(F.col("gram").bitwiseXOR(SALT).alias("gram"), (F.col("count") > hot).alias("hot"))
    shared = cut_lineage(points.withColumn("gram", F.col("gram").bitwiseXOR(SALT)).join(again, "gram").select("k1", "place", "hot"))
    # Later copies of a whole text: they lose all of it, and their windows need no comparison.
    known = rows.select("k1", "t1", F.xxhash64(F.lit("second"), "text").alias("t2"))
    heads = known.groupBy("t1", "t2").agg(F.min("k1").alias("head"), F.count("*").alias("n")).filter("n > 1")
    heads = cut_lineage(heads.select("t1", "t2", "head"))
    copies = cut_lineage(known.join(heads, ["t1", "t2"]).filter("k1 > head").groupBy("k1").agg(F.collect_set("t1").alias("copies")))
    # The texts are dealt once, by id; rows equal in id and text are one.
    texts = rows.repartition("k1").groupBy("k1", "t1").agg(F.first("text").alias("text"), F.count("*").alias("times"))
    texts = texts.join(copies.hint("merge"), "k1", "left").withColumn("copy", F.coalesce(F.array_contains("copies", F.col("t1")), F.lit(False))).drop("copies")
    runs = _cold(_contexts(texts, shared.filter("not hot"), depth), depth).unionByName(_hot(_contexts(texts, shared.filter("hot"), depth), depth))
    gone = runs.groupBy("k1").agg(F.collect_list(F.struct("t1", "first", "last")).alias("runs"))
    out = pa.schema([("doc_id", pa.int64()), ("times", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for part in parts:
                for k1, t1, text, times, copy, found in python_rows(part):
                    raw, spans = text.encode(), []
                    if copy and len(raw) >= depth:
                        found = [{"t1": t1, "first": 0, "last": len(raw) - depth}]
                    for a, b in sorted((r["first"], r["last"] + depth) for r in found or () if r["t1"] == t1):
                        if spans and a <= spans[-1]["end"]:
                            spans[-1]["end"] = max(b, spans[-1]["end"])
                        else:
                            spans.append({"start": a, "end": b})
                    kept = b"".join(raw[a:b] for a, b in zip([0, *(s["end"] for s in spans)], [*(s["start"] for s in spans), len(raw)]))
                    yield None if k1 == LEAST else k1, times, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans

        return batches(each(), out)

    done = texts.join(gone.hint("merge"), "k1", "left").select("k1", "t1", "text", "times", "copy", "runs")
    done = done.mapInArrow(finish, "doc_id bigint, times bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>")
    return done.withColumn("time", F.explode(F.sequence(F.lit(1).cast("bigint"), "times"))).drop("time", "times")
