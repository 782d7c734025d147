"""The prefix trie of conversations by sorted shards and a skeleton of splitter paths.

A conversation is the path of its turns, each a token of fixed width (128 bits of role and text, 32 bits of the text's
length), so that paths sort as bytes and a prefix is a prefix of the bytes. Equal paths are one row with a number of members.
Splitter paths, drawn evenly from a bounded sample and cut to ``SPLITTER_TURNS`` turns, part the sorted order into shards;
the trie of the splitters (the skeleton, at most ``SHARDS`` x ``SPLITTER_TURNS`` nodes) is broadcast. A node that is no prefix
of a splitter has all its members inside one shard, which finishes it in one pass over its sorted paths, holding one path of
open nodes at a time. Nodes of the skeleton are finished by reduction: each shard sends one partial aggregate for each of its
own, and these are summed over the shards and up the skeleton.

A node's row names its parent's smallest member, known when the parent closes. Rows under an open node wait for it; when more
than ``WAITING`` wait in all, or the parent is in the skeleton, they are written with the parent's key and joined with it
afterwards.

Defined results: rows without a conversation id belong to none and are left out; a null role or text is empty; turns are
ordered by number (null first), those with equal numbers by a hash of role and text; a conversation without turns is a member
of the root alone; conversations with equal turns share all nodes; an empty table has no nodes, not even a root; texts of any
length are only hashed; extra columns are ignored. One conversation's tokens (20 bytes a turn) are held by a task at a time,
and so are the open nodes of one path; groups of conversations never are. The ids under one path are hashed in a stream.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm.common import batches, cut_lineage, num_partitions, python_rows
from voxlake.operators.joins import fact_join

#: Bytes of a turn in a path: 16 of a hash, 4 of the length of the text.
TOKEN = 20
SHARDS = 4096
SPLITTER_TURNS = 16
#: Paths sampled for each splitter.
DRAWN = 16
WAITING = 20_000

NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Kinds of rows that a shard writes.
DONE, PENDING, PARENT, PARTIAL = range(4)
SHARD_ROWS = "kind int, node binary, " + NODE
SHARD_SCHEMA = pa.schema([("kind", pa.int32()), ("node", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())])


def turn_token(role: Column, text: Column) -> Column:
    """A turn as 40 hex digits."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.concat(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)), F.lpad(F.lower(F.hex(F.length(text))), 8, "0"))


def turn_lists(turns: DataFrame) -> DataFrame:
    """(conv_id, tokens) from (conv_id, turn, role, text): each conversation's turns in their order."""
    one = turns.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", turn_token(F.col("role"), F.col("text")).alias("token"))
    return one.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "token"))).alias("t")).select("conv_id", F.col("t.token").alias("tokens"))


def distinct_paths(lists: DataFrame) -> DataFrame:
    """(path, n, conv_id, ends) from (conv_id, tokens): each path once, its members' number, smallest id and the hash of all ids."""
    paths = cut_lineage(lists.select("conv_id", F.unhex(F.array_join("tokens", "")).alias("path")).withColumn("key", F.md5("path")))
    whole = paths.groupBy("key").agg(F.first("path").alias("path"))
    schema = pa.schema([("key", pa.string()), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())])

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[tuple]:
            key = sha = None
            n = first = 0
            for part in parts:
                for k, c in python_rows(part):
                    if k != key:
                        if sha is not None:
                            yield key, n, first, sha.hexdigest()
                        key, sha, n, first = k, hashlib.sha256(b"%d" % c), 1, c
                    else:
                        sha.update(b",%d" % c)
                        n += 1
            if sha is not None:
                yield key, n, first, sha.hexdigest()

        return batches(groups(), schema)

    ids = paths.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    members = ids.mapInArrow(hashed, "key string, n bigint, conv_id bigint, ends string")
    return cut_lineage(whole.join(members, "key").select("path", "n", "conv_id", "ends"))


def splitters(paths: DataFrame, shards: int, turns: int = SPLITTER_TURNS) -> list[bytes]:
    """At most ``shards`` - 1 evenly drawn paths, cut to ``turns`` turns, in order."""
    rows = paths.count()
    if shards < 2 or rows < 2:
        return []
    # A hash of the path decides, so the sample is the same whenever it is drawn.
    rate = min(1.0, DRAWN * shards / rows)
    unit = F.conv(F.substring(F.md5(F.concat(F.lit("draw"), "path")), 1, 8), 16, 10).cast("double") / 2.0**32
    drawn = paths.filter(unit < rate).select(F.substring("path", 1, turns * TOKEN).alias("path"))
    cuts = drawn.agg(F.sort_array(F.collect_list("path")).alias("p")).select(F.expr(f"filter(p, (x, i) -> i > 0 and i % ceil(size(p) / {shards}) = 0)").alias("cuts"))
    return sorted({bytes(c) for c in cuts.first().cuts})


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    n = min(len(a), len(b)) // TOKEN
    if a[: n * TOKEN] == b[: n * TOKEN]:
        return n
    low, high = 0, n - 1
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * TOKEN] == b[: mid * TOKEN] else (low, mid - 1)
    return low


class _Node:
    """An open node: its path's length in turns, what it has gathered, and the rows that wait for its smallest member."""

    __slots__ = ("depth", "key", "length", "conv", "n", "children", "leaves", "saved", "ends", "waiting", "wide")

    def __init__(self, depth: int, path: bytes):
        self.depth, self.key, self.length = depth, path[: depth * TOKEN], int.from_bytes(path[depth * TOKEN - 4 : depth * TOKEN], "big") if depth else 0
        self.conv, self.n, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, 0, NO_ENDS
        self.waiting: list[tuple] = []
        self.wide = False

    def gather(self, n: int, conv: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None else min(conv, self.conv)

    def adopt(self, child: _Node) -> None:
        self.gather(child.n, child.conv)
        self.children += 1
        self.leaves += child.leaves
        self.saved += child.saved


def node_key(path: bytes) -> bytes:
    return hashlib.md5(path).digest()


def finish_shard(paths: Iterator[tuple], skeleton: Sequence[bytes], shard: int, waiting: int = WAITING) -> Iterator[tuple]:
    """Rows of ``SHARD_ROWS`` from a shard's (path, n, conv_id, ends) in order; ``skeleton`` are all splitters, in order."""
    # Of all splitters the two around a shard have the longest common prefixes with its paths.
    around = [*skeleton[max(shard - 1, 0) : shard], *skeleton[shard : shard + 1]]
    bones: dict[bytes, _Node] = {}
    open_nodes: list[_Node] = []
    held = 0

    def bone(path: bytes, depth: int) -> _Node:
        key = path[: depth * TOKEN]
        if key not in bones:
            bones[key] = _Node(depth, path)
        return bones[key]

    def row(kind: int, node: bytes | None, x: _Node, parent: int | None) -> tuple:
        return kind, node, x.conv, x.depth, parent, x.n, x.children, x.leaves, x.saved, x.ends

    def close() -> Iterator[tuple]:
        nonlocal held
        x = open_nodes.pop()
        held -= len(x.waiting)
        x.saved += (x.n - 1) * x.length
        x.leaves = x.leaves or 1
        for r in x.waiting:
            yield (DONE, None, r[2], r[3], x.conv, *r[5:])
        if x.wide:
            yield row(PARENT, node_key(x.key), x, None)
        own = row(DONE, None, x, None)
        if not open_nodes:
            parent = bone(x.key, x.depth - 1)
            yield (PENDING, node_key(parent.key), *own[2:])
        else:
            parent = open_nodes[-1]
            parent.waiting.append(own)
            held += 1
            if held > waiting:
                for y in open_nodes:
                    key, y.wide = node_key(y.key), y.wide or bool(y.waiting)
                    for r in y.waiting:
                        yield (PENDING, key, *r[2:])
                    y.waiting = []
                held = 0
        parent.adopt(x)

    before = b""
    for path, n, conv, ends in paths:
        deep = len(path) // TOKEN
        inside = max((common_turns(path, s) for s in around), default=0)
        shared = common_turns(before, path)
        while open_nodes and open_nodes[-1].depth > shared:
            yield from close()
        for depth in range(max(shared, inside) + 1, deep + 1):
            open_nodes.append(_Node(depth, path))
        last = bone(path, deep) if deep <= inside else open_nodes[-1]
        last.gather(n, conv)
        last.ends = ends
        before = path
    while open_nodes:
        yield from close()
    for x in bones.values():
        yield (PARTIAL, x.key, x.conv, x.depth, None, x.n, x.children, x.leaves, x.saved, x.ends)


def shard_rows(paths: DataFrame, cuts: list[bytes], waiting: int = WAITING) -> DataFrame:
    """``SHARD_ROWS`` of all shards."""
    spark = paths.sparkSession
    held = spark.sparkContext.broadcast(cuts)
    schema = pa.schema([("shard", pa.int32()), ("path", pa.binary()), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())])

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            shard = [bisect.bisect_right(held.value, p) for p in part.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *(part.column(f.name).cast(f.type) for f in list(schema)[1:])], schema=schema)

    def finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shards() -> Iterator[tuple]:
            rows = (r for part in parts for r in python_rows(part))
            ahead = next(rows, None)

            def one(shard: int) -> Iterator[tuple]:
                nonlocal ahead
                while ahead is not None and ahead[0] == shard:
                    now, ahead = ahead, next(rows, None)
                    yield now[1:]

            while ahead is not None:
                yield from finish_shard(one(ahead[0]), held.value, ahead[0], waiting)

        return batches(shards(), SHARD_SCHEMA)

    dealt = paths.mapInArrow(deal, "shard int, path binary, n bigint, conv_id bigint, ends string")
    sorted_ = dealt.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "path")
    out = cut_lineage(sorted_.mapInArrow(finish, SHARD_ROWS))
    held.unpersist()
    return out


def finish_skeleton(partials: DataFrame) -> DataFrame:
    """(node, columns of ``NODE``) of the skeleton's nodes, from the shards' partial aggregates."""
    prefix = lambda d: F.expr(f"substring(node, 1, {TOKEN} * {d})")
    up = partials.withColumn("d", F.explode(F.expr("sequence(0, depth)")))
    mine = lambda c: F.sum(F.when(F.col("d") == F.col("depth"), F.col(c)).otherwise(0)).alias(c)
    ends = F.max(F.when((F.col("d") == F.col("depth")) & (F.col("ends_sha256") != NO_ENDS), F.col("ends_sha256"))).alias("ends_sha256")
    bones = cut_lineage(up.groupBy(F.col("d").alias("depth"), prefix("d").alias("node")).agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), mine("n_children"), mine("n_leaves"), mine("saved_tokens"), ends))
    inner = bones.filter("depth > 0").groupBy(F.expr(f"substring(node, 1, {TOKEN} * (depth - 1))").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("inner"))
    bones = bones.join(inner, ["node", "depth"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("inner", F.lit(0)))
    length = F.conv(F.hex(F.expr("substring(node, -4, 4)")), 16, 10).cast("bigint")
    bones = bones.withColumn("saved_tokens", F.col("saved_tokens") + F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * length).otherwise(0))
    bones = cut_lineage(bones.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves"))))
    sums = bones.select("node", "depth", "n_leaves", "saved_tokens", F.explode(F.expr("sequence(0, depth)")).alias("d"))
    sums = sums.groupBy(F.col("d").alias("depth"), prefix("d").alias("node")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    parents = bones.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = bones.drop("n_leaves", "saved_tokens", "inner").join(sums, ["node", "depth"])
    out = out.withColumn("parent", F.when(F.col("depth") > 0, F.expr(f"substring(node, 1, {TOKEN} * (depth - 1))"))).join(parents, ["parent", "depth"], "left")
    return cut_lineage(out.select("node", "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))


def prefix_trie(lists: DataFrame, shards: int | None = None, waiting: int = WAITING) -> DataFrame:
    """One row of ``NODE`` for each node of the trie over (conv_id, tokens)."""
    spark: SparkSession = lists.sparkSession
    paths = distinct_paths(lists)
    rows = shard_rows(paths, splitters(paths, min(shards or num_partitions(spark), SHARDS)), waiting)
    skeleton = finish_skeleton(rows.filter(F.col("kind") == PARTIAL))
    names = [c.split()[0] for c in NODE.split(", ")]
    parents = skeleton.select(F.unhex(F.md5("node")).alias("node"), "conv_id").unionByName(rows.filter(F.col("kind") == PARENT).select("node", "conv_id"))
    pending = fact_join(rows.filter(F.col("kind") == PENDING).drop("parent_conv_id"), parents.withColumnRenamed("conv_id", "parent_conv_id"), ["node"])
    return rows.filter(F.col("kind") == DONE).select(names).unionByName(pending.select(names)).unionByName(skeleton.select(names))
