"""Merkle manifest of a dataset as a postorder append log, in DataFrame operations only.

A tree of fan-out 16 stands over the leaves of each group, in their order; a tree of the groups' roots stands over these.
Leaves are numbered by range partitions, so a group that holds a third of all rows is numbered by many tasks. Each builder
takes an aligned block of 256 nodes of one level and closes the two levels above them, appending every node when its last
child is there: children, then their parent (postorder). A round of builders closes two levels, so ten thousand million
leaves take five rounds, each on a 256th of the rows before it.

Positions in the log need no index. A subtree is complete before anything after it is written, so the node of a level whose
last leaf is e lies at e + e/16 + e/256 + ... + level (whole quotients, ``position``). The same holds inside a builder's
segment, and there it addresses the siblings of a proof: the 15 others of a run lie side by side, the parents 17 places apart.

Defined results: a null field counts as ``-``; a null group is a group, the first one; null ids come first; rows with equal
ids are ordered by their digest, and equal rows are leaves of their own; a null or empty text is a leaf like any other and a
long one is only hashed, never moved; an empty table has no rows, and no root; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.common import cut_lineage, num_partitions
from voxlake.operators.joins import fact_join

FAN = 16
#: Levels that one builder closes, and the nodes it starts from.
CLOSES = 2
BLOCK = FAN**CLOSES
#: Hex digits of a digest.
WIDE = 64


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field as its UTF-8 byte count, a colon and its value, or ``-`` if null."""
    shown = [f.cast("string") for f in fields]
    return digest(*(F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for s in shown))


def height(n: Column) -> Column:
    """Levels above ``n`` leaves: the least h with 16^h >= n."""
    return F.when(n > 1, F.length(F.hex(n - 1))).otherwise(0)


def position(level: Column, index: Column, n: Column, top: int = 15) -> Column:
    """Place in the postorder log of the ``index``-th node of ``level`` over ``n`` leaves."""
    last = F.least((index + 1) * F.pow(F.lit(FAN), level).cast("bigint"), n) - 1
    closed = sum((F.floor(last / F.lit(FAN**k)) for k in range(1, top)), F.lit(0))
    return (last + closed + level).cast("bigint")


@dataclass
class Manifest:
    """The log of one forest. ``segments[r]`` holds the builders' segments of round r:

    tree, n (leaves of the tree), h (its height), base (level of the segment's lowest nodes), block (its place among the
    segments of that base), items (array of index and, in round 0, the leaves' other columns), log (digests in postorder),
    top (the last of them).
    """

    segments: list[DataFrame]

    def roots(self) -> DataFrame:
        """(tree, n, h, root), one row for each tree."""
        done = [s.filter(_last(s)).select("tree", "n", "h", F.col("top").alias("root")) for s in self.segments]
        out = done[0]
        for d in done[1:]:
            out = out.unionByName(d)
        return out

    def nodes(self) -> DataFrame:
        """(tree, position, level, index, digest): the whole append log, a row for each node."""
        parts = []
        for r, seg in enumerate(self.segments):
            m = F.size("items")
            closed = F.least(F.lit(CLOSES), F.col("h") - F.col("base"))
            levels = [F.struct(F.lit(0).alias("up"), F.lit(1).alias("span"))] if r == 0 else []
            levels += [F.struct(F.lit(k).alias("up"), F.lit(FAN**k).alias("span")) for k in range(1, CLOSES + 1)]
            each = seg.withColumn("m", m).withColumn("l", F.explode(F.array(*levels))).filter(F.col("l.up") <= closed)
            each = each.withColumn("i", F.explode(F.expr("sequence(0, int((m - 1) div l.span))")))
            last = F.least((F.col("i") + 1) * F.col("l.span"), F.col("m")) - 1
            at = last + F.floor(last / FAN) + F.col("l.up")
            level, index = F.col("base") + F.col("l.up"), F.col("block") * (BLOCK / F.col("l.span")).cast("bigint") + F.col("i")
            parts.append(each.select("tree", position(level, index, F.col("n")).alias("position"), level.alias("level"), index.alias("index"), F.substr("log", (at * WIDE + 1).cast("int"), F.lit(WIDE)).alias("digest")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def _last(seg: DataFrame) -> Column:
    """Whether a segment closes its tree."""
    return seg["h"] <= seg["base"] + CLOSES


def numbered(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``index``, their place (from 0) in their tree by ``order``, nulls first, and ``n``, the tree's rows.

    Equal rows are dealt to several range partitions too, by a number of their own.
    """
    own = cut_lineage(rows).withColumn("_row", F.monotonically_increasing_id())
    by = [tree, *order, "_row"]
    placed = own.repartitionByRange(num_partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    placed = cut_lineage(placed.drop("_row").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    # Inside a partition the rows of a tree lie side by side; the window runs over one row for each partition that has some.
    parts = placed.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    over = Window.partitionBy(tree)
    before = F.sum("_n").over(over.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    starts = parts.select(tree, "_part", (F.col("_first") - before).alias("_shift"), F.sum("_n").over(over).alias("n"))
    joined = fact_join(placed, starts, [tree, "_part"])
    return joined.withColumn("index", F.col("_at") - F.col("_shift")).drop("_at", "_part", "_shift")


def build(rows: DataFrame, order: Sequence[str], kept: Sequence[str] = ()) -> Manifest:
    """The manifest of ``rows`` (tree, digest, the ``order`` and ``kept`` columns); segments keep the latter beside the leaves."""
    nodes = numbered(rows.select(*dict.fromkeys(["tree", "digest", *order, *kept])), "tree", order)
    nodes = nodes.select("tree", "n", height(F.col("n")).alias("h"), "index", "digest", *kept)
    segments: list[DataFrame] = []
    while True:
        base = CLOSES * len(segments)
        segments.append(cut_lineage(_close(nodes, base, kept if base == 0 else ())))
        rest = segments[-1].filter(~_last(segments[-1]))
        if rest.isEmpty():
            return Manifest(segments)
        nodes = rest.select("tree", "n", "h", F.col("block").alias("index"), F.col("top").alias("digest"))


def _close(nodes: DataFrame, base: int, kept: Sequence[str]) -> DataFrame:
    """One segment for each aligned block of nodes of level ``base``."""
    item = F.struct("index", "digest", *kept)
    grouped = nodes.groupBy("tree", "n", "h", F.expr(f"index div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    own = grouped.withColumn("own", F.col("items.digest"))
    # Complete runs get their parent right behind them.
    runs = own.withColumn("runs", F.expr(f"transform(sequence(0, int((size(own) - 1) div {FAN})), j -> array_join(slice(own, j * {FAN} + 1, {FAN}), ''))"))
    runs = runs.withColumn("first", F.when(F.col("h") > base, F.transform("runs", lambda r: F.sha2(r, 256))).otherwise(F.array().cast("array<string>")))
    runs = runs.withColumn("second", F.when(F.col("h") > base + 1, F.sha2(F.array_join("first", ""), 256)).otherwise(F.lit("")))
    log = F.concat(F.array_join(F.zip_with("runs", "first", lambda r, p: F.concat(r, F.coalesce(p, F.lit("")))), ""), F.col("second"))
    seg = runs.select("tree", "n", "h", F.lit(base).alias("base"), "block", F.transform("items", lambda i: i.dropFields("digest")).alias("items"), log.alias("log"))
    return seg.withColumn("top", F.substr("log", F.length("log") - F.lit(WIDE - 1), F.lit(WIDE)))


def proofs(made: Manifest, tops: DataFrame) -> DataFrame:
    """(tree, kept columns, index, digest, path, columns of ``tops``) for each leaf.

    ``path`` holds, level by level, the digests of the node's siblings to the left and to the right as two strings. ``tops``
    (tree, path, more) has the path above each tree's root.
    """
    more = [c for c in tops.columns if c not in ("tree", "path")]
    upper = None
    for r in range(len(made.segments) - 1, -1, -1):
        seg = made.segments[r]
        ends = seg.filter(_last(seg)).join(tops, "tree")
        if upper is not None:
            ends = ends.unionByName(seg.filter(~_last(seg)).join(upper, ["tree", "block"]))
        upper = _paths(ends, more)
        if r:
            upper = cut_lineage(upper.select("tree", F.col("item.index").alias("block"), "path", *more))
    names = [f.name for f in made.segments[0].schema["items"].dataType.elementType.fields]
    return upper.select("tree", *(F.col(f"item.{c}").alias(c) for c in names), "digest", "path", *more)


def _paths(segments: DataFrame, more: Sequence[str]) -> DataFrame:
    """The nodes of each segment's lowest level (tree, item, digest, path): their siblings, by position, before ``path``."""
    runs = segments.withColumns({"m": F.size("items"), "closed": F.least(F.lit(CLOSES), F.col("h") - F.col("base"))})
    runs = runs.select("*", F.explode(F.expr(f"sequence(0, int((m - 1) div {FAN}))")).alias("j"))
    # The j-th parent's last child is the least of 16j + 15 and m - 1, and the parent lies behind it.
    parent = f"substr(log, (least({FAN} * x + {FAN - 1}, m - 1) + int(least({FAN} * x + {FAN - 1}, m - 1) div {FAN}) + 1) * {WIDE} + 1, {WIDE})"
    side = lambda sign: F.expr(f"array_join(transform(filter(sequence(0, int((m - 1) div {FAN})), x -> x {sign} j), x -> {parent}), '')")
    pair = lambda a, b: F.struct(a.alias("before"), b.alias("after"))
    above = F.when(F.col("closed") > 1, F.array(pair(side("<"), side(">")))).otherwise(F.expr("cast(array() as array<struct<before string, after string>>)"))
    runs = runs.select(
        "tree", "closed", F.slice("items", F.col("j") * FAN + 1, F.lit(FAN)).alias("items"), F.concat(above, "path").alias("path"), *more,
        F.substr("log", F.col("j") * ((FAN + 1) * WIDE) + 1, F.least(F.lit(FAN), F.col("m") - F.col("j") * FAN) * WIDE).alias("own"),
    )
    one = runs.select("tree", "closed", "path", "own", *more, F.posexplode("items").alias("i", "item"))
    left, right = F.substr("own", F.lit(1), F.col("i") * WIDE), F.substr("own", (F.col("i") + 1) * WIDE + 1, F.lit(FAN * WIDE))
    path = F.when(F.col("closed") > 0, F.concat(F.array(pair(left, right)), "path")).otherwise(F.col("path"))
    return one.select("tree", "item", F.substr("own", F.col("i") * WIDE + 1, F.lit(WIDE)).alias("digest"), path.alias("path"), *more)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, start, lambda node, s: digest(s["before"], node, s["after"]))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(rows: DataFrame, order: Sequence[str], kept: Sequence[str] = ()) -> tuple[Manifest, Manifest]:
    """The manifests of the groups (``tree``, a struct of the group's columns) and of the groups' roots, in their order."""
    groups = build(rows, order, kept)
    subroots = groups.roots().select(F.struct(F.lit(0).alias("all")).alias("tree"), F.col("tree").alias("group"), F.col("root").alias("digest"))
    return groups, build(subroots, ["group"], ["group"])


def all_proofs(groups: Manifest, whole: Manifest) -> DataFrame:
    """``proofs`` of all leaves up to the one root, with ``subroot`` and ``root``."""
    none = F.expr("cast(array() as array<struct<before string, after string>>)")
    root = whole.roots().select("tree", none.alias("path"), "root")
    above = proofs(whole, root).select(F.col("group").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    return proofs(groups, cut_lineage(above))
