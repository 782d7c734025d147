"""Connected components of label volumes, object ids, and filters by object size.

A volume is cut into fixed chunks. Inside a chunk the voxels are joined up with array code (a chunk has
a fixed greatest size); pieces that touch across chunk faces become edges, and the edges are contracted
until each piece points at the smallest raster index of its object: whole volumes at a time where they have few
edges, with joins and grouped minima where they have many.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.operators.joins import VOXEL, offset_array, offsets, fact_join
from voxlake.operators.ranks import BUCKETS, bucket_rank
from voxlake.session import cut_lineage, dealt

CHUNK = (16, 128, 128)
CHUNK_COLS = ("cz", "cy", "cx")


def _moves(connectivity: int, planar: bool) -> list[tuple[int, int, int]]:
    half = offsets(connectivity, half=True)
    return [m for m in half if m[0] == 0] if planar else half


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each connected set; each round hooks higher roots to lower ones."""
    parent = np.arange(n)
    while True:
        pa, pb = parent[a], parent[b]
        low, high = np.minimum(pa, pb), np.maximum(pa, pb)
        apart = low != high
        if not apart.any():
            return parent
        a, b = low[apart], high[apart]
        np.minimum.at(parent, b, a)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _groups(pdf: pd.DataFrame, names: Sequence[str]) -> np.ndarray:
    """Number of the run of equal keys that each row belongs to."""
    new = np.zeros(len(pdf), dtype=bool)
    for c in names:
        values = pdf[c].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.cumsum(new)


def _chunk_roots(keys: Sequence[str], moves: Sequence[tuple[int, int, int]], chunk: tuple[int, int, int], carry: Sequence[str] = ()):
    """Iterator function over rows sorted by (keys, chunk): adds the smallest raster index of each piece."""
    group_cols = [*keys, *CHUNK_COLS]
    wide = [c + 2 for c in chunk]

    def label(pdf: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        local = [pdf[a].to_numpy() - pdf[c].to_numpy() * s + 1 for a, c, s in zip(VOXEL, CHUNK_COLS, chunk)]
        code = group.astype(np.int64)
        for part, size in zip(local, wide):
            code = code * size + part
        order = np.argsort(code, kind="stable")
        pdf, code = pdf.iloc[order], code[order]
        value = pdf["label"].to_numpy()
        left, right = [], []
        for dz, dy, dx in moves:
            want = code + (dz * wide[1] + dy) * wide[2] + dx
            at = np.minimum(np.searchsorted(code, want), len(code) - 1)
            hit = np.flatnonzero((code[at] == want) & (value[at] == value))
            left.append(hit)
            right.append(at[hit])
        parent = _roots(len(code), np.concatenate(left), np.concatenate(right))
        return pdf[[*keys, *VOXEL, "label", *carry]].assign(root=pdf["r"].to_numpy()[parent])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            group = _groups(pdf, group_cols)
            open_from = int(np.searchsorted(group, group[-1]))
            held = pdf.iloc[open_from:]
            if open_from:
                yield label(pdf.iloc[:open_from], group[:open_from])
        if held is not None and len(held):
            yield label(held, _groups(held, group_cols))

    return run


def connected_components(
    labels: DataFrame,
    volumes: DataFrame,
    connectivity: int = 3,
    keys: Sequence[str] = ("volume_id",),
    planar: bool = False,
    chunk: tuple[int, int, int] = CHUNK,
    parts: int | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Foreground voxels with ``object_id`` = smallest raster index of their object.

    Equal labels connect. ``connectivity`` counts the axes that may change at once (1, 2, 3 = 6, 18, 26
    neighbours); ``planar`` works slice by slice (1, 2 = 4, 8 neighbours). ``parts`` deals the chunks over so many partitions;
    ``carry`` are more columns of ``labels`` to keep.
    """
    keys = list(keys)
    moves = _moves(connectivity, planar)
    rows = labels
    if not {"ny", "nx"} <= set(labels.columns):
        dims = volumes.select("volume_id", "ny", "nx")
        rows = fact_join(labels.select(*keys, *VOXEL, "label", *carry), dims, ["volume_id"])
    rows = rows.select(
        *keys,
        *VOXEL,
        "label",
        *carry,
        ((F.col("z").cast("bigint") * F.col("ny") + F.col("y")) * F.col("nx") + F.col("x")).alias("r"),
        *[F.floor(F.col(a) / s).cast("int").alias(c) for a, c, s in zip(VOXEL, CHUNK_COLS, chunk)],
    )
    spread = dealt(rows, parts, *keys, *CHUNK_COLS)
    types = dict(labels.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in (*keys, *VOXEL, "label", *carry)], "root bigint"])
    ordered = spread.sortWithinPartitions(*keys, *CHUNK_COLS, *VOXEL)
    pieces = ordered.mapInPandas(_chunk_roots(keys, moves, chunk, carry), schema)
    # Where every volume fits into one chunk, the pieces are the objects: nothing is written or joined.
    over = [F.col(f"n{a}") > size for a, size in zip(VOXEL, chunk) if not (planar and a == "z")]
    if volumes.filter(reduce(or_, over)).isEmpty():
        return pieces.withColumnRenamed("root", "object_id")
    pieces = cut_lineage(pieces)
    edges = cut_lineage(_face_edges(pieces.drop(*carry), volumes, keys, moves, chunk))
    if edges.isEmpty():
        return pieces.withColumnRenamed("root", "object_id")
    links = contract(edges, keys)
    merged = fact_join(pieces, links.withColumnRenamed("u", "root"), [*keys, "root"], "left")
    return merged.select(*keys, *VOXEL, "label", *carry, F.coalesce("m", "root").alias("object_id"))


def _face_edges(pieces: DataFrame, volumes: DataFrame, keys: list[str], moves, chunk) -> DataFrame:
    """Distinct pairs of pieces that touch across a chunk face; only voxels at a face inside their volume take part."""
    rows = fact_join(pieces, volumes.select("volume_id", *(f"n{a}" for a in VOXEL)), ["volume_id"])
    on_face = F.lit(False)
    for axis, size in zip(VOXEL, chunk):
        place, c = F.pmod(F.col(axis), F.lit(size)), F.col(axis)
        on_face = on_face | ((place == 0) & (c > 0)) | ((place == size - 1) & (c < F.col(f"n{axis}") - 1))
    face = rows.filter(on_face)
    step = offset_array(moves, ("dz", "dy", "dx"))
    away = face.select(*keys, *VOXEL, *(f"n{a}" for a in VOXEL), "label", F.col("root").alias("ra"), F.explode(step).alias("m"))
    crosses, inside = F.lit(False), F.lit(True)
    for axis, size in zip(VOXEL, chunk):
        moved = F.col(axis) + F.col(f"m.d{axis}")
        crosses = crosses | (F.floor(F.col(axis) / size) != F.floor(moved / size))
        inside = inside & (moved >= 0) & (moved < F.col(f"n{axis}"))
    reach = away.filter(crosses & inside).select(*keys, *[(F.col(a) + F.col(f"m.d{a}")).alias(a) for a in VOXEL], "label", "ra")
    other = face.select(*keys, *VOXEL, "label", F.col("root").alias("rb"))
    met = reach.join(other, [*keys, *VOXEL, "label"]).filter("ra <> rb")
    return met.select(*keys, F.greatest("ra", "rb").alias("u"), F.least("ra", "rb").alias("v")).distinct()


#: Edges of one key that a task contracts by itself; a key with more is contracted by joins.
EDGES_AT_ONCE = 500_000


def contract(edges: DataFrame, keys: Sequence[str], at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """Edges (u, v) to a map u -> m, m the smallest node of u's connected set; smallest nodes are not in it.

    A key with at most ``at_once`` edges is one group of rows for array code. The others take alternating stars.
    """
    keys = list(keys)
    edges = cut_lineage(edges.select(*keys, "u", "v").filter("u <> v").distinct())
    many = cut_lineage(edges.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > at_once).drop("_n"))
    if many.isEmpty():
        return _contract_groups(edges, keys)
    few = _contract_groups(fact_join(edges, many, keys, "left_anti"), keys)
    return few.unionByName(_contract_stars(fact_join(edges, many, keys, "left_semi"), keys))


def _contract_groups(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The map of ``contract`` for keys with few edges: one shuffle, whole keys side by side."""

    def solved(pdf: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        both = np.concatenate([group, group]), np.concatenate([pdf["u"].to_numpy(), pdf["v"].to_numpy()])
        order = np.lexsort((both[1], both[0]))
        g, node = both[0][order], both[1][order]
        first = np.ones(len(g), bool)
        first[1:] = (g[1:] != g[:-1]) | (node[1:] != node[:-1])
        place = np.empty(len(g), np.int64)
        place[order] = np.cumsum(first) - 1
        parent = _roots(int(first.sum()), place[: len(pdf)], place[len(pdf) :])
        g, node = g[first], node[first]
        at = np.flatnonzero(parent != np.arange(len(parent)))
        heads = np.searchsorted(group, g[at])
        return pdf[keys].iloc[heads].reset_index(drop=True).assign(u=node[at], m=node[parent[at]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if not len(pdf):
                continue
            held = pdf.reset_index(drop=True) if held is None else pd.concat([held, pdf], ignore_index=True)
            group = _groups(held, keys)
            open_from = int(np.searchsorted(group, group[-1]))
            if open_from:
                yield solved(held.iloc[:open_from], group[:open_from])
                held = held.iloc[open_from:].reset_index(drop=True)
        if held is not None and len(held):
            yield solved(held, _groups(held, keys))

    types = dict(edges.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], f"u {types['u']}", f"m {types['u']}"])
    return edges.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def _contract_stars(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The map of ``contract`` by alternating stars.

    Every step is a grouped minimum and a join. A large set ends as one star: its hub is split by skew handling, and the
    node table is never copied.
    """
    edges, mark = cut_lineage(edges), None
    while True:
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = fact_join(both.filter("v > u"), low, [*keys, "u"])
        large = large.select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        tied = fact_join(down, low, [*keys, "u"])
        small = tied.select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = small.unionByName(low.select(*keys, "u", F.col("m").alias("v"))).distinct()
        edges = cut_lineage(small)
        total = edges.agg(F.count("*"), F.bit_xor(F.xxhash64(*keys, "u", "v"))).first()
        if total == mark:
            return edges.select(*keys, "u", F.col("v").alias("m"))
        mark = total


#: Lines (z, y) of a bundle of runs, and the length of the pieces of a line on which runs of two bundles meet.
LINES = (16, 256)
SPAN = 256


def _line_moves(connectivity: int, planar: bool) -> list[tuple[int, int, int]]:
    """(dz, dy, gap): the later lines that touch a line, and how far apart two runs of them may end and begin."""
    moves = [(dz, dy) for dz, dy in ((0, 1), (1, -1), (1, 0), (1, 1)) if abs(dz) + abs(dy) <= connectivity and not (planar and dz)]
    return [(dz, dy, int(abs(dz) + abs(dy) < connectivity)) for dz, dy in moves]


def _run_roots(keys: Sequence[str], moves: Sequence[tuple[int, int, int]], lines: tuple[int, int]):
    """Iterator function over voxel rows sorted by (keys, bundle, z, y, x): runs, with the smallest raster index of their piece."""
    group_cols = [*keys, "cz", "cy"]

    def label(pdf: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        z, y, x, value = (pdf[c].to_numpy().astype(np.int64) for c in (*VOXEL, "label"))
        line = (group * (lines[0] + 2) + z % lines[0] + 1) * (lines[1] + 2) + y % lines[1] + 1
        new = np.ones(len(x), bool)
        new[1:] = (line[1:] != line[:-1]) | (x[1:] != x[:-1] + 1) | (value[1:] != value[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(x)) - 1
        wide = int(x.max()) + 4
        start, end, value = line[first] * wide + x[first] + 1, line[last] * wide + x[last] + 1, value[first]
        left, right = [], []
        for dz, dy, gap in moves:
            # Runs of a line lie in order and apart, so those that a run touches on another line lie side by side.
            step = (dz * (lines[1] + 2) + dy) * wide
            low, high = np.searchsorted(end, start + step - gap), np.searchsorted(start, end + step + gap, "right")
            many = np.maximum(high - low, 0)
            a = np.repeat(np.arange(len(first)), many)
            b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + low[a]
            same = value[a] == value[b]
            left.append(a[same])
            right.append(b[same])
        parent = _roots(len(first), np.concatenate(left), np.concatenate(right))
        rows = pdf.iloc[first]
        return rows[[*keys, "z", "y"]].assign(x0=x[first].astype(np.int32), x1=x[last].astype(np.int32), label=rows["label"], root=rows["r"].to_numpy()[parent])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if not len(pdf):
                continue
            held = pdf.reset_index(drop=True) if held is None else pd.concat([held, pdf], ignore_index=True)
            group = _groups(held, group_cols)
            open_from = int(np.searchsorted(group, group[-1]))
            if open_from:
                yield label(held.iloc[:open_from], group[:open_from])
                held = held.iloc[open_from:].reset_index(drop=True)
        if held is not None and len(held):
            yield label(held, _groups(held, group_cols))

    return run


def object_runs(
    labels: DataFrame, volumes: DataFrame, connectivity: int = 3, keys: Sequence[str] = ("volume_id",), planar: bool = False, lines: tuple[int, int] = LINES
) -> DataFrame:
    """(keys, z, y, x0, x1, label, object_id): ``connected_components`` as runs along x.

    Bundles of lines are joined up by array code, run against run; pieces that touch across bundles are found by an overlap
    join of the runs on the bundles' outer lines. For solid objects there is a row for each line through them, not for each voxel.
    """
    keys = list(keys)
    moves = _line_moves(connectivity, planar)
    sizes = volumes.select("volume_id", *(f"n{a}" for a in VOXEL))
    rows = fact_join(labels.select(*keys, *VOXEL, "label"), sizes, ["volume_id"])
    raster = (F.col("z").cast("bigint") * F.col("ny") + F.col("y")) * F.col("nx") + F.col("x")
    bundle = [F.floor(F.col(a) / s).cast("int").alias(f"c{a}") for a, s in zip("zy", lines)]
    rows = rows.select(*keys, *VOXEL, "label", raster.alias("r"), *bundle)
    types = dict(labels.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "z int, y int, x0 int, x1 int", f"label {types['label']}", "root bigint"])
    ordered = rows.repartition(*keys, "cz", "cy").sortWithinPartitions(*keys, "cz", "cy", *VOXEL)
    pieces = ordered.mapInPandas(_run_roots(keys, moves, lines), schema)
    over = F.col("ny") > lines[1] if planar else (F.col("nz") > lines[0]) | (F.col("ny") > lines[1])
    if volumes.filter(over).isEmpty():
        return pieces.withColumnRenamed("root", "object_id")
    pieces = cut_lineage(pieces)
    edges = cut_lineage(_line_edges(pieces, sizes, keys, moves, lines))
    if edges.isEmpty():
        return pieces.withColumnRenamed("root", "object_id")
    merged = fact_join(pieces, contract(edges, keys).withColumnRenamed("u", "root"), [*keys, "root"], "left")
    return merged.select(*keys, "z", "y", "x0", "x1", "label", F.coalesce("m", "root").alias("object_id"))


def spans(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """Runs once for each piece of a line, of ``SPAN`` cells, that they reach into (``span``): overlaps become equal keys."""
    return rows.withColumn("span", F.explode(F.sequence(F.floor(low / SPAN), F.floor(high / SPAN))))


def _line_edges(pieces: DataFrame, sizes: DataFrame, keys: list[str], moves, lines: tuple[int, int]) -> DataFrame:
    """Distinct pairs of pieces whose runs touch across bundles."""
    rows = fact_join(pieces, sizes, ["volume_id"])
    outer, crosses, inside = F.lit(False), F.lit(False), F.lit(True)
    for a, size in zip("zy", lines):
        place, moved = F.pmod(F.col(a), F.lit(size)), F.col(a) + F.col(f"m.d{a}")
        outer = outer | ((place == 0) & (F.col(a) > 0)) | ((place == size - 1) & (F.col(a) < F.col(f"n{a}") - 1))
        crosses = crosses | (F.floor(F.col(a) / size) != F.floor(moved / size))
        inside = inside & (moved >= 0) & (moved < F.col(f"n{a}"))
    face = cut_lineage(rows.filter(outer))
    away = face.withColumn("m", F.explode(offset_array(moves, ("dz", "dy", "gap")))).filter(crosses & inside)
    away = away.select(*keys, *((F.col(a) + F.col(f"m.d{a}")).alias(a) for a in "zy"), "label", F.col("root").alias("ra"), F.greatest(F.col("x0") - F.col("m.gap"), F.lit(0)).alias("a0"), (F.col("x1") + F.col("m.gap")).alias("a1"))
    other = face.select(*keys, "z", "y", "label", F.col("root").alias("rb"), "x0", "x1")
    met = spans(away, F.col("a0"), F.col("a1")).join(spans(other, F.col("x0"), F.col("x1")), [*keys, "z", "y", "label", "span"])
    met = met.filter("a0 <= x1 and x0 <= a1 and ra <> rb")
    return met.select(*keys, F.greatest("ra", "rb").alias("u"), F.least("ra", "rb").alias("v")).distinct()


def object_table(components: DataFrame, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """One row per object: voxel count, label and bounding box."""
    return components.groupBy(*keys, "object_id").agg(
        F.count("*").alias("area"),
        F.min("label").alias("label"),
        *[f(a).alias(f"{n}_{a}") for a in VOXEL for f, n in ((F.min, "min"), (F.max, "max"))],
    )


def object_numbers(objects: DataFrame, volumes: DataFrame, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Objects numbered 1..n in raster order inside each volume, as an array library would."""
    size = volumes.select("volume_id", (F.col("nz").cast("bigint") * F.col("ny") * F.col("nx")).alias("_size"))
    rows = fact_join(objects, size, ["volume_id"])
    bucket = F.floor(F.col("object_id") / F.col("_size") * BUCKETS)
    return bucket_rank(rows, keys, bucket, [F.col("object_id")], "number").drop("_size")


def remove_small(
    labels: DataFrame, volumes: DataFrame, max_size: float, by: str = "component", keys: Sequence[str] = ("volume_id",), connectivity: int = 1
) -> DataFrame:
    """Drop objects of at most ``max_size`` voxels: face-connected components, or whole label values."""
    if by not in ("component", "label"):
        raise ValueError("by must be 'component' or 'label'")
    rows = labels
    name = "label"
    if by == "component":
        rows = connected_components(labels, volumes, connectivity, keys)
        name = "object_id"
    kept = rows.groupBy(*keys, name).agg(F.count("*").alias("_n")).filter(F.col("_n") > max_size).drop("_n")
    return fact_join(rows, kept, [*keys, name], "left_semi").select(*keys, *VOXEL, "label")


def largest_component(
    labels: DataFrame, volumes: DataFrame, connectivity: int = 3, keys: Sequence[str] = ("volume_id",)
) -> DataFrame:
    """The biggest object of each volume; the earlier one in raster order wins a tie."""
    comp = connected_components(labels, volumes, connectivity, keys)
    sizes = comp.groupBy(*keys, "object_id").agg(F.count("*").alias("n"))
    best = sizes.groupBy(*keys).agg(F.min(F.struct(-F.col("n"), "object_id")).alias("b"))
    best = best.select(*keys, F.col("b.object_id").alias("object_id"))
    return fact_join(comp, best, [*keys, "object_id"], "left_semi")
