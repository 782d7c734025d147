"""Superpixels of each slice: a minimum spanning forest that grows until its trees differ too much.

Pixels are nodes, neighbours in a slice are edges, and an edge weighs the difference of the two blurred values. In a round every
component proposes its least edge; the edge is taken if it weighs less than what either side allows, which is the greatest
weight inside the component plus ``scale`` over its size. Taken edges merge components, the edges between two components become
one, and the next round starts from these. Slices that fit a task go through all rounds in one visit, after one shuffle of the
voxels. For larger ones a round is a grouped minimum, joins with one row for each component, and a contraction of the taken
edges; no task sees such a slice, and each round has fewer rows than the one before it.

Components under ``min_size`` then take their least edge whatever it weighs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.operators import chunks as ch
from voxlake.operators import whole as wh
from voxlake.operators.chunks import Three
from voxlake.operators.components import _roots, contract
from voxlake.operators.joins import VOXEL, fact_join, voxel_grid
from voxlake.operators.lines import gaussian_kernel
from voxlake.session import cut_lineage
from voxlake.sources.volumes import CHUNK_SHAPE

KEYS = ("volume_id", "z")
#: Half of the eight neighbours of a pixel (y, x).
HALF = ((0, 1), (1, -1), (1, 0), (1, 1))


def _differences(kernel: np.ndarray) -> Callable[[np.ndarray], list[np.ndarray]]:
    """Blur, and the differences of each cell to the neighbours of ``HALF``; the input has half the kernel and one cell more around it."""

    def differences(a: np.ndarray) -> list[np.ndarray]:
        for axis in (2, 1):
            a = ch._correlate(a, kernel, axis)
        n, m = a.shape[1] - 1, a.shape[2] - 1
        inner = a[:, 1:n, 1:m]
        return [np.abs(inner - a[:, 1 + dy : n + dy, 1 + dx : m + dx]) for dy, dx in HALF]

    return differences


def _blur_kernel(sigma: float) -> np.ndarray:
    return gaussian_kernel(sigma) if sigma > 0 else np.ones(1)


def pixel_edges(voxels: DataFrame, volumes: DataFrame, sigma: float, shape: Three = CHUNK_SHAPE) -> DataFrame:
    """(volume_id, z, a, b, w): neighbouring pixels a < b of a slice by raster index, and the difference of their blurred values.

    Blur and differences are taken from one visit to each chunk with its halo; the border is mirrored, edge cells included.
    """
    kernel = _blur_kernel(sigma)
    r = len(kernel) // 2 + 1
    names = [f"w{i}" for i in range(len(HALF))]
    rows = ch.to_voxels(ch.map_chunks(voxels, volumes, _differences(kernel), (0, r, r), shape, names, "symmetric"), names, names)
    rows = fact_join(rows, volumes.select("volume_id", "ny", "nx"), ["volume_id"])
    at = F.col("y").cast("bigint") * F.col("nx") + F.col("x")
    inside = lambda dy, dx: (F.col("y") + dy < F.col("ny")) & (F.col("x") + dx >= 0) & (F.col("x") + dx < F.col("nx"))
    each = F.array_compact(F.array(*(F.when(inside(dy, dx), F.struct(at.alias("a"), (at + dy * F.col("nx") + dx).alias("b"), F.col(n).alias("w"))) for (dy, dx), n in zip(HALF, names))))
    return rows.select(*KEYS, F.explode(each).alias("e")).select(*KEYS, "e.a", "e.b", "e.w")


def _round(edges: DataFrame, parts: DataFrame, taken: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, components and the map (c, m) after the ``taken`` edges (a, b, w) have merged their ends."""
    links = cut_lineage(contract(taken.select(*KEYS, F.col("b").alias("u"), F.col("a").alias("v")), KEYS).withColumnRenamed("u", "c"))
    root = lambda rows, c: fact_join(rows, links.withColumnsRenamed({"c": c, "m": "_m"}), [*KEYS, c], "left").withColumn(c, F.coalesce("_m", c)).drop("_m")
    heaviest = root(taken.select(*KEYS, F.col("a").alias("c"), "w"), "c").groupBy(*KEYS, "c").agg(F.max("w").alias("w"))
    merged = root(parts, "c").groupBy(*KEYS, "c").agg(F.sum("size").alias("size"), F.max("inner").alias("inner"))
    merged = fact_join(merged, heaviest, [*KEYS, "c"], "left").select(*KEYS, "c", "size", F.greatest("inner", F.coalesce("w", F.lit(0.0))).alias("inner"))
    moved = root(root(edges, "a"), "b").filter("a <> b")
    moved = moved.groupBy(*KEYS, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w"))
    return cut_lineage(moved), cut_lineage(merged), links


def _least(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """The least edge (a, b, w) of each component, or of those in ``of``; smaller ids win a tie."""
    ends = F.explode(F.array("a", "b"))
    each = edges.select(*KEYS, ends.alias("c"), F.struct("w", "a", "b").alias("e"))
    if of is not None:
        each = fact_join(each, of.select(*KEYS, "c"), [*KEYS, "c"], "left_semi")
    best = each.groupBy(*KEYS, "c").agg(F.min("e").alias("e"))
    return best.select(*KEYS, "e.a", "e.b", "e.w").distinct()


def forest(edges: DataFrame, parts: DataFrame, scale: float, min_size: int) -> DataFrame:
    """(volume_id, z, c, m): the component m of each node c. ``edges`` (a, b, w), ``parts`` (c, size, inner)."""
    edges, parts, maps = cut_lineage(edges), cut_lineage(parts), []
    allowed = parts.columns
    while True:
        bound = parts.select(*KEYS, "c", (F.col("inner") + F.lit(float(scale)) / F.col("size")).alias("bound"))
        taken = _least(edges)
        for end in ("a", "b"):
            taken = fact_join(taken, bound.withColumnRenamed("c", end), [*KEYS, end]).filter("w < bound").drop("bound")
        taken = cut_lineage(taken)
        if taken.isEmpty():
            break
        edges, parts, links = _round(edges, parts.select(allowed), taken)
        maps.append(links)
    while True:
        taken = cut_lineage(_least(edges, parts.filter(F.col("size") < min_size)))
        if taken.isEmpty():
            break
        edges, parts, links = _round(edges, parts.select(allowed), taken)
        maps.append(links)
    return _composed(maps)


def _composed(maps: Sequence[DataFrame]) -> DataFrame | None:
    """One map from the maps of the rounds; a node that no round has moved is in none of them."""
    out = None
    for links in reversed(maps):
        if out is None:
            out = links
            continue
        later = fact_join(links, out.select(*KEYS, F.col("c").alias("m"), F.col("m").alias("_m")), [*KEYS, "m"], "left").select(*KEYS, "c", F.coalesce("_m", "m").alias("m"))
        # Nodes of later rounds that this one left alone.
        out = later.unionByName(fact_join(out, links.select(*KEYS, "c"), [*KEYS, "c"], "left_anti"))
    return out


def _grown(a: np.ndarray, b: np.ndarray, w: np.ndarray, nodes: int, scale: float, min_size: int) -> tuple[np.ndarray, np.ndarray]:
    """``forest`` of nodes 0..nodes - 1 as arrays: the component of each, its smallest node, and the sizes of the components."""
    root, size, inner = np.arange(nodes), np.ones(nodes, np.int64), np.zeros(nodes)
    for growing in (True, False):
        while True:
            # The least edge of each component: the first in order that it takes part in.
            order = np.lexsort((b, a, w))
            a, b, w = a[order], b[order], w[order]
            best = np.full(nodes, len(a))
            best[b[::-1]] = np.arange(len(a))[::-1]
            other = np.full(nodes, len(a))
            other[a[::-1]] = np.arange(len(a))[::-1]
            best = np.minimum(best, other)
            taken = np.unique(best[(best < len(a)) & (growing | (size < min_size))])
            if growing:
                bound = inner + float(scale) / np.maximum(size, 1)
                taken = taken[(w[taken] < bound[a[taken]]) & (w[taken] < bound[b[taken]])]
            if not len(taken):
                break
            up = _roots(nodes, a[taken], b[taken])
            heaviest = np.zeros(nodes)
            with np.errstate(invalid="ignore"):
                np.maximum.at(heaviest, up, inner)
                np.maximum.at(heaviest, up[a[taken]], w[taken])
            root, inner, size = up[root], heaviest, np.bincount(up, size, nodes).astype(np.int64)
            a, b = up[a], up[b]
            a, b, apart = np.minimum(a, b), np.maximum(a, b), a != b
            a, b, w = a[apart], b[apart], w[apart]
    return root, size


def _slice_segments(g: wh.Group, sigma: float, scale: float, min_size: int, more_than: float | None) -> tuple[np.ndarray, ...]:
    """Cells of whole slices: the place of their head, y, x and segment; with ``more_than`` those of segments of more cells."""
    kernel = _blur_kernel(sigma)
    r = len(kernel) // 2 + 1
    rows, of = g.rows(1, ("y", "x"))
    y, x, v = (g.column(c, rows) for c in ("y", "x", "v"))
    place, out = np.empty(len(g.heads), np.int64), []
    for (ny, nx), heads in wh.alike(g.head("ny"), g.head("nx")):
        place[:] = -1
        place[heads] = np.arange(len(heads))
        mine = np.flatnonzero((place[of] >= 0) & (y >= 0) & (y < ny) & (x >= 0) & (x < nx))
        dense = np.zeros((len(heads), ny, nx))
        dense[place[of[mine]], y[mine], x[mine]] = v[mine]
        node = np.arange(dense.size).reshape(dense.shape)
        ends = []
        for (dy, dx), w in zip(HALF, _differences(kernel)(np.pad(dense, ((0, 0), (r, r), (r, r)), "symmetric"))):
            one = slice(None), slice(0, ny - dy), slice(max(-dx, 0), nx - max(dx, 0))
            two = slice(None), slice(dy, ny), slice(max(dx, 0), nx - max(-dx, 0))
            ends.append((node[one].ravel(), node[two].ravel(), w[one].ravel()))
        root, size = _grown(*(np.concatenate(e) for e in zip(*ends)), dense.size, scale, min_size)
        kept = np.flatnonzero(size[root] > more_than) if more_than is not None else np.arange(dense.size)
        at = kept % (ny * nx)
        out.append((heads[kept // (ny * nx)], at // nx, at % nx, root[kept] % (ny * nx)))
    return tuple(np.concatenate(c) for c in zip(*out))


def _whole_superpixels(voxels: DataFrame, volumes: DataFrame, scale: float, sigma: float, min_size: int, parts: int, more_than: float | None) -> DataFrame:
    """``superpixels`` of slices that fit a task each: one shuffle of the voxels."""
    heads = volumes.filter("nz > 0 and ny > 0 and nx > 0").select("volume_id", F.explode(F.sequence(F.lit(0), F.col("nz").cast("int") - 1)).alias("z"), *(F.col(n).cast("int").alias(n) for n in ("ny", "nx")))
    rows = voxels.select("volume_id", *VOXEL, F.col("v").cast("double").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in wh.groups(batches, KEYS, ("ny", "nx")):
            if not len(g.heads):
                continue
            of, y, x, segment = _slice_segments(g, sigma, scale, min_size, more_than)
            cols = [*g.keys(KEYS, of), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(segment.astype(np.int64))]
            yield from pa.table(cols, names=[*KEYS, "y", "x", "segment"]).to_batches()

    kind = dict(volumes.dtypes)["volume_id"]
    return wh.beside(heads, [rows], KEYS, parts).mapInArrow(run, f"volume_id {kind}, z int, y int, x int, segment bigint")


def superpixels(
    voxels: DataFrame, volumes: DataFrame, scale: float = 100.0, sigma: float = 0.5, min_size: int = 20, shape: Three = CHUNK_SHAPE, more_than: float | None = None
) -> DataFrame:
    """(volume_id, z, y, x, segment): every cell of each slice with the smallest raster index of its segment in the slice.

    ``voxels`` are sparse (absent cells are zero). A slice of one cell is one segment. With ``more_than`` only the cells of segments
    of more cells are given.
    """
    small, large, parts = wh.told_apart(volumes, ("ny", "nx"))
    whole = None if small is None else _whole_superpixels(voxels, small, scale, sigma, min_size, parts, more_than)
    if large is None:
        return whole
    by_rounds = _round_superpixels(voxels, large, scale, sigma, min_size, shape)
    if more_than is not None:
        by_rounds = _more_than(by_rounds, more_than)
    return by_rounds if whole is None else whole.unionByName(by_rounds)


def _round_superpixels(voxels: DataFrame, volumes: DataFrame, scale: float, sigma: float, min_size: int, shape: Three) -> DataFrame:
    """``superpixels`` of slices of any size."""
    pixels = voxel_grid(volumes, keep=("nx",)).withColumn("c", F.col("y").cast("bigint") * F.col("nx") + F.col("x"))
    parts = pixels.select(*KEYS, "c", F.lit(1).cast("bigint").alias("size"), F.lit(0.0).alias("inner"))
    links = forest(pixel_edges(voxels, volumes, sigma, shape), parts, scale, min_size)
    if links is None:
        return pixels.select(*KEYS, "y", "x", F.col("c").alias("segment"))
    return fact_join(pixels, links, [*KEYS, "c"], "left").select(*KEYS, "y", "x", F.coalesce("m", "c").alias("segment"))


def _more_than(segments: DataFrame, size: float) -> DataFrame:
    sizes = segments.groupBy(*KEYS, "segment").agg(F.count("*").alias("n")).filter(F.col("n") > size)
    return fact_join(segments, sizes, [*KEYS, "segment"], "left_semi")


def large_segments(segments: DataFrame, max_size: float) -> DataFrame:
    """The cells of segments of more than ``max_size`` cells, numbered from 1 by segment inside each slice, as labels."""
    return as_labels(_more_than(segments, max_size))


def as_labels(segments: DataFrame) -> DataFrame:
    """Segments numbered from 1 inside each slice, as labels."""
    return segments.select("volume_id", *VOXEL, (F.col("segment") + 1).alias("label"))
