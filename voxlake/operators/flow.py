"""Fusing the slice-wise objects of several views into 3-D objects by following gradients.

In each view every slice has its own objects. The distance of a cell to the edge of its object rises towards the object's
middle; the gradients of all views are averaged into one vector at each voxel, and each voxel steps to the neighbour that its
vector points at, again and again, until it comes to rest. Voxels that rest together are one object, so two objects that
touch stay apart where their middles are. Volumes that fit a task are fused in one visit, with one shuffle of the views' cells. In
larger ones all steps are joins: the walk doubles its length with each of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.operators import whole as wh
from voxlake.operators.components import _roots, connected_components
from voxlake.operators.geometry import VIEWS, undo_view
from voxlake.operators.joins import VOXEL, fact_join, offset_array, offsets
from voxlake.operators.lines import own_squared_distance
from voxlake.operators.morphology import with_shell
from voxlake.operators.tiles import view_vote
from voxlake.session import cut_lineage


def object_distance(labels: DataFrame, volumes: DataFrame, axes: tuple[str, str]) -> DataFrame:
    """(volume_id, label, z, y, x, d): in the plane of ``axes``, the distance of each cell to the nearest one not of its object.

    The nearest such cell touches the object, so only cells beside it are looked at. Outside the volume there are none; an object
    without any cell beside it has distance 1 everywhere.
    """
    keys = ("volume_id", "label")
    rows = own_squared_distance(with_shell(labels.select(*keys, *VOXEL), volumes, axes, keys), volumes, axes, keys)
    return rows.select(*keys, *VOXEL, F.sqrt(F.coalesce("d2", F.lit(1)).cast("double")).alias("d"))


def _gradient(field: DataFrame, axes: tuple[str, str]) -> DataFrame:
    """(volume_id, z, y, x, gz, gy, gx): central differences inside each object, the distance outside being 0."""
    keys = ("volume_id", "label")
    names = [f"g{a}" for a in VOXEL]
    moves = [(*(s if a == axis else 0 for a in VOXEL), *(-s / 2 if a == axis else 0.0 for a in VOXEL)) for axis in axes for s in (-1, 1)]
    # Each cell adds its distance to the differences of its neighbours, and nothing to its own row.
    moves.append((0, 0, 0, 0.0, 0.0, 0.0))
    sent = field.select(*keys, *VOXEL, "d", F.explode(offset_array(moves, ("dz", "dy", "dx", *names))).alias("m"))
    stays = (F.col("m.dz") == 0) & (F.col("m.dy") == 0) & (F.col("m.dx") == 0)
    sent = sent.select(*keys, *((F.col(a) + F.col(f"m.d{a}")).alias(a) for a in VOXEL), *((F.col("d") * F.col(f"m.{n}")).alias(n) for n in names), stays.alias("own"))
    summed = sent.groupBy(*keys, *VOXEL).agg(*(F.sum(n).alias(n) for n in names), F.max("own").alias("own"))
    return summed.filter("own").select("volume_id", *VOXEL, *names)


def view_gradients(view_labels: DataFrame, volumes: DataFrame) -> DataFrame:
    """(volume_id, z, y, x, gz, gy, gx): gradients of the views (volume_id, view, a, b, c, label), averaged for each component.

    A component is averaged over the views whose slices hold its axis, as far as they have an object at the voxel.
    """
    rows = undo_view(view_labels)
    parts = None
    for view, order in VIEWS.items():
        own = rows.filter(F.col("view") == view).select("volume_id", *VOXEL, "label")
        g = _gradient(object_distance(own, volumes, order[1:]), order[1:])
        g = g.select("volume_id", *VOXEL, *((F.col(f"g{a}") if a in order[1:] else F.lit(None).cast("double")).alias(f"g{a}") for a in VOXEL))
        parts = g if parts is None else parts.unionByName(g)
    return parts.groupBy("volume_id", *VOXEL).agg(*(F.coalesce(F.avg(f"g{a}"), F.lit(0.0)).alias(f"g{a}") for a in VOXEL))


def first_steps(mask: DataFrame, gradients: DataFrame) -> DataFrame:
    """(volume_id, z, y, x, tz, ty, tx): the neighbour that each mask voxel points at; itself if that isn't in the mask."""
    g = mask.select("volume_id", *VOXEL).join(gradients, ["volume_id", *VOXEL], "left")
    size = F.sqrt(sum((F.col(f"g{a}") * F.col(f"g{a}") for a in ("y", "x")), F.col("gz") * F.col("gz")))
    step = lambda a: F.coalesce(F.round(F.try_divide(F.col(f"g{a}"), F.col("size"))), F.lit(0.0)).cast("int")
    aimed = g.withColumn("size", F.when(size > 0, size)).select("volume_id", *VOXEL, *((F.col(a) + step(a)).alias(f"t{a}") for a in VOXEL))
    held = mask.select("volume_id", *(F.col(a).alias(f"t{a}") for a in VOXEL), F.lit(True).alias("held"))
    met = aimed.join(held, ["volume_id", *(f"t{a}" for a in VOXEL)], "left")
    return met.select("volume_id", *VOXEL, *(F.when(F.col("held"), F.col(f"t{a}")).otherwise(F.col(a)).alias(f"t{a}") for a in VOXEL))


def follow(steps: DataFrame, reach: int) -> DataFrame:
    """``steps`` with the voxel where each walk is after at least ``reach`` steps; each round doubles the length."""
    targets = [f"t{a}" for a in VOXEL]
    at_rest = F.lit(True)
    for a in VOXEL:
        at_rest = at_rest & F.col(f"t{a}").eqNullSafe(F.col(a))
    now = cut_lineage(steps)
    resting, walking = now.filter(at_rest), now.filter(~at_rest)
    on_the_way, ended = walking, []
    for _ in range(_rounds(reach)):
        # A walk whose target is at rest has come to its end; only the others are joined and written again.
        ahead = on_the_way.select("volume_id", *(F.col(a).alias(f"t{a}") for a in VOXEL), *(F.col(t).alias(f"_{t}") for t in targets), F.lit(True).alias("_on"))
        # Many walks may be at one voxel: the key is dealt anew and split where it is hot.
        met = fact_join(walking, ahead, ["volume_id", *targets], "left")
        met = cut_lineage(met.select("volume_id", *VOXEL, *(F.coalesce(f"_{t}", t).alias(t) for t in targets), F.col("_on").isNotNull().alias("_on")))
        on_the_way = reduce(DataFrame.unionByName, ended, met.drop("_on"))
        walking = met.filter("_on").drop("_on")
        ended.append(met.filter("not _on").drop("_on"))
        if walking.isEmpty():
            break
    return reduce(DataFrame.unionByName, [resting, *ended], walking)


def _found(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The places of the wanted numbers in the sorted ``codes``, -1 for those that aren't there."""
    if not len(codes):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return np.where(codes[at] == wanted, at, -1)


def _digits(c: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Coordinates as digits from 1, and their base: those in 0..size keep their distances, wider gaps outside become 2."""
    u, of = np.unique(np.concatenate([c, [0, size]]), return_inverse=True)
    step = np.diff(u)
    step = np.where((u[:-1] >= 0) & (u[1:] <= size), step, np.minimum(step, 2))
    digit = np.concatenate([[1], 1 + np.cumsum(step)])
    return digit[of.ravel()[: len(c)]], int(digit[-1]) + 2


def _own_distances(codes: np.ndarray, at: np.ndarray, size: np.ndarray, axes: Sequence[int], strides: Sequence[int]) -> np.ndarray:
    """``object_distance`` of cells inside their volumes; ``codes`` are sorted, and differ between objects."""
    if not len(codes):
        return np.ones(0)
    axis, other = axes
    c, n = at[axis], size[axis]
    line = codes - c * strides[axis]
    order = np.lexsort((c, line))
    new = np.ones(len(c), bool)
    new[1:] = (line[order][1:] != line[order][:-1]) | (c[order][1:] != c[order][:-1] + 1)
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    start, end = (c[order][i][run] for i in (first, np.append(first[1:], len(c)) - 1))
    own = np.empty(len(c))
    c, n = c[order], n[order]
    own[order] = np.minimum(np.where(start > 0, c - start + 1.0, np.inf), np.where(end < n - 1, end - c + 1.0, np.inf)) ** 2
    best, c, n, k = own.copy(), at[other], size[other], 1
    active = np.flatnonzero((best > 1) & (n > 1))
    while len(active):
        for s in (-k, k):
            to = c[active] + s
            near = active[(to >= 0) & (to < n[active])]
            hit = _found(codes, codes[near] + s * strides[other])
            best[near] = np.minimum(best[near], k * k + np.where(hit >= 0, own[hit], 0.0))
        k += 1
        active = active[(best[active] > k * k) & (np.maximum(c[active], n[active] - 1 - c[active]) >= k)]
    return np.sqrt(np.where(np.isfinite(best), best, 1.0))


def _fused(g: wh.Group, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Voxels of whole volumes: the place of their head, (z, y, x), and the object's id."""
    rows, of = g.rows(1, VOXEL)
    at = np.stack([g.column(a, rows).astype(np.int64) for a in VOXEL])
    view = g.column("view", rows).astype(np.int64)
    sizes = np.stack([g.head(n).astype(np.int64) for n in wh.SIZE])
    size = sizes[:, of]
    digits, bases = zip(*(_digits(c, int(n.max())) for c, n in zip(at, sizes)))
    strides = bases[1] * bases[2], bases[2], 1
    place = of * bases[0] * strides[0] + sum(d * s for d, s in zip(digits, strides))
    cells, index, cell = np.unique(place, return_index=True, return_inverse=True)
    cell = cell.ravel()
    votes = np.bincount(np.unique(cell * 3 + view) // 3, minlength=len(cells))
    label = g.table.column("label").combine_chunks().dictionary_encode(null_encoding="encode").indices.take(pa.array(rows)).to_numpy().astype(np.int64)
    label = np.unique(label, return_inverse=True)[1].ravel()
    named = g.table.column("label").is_valid().to_numpy()[rows]
    inside = ((at >= 0) & (at < size)).all(0) & named
    slope, views = np.zeros((3, len(cells))), np.zeros((3, len(cells)))
    for i, order in enumerate(VIEWS.values()):
        mine = np.flatnonzero(view == i)
        # Objects of a view may lie over one another.
        codes, first = np.unique(label[mine] * (len(g.heads) * bases[0] * strides[0]) + place[mine], return_index=True)
        mine = mine[first]
        axes = [VOXEL.index(a) for a in order[1:]]
        d, held = np.ones(len(mine)), inside[mine]
        d[held] = _own_distances(codes[held], at[:, mine[held]], size[:, mine[held]], axes, strides)
        for axis in axes:
            before, after = (_found(codes, codes + s * strides[axis]) for s in (-1, 1))
            rise = np.where(after >= 0, d[after], 0.0) * 0.5 - np.where(before >= 0, d[before], 0.0) * 0.5
            slope[axis] += np.bincount(cell[mine], rise, len(cells))
            views[axis] += np.bincount(cell[mine], minlength=len(cells))
    kept = votes * 2 > g.head("k")[of[index]]
    cells, index = cells[kept], index[kept]
    slope = np.where(views > 0, slope / np.maximum(views, 1), 0.0)[:, kept]
    length = np.sqrt(slope[0] * slope[0] + slope[1] * slope[1] + slope[2] * slope[2])
    turn = np.where(length > 0, slope / np.where(length > 0, length, 1.0), 0.0)
    steps = np.where(np.abs(turn) >= 0.5, np.sign(turn), 0.0).astype(np.int64)
    to = _found(cells, cells + sum(t * s for t, s in zip(steps, strides)))
    to = np.where(to >= 0, to, np.arange(len(cells)))
    for _ in range(rounds):
        to, last = to[to], to
        if (to == last).all():
            break
    rests = np.unique(to)
    pairs = [(np.flatnonzero(hit >= 0), hit[hit >= 0]) for m in offsets(3, half=True) for hit in [_found(cells[rests], cells[rests] + sum(a * s for a, s in zip(m, strides)))]]
    middle = rests[_roots(len(rests), *(np.concatenate(p) for p in zip(*pairs)))]
    z, y, x = at[:, index[middle]]
    _, ny, nx = size[:, index[middle]]
    ids = ((z * ny + y) * nx + x)[np.searchsorted(rests, to)]
    return of[index], at[:, index], ids


def _nowhere(g: wh.Group) -> list[tuple]:
    """(place of the head, z, y, x) of the voted cells of which a coordinate is null; they rest where they are."""
    rows, of = g.rows(1)
    null = ~np.logical_and.reduce([g.table.column(a).is_valid().to_numpy()[rows] for a in VOXEL])
    names = [*VOXEL, "view", "name"]
    seen: dict[tuple, set] = {}
    for place, row in zip(of[null].tolist(), g.table.select(names).take(pa.array(rows[null])).to_pylist()):
        views = seen.setdefault((place, *(row[a] for a in VOXEL)), set())
        views |= {v for v in (row["view"], row["name"]) if v is not None}
    need = g.head("k")
    return [cell for cell, views in seen.items() if 2 * len(views) > need[cell[0]]]


def _whole_fusion(view_labels: DataFrame, views: DataFrame, volumes: DataFrame, reach: int, parts: int) -> DataFrame:
    """``flow_fusion`` of volumes that fit a task each: one shuffle of the views' cells."""
    rounds = _rounds(reach)
    present = views.groupBy("volume_id").agg(F.countDistinct("view").cast("int").alias("k"))
    heads = fact_join(volumes.select("volume_id", *(F.col(n).cast("int").alias(n) for n in wh.SIZE)), present, ["volume_id"])
    code = F.lit(None)
    for i, name in enumerate(VIEWS):
        code = F.when(F.col("view") == name, i).otherwise(code)
    rows = undo_view(view_labels).select("volume_id", *VOXEL, "label", code.cast("int").alias("view"), F.when(code.isNull(), F.col("view")).alias("name"))
    kind = dict(view_labels.dtypes)["volume_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in wh.groups(batches, ["volume_id"]):
            if not len(g.heads):
                continue
            of, at, ids = _fused(g, rounds)
            lost = _nowhere(g)
            of = np.concatenate([of, np.array([c[0] for c in lost], np.int64)]).astype(np.int64)
            cols = [pa.concat_arrays([pa.array(a.astype(np.int32)), pa.array([c[i] for c in lost], pa.int32())]) for i, a in enumerate(at, 1)]
            ids = pa.concat_arrays([pa.array(ids), pa.nulls(len(lost), pa.int64())])
            yield from pa.table([*g.keys(["volume_id"], of), *cols, ids], names=["volume_id", *VOXEL, "object_id"]).to_batches()

    return wh.beside(heads, [rows], ["volume_id"], parts).mapInArrow(run, f"volume_id {kind}, z int, y int, x int, object_id bigint")


def _rounds(reach: int) -> int:
    return max(math.ceil(math.log2(max(reach, 1))), 0)


def flow_fusion(view_labels: DataFrame, views: DataFrame, volumes: DataFrame) -> DataFrame:
    """(volume_id, z, y, x, object_id): objects of the voxels that most views hold.

    ``view_labels`` (volume_id, view, a, b, c, label) has the objects of each view's slices, ``views`` (volume_id, view) the views
    that a volume has. Places of rest that touch are one; an object's id is the smallest raster index among them.
    """
    # The longest way is bounded by the largest volume's sides: one number.
    reach = int(volumes.agg(F.max(F.col("nz") + F.col("ny") + F.col("nx"))).first()[0] or 1)
    small, large, parts = wh.told_apart(volumes, nulls=False)
    if small is None:
        return _joined_fusion(view_labels, views, volumes, reach)
    fused = _whole_fusion(view_labels, views, small, reach, parts)
    if large is None:
        return fused
    return fused.unionByName(_joined_fusion(wh.of_volumes(view_labels, large), wh.of_volumes(views, large), large, reach))


def _joined_fusion(view_labels: DataFrame, views: DataFrame, volumes: DataFrame, reach: int) -> DataFrame:
    """``flow_fusion`` of volumes of any size."""
    mask = cut_lineage(view_vote(view_labels.drop("label"), views).select("volume_id", *VOXEL))
    ends = follow(first_steps(mask, view_gradients(view_labels, volumes)), reach)
    rests = ends.select("volume_id", *(F.col(f"t{a}").alias(a) for a in VOXEL)).distinct()
    middles = connected_components(rests.withColumn("label", F.lit(1)), volumes, 3)
    named = middles.select("volume_id", *(F.col(a).alias(f"t{a}") for a in VOXEL), "object_id")
    return fact_join(ends, named, ["volume_id", *(f"t{a}" for a in VOXEL)]).select("volume_id", *VOXEL, "object_id")
