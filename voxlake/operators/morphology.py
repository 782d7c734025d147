"""Opening, hole filling, distance, edges and the organoid mask."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.operators import chunks as ch
from voxlake.operators.components import connected_components
from voxlake.operators.geometry import bounding_boxes
from voxlake.operators.histogram import above, histogram, otsu, triangle, triangle_of
from voxlake.operators.joins import VOXEL, fact_join, offset_array, voxel_grid
from voxlake.operators.lines import LINE_BATCH, _spread, convolve_edges, gaussian, gaussian_kernel, map_lines, squared_distance, with_sizes
from voxlake.session import cut_lineage, dealt


def background(mask: DataFrame, volumes: DataFrame) -> DataFrame:
    """Grid cells outside the mask, with the size of their volume."""
    return voxel_grid(volumes, keep=("nz", "ny", "nx")).join(mask.select("volume_id", *VOXEL), ["volume_id", *VOXEL], "left_anti")


def shell(mask: DataFrame, volumes: DataFrame, axes: Sequence[str] = VOXEL, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Cells beside the mask along ``axes``, inside the volume and not in the mask themselves.

    The cell outside the mask that is nearest to one of its voxels is always among them, so their number, which follows the
    mask's surface, is all that a distance needs.
    """
    return with_shell(mask, volumes, axes, keys).filter("_own = 0").drop("_own")


def with_shell(mask: DataFrame, volumes: DataFrame, axes: Sequence[str] = VOXEL, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """The mask's cells (``_own`` 1) and those of its ``shell`` (0); one grouping tells them apart."""
    moves = [tuple(s if a == axis else 0 for a in VOXEL) for axis in axes for s in (-1, 1)]
    own = mask.select(*keys, *VOXEL)
    near = fact_join(own, volumes.select("volume_id", "nz", "ny", "nx"), ["volume_id"])
    near = near.select(*keys, "nz", "ny", "nx", *VOXEL, F.explode(offset_array(moves, ("dz", "dy", "dx"))).alias("m"))
    inside = F.lit(True)
    for a in VOXEL:
        moved = F.col(a) + F.col(f"m.d{a}")
        inside = inside & (moved >= 0) & (moved < F.col(f"n{a}"))
    near = near.filter(inside).select(*keys, *((F.col(a) + F.col(f"m.d{a}")).alias(a) for a in VOXEL), F.lit(0).alias("_own"))
    both = near.unionByName(own.withColumn("_own", F.lit(1)))
    return both.groupBy(*keys, *VOXEL).agg(F.max("_own").alias("_own"))


def distance_to_background(mask: DataFrame, volumes: DataFrame, planar: bool = True) -> DataFrame:
    """Squared Euclidean distance of mask voxels to the nearest background cell of their slice (or volume)."""
    axes = ("x", "y") if planar else ("x", "y", "z")
    field = squared_distance(shell(mask, volumes, axes), volumes, axes)
    return mask.select("volume_id", *VOXEL).join(field, ["volume_id", *VOXEL])


def ball_limit(radius: int) -> float:
    """A digital ball of radius r holds the offsets within r + 1/2."""
    return (radius + 0.5) ** 2


def erode(mask: DataFrame, volumes: DataFrame, radius: int) -> DataFrame:
    """Ball erosion through the distance to the background: three passes for any radius.

    Outside the volume counts as foreground; a volume without background keeps all its voxels.
    """
    near = squared_distance(shell(mask, volumes), volumes, limit=ball_limit(radius))
    return mask.select("volume_id", *VOXEL).join(near, ["volume_id", *VOXEL], "left_anti")


def dilate(mask: DataFrame, volumes: DataFrame, radius: int) -> DataFrame:
    return squared_distance(mask, volumes, limit=ball_limit(radius)).select("volume_id", *VOXEL)


def opening(mask: DataFrame, volumes: DataFrame, radius: int) -> DataFrame:
    return dilate(erode(mask, volumes, radius), volumes, radius)


def holes(mask: DataFrame, volumes: DataFrame, max_size: int | None = None, connectivity: int = 1) -> DataFrame:
    """Background voxels closed in by the mask, optionally only holes of at most ``max_size`` voxels.

    A hole lies inside the mask's bounding box, so only that box is looked at.
    """
    # One row for each volume, read three times.
    boxes = cut_lineage(bounding_boxes(mask, volumes, 0))
    sized = boxes.select("volume_id", *[F.col(f"d{a}").alias(f"n{a}") for a in VOXEL])
    inside = fact_join(mask.select("volume_id", *VOXEL), boxes, ["volume_id"])
    moved = inside.select("volume_id", *[(F.col(a) - F.col(f"{a}0")).alias(a) for a in VOXEL])
    empty = background(moved, sized).withColumn("label", F.lit(1))
    comp = connected_components(empty, sized, connectivity)
    dims = fact_join(comp, boxes, ["volume_id"])
    rim = F.lit(False)
    for axis in VOXEL:
        rim = rim | (F.col(axis) == 0) | (F.col(axis) == F.col(f"d{axis}") - 1)
    facts = dims.groupBy("volume_id", "object_id").agg(F.max(rim.cast("int")).alias("_rim"), F.count("*").alias("_n"))
    closed = facts.filter("_rim = 0")
    if max_size is not None:
        closed = closed.filter(F.col("_n") <= max_size)
    hit = fact_join(dims, closed.select("volume_id", "object_id"), ["volume_id", "object_id"], "left_semi")
    return hit.select("volume_id", *[(F.col(a) + F.col(f"{a}0")).alias(a) for a in VOXEL])


def fill_holes(mask: DataFrame, volumes: DataFrame, max_size: int | None = None, connectivity: int = 1) -> DataFrame:
    return mask.select("volume_id", *VOXEL).unionByName(holes(mask, volumes, max_size, connectivity))


def slice_objects(mask: DataFrame, volumes: DataFrame, parts: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """8-connected objects of each slice."""
    return connected_components(mask.withColumn("label", F.lit(1)), volumes, 2, planar=True, parts=parts, carry=carry)


def object_areas(components: DataFrame) -> DataFrame:
    """Size of each object of a slice."""
    return components.groupBy("volume_id", "z", "object_id").agg(F.count("*").alias("area"))


def mean_areas(areas: DataFrame) -> DataFrame:
    return areas.groupBy("volume_id", "z").agg(F.count("*").alias("objects"), F.avg("area").alias("mean_area"))


#: Cells of a slice that a task holds as arrays.
SLICE_CELLS = 1 << 22


def slice_depth(mask: np.ndarray) -> float:
    """Greatest distance of a slice's mask to its background; the longer side if there is none."""
    if mask.all():
        return float(max(mask.shape))
    field = np.where(mask, np.inf, 0.0)
    field = _spread(_spread(field, np.inf).T, np.inf).T
    return float(np.sqrt(field[mask].max()))


def _blurred_masks(objects: DataFrame, minimum_size: float | None, sigma: float | None, parts: int) -> DataFrame:
    """Objects above a size, blurred and cut by the triangle rule, a whole slice at a time; one shuffle of the objects' voxels.

    A slice whose volume or z is null has no mean size.
    """
    key = ["volume_id", "z"]
    types = dict(objects.dtypes)
    if minimum_size is None:
        objects = objects.dropna(subset=key)

    def cut(y: np.ndarray, x: np.ndarray, ids: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        _, of, area = np.unique(ids, return_inverse=True, return_counts=True)
        kept = area[of] > (area.sum() / len(area) if minimum_size is None else minimum_size)
        if not kept.any():
            return np.zeros((0, 2), np.int64)
        mask, v = np.zeros(shape, bool), np.zeros(shape)
        mask[y, x], v[y[kept], x[kept]] = True, 1.0
        kernel = gaussian_kernel(slice_depth(mask) if sigma is None else sigma)
        v = convolve_edges(convolve_edges(v, kernel).T, kernel).T
        return np.argwhere((v > triangle_of(v)) & (v != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_slices(batches, key):
            y, x, ids, ny, nx = (table.column(c).to_numpy() for c in ("y", "x", "object_id", "ny", "nx"))
            ends = [*starts[1:].tolist(), table.num_rows]
            found = [cut(y[a:b], x[a:b], ids[a:b], (int(ny[a]), int(nx[a]))) for a, b in zip(starts.tolist(), ends)]
            heads = table.select(key).take(pa.array(np.repeat(starts, [len(f) for f in found])))
            at = np.concatenate(found).astype(np.int32)
            cols = [*heads.columns, pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(np.ones(len(at), np.int32))]
            yield from pa.table(cols, names=[*key, "y", "x", "label"]).to_batches()

    rows = dealt(objects.select(*key, "y", "x", "object_id", "ny", "nx"), parts, *key).sortWithinPartitions(*key)
    return rows.mapInArrow(run, f"volume_id {types['volume_id']}, z {types['z']}, y int, x int, label int")


def _whole_slices(batches: Iterator[pa.RecordBatch], key: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole keys (null is one) from rows sorted by ``key``, and the row numbers where a new one begins."""

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for c in key:
            values = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < LINE_BATCH:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        at = starts(table)
        if len(at) > 1:
            yield table.slice(0, int(at[-1])), at[:-1]
            held = table.slice(int(at[-1])).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts(table)


def organoid_mask(
    sparse: DataFrame, volumes: DataFrame, minimum_size: float | None = None, sigma: float | None = None, kind: str | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Highest slice Otsu, slice objects above a size, blur, triangle threshold.

    ``None`` picks per slice: the mean object size, and the greatest distance to background as sigma (a slice that is all
    object has none and takes its longer side). With ``parts``, and where every slice fits a task (``SLICE_CELLS``), slices are dealt
    whole over so many partitions: the histogram, and then all that follows the objects, visit a slice once. Else they are read
    several times by lines and grouped rows, so the objects and the blurred slices are written once.
    """
    if parts and volumes.filter(F.col("ny").cast("bigint") * F.col("nx") > SLICE_CELLS).isEmpty():
        slices = otsu(histogram(sparse, kind, ["volume_id", "z"], volumes, parts=parts), ["volume_id", "z"])
        limit = with_sizes(slices.groupBy("volume_id").agg(F.max("threshold").alias("threshold")), volumes)
        comp = slice_objects(above(sparse, limit, keep=("ny", "nx"), parts=parts), volumes, parts, ("ny", "nx"))
        return _blurred_masks(comp, minimum_size, sigma, parts)
    slices = otsu(histogram(sparse, kind, ["volume_id", "z"], volumes), ["volume_id", "z"])
    limit = slices.groupBy("volume_id").agg(F.max("threshold").alias("threshold"))
    comp = cut_lineage(slice_objects(above(sparse, limit), volumes))
    areas = object_areas(comp)
    if minimum_size is None:
        big = areas.join(mean_areas(areas), ["volume_id", "z"]).filter("area > mean_area")
    else:
        big = areas.filter(F.col("area") > minimum_size)
    kept = fact_join(comp, big.select("volume_id", "z", "object_id"), ["volume_id", "z", "object_id"], "left_semi")
    if sigma is None:
        depth = distance_to_background(comp, volumes).groupBy("volume_id", "z").agg(F.sqrt(F.max("d2")).alias("sigma"))
        rows = with_sizes(fact_join(kept, depth, ["volume_id", "z"], "left"), volumes)
        rows = rows.withColumn("sigma", F.coalesce("sigma", F.greatest("ny", "nx").cast("double"))).drop("nz", "ny", "nx")
    else:
        rows = kept.withColumn("sigma", F.lit(float(sigma)))
    blurred = cut_lineage(gaussian(rows.withColumn("v", F.lit(1.0)), volumes, "sigma", ("x", "y")))
    cut = triangle(histogram(blurred, "float", ["volume_id", "z"], volumes), ["volume_id", "z"])
    return above(blurred, cut, ["volume_id", "z"])


def neighbours_3x3(rows: DataFrame, value: str) -> DataFrame:
    """Nine columns p<dy><dx> (0, 1, 2 = before, here, after) of a dense slice; the edge cell repeats outside.

    Two line windows, along x and then along y.
    """
    along_x = Window.partitionBy("volume_id", "z", "y").orderBy("x")
    v = F.col(value)
    rows = rows.withColumn(
        "_r", F.struct(F.coalesce(F.lag(v).over(along_x), v).alias("a"), v.alias("b"), F.coalesce(F.lead(v).over(along_x), v).alias("c"))
    )
    along_y = Window.partitionBy("volume_id", "z", "x").orderBy("y")
    r = F.col("_r")
    rows = rows.withColumn("_u", F.coalesce(F.lag(r).over(along_y), r)).withColumn("_d", F.coalesce(F.lead(r).over(along_y), r))
    cols = [F.col(f"{s}.{f}").alias(f"p{i}{j}") for i, s in enumerate(("_u", "_r", "_d")) for j, f in enumerate("abc")]
    return rows.select("volume_id", *VOXEL, *[c for c in rows.columns if c not in ("volume_id", *VOXEL, "_r", "_u", "_d")], *cols)


def _p(i: int, j: int) -> Column:
    return F.col(f"p{i}{j}")


def sobel(dense: DataFrame) -> DataFrame:
    """Slice gradients gi (down), gj (right) and their magnitude."""
    n = neighbours_3x3(dense, "v")
    gi = (_p(2, 0) + 2 * _p(2, 1) + _p(2, 2)) - (_p(0, 0) + 2 * _p(0, 1) + _p(0, 2))
    gj = (_p(0, 2) + 2 * _p(1, 2) + _p(2, 2)) - (_p(0, 0) + 2 * _p(1, 0) + _p(2, 0))
    g = n.select("volume_id", *VOXEL, gi.alias("gi"), gj.alias("gj"))
    return g.withColumn("m", F.sqrt(F.col("gi") * F.col("gi") + F.col("gj") * F.col("gj")))


def thin_edges(grad: DataFrame, volumes: DataFrame, low: float) -> DataFrame:
    """Non-maximum suppression along the gradient with interpolated neighbours; border cells never pass."""
    n = neighbours_3x3(grad, "m")
    gi, gj, m = F.col("gi"), F.col("gj"), F.col("m")
    ai, aj = F.abs(gi), F.abs(gj)
    same = ((gi >= 0) & (gj >= 0)) | ((gi <= 0) & (gj <= 0))
    steep = F.when(same, ai > aj).otherwise(ai >= aj)
    w = F.when(steep, aj / ai).otherwise(F.when(aj > 0, ai / aj).otherwise(0.0))
    pick = lambda diag, straight: diag * w + straight * (1 - w)
    after = F.when(same & steep, pick(_p(2, 2), _p(2, 1))).when(same, pick(_p(2, 2), _p(1, 2)))
    after = after.when(steep, pick(_p(0, 2), _p(0, 1))).otherwise(pick(_p(0, 2), _p(1, 2)))
    before = F.when(same & steep, pick(_p(0, 0), _p(0, 1))).when(same, pick(_p(0, 0), _p(1, 0)))
    before = before.when(steep, pick(_p(2, 0), _p(2, 1))).otherwise(pick(_p(2, 0), _p(1, 0)))
    rows = fact_join(n, volumes.select("volume_id", "ny", "nx"), ["volume_id"])
    inner = (F.col("y") > 0) & (F.col("x") > 0) & (F.col("y") < F.col("ny") - 1) & (F.col("x") < F.col("nx") - 1)
    return rows.filter(inner & (m >= low) & (after <= m) & (before <= m)).select("volume_id", *VOXEL, "m")


def hysteresis(edges: DataFrame, volumes: DataFrame, high: float) -> DataFrame:
    """Weak edge objects of a slice that hold a strong pixel."""
    comp = connected_components(edges.select("volume_id", *VOXEL, F.lit(1).alias("label")), volumes, 2, planar=True)
    strong = edges.filter(F.col("m") >= high).select("volume_id", *VOXEL)
    good = comp.join(strong, ["volume_id", *VOXEL]).select("volume_id", "object_id").distinct()
    return fact_join(comp, good, ["volume_id", "object_id"], "left_semi").select("volume_id", *VOXEL)


def smooth_inside(dense: DataFrame, volumes: DataFrame, sigma: float) -> DataFrame:
    """Slice blur that only averages cells inside the image: kernel weights are renormalised at the border."""
    kernel = gaussian_kernel(sigma)

    def blur(mats, extra):
        m = mats["v"]
        reach = len(kernel) // 2
        both = []
        for a in (m, np.ones((1, m.shape[1]))):
            padded = np.pad(a, ((0, 0), (reach, reach)))
            both.append(sum(w * padded[:, k : k + m.shape[1]] for k, w in enumerate(kernel)))
        return {"v": both[0] / both[1]}

    data = with_sizes(dense, volumes)
    for axis in ("x", "y"):
        data = map_lines(data, axis, blur, ["v"])
    return data.select("volume_id", *VOXEL, "v")


def _inside_blur(a: np.ndarray, kernel: np.ndarray, axis: int, ends: tuple[int, int]) -> np.ndarray:
    """Weighted mean of the cells inside the volume along ``axis``; loses the kernel's reach at both ends, outside is 0."""
    reach, size = len(kernel) // 2, a.shape[axis]
    held = np.zeros(size)
    held[ends[0] : size - ends[1]] = 1
    n = size - 2 * reach
    along = [-1 if i == axis else 1 for i in range(3)]
    cut = [slice(None)] * 3
    total, weight = 0, 0
    for k, w in enumerate(kernel):
        cut[axis] = slice(k, k + n)
        total = total + w * a[tuple(cut)]
        weight = weight + w * held[k : k + n]
    inner = held[reach : reach + n]
    return np.where(inner.reshape(along) > 0, total / np.where(inner > 0, weight, 1).reshape(along), 0.0)


def _clamped(a: np.ndarray, ends: Sequence[tuple[int, int]]) -> np.ndarray:
    """The last cells inside the volume repeated outside, in the slice's plane."""
    for axis, (first, last) in zip((1, 2), ends):
        a = np.take(a, np.clip(np.arange(a.shape[axis]), first, a.shape[axis] - 1 - last), axis)
    return a


def _around(a: np.ndarray) -> list[list[np.ndarray]]:
    """The nine neighbours in the slice of the cells that have them all."""
    h, w = a.shape[1] - 2, a.shape[2] - 2
    return [[a[:, i : i + h, j : j + w] for j in range(3)] for i in range(3)]


def _thinned(a: np.ndarray, missing: Sequence[tuple[int, int]], kernel: np.ndarray, low: float) -> np.ndarray:
    """Gradient size of the cells of a chunk that are edges, else -1: ``smooth_inside``, ``sobel`` and ``thin_edges`` in one visit."""
    reach = len(kernel) // 2
    ends = [tuple(max(m - reach, 0) for m in pair) for pair in missing[1:]]
    a = _clamped(_inside_blur(_inside_blur(a, kernel, 2, missing[2]), kernel, 1, missing[1]), ends)
    p = _around(a)
    gi = (p[2][0] + 2 * p[2][1] + p[2][2]) - (p[0][0] + 2 * p[0][1] + p[0][2])
    gj = (p[0][2] + 2 * p[1][2] + p[2][2]) - (p[0][0] + 2 * p[1][0] + p[2][0])
    ends = [tuple(max(m - 1, 0) for m in pair) for pair in ends]
    p = _around(_clamped(np.sqrt(gi * gi + gj * gj), ends))
    gi, gj, m = gi[:, 1:-1, 1:-1], gj[:, 1:-1, 1:-1], p[1][1]
    ai, aj = np.abs(gi), np.abs(gj)
    same = ((gi >= 0) & (gj >= 0)) | ((gi <= 0) & (gj <= 0))
    steep = np.where(same, ai > aj, ai >= aj)
    over = np.where(steep, ai, aj)
    w = np.where(over > 0, np.where(steep, aj, ai) / np.where(over > 0, over, 1), 0.0)
    pick = lambda diag, straight: diag * w + straight * (1 - w)
    after = np.where(same, pick(p[2][2], np.where(steep, p[2][1], p[1][2])), pick(p[0][2], np.where(steep, p[0][1], p[1][2])))
    before = np.where(same, pick(p[0][0], np.where(steep, p[0][1], p[1][0])), pick(p[2][0], np.where(steep, p[2][1], p[1][0])))
    edge = (m >= low) & (after <= m) & (before <= m)
    # The border of the slice never passes; it lies at a chunk's end if cells are missing there.
    for axis, pair in zip((1, 2), missing[1:]):
        place = np.arange(reach + 2, reach + 2 + m.shape[axis])
        inner = (place > pair[0]) & (place < m.shape[axis] + 2 * (reach + 2) - 1 - pair[1])
        edge &= inner.reshape([-1 if i == axis else 1 for i in range(3)])
    return np.where(edge, m, -1.0)


def canny(voxels: DataFrame, volumes: DataFrame, sigma: float = 1.0, low: float = 0.1, high: float = 0.3, parts: int | None = None, shape: ch.Three = ch.CHUNK_SHAPE) -> DataFrame:
    """Edges of each slice: blur, gradient, thinning, hysteresis. Absent cells are zero.

    A chunk with the cells around it goes through blur, gradient and thinning in one visit; the thin edges, read twice by the
    hysteresis, are written once.
    """
    kernel = gaussian_kernel(sigma)
    reach = len(kernel) // 2 + 2
    chunks = ch.map_chunks(
        voxels.select("volume_id", *VOXEL, "v").filter("v <> 0"), volumes, lambda a, missing: [_thinned(a, missing, kernel, low)], (0, reach, reach), shape, mode="constant", parts=parts, placed=True,
    )
    edges = ch.to_voxels(chunks, names=("m",)).filter("m >= 0")
    return hysteresis(cut_lineage(edges), volumes, high)
