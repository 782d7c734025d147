"""Dense work on chunks: array boxes of a volume, with the slabs of their neighbours' faces around them.

A chunk row holds one box of a volume as an array. For a neighbourhood operator every chunk is sent once to itself and, cut
down to the slab that is wanted there, to each neighbour within reach; one shuffle brings the pieces of a chunk together,
and array code works on the chunk with its halo. Tiles are put together in the same way, from the parts of the chunks that
they cover. A task holds one chunk and its slabs at a time; rows move as bytes of an array, not as voxels.

Cells outside a volume are made where the chunk touches its border: the edge repeated, mirrored, or a constant.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.operators.joins import VOXEL, fact_join
from voxlake.operators.lines import gaussian_kernel
from voxlake.session import dealt
from voxlake.sources.volumes import CHUNK_SHAPE

INDEX = ("cz", "cy", "cx")
LOW = ("z0", "y0", "x0")
SHAPE = ("dz", "dy", "dx")
SIZE = ("nz", "ny", "nx")
FLUSH = 1 << 22

#: key, index of the chunk (or corner of the tile), lowest cell, values, size of the volume.
Box = tuple[tuple, tuple[int, ...], tuple[int, ...], np.ndarray, tuple[int, ...]]
Three = tuple[int, int, int]


def chunk_grid(volumes: DataFrame, shape: Three = CHUNK_SHAPE, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """One row for each chunk of each volume (keys, index, volume size); a volume with an empty axis has none."""
    rows = volumes.select(*keys, *SIZE)
    for index, size, step in zip(INDEX, SIZE, shape):
        rows = rows.withColumn(index, F.explode(F.when(F.col(size) > 0, F.sequence(F.lit(0), F.floor((F.col(size) - 1) / step).cast("int")))))
    return rows.select(*keys, *INDEX, *SIZE)


def _cells(voxels: DataFrame, volumes: DataFrame, shape: Three, value: str, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """Rows of every chunk side by side: first one with the volume's size, then its voxels (place in the chunk, value)."""
    index = [F.floor(F.col(a) / s).cast("int") for a, s in zip(VOXEL, shape)]
    local = [F.col(a) - F.floor(F.col(a) / s).cast("int") * s for a, s in zip(VOXEL, shape)]
    at = ((local[0] * shape[1] + local[1]) * shape[2] + local[2]).cast("int")
    rows = voxels.select(*keys, *(i.alias(n) for i, n in zip(index, INDEX)), *(F.lit(None).cast("int").alias(n) for n in SIZE), at.alias("at"), F.col(value).cast("double").alias("v"))
    grid = chunk_grid(volumes, shape, keys).select(*keys, *INDEX, *(F.col(n).cast("int").alias(n) for n in SIZE), F.lit(-1).alias("at"), F.lit(0.0).alias("v"))
    return dealt(grid.unionByName(rows), parts, *keys, *INDEX).sortWithinPartitions(*keys, *INDEX, "at")


def _filled(parts: Iterator[pa.RecordBatch], shape: Three, n_keys: int, fill: float) -> Iterator[Box]:
    """Chunks from the rows of ``_cells``; voxels outside their volume have no chunk and are left out."""
    box = None
    for part in parts:
        if not part.num_rows:
            continue
        cols = [part.column(i) for i in range(n_keys + 3)]
        at, v = part.column("at").to_numpy(), part.column("v").to_numpy(zero_copy_only=False)
        new = at < 0
        for i in range(n_keys, n_keys + 3):
            x = cols[i].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        for c in cols[:n_keys]:
            x = c.to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        new[0] = True
        starts = np.flatnonzero(new)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(at)]):
            key, index = tuple(c[a].as_py() for c in cols[:n_keys]), tuple(c[a].as_py() for c in cols[n_keys:])
            if at[a] < 0:
                if box is not None:
                    yield box
                size = tuple(part.column(n)[a].as_py() for n in SIZE)
                low = tuple(i * s for i, s in zip(index, shape))
                box = key, index, low, np.full([min(s, n - o) for s, n, o in zip(shape, size, low)], fill), size
                a += 1
            if box is not None and box[:2] == (key, index) and a < b:
                place = np.unravel_index(at[a:b], shape)
                inside = np.all([p < d for p, d in zip(place, box[3].shape)], axis=0)
                box[3][tuple(p[inside] for p in place)] = v[a:b][inside]
    if box is not None:
        yield box


def _read(parts: Iterator[pa.RecordBatch], n_keys: int, shape: Three | None = None) -> Iterator[Box]:
    """Boxes from rows of ``_SCHEMA``, or from chunk rows (with ``shape``, by whose multiples they are placed)."""
    for part in parts:
        keys = [part.column(i).to_pylist() for i in range(n_keys)]
        index, low, dims, size = (list(zip(*(part.column(c).to_pylist() for c in names))) for names in (INDEX, LOW, SHAPE, SIZE))
        data = part.column("data")
        for i in range(part.num_rows):
            values = np.frombuffer(data[i].as_py(), np.float64) if shape is None else data[i].values.to_numpy(zero_copy_only=False).astype(np.float64)
            yield tuple(k[i] for k in keys), index[i], low[i], values.reshape(dims[i]), size[i]


def _rows(boxes: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows (key, index, low, arrays, size); the first array gives the shape."""
    held, size = [], 0
    for key, index, low, arrays, volume in boxes:
        held.append((*key, *index, *low, *arrays[0].shape, *volume, *arrays))
        size += sum(a.nbytes for a in arrays)
        if size > FLUSH or len(held) >= 2000:
            yield _packed(held, schema)
            held, size = [], 0
    if held:
        yield _packed(held, schema)


def _packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = []
    for values, field in zip(zip(*rows), schema, strict=True):
        if pa.types.is_binary(field.type):
            cols.append(pa.array([a if isinstance(a, bytes) else np.ascontiguousarray(a, np.float64).tobytes() for a in values], field.type))
        elif pa.types.is_list(field.type):
            ends = np.cumsum([0, *(a.size for a in values)])
            cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.ravel(a) for a in values]).astype(field.type.value_type.to_pandas_dtype()))))
        else:
            cols.append(pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(cols, schema=schema)


def _schema(rows: DataFrame, keys: Sequence[str], data: Sequence[tuple[str, str]]) -> tuple[str, pa.Schema]:
    """Spark and Arrow schema of box rows with the ``data`` columns (name, type)."""
    types = dict(rows.dtypes)
    ddl = ", ".join([*(f"`{k}` {types[k]}" for k in keys), *(f"{c} int" for c in (*INDEX, *LOW, *SHAPE, *SIZE)), *(f"`{n}` {t}" for n, t in data)])
    return ddl, _arrow(ddl)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def from_sparse(voxels: DataFrame, volumes: DataFrame, shape: Three = CHUNK_SHAPE, value: str = "v", fill: float = 0.0, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Chunk rows (keys, index, lowest cell, shape, volume size, data) of sparse voxels; one shuffle of the voxels."""
    n = len(keys)
    ddl, schema = _schema(voxels, keys, [("data", "array<double>")])
    return _cells(voxels, volumes, shape, value, keys).mapInArrow(lambda parts: _rows(((k, i, o, [a], s) for k, i, o, a, s in _filled(parts, shape, n, fill)), schema), ddl)


def with_sizes(chunks: DataFrame, volumes: DataFrame, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Chunk rows with the size of their volume."""
    return chunks if set(SIZE) <= set(chunks.columns) else fact_join(chunks, volumes.select(*keys, *SIZE), keys)


def to_voxels(chunks: DataFrame, out: Sequence[str] = ("data",), names: Sequence[str] = ("v",), keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Voxel rows of chunk rows; several array columns side by side."""
    i, area = F.col("i"), F.col("dy") * F.col("dx")
    rows = chunks.select(*keys, *LOW, "dy", "dx", F.posexplode(F.arrays_zip(*out)).alias("i", "s"))
    return rows.select(
        *keys, (F.col("z0") + F.floor(i / area)).cast("int").alias("z"), (F.col("y0") + F.floor(i % area / F.col("dx"))).cast("int").alias("y"), (F.col("x0") + i % F.col("dx")).cast("int").alias("x"),
        *(F.col(f"s.{c}").alias(n) for c, n in zip(out, names)),
    )


def _slabs(boxes: Iterator[Box], shape: Three, reach: Three) -> Iterator[Box]:
    """Each chunk itself, and for every chunk within reach the part of it that lies in that one's halo."""
    steps = [range(-(-(-r // s)), -(-r // s) + 1) for r, s in zip(reach, shape)]
    for key, index, low, values, size in boxes:
        yield key, index, low, values, size
        for move in product(*steps):
            if not any(move):
                continue
            to, cut = tuple(i + m for i, m in zip(index, move)), []
            for t, s, r, n, o, d in zip(to, shape, reach, size, low, values.shape):
                a, b = max(t * s - r, o), min(min((t + 1) * s, n) + r, o + d)
                if t < 0 or t * s >= n or a >= b:
                    break
                cut.append((a, b))
            if len(cut) == 3:
                yield key, to, tuple(a for a, _ in cut), values[tuple(slice(a - o, b - o) for (a, b), o in zip(cut, low))], size


def _parts_of_tiles(boxes: Iterator[Box], size: Three, starts: Callable[[int, int], Sequence[int]]) -> Iterator[Box]:
    """For every tile that a chunk touches the part of the chunk in it; the tile's corner takes the place of the index."""
    for key, _, low, values, volume in boxes:
        near = [[s for s in starts(axis, n) if s < o + d and s + t > o] for axis, (n, o, d, t) in enumerate(zip(volume, low, values.shape, size))]
        for corner in product(*near):
            cut = [(max(c, o), min(c + t, o + d)) for c, t, o, d in zip(corner, size, low, values.shape)]
            yield key, corner, tuple(a for a, _ in cut), values[tuple(slice(a - o, b - o) for (a, b), o in zip(cut, low))], volume


def _gathered(parts: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[Box]]:
    """The boxes that were sent to one place, place by place."""
    held: list[Box] = []
    for box in _read(parts, n_keys):
        if held and held[0][:2] != box[:2]:
            yield held
            held = []
        held.append(box)
    if held:
        yield held


def _joined(boxes: list[Box], low: Sequence[int], high: Sequence[int]) -> np.ndarray:
    out = np.empty([b - a for a, b in zip(low, high)])
    for _, _, at, values, _ in boxes:
        out[tuple(slice(o - a, o - a + d) for o, a, d in zip(at, low, values.shape))] = values
    return out


def _pieces(source: DataFrame, volumes: DataFrame, shape: Three, keys: Sequence[str], fill: float, cut: Callable[[Iterator[Box]], Iterator[Box]], value: str, parts: int | None = None) -> DataFrame:
    """The pieces that ``cut`` makes of each chunk. ``source``: chunk rows, or sparse voxels."""
    n = len(keys)
    ddl, schema = _schema(source, keys, [("data", "binary")])
    if set(INDEX) <= set(source.columns):
        rows = with_sizes(source, volumes, keys).select(*keys, *INDEX, *LOW, *SHAPE, *SIZE, "data")
        read = lambda parts: _read(parts, n, shape)
    else:
        rows = _cells(source, volumes, shape, value, keys, parts)
        read = lambda parts: _filled(parts, shape, n, fill)
    return rows.mapInArrow(lambda batches: _rows(((k, i, o, [a], s) for k, i, o, a, s in cut(read(batches))), schema), ddl)


def _send(source: DataFrame, volumes: DataFrame, shape: Three, keys: Sequence[str], fill: float, cut: Callable[[Iterator[Box]], Iterator[Box]], value: str, parts: int | None = None) -> DataFrame:
    """``_pieces``, dealt by their new place."""
    return dealt(_pieces(source, volumes, shape, keys, fill, cut, value, parts), parts, *keys, *INDEX).sortWithinPartitions(*keys, *INDEX)


def map_chunks(
    source: DataFrame, volumes: DataFrame, fn: Callable[[np.ndarray], Sequence[np.ndarray]], reach: Three, shape: Three = CHUNK_SHAPE,
    out: Sequence[str] = ("data",), mode: str = "edge", fill: float = 0.0, outside: float = 0.0, value: str = "v", keys: Sequence[str] = ("volume_id",),
    parts: int | None = None, placed: bool = False,
) -> DataFrame:
    """Chunk rows with the arrays that ``fn`` gives for each chunk.

    ``fn`` gets the chunk with ``reach`` cells around it and returns one array of the chunk's own shape for each name of
    ``out``. ``mode`` is numpy's name for what lies outside the volume (``edge``, ``symmetric``, ``reflect``), or ``constant`` for
    ``outside``. ``source`` are chunk rows of ``shape``, or sparse voxels, whose absent cells are ``fill``. With ``placed``, ``fn``
    also gets how many cells at each end of each axis lie outside the volume.
    """
    n = len(keys)
    ddl, schema = _schema(source, keys, [(c, "array<double>") for c in out])

    def around(boxes: list[Box]) -> tuple:
        key, index, _, _, size = boxes[0]
        low = [i * s for i, s in zip(index, shape)]
        high = [min(o + s, m) for o, s, m in zip(low, shape, size)]
        near = [max(o - r, 0) for o, r in zip(low, reach)], [min(h + r, m) for h, r, m in zip(high, reach, size)]
        missing = [(r - (o - a), r - (b - h)) for r, o, a, b, h in zip(reach, low, near[0], near[1], high)]
        values = _joined(boxes, *near)
        padded = np.pad(values, missing, mode, **({"constant_values": outside} if mode == "constant" else {}))
        return key, index, tuple(low), [np.asarray(a, np.float64) for a in (fn(padded, missing) if placed else fn(padded))], size

    sent = _send(source, volumes, shape, keys, fill, lambda boxes: _slabs(boxes, shape, reach), value, parts)
    return sent.mapInArrow(lambda batches: _rows(map(around, _gathered(batches, n)), schema), ddl)


def ragged_starts(stride: Three) -> Callable[[int, int], Sequence[int]]:
    """Tiles at every multiple of the stride; those at the end are cut off by the volume."""
    return lambda axis, n: range(0, n, stride[axis])


def clamped_starts(size: Three, stride: Three) -> Callable[[int, int], Sequence[int]]:
    """Tiles that lie inside the volume: the last one is moved back to end with it."""
    return lambda axis, n: sorted({min(s, max(n - size[axis], 0)) for s in range(0, max(n - size[axis], 0) + stride[axis], stride[axis])})


def tiles(
    source: DataFrame, volumes: DataFrame, size: Three, starts: Callable[[int, int], Sequence[int]], normalise: bool = True, eps: float = 1e-6,
    shape: Three = CHUNK_SHAPE, fill: float = 0.0, value: str = "v", keys: Sequence[str] = ("volume_id",), parts: int | None = None,
) -> DataFrame:
    """(keys, z0, y0, x0, at, data): one row for each tile, with its cells' places in a whole tile and their values.

    With ``normalise`` the mean is taken off and divided by the deviation (plus ``eps``) before any padding. Tiles are made
    where a chunk lies, so a tile inside a volume is whole.
    """
    n = len(keys)
    types = dict(source.dtypes)
    ddl = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "z0 int, y0 int, x0 int, at array<int>, data array<double>"])
    schema = _arrow(ddl)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells = [], 0
        for boxes in _gathered(parts, n):
            key, corner, _, _, volume = boxes[0]
            high = [min(c + t, m) for c, t, m in zip(corner, size, volume)]
            values = _joined(boxes, corner, high)
            if normalise:
                values = (values - values.mean()) / (values.std() + eps)
            places = np.ravel_multi_index(np.indices(values.shape), size)
            held.append((*key, *corner, places, values))
            cells += values.size
            if cells > FLUSH // 8:
                yield _packed(held, schema)
                held, cells = [], 0
        if held:
            yield _packed(held, schema)

    return _send(source, volumes, shape, keys, fill, lambda boxes: _parts_of_tiles(boxes, size, starts), value, parts).mapInArrow(run, ddl)


def _correlate(a: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """The inner part of a symmetric correlation along ``axis``, summed from one end to the other."""
    n = a.shape[axis] - len(kernel) + 1
    cut = [slice(None)] * a.ndim
    out = 0.0
    for k, w in enumerate(kernel):
        cut[axis] = slice(k, k + n)
        out = out + w * a[tuple(cut)]
    return out


def gaussian(source: DataFrame, volumes: DataFrame, sigma: float, truncate: float = 4.0, shape: Three = CHUNK_SHAPE, keys: Sequence[str] = ("volume_id",), planar: bool = False) -> DataFrame:
    """Chunk rows of the separable Gaussian blur, the edge repeated outside; one shuffle for all axes."""
    kernel = gaussian_kernel(sigma, truncate)
    r = len(kernel) // 2
    axes = (2, 1) if planar else (2, 1, 0)

    def blur(a: np.ndarray) -> list[np.ndarray]:
        for axis in axes:
            a = _correlate(a, kernel, axis)
        return [a]

    return map_chunks(source, volumes, blur, (0 if planar else r, r, r), shape, keys=keys)


def _box_sum(a: np.ndarray, window: int) -> np.ndarray:
    """Sums of the windows of the last two axes."""
    for axis in (2, 1):
        total = np.cumsum(a, axis=axis)
        first = np.take(total, [window - 1], axis)
        head, tail = [slice(None)] * 3, [slice(None)] * 3
        head[axis], tail[axis] = slice(window, None), slice(None, -window)
        a = np.concatenate([first, total[tuple(head)] - total[tuple(tail)]], axis)
    return a


def sauvola(source: DataFrame, volumes: DataFrame, window: int = 25, k: float = 0.2, r: float = 127.5, shape: Three = CHUNK_SHAPE, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Chunk rows with ``data``, ``threshold`` = mean x (1 + k (std / R - 1)) of the window, slice by slice, mirrored at the border."""
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    reach = window // 2

    def local(a: np.ndarray) -> list[np.ndarray]:
        mean = _box_sum(a, window) / window**2
        deviation = np.sqrt(np.maximum(_box_sum(a * a, window) / window**2 - mean * mean, 0.0))
        return [a[:, reach : a.shape[1] - reach, reach : a.shape[2] - reach], mean * (1 + k * (deviation / r - 1))]

    return map_chunks(source, volumes, local, (0, reach, reach), shape, ("data", "threshold"), "reflect", keys=keys)


def ball(radius: int) -> np.ndarray:
    """A digital ball of radius r holds the offsets within r + 1/2."""
    span = np.arange(-radius, radius + 1) ** 2
    return span[:, None, None] + span[None, :, None] + span[None, None, :] <= (radius + 0.5) ** 2


def _any_in(a: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Whether some cell of the structure around each inner cell is set."""
    size = [n - s + 1 for n, s in zip(a.shape, shape.shape)]
    out = np.zeros(size, bool)
    for z, y, x in np.argwhere(shape).tolist():
        out |= a[z : z + size[0], y : y + size[1], x : x + size[2]]
    return out


def opening(mask: DataFrame, volumes: DataFrame, radius: int, shape: Three = CHUNK_SHAPE, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Voxels of the mask's opening by a ball: erosion and dilation of a chunk in one visit, with two radii around it.

    Outside the volume counts as foreground for the erosion and holds nothing that could be dilated from.
    """
    structure = ball(radius)

    def opened(a: np.ndarray) -> list[np.ndarray]:
        # 1 in the mask, 0 in the volume, -1 outside.
        kept = ~_any_in(a == 0, structure)
        inner = tuple(slice(radius, n - radius) for n in a.shape)
        return [_any_in(kept & (a[inner] >= 0), structure)]

    rows = mask.select(*keys, *VOXEL, F.lit(1.0).alias("v"))
    chunks = map_chunks(rows, volumes, opened, (2 * radius,) * 3, shape, mode="constant", outside=-1.0, keys=keys)
    return to_voxels(chunks, keys=keys).filter("v > 0").select(*keys, *VOXEL)
