"""Fourier transforms on bundles of whole image lines.

Between two axes the spectrum is cut into blocks and dealt anew, so a task holds a bundle of lines as one array, never a
volume. The input is real: only half of the frequencies along x are kept, and the other half is their mirror image. All bands
of a filter travel in one array, so the number of shuffles doesn't depend on how many there are: one to each further axis and
one back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxlake.operators import chunks as ch
from voxlake.operators.chunks import INDEX, LOW, SHAPE, SIZE, Box
from voxlake.session import cut_lineage, dealt

#: Lines of a bundle, by axis; along its own axis a line is whole.
BLOCK = (8, 32, 32)
#: More cells than any line has.
WHOLE = 1 << 22

#: Signed distances (z, y, x) of a bundle's cells from the zero frequency, and the volume's size, to the gains of the bands.
Gain = Callable[[tuple[np.ndarray, np.ndarray, np.ndarray], Sequence[int], object], np.ndarray]


def _schema(rows: DataFrame, keys: Sequence[str]) -> tuple[str, pa.Schema]:
    return ch._schema(rows, keys, [("data", "binary")])


def _packed(boxes: Iterator[Box], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Complex boxes (bands, z, y, x) as rows."""
    held, size = [], 0
    for key, index, low, values, volume in boxes:
        data = np.ascontiguousarray(values, np.complex128).tobytes()
        held.append((*key, *index, *low, *values.shape[-3:], *volume, data))
        size += len(data)
        if size > ch.FLUSH or len(held) >= 2000:
            yield ch._packed(held, schema)
            held, size = [], 0
    if held:
        yield ch._packed(held, schema)


def _read(parts: Iterator[pa.RecordBatch], n_keys: int, extra: str | None = None) -> Iterator[tuple]:
    """The boxes of rows; with ``extra`` each beside its value of that column."""
    for part in parts:
        keys = [part.column(i).to_pylist() for i in range(n_keys)]
        index, low, dims, size = (list(zip(*(part.column(c).to_pylist() for c in names))) for names in (INDEX, LOW, SHAPE, SIZE))
        data, more = part.column("data"), part.column(extra) if extra else None
        for i in range(part.num_rows):
            box = tuple(k[i] for k in keys), index[i], low[i], np.frombuffer(data[i].as_py(), np.complex128).reshape(-1, *dims[i]), size[i]
            yield (box, more[i].as_py()) if extra else box


def _gathered(parts: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[Box]:
    """The pieces that were sent to one bundle, joined along the one axis that they were cut on."""
    held: list[Box] = []

    def joined() -> Box:
        low = tuple(min(b[2][i] for b in held) for i in range(3))
        axis = next((i for i in range(3) if len({b[2][i] for b in held}) > 1), 0)
        pieces = sorted(held, key=lambda b: b[2][axis])
        return held[0][0], held[0][1], low, np.concatenate([b[3] for b in pieces], axis - 3), held[0][4]

    for box in _read(parts, n_keys):
        if held and held[0][:2] != box[:2]:
            yield joined()
            held = []
        held.append(box)
    if held:
        yield joined()


def _cut(box: Box, axis: int, whole: int) -> Iterator[Box]:
    """The box in blocks along ``axis``, each for the bundle that is whole along ``whole``."""
    key, _, low, values, size = box
    for start in range(0, values.shape[axis - 3], BLOCK[axis]):
        at = list(low)
        at[axis] += start
        to = tuple(0 if i == whole else at[i] // BLOCK[i] for i in range(3))
        piece = [slice(None)] * 4
        piece[axis + 1] = slice(start, start + BLOCK[axis])
        yield key, to, tuple(at), values[tuple(piece)], size


def _dealt(rows: DataFrame, run, ddl: str, keys: Sequence[str], parts: int | None) -> DataFrame:
    return dealt(rows.mapInArrow(run, ddl), parts, *keys, *INDEX).sortWithinPartitions(*keys, *INDEX)


def forward(sparse: DataFrame, volumes: DataFrame, space: bool, keys: Sequence[str] = ("volume_id",), parts: int | None = None) -> DataFrame:
    """The half spectrum of each slice (bundles along y) or volume (bundles along z), written once.

    ``parts``: partitions of each step. A Python worker holds up to ten thousand of a partition's bundles at once.
    """
    n, shape = len(keys), (*BLOCK[:2], WHOLE)
    ddl, schema = _schema(sparse, keys)

    def along_x(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = ((k, i, o, np.fft.rfft(a, axis=2)[None], s) for k, i, o, a, s in ch._filled(parts, shape, n, 0.0))
        return _packed((piece for box in boxes for piece in _cut(box, 2, 1)), schema)

    def transformed(parts: Iterator[pa.RecordBatch], axis: int) -> Iterator[Box]:
        return ((k, i, o, np.fft.fft(a, axis=axis - 3), s) for k, i, o, a, s in _gathered(parts, n))

    rows = _dealt(ch._cells(sparse, volumes, shape, "v", keys, parts), along_x, ddl, keys, parts)
    if space:
        rows = _dealt(rows, lambda batches: _packed((piece for box in transformed(batches, 1) for piece in _cut(box, 1, 0)), schema), ddl, keys, parts)
    return cut_lineage(rows.mapInArrow(lambda batches: _packed(transformed(batches, 0 if space else 1), schema), ddl))


def offsets(low: Sequence[int], shape: Sequence[int], size: Sequence[int], space: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signed distances of the cells of a bundle from the zero frequency; z counts from the first slice unless ``space``."""
    out = []
    for i, (o, d, n) in enumerate(zip(low, shape, size)):
        k = np.arange(o, o + d)
        k = k if i == 0 and not space else (k + n // 2) % n - n // 2
        out.append(k.reshape([-1 if i == j else 1 for j in range(3)]))
    return tuple(out)


def _scaled(z: np.ndarray, y: np.ndarray, x: np.ndarray, size: Sequence[int], space: bool) -> np.ndarray:
    """Distance from the zero frequency, rows scaled by nx / ny, and z by nz / max(ny, nx)."""
    return np.sqrt(x * x + (y * (size[2] / size[1])) ** 2 + ((z * size[0] / max(size[1:])) ** 2 if space else 0))


def weights(low: Sequence[int], shape: Sequence[int], size: Sequence[int]) -> np.ndarray:
    """How many cells of the whole spectrum each cell of the half stands for, along x."""
    k = np.arange(low[2], low[2] + shape[2])
    return np.where((k == 0) | (2 * k == size[2]), 1, 2)


def backward(
    spectrum: DataFrame, space: bool, gain: Gain, finish: Callable[[np.ndarray], np.ndarray], extra: str, keys: Sequence[str] = ("volume_id",),
    parts: int | None = None,
) -> DataFrame:
    """Chunk rows of ``finish`` of the bands (band, z, y, x) that the ``gain`` lets through.

    ``spectrum`` are rows of ``forward`` with a column ``extra``, which ``gain`` gets as its third argument.
    """
    n = len(keys)
    rows = spectrum.select(*keys, *INDEX, *LOW, *SHAPE, *SIZE, "data", extra)
    rows = rows.repartition(parts, *keys, *INDEX) if parts else rows
    ddl, schema = _schema(spectrum, keys)
    out_ddl, out_schema = ch._schema(spectrum, keys, [("data", "array<double>")])

    def filtered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def boxes() -> Iterator[Box]:
            for (key, index, low, values, size), more in _read(parts, n, extra):
                bands = values * gain(offsets(low, values.shape[-3:], size, space), size, more)
                box = key, index, low, np.fft.ifft(bands, axis=-3 if space else -2), size
                # Bundles along z are cut for those along y; those along y for the ones along x.
                yield from _cut(box, 0, 1) if space else _cut(box, 1, 2)

        return _packed(boxes(), schema)

    def along_y(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = ((k, i, o, np.fft.ifft(a, axis=-2), s) for k, i, o, a, s in _gathered(parts, n))
        return _packed((piece for box in boxes for piece in _cut(box, 1, 2)), schema)

    def along_x(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return ch._rows(((k, i, o, [finish(np.fft.irfft(a, s[2], axis=-1))], s) for k, i, o, a, s in _gathered(parts, n)), out_schema)

    rows = _dealt(rows, filtered, ddl, keys, parts)
    if space:
        rows = _dealt(rows, along_y, ddl, keys, parts)
    return rows.mapInArrow(along_x, out_ddl)


def of_whole(a: np.ndarray, space: bool) -> np.ndarray:
    """The half spectra of whole volumes (volume, z, y, x), as ``forward`` makes them."""
    spectrum = np.fft.fft(np.fft.rfft(a, axis=-1), axis=-2)
    return np.fft.fft(spectrum, axis=-3) if space else spectrum


def to_whole(spectra: np.ndarray, size: Sequence[int], space: bool, gains: np.ndarray) -> np.ndarray:
    """The bands (volume, band, z, y, x) that the ``gains`` let through, as ``backward`` makes them."""
    bands = spectra[:, None] * gains
    bands = np.fft.ifft(bands, axis=-3) if space else bands
    return np.fft.irfft(np.fft.ifft(bands, axis=-2), size[2], axis=-1)


def radial_parts(spectrum: DataFrame, space: bool, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """(keys, z unless ``space``, radius, total, cells, far): power of the cells at each whole distance, by bundle.

    Cells without power are left out; ``far`` is their greatest distance. Rows are scaled by nx / ny, and z by nz / max(ny, nx).
    """
    n = len(keys)
    types = dict(spectrum.dtypes)
    ddl = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "z int, radius int, total double, cells long, far double"])
    schema = ch._arrow(ddl)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, low, values, size in _read(parts, n):
            z, y, x = offsets(low, values.shape[-3:], size, space)
            flat = _scaled(z, y, x, size, space)
            power = values[0].real ** 2 + values[0].imag ** 2
            times = np.broadcast_to(weights(low, values.shape[-3:], size), power.shape)
            for i in range(1 if space else len(power)):
                p, d, t = (power, flat, times) if space else (power[i], flat[0], times[i])
                seen = p > 0
                if not seen.any():
                    continue
                radius = np.floor(d[seen]).astype(int)
                cells, total, far = np.bincount(radius, t[seen]), np.bincount(radius, t[seen] * p[seen]), np.zeros(radius.max() + 1)
                np.maximum.at(far, radius, d[seen])
                at = np.flatnonzero(cells)
                slice_ = None if space else low[0] + i
                cols = [[k] * len(at) for k in key] + [[slice_] * len(at), at, total[at], cells[at].astype(np.int64), far[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return spectrum.mapInArrow(run, ddl)


def whole_radial_parts(spectra: np.ndarray, size: Sequence[int]) -> tuple[np.ndarray, ...]:
    """``radial_parts`` in space of whole volumes' spectra: the volume's place, radius, total, cells and far of each row."""
    shape = spectra.shape[1:]
    flat = _scaled(*offsets((0, 0, 0), shape, size, True), size, True).ravel()
    times = np.broadcast_to(weights((0, 0, 0), shape, size), shape).ravel()
    power = (spectra.real**2 + spectra.imag**2).reshape(len(spectra), -1)
    of, at = np.nonzero(power > 0)
    bins = int(flat.max()) + 1
    code = of * bins + np.floor(flat[at]).astype(int)
    many = len(spectra) * bins
    cells, total, far = np.bincount(code, times[at], many), np.bincount(code, times[at] * power[of, at], many), np.zeros(many)
    np.maximum.at(far, code, flat[at])
    held = np.flatnonzero(cells)
    return held // bins, held % bins, total[held], cells[held].astype(np.int64), far[held]
