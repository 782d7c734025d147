"""Work along whole image lines: Spark gathers each line, array code transforms batches of them.

Volume-wide separable operators (blur, distance, Fourier transform) take one pass and one shuffle per axis; a
task holds some lines at a time, never a volume.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.operators.joins import VOXEL, fact_join

# Rows gathered before a matrix is made: enough to fill array code, small beside executor memory.
LINE_BATCH = 100_000

LineFunction = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], dict[str, np.ndarray]]


def with_sizes(rows: DataFrame, volumes: DataFrame) -> DataFrame:
    """Adds nz, ny, nx unless the rows carry them already."""
    if {"nz", "ny", "nx"} <= set(rows.columns):
        return rows
    return fact_join(rows, volumes.select("volume_id", "nz", "ny", "nx"), ["volume_id"])


def map_lines(
    rows: DataFrame,
    axis: str,
    fn: LineFunction,
    values: Sequence[str],
    out: Sequence[str] | None = None,
    keys: Sequence[str] = ("volume_id",),
    carry: Sequence[str] = (),
    fill: float = 0.0,
    keep: str | None = None,
) -> DataFrame:
    """Apply ``fn`` to every line along ``axis`` that has at least one row.

    ``rows`` carries nz, ny, nx; absent cells read as ``fill``. ``fn`` gets value matrices (line, position) and
    the ``carry`` columns (one entry per line) and returns matrices for ``out``. ``keep`` is a filter on
    the result rows.
    """
    out = list(out or values)
    others = [a for a in VOXEL if a != axis]
    line = [*keys, *others]
    fixed = [*line, "nz", "ny", "nx", *carry]
    types = dict(rows.dtypes)
    spread = rows.select(*fixed, axis, *[F.col(c).cast("double").alias(c) for c in values])
    spread = spread.repartition(*line).sortWithinPartitions(*line)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in (*fixed, axis)], *[f"`{c}` double" for c in out]])

    def transform(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole lines, each beginning at one of ``starts``: one matrix per line length."""
        sizes = table.column(f"n{axis}").to_numpy()[starts]
        line_of = np.zeros(table.num_rows, dtype=np.int64)
        line_of[starts[1:]] = 1
        line_of = np.cumsum(line_of)
        at = table.column(axis).to_numpy()
        data = {c: table.column(c).to_numpy() for c in values}
        for n in np.unique(sizes):
            lines = np.flatnonzero(sizes == n)
            place = np.full(len(starts), -1)
            place[lines] = np.arange(len(lines))
            rows_here = np.flatnonzero(place[line_of] >= 0)
            mats = {}
            for c in values:
                m = np.full((len(lines), int(n)), fill)
                m[place[line_of[rows_here]], at[rows_here]] = data[c][rows_here]
                mats[c] = m
            heads = table.take(pa.array(starts[lines]))
            got = fn(mats, {c: heads.column(c).to_numpy() for c in carry})
            every = heads.select(fixed).take(pa.array(np.repeat(np.arange(len(lines)), int(n))))
            cols = [every.column(c) for c in fixed]
            cols.append(pa.array(np.tile(np.arange(int(n)), len(lines)), type=table.schema.field(axis).type))
            cols += [pa.array(np.ascontiguousarray(got[c], dtype=np.float64).ravel()) for c in out]
            yield from pa.table(cols, names=[*fixed, axis, *out]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < LINE_BATCH:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            starts = _line_starts(table, line)
            last = int(starts[-1])
            if last == 0:
                continue
            held = table.slice(last).to_batches()
            yield from transform(table.slice(0, last), starts[:-1])
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from transform(table, _line_starts(table, line))

    done = spread.mapInArrow(run, schema)
    return done.filter(keep) if keep else done


def _line_starts(table: pa.Table, line: Sequence[str]) -> np.ndarray:
    """Row numbers where a new line begins (rows of a line follow one another)."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for c in line:
        values = table.column(c).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> np.ndarray:
    reach = int(truncate * sigma + 0.5)
    if reach == 0:
        return np.ones(1)
    x = np.arange(-reach, reach + 1)
    w = np.exp(-0.5 * (x / sigma) ** 2)
    return w / w.sum()


def convolve_edges(m: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Line convolution with a symmetric kernel; the edge cell repeats outside."""
    reach = len(kernel) // 2
    padded = np.pad(m, ((0, 0), (reach, reach)), mode="edge")
    out = np.zeros_like(m)
    for k, w in enumerate(kernel):
        out += w * padded[:, k : k + m.shape[1]]
    return out


def gaussian(
    rows: DataFrame, volumes: DataFrame, sigma: float | str, axes: Sequence[str] = VOXEL, keys: Sequence[str] = ("volume_id",), truncate: float = 4.0
) -> DataFrame:
    """Separable Gaussian blur of sparse voxels, edge cells repeated outside.

    ``sigma`` is a number, or the name of a column constant on each line (one blur per slice).
    Only lines that hold a voxel are touched; untouched cells are zero and stay absent.
    """
    named = isinstance(sigma, str)
    carry = [sigma] if named else []

    def blur(mats, extra):
        m = mats["v"]
        if not named:
            return {"v": convolve_edges(m, gaussian_kernel(sigma, truncate))}
        out = np.empty_like(m)
        sigmas = extra[sigma].astype(float)
        for s in np.unique(sigmas):
            hit = sigmas == s
            out[hit] = convolve_edges(m[hit], gaussian_kernel(s, truncate))
        return {"v": out}

    data = with_sizes(rows.select(*keys, *VOXEL, "v", *carry), volumes)
    for axis in axes:
        data = map_lines(data, axis, blur, ["v"], keys=keys, carry=carry, keep="v <> 0")
    return data.select(*keys, *VOXEL, "v", *carry)


def _spread(m: np.ndarray, limit: float) -> np.ndarray:
    """min over j of m[j] + (i - j)^2, for all lines at once; stops when no step can help or passes the limit."""
    out = m.copy()
    n = m.shape[1]
    k = 1
    while k < n and k * k <= limit:
        step = float(k * k)
        finite = out[np.isfinite(out)]
        if np.isfinite(out).all() and (not finite.size or finite.max() <= step):
            break
        np.minimum(out[:, k:], m[:, :-k] + step, out=out[:, k:])
        np.minimum(out[:, :-k], m[:, k:] + step, out=out[:, :-k])
        k += 1
    return out


def squared_distance(
    sites: DataFrame, volumes: DataFrame, axes: Sequence[str] = VOXEL, keys: Sequence[str] = ("volume_id",), limit: float = float("inf")
) -> DataFrame:
    """Squared distance of grid cells to the nearest site voxel, one pass per axis.

    Cells further than ``limit`` (squared) are absent, so a small limit keeps every pass near the sites.
    """
    keep = "v < double('infinity')" if limit == float("inf") else f"v <= {limit}"

    def pass_(mats, extra):
        return {"v": _spread(mats["v"], limit)}

    data = with_sizes(sites.withColumn("v", F.lit(0.0)), volumes).select(*keys, *VOXEL, "nz", "ny", "nx", "v")
    for axis in axes:
        data = map_lines(data, axis, pass_, ["v"], keys=keys, fill=float("inf"), keep=keep)
    return data.select(*keys, *VOXEL, F.col("v").cast("bigint").alias("d2"))


def own_squared_distance(rows: DataFrame, volumes: DataFrame, axes: Sequence[str], keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Squared distance (d2) of the cells with ``_own`` 1 to the nearest with 0 of the same key; null where there is none.

    The cells that ask travel with the sites, so the last pass gives their rows alone and none of the field around them. A cell that
    isn't in its volume, or of which a key or coordinate is null, has none.
    """
    asked = F.col("_own") == 1
    inf = F.lit(float("inf"))
    marked = rows.select(*keys, *VOXEL, F.when(asked, inf).otherwise(0.0).alias("v"), F.when(asked, 1.0).otherwise(inf).alias("own"))
    sized = fact_join(marked, volumes.select("volume_id", "nz", "ny", "nx"), ["volume_id"], "left")
    held = [F.col(k).isNotNull() for k in keys] + [(F.col(a) >= 0) & (F.col(a) < F.col(f"n{a}")) for a in VOXEL]
    inside = F.coalesce(reduce(and_, held), F.lit(False))
    apart = sized.filter(~inside & (F.col("own") == 1)).select(*keys, *VOXEL, F.lit(None).cast("bigint").alias("d2"))
    data = sized.filter(inside).select(*keys, *VOXEL, "nz", "ny", "nx", "v", "own")

    def pass_(mats, extra):
        return {"v": _spread(mats["v"], float("inf")), "own": mats["own"]}

    for i, axis in enumerate(axes):
        keep = "own = 1" if i == len(axes) - 1 else "v < double('infinity') or own = 1"
        data = map_lines(data, axis, pass_, ["v", "own"], keys=keys, fill=float("inf"), keep=keep)
    return data.select(*keys, *VOXEL, F.when(F.col("v") < inf, F.col("v").cast("bigint")).alias("d2")).unionByName(apart)
