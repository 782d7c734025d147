"""Whole volumes or slices that fit a task: one shuffle brings the rows of each to one place, beside a row with its size.

What works on neighbours, lines or groups inside a volume then needs no other shuffle. Volumes that don't fit are told apart; they
take the ways by chunks, lines and joins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.operators.joins import fact_join
from voxlake.operators.lines import LINE_BATCH
from voxlake.session import dealt, parts_for

SIZE = ("nz", "ny", "nx")
#: Cells of a volume, or of a slice, that a task works on at once.
WHOLE_CELLS = 1 << 20
#: Cells that array code takes at once where one volume or slice has fewer.
BLOCK_CELLS = 1 << 18


def told_apart(volumes: DataFrame, axes: Sequence[str] = SIZE, nulls: bool = True, limit: int | None = None) -> tuple[DataFrame | None, DataFrame | None, int]:
    """Volumes whose cells along ``axes`` fit a task, the others (None if there are none), and partitions for the cells of the first.

    Ids that come twice fit none; without ``nulls`` neither does the null id.
    """
    cells = lambda names: reduce(lambda a, b: a * b, [F.col(n).cast("bigint") for n in names])
    fits = cells(axes) <= F.lit(WHOLE_CELLS if limit is None else limit)
    fits = F.coalesce(reduce(and_, [F.col(n).isNotNull() for n in SIZE], fits), F.lit(False))
    fits = fits if nulls else fits & F.col("volume_id").isNotNull()
    named = F.when(fits, F.struct("volume_id"))
    all_, some, ids, total = volumes.agg(F.count("*"), F.count(named), F.count_distinct(named), F.sum(F.when(fits, cells(SIZE)))).first()
    if some != ids:
        return None, volumes, 1
    parts = parts_for(volumes.sparkSession, total or 0)
    return volumes.filter(fits) if some else None, volumes.filter(~fits) if some < all_ else None, parts


def of_volumes(rows: DataFrame, volumes: DataFrame) -> DataFrame:
    """The rows of the given volumes."""
    return fact_join(rows, volumes.select("volume_id").distinct(), ["volume_id"], "left_semi")


def beside(heads: DataFrame, tables: Sequence[DataFrame], keys: Sequence[str], parts: int) -> DataFrame:
    """Rows of ``heads`` (``_t`` 0) and of the tables (1, 2, ..), those of a key side by side; columns that a table hasn't are null."""
    rows = heads.withColumn("_t", F.lit(0))
    for i, table in enumerate(tables, 1):
        rows = rows.unionByName(table.withColumn("_t", F.lit(i)), allowMissingColumns=True)
    return dealt(rows, parts, *keys).sortWithinPartitions(*keys)


def _starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for c in keys:
        values = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


class Group:
    """Whole keys of a table of ``beside``: rows of table ``t`` with the number of their key, and the keys' head rows."""

    def __init__(self, table: pa.Table, starts: np.ndarray):
        self.table, self.starts = table, starts
        at = np.repeat(np.arange(len(starts)), np.diff([*starts, table.num_rows]))
        kind = table.column("_t").to_numpy()
        self.heads = np.flatnonzero(kind == 0)
        # Rows of a key without a head belong to no volume.
        place = np.full(len(starts), -1)
        place[at[self.heads]] = np.arange(len(self.heads))
        self._of, self._kind = place[at], kind

    def head(self, name: str) -> np.ndarray:
        return self.table.column(name).take(pa.array(self.heads)).to_numpy()

    def rows(self, t: int, needed: Sequence[str] = ()) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of table ``t``, and the place of each one's key among the heads; only those that have the ``needed`` columns."""
        held = (self._kind == t) & (self._of >= 0)
        for c in needed:
            held &= self.table.column(c).is_valid().to_numpy()
        at = np.flatnonzero(held)
        return at, self._of[at]

    def column(self, name: str, at: np.ndarray) -> np.ndarray:
        return self.table.column(name).take(pa.array(at)).to_numpy()

    def keys(self, names: Sequence[str], of: np.ndarray) -> list[pa.ChunkedArray]:
        """The key columns of the heads at ``of``."""
        return self.table.select(names).take(pa.array(self.heads[of])).columns


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], axes: Sequence[str] = SIZE) -> Iterator[Group]:
    """Tables of whole keys, of about ``BLOCK_CELLS`` cells (``axes`` of their heads) or one key each."""

    def cut(table: pa.Table, starts: np.ndarray) -> Iterator[Group]:
        cells = np.ones(table.num_rows, np.int64)
        for c in axes:
            cells = cells * table.column(c).fill_null(0).to_numpy().astype(np.int64)
        block = np.cumsum(np.add.reduceat(np.where(table.column("_t").to_numpy() == 0, cells, 0), starts)) // BLOCK_CELLS
        first = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist()]
        ends = [*starts.tolist(), table.num_rows]
        for a, b in zip(first, [*first[1:], len(starts)]):
            yield Group(table.slice(ends[a], ends[b] - ends[a]), starts[a:b] - starts[a])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < LINE_BATCH:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        at = _starts(table, keys)
        if len(at) > 1:
            yield from cut(table.slice(0, int(at[-1])), at[:-1])
            held = table.slice(int(at[-1])).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from cut(table, _starts(table, keys))


def cells(g: Group, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of table ``t`` inside their volumes, their cells, and the first cell and the volume's number of cells of each head.

    Cells of a group are numbered in raster order, volume after volume. A row without a place has no cell.
    """
    size = np.stack([g.head(n).astype(np.int64) for n in SIZE])
    rows, of = g.rows(t, ("z", "y", "x"))
    at = np.stack([g.column(a, rows).astype(np.int64) for a in ("z", "y", "x")])
    inside = ((at >= 0) & (at < size[:, of])).all(0)
    rows, of, (z, y, x) = rows[inside], of[inside], at[:, inside]
    many = size.prod(0)
    first = np.cumsum(many) - many
    return rows, first[of] + (z * size[1, of] + y) * size[2, of] + x, first, many


def places(g: Group, cell: np.ndarray, first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The head of each cell, and its z, y and x."""
    of = np.repeat(np.arange(len(many)), many)[cell]
    ny, nx = g.head("ny").astype(np.int64)[of], g.head("nx").astype(np.int64)[of]
    at = cell - first[of]
    return of, at // (ny * nx), at // nx % ny, at % nx


def percentiles(values: np.ndarray, of: np.ndarray, groups: int, probs: Sequence[float]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Values of each group, and its percentiles with linear interpolation (0 without values)."""
    many = np.bincount(of, minlength=groups)
    order, first = np.lexsort((values, of)), np.cumsum(many) - many
    out = []
    for p in probs:
        at = p * (many - 1)
        low, high = (values[order[np.where(many > 0, first + f(at).astype(np.int64), 0)]] if len(values) else np.zeros(groups) for f in (np.floor, np.ceil))
        out.append(np.where(many > 0, low + (high - low) * (at - np.floor(at)), 0.0))
    return many, out


def alike(*columns: np.ndarray) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """The distinct rows of whole numbers, and where each is found."""
    kinds, of = np.unique(np.stack(columns, 1), axis=0, return_inverse=True)
    of = of.ravel()
    for i, kind in enumerate(kinds.tolist()):
        yield tuple(kind), np.flatnonzero(of == i)


def runs(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, .. of each run of ``many``, run after run."""
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
