"""Moving voxels: views, projections, resampling, crops, pads, shifts, displacement."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.operators import chunks as ch
from voxlake.operators import whole as wh
from voxlake.operators.joins import VOXEL, densify, fact_join, voxel_grid
from voxlake.operators.voxel import draw, hash_normal
from voxlake.session import dealt

# The coordinate order of each view of a (z, y, x) volume.
VIEWS = {"XY": ("z", "y", "x"), "XZ": ("y", "z", "x"), "YZ": ("x", "z", "y")}


def multiview(voxels: DataFrame, views: Sequence[str] = ("XY", "XZ", "YZ")) -> DataFrame:
    """Each voxel once per view with permuted coordinates (a, b, c); no shuffle."""
    if not views:
        raise ValueError("at least one view is needed")
    rows = [F.struct(F.lit(n).alias("view"), *[F.col(s).alias(t) for s, t in zip(VIEWS[n], "abc")]) for n in views]
    rest = [c for c in voxels.columns if c not in VOXEL]
    return voxels.select(*rest, F.explode(F.array(*rows)).alias("_p")).select(*rest, "_p.view", "_p.a", "_p.b", "_p.c")


def undo_view(rows: DataFrame) -> DataFrame:
    """Permuted coordinates back to (z, y, x)."""
    cols = []
    for axis in VOXEL:
        pick = F.lit(None)
        for view, order in VIEWS.items():
            pick = F.when(F.col("view") == view, F.col("abc"[order.index(axis)])).otherwise(pick)
        cols.append(pick.cast("int").alias(axis))
    rest = [c for c in rows.columns if c not in ("a", "b", "c")]
    return rows.select(*rest, *cols)


def max_projection(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("volume_id", "y", "x").agg(F.max("v").alias("v"))


def middle_slice(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    middle = volumes.select("volume_id", F.floor(F.col("nz") / 2).cast("int").alias("z"))
    return fact_join(voxels, middle, ["volume_id", "z"]).drop("z")


def _with_dims(voxels: DataFrame, volumes: DataFrame, targets: dict[str, Column]) -> DataFrame:
    dims = volumes.select("volume_id", *[F.col(f"n{a}").alias(f"_n{a}") for a in VOXEL], *[targets[a].alias(f"_m{a}") for a in VOXEL])
    return fact_join(voxels, dims, ["volume_id"])


def spacing_targets(new: float) -> dict[str, Column]:
    """Target sizes for a new spacing: size x old spacing / new spacing, cut to whole voxels, one at least."""
    return {a: F.greatest((F.col(f"n{a}") * F.col(f"spacing_{a}") / new).cast("int"), F.lit(1)) for a in VOXEL}


def resample_spacing(voxels: DataFrame, volumes: DataFrame, new: float, how: str = "linear", value: str = "v") -> DataFrame:
    """Resampling to exactly ``new`` spacing on every axis, the old centre kept; target cells outside the volume are absent.

    Cell t of the target reads the source at n / 2 - m a / 2 + t a, where a is new over old spacing. ``how`` is linear or
    nearest; nothing is joined but the volume table, and linear reading sums once per axis.
    """
    if how not in ("linear", "nearest"):
        raise ValueError("how must be linear or nearest")
    sizes = spacing_targets(new)
    facts = [c for a in VOXEL for c in (F.col(f"n{a}").alias(f"_n{a}"), sizes[a].alias(f"_m{a}"), (F.lit(new) / F.col(f"spacing_{a}")).alias(f"_a{a}"))]
    rows = fact_join(voxels.select("volume_id", *VOXEL, value), volumes.select("volume_id", *facts), ["volume_id"])
    carried = [f"_{k}{a}" for a in VOXEL for k in "nma"]
    for axis in reversed(VOXEL):
        i, n, m, a = F.col(axis), F.col(f"_n{axis}"), F.col(f"_m{axis}"), F.col(f"_a{axis}")
        start = n / 2 - m * a / 2
        inside = lambda t: (start + t * a >= -0.5) & (start + t * a < n - 0.5)  # noqa: B023, E731
        at = lambda t: F.greatest(F.lit(0.0), F.least(n - 1.0, start + t * a))  # noqa: B023, E731
        low = F.when(i == 0, 0).otherwise(F.greatest(F.floor((i - 1.0 - start) / a) - 1, F.lit(0))).cast("int")
        high = F.when(i == n - 1, m - 1).otherwise(F.least(F.ceil((i + 1.0 - start) / a) + 1, m - 1)).cast("int")
        near = (lambda t: F.abs(at(t) - i) < 1) if how == "linear" else (lambda t: F.least(F.floor(start + t * a + 0.5), n - 1) == i)  # noqa: B023
        spots = F.when(low <= high, F.filter(F.sequence(low, high), lambda t: inside(t) & near(t)))  # noqa: B023
        sent = rows.withColumn("_t", F.explode(spots))
        keep = [x for x in VOXEL if x != axis]
        if how == "nearest":
            rows = sent.drop(axis).withColumnRenamed("_t", axis)
        else:
            weighted = F.sum(F.col(value) * (1.0 - F.abs(at(F.col("_t")) - i)))
            rows = sent.groupBy("volume_id", *keep, F.col("_t").alias(axis), *carried).agg(weighted.alias(value))
    return rows.select("volume_id", *VOXEL, value)


def _targets_of(i: Column, n: Column, m: Column, pick) -> Column:
    """Target cells t in 0..m-1 around source cell i that satisfy ``pick(t)``."""
    low = F.greatest(F.floor((i - 1.0) * m / n) - 1, F.lit(0)).cast("int")
    high = F.least(F.ceil((i + 2.0) * m / n) + 1, m - 1).cast("int")
    low = F.when(i == 0, 0).otherwise(F.least(low, high))
    high = F.when(i == n - 1, m - 1).otherwise(high)
    return F.filter(F.sequence(low, high), pick)


def resample_nearest(voxels: DataFrame, volumes: DataFrame, targets: dict[str, Column], align_corners: bool = False) -> DataFrame:
    """Nearest-neighbour resampling pushed from source to target cells: a projection, no join on voxels."""
    rows = _with_dims(voxels, volumes, targets)
    for axis in VOXEL:
        i, n, m = F.col(axis), F.col(f"_n{axis}"), F.col(f"_m{axis}")

        def source(t):
            if align_corners:
                at = F.when(m > 1, t * (n - 1) / (m - 1)).otherwise(0.0)
                return F.floor(at + 0.5)
            return F.floor((t + 0.5) * n / m)

        hits = _targets_of(i, n, m, lambda t: F.least(source(t), n - 1) == i)
        rows = rows.withColumn(axis, F.explode(hits))
    return rows.drop(*[f"_{k}{a}" for k in "nm" for a in VOXEL])


def resample_linear(voxels: DataFrame, volumes: DataFrame, targets: dict[str, Column], align_corners: bool = False) -> DataFrame:
    """Linear resampling, one axis at a time: each source cell sends its weighted value to the few target
    cells within one step, and a grouped sum collects them. Edges repeat the last cell."""
    rows = _with_dims(voxels.select("volume_id", *VOXEL, "v"), volumes, targets)
    dims = [f"_{k}{a}" for k in "nm" for a in VOXEL]
    for axis in reversed(VOXEL):
        i, n, m = F.col(axis), F.col(f"_n{axis}"), F.col(f"_m{axis}")

        def at(t):
            if align_corners:
                return F.when(m > 1, t * (n - 1) / (m - 1)).otherwise(0.0)
            return F.greatest(F.lit(0.0), F.least(n - 1.0, (t + 0.5) * n / m - 0.5))

        hits = _targets_of(i, n, m, lambda t: F.abs(at(t) - i) < 1)
        sent = rows.withColumn("_t", F.explode(hits)).withColumn("_w", F.col("v") * (1.0 - F.abs(at(F.col("_t")) - i)))
        keep = [a for a in VOXEL if a != axis]
        rows = (
            sent.groupBy("volume_id", *keep, F.col("_t").alias(axis), *dims).agg(F.sum("_w").alias("v"))
        )
    return rows.select("volume_id", *VOXEL, "v")


def centre_crop_or_pad(voxels: DataFrame, volumes: DataFrame, targets: dict[str, Column]) -> DataFrame:
    """Centre crop where the volume is larger, shift into the centre where it is smaller (new cells stay absent)."""
    rows = _with_dims(voxels, volumes, targets)
    keep = F.lit(True)
    for axis in VOXEL:
        n, m = F.col(f"_n{axis}"), F.col(f"_m{axis}")
        crop = F.floor(F.greatest(n - m, F.lit(0)) / 2).cast("int")
        pad = F.floor(F.greatest(m - n, F.lit(0)) / 2).cast("int")
        rows = rows.withColumn(axis, F.col(axis) - crop + pad)
        keep = keep & (F.col(axis) >= 0) & (F.col(axis) < m)
    return rows.filter(keep).drop(*[f"_{k}{a}" for k in "nm" for a in VOXEL])


def mask_boxes(mask: DataFrame, volumes: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """Box of the given size around the whole-number mean coordinate of the mask, clipped to the volume.

    A volume whose mask is empty gets the box around its own centre.
    """
    mean = mask.groupBy("volume_id").agg(*[F.avg(a).cast("int").alias(f"_c{a}") for a in VOXEL])
    rows = volumes.select("volume_id", "nz", "ny", "nx").join(mean, "volume_id", "left")
    cols = []
    for axis, s in zip(VOXEL, size):
        n = F.col(f"n{axis}")
        middle = F.coalesce(F.col(f"_c{axis}"), F.floor(n / 2).cast("int"))
        start = F.least(F.greatest(middle - s // 2, F.lit(0)), F.greatest(n - s, F.lit(0)))
        cols += [start.alias(f"{axis}0"), F.least(F.lit(s), n).alias(f"d{axis}")]
    return rows.select("volume_id", *cols)


def crop_or_pad_boxes(mask: DataFrame, volumes: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """Box of exactly the given size around the centre of the mask's bounding box, or of a volume without mask.

    It may begin before the volume or end after it: cropping then pads, as cells that no voxel fills are absent.
    """
    edge = mask.groupBy("volume_id").agg(*[f(a).alias(f"_{n}{a}") for a in VOXEL for f, n in ((F.min, "a"), (F.max, "b"))])
    rows = volumes.select("volume_id", "nz", "ny", "nx").join(edge, "volume_id", "left")
    cols = []
    for axis, s in zip(VOXEL, size):
        # Twice the centre, ends included; a centre between two cells goes down where the size asks for a whole one.
        twice = F.coalesce(F.col(f"_a{axis}") + F.col(f"_b{axis}") + 1, F.col(f"n{axis}"))
        cols += [F.floor((twice - s) / 2).cast("int").alias(f"{axis}0"), F.lit(s).alias(f"d{axis}")]
    return rows.select("volume_id", *cols)


def bounding_boxes(mask: DataFrame, volumes: DataFrame, margin: int) -> DataFrame:
    """Foreground box grown by a margin and clamped to the volume; the whole volume if there is no foreground."""
    edge = mask.groupBy("volume_id").agg(*[f(a).alias(f"_{n}{a}") for a in VOXEL for f, n in ((F.min, "a"), (F.max, "b"))])
    rows = volumes.select("volume_id", "nz", "ny", "nx").join(edge, "volume_id", "left")
    cols = []
    for axis in VOXEL:
        low = F.greatest(F.coalesce(F.col(f"_a{axis}") - margin, F.lit(0)), F.lit(0))
        high = F.least(F.coalesce(F.col(f"_b{axis}") + margin, F.col(f"n{axis}")), F.col(f"n{axis}") - 1)
        cols += [low.alias(f"{axis}0"), (high - low + 1).alias(f"d{axis}")]
    return rows.select("volume_id", *cols)


def crop(voxels: DataFrame, boxes: DataFrame) -> DataFrame:
    """One box per volume: keep the voxels inside and count coordinates from its corner."""
    rows = fact_join(voxels, boxes, ["volume_id"])
    keep = F.lit(True)
    for axis in VOXEL:
        rows = rows.withColumn(axis, F.col(axis) - F.col(f"{axis}0"))
        keep = keep & (F.col(axis) >= 0) & (F.col(axis) < F.col(f"d{axis}"))
    return rows.filter(keep).select(*voxels.columns)


def shift(voxels: DataFrame, volumes: DataFrame, axis: str, step: Column) -> DataFrame:
    """Zero-filling shift; ``step`` may use volume_id."""
    n = volumes.select("volume_id", F.col(f"n{axis}").alias("_n"))
    rows = fact_join(voxels, n, ["volume_id"]).withColumn(axis, (F.col(axis) + step).cast("int"))
    return rows.filter((F.col(axis) >= 0) & (F.col(axis) < F.col("_n"))).drop("_n")


def roll(voxels: DataFrame, volumes: DataFrame, axis: str, step: Column) -> DataFrame:
    n = volumes.select("volume_id", F.col(f"n{axis}").alias("_n"))
    rows = fact_join(voxels, n, ["volume_id"])
    return rows.withColumn(axis, F.pmod(F.col(axis) + step, F.col("_n")).cast("int")).drop("_n")


def flip(voxels: DataFrame, volumes: DataFrame, axes: Sequence[str]) -> DataFrame:
    n = volumes.select("volume_id", *[F.col(f"n{a}").alias(f"_n{a}") for a in axes])
    rows = fact_join(voxels, n, ["volume_id"])
    for axis in axes:
        rows = rows.withColumn(axis, F.col(f"_n{axis}") - 1 - F.col(axis))
    return rows.drop(*[f"_n{a}" for a in axes])


def drop_slices(voxels: DataFrame, dropped: DataFrame) -> DataFrame:
    """Blank the listed (volume_id, z) slices."""
    return fact_join(voxels, dropped.select("volume_id", "z").distinct(), ["volume_id", "z"], "left_anti")


def _zoom_sizes(volumes: DataFrame, seed: int, scale) -> DataFrame:
    """``volumes`` with their zoomed sizes mz, my, mx."""
    sized = volumes
    for axis in VOXEL:
        size = F.bround(F.col(f"n{axis}") * draw(*scale, f"zoom{axis}", seed), 0).cast("int")
        sized = sized.withColumn(f"m{axis}", size)
    return sized


def zoom_pair(image: DataFrame, mask: DataFrame, volumes: DataFrame, seed: int, scale=(0.9, 1.1), together: bool = False) -> tuple[DataFrame, DataFrame] | DataFrame:
    """The same zoom per volume for both (linear, nearest; corners aligned), then crop or pad to the old size.

    With ``together`` the image's absent cells are zeros, and one table (volume_id, z, y, x, v, label) has its cells with the mask's label
    there, if any: volumes that fit a task are made dense, zoomed and cut in one visit.
    """
    if together:
        small, large, parts = wh.told_apart(volumes)
        whole = None if small is None else _whole_zoom(image, mask, _zoom_sizes(small, seed, scale), parts)
        if large is None:
            return whole
        zoomed, labels = zoom_pair(densify(image, large, {"v": 0.0}), mask, large, seed, scale)
        joined = zoomed.join(labels.select("volume_id", *VOXEL, "label"), ["volume_id", *VOXEL], "left")
        return joined if whole is None else whole.unionByName(joined)
    sized = _zoom_sizes(volumes, seed, scale)
    new = {a: F.col(f"m{a}") for a in VOXEL}
    old = {a: F.col(f"old{a}") for a in VOXEL}
    back = sized.select("volume_id", *[F.col(f"m{a}").alias(f"n{a}") for a in VOXEL], *[F.col(f"n{a}").alias(f"old{a}") for a in VOXEL])
    return (
        centre_crop_or_pad(resample_linear(image, sized, new, True), back, old),
        centre_crop_or_pad(resample_nearest(mask, sized, new, True), back, old),
    )


def _whole_zoom(sparse: DataFrame, mask: DataFrame, sized: DataFrame, parts: int) -> DataFrame:
    """``zoom_pair`` as one table, of volumes that fit a task each: one shuffle of both tables."""

    def aligned(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        """The target cells that stay inside the old size (after crop or pad), and the place that each reads, corners aligned."""
        t = np.arange(m)
        to = t - max(m - n, 0) // 2 + max(n - m, 0) // 2
        kept = (to >= 0) & (to < n)
        at = t * (n - 1) / (m - 1) if m > 1 else np.zeros(m)
        return to[kept], at[kept]

    def linear(a: np.ndarray, at: np.ndarray, axis: int) -> np.ndarray:
        low = np.floor(at).astype(np.int64)
        along = [-1 if i == axis else 1 for i in range(4)]
        out = 0.0
        for i in (low, low + 1):
            near = (np.abs(at - i) < 1) & (i < a.shape[axis])
            weight = (1.0 - np.abs(at - i)).reshape(along)
            out = out + np.where(near.reshape(along), np.take(a, np.minimum(i, a.shape[axis] - 1), axis) * weight, 0.0)
        return out

    kind, label = dict(sized.dtypes)["volume_id"], dict(mask.dtypes)["label"]
    schema = ch._arrow(f"volume_id {kind}, z int, y int, x int, v double, label {label}")

    def zoomed(g: wh.Group) -> Iterator[pa.RecordBatch]:
        rows, cell, first, many = wh.cells(g, 1)
        dense = np.zeros(many.sum())
        np.add.at(dense, cell, g.column("v", rows))
        rows, cell, _, _ = wh.cells(g, 2)
        order = np.argsort(cell, kind="stable")
        rows, cell = rows[order], cell[order]
        sizes = [g.head(f"{k}{a}") for k in "nm" for a in VOXEL]
        for (*n, mz, my, mx), heads in wh.alike(*sizes):
            (z, y, x), at = zip(*(aligned(a, b) for a, b in zip(n, (mz, my, mx))))
            if not (len(heads) and len(z) and len(y) and len(x)):
                continue
            a = dense[first[heads][:, None] + np.arange(np.prod(n))].reshape(len(heads), *n)
            for axis in (2, 1, 0):
                a = linear(a, at[axis], axis + 1)
            source = [np.minimum(np.floor(p + 0.5), k - 1).astype(np.int64) for p, k in zip(at, n)]
            place = ((source[0][:, None, None] * n[1] + source[1][:, None]) * n[2] + source[2]).ravel()
            wanted = (first[heads][:, None] + place).ravel()
            low, high = np.searchsorted(cell, wanted), np.searchsorted(cell, wanted, "right")
            # A cell without a label has one row, and one with several a row for each.
            times = np.maximum(high - low, 1)
            hit = wh.runs(low, times)
            found = np.repeat(high > low, times)
            labels = g.table.column("label").take(pa.array(rows[hit * found] if len(rows) else np.zeros(len(hit), np.int64), mask=~found))
            i = np.repeat(np.arange(len(wanted)), times)
            of, k = heads[i // len(place)], i % len(place)
            where = z[k // (len(y) * len(x))], y[k // len(x) % len(y)], x[k % len(x)]
            cols = [*g.keys(["volume_id"], of), *(pa.array(c.astype(np.int32)) for c in where), pa.array(a.ravel()[i]), labels]
            yield from pa.table(cols, schema=schema).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in wh.groups(batches, ["volume_id"]):
            if len(g.heads):
                yield from zoomed(g)

    heads = sized.select("volume_id", *(F.col(f"{k}{a}").cast("int").alias(f"{k}{a}") for k in "nm" for a in VOXEL))
    image = sparse.select("volume_id", *VOXEL, F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v"))
    tables = [t.filter(F.col("volume_id").isNotNull()) for t in (image, mask.select("volume_id", *VOXEL, "label"))]
    return wh.beside(heads, tables, ["volume_id"], parts).mapInArrow(run, f"volume_id {kind}, z int, y int, x int, v double, label {label}")


def _reflect(i: Column, n: Column) -> Column:
    """Half-sample mirror: d c b a | a b c d | d c b a."""
    k = F.pmod(i, 2 * n)
    # Never null for a volume with cells; said so, as a join would else make the places twice to leave nulls out.
    return F.coalesce(F.when(k >= n, 2 * n - 1 - k).otherwise(k), F.lit(0)).cast("int")


def displaced(volumes: DataFrame, seed: int, alpha: float = 2.0) -> DataFrame:
    """Every grid cell with the point it is read from: its own place plus alpha x a normal draw per axis."""
    cells = voxel_grid(volumes, keep=("nz", "ny", "nx"))
    return cells.select("*", *[(F.col(a) + alpha * hash_normal(f"move{a}", seed)).alias(f"s{a}") for a in VOXEL])


#: What a point needs to read its chunk: the place there of the lower of its cells, and the weights of the next one on each axis.
POINT = ("wz", "wy", "wx")


def displace_image(voxels: DataFrame, volumes: DataFrame, points: DataFrame, shape: ch.Three = ch.CHUNK_SHAPE, parts: int | None = None) -> DataFrame:
    """Linear reading at displaced points; absent voxels are zero.

    A point is sent once, to the chunk of the lowest of its eight cells, and a chunk goes there with the cells next to it.
    """
    index, local, weights = [], [], []
    for axis, size in zip(VOXEL, shape):
        n, base = F.col(f"n{axis}"), F.floor(F.col(f"s{axis}"))
        part = F.col(f"s{axis}") - base
        one, two = _reflect(base, n), _reflect(base + 1, n)
        low = F.least(one, two)
        index.append(F.floor(low / size).cast("int").alias(f"c{axis}"))
        local.append(F.pmod(low, F.lit(size)))
        # Backwards inside a mirrored copy; at its ends both are one cell.
        weights.append(F.when(one < two, part).when(one > two, 1.0 - part).otherwise(0.0).alias(f"w{axis}"))
    at = ((local[0] * shape[1] + local[1]) * shape[2] + local[2]).cast("int").alias("at")
    sent = points.filter(F.col("volume_id").isNotNull()).select("volume_id", *index, at, *VOXEL, *weights)
    none = [F.lit(None).cast("int").alias(c) for c in (*ch.LOW, *ch.SHAPE, *ch.SIZE)]
    sent = sent.select(*sent.columns, *none, F.lit(None).cast("binary").alias("data"))
    keys = ("volume_id",)
    boxes = ch._pieces(voxels.select("volume_id", *VOXEL, "v"), volumes, shape, keys, 0.0, lambda b: ch._slabs(b, shape, (1, 1, 1)), "v", parts)
    boxes = boxes.select("*", F.lit(-1).alias("at"), *(F.lit(None).cast("int").alias(a) for a in VOXEL), *(F.lit(None).cast("double").alias(w) for w in POINT))
    both = dealt(sent.unionByName(boxes), parts, *keys, *ch.INDEX).sortWithinPartitions(*keys, *ch.INDEX, "at")
    ddl = f"volume_id {dict(points.dtypes)['volume_id']}, z int, y int, x int, v double"
    schema = ch._arrow(ddl)

    def read(values: np.ndarray, first: list[int], part: pa.RecordBatch) -> np.ndarray:
        place = np.unravel_index(part.column("at").to_numpy(zero_copy_only=False).astype(np.int64), shape)
        one = [p + f for p, f in zip(place, first)]
        two = [np.minimum(p + 1, n - 1) for p, n in zip(one, values.shape)]
        w = [part.column(c).to_numpy(zero_copy_only=False) for c in POINT]
        total = 0.0
        for corner in product((0, 1), repeat=3):
            share = 1.0
            for c, x in zip(corner, w):
                share = share * (x if c else 1.0 - x)
            total = total + share * values[tuple(b if c else a for c, a, b in zip(corner, one, two))]
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, values, first = None, [], None, None
        for part in batches:
            if not part.num_rows:
                continue
            names = [*keys, *ch.INDEX]
            at, out = part.column("at").to_numpy(), []
            new = np.ones(part.num_rows, bool)
            new[1:] = (at[1:] < 0) != (at[:-1] < 0)
            for c in names:
                x = part.column(c).to_numpy(zero_copy_only=False)
                new[1:] |= x[1:] != x[:-1]
            starts = np.flatnonzero(new).tolist()
            for a, b in zip(starts, [*starts[1:], part.num_rows]):
                key = tuple(part.column(c)[a].as_py() for c in names)
                if key != now:
                    now, held, values = key, [], None
                rows = part.slice(a, b - a)
                if at[a] < 0:
                    held += ch._read(iter([rows]), 1)
                elif held:
                    if values is None:
                        low = [min(box[2][i] for box in held) for i in range(3)]
                        high = [max(box[2][i] + box[3].shape[i] for box in held) for i in range(3)]
                        values, first = ch._joined(held, low, high), [c * s - o for c, s, o in zip(key[1:], shape, low)]
                    out.append(pa.RecordBatch.from_arrays([rows.column(c).cast(schema.field(c).type) for c in (*keys, *VOXEL)] + [pa.array(read(values, first, rows))], schema=schema))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return both.mapInArrow(run, ddl)


def displace_mask(mask: DataFrame, points: DataFrame) -> DataFrame:
    """Nearest reading at displaced points; only foreground cells come back."""
    src = [_reflect(F.floor(F.col(f"s{a}") + 0.5), F.col(f"n{a}")).alias(f"_s{a}") for a in VOXEL]
    rows = points.select("volume_id", *VOXEL, *src)
    values = mask.select("volume_id", *[F.col(a).alias(f"_s{a}") for a in VOXEL], "label")
    return rows.hint("merge").join(values, ["volume_id", *[f"_s{a}" for a in VOXEL]]).select("volume_id", *VOXEL, "label")
