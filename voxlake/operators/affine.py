"""Volumes in space: orientation, crops that keep their place, and resampling from one grid to another.

A frame is a volume's grid in the world: its size and a 4 x 4 matrix (16 numbers, row by row) that takes the cell (x, y, z) to
millimetres to the right, to the front and up. Reorienting is a projection: axes change places or run backwards. Resampling
asks, for every cell of the target, where it lies in the source: each source chunk is sent, cut down to what is wanted, to the
target chunks whose preimage it meets, so a volume of any size is resampled chunk by chunk with one shuffle of array boxes.
Whatever was done to a volume, its frame went along, so a result goes back to the first grid by one more resampling.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.operators import chunks as ch
from voxlake.operators.chunks import INDEX, LOW, SHAPE, SIZE, Box, Three
from voxlake.operators.joins import VOXEL, fact_join
from voxlake.operators.voxel import draw
from voxlake.sources.volumes import CHUNK_SHAPE

#: Letters of the two ends of each axis of the world.
ENDS = (("L", "R"), ("P", "A"), ("I", "S"))
AXES = ("x", "y", "z")
FRAME = "volume_id {key}, nz int, ny int, nx int, affine array<double>"


def frames(volumes: DataFrame, affine: Column | None = None) -> DataFrame:
    """(volume_id, nz, ny, nx, affine); without an affine one that has only the volume's spacing."""
    if affine is None:
        diagonal = [*(F.col(f"spacing_{a}").cast("double") for a in AXES), F.lit(1.0)]
        affine = F.array(*(d if i == j else F.lit(0.0) for i, d in enumerate(diagonal) for j in range(4)))
    return volumes.select("volume_id", *(F.col(n).cast("int").alias(n) for n in SIZE), affine.alias("affine"))


def _matrix(affine) -> np.ndarray:
    return np.asarray(affine, float).reshape(4, 4)


def axis_places(affine: np.ndarray) -> list[tuple[int, int]]:
    """For x, y, z the nearest axis of the world (0, 1, 2) and its direction (1, -1).

    The matrix without its spacing is taken to the nearest rotation; the axis that agrees best with one of the world chooses
    first. Of two that agree equally the earlier one chooses.
    """
    turn = affine[:3, :3] / np.where((size := np.sqrt((affine[:3, :3] ** 2).sum(0))) == 0, 1, size)
    u, s, v = np.linalg.svd(turn)
    near = (u[:, s > s.max() * 3 * np.finfo(float).eps] @ v[s > s.max() * 3 * np.finfo(float).eps]).round(12)
    out: list[tuple[int, int]] = [(-1, 1)] * 3
    for axis in np.argsort(-np.abs(near).max(0), kind="stable"):
        world = int(np.abs(near[:, axis]).argmax())
        out[axis] = world, -1 if near[world, axis] < 0 else 1
        near[world] = 0
    return out


def axis_codes(affine: np.ndarray) -> str:
    """The three letters of the directions in which x, y and z run."""
    return "".join(ENDS[w][d > 0] for w, d in axis_places(affine))


def orientations(frames_: DataFrame, codes: str = "RAS") -> DataFrame:
    """frames with old_codes, and for each axis of the new volume ``from_<axis>``, the old one, and ``flip_<axis>``.

    nz, ny, nx and the affine are those of the volume after the turn; ``old_n<axis>`` are the sizes before. An axis keeps its
    distance of cells.
    """
    wanted = [next((w, 1 if c == pair[1] else -1) for w, pair in enumerate(ENDS) if c in pair) for c in codes]
    if sorted(w for w, _ in wanted) != [0, 1, 2]:
        raise ValueError("codes must name each of the three directions once")
    key = dict(frames_.dtypes)["volume_id"]
    schema = FRAME.format(key=key) + ", old_codes string, " + ", ".join(f"from_{a} string, flip_{a} boolean, old_n{a} int" for a in AXES)

    def turned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for volume, nz, ny, nx, affine in part.itertuples(index=False):
                affine, size = _matrix(affine), (nx, ny, nz)
                have, turn, row = axis_places(affine), np.zeros((4, 4)), {}
                turn[3, 3] = 1
                for new, (world, way) in enumerate(wanted):
                    old = [w for w, _ in have].index(world)
                    flip = have[old][1] != way
                    # The old coordinate of a new cell.
                    turn[old, new], turn[old, 3] = (-1, size[old] - 1) if flip else (1, 0)
                    row |= {f"from_{AXES[new]}": AXES[old], f"flip_{AXES[new]}": flip, f"n{AXES[new]}": size[old], f"old_n{AXES[new]}": size[new]}
                rows.append({"volume_id": volume, "affine": (affine @ turn).ravel().tolist(), "old_codes": "".join(ENDS[w][d > 0] for w, d in have), **row})
            names = ["volume_id", *SIZE, "affine", "old_codes", *(c for a in AXES for c in (f"from_{a}", f"flip_{a}", f"old_n{a}"))]
            yield pd.DataFrame(rows, columns=names)

    return frames_.select("volume_id", *SIZE, "affine").mapInPandas(turned, schema)


def reorient(voxels: DataFrame, turned: DataFrame) -> DataFrame:
    """Voxel rows in the grids of ``orientations``: a projection, without a shuffle but for the facts of each volume."""
    facts = turned.select("volume_id", *(F.col(f"{c}_{a}").alias(f"_{c}{a}") for a in AXES for c in ("from", "flip")), *(F.col(f"old_n{a}").alias(f"_n{a}") for a in AXES))
    rows = fact_join(voxels, facts, ["volume_id"])
    new = {}
    for a in AXES:
        place = size = F.lit(None).cast("int")
        for b in AXES:
            place, size = F.when(F.col(f"_from{a}") == b, F.col(b)).otherwise(place), F.when(F.col(f"_from{a}") == b, F.col(f"_n{b}")).otherwise(size)
        new[a] = F.when(F.col(f"_flip{a}"), size - 1 - place).otherwise(place).cast("int")
    return rows.select(*(new[c].alias(c) if c in new else F.col(c) for c in voxels.columns))


def crop_frames(frames_: DataFrame, boxes: DataFrame) -> DataFrame:
    """Frames of boxes (volume_id, z0, y0, x0, dz, dy, dx) cut out of the volumes; a box may stick out."""
    rows = fact_join(frames_, boxes.select("volume_id", *LOW, *SHAPE), ["volume_id"])
    cell = [F.get("affine", F.lit(i)) for i in range(16)]
    moved = [cell[4 * i + j] if j < 3 else cell[4 * i + 3] + sum(cell[4 * i + k] * F.col(f"{a}0") for k, a in enumerate(AXES)) for i in range(3) for j in range(4)]
    return rows.select("volume_id", *(F.col(d).cast("int").alias(n) for d, n in zip(SHAPE, SIZE)), F.array(*moved, *cell[12:]).alias("affine"))


def crop(voxels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Voxel rows inside their volume's box, counted from its corner."""
    rows = fact_join(voxels, boxes.select("volume_id", *LOW, *SHAPE), ["volume_id"])
    inside = F.lit(True)
    for a in VOXEL:
        inside = inside & (F.col(a) >= F.col(f"{a}0")) & (F.col(a) < F.col(f"{a}0") + F.col(f"d{a}"))
    return rows.filter(inside).select(*((F.col(c) - F.col(f"{c}0")).cast("int").alias(c) if c in VOXEL else F.col(c) for c in voxels.columns))


def random_affine(frames_: DataFrame, seed: int, angle: float = 0.26, scale: float = 0.2, share: float = 0.2) -> DataFrame:
    """Frames turned and scaled about the volume's centre, for ``resample_to``: the same for an image and its label.

    A ``share`` of the volumes is changed; angles about x, y and z lie within ``angle``, factors within 1 +- ``scale``. Numbers are
    drawn from the volume's id.
    """
    c = lambda tag: F.cos(draw(-angle, angle, f"turn {tag}", seed))
    s = lambda tag: F.sin(draw(-angle, angle, f"turn {tag}", seed))
    zero, one = F.lit(0.0), F.lit(1.0)
    turns = [
        [[one, zero, zero], [zero, c("x"), -s("x")], [zero, s("x"), c("x")]],
        [[c("y"), zero, s("y")], [zero, one, zero], [-s("y"), zero, c("y")]],
        [[c("z"), -s("z"), zero], [s("z"), c("z"), zero], [zero, zero, one]],
    ]
    size = [draw(1 - scale, 1 + scale, f"scale {a}", seed) for a in AXES]
    names = [f"_{what}{i}{j}" for what in "abc" for i in range(3) for j in range(3)]
    facts = frames_.select("*", *(m[i][j].alias(f"_{what}{i}{j}") for what, m in zip("abc", turns) for i in range(3) for j in range(3)), *(x.alias(f"_s{i}") for i, x in enumerate(size)))
    times = lambda a, b: [[sum((F.col(f"{a}{i}{k}") * F.col(f"{b}{k}{j}") for k in range(1, 3)), F.col(f"{a}{i}0") * F.col(f"{b}0{j}")) for j in range(3)] for i in range(3)]
    both = facts.select("*", *(x.alias(f"_d{i}{j}") for i, row in enumerate(times("_a", "_b")) for j, x in enumerate(row)))
    turn = both.select("*", *((x * F.col(f"_s{j}")).alias(f"_m{i}{j}") for i, row in enumerate(times("_d", "_c")) for j, x in enumerate(row)))
    middle = [(F.col(f"n{a}") - 1) / 2 for a in AXES]
    shift = [middle[i] - sum((F.col(f"_m{i}{j}") * middle[j] for j in range(1, 3)), F.col(f"_m{i}0") * middle[0]) for i in range(3)]
    cell = [F.get("affine", F.lit(i)) for i in range(16)]
    new = []
    for i in range(3):
        new += [sum((cell[4 * i + k] * F.col(f"_m{k}{j}") for k in range(1, 3)), cell[4 * i] * F.col(f"_m0{j}")) for j in range(3)]
        new.append(cell[4 * i + 3] + sum((cell[4 * i + k] * shift[k] for k in range(1, 3)), cell[4 * i] * shift[0]))
    changed = F.when(draw(0.0, 1.0, "affine", seed) < share, F.array(*new, *cell[12:])).otherwise(F.col("affine"))
    return turn.select("volume_id", *SIZE, changed.alias("affine")).drop(*names)


def _warps(source: DataFrame, target: DataFrame) -> DataFrame:
    """(volume_id, warp): bytes of the target's size and of the matrix from its cells (z, y, x) to those of the source."""
    key = dict(source.dtypes)["volume_id"]
    both = source.select("volume_id", F.col("affine").alias("a")).join(target.select("volume_id", *SIZE, F.col("affine").alias("b")), "volume_id")

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = np.eye(4)[[2, 1, 0, 3]]
        for part in parts:
            warps = [np.array([*size, *(turn @ np.linalg.solve(_matrix(a), _matrix(b)) @ turn)[:3].ravel()], float).tobytes() for a, b, *size in part[["a", "b", *SIZE]].itertuples(index=False)]
            yield pd.DataFrame({"volume_id": part["volume_id"], "warp": pd.Series(warps, index=part.index, dtype=object)})

    return both.mapInPandas(packed, f"volume_id {key}, warp binary")


def _unpacked(warp: bytes) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Size of the target, matrix and shift."""
    numbers = np.frombuffer(warp)
    m = numbers[3:].reshape(3, 4)
    return numbers[:3].astype(int).tolist(), m[:, :3], m[:, 3]


def _bounds(low: Sequence[float], high: Sequence[float], m: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest coordinates of a mapped box."""
    corners = np.array(list(product(*zip(low, high))), float) @ m.T + t
    return corners.min(0), corners.max(0)


def _wanted(low: Sequence[int], high: Sequence[int], m: np.ndarray, t: np.ndarray, size: Sequence[int]) -> list[tuple[int, int]]:
    """Source cells (half-open, for each axis) that the target cells low .. high - 1 can read."""
    a, b = _bounds(low, [h - 1 for h in high], m, t)
    return [(max(math.floor(p), 0), min(math.floor(q) + 2, n)) for p, q, n in zip(a - 1e-6, b + 1e-6, size)]


def _sent(boxes: Iterator[Box], shape: Three) -> Iterator[Box]:
    """Of each source chunk the part that each target chunk wants; the target chunk's index takes the place of its own."""
    for key, _, low, values, size in boxes:
        target, m, t = _unpacked(key[-1])
        high = [o + d for o, d in zip(low, values.shape)]
        back = np.linalg.inv(m)
        a, b = _bounds([o - 1 for o in low], high, back, -back @ t)
        spans = [range(max(math.floor((p - 1e-6) / s), 0), min(math.floor((q + 1e-6) / s), (n - 1) // s) + 1) for p, q, s, n in zip(a, b, shape, target)]
        for to in product(*spans):
            first = [i * s for i, s in zip(to, shape)]
            need = _wanted(first, [min(f + s, n) for f, s, n in zip(first, shape, target)], m, t, size)
            cut = [(max(p, o), min(q, h)) for (p, q), o, h in zip(need, low, high)]
            if all(p < q for p, q in cut):
                yield key, to, tuple(p for p, _ in cut), values[tuple(slice(p - o, q - o) for (p, q), o in zip(cut, low))], size


def _sampled(boxes: list[Box], shape: Three, how: str, fill: float) -> tuple:
    """The target chunk that the boxes were sent to."""
    key, index, _, _, size = boxes[0]
    target, m, t = _unpacked(key[-1])
    low = [i * s for i, s in zip(index, shape)]
    high = [min(o + s, n) for o, s, n in zip(low, shape, target)]
    need = _wanted(low, high, m, t, size)
    values = np.full([q - p for p, q in need], fill)
    for _, _, at, part, _ in boxes:
        values[tuple(slice(o - p, o - p + d) for o, (p, _), d in zip(at, need, part.shape))] = part
    cells = np.stack(np.meshgrid(*(np.arange(a, b) for a, b in zip(low, high)), indexing="ij"))
    place = [sum((m[i, j] * cells[j] for j in range(1, 3)), m[i, 0] * cells[0]) + t[i] for i in range(3)]
    inside = np.all([(p >= -0.5) & (p < n - 0.5) for p, n in zip(place, size)], axis=0)
    if how == "nearest":
        near = [np.clip(np.floor(p + 0.5).astype(int), 0, n - 1) - a for p, n, (a, _) in zip(place, size, need)]
        out = values[tuple(np.clip(p, 0, d - 1) for p, d in zip(near, values.shape))]
    else:
        place = [np.clip(p, 0, n - 1) for p, n in zip(place, size)]
        whole = [np.floor(p).astype(int) for p in place]
        out = np.zeros(cells.shape[1:])
        for corner in product((0, 1), repeat=3):
            weight = np.ones(cells.shape[1:])
            for c, p, w in zip(corner, place, whole):
                weight = weight * (p - w if c else 1 - (p - w))
            at = tuple(np.clip(np.minimum(w + c, n - 1) - a, 0, d - 1) for c, w, n, (a, _), d in zip(corner, whole, size, need, values.shape))
            out += weight * values[at]
    return key[:-1], index, tuple(low), [np.where(inside, out, fill)], tuple(target)


def resample_to(
    source: DataFrame, source_frames: DataFrame, target_frames: DataFrame, how: str = "nearest", fill: float = 0.0, shape: Three = CHUNK_SHAPE, value: str = "v"
) -> DataFrame:
    """Chunk rows of the source's values on the target's grid, for every target chunk that the source reaches.

    ``source`` are sparse voxels (absent cells are zero), or chunk rows of ``shape``; ``how`` is nearest (labels) or linear (images). A target cell
    beyond half a cell outside the source is ``fill``, and chunks that lie wholly outside are absent.
    """
    if how not in ("nearest", "linear"):
        raise ValueError("how must be linear or nearest")
    chunks = source if set(INDEX) <= set(source.columns) else ch.from_sparse(source, source_frames, shape, value)
    rows = fact_join(ch.with_sizes(chunks, source_frames), _warps(source_frames, target_frames), ["volume_id"])
    keys = ("volume_id", "warp")
    ddl, schema = ch._schema(rows, keys, [("data", "binary")])
    sent = rows.select(*keys, *INDEX, *LOW, *SHAPE, *SIZE, "data").mapInArrow(lambda parts: ch._rows(((k, i, o, [a], s) for k, i, o, a, s in _sent(ch._read(parts, 2, shape), shape)), schema), ddl)
    sent = sent.repartition(*keys, *INDEX).sortWithinPartitions(*keys, *INDEX)
    out_ddl, out_schema = ch._schema(rows, ("volume_id",), [("data", "array<double>")])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return ch._rows((_sampled(boxes, shape, how, fill) for boxes in ch._gathered(parts, 2)), out_schema)

    return sent.mapInArrow(run, out_ddl)


def canonical_crop(voxels: DataFrame, mask: DataFrame, frames_: DataFrame, size: Three, codes: str = "RAS") -> tuple[DataFrame, DataFrame]:
    """A volume turned to ``codes`` and cropped or padded to ``size`` about its mask: (voxels, their frames)."""
    from voxlake.operators.geometry import crop_or_pad_boxes

    turned = orientations(frames_, codes)
    boxes = crop_or_pad_boxes(reorient(mask, turned), turned, size)
    return crop(reorient(voxels, turned), boxes), crop_frames(turned, boxes)


def back_to(predicted: DataFrame, predicted_frames: DataFrame, first_frames: DataFrame, shape: Three = CHUNK_SHAPE) -> DataFrame:
    """Labels of a turned and cropped volume as voxel rows of the first grid (only cells that are not zero)."""
    rows = predicted.select("volume_id", *VOXEL, F.col("label").cast("double").alias("v"))
    out = ch.to_voxels(resample_to(rows, predicted_frames, first_frames, "nearest", shape=shape))
    return out.filter("v <> 0").select("volume_id", *VOXEL, F.col("v").cast("long").alias("label"))
