"""Chunks with halos, affine mapping, superpixels and fused views against plain array code."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import affine as af
from voxlake.operators import chunks as ch
from voxlake.operators import flow, superpixels
from voxlake.operators.geometry import multiview
from voxlake.operators.lines import gaussian_kernel
from voxlake.operators.tiles import clamped_tiles
from voxlake.sources.volumes import to_chunks

#: Sizes within one chunk, of one chunk, and across several; a flat one, and one of a single cell.
SIZES = {1: (5, 7, 9), 2: (3, 4, 4), 3: (7, 9, 13), 4: (1, 6, 2), 5: (1, 1, 1)}
SHAPE = (3, 4, 4)


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(4)
    return {i: np.where(rng.random(n) < 0.6, rng.integers(0, 60, n), 0).astype(float) for i, n in SIZES.items()}


@pytest.fixture(scope="module")
def volumes(spark):
    return spark.createDataFrame([(i, *n, 3.0, 1.5, 1.5) for i, n in SIZES.items()], "volume_id long, nz int, ny int, nx int, spacing_z double, spacing_y double, spacing_x double")


def table(spark, arrays, name="v", kind="double", zeros=False):
    rows = [(i, *map(int, p), a[tuple(p)].item()) for i, a in arrays.items() for p in np.argwhere((a != 0) | zeros)]
    return spark.createDataFrame([(*r[:4], int(r[4]) if kind != "double" else r[4]) for r in rows], f"volume_id long, z int, y int, x int, {name} {kind}")


def dense(df, sizes, name="v"):
    out = {i: np.full(n, np.nan) for i, n in sizes.items()}
    for r in df.collect():
        out[r.volume_id][r.z, r.y, r.x] = r[name]
    return out


def same(got, want, tolerance=1e-9):
    assert got.keys() == want.keys()
    for i in want:
        assert np.allclose(got[i], want[i], atol=tolerance, equal_nan=True), i


def blurred(a, kernel, axes, mode):
    r = len(kernel) // 2
    for axis in axes:
        pad = [(r, r) if k == axis else (0, 0) for k in range(3)]
        a = np.apply_along_axis(lambda line: np.convolve(line, kernel, "valid"), axis, np.pad(a, pad, mode))
    return a


def test_chunks_hold_every_cell(spark, arrays, volumes):
    sparse = table(spark, arrays)
    stray = spark.createDataFrame([(1, -1, 0, 0, 5.0), (1, 5, 6, 8, 5.0), (2, 0, 0, 99, 5.0), (99, 0, 0, 0, 5.0)], sparse.schema)
    same(dense(ch.to_voxels(ch.from_sparse(sparse.unionByName(stray), volumes, SHAPE)), SIZES), arrays)
    assert ch.from_sparse(sparse.filter("false"), volumes.filter("false"), SHAPE).count() == 0


@pytest.mark.parametrize("stored", [False, True])
def test_gaussian_across_chunks(spark, arrays, volumes, stored):
    source = to_chunks(table(spark, arrays, zeros=True), volumes, SHAPE) if stored else table(spark, arrays)
    got = dense(ch.to_voxels(ch.gaussian(source, volumes, 1.2, shape=SHAPE)), SIZES)
    same(got, {i: blurred(a, gaussian_kernel(1.2), (2, 1, 0), "edge") for i, a in arrays.items()})


def test_sauvola_across_chunks(spark, arrays, volumes):
    got = dense(ch.to_voxels(ch.sauvola(table(spark, arrays), volumes, 7, shape=SHAPE), ("threshold",), ("t",)), SIZES, "t")
    want = {}
    for i, a in arrays.items():
        wide = np.lib.stride_tricks.sliding_window_view(np.pad(a, ((0, 0), (3, 3), (3, 3)), "reflect"), (7, 7), axis=(1, 2))
        want[i] = wide.mean((3, 4)) * (1 + 0.2 * (wide.std((3, 4)) / 127.5 - 1))
    same(got, want, 1e-6)


@pytest.mark.parametrize("radius", [1, 2])
def test_opening_across_chunks(spark, arrays, volumes, radius):
    masks = {i: (a < 55).astype(float) for i, a in arrays.items()}
    offsets = np.argwhere(ch.ball(radius)) - radius

    def around(m, outside):
        wide = np.pad(m, radius, constant_values=outside)
        return [wide[tuple(slice(radius + o, radius + o + n) for o, n in zip(move, m.shape))] for move in offsets]

    got = {i: np.nan_to_num(a) for i, a in dense(ch.opening(table(spark, masks), volumes, radius, SHAPE).withColumn("v", F.lit(1.0)), SIZES).items()}
    same(got, {i: np.any(around(np.all(around(m > 0, True), axis=0), False), axis=0).astype(float) for i, m in masks.items()})


def test_clamped_tiles_from_chunks(spark, arrays, volumes):
    size, stride = (3, 5, 5), (2, 3, 3)
    tiles = ch.tiles(table(spark, arrays), volumes, size, ch.clamped_starts(size, stride), normalise=False, shape=SHAPE).collect()
    boxes = {(r.volume_id, r.z0, r.y0, r.x0): (r.dz, r.dy, r.dx) for r in clamped_tiles(volumes, size, stride).collect()}
    assert {(t.volume_id, t.z0, t.y0, t.x0) for t in tiles} == set(boxes) and len(tiles) == len(boxes)
    for t in tiles:
        cut = arrays[t.volume_id][tuple(slice(o, o + d) for o, d in zip((t.z0, t.y0, t.x0), boxes[t.volume_id, t.z0, t.y0, t.x0]))]
        whole = np.zeros(size)
        whole.ravel()[t.at] = t.data
        assert (whole[: cut.shape[0], : cut.shape[1], : cut.shape[2]] == cut).all() and len(t.data) == cut.size


AFFINES = {
    1: np.diag([1.5, 1.5, 3, 1]), 2: np.array([[0, -2.0, 0, 4], [1, 0, 0, 0], [0, 0, -3, 7], [0, 0, 0, 1]]), 3: np.array([[0.1, 0.2, -3, 1], [-1.4, 0.1, 0, 0], [0, 1.5, 0.2, 0], [0, 0, 0, 1]]),
    4: np.diag([-1.0, -1, -1, 1]), 5: np.eye(4),
}


def framed(spark, affines, sizes=SIZES):
    return spark.createDataFrame([(i, *sizes[i], np.asarray(a, float).ravel().tolist()) for i, a in affines.items()], "volume_id long, nz int, ny int, nx int, affine array<double>")


def test_axis_codes():
    assert [af.axis_codes(AFFINES[i]) for i in AFFINES] == ["RAS", "ALI", "PSL", "LPI", "RAS"]
    turned = np.array([[math.cos(1), -math.sin(1), 0, 0], [math.sin(1), math.cos(1), 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    assert af.axis_codes(turned) == "ALS"


def test_reorient_keeps_every_place_in_the_world(spark, arrays):
    turned = af.orientations(framed(spark, AFFINES), "LPS")
    after = {r.volume_id: r for r in turned.collect()}
    assert all(af.axis_codes(np.reshape(r.affine, (4, 4))) == "LPS" for r in after.values())
    world = lambda affine, r: tuple(np.round((np.reshape(affine, (4, 4)) @ [r.x, r.y, r.z, 1])[:3], 6) + 0.0)
    sparse = table(spark, arrays)
    moved = af.reorient(sparse, turned).collect()
    assert {(r.volume_id, world(after[r.volume_id].affine, r), r.v) for r in moved} == {(r.volume_id, world(AFFINES[r.volume_id], r), r.v) for r in sparse.collect()}
    assert all(0 <= r.z < after[r.volume_id].nz and 0 <= r.y < after[r.volume_id].ny and 0 <= r.x < after[r.volume_id].nx for r in moved)
    with pytest.raises(ValueError):
        af.orientations(framed(spark, AFFINES), "RLS")


def test_back_to_the_first_grid(spark, arrays):
    frames, sparse = framed(spark, AFFINES), table(spark, arrays)
    cropped, where = af.canonical_crop(sparse, sparse.filter("v > 40"), frames, (40, 40, 40))
    got = af.back_to(cropped.withColumnRenamed("v", "label"), where, frames, SHAPE)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in sparse.collect()}  # the crop is larger than any volume
    small, where = af.canonical_crop(sparse, sparse.filter("v > 40"), frames, (3, 4, 5))
    assert {tuple(r) for r in af.back_to(small.withColumnRenamed("v", "label"), where, frames, SHAPE).collect()} < {tuple(r) for r in sparse.collect()}


@pytest.mark.parametrize("how", ["nearest", "linear"])
def test_resampling_to_any_grid(spark, arrays, how):
    rng = np.random.default_rng(9)
    sizes = {1: (6, 6, 11), 2: (9, 2, 5), 3: (4, 12, 8), 4: (3, 3, 3), 5: (2, 2, 2)}
    target = {i: a @ np.vstack([np.c_[np.eye(3) * 0.8 + rng.normal(0, 0.25, (3, 3)), rng.normal(0, 0.6, 3)], [0, 0, 0, 1]]) for i, a in AFFINES.items()}
    got = dense(ch.to_voxels(af.resample_to(table(spark, arrays), framed(spark, AFFINES), framed(spark, target, sizes), how, -1.0, SHAPE)), sizes)
    for i, n in sizes.items():
        m, a = np.linalg.inv(AFFINES[i]) @ target[i], arrays[i]
        for cell in np.ndindex(*n):
            place = (m @ [cell[2], cell[1], cell[0], 1])[2::-1]
            want = -1.0
            if all(-0.5 <= p < s - 0.5 for p, s in zip(place, a.shape)):
                if how == "nearest":
                    want = a[tuple(min(math.floor(p + 0.5), s - 1) for p, s in zip(place, a.shape))]
                else:
                    at = [min(max(p, 0), s - 1) for p, s in zip(place, a.shape)]
                    low = [math.floor(p) for p in at]
                    want = sum(a[tuple(min(o + c, s - 1) for o, c, s in zip(low, corner, a.shape))] * math.prod(p - o if c else 1 - p + o for c, p, o in zip(corner, at, low)) for corner in np.ndindex(2, 2, 2))
            # A target chunk that lies wholly outside is absent.
            assert np.isclose(got[i][cell], want) or (np.isnan(got[i][cell]) and want == -1), (i, cell)


def test_random_affine_is_one_matrix_for_image_and_label(spark, arrays, volumes):
    frames = af.frames(volumes)
    none, every = af.random_affine(frames, 3, share=0.0).collect(), {r.volume_id: np.reshape(r.affine, (4, 4)) for r in af.random_affine(frames, 3, share=1.0).collect()}
    assert {r.volume_id: r.affine for r in none} == {r.volume_id: r.affine for r in frames.collect()}
    for r in frames.collect():
        m = np.linalg.inv(np.reshape(r.affine, (4, 4))) @ every[r.volume_id]
        middle = np.array([(r.nx - 1) / 2, (r.ny - 1) / 2, (r.nz - 1) / 2, 1])
        assert np.allclose(m @ middle, middle)
        size = np.sqrt((m[:3, :3] ** 2).sum(0))
        assert ((0.8 <= size) & (size <= 1.2)).all() and np.allclose((m[:3, :3] / size).T @ (m[:3, :3] / size), np.eye(3))


def plain_superpixels(plane, scale, sigma, min_size):
    """The rounds of the operator on one slice, with dictionaries."""
    kernel = gaussian_kernel(sigma)
    smooth = blurred(plane[None], kernel, (2, 1), "symmetric")[0]
    ny, nx = plane.shape
    edges = {}
    for y, x in np.ndindex(ny, nx):
        for dy, dx in superpixels.HALF:
            if y + dy < ny and 0 <= x + dx < nx:
                edges[y * nx + x, (y + dy) * nx + x + dx] = abs(smooth[y, x] - smooth[y + dy, x + dx])
    size, inner, root = {c: 1 for c in range(ny * nx)}, {c: 0.0 for c in range(ny * nx)}, list(range(ny * nx))

    def merge(taken):
        nonlocal edges
        up = {c: c for c in size}
        find = lambda c: c if up[c] == c else find(up[c])
        for (a, b), _ in taken:
            a, b = sorted((find(a), find(b)))
            up[b] = a
        for c in [c for c in size if find(c) != c]:
            size[find(c)] += size.pop(c)
            inner[find(c)] = max(inner[find(c)], inner.pop(c))
        for (a, _), w in taken:
            inner[find(a)] = max(inner[find(a)], w)
        root[:] = [find(c) for c in root]
        met = {}
        for (a, b), w in edges.items():
            a, b = sorted((find(a), find(b)))
            if a != b:
                met[a, b] = min(w, met.get((a, b), math.inf))
        edges = met

    def least(of):
        best = {}
        for (a, b), w in edges.items():
            for c in (a, b):
                if c in of:
                    best[c] = min(best.get(c, (math.inf,)), (w, a, b))
        return {((a, b), w) for w, a, b in best.values()}

    while taken := {((a, b), w) for (a, b), w in least(size) if all(w < inner[c] + scale / size[c] for c in (a, b))}:
        merge(taken)
    while taken := least({c for c, n in size.items() if n < min_size}):
        merge(taken)
    return np.reshape(root, plane.shape)


@pytest.mark.parametrize("scale, min_size", [(30.0, 3), (4.0, 0)])
def test_superpixels_are_those_of_the_plain_rounds(spark, arrays, volumes, scale, min_size):
    got = dense(superpixels.superpixels(table(spark, arrays), volumes, scale, 0.5, min_size, SHAPE), SIZES, "segment")
    same(got, {i: np.stack([plain_superpixels(p, scale, 0.5, min_size) for p in a]) for i, a in arrays.items()})
    assert scale > 10 or len(np.unique(got[3][0])) > 1


def balls():
    """Two balls that touch, each its own object in every slice of every view."""
    grid = np.stack(np.meshgrid(*(np.arange(n) for n in (13, 13, 22)), indexing="ij"))
    near = [((grid - np.array(c)[:, None, None, None]) ** 2).sum(0) for c in ((6, 6, 6), (6, 6, 15))]
    return np.where(np.minimum(*near) <= 25, np.where(near[0] <= near[1], 1, 2), 0)


def test_flow_splits_touching_balls_that_a_vote_joins(spark):
    both = balls()
    sizes = {1: both.shape}
    volumes = spark.createDataFrame([(1, *both.shape)], "volume_id long, nz int, ny int, nx int")
    labels = table(spark, {1: both}, "label", "int")
    views = spark.createDataFrame([(1, v) for v in ("XY", "XZ", "YZ")], "volume_id long, view string")
    from voxlake.operators.tiles import view_consensus

    seen = multiview(labels, ["XY", "XZ", "YZ"])
    assert view_consensus(seen.drop("label"), views, volumes).select("object_id").distinct().count() == 1
    got = np.nan_to_num(dense(flow.flow_fusion(seen, views, volumes), sizes, "object_id")[1], nan=-1)
    assert (both > 0).sum() == (got >= 0).sum()
    found = [np.unique(got[both == k]) for k in (1, 2)]
    assert all(len(f) == 1 for f in found) and found[0] != found[1]


def test_flow_of_nothing(spark, volumes):
    none = spark.createDataFrame([], "volume_id long, view string, a int, b int, c int, label int")
    assert flow.flow_fusion(none, none.select("volume_id", "view"), volumes).count() == 0


def test_walks_at_rest_are_not_joined_again(spark):
    """Ends of walks of all lengths, and a walk that goes in a circle; null places have distance 1 (F4 of round 3)."""
    n = 37
    line = [(1, 0, 0, x, 0, 0, max(x - 1, 0)) for x in range(n)] + [(1, 1, 0, 0, 1, 0, 1), (1, 1, 0, 1, 1, 0, 0), (1, None, 0, 5, None, 0, 5)]
    steps = spark.createDataFrame(line, "volume_id bigint, z int, y int, x int, tz int, ty int, tx int")
    ends = {(r.z, r.x): (r.tz, r.tx) for r in flow.follow(steps, n).collect()}
    assert ends == {(0, x): (0, 0) for x in range(n)} | {(1, 0): (1, 0), (1, 1): (1, 1), (None, 5): (None, 5)}
    written = []
    cut = flow.cut_lineage
    flow.cut_lineage = lambda df: written.append(cut(df)) or written[-1]
    try:
        flow.follow(steps.filter("z = 0 and x < 4"), n).collect()
    finally:
        flow.cut_lineage = cut
    assert [t.count() for t in written] == [4, 3, 2, 1]
    sizes = spark.createDataFrame([(1, 3, 5, 5)], "volume_id bigint, nz int, ny int, nx int")
    cells = [(1, 7, 0, y, x) for y in range(1, 4) for x in range(1, 4)] + [(1, 7, None, 1, 1), (1, 7, 0, 9, 1), (None, 7, 0, 1, 1)]
    got = flow.object_distance(spark.createDataFrame(cells, "volume_id bigint, label bigint, z int, y int, x int"), sizes, ("y", "x"))
    far = {(r.volume_id, r.z, r.y, r.x): r.d for r in got.collect()}
    assert far == {(c[0], *c[2:]): 2.0 if c[2:] == (0, 2, 2) and c[0] else 1.0 for c in cells}
