"""Volumes and slices that fit a task give the rows of the ways by chunks, lines and joins."""

import numpy as np
from pyspark.sql import functions as F

from voxlake.operators import flow
from voxlake.operators import geometry as ge
from voxlake.operators import histogram as hi
from voxlake.operators import spectral as sp
from voxlake.operators import superpixels as su
from voxlake.operators import voxel as vx
from voxlake.operators import whole as wh
from voxlake.operators.geometry import multiview
from voxlake.operators.joins import densify

DIMS = "volume_id bigint, nz int, ny int, nx int"
SIZES = [(1, 4, 6, 7), (2, 1, 1, 1), (3, 3, 9, 5), (4, 1, 12, 2), (5, 2, 0, 3), (7, 5, 5, 5)]


def rows(df):
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    return sorted((tuple(r) for r in df.collect()), key=key)


def cells(sizes, share, seed, values):
    """Cells with a value each; some come twice, some lie outside, and some have a null key or place."""
    rng = np.random.default_rng(seed)
    out = [(i, z, y, x, int(rng.integers(1, values))) for i, *n in sizes for z, y, x in np.argwhere(rng.random(n) < share).tolist()]
    return out


def test_flow_of_whole_volumes(spark, monkeypatch):
    rng = np.random.default_rng(2)
    made = []
    for view, seed in (("XY", 1), ("XZ", 2), ("YZ", 3)):
        at = {"XY": (0, 1, 2), "XZ": (1, 0, 2), "YZ": (2, 0, 1)}[view]
        own = cells([*SIZES, (9, 3, 3, 3)], 0.85, seed, 3)
        own += [own[i] for i in rng.integers(0, len(own), 20)] + [(*own[i][:4], 7) for i in rng.integers(0, len(own), 30)]
        own += [(1, 1, 2, 2, None), (1, 1, 2, 3, None), (1, None, 2, 3, 1), (1, 0, None, None, 2), (None, 1, 1, 1, 1), (None, 1, 1, 2, 1), (3, 1, 9, 4, 1), (3, 1, 10, 4, 1)]
        made += [(c[0], view, *(c[1:4][i] for i in at), c[4]) for c in own]
    made += [(1, None, 1, 1, 1, 1), (1, "other", 2, 2, 2, 1), (1, "third", 2, 2, 2, 1)]
    seen = spark.createDataFrame(made, "volume_id bigint, view string, a int, b int, c int, label int")
    views = spark.createDataFrame([(i, v) for i in (1, 2, 3, 4, 5, 7, 9, None) for v in ("XY", "XZ", "YZ", "XY")[: 2 if i == 4 else 4]], "volume_id bigint, view string")
    volumes = spark.createDataFrame([*SIZES, (None, 2, 2, 3), (8, 2, 2, 2)], DIMS)
    want = rows(flow._joined_fusion(seen, views, volumes, 21))
    got = flow.flow_fusion(seen, views, volumes)
    assert got.columns == ["volume_id", "z", "y", "x", "object_id"] and rows(got) == want
    assert len({r[4] for r in want if r[0] == 3}) > 1 and any(r[0] is None for r in want) and any(r[1] is None for r in want)
    # An id that comes twice fits none; the one that is null took the way by joins.
    assert wh.told_apart(volumes.union(volumes))[0] is None
    monkeypatch.setattr(flow, "_joined_fusion", None)
    held = volumes.filter("volume_id is not null")
    assert rows(flow.flow_fusion(seen, views, held)) == [r for r in want if r[0] is not None]


def test_flow_of_thick_objects(spark):
    """Distances beyond the nearest cells, and walks of many steps."""
    grid = np.indices((9, 20, 30))
    near = [sum(((g - c) / s) ** 2 for g, c, s in zip(grid, at, (5, 9, 12))) for at in ((4, 9, 8), (4, 10, 20))]
    both = np.where(np.minimum(*near) <= 1, np.where(near[0] <= near[1], 1, 2), 0)
    labels = spark.createDataFrame([(1, *map(int, p), int(both[tuple(p)])) for p in np.argwhere(both)], "volume_id bigint, z int, y int, x int, label int")
    seen = multiview(labels, ["XY", "XZ", "YZ"])
    views = spark.createDataFrame([(1, v) for v in ("XY", "XZ", "YZ")], "volume_id bigint, view string")
    volumes = spark.createDataFrame([(1, *both.shape)], DIMS)
    assert rows(flow.flow_fusion(seen, views, volumes)) == rows(flow._joined_fusion(seen, views, volumes, 59))


def test_superpixels_of_whole_slices(spark, monkeypatch):
    scale, min_size = 20.0, 3
    made = [(i, z, y, x, float(v) if v % 31 else None) for i, z, y, x, v in cells([*SIZES, (9, 2, 2, 2)], 0.7, 5, 60)]
    made += [(3, 1, y, x, 90.0) for y, x in ((9, 1), (2, 5), (-1, 2))]
    voxels, volumes = spark.createDataFrame(made, "volume_id bigint, z int, y int, x int, v double"), spark.createDataFrame(SIZES, DIMS)
    want = su._round_superpixels(voxels, volumes, scale, 0.5, min_size, (3, 4, 4))
    segments = rows(want)
    assert rows(su.superpixels(voxels, volumes, scale, 0.5, min_size)) == segments and len({r[4] for r in segments}) > 5
    monkeypatch.setattr(su, "_round_superpixels", lambda *a: want.join(a[1].select("volume_id"), "volume_id", "left_semi"))
    monkeypatch.setattr(wh, "WHOLE_CELLS", 42)
    assert rows(su.superpixels(voxels, volumes, scale, 0.5, min_size)) == segments
    assert rows(su.as_labels(su.superpixels(voxels, volumes, scale, 0.5, min_size, more_than=5))) == rows(su.large_segments(want, 5))
    # Rows that are nowhere, and a volume without an id.
    odd = [(1, None, 1, 1, 9.0), (1, 1, None, 1, 9.0), (None, 0, 1, 1, 50.0), (None, 0, 1, 2, 50.0)]
    more = voxels.union(spark.createDataFrame(odd, voxels.schema))
    monkeypatch.setattr(su, "_round_superpixels", None)
    monkeypatch.setattr(wh, "WHOLE_CELLS", 1000)
    found = rows(su.superpixels(more, volumes.union(spark.createDataFrame([(None, 1, 3, 3)], DIMS)), scale, 0.5, min_size))
    assert [r for r in found if r[0] is not None] == segments and len(found) == len(segments) + 9


def odd_voxels(spark, seed):
    """Voxels of ``SIZES`` and of a volume that isn't listed; some twice, without a value or a place, outside, and not finite."""
    made = [(i, z, y, x, float(v) - 3 if v % 13 else None) for i, z, y, x, v in cells([s for s in SIZES if s[0] != 7] + [(9, 2, 2, 2)], 0.6, seed, 40)]
    made += made[::9] + [(3, 1, 9, 4, 5.0), (3, 1, -1, 4, 5.0), (None, 0, 1, 1, 50.0), (1, None, 1, 1, 9.0), (1, 1, 1, None, 9.0)]
    volumes = spark.createDataFrame([*SIZES, (None, 1, 2, 3)], DIMS)
    return spark.createDataFrame(made, "volume_id bigint, z int, y int, x int, v double"), volumes


def test_percentile_windows_of_whole_volumes(spark, monkeypatch):
    voxels, volumes = odd_voxels(spark, 6)
    inf = float("inf")
    more = [(1, 0, 0, 0, v) for v in (float("nan"), inf, -inf)] + [(2, 0, 0, 0, inf)]
    voxels = voxels.union(spark.createDataFrame(more, voxels.schema))
    want = rows(vx.percentile_window(densify(voxels, volumes, {"v": 0.0}), 0.05, 0.93))
    assert rows(vx.percentile_window(voxels, 0.05, 0.93, volumes=volumes)) == want and len({r[4] for r in want}) > 10
    monkeypatch.setattr(wh, "WHOLE_CELLS", 130)
    assert rows(vx.percentile_window(voxels, 0.05, 0.93, volumes=volumes)) == want
    monkeypatch.setattr(wh, "BLOCK_CELLS", 10)
    monkeypatch.setattr(wh, "WHOLE_CELLS", 1000)
    monkeypatch.setattr(vx, "densify", None)
    assert rows(vx.percentile_window(voxels, 0.05, 0.93, volumes=volumes)) == want


def test_zoom_of_whole_volumes(spark, monkeypatch):
    voxels, volumes = odd_voxels(spark, 7)
    mask = voxels.filter("v > 15 or v is null").select("volume_id", "z", "y", "x", F.col("v").cast("int").alias("label"))
    for scale in ((0.9, 1.1), (0.5, 2.0)):
        image, labels = ge.zoom_pair(densify(voxels, volumes, {"v": 0.0}), mask, volumes, 6, scale)
        want = rows(image.join(labels, ["volume_id", "z", "y", "x"], "left"))
        close = lambda found: len(found) == len(want) and all(a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-9 and a[5] == b[5] for a, b in zip(found, want))  # noqa: B023, E731
        limits = (1000, 130) if scale[0] < 0.9 else (1000,)
        for limit in limits:
            monkeypatch.setattr(wh, "WHOLE_CELLS", limit)
            assert close(rows(ge.zoom_pair(voxels, mask, volumes, 6, scale, together=True)))
        assert {r[5] for r in want} > {None, 20}


def test_phase_foreground_of_whole_volumes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    sizes = [(1, 4, 6, 7), (2, 1, 1, 1), (3, 3, 9, 5), (4, 1, 12, 2), (5, 2, 0, 3), (6, 4, 6, 7), (7, 5, 5, 5), (8, 2, 3, 3)]
    made = [(i, z, y, x, float(rng.integers(1, 50))) for i, *n in sizes[:-2] for z, y, x in np.argwhere(rng.random(n) < 0.6).tolist()]
    made += [(8, 0, 1, 1, None), (8, 1, 1, 1, 3.0), (9, 0, 0, 0, 5.0), (3, 1, 9, 4, 5.0), (None, 0, 0, 1, 4.0)]
    voxels = spark.createDataFrame(made, "volume_id bigint, z int, y int, x int, v double")
    volumes = spark.createDataFrame([*sizes, (None, 1, 2, 3)], DIMS)

    def field():
        return sp.phase_congruency(voxels, volumes, [1.0, 2.0, 3.5], 0.5).withColumn("v", F.round("v", 9))

    def front():
        more = spark.createDataFrame([(1, None, 0, 0, 0.5), (1, 0, 9, 0, 0.5), (1, 0, 0, 0, None), (3, 1, 1, 1, 1.0)], voxels.schema)
        return sp.field_foreground(shown.union(more), voxels, volumes, 30.0, True)

    shown = field()
    got = rows(shown)
    shown = spark.createDataFrame(got, voxels.schema)
    cut = rows(front())
    whole = spark.createDataFrame(cut, front().schema)
    for limit in (0, 150):
        monkeypatch.setattr(wh, "WHOLE_CELLS", limit)
        assert not limit or rows(field()) == got
        assert rows(front()) == rows(whole)
    assert len(cut) > 50 and {r[0] for r in cut} >= {1, 3, 4, 6} and len({r[4] for r in got}) > 1


def test_otsu_of_arrays(spark):
    rng = np.random.default_rng(3)
    slices = np.stack([*(rng.random((9, 8)) ** k for k in (0.3, 1, 6)), np.zeros((9, 8)), np.arange(72.0).reshape(9, 8) // 30]).reshape(5, -1)
    made = [(i, 0, 0, x, float(v)) for i, a in enumerate(slices) for x, v in enumerate(a)]
    df = spark.createDataFrame(made, "volume_id bigint, z int, y int, x int, v double")
    found = {r.volume_id: r.threshold for r in hi.otsu(hi.histogram(df, "float")).collect()}
    assert [found[i] for i in range(5)] == hi.otsu_of_rows(slices).tolist() == hi.otsu_of_rows(np.tile(slices, (1000, 1)))[-5:].tolist()
