"""Runs, contraction, matching, wide thresholds and cuboid masks against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_components import flood, frames, snake
from voxlake.operators import components as cc
from voxlake.operators import histogram as hi
from voxlake.operators import score as sc
from voxlake.operators import splits


def arrays():
    rng = np.random.default_rng(8)
    solid = np.ones((4, 5, 600), dtype=int)
    solid[:, :, 300] = 0
    return [snake(), rng.integers(0, 3, (5, 8, 9)), (rng.random((6, 7, 8)) < 0.55).astype(int), solid, np.zeros((2, 2, 2), dtype=int)]


@pytest.mark.parametrize("connectivity, planar", [(1, False), (2, False), (3, False), (1, True), (2, True)])
def test_runs_match_flood_fill_across_bundles(spark, connectivity, planar):
    every = arrays()
    small, volumes = frames(spark, every)
    want = {(i, *p): root for i, a in enumerate(every) for p, root in flood(a, connectivity, planar).items()}
    for lines in ((2, 3), (16, 256)):
        runs = cc.object_runs(small, volumes, connectivity, planar=planar, lines=lines).collect()
        got = {(r.volume_id, r.z, r.y, x): r.object_id for r in runs for x in range(r.x0, r.x1 + 1)}
        assert got == want and len(got) == sum(r.x1 - r.x0 + 1 for r in runs)
        assert len({(r.volume_id, r.z, r.y) for r in runs if r.volume_id == 3}) * 2 == len([r for r in runs if r.volume_id == 3])


def test_overlaps_of_runs_are_those_of_voxels(spark):
    rng = np.random.default_rng(5)
    shape = (3, 4, 700)  # lines longer than a span
    gt = (rng.random(shape) < 0.98).astype(int)
    pred = (rng.random(shape) < 0.97).astype(int)
    g, volumes = frames(spark, [gt])
    p = frames(spark, [pred])[0].withColumn("model", F.lit("m"))
    want = sc.object_pairs(cc.connected_components(g, volumes, 1), cc.connected_components(p, volumes, 1, sc.PAIR))
    got = sc.run_object_pairs(cc.object_runs(g, volumes, 1), cc.object_runs(p, volumes, 1, sc.PAIR))
    rows = lambda df: {tuple(r) for r in df.select(*want.columns).collect()}
    assert rows(got) == rows(want)


@pytest.mark.parametrize("at_once", [0, 25, 10**6])
def test_contraction_of_small_and_large_groups(spark, at_once):
    rng = np.random.default_rng(2)
    edges = [(int(k), int(a), int(b)) for k, n in ((1, 200), (2, 10), (3, 60)) for a, b in rng.integers(0, 80, (n, 2))] + [(4, 1, 1)]
    want = {}
    for k in (1, 2, 3):
        low = {}
        for _ in range(80):
            for kk, a, b in edges:
                if kk == k and a != b:
                    low[a] = low[b] = min(low.get(a, a), low.get(b, b))
        want |= {(k, n): m for n, m in low.items() if n != m}
    out = cc.contract(spark.createDataFrame(edges, "k int, u long, v long"), ["k"], at_once).collect()
    assert {(r.k, r.u): r.m for r in out} == want and len(out) == len(want)


@pytest.mark.parametrize("threshold", [0.05, 0.3])
def test_matching_below_one_half_is_the_ordered_walk(spark, threshold):
    rng = np.random.default_rng(6)
    rows = {(m, v, g, int(p)): float(rng.choice([0.1, 0.2, 0.3, 0.4, 0.45])) for m in ("a", "b") for v in range(3) for g in range(40) for p in rng.integers(0, 30, 3)}
    made = [(*k, 1, 10, 10, iou) for k, iou in rows.items()]
    pairs = spark.createDataFrame(made, "model string, volume_id int, gt_id long, pred_id long, n_both long, gt_area long, pred_area long, iou double")
    got = {(r.model, r.volume_id, r.gt_id, r.pred_id) for r in sc.match_objects(pairs, threshold).collect()}
    want = set()
    for m in ("a", "b"):
        for v in range(3):
            used = set()
            for g in range(40):
                able = sorted((-iou, k[3]) for k, iou in rows.items() if k[:3] == (m, v, g) and iou >= threshold and k[3] not in used)
                if able:
                    used.add(able[0][1])
                    want.add((m, v, g, able[0][1]))
    assert got == want


def plain_otsu(values):
    at, n = np.unique(values, return_counts=True)
    w1, s1 = np.cumsum(n), np.cumsum(n * at.astype(object))
    best = None
    for v, w, s in zip(at.tolist(), w1.tolist(), s1.tolist()):
        rest = len(values) - w
        score = w * rest * (s / w - (s1[-1] - s) / rest) ** 2 if rest else -1.0
        if best is None or score > best[0] * (1 + 1e-12):
            best = score, v
    return best[1]


def test_otsu_of_wide_values(spark):
    rng = np.random.default_rng(1)
    cases = [rng.integers(0, 2**31, 500), rng.integers(-(2**31), 2**31, 500), np.r_[rng.integers(0, 90, 300), rng.integers(2**30, 2**30 + 90, 40)], np.array([7]), np.array([2**31 - 1] * 5), np.r_[np.zeros(9, int), 65_536, 65_535],
             rng.normal(2**20, 2**15, 2000).astype(int), np.arange(0, 2**18, 64)]
    rows = [(i, 0, 0, x, int(v)) for i, c in enumerate(cases) for x, v in enumerate(c)]
    table = spark.createDataFrame(rows, "volume_id int, z int, y int, x int, v long")
    got = {r.volume_id: r.threshold for r in hi.otsu_values(table).collect()}
    assert got == {i: plain_otsu(c) for i, c in enumerate(cases)}
    volumes = spark.createDataFrame([(i, 1, 1, len(c) + 300) for i, c in enumerate(cases)], "volume_id int, nz int, ny int, nx int")
    got = {r.volume_id: r.threshold for r in hi.otsu_of(table, volumes).collect()}
    assert got == {i: plain_otsu(np.r_[c, np.zeros(300, int)]) for i, c in enumerate(cases)}


def test_cuboids_reach_their_ratio_and_stop(spark):
    grids = spark.createDataFrame([(1, 8, 8, 8), (2, 1, 5, 3), (3, 12, 2, 9), (4, 1, 1, 1)], "volume_id int, nz int, ny int, nx int")
    size = {r.volume_id: r.nz * r.ny * r.nx for r in grids.collect()}
    for ratio, boxes in ((0.6, 2), (0.6, 64), (0.0, 4)):
        cells = splits.cuboid_masks(grids, ratio, 4, boxes).collect()
        assert len(cells) == len({tuple(c) for c in cells})
        hidden = {v: {tuple(c[1:]) for c in cells if c.volume_id == v} for v in size}
        if boxes == 64:
            assert hidden == before  # noqa: F821 - more boxes of the same series change nothing
        before = hidden
        for v, n in size.items():
            wanted = int(ratio * n)
            assert len(hidden[v]) >= wanted and (wanted > 0 or not hidden[v])
            assert len(hidden[v]) < max(wanted, 1) + n // 4 + 1
    with pytest.raises(ValueError):
        splits.cuboid_masks(grids, 1.5, 4)
