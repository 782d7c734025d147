"""Work whose tasks, batches and shuffles must not grow faster than the tables."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import chunks as ch
from voxlake.operators import geometry as ge
from voxlake.operators import histogram as hi
from voxlake.operators import morphology as mo
from voxlake.operators import pencils as pc
from voxlake.operators import score as sc
from voxlake.operators import tiles as ti
from voxlake.operators.joins import CELL, box_join, densify, fact_join, voxel_grid
from voxlake.session import TASK_ROWS, parts_for

SIZE = (2, 9, 11)


def _volumes(spark, ids=(1, 2), size=SIZE):
    return spark.createDataFrame([(i, *size) for i in ids], "volume_id long, nz int, ny int, nx int")


def _voxels(spark, seed=0, ids=(1, 2), size=SIZE, share=0.7):
    rng = np.random.default_rng(seed)
    rows = [(i, z, y, x, float(rng.integers(1, 50))) for i in ids for z, y, x in product(*map(range, size)) if rng.random() < share]
    return spark.createDataFrame(rows, "volume_id long, z int, y int, x int, v double")


def _plan(df, capsys):
    capsys.readouterr()
    df.explain("extended")
    return capsys.readouterr().out


def _same(a, b):
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.select(*a.columns).collect()), key=key)


def test_a_task_takes_no_more_of_a_larger_table(spark):
    assert parts_for(spark, 0) == 1 and parts_for(spark, 100) == 1
    for rows in (10**7, 10**9):
        assert rows / parts_for(spark, rows) <= TASK_ROWS


def test_fact_join_dealt_over_parts(spark):
    big = spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(60)], "k int, v int")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (None, "n"), (9, "z")], "k int, f string")
    for how in ("inner", "left"):
        _same(fact_join(big, small, ["k"], how), fact_join(big, small, ["k"], how, parts=5))


def test_tiles_are_stitched_where_they_were_joined(spark, capsys):
    volumes, voxels = _volumes(spark), _voxels(spark)
    rows = box_join(ti.clamped_tiles(volumes, (2, 5, 5), (1, 4, 4)), voxels, parts=3, listed=True)
    assert _plan(ti.stitch(rows, by=CELL), capsys).split("Physical Plan")[1].count("Exchange") == _plan(rows, capsys).split("Physical Plan")[1].count("Exchange")
    _same(ti.stitch(rows, by=CELL), ti.stitch(rows.drop(*CELL)))


def test_boundary_dealt_over_parts(spark):
    volumes, mask = _volumes(spark), _voxels(spark, 3).drop("v")
    _same(sc.inner_boundary(mask, volumes), sc.inner_boundary(mask, volumes, parts=3))


def test_batches_of_bundles_are_bounded(spark):
    schema = ch._arrow("volume_id long, " + ", ".join(f"{c} int" for c in (*ch.INDEX, *ch.LOW, *ch.SHAPE, *ch.SIZE)) + ", data binary")
    boxes = (((i,), (0, 0, 0), (0, 0, 0), np.zeros((1, 8, 32, 32), complex), (8, 32, 32)) for i in range(100))
    assert max(batch.nbytes for batch in pc._packed(boxes, schema)) < 1.2 * ch.FLUSH


@pytest.mark.parametrize("shape", [(1, 4, 5), (16, 256, 256)])
def test_edges_of_chunks_are_those_of_the_slices(spark, shape):
    volumes, voxels = _volumes(spark), _voxels(spark, 1)
    dense = densify(voxels, volumes, {"v": 0.0})
    thin = mo.thin_edges(mo.sobel(mo.smooth_inside(dense, volumes, 1.0)), volumes, 5.0)
    got = mo.canny(voxels, volumes, 1.0, 5.0, 12.0, 2, shape)
    assert got.count() > 20
    _same(mo.hysteresis(thin, volumes, 12.0), got)


@pytest.mark.parametrize("shape", [(2, 4, 5), (16, 256, 256)])
def test_displaced_points_read_their_chunk(spark, shape):
    volumes, voxels = _volumes(spark), _voxels(spark, 2)
    image = {i: np.zeros(SIZE) for i in (1, 2)}
    for r in voxels.collect():
        image[r.volume_id][r.z, r.y, r.x] = r.v
    points = voxel_grid(volumes, keep=("nz", "ny", "nx")).select("*", *((F.col(a) * 3.7 - 11.3 + F.col("volume_id")).alias(f"s{a}") for a in "zyx"))

    def mirrored(k, n):
        k %= 2 * n
        return 2 * n - 1 - k if k >= n else k

    got = {(r.volume_id, r.z, r.y, r.x): r.v for r in ge.displace_image(voxels, volumes, points, shape, 3).collect()}
    assert len(got) == 2 * np.prod(SIZE)
    for r in points.collect():
        want = 0.0
        for corner in product((0, 1), repeat=3):
            s = (r.sz, r.sy, r.sx)
            base = [int(np.floor(p)) for p in s]
            weight = np.prod([p - b if c else 1 - (p - b) for c, p, b in zip(corner, s, base)])
            want += weight * image[r.volume_id][tuple(mirrored(b + c, n) for c, b, n in zip(corner, base, SIZE))]
        assert got[r.volume_id, r.z, r.y, r.x] == pytest.approx(want, abs=1e-9)


def test_draws_are_made_once(spark, capsys):
    mask = _voxels(spark).select("volume_id", "z", "y", "x", F.lit(1).alias("label"))
    plan = _plan(ge.displace_mask(mask, ge.displaced(_volumes(spark), 8)), capsys).split("Physical Plan")[0].split("Optimized")[1]
    assert not [line for line in plan.splitlines() if "Filter" in line and "md5" in line]


def test_matching_makes_no_product(spark, capsys):
    voxels = _voxels(spark)
    assert "CartesianProduct" not in _plan(hi.match_histogram(voxels, voxels, 3), capsys)
