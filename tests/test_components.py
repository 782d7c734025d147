"""Components against a plain flood fill, in one chunk and across chunk faces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import components as cc
from voxlake.operators.joins import offsets


def flood(mask, connectivity, planar=False):
    """object id (smallest raster index) of every labelled cell of a small array."""
    out = {}
    nz, ny, nx = mask.shape
    moves = [m for m in offsets(connectivity) if not planar or m[0] == 0]
    for start in map(tuple, np.argwhere(mask)):
        if start in out:
            continue
        root = (start[0] * ny + start[1]) * nx + start[2]
        out[start] = root
        todo = [start]
        while todo:
            p = todo.pop()
            for m in moves:
                q = tuple(int(a) + b for a, b in zip(p, m))
                if all(0 <= c < n for c, n in zip(q, mask.shape)) and q not in out and mask[q] == mask[start]:
                    out[q] = root
                    todo.append(q)
    return {tuple(int(c) for c in k): int(v) for k, v in out.items()}


def frames(spark, arrays):
    rows = [(i, *map(int, p), int(a[tuple(p)])) for i, a in enumerate(arrays) for p in np.argwhere(a)]
    labels = spark.createDataFrame(rows, "volume_id bigint, z int, y int, x int, label int")
    dims = [(i, *a.shape) for i, a in enumerate(arrays)]
    return labels, spark.createDataFrame(dims, "volume_id bigint, nz int, ny int, nx int")


def snake():
    """One winding object that crosses many chunk faces, plus dense noise of two labels."""
    a = np.zeros((3, 9, 11), dtype=int)
    for y in range(0, 9, 2):
        a[1, y, :] = 1
        if y + 1 < 9:
            a[1, y + 1, 0 if y % 4 else 10] = 1
    return a


@pytest.mark.parametrize("connectivity,planar", [(1, False), (2, False), (3, False), (2, True)])
def test_matches_flood_fill_across_chunks(spark, connectivity, planar):
    rng = np.random.default_rng(connectivity)
    arrays = [snake(), rng.integers(0, 3, (5, 8, 9)), (rng.random((6, 7, 8)) < 0.55).astype(int), np.ones((4, 5, 6), dtype=int)]
    labels, volumes = frames(spark, arrays)
    for chunk in ((2, 3, 4), (16, 128, 128)):
        comp = cc.connected_components(labels, volumes, connectivity, planar=planar, chunk=chunk)
        got = {(r.volume_id, r.z, r.y, r.x): r.object_id for r in comp.collect()}
        want = {(i, *p): root for i, a in enumerate(arrays) for p, root in flood(a, connectivity, planar).items()}
        assert got == want


def test_contract_long_chain(spark):
    edges = spark.range(60).select(F.lit(0).alias("k"), (F.col("id") + 1).alias("u"), F.col("id").alias("v"))
    got = {r.u: r.m for r in cc.contract(edges, ["k"]).collect()}
    assert got == {i: 0 for i in range(1, 61)}


def test_numbers_follow_raster_order(spark):
    a = np.zeros((2, 4, 4), dtype=int)
    a[1, 3, 3] = a[0, 0, 2] = a[0, 3, 0] = 1
    labels, volumes = frames(spark, [a])
    objects = cc.object_table(cc.connected_components(labels, volumes, 1))
    got = {r.object_id: r.number for r in cc.object_numbers(objects, volumes).collect()}
    assert got == {2: 1, 12: 2, 31: 3}


def test_remove_small_limit_is_inclusive(spark):
    a = np.zeros((1, 1, 6), dtype=int)
    a[0, 0, :2] = 1
    a[0, 0, 3:6] = 1
    labels, volumes = frames(spark, [a])
    kept = {r.x for r in cc.remove_small(labels, volumes, 2).collect()}
    assert kept == {3, 4, 5}
    with pytest.raises(ValueError):
        cc.remove_small(labels, volumes, 2, by="size")
