"""The organoid mask by whole slices gives the rows of the way by lines, over as many partitions as asked for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import histogram as hi
from voxlake.operators import morphology as mo

CELL = ["volume_id", "z", "y", "x"]


def images(spark):
    rng = np.random.default_rng(5)
    dims, cells = [], []
    for vid, (nz, ny, nx) in enumerate([(3, 12, 12), (2, 9, 17), (1, 1, 6), (2, 140, 20), (1, 4, 4)]):
        dims.append((vid, nz, ny, nx, 1.0, 1.0, 1.0))
        for z, y, x in np.argwhere(rng.random((nz, ny, nx)) < 0.6).tolist():
            near = (y // 5 + x // 4 + z) % 3
            cells.append((vid, z, y, x, float(rng.integers(1, 30) + 20 * near)))
    # A slice that is one bright object throughout, and one without any voxel.
    dims.append((9, 2, 6, 8, 1.0, 1.0, 1.0))
    cells += [(9, 0, y, x, 50.0) for y in range(6) for x in range(8)]
    names = "volume_id bigint, nz int, ny int, nx int, spacing_z double, spacing_y double, spacing_x double"
    return spark.createDataFrame(cells, "volume_id bigint, z int, y int, x int, v double"), spark.createDataFrame(dims, names)


def rows(df):
    return sorted(tuple(r) for r in df.select(*CELL, "label").collect())


@pytest.mark.parametrize("minimum,sigma,kind", [(None, None, "int"), (None, 1.0, "int"), (2.0, 1.5, "float"), (0.0, None, "int")])
def test_whole_slices_give_the_same_mask(spark, minimum, sigma, kind):
    sparse, volumes = images(spark)
    by_lines = mo.organoid_mask(sparse, volumes, minimum, sigma, kind)
    by_slices = mo.organoid_mask(sparse, volumes, minimum, sigma, kind, parts=5)
    assert by_slices.schema == by_lines.schema or by_slices.dtypes == by_lines.dtypes
    assert rows(by_slices) == rows(by_lines) and by_slices.rdd.getNumPartitions() == 5


def test_large_slices_take_the_way_by_lines(spark, monkeypatch):
    sparse, volumes = images(spark)
    want = rows(mo.organoid_mask(sparse, volumes, None, 1.0, "int", parts=3))
    monkeypatch.setattr(mo, "SLICE_CELLS", 100)
    monkeypatch.setattr(mo, "_blurred_masks", None)
    assert rows(mo.organoid_mask(sparse, volumes, None, 1.0, "int", parts=3)) == want


def test_histogram_dealt_by_whole_keys(spark):
    sparse, volumes = images(spark)
    sparse = sparse.withColumn("v", F.col("v") - 10)  # below zero, and stored zeros
    for dims in (None, volumes):
        plain = hi.histogram(sparse, "int", ["volume_id", "z"], dims)
        dealt = hi.histogram(sparse, "int", ["volume_id", "z"], dims, parts=4)
        assert dealt.columns == plain.columns and sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect()))


def test_triangle_of_an_array(spark):
    rng = np.random.default_rng(3)
    slices = [rng.random((8, 9)) ** k for k in (0.3, 1, 3, 6)] + [np.zeros((3, 3)), np.arange(12.0).reshape(3, 4), -rng.random((7, 7)) ** 4]
    made = [(i, 0, y, x, float(a[y, x])) for i, a in enumerate(slices) for y in range(a.shape[0]) for x in range(a.shape[1])]
    df = spark.createDataFrame(made, "volume_id bigint, z int, y int, x int, v double")
    found = {r.volume_id: r.threshold for r in hi.triangle(hi.histogram(df, "float", ["volume_id", "z"]), ["volume_id", "z"]).collect()}
    assert found == {i: hi.triangle_of(a) for i, a in enumerate(slices)}
