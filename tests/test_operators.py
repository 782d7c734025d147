"""Round trips, border rules and hand cases of the voxel, tile and catalogue operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake import extensions as ex
from voxlake.operators import geometry as ge
from voxlake.operators import histogram as hi
from voxlake.operators import lines as li
from voxlake.operators import morphology as mo
from voxlake.operators import splits as sp
from voxlake.operators import spectral as spc
from voxlake.operators import tiles as ti
from voxlake.operators import voxel as vx
from voxlake.operators.joins import box_join, densify
from voxlake.sources import catalog as ct
from voxlake.sources import sinks, volumes as vo

CELL = ["volume_id", "z", "y", "x"]


def dense_frame(spark, arrays):
    rows = [(i, *map(int, p), float(a[tuple(p)])) for i, a in enumerate(arrays) for p in np.ndindex(a.shape)]
    df = spark.createDataFrame(rows, "volume_id bigint, z int, y int, x int, v double")
    dims = spark.createDataFrame([(i, *a.shape) for i, a in enumerate(arrays)], "volume_id bigint, nz int, ny int, nx int")
    return df, dims


def array_of(df, shape, value="v", volume=0):
    out = np.zeros(shape)
    for r in df.filter(F.col("volume_id") == volume).collect():
        out[r.z, r.y, r.x] = r[value]
    return out


@pytest.fixture(scope="module")
def pair(spark):
    rng = np.random.default_rng(3)
    arrays = [rng.random((4, 7, 9)).round(3), rng.random((3, 6, 5)).round(3)]
    df, dims = dense_frame(spark, arrays)
    return arrays, df.cache(), dims.cache()


def test_chunks_and_runs_round_trip(spark, pair):
    arrays, df, dims = pair
    quarter = df.withColumn("v", F.round(F.col("v") * 4) / 4)
    for shape in ((2, 3, 4), (16, 256, 256)):
        back = vo.from_chunks(vo.to_chunks(quarter, dims, shape))
        assert back.select(*CELL, "v").exceptAll(quarter).isEmpty() and back.count() == quarter.count()
    labels = df.filter("v > 0.4").select(*CELL, F.when(F.col("v") > 0.7, 2).otherwise(1).alias("label"))
    again = vo.from_runs(vo.to_runs(labels)).select(*labels.columns)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, labels.collect()))


def test_views_invert(pair):
    _, df, _ = pair
    back = ge.undo_view(ge.multiview(df)).groupBy(*CELL).agg(F.count("*").alias("n"), F.max("v").alias("v"))
    assert back.filter("n <> 3").isEmpty() and back.drop("n").exceptAll(df).isEmpty()
    with pytest.raises(ValueError):
        ge.multiview(df, [])


def test_odd_and_even_centre_crops(spark):
    for n, t in ((5, 3), (6, 3), (5, 2), (3, 6), (4, 4)):
        a = np.arange(1.0, n + 1).reshape(1, 1, n)
        df, dims = dense_frame(spark, [a])
        out = ge.centre_crop_or_pad(df, dims, {"z": F.lit(1), "y": F.lit(1), "x": F.lit(t)})
        got = array_of(out, (1, 1, t))[0, 0]
        if n >= t:
            want = a[0, 0, (n - t) // 2 : (n - t) // 2 + t]
        else:
            want = np.zeros(t)
            want[(t - n) // 2 : (t - n) // 2 + n] = a[0, 0]
        assert got.tolist() == want.tolist()


def test_flat_volume(spark):
    df, dims = dense_frame(spark, [np.full((2, 3, 3), 7.0)])
    assert {r.v for r in vx.to_uint8(df).collect()} == {0}
    assert {r.v for r in vx.normalize(df, -1.0, 1.0, "as_computed").collect()} == {13.0}
    assert hi.otsu(hi.histogram(df, "int")).first().threshold == 7.0
    assert hi.triangle(hi.histogram(df, "float")).first().threshold == 7.0
    with pytest.raises(Exception, match="uint8"):
        vx.require_uint8(df.withColumn("v", F.col("v") * 100)).collect()


def test_sparse_histogram_counts_zeros(pair):
    _, df, dims = pair
    whole = df.withColumn("v", F.floor(F.col("v") * 5).cast("double"))
    for keys in (["volume_id"], ["volume_id", "z"]):
        for kind in ("int", "float"):
            a = hi.histogram(whole, kind, keys)
            b = hi.histogram(whole.filter("v <> 0"), kind, keys, dims)
            assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_sauvola_window_larger_than_slice(pair):
    arrays, df, dims = pair
    got = hi.box_moments(df, dims, 25)
    for i, a in enumerate(arrays):
        mean, std = array_of(got, a.shape, "mean", i), array_of(got, a.shape, "std", i)
        for z in range(a.shape[0]):
            wide = np.pad(a[z], 12, mode="reflect")
            for y in range(a.shape[1]):
                for x in range(a.shape[2]):
                    w = wide[y : y + 25, x : x + 25]
                    assert mean[z, y, x] == pytest.approx(w.mean()) and std[z, y, x] == pytest.approx(w.std(), abs=1e-9)


def test_transform_round_trip_and_numpy(pair):
    arrays, df, dims = pair
    spectrum = spc.fourier(df, dims, spc.SPACE).cache()
    for i, a in enumerate(arrays):
        got = array_of(spectrum, a.shape, "re", i) + 1j * array_of(spectrum, a.shape, "im", i)
        assert np.allclose(got, np.fft.fftn(a))
    back = spc.inverse(spectrum, spc.SPACE)
    assert np.allclose(array_of(back, arrays[0].shape, "re"), arrays[0])


def test_knee_of_known_curve(spark):
    x = np.arange(10)
    y = 1.0 / (x + 1)
    df = spark.createDataFrame([(0, 0, int(a), float(b)) for a, b in zip(x, y)], "volume_id bigint, z int, radius int, power double")
    assert spc.knee(df).first().knee == 2


def test_gaussian_keeps_a_constant(spark):
    df, dims = dense_frame(spark, [np.full((3, 4, 5), 2.5)])
    assert np.allclose(array_of(li.gaussian(df, dims, 1.5), (3, 4, 5)), 2.5)


def test_distance_opening_and_holes(spark):
    rng = np.random.default_rng(5)
    a = (rng.random((5, 8, 9)) < 0.8).astype(float)
    df, dims = dense_frame(spark, [a])
    mask = df.filter("v > 0").select(*CELL)
    got = {(r.z, r.y, r.x): r.d2 for r in mo.distance_to_background(mask, dims, planar=False).collect()}
    zeros = np.argwhere(a == 0)
    for p in map(tuple, np.argwhere(a > 0)):
        assert got[tuple(map(int, p))] == ((zeros - np.array(p)) ** 2).sum(axis=1).min()
    ball = [d for d in np.ndindex(5, 5, 5) if sum((c - 2) ** 2 for c in d) <= mo.ball_limit(1)]
    ball = [tuple(c - 2 for c in d) for d in ball]
    inside = lambda q: all(0 <= c < n for c, n in zip(q, a.shape))
    add = lambda p, d: tuple(int(i) + j for i, j in zip(p, d))
    eroded = {tuple(map(int, p)) for p in np.argwhere(a > 0) if all(not inside(add(p, d)) or a[add(p, d)] > 0 for d in ball)}
    opened = {add(p, d) for p in eroded for d in ball if inside(add(p, d))}
    assert {(r.z, r.y, r.x) for r in mo.opening(mask, dims, 1).collect()} == opened
    shell = np.ones((5, 5, 5))
    shell[2, 2, 2] = shell[0, 0, 0] = 0
    df, dims = dense_frame(spark, [shell])
    assert [(r.z, r.y, r.x) for r in mo.holes(df.filter("v > 0").select(*CELL), dims).collect()] == [(2, 2, 2)]


def test_stitching_a_constant(spark):
    df, dims = dense_frame(spark, [np.full((5, 6, 7), 3.25)])
    for tiles in (ti.ragged_tiles(dims, (4, 4, 4), (2, 3, 3)), ti.clamped_tiles(dims, (9, 4, 4), (2, 3, 3)), ti.slab_tiles(dims, 2)):
        rows = box_join(tiles, df, cell=(2, 3, 2))
        local = rows.select(*CELL, "v", *[(F.col(a) - F.col(f"{a}0")).alias(f"p{a}") for a in "zyx"])
        for weight in (None, ti.gaussian_weight((4, 4, 4))):
            out = ti.stitch(local, weight)
            assert out.count() == 5 * 6 * 7 and out.filter("abs(v - 3.25) > 1e-9").isEmpty()


def test_densify_and_grid(spark, pair):
    arrays, df, dims = pair
    full = densify(df.filter("v > 0.5"), dims, {"v": -1.0})
    assert full.count() == sum(a.size for a in arrays)
    assert full.filter("v = -1").count() == sum(int((a <= 0.5).sum()) for a in arrays)


def test_poisson_moments(spark):
    df, _ = dense_frame(spark, [np.full((10, 20, 20), 6.0)])
    m = vx.poisson_noise(df, 1).agg(F.avg("v"), F.var_pop("v"), F.count("*")).first()
    assert m[0] == pytest.approx(6, abs=0.2) and m[1] == pytest.approx(6, abs=0.5) and m[2] == 4000


def test_split_contract(spark):
    files = spark.createDataFrame([(f"d/{i}{s}.tif",) for i in range(10) for s in ("", "_seg")], "path string")
    out = sp.group_split(files, 0.75, 1)
    sides = out.groupBy("base").agg(F.countDistinct("split").alias("n"))
    assert sides.filter("n <> 1").isEmpty() and out.filter("split = 'train'").count() == 14
    with pytest.raises(ValueError):
        sp.group_split(files, 1.0)


def test_folder_scan_and_sinks(spark, tmp_path):
    for name in ("a.tif", "a_seg.tif", ".b.tif", "c.png", "d.nii.gz"):
        (tmp_path / name).write_bytes(b"x" * len(name))
    files = ct.scan_folder(spark, str(tmp_path))
    assert {(r.name, r.length) for r in files.select("name", "length").collect()} == {("a.tif", 5), ("a_seg.tif", 9), ("d.nii.gz", 8)}
    assert ct.pair_images(files.select("path"))[0].count() == 1
    scores = spark.createDataFrame([("m", 2, 0.5), ("m", 1, 0.25), ("n", 1, 1.0)], "model string, volume_id bigint, s double")
    table = sinks.score_table(scores, "s", ["m", "n"])
    path = sinks.write_scores(table, str(tmp_path / "out"), "Average Dice")
    assert path.endswith("average_dice.csv")
    assert spark.read.csv(path, header=True, inferSchema=True).orderBy("sample_index").collect()[0].asDict() == {"sample_index": 0, "m": 0.25, "n": 1.0}


def test_registries(spark, pair):
    _, df, dims = pair
    whole = df.withColumn("v", F.floor(F.col("v") * 200).cast("double"))
    for name in ("otsu", "sauvola", "canny", "organoid", "single cell", "nuclear"):
        values = {"max_freq": 4.0} if name == "nuclear" else {}
        mask = ex.SEGMENTERS.run(name, whole, dims, **values)
        assert {"volume_id", "z", "y", "x", "label"} <= set(mask.columns)
        assert mask.join(df, CELL, "left_anti").isEmpty()
    with pytest.raises(ValueError):
        ex.SEGMENTERS.register("otsu")(lambda: None)
    with pytest.raises(ValueError):
        ex.SEGMENTERS.run("otsu", whole, dims, remove_small_objects=-1)
    with pytest.raises(KeyError):
        ex.METRICS.run("none")
    gt = whole.filter("v > 150").select(*CELL, F.lit(1).alias("label"))
    pred = whole.filter("v > 140").select(F.lit("m").alias("model"), *CELL, F.lit(1).alias("label"))
    pairs = dims.select(F.lit("m").alias("model"), "volume_id")
    out = ex.benchmark(["Average Dice", "Mean Object F1", "Panoptic F1", "Boundary F1"], gt, pred, pairs, dims).collect()
    by = {(r.metric, r.volume_id): r.value for r in out}
    assert len(by) == 8 and all(by["Mean Object F1", v] == by["Panoptic F1", v] for v in (0, 1))
