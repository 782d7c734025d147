"""Scores on hand cases with known answers, and the matching against a plain ordered walk."""

import random

import pytest

from voxlake.operators import score as sc

MASK = "volume_id bigint, z int, y int, x int, label int"
PRED = "model string, volume_id bigint, z int, y int, x int, label int"


def test_dice_policies(spark):
    gt = spark.createDataFrame([(1, 0, 0, 0, 1), (1, 0, 0, 1, 1), (2, 0, 0, 0, 1)], MASK)
    pred = spark.createDataFrame([("m", 1, 0, 0, 1, 1), ("m", 3, 0, 0, 0, 1)], PRED)
    pairs = spark.createDataFrame([("m", v) for v in (1, 2, 3, 4)], "model string, volume_id bigint")
    got = {r.volume_id: r.dice for r in sc.dice(sc.overlap_counts(gt, pred, pairs)).collect()}
    assert got == {1: pytest.approx(2 / 3), 2: 0.0, 3: 0.0, 4: 1.0}


def test_boundary_ignores_volume_edge(spark):
    full = spark.createDataFrame([(1, z, y, x, 1) for z in range(2) for y in range(2) for x in range(2)], MASK)
    volumes = spark.createDataFrame([(1, 2, 2, 2)], "volume_id bigint, nz int, ny int, nx int")
    assert sc.inner_boundary(full, volumes).count() == 0
    larger = spark.createDataFrame([(1, 2, 2, 3)], "volume_id bigint, nz int, ny int, nx int")
    assert {r.x for r in sc.inner_boundary(full, larger).collect()} == {1}


def walk(pairs, threshold):
    """Objects in id order take their best unused prediction."""
    used, out = set(), set()
    for g in sorted({p[0] for p in pairs}):
        best = None
        for gt, pred, n, a, b in pairs:
            iou = n / (a + b - n)
            if gt == g and pred not in used and iou >= threshold and (best is None or (-iou, pred) < best):
                best = (-iou, pred)
        if best:
            used.add(best[1])
            out.add((g, best[1]))
    return out


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.5])
def test_matching_equals_ordered_walk(spark, threshold):
    """Random masks in one row: each cell carries one object id per side, so areas and overlaps are real."""
    rng = random.Random(7)
    rows, cases = [], []
    for case in range(40):
        g = [rng.randint(0, 6) for _ in range(40)]
        p = [x if rng.random() < 0.6 else rng.randint(0, 6) for x in g]
        pairs = []
        for a in range(1, 7):
            for b in range(1, 7):
                n = sum(1 for x, y in zip(g, p) if (x, y) == (a, b))
                if n:
                    pairs.append((a, b, n, g.count(a), p.count(b)))
        cases.append(pairs)
        rows += [("m", case, *p_, p_[2] / (p_[3] + p_[4] - p_[2])) for p_ in pairs]
    df = spark.createDataFrame(
        rows, "model string, volume_id bigint, gt_id bigint, pred_id bigint, n_both bigint, gt_area bigint, pred_area bigint, iou double"
    )
    got = {(r.volume_id, r.gt_id, r.pred_id) for r in sc.match_objects(df, threshold).collect()}
    assert got == {(i, *m) for i, pairs in enumerate(cases) for m in walk(pairs, threshold)}


def test_half_iou_star(spark):
    """One object split into two equal predictions with IoU exactly 0.5: the lower id wins."""
    df = spark.createDataFrame(
        [("m", 1, 5, 8, 2, 4, 2, 0.5), ("m", 1, 5, 9, 2, 4, 2, 0.5)],
        "model string, volume_id bigint, gt_id bigint, pred_id bigint, n_both bigint, gt_area bigint, pred_area bigint, iou double",
    )
    assert [(r.gt_id, r.pred_id) for r in sc.match_objects(df).collect()] == [(5, 8)]


def test_object_scores_empty_sides(spark):
    g = spark.createDataFrame([(1, 7), (2, 7)], "volume_id bigint, object_id bigint")
    p = spark.createDataFrame([("m", 1, 7)], "model string, volume_id bigint, object_id bigint")
    m = spark.createDataFrame([("m", 1, 7, 7)], "model string, volume_id bigint, gt_id bigint, pred_id bigint")
    pairs = spark.createDataFrame([("m", v) for v in (1, 2, 3)], "model string, volume_id bigint")
    got = {r.volume_id: (r.tp, r.fp, r.fn, r.f1) for r in sc.object_scores(g, p, m, pairs).collect()}
    assert got == {1: (1, 0, 0, 1.0), 2: (0, 0, 1, 0.0), 3: (0, 0, 0, 1.0)}


def test_counts_fall_back_to_stem(spark):
    counts = spark.createDataFrame([("a.tiff", 2.0), ("b.tiff", 4.0), ("c.tiff", 1.0)], "file string, counts double")
    pred = spark.createDataFrame([("m", "a.tiff", 3.0), ("m", "b.tif", 5.0)], "model string, file string, pred_count double")
    got = {(r.file, r.pred_count) for r in sc.match_counts(counts, pred, ["m"]).collect()}
    assert got == {("a.tiff", 3.0), ("b.tiff", 5.0)}
    fit = sc.count_fit(sc.match_counts(counts, pred, ["m"])).first()
    assert fit.slope == pytest.approx((2 * 3 + 4 * 5) / (4 + 16))


def test_whiskers(spark):
    scores = spark.createDataFrame([("m", i, float(v)) for i, v in enumerate([1, 2, 3, 4, 100])], "model string, volume_id bigint, s double")
    b = sc.box_summary(scores, "s").first()
    assert (b.q1, b["median"], b.q3, b.whisker_low, b.whisker_high, b.outliers) == (2.0, 3.0, 4.0, 1.0, 4.0, 1)
