"""Neighbours and meeting rectangles against all pairs, with ties, nulls, and one key that holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from corvine.operators import neighbours as op
from corvine.operators import vectors


def sides(spark, seed, n=120, values=40):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *[rng.randrange(values) / 4 for _ in range(8)]]), i) for i in range(n)]
    left = [(k, v, i) for k, v, i in rows if i % 2]
    right = [(k, v, -i) for k, v, i in rows if i % 2 == 0]
    make = lambda x, names: spark.createDataFrame(x, names).repartition(3)
    return left, right, make(left, "k string, x double, l long"), make(right, "k string, y double, r long")


@pytest.mark.parametrize("k", [1, 2, 5])
def test_nearest_k(spark, k):
    for seed in (1, 2):
        left, right, l, r = sides(spark, seed + 10 * k, values=[6, 400][seed - 1])  # noqa: E741
        want = set()
        for key, x, i in left:
            near = sorted((abs(x - y), j) for g, y, j in right if g == key and key and None not in (x, y))
            want |= {(key, i, j, gap, n) for n, (gap, j) in enumerate(near[:k], 1)}
        got = op.nearest_k(l, r, ["k"], "x", "y", "l", "r", k).collect()
        assert len(got) == len(want) and {tuple(g) for g in got} == want


def test_margin_and_containing(spark):
    left, right, l, r = sides(spark, 5)  # noqa: E741
    got = {g["l"]: g["match"] for g in op.with_margin(l, r, ["k"], "x", "y", "l", "r", 0.5, 3.0).collect()}
    inside = {g["l"]: g["match"] for g in op.nearest_containing(l, r, ["k"], "x", "y", "l", "r", 0.6).collect()}
    for key, x, i in left:
        near = sorted((abs(x - y), j) for g, y, j in right if g == key and key and None not in (x, y))
        if near:
            clear = (len(near) < 2 or near[1][0] - near[0][0] >= 0.5) and near[0][0] <= 3
            assert got.pop(i) == (near[0][1] if clear else None)
            over = [j for gap, j in near if gap <= 0.6]
            assert inside.pop(i) == (min(over) if over else near[0][1])
    assert not got and not inside


def test_band_minimum_over_many_ranks(spark):
    rng = random.Random(4)
    right = [(1, float(i), rng.randrange(10**6)) for i in range(700)]
    left = [(1, rng.uniform(-50, 750), i) for i in range(60)]
    for reach in (0.2, 3.0, 90.0, 5000.0):
        got = {g["l"]: g["match"] for g in op.band_min(spark.createDataFrame(left, "k int, x double, l int"), spark.createDataFrame(right, "k int, y double, r int"), ["k"], "x", "y", "l", "r", reach).collect()}
        want = {i: min(ids) for _, x, i in left if (ids := [j for _, y, j in right if abs(x - y) <= reach])}
        assert got == want


def boxes(rng, n, size, key=lambda rng: rng.choice("aab")):
    return [(key(rng), i, x, y, x + rng.random() * size, y + rng.random() * size) for i in range(n) for x, y in [(rng.gauss(50, 20), rng.gauss(50, 20))]]


NAMES = "page string, id int, left double, top double, right double, bottom double"


@pytest.mark.parametrize("within", [0.0, 1.5])
def test_rectangles_that_meet(spark, monkeypatch, within):
    monkeypatch.setattr(op, "CELL_ROWS", 8)
    rng = random.Random(8)
    a, b = boxes(rng, 250, 9), [*boxes(rng, 200, 5), ("a", 900, -1e3, 40.0, 1e3, 60.0), ("a", 901, 50.0, 50.0, 50.0, 50.0), (None, 902, 0.0, 0.0, 99.0, 99.0)]
    got = [(r["l_id"], r["r_id"]) for r in op.rect_join(spark.createDataFrame(a, NAMES), spark.createDataFrame(b, NAMES), ["page"], within).collect()]
    want = {(x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] - within <= y[4] and y[2] <= x[4] + within and x[3] - within <= y[5] and y[3] <= x[5] + within}
    assert len(got) == len(set(got)) and set(got) == want


def test_one_page_of_very_many_pieces(spark):
    """A hundred thousand small pieces of a page: the cells compare a small part of the 10^10 pairs."""
    df = spark.range(100_000).selectExpr("'p' page", "id", "pmod(xxhash64(id, 1), 65536) / 64D `left`", "pmod(xxhash64(id, 2), 65536) / 64D top")
    df = df.withColumns({"right": F.col("left") + 0.5, "bottom": F.col("top") + 0.5}).select("page", "id", "left", "top", "right", "bottom")
    met = op.rect_join(df, df, ["page"])
    n = met.where("l_id < r_id").count()
    cell = df.selectExpr("id", "`left`", "top", "floor(`left`) cx", "floor(top) cy")
    near = cell.withColumn("cx", F.explode(F.expr("array(cx - 1, cx, cx + 1)"))).withColumn("cy", F.explode(F.expr("array(cy - 1, cy, cy + 1)"))).selectExpr("id o", "`left` ol", "top ot", "cx", "cy")
    want = cell.join(near, ["cx", "cy"]).where("id < o and abs(`left` - ol) <= 0.5 and abs(top - ot) <= 0.5").count()
    assert n == want > 1000


def test_balls_leave_out_most_distances_and_nothing_near(spark):
    """Four hundred clusters: the nearest are those of all pairs, by less than a tenth of the distances."""
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(400, 12)) * 10
    points = np.concatenate([centres[rng.integers(0, 400, 5000)] + rng.normal(size=(5000, 12)) * 0.1, np.repeat(centres[:1], 200, axis=0)])
    names = ["a" if i % 2 else "b" for i in range(len(points))]
    df = spark.createDataFrame([(i, c, p.tolist()) for i, (c, p) in enumerate(zip(names, points))], "id long, class string, value array<double>").repartition(4)
    refs = df.withColumnRenamed("id", "ref")
    gap = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    np.fill_diagonal(gap, np.inf)
    told = spark.sparkContext.accumulator(0)
    got = vectors.nearest_few(df.select("id", "value"), refs.select("ref", "value"), 3, apart=True, told=told).collect()
    assert 0 < told.value < 0.1 * len(points) ** 2
    want = np.argsort(gap, axis=1, kind="stable")[:, :3]
    assert len(got) == want.size and all(want[r["id"], r["place"] - 1] == r["ref"] for r in got)
    told = spark.sparkContext.accumulator(0)
    best = {(r["id"], r["class"]): (r["dist"], r["ref"]) for r in vectors.nearest_of_class(df.select("id", "value"), refs, apart=True, told=told).collect()}
    assert 0 < told.value < 0.1 * len(points) ** 2 and len(best) == 2 * len(points)
    for c in "ab":
        mine = np.array([x == c for x in names])
        of = np.where(mine[None], gap, np.inf)
        assert all(best[i, c][1] == of[i].argmin() for i in range(len(points)))
