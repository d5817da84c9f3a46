"""Properties of the operators that hold for any input."""

import random

import pytest
from pyspark.sql import functions as F

from corvine.functions import geometry as geo
from corvine.functions import scalar as fn
from corvine.operators import grouped, iterate, joins, score, windows
from corvine.plans import fixtures


def test_half_even(spark):
    r = spark.range(1).select(*[fn.half_even(F.lit(x)).alias(f"c{k}") for k, x in enumerate((0.5, 1.5, 2.5, -0.5))]).first()
    assert list(r) == [0, 2, 2, 0]


def test_logical_and_physical_are_inverse(spark):
    d = spark.range(200).select((F.col("id") * 1.37).alias("x"))
    back = geo.to_physical_x(geo.to_logical_x(F.col("x"), F.lit(3.0), F.lit(250.0), F.lit(32)), F.lit(3.0), F.lit(250.0), F.lit(32))
    assert d.select(F.max(F.abs(back - F.col("x"))).alias("m")).first()["m"] < 1e-9


def test_matching_is_one_to_one_and_greedy(spark):
    rng = random.Random(1)
    rows = [(k, a, b, rng.randrange(1000) / 10) for k in range(4) for a in range(12) for b in range(9) if rng.random() < 0.6]
    got = {(r["k"], r["a"], r["b"]) for r in iterate.greedy_match(spark.createDataFrame(rows, "k int, a int, b int, s double"), ["k"], "a", "b", F.col("s")).collect()}
    want, left, right = set(), set(), set()
    for k, a, b, _ in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        if (k, a) not in left and (k, b) not in right:
            want.add((k, a, b))
            left.add((k, a))
            right.add((k, b))
    assert got == want


def test_components_partition_the_nodes(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    got = dict(iterate.components(spark.createDataFrame(edges, "a long, b long")).collect())
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {x: find(x) for x in root}


def test_islands_are_disjoint(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), float(s := rng.randrange(1000)), float(s + rng.randrange(30))) for _ in range(200)]
    i = windows.merge_islands(spark.createDataFrame(rows, "k int, s double, e double"), ["k"], "s", "e", 5.0).groupBy("k", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).orderBy("k", "s").collect()
    assert all(a["k"] != b["k"] or b["s"] - a["e"] > 5.0 for a, b in zip(i, i[1:]))


def test_claims_are_idempotent(spark):
    s = fixtures.page_symbols(spark)
    once = score.exclude_claimed(s, s.where("label = 'oval'"))
    assert once.count() == score.exclude_claimed(once, s.where("label = 'oval'")).count() == s.count() - s.where("label = 'oval'").count()


def test_band_and_interval_joins_equal_all_pairs(spark):
    rng = random.Random(4)
    a = spark.createDataFrame([(k, rng.randrange(3), rng.random() * 100, 0.0) for k in range(150)], "id int, k int, x double, y double").withColumn("y", F.col("x") + F.col("id") % 7)
    b = spark.createDataFrame([(k, rng.randrange(3), rng.random() * 100) for k in range(100)], "id int, k int, x double").withColumn("y", F.col("x") + F.col("id") % 5)
    p = a.alias("a").join(b.alias("b"), F.col("a.k") == F.col("b.k"))
    near = p.where(F.abs(F.col("a.x") - F.col("b.x")) <= 0.7).select("a.id").distinct().count()
    assert joins.band_semi(a, b, "x", "x", 0.7, ["k"]).count() == near > 0
    meet = p.where((F.col("a.x") <= F.col("b.y")) & (F.col("b.x") <= F.col("a.y"))).count()
    assert joins.interval_join(a, b, ["k"], ("x", "y"), ("x", "y"), 3.0).count() == meet > 0


def test_lanes_never_overlap_and_are_fewest(spark):
    rng = random.Random(5)
    rows = [(0, k, float(s := rng.randrange(100)), float(s + 1 + rng.randrange(20))) for k in range(80)]
    got = grouped.colour_intervals(spark.createDataFrame(rows, "k int, id int, s double, e double"), ["k"], "s", "e", "id").collect()
    for a in got:
        assert all(a["id"] == b["id"] or a["lane"] != b["lane"] or a["e"] <= b["s"] or b["e"] <= a["s"] for b in got)
    assert max(r["lane"] for r in got) + 1 == max(sum(r["s"] <= t < r["e"] for r in got) for t in range(120))


def test_suppression_and_anchor_groups(spark):
    rows = [("p", 1, 0.0, 0.0, 10.0, 10.0, 0.9), ("p", 2, 1.0, 1.0, 10.0, 10.0, 0.8), ("p", 3, 9.0, 9.0, 19.0, 19.0, 0.7), ("p", 4, 18.0, 18.0, 30.0, 30.0, 0.6)]
    d = spark.createDataFrame(rows, "page string, id long, left double, top double, right double, bottom double, score double")
    assert {r["id"] for r in grouped.suppress(d, ["page"], "score", "id", 0.45).where("kept").collect()} == {1, 3, 4}
    assert {r["id"]: r["anchor"] for r in grouped.anchor_groups(d, ["page"], "id").collect()} == {4: 4, 3: 4, 1: 1, 2: 1}


def test_global_rank(spark):
    d = spark.range(0, 1000, 1, 7).select((F.pmod(F.col("id") * 7919, F.lit(1009))).alias("v"))
    got = iterate.global_rank(d, ["v"], "n").orderBy("v").collect()
    assert [r["n"] for r in got] == list(range(1, 1001))
    assert iterate.global_rank(d.limit(0), ["v"], "n").count() == 0


def test_labels_spread_to_the_end_of_a_long_chain(spark, monkeypatch):
    monkeypatch.setattr(iterate, "cut", lambda df: spark.createDataFrame(df.collect(), df.schema).coalesce(1))  # many rounds: no files
    nodes = spark.createDataFrame([(i, 7 if i == 0 else None) for i in range(52)], "node long, label long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(51)], "a long, b long")
    got = iterate.spread_labels(nodes.coalesce(1), edges.coalesce(1)).collect()
    assert {(r["label"], r["state"]) for r in got if r["node"] > 0} == {(7, "spread")}


@pytest.mark.parametrize("block", [5, 2048])
def test_nearest_in_blocks_equals_brute_force(spark, monkeypatch, block):
    import math
    import random

    from corvine.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = random.Random(block)
    data = [(i, f"c{i % 3}", [float(rng.randrange(4)) for _ in range(3)], rng.randrange(64)) for i in range(23)]
    table = spark.createDataFrame(data, "id long, class string, value array<double>, mask long")
    refs = table.withColumnRenamed("id", "ref")
    far = lambda a, b: math.dist(a[2], b[2])
    want = {(a[0], c): min((far(a, b), b[0]) for b in data if b[1] == c and b[0] != a[0]) for a in data for c in ("c0", "c1", "c2")}
    got = vectors.nearest_of_class(table.select("id", "value"), refs.select("ref", "class", "value"), apart=True).collect()
    assert {(r["id"], r["class"]): (pytest.approx(r["dist"]), r["ref"]) for r in got} == want
    less = lambda a, b: 1 - (bin(a[3] & b[3]).count("1") / bin(a[3] | b[3]).count("1") if a[3] | b[3] else 0)
    few = vectors.nearest_few(table.select("id", F.col("mask").alias("value")), refs.select("ref", F.col("mask").alias("value")), 4).collect()
    assert {(r["id"], r["place"]): r["ref"] for r in few} == {(a[0], k): b for a in data for k, (_, b) in enumerate(sorted((less(a, b), b[0]) for b in data)[:4], 1)}
    none = vectors.nearest_few(table.select("id", "value").where("false"), refs.select("ref", "value"), 2)
    assert none.count() == 0


def test_nearest_value_of_one_key_is_cut(spark):
    import random

    from corvine.operators import joins

    rng = random.Random(2)
    left = [(1 if i % 5 else i % 3, i, rng.choice([float(rng.randrange(300)), None]) if i % 11 == 0 else float(rng.randrange(300))) for i in range(400)]
    right = [(1 if i % 7 else i % 4, i, float(rng.randrange(100, 200))) for i in range(90)]
    got = joins.nearest_value(spark.createDataFrame(left, "k int, l long, a double"), spark.createDataFrame(right, "k int, r long, b double"), ["k"], "a", "b", "l", "r").collect()
    want = {}
    for k, i, a in left:
        near = [(abs(a - b), r) for j, r, b in right if j == k and a is not None]
        want[i] = min(near)[::-1] if near else (None, None)
    assert len(got) == len(left) and {r["l"]: (r["match"], r["gap"]) for r in got} == want


def test_one_key_is_clustered_in_pieces_between_gaps(spark):
    """Clusters and complete links of a single key, many pieces, ties, nulls, negative values and gaps of exactly the tolerance, against loops."""
    import random

    from corvine.operators import grouped

    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, None]), i, rng.choice([None, *[rng.randrange(-300, 300) / 4 for _ in range(12)]])) for i in range(260)]
    df = spark.createDataFrame(rows, "k int, id long, v double").repartition(3)
    clusters = {r["id"]: r["cluster"] for r in grouped.running_mean_clusters(df.where("v is not null"), ["k"], "v", 1.25, "id").collect()}
    links = {r["id"]: r["link"] for r in grouped.complete_link(df.where("v is not null"), ["k"], ["v", "id"], "v", 2.0).collect()}
    for key in (1, None):
        own = sorted((v, i) for k, i, v in rows if k == key and v is not None)
        total, n, c, low, g = 0.0, 0, -1, None, -1
        for v, i in own:
            if n == 0 or v - total / n > 1.25:
                total, n, c = 0.0, 0, c + 1
            total, n = total + v, n + 1
            if low is None or v - low > 2.0:
                low, g = v, g + 1
            assert clusters.pop(i) == c and links.pop(i) == g
    assert not clusters and not links
    pieces = grouped.between_gaps(df.where("v is not null"), ["k"], ["v", "id"], "v", 1.25, "n", lambda g: [0] * len(g)).groupBy("k").agg(F.count_distinct("n").alias("n"))
    assert all(r["n"] > 5 for r in pieces.collect())
