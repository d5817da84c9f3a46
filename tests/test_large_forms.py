"""Forms of queries whose work or memory must not grow faster than their input."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from corvine import catalog
from corvine.operators import aggregates


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [float(k % 7) for k in range(999)], [1.0] * 500 + [2.0] * 500, [5.0] * 900 + [float(k) for k in range(600)], [random.Random(4).random() for _ in range(5001)]])
def test_median_of_a_table_is_exact_with_few_values_at_a_time(spark, monkeypatch, values):
    monkeypatch.setattr(aggregates, "ACCURACY", 50)
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(3)
    assert aggregates.table_median(df, "v", few=3) == pytest.approx(statistics.median(values), abs=1e-12)


def test_median_of_nothing(spark):
    assert aggregates.table_median(spark.createDataFrame([(None,)], "v double"), "v") is None


def test_medians_are_not_gathered_in_one_task(spark, sf):
    """No percentile() of the whole table: it holds all values."""
    df = catalog.queries()["p08_outlier_in_both"](spark, sf)
    ends = [aggregates.table_median(spark.read.parquet(f"{sf}/lineitem.parquet"), c) for c in ("l_quantity", "l_extendedprice")]
    want = spark.read.parquet(f"{sf}/lineitem.parquet").agg(F.percentile("l_quantity", 0.5), F.percentile("l_extendedprice", 0.5)).first()
    assert ends == list(want) and df.count() > 0


def test_a_walk_makes_no_pairs_of_nodes(spark, sf):
    """A step meets the nodes at the edge, not all pairs of nodes of an order."""
    plan = catalog.queries()["i05_bfs"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and "LeftSemi" in plan


def test_lanes_are_judged_by_one_sort(spark, sf):
    plan = catalog.queries()["l46_lane_validity"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Window" in plan


def test_signatures_are_sent_once_and_without_masks(spark):
    from corvine.llm import op02_spotsigs as op

    sets = spark.createDataFrame([(1, [1, 2, 3]), (2, [2, 3, 4]), (3, [9])], "cid long, sigs array<int>")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = op.prefixes(op.partitioned(sets, 0.8), 0.8)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(sig") == 1
        # of each class the first that another has too: 1 and 4 stand alone, and come before
        assert sorted((r["cid"], r["sig"], r["place"]) for r in found.collect()) == []
        half = op.prefixes(op.partitioned(sets, 0.5), 0.5)
        assert sorted((r["cid"], r["sig"], r["place"]) for r in half.collect()) == [(1, 2, 2), (2, 2, 2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_equal_lines_meet_measures_once_and_lie_in_runs(spark, monkeypatch):
    """All texts come with all measures of their number, the equal ones of a measure one after the other."""
    from collections import Counter
    from itertools import groupby

    from corvine.operators import legacy

    monkeypatch.setattr(legacy, "COPIES", 7)
    texts = [(None if i % 11 == 0 else i % 20, None if i % 9 == 0 else 1 + i % 2, [None, "L", "R"][i % 3], None if i % 13 == 0 else f"{'abc'[i % 3]} in a longer line of text {i}") for i in range(4000)]
    measures = [(f"p{k % 25}", k * 7919 % 100_003, None if k % 50 == 49 else k % 21) for k in range(1000)]
    df = spark.createDataFrame(texts, "measure int, staff int, align string, value string")
    got = legacy.place_text(df, spark.createDataFrame(measures, "page string, measure_pos long, number int"))
    want = Counter((p, k, s, a, v and v[:25], "tempo" if (m, s, a) == (1, 1, "L") else "words") for m, s, a, v in texts if m is not None for p, k, n in measures if n == m)
    rows = [tuple(r) for r in got.collect()]
    assert Counter(rows) == want and max(want.values()) > 14
    assert len(list(groupby(rows))) == len(want)


def test_figures_of_a_block_are_sorted_once(spark, sf):
    """Figures and their blocks meet in one join, and are dealt to as many tasks as the session has, however few bytes they are."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = catalog.queries()["g09_compound_meters"](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and plan.count("REPARTITION_BY_NUM") == 2
        assert df.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
