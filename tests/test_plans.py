"""What the plans must look like to hold at a thousand times the data."""

import re

import pytest

from corvine import catalog

SF = "/root/testdata/sf0.01"


def plan(spark, name):
    return catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in catalog.queries() if re.match(r"[aopuwx]\d\d_|x_|j\d\d_", n)])
def test_joins_have_an_equal_part(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    p = plan(spark, "p02_filter_chain")
    assert "GreaterThanOrEqual(l_quantity,10" in p and "LessThanOrEqual(l_discount" in p
    schema = re.search(r"ReadSchema: (struct<.*>)", p)[1]
    assert "l_comment" not in schema and "l_tax" not in schema and "l_shipdate" not in schema
    assert "Exchange" not in p


@pytest.mark.parametrize("name", ["w01_carry_forward", "w03_cursor", "w10_islands", "w15_position", "w18_interpolate", "j14_asof_join", "j17_blocked_nearest"])
def test_windows_share_one_shuffle(spark, name):
    shuffles = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan(spark, name))
    assert len(set(re.sub(r"#\d+L?", "", s) for s in shuffles)) == 1


@pytest.mark.parametrize("name", ["a01_group_composite", "a04_argmax", "a10_having", "a11_bool", "a19_f1"])
def test_aggregates_are_partial_before_the_shuffle(spark, name):
    assert "partial_" in plan(spark, name)


@pytest.mark.parametrize("name", ["p01_project", "p14_array_shape_gate", "p22_first_rule_wins", "x_bankers_round", "w01_carry_forward", "j06_band_semi", "a14_folds"])
def test_no_python_where_columns_do(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan(spark, name))


@pytest.mark.parametrize("name,key,want", [("g07_anchor_groups", "page", {1, 41, 5000}), ("g11_nms", "page", {1, 41, 5000}), ("j26_tolerance_match", "k", {3, 2001, 60000})])
def test_no_rows_are_left_out_by_their_id(spark, tmp_path, name, key, want):
    rows = [(o, s, n, 10.0 + n, 0.01 * n, 100.0 + n, "A") for o, s in ((3, 1), (2001, 41), (60000, 5000)) for n in (1, 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_extendedprice double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r[key] for r in catalog.queries()[name](spark, str(tmp_path)).collect()} == want
