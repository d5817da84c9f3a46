"""Sorted groups in batches: cut where groups end, however batches lie, and no call of Python for each group."""

import pyarrow as pa
import pytest

from corvine import catalog
from corvine.operators import grouped


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_whole_groups_over_batches(size):
    rows = [(None, 1, 0.5), (None, 1, None), (None, 2, 1.0), ("a", None, 2.0), ("a", None, 3.0), ("a", 2, 4.0), ("b", 2, 5.0), ("b", 2, 6.0), ("b", 2, 7.0), ("b", 2, 8.0), ("c", 2, 9.0)]
    schema = pa.schema([("p", pa.string()), ("k", pa.int64()), ("v", pa.float64())])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + size]), schema)], schema=schema) for i in range(0, len(rows), size)]
    batches.insert(1, batches[0].slice(0, 0))
    found = [(b.slice(g.start, g.stop - g.start).to_pydict()) for b, groups in grouped.whole_groups(iter(batches), ["p", "k"]) for g in groups]
    assert [(g["p"][0], g["k"][0], g["v"]) for g in found] == [(None, 1, [0.5, None]), (None, 2, [1.0]), ("a", None, [2.0, 3.0]), ("a", 2, [4.0]), ("b", 2, [5.0, 6.0, 7.0, 8.0]), ("c", 2, [9.0])]


@pytest.mark.parametrize("name", ["l27_chord_rhythm", "g11_nms", "g11_clefs", "l46_interval_colouring", "g07_anchor_groups", "l02_staff_windows", "g01_staves"])
def test_no_call_for_each_group(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    assert "FlatMapGroupsIn" not in df._jdf.queryExecution().toString()


def test_suppression_keeps_large_ids_and_null_scores_last(spark):
    big = (1 << 60) + 1
    rows = [("p", big, 0.0, 0.0, 4.0, 4.0, None), ("p", big + 1, 0.0, 0.0, 4.0, 4.0, 0.5), ("p", big + 2, 9.0, 0.0, 12.0, 4.0, None), (None, big + 3, 0.0, 0.0, 4.0, 4.0, 0.1)]
    df = spark.createDataFrame(rows, "page string, id long, left double, top double, right double, bottom double, score double")
    assert {r["id"]: r["kept"] for r in grouped.suppress(df, ["page"], "score", "id", 0.45).collect()} == {big: False, big + 1: True, big + 2: True, big + 3: True}
    assert {r["id"]: r["anchor"] for r in grouped.anchor_groups(df, ["page"], "id").collect()} == {big: big, big + 1: big, big + 2: big + 2, big + 3: big + 3}
