"""Overlay of random polygons (crossing themselves, touching, on a coarse grid) against points, and of pieces whose boxes mislead."""

import numpy as np
import pytest

from corvine.functions import overlay as op
from corvine.operators import glyph, joins, score


def square(x, y, size):
    return np.array([(x, y), (x + size, y), (x + size, y + size), (x, y + size)], float)


def winding(points, rings):
    out = np.zeros(len(points), int)
    for p in rings:
        for (x0, y0), (x1, y1) in zip(p, np.roll(p, -1, axis=0)):
            if y0 != y1:
                cross = points[:, 0] < (x1 - x0) * (points[:, 1] - y0) / (y1 - y0) + x0
                out += (cross & (y0 <= points[:, 1]) & (points[:, 1] < y1)).astype(int) - (cross & (y1 <= points[:, 1]) & (points[:, 1] < y0)).astype(int)
    return out


@pytest.mark.parametrize("rule", ["evenodd", "nonzero"])
def test_areas_and_outlines_of_random_polygons(rule):
    rng = np.random.default_rng(5)
    points = rng.random((20000, 2))
    for t in range(60):
        a, b = [rng.random((rng.integers(3, 9), 2))], [rng.random((rng.integers(3, 9), 2)), rng.random((4, 2))]
        if t % 3 == 0:  # many corners on edges, edges on edges
            a, b = ([np.rint(p * 6) / 6 for p in x] for x in (a, b))
        inside = [w != 0 if rule == "nonzero" else w % 2 != 0 for w in (winding(points, a), winding(points, b))]
        both, x, y = op.areas(a, b, rule)
        whole = op.united([a, b], rule=rule)
        less = op.overlay([a, b], lambda i: i[0] & ~i[1], rule)
        assert abs(both - (inside[0] & inside[1]).mean()) < 0.02 and abs(less.area - (inside[0] & ~inside[1]).mean()) < 0.02
        assert abs(both + whole.area - x - y) < 1e-9 and abs(less.area + both - x) < 1e-9
        for strips in (whole, less):
            rings = op.outlines(strips)
            assert abs(op.own_area(rings) - strips.area) < 1e-6
            assert abs(abs(sum(glyph.area(p) for p in rings)) - strips.area) < 1e-6  # holes turn the other way


def test_known_unions_and_clipping():
    joined = op.outlines(op.united([[square(0, 0, 1)], [square(1, 0, 1)]]))
    assert [len(p) for p in joined] == [4]
    frame = op.outlines(op.united([[square(0, 0, 4), square(1, 1, 2)]]))
    assert sorted(abs(glyph.area(p)) for p in frame) == [4.0, 16.0]
    assert op.united([[square(0, 0, 4)]], (1, 1, 2, 9)).area == 3.0 and op.united([[square(0, 0, 1)]], (5, 5, 6, 6)).area == 0
    assert op.united([]).area == 0 and op.outlines(op.united([[]])) == []
    area, rings = glyph.normalized([[[{"x": x, "y": y} for x, y in square(k, 0, 2).tolist()]] for k in range(3)], (0.5, 0, 9, 1))
    assert area == 3.5 and len(rings) == 1 and len(rings[0]) == 4


def test_a_large_outline_costs_no_square_of_memory():
    turn = np.linspace(0, 2 * np.pi, 6000, endpoint=False)
    rough = np.stack([np.cos(turn), np.sin(turn)], axis=1) * (1 + 0.001 * np.cos(50 * turn))[:, None]
    both, a, b = op.areas([rough], [rough + (0.5, 0)])
    assert 0 < both < a and abs(a - b) < 1e-9 and abs(a - np.pi) < 0.01


def test_ink_not_boxes_joins_pieces(spark):
    """Two slanted bars whose boxes are the same and whose ink is apart; a third one touches both."""
    bars = [(1, [(0, 0), (1, 0), (10, 9), (10, 10)]), (2, [(0, 4), (0, 3), (6, 10), (5, 10)]), (3, [(20, 0), (30, 0), (30, 10), (20, 10)])]
    rows = [("p", 1, i, [[{"x": float(x), "y": float(y)} for x, y in p]], *map(float, (min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p), max(y for _, y in p)))) for i, p in bars]
    df = spark.createDataFrame(rows, f"page string, symbol long, id long, rings {glyph.RINGS}, left double, top double, right double, bottom double")
    child = lambda df: {r["id"]: r["child"] for r in score.split_ink(df).collect()}
    assert child(df) == {1: 1, 2: 2, 3: 3} and child(df.drop("rings")) == {1: 1, 2: 1, 3: 3}
    link = spark.createDataFrame([("p", 1, 4, [[{"x": x, "y": y} for x, y in ((0.0, 0.0), (5.0, 0.0), (5.0, 10.0), (0.0, 10.0))]], 0.0, 0.0, 5.0, 10.0)], df.schema)
    assert child(df.unionByName(link)) == {1: 1, 2: 1, 4: 1, 3: 3}


@pytest.mark.parametrize("share", [0.0, 0.05, 0.09])
def test_claimed_rectangles_against_all_pairs(spark, share):
    rng = np.random.default_rng(9)
    claimed = [("p", *map(float, (x, y, x + w, y + h))) for x, y, w, h in np.round(rng.random((60, 4)) * [40, 40, 6, 6] - [20, 20, 0.5, 0.5], 1)]
    near = [(k, *map(float, np.round([x + e[0] * (r - x), t + e[1] * (b - t), r - e[2] * (r - x), b - e[3] * (b - t)], 6))) for k, x, t, r, b in claimed for e in rng.random((4, 4)) * 0.12]
    names = "page string, left double, top double, right double, bottom double"
    rows = [*claimed, *near, ("q", *claimed[0][1:]), ("p", 0.0, 0.0, 0.0, 0.0)]
    inside = lambda a, c: all((a[1] - c[1] >= 0, a[2] - c[2] >= 0, c[3] - a[3] >= 0, c[4] - a[4] >= 0, a[1] - c[1] <= share * (c[3] - c[1]), c[3] - a[3] <= share * (c[3] - c[1]), a[2] - c[2] <= share * (c[4] - c[2]), c[4] - a[4] <= share * (c[4] - c[2])))
    want = sorted(a for a in rows if not any(a[0] == c[0] and inside(a, c) for c in claimed if c[3] >= c[1] and c[4] >= c[2]))
    valid = [c for c in claimed if c[3] >= c[1] and c[4] >= c[2]]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], names + ", n int")
    got = joins.claimed_anti(df, spark.createDataFrame(valid, names), ["page"], share)
    assert sorted(tuple(r)[:5] for r in got.select("page", *score.BOX).collect()) == want


@pytest.mark.parametrize("rule", ["evenodd", "nonzero"])
def test_many_at_once_are_as_one_by_one(rule, monkeypatch):
    monkeypatch.setattr(op, "TOGETHER", 1 << 10)  # so that some have more edges than are looked at together
    rng = np.random.default_rng(8)
    items = [[[rng.random((n, 2))] for n in rng.integers(3, 12, k % 4)] for k in range(200)] + [[[np.rint(rng.random((6, 2)) * 4)], []], [[rng.random((60, 2))], [rng.random((4, 2))]]]
    least = lambda x: x[0]
    assert np.abs(op.areas_of_many(items, [least], rule)[0] - [op.own_area(x[0], rule) if x else 0 for x in items]).max() < 1e-9
    for box in (None, (0.2, 0.3, 0.8, 0.7)):
        for a, b in zip(op.united_of_many(items, box, rule), (op.united(x, box, rule) if x else op.NOTHING for x in items), strict=True):
            assert abs(a.area - b.area) < 1e-9


def test_masks_and_rings_of_many_are_as_one_by_one():
    rng = np.random.default_rng(4)
    values = [[rng.random((n, 2)) for n in rng.integers(3, 9, k % 4)] for k in range(300)] + [[np.rint(rng.random((5, 2)) * 3)] for _ in range(100)] + [[rng.random((600, 2))]]
    assert glyph.occupancy_masks(values) == [glyph.occupancy_mask(v) for v in values]
    back = glyph.column_rings(glyph.as_rings(values[:300]))
    assert all(np.array_equal(p, q) for v, w in zip(values, back) for p, q in zip(v, w, strict=True)) and len(back) == 300


def test_glyphs_are_united_without_a_call_for_each(spark, sf):
    from corvine import catalog

    assert "FlatMapGroupsIn" not in catalog.queries()["d09_normalized_shapes"](spark, sf)._jdf.queryExecution().toString()


def test_a_piece_that_meets_none_takes_no_part_in_the_search(spark, monkeypatch):
    from corvine.operators import iterate

    seen = []
    search = iterate.components
    monkeypatch.setattr(iterate, "components", lambda edges: search(seen.append(edges) or edges))
    rows = [("p", 1, i, *map(float, box)) for i, box in enumerate([(0, 0, 2, 2), (1, 1, 3, 3), (8, 8, 9, 9), (20, 0, 21, 1)])] + [(None, 1, 7, 0.0, 0.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "page string, symbol long, id long, left double, top double, right double, bottom double")
    assert sorted(((r["page"] or "", r["id"], r["child"]) for r in score.split_ink(df).collect())) == [("", 7, 7), ("p", 0, 0), ("p", 1, 0), ("p", 2, 2), ("p", 3, 3)]
    assert seen[0].count() == 1
