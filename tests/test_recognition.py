"""Recognition rules against plain loops over drawn pages."""

import itertools
import math
import random

import numpy as np
import pytest

from corvine.operators import glyph, score

LINES = "page string, page_width double, page_height double, x1 double, y1 double, x2 double, y2 double"
BOX = "left double, top double, right double, bottom double"
GRID = f"page string, part int, measure int, {BOX}, units int"


def test_staves_of_drawn_pages(spark):
    """Pages are drawn from known systems, with frames, odd staves, short lines, broken and short bars."""
    rng = random.Random(3)
    rows, want = [], {}
    for n in range(12):
        page, width, height = f"p{n}", rng.choice([500.0, 2000.0, 21.0]), rng.choice([700.0, 3000.0, 29.7])
        sp = height * rng.uniform(0.006, 0.009)
        add = lambda x1, y1, x2, y2, page=page, width=width, height=height: rows.append((page, width, height, x1, y1, x2, y2))
        y, systems = height * 0.05, rng.randrange(1, 4)
        x0, x1 = 0.08 * width, 0.93 * width
        for _ in range(systems):
            tops = [y, y + 11 * sp]
            for t in tops:
                for k in range(5):
                    add(x0, t + k * sp + rng.uniform(-0.05, 0.05) * sp, x1, t + k * sp + rng.uniform(-0.05, 0.05) * sp)
            bars = sorted({x0, x1, *[x0 + (x1 - x0) * k / 7 for k in rng.sample(range(1, 7), 3)]})
            for x in bars:
                foot, way = tops[1] + 4 * sp, rng.randrange(3)
                if way == 0:
                    add(x, tops[0], x, foot)
                elif way == 1:  # two pieces, almost touching, and a little inside
                    add(x, tops[0] + 0.15 * sp, x, tops[1])
                    add(x, tops[1] + 0.05 * sp, x, foot - 0.15 * sp)
                else:
                    add(x, foot, x, tops[0] - 0.1 * sp)
            add(x0 + 0.05 * width, tops[0], x0 + 0.05 * width, tops[1])  # too short
            add(x0 + 0.07 * width, tops[0], x0 + 0.07 * width, tops[1] - sp)  # broken by too much
            add(x0 + 0.07 * width, tops[1], x0 + 0.07 * width, tops[1] + 4 * sp)
            add(0.99 * width, tops[0], 0.99 * width, tops[1] + 4 * sp)  # outside
            want.setdefault(page, []).append((tops, bars, sp))
            y += 11 * sp + 4 * sp + 14 * sp
        if n % 3 == 0:  # a last staff without a partner
            for k in range(5):
                add(x0, y + k * sp, x1, y + k * sp)
        for at in (0.0, height):
            add(0.0, at, width, at)
        add(x0, height * 0.98, x0 + 0.2 * width, height * 0.98)
    rows += [("bare", 100.0, 100.0, 0.0, 0.0, 90.0, 0.0), ("one", 100.0, 100.0, 0.0, 0.0, 1.0, 1.0)]
    got = score.detect_staves(spark.createDataFrame(rows, LINES)).collect()
    assert {r["page"] for r in got if r["error"]} == {"bare", "one"}
    for page, systems in want.items():
        found = sorted((r["system"], r["staff"], r["top"], r["bars"]) for r in got if r["page"] == page)
        assert len(found) == 2 * len(systems), page
        for s, k, top, bars in found:
            tops, known, sp = systems[s]
            assert abs(top - tops[k]) < 0.06 * sp and bars == pytest.approx(known, abs=1e-3 * sp)


def grid(spark):
    return spark.createDataFrame([("p", part, 1, 0.0, 100.0 * part, 320.0, 100.0 * part + 40, 32) for part in (1, 2)], GRID)


def test_stems_without_a_part_span_staves(spark):
    heads = spark.createDataFrame([("p", 1, 1, 1, 40.0, 125.5, 52.0, 134.5), ("p", 1, 2, 2, 40.0, 215.5, 52.0, 224.5), ("p", 1, 1, 3, 100.0, 115.5, 112.0, 124.5)], f"page string, measure int, part int, id long, {BOX}")
    lines = spark.createDataFrame([("p", 1, None, 10, 52.0, 110.0, 52.5, 222.0), ("p", 1, None, 11, 112.0, 80.0, 112.5, 121.0), ("p", 1, 1, 12, 300.0, 100.0, 300.5, 240.0), ("p", 1, 1, 13, 100.0, 118.0, 100.4, 128.0)], f"page string, measure int, part int, id long, {BOX}")
    found, links = score.stems(lines, heads, grid(spark))
    got = {r["id"]: (r["part"], r["direction"], r["cross_staff"]) for r in found.collect()}
    assert got == {10: (2, "up", True), 11: (1, "up", False)}
    assert {(r["stem"], r["head"]) for r in links.collect()} == {(10, 2), (11, 3)}


def strip_points(x0, y0, x1, y1, a, b):
    return [{"x": x0, "y": y0 - a / 2}, {"x": x1, "y": y1 - b / 2}, {"x": x1, "y": y1 + b / 2}, {"x": x0, "y": y0 + a / 2}]


def test_strips_by_width_and_thickness(spark):
    rows = []
    for n, (w, a, b) in enumerate(itertools.product((5.0, 7.6, 40.0), (0.5, 1.5, 4.0, 8.0), (1.0, 3.0, 6.5))):
        p = strip_points(10.0, 50.0, 10.0 + w, 52.0, a, b)
        rows.append(("p", None if n % 2 else 1, 1, n, 10.0, min(q["y"] for q in p), 10.0 + w, max(q["y"] for q in p), p))
    prims = spark.createDataFrame(rows, f"page string, part int, measure int, id long, {BOX}, points array<struct<x:double,y:double>>")
    got = {r["id"] for r in score.beam_strips(prims, grid(spark)).collect()}
    want = {n for n, (w, a, b) in enumerate(itertools.product((5.0, 7.6, 40.0), (0.5, 1.5, 4.0, 8.0), (1.0, 3.0, 6.5))) if w >= 7.5 and 1.2 <= (a + b) / 2 <= 7 and max(a, b) <= 2.2 * min(a, b)}
    assert got == want and want


@pytest.mark.parametrize("one_by_one", [False, True])
def test_beams_of_five_levels(spark, one_by_one):
    stems = spark.createDataFrame([("p", 1, 1, k, 10.0, 20.0 * k, 20.0, 20.0 * k + 1, 120.0, "up") for k in (1, 2, 3)], f"page string, measure int, part int, id long, sp double, {BOX.replace('left', 'left')}, direction string")
    heads = spark.createDataFrame([("p", 1, 1, 100 + k, 20.0 * k - 12, 115.0, 20.0 * k, 124.0) for k in (1, 2, 3)], f"page string, measure int, part int, id long, {BOX}")
    links = spark.createDataFrame([("p", 1, k, 100 + k) for k in (1, 2, 3)], "page string, measure int, stem long, head long")
    strips = [("p", 1, n, 10.0, 20.5, 20.0 + 7 * n, 60.5, 20.0 + 7 * n) for n in range(5)]
    strips += [("p", 1, 9, 10.0, 20.5, 114.5, 60.5, 114.5), ("p", 1, 10, 10.0, 5.0, 90.0, 15.0, 90.0), ("p", 1, 11, 10.0, 20.5, 200.0, 60.5, 200.0)]
    made = score.beams(spark.createDataFrame(strips, "page string, measure int, id long, sp double, x0 double, y0 double, x1 double, y1 double"), stems, links, heads, one_by_one)
    got = {(r["beam"], r["stem"], r["level"]) for r in made.collect()}
    assert got == {(n, k, n + 1 if one_by_one else min(n + 1, 2)) for n in range(5) for k in (1, 2, 3)}


def test_arc_measures_and_gates(spark):
    def arc(width, rise, thick):
        x = np.linspace(0, width, 25)
        mid = 50 - rise * np.sin(np.pi * x / width)
        half = thick / 2 + 0.5 * np.sin(np.pi * x / width)
        return [{"x": float(a), "y": float(b)} for a, b in [*zip(x, mid - half), *zip(x[::-1], (mid + half)[::-1])]]

    shapes = {1: arc(60.0, 8.0, 1.0), 2: arc(6.0, 8.0, 1.0), 3: arc(60.0, 0.2, 1.0), 4: arc(60.0, 8.0, 7.0), 5: arc(60.0, 8.0, 1.0)[:5]}
    rows = [("p", 1, 1, n, min(q["x"] for q in p), min(q["y"] for q in p), max(q["x"] for q in p), max(q["y"] for q in p), p) for n, p in shapes.items()]
    prims = spark.createDataFrame(rows, f"page string, part int, measure int, id long, {BOX}, points array<struct<x:double,y:double>>")
    ids = lambda **gates: {r["id"] for r in score.arc_shapes(prims, grid(spark), **gates).collect()}
    assert ids() == {1, 2, 3, 4}
    assert ids(least_width=0.9) == {1, 3, 4} and ids(least_curvature=0.16) == {1, 2, 4} and 4 not in ids(most_thickness=0.55)
    one = score.arc_shapes(prims, grid(spark)).where("id = 1").first()
    assert (one["x0"], one["x1"], one["width"]) == (0.0, 60.0, 6.0) and one["curvature"] == pytest.approx(0.8, abs=0.15)


def symbol(i, x, y, label, confidence=0.9, w=6.0, h=16.0):
    """In part 1 of the grid: x in pixels, y in half spaces."""
    return ("p", 1, 1, i, x - w / 2, 100 + 5 * y - h / 2, x + w / 2, 100 + 5 * y + h / 2, label, confidence)


def test_accidentals_by_chains_and_blockers(spark):
    symbols = [
        symbol(1, 50, 3, "sharp"),  # lane of row 3: tried, then 2 fails, and 3 waits for its head
        symbol(2, 80, 3, "blot"),
        symbol(3, 110, 3, "natural"),  # right before head 102
        symbol(4, 200, 8, "sharp", 0.5),  # not sure: ends its lane
        symbol(5, 220, 8, "sharp"),  # no head near: never tried
        symbol(6, 150, -2, "flat", h=16),  # half space above its foot: row -1.4, head 103
        symbol(7, 20, 3, "sharp"),  # lies on the clef: passed over, lane goes on
        symbol(8, 60, 20, "sharp"),  # recognized, head 104 is behind a blot
        symbol(9, 75, 20, "blot"),
    ]
    heads = spark.createDataFrame([("p", 1, 1, 101, 60.0, 110.5, 72.0, 119.5, 6.6, 3.0), ("p", 1, 1, 102, 118.0, 110.5, 130.0, 119.5, 12.4, 3.0), ("p", 1, 1, 103, 160.0, 88.5, 172.0, 97.5, 16.6, -1.4), ("p", 1, 1, 104, 94.0, 195.5, 106.0, 204.5, 10.0, 20.0)], f"page string, part int, measure int, id long, {BOX}, lx double, ly double")
    clefs = spark.createDataFrame([("p", 1, 1, 900, 10.0, 90.0, 30.0, 150.0)], f"page string, part int, measure int, id long, {BOX}")
    made = score.accidentals(spark.createDataFrame(symbols, f"page string, part int, measure int, id long, {BOX}, label string, confidence double"), heads, clefs, grid(spark))
    assert {r["id"]: r["head"] for r in made.collect()} == {1: 101, 3: 102, 6: 103, 8: None}


def slow_distance(a, b, phase):
    """The sum of the survey's terms by loops."""
    total = 0.0
    for (n, w), (m, v) in zip(a["scans"], b["scans"]):
        total += 2.5 * ((n - m) / 2) ** 2 + 4.0 * (w - v) ** 2
    best = math.inf
    for order in itertools.permutations(range(3)):
        s = 0.0
        for i, j in enumerate(order):
            r, q = (a["rings"][i] if i < len(a["rings"]) else None), (b["rings"][j] if j < len(b["rings"]) else None)
            if r is None and q is None:
                continue
            if r is None or q is None:
                s += 0.65 * (1.25 * (r or q)[0] ** 2 + 0.08)
                continue
            t = 1.5 * (r[0] - q[0]) ** 2 + 0.6 * ((r[1] - q[1]) ** 2 + (r[2] - q[2]) ** 2) + 0.5 * ((r[3] - q[3]) ** 2 + (r[4] - q[4]) ** 2)
            for k in range(5, 21, 2):
                x, y = complex(r[k], r[k + 1]), complex(q[k], q[k + 1])
                t += abs(x - y) ** 2 if phase else (abs(x) - abs(y)) ** 2
            s += 0.65 * t
        best = min(best, s)
    return math.sqrt(total + best + 0.015 * (a["count"] - b["count"]) ** 2)


def test_fourier_distance_of_random_outlines():
    rng = random.Random(8)
    ring = lambda cx, cy, r: [{"x": cx + r * rng.uniform(0.7, 1.3) * math.cos(t), "y": cy + r * rng.uniform(0.7, 1.3) * math.sin(t)} for t in np.linspace(0, 2 * math.pi, 17)[:-1]]
    shapes = [[ring(0, 0, 5), *[ring(rng.uniform(-2, 2), rng.uniform(-2, 2), 1) for _ in range(rng.randrange(4))]] for _ in range(12)]
    made = [glyph.fourier(s) for s in shapes]
    for a, b in itertools.product(made, made):
        for phase in (True, False):
            assert glyph.fourier_distance(a, b, phase) == pytest.approx(slow_distance(a, b, phase))
    for s, d in zip(shapes, made):
        again = glyph.fourier([[{"x": 7 + 3 * p["x"], "y": 3 * p["y"] - 1} for p in r] for r in s[::-1]] + [s[0][:0]])
        assert glyph.fourier_distance(d, again) < 1e-6 and d["count"] == len(s)
    assert glyph.fourier([shapes[0][0], shapes[0][0]])["count"] == 1


def test_scans_count_crossings():
    square, hole = [(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1.1), (3, 1.1), (3, 2.9), (1, 2.9)]
    d = glyph.fourier([[{"x": x, "y": y} for x, y in r] for r in (square, hole)])
    assert [n for n, _ in d["scans"]] == 2 * [2, 2, 4, 4, 4, 4, 4, 2, 2] and [w for _, w in d["scans"]] == pytest.approx([1.0] * 18)
