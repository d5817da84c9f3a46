"""Recognition on score pages: staves, blocks, grid and the object resolvers, one function each, and the chain.

Common columns: page, id, box (left, top, right, bottom; y downward), part, measure, and for classified symbols label and confidence. ``grid``
has a row per (page, part, measure) with its box, beats, beat_value and units. sp, the staff space, is a quarter of a block's height; all
thresholds are in it. Joins have (page, measure) or (page, part, measure) as their equi part, so pages spread over the cluster.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import geometry as geo
from ..functions import scalar as fn
from . import glyph, grouped, iterate, joins, neighbours
from . import windows as win

BLOCK = ["page", "part", "measure"]
BOX = ["left", "top", "right", "bottom"]
#: Ledger and staff geometry in half spaces: staff lines are 0, 2, 4, 6, 8.
TOP_LINE, BOTTOM_LINE = 0, 8

STAVES = "page string, system int, staff int, left double, top double, right double, bottom double, bars array<double>, error string"


def runs_within(values: np.ndarray, tolerance: float) -> list[slice]:
    """Ascending values in runs: one joins the open run while it lies within the tolerance of the run's mean."""
    out, start, v = [], 0, values.tolist()
    for i in range(1, len(v) + 1):
        # the mean lies between the run's ends, and is needed only where these do not tell
        if i < len(v) and v[i] - v[start] < tolerance * (1 - 1e-9):
            continue
        if i == len(v) or v[i] - v[i - 1] > tolerance * (1 + 1e-9) or v[i] - values[start:i].mean() > tolerance:
            out.append(slice(start, i))
            start = i
    return out if v else []


def merged_uprights(x: np.ndarray, top: np.ndarray, bottom: np.ndarray, x_tolerance: float, join: float) -> list[tuple[float, float, float]]:
    """(x, top, bottom) of vertical pieces, those at one x joined where the gap between them is ``join`` at most."""
    order = np.lexsort((top, x))
    x, top, bottom = x[order], top[order], bottom[order]
    out = []
    for run in runs_within(x, x_tolerance):
        inner = np.argsort(top[run], kind="stable")
        t, b = top[run][inner], np.maximum.accumulate(bottom[run][inner])
        starts = [0, *(np.flatnonzero(t[1:] > b[:-1] + join) + 1), len(t)]
        out += [(float(x[run].mean()), float(t[i]), float(b[j - 1])) for i, j in zip(starts, starts[1:], strict=False)]
    return out


def page_staves(width: float, height: float, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, share: float) -> list[tuple]:
    """(system, staff, left, top, right, bottom, bars) of a page's lines, or an empty list."""
    x_tolerance, y_tolerance = 0.001 * width, 0.001 * height
    long = np.flatnonzero((np.abs(y2 - y1) <= y_tolerance) & (np.abs(x2 - x1) >= share * width))
    long = long[np.argsort((y1 + y2)[long], kind="stable")]
    y = (y1 + y2)[long] / 2
    rows = [(y[r].mean(), long[r][np.abs(x2 - x1)[long[r]].argmax()]) for r in runs_within(y, y_tolerance)]  # the widest line stands for its row
    centre = np.array([c for c, _ in rows])
    gaps = np.sort(np.diff(centre)[np.diff(centre) > y_tolerance])
    if len(long) < 5 or not len(gaps):
        return []
    low = gaps[: max(1, len(gaps) // 3)]
    sp = low[len(low) // 2]
    staves, i = [], 0
    while i + 5 <= len(rows):
        if (np.abs(np.diff(centre[i : i + 5]) - sp) <= 0.3 * sp).all():
            staves.append((centre[i], centre[i + 4], [k for _, k in rows[i : i + 5]]))
            i += 5
        else:
            i += 1
    upright = np.abs(x2 - x1) <= x_tolerance
    pieces = merged_uprights(((x1 + x2) / 2)[upright], np.minimum(y1, y2)[upright], np.maximum(y1, y2)[upright], x_tolerance, max(y_tolerance, 0.10 * sp))
    out, edge, system = [], max(y_tolerance, 0.25 * sp), 0
    for (top, upper, a), (lower, bottom, b) in zip(staves[::2], staves[1::2], strict=False):
        lines = [*a, *b]
        left, right = float(np.minimum(x1, x2)[lines].mean()), float(np.maximum(x1, x2)[lines].mean())
        bars: list[float] = []
        for x in sorted(x for x, t, f in pieces if t <= top + edge and f >= bottom - edge and f - t >= bottom - top - 2 * edge and left - x_tolerance <= x <= right + x_tolerance):
            if not bars or x - bars[-1] > x_tolerance:
                bars.append(x)
        if len(bars) >= 2:
            out += [(system, k, left, float(t), right, float(f), bars) for k, (t, f) in enumerate(((top, upper), (lower, bottom)))]
            system += 1
    return out


def detect_staves(lines: DataFrame, share: float = 0.35) -> DataFrame:
    """lines: page, page_width, page_height, x1, y1, x2, y2. Long horizontals cluster by y (0.001 of the page's height); the staff space is the middle of the lower third of the gaps;
    five lines whose gaps are within 0.3 of it are a staff, two staves a system (a last odd one is left out; left and right are the means of its lines). Its bars are the verticals at one x
    (0.001 of the width), joined over gaps of 0.1 spaces, that reach to 0.25 spaces of both ends; a system has two at least. A page without a system gives a row with an error."""

    arrow = to_arrow_schema(T.StructType.fromDDL(STAVES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, pages in grouped.whole_groups(batches, ["page"]):
            page, width, height, *ends = (b.column(b.schema.get_field_index(c)) for c in ("page", "page_width", "page_height", "x1", "y1", "x2", "y2"))
            ends, rows = [grouped.numbers(c) for c in ends], []
            for g in pages:
                name = page[g.start].as_py()
                found = page_staves(width[g.start].as_py(), height[g.start].as_py(), *[c[g] for c in ends], share)
                rows += [(name, *row, None) for row in found] or [(name, *[None] * 7, "no staff system")]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    # lines of one height are told apart by their order
    return grouped.by_groups(lines, ["page"], ["y1", "x1", "y2", "x2"]).mapInArrow(run, STAVES)


def blocks(staves: DataFrame) -> DataFrame:
    """One row per part and measure: neighbouring bars bound measures, numbered over the systems of a page."""
    good = staves.where("error is null and size(bars) > 1")
    m = good.select("page", "system", "staff", "top", "bottom", F.posexplode(F.expr("zip_with(slice(bars, 1, size(bars) - 1), slice(bars, 2, size(bars) - 1), (a, b) -> struct(a as `left`, b as `right`))")).alias("k", "b"))
    w = Window.partitionBy("page", "staff").orderBy("system", "k")
    return m.select("page", "system", (F.col("staff") + 1).alias("part"), F.row_number().over(w).alias("measure"), (F.col("k") == 0).alias("starts_new_system"), "b.left", "top", "b.right", "bottom")


def logical_grid(blocks_: DataFrame, meters: DataFrame, subdivisions: int = 8) -> DataFrame:
    """blocks with the meter in force (the most confident of a measure, carried on in the part) and units = beats * subdivisions."""
    best = meters.groupBy(*BLOCK).agg(F.max_by(F.struct("beats", "beat_value"), "confidence").alias("m"))
    g = win.carry_forward(blocks_.join(best, BLOCK, "left"), ["page", "part"], ["measure"], "m", "m")
    return g.select(*blocks_.columns, "m.beats", "m.beat_value", (F.col("m.beats") * subdivisions).alias("units"))


def on_grid(objects: DataFrame, grid: DataFrame) -> DataFrame:
    """objects with their block's box as block_*, sp, and logical x and y of their centre."""
    g = grid.select(*BLOCK, *[F.col(c).alias(f"block_{c}") for c in BOX], "units")
    o = objects.join(g, BLOCK)
    height = F.col("block_bottom") - F.col("block_top")
    cx, cy = (F.col("left") + F.col("right")) / 2, (F.col("top") + F.col("bottom")) / 2
    return o.withColumns({"sp": height / 4, "lx": geo.to_logical_x(cx, F.col("block_left"), F.col("block_right") - F.col("block_left"), F.col("units")), "ly": (cy - F.col("block_top")) / (height / 8)})


def drop_garbage(prims: DataFrame, blocks_: DataFrame) -> DataFrame:
    """Without what is too large in both directions against the page's median block (1.8 widths, 3 heights)."""
    m = blocks_.groupBy("page").agg(F.coalesce(F.percentile(F.col("right") - F.col("left"), 0.5), F.lit(1.0)).alias("mw"), F.coalesce(F.percentile(F.col("bottom") - F.col("top"), 0.5), F.lit(1.0)).alias("mh"))
    r = geo.Rect.of()
    return prims.join(m, "page", "left").where(F.col("mw").isNull() | ~((r.width > 1.8 * F.col("mw")) & (r.height > 3 * F.col("mh")))).drop("mw", "mh")


def drop_staff_lines(prims: DataFrame, lines: DataFrame, blocks_: DataFrame) -> DataFrame:
    """Without long thin pieces at the height of a staff line. lines: page, y."""
    m = blocks_.groupBy("page").agg(F.percentile(F.col("right") - F.col("left"), 0.5).alias("mw"), F.percentile((F.col("bottom") - F.col("top")) / 4, 0.5).alias("msp"))
    r = geo.Rect.of()
    thin = prims.join(m, "page").where((r.width >= 1.25 * F.col("mw")) & (r.height <= 0.3 * F.col("msp"))).withColumn("yc", (F.col("top") + F.col("bottom")) / 2)
    near = thin.alias("t").join(lines.alias("s"), (F.col("t.page") == F.col("s.page")) & (F.abs(F.col("t.yc") - F.col("s.y")) <= 0.25 * F.col("t.msp"))).select(F.col("t.page").alias("page"), F.col("t.id").alias("id")).distinct()
    return prims.join(near, ["page", "id"], "left_anti")


def assign_blocks(prims: DataFrame, blocks_: DataFrame, reach: float = 1.5) -> DataFrame:
    """prims with part, measure and scope. Pieces that meet exactly one block are seeds; labels spread to pieces within ``reach``
    spaces, several at once leave a piece ambiguous, which then takes the measure of the nearest block, containing ones first."""
    keyed = blocks_.select("page", "part", "measure", *[F.col(c).alias(f"b_{c}") for c in BOX])
    met = neighbours.rect_join(prims.select("page", "id", *BOX), blocks_.select("page", "part", "measure", *BOX), ["page"])
    hits = met.groupBy("page", F.col("l_id").alias("id")).agg(F.count("*").alias("n"), F.min(F.struct(F.col("r_part").alias("part"), F.col("r_measure").alias("measure"))).alias("b"))
    label = F.when(F.col("n") == 1, F.concat_ws(":", "page", "b.part", "b.measure"))
    node = F.concat_ws(":", "page", "id")
    nodes = prims.join(hits, ["page", "id"], "left").select(node.alias("node"), label.alias("label"))
    sp = blocks_.groupBy("page").agg(F.percentile((F.col("bottom") - F.col("top")) / 4, 0.5).alias("sp"))
    p = prims.join(sp, "page").select("page", "id", "sp", *BOX)
    near = neighbours.rect_join(p, p.drop("sp"), ["page"], reach * F.col("sp"))
    near = near.where((F.col("l_id") < F.col("r_id")) & (geo.rect_distance(geo.Rect.of("l_"), geo.Rect.of("r_")) <= reach * F.col("l_sp")))
    spread = iterate.spread_labels(nodes, near.select(F.concat_ws(":", "page", "l_id").alias("a"), F.concat_ws(":", "page", "r_id").alias("b")))
    placed = prims.withColumn("node", node).join(spread, "node").drop("node")
    parts = F.split("label", ":")
    placed = placed.withColumns({"part": F.element_at(parts, -2).cast("int"), "measure": F.element_at(parts, -1).cast("int")})
    lost = placed.where("label is null").select("page", "id", *BOX)
    inside = (F.col("left") >= F.col("b_left")) & (F.col("right") <= F.col("b_right"))
    cost = F.struct((~inside).alias("o"), geo.rect_distance(geo.Rect.of(), geo.Rect.of("b_")).alias("d"), F.abs((F.col("left") + F.col("right") - F.col("b_left") - F.col("b_right")) / 2).alias("x"), "measure")
    best = lost.join(keyed, "page").groupBy("page", "id").agg(F.min_by("measure", cost).alias("near"))
    out = placed.join(best, ["page", "id"], "left").withColumn("measure", F.coalesce("measure", "near"))
    scope = F.when(F.col("part").isNotNull(), "PartMeasure").when(F.col("measure").isNotNull(), "Measure").otherwise("PhysicalOnly")
    return out.withColumn("scope", scope).drop("near", "label", "state")


def group_symbols(prims: DataFrame) -> DataFrame:
    """Symbols: in each block the largest piece takes what overlaps it. symbol is the anchor's id."""
    return grouped.anchor_groups(prims, BLOCK, "id", "symbol")


def split_ink(prims: DataFrame, share: float = 0.01) -> DataFrame:
    """page, id, child: within a symbol, pieces whose common ink is more than ``share`` of the smaller one's hang together. The ink is in the column ``rings``, if
    there is one, else it is the box. Only pieces whose boxes have an area in common are overlaid."""
    boxes = prims.select("page", "symbol", "id", *BOX)
    met = neighbours.rect_join(boxes, boxes, ["page", "symbol"]).where((F.col("l_id") < F.col("r_id")) & geo.overlaps(geo.Rect.of("l_"), geo.Rect.of("r_"), 0.0))
    a, b = geo.Rect.of("l_"), geo.Rect.of("r_")
    if "rings" in prims.columns:
        ink = lambda mark: prims.select("page", F.col("id").alias(f"{mark}_id"), F.col("rings").alias(f"{mark}_rings"))
        met = met.select("page", "l_id", "r_id").join(ink("l"), ["page", "l_id"]).join(ink("r"), ["page", "r_id"])
        met = iterate.cut(glyph.with_share_of_ink(met, "l_rings", "r_rings", "share").where(F.col("share") > share).select("page", "l_id", "r_id"))
    else:
        both = (F.least(a.right, b.right) - F.greatest(a.left, b.left)) * (F.least(a.bottom, b.bottom) - F.greatest(a.top, b.top))
        met = met.where(both > share * F.least(a.area, b.area))
    key = lambda c: F.concat_ws(":", "page", F.lpad(F.col(c).cast("string"), 20, "0"))
    found = iterate.components(met.select(key("l_id").alias("a"), key("r_id").alias("b")))
    # a piece that meets none is its own
    every = prims.select("page", F.col("id").cast("long").alias("id")).distinct().withColumn("node", key("id"))
    return every.join(found, "node", "left").select("page", "id", F.coalesce(F.element_at(F.split("label", ":"), -1).cast("long"), "id").alias("child"))


def exclude_claimed(candidates: DataFrame, claimed: DataFrame) -> DataFrame:
    return joins.claimed_anti(candidates, claimed, ["page"])


def meters(digits: DataFrame, grid: DataFrame, supported: list[tuple[int, int]]) -> DataFrame:
    """Digits (label a number) over digits in one block: top above bottom, overlapping in x, sizes alike, a supported pair; side by place, confidence the geometric mean. The eight best a block."""
    d = on_grid(digits, grid).where(F.col("label").rlike("^[0-9]+$")).withColumn("value", F.col("label").cast("int"))
    top = d.where("ly between 0 and 4").select(*BLOCK, "id", "value", "confidence", "sp", *BOX, "block_left", "block_right")
    low = d.where("ly between 4 and 8").select(*BLOCK, F.col("id").alias("o"), F.col("value").alias("o_value"), F.col("confidence").alias("o_confidence"), *[F.col(c).alias(f"o_{c}") for c in BOX])
    a, b = geo.Rect.of(), geo.Rect.of("o_")
    pairs = top.join(low, BLOCK).where((geo.overlap_share(a.left, a.right, b.left, b.right) >= 0.35) & (F.col("bottom") <= F.col("o_top") + 0.35 * F.col("sp")) & (F.least(a.height, b.height) / F.greatest(a.height, b.height) >= 0.6))
    known = digits.sparkSession.createDataFrame(supported, "value int, o_value int")
    place = ((F.col("left") + F.col("right")) / 2 - F.col("block_left")) / (F.col("block_right") - F.col("block_left"))
    found = pairs.join(F.broadcast(known), ["value", "o_value"], "left_semi")
    found = found.withColumns({"confidence": F.sqrt(F.col("confidence") * F.col("o_confidence")), "side": F.when(place <= 0.48, "Left").when(place >= 0.72, "Right").otherwise("Middle")})
    found = found.withColumn("n", F.row_number().over(Window.partitionBy(*BLOCK).orderBy(F.desc("confidence"), "id", "o"))).where("n <= 8")
    return found.select(*BLOCK, F.col("value").alias("beats"), F.col("o_value").alias("beat_value"), "side", "confidence", F.least("left", "o_left").alias("left"), "top", F.greatest("right", "o_right").alias("right"), F.col("o_bottom").alias("bottom"))


def compound_meters(symbols: DataFrame, grid: DataFrame, supported: list[tuple[int, int]]) -> DataFrame:
    """The best meter of each block, whose numbers may have two figures that came as two symbols. Figures (labels that are numbers) fit a row by their size; in each half of the
    block a row is one figure or two neighbours (gap of -0.10 to 0.32 staff heights, common height of 0.55 of the lower). An upper and a lower row of like size, one above the other, are a candidate,
    scored by how well they agree; the eight best of a block are read, and of those that are supported the most certain (its agreement has a vote of 0.18) is the meter."""
    # figures take little room when they are sent and much when they are sorted, so the number of tasks is that of the session and not one by bytes sent
    tasks = int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = on_grid(symbols.where(F.col("label").rlike("^[0-9]{1,2}$")).repartition(tasks, "page"), grid.repartition(tasks, "page"))
    staff, r = 4 * F.col("sp"), geo.Rect.of()
    d = d.where(r.height.between(0.22 * staff, 0.72 * staff) & r.width.between(0.10 * staff, 1.15 * staff) & (r.width >= 0.20 * r.height))
    one = d.select(*BLOCK, "id", "label", "confidence", *BOX, "sp", "block_left", "block_right", (F.col("ly") < 4).alias("upper"))
    # one sort of a block's figures tells the neighbours, the forms of a row and the lower rows; no side of a join is made twice
    along = Window.partitionBy(*BLOCK).orderBy("upper", "left", "id")
    two = one.withColumn("b", F.lead(F.struct("upper", "label", "confidence", *BOX)).over(along))
    gap = (F.col("b.left") - F.col("right")) / staff
    shared = (F.least("bottom", "b.bottom") - F.greatest("top", "b.top")) / F.least(r.height, F.col("b.bottom") - F.col("b.top"))
    both = F.concat("label", "b.label")
    form = lambda label, confidence, *box: F.struct(label.cast("int").alias("value"), F.length(label).alias("figures"), confidence.alias("confidence"), *[x.alias(c) for x, c in zip(box, BOX, strict=True)])
    alone = form(F.col("label"), F.col("confidence"), *[F.col(c) for c in BOX])
    joined = F.when((F.col("b.upper") == F.col("upper")) & gap.between(-0.10, 0.32) & (shared >= 0.55), form(both, F.sqrt(F.col("confidence") * F.col("b.confidence")), F.least("left", "b.left"), F.least("top", "b.top"), F.greatest("right", "b.right"), F.greatest("bottom", "b.bottom")))
    rows = two.select(*BLOCK, "id", "sp", "block_left", "block_right", "left", "upper", F.array_compact(F.array(alone, joined)).alias("forms"))
    lower = F.collect_list(F.when(~F.col("upper"), F.struct("id", "forms"))).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kept = [*BLOCK, "id", "sp", "block_left", "block_right"]
    top = rows.withColumn("lower", lower).where("upper").select(*kept, "lower", F.explode("forms").alias("t")).select(*kept, "t.*", F.explode("lower").alias("l"))
    found = top.withColumn("f", F.explode("l.forms")).withColumns({"o": F.col("l.id"), **{f"o_{c}": F.col(f"f.{c}") for c in ("value", "figures", "confidence", *BOX)}}).drop("l", "f")
    a, b = geo.Rect.of(), geo.Rect.of("o_")
    ratio = lambda x, y: F.least(x, y) / F.greatest(x, y)
    overlap, off, wide, high = geo.overlap_share(a.left, a.right, b.left, b.right), F.abs(a.left + a.right - b.left - b.right) / 2 / staff, ratio(a.width, b.width), ratio(a.height, b.height)
    over = (b.top - a.bottom) / staff
    cover = (F.greatest("bottom", "o_bottom") - F.least("top", "o_top")) / staff
    fits = (overlap >= 0.58) & (off <= 0.22) & (wide >= 0.48) & (high >= 0.52) & ((a.width + b.width) / 2 >= 0.14 * staff) & over.between(-0.18, 0.24) & cover.between(0.72, 1.35)
    agree = 1.8 * overlap + 0.65 * wide + 0.35 * high + 0.35 * F.least(cover, F.lit(1.05)) - 0.55 * off
    found = found.where(fits).withColumn("agree", agree)
    ties = ["id", "figures", "o", "o_figures"]
    found = found.withColumn("n", F.row_number().over(Window.partitionBy(*BLOCK).orderBy(F.desc("agree"), *ties))).where("n <= 8")
    known = symbols.sparkSession.createDataFrame(supported, "value int, o_value int")
    found = found.join(F.broadcast(known), ["value", "o_value"], "left_semi").withColumn("confidence", F.sqrt(F.col("confidence") * F.col("o_confidence")))
    best = found.withColumn("n", F.row_number().over(Window.partitionBy(*BLOCK).orderBy(F.desc(F.col("confidence") + 0.18 * F.col("agree")), *ties))).where("n = 1")
    place = ((F.least("left", "o_left") + F.greatest("right", "o_right")) / 2 - F.col("block_left")) / (F.col("block_right") - F.col("block_left"))
    side = F.when(place <= 0.48, "Left").when(place >= 0.72, "Right").otherwise("Middle")
    return best.select(*BLOCK, F.col("value").alias("beats"), F.col("o_value").alias("beat_value"), side.alias("side"), "confidence", F.least("left", "o_left").alias("left"), F.least("top", "o_top").alias("top"), F.greatest("right", "o_right").alias("right"), F.greatest("bottom", "o_bottom").alias("bottom"))


def clefs(symbols: DataFrame, grid: DataFrame) -> DataFrame:
    """Size gate; of candidates in one place (centre and size to 0.01) the one that is not derived and has the most paths, where symbols tell (columns derived, paths); then non-maximum suppression per
    kind. kind is the label."""
    s = on_grid(symbols, grid)
    if {"derived", "paths"} <= set(s.columns):
        box = geo.Rect.of()
        bucket = [fn.half_even(x * 100) for x in ((box.left + box.right) / 2, (box.top + box.bottom) / 2, box.width, box.height)]
        named = s.withColumns({f"__b{i}": x for i, x in enumerate(bucket)})
        first = F.row_number().over(Window.partitionBy(*BLOCK, *[f"__b{i}" for i in range(4)]).orderBy("derived", F.desc("paths"), "id"))
        s = named.withColumn("__n", first).where("__n = 1").drop("__n", *[f"__b{i}" for i in range(4)])
    r = geo.Rect.of()
    gated = s.where((r.height / (F.col("sp") / 2)).between(6, 22) & (r.width / (4 * F.col("sp"))).between(0.40, 1.80) & F.col("label").isin("G", "F", "C"))
    return grouped.suppress(gated.select("page", "part", "measure", "id", "label", "confidence", "lx", *BOX), [*BLOCK, "label"], "confidence", "id", 0.45).where("kept").drop("kept")


def ledgers(prims: DataFrame, grid: DataFrame) -> DataFrame:
    """Ledger ladders: short thin pieces at an even level outside the staff, joined where they overlap in x by 0.35; of each ladder the levels
    without a gap from the staff on. depth counts them, below the staff positive, above negative."""
    r = geo.Rect.of()
    g = on_grid(prims, grid).withColumn("level", fn.half_even(F.col("ly") / 2) * 2)
    g = g.where((r.width / F.col("sp")).between(0.5, 3) & (r.height <= 0.25 * F.col("sp")) & (F.abs(F.col("ly") - F.col("level")) <= 0.35) & ((F.col("level") <= -2) | (F.col("level") >= 10)))
    g = g.withColumns({"side": F.when(F.col("level") < 0, -1).otherwise(1), "step": F.when(F.col("level") < 0, -F.col("level") / 2).otherwise((F.col("level") - 8) / 2).cast("int")})
    key = F.concat_ws(":", "page", "part", "measure", "side", F.lpad(F.col("id").cast("string"), 12, "0"))
    g = g.withColumn("node", key)
    b = g.select(*BLOCK, "side", F.col("node").alias("o"), F.col("left").alias("o_left"), F.col("right").alias("o_right"))
    pairs = g.join(b, [*BLOCK, "side"]).where((F.col("node") == F.col("o")) | ((F.col("node") < F.col("o")) & (geo.overlap_share(F.col("left"), F.col("right"), F.col("o_left"), F.col("o_right")) >= 0.35)))
    ladders = iterate.components(pairs.select(F.col("node").alias("a"), F.col("o").alias("b")))
    g = g.join(ladders, "node").withColumnRenamed("label", "ladder")
    n = F.dense_rank().over(Window.partitionBy("ladder").orderBy("step"))
    g = g.withColumn("n", n).where("n = step")
    return g.groupBy(*BLOCK, "side", "ladder").agg((F.max("step") * F.first("side")).alias("depth"), F.min("left").alias("left"), F.max("right").alias("right"), F.min("top").alias("top"), F.max("bottom").alias("bottom")).drop("ladder")


def noteheads(ovals: DataFrame, grid: DataFrame, clefs_: DataFrame, ledgers_: DataFrame) -> DataFrame:
    """Ovals at a legal staff position with their pitch. Positions from -1 to 9 are legal; others need a ladder that is deep enough and covers the head in x. The clef is
    the last at or left of the head. Where ovals have points, there are 12 or more, whose radii vary little. An oval within a larger one of its measure is no head; with a
    column source (what it was drawn by) the outer one of the two is hollow, if the inner is centred and of a fitting width. hole marks ovals that are known to be hollow."""
    r = geo.Rect.of()
    if "points" in ovals.columns:
        ovals = ovals.where((F.size("points") >= 12) & (geo.radial_variation(F.col("points"), r) <= 0.34))
    o = on_grid(ovals, grid).withColumn("position", fn.half_even(F.col("ly")).cast("int"))
    o = o.where((r.height / F.col("sp")).between(0.45, 1.35) & (r.width / r.height).between(1.05, 2.40) & (F.abs(F.col("ly") - F.col("position")) <= 0.40))
    p = F.col("position")
    need = F.when(p < -1, F.ceil((F.abs(p) - 1) / 2)).when(p > 9, F.ceil((p - 9) / 2)).otherwise(0)
    l = ledgers_.select(*BLOCK, F.col("depth"), F.col("left").alias("l_left"), F.col("right").alias("l_right"))  # noqa: E741
    covered = o.withColumn("need", need).join(l, BLOCK, "left")
    reach = (F.col("need") == 0) | ((F.signum("depth") == F.when(p < 0, -1).otherwise(1)) & (F.abs("depth") >= F.col("need")) & (F.least("right", "l_right") - F.greatest("left", "l_left") > 0))
    legal = covered.withColumn("ok", reach).groupBy("page", "id").agg(F.bool_or("ok").alias("ok")).where("ok").drop("ok")
    o = nested(o.join(legal, ["page", "id"], "left_semi"), ovals)
    c = clefs_.select("page", "part", "measure", F.coalesce("lx", F.lit(-1e9)).alias("at"), F.col("id").alias("cid"), F.col("label").alias("clef"))
    keyed = o.withColumns({"at": F.coalesce("lx", F.lit(1e9)), "cid": F.lit(None).cast("long")})
    placed = _last_clef(keyed, c)
    known = placed.where("clef in ('G', 'F')")
    step_g, octave_g = fn.pitch_of(F.col("position"), 3, 5)  # top line of a G clef: F5
    step_f, octave_f = fn.pitch_of(F.col("position"), 5, 3)  # of an F clef: A3
    is_g = F.col("clef") == "G"
    return known.select(*BLOCK, "id", *BOX, "sp", "lx", "ly", "position", "clef", F.when(is_g, step_g).otherwise(step_f).alias("step"), F.when(is_g, octave_g).otherwise(octave_f).alias("octave"), (~F.coalesce("hole", F.lit(False))).alias("filled"))


def nested(heads: DataFrame, ovals: DataFrame) -> DataFrame:
    """heads without those that lie in a larger one of their block, and with hole for those that hold a smaller oval of their own source: centred within 0.35 of the
    height, 0.25 to 0.90 of the width, less than 0.95 of the area."""
    known = [c for c in ("source",) if c in ovals.columns]
    h = iterate.cut(heads)
    met = neighbours.rect_join(h.select(*BLOCK, "id", *BOX, *known), ovals.select(*BLOCK, "id", *BOX, *known), BLOCK)
    a, b = geo.Rect.of("l_"), geo.Rect.of("r_")
    met = met.where((F.col("l_id") != F.col("r_id")) & (b.left >= a.left) & (b.right <= a.right) & (b.top >= a.top) & (b.bottom <= a.bottom) & (b.area < a.area))
    within = met.select("page", F.col("r_id").alias("id")).distinct()
    out = h.join(within, ["page", "id"], "left_anti")
    if known:
        off = F.sqrt(F.pow((a.left + a.right - b.left - b.right) / 2, 2) + F.pow((a.top + a.bottom - b.top - b.bottom) / 2, 2))
        fits = (F.col("l_source") == F.col("r_source")) & (b.area < 0.95 * a.area) & (off <= 0.35 * a.height) & (b.width / a.width).between(0.25, 0.90)
        hollow = met.where(fits).select("page", F.col("l_id").alias("id")).distinct().withColumn("__hollow", F.lit(True))
        hole = F.coalesce(F.col("__hollow"), F.col("hole") if "hole" in h.columns else F.lit(None), F.lit(False))
        return out.join(hollow, ["page", "id"], "left").withColumn("hole", hole).drop("__hollow")
    return out if "hole" in out.columns else out.withColumn("hole", F.lit(False))


def _last_clef(heads: DataFrame, clefs_: DataFrame) -> DataFrame:
    """As-of on (measure, x): clefs come before heads at the same place."""
    c = clefs_.withColumn("__side", F.lit(0))
    both = heads.withColumns({"__side": F.lit(1), "clef": F.lit(None).cast("string")}).unionByName(c, allowMissingColumns=True)
    w = Window.partitionBy("page", "part").orderBy("measure", "at", "__side", "cid").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("clef", F.last("clef", ignorenulls=True).over(w)).where("__side = 1").drop("__side", "at", "cid")


def measure_space(grid: DataFrame) -> DataFrame:
    """page, measure, sp: the mean staff space of a measure's blocks, for what spans staves."""
    return grid.groupBy("page", "measure").agg(F.avg((F.col("bottom") - F.col("top")) / 4).alias("sp"))


def stems(lines: DataFrame, heads: DataFrame, grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stems and stem-head links. A line, of a part or of a measure only (part null), is thin and at least 1.2 sp tall; a head touches an end within 0.20 sp in x and 0.28 sp in y. Up if heads touch the
    lower end alone, down if the upper alone; of both the nearer, up on ties. Heads at that end are attached; a line without a part takes that of the nearest of them. Cross-staff: it meets the
    height of two parts' blocks. heads may tell their width, which is then not rounded as part of a right edge: lines stand at the very limit."""
    r = geo.Rect.of()
    l = lines.join(measure_space(grid), ["page", "measure"]).where((r.height > 1e-9) & (r.width <= 0.16 * r.height) & (r.height >= 1.2 * F.col("sp")))  # noqa: E741
    l = l.select("page", "measure", F.col("part").alias("own_part"), F.col("id").alias("stem"), "sp", *[F.col(c).alias(f"s_{c}") for c in BOX])  # noqa: E741
    wide = F.col("width") if "width" in heads.columns else F.lit(None).cast("double")
    h = heads.select("page", "measure", F.col("part").alias("head_part"), F.col("id").alias("head"), *BOX, wide.alias("wide"))
    x, s = (F.col("s_left") + F.col("s_right")) / 2, F.col("sp")
    dx = F.greatest(F.col("left") - x, F.coalesce(x - F.col("left") - F.col("wide"), x - F.col("right")), F.lit(0.0))
    low = geo.interval_gap(F.col("s_bottom"), F.col("s_bottom"), F.col("top"), F.col("bottom"))
    high = geo.interval_gap(F.col("s_top"), F.col("s_top"), F.col("top"), F.col("bottom"))
    far = lambda dy: F.when((dx <= 0.20 * s) & (dy <= 0.28 * s), F.sqrt(dx * dx + dy * dy))
    met = l.join(h, ["page", "measure"]).withColumns({"low": far(low), "high": far(high)}).where("low is not null or high is not null")
    key = ["page", "measure", "stem", "own_part", "sp", *[f"s_{c}" for c in BOX]]
    nearest = lambda d: F.min(F.when(F.col(d).isNotNull(), F.struct(d, "head", "head_part")))
    ends = met.groupBy(*key).agg(nearest("low").alias("at_low"), nearest("high").alias("at_high"))
    up = F.col("at_low").isNotNull() & (F.col("at_high").isNull() | (F.col("at_low.low") <= F.col("at_high.high")))
    ends = ends.withColumn("direction", F.when(up, "up").otherwise("down")).withColumn("part", F.coalesce("own_part", F.when(up, F.col("at_low.head_part")).otherwise(F.col("at_high.head_part"))))
    b = grid.select("page", "measure", F.col("part").alias("b_part"), F.col("top").alias("b_top"), F.col("bottom").alias("b_bottom"))
    parts = ends.join(b, ["page", "measure"]).where((F.col("s_bottom") >= F.col("b_top")) & (F.col("s_top") <= F.col("b_bottom"))).groupBy("page", "stem").agg(F.count_distinct("b_part").alias("parts"))
    ends = ends.join(grid.select(*BLOCK), BLOCK, "left_semi").join(parts, ["page", "stem"], "left")
    found = ends.select("page", "measure", "part", F.col("stem").alias("id"), "sp", *[F.col(f"s_{c}").alias(c) for c in BOX], "direction", F.coalesce(F.col("parts") >= 2, F.lit(False)).alias("cross_staff"))
    side = F.when(F.col("direction") == "up", F.col("low")).otherwise(F.col("high"))
    links = met.join(found.select("page", "measure", F.col("id").alias("stem"), "direction"), ["page", "measure", "stem"]).where(side.isNotNull())
    return found, links.select("page", "measure", "stem", "head")


def free_end(direction: Column = None, prefix: str = "") -> Column:
    d = F.col(f"{prefix}direction") if direction is None else direction
    return F.when(d == "up", F.col(f"{prefix}top")).otherwise(F.col(f"{prefix}bottom"))


def arpeggi(waves: DataFrame, heads: DataFrame, grid: DataFrame) -> DataFrame:
    """Columns of narrow tall wavy pieces (dx <= 0.55 sp, gap <= 1 sp) of at least 2 sp, with two or more heads right of them within 3 units. waves: wavy boolean.
    -> page, measure, column, box, pieces (their ids), heads."""
    w = on_grid(waves, grid).where("wavy").withColumn("node", F.concat_ws(":", "page", "measure", F.lpad(F.col("id").cast("string"), 12, "0")))
    o = w.select("page", "measure", F.col("node").alias("o"), *[F.col(c).alias(f"o_{c}") for c in BOX])
    near = (F.abs(F.col("left") + F.col("right") - F.col("o_left") - F.col("o_right")) / 2 <= 0.55 * F.col("sp")) & (geo.interval_gap(F.col("top"), F.col("bottom"), F.col("o_top"), F.col("o_bottom")) <= F.col("sp"))
    pairs = w.join(o, ["page", "measure"]).where((F.col("node") == F.col("o")) | ((F.col("node") < F.col("o")) & near))
    columns = w.join(iterate.components(pairs.select(F.col("node").alias("a"), F.col("o").alias("b"))).withColumnRenamed("label", "column"), "node")
    columns = columns.groupBy("page", "measure", "column").agg(F.first("sp").alias("sp"), F.avg("lx").alias("x"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.array_sort(F.collect_list("id")).alias("pieces")).where("bottom - top >= 2 * sp")
    h = heads.select("page", "measure", F.col("id").alias("head"), F.col("lx").alias("hx"), F.col("ly").alias("hy"))
    met = columns.join(h, ["page", "measure"]).where((F.col("hx") - F.col("x")).between(-0.45, 3.0))
    return met.groupBy("page", "measure", "column", *BOX, "pieces").agg(F.array_sort(F.collect_list("head")).alias("heads")).where("size(heads) >= 2")


def ends_of_outline(prims: DataFrame, share: float, least: float) -> DataFrame:
    """prims (points: array of (x, y), box, sp) with low0, high0, n0 and low1, high1, n1: the heights of the outline in a band at its left and at its right end, and the points
    there. A band is ``share`` of the width, ``least`` sp at least."""
    band = F.greatest((F.col("right") - F.col("left")) * share, F.col("sp") * least)
    here = {"0": lambda p: p["x"] <= F.col("left") + band, "1": lambda p: p["x"] >= F.col("right") - band}
    out = prims
    for k, inside in here.items():
        out = out.withColumn(f"__y{k}", F.transform(F.filter("points", inside), lambda p: p["y"]))
        out = out.withColumns({f"low{k}": F.array_min(f"__y{k}"), f"high{k}": F.array_max(f"__y{k}"), f"n{k}": F.size(f"__y{k}")}).drop(f"__y{k}")
    return out


def space_of(prims: DataFrame, grid: DataFrame) -> DataFrame:
    """prims with sp: of their own block, or the mean of their measure's."""
    own = grid.select(*BLOCK, ((F.col("bottom") - F.col("top")) / 4).alias("own_sp"))
    return prims.join(own, BLOCK, "left").join(measure_space(grid).withColumnRenamed("sp", "mean_sp"), ["page", "measure"]).withColumn("sp", F.coalesce("own_sp", "mean_sp")).drop("own_sp", "mean_sp")


def beam_strips(prims: DataFrame, grid: DataFrame) -> DataFrame:
    """Strips that may be beams, with their centre line (x0, y0, x1, y1) and sp. prims: page, part (or null), measure, id, box, points. An outline of four points or more, 0.75 sp wide, 0.12 to 0.70 sp thick in
    the mean of its ends, one end at most 2.2 times as thick as the other."""
    p = ends_of_outline(space_of(prims, grid), 0.14, 0.08)
    a, b, sp = F.col("high0") - F.col("low0"), F.col("high1") - F.col("low1"), F.col("sp")
    good = (F.size("points") >= 4) & (F.col("right") - F.col("left") >= F.greatest(0.75 * sp, F.lit(1e-9))) & (F.col("bottom") - F.col("top") > 1e-9) & (F.col("n0") >= 2) & (F.col("n1") >= 2)
    good = good & ((a + b) / 2).between(0.12 * sp, 0.70 * sp) & (F.greatest(a, b) <= 2.2 * F.greatest(F.least(a, b), F.lit(1e-9)))
    return p.where(good).select("page", "measure", "id", "sp", F.col("left").alias("x0"), ((F.col("low0") + F.col("high0")) / 2).alias("y0"), F.col("right").alias("x1"), ((F.col("low1") + F.col("high1")) / 2).alias("y1"))


def beams(strips: DataFrame, stems_: DataFrame, links: DataFrame, heads: DataFrame, one_by_one: bool = False) -> DataFrame:
    """strips: page, measure, id, sp, x0, y0, x1, y1 (centre line). A strip touches the stems between its ends that it meets in height (0.28 sp in x, 0.38 sp in y), and must pass all their heads on the free
    side by 0.08 sp. Level 1: its ends are at the free ends of two different stems. Level n: all stems that it touches have level n - 1, and one of its ends is near a stem.
    All strips that qualify at once share a level, so those under the first have level 2; with ``one_by_one`` each stem takes only the strip nearest its tip in a turn, which
    numbers them from the tips on. Goes on until a turn adds nothing. -> page, measure, beam, stem, level."""
    m = ["page", "measure"]
    xt, yt = 0.28 * F.col("sp"), 0.38 * F.col("sp")
    sx = (F.col("left") + F.col("right")) / 2
    head = links.join(heads.select(*m, F.col("id").alias("head"), F.col("top").alias("h_top"), F.col("bottom").alias("h_bottom")), [*m, "head"]).groupBy(*m, "stem").agg(F.min("h_top").alias("h_top"), F.max("h_bottom").alias("h_bottom"))
    s = stems_.select(*m, F.col("part").alias("s_part"), F.col("id").alias("stem"), sx.alias("sx"), F.col("left").alias("s_left"), "top", "bottom", free_end().alias("tip"), "direction").join(head, [*m, "stem"], "left")
    both = strips.withColumnRenamed("id", "beam").join(s, m).withColumn("y", geo.line_at(F.col("sx"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    touches = F.col("sx").between(F.col("x0") - xt, F.col("x1") + xt) & F.col("y").between(F.col("top") - yt, F.col("bottom") + yt)
    at_tip = lambda k: (F.abs(F.col("sx") - F.col(f"x{k}")) <= xt) & (F.abs(F.col("tip") - F.col(f"y{k}")) <= yt)
    at_any = lambda k: (F.abs(F.col("sx") - F.col(f"x{k}")) <= xt) & F.col(f"y{k}").between(F.col("top") - yt, F.col("bottom") + yt)
    gap = lambda k: F.sqrt(F.pow(F.col("sx") - F.col(f"x{k}"), 2) + F.pow(F.col("tip") - F.col(f"y{k}"), 2))
    clear = 0.08 * F.col("sp")
    passes = F.when(F.col("direction") == "up", F.col("y") < F.col("h_top") - clear).otherwise(F.col("y") > F.col("h_bottom") + clear)
    both = both.withColumns({"touches": touches, "tip0": at_tip(0), "tip1": at_tip(1), "near": at_any(0) | at_any(1), "passes": F.coalesce(passes, F.lit(True)), "gap0": gap(0), "gap1": gap(1), "depth": F.abs(F.col("y") - F.col("tip"))})
    met = iterate.cut(both.where("touches or tip0 or tip1").select(*m, "beam", "stem", "s_part", "s_left", "top", "touches", "tip0", "tip1", "near", "passes", "gap0", "gap1", "depth"))
    order = lambda k: F.struct(f"gap{k}", "s_part", "s_left", "top", "stem")
    first = met.groupBy(*m, "beam").agg(F.min(F.when(F.col("tip0"), order(0)))["stem"].alias("a"))
    last = met.join(first.where("a is not null"), [*m, "beam"]).groupBy(*m, "beam", "a").agg(F.min(F.when(F.col("tip1") & (F.col("stem") != F.col("a")), order(1)))["stem"].alias("b")).where("b is not null")
    of = met.join(last, [*m, "beam"]).where(F.col("touches") | F.col("stem").isin(F.col("a"), F.col("b")))
    good = of.groupBy(*m, "beam").agg(F.bool_and("passes").alias("ok")).where("ok").drop("ok")
    known = iterate.cut(of.join(good, [*m, "beam"], "left_semi").select(*m, "beam", "stem", F.lit(1).alias("level")))
    out, n = known, 1
    while not known.isEmpty():
        n += 1
        held = known.select(*m, "stem", F.lit(True).alias("held")).distinct()
        rest = met.where("touches").join(out.select(*m, "beam").distinct(), [*m, "beam"], "left_anti").join(held, [*m, "stem"], "left")
        good = rest.groupBy(*m, "beam").agg(F.bool_and(F.coalesce("held", F.lit(False)) & F.col("passes")).alias("all"), F.bool_or("near").alias("end"), F.min("depth").alias("nearest")).where("all and end")
        pick = rest.join(good.select(*m, "beam", "nearest"), [*m, "beam"])
        if one_by_one:
            turn = F.dense_rank().over(Window.partitionBy(*m, "stem").orderBy("nearest", "beam"))
            late = pick.withColumn("turn", turn).where("turn > 1").select(*m, "beam").distinct()
            pick = pick.join(late, [*m, "beam"], "left_anti")
        known = iterate.cut(pick.select(*m, "beam", "stem", F.lit(n).alias("level")))
        out = out.unionByName(known)
    return out


def flags(symbols: DataFrame, stems_: DataFrame, beamed: DataFrame) -> DataFrame:
    """The best flag per stem without a beam: within 1.25 sp of the free end, wide and high enough, its direction that of the stem. label such as flag8thUp."""
    s = stems_.join(beamed.select("page", "measure", F.col("stem").alias("id")).distinct(), ["page", "measure", "id"], "left_anti")
    s = s.select("page", "measure", F.col("id").alias("stem"), "sp", ((F.col("left") + F.col("right")) / 2).alias("sx"), (F.col("right") - F.col("left")).alias("sw"), free_end().alias("tip"), "direction")
    f = symbols.withColumns({"denominator": F.regexp_extract("label", r"^flag(\d+)th(Up|Down)$", 1).try_cast("int"), "turn": F.lower(F.regexp_extract("label", r"^flag(\d+)th(Up|Down)$", 2))}).where("denominator is not null")
    gap = F.sqrt(F.pow(geo.interval_gap(F.col("sx"), F.col("sx"), F.col("left"), F.col("right")), 2) + F.pow(geo.interval_gap(F.col("tip"), F.col("tip"), F.col("top"), F.col("bottom")), 2))
    r = geo.Rect.of()
    met = f.join(s, ["page", "measure"]).where((gap <= 1.25 * F.col("sp")) & (F.col("turn") == F.col("direction")) & (r.width >= F.greatest(2 * F.col("sw"), 0.12 * F.col("sp"))) & (r.height >= 0.20 * F.col("sp")))
    best = met.groupBy("page", "measure", "stem").agg(F.max_by(F.struct("id", "denominator", "confidence"), F.struct("confidence", -F.col("id"))).alias("f"))
    return best.select("page", "measure", "stem", F.col("f.id").alias("flag"), "f.denominator", "f.confidence")


def arc_shapes(prims: DataFrame, grid: DataFrame, least_width: float | None = None, most_thickness: float | None = None, least_curvature: float | None = None, most_ratio: float | None = None) -> DataFrame:
    """Outlines as arcs: their ends (x0, y0, x1, y1), sp, and in sp width, thickness of both ends (t0, t1) and curvature. Outlines have six points or more, two of them in
    each of the bands at the ends and in the middle. The four gates (customary values 0.90, 0.55, 0.16 and 3) are off unless given."""
    p = ends_of_outline(space_of(prims, grid), 0.12, 0.06)
    centre, half = (F.col("left") + F.col("right")) / 2, F.greatest((F.col("right") - F.col("left")) * 0.06, 0.05 * F.col("sp"))
    p = p.withColumn("__mid", F.transform(F.filter("points", lambda q: F.abs(q["x"] - centre) <= half), lambda q: q["y"]))
    p = p.where((F.size("points") >= 6) & (F.col("right") - F.col("left") > 1e-9) & (F.col("bottom") - F.col("top") > 1e-9) & (F.col("n0") >= 2) & (F.col("n1") >= 2) & (F.size("__mid") >= 2))
    y0, y1, mid = (F.col("low0") + F.col("high0")) / 2, (F.col("low1") + F.col("high1")) / 2, (F.array_min("__mid") + F.array_max("__mid")) / 2
    sp, a, b = F.col("sp"), F.col("high0") - F.col("low0"), F.col("high1") - F.col("low1")
    p = p.select("page", "measure", "id", "sp", F.col("left").alias("x0"), y0.alias("y0"), F.col("right").alias("x1"), y1.alias("y1"), ((F.col("right") - F.col("left")) / sp).alias("width"), (a / sp).alias("t0"), (b / sp).alias("t1"), (F.abs(mid - (y0 + y1) / 2) / sp).alias("curvature"))
    gates = [(least_width, F.col("width") >= F.lit(least_width)), (most_thickness, F.greatest("t0", "t1") <= F.lit(most_thickness)), (least_curvature, F.col("curvature") >= F.lit(least_curvature)), (most_ratio, F.greatest("t0", "t1") <= F.greatest(F.least("t0", "t1"), F.lit(1e-9)) * F.lit(most_ratio))]
    for value, gate in gates:
        p = p.where(gate) if value is not None else p
    return p


def arcs(shapes: DataFrame, heads: DataFrame, stems_: DataFrame) -> DataFrame:
    """shapes: page, measure, id, sp, x0, y0, x1, y1 (ends). Longer than 2 sp; each end within 2 sp of a head's box, or of either end of a stem, on the page, of different ones: the nearest at the left with the nearest other at
    the right, else the next at the left. Two heads win over two stems; of equal rounded ends the widest is kept. -> page, measure, id, start_key, stop_key."""
    unit = F.col("sp")
    long = shapes.where(F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2)) >= 2 * unit).select("page", "measure", "id", "sp", "x0", "y0", "x1", "y1")
    h = heads.select("page", F.lit(0).alias("rank"), F.col("id").alias("object"), *[F.col(c).alias(f"o_{c}") for c in BOX])
    cx = (F.col("left") + F.col("right")) / 2
    s = stems_.select("page", F.lit(1).alias("rank"), F.col("id").alias("object"), cx.alias("o_left"), F.col("top").alias("o_top"), cx.alias("o_right"), F.col("bottom").alias("o_bottom"))
    met = long.join(h.unionByName(s), "page")

    def far(x: str, y: str) -> Column:
        dx, dy = geo.interval_gap(F.col(x), F.col(x), F.col("o_left"), F.col("o_right")), geo.interval_gap(F.col(y), F.col(y), F.col("o_top"), F.col("o_bottom"))
        return F.sqrt(dx * dx + F.when(F.col("rank") == 0, dy * dy).otherwise(F.pow(F.least(F.abs(F.col(y) - F.col("o_top")), F.abs(F.col(y) - F.col("o_bottom"))), 2)))

    key = ["page", "id", "rank"]
    end = lambda k: met.withColumn("d", far(f"x{k}", f"y{k}")).where(F.col("d") <= 2 * unit)
    left = end(0).select(*key, "measure", "x0", "y0", "x1", "y1", F.col("d").alias("d0"), F.col("object").alias("a"))
    pairs = left.join(end(1).select(*key, F.col("d").alias("d1"), F.col("object").alias("b")), key).where("a <> b")
    best = pairs.groupBy("page", "id", "measure", "x0", "y0", "x1", "y1").agg(F.min(F.struct("rank", "d0", "a", "d1", "b")).alias("e"))
    rounded = [fn.half_even(F.col(c), 1).alias(f"k_{c}") for c in ("x0", "y0", "x1", "y1")]
    keyed = best.select("page", "measure", "id", "e.*", (F.col("x1") - F.col("x0")).alias("width"), *rounded)
    n = F.row_number().over(Window.partitionBy("page", "k_x0", "k_y0", "k_x1", "k_y1").orderBy(F.desc("width"), "id"))
    name = lambda c: F.concat(F.when(F.col("rank") == 0, "note:").otherwise("stem:"), F.col(c))
    return keyed.withColumn("n", n).where("n = 1").select("page", "measure", "id", name("a").alias("start_key"), name("b").alias("stop_key"))


ACCIDENTALS = ("sharp", "flat", "natural", "doubleSharp", "doubleFlat")


def meets(a: dict, b: dict) -> bool:
    """Boxes that touch."""
    return a["right"] >= b["left"] and a["left"] <= b["right"] and a["bottom"] >= b["top"] and a["top"] <= b["bottom"]


def found_accidentals(symbols: list[dict], heads: list[dict], clefs_: list[dict], least: float) -> list[tuple[int, str, int | None]]:
    """(id, label, head or None) of a block. Boxes are top, bottom, ...; x, y and lt, lb are logical centre, top and bottom."""
    known: dict[int, dict] = {}
    sure = lambda s: s["label"] in ACCIDENTALS and s["confidence"] >= least
    at_clef = lambda s: any(meets(s, c) for c in clefs_)
    off = lambda s, y: max(s["lt"] - y, y - s["lb"], 0.0)
    lanes: list[list[dict]] = []
    for s in sorted(symbols, key=lambda s: (s["y"], s["id"])):
        lane = next((x for x in lanes if abs(sum(t["y"] for t in x) / len(x) - s["y"]) <= 0.55), None)
        if lane is None:
            lanes.append(lane := [])
        lane.append(s)
    by_x = lambda s: (s["x"], s["id"])
    for lane in lanes:
        known |= {s["id"]: s for s in itertools.takewhile(sure, (s for s in sorted(lane, key=by_x) if not at_clef(s)))}
    for h in sorted(heads, key=by_x):
        left = sorted((s for s in symbols if s["x"] < h["x"] and off(s, h["y"]) <= 1.0 and s["id"] not in known), key=by_x, reverse=True)
        known |= {s["id"]: s for s in itertools.takewhile(lambda s: sure(s) and not at_clef(s), left)}
    out = []
    for s in sorted(known.values(), key=by_x):
        anchor = s["lb"] - 1.0 if s["label"] in ("flat", "doubleFlat") else s["y"]
        exact = lambda h, anchor=anchor: round(h["y"]) == round(anchor)
        near = [h for h in heads if 0 < h["x"] - s["x"] <= 8 and (exact(h) or abs(h["y"] - anchor) <= 0.65)]
        near.sort(key=lambda h: (not exact(h), abs(h["y"] - anchor), h["x"], h["id"]))
        free = (h for h in near if not any(s["x"] < t["x"] < h["x"] and t["id"] not in known and off(t, h["y"]) <= 0.75 and not meets(t, s) and not meets(t, h) for t in symbols))
        out.append((s["id"], s["label"], next((h["id"] for h in free), None)))
    return out


def accidentals(symbols: DataFrame, heads: DataFrame, clefs_: DataFrame, grid: DataFrame, least: float = 0.70) -> DataFrame:
    """Symbols of 1.5 to 7 half spaces are tried in chains only: along each lane of like height (0.55) from the left, clefs passed over, and from each head leftwards within a half space of its row;
    a chain ends at the first that is no accidental. Each takes the head within 8 units right of it, in its row or within 0.65, own row and nearest row first,
    unless a symbol that is no accidental stands between them in that row. Flats stand one half space above their lower edge. head is null where none is free. -> page, part, measure, id, label, head."""
    schema = "page string, part int, measure int, id long, label string, head long"
    s = on_grid(symbols, grid).where(((F.col("bottom") - F.col("top")) / (F.col("sp") / 2)).between(1.5, 7) & F.col("lx").isNotNull())
    edge = lambda c: ((F.col(c) - F.col("block_top")) / (F.col("sp") / 2)).alias({"top": "lt", "bottom": "lb"}[c])
    none = F.lit(None).cast("double")
    rows = s.select(*BLOCK, F.lit(0).alias("kind"), "id", "label", "confidence", F.col("lx").alias("x"), F.col("ly").alias("y"), edge("top"), edge("bottom"), *BOX)
    rows = rows.unionByName(heads.select(*BLOCK, F.lit(1).alias("kind"), "id", F.lit("").alias("label"), none.alias("confidence"), F.col("lx").alias("x"), F.col("ly").alias("y"), none.alias("lt"), none.alias("lb"), *BOX).where("x is not null"))
    rows = rows.unionByName(clefs_.select(*BLOCK, F.lit(2).alias("kind"), "id", F.lit("").alias("label"), none.alias("confidence"), none.alias("x"), none.alias("y"), none.alias("lt"), none.alias("lb"), *BOX))

    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        of = [g[g["kind"] == k].to_dict("records") for k in range(3)]
        out = [(*key, *row) for row in found_accidentals(*of, least)]
        return pd.DataFrame(out, columns=["page", "part", "measure", "id", "label", "head"]).astype({"head": "Int64"})

    return rows.groupBy(*BLOCK).applyInPandas(run, schema)


def rests(symbols: DataFrame, grid: DataFrame, claimed: DataFrame) -> DataFrame:
    """Rest symbols near the staff or a claimed object (2 sp), in their own block or else the vertically nearest of the measure."""
    s = exclude_claimed(symbols, claimed).where(F.lower("label").startswith("rest"))
    g = grid.select("page", "measure", F.col("part").alias("g_part"), *[F.col(c).alias(f"b_{c}") for c in BOX])
    gap = geo.interval_gap(F.col("top"), F.col("bottom"), F.col("b_top"), F.col("b_bottom"))
    placed = s.join(g, ["page", "measure"]).groupBy("page", "measure", "id", "label", "confidence", *BOX).agg(F.min_by(F.struct(F.col("g_part").alias("part"), gap.alias("gap"), ((F.col("b_bottom") - F.col("b_top")) / 4).alias("sp")), F.struct((~F.col("g_part").eqNullSafe(F.col("part"))).alias("o"), gap.alias("g"), "g_part")).alias("b"))
    c = claimed.select("page", *[F.col(x).alias(f"c_{x}") for x in BOX])
    near = placed.join(c, "page", "left").groupBy("page", "id").agg(F.min(F.when(F.col("c_left").isNotNull(), geo.rect_distance(geo.Rect.of(), geo.Rect.of("c_")))).alias("d"))
    return placed.join(near, ["page", "id"]).where((F.col("b.gap") <= 2 * F.col("b.sp")) | (F.coalesce("d", F.lit(1e9)) <= 2 * F.col("b.sp"))).select("page", "b.part", "measure", "id", "label", "confidence", *BOX)


def dots(small: DataFrame, heads: DataFrame, rests_: DataFrame, grid: DataFrame) -> DataFrame:
    """Round small pieces (0.06 to 0.55 sp, circularity of their points >= 0.64), at most 0.35 of a head's area and 0.72 of its width and height, matched one to one with a head or rest left of
    them: 0 < dx < 4 units, dy <= 0.70 to its row or a row beside it, score dx + 1.75 dy, then the left one first. small: points, box."""
    r = geo.Rect.of()
    d = on_grid(small, grid).where((r.width / F.col("sp")).between(0.06, 0.55) & (r.height / F.col("sp")).between(0.06, 0.55) & (r.width / r.height).between(0.55, 1.80) & (F.size("points") >= 4) & (geo.circularity(F.col("points")) >= 0.64))
    d = d.select(*BLOCK, F.col("id").alias("dot"), F.col("left").alias("dot_left"), "lx", "ly", r.width.alias("w"), r.height.alias("h"))
    of = lambda df, note: on_grid(df.select(*BLOCK, "id", *BOX), grid).select(*BLOCK, F.col("id").alias("target"), F.col("lx").alias("tx"), F.col("ly").alias("ty"), r.width.alias("tw"), r.height.alias("th"), F.lit(note).alias("note"))
    dx = F.col("lx") - F.col("tx")
    dy = F.least(*[F.abs(F.col("ly") - F.col("ty") - k) for k in (-1, 0, 1)])
    smaller = (F.col("w") * F.col("h") <= 0.35 * F.col("tw") * F.col("th")) & (F.col("w") <= 0.72 * F.col("tw")) & (F.col("h") <= 0.72 * F.col("th"))
    pairs = d.join(of(heads, True).unionByName(of(rests_, False)), BLOCK).where((dx > 0) & (dx < 4) & (dy <= 0.70) & (~F.col("note") | smaller))
    return iterate.greedy_match(pairs, BLOCK, "dot", "target", F.struct((dx + 1.75 * dy).alias("score"), "dot_left")).withColumn("score", F.col("score.score"))


def resolve(symbols: DataFrame, blocks_: DataFrame, supported: list[tuple[int, int]]) -> dict[str, DataFrame]:
    """The chain over classified symbols in its fixed order: meter, grid, clef, ledger, head, stem, arpeggio, beam, flag, arc, accidental, rest, dot. What a pass recognizes is
    claimed: later passes do not see it, and a rest counts as near it. symbols: page, id, part (null for what spans parts), measure, box, points, label, confidence, hole."""
    out: dict[str, DataFrame] = {}
    no_meter = blocks_.withColumns({"beats": F.lit(None).cast("int"), "beat_value": F.lit(None).cast("int"), "units": F.lit(None).cast("int")})
    out["meters"] = compound_meters(symbols, no_meter, supported)
    grid = out["grid"] = logical_grid(blocks_, out["meters"])
    claimed = symbols.where("false").select("page", *BOX)
    rest = symbols

    def claim(found: DataFrame) -> DataFrame:
        """found, whose boxes are taken."""
        nonlocal claimed, rest
        claimed = iterate.cut(claimed.unionByName(found.select("page", *BOX)))
        rest = iterate.cut(exclude_claimed(rest, found.select("page", *BOX)))
        return found

    def claim_pieces(found: DataFrame, piece: str) -> DataFrame:
        """found, which takes the symbols of the ids ``piece``."""
        claim(rest.join(found.select("page", F.col(piece).alias("id")).distinct(), ["page", "id"], "left_semi"))
        return found

    claim(out["meters"])
    out["clefs"] = claim(iterate.cut(clefs(rest, grid)))
    out["ledgers"] = claim(iterate.cut(ledgers(rest.where("label = 'line'").drop("label"), grid)))
    out["heads"] = claim(iterate.cut(noteheads(rest.where("label = 'oval'"), grid, out["clefs"], out["ledgers"])))
    stems_, links = stems(rest.where("label = 'stem'"), out["heads"], grid)
    out["stems"], out["stem_heads"] = claim(iterate.cut(stems_)), links
    out["arpeggi"] = iterate.cut(arpeggi(rest.where("label = 'wave'").withColumn("wavy", F.lit(True)), out["heads"], grid))
    claim_pieces(out["arpeggi"].select("page", F.explode("pieces").alias("piece")), "piece")
    out["beams"] = claim_pieces(beams(beam_strips(rest.where("label = 'strip'"), grid), out["stems"], links, out["heads"]), "beam")
    out["flags"] = claim_pieces(iterate.cut(flags(rest, out["stems"], out["beams"])), "flag")
    out["arcs"] = claim_pieces(iterate.cut(arcs(arc_shapes(rest.where("label = 'arc'"), grid), out["heads"], out["stems"])), "id")
    out["accidentals"] = claim_pieces(iterate.cut(accidentals(rest, out["heads"], out["clefs"], grid)), "id")
    out["rests"] = claim(iterate.cut(rests(rest, grid, claimed)))
    out["dots"] = dots(rest.where("label = 'dot'"), out["heads"], out["rests"], grid)
    return out
