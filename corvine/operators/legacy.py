"""Second generation of resolvers: passes over recognized events of a page and over the notes of written measures.

events: page, id, staff, x, y, kind, and where known stem_x, stem_top, stem_bottom, direction, duration, denominator. staves: page, staff, left, right,
centre, sp. contours: page, id, box, points_n. Each pass returns rows or columns of its own and leaves its input alone; thresholds are in staff
spaces. Notes of measures: page (or path), part, measure_pos, pos, voice, staff, onset, quarters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import scalar as fn
from . import grouped, iterate
from . import windows as win

MEASURE = ["page", "part", "measure_pos"]


def first_per(df: DataFrame, keys: list, order: list) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def nearest_staff(points: DataFrame, staves: DataFrame, margin: float, most: float) -> DataFrame:
    """points with staff, centre, sp of the staff of least |y - centre| whose x range, widened by ``margin`` sp, holds the point."""
    s = staves.select("page", F.col("staff").alias("staff"), F.col("left").alias("s_left"), F.col("right").alias("s_right"), "centre", "sp")
    d = F.abs(F.col("y") - F.col("centre"))
    met = points.drop("staff", "centre", "sp").join(s, "page").where(F.col("x").between(F.col("s_left") - margin * F.col("sp"), F.col("s_right") + margin * F.col("sp")) & (d <= most * F.col("sp")))
    return first_per(met, ["page", "id"], [d, "staff"]).drop("s_left", "s_right")


def vertical_edges(segments: DataFrame, existing: DataFrame, sp: float) -> DataFrame:
    """Upright edges at the left or right end of wide path contours, without those that an existing line has at nearly the same place.
    segments: page, id, n, x1, y1, x2, y2, left, right (of the contour)."""
    x, dy = (F.col("x1") + F.col("x2")) / 2, F.abs(F.col("y2") - F.col("y1"))
    e = segments.where((F.col("right") - F.col("left") >= 1.35 * sp) & dy.between(sp, 11 * sp) & (F.abs(F.col("x2") - F.col("x1")) <= F.greatest(F.lit(0.08 * sp), 0.08 * dy)) & (F.least(x - F.col("left"), F.col("right") - x) <= 0.28 * sp))
    e = e.select("page", "id", "n", x.alias("x"), F.least("y1", "y2").alias("top"), F.greatest("y1", "y2").alias("bottom"))
    o = existing.select("page", F.col("x").alias("o_x"), F.col("top").alias("o_top"), F.col("bottom").alias("o_bottom"))
    same = lambda p: (F.abs(F.col("x") - F.col(f"{p}_x")) <= 0.10 * sp) & (F.abs(F.col("top") - F.col(f"{p}_top")) <= 0.25 * sp) & (F.abs(F.col("bottom") - F.col(f"{p}_bottom")) <= 0.25 * sp)
    e = e.join(o.withColumnRenamed("page", "o_page"), (F.col("page") == F.col("o_page")) & same("o"), "left_anti")
    q = e.select(F.col("page").alias("q_page"), F.col("id").alias("q_id"), F.col("n").alias("q_n"), F.col("x").alias("q_x"), F.col("top").alias("q_top"), F.col("bottom").alias("q_bottom"))
    return e.join(q, (F.col("page") == F.col("q_page")) & (F.struct("q_id", "q_n") < F.struct("id", "n")) & same("q"), "left_anti")


def four_flips_iou(a: Column, b: Column) -> Column:
    """The best overlap of an 8 x 8 mask with another over no, left-right, top-bottom and both flips."""
    sideways = fn.flip_byte_rows(b)
    rows = lambda m: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(F.call_function("shiftleft", F.call_function("shiftrightunsigned", m, i * 8).bitwiseAND(F.lit(255).cast("long")), (F.lit(7) - i) * 8)))
    return F.greatest(*[fn.mask_iou(a, m) for m in (b, sideways, rows(b), rows(sideways))])


def correct_kinds(symbols: DataFrame) -> DataFrame:
    """First rule wins: a hollow head, a small black one, an unknown filled one with a stem, a 3 in the meter's place.
    symbols: kind, hollow, scale, filled, has_stem, in_meter_slot, looks_like_three."""
    kind = F.coalesce(F.when(F.col("hollow") & F.col("kind").isin("unknown", "black"), F.lit("half")), F.when((F.col("kind") == "unknown") & F.col("scale").between(0.42, 0.82), F.lit("grace-black")), F.when((F.col("kind") == "unknown") & F.col("filled") & F.col("has_stem"), F.lit("black")), F.when(F.col("in_meter_slot") & F.col("looks_like_three"), F.lit("digit-3")), F.col("kind"))
    return symbols.withColumn("kind", kind)


def recover_clefs(staves: DataFrame, events: DataFrame, candidates: DataFrame) -> DataFrame:
    """Staves without a clef take the leftmost, then best candidate from .8 sp left to 4.5 sp right of the staff's start and 4 sp up or down."""
    bare = staves.join(events.where("kind like 'clef%'").select("page", "staff").distinct(), ["page", "staff"], "left_anti")
    c = candidates.select("page", "id", "x", "y", "kind", "score")
    met = bare.join(c, "page").where(((F.col("x") - F.col("left")) / F.col("sp")).between(-0.8, 4.5) & (F.abs(F.col("y") - F.col("centre")) <= 4 * F.col("sp")) & F.col("kind").isin("clef-treble", "clef-bass"))
    return first_per(met, ["page", "staff"], ["x", F.desc("score"), "id"]).select("page", "staff", "id", "kind")


def painted_positions(events: DataFrame, instances: DataFrame, sp: float) -> DataFrame:
    """X of a head becomes that of the nearest painted instance of its source within 1.6 sp each way."""
    i = instances.select("page", "source", F.col("id").alias("i_id"), F.col("x").alias("i_x"), F.col("y").alias("i_y"))
    dx, dy = (F.col("i_x") - F.col("x")) / (1.6 * sp), (F.col("i_y") - F.col("y")) / (1.6 * sp)
    near = first_per(events.join(i, ["page", "source"]).where((F.abs(dx) <= 1) & (F.abs(dy) <= 1)), ["page", "id"], [dx * dx + dy * dy, "i_id"]).select("page", "id", "i_x")
    return events.join(near, ["page", "id"], "left").withColumn("x", F.coalesce("i_x", "x")).drop("i_x")


def quarter_rests(contours: DataFrame, staves: DataFrame, rests: DataFrame) -> DataFrame:
    """Single contours of 250 to 430 points and a rest's size, at the height nearest to -1.8 sp, none where a rest is within .4 sp."""
    r = geo.Rect.of()
    c = contours.withColumns({"x": (F.col("left") + F.col("right")) / 2, "y": (F.col("top") + F.col("bottom")) / 2})
    c = nearest_staff(c, staves, 1.0, 5.0)
    delta = (F.col("y") - F.col("centre")) / F.col("sp")
    good = c.where(F.col("points_n").between(250, 430) & (r.width / F.col("sp")).between(0.80, 1.55) & (r.height / F.col("sp")).between(2.25, 2.95) & delta.between(-5, 2.5)).withColumn("miss", F.abs(delta + 1.8))
    o = rests.select("page", "staff", F.col("x").alias("r_x"))
    return good.join(o, (good["page"] == o["page"]) & (good["staff"] == o["staff"]) & (F.abs(F.col("x") - F.col("r_x")) <= 0.4 * F.col("sp")), "left_anti").select("page", "staff", "id", "x", "miss")


def long_stems(heads: DataFrame, lines: DataFrame, sp: float) -> DataFrame:
    """Heads without a stem and lines of 7 to 11 sp: dx within 1.12 sp, the nearer end within .90 sp; nearer by dx, then by gap. Top end: down."""
    l = lines.where((F.col("bottom") - F.col("top")).between(7 * sp, 11 * sp)).select("page", F.col("id").alias("line"), F.col("x").alias("l_x"), F.col("top").alias("l_top"), F.col("bottom").alias("l_bottom"))  # noqa: E741
    dx = F.abs(F.col("l_x") - F.col("x"))
    high, low = F.abs(F.col("y") - F.col("l_top")), F.abs(F.col("y") - F.col("l_bottom"))
    met = heads.where("stem_x is null").select("page", "id", "x", "y").join(l, "page").where((dx <= 1.12 * sp) & (F.least(high, low) <= 0.90 * sp))
    return first_per(met, ["page", "id"], [dx, F.least(high, low), "line"]).select("page", "id", "line", F.when(high < low, "down").otherwise("up").alias("direction"))


def shared_stems(heads: DataFrame, lines: DataFrame, sp: float) -> DataFrame:
    """Where two or more lines stand within .08 sp of the nearest axis, the one of the smallest end gap (.90 sp at most)."""
    l = lines.select("page", F.col("id").alias("line"), F.col("x").alias("l_x"), F.col("top").alias("l_top"), F.col("bottom").alias("l_bottom"))  # noqa: E741
    met = heads.select("page", "id", "x", "y").join(l, "page").withColumns({"dx": F.abs(F.col("l_x") - F.col("x")), "gap": F.least(F.abs(F.col("y") - F.col("l_top")), F.abs(F.col("y") - F.col("l_bottom")))}).where(F.col("dx") <= 1.12 * sp)
    w = Window.partitionBy("page", "id")
    near = met.where(F.col("dx") <= 1e9).withColumn("least", F.min("dx").over(w)).where(F.col("dx") - F.col("least") <= 0.08 * sp).withColumn("n", F.count("*").over(w)).where("n >= 2")
    return first_per(near.where(F.col("gap") <= 0.90 * sp), ["page", "id"], ["gap", "line"]).select("page", "id", "line")


def drop_stemless_hollow(heads: DataFrame, staves: DataFrame, lines: DataFrame) -> DataFrame:
    """Without half heads that have no stem, lie over .75 sp outside the staff and have no ledger line."""
    h = nearest_staff(heads, staves, 2.0, 12.0)
    out = h.where((F.col("kind") == "half") & F.col("stem_x").isNull() & (F.abs(F.col("y") - F.col("centre")) - 2 * F.col("sp") > 0.75 * F.col("sp")))
    l = lines.where("right > left").select(F.col("page").alias("l_page"), *[F.col(c).alias(f"l_{c}") for c in ("left", "top", "right", "bottom")])  # noqa: E741
    ledger = (F.col("page") == F.col("l_page")) & (F.col("l_right") - F.col("l_left") >= 0.75 * F.col("sp")) & (F.col("l_bottom") - F.col("l_top") <= 0.18 * F.col("sp")) & (F.abs((F.col("l_top") + F.col("l_bottom")) / 2 - F.col("y")) <= 0.38 * F.col("sp")) & F.col("x").between(F.col("l_left"), F.col("l_right"))
    return heads.join(out.join(l, ledger, "left_anti").select("page", "id"), ["page", "id"], "left_anti")


def copy_stems(heads: DataFrame, sp: float) -> DataFrame:
    """Half heads without a stem take it from one with, within 1.30 sp in x and 6 sp in y, if three or more heads spread over 1.5 sp."""
    half = heads.where("kind = 'half'")
    a = half.where("stem_x is not null").select("page", "staff", F.col("id").alias("anchor"), F.col("x").alias("a_x"), F.col("y").alias("a_y"), F.col("stem_x").alias("a_stem"), F.col("direction").alias("a_dir"))
    met = half.where("stem_x is null").select("page", "staff", "id", "x", "y").join(a, ["page", "staff"]).where((F.abs(F.col("x") - F.col("a_x")) <= 1.30 * sp) & (F.abs(F.col("y") - F.col("a_y")) <= 6 * sp))
    w = Window.partitionBy("page", "anchor")
    big = met.withColumns({"n": F.count("*").over(w) + 1, "spread": F.greatest(F.max("y").over(w), "a_y") - F.least(F.min("y").over(w), "a_y")}).where((F.col("n") >= 3) & (F.col("spread") >= 1.5 * sp))
    return first_per(big, ["page", "id"], [F.abs(F.col("x") - F.col("a_x")), "anchor"]).select("page", "id", F.col("a_stem").alias("stem_x"), F.col("a_dir").alias("direction"))


def cross_staff_chords(heads: DataFrame, lines: DataFrame, staves: DataFrame, sp: float) -> DataFrame:
    """A line of 8 to 18 sp that reaches from the upper of two staves to the lower (1.4 sp) binds the heads of both within .82 sp of it, if the mean of their distances is .82 sp at most and the least
    .70; the stem goes up if it stands right of their mean x (summed in order of id, since lines stand at a mean and sums differ in their last digit). staves: page, staff (1 above 2), top, bottom. -> page, line, heads, direction."""
    s = staves.groupBy("page").agg(F.max(F.when(F.col("staff") == 1, F.col("bottom"))).alias("upper"), F.max(F.when(F.col("staff") == 2, F.col("top"))).alias("lower"))
    l = lines.where((F.col("bottom") - F.col("top")).between(8 * sp, 18 * sp)).join(s, "page").where((F.col("top") <= F.col("upper") + 1.4 * sp) & (F.col("bottom") >= F.col("lower") - 1.4 * sp))  # noqa: E741
    l = l.select("page", F.col("id").alias("line"), F.col("x").alias("l_x"))  # noqa: E741
    away = F.abs(F.col("x") - F.col("l_x"))
    met = heads.select("page", "staff", "id", "x").join(l, "page").where(away <= 0.82 * sp)
    g = met.groupBy("page", "line", "l_x").agg(F.count_distinct("staff").alias("staves"), F.avg(away).alias("mean"), F.min(away).alias("least"), F.array_sort(F.collect_list(F.struct("id", "x"))).alias("met"))
    total = F.aggregate("met", F.lit(0.0), lambda s, h: s + h["x"])
    g = g.withColumns({"heads": F.transform("met", lambda h: h["id"]), "x": total / F.size("met")})
    return g.where((F.col("staves") >= 2) & (F.col("mean") <= 0.82 * sp) & (F.col("least") <= 0.70 * sp)).select("page", "line", "heads", F.when(F.col("l_x") >= F.col("x"), "up").otherwise("down").alias("direction"))


def strip_members(stems: DataFrame, strips: DataFrame, sp: float, margin: float = 0.25, gap: float = 0.50, groups: int = 2) -> DataFrame:
    """Stems that a sloped strip covers, with begin, continue, end by rounded stem x and the number of strips per stem (1 to 4) as level.
    strips: page, id, x0, y0, x1, y1, points_n, area. Strips have 3 to 14 points and are long against their thickness (area over diagonal)."""
    wide, diagonal = F.col("x1") - F.col("x0"), F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    s = strips.where(F.col("points_n").between(3, 14) & (wide >= 1.15 * sp) & (F.col("area") / diagonal).between(0.05 * sp, 0.62 * sp) & (wide / F.greatest(F.abs(F.col("y1") - F.col("y0")), F.lit(1e-9)) >= 1.45)).withColumnRenamed("id", "strip")
    met = stems.select("page", "id", "stem_x", "stem_top", "stem_bottom").join(s, "page").where(F.col("stem_x").between(F.col("x0") - margin * sp, F.col("x1") + margin * sp))
    met = met.withColumn("y", geo.line_at(F.col("stem_x"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).where(geo.interval_gap(F.col("y"), F.col("y"), F.col("stem_top"), F.col("stem_bottom")) <= gap * sp)
    met = met.withColumn("slot", fn.half_even(F.col("stem_x") / (0.12 * sp)))
    n, last = F.dense_rank().over(Window.partitionBy("page", "strip").orderBy("slot")), F.size(F.collect_set("slot").over(Window.partitionBy("page", "strip")))
    placed = met.withColumns({"n": n, "of": last}).where(F.col("of") >= groups)
    placed = placed.withColumns({"position": F.when(F.col("n") == 1, "begin").when(F.col("n") == F.col("of"), "end").otherwise("continue"), "level": F.least(F.count("*").over(Window.partitionBy("page", "id")), F.lit(4)).cast("int")})
    return placed.select("page", "strip", "id", "position", "level")


def attach_marks(marks: DataFrame, notes: DataFrame, staves: DataFrame, dx: float = 5.25, dy: float = 1.35) -> DataFrame:
    """Marks of a staff within 4 sp to the nearest note right of them; of several on one note the last by x counts. page, id (note), mark, kind."""
    m = nearest_staff(marks, staves, 1.0, 4.0).select("page", "staff", "sp", F.col("id").alias("mark"), "kind", F.col("x").alias("m_x"), F.col("y").alias("m_y"))
    n = notes.select("page", "staff", "id", "x", "y")
    right, off = F.col("x") - F.col("m_x"), F.abs(F.col("y") - F.col("m_y"))
    met = m.join(n, ["page", "staff"]).where((right > 0) & (right <= dx * F.col("sp")) & (off <= dy * F.col("sp")))
    own = first_per(met, ["page", "mark"], [fn.half_even(off / (F.col("sp") / 2)), off, right, "id"])
    return first_per(own, ["page", "id"], [F.desc("m_x"), F.desc("mark")]).select("page", "id", "mark", "kind")


def attach_dots(dots: DataFrame, events: DataFrame, sp: float, dx: float = 3.0, dy: float = 1.25) -> DataFrame:
    """A dot to the nearest note or rest left of it; an event is dotted once, its integer duration times 3/2."""
    d = dots.select("page", F.col("id").alias("dot"), F.col("x").alias("d_x"), F.col("y").alias("d_y"))
    left, off = F.col("d_x") - F.col("x"), F.abs(F.col("d_y") - F.col("y"))
    met = events.join(d, "page").where((left > 0) & (left <= dx * sp) & (off <= dy * sp))
    one = first_per(first_per(met, ["page", "dot"], [off, left, "id"]), ["page", "id"], ["d_x", "dot"])
    return one.select("page", "id", "dot", F.floor(F.col("duration") * 3 / 2).cast("int").alias("duration"))


def pair_arcs(arcs: DataFrame, notes: DataFrame, sp: float, dx: float = 2.25, most: float = 10.0) -> DataFrame:
    """Start and end notes near an arc's ends, score the sum of dx + .9 dy; pairs of one pitch go first by 1.65. Each arc gets one pair and each pair one arc,
    in order of score. kind is tie for neighbours of one pitch, else slur; slurs are numbered per page."""
    n = notes.select("page", "staff", "id", "x", "y", "pitch")
    near = lambda px, py, name: arcs.join(n, "page").withColumn("c", F.abs(F.col("x") - F.col(px)) + 0.9 * F.abs(F.col("y") - F.col(py))).where(F.abs(F.col("x") - F.col(px)) <= dx * sp).select("page", F.col("arc"), F.col("id").alias(name), F.col("pitch").alias(f"{name}_pitch"), F.col("x").alias(f"{name}_x"), F.col("c").alias(f"{name}_c"))
    pairs = near("x0", "y0", "a").join(near("x1", "y1", "b"), ["page", "arc"]).where("a <> b and a_x < b_x").withColumn("same", F.col("a_pitch") == F.col("b_pitch"))
    pairs = pairs.withColumn("score", (F.col("a_c") + F.col("b_c")) / sp - F.when(F.col("same"), 1.65).otherwise(0.0)).where(F.col("score") <= most).withColumn("pair", F.concat_ws(":", "a", "b"))
    taken = iterate.greedy_match(pairs, ["page"], "arc", "pair", F.col("score")).select("page", "arc", "pair")
    out = taken.join(pairs, ["page", "arc", "pair"]).withColumn("kind", F.when(F.col("same"), "tie").otherwise("slur"))
    return out.withColumn("number", F.when(~F.col("same"), F.row_number().over(Window.partitionBy("page", "kind").orderBy("a_x", "arc")))).select("page", "arc", "a", "b", "kind", "number")


def arched(points: Column, sp: float) -> Column:
    """The middle stands above both ends by .15 sp."""
    n = F.size(points)
    y = lambda i: F.get(points, i)["y"]
    return (F.least(y(F.lit(0)), y(n - 1)) - y(F.floor(n / 2).cast("int"))) >= 0.15 * sp


def chord_rhythm(notes: DataFrame, tolerance: float) -> DataFrame:
    """In clusters by x per staff and direction, dots and shortest type of any member hold for all."""
    c = grouped.running_mean_clusters(notes, ["page", "staff", "direction"], "x", tolerance, "id", "cluster")
    w = Window.partitionBy("page", "staff", "direction", "cluster")
    return c.withColumns({"dots": F.max("dots").over(w), "denominator": F.max("denominator").over(w)}).drop("cluster")


def standalone_flags(heads: DataFrame, flags: DataFrame, sp: float) -> DataFrame:
    """One unused flag per stem (rounded stem x) on the right side of its free end, score .70 |dx| + |dy|, greedy."""
    s = heads.where("stem_x is not null and not beamed").withColumn("slot", fn.half_even(F.col("stem_x") / (0.20 * sp)))
    s = first_per(s, ["page", "staff", "slot"], ["id"]).select("page", "id", "stem_x", F.when(F.col("direction") == "up", F.col("stem_top")).otherwise(F.col("stem_bottom")).alias("tip"), F.when(F.col("direction") == "up", 1).otherwise(-1).alias("turn"))
    f = flags.select("page", F.col("id").alias("flag"), F.col("x").alias("f_x"), F.col("y").alias("f_y"))
    dx, dy = (F.col("f_x") - F.col("stem_x")) / sp, (F.col("f_y") - F.col("tip")) * F.col("turn") / sp
    pairs = s.join(f, "page").where(dx.between(-0.30, 1.85) & dy.between(0.10, 2.55))
    return iterate.greedy_match(pairs, ["page"], "id", "flag", 0.70 * F.abs(dx) + F.abs(dy)).select("page", "id", "flag")


def cross_system_ties(arcs: DataFrame, notes: DataFrame, sp: float) -> DataFrame:
    """An arc open at the right edge of a system, from a note, to the same pitch at the left of the next. arcs: page, system, arc, note, opens boolean."""
    o = arcs.where("opens").join(notes.select("page", F.col("id").alias("note"), "staff", "pitch"), ["page", "note"])
    n = notes.select("page", (F.col("system") - 1).alias("system"), "staff", "pitch", F.col("id").alias("to"), "x", "system_left").where(F.col("x") - F.col("system_left") <= 8 * sp)
    return first_per(o.join(n, ["page", "system", "staff", "pitch"]), ["page", "arc"], ["x", "to"]).select("page", "arc", "note", "to")


#: Dynamics, longest first.
DYNAMICS = ("sfpp", "ffff", "pppp", "fff", "ppp", "sfz", "sfp", "sf", "fz", "ff", "pp", "mf", "mp", "fp", "f", "p")


def dynamics(symbols: DataFrame, staves: DataFrame) -> DataFrame:
    """Dynamics between neighbouring staves: the first known token in the name, or a three-point hairpin by which side has two points; the same one
    within .35 sp is told once. symbols: page, id, x, y, kind, width, height, tip_left (null unless a hairpin)."""
    w = Window.partitionBy("page").orderBy("centre")
    gaps = staves.withColumns({"next": F.lead("centre").over(w)}).where(F.col("next") - F.col("centre") >= 2 * F.col("sp")).select("page", F.col("staff").alias("above"), "centre", "next", "sp")
    s = symbols.join(gaps, "page").where(F.col("y").between(F.col("centre") + 2 * F.col("sp"), F.col("next") - 2 * F.col("sp")))
    letters = F.regexp_extract(F.lower("kind"), "^dynamic[-_ ]?(" + "|".join(DYNAMICS) + ")$", 1)
    hairpin = F.when(F.col("tip_left").isNotNull() & (F.col("width") / F.col("sp")).between(5.5, 20) & (F.col("height") / F.col("sp")).between(0.65, 2.5), F.when(F.col("tip_left"), "crescendo").otherwise("diminuendo"))
    s = s.withColumn("value", F.coalesce(hairpin, F.nullif(letters, F.lit("")))).where("value is not null")
    order = Window.partitionBy("page", "above", "value").orderBy("x", "id")
    return s.withColumn("__d", F.col("x") - F.lag("x").over(order)).where(F.col("__d").isNull() | (F.col("__d") > 0.35 * F.col("sp"))).select("page", "above", "id", "value", "x")


def terminal_dynamics(wedges: DataFrame, shapes: DataFrame, known: DataFrame, sp: float) -> DataFrame:
    """An unknown glyph of mp's size just behind a wedge, unless a dynamic stands there."""
    s = shapes.where((F.col("width") / sp).between(3.25, 3.70) & (F.col("height") / sp).between(1.35, 1.72)).select("page", "id", "x")
    met = wedges.select("page", F.col("id").alias("wedge"), "end_x").join(s, "page").where(((F.col("x") - F.col("end_x")) / sp).between(-0.5, 3.0))
    k = known.select(F.col("page").alias("k_page"), F.col("x").alias("k_x"))
    return first_per(met.join(k, (F.col("page") == F.col("k_page")) & (F.abs(F.col("x") - F.col("k_x")) <= 0.5 * sp), "left_anti"), ["page", "wedge"], ["x", "id"]).select("page", "wedge", "id", F.lit("mp").alias("value"))


def zip_by_order(xml: DataFrame, events: DataFrame, keys: list) -> DataFrame:
    """The n-th written note of a staff meets the n-th recognized event."""
    x = xml.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")))
    e = events.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("x", "id")))
    return x.join(e.select(*keys, "n", "id", "x", "y", "direction"), [*keys, "n"])


def grace_notes(heads: DataFrame, widths: tuple = (0.42, 0.82), heights: tuple = (0.36, 0.72)) -> DataFrame:
    """Heads scaled down against the page's median head."""
    w = Window.partitionBy("page")
    m = heads.withColumns({"mw": F.percentile("width", 0.5).over(w), "mh": F.percentile("height", 0.5).over(w)})
    return m.withColumn("grace", (F.col("width") / F.col("mw")).between(*widths) & (F.col("height") / F.col("mh")).between(*heights)).drop("mw", "mh")


def tie_sides(ties: DataFrame, arcs: DataFrame, sp: float, most: float = 4.0) -> DataFrame:
    """A tie lies above or below its note as its nearest arc does."""
    a = arcs.select("page", "arc", "x0", "y0")
    cost = (F.abs(F.col("x") - F.col("x0")) + F.abs(F.col("y") - F.col("y0"))) / sp
    return first_per(ties.join(a, "page").where(cost <= most), ["page", "id"], [cost, "arc"]).select("page", "id", F.when(F.col("y0") < F.col("y"), "above").otherwise("below").alias("side"))


def ornaments(contours: DataFrame, staves: DataFrame, notes: DataFrame) -> DataFrame:
    """Dense flat contours 2 to 10.5 sp above a staff, to the nearest note within 1.75 sp in x."""
    r = geo.Rect.of()
    c = nearest_staff(contours.withColumns({"x": (F.col("left") + F.col("right")) / 2, "y": (F.col("top") + F.col("bottom")) / 2}), staves, 1.0, 13.0)
    up = (F.col("centre") - 2 * F.col("sp") - F.col("y")) / F.col("sp")
    c = c.where((F.col("points_n") >= 120) & up.between(2, 10.5) & (r.width / F.col("sp")).between(1.8, 3.2) & (r.height / F.col("sp")).between(0.55, 1.35) & (r.width / r.height >= 1.8)).select("page", "staff", "sp", F.col("id").alias("ornament"), F.col("x").alias("o_x"))
    d = F.abs(F.col("x") - F.col("o_x"))
    return first_per(c.join(notes.select("page", "staff", "id", "x"), ["page", "staff"]).where(d <= 1.75 * F.col("sp")), ["page", "ornament"], [d, "id"]).select("page", "ornament", "id")


def rename(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Values under other names."""
    return df.replace(names, subset=[column])


def lanes_by_direction(notes: DataFrame) -> DataFrame:
    """Measures whose stems point both ways at one onset or x get two lanes, up 1 and down 2; others stay in 1."""
    w = Window.partitionBy(*MEASURE, "staff")
    both = (F.count_if(F.col("direction") == "up").over(w) > 0) & (F.count_if(F.col("direction") == "down").over(w) > 0)
    return notes.withColumn("lane", F.when(both & (F.col("direction") == "down"), 2).otherwise(1))


def lane_validity(notes: DataFrame, capacity: Column) -> DataFrame:
    """Lanes with a negative onset, an overlap or too long a sum are invalid. One row per lane, its last note: one sort tells all, and no table of lanes is held beside it."""
    w = Window.partitionBy(*MEASURE, "lane").orderBy("onset", "pos", "quarters")
    whole, end = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), F.col("onset") + F.col("quarters")
    n = notes.select(*MEASURE, "lane", "onset", "pos", "quarters", capacity.alias("__capacity"))
    n = n.withColumns({"__over": F.col("onset") < F.lag(end).over(w) - 1e-9, "__next": F.lead(F.lit(True)).over(w)})
    n = n.withColumns({"__over": F.max("__over").over(whole), "__low": F.min("onset").over(whole), "__high": F.max(end).over(whole), "__capacity": F.first("__capacity").over(whole)}).where("__next is null")
    return n.select(*MEASURE, "lane", (~(F.coalesce("__over", F.lit(False)) | (F.col("__low") < 0) | (F.col("__high") > F.col("__capacity") + 1e-9))).alias("valid"))


def predicted_onsets(notes: DataFrame, grid: float) -> DataFrame:
    """Onsets by interpolation in x between anchors (notes of valid lanes), snapped to the grid, not below 0."""
    n = win.interpolate(notes.withColumn("__anchor", F.when(F.col("valid"), F.col("onset"))), MEASURE, ["x", "pos"], "x", "__anchor", "predicted")
    return n.withColumn("predicted", F.greatest(F.lit(0.0), fn.half_even(F.col("predicted") / grid) * grid)).drop("__anchor")


def full_measure_rests(lanes: DataFrame) -> DataFrame:
    """Rests of a lane with one sounding unit go to the lane whose total with them equals what sounds, the nearest in x.
    lanes: MEASURE, lane, sounding, sustained, rest_total, total, x."""
    a = lanes.where("sounding = 1 and rest_total > 0").select(*MEASURE, F.col("lane").alias("from"), "sustained", "rest_total", F.col("x").alias("f_x"))
    b = lanes.select(*MEASURE, F.col("lane").alias("to"), "total", "x")
    met = a.join(b, MEASURE).where((F.col("from") != F.col("to")) & (F.abs(F.col("total") + F.col("rest_total") - F.col("sustained")) < 1e-6))
    return first_per(met, [*MEASURE, "from"], [F.abs(F.col("x") - F.col("f_x")), "to"]).select(*MEASURE, "from", "to")


def delayed_onsets(notes: DataFrame, gap: float = 18.0, reach: float = 12.0) -> DataFrame:
    """A lane that starts at 0 but well right of the measure's first note, and does not fill it, starts with the nearest foreign note's onset."""
    first = first_per(notes, [*MEASURE, "lane"], ["x", "pos"])
    total = notes.groupBy(*MEASURE, "lane").agg(F.sum("quarters").alias("total"))
    w = Window.partitionBy(*MEASURE)
    late = first.join(total, [*MEASURE, "lane"]).withColumns({"x0": F.min("x").over(w), "most": F.max("total").over(w)}).where((F.col("onset") == 0) & (F.col("x") - F.col("x0") >= gap) & (F.col("total") < F.col("most")))
    o = notes.select(*MEASURE, F.col("lane").alias("o_lane"), F.col("x").alias("o_x"), F.col("onset").alias("forward"), F.col("pos").alias("o_pos"))
    d = F.abs(F.col("o_x") - F.col("x"))
    return first_per(late.join(o, MEASURE).where((F.col("lane") != F.col("o_lane")) & (d <= reach)), [*MEASURE, "lane"], [d, "o_pos"]).where("forward > 0").select(*MEASURE, "lane", "forward")


def lane_offsets(notes: DataFrame) -> DataFrame:
    """A later lane starts after the durations that the ruling lane (longest, then leftmost) has left of its first x."""
    l = notes.groupBy(*MEASURE, "lane").agg(F.sum("quarters").alias("total"), F.min("x").alias("x0"))  # noqa: E741
    ruler = first_per(l, MEASURE, [F.desc("total"), "x0", "lane"]).select(*MEASURE, F.col("lane").alias("ruler"))
    r = notes.join(ruler, MEASURE).where("lane = ruler and not coalesce(is_chord, false)").select(*MEASURE, F.col("x").alias("r_x"), F.col("quarters").alias("q"))
    others = l.join(ruler, MEASURE).where("lane <> ruler")
    return others.join(r, MEASURE).groupBy(*MEASURE, "lane").agg(F.sum(F.when(F.col("r_x") < F.col("x0") - 1e-6, F.col("q")).otherwise(0.0)).alias("offset"))


def system_breaks(measures: DataFrame) -> DataFrame:
    """Measures with a clef of their own, but the first, start a system."""
    return measures.withColumn("new_system", F.col("has_clef") & (F.col("measure_pos") > F.min("measure_pos").over(Window.partitionBy("page", "part"))))


def secondary_beams(notes: DataFrame) -> DataFrame:
    """Per voice and staff and for levels 2 up: continue, end or begin by the neighbours in the beam, alone a hook forward (first) or backward. notes: level, beam (id of the run)."""
    w = Window.partitionBy(*MEASURE, "voice", "staff", "beam").orderBy("pos")
    n = notes.where("beam is not null").withColumns({"before": F.coalesce(F.lag("level").over(w), F.lit(0)), "after": F.coalesce(F.lead("level").over(w), F.lit(0)), "first": F.row_number().over(w) == 1})
    n = n.where("level >= 2").withColumn("number", F.explode(F.expr("sequence(2, level)")))
    b, a = F.col("before") >= F.col("number"), F.col("after") >= F.col("number")
    return n.withColumn("mark", F.when(b & a, "continue").when(b, "end").when(a, "begin").when(F.col("first"), "forward hook").otherwise("backward hook")).select(*MEASURE, "pos", "number", "mark")


def tuplets(runs: DataFrame) -> DataFrame:
    """Runs (actual notes, written and required duration) whose ratio is .45 to 1.60 without being 1 are normal = actual * required / written in the time of, if that is whole within .08."""
    normal = F.col("actual") * F.col("required") / F.col("written")
    ratio = F.col("required") / F.col("written")
    t = runs.withColumn("normal", fn.half_even(normal).cast("int"))
    return t.where(ratio.between(0.45, 1.60) & (F.abs(normal - F.col("normal")) <= 0.08) & (F.col("normal") != F.col("actual")) & (F.col("normal") > 0))


def restore_cross_staff(notes: DataFrame) -> DataFrame:
    """Tagged members of a chord over two staves or more: one per source, the least voice, the anchor on the highest staff number with the lowest pitch; the others are chord tones."""
    one = first_per(notes.where("tag is not null"), [*MEASURE, "tag", "source"], ["pos"])
    w = Window.partitionBy(*MEASURE, "tag")
    good = one.withColumns({"staves": F.size(F.collect_set("staff").over(w)), "voice": F.min("voice").over(w)}).where("staves >= 2")
    order = Window.partitionBy(*MEASURE, "tag").orderBy(F.desc("staff"), "pitch_index", "pos")
    return good.withColumn("is_chord", F.row_number().over(order) > 1).drop("staves")


def accidental_state(notes: DataFrame) -> DataFrame:
    """The alteration in force per staff, step and octave within a measure, by onset; a sign of its own comes first at equal onset."""
    order = ["onset", F.col("accidental").isNull(), "pos"]
    own = F.when(F.col("accidental").isNotNull(), F.col("alter"))
    return win.carry_forward(notes, [*MEASURE, "staff", "step", "octave"], order, own, "in_force").withColumn("in_force", F.coalesce("in_force", F.col("key_alter")))


def place_marks(marks: DataFrame, segments: DataFrame) -> DataFrame:
    """The measure that holds a mark's x (the last one closed) and the offset in it, rounded and clamped. segments: page, measure_pos, left, right, duration, is_last."""
    s = segments.select("page", "measure_pos", F.col("left").alias("s_left"), F.col("right").alias("s_right"), "duration", "is_last")
    inside = (F.col("x") >= F.col("s_left")) & ((F.col("x") < F.col("s_right")) | (F.col("is_last") & (F.col("x") <= F.col("s_right"))))
    offset = fn.clamp(fn.half_even((F.col("x") - F.col("s_left")) / (F.col("s_right") - F.col("s_left")) * F.col("duration")), F.lit(0.0), F.col("duration").cast("double"))
    return marks.join(s, "page").where(inside).withColumn("offset", offset.cast("int")).drop("s_left", "s_right", "duration", "is_last")


def sustain_brackets(contours: DataFrame, staves: DataFrame) -> DataFrame:
    """Brackets 5 to 42 sp wide, at most 2.8 sp tall, 1.2 to 9 sp under the lower staff, mostly one long run (run_share), with a hook or 8 sp; doubles by rounded ends go."""
    low = staves.groupBy("page").agg(F.max_by(F.struct("centre", "sp"), "centre").alias("s")).select("page", "s.*")
    r = geo.Rect.of()
    c = contours.join(low, "page").where((r.width / F.col("sp")).between(5, 42) & (r.height <= 2.8 * F.col("sp")) & ((F.col("top") - F.col("centre") - 2 * F.col("sp")) / F.col("sp")).between(1.2, 9) & (F.col("run_share") >= 0.55) & (F.col("hook") | (r.width >= 8 * F.col("sp"))))
    return first_per(c.withColumns({"k0": fn.half_even(F.col("left") / 4), "k1": fn.half_even(F.col("right") / 4)}), ["page", "k0", "k1"], ["id"]).select("page", "id", "left", "right")


def final_barlines(columns: DataFrame) -> DataFrame:
    """The last two bar columns of a system stand .35 to 1.25 sp apart."""
    w = Window.partitionBy("page", "system").orderBy(F.desc("x"))
    c = columns.withColumns({"n": F.row_number().over(w), "d": F.col("x") - F.lead("x").over(w)}).where("n = 1")
    return c.select("page", "system", F.coalesce((F.col("d") / F.col("sp")).between(0.35, 1.25), F.lit(False)).alias("final"))


def drop_trailing(measures: DataFrame) -> DataFrame:
    """A last measure of bars, prints and attributes alone goes, its right bar to the one before. measures: notes, others, right_bar."""
    w = Window.partitionBy("page", "part").orderBy(F.desc("measure_pos"))
    m = measures.withColumns({"n": F.row_number().over(w), "of": F.count("*").over(Window.partitionBy("page", "part"))})
    empty = (F.col("notes") == 0) & (F.col("others") == 0) & (F.col("n") == 1) & (F.col("of") > 1)
    m = m.withColumns({"gone": empty, "given": F.lag(F.when(empty, F.col("right_bar"))).over(w)})
    return m.where("not gone").withColumn("right_bar", F.coalesce("given", "right_bar")).drop("n", "of", "gone", "given")


def join_pages(measures: DataFrame, page_order: DataFrame) -> DataFrame:
    """Pages in order one after the other: measures numbered on, meters inherited, the first measure of a page starts a system. page_order: page, n."""
    m = measures.join(page_order, "page")
    m = win.carry_forward(m, ["part"], ["n", "measure_pos"], "meter", "meter")
    number = F.row_number().over(Window.partitionBy("part").orderBy("n", "measure_pos"))
    first = F.row_number().over(Window.partitionBy("part", "n").orderBy("measure_pos")) == 1
    return m.withColumns({"number": number, "new_system": F.col("new_system") | (first & (F.col("n") > 1))})


def drop_repeated(df: DataFrame, keys: list, order: list, column: str) -> DataFrame:
    """A value equal to the one in force becomes null; nulls between do not count."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__was", F.last(column, ignorenulls=True).over(w)).withColumn(column, F.when(~F.col(column).eqNullSafe(F.col("__was")), F.col(column))).drop("__was")


#: Equal lines of a row that are told apart at once.
COPIES = 1024


def place_text(texts: DataFrame, measures: DataFrame) -> DataFrame:
    """Sidecar texts to measures by number; the first one at the left of staff 1 is the tempo line; longer ones end after 25 characters. Every text comes with every measure of its
    number: lines that are equal so far are counted, meet the measures once, and are then repeated as often as there were texts. So rows of a measure come in runs of equal lines, which a
    file keeps as runs. Both sides are small until then, so the number of tasks is that of the session and not one by their bytes."""
    tempo = (F.col("measure") == 1) & (F.col("staff") == 1) & (F.col("align") == "L")
    cut_off = texts.where("measure is not null").select("measure", "staff", "align", F.substring("value", 1, 25).alias("text"), F.when(tempo, "tempo").otherwise("words").alias("kind"))
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = cut_off.groupBy("measure", "staff", "align", "text", "kind").agg(F.count("*").alias("n")).repartition(tasks, "measure")
    numbered = measures.select("page", "measure_pos", F.col("number").alias("measure")).where("measure is not null").repartition(tasks, "measure")
    met = numbered.join(lines.hint("merge"), "measure")
    some = met.withColumn("before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    each = some.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES), F.col("n") - F.col("before")))))
    return each.select("page", "measure_pos", "staff", "align", "text", "kind")


def playback_tempo(bpm: Column, denominator: Column) -> Column:
    return bpm * 4 / denominator


def recover_meter(measures: DataFrame) -> DataFrame:
    """Per part the most frequent filled length, the longest of equals, if the floored 90th percentile is not below it."""
    h = measures.groupBy("page", "part", "filled").agg(F.count("*").alias("n"))
    best = first_per(h, ["page", "part"], [F.desc("n"), F.desc("filled")]).select("page", "part", F.col("filled").alias("length"))
    s = F.array_sort(F.collect_list("filled"))
    p90 = measures.groupBy("page", "part").agg(F.element_at(s, (F.floor((F.size(s) - 1) * 0.9) + 1).cast("int")).alias("p90"))
    return best.join(p90, ["page", "part"]).where(F.col("p90") >= F.col("length"))
