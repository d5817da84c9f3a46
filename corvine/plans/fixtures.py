"""Recognition, rules, glyphs, sources and comparison on small fixtures that are known by construction."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import glyph, iterate, quality, rules, score
from ..registry import query, table
from ..sources import musicxml, svg
from .relational import METERS

# A page: one system of two staves (spaces of 10), three measures of 200.
SP = 10.0


def page_lines(spark: SparkSession) -> DataFrame:
    rows = []
    for top in (100.0, 220.0):
        rows += [("p1", 700.0, 900.0, 50.0, top + SP * k, 650.0, top + SP * k) for k in range(5)]
    rows += [("p1", 700.0, 900.0, x, 100.0, x, 260.0) for x in (50.0, 250.0, 450.0)]
    rows += [("p1", 700.0, 900.0, 650.0, 102.0, 650.0, 220.0), ("p1", 700.0, 900.0, 650.0, 220.8, 650.0, 259.0)]  # one bar in two pieces, a little inside
    rows += [("p1", 700.0, 900.0, 300.0, 104.0, 300.0, 137.0), ("p1", 700.0, 900.0, 350.0, 104.0, 350.0, 260.0), ("p2", 700.0, 900.0, 0.0, 0.0, 10.0, 10.0)]
    return spark.createDataFrame(rows, "page string, page_width double, page_height double, x1 double, y1 double, x2 double, y2 double")


def page_blocks(spark: SparkSession) -> DataFrame:
    return score.blocks(score.detect_staves(page_lines(spark)))


def at(i, part, measure, x, half, w, h, label, confidence=0.9, hole=False):
    """An object by the centre of its box: x in the measure, y in half spaces below the part's top line."""
    cx, cy = 50 + 200 * (measure - 1) + x, (220.0 if part == 2 else 100.0) + half * SP / 2
    turns = [math.pi * k / 8 for k in range(16)] if label in ("oval", "dot") else [math.pi * (2 * k + 1) / 4 for k in range(4)]
    size = 0.5 if len(turns) > 4 else math.sqrt(0.5)
    points = [{"x": cx + w * size * math.cos(t), "y": cy + h * size * math.sin(t)} for t in turns]
    return ("p1", i, part, measure, cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2, label, confidence, hole, points)


SYMBOLS = "page string, id long, part int, measure int, left double, top double, right double, bottom double, label string, confidence double, hole boolean, points array<struct<x:double,y:double>>"


def page_symbols(spark: SparkSession) -> DataFrame:
    rows = [
        at(1, 1, 1, 12, 4, 24, 60, "G"), at(2, 2, 1, 12, 4, 22, 32, "F"), at(3, 1, 1, 12, 4, 23, 58, "G", 0.5),
        at(4, 1, 1, 40, 2, 14, 19, "4", 0.8), at(5, 1, 1, 40, 6, 14, 19, "4", 0.9), at(6, 2, 1, 40, 2, 14, 19, "4"), at(7, 2, 1, 40, 6, 14, 19, "4"),
        at(10, 1, 1, 80, 3, 12, 9, "oval"), at(11, 1, 1, 120, 5, 12, 9, "oval"), at(12, 1, 1, 160, 10, 12, 9, "oval", 0.9, True), at(13, 1, 2, 40, 13, 12, 9, "oval"), at(14, 2, 1, 80, 0, 12, 9, "oval"),
        at(20, 1, 1, 160, 10, 20, 1.5, "line"), at(21, 1, 2, 150, 10, 20, 1.5, "line"), at(22, 1, 2, 151, 12, 20, 1.5, "line"), at(23, 1, 2, 149, 16, 20, 1.5, "line"),
        at(30, 1, 1, 85.5, 0, 1, 30, "stem"), at(31, 1, 1, 114.5, 8, 1, 30, "stem"), at(32, 2, 1, 85.5, -3, 1, 30, "stem"),
        at(40, 1, 1, 90, -3.5, 6, 14, "flag8thUp"), at(41, 1, 1, 118, 13, 6, 14, "flag16thUp"), at(42, 1, 1, 90, -3, 6, 14, "flag32ndUp"),
        at(50, 1, 1, 68, 3, 6, 16, "sharp"), at(51, 1, 1, 108, 3.9, 6, 16, "flat"), at(52, 1, 1, 20, 3, 6, 16, "natural", 0.4),
        at(60, 2, 2, 100, 4, 12, 28, "restQuarter"), at(61, 2, 3, 100, 60, 12, 28, "restQuarter"),
        at(70, 1, 1, 92, 3, 3, 3, "dot"), at(71, 1, 1, 131, 5, 3, 3, "dot"), at(72, 1, 1, 95, 3, 3, 3, "dot"),
    ]
    return spark.createDataFrame(rows, SYMBOLS)


CHAINS: dict[str, dict[str, DataFrame]] = {}


def resolved(spark: SparkSession) -> dict[str, DataFrame]:
    """The chain's tables, made once per application."""
    app = spark.sparkContext.applicationId
    if app not in CHAINS:
        CHAINS[app] = score.resolve(page_symbols(spark), page_blocks(spark), list(METERS))
    return CHAINS[app]


def grid_of(spark: SparkSession) -> DataFrame:
    meters = spark.createDataFrame([("p1", 1, 1, 4, 4, 0.9), ("p1", 2, 1, 4, 4, 0.9)], "page string, part int, measure int, beats int, beat_value int, confidence double")
    return score.logical_grid(page_blocks(spark), meters)


@query("g04_block_assignment", """SELECT * FROM (VALUES (1, 1, 1, 'PartMeasure'), (2, 1, 1, 'PartMeasure'), (3, NULL, 1, 'Measure'), (4, NULL, 3, 'Measure')) t(id, part, measure, scope)""")
def g04b(spark, d):
    """A piece inside, one beside it, one between two blocks, one far off."""
    rows = [("p1", 1, 100.0, 95.0, 110.0, 105.0), ("p1", 2, 100.0, 85.0, 110.0, 92.0), ("p1", 3, 150.0, 130.0, 160.0, 230.0), ("p1", 4, 600.0, 400.0, 605.0, 405.0)]
    p = spark.createDataFrame(rows, "page string, id int, left double, top double, right double, bottom double")
    return score.assign_blocks(p, page_blocks(spark)).select("id", "part", "measure", "scope")


@query("g07_g08_symbols_and_ink", "SELECT * FROM (VALUES (1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 4, 4)) t(id, symbol, child)")
def g0708(spark, d):
    """The largest takes what overlaps it; its ink falls apart where boxes share under one hundredth."""
    rows = [("p1", 1, 1, 1, 0.0, 0.0, 50.0, 50.0), ("p1", 2, 1, 1, 49.0, 49.0, 60.0, 60.0), ("p1", 3, 1, 1, 40.0, 10.0, 55.0, 20.0), ("p1", 4, 1, 1, 58.0, 58.0, 70.0, 70.0)]
    p = spark.createDataFrame(rows, "page string, part int, measure int, id long, left double, top double, right double, bottom double").withColumns({"part": F.lit(1), "measure": F.lit(1)})
    p = p.withColumn("id", F.when(F.col("left") == 0, 1).when(F.col("left") == 49, 2).when(F.col("left") == 40, 3).otherwise(4).cast("long"))
    s = iterate.cut(score.group_symbols(p))
    return s.join(score.split_ink(s), ["page", "id"]).select(F.col("id").cast("int"), F.col("symbol").cast("int"), F.col("child").cast("int"))


@query("g12_ledger_ladders", "SELECT * FROM (VALUES (1, 1, 1), (1, 2, 2)) t(part, measure, depth)")
def g12l(spark, d):
    return resolved(spark)["ledgers"].select("part", "measure", F.col("depth").cast("int").alias("depth"))


@query("g22_accidentals", "SELECT * FROM (VALUES (50, 'sharp', 10), (51, 'flat', 11)) t(id, label, head)")
def g22a(spark, d):
    return resolved(spark)["accidentals"].select(F.col("id").cast("int"), "label", F.col("head").cast("int"))


@query("g16_arpeggio", "SELECT * FROM (VALUES ('10,11')) t(heads)")
def g16(spark, d):
    waves = spark.createDataFrame([("p1", 1, 1, k, 100.0, 100.0 + 12 * k, 104.0, 110.0 + 12 * k, True) for k in range(3)], "page string, part int, measure int, id long, left double, top double, right double, bottom double, wavy boolean")
    heads = spark.createDataFrame([("p1", 1, 1, 10, 10.0, 1.0), ("p1", 1, 1, 11, 10.1, 5.0), ("p1", 1, 1, 12, 20.0, 5.0)], "page string, part int, measure int, id long, lx double, ly double")
    return score.arpeggi(waves, heads, grid_of(spark)).select(F.array_join(F.col("heads").cast("array<string>"), ",").alias("heads"))


# Rules ---------------------------------------------------------------------------------------------------------------
def facts(spark: SparkSession):
    notes = [("p", 1, "a", 1, 2.0, "C4", True, None, 0), ("p", 1, "b", 1, 2.5, "E#4", True, None, 1), ("p", 1, "c", 1, 10.0, "F4", True, "sharp", 0), ("p", 1, "d", 1, 14.0, "Bb3", True, "natural", 0), ("p", 1, "e", 1, 20.0, "G4", False, None, 0), ("p", 1, "f", 1, 20.4, "C3", False, None, 0), ("p", 2, "g", 1, 1.0, "D4", False, None, 2)]
    stems = [("p", 1, "s1", 1, 2.2, "up", ["a", "b"]), ("p", 1, "s2", 1, 10.2, "up", ["c"]), ("p", 1, "s3", 1, 14.1, "up", ["d"]), ("p", 1, "s4", 1, 20.2, "up", ["e"]), ("p", 1, "s5", 1, 20.5, "down", ["f"])]
    beams = [("p", 1, "b1", 1, ["s2", "s3"]), ("p", 1, "b2", 2, ["s3"])]
    n = spark.createDataFrame(notes, "page string, measure int, key string, staff int, logical_x double, pitch string, is_filled boolean, accidental string, dot_count int")
    s = spark.createDataFrame(stems, "page string, measure int, key string, staff int, logical_x double, direction string, attached_note_keys array<string>")
    b = spark.createDataFrame(beams, "page string, measure int, id string, level int, stem_keys array<string>")
    f = spark.createDataFrame([("p", 1, "s1", 8)], "page string, measure int, stem_key string, denominator int")
    a = spark.createDataFrame([("p", 1, "x", ["a"], ["s3"]), ("p", 1, "y", ["e"], ["none"])], "page string, measure int, id string, note_keys array<string>, stem_keys array<string>")
    return n, s, b, f, a


@query("m01_to_m09_note_rules", """SELECT * FROM (VALUES ('a', 'C', 4, 0, 's1', 'a', false, 1, 1, 'eighth', '', '1start', 1), ('b', 'E', 4, 1, 's1', 'a', true, 1, 1, 'eighth', '', '', 2), ('c', 'F', 4, 1, 's2', NULL, false, 0, 1, 'eighth', '1begin', '', 3),
('d', 'B', 3, 0, 's3', NULL, false, 0, 1, '16th', '1end,2begin', '1stop', 4), ('e', 'G', 4, 0, 's4', NULL, false, 0, 1, 'half', '', '', 5), ('f', 'C', 3, 0, 's5', NULL, false, 0, 2, 'half', '', '', 6), ('g', 'D', 4, 0, NULL, NULL, false, 2, NULL, 'whole', '', '', 1))
t(key, step, octave, alter_by, stem, chord_key, is_chord, dots, voice, type, beams, slurs, place)""")
def m_all(spark, d):
    n = rules.build(*facts(spark))
    joined = lambda c, a, b: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat(x[a].cast("string"), x[b])), ","), F.lit(""))
    return n.select("key", "step", "octave", F.col("alter").alias("alter_by"), "stem", "chord_key", "is_chord", "dots", "voice", "type", joined("beams", "level", "position").alias("beams"), joined("slurs", "number", "type").alias("slurs"), "place")


@query("m11_written_order", """SELECT * FROM (VALUES ('a', 1, 0, NULL), ('b', 2, 0, NULL), ('c', 3, 24, NULL), ('d', 4, 40, NULL), ('e', 5, 48, 112), ('f', 6, 0, 64)) t(key, written, onset, backup)""")
def m11(spark, d):
    w = rules.written_order(rules.build(*facts(spark))).where("measure = 1")
    return w.select("key", "written", F.col("onset").cast("int"), F.col("backup").cast("int"))


@query("m06_duration", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'whole' WHEN 1 THEN 'half' WHEN 2 THEN 'quarter' ELSE 'eighth' END AS type, CAST(CASE p_size % 3 WHEN 0 THEN 128 // d WHEN 1 THEN (128 // d) * 3 // 2 ELSE (128 // d) * 7 // 4 END AS INTEGER) AS ticks FROM (SELECT *, CAST(power(2, p_size % 4) AS INTEGER) AS d FROM part)")
def m06(spark, d):
    p = table(spark, d, "part").withColumn("d", F.pow(F.lit(2), F.col("p_size") % 4).cast("int"))
    return p.select("p_partkey", rules.note_type(F.col("d")).alias("type"), rules.ticks(F.col("d"), F.col("p_size") % 3).alias("ticks"))


@query("m08_all_measures", "SELECT DISTINCT k FROM (SELECT user_id AS k FROM events WHERE event_type = 'error' UNION ALL SELECT user_id FROM events WHERE event_type = 'signup')")
def m08(spark, d):
    e = table(spark, d, "events").select(F.lit("p").alias("page"), F.col("user_id").alias("measure"), "event_type")
    return rules.measures(e.where("event_type = 'error'"), e.where("event_type = 'signup'")).select(F.col("measure").alias("k"))


# Glyphs --------------------------------------------------------------------------------------------------------------
def ring(points, turn=0.0, size=1.0):
    c, s = math.cos(turn), math.sin(turn)
    return [{"x": size * (c * x - s * y) + 5, "y": size * (s * x + c * y) - 3} for x, y in points]


def ellipse(a, b, n=48):
    return [(a * math.cos(2 * math.pi * k / n), b * math.sin(2 * math.pi * k / n)) for k in range(n)]


SHAPES = {"ellipse": [ellipse(2, 1)], "ring": [ellipse(2, 1), ellipse(1.2, 0.5)], "bar": [[(-3, -0.3), (3, -0.3), (3, 0.3), (-3, 0.3)]], "ell": [[(0, 0), (3, 0), (3, 1), (1, 1), (1, 4), (0, 4)]]}


def glyph_rows(spark: SparkSession, turn: float, size: float) -> DataFrame:
    return spark.createDataFrame([(n, [ring(r, turn, size) for r in rings]) for n, rings in SHAPES.items()], f"name string, rings {glyph.RINGS}")


@query("g20_glyph_classes", "SELECT * FROM (VALUES ('ellipse', 'ellipse', true), ('ring', 'ring', true), ('bar', 'bar', true), ('ell', 'ell', true)) t(name, class, accepted)")
def g20(spark, d):
    """Turned and scaled shapes find their class; fingerprints are projections of the distance grids on a fitted basis."""
    import numpy as np

    known = glyph.describe(glyph_rows(spark, 0.0, 1.0), "rings", ["sdf"]).collect()
    mean, basis = glyph.fit_pca(np.array([r["sdf"] for r in known]), 3)
    model = spark.createDataFrame([("shapes", mean.tolist(), basis.tolist(), 0.9, dict.fromkeys(SHAPES, 8.0))], "family string, mean array<double>, components array<array<double>>, ratio_threshold double, class_thresholds map<string,double>")
    refs = spark.createDataFrame([("shapes", r["name"], ((np.array(r["sdf"]) - mean) @ basis.T).tolist()) for r in known], "family string, class string, fingerprint array<double>")
    found = glyph.project(glyph.describe(glyph_rows(spark, 0.7, 3.0), "rings", ["sdf"]), "sdf", model)
    return glyph.classify(found, refs, model, "name").where("place = 1").select("name", "class", "accepted")


@query("d16_contour_hash", "SELECT 4 AS shapes, 4 AS hashes")
def d16(spark, d):
    """The same for another first point and direction."""
    turned = [(n, [list(reversed(r[3:] + r[:3])) for r in ([ring(q) for q in rings])]) for n, rings in SHAPES.items()]
    both = glyph.describe(glyph_rows(spark, 0.0, 1.0).unionByName(spark.createDataFrame(turned, f"name string, rings {glyph.RINGS}")), "rings", ["contour_hash"])
    return both.agg(F.count_distinct("name").cast("int").alias("shapes"), F.count_distinct("contour_hash").cast("int").alias("hashes"))


@query("d01_d02_fourier", "SELECT * FROM (VALUES ('ellipse', 'ellipse'), ('ring', 'ring'), ('bar', 'bar'), ('ell', 'ell')) t(name, nearest)")
def d0102(spark, d):
    """Shapes of another size and with another first point find themselves. The references are four."""
    known = glyph.describe(glyph_rows(spark, 0.0, 1.0), "rings", ["fourier"]).select(F.lit(1).alias("one"), F.col("name").alias("ref"), F.col("fourier").alias("rf"))
    found = glyph.describe(glyph_rows(spark, 0.0, 4.0), "rings", ["fourier"]).withColumn("one", F.lit(1)).join(F.broadcast(known), "one")
    return glyph.with_fourier_distance(found, "fourier", "rf", "d").groupBy("name").agg(F.min_by("ref", F.struct("d", "ref")).alias("nearest"))


# Sources and comparison ---------------------------------------------------------------------------------------------
SCORE = """<?xml version="1.0"?><!DOCTYPE score-partwise><score-partwise version="4.0"><part-list><score-part id="P1"><part-name/></score-part></part-list><part id="P1"><measure number="1">
<attributes><divisions>4</divisions><key><fifths>1</fifths></key><time><beats>4</beats><beat-type>4</beat-type></time><clef><sign>G</sign><line>2</line></clef></attributes>
<note default-x="10"><pitch><step>C</step><octave>4</octave></pitch><duration>8</duration><voice>1</voice><type>half</type></note>
<note><chord/><pitch><step>E</step><alter>-1</alter><octave>4</octave></pitch><duration>8</duration><voice>1</voice><type>half</type></note>
<note><pitch><step>D</step><octave>4</octave></pitch><duration>8</duration><voice>1</voice></note><backup><duration>16</duration></backup>
<note><rest/><duration>4</duration><voice>2</voice></note><forward><duration>4</duration></forward><note><pitch><step>F</step><octave>3</octave></pitch><duration>8</duration><voice>2</voice></note></measure>
<measure number="2"><note><pitch><step>G</step><octave>4</octave></pitch><duration>16</duration><voice>1</voice></note></measure></part></score-partwise>"""


def scores(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("a.musicxml", SCORE), ("b.musicxml", SCORE.replace("<step>D", "<step>A")), ("broken.musicxml", "<score-partwise><part>")], "path string, content string")


@query("q04_event_match_f1", "SELECT 5 AS matched, 1 AS mismatched, 0 AS missing, 0 AS extra, 0.833333 AS f1", f1="DOUBLE")
def q04(spark, d):
    """The changed note is matched in time and wrong in pitch."""
    e = iterate.cut(musicxml.timed_events(musicxml.parse_column(scores(spark), "path", "content")).withColumn("id", (F.col("measure_pos") * 1000 + F.col("pos")).cast("long")))
    pick = lambda p: e.where(F.col("path") == p).select("part", "measure", "voice", "id", "position", "step", "octave", "quarters")
    s = quality.summary(quality.match_events(pick("a.musicxml"), pick("b.musicxml"), ["part", "measure", "voice"]))
    return s.select(*[F.col(c).cast("int") for c in ("matched", "mismatched", "missing", "extra")], F.round("f1", 6).alias("f1"))


@query("q05_xml_diff", "SELECT 1 AS n")
def q05(spark, d):
    s = scores(spark)
    pair = s.groupBy(F.lit("score").alias("of")).agg(F.max_by("content", F.col("path") == "a.musicxml").alias("a"), F.max_by("content", F.col("path") == "b.musicxml").alias("b"))
    return quality.xml_diff(pair, "a", "b").select(F.size("differences").cast("int").alias("n"))


@query("q01_block_diff", """SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN a IS NULL THEN 'extra' WHEN b IS NULL THEN 'missing' ELSE 'matched' END AS verdict FROM (SELECT DISTINCT o_custkey AS a FROM orders WHERE o_orderstatus = 'F') x FULL JOIN (SELECT DISTINCT o_custkey AS b FROM orders WHERE o_totalprice > 200000) y ON a = b) GROUP BY 1""")
def q01(spark, d):
    o = table(spark, d, "orders")
    return quality.set_diff(o.where("o_orderstatus = 'F'"), o.where("o_totalprice > 200000"), ["o_custkey"]).groupBy("verdict").agg(F.count("*").alias("n"))


@query("q02_attribute_diff", """WITH a AS (SELECT l_suppkey AS k, l_quantity AS q, row_number() OVER (PARTITION BY l_suppkey, l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT l_suppkey AS k, l_quantity AS q, row_number() OVER (PARTITION BY l_suppkey, l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem WHERE l_returnflag = 'N')
SELECT CASE WHEN a.n IS NULL THEN 'extra' WHEN b.n IS NULL THEN 'missing' ELSE 'matched' END AS verdict, count(*) AS c FROM a FULL JOIN b ON a.k = b.k AND a.q = b.q AND a.n = b.n GROUP BY 1""")
def q02(spark, d):
    l = table(spark, d, "lineitem").selectExpr("l_suppkey k", "l_quantity q", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag f")  # noqa: E741
    return quality.multiset_diff(l.where("f = 'A'"), l.where("f = 'N'"), ["k", "q"], ["l_orderkey", "l_linenumber", "l_partkey"]).groupBy("verdict").agg(F.count("*").alias("c"))


SVG = '<svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink"><defs><path id="g" d="M0 0h2v2h-2z m1 1 q1 0 1 1"/></defs><g transform="translate(10,20)"><use xlink:href="#g" x="1" y="2"/><line x1="0" y1="0" x2="5" y2="0"/></g><rect x="1" y="1" width="3" height="4"/><path d="M1 1 C 1 2 3 2 3 1 S 5 0 5 1 Z"/></svg>'


@query("g25_instance_groups", "SELECT * FROM (VALUES (0, 2), (1, 2), (2, 1)) t(id, together)")
def g25(spark, d):
    c = svg.parse_column(spark.createDataFrame([("p.svg", SVG)], "path string, content string"), "path", "content")
    return svg.with_group_contours(c).where("id < 3").select("id", F.size("group_contours").cast("int").alias("together"))


@query("s18_json_rows", "SELECT json_object('oOrderkey', o_orderkey, 'oOrderstatus', o_orderstatus) AS value FROM orders", value="VARCHAR")
def s18(spark, d):
    from ..sources.text import to_json_rows

    return to_json_rows(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"))


@query("s14_json_maps", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def s14(spark, d):
    """Objects of a JSON text as rows of key and value."""
    e = table(spark, d, "events").select("event_id", F.explode(F.map_entries(F.from_json("props", "map<string,int>"))).alias("e"))
    return e.where("e.key = 'k' and e.value is not null").select("event_id", F.col("e.value").alias("k"))
