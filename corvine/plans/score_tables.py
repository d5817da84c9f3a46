"""Pages and scores that are built from the driver's tables: what a pass reads is made by SQL that both engines run, or written as SVG or MusicXML and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import iterate, quality, score
from ..registry import query
from ..sources import musicxml, svg
from .legacy_tables import duck, read, with_

#: A page for each customer: one or two systems of staves 11 spaces apart, with bars of which some are broken and some too short, a frame, and at times a last staff alone.
PAGE = "SELECT CAST(c_custkey AS STRING) AS page, c_custkey AS k, CAST(4 + c_custkey % 5 AS DOUBLE) AS sp, CAST(1 + c_custkey % 2 AS INT) AS systems, CAST(2 + c_custkey % 4 AS INT) AS bars FROM {customer}"


def digits(n: int, name: str) -> str:
    return "(" + " UNION ALL ".join(f"SELECT {i} AS {name}" for i in range(n)) + ")"


STAFF_LINES = f"SELECT page, 80 AS xa, 60 + s * 50 * sp + u * 11 * sp + i * sp AS ya, 920 AS xb, 60 + s * 50 * sp + u * 11 * sp + i * sp AS yb FROM ({PAGE}) CROSS JOIN {digits(3, 's')} CROSS JOIN {digits(2, 'u')} CROSS JOIN {digits(5, 'i')} WHERE s < systems OR s = systems AND k % 7 = 0 AND u = 0"
BAR = f"SELECT page, k, s, b, sp, systems, bars, 80 + CAST(840 AS DOUBLE) * b / bars AS x, 60 + s * 50 * sp AS top, (k + b) % 5 = 0 AS short, (k + b) % 3 = 0 AS broken FROM ({PAGE}) CROSS JOIN {digits(2, 's')} CROSS JOIN {digits(6, 'b')} WHERE s < systems AND b <= bars"
BAR_LINES = f"SELECT page, x, top, x, top + CASE WHEN broken THEN 11 WHEN short THEN 14 ELSE 15 END * sp FROM ({BAR}) UNION ALL SELECT page, x, top + CAST(1105 AS DOUBLE) / 100 * sp, x, top + CASE WHEN short THEN 14 ELSE 15 END * sp FROM ({BAR}) WHERE broken"
FRAME = f"SELECT page, 0, 1400 * i, 1000, 1400 * i FROM ({PAGE}) CROSS JOIN {digits(2, 'i')}"
DRAWN = f"SELECT page, CAST(1000 AS DOUBLE) AS page_width, CAST(1400 AS DOUBLE) AS page_height, CAST(xa AS DOUBLE) AS x1, CAST(ya AS DOUBLE) AS y1, CAST(xb AS DOUBLE) AS x2, CAST(yb AS DOUBLE) AS y2 FROM ({STAFF_LINES} UNION ALL {BAR_LINES} UNION ALL {FRAME})"
#: The systems that have two bars or more, numbered.
SYSTEMS = f"good AS (SELECT * FROM ({duck(BAR)}) WHERE NOT short), sys AS (SELECT page, s, sp, min(top) AS top, count(*) AS bars, row_number() OVER (PARTITION BY page ORDER BY s) - 1 AS n FROM good GROUP BY page, s, sp HAVING count(*) >= 2)"


def staves(spark: SparkSession, d: str) -> DataFrame:
    return score.detect_staves(read(spark, d, DRAWN))


@query("g01_staves", f"""WITH {SYSTEMS} SELECT page, n AS system, CAST(u AS BIGINT) AS staff, round(top + u * 11 * sp, 6) AS top, round(top + u * 11 * sp + 4 * sp, 6) AS bottom, CAST(bars AS INTEGER) AS bars, NULL::VARCHAR AS error FROM sys, (SELECT unnest([0, 1]) AS u)
UNION ALL SELECT page, NULL, NULL, NULL, NULL, NULL, 'no staff system' FROM ({duck(PAGE)}) WHERE page NOT IN (SELECT page FROM sys)""")
def g01(spark, d):
    return staves(spark, d).select("page", F.col("system").cast("long").alias("system"), F.col("staff").cast("long").alias("staff"), F.round("top", 6).alias("top"), F.round("bottom", 6).alias("bottom"), F.when(F.size("bars") >= 0, F.size("bars")).alias("bars"), "error")


@query("l02_staff_windows", f"WITH {SYSTEMS} SELECT page, 2 * count(*) AS staves FROM sys GROUP BY 1")
def l02(spark, d):
    return staves(spark, d).where("error is null").groupBy("page").agg(F.count("*").alias("staves"))


@query("g02_blocks", f"""WITH {SYSTEMS}, b AS (SELECT good.page, sys.n, good.x, lead(good.x) OVER (PARTITION BY good.page, good.s ORDER BY good.x) AS nx, row_number() OVER (PARTITION BY good.page, good.s ORDER BY good.x) = 1 AS first FROM good JOIN sys ON sys.page = good.page AND sys.s = good.s)
SELECT page, CAST(p AS BIGINT) AS part, CAST(row_number() OVER (PARTITION BY page, p ORDER BY n, x) AS INTEGER) AS measure, first AS starts_new_system, round(x, 6) AS "left", round(nx, 6) AS "right" FROM b, (SELECT unnest([1, 2]) AS p) WHERE nx IS NOT NULL""")
def g02(spark, d):
    return score.blocks(staves(spark, d)).select("page", F.col("part").cast("long").alias("part"), "measure", "starts_new_system", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"))


BLOCKS = "SELECT DISTINCT CAST(user_id AS STRING) AS page, CAST(p AS INT) AS part, CAST(m AS INT) AS measure, CAST(200 * m AS DOUBLE) AS left, CAST(100 * p AS DOUBLE) AS top, CAST(200 * m + 180 + 10 * m AS DOUBLE) AS right, CAST(100 * p + 40 AS DOUBLE) AS bottom FROM (SELECT DISTINCT user_id, 1 + event_id % 2 AS p, event_id % 3 AS m FROM {events})"
PIECES = "SELECT CAST(user_id AS STRING) AS page, event_id AS id, CAST(event_id * 7919 % 6000 AS DOUBLE) / 10 AS left, CAST(90 + event_id * 31 % 160 AS DOUBLE) AS top, CAST(event_id * 7919 % 6000 AS DOUBLE) / 10 + event_id * 13 % 500 AS right, CAST(90 + event_id * 31 % 160 + event_id % 5 * CASE WHEN event_id % 3 = 0 THEN 1 ELSE 40 END AS DOUBLE) + 0.5 AS bottom FROM {events}"


def quoted(text: str) -> str:
    return text.replace("AS left", 'AS "left"').replace("AS right", 'AS "right"')


@query("p08_garbage_filter", f"""{with_(b=quoted(BLOCKS), p=quoted(PIECES))}, m AS (SELECT page, quantile_cont("right" - "left", 0.5) AS w, quantile_cont(bottom - top, 0.5) AS h FROM b GROUP BY 1) SELECT id FROM p JOIN m ON p.page = m.page WHERE NOT ("right" - "left" > 1.8 * w AND bottom - top > 3 * h)""")
def p08g(spark, d):
    return score.drop_garbage(read(spark, d, PIECES), read(spark, d, BLOCKS)).select("id")


RULED = "SELECT DISTINCT CAST(user_id AS STRING) AS page, CAST(100 * p + 10 * i AS DOUBLE) AS y FROM (SELECT DISTINCT user_id, 1 + event_id % 2 AS p, event_id % 5 AS i FROM {events})"


@query("p09_staff_line_filter", f"""{with_(b=quoted(BLOCKS), p=quoted(PIECES), l=RULED)}, m AS (SELECT page, quantile_cont("right" - "left", 0.5) AS w, quantile_cont((bottom - top) / 4, 0.5) AS sp FROM b GROUP BY 1)
SELECT id FROM p JOIN m ON p.page = m.page WHERE NOT ("right" - "left" >= 1.25 * w AND bottom - top <= 0.3 * sp AND EXISTS (SELECT 1 FROM l WHERE l.page = p.page AND abs((p.top + p.bottom) / 2 - l.y) <= 0.25 * sp))""")
def p09(spark, d):
    return score.drop_staff_lines(read(spark, d, PIECES), read(spark, d, RULED), read(spark, d, BLOCKS)).select("id")


FOUND = "SELECT DISTINCT CAST(user_id AS STRING) AS page, CAST(1 + event_id % 2 AS INT) AS part, CAST(event_id % 3 AS INT) AS measure, CAST(2 + event_id % 5 AS INT) AS beats, CAST(4 AS INT) AS beat_value, CAST(event_id AS DOUBLE) / 10000 AS confidence FROM {events} WHERE event_type = 'error' AND event_id % 3 > 0"


@query("g10_grid", f"""{with_(b=quoted(BLOCKS), f=FOUND)}, x AS (SELECT page, part, measure, arg_max(beats, confidence) AS beats FROM f GROUP BY ALL), c AS (SELECT b.page, b.part, b.measure, last_value(x.beats IGNORE NULLS) OVER (PARTITION BY b.page, b.part ORDER BY b.measure ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS beats FROM b LEFT JOIN x ON b.page = x.page AND b.part = x.part AND b.measure = x.measure) SELECT *, beats * 8 AS units FROM c""")
def g10(spark, d):
    return score.logical_grid(read(spark, d, BLOCKS), read(spark, d, FOUND)).select("page", "part", "measure", "beats", "units")


DIGITS = "SELECT CAST(user_id AS STRING) AS page, event_id AS id, CAST(1 + event_id % 2 AS INT) AS part, CAST(event_id % 3 AS INT) AS measure, CAST(200 * (event_id % 3) + event_id * 7 % 190 AS DOUBLE) AS left, CAST(100 * (1 + event_id % 2) + event_id % 4 / 2 * 0 + CASE WHEN event_id % 4 < 2 THEN 1 ELSE 21 END + event_id % 3 AS DOUBLE) AS top, CAST(200 * (event_id % 3) + event_id * 7 % 190 + 12 + event_id % 5 AS DOUBLE) AS right, CAST(100 * (1 + event_id % 2) + CASE WHEN event_id % 4 < 2 THEN 1 ELSE 21 END + event_id % 3 + 9 + event_id % 11 AS DOUBLE) AS bottom, CASE WHEN event_id % 13 = 0 THEN 'G' ELSE CAST(2 + event_id * 7 % 7 AS STRING) END AS label, CAST(1 + event_id % 97 AS DOUBLE) / 100 AS confidence FROM {events}"
SUPPORTED = [(2, 4), (3, 4), (4, 4), (6, 8), (2, 2), (3, 8), (5, 4), (7, 8)]


@query("g09_meters", f"""{with_(g=quoted(DIGITS), b=quoted(BLOCKS))}, k(v, w) AS (VALUES {", ".join(map(str, SUPPORTED))}), o AS (SELECT g.*, CAST(label AS INTEGER) AS v, b."left" AS bl, b."right" AS br, ((g.top + g.bottom) / 2 - b.top) / 5 AS ly FROM g JOIN b ON g.page = b.page AND g.part = b.part AND g.measure = b.measure WHERE label <> 'G'),
p AS (SELECT t.page, t.part, t.measure, t.id, l.id AS low, t.v AS beats, l.v AS beat_value, sqrt(t.confidence * l.confidence) AS confidence, ((t."left" + t."right") / 2 - t.bl) / (t.br - t.bl) AS place FROM o t JOIN o l ON t.page = l.page AND t.part = l.part AND t.measure = l.measure AND t.ly BETWEEN 0 AND 4 AND l.ly BETWEEN 4 AND 8 JOIN k ON k.v = t.v AND k.w = l.v
WHERE greatest(least(t."right", l."right") - greatest(t."left", l."left"), 0) / least(t."right" - t."left", l."right" - l."left") >= 0.35 AND t.bottom <= l.top + 3.5 AND least(t.bottom - t.top, l.bottom - l.top) / greatest(t.bottom - t.top, l.bottom - l.top) >= 0.6)
SELECT page, part, measure, beats, beat_value, CASE WHEN place <= 0.48 THEN 'Left' WHEN place >= 0.72 THEN 'Right' ELSE 'Middle' END AS side, round(confidence, 9) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY page, part, measure ORDER BY confidence DESC, id, low) AS n FROM p) WHERE n <= 8""")
def g09(spark, d):
    none = read(spark, d, BLOCKS).withColumn("units", F.lit(None).cast("int"))
    return score.meters(read(spark, d, DIGITS), none, SUPPORTED).select("page", "part", "measure", "beats", "beat_value", "side", F.round("confidence", 9).alias("confidence"))


#: A block for each order, 40 high: its lines are a figure above, a second one that is near enough or not, one below, another below, and blots.
METER_BLOCKS = "SELECT CAST(o_orderkey AS STRING) AS page, CAST(1 AS INT) AS part, CAST(1 AS INT) AS measure, CAST(0 AS DOUBLE) AS left, CAST(0 AS DOUBLE) AS top, CAST(200 AS DOUBLE) AS right, CAST(40 AS DOUBLE) AS bottom FROM {orders}"
FIGURES = (
    "SELECT CAST(l_orderkey AS STRING) AS page, CAST(1 AS INT) AS part, CAST(1 AS INT) AS measure, CAST(l_linenumber AS BIGINT) AS id, CASE l_linenumber WHEN 1 THEN CASE WHEN p % 4 = 0 THEN '6' ELSE '1' END WHEN 2 THEN CASE p % 3 WHEN 0 THEN '2' WHEN 1 THEN '6' ELSE '9' END WHEN 3 THEN CASE q % 3 WHEN 0 THEN '4' ELSE '8' END WHEN 4 THEN '8' ELSE 'blot' END AS label, "
    "(1 + q) / CAST(64 AS DOUBLE) AS confidence, x AS left, t AS top, x + w AS right, t + 16 AS bottom FROM (SELECT l_orderkey, l_linenumber, p, q, CAST(CASE l_linenumber WHEN 1 THEN 20 WHEN 2 THEN 30 + q % 16 WHEN 3 THEN 22 + p % 7 ELSE 60 + p % 50 END AS DOUBLE) AS x, CAST(CASE WHEN l_linenumber <= 2 THEN 3 ELSE 21 END AS DOUBLE) AS t, "
    "CAST(CASE l_linenumber WHEN 1 THEN 8 WHEN 2 THEN 10 ELSE 11 END AS DOUBLE) AS w FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, CAST(min(l_quantity) AS BIGINT) AS q FROM {lineitem} GROUP BY 1, 2) u) v"
)
COMPOUND = [(6, 8), (9, 8), (12, 8), (1, 8), (2, 4), (6, 4)]


@query("g09_compound_meters", f"""{with_(f=quoted(FIGURES))}, k(v, w) AS (VALUES {", ".join(map(str, COMPOUND))}), o AS (SELECT page, id, label, confidence, "left" AS l, "right" AS r FROM f WHERE label <> 'blot'),
u AS (SELECT page, id, 1 AS figures, label, confidence, l, r FROM o WHERE id <= 2 UNION ALL SELECT a.page, a.id, 2, a.label || b.label, sqrt(a.confidence * b.confidence), a.l, b.r FROM o a JOIN o b ON a.page = b.page AND a.id = 1 AND b.id = 2 AND (b.l - a.r) / 40 BETWEEN -0.1 AND 0.32),
d AS (SELECT page, id, 1 AS figures, label, confidence, l, r FROM o WHERE id > 2 UNION ALL SELECT page, id, 2, label || nl, sqrt(confidence * nc), l, nr FROM (SELECT *, lead(l) OVER w AS n, lead(label) OVER w AS nl, lead(confidence) OVER w AS nc, lead(r) OVER w AS nr FROM o WHERE id > 2 WINDOW w AS (PARTITION BY page ORDER BY l, id)) WHERE (n - r) / 40 BETWEEN -0.1 AND 0.32),
p AS (SELECT u.page, u.id, u.figures, d.id AS low, d.figures AS low_figures, CAST(u.label AS INTEGER) AS beats, CAST(d.label AS INTEGER) AS beat_value, u.confidence AS uc, d.confidence AS dc, least(u.l, d.l) AS l, greatest(u.r, d.r) AS r, (least(u.r, d.r) - greatest(u.l, d.l)) / least(u.r - u.l, d.r - d.l) AS share, abs(u.l + u.r - d.l - d.r) / 80 AS away, least(u.r - u.l, d.r - d.l) / greatest(u.r - u.l, d.r - d.l) AS wide FROM u JOIN d ON u.page = d.page),
e AS (SELECT *, 1.8 * share + 0.65 * wide + 0.35 + 0.35 * 0.85 - 0.55 * away AS agree FROM p WHERE share >= 0.58 AND away <= 0.22 AND wide >= 0.48),
n AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY page ORDER BY agree DESC, id, figures, low, low_figures) <= 8),
s AS (SELECT n.*, sqrt(uc * dc) AS confidence FROM n JOIN k ON k.v = n.beats AND k.w = n.beat_value)
SELECT page, beats, beat_value, CASE WHEN (l + r) / 400 <= 0.48 THEN 'Left' WHEN (l + r) / 400 >= 0.72 THEN 'Right' ELSE 'Middle' END AS side, round(confidence, 9) AS confidence FROM s QUALIFY row_number() OVER (PARTITION BY page ORDER BY confidence + 0.18 * agree DESC, id, figures, low, low_figures) = 1""")
def g09c(spark, d):
    """12/8, 16/8 and 9/8 from figures one by one, where they stand near enough; what is not supported is no meter."""
    blocks = read(spark, d, METER_BLOCKS).withColumn("units", F.lit(None).cast("int"))
    found = score.compound_meters(read(spark, d, FIGURES), blocks, COMPOUND)
    return found.select("page", "beats", "beat_value", "side", F.round("confidence", 9).alias("confidence"))


STEMS = "SELECT CAST(user_id AS STRING) AS page, CAST(event_id % 3 AS INT) AS measure, event_id AS id, CAST(10 AS DOUBLE) AS sp, CAST(event_id * 7919 % 6000 AS DOUBLE) / 10 AS left, CAST(100 + event_id % 90 AS DOUBLE) AS top, CAST(event_id * 7919 % 6000 AS DOUBLE) / 10 + 1 AS right, CAST(130 + event_id % 90 AS DOUBLE) AS bottom, CASE WHEN event_id % 2 = 0 THEN 'up' ELSE 'down' END AS direction FROM {events} WHERE event_type = 'click'"
BEAMED = "SELECT CAST(user_id AS STRING) AS page, CAST(event_id % 3 AS INT) AS measure, event_id AS stem FROM {events} WHERE event_type = 'click' AND event_id % 7 = 0"
MARKS = "SELECT CAST(user_id AS STRING) AS page, CAST(event_id % 3 AS INT) AS measure, event_id AS id, CAST(event_id * 7907 % 6000 AS DOUBLE) / 10 AS left, CAST(80 + event_id % 150 AS DOUBLE) AS top, CAST(event_id * 7907 % 6000 AS DOUBLE) / 10 + event_id % 9 AS right, CAST(80 + event_id % 150 + event_id % 8 AS DOUBLE) AS bottom, CASE event_id % 5 WHEN 0 THEN 'flag8thUp' WHEN 1 THEN 'flag16thDown' WHEN 2 THEN 'flag32ndUp' WHEN 3 THEN 'flag8thDown' ELSE 'sharp' END AS label, CAST(event_id % 89 AS DOUBLE) / 89 AS confidence FROM {events} WHERE event_type IN ('view', 'purchase')"


@query("g18_flags", f"""{with_(s=quoted(STEMS), b=BEAMED, f=quoted(MARKS))}, o AS (SELECT *, ("left" + "right") / 2 AS sx, CASE WHEN direction = 'up' THEN top ELSE bottom END AS tip FROM s WHERE id NOT IN (SELECT stem FROM b)), l AS (SELECT *, CASE label WHEN 'flag8thUp' THEN 8 WHEN 'flag8thDown' THEN 8 WHEN 'flag16thDown' THEN 16 END AS denominator, CASE WHEN label LIKE '%Up' THEN 'up' ELSE 'down' END AS turn FROM f),
m AS (SELECT o.page, o.measure, o.id AS stem, l.id AS flag, l.denominator, l.confidence FROM o JOIN l ON o.page = l.page AND o.measure = l.measure AND l.denominator IS NOT NULL AND l.turn = o.direction AND sqrt(power(greatest(l."left" - o.sx, o.sx - l."right", 0), 2) + power(greatest(l.top - o.tip, o.tip - l.bottom, 0), 2)) <= 12.5 AND l."right" - l."left" >= 2 * (o."right" - o."left") AND l.bottom - l.top >= 2)
SELECT page, measure, stem, arg_max(flag, (confidence, -flag)) AS flag, arg_max(denominator, (confidence, -flag)) AS denominator, max(confidence) AS confidence FROM m GROUP BY ALL""")
def g18(spark, d):
    return score.flags(read(spark, d, MARKS), read(spark, d, STEMS), read(spark, d, BEAMED))


NOTE = "l_suppkey, l_linenumber, l_orderkey, l_partkey, l_extendedprice"
#: Each supplier's lines as a score: a measure for each line number, a note for each line; some are chord tones of the last.
WRITTEN = f"SELECT concat('s', CAST(l_suppkey AS STRING)) AS path, CAST(l_linenumber AS STRING) AS measure, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice) AS n, CASE l_partkey % 7 WHEN 0 THEN 'C' WHEN 1 THEN 'D' WHEN 2 THEN 'E' WHEN 3 THEN 'F' WHEN 4 THEN 'G' WHEN 5 THEN 'A' ELSE 'B' END AS step, CAST(2 + l_orderkey % 4 AS INT) AS octave, CAST(1 + l_partkey % 8 AS INT) AS duration, l_orderkey % 5 = 0 AND row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice) > 1 AS chord FROM {{lineitem}}"


def scores(spark: SparkSession, d: str) -> DataFrame:
    """path, content: the scores as MusicXML."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c.cast("string") if not isinstance(c, str) else F.col(c).cast("string"), F.lit(f"</{name}>"))
    note = F.concat(F.lit("<note>"), F.when(F.col("chord"), "<chord/>").otherwise(""), tag("pitch", F.concat(tag("step", "step"), tag("octave", "octave"))), tag("duration", "duration"), F.lit("<voice>1</voice></note>"))
    m = read(spark, d, WRITTEN).withColumn("xml", note).groupBy("path", "measure").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "xml"))), lambda x: x["xml"]), "").alias("xml"))
    head = F.when(F.col("measure") == "1", "<attributes><divisions>4</divisions></attributes>").otherwise("")
    m = m.withColumn("xml", F.concat(F.lit('<measure number="'), "measure", F.lit('">'), head, "xml", F.lit("</measure>")))
    whole = m.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("measure", "xml"))), lambda x: x["xml"]), "").alias("xml"))
    return whole.select("path", F.concat(F.lit('<score-partwise version="4.0"><part-list><score-part id="P1"><part-name/></score-part></part-list><part id="P1">'), "xml", F.lit("</part></score-partwise>")).alias("content"))


TIMED = f"{with_(w=WRITTEN)}, c AS (SELECT *, sum(CASE WHEN chord THEN 0 ELSE duration END) OVER (PARTITION BY path, measure ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w), t AS (SELECT *, last_value(CASE WHEN NOT chord THEN coalesce(before, 0) END IGNORE NULLS) OVER (PARTITION BY path, measure ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS onset FROM c)"


@query("s08_s09_timed_notes", f"{TIMED} SELECT path, measure, step, octave, onset / 4 AS position, duration / 4 AS quarters FROM t")
def s08(spark, d):
    return musicxml.timed_events(musicxml.parse_column(scores(spark, d), "path", "content")).select("path", "measure", "step", "octave", F.col("position").cast("double").alias("position"), "quarters")


@query("s10_note_rows", f"{with_(w=WRITTEN)} SELECT path, measure, count(*) AS notes, count(*) FILTER (WHERE chord) AS chords FROM w GROUP BY ALL")
def s10(spark, d):
    n = musicxml.notes(musicxml.parse_column(scores(spark, d), "path", "content")).where("not is_rest")
    return n.groupBy("path", "measure").agg(F.count("*").alias("notes"), F.count_if("is_chord").alias("chords"))


@query("s19_q06_round_trip", f"{with_(w=WRITTEN)} SELECT path, count(*) AS notes, CAST(0 AS BIGINT) AS changed FROM w GROUP BY 1")
def s19(spark, d):
    """Notes after writing and reading again, and how many differ from the first reading."""
    before = iterate.cut(musicxml.parse_column(scores(spark, d), "path", "content"))
    after = iterate.cut(musicxml.parse_column(musicxml.write_scores(before), "path", "content"))
    cols = ["kind", "step", "octave", "alter", "duration", "voice", "type", "is_chord", "is_rest"]
    changed = quality.round_trip(before, after, ["path", "part", "measure"], ["measure_pos", "pos"], cols).groupBy("path").agg(F.count("*").alias("c"))
    notes = musicxml.notes(after).groupBy("path").agg(F.count("*").alias("notes"))
    return notes.join(changed, "path", "left").select("path", "notes", F.coalesce("c", F.lit(0)).alias("changed"))


SHAPE = "SELECT CAST(user_id AS STRING) AS page, event_id AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS id, event_id % 4 AS kind, CAST(event_id * 31 % 400 AS INT) AS x, CAST(event_id * 17 % 300 AS INT) AS y, CAST(1 + event_id % 40 AS INT) AS w, CAST(1 + event_id % 23 AS INT) AS h FROM {events}"


@query("s04_s05_svg_contours", f"""{with_(s=SHAPE)} SELECT page AS path, CAST(id AS INTEGER) AS id, CASE kind WHEN 1 THEN 'line' WHEN 2 THEN 'rect' ELSE 'path' END AS element, CAST(7 + 2 * x AS DOUBLE) AS "left", CAST(11 + 2 * y AS DOUBLE) AS top, CAST(7 + 2 * (x + w) AS DOUBLE) AS "right", CAST(11 + 2 * (y + h) AS DOUBLE) AS bottom FROM s""")
def s04(spark, d):
    """Lines, rectangles and paths of absolute and relative commands under a matrix stack."""
    s = read(spark, d, SHAPE)
    made = """CASE kind WHEN 1 THEN concat('<line x1="', x, '" y1="', y, '" x2="', x + w, '" y2="', y + h, '"/>') WHEN 2 THEN concat('<rect x="', x, '" y="', y, '" width="', w, '" height="', h, '"/>')
        WHEN 3 THEN concat('<path d="m', x, ' ', y, 'l', w, ' 0l0 ', h, 'l-', w, ' 0z"/>') ELSE concat('<path d="M', x, ',', y, 'H', x + w, 'V', y + h, 'L', x, ' ', y + h, 'Z"/>') END"""
    pages = s.withColumn("xml", F.expr(made)).groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "xml"))), lambda x: x["xml"]), "").alias("xml"))
    pages = pages.select("page", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg"><g transform="translate(7 11)"><g transform="scale(2)">'), "xml", F.lit("</g></g></svg>")).alias("content"))
    return svg.parse_column(pages.withColumnRenamed("page", "path"), "path", "content").select("path", "id", "element", *[F.round(c, 6).alias(c) for c in ("left", "top", "right", "bottom")])


@query("s07_path_grammar", f"""{with_(s=SHAPE)} SELECT e, x || ' ' || y || '|' || (x + w) || ' ' || (y + h) || '|' || (x + w + 3) || ' ' || (y + h) || '|' || (x + w + 3) || ' ' || (y + h + 4) || '/' || (x + 1) || ' ' || (y + 1) || '|' || w || ' ' || h AS points FROM s""")
def s07(spark, d):
    """Moves, relative lines, horizontals and verticals, and a second contour."""
    s = read(spark, d, SHAPE).select("e", F.expr("concat('M', x, ' ', y, 'l', w, ',', h, 'h3v4M', x + 1, ' ', y + 1, 'L', w, ' ', h)").alias("d"))

    @F.pandas_udf("string")
    def points(d):
        return d.map(lambda t: "/".join("|".join(f"{a:g} {b:g}" for a, b in c) for c in svg.flatten(t)))

    return s.select("e", points("d").alias("points"))


DIFF = """a AS (SELECT l_suppkey AS k, l_linenumber AS m, l_quantity AS q, l_discount AS d, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice) AS n FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT l_suppkey AS k, l_linenumber AS m, l_quantity AS q, l_discount AS d, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice) AS n FROM lineitem WHERE l_returnflag = 'N'),
x AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.m, b.m) AS m, coalesce(a.n, b.n) AS n, CASE WHEN a.n IS NULL OR b.n IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.q <> b.q THEN 'q' END, CASE WHEN a.d <> b.d THEN 'd' END) END AS differs, a.n IS NULL AS extra, b.n IS NULL AS missing FROM a FULL JOIN b ON a.k = b.k AND a.m = b.m AND a.n = b.n),
v AS (SELECT k, m, n, differs, CASE WHEN extra THEN 'extra' WHEN missing THEN 'missing' WHEN differs <> '' THEN 'mismatched' ELSE 'matched' END AS verdict FROM x)"""
SCORED = """c AS (SELECT {0}, count(*) FILTER (WHERE verdict = 'matched') AS matched, count(*) FILTER (WHERE verdict = 'mismatched') AS mismatched, count(*) FILTER (WHERE verdict = 'missing') AS missing, count(*) FILTER (WHERE verdict = 'extra') AS extra FROM v GROUP BY ALL),
p AS (SELECT *, CASE WHEN matched + mismatched + extra > 0 THEN matched / (matched + mismatched + extra) ELSE 0 END AS pr, CASE WHEN matched + mismatched + missing > 0 THEN matched / (matched + mismatched + missing) ELSE 0 END AS re FROM c), f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM p)"""


def line_diff(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "SELECT l_suppkey AS k, l_linenumber AS m, l_quantity AS q, l_discount AS d, l_orderkey, l_partkey, l_extendedprice, l_returnflag FROM {lineitem}")  # noqa: E741
    return quality.multiset_diff(l.where("l_returnflag = 'A'"), l.where("l_returnflag = 'N'"), ["k", "m"], ["l_orderkey", "l_partkey", "l_extendedprice"], ["q", "d"])


@query("q03_note_diff", f"WITH {DIFF} SELECT k, m, CAST(n AS INTEGER) AS n, verdict, differs FROM v")
def q03(spark, d):
    return line_diff(spark, d)


@query("q08_quality_report", f"WITH {DIFF}, {SCORED.format('m')} SELECT m, matched, mismatched, missing, extra, round(f1, 6) AS f1 FROM f")
def q08(spark, d):
    return quality.summary(line_diff(spark, d), ["m"]).select("m", "matched", "mismatched", "missing", "extra", F.round("f1", 6).alias("f1"))


@query("s21_report_tables", f"""WITH {DIFF}, {SCORED.format('k')}, r AS (SELECT *, row_number() OVER (ORDER BY f1, missing DESC, k) AS "rank" FROM f) SELECT k, matched, mismatched, missing, extra, round(f1, 6) AS f1, "rank", "rank" <= 10 AS worst FROM r""")
def s21(spark, d):
    """The numbers of a report: every group's counts and scores, ranked, the ten worst marked."""
    return quality.report(line_diff(spark, d), ["k"], 10).select("k", "matched", "mismatched", "missing", "extra", F.round("f1", 6).alias("f1"), F.col("rank").cast("long").alias("rank"), "worst")


@query("s15_coverage", "SELECT f.p_brand AS font, g.p_type AS glyph, count(p.p_partkey) AS n, count(p.p_partkey) > 0 AS covered FROM (SELECT DISTINCT p_brand FROM part) f CROSS JOIN (SELECT DISTINCT p_type FROM part) g LEFT JOIN part p ON p.p_brand = f.p_brand AND p.p_type = g.p_type GROUP BY ALL")
def s15(spark, d):
    """Which font has which glyph: every font with every glyph's name. The names of fonts are few and go along with each glyph."""
    p = read(spark, d, "SELECT p_brand AS font, p_type AS glyph FROM {part}")
    have = p.groupBy("font", "glyph").agg(F.count("*").alias("n"))
    fonts = p.agg(F.collect_set("font").alias("fonts")).withColumn("one", F.lit(1))
    every = p.select("glyph").distinct().withColumn("one", F.lit(1)).join(F.broadcast(fonts), "one").select(F.explode("fonts").alias("font"), "glyph")
    return every.join(have, ["font", "glyph"], "left").select("font", "glyph", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("covered"))


@query("s22_svg_dump", f"""{with_(p=quoted(PIECES))} SELECT page, '<svg xmlns="http://www.w3.org/2000/svg">' || string_agg('<rect id="' || id || '" x="' || format('{{:.2f}}', "left") || '" y="' || format('{{:.2f}}', top) || '" width="' || format('{{:.2f}}', "right" - "left") || '" height="' || format('{{:.2f}}', bottom - top) || '"/>', '' ORDER BY id) || '</svg>' AS content FROM p GROUP BY 1""")
def s22(spark, d):
    return svg.dump(read(spark, d, PIECES))


def segment_pages(s: DataFrame) -> DataFrame:
    """path, content: the lines and rectangles of s as SVG, in order of their ids: a text that is read twice must number them alike."""
    made = """CASE kind WHEN 1 THEN concat('<line x1="', x, '" y1="', y, '" x2="', x + w, '" y2="', y + h, '"/>') ELSE concat('<rect x="', x, '" y="', y, '" width="', w, '" height="', h, '"/>') END"""
    return s.withColumn("xml", F.expr(made)).groupBy(F.col("page").alias("path")).agg(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">'), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "xml"))), lambda x: x["xml"]), ""), F.lit("</svg>")).alias("content"))


@query("s06_svg_segments", f"""{with_(s=SHAPE)} SELECT page AS path, CASE kind WHEN 1 THEN 'line' ELSE 'rect' END AS element, sum(CASE kind WHEN 1 THEN 1 ELSE 4 END) AS n FROM s WHERE kind IN (1, 2) GROUP BY ALL""", n="BIGINT")
def s06(spark, d):
    """Segments of the lines and rectangles that are drawn."""
    c = svg.parse_column(segment_pages(read(spark, d, SHAPE).where("kind in (1, 2)")), "path", "content")
    return svg.segments(c).join(c.select("path", "id", "element"), ["path", "id"]).groupBy("path", "element").agg(F.count("*").alias("n"))


@query("g03_contours_of_paths", f"""{with_(s=SHAPE)} SELECT e, CAST(1 + h % 3 + w % 2 AS INTEGER) AS contours FROM s""")
def g03(spark, d):
    """One contour a move, and one where a command follows a close."""
    s = read(spark, d, SHAPE).select("e", F.expr("concat('M', x, ' ', y, 'h1v1Z', repeat('M5 5 6 6', cast(h % 3 as int)), if(w % 2 = 1, if(h % 3 = 0, 'l2 2', 'Zl2 2'), ''))").alias("d"))

    @F.pandas_udf("int")
    def count(d):
        return d.map(lambda x: len(svg.flatten(x)))

    return s.select("e", count("d").alias("contours"))


BROKEN = "SELECT DISTINCT l_suppkey AS k, concat('s', CAST(l_suppkey AS STRING)) AS path FROM {lineitem}"


@query("s24_error_rows", f"{with_(b=BROKEN)} SELECT path, true AS failed FROM b WHERE k % 7 = 0")
def s24(spark, d):
    """Broken files become rows, the others go on."""
    s = scores(spark, d).join(read(spark, d, BROKEN), "path")
    s = s.withColumn("content", F.when(F.col("k") % 7 == 0, F.expr("substring(content, 1, length(content) - 20)")).otherwise(F.col("content")))
    return musicxml.parse_column(s, "path", "content").where("error is not null").select("path", F.lit(True).alias("failed"))


STATES = "SELECT DISTINCT concat('s', CAST(l_suppkey AS STRING)) AS path, CAST(l_linenumber AS STRING) AS measure, l_linenumber AS n, CASE WHEN (l_suppkey + l_linenumber) % 3 = 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'G' ELSE 'F' END END AS sign, CASE WHEN l_linenumber * l_suppkey % 4 = 0 THEN CAST(2 + l_linenumber % 3 AS INT) END AS beats, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_suppkey % 5 AS INT) END AS fifths FROM {lineitem}"


@query("s11_attribute_state", f"""{with_(s=STATES)} SELECT path, measure, last_value(sign || '2' IGNORE NULLS) OVER w AS clef, last_value(CAST(fifths AS VARCHAR) IGNORE NULLS) OVER w AS key, last_value(beats IGNORE NULLS) OVER w AS beats FROM s WINDOW w AS (PARTITION BY path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def s11(spark, d):
    """Clef, key and meter in force, from attributes that state some of them in some measures."""
    part = lambda test, *xml: F.when(F.col(test).isNotNull(), F.concat(*xml)).otherwise("")
    s = read(spark, d, STATES)
    xml = F.concat(F.lit('<measure number="'), "measure", F.lit('"><attributes><divisions>4</divisions>'), part("fifths", F.lit("<key><fifths>"), F.col("fifths").cast("string"), F.lit("</fifths></key>")), part("beats", F.lit("<time><beats>"), F.col("beats").cast("string"), F.lit("</beats><beat-type>4</beat-type></time>")), part("sign", F.lit("<clef><sign>"), F.col("sign"), F.lit("</sign><line>2</line></clef>")), F.lit("</attributes></measure>"))
    whole = s.withColumn("xml", xml).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "xml"))), lambda x: x["xml"]), "").alias("xml"))
    files = whole.select("path", F.concat(F.lit('<score-partwise><part-list/><part id="P1">'), "xml", F.lit("</part></score-partwise>")).alias("content"))
    return musicxml.attribute_state(musicxml.parse_column(files, "path", "content")).select("path", "measure", "clef", "key", "beats")


SIDECAR = "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN concat('  ', CAST(o_custkey % 90 AS STRING), '-', CAST(o_orderkey % 3 AS STRING), '-L : ', o_orderpriority) WHEN 1 THEN concat('Title', CAST(o_orderkey AS STRING), ': ', o_orderstatus, ': ', o_orderpriority, ' ') WHEN 2 THEN 'no pair' ELSE '' END AS value FROM {orders}"


@query("s17_sidecar", """SELECT path, CASE WHEN k % 4 = 0 THEN m || '-' || s || '-L' ELSE 'Title' || k END AS key, CASE WHEN k % 4 = 0 THEN p ELSE t || ': ' || p END AS value, CASE WHEN k % 4 = 0 THEN CAST(m AS INTEGER) END AS measure, CASE WHEN k % 4 = 0 THEN CAST(s AS INTEGER) END AS staff, CASE WHEN k % 4 = 0 THEN 'L' END AS align FROM (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderkey AS k, o_custkey % 90 AS m, o_orderkey % 3 AS s, o_orderpriority AS p, o_orderstatus AS t FROM orders) WHERE k % 4 < 2""")
def s17(spark, d):
    from ..sources.text import sidecar_rows

    return sidecar_rows(read(spark, d, SIDECAR).select(F.col("k").cast("string").alias("path"), "value"))


RECTANGLE = "SELECT p_partkey AS id, CAST(1 + p_size AS DOUBLE) AS w, CAST(1 + p_partkey % 40 AS DOUBLE) AS h FROM {part}"


@query("p15_round_gate", f"{with_(r=RECTANGLE)} SELECT id, 12.566370614359172 * w * h / power(2 * (w + h), 2) >= 0.64 AS round FROM r")
def p15(spark, d):
    """Circularity of outlines, by columns."""
    from ..functions import geometry as geo

    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero, w, h = F.lit(0.0), F.col("w"), F.col("h")
    return read(spark, d, RECTANGLE).select("id", (geo.circularity(F.array(p(zero, zero), p(w, zero), p(w, h), p(zero, h))) >= 0.64).alias("round"))


CLASSED = "SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id, CASE l_partkey % 3 WHEN 0 THEN 'gClef' WHEN 1 THEN 'fClef' ELSE 'other' END AS class, CAST(1 + l_suppkey % 2 AS INT) AS place, l_returnflag = 'A' AS accepted, l_discount * 10 AS confidence FROM {lineitem}"


@query("g21_label_adapter", f"""{with_(m=CLASSED)} SELECT id, CASE "class" WHEN 'gClef' THEN 'G' ELSE 'F' END AS label, confidence FROM m WHERE place = 1 AND accepted AND confidence >= 0.25 AND "class" <> 'other'""".replace("AS class", 'AS "class"'))
def g21(spark, d):
    from ..operators import glyph

    return glyph.labels(read(spark, d, CLASSED), "id", {"gClef": "G", "fClef": "F"}, 0.25)


SAMPLES = "SELECT DISTINCT p_brand AS source, CAST(p_size % 10 AS STRING) AS label FROM {part}"


@query("d11_composed_numbers", f"""{with_(s=SAMPLES)} SELECT source, label FROM s WHERE CAST(label AS INTEGER) <= 16 UNION SELECT a.source, a.label || b.label FROM s a JOIN s b ON a.source = b.source WHERE a.label <> '0' AND CAST(a.label || b.label AS INTEGER) <= 16""")
def d11(spark, d):
    from ..operators import glyph

    return glyph.compose_numbers(read(spark, d, SAMPLES), 16).select("source", "label")


INKS = "SELECT l_suppkey AS m, l_orderkey * 10 + l_linenumber AS id, l_extendedprice AS left, CAST(l_partkey % 10 AS STRING) AS label, (1 + l_quantity) / 52 AS confidence, l_partkey % 3 > 0 AS gap_after FROM {lineitem}"


@query("d05_d06_numbers", f"""{with_(p=quoted(INKS))}, g AS (SELECT *, lag(gap_after) OVER w AS parted FROM p WINDOW w AS (PARTITION BY m ORDER BY "left", id, label, confidence)), n AS (SELECT *, sum(CASE WHEN parted THEN 1 ELSE 0 END) OVER (PARTITION BY m ORDER BY "left", id, label, confidence ROWS UNBOUNDED PRECEDING) AS number FROM g)
SELECT m, CAST(number AS BIGINT) AS number, string_agg(label, '' ORDER BY "left", id, label, confidence) AS label, round(exp(sum(ln(confidence)) / count(*)) * exp(-CASE WHEN count(*) = 2 AND arg_min(label, ("left", id, label, confidence)) <> '1' THEN 2.0 ELSE 0 END), 6) AS confidence FROM n GROUP BY m, number""")
def d0506(spark, d):
    from ..operators import glyph

    p = read(spark, d, INKS)
    return glyph.number_candidates(p, ["m"], "id").select("m", F.col("number").cast("long").alias("number"), "label", F.round("confidence", 6).alias("confidence"))


GRID = f"SELECT *, CAST(32 AS INT) AS units FROM ({BLOCKS})"
OVALS = "SELECT CAST(user_id AS STRING) AS page, event_id AS id, CAST(1 + event_id % 2 AS INT) AS part, CAST(event_id % 3 AS INT) AS measure, CAST(200 * (event_id % 3) AS DOUBLE) + CAST(event_id * 7919 % 1800 AS DOUBLE) / 10 AS left, CAST(100 * (1 + event_id % 2) - 40 + event_id * 31 % 125 AS DOUBLE) AS top, CAST(200 * (event_id % 3) AS DOUBLE) + CAST(event_id * 7919 % 1800 AS DOUBLE) / 10 + 8 + event_id % 8 AS right, CAST(100 * (1 + event_id % 2) - 40 + event_id * 31 % 125 + 4 + event_id % 10 AS DOUBLE) AS bottom, event_id % 4 = 0 AS hole FROM {events} WHERE event_type IN ('view', 'click')"
SEEN_CLEFS = "SELECT CAST(user_id AS STRING) AS page, event_id AS id, CAST(1 + event_id % 2 AS INT) AS part, CAST(event_id % 3 AS INT) AS measure, CASE event_id % 5 WHEN 0 THEN 'C' WHEN 1 THEN 'F' WHEN 2 THEN 'F' ELSE 'G' END AS label, CAST(event_id % 32 AS DOUBLE) + CAST(1 AS DOUBLE) / 3 AS lx FROM {events} WHERE event_type = 'purchase'"
RUNGS = "SELECT CAST(user_id AS STRING) AS page, CAST(1 + event_id % 2 AS INT) AS part, CAST(event_id % 3 AS INT) AS measure, CAST(CASE WHEN event_id % 4 < 2 THEN -1 ELSE 1 END * (1 + event_id % 3) AS INT) AS depth, CAST(200 * (event_id % 3) + event_id * 7 % 170 AS DOUBLE) AS left, CAST(200 * (event_id % 3) + event_id * 7 % 170 + 20 AS DOUBLE) AS right FROM {events} WHERE event_type = 'error'"


@query("g13_noteheads", f"""{with_(g=quoted(GRID), o0=quoted(OVALS), c=SEEN_CLEFS, r=quoted(RUNGS))}, o AS (SELECT o0.*, ((o0."left" + o0."right") / 2 - g."left") / (g."right" - g."left") * 32 AS lx, ((o0.top + o0.bottom) / 2 - g.top) / 5 AS ly FROM o0 JOIN g ON o0.page = g.page AND o0.part = g.part AND o0.measure = g.measure),
p AS (SELECT *, CAST(round_even(ly, 0) AS INTEGER) AS position FROM o WHERE (bottom - top) / 10 BETWEEN 0.45 AND 1.35 AND ("right" - "left") / (bottom - top) BETWEEN 1.05 AND 2.4), q AS (SELECT *, CASE WHEN position < -1 THEN ceil((abs(position) - 1) / 2) WHEN position > 9 THEN ceil((position - 9) / 2) ELSE 0 END AS need FROM p WHERE abs(ly - position) <= 0.4),
l AS (SELECT * FROM q WHERE need = 0 OR EXISTS (SELECT 1 FROM r WHERE r.page = q.page AND r.part = q.part AND r.measure = q.measure AND sign(r.depth) = CASE WHEN q.position < 0 THEN -1 ELSE 1 END AND abs(r.depth) >= q.need AND least(q."right", r."right") - greatest(q."left", r."left") > 0)),
k AS (SELECT l.page, l.id, arg_max(c.label, (c.measure, c.lx, c.id)) AS clef FROM l JOIN c ON l.page = c.page AND l.part = c.part AND (c.measure < l.measure OR c.measure = l.measure AND c.lx <= l.lx) GROUP BY ALL), i AS (SELECT l.*, k.clef, CASE k.clef WHEN 'G' THEN 38 ELSE 26 END - position AS ix FROM l JOIN k ON l.page = k.page AND l.id = k.id AND k.clef <> 'C')
SELECT page, part, measure, id, position, clef, ['C', 'D', 'E', 'F', 'G', 'A', 'B'][(ix % 7 + 7) % 7 + 1] AS step, CAST(floor(ix / 7) AS INTEGER) AS octave, NOT hole AS filled FROM i""")
def g13(spark, d):
    """Ovals at legal places, by ladders of their own side, with the pitch that the last clef gives them."""
    h = score.noteheads(read(spark, d, OVALS), read(spark, d, GRID), read(spark, d, SEEN_CLEFS), read(spark, d, RUNGS))
    return h.select("page", "part", "measure", "id", "position", "clef", "step", F.col("octave").cast("int").alias("octave"), "filled")


SIGNS = "SELECT CAST(user_id AS STRING) AS page, event_id AS id, CASE WHEN event_id % 5 > 0 THEN CAST(1 + event_id % 2 AS INT) END AS part, CAST(event_id % 3 AS INT) AS measure, CAST(event_id * 7919 % 6000 AS DOUBLE) / 10 AS left, CAST(40 + event_id * 31 % 330 AS DOUBLE) AS top, CAST(event_id * 7919 % 6000 AS DOUBLE) / 10 + 9 AS right, CAST(40 + event_id * 31 % 330 + 12 AS DOUBLE) AS bottom, CASE event_id % 4 WHEN 0 THEN 'restQuarter' WHEN 1 THEN 'RestHalf' WHEN 2 THEN 'sharp' ELSE 'rest8th' END AS label, CAST(event_id % 89 AS DOUBLE) / 89 AS confidence FROM {events} WHERE event_type IN ('view', 'click')"
CLAIMED = "SELECT CAST(user_id AS STRING) AS page, CAST(event_id * 7919 % 6000 AS DOUBLE) / 10 - CAST(event_id % 3 AS DOUBLE) / 5 AS left, CAST(40 + event_id * 31 % 330 AS DOUBLE) AS top, CAST(event_id * 7919 % 6000 AS DOUBLE) / 10 + 9 AS right, CAST(40 + event_id * 31 % 330 + 12 AS DOUBLE) AS bottom FROM {events} WHERE event_id % 11 = 0"


@query("g23_rests", f"""{with_(s=quoted(SIGNS), c=quoted(CLAIMED), g=quoted(GRID))}, f AS (SELECT * FROM s WHERE lower(label) LIKE 'rest%' AND NOT EXISTS (SELECT 1 FROM c WHERE c.page = s.page AND s."left" >= c."left" AND s."right" <= c."right" AND s.top >= c.top AND s.bottom <= c.bottom AND s."left" - c."left" <= (c."right" - c."left") * 0.05::DOUBLE AND c."right" - s."right" <= (c."right" - c."left") * 0.05::DOUBLE AND s.top - c.top <= (c.bottom - c.top) * 0.05::DOUBLE AND c.bottom - s.bottom <= (c.bottom - c.top) * 0.05::DOUBLE)),
b AS (SELECT f.page, f.id, f.measure, f.label, g.part, greatest(g.top - f.bottom, f.top - g.bottom, 0) AS gap, row_number() OVER (PARTITION BY f.page, f.id ORDER BY g.part IS DISTINCT FROM f.part, greatest(g.top - f.bottom, f.top - g.bottom, 0), g.part) AS n FROM f JOIN g ON g.page = f.page AND g.measure = f.measure),
d AS (SELECT f.page, f.id, min(sqrt(power(greatest(c."left" - f."right", f."left" - c."right", 0), 2) + power(greatest(c.top - f.bottom, f.top - c.bottom, 0), 2))) AS d FROM f JOIN c ON c.page = f.page GROUP BY ALL) SELECT b.page, b.part, b.measure, b.id, b.label FROM b LEFT JOIN d ON b.page = d.page AND b.id = d.id WHERE n = 1 AND (gap <= 20 OR coalesce(d.d, 1e9) <= 20)""")
def g23(spark, d):
    return score.rests(read(spark, d, SIGNS), read(spark, d, GRID), read(spark, d, CLAIMED)).select("page", "part", "measure", "id", "label")


CANDIDATES = "SELECT CAST(user_id AS STRING) AS page, event_id AS id, CAST(1 + event_id % 2 AS INT) AS part, CAST(event_id % 3 AS INT) AS measure, CAST(200 * (event_id % 3) + event_id * 7 % 150 AS DOUBLE) AS left, CAST(100 * (1 + event_id % 2) + event_id % 13 - 6 AS DOUBLE) AS top, CAST(200 * (event_id % 3) + event_id * 7 % 150 + 12 + event_id % 40 AS DOUBLE) AS right, CAST(100 * (1 + event_id % 2) + event_id % 13 - 6 + 20 + event_id % 100 AS DOUBLE) AS bottom, CASE event_id % 4 WHEN 0 THEN 'G' WHEN 1 THEN 'F' WHEN 2 THEN 'C' ELSE 'blot' END AS label, CAST(event_id % 97 AS DOUBLE) / 97 AS confidence FROM {events}"


@query("g11_clefs", f"""{with_(c=quoted(CANDIDATES)).replace("WITH", "WITH RECURSIVE", 1)}, s AS (SELECT page, part, measure, label, list({{'id': id, 'l': "left", 'r': "right", 't': top, 'f': bottom}} ORDER BY confidence DESC, id) AS v FROM c WHERE (bottom - top) / 5 BETWEEN 6 AND 22 AND ("right" - "left") / 40 BETWEEN 0.4 AND 1.8 AND label <> 'blot' GROUP BY ALL),
r(page, part, measure, label, v, i, kept) AS (SELECT *, 1, CAST([] AS STRUCT(id BIGINT, l DOUBLE, r DOUBLE, t DOUBLE, f DOUBLE)[]) FROM s UNION ALL SELECT page, part, measure, label, v, i + 1, CASE WHEN len(list_filter(kept, lambda x: greatest(least(x.r, v[i].r) - greatest(x.l, v[i].l), 0) * greatest(least(x.f, v[i].f) - greatest(x.t, v[i].t), 0) >= 0.45 * least((x.r - x.l) * (x.f - x.t), (v[i].r - v[i].l) * (v[i].f - v[i].t)))) = 0 THEN list_append(kept, v[i]) ELSE kept END FROM r WHERE i <= len(v))
SELECT page, part, measure, label, unnest(list_transform(kept, lambda x: x.id)) AS id FROM r WHERE i > len(v)""")
def g11c(spark, d):
    return score.clefs(read(spark, d, CANDIDATES), read(spark, d, GRID)).select("page", "part", "measure", "label", "id")


#: A page for each customer: two staves with three measures, and a head with its stem for each order.
ORDERED = "SELECT CAST(o_custkey AS STRING) AS page, o_orderkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS r, CAST(1 + o_orderkey % 2 AS INT) AS part, CAST(o_orderkey % 9 AS INT) AS position FROM {orders}"
DRAWN_NOTES = f"SELECT page, k, part, position, CAST(1 + r % 3 AS INT) AS measure, CAST(90 + 300 * (r % 3) + 22 * ((r - r % 3) / 3) AS INT) AS x, CAST(100 + 110 * (part - 1) + 5 * position AS INT) AS y FROM ({ORDERED})"


def drawn_pages(spark: SparkSession, d: str) -> DataFrame:
    """path, content: the pages as SVG: ten staff lines, four bars, a path for each head (every third with a white hole) and a line for each stem."""
    import math

    line = lambda *at: '<line x1="{}" y1="{}" x2="{}" y2="{}"/>'.format(*at)
    frame = "".join(line(50, y + 10 * i, 950, y + 10 * i) for y in (100, 210) for i in range(5)) + "".join(line(x, 100, x, 250) for x in (50, 350, 650, 950))
    n = read(spark, d, DRAWN_NOTES)
    around = [(6 * math.cos(2 * math.pi * i / 16), 4.5 * math.sin(2 * math.pi * i / 16)) for i in range(16)]
    outline = lambda size: F.concat(*[F.concat(F.lit("L" if i else "M"), F.format_string("%.6f %.6f", F.col("x") + F.lit(a * size), F.col("y") + F.lit(b * size))) for i, (a, b) in enumerate(around)], F.lit("Z"))
    points = F.concat(outline(1.0), F.when(F.col("k") % 3 == 0, outline(0.6)).otherwise(""))
    up = F.col("position") >= 4
    x, y = F.when(up, F.col("x") + 6).otherwise(F.col("x") - 6), F.when(up, F.col("y") - 35).otherwise(F.col("y") + 35)
    stem = F.concat(F.lit('<line x1="'), x, F.lit('" y1="'), F.col("y"), F.lit('" x2="'), x, F.lit('" y2="'), y, F.lit('"/>'))
    n = n.withColumn("xml", F.concat(F.lit('<path d="'), points, F.lit('"/>'), stem))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "xml"))), lambda v: v["xml"]), "")
    return n.groupBy(F.col("page").alias("path")).agg(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">' + frame), body, F.lit("</svg>")).alias("content"))


@query("x_svg_to_notes", f"""{with_(n=DRAWN_NOTES)}, i AS (SELECT *, CASE part WHEN 1 THEN 38 ELSE 26 END - position AS ix FROM n) SELECT page, part, measure, CAST(x AS DOUBLE) AS x, ['C', 'D', 'E', 'F', 'G', 'A', 'B'][ix % 7 + 1] AS step, CAST(floor(ix / 7) AS INTEGER) AS octave, CASE WHEN position >= 4 THEN 'up' ELSE 'down' END AS direction, k % 3 > 0 AS filled FROM i""")
def svg_to_notes(spark, d):
    """From SVG bytes to notes: contours, staves, blocks, the pieces' measures, heads with pitch and fill, stems with direction. Upper staves have a G clef, lower ones an F clef."""
    c = iterate.cut(svg.parse_column(drawn_pages(spark, d), "path", "content").where("error is null").withColumnRenamed("path", "page"))
    two = c.where("size(points) = 2")
    lines = two.select("page", F.lit(1000.0).alias("page_width"), F.lit(400.0).alias("page_height"), *[F.col("points")[k][v].alias(f"{v}{k + 1}") for k in (0, 1) for v in ("x", "y")])
    blocks = iterate.cut(score.blocks(score.detect_staves(lines)))
    pieces = c.where("size(points) > 2 or (right - left < 1 and bottom - top < 100)").select("page", F.col("id").cast("long").alias("id"), "left", "top", "right", "bottom", "points", F.col("anchor").alias("source"))
    placed = iterate.cut(score.assign_blocks(pieces, blocks))
    meter = blocks.select("page", "part", "measure", F.lit(4).alias("beats"), F.lit(4).alias("beat_value"), F.lit(1.0).alias("confidence"))
    grid = iterate.cut(score.logical_grid(blocks, meter))
    clefs = blocks.where("measure = 1").select("page", "part", "measure", F.lit(-1.0).alias("lx"), F.lit(0).cast("long").alias("id"), F.when(F.col("part") == 1, "G").otherwise("F").alias("label"))
    ledgers = grid.where("false").select("page", "part", "measure", F.lit(0).alias("depth"), "left", "right")
    heads = iterate.cut(score.noteheads(placed.where("size(points) > 2"), grid, clefs, ledgers))
    stems, links = score.stems(placed.where("size(points) = 2"), heads, grid)
    way = links.join(stems.select("page", "measure", F.col("id").alias("stem"), "direction"), ["page", "measure", "stem"]).select("page", "measure", F.col("head").alias("id"), "direction")
    return heads.join(way, ["page", "measure", "id"], "left").select("page", F.col("part").cast("int").alias("part"), F.col("measure").cast("int").alias("measure"), F.round((F.col("left") + F.col("right")) / 2, 3).alias("x"), "step", F.col("octave").cast("int").alias("octave"), "direction", "filled")


PAIRED = "SELECT CAST(o_custkey AS STRING) AS page, CAST(o_orderkey % 5 AS INT) AS arc, CAST(o_orderkey % 7 AS STRING) AS pair, o_totalprice AS score FROM {orders}"


@query("j31_unused_pairs", f"""{with_(p=PAIRED).replace("WITH", "WITH RECURSIVE", 1)}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score, arc, pair) AS n FROM p), r(page, n, arcs, pairs) AS (SELECT DISTINCT page, CAST(0 AS BIGINT), CAST([] AS INTEGER[]), CAST([] AS VARCHAR[]) FROM o
UNION ALL SELECT r.page, o.n, CASE WHEN list_contains(arcs, arc) OR list_contains(pairs, pair) THEN arcs ELSE list_append(arcs, arc) END, CASE WHEN list_contains(arcs, arc) OR list_contains(pairs, pair) THEN pairs ELSE list_append(pairs, pair) END FROM r JOIN o ON o.page = r.page AND o.n = r.n + 1), f AS (SELECT page, arg_max(arcs, n) AS arcs, arg_max(pairs, n) AS pairs FROM r GROUP BY 1) SELECT page, unnest(arcs) AS arc, unnest(pairs) AS pair FROM f""")
def j31(spark, d):
    """Scored start and end pairs, each arc and each pair once, best first."""
    return iterate.greedy_match(read(spark, d, PAIRED), ["page"], "arc", "pair", F.col("score")).select("page", "arc", "pair")
