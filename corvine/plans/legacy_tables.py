"""The second generation of resolvers on rows drawn from the driver's tables. What a pass reads is stated once, in SQL that both engines run; what it must
return is stated in SQL of its own. Spaces are 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import legacy as op
from ..registry import query, table

SP = 10.0


def t(x: float) -> str:
    """A threshold of x spaces, as the engine computes it."""
    return f"{x * SP!r}::DOUBLE"


def read(spark: SparkSession, d: str, text: str) -> DataFrame:
    return spark.sql(text, **{n: table(spark, d, n) for n in ("events", "lineitem", "orders", "part", "customer") if f"{{{n}}}" in text})


def duck(text: str) -> str:
    return text.replace("{", "").replace("}", "")


def with_(**views: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({duck(v)})" for k, v in views.items())


HEADS = "SELECT CAST(user_id AS STRING) AS page, CAST(event_id % 2 + 1 AS INT) AS staff, event_id AS id, event_id * 7919 % 5800 / CAST(10 AS DOUBLE) AS x, CAST(100 * (event_id % 2 + 1) + 5 * (CAST(floor(value) AS INT) % 9) + (event_id % 11 - 5) * 9 AS DOUBLE) AS y FROM {events} WHERE event_type IN ('view', 'click')"
LINES = "SELECT CAST(user_id AS STRING) AS page, event_id AS id, event_id * 7919 % 5800 / CAST(10 AS DOUBLE) + (event_id % 7 - 3) * 2.3 AS x, CAST(80 + event_id % 90 AS DOUBLE) AS top, CAST(100 + event_id % 90 + event_id % 13 * 12 AS DOUBLE) AS bottom FROM {events} WHERE event_id % 3 = 0"
STAVES = "SELECT DISTINCT CAST(user_id AS STRING) AS page, CAST(1 AS INT) AS staff, CAST(0 AS DOUBLE) AS left, CAST(560 AS DOUBLE) AS right, CAST(120 AS DOUBLE) AS centre, CAST(10 AS DOUBLE) AS sp FROM {events} UNION ALL SELECT DISTINCT CAST(user_id AS STRING), 2, CAST(0 AS DOUBLE), CAST(560 AS DOUBLE), CAST(220 AS DOUBLE), CAST(10 AS DOUBLE) FROM {events}"
#: The staff nearest to a point of q (page, id, x, y), for points within reach of it.
NEAREST = 'SELECT * FROM (SELECT q.* EXCLUDE (staff), s.staff, s.centre, row_number() OVER (PARTITION BY q.page, q.id ORDER BY abs(q.y - s.centre), s.staff) AS nn FROM q JOIN staves s ON q.page = s.page AND q.x BETWEEN s."left" - {0} AND s."right" + {0} AND abs(q.y - s.centre) <= {1}) WHERE nn = 1'


def staves_sql() -> str:
    return STAVES.replace("AS left", 'AS "left"').replace("AS right", 'AS "right"')


EDGES = "SELECT CAST(user_id AS STRING) AS page, event_id AS id, CAST(event_id % 4 AS INT) AS n, event_id % 50 * 4.0 + event_id % 7 AS x1, 10.0 * (event_id % 30) AS y1, event_id % 50 * 4.0 + event_id % 7 + event_id % 5 * 0.3 AS x2, 10.0 * (event_id % 30) + 7.0 * (event_id % 23) AS y2, event_id % 50 * 4.0 AS left, event_id % 50 * 4.0 + 9 + event_id % 14 AS right FROM {events}"
KNOWN = "SELECT CAST(user_id AS STRING) AS page, event_id % 50 * 4.0 + event_id % 7 + 0.55 AS x, 10.0 * (event_id % 30) + 1 AS top, 10.0 * (event_id % 30) + 7.0 * (event_id % 23) + 1 AS bottom FROM {events} WHERE event_id % 17 = 0"


@query("l05_vertical_edges", f"""{with_(g=EDGES.replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'), k=KNOWN)}, e AS (SELECT page, id, n, (x1 + x2) / 2 AS x, least(y1, y2) AS top, greatest(y1, y2) AS bottom FROM g WHERE "right" - "left" >= {t(1.35)} AND abs(y2 - y1) BETWEEN {t(1.0)} AND {t(11.0)} AND abs(x2 - x1) <= greatest({t(0.08)}, 0.08 * abs(y2 - y1)) AND least((x1 + x2) / 2 - "left", "right" - (x1 + x2) / 2) <= {t(0.28)}),
f AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.page = e.page AND abs(e.x - k.x) <= {t(0.1)} AND abs(e.top - k.top) <= {t(0.25)} AND abs(e.bottom - k.bottom) <= {t(0.25)}))
SELECT page, id, n FROM f WHERE NOT EXISTS (SELECT 1 FROM f q WHERE q.page = f.page AND (q.id < f.id OR q.id = f.id AND q.n < f.n) AND abs(f.x - q.x) <= {t(0.1)} AND abs(f.top - q.top) <= {t(0.25)} AND abs(f.bottom - q.bottom) <= {t(0.25)})""")
def l05(spark, d):
    return op.vertical_edges(read(spark, d, EDGES), read(spark, d, KNOWN), SP).select("page", "id", "n")


KINDS = "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'black' ELSE 'rest' END AS kind, event_id % 5 = 0 AS hollow, event_id % 11 * 0.1 AS scale, event_id % 2 = 0 AS filled, event_id % 7 < 4 AS has_stem, event_id % 13 < 3 AS in_meter_slot, event_id % 4 = 1 AS looks_like_three FROM {events}"


@query("l08_correct_kinds", f"""{with_(s=KINDS)} SELECT id, CASE WHEN hollow AND kind <> 'rest' THEN 'half' WHEN kind = 'unknown' AND scale BETWEEN 0.42 AND 0.82 THEN 'grace-black' WHEN kind = 'unknown' AND filled AND has_stem THEN 'black' WHEN in_meter_slot AND looks_like_three THEN 'digit-3' ELSE kind END AS kind FROM s""")
def l08(spark, d):
    return op.correct_kinds(read(spark, d, KINDS)).select("id", "kind")


CLEFS = "SELECT CAST(user_id AS STRING) AS page, event_id AS id, event_id % 60 - 9.5 AS x, 90.0 + event_id % 190 AS y, CASE event_id % 3 WHEN 0 THEN 'clef-treble' WHEN 1 THEN 'clef-bass' ELSE 'blot' END AS kind, value AS score FROM {events} WHERE event_type = 'click'"
HAVE = "SELECT DISTINCT CAST(user_id AS STRING) AS page, CAST(event_id % 2 + 1 AS INT) AS staff, CAST('clef-treble' AS STRING) AS kind FROM {events} WHERE event_type = 'signup' AND value > 60"


@query("l10_recover_clefs", f"""{with_(s=staves_sql(), c=CLEFS, e=HAVE)} SELECT page, staff, id, kind FROM (SELECT s.page, s.staff, c.id, c.kind, row_number() OVER (PARTITION BY s.page, s.staff ORDER BY c.x, c.score DESC, c.id) AS n FROM s JOIN c ON s.page = c.page AND (c.x - s."left") / s.sp BETWEEN -0.8 AND 4.5 AND abs(c.y - s.centre) <= 40 AND c.kind <> 'blot'
WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.page = s.page AND e.staff = s.staff)) WHERE n = 1""")
def l10(spark, d):
    return op.recover_clefs(read(spark, d, STAVES), read(spark, d, HAVE), read(spark, d, CLEFS)).select("page", "staff", "id", "kind")


PAINTED = "SELECT CAST(user_id AS STRING) AS page, event_id AS id, CAST(event_id % 5 AS STRING) AS source, event_id * 7919 % 2000 / CAST(10 AS DOUBLE) AS x, value AS y FROM {events} WHERE event_type = 'view'"
INSTANCES = PAINTED.replace("= 'view'", "= 'click'")


@query("l11_painted_positions", f"""{with_(e=PAINTED, i=INSTANCES)}, m AS (SELECT e.id, i.x, row_number() OVER (PARTITION BY e.page, e.id ORDER BY ((i.x - e.x) / {t(1.6)}) * ((i.x - e.x) / {t(1.6)}) + ((i.y - e.y) / {t(1.6)}) * ((i.y - e.y) / {t(1.6)}), i.id) AS n FROM e JOIN i ON e.page = i.page AND e.source = i.source AND abs((i.x - e.x) / {t(1.6)}) <= 1 AND abs((i.y - e.y) / {t(1.6)}) <= 1)
SELECT e.id, coalesce(m.x, e.x) AS x FROM e LEFT JOIN m ON m.id = e.id AND n = 1""")
def l11(spark, d):
    return op.painted_positions(read(spark, d, PAINTED), read(spark, d, INSTANCES), SP).select("id", "x")


CONTOURS = "SELECT CAST(user_id AS STRING) AS page, event_id AS id, CAST(event_id % 500 AS INT) AS points_n, event_id * 7919 % 5600 / CAST(10 AS DOUBLE) AS left, 60.0 + event_id % 170 AS top, event_id * 7919 % 5600 / CAST(10 AS DOUBLE) + 7.3 + event_id % 10 AS right, 60.0 + event_id % 170 + 21.7 + event_id % 9 AS bottom FROM {events}"
RESTS = "SELECT CAST(user_id AS STRING) AS page, CAST(event_id % 2 + 1 AS INT) AS staff, event_id * 7919 % 5600 / CAST(10 AS DOUBLE) + 5.9 AS x FROM {events} WHERE event_id % 9 = 0"


@query("l12_quarter_rests", f"""{with_(c=CONTOURS.replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'), staves=staves_sql(), r=RESTS)}, q AS (SELECT *, 0 AS staff, ("left" + "right") / 2 AS x, (top + bottom) / 2 AS y FROM c), n AS ({NEAREST.format(t(1.0), t(5.0))})
SELECT page, staff, id FROM n WHERE points_n BETWEEN 250 AND 430 AND ("right" - "left") / 10 BETWEEN 0.8 AND 1.55 AND (bottom - top) / 10 BETWEEN 2.25 AND 2.95 AND (y - centre) / 10 BETWEEN -5 AND 2.5 AND NOT EXISTS (SELECT 1 FROM r WHERE r.page = n.page AND r.staff = n.staff AND abs(n.x - r.x) <= {t(0.4)})""")
def l12(spark, d):
    return op.quarter_rests(read(spark, d, CONTOURS), read(spark, d, STAVES), read(spark, d, RESTS)).select("page", "staff", "id")


STEMLESS = f"SELECT *, CASE WHEN id % 5 = 0 THEN x + 6 END AS stem_x FROM ({HEADS})"


@query("l13_long_stems", f"""{with_(h=STEMLESS, l=LINES)} SELECT page, id, line, CASE WHEN hi < lo THEN 'down' ELSE 'up' END AS direction FROM (SELECT h.page, h.id, l.id AS line, abs(h.y - l.top) AS hi, abs(h.y - l.bottom) AS lo, row_number() OVER (PARTITION BY h.page, h.id ORDER BY abs(l.x - h.x), least(abs(h.y - l.top), abs(h.y - l.bottom)), l.id) AS n
FROM h JOIN l ON h.page = l.page AND h.stem_x IS NULL AND l.bottom - l.top BETWEEN {t(7.0)} AND {t(11.0)} AND abs(l.x - h.x) <= {t(1.12)} AND least(abs(h.y - l.top), abs(h.y - l.bottom)) <= {t(0.9)}) WHERE n = 1""")
def l13(spark, d):
    return op.long_stems(read(spark, d, STEMLESS), read(spark, d, LINES), SP).select("page", "id", "line", "direction")


DOUBLED = f"SELECT * FROM ({LINES}) UNION ALL SELECT page, id + 1000000, x + id % 4 * 0.37, top - 7, bottom + 5 FROM ({LINES})"


@query("l15_shared_stems", f"""{with_(h=HEADS, l=DOUBLED)}, m AS (SELECT h.page, h.id, l.id AS line, abs(l.x - h.x) AS dx, least(abs(h.y - l.top), abs(h.y - l.bottom)) AS gap FROM h JOIN l ON h.page = l.page AND abs(l.x - h.x) <= {t(1.12)}), a AS (SELECT *, min(dx) OVER (PARTITION BY page, id) AS lo FROM m),
b AS (SELECT *, count(*) OVER (PARTITION BY page, id) AS k FROM a WHERE dx - lo <= {t(0.08)}) SELECT page, id, line FROM (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY gap, line) AS n FROM b WHERE k >= 2 AND gap <= {t(0.9)}) WHERE n = 1""")
def l15(spark, d):
    return op.shared_stems(read(spark, d, HEADS), read(spark, d, DOUBLED), SP).select("page", "id", "line")


HALF = f"SELECT *, CASE WHEN id % 3 = 0 THEN 'black' ELSE 'half' END AS kind, CASE WHEN id % 5 = 0 THEN x + 6 END AS stem_x, CASE WHEN id % 2 = 0 THEN 'up' ELSE 'down' END AS direction FROM ({HEADS})"
LEDGERS = "SELECT CAST(user_id AS STRING) AS page, event_id * 7919 % 5800 / CAST(10 AS DOUBLE) - 20 - event_id % 9 AS left, 85.0 + event_id % 20 * 9 AS top, event_id * 7919 % 5800 / CAST(10 AS DOUBLE) + 20 AS right, 86.0 + event_id % 20 * 9 + event_id % 3 * 0.6 AS bottom FROM {events} WHERE event_id % 2 = 0"


@query("l16_stemless_hollow", f"""{with_(q=HALF, staves=staves_sql(), l=LEDGERS.replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))}, n AS ({NEAREST.format(t(2.0), t(12.0))})
SELECT id FROM q WHERE (page, id) NOT IN (SELECT (page, id) FROM n WHERE kind = 'half' AND stem_x IS NULL AND abs(y - centre) - 20 > {t(0.75)} AND NOT EXISTS (SELECT 1 FROM l WHERE l.page = n.page AND l."right" > l."left" AND l."right" - l."left" >= {t(0.75)} AND l.bottom - l.top <= {t(0.18)} AND abs((l.top + l.bottom) / 2 - n.y) <= {t(0.38)} AND n.x BETWEEN l."left" AND l."right"))""")
def l16(spark, d):
    return op.drop_stemless_hollow(read(spark, d, HALF), read(spark, d, STAVES), read(spark, d, LEDGERS)).select("id")


@query("l17_copy_stems", f"""{with_(q=HALF)}, m AS (SELECT n.page, n.id, n.x, n.y, a.id AS anchor, a.x AS ax, a.y AS ay, a.stem_x, a.direction FROM q n JOIN q a ON n.page = a.page AND n.staff = a.staff AND n.kind = 'half' AND a.kind = 'half' AND n.stem_x IS NULL AND a.stem_x IS NOT NULL AND abs(n.x - a.x) <= {t(1.3)} AND abs(n.y - a.y) <= {t(6.0)}),
w AS (SELECT *, count(*) OVER v + 1 AS k, greatest(max(y) OVER v, ay) - least(min(y) OVER v, ay) AS spread FROM m WINDOW v AS (PARTITION BY page, anchor)) SELECT page, id, stem_x, direction FROM (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY abs(x - ax), anchor) AS n FROM w WHERE k >= 3 AND spread >= {t(1.5)}) WHERE n = 1""")
def l17(spark, d):
    return op.copy_stems(read(spark, d, HALF), SP).select("page", "id", "stem_x", "direction")


SPANS = "SELECT DISTINCT CAST(user_id AS STRING) AS page, CAST(1 AS INT) AS staff, CAST(100 AS DOUBLE) AS top, CAST(140 AS DOUBLE) AS bottom FROM {events} UNION ALL SELECT DISTINCT CAST(user_id AS STRING), 2, CAST(200 AS DOUBLE), CAST(240 AS DOUBLE) FROM {events}"


@query("l18_cross_staff_chords", f"""{with_(h=HEADS, l=LINES)}, m AS (SELECT l.page, l.id AS line, l.x AS lx, h.id, h.staff, h.x, abs(h.x - l.x) AS away FROM l JOIN h ON h.page = l.page AND l.bottom - l.top BETWEEN {t(8.0)} AND {t(18.0)} AND l.top <= 140 + {t(1.4)} AND l.bottom >= 200 - {t(1.4)} AND abs(h.x - l.x) <= {t(0.82)})
SELECT page, line, array_to_string(list(id ORDER BY id), ',') AS heads, CASE WHEN lx >= avg(x) THEN 'up' ELSE 'down' END AS direction FROM m GROUP BY page, line, lx HAVING count(DISTINCT staff) >= 2 AND avg(away) <= {t(0.82)} AND min(away) <= {t(0.7)}""")
def l18(spark, d):
    c = op.cross_staff_chords(read(spark, d, HEADS), read(spark, d, LINES), read(spark, d, SPANS), SP)
    return c.select("page", "line", F.array_join(F.col("heads").cast("array<string>"), ",").alias("heads"), "direction")


MARKS = "SELECT CAST(user_id AS STRING) AS page, event_id AS id, CASE event_id % 2 WHEN 0 THEN 'sharp' ELSE 'flat' END AS kind, event_id * 7919 % 5800 / CAST(10 AS DOUBLE) - event_id % 31 * 2 AS x, 100.0 + event_id % 150 + 0.25 AS y FROM {events} WHERE event_type = 'purchase'"


@query("l22_attach_marks", f"""{with_(h=HEADS, staves=staves_sql(), m0=MARKS)}, q AS (SELECT *, 0 AS staff FROM m0), m AS ({NEAREST.format(t(1.0), t(4.0))}), p AS (SELECT m.page, m.id AS mark, m.kind, m.x AS mx, h.id, h.x - m.x AS dx, abs(h.y - m.y) AS off FROM m JOIN h ON m.page = h.page AND m.staff = h.staff AND h.x - m.x > 0 AND h.x - m.x <= {t(5.25)} AND abs(h.y - m.y) <= {t(1.35)}),
o AS (SELECT *, row_number() OVER (PARTITION BY page, mark ORDER BY round_even(off / 5, 0), off, dx, id) AS n FROM p) SELECT page, id, mark, kind FROM (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY mx DESC, mark DESC) AS k FROM o WHERE n = 1) WHERE k = 1""")
def l22(spark, d):
    return op.attach_marks(read(spark, d, MARKS), read(spark, d, HEADS), read(spark, d, STAVES)).select("page", "id", "mark", "kind")


TIMED = f"SELECT *, CAST(4 + id % 29 AS INT) AS duration FROM ({HEADS})"


@query("l23_dots", f"""{with_(h=TIMED, d=MARKS)}, p AS (SELECT h.page, h.id, h.duration, d.id AS dot, d.x AS dx, d.x - h.x AS gap, abs(d.y - h.y) AS off FROM h JOIN d ON h.page = d.page AND d.x - h.x > 0 AND d.x - h.x <= {t(3.0)} AND abs(d.y - h.y) <= {t(1.25)}), o AS (SELECT *, row_number() OVER (PARTITION BY page, dot ORDER BY off, gap, id) AS n FROM p)
SELECT page, id, dot, duration * 3 // 2 AS duration FROM (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY dx, dot) AS k FROM o WHERE n = 1) WHERE k = 1""")
def l23(spark, d):
    return op.attach_dots(read(spark, d, MARKS), read(spark, d, TIMED), SP).select("page", "id", "dot", "duration")


MIDDLE = "SELECT event_id AS id, value AS y0, value - event_id % 40 * 0.1 AS y1, value + event_id % 3 - 1 AS y2 FROM {events}"


@query("l25_arched", f"{with_(p=MIDDLE)} SELECT id, least(y0, y2) - y1 >= {t(0.15)} AS arched FROM p")
def l25(spark, d):
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.col(y).alias("y"))
    return read(spark, d, MIDDLE).select("id", op.arched(F.array(point(0, "y0"), point(1, "y1"), point(2, "y2")), SP).alias("arched"))


OPEN = "SELECT CAST(l_suppkey AS STRING) AS page, CAST(l_partkey % 4 AS INT) AS system, l_orderkey * 10 + l_linenumber AS arc, l_orderkey * 10 + l_linenumber AS note, l_linenumber % 2 = 1 AS opens FROM {lineitem} WHERE l_linenumber < 5"
PITCHED = "SELECT DISTINCT CAST(l_suppkey AS STRING) AS page, l_orderkey * 10 + l_linenumber AS id, CAST(l_linenumber % 2 AS INT) AS staff, CAST(l_partkey % 4 AS INT) AS system, CAST(l_quantity AS INT) % 12 AS pitch, l_extendedprice / 100 AS x, CAST(20 AS DOUBLE) AS system_left FROM {lineitem}"


@query("l32_cross_system_ties", f"""{with_(a=OPEN, n=PITCHED)} SELECT DISTINCT page, arc, note, "to" FROM (SELECT a.page, a.arc, a.note, m.id AS "to", row_number() OVER (PARTITION BY a.page, a.arc ORDER BY m.x, m.id) AS k FROM a JOIN n s ON a.page = s.page AND a.note = s.id AND a.opens JOIN n m ON m.page = a.page AND m.system - 1 = a.system AND m.staff = s.staff AND m.pitch = s.pitch AND m.x - m.system_left <= 80) WHERE k = 1""")
def l32(spark, d):
    return op.cross_system_ties(read(spark, d, OPEN), read(spark, d, PITCHED), SP)


WEDGES = "SELECT CAST(user_id AS STRING) AS page, event_id AS id, event_id * 7919 % 5800 / CAST(10 AS DOUBLE) AS end_x FROM {events} WHERE event_type = 'signup'"
SHAPES = "SELECT CAST(user_id AS STRING) AS page, event_id AS id, event_id * 7907 % 5800 / CAST(10 AS DOUBLE) AS x, 31.0 + event_id % 8 AS width, 12.9 + event_id % 6 AS height FROM {events} WHERE event_type = 'view'"
STANDING = "SELECT CAST(user_id AS STRING) AS page, event_id * 7901 % 5800 / CAST(10 AS DOUBLE) AS x FROM {events} WHERE event_type = 'error'"


@query("l34_terminal_dynamics", f"""{with_(w=WEDGES, s=SHAPES, k=STANDING)} SELECT page, wedge, id, 'mp' AS value FROM (SELECT w.page, w.id AS wedge, s.id, row_number() OVER (PARTITION BY w.page, w.id ORDER BY s.x, s.id) AS n FROM w JOIN s ON w.page = s.page AND s.width / 10 BETWEEN 3.25 AND 3.7 AND s.height / 10 BETWEEN 1.35 AND 1.72 AND (s.x - w.end_x) / 10 BETWEEN -0.5 AND 3
AND NOT EXISTS (SELECT 1 FROM k WHERE k.page = s.page AND abs(s.x - k.x) <= {t(0.5)})) WHERE n = 1""")
def l34(spark, d):
    return op.terminal_dynamics(read(spark, d, WEDGES), read(spark, d, SHAPES), read(spark, d, STANDING), SP)


WRITTEN = "SELECT l_suppkey AS page, l_orderkey * 100 + l_linenumber * 10 + l_partkey % 10 AS pos FROM {lineitem} WHERE l_returnflag = 'A'"
SEEN = "SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS id, l_extendedprice AS x, l_discount AS y, l_linestatus AS direction FROM {lineitem} WHERE l_returnflag = 'R'"


@query("l36_zip_by_order", f"""{with_(w=WRITTEN, s=SEEN)}, a AS (SELECT page, pos, row_number() OVER (PARTITION BY page ORDER BY pos) AS n FROM w), b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY x, id) AS n FROM s) SELECT a.page, a.pos, CAST(a.n AS INTEGER) AS n, b.x FROM a JOIN b ON a.page = b.page AND a.n = b.n""")
def l36(spark, d):
    return op.zip_by_order(read(spark, d, WRITTEN), read(spark, d, SEEN), ["page"]).select("page", "pos", "n", "x")


SIZED = "SELECT CAST(user_id AS STRING) AS page, event_id AS id, 4.0 + event_id % 13 AS width, 3.0 + event_id % 11 AS height FROM {events}"


@query("l37_grace_notes", f"""{with_(h=SIZED)}, m AS (SELECT page, quantile_cont(width, 0.5) AS mw, quantile_cont(height, 0.5) AS mh FROM h GROUP BY 1) SELECT id, width / mw BETWEEN 0.42 AND 0.82 AND height / mh BETWEEN 0.36 AND 0.72 AS grace FROM h JOIN m ON h.page = m.page""")
def l37(spark, d):
    return op.grace_notes(read(spark, d, SIZED)).select("id", "grace")


ARCS = "SELECT CAST(user_id AS STRING) AS page, event_id AS arc, event_id * 7907 % 5800 / CAST(10 AS DOUBLE) AS x0, 100.0 + event_id % 150 + 0.3 AS y0 FROM {events} WHERE event_type = 'purchase'"


@query("l40_tie_sides", f"""{with_(h=HEADS, a=ARCS)} SELECT page, id, CASE WHEN y0 < y THEN 'above' ELSE 'below' END AS side FROM (SELECT h.page, h.id, h.y, a.y0, row_number() OVER (PARTITION BY h.page, h.id ORDER BY (abs(h.x - x0) + abs(h.y - y0)) / 10, arc) AS n FROM h JOIN a ON h.page = a.page AND (abs(h.x - x0) + abs(h.y - y0)) / 10 <= 4) WHERE n = 1""")
def l40(spark, d):
    return op.tie_sides(read(spark, d, HEADS), read(spark, d, ARCS), SP)


FLAT = "SELECT CAST(user_id AS STRING) AS page, event_id AS id, CAST(60 + event_id % 200 AS INT) AS points_n, event_id * 7919 % 5600 / CAST(10 AS DOUBLE) AS left, 1.0 * (event_id % 210) AS top, event_id * 7919 % 5600 / CAST(10 AS DOUBLE) + 15.3 + event_id % 20 AS right, event_id % 210 + 4.7 + event_id % 10 AS bottom FROM {events} WHERE event_id % 4 = 0"


@query("l42_ornaments", f"""{with_(c=FLAT.replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'), staves=staves_sql(), h=HEADS)}, q AS (SELECT *, 0 AS staff, ("left" + "right") / 2 AS x, (top + bottom) / 2 AS y FROM c), n AS ({NEAREST.format(t(1.0), t(13.0))}),
g AS (SELECT * FROM n WHERE points_n >= 120 AND (centre - 20 - y) / 10 BETWEEN 2 AND 10.5 AND ("right" - "left") / 10 BETWEEN 1.8 AND 3.2 AND (bottom - top) / 10 BETWEEN 0.55 AND 1.35 AND ("right" - "left") / (bottom - top) >= 1.8)
SELECT page, ornament, id FROM (SELECT g.page, g.id AS ornament, h.id, row_number() OVER (PARTITION BY g.page, g.id ORDER BY abs(h.x - g.x), h.id) AS k FROM g JOIN h ON g.page = h.page AND g.staff = h.staff AND abs(h.x - g.x) <= {t(1.75)}) WHERE k = 1""")
def l42(spark, d):
    return op.ornaments(read(spark, d, FLAT), read(spark, d, STAVES), read(spark, d, HEADS)).select("page", "ornament", "id")


NOTES = "SELECT CAST(l_suppkey AS STRING) AS page, CAST(1 AS INT) AS part, l_partkey AS measure_pos, l_orderkey * 10 + l_linenumber AS pos, CAST(l_linenumber % 2 + 1 AS INT) AS staff, CAST(l_linenumber % 3 AS INT) AS lane, l_quantity / 8 AS onset, CAST(1 + l_orderkey % 3 AS DOUBLE) / 2 AS quarters, l_extendedprice / 1000 AS x, CASE WHEN l_linenumber < 4 THEN 'up' ELSE 'down' END AS direction FROM {lineitem}"


@query("l44_lanes", f"""{with_(n=NOTES)} SELECT page, measure_pos, pos, x, CASE WHEN direction = 'down' AND bool_or(direction = 'up') OVER w THEN 2 ELSE 1 END AS lane FROM n WINDOW w AS (PARTITION BY page, part, measure_pos, staff)""")
def l44(spark, d):
    return op.lanes_by_direction(read(spark, d, NOTES)).select("page", "measure_pos", "pos", "x", "lane")


@query("l46_lane_validity", f"""{with_(n=NOTES)}, o AS (SELECT *, onset < lag(onset + quarters) OVER (PARTITION BY page, part, measure_pos, lane ORDER BY onset, pos, quarters) - 1e-9 AS over_ FROM n) SELECT page, part, measure_pos, lane, NOT (coalesce(bool_or(over_), false) OR min(onset) < 0 OR max(onset + quarters) > 5 + 1e-9) AS valid FROM o GROUP BY ALL""")
def l46v(spark, d):
    return op.lane_validity(read(spark, d, NOTES), F.lit(5.0))


LANES = "SELECT CAST(l_suppkey AS STRING) AS page, CAST(1 AS INT) AS part, l_partkey % 40 AS measure_pos, CAST(l_linenumber AS INT) AS lane, CAST(min(l_orderkey) % 2 + 1 AS INT) AS sounding, CAST(4 + min(l_orderkey) % 3 AS DOUBLE) AS sustained, CAST(min(l_orderkey) % 4 AS DOUBLE) AS rest_total, CAST(2 + max(l_orderkey) % 4 AS DOUBLE) AS total, min(l_extendedprice) AS x FROM {lineitem} GROUP BY l_suppkey, l_partkey % 40, l_linenumber"


@query("l47_full_measure_rests", f"""{with_(l=LANES)} SELECT page, part, measure_pos, "from", "to" FROM (SELECT a.page, a.part, a.measure_pos, a.lane AS "from", b.lane AS "to", row_number() OVER (PARTITION BY a.page, a.part, a.measure_pos, a.lane ORDER BY abs(b.x - a.x), b.lane) AS n FROM l a JOIN l b ON a.page = b.page AND a.part = b.part AND a.measure_pos = b.measure_pos AND a.lane <> b.lane AND a.sounding = 1 AND a.rest_total > 0 AND abs(b.total + a.rest_total - a.sustained) < 1e-6) WHERE n = 1""")
def l47(spark, d):
    return op.full_measure_rests(read(spark, d, LANES))


BARS = "SELECT o_custkey AS page, CAST(o_orderkey % 3 AS INT) AS system, o_totalprice / 100 AS x, CAST(10 AS DOUBLE) AS sp FROM {orders}"


@query("l57_final_barlines", f"""{with_(c=BARS)} SELECT page, system, coalesce(dd / 10 BETWEEN 0.35 AND 1.25, false) AS final FROM (SELECT *, x - lead(x) OVER w AS dd, row_number() OVER w AS n FROM c WINDOW w AS (PARTITION BY page, system ORDER BY x DESC)) WHERE n = 1""")
def l57(spark, d):
    return op.final_barlines(read(spark, d, BARS))


MEASURES = "SELECT o_custkey AS page, CAST(1 AS INT) AS part, o_orderkey AS measure_pos, o_orderkey % 4 = 0 AS has_clef, CAST(o_orderkey % 3 AS INT) AS notes, CAST(o_orderkey % 2 AS INT) AS others, CAST(o_orderkey % 7 AS STRING) AS right_bar, CAST(3 + o_orderkey % 3 AS INT) AS filled FROM {orders}"


@query("l50_system_breaks", f"""{with_(m=MEASURES)} SELECT page, measure_pos, has_clef AND measure_pos > min(measure_pos) OVER (PARTITION BY page, part) AS new_system FROM m""")
def l50(spark, d):
    return op.system_breaks(read(spark, d, MEASURES)).select("page", "measure_pos", "new_system")


@query("l58_trailing_measure", f"""{with_(m=MEASURES)}, g AS (SELECT *, measure_pos = max(measure_pos) OVER w AND notes = 0 AND others = 0 AND count(*) OVER w > 1 AS gone, lead(right_bar) OVER o AS rb, lead(measure_pos) OVER o AS np FROM m WINDOW w AS (PARTITION BY page, part), o AS (PARTITION BY page, part ORDER BY measure_pos)),
k AS (SELECT *, lead(gone) OVER (PARTITION BY page, part ORDER BY measure_pos) AS taken FROM g) SELECT page, measure_pos, CASE WHEN taken THEN rb ELSE right_bar END AS right_bar FROM k WHERE NOT gone""")
def l58(spark, d):
    return op.drop_trailing(read(spark, d, MEASURES)).select("page", "measure_pos", "right_bar")


@query("l64_recover_meter", f"""{with_(m=MEASURES)}, h AS (SELECT page, part, filled, count(*) AS n FROM m GROUP BY ALL), b AS (SELECT page, part, arg_max(filled, (n, filled)) AS length FROM h GROUP BY ALL), p AS (SELECT page, part, list(filled ORDER BY filled)[CAST(floor((count(*) - 1) * 0.9) AS INTEGER) + 1] AS p90 FROM m GROUP BY ALL) SELECT b.page, b.part, length, p90 FROM b JOIN p ON b.page = p.page AND b.part = p.part WHERE p90 >= length""")
def l64(spark, d):
    return op.recover_meter(read(spark, d, MEASURES))


RUNS = "SELECT o_orderkey AS id, CAST(2 + o_orderkey % 9 AS INT) AS actual, CAST(1 + o_orderkey % 7 AS DOUBLE) AS required, CAST(1 + o_custkey % 8 AS DOUBLE) AS written FROM {orders}"


@query("l52_tuplets", f"""{with_(r=RUNS)}, n AS (SELECT *, CAST(round_even(actual * required / written, 0) AS INTEGER) AS normal FROM r) SELECT id, actual, normal FROM n WHERE required / written BETWEEN 0.45 AND 1.6 AND abs(actual * required / written - normal) <= 0.08 AND normal <> actual AND normal > 0""")
def l52(spark, d):
    return op.tuplets(read(spark, d, RUNS)).select("id", "actual", "normal")


TAGGED = "SELECT CAST(o_custkey % 50 AS STRING) AS page, CAST(1 AS INT) AS part, o_custkey % 7 AS measure_pos, o_orderkey AS pos, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 23 END AS tag, o_orderkey % 61 AS source, CAST(o_orderkey % 2 + 1 AS INT) AS staff, CAST(o_orderkey % 4 AS INT) AS voice, CAST(o_orderkey % 37 AS INT) AS pitch_index FROM {orders}"


@query("l53_restore_cross_staff", f"""{with_(n=TAGGED)}, o AS (SELECT *, row_number() OVER (PARTITION BY page, part, measure_pos, tag, source ORDER BY pos) AS k FROM n WHERE tag IS NOT NULL), g AS (SELECT page, part, measure_pos, pos, tag, staff, pitch_index, min(voice) OVER w AS voice, min(staff) OVER w <> max(staff) OVER w AS two FROM o WHERE k = 1 WINDOW w AS (PARTITION BY page, part, measure_pos, tag))
SELECT pos, voice, row_number() OVER (PARTITION BY page, part, measure_pos, tag ORDER BY staff DESC, pitch_index, pos) > 1 AS is_chord FROM g WHERE two""")
def l53(spark, d):
    return op.restore_cross_staff(read(spark, d, TAGGED)).select("pos", "voice", "is_chord")


SIGNS = "SELECT CAST(l_suppkey AS STRING) AS page, CAST(1 AS INT) AS part, l_partkey % 30 AS measure_pos, l_orderkey * 10 + l_linenumber AS pos, CAST(l_linenumber % 2 AS INT) AS staff, CAST(l_orderkey % 3 AS STRING) AS step, CAST(l_partkey % 2 AS INT) AS octave, l_quantity AS onset, CASE WHEN l_orderkey % 4 = 0 THEN 'sharp' END AS accidental, CAST(l_linenumber % 3 - 1 AS INT) AS alter, CAST(l_suppkey % 2 AS INT) AS key_alter, l_extendedprice AS price FROM {lineitem}"


@query("l54_accidental_state", f"""{with_(n0=SIGNS.replace("AS alter,", 'AS "alter",'))}, n AS (SELECT DISTINCT ON (page, measure_pos, staff, step, octave, onset, pos) * FROM n0 ORDER BY page, measure_pos, staff, step, octave, onset, pos, price)
SELECT page, measure_pos, pos, onset, coalesce(last_value(CASE WHEN accidental IS NOT NULL THEN "alter" END IGNORE NULLS) OVER (PARTITION BY page, part, measure_pos, staff, step, octave ORDER BY onset, accidental IS NULL, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), key_alter) AS in_force FROM n""")
def l54(spark, d):
    keys = ["page", "measure_pos", "staff", "step", "octave", "onset", "pos"]
    return op.accidental_state(op.first_per(read(spark, d, SIGNS), keys, ["price"])).select("page", "measure_pos", "pos", "onset", "in_force")


SEGMENTS = "SELECT DISTINCT CAST(user_id AS STRING) AS page, CAST(k AS INT) AS measure_pos, 100.0 * k AS left, 100.0 * (k + 1) AS right, CAST(16 + k AS INT) AS duration, k = 4 AS is_last FROM {events} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4)"
PLACED = "SELECT CAST(user_id AS STRING) AS page, event_id AS id, CAST(event_id * 7919 % 5200 AS DOUBLE) / 10 AS x FROM {events}"


@query("l55_place_marks", f"""{with_(s=SEGMENTS.replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'), m=PLACED)} SELECT m.id, s.measure_pos, CAST(least(greatest(round_even((m.x - s."left") / (s."right" - s."left") * s.duration, 0), 0), s.duration) AS INTEGER) AS "offset" FROM m JOIN s ON m.page = s.page AND m.x >= s."left" AND (m.x < s."right" OR s.is_last AND m.x <= s."right")""")
def l55(spark, d):
    return op.place_marks(read(spark, d, PLACED), read(spark, d, SEGMENTS)).select("id", "measure_pos", "offset")


REPEATED = "SELECT o_custkey AS page, o_orderkey AS pos, CASE o_orderkey % 3 WHEN 0 THEN 'G' WHEN 1 THEN 'F' END AS clef FROM {orders}"


@query("l60_repeated_clefs", f"""{with_(m=REPEATED)}, w AS (SELECT *, last_value(clef IGNORE NULLS) OVER (PARTITION BY page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM m) SELECT page, pos, CASE WHEN clef IS DISTINCT FROM was THEN clef END AS clef FROM w""")
def l60(spark, d):
    return op.drop_repeated(read(spark, d, REPEATED), ["page"], ["pos"], "clef")


TEXTS = "SELECT CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey % 400 AS INT) END AS measure, CAST(o_orderkey % 2 + 1 AS INT) AS staff, CASE o_orderkey % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'R' END AS align, concat(o_orderpriority, ' ', o_orderstatus, ' in a longer line of text ', CAST(o_orderkey AS STRING)) AS value FROM {orders}"
NUMBERED = "SELECT CAST(c_nationkey AS STRING) AS page, c_custkey AS measure_pos, CAST(c_custkey % 300 AS INT) AS number FROM {customer}"


@query("l61_place_text", f"""{with_(x=TEXTS, m=NUMBERED)} SELECT m.page, m.measure_pos, x.staff, x.align, x.value[1:25] AS text, CASE WHEN x.measure = 1 AND x.staff = 1 AND x.align = 'L' THEN 'tempo' ELSE 'words' END AS kind FROM x JOIN m ON x.measure = m.number""")
def l61(spark, d):
    return op.place_text(read(spark, d, TEXTS), read(spark, d, NUMBERED))


FAR = "SELECT CAST(user_id AS STRING) AS page, event_id AS id, event_id * 7919 % 7000 / CAST(10 AS DOUBLE) - 50 AS x, CAST(40 + event_id * 31 % 300 AS DOUBLE) AS y, CAST(NULL AS DOUBLE) AS stem_x FROM {events}"


@query("l09_events_on_staves", f"""{with_(q0=FAR, staves=staves_sql())}, q AS (SELECT *, 0 AS staff FROM q0) SELECT id, staff FROM ({NEAREST.format(t(2.0), t(5.0))})""")
def l09(spark, d):
    return op.nearest_staff(read(spark, d, FAR), read(spark, d, STAVES), 2.0, 5.0).select("id", "staff")


@query("l14_relations", f"""{with_(h=STEMLESS, l=LINES, staves=staves_sql())}, q AS (SELECT * FROM h), n AS ({NEAREST.format(t(2.0), t(5.0))}), m AS (SELECT h.page, h.id, l.id AS line, abs(h.y - l.top) AS hi, abs(h.y - l.bottom) AS lo, row_number() OVER (PARTITION BY h.page, h.id ORDER BY abs(l.x - h.x), least(abs(h.y - l.top), abs(h.y - l.bottom)), l.id) AS n
FROM h JOIN l ON h.page = l.page AND h.stem_x IS NULL AND l.bottom - l.top BETWEEN {t(7.0)} AND {t(11.0)} AND abs(l.x - h.x) <= {t(1.12)} AND least(abs(h.y - l.top), abs(h.y - l.bottom)) <= {t(0.9)}) SELECT n.id, n.staff, m.line, CASE WHEN hi < lo THEN 'down' ELSE 'up' END AS direction FROM n JOIN m ON n.page = m.page AND n.id = m.id WHERE m.n = 1""")
def l14(spark, d):
    """Heads get their staff and their stem, and the stem its direction."""
    h = read(spark, d, STEMLESS)
    on = op.nearest_staff(h, read(spark, d, STAVES), 2.0, 5.0).select("page", "id", "staff")
    return on.join(op.long_stems(h, read(spark, d, LINES), SP), ["page", "id"]).select("id", "staff", "line", "direction")


UPRIGHT = "SELECT CAST(user_id AS STRING) AS page, event_id AS id, event_id * 7919 % 3000 / CAST(10 AS DOUBLE) AS stem_x, CAST(20 + event_id % 40 AS DOUBLE) AS stem_top, CAST(60 + event_id % 40 AS DOUBLE) AS stem_bottom FROM {events} WHERE event_id % 3 = 0"
STRIPS = "SELECT CAST(user_id AS STRING) AS page, event_id AS id, event_id * 7907 % 3000 / CAST(10 AS DOUBLE) AS x0, CAST(15 + event_id % 60 AS DOUBLE) AS y0, event_id * 7907 % 3000 / CAST(10 AS DOUBLE) + 9 + event_id % 70 AS x1, CAST(15 + event_id % 60 + event_id % 9 - 4 AS DOUBLE) AS y1, CAST(event_id % 17 AS INT) AS points_n, CAST(event_id % 70 * 4 AS DOUBLE) AS area FROM {events} WHERE event_id % 4 = 1"


def strip_sql(groups: int) -> str:
    return f"""{with_(s=UPRIGHT, b=STRIPS)}, g AS (SELECT * FROM b WHERE points_n BETWEEN 3 AND 14 AND x1 - x0 >= {t(1.15)} AND area / sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) BETWEEN {t(0.05)} AND {t(0.62)} AND (x1 - x0) / greatest(abs(y1 - y0), 1e-9) >= 1.45),
y AS (SELECT g.page, g.id AS strip, s.id, round_even(stem_x / {0.12 * SP!r}::DOUBLE, 0) AS slot, y0 + (y1 - y0) * (stem_x - x0) / (x1 - x0) AS y, stem_top, stem_bottom FROM g JOIN s ON g.page = s.page AND stem_x BETWEEN x0 - {t(0.25)} AND x1 + {t(0.25)}), m AS (SELECT * FROM y WHERE greatest(stem_top - y, y - stem_bottom, 0) <= {t(0.5)}),
r AS (SELECT *, dense_rank() OVER (PARTITION BY page, strip ORDER BY slot) AS n FROM m), o AS (SELECT *, max(n) OVER (PARTITION BY page, strip) AS k FROM r), p AS (SELECT * FROM o WHERE k >= {groups})
SELECT page, strip, id, CASE n WHEN 1 THEN 'begin' WHEN k THEN 'end' ELSE 'continue' END AS position, CAST(least(count(*) OVER (PARTITION BY page, id), 4) AS INTEGER) AS level FROM p"""


@query("l19_l21_strip_members", strip_sql(2))
def l19(spark, d):
    return op.strip_members(read(spark, d, UPRIGHT), read(spark, d, STRIPS), SP)


@query("l28_beam_hooks", strip_sql(1))
def l28(spark, d):
    """A short strip at one stem counts as a hook: one group is enough."""
    return op.strip_members(read(spark, d, UPRIGHT), read(spark, d, STRIPS), SP, groups=1)


TUNED = f"SELECT page, staff, id, x, y, CAST(id % 5 AS STRING) AS pitch FROM ({HEADS})"
BOWS = "SELECT CAST(user_id AS STRING) AS page, event_id AS arc, event_id * 7907 % 5000 / CAST(10 AS DOUBLE) AS x0, CAST(100 + event_id % 140 AS DOUBLE) + 0.3 AS y0, event_id * 7907 % 5000 / CAST(10 AS DOUBLE) + 11 + event_id % 90 AS x1, CAST(100 + event_id % 130 AS DOUBLE) + 0.7 AS y1, CAST(event_id % 29 AS INT) AS points_n FROM {events} WHERE event_type = 'purchase'"


def arc_sql(arcs: str, dx: float, most: float) -> str:
    """All pairs in order of score, arc and pair, each taken if both are free."""
    return f"""{with_(h=TUNED, a0=BOWS).replace("WITH", "WITH RECURSIVE", 1)}, a AS ({arcs}), s AS (SELECT a.page, a.arc, h.id, h.pitch, h.x, abs(h.x - x0) + 0.9 * abs(h.y - y0) AS c FROM a JOIN h ON a.page = h.page AND abs(h.x - x0) <= {dx * SP!r}::DOUBLE), e AS (SELECT a.page, a.arc, h.id, h.pitch, h.x, abs(h.x - x1) + 0.9 * abs(h.y - y1) AS c FROM a JOIN h ON a.page = h.page AND abs(h.x - x1) <= {dx * SP!r}::DOUBLE),
p AS (SELECT s.page, s.arc, s.id AS a, e.id AS b, s.x, s.pitch = e.pitch AS same, (s.c + e.c) / 10 - CASE WHEN s.pitch = e.pitch THEN 1.65 ELSE 0 END AS score FROM s JOIN e ON s.page = e.page AND s.arc = e.arc AND s.id <> e.id AND s.x < e.x), o AS (SELECT *, a || ':' || b AS pair, row_number() OVER (PARTITION BY page ORDER BY score, arc, a || ':' || b) AS n FROM p WHERE score <= {most}),
r(page, n, arcs, pairs) AS (SELECT DISTINCT page, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]) FROM o UNION ALL SELECT page, k, CASE WHEN free THEN list_append(arcs, arc) ELSE arcs END, CASE WHEN free THEN list_append(pairs, pair) ELSE pairs END FROM (SELECT r.*, o.arc, o.pair, o.n AS k, NOT list_contains(r.arcs, o.arc) AND NOT list_contains(r.pairs, o.pair) AS free FROM r JOIN o ON o.page = r.page AND o.n = r.n + 1)),
f AS (SELECT page, arg_max(arcs, n) AS arcs, arg_max(pairs, n) AS pairs FROM r GROUP BY 1), u AS (SELECT page, unnest(arcs) AS arc, unnest(pairs) AS pair FROM f) SELECT u.page, u.arc, o.a, o.b, CASE WHEN same THEN 'tie' ELSE 'slur' END AS kind, CASE WHEN NOT same THEN CAST(row_number() OVER (PARTITION BY u.page, same ORDER BY x, u.arc) AS INTEGER) END AS number FROM u JOIN o ON u.page = o.page AND u.arc = o.arc AND u.pair = o.pair"""


@query("l24_pair_arcs", arc_sql("SELECT * FROM a0", 2.25, 10.0))
def l24(spark, d):
    return op.pair_arcs(read(spark, d, BOWS), read(spark, d, TUNED), SP)


@query("l26_long_arcs", arc_sql("SELECT * FROM a0 WHERE x1 - x0 >= 60", 2.6, 7.0))
def l26(spark, d):
    """Wider windows for long arcs, a stricter score."""
    return op.pair_arcs(read(spark, d, BOWS).where("x1 - x0 >= 60"), read(spark, d, TUNED), SP, dx=2.6, most=7.0)


@query("l30_compact_arcs", arc_sql("SELECT * FROM a0 WHERE points_n >= 16 AND (x1 - x0) / 10 BETWEEN 1.1 AND 1.55", 1.0, 7.5))
def l30(spark, d):
    a = read(spark, d, BOWS).where((F.col("points_n") >= 16) & ((F.col("x1") - F.col("x0")) / 10).between(1.10, 1.55))
    return op.pair_arcs(a, read(spark, d, TUNED), SP, dx=1.0, most=7.5)


STEMMED = f"SELECT page, staff, id, x + 6 AS stem_x, CASE WHEN id % 2 = 0 THEN 'up' ELSE 'down' END AS direction, y - 30 AS stem_top, y + 30 AS stem_bottom, id % 4 = 0 AS beamed FROM ({HEADS})"
LOOSE = "SELECT CAST(user_id AS STRING) AS page, event_id AS id, event_id * 7907 % 5800 / CAST(10 AS DOUBLE) AS x, CAST(60 + event_id % 210 AS DOUBLE) + 0.4 AS y FROM {events} WHERE event_type = 'purchase'"


@query("l29_standalone_flags", f"""{with_(h=STEMMED, f=LOOSE).replace("WITH", "WITH RECURSIVE", 1)}, s AS (SELECT *, CASE WHEN direction = 'up' THEN stem_top ELSE stem_bottom END AS tip, CASE WHEN direction = 'up' THEN 1 ELSE -1 END AS turn FROM (SELECT *, row_number() OVER (PARTITION BY page, staff, round_even(stem_x / {t(0.2)}, 0) ORDER BY id) AS k FROM h WHERE NOT beamed) WHERE k = 1),
p AS (SELECT s.page, s.id, f.id AS flag, (f.x - stem_x) / 10 AS dx, (f.y - tip) * turn / 10 AS dy FROM s JOIN f ON s.page = f.page), o AS (SELECT page, id, flag, row_number() OVER (PARTITION BY page ORDER BY 0.7 * abs(dx) + abs(dy), id, flag) AS n FROM p WHERE dx BETWEEN -0.3 AND 1.85 AND dy BETWEEN 0.1 AND 2.55),
r(page, n, a, b) AS (SELECT DISTINCT page, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM o UNION ALL SELECT r.page, o.n, CASE WHEN list_contains(a, id) OR list_contains(b, flag) THEN a ELSE list_append(a, id) END, CASE WHEN list_contains(a, id) OR list_contains(b, flag) THEN b ELSE list_append(b, flag) END FROM r JOIN o ON o.page = r.page AND o.n = r.n + 1),
g AS (SELECT page, arg_max(a, n) AS a, arg_max(b, n) AS b FROM r GROUP BY 1) SELECT page, unnest(a) AS id, unnest(b) AS flag FROM g""")
def l29(spark, d):
    return op.standalone_flags(read(spark, d, STEMMED), read(spark, d, LOOSE), SP)


LOUD = "SELECT CAST(user_id AS STRING) AS page, event_id AS id, event_id * 7919 % 5800 / CAST(10 AS DOUBLE) AS x, CAST(100 + event_id * 31 % 150 AS DOUBLE) AS y, CASE event_id % 6 WHEN 0 THEN 'dynamic-ff' WHEN 1 THEN 'Dynamic_sfz' WHEN 2 THEN 'dynamicmp' WHEN 3 THEN 'dynamic-loud' ELSE 'hairpin' END AS kind, CAST(40 + event_id % 200 AS DOUBLE) AS width, CAST(5 + event_id % 25 AS DOUBLE) AS height, CASE WHEN event_id % 6 >= 4 THEN event_id % 2 = 0 END AS tip_left FROM {events}"


@query("l33_dynamics", f"""{with_(s=LOUD)}, v AS (SELECT *, coalesce(CASE WHEN tip_left IS NOT NULL AND width / 10 BETWEEN 5.5 AND 20 AND height / 10 BETWEEN 0.65 AND 2.5 THEN CASE WHEN tip_left THEN 'crescendo' ELSE 'diminuendo' END END, CASE lower(kind) WHEN 'dynamic-ff' THEN 'ff' WHEN 'dynamic_sfz' THEN 'sfz' WHEN 'dynamicmp' THEN 'mp' END) AS value FROM s WHERE y BETWEEN 140 AND 200),
l AS (SELECT *, x - lag(x) OVER (PARTITION BY page, value ORDER BY x, id) AS gap FROM v WHERE value IS NOT NULL) SELECT page, id, value, x FROM l WHERE gap IS NULL OR gap > 3.5""")
def l33(spark, d):
    return op.dynamics(read(spark, d, LOUD), read(spark, d, STAVES)).select("page", "id", "value", "x")


PIECES = "SELECT CAST(user_id AS STRING) AS page, CAST(event_id % 3 AS INT) AS x, CAST(event_id * 7919 % 40000 AS DOUBLE) AS top, CAST(event_id * 7919 % 40000 + event_id % 400 AS DOUBLE) AS bottom FROM {events}"


@query("l35_barline_chains", f"""{with_(p=PIECES)}, w AS (SELECT *, max(bottom) OVER (PARTITION BY page, x ORDER BY top, bottom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM p), g AS (SELECT *, sum(CASE WHEN far IS NULL OR top > far + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY page, x ORDER BY top, bottom ROWS UNBOUNDED PRECEDING) AS chain FROM w) SELECT page, x, CAST(chain AS INTEGER) AS chain, min(top) AS top, max(bottom) AS bottom FROM g GROUP BY ALL""")
def l35(spark, d):
    """Pieces at one x that touch within half a space are one bar."""
    from ..operators import windows as win

    return win.merge_islands(read(spark, d, PIECES), ["page", "x"], "top", "bottom", 5.0, "chain").groupBy("page", "x", F.col("chain").cast("int")).agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"))


@query("l38_default_x", f"""{with_(w=WRITTEN, s=SEEN)}, a AS (SELECT page, pos, row_number() OVER (PARTITION BY page ORDER BY pos) AS n FROM w), b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY x, id) AS n FROM s) SELECT a.page, a.pos, a.n, 60 + 10 * (b.x - 10) / 10 AS default_x FROM a JOIN b ON a.page = b.page AND a.n = b.n""", n="INTEGER")
def l38(spark, d):
    return op.zip_by_order(read(spark, d, WRITTEN), read(spark, d, SEEN), ["page"]).select("page", "pos", "n", (60 + 10 * (F.col("x") - 10.0) / 10).alias("default_x"))


@query("l39_rest_y", f"""{with_(w=WRITTEN, s=SEEN)}, a AS (SELECT page, pos, row_number() OVER (PARTITION BY page ORDER BY pos) AS n FROM w), b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY x, id) AS n FROM s) SELECT a.page, a.pos, a.n, b.x, -(b.y - 100) AS default_y FROM a JOIN b ON a.page = b.page AND a.n = b.n""", n="INTEGER")
def l39(spark, d):
    return op.zip_by_order(read(spark, d, WRITTEN), read(spark, d, SEEN), ["page"]).select("page", "pos", "n", "x", (-(F.col("y") - 100.0)).alias("default_y"))


@query("l41_naturals", f"""{with_(h=HEADS, staves=staves_sql(), m0=MARKS)}, q AS (SELECT *, 0 AS staff FROM m0), m AS ({NEAREST.format(t(1.0), t(4.0))}), p AS (SELECT m.page, m.id AS mark, m.kind, m.x AS mx, h.id, h.x - m.x AS dx, abs(h.y - m.y) AS off FROM m JOIN h ON m.page = h.page AND m.staff = h.staff AND h.x - m.x > 0 AND h.x - m.x <= {t(5.25)} AND abs(h.y - m.y) <= {t(1.35)}),
o AS (SELECT *, row_number() OVER (PARTITION BY page, mark ORDER BY round_even(off / 5, 0), off, dx, id) AS n FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY mx DESC, mark DESC) AS k FROM o WHERE n = 1) SELECT h.id, CASE WHEN k.id IS NULL THEN h.id % 3 - 1 END AS alter_by, CASE WHEN k.id IS NOT NULL THEN 'natural' END AS accidental FROM h LEFT JOIN k ON h.id = k.id AND k = 1""", alter_by="BIGINT")
def l41(spark, d):
    """A natural is written and takes the alteration away."""
    h = read(spark, d, HEADS)
    m = op.attach_marks(read(spark, d, MARKS).withColumn("kind", F.lit("natural")), h, read(spark, d, STAVES)).select("page", "id", F.col("kind").alias("accidental"))
    return h.join(m, ["page", "id"], "left").select("id", F.when(F.col("accidental").isNull(), F.col("id") % 3 - 1).alias("alter_by"), "accidental")


WAITING = "SELECT CAST(l_suppkey AS STRING) AS page, CAST(1 AS INT) AS part, l_partkey AS measure_pos, l_orderkey * 10 + l_linenumber AS pos, l_quantity / 8 AS at FROM {lineitem} WHERE l_linenumber = 7"


@query("l45_free_lane", f"""{with_(n=NOTES, r=WAITING)}, m AS (SELECT r.page, r.measure_pos, r.pos, n.lane, bool_or(n.onset <= r."at" AND r."at" < n.onset + n.quarters) AS busy FROM r JOIN n ON r.page = n.page AND r.part = n.part AND r.measure_pos = n.measure_pos GROUP BY ALL) SELECT page, measure_pos, pos, min(lane) AS lane FROM m WHERE NOT busy GROUP BY ALL""".replace("AS at FROM", 'AS "at" FROM'))
def l45(spark, d):
    """A rest goes to the first lane that does not sound at its onset."""
    n, r = read(spark, d, NOTES), read(spark, d, WAITING)
    met = r.join(n.drop("pos"), op.MEASURE).withColumn("busy", (F.col("onset") <= F.col("at")) & (F.col("at") < F.col("onset") + F.col("quarters")))
    free = met.groupBy("page", "measure_pos", "pos", "lane").agg(F.bool_or("busy").alias("busy")).where("not busy")
    return free.groupBy("page", "measure_pos", "pos").agg(F.min("lane").alias("lane"))


ONE_NOTE = "SELECT CAST(l_suppkey AS STRING) AS page, CAST(1 AS INT) AS part, l_partkey % 50 AS measure_pos, l_orderkey * 10 + l_linenumber AS pos, CAST(l_linenumber % 3 AS INT) AS lane, min(CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE l_quantity / 8 END) AS onset, CAST(1 + l_orderkey % 3 AS DOUBLE) / 2 AS quarters, min(l_extendedprice) / 1000 AS x FROM {lineitem} GROUP BY l_suppkey, l_partkey % 50, l_orderkey, l_linenumber"


@query("l48_delayed_onsets", f"""{with_(n=ONE_NOTE)}, f AS (SELECT *, row_number() OVER (PARTITION BY page, measure_pos, lane ORDER BY x, pos) AS k, sum(quarters) OVER (PARTITION BY page, measure_pos, lane) AS total FROM n), l AS (SELECT *, min(x) OVER w AS x0, max(total) OVER w AS most FROM f WHERE k = 1 WINDOW w AS (PARTITION BY page, measure_pos)),
o AS (SELECT l.page, l.measure_pos, l.lane, n.onset AS forward, row_number() OVER (PARTITION BY l.page, l.measure_pos, l.lane ORDER BY abs(n.x - l.x), n.pos) AS k FROM l JOIN n ON l.page = n.page AND l.measure_pos = n.measure_pos AND l.lane <> n.lane AND abs(n.x - l.x) <= 12 WHERE l.onset = 0 AND l.x - l.x0 >= 18 AND l.total < l.most) SELECT page, measure_pos, lane, forward FROM o WHERE k = 1 AND forward > 0""")
def l48(spark, d):
    return op.delayed_onsets(read(spark, d, ONE_NOTE)).select("page", "measure_pos", "lane", "forward")


@query("l49_lane_offsets", f"""{with_(n=ONE_NOTE)}, l AS (SELECT page, measure_pos, lane, sum(quarters) AS total, min(x) AS x0 FROM n GROUP BY ALL), r AS (SELECT page, measure_pos, lane AS ruler FROM (SELECT *, row_number() OVER (PARTITION BY page, measure_pos ORDER BY total DESC, x0, lane) AS k FROM l) WHERE k = 1)
SELECT l.page, l.measure_pos, l.lane, sum(CASE WHEN n.x < l.x0 - 1e-6 THEN n.quarters ELSE 0 END) AS "offset" FROM l JOIN r ON l.page = r.page AND l.measure_pos = r.measure_pos AND l.lane <> r.ruler JOIN n ON n.page = l.page AND n.measure_pos = l.measure_pos AND n.lane = r.ruler GROUP BY ALL""")
def l49(spark, d):
    return op.lane_offsets(read(spark, d, ONE_NOTE).withColumn("is_chord", F.lit(False))).select("page", "measure_pos", "lane", "offset")


BEAMED = "SELECT CAST(o_custkey AS STRING) AS page, CAST(1 AS INT) AS part, CAST(1 AS INT) AS measure_pos, o_orderkey AS pos, CAST(o_orderkey % 2 AS INT) AS voice, CAST(1 AS INT) AS staff, CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderkey % 3 AS INT) END AS beam, CAST(1 + o_orderkey % 4 AS INT) AS level FROM {orders}"


@query("l51_secondary_beams", f"""{with_(n=BEAMED)}, b AS (SELECT *, coalesce(lag(level) OVER w, 0) AS l, coalesce(lead(level) OVER w, 0) AS r, row_number() OVER w = 1 AS first FROM n WHERE beam IS NOT NULL WINDOW w AS (PARTITION BY page, measure_pos, voice, staff, beam ORDER BY pos)), u AS (SELECT *, unnest(generate_series(2, level)) AS number FROM b WHERE level >= 2)
SELECT page, pos, CAST(number AS INTEGER) AS number, CASE WHEN l >= number AND r >= number THEN 'continue' WHEN l >= number THEN 'end' WHEN r >= number THEN 'begin' WHEN first THEN 'forward hook' ELSE 'backward hook' END AS mark FROM u""")
def l51(spark, d):
    return op.secondary_beams(read(spark, d, BEAMED)).select("page", "pos", "number", "mark")


BRACKETS = "SELECT CAST(user_id AS STRING) AS page, event_id AS id, CAST(event_id * 7919 % 5000 AS DOUBLE) / 10 AS left, CAST(230 + event_id % 130 AS DOUBLE) AS top, CAST(event_id * 7919 % 5000 AS DOUBLE) / 10 + 30 + event_id * 13 % 450 AS right, CAST(240 + event_id % 130 + event_id % 23 AS DOUBLE) AS bottom, CAST(event_id % 10 AS DOUBLE) / 10 AS run_share, event_id % 2 = 0 AS hook FROM {events}"


@query("l56_sustain", f"""{with_(c=BRACKETS.replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))}, g AS (SELECT * FROM c WHERE ("right" - "left") / 10 BETWEEN 5 AND 42 AND bottom - top <= {t(2.8)} AND (top - 220 - 20) / 10 BETWEEN 1.2 AND 9 AND run_share >= 0.55 AND (hook OR "right" - "left" >= 80))
SELECT page, id FROM (SELECT *, row_number() OVER (PARTITION BY page, round_even("left" / 4, 0), round_even("right" / 4, 0) ORDER BY id) AS n FROM g) WHERE n = 1""")
def l56(spark, d):
    return op.sustain_brackets(read(spark, d, BRACKETS), read(spark, d, STAVES)).select("page", "id")


SHEETS = "SELECT CAST(o_custkey AS STRING) AS page, CAST(o_custkey % 10 AS STRING) AS part, o_orderkey AS measure_pos, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 7 AS STRING) END AS meter, o_orderkey % 11 = 0 AS new_system FROM {orders}"
SHEET_ORDER = "SELECT CAST(c_custkey AS STRING) AS page, CAST(c_custkey * 7919 % 100003 AS INT) AS n FROM {customer}"


@query("l59_join_pages", f"""{with_(m=SHEETS, p=SHEET_ORDER)}, j AS (SELECT m.*, p.n FROM m JOIN p ON m.page = p.page) SELECT part, measure_pos, last_value(meter IGNORE NULLS) OVER (PARTITION BY part ORDER BY n, measure_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS meter, CAST(row_number() OVER (PARTITION BY part ORDER BY n, measure_pos) AS INTEGER) AS number, new_system OR row_number() OVER (PARTITION BY part, n ORDER BY measure_pos) = 1 AND n > 1 AS new_system FROM j""")
def l59(spark, d):
    return op.join_pages(read(spark, d, SHEETS), read(spark, d, SHEET_ORDER)).select("part", "measure_pos", "meter", "number", "new_system")


RHYTHM = f"SELECT page, staff, id, x, CASE WHEN id % 2 = 0 THEN 'up' ELSE 'down' END AS direction, CAST(id % 3 AS INT) AS dots, CAST(4 + id % 5 * 4 AS INT) AS denominator FROM ({HEADS})"


@query("l27_chord_rhythm", f"""{with_(h=RHYTHM).replace("WITH", "WITH RECURSIVE", 1)}, s AS (SELECT page, staff, direction, list({{'x': x, 'id': id, 'dots': dots, 'd': denominator}} ORDER BY x, id) AS v FROM h GROUP BY ALL),
r(page, staff, direction, v, i, total, n, g, gs) AS (SELECT *, 2, v[1].x, 1, 0, [0] FROM s UNION ALL SELECT page, staff, direction, v, i + 1, CASE WHEN far THEN v[i].x ELSE total + v[i].x END, CASE WHEN far THEN 1 ELSE n + 1 END, CASE WHEN far THEN g + 1 ELSE g END, list_append(gs, CASE WHEN far THEN g + 1 ELSE g END) FROM (SELECT *, v[i].x - total / n > 8.0 AS far FROM r WHERE i <= len(v))),
u AS (SELECT page, staff, direction, unnest(v) AS e, unnest(gs) AS g FROM r WHERE i > len(v)) SELECT e.id AS id, max(e.dots) OVER w AS dots, max(e.d) OVER w AS denominator FROM u WINDOW w AS (PARTITION BY page, staff, direction, g)""")
def l27(spark, d):
    return op.chord_rhythm(read(spark, d, RHYTHM), 8.0).select("id", "dots", "denominator")
