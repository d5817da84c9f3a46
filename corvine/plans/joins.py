"""Join operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import scalar as fn
from ..operators import joins as op
from ..operators import neighbours, vectors
from ..registry import query, table


@query("j01_dimension_lookup", """SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def j01(spark, d):
    """Facts are counted per key before they meet the dimensions."""
    per = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("k"))
    both = per.join(table(spark, d, "nation"), per["c_nationkey"] == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.groupBy("n_name", "r_name").agg(F.sum("k").alias("customers"))


@query("j02_lookup_with_fallback", "SELECT o_orderkey, coalesce(c_mktsegment, 'none') AS segment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def j02(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    o = table(spark, d, "orders")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("none")).alias("segment"))


@query("j03_outer_then_carry", """WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_size FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 10) ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, last_value(p_size IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS size FROM m""")
def j03(spark, d):
    p = table(spark, d, "part").where("p_size <= 10").select("p_partkey", "p_size")
    m = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    return m.select("l_orderkey", "l_linenumber", F.last("p_size", ignorenulls=True).over(w).alias("size"))


@query("j04_key_lists", """WITH k AS (SELECT l_suppkey, unnest(list(DISTINCT l_partkey)) AS p FROM lineitem GROUP BY 1) SELECT l_suppkey, count(*) AS parts, max(p_size) AS largest FROM k JOIN part ON p = p_partkey GROUP BY 1""")
def j04(spark, d):
    k = table(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey")).distinct()
    return k.join(table(spark, d, "part"), "p_partkey").groupBy("l_suppkey").agg(F.count("*").alias("parts"), F.max("p_size").alias("largest"))


RECTS = """SELECT l_orderkey AS id, l_linenumber AS n, l_suppkey AS page, l_quantity AS "left", l_quantity + 2 AS "right", l_discount * 100 AS top, l_discount * 100 + 1 AS bottom FROM lineitem"""


def rects(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey id", "l_linenumber n", "l_suppkey page", "l_quantity `left`", "l_quantity + 2 `right`", "l_discount * 100 top", "l_discount * 100 + 1 bottom")


@query("j05_intersection_count", f"""WITH r AS ({RECTS}), a AS (SELECT * FROM r WHERE n = 1), b AS (SELECT * FROM r WHERE n = 2) SELECT a.id, count(DISTINCT b.id) AS blocks, count(DISTINCT b.id) = 1 AS unique_block
FROM a JOIN b ON a.page = b.page AND a."left" <= b."right" AND b."left" <= a."right" AND a.top <= b.bottom AND b.top <= a.bottom GROUP BY 1""")
def j05(spark, d):
    """Rectangles that meet on one page, by cells of both axes."""
    r = rects(spark, d)
    met = neighbours.rect_join(r.where("n = 1"), r.where("n = 2"), ["page"])
    return met.groupBy(F.col("l_id").alias("id")).agg(F.count_distinct("r_id").alias("blocks")).withColumn("unique_block", F.col("blocks") == 1)


@query("j06_band_semi", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM part p WHERE abs(l.l_extendedprice / 10 - p.p_retailprice) <= 0.5)")
def j06(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 10).alias("x"))  # noqa: E741
    return op.band_semi(l, table(spark, d, "part"), "x", "p_retailprice", 0.5).select("l_orderkey", "l_linenumber")


@query("j07_claimed_anti_join", f"""WITH r AS ({RECTS}), c AS (SELECT * FROM r WHERE n = 1), a AS (SELECT * FROM r WHERE n = 2) SELECT id FROM a WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.page = a.page AND a."left" >= c."left" AND a."right" <= c."right"
AND a.top >= c.top AND a.bottom <= c.bottom AND a."left" - c."left" <= 0.05 * (c."right" - c."left") AND c."right" - a."right" <= 0.05 * (c."right" - c."left") AND a.top - c.top <= 0.05 * (c.bottom - c.top) AND c.bottom - a.bottom <= 0.05 * (c.bottom - c.top))""")
def j07(spark, d):
    r = rects(spark, d)
    return op.claimed_anti(r.where("n = 2"), r.where("n = 1"), ["page"]).select("id")


@query("j08_point_in_band", """SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'view'
AND abs(a.value - b.value) <= 2 AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 86400e6""")
def j08(spark, d):
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    a, b = e.where("event_type = 'purchase'").alias("a"), e.where("event_type = 'view'").alias("b")
    on = (F.col("a.user_id") == F.col("b.user_id")) & (F.abs(F.col("a.value") - F.col("b.value")) <= 2) & (F.abs(F.col("a.us") - F.col("b.us")) <= 86400_000_000)
    return a.join(b, on).select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b"))


@query("j09_line_meets_interval", """WITH s AS (SELECT o_custkey AS k, o_orderkey AS id, o_totalprice AS y0, lead(o_totalprice) OVER w AS y1, o_orderkey AS x0, lead(o_orderkey) OVER w AS x1 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT s.id, p.o_orderkey AS at FROM s JOIN orders p ON s.k = p.o_custkey AND p.o_orderkey BETWEEN s.x0 AND s.x1 AND abs(s.y0 + (s.y1 - s.y0) * (p.o_orderkey - s.x0) / (s.x1 - s.x0) - p.o_totalprice) <= 1000 WHERE s.x1 IS NOT NULL""")
def j09(spark, d):
    """Interpolated y of a segment against a point's interval."""
    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    s = o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("x0"), F.col("o_totalprice").alias("y0"), F.lead("o_orderkey").over(w).alias("x1"), F.lead("o_totalprice").over(w).alias("y1")).where("x1 is not null")
    on = (F.col("k") == F.col("o_custkey")) & F.col("o_orderkey").between(F.col("x0"), F.col("x1")) & (F.abs(geo.line_at(F.col("o_orderkey"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")) - F.col("o_totalprice")) <= 1000)
    return s.join(o, on).select(F.col("x0").alias("id"), F.col("o_orderkey").alias("at"))


@query("j10_nearest_one", """SELECT c_custkey, match, round(gap, 2) AS gap FROM (SELECT c_custkey, s_suppkey AS match, abs(c_acctbal - s_acctbal) AS gap, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS n
FROM customer JOIN supplier ON c_nationkey = s_nationkey) WHERE n = 1""")
def j10(spark, d):
    """Nearest by value within a key: one sort of both sides, no pairs."""
    c = table(spark, d, "customer").withColumnRenamed("c_nationkey", "k")
    s = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "k")
    return op.nearest_value(c, s, ["k"], "c_acctbal", "s_acctbal", "c_custkey", "s_suppkey").where("match is not null").select("c_custkey", "match", F.round("gap", 2).alias("gap"))


@query("j11_nearest_k", """SELECT s_suppkey, p, place FROM (SELECT s_suppkey, c_custkey AS p, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(c_acctbal - s_acctbal), c_custkey) AS place FROM supplier JOIN customer ON c_nationkey = s_nationkey) WHERE place <= 2""")
def j11(spark, d):
    s, c = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "k"), table(spark, d, "customer").withColumnRenamed("c_nationkey", "k")
    return neighbours.nearest_k(s, c, ["k"], "s_acctbal", "c_acctbal", "s_suppkey", "c_custkey", 2).select("s_suppkey", F.col("match").alias("p"), F.col("place").cast("long").alias("place"))


@query("j12_nearest_prefers_containing", """SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, c_custkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY NOT (s_acctbal BETWEEN c_acctbal - 100 AND c_acctbal + 100), greatest(abs(s_acctbal - c_acctbal) - 100, 0), c_custkey) AS n
FROM supplier JOIN customer ON s_nationkey = c_nationkey) WHERE n = 1""")
def j12(spark, d):
    s, c = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "k"), table(spark, d, "customer").withColumnRenamed("c_nationkey", "k")
    return neighbours.nearest_containing(s, c, ["k"], "s_acctbal", "c_acctbal", "s_suppkey", "c_custkey", 100.0).select("s_suppkey", F.col("match").alias("c_custkey"))


@query("j13_nearest_after_equi", """SELECT o_orderkey, near FROM (SELECT a.o_orderkey, b.o_orderkey AS near, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY abs(a.o_totalprice - b.o_totalprice), b.o_orderkey) AS n
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey <> b.o_orderkey) WHERE n = 1""")
def j13(spark, d):
    a = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    b = a.select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("near"), F.col("o_totalprice").alias("p"))
    return op.nearest(a, b, ["o_custkey", "o_orderpriority"], "o_orderkey", F.abs(F.col("o_totalprice") - F.col("p")), ["near"], within=F.col("near") != F.col("o_orderkey")).select("o_orderkey", "near")


@query("j14_asof_join", """SELECT p.event_id, (SELECT arg_max(e.event_id, (e.ts, e.event_id)) FROM events e WHERE e.user_id = p.user_id AND e.event_type = 'error' AND e.ts <= p.ts) AS last_error FROM events p WHERE p.event_type = 'purchase'""")
def j14(spark, d):
    """The last error at or before each purchase."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return op.asof(e.where("event_type = 'purchase'"), e.where("event_type = 'error'"), ["user_id"], ["ts", "event_id"], F.col("event_id"), "last_error").select("event_id", "last_error")


@query("j15_equi_then_nearest", """WITH own AS (SELECT l_orderkey, l_linenumber, l_suppkey, s_acctbal FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey WHERE l_linenumber = 1),
f AS (SELECT l_suppkey, arg_min(s_suppkey, (abs(s_suppkey - l_suppkey), s_suppkey)) AS near FROM (SELECT DISTINCT l_suppkey FROM own WHERE s_acctbal IS NULL), supplier WHERE s_acctbal > 0 GROUP BY 1)
SELECT l_orderkey, CASE WHEN s_acctbal IS NOT NULL THEN own.l_suppkey ELSE near END AS block FROM own LEFT JOIN f ON own.l_suppkey = f.l_suppkey""")
def j15(spark, d):
    """The own block where there is one, else the nearest by key."""
    s = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("own"))
    lines = table(spark, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_suppkey")
    keyed = lines.join(s, F.col("l_suppkey") == F.col("own"), "left")
    lost = keyed.where("own is null").select("l_suppkey").distinct().withColumn("one", F.lit(1))
    near = neighbours.nearest_k(lost, s.withColumn("one", F.lit(1)), ["one"], "l_suppkey", "own", "l_suppkey", "own").select("l_suppkey", "match")
    return keyed.join(near, "l_suppkey", "left").select("l_orderkey", F.coalesce("own", "match").alias("block"))


@query("j16_near_either", """SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = c.c_nationkey AND abs(s.s_acctbal - c.c_acctbal) <= 50)
OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND abs(o.o_totalprice - c.c_acctbal) <= 50)""")
def j16(spark, d):
    """Within reach of one of two kinds of targets: the targets are one set."""
    s = table(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_nationkey").cast("long").alias("k"), F.col("s_acctbal").alias("v"))
    o = table(spark, d, "orders").select(F.lit("o").alias("kind"), F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"))
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.explode(F.array(F.struct(F.lit("s").alias("kind"), F.col("c_nationkey").cast("long").alias("k")), F.struct(F.lit("o").alias("kind"), F.col("c_custkey").alias("k")))).alias("t"))
    c = c.select("c_custkey", "c_acctbal", "t.*")
    return op.band_semi(c, s.union(o), "c_acctbal", "v", 50.0, ["kind", "k"]).select("c_custkey").distinct()


@query("j17_blocked_nearest", """WITH p AS (SELECT a.event_id, a.user_id, a.ts, (SELECT arg_min(b.event_id, (b.ts, b.event_id)) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND (b.ts, b.event_id) > (a.ts, a.event_id)) AS nxt FROM events a WHERE a.event_type = 'view')
SELECT p.event_id, p.nxt FROM p JOIN events n ON n.event_id = p.nxt WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = p.user_id AND e.event_type = 'error' AND (e.ts, e.event_id) > (p.ts, p.event_id) AND (e.ts, e.event_id) < (n.ts, n.event_id))""")
def j17(spark, d):
    """The next purchase after a view with no error between: the next of either kind decides."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("event_type").isin("purchase", "error"), F.struct("event_type", "event_id")), ignorenulls=True).over(w)
    return e.withColumn("x", nxt).where("event_type = 'view' and x.event_type = 'purchase'").select("event_id", F.col("x.event_id").alias("nxt"))


@query("j18_scored_pairs", """SELECT a.l_orderkey, a.l_linenumber AS dot, b.l_linenumber AS target, round(a.l_quantity - b.l_quantity + 1.75 * abs(a.l_discount - b.l_discount) * 100, 4) AS score
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_quantity - b.l_quantity > 0 AND a.l_quantity - b.l_quantity < 4 AND abs(a.l_discount - b.l_discount) * 100 <= 3.5""")
def j18(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")  # noqa: E741
    b = l.select("l_orderkey", F.col("l_linenumber").alias("target"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("e"))
    dx, dy = F.col("l_quantity") - F.col("q"), F.abs(F.col("l_discount") - F.col("e")) * 100
    return l.join(b, "l_orderkey").where((dx > 0) & (dx < 4) & (dy <= 3.5)).select("l_orderkey", F.col("l_linenumber").alias("dot"), "target", F.round(dx + 1.75 * dy, 4).alias("score"))


@query("j19_two_sided_contact", """WITH t AS (SELECT o.o_orderkey, o.o_custkey, o.o_totalprice AS lo, o.o_totalprice + 5000 AS hi FROM orders o), l AS (SELECT t.o_orderkey, arg_min(x.o_orderkey, (abs(x.o_totalprice - lo), x.o_orderkey)) AS a FROM t JOIN orders x ON x.o_custkey = t.o_custkey AND x.o_orderkey <> t.o_orderkey AND abs(x.o_totalprice - lo) <= 20000 GROUP BY 1),
r AS (SELECT t.o_orderkey, arg_min(x.o_orderkey, (abs(x.o_totalprice - hi), x.o_orderkey)) AS b FROM t JOIN orders x ON x.o_custkey = t.o_custkey AND x.o_orderkey <> t.o_orderkey AND abs(x.o_totalprice - hi) <= 20000 GROUP BY 1) SELECT l.o_orderkey, a, b FROM l JOIN r ON l.o_orderkey = r.o_orderkey WHERE a <> b""")
def j19(spark, d):
    """Both ends must touch, and touch different objects."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    x = o.select("o_custkey", F.col("o_orderkey").alias("x"), F.col("o_totalprice").alias("p"))
    pairs = o.join(x, "o_custkey").where("x <> o_orderkey")
    lo, hi = F.abs(F.col("p") - F.col("o_totalprice")), F.abs(F.col("p") - F.col("o_totalprice") - 5000)
    ends = pairs.groupBy("o_orderkey").agg(F.min(F.when(lo <= 20000, F.struct(lo, "x")))["x"].alias("a"), F.min(F.when(hi <= 20000, F.struct(hi, "x")))["x"].alias("b"))
    return ends.where("a is not null and b is not null and a <> b")


@query("j20_interval_having", """SELECT a.event_id, count(*) AS heads FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'view' AND epoch_us(b.ts) - epoch_us(a.ts) BETWEEN -3600e6 AND 24 * 3600e6 GROUP BY 1 HAVING count(*) >= 2""")
def j20(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    a, b = e.where("event_type = 'signup'").alias("a"), e.where("event_type = 'view'").select("user_id", F.col("us").alias("t")).alias("b")
    met = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("t") - F.col("us")).between(-3600_000_000, 24 * 3600_000_000))
    return met.groupBy("event_id").agg(F.count("*").alias("heads")).where("heads >= 2")


@query("j22_pairs_in_block", """SELECT a.l_orderkey, a.l_linenumber AS top, b.l_linenumber AS bottom FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber
WHERE abs(a.l_quantity - b.l_quantity) <= 3 AND a.l_shipdate < b.l_shipdate AND least(a.l_extendedprice, b.l_extendedprice) / greatest(a.l_extendedprice, b.l_extendedprice) >= 0.5""")
def j22(spark, d):
    """Top and bottom rows of one block: the cross join is within the order, an equi key."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_extendedprice")  # noqa: E741
    a, b = l.alias("a"), l.alias("b")
    c = lambda x: (F.col(f"a.{x}"), F.col(f"b.{x}"))
    (n, m), (q, r), (s, t), (p, e) = c("l_linenumber"), c("l_quantity"), c("l_shipdate"), c("l_extendedprice")
    return a.join(b, "l_orderkey").where((n < m) & (F.abs(q - r) <= 3) & (s < t) & (F.least(p, e) / F.greatest(p, e) >= 0.5)).select("l_orderkey", n.alias("top"), m.alias("bottom"))


@query("j23_pairs_supported", """SELECT a.l_orderkey, a.l_linenumber AS top, b.l_linenumber AS bottom FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber
WHERE (CAST(a.l_quantity AS INTEGER), CAST(b.l_quantity AS INTEGER)) IN ((2, 4), (3, 4), (4, 4), (6, 8), (9, 8), (12, 8), (2, 2), (3, 2))""")
def j23(spark, d):
    known = spark.createDataFrame([(2, 4), (3, 4), (4, 4), (6, 8), (9, 8), (12, 8), (2, 2), (3, 2)], "x int, y int")
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))  # noqa: E741
    a = l.where("q <= 12").select("l_orderkey", F.col("l_linenumber").alias("top"), F.col("q").alias("x"))
    b = l.where("q <= 8").select("l_orderkey", F.col("l_linenumber").alias("bottom"), F.col("q").alias("y"))
    return a.join(b, "l_orderkey").where("top < bottom").join(F.broadcast(known), ["x", "y"], "left_semi").select("l_orderkey", "top", "bottom")


@query("j24_margin_guard", """WITH r AS (SELECT c_custkey, s_suppkey, abs(c_acctbal - s_acctbal) AS dist, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey)
SELECT c_custkey, CASE WHEN count(*) FILTER (WHERE n = 2) = 0 OR max(dist) FILTER (WHERE n = 2) - max(dist) FILTER (WHERE n = 1) >= 500 THEN max(s_suppkey) FILTER (WHERE n = 1) END AS match FROM r GROUP BY 1""")
def j24(spark, d):
    c, s = table(spark, d, "customer").withColumnRenamed("c_nationkey", "k"), table(spark, d, "supplier").withColumnRenamed("s_nationkey", "k")
    return neighbours.with_margin(c, s, ["k"], "c_acctbal", "s_acctbal", "c_custkey", "s_suppkey", 500.0)


@query("j25_rank_match", """WITH a AS (SELECT l_suppkey AS k, l_orderkey AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'A'),
b AS (SELECT l_suppkey AS k, l_orderkey AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'R')
SELECT coalesce(a.k, b.k) AS k, CAST(count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL) AS BIGINT) AS matched, CAST(count(*) FILTER (WHERE b.id IS NULL) AS BIGINT) AS missing, CAST(count(*) FILTER (WHERE a.id IS NULL) AS BIGINT) AS extra FROM a FULL JOIN b ON a.k = b.k AND a.n = b.n GROUP BY 1""")
def j25(spark, d):
    l = table(spark, d, "lineitem").selectExpr("l_suppkey k", "l_shipdate t", "l_orderkey id", "l_linenumber n0", "l_returnflag f")  # noqa: E741
    order = ["t", "id", "n0"]
    m = op.rank_match(l.where("f = 'A'").drop("f"), l.where("f = 'R'").drop("f"), ["k"], order, order)
    return m.groupBy("k").agg(F.count_if(F.col("in_l") & F.col("in_r")).alias("matched"), F.count_if(F.col("in_r").isNull()).alias("missing"), F.count_if(F.col("in_l").isNull()).alias("extra"))


@query("j28_nearest_bounded", """SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 800) WHERE n = 1""")
def j28(spark, d):
    c, s = table(spark, d, "customer").withColumnRenamed("c_nationkey", "k"), table(spark, d, "supplier").withColumnRenamed("s_nationkey", "k")
    return op.nearest_value(c, s, ["k"], "c_acctbal", "s_acctbal", "c_custkey", "s_suppkey").where("gap <= 800").select("c_custkey", F.col("match").alias("s_suppkey"))


@query("j29_prioritized_nearest", """SELECT o_orderkey, l_linenumber FROM (SELECT o_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE WHEN l_quantity * 1000 >= o_totalprice THEN 0 WHEN l_returnflag = 'R' THEN 1 ELSE 2 END, abs(l_extendedprice - o_totalprice), l_linenumber) AS n
FROM orders JOIN lineitem ON o_orderkey = l_orderkey) WHERE n = 1""")
def j29(spark, d):
    tier = F.when(F.col("l_quantity") * 1000 >= F.col("o_totalprice"), 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    both = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    best = both.groupBy("o_orderkey").agg(F.min(F.struct(tier.alias("t"), F.abs(F.col("l_extendedprice") - F.col("o_totalprice")).alias("d"), "l_linenumber")).alias("b"))
    return best.select("o_orderkey", "b.l_linenumber")


@query("j32_two_hop", """WITH e AS (SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, date_trunc('day', ts) AS day FROM events),
l AS (SELECT user_id, day, arg_max(value, n) AS v, max(n) AS n FROM e GROUP BY 1, 2), f AS (SELECT user_id, day, arg_min(value, n) AS v, min(n) AS n FROM e GROUP BY 1, 2) SELECT l.user_id, count(*) AS ties FROM l JOIN f ON l.user_id = f.user_id AND f.n = l.n + 1 WHERE abs(l.v - f.v) <= 20 GROUP BY 1""")
def j32(spark, d):
    """What is open at the end of one group meets the start of the next."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("day", F.to_date("ts")).withColumns({"nv": F.lead("value").over(w), "nd": F.lead("day").over(w)})
    return e.where("nd <> day").where(F.abs(F.col("value") - F.col("nv")) <= 20).groupBy("user_id").agg(F.count("*").alias("ties"))


@query("j33_positional_zip", """WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view'), b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click')
SELECT a.event_id AS a, b.event_id AS b FROM a JOIN b ON a.user_id = b.user_id AND a.n = b.n""")
def j33(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    m = op.rank_match(e.where("event_type = 'view'").drop("event_type"), e.where("event_type = 'click'").drop("event_type"), ["user_id"], ["ts", "event_id"], ["ts", "event_id"])
    return m.where("in_l and in_r").select(F.col("l_event_id").alias("a"), F.col("r_event_id").alias("b"))


@query("j34_nearest_class", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT a.vec_id, b.label AS class, min(list_distance(a.v, b.v)) AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, class) AS n, lead(dist) OVER (PARTITION BY vec_id ORDER BY dist, class) AS nxt FROM m)
SELECT vec_id, class, n AS place, round(dist, 6) AS dist, CASE WHEN n = 1 THEN greatest(dist / 1.5, dist / nxt / 0.98) <= 1 END AS accepted FROM k WHERE n <= 5""")
def j34(spark, d):
    """The nearest other vector of each class, five best classes, open-set decision; all vectors against all."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("class"), F.col("embedding").alias("value"))
    best = vectors.nearest_of_class(e.select("id", "value"), e.withColumnRenamed("id", "ref"), apart=True)
    w = Window.partitionBy("id").orderBy("dist", "class")
    k = best.withColumns({"place": F.row_number().over(w).cast("long"), "nxt": F.lead("dist").over(w)}).where("place <= 5")
    accepted = F.when(F.col("place") == 1, F.greatest(F.col("dist") / 1.5, F.col("dist") / F.col("nxt") / 0.98) <= 1)
    return k.select(F.col("id").alias("vec_id"), "class", "place", F.round("dist", 6).alias("dist"), accepted.alias("accepted"))


@query("j27_class_of_symbol", "SELECT l_orderkey, l_linenumber, l_partkey, p_brand AS class FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25")
def j27(spark, d):
    """The class of each symbol by its id; symbols without one are dropped."""
    known = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("class"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(known, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "class")
