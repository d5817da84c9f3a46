"""Projections, predicates, sorts, set operations and scalar functions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import scalar as fn
from ..operators import aggregates
from ..operators.iterate import global_rank
from ..registry import query, table


@query("p01_project", "SELECT o_orderkey, o_totalprice * 0.5 AS half_price, upper(o_orderpriority) AS priority FROM orders")
def p01(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") * 0.5).alias("half_price"), F.upper("o_orderpriority").alias("priority"))


@query("p02_filter_chain", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_discount <= 0.05 AND l_returnflag <> 'R'")
def p02(spark, d):
    return table(spark, d, "lineitem").where("l_quantity >= 10").where("l_discount <= 0.05").where("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber", "l_quantity")


@query("p03_flatten", "SELECT item_id, unnest(string_split(text, ' ')) AS word FROM benchmark")
def p03(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("word"))


@query("p04_indexed_flatten", "SELECT item_id, unnest(range(len(string_split(text, ' ')))) AS pos, unnest(string_split(text, ' ')) AS word FROM benchmark")
def p04(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "word")).select("item_id", F.col("pos").cast("long").alias("pos"), "word")


@query("p05_series", "SELECT p_partkey, unnest(generate_series(1, p_size)) AS slot FROM part WHERE p_size <= 5")
def p05(spark, d):
    return table(spark, d, "part").where("p_size <= 5").select("p_partkey", F.explode(F.sequence(F.lit(1).cast("long"), F.col("p_size").cast("long"))).alias("slot"))


@query("p06_scope_views", "SELECT event_type AS scope, count(*) AS n, count(value) AS with_value FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def p06(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("view", "click")).groupBy(F.col("event_type").alias("scope")).agg(F.count("*").alias("n"), F.count("value").alias("with_value"))


@query("p07_near_level", "SELECT a.l_orderkey, a.l_linenumber FROM lineitem a WHERE abs(l_tax - l_discount) <= 0.005")
def p07(spark, d):
    return table(spark, d, "lineitem").where(F.abs(F.col("l_tax") - F.col("l_discount")) <= 0.005).select("l_orderkey", "l_linenumber")


@query("p08_outlier_in_both", """WITH m AS (SELECT quantile_cont(l_quantity, 0.5) AS mq, quantile_cont(l_extendedprice, 0.5) AS mp FROM lineitem)
SELECT l_orderkey, l_linenumber FROM lineitem, m WHERE NOT (l_quantity > 1.8 * mq AND l_extendedprice > 1.5 * mp)""")
def p08(spark, d):
    """Too large in both measures against the median; one row of medians reaches every task."""
    rows = table(spark, d, "lineitem")
    quantity, price = (F.lit(aggregates.table_median(rows, c)) for c in ("l_quantity", "l_extendedprice"))
    return rows.where(~((F.col("l_quantity") > 1.8 * quantity) & (F.col("l_extendedprice") > 1.5 * price))).select("l_orderkey", "l_linenumber")


@query("p11_size_gates", "SELECT p_partkey FROM part WHERE p_size BETWEEN 6 AND 22 AND p_retailprice / 1000 BETWEEN 0.4 AND 1.8")
def p11(spark, d):
    return table(spark, d, "part").where(F.col("p_size").between(6, 22) & (F.col("p_retailprice") / 1000).between(0.4, 1.8)).select("p_partkey")


@query("p12_relative_gate", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount >= greatest(2 * l_tax, 0.03) AND l_quantity >= 20")
def p12(spark, d):
    return table(spark, d, "lineitem").where((F.col("l_discount") >= F.greatest(2 * F.col("l_tax"), F.lit(0.03))) & (F.col("l_quantity") >= 20)).select("l_orderkey", "l_linenumber")


@query("p13_even_level_gate", "SELECT p_partkey, CAST(round_even(p_size / 2.0, 0) * 2 AS BIGINT) AS level FROM part WHERE abs(p_size + p_retailprice / 1e5 - round_even(p_size / 2.0, 0) * 2) <= 0.35 AND (p_size <= 8 OR p_size >= 40)")
def p13(spark, d):
    level = fn.half_even(F.col("p_size") / 2) * 2
    return table(spark, d, "part").where((F.abs(F.col("p_size") + F.col("p_retailprice") / 1e5 - level) <= 0.35) & ((F.col("p_size") <= 8) | (F.col("p_size") >= 40))).select("p_partkey", level.cast("long").alias("level"))


@query("p14_array_shape_gate", """WITH s AS (SELECT vec_id, list_avg(embedding::DOUBLE[]) AS m, list_stddev_pop(embedding::DOUBLE[]) AS sd FROM embeddings)
SELECT vec_id FROM s WHERE abs(m) <= 0.02 AND sd BETWEEN 0.05 AND 0.34""")
def p14(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.size("x")
    var = F.aggregate("x", F.lit(0.0), lambda s, v: s + (v - F.col("m")) * (v - F.col("m"))) / F.size("x")
    return table(spark, d, "embeddings").select("vec_id", x.alias("x")).withColumn("m", mean).where((F.abs("m") <= 0.02) & F.sqrt(var).between(0.05, 0.34)).select("vec_id")


@query("p16_strip_gate", """SELECT vec_id FROM embeddings WHERE list_max(embedding::DOUBLE[]) - list_min(embedding::DOUBLE[]) >= 0.5
AND abs(list_max(embedding::DOUBLE[])) / abs(list_min(embedding::DOUBLE[])) <= 1.2""")
def p16(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, d, "embeddings").where((F.array_max(x) - F.array_min(x) >= 0.5) & (F.abs(F.array_max(x)) / F.abs(F.array_min(x)) <= 1.2)).select("vec_id")


@query("p17_band_counts", """SELECT vec_id, CAST(len(list_filter(embedding[1:21], lambda x: x > 0)) AS BIGINT) AS low, CAST(len(list_filter(embedding[22:43], lambda x: x > 0)) AS BIGINT) AS mid,
CAST(len(list_filter(embedding[44:64], lambda x: x > 0)) AS BIGINT) AS high FROM embeddings""")
def p17(spark, d):
    band = lambda a, n: F.size(F.filter(F.slice("embedding", a, n), lambda x: x > 0)).cast("long")
    return table(spark, d, "embeddings").select("vec_id", band(1, 21).alias("low"), band(22, 22).alias("mid"), band(44, 21).alias("high"))


@query("p18_needs_cover", """SELECT o_orderkey FROM orders o WHERE o_totalprice < 100000
OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity >= ceil(o.o_totalprice / 10000))""")
def p18(spark, d):
    """Legal by itself or by a covering row of sufficient depth."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("depth"))
    both = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left")
    return both.where((F.col("o_totalprice") < 100000) | (F.col("depth") >= F.ceil(F.col("o_totalprice") / 10000))).select("o_orderkey")


#: The supported pairs of beats and beat value.
METERS = ((2, 2), (3, 2), (4, 2), (2, 4), (3, 4), (4, 4), (5, 4), (6, 4), (7, 4), (3, 8), (5, 8), (6, 8), (7, 8), (9, 8), (12, 8), (3, 16), (6, 16), (9, 16), (12, 16))


@query("p19_whitelist", f"SELECT p_partkey FROM part WHERE (p_size % 13, p_size % 17) IN ({', '.join(map(str, METERS))})")
def p19(spark, d):
    allowed = spark.createDataFrame(METERS, "beats int, value int")
    rows = table(spark, d, "part").withColumns({"beats": F.col("p_size") % 13, "value": F.col("p_size") % 17})
    return rows.join(F.broadcast(allowed), ["beats", "value"], "left_semi").select("p_partkey")


@query("p20_compact", "SELECT p_partkey FROM part WHERE p_size <= 30 AND greatest(p_size, p_retailprice / 100) / least(p_size, p_retailprice / 100) <= 3 AND p_type NOT IN ('STANDARD')")
def p20(spark, d):
    side = F.col("p_retailprice") / 100
    return table(spark, d, "part").where((F.col("p_size") <= 30) & (F.greatest(F.col("p_size").cast("double"), side) / F.least(F.col("p_size").cast("double"), side) <= 3) & ~F.col("p_type").isin("STANDARD")).select("p_partkey")


@query("p21_text_predicates", "SELECT p_partkey FROM part WHERE lower(p_type) LIKE 'p%' OR contains(lower(p_name), '1')")
def p21(spark, d):
    return table(spark, d, "part").where(F.lower("p_type").startswith("p") | F.lower("p_name").contains("1")).select("p_partkey")


@query("p22_first_rule_wins", """SELECT p_partkey, coalesce(CASE WHEN p_size > 40 THEN 'clef' END, CASE WHEN p_size < 4 THEN 'dot' END,
CASE WHEN p_retailprice > 1500 THEN 'rest' END, CASE WHEN p_size % 2 = 0 THEN 'flat' END, 'notehead') AS kind FROM part""")
def p22(spark, d):
    size, price = F.col("p_size"), F.col("p_retailprice")
    kind = F.coalesce(F.when(size > 40, "clef"), F.when(size < 4, "dot"), F.when(price > 1500, "rest"), F.when(size % 2 == 0, "flat"), F.lit("notehead"))
    return table(spark, d, "part").select("p_partkey", kind.alias("kind"))


# Sorts, limits, top-k -----------------------------------------------------------------------------------------------
@query("o01_multi_key_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) AS place FROM orders")
def o01(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey")).cast("long").alias("place"))


@query("o02_topk_group", "SELECT c_nationkey, c_custkey, place FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 3")
def o02(spark, d):
    """Rank filters reach below the shuffle as a per-task group limit."""
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return table(spark, d, "customer").withColumn("place", place).where("place <= 3").select("c_nationkey", "c_custkey", F.col("place").cast("long").alias("place"))


@query("o02_topk_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def o02g(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("o03_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 10")
def o03(spark, d):
    return table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").offset(10).limit(25)


@query("o04_take_while", "SELECT item_id, regexp_extract(text, '^[A-Za-z]+', 0) AS lead FROM benchmark")
def o04(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.regexp_extract("text", "^[A-Za-z]+", 0).alias("lead"))


@query("o05_reverse", "SELECT item_id, array_to_string(list_reverse(string_split(text, ' ')), ' ') AS backward FROM benchmark")
def o05(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.reverse(F.split("text", " ")), " ").alias("backward"))


@query("o06_natural_order", """SELECT page_id, row_number() OVER (ORDER BY lpad(regexp_extract(url, '(\\d+)$', 1), 20, '0'), length(url), url, page_id) AS place
FROM (SELECT page_id, 'page' || page_id AS url FROM pages)""")
def o06(spark, d):
    """Numbers inside names compare as numbers; the rank comes from a range sort, not from one task."""
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit("page"), F.col("page_id")).alias("url"))
    return global_rank(pages, [fn.natural_key(F.col("url")), "page_id"], "place").select("page_id", F.col("place").cast("long").alias("place"))


# Set operations ---------------------------------------------------------------------------------------------------------
@query("u01_intersect", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 50000 INTERSECT SELECT l_orderkey FROM lineitem WHERE l_quantity > 45")
def u01(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 50000").select(F.col("o_orderkey").alias("k")).intersect(table(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey"))


@query("u02_except_both", """(SELECT 'missing' AS side, o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30))
UNION ALL (SELECT DISTINCT 'extra', l_orderkey FROM lineitem WHERE l_quantity > 30 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))""")
def u02(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("k"))
    missing = orders.select(F.col("o_orderkey").alias("k")).subtract(lines)
    extra = lines.subtract(orders.where("o_orderstatus = 'F'").select("o_orderkey"))
    return missing.select(F.lit("missing").alias("side"), "k").unionByName(extra.select(F.lit("extra").alias("side"), "k"))


@query("u02_except_all", "SELECT l_quantity AS q FROM lineitem WHERE l_returnflag = 'A' EXCEPT ALL SELECT l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def u02m(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.where("l_returnflag = 'A'").select(F.col("l_quantity").alias("q")).exceptAll(lines.where("l_returnflag = 'R'").select("l_quantity"))


@query("u03_union_distinct", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def u03(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).union(table(spark, d, "customer").select("c_custkey")).distinct()


@query("u04_symmetric_difference", """SELECT event_type, user_id FROM (SELECT DISTINCT event_type, user_id, 1 AS s FROM events WHERE value > 50 UNION ALL
SELECT DISTINCT event_type, user_id, 2 FROM events WHERE value <= 50) GROUP BY 1, 2 HAVING count(*) = 1""")
def u04(spark, d):
    """Even-odd: keys that are on one side only."""
    side = table(spark, d, "events").where("value is not null").select("event_type", "user_id", (F.col("value") > 50).alias("s")).distinct()
    return side.groupBy("event_type", "user_id").agg(F.count("*").alias("n")).where("n = 1").select("event_type", "user_id")


@query("u05_sequence_equality", """WITH a AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS s FROM events GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS users, CAST(count(*) FILTER (WHERE s = list_reverse(s)) AS BIGINT) AS same_both_ways FROM a""")
def u05(spark, d):
    """Ordered sequences compared element by element."""
    s = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type")))["event_type"].alias("s"))
    return s.agg(F.count("*").alias("users"), F.count_if(F.col("s") == F.reverse("s")).alias("same_both_ways"))


# Scalars -----------------------------------------------------------------------------------------------------------------
@query("x_bankers_round", "SELECT p_partkey, round_even(p_size / 2.0, 0) AS r0, round_even(p_size / 4.0, 1) AS r1, round_even(p_size / 8.0, 2) AS r2 FROM part")
def bankers(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", fn.half_even(s / 2).alias("r0"), fn.half_even(s / 4, 1).alias("r1"), fn.half_even(s / 8, 2).alias("r2"))


@query("x_logical_grid", """SELECT event_id, round(x / 24 * units, 6) AS logical, round(x, 6) AS back FROM
(SELECT event_id, hour(ts) + minute(ts) / 60.0 AS x, CASE WHEN event_type <> 'error' THEN 32 END AS units FROM events) WHERE units IS NOT NULL
UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_type = 'error'""")
def grid(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.hour("ts") + F.minute("ts") / 60.0).alias("x"), F.when(F.col("event_type") != "error", 32).alias("units"))
    logical = geo.to_logical_x(F.col("x"), F.lit(0.0), F.lit(24.0), F.col("units"))
    return rows.select("event_id", F.round(logical, 6).alias("logical"), F.round(geo.to_physical_x(logical, F.lit(0.0), F.lit(24.0), F.col("units")), 6).alias("back"))


@query("x_rect_functions", """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS l, l_quantity + 5 AS r, l_discount * 100 AS t, l_discount * 100 + 2 AS b FROM lineitem WHERE l_linenumber <= 2)
SELECT x.l_orderkey, x.l <= y.r AND y.l <= x.r AND x.t <= y.b AND y.t <= x.b AS meet, least(x.r, y.r) - greatest(x.l, y.l) > 1e-6 AND least(x.b, y.b) - greatest(x.t, y.t) > 1e-6 AS over,
round(sqrt(power(greatest(y.l - x.r, x.l - y.r, 0), 2) + power(greatest(y.t - x.b, x.t - y.b, 0), 2)), 6) AS dist, round(greatest(least(x.r, y.r) - greatest(x.l, y.l), 0) / 5, 6) AS share
FROM r x JOIN r y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber = 1 AND y.l_linenumber = 2""")
def rects(spark, d):
    r = table(spark, d, "lineitem").where("l_linenumber <= 2").selectExpr("l_orderkey", "l_linenumber n", "l_quantity `left`", "l_quantity + 5 `right`", "l_discount * 100 top", "l_discount * 100 + 2 bottom")
    x = r.where("n = 1").select("l_orderkey", *[F.col(c).alias(f"x_{c}") for c in geo.Rect._fields])
    y = r.where("n = 2").select("l_orderkey", *[F.col(c).alias(f"y_{c}") for c in geo.Rect._fields])
    a, b = geo.Rect.of("x_"), geo.Rect.of("y_")
    return x.join(y, "l_orderkey").select("l_orderkey", geo.intersects(a, b).alias("meet"), geo.overlaps(a, b).alias("over"), F.round(geo.rect_distance(a, b), 6).alias("dist"), F.round(geo.overlap_share(a.left, a.right, b.left, b.right), 6).alias("share"))


@query("x_parse_and_regex", """SELECT event_id, TRY_CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS INTEGER) AS k, length(props) AS n, json_extract_string(props, '$.k') AS kj FROM events""")
def parse(spark, d):
    return table(spark, d, "events").select("event_id", F.regexp_extract("props", r'"k": *(\d+)', 1).try_cast("int").alias("k"), F.length("props").cast("long").alias("n"), F.get_json_object("props", "$.k").alias("kj"))


@query("x_hash_key", "SELECT item_id, substr(sha1(text), 1, 16) AS key FROM benchmark")
def hash_key(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.substring(F.sha1(F.encode("text", "utf-8")), 1, 16).alias("key"))


@query("x_array_map", """SELECT item_id, CAST(list_position(w, 'the') AS BIGINT) AS first_the, CAST(len(list_distinct(w)) AS BIGINT) AS kinds, list_contains(w, 'and') AS has_and,
array_to_string(list_sort(w)[1:3], ' ') AS first_sorted FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)""")
def arrays(spark, d):
    w = F.col("w")
    return table(spark, d, "benchmark").select("item_id", F.split("text", " ").alias("w")).select("item_id", F.when(F.array_position(w, "the") > 0, F.array_position(w, "the")).alias("first_the"), F.size(F.array_distinct(w)).cast("long").alias("kinds"), F.array_contains(w, "and").alias("has_and"), F.array_join(F.slice(F.array_sort(w), 1, 3), " ").alias("first_sorted"))


@query("g14_pitch", """SELECT p_partkey, substr('CDEFGAB', CAST((38 - p) % 7 + 1 AS INTEGER), 1) AS step, CAST(floor((38 - p) / 7.0) AS INTEGER) AS octave FROM (SELECT p_partkey, p_size % 12 AS p FROM part)""")
def pitch(spark, d):
    """Diatonic label of a staff position: the top line of a G clef is F5."""
    step, octave = fn.pitch_of(F.col("p_size") % 12, 3, 5)
    return table(spark, d, "part").select("p_partkey", step.alias("step"), octave.alias("octave"))
