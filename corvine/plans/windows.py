"""Window operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows as op
from ..registry import query, table

ORDER = ["ts", "event_id"]


def events(spark, d):
    return table(spark, d, "events")


def seconds(c: str = "ts"):
    return F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1_000_000)


@query("w01_carry_forward", """SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS signup FROM events""")
def w01(spark, d):
    return op.carry_forward(events(spark, d), ["user_id"], ORDER, F.when(F.col("event_type") == "signup", F.col("value")), "signup").select("event_id", "signup")


@query("w02_state_at_starts", """SELECT event_id, state FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM events) WHERE event_type = 'purchase' AND state IS NOT NULL""")
def w02(spark, d):
    """State carried along and told again at every start."""
    carried = op.carry_forward(events(spark, d), ["user_id"], ORDER, F.when(F.col("event_type") == "signup", F.col("event_id")), "state")
    return carried.where("event_type = 'purchase' and state is not null").select("event_id", "state")


@query("w03_cursor", """WITH m AS (SELECT *, event_type = 'view' AS shares, CASE event_type WHEN 'view' THEN 0 WHEN 'error' THEN -2 ELSE 3 END AS step FROM events),
c AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM m)
SELECT event_id, CAST(CASE WHEN shares THEN last_value(CASE WHEN NOT shares THEN pos END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE pos END AS BIGINT) AS onset FROM c""")
def w03(spark, d):
    kind = F.col("event_type")
    step = F.when(kind == "error", -2).otherwise(3).cast("long")
    return op.cursor(events(spark, d), ["user_id"], ["user_id"], ORDER, step, kind == "view", "onset").select("event_id", "onset")


@query("w04_keyed_state", """SELECT event_id, coalesce(CASE WHEN event_type = 'error' THEN value END, last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS)
OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS alter_now FROM events""")
def w04(spark, d):
    """State that ends with its frame: carried per user within a day."""
    day = events(spark, d).withColumn("day", F.to_date("ts"))
    return op.carry_forward(day, ["user_id", "day"], ORDER, F.when(F.col("event_type") == "error", F.col("value")), "alter_now").select("event_id", "alter_now")


@query("w05_change_points", """SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was,
row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1 OR event_type IS DISTINCT FROM was""")
def w05(spark, d):
    return op.change_points(events(spark, d), ["user_id"], ORDER, "event_type").select("event_id", "event_type")


@query("w06_gaps", """WITH g AS (SELECT user_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 - epoch_us(ts) / 1e6 AS gap FROM events),
s AS (SELECT user_id, list(gap ORDER BY gap) AS g FROM g WHERE gap IS NOT NULL GROUP BY 1)
SELECT user_id, round(g[greatest(1, len(g) // 3) // 2 + 1], 3) AS low_median FROM s""")
def w06(spark, d):
    """Differences of neighbours and the middle of their lowest third."""
    gap = F.lead(seconds()).over(op.within(["user_id"], ORDER)) - seconds()
    g = events(spark, d).select("user_id", gap.alias("gap")).where("gap is not null").groupBy("user_id").agg(F.array_sort(F.collect_list("gap")).alias("g"))
    return g.selectExpr("user_id", "round(element_at(g, cast(greatest(1, size(g) div 3) div 2 + 1 as int)), 3) as low_median")


@query("w07_regular_fives", """WITH g AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT a.user_id, a.n, list(b.t ORDER BY b.n) AS t FROM g a JOIN g b ON a.user_id = b.user_id AND b.n BETWEEN a.n AND a.n + 4 GROUP BY 1, 2 HAVING count(*) = 5),
x AS (SELECT user_id, n, [t[2]-t[1], t[3]-t[2], t[4]-t[3], t[5]-t[4]] AS gaps FROM w) SELECT CAST(count(*) AS BIGINT) AS windows, CAST(count(*) FILTER (WHERE list_max(gaps) <= 8 * list_avg(gaps) AND list_min(gaps) >= 0.05 * list_avg(gaps)) AS BIGINT) AS regular FROM x""")
def w07(spark, d):
    """Sliding windows of five whose four gaps all agree with their mean within bounds."""
    w = op.within(["user_id"], ORDER)
    gaps = [F.lead(seconds(), k + 1).over(w) - F.lead(seconds(), k).over(w) for k in range(4)]
    rows = events(spark, d).select("user_id", *[g.alias(f"g{k}") for k, g in enumerate(gaps)]).where("g3 is not null")
    cols = [F.col(f"g{k}") for k in range(4)]
    mean = (cols[0] + cols[1] + cols[2] + cols[3]) / 4
    return rows.agg(F.count("*").alias("windows"), F.count_if((F.greatest(*cols) <= 8 * mean) & (F.least(*cols) >= 0.05 * mean)).alias("regular"))


@query("w08_gap_clusters", """WITH v AS (SELECT l_suppkey, l_extendedprice AS x, l_orderkey, l_linenumber FROM lineitem), f AS (SELECT *, CASE WHEN x - lag(x) OVER w > 500 THEN 1 ELSE 0 END AS o FROM v WINDOW w AS (PARTITION BY l_suppkey ORDER BY x, l_orderkey, l_linenumber)),
c AS (SELECT *, sum(o) OVER (PARTITION BY l_suppkey ORDER BY x, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS cl FROM f) SELECT l_suppkey, CAST(cl AS BIGINT) AS cluster, count(*) AS n, min(x) AS low, max(x) AS high FROM c GROUP BY 1, 2""")
def w08(spark, d):
    """One-dimensional clusters by gap; the running-mean kind is in operators.cluster."""
    v = table(spark, d, "lineitem")
    order = ["l_extendedprice", "l_orderkey", "l_linenumber"]
    opens = F.col("l_extendedprice") - F.lag("l_extendedprice").over(op.within(["l_suppkey"], order)) > 500
    c = op.number_runs(v.withColumn("opens", opens), ["l_suppkey"], order, F.col("opens"), "cluster")
    return c.groupBy("l_suppkey", F.col("cluster").cast("long").alias("cluster")).agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query("w09_spaced_values", """WITH RECURSIVE s AS (SELECT l_suppkey AS k, list(l_quantity ORDER BY l_quantity) AS v FROM lineitem GROUP BY 1),
r(k, v, i, lastv, kept) AS (SELECT k, v, 2, v[1], [v[1]] FROM s UNION ALL SELECT k, v, i + 1, CASE WHEN v[i] - lastv >= 4 THEN v[i] ELSE lastv END, CASE WHEN v[i] - lastv >= 4 THEN list_append(kept, v[i]) ELSE kept END FROM r WHERE i <= len(v))
SELECT k AS l_suppkey, array_to_string(list_transform(kept, lambda x: CAST(x AS INTEGER)), ',') AS kept FROM r WHERE i > len(v)""")
def w09(spark, d):
    kept = op.keep_spaced(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", 4.0, "kept")
    return kept.select("l_suppkey", F.array_join(F.transform("kept", lambda x: x.cast("int").cast("string")), ",").alias("kept"))


@query("w10_islands", """WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + coalesce(value, 0) * 60 AS e FROM events),
f AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT user_id, CAST(island AS BIGINT) AS island, round(min(s), 3) AS s, round(max(e), 3) AS e, count(*) AS n FROM i GROUP BY 1, 2""")
def w10(spark, d):
    e = events(spark, d).select("user_id", seconds().alias("s"), (seconds() + F.coalesce("value", F.lit(0.0)) * 60).alias("e"))
    i = op.merge_islands(e, ["user_id"], "s", "e", 3600)
    return i.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.round(F.min("s"), 3).alias("s"), F.round(F.max("e"), 3).alias("e"), F.count("*").alias("n"))


@query("w11_pairs", """WITH n AS (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 2 AS pair FROM orders)
SELECT o_custkey, pair, min(o_orderkey) AS a, max(o_orderkey) AS b FROM n GROUP BY 1, 2 HAVING count(*) = 2""")
def w11(spark, d):
    p = op.pair_rows(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "pair")
    return p.groupBy("o_custkey", "pair").agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"))


@query("w12_segments", """SELECT o_custkey, o_orderkey AS opens, nxt AS closes, n, n = 1 AS starts FROM (SELECT *, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE nxt IS NOT NULL""")
def w12(spark, d):
    """Neighbouring bars bound numbered segments."""
    w = op.within(["o_custkey"], ["o_orderdate", "o_orderkey"])
    s = table(spark, d, "orders").withColumns({"closes": F.lead("o_orderkey").over(w), "n": F.row_number().over(w).cast("long")})
    return s.where("closes is not null").select("o_custkey", F.col("o_orderkey").alias("opens"), "closes", "n", (F.col("n") == 1).alias("starts"))


@query("w13_longest_run", """WITH m AS (SELECT user_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, row_number() OVER (PARTITION BY user_id, event_type <> 'error' ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, CASE WHEN ok THEN n - k END AS run, count(*) FILTER (WHERE ok) AS len FROM m GROUP BY 1, 2) SELECT user_id, max(len) AS longest FROM r GROUP BY 1""")
def w13(spark, d):
    return op.longest_run(events(spark, d), ["user_id"], ORDER, F.col("event_type") != "error", "longest")


@query("w14_direction_changes", """WITH s AS (SELECT user_id, ts, event_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM events),
g AS (SELECT *, s - lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dv FROM s), h AS (SELECT *, CASE WHEN abs(dv) > 1 THEN sign(dv) END AS g FROM g),
p AS (SELECT *, last_value(g IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM h) SELECT user_id, count(*) FILTER (WHERE g <> p) AS turns FROM p GROUP BY 1""")
def w14(spark, d):
    return op.direction_changes(events(spark, d), ["user_id"], ORDER, "value", 1.0, "turns")


@query("w15_position", """SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN 'begin' WHEN n = k THEN 'end' ELSE 'continue' END AS position FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n,
count(*) OVER (PARTITION BY l_orderkey) AS k FROM lineitem)""")
def w15(spark, d):
    return op.place_in_group(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], "position").select("l_orderkey", "l_linenumber", "position")


@query("w16_lane_index", "SELECT c_custkey, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) - 1 AS lane, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1 AS slot FROM customer")
def w16(spark, d):
    lane = F.dense_rank().over(Window.partitionBy("c_nationkey").orderBy("c_mktsegment")) - 1
    slot = F.row_number().over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")) - 1
    return table(spark, d, "customer").select("c_custkey", lane.cast("long").alias("lane"), slot.cast("long").alias("slot"))


@query("w17_run_numbers", "SELECT event_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM events")
def w17(spark, d):
    return op.number_runs(events(spark, d), ["user_id"], ORDER, F.col("event_type") == "signup", "run").select("event_id", "run")


@query("w18_interpolate", """WITH b AS (SELECT user_id, event_id, ts, epoch_us(ts) / 1e6 AS x, CASE WHEN event_type = 'purchase' THEN value END AS y FROM events),
n AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN {'x': x, 'y': y} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l,
first_value(CASE WHEN y IS NOT NULL THEN {'x': x, 'y': y} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM b)
SELECT event_id, round(CASE WHEN l IS NULL THEN r.y WHEN r IS NULL OR r.x = l.x THEN l.y ELSE l.y + (r.y - l.y) * (x - l.x) / (r.x - l.x) END, 4) AS v FROM n""")
def w18(spark, d):
    b = events(spark, d).select("user_id", "event_id", "ts", seconds().alias("x"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("y"))
    return op.interpolate(b, ["user_id"], ORDER, "x", "y", "v").select("event_id", F.round("v", 4).alias("v"))


@query("w19_running_bounds", """SELECT event_id, round(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS top, round(min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS low FROM events""")
def w19(spark, d):
    return events(spark, d).select("event_id", F.round(F.max("value").over(op.within(["user_id"], ORDER, op.FIRST, op.HERE)), 4).alias("top"), F.round(F.min("value").over(op.within(["user_id"], ORDER, op.HERE, op.LAST)), 4).alias("low"))


@query("g22_prefix_scan", """SELECT event_id FROM (SELECT event_id, min(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ok FROM events) WHERE ok = 1""")
def g22(spark, d):
    """Rows of a lane up to the first failure."""
    return op.prefix_all(events(spark, d), ["user_id"], ORDER, F.col("event_type") != "error").select("event_id")
