"""Fixpoint and greedy operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grouped, iterate
from ..operators.aggregates import first_by
from ..registry import query, table


@query("g05_mutual_best_match", """WITH RECURSIVE p AS (SELECT a.l_orderkey AS k, a.l_linenumber AS x, b.l_linenumber AS y, round(abs(a.l_quantity - b.l_quantity) + b.l_linenumber * 0.01 + a.l_linenumber * 0.0001, 6) AS score
FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) a JOIN (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber % 2 = 0 AND b.l_linenumber % 2 = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score, x, y) AS n FROM p), r(k, n, xs, ys) AS (SELECT DISTINCT k, CAST(0 AS BIGINT), CAST([] AS INTEGER[]), CAST([] AS INTEGER[]) FROM o
UNION ALL SELECT r.k, o.n, CASE WHEN NOT list_contains(r.xs, o.x) AND NOT list_contains(r.ys, o.y) THEN list_append(r.xs, o.x) ELSE r.xs END, CASE WHEN NOT list_contains(r.xs, o.x) AND NOT list_contains(r.ys, o.y) THEN list_append(r.ys, o.y) ELSE r.ys END FROM r JOIN o ON o.k = r.k AND o.n = r.n + 1),
f AS (SELECT k, arg_max(xs, n) AS xs, arg_max(ys, n) AS ys FROM r GROUP BY 1) SELECT k, unnest(xs) AS x, unnest(ys) AS y FROM f""")
def g05(spark, d):
    """Greedy one-to-one pairs within a key, as rounds of mutual bests."""
    l = first_by(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])  # noqa: E741
    a = l.where("l_linenumber % 2 = 0").selectExpr("l_orderkey k", "l_linenumber x", "l_quantity qx")
    b = l.where("l_linenumber % 2 = 1").selectExpr("l_orderkey k", "l_linenumber y", "l_quantity qy")
    score = F.round(F.abs(F.col("qx") - F.col("qy")) + F.col("y") * 0.01 + F.col("x") * 0.0001, 6)
    return iterate.greedy_match(a.join(b, "k"), ["k"], "x", "y", score).select("k", "x", "y")


@query("g08_components", """WITH RECURSIVE v AS (SELECT DISTINCT user_id, CAST(floor(epoch_us(ts) / 86400e6) AS BIGINT) AS day FROM events WHERE value > 95 AND event_type = 'error'), e AS (SELECT a.user_id AS a, b.user_id AS b FROM v a JOIN v b ON a.day = b.day),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS node, min(b) AS label FROM r GROUP BY 1""")
def g08(spark, d):
    """Users joined by errors on the same day. The edges run from each to the day's smallest user, so they are as many as rows."""
    v = table(spark, d, "events").where("value > 95 and event_type = 'error'").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400_000_000).alias("day")).distinct()
    star = v.join(v.groupBy("day").agg(F.min("user_id").alias("a")), "day").select("a", F.col("user_id").alias("b"))
    return iterate.components(star)


@query("g04_propagation", """WITH RECURSIVE n AS (SELECT n_nationkey AS node, CASE WHEN n_nationkey IN (0, 12, 24) THEN n_nationkey END AS label FROM nation), e AS (SELECT n_nationkey AS a, n_nationkey + 1 AS b FROM nation WHERE n_nationkey < 24),
dist AS (SELECT node, list(abs(node - s) ORDER BY abs(node - s), s) AS ds, list(s ORDER BY abs(node - s), s) AS ss FROM n, (SELECT unnest([0, 12, 24]) AS s) GROUP BY 1)
SELECT node, CASE WHEN ds[1] = 0 THEN ss[1] WHEN ds[1] = ds[2] THEN NULL ELSE ss[1] END AS label, CASE WHEN ds[1] = 0 THEN 'seed' WHEN ds[1] = ds[2] THEN 'ambiguous' ELSE 'spread' END AS state FROM dist""")
def g04(spark, d):
    """Three seeds on a chain spread both ways; where they meet at once it stays ambiguous."""
    n = table(spark, d, "nation")
    nodes = n.select(F.col("n_nationkey").alias("node"), F.when(F.col("n_nationkey").isin(0, 12, 24), F.col("n_nationkey")).alias("label"))
    edges = n.where("n_nationkey < 24").select(F.col("n_nationkey").alias("a"), (F.col("n_nationkey") + 1).alias("b"))
    return iterate.spread_labels(nodes, edges)


@query("g12_ladders", """WITH r AS (SELECT DISTINCT l_suppkey AS k, CAST(l_quantity AS INTEGER) AS level FROM lineitem WHERE l_quantity <= 30), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY level) AS n, min(level) OVER (PARTITION BY k) AS first FROM r)
SELECT k, min(first) AS first, max(n) FILTER (WHERE level - n = first - 1) AS depth FROM n GROUP BY 1""")
def g12(spark, d):
    """Consecutive levels from the first one on."""
    from pyspark.sql import Window

    r = table(spark, d, "lineitem").where("l_quantity <= 30").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").cast("int").alias("level")).distinct()
    n = r.withColumns({"n": F.row_number().over(Window.partitionBy("k").orderBy("level")).cast("long"), "first": F.min("level").over(Window.partitionBy("k"))})
    return n.groupBy("k").agg(F.min("first").alias("first"), F.max(F.when(F.col("level") - F.col("n") == F.col("first") - 1, F.col("n"))).alias("depth"))


BOXES = """b AS (SELECT DISTINCT ON (id) * FROM (SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS id, l_quantity AS l, l_quantity + 3 AS r, l_discount * 100 AS t, l_discount * 100 + 2 AS f, l_extendedprice AS score, l_partkey FROM lineitem) ORDER BY id, page, l, t, score)"""


def boxes(spark, d):
    """One box per id, the first by place and score."""
    b = table(spark, d, "lineitem").selectExpr("l_suppkey page", "l_orderkey * 10 + l_linenumber id", "l_quantity `left`", "l_quantity + 3 `right`", "l_discount * 100 top", "l_discount * 100 + 2 bottom", "l_extendedprice score")
    return first_by(b, ["id"], ["page", "left", "top", "score"])


@query("g07_anchor_groups", f"""WITH RECURSIVE {BOXES}, s AS (SELECT page, list({{'id': id, 'l': l, 'r': r, 't': t, 'f': f}} ORDER BY (r - l) * (f - t) DESC, id) AS v FROM b GROUP BY 1),
r(page, v, i, anchor) AS (SELECT page, v, 1, list_transform(v, lambda x: CAST(NULL AS BIGINT)) FROM s UNION ALL SELECT page, v, i + 1, CASE WHEN anchor[i] IS NOT NULL THEN anchor ELSE list_transform(anchor, lambda a, j: CASE WHEN a IS NULL AND (j = i OR least(v[j].r, v[i].r) - greatest(v[j].l, v[i].l) > 1e-6 AND least(v[j].f, v[i].f) - greatest(v[j].t, v[i].t) > 1e-6) THEN v[i].id ELSE a END) END FROM r WHERE i <= len(v))
SELECT page, unnest(list_transform(v, lambda x: x.id)) AS id, unnest(anchor) AS anchor FROM r WHERE i > len(v)""")
def g07(spark, d):
    return grouped.anchor_groups(boxes(spark, d), ["page"], "id").select("page", "id", "anchor")


@query("g11_nms", f"""WITH RECURSIVE {BOXES}, s AS (SELECT page, list({{'id': id, 'l': l, 'r': r, 't': t, 'f': f}} ORDER BY score DESC, id) AS v FROM b GROUP BY 1),
r(page, v, i, kept) AS (SELECT page, v, 1, CAST([] AS STRUCT(id BIGINT, l DOUBLE, r DOUBLE, t DOUBLE, f DOUBLE)[]) FROM s UNION ALL SELECT page, v, i + 1, CASE WHEN len(list_filter(kept, lambda x: greatest(least(x.r, v[i].r) - greatest(x.l, v[i].l), 0) * greatest(least(x.f, v[i].f) - greatest(x.t, v[i].t), 0) >= 0.45 * least((x.r - x.l) * (x.f - x.t), (v[i].r - v[i].l) * (v[i].f - v[i].t)))) = 0 THEN list_append(kept, v[i]) ELSE kept END FROM r WHERE i <= len(v)),
k AS (SELECT page, v, list_transform(kept, lambda x: x.id) AS ids FROM r WHERE i > len(v)), u AS (SELECT page, ids, unnest(list_transform(v, lambda x: x.id)) AS id FROM k) SELECT page, id, list_contains(ids, id) AS kept FROM u""")
def g11(spark, d):
    return grouped.suppress(boxes(spark, d), ["page"], "score", "id", 0.45).select("page", "id", "kept")


@query("m03_complete_link", """WITH RECURSIVE s AS (SELECT c_nationkey AS k, list(c_acctbal ORDER BY c_acctbal, c_custkey) AS v, list(c_custkey ORDER BY c_acctbal, c_custkey) AS ids FROM customer GROUP BY 1),
r(k, v, ids, i, lo, g, gs) AS (SELECT k, v, ids, 2, v[1], 0, [0] FROM s UNION ALL SELECT k, v, ids, i + 1, CASE WHEN v[i] - lo <= 200 THEN lo ELSE v[i] END, CASE WHEN v[i] - lo <= 200 THEN g ELSE g + 1 END, list_append(gs, CASE WHEN v[i] - lo <= 200 THEN g ELSE g + 1 END) FROM r WHERE i <= len(v))
SELECT k, unnest(ids) AS c_custkey, CAST(unnest(gs) AS BIGINT) AS link FROM r WHERE i > len(v)""")
def m03(spark, d):
    c = table(spark, d, "customer").selectExpr("c_nationkey k", "c_custkey", "c_acctbal")
    return grouped.complete_link(c, ["k"], ["c_acctbal", "c_custkey"], "c_acctbal", 200.0).select("k", "c_custkey", "link")


@query("w08_running_mean_clusters", """WITH RECURSIVE s AS (SELECT c_nationkey AS k, list(c_acctbal ORDER BY c_acctbal, c_custkey) AS v, list(c_custkey ORDER BY c_acctbal, c_custkey) AS ids FROM customer GROUP BY 1),
r(k, v, ids, i, total, n, g, gs) AS (SELECT k, v, ids, 2, v[1], 1, 0, [0] FROM s UNION ALL SELECT k, v, ids, i + 1, CASE WHEN v[i] - total / n > 150 THEN v[i] ELSE total + v[i] END, CASE WHEN v[i] - total / n > 150 THEN 1 ELSE n + 1 END, CASE WHEN v[i] - total / n > 150 THEN g + 1 ELSE g END,
list_append(gs, CASE WHEN v[i] - total / n > 150 THEN g + 1 ELSE g END) FROM r WHERE i <= len(v)) SELECT k, unnest(ids) AS c_custkey, CAST(unnest(gs) AS BIGINT) AS cluster FROM r WHERE i > len(v)""")
def w08r(spark, d):
    c = table(spark, d, "customer").selectExpr("c_nationkey k", "c_custkey", "c_acctbal")
    return grouped.running_mean_clusters(c, ["k"], "c_acctbal", 150.0, "c_custkey").select("k", "c_custkey", "cluster")


@query("w07_lane_windows", """WITH RECURSIVE s AS (SELECT c_nationkey AS k, list(c_acctbal ORDER BY c_acctbal, c_custkey) AS v, list(c_custkey ORDER BY c_acctbal, c_custkey) AS ids FROM customer GROUP BY 1),
r(k, v, ids, i, n, w) AS (SELECT k, v, ids, 1, 0, CAST([] AS BIGINT[]) FROM s UNION ALL SELECT k, v, ids, CASE WHEN ok THEN i + 3 ELSE i + 1 END, CASE WHEN ok THEN n + 1 ELSE n END, CASE WHEN ok THEN list_concat(w, [n, n, n]) ELSE list_append(w, NULL) END FROM (SELECT *, i + 2 <= len(v) AND v[i + 2] > v[i] AND abs((v[i + 1] - v[i]) - (v[i + 2] - v[i]) / 2) <= 0.3 * (v[i + 2] - v[i]) / 2 AND abs((v[i + 2] - v[i + 1]) - (v[i + 2] - v[i]) / 2) <= 0.3 * (v[i + 2] - v[i]) / 2 AS ok FROM r WHERE i <= len(v))),
f AS (SELECT k, ids, w FROM r WHERE i > len(v)), u AS (SELECT k, unnest(ids) AS c_custkey, unnest(w) AS "window" FROM f) SELECT * FROM u WHERE "window" IS NOT NULL""")
def w07(spark, d):
    e = table(spark, d, "customer").selectExpr("c_nationkey k", "c_custkey", "c_acctbal")
    return grouped.lane_windows(e, ["k"], "c_acctbal", 3, 0.3, "c_custkey").where("window is not null").select("k", "c_custkey", "window")


@query("l46_interval_colouring", """WITH RECURSIVE s AS (SELECT o_custkey AS k, list({'s': CAST(o_totalprice AS DOUBLE), 'e': o_totalprice + 40000, 'id': o_orderkey} ORDER BY o_totalprice, o_totalprice + 40000, o_orderkey) AS v FROM orders GROUP BY 1),
r(k, v, i, ends, lanes) AS (SELECT k, v, 1, CAST([] AS DOUBLE[]), CAST([] AS BIGINT[]) FROM s UNION ALL SELECT k, v, i + 1, CASE WHEN pos IS NULL THEN list_append(ends, v[i].e) ELSE list_concat(ends[:pos - 1], [v[i].e], ends[pos + 1:]) END, list_append(lanes, coalesce(pos - 1, len(ends))) FROM (SELECT *, list_position(list_transform(ends, lambda x: x <= v[i].s), true) AS pos FROM r WHERE i <= len(v)))
SELECT k, unnest(list_transform(v, lambda x: x.id)) AS id, unnest(lanes) AS lane FROM r WHERE i > len(v)""")
def l46(spark, d):
    o = table(spark, d, "orders").selectExpr("o_custkey k", "o_orderkey id", "cast(o_totalprice as double) s", "o_totalprice + 40000 e")
    return grouped.colour_intervals(o, ["k"], "s", "e", "id").select("k", "id", "lane")


@query("j26_tolerance_match", """WITH RECURSIVE l AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS id, l_quantity AS v, l_returnflag AS f FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity, l_returnflag),
e AS (SELECT k, list({'id': id, 'v': v, 'f': f} ORDER BY v, id) AS e FROM l WHERE id % 2 = 0 GROUP BY 1), a AS (SELECT k, list({'id': id, 'v': v, 'f': f} ORDER BY v, id) AS a FROM l WHERE id % 2 = 1 GROUP BY 1),
r(k, e, a, i, used, dist) AS (SELECT coalesce(e.k, a.k), coalesce(e, []), coalesce(a, []), 1, CAST([] AS BIGINT[]), CAST([] AS DOUBLE[]) FROM e FULL JOIN a ON e.k = a.k UNION ALL
SELECT k, e, a, i + 1, list_append(used, best.id), list_append(dist, abs(best.v - e[i].v)) FROM (SELECT *, list_sort(list_transform(list_filter(a, lambda x: abs(x.v - e[i].v) <= 10 AND NOT list_contains(used, x.id)), lambda x: {'c': abs(x.v - e[i].v) + CASE WHEN x.f <> e[i].f THEN 0.1 ELSE 0 END, 'v': x.v, 'id': x.id}))[1] AS best FROM r WHERE i <= len(e)))
SELECT k, unnest(list_transform(e, lambda x: x.id)) AS expected, unnest(used) AS actual, round(unnest(dist), 4) AS distance FROM r WHERE i > len(e) UNION ALL SELECT k, NULL, x.id, NULL FROM (SELECT k, used, unnest(a) AS x FROM r WHERE i > len(e)) WHERE NOT coalesce(list_contains(used, x.id), false)""")
def j26(spark, d):
    l = first_by(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_returnflag"])  # noqa: E741
    l = l.selectExpr("l_orderkey k", "cast(l_linenumber as long) id", "l_quantity v", "l_returnflag f")  # noqa: E741
    return grouped.match_by_tolerance(l.where("id % 2 = 0"), l.where("id % 2 = 1"), ["k"], "v", "id", 10.0, "f").select("k", "expected", "actual", F.round("distance", 4).alias("distance"))
