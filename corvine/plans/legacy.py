"""The second generation of resolvers on small inputs with known results: at, below and above their thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import legacy as op
from ..registry import query, table


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def staves(spark):
    return rows(spark, "page string, staff int, left double, right double, centre double, sp double", ("p", 1, 0.0, 600.0, 100.0, 10.0), ("p", 2, 0.0, 600.0, 220.0, 10.0))


#: Bit i of an 8 x 8 mask is place i of the list; the four ways to turn it over, as the place that comes to each.
TURNS = ["i", "8 * (i // 8) + 7 - i % 8", "8 * (7 - i // 8) + i % 8", "8 * (7 - i // 8) + 7 - i % 8"]


@query("l07_flip_overlap", f"""WITH m AS (SELECT vec_id, list_transform(range(64), lambda i: i < 62 AND embedding[i + 1] > 0) AS a FROM embeddings), p AS (SELECT x.vec_id, x.a, y.a AS b FROM m x JOIN m y ON y.vec_id = x.vec_id + 1),
t AS (SELECT vec_id, unnest([{", ".join(f"list_transform(range(64), lambda i: CASE WHEN a[i + 1] AND b[{t} + 1] THEN 2 WHEN a[i + 1] OR b[{t} + 1] THEN 1 ELSE 0 END)" for t in TURNS)}]) AS c FROM p)
SELECT vec_id, round(max(CASE WHEN len(list_filter(c, lambda x: x > 0)) = 0 THEN 0 ELSE len(list_filter(c, lambda x: x = 2)) / len(list_filter(c, lambda x: x > 0)) END), 6) AS overlap FROM t GROUP BY 1""")
def l07(spark, d):
    """Masks of the signs of each vector and the next one: their overlap, however one of them is turned over."""
    e = table(spark, d, "embeddings").select("vec_id", op.fn.sign_mask(F.col("embedding"), 62).alias("a"))
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return both.select("vec_id", F.round(op.four_flips_iou(F.col("a"), F.col("b")), 6).alias("overlap"))


LINES = "page string, id int, x double, top double, bottom double"


@query("l43_rename", "SELECT replace(o_orderpriority, '1-URGENT', 'short') AS p, count(*) AS n FROM orders GROUP BY 1")
def l43(spark, d):
    return op.rename(table(spark, d, "orders").select(F.col("o_orderpriority").alias("p")), "p", {"1-URGENT": "short"}).groupBy("p").agg(F.count("*").alias("n"))


NOTES = "page string, part string, measure_pos int, pos int, lane int, x double, onset double, quarters double, is_chord boolean"


def lane_notes(spark):
    return rows(spark, NOTES, ("p", "P1", 1, 1, 1, 10.0, 0.0, 2.0, False), ("p", "P1", 1, 2, 1, 60.0, 2.0, 2.0, False), ("p", "P1", 1, 3, 2, 61.0, 0.0, 1.0, False), ("p", "P1", 1, 4, 2, 90.0, 1.0, 1.0, False))


@query("l44_rest_lanes", "SELECT * FROM (VALUES (1, 2), (2, 1)) t(id, lane)")
def l44r(spark, d):
    """The first rest fills lane 2 exactly; then lane 1 is the one with room."""
    from ..operators.grouped import rest_lanes

    r = rows(spark, "m int, id int, x double, duration double, capacity double, lanes array<struct<lane:int,total:double,x:double>>", (1, 1, 5.0, 1.0, 4.0, [(1, 2.0, 5.0), (2, 3.0, 50.0)]), (1, 2, 9.0, 1.0, 4.0, [(1, 2.0, 5.0), (2, 3.0, 50.0)]))
    return rest_lanes(r, ["m"], "id").select("id", F.col("lane").cast("int"))


@query("l46_predicted_onsets", "SELECT * FROM (VALUES (1, 0.0), (2, 2.0), (3, 2.0), (4, 2.0)) t(pos, predicted)", predicted="DOUBLE")
def l46p(spark, d):
    return op.predicted_onsets(lane_notes(spark).withColumn("valid", F.col("lane") == 1), 0.5).select("pos", "predicted")
