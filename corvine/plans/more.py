"""Variants and whole chains: file scans, text sinks, gates on shapes, descriptor benchmarks, line fits, barline chains, reports."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import scalar as fn
from ..operators import aggregates, glyph, joins, legacy, quality, score, vectors
from ..operators import windows as win
from ..registry import query, table
from ..sources import text
from .fixtures import SHAPES, glyph_rows, resolved, scores
from .legacy import rows

NAMES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()
FILES = ", ".join(f"('{n}.parquet', {k})" for k, n in enumerate(NAMES, 1))


@query("s01_directory_scan", f"SELECT name, CAST(n AS BIGINT) AS n FROM (VALUES {FILES}) t(name, n)")
def s01(spark, d):
    """Files by name without case; only their paths are read."""
    return text.list_files(spark, d, "*.parquet").select("name", F.col("n").cast("long"))


@query("s02_recursive_scan", f"SELECT count(*) AS files FROM (VALUES {FILES}) t(name, n)")
def s02(spark, d):
    return text.list_files(spark, d, "*.parquet", recursive=True).agg(F.count("*").alias("files"))


@query("s03_natural_names", "SELECT page_id, row_number() OVER (ORDER BY page_id % 50, page_id) AS n FROM pages")
def s03(spark, d):
    """Names such as part7-120 by their numbers."""
    from ..operators.iterate import global_rank

    p = table(spark, d, "pages").select("page_id", F.concat_ws("-", F.concat(F.lit("part"), F.col("page_id") % 50), "page_id").alias("name"))
    return global_rank(p, [fn.natural_key(F.col("name"))], "n").select("page_id", F.col("n").cast("long").alias("n"))


@query("s13_reference_lookup", "SELECT p_brand, count(*) AS n, min(p_retailprice) AS low FROM part WHERE p_type IN (SELECT DISTINCT p_type FROM part WHERE p_size = 1) GROUP BY 1")
def s13(spark, d):
    p = table(spark, d, "part")
    return p.join(p.where("p_size = 1").select("p_type").distinct(), "p_type", "left_semi").groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_retailprice").alias("low"))


@query("s20_csv_rows", """SELECT '"' || c_custkey || '","' || c_mktsegment || '"' AS line FROM customer""")
def s20(spark, d):
    return table(spark, d, "customer").select(F.to_csv(F.struct(F.col("c_custkey").cast("string"), "c_mktsegment"), {"quoteAll": "true"}).alias("line"))


@query("s23_tag_counts", "SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS tag FROM pages) GROUP BY 1, 2")
def s23(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), 1)).alias("tag")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("p10_thin_waves", "SELECT * FROM (VALUES ('wave', true), ('line', false)) t(name, wavy)")
def p10(spark, d):
    """Thin shapes are waves if their outline turns twice or more over the slices."""
    s = [("wave", k, math.sin(k * 1.2) * 3) for k in range(14)] + [("line", k, 0.1 * k) for k in range(14)]
    turns = win.direction_changes(spark.createDataFrame(s, "name string, slice int, x double"), ["name"], ["slice"], "x", 0.2, "turns")
    return turns.select("name", (F.col("turns") >= 2).alias("wavy"))


@query("j21_distance_join", """SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'click'
AND power((epoch_us(a.ts) - epoch_us(b.ts)) / 3600e6, 2) + power(a.value - b.value, 2) <= 100""")
def j21(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 3600e6).alias("h"))
    a, b = e.where("event_type = 'signup'").alias("a"), e.where("event_type = 'click'").alias("b")
    near = F.pow(F.col("a.h") - F.col("b.h"), 2) + F.pow(F.col("a.value") - F.col("b.value"), 2) <= 100
    return a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & near).select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b"))


@query("j30_nearest_within", """SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, c_custkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - c_acctbal), c_custkey) AS n FROM supplier JOIN customer ON s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) <= 112) WHERE n = 1""")
def j30(spark, d):
    s, c = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "k"), table(spark, d, "customer").withColumnRenamed("c_nationkey", "k")
    return joins.nearest_value(s, c, ["k"], "s_acctbal", "c_acctbal", "s_suppkey", "c_custkey").where("gap <= 112").select("s_suppkey", F.col("match").alias("c_custkey"))


@query("g06_primitive_chain", "SELECT * FROM (VALUES (1, 'PartMeasure')) t(id, scope)")
def g06(spark, d):
    """Garbage and staff lines out, then blocks."""
    from .fixtures import page_blocks, page_lines

    b = page_blocks(spark)
    p = spark.createDataFrame([("p1", 1, 100.0, 95.0, 110.0, 105.0), ("p1", 2, 0.0, 0.0, 500.0, 150.0), ("p1", 3, 50.0, 109.5, 650.0, 110.5)], "page string, id int, left double, top double, right double, bottom double")
    kept = score.drop_staff_lines(score.drop_garbage(p, b), page_lines(spark).where("y1 = y2").select("page", F.col("y1").alias("y")), b)
    return score.assign_blocks(kept, b).select("id", "scope")


@query("g26_outline_points", "SELECT * FROM (VALUES ('bar', 4), ('ell', 6)) t(name, kept)")
def g26(spark, d):
    """Outlines thinned to the points that matter: of straight sides the corners."""
    import numpy as np

    @F.pandas_udf("int")
    def kept(rings):
        return rings.map(lambda r: len(glyph.simplify(np.array([(p["x"], p["y"]) for p in r[0]]), 0.7)))

    return glyph_rows(spark, 0.0, 2.0).where("name in ('bar', 'ell')").select("name", kept("rings").alias("kept"))


@query("g27_chain_counts", "SELECT * FROM (VALUES ('accidentals', 2), ('arpeggi', 0), ('arcs', 0), ('beams', 0), ('clefs', 2), ('dots', 2), ('flags', 1), ('grid', 6), ('heads', 4), ('ledgers', 2), ('meters', 2), ('rests', 1), ('stem_heads', 3), ('stems', 3)) t(pass, n)")
def g27(spark, d):
    """All passes in order with what they claim."""
    out = None
    for name, df in resolved(spark).items():
        n = df.agg(F.count("*").cast("int").alias("n")).select(F.lit(name).alias("pass"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("m10_adapter", "SELECT * FROM (VALUES ('note:10', 'C5', true, 'sharp', 1), ('note:11', 'A4', true, 'flat', 1), ('note:12', 'C4', false, NULL, 0), ('note:14', 'A3', true, NULL, 0)) t(key, pitch, is_filled, accidental, dot_count)")
def m10(spark, d):
    from ..operators import rules

    r = resolved(spark)
    notes, _ = rules.facts_from_objects(r["heads"], r["stem_heads"], r["stems"], r["accidentals"], r["dots"])
    return notes.select("key", "pitch", "is_filled", "accidental", "dot_count")


@query("d14_descriptor_benchmark", """WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT k, a.vec_id, a.label, arg_min(b.label, (list_distance(a.v[1:k], b.v[1:k]), b.vec_id)) AS top FROM p a JOIN p b ON a.vec_id <> b.vec_id, (SELECT unnest([8, 32, 64]) AS k) GROUP BY 1, 2, 3)
SELECT CAST(k AS INTEGER) AS dims, round(count(*) FILTER (WHERE top = label) / count(*), 6) AS top1 FROM x GROUP BY 1""")
def d14(spark, d):
    """Leave-one-out accuracy by the first dimensions, all vectors against all others."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    out = None
    for dims in (8, 32, 64):
        v = e.select("id", F.slice("embedding", 1, dims).alias("value"))
        near = vectors.nearest_few(v, v.withColumnRenamed("id", "ref"), 1, apart=True).select("id", "ref")
        both = near.join(e.select("id", "label"), "id").join(e.select(F.col("id").alias("ref"), F.col("label").alias("found")), "ref")
        one = both.agg(F.round(F.count_if(F.col("found") == F.col("label")) / F.count("*"), 6).alias("top1")).select(F.lit(dims).alias("dims"), "top1")
        out = one if out is None else out.unionByName(one)
    return out


@query("d15_model_export", "SELECT label, json_object('class', label, 'count', count(*)) AS model FROM embeddings GROUP BY 1", model="VARCHAR")
def d15(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("count")).select("label", F.to_json(F.struct(F.col("label").alias("class"), "count")).alias("model"))


@query("l20_line_fit", "SELECT o_custkey, round(regr_slope(o_totalprice, o_orderkey), 6) AS slope, round(regr_intercept(o_totalprice, o_orderkey) + regr_slope(o_totalprice, o_orderkey) * 1000, 2) AS at_1000 FROM orders GROUP BY 1 HAVING count(*) >= 5")
def l20(spark, d):
    """A line through a group's points and its height at a place."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.regr_slope("o_totalprice", "o_orderkey").alias("s"), F.regr_intercept("o_totalprice", "o_orderkey").alias("i")).where("n >= 5")
    return o.select("o_custkey", F.round("s", 6).alias("slope"), F.round(F.col("i") + F.col("s") * 1000, 2).alias("at_1000"))


@query("l31_run_ends", """SELECT user_id, run, min(event_id) AS start, max(event_id) AS stop FROM (SELECT user_id, event_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM events) GROUP BY 1, 2 HAVING count(*) >= 2""", run="BIGINT")
def l31(spark, d):
    """First and last of a run, for what hangs on its ends."""
    e = win.number_runs(table(spark, d, "events"), ["user_id"], ["event_id"], F.col("event_type") == "signup", "run")
    return e.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.min("event_id").alias("start"), F.max("event_id").alias("stop")).where("n >= 2").drop("n")


@query("q07_visible_state", """SELECT event_id, state FROM (SELECT *, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state,
row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS n FROM events) WHERE n = 1 AND state IS NOT NULL""")
def q07(spark, d):
    """What is in force, told at the first row of every system (here: day)."""
    e = win.carry_forward(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "error", F.col("event_id")), "state")
    n = F.row_number().over(Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id"))
    return e.withColumn("n", n).where("n = 1 and state is not null").select("event_id", "state")


@query("x_shape_names", f"SELECT {len(SHAPES)} AS n")
def shapes(spark, d):
    """Shapes whose descriptors agree after a turn, a scale and a shift."""
    a = glyph.describe(glyph_rows(spark, 0.0, 1.0), "rings", ["sdf"]).select("name", "sdf")
    b = glyph.describe(glyph_rows(spark, 1.1, 2.5), "rings", ["sdf"]).select("name", F.col("sdf").alias("other"))
    return a.join(b, "name").where(fn.l2(F.col("sdf"), F.col("other")) < 4.0).agg(F.count("*").cast("int").alias("n"))


@query("a03_first_by", "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n = 1")
def first_by(spark, d):
    return aggregates.first_by(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), "p_partkey"]).select("p_brand", "p_partkey")


@query("s12_model_bundle", "SELECT * FROM (VALUES ('clefs', 'G'), ('rests', 'Q')) t(family, class)")
def s12(spark, d):
    import io
    import json
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for family, name in (("clefs", "G"), ("rests", "Q")):
            z.writestr(f"{family}.json", json.dumps({"family": family, "grid_size": 32, "mean": [0.0], "components": [[1.0]], "ratio_threshold": 0.9, "class_thresholds": {name: 1.0}, "references": [{"class": name, "source": "s", "fingerprint": [0.5]}]}))
    return text.parse_bundle(spark, held.getvalue())["references"].select("family", "class")


@query("l01_pass_order", "SELECT * FROM (VALUES (1, 'meters'), (2, 'grid'), (3, 'clefs'), (4, 'ledgers'), (5, 'heads'), (6, 'stems'), (7, 'stem_heads'), (8, 'arpeggi'), (9, 'beams'), (10, 'flags'), (11, 'arcs'), (12, 'accidentals'), (13, 'rests'), (14, 'dots')) t(n, pass)")
def l01(spark, d):
    """The passes in the order in which they claim."""
    return spark.createDataFrame(list(enumerate(resolved(spark), 1)), "n int, pass string")


@query("l04_page_geometry", "SELECT 'p.svg' AS path, 2 AS from_use, 3 AS direct")
def l04(spark, d):
    """Instances and direct shapes in one stream."""
    from ..sources import svg
    from .fixtures import SVG

    c = svg.parse_column(spark.createDataFrame([("p.svg", SVG)], "path string, content string"), "path", "content")
    return c.groupBy("path").agg(F.count_if("is_use").cast("int").alias("from_use"), F.count_if(~F.col("is_use")).cast("int").alias("direct"))
