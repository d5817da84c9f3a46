"""Operators that run to a fixpoint: components, label spreading, mutual-best matching.

Each round is a handful of shuffled joins; its result is written to the folder that the session names in
spark.checkpoint.dir (reliable checkpoint), which ends the lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, with its lineage ended by a reliable checkpoint."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or f"{tempfile.gettempdir()}/corvine-checkpoints")
    return df.checkpoint()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node reachable, for every node on an edge. Labels jump along pointers, so the number of rounds
    grows with the logarithm of the longest path."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = cut(both.unionByName(both.selectExpr("v u", "u v")).distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("label")))
    while True:
        told = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("told"))
        nearer = labels.join(told, labels["node"] == told["u"]).select("node", F.col("label").alias("was"), F.least("label", "told").alias("label"))
        jump = labels.select(F.col("node").alias("__at"), F.col("label").alias("__next"))
        new = cut(nearer.join(jump, nearer["label"] == jump["__at"], "left").select("node", "was", F.least("label", "__next").alias("label")))
        labels = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            return labels


def spread_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node, label or null) -> node, label, state. Each round, from a snapshot: a pending node whose labelled neighbours all agree
    takes their label; one that sees several is ambiguous for good. Stops when nothing changes."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = cut(both.unionByName(both.selectExpr("v u", "u v")).distinct())
    state = cut(nodes.select("node", "label", F.when(F.col("label").isNotNull(), "seed").otherwise("pending").alias("state")))
    while True:
        given = state.where("label is not null").select(F.col("node").alias("v"), F.col("label").alias("seen"))
        pending = state.where("state = 'pending'")
        told = pending.join(both, pending["node"] == both["u"]).join(given, "v").groupBy("node").agg(F.min("seen").alias("lo"), F.max("seen").alias("hi"))
        new = state.join(told, "node", "left")
        hit = F.col("lo").isNotNull()
        new = cut(new.select("node", F.when(hit & (F.col("lo") == F.col("hi")), F.col("lo")).otherwise(F.col("label")).alias("label"), F.when(hit, F.when(F.col("lo") == F.col("hi"), "spread").otherwise("ambiguous")).otherwise(F.col("state")).alias("state"), hit.alias("changed")))
        state = new.drop("changed")
        if new.where("changed").isEmpty():
            return state


def greedy_match(pairs: DataFrame, keys: list, left: str, right: str, score: Column) -> DataFrame:
    """One-to-one: pairs in order of (score, left, right), each taken if both sides are free. Pairs that are
    best for both sides are what the greedy takes next anyway, so rounds of mutual bests give the same matching, distributed."""
    rest = cut(pairs.select(*keys, left, right, score.alias("score")))
    out = None
    while not rest.isEmpty():
        order = [F.col("score"), F.col(left), F.col(right)]
        best = rest.withColumns({"__l": F.row_number().over(Window.partitionBy(*keys, left).orderBy(*order)), "__r": F.row_number().over(Window.partitionBy(*keys, right).orderBy(*order))})
        taken = cut(best.where("__l = 1 and __r = 1").drop("__l", "__r"))
        out = taken if out is None else out.unionByName(taken)
        rest = rest.join(taken.select(*keys, left), [*keys, left], "left_anti").join(taken.select(*keys, right), [*keys, right], "left_anti")
        rest = cut(rest.select(*keys, left, right, "score"))
    return rest if out is None else out


def global_rank(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows numbered from 1 in a total order, without one task for all: a range sort, row numbers within its partitions, and
    the counts of the partitions before (one number for each)."""
    ranked = cut(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    offsets, total = [], 0
    for r in ranked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        offsets += [F.lit(r["p"]), F.lit(total)]
        total += r["n"]
    before = F.element_at(F.create_map(*offsets), part) if offsets else F.lit(0)
    return ranked.withColumn(name, before + F.col("__id").bitwiseAND((1 << 33) - 1) + 1).drop("__id")
