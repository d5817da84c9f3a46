"""Operator 3, mixing sources to target weights.

Every document gets a hash-random key. Within a source, keys in ascending order are one epoch. The
key space is range-split into as many ranges as the square root of the number of rows (4096 at least); only the token sums of (source, range) are
shuffled, after a partial sum in each task. Prefix sums over the ranges of a source find the range
in which its budget ends; only the rows of that range are sorted to find the
key of the cut, and the document at the cut gives just the words that are left. Texts never move,
however much of the corpus one source holds.

Targets: sources in code-point order, null last, weigh 1, 2, 3, 1, ...; a target stops at
``max_epochs`` times its source's size and the excess is reshared by weight (water filling: the level rises until no
further source is full; each step is one sum over the sources). Sources are numbered by a range sort, so there may be any number of them.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own;
rows equal in id and text share one key and, at the cut, what is left in equal whole parts; texts of any length are counted whole; an empty table gives
an empty table. ``mix_sources`` replaces input columns named like an output column (in any case); ``mix_rows`` returns all columns with their own values
(names that begin with two underscores are its own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, release, table, word_count

BUCKET_BITS = 12
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3


def mix_key(doc_id: Column, text: Column, seed: int) -> Column:
    """A random, repeatable key of 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id.cast("string"), text), 1)


def numbered(sizes: DataFrame) -> DataFrame:
    """sizes with n, the place of each source in code-point order from 0 on, null last: a range sort, the place in its partition
    and the rows of the partitions before."""
    placed = materialize(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("__id", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("__id", 33)
    offsets, total = [], 0
    for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():  # one row per partition
        offsets += [F.lit(r["p"]), F.lit(total)]
        total += r["n"]
    before = F.element_at(F.create_map(*offsets), part) if offsets else F.lit(0)
    return placed.withColumn("n", before + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> with target (double)."""
    w = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights)).cast("int") + 1)
    ranked = numbered(sizes).withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    level = 0.0
    while True:
        full = F.col("cap") <= F.col("w") * level
        r = ranked.agg(F.sum("source_size").alias("size"), F.sum(F.when(full, F.col("cap"))).alias("full"), F.sum(F.when(~full, F.col("w"))).alias("open")).first()
        higher = ((r["size"] or 0) - (r["full"] or 0)) / r["open"] if r["open"] else level
        if higher <= level:
            return ranked.select("source", "source_size", F.least("cap", F.col("w") * level).alias("target"))
        level = higher


def mix_plan(docs: DataFrame, bucket_bits: int | None = None) -> DataFrame:
    """One row per source: source, source_size, target, epochs (whole ones), cut_key, cut_rest (words left
    at the cut) and cut_rows (rows that share them). docs has source, __size, __key."""
    if bucket_bits is None:
        bucket_bits = max(BUCKET_BITS, docs.count().bit_length() // 2)
    bucket = F.shiftright("__key", 63 - bucket_bits)
    keyed = docs.select("source", "__size", "__key", bucket.alias("__bucket"))
    sums = materialize(keyed.groupBy("source", "__bucket").agg(F.sum("__size").alias("__sum")), "mix-sums")
    goal = source_targets(sums.groupBy("source").agg(F.sum("__sum").alias("source_size")))
    budget = F.rint("target").cast("long")
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    run = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    prefix = sums.withColumn("before", F.coalesce(F.sum("__sum").over(run), F.lit(0)))
    at = prefix.alias("p").join(goal.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source")))
    at = at.where("before <= rest and rest < before + __sum")
    cut = materialize(at.selectExpr("g.source source", "source_size", "target", "epochs", "rest - before as rest", "__bucket cut_bucket"), "mix-cut")
    inside = keyed.alias("k").join(cut.alias("c"), F.col("k.source").eqNullSafe(F.col("c.source")) & (F.col("k.__bucket") == F.col("c.cut_bucket")))
    inside = inside.groupBy("c.source", "c.rest", "k.__key").agg(F.sum("k.__size").alias("words"), F.count("*").alias("cut_rows"))
    run = Window.partitionBy("source").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    inside = inside.where("before <= rest and rest < before + words").selectExpr("source s", "__key cut_key", "rest - before cut_rest", "cut_rows")
    plan = materialize(goal.join(inside, goal["source"].eqNullSafe(inside["s"]), "left").drop("s", "rest"), "mix-plan")
    release(sums)
    release(cut)
    return plan


def keys(docs: DataFrame, doc_id: str, text: str, seed: int) -> DataFrame:
    """docs with __size and __key."""
    return docs.withColumns({"__size": word_count(F.col(text)), "__key": mix_key(F.col(doc_id), F.col(text), seed)})


def taken(keyed: DataFrame, source: str) -> DataFrame:
    """keyed (with __size and __key) with __source_size, __target, __epochs and __taken."""
    plan = mix_plan(keyed.select(F.col(source).alias("source"), "__size", "__key"))
    plan = plan.select(*[F.col(c).alias(f"__{c}") for c in plan.columns])
    both = keyed.join(plan, F.col(source).eqNullSafe(F.col("__source")), "left")
    part = F.when(F.col("__key") < F.col("__cut_key"), F.col("__size")).when(F.col("__key") == F.col("__cut_key"), F.least(F.col("__size"), F.floor(F.col("__cut_rest") / F.col("__cut_rows")))).otherwise(0)
    return both.withColumn("__taken", (F.col("__epochs") * F.col("__size") + part).cast("long")).drop("__key", "__source", "__cut_key", "__cut_rest", "__cut_rows")


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """docs with size, source_size, target, epochs and taken (words the mix takes of the row, repeats counted)."""
    names = ["size", "source_size", "target", "epochs", "taken"]
    kept = docs.drop(*[c for c in docs.columns if c.lower() in names])
    return taken(keys(kept, doc_id, text, seed), source).withColumnsRenamed({f"__{c}": c for c in names})


def mix_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """The mix itself, whole documents only: each row as many times as the mix takes it. A part of a
    document counts as the whole from half its words on, so a source misses its target by half a document at most."""
    mixed = taken(keys(docs, doc_id, text, seed), source)
    copies = F.when(F.col("__size") > 0, F.floor(F.col("__taken") / F.col("__size") + 0.5)).otherwise(0).cast("int")
    return mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), copies))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words are counted once: all else reads the sizes and keys."""
    docs = keys(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id", "text", 7)
    mixed = taken(materialize(docs.select("doc_id", "source", "__size", "__key"), "mix-keys"), "source")
    return mixed.select("doc_id", F.col("__size").alias("size"), "source", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))
