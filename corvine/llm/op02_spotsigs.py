"""Operator 2, document fingerprints: SpotSigs, in DataFrame functions only.

A spot signature is a common word (the anchor) with the chain of the CHAIN content words that follow it among the next REACH
words; common words in between are passed over. A fingerprint is the set of a text's signatures, 32-bit hashes, and two
fingerprints are compared by Jaccard. A text without any common word has one signature, of all its words; an
empty text (no letter or digit) has none, and two empty sets are alike (1.0).

``near_groups`` is the join: documents of equal sets are one class; sets are partitioned by length so that only sets in
the same or the next partition can reach the threshold; within those, only sets that share a signature of their prefixes (rarest first) can. Each such
bucket (signature, partition) compares its members with a few hubs first, drawn by hash, in later turns from those that are not of its first component; they join
families that make up a good part of a bucket by a bounded number of comparisons for each member; only members of a bucket that are not linked by then meet each other. Lengths, the places of the shared signature and parity masks of the sets prune before the exact Jaccard. ``near_pairs`` lists all pairs of class
representatives instead, for small inputs.

The query needs each document's successor in descending id order without sorting in one task: ids are cut into ranges at
approximate quantiles and evenly between them (their number follows the size of the texts), ids that hold a range or more by themselves and null ids further by hash
of the text; each range is one window, and the first document of every
range is also sent to the range before it as a ghost. Texts are shuffled once.

Defined results: a null text is an empty one; null ids come last; equal ids are ordered by hash of the text, then text; an input of one
row is its own successor; an empty table gives an empty table; rows repeat as they repeat; texts of any length are read whole (a task holds one with its words);
other columns are not looked at. In groups, a document with an empty set is alone in its class and group, and a null id has neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, materialize, release, table

CHAIN, REACH = 3, 12
#: Turns in which a bucket's members are compared with hubs, and hubs in a turn.
TURNS, HUBS = 3, 2

#: Common words of English, German, French and Spanish.
ANCHORS = """the of and to in a is that it for on was be with as this by are at from an or not but
der die das und den von zu mit des dem ein eine im ist auf für nicht sich auch es er
de la le et les des un une en du que dans qui par pour est sur au pas plus se ce
el los las y del por con para una al lo su no como más""".split()


def words_of(text: str) -> str:
    return rf"split(trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ')), ' ')"


def signatures(words: str) -> str:
    """SQL for the sorted set of signature hashes; words names a column of word arrays."""
    common = "(" + ", ".join(f"'{w}'" for w in dict.fromkeys(ANCHORS)) + ")"
    chain = f"slice(filter(slice({words}, i + 2, {REACH}), y -> y not in {common}), 1, {CHAIN})"
    spots = f"filter(transform({words}, (x, i) -> if(x in {common}, hash(x, array_join({chain}, ' ')), cast(null as int))), h -> h is not null)"
    return f"case when size({words}) = 1 and {words}[0] = '' then cast(array() as array<int>) when exists({words}, x -> x in {common}) then array_sort(array_distinct({spots})) else array(hash('', array_join({words}, ' '))) end"


def fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with column ``name``: the sorted signature set of a text column without nulls."""
    return df.withColumn("__w", F.expr(words_of(text))).withColumn(name, F.expr(signatures("__w"))).drop("__w")


def likeness(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def as_text(column: str) -> str:
    return f"array_join(transform({column}, x -> lpad(lower(hex(cast(x as bigint) & 4294967295)), 8, '0')), '')"


def with_key(df: DataFrame) -> DataFrame:
    return df.withColumn("__key", F.sha2(F.array_join("sigs", ","), 256))


#: Longs of a set's parity mask, and the columns that describe a set beside a signature.
MASKS = 4
SET = ["cid", "n", "place", *[f"m{k}" for k in range(MASKS)]]


def partitioned(classes: DataFrame, threshold: float) -> DataFrame:
    """classes with n, part, the partition by length (sets that reach the threshold are in the same or neighbouring ones), and the parity mask: of each
    signature one bit is turned, so two masks differ in no more bits than the sets in signatures."""
    turn = "if((x & 255) div 64 = {k}, a ^ shiftleft(1L, x & 63), a)"
    masks = {f"m{k}": F.expr(f"aggregate(sigs, 0L, (a, x) -> {turn.format(k=k)})") for k in range(MASKS)}
    return classes.withColumn("n", F.size("sigs")).withColumn("part", F.floor(F.log(F.col("n") + 1e-9) / F.log(F.lit(1 / threshold))).cast("int")).withColumns(masks)


def prefixes(classes: DataFrame, threshold: float) -> DataFrame:
    """sig, part, and SET: the signatures of each class's prefix, rarest first, that another class has too, with their places. Until the prefix is known a signature goes with its class's id and size alone."""
    each = classes.select("cid", "n", F.explode("sigs").alias("sig"))
    shared = each.withColumn("df", F.count("*").over(Window.partitionBy("sig"))).where("df > 1")
    mine = Window.partitionBy("cid")
    place = F.col("n") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("df", "sig"))  # after the ones that no other has
    ranked = shared.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1).select("cid", "sig", "place")
    return ranked.join(classes.select("cid", "part", *[c for c in SET if c not in ("cid", "place")]), "cid").select("sig", "part", *SET)


def named(df: DataFrame, mark: str) -> DataFrame:
    """df with the columns of SET under other names."""
    return df.withColumnsRenamed({c: f"{mark}_{c}" for c in SET})


def may_reach(a: str, b: str, threshold: float) -> Column:
    """Whether two sets that share a signature can reach the threshold: by their sizes, by what follows the signature in them, if it is
    the first that they share (they meet at the first one in any case), and by the bits in which their masks differ."""
    (n, i), (m, j) = ((F.col(f"{x}_n"), F.col(f"{x}_place")) for x in (a, b))
    common = (n + m) * F.lit(threshold / (1 + threshold)) - 1e-9
    apart = sum((F.bit_count(F.col(f"{a}_m{k}").bitwiseXOR(F.col(f"{b}_m{k}"))) for k in range(MASKS)), F.lit(0))
    return (F.least(n, m) >= F.greatest(n, m) * threshold - 1e-9) & (1 + F.least(n - i, m - j) >= common) & (apart <= n + m - 2 * common)


def similar(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of classes that reach the threshold, with their similarity."""
    x, y = (classes.select(F.col("cid").alias(c), F.col("sigs").alias(f"s{c}")) for c in "ab")
    return pairs.join(x, "a").join(y, "b").select(*pairs.columns, likeness("sa", "sb").alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)


def spot_classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_signatures, __key of every row of docs, and the classes: __key, cid, class_id, sigs, n, part."""
    marked = fingerprint(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "sigs").select("doc_id", "sigs", F.size("sigs").alias("n_signatures"))
    marked = materialize(with_key(marked), "spots")
    classes = marked.where("doc_id is not null and n_signatures > 0").groupBy("__key").agg(F.min("doc_id").alias("class_id"), F.first("sigs").alias("sigs"))
    return marked.drop("sigs"), materialize(partitioned(classes.withColumn("cid", F.monotonically_increasing_id()), threshold), "spot-classes")


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """All pairs (a, b, similarity) of class representatives with Jaccard >= threshold, and members (doc_id, class_id).
    Empty sets are linked with nothing; null ids belong to no class."""
    marked, classes = spot_classes(docs, threshold)
    prefix = materialize(prefixes(classes, threshold), "spot-prefixes")
    left = named(prefix, "a").withColumn("part", F.explode(F.array("part", F.col("part") + 1)))
    met = left.join(named(prefix, "b"), ["sig", "part"]).where((F.col("a_cid") != F.col("b_cid")) & may_reach("a", "b", threshold)).select(F.least("a_cid", "b_cid").alias("a"), F.greatest("a_cid", "b_cid").alias("b")).distinct()
    x, y = (classes.select(F.col("cid").alias(c), F.col("class_id").alias(f"id_{c}")) for c in "ab")
    told = similar(met, classes, threshold).join(x, "a").join(y, "b")
    members = marked.where("doc_id is not null").join(classes.select("__key", "class_id"), "__key").select("doc_id", "class_id")
    return told.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "similarity"), members


def near_groups(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_signatures, class_id (the least id with an equal set) and group_id (the least id reachable by links of Jaccard >= threshold) for every row."""
    marked, classes = spot_classes(docs, threshold)
    rows = materialize(prefixes(classes, threshold).withColumn("bucket", F.explode(F.array("part", F.col("part") + 1))).drop("part"), "spot-buckets")
    key, labels = ["sig", "bucket"], None
    for turn in range(TURNS + 1):
        known = rows.withColumn("label", F.col("cid")) if labels is None else rows.join(labels, F.col("cid") == F.col("node"), "left").select(*key, *SET, F.coalesce("label", "cid").alias("label"))
        mixed = known.groupBy(*key).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select(*key, "lo")
        open_ = materialize(known.join(mixed, key), "spot-open")
        b = named(open_, "b").drop("lo")
        if turn < TURNS:
            order = Window.partitionBy(*key).orderBy(F.xxhash64("cid", F.lit(turn)))
            hubs = (open_ if turn == 0 else open_.where("label <> lo")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= HUBS)
            a = named(hubs.drop("r", "lo"), "a").withColumnRenamed("label", "a_label")
        else:
            a = named(open_, "a").drop("lo").withColumnRenamed("label", "a_label")
        apart = (F.col("label") != F.col("a_label")) & ((F.col("a_cid") < F.col("b_cid")) if turn == TURNS else (F.col("a_cid") != F.col("b_cid")))
        met = b.join(a, key).where(apart & may_reach("a", "b", threshold)).select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b"), F.col("a_label").alias("x"), F.col("label").alias("y")).distinct()
        # new links join what is joined already, so the graph has the labels for nodes
        new = components(similar(met, classes, threshold).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        if labels is not None:
            moved = labels.join(new.select(F.col("node").alias("at"), F.col("label").alias("to")), F.col("label") == F.col("at"), "left").select("node", F.coalesce("to", "label").alias("label"))
            new = materialize(moved.unionByName(new.join(labels, "node", "left_anti")), "spot-labels")
        labels = new
        release(open_)
    release(rows)
    placed = classes.select("__key", "class_id", "cid").join(labels, F.col("cid") == F.col("node"), "left").select("__key", "class_id", F.coalesce("label", "cid").alias("label"))
    told = placed.join(placed.groupBy("label").agg(F.min("class_id").alias("group_id")), "label").drop("label")
    out = marked.join(told, "__key", "left")
    alone = F.col("n_signatures") == 0
    return out.select("doc_id", F.col("n_signatures").cast("long").alias("n_signatures"), *[F.when(F.col("doc_id").isNotNull(), F.when(alone, F.col("doc_id")).otherwise(F.col(c))).alias(c) for c in ("class_id", "group_id")])


def range_of(column: Column, edges: list, parts: int) -> Column:
    """Number of the descending range that a value falls in; null in the last. Ranges lie between the quantiles ``edges``
    (descending, the least and greatest value among them), found by binary search, and are cut evenly into ``parts``."""

    def pick(low: int, high: int) -> Column:
        if high - low == 1:
            top, foot = edges[low], edges[high]
            share = F.floor((F.lit(top) - column) / F.lit(max(1, top - foot)) * parts)
            return F.lit(low * parts) + F.least(share, F.lit(parts - 1))
        mid = (low + high) // 2
        return F.when(column > F.lit(edges[mid]), pick(low, mid)).otherwise(pick(mid, high))

    last = F.lit(len(edges) * parts).cast("long")
    return F.when(column.isNull(), last).otherwise(pick(0, len(edges) - 1)) if len(edges) > 1 else F.when(column.isNull(), last).otherwise(F.lit(0).cast("long"))


#: Quantiles at most, so that the search stays a small expression; further ranges come from cutting evenly between them, and an id that
#: holds a range by itself, like the null ids, is cut by hash into so many.
QUANTILES, BY_HASH = 200, 64
#: Bytes of text in a range, about, and ranges whose table is broadcast at most (2 MB).
RANGE_BYTES, FEW_RANGES = 8 << 20, 1 << 16


def with_next(docs: DataFrame, add) -> DataFrame:
    """docs (doc_id, text without nulls) with what ``add`` computes per row, and a struct __next of the next row's
    columns in descending order of doc_id, after the last the first."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shuffled = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (4 * RANGE_BYTES))
    n = min(QUANTILES, 4 * shuffled)
    found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("q"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    cuts = list(found["q"] or [])
    edges = sorted({*cuts, *[x for x in (found["a"], found["b"]) if x is not None]}, reverse=True)
    heavy = F.col("doc_id").isNull() | F.col("doc_id").isin({x for x in cuts if cuts.count(x) > 1})
    # a heavy id is the top of its range; in it, its rows come first, by hash, and those of lower ids last
    of_hash = F.floor((F.xxhash64("text") / F.lit(2.0**64) + 0.5) * (BY_HASH - 1))
    ranged = docs.withColumn("__range", range_of(F.col("doc_id"), edges, -(-4 * shuffled // n)) * BY_HASH + F.when(heavy, F.least(of_hash, F.lit(BY_HASH - 2))).otherwise(BY_HASH - 1))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    # a row per range: its greatest id, and the range before it, for the first one the last; ranges are put in order within their quantile, and of those there are few
    quantile = F.floor(F.col("__range") / (-(-4 * shuffled // n) * BY_HASH))
    heads = ranged.groupBy("__range").agg(F.max("doc_id").alias("__head")).withColumn("__quantile", quantile)
    heads = materialize(heads, "spot-heads")
    last = {r["__quantile"]: r["last"] for r in heads.groupBy("__quantile").agg(F.max("__range").alias("last")).collect()}
    order_ = sorted(last)
    before = F.create_map(*[F.lit(x) for q, p in zip(order_, order_[-1:] + order_[:-1], strict=True) for x in (q, last[p])]) if last else F.lit(None)
    to = F.coalesce(F.lag("__range").over(Window.partitionBy("__quantile").orderBy("__range")), before[F.col("__quantile")] if last else F.lit(0))
    heads = heads.select(F.col("__range").alias("__at"), "__head", to.alias("__to"))
    if heads.count() <= FEW_RANGES:  # beyond that the rows meet them by a shuffle
        heads = F.broadcast(heads)
    first = ranged.join(heads, (F.col("__range") == F.col("__at")) & F.col("doc_id").eqNullSafe(F.col("__head")))
    first = first.withColumn("__k", F.row_number().over(Window.partitionBy("__range").orderBy(*order))).where("__k = 1")
    ghosts = first.select(*docs.columns, F.col("__to").alias("__range"), F.lit(True).alias("__ghost"))
    both = ranged.withColumn("__ghost", F.lit(False)).unionByName(ghosts).repartition(shuffled, "__range")
    made = add(both)
    within = Window.partitionBy("__range").orderBy("__ghost", *order)
    names = [c for c in made.columns if c not in ("__range", "__ghost")]
    return made.withColumns({f"__next_{c}": F.lead(c).over(within) for c in names}).where("not __ghost").drop("__range", "__ghost")


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(docs, lambda d: fingerprint(d, "text", "sigs"))
    both = both.withColumn("n_chars", F.length("text").cast("long"))
    cut = "cast(floor(n_chars / 3) as int)"
    both = both.withColumn("edited", F.expr(f"concat(substring(text, 1, cast(n_chars as int) - {cut}), substring(__next_text, 1, {cut}))"))
    both = fingerprint(both, "edited", "edited_sigs")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.expr(as_text("sigs")).alias("fingerprint"), F.expr(as_text("edited_sigs")).alias("edited_fingerprint"),
        likeness("sigs", "edited_sigs").alias("near_edited"), likeness("sigs", "__next_sigs").alias("near_next"), F.size("sigs").alias("n_signatures"),
    )


def spotsigs_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join over the whole table."""
    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
