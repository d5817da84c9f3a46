"""Operator 8, near-duplicates by min-max hashing.

Each permutation of the hashed shingles gives two signature values, its minimum and its maximum, so PERMUTATIONS hash
evaluations per shingle make 2 * PERMUTATIONS values. They are banded by ROWS; documents that share a
band are candidates. At a similarity of 0.85 a pair shares no band with probability 2e-10, at 0.8 with 1e-7.

1. One pass over the texts makes, per row, the set size, a 128-bit digest of the set, signature and bands; it is written with the text.
2. Rows of equal sets are one class (partial minimum per task, then per digest), known by the number of one of its rows, never by its id.
3. Buckets (band, key) are named by their smallest member; classes of one name form a group. In it, signatures and sizes are compared
   and a spanning forest of the likely pairs comes out: no more rows than members. Its components are the clusters.
4. Within a cluster the full sets (64-bit hashes of all shingles) are compared exactly. Out comes a
   spanning forest of the confirmed links, whose components are the result; the least id in each names it.

Forests: every member is first compared with its group's hub, the member that names it, by a join that has one row per group on one side, so a
group of any size spreads over tasks. Only what the hub does not meet is compared on, with all
members but the hub, by search: a member in turn is compared with all that no tree holds yet. No link between members is thus lost, and no
list of pairs is ever made. For that, large groups are dealt into blocks of at most about BLOCK members and SHINGLES shingles, one task per pair of blocks.

Components are found by minimum labels with pointer jumping, each round written to the shared folder.

Defined results: an empty or null text has an empty set and is linked with nothing; a null doc_id is linked with nothing, has a null
component_id and is kept; rows are judged by their own text, whether or not other rows have the same id, so repeated rows share a component and are alike
kept or not; fewer words than a shingle count as one shingle; equal smallest ids are ties without effect; texts of any length are read whole
(a task holds some of them with their sets); ``without_copies`` carries all other columns as they are, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, bound_batches, components, materialize, release, table

PERMUTATIONS, ROWS = 60, 4
BLOCK, SHINGLES = 1000, 1 << 21
#: A pair is likely if its signatures agree in at least threshold - SLACK, about six standard errors.
SLACK = 0.2


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sequence(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
BYTE = sequence(256, 1)[LOWER]
BASE = 0x2545F4914F6CDD1D
INVERSE = pow(BASE, -1, 1 << 64)
PLACE = sequence(64, 2) | np.uint64(1)
TIMES, PLUS = sequence(PERMUTATIONS, 3) | np.uint64(1), sequence(PERMUTATIONS, 4)


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, as long as the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int):
        while len(self.up) < n:
            k = len(self.up)
            self.up, self.down = (np.concatenate([p, p * np.uint64(pow(b, k, 1 << 64))]) for p, b in ((self.up, BASE), (self.down, INVERSE)))
        return self.up[:n], self.down[:n]


def shingle_set(data: np.ndarray, words: int, powers: Powers) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text's bytes."""
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = ~BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers.reach(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * up, dtype=np.uint64)])
    word = mix((total[ends] - total[starts]) * down[starts])
    n = len(word) - words + 1
    if n < 1:
        return mix((word * PLACE[: len(word)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(word)))
    whole = word[:n] * PLACE[0]
    for k in range(1, words):
        whole = whole + word[k : k + n] * PLACE[k]
    return np.unique(mix(whole))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, side by side."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(shingles), 2048):
        placed = TIMES[:, None] * shingles[None, i : i + 2048] + PLUS[:, None]
        low, high = np.minimum(low, placed.min(axis=1)), np.maximum(high, placed.max(axis=1))
    return np.stack([low, high], axis=1).ravel()


def bands(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(-1, ROWS)
    return mix((rows * PLACE[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(len(rows), dtype=np.uint64))


def text_bytes(t: pa.Scalar) -> np.ndarray:
    return np.frombuffer(t.as_buffer(), np.uint8) if t.is_valid and t.as_buffer() is not None else np.zeros(0, np.uint8)


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """row (a number of its own), doc_id, text, others (a struct of all other columns), n_shingles, low, high (set digest), bands, sig (8
    bits of each signature value)."""
    long = T.LongType()
    fields = [T.StructField("n_shingles", long), T.StructField("low", long), T.StructField("high", long), T.StructField("bands", T.ArrayType(long)), T.StructField("sig", T.BinaryType())]

    def make():
        powers = Powers()

        def run(texts):
            n, low, high, keys, sigs = [], [], [], [], []
            for t in texts:
                s = shingle_set(text_bytes(t), words, powers)
                n.append(len(s))
                low.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                high.append(int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)))
                values = signature(s) if len(s) else np.zeros(0, np.uint64)
                keys.append(bands(values).view(np.int64) if len(s) else np.zeros(0, np.int64))
                sigs.append((values >> np.uint64(24)).astype(np.uint8).tobytes())
            at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            return [pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.ListArray.from_arrays(at, pa.array(np.concatenate(keys))), pa.array(sigs, pa.binary())]

        return run

    others = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    return append_columns(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", others.alias("others")), ["text"], fields, make)


def similar_sizes(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(a, b) * 100 >= np.maximum(a, b) * percent


def signatures(data: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)


def likely(n: np.ndarray, data: list[bytes], hub_n: np.ndarray, hub: list[bytes], percent: int) -> np.ndarray:
    """Which rows may meet their hubs, by sizes and signatures."""
    sig = signatures(data)
    return similar_sizes(n, hub_n, percent) & ((sig == signatures(hub)).sum(axis=1) >= (percent / 100 - SLACK) * sig.shape[1])


def exact(n: np.ndarray, data: list[bytes], hub_n: np.ndarray, hub: list[bytes], percent: int) -> np.ndarray:
    """Which rows meet their hubs: 100 * |a & b| >= percent * |a | b| on the full sets."""
    out = similar_sizes(n, hub_n, percent)
    for i in np.flatnonzero(out):
        a, b = np.frombuffer(data[i], np.uint64), np.frombuffer(hub[i], np.uint64)
        both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        out[i] = 100 * both >= percent * (len(a) + len(b) - both)
    return out


def forest(ids: np.ndarray, near: np.ndarray, order: np.ndarray, alike) -> pd.DataFrame:
    """Edges (a, b) that join the rows to trees. Rows with ``near`` are of one tree already; alike(i, rest) tells which of the rows
    ``rest`` row i meets; rows are tried in ``order``."""
    todo, rest, edges = order[near[order]].tolist(), order[~near[order]], []
    while len(rest):
        if not todo:
            todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            met = alike(i, rest)
            edges += [(ids[i], ids[j]) for j in rest[met]]
            todo += rest[met].tolist()
            rest = rest[~met]
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def likely_forest(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """By sizes and signatures."""
    rows = rows.sort_values("cid")
    sig, n = signatures(list(map(bytes, rows["data"]))), rows["n"].to_numpy()
    least = (percent / 100 - SLACK) * sig.shape[1]
    return forest(rows["cid"].to_numpy(), rows["near"].to_numpy(bool), np.arange(len(rows)), lambda i, rest: similar_sizes(n[rest], n[i], percent) & ((sig[rest] == sig[i]).sum(axis=1) >= least))


def exact_forest(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """By the full sets, from the member that shares most with all others on."""
    rows = rows.sort_values("cid")
    sets = [np.frombuffer(x, np.uint64) for x in rows["data"]]
    sizes = np.array([len(x) for x in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    shared = np.add.reduceat(np.bincount(code)[code], ends - sizes) / sizes
    parts = [code[e - k : e] for e, k in zip(ends, sizes, strict=True)]
    mark = np.zeros(code.max() + 1, bool)

    def alike(i: int, rest: np.ndarray) -> np.ndarray:
        mark[parts[i]] = True
        good = similar_sizes(sizes[rest], sizes[i], percent)
        both = np.array([np.count_nonzero(mark[parts[j]]) if g else 0 for j, g in zip(rest, good, strict=True)], np.int64)
        mark[parts[i]] = False
        return good & (100 * both >= percent * (sizes[rest] + sizes[i] - both))

    return forest(rows["cid"].to_numpy(), rows["near"].to_numpy(bool), np.argsort(-shared, kind="stable"), alike)


def set_rows(rows: DataFrame, words: int) -> DataFrame:
    """rows with data, the full set of a text, instead of the text."""

    def make():
        powers = Powers()
        return lambda texts: [pa.array([shingle_set(text_bytes(t), words, powers).tobytes() for t in texts], pa.binary())]

    return append_columns(rows, ["text"], [T.StructField("data", T.BinaryType())], make).drop("text")


def links(rows: DataFrame, compare, grow, percent: int) -> DataFrame:
    """Edges (a, b) of a spanning forest of each group. rows: name (the group, known by its hub's cid), cid, n, data."""
    bound_batches(rows.sparkSession)

    def run(batches):
        for b in batches:
            name, cid, n, data, hub_n, hub = b.columns
            near = compare(n.to_numpy(), data.to_pylist(), hub_n.to_numpy(), hub.to_pylist(), percent) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([name, cid, n, pa.array(near, pa.bool_())], names=["name", "cid", "n", "near"])

    hubs = rows.where("cid = name").select("name", F.col("n").alias("hub_n"), F.col("data").alias("hub"))
    others = rows.where("cid <> name")
    tested = materialize(others.join(hubs, "name").select("name", "cid", "n", "data", "hub_n", "hub").mapInArrow(run, "name long, cid long, n long, near boolean"), "tested")
    near, far = F.col("near"), ~F.col("near")
    blocks = lambda which: F.greatest(F.ceil(F.count_if(which) / BLOCK), F.ceil(F.sum(F.when(which, F.col("n")).otherwise(0)) / SHINGLES)).cast("int")
    open_ = tested.groupBy("name").agg(F.count("*").alias("m"), blocks(near).alias("x"), blocks(far).alias("y")).where("y > 0 and m > 1").select("name", "x", "y")
    # blocks 0 .. x - 1 are the hub's, x .. x + y - 1 are open; each pair with an open block in it is a task
    mine = F.when(near, F.pmod(F.xxhash64("cid"), F.col("x"))).otherwise(F.col("x") + F.pmod(F.xxhash64("cid"), F.col("y"))).cast("int")
    dealt = tested.join(open_, "name").withColumn("block", mine)
    dealt = dealt.withColumn("with", F.explode(F.expr("if(near, sequence(x, x + y - 1), if(x + y = 1, array(0), filter(sequence(0, x + y - 1), k -> k <> block)))")))
    dealt = dealt.select("name", "cid", "near", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    found = dealt.join(others, ["name", "cid"]).groupBy("name", "i", "j").applyInPandas(lambda g: grow(g, percent), "a long, b long")
    return tested.where("near").select(F.col("name").alias("a"), F.col("cid").alias("b")).unionByName(found)


def classify(docs: DataFrame, words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """The sketch of every row, and for each class of more than no shingles low, high, component_id and first (the row that stays of the component)."""
    base = materialize(sketch(docs, words), "sketch")  # with the texts: rows are known by numbers that hold for this copy only
    full = base.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("low", "high").agg(F.min(F.struct("doc_id", "row", "n_shingles", "bands", "sig")).alias("rep"))
    classes = materialize(classes.select("low", "high", F.col("rep.doc_id").alias("least"), F.col("rep.row").alias("cid"), F.col("rep.n_shingles").alias("n"), "rep.bands", "rep.sig"), "classes")
    spread = classes.select("cid", F.posexplode("bands").alias("band", "key"))
    shared = spread.groupBy("band", "key").agg(F.min("cid").alias("name"), F.max("cid").alias("last")).where("name < last")
    groups = spread.join(shared.select("band", "key", "name"), ["band", "key"]).select("name", "cid").distinct()
    candidates = materialize(groups.join(classes.select("cid", "n", F.col("sig").alias("data")), "cid").select("name", "cid", "n", "data"), "candidates")
    clusters = components(links(candidates, likely, likely_forest, percent))
    release(candidates)
    texts = base.select("row", "n_shingles", "text").join(clusters, F.col("row") == F.col("node"))
    sets = materialize(set_rows(texts.select(F.col("label").alias("name"), F.col("row").alias("cid"), F.col("n_shingles").alias("n"), "text"), words), "sets")
    labels = components(links(sets, exact, exact_forest, percent))
    release(sets)
    known = classes.select("cid", "least")
    linked = materialize(labels.join(known, F.col("node") == F.col("cid")).select("cid", "label", "least"), "linked")
    first = linked.groupBy("label").agg(F.min(F.struct("least", "cid")).alias("first"))
    of = linked.join(first, "label").select("cid", "first")
    placed = classes.select("low", "high", "cid", "least").join(of, "cid", "left").withColumn("first", F.coalesce("first", F.struct("least", "cid")))
    return base, placed.select("low", "high", F.col("first.least").alias("component_id"), F.col("first.cid").alias("first"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id long, text). Links: 100 * |a & b| >= percent * |a | b|."""
    base, placed = classify(docs.select("doc_id", "text"), words, percent)
    out = base.select("doc_id", "n_shingles", "low", "high").join(placed, ["low", "high"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates, one with the group's least id, and all its columns as they are. Rows without an id, and rows
    without a shingle, stay."""
    base, placed = classify(docs, words, percent)
    stay = placed.select("first").distinct()
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    kept = base.where(~alone).join(stay, F.col("row") == F.col("first"), "left_semi").unionByName(base.where(alone))
    return kept.select(*[F.col("others")[c].alias(c) if c not in ("doc_id", "text") else F.col(c) for c in docs.columns])


def op8_minmax_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85)
