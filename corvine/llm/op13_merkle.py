"""Operator 13, Merkle dataset manifest, broadcast upper-tree variant.

Every row is a leaf; per group (a language) leaves stand in the order of their id, and every FAN consecutive nodes become their hash until one is left, the
group's subroot. Subroots in order of their group (null first, bytewise) likewise give the root. H is the lowercase hex SHA-256 of its inputs, concatenated as hex text.

Scale: texts are hashed where they are read and move nowhere. The leaves are put in order by ranges, numbered by prefix sums over (range, group),
and cut into blocks of BLOCK consecutive leaves (a power of FAN); a task reduces blocks to their roots and packs each block into one row. While more than TOP nodes are
left, their blocks are reduced the same way, by group and, where the groups alone are more than that, over the subroots. The top tree, TOP nodes at most, is built on the driver; the path from
each of them to the root is broadcast, and the blocks' rows finish proofs and folds without a further shuffle. Nothing larger than a block meets in a task, whatever a group holds.

Defined results: null ids come first in their group, rows of one id are ordered by their leaf, and equal rows are leaves of their own (their proofs may differ);
a null group is a group, other than the empty one; a row alone has the leaf for its root and the hash of nothing for its proof; a null text is not tampered with, nor is a row without an id; texts of
any length are hashed whole; other columns are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, id_bucket, materialize, table

FAN = 8
#: Leaves of a block, nodes that the driver gets, rows of a range about.
BLOCK, TOP, RANGE_ROWS = FAN**4, 4096, 1 << 18
#: Rows of a table of sizes that is broadcast.
SMALL = 1 << 17
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_of(*columns: Column) -> Column:
    """H of the values: ``-`` for null, else byte count, colon, value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in texts]), 256)


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def reduced(nodes: list[str], fan: int, most: int) -> tuple[str, list[bytes]]:
    """The node that ``most`` (a power of ``fan``) places become, of which ``nodes`` are the first that are taken; one place stays as it is. And of each node its path:
    per round its place in its run, the size of the run and the digests of the others."""
    at = list(range(len(nodes)))
    paths: list[list[bytes]] = [[] for _ in nodes]
    while most > 1:
        runs = [nodes[i : i + fan] for i in range(0, len(nodes), fan)]
        raw = [[bytes.fromhex(h) for h in run] for run in runs]
        for path, k in zip(paths, at, strict=True):
            run, place = raw[k // fan], k % fan
            path.append(bytes((place, len(run))) + b"".join(run[:place]) + b"".join(run[place + 1 :]))
        nodes = [digest(run) for run in runs]
        at = [k // fan for k in at]
        most //= fan
    return nodes[0], [b"".join(p) for p in paths]


def rounds(n: int, fan: int) -> int:
    """fan to the rounds that n nodes take until one is left."""
    most = 1
    while most < n:
        most *= fan
    return most


def steps(path: bytes) -> Iterator[tuple[int, list[str]]]:
    """Of each round the place of the node and the digests of the others."""
    i = 0
    while i < len(path):
        place, n = path[i], path[i + 1]
        i += 2
        yield place, [path[j : j + 32].hex() for j in range(i, i + 32 * (n - 1), 32)]
        i += 32 * (n - 1)


def fold(leaf: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its path give."""
    for place, others in path:
        leaf = digest([*others[:place], leaf, *others[place:]])
    return leaf


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with a long column ``name``, the place of each in its group (from 0) in the order of the columns ``order``, nulls first, and ``n``, the size of its group.
    The last of them should tell equal rows apart, so that no value fills a range. Rows are sorted by ranges; sizes of (range, group) are summed up before."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS)
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, k = None, -1
        for b in batches:
            here = []
            for g in b.column(b.schema.get_field_index(group)).to_pylist():
                held, k = (g, k + 1) if g == held else (g, 0)
                here.append(k)
            yield b.append_column(name, pa.array(here, pa.int64()))

    ranged = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__range", F.spark_partition_id())
    ranged = materialize(ranged.mapInArrow(number, T.StructType([*ranged.schema.fields, T.StructField(name, T.LongType())])), "merkle-ranges")
    sizes = ranged.groupBy(F.col(group).alias("__group"), F.col("__range").alias("__in")).agg(F.count("*").alias("__n"))
    all_ = Window.partitionBy("__group")
    before = F.sum("__n").over(all_.orderBy("__in").rowsBetween(Window.unboundedPreceding, -1))
    sizes = materialize(sizes.select("__group", "__in", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(all_).alias("n")), "merkle-sizes")
    if sizes.count() <= SMALL:
        sizes = F.broadcast(sizes)
    placed = ranged.join(sizes, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__range") == F.col("__in")))
    return placed.withColumn(name, F.col(name) + F.col("__before")).select(*rows.columns, name, "n")


PACKED = "key string, block long, root string, pos array<long>, nodes array<string>, paths array<binary>"


def blocks(nodes: DataFrame, fan: int, block: int) -> DataFrame:
    """One row for each run of ``block`` consecutive nodes (key, pos, node, n: how many the key has): its root, and its nodes with their paths in it."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        pos, n = t["pos"].to_pylist(), t["n"][0].as_py()
        root, paths = reduced(t["node"].to_pylist(), fan, min(block, rounds(n, fan)))
        row = {"key": t["key"][:1].to_pylist(), "block": [pos[0] // block], "root": [root], "pos": [pos], "nodes": [t["node"].to_pylist()], "paths": [paths]}
        return pa.table(row, schema=pa.schema([("key", pa.string()), ("block", pa.int64()), ("root", pa.string()), ("pos", pa.list_(pa.int64())), ("nodes", pa.list_(pa.string())), ("paths", pa.list_(pa.binary()))]))

    return nodes.select("key", "pos", "node", "n").groupBy("key", F.expr(f"pos div {block}")).applyInArrow(run, PACKED)


def sized(nodes: DataFrame) -> DataFrame:
    """nodes with n: the number of nodes of their key. Keys are counted first, so a large one is no window."""
    counts = nodes.groupBy(F.col("key").alias("__key")).agg(F.max("pos").alias("__last"))
    return nodes.join(counts, nodes["key"].eqNullSafe(counts["__key"])).withColumn("n", F.col("__last") + 1).drop("__key", "__last")


class Tree:
    """The nodes above some blocks: levels (DataFrames key, pos, up, path) while they are more than ``top``, and the driver's part."""

    def __init__(self, nodes: DataFrame, fan: int, block: int, top: int):
        """nodes: key, pos, node; pos counts from 0 within a key."""
        self.fan, self.levels, self.subtree = fan, [], None
        while True:
            size = nodes.agg(F.count("*").alias("n"), F.max("pos").alias("last")).first()
            if size["n"] <= top or size["last"] == 0:
                break
            made = materialize(blocks(sized(nodes), fan, block), "merkle-levels")
            self.levels.append(made.select("key", F.col("block").alias("up"), F.explode(F.arrays_zip("pos", "paths")).alias("x")).select("key", "up", F.col("x.pos").alias("pos"), F.col("x.paths").alias("path")))
            nodes = made.select("key", F.col("block").alias("pos"), F.col("root").alias("node"))
        self.nodes, self.few = nodes, size["n"] <= top

    def known(self) -> tuple[dict, str | None]:
        """(key, pos) -> (path to the root, subroot) of the last nodes, and the root. Only where they are few."""
        groups: dict = {}
        for r in self.nodes.orderBy(F.col("key").asc_nulls_first(), "pos").collect():
            groups.setdefault(r["key"], []).append(r["node"])
        done = {k: reduced(v, self.fan, rounds(len(v), self.fan)) for k, v in groups.items()}
        if not done:
            return {}, None
        root, paths = reduced([r for r, _ in done.values()], self.fan, rounds(len(done), self.fan))
        return {(k, i): (p + above, sub) for (k, (sub, own)), above in zip(done.items(), paths, strict=True) for i, p in enumerate(own)}, root


def suffixes(heads: DataFrame, fan: int, block: int, top: int) -> tuple[DataFrame, str | None]:
    """heads (key, pos, node: blocks' roots by their group) with ``suffix``, the path from each to the root, and ``subroot``; and the root."""
    spark = heads.sparkSession
    tree = Tree(heads, fan, block, top)
    if tree.few:
        known, root = tree.known()
        held = spark.sparkContext.broadcast(known)

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [held.value[k] for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([p for p, _ in found], pa.binary()), pa.array([s for _, s in found], pa.string())], names=["key", "pos", "suffix", "subroot"])

        out = tree.nodes.select("key", "pos").mapInArrow(told, "key string, pos long, suffix binary, subroot string")
    else:  # every group has its subroot, and they are many: a tree of their own under one key
        named = tree.nodes.select(F.lit("").alias("all"), F.col("key").alias("of"), F.col("node"))
        many = materialize(numbered(named, "all", ["of", "node"], "at"), "merkle-subroots")
        over, root = suffixes(many.select(F.col("all").alias("key"), F.col("at").alias("pos"), "node"), fan, block, top)
        out = many.join(over.select(F.col("pos").alias("at"), "suffix"), "at").select(F.col("of").alias("key"), F.lit(0).cast("long").alias("pos"), "suffix", F.col("node").alias("subroot"))
    for level in reversed(tree.levels):
        up = out.select(F.col("key").alias("__key"), F.col("pos").alias("__up"), F.col("suffix").alias("__suffix"), "subroot")
        out = level.join(up, level["key"].eqNullSafe(up["__key"]) & (level["up"] == up["__up"])).select("key", "pos", F.concat("path", "__suffix").alias("suffix"), "subroot")
    return out, root


def manifest(leaves: DataFrame, fan: int = FAN, block: int = BLOCK, top: int = TOP) -> DataFrame:
    """leaves: doc_id, key (the group), leaf, tampered (the leaf as found later). Gives doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    block is a power of fan."""
    spark = leaves.sparkSession
    bound_batches(spark)
    held = materialize(leaves.select("doc_id", "key", "leaf", F.when(F.col("tampered") != F.col("leaf"), F.col("tampered")).alias("tampered"), F.monotonically_increasing_id().alias("copy")), "merkle-leaves")
    # equal rows are told apart by where they were read
    placed = numbered(held, "key", ["doc_id", "leaf", "copy"], "pos")

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        nodes = t["leaf"].to_pylist()
        root, _ = reduced(nodes, fan, min(block, rounds(t["n"][0].as_py(), fan)))
        row = [t["key"].slice(0, 1), pa.array([t["pos"][0].as_py() // block]), pa.array([root]), pa.array([t["n"][0].as_py()]), *[pa.array([t[c].to_pylist()], pa.list_(kind)) for c, kind in (("doc_id", pa.int64()), ("leaf", pa.string()), ("tampered", pa.string()))]]
        return pa.table(row, names=["key", "block", "root", "n", "doc_ids", "leaves", "tampered"])

    packed = placed.select("key", "pos", "n", "doc_id", "leaf", "tampered").groupBy("key", F.expr(f"pos div {block}")).applyInArrow(pack, "key string, block long, root string, n long, doc_ids array<long>, leaves array<string>, tampered array<string>")
    packed = materialize(packed, "merkle-blocks")
    over, root = suffixes(packed.select("key", F.col("block").alias("pos"), F.col("root").alias("node")), fan, block, top)
    over = over.withColumnsRenamed({"key": "__key", "pos": "__pos"})
    whole = packed.join(over, packed["key"].eqNullSafe(over["__key"]) & (packed["block"] == over["__pos"])).select("n", "doc_ids", "leaves", "tampered", "suffix", "subroot")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        for b in batches:
            for i in range(b.num_rows):
                r = {k: v[0] for k, v in b.slice(i, 1).to_pydict().items()}
                above = list(steps(r["suffix"]))
                over = [h for _, others in above for h in others]
                _, paths = reduced(r["leaves"], fan, min(block, rounds(r["n"], fan)))
                proofs, folds = [], []
                for leaf, other, path in zip(r["leaves"], r["tampered"], paths, strict=True):
                    own = list(steps(path))
                    proofs.append(digest([*[h for _, others in own for h in others], *over]))
                    folds.append(fold(fold(other or leaf, own), above))
                n = len(proofs)
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(r["leaves"]), pa.array([r["subroot"]] * n), pa.array([root] * n), pa.array(proofs), pa.array(folds), pa.array([f == root for f in folds])], names=names)

    return whole.mapInArrow(finish, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    columns = {c: F.col(c) for c in COLUMNS}
    found_later = columns | {"text": F.translate("text", UPPER, LOWER)}
    tampered = F.coalesce(id_bucket("doc_id", 3) == 0, F.lit(False))
    leaf = leaf_of(*columns.values())
    leaves = docs.select("doc_id", F.col("lang").alias("key"), leaf.alias("leaf"), F.when(tampered, leaf_of(*found_later.values())).alias("tampered"))
    return manifest(leaves)
