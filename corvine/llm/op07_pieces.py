"""Operator 7, SentencePiece encoding and decoding by a relational lattice.

The piece table is a public SentencePiece model (a parameter; never trained or copied here). A text with one blank before it is cut
into units: a blank with the word or the signs after it, those alone, a blank, or a line feed. For the units, substrings up to the longest piece
are exploded and equi-joined to the piece table, the edges are grouped by unit, and a Spark higher-order aggregate folds
Viterbi over the end positions: least cost, then fewest pieces, then the longest last piece. A character
without a piece costs FALLBACK and becomes its UTF-8 bytes, so decoding gives back every text exactly.

The public model has merge ranks, not probabilities; the cost of a piece is 1000 * log2(rank + SHIFT), the code length
a Zipf-Mandelbrot law gives its rank. Codes therefore are the cheapest under that law, not those that merging in order of rank would find.

Units are counted over all texts. The lattice runs once per distinct unit for all units that hold a share of UNIT_SHARE (at most 1 / UNIT_SHARE of them, so their table
may be broadcast) and have LONGEST_UNIT characters at most (the fold of an array costs the square of its length). Rarer units, most of which occur once, and longer ones are folded by the same recurrence where they stand
(``fold``; tests hold it to the lattice): joining their occurrences by unit and regrouping them by text moves more than the input.
Share and length decide only where a unit is coded, never its code.

Defined results: a null text has null ids and no tokens; an empty text no ids; rows repeat as they repeat; texts of any length are read whole (a task holds one batch of them with its codes); input
columns named like an output column are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import importlib
import math
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, bound_batches, materialize, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNIT_SHARE = 2.0**-20
FALLBACK = 60_000
SHIFT = 300
LONGEST_UNIT = 48
#: Distinct units that a task counts before it tells them.
FLUSH = 400_000
UNIT = re.compile(r" ?\w+| ?[^\w \n]+| |\n")
MARK = "▁"


@cache
def load_pieces(path: str = MODEL) -> tuple[dict[str, tuple[int, int]], list[bytes]]:
    """piece -> (cost, id) with blanks for marks, and the bytes that each id decodes to."""
    model = importlib.import_module("sentencepiece").SentencePieceProcessor(model_file=path)
    costs, texts, rank = {}, [], 0
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            texts.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            texts.append(b"")
        else:
            piece = piece.replace(MARK, " ")
            texts.append(piece.encode())
            if model.get_score(i) > -1e8 or piece == " ":  # below stand reserved runs of blanks
                costs[piece] = (round(1000 * math.log2(rank + SHIFT)), i)
                rank += 1
    return costs, texts


def byte_ids(texts: list[bytes]) -> list[int]:
    """Ids of the 256 byte pieces: the first id that decodes to each lone byte, among the ids that come first."""
    found: dict[bytes, int] = {}
    for i, t in enumerate(texts):
        if len(t) == 1:
            found.setdefault(t, i)
    return [found[bytes([b])] for b in range(256)]


def trie(costs: dict[str, tuple[int, int]]) -> tuple:
    """The pieces as a tree of (weight, id, children by character), weight 0 where no piece ends. A weight is cost << 20 | 1, so
    that sums compare by cost, then by number of pieces."""
    root: list = [0, 0, {}]
    for piece, (cost, i) in costs.items():
        node = root
        for c in piece:
            node = node[2].setdefault(c, [0, 0, {}])
        node[:2] = cost << 20 | 1, i

    def frozen(node: list) -> tuple:
        return node[0], node[1], {c: frozen(x) for c, x in node[2].items()}

    return frozen(root)


def fold(unit: str, pieces: tuple) -> list[int]:
    """The ids of a unit by the trie of pieces; a negative one is a character, as its code point, for the fallback to bytes.
    Starts ascend, so of equal sums the first one found has the longest last piece."""
    n, begin = len(unit), pieces[2].get
    best, start, ids = [1 << 62] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    best[0] = 0
    for s in range(n):
        base, e = best[s], s + 1
        node = begin(unit[s])
        if (node is None or not node[0]) and (new := base + (FALLBACK << 20 | 1)) < best[e]:
            best[e], start[e], ids[e] = new, s, -ord(unit[s])
        while node is not None:
            if node[0] and (new := base + node[0]) < best[e]:
                best[e], start[e], ids[e] = new, s, node[1]
            if e == n:
                break
            node = node[2].get(unit[e])
            e += 1
    out = []
    while n:
        out.append(ids[n])
        n = start[n]
    return out[::-1]


def lattice(units: DataFrame, pieces: DataFrame) -> DataFrame:
    """unit, ids for a table of distinct units; pieces: piece, cost, id (of fixed size, so broadcast)."""
    longest = pieces.agg(F.max(F.length("piece"))).first()[0] or 1
    starts = units.select("unit", F.length("unit").alias("n"), F.explode(F.expr("sequence(0, length(unit) - 1)")).alias("s"))
    parts = starts.select("unit", "n", "s", F.explode(F.expr(f"sequence(1, least({longest}, n - s))")).alias("k")).withColumn("piece", F.expr("substring(unit, s + 1, k)"))
    edges = parts.join(F.broadcast(pieces), "piece", "left").where("id is not null or k = 1")
    edge = F.expr(f"struct(s + k as e, s, coalesce(cost, {FALLBACK}) as cost, coalesce(id, -ascii(piece)) as id)")  # ascii() is the code point
    grouped = edges.groupBy("unit", "n").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    best = """aggregate(sequence(1, n), array(struct(0 as cost, 0 as k, 0 as s, 0 as id)), (b, p) -> concat(b, array(array_min(
        transform(filter(edges, x -> x.e = p), x -> struct(b[x.s].cost + x.cost as cost, b[x.s].k + 1 as k, x.s as s, x.id as id))))))"""
    back = "aggregate(sequence(1, n), struct(n as at, cast(array() as array<int>) as ids), (a, p) -> if(a.at = 0, a, struct(b[a.at].s as at, concat(array(b[a.at].id), a.ids) as ids)), a -> a.ids)"
    return grouped.withColumn("b", F.expr(best)).select("unit", F.expr(back).alias("ids"))


def common_units(docs: DataFrame, text: str) -> DataFrame:
    """Units with a share of UNIT_SHARE of all units and LONGEST_UNIT characters at most."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([*seen], pa.string()), pa.array([*seen.values()], pa.int64())], names=["unit", "n"])

        for b in batches:
            for t in b.column(0):
                if t.is_valid:
                    seen.update(UNIT.findall(" " + t.as_py()))
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    counted = materialize(docs.select(text).mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")), "units")
    total = counted.agg(F.sum("n")).first()[0] or 0
    return counted.where((F.col("n") >= UNIT_SHARE * total) & (F.length("unit") <= LONGEST_UNIT)).select("unit")


def encode_pieces(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """docs with piece_ids (array of int) and n_pieces."""
    spark = docs.sparkSession
    bound_batches(spark)
    costs, texts = load_pieces(model)
    bytes_ = byte_ids(texts)
    pieces = spark.createDataFrame([(p, c, i) for p, (c, i) in costs.items()], "piece string, cost int, id int")
    rows = lattice(common_units(docs, text), pieces).toPandas()

    def packed(ids) -> bytes:
        flat = []
        for i in ids:
            flat += [i] if i > 0 else [bytes_[b] for b in chr(-i).encode()]
        return np.array(flat, np.int32).tobytes()

    held = spark.sparkContext.broadcast((dict(zip(rows["unit"], map(packed, rows["ids"]), strict=True)), trie(costs)))

    def make():
        known, pieces = held.value
        rare: dict[str, bytes] = {}

        def code(unit: str) -> bytes:
            ids = rare.get(unit)
            if ids is None:
                if len(rare) > 200_000:
                    rare.clear()
                ids = rare[unit] = packed(fold(unit, pieces))
            return ids

        def run(column):
            out = []
            for t in column:
                t = t.as_py()
                out.append(b"".join([known.get(u) or code(u) for u in UNIT.findall(" " + t)]) if t else None if t is None else b"")
            sizes = np.array([len(x) // 4 if x else 0 for x in out])
            at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([*[x is None for x in out], False]))
            ids = pa.ListArray.from_arrays(at, pa.array(np.frombuffer(b"".join([x for x in out if x]), np.int32)))
            return [ids, pa.array(sizes, pa.int64())]

        return run

    return append_columns(docs, [text], [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType())], make)


def decode_pieces(coded: DataFrame, ids: str = "piece_ids", model: str = MODEL) -> DataFrame:
    """coded with decoded, the text of the ids; null for null ids."""
    held = coded.sparkSession.sparkContext.broadcast(load_pieces(model)[1])

    def make():
        table_ = np.frombuffer(b"".join(held.value), np.uint8)
        size = np.array([len(t) for t in held.value])
        start = np.cumsum(size) - size

        def run(column):
            ids = column.flatten().to_numpy()
            of = size[ids]
            ends = np.concatenate([[0], np.cumsum(of)])
            data = table_[np.repeat(start[ids] - ends[:-1], of) + np.arange(ends[-1])].tobytes()
            at = ends[np.cumsum([0, *[len(x) if x.is_valid else 0 for x in column]])]
            return [[data[a + 1 : b].decode(errors="replace") if x.is_valid else None for x, a, b in zip(column, at, at[1:], strict=False)]]

        return run

    return append_columns(coded, [ids], [T.StructField("decoded", T.StringType())], make)


def op7_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the digest of what they decode to."""
    coded = decode_pieces(encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return coded.select("doc_id", "n_pieces", "piece_ids", F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))
