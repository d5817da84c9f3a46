"""Nearest references by exact distance or mask overlap.

Vectors: references are dealt to balls around pivots, and lie in blocks in the order of the balls. In a block a row is compared with the balls next to it first, which bounds how far its nearest
can be; then only with the balls that may hold something as near, by the triangle inequality (the row's distance to a pivot less the ball's radius). What is left out can not be among the
nearest, so the result is exact. Pivots and radii are a table of fixed size. Masks go by blocks of all rows and all references.

A task compares a block of rows with one of references (WIDE * BLOCK vectors or masks, MANY times as many references where they are masks), some CELLS pairs at a time, so its memory is two blocks, however many rows a ball or a group holds. A matrix product
tells which pairs may be among the nearest, and only their distances are taken from the differences themselves. It returns partial minima only (per row and class, or the k best), which a
shuffle on the row reduces, so no pairs are emitted. Where no ball can be left out (many dimensions) all pairs are compared: time grows with their number, what is shuffled with their number by the block."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .iterate import cut

BLOCK = 2048
#: Rows and references of a task over balls, in blocks.
WIDE = 8
#: References of a task over masks, in blocks of rows; blocks that rows are dealt to while they are few.
MANY, SPREAD = 16, 64
#: Cells of differences at once.
CELLS = 1 << 21
#: Share of a block's pairs from which on all of them are compared at once.
DENSE = 0.2


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, from the differences themselves."""
    out = np.empty((len(a), len(b)))
    step = max(1, CELLS // max(1, b.size))
    for i in range(0, len(a), step):
        gap = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


def bits(masks: np.ndarray) -> np.ndarray:
    """The 64 bits of each mask as columns."""
    return np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)


def most_overlap(a: np.ndarray, ids: np.ndarray, b: np.ndarray, refs: np.ndarray, k: int, apart: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows, references and costs: for each mask of a the k of b with the most overlap, the smaller ref on ties, and of how many pairs the cost was taken. It is 1 - intersection over union,
    1 where both are empty.

    References come in order, so a later one has to be better than the k-th so far, n / d: intersection * (n + d) - n * size(b) > n * size(a), in whole numbers that a float holds exactly. One
    matrix product tells that of all pairs of a piece, and the cost is taken of the few for which it holds. Pieces are short at first, as all of the first k are taken."""
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    order = np.argsort(refs, kind="stable")
    b, refs = b[order], refs[order]
    size_a, bits_a = np.bitwise_count(a).astype(np.float32), bits(a)
    wide = int(CELLS**0.5) // 2
    parts = [slice(i, i + wide) for i in range(0, len(a), wide)]
    none = np.zeros(0, np.int64)
    held = [(none, none, np.zeros(0)) for _ in parts]
    n, d, least = np.zeros(len(a), np.float32), np.zeros(len(a), np.float32), np.full(len(a), -1, np.float32)
    begin = told = 0
    while begin < len(b):
        end = min(len(b), begin + min(4 * wide, max(64, begin)))
        piece = np.column_stack([bits(b[begin:end]), np.bitwise_count(b[begin:end]).astype(np.float32)]).T
        for i, part in enumerate(parts):
            better = np.column_stack([bits_a[part] * (n + d)[part, None], -n[part]]) @ piece > least[part, None]
            x, y = np.divmod(np.flatnonzero(better), end - begin)
            x, y = x + part.start, y + begin
            if apart:
                other = ids[x] != refs[y]
                x, y = x[other], y[other]
            if not len(x):
                continue
            told += len(x)
            both, either = np.bitwise_count(a[x] & b[y]).astype(float), np.bitwise_count(a[x] | b[y]).astype(float)
            x, y, cost = (np.concatenate(v) for v in zip(held[i], (x, y, np.where(either > 0, 1 - both / np.maximum(either, 1), 1.0)), strict=True))
            best = first_of_each(x, cost, y, k)
            held[i] = x, y, cost = x[best], y[best], cost[best]
            last = np.flatnonzero(np.arange(len(x)) - np.searchsorted(x, x) == k - 1)
            row, to = x[last], y[last]
            n[row], d[row] = np.bitwise_count(a[row] & b[to]), np.maximum(np.bitwise_count(a[row] | b[to]), 1)
            least[row] = n[row] * size_a[row]
        begin = end
    x, y, cost = (np.concatenate(v) for v in zip(*held, strict=True)) if held else (none, none, np.zeros(0))
    return x, order[y], cost, told


def scan(rows: DataFrame, references: DataFrame, k: int, apart: bool, schema: T.StructType, told=None) -> DataFrame:
    """Partial results that hold the k references of most overlap of every row. rows: id, value; references: ref, value; values are masks."""
    of_rows, of_references = rows.count(), references.count()
    x, y = max(-(-of_rows // (WIDE * BLOCK)), min(SPREAD, -(-of_rows // BLOCK)), 1), max(1, -(-of_references // (MANY * WIDE * BLOCK)))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = rows.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(x)).cast("int")).withColumn("j", every(y))
    b = references.select("ref", F.col("value").alias("target"), F.pmod(F.xxhash64("ref"), F.lit(y)).cast("int").alias("j")).withColumn("i", every(x))
    arrow = to_arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        ids, refs = left["id"].to_numpy(), right["ref"].to_numpy()
        at, to, cost, n = most_overlap(left["value"].to_numpy(), ids, right["target"].to_numpy(), refs, k, apart)
        if told is not None:
            told.add(n)
        return pa.table({"id": ids[at], "class": np.zeros(len(at), np.int32), "dist": cost, "ref": refs[to]}, schema=arrow)

    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(run, schema)


#: Pivots at most, references that they are chosen from, and balls (pivots times classes) at most.
PIVOTS, SAMPLE, BALLS = 1024, 4096, 1 << 16
#: What rounding may take off a bound.
SLACK = 1e-9


def matrix(c: pa.Array | pa.ChunkedArray) -> np.ndarray:
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy().astype(float).reshape(len(c), -1)


def far_apart(points: np.ndarray, most: int) -> np.ndarray:
    """Of some points one after the other the one farthest from those chosen, until all are as one of them."""
    chosen = [0]
    far = distances(points, points[:1])[:, 0]
    while len(chosen) < most and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def dealt(n: int, width: int) -> list[slice]:
    """n rows in pieces, so that each with ``width`` columns has CELLS cells."""
    step = max(1, CELLS // max(1, width))
    return [slice(i, i + step) for i in range(0, n, step)]


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by a matrix product; the last digits are lost."""
    out = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return out if np.isfinite(out).all() else distances(a, b) ** 2


def same(ids: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ids and refs that are equal, in order of ids."""
    if ids.dtype == object or refs.dtype == object:
        met = [(x + part.start, y) for part in dealt(len(ids), len(refs)) for x, y in [np.nonzero(ids[part, None] == refs[None, :])]]
        return tuple(np.concatenate(v) for v in zip(*met, strict=True)) if met else (np.zeros(0, np.int64),) * 2
    order = np.argsort(refs, kind="stable")
    lo, hi = (np.searchsorted(refs, ids, side, sorter=order) for side in ("left", "right"))
    n = hi - lo
    at = np.repeat(np.arange(len(ids)), n)
    to = order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(at))]
    equal = ids[at] == refs[to]
    return at[equal], to[equal]


class Rough:
    """What squared distances of a to b are, less the row's own square, by one product of single floats; slack: what they can be wrong by, twice."""

    def __init__(self, a: np.ndarray, b: np.ndarray, size: float):
        self.a = np.column_stack([-2 * a, np.ones(len(a))]).astype(np.float32)
        self.b = np.ascontiguousarray(np.column_stack([b, (b * b).sum(axis=1)]).astype(np.float32).T)
        self.slack = np.float32(4 * (a.shape[1] + 4) * np.finfo(np.float32).eps * size)

    @staticmethod
    def holds(size: float) -> bool:
        """Whether single floats hold squares of this size, and the digits below them."""
        return 1e-20 < size < 1e30


def lowest(cost: np.ndarray, k: int, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of all finite cells that are among the k least of their row, or no more than ``slack`` above them."""
    if cost.shape[1] <= k:
        return np.nonzero(np.isfinite(cost))
    least = cost.min(axis=1) if k == 1 else np.partition(cost, k - 1, axis=1)[:, k - 1]
    x, y = np.divmod(np.flatnonzero(cost <= (least + slack)[:, None]), cost.shape[1])
    finite = np.isfinite(cost[x, y])
    return x[finite], y[finite]


def first_of_each(row: np.ndarray, dist: np.ndarray, ref: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest of each row, the smaller ref on ties."""
    order = np.lexsort((ref, dist, row))
    row = row[order]
    return order[np.arange(len(row)) - np.searchsorted(row, row) < k]


class Balls(NamedTuple):
    """Of each ball its class (as a number), pivot and radius."""

    of: np.ndarray
    pivot: np.ndarray
    radius: np.ndarray


def closest(a: np.ndarray, ids: np.ndarray, b: np.ndarray, refs: np.ndarray, own: np.ndarray, balls: Balls, pivots: np.ndarray, k: int, apart: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows, references and distances: for each row of a the k nearest of b of each class, and how many pairs were compared. own: the balls of b, ascending."""
    size = lambda x: float((x * x).sum(axis=1).max(initial=0.0))
    sizes = size(a) + size(b)
    slack = 16 * a.shape[1] * np.finfo(float).eps * sizes
    rough = None
    some, begin, n = np.unique(own, return_index=True, return_counts=True)
    columns = np.split(np.arange(len(own)), begin[1:])
    kind, of = np.unique(balls.of[some], return_inverse=True)
    ends = [*begin[np.flatnonzero(np.diff(of, prepend=-1))].tolist(), len(own)]
    use, back = np.unique(balls.pivot[some], return_inverse=True)
    out, told = [], 0

    def costs(rows: np.ndarray, columns_: np.ndarray | slice) -> np.ndarray:
        cost = squares(a[rows], b[columns_])
        if apart:
            cost[ids[rows][:, None] == refs[columns_][None, :]] = np.inf
        return cost

    for part in dealt(len(a), max(len(some), len(use) * a.shape[1] // 8)):
        rows = np.arange(len(a))[part]
        away = distances(a[rows], pivots[use])[:, back]
        # of each class the balls next to a row; each holds one at least, and one may be the row itself
        first = np.zeros(away.shape, bool)
        for c in range(len(kind)):
            mine = np.flatnonzero(of == c)
            few = min(k + bool(apart), len(mine))
            np.put_along_axis(first[:, mine[0] : mine[-1] + 1], np.argpartition(away[:, mine], few - 1, axis=1)[:, :few], True, axis=1)
        met = []
        for j in np.flatnonzero(first.any(axis=0)):
            r = np.flatnonzero(first[:, j])
            cost = costs(rows[r], columns[j])
            told += cost.size
            x, y = lowest(cost, k)
            met.append((r[x] * len(kind) + of[j], cost[x, y]))
        at, cost = (np.concatenate(v) for v in zip(*met, strict=True))
        order = np.lexsort((cost, at))
        at, cost = at[order], cost[order]
        last = np.arange(len(at)) - np.searchsorted(at, at) == k - 1
        bound = np.full(len(rows) * len(kind), np.inf)
        bound[at[last]] = np.sqrt(np.maximum(cost[last], 0) + slack)
        near = away - balls.radius[some] <= bound.reshape(len(rows), -1)[:, of] * (1 + SLACK) + SLACK
        dense = (near @ n).sum() > DENSE * len(rows) * len(b)
        if dense and rough is None and Rough.holds(sizes):
            rough = Rough(a, b, sizes)
            own_at, own_to = same(ids, refs) if apart else (np.zeros(0, np.int64),) * 2
        about = slack if rough is None or not dense else rough.slack
        for piece in dealt(len(rows), len(b)):
            r = rows[piece]
            if dense:
                if rough is None:
                    cost = costs(r, slice(None))
                else:
                    cost = rough.a[r] @ rough.b
                    one = slice(*np.searchsorted(own_at, [r[0], r[-1] + 1]))
                    cost[own_at[one] - r[0], own_to[one]] = np.inf
                told += cost.size
            else:
                cost = np.full((len(r), len(b)), np.inf)
                for j in np.flatnonzero(near[piece].any(axis=0)):
                    asks = np.flatnonzero(near[piece, j])
                    cost[asks, begin[j] : begin[j] + n[j]] = costs(r[asks], columns[j])
                    told += len(asks) * int(n[j])
            for lo, hi in zip(ends, ends[1:], strict=False):
                x, y = lowest(cost[:, lo:hi], k, about)
                y = y + lo
                dist = np.concatenate([np.sqrt(np.einsum("ij,ij->i", g, g)) for s in dealt(len(x), a.shape[1]) for g in [a[r[x[s]]] - b[y[s]]]] or [np.zeros(0)])
                best = first_of_each(x, dist, refs[y], k)
                out.append((r[x[best]], y[best], dist[best]))
    at, to, far = (np.concatenate(v) for v in zip(*out, strict=True))
    return at, to, far, told


def by_balls(rows: DataFrame, references: DataFrame, apart: bool, k: int, by_class: bool, schema: T.StructType, told=None) -> DataFrame:
    """Partial results that hold the k nearest references of every row, of each class if by_class. rows: id, value; references: ref, class, value."""
    spark = rows.sparkSession
    wide = WIDE * BLOCK
    known = cut(references.select("ref", F.col("class") if by_class else F.lit(0).alias("class"), "value"))
    classes = [r["class"] for r in known.select("class").distinct().limit(BALLS + 1).collect()]
    if len(classes) > BALLS:
        raise ValueError(f"more than {BALLS} classes")
    most = max(1, min(PIVOTS, BALLS // max(1, len(classes)), int(4 * (known.count() / max(1, len(classes))) ** 0.5)))
    some = np.array([list(r["value"]) for r in known.orderBy(F.xxhash64("ref"), "ref").limit(SAMPLE).select("value").collect()], float)
    if not len(some):
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(far_apart(some, most))

    def nearest_pivot(batches):
        for b in batches:
            x = matrix(b.column(b.schema.get_field_index("value")))
            d = [distances(x[part], held.value) for part in dealt(len(x), len(held.value))]
            pivot, off = (np.concatenate([f(v) for v in d] or [np.zeros(0)]) for f in (lambda v: v.argmin(axis=1), lambda v: v.min(axis=1)))
            yield b.append_column("pivot", pa.array(pivot, pa.int32())).append_column("off", pa.array(off, pa.float64()))

    placed = cut(known.mapInArrow(nearest_pivot, T.StructType([*known.schema.fields, T.StructField("pivot", T.IntegerType()), T.StructField("off", T.DoubleType())])))
    number = {c: i for i, c in enumerate(classes)}
    found = sorted(placed.groupBy("class", "pivot").agg(F.max("off").alias("radius"), F.count("*").alias("n")).collect(), key=lambda r: (number[r["class"]], r["pivot"]))
    # blocks in order of the balls; a ball that is more than a block has blocks of its own
    begin, count, at, room = [], [], -1, 0
    for r in found:
        if r["n"] > room:
            at, room = at + 1, wide
        begin.append(at)
        count.append(-(-r["n"] // wide))
        at, room = at + count[-1] - 1, room - r["n"] if count[-1] == 1 else 0
    balls = spark.sparkContext.broadcast(Balls(np.array([number[r["class"]] for r in found]), np.array([r["pivot"] for r in found]), np.array([r["radius"] for r in found])))
    table = spark.createDataFrame([(i, r["class"], r["pivot"], b, c) for i, (r, b, c) in enumerate(zip(found, begin, count, strict=True))], T.StructType([T.StructField("ball", T.IntegerType()), known.schema["class"], *[T.StructField(n, T.IntegerType()) for n in ("pivot", "begin", "count")]]))
    refs = placed.join(F.broadcast(table), ["class", "pivot"]).select("ref", "class", F.col("value").alias("target"), "ball", (F.col("begin") + F.pmod(F.xxhash64("ref"), F.col("count"))).cast("int").alias("j"))
    x, every = max(1, -(-rows.count() // wide)), lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = rows.select("id", "value", F.pmod(F.xxhash64("id"), F.lit(x)).cast("int").alias("i")).withColumn("j", every(at + 1))
    right = refs.withColumn("i", every(x))
    arrow = to_arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        right = right.sort_by([("ball", "ascending")])
        ids, refs = left["id"].to_numpy(), right["ref"].to_numpy()
        at, to, far, n = closest(matrix(left["value"]), ids, matrix(right["target"]), refs, right["ball"].to_numpy(), balls.value, held.value, k, apart)
        if told is not None:
            told.add(n)
        return pa.table({"id": ids[at], "class": right["class"].combine_chunks().take(pa.array(to)), "dist": far, "ref": refs[to]}, schema=arrow)

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, schema)


def nearest_of_class(rows: DataFrame, references: DataFrame, apart: bool = False, told=None) -> DataFrame:
    """id, class, dist, ref: the nearest reference of each class for every row, the smaller ref on ties. told: an accumulator for the number of distances between rows and references."""
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("class", references.schema["class"].dataType), T.StructField("dist", T.DoubleType()), T.StructField("ref", references.schema["ref"].dataType)])
    met = by_balls(rows, references, apart, 1, True, schema, told)
    return met.groupBy("id", "class").agg(F.min(F.struct("dist", "ref")).alias("m")).select("id", "class", "m.dist", "m.ref")


def nearest_few(rows: DataFrame, references: DataFrame, k: int, apart: bool = False, told=None) -> DataFrame:
    """id, ref, cost, place (1 to k): the k nearest references of every row, the smaller ref on ties; values are vectors or masks."""
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("class", T.IntegerType()), T.StructField("dist", T.DoubleType()), T.StructField("ref", references.schema["ref"].dataType)])
    place = F.row_number().over(Window.partitionBy("id").orderBy("cost", "ref"))
    vectors = isinstance(rows.schema["value"].dataType, T.ArrayType)
    met = by_balls(rows, references, apart, k, False, schema, told) if vectors else scan(rows, references, k, apart, schema, told)
    return met.select("id", "ref", F.col("dist").alias("cost")).withColumn("place", place.cast("long")).where(F.col("place") <= k)
