"""Order-dependent greedy operators. They work on one group at a time (a page or a measure, 10^2 to 10^4 rows), which is the
unit of distribution, or, along an axis, on the pieces of a group between gaps that nothing reaches over; every order ends in an id, which makes the result a function of the rows."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import iterate

BOX = ["left", "top", "right", "bottom"]
#: Rows of an Arrow batch that a task returns.
ROWS = 4096


def starts(b: pa.RecordBatch, keys: list) -> np.ndarray:
    """Where the groups of a batch begin; null keys are equal."""
    new = np.zeros(b.num_rows, bool)
    new[:1] = True
    for k in keys:
        codes = b.column(b.schema.get_field_index(k)).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*[p.columns for p in parts], strict=True)], schema=parts[0].schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list) -> Iterator[tuple[pa.RecordBatch, list[slice]]]:
    """Batches of rows that are sorted by their keys, cut anew so that each has whole groups, and where they lie. One group and one batch are held."""
    held: list[pa.RecordBatch] = []

    def told(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, list[slice]]:
        b = joined(parts)
        at = starts(b, keys).tolist()
        return b, [slice(i, j) for i, j in zip(at, [*at[1:], b.num_rows], strict=True)]

    for b in batches:
        if not b.num_rows:
            continue
        last = int(starts(b, keys)[-1])
        if last:
            yield told([*held, b.slice(0, last)])
            held = []
        elif held and len(starts(joined([held[0].slice(0, 1), b.slice(0, 1)]), keys)) > 1:
            yield told(held)
            held = []
        held.append(b.slice(last))
    if held:
        yield told(held)


def by_groups(df: DataFrame, keys: list, order: list) -> DataFrame:
    """df in sorted groups, each in one task, for whole_groups()."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *[F.asc_nulls_last(c) for c in order])


def numbers(column: pa.Array) -> np.ndarray:
    """A column as it is, if it has whole numbers without nulls, else as floats, null as nan."""
    x = column.to_numpy(zero_copy_only=False)
    return x if x.dtype.kind in "iu" else x.astype(float)


def per_group(df: DataFrame, keys: list, order: list, name: str, kind: T.DataType, fn, needs: list) -> DataFrame:
    """df with column ``name`` that fn makes from the columns ``needs`` (arrays of numbers) of each group, sorted by ``order``. A task goes through its sorted groups, many in a batch."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, groups in whole_groups(batches, keys):
            columns = [numbers(b.column(b.schema.get_field_index(c))) for c in needs]
            made = pa.concat_arrays([pa.array(fn(*[c[g] for c in columns]), arrow.field(name).type) for g in groups])
            yield pa.RecordBatch.from_arrays([*b.columns, made], schema=arrow)

    return by_groups(df, keys, order).mapInArrow(run, schema)


def between_gaps(df: DataFrame, keys: list, order: list, value: str, gap: float, name: str, fn) -> DataFrame:
    """per_group() of fn, whose numbers from 0 on count what it finds in ascending order of ``value`` (first in the order) and which joins no rows across more than ``gap``: each
    group is cut there, and the numbers of the pieces before are added. Gaps show between bins as wide as they are, so only the ends of bins meet in a window. Null values are a piece of their own, after the others."""
    bin_ = F.coalesce(F.floor(F.col(value) / gap), F.lit((1 << 63) - 1)).cast("long")
    binned = df.withColumn("__bin", bin_)
    along = Window.partitionBy(*keys)
    bins = binned.groupBy(*keys, "__bin").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    apart = F.coalesce(F.col("lo") - F.lag("hi").over(along.orderBy("__bin")) > gap, F.col("lo").isNull())
    bins = bins.withColumn("__cut", apart.cast("long")).withColumn("__piece", F.sum("__cut").over(along.orderBy("__bin"))).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__bin").alias("__of"), "__piece")
    on = F.col("__bin") == F.col("__of")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    cut_ = iterate.cut(per_group(binned.join(bins, on).select(*df.columns, "__piece"), [*keys, "__piece"], order, name, T.LongType(), fn, [value]))
    found = cut_.groupBy(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__piece").alias("__of")).agg((F.max(name) + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*[f"__{k}" for k in keys]).orderBy("__of").rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("__before", F.coalesce(before, F.lit(0))).drop("n")
    on = F.col("__piece") == F.col("__of")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return cut_.join(found, on).withColumn(name, F.col(name) + F.col("__before")).select(*df.columns, name)


def running_mean_clusters(df: DataFrame, keys: list, value: str, tolerance: float, id_: str, name: str = "cluster") -> DataFrame:
    """In ascending order a value joins the open cluster if it lies within the tolerance of its running mean. A mean is no more than the last value, so a gap above
    the tolerance always parts clusters."""

    def fn(values: np.ndarray) -> np.ndarray:
        out, total, n, k = [], 0.0, 0, -1
        for v in values.tolist():
            if n == 0 or v - total / n > tolerance:
                total, n, k = 0.0, 0, k + 1
            total, n = total + v, n + 1
            out.append(k)
        return np.array(out)

    return between_gaps(df, keys, [value, id_], value, tolerance, name, fn)


def anchor_groups(df: DataFrame, keys: list, id_: str, name: str = "anchor") -> DataFrame:
    """Largest rectangle first: it takes all free ones that overlap it, it alone, not what overlaps those."""

    def fn(ids: np.ndarray, *box: np.ndarray) -> np.ndarray:
        left, top, right, bottom = (c.astype(float) for c in box)
        area = (right - left).clip(0) * (bottom - top).clip(0)
        out = np.full(len(ids), -1, np.int64)
        free = np.ones(len(ids), bool)
        for i in np.lexsort((np.arange(len(ids)), -area)).tolist():
            if free[i]:
                w = np.minimum(right, right[i]) - np.maximum(left, left[i])
                h = np.minimum(bottom, bottom[i]) - np.maximum(top, top[i])
                took = free & (w > 1e-6) & (h > 1e-6)
                took[i] = True
                out[took], free[took] = ids[i], False
        return out

    return per_group(df, keys, [id_], name, T.LongType(), fn, [id_, *BOX])


def suppress(df: DataFrame, keys: list, score: str, id_: str, share: float, name: str = "kept") -> DataFrame:
    """Non-maximum suppression: best score first, a rectangle goes if it overlaps a kept one by ``share`` of the smaller area."""

    def fn(scores: np.ndarray, *box: np.ndarray) -> np.ndarray:
        order = np.lexsort((np.arange(len(scores)), -scores.astype(float)))
        left, top, right, bottom = (c[order].astype(float) for c in box)
        area = (right - left).clip(0) * (bottom - top).clip(0)
        kept = np.ones(len(order), bool)
        for i in range(len(order)):
            if kept[i]:  # takes those after it
                after = slice(i + 1, None)
                w = np.minimum(right[after], right[i]) - np.maximum(left[after], left[i])
                h = np.minimum(bottom[after], bottom[i]) - np.maximum(top[after], top[i])
                kept[after] &= ~(w.clip(0) * h.clip(0) >= share * np.minimum(area[after], area[i]).clip(1e-12))
        out = np.empty(len(order), bool)
        out[order] = kept
        return out

    return per_group(df, keys, [id_], name, T.BooleanType(), fn, [score, *BOX])


def complete_link(df: DataFrame, keys: list, order: list, value: str, most: float, name: str = "link") -> DataFrame:
    """In order, a free row opens a group and takes every later free row within ``most`` of all its members. No group reaches over a gap above ``most``."""

    def fn(values: np.ndarray) -> np.ndarray:
        v, out, k = values.astype(float), np.full(len(values), -1, np.int64), 0
        rising = bool((np.diff(v) >= 0).all())
        i = 0
        while i < len(v):
            if out[i] < 0 and rising:  # a group is a run
                end = int(np.searchsorted(v, v[i] + most, "right"))
                while end > i + 1 and v[end - 1] - v[i] > most:
                    end -= 1
                while end < len(v) and v[end] - v[i] <= most:
                    end += 1
                out[i : max(end, i + 1)], k, i = k, k + 1, max(end, i + 1) - 1
            elif out[i] < 0:
                low = high = v[i]
                out[i] = k
                for j in range(i + 1, len(v)):
                    if out[j] < 0 and max(high, v[j]) - min(low, v[j]) <= most:
                        out[j], low, high = k, min(low, v[j]), max(high, v[j])
                k += 1
            i += 1
        return out

    if order[0] == value:
        return between_gaps(df, keys, order, value, most, name, fn)
    return per_group(df, keys, order, name, T.LongType(), fn, [value])


def colour_intervals(df: DataFrame, keys: list, start: str, end: str, id_: str, name: str = "lane") -> DataFrame:
    """Lanes for intervals: by start, each goes to the lowest lane that is free by then. As many lanes as overlap at most."""
    import heapq

    def fn(begin: np.ndarray, until: np.ndarray) -> np.ndarray:
        busy: list[tuple[float, int]] = []
        free: list[int] = []
        out, lanes = [], 0
        for s, e in zip(begin.astype(float).tolist(), until.astype(float).tolist(), strict=True):
            while busy and busy[0][0] <= s:
                heapq.heappush(free, heapq.heappop(busy)[1])
            if free:
                lane = heapq.heappop(free)
            else:
                lane, lanes = lanes, lanes + 1
            heapq.heappush(busy, (e, lane))
            out.append(lane)
        return np.array(out, np.int64)

    return per_group(df, keys, [start, end, id_], name, T.LongType(), fn, [start, end])


def lane_windows(df: DataFrame, keys: list, value: str, size: int, spread: float, id_: str, name: str = "window") -> DataFrame:
    """Left to right, a run of ``size`` values whose gaps all lie within ``spread`` of their mean is a window; the scan goes on after it.
    Rows outside of windows have null."""

    def fn(values: np.ndarray) -> list:
        v, out, i, k = values.astype(float), [None] * len(values), 0, 0
        while i + size <= len(v):
            gaps = np.diff(v[i : i + size])
            mean = gaps.mean()
            if mean > 0 and (np.abs(gaps - mean) <= spread * mean).all():
                out[i : i + size] = [k] * size
                i, k = i + size, k + 1
            else:
                i += 1
        return out

    return per_group(df, keys, [value, id_], name, T.LongType(), fn, [value])


def rest_lanes(rests: DataFrame, keys: list, id_: str) -> DataFrame:
    """Each rest, by x, to the lane that it fills exactly, else without overshoot, else with least left over, else nearest x.
    rests: duration, x, capacity and a list of lanes (lane, total, x); totals change as rests are added."""
    schema = T.StructType([*[f for f in rests.schema.fields if f.name in keys], rests.schema[id_], T.StructField("lane", T.LongType())])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["x", id_], kind="stable")
        lanes = {int(r["lane"]): [float(r["total"]), float(r["x"])] for r in g.iloc[0]["lanes"]}
        out = []
        for r in g.itertuples():
            def rank(k, r=r):
                left = r.capacity - lanes[k][0] - r.duration
                return (left != 0, left < 0, abs(left), abs(lanes[k][1] - r.x), k)

            best = min(lanes, key=rank)
            lanes[best][0] += r.duration
            out.append(best)
        return g[[f.name for f in schema.fields[:-1]]].assign(lane=out)

    return rests.groupBy(*keys).applyInPandas(run, schema)


def match_by_tolerance(expected: DataFrame, actual: DataFrame, keys: list, value: str, id_: str, tolerance: float, penalty: str | None = None) -> DataFrame:
    """Each expected row, in order of (value, id), takes the free actual row of least distance (plus 0.1 for another ``penalty``
    value) within the tolerance. keys, expected id, actual id; an id is null on the side that is missing. A task goes through its sorted groups, of which it holds one; a row
    looks at those within the tolerance alone."""
    kind = expected.schema[id_].dataType
    schema = T.StructType([*[expected.schema[k] for k in keys], T.StructField("expected", kind), T.StructField("actual", kind), T.StructField("distance", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def matched(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        e, a = ([r for r in rows if r[0] == side] for side in (0, 1))
        known = [r for r in a if r[1] is not None and r[1] == r[1]]
        values, free = [r[1] for r in known], [True] * len(known)
        for _, v, i, p in e:
            best = None
            if v is not None and v == v:
                reach = tolerance + 1e-9 * (tolerance + abs(v))
                for j in range(bisect_left(values, v - reach), bisect_right(values, v + reach)):
                    d = abs(values[j] - v)
                    if free[j] and d <= tolerance:
                        cost = d + (0.1 * (known[j][3] != p) if penalty else 0)
                        if best is None or cost < best[0]:
                            best = (cost, j, d)
            if best:
                free[best[1]] = False
            yield (*key, i, known[best[1]][2] if best else None, best[2] if best else None)
        taken = {id(r) for r, f in zip(known, free, strict=True) if not f}
        yield from ((*key, None, r[2], None) for r in a if id(r) not in taken)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
        out: list[tuple] = []
        rows = ((r[: len(keys)], r[len(keys) :]) for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        for key, group in groupby(rows, lambda r: r[0]):
            out += matched(key, [r for _, r in group])
            if len(out) >= ROWS:
                yield as_batch(out)
                out = []
        if out:
            yield as_batch(out)

    side = lambda df, n: df.select(*keys, F.lit(n).alias("__side"), F.col(value).cast("double").alias("__value"), F.col(id_).alias("__id"), (F.col(penalty) if penalty else F.lit(None).cast("int")).alias("__penalty"))
    both = side(expected, 0).unionByName(side(actual, 1))
    return both.repartition(*keys).sortWithinPartitions(*keys, "__side", "__value", "__id").mapInArrow(run, schema)
