"""Aggregations with the reference semantics as reusable columns and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box_union(left="left", top="top", right="right", bottom="bottom", nullable: bool = False) -> list[Column]:
    """Bounding box of a group; with ``nullable`` an edge is null as soon as one member's is."""

    def edge(fn, c):
        return (F.when(F.count(c) == F.count("*"), fn(c)) if nullable else fn(c)).alias(c)

    return [edge(F.min, left), edge(F.min, top), edge(F.max, right), edge(F.max, bottom)]


def median(x: Column, default: float | None = None) -> Column:
    """The middle value, of an even count the mean of two."""
    m = F.percentile(x, 0.5)
    return m if default is None else F.coalesce(m, F.lit(default))


#: Accuracy of the quantiles that close in on a median, and rows among which it is looked up.
ACCURACY, FEW_VALUES = 10_000, 1 << 16


def table_median(df: DataFrame, column: str, few: int = FEW_VALUES) -> float | None:
    """median() of a column over a whole table, exact, without a task that holds all its values: approximate quantiles on both sides of the middle close in on it, and what lies below, on and
    between them is counted. The middle is one of these two, or each pass leaves the rows strictly between them, until few are left."""
    x = F.col("x")
    rows = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    left = rows.count()
    if not left:
        return None
    at, found = [(left - 1) // 2, left // 2], [None, None]
    while left > few and None in found:
        slack = 2 / ACCURACY
        while True:
            low, high = rows.agg(F.percentile_approx("x", [max(0.0, at[0] / left - slack), min(1.0, (at[1] + 1) / left + slack)], ACCURACY)).first()[0]
            inner = (x > low) & (x < high)
            under, on_low, between, upto = rows.agg(*[F.count(F.when(c, 1)) for c in (x < low, x == low, inner, x <= high)]).first()
            if under <= at[0] and at[1] < upto:
                break
            slack *= 4
        rows, left, at = rows.where(inner), between, [r - under - on_low for r in at]
        found = [low if r < 0 else high if r >= between else None for r in at]
        if found[0] is None and found[1] is not None:  # the last before the upper end
            found[0] = rows.agg(F.max("x")).first()[0]
        elif found[1] is None and found[0] is not None:
            found[1] = rows.agg(F.min("x")).first()[0]
    if None in found:
        values = sorted((r["x"] for r in rows.collect()), key=lambda v: (v != v, v))
        found = [values[r] for r in at]
    return found[0] if found[0] == found[1] else 0.5 * found[0] + 0.5 * found[1]


def low_third_middle(x: Column) -> Column:
    """Middle of the lowest third of the sorted values."""
    s = F.array_sort(F.collect_list(x))
    return F.element_at(s, (F.floor(F.greatest(F.lit(1), F.floor(F.size(s) / 3)) / 2) + 1).cast("int"))


def floor_percentile(x: Column, p: float) -> Column:
    """The value at the floored index, without interpolation."""
    s = F.array_sort(F.collect_list(x))
    return F.element_at(s, (F.floor((F.size(s) - 1) * F.lit(p)) + 1).cast("int"))


def mode_smallest(x: Column) -> Column:
    """The most frequent value, the smallest of several."""
    return F.call_function("mode", x, F.lit(True))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid, as a fold of bounded length."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] != 0, s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


def gcd_of(values: Column) -> Column:
    """Of an array of integers; 0 for an empty one."""
    return F.aggregate(values, F.lit(0).cast("long"), gcd)


def precision_recall(matched: Column, mismatched: Column, missing: Column, extra: Column) -> list[Column]:
    """precision, recall and f1; 0 where a denominator is. What is recognized is matched or mismatched."""
    found, expected = matched + mismatched + extra, matched + mismatched + missing
    p = F.when(found > 0, matched / found).otherwise(0.0)
    r = F.when(expected > 0, matched / expected).otherwise(0.0)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def first_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
