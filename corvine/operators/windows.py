"""Order-dependent operators as window functions. ``keys`` partition, ``order`` is a total order within a key (end it in an id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST, LAST, HERE = Window.unboundedPreceding, Window.unboundedFollowing, Window.currentRow


def within(keys: list, order: list, start=None, end=None):
    w = Window.partitionBy(*keys).orderBy(*order)
    return w if start is None else w.rowsBetween(start, end)


def carry_forward(df: DataFrame, keys: list, order: list, value: Column | str, name: str) -> DataFrame:
    """The last value that is not null at or before each row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(within(keys, order, FIRST, HERE)))


def change_points(df: DataFrame, keys: list, order: list, value: str) -> DataFrame:
    """Rows whose value differs from the one before (null-safe); the first of a key stays."""
    w = within(keys, order)
    marked = df.withColumns({"__was": F.lag(value).over(w), "__n": F.row_number().over(w)})
    return marked.where((F.col("__n") == 1) | ~F.col(value).eqNullSafe(F.col("__was"))).drop("__was", "__n")


def merge_islands(df: DataFrame, keys: list, start: str, end: str, join: Column | float, island: str = "island") -> DataFrame:
    """Number the islands of intervals that touch or come within ``join`` of what came before."""
    order = [start, end]
    reach = F.max(end).over(within(keys, order, FIRST, -1))
    opens = F.when(reach.isNull() | (F.col(start) - reach > join), 1).otherwise(0)
    return df.withColumn("__opens", opens).withColumn(island, F.sum("__opens").over(within(keys, order, FIRST, HERE))).drop("__opens")


def cursor(df: DataFrame, keys: list, voice: list, order: list, step: Column, shares: Column, name: str) -> DataFrame:
    """Onset of each row: the sum of the signed steps before it; a row that shares takes the onset of the
    last row of its voice that does not, and adds no step."""
    moved = df.withColumn("__step", F.when(shares, F.lit(0)).otherwise(step))
    moved = moved.withColumn("__at", F.coalesce(F.sum("__step").over(within(keys, order, FIRST, -1)), F.lit(0)))
    own = F.last(F.when(~shares, F.col("__at")), ignorenulls=True).over(within(voice, order, FIRST, HERE))
    return moved.withColumn(name, F.when(shares, own).otherwise(F.col("__at"))).drop("__step", "__at")


def pair_rows(df: DataFrame, keys: list, order: list, name: str) -> DataFrame:
    """Number consecutive pairs (1, 2), (3, 4), ...; a last row without partner is dropped."""
    n = F.row_number().over(within(keys, order))
    paired = df.withColumn(name, F.floor((n - 1) / 2).cast("long"))
    return paired.withColumn("__n", F.count("*").over(Window.partitionBy(*keys, name))).where("__n = 2").drop("__n")


def place_in_group(df: DataFrame, keys: list, order: list, name: str) -> DataFrame:
    """begin, continue or end by rank; a group of one begins."""
    n, of = F.row_number().over(within(keys, order)), F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn(name, F.when(n == 1, "begin").when(n == of, "end").otherwise("continue"))


def number_runs(df: DataFrame, keys: list, order: list, begins: Column, name: str) -> DataFrame:
    """Number the runs that rows with ``begins`` open; rows before the first have 0."""
    return df.withColumn(name, F.sum(F.when(begins, 1).otherwise(0)).over(within(keys, order, FIRST, HERE)))


def interpolate(df: DataFrame, keys: list, order: list, x: str, anchor: str, name: str) -> DataFrame:
    """Linear between the nearest rows with an anchor value on both sides; the nearer one's value outside."""
    at = F.when(F.col(anchor).isNotNull(), F.struct(F.col(x).alias("x"), F.col(anchor).alias("y")))
    before = F.last(at, ignorenulls=True).over(within(keys, order, FIRST, HERE))
    after = F.first(at, ignorenulls=True).over(within(keys, order, HERE, LAST))
    df = df.withColumns({"__b": before, "__a": after})
    b, a, here = F.col("__b"), F.col("__a"), F.col(x)
    line = b["y"] + (a["y"] - b["y"]) * (here - b["x"]) / (a["x"] - b["x"])
    value = F.when(b.isNull(), a["y"]).when(a.isNull() | (a["x"] == b["x"]), b["y"]).otherwise(line)
    return df.withColumn(name, value).drop("__b", "__a")


def longest_run(df: DataFrame, keys: list, order: list, test: Column, name: str) -> DataFrame:
    """Length of the longest run of rows that pass, one row per key; 0 if none does."""
    marked = df.withColumns({"__ok": F.coalesce(test, F.lit(False)), "__n": F.row_number().over(within(keys, order))})
    marked = marked.withColumn("__run", F.when(F.col("__ok"), F.col("__n") - F.row_number().over(Window.partitionBy(*keys, "__ok").orderBy(*order))))
    runs = marked.groupBy(*keys, "__run").agg(F.count_if("__ok").alias("__len"))
    return runs.groupBy(*keys).agg(F.max("__len").alias(name))


def direction_changes(df: DataFrame, keys: list, order: list, value: str, dead_band: float, name: str) -> DataFrame:
    """Sign changes of the slope after smoothing over three rows, steps within the dead band left out."""
    smooth = F.avg(value).over(within(keys, order, -1, 1))
    df = df.withColumn("__s", smooth).withColumn("__d", F.col("__s") - F.lag("__s").over(within(keys, order)))
    df = df.withColumn("__g", F.when(F.abs("__d") > dead_band, F.signum("__d")))
    df = df.withColumn("__p", F.last("__g", ignorenulls=True).over(within(keys, order, FIRST, -1)))
    return df.groupBy(*keys).agg(F.count_if(F.col("__g") != F.col("__p")).alias(name))


def prefix_all(df: DataFrame, keys: list, order: list, test: Column) -> DataFrame:
    """Rows up to, not including, the first that fails."""
    return df.withColumn("__ok", F.min(F.when(test, 1).otherwise(0)).over(within(keys, order, FIRST, HERE))).where("__ok = 1").drop("__ok")


def keep_spaced(df: DataFrame, keys: list, value: str, least: float, name: str) -> DataFrame:
    """Per key the sorted values, each kept if it is at least ``least`` above the last one kept: a fold over the sorted
    array, as the comparison is with a kept value and no window sees those."""
    kept = F.aggregate(F.array_sort(F.collect_list(value)), F.array().cast("array<double>"), lambda a, v: F.when((F.size(a) == 0) | (v - F.element_at(a, -1) >= least), F.concat(a, F.array(v.cast("double")))).otherwise(a))
    return df.groupBy(*keys).agg(kept.alias(name))
