"""Joins beyond equality. Each has an equi part, so rows spread by key; bands become one by binning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo


def band_semi(left: DataFrame, right: DataFrame, a: str, b: str, tolerance: float, keys: list = ()) -> DataFrame:
    """Rows of left with a row of right within ``tolerance``. Right keeps one row per bin value, sent to three bins;
    the shuffle is on (keys, bin), never a loop over all pairs."""
    bins = right.select(*keys, F.col(b).alias("__b")).where("__b is not null").distinct()
    bins = bins.withColumn("__bin", F.explode(F.array(*[F.floor(F.col("__b") / tolerance) + k for k in (-1, 0, 1)])))
    binned = left.withColumn("__bin", F.floor(F.col(a) / tolerance))
    on = [F.col("l.__bin") == F.col("r.__bin"), F.abs(F.col(f"l.{a}") - F.col("r.__b")) <= tolerance, *[F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]]
    return binned.alias("l").join(bins.alias("r"), on, "left_semi").drop("__bin")


#: Sizes from one level to the next.
LEVEL = 1.25


def claimed_anti(candidates: DataFrame, claimed: DataFrame, keys: list, share: float = 0.05) -> DataFrame:
    """Candidates that no claimed rectangle of the same key covers with all four edges within a share (0.09 at most) of its size. What it covers is
    nearly of its size, so both meet by levels of size and, on a grid of that size, by the place of the corner: claimed rectangles go to the few cells that may be
    asked for, candidates stay as they are."""
    rect = list(geo.Rect._fields)
    c = claimed.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(x).alias(f"__{x}") for x in rect])

    def level(low: str, high: str) -> Column:
        size = F.col(high) - F.col(low)
        return F.when(size > 0, F.floor(F.log(size) / F.log(F.lit(LEVEL)))).otherwise(-(1 << 20)).cast("int")

    step = lambda at: F.when(at > -(1 << 20), F.pow(F.lit(LEVEL), at + 1)).otherwise(1.0)
    on = geo.same_region(geo.Rect.of(), geo.Rect.of("__"), share)
    for low, high, name in (("left", "right", "x"), ("top", "bottom", "y")):
        own = level(f"__{low}", f"__{high}")
        c = c.withColumn(f"__{name}", F.explode(F.when(own > -(1 << 20), F.array(own - 1, own)).otherwise(F.array(own))))
        edge, most = F.col(f"__{low}"), F.col(f"__{low}") + (share + 1e-6) * (F.col(f"__{high}") - F.col(f"__{low}"))
        c = c.withColumn(f"__{name}_cell", F.explode(F.sequence(F.floor(edge / step(F.col(f"__{name}"))), F.floor(most / step(F.col(f"__{name}"))))))
        on = on & (level(low, high) == F.col(f"__{name}")) & (F.floor(F.col(low) / step(level(low, high))) == F.col(f"__{name}_cell"))
    for k in keys:
        on = (F.col(k) == F.col(f"__{k}")) & on
    return candidates.join(c, on, "left_anti")


def nearest(left: DataFrame, right: DataFrame, keys: list, left_id: str, cost: Column, ties: list, k: int = 1, within: Column | None = None, how: str = "inner") -> DataFrame:
    """The k right rows of least cost per left row among those of equal keys, as column ``place`` from 1 on."""
    pairs = left.join(right, keys, how).withColumn("cost", cost)
    if within is not None:
        pairs = pairs.where(within)
    place = F.row_number().over(Window.partitionBy(left_id).orderBy(F.col("cost").asc_nulls_last(), *ties))
    return pairs.withColumn("place", place).where(F.col("place") <= k)


#: Cuts of the values, so that one key's rows are sorted in several tasks.
CUTS = 32


def nearest_value(left: DataFrame, right: DataFrame, keys: list, a: str, b: str, left_id: str, right_id: str) -> DataFrame:
    """left with ``match`` and ``gap``: the right row of nearest value per key, the smaller id on ties. Both sides are sorted
    together once; the neighbours below and above are carried to each left row, so no pairs are formed. Each key is cut at quantiles of the
    values, which are the same for all keys; the edges of the pieces (one row each) are carried over empty ones."""
    cuts = sorted(set(right.agg(F.percentile_approx(b, [i / CUTS for i in range(1, CUTS)], 1000).alias("q")).first()["q"] or []))
    piece = F.lit(0)
    for c in cuts:
        piece = piece + F.when(F.col("__v") >= F.lit(c), 1).otherwise(0)
    l = left.select(*keys, F.col(a).alias("__v"), F.col(left_id).alias("__l"), F.lit(None).cast(right.schema[right_id].dataType).alias("__r"))  # noqa: E741
    r = right.groupBy(*keys, F.col(b).alias("__v")).agg(F.min(right_id).alias("__r")).withColumn("__l", F.lit(None).cast(left.schema[left_id].dataType))
    both = l.unionByName(r).withColumn("__piece", F.coalesce(piece, F.lit(0)))
    at = F.when(F.col("__r").isNotNull(), F.struct("__v", "__r"))
    edges = both.groupBy(*keys, "__piece").agg(F.min(at).alias("__first"), F.max(F.when(F.col("__r").isNotNull(), F.struct("__v", "__r"))).alias("__last"))
    order = Window.partitionBy(*keys).orderBy("__piece")
    edges = edges.withColumns({"__before": F.last("__last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), "__after": F.first("__first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))}).drop("__first", "__last")
    below = F.last(at, ignorenulls=True).over(Window.partitionBy(*keys, "__piece").orderBy("__v", F.col("__r").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    above = F.first(at, ignorenulls=True).over(Window.partitionBy(*keys, "__piece").orderBy("__v", F.col("__r").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing))
    e = edges.withColumnsRenamed({k: f"__{k}" for k in [*keys, "__piece"]})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in [*keys, "__piece"]]
    placed = both.withColumns({"__below": below, "__above": above}).where("__l is not null").join(e, on)
    gap = lambda c, d: F.struct(F.abs(F.col("__v") - F.coalesce(c, d)["__v"]).alias("gap"), F.coalesce(c, d)["__r"].alias("match"))
    best = F.array_min(F.filter(F.array(gap("__below", "__before"), gap("__above", "__after")), lambda x: x["match"].isNotNull() & x["gap"].isNotNull()))
    return placed.select(*keys, F.col("__l").alias(left_id), best["match"].alias("match"), best["gap"].alias("gap"))


def asof(left: DataFrame, right: DataFrame, keys: list, order: list, value: Column, name: str) -> DataFrame:
    """left with ``name``: value of the last right row at or before it (right first on equal order). One sort of both sides."""
    r = right.select(*keys, *order, value.alias("__v")).withColumn("__side", F.lit(0))
    l = left.withColumns({"__side": F.lit(1), "__v": F.lit(None).cast(r.schema["__v"].dataType)})  # noqa: E741
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(order[0], "__side", *order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last("__v", ignorenulls=True).over(w)).where("__side = 1").drop("__side", "__v")


def rank_match(left: DataFrame, right: DataFrame, keys: list, left_order: list, right_order: list) -> DataFrame:
    """Multiset full outer join: the n-th of a key on the left meets the n-th on the right. Columns of left get l_, of right r_."""

    def ranked(df: DataFrame, order: list, mark: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.select(*keys, n.alias("n"), *[F.col(c).alias(f"{mark}_{c}") for c in df.columns if c not in keys], F.lit(True).alias(f"in_{mark}"))

    return full_outer(ranked(left, left_order, "l"), ranked(right, right_order, "r"), [*keys, "n"], "in_l")


def full_outer(left: DataFrame, right: DataFrame, keys: list, mark: str) -> DataFrame:
    """Full outer join in which null keys meet; mark is a column of left that is never null."""
    r = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    both = left.join(r, on, "full_outer")
    return both.withColumns({k: F.when(F.col(mark).isNotNull(), F.col(k)).otherwise(F.col(f"__{k}")) for k in keys}).drop(*[f"__{k}" for k in keys])


def interval_join(left: DataFrame, right: DataFrame, keys: list, a: tuple[str, str], b: tuple[str, str], width: float) -> DataFrame:
    """Pairs of closed intervals that meet, per key. Both sides go to the bins of ``width`` that they touch; a pair
    is told in the one bin where the later of the two starts, so none comes twice."""

    def binned(df: DataFrame, x: tuple[str, str], mark: str) -> DataFrame:
        df = df.select(*[F.col(k) for k in keys], *[F.col(c).alias(f"{mark}_{c}") for c in df.columns if c not in keys])
        return df.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(f"{mark}_{x[0]}") / width), F.floor(F.col(f"{mark}_{x[1]}") / width))))

    met = binned(left, a, "l").join(binned(right, b, "r"), [*keys, "__bin"])
    meets = (F.col(f"l_{a[0]}") <= F.col(f"r_{b[1]}")) & (F.col(f"r_{b[0]}") <= F.col(f"l_{a[1]}"))
    return met.where(meets & (F.floor(F.greatest(f"l_{a[0]}", f"r_{b[0]}") / width) == F.col("__bin"))).drop("__bin")
