"""Neighbours along an axis and in the plane without pairs of a group.

One sort of both sides by ranges puts every row at its rank in its key; what a row needs then lies at a few ranks, or in a few aligned runs of ranks, and meets it
by an equi-join on them. So a key may hold any part of the rows: it is cut where the ranges are. Rectangles meet in cells that follow their density.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as geo
from .iterate import cut


def counted(rows: DataFrame, keys: list[str], order: list, flag: str, name: str) -> DataFrame:
    """rows with ``name``: how many rows of the key with a true ``flag`` stand at or before each in the order (which should end in an id). Rows are
    sorted by ranges of (key, order), counted within them, and the counts of the ranges before are added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = None, 0
        for b in batches:
            at = list(zip(*[b.column(b.schema.get_field_index(k)).to_pylist() for k in keys], strict=True))
            seen = []
            for key, f in zip(at, b.column(b.schema.get_field_index(flag)).to_pylist(), strict=True):
                if key != held:
                    held, n = key, 0
                n += bool(f)
                seen.append(n)
            yield b.append_column(name, pa.array(seen, pa.int64()))

    ranged = rows.orderBy(*keys, *order).withColumn("__range", F.spark_partition_id())
    ranged = cut(ranged.mapInArrow(run, T.StructType([*ranged.schema.fields, T.StructField(name, T.LongType())])))
    sizes = ranged.groupBy(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__in")).agg(F.max(name).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*[f"__{k}" for k in keys]).orderBy("__in").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("__before", F.coalesce(before, F.lit(0)))
    on = F.col("__range") == F.col("__in")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return ranged.join(sizes, on).withColumn(name, F.col(name) + F.col("__before")).select(*rows.columns, name)


def nearest_k(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, left_id: str, right_id: str, k: int = 1) -> DataFrame:
    """keys, left_id, match, gap, place: the k rows of right (fewer where there are fewer) with the nearest values ``b`` for each row of left (its value ``a``), smaller ids first on
    equal gaps. Null values and null keys match nothing. The k nearest lie among the k ranks below and the k above."""
    r = right.select(*keys, F.col(b).cast("double").alias("__v"), F.col(right_id).alias("__r")).dropna()
    # of equal values only the k smallest ids can be told
    r = r.withColumn("__copy", F.row_number().over(Window.partitionBy(*keys, "__v").orderBy("__r"))).where(F.col("__copy") <= k)
    l = left.select(*keys, F.col(a).cast("double").alias("__v"), F.col(left_id).alias("__l")).dropna()  # noqa: E741
    both = r.select(*keys, "__v", "__r", "__copy", F.lit(None).cast(l.schema["__l"].dataType).alias("__l")).unionByName(l, allowMissingColumns=True)
    both = both.withColumns({"__right": F.col("__l").isNull(), "__side": F.when(F.col("__l").isNull(), 0).otherwise(1)})
    placed = counted(both, keys, ["__v", "__side", "__copy", "__r", "__l"], "__right", "__rank")
    own = placed.where("__right")
    # going down, equal values are met from the smallest id on as well
    copies = own.groupBy(*keys, "__v").agg(F.max("__rank").alias("__most"))
    down = own.join(copies, [*keys, "__v"]).withColumn("__rank", F.col("__most") - F.col("__copy") + 1).drop("__most")
    told = own.withColumn("__up", F.lit(True)).unionByName(down.withColumn("__up", F.lit(False))).select(*keys, "__up", "__rank", F.col("__v").alias("__w"), F.col("__r").alias("match"))
    seen = placed.where("not __right").select(*keys, "__l", "__v", F.explode(F.expr(f"sequence(__rank - {k - 1}, __rank + {k})")).alias("__at"), F.col("__rank").alias("__here"))
    seen = seen.withColumn("__up", F.col("__at") > F.col("__here")).withColumnRenamed("__at", "__rank")
    met = seen.join(told, [*keys, "__up", "__rank"]).withColumn("gap", F.abs(F.col("__v") - F.col("__w")))
    place = F.row_number().over(Window.partitionBy(*keys, "__l").orderBy("gap", "match"))
    return met.withColumn("place", place).where(F.col("place") <= k).select(*keys, F.col("__l").alias(left_id), "match", "gap", "place")


def with_margin(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, left_id: str, right_id: str, margin: float, most: float | None = None) -> DataFrame:
    """left_id and match of every row of left that has a row of right in its key: the nearest one, null if the runner-up comes within ``margin`` of it or it is beyond ``most``."""
    at = lambda n, c: F.max(F.when(F.col("place") == n, F.col(c)))
    two = nearest_k(left, right, keys, a, b, left_id, right_id, 2).groupBy(*keys, left_id).agg(at(1, "match").alias("id"), at(1, "gap").alias("first"), at(2, "gap").alias("second"))
    good = F.col("second").isNull() | (F.col("second") - F.col("first") >= margin)
    if most is not None:
        good = good & (F.col("first") <= most)
    return two.select(left_id, F.when(good, F.col("id")).alias("match"))


def band_min(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, left_id: str, right_id: str, reach: float) -> DataFrame:
    """keys, left_id, match: the smallest id of right within ``reach`` of each value of left, where there is one. The ranks of a band are a few aligned
    runs of 1, 2, 4, ... ranks, whose minima are made once for all, so that no row of right meets a row of left by itself."""
    r = right.select(*keys, F.col(b).cast("double").alias("__v"), F.col(right_id).alias("__r")).dropna()
    l = left.select(*keys, F.col(a).cast("double").alias("__v"), F.col(left_id).alias("__l")).dropna()  # noqa: E741
    ends = l.select(*keys, "__l", F.explode(F.array(F.struct((F.col("__v") - reach).alias("__v"), F.lit(0).alias("__side")), F.struct((F.col("__v") + reach).alias("__v"), F.lit(2).alias("__side")))).alias("e")).select(*keys, "__l", "e.*")
    both = r.withColumn("__side", F.lit(1)).unionByName(ends, allowMissingColumns=True).withColumn("__right", F.col("__side") == 1)
    placed = counted(both, keys, ["__v", "__side", "__r", "__l"], "__right", "__rank")
    bands = placed.where("not __right").groupBy(*keys, "__l").agg(F.min("__rank").alias("lo"), F.max("__rank").alias("hi")).where("lo < hi")  # ranks lo + 1 to hi, from 0 on: lo to hi - 1
    own = placed.where("__right").select(*keys, (F.col("__rank") - 1).alias("__at"), "__r")
    top = own.agg(F.max("__at")).first()[0] or 0
    levels = top.bit_length()
    runs = own.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"), "__at", "__r").groupBy(*keys, "level", F.expr("shiftright(__at, level)").alias("run")).agg(F.min("__r").alias("__r"))
    # as in a segment tree: on each level the ends that no run of the next level covers
    step = "named_struct('lo', shiftright(s.lo + 1, 1), 'hi', shiftright(s.hi, 1), 'runs', concat(s.runs, if(s.lo < s.hi and (s.lo & 1) = 1, array(named_struct('level', j, 'run', s.lo)), array()), if(s.lo < s.hi and (s.hi & 1) = 1, array(named_struct('level', j, 'run', s.hi - 1)), array())))"
    start = "named_struct('lo', lo, 'hi', hi, 'runs', cast(array() as array<struct<level:int,run:bigint>>))"
    needs = bands.select(*keys, "__l", F.explode(F.expr(f"aggregate(sequence(0, {levels}), {start}, (s, j) -> {step}, s -> s.runs)")).alias("x")).select(*keys, "__l", "x.level", "x.run")
    return needs.join(runs, [*keys, "level", "run"]).groupBy(*keys, F.col("__l").alias(left_id)).agg(F.min("__r").alias("match"))


def nearest_containing(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, left_id: str, right_id: str, reach: float) -> DataFrame:
    """keys, left_id, match: the intervals of right reach from b - reach to b + reach; the smallest id of those that contain the value ``a``, else the nearest one."""
    inside = band_min(left, right, keys, a, b, left_id, right_id, reach).withColumnRenamed("match", "__inside")
    near = nearest_k(left, right, keys, a, b, left_id, right_id).join(inside, [*keys, left_id], "left")
    return near.select(*keys, left_id, F.coalesce("__inside", "match").alias("match"))


#: Rectangles of a cell about, and cuts of an axis at most.
CELL_ROWS, CUTS = 64, 128


def rect_join(left: DataFrame, right: DataFrame, keys: list[str], within: float | Column = 0.0) -> DataFrame:
    """Pairs of rectangles of equal keys that meet when those of left grow by ``within`` on all sides (a number or an expression over left); columns of left and right get l_ and r_, keys stay.

    Each key is cut into strips at quantiles of the left edges, each strip into cells at quantiles of its upper edges, as many as its rows ask for. A rectangle goes to all cells
    that it touches, and a pair is told in the cell of the corner where both begin, once. Null edges and null keys meet nothing."""
    l = left.select(*keys, *[F.col(c).alias(f"l_{c}") for c in left.columns if c not in keys], *[(F.col(c) + (within if c in ("right", "bottom") else -within)).cast("double").alias(f"__{c}") for c in geo.Rect._fields])  # noqa: E741
    r = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys], *[F.col(c).cast("double").alias(f"__{c}") for c in geo.Rect._fields])
    usable = (F.col("__left") <= F.col("__right")) & (F.col("__top") <= F.col("__bottom"))
    l, r = l.where(usable), r.where(usable)  # noqa: E741
    shares = F.array(*[F.lit((i + 1) / CUTS) for i in range(CUTS - 1)])

    def edges(frames: list[DataFrame], by: list[str], column: str, rows: Column) -> DataFrame:
        """Cuts of a group that has more rows than a cell: every so manieth quantile, so that its rows fill them."""
        one = frames[0].select(*by, column)
        for f in frames[1:]:
            one = one.unionAll(f.select(*by, column))
        many = one.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS)
        g = one.join(many.drop("n"), by, "left_semi").groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx(column, shares, 10 * CUTS).alias("q"))
        step = F.greatest(F.lit(1), F.ceil(F.lit(CUTS) / F.greatest(F.lit(1), rows)).cast("int"))
        return g.withColumn("step", step).select(*[F.col(c).alias(f"__k_{c}") for c in by], F.expr("array_distinct(filter(q, (x, i) -> (i + 1) % step = 0))").alias("cuts"))

    def keyed(df: DataFrame, cuts: DataFrame, by: list[str]) -> DataFrame:
        on = F.lit(True)
        for c in by:
            on = on & (F.col(c) == F.col(f"__k_{c}"))
        return df.join(cuts, on, "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<double>"))).drop(*[f"__k_{c}" for c in by])

    place = lambda x: f"size(filter(cuts, e -> e <= {x}))"

    def dealt(df: DataFrame, cuts: DataFrame, by: list[str], low: str, high: str, name: str) -> DataFrame:
        return keyed(df, cuts, by).withColumn(name, F.explode(F.expr(f"sequence({place(low)}, {place(high)})"))).withColumn(f"{name}_of", F.expr(place(low))).drop("cuts")

    strips = edges([l, r], keys, "__left", F.sqrt(F.col("n") / CELL_ROWS))
    l, r = (dealt(x, strips, keys, "__left", "__right", "__strip") for x in (l, r))  # noqa: E741
    cells = edges([l, r], [*keys, "__strip"], "__top", F.col("n") / CELL_ROWS)
    l, r = (dealt(x, cells, [*keys, "__strip"], "__top", "__bottom", "__cell") for x in (l, r))  # noqa: E741
    names = {f"__{c}": f"__o_{c}" for c in [*geo.Rect._fields, "strip_of", "cell_of"]}
    met = l.join(r.withColumnsRenamed(names), [*keys, "__strip", "__cell"])
    first = (F.greatest("__strip_of", "__o_strip_of") == F.col("__strip")) & (F.greatest("__cell_of", "__o_cell_of") == F.col("__cell"))
    meets = (F.col("__left") <= F.col("__o_right")) & (F.col("__o_left") <= F.col("__right")) & (F.col("__top") <= F.col("__o_bottom")) & (F.col("__o_top") <= F.col("__bottom"))
    return met.where(first & meets).select(*keys, *[c for c in met.columns if c.startswith(("l_", "r_"))])
