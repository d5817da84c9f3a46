"""Comparing what was recognized with a reference: block, attribute and note diffs, event matching with scores, round trips."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.musicxml import tree_diff
from .aggregates import precision_recall
from .grouped import match_by_tolerance
from .iterate import global_rank
from .joins import full_outer, rank_match


def set_diff(expected: DataFrame, actual: DataFrame, keys: list) -> DataFrame:
    """keys, verdict: matched, missing or extra, each key once."""
    e, a = expected.select(*keys, F.lit(1).alias("e")).distinct(), actual.select(*keys, F.lit(1).alias("a")).distinct()
    both = full_outer(e, a, keys, "e")
    return both.select(*keys, F.when(F.col("e").isNull(), "extra").when(F.col("a").isNull(), "missing").otherwise("matched").alias("verdict"))


def multiset_diff(expected: DataFrame, actual: DataFrame, keys: list, order: list, compare: list = ()) -> DataFrame:
    """Positional within a key: keys, n, verdict and the names of ``compare`` columns that differ."""
    m = rank_match(expected.select(*keys, *order, *compare), actual.select(*keys, *order, *compare), keys, order, order)
    differing = F.concat_ws(",", *[F.when(F.col("in_l") & F.col("in_r") & ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.lit(c)) for c in compare]) if compare else F.lit("")
    verdict = F.when(F.col("in_l").isNull(), "extra").when(F.col("in_r").isNull(), "missing").when(F.col("differs") != "", "mismatched").otherwise("matched")
    return m.withColumn("differs", differing).withColumn("verdict", verdict).select(*keys, "n", "verdict", "differs")


def summary(diff: DataFrame, by: list = ()) -> DataFrame:
    c = diff.groupBy(*by).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("matched", "mismatched", "missing", "extra")])
    return c.select("*", *precision_recall(*[F.col(v) for v in ("matched", "mismatched", "missing", "extra")]))


def report(diff: DataFrame, by: list, worst: int) -> DataFrame:
    """The tables of a report: the summary of each group with its rank, the worst first by F1, then by what is missing, then by its keys; and whether it is among the ``worst``."""
    s = summary(diff, by)
    ranked = global_rank(s, ["f1", F.desc("missing"), *by], "rank")
    return ranked.withColumn("worst", F.col("rank") <= worst)


def match_events(expected: DataFrame, actual: DataFrame, keys: list, tolerance: float = 0.5) -> DataFrame:
    """Events (id, position, step, octave, quarters) matched in time per key; a match is wrong if pitch or duration differ."""
    m = match_by_tolerance(expected, actual, keys, "position", "id", tolerance, "step")
    side = lambda df, name: df.select(*keys, F.col("id").alias(name), F.struct("step", "octave", F.round("quarters", 4).alias("q")).alias(f"{name}_v"))
    both = m.join(side(expected, "expected"), [*keys, "expected"], "left").join(side(actual, "actual"), [*keys, "actual"], "left")
    verdict = F.when(F.col("expected").isNull(), "extra").when(F.col("actual").isNull(), "missing").when(F.col("expected_v").eqNullSafe(F.col("actual_v")), "matched").otherwise("mismatched")
    return both.select(*keys, "expected", "actual", "distance", verdict.alias("verdict"))


def xml_diff(pairs: DataFrame, a: str, b: str, most: int = 500) -> DataFrame:
    """pairs with differences, an array of paths; an unreadable side is one difference."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields) + ", differences array<string>"

    def one(x, y) -> list[str] | None:
        if x is None or y is None:
            return None
        try:
            return tree_diff(x, y, most)
        except SyntaxError as e:
            return [f"unreadable: {e}"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            yield g.assign(differences=[one(x, y) for x, y in zip(g[a], g[b], strict=True)])

    return pairs.mapInPandas(run, schema)


def round_trip(before: DataFrame, after: DataFrame, keys: list, order: list, columns: list) -> DataFrame:
    """Rows of the typed projection that changed; none for a faithful round trip."""
    return multiset_diff(before, after, keys, order, columns).where("verdict <> 'matched'")
