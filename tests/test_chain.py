"""The chain's claims: what one pass has recognized no later pass sees; arpeggi, hollow heads, meters of two figures and clefs in one place."""

import pytest

from corvine.operators import iterate, score
from corvine.plans import fixtures
from corvine.plans.fixtures import SYMBOLS, at


@pytest.fixture(scope="module")
def blocks(spark):
    return iterate.cut(fixtures.page_blocks(spark))


def labels_of(df):
    return sorted((r["id"], r["label"]) for r in df.collect())


def test_chain_claims_and_arpeggi(spark, blocks):
    waves = [at(80 + k, 1, 1, 55, 2.5 + 2.6 * k, 4, 13, "wave") for k in range(3)]
    rows = [
        at(1, 1, 1, 12, 4, 24, 60, "G"), at(4, 1, 1, 30, 2, 8, 17, "1", 0.8), at(5, 1, 1, 39, 2, 10, 17, "2", 0.9), at(6, 1, 1, 34, 6, 14, 17, "8", 0.9),
        at(10, 1, 1, 60, 3, 12, 9, "oval"), at(11, 1, 1, 60, 6, 12, 9, "oval"), at(12, 1, 1, 120, 5, 12, 9, "oval"),
        at(31, 1, 1, 125.5, 2, 1, 30, "stem"),
        at(40, 1, 1, 129, -0.5, 7, 14, "flag8thUp"),
        # what lies where the flag, an accidental and a wave lie is no rest of its own
        at(41, 1, 1, 129, -0.5, 7, 14, "restQuarter"), at(42, 1, 1, 108, 5, 6, 16, "sharp"), at(43, 1, 1, 108, 5, 6, 16, "restHalf"), at(44, 1, 1, 55, 2.5, 4, 13, "rest8th"),
        at(60, 1, 2, 100, 4, 12, 28, "restQuarter"), *waves,
    ]
    out = score.resolve(spark.createDataFrame(rows, SYMBOLS), blocks, [(12, 8), (2, 8)])
    assert [(r["beats"], r["beat_value"]) for r in out["meters"].collect()] == [(12, 8)]
    found = out["arpeggi"].collect()
    assert [(r["pieces"], r["heads"]) for r in found] == [([80, 81, 82], [10, 11])]
    assert [(r["stem"], r["flag"]) for r in out["flags"].collect()] == [(31, 40)]
    assert labels_of(out["accidentals"].where("head is not null")) == [(42, "sharp")]
    assert labels_of(out["rests"]) == [(60, "restQuarter")]


def test_heads_by_their_outlines(spark, blocks):
    """A nested oval of the same source makes a head hollow and is no head; one of another source is only no head; a box is no oval."""
    rows = [at(10, 1, 1, 60, 3, 12, 9, "oval"), at(11, 1, 1, 60, 3, 8, 5, "oval"), at(12, 1, 1, 90, 3, 12, 9, "oval"), at(13, 1, 1, 90, 3, 8, 5, "oval"), at(14, 1, 1, 120, 3, 12, 9, "oval"), at(15, 1, 1, 150, 3, 12, 9, "box"), at(16, 1, 1, 180, 3, 12, 9, "oval"), at(17, 1, 1, 183.9, 3, 4, 3, "oval")]
    ovals = spark.createDataFrame([(*r, {10: 1, 11: 1, 12: 2, 13: 3, 16: 5, 17: 5}.get(r[1], 9)) for r in rows], SYMBOLS + ", source int").drop("hole")
    grid = fixtures.grid_of(spark)
    clefs = spark.createDataFrame([("p1", 1, 1, 0, "G", -1.0)], "page string, part int, measure int, id long, label string, lx double")
    none = grid.where("false").selectExpr("page", "part", "measure", "0 depth", "`left`", "`right`")
    heads = {r["id"]: r["filled"] for r in score.noteheads(ovals, grid, clefs, none).collect()}
    assert heads == {10: False, 12: True, 14: True, 16: True}  # 17 is not in the middle of 16
    assert {r["id"] for r in score.noteheads(ovals.drop("source"), grid, clefs, none).where("filled").collect()} == {10, 12, 14, 16}


def test_two_figures_and_what_is_not_supported(spark, blocks):
    none = blocks.withColumn("units", blocks["part"] * 0)
    make = lambda gap, low="8": spark.createDataFrame([at(1, 1, 1, 30, 2, 8, 17, "1"), at(2, 1, 1, 39 + gap, 2, 10, 17, "2"), at(3, 1, 1, 34 + gap / 2, 6, 14, 17, low)], SYMBOLS)
    read = lambda df, known: [(r["beats"], r["beat_value"]) for r in score.compound_meters(df, none, known).collect()]
    assert read(make(0.0), [(12, 8)]) == [(12, 8)] and read(make(5.0), [(12, 8)]) == [(12, 8)]
    assert read(make(20.0), [(12, 8)]) == [] and read(make(0.0, "7"), [(12, 8)]) == []


def test_clefs_in_one_place(spark, blocks):
    grid = fixtures.grid_of(spark)
    rows = [(*at(i, 1, 1, 12, 4, 24, 60, label, confidence), derived, paths) for i, label, confidence, derived, paths in ((1, "F", 0.99, True, 9), (2, "G", 0.5, False, 2), (3, "C", 0.9, False, 1))]
    s = spark.createDataFrame(rows, SYMBOLS + ", derived boolean, paths int")
    assert [r["id"] for r in score.clefs(s, grid).collect()] == [2]
    assert sorted(r["id"] for r in score.clefs(s.drop("derived"), grid).collect()) == [1, 2, 3]
