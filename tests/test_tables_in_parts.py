"""Tables that are folders of parts, pages of which one side is empty, files whose text must not depend on how rows arrive."""

from corvine.operators import legacy, score
from corvine.plans.score_tables import segment_pages
from corvine.sources import text


def test_a_table_of_parts_is_one_file(spark, tmp_path):
    (tmp_path / "a.parquet").write_bytes(b"x")
    for k in range(3):
        (tmp_path / "B.parquet").mkdir(exist_ok=True)
        (tmp_path / "B.parquet" / f"part-{k}.parquet").write_bytes(b"x")
        (tmp_path / "sub").mkdir(exist_ok=True)
        (tmp_path / "sub" / f"c{k}.parquet").write_bytes(b"x")
    (tmp_path / "d.csv").write_bytes(b"x")
    (tmp_path / "e.parquets").mkdir()
    (tmp_path / "e.parquets" / "x.csv").write_bytes(b"x")
    flat = text.list_files(spark, str(tmp_path), "*.parquet").orderBy("n").collect()
    assert [(r["n"], r["name"]) for r in flat] == [(1, "a.parquet"), (2, "B.parquet")] and flat[1]["path"].endswith("/B.parquet")
    deep = text.list_files(spark, f"file://{tmp_path}/", "*.parquet", recursive=True).orderBy("n").collect()
    assert [r["name"] for r in deep] == ["a.parquet", "B.parquet", "c0.parquet", "c1.parquet", "c2.parquet"]


def test_rests_of_a_page_without_claimed_objects(spark):
    box = "id long, page string, part int, measure int, left double, top double, right double, bottom double, label string, confidence double"
    signs = spark.createDataFrame([(1, "p", 1, 0, 10.0, 300.0, 19.0, 312.0, "restHalf", 0.9), (2, "p", 1, 0, 10.0, 110.0, 19.0, 122.0, "restHalf", 0.9)], box)
    grid = spark.createDataFrame([("p", 1, 0, 0.0, 100.0, 200.0, 140.0, 32)], "page string, part int, measure int, left double, top double, right double, bottom double, units int")
    none = spark.createDataFrame([("q", 0.0, 300.0, 9.0, 312.0)], "page string, left double, top double, right double, bottom double")
    assert [r["id"] for r in score.rests(signs, grid, none).collect()] == [2]


def test_a_chord_whose_line_is_at_the_mean_of_its_heads(spark):
    """199.4, 198.3 and 186.7 in this order sum to a little more than 3 * 194.8; in others they do not. The order is that of the ids, however the rows arrive."""
    heads = [("p", 1, 1, 199.4, 100.0), ("p", 2, 2, 198.3, 200.0), ("p", 1, 3, 186.7, 100.0)]
    lines = spark.createDataFrame([("p", 9, 194.8, 100.0, 230.0)], "page string, id long, x double, top double, bottom double")
    staves = spark.createDataFrame([("p", 1, 100.0, 140.0), ("p", 2, 200.0, 240.0)], "page string, staff int, top double, bottom double")
    assert (199.4 + 198.3 + 186.7) / 3 > 194.8 >= (198.3 + 186.7 + 199.4) / 3
    for order in ((0, 1, 2), (2, 1, 0), (1, 2, 0)):
        rows = spark.createDataFrame([heads[k] for k in order], "page string, staff int, id long, x double, y double").coalesce(1)
        got = legacy.cross_staff_chords(rows, lines, staves, 10.0).collect()
        assert [(r["direction"], r["heads"]) for r in got] == [("down", [1, 2, 3])]


def test_the_text_of_a_page_does_not_depend_on_the_order_of_rows(spark):
    rows = [("p", k, 1 + k % 2, k, 0, 1, 1) for k in range(40)]
    made = [segment_pages(spark.createDataFrame(r, "page string, id long, kind long, x int, y int, w int, h int").coalesce(1)).first()["content"] for r in (rows, rows[::-1])]
    assert made[0] == made[1] and made[0].index('x="1"') < made[0].index('x="39"')


def test_a_line_at_the_very_limit_of_a_head(spark):
    """18.1 - 4.1 - 12 is a little more than 2, 18.1 - 16.1 is not: a head that tells its width is measured from its left edge."""
    heads = spark.createDataFrame([("p", 1, 1, 1, 4.1, 95.5, 4.1 + 12, 104.5, 12.0), ("p", 1, 1, 2, 6.1, 95.5, 18.1, 104.5, 12.0)], "page string, measure int, part int, id long, left double, top double, right double, bottom double, width double")
    lines = spark.createDataFrame([("p", 1, 1, 9, 18.1, 60.0, 18.1, 100.0)], "page string, measure int, part int, id long, left double, top double, right double, bottom double")
    grid = spark.createDataFrame([("p", 1, 1, 0.0, 100.0, 600.0, 140.0, 32)], "page string, part int, measure int, left double, top double, right double, bottom double, units int")
    assert [r["head"] for r in score.stems(lines, heads, grid)[1].collect()] == [2]
    assert sorted(r["head"] for r in score.stems(lines, heads.drop("width"), grid)[1].collect()) == [1, 2]
