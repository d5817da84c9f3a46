"""Files become batches of bounded size."""

import pyarrow as pa

from corvine.sources import batches, musicxml, svg


def files(n, content):
    return iter([pa.record_batch({"path": [f"f{k}" for k in range(n)], "content": [content(k) for k in range(n)]})])


def test_many_scores_in_one_batch(spark):
    note = b"<note><pitch><step>C</step><octave>4</octave></pitch><duration>1</duration></note>"
    score = lambda k: b'<score-partwise><part id="P1"><measure number="1">' + note * 700 + b"</measure></part></score-partwise>" if k != 5 else b"<score-partwise>"
    out = list(musicxml.parse(files(40, score)))
    rows = [r for b in out for r in b.to_pylist()]
    assert max(b.num_rows for b in out) <= batches.ROWS and len(rows) == 39 * 700 + 1
    assert [r["path"] for r in rows if r["error"]] == ["f5"] and [r["pos"] for r in rows if r["path"] == "f9"] == list(range(700))


def test_a_page_of_many_shapes(spark):
    page = lambda k: b'<svg xmlns="http://www.w3.org/2000/svg">' + b'<line x1="0" y1="0" x2="1" y2="1"/>' * 9000 + b"</svg>" if k else b"<svg"
    out = list(svg.parse(8)(files(3, page)))
    rows = [r for b in out for r in b.to_pylist()]
    assert max(b.num_rows for b in out) <= batches.ROWS and len(rows) == 18001 and rows[0]["error"]
    assert [r["id"] for r in rows if r["path"] == "f2"] == list(range(9000))


def test_many_small_groups_in_one_task(spark):
    """A call for each group took 2 ms and more; here 20,000 groups, and one of 20,000 rows, are done in seconds."""
    import time

    from corvine.operators import grouped

    e = spark.range(40_000).selectExpr("id div 2 k", "id", "id % 2 * 10.0D v").unionByName(spark.range(20_000).selectExpr("-1L k", "id", "id * 1.0D v"))
    a = spark.range(20_000).selectExpr("id k", "id + 100000 id", "9.0D v").unionByName(spark.range(20_000).selectExpr("-1L k", "id + 200000 id", "id + 0.25D v"))
    began = time.time()
    got = {(r["k"], r["expected"]): r for r in grouped.match_by_tolerance(e, a, ["k"], "v", "id", 1.0).collect()}
    assert time.time() - began < 15
    assert all(got[-1, i]["actual"] == i + 200_000 and got[-1, i]["distance"] == 0.25 for i in range(20_000))
    assert all(got[k, 2 * k + 1]["actual"] == k + 100_000 and got[k, 2 * k]["actual"] is None for k in range(20_000)) and len(got) == 60_000
