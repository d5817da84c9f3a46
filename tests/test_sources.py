import json
import zipfile

from corvine.plans.fixtures import SCORE, SVG
from corvine.sources import musicxml, svg, text
from corvine.streaming import pages


def test_musicxml_files_and_broken_ones(spark, tmp_path):
    (tmp_path / "a.musicxml").write_text(SCORE)
    (tmp_path / "b.musicxml").write_text("<score-partwise><part>")
    (tmp_path / "c.musicxml").write_text("<other/>")
    rows = musicxml.read_elements(spark, str(tmp_path))
    assert rows.where("error is not null").count() == 2
    assert rows.where("kind = 'note'").count() == 6 and rows.where("is_chord").count() == 1


def test_self_comparison_is_perfect(spark, tmp_path):
    from pyspark.sql import functions as F

    from corvine.operators import quality

    (tmp_path / "a.musicxml").write_text(SCORE)
    e = musicxml.timed_events(musicxml.read_elements(spark, str(tmp_path))).withColumn("id", (F.col("measure_pos") * 1000 + F.col("pos")).cast("long"))
    e = e.select("part", "measure", "voice", "id", "position", "step", "octave", "quarters")
    assert quality.summary(quality.match_events(e, e, ["part", "measure", "voice"])).first()["f1"] == 1.0


def test_svg_files(spark, tmp_path):
    (tmp_path / "page10.svg").write_text(SVG)
    (tmp_path / "page2.svg").write_text(SVG)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "page1.svg").write_text("<svg")
    assert svg.read_contours(spark, str(tmp_path)).count() == 10
    assert svg.read_contours(spark, str(tmp_path), recursive=True).where("error is not null").count() == 1
    assert {(r["tag"], r["n"]) for r in svg.tag_counts(spark, str(tmp_path)).where("tag = 'path'").collect()} == {("path", 2)}
    natural = [r["name"] for r in text.list_files(spark, str(tmp_path), "*.svg", natural=True).orderBy("n").collect()]
    plain = [r["name"] for r in text.list_files(spark, str(tmp_path), "*.svg").orderBy("n").collect()]
    assert natural == ["page2.svg", "page10.svg"] and plain == ["page10.svg", "page2.svg"]


def test_sidecar_csv_json_and_bundle(spark, tmp_path):
    (tmp_path / "score.txt").write_text("Title: A\n34-1-L: dolce\n")
    kv = {r["key"]: r for r in text.read_sidecar(spark, str(tmp_path / "score.txt")).collect()}
    assert kv["34-1-L"]["measure"] == 34 and kv["Title"]["value"] == "A"
    text.write_csv(spark.createDataFrame([(1, 'say "x"')], "a int, b string"), str(tmp_path / "out"))
    model = {"family": "clefs", "grid_size": 32, "mean": [0.0], "components": [[1.0]], "ratio_threshold": 0.9, "class_thresholds": {"G": 1.0}, "references": [{"class": "G", "source": "s", "fingerprint": [0.5]}]}
    for name, listed in (("a.zip", True), ("b.zip", False)):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("clefs.json", json.dumps(model))
            if listed:
                z.writestr("manifest.json", json.dumps({"models": ["clefs.json"]}))
        bundle = text.load_bundle(spark, str(tmp_path / name))
        assert bundle["models"].first()["family"] == "clefs" and bundle["references"].count() == 1
    (tmp_path / "catalog.json").write_text(json.dumps([{"id": "g", "kind": "clef", "size_tolerance": 0.2}]))
    assert text.read_catalog(spark, str(tmp_path / "catalog.json")).first()["size_tolerance"] == 0.2
    (tmp_path / "names.json").write_text(json.dumps({"gClef": {"codepoint": "U+E050"}, "fClef": {"codepoint": "U+E062"}}))
    assert {r["name"] for r in text.named_entries(spark, str(tmp_path / "names.json"), "codepoint: string").collect()} == {"gClef", "fClef"}


def test_stream_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.musicxml").write_text(SCORE)
        pages.append_to(pages.stream_scores(spark, str(tmp_path / "in")), out, mark).awaitTermination()
    assert spark.read.parquet(out).where("kind = 'note'").count() == 12


def test_elements_are_read_as_by_findtext_and_written_as_by_tostring(monkeypatch):
    """Also where there is something to escape, an attribute, a name space or a text after an element; plain ones don't go through tostring."""
    import xml.etree.ElementTree as ET

    from corvine.sources import musicxml

    notes = [
        "<note><pitch><step>C</step><octave>4</octave></pitch><duration>2</duration><voice/></note>", "<note default-x='3.5' id='a&amp;b'><rest/><type> half </type></note>", "<note><a>1 &lt; 2</a></note>",
        "<note><chord/><pitch/><pitch><alter>-1</alter><step>A</step></pitch><dot/><dot/></note> tail &amp; more", "<note><lyric xml:lang='de' x='\"&#10;'>ä<b/>c</lyric></note>\n", "<note/>", "<note><n:x xmlns:n='u'>1</n:x></note>",
        "<attributes><clef><sign>G</sign></clef><clef><line>2</line></clef><time><beats>3</beats><beat-type>4</beat-type></time></attributes>",
    ]
    text = f"<score-partwise><part><measure>{''.join(notes)}</measure></part></score-partwise>"
    measure = ET.fromstring(text).find("part/measure")
    got = list(musicxml.elements("p", text.encode()))
    assert [r["xml"] for r in got] == [ET.tostring(e, encoding="unicode").strip() for e in measure]
    for r, e in zip(got, measure, strict=True):
        for name, path in (("step", "pitch/step"), ("voice", "voice"), ("type", "type")):
            assert r["kind"] != "note" or r[name] == e.findtext(path)
    assert got[0]["voice"] == "" and (got[3]["alter"], got[3]["dots"], got[3]["is_chord"]) == (-1.0, 2, True) and (got[7]["clef"], got[7]["beats"]) == ("G2", 3)
    monkeypatch.setattr(musicxml.ET, "tostring", lambda *a, **k: 1 / 0)
    assert len(list(musicxml.elements("p", f"<score-partwise><part><measure>{notes[0]}</measure></part></score-partwise>".encode()))) == 1
