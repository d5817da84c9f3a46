"""score-partwise MusicXML: readers for notes and timed elements, a writer, a structural diff.

Files come from Spark's binary reader, one row per file, and are parsed with the standard library in Arrow
batches, because note, backup and forward must keep their document order (a row-tag reader gathers children by name). A broken file gives a row
with its error instead of failing the job. DTDs are allowed; entities are not resolved.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators import windows
from .batches import in_batches

ELEMENTS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("path", "error", "part", "measure")]
    + [T.StructField("measure_pos", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("kind", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in ("divisions", "duration", "default_x", "default_y", "alter")]
    + [T.StructField(n, T.BooleanType()) for n in ("is_chord", "is_rest", "is_grace")]
    + [T.StructField(n, T.StringType()) for n in ("step", "voice", "type", "accidental", "stem")]
    + [T.StructField(n, T.IntegerType()) for n in ("octave", "staff", "dots", "beats", "beat_type")]
    + [T.StructField(n, T.StringType()) for n in ("clef", "key", "xml")]
)
KINDS = ("note", "backup", "forward", "attributes", "direction", "barline", "print")


def number(text: str | None) -> float | None:
    """Invariant; null for what is not a number."""
    try:
        return float(text.strip()) if text is not None else None
    except ValueError:
        return None


def whole(text: str | None) -> int | None:
    x = number(text)
    return int(x) if x is not None and x == int(x) else None


ESCAPED = re.compile("[&<>]")
SPECIAL = re.compile(r'[&<>"\r\n\t{]')


class Odd(Exception):
    """There is a namespace or something to escape."""


def plain(e: ET.Element) -> str:
    """The XML of an element without its tail; texts have nothing to escape."""
    tag, head, text = e.tag, e.tag, e.text or ""
    if "{" in tag:
        raise Odd
    if e.attrib:
        if SPECIAL.search("".join([k + v for k, v in e.attrib.items()])):
            raise Odd
        head += "".join([f' {k}="{v}"' for k, v in e.attrib.items()])
    if len(e):
        text += "".join([plain(c) + c.tail if c.tail else plain(c) for c in e])
        return f"<{head}>{text}</{tag}>"
    return f"<{head}>{text}</{tag}>" if text else f"<{head} />"


def written(e: ET.Element) -> str:
    """ET.tostring(e) without outer blanks; short for elements in which there is nothing to escape."""
    if not ESCAPED.search("".join(e.itertext())) and not (e.tail and e.tail.strip()):
        try:
            return plain(e)
        except Odd:
            pass
    return ET.tostring(e, encoding="unicode").strip()


def texts(e: ET.Element) -> dict[str, str]:
    """What findtext() gives for each child and each child's child."""
    first: dict[str, str] = {}
    for c in e:
        if c.tag not in first:
            first[c.tag] = c.text or ""
        for g in c:
            first.setdefault(f"{c.tag}/{g.tag}", g.text or "")
    return first


def elements(path: str, data: bytes) -> Iterator[dict]:
    """One dict per child of a measure, in document order. A missing part id is P1, P2, ...; a missing number counts from 1."""
    root = ET.fromstring(data)
    if root.tag != "score-partwise":
        raise ValueError(f"{root.tag} is not score-partwise")
    for p, part in enumerate(root.iter("part"), 1):
        divisions = 1.0
        for m, measure in enumerate(part.iter("measure"), 1):
            at = {"path": path, "part": part.get("id") or f"P{p}", "measure": measure.get("number") or str(m), "measure_pos": m}
            if not len(measure):
                yield at | {"pos": 0, "kind": "empty"}
            for k, e in enumerate(measure):
                if e.tag not in KINDS:
                    continue
                first = texts(e)
                text = first.get
                divisions = number(text("divisions")) or divisions
                row = at | {"pos": k, "kind": e.tag, "divisions": divisions, "duration": number(text("duration")), "staff": whole(text("staff")), "voice": text("voice"), "xml": written(e)}
                if e.tag == "note":
                    row |= {"default_x": number(e.get("default-x")), "default_y": number(e.get("default-y")), "alter": number(text("pitch/alter")), "step": text("pitch/step"), "octave": whole(text("pitch/octave")), "type": text("type"), "accidental": text("accidental"), "stem": text("stem"), "dots": len(e.findall("dot")) if "dot" in first else 0}
                    row |= {"is_chord": "chord" in first, "is_rest": "rest" in first, "is_grace": "grace" in first}
                elif e.tag == "attributes":
                    sign, line = text("clef/sign"), text("clef/line")
                    row |= {"beats": whole(text("time/beats")), "beat_type": whole(text("time/beat-type")), "clef": f"{sign}{line or ''}" if sign else None, "key": text("key/fifths")}
                yield row


def parse(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(ELEMENTS)

    def rows(path: str, data: bytes | None) -> list[dict]:
        try:
            return list(elements(path, data or b""))
        except (ET.ParseError, ValueError) as e:
            return [{"path": path, "error": f"{type(e).__name__}: {e}"}]

    yield from in_batches((rows(path, data.as_py()) for b in files for path, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True)), schema)


def read_elements(spark: SparkSession, path: str, pattern: str = "*.musicxml", recursive: bool = True) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "content").mapInArrow(parse, ELEMENTS)


def parse_column(df: DataFrame, path: str, content: str) -> DataFrame:
    """The same from a table of documents."""
    return df.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).mapInArrow(parse, ELEMENTS)


MEASURE = ["path", "part", "measure_pos"]


def notes(elements_: DataFrame) -> DataFrame:
    return elements_.where("kind = 'note'")


def timed_events(elements_: DataFrame) -> DataFrame:
    """Notes with position in quarters: the metric cursor over note, backup and forward; chord members take the last onset of their voice."""
    steps = elements_.where("kind in ('note', 'backup', 'forward')").withColumn("voice", F.coalesce("voice", F.lit("1")))
    amount = F.coalesce("duration", F.lit(0.0)) / F.col("divisions")
    step = F.when(F.col("kind") == "backup", -amount).otherwise(amount)
    shares = (F.col("kind") == "note") & F.coalesce("is_chord", F.lit(False))
    timed = windows.cursor(steps, MEASURE, [*MEASURE, "voice"], ["pos"], step, shares, "position")
    return timed.where("kind = 'note'").withColumn("quarters", amount)


def attribute_state(elements_: DataFrame) -> DataFrame:
    """Clef, key and meter in force at each measure, carried forward in a part."""
    own = elements_.groupBy(*MEASURE, "measure").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in ("clef", "key", "beats", "beat_type")])
    for c in ("clef", "key", "beats", "beat_type"):
        own = windows.carry_forward(own, ["path", "part"], ["measure_pos"], c, c)
    return own


def write_scores(elements_: DataFrame) -> DataFrame:
    """path, content: each file's parts and measures put together again from the kept XML of their elements."""
    escape = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c), "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    body = lambda c, o: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(o, c))), lambda x: x[c]), "\n")
    measures = elements_.where("error is null").groupBy(*MEASURE, "measure").agg(body("xml", "pos").alias("xml"))
    measures = measures.withColumn("xml", F.concat(F.lit('<measure number="'), escape("measure"), F.lit('">\n'), "xml", F.lit("\n</measure>")))
    parts = measures.groupBy("path", "part").agg(body("xml", "measure_pos").alias("xml"))
    parts = parts.select("path", "part", F.concat(F.lit('<part id="'), escape("part"), F.lit('">\n'), "xml", F.lit("\n</part>")).alias("xml"), F.concat(F.lit('<score-part id="'), escape("part"), F.lit('"><part-name/></score-part>')).alias("head"))
    scores = parts.groupBy("path").agg(body("head", "part").alias("head"), body("xml", "part").alias("xml"))
    return scores.select("path", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<score-partwise version="4.0">\n<part-list>'), "head", F.lit("</part-list>\n"), "xml", F.lit("\n</score-partwise>")).alias("content"))


def tree_diff(a: str, b: str, most: int = 500) -> list[str]:
    """Where two XML texts differ, as paths: tags, attributes, text without outer blanks, missing and extra children."""
    out: list[str] = []

    def walk(x: ET.Element, y: ET.Element, path: str) -> None:
        if x.tag != y.tag:
            out.append(f"{path}: {x.tag} / {y.tag}")
            return
        for k in sorted(x.attrib.keys() | y.attrib.keys()):
            if x.get(k) != y.get(k):
                out.append(f"{path}/@{k}: {x.get(k)} / {y.get(k)}")
        if (x.text or "").strip() != (y.text or "").strip():
            out.append(f"{path}: '{(x.text or '').strip()}' / '{(y.text or '').strip()}'")
        for i in range(max(len(x), len(y))):
            if i >= len(x) or i >= len(y):
                one = (x if i < len(x) else y)[i]
                out.append(f"{path}/{one.tag}[{i}]: {'missing' if i < len(x) else 'extra'}")
            else:
                walk(x[i], y[i], f"{path}/{x[i].tag}[{i}]")
            if len(out) >= most:
                return

    walk(ET.fromstring(a), ET.fromstring(b), "")
    return out[:most]
