"""Operator 1, secret scans: multipart credential linking.

Every whole text is scanned for parts of a credential: access identifiers, secrets and endpoints.
Parts that are strong by themselves (the base patterns) are always reported. Weak candidates, which
alone are mostly false alarms, are reported only when a complementary part lies within their
scope: both spans, each widened by ``reach`` code points, must meet (so the gap between them is 2 * ``reach`` at most) and sit in
one section (sections end at a run of blank lines). A weak part within or across a base span is that span's, not a part of its own.
The overlap is an interval join by a sweep in start order within each document; a weak part needs
one partner, so no pairs are emitted and a text with n parts costs O(n log n). Parts may be of any length.

Defined results: a null text is an empty text (no spans); rows repeat as they repeat; a null
doc_id is carried along; input columns with the name of an output column are replaced; an empty
table gives an empty table. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import append_columns, table

#: The base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

#: Weak parts: an identifier or secret by its label, a mixed high-entropy word, an endpoint.
WEAK_ID = re.compile(r"\b(?:client_?id|key_?id|account(?:_?id)?|user(?:_?name)?|login|tenant)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{3,}+)", re.ASCII | re.IGNORECASE)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+=*+(?![A-Za-z0-9+/_-])")
ENDPOINT = re.compile(r"\b(?:https?|s3|gs|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{3,}|\b(?:host|hostname|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{3,}", re.ASCII | re.IGNORECASE)
SECTION = re.compile(r"\n[\x20\t\r]*\n")

KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
BASE = KINDS[:3]
#: What a part of each kind is, and which sides complete it. A long run of hex digits may be a key or a digest.
SIDE = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
REACH = 240
MIN_ENTROPY = 3.5


def entropy(word: str) -> float:
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in Counter(word).values())


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def weak_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "weak_id") for m in WEAK_ID.finditer(text)]
    for m in WEAK_SECRET.finditer(text):
        w = m[0]
        if any(c.isdigit() for c in w) and any(c.isupper() for c in w) and any(c.islower() for c in w) and entropy(w) >= MIN_ENTROPY:
            out.append((m.start(), m.end(), "weak_secret"))
    return out + [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]


def linked(base: list[tuple], weak: list[tuple], text: str, reach: int) -> list[tuple]:
    """The weak spans that a complementary part completes. An identifier needs a secret and a secret
    an identifier; an endpoint is told when an identifier and a secret both reach it."""
    gaps = [m.span() for m in SECTION.finditer(text)]
    cuts = [s for s, _ in gaps]
    sides: dict[str, list[tuple[int, int]]] = {"id": [], "secret": [], "endpoint": []}
    for s, e, k in sorted(base + weak):
        sides[SIDE[k]].append((s, e))
    tops = {}
    for side, spans in sides.items():
        tops[side] = ([s for s, _ in spans], [])
        top = -1
        for _, e in spans:  # the greatest end so far, for overlap tests by bisection
            tops[side][1].append(top := max(top, e))

    def meets(span: tuple, side: str) -> bool:
        s, e, _ = span
        k = bisect.bisect_right(cuts, s)
        low, high = (gaps[k - 1][1] if k else 0), (cuts[k] if k < len(cuts) else len(text))
        starts, most = tops[side]
        last = bisect.bisect_right(starts, min(e + 2 * reach, high)) - 1
        first = bisect.bisect_left(most, max(s - 2 * reach, low))
        for j in range(first, last + 1):  # spans of one side seldom overlap: ends in a step or two
            a, b = sides[side][j]
            if b >= max(s - 2 * reach, low) and (b <= s or a >= e):
                return True
        return False

    needs = {"id": ("secret",), "secret": ("id",), "endpoint": ("id", "secret")}
    return [x for x in weak if all(meets(x, side) for side in needs[SIDE[x[2]]])]


def scan_text(text: str | None, reach: int = REACH) -> tuple[list[tuple], list[tuple]]:
    """Base spans and linked weak spans, as (start, end, kind)."""
    text = text or ""
    base = base_spans(text)
    weak = weak_spans(text)
    covered = sorted((s, e) for s, e, _ in base)
    starts, ends = [s for s, _ in covered], list(itertools.accumulate((e for _, e in covered), max))

    def free(x: tuple) -> bool:
        j = bisect.bisect_left(starts, x[1])
        return j == 0 or ends[j - 1] <= x[0]

    weak = [x for x in weak if free(x)]
    return base, linked(base, weak, text, reach) if weak else []


def digest(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def scan_secrets(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """docs and secret_spans: array of (kind, start, end, strong) by start, then kind."""
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("strong", T.BooleanType())]))

    def make():
        def run(texts):
            rows = []
            for t in texts.to_pylist():
                base, weak = scan_text(t, reach)
                both = sorted(base + weak, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
                rows.append([{"kind": k, "start": s, "end": e, "strong": k in BASE} for s, e, k in both])
            return [rows]

        return run

    return append_columns(docs, [text], [T.StructField("secret_spans", kind)], make)


def op1_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.selectExpr(
        "doc_id",
        *[f"cast(size(filter(secret_spans, x -> x.kind = '{k}')) as long) n_{k}" for k in KINDS],
        "sha2(array_join(transform(filter(secret_spans, x -> x.strong), x -> concat_ws(':', x.kind, x.start, x.end)), ','), 256) base_sha256",
        "array_join(transform(secret_spans, x -> concat_ws(':', x.kind, x.start, x.end)), ',') spans",
    )
