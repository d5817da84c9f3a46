"""Operator 12, phrase collocation mining: suffix-sigma.

Texts fall into pieces at sentence and line marks, pieces into words (A-Z lower-cased). At every word a suffix begins: the words up to the end of its piece, max_n at
most. Suffixes are shuffled by language and first word and sorted reverse-lexicographically; then all suffixes that begin with a phrase stand together, and one
stack of the open prefixes counts every prefix of every suffix in one pass: where the next suffix shares fewer than k words, the prefix of k words is closed with its
count. The stack's bottom is the language itself, whose count n is that of all its words. The counts of a candidate's parts are joined afterwards.

Scale: a task turns about FLUSH bytes of text into distinct suffixes with counts, sorted, before anything moves, as packed rows. A shuffle by (language, first word) alone would
put the commonest word into one task, so (language, suffix) is dealt by ranges between borders taken from a sample of the suffixes: several first words to a
range, or several ranges to a common word. A prefix that reaches over a border is told by each range with its part of the count, and the parts are summed with the
phrases; all others are whole where they are told, and leave only if they are common enough. Ranges hold about RANGE bytes of text, 65,536 of them at most. The sample decides where rows go, never what is counted.

Defined results: a null text has no words, a null language counts as ``und`` (and with the language of that name); rows that repeat count as often as they stand there, whatever their id;
texts and pieces of any length are read whole; other columns are not looked at; an empty table gives an empty table. Equal scores are ordered by count, then by the phrase's bytes.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialize, table

MAX_N, LEAST, MOST_RANKS, COVER = 3, 10, 2000, 50
FLUSH, RANGE = 16 << 20, 8 << 20
RANGES = 1 << 16
#: Bytes of text sampled for borders, and suffixes taken for each border.
SAMPLE, PER_BORDER = 8 << 20, 32
#: A byte that no text has in UTF-8 marks the end of a piece.
MARK = b"\xff"
MARKED = bytes(0xFF if i in b".,;:!?\n\x0b\x0c\r" else i + 32 if 65 <= i <= 90 else i for i in range(256))


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, with MARK at the end of every piece."""
    return (text.translate(MARKED) + MARK).replace(MARK, b" \xff ").split()


class Numbers(dict):
    """Numbers from 1 on, in the order of first use; MARK has 0."""

    def __init__(self):
        super().__init__({MARK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def suffixes(ids: np.ndarray, max_n: int) -> np.ndarray:
    """The suffixes at every word, one a row; 0 follows the last word of a piece. ids end with a 0."""
    at = np.flatnonzero(ids)
    ids = np.concatenate([ids, np.zeros(max_n, ids.dtype)])
    out = np.zeros((len(at), max_n), np.int32)
    going = np.ones(len(at), bool)
    for k in range(max_n):
        going &= ids[at + k] > 0
        out[:, k] = ids[at + k] * going
    return out


def summed(rows: np.ndarray, counts: np.ndarray | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of numbers below ``size`` in lexicographic order, with the sums of their counts."""
    code, most = rows[:, 0].astype(np.int64), size
    for k in range(1, rows.shape[1]):
        if most * size >= 1 << 62:  # dense numbers in the same order
            values, code = np.unique(code, return_inverse=True)
            most = len(values)
        code, most = code * size + rows[:, k], most * size
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    total = np.diff(first, append=len(code)) if counts is None else np.add.reduceat(counts[order], first) if len(first) else counts
    return rows[order[first]], total


def pack(x: np.ndarray) -> bytes:
    """Whole numbers, not below 0, in as few bytes each as the greatest takes, byte by byte."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * w - (w == 8)))
    planes = x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(x: bytes) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(x[9:], int.from_bytes(x[1:9], "little"), codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(x[0], -1).T).view(f"<u{x[0]}").ravel().astype(np.int64)


def pack_words(words: list[bytes]) -> bytes:
    data = b" ".join(words)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpack_words(x: bytes) -> list[bytes]:
    data = pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True)
    return data.split(b" ") if data else []


PACKED = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("words", pa.binary()), ("first", pa.binary()), ("rest", pa.binary()), ("n", pa.binary())])
Border = tuple  # language and words as bytes, shorter suffixes filled up with empty words


class Held:
    """What a task has read since it last told anything."""

    def __init__(self, max_n: int):
        self.max_n, self.size = max_n, 0
        self.number, self.streams = Numbers(), {}

    def add(self, text: bytes, lang: str) -> None:
        some = tokens(text)
        self.streams.setdefault(lang, []).append(np.fromiter(map(self.number.__getitem__, some), np.int32, len(some)))
        self.size += len(text) + 16

    def told(self) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
        """Of each language its words in order, its distinct suffixes as numbers of them (from 1) in order, and their counts."""
        words = sorted(self.number.keys() - {MARK})
        order = np.zeros(len(self.number), np.int32)
        order[[self.number[w] for w in words]] = np.arange(1, len(words) + 1)
        for lang, streams in sorted(self.streams.items(), key=lambda x: x[0].encode()):
            rows = suffixes(order[np.concatenate(streams)], self.max_n)
            if len(rows):
                yield lang, words, *summed(rows, None, len(words) + 1)


def dealt(docs: DataFrame, borders: list[Border], max_n: int) -> DataFrame:
    """PACKED rows of the suffixes of docs (lang, text as binary), by range: the number of borders at or before a suffix."""
    held_borders = docs.sparkSession.sparkContext.broadcast(borders)

    def out(held: Held) -> Iterator[pa.RecordBatch]:
        edges = held_borders.value
        for lang, words, rows, n in held.told():
            key = lang.encode()

            def suffix(i: int) -> Border:
                return (key, *[words[w - 1] if w else b"" for w in rows[i].tolist()])  # noqa: B023  used here only

            low, high = bisect.bisect_right(edges, suffix(0)), bisect.bisect_right(edges, suffix(len(rows) - 1))
            cuts = [0, *[bisect.bisect_left(range(len(rows)), edges[e], key=suffix) for e in range(low, high)], len(rows)]
            made = []
            for e, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False), low):
                if x == y:
                    continue
                used = np.unique(rows[x:y])
                used = used[used > 0]
                small = np.searchsorted(used, rows[x:y]) + (rows[x:y] > 0)
                made.append((e, lang, pack_words([words[u - 1] for u in used.tolist()]), pack(np.diff(small[:, 0], prepend=0)), pack(small[:, 1:].T.ravel()), pack(n[x:y])))
                if len(made) == 64:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), PACKED, strict=True)], schema=PACKED)
                    made = []
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), PACKED, strict=True)], schema=PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(max_n)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.add(text.as_py(), lang)
                if held.size > FLUSH:
                    yield from out(held)
                    held = Held(max_n)
        yield from out(held)

    return docs.select("lang", "text").mapInArrow(run, "range int, lang string, words binary, first binary, rest binary, n binary")


def find_borders(docs: DataFrame, size: int, max_n: int) -> list[Border]:
    """Borders of ranges of about equal weight, from a sample of the texts that is bounded in bytes, but for its last text."""
    parts = min(RANGES, max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE))
    share = min(1.0, SAMPLE / max(1, size))
    step = max(1, int(share * size / 8 / (PER_BORDER * parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = 0
        for b in batches:
            found = []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                some = tokens(text)
                for i in range(step - 1 - passed % step, len(some), step):
                    suffix = [*some[i : i + max_n], MARK]
                    suffix = suffix[: suffix.index(MARK)]
                    if suffix:
                        found.append([lang.encode(), *suffix, *[b""] * (max_n - len(suffix))])
                passed += len(some)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.binary()))], names=["suffix"])

    rows = docs.where(F.rand(7) < share).select("lang", "text").mapInArrow(run, "suffix array<binary>").collect()
    found = sorted(tuple(bytes(x) for x in r["suffix"]) for r in rows)
    return sorted({found[len(found) * k // parts] for k in range(1, parts)}) if found else []


def counted(t: pa.Table, lo: Border | None, hi: Border | None, max_n: int, least: int) -> tuple[list, list, list, list]:
    """lang, phrase, size, f of the prefixes of a range's suffixes that occur ``least`` times in it or may go on beyond its borders."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    langs: dict[str, list[int]] = {}
    for i, lang in enumerate(t["lang"].to_pylist()):
        langs.setdefault(lang, []).append(i)
    columns = {c: t[c] for c in ("words", "first", "rest", "n")}
    for lang, places in langs.items():
        own = [unpack_words(columns["words"][i].as_py()) for i in places]
        words = sorted(set().union(*own))
        number = dict(zip(words, range(1, len(words) + 1), strict=True))
        parts, counts = [], []
        for some, i in zip(own, places, strict=True):
            order = np.array([0, *map(number.__getitem__, some)], np.int32)
            first = np.cumsum(unpack(columns["first"][i].as_py()))
            rest = unpack(columns["rest"][i].as_py()).reshape(max_n - 1, -1)
            parts.append(order[np.vstack([first, rest])].T)
            counts.append(unpack(columns["n"][i].as_py()))
        rows, n = summed(np.concatenate(parts), np.concatenate(counts), len(words) + 1)
        rows, n = rows[::-1], n[::-1]  # longer suffixes before the prefixes of theirs that end a piece
        key = lang.encode()
        changed = np.ones(len(rows), bool)
        changed[1:] = False
        for k in range(max_n + 1):
            # the prefix of k words on the stack is closed where one of its words changes; at k = 0 only at the end
            if k:
                changed[1:] |= rows[1:, k - 1] != rows[:-1, k - 1]
            starts = np.flatnonzero(changed)
            f = np.add.reduceat(n, starts)
            open_ = np.zeros(len(starts), bool)
            for border in (lo, hi) if 0 < k < max_n else ():
                if border and border[0] == key:
                    open_ |= (rows[starts, :k] == [number.get(w, -1) for w in border[1 : k + 1]]).all(axis=1)
            told = np.flatnonzero(((f >= least) | open_) & (rows[starts, k - 1] > 0)) if k else np.arange(1)
            for j in told.tolist():
                out[0].append(lang)
                out[1].append(b" ".join([words[w - 1] for w in rows[starts[j], :k].tolist()]).decode())
                out[2].append(k)
                out[3].append(int(f[j]))
    return out


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> DataFrame:
    """lang, phrase, size, f: the phrases of up to max_n words that occur ``least`` times or more in a language, and for size 0 the number of its words."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.where("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    borders = find_borders(texts, size, max_n)
    edges = spark.sparkContext.broadcast(borders)

    def run(t: pa.Table) -> pa.Table:
        r = t["range"][0].as_py()
        lo, hi = edges.value[r - 1] if r else None, edges.value[r] if r < len(edges.value) else None
        lang, phrase, k, f = counted(t, lo, hi, max_n, least)
        return pa.table([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(k, pa.int32()), pa.array(f, pa.int64())], names=["lang", "phrase", "size", "f"])

    told = dealt(texts, borders, max_n).groupBy("range").applyInArrow(run, "lang string, phrase string, size int, f long")
    return told.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where((F.col("size") == 0) | (F.col("f") >= least))


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, most: int = MOST_RANKS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: per language the first ``most`` candidates of 2 to max_n words."""
    counts = materialize(phrase_counts(docs, max_n, least), "phrase-counts")
    candidates = counts.where("size > 1").withColumnRenamed("f", "a")
    words = "split(phrase, ' ')"
    cut = candidates.withColumn("k", F.explode(F.expr("sequence(1, size - 1)"))).withColumns({"left": F.expr(f"array_join(slice({words}, 1, k), ' ')"), "right": F.expr(f"array_join(slice({words}, k + 1, size), ' ')")})
    part = counts.where("size > 0").select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    cut = cut.join(part, ["lang", "left"]).join(part.select("lang", F.col("left").alias("right"), F.col("l").alias("r")), ["lang", "right"])
    big = {c: F.col(c).cast("decimal(15,0)") for c in "alr"}
    score = (F.lit(1_000_000).cast("decimal(7,0)") * (big["a"] * big["a"]), big["l"] * big["r"])
    cut = cut.withColumn("__over", score[0]).withColumn("__under", score[1]).withColumn("score", F.expr("__over div __under"))
    scored = cut.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = candidates.where("size > 2").withColumn("m", F.explode(F.expr("sequence(2, size - 1)"))).withColumn("at", F.explode(F.expr("sequence(1, size - m + 1)")))
    inside = inside.select("lang", F.expr(f"array_join(slice({words}, at, m), ' ')").alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    stays = scored.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < COVER * F.col("a")))
    best = stays.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    # the first ones of small parts of a language, then of larger ones, then of all: no task sorts more than 64 times ``most`` rows but at first
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = best
    for parts in (4096, 64, 1):
        within = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        ranked = ranked.withColumn("rank", F.row_number().over(within).cast("long")).where(F.col("rank") <= most)
    total = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))
