"""Operator 10, LM scoring: context-tree weighting.

A text is read as tokens (words between ASCII white space, A-Z lower-cased, then one end), a token
as its bytes and a closing blank (the end: one line feed). Each byte is eight binary
decisions, most significant bit first; every decision node has a context tree over the DEPTH bytes before it in the
text so coded, over the borders of tokens (before the text all bytes count as blanks). Each node of a tree holds a
Krichevsky-Trofimov estimate, and P_w(s) = 1/2 P_e(s) + 1/2 prod P_w(children of s) mixes all depths. Scoring uses the
trees as learned: at each bit the estimates along the context path are mixed by the posterior of stopping there. The
score is the sum of log10 probabilities; per byte it is a code length (``bits_per_byte``).

Scale: every n-gram and every word of the corpus is counted and kept. Texts are dealt into blocks of about BLOCK bytes by their place in
the input. Each task packs the distinct n-grams of a block with their counts into one row for each bucket, and its words likewise; a bucket
of n-grams has whole subtrees (all n-grams whose last ROOT context bytes are the same), so it grows them alone. What
the trees above need, sums for at most 256^(ROOT - 1) contexts, goes to the driver and is broadcast. Then the buckets answer for all
n-grams and words that any block has asked for, and the answers meet the texts block by block. A task holds a block, or a bucket and at least one subtree;
buckets are as many as the input needs, and each block asks for an n-gram or word once or a few times, however often it occurs.

Defined results: a null text is an empty one (its end alone); a null doc_id is neither held out nor learned from; rows
repeat as they repeat; without training rows N = 0 and V = 0 and every bit costs one bit; texts of any length are read whole (one longer than a block is a block of
its own); other columns are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bound_batches, id_bucket, materialize, table

DEPTH = 6
ROOT = 3
END = b"\n"
BLOCK = 32 << 20
#: Bytes coded at once, and n-grams and words of a block held before they are told.
AT_ONCE, HELD, HELD_WORDS = 1 << 20, 1 << 22, 1_000_000
GRAMS, WORDS = 0, 1


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def stream_of(words: list[bytes]) -> bytes:
    """What is coded of a text; it begins after blanks."""
    return b" ".join([*words, END])


def streams_of(text: str | None) -> list[bytes]:
    return [stream_of(words_of(text))]


def coded(streams: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with its context as one number (last byte lowest), and the stream it is of."""
    data = b"".join([b" " * depth + x for x in streams])
    a = np.frombuffer(data, np.uint8).astype(np.int64)
    sizes = np.array([len(x) for x in streams], np.int64)
    # runs of 1, 2, 4, ... bytes that end at each place (fewer at the very start, where only blanks are), put together by the bits of depth + 1
    code, have, run, width = np.zeros_like(a), 0, a, 1
    while have <= depth:
        if (depth + 1) & width:
            code[have:] |= run[: len(a) - have] << 8 * have
            have += width
        longer = run.copy()
        longer[width:] |= run[:-width] << 8 * width
        run, width = longer, 2 * width
    inside = np.ones(len(a), bool)
    starts = np.cumsum(sizes + depth) - sizes
    inside[(starts[:, None] - np.arange(1, depth + 1)).ravel()] = False
    return code[inside], np.repeat(np.arange(len(streams)), sizes)


def grams(words: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    return coded([w if w == END else w + b" " for w in words], depth)


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def expand(x: bytes) -> bytes:
    return pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers, byte by byte."""
    return squeeze(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(expand(x), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def turned(code: np.ndarray, depth: int, root: int) -> np.ndarray:
    """n-grams with the last ``root`` context bytes in front of the others, so that a subtree's are neighbours in order."""
    low, rest = (1 << 8 * root) - 1, 8 * (depth - root)
    return ((code >> 8 & low) << rest | code >> 8 + 8 * root) << 8 | code & 255


def turned_back(x: np.ndarray, depth: int, root: int) -> np.ndarray:
    return turned(x, depth, depth - root)


def pack_grams(code: np.ndarray, depth: int, root: int) -> tuple[bytes, np.ndarray]:
    """The n-grams in turned order, as differences, and that order."""
    x = turned(code, depth, root)
    order = np.argsort(x)
    return pack(np.diff(x[order], prepend=0)), order


def unpack_grams(x: bytes, depth: int, root: int) -> np.ndarray:
    return turned_back(np.cumsum(unpack(x)), depth, root)


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams, sorted, with the sums of their counts."""
    code, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first], np.add.reduceat(n, first) if len(first) else n


def bucket_of(code: np.ndarray, buckets: int, root: int) -> np.ndarray:
    context = (code >> 8 & ((1 << 8 * root) - 1)).astype(np.uint64)
    return ((context * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)


def unpack_words(x: bytes) -> list[bytes]:
    return expand(x).split(b" ")


REQUEST = "kind int, bucket int, block long, items binary, n binary, total long"


def ask(docs: DataFrame, depth: int, buckets: int) -> DataFrame:
    """The n-grams and words in the texts of a block, how often they are in those learned from (packed), and their sum. docs: text, learn, block."""
    root = min(ROOT, depth)
    arrow = to_arrow_schema(T._parse_datatype_string(REQUEST))

    def run(batches):
        block, parts, texts, size = None, [], ([], []), 0
        learned: Counter = Counter()
        others: set[bytes] = set()

        def rows(kind: int, told: list[tuple]):
            for i in range(0, len(told), 50):
                where, items, n, total = zip(*told[i : i + 50], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([kind] * len(where), where, [block] * len(where), items, n, total), arrow, strict=True)], schema=arrow)

        def count():
            for learn in (0, 1):
                if texts[learn]:
                    kinds, n = np.unique(coded(texts[learn], depth)[0], return_counts=True)
                    parts.append((kinds, n * learn))
                    texts[learn].clear()
            if sum(len(x) for x, _ in parts) > HELD:
                parts[:] = [added(parts)]

        def grams_out():
            count()
            if not parts:
                return
            code, n = added(parts)
            parts.clear()
            where = bucket_of(code, buckets, root)
            order = np.argsort(where, kind="stable")
            code, n, where = code[order], n[order], where[order]
            cuts = [*np.flatnonzero(np.diff(where, prepend=-1.0)), len(where)]
            told = []
            for x, y in zip(cuts, cuts[1:], strict=False):
                items, order = pack_grams(code[x:y], depth, root)
                told.append((int(where[x]), items, pack(n[x:y][order]), 0))
            yield from rows(GRAMS, told)

        def words_out():
            dealt: list[list[bytes]] = [[] for _ in range(buckets)]
            for some in (learned, others - learned.keys()):
                for w in some:
                    dealt[zlib.crc32(w) % buckets].append(w)
            dealt = [sorted(some) for some in dealt]
            n = [[learned[w] for w in some] for some in dealt]
            yield from rows(WORDS, [(k, squeeze(b" ".join(some)), pack(np.array(c)), sum(c)) for k, (some, c) in enumerate(zip(dealt, n, strict=True)) if some])
            learned.clear()
            others.clear()

        for b in batches:
            for t, learn, at in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if at != block or sum(len(x) for x, _ in parts) > HELD:
                    yield from grams_out()
                if at != block or len(learned) + len(others) > HELD_WORDS:
                    yield from words_out()
                block = at
                words = words_of(t.as_py())
                (learned if learn else others).update(words)
                x = stream_of(words)
                texts[bool(learn)].append(x)
                size += len(x)
                if size > AT_ONCE:
                    count()
                    size = 0
        yield from grams_out()
        yield from words_out()

    return docs.select("text", "learn", "block").mapInArrow(run, REQUEST)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    x = np.asarray(x, float)
    low = sum(np.log(x + k) for k in range(8))
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) - low


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - math.log(math.pi)


def closed(key: np.ndarray, a: np.ndarray, b: np.ndarray, split: np.ndarray | None) -> dict:
    """Nodes with their counts, weighted with the sum of log P_w of their children (none at the full depth)."""
    estimate = log_kt(a, b)
    here = {"key": key, "a": a, "b": b, "p": (b + 0.5) / (a + b + 1)}
    if split is None:
        return here | {"stop": np.ones(len(key)), "log_pw": estimate}
    log_pw = np.logaddexp(estimate, split) - math.log(2)
    return here | {"stop": np.exp(estimate - math.log(2) - log_pw), "log_pw": log_pw}


def above(below: dict, depth: int) -> list[np.ndarray]:
    """key, a, b and the children's sum of log P_w of the nodes at ``depth`` over those one deeper."""
    key, at = np.unique((below["key"] >> 8 & ((1 << 8 * depth) - 1)) << 8 | below["key"] & 255, return_inverse=True)
    return [key, *[np.bincount(at, weights=below[k], minlength=len(key)).astype(float) for k in ("a", "b", "log_pw")]]


def climb(code: np.ndarray, n: np.ndarray, depth: int, root: int) -> list[dict]:
    """The weighted trees from depth ``root`` down to ``depth``. Keys are context << 8 | decision node."""
    keys, ones, zeros = [], [], []
    code, n = code[n > 0], n[n > 0]
    for i in range(8):
        byte = code & 255
        keys.append(code >> 8 << 8 | (1 << i | byte >> (8 - i)))
        bit = (byte >> (7 - i)) & 1
        ones.append(n * bit)
        zeros.append(n * (1 - bit))
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    levels = [closed(key, *[np.bincount(at, weights=np.concatenate(x).astype(float), minlength=len(key)).astype(float) for x in (zeros, ones)], None)]
    for d in range(depth - 1, root - 1, -1):
        levels.insert(0, closed(*above(levels[0], d)))
    return levels


def slim(levels: list[dict]) -> list[dict]:
    return [{"key": x["key"], "p": x["p"].astype(np.float32), "stop": x["stop"].astype(np.float32)} for x in levels]


def grow(kept: list[tuple[np.ndarray, np.ndarray]]) -> list[dict]:
    """All trees in one place from the n-grams at each depth, of which the deepest have all counts."""
    return slim(climb(*kept[-1], len(kept) - 1, 0))


def subtrees(code: np.ndarray, n: np.ndarray, depth: int, root: int, most: int = 1 << 19):
    """Some n-grams with their trees at a time: about ``most``, but all with the same last ``root`` context bytes together."""
    context = code >> 8 & ((1 << 8 * root) - 1)
    order = np.argsort(context, kind="stable")
    cuts = [*np.flatnonzero(np.diff(context[order], prepend=-1)), len(order)]
    start = 0
    for x, y in zip(cuts, [*cuts[1:], cuts[-1]], strict=True):
        if x > start and (y - start > most or x == len(order)):
            some = order[start:x]
            yield some, climb(code[some], n[some], depth, root)
            start = x


def gram_log10(levels: list[dict], code: np.ndarray) -> np.ndarray:
    """log10 P(byte | context) for each n-gram."""
    total = np.zeros(len(code))
    byte = code & 255
    top = len(levels) - 1
    for i in range(8):
        node, bit = 1 << i | byte >> (8 - i), (byte >> (7 - i)) & 1
        p = np.full(len(code), 0.5)
        for d in range(top, -1, -1):
            level = levels[d]
            if not len(level["key"]):
                continue
            key = (code >> 8 & ((1 << 8 * d) - 1)) << 8 | node
            at = np.minimum(np.searchsorted(level["key"], key), len(level["key"]) - 1)
            found = level["key"][at] == key
            if d == top:
                p = np.where(found, level["p"][at], -1.0)
            else:
                deeper = np.where(p >= 0, p, 0.5)
                stop = level["stop"][at]
                p = np.where(found, stop * level["p"][at] + (1 - stop) * deeper, -1.0)
        p = np.where(p >= 0, p, 0.5)
        total += np.log10(np.where(bit == 1, p, 1 - p))
    return total


def score_words(levels: list[dict], words: list[bytes], depth: int) -> np.ndarray:
    code, of = grams(words, depth)
    kinds, back = np.unique(code, return_inverse=True)
    return np.bincount(of, weights=gram_log10(levels, kinds)[back], minlength=len(words))


def merged(t: pa.Table) -> tuple[list[list[bytes]], dict[bytes, int]]:
    """The words that each row of a bucket asks for, and the counts of all."""
    asked, known = [], {}
    get = known.get
    for x, y in zip(t["items"], t["n"], strict=True):
        words = unpack_words(x.as_py())
        for w, n in zip(words, unpack(y.as_py()).tolist(), strict=True):
            known[w] = get(w, 0) + n
        asked.append(words)
    return asked, known


def top_trees(requests: DataFrame, depth: int) -> tuple[list[dict], int]:
    """The trees above depth ROOT, and the number of distinct words that were learned."""
    root = min(ROOT, depth)

    def run(t: pa.Table) -> pa.Table:
        if t["kind"][0].as_py() == WORDS:
            return pa.table({"key": [-1], "a": [float(sum(n > 0 for n in merged(t)[1].values()))], "b": [0.0], "split": [0.0]})
        code, n = added([(unpack_grams(x, depth, root), unpack(y)) for x, y in zip(t["items"].to_pylist(), t["n"].to_pylist(), strict=True)])
        found = [above(levels[0], root - 1) for _, levels in subtrees(code, n, depth, root)]
        return pa.table({k: np.concatenate(x) for k, x in zip(("key", "a", "b", "split"), zip(*found, strict=True), strict=True)})

    sums = requests.groupBy("kind", "bucket").applyInArrow(run, "key long, a double, b double, split double").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("split").alias("split")).toPandas().sort_values("key")
    distinct = int(sums["a"][sums["key"] < 0].sum())
    sums = sums[sums["key"] >= 0]
    levels = [closed(*[sums[k].to_numpy(t) for k, t in (("key", np.int64), ("a", float), ("b", float), ("split", float))])]
    for d in range(root - 2, -1, -1):
        levels.insert(0, closed(*above(levels[0], d)))
    return slim(levels), distinct


def answers(requests: DataFrame, trees: list[dict], depth: int) -> DataFrame:
    """kind, block, items, found: log10 P(byte | context) of all n-grams of the blocks (32-bit floats), and the counts of all words, packed."""
    root = min(ROOT, depth)
    held = requests.sparkSession.sparkContext.broadcast(trees)

    def run(t: pa.Table) -> pa.Table:
        if t["kind"][0].as_py() == WORDS:
            asked, known = merged(t)
            found = [pack(np.fromiter(map(known.__getitem__, words), np.int64, len(words))) for words in asked]
        else:
            asked = [unpack_grams(x, depth, root) for x in t["items"].to_pylist()]
            code, n = added([(x, unpack(y)) for x, y in zip(asked, t["n"].to_pylist(), strict=True)])
            score = np.zeros(len(code), np.float32)
            for some, levels in subtrees(code, n, depth, root):
                score[some] = gram_log10([*held.value, *slim(levels)], code[some])
            found = [squeeze(score[np.searchsorted(code, x)].view(np.uint8).reshape(-1, 4).T.tobytes()) for x in asked]
        return pa.table([t["kind"], t["block"], t["items"], pa.array(found, pa.binary())], names=["kind", "block", "items", "found"])

    return requests.select("kind", "bucket", "block", "items", "n").groupBy("kind", "bucket").applyInArrow(run, "kind int, block long, items binary, found binary")


def unpack_floats(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(expand(x), np.uint8).reshape(4, -1).T).view(np.float32).ravel()


def packed_texts(texts: DataFrame) -> DataFrame:
    """block, rows: the rows of a block (its other columns, compressed), some at a time."""

    def run(batches):
        for b in batches:
            block = b.column(0).to_numpy()
            cuts = [*np.flatnonzero(np.diff(block, prepend=block[:1] - 1)), len(block)]
            rows = []
            for x, y in zip(cuts, cuts[1:], strict=False):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema(list(b.schema)[1:]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([c.slice(x, y - x) for c in b.columns[1:]], schema=pa.schema(list(b.schema)[1:])))
                rows.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]], pa.int64()), pa.array(rows, pa.binary())], names=["block", "rows"])

    return texts.mapInArrow(run, "block long, rows binary")


def score_texts(docs: DataFrame, keep: list[str], depth: int = DEPTH) -> DataFrame:
    """The columns ``keep`` of docs (text, learn, block) with n_tokens, n_known, train_tokens, base_score, score and n_bytes (of what is coded)."""
    spark = docs.sparkSession
    bound_batches(spark)
    root = min(ROOT, depth)
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if("learn").alias("ends")).first()
    ends = size["ends"]
    requests = materialize(ask(docs, depth, max(64, (size["bytes"] or 0) >> 23)), "ctw-requests")
    trees, distinct = top_trees(requests, depth)
    tokens = (requests.agg(F.sum("total")).first()[0] or 0) + ends
    least = math.log10(tokens + 0.5 * (distinct + (ends > 0) + 1))
    made = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("n_bytes", T.LongType())]
    texts = docs.select("block", "text", *[F.col(c).alias(f"__{c}") for c in keep])
    schema = T.StructType([*texts.schema.fields[2:], *[T.StructField(n, t) for n, t in made]])
    arrow = to_arrow_schema(schema)

    def words_known(found: list[tuple]) -> dict[bytes, float]:
        """log10(count + 0.5) of a block's words; above 0 for those that were learned."""
        known: dict[bytes, float] = {}
        for items, n in found:
            known.update(zip(unpack_words(items), np.log10(unpack(n) + 0.5).tolist(), strict=True))
        return known

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        told: dict[int, list[tuple]] = {GRAMS: [], WORDS: []}
        for kind, items, x in zip(found["kind"].to_pylist(), found["items"].to_pylist(), found["found"].to_pylist(), strict=True):
            told[kind].append((items, x))
        code, score = (np.concatenate(x) for x in zip(*[(unpack_grams(x, depth, root), unpack_floats(y)) for x, y in told[GRAMS]], strict=True))
        code, first = np.unique(code, return_index=True)
        score = score[first]
        known = words_known(told[WORDS])

        def sums(streams: list[bytes], n: int) -> np.ndarray:
            asked, stream = coded(streams, depth)
            order = np.argsort(asked)
            asked = asked[order]
            first = np.flatnonzero(np.diff(asked, prepend=-1))
            place = np.searchsorted(code, asked[first])
            assert (code[np.minimum(place, len(code) - 1)] == asked[first]).all(), "an n-gram has no answer"
            return np.bincount(stream[order], weights=np.repeat(score[place].astype(float), np.diff(first, append=len(asked))), minlength=n)

        out = []
        for packed in texts["rows"]:
            rows = pa.ipc.open_stream(packed.as_buffer()).read_all().combine_chunks()
            counts, base, total, some, size = [], [], [], [], 0
            for t in rows["text"]:
                words = words_of(t.as_py())
                each = np.fromiter(map(known.__getitem__, words), float, len(words))
                stream = stream_of(words)
                counts.append((len(words) + 1, int((each > 0).sum()) + (ends > 0), len(stream)))
                base.append(float(each.sum()) + math.log10(ends + 0.5) - (len(words) + 1) * least)
                some.append(stream)
                size += len(stream)
                if size > AT_ONCE:
                    total.append(sums(some, len(some)))
                    some, size = [], 0
            if some:
                total.append(sums(some, len(some)))
            tokens_, known_, bytes_ = np.array(counts, np.int64).T
            out.append(pa.Table.from_arrays([*rows.columns[1:], *[pa.array(x) for x in (tokens_, known_, np.array(base), np.concatenate(total), bytes_)]], schema=arrow))
        return pa.concat_tables(out)

    scored = packed_texts(texts).groupBy("block").cogroup(answers(requests, trees, depth).groupBy("block")).applyInArrow(run, schema)
    return scored.select(*[F.col(f"__{c}").alias(c) for c in keep], "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes")


def op10_ctw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = id_bucket("doc_id", 5)
    read = table(spark, sf_dir, "documents")
    found = read.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    rows = max(1, BLOCK * found["n"] // max(1, found["bytes"] or 0)) if found["n"] else 1
    block = F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / rows))
    docs = read.select("doc_id", "text", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), F.coalesce(rest != 1, F.lit(False)).alias("learn"), block.alias("block"))
    scored = score_texts(docs, ["doc_id", "held_out"])
    return scored.withColumn("bits_per_byte", F.col("score") * F.lit(-math.log2(10)) / F.col("n_bytes")).drop("n_bytes")
