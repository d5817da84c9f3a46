"""Operator 5, quality classifier: ordinal cumulative-link regression.

Graded ratings 0 < 1 < ... < K-1 follow P(grade >= k | x) = sigmoid(w.x - theta_k) with one weight vector w over
hashed text features, shared by all grades, and thresholds theta_1 <= theta_2 <= ... . Out come the expected grade and the tail probabilities;
a document is kept if its tail probability at ``keep_grade`` reaches ``keep_probability``.

Features (binary, hashed): the distinct words of the whole text, and a few measures of form in steps (share of capitals,
digits and punctuation per word, distinct words, ...). An L1 term leaves weight on telling features only,
so long clean texts gather no noise.

The fit takes at most ``max_labelled`` labelled rows (by hash order of the id, a documented bound; so the list of them
may be broadcast); every text is scored whole. Grade of a labelled row: 0 toxic, 1 not toxic but of low quality, 2 not toxic and of
good quality; a row whose labels do not tell its grade (quality missing, or toxic missing) is not learned from.

Defined results: a null text is an empty text; without labelled rows, or with one grade only, all are kept with
expected grade and probabilities null; repeated ids in labels: each rating is learned from; of texts that share an id, one is learned from;
a null id matches nothing; rows repeat as they repeat; texts of any length are read whole, one at a time; an empty table gives an empty table; input columns named like
an output column (in any case) are replaced, unless ``names`` gives the output columns other names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, table

BITS = 18
TOKEN = re.compile(r"\w+")
GRADES = 3
#: Entries of the sample that the fit has in work at once.
CHUNK = 250_000


def steps(value: float, edges: tuple) -> int:
    return sum(value >= e for e in edges)


def form(text: str, words: list[str], distinct: int) -> list[str]:
    """Measures of form as named steps; names start with a blank, which no word does."""
    n, chars = max(1, len(words)), max(1, len(text))
    parts = text.split()
    p = max(1, len(parts))
    upper = sum(map(str.isupper, parts)) / p
    bare = sum(not x.isalnum() for x in parts) / p
    odd = sum(map(text.count, "#&*%$|!<>{}=@_~^")) / p
    digits = sum(map(text.count, "0123456789")) / chars
    lines = text.split("\n")
    again = 1 - len(set(lines)) / len(lines)
    top = Counter(words).most_common(1)[0][1] / n if words else 0
    return [
        f" upper{steps(upper, (0.02, 0.1, 0.3, 0.6))}", f" odd{steps(odd, (0.002, 0.01, 0.05, 0.2, 0.5, 0.8))}", f" bare{steps(bare, (0.1, 0.2, 0.35, 0.6))}",
        f" digits{steps(digits, (0.01, 0.05, 0.2))}", f" again{steps(again, (0.05, 0.2, 0.5))}", f" top{steps(top, (0.1, 0.15, 0.25, 0.5))}",
        f" kinds{steps(distinct / n, (0.05, 0.15, 0.3, 0.5, 0.8))}", f" size{steps(n, (1, 5, 20, 100, 1000))}",
    ]


def slot(word: str) -> int:
    return zlib.crc32(word.encode()) >> (32 - BITS)


def features(text: str | None) -> bytes:
    """Slots in ascending order, four bytes each."""
    text = text or ""
    words = TOKEN.findall(text.lower())
    distinct = set(words)
    return np.array(sorted({slot(w) for w in distinct} | {slot(w) for w in form(text, words, len(distinct))}), np.int32).tobytes()


def fit_ordinal(rows: list, grades: list[int], n_grades: int = GRADES, l1: float = 1.0, rounds: int = 300) -> dict | None:
    """Accelerated proximal gradient descent on the cumulative-link likelihood plus l1 * |w|."""
    y = np.array(grades)
    levels = [k for k in range(1, n_grades) if 0 < (y >= k).sum() < len(y)] if len(y) else []
    if not levels:
        return None
    cols = np.concatenate([np.array(r, np.int32) for r in rows])
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    seen, cols = np.unique(cols, return_inverse=True)
    cols, at = cols.astype(np.int32), at.astype(np.int32)
    spans = [slice(i, i + CHUNK) for i in range(0, len(cols), CHUNK)]
    often = np.bincount(cols)
    scale = 1 / np.sqrt(np.maximum(1, often / len(rows) * 50))  # common features step less
    theta = np.array([-np.log((y >= k).mean() / (1 - (y >= k).mean())) for k in levels])
    w = np.zeros(len(seen))
    target = np.array([(y >= k) for k in levels], float)
    weight = np.array([0.5 / max(1, (y == g).sum()) for g in range(n_grades)])[y]
    weight = weight * len(y) / weight.sum()
    weight = np.sqrt(weight)  # rare grades count more, yet calibration is kept near

    def slope(w, theta):
        v, eta, along = w * scale, np.zeros(len(rows)), np.zeros(len(seen))
        for s in spans:
            eta += np.bincount(at[s], weights=v[cols[s]], minlength=len(rows))
        off = (1 / (1 + np.exp(-np.clip(eta - theta[:, None], -30, 30))) - target) * weight
        each = off.sum(axis=0)
        for s in spans:
            along += np.bincount(cols[s], weights=each[at[s]], minlength=len(seen))
        return along * scale, -off.sum(axis=1)

    step, last_w, last_t, speed = 4.0 / (len(rows) * len(levels)) / 2, w, theta, 1.0
    ahead_w, ahead_t = w, theta
    for _ in range(rounds):
        g_w, g_t = slope(ahead_w, ahead_t)
        w = ahead_w - step * g_w
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        theta = np.maximum.accumulate(ahead_t - step * g_t)
        new = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        ahead_w, ahead_t = w + (speed - 1) / new * (w - last_w), theta + (speed - 1) / new * (theta - last_t)
        last_w, last_t, speed = w, theta, new
    used = w != 0
    return {"weights": dict(zip(seen[used].tolist(), (w * scale)[used].tolist(), strict=True)), "levels": levels, "theta": theta.tolist(), "n_grades": n_grades}


def tails(model: dict, eta: float) -> list[float]:
    """P(grade >= k) for k = 1 .. n_grades - 1; a level that was not seen takes its neighbour's."""
    known = {k: 1 / (1 + np.exp(-np.clip(eta - t, -30, 30))) for k, t in zip(model["levels"], model["theta"], strict=True)}
    return [float(known.get(k, known[min(model["levels"], key=lambda x: (abs(x - k), x))])) for k in range(1, model["n_grades"])]


def train_quality_model(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000) -> dict | None:
    grade = F.when(F.col("toxic") == 1, 0).when((F.col("toxic") == 0) & (F.col("quality") == 0), 1).when((F.col("toxic") == 0) & (F.col("quality") == 1), 2)
    graded = labels.where("doc_id is not null").select("doc_id", grade.alias("grade")).where("grade is not null")
    some = graded.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(max_labelled)
    texts = docs.select("doc_id", "text").join(F.broadcast(some.select("doc_id").distinct()), "doc_id")
    made = append_columns(texts, ["text"], [T.StructField("slots", T.BinaryType())], lambda: lambda t: [[features(x) for x in t.to_pylist()]])
    one = made.groupBy("doc_id").agg(F.min("slots").alias("slots"))  # of texts that share an id, one
    rows = one.join(some, "doc_id").select("slots", "grade").collect()
    rows.sort(key=lambda r: (r["grade"], r["slots"]))
    return fit_ordinal([np.frombuffer(r["slots"], np.int32) for r in rows], [r["grade"] for r in rows])


NAMES = ("expected_grade", "tail_probabilities", "kept")


def score_quality(docs: DataFrame, model: dict | None, keep_grade: int = 2, keep_probability: float = 0.5, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """docs with expected_grade, tail_probabilities (of grade >= 1, 2, ...) and kept, or the names given for them."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = held.value
        weights = m["weights"] if m else {}
        cache: dict[str, float] = {}

        def score(text: str | None) -> list[float]:
            text = text or ""
            words = TOKEN.findall(text.lower())
            distinct = set(words)
            if len(cache) > 300_000:
                cache.clear()
            hit = {}
            for w in [*distinct, *form(text, words, len(distinct))]:
                s = cache.get(w)
                if s is None:
                    k = slot(w)
                    s = cache[w] = k if k in weights else -1
                if s >= 0:
                    hit[s] = weights[s]
            return tails(m, sum(hit[k] for k in sorted(hit)))

        def run(texts):
            if not m:
                n = len(texts)
                return [[None] * n, [None] * n, [True] * n]
            rows = [score(t.as_py()) for t in texts]
            return [pa.array([sum(r) for r in rows], pa.float64()), rows, [r[keep_grade - 1] >= keep_probability for r in rows]]

        return run

    return append_columns(docs, ["text"], [T.StructField(n, t) for n, t in zip(names, (T.DoubleType(), T.ArrayType(T.DoubleType()), T.BooleanType()), strict=True)], make)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality_model(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).selectExpr("doc_id", "expected_grade", "tail_probabilities[0] p_grade_1", "tail_probabilities[1] p_grade_2", "kept")
