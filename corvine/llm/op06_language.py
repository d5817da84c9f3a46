"""Operator 6, language ID: string-kernel classification.

Blended-spectrum presence kernel: a text is the set of its byte n-grams of length 1 to 3 (lower-cased, UTF-8, over the
whole text, told apart exactly), and k(x, y) = |x & y| / sqrt(|x| |y|). Nystroem: some training texts, the landmarks, span the
feature space; kernel ridge regression, one language against the rest, is solved
there once. Texts are scored in blocks by two matrix products: presence rows by landmark rows, then
kernel rows by the regression weights. Columns are the n-grams that some landmark has, as no others can be shared with one.

The fit takes at most ``max_train`` labelled rows in all (per language an equal share and at least one, by hash order; equal rows count
once) and ``landmarks`` of them, at least one per language however many there are. Landmarks travel to the driver as their n-gram sets, training rows as
one kernel value for each landmark. Everything else covers all rows. What a task holds is one text, the landmarks, and a block of presence rows.

Defined results: a null text or one without a letter (Unicode category L) is ``und`` with score 0; so is every text where no labelled row
exists to learn from. A null doc_id is never held out, and its row is not learned from. Ties between languages go to the first in
code-point order. Rows repeat as they repeat; texts of any length are read whole; input columns named like an output column are
replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, id_bucket, materialize, table

#: Cells of a block of presence rows.
CELLS = 1 << 22
#: One rate per language is sent to all tasks up to this number of languages; beyond it they are joined.
BROADCAST_ROWS = 100_000


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """The distinct n-grams of a text as ascending numbers: bytes, then pairs, then triples."""
    a = np.frombuffer(text.lower().encode(), np.uint8).astype(np.int32)
    pairs = a[:-1] << 8 | a[1:]
    triples = pairs[:-1] << 8 | a[2:]
    return np.concatenate([np.unique(a), (1 << 8) + np.unique(pairs), (1 << 8) + (1 << 16) + np.unique(triples)])


def marks_of(sets: list[np.ndarray]) -> dict:
    """The landmarks: their n-grams as columns, and a 0/1 row for each."""
    columns = np.unique(np.concatenate(sets))
    rows = np.zeros((len(sets), len(columns)), np.uint8)
    for row, s in zip(rows, sets, strict=True):
        row[np.searchsorted(columns, s)] = 1
    return {"columns": columns, "rows": rows}


class Kernel:
    """k(text, landmark) for texts in blocks."""

    def __init__(self, marks: dict):
        self.columns = marks["columns"]
        self.rows = marks["rows"].astype(np.float32)
        self.sizes = self.rows.sum(axis=1)
        self.block = max(1, CELLS // len(self.columns))

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.rows)), np.float32)
        for i in range(0, len(texts), self.block):
            some = texts[i : i + self.block]
            x, size = np.zeros((len(some), len(self.columns)), np.float32), np.ones(len(some))
            for k, t in enumerate(some):
                s = grams(t)
                at = np.minimum(np.searchsorted(self.columns, s), len(self.columns) - 1)
                x[k, at[self.columns[at] == s]] = 1
                size[k] = max(1, len(s))
            out[i : i + self.block] = x @ self.rows.T / np.sqrt(size[:, None] * self.sizes)
        return out


def fit(square: np.ndarray, rows: np.ndarray, langs: list[str], ridge: float) -> dict:
    """Ridge regression in the landmarks' span. square: landmarks by landmarks; rows: training rows by landmarks."""
    names = sorted(set(langs))
    value, vector = np.linalg.eigh(square.astype(np.float64))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    place = {n: i for i, n in enumerate(names)}
    y = np.array([place[x] for x in langs])
    weight = (len(langs) / (len(names) * np.bincount(y, minlength=len(names))))[y, None]
    phi = np.hstack([rows @ root, np.ones((len(rows), 1))])
    goal = phi.T @ (weight * np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0))
    solved = np.linalg.solve(phi.T @ (weight * phi) + ridge * np.eye(phi.shape[1]), goal)
    return {"names": names, "weights": (root @ solved[:-1]).astype(np.float32), "bias": solved[-1].astype(np.float32)}


def sample(good: DataFrame, max_train: int) -> DataFrame | None:
    """lang, text, place (from 1 on in hash order, per language) of the rows to learn from; None without any."""
    counts = materialize(good.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    n = counts.count()
    if not n:
        return None
    share = max(1, max_train // n)
    # rates leave a margin over the share, so that few rows are sorted; the place makes the bound hold
    rates = counts.select("lang", ((1.3 * share + 50) / F.col("n")).alias("rate"))
    some = good.join(F.broadcast(rates) if n <= BROADCAST_ROWS else rates, "lang").where((F.col("h") / F.lit(2.0**64)) + 0.5 < F.col("rate")).dropDuplicates(["lang", "h"])
    placed = some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("place") <= share)
    return materialize(placed.select("lang", "text", "place"), "language-sample")


def train_language_model(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_train: int = 6000, landmarks: int = 96, ridge: float = 1.0) -> dict | None:
    """Fit on docs, all of whose rows with text and language may be learned from."""
    good = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = sample(good.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("h")), max_train)
    if rows is None:
        return None
    names = rows.select("lang").distinct().count()
    per = max(1, -(-landmarks // names))

    def sets():
        return lambda texts: [pa.array([grams(t).tobytes() for t in texts.to_pylist()], pa.binary())]

    picked = append_columns(rows.where(F.col("place") <= per), ["text"], [T.StructField("grams", T.BinaryType())], sets).select("lang", "place", "grams").collect()
    picked.sort(key=lambda r: (r["place"], r["lang"]))
    marks = marks_of([np.frombuffer(r["grams"], np.int32) for r in picked])
    held = docs.sparkSession.sparkContext.broadcast(marks)

    def values():
        kernel = Kernel(held.value)
        return lambda texts: [pa.array([x.tobytes() for x in kernel(texts.to_pylist())], pa.binary())]

    made = append_columns(rows, ["text"], [T.StructField("row", T.BinaryType())], values).select("lang", "place", "row").collect()
    made.sort(key=lambda r: (r["place"], r["lang"]))
    known = {(r["place"], r["lang"]): np.frombuffer(r["row"], np.float32) for r in made}
    square = np.array([known[r["place"], r["lang"]] for r in picked])
    return {"marks": marks} | fit(square, np.array(list(known.values())), [lang for _, lang in known], ridge)


def identify_language(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1) for every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = held.value
        kernel = Kernel(m["marks"]) if m else None

        def run(texts):
            n = len(texts)
            names, scores = ["und"] * n, np.zeros(n)
            todo = [(i, s) for i in range(n) if texts[i].is_valid and has_letter(s := texts[i].as_py())] if m else []
            if todo:
                margin = kernel([s for _, s in todo]) @ m["weights"] + m["bias"]
                for (i, _), best, top in zip(todo, margin.argmax(axis=1), margin.max(axis=1), strict=True):
                    names[i], scores[i] = m["names"][best], min(1.0, max(0.0, (float(top) + 1) / 2))
            return [names, pa.array(scores)]

        return run

    return append_columns(docs, [text], [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    split = F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False))
    model = train_language_model(docs.where(id_bucket("doc_id", 4) != 2))
    return identify_language(docs.select("doc_id", "text", split.alias("held_out")), model).drop("text")
