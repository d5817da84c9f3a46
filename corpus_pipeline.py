"""A training-data pipeline over ``documents``: quality, near-duplicates, personal data, mix, pieces.

Every stage takes (spark, docs, sf_dir), works on all rows of its predecessor and returns the columns of documents with their own values, further
ones included (names that begin with two underscores are the stages' own); the last one adds piece_ids and n_pieces. An empty table gives an empty table. Stages are written as Parquet and reread, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm import op03_mixing, op04_pii, op05_quality, op07_pieces, op08_minhash
from corvine.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade reaches one half. A null text is an empty text; each row is judged by its own text;
    without labels to learn from all stay."""
    model = op05_quality.train_quality_model(docs, table(spark, sf_dir, "labels"))
    return op05_quality.score_quality(docs, model, names=("__grade", "__tails", "__kept")).where("__kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, 0.8), one with its smallest id. Rows are judged by their own texts, so a copy goes even if
    its id has another text too. Rows without an id and rows without a word stay."""
    return op08_minhash.without_copies(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the name of their kind; n_chars follows the text. A null text stays null, with its n_chars null; rows repeat as they repeat."""
    return op04_pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated as the sources' targets ask. Rows without a word have no size and are never taken; a null source is a source."""
    return op03_mixing.mix_rows(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With piece_ids and n_pieces (columns of these names give way). A null text has null ids, an empty one none."""
    return op07_pieces.encode_pieces(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", mix),
    ("pieces", pieces),
]

#: The classifier and the piece codes are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
