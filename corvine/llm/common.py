"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Words are maximal runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space as bytes, for split() on encoded text.
SPACE_BYTES = bytes([32, 9, 10, 11, 12, 13])

#: Rows of an Arrow batch between the JVM and Python at most, and rows whose values are Python objects at once.
BATCH_ROWS, ROWS_AT_ONCE = 1000, 256


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small in this session; both sides hold a few of them for each task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/corvine-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there and a lost
    executor costs only a reread. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    WRITTEN[out] = (files, where)
    return out


#: Where the tables that materialize() returned lie.
WRITTEN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def release(written: DataFrame) -> None:
    """Delete the files of a table that materialize() returned, once nothing is to be read from it again."""
    files, where = WRITTEN.pop(written)
    files.delete(where, True)


def id_bucket(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % modulus


def word_count(text: Column) -> Column:
    """Words in a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def append_columns(df: DataFrame, inputs: list[str], fields: list[T.StructField], make: Callable) -> DataFrame:
    """df and new columns made batch by batch from Arrow arrays: make() is called once per partition
    and returns the function from input arrays to output arrays. A column of df whose name
    one of the new ones takes (in any case) is replaced."""
    bound_batches(df.sparkSession)
    taken = {f.name.lower() for f in fields}
    both = [c for c in df.columns if c.lower() in taken]
    work = df
    hidden = {}
    for c in both:
        if c in inputs:
            hidden[c] = f"__in_{c}"
            work = work.withColumnRenamed(c, hidden[c])
        else:
            work = work.drop(c)
    kept = [f for f in work.schema.fields if f.name not in hidden.values()]
    schema = T.StructType(kept + fields)
    arrow = to_arrow_schema(schema)
    names = [f.name for f in kept]
    reads = [hidden.get(c, c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            made = fn(*[b.column(b.schema.get_field_index(c)) for c in reads])
            old = [b.column(b.schema.get_field_index(c)) for c in names]
            made = [a if isinstance(a, pa.Array) else pa.array(a, type=arrow.field(len(old) + i).type) for i, a in enumerate(made)]
            yield pa.RecordBatch.from_arrays([*old, *made], schema=arrow)

    return work.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for every node on an edge (a, b)."""
    both = materialize(edges.unionByName(edges.selectExpr("b a", "a b")).where("a <> b").distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        told = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("told"))
        nearer = labels.join(told, labels["node"] == told["a"]).select("node", F.col("label").alias("was"), F.least("label", "told").alias("label"))
        jump = labels.select(F.col("node").alias("__at"), F.col("label").alias("__next"))
        new = nearer.join(jump, nearer["label"] == jump["__at"], "left").select("node", "was", F.least("label", "__next").alias("label"))
        new = materialize(new, "labels")
        release(labels)
        labels = new
        if new.where("label <> was").isEmpty():
            release(both)
            return labels.select("node", "label")
