"""What the operators of this subpackage share: staging, and tidy input columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, one of our own in local mode (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if base is None:
        base = sc.getCheckpointDir()
    if base is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if base is None:
        base = f"file://{tempfile.mkdtemp(prefix='platefold-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/platefold-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, and a lost
    executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string); a null text counts as empty. Other columns are left out, so
    that none of their names can clash with an operator's own."""
    return df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def slices(batches, rows: int = 500):
    """Arrow batches in pieces, so that a worker holds few texts as Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What runs inside sends at most ``rows`` rows to a Python worker at a time: with whole texts in them, ten thousand would fill its memory and the JVM's buffers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Rows of one key from which it counts as hot, and hot keys at most.
HOT_ROWS, HOT_KEYS = 100, 50_000


def join_hot(left: DataFrame, right: DataFrame, on: list[str], rows: str, how: str = "inner", total: int | None = None, most: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` (one row for each key, both read twice: staged), ``how`` inner or left.

    ``rows`` is a column of ``right``: how many rows of ``left`` have the key.  Hot keys are broadcast,
    so their rows stay where they are; all others are shuffled.  A key is hot from a share of all
    rows (``total``, where it is known) that only HOT_KEYS keys can have, which bounds the broadcast
    at any size.  Where no key has that many rows (``most``, if known) nothing is broadcast: each broadcast
    takes the driver's memory and threads, even of no rows.
    """
    if total is None or most is None:
        total, most = (x or 0 for x in right.agg(F.sum(rows), F.max(rows)).first())
    bound = max(HOT_ROWS, total / HOT_KEYS)
    if most <= bound:
        return left.join(right, on, how)
    hot = right.where(F.col(rows) > bound)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.where(F.col(rows) <= bound), on, how)
    return left.join(F.broadcast(hot), on).select(rest.columns).unionByName(rest)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
