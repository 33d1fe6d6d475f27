"""Cutting a plan in two: a frame is computed once, in the folder of spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """``df``, written once to the shared checkpoint folder and read back (a folder of our own only in local mode, where none is set)."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if base is None:
        base = f"file://{tempfile.mkdtemp(prefix='platefold-')}"
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/platefold-settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each computed once for a row: an explode of one entry keeps them from being put into the lambdas that read them."""
    step = next(n for n in (f"_step{'_' * k}" for k in range(len(df.columns) + 1)) if n not in df.columns)
    entry = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias(step)
    return df.select("*", entry).withColumns({n: F.col(f"{step}.{n}") for n in columns}).drop(step)


def placed(df: DataFrame, order: list, out: str = "place") -> DataFrame:
    """``df`` with ``out``, each row's place in ``order`` over the whole frame, from 1.

    One range sort; rows are counted in their own partitions, and only the counts, one for each
    partition, are summed up.  Ties of all columns of ``order`` come in any order.
    """
    id_, part = (next(n for n in (f"{base}{'_' * k}" for k in range(len(df.columns) + 1)) if n not in df.columns) for base in ("_id", "_part"))
    rows = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(id_, F.monotonically_increasing_id()))
    rows = rows.withColumn(part, F.shiftright(id_, 33))
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.alias("a").join(counts.alias("b"), F.col(f"b.{part}") < F.col(f"a.{part}"), "left").groupBy(F.col(f"a.{part}").alias(part)).agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    both = rows.join(before, part)
    return both.withColumn(out, F.col("_before") + F.col(id_).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop(id_, part, "_before")
