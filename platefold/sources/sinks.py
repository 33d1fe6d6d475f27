"""Where results go: snapshots, their index, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.report import menu_index


def write_snapshots(items: DataFrame, path: str, fmt: str = "json") -> None:
    """Items by restaurant, one folder for each, so that readers of some restaurants open only theirs."""
    items.repartition("restaurant").write.mode("overwrite").partitionBy("restaurant").format(fmt).save(path)


def write_index(items: DataFrame, path: str, generated_at: str) -> None:
    menu_index(items).withColumn("generated_at", F.lit(generated_at)).write.mode("overwrite").json(path)


def write_cache(items: DataFrame, path: str, saved_at_ms: int) -> None:
    items.withColumn("saved_at", F.lit(saved_at_ms)).write.mode("overwrite").parquet(path)


def write_debug(items: DataFrame, path: str) -> list[str]:
    """Each restaurant's items as JSON in a folder of its own, lower-case name and "_nutrition"; the names of restaurants that could not be written.

    One that fails does not keep the others from being written.
    """
    failed = []
    for name in [r[0] for r in items.select("restaurant").distinct().orderBy("restaurant").collect()]:  # one folder for each source of the registry
        try:
            items.where(F.col("restaurant") == name).write.mode("overwrite").json(f"{path}/{name.lower()}_nutrition")
        except Exception as e:
            print(f"{name} not written: {str(e)[:200]}")
            failed.append(name)
    return failed
