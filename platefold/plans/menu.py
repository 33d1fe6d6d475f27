"""The driver's tables read as menus, so that every operator has data and SQL has the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K = "p_partkey"
MENU_EXPRS = {
    "restaurant": "p_brand",
    "item_seq": "p_partkey",
    "name": "p_name",
    "category": f"case when {K} % 11 = 0 then null else p_type end",
    "size": "p_size",
    "calories": f"120 + ({K} * 37) % 700",
    "protein": f"1 + ({K} * 13) % 45",
    "fat": f"({K} * 7) % 35",
    "carbs": f"1 + ({K} * 29) % 80",
}
MENU_SQL = "select " + ", ".join(f"{e} as {n}" for n, e in MENU_EXPRS.items()) + " from part"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(restaurant, item_seq, name, category, size, calories, protein, fat, carbs) from part."""
    return table(spark, sf_dir, "part").select(*(F.expr(e).alias(n) for n, e in MENU_EXPRS.items()))
