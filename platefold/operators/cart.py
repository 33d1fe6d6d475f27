"""The meal cart as a fold over events, and tracked meals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..macros import MACROS


def fold(events: DataFrame) -> DataFrame:
    """(user_id, restaurant, name, qty) after events (user_id, seq, restaurant, name, delta of 1 or -1).

    Adding an item of another restaurant than the cart's clears the cart, so what counts is the
    last run of additions from one restaurant.  Taking away what is not there does nothing: a
    quantity is the running sum since its lowest point below zero.
    """
    w = Window.partitionBy("user_id").orderBy("seq")
    added = events.withColumn("_add", F.when(F.col("delta") > 0, F.col("restaurant")))
    held = F.last("_add", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = added.withColumn("_held", held)
    marked = marked.withColumn("_c", F.coalesce((F.col("_add") != F.col("_held")).cast("int"), F.lit(0)))
    runs = marked.withColumn("_run", F.sum("_c").over(w)).where(F.col("_add").isNotNull() | (F.col("restaurant") == F.col("_held")))
    last = runs.withColumn("_last", F.max("_run").over(Window.partitionBy("user_id"))).where("_run = _last")
    keys = ["user_id", "restaurant", "name"]
    walked = last.withColumn("_s", F.sum("delta").over(Window.partitionBy(*keys).orderBy("seq")))
    return walked.groupBy(*keys).agg((F.sum("delta") - F.least(F.min("_s"), F.lit(0))).alias("qty")).where("qty > 0")


def totals(cart: DataFrame, menu: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, macros, items): sum of quantity times macro, joined on restaurant and name."""
    return cart.join(menu, ["restaurant", "name"]).groupBy(*keys).agg(*(F.sum(F.col(m) * F.col("qty")).alias(m) for m in MACROS), F.sum("qty").alias("items"))


def quantity_by_category(cart: DataFrame, menu: DataFrame) -> DataFrame:
    joined = cart.join(menu.select("restaurant", "name", "category"), ["restaurant", "name"])
    return joined.groupBy("restaurant", F.coalesce("category", F.lit("Other")).alias("category")).agg(F.sum("qty").alias("qty"))


def as_rows(cart: DataFrame) -> DataFrame:
    """One row per piece: (user_id, restaurant, name, piece)."""
    return cart.select("user_id", "restaurant", "name", F.explode(F.sequence(F.lit(1), F.col("qty").cast("int"))).alias("piece"))


def from_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, qty) of the rows (keys, on) that are on: the inverse of :func:`as_rows`."""
    return rows.where("on").groupBy(*keys).agg(F.count(F.lit(1)).alias("qty"))


def switch_off_last(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Rows (keys, seq, on) with the last one that is on switched off in each group."""
    w = Window.partitionBy(*keys, "on").orderBy(F.desc(order))
    return rows.withColumn("on", F.col("on") & (F.row_number().over(w) > 1))


def kept_total(rows: DataFrame, key: str) -> DataFrame:
    return rows.where("on").groupBy(key).agg(*(F.sum(m).alias(m) for m in MACROS), F.count(F.lit(1)).alias("rows"))


def on_composed_menu(rows: DataFrame, bases: DataFrame) -> DataFrame:
    """Rows with ``base``: the first menu item (restaurant, base, ord) whose name and a dash the row's name begins with."""
    names = rows.select("restaurant", "name").distinct()
    hit = names.join(bases, "restaurant").where(F.startswith(F.col("name"), F.concat(F.col("base"), F.lit(" — "))))
    return rows.join(hit.groupBy("restaurant", "name").agg(F.min_by("base", "ord").alias("base")), ["restaurant", "name"], "left")
