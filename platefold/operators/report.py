"""Indexes, counts and the printed report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..macros import MACROS, Target


def menu_index(items: DataFrame) -> DataFrame:
    """(restaurant, item_count, base_items, categories): one row for each restaurant with items."""
    return items.groupBy("restaurant").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.count_distinct("name").alias("names"),
        F.array_sort(F.collect_set("category")).alias("categories"),
    )


def base_item_count(items: DataFrame) -> DataFrame:
    """Plain items and groups of variants."""
    return items.groupBy("restaurant").agg((F.count_if(F.col("variant_of").isNull()) + F.count_distinct("variant_of")).alias("base_items"))


def by_category(items: DataFrame) -> DataFrame:
    """(restaurant, category, n, names): items grouped by category, those without one under Other."""
    return items.groupBy("restaurant", F.coalesce("category", F.lit("Other")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"))


def with_dietary_data(items: DataFrame) -> DataFrame:
    return items.groupBy("restaurant").agg(F.bool_or(F.col("dietary").isNotNull()).alias("has_dietary"))


def report(combos: DataFrame, target: Target) -> DataFrame:
    """One line per meal: totals with signed differences, bands and the match in per cent, best restaurants first."""
    signed = {m: F.format_string("%s%d", F.when(F.col(m) >= target[m], "+").otherwise(""), F.floor(F.col(m) - target[m] + 0.5)) for m in MACROS}
    best = F.expr("min(avg_accuracy) over (partition by restaurant)")
    return combos.select(
        "restaurant",
        "rank",
        *(F.concat(F.floor(F.col(m) + 0.5).cast("string"), F.lit(" ("), signed[m], F.lit(")")).alias(m) for m in MACROS),
        *(exprs.accuracy_band(F.col(f"{m}_off")).alias(f"{m}_band") for m in MACROS),
        exprs.accuracy_percent(F.col("avg_accuracy")).alias("match"),
        best.alias("best"),
    )


LOCALE = "UNICODE"


def locale_place(text: str, keys: list[str], collation: str = LOCALE) -> Column:
    """A row's place among its ``keys`` in the order of a locale's collation, from 1; by bytes where it sees no difference."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return F.row_number().over(w.orderBy(F.collate(F.col(text), collation), text))


def items_by_category(items: DataFrame, search: str = "") -> DataFrame:
    """(restaurant, category, place, n, names): a restaurant's items whose name contains ``search``, by category in locale order.

    Items without a category are under Other; names are in the menu's order.
    """
    kept = items.where(F.contains(F.lower("name"), F.lit(search.strip().lower())))
    listed = kept.groupBy("restaurant", F.coalesce("category", F.lit("Other")).alias("category")).agg(F.transform(F.array_sort(F.collect_list(F.struct("item_seq", "name"))), lambda x: x["name"]).alias("names"))
    return listed.select("restaurant", "category", locale_place("category", ["restaurant"]).alias("place"), F.size("names").alias("n"), "names")


def outcome_counts(rows: DataFrame, keys: list[str], outcomes: list[str], status: str = "status") -> DataFrame:
    """(keys, one count for each outcome, other): what became of the rows, in one aggregation."""
    counts = [F.count_if(F.col(status) == o).alias(o) for o in outcomes]
    return rows.groupBy(*keys).agg(*counts, F.count_if(~F.coalesce(F.col(status).isin(*outcomes), F.lit(False))).alias("other"))
