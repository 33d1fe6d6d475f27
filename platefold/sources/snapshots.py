"""Snapshots as the registry lists them: one for each entry, whatever was scanned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..macros import MACROS
from ..operators import normalize, tree

ITEM = "array<struct<item_seq:bigint,name:string,category:string,calories:double,protein:double,fat:double,carbs:double,build:string>>"


def build_rows(formats: DataFrame) -> DataFrame:
    """(key, item_seq, name, category, macros, build): a row for each format (key, ord, format) of which a meal is put together.

    There is no one meal to state, so its macros are 0; its category is the format, which ``build`` refers to.
    """
    return formats.select("key", F.col("ord").cast("long").alias("item_seq"), F.concat("format", F.lit(" (Build Your Own)")).alias("name"), F.col("format").alias("category"), *(F.lit(0.0).alias(m) for m in MACROS), F.col("format").alias("build"))


def listed_snapshots(registry: DataFrame, items: DataFrame, builds: DataFrame, existing: DataFrame, now: str) -> DataFrame:
    """(ord, key, restaurant, updated_at, items, fresh): the registry's entries in its order.

    ``registry`` is (ord, key, restaurant, source, taken_at), ``items`` (key, item_seq, name,
    category, macros), ``builds`` as :func:`build_rows` gives them, which come after the items, ``existing``
    (key, items, updated_at).  A live entry without rows keeps its existing items and their date;
    one that never had any is listed with none, dated now.  A snapshot is dated when it was taken.
    """
    own = items.select("key", F.lit(0).alias("part"), F.struct(F.col("item_seq").cast("long").alias("item_seq"), "name", "category", *(F.col(m).cast("double").alias(m) for m in MACROS), F.lit(None).cast("string").alias("build")).alias("i"))
    more = builds.select("key", F.lit(1).alias("part"), F.struct("item_seq", "name", "category", *MACROS, "build").alias("i"))
    lists = own.unionByName(more).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "i"))), lambda x: x["i"]).alias("_new"))
    before = existing.select("key", F.col("items").alias("_old"), F.col("updated_at").alias("_at"))
    both = registry.join(lists, "key", "left").join(before, "key", "left")
    fresh = F.col("_new").isNotNull()
    keep = ~fresh & (F.col("source") == "live")
    found = F.coalesce(F.when(keep, F.col("_old")).otherwise(F.col("_new")), F.array().cast(ITEM))
    dated = F.when(F.col("source") == "snapshot", F.coalesce("taken_at", F.lit(now))).when(fresh, F.lit(now)).otherwise(F.coalesce("_at", F.lit(now)))
    return both.select("ord", "key", "restaurant", dated.alias("updated_at"), found.alias("items"), fresh.alias("fresh"))


def flat_rows(items: DataFrame, groups: DataFrame, choices: DataFrame, macro: str) -> DataFrame:
    """(restaurant, item_seq, pos, name, category, macros) of items with variants or a ``build``, one row for each that can be ordered.

    Variants are "name (label)", meals of a build "name — a, b" for all that ``macro`` leaves of its
    tree; other items are themselves.  Of a name's repeats the last stays.
    """
    plain = normalize.to_rows(items.where("build is null").drop("build"))
    meals = tree.expand(groups, choices, macro).join(groups.where("parent_choice_id is null").select("group_id", F.col("format").alias("build")), "group_id")
    each = items.where("build is not null").select("restaurant", "item_seq", "name", "category", "build").join(meals, "build")
    shown = F.concat("name", F.lit(" — "), F.array_join("labels", ", "))
    place = F.row_number().over(Window.partitionBy("restaurant", "item_seq").orderBy("labels"))
    made = each.select("restaurant", "item_seq", place.alias("pos"), shown.alias("name"), "category", *MACROS)
    last = F.row_number().over(Window.partitionBy("restaurant", "name").orderBy(F.desc("item_seq"), F.desc("pos")))
    return plain.unionByName(made).withColumn("_r", last).where("_r = 1").drop("_r")


def chosen(index: DataFrame, snapshots: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Snapshots that the index lists with items, of all keys or of some; the others are not opened where they are folders of their own."""
    wanted = index.where(F.col("item_count") > 0).select("restaurant")
    if keys is not None:
        wanted = wanted.where(F.col("restaurant").isin(*keys))
    return snapshots.join(wanted, "restaurant", "left_semi")
