"""Which items a search looks at: categories, diets, dishes, presets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Categories that a preset excludes, by a part of the name or by the whole name.
PRESETS = (
    ("sides", "No sides", ("side", "fries", "dips", "sauce", "condiment", "chick 'n' dip", "extra"), ("toppings",)),
    ("drinks", "No drinks", ("drink", "beverage", "shake"), ()),
    ("desserts", "No desserts", ("dessert", "sweet treat", "churro", "cookie", "shake"), ()),
    ("breakfast", "No breakfast", ("breakfast",), ()),
    ("dips", "No dips", ("dips",), ()),
)
PRESET_SCHEMA = "key string, label string, keywords array<string>, exact array<string>"


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, n, list(w), list(x)) for k, n, w, x in PRESETS], PRESET_SCHEMA)


def exclude_categories(items: DataFrame, categories: list[str]) -> DataFrame:
    """Items of no such category, whatever its case; those without a category stay."""
    if not categories:
        return items
    return items.where(F.coalesce(~F.lower("category").isin([c.lower() for c in categories]), F.lit(True)))


def filter_by_restaurant(items: DataFrame, filters: DataFrame) -> DataFrame:
    """Apply ``filters`` (restaurant, mode, categories), one row for a restaurant at most.

    include: only the listed categories, so items without one go; exclude: not the listed ones,
    so they stay.  Mode all, an empty list or no row lets everything pass.
    """
    f = filters.select("restaurant", F.col("mode").alias("_mode"), F.transform("categories", lambda c: F.lower(c)).alias("_listed"))
    joined = items.join(f, "restaurant", "left")
    hit = F.coalesce(F.array_contains("_listed", F.lower("category")), F.lit(False))
    passes = F.col("_mode").isNull() | (F.col("_mode") == "all") | (F.size("_listed") <= 0)
    return joined.where(passes | F.when(F.col("_mode") == "include", hit).otherwise(~hit)).drop("_mode", "_listed")


def dietary(items: DataFrame, restriction: str) -> DataFrame:
    """Items that carry the tag; those without tags go."""
    if restriction == "none":
        return items
    return items.where(F.coalesce(F.array_contains("dietary", restriction), F.lit(False)))


def without_dishes(items: DataFrame, terms: list[str]) -> DataFrame:
    """Items whose name has none of the terms in it, whatever the case; blank terms count for nothing."""
    words = [t.strip().lower() for t in terms if t.strip()]
    return reduce(lambda df, t: df.where(~F.contains(F.lower("name"), F.lit(t))), words, items)


def preset_hit(category: Column, keywords: Column, exact: Column) -> Column:
    c = F.lower(category)
    return F.coalesce(F.exists(keywords, lambda k: F.contains(c, k)) | F.array_contains(exact, c), F.lit(False))


def preset_matches(groups: DataFrame) -> DataFrame:
    """(key, restaurant, matched): for each preset and restaurant the categories it covers, in order.

    ``groups`` is (restaurant, categories).  Presets are five rows, so the join is small.
    """
    rows = F.broadcast(presets(groups.sparkSession))
    each = groups.select("restaurant", F.posexplode("categories").alias("pos", "category")).join(rows, preset_hit(F.col("category"), F.col("keywords"), F.col("exact")))
    listed = each.groupBy("key", "restaurant").agg(F.array_sort(F.collect_list(F.struct("pos", "category"))).alias("m"))
    return listed.select("key", "restaurant", F.transform("m", lambda x: x["category"]).alias("matched"))


def preset_active(groups: DataFrame, filters: DataFrame) -> DataFrame:
    """(key, active): every category that the preset covers is excluded somewhere it occurs, and there is one.

    A restaurant in include mode with such a category keeps the preset inactive.
    """
    state = preset_matches(groups).join(filters, "restaurant", "left")
    done = (F.col("mode") == "exclude") & (F.size(F.array_except("matched", "categories")) == 0)
    return state.groupBy("key").agg(F.bool_and(F.coalesce(done, F.lit(False))).alias("active"))


def toggle_preset(groups: DataFrame, filters: DataFrame, key: str, on: bool) -> DataFrame:
    """``filters`` after switching a preset on or off.

    On: its categories are added to a restaurant's exclusions.  Off: they are taken away, and a
    restaurant left without any goes back to mode all.  Restaurants in include mode, or without
    such a category, stay as they are.
    """
    own = preset_matches(groups).where(F.col("key") == key).select("restaurant", "matched")
    both = filters.join(own, "restaurant", "full_outer")
    now = F.coalesce("categories", F.array().cast("array<string>"))
    touched = F.col("matched").isNotNull() & ~F.coalesce(F.col("mode") == "include", F.lit(False))
    excluded = F.when(F.col("mode") == "exclude", now).otherwise(F.array().cast("array<string>"))
    new = F.array_union(excluded, "matched") if on else F.array_except(excluded, "matched")
    mode = F.when(~touched, F.coalesce("mode", F.lit("all"))).when(F.size(new) > 0, "exclude").otherwise("all")
    return both.select("restaurant", mode.alias("mode"), F.when(touched, new).otherwise(now).alias("categories"))


def toggle_category(categories: Column, category: Column) -> Column:
    """Remove it if it is listed, else add it."""
    return F.when(F.array_contains(categories, category), F.array_remove(categories, category)).otherwise(F.array_append(categories, category))


def add_term(terms: Column, term: Column) -> Column:
    """Add a term, trimmed, unless it is blank or one equal but for case is there."""
    t = F.trim(term)
    return F.when(F.exists(terms, lambda x: F.lower(x) == F.lower(t)) | (t == ""), terms).otherwise(F.array_append(terms, t))


def remove_term(terms: Column, term: Column) -> Column:
    """Without the terms equal to ``term``, case and all."""
    return F.filter(terms, lambda x: x != term)


def merge_preferences(stored: Column, defaults: dict[str, str], fixed: dict[str, str] | None = None) -> Column:
    """A map of preferences: the defaults, what a JSON object has stored over them, and ``fixed`` over both.

    A text that is no JSON object counts as nothing stored; a stored null is a null.
    """
    as_map = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv)) if d else F.create_map().cast("map<string,string>")
    read = F.coalesce(F.from_json(stored, "map<string,string>"), F.create_map().cast("map<string,string>"))
    under = lambda top, base: F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(top, k)), top)
    merged = under(read, as_map(defaults))
    return under(as_map(fixed or {}), merged) if fixed else merged


def in_scope(section: Column, name: Column, scope: str, drop: str | None = None) -> Column:
    """Whether a row's section is one that ``scope`` matches and its name is none that ``drop`` does.

    The name guards the seam between sections, where a row's place can put it into the next one;
    a row without a section is in none.
    """
    own = F.coalesce(section.rlike(scope), F.lit(False))
    return own & ~F.coalesce(name.rlike(drop), F.lit(False)) if drop else own


def active_filters(filters: DataFrame) -> DataFrame:
    return filters.agg(F.count_if((F.col("mode") != "all") & (F.size("categories") > 0)).alias("active"))


def relevant_presets(groups: DataFrame) -> DataFrame:
    """Presets that cover a category of some restaurant, and of how many."""
    return preset_matches(groups).groupBy("key").agg(F.count(F.lit(1)).alias("restaurants"))


def dish_preview(items: DataFrame, term: str, most: int = 8) -> DataFrame:
    """The first distinct names, in order, that contain a term."""
    return items.where(F.contains(F.lower("name"), F.lit(term.lower()))).select("name").distinct().orderBy("name").limit(most)
