"""Ordered normalisation of item rows: headings, repeats, name collisions, variants."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs
from ..macros import MACROS

FAMILY = ("restaurant", "name")


def fill_headings(rows: DataFrame, doc: str, order: str, heading: str, out: str = "section") -> DataFrame:
    """Give each row the last heading at or before it in its document."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(heading, ignorenulls=True).over(w))


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return _one(rows, keys, F.col(order).asc())


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return _one(rows, keys, F.col(order).desc())


def _one(rows: DataFrame, keys: list[str], order) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")


def best_by_priority(rows: DataFrame, key: str, rank: str, order: str, value: str) -> DataFrame:
    """(key, value) of least rank, the first of equals; one aggregation, no sort."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(rank, order)).alias(value))


def segments_on_reset(rows: DataFrame, doc: str, order: str, serves: str) -> DataFrame:
    """Number the groups of a document's rows; a new one begins where serves is 1 after another number."""
    w = Window.partitionBy(doc).orderBy(order)
    before = F.lag(serves).over(w)
    reset = F.coalesce((F.col(serves) == 1) & (before != 1), F.lit(False)).cast("int")
    return rows.withColumn("_reset", reset).withColumn("segment", F.sum("_reset").over(w) + 1).drop("_reset")


def resolve_collisions(items: DataFrame) -> DataFrame:
    """Items (restaurant, item_seq, name, category, macros) with ``final_name``, unique in a restaurant.

    Of one name's items, those with macros that an earlier one has are dropped; missing macros
    are equal to missing ones only.  If a later item's category is given and differs from the first
    one's, which is given too, then at the first such item both get their category in
    parentheses.  All other later items are numbered from 2 in order, by the next free number.

    Names that already end in parentheses belong to the family of the name before them: their
    items count as earlier variants, and their numbers are taken; a name given for a category takes the
    place of an item that has it already.  Such families are folded in order, one family at a time in
    each task; all others are named by windows over the same shuffle.
    """
    rows = items.withColumn("_base", F.substring_index("name", " (", 1))
    odd = F.bool_or((F.col("name") != F.col("_base")) | F.coalesce(F.col("category").rlike(r"^\d+$"), F.lit(False)))
    rows = rows.withColumn("_odd", F.coalesce(odd.over(Window.partitionBy("restaurant", "_base")), F.lit(False)))
    plain = _numbered(rows.where("not _odd")).drop("_base", "_odd")
    in_order = rows.where("_odd").drop("_odd").repartition("restaurant", "_base").sortWithinPartitions("restaurant", "_base", "item_seq")
    named = in_order.mapInPandas(_fold_families, T.StructType([*items.schema.fields, T.StructField("final_name", T.StringType())]))
    return plain.unionByName(named)


def _numbered(items: DataFrame) -> DataFrame:
    """Final names of families whose names have no parentheses: the name is the base."""
    rows = keep_first(items, ["restaurant", "_base", *MACROS], "item_seq")
    whole = Window.partitionBy("restaurant", "_base")
    family = whole.orderBy("item_seq")
    rows = rows.withColumn("_k", F.row_number().over(family)).withColumn("_c1", F.first("category").over(family))
    differs = (F.col("_k") >= 2) & (F.coalesce("category", F.lit("")) != "") & (F.coalesce("_c1", F.lit("")) != "") & (F.col("category") != F.col("_c1"))
    rows = rows.withColumn("_s", F.min(F.when(differs, F.col("_k"))).over(whole))
    split = F.coalesce((F.col("_k") == 1) & F.col("_s").isNotNull() | (F.col("_k") == F.col("_s")), F.lit(False))
    numbered = (F.col("_k") >= 2) & ~split
    rows = rows.withColumn("_n", F.sum(numbered.cast("int")).over(family) + 1)
    in_brackets = lambda c: F.concat("name", F.lit(" ("), c, F.lit(")"))
    final = F.when(split, in_brackets(F.col("category"))).when(numbered, in_brackets(F.col("_n").cast("string"))).otherwise(F.col("name"))
    return rows.withColumn("final_name", final).drop("_k", "_c1", "_s", "_n")


def _roots(name: str) -> list[str]:
    """The names whose family a final name is in: itself, and what stands before each of its parentheses."""
    cuts = [k for k in range(1, len(name)) if name.startswith(" (", k) and k < len(name) - 3] if name.endswith(")") else []
    return [name, *(name[:k] for k in cuts)]


class _Family:
    """What is known of a family so far.

    ``below`` counts the macros of the items under each name that a final name belongs to, so one look-up
    tells a repeat.  ``owner`` has the final names in use, ``free`` the least number that may be
    free for a name.
    """

    def __init__(self, macros: list[tuple]):
        self.macros = macros
        self.below: dict[str, Counter] = {}
        self.owner: dict[str, int] = {}
        self.free: dict[str, int] = {}

    def give(self, final: str, row: int) -> None:
        """A name that is in use already changes hands."""
        if final in self.owner:
            self.release(final)
        self.owner[final] = row
        for root in _roots(final):
            self.below.setdefault(root, Counter())[self.macros[row]] += 1

    def release(self, final: str) -> int:
        row = self.owner.pop(final)
        for root in _roots(final):
            self.below[root] -= Counter([self.macros[row]])
        root, _, number = final[:-1].rpartition(" (")
        if number.isdigit() and root in self.free:
            self.free[root] = min(self.free[root], max(2, int(number)))
        return row

    def number(self, name: str) -> str:
        n = self.free.get(name, 2)
        while f"{name} ({n})" in self.owner:
            n += 1
        self.free[name] = n
        return f"{name} ({n})"


def _fold_families(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Items in order of restaurant, base name and place with their final names; repeats are left out. One family is held at a time, and one batch."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch])
        if rows.empty:
            continue
        keys = rows[["restaurant", "_base"]].astype(object).where(rows[["restaurant", "_base"]].notna(), None).to_numpy()
        last = (keys == keys[-1]).all(axis=1)
        cut = len(rows) - (int(last[::-1].argmin()) if not last.all() else len(rows))
        rest = rows.iloc[cut:]
        if cut:
            yield _folded(rows.iloc[:cut])
    if rest is not None:
        yield _folded(rest)


def _folded(rows: pd.DataFrame) -> pd.DataFrame:
    told = lambda x: None if pd.isna(x) else x
    macros = [tuple(map(told, m)) for m in rows[list(MACROS)].itertuples(index=False)]
    kinds = [told(c) or "" for c in rows["category"]]
    names: dict[int, str] = {}
    family, of = _Family(macros), None
    for row, (restaurant, base, name) in enumerate(rows[["restaurant", "_base", "name"]].itertuples(index=False)):
        if (told(restaurant), told(base)) != of:
            names |= {k: final for final, k in family.owner.items()}
            family, of = _Family(macros), (told(restaurant), told(base))
        below = family.below.get(name)
        if below and macros[row] in below:
            continue
        other = kinds[family.owner[name]] if name in family.owner else ""
        final = name if not below else None
        if below and other and kinds[row] and other != kinds[row]:
            family.give(f"{name} ({other})", family.release(name))
            final = f"{name} ({kinds[row]})"
        family.give(final or family.number(name), row)
    names |= {k: final for final, k in family.owner.items()}
    kept = sorted(names)
    return rows.iloc[kept].drop(columns="_base").assign(final_name=[names[k] for k in kept])


def add_variants(items: DataFrame) -> DataFrame:
    """Items with ``variant`` (struct base, label, option, or null) under their final names, in one pass.

    A variant is named "base (option)" and stamped with variant_of, variant_label and
    variant_option; then names are resolved as those of all other items.
    """
    v = F.col("variant")
    name = F.when(v.isNull(), F.col("name")).otherwise(F.concat(v["base"], F.lit(" ("), v["option"], F.lit(")")))
    stamped = items.withColumn("name", name).withColumns({"variant_of": v["base"], "variant_label": v["label"], "variant_option": v["option"]})
    return resolve_collisions(stamped.drop("variant"))


def stamp_variants(items: DataFrame) -> DataFrame:
    """Add variant_of, variant_label and variant_option where a group has several rows and options.

    ``items`` has ``variant`` (struct base, label, option, or null).  A base with one row or one
    option is no choice; its rows stay plain.
    """
    w = Window.partitionBy("restaurant", "variant.base")
    options = F.size(F.collect_set("variant.option").over(w))
    real = F.col("variant").isNotNull() & (F.count(F.lit(1)).over(w) > 1) & (options > 1)
    return items.select("*", *(F.when(real, F.col(f"variant.{f}")).alias(n) for f, n in (("base", "variant_of"), ("label", "variant_label"), ("option", "variant_option"))))


def distinct_labels(rows: DataFrame, keys: list[str], label: str, order: str) -> DataFrame:
    """A label's later repeats in a group get (2), (3), ... in order."""
    n = F.row_number().over(Window.partitionBy(*keys, label).orderBy(order))
    return rows.withColumn(label, F.when(n == 1, F.col(label)).otherwise(F.concat(label, F.lit(" ("), n.cast("string"), F.lit(")"))))


def median_row(rows: DataFrame, keys: list[str], order: str = "item_seq") -> DataFrame:
    """The row of middle calories in each group, the lower of two, the first of equals."""
    w = Window.partitionBy(*keys)
    r = F.row_number().over(w.orderBy("calories", order))
    return rows.select("*", r.alias("_r"), F.count(F.lit(1)).over(w).alias("_n")).where("_r = (_n + 1) div 2").drop("_r", "_n")


def regroup_variants(items: DataFrame) -> DataFrame:
    """Variant rows (variant_of, variant_option) as one item each with ``variants``; plain rows as they are.

    Columns: restaurant, item_seq (of the first row), name, category, macros, variants (array of
    label and macros, null for plain items).  A group of one is a plain item with its option in
    the name: in parentheses, or after a dash if it has some itself.  A group's own macros are
    those of its median option.
    """
    plain = items.where(F.col("variant_of").isNull()).select("restaurant", "item_seq", "name", "category", *MACROS)
    own = distinct_labels(items.where(F.col("variant_of").isNotNull()), ["restaurant", "variant_of"], "variant_option", "item_seq")
    entry = F.struct("item_seq", F.col("variant_option").alias("label"), *MACROS)
    groups = own.groupBy("restaurant", "variant_of").agg(F.min("item_seq").alias("item_seq"), F.min_by("category", "item_seq").alias("category"), F.array_sort(F.collect_list(entry)).alias("v"))
    by_calories = F.array_sort(F.transform("v", lambda x: F.struct(x["calories"].alias("calories"), x["item_seq"].alias("item_seq"), x.alias("x"))))
    groups = groups.withColumn("mid", F.element_at(by_calories, ((F.size("v") - 1) / 2).cast("int") + 1)["x"])
    only = F.col("v")[0]["label"]
    name = F.when(F.size("v") > 1, F.col("variant_of")).when(F.contains(only, F.lit("(")), F.concat("variant_of", F.lit(" — "), only)).otherwise(F.concat("variant_of", F.lit(" ("), only, F.lit(")")))
    variants = F.when(F.size("v") > 1, F.transform("v", lambda x: F.struct(x["label"].alias("label"), *(x[m].alias(m) for m in MACROS))))
    made = groups.select("restaurant", "item_seq", name.alias("name"), "category", *(F.col(f"mid.{m}").alias(m) for m in MACROS), variants.alias("variants"))
    return plain.withColumn("variants", F.lit(None).cast(made.schema["variants"].dataType)).unionByName(made)


def calorie_range(items: DataFrame) -> DataFrame:
    """(restaurant, name, least, most, base_items) of items with variants."""
    calories = F.transform("variants", lambda v: v["calories"])
    return items.where(F.col("variants").isNotNull()).select("restaurant", "name", F.array_min(calories).alias("least"), F.array_max(calories).alias("most"))


def to_rows(snapshot: DataFrame) -> DataFrame:
    """Flat rows of items with variants: "name (label)" for each; of a name's repeats the last stays."""
    plain = snapshot.where(F.col("variants").isNull()).select("restaurant", "item_seq", F.lit(0).alias("pos"), "name", "category", *MACROS)
    each = snapshot.where(F.col("variants").isNotNull()).select("restaurant", "item_seq", "name", "category", F.posexplode("variants").alias("pos", "v"))
    flat = each.select("restaurant", "item_seq", "pos", F.concat("name", F.lit(" ("), F.col("v.label"), F.lit(")")).alias("name"), "category", *(F.col(f"v.{m}").alias(m) for m in MACROS))
    rows = plain.unionByName(flat)
    last = F.row_number().over(Window.partitionBy(*FAMILY).orderBy(F.desc("item_seq"), F.desc("pos")))
    return rows.withColumn("_r", last).where("_r = 1").drop("_r")


def with_status(items: DataFrame, missing: str = "zero", deny: list[str] | None = None) -> DataFrame:
    """Add ``status``: incomplete, invalid (no calories), implausible, excluded (category) or ok.

    ``missing='zero'`` takes missing protein, fat or carbs for 0; ``'reject'`` calls the row
    incomplete.
    """
    gone = F.col("calories").isNull() | F.isnan(F.col("calories").cast("double"))
    if missing == "reject":
        for m in MACROS[1:]:
            gone |= F.col(m).isNull()
    p, f, c = (F.coalesce(m, F.lit(0)) for m in MACROS[1:])
    denied = F.coalesce(F.lower("category").isin([x.lower() for x in deny or []]), F.lit(False))
    status = F.when(gone, "incomplete").when(F.col("calories") <= 0, "invalid").when(exprs.implausible(p, f, c, F.col("calories")), "implausible").when(denied, "excluded").otherwise("ok")
    return items.withColumn("status", status)


def status_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("restaurant", "status").agg(F.count(F.lit(1)).alias("n"))
