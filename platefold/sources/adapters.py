"""Raw menu documents of several shapes as item rows.

Every adapter takes a table of documents and returns (doc_id, seq, name, category, label, calories,
protein, fat, carbs): label is a size or option where the shape has one.  A document that does
not parse gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..macros import MACROS
from . import loaders

FACTS = "struct<calories:string,protein:string,fat:string,carbs:string>"
ITEM = f"struct<name:string,facts:{FACTS}>"


def _facts(facts: Column, parse=exprs.parse_number) -> list[Column]:
    return [parse(facts[m]).alias(m) for m in MACROS]


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    return df.withColumn("seq", seq).select("doc_id", "seq", "name", "category", "label", *MACROS)


def embedded_items(docs: DataFrame, html: str = "html", script_id: str = "__NEXT_DATA__") -> DataFrame:
    """Pages with a script of {"props": {"items": [{name, category, facts}]}}; a comma is a decimal mark."""
    schema = f"struct<props:struct<items:array<struct<name:string,category:string,facts:{FACTS}>>>>"
    doc = F.from_json(loaders.embedded_json(F.col(html), script_id), schema)
    each = docs.select("doc_id", F.posexplode(doc["props"]["items"]).alias("pos", "i"))
    rows = each.select("doc_id", "pos", F.trim("i.name").alias("name"), exprs.normalize_category(F.col("i.category")).alias("category"), F.lit(None).cast("string").alias("label"), *_facts(F.col("i.facts"), exprs.parse_decimal_mark))
    return _numbered(rows, "pos")


def cms_items(docs: DataFrame, json: str = "json", skip: str = "combo") -> DataFrame:
    """{"sections": [{title, items: [{type, name, facts, options: [{name, facts}]}]}]}: items, and a picker's options in its place.

    Entries of type ``skip`` are left out; rows with a missing macro are too.
    """
    schema = f"struct<sections:array<struct<title:string,items:array<struct<type:string,name:string,facts:{FACTS},options:array<{ITEM}>>>>>>"
    doc = F.from_json(json, schema)
    sections = docs.select("doc_id", F.posexplode(doc["sections"]).alias("p", "s"))
    # the title leaves the section before its items come out of it: a row of an item must not carry them all
    titled = sections.select("doc_id", "p", exprs.normalize_category(F.col("s.title")).alias("category"), F.col("s.items").alias("items"))
    items = titled.select("doc_id", "p", "category", F.posexplode("items").alias("q", "i")).where(F.coalesce(F.col("i.type"), F.lit("")) != skip)
    own = items.where("i.options is null").select("doc_id", "category", "p", "q", F.lit(0).alias("r"), F.col("i.name").alias("name"), F.col("i.facts").alias("f"))
    picked = items.where("i.options is not null").select("doc_id", "category", "p", "q", F.posexplode("i.options").alias("r", "o")).select("doc_id", "category", "p", "q", "r", F.col("o.name").alias("name"), F.col("o.facts").alias("f"))
    rows = own.unionByName(picked).select("doc_id", "category", "p", "q", "r", exprs.clean(F.col("name")).alias("name"), F.lit(None).cast("string").alias("label"), *_facts(F.col("f"))).dropna(subset=list(MACROS))
    return _numbered(rows, "p", "q", "r")


def sized_items(docs: DataFrame, json: str = "json") -> DataFrame:
    """{"products": [{name, category, facts, modifiers: [{slug, options: [{label, facts}]}]}]}: a size modifier's facts replace the product's."""
    option = f"struct<label:string,facts:{FACTS}>"
    schema = f"struct<products:array<struct<name:string,category:string,facts:{FACTS},modifiers:array<struct<slug:string,options:array<{option}>>>>>>"
    each = docs.select("doc_id", F.posexplode(F.from_json(json, schema)["products"]).alias("p", "i"))
    sizes = F.get(F.filter(F.coalesce("i.modifiers", F.array()), lambda m: F.startswith(m["slug"], F.lit("choose-size-"))), F.lit(0))["options"]
    plain = F.array(F.struct(F.lit(None).cast("string").alias("label"), F.col("i.facts").alias("facts")))
    sized = each.select("doc_id", "p", F.col("i.name").alias("name"), F.col("i.category").alias("category"), F.posexplode(F.when(F.size(sizes) > 0, sizes).otherwise(plain)).alias("q", "o"))
    return _numbered(sized.select("doc_id", "p", "q", "name", "category", F.col("o.label").alias("label"), *_facts(F.col("o.facts"))), "p", "q")


def component_items(docs: DataFrame, json: str = "json", typename: str = "Product") -> DataFrame:
    """{"components": [{"__typename", name, category, facts}]}: the first component of a type."""
    schema = f"struct<components:array<struct<__typename:string,name:string,category:string,facts:{FACTS}>>>"
    hit = F.get(F.filter(F.from_json(json, schema)["components"], lambda c: c["__typename"] == typename), F.lit(0))
    rows = docs.select("doc_id", hit.alias("i")).where("i is not null")
    return _numbered(rows.select("doc_id", F.col("i.name").alias("name"), F.col("i.category").alias("category"), F.lit(None).cast("string").alias("label"), *_facts(F.col("i.facts"))), "name")


def _as_array(v: Column) -> Column:
    """A variant that is one object or an array of them, as an array of JSON texts."""
    text = F.to_json(v)
    return F.from_json(F.when(F.startswith(text, F.lit("[")), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), "array<variant>")


def menu_tree_items(docs: DataFrame, json: str = "json", deepest: int = 6) -> DataFrame:
    """JSON-LD menus: {hasMenuSection: section or list, each with name, hasMenuItem, hasMenuSection}.

    The category is the section that an item stands in.  One level of sections is opened at a
    time, down to ``deepest``.
    """
    level = docs.select("doc_id", F.try_parse_json(json).alias("v"), F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("category"))
    found = []
    for _ in range(deepest):
        own = level.select("doc_id", "path", "category", F.posexplode(_as_array(F.try_variant_get("v", "$.hasMenuItem", "variant"))).alias("k", "i"))
        found.append(own.select("doc_id", F.concat("path", F.array(F.lit(-1), F.col("k"))).alias("path"), "category", F.try_variant_get("i", "$.name", "string").alias("name"), *(exprs.parse_number(F.try_variant_get("i", f"$.nutrition.{m}", "string")).alias(m) for m in MACROS)))
        level = level.select("doc_id", "path", F.posexplode(_as_array(F.try_variant_get("v", "$.hasMenuSection", "variant"))).alias("k", "s")).select("doc_id", F.col("s").alias("v"), F.concat("path", F.array(F.col("k"))).alias("path"), F.try_variant_get("s", "$.name", "string").alias("category"))
    rows = reduce(DataFrame.unionByName, found).withColumn("label", F.lit(None).cast("string"))
    return _numbered(rows, "path")


def html_table_items(docs: DataFrame, html: str = "html", deny_sections: tuple[str, ...] = (), deny_names: tuple[str, ...] = ()) -> DataFrame:
    """Tables of name, calories, protein, fat, carbs under headings; a dash is no value.

    Rows of denied sections, or with a denied word in the name, go.
    """
    pages = docs.select(F.col("doc_id").alias("page_id"), html)
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = loaders.table_rows(pages, html).withColumn("category", F.last("heading", ignorenulls=True).over(w)).where(F.size("cells") >= 5)
    cell = lambda k: F.get("cells", F.lit(k))
    out = rows.select(F.col("page_id").alias("doc_id"), "pos", exprs.normalize_category(F.col("category")).alias("category"), cell(0).alias("name"), F.lit(None).cast("string").alias("label"), *(exprs.parse_number(cell(k + 1)).alias(m) for k, m in enumerate(MACROS)))
    out = out.where("calories is not null")
    if deny_sections:
        out = out.where(F.coalesce(~F.lower("category").isin([s.lower() for s in deny_sections]), F.lit(True)))
    for word in deny_names:
        out = out.where(~F.contains(F.lower("name"), F.lit(word.lower())))
    return _numbered(out, "pos")


def nutrition_pairs(docs: DataFrame, json: str = "json", rules: dict[str, str] | None = None) -> DataFrame:
    """{"name", "category", "pairs": [{label, value}]}: each macro from the first label that matches its pattern."""
    rules = rules or {"calories": "(?i)energy.*kcal|calories", "protein": "(?i)protein", "fat": "(?i)fat", "carbs": "(?i)carbohydrate|carbs"}
    doc = docs.select("doc_id", F.from_json(json, "struct<name:string,category:string,pairs:array<struct<label:string,value:string>>>").alias("d")).where("d.name is not null")
    rows = doc.select("doc_id", F.col("d.name").alias("name"), F.col("d.category").alias("category"), F.lit(None).cast("string").alias("label"), *(exprs.parse_number(loaders.value_by_label(F.col("d.pairs"), rules[m])).alias(m) for m in MACROS))
    return _numbered(rows, "name")


def listing_details(listing: DataFrame, details: DataFrame, url: str = "url") -> DataFrame:
    """Listed pages with their details; a page listed twice is taken once, the first time."""
    first = listing.withColumn("_r", F.row_number().over(Window.partitionBy(url).orderBy("ord"))).where("_r = 1").drop("_r")
    return first.join(details, url)
