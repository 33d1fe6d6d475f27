"""Documents that are one flat array: each object and list in it holds places of other entries instead of values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from ..staging import once, settle

#: Edges between a category and its items at most, two for each section in between; lists count as edges.
DEEPEST = 8
#: What the nutrition rows of an item are called.
LABELS = {"calories": r"(?i)energy \(kcal\)", "protein": r"(?i)^protein \(g\)", "fat": r"(?i)^fat \(g\)", "carbs": r"(?i)^carb \(g\)"}
NODE = ["doc_id", "idx"]
#: Entries of a document that are parsed together.
PIECE = 256
# JSON of one level: arrays of plain values, and of objects and lists of these. Every repetition is possessive, so texts of any length take no stack.
_WS = r"[ \t\r\n]*+"
_TEXT = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
_PLAIN = rf"(?:{_TEXT}|-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+|true|false|null){_WS}"
_PAIR = rf"{_TEXT}{_WS}:{_WS}{_PLAIN}"
_NODE = rf"(?:{_PLAIN}|(?:\{{{_WS}(?:{_PAIR}(?:,{_WS}{_PAIR})*+)?+\}}|\[{_WS}(?:{_PLAIN}(?:,{_WS}{_PLAIN})*+)?+\]){_WS})"
_FLAT = rf"\A{_WS}\[{_WS}{_NODE}(?:,{_WS}{_NODE})*+\]{_WS}\z"
_PIECES = rf"\G(?:\A{_WS}\[|,){_WS}({_NODE}(?:,{_WS}{_NODE}){{0,{PIECE - 1}}}+)"


def decode(docs: DataFrame, json: str = "json") -> DataFrame:
    """(doc_id, idx, kind, key, ord, ref, value): an entry of each object (key) and list (ord) of the arrays, and each plain value.

    An integer inside an object or list is a reference, ``ref``; negative ones lead nowhere.  Other
    values are text.  A document that is no JSON array has no rows.
    """
    tvf = docs.sparkSession.tvf
    parsed = _pieces(docs, json).select("doc_id", "first", F.try_parse_json("piece").alias("payload")).where(F.schema_of_variant("payload").startswith("ARRAY"))
    nodes = parsed.lateralJoin(tvf.variant_explode(F.col("payload").outer())).select("doc_id", (F.col("first") + F.col("pos")).alias("idx"), F.col("value").alias("node"))
    kind = F.lower(F.regexp_extract(F.schema_of_variant("node"), r"^(OBJECT|ARRAY)", 1))
    # a node's own text leaves it before its entries come out: a row of an entry must not carry the whole node
    nodes = nodes.withColumn("kind", F.when(kind == "", "value").otherwise(kind)).withColumn("plain", F.when(kind == "", F.try_variant_get("node", "$", "string")))
    entries = nodes.lateralJoin(tvf.variant_explode_outer(F.col("node").outer())).select("doc_id", "idx", "kind", "key", F.col("pos").cast("long").alias("ord"), "plain", "value")
    inside = F.col("kind") != "value"
    number = inside & (F.schema_of_variant("value") == "BIGINT")
    text = F.when(inside, F.when(~number, F.try_variant_get("value", "$", "string"))).otherwise(F.col("plain"))
    return entries.select("doc_id", "idx", "kind", "key", "ord", F.when(number, F.try_variant_get("value", "$", "long")).alias("ref"), text.alias("value")).withColumn("ref", F.when(F.col("ref") >= 0, F.col("ref")))


def _pieces(docs: DataFrame, json: str) -> DataFrame:
    """(doc_id, first, piece): arrays of PIECE entries of each document, and the place of the first one.

    A document is held by one task as a text only; its entries come out of pieces of a few
    kilobytes.  One with entries of several levels, or that is no array, stays whole.  One of
    which a piece is no JSON (keys may be there twice) has no pieces, as it is no JSON itself.
    """
    text = docs.select("doc_id", F.col(json).alias("_json"))
    array = lambda p: F.concat(F.lit("["), p, F.lit("]"))
    flat = F.coalesce(F.col("_json").rlike(_FLAT), F.lit(False))
    cut = F.when(flat, F.regexp_extract_all("_json", F.lit(_PIECES), F.lit(1)))
    cut = once(text, _cut=F.coalesce(cut, F.array("_json")), _flat=flat).drop("_json")
    sound = cut.where(~F.col("_flat") | F.forall("_cut", lambda p: F.try_parse_json(array(p)).isNotNull()))
    each = sound.select("doc_id", "_flat", F.posexplode("_cut").alias("_at", "_piece"))
    return settle(each.select("doc_id", (F.col("_at").cast("long") * PIECE).alias("first"), F.when(F.col("_flat"), array(F.col("_piece"))).otherwise(F.col("_piece")).alias("piece")))


def values_of(entries: DataFrame, key: str, out: str) -> DataFrame:
    """(doc_id, idx, out): the plain value under ``key`` of each object, its own or the one it refers to."""
    own = entries.where((F.col("kind") == "object") & (F.col("key") == key))
    plain = entries.where("kind = 'value'").select("doc_id", F.col("idx").alias("ref"), F.col("value").alias("_far"))
    return own.select(*NODE, "ref", "value").join(plain, ["doc_id", "ref"], "left").select(*NODE, F.coalesce("value", "_far").alias(out))


def objects_with(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(doc_id, idx) of the objects that have all of ``keys``."""
    hit = entries.where((F.col("kind") == "object") & F.col("key").isin(*keys)).groupBy(*NODE).agg(F.count_distinct("key").alias("n"))
    return hit.where(F.col("n") == len(keys)).select(*NODE)


def walk(entries: DataFrame, roots: DataFrame, stops: DataFrame, through: Sequence[str] | None = None, deepest: int = DEEPEST) -> DataFrame:
    """(doc_id, root, idx): the nodes of ``stops`` that lie below each of ``roots`` (doc_id, idx).

    From an object the walk goes on through the keys of ``through`` only (None: all), from a list
    through all of its places; at a stop it ends if the keys are limited.  Each root has its own visited nodes, which
    ends cycles; a node counts at its least depth.  One join on the place for each edge.
    """
    edges = entries.where("ref is not null")
    if through is not None:
        edges = edges.where((F.col("kind") == "array") | F.col("key").isin(*through)).join(stops, NODE, "left_anti")
    edges = settle(edges.select(*NODE, "ref").distinct())
    seen = settle(roots.select("doc_id", F.col("idx").alias("root"), "idx"))
    frontier = seen
    for _ in range(deepest):
        below = frontier.join(edges, NODE).select("doc_id", "root", F.col("ref").alias("idx")).distinct()
        frontier = settle(below.join(seen, ["doc_id", "root", "idx"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.join(stops, NODE, "left_semi")


def categories(entries: DataFrame, marks: Sequence[str] = ("Recipes", "Sections", "Name", "SType"), through: Sequence[str] = ("Recipes", "Sections")) -> DataFrame:
    """(doc_id, item, category): each item's name, trimmed and in lower case, with the first category that it lies in.

    A category is an object with all of ``marks`` and a name that is not blank; an item has Name
    and Nutrs.  Categories come in the order of the array.
    """
    named = values_of(entries, "Name", "name")
    label = F.trim(F.col("name"))
    roots = settle(objects_with(entries, marks).join(named, NODE).where(label != "").select(*NODE, label.alias("category")))
    items = objects_with(entries, ("Name", "Nutrs"))
    found = walk(entries, roots, items, through).join(named, NODE).where("name is not null")
    both = found.select("doc_id", "root", F.lower(F.trim("name")).alias("item")).join(roots.withColumnRenamed("idx", "root"), ["doc_id", "root"])
    return both.groupBy("doc_id", "item").agg(F.min_by("category", "root").alias("category"))


def names_below(entries: DataFrame, pattern: str, marks: Sequence[str] = ("Recipes", "Sections", "Name"), deepest: int = DEEPEST) -> DataFrame:
    """(doc_id, item): names of the items that are reached in any way from a category whose name matches ``pattern``."""
    named = values_of(entries, "Name", "name")
    roots = objects_with(entries, marks).join(named, NODE).where(F.col("name").rlike(pattern)).select(*NODE)
    found = walk(entries, roots, objects_with(entries, ("Name", "Nutrs")), None, deepest)
    return found.join(named, NODE).where("name is not null").select("doc_id", F.lower(F.trim("name")).alias("item")).distinct()


def nutrition(entries: DataFrame) -> DataFrame:
    """(doc_id, idx, name, calories, protein, fat, carbs): items with the value of the first nutrition row for each label."""
    items = objects_with(entries, ("Name", "Nutrs")).join(values_of(entries, "Name", "name"), NODE)
    lists = entries.where((F.col("kind") == "object") & (F.col("key") == "Nutrs")).select(*NODE, F.col("ref").alias("list"))
    places = entries.where("kind = 'array' and ref is not null").select("doc_id", F.col("idx").alias("list"), "ord", F.col("ref").alias("row"))
    said = values_of(entries, "Desc", "label").join(values_of(entries, "PerServ", "figure"), NODE).withColumnRenamed("idx", "row")
    rows = lists.join(places, ["doc_id", "list"]).join(said, ["doc_id", "row"])
    first = [F.min_by(F.when(F.col("label").rlike(p), exprs.parse_number(F.col("figure"))), F.when(F.col("label").rlike(p), F.col("ord"))).alias(m) for m, p in LABELS.items()]
    return items.join(rows.groupBy(*NODE).agg(*first), NODE).select(*NODE, F.trim("name").alias("name"), *LABELS)


def menu(docs: DataFrame, json: str = "json", drinks: str = r"(?i)drink") -> DataFrame:
    """(doc_id, idx, name, category, calories, protein, fat, carbs, status) of the items of reference documents.

    status is ok, invalid (no name or calories), excluded (in a category of ``drinks``) or
    implausible (a macro holds more energy than the calories by over 30 %); missing protein, fat and
    carbs count as none.  An item that several categories share has the first one's name.
    """
    entries = settle(decode(docs, json))
    found = nutrition(entries).withColumn("item", F.lower("name"))
    gone = names_below(entries, drinks).withColumn("_gone", F.lit(True))
    both = found.join(categories(entries), ["doc_id", "item"], "left").join(gone, ["doc_id", "item"], "left")
    p, f, c = (F.coalesce(m, F.lit(0.0)) for m in ("protein", "fat", "carbs"))
    status = F.when(F.coalesce(F.col("name"), F.lit("")) == "", "invalid").when(F.col("_gone"), "excluded").when(F.coalesce(F.col("calories"), F.lit(0.0)) <= 0, "invalid").when(exprs.implausible(p, f, c, F.col("calories")), "implausible").otherwise("ok")
    return both.select(*NODE, "name", exprs.normalize_category(F.col("category")).alias("category"), "calories", p.alias("protein"), f.alias("fat"), c.alias("carbs"), status.alias("status"))
