"""Where items come from: a registry of loaders, embedded JSON, HTML tables, snapshots, caches.

Nothing here goes to the network: pages, files and tables are the input.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import settle

ITEM_SCHEMA = "restaurant string, item_seq long, name string, category string, calories double, protein double, fat double, carbs double"


class Registry:
    """Loaders by name and alias, whatever the case; each returns a DataFrame of ITEM_SCHEMA."""

    def __init__(self):
        self.loaders: dict[str, Callable[[SparkSession], DataFrame]] = {}
        self.names: dict[str, str] = {}

    def add(self, name: str, loader: Callable[[SparkSession], DataFrame], aliases: tuple[str, ...] = ()) -> None:
        self.loaders[name] = loader
        for a in (name, *aliases):
            self.names[a.lower()] = name

    def load(self, spark: SparkSession, name: str) -> DataFrame | None:
        """The named source, None for a name that is not known, and no rows if it fails."""
        found = self.names.get(name.lower())
        return None if found is None else guarded(spark, self.loaders[found])

    def enabled(self, settings: dict[str, str] | None = None) -> list[str]:
        """Sources without a setting DISABLE_<NAME> of 1, true, yes or on."""
        env = os.environ if settings is None else settings
        return [n for n in self.loaders if env.get(f"DISABLE_{n.upper()}", "").strip().lower() not in ("1", "true", "yes", "on")]

    def load_all(self, spark: SparkSession, settings: dict[str, str] | None = None) -> DataFrame:
        return reduce(DataFrame.unionByName, (guarded(spark, self.loaders[n]) for n in self.enabled(settings)), spark.createDataFrame([], ITEM_SCHEMA))


def guarded(spark: SparkSession, loader: Callable[[SparkSession], DataFrame]) -> DataFrame:
    """A source that cannot be opened is empty, so that it does not stop the others."""
    try:
        return loader(spark).to(spark.createDataFrame([], ITEM_SCHEMA).schema)
    except Exception as e:
        print(f"source left out: {str(e)[:200]}")
        return spark.createDataFrame([], ITEM_SCHEMA)


def first_that_has_rows(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """primary, or fallback where primary has no row; decided inside the query."""
    none = primary.limit(1).agg((F.count(F.lit(1)) == 0).alias("_none"))
    return primary.unionByName(fallback.join(F.broadcast(none), F.col("_none")).drop("_none"))


def embedded_json(html: Column, script_id: str = "__NEXT_DATA__") -> Column:
    """The text of a script element by its id, null where there is none."""
    return F.nullif(F.regexp_extract(html, rf'(?s)<script[^>]*id="{script_id}"[^>]*>(.*?)</script>', 1), F.lit(""))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href): the addresses that a page's links lead to."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("pos", "href"))


def table_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, pos, heading, cells): table rows and headings of a page in order, tags removed from their text."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)(<tr[^>]*>.*?</tr>|<h[1-6][^>]*>.*?</h[1-6]>)"), 1)
    each = pages.select("page_id", F.posexplode(found).alias("pos", "part"))
    text = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))
    heading = F.when(F.col("part").rlike(r"(?i)^<h[1-6]"), text(F.col("part")))
    cells = F.transform(F.regexp_extract_all("part", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), text)
    return each.select("page_id", "pos", heading.alias("heading"), F.when(heading.isNull(), cells).alias("cells"))


def value_by_label(pairs: Column, pattern: str, without: str = "of which") -> Column:
    """The value of the first pair (label, value) whose label matches and has no ``without`` in it."""
    hit = F.filter(pairs, lambda p: p["label"].rlike(pattern) & ~F.contains(F.lower(p["label"]), F.lit(without)))
    return F.get(hit, F.lit(0))["value"]


def menu_tree(spark: SparkSession, nodes: DataFrame, root: str, deepest: int = 12) -> DataFrame:
    """(depth, node, category) below ``root`` of (node, parent, ord, label): the category is the parent's label."""
    tree = """
        with recursive t(depth, node, category) as (
            select 0, node, cast(null as string) from {nodes} where node = :root
            union all
            select t.depth + 1, n.node, p.label from t join {nodes} n on n.parent = t.node join {nodes} p on p.node = t.node where t.depth < :deepest)
        select depth, node, category from t"""
    return spark.sql(tree, args={"root": root, "deepest": deepest}, nodes=nodes)


def resolve_references(values: DataFrame, root: int, deepest: int = 12) -> DataFrame:
    """(depth, idx, key, value) reachable from ``root`` in a flat array of (idx, key, ref, value).

    A row is an entry of node idx: a reference to another node, or a value.  One join on the
    index for each level, and a node is visited once, at its least depth.
    """
    seen = values.sparkSession.createDataFrame([(0, root)], "depth int, idx long")
    frontier = seen
    for d in range(1, deepest + 1):
        below = values.join(frontier.select("idx"), "idx", "left_semi").where("ref is not null").select(F.lit(d).alias("depth"), F.col("ref").alias("idx")).distinct()
        nxt = settle(below.join(seen.select("idx"), "idx", "left_anti").select("depth", "idx"))
        if nxt.isEmpty():
            break
        seen, frontier = seen.unionByName(nxt), nxt
    return seen.join(values, "idx").select("depth", "idx", "key", "value")


def latest_menu(versions: DataFrame, key: str, updated: str) -> DataFrame:
    """The newest version's row for each key; one aggregation."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(updated)).alias("m")).select(key, *(F.col(f"m.{c}").alias(c) for c in rest))


def fresh(cache: DataFrame, now_ms: int, ttl_ms: int = 7 * 86_400_000, saved: str = "saved_at") -> DataFrame:
    """Rows saved less than ``ttl_ms`` ago; a plain predicate, which the scan can use."""
    return cache.where(F.col(saved) > now_ms - ttl_ms)


def version_stamp(cells: DataFrame, pattern: str = r"^[A-Z]+\d+$") -> DataFrame:
    """(doc_id, stamp): the topmost text of the first page that has one matching ``pattern``."""
    hit = cells.where(F.col("str").rlike(pattern)).groupBy("doc_id", "page").agg(F.max_by("str", "y").alias("stamp"))
    return hit.groupBy("doc_id").agg(F.min_by("stamp", "page").alias("stamp"))


def changed_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, decision) for documents (key, version, content): unchanged, refused (same version, other content) or replace."""
    o = old.select("key", F.col("version").alias("_v"), F.sha2(F.col("content").cast("binary"), 256).alias("_h"))
    n = new.withColumn("_n", F.sha2(F.col("content").cast("binary"), 256)).join(o, "key", "left")
    return n.select("key", F.when(F.col("_h") == F.col("_n"), "unchanged").when(F.col("_v") == F.col("version"), "refused").otherwise("replace").alias("decision"))


def remaining_row(rows: DataFrame, doc: str) -> DataFrame:
    """(doc, cells): of rows (doc, pos, cells, in_summary) labelled remaining with five cells, the last, a summary's first."""
    hit = rows.where((F.size("cells") >= 5) & F.contains(F.lower(F.get("cells", F.lit(0))), F.lit("remaining")))
    return hit.groupBy(doc).agg(F.max_by("cells", F.struct(F.col("in_summary").cast("int"), "pos")).alias("cells"))


def merge_targets(given: dict[str, Column], fallback: dict[str, Column]) -> list[Column]:
    """Each macro as given, or the fallback where that is missing or no number."""
    return [F.coalesce(F.when(~F.isnan(given[m].cast("double")), given[m]), fallback[m]).alias(m) for m in given]


def keep_last_good(old: DataFrame, new: DataFrame, key: str = "restaurant") -> DataFrame:
    """(key, items, updated_at): new items where there are any, else the old ones with their date."""
    n = new.select(key, F.col("items").alias("_items"), F.col("updated_at").alias("_at"))
    both = old.join(n, key, "full_outer")
    has = F.coalesce(F.size("_items") > 0, F.lit(False))
    return both.select(key, F.when(has, F.col("_items")).otherwise(F.col("items")).alias("items"), F.when(has, F.col("_at")).otherwise(F.col("updated_at")).alias("updated_at"))


def latest_by_event(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return events.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
