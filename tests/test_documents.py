"""Stores, faults, references, trees and screenshots on odd cases."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from platefold.functions import exprs
from platefold.operators import compose, filters, layout, tree
from platefold.sources import documents, loaders, references, screenshots, sinks, snapshots
from platefold.staging import settle

DOC = "key string, version string, content string"


def decisions(df):
    return {r["key"]: r["decision"] for r in df.collect()}


def test_store_replaces_only_newer_versions(spark, tmp_path):
    store = documents.DocumentStore(spark, f"file://{tmp_path}/store")
    new = lambda *rows: spark.createDataFrame(rows, DOC)
    assert store.read().count() == 0
    assert decisions(store.replace(new(("a", "v1", "one"), ("b", "v1", "two"), ("c", None, "x"), ("d", "v1", "")), 1)) == {"a": "new", "b": "new", "c": "new", "d": "invalid"}
    later = new(("a", "v1", "one"), ("b", "v1", "other"), ("c", "v2", "y"))
    assert decisions(store.replace(later, 2, check_only=True)) == {"a": "unchanged", "b": "refused", "c": "replace"}
    held = lambda: {r["key"]: (r["version"], bytes(r["content"]).decode()) for r in store.read().collect()}
    assert held() == {"a": ("v1", "one"), "b": ("v1", "two"), "c": (None, "x")}
    store.replace(later, 2)
    assert held()["b"] == ("v1", "two") and held()["c"] == ("v2", "y")


def test_broken_replacement_leaves_the_old_document(spark, tmp_path, monkeypatch):
    store = documents.DocumentStore(spark, f"file://{tmp_path}/store")
    store.replace(spark.createDataFrame([("a", "v1", "one")], DOC), 1)
    # the new bytes get lost on their way
    commit = store._commit
    monkeypatch.setattr(store, "_commit", lambda folder, at, n: commit(folder, at, n + 1))
    with pytest.raises(OSError):
        store.replace(spark.createDataFrame([("a", "v2", "two")], DOC), 2)
    assert [(r["version"], bytes(r["content"])) for r in store.read().collect()] == [("v1", b"one")]


def test_bad_records_and_files_are_rows(spark, tmp_path):
    folder = tmp_path / "json"
    folder.mkdir()
    (folder / "a.json").write_text('{"n": 1}\n{"n": \n{"n": 3}\nno json\n')
    (folder / "b.json").write_text('{"n": 4}\n')
    rows, faults = documents.read_json_lines(spark, f"file://{folder}", "n long")
    assert sorted(r["n"] for r in rows.collect()) == [1, 3, 4]
    assert [(os.path.basename(r["file"]), r["n"]) for r in documents.fault_counts(faults).collect()] == [("a.json", 2)]
    folder = f"{tmp_path}/parquet"
    spark.range(50).coalesce(1).write.parquet(folder)
    spark.range(0).coalesce(1).write.mode("append").parquet(folder)
    spark.range(60, 90).coalesce(1).write.mode("append").parquet(folder)
    files = sorted((f for f in os.listdir(folder) if f.endswith(".parquet")), key=lambda f: os.path.getsize(f"{folder}/{f}"))
    torn = files[1]  # thirty rows
    data = open(f"{folder}/{torn}", "rb").read()
    open(f"{folder}/{torn}", "wb").write(data[: len(data) // 2])
    for f in os.listdir(folder):
        if f.endswith(".crc"):
            os.remove(f"{folder}/{f}")
    rows, faults = documents.read_parquet_files(spark, f"file://{folder}", "id long")
    assert rows.count() == 50
    assert [os.path.basename(r["file"]) for r in faults.collect()] == [torn]


def test_debug_dump(spark, tmp_path):
    df = spark.createDataFrame([("Acme", "a", 1.0), ("Bistro", "b", 2.0)], "restaurant string, name string, calories double")
    assert sinks.write_debug(df, f"file://{tmp_path}") == []
    assert spark.read.json(f"file://{tmp_path}/acme_nutrition").count() == 1


PAYLOAD = [
    {"Name": 1, "Recipes": 2, "Sections": 2, "SType": 3},
    " Mains ",
    [0, 4, 4, -1, 99],
    0,
    {"Name": 5, "Nutrs": 6, "Recipes": 10},
    "Pie",
    [7, 8],
    {"Desc": 9, "PerServ": 11},
    {"Desc": "Energy (kcal)", "PerServ": "250 kcal"},
    "Protein (g)",
    [12],
    "12.5",
    {"Name": 13, "Nutrs": 6},
    "Hidden",
]


def test_reference_documents(spark):
    docs = spark.createDataFrame([("d", json.dumps(PAYLOAD)), ("e", "[]"), ("f", "no json"), ("g", None), ("h", '{"a": 1}')], "doc_id string, json string")
    entries = references.decode(docs)
    assert {r["doc_id"] for r in entries.collect()} <= {"d"}
    got = {(r["name"], r["category"], r["calories"], r["protein"], r["fat"], r["status"]) for r in references.menu(docs).collect()}
    # an item ends the walk through categories: what hangs below it has none
    assert got == {("Pie", "Mains", 250.0, 12.5, 0.0, "ok"), ("Hidden", None, 250.0, 12.5, 0.0, "ok")}
    drinks = references.names_below(entries, "Mains", ("Name", "Recipes", "Sections"))
    assert {r["item"] for r in drinks.collect()} == {"pie", "hidden"}


def forest(spark, groups, options, formats=(("Bowl", ["g"]),), **kw):
    g = spark.createDataFrame(groups, "group_id string, name string, least int, most int")
    o = spark.createDataFrame(options, "group_id string, ord int, name string, group_ids array<string>")
    f = spark.createDataFrame(formats, "format string, group_ids array<string>")
    aliases = spark.createDataFrame([("Rice", "White"), ("Beans", "Black")], "option string, ingredient string")
    ingredients = spark.createDataFrame([("White", 10.0, 1.0, 2.0, 3.0), ("Black", 20.0, 1.0, 2.0, 3.0)], "ingredient string, calories double, protein double, fat double, carbs double")
    return tree.build_forest(f, g, o, aliases, ingredients, **kw)


def test_forest(spark):
    groups, choices = forest(spark, [("g", "Base", 1, 1), ("h", "Side", 2, 2), ("x", "extra", 1, 1)], [("g", 0, "Rice 🌱", ["h", "x", "none"]), ("g", 1, "Veggie", ["h"]), ("g", 2, "No Rice", []), ("h", 0, "Beans", [])], [("Bowl", ["x", "g", "none"]), ("Wrap", ["g"])])
    assert sorted((r["format"], r["label"], r["selection"], r["count"]) for r in groups.collect()) == [(f, *g) for f in ("Bowl", "Wrap") for g in (("Base", "one", None), ("Side", "exactly", 2))]
    assert sorted((r["label"], r["calories"]) for r in choices.where("format = 'Bowl'").collect()) == [("Beans", 20.0), ("No Rice", 0.0), ("Rice", 10.0)]
    meals = tree.expand(groups.select("group_id", "parent_choice_id", "ord", "label", "selection", "count"), choices.drop("format"), "protein")
    # two of one side is none, so only the plate without rice is left
    assert [r["labels"] for r in meals.collect()] == [["No Rice"]] * 2


@pytest.mark.parametrize("tops", [[], ["g", "h"], ["none"], None])
def test_other_than_one_root_is_an_error(spark, tops):
    with pytest.raises(Exception, match="one group is expected at the top of Bowl"):
        forest(spark, [("g", "Base", 1, 1), ("h", "Side", 1, 1)], [("g", 0, "Rice", [])], [("Bowl", tops)])


def test_cycles_and_unknown_options_are_errors(spark):
    with pytest.raises(ValueError, match="deeper than 8 groups at Base"):
        forest(spark, [("g", "Base", 1, 1)], [("g", 0, "Rice", ["g"])])
    with pytest.raises(Exception, match="unknown option Mystery"):
        forest(spark, [("g", "Base", 1, 1)], [("g", 0, "Mystery", [])])[1].collect()


TEXTS = {
    "Calories Carbs Fat Protein\nRemaining 1,500 200 50 120": ("table", 1500, 120, 200, 50),
    "REMAINING 1,500 200 50 120 2,300 30": ("table", 1500, 120, 200, 50),
    "Protein  Fat\n80 g left 10g left\nCalories\nremaining\n\n900": ("card", 900, 80, None, 10),
    "Calories\n1\nCarbs\n5 / 3\nfat 70 100": ("card", 1, None, 0, 30),
    "Calories\na\nb\nc\n100 left": ("card", None, None, None, None),
    "fat and carbs": ("card", None, None, None, None),
    " \r\n ": ("card", None, None, None, None),
    None: ("card", None, None, None, None),
}


def test_screenshots(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "n int, text string")
    got = {r["n"]: (r["layout"], *(r[t] for t in screenshots.TARGETS)) for r in screenshots.read_targets(df).collect()}
    assert got == dict(enumerate(TEXTS.values()))


def test_accepted_rows_of_tables(spark):
    cell = lambda x, y, s, h=9.0: ("d", 1, float(x), float(y), h, s)
    cells = [cell(20, 700, "Name"), cell(100, 700, "kcal"), cell(160, 700, "fat"), cell(20, 740, "Menu", 20.0), cell(20, 650, "Pie"), cell(100, 650, "5"), cell(20, 600, "Dip"), cell(100, 600, "7")]
    df = spark.createDataFrame(cells, "doc_id string, page int, x double, y double, height double, str string")
    patterns = {"name": "^Name$", "calories": "^kcal$", "fat": "^fat$"}
    assert layout.assemble_tables(df, patterns).count() == 2
    keep = filters.in_scope(F.col("title"), F.col("row")["name"], "(?i)menu", r"(?i)\bdip\b")
    assert [r["row"]["name"] for r in layout.assemble_tables(df, patterns, accept=keep).collect()] == ["Pie"]


def test_registry_without_anything_scanned(spark):
    registry = spark.createDataFrame([(1, "A", "Acme", "live", None), (2, "B", "Bistro", "snapshot", "2026-01-01")], "ord int, key string, restaurant string, source string, taken_at string")
    none = spark.createDataFrame([], "key string, item_seq long, name string, category string, calories double, protein double, fat double, carbs double")
    builds = snapshots.build_rows(spark.createDataFrame([], "key string, ord int, format string"))
    got = snapshots.listed_snapshots(registry, none, builds, spark.createDataFrame([], f"key string, items {snapshots.ITEM}, updated_at string"), "now").orderBy("ord").collect()
    assert [(r["key"], r["updated_at"], r["items"], r["fresh"]) for r in got] == [("A", "now", [], False), ("B", "2026-01-01", [], False)]


OPTION = "option string, seat int"
ALIAS = "option string, ingredient string"
PART = "ingredient string, calories double, protein double, fat double, carbs double"


def resolved(spark, options):
    aliases = spark.createDataFrame([("Rice", "White Rice"), ("Steak", "Beef"), ("Lost", "Nowhere")], ALIAS)
    parts = spark.createDataFrame([("White Rice", 210.0, 4.0, 4.0, 40.0), ("Beef", 150.0, 21.0, 6.0, 1.0)], PART)
    return compose.resolve_options(spark.createDataFrame(options, OPTION), aliases, parts, ["No Rice"], ["Veggie"])


def test_options_by_alias(spark):
    found = resolved(spark, [("Rice 🌱", 1), (" Steak", 2), ("No  Rice", 3), ("Veggie", 4), ("Rice", 1), ("Rice", 1)])
    rows = sorted((r["seat"], r["option"], r["ingredient"], r["calories"], r["carbs"]) for r in found.where("ingredient is not null").collect())
    assert rows == [(1, "Rice", "White Rice", 210.0, 40.0)] * 2 + [(1, "Rice 🌱", "White Rice", 210.0, 40.0), (2, " Steak", "Beef", 150.0, 1.0)]
    assert [tuple(r) for r in found.where("ingredient is null").collect()] == [("No  Rice", 3, None, 0.0, 0.0, 0.0, 0.0)]
    assert resolved(spark, []).count() == 0


@pytest.mark.parametrize(("option", "told"), [("Tofu 🌱", "unknown option Tofu 🌱, it has no alias"), ("Lost", "unknown option Lost, there is no ingredient Nowhere"), (None, "unknown option null, it has no alias"), ("steak", "unknown option steak, it has no alias")])
def test_options_that_lead_nowhere(spark, option, told):
    with pytest.raises(Exception, match=told):
        resolved(spark, [("Rice", 1), (option, 2)]).collect()


def test_cache_and_index_are_read_back(spark, tmp_path):
    items = spark.createDataFrame([("A", "x", "Mains"), ("A", "y", None), ("A", "x", "Sides"), ("B", "z", "Mains")], "restaurant string, name string, category string")
    sinks.write_index(items, f"file://{tmp_path}/index", "2024-01-02T00:00:00Z")
    index = {r["restaurant"]: r for r in spark.read.json(f"file://{tmp_path}/index").collect()}
    assert {k: (r["item_count"], r["names"], r["categories"]) for k, r in index.items()} == {"A": (3, 2, ["Mains", "Sides"]), "B": (1, 1, ["Mains"])}
    assert {r["generated_at"] for r in index.values()} == {"2024-01-02T00:00:00Z"}
    day = 86_400_000
    sinks.write_cache(items, f"file://{tmp_path}/cache", 10 * day)
    cache = spark.read.parquet(f"file://{tmp_path}/cache")
    assert loaders.fresh(cache, 17 * day - 1).drop("saved_at").exceptAll(items).isEmpty() and cache.count() == 4
    assert loaders.fresh(cache, 17 * day).isEmpty()
    sinks.write_cache(items.where("restaurant = 'B'"), f"file://{tmp_path}/cache", 20 * day)
    assert spark.read.parquet(f"file://{tmp_path}/cache").count() == 1
    sinks.write_snapshots(items, f"file://{tmp_path}/menus")
    assert sorted(os.listdir(tmp_path / "menus"))[-2:] == ["restaurant=A", "restaurant=B"]
    assert spark.read.json(f"file://{tmp_path}/menus").where("restaurant = 'A'").count() == 3


def test_names_of_a_family(spark):
    rows = spark.createDataFrame([("Pie", True), ("Pie (Large)", True), ("Pie (a) (b)", True), ("Pies (Large)", False), ("Pie (Large", False), ("Pie ()", False), ("Pie(Large)", False), ("", False)], "name string, member boolean")
    assert [r["name"] for r in rows.where(exprs.in_family(F.col("name"), F.lit("Pie")) != F.col("member")).collect()] == []


def test_a_section_is_not_repeated_for_its_items(spark):
    """Each of n rows carried all n items of its section."""
    from platefold.sources import adapters

    facts = {m: "1" for m in ("calories", "protein", "fat", "carbs")}
    doc = {"sections": [{"title": "MAINS", "items": [{"type": "item", "name": f"n{k}", "facts": facts, "options": [{"name": "o", "facts": facts}] if k == 1 else None} for k in range(3)]}]}
    found = adapters.cms_items(spark.createDataFrame([("d", json.dumps(doc))], "doc_id string, json string"))
    assert [(r["seq"], r["name"], r["category"]) for r in found.orderBy("seq").collect()] == [(1, "n0", "Mains"), (2, "o", "Mains"), (3, "n2", "Mains")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    inner = [line for line in plan.splitlines() if "Generate posexplode" in line and "items" in line and "from_json" not in line]
    assert inner and all(".items" not in line.split("posexplode")[1].split("]")[0] for line in inner)


def test_places_of_groups_are_counted_as_they_are_made(spark):
    """Groups under many options: the counts took all places, of all choices, before."""
    groups = [("g", "Base", 1, 1), ("h", "Side", 2, 2), ("k", "Top", 0, 3), ("x", "extra", 1, 1)]
    options = [("g", n, "Rice", ["h", "k", "h", "x"]) for n in range(4)] + [("h", n, "Beans", ["k"]) for n in range(3)] + [("k", 0, "Rice", []), ("g", 9, "Veggie", ["h"])]
    g = spark.createDataFrame(groups, "group_id string, name string, least int, most int")
    o = spark.createDataFrame(options, "group_id string, ord int, name string, group_ids array<string>")
    f = spark.createDataFrame([("Bowl", ["g"]), ("Wrap", ["h"])], "format string, group_ids array<string>")
    made = forest(spark, groups, options, [("Bowl", ["g"]), ("Wrap", ["h"])])[0].groupBy("format", "label", "selection").count().collect()
    counted = tree.group_places(f, g, o).groupBy("format", "label", "selection").agg(F.sum("places").alias("n")).collect()
    assert sorted(map(tuple, counted)) == sorted(map(tuple, made)) == [("Bowl", "Base", "one", 1), ("Bowl", "Side", "exactly", 8), ("Bowl", "Top", "many", 28), ("Wrap", "Side", "exactly", 1), ("Wrap", "Top", "many", 3)]
    deep = spark.createDataFrame([("g", 0, "Rice", ["g"])] * 1000, o.schema)
    with pytest.raises(ValueError, match="deeper than 8 groups at Base"):
        tree.group_places(f.where("format = 'Bowl'"), g, deep).collect()  # 1000 to the ninth places


@pytest.mark.parametrize("kept", [1, 20, 1000])
def test_large_levels_of_a_forest_are_not_stored(spark, monkeypatch, kept):
    """The places of every level were written, as many as the power of the depth."""
    written = []
    monkeypatch.setattr(tree, "PLACES_KEPT", kept, raising=False)
    monkeypatch.setattr(tree, "settle", lambda df: written.append(settle(df)) or written[-1])
    groups = [(g, g, 1, 1) for g in "ghk"]
    options = [(g, n, "Rice", [under] if under else []) for g, under in zip("ghk", ["h", "k", None], strict=True) for n in range(8)]
    made_groups, choices = forest(spark, groups, options)
    ids = {f"Bowl:0/{a}" for a in range(8)} | {f"Bowl:0/{a}.0/{b}" for a in range(8) for b in range(8)} | {f"Bowl:0/{a}.0/{b}.0/{c}" for a in range(8) for b in range(8) for c in range(8)}
    assert sorted(r["choice_id"] for r in choices.collect()) == sorted(ids)
    assert made_groups.count() == made_groups.select("group_id").distinct().count() == 1 + 8 + 64
    assert max(df.count() for df in written if "path" in df.columns) == max(n for n in (1, 8, 64) if n <= kept)
