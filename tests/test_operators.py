"""Cases of the operators that the driver's tables do not hold."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from platefold.functions import exprs
from platefold.macros import MACROS, Target
from platefold.operators import compose, filters, layout, normalize, tree
from platefold.sources import loaders, sinks
from platefold.streaming import snapshots


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(f(F.col("s")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "plain", "mark", "whole"),
    [("1,408", 1408.0, 1.408, 1.408), ("-", None, None, None), ("about -2.5 g", -2.5, -2.5, None), (None, None, None, None), ("", None, None, None)],
)
def test_number_dialects(spark, text, plain, mark, whole):
    assert one(spark, text, exprs.parse_number) == plain
    assert one(spark, text, exprs.parse_decimal_mark) == mark
    assert one(spark, text, exprs.parse_whole_decimal_comma) == whole


def test_labels(spark):
    assert one(spark, "CHICK 'N' DIP", exprs.normalize_category) == "Chick 'N' Dip"
    assert one(spark, "Kid's Menu", exprs.normalize_category) == "Kid's Menu"
    assert one(spark, "  ", exprs.normalize_category) is None
    assert one(spark, "🌶 Hot  sauce", exprs.option_name) == "Hot sauce"
    assert one(spark, "/product/big-fries-large.html", exprs.base_slug) == "big-fries"
    assert one(spark, "elsewhere", exprs.base_slug) == "elsewhere"
    assert one(spark, 59.96, lambda c: exprs.remaining_text(c, F.lit(60), 1), "double") == "0.0 left"
    assert one(spark, 12.25, lambda c: exprs.clipboard_token(c, c, c, c), "double") == "MM1:12,12.3,12.3,12.3"
    assert one(spark, "Bowl — rice, beans", exprs.composed_labels) == ["rice", "beans"]
    assert one(spark, "Bowl", exprs.composed_labels) == []
    assert one(spark, "None", exprs.is_junk) and one(spark, "12.5", exprs.is_junk) and not one(spark, "Fresh", exprs.is_junk)
    assert one(spark, " a, ,b ", exprs.comma_list) == ["a", "b"]
    assert one(spark, " On ", exprs.truthy)
    assert one(spark, "#remaining=900,60.5,35,100", exprs.hash_targets)["protein"] == 60.5
    assert one(spark, "nothing", exprs.hash_targets) is None
    assert one(spark, 2.5, lambda c: exprs.round_half_up(-c), "double") == -2.0


@pytest.mark.parametrize(
    ("before", "after", "joined"),
    [("Plant-Bas", "ed", "Plant-Based"), ("Margheri-t", "astic", "Margheri-tastic"), ("BBQ Chicken", "and Bacon", "BBQ Chicken and Bacon"), ("Beef", "andouille", "Beef andouille"), ("", "x", "x")],
)
def test_wrapped_lines(spark, before, after, joined):
    df = spark.createDataFrame([(before, after)], "a string, b string")
    assert df.select(exprs.join_wrapped(F.col("a"), F.col("b"))).first()[0] == joined


def test_screenshot_rows(spark):
    assert one(spark, "120g / 200 10 / 40 5 / 9", lambda c: exprs.values_in_row(c, 3)) == [80, 30, 4]
    assert one(spark, "1,900 left 20g left", lambda c: exprs.values_in_row(c, 2)) == [1900, 20]
    assert one(spark, "10 30 5 25", lambda c: exprs.values_in_row(c, 2)) == [20, 20]
    assert one(spark, "calories carbs fat", lambda c: exprs.column_order(c, {"calories": "calories", "fat": "fat", "carbs": "carbs", "protein": "protein"})) == ["calories", "carbs", "fat"]


def test_null_categories_and_tags(spark):
    df = spark.createDataFrame([("a", "Sides", ["vegan"]), ("b", None, None)], "name string, category string, dietary array<string>")
    assert [r["name"] for r in filters.exclude_categories(df, ["SIDES"]).collect()] == ["b"]
    assert [r["name"] for r in filters.dietary(df, "vegan").collect()] == ["a"]
    assert filters.without_dishes(df, ["", "A"]).count() == 1


def test_presets_hit_and_miss(spark):
    cats = ["Sides & Dips", "Sweet Potato Fries", "Toppings", "Salads Includes Toppings", "Milkshakes", "Chicken", "Frosty"]
    g = spark.createDataFrame([("r", cats)], "restaurant string, categories array<string>")
    hit = {r["key"]: r["matched"] for r in filters.preset_matches(g).collect()}
    assert hit["sides"] == ["Sides & Dips", "Sweet Potato Fries", "Toppings"]
    assert hit["drinks"] == hit["desserts"] == ["Milkshakes"]
    assert "breakfast" not in hit
    none = spark.createDataFrame([("r", "all", [])], "restaurant string, mode string, categories array<string>")
    on = filters.toggle_preset(g, none, "drinks", True)
    assert on.first()["categories"] == ["Milkshakes"] and {r["key"]: r["active"] for r in filters.preset_active(g, on).collect()}["drinks"]
    off = filters.toggle_preset(g, on, "drinks", False).first()
    assert (off["mode"], off["categories"]) == ("all", [])


def test_unknown_ingredient_is_an_error(spark):
    lines = spark.createDataFrame([("d", "salt", 2.0)], "dish string, ingredient string, multiplier double")
    known = spark.createDataFrame([("oil", 1.0, 0.0, 1.0, 0.0)], "ingredient string, " + ", ".join(f"{m} double" for m in MACROS))
    with pytest.raises(Exception, match="unknown ingredient"):
        compose.recipe_totals(lines, known).collect()


def test_reconcile(spark):
    df = spark.createDataFrame([(628.0, 678.0), (390.0, 678.0), (100.0, None), (100.0, 0.0), (50.0, 50.0)], "calories double, stated_kcal double").withColumns({m: F.lit(10.0) for m in MACROS[1:]})
    got = [(r["outcome"], round(r["calories"], 6)) for r in compose.reconcile(df).collect()]
    assert got == [("anchored", 678.0), ("flagged", 390.0), ("unstated", 100.0), ("unstated", 100.0), ("exact", 50.0)]


def trees(spark, groups, choices):
    g = spark.createDataFrame(groups, "group_id string, parent_choice_id string, ord int, label string, selection string, count int")
    c = spark.createDataFrame([(*x, float(k), k / 10, 1.0, 1.0) for *x, k in choices], "choice_id string, group_id string, ord int, label string, calories double, protein double, fat double, carbs double")
    return g, c


@pytest.mark.parametrize(("selection", "count", "n", "combos"), [("one", None, 2, 2), ("many", None, 3, 1), ("exactly", 2, 3, 3), ("exactly", 3, 10, 10), ("exactly", 6, 10, 0), ("exactly", 0, 3, 1), ("one", None, 3, 3), ("one", None, 9, 3)])
def test_single_groups(spark, selection, count, n, combos):
    g, c = trees(spark, [("g", None, 1, "G", selection, count)], [(f"c{i}", "g", i, f"L{i}", 100 + 10 * i) for i in range(n)])
    assert tree.expand(g, c, "protein").count() == combos


def test_nested_groups_multiply(spark):
    g, c = trees(
        spark,
        [("a", None, 1, "A", "one", None), ("b", "a0", 1, "B", "one", None), ("c", "a0", 2, "C", "one", None)],
        [("a0", "a", 0, "x", 100), ("b0", "b", 0, "p", 10), ("b1", "b", 1, "q", 20), ("c0", "c", 0, "r", 1), ("c1", "c", 1, "s", 2)],
    )
    got = {tuple(r["labels"]): r["calories"] for r in tree.expand(g, c, "protein").where("group_id = 'a'").collect()}
    assert got == {("x", "p", "r"): 111, ("x", "p", "s"): 112, ("x", "q", "r"): 121, ("x", "q", "s"): 122}
    meals = spark.createDataFrame([("".join(x), list(x)) for x in got], "meal string, labels array<string>")
    picks = tree.resolve_labels(g, c, meals).collect()
    for labels in got:
        assert sorted(r["choice_id"] for r in picks if r["meal"] == "".join(labels)) == sorted({"x": "a0", "p": "b0", "q": "b1", "r": "c0", "s": "c1"}[x] for x in labels)


def test_labels_are_used_up(spark):
    """Two roots that both offer Rice and Beans: each takes its own labels."""
    g, c = trees(spark, [("a", None, 1, "A", "one", None), ("b", None, 2, "B", "exactly", 2), ("m", None, 3, "M", "many", None)], [("a0", "a", 0, "Rice", 1), ("a1", "a", 1, "Beans", 1), ("b0", "b", 0, "Rice", 1), ("b1", "b", 1, "Beans", 1), ("b2", "b", 2, "Corn", 1), ("m0", "m", 0, "Rice", 1)])
    meals = spark.createDataFrame([(1, ["Rice", "Beans", "Corn"]), (2, ["Beans", "Rice", "Beans"]), (3, []), (4, ["other"])], "meal int, labels array<string>")
    got = {(r["meal"], r["choice_id"]) for r in tree.resolve_labels(g, c, meals).collect()}
    assert got == {(1, "a0"), (1, "b1"), (1, "b2"), (2, "a1"), (2, "b0"), (2, "b1")}


def test_only_groups_under_picked_choices_are_asked(spark):
    g, _ = trees(spark, [("a", None, 1, "A", "one", None), ("b", "a0", 1, "B", "one", None)], [("a0", "a", 0, "x", 1)])
    picks = spark.createDataFrame([(1, "a", "a1", 5.0), (2, "a", "a0", 5.0), (3, "a", "a0", 5.0), (3, "b", "b0", 2.0), (4, "b", "b0", 9.0), (4, "a", "a1", 1.0)], "build int, group_id string, choice_id string, calories double")
    picks = picks.select("*", *(F.lit(1.0).alias(m) for m in ("protein", "fat", "carbs")))
    got = {r["build"]: (r["valid"], r["calories"]) for r in tree.valid_picks(g, picks, spark.range(1, 6).selectExpr("cast(id as int) build")).collect()}
    assert got == {1: (True, 5), 2: (False, 5), 3: (True, 7), 4: (True, 1), 5: (False, 0)}


def test_dominant_macro():
    assert tree.dominant_macro(Target(0, 177, 55, 235)) == "carbs"
    assert tree.dominant_macro(Target(0, 5, 5, 5)) == "protein"
    assert tree.dominant_macro(Target(0, 1, 5, 5)) == "fat"


def test_lines_are_anchored_to_their_first_glyph(spark):
    g = spark.createDataFrame([(1, 1, 5.0, 100.0), (1, 1, 1.0, 98.0), (1, 1, 2.0, 96.0), (1, 1, 3.0, 50.0)], "doc_id int, page int, x double, y double")
    got = {(r["x"]): r["line"] for r in layout.cluster_lines(g, 3.0).collect()}
    assert got == {5.0: 1, 1.0: 1, 2.0: 2, 3.0: 3}


def test_ingredient_lines(spark):
    v = ["1", "90,5", "2", "3", "4", "5", "6", "7", "8"]
    rows = [(1, 90.0, ["Rice", *v]), (1, 80.0, v), (1, 70.0, ["Beans"]), (1, 60.0, ["Rice", *v]), (1, 50.0, ["short", "1"])]
    got = [(r["name"], r["calories"], r["protein"], r["y"]) for r in layout.ingredient_rows(spark.createDataFrame(rows, "doc_id int, y double, texts array<string>")).orderBy(F.desc("y")).collect()]
    assert got == [("Rice", 90.5, 7.0, 90.0), ("Beans", 90.5, 7.0, 70.0)]


def test_headings_bound_rows(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["x", "START", "a", "b", "END", "c"])], "d int, i int, t string")
    got = layout.within_headings(df, "d", "i", F.col("t") == "START", F.col("t") == "END")
    assert [r["t"] for r in got.orderBy("i").collect()] == ["a", "b"]


def test_wrapped_rows_and_continuations(spark):
    lines = spark.createDataFrame([(1, 1, 100.0, True), (1, 1, 90.0, False), (1, 1, 80.0, False), (1, 1, 50.0, False), (1, 1, 40.0, True)], "doc_id int, page int, y double, anchor boolean")
    got = [r["row"] for r in layout.attach_wrapped(lines).orderBy(F.desc("y")).collect()]
    assert got[0] == got[1] == got[2] and got[3] is None and got[4] != got[0]
    cut = spark.createDataFrame([(1, 1, 100.0, 10), (1, 1, 96.0, 6), (1, 1, 60.0, 16)], "doc_id int, page int, y double, n_numbers int")
    assert [r["merged_into"] for r in layout.merge_continuations(cut).orderBy(F.desc("y")).collect()] == [None, 100.0, None]


def test_registry(spark):
    r = loaders.Registry()
    r.add("good", lambda s: s.createDataFrame([("g", 1, "x", None, 1.0, 1.0, 1.0, 1.0)], loaders.ITEM_SCHEMA), ("g",))
    r.add("bad", lambda s: s.read.parquet("/nowhere/at/all"))
    assert r.load(spark, "G").count() == 1 and r.load(spark, "none") is None and r.load(spark, "bad").count() == 0
    assert r.load_all(spark, {}).count() == 1 and r.enabled({"DISABLE_GOOD": "Yes"}) == ["bad"]


def test_fallback_and_decisions(spark):
    a, empty = spark.range(2), spark.range(0)
    assert loaders.first_that_has_rows(a, spark.range(5)).count() == 2
    assert loaders.first_that_has_rows(empty, spark.range(5)).count() == 5
    old = spark.createDataFrame([("k", "1", "x")], "key string, version string, content string")
    for v, c, d in (("1", "x", "unchanged"), ("1", "y", "refused"), ("2", "y", "replace")):
        assert loaders.changed_documents(old, spark.createDataFrame([("k", v, c)], old.schema)).first()["decision"] == d


def test_references(spark):
    rows = [(0, "a", 1, None), (0, "b", 2, None), (1, "x", None, "v"), (2, "y", 0, None), (2, "z", None, "w"), (9, "q", None, "no")]
    got = loaders.resolve_references(spark.createDataFrame(rows, "idx long, key string, ref long, value string"), 0)
    assert {(r["depth"], r["key"]) for r in got.collect()} == {(0, "a"), (0, "b"), (1, "x"), (1, "y"), (1, "z")}


def test_html_rows(spark):
    html = "<h2>Sides</h2><table><tr><th>Name</th><td> <b>Fries</b> </td></tr></table>"
    got = loaders.table_rows(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("pos").collect()
    assert got[0]["heading"] == "Sides" and got[1]["cells"] == ["Name", "Fries"]


def test_collision_order(spark):
    rows = [("r", 1, "a", "X", 1), ("r", 2, "a", "X", 1), ("r", 3, "a", "X", 2), ("r", 4, "a", "Y", 3), ("r", 5, "a", None, 4)]
    df = spark.createDataFrame([(*r[:4], float(r[4]), 1.0, 1.0, 1.0) for r in rows], "restaurant string, item_seq int, name string, category string, calories double, protein double, fat double, carbs double")
    got = {r["item_seq"]: r["final_name"] for r in normalize.resolve_collisions(df).collect()}
    assert got == {1: "a (X)", 3: "a (2)", 4: "a (Y)", 5: "a (3)"}


def test_collisions_with_taken_names_and_missing_macros(spark):
    rows = [(1, "a", 100, None, 5), (2, "a (2)", 7, 1, 1), (3, "a", 100, 5, None), (4, "a", 7, 1, 1), (5, "a", 100, None, 5), (6, "a (2)", 8, 1, 1), (7, "b", 100, None, 5), (8, "b", 100, 5, None), (9, "b", 100, None, 5)]
    df = spark.createDataFrame([("r", k, n, None, float(x), y and float(y), z and float(z), 1.0) for k, n, x, y, z in rows], "restaurant string, item_seq int, name string, category string, calories double, protein double, fat double, carbs double")
    got = {r["item_seq"]: r["final_name"] for r in normalize.resolve_collisions(df).collect()}
    assert got == {1: "a", 2: "a (2)", 3: "a (3)", 6: "a (2) (2)", 7: "b", 8: "b (2)"}


def test_snapshots_keep_the_last_good(spark, tmp_path):
    schema = "restaurant string, items array<string>, updated_at string"
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    spark.createDataFrame([("a", ["x"], "1"), ("b", ["y"], "1")], schema).coalesce(1).write.parquet(src)
    run = lambda: snapshots.upsert_snapshots(spark.readStream.schema(schema).parquet(src), out, cp).awaitTermination()
    run()
    spark.createDataFrame([("a", [], "2"), ("b", ["z"], "2")], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    got = {r["restaurant"]: (r["items"], r["updated_at"]) for r in snapshots.read_snapshots(spark, out).collect()}
    assert got == {"a": (["x"], "1"), "b": (["z"], "2")}
    sinks.write_snapshots(spark.createDataFrame([("a", "n")], "restaurant string, name string"), str(tmp_path / "snap"))
    assert spark.read.json(str(tmp_path / "snap")).count() == 1


def test_cart_ignores_taking_away_what_is_not_there(spark):
    from platefold.operators import cart

    rows = [("u", 1, "a", "x", -1), ("u", 2, "a", "x", 1), ("u", 3, "a", "x", 1), ("u", 4, "b", "y", -1), ("u", 5, "a", "z", 1), ("u", 6, "a", "z", -1), ("v", 1, "a", "x", 1), ("v", 2, "b", "y", 1), ("v", 3, "b", "y", 1)]
    got = {(r["user_id"], r["name"]): r["qty"] for r in cart.fold(spark.createDataFrame(rows, "user_id string, seq int, restaurant string, name string, delta int")).collect()}
    assert got == {("u", "x"): 2, ("v", "y"): 2}


def test_tables_from_glyphs(spark):
    head = [("Item", 10.0), ("kcal", 100.0), ("Protein", 150.0), ("Fat", 200.0)]
    cells = [(1, 1, 10.0, 700.0, 18.0, "Mains")] + [(1, 1, x, 680.0, 8.0, s) for s, x in head]
    cells += [(1, 1, 10.0, 660.0, 8.0, "Plant-Bas"), (1, 1, 99.0, 661.0, 8.0, "300"), (1, 1, 152.0, 660.0, 8.0, "20"), (1, 1, 10.0, 650.0, 8.0, "ed burger"), (1, 1, 10.0, 600.0, 8.0, "stray note")]
    cells += [(1, 2, x, 680.0, 8.0, s) for s, x in head] + [(1, 2, 10.0, 660.0, 8.0, "Wrap"), (1, 2, 101.0, 660.0, 8.0, "250")]
    cells += [(1, 2, 10.0, 600.0, 18.0, "Sides")] + [(1, 2, x, 580.0, 8.0, s) for s, x in head] + [(1, 2, 10.0, 560.0, 8.0, "Chips"), (1, 2, 60.0, 560.0, 8.0, "far"), (1, 2, 101.0, 560.0, 8.0, "400")]
    df = spark.createDataFrame(cells, "doc_id int, page int, x double, y double, height double, str string")
    roles = {"name": "(?i)^item$", "calories": "(?i)kcal", "protein": "(?i)protein", "fat": "(?i)^fat$"}
    got = [(r["table_id"], r["title"], dict(r["row"])) for r in layout.assemble_tables(df, roles).orderBy("page", F.desc("y")).collect()]
    assert got == [
        (1, "Mains", {"name": "Plant-Based burger", "calories": "300", "protein": "20"}),
        (1, "Mains", {"name": "Wrap", "calories": "250"}),
        (2, "Sides", {"name": "Chips", "calories": "400"}),
    ]


def test_rotated_labels(spark):
    frags = [(1, 50.0, 40.0, 60.0, 2.0, "Dips"), (1, 52.0, 41.0, 62.0, 1.0, "Hot"), (1, 20.0, 10.0, 30.0, 1.0, "Sides")]
    df = spark.createDataFrame(frags, "page int, cy double, lo double, hi double, x double, str string")
    got = [(r["label"], r["cy"], r["lo"], r["hi"]) for r in layout.merge_labels(df, ["page"], 8.0).orderBy("label_id").collect()]
    assert got == [("Hot Dips", 51.0, 40.0, 62.0), ("Sides", 20.0, 10.0, 30.0)]
