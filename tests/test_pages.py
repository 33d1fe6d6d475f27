"""Product pages, named families and glyph lines on small cases that the queries do not print."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from platefold.operators import layout, normalize, pages

CELLS = "doc_id string, page int, x double, x_end double, y double, height double, str string"


def cell(x, y, s, height=8.0, page=1):
    return ("d", page, float(x), float(x) + 8, float(y), float(height), str(s))


def figures(y, x=100, n=16, first=0, page=1):
    values = [100, 400, 5, 4, 1, 11, 2, 3, 0.1, 0.3, 200, 100, 200, 100, 2, 1]
    return [cell(x + 14 * k, y, v, page=page) for k, v in enumerate(values[first : first + n])]


def head(page=1, title="Dish", y=450):
    return [cell(100, y, pages.PER_100, 6, page), cell(300, y - 10, "VALUES PER PORTION", 6, page), cell(110, 500, title, 20, page)]


def read(spark, cells):
    rows = pages.read_pages(spark.createDataFrame(cells, CELLS)).collect()
    return sorted((r["page"], r["title"], r["label"], r["layout"], len(r["nums"])) for r in rows)


def test_labels_by_height_and_below(spark):
    cells = head() + figures(400) + figures(380) + figures(360)
    cells += [cell(20, 400, "Large"), cell(50, 400, "SO", 5)]  # a note of another height on the row
    cells += [cell(20, 374, "too far below"), cell(20, 380, "7", 5)]
    cells += [cell(20, 355, "Small"), cell(40, 355, "Thin", 4)]  # the height counts on the row itself alone
    assert read(spark, cells) == [(1, "Dish", "Large", "combined", 16), (1, "Dish", "Small Thin", "combined", 16), (1, "Dish", "Standard", "combined", 16)]


def test_only_row_needs_no_label(spark):
    assert read(spark, head() + figures(400) + [cell(20, 400, "Large")]) == [(1, "Dish", "Standard", "combined", 16)]


def test_pages_without_tables_banner_or_figures(spark):
    cells = [cell(110, 500, "Prose", 20, 1), *head(2, "Empty"), cell(50, 30, "DRINKS", 40, 3), *head(3, "Cola"), *figures(400, page=3)]
    assert read(spark, cells) == []
    assert read(spark, []) == []


def test_combined_headers_with_rows_on_two_levels(spark):
    """Headers side by side, but ten figures and six lie too far apart to be one line: read as stacked."""
    cells = head() + figures(400, n=10) + figures(380, n=6, first=10)
    assert read(spark, cells) == [(1, "Dish", "Standard", "stacked", 16)]


def test_fourteen_figures_are_not_sixteen(spark):
    assert read(spark, head() + figures(400, n=15)) == []


def test_clusters_and_labels_against_a_walk(spark):
    r = random.Random(2)
    rows = [(f"d{d}", p, float(r.randint(0, 60)) / 2, k) for d in range(5) for p in range(4) for k in range(25)]
    df = spark.createDataFrame(rows, "doc_id string, page int, y double, n int").withColumn("x", F.col("n"))
    got = {(x["doc_id"], x["page"], x["n"]): x["line"] for x in layout.cluster_lines(df, 3.0).collect()}
    for d, p in {(x[0], x[1]) for x in rows}:
        line, first = 0, None
        for _, _, y, n in sorted((x for x in rows if x[:2] == (d, p)), key=lambda x: -x[2]):
            if first is None or first - y > 3.0:
                line, first = line + 1, y
            assert got[d, p, n] == line


ITEMS = "restaurant string, item_seq long, name string, category string, calories double, protein double, fat double, carbs double"


def plain_names(rows):
    """Final names by looking through all names held so far."""
    held = {}
    for i, (_, seq, name, category, *macros) in enumerate(rows):
        family = [k for k in held if k == name or (k.startswith(name + " (") and k.endswith(")") and len(k) > len(name) + 3)]
        if any(rows[held[k]][4:] == tuple(macros) for k in family):
            continue
        first = held.get(name)
        if family and first is not None and rows[first][3] and category and rows[first][3] != category:
            del held[name]
            held[f"{name} ({rows[first][3]})"] = first
            held[f"{name} ({category})"] = i
        elif family:
            held[f"{name} ({next(n for n in range(2, 10_000) if f'{name} ({n})' not in held)})"] = i
        else:
            held[name] = i
    return {rows[i][1]: k for k, i in held.items()}


def test_families_in_parentheses_at_random(spark):
    r = random.Random(7)
    names = ["A", "A (2)", "A (x)", "A (x) (2)", "A ()", "A (x) y", "B", "B (3)", "AA", "A  (z)"]
    wanted, rows = {}, []
    for k in range(40):
        own = [(f"r{k}", 1000 * k + i, r.choice(names), r.choice([None, "", "x", "2", "3", "C"]), float(r.randint(1, 9)), 1.0, r.choice([None, 2.0]), 3.0) for i in range(60)]
        rows += own
        wanted |= plain_names(own)
    got = {x["item_seq"]: x["final_name"] for x in normalize.resolve_collisions(spark.createDataFrame(rows, ITEMS)).collect()}
    assert got == wanted


def test_variants_are_named_and_stamped(spark):
    df = spark.createDataFrame([("r", 1, "P", None, 1.0, 1.0, 1.0, 1.0, ("P", "Size", "S")), ("r", 2, "P", None, 2.0, 1.0, 1.0, 1.0, ("P", "Size", "S")), ("r", 3, "P (S)", None, 3.0, 1.0, 1.0, 1.0, None)], ITEMS + ", variant struct<base:string,label:string,option:string>")
    got = sorted((x["item_seq"], x["final_name"], x["variant_of"], x["variant_option"]) for x in normalize.add_variants(df).collect())
    assert got == [(1, "P (S)", "P", "S"), (2, "P (S) (2)", "P", "S"), (3, "P (S) (3)", None, None)]
