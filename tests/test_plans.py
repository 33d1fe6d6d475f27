"""What plans must not do as tables grow: shuffle a page's cells again, carry a whole list with each entry, read a line again for each use."""

from __future__ import annotations

from platefold.operators import pages
from platefold.sources import references, screenshots
from tests.test_pages import CELLS, figures, head


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan()


def walk(node):
    yield node
    children = node.children()
    for k in range(children.size()):
        yield from walk(children.apply(k))


def test_cells_of_a_page_are_shuffled_once(spark):
    rows = pages.read_pages(spark.createDataFrame(head() + figures(400), CELLS))
    assert rows._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_entries_do_not_carry_their_node(spark):
    docs = spark.createDataFrame([("d", '[{"a": 1}, [0, 1], "x"]')], "doc_id string, json string")
    made = [n for n in walk(optimized(references.decode(docs))) if n.nodeName() == "Generate"]
    carried = [n.requiredChildOutput().mkString(",") for n in made]
    assert len(made) == 2
    assert [c for c in carried if "node" in c or "payload" in c] == []


def test_a_near_line_is_looked_for_once(spark):
    texts = spark.createDataFrame([("Calories\n5 left",)], "text string")
    plan = str(screenshots.read_targets(texts)._jdf.queryExecution().optimizedPlan().toString())
    assert plan.count("slice(") <= 2 * len(screenshots.TARGETS)


def test_documents_are_parsed_in_pieces(spark):
    """The places of a whole document were held at once as rows."""
    flat = "[" + ",".join(f'{{"a":{i}}},[{i},"x"],"v{i}"' for i in range(700)) + "]"
    docs = spark.createDataFrame([("flat", flat), ("deep", "[" * 3 + "1" + "]" * 3), ("twice", flat[:-1] + ',{"a":1,"a":2}]'), ("cut", flat[:-1])], "doc_id string, json string")
    entries = references.decode(docs)
    plan = optimized(entries).toString()
    assert "Generate variant_explode(json" not in plan and "aggregate" not in plan.lower()
    rows = {}
    for r in entries.collect():
        rows.setdefault(r["doc_id"], []).append((r["idx"], r["kind"], r["key"], r["ord"], r["ref"], r["value"]))
    each = [row for i in range(700) for row in ((3 * i, "object", "a", 0, i, None), (3 * i + 1, "array", None, 0, i, None), (3 * i + 1, "array", None, 1, None, "x"), (3 * i + 2, "value", None, None, None, f"v{i}"))]
    assert sorted(rows.pop("flat"), key=lambda r: (r[0], r[3] or 0)) == each
    assert [r[:2] for r in rows.pop("deep")] == [(0, "array")] and not rows
    longest = max(r["n"] for r in references._pieces(docs.where("doc_id = 'flat'"), "json").selectExpr("length(piece) as n").collect())
    assert longest * 5 < len(flat)
