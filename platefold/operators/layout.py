"""Tables from positioned text: lines, columns, sections, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import join_wrapped

COLUMN_TOLERANCE = 26


def first_of_groups(values: Column, joins) -> Column:
    """Of values in descending order those that begin a group: one that does not join the group's first value begins the next."""
    last = lambda acc: F.get(acc, F.size(acc) - 1)
    return F.aggregate(values, F.array().cast("array<double>"), lambda acc, v: F.when(F.coalesce(joins(last(acc), v), F.lit(False)), acc).otherwise(F.concat(acc, F.array(v))))


def _grouped_down(rows: DataFrame, page: list[str], at: str, joins, out: str) -> DataFrame:
    """``rows`` with ``out``: the number of their group, counted from 1 down each page by ``at``. A page's different values are folded once."""
    values = F.sort_array(F.collect_set(F.col(at).cast("double")), asc=False)
    heads = rows.groupBy(*page).agg(first_of_groups(values, joins).alias("_heads"))
    return rows.join(heads, page).withColumn(out, F.size(F.filter("_heads", lambda h: h >= F.col(at))).cast("long")).drop("_heads")


def cluster_lines(glyphs: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Glyphs (doc_id, page, x, y, ...) with ``line``, counted from 1 down each page.

    From the top, a line takes all that lies within ``tolerance`` of its first baseline: a
    distance to the line's first glyph, not to the last one.
    """
    return _grouped_down(glyphs, ["doc_id", "page"], "y", lambda first, y: first - y <= tolerance, "line")


def nearest_column(cells: DataFrame, columns: DataFrame, x: str = "x", tolerance: float = COLUMN_TOLERANCE) -> DataFrame:
    """Cells with ``role``: the column (role, anchor, ord) nearest within ``tolerance``, the first of equals, or null.

    ``columns`` may have a doc_id: then a document's cells go to its own columns, else all to the
    same.  A header is one row, with its columns as an array.
    """
    own = ["doc_id"] if "doc_id" in columns.columns else []
    heads = columns.groupBy(*own).agg(F.collect_list(F.struct(F.col("anchor").cast("double").alias("anchor"), "ord", "role")).alias("_heads"))
    both = cells.join(heads, own, "left") if own else cells.crossJoin(F.broadcast(heads))  # one row
    near = F.transform("_heads", lambda h: F.struct(F.abs(F.col(x) - h["anchor"]).alias("d"), h["ord"].alias("o"), h["role"].alias("role")))
    return both.withColumn("role", F.array_min(F.filter(near, lambda c: c["d"] <= tolerance))["role"]).drop("_heads")


def best_grid(cells: DataFrame, grids: DataFrame, line: list[str], tolerance: float = COLUMN_TOLERANCE) -> DataFrame:
    """(line, grid, hits): for each line the grid that most of its cells fall into; the first of equals.

    ``grids`` is (grid, grid_ord, ord, anchor).  Cells and anchors meet by strips of x as wide as the
    tolerance: an anchor lies in its own and in both next to it.
    """
    strip = lambda c: F.floor(c / F.lit(float(tolerance)))
    at = grids.select("grid", "grid_ord", F.col("ord").alias("_ord"), "anchor", F.explode(F.array(*(strip(F.col("anchor")) + k for k in (-1, 0, 1)))).alias("_strip"))
    hit = cells.select(*line, F.col("x").alias("_x"), strip(F.col("x")).alias("_strip")).join(at, "_strip").where(F.abs(F.col("_x") - F.col("anchor")) <= tolerance)
    counts = hit.groupBy(*line, "grid", "grid_ord").agg(F.count_distinct("_ord").alias("hits"))
    return counts.groupBy(*line).agg(F.max_by(F.struct("grid", "hits"), F.struct("hits", -F.col("grid_ord"))).alias("b")).select(*line, "b.grid", "b.hits")


def cells_to_columns(cells: DataFrame, line: list[str]) -> DataFrame:
    """(line, row): a map from role to the text of its cells from left to right; blanks are skipped."""
    kept = cells.where(F.col("role").isNotNull() & (F.trim("str") != ""))
    text = kept.groupBy(*line, "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", F.trim("str").alias("s")))), lambda c: c["s"]), " ").alias("text"))
    return text.groupBy(*line).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "text")))).alias("row"))


def is_header(labels: Column, patterns: dict[str, str], least: int = 3) -> Column:
    """Every label of a line matches a pattern (the first that does gives its role), and ``least`` roles occur."""

    def role(label):
        out = F.when(F.lit(False), F.lit(""))
        for r, p in patterns.items():
            out = out.when(label.rlike(p), r)
        return out

    roles = F.transform(labels, role)
    return F.forall(roles, lambda r: r.isNotNull()) & (F.size(F.array_distinct(roles)) >= least)


def attach_wrapped(lines: DataFrame, max_gap: float = 14.0) -> DataFrame:
    """Add ``row``: lines that begin one (anchor) start it, and those within ``max_gap`` below the last line continue it.

    ``lines`` is (doc_id, page, y, anchor boolean).  Lines that belong to no row get null.
    """
    w = Window.partitionBy("doc_id", "page").orderBy(F.desc("y"))
    gap = F.lag("y").over(w) - F.col("y")
    broken = F.coalesce(~F.col("anchor") & ((gap <= 0) | (gap > max_gap)), F.lit(False))
    marked = lines.withColumn("_b", (F.col("anchor") | broken).cast("int")).withColumn("_g", F.sum("_b").over(w))
    group = Window.partitionBy("doc_id", "page", "_g").orderBy(F.desc("y"))
    return marked.withColumn("row", F.when(F.first("anchor").over(group), F.col("_g"))).drop("_b", "_g")


def merge_continuations(lines: DataFrame) -> DataFrame:
    """Add ``merged_into``: the y of the line above for the second half of a row of 14 to 16 numbers.

    ``lines`` is (doc_id, page, y, n_numbers); the halves lie at most 6 apart.  Of three lines in
    a row the first two are taken.
    """
    w = Window.partitionBy("doc_id", "page").orderBy(F.desc("y"))
    up_y, up_n = F.lag("y").over(w), F.lag("n_numbers").over(w)
    gap, total = up_y - F.col("y"), up_n + F.col("n_numbers")
    ok = F.coalesce((up_n >= 6) & (up_n < 14) & (gap > 0) & (gap <= 6) & (F.col("n_numbers") >= 2) & (F.col("n_numbers") < 14) & total.between(14, 16), F.lit(False))
    marked = lines.withColumn("_ok", ok)
    free = ~F.coalesce(F.lag("_ok").over(w), F.lit(False))
    return marked.withColumn("_up", up_y).withColumn("merged_into", F.when(F.col("_ok") & free, F.col("_up"))).drop("_ok", "_up")


def split_by_gap(cells: DataFrame, line: list[str], least: float) -> DataFrame:
    """Add ``part``: 1 before and 2 after the widest gap over ``least`` between neighbours; the first of equals."""
    w = Window.partitionBy(*line).orderBy("x")
    gapped = cells.withColumn("_gap", F.col("x") - F.lag("x_end").over(w))
    at = F.max_by("x", F.struct("_gap", -F.col("x"))).over(Window.partitionBy(*line))
    widest = F.max("_gap").over(Window.partitionBy(*line))
    return gapped.withColumn("part", F.when((widest > least) & (F.col("x") >= at), 2).otherwise(1)).drop("_gap")


def strip_outliers(cells: DataFrame, line: list[str], gap: float = 80.0) -> DataFrame:
    """Without leading cells that lie more than ``gap`` before the next one."""
    w = Window.partitionBy(*line).orderBy("x")
    after = F.lead("x").over(w) - F.col("x_end")
    stays = F.coalesce(after <= gap, F.lit(True)).cast("int")
    return cells.withColumn("_s", stays).withColumn("_s", F.max("_s").over(w)).where("_s = 1").drop("_s")


def label_for_span(spans: DataFrame, labels: DataFrame, page: list[str]) -> DataFrame:
    """Spans (page, span_id, lo, hi) with ``label``: one whose centre lies inside (2 to spare), else the nearest.

    Labels (page, ord, cy, label) of a page are few; the join is by page.
    """
    both = spans.join(labels, page, "left")
    inside = F.col("cy").between(F.col("lo") - 2, F.col("hi") + 2)
    far = F.least(F.abs(F.col("cy") - F.col("lo")), F.abs(F.col("cy") - F.col("hi")))
    order = F.struct(F.when(inside, 0).otherwise(1).alias("a"), F.when(inside, F.lit(0.0)).otherwise(far).alias("b"), F.col("ord").alias("c"))
    return both.groupBy(*page, "span_id").agg(F.min_by("label", order).alias("label"))


def section_bounds(labels: DataFrame, page: list[str]) -> DataFrame:
    """(page, ord, label, lower): sections that tile a page, each centre bisecting its own.

    ``labels`` is (page, cy, label, top_y).  From the top, lower = 2 * centre - upper; the last
    section is open.  The recurrence is folded over the page's few labels in order.
    """
    listed = labels.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct("cy", "label")), asc=False).alias("s"), F.max("top_y").alias("top"))
    start = F.array(F.struct(F.lit("").alias("label"), F.col("top").cast("double").alias("lower")))
    folded = F.aggregate("s", start, lambda acc, x: F.concat(acc, F.array(F.struct(x["label"].alias("label"), (2 * x["cy"] - F.element_at(acc, -1)["lower"]).cast("double").alias("lower")))))
    each = listed.select(*page, F.posexplode(F.slice(folded, 2, 10_000)).alias("ord", "x"), F.size("s").alias("n"))
    return each.select(*page, "ord", "x.label", F.when(F.col("ord") == F.col("n") - 1, F.lit(float("-inf"))).otherwise(F.col("x.lower")).alias("lower"))


def section_of(rows: DataFrame, sections: DataFrame, page: list[str], key: list[str]) -> DataFrame:
    """(key, label): the first section from the top whose lower bound a row's y clears."""
    both = rows.join(sections, page).where("y >= lower")
    return both.groupBy(*key).agg(F.min_by("label", "ord").alias("label"))


def merge_labels(frags: DataFrame, page: list[str], gap: float) -> DataFrame:
    """Labels of rotated fragments (page, cy, lo, hi, x, str): (page, label_id, cy, lo, hi, label).

    From the top, a fragment joins the label whose first fragment is nearer than ``gap``; first
    fragments lie ``gap`` apart, so there is one at most.
    """
    marked = _grouped_down(frags, page, "cy", lambda first, cy: first - cy < gap, "label_id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "str"))), lambda c: c["str"]), " ")
    return marked.groupBy(*page, "label_id").agg(F.avg("cy").alias("cy"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), text.alias("label"))


def heading_height(cells: DataFrame, doc: str) -> DataFrame:
    """(doc, least): the most frequent glyph height, in half points, and 1.5 more; the first seen of equals."""
    bucket = F.floor(F.col("height") * 2 + 0.5) / 2
    counts = cells.groupBy(doc, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    return counts.groupBy(doc).agg((F.max_by("bucket", F.struct("n", -F.col("first"))) + 1.5).alias("least"))


def sequence_count(cells: DataFrame, line: list[str], words: list[str]) -> DataFrame:
    """(line, n): how often ``words`` follow each other from left to right."""
    w = Window.partitionBy(*line).orderBy("x")
    hit = F.col("str") == words[0]
    for k, word in enumerate(words[1:], 1):
        hit &= F.coalesce(F.lead("str", k).over(w) == word, F.lit(False))
    return cells.withColumn("_h", hit).groupBy(*line).agg(F.count_if("_h").alias("n"))


def ingredient_rows(lines: DataFrame) -> DataFrame:
    """(doc_id, y, name, calories, protein, fat, carbs) of lines (doc_id, y, texts array) with nine values or more.

    A line with values and no name belongs to the name-only line after it.  The values are kJ,
    kcal, fat, saturates, carbs, sugars, fibre, protein, salt; rows without calories go, and of
    a name's repeats the first stays.
    """
    numeric = lambda t: t.rlike(r"^-?\d+([.,]\d+)?$")
    at = F.coalesce(F.array_position(F.transform("texts", numeric), F.lit(True)), F.lit(0)).cast("int")
    split = lines.withColumn("_at", at)
    names = F.when(F.col("_at") == 0, F.col("texts")).otherwise(F.slice("texts", F.lit(1), F.col("_at") - 1))
    values = F.when(F.col("_at") > 0, F.transform(F.filter(F.slice("texts", F.greatest("_at", F.lit(1)), F.size("texts")), numeric), lambda t: F.translate(t, ",", ".").cast("double"))).otherwise(F.array().cast("array<double>"))
    parts = split.select("doc_id", "y", F.trim(F.array_join(names, " ")).alias("name"), values.alias("v"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("y"))
    orphan = (F.lag("name").over(w) == "") & (F.size(F.lag("v").over(w)) >= 9)
    joined = parts.withColumn("v", F.when((F.size("v") == 0) & orphan, F.lag("v").over(w)).otherwise(F.col("v"))).where((F.col("name") != "") & (F.size("v") >= 9))
    rows = joined.select("doc_id", "y", "name", F.get("v", F.lit(1)).alias("calories"), F.get("v", F.lit(7)).alias("protein"), F.get("v", F.lit(2)).alias("fat"), F.get("v", F.lit(4)).alias("carbs")).where("calories > 0")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "name").orderBy(F.desc("y")))).where("_r = 1").drop("_r")


def within_headings(rows: DataFrame, doc: str, order: str, start: Column, stop: Column) -> DataFrame:
    """Rows after the first that is ``start`` and before the first later one that is ``stop``."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_a", F.max(start.cast("int")).over(w))
    marked = marked.withColumn("_z", F.max(F.when(F.col("_a") == 1, stop.cast("int")).otherwise(0)).over(w))
    return marked.where((F.col("_a") == 1) & (F.col("_z") == 0) & ~start).drop("_a", "_z")


def assemble_tables(cells: DataFrame, patterns: dict[str, str], anchor_role: str = "calories", heading_height: float = 14.0, tolerance: float = COLUMN_TOLERANCE, line_tolerance: float = 3.0, wrap_gap: float = 14.0, accept: Column | None = None) -> DataFrame:
    """(doc_id, table_id, title, page, y, row): the rows of a document's tables, from positioned text.

    ``cells`` is (doc_id, page, x, y, height, str).  Lines are read down the pages.  A line all of
    whose cells name columns is a header; it opens a table if a heading came since the header
    before, or if it is the first, and else goes on with the table.  A line with a glyph of
    ``heading_height`` or more is a heading.  Other lines below a header are mapped to its
    columns; one with the ``anchor_role`` begins a row, and near lines after it continue it.
    ``row`` maps roles to texts, wrapped words put together again.  ``accept`` is a predicate over
    title, page, y and row; rows for which it does not hold are left out.
    """
    lined = cluster_lines(cells, line_tolerance)
    line_key = ["doc_id", "page", "line"]
    text = F.array_sort(F.collect_list(F.struct("x", F.trim("str").alias("str"))))
    lines = lined.groupBy(*line_key).agg(F.max("y").alias("y"), F.max("height").alias("height"), text.alias("cells"))
    labels = F.transform("cells", lambda c: c["str"])
    order = Window.partitionBy("doc_id").orderBy("page", "line")
    lines = lines.withColumn("header", is_header(labels, patterns)).withColumn("heading", ~F.col("header") & (F.col("height") >= heading_height))
    lines = lines.withColumn("layout", F.sum(F.col("header").cast("int")).over(order))
    # the heading that a header takes: the last one since the header before
    title = F.last(F.when(F.col("heading"), F.array_join(labels, " ")), ignorenulls=True).over(Window.partitionBy("doc_id", "layout").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("pending", title)
    headers = lines.where("header").select("doc_id", "layout", F.col("cells").alias("anchors"))
    before = lines.groupBy("doc_id", (F.col("layout") + 1).alias("layout")).agg(F.max_by("pending", F.struct("page", "line")).alias("title"))
    opened = headers.join(before, ["doc_id", "layout"], "left")
    by_layout = Window.partitionBy("doc_id").orderBy("layout")
    opens = (F.col("title").isNotNull() | (F.col("layout") == 1)).cast("int")
    opened = opened.withColumn("table_id", F.sum(opens).over(by_layout)).withColumn("title", F.first("title").over(Window.partitionBy("doc_id", "table_id").orderBy("layout")))

    def role_of(label: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for r, p in patterns.items():
            out = out.when(label.rlike(p), r)
        return out

    anchors = F.transform("anchors", lambda a, i: F.struct(a["x"].alias("x"), i.alias("i"), role_of(a["str"]).alias("role")))
    data = lines.where("not header and not heading and layout > 0").join(opened.withColumn("anchors", anchors), ["doc_id", "layout"])
    near = lambda c: F.array_min(F.filter(F.transform(F.col("anchors"), lambda a: F.struct(F.abs(a["x"] - c["x"]).alias("d"), a["i"].alias("i"), a["role"].alias("role"))), lambda d: d["d"] <= tolerance))
    mapped = F.filter(F.transform("cells", lambda c: F.struct(near(c)["role"].alias("role"), c["str"].alias("str"))), lambda c: c["role"].isNotNull() & (c["str"] != ""))
    data = data.withColumn("mapped", mapped).where(F.size("mapped") > 0).withColumn("anchor", F.exists("mapped", lambda c: c["role"] == anchor_role))
    rows = attach_wrapped(data, wrap_gap).where("row is not null")
    each = rows.select("doc_id", "table_id", "title", "page", "row", "y", F.posexplode("mapped").alias("k", "m")).select("doc_id", "table_id", "title", "page", "row", "y", "k", "m.role", "m.str")
    whole = each.groupBy("doc_id", "table_id", "title", "page", "row", "role", "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "str"))), lambda c: c["str"]), " ").alias("text"))
    wrapped = F.aggregate(F.sort_array(F.collect_list(F.struct("y", "text")), asc=False), F.lit(""), lambda acc, x: join_wrapped(acc, x["text"]))
    texts = whole.groupBy("doc_id", "table_id", "title", "page", "row", "role").agg(wrapped.alias("text"), F.max("y").alias("y"))
    rows = texts.groupBy("doc_id", "table_id", "title", "page", "row").agg(F.max("y").alias("y"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "text")))).alias("cells")).select("doc_id", "table_id", "title", "page", "y", F.col("cells").alias("row"))
    return rows if accept is None else rows.where(F.coalesce(accept, F.lit(False)))
