"""Queries about product pages and tables of positioned text; the pages are printed from part and lineitem."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layout, normalize, pages
from ..operators.pages import FIGURES
from .menu import MENU_SQL, menu, table
from .text_queries import _CELLS_SQL, _LINES, _cells, _lines

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- product pages ---

K = "p_partkey"
#: Kinds of pages, by the part's key: combined with one row, three rows or two products; stacked with one or two; no menu, no longer sold, no table; a row over two lines.
KINDS = 9
SHOWN = ("kcal_100", "protein_100", "fat_100", "carbs_100", "total_kcal", "weight")


def _figures(row: int, product: int) -> dict[str, str]:
    """What a row prints, as SQL over part. The checks hold; of every fifth page's only row protein lacks its decimal point."""
    p, f, c = f"(5 + ({K} * 13 + {7 * row + 3 * product}) % 15)", f"(2 + ({K} * 7 + {row + product}) % 12)", f"(10 + ({K} * 29 + {5 * row + product}) % 40)"
    kcal, weight = f"(4 * {p} + 4 * {c} + 9 * {f})", f"(100 + (({K} + {50 * row + 10 * product}) % 9) * 50)"
    total = f"({kcal} * {weight} / 100.0)"
    return {"kcal_100": kcal, "kj_100": f"({kcal} * 4)", "protein_100": p, "fat_100": f, "sat_100": "1", "carbs_100": c, "sugars_100": "2", "fibre_100": "3", "sodium_100": "0.1", "salt_100": "0.3", "total_kcal": total, "portion_kcal": f"({total} / 2)", "weight": weight, "portion_size": f"({weight} / 2.0)", "portion_units": "2", "total_units": "1"}


def _cell(x: float, y: float, height: float, text: str) -> str:
    return f"named_struct('x', double({x}), 'x_end', double({x + 8}), 'y', double({y}), 'height', double({height}), 'str', {text})"


def _numbers(values: list[str], x: float, y: float) -> list[str]:
    return [_cell(x + 14 * i, y, 8, f"cast(round({v}, 2) as string)") for i, v in enumerate(values)]


def _page(kind: int) -> str:
    """The glyphs of one kind of page, as an array."""
    row = lambda r=0, q=0: list(_figures(r, q).values())
    slipped = [f"case when {K} % 5 = 0 then 10 * {v} else {v} end" if k == FIGURES.index("protein_100") else v for k, v in enumerate(row())]
    banner = {5: "'KIDS DRINKS'", 6: "'RECENTLY DELISTED'"}.get(kind, "p_type")
    out = [_cell(700, 560, 8, "'JUNE26'"), _cell(720, 560, 8, "'-'"), _cell(740, 560, 8, "'1'"), _cell(50, 30, 40, banner)]
    two = kind in (2, 4)
    out += [_cell(110, 500, 20, "'Pizza'"), _cell(150, 500, 20, f"concat(p_name, ' ', {K})")] + [_cell(560, 500, 20, "'Side'"), _cell(600, 500, 20, f"concat(p_name, ' ', {K})")] * two
    if kind == 7:
        return f"array({', '.join(out)})"
    if kind in (3, 4):
        if kind == 4:
            out += [_cell(x + 14 * i, 450, 6, f"'{w}'") for x in (100, 600) for i, w in enumerate(pages.RUN)]
        else:
            out.append(_cell(100, 450, 6, f"'{pages.PER_100}'"))
        out.append(_cell(100, 380, 6, "'VALUES PER SLICE'"))
        for q, x in enumerate((100, 600) if two else (100,)):
            v = row(q=q)
            # a printed total that the figures do not bear out, and half a product that they do
            whole = [f"case when {K} % 3 = 0 then {v[10]} * 1.5 else {v[10]} end", *v[11:]]
            half = [f"({v[10]} / 2)", v[11], f"({v[12]} / 2.0)", *v[13:]]
            out += _numbers(v[:10], x, 420) + _numbers(whole, x, 350) + _numbers(half, x, 330)
        return f"array({', '.join(out)})"
    out += [_cell(100, 450, 6, f"'{pages.PER_100}'"), _cell(300, 460, 6, "'VALUES PER PORTION'")] + [_cell(600, 450, 6, f"'{pages.PER_100}'")] * two
    if kind == 1:
        out += _numbers(row(0), 100, 400) + [_cell(20, 400, 8, "'Large'"), _cell(40, 400, 8, "'Thin'"), _cell(60, 400, 5, "'MAY CONTAIN:'")]
        out += _numbers(row(1), 100, 380) + [_cell(60, 380, 5, "'MILK'"), _cell(20, 376, 8, "'Small'")]
        out += _numbers(row(2), 100, 360)
    elif kind == 2:
        out += _numbers(row(q=0), 100, 400) + _numbers(row(q=1), 600, 400)
    elif kind == 8:
        out += _numbers(row()[:10], 100, 400) + _numbers(row()[10:], 240, 395)
    else:
        out += _numbers(slipped, 100, 400) + [_cell(2, 400, 8, f"case when {K} % 2 = 1 then '2' else 'O' end")]
    return f"array({', '.join(out)})"


def _glyphs(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    kinds = [part.where(f"{K} % {KINDS} = {k}").select(F.col("p_brand").alias("doc_id"), F.col(K).alias("page"), F.explode(F.expr(_page(k))).alias("c")) for k in range(KINDS)]
    return reduce(DataFrame.unionByName, kinds).select("doc_id", "page", "c.*")


def _printed() -> str:
    """What the pages say, row by row: (doc_id, page, product, r, title, category, label, layout, and the shown figures)."""
    parts = []
    for kinds, r, q, label, how in (((0, 5, 6, 8), 0, 0, "Standard", "combined"), ((1,), 0, 0, "Large Thin", "combined"), ((1,), 1, 0, "Small", "combined"), ((1,), 2, 0, "Standard", "combined"), ((2,), 0, 0, "Standard", "combined"), ((2,), 0, 1, "Standard", "combined"), ((3, 4), 0, 0, "Standard", "stacked"), ((4,), 0, 1, "Standard", "stacked")):
        f = _figures(r, q)
        if how == "stacked":
            f["total_kcal"], f["weight"] = (f"case when {K} % 3 = 0 then {f[m]} / 2.0 else {f[m]} end" for m in ("total_kcal", "weight"))
        elif q == 0 and r == 0:
            f["protein_100"] = f"case when {K} % {KINDS} in (0, 6) and {K} % 5 = 0 then 10 else 1 end * {f['protein_100']}"
        title = f"'{'Side' if q else 'Pizza'} ' || p_name || ' ' || {K}"
        category = f"case when {K} % {KINDS} = 6 then 'RECENTLY DELISTED' else p_type end"
        parts.append(f"select p_brand as doc_id, {K} as page, {q} as product, {r} as r, {title} as title, {category} as category, '{label}' as label, '{how}' as layout, " + ", ".join(f"round({f[m]}, 2)::double as {m}" for m in SHOWN) + f" from part where {K} % {KINDS} in ({', '.join(map(str, kinds))}) and {K} % {KINDS} <> 5")
    return " union all ".join(parts)


@query(f"select doc_id, page, product, title, category, label, layout, {', '.join(SHOWN)} from ({_printed()})")
def product_pages(spark, sf_dir):
    rows = pages.read_pages(_glyphs(spark, sf_dir))
    return rows.select("doc_id", "page", "product", "title", "category", "label", "layout", *(F.col("nums")[FIGURES.index(m)].alias(m) for m in SHOWN))


@query(f"select label, layout, count(*) as n, count(distinct page) as pages from ({_printed()}) group by 1, 2")
def row_labels(spark, sf_dir):
    """How often each label was picked: beside the figures, below them, or none."""
    return pages.read_pages(_glyphs(spark, sf_dir)).groupBy("label", "layout").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id", "page").alias("pages"))


#: Printed rows with ``slipped``: protein lacks its decimal point; ``open``: carbs or fat without theirs would explain it as well, so the row is not mended.
_SLIPPED = f"""p as (select *, page % {KINDS} in (0, 6) and page % 5 = 0 as slipped from ({_printed()})),
    s as (select *, slipped and (abs(4 * protein_100 + 0.4 * carbs_100 + 9 * fat_100 - kcal_100) <= 0.12 * kcal_100 or abs(4 * protein_100 + 4 * carbs_100 + 0.9 * fat_100 - kcal_100) <= 0.12 * kcal_100) as open from p),
    f as (select * replace (case when slipped and not open then protein_100 / 10 else protein_100 end as protein_100) from s)"""


@query(f"""with {_SLIPPED} select case when category = 'RECENTLY DELISTED' then 'delisted' when open then 'rejected' when slipped then 'repaired' when weight > 400 then 'rejected' else 'ok' end as status, count(*) as n, round(sum(protein_100), 2) as protein from f group by 1""")
def page_row_status(spark, sf_dir):
    """Accepted, mended and refused rows; the predicate that the caller gives refuses what is heavier than 400 g and was not mended."""
    light = (F.col("weight") <= 400) | (F.col("status") == "repaired")
    rows = pages.checked_rows(pages.read_pages(_glyphs(spark, sf_dir)), light)
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("protein_100"), 2).alias("protein"))


_ITEMS = f"""with {_SLIPPED}, g as (select * from f where category <> 'RECENTLY DELISTED' and not open),
    t as (select *, count(*) over (partition by doc_id, page, product) > 1 as many, row_number() over (partition by doc_id order by page, product, r) as item_seq from g),
    n as (select doc_id as restaurant, item_seq, case when many then title || ' (' || label || ')' else title end as name, total_kcal as calories, floor(protein_100 * weight / 100 * 10 + 0.5) / 10 as protein, floor(fat_100 * weight / 100 * 10 + 0.5) / 10 as fat, floor(carbs_100 * weight / 100 * 10 + 0.5) / 10 as carbs, case when many then title end as variant_of, case when many then label end as variant_option from t)
    select restaurant, count(*) as items, count(variant_of) as variants, round(sum(calories), 1) as calories, round(sum(protein), 1) as protein, round(sum(fat), 1) as fat, round(sum(carbs), 1) as carbs, count(distinct name) as names from n group by 1"""


@query(_ITEMS)
def page_menu(spark, sf_dir):
    """A whole document of pages as one menu, under final names."""
    items = pages.page_items(pages.checked_rows(pages.read_pages(_glyphs(spark, sf_dir))))
    total = [F.round(F.sum(m), 1).alias(m) for m in ("calories", "protein", "fat", "carbs")]
    return items.groupBy("restaurant").agg(F.count(F.lit(1)).alias("items"), F.count("variant_of").alias("variants"), *total, F.count_distinct("name").alias("names"))


# --- tables, lines and labels ---


@query(f"""with recursive {_CELLS_SQL}, o as (select *, row_number() over (partition by doc_id, page order by y desc, x, n) as k from c),
    w(doc_id, page, k, n, first, line) as (select doc_id, page, k, n, y, 1 from o where k = 1 union all
        select o.doc_id, o.page, o.k, o.n, case when abs(w.first - o.y) > 3.0 then o.y else w.first end, case when abs(w.first - o.y) > 3.0 then w.line + 1 else w.line end from w join o on o.doc_id = w.doc_id and o.page = w.page and o.k = w.k + 1)
    select doc_id, page, n, line from w""")
def clustered_lines(spark, sf_dir):
    return layout.cluster_lines(_cells(spark, sf_dir), 3.0).select("doc_id", "page", "n", "line")


_HEADS = (("name", "Product", 20), ("calories", "Energy kcal", 200), ("protein", "Protein", 260), ("carbs", "Carbs", 320))
_PATTERNS = {"name": "(?i)^product$", "calories": "(?i)^energy", "protein": "(?i)^protein$", "carbs": "(?i)^carbs$"}


@query(f"""with m as ({MENU_SQL}), r as (select *, row_number() over (partition by restaurant order by item_seq) - 1 as k from m), t as (select *, k // 12 as p, k // 12 - case when k // 12 % 3 = 2 then 1 else 0 end as t from r)
    select restaurant as doc_id, 1 + t - t // 3 as table_id, 'Table ' || t as title, item_seq, name || case when k % 4 = 1 then ' (grilled)' else '' end as name, calories, case when k % 5 = 0 then null else protein end as protein, carbs from t""")
def table_rows_by_grid(spark, sf_dir):
    """Tables of twelve rows: every third has no heading of its own, and goes on with the one before."""
    r = menu(spark, sf_dir).withColumn("k", F.expr("row_number() over (partition by restaurant order by item_seq) - 1")).selectExpr("*", "k div 12 t", "k % 12 i")
    cell = lambda x, y, h, s: f"named_struct('x', double({x}), 'y', double({y}), 'height', double({h}), 'str', {s})"
    heads = [cell(x, 700, 9, f"'{s}'") for _, s, x in _HEADS]
    top = f"case when i <> 0 then array() when t % 3 = 2 then array({', '.join(heads)}) else array({', '.join([cell(20, 740, 18, 'concat(\"Table \", t)'), *heads])}) end"
    y = "650 - 30 * i"
    row = [cell(22, y, 9, "name"), cell(203, y, 9, "cast(calories as string)"), cell(318, y, 9, "cast(carbs as string)"), cell(900, y, 9, "'stray'")]
    more = f"concat(case when k % 5 = 0 then array() else array({cell(257, y, 9, 'cast(protein as string)')}) end, case when k % 4 = 1 then array({cell(24, y + ' - 10', 9, repr('(grilled)'))}) else array() end)"
    cells = r.select(F.col("restaurant").alias("doc_id"), F.col("t").alias("page"), F.explode(F.expr(f"concat({top}, array({', '.join(row)}), {more})")).alias("c")).select("doc_id", "page", "c.*")
    found = layout.assemble_tables(cells, _PATTERNS)
    back = menu(spark, sf_dir).withColumn("k", F.expr("row_number() over (partition by restaurant order by item_seq) - 1")).selectExpr("restaurant doc_id", "k div 12 page", "double(650 - 30 * (k % 12)) y", "item_seq")
    value = lambda m: F.col("row")[m].try_cast("bigint").alias(m)
    return found.join(back, ["doc_id", "page", "y"], "left").select("doc_id", "table_id", "title", "item_seq", F.col("row")["name"].alias("name"), value("calories"), value("protein"), value("carbs"))


@query(f"""with l as (select l_orderkey as doc_id, l_linenumber as n, 100.0 - 4 * l_linenumber as y, case when l_quantity::bigint % 3 = 0 then 10 when l_quantity::bigint % 3 = 1 then 6 else 15 end as n_numbers from ({_LINES})),
    w as (select *, lag(n_numbers) over o as up, lag(y) over o as up_y from l window o as (partition by doc_id order by n)),
    ok as (select *, coalesce(up between 6 and 13 and up_y - y between 0.001 and 6 and n_numbers between 2 and 13 and up + n_numbers between 14 and 16, false) as ok from w)
    select doc_id, y, case when ok and not coalesce(lag(ok) over (partition by doc_id order by n), false) then up_y end as merged_into from ok""")
def merged_rows(spark, sf_dir):
    l = _lines(spark, sf_dir).selectExpr("l_orderkey doc_id", "0 page", "double(100.0 - 4 * l_linenumber) y", "case cast(l_quantity as bigint) % 3 when 0 then 10 when 1 then 6 else 15 end n_numbers")
    return layout.merge_continuations(l).select("doc_id", "y", "merged_into")


@query(f"""with f as (select l_orderkey as page, l_linenumber as n, l_quantity::double as cy, l_suppkey % 50 as x, l_returnflag || l_linenumber as str from ({_LINES})), d as (select * from (select *, row_number() over (partition by page, cy order by n) as r from f) where r = 1),
    g as (select *, floor(cy / 60) as k from d) select page, round(avg(cy), 6) as cy, min(cy - 2) as lo, max(cy + 2) as hi, string_agg(str, ' ' order by x, str) as label from g group by page, k""")
def merged_labels(spark, sf_dir):
    """Fragments of rotated labels: all of a page's lie nearer than the gap to its first, so each page has one label."""
    f = _lines(spark, sf_dir).selectExpr("l_orderkey page", "l_linenumber n", "double(l_quantity) cy", "l_suppkey % 50 x", "concat(l_returnflag, l_linenumber) str")
    one = normalize.keep_first(f, ["page", "cy"], "n").selectExpr("page", "cy", "cy - 2 lo", "cy + 2 hi", "x", "str")
    return layout.merge_labels(one, ["page"], 60).select("page", F.round("cy", 6).alias("cy"), "lo", "hi", "label")


@query("""with r as (select user_id, event_id, event_type, max(case when event_type = 'click' then 1 else 0 end) over w as a from events window w as (partition by user_id order by event_id rows between unbounded preceding and current row)),
    z as (select *, max(case when a = 1 and event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and current row) as z from r)
    select user_id, event_id from z where a = 1 and z = 0 and event_type <> 'click'""")
def between_headings(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return layout.within_headings(e, "user_id", "event_id", F.col("event_type") == "click", F.col("event_type") == "purchase").select("user_id", "event_id")


@query(f"""with m as ({MENU_SQL}), r as (select *, row_number() over (partition by restaurant, name order by item_seq) as r from m where calories > 0 and item_seq % 7 <> 3) select restaurant as doc_id, name, calories::double as calories, protein::double as protein, fat::double as fat, carbs + 0.5 as carbs from r where r = 1""")
def ingredient_lines(spark, sf_dir):
    """Lines of nine values: some with the name on the line below, some of too few."""
    m = menu(spark, sf_dir)
    values = "array(cast(calories * 4 as string), cast(calories as string), cast(fat as string), '1', concat(carbs, ',5'), '2', '3', cast(protein as string), '0.1')"
    y = "double(-10 * item_seq)"
    lines = f"case when item_seq % 7 = 3 then array(named_struct('y', {y}, 'texts', concat(array(name), slice({values}, 1, 5)))) when item_seq % 4 = 0 then array(named_struct('y', {y}, 'texts', {values}), named_struct('y', {y} - 4, 'texts', array(name))) else array(named_struct('y', {y}, 'texts', concat(array(name), {values}))) end"
    rows = m.select(F.col("restaurant").alias("doc_id"), F.explode(F.expr(lines)).alias("l")).select("doc_id", "l.*")
    return layout.ingredient_rows(rows).select("doc_id", "name", "calories", "protein", "fat", "carbs")


# --- names ---

#: A family in order: name, category and macros (as a number added to the calories), and the name it gets; none for a repeat.
FAMILIES = (
    ((("{}", "A", 0), "{} (A)"), (("{} (2)", "A", 1), "{} (2)"), (("{}", "A", 2), "{} (3)"), (("{} (2)", "A", 3), "{} (2) (2)"), (("{}", "B", 1), None), (("{}", "B", 4), "{} (B)")),
    ((("{}", "A", 0), "{} (A) (A)"), (("{}", "B", 1), "{} (B)"), (("{}", "B", 2), "{} (2)"), (("{} (A)", "C", 3), "{} (A) (C)"), (("{} (A)", "C", 0), None)),
    ((("{} (x) y", "A", 0), "{} (x) y"), (("{}", "A", 1), "{}"), (("{}", None, 2), "{} (2)"), (("{} (x) y", "A", 3), "{} (x) y (2)"), (("{}", "A", 3), None)),
)


def _families_sql() -> str:
    rows = [(f, k, final) for f, some in enumerate(FAMILIES) for k, (_, final) in enumerate(some) if final]
    return f"with m as ({MENU_SQL}) " + " union all ".join(f"select restaurant, item_seq * 10 + {k} as item_seq, replace('{final}', '{{}}', 'N' || item_seq) as final_name from m where item_seq % {len(FAMILIES)} = {f}" for f, k, final in rows)


@query(_families_sql())
def collision_families(spark, sf_dir):
    """Families whose names have parentheses of their own."""
    rows = lambda some: "array(" + ", ".join(f"named_struct('k', {k}, 'name', '{n}', 'category', {'cast(null as string)' if c is None else repr(c)}, 'more', {x})" for k, ((n, c, x), _) in enumerate(some)) + ")"
    each = F.expr(f"case item_seq % {len(FAMILIES)} " + " ".join(f"when {f} then {rows(some)}" for f, some in enumerate(FAMILIES)) + " end")
    m = menu(spark, sf_dir).select("restaurant", "item_seq", "calories", "protein", "fat", "carbs", F.explode(each).alias("r"))
    items = m.selectExpr("restaurant", "item_seq * 10 + r.k as item_seq", "replace(r.name, '{}', concat('N', item_seq)) as name", "r.category as category", "calories + r.more as calories", "protein", "fat", "carbs")
    return normalize.resolve_collisions(items).select("restaurant", "item_seq", "final_name")
