"""Queries about text, layout, pages, carts and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import cart, layout, normalize
from ..sources import loaders
from ..streaming import snapshots
from .menu import MENU_SQL, menu, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- numbers and names ---

_NUMBERS = "(p_partkey % 97) || ',' || (100 + p_partkey % 900) || '.5 kcal (' || p_size || ' g)'"


@query(f"""with t as (select p_partkey, {_NUMBERS} as s from part)
    select p_partkey, try_cast(regexp_extract(replace(s, ',', ''), '-?\\d+(?:\\.\\d+)?', 0) as double) as plain,
        try_cast(replace(regexp_extract(s, '-?\\d+(?:[.,]\\d+)?', 0), ',', '.') as double) as decimal_mark,
        try_cast(regexp_extract(s, '([\\d.]+)\\s*kcal', 1) as double) as kcal, p_partkey % 97 || '.25' = '0.25' as is_zero from t""")
def parse_numbers(spark, sf_dir):
    t = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_NUMBERS} s")
    comma = F.concat((F.col("p_partkey") % 97).cast("string"), F.lit(",25"))
    return t.select("p_partkey", exprs.parse_number(F.col("s")).alias("plain"), exprs.parse_decimal_mark(F.col("s")).alias("decimal_mark"), exprs.energy_kcal(F.col("s")).alias("kcal"), (exprs.parse_whole_decimal_comma(comma) == 0.25).alias("is_zero"))


_LABEL = "case p_partkey % 5 when 0 then upper(p_name) when 1 then lower(p_type) || {} || p_name when 2 then '  ' || p_type || '  ' when 3 then '' else p_name || ' (' || p_size || ')' end"
_QUOTED = "'''s  n'' '"
_CLEAN = "trim(regexp_replace(coalesce(s, ''), '\\s+', ' ', 'g'))"
_TITLE = "array_to_string(list_transform(regexp_extract_all(lower({x}), '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda t: upper(t[1]) || t[2:]), '')"


@query(f"""with t as (select p_partkey, {_LABEL.format(_QUOTED)} as s from part), c as (select *, {_CLEAN} as x from t)
    select p_partkey, x as cleaned, {_TITLE.format(x="x")} as titled, case when x = '' then null when x = lower(x) or x = upper(x) then {_TITLE.format(x="x")} else x end as category,
        regexp_replace(lower(s), '[^a-z0-9_-]+', '_', 'g') as cache_key from c""")
def normalize_labels(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", F.expr(_LABEL.format("\"'s  n' \"")).alias("s"))
    s = F.col("s")
    return t.select("p_partkey", exprs.clean(s).alias("cleaned"), exprs.title_case(exprs.clean(s)).alias("titled"), exprs.normalize_category(s).alias("category"), exprs.cache_key(s).alias("cache_key"))


_VARIANT = "case p_partkey % 6 when 0 then p_name || ' (' || (p_size % 9 + 1) || ')' when 1 then p_name || ' (large)' when 2 then 'XL ' || p_name when 3 then p_size || ' ' || p_name when 4 then 'medium ' || p_name else p_name end"


@query(f"""with t as (select p_partkey, {_VARIANT} as s from part), x as (select *, regexp_extract(s, '(?i)^(.+?)\\s*\\((\\d+|large|regular|small|medium|xl)\\)$', 2) as mark, regexp_matches(s, '(?i)^(large|regular|small|medium|xl)\\s+(.+)$') as lead from t)
    select p_partkey, case when mark <> '' then trim(regexp_extract(s, '(?i)^(.+?)\\s*\\((\\d+|large|regular|small|medium|xl)\\)$', 1)) when lead then trim(regexp_extract(s, '(?i)^(large|regular|small|medium|xl)\\s+(.+)$', 2)) end as base,
        case when regexp_matches(mark, '^\\d+$') then mark || ' pc' when mark <> '' then upper(mark[1]) || lower(mark[2:]) when lead then case when lower(regexp_extract(s, '^(\\w+)', 1)) = 'xl' then 'XL' else upper(s[1]) || lower(regexp_extract(s, '^(\\w+)', 1)[2:]) end end as option,
        case when regexp_matches(s, '^\\d+\\s+.+$') then regexp_extract(s, '^(\\d+)', 1) || ' pc' end as count_option from x""")
def variant_names(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", F.expr(_VARIANT).alias("s"))
    v, c = exprs.variant_of_name(F.col("s")), exprs.leading_count(F.col("s"))
    return t.select("p_partkey", v["base"].alias("base"), v["option"].alias("option"), c["option"].alias("count_option"))


_TITLES = "case p_partkey % 4 when 0 then '3. Acme''s Pizza Nutrition – ' || p_type || ' (Per Slice – Large)' when 1 then 'Acme''s ' || p_type || ' Nutrition (Per Whole Pizza)' when 2 then p_type || ' Combos' else 'Acme ' || p_type || ' Nutrition' end"
_STRIPPED = "trim(regexp_replace(regexp_replace(regexp_replace(t, '^\\d+\\.\\s*', ''), '(?i)^Acme''?s?\\s*', ''), '\\s*\\([^)]*\\)\\s*$', ''))"


@query(f"""with t as (select p_partkey, p_name, p_size, {_TITLES} as t from part), b as (select *, {_STRIPPED} as bare, case p_partkey % 4 when 0 then 'Per Slice, Large' when 1 then 'Per Whole' else '' end as basis from t)
    select p_partkey, case when regexp_matches(bare, '(?i)^Pizza Nutrition\\s*[–-]\\s*(.+)$') then trim(regexp_extract(bare, '(?i)^Pizza Nutrition\\s*[–-]\\s*(.+)$', 1)) else trim(regexp_replace(bare, '(?i)\\s*Nutrition\\s*$', '')) end as category, basis,
        p_name || ' — thin' || case when p_size > 40 then ' (L)' when basis <> '' then ' (' || basis || ')' else '' end as item_key from b""")
def section_titles(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", F.expr(_TITLES.replace("''", "\\'")).alias("t"))
    size = F.when(F.col("p_size") > 40, "L")
    return t.select("p_partkey", exprs.title_category(F.col("t"), "Acme").alias("category"), exprs.serving_basis(F.col("t")).alias("basis"), exprs.item_key(F.col("p_name"), F.lit("thin"), size, F.col("t")).alias("item_key"))


_OCR = "case event_id % 4 when 0 then 'carbs ' || (event_id % 90) || 'g / ' || (event_id % 200) when 1 then (event_id % 1500) || ' cal left' when 2 then 'fat ' || (event_id % 40) || ' ' || (event_id % 70) else 'protein ' || (event_id % 80) end"


@query(f"""with t as (select event_id, event_id % 4 as k, {_OCR} as line from events)
    select event_id, line, case k when 0 then greatest(event_id % 200 - event_id % 90, 0) when 1 then event_id % 1500 when 2 then abs(event_id % 70 - event_id % 40) else event_id % 80 end as remaining from t""")
def screenshot_lines(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id", F.expr(_OCR).alias("line"))
    return t.select("event_id", "line", exprs.remaining_in_line(F.col("line")).alias("remaining"))


_NOW = 1_767_225_600_000


@query(f"""with d as (select event_id, greatest(floor(({_NOW} - (epoch_ms(ts) - (event_id % 200) * 86400000)) / 86400000.0 - 0 + 0.5), 0)::bigint as days from events)
    select event_id, days, case when days <= 0 then 'today' when days = 1 then '1 day ago' when days < 14 then days || ' days ago' when days < 60 then floor(days / 7.0 + 0.5)::bigint || ' weeks ago' else floor(days / 30.0 + 0.5)::bigint || ' months ago' end as label, days > 90 as stale from d""")
def staleness_labels(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")) - (F.col("event_id") % 200) * 86_400_000)
    d = e.select("event_id", exprs.age_days(F.col("ms"), F.lit(_NOW)).cast("bigint").alias("days"))
    return d.select("event_id", "days", exprs.age_label(F.col("days")).alias("label"), exprs.is_stale(F.col("days")).alias("stale"))


@query("""select event_id, case when hour(ts) < 11 then 'Breakfast' when hour(ts) < 15 then 'Lunch' when hour(ts) < 21 then 'Dinner' else 'Snacks' end as meal,
    case when value % 1 < 0.1 then 'good' when value % 1 < 0.2 then 'warn' else 'bad' end as band from events""")
def meal_of_day(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", exprs.meal_of_day(F.hour(F.col("ts").cast("timestamp"))).alias("meal"), exprs.accuracy_band(F.col("value") % 1).alias("band"))


@query(f"""with m as ({MENU_SQL}), c as (select item_seq, case item_seq % 6 when 0 then null when 1 then 'Chicken Wings' when 2 then 'Sweet Potato Fries' when 3 then 'Iced Tea' when 4 then 'Dips' else 'Bowls' end as category from m)
    select item_seq, case when category is null then null when category = 'Chicken Wings' then '🍗' when category = 'Sweet Potato Fries' then '🍰' when category = 'Iced Tea' then '🥤' when category = 'Dips' then '🍟' else '🍽️' end as icon from c""")
def category_icons(spark, sf_dir):
    c = F.expr("case item_seq % 6 when 0 then null when 1 then 'Chicken Wings' when 2 then 'Sweet Potato Fries' when 3 then 'Iced Tea' when 4 then 'Dips' else 'Bowls' end")
    return menu(spark, sf_dir).select("item_seq", exprs.category_icon(c).alias("icon"))


# --- order and layout ---

_LINES = "select l_orderkey, l_linenumber, max(l_quantity) as l_quantity, max(l_suppkey) as l_suppkey, max(l_returnflag) as l_returnflag from lineitem group by l_orderkey, l_linenumber"


def _lines(spark, sf_dir):
    """One row for each line number of an order, as ties would leave the order open."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in ("l_quantity", "l_suppkey", "l_returnflag")))



@query("""select user_id, event_id, last_value(case when event_type = 'view' then value end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as section from events""")
def last_seen_heading(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("heading", F.expr("case when event_type = 'view' then value end"))
    return normalize.fill_headings(e, "user_id", "event_id", "heading").select("user_id", "event_id", "section")


@query(f"""with r as (select l_orderkey, l_linenumber, l_quantity::bigint % 4 as serves from ({_LINES})), f as (select *, case when serves = 1 and lag(serves) over w <> 1 then 1 else 0 end as reset from r window w as (partition by l_orderkey order by l_linenumber))
    select l_orderkey, l_linenumber, sum(reset) over (partition by l_orderkey order by l_linenumber) + 1 as segment from f""")
def segment_on_reset(spark, sf_dir):
    r = _lines(spark, sf_dir).selectExpr("l_orderkey", "l_linenumber", "cast(l_quantity as bigint) % 4 serves")
    return normalize.segments_on_reset(r, "l_orderkey", "l_linenumber", "serves").select("l_orderkey", "l_linenumber", "segment")


def _cells(spark, sf_dir):
    return _lines(spark, sf_dir).selectExpr("l_orderkey doc_id", "l_linenumber n", "l_linenumber div 4 page", "l_quantity * 10 x", "l_quantity * 10 + 5 + l_linenumber x_end", "cast(l_suppkey % 40 as double) y", "l_returnflag str")


_CELLS_SQL = "c as (select l_orderkey as doc_id, l_linenumber as n, l_linenumber // 4 as page, l_quantity * 10 as x, l_quantity * 10 + 5 + l_linenumber as x_end, (l_suppkey % 40)::double as y, l_returnflag as str from (" + _LINES + "))"
_ANCHORS = (("name", 40.0, 0), ("calories", 160.0, 1), ("protein", 200.0, 2), ("carbs", 330.0, 3))


@query(f"""with {_CELLS_SQL}, a(role, anchor, ord) as (values {", ".join(f"('{r}', {x}, {o})" for r, x, o in _ANCHORS)}),
    d as (select c.doc_id, c.n, a.role, row_number() over (partition by c.doc_id, c.n order by abs(c.x - a.anchor), a.ord) as r from c, a where abs(c.x - a.anchor) <= 26)
    select c.doc_id, c.n, d.role from c left join d on d.doc_id = c.doc_id and d.n = c.n and d.r = 1""")
def nearest_column(spark, sf_dir):
    cols = spark.createDataFrame(_ANCHORS, "role string, anchor double, ord int")
    return layout.nearest_column(_cells(spark, sf_dir), cols).select("doc_id", "n", "role")


@query(f"""with {_CELLS_SQL}, a(role, anchor, ord) as (values {", ".join(f"('{r}', {x}, {o})" for r, x, o in _ANCHORS)}),
    d as (select c.doc_id, c.n, c.x, c.str, a.role, row_number() over (partition by c.doc_id, c.n order by abs(c.x - a.anchor), a.ord) as r from c, a where abs(c.x - a.anchor) <= 26),
    t as (select doc_id, role, string_agg(str, ' ' order by x, str) as text from d where r = 1 group by 1, 2)
    select doc_id, string_agg(role || '=' || text, ';' order by role) as shown from t group by 1""")
def cells_to_columns(spark, sf_dir):
    cols = spark.createDataFrame(_ANCHORS, "role string, anchor double, ord int")
    rows = layout.cells_to_columns(layout.nearest_column(_cells(spark, sf_dir), cols), ["doc_id"])
    return rows.select("doc_id", F.array_join(F.transform(F.array_sort(F.map_entries("row")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("shown"))


_GRIDS = (("g1", 0, 0, 40.0), ("g1", 0, 1, 160.0), ("g1", 0, 2, 300.0), ("g2", 1, 0, 90.0), ("g2", 1, 1, 210.0), ("g2", 1, 2, 420.0))


@query(f"""with {_CELLS_SQL}, g(grid, go, ord, anchor) as (values {", ".join(f"('{g}', {k}, {o}, {x})" for g, k, o, x in _GRIDS)}),
    h as (select doc_id, grid, go, count(distinct ord) as hits from c, g where abs(c.x - g.anchor) <= 26 group by 1, 2, 3), r as (select *, row_number() over (partition by doc_id order by hits desc, go) as r from h)
    select doc_id, grid, hits from r where r = 1""")
def best_grid(spark, sf_dir):
    grids = spark.createDataFrame(_GRIDS, "grid string, grid_ord int, ord int, anchor double")
    return layout.best_grid(_cells(spark, sf_dir), grids, ["doc_id"])


@query(f"""with {_CELLS_SQL}, w as (select *, lag(x_end) over (partition by doc_id order by x, n) as before from c)
    select doc_id, count(*) filter (where x - before > 80) as wide_gaps from w group by 1""")
def wide_gaps(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("x", "n")
    return _cells(spark, sf_dir).withColumn("before", F.lag("x_end").over(w)).groupBy("doc_id").agg(F.count_if(F.expr("x - before > 80")).alias("wide_gaps"))


@query(f"""with c as (select l_orderkey as doc_id, l_quantity * 10 + l_linenumber as x, l_quantity * 10 + l_linenumber + 3 as x_end from ({_LINES})), w as (select *, x - lag(x_end) over (partition by doc_id order by x) as gap from c),
    m as (select *, max(gap) over (partition by doc_id) as widest, first_value(x) over (partition by doc_id order by gap desc nulls last, x) as spot from w)
    select doc_id, x, case when widest > 50 and x >= spot then 2 else 1 end as part from m""")
def split_by_gap(spark, sf_dir):
    c = _lines(spark, sf_dir).selectExpr("l_orderkey doc_id", "l_quantity * 10 + l_linenumber x", "l_quantity * 10 + l_linenumber + 3 x_end")
    return layout.split_by_gap(c, ["doc_id"], 50).select("doc_id", "x", "part")


@query(f"""with c as (select l_orderkey as doc_id, l_quantity * 10 + l_linenumber as x, l_quantity * 10 + l_linenumber + 3 as x_end from ({_LINES})), w as (select *, lead(x) over (partition by doc_id order by x) - x_end as gap from c),
    m as (select *, max(case when coalesce(gap <= 80, true) then 1 else 0 end) over (partition by doc_id order by x) as keep from w) select doc_id, x from m where keep = 1""")
def strip_outliers(spark, sf_dir):
    c = _lines(spark, sf_dir).selectExpr("l_orderkey doc_id", "l_quantity * 10 + l_linenumber x", "l_quantity * 10 + l_linenumber + 3 x_end")
    return layout.strip_outliers(c, ["doc_id"]).select("doc_id", "x")


@query(f"""with s as (select l_orderkey as doc_id, l_linenumber as span_id, l_quantity as lo, l_quantity + 6 as hi from ({_LINES})), l(ord, cy, label) as (values (0, 8.0, 'low'), (1, 20.0, 'mid'), (2, 21.0, 'mid2'), (3, 43.0, 'high')),
    r as (select s.*, l.label, row_number() over (partition by doc_id, span_id order by case when cy between lo - 2 and hi + 2 then 0 else 1 end, case when cy between lo - 2 and hi + 2 then 0.0 else least(abs(cy - lo), abs(cy - hi)) end, ord) as r from s, l)
    select doc_id, span_id, label from r where r = 1""")
def band_or_nearest(spark, sf_dir):
    s = _lines(spark, sf_dir).selectExpr("l_orderkey doc_id", "0 page", "l_linenumber span_id", "l_quantity lo", "l_quantity + 6 hi").withColumn("doc_id", F.col("doc_id"))
    labels = spark.createDataFrame([(0, 0, 8.0, "low"), (0, 1, 20.0, "mid"), (0, 2, 21.0, "mid2"), (0, 3, 43.0, "high")], "page int, ord int, cy double, label string")
    keyed = s.withColumn("span_id", F.struct("doc_id", "span_id")).drop("doc_id")
    return layout.label_for_span(keyed, F.broadcast(labels), ["page"]).select("span_id.doc_id", "span_id.span_id", "label")


@query(f"""with l(ord, label, lower) as (values (0, 'top', 34.0), (1, 'middle', 12.0), (2, 'bottom', '-infinity'::double)), r as (select l_orderkey, l_linenumber, l.label, row_number() over (partition by l_orderkey, l_linenumber order by ord) as r from ({_LINES}), l where l_quantity >= lower)
    select l_orderkey, l_linenumber, label from r where r = 1""")
def asof_section(spark, sf_dir):
    labels = spark.createDataFrame([(0, 42.0, "top", 50.0), (0, 23.0, "middle", 50.0), (0, 5.0, "bottom", 50.0)], "page int, cy double, label string, top_y double")
    rows = _lines(spark, sf_dir).selectExpr("0 page", "l_orderkey", "l_linenumber", "l_quantity y")
    return layout.section_of(rows, F.broadcast(layout.section_bounds(labels, ["page"])), ["page"], ["l_orderkey", "l_linenumber"])


@query()
def line_clusters(spark, sf_dir):
    return layout.cluster_lines(_cells(spark, sf_dir), 3.0).select("doc_id", "page", "n", "line")


@query(f"""with c as (select l_orderkey as doc_id, l_linenumber as seq, floor(l_quantity / 10 * 2 + 0.5) / 2 as bucket from ({_LINES})), g as (select doc_id, bucket, count(*) as n, min(seq) as first from c group by 1, 2),
    r as (select *, row_number() over (partition by doc_id order by n desc, first) as r from g) select doc_id, bucket + 1.5 as least from r where r = 1""")
def heading_heights(spark, sf_dir):
    c = _lines(spark, sf_dir).selectExpr("l_orderkey doc_id", "l_linenumber seq", "l_quantity / 10 height")
    return layout.heading_height(c, "doc_id")


@query(f"""with w as (select l_orderkey, l_returnflag as a, lead(l_returnflag) over (partition by l_orderkey order by l_linenumber) as b from ({_LINES})) select l_orderkey, count(*) filter (where a = 'N' and b = 'N') as n from w group by 1""")
def sequence_count(spark, sf_dir):
    c = _lines(spark, sf_dir).selectExpr("l_orderkey", "l_linenumber x", "l_returnflag str")
    return layout.sequence_count(c, ["l_orderkey"], ["N", "N"])


# --- pages ---


@query("select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as links from pages")
def html_title_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    n = F.size(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1))
    return p.select("page_id", loaders.page_title(F.col("html")).alias("title"), n.cast("bigint").alias("links"))


@query("with l as (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as href from pages) select href, count(*) as n from l group by 1")
def page_links(spark, sf_dir):
    return loaders.links(table(spark, sf_dir, "pages")).groupBy("href").agg(F.count(F.lit(1)).alias("n"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def embedded_json(spark, sf_dir):
    html = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), F.col("props"), F.lit("</script></html>"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(loaders.embedded_json(html), "$.k").cast("bigint").alias("k"))


@query("""with recursive n as (select n_nationkey, n_name, n_regionkey, r_name from nation join region on r_regionkey = n_regionkey), t(node, parent, label) as (select 'root', null, 'Menu' union all select 'r' || r_regionkey, 'root', r_name from region union all select 'n' || n_nationkey, 'r' || n_regionkey, n_name from nation),
    w(depth, node, category) as (select 0, 'root', null::varchar union all select w.depth + 1, t.node, p.label from w join t on t.parent = w.node join t p on p.node = w.node) select depth, node, category from w""")
def menu_tree(spark, sf_dir):
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    nodes = spark.createDataFrame([("root", None, "Menu")], "node string, parent string, label string")
    nodes = nodes.unionByName(r.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("root").alias("parent"), F.col("r_name").alias("label")))
    nodes = nodes.unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("label")))
    return loaders.menu_tree(spark, nodes, "root")


# --- carts and streams ---

_EVENTS = "e as (select user_id, event_id as seq, 'menu' || (event_id // 7 % 2) as restaurant, event_type as name, case when event_id % 5 = 0 then -1 else 1 end as delta from events)"
_RUNS = f"""{_EVENTS}, a as (select *, case when delta > 0 then restaurant end as added, last_value(case when delta > 0 then restaurant end ignore nulls) over (partition by user_id order by seq rows between unbounded preceding and 1 preceding) as held from e),
    c as (select *, coalesce(case when added <> held then 1 else 0 end, 0) as ch from a), r as (select *, sum(ch) over (partition by user_id order by seq) as run from c), o as (select * from r where added is not null or restaurant = held),
    l as (select *, max(run) over (partition by user_id) as last from o), s as (select *, sum(delta) over (partition by user_id, restaurant, name order by seq) as s from l where run = last),
    f as (select user_id, restaurant, name, sum(delta) - least(min(s), 0) as qty from s group by 1, 2, 3 having sum(delta) - least(min(s), 0) > 0)"""


def _cart(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("user_id", "event_id seq", "concat('menu', cast(event_id div 7 % 2 as string)) restaurant", "event_type name", "case when event_id % 5 = 0 then -1 else 1 end delta")
    return cart.fold(e)


@query(f"with {_RUNS} select * from f")
def cart_fold(spark, sf_dir):
    return _cart(spark, sf_dir)


_CART_MENU = "cm as (select 'menu' || k as restaurant, t.name, 100 * (k + 1) + length(t.name) as calories, length(t.name) as protein, k as fat, 10 * length(t.name) as carbs, case when length(t.name) > 5 then 'long' end as category from (select distinct event_type as name from events) t, range(2) x(k))"


def _cart_menu(spark, sf_dir):
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct()
    return names.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).selectExpr("concat('menu', cast(k as string)) restaurant", "name", "100 * (k + 1) + length(name) calories", "length(name) protein", "k fat", "10 * length(name) carbs", "case when length(name) > 5 then 'long' end category")


@query(f"with {_RUNS}, {_CART_MENU} select user_id, sum(calories * qty) as calories, sum(protein * qty) as protein, sum(fat * qty) as fat, sum(carbs * qty) as carbs, sum(qty) as items from f join cm using (restaurant, name) group by 1")
def cart_totals(spark, sf_dir):
    return cart.totals(_cart(spark, sf_dir), _cart_menu(spark, sf_dir), ["user_id"])


@query(f"with {_RUNS}, {_CART_MENU} select restaurant, coalesce(category, 'Other') as category, sum(qty) as qty from f join cm using (restaurant, name) group by 1, 2")
def cart_qty_by_category(spark, sf_dir):
    return cart.quantity_by_category(_cart(spark, sf_dir), _cart_menu(spark, sf_dir))


@query(f"with {_RUNS} select user_id, count(*) as pieces from (select user_id, unnest(range(qty::bigint)) from f) group by 1")
def cart_rows(spark, sf_dir):
    return cart.as_rows(_cart(spark, sf_dir)).groupBy("user_id").agg(F.count(F.lit(1)).alias("pieces"))


@query("""with r as (select user_id, event_type, event_id, event_id % 3 <> 0 as is_on from events), n as (select *, row_number() over (partition by user_id, event_type, is_on order by event_id desc) as r from r)
    select user_id, count(*) filter (where is_on and r > 1) as still_on from n group by 1""")
def switched_off_last(spark, sf_dir):
    r = table(spark, sf_dir, "events").selectExpr("user_id", "event_type", "event_id seq", "event_id % 3 <> 0 on")
    return cart.switch_off_last(r, ["user_id", "event_type"]).groupBy("user_id").agg(F.count_if("on").alias("still_on"))


@query("select user_id, event_id, value from (select *, row_number() over (partition by user_id order by event_id desc) as r from events where epoch_ms(ts) > (select max(epoch_ms(ts)) - 604800000 from events)) where r = 1")
def ttl_latest_snapshot(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("saved_at", F.unix_millis(F.col("ts").cast("timestamp")))
    now = e.agg(F.max("saved_at")).first()[0]
    return loaders.latest_by_event(loaders.fresh(e, now), "user_id", "event_id").select("user_id", "event_id", "value")


@query("select event_type, time_bucket(interval '1 hour', ts) as start, count(*) as n, round(sum(value), 4) as value from events group by 1, 2")
def tumbling_counts(spark, sf_dir):
    return snapshots.tumbling_counts(table(spark, sf_dir, "events")).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("value", 4).alias("value"))


@query("""with e as (select user_id, ts, value, case when ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval '30 minutes' then 1 else 0 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as g from e)
    select user_id, min(ts) as start, count(*) as n, round(sum(value), 4) as value from s group by user_id, g""")
def session_windows(spark, sf_dir):
    return snapshots.session_windows(table(spark, sf_dir, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("value", 4).alias("value"))


@query("""select d.doc_id, d.lang, d.source, case when l.toxic = 1 then 'toxic' when l.quality = 0 then 'poor' when l.quality = 1 then 'good' end as tag from documents d left join labels l using (doc_id)""")
def item_quality_tags(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id", "left").select("doc_id", "lang", "source", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good").alias("tag"))


@query("select user_id, round(sum(value), 6) as calories, count(*) as rows from events where event_id % 3 <> 0 group by 1")
def kept_meal_total(spark, sf_dir):
    r = table(spark, sf_dir, "events").selectExpr("user_id", "event_id % 3 <> 0 on", "value calories", "0 protein", "0 fat", "0 carbs")
    return cart.kept_total(r, "user_id").select("user_id", F.round("calories", 6).alias("calories"), "rows")


@query(f"""with m as ({MENU_SQL}), b as (select restaurant, name as base, min(item_seq) as ord from m where size % 2 = 0 group by 1, 2), r as (select item_seq, restaurant, case when item_seq % 3 = 0 then name else name || ' — rice, beans' end as name from m)
    select r.item_seq, b.base from r left join b on b.restaurant = r.restaurant and r.name = b.base || ' — rice, beans'""")
def composed_rows(spark, sf_dir):
    m = menu(spark, sf_dir)
    bases = m.where("size % 2 = 0").groupBy("restaurant", F.col("name").alias("base")).agg(F.min("item_seq").alias("ord"))
    rows = m.select("item_seq", "restaurant", F.expr("case when item_seq % 3 = 0 then name else concat(name, ' — rice, beans') end").alias("name"))
    return cart.on_composed_menu(rows, bases).select("item_seq", "base")


@query(f"with m as ({MENU_SQL}) select item_seq, case when item_seq % 3 = 0 then '' else 'rice+beans' end as labels, replace(name, '_', ' ') as pretty from m")
def composed_labels(spark, sf_dir):
    name = F.expr("case when item_seq % 3 = 0 then name else concat(name, ' — rice, beans') end")
    return menu(spark, sf_dir).select("item_seq", F.array_join(exprs.composed_labels(name), "+").alias("labels"), exprs.pretty_name(F.col("name")).alias("pretty"))


@query("select event_id, k[1] as first, k[2] as second from (select event_id, [greatest(event_id % 200 - event_id % 90, 0), greatest(event_id % 70 - event_id % 40, 0)] as k from events)")
def screenshot_rows(spark, sf_dir):
    line = F.expr("concat(event_id % 90, 'g / ', event_id % 200, '   ', event_id % 40, ' / ', event_id % 70)")
    v = exprs.values_in_row(line, 2)
    return table(spark, sf_dir, "events").select("event_id", v[0].alias("first"), v[1].alias("second"))


@query("""select user_id, event_id, 'https://x/#remaining=' || event_id || ',60.5,35,100' as url, event_id::double as calories, 60.5 as protein from events""")
def url_targets(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr("concat('https://x/#remaining=', event_id, ',60.5,35,100')").alias("url"))
    t = exprs.hash_targets(F.col("url"))
    return e.select("user_id", "event_id", "url", t["calories"].alias("calories"), t["protein"].alias("protein"))
