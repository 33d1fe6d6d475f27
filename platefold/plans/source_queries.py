"""Queries about raw documents of each shape; the documents are made from part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..macros import MACROS, Target
from ..operators import layout, optimize, report, tree
from ..sources import adapters, loaders
from .menu import MENU_SQL, menu, table
from .optimizer_queries import ITEMS, TOP
from .optimizer_queries import _sql as search_sql

QUERIES, SQL = {}, {}
M4 = ", ".join(MACROS)
WANTED = Target(900, 60, 35, 100)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _facts(unit: str = "") -> str:
    return "named_struct(" + ", ".join(f"'{m}', concat(cast({m} as string), '{unit}')" for m in MACROS) + ")"


def _doc(spark, sf_dir, item: str, wrap: str):
    """One JSON document for each restaurant: ``item`` for each menu row in order, gathered in ``wrap``."""
    m = menu(spark, sf_dir).select("restaurant", F.expr(f"struct(item_seq, {item} as i)").alias("x"))
    d = m.groupBy("restaurant").agg(F.array_sort(F.collect_list("x")).alias("xs")).select(F.col("restaurant").alias("doc_id"), F.transform("xs", lambda x: x["i"]).alias("items"))
    return d.select("doc_id", F.expr(f"to_json({wrap})").alias("json"))


_SEQ = "row_number() over (partition by restaurant order by item_seq)"
_TITLED = "array_to_string(list_transform(regexp_extract_all(lower(category), '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda t: upper(t[1]) || t[2:]), '')"
_CATEGORY = f"case when category = lower(category) or category = upper(category) then {_TITLED} else category end"


@query(f"with m as ({MENU_SQL}) select restaurant as doc_id, {_SEQ} as seq, name, {_CATEGORY} as category, {M4} from m")
def embedded_items(spark, sf_dir):
    d = _doc(spark, sf_dir, f"named_struct('name', name, 'category', category, 'facts', {_facts(' g')})", "named_struct('props', named_struct('items', items))")
    html = d.select("doc_id", F.concat(F.lit('<p>x</p><script id="__NEXT_DATA__" type="application/json">'), "json", F.lit("</script>")).alias("html"))
    return adapters.embedded_items(html).drop("label")


@query(f"""with m as ({MENU_SQL}), k as (select *, row_number() over (partition by restaurant order by item_seq) as r from m where item_seq % 10 <> 0),
    e as (select restaurant, r, 0 as o, name, {M4} from k where item_seq % 7 <> 0 union all select restaurant, r, 0, name || ' A', {M4} from k where item_seq % 7 = 0 union all select restaurant, r, 1, name || ' B', {M4} from k where item_seq % 7 = 0)
    select restaurant as doc_id, row_number() over (partition by restaurant order by r, o) as seq, name, 'Mains' as category, {M4} from e""")
def cms_items(spark, sf_dir):
    option = f"array(named_struct('name', concat(name, '  A'), 'facts', {_facts()}), named_struct('name', concat(name, ' B'), 'facts', {_facts()}))"
    item = f"named_struct('type', case when item_seq % 10 = 0 then 'combo' else 'item' end, 'name', name, 'facts', {_facts()}, 'options', case when item_seq % 7 = 0 then {option} end)"
    return adapters.cms_items(_doc(spark, sf_dir, item, "named_struct('sections', array(named_struct('title', 'MAINS', 'items', items)))")).drop("label")


@query(f"""with m as ({MENU_SQL}), e as (select restaurant, item_seq, 0 as o, name, category, case when item_seq % 4 = 0 then 'small' end as label, {M4} from m
    union all select restaurant, item_seq, 1, name, category, 'large', calories * 2, protein, fat, carbs from m where item_seq % 4 = 0)
    select restaurant as doc_id, row_number() over (partition by restaurant order by item_seq, o) as seq, name, category, label, {M4} from e""")
def sized_items(spark, sf_dir):
    large = _facts().replace("cast(calories as string)", "cast(calories * 2 as string)")
    sizes = f"array(named_struct('slug', 'sauce', 'options', array(named_struct('label', 'x', 'facts', {_facts()}))), named_struct('slug', 'choose-size-1', 'options', array(named_struct('label', 'small', 'facts', {_facts()}), named_struct('label', 'large', 'facts', {large}))))"
    item = f"named_struct('name', name, 'category', category, 'facts', {_facts()}, 'modifiers', case when item_seq % 4 = 0 then {sizes} end)"
    return adapters.sized_items(_doc(spark, sf_dir, item, "named_struct('products', items)"))


@query(f"with m as ({MENU_SQL}), r as (select *, row_number() over (partition by restaurant order by item_seq) as r from m where item_seq % 3 = 0) select restaurant as doc_id, 1 as seq, name, category, {M4} from r where r = 1")
def component_items(spark, sf_dir):
    item = f"named_struct('__typename', case when item_seq % 3 = 0 then 'Product' else 'Banner' end, 'name', name, 'category', category, 'facts', {_facts()})"
    return adapters.component_items(_doc(spark, sf_dir, item, "named_struct('components', items)")).drop("label")


@query(f"""with m as ({MENU_SQL}), r as (select *, row_number() over (partition by restaurant order by item_seq) as r, count(*) over (partition by restaurant) as n from m)
    select restaurant as doc_id, name, case when r = 1 then 'Top' else 'Inner' end as category, {M4} from r""")
def menu_tree_items(spark, sf_dir):
    item = "named_struct('name', name, 'nutrition', named_struct(" + ", ".join(f"'{m}', concat(cast({m} as string), ' x')" for m in MACROS) + "))"
    wrap = "named_struct('hasMenuSection', named_struct('name', 'Top', 'hasMenuItem', items[0], 'hasMenuSection', array(named_struct('name', 'Inner', 'hasMenuItem', slice(items, 2, 100000)))))"
    return adapters.menu_tree_items(_doc(spark, sf_dir, item, wrap), deepest=4).drop("label", "seq")


@query(f"with m as ({MENU_SQL}) select restaurant as doc_id, row_number() over (partition by restaurant order by item_seq) as seq, name, 'Hot Food' as category, {M4} from m where item_seq % 6 <> 0 and not contains(lower(name), 'red')")
def html_table_items(spark, sf_dir):
    row = "concat('<tr><td>', name, '</td><td>', case when item_seq % 6 = 0 then '-' else concat(calories, ' kcal') end, '</td><td>', protein, '</td><td><b>', fat, '</b></td><td>', carbs, '</td></tr>')"
    d = _doc(spark, sf_dir, row, "named_struct('h', concat('<h2>HOT FOOD</h2><table>', array_join(items, ''), '</table>'))")
    return adapters.html_table_items(d.select("doc_id", F.get_json_object("json", "$.h").alias("html")), deny_names=("red",)).drop("label")


@query(f"with m as ({MENU_SQL}) select item_seq as doc_id, name, calories, protein, fat, carbs from m")
def nutrition_pairs(spark, sf_dir):
    pair = lambda label, v: f"named_struct('label', '{label}', 'value', concat({v}, ' g'))"
    pairs = f"array({pair('Energy (kJ)', '1')}, {pair('Energy (kcal)', 'calories')}, {pair('of which saturated fat', '0')}, {pair('Fat', 'fat')}, {pair('Carbohydrate', 'carbs')}, {pair('of which sugars', '0')}, {pair('Protein', 'protein')})"
    d = menu(spark, sf_dir).select(F.col("item_seq").alias("doc_id"), F.expr(f"to_json(named_struct('name', name, 'category', category, 'pairs', {pairs}))").alias("json"))
    return adapters.nutrition_pairs(d).select("doc_id", "name", *MACROS)


@query("with r as (select l_partkey, min(l_orderkey * 10 + l_linenumber) as ord from lineitem group by 1) select p_partkey as url, r.ord, p_name from r join part on p_partkey = l_partkey")
def listing_details(spark, sf_dir):
    listing = table(spark, sf_dir, "lineitem").selectExpr("l_partkey url", "l_orderkey * 10 + l_linenumber ord").distinct()
    return adapters.listing_details(listing, table(spark, sf_dir, "part").selectExpr("p_partkey url", "p_name")).select("url", "ord", "p_name")


@query("select user_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by 1")
def latest_menu(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return loaders.latest_menu(e, "user_id", "event_id").select("user_id", "event_type", "value")


@query("select l_orderkey as doc_id, max(l_linenumber) as pos from lineitem where l_linenumber % 2 = 0 group by 1")
def remaining_row(spark, sf_dir):
    cells = F.expr("case when l_linenumber % 2 = 0 then array('Your Remaining', cast(l_linenumber as string), 'a', 'b', 'c') else array('Totals', '0', 'a', 'b', 'c') end")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), cells.alias("cells"), F.lit(False).alias("in_summary"))
    return loaders.remaining_row(rows, "doc_id").select("doc_id", F.col("cells")[1].cast("int").alias("pos"))


@query("""with c as (select l_orderkey as doc_id, l_linenumber // 3 as page, max(l_partkey * 100 + l_linenumber) as y from lineitem where l_returnflag = 'R' group by 1, 2), f as (select *, row_number() over (partition by doc_id order by page) as r from c)
    select doc_id, 'V' || y as stamp from f where r = 1""")
def version_stamp(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey doc_id", "l_linenumber div 3 page", "l_partkey * 100 + l_linenumber y", "case when l_returnflag = 'R' then concat('V', l_partkey * 100 + l_linenumber) else 'text' end str")
    return loaders.version_stamp(c)


@query("select p_partkey as key, case when p_partkey % 3 = 0 then 'unchanged' when p_partkey % 3 = 1 then 'refused' else 'replace' end as decision from part")
def changed_documents(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    old = p.selectExpr("p_partkey key", "'1' version", "p_name content")
    new = p.selectExpr("p_partkey key", "case when p_partkey % 3 = 2 then '2' else '1' end version", "case when p_partkey % 3 = 0 then p_name else p_brand end content")
    return loaders.changed_documents(old, new)


@query("select event_id, coalesce(case when event_id % 3 = 0 then null else value end, 900.0) as calories, coalesce(case when event_id % 5 = 0 then null else value / 10 end, 60.0) as protein from events")
def merged_targets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    given = {"calories": F.expr("case when event_id % 3 = 0 then cast('NaN' as double) else value end"), "protein": F.expr("case when event_id % 5 = 0 then null else value / 10 end")}
    return e.select("event_id", *loaders.merge_targets(given, {"calories": F.lit(900.0), "protein": F.lit(60.0)}))


_SIGNED = ", ".join(f"floor({m} + 0.5)::bigint || ' (' || case when {m} >= {WANTED[m]} then '+' else '' end || floor({m} - {WANTED[m]} + 0.5)::bigint || ')' as {m}" for m in MACROS)


@query(f"{search_sql()} select restaurant, rank, {_SIGNED}, {', '.join(f"case when {m}_off < 0.1 then 'good' when {m}_off < 0.2 then 'warn' else 'bad' end as {m}_band" for m in MACROS)}, floor((1 - avg_accuracy) * 100 + 0.5)::bigint || '% match' as match from best")
def meal_report(spark, sf_dir):
    return report.report(optimize.combinations(menu(spark, sf_dir), WANTED, ITEMS, TOP), WANTED).drop("best")


@query("""with c as (select l_orderkey as doc, l_linenumber as k from lineitem group by 1, 2), r as (select doc, count(*) as n from c group by 1)
    select doc, n >= 3 as header from r""")
def header_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("k"))
    labels = F.transform("k", lambda k: F.concat(F.lit("col"), k.cast("string")))
    return lines.select("doc", layout.is_header(labels, {f"role{i}": f"^col{i}$" for i in range(1, 9)}).alias("header"))


@query("""with l as (select l_orderkey as doc_id, l_linenumber * 5 + (l_linenumber % 3) * 8 as y, l_linenumber % 3 = 0 as anchor from lineitem group by 1, 2, 3), g as (select *, lag(y) over (partition by doc_id order by y desc) - y as gap from l),
    b as (select *, sum(case when anchor or coalesce(not anchor and (gap <= 0 or gap > 14), false) then 1 else 0 end) over (partition by doc_id order by y desc) as grp from g), f as (select *, first_value(anchor) over (partition by doc_id, grp order by y desc) as head from b)
    select doc_id, y, case when head then grp end as row from f""")
def wrapped_rows(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey doc_id", "1 page", "l_linenumber * 5 + (l_linenumber % 3) * 8 y", "l_linenumber % 3 = 0 anchor").distinct()
    return layout.attach_wrapped(l).select("doc_id", "y", "row")


GROUPS = [("g", None, 1, "exactly", 2), ("h", "c0", 1, "one", None), ("k", "c1", 1, "many", None)]
TREE = "group_id string, parent_choice_id string, ord int, selection string, count int"


VALIDITY = f"""with m as ({MENU_SQL}), g as (select restaurant, count(*) n, bool_or(item_seq % 3 = 0) zero, bool_or(item_seq % 3 = 1) one, {", ".join(f"sum({x}) {x}" for x in MACROS)} from m where item_seq % 29 = 0 group by 1),
    h as (select restaurant, count(*) n, {", ".join(f"sum({x}) {x}" for x in MACROS)} from m where item_seq % 31 = 0 group by 1),
    k as (select restaurant, {", ".join(f"sum({x}) {x}" for x in MACROS)} from m where item_seq % 37 = 0 group by 1)
    select r.restaurant, coalesce(g.n, 0) = 2 and (not coalesce(zero, false) or coalesce(h.n, 0) = 1) as valid,
        {", ".join(f"(coalesce(g.{x}, 0) + case when zero then coalesce(h.{x}, 0) else 0 end + case when one then coalesce(k.{x}, 0) else 0 end)::bigint as {x}" for x in MACROS)}
    from (select distinct restaurant from m) r left join g using (restaurant) left join h using (restaurant) left join k using (restaurant)"""


@query(VALIDITY)
def build_validity(spark, sf_dir):
    m = menu(spark, sf_dir)
    picks = m.where("item_seq % 29 = 0").withColumn("group_id", F.lit("g"))
    for n, g in ((31, "h"), (37, "k")):
        picks = picks.unionByName(m.where(f"item_seq % {n} = 0").withColumn("group_id", F.lit(g)))
    picks = picks.select(F.col("restaurant").alias("build"), "group_id", F.expr("case when group_id = 'g' then concat('c', item_seq % 3) else concat(group_id, item_seq) end").alias("choice_id"), *MACROS)
    return tree.valid_picks(spark.createDataFrame(GROUPS, TREE), picks, m.select(F.col("restaurant").alias("build"))).withColumnRenamed("build", "restaurant")


@query(f"with v as ({VALIDITY}) select * exclude (valid) from v where valid")
def build_picks(spark, sf_dir):
    """What valid builds add up to."""
    return build_validity(spark, sf_dir).where("valid").drop("valid")


@query("""with l as (select p_partkey as meal, [['Rice', 'Beans', 'Corn', 'Hot'][1 + p_partkey % 4], ['Rice', 'Beans', 'Corn', 'Hot'][1 + p_partkey // 4 % 4], ['Rice', 'Beans', 'Corn', 'Mild'][1 + p_partkey // 16 % 4]] as t from part)
    select meal, 0 as depth, 'a' as group_id, 'a-' || t[1] as choice_id from l where t[1] in ('Rice', 'Beans')
    union all select distinct meal, 0, 'b', 'b-' || x from (select meal, unnest(t[2:3]) as x from l) where x in ('Rice', 'Beans', 'Corn')
    union all select meal, 1, 'c', 'c-' || t[2] from l where t[1] = 'Rice' and t[2] in ('Hot', 'Mild')""")
def label_picks(spark, sf_dir):
    groups = spark.createDataFrame([("a", None, 1, "one", None), ("b", None, 2, "exactly", 2), ("c", "a-Rice", 1, "one", None)], TREE)
    offers = [("a", "Rice"), ("a", "Beans"), ("b", "Rice"), ("b", "Beans"), ("b", "Corn"), ("c", "Hot"), ("c", "Mild")]
    choices = spark.createDataFrame([(g, f"{g}-{x}", k, x) for k, (g, x) in enumerate(offers)], "group_id string, choice_id string, ord int, label string")
    at = lambda n, last: F.expr(f"element_at(array('Rice', 'Beans', 'Corn', '{last}'), cast(1 + (p_partkey div {n}) % 4 as int))")
    meals = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("meal"), F.array(at(1, "Hot"), at(4, "Hot"), at(16, "Mild")).alias("labels"))
    return tree.resolve_labels(groups, choices, meals).select("meal", "depth", "group_id", "choice_id")
