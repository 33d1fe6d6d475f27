"""Queries about items: text functions, filters, normalising, dishes, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..macros import MACROS
from ..operators import compose, filters, normalize, report, tree
from ..sources import loaders
from .menu import MENU_SQL, menu, table

M4 = ", ".join(MACROS)
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query, with the SQL that gives the same."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- filters ---

DENY = ["PROMO BRUSHED", "small plated", "economy anodized"]
_DENY_SQL = "('promo brushed', 'small plated', 'economy anodized')"


def _with_tags(items):
    return items.withColumn("dietary", F.expr("case when item_seq % 7 = 0 then array('vegetarian', 'vegan') when item_seq % 5 = 0 then array('vegetarian') when item_seq % 3 = 0 then array('halal') end"))


_TAGS = "case when item_seq % 7 = 0 then ['vegetarian', 'vegan'] when item_seq % 5 = 0 then ['vegetarian'] when item_seq % 3 = 0 then ['halal'] end"


@query(f"with m as ({MENU_SQL}), c as (select distinct category from m where category is not null order by 1 limit 2) select * from m where coalesce(category not in (select category from c), true)")
def exclude_categories_nullsafe(spark, sf_dir):
    m = menu(spark, sf_dir)
    two = [r[0].upper() for r in m.select("category").where("category is not null").distinct().orderBy("category").limit(2).collect()]
    return filters.exclude_categories(m, two)


_MODES = "case when restaurant like '%1' then 'include' when restaurant like '%2' then 'exclude' when restaurant like '%3' then 'all' end"


def _filters(spark, sf_dir):
    m = menu(spark, sf_dir).where("category is not null")
    return m.groupBy("restaurant").agg(F.expr("array(upper(min(category)))").alias("categories")).withColumn("mode", F.expr(_MODES)).where("mode is not null")


@query(f"""with m as ({MENU_SQL}), f as (select restaurant, min(category) as c, {_MODES} as mode from m where category is not null group by restaurant)
    select m.* from m left join f on f.restaurant = m.restaurant and f.mode is not null
    where f.mode is null or f.mode = 'all' or (f.mode = 'include' and coalesce(m.category = f.c, false)) or (f.mode = 'exclude' and not coalesce(m.category = f.c, false))""")
def filter_categories_by_menu(spark, sf_dir):
    return filters.filter_by_restaurant(menu(spark, sf_dir), _filters(spark, sf_dir))


@query(f"with m as ({MENU_SQL}) select item_seq, name from m where list_contains(coalesce({_TAGS}, []), 'vegetarian')")
def dietary_filter(spark, sf_dir):
    return filters.dietary(_with_tags(menu(spark, sf_dir)), "vegetarian").select("item_seq", "name")


@query(f"with m as ({MENU_SQL}) select item_seq, name from m where not contains(lower(name), 'red') and not contains(lower(name), 'gr')")
def dish_denylist(spark, sf_dir):
    return filters.without_dishes(menu(spark, sf_dir), ["RED", " ", "gr"]).select("item_seq", "name")


@query(f"with m as ({MENU_SQL}) select distinct name from m where contains(lower(name), 'e') order by name limit 8")
def dish_preview(spark, sf_dir):
    return filters.dish_preview(menu(spark, sf_dir), "E")


#: A menu whose categories the presets know: by item number.
_CATEGORY = "case item_seq % 9 when 0 then 'Sides & Dips' when 1 then 'Hot Drinks' when 2 then 'Milkshakes' when 3 then 'Desserts' when 4 then 'Toppings' when 5 then 'Salads Includes Toppings' when 6 then 'Breakfast Rolls' when 7 then 'Dips' else 'Burgers' end"


def _groups(spark, sf_dir):
    m = menu(spark, sf_dir).withColumn("c", F.expr(_CATEGORY)).where("item_seq % 4 <> 0")
    return m.groupBy("restaurant").agg(F.array_sort(F.collect_set("c")).alias("categories"))


_GROUPS_SQL = f"m as ({MENU_SQL}), g as (select distinct restaurant, {_CATEGORY} as category from m where item_seq % 4 <> 0)"
_PRESETS_SQL = "p(key, keywords, exact) as (values " + ", ".join("('{}', [{}], [{}]::varchar[])".format(k, ", ".join("'" + w.replace("'", "''") + "'" for w in ws), ", ".join(f"'{w}'" for w in x)) for k, _, ws, x in filters.PRESETS) + ")"
_HIT = "(len(list_filter(p.keywords, lambda w: contains(lower(g.category), w))) > 0 or list_contains(p.exact, lower(g.category)))"


@query(f"with {_GROUPS_SQL}, {_PRESETS_SQL} select p.key, g.restaurant, string_agg(g.category, '|' order by g.category) as matched from g join p on {_HIT} group by 1, 2")
def preset_matches(spark, sf_dir):
    return filters.preset_matches(_groups(spark, sf_dir)).withColumn("matched", F.array_join("matched", "|"))


@query(f"with {_GROUPS_SQL}, {_PRESETS_SQL} select p.key, count(distinct g.restaurant) as restaurants from g join p on {_HIT} group by 1")
def relevant_presets(spark, sf_dir):
    return filters.relevant_presets(_groups(spark, sf_dir))


def _chosen(spark, sf_dir):
    return _groups(spark, sf_dir).select("restaurant", F.expr("case when restaurant like '%1' then 'include' when restaurant like '%2' then 'exclude' else 'all' end").alias("mode"), F.expr("case when restaurant like '%3' then array() when restaurant like '%2' then array('Dips', 'Burgers') else array('Burgers') end").cast("array<string>").alias("categories"))


_CHOSEN_SQL = "f as (select distinct restaurant, case when restaurant like '%1' then 'include' when restaurant like '%2' then 'exclude' else 'all' end as mode, case when restaurant like '%3' then []::varchar[] when restaurant like '%2' then ['Dips', 'Burgers'] else ['Burgers'] end as categories from g)"
_OWN_SQL = "own as (select g.restaurant, list(g.category order by g.category) as matched from g join p on {hit} where p.key = 'sides' group by 1)".format(hit=_HIT)


@query(f"""with {_GROUPS_SQL}, {_PRESETS_SQL}, {_CHOSEN_SQL}, {_OWN_SQL},
    n as (select f.restaurant, f.mode, f.categories, o.matched, case when f.mode = 'exclude' then f.categories else []::varchar[] end as old from f left join own o using (restaurant))
    select restaurant, case when matched is null or mode = 'include' then mode else 'exclude' end as mode,
        array_to_string(case when matched is null or mode = 'include' then categories else list_concat(old, list_filter(matched, lambda x: not list_contains(old, x))) end, '|') as categories from n""")
def preset_toggle_on(spark, sf_dir):
    return filters.toggle_preset(_groups(spark, sf_dir), _chosen(spark, sf_dir), "sides", True).withColumn("categories", F.array_join("categories", "|"))


@query(f"""with {_GROUPS_SQL}, {_PRESETS_SQL}, {_CHOSEN_SQL}, {_OWN_SQL},
    n as (select f.restaurant, f.mode, f.categories, o.matched, list_filter(case when f.mode = 'exclude' then f.categories else []::varchar[] end, lambda x: not list_contains(coalesce(o.matched, []), x)) as rest from f left join own o using (restaurant))
    select restaurant, case when matched is null or mode = 'include' then mode when len(rest) > 0 then 'exclude' else 'all' end as mode,
        array_to_string(case when matched is null or mode = 'include' then categories else rest end, '|') as categories from n""")
def preset_toggle_off(spark, sf_dir):
    return filters.toggle_preset(_groups(spark, sf_dir), _chosen(spark, sf_dir), "sides", False).withColumn("categories", F.array_join("categories", "|"))


@query(f"""with {_GROUPS_SQL}, {_PRESETS_SQL}, {_CHOSEN_SQL}, o as (select p.key, g.restaurant, list(g.category) as matched from g join p on {_HIT} group by 1, 2)
    select key, bool_and(coalesce(f.mode = 'exclude' and len(list_filter(o.matched, lambda x: not list_contains(f.categories, x))) = 0, false)) as active from o left join f using (restaurant) group by 1""")
def preset_active(spark, sf_dir):
    return filters.preset_active(_groups(spark, sf_dir), _chosen(spark, sf_dir))


@query(f"with {_GROUPS_SQL}, {_CHOSEN_SQL} select count(*) filter (where mode <> 'all' and len(categories) > 0) as active from f")
def active_filter_count(spark, sf_dir):
    return filters.active_filters(_chosen(spark, sf_dir))


@query(f"""with {_GROUPS_SQL}, {_CHOSEN_SQL} select restaurant, array_to_string(case when list_contains(categories, 'Burgers') then list_filter(categories, lambda x: x <> 'Burgers') else list_append(categories, 'Burgers') end, '|') as toggled,
    array_to_string(case when len(list_filter(categories, lambda x: lower(x) = 'dips')) > 0 then categories else list_append(categories, 'DIPS') end, '|') as terms from f""")
def category_and_term_toggles(spark, sf_dir):
    f = _chosen(spark, sf_dir)
    return f.select("restaurant", F.array_join(filters.toggle_category(F.col("categories"), F.lit("Burgers")), "|").alias("toggled"), F.array_join(filters.add_term(F.col("categories"), F.lit("DIPS")), "|").alias("terms"))


# --- normalising ---

_STATUS_ITEMS = "select restaurant, item_seq, category, case when item_seq % 13 = 0 then null when item_seq % 17 = 0 then 0 else calories end as calories, case when item_seq % 19 = 0 then null else protein * 2 end as protein, fat, carbs from m"


def _odd_items(spark, sf_dir):
    m = menu(spark, sf_dir)
    return m.withColumn("calories", F.expr("case when item_seq % 13 = 0 then null when item_seq % 17 = 0 then 0 else calories end")).withColumn("protein", F.expr("case when item_seq % 19 = 0 then null else protein * 2 end"))


def _status_sql(reject: bool) -> str:
    gone = "calories is null" + (" or protein is null" if reject else "")
    return f"""case when {gone} then 'incomplete' when calories <= 0 then 'invalid'
        when coalesce(protein, 0) * 4 > calories * 1.3::double or coalesce(carbs, 0) * 4 > calories * 1.3::double or coalesce(fat, 0) * 9 > calories * 1.3::double then 'implausible'
        when coalesce(lower(category) in {_DENY_SQL}, false) then 'excluded' else 'ok' end"""


@query(f"with m as ({MENU_SQL}), o as ({_STATUS_ITEMS}) select item_seq, {_status_sql(False)} as status, {_status_sql(True)} as strict_status from o")
def plausibility_status(spark, sf_dir):
    m = _odd_items(spark, sf_dir)
    both = normalize.with_status(normalize.with_status(m, "reject", DENY).withColumnRenamed("status", "strict_status"), "zero", DENY)
    return both.select("item_seq", "status", "strict_status")


@query(f"with m as ({MENU_SQL}), o as ({_STATUS_ITEMS}), s as (select restaurant, {_status_sql(False)} as status from o) select restaurant, status, count(*) as n from s group by 1, 2")
def status_counts(spark, sf_dir):
    return normalize.status_counts(normalize.with_status(_odd_items(spark, sf_dir), "zero", DENY))


_COLLIDE = f"""with m as ({MENU_SQL}), d as (select *, row_number() over (partition by restaurant, name, {M4} order by item_seq) as r from m),
    k as (select *, row_number() over f as k, first_value(category) over f as c1 from d where r = 1 window f as (partition by restaurant, name order by item_seq)),
    s as (select *, min(case when k >= 2 and coalesce(category, '') <> '' and coalesce(c1, '') <> '' and category <> c1 then k end) over (partition by restaurant, name) as s from k),
    n as (select *, sum(case when k >= 2 and not coalesce(k = s, false) then 1 else 0 end) over (partition by restaurant, name order by item_seq) + 1 as n from s)
    select restaurant, item_seq, case when (k = 1 and s is not null) or coalesce(k = s, false) then name || ' (' || category || ')' when k >= 2 then name || ' (' || n || ')' else name end as final_name from n"""


@query(_COLLIDE)
def collision_names(spark, sf_dir):
    return normalize.resolve_collisions(menu(spark, sf_dir)).select("restaurant", "item_seq", "final_name")


def _variants(spark, sf_dir):
    m = menu(spark, sf_dir)
    v = m.withColumn("variant", F.expr("case when item_seq % 3 <> 0 then named_struct('base', name, 'label', 'Size', 'option', case when size % 7 = 0 then 'Per slice (Large)' else concat('Size ', cast(size % 4 as string)) end) end"))
    return normalize.stamp_variants(v)


_STAMP = f"""m as ({MENU_SQL}), v as (select *, case when item_seq % 3 <> 0 then name end as base, case when size % 7 = 0 then 'Per slice (Large)' else 'Size ' || (size % 4) end as option from m),
    w as (select *, count(*) over (partition by restaurant, base) as n, (select count(distinct u.option) from v u where u.restaurant = v.restaurant and u.base = v.base) as options from v),
    st as (select *, case when base is not null and n > 1 and options > 1 then base end as variant_of from w)"""


@query(f"with {_STAMP} select item_seq, variant_of, case when variant_of is not null then 'Size' end as variant_label, case when variant_of is not null then option end as variant_option from st")
def stamped_variants(spark, sf_dir):
    return _variants(spark, sf_dir).select("item_seq", "variant_of", "variant_label", "variant_option")


_REGROUP = f"""{_STAMP}, lab as (select *, row_number() over (partition by restaurant, variant_of, option order by item_seq) as rep from st where variant_of is not null),
    l2 as (select *, case when rep = 1 then option else option || ' (' || rep || ')' end as label, row_number() over (partition by restaurant, variant_of order by calories, item_seq) as rc, count(*) over (partition by restaurant, variant_of) as cnt from lab),
    grp as (select restaurant, variant_of, min(item_seq) as item_seq, first(category order by item_seq) as category, string_agg(label || ':' || calories, ', ' order by item_seq) as options, count(*) as cnt, min(calories) as least, max(calories) as most from l2 group by 1, 2),
    mid as (select restaurant, variant_of, {M4} from l2 where rc = (cnt + 1) // 2)"""


@query(f"""with {_REGROUP} select g.restaurant, g.item_seq, g.variant_of as name, g.category, {", ".join("mid." + m for m in MACROS)}, g.options from grp g join mid using (restaurant, variant_of)
    union all select restaurant, item_seq, name, category, {M4}, null from st where variant_of is null""")
def variant_regroup(spark, sf_dir):
    r = normalize.regroup_variants(_variants(spark, sf_dir))
    return r.withColumn("options", F.array_join(F.transform("variants", lambda v: F.concat(v["label"], F.lit(":"), v["calories"].cast("string"))), ", ")).drop("variants")


@query(f"with {_REGROUP} select restaurant, variant_of as name, least, most from grp")
def calorie_range(spark, sf_dir):
    return normalize.calorie_range(normalize.regroup_variants(_variants(spark, sf_dir)))


@query(f"with m as ({MENU_SQL}), r as (select *, row_number() over (partition by restaurant, category order by calories, item_seq) as r, count(*) over (partition by restaurant, category) as n from m) select restaurant, category, item_seq, calories from r where r = (n + 1) // 2")
def median_variant(spark, sf_dir):
    return normalize.median_row(menu(spark, sf_dir), ["restaurant", "category"]).select("restaurant", "category", "item_seq", "calories")


@query(f"""with {_REGROUP}, flat as (select restaurant, item_seq, 0::bigint as pos, name, {M4} from st where variant_of is null
        union all select l.restaurant, g.item_seq, row_number() over (partition by l.restaurant, l.variant_of order by l.item_seq) - 1, l.variant_of || ' (' || l.label || ')', {", ".join("l." + m for m in MACROS)} from l2 l join grp g using (restaurant, variant_of)),
    last as (select *, row_number() over (partition by restaurant, name order by item_seq desc, pos desc) as r from flat)
    select restaurant, name, {M4} from last where r = 1""")
def snapshot_to_rows(spark, sf_dir):
    return normalize.to_rows(normalize.regroup_variants(_variants(spark, sf_dir))).select("restaurant", "name", *MACROS)


@query(f"with m as ({MENU_SQL}) select restaurant, name, item_seq from (select *, row_number() over (partition by restaurant, name order by item_seq) as r from m) where r = 1")
def first_of_each_name(spark, sf_dir):
    return normalize.keep_first(menu(spark, sf_dir), ["restaurant", "name"], "item_seq").select("restaurant", "name", "item_seq")


@query(f"with m as ({MENU_SQL}) select restaurant, name, max(item_seq) as item_seq from m group by 1, 2")
def last_of_each_name(spark, sf_dir):
    return normalize.keep_last(menu(spark, sf_dir), ["restaurant", "name"], "item_seq").select("restaurant", "name", "item_seq")


@query(f"with m as ({MENU_SQL}), r as (select name, category, row_number() over (partition by name order by size, item_seq) as r from m) select name, category from r where r = 1")
def best_category_by_priority(spark, sf_dir):
    m = menu(spark, sf_dir).withColumn("category", F.coalesce("category", F.lit("-")))
    return normalize.best_by_priority(m, "name", "size", "item_seq", "category").withColumn("category", F.nullif("category", F.lit("-")))


# --- dishes ---

_INGREDIENTS = f"select p_partkey as ingredient, 120 + (p_partkey * 37) % 700 as calories, 1 + (p_partkey * 13) % 45 as protein, (p_partkey * 7) % 35 as fat, 1 + (p_partkey * 29) % 80 as carbs from part"
_RECIPE = f"with i as ({_INGREDIENTS}), r as (select l_orderkey as dish, {', '.join(f'sum({m} * l_quantity) as {m}' for m in MACROS)}, count(*) as lines from lineitem join i on i.ingredient = l_partkey group by 1)"


def _recipes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dish"), F.col("l_partkey").alias("ingredient"), F.col("l_quantity").alias("multiplier"))
    return compose.recipe_totals(lines, menu(spark, sf_dir).select(F.col("item_seq").alias("ingredient"), *MACROS))


@query(f"{_RECIPE} select * from r")
def recipe_totals(spark, sf_dir):
    return _recipes(spark, sf_dir)


_STATED = "case when dish % 9 = 0 then null when dish % 8 = 0 then calories else calories * (75 + dish % 50) / 100 end"


@query(f"""{_RECIPE}, s as (select *, {_STATED} as stated_kcal from r), g as (select *, case when stated_kcal > 0 then abs(calories - stated_kcal) / stated_kcal end as gap from s),
    o as (select *, case when gap is null then 'unstated' when gap = 0 then 'exact' when gap <= 0.2 then 'anchored' else 'flagged' end as outcome from g)
    select dish, round(gap, 6) as gap, outcome, {", ".join(f"round(case when outcome = 'anchored' then {m} * (stated_kcal / calories) else {m} end, 3) as {m}" for m in MACROS)} from o""")
def recipe_reconcile(spark, sf_dir):
    r = compose.reconcile(_recipes(spark, sf_dir).withColumn("stated_kcal", F.expr(_STATED)))
    return r.select("dish", F.round("gap", 6).alias("gap"), "outcome", *(F.round(m, 3).alias(m) for m in MACROS))


@query("select o_orderkey as dish, o_orderpriority from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')")
def listed_dishes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dish"), "o_orderpriority")
    return compose.listed_dishes(o, table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("dish")))


@query("select o_orderkey as dish, o_orderpriority from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def delisted_dishes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dish"), "o_orderpriority")
    return compose.delisted_dishes(o, table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("dish")))


_SLIP = "case when item_seq % 5 = 0 then 10.0 when item_seq % 7 = 0 then 0.1 else 1.0 end"
_ROW16 = f"""select item_seq, cast(4 * protein + 4 * carbs + 9 * fat as double) * (case when item_seq % 10 = 0 then 10.0 else 1.0 end) as kcal_100, cast(protein as double) * (case when item_seq % 7 = 0 then 0.1 else 1.0 end) as protein_100, cast(fat as double) as fat_100, cast(carbs as double) as carbs_100,
    cast((4 * protein + 4 * carbs + 9 * fat) * (100 + size * 10) as double) / 100 * (case when item_seq % 11 = 0 then 3.0 else 1.0 end) as total_kcal, cast(100 + size * 10 as double) as weight from m"""


def _near(a: str, b: str, t: float) -> str:
    return f"coalesce({b} <> 0 and abs({a} - {b}) / abs(nullif({b}, 0)) <= {t}, false)"


def _checks(f: dict) -> str:
    return f"({_near(f'{f['kcal_100']} * {f['weight']} / 100', f['total_kcal'], 0.02)} and {_near(f'4 * {f['protein_100']} + 4 * {f['carbs_100']} + 9 * {f['fat_100']}', f['kcal_100'], 0.12)})"


_TRY = {x: f"(case when t.field = '{x}' then r.{x} * t.factor else r.{x} end)" for x in compose.REPAIRED}


@query(f"""with m as ({MENU_SQL}), r as ({_ROW16}), t(field, factor) as (values {", ".join(f"('{x}', {k}::double)" for x in compose.REPAIRED for k in (0.1, 10.0))}),
    good as (select item_seq from r where {_checks({x: f"r.{x}" for x in compose.REPAIRED})}),
    hits as (select r.item_seq, t.field, t.factor, count(*) over (partition by r.item_seq) as n from r, t where {_checks(_TRY)} and r.item_seq not in (select item_seq from good))
    select r.item_seq, case when r.item_seq in (select item_seq from good) then 'ok' when h.item_seq is not null then 'repaired' else 'rejected' end as status, h.field, h.factor from r left join hits h on h.item_seq = r.item_seq and h.n = 1""")
def row_repair(spark, sf_dir):
    menu(spark, sf_dir).createOrReplaceTempView("m")
    return compose.repair_rows(spark.sql(_ROW16)).select("item_seq", "status", "field", "factor")


@query(f"""with m as ({MENU_SQL}), s as (select name, arg_min(category, item_seq) as sibling from m where category is not null and category not in ('BUNDLE') and size % 5 <> 0 group by 1)
    select m.item_seq, case when m.size % 5 = 0 then coalesce(s.sibling, 'BUNDLE') else coalesce(m.category, '-') end as resolved from m left join s on s.name = m.name and true""")
def sibling_inheritance(spark, sf_dir):
    m = menu(spark, sf_dir).withColumn("category", F.expr("case when size % 5 = 0 then 'BUNDLE' else coalesce(category, '-') end"))
    named = m.where("category <> '-'")
    own = compose.inherit_from_siblings(named, "name", "category", ["BUNDLE"])
    return own.select("item_seq", "resolved").unionByName(m.where("category = '-'").select("item_seq", F.col("category").alias("resolved")))


@query(f"with m as ({MENU_SQL}) select item_seq, case when item_seq % 6 = 0 then 'vegetarian,vegan' when item_seq % 4 = 0 then 'vegetarian' end as dietary from m")
def dietary_tags(spark, sf_dir):
    m = menu(spark, sf_dir)
    return compose.dietary_tags(m, m.where("item_seq % 4 = 0"), m.where("item_seq % 6 = 0")).select("item_seq", F.array_join("dietary", ",").alias("dietary"))


@query("""with p as (select l_orderkey as k, l_linenumber as n, l_quantity as kcal_100, l_quantity * (case when l_linenumber % 2 = 0 then 1 else 2 end) as total_kcal, 100.0::double as weight from lineitem),
    pairs as (select a.k, a.kcal_100, b.weight, b.total_kcal, coalesce(b.total_kcal <> 0 and abs(a.kcal_100 * b.weight / 100 - b.total_kcal) / abs(nullif(b.total_kcal, 0)) <= 0.02, false) as passes from p a join p b on a.k = b.k),
    ranked as (select *, row_number() over (partition by k order by passes desc, total_kcal desc, weight desc, kcal_100 desc) as r from pairs) select k, kcal_100, weight, total_kcal, passes from ranked where r = 1""")
def portion_row_pick(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey k", "l_quantity kcal_100", "l_quantity * (case when l_linenumber % 2 = 0 then 1 else 2 end) total_kcal", "cast(100 as double) weight")
    return compose.pick_portion_row(p.select("k", "kcal_100"), p.select("k", "weight", "total_kcal"), "k")


# --- trees ---


@query(f"""with m as ({MENU_SQL}), r as (select *, row_number() over (partition by restaurant order by case when calories > 0 then protein::double / calories else 0.0 end desc, item_seq) as r, row_number() over (partition by restaurant order by item_seq) as o, count(*) over (partition by restaurant) as n from m)
    select restaurant, item_seq, case when n <= 5 then o else r end as place from r where n <= 5 or list_contains(list_transform(range(0, 5), lambda i: floor(i * (n - 1) / 4.0 + 0.5)::bigint), r - 1)""")
def diverse_sample(spark, sf_dir):
    return tree.diverse_sample(menu(spark, sf_dir), ["restaurant"], "protein", 5, "item_seq").select("restaurant", "item_seq", "place")


@query(f"with m as ({MENU_SQL}) select item_seq, case when protein >= fat and protein >= carbs then 'protein' when fat >= carbs then 'fat' else 'carbs' end as dominant from m")
def dominant_macro(spark, sf_dir):
    return menu(spark, sf_dir).select("item_seq", tree.dominant_macro_column(F.col("protein"), F.col("fat"), F.col("carbs")).alias("dominant"))


@query("select l_orderkey, l_linenumber, case when l_linenumber % 3 = 1 then 'one' when l_linenumber % 3 = 2 then 'exactly' else 'many' end as selection, case when l_linenumber % 3 = 2 then l_linenumber end as count from lineitem")
def selection_kinds(spark, sf_dir):
    k = tree.selection_kind(F.expr("case when l_linenumber % 3 = 1 then 1 when l_linenumber % 3 = 2 then l_linenumber else 0 end"), F.expr("case when l_linenumber % 3 = 1 then 1 when l_linenumber % 3 = 2 then l_linenumber else 3 end"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", k.alias("k")).select("l_orderkey", "l_linenumber", "k.selection", "k.count")


@query(f"""with m as ({MENU_SQL}), i as (select *, row_number() over (partition by restaurant order by item_seq) as p from m), s as (select * from i where p <= 6)
    select a.restaurant, a.name || '|' || b.name || '|' || c.name as labels, a.calories + b.calories + c.calories as calories from s a join s b on a.restaurant = b.restaurant and b.p > a.p join s c on c.restaurant = b.restaurant and c.p > b.p""")
def three_of_six(spark, sf_dir):
    from pyspark.sql import Window

    s = menu(spark, sf_dir).withColumn("p", F.row_number().over(Window.partitionBy("restaurant").orderBy("item_seq"))).where("p <= 6")
    sets = tree.subsets(s, ["restaurant"], "p", "name", 3)
    calories = s.groupBy("restaurant").agg(F.map_from_entries(F.collect_list(F.struct("p", "calories"))).alias("by"))
    total = F.aggregate("places", F.lit(0).cast("bigint"), lambda a, p: a + F.col("by")[p])
    return sets.join(calories, "restaurant").select("restaurant", F.array_join("labels", "|").alias("labels"), total.alias("calories"))


def _edges(spark, sf_dir):
    """Two formats of each of two restaurants: a root of one, a group of exactly 2 below, a group of one below that."""
    m = menu(spark, sf_dir)
    top = m.withColumn("r", F.expr("row_number() over (partition by restaurant order by item_seq)")).where("r <= 12")
    choices = top.select(F.concat_ws(":", "restaurant", "r").alias("choice_id"), F.concat(F.col("restaurant"), F.expr("case when r <= 3 then '/a' when r <= 8 then '/b' else '/c' end")).alias("group_id"), F.col("r").alias("ord"), F.concat(F.lit("i"), F.col("r")).alias("label"), *MACROS)
    roots = top.select("restaurant").distinct()
    groups = roots.select(F.expr("inline(array(struct(concat(restaurant, '/a'), cast(null as string), 1, 'base', 'one', cast(null as int)), struct(concat(restaurant, '/b'), concat(restaurant, ':1'), 1, 'fillings', 'exactly', 2), struct(concat(restaurant, '/c'), concat(restaurant, ':2'), 1, 'sauce', 'one', cast(null as int))))").alias("group_id", "parent_choice_id", "ord", "label", "selection", "count"))
    return groups, choices


@query(f"""with m as ({MENU_SQL}), t as (select *, row_number() over (partition by restaurant order by item_seq) as r from m), c as (select *, 'i' || r as label from t where r <= 12),
    a as (select * from c where r <= 3), b as (select * from c where r between 4 and 8), k as (select *, row_number() over (partition by restaurant order by case when calories > 0 then protein::double / calories else 0.0 end desc, r) as rk, count(*) over (partition by restaurant) as n from c where r > 8),
    s as (select * from k where n <= 3 or list_contains(list_transform(range(0, 3), lambda i: floor(i * (n - 1) / 2.0 + 0.5)::bigint), rk - 1)),
    pairs as (select x.restaurant, x.label || '|' || y.label as label, {", ".join(f"x.{m} + y.{m} as {m}" for m in MACROS)} from b x join b y on x.restaurant = y.restaurant and y.r > x.r)
    select a.restaurant, a.label || '|' || p.label as labels, {", ".join(f"a.{m} + p.{m} as {m}" for m in MACROS)} from a join pairs p on p.restaurant = a.restaurant where a.r = 1
    union all select a.restaurant, a.label || '|' || s.label, {", ".join(f"a.{m} + s.{m}" for m in MACROS)} from a join s on s.restaurant = a.restaurant where a.r = 2
    union all select restaurant, label, {M4} from a where r = 3""")
def build_tree_expand(spark, sf_dir):
    groups, choices = _edges(spark, sf_dir)
    made = tree.expand(groups, choices, "protein").where("group_id like '%/a'")
    return made.select(F.split("group_id", "/")[0].alias("restaurant"), F.array_join("labels", "|").alias("labels"), *MACROS)


# --- reports ---


@query(f"with m as ({MENU_SQL}) select restaurant, count(*) as item_count, count(distinct name) as names, array_to_string(list_sort(list(distinct category)), '|') as categories from m group by 1")
def menu_index(spark, sf_dir):
    return report.menu_index(menu(spark, sf_dir)).withColumn("categories", F.array_join("categories", "|"))


@query(f"with m as ({MENU_SQL}) select restaurant, coalesce(category, 'Other') as category, count(*) as n, min(name) as first_name from m group by 1, 2")
def items_by_category(spark, sf_dir):
    return report.by_category(menu(spark, sf_dir))


@query(f"with {_STAMP} select restaurant, count(*) filter (where variant_of is null) + count(distinct variant_of) as base_items from st group by 1")
def base_item_count(spark, sf_dir):
    return report.base_item_count(_variants(spark, sf_dir))


@query(f"with m as ({MENU_SQL}) select restaurant, bool_or({_TAGS} is not null) as has_dietary from m group by 1")
def menus_with_dietary_data(spark, sf_dir):
    return report.with_dietary_data(_with_tags(menu(spark, sf_dir)))


@query(f"with m as ({MENU_SQL}) select distinct name from m")
def dish_names(spark, sf_dir):
    return menu(spark, sf_dir).select("name").distinct()


@query(f"""with m as ({MENU_SQL}) select item_seq, round(coalesce(nullif(protein / nullif(calories, 0), 0.0), 1.0), 9) as protein_ratio, floor(fat * size / 100.0 * 10 + 0.5) / 10 as fat_portion,
    restaurant || '::' || name as id, case when abs((protein - 30) / 30.0) <= 0.05 then 'good' when protein < 30 then 'warn' else 'bad' end as protein_status,
    case when 60 - fat >= 0 then (60 - fat) || ' left' else (fat - 60) || ' over' end as fat_left, 'MM1:' || calories || ',' || carbs || ',' || fat || ',' || protein as token from m""")
def item_figures(spark, sf_dir):
    return menu(spark, sf_dir).select(
        "item_seq",
        F.round(exprs.per_calorie(F.col("protein"), F.col("calories")), 9).alias("protein_ratio"),
        exprs.for_weight(F.col("fat"), F.col("size")).alias("fat_portion"),
        exprs.item_id(F.col("restaurant"), F.col("name")).alias("id"),
        exprs.macro_status(F.col("protein"), F.lit(30)).alias("protein_status"),
        exprs.remaining_text(F.col("fat"), F.lit(60)).alias("fat_left"),
        exprs.clipboard_token(F.col("calories"), F.col("carbs"), F.col("fat"), F.col("protein")).alias("token"),
    )


@query(f"with m as ({MENU_SQL}) select k as restaurant, v as item_count from (select restaurant as k, count(*) filter (where item_seq % 50 = 0) as v from m group by 1) where v > 0")
def sources_with_items(spark, sf_dir):
    return menu(spark, sf_dir).groupBy("restaurant").agg(F.count_if(F.col("item_seq") % 50 == 0).alias("item_count")).where("item_count > 0")


@query(f"""with m as ({MENU_SQL}) select restaurant, case when count(*) filter (where item_seq % 2 = 0) > 0 and restaurant not like '%5' then 'new' else 'old' end as taken from m group by 1""")
def keep_last_good(spark, sf_dir):
    m = menu(spark, sf_dir)
    old = m.groupBy("restaurant").agg(F.array_sort(F.collect_list("name")).alias("items")).withColumn("updated_at", F.lit("old"))
    new = m.groupBy("restaurant").agg(F.expr("case when restaurant like '%5' then array() else collect_list(case when item_seq % 2 = 0 then name end) end").cast("array<string>").alias("items")).withColumn("updated_at", F.lit("new"))
    return loaders.keep_last_good(old, new).select("restaurant", F.col("updated_at").alias("taken"))
