"""Queries about meals that fill a target."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..macros import MACROS, Preference, Preferences, Target
from ..operators import optimize
from .menu import MENU_SQL, menu

TARGET = Target(900, 60, 35, 100)
ITEMS, TOP = 3, 3


def _sql(prefs: Preferences = Preferences(), target: Target = TARGET, items: int = ITEMS, top: int = TOP) -> str:
    """CTEs m, cand, lvl and ranked: the same search as a recursive query."""
    eff = optimize.effective(target, prefs)
    bound = " and ".join(["protein >= 1", "carbs >= 1", *(f"{m} <= {eff[m] * 1.3!r}" for m in MACROS if prefs[m].binding)])
    lead = "protein" if eff["protein"] >= max(eff["carbs"], eff["fat"]) else "carbs" if eff["carbs"] >= max(eff["protein"], eff["fat"]) else None
    order = f"{lead}::double / greatest(calories, 1) desc, " if lead else ""
    ok = lambda f: " and ".join([f"{f(m)} <= {eff[m]!r}" for m in MACROS if prefs[m].binding] or ["true"])
    score = " + ".join(f"least({m}::double / {max(eff[m], 1.0)!r}, 1.0::double)" if prefs[m].weight > 0 else "0.0::double" for m in MACROS)
    off = {m: f"abs({m} - {float(target[m])!r}::double) / {max(float(target[m]), 1.0)!r}::double" for m in MACROS}
    return f"""with recursive m as ({MENU_SQL}),
        cand as (select restaurant, row_number() over (partition by restaurant order by {order}item_seq) as i, name, {", ".join(MACROS)} from m where {bound}),
        lvl as (select restaurant, [i] as path, i as last, {", ".join(MACROS)}, 1 as n from cand where {ok(lambda m: m)}
            union all
            select l.restaurant, list_append(l.path, c.i), c.i, {", ".join(f"l.{m} + c.{m}" for m in MACROS)}, l.n + 1
            from lvl l join cand c on c.restaurant = l.restaurant and c.i >= l.last and {ok(lambda m: f"l.{m} + c.{m}")} where l.n < {items}),
        scored as (select *, {score} as score, {", ".join(f"{e} as {m}_off" for m, e in off.items())} from lvl),
        ranked as (select *, row_number() over (partition by restaurant order by score desc, n, path) as rank from scored),
        best as (select *, ({" + ".join(f"{m}_off" for m in MACROS)}) / 4 as avg_accuracy from ranked where rank <= {top})"""


SHOWN = f"select restaurant, rank, array_to_string(path, '-') as items, n, {', '.join(MACROS)}, round(score, 9) as score, round(avg_accuracy, 9) as avg_accuracy from best"


def _combos(spark, sf_dir, prefs=Preferences(), items=ITEMS, target=TARGET, **kw):
    return optimize.combinations(menu(spark, sf_dir), target, items, TOP, prefs, **{"prune": True} | kw)


def _shown(combos):
    return combos.select("restaurant", "rank", F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("items"), "n", *MACROS, F.round("score", 9).alias("score"), F.round("avg_accuracy", 9).alias("avg_accuracy"))


WEIGHTED = Preferences(protein=Preference(1.2, "strict"), fat=Preference(0.8, "strict"))
OVERFLOW = Preferences(protein=Preference(1.5, "allowed"), carbs=Preference(1.0, "allowed"))
ZERO = Preferences(fat=Preference(0.0, "strict"))
SWAP_TOTAL, SWAP_MEAL = {"calories": 520.0, "protein": 31.0, "fat": 22.0, "carbs": 48.0}, ["part_1", "part_2"]


def top_combos_per_menu(spark, sf_dir):
    return _shown(_combos(spark, sf_dir))


def top_combos_unpruned(spark, sf_dir):
    return _shown(_combos(spark, sf_dir, prune=False))


def top_combos_five_items(spark, sf_dir):
    return _shown(_combos(spark, sf_dir, items=5))


def top_combos_weighted(spark, sf_dir):
    return _shown(_combos(spark, sf_dir, WEIGHTED))


def top_combos_overflow(spark, sf_dir):
    return _shown(_combos(spark, sf_dir, OVERFLOW, 2))


def top_combos_zero_weight(spark, sf_dir):
    return _shown(_combos(spark, sf_dir, ZERO, 2))


def rank_menus_by_accuracy(spark, sf_dir):
    return optimize.restaurants_by_accuracy(_combos(spark, sf_dir)).withColumn("avg_accuracy", F.round("avg_accuracy", 9))


def combo_item_quantities(spark, sf_dir):
    return optimize.item_quantities(_combos(spark, sf_dir), menu(spark, sf_dir), TARGET)


def swap_suggestions(spark, sf_dir):
    return optimize.swap_suggestions(menu(spark, sf_dir), TARGET, SWAP_TOTAL, SWAP_MEAL, max_items=3)


def candidate_order(spark, sf_dir):
    return optimize.candidates(menu(spark, sf_dir), TARGET)


def candidate_maxima(spark, sf_dir):
    return optimize.candidates(menu(spark, sf_dir), TARGET).groupBy("restaurant").agg(*(F.max(m).alias(f"most_{m}") for m in MACROS))


QUERIES = {f.__name__: f for f in (top_combos_per_menu, top_combos_five_items, top_combos_unpruned, top_combos_weighted, top_combos_overflow, top_combos_zero_weight, rank_menus_by_accuracy, combo_item_quantities, swap_suggestions, candidate_order, candidate_maxima)}
_WIDE = optimize.widened(TARGET, SWAP_TOTAL)
SQL = {
    "top_combos_per_menu": f"{_sql()} {SHOWN}",
    "top_combos_unpruned": f"{_sql()} {SHOWN}",
    "top_combos_five_items": f"{_sql(items=5)} {SHOWN}",
    "top_combos_weighted": f"{_sql(WEIGHTED)} {SHOWN}",
    "top_combos_overflow": f"{_sql(OVERFLOW, items=2)} {SHOWN}",
    "top_combos_zero_weight": f"{_sql(ZERO, items=2)} {SHOWN}",
    "rank_menus_by_accuracy": f"{_sql()} select restaurant, round(avg_accuracy, 9) as avg_accuracy, row_number() over (order by avg_accuracy, restaurant) as place from best where rank = 1",
    "combo_item_quantities": f"""{_sql()}, each as (select restaurant, rank, unnest(path) as i, generate_subscripts(path, 1) - 1 as pos from best)
        select e.restaurant, e.rank, c.name, count(*) as quantity, min(e.pos) as first_pos from each e join cand c using (restaurant, i) group by 1, 2, 3""",
    "swap_suggestions": f"""{_sql(target=_WIDE, items=3, top=10)}, each as (select restaurant, rank, unnest(path) as i, generate_subscripts(path, 1) as pos from best),
        firsts as (select e.restaurant, c.name, min(row(e.rank, e.pos)) as spot from each e join cand c using (restaurant, i) group by 1, 2),
        placed as (select *, row_number() over (partition by restaurant order by spot) as place from firsts)
        select restaurant, place, name from placed where place <= 10 and name not in ('part_1', 'part_2')""",
    "candidate_order": f"{_sql()} select * from cand",
    "candidate_maxima": f"{_sql()} select restaurant, {', '.join(f'max({m}) as most_{m}' for m in MACROS)} from cand group by 1",
}
