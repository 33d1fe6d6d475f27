"""Bounded multiset top-k for each restaurant: the meals that fill a target best.

Where macros are whole numbers, many meals have the same totals: the totals worth having are looked
for first, each distinct total of the first items once, then the meals that have them, in the order
of results.  Otherwise some items of each restaurant are searched first; the best meals found are a
bar.  In both, beginnings are equi-joined on the restaurant in the order of a macro that binds, with
the feasibility sums as residual condition; the bar then leaves a narrow box of macros for the last
item, which is looked up by cell.  Nothing is kept but a few best meals for each restaurant.
With ``max_frontier``, or macros below zero, meals are built and kept level by level.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..macros import MACROS, Preferences, Target
from ..staging import placed, settle

#: How far a single item may exceed a binding macro to be looked at, and what it must hold.
SLACK, LEAST_PROTEIN, LEAST_CARBS = 1.3, 1, 1
#: Items up to which all are broadcast (a few tens of bytes each).
BROADCAST_ITEMS = 1_000_000
#: How many items of a restaurant, in each of two orders, are searched before all are; the least only before longer meals.
FIRST_TURNS = (2048, 256, 32)
#: How many beginnings of meals are joined in the first round for given totals; each round takes eight times the last one's first items.
ROUND = 30_000_000


def effective(target: Target, prefs: Preferences) -> dict[str, float]:
    """Targets times weights: what the search fills; accuracy is against the targets themselves."""
    return {m: float(target[m]) * prefs[m].weight for m in MACROS}


def candidates(items: DataFrame, target: Target, prefs: Preferences = Preferences()) -> DataFrame:
    """(restaurant, i, name, macros) of items worth searching, numbered in search order from 1.

    An item needs some protein and carbs, whatever their weights, and must not exceed a binding
    macro by more than the slack.  Order: protein for each calorie if protein has the largest
    effective target, else carbs if those have, else as given; ties as given (item_seq).
    """
    eff = effective(target, prefs)
    keep = (F.col("protein") >= LEAST_PROTEIN) & (F.col("carbs") >= LEAST_CARBS)
    for m in MACROS:
        if prefs[m].binding:
            keep &= F.col(m) <= eff[m] * SLACK
    if eff["protein"] >= eff["carbs"] and eff["protein"] >= eff["fat"]:
        lead = "protein"
    elif eff["carbs"] >= eff["protein"] and eff["carbs"] >= eff["fat"]:
        lead = "carbs"
    else:
        lead = None
    order = [F.expr(f"{lead} / greatest(calories, 1)").desc()] if lead else []
    place = F.row_number().over(_window("restaurant", *order, F.col("item_seq")))
    return items.where(keep).withColumn("i", place).select("restaurant", "i", "name", *MACROS)


def _window(key: str, *order):
    return Window.partitionBy(key).orderBy(*order)


def score(eff: dict[str, float], prefs: Preferences, of=F.col) -> Column:
    """How full the effective targets are, each 1 at most; a macro of weight 0 counts for nothing."""
    parts = [F.least(of(m) / F.lit(max(eff[m], 1.0)), F.lit(1.0)) if prefs[m].weight > 0 else F.lit(0.0) for m in MACROS]
    return reduce(lambda a, b: a + b, parts)


def feasible(eff: dict[str, float], prefs: Preferences, of) -> Column:
    """No binding macro exceeded; sound for prefixes, as macros are not negative."""
    return reduce(lambda a, b: a & b, [of(m) <= F.lit(eff[m]) for m in MACROS if prefs[m].binding], F.lit(True))


def combinations(items: DataFrame, target: Target, max_items: int = 5, top: int = 3, prefs: Preferences = Preferences(), prune: bool = False, max_frontier: int | None = None) -> DataFrame:
    """(restaurant, rank, path, n, totals, score, accuracies, avg_accuracy, truncated): the ``top`` meals.

    Meals of 1 to ``max_items`` items, the same one repeatedly if that helps, ranked by score,
    then fewer items, then search order.  ``path`` lists the items' search numbers.
    Restaurants without a feasible meal are absent.  Results do not depend on ``prune``: with it, and
    a macro below zero, meals that cannot come to a restaurant's ``top``-th best score even with
    its largest items are dropped between levels.  ``max_frontier`` bounds the meals of a restaurant
    that are extended, best bound first: then ``truncated`` tells where it dropped any.
    """
    if not 1 <= max_items <= 5:
        raise ValueError("max_items must be 1 to 5")
    eff = effective(target, prefs)
    cand = settle(candidates(items, target, prefs))
    below, whole = cand.select(
        F.coalesce(F.bool_or(reduce(lambda a, b: a | b, [F.coalesce(F.col(m) < 0, F.lit(False)) for m in MACROS])), F.lit(False)),
        F.coalesce(F.bool_and(reduce(lambda a, b: a & b, [F.coalesce((F.col(m) == F.floor(m)) & (F.abs(m) < 1 << 40), F.lit(True)) for m in MACROS])), F.lit(True)),
    ).first()
    best = _by_levels(cand, eff, prefs, max_items, top, prune, max_frontier) if below or max_frontier else _by_boxes(cand, eff, prefs, max_items, top, whole)
    ranked = best.withColumn("rank", F.row_number().over(_window("restaurant", F.desc("score"), "n", "path")))
    accuracy = {m: F.abs(F.col(m) - F.lit(float(target[m]))) / F.lit(max(float(target[m]), 1.0)) for m in MACROS}
    mean = reduce(lambda a, b: a + b, accuracy.values()) / 4
    return ranked.select("restaurant", "rank", "path", "n", *MACROS, "score", *(a.alias(f"{m}_off") for m, a in accuracy.items()), mean.alias("avg_accuracy"), F.col("cut").alias("truncated"))


def _parts(cand: DataFrame) -> int:
    """A number of parts of its own: a few rows make many pairs, so parts must not be put together by size."""
    return 4 * max(cand.sparkSession.sparkContext.defaultParallelism, int(cand.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) // 4)


def _singles(cand: DataFrame, eff, prefs) -> DataFrame:
    level = cand.select("restaurant", F.array("i").alias("path"), F.col("i").alias("last"), *MACROS, F.lit(False).alias("cut")).where(feasible(eff, prefs, F.col))
    return level.withColumn("score", score(eff, prefs)).withColumn("n", F.lit(1))


def _by_boxes(cand: DataFrame, eff, prefs, max_items: int, top: int, whole: bool) -> DataFrame:
    """The ``top`` meals by a search that keeps no meals between levels; macros must not be below zero.

    Of items alike in all macros the first stands for all, as another in its place changes the order
    alone, and the best meals are written out with the ``top`` first of them at the end; sums of
    fractions depend on their order, so this is for ``whole`` macros only, as is the search by totals.
    Otherwise some items of each restaurant are searched before all are: their best meals are a bar
    for what is looked at then.
    """
    alike = Window.partitionBy("restaurant", *MACROS)
    copies = None
    if whole:
        copies = settle(cand.withColumn("first", F.min("i").over(alike)).withColumn("k", F.row_number().over(alike.orderBy("i"))).where(F.col("k") <= top))
        cand = copies.where(F.col("k") == 1)
    spread = [F.row_number().over(_window("restaurant", *order)) for order in ([F.col("i")], [F.xxhash64("i"), F.col("i")])]
    some = settle(cand.select("restaurant", "i", *MACROS, F.least(*spread).alias("turn")))
    most = some.groupBy("restaurant").agg(F.max("turn").alias("turns"), *(F.max(m).cast("double").alias(f"most_{m}") for m in MACROS))
    most = settle(most)
    turns = most.agg(F.max("turns")).first()[0] or 0
    best = settle(_best(_singles(some, eff, prefs), top))
    if whole:
        best = _by_totals(some, most, best, eff, prefs, max_items, top, turns)
    for turn in _turns(turns, max_items) if not whole else []:
        own = some.where(F.col("turn") <= turn)
        for n in range(2, max_items + 1):
            found = _meals_of(own, most, best, eff, prefs, n, top)
            best = settle(_best(best.unionByName(found).dropDuplicates(["restaurant", "path"]), top))
    if copies is None or copies.where("k > 1").isEmpty():
        return best
    each = best
    for k in range(max_items):
        other = copies.select(F.col("restaurant").alias("_r"), F.col("first"), F.col("i").alias(f"_i{k}"))
        at = F.get("path", F.lit(k))
        each = each.join(other, at.eqNullSafe(F.col("first")) & F.col("restaurant").eqNullSafe(F.col("_r")), "left").drop("_r", "first")
    path = F.array_sort(F.array_compact(F.array(*(f"_i{k}" for k in range(max_items)))))
    return settle(_best(each.withColumn("path", path).dropDuplicates(["restaurant", "path"]), top))


def _turns(turns: int, max_items: int) -> list[int]:
    """How many items of a restaurant are searched, one search after the other."""
    return [t for t in (sorted(FIRST_TURNS) if max_items > 3 else sorted(FIRST_TURNS)[1:]) if t < turns] + [turns]


def _capped(v: Column, prefs: Preferences, eff, m: str) -> Column:
    """What counts of a macro's total: one that may be exceeded counts no further than its target."""
    return v.cast("double") if prefs[m].binding else F.least(v.cast("double"), F.lit(max(eff[m], 1.0)))


def _by_totals(cand: DataFrame, most: DataFrame, best: DataFrame, eff, prefs, max_items: int, top: int, turns: int) -> DataFrame:
    """The ``top`` meals of items with whole macros, given the ``best`` single items.

    Of beginnings with the same totals one finds the totals of meals as well as all do.  The
    ``top`` best totals of a restaurant hold its ``top`` best meals; of meals with the same score
    and number of items those come first whose first item does, so they are looked for in rounds
    of first items, until no meal that is still missing can be among the best.
    """
    scored = [m for m in MACROS if prefs[m].weight > 0]
    kinds = settle(cand.groupBy("restaurant", *(_capped(F.col(m), prefs, eff, m).alias(f"t_{m}") for m in scored)).agg(F.min("turn").alias("turn")))
    heads = best.select("restaurant", "n", "score", *(_capped(F.col(m), prefs, eff, m).alias(f"t_{m}") for m in scored))
    for turn in _turns(turns, max_items):
        own = kinds.where(F.col("turn") <= turn).drop("turn")
        for n in range(2, max_items + 1):
            found = heads.unionByName(_totals_of(own, most, heads, eff, prefs, n, top)).distinct()
            # meals of the same score and number are told apart by their paths only
            heads = settle(found.withColumn("r", F.rank().over(_window("restaurant", F.desc("score"), "n"))).where(F.col("r") <= top).drop("r"))
    sizes = settle(cand.where("restaurant is not null").groupBy("restaurant").agg(F.count(F.lit(1)).cast("double").alias("size"), F.max("i").alias("end")))
    for n in range(2, max_items + 1):
        low = 0
        while True:
            wanted = heads.where(F.col("n") == n).join(sizes, "restaurant").where(F.col("end") > low)
            enough = best.select("restaurant", F.col("score").alias("_s"), F.col("n").alias("_n"))
            wanted = wanted.join(enough, "restaurant", "left").groupBy(*wanted.columns).agg(F.count_if((F.col("_s") > F.col("score")) | (F.col("_s") == F.col("score")) & (F.col("_n") <= F.col("n"))).alias("before"))
            wanted = settle(wanted.where(F.col("before") < top))
            work = wanted.agg(F.sum(F.pow("size", F.lit(n - 2)))).first()[0]
            if not work:
                break
            high = max(8 * low, int(ROUND // work), 1)
            found = _meals_with(cand, most, wanted.select("restaurant", *(F.col(f"t_{m}").alias(f"want_{m}") for m in scored)), eff, prefs, n, low, high)
            best = settle(_best(best.unionByName(found.select(*best.columns)), top))
            low = high
    return best


def _totals_of(kinds: DataFrame, most: DataFrame, heads: DataFrame, eff, prefs, n: int, top: int) -> DataFrame:
    """(restaurant, n, score, t_*): totals of ``n`` items that may be among the ``top`` of their restaurant, given those of ``heads``.

    Items are added in the order of a macro that binds: of the distinct totals so far only as much of it is
    known as that the next item holds no less than their mean.  The last item is looked up as in ``_meals_of``.
    """
    binding = [m for m in MACROS if prefs[m].binding]
    scored = [m for m in MACROS if prefs[m].weight > 0]
    lead = binding[0] if binding else None
    den = {m: max(eff[m], 1.0) for m in MACROS}
    full = {m: float(math.floor(eff[m])) if m in binding else den[m] for m in scored}
    best_score = sum(full[m] / den[m] for m in scored)
    small, near = _near(kinds)
    parts = _parts(kinds)
    bars = heads.withColumn("r", F.row_number().over(_window("restaurant", F.desc("score"), "n"))).where(F.col("r") == top).select("restaurant", F.col("score").alias("bar"))
    # how far a single macro may stay under the most it can be, the others being full
    missing = F.when(F.col("bar").isNull(), F.lit(float(len(scored)))).otherwise(F.greatest(F.lit(best_score) - F.col("bar"), F.lit(0.0)) + 1e-9)
    low = {m: F.lit(full[m]) - missing * den[m] - 1e-6 for m in scored}
    low = {m: F.greatest(F.ceil(v).cast("double") if m in binding else v, F.lit(0.0)) for m, v in low.items()}
    limits = most.join(bars, "restaurant", "left").select("restaurant", "bar", F.ceil(F.sqrt("turns") / 4).cast("int").alias("salts"), *(f"most_{m}" for m in scored), *(low[m].alias(f"low_{m}") for m in scored))
    limits = settle(limits.select("*", *((F.lit(full[m]) - F.col(f"low_{m}") + 1).alias(f"wide_{m}") for m in binding)))
    spread = max(1, -(-parts // max(1, limits.count())))
    side = kinds.select("restaurant", *(F.col(f"t_{m}").alias(f"a_{m}") for m in scored))
    with_ = {m: _capped(F.col(f"t_{m}") + F.col(f"a_{m}"), prefs, eff, m) for m in scored}

    def hopeful(k: int, of) -> Column:
        tests = [of[m] <= full[m] for m in binding] + [of[m] + (n - k) * F.coalesce(f"most_{m}", F.lit(den[m])) >= F.col(f"low_{m}") for m in scored]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def in_order(k: int) -> Column:
        if lead is None:
            return F.lit(True)
        return (F.col(f"t_{lead}") + (n - k + 1) * F.col(f"a_{lead}") <= full[lead]) & ((k - 1) * F.col(f"a_{lead}") >= F.col(f"t_{lead}"))

    totals = [f"t_{m}" for m in scored]
    made = kinds.select("restaurant", *totals) if lead is None else kinds.select("restaurant", *totals).where(n * F.col(f"t_{lead}") <= full[lead])
    for k in range(2, n):
        # parts hold few restaurants each, so that equal totals mostly meet before they are moved
        made = made.repartition(parts, "restaurant", F.pmod(F.xxhash64(*totals), F.lit(spread))).join(near(limits), "restaurant")
        if small:
            made = made.join(F.broadcast(side), "restaurant")
        else:  # items go to each part of their restaurant
            salted = side.join(limits.select("restaurant", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")), "restaurant")
            made = made.withColumn("salt", F.pmod(F.xxhash64(*totals), F.col("salts")).cast("int")).join(salted, ["restaurant", "salt"])
        made = made.where(in_order(k) & hopeful(k, with_)).select("restaurant", *(with_[m].alias(f"t_{m}") for m in scored)).distinct()
    made = made.repartition(parts, "restaurant", F.pmod(F.xxhash64(*totals), F.lit(spread))).join(near(limits), "restaurant")
    cell = lambda v, m: F.floor(v / F.col(f"wide_{m}"))
    for m in binding:
        left = F.lit(full[m]) - F.col(f"t_{m}")
        least = F.greatest(F.col(f"low_{m}") - F.col(f"t_{m}"), F.lit(0.0))
        if m == lead:
            least = F.greatest(least, F.col(f"t_{m}") / (n - 1))
        made = made.where(least <= left).withColumn(f"c_{m}", F.explode(F.sequence(cell(least, m), cell(left, m))))
    ends = side.join(near(limits.select("restaurant", *(f"wide_{m}" for m in binding))), "restaurant")
    ends = ends.select(F.col("restaurant").alias("_r"), F.xxhash64("restaurant", *(cell(F.col(f"a_{m}"), m) for m in binding)).alias("_cell"), *(f"a_{m}" for m in scored))
    # the cell's number is the only key of the lookup; what lies in another cell is still a right total
    made = made.withColumn("_cell", F.xxhash64("restaurant", *(f"c_{m}" for m in binding))).join(near(ends), "_cell").where((F.col("_r") <= F.col("restaurant")) & (F.col("_r") >= F.col("restaurant")) & hopeful(n, with_))
    made = made.select("restaurant", F.lit(n).alias("n"), "bar", *(with_[m].alias(f"t_{m}") for m in scored)).withColumn("score", score(eff, prefs, of=lambda m: F.col(f"t_{m}")))
    return made.where(F.col("bar").isNull() | (F.col("score") >= F.col("bar"))).select("restaurant", "n", "score", *totals).distinct()


def _meals_with(cand: DataFrame, most: DataFrame, wanted: DataFrame, eff, prefs, n: int, low: int, high: int) -> DataFrame:
    """Meals of ``n`` items with ``wanted`` totals whose first item lies in (``low``, ``high``]; the others come in the order of a macro that binds, the last one by lookup."""
    binding = [m for m in MACROS if prefs[m].binding]
    scored = [m for m in MACROS if prefs[m].weight > 0]
    lead = binding[0] if binding else None
    small, near = _near(cand)
    limits = settle(most.withColumn("salts", F.ceil(F.sqrt("turns") / 4).cast("int")).drop("turns"))
    side = lambda k: cand.select("restaurant", F.col("i").alias(f"i{k}"), *(F.col(m).alias(f"{m}{k}") for m in MACROS)).where(F.lit(True) if lead is None or k == 1 else F.col(f"{lead}{k}") * (n - k + 1) <= eff[lead])

    def hopeful(k: int) -> Column:
        """The rest can fill what is missing, and need not exceed what is left."""
        tests = [_total(m, k) <= F.col(f"want_{m}") for m in binding]
        tests += [F.coalesce(_total(m, k) + (n - k) * F.col(f"most_{m}") >= F.col(f"want_{m}"), F.lit(True)) for m in scored]
        if lead and k > 1:
            tests.append(_total(lead, k) + (n - k) * F.col(f"{lead}{k}") <= F.col(f"want_{lead}"))
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def after(k: int) -> Column:
        return (F.col(f"i{k}") >= F.col("i1")) & (_after(lead, k) if k > 2 else F.lit(True))

    made = side(1).where((F.col("i1") > low) & (F.col("i1") <= high)).join(near(limits), "restaurant").join(near(wanted), "restaurant").where(hopeful(1)).repartition(_parts(cand), "restaurant", "i1")
    for k in range(2, n):
        made = _joined(made, side(k), limits, k, small).where(after(k) & hopeful(k))
    missing = [F.col(f"want_{m}") - _total(m, n - 1) + F.lit(0.0) for m in binding]
    ends = side(n).select(F.col("restaurant").alias("_r"), F.xxhash64("restaurant", *(F.col(f"{m}{n}").cast("double") + F.lit(0.0) for m in binding)).alias("_cell"), f"i{n}", *(f"{m}{n}" for m in MACROS))
    made = made.withColumn("_cell", F.xxhash64("restaurant", *missing)).join(near(ends), "_cell").where((F.col("_r") <= F.col("restaurant")) & (F.col("_r") >= F.col("restaurant")))
    exact = [_capped(_total(m, n), prefs, eff, m) == F.col(f"want_{m}") for m in scored]
    made = made.where(reduce(lambda a, b: a & b, exact, after(n)))
    return _written(made, eff, prefs, n)


def _near(cand: DataFrame):
    """Whether the items are few enough to be broadcast, and a broadcast or nothing."""
    small = cand.count() <= BROADCAST_ITEMS
    return small, F.broadcast if small else lambda df: df


def _total(m: str, k: int) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"{m}{j}") for j in range(1, k + 1)])


def _after(lead: str | None, k: int) -> Column:
    """Item ``k`` comes after the one before it in the order of ``lead``."""
    here, before = F.col(f"i{k}"), F.col(f"i{k - 1}")
    if lead is None:
        return here >= before
    return (F.col(f"{lead}{k}") > F.col(f"{lead}{k - 1}")) | (F.col(f"{lead}{k}") == F.col(f"{lead}{k - 1}")) & (here >= before)


def _joined(made: DataFrame, side: DataFrame, limits: DataFrame, k: int, small: bool) -> DataFrame:
    """Beginnings of ``k`` - 1 items with each item of their restaurant."""
    if small:
        return made.join(F.broadcast(side), "restaurant")
    # items go to each part of their restaurant
    salted = side.join(limits.select("restaurant", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")), "restaurant")
    return made.withColumn("salt", F.pmod(f"i{k - 1}", "salts").cast("int")).join(salted, ["restaurant", "salt"]).drop("salt")


def _written(made: DataFrame, eff, prefs, n: int) -> DataFrame:
    """Meals of ``n`` items with path, sums in the order of the path, and score."""
    meal = F.array_sort(F.array(*(F.struct(F.col(f"i{k}").alias("i"), *(F.col(f"{m}{k}").alias(m) for m in MACROS)) for k in range(1, n + 1))))
    made = made.select("restaurant", meal.alias("meal"))
    added = lambda m: reduce(lambda a, b: a + b, [F.col("meal")[k][m] for k in range(n)])
    level = made.select("restaurant", F.transform("meal", lambda x: x["i"]).alias("path"), F.col("meal")[n - 1]["i"].alias("last"), *(added(m).alias(m) for m in MACROS), F.lit(False).alias("cut"))
    return level.where(feasible(eff, prefs, F.col)).withColumn("score", score(eff, prefs)).withColumn("n", F.lit(n))


def _meals_of(cand: DataFrame, most: DataFrame, best: DataFrame, eff, prefs, n: int, top: int) -> DataFrame:
    """Meals of ``n`` items that may be among the ``top`` of their restaurant, given the ``best`` so far.

    A meal's items are taken in the order of a macro that binds, so that each leaves room for the ones
    after it.  The last item is not tried out: a score at or above the bar leaves a narrow box of
    macros for it, and items are looked up by the cells of a grid as wide as the box.
    """
    binding = [m for m in MACROS if prefs[m].binding]
    lead = binding[0] if binding else None
    gridded = binding[1:] if len(binding) > 3 else binding  # a beginning meets up to two cells for each macro of the grid
    scored = [m for m in MACROS if prefs[m].weight > 0]
    den, slack = {m: max(eff[m], 1.0) for m in MACROS}, 1e-9
    small, near = _near(cand)
    worst = F.when(F.count(F.lit(1)) == top, F.max(F.struct((-F.col("score")).alias("s"), "n", "path")))
    bars = best.groupBy("restaurant").agg(worst.alias("bar"))
    missing = F.least(F.coalesce(F.lit(float(len(scored))) + F.col("bar.s"), F.lit(1.0)) + slack, F.lit(1.0))
    low = {m: F.greatest((1.0 - missing) * den[m] - slack * den[m], F.lit(0.0)) for m in scored}
    wide = {m: F.greatest(F.lit(eff[m]) - low[m], F.lit(0.0)) * (1 + 1e-6) + 1e-6 for m in gridded}
    lack = F.coalesce(F.lit(float(len(scored))) + F.col("bar.s"), F.lit(float(len(scored)))) + slack
    bars = settle(most.join(bars, "restaurant", "left").select("restaurant", "bar", lack.alias("lack"), F.ceil(F.sqrt("turns") / 4).cast("int").alias("salts"), *(f"most_{m}" for m in scored), *(low[m].alias(f"low_{m}") for m in scored), *(wide[m].alias(f"wide_{m}") for m in gridded)))
    limits = bars.drop("bar")
    side = lambda k: cand.select("restaurant", F.col("i").alias(f"i{k}"), *(F.col(m).alias(f"{m}{k}") for m in MACROS)).where(F.lit(True) if lead is None else F.col(f"{lead}{k}") * (n - k + 1) <= eff[lead] + slack)

    def hopeful(k: int) -> Column:
        """No macro exceeded, and none that the largest items cannot fill as far as the bar asks."""
        tests = [_total(m, k) <= eff[m] + slack * den[m] for m in binding]
        tests += [F.coalesce(_total(m, k) + (n - k) * F.col(f"most_{m}") >= F.col(f"low_{m}"), F.lit(True)) for m in scored]
        if lead:
            tests.append(_total(lead, k) + (n - k) * F.col(f"{lead}{k}") <= eff[lead] + slack * den[lead])
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    made = side(1).join(near(limits), "restaurant").where(hopeful(1)).repartition(_parts(cand), "restaurant", "i1")
    for k in range(2, n):
        made = _joined(made, side(k), limits, k, small).where(_after(lead, k) & hopeful(k))
    cell = lambda v, m: F.floor(v / F.col(f"wide_{m}"))
    for m in gridded:
        left = F.lit(eff[m] + slack * den[m]) - _total(m, n - 1)
        least = F.greatest(F.col(f"low_{m}") - _total(m, n - 1) - slack * den[m], F.lit(0.0))
        made = made.withColumn(f"c_{m}", F.explode(F.sequence(cell(least, m), F.greatest(cell(left, m), cell(least, m)))))
    ends = side(n).join(near(limits.select("restaurant", *(f"wide_{m}" for m in gridded))), "restaurant")
    ends = ends.select(F.col("restaurant").alias("_r"), F.xxhash64("restaurant", *(cell(F.col(f"{m}{n}"), m) for m in gridded)).alias("_cell"), f"i{n}", *(f"{m}{n}" for m in MACROS))
    # the cell's number is the only key of the lookup; that it is right is checked beside it
    made = made.withColumn("_cell", F.xxhash64("restaurant", *(f"c_{m}" for m in gridded))).join(near(ends), "_cell").where((F.col("_r") <= F.col("restaurant")) & (F.col("_r") >= F.col("restaurant")))
    for m in gridded:
        at = cell(F.col(f"{m}{n}"), m)
        made = made.where((at <= F.col(f"c_{m}")) & (at >= F.col(f"c_{m}")))
    made = made.where(F.coalesce(score(eff, prefs, of=lambda m: _total(m, n)) >= F.lit(float(len(scored))) - F.col("lack"), F.lit(True)))
    made = made.where(_after(lead, n) & hopeful(n))
    level = _written(made, eff, prefs, n)
    mine = F.struct((-F.col("score")).alias("s"), "n", "path")
    return level.join(near(bars.select("restaurant", "bar")), "restaurant").where(F.col("bar").isNull() | (mine <= F.col("bar"))).select(*best.columns)


def _by_levels(cand: DataFrame, eff, prefs, max_items: int, top: int, prune: bool, max_frontier: int | None) -> DataFrame:
    """The ``top`` meals, level by level, each level kept."""
    side = cand.select(F.col("restaurant"), F.col("i").alias("j"), *(F.col(m).alias(f"add_{m}") for m in MACROS))
    # meals are spread by their last item; items go to all of them, by broadcast or by a copy for each part of their restaurant
    small = cand.count() <= BROADCAST_ITEMS
    if small:
        side = F.broadcast(side)
    else:
        sizes = settle(cand.groupBy("restaurant").agg(F.ceil(F.sqrt(F.count(F.lit(1))) / 4).cast("int").alias("salts")))
        side = side.join(sizes, "restaurant").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    single = _singles(cand, eff, prefs)
    level = single.drop("score", "n")
    parts = _parts(cand)
    best = settle(_best(single, top))
    most = _reach(cand, eff, prefs) if prune or max_frontier else None
    total = lambda m: F.col(m) + F.col(f"add_{m}")
    for k in range(1, max_items):
        last = k == max_items - 1
        floor = best.groupBy("restaurant").agg(F.when(F.count(F.lit(1)) == top, F.min("score")).alias("floor"))
        if max_frontier or prune and k > 1:  # single items set no score that another item would not reach
            level = _bounded(level, floor, most, eff, prefs, max_items - k, prune, max_frontier)
        known = level.join(F.broadcast(floor) if small else floor, "restaurant", "left")
        if small:
            made = known.repartition(parts, "restaurant", "last").join(side, "restaurant")
        else:  # the join itself moves the meals, once
            made = known.join(sizes, "restaurant").withColumn("salt", F.pmod("last", "salts").cast("int")).join(side, ["restaurant", "salt"])
        made = made.where((F.col("j") >= F.col("last")) & feasible(eff, prefs, total))
        if last:
            made = made.where(F.col("floor").isNull() | (score(eff, prefs, of=total) >= F.col("floor")))
        level = made.select("restaurant", F.concat("path", F.array("j")).alias("path"), F.col("j").alias("last"), *(total(m).alias(m) for m in MACROS), "cut")
        if not last:
            level = settle(level)
        scored = level.withColumn("score", score(eff, prefs)).withColumn("n", F.lit(k + 1))
        # only what reaches the best so far need be ranked
        reach = scored.join(F.broadcast(floor) if small else floor, "restaurant", "left").where(F.col("floor").isNull() | (F.col("score") >= F.col("floor"))).select(*best.columns)
        best = settle(_best(best.unionByName(reach), top))
    return best


def _best(scored: DataFrame, top: int) -> DataFrame:
    """The ``top`` meals of each restaurant by score, then fewer items, then path."""
    ranked = scored.withColumn("r", F.row_number().over(_window("restaurant", F.desc("score"), "n", "path"))).where(F.col("r") <= top)
    return ranked.select("restaurant", "path", "last", *MACROS, "cut", "score", "n")


def _reach(cand: DataFrame, eff, prefs) -> DataFrame:
    """(restaurant, last, most_*, rate_*): the most that an item from ``last`` on holds of each macro, and of each for a calorie."""
    after = Window.partitionBy("restaurant").orderBy(F.desc("i"))
    most = [F.max(m).over(after).cast("double").alias(f"most_{m}") for m in MACROS]
    # an item without calories but with some of a macro has no rate: the calories then tell nothing
    rates = [F.max(F.when(F.col(m) <= 0, 0.0).when(F.col("calories") > 0, F.col(m) / F.col("calories")).otherwise(float("inf"))).over(after).alias(f"rate_{m}") for m in MACROS]
    return settle(cand.select("restaurant", F.col("i").alias("last"), *most, *rates))


def _bounded(level: DataFrame, floor: DataFrame, most: DataFrame, eff, prefs, slots: int, prune: bool, max_frontier: int | None) -> DataFrame:
    """The meals of ``level`` that are worth extending.

    What ``slots`` more items can add to a macro is bounded by the most that one holds and, where
    calories bind, by the calories left times the most of it for a calorie; only items from the
    meal's last one on count.
    """
    left = F.lit(eff["calories"]) - F.col("calories")
    parts = []
    for m in MACROS:
        if prefs[m].weight <= 0:
            continue
        more = slots * F.col(f"most_{m}")
        if prefs["calories"].binding:
            more = F.least(more, F.when(left <= 0, F.when(F.col(f"rate_{m}") == float("inf"), more).otherwise(0.0)).otherwise(left * F.col(f"rate_{m}")))
        parts.append(F.least((F.col(m) + more) / F.lit(max(eff[m], 1.0)), F.lit(1.0)))
    open_ = level.join(most, ["restaurant", "last"]).withColumn("upper", reduce(lambda a, b: a + b, parts, F.lit(0.0)) + F.lit(1e-9))
    if prune:
        open_ = open_.join(floor, "restaurant", "left").where(F.col("floor").isNull() | (F.col("upper") >= F.col("floor")))
    if max_frontier:
        open_ = open_.withColumn("r", F.row_number().over(_window("restaurant", F.desc("upper"), "path")))
        open_ = open_.withColumn("cut", F.expr(f"cut or max(r) over (partition by restaurant) > {max_frontier}")).where(F.col("r") <= max_frontier)
    return open_.select(*level.columns)


def named(combos: DataFrame, items: DataFrame, target: Target, prefs: Preferences = Preferences()) -> DataFrame:
    """One row per item of each meal: (restaurant, rank, pos, i, name, macros)."""
    each = combos.select("restaurant", "rank", F.posexplode("path").alias("pos", "i"))
    return each.join(candidates(items, target, prefs), ["restaurant", "i"])


def item_quantities(combos: DataFrame, items: DataFrame, target: Target, prefs: Preferences = Preferences()) -> DataFrame:
    """(restaurant, rank, name, quantity, first_pos): repeated items of a meal put together."""
    return named(combos, items, target, prefs).groupBy("restaurant", "rank", "name").agg(F.count(F.lit(1)).alias("quantity"), F.min("pos").alias("first_pos"))


def restaurants_by_accuracy(combos: DataFrame) -> DataFrame:
    """(restaurant, avg_accuracy, place): restaurants by how near their best meal comes."""
    first = combos.where(F.col("rank") == 1).select("restaurant", "avg_accuracy")
    return placed(first, ["avg_accuracy", "restaurant"])


def widened(target: Target, total: dict[str, float]) -> Target:
    """The target of a search for additions: half as much again as is missing, a fifth of the target at least."""
    return Target(**{m: max(max(0.0, target[m] - total[m]) * 1.5, target[m] * 0.2) for m in MACROS})


def swap_suggestions(items: DataFrame, target: Target, total: dict[str, float], on_meal: list[str], max_items: int = 3, top: int = 10, limit: int = 10) -> DataFrame:
    """(restaurant, place, name): items of the best additions to a meal, distinct in order of appearance.

    The limit is applied before names already on the meal are left out.
    """
    wide = widened(target, total)
    each = named(combinations(items, wide, max_items, top), items, wide)
    first = each.groupBy("restaurant", "name").agg(F.min(F.struct("rank", "pos")).alias("at"))
    placed = first.withColumn("place", F.row_number().over(_window("restaurant", "at"))).where(F.col("place") <= limit)
    return placed.where(~F.col("name").isin(on_meal)).select("restaurant", "place", "name")
