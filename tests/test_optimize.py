"""The meal search against a brute force over all multisets, and its properties."""

from __future__ import annotations

import itertools
import random

import pytest

from platefold.macros import MACROS, Preference, Preferences, Target
from platefold.operators import optimize

ITEMS = "restaurant string, item_seq long, name string, category string, calories double, protein double, fat double, carbs double"


def frame(spark, rows):
    return spark.createDataFrame([(r, i, f"n{i}", None, *map(float, m)) for i, (r, m) in enumerate(rows)], ITEMS)


def brute(rows, target, prefs, most, top):
    eff = optimize.effective(target, prefs)
    out = {}
    for rest in sorted({r for r, _ in rows}):
        items = [m for r, m in rows if r == rest and m[1] >= 1 and m[3] >= 1 and all(not prefs[k].binding or m[j] <= eff[k] * 1.3 for j, k in enumerate(MACROS))]
        if eff["protein"] >= eff["carbs"] and eff["protein"] >= eff["fat"]:
            items.sort(key=lambda m: -(m[1] / max(m[0], 1)))
        elif eff["carbs"] >= eff["protein"] and eff["carbs"] >= eff["fat"]:
            items.sort(key=lambda m: -(m[3] / max(m[0], 1)))
        found = []
        for n in range(1, most + 1):
            for path in itertools.combinations_with_replacement(range(len(items)), n):
                total = [sum(items[i][j] for i in path) for j in range(4)]
                if any(prefs[k].binding and total[j] > eff[k] for j, k in enumerate(MACROS)):
                    continue
                score = 0.0
                for j, k in enumerate(MACROS):
                    score += min(total[j] / max(eff[k], 1.0), 1.0) if prefs[k].weight > 0 else 0.0
                found.append((-score, n, tuple(i + 1 for i in path)))
        if found:
            out[rest] = sorted(found)[:top]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(f"r{rng.randrange(3)}", [rng.randint(50, 400), rng.randint(0, 30), rng.randint(0, 25), rng.randint(0, 50)]) for _ in range(20)]
    target = Target(rng.randint(300, 800), rng.randint(20, 60), rng.randint(15, 50), rng.randint(30, 90))
    prefs = Preferences(*(Preference(rng.choice([0.0, 0.8, 1.0, 1.2]), rng.choice(["strict", "allowed"])) for _ in range(4)))
    wanted = brute(rows, target, prefs, 3, 4)
    for prune in (False, True):
        got = optimize.combinations(frame(spark, rows), target, 3, 4, prefs, prune=prune).collect()
        found = {}
        for r in sorted(got, key=lambda r: (r["restaurant"], r["rank"])):
            found.setdefault(r["restaurant"], []).append((-r["score"], r["n"], tuple(r["path"])))
        assert found == wanted


def test_many_items_are_joined_by_parts_of_their_restaurant(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "a", "b"]), [rng.randint(50, 400), rng.randint(1, 30), rng.randint(0, 25), rng.randint(1, 50)]) for _ in range(70)]
    target = Target(600, 40, 30, 70)
    wanted = optimize.combinations(frame(spark, rows), target, 3, 4).select("restaurant", "rank", "path").collect()
    monkeypatch.setattr(optimize, "BROADCAST_ITEMS", 0)
    for prune in (False, True):
        got = optimize.combinations(frame(spark, rows), target, 3, 4, prune=prune).select("restaurant", "rank", "path").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, wanted))


def test_places_of_restaurants_without_a_window(spark):
    from platefold.staging import placed

    df = spark.range(997).selectExpr("id", "id % 10 v", "'x' _id").repartition(7)
    got = sorted((r["place"], r["v"], r["id"]) for r in placed(df, ["v", "id"]).collect())
    assert [(v, i) for _, v, i in got] == sorted((i % 10, i) for i in range(997))
    assert [p for p, _, _ in got] == list(range(1, 998))


def test_preferences_change_the_best(spark):
    rows = [("r", [300, 40, 40, 15]), ("r", [300, 40, 50, 15])]
    fat_low = Preferences(fat=Preference(0.8))
    best = optimize.combinations(frame(spark, rows), Target(600, 50, 55, 60), 1, 3, fat_low).collect()
    assert [r["fat"] for r in best] == [40]
    assert optimize.combinations(frame(spark, [("r", [300, 20, 90, 20])]), Target(600, 50, 50, 60)).count() == 0
    over = Preferences(fat=Preference(1.0, "allowed"))
    assert [r["fat"] for r in optimize.combinations(frame(spark, [("r", [300, 20, 90, 20])]), Target(600, 50, 50, 60), 1, 3, over).collect()] == [90]


def test_more_results_keep_the_first(spark):
    rows = [("r", [100 + 7 * i, 5 + i, 3 + i % 4, 10 + i % 7]) for i in range(12)]
    t = Target(600, 50, 40, 80)
    few, many = ([tuple(r["path"]) for r in optimize.combinations(frame(spark, rows), t, 3, n).orderBy("rank").collect()] for n in (2, 6))
    assert many[:2] == few


def test_frontier_is_bounded_and_says_so(spark):
    rows = [("r", [180 + i % 7, 20 + i % 5, 8 + i % 3, 15 + i % 4]) for i in range(60)]
    got = optimize.combinations(frame(spark, rows), Target(900, 90, 40, 90), 3, 3, max_frontier=20).collect()
    assert got and all(r["truncated"] for r in got if r["n"] > 1)


def test_bad_settings():
    with pytest.raises(ValueError):
        Preference(-1)
    with pytest.raises(ValueError):
        Target(float("nan"), 1, 1, 1)
    assert Preference.from_percent(120) == Preference(1.2, "allowed")


def test_no_meals_are_kept_between_levels_and_alike_items_count(spark, monkeypatch):
    """All feasible pairs were written before the third item was looked for."""
    rng = random.Random(5)
    kinds = [[rng.randint(50, 300), rng.randint(1, 20), rng.randint(0, 12), rng.randint(1, 30)] for _ in range(12)]
    rows = [("r", rng.choice(kinds)) for _ in range(36)]
    kept, settle = [], optimize.settle

    def counted(df):
        out = settle(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(optimize, "settle", counted)
    target = Target(800, 55, 33, 80)
    got = optimize.combinations(frame(spark, rows), target, 3, 4).orderBy("rank").collect()
    assert [(-r["score"], r["n"], tuple(r["path"])) for r in got] == brute(rows, target, Preferences(), 3, 4)["r"]
    assert max(kept) <= len(rows)


@pytest.mark.parametrize("prefs", [Preferences(), Preferences(protein=Preference(1.5, "allowed"), fat=Preference(0.8)), Preferences(fat=Preference(0.0), carbs=Preference(1.1, "allowed"))])
def test_totals_are_looked_for_before_meals(spark, monkeypatch, prefs):
    """Every pair of items was taken to the last step, though few totals are different; ROUND is small so that there are many rounds."""
    rng = random.Random(11)
    rows = [("ab"[j % 2], [60 + 20 * rng.randrange(9), 5 * rng.randint(1, 4), 4 * rng.randint(0, 4), 10 * rng.randint(1, 4)]) for j in range(50)]
    target = Target(635, 43, 33, 95)
    written, monkeyed = [], optimize._totals_of

    def counted(*args):
        out = monkeyed(*args)
        written.append((out.count(), out.distinct().count()))
        return out

    monkeypatch.setattr(optimize, "_totals_of", counted)
    monkeypatch.setattr(optimize, "ROUND", 40)
    got = optimize.combinations(frame(spark, rows), target, 4, 5, prefs).orderBy("restaurant", "rank").collect()
    found = {}
    for r in got:
        found.setdefault(r["restaurant"], []).append((-r["score"], r["n"], tuple(r["path"])))
    assert found == brute(rows, target, prefs, 4, 5)
    assert written and all(a == b for a, b in written)
