"""Scalar functions over columns: numbers in text, names, labels, roundings. All stay in the JVM.

Each takes and returns a Column.  A null or unreadable input gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"-?\d+(?:\.\d+)?"
DAY_MS = 86_400_000


def _first(c: Column, pattern: str, group: int = 0) -> Column:
    """The match of ``pattern``, null where there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def parse_number(c: Column) -> Column:
    """The first number of a text; commas group thousands: "1,408 kcal" is 1408."""
    return _first(F.regexp_replace(c, ",", ""), NUMBER).try_cast("double")


def parse_decimal_mark(c: Column) -> Column:
    """The first number of a text in which comma and point are both the decimal mark: "1,408" is 1.408."""
    return F.translate(_first(c, r"-?\d+(?:[.,]\d+)?"), ",", ".").try_cast("double")


def parse_whole_decimal_comma(c: Column) -> Column:
    """A whole text as a number, its first comma being the decimal mark."""
    return F.regexp_replace(F.trim(c), r"^([^,]*),", "$1.").try_cast("double")


def energy_kcal(c: Column) -> Column:
    """The number before "kcal"."""
    return _first(c, r"(?i)(\d+(?:\.\d+)?)\s*kcal", 1).try_cast("double")


def clean(c: Column) -> Column:
    """White space collapsed and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def title_case(c: Column) -> Column:
    """Lower case but for the first letter of each run of ASCII letters and digits: "Chick 'N' Dip", "Kid'S"."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), 1)
    return F.array_join(F.transform(runs, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1_000_000))), "")


def normalize_category(c: Column) -> Column:
    """Cleaned; null if empty; in title case if the text is all of one case."""
    x = clean(c)
    return F.when(x == "", None).when((x == F.lower(x)) | (x == F.upper(x)), title_case(x)).otherwise(x)


def clean_label(c: Column) -> Column:
    """Cleaned, without trade marks."""
    return clean(F.regexp_replace(c, "[®™]", ""))


def option_name(c: Column) -> Column:
    """Cleaned, without pictographs."""
    return clean(F.regexp_replace(c, r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}\x{2B00}-\x{2BFF}]", ""))


def base_slug(url: Column, sizes: tuple[str, ...] = ("small", "medium", "large", "regular", "mini")) -> Column:
    """The product's slug in an address ending in /product/<slug>.html, without size words; other addresses as they are."""
    slug = _first(url, r"(?i)/product/([a-z0-9-]+)\.html", 1)
    return F.coalesce(F.array_join(F.filter(F.split(slug, "-"), lambda t: ~F.lower(t).isin(*sizes)), "-"), url)


#: The words that name a size.
SIZE_WORDS = "large|regular|small|medium|xl"


def _size(raw: Column) -> Column:
    return F.when(F.lower(raw) == "xl", "XL").otherwise(F.concat(F.upper(F.substring(raw, 1, 1)), F.lower(F.substring(raw, 2, 100))))


def variant_of_name(c: Column) -> Column:
    """struct(base, label, option) of names like "x (3)", "x (large)" or "large x"; null for others."""
    tail = rf"(?i)^(.+?)\s*\((\d+|{SIZE_WORDS})\)$"
    lead = rf"(?i)^({SIZE_WORDS})\s+(.+)$"
    mark = F.regexp_extract(c, tail, 2)
    made = lambda base, label, option: F.struct(F.trim(base).alias("base"), F.lit(label).alias("label"), option.alias("option"))
    return (
        F.when(mark.rlike(r"^\d+$"), made(F.regexp_extract(c, tail, 1), "Count", F.concat(mark, F.lit(" pc"))))
        .when(mark != "", made(F.regexp_extract(c, tail, 1), "Size", _size(mark)))
        .when(c.rlike(lead), made(F.regexp_extract(c, lead, 2), "Size", _size(F.regexp_extract(c, lead, 1))))
    )


def leading_count(c: Column) -> Column:
    """struct(base, option) of names like "6 Crispy Wings"; null for others."""
    p = r"^(\d+)\s+(.+)$"
    return F.when(c.rlike(p), F.struct(F.trim(F.regexp_extract(c, p, 2)).alias("base"), F.concat(F.regexp_extract(c, p, 1), F.lit(" pc")).alias("option")))


def serving_basis(title: Column) -> Column:
    """How a title's parenthesis with slice or whole says the food is served; empty if there is none."""
    inside = F.regexp_extract(title, r"(?i)\(([^)]*(?:slice|whole)[^)]*)\)", 1)
    return clean(F.regexp_replace(F.regexp_replace(inside, "(?i)pizza", ""), r"\s*[–-]\s*", ", "))


def item_key(name: Column, crust: Column, size: Column, title: Column) -> Column:
    """name — crust (size or serving basis), what there is of it; null without a name."""
    n, c, s = clean(name), clean(crust), clean(size)
    basis = F.when(s != "", s).otherwise(serving_basis(F.coalesce(title, F.lit(""))))
    return F.when(n != "", F.concat(n, F.when(c != "", F.concat(F.lit(" — "), c)).otherwise(""), F.when(basis != "", F.concat(F.lit(" ("), basis, F.lit(")"))).otherwise("")))


def row_variant(name: Column, crust: Column, size: Column, title: Column) -> Column:
    """struct(base, option) of a row with a crust or a size; null for others."""
    n, c, s = clean(name), clean(crust), clean(size)
    basis = F.when(s != "", s).otherwise(serving_basis(F.coalesce(title, F.lit(""))))
    option = F.when((c != "") & (basis != ""), F.concat(c, F.lit(" ("), basis, F.lit(")"))).when(c != "", c).when(basis != "", basis)
    return F.when((n != "") & option.isNotNull(), F.struct(n.alias("base"), option.alias("option")))


def title_category(title: Column, brand: str) -> Column:
    """A section title without its number, the brand, a last parenthesis and the word Nutrition."""
    bare = F.regexp_replace(title, r"^\d+\.\s*", "")
    bare = F.regexp_replace(bare, rf"(?i)^{brand}'?s?\s*", "")
    bare = F.trim(F.regexp_replace(bare, r"\s*\([^)]*\)\s*$", ""))
    dash = F.regexp_extract(bare, r"(?i)^Pizza Nutrition\s*[–-]\s*(.+)$", 1)
    return F.when(dash != "", F.trim(dash)).otherwise(F.trim(F.regexp_replace(bare, r"(?i)\s*Nutrition\s*$", "")))


def with_section(name: Column, suffix: Column) -> Column:
    """name suffix, unless the name already has it."""
    return F.when(suffix.isNull() | F.contains(F.lower(name), F.lower(suffix)), name).otherwise(F.concat_ws(" ", name, suffix))


def is_junk(c: Column) -> Column:
    """A description that says nothing: "None", or digits and points only."""
    return F.coalesce((c == "None") | c.rlike(r"^[\d.]+$"), F.lit(False))


def in_family(name: Column, base: Column) -> Column:
    """name is base, or base with a parenthesis after it."""
    return (name == base) | (F.startswith(name, F.concat(base, F.lit(" ("))) & F.endswith(name, F.lit(")")) & (F.length(name) > F.length(base) + 3))


#: Small words that begin a new word when a line wraps.
CONNECTORS = "and|or|to|of|in|on|at|the|a|no|n|with|for"


def join_wrapped(before: Column, after: Column) -> Column:
    """A wrapped line put after the text before it, glued on if the wrap split a word.

    It did if the rest is a short lower-case tail that is no small word, or lower case after a
    stem that ends in a hyphen and one or two letters.
    """
    tail = (F.length(F.regexp_extract(after, r"^\S+", 0)) <= 3) & ~after.rlike(rf"(?i)^({CONNECTORS})\b")
    glue = after.rlike("^[a-z]") & (tail | before.rlike(r"-\w{1,2}$"))
    return F.when(F.coalesce(before, F.lit("")) == "", after).when(glue, F.concat(before, after)).otherwise(F.concat_ws(" ", before, after))


def per_calorie(macro: Column, calories: Column) -> Column:
    """macro / calories, 1 where that is 0 or undefined."""
    return F.coalesce(F.nullif(macro / F.nullif(calories, F.lit(0)), F.lit(0.0)), F.lit(1.0))


def round_half_up(c: Column, places: int = 0) -> Column:
    """Halves go up, also below zero."""
    f = 10.0**places
    return F.floor(c * f + 0.5) / f


def for_weight(per_100: Column, weight: Column) -> Column:
    return round_half_up(per_100 * weight / 100, 1)


def near(a: Column, b: Column, tolerance: float) -> Column:
    """a is within a share of b; false for b = 0."""
    return F.coalesce((b != 0) & (F.abs(a - b) / F.abs(F.nullif(b, F.lit(0))) <= tolerance), F.lit(False))


def mg_to_g(c: Column) -> Column:
    return c / 1000


def item_id(restaurant: Column, name: Column) -> Column:
    return F.concat_ws("::", restaurant, name)


def pretty_name(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def composed_labels(c: Column) -> Column:
    """Labels of a composed name "base — a, b"; an empty array for others."""
    return F.when(F.contains(c, F.lit(" — ")), F.split(F.regexp_extract(c, r"^.*? — (.*)$", 1), ", ")).otherwise(F.array().cast("array<string>"))


def numbers_in(c: Column) -> Column:
    """All numbers of a line without their thousands' commas, rounded."""
    found = F.regexp_extract_all(c, F.lit(r"\d[\d,]*(?:\.\d+)?"), 0)
    return F.transform(found, lambda s: F.floor(F.regexp_replace(s, ",", "").cast("double") + 0.5))


USED_OF_TOTAL = r"(\d[\d,]*)\s*(?:g|cal|kcal|mg)?\s*/\s*(\d[\d,]*)"
LEFT = r"(\d[\d,]*)\s*(?:g|cal|kcal|mg)?\s*(?:left|remaining)"


def _whole(c: Column) -> Column:
    return F.regexp_replace(c, ",", "").try_cast("bigint")


def remaining_in_line(c: Column) -> Column:
    """What a line says is left: of used / total, n left, two numbers' difference, or one number."""
    n = numbers_in(c)
    return (
        F.when(c.rlike(USED_OF_TOTAL), F.greatest(_whole(F.regexp_extract(c, USED_OF_TOTAL, 2)) - _whole(F.regexp_extract(c, USED_OF_TOTAL, 1)), F.lit(0)))
        .when(c.rlike(LEFT), _whole(F.regexp_extract(c, LEFT, 1)))
        .when(F.size(n) >= 2, F.abs(F.get(n, F.lit(1)) - F.get(n, F.lit(0))))
        .when(F.size(n) == 1, F.get(n, F.lit(0)))
    )


def column_order(header: Column, keys: dict[str, str]) -> Column:
    """Names of the columns whose keyword a header line has, from left to right; null below three."""
    hits = F.array(*(F.struct(F.locate(word, header).alias("at"), F.lit(k).alias("key")) for k, word in keys.items()))
    found = F.transform(F.array_sort(F.filter(hits, lambda h: h["at"] > 0)), lambda h: h["key"])
    return F.when(F.size(found) >= 3, found)


ROW_PARTS = ("used", "total", "left", "nums")


def row_parts(c: Column) -> dict[str, Column]:
    """What :func:`values_of_parts` reads of a line."""
    used, total = (F.regexp_extract_all(c, F.lit(USED_OF_TOTAL), g) for g in (1, 2))
    return dict(zip(ROW_PARTS, (used, total, F.regexp_extract_all(c, F.lit(LEFT), 1), numbers_in(c)), strict=True))


def values_of_parts(used: Column, total: Column, left: Column, nums: Column, n: int) -> Column:
    """``n`` remaining values of one line: of n pairs, n "left"s, n numbers, 2n numbers, or the first ones."""
    at = F.sequence(F.lit(0), F.lit(n - 1))
    return (
        F.when(F.size(used) >= n, F.transform(at, lambda i: F.greatest(_whole(F.get(total, i)) - _whole(F.get(used, i)), F.lit(0))))
        .when(F.size(left) >= n, F.transform(at, lambda i: _whole(F.get(left, i))))
        .when(F.size(nums) == 2 * n, F.transform(at, lambda i: F.abs(F.get(nums, 2 * i + 1) - F.get(nums, 2 * i))))
        .otherwise(F.transform(at, lambda i: F.get(nums, i)))
    )


def values_in_row(c: Column, n: int) -> Column:
    return values_of_parts(**row_parts(c), n=n)


def age_days(updated_ms: Column, now_ms: Column) -> Column:
    return F.greatest(F.floor((now_ms - updated_ms) / DAY_MS + 0.5), F.lit(0))


def age_label(days: Column) -> Column:
    up = lambda x: F.floor(x + 0.5).cast("string")
    return (
        F.when(days <= 0, "today")
        .when(days == 1, "1 day ago")
        .when(days < 14, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(days < 60, F.concat(up(days / 7), F.lit(" weeks ago")))
        .otherwise(F.concat(up(days / 30), F.lit(" months ago")))
    )


def is_stale(days: Column) -> Column:
    return days > 90


def accuracy_band(delta: Column) -> Column:
    return F.when(delta < 0.1, "good").when(delta < 0.2, "warn").otherwise("bad")


def accuracy_percent(delta: Column) -> Column:
    """"n% match"; negative where a meal is off by more than its targets."""
    return F.concat(F.floor((1 - delta) * 100 + 0.5).cast("string"), F.lit("% match"))


def macro_status(current: Column, target: Column) -> Column:
    off = (current - target) / F.nullif(target, F.lit(0))
    return F.when(target <= 0, "muted").when(F.abs(off) <= 0.05, "good").when(off < 0, "warn").otherwise("bad")


def remaining_text(current: Column, target: Column, places: int = 0) -> Column:
    """"n left" or "n over"; calories are shown without places, the other macros with one."""
    gap = (target - current).cast("double")
    shown = F.format_string(f"%.{places}f", round_half_up(F.abs(gap), places))
    return F.when(gap >= 0, F.concat(shown, F.lit(" left"))).otherwise(F.concat(shown, F.lit(" over")))


#: What a category is shown with; the first that matches counts.
ICONS = (
    ("burger", "🍔"),
    ("chicken|wing|tender|nugget", "🍗"),
    ("salad", "🥗"),
    ("dessert|cookie|cake|ice ?cream|sweet", "🍰"),
    ("drink|beverage|juice|soda|shake|cocktail|beer|cider|wine|coffee|tea", "🥤"),
    ("sub|wrap|burrito|taco", "🥪"),
    ("sauce|condiment|topping|extra", "🧂"),
    ("side|fries|dip", "🍟"),
)
OTHER_ICON = "🍽️"


def category_icon(c: Column) -> Column:
    out = F.when(F.coalesce(c, F.lit("")) == "", None)
    for pattern, icon in ICONS:
        out = out.when(F.lower(c).rlike(pattern), icon)
    return out.otherwise(OTHER_ICON)


def meal_of_day(hour: Column) -> Column:
    return F.when(hour < 11, "Breakfast").when(hour < 15, "Lunch").when(hour < 21, "Dinner").otherwise("Snacks")


def cache_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9_-]+", "_")


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes", "on"), F.lit(False))


def comma_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def clipboard_token(calories: Column, carbs: Column, fat: Column, protein: Column) -> Column:
    """"MM1:" with calories as a whole number and the others to one place, as short as they go."""
    one = lambda c: F.regexp_replace(F.format_string("%.1f", round_half_up(c.cast("double"), 1)), r"\.0$", "")
    return F.concat(F.lit("MM1:"), F.concat_ws(",", F.floor(calories + 0.5).cast("string"), one(carbs), one(fat), one(protein)))


def hash_targets(url: Column) -> Column:
    """struct of the four numbers of "#remaining=calories,protein,fat,carbs"; null where they are not there."""
    p = r"remaining=([\d.]+),([\d.]+),([\d.]+),([\d.]+)"
    parts = [F.regexp_extract(url, p, i + 1).try_cast("double").alias(m) for i, m in enumerate(("calories", "protein", "fat", "carbs"))]
    return F.when(url.rlike(p), F.struct(*parts))


def implausible(protein: Column, fat: Column, carbs: Column, calories: Column) -> Column:
    """A macro holds more energy than the calories, by more than 30 %."""
    most = calories * 1.3
    return (protein * 4 > most) | (carbs * 4 > most) | (fat * 9 > most)


def row_checks(kcal_100: Column, protein_100: Column, fat_100: Column, carbs_100: Column, total_kcal: Column, weight: Column) -> Column:
    """Calories by weight come to the total (2 %), and the macros to the calories (12 %)."""
    return near(kcal_100 * weight / 100, total_kcal, 0.02) & near(4 * protein_100 + 4 * carbs_100 + 9 * fat_100, kcal_100, 0.12)
