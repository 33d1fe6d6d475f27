"""Product pages of positioned text: what lies on a page decides how it is read.

A page prints one product or two side by side, and a product's sixteen figures on one line
(combined) or on a line of ten and a line of six (stacked).  Headers, titles and the
banner tell which.  A page is small and there are many: its cells come together in one row, and all
that is read of it, facts, products as ranges of x and rows of either kind, is read of that row's arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..staging import once
from .compose import repair_rows
from .layout import first_of_groups
from .normalize import add_variants

PAGE = ["doc_id", "page"]
NUMBER = r"^-?\d+(\.\d+)?$"
#: What headers say, pages that are no menu, products that are no longer sold, and a row's figures in order.
PER_100, PER_PORTION, RUN = "VALUES PER 100G", r"^VALUES PER (PORTION|SLICE)$", ["ENERGY", "ENERGY", "PROTEIN", "FAT"]
SKIPPED, DELISTED = r"(?i)CYO INGREDIENTS|DRINKS", r"(?i)RECENTLY DELISTED"
FIGURES = "kcal_100 kj_100 protein_100 fat_100 sat_100 carbs_100 sugars_100 fibre_100 sodium_100 salt_100 total_kcal portion_kcal weight portion_size portion_units total_units".split()
#: Glyph heights of banners and titles; widest gap within a title; headers on one level; the most a label lies below its row; gap after an outlying number.
BANNER, TITLE, TITLE_GAP, SAME_LEVEL, BELOW, OUTLYING = 35, 18, 80.0, 20, 5, 80.0


#: What is told of a cell once, before the cells of a page come together; cells are in the order of x, then of their text.
CELL = "x, str, x_end, y, height, num, v, head, portion".split(", ")


def _joined(cells: Column, *order) -> Column:
    """The texts of cells, by ``order`` and the text, blanks drawn together."""
    listed = cells if not order else F.array_sort(F.transform(cells, lambda c: F.struct(*(o(c) for o in order), c["str"].alias("str"))))
    return F.trim(F.regexp_replace(F.array_join(F.transform(listed, lambda c: c["str"]), " "), r"\s+", " "))


def _values(cells: Column) -> Column:
    """The numbers of cells from left to right."""
    return F.transform(F.array_sort(F.transform(cells, lambda c: F.struct(c["x"].alias("x"), c["v"].alias("v")))), lambda c: c["v"])


def _from_outliers(cells: Column) -> Column:
    """Cells in the order of x without leading ones that lie more than OUTLYING before the next one."""
    stays = F.transform(cells, lambda c, i: F.coalesce(F.get(cells, i + 1)["x"] - c["x_end"] <= OUTLYING, F.lit(True)))
    return F.slice(cells, F.greatest(F.array_position(stays, F.lit(True)).cast("int"), F.lit(1)), F.greatest(F.size(cells), F.lit(1)))


def _line_heads(ys: Column, tolerance: float) -> Column:
    """The y of each line from the top; a line takes all that lies within ``tolerance`` of its first y."""
    return first_of_groups(F.sort_array(F.array_distinct(ys), asc=False), lambda first, y: first - y <= tolerance)


def _taken(heads: Column, i: Column, head: Column, y: Column) -> Column:
    """y belongs to the line of the ``i``-th head."""
    return (y <= head) & F.coalesce(y > F.get(heads, i + 1), F.lit(True))


def paged_lines(cells: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """(doc_id, page, lines): one row for each page of cells (doc_id, page, x, x_end, y, height, str).

    ``lines`` come from the top: y, cells from left to right, n_numbers, heads, portion, banner, high
    and runs.  The cells meet once; all that is read of a page later is read of this row.
    """
    said = F.col("str")
    num = F.coalesce(F.trim(said).rlike(NUMBER), F.lit(False))
    told = {"num": num, "v": F.when(num, F.trim(said).cast("double")), "head": said == PER_100, "portion": said.rlike(PER_PORTION)}
    told |= {n: F.col(n).cast("double") for n in ("x", "x_end", "y", "height")} | {"str": said}
    own = cells.where(F.col("doc_id").isNotNull() & F.col("page").isNotNull() & F.col("y").isNotNull()).select(*PAGE, F.struct(*(told[n].alias(n) for n in CELL)).alias("c"))
    pages = own.groupBy(*PAGE).agg(F.array_sort(F.collect_list("c")).alias("cells"))
    pages = once(pages, line_ys=_line_heads(F.transform("cells", lambda c: c["y"]), tolerance))
    heads = F.col("line_ys")
    pages = once(pages, lines=F.transform(heads, lambda h, i: F.struct(h.alias("y"), F.filter("cells", lambda c: _taken(heads, i, h, c["y"])).alias("cells"))))

    def facts(line: Column) -> Column:
        has, count = lambda f: F.exists(line["cells"], f), lambda f: F.size(F.filter(line["cells"], f))
        after = lambda i, k: F.coalesce(F.get(line["cells"], i + k)["str"] == RUN[k], F.lit(False))
        starts = F.filter(line["cells"], lambda c, i: (c["str"] == RUN[0]) & after(i, 1) & after(i, 2) & after(i, 3))
        high = has(lambda c: (c["height"] >= TITLE) & (c["height"] < BANNER))
        return F.struct(
            line["y"].alias("y"), line["cells"].alias("cells"), count(lambda c: c["num"]).alias("n_numbers"), count(lambda c: c["head"]).alias("heads"),
            has(lambda c: c["portion"]).alias("portion"), has(lambda c: c["height"] >= BANNER).alias("banner"), F.coalesce(high, F.lit(False)).alias("high"), F.size(starts).alias("runs"),
        )

    return once(pages.select(*PAGE, "lines"), lines=F.transform("lines", facts))


def page_facts(pages: DataFrame, skip: str = SKIPPED) -> DataFrame:
    """``pages`` that have a table, with two, combined, header_y, banner_y and category.

    Tables are counted by their header; where no page header says so, by runs of the first column
    names.  A page is combined if a header for 100 g and one for a portion lie less than 20 apart.
    The category is the lowest line of banner height; pages that ``skip`` matches are left out.
    """
    ys = lambda holds: F.transform(F.filter("lines", holds), lambda l: l["y"])
    total = lambda name: F.aggregate("lines", F.lit(0), lambda acc, l: acc + l[name])
    banners = F.filter("lines", lambda l: l["banner"])
    marked = once(pages, heads=total("heads"), runs=total("runs"), head_ys=ys(lambda l: l["heads"] > 0), run_ys=ys(lambda l: l["runs"] > 0), portion_ys=ys(lambda l: l["portion"]), banner=F.get(banners, F.size(banners) - 1))
    named = F.col("heads") > 0
    marked = once(marked.where("heads > 0 or runs > 0"), tables=F.when(named, F.col("heads")).otherwise(F.col("runs")), ys=F.when(named, F.col("head_ys")).otherwise(F.col("run_ys")), category=F.coalesce(_joined(F.col("banner.cells")), F.lit("")))
    apart = F.array_min(F.flatten(F.transform("ys", lambda a: F.transform("portion_ys", lambda b: F.abs(a - b)))))
    facts = [(F.col("tables") >= 2).alias("two"), F.coalesce(apart < SAME_LEVEL, F.lit(False)).alias("combined"), F.array_min("ys").alias("header_y"), F.coalesce("banner.y", F.lit(0.0)).alias("banner_y")]
    return marked.where(~F.col("category").rlike(skip)).select(*PAGE, "lines", "category", *facts)


def products_of(pages: DataFrame) -> DataFrame:
    """``pages`` with ``products`` (product, title, lo, hi): the whole page, or its sides of the widest gap between titles (x = 400 without one)."""
    titled = F.filter("lines", lambda l: l["high"] & (l["y"] > 60))
    cells = F.flatten(F.transform(titled, lambda l, i: F.transform(l["cells"], lambda c: F.struct(c["x"].alias("x"), c["x_end"].alias("x_end"), i.alias("line"), c["str"].alias("str")))))
    pages = once(pages, high=F.array_sort(cells))
    high, far = F.col("high"), float("inf")
    gaps = F.filter(F.transform(high, lambda c, i: F.struct((c["x"] - F.get(high, i - 1)["x_end"]).alias("gap"), (-c["x"]).alias("at"))), lambda g: g["gap"] > TITLE_GAP)
    pages = once(pages, at=F.when(F.col("two"), -F.array_max(gaps)["at"]))
    right = lambda c: F.coalesce(c["x"] >= F.col("at"), F.lit(False))
    pages = once(pages, left=F.filter("high", lambda c: ~right(c)), right=F.filter("high", right))
    between = (F.array_max(F.transform("left", lambda c: c["x_end"])) + F.array_min(F.transform("right", lambda c: c["x"]))) / 2
    pages = once(pages, split=F.coalesce(between, F.lit(400.0)))
    entry = lambda k, title, lo, hi: F.struct(F.lit(k).alias("product"), title.alias("title"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    x, line = (lambda c: c["x"].alias("x")), (lambda c: c["line"].alias("line"))
    sides = F.array(entry(0, _joined(F.col("left"), x, line), F.lit(-far), F.col("split")), entry(1, _joined(F.col("right"), x, line), F.col("split"), F.lit(far)))
    whole = F.array(entry(0, _joined(high, line, x), F.lit(-far), F.lit(far)))
    return once(pages, products=F.when(F.col("two"), sides).otherwise(whole)).drop("high", "at", "left", "right", "split")


def _within(cells: Column, product: Column) -> Column:
    """The cells in whose product's range of x they begin."""
    return F.filter(cells, lambda c: (c["x"] >= product["lo"]) & (c["x"] < product["hi"]))


def _label(row: Column, count: Column, product: Column) -> Column:
    """A row's label, of the words left of its figures.

    Words on the row count if they are as high as its figures, to one point; where there are none,
    the words of the nearest line at most 5 below; else, and if the row is its product's only one, it is "Standard".
    """
    words = lambda cells: F.filter(cells, lambda c: ~c["num"] & (c["x"] >= product["lo"]) & (c["x"] < row["first_x"]))
    on = lambda cells: F.filter(words(cells), lambda c: F.abs(c["height"] - row["first_height"]) <= 1)
    beside = _joined(F.concat(on(row["cells"]), on(F.coalesce(row["more"], F.slice(row["cells"], 1, 0)))))
    under = F.filter("lines", lambda l: (row["y"] - l["y"] > 0) & (row["y"] - l["y"] <= BELOW) & (F.size(words(l["cells"])) > 0))
    given = lambda c: F.nullif(c, F.lit(""))
    return F.when(count > 1, F.coalesce(given(beside), given(_joined(words(F.get(under, F.lit(0))["cells"]))))).otherwise(F.lit(None).cast("string"))


def with_combined(pages: DataFrame) -> DataFrame:
    """``pages`` with ``found``: for each product the rows (label, layout, y, nums) of lines that carry all sixteen figures."""
    above = lambda i: F.get("lines", i - 1)
    # the second half of a row of 14 to 16 numbers lies at most 6 below the first; of three lines in a row the first two are taken
    half = F.transform("lines", lambda l, i: F.coalesce((above(i)["n_numbers"] >= 6) & (above(i)["n_numbers"] < 14) & (above(i)["y"] - l["y"] <= 6) & (l["n_numbers"] >= 2) & (l["n_numbers"] < 14) & (above(i)["n_numbers"] + l["n_numbers"]).between(14, 16), F.lit(False)))
    pages = once(pages, half=F.when(F.col("combined"), half))
    pages = once(pages, half=F.transform("half", lambda ok, i: ok & ~F.coalesce(F.get("half", i - 1), F.lit(False))))
    whole = F.transform("lines", lambda l, i: F.struct(l["y"].alias("y"), l["cells"].alias("cells"), F.when(F.get("half", i + 1), F.get("lines", i + 1)["cells"]).alias("more"), F.get("half", i).alias("half")))
    pages = once(pages, whole=F.when(F.col("combined"), F.filter(whole, lambda r: ~r["half"])))
    numeric = lambda cells, p: F.filter(_within(cells, p), lambda c: c["num"])
    merged = lambda r, p: F.when(r["more"].isNull(), numeric(r["cells"], p)).otherwise(F.array_sort(F.concat(numeric(r["cells"], p), numeric(r["more"], p))))
    full = lambda p: F.filter(F.transform("whole", lambda r: F.struct(r["y"].alias("y"), r["cells"].alias("cells"), r["more"].alias("more"), merged(r, p).alias("n"))), lambda r: F.size(r["n"]) >= 14)
    pages = once(pages, rows=F.when(F.col("combined"), F.transform("products", lambda p: F.transform(full(p), lambda r: F.struct(r["y"].alias("y"), r["cells"].alias("cells"), r["more"].alias("more"), F.slice(_from_outliers(r["n"]), 1, 16).alias("n"))))))
    told = lambda r: F.struct(r["y"].alias("y"), r["cells"].alias("cells"), r["more"].alias("more"), F.get(r["n"], F.lit(0))["x"].alias("first_x"), F.get(r["n"], F.lit(0))["height"].alias("first_height"), _values(r["n"]).alias("nums"))
    pages = once(pages, rows=F.transform("rows", lambda rows: F.transform(rows, told)))
    out = lambda r, n, p: F.struct(F.coalesce(_label(r, n, p), F.lit("Standard")).alias("label"), F.lit("combined").alias("layout"), r["y"].alias("y"), r["nums"].alias("nums"))
    found = F.transform("rows", lambda rows, i: F.transform(F.filter(rows, lambda r: F.size(r["nums"]) == 16), lambda r: out(r, F.size(rows), F.get("products", i))))
    return once(pages, found=found).drop("half", "whole", "rows")


def with_stacked(pages: DataFrame) -> DataFrame:
    """``pages`` with ``found`` of each product, where no product of its title has rows: one of a line of ten figures and one of six, or one of sixteen, between header and banner.

    Of several lines of six, one that makes the row's checks hold is taken, then the largest total.
    """
    titles = F.transform(F.filter(F.arrays_zip("products", "found"), lambda z: F.size(z["found"]) > 0), lambda z: z["products"]["title"])
    pages = once(pages, read=F.when(F.col("combined"), titles).otherwise(F.array().cast("array<string>")))
    open_ = F.exists("products", lambda p: ~F.array_contains("read", p["title"]))
    pages = once(pages, near=F.when(open_, F.filter("lines", lambda l: (l["n_numbers"] > 0) & (l["y"] < F.col("header_y")) & (l["y"] > F.col("banner_y") + 20))))
    pages = once(pages, near_ys=_line_heads(F.transform("near", lambda l: l["y"]), 4.0))
    heads = F.col("near_ys")
    group = lambda h, i: F.filter(F.flatten(F.transform(F.filter("near", lambda l: _taken(heads, i, h, l["y"])), lambda l: F.transform(l["cells"], lambda c: F.struct(c["x"].alias("x"), c["x_end"].alias("x_end"), l["y"].alias("y"), c["num"].alias("num"), c["v"].alias("v"))))), lambda c: c["num"])
    pages = once(pages, near=F.transform(heads, lambda h, i: F.array_sort(group(h, i))))
    lines = lambda p: F.transform(F.transform("near", lambda g: _from_outliers(_within(g, p))), lambda g, i: F.struct(F.size(g).alias("n"), i.alias("line"), F.array_max(F.transform(g, lambda c: c["y"])).alias("y"), _values(g).alias("v")))
    pages = once(pages, stacked=F.transform("products", lambda p: F.when(~F.array_contains("read", p["title"]), F.filter(lines(p), lambda l: l["n"].isin(6, 10, 16)))))
    beginning = lambda s: F.array_min(F.transform(F.filter(s, lambda l: l["n"] != 6), lambda l: F.struct((l["n"] == 16).alias("whole"), l["line"].alias("line"), F.slice(l["v"], 1, 10).alias("base"))))
    top = lambda s: F.array_max(F.transform(F.filter(s, lambda l: l["n"] != 6), lambda l: l["y"]))
    ends = lambda s: F.transform(F.filter(s, lambda l: l["n"] != 10), lambda l: F.struct((l["n"] == 16).alias("whole"), l["line"].alias("line"), F.slice(l["v"], F.when(l["n"] == 16, 11).otherwise(1), F.lit(6)).alias("rest")))
    pages = once(pages, stacked=F.transform("stacked", lambda s: F.struct(top(s).alias("y"), beginning(s)["base"].alias("base"), ends(s).alias("ends"))))
    tried = lambda s: F.transform(F.when(s["base"].isNotNull(), s["ends"]), lambda e: F.struct(F.concat(s["base"], e["rest"]).alias("nums"), e["whole"].alias("whole"), e["line"].alias("line")))
    good = lambda nums: exprs.row_checks(*(nums[FIGURES.index(f)] for f in ("kcal_100", "protein_100", "fat_100", "carbs_100", "total_kcal", "weight")))
    best = lambda s: F.array_max(F.transform(tried(s), lambda t: F.struct(F.coalesce(good(t["nums"]), F.lit(False)).alias("a"), t["nums"][10].alias("b"), (~t["whole"]).alias("c"), (-t["line"]).alias("d"), t["nums"].alias("nums"))))["nums"]
    row = lambda s: F.struct(F.lit("Standard").alias("label"), F.lit("stacked").alias("layout"), s["y"].alias("y"), best(s).alias("nums"))
    pages = once(pages, stacked=F.transform("stacked", lambda s: F.filter(F.array(row(s)), lambda r: r["nums"].isNotNull())))
    none = F.slice(F.get("stacked", F.lit(0)), 1, 0)
    either = F.transform("products", lambda p, i: F.when(~F.array_contains("read", p["title"]), F.get("stacked", i)).otherwise(F.coalesce(F.get("found", i), none)))
    return once(pages, found=either)


def read_pages(cells: DataFrame, skip: str = SKIPPED, tolerance: float = 3.0) -> DataFrame:
    """(doc_id, page, product, title, category, label, layout, y, nums): the rows of all product pages.

    Pages without a table give nothing.  What a combined page does not give for a title is
    looked for as stacked.  A page's cells are shuffled once, to one row.
    """
    pages = with_stacked(with_combined(products_of(page_facts(paged_lines(cells, tolerance), skip))))
    each = pages.select(*PAGE, "category", F.explode(F.arrays_zip("products", "found")).alias("z")).select(*PAGE, "category", "z.products", F.explode("z.found").alias("r"))
    return each.select(*PAGE, "products.product", "products.title", "category", "r.label", "r.layout", "r.y", "r.nums")


def checked_rows(rows: DataFrame, accept: Column | None = None, delisted: str = DELISTED) -> DataFrame:
    """Rows with their figures as columns and a status: ok, repaired, rejected or delisted; untitled ones are left out.

    ``accept`` is a further predicate over the rows' columns; what it refuses is rejected.
    """
    named = rows.where("title <> ''").select("*", *(F.col("nums")[k].alias(f) for k, f in enumerate(FIGURES)))
    out = repair_rows(named)
    refused = ~F.coalesce(accept, F.lit(False)) if accept is not None else F.lit(False)
    return out.withColumn("status", F.when(F.col("category").rlike(delisted), "delisted").when(refused, "rejected").otherwise(F.col("status")))


def page_items(rows: DataFrame, label: str = "Size & Crust") -> DataFrame:
    """Items (restaurant, item_seq, name, category, macros, variant_of, variant_label, variant_option, final_name) of :func:`checked_rows`.

    Calories are the whole product's, other macros its figures for 100 g by its weight, to one
    place.  A product with several good rows has variants, in the order of the pages.
    """
    good = rows.where("status in ('ok', 'repaired')")
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "product", F.desc("y")))
    many = F.count(F.lit(1)).over(Window.partitionBy(*PAGE, "product")) > 1
    scaled = [exprs.round_half_up(F.col(f"{m}_100") * F.col("weight") / 100, 1).alias(m) for m in ("protein", "fat", "carbs")]
    items = good.select(F.col("doc_id").alias("restaurant"), seq.cast("long").alias("item_seq"), F.col("title").alias("name"), exprs.normalize_category(F.col("category")).alias("category"), F.col("total_kcal").alias("calories"), *scaled, F.when(many, F.struct(F.col("title").alias("base"), F.lit(label).alias("label"), F.col("label").alias("option"))).alias("variant"))
    return add_variants(items)
