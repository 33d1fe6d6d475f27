"""Remaining macros from the text of a screenshot: a table's row, columns of a card, or a label with its value near it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ROW_PARTS, column_order, numbers_in, remaining_in_line, row_parts, values_of_parts
from ..staging import once

#: The word that names each column, in the order of a table whose header cannot be read.
COLUMNS = {"calories": "calorie", "carbs": "carb", "fat": "fat", "protein": "protein", "sodium": "sodium", "sugar": "sugar"}
TARGETS = ("calories", "protein", "carbs", "fat")
#: Lines from a label on in which its value is looked for.
NEAR = 4


def lines_of(text: Column) -> Column:
    """A text's lines in lower case, without blanks around them and without empty ones."""
    lines = F.transform(F.split(F.lower(text), r"\r?\n"), lambda l: F.regexp_replace(l, r"^\s+|\s+$", ""))
    return F.filter(lines, lambda l: l != "")


def _first(lines: Column, holds) -> Column:
    """The place of the first line for which ``holds``, from 0; null for none."""
    places = F.filter(F.transform(lines, lambda l, i: F.when(holds(l), i)), lambda i: i.isNotNull())
    return F.get(places, F.lit(0))


def _named(line: Column, keys) -> Column:
    """How many of the columns a line names."""
    return sum((F.contains(line, F.lit(COLUMNS[k])).cast("int") for k in keys), F.lit(0))


def _near(lines: Column, at: Column, near: int) -> Column:
    return F.get(F.filter(F.slice(lines, at + 1, F.lit(near)), lambda l: l.rlike(r"\d")), F.lit(0))


def value_near(lines: Column, at: Column, near: int = NEAR) -> Column:
    """What is left by the first line with a digit among the ``near`` lines from place ``at`` on; null if there is none."""
    return remaining_in_line(_near(lines, at, near))


def read_targets(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with layout (table or card), the four macros, null where they were not read, and ``unread``, their names.

    A line with the word remaining and four numbers is a table's row: its numbers go by a header
    that names all four macros, else by the fixed order.  Otherwise the first line that names two
    macros or more is a card's header, and the first line with a digit after it has their values in
    the header's order.  What is missing then is looked for by its own label, on its line or the
    three after it.  A text is never split over rows, and what is read of it is
    computed once.
    """
    rows = once(texts, _l=lines_of(F.coalesce(F.col(text), F.lit(""))))
    lines = F.col("_l")
    rows = once(rows, _table=F.get(F.filter(lines, lambda l: l.rlike(r"\bremaining\b") & (F.size(numbers_in(l)) >= 4)), F.lit(0)))
    table = F.col("_table").isNotNull()
    header = F.when(table, F.get(F.filter(lines, lambda l: _named(l, COLUMNS) >= 3), F.lit(0)))
    rows = once(rows, _header=header, _numbers=F.when(table, numbers_in(F.col("_table"))), _card=F.when(~table, _first(lines, lambda l: _named(l, TARGETS) >= 2)))
    top = F.get(lines, F.col("_card"))
    after = F.filter(F.slice(lines, F.col("_card") + 2, F.greatest(F.size(lines), F.lit(1))), lambda l: l.rlike(r"\d"))
    rows = once(rows, _read=column_order(F.col("_header"), COLUMNS), _top=top, _line=F.get(after, F.lit(0)))
    hits = F.array(*(F.struct(F.locate(COLUMNS[t], F.col("_top")).alias("at"), F.lit(t).alias("key")) for t in TARGETS))
    heads = F.when(F.col("_card").isNotNull(), F.transform(F.array_sort(F.filter(hits, lambda h: h["at"] > 0)), lambda h: h["key"]))
    whole = F.forall(F.array(*map(F.lit, TARGETS)), lambda t: F.array_contains("_read", t))
    rows = once(rows, _order=F.when(whole, F.col("_read")).otherwise(F.array(*map(F.lit, COLUMNS))), _heads=heads, **{f"_in_{k}": c for k, c in row_parts(F.col("_line")).items()})
    parts = {k: F.col(f"_in_{k}") for k in ROW_PARTS}
    values = F.when(F.size("_heads") == 2, values_of_parts(**parts, n=2)).when(F.size("_heads") == 3, values_of_parts(**parts, n=3)).otherwise(values_of_parts(**parts, n=4))
    rows = once(rows, _values=F.when(F.col("_heads").isNotNull() & F.col("_line").isNotNull(), values))
    at = lambda key, order, numbers: F.when(F.array_contains(order, key), F.get(F.col(numbers), (F.array_position(F.col(order), F.lit(key)) - 1).cast("int")))
    rows = once(rows, **{f"_at_{t}": F.when(table, at(t, "_order", "_numbers")).otherwise(at(t, "_heads", "_values")) for t in TARGETS})
    # what is missing has its own label looked for, then a line with a digit near it, then that line's numbers
    rows = once(rows, **{f"_own_{t}": F.when(~table & F.col(f"_at_{t}").isNull(), _first(lines, lambda l, t=t: F.contains(l, F.lit(COLUMNS[t])))) for t in TARGETS})
    rows = once(rows, **{f"_near_{t}": _near(lines, F.col(f"_own_{t}"), NEAR) for t in TARGETS})
    macros = {t: F.coalesce(f"_at_{t}", remaining_in_line(F.col(f"_near_{t}"))) for t in TARGETS}
    out = rows.withColumns(macros).withColumn("layout", F.when(table, "table").otherwise("card"))
    unread = F.array_compact(F.array(*(F.when(F.col(t).isNull(), F.lit(t)) for t in TARGETS)))
    return out.withColumn("unread", unread).select(*texts.columns, *TARGETS, "layout", "unread")
