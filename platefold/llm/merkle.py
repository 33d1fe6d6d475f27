"""A Merkle manifest of a table: leaves, a root for each group, one for all, and a proof for each row.

A tree is built level by level.  A window over (group, parent index) with an ordered full-frame
collect_list gives every node its whole run: the run is its parent's preimage, and without the
node itself it is the node's siblings.  The first node of a run stands for the parent, so each
level is a sixteenth of the one below and no group of rows is larger than a run.  Proofs come
down the same levels: a node's steps are its own siblings, then its parent's steps.

A group's rows are numbered by one range sort over all groups, so a group that holds a third of
the table is spread over as many tasks as its rows need.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Nodes that become one on the next level.
ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<before:string,after:string>>"


def framed(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 bytes after their number and a colon; integers are decimal."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*(framed(v) for v in values)).cast("binary"), 256)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its steps lead to."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]).cast("binary"), 256))


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (g, and ``order``) with ``idx``, the place within g, and ``n``, the size of g.

    ``order`` starts with columns that g is made of.  One range sort; then only the places where
    groups begin in partitions, at most one for each group and partition, are summed up.
    """
    place = F.monotonically_increasing_id()  # within a sorted partition: consecutive
    placed = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", place), "merkle-order")
    placed = placed.withColumn("part", F.shiftright("place", 33))
    starts = placed.groupBy("g", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("c"))
    by_group = Window.partitionBy("g")
    before = F.sum("c").over(by_group.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")
    starts = starts.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("c").over(by_group).alias("n"))
    return placed.join(starts, ["g", "part"]).withColumn("idx", F.col("place") + F.col("shift")).drop("place", "part", "shift")


def _runs(level: DataFrame) -> DataFrame:
    """Each node of ``level`` (g, idx, hash, n) whose group is not down to one node, with ``parent`` and ``run``."""
    nodes = level.where("n > 1").withColumn("parent", F.expr(f"idx div {ARITY}"))
    whole = Window.partitionBy("g", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.withColumn("run", F.collect_list("hash").over(whole))


def _step() -> Column:
    own = (F.col("idx") % ARITY).cast("int")
    before = F.array_join(F.slice("run", F.lit(1), own), "")
    after = F.array_join(F.slice("run", own + 2, F.lit(ARITY)), "")
    return F.array(F.struct(before.alias("before"), after.alias("after")))


def _climb(leaves: DataFrame) -> list[DataFrame]:
    """The levels over ``leaves`` (g, idx, n, hash), until every group is down to one node."""
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        first = _runs(levels[-1]).where(F.col("idx") % ARITY == 0)
        parents = first.select("g", F.col("parent").alias("idx"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), F.sha2(F.array_join("run", "").cast("binary"), 256).alias("hash"))
        levels.append(stage(parents, "merkle-level"))
        most = -(-most // ARITY)
    return levels


def _tops(levels: list[DataFrame]) -> DataFrame:
    """(g, hash): what remains of each group."""
    found = [x.where("n = 1").select("g", "hash") for x in levels]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest level's rows with ``top`` and ``steps``; ``tops`` (g, top, steps) is what lies above each group's last node."""
    above = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        # one node for each group that ends on this level: nothing hot meets here
        rows = level.where("n = 1").join(tops, "g")
        if above is not None:
            own = _runs(level).withColumn("own", _step()).drop("run")
            inner = own.join(above.select("g", F.col("idx").alias("parent"), "top", F.col("steps").alias("rest")), ["g", "parent"])
            inner = inner.withColumn("steps", F.concat("own", "rest")).drop("own", "rest", "parent")
            rows = rows.unionByName(inner.select(rows.columns))
        above = rows if k == 0 else stage(rows.select("g", "idx", "top", "steps"), "merkle-steps")
    return above


@dataclass
class Manifest:
    """``leaves``: one row for each row of the table (order column, group column, leaf, other); ``root``: null for an empty table."""

    levels: list[DataFrame]
    tops: DataFrame
    root: str | None

    def proofs(self) -> DataFrame:
        """(the order and group columns, leaf, other, subroot, root, steps) for every row."""
        found = _descend(self.levels, self.tops)
        return found.withColumnRenamed("hash", "leaf").withColumnRenamed("top", "subroot").withColumn("root", F.lit(self.root)).drop("g", "idx", "n")


def build(rows: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", other: dict[str, Column] | None = None, where: Column | None = None) -> Manifest:
    """The manifest of ``rows``.

    A leaf is the digest of ``fields``, each framed by its length.  Within ``group`` leaves ascend
    by ``order``, nulls first; rows with one id are ordered by their leaf, so equal rows are
    interchangeable.  Groups ascend bytewise, null first, a group of its own.  Null fields are
    ``-``, unlike empty ones.  Columns that are not named are not read, whatever they are called.

    ``other`` replaces fields to give a second leaf where ``where`` holds, null elsewhere: a copy of the
    row as it is found later, to be checked against the manifest.
    """
    values = [rows[f] for f in fields]
    again = leaf_digest(*((other or {}).get(f, rows[f]) for f in fields))
    changed = F.when(where, again) if where is not None else F.lit(None).cast("string")
    kept = rows.select(rows[order].alias("k"), rows[group].cast("string").alias("s"), framed(rows[group]).alias("g"), leaf_digest(*values).alias("hash"), changed.alias("other"), F.monotonically_increasing_id().alias("rid"))
    leaves = stage(_numbered(stage(kept, "merkle-leaves"), ["s", "k", "hash", "rid"]).drop("rid"), "merkle-ranked")
    levels = _climb(leaves.select("g", "idx", "n", "hash"))
    # the groups' last nodes are the leaves of one more tree
    names = leaves.where("idx = 0").select("g", "s")
    subroots = _numbered(stage(_tops(levels).join(names, "g").select(F.lit("").alias("g"), F.col("g").alias("of"), "s", "hash"), "merkle-subroots"), ["s", "of"])
    upper = _climb(stage(subroots, "merkle-upper"))
    last = _tops(upper).first()
    root = last["hash"] if last else None
    over = _descend(upper, upper[0].sparkSession.createDataFrame([("", root)], "g string, top string").withColumn("steps", F.array().cast(STEPS)))
    tops = stage(over.select(F.col("of").alias("g"), F.col("hash").alias("top"), "steps"), "merkle-tops")
    levels[0] = leaves.select("g", "idx", "n", "hash", F.col("k").alias(order), F.col("s").alias(group), "other")
    return Manifest(levels, tops, root)


def verified(rows: DataFrame, order: str = "doc_id", **how) -> DataFrame:
    """(order, group, leaf, subroot, root, proof_sha256, folded_root, verified) for every row: each leaf, or the other one
    where there is one, folded with the manifest's siblings. See :func:`build`; an empty table gives no rows."""
    found = build(rows, order=order, **how).proofs()
    folded = found.withColumn("folded_root", fold(F.coalesce("other", "leaf"), F.col("steps"))).withColumn("proof_sha256", proof_digest(F.col("steps")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root")).drop("steps", "other")
