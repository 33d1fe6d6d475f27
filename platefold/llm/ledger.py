"""Secret scans over an incremental ledger of blobs, in DataFrame operations only.

Every version of every path is content-addressed: its blob is the digest of its text.  The ledger
holds which pairs of blob and rule version were scanned, and where their secrets lie.  A scan looks
only at pairs that are not in it, each blob once however many paths and versions have it, appends
what it finds, and joins the findings back to all paths.

Places are code points.  A text cut at a rule's matches gives the gaps between them; running sums
of the lengths of gaps and matches are the places.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_ROWS, join_hot, stage, stage_path

LOG = "batch string"
SCANNED = "blob string, kind string, version int"
FINDINGS = "blob string, kind string, version int, start int, end int"


@dataclass(frozen=True)
class Rule:
    """``pattern``'s leftmost non-overlapping matches whose ``group`` has ``least`` code points or more.

    ``hint`` is a string that each match holds, which spares the others the pattern.  A rule that is
    changed gets another ``version``, and old blobs are then scanned for it again.
    """

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    hint: str | None = None
    version: int = 1

    def spotted(self, text: Column) -> Column:
        """Whether a text is worth being cut."""
        found = text.rlike(self.pattern)
        return text.contains(self.hint) & found if self.hint else found


def either(word: str) -> str:
    """A pattern for ``word`` with letters A-Z in either case, and for nothing else."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
#: Spans are listed by start, then in this order.
RULES = (
    Rule("assign", rf"({NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18, hint="AKIA"),
    Rule("hex", r"[0-9a-f]{16,}", 16),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\n\r]+-----END [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", hint="eyJ"),
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("login", r"[a-z][a-z0-9+.-]*://[^\x20\n\r\t/:@]+:[^\x20\n\r\t/:@]+@", hint="://"),
)
BASE = ("assign", "access", "hex")


def _cut(text: Column, rule: Rule) -> Column:
    """Lengths of the gaps before, the whole matches, and the parts that count."""
    lengths = lambda parts: F.transform(parts, lambda x: F.length(x))
    matches = lambda group: lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group)))
    return F.arrays_zip(lengths(F.split(text, rule.pattern, -1)).alias("gap"), matches(0).alias("whole"), matches(rule.group).alias("part"))


def spans(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind, version, start, end) over ``blobs`` (blob, text, and missing: the rules to look for, as kind@version).

    The sums run over one blob's matches of one rule; texts without a match end in the first step.
    """
    text = F.col("text")
    cuts = [F.when(F.array_contains("missing", f"{r.kind}@{r.version}") & r.spotted(text), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"), _cut(text, r).alias("cut"))) for r in rules]
    found = blobs.select("blob", F.explode(F.array_compact(F.array(*cuts))).alias("r"))
    pieces = found.select("blob", "r.kind", "r.version", "r.least", F.posexplode("r.cut").alias("place", "x")).where("x.whole is not null")
    so_far = Window.partitionBy("blob", "kind", "version").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = pieces.withColumn("end", F.sum(F.col("x.gap") + F.col("x.whole")).over(so_far).cast("int"))
    return ends.where(F.col("x.part") >= F.col("least")).select("blob", "kind", "version", (F.col("end") - F.col("x.whole")).alias("start"), "end")


class Ledger:
    """Batches of scanned pairs and findings under ``path``; one in the log counts, one that was broken off does not."""

    def __init__(self, spark: SparkSession, path: str | None = None, rules: tuple[Rule, ...] = RULES):
        if len({r.kind for r in rules}) < len(rules):
            raise ValueError("each kind has one rule")
        self.spark, self.path, self.rules = spark, path or stage_path(spark, "ledger"), rules

    def _read(self, what: str, schema: str) -> DataFrame:
        try:
            batches = [r[0] for r in self.spark.read.schema(LOG).parquet(f"{self.path}/log").distinct().collect()]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            batches = []
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{b}/{what}" for b in sorted(batches))) if batches else self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", SCANNED)

    def findings(self) -> DataFrame:
        """Of the ledger's rules, as they are now."""
        current = [f"{r.kind}@{r.version}" for r in self.rules]
        return self._read("findings", FINDINGS).where(F.concat_ws("@", "kind", "version").isin(current))

    def pending(self, paths: DataFrame) -> DataFrame:
        """(blob, missing): each different blob of ``paths`` that some rule was not held against yet."""
        wanted = F.array(*(F.lit(f"{r.kind}@{r.version}") for r in self.rules))
        done = self.scanned().groupBy("blob").agg(F.collect_set(F.concat_ws("@", "kind", "version")).alias("done"))
        asked = paths.select("blob").distinct().join(done, "blob", "left")
        return asked.select("blob", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>"))).alias("missing")).where(F.size("missing") > 0)

    def scan(self, history: DataFrame, path_col: str = "path", version_col: str | None = None, text_col: str = "text") -> DataFrame:
        """(path, version, blob, findings: array of (kind, start, end)) for every row of ``history``.

        A null text counts as empty; null paths and repeated rows are rows like others.  Findings are
        ordered by start, then by the rules' order.  An empty history gives no rows and adds an
        empty batch.  The findings are written before the batch enters the log, so a scan that
        was broken off leaves no trace that counts.
        """
        blob = lambda text: F.sha2(text.cast("binary"), 256)
        text = F.coalesce(history[text_col].cast("string"), F.lit(""))
        version = history[version_col] if version_col else F.lit(None).cast("string")
        paths = stage(history.select(history[path_col].alias("path"), version.alias("version"), blob(text).alias("blob")), "paths")
        pending = stage(self.pending(paths), "pending")
        batch = f"batch-{uuid.uuid4().hex}"
        # a task sends one text for each blob, and only blobs that wait for a rule
        texts = history.select(blob(text).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
        spans(texts.join(pending, "blob"), self.rules).write.parquet(f"{self.path}/{batch}/findings")
        pairs = pending.select("blob", F.explode("missing").alias("m")).select("blob", F.substring_index("m", "@", 1).alias("kind"), F.substring_index("m", "@", -1).cast("int").alias("version"))
        pairs.write.option("compression", "zstd").parquet(f"{self.path}/{batch}/scanned")
        self.spark.createDataFrame([(batch,)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return self.joined(paths)

    def joined(self, paths: DataFrame) -> DataFrame:
        """``paths`` (path, version, blob), staged, with all findings of their blobs."""
        place = F.expr(f"array_position(array({', '.join(repr(r.kind) for r in self.rules)}), kind)")
        listed = self.findings().groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", place.alias("place"), "kind", "end"))).alias("f"))
        # blobs of many paths are listed with or without findings, so that their rows stay where they are
        held = stage(paths.groupBy("blob").agg(F.count(F.lit(1)).alias("c")).join(listed, "blob", "left").where((F.col("c") > HOT_ROWS) | F.col("f").isNotNull()), "held")
        out = join_hot(paths, held, ["blob"], "c", "left", paths.count())
        found = F.transform("f", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
        return out.select("path", "version", "blob", F.coalesce(found, F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("findings"))


def listed(findings: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
