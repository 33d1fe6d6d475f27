"""Exact dedup with a log-structured merge index of digests, in DataFrame operations only.

The input's partitions fill a few memtables.  A flush writes each as a run: rows of digest and
identifier, sorted by digest, in Parquet files with min/max statistics and Bloom filters for
literal look-ups.  Compaction merges runs, keeping one identifier and a count for each digest.
A probe of many texts first asks a blocked Bloom filter over the digests in question, a table of
64-bit words; only what it lets through is grouped.  Digests only propose copies: the texts that
they hit are compared byte for byte, and the bytes decide.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_hot, stage, stage_path

#: A run's files: each filter has the smallest of eight sizes, 8 KB to 1 MB, that serves its digests.
FILTERS = {"compression": "zstd", "parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.candidates.number": "8"}
ROW = "doc_id long, rid long, digest long, sha string, n long"
#: Memtables that a batch fills, and runs merged at a time.
MEMTABLES, FAN_IN = 4, 4
#: Digests for each word of the probe filter (16 bits each, two set), and words up to which it is broadcast (16 bytes each).
PER_WORD, BROADCAST_WORDS = 4, 1 << 22


def digest_of(text: Column) -> Column:
    """64 bits of a text; equal ones are candidates only."""
    return F.xxhash64(text)


def _bits(digest: Column) -> Column:
    """The two bits of its word that a digest sets."""
    h = F.xxhash64(digest, F.lit(1))
    one = F.lit(1).cast("long")
    return F.call_function("shiftleft", one, (h.bitwiseAND(F.lit(63))).cast("int")).bitwiseOR(F.call_function("shiftleft", one, (F.shiftright(h, 6).bitwiseAND(F.lit(63))).cast("int")))


def probe_filter(digests: DataFrame, count: int) -> tuple[DataFrame, int]:
    """A blocked Bloom filter over ``digests`` (digest): rows (word, mask), and the number of words."""
    words = 1 << max(6, ceil(log2(max(1, count) / PER_WORD)))
    return digests.groupBy(F.xxhash64("digest").bitwiseAND(F.lit(words - 1)).alias("word")).agg(F.bit_or(_bits(F.col("digest"))).alias("mask")), words


def probe(rows: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """Rows whose digest the filter may hold: all that it holds, and about one in fifty others."""
    word = F.xxhash64("digest").bitwiseAND(F.lit(size - 1))
    own = F.broadcast(words) if size <= BROADCAST_WORDS else words
    return rows.withColumn("word", word).join(own, "word").where(F.col("mask").bitwiseAND(_bits(F.col("digest"))) == _bits(F.col("digest"))).drop("word", "mask")


def _order(keep: str) -> Column:
    """What min or max of puts a null id last."""
    missing = F.col("doc_id").isNull()
    if keep == "max":
        return F.struct((~missing).alias("known"), F.col("doc_id").alias("k")).alias("order")
    return F.struct(missing.alias("missing"), F.col("doc_id").alias("k")).alias("order")


class DigestIndex:
    """Runs of (doc_id, rid, digest, sha, n) under ``path``; ``keep`` says whose row stays: min or max id."""

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "min", fan_in: int = FAN_IN, memtables: int = MEMTABLES):
        if keep not in ("min", "max"):
            raise ValueError("keep must be min or max")
        self.spark, self.path, self.keep, self.fan_in, self.memtables = spark, path or stage_path(spark, "lsm"), keep, fan_in, memtables
        self.runs: list[str] = []
        self.made = 0

    def _name(self, level: int) -> str:
        self.made += 1
        return f"{self.path}/level-{level}-{self.made}"

    def flush(self, docs: DataFrame) -> DataFrame:
        """Add a batch (doc_id, text): one run for each memtable; returns the rows of these runs.

        ``rid`` tells repeated rows of one identifier apart; it is fixed by being written.
        """
        rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), digest_of(F.col("text")).alias("digest"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.lit(1).cast("long").alias("n"))
        base = self._name(0)
        rows.withColumn("memtable", F.spark_partition_id() % self.memtables).sortWithinPartitions("memtable", "digest").write.partitionBy("memtable").options(**FILTERS).parquet(base)
        # memtables that no partition fell to have no run
        filled = [r[0] for r in self.spark.read.schema(f"{ROW}, memtable int").parquet(base).select("memtable").distinct().collect()]
        new = [f"{base}/memtable={m}" for m in sorted(filled)]
        self.runs += new
        return self.read(new)

    def read(self, runs: list[str] | None = None) -> DataFrame:
        runs = self.runs if runs is None else runs
        return self.spark.read.schema(ROW).parquet(*runs) if runs else self.spark.createDataFrame([], ROW)

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row for each digest: who stays (a null id only among nulls), and how many there are."""
        best = F.max if self.keep == "max" else F.min
        merged = rows.groupBy("digest").agg(best(F.struct(_order(self.keep), "doc_id", "rid")).alias("s"), F.sum("n").alias("n"))
        return merged.select("s.doc_id", "s.rid", "digest", F.lit(None).cast("string").alias("sha"), "n")

    def entries(self) -> DataFrame:
        """One row per digest over all runs."""
        return self._merged(self.read())

    def compact(self) -> None:
        """Merge the runs, ``fan_in`` at a time, until one is left that holds one row for each digest.

        Each task sums up its own part of a run before the shuffle, so a digest that many rows
        share moves one row per task.
        """
        level = 0
        while self.runs and (level == 0 or len(self.runs) > 1):
            level += 1
            merged = []
            for i in range(0, len(self.runs), self.fan_in):
                run = self._name(level)
                self._merged(self.read(self.runs[i : i + self.fan_in])).sortWithinPartitions("digest").write.options(**FILTERS).parquet(run)
                merged.append(run)
            self.runs = merged

    def seen(self, docs: DataFrame, held: DataFrame) -> DataFrame:
        """Rows of ``docs`` (doc_id, text) with ``first_id``: whose text here is the same, or null.

        ``held`` (doc_id, text) are the documents that the index was made of: a hit counts only
        if the bytes agree with one of its digest.
        """
        rows = stage(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("rid"), digest_of(F.col("text")).alias("digest")), "probe")
        asked = stage(rows.select("digest").distinct(), "asked")
        words, size = probe_filter(asked, asked.count())
        hits = probe(held.select("doc_id", "text", digest_of(F.col("text")).alias("digest")), stage(words, "words"), size)
        best = F.max if self.keep == "max" else F.min
        first = hits.groupBy("digest", "text").agg(best("doc_id").alias("first_id"))
        return rows.join(first, ["digest", "text"], "left").select("doc_id", "text", "first_id")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, variants) for every row.

    Equal texts, byte for byte, are a group; the row with the least (``keep='max'``: largest)
    id stays.  Null texts count as empty, and all empty texts are equal.  Of rows repeated
    with one id, one is kept.  A null id stays only where its whole group has none.  An empty
    table gives an empty result.

    Digests that occur once are settled by the index.  The texts of the others are found by the
    probe filter and grouped by their bytes; each task collapses its own copies before the
    shuffle, so a group of any size moves one row per task, and the rows of large groups are
    joined with a broadcast of those groups alone.  ``variants`` is the number of different texts
    behind a digest; where it is not 1 the groups are those of the bytes.
    """
    spark = docs.sparkSession
    rows = documents(docs, id_col, text_col)
    index = DigestIndex(spark, keep=keep)
    run = index.flush(rows)
    index.compact()
    repeated = stage(index.read().where("n > 1").select("digest", F.col("doc_id").alias("keep_id"), F.col("rid").alias("keep_rid"), "n"), "repeated")
    words, size = probe_filter(repeated.select("digest"), repeated.count())
    texts = rows.select("doc_id", "text", digest_of(F.col("text")).alias("digest"))
    hits = probe(texts.select("digest", "text"), stage(words, "words"), size)
    # byte verification: one row for each different text behind a hit
    verified = hits.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("c")).groupBy("digest").agg(F.count(F.lit(1)).alias("variants"))
    held = stage(repeated.join(verified, "digest"), "held")
    out = join_hot(run.drop("n"), held, ["digest"], "n", "left")
    single = F.col("n").isNull()
    found = out.where("variants is null or variants = 1").select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.coalesce("variants", F.lit(1).cast("long")).alias("variants"),
    )
    shared = held.where("variants > 1").select("digest", "variants")
    if shared.isEmpty():
        return found
    return found.unionByName(_by_bytes(texts.join(shared, "digest"), keep))


def _by_bytes(rows: DataFrame, keep: str) -> DataFrame:
    """Groups of (doc_id, text, digest, variants) by the texts themselves: for digests that different texts share."""
    rows = stage(rows.withColumn("rid", F.monotonically_increasing_id()), "by-bytes")
    best = F.max if keep == "max" else F.min
    groups = rows.groupBy("digest", "text").agg(best(F.struct(_order(keep), "doc_id", "rid")).alias("s"), F.count(F.lit(1)).alias("n"))
    return rows.join(groups, ["digest", "text"]).select("doc_id", F.col("s.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rid") == F.col("s.rid")).alias("kept"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "variants")
