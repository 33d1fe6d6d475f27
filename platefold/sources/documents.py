"""Documents that lead to documents, that are replaced with care, and that cannot be read."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import settle

STORED = "key string, version string, sha string, content binary, folder string"
LOG = "key string, version string, sha string, folder string, at long"


# --- an address found in another document ---


def versioned_address(html: Column, base: str, mapping: str = r"window\.___chunkMapping=(\{.*?\});", bundle: str = "app", pattern: str = r"app-(\d+)\.js") -> Column:
    """``base``.<hash>.json with the hash that a page's own mapping of bundles names; null where it names none."""
    first = F.get(F.from_json(F.regexp_extract(html, mapping, 1), "map<string, array<string>>")[bundle], F.lit(0))
    found = F.regexp_extract(F.coalesce(first, F.lit("")), pattern, 1)
    return F.when(found != "", F.concat(F.lit(f"{base}."), found, F.lit(".json")))


def follow(pages: DataFrame, address: Column, documents: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with address, ``documents``'s other columns under that address, and status: found, missing or unnamed."""
    rest = [c for c in documents.columns if c != url]
    target = documents.select(F.col(url).alias("address"), *rest, F.lit(True).alias("_there"))
    both = pages.withColumn("address", address).join(target, "address", "left")
    return both.withColumn("status", F.when(F.col("address").isNull(), "unnamed").when(F.col("_there"), "found").otherwise("missing")).drop("_there")


# --- a store that replaces a document only by a newer one ---


class DocumentStore:
    """Documents by key under ``path``: contents in folders that are never changed, and a log of which folder counts.

    A replacement is written aside and read back; only if its digest is what it should be does
    a line in the log, one commit, make it current.  Whatever fails before that leaves the old document.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], LOG)

    def current(self) -> DataFrame:
        """(key, version, sha, folder): what counts for each key."""
        best = F.max_by(F.struct("version", "sha", "folder"), "at")
        return self._log().groupBy("key").agg(best.alias("b")).select("key", "b.*")

    def read(self) -> DataFrame:
        """(key, version, content) of all current documents; only folders that hold one are opened."""
        now = settle(self.current())
        folders = [r[0] for r in now.select("folder").distinct().collect()]
        if not folders:
            return self.spark.createDataFrame([], "key string, version string, content binary")
        held = self.spark.read.schema(STORED).parquet(*folders)
        return held.join(now.select("key", "folder"), ["key", "folder"], "left_semi").select("key", "version", "content")

    def decide(self, new: DataFrame) -> DataFrame:
        """(key, version, sha, content, decision) for documents (key, version, content): new, unchanged (the same bytes),
        refused (other bytes under the version that is stored) or replace."""
        old = self.current().select("key", F.col("version").alias("_v"), F.col("sha").alias("_s"))
        both = new.select("key", "version", F.sha2(F.col("content").cast("binary"), 256).alias("sha"), F.col("content").cast("binary").alias("content")).join(old, "key", "left")
        decision = F.when(F.col("_s").isNull(), "new").when(F.col("_s") == F.col("sha"), "unchanged").when(F.col("_v").eqNullSafe(F.col("version")), "refused").otherwise("replace")
        return both.withColumn("decision", decision).drop("_v", "_s")

    def replace(self, new: DataFrame, at: int, check_only: bool = False, valid: Callable[[Column], Column] = lambda content: F.length(content) > 0) -> DataFrame:
        """:meth:`decide`, and what is new or to be replaced takes effect unless ``check_only``: (key, version, decision).

        ``at`` orders the log: the time in milliseconds.  Contents that are not ``valid`` are decided invalid.
        """
        decided = settle(self.decide(new).withColumn("decision", F.when(valid(F.col("content")), F.col("decision")).otherwise("invalid")))
        taken = decided.where("decision in ('new', 'replace')").select("key", "version", "sha", "content")
        if not check_only and not taken.isEmpty():
            folder = f"{self.path}/contents-{uuid.uuid4().hex}"
            taken.withColumn("folder", F.lit(folder)).write.parquet(folder)
            self._commit(folder, at, decided.where("decision in ('new', 'replace')").count())
        return decided.select("key", "version", "decision")

    def _commit(self, folder: str, at: int, expected: int) -> None:
        written = self.spark.read.schema(STORED).parquet(folder)
        good = written.agg(F.count_if(F.sha2("content", 256) == F.col("sha"))).first()[0]
        if good != expected:
            raise OSError(f"{folder} holds {good} of {expected} documents as they should be")
        lines = written.select("key", "version", "sha", "folder", F.lit(at).cast("long").alias("at"))
        lines.coalesce(1).write.mode("append").parquet(f"{self.path}/log")


# --- faults found while reading ---


def read_json_lines(spark: SparkSession, path: str, schema: str, source: str = "_file") -> tuple[DataFrame, DataFrame]:
    """(rows, faults) of JSON lines: a bad record is a row (file, fault, text) of faults instead of an end of the scan."""
    marked = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(f"{schema}, _bad string").json(path).withColumn(source, F.col("_metadata.file_path"))
    marked = settle(marked)
    bad = F.col("_bad").isNotNull()
    return marked.where(~bad).drop("_bad"), marked.where(bad).select(F.col(source).alias("file"), F.lit("bad record").alias("fault"), F.col("_bad").alias("text"))


def read_parquet_files(spark: SparkSession, path: str, schema: str, source: str = "_file") -> tuple[DataFrame, DataFrame]:
    """(rows, faults) of Parquet files: a file that cannot be read is a row of faults, (file, fault, text).

    The files are listed by name and length alone; one that the scan has no row of is told from an empty
    one by its end, which a whole Parquet file marks.
    """
    rows = settle(spark.read.option("ignoreCorruptFiles", "true").schema(schema).parquet(path).withColumn(source, F.col("_metadata.file_path")))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    listed = files.select(F.col("path").alias("file"), "length", "modificationTime")
    silent = settle(listed.join(rows.select(F.col(source).alias("file")).distinct(), "file", "left_anti"))
    whole = files.select(F.col("path").alias("file"), (F.substring("content", -4, 4) == F.lit(b"PAR1")).alias("whole"))
    torn = silent.join(whole.join(silent.select("file"), "file", "left_semi"), "file").where("not whole")
    return rows, torn.select("file", F.lit("bad file").alias("fault"), F.col("length").cast("string").alias("text"))


def fault_counts(faults: DataFrame) -> DataFrame:
    return faults.groupBy("file", "fault").agg(F.count(F.lit(1)).alias("n"))
