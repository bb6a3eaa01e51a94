"""Files that come, change and vanish, and their findings over time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.plans.scan import Options, scan
from lintlake.schema import FINDINGS
from lintlake.streaming.lifecycle import merge_lifecycle
from lintlake.streaming.snapshot import Snapshot

# What is known of a file: how long its text is, and its hash.  A file that is gone has neither.
STATE = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("digest", T.StringType()),
    ]
)


class Tracker:
    """The state of all files, and the table of their findings, as of the latest batch.

    A batch has (file, code, language) and may have `removed`, true of files that are gone, and `mtime`.  Of several
    rows of a file in one batch the removal counts, then the latest `mtime`.  Files are compared by their content, so
    the age of a file is of no account, and one that comes again as it was is not scanned again.

    Findings are kept with their history, as by `merge_lifecycle`: those of a changed or removed file that are gone are
    `fixed`, the others stay what they were.  Both tables are in hash buckets of the file names, and a batch rewrites
    the buckets of its changed files only.  The state is written last: a batch that failed before that is repeated whole.
    """

    def __init__(
        self, spark: SparkSession, path: str, rules: DataFrame | None = None, options: Options = Options(), buckets: int = 64, **changes
    ):
        self.spark, self.rules = spark, rules
        self.options = Options(**{**options.__dict__, **changes, "order": False, "unique_files": True})
        self.state = Snapshot(spark, f"{path}/state", STATE, "file", buckets)
        self.history = Snapshot(spark, f"{path}/findings", FINDINGS, "file", buckets)

    def findings(self) -> DataFrame:
        """All findings, also those of the past."""
        return self.history.read()

    def open_findings(self) -> DataFrame:
        return self.findings().filter("status <> 'fixed'")

    def files(self) -> DataFrame:
        """(file, length, digest) of all files that are there."""
        return self.state.read().filter("digest IS NOT NULL")

    def apply(self, batch: DataFrame, version: int) -> None:
        """Takes up one batch; versions ascend."""
        changed = self._changed(batch, version).persist(StorageLevel.DISK_ONLY)
        try:
            present = changed.filter("digest IS NOT NULL").select("file", "code", "language")
            names = changed.select("file")
            found = scan(present, self.rules, options=self.options)
            now = self.options.now
            self.history.update(names, lambda old: _of(old, names, found, now), version)
            self.state.replace(names, changed.select(*STATE.fieldNames()), version)
        finally:
            changed.unpersist()

    def _changed(self, batch: DataFrame, version: int) -> DataFrame:
        """(file, code, language, length, digest): the latest row of each file, where it differs from what is known."""
        removed = F.coalesce("removed", F.lit(False)) if "removed" in batch.columns else F.lit(False)
        mtime = F.col("mtime") if "mtime" in batch.columns else F.lit(None).cast("timestamp")
        texts = batch.filter(F.col("file").isNotNull()).select(
            "file",
            F.when(~removed, F.coalesce("code", F.lit(""))).alias("code"),
            F.lower("language").alias("language"),
            mtime.alias("mtime"),
        )
        texts = texts.withColumns({"length": F.length("code").cast("long"), "digest": F.sha2("code", 256)})
        order = [F.col("digest").isNotNull(), F.desc_nulls_last("mtime"), "digest", "language"]
        latest = F.row_number().over(Window.partitionBy("file").orderBy(*order))
        texts = texts.withColumn("_rank", latest).filter(F.col("_rank") == 1).drop("_rank", "mtime")
        known = self.state.read(before=version).select("file", F.col("length").alias("_length"), F.col("digest").alias("_digest"))
        joined = texts.join(known, "file", "left")
        same = F.col("digest").eqNullSafe(F.col("_digest")) & F.col("length").eqNullSafe(F.col("_length"))
        return joined.filter(~same).drop("_length", "_digest")

    def sync(self, files: DataFrame) -> None:
        """Takes up a whole tree as it is now: files that are known but not in it are gone."""
        gone = self.files().join(files.select("file"), "file", "left_anti")
        columns = [c for c in ("file", "code", "language", "mtime") if c in files.columns]
        removed = gone.select("file", F.lit(True).alias("removed"))
        self.apply(files.select(*columns).unionByName(removed, allowMissingColumns=True), self.state.version() + 1)

    def on_batch(self) -> Callable[[DataFrame, int], None]:
        """For `foreachBatch`.  The number of a batch is its version, so a batch that is run again replaces itself."""
        return self.apply

    def run_available(self, stream: DataFrame, checkpoint: str) -> None:
        """Takes up all that has arrived on a stream of batches."""
        query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.on_batch())
        query.trigger(availableNow=True).start().awaitTermination()


def _of(old: DataFrame, files: DataFrame, found: DataFrame, now) -> DataFrame:
    return merge_lifecycle(old, found, now, files)
