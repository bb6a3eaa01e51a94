"""A keyed table that batches update, kept as Parquet folders of hash buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Snapshot:
    """Rows by `key` in a fixed number of buckets; an update rewrites the buckets it touches, and no other.

    Every update is a version of its own: a folder with the touched buckets in full, valid once Spark has marked the
    write as done.  The table is, of every bucket, the latest valid version.  So a reader never sees half an update, and
    an update that is run again, as a stream does after a failure, starts from the versions before it and replaces
    its own.  `vacuum` removes what newer versions have replaced.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "file", buckets: int = 64):
        self.spark, self.schema, self.key, self.buckets = spark, schema, key, buckets
        # The number of buckets is part of the place: with another one it would be another table.
        self.path = f"{path.rstrip('/')}/buckets={buckets}"

    def bucket(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _folders(self, before: int | None = None) -> dict[int, tuple[int, str]]:
        """Of every bucket its latest valid version before the given one, and its folder."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        path = lambda tail: self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{tail}")
        valid = {s.getPath().getParent().getName() for s in fs.globStatus(path("version=*/_SUCCESS")) or []}
        found: dict[int, tuple[int, str]] = {}
        for status in fs.globStatus(path("version=*/bucket=*")) or []:
            folder = status.getPath()
            name = folder.getParent().getName()
            version, bucket = int(name.split("=")[1]), int(folder.getName().split("=")[1])
            if name in valid and (before is None or version < before) and version >= found.get(bucket, (version, ""))[0]:
                found[bucket] = (version, folder.toString())
        return found

    def version(self) -> int:
        """The latest valid version; -1 without one."""
        return max((version for version, _ in self._folders().values()), default=-1)

    def read(self, buckets: set[int] | None = None, before: int | None = None) -> DataFrame:
        """The table, or some of its buckets, as of now or before a version."""
        folders = [place for b, (_, place) in sorted(self._folders(before).items()) if buckets is None or b in buckets]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders).filter(F.col(self.key).isNotNull())

    def update(self, touched: DataFrame, change: Callable[[DataFrame], DataFrame], version: int) -> None:
        """Replaces the buckets of the `touched` keys: `change` makes their new rows of their old ones.

        A row without a key marks a bucket that was touched, since it may be empty now.
        """
        own = self.bucket(self.key).alias("bucket")
        # At most as many as there are buckets.
        buckets = {r[0] for r in touched.select(own).distinct().collect()}
        rows = change(self.read(buckets, version)).select(*self.schema.fieldNames())
        fields = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        marks = self.spark.createDataFrame([(b,) for b in sorted(buckets)], "bucket int").select(*fields, "bucket")
        every = rows.select("*", own).unionByName(marks)
        every.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={version}")

    def replace(self, keys: DataFrame, rows: DataFrame, version: int) -> None:
        """All rows of the given keys go, and the new ones come."""
        keys = keys.select(self.key).distinct()
        self.update(keys, lambda old: old.join(keys, self.key, "left_anti").unionByName(rows.select(*self.schema.fieldNames())), version)

    def vacuum(self, keep: int = 2) -> None:
        """Removes buckets that later valid versions have replaced, but for the last `keep` versions."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        latest, newest = self._folders(), self.version()
        for status in fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version=*/bucket=*")) or []:
            folder = status.getPath()
            version, bucket = int(folder.getParent().getName().split("=")[1]), int(folder.getName().split("=")[1])
            if version <= newest - keep and version < latest.get(bucket, (0, ""))[0]:
                fs.delete(folder, True)
