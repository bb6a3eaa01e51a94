"""Small helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def small_table(spark: SparkSession, rows: Iterable[dict], schema: T.StructType) -> DataFrame:
    """A dimension table built on the driver.

    Going through Arrow gives Spark a local relation with an exact size, so the
    optimiser itself decides whether a join against it may be broadcast.
    """
    table = pa.Table.from_pylist(list(rows), schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema=schema)


def explode_once(table: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """One row per element of a computed array, beside the `keep` columns.

    A plain explode lets Spark first filter on the size of the array, and that
    filter would compute the array a second time.
    """
    computed = table.select(*keep, array.alias("_elements"))
    exploded = computed.select(*keep, F.explode_outer("_elements").alias(name))
    return exploded.filter(F.col(name).isNotNull())


# A table below this many bytes is not worth moving.
_TOO_SMALL = 1 << 20


def spread(table: DataFrame) -> DataFrame:
    """A small table over all cores; any other table as it is.

    Texts are costly to scan, and a table of a few row groups would keep a few
    cores busy.  Only a table whose estimated size is less than one input split
    per core is moved, so the amount moved is bounded by the cluster and large
    inputs keep the partitions they are read in.
    """
    if table.isStreaming:
        return table
    spark = table.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(cores) if _TOO_SMALL <= size < cores * split else table


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for streaming state and intermediate tables.

    The cluster names it in `spark.checkpoint.dir`; only a session without that
    setting on a local master (a test) falls back to a scratch folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="lintlake-")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: what follows reads them again instead of making them again,
    also after the loss of an executor."""
    path = f"{checkpoint_root(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
