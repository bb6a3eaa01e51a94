"""What the operators of this folder share: tables, folds, stored intermediate results, Arrow batches."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.support import checkpoint_root

# The white space that separates words: the blank and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, parts: int) -> Column:
    """Remainder of the CRC-32 of a key's text; a null key has the remainder of the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: later steps survive a lost executor."""
    spark = frame.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def unused(name: str, columns: list[str]) -> str:
    """A name for a column of our own that none of `columns` has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


# Bits of a filter of keys.
_FILTER = 1 << 23


def key_bits(keys: list[str]) -> list[Column]:
    """Two places of a row's keys in the filter: `bit0, bit1`."""
    return [F.pmod(F.xxhash64(*keys, F.lit(i)), F.lit(_FILTER)).alias(f"bit{i}") for i in range(2)]


def key_filter(frame: DataFrame, keys: list[str]) -> bytes:
    """A filter of fixed size, low bits first, that has both bits of every key of `frame`, and of few others.

    As more keys come in it lets more others pass, up to all: what passes has to be joined still.
    """
    words = frame.select(F.explode(F.array(*key_bits(keys))).alias("bit")).groupBy((F.col("bit") / 64).cast("int").alias("word"))
    rows = words.agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("mask")).toArrow()
    filled = np.zeros(_FILTER // 64, "<i8")
    filled[rows.column("word").to_numpy()] = rows.column("mask").to_numpy()
    return filled.tobytes()


def cached(key: str, make: Callable[[], object]) -> object:
    """An object that a Python worker builds once and keeps for its later tasks."""
    kept = vars(sys).setdefault("_lintlake_llm", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_batch(frame: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """`function` on every Arrow batch; it returns the columns of `schema` by name."""
    arrow = _arrow_schema(frame.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield to_batch(function(batch), arrow)

    return frame.mapInArrow(run, schema)


def to_batch(columns: dict, arrow: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in arrow:
        value = columns[field.name]
        if not isinstance(value, pa.Array):
            value = pa.array(value, type=field.type)
        arrays.append(value.cast(field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=arrow)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema))
