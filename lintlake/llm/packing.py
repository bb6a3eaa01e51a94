"""Best-fit packing of documents into sequences, planned on the number of pieces of each length."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.llm.common import stored, table
from lintlake.llm.wordids import vocabulary_path, words

CAPACITY = 4096
END = 1

_FIELDS = "part int, rank long, piece int, start long, length long, ids_crc32 long"
# Characters tokenized at once; a longer text goes alone.
_CHUNK = 1 << 20


@dataclass
class Plan:
    """Where the pieces of a length go.  The k-th piece of a length belongs to the last run with `first` <= k: its
    sequence is `sequence + (k - first) // copies`, its place `offset + (k - first) % copies * length`."""

    sequences: int = 0
    runs: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Large pieces (over a third of the capacity) are matched, the others best-fit what is left.

    `counts` has the number of pieces of each length, so a plan costs the same for any number of pieces: pieces of a
    length and sequences with one gap are handled together, as runs.  Large pieces go from the longest on; each is
    matched with the longest large one that fits beside it.  Small pieces go from the longest on into the smallest
    gap that holds them, as many as fit, and open sequences when no gap does.
    """
    made = Plan(runs={length: [] for length in counts if counts[length]})
    left = {length: n for length, n in counts.items() if n}
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, number of sequences), in order

    def put(length: int, copies: int, sequence: int, offset: int, n: int) -> None:
        made.runs[length].append((counts[length] - left[length], copies, sequence, offset))
        left[length] -= n

    def opened(n: int, gap: int) -> int:
        first = made.sequences
        made.sequences += n
        if gap:
            insort(gaps, (gap, first, n))
        return first

    large = sorted(length for length in left if 3 * length > capacity)
    for a in reversed(large):
        while left[a]:
            at = bisect_left(large, capacity - a + 1) - 1
            while at >= 0 and not left[large[at]]:
                at -= 1
            b = large[min(at, bisect_left(large, a))] if at >= 0 else 0
            if b == a and left[a] == 1:
                at -= 1
                while at >= 0 and not left[large[at]]:
                    at -= 1
                b = large[at] if at >= 0 else 0
            if not b:
                n = left[a]
                put(a, 1, opened(n, capacity - a), 0, n)
            elif b == a:
                n = left[a] // 2
                put(a, 2, opened(n, capacity - 2 * a), 0, 2 * n)
            else:
                n = min(left[a], left[b])
                first = opened(n, capacity - a - b)
                put(a, 1, first, 0, n)
                put(b, 1, first, a, n)
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(gaps, (length, -1, -1))
            gap, first, n = gaps.pop(at) if at < len(gaps) else (capacity, made.sequences, 0)
            copies = min(gap // length, left[length])
            if not n:
                n = left[length] // copies
                made.sequences += n
            filled = min(n, left[length] // copies)
            put(length, copies, first, capacity - gap, filled * copies)
            if gap > copies * length:
                insort(gaps, (gap - copies * length, first, filled))
            if filled < n:
                insort(gaps, (gap, first + filled, n - filled))
    return made


def pieces(docs: DataFrame, key: str, text: str, path: str, capacity: int) -> DataFrame:
    """The pieces of all texts, with the number of each among those of its length in its partition."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = words(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            start = 0
            while start < batch.num_rows:
                end, chars, some = start, 0, []
                while end < batch.num_rows and (end == start or chars <= _CHUNK):
                    some.append(texts[end].as_py() or "")
                    chars += len(some[-1])
                    end += 1
                row, columns = _pieces(*encoder.encode(some), seen, capacity)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row + start)), pa.array(np.full(len(row), part, np.int32)), *map(pa.array, columns)],
                    names=[key, "part", "rank", "piece", "start", "length", "ids_crc32"],
                )
                start = end

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {_FIELDS}")


def _pieces(ids: np.ndarray, sizes: np.ndarray, seen: np.ndarray, capacity: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows of the pieces, and their columns rank, piece, start, length and ids_crc32."""
    ends = np.cumsum(sizes + 1)
    every = np.full(int(ends[-1]), END, "<u4")
    inside = np.ones(len(every), bool)
    inside[ends - 1] = False
    every[inside] = ids
    count = -(-(sizes + 1) // capacity)
    row = np.repeat(np.arange(len(sizes)), count)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = piece * capacity
    length = np.minimum(sizes[row] + 1 - start, capacity)
    first = (ends - sizes - 1)[row] + start
    crc = [zlib.crc32(every[a:b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
    order = np.argsort(length, kind="stable")
    of_length = length[order]
    new = np.flatnonzero(np.concatenate([[True], of_length[1:] != of_length[:-1]]))
    runs = np.diff(np.append(new, len(order)))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order)) - np.repeat(new, runs) + seen[of_length]
    seen[of_length[new]] += runs
    return row, [rank, piece.astype(np.int32), start, length, np.array(crc, np.int64)]


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None
) -> DataFrame:
    """`key, piece, start, length, ids_crc32, sequence_id, offset` for every piece of every row.

    A null or empty text is its end token alone; only rows of more tokens than a sequence are cut.  Equal and
    repeated rows are packed each.  Pieces get a number among those of their length: within a partition when they
    are made, and on top of it the number of such pieces in the partitions before.  The plan is made on the driver
    from the number of pieces of each length, at most `capacity` rows, and has a run or two for each; every task
    looks up its pieces in it.
    """
    made = stored(pieces(docs, key, text, path or vocabulary_path(), capacity), "pieces")
    held = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = stored(held.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "held")
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    numbered = made.join(held.drop("n"), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    slim = numbered.select(key, "piece", "start", "length", "ids_crc32", "rank")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return slim.mapInArrow(_placed(docs.sparkSession, plan(counts, capacity)), schema)


def _placed(spark: SparkSession, made: Plan) -> Callable:
    arrays = {length: np.array(runs, np.int64).reshape(-1, 4) for length, runs in made.runs.items()}
    shared = spark.sparkContext.broadcast(arrays)  # a few runs for each length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length).tolist():
                at = np.flatnonzero(length == size)
                runs = shared.value[size]
                chosen = runs[np.searchsorted(runs[:, 0], rank[at], side="right") - 1]
                step = rank[at] - chosen[:, 0]
                sequence[at] = chosen[:, 2] + step // chosen[:, 1]
                offset[at] = chosen[:, 3] + step % chosen[:, 1] * size
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    return run


def op2_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """Last pipeline stage: the packed pieces of all rows."""
    return pack(docs)
