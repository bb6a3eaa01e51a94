"""SimHash near-duplicates: fingerprints joined on shared blocks, then compared bit by bit."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import by_batch, stored, table, unused
from lintlake.llm.graph import components

SHINGLE = 4
RADIUS = 4
SEED = 42

# Runs up to this length are compared pair by pair at once, longer ones by growing clusters.
_SHORT = 16
_SLICE = 1 << 16


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """`key, fp` for every row of `docs`; `fp` is the 64-bit SimHash of its word shingles as a long.

    Shingles count as often as they occur.  A text of fewer words than a shingle is one shingle; a null text or
    one without a word has fingerprint 0.  Repeated rows each give a row.
    """

    def batch(rows: pa.RecordBatch) -> dict:
        return {"id": rows.column(0), "fp": _simhash(rows.column(1), shingle).view(np.int64)}

    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    return by_batch(slim, batch, "id long, fp long")


def _simhash(texts: pa.Array, shingle: int) -> np.ndarray:
    found = np.zeros(len(texts), np.uint64)
    pending: list[tuple[int, np.ndarray]] = []
    held = 0
    for row, text in enumerate(texts):
        hashes = _shingle_hashes(text.as_py() or b"", shingle)
        if len(hashes):
            pending.append((row, hashes))
            held += len(hashes)
        if held > _SLICE:
            _vote(pending, found)
            pending, held = [], 0
    _vote(pending, found)
    return found


def _shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    words = text.lower().split()
    count = len(words) - shingle + 1
    if count <= 1:
        whole = [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
        return np.array(whole, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    digest = xxhash.xxh64_intdigest
    pairs = zip((ends - lengths)[:count].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, count)


def _vote(pending: list[tuple[int, np.ndarray]], found: np.ndarray) -> None:
    """Sets the fingerprint of each pending row: a bit that over half of its hashes have."""
    if not pending:
        return
    sizes = np.array([len(hashes) for _, hashes in pending])
    bits = np.zeros((len(pending), 64), np.int64)
    owner = np.repeat(np.arange(len(pending)), sizes)
    every = np.concatenate([hashes for _, hashes in pending])
    for start in range(0, len(every), _SLICE):
        part = every[start : start + _SLICE]
        rows, first = np.unique(owner[start : start + _SLICE], return_index=True)
        ones = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bits[rows] += np.add.reduceat(ones, first, axis=0, dtype=np.int64)
    majority = (2 * bits > sizes[:, None]).astype(np.uint8)
    packed = np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel()
    found[[row for row, _ in pending]] = packed


def block_count(distinct: int, radius: int = RADIUS) -> int:
    """So many blocks that a key of shared blocks has at least as many values as there are fingerprints.

    Any number above the radius finds the same links; more blocks only make longer keys, hence smaller groups.
    """
    blocks = radius + 1
    while blocks < 2 * radius and 64 * (blocks - radius) // blocks < max(distinct, 1).bit_length() + 2:
        blocks += 1
    return blocks


def block_masks(blocks: int, radius: int) -> list[int]:
    """Fingerprints within `radius` bits agree on all bits of at least one of these masks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """`a, b`: links that connect all distinct fingerprints `fp` within `radius` bits of each other.

    Every fingerprint is dealt once per set of blocks, so that near ones meet; within such a group the distance
    is computed.  Not all pairs of a group come out, only enough of them to connect what is linked.
    """
    if blocks is None:
        blocks = block_count(prints.count(), radius)
    masks = block_masks(blocks, radius)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("set"), F.col("fp").bitwiseAND(F.lit(m)).alias("block"))
                               for i, m in enumerate(masks)]))
    dealt = prints.select("fp", keys.alias("k")).select("k.set", "k.block", "fp")
    dealt = dealt.repartition("set", "block").sortWithinPartitions("set", "block", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets, shared, fps in _whole_groups(batches):
            yield _as_links(_linked(sets, shared, fps, radius))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int = 2) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of sorted batches, cut where the first ones, the `keys`, change."""
    rest: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        now = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if rest is not None:
            now = tuple(np.concatenate(pair) for pair in zip(rest, now, strict=True))
        if len(now[0]):
            cut = int(np.argmax(np.logical_and.reduce([column == column[-1] for column in now[:keys]])))
            rest = tuple(column[cut:] for column in now)
            if cut:
                yield tuple(column[:cut] for column in now)
    if rest is not None:
        yield rest


def _as_links(pairs: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in pairs], names=["a", "b"])


def _linked(sets: np.ndarray, blocks: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    prints = prints.astype(np.int64).view(np.uint64)
    if len(prints) < 2:
        return prints[:0], prints[:0]
    new = np.flatnonzero((sets[1:] != sets[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    starts = np.concatenate([[0], new])
    sizes = np.diff(np.concatenate([starts, [len(prints)]]))
    run = np.repeat(np.arange(len(starts)), sizes)
    short = np.repeat(sizes <= _SHORT, sizes)
    left, right = [], []
    for step in range(1, min(_SHORT, int(sizes.max()))):
        near = (run[step:] == run[:-step]) & short[step:]
        near &= np.bitwise_count(prints[step:] ^ prints[:-step]) <= radius
        at = np.flatnonzero(near)
        left.append(prints[at])
        right.append(prints[at + step])
    for start, size in zip(starts[sizes > _SHORT], sizes[sizes > _SHORT], strict=True):
        a, b = _grown(prints[start : start + size], radius)
        left.append(a)
        right.append(b)
    return np.concatenate([prints[:0], *left]), np.concatenate([prints[:0], *right])


def _grown(group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold the clusters of one large group together.

    A cluster grows from a member to all that are near it, and on from those; what has joined a cluster is not
    compared again, so a dense cluster costs a few passes over the group.
    """
    left, right = [group[:0]], [group[:0]]
    waiting = group
    frontier: list[int] = []
    while len(waiting):
        if not frontier:
            frontier, waiting = [waiting[0]], waiting[1:]
        here = frontier.pop()
        near = np.bitwise_count(waiting ^ here) <= radius
        joined = waiting[near]
        if len(joined):
            left.append(np.full(len(joined), here, np.uint64))
            right.append(joined)
            frontier.extend(joined)
            waiting = waiting[~near]
    return np.concatenate(left), np.concatenate(right)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """`id, fp, component_id` for every row: the smallest key that links of at most `radius` bits reach.

    Null keys never name a component that has another key.  An empty table gives an empty one.
    """
    prints = stored(fingerprints(docs, key, text, shingle), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("low"))
    roots = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stored(rooted, "rooted")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates the row of the smallest doc_id stays.

    Groups are those of `near_duplicates`: fingerprints of four-word shingles, linked at four or fewer differing bits.
    Texts without a word are one group.  A null doc_id comes after all others; rows that repeat the kept one are told
    apart by their order in the table as stored, so one of them stays.  All columns stay as they are, whatever their
    names; an empty table gives an empty one.
    """
    row = unused("_row", docs.columns)
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered, row, "text").select("id", "component_id")
    keyed = stored(found.join(numbered.select(F.col(row).alias("id"), F.col("doc_id")), "id"), "grouped")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("id"))
    kept = keyed.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.id").alias("id"))
    others = stored(keyed.join(kept, "id", "left_anti").select(F.col("id").alias(row)), "others")
    return numbered.join(others, row, "left_anti").select(*docs.columns)
