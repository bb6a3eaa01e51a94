"""Benchmark decontamination by spaced seeds: masks that ignore some token positions, then verified overlaps."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import cached, stored, table, unused

# Fixed masks: 1 counts, 0 is ignored.  Wherever a fifth of 16 or more tokens in line is substituted, one of MASKS still
# fits somewhere; SHORT_MASKS do the same for items of 8 to 15 tokens whose first and last token are equal.  A stretch
# of 32 tokens or more has a half that agrees as well as itself, so stretches up to 31 are all that tests enumerate.
MASKS = ("11101111", "111010001011", "11000110111", "11011010000101", "1100101111")
SHORT_MASKS = ("111011", "11001011", "11111")
_EVERY = MASKS + SHORT_MASKS
# Shifts of a seed hash that give its bits in the filter.
PROBES = (0, 20, 39)


@dataclass(frozen=True)
class Settings:
    """least: tokens in an overlap; agree: share of them that are equal; bits: positions of the seed filter.

    An item of fewer tokens than `least` is matched from its first to its last token, of which the share `agree` is
    equal, if it has at least `shortest` tokens, and never below.
    """

    least: int = 16
    agree: float = 0.8
    shortest: int = 8
    bits: int = 1 << 24


_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SALTS = [(0xA24BAED4963EE407 * (2 * i + 3)) & (1 << 64) - 1 | 1 for i in range(64)]


def _inverse(value: int) -> int:
    return pow(value, -1, 1 << 64)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept by the worker and made longer when a longer batch comes."""
    held: dict = cached("powers", dict)
    if len(held.get("up", ())) < size:
        length = 1 << max(21, size.bit_length())
        for name, base in (("up", int(_BASE)), ("down", _inverse(int(_BASE)))):
            factors = np.full(length, np.uint64(base))
            factors[0] = 1
            held[name] = np.multiply.accumulate(factors)
    return held["up"], held["down"]


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Bytes in lower case, and which of them belong to a token: letters, digits and all of non-ASCII."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.zeros(256, bool)
    inside[48:58] = inside[97:123] = inside[65:91] = inside[128:] = True
    return lower, inside


def token_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the tokens of UTF-8 bytes: runs of letters and digits, A-Z in lower case."""
    lower, inside = cached("classes", _classes)
    member = np.concatenate([[False], inside[data], [False]])
    turns = np.flatnonzero(member[1:] != member[:-1])
    starts, ends = turns[::2], turns[1::2]
    up, down = _powers(len(data) + 1)
    weighted = (lower[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted, dtype=np.uint64)])
    hashes = (total[ends] - total[starts]) * down[starts]
    hashes ^= hashes >> np.uint64(31)
    hashes *= _MIX
    return hashes ^ hashes >> np.uint64(29), starts


def seed_hashes(tokens: np.ndarray, mask: int) -> np.ndarray:
    """One hash for every place where the mask fits; it takes no notice of the ignored positions.

    The masks for short items are numbered on from those for long ones.
    """
    places = [i for i, c in enumerate(_EVERY[mask]) if c == "1"]
    return _mixed_sum(tokens, places, mask)


def _mixed_sum(tokens: np.ndarray, places: list[int], salt: int) -> np.ndarray:
    count = len(tokens) - places[-1]
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(count, np.uint64((salt + 1) * int(_MIX) & (1 << 64) - 1))
    for place in places:
        total += tokens[place : place + count] * np.uint64(_SALTS[place])
    total ^= total >> np.uint64(32)
    total *= _BASE
    return total ^ total >> np.uint64(29)


def _seeds_of(tokens: np.ndarray, settings: Settings) -> list[tuple[int, np.ndarray]]:
    """(mask, hash at every place) of an item, by the masks for its length."""
    if len(tokens) < settings.shortest:
        return []
    masks = range(len(MASKS)) if len(tokens) >= settings.least else range(len(MASKS), len(_EVERY))
    return [(m, seed_hashes(tokens, m)) for m in masks]


def benchmark_seeds(items: DataFrame, settings: Settings, key: str = "item_id", text: str = "text") -> DataFrame:
    """`kind, seed, item, version, at, tokens` for every seed of the items.

    `version` tells items of one key and different texts apart; `tokens`, on the row of place 0, are the token hashes.
    """

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {"kind": [], "seed": [], "item": [], "version": [], "at": [], "tokens": []}
            for item, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens, _ = token_hashes(np.frombuffer(value.as_py() or b"", np.uint8))
                for kind, seeds in _seeds_of(tokens, settings):
                    for at, seed in enumerate(seeds.view(np.int64).tolist()):
                        out["kind"].append(kind)
                        out["seed"].append(seed)
                        out["item"].append(item)
                        out["version"].append(zlib.crc32(tokens.tobytes()))
                        out["at"].append(at)
                        out["tokens"].append(None if at else tokens.tobytes())
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out)
            )

    slim = items.select(F.col(key).cast("long"), F.col(text).cast("binary"))
    return slim.mapInArrow(run, "kind int, seed long, item long, version long, at int, tokens binary")


def _probes(seed: Column, bits: int) -> list[Column]:
    return [F.shiftrightunsigned(seed, shift).bitwiseAND(F.lit(bits - 1)) for shift in PROBES]


def seed_filter(seeds: DataFrame, bits: int) -> bytes:
    """Three bits for each seed hash, in a fixed number of bits: any number of items gives a filter of this size."""
    places = seeds.select(F.explode(F.array(*_probes(F.col("seed"), bits))).alias("bit"))
    words = places.groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("mask")
    )
    filled = np.zeros(bits // 64, np.int64)
    rows = words.toArrow()  # at most bits/64 rows
    filled[rows.column("word").to_numpy()] = rows.column("mask").to_numpy()
    return filled.tobytes()


_LONGEST = max(map(len, _EVERY))

# Bytes of texts hashed at once; a longer text is hashed alone.
_CHUNK = 1 << 20


def training_regions(docs: DataFrame, passing: bytes, kinds: list[int], context: int, key: str, text: str) -> DataFrame:
    """`doc, start, tokens, kinds, seeds, ats`: the parts of `docs` in which a seed passes the filter.

    `tokens` are the hashes of the tokens from number `start` on: the places of the hits and `context` tokens on each
    side; hits that are nearer to each other share a part.  `kinds`, `seeds` and `ats` list its hits.
    """
    shared = docs.sparkSession.sparkContext.broadcast(passing)  # of fixed size
    fields = "doc long, start int, tokens binary, kinds array<int>, seeds array<long>, ats array<int>"

    def run(batches):
        bitset = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = batch.column(1)
            start = 0
            while start < len(keys):
                end, held, parts = start, 0, []
                while end < len(keys) and (end == start or held <= _CHUNK):
                    parts.append(texts[end].as_py() or b"")
                    held += len(parts[-1])
                    end += 1
                yield _regions(keys[start:end], parts, bitset, kinds, context)
                start = end

    slim = docs.select(F.col(key).cast("long"), F.col(text).cast("binary"))
    return slim.mapInArrow(run, fields)


def _regions(keys: list, parts: list[bytes], bitset: np.ndarray, kinds: list[int], context: int) -> pa.RecordBatch:
    tokens, starts = token_hashes(np.frombuffer(b"\n".join(parts), np.uint8))
    bounds = np.cumsum([len(p) + 1 for p in parts])
    owner = np.searchsorted(bounds, starts, side="right")
    first = np.searchsorted(owner, np.arange(len(parts)), side="left")
    last = np.searchsorted(owner, np.arange(len(parts)), side="right")
    hits: list[tuple[int, int, int]] = []
    for kind in kinds:
        length = len(_EVERY[kind])
        seeds = seed_hashes(tokens, kind)
        left = np.flatnonzero(owner[: len(seeds)] == owner[length - 1 : length - 1 + len(seeds)]) if len(seeds) else seeds
        for shift in PROBES:
            bit = seeds[left] >> np.uint64(shift) & np.uint64(len(bitset) * 8 - 1)
            byte = bitset[(bit >> np.uint64(3)).astype(np.int64)]
            left = left[(byte >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
        hits += zip(left.tolist(), [kind] * len(left), seeds[left].view(np.int64).tolist(), strict=True)
    hits.sort()
    out: dict[str, list] = {name: [] for name in ("doc", "start", "tokens", "kinds", "seeds", "ats")}
    at = 0
    while at < len(hits):
        row = owner[hits[at][0]]
        low = max(first[row], hits[at][0] - context)
        end = at + 1
        while end < len(hits) and owner[hits[end][0]] == row and hits[end][0] - hits[end - 1][0] <= context:
            end += 1
        high = min(last[row], hits[end - 1][0] + _LONGEST + context)
        out["doc"].append(keys[row])
        out["start"].append(int(low - first[row]))
        out["tokens"].append(tokens[low:high].tobytes())
        out["kinds"].append([k for _, k, _ in hits[at:end]])
        out["seeds"].append([s for _, _, s in hits[at:end]])
        out["ats"].append([int(p - first[row]) for p, _, _ in hits[at:end]])
        at = end
    types = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))


# Tokens of context that a hit carries; longer overlaps are put together from several hits.
CONTEXT = 48


def overlap(doc: np.ndarray, item: np.ndarray, settings: Settings) -> tuple[int, int, int]:
    """First, end and equal tokens of the longest stretch of two aligned token runs in which enough agree.

    Tokens that differ at its ends are trimmed.
    """
    same = doc == item
    i, j = _longest(same, settings)
    while i < j and not same[i]:
        i += 1
    while j > i and not same[j - 1]:
        j -= 1
    return i, j, int(same[i:j].sum())


def _longest(same: np.ndarray, settings: Settings) -> tuple[int, int]:
    """First and end of the longest stretch in which enough agree.

    Equal tokens count 1 - agree, others -agree: a stretch with a sum of zero or more agrees in that share.
    """
    sums = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - settings.agree, -settings.agree))])
    # The longest i < j with sums[i] <= sums[j].
    low = np.minimum.accumulate(sums)
    high = np.maximum.accumulate(sums[::-1])[::-1]
    best, i, j = (0, 0), 0, 0
    n = len(sums)
    while j < n and i < n:
        if low[i] <= high[j] + 1e-9:
            if j - i > best[1] - best[0]:
                best = (i, j)
            j += 1
        else:
            i += 1
    return best


def _verify(rows, settings: Settings):
    for batch in rows:
        data = batch.to_pydict()
        out: dict[str, list] = {"doc": [], "item": [], "hits": [], "first": [], "end": [], "equal": []}
        for doc, item, hits, shift, start, around, known in zip(
            *(data[c] for c in ("doc", "item", "hits", "shift", "start", "around", "known")), strict=True
        ):
            theirs, ours = np.frombuffer(known, np.uint64), np.frombuffer(around, np.uint64)
            # The item's token 0 lies at token `shift` of the text.
            low, high = max(shift, start), min(shift + len(theirs), start + len(ours))
            own, its = ours[low - start : high - start], theirs[low - shift : high - shift]
            first, end, equal = overlap(own, its, settings)
            i, j = (first, end) if len(theirs) < settings.least else _longest(own == its, settings)
            if j - i >= min(settings.least, len(theirs)):
                for name, value in zip(out, (doc, item, hits, low + first, low + end, equal), strict=True):
                    out[name].append(value)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))


def contaminated(
    docs: DataFrame, items: DataFrame, settings: Settings = Settings(), key: str = "doc_id", item_key: str = "item_id"
) -> DataFrame:
    """`doc, item, n_hits, first, end, equal`: texts that hold a passage of a benchmark item, a row for each pair.

    A pair needs a stretch of at least `least` tokens (or a shorter item from its first to its last token) on one
    diagonal in which the share `agree` of tokens is equal.  `first` and `end` bound its verified stretches in the text, in tokens; `equal`
    is the most equal tokens in one of them.  Null or empty texts and items have no tokens; repeated rows count
    as one.  Texts are only looked at where a seed passes a filter of fixed size; the seeds there are joined with
    those of the items, and what meets on one diagonal is compared token by token.
    """
    seeds = benchmark_seeds(items, settings, item_key).dropDuplicates(["kind", "seed", "item", "version", "at"])
    seeds = stored(seeds, "seeds")
    passing = seed_filter(seeds, settings.bits)
    kinds = sorted(r[0] for r in seeds.select("kind").distinct().collect())  # of the masks
    regions = training_regions(docs, passing, kinds, CONTEXT, key, "text")
    regions = stored(regions.withColumn("region", F.monotonically_increasing_id()), "regions")
    hits = regions.select("region", F.explode(F.arrays_zip("kinds", "seeds", "ats")).alias("h")).select(
        "region", F.col("h.kinds").alias("kind"), F.col("h.seeds").alias("seed"), F.col("h.ats").alias("spot")
    )
    met = hits.join(seeds.select("kind", "seed", "item", "at", "version"), ["kind", "seed"])
    met = met.groupBy("region", "item", "version", (F.col("spot") - F.col("at")).alias("shift")).agg(F.count("*").alias("hits"))
    known = seeds.filter("at = 0").select("item", "version", F.col("tokens").alias("known"))
    pairs = met.join(regions.select("region", "doc", "start", F.col("tokens").alias("around")), "region")
    pairs = pairs.join(known.distinct(), ["item", "version"])
    fields = "doc long, item long, hits long, first int, end int, equal int"
    slim = pairs.select("doc", "item", "hits", "shift", "start", "around", "known")
    found = slim.mapInArrow(lambda rows: _verify(rows, settings), fields)
    return found.groupBy("doc", "item").agg(
        F.sum("hits").alias("n_hits"), F.min("first").alias("first"), F.max("end").alias("end"), F.max("equal").alias("equal")
    )


def op10_benchmark_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_hits", F.col("first").alias("first_token"),
        F.col("end").alias("end_token"), F.col("equal").alias("equal_tokens"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pipeline stage: rows whose text holds a passage of the benchmark go, whatever their key, and no others.

    Texts are told apart by a 64-bit hash, so rows that repeat a key, or have none, are judged by their own text.  The
    hashes found are written first: Spark knows their size, and moves texts only if they are too many for every task.
    """
    key = unused("_text_hash", docs.columns)
    texts = docs.select(F.xxhash64("text").alias(key), "text")
    found = stored(contaminated(texts, items, key=key).select(F.col("doc").alias(key)).distinct(), "contaminated")
    return docs.withColumn(key, F.xxhash64("text")).join(found, key, "left_anti").select(*docs.columns)
