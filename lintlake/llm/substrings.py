"""Removal of long repeated substrings: texts that share one meet in a bucket, whose suffixes are sorted."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import key_bits, key_filter, stored, table
from lintlake.llm.suffixes import SuffixBlocks, same_start

LENGTH = 50
# Bytes of a seed: every string of LENGTH bytes goes where its seed of the least hash sends it.
SEED = 16

# Bytes of texts cut at once, of fragments in a bucket, and suffixes in a block.
_CHUNK = 1 << 21
_BUCKET = 16 << 20
_BLOCK = 1 << 20

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_LAST = (1 << 63) - 1


def _seed_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the SEED bytes from each byte on, where as many follow."""
    count = len(data) - SEED + 1
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    found = eight[:count] * _A
    found ^= found >> np.uint64(32)
    found += eight[8 : count + 8] * _B
    found ^= found >> np.uint64(29)
    found *= _C
    return found ^ found >> np.uint64(32)


def _least(hashes: np.ndarray, width: int) -> np.ndarray:
    """The least of `width` hashes from each on."""
    span = 1
    while span * 2 <= width:
        hashes = np.minimum(hashes[:-span], hashes[span:])
        span *= 2
    rest = width - span
    return np.minimum(hashes[:-rest], hashes[rest:]) if rest else hashes


def fragments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and seed of the fragments of texts that end at `ends`: runs of LENGTH-byte strings of one seed.

    A fragment has all bytes of its strings, so neighbours overlap; every string is in one of them.
    """
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    seed = _least(_seed_hashes(data), LENGTH - SEED + 1)
    inside = np.ones(len(seed), bool)
    for end in ends.tolist():
        inside[max(0, end - LENGTH + 1) : end] = False
    change = np.concatenate([[True], (seed[1:] != seed[:-1]) | (inside[1:] != inside[:-1])])
    start = np.flatnonzero(change & inside)
    stop = np.append(np.flatnonzero(change), len(seed))
    stop = stop[np.searchsorted(stop, start, side="right")]
    return start, stop - start + LENGTH - 1, seed[start]


def _slices(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of the fragments one after another."""
    first = np.cumsum(length) - length
    return data[np.arange(int(length.sum())) + np.repeat(start - first, length)]


def _packed(compress, *arrays: np.ndarray) -> bytes:
    parts = [compress(np.ascontiguousarray(a).tobytes()) for a in arrays]
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def _unpacked(expand, blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(kinds))
    at, out = 8 * len(kinds), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(expand(blob[at : at + size]), kind))
        at += size
    return out


_KINDS = ["<u1", "<u4", "<i8", "<i8", "<u4", "<u4"]


def _dealt(keys: np.ndarray, tags: np.ndarray, texts: list[bytes], offsets: np.ndarray, buckets: int):
    """(bucket, blob) of the fragments of some texts; (-1, blob) of strings that an earlier one of these texts has.

    Of fragments with the same bytes only those of the smallest key are dealt: the others are repeats already.
    """
    compress = zstandard.ZstdCompressor(level=6).compress
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    start, length, seed = fragments(data, ends)
    if not len(start):
        return
    owner = np.searchsorted(ends, start, side="right")
    place = start - (ends - sizes)[owner] + offsets[owner]
    keep = np.ones(len(start), bool)
    order = np.lexsort((keys[owner], seed))
    twin = np.flatnonzero(seed[order][1:] == seed[order][:-1])
    first: dict[bytes, int] = {}
    for i in order[np.unique(np.concatenate([twin, twin + 1]))].tolist():
        key = keys[owner[i]]
        keep[i] = first.setdefault(data[start[i] : start[i] + length[i]].tobytes(), key) >= key
    gone = np.flatnonzero(~keep)
    if len(gone):
        yield -1, _packed(compress, np.zeros(0, np.uint8), length[gone].astype("<u4"), keys[owner[gone]], tags[owner[gone]],
                          np.zeros(0, "<u4"), place[gone].astype("<u4"))
    kept = np.flatnonzero(keep)
    bucket = ((seed[kept] * _A >> np.uint64(11)) % np.uint64(buckets)).astype(np.int64)
    kept = kept[np.argsort(bucket, kind="stable")]
    counts = np.bincount(bucket, minlength=buckets)
    for number, group in zip(np.flatnonzero(counts), np.split(kept, np.cumsum(counts[counts > 0])[:-1]), strict=True):
        rows, row = np.unique(owner[group], return_inverse=True)
        yield int(number), _packed(
            compress, _slices(data, start[group], length[group]), length[group].astype("<u4"), keys[rows], tags[rows],
            row.astype("<u4"), place[group].astype("<u4"),
        )


def _segments(batches: Iterator[pa.RecordBatch]):
    """Texts in groups of bounded size: whole ones, and long ones in parts that overlap by one string less a byte."""
    held: list[tuple[int, int, bytes, int]] = []
    size = 0
    for batch in batches:
        keys, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for key, tag, text in zip(keys, tags, batch.column(2), strict=True):
            text = text.as_py() or b""
            key = _LAST if key is None else key
            for offset in range(0, max(1, len(text) - LENGTH + 1), _CHUNK):
                part = text[offset : offset + _CHUNK + LENGTH - 1]
                if size + len(part) > _CHUNK and held:
                    yield held
                    held, size = [], 0
                held.append((key, tag, part, offset))
                size += len(part)
    if held:
        yield held


def dealt(docs: DataFrame, buckets: int) -> DataFrame:
    """`bucket, blob`: the fragments of all texts, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _segments(batches):
            keys, tags, texts, offsets = zip(*held, strict=True)
            rows = list(_dealt(np.array(keys, np.int64), np.array(tags, np.int64), list(texts), np.array(offsets), buckets))
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "blob"]
            )

    return docs.mapInArrow(run, "bucket int, blob binary")


def _repeats(data: np.ndarray, length: np.ndarray, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Fragment, first byte and end of the parts that are in a fragment of a smaller key.

    A fragment's seed is looked up again; fragments of a seed that only one key has are left out.  Of equal
    fragments one enters the suffix sort, with the smallest key, and stands for all of that key; those of other
    keys are repeats as a whole.
    """
    first = np.cumsum(length) - length
    seed = np.empty(len(first), np.uint64)
    for at in range(0, len(first), 1 << 14):
        some = first[at : at + (1 << 14)]
        window = data[(some[:, None] + np.arange(LENGTH)).ravel()]
        hashes = _seed_hashes(window)
        places = (np.arange(len(some)) * LENGTH)[:, None] + np.arange(LENGTH - SEED + 1)
        seed[at : at + (1 << 14)] = hashes[places].min(axis=1)
    order = np.argsort(seed, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], seed[order][1:] != seed[order][:-1]]))
    low = np.minimum.reduceat(key[order], new)
    high = np.maximum.reduceat(key[order], new)
    shared = order[np.repeat(low != high, np.diff(np.append(new, len(order))))]
    if not len(shared):
        return
    number: dict[bytes, int] = {}
    of = np.empty(len(shared), np.int64)
    for i, (a, n) in enumerate(zip(first[shared].tolist(), length[shared].tolist(), strict=True)):
        of[i] = number.setdefault(data[a : a + n].tobytes(), len(number))
    least = np.full(len(number), _LAST, np.int64)
    np.minimum.at(least, of, key[shared])
    copies = key[shared] > least[of]
    yield shared[copies], np.zeros(int(copies.sum()), np.int64), length[shared[copies]]
    members, of = shared[~copies], of[~copies]
    unique = np.empty(len(number), np.int64)
    unique[of] = members
    size = length[unique]
    text = _slices(data, first[unique], size)
    begin = np.cumsum(size) - size
    strings = size - LENGTH + 1
    starts = np.arange(int(strings.sum())) + np.repeat(begin - (np.cumsum(strings) - strings), strings)
    owner = np.repeat(np.arange(len(unique)), strings)
    of_byte = np.zeros(len(text), np.int32)
    of_byte[starts] = owner
    marked = np.zeros(len(text), bool)
    sort = SuffixBlocks(text)
    for ordered in sort.blocks(starts, _BLOCK):
        same = same_start(sort, ordered, LENGTH)
        heads = np.flatnonzero(~same)
        keys = least[of_byte[ordered]]
        smallest = np.repeat(np.minimum.reduceat(keys, heads), np.diff(np.append(heads, len(ordered))))
        marked[ordered[keys > smallest]] = True
    at = np.flatnonzero(marked)
    if not len(at):
        return
    apart = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(of_byte[at]) != 0)])
    run_first = at[apart]
    run_last = at[np.append(np.flatnonzero(apart)[1:] - 1, len(at) - 1)]
    fragment = of_byte[run_first]
    a, b = run_first - begin[fragment], run_last - begin[fragment] + LENGTH
    # The runs of a fragment hold for all members that have its bytes.
    by = np.argsort(fragment, kind="stable")
    left = np.searchsorted(fragment[by], of, side="left")
    count = np.searchsorted(fragment[by], of, side="right") - left
    which = by[np.arange(int(count.sum())) + np.repeat(left - (np.cumsum(count) - count), count)]
    yield np.repeat(members, count), a[which], b[which]


def _marks(batches: list[bytes], local: bool) -> pa.RecordBatch:
    expand = zstandard.ZstdDecompressor().decompress
    read = [_unpacked(expand, blob, _KINDS) for blob in batches]
    if local:
        key, tag = (np.concatenate([r[i] for r in read]) for i in (2, 3))
        length, place = (np.concatenate([r[i] for r in read]).astype(np.int64) for i in (1, 5))
        spans = [(np.arange(len(key)), np.zeros(len(key), np.int64), length)]
    else:
        data, length, place = (np.concatenate([r[i] for r in read]) for i in (0, 1, 5))
        length, place = length.astype(np.int64), place.astype(np.int64)
        key, tag = (np.concatenate([r[i][r[4]] for r in read]) for i in (2, 3))
        spans = list(_repeats(data, length, key))
    fragment, a, b = (np.concatenate([np.zeros(0, np.int64), *[s[i] for s in spans]]) for i in range(3))
    key, tag, begin, end = key[fragment], tag[fragment], place[fragment] + a, place[fragment] + b
    order = np.lexsort((begin, tag, key))
    key, tag, both = key[order], tag[order], np.stack([begin[order], end[order]], axis=1).astype("<u4")
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])])) if len(key) else order
    cuts = np.append(new, len(key)).tolist()
    blobs = [both[p:q].tobytes() for p, q in zip(cuts, cuts[1:], strict=False)]
    return pa.RecordBatch.from_arrays(
        [pa.array(key[new]), pa.array(tag[new]), pa.array(blobs, pa.binary())], names=["key", "tag", "spans"]
    )


def repeats(docs: DataFrame) -> DataFrame:
    """`key, tag, spans`: first byte and end (pairs of 32-bit numbers) of repeated strings, several rows for a text.

    `docs` has `key` (long), `tag` (of the text, for rows that repeat a key) and `text` (binary).  A string of LENGTH
    bytes is a repeat if a text of a smaller key has it.  A null key is greater than all others.
    """
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    # Fragments are four times the texts, neighbours overlapping.
    buckets = max(8, -(-4 * total // _BUCKET))

    def run(group: pa.Table) -> pa.Table:
        blobs = group.column("blob").to_pylist()
        return pa.Table.from_batches([_marks(blobs, group.column("bucket")[0].as_py() < 0)])

    # What a chunk has found alone needs no bucket of its own; it goes to as many as there are others.
    pieces = dealt(docs, buckets)
    lot = F.pmod(F.xxhash64("blob"), F.lit(buckets)).cast("int")
    pieces = pieces.withColumn("bucket", F.when(F.col("bucket") < 0, -1 - lot).otherwise(F.col("bucket")))
    return pieces.groupBy("bucket").applyInArrow(run, "key long, tag long, spans binary")


def _merged(spans: list[bytes]) -> np.ndarray:
    """The union of spans, in order, as rows of first byte and end; spans that touch are one."""
    pairs = np.frombuffer(b"".join(spans), "<u4").reshape(-1, 2).astype(np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(pairs) - 1)
    return np.stack([pairs[new, 0], reach[last]], axis=1)


def _marked_texts(docs: DataFrame, bits: bytes) -> DataFrame:
    """`key, tag, packed`: compressed texts whose key may be in the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        held = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little")
        for batch in batches:
            hit = held[batch.column(3).to_numpy()] & held[batch.column(4).to_numpy()]
            batch = batch.filter(pa.array(hit.astype(bool)))
            packed = [compress(x.as_py() or b"") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary())], names=["key", "tag", "packed"])

    return docs.select("key", "tag", "text", *key_bits(["key", "tag"])).mapInArrow(run, "key long, tag long, packed binary")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        removed, runs, digests = [], [], []
        for packed, spans in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
            text = expand(packed.as_py())
            pairs = _merged(spans)
            kept, at = hashlib.sha256(), 0
            for a, b in pairs.tolist():
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            removed.append(int((pairs[:, 1] - pairs[:, 0]).sum()))
            runs.append(len(pairs))
            digests.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())],
            names=["key", "tag", "n_removed", "n_spans", "digest"],
        )


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key, n_bytes, n_removed, n_spans, kept_sha256` for every row: what is left without repeated strings.

    A byte goes if a string of LENGTH bytes over it is also in a text of a smaller key.  A null text is empty; a null
    key is greater than all others.  Rows of equal keys are not repeats of each other, and rows of equal key and text
    have equal results.
    """
    value = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.crc32(value).alias("tag"), value.alias("text"))
    rows = rows.withColumn("key", F.coalesce("key", F.lit(_LAST)))
    found = stored(repeats(rows), "repeats")
    spans = found.groupBy("key", "tag").agg(F.collect_list("spans").alias("spans"))
    texts = _marked_texts(rows, key_filter(found, ["key", "tag"])).dropDuplicates(["key", "tag"])
    joined = texts.join(spans, ["key", "tag"]).select("key", "tag", "packed", "spans")
    cut = joined.mapInArrow(_cut, "key long, tag long, n_removed long, n_spans long, digest string")
    whole = rows.select("key", "tag", F.length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    every = whole.join(cut, ["key", "tag"], "left")
    return every.select(
        F.when(F.col("key") != _LAST, F.col("key")).alias(key), "n_bytes",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_spans")],
        F.coalesce("digest", "sha").alias("kept_sha256"),
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
