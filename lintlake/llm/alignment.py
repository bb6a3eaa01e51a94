"""Alignment of two tokenizers: byte offsets where tokens of both end, and the tokens that overlap between them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import cached, stored, table
from lintlake.llm.tokencounts import byte_signs
from lintlake.llm.wordids import ranges, vocabulary_path

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"

# A blank behind anything but white space begins a segment: no token of either kind reaches across.
_CUT = re.compile(r"(?<=\S) ")
# Segments a worker remembers before it starts anew, and the longest one that it does; characters aligned at once.
_KEPT = 400_000
_LONG = 256
_CHUNK = 1 << 19

# The commonest pairs, whose counts every worker holds; the others are joined.
_HEAD = 1 << 18


class Encoder:
    """Ids of both tokenizers for segments of a text, each with a blank before it.

    A segment whose tokens do not spell it in one of them is not `sound`, nor is its text.
    """

    def __init__(self, first: str, second: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.bytewise = Tokenizer.from_file(first)
        self.bytewise.encode_special_tokens = True
        self.pieces = SentencePieceProcessor(model_file=second)
        self.blank = self.pieces.piece_to_id("▁")
        signs = {sign: b for b, sign in enumerate(byte_signs())}
        entries = self.bytewise.get_vocab(with_added_tokens=False)
        self.spelled_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.spelled_a[i] = bytes(signs[c] for c in entry)
        self.spelled_b = [self._spelling(i) for i in range(self.pieces.get_piece_size())]
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.spelled_a, self.spelled_b))
        self._reset()

    def _spelling(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.sound = np.zeros(0, bool)
        # The ids of all known segments, one after another, and where those of each begin; of both kinds.
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.first = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def encode(self, segments: list[list[str]]) -> list[np.ndarray]:
        """The numbers of all segments of all texts, good until the next call."""
        if len(self.number) > _KEPT or sum(map(len, self.ids)) > 16 * _KEPT:
            self._reset()
        new = list(set(chain.from_iterable(segments)).difference(self.number))
        if new:
            self._learn(new)
        found = [np.fromiter(map(self.number.__getitem__, some), np.int64, len(some)) for some in segments]
        for segment in new:
            if len(segment) > _LONG:
                del self.number[segment]
        return found

    def _learn(self, new: list[str]) -> None:
        count = len(self.sound)
        self.number.update(zip(new, range(count, count + len(new)), strict=True))
        a = [e.ids for e in self.bytewise.encode_batch_fast([" " + s for s in new], add_special_tokens=False)]
        b = [ids or [self.blank] for ids in self.pieces.encode(new, num_threads=1)]
        texts = [b" " + s.encode() for s in new]
        sound = np.ones(len(new), bool)
        for ids, spelled in ((a, self.spelled_a), (b, self.spelled_b)):
            same = [b"".join([spelled[i] for i in some]) == text for some, text in zip(ids, texts, strict=True)]
            sound &= np.array(same, bool)
        self.sound = np.concatenate([self.sound, sound])
        for kind, ids in enumerate((a, b)):
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
            self.first[kind] = np.concatenate([self.first[kind], self.first[kind][-1] + np.cumsum(sizes)])
            self.ids[kind] = np.concatenate([self.ids[kind], flat])

    def sizes(self, kind: int, numbers: np.ndarray) -> np.ndarray:
        return self.first[kind][numbers + 1] - self.first[kind][numbers]

    def tokens(self, kind: int, numbers: np.ndarray) -> np.ndarray:
        """The ids of segments, one after another."""
        return self.ids[kind][ranges(self.first[kind][numbers], self.sizes(kind, numbers))].astype(np.int64)


def gallop(short: np.ndarray, long: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For every value of `short` the number of smaller ones in `long`; both ascend.

    From its guess each search doubles its step until it has passed its value, then halves the bracket.  All go at the
    same time, and only those that are not done yet go on.
    """
    n = len(long)
    low, high = np.full(len(short), -1), np.full(len(short), n)  # long[low] < value <= long[high]
    if not n:
        return high
    here = np.clip(guess, 0, n - 1)
    below = long[here] < short
    low[below] = here[below]
    high[~below] = here[~below]
    for side, edge in ((np.flatnonzero(below), 1), (np.flatnonzero(~below), -1)):
        step = 1
        while len(side):
            at = (low[side] if edge > 0 else high[side]) + edge * step
            inside = (at < n) & (at >= 0)
            side, at = side[inside], at[inside]
            smaller = long[at] < short[side]
            low[side[smaller]] = at[smaller]
            high[side[~smaller]] = at[~smaller]
            side = side[smaller if edge > 0 else ~smaller]
            step *= 2
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        at = (low[open_] + high[open_]) // 2
        smaller = long[at] < short[open_]
        low[open_[smaller]] = at[smaller]
        high[open_[~smaller]] = at[~smaller]
        open_ = open_[high[open_] - low[open_] > 1]
    return high


def _placed(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, of_b: np.ndarray):
    """One list of ends per text, b's where `of_b` says so: all ends, their places in their own lists, the first of each text."""
    first = np.concatenate([[0], np.cumsum(np.where(of_b, np.diff(first_b), np.diff(first_a)))])
    ends, source = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    for every, begin, mine in ((ends_a, first_a, ~of_b), (ends_b, first_b, of_b)):
        text = np.repeat(np.arange(len(mine)), np.diff(begin))
        at = np.flatnonzero(mine[text])
        place = at - begin[text[at]] + first[text[at]]
        ends[place], source[place] = every[at], at
    return ends, source, first


def align(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Groups and links of texts that lie one after another, each ending with a token of both kinds.

    `ends_a`, `ends_b` are the ascending ends of all tokens, `first_a`, `first_b` the numbers of tokens before each
    text and, last, of all.  Returns the group of each a and of each b, and the a and the b of every overlapping pair.
    Of each text the shorter list of ends is searched for in the longer one.
    """
    turned = np.diff(first_b) < np.diff(first_a)
    short, of_short, first_short = _placed(ends_a, ends_b, first_a, first_b, turned)
    long, of_long, first_long = _placed(ends_a, ends_b, first_a, first_b, ~turned)
    text = np.repeat(np.arange(len(turned)), np.diff(first_short))
    # Where an end would be if both lists advanced evenly through their text.
    share = np.diff(first_long) / np.maximum(np.diff(first_short), 1)
    guess = first_long[text] + ((np.arange(len(short)) - first_short[text]) * share[text]).astype(np.int64)
    rank = gallop(short, long, guess)
    common = long[rank] == short
    # The common ends slice both lists.
    group_short = np.cumsum(common) - common
    ended = np.zeros(len(long) + 1, np.int64)
    ended[rank[common] + 1] = 1
    group_long = np.cumsum(ended)[: len(long)]
    # A token overlaps those of the other list from the one in which it begins to the one in which it ends.
    begin = np.concatenate([[0], (rank + common)[:-1]])
    count = rank - begin + 1
    link_short = np.repeat(np.arange(len(short)), count)
    link_long = np.arange(len(link_short)) - np.repeat(np.cumsum(count) - count - begin, count)
    flip = turned[text[link_short]]
    one, other = of_short[link_short], of_long[link_long]
    group_a, group_b = np.empty(len(ends_a), np.int64), np.empty(len(ends_b), np.int64)
    for group, source, of_b in ((group_short, of_short, turned[text]), (group_long, of_long, ~turned[np.repeat(np.arange(len(turned)), np.diff(first_long))])):
        group_a[source[~of_b]], group_b[source[of_b]] = group[~of_b], group[of_b]
    return group_a, group_b, np.where(flip, other, one), np.where(flip, one, other)


def _digits(size: int) -> np.ndarray:
    """The decimal digits of all numbers below `size`, zero bytes in front, and room for a sign behind."""
    width = len(str(max(size - 1, 0)))
    number = np.arange(size)[:, None] // 10 ** np.arange(width - 1, -1, -1)
    text = np.where((number > 0) | (np.arange(width) == width - 1), number % 10 + ord("0"), 0).astype(np.uint8)
    return np.concatenate([text, np.zeros((size, 1), np.uint8)], axis=1)


class Aligner:
    """Aligns chunks of whole texts or of parts of one."""

    def __init__(self, first: str, second: str):
        self.encoder = Encoder(first, second)
        self.pairs = len(self.encoder.spelled_b)
        self.digits = _digits(max(len(self.encoder.spelled_a), self.pairs))

    def align(self, parts: list[np.ndarray]) -> tuple[list[tuple[int, int, int, int]], list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
        """Of each part, the numbers of its segments: n_a, n_b, n_groups, n_links; the groups written out; its pairs and how often."""
        texts = len(parts)
        sizes = [[int(self.encoder.sizes(kind, part).sum()) for part in parts] for kind in (0, 1)]
        first_a, first_b = (np.concatenate([[0], np.cumsum(n, dtype=np.int64)]) for n in sizes)
        ids_a, ids_b = (self.encoder.tokens(kind, np.concatenate(parts)) for kind in (0, 1))
        ends_a, ends_b = np.cumsum(self.encoder.size_a[ids_a]), np.cumsum(self.encoder.size_b[ids_b])
        group_a, group_b, link_a, link_b = align(ends_a, ends_b, first_a, first_b)
        text_a = np.repeat(np.arange(texts), sizes[0])
        text_of_link = text_a[link_a]
        groups = np.diff(np.concatenate([[-1], group_a[first_a[1:] - 1]]))
        links = np.bincount(text_of_link, minlength=texts)
        numbers = list(zip(*sizes, groups.tolist(), links.tolist(), strict=True))
        written = self._written(ids_a, ids_b, group_a, group_b, first_a, first_b)
        # Keys of all pairs of ids, and on top of them the text.
        span = len(self.encoder.spelled_a) * self.pairs
        keys, times = np.unique(text_of_link * span + ids_a[link_a] * self.pairs + ids_b[link_b], return_counts=True)
        cuts = np.searchsorted(keys, np.arange(texts + 1) * span)
        pairs = [(keys[x:y] - i * span, times[x:y]) for i, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))]
        return numbers, written, pairs

    def _written(
        self, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray
    ) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3;` for each text, every group with a sign behind."""
        last_a, last_b = (np.diff(g, append=-1) != 0 for g in (group_a, group_b))
        before_b = np.searchsorted(group_b, group_a)  # tokens of b in earlier groups
        before_a = np.searchsorted(group_a, group_b, side="right")
        rows = np.empty((len(ids_a) + len(ids_b), self.digits.shape[1]), np.uint8)
        place_a, place_b = np.arange(len(ids_a)) + before_b, np.arange(len(ids_b)) + before_a
        rows[place_a], rows[place_b] = self.digits[ids_a], self.digits[ids_b]
        rows[place_a, -1] = np.where(last_a, ord("|"), ord(","))
        rows[place_b, -1] = np.where(last_b, ord(";"), ord(","))
        used = rows != 0
        ends = np.cumsum(np.concatenate([[0], used.sum(1)]))[first_a + first_b]
        text = rows[used].tobytes()
        return [text[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_FIELDS = "row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def aligned(docs: DataFrame, key: str, text: str, first: str, second: str) -> DataFrame:
    """`key, row, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times` for every row of `docs`."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = cached(f"aligner {first} {second}", lambda: Aligner(first, second))
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                end, chars, some = at, 0, []
                while end < batch.num_rows and (end == at or chars <= _CHUNK):
                    some.append(batch.column(1)[end].as_py() or "")
                    chars += len(some[-1])
                    end += 1
                columns = _document_columns(aligner, some)
                numbers = pa.array(np.arange(row + at, row + end))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), numbers, *columns],
                    names=[key, "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )
                at = end
            row += batch.num_rows

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, {_FIELDS}")


def _document_columns(aligner: Aligner, texts: list[str]) -> list[pa.Array]:
    numbers = np.zeros((len(texts), 4), np.int64)
    hashes: list = [None] * len(texts)
    pairs: list[list] = [[] for _ in texts]
    for owners, parts in _parts(aligner.encoder, texts):
        for owner, n, written, found in zip(owners, *aligner.align(parts), strict=True):
            numbers[owner] += n
            pairs[owner].append(found)
            if hashes[owner] is None:
                hashes[owner] = hashlib.sha256()
            else:
                hashes[owner].update(b";")
            hashes[owner].update(written[:-1])
    ends = pa.array(np.cumsum([0, *(sum(len(keys) for keys, _ in some) for some in pairs)]).astype(np.int32))
    keys = np.concatenate([np.zeros(0, np.int64), *(keys for some in pairs for keys, _ in some)])
    times = np.concatenate([np.zeros(0, np.int64), *(n for some in pairs for _, n in some)]).astype(np.int32)
    return [
        *(pa.array(numbers[:, k].copy()) for k in range(4)), pa.array(["" if h is None else h.hexdigest() for h in hashes], pa.string()),
        pa.ListArray.from_arrays(ends, pa.array(keys)), pa.ListArray.from_arrays(ends, pa.array(times)),
    ]


def _parts(encoder: Encoder, texts: list[str]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """The numbers of the segments of all texts that have tokens, very long texts in several parts."""
    found = encoder.encode([_CUT.split(t) if t else [] for t in texts])
    owners, parts = [], []
    for owner, segments in enumerate(found):
        if not len(segments) or not encoder.sound[segments].all():
            continue
        if len(texts[owner]) <= 2 * _CHUNK:
            owners.append(owner)
            parts.append(segments)
            continue
        tokens = np.cumsum(encoder.sizes(0, segments) + encoder.sizes(1, segments))
        for part in np.split(segments, np.flatnonzero(np.diff(tokens // _CHUNK)) + 1):
            yield [owner], [part]
    if parts:
        yield owners, parts


def alignments(
    docs: DataFrame, key: str = "doc_id", text: str = "text", first: str | None = None, second: str | None = None
) -> DataFrame:
    """`key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256` for every row.

    A text is encoded with a blank in front by a byte-level vocabulary (a) and a piece vocabulary (b); bytes at which
    tokens of both end cut it into groups, and tokens that share a byte are linked.  `count_sum` adds up how many links
    of all texts hold the ids of each link; `n_best` counts the links of which no other a is linked more often to the b.
    A null or empty text, and one that either vocabulary does not spell, has zeros and no hash.  Repeated rows and rows
    with a null key are aligned and counted each.

    Texts are tokenized once: the pairs of ids of each are stored with it.  The counts of the commonest pairs are held
    by every worker, a list of fixed length; the links of all others are joined with the counts.
    """
    first, second = first or vocabulary_path(FIRST), second or vocabulary_path(SECOND)
    found = stored(aligned(docs, key, text, first, second), "aligned")
    width = _pieces(second)
    counts = found.selectExpr("inline(arrays_zip(pairs, times))").groupBy("pairs").agg(F.sum("times").alias("n"))
    counts = stored(counts.withColumn("b", F.col("pairs") % width), "pair-counts")
    highest = counts.groupBy("b").agg(F.max("n").alias("high"))  # a row for each id at most
    counts = counts.join(F.broadcast(highest), "b").select("pairs", "n", (F.col("n") == F.col("high")).alias("best"))
    counts = stored(counts, "pair-bests")
    head = counts.orderBy(F.desc("n"), "pairs").limit(_HEAD).toArrow()
    summed = stored(_summed(found, head, key), "sums")
    rest = summed.selectExpr("row", "inline(rest)").join(counts, "pairs").groupBy("row")
    rest = rest.agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.col("times") * F.col("best").cast("int")).alias("bests"))
    every = summed.drop("rest").join(rest, "row", "left")
    return every.select(
        key, "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("bests", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256",
    )


def _pieces(path: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path).get_piece_size()


def _summed(found: DataFrame, head: pa.Table, key: str) -> DataFrame:
    """The sums over the links of common pairs, and the `rest` of the pairs."""
    pairs = head.column("pairs").to_numpy().astype(np.int64)
    order = np.argsort(pairs)
    columns = [pairs[order], head.column("n").to_numpy()[order].astype(np.int64), np.array(head.column("best").to_pylist(), bool)[order]]
    shared = found.sparkSession.sparkContext.broadcast(columns)  # of fixed length
    fixed = ["row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.select(key, *fixed).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy().astype(np.int64)
            keys = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            common = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            sums = [np.zeros(len(lists), np.int64) for _ in range(2)]
            np.add.at(sums[0], owner[common], times[common] * best[at[common]])
            np.add.at(sums[1], owner[common], times[common] * n[at[common]])
            ends = np.searchsorted(owner[~common], np.arange(len(lists) + 1)).astype(np.int32)
            rest = pa.StructArray.from_arrays([pa.array(keys[~common]), pa.array(times[~common])], names=["pairs", "times"])
            columns = [batch.column(name) for name in (key, *fixed)]
            yield pa.RecordBatch.from_arrays(
                [*columns, *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(ends), rest)],
                names=[key, *fixed, "n_best", "count_sum", "rest"],
            )

    schema = f"{kinds}, n_best long, count_sum long, rest array<struct<pairs: long, times: long>>"
    return found.mapInArrow(run, schema)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(table(spark, sf_dir, "documents"))
