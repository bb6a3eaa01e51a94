"""Ranked lexical search: posting lists with range-maximum tables, searched best-first by intervals of documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.llm.common import lower_ascii, stored, table

TOP = 50

# What is no part of a term, as bytes: all of ASCII but letters and digits.  The others are letters, A-Z in lower case.
_PARTS = bytes.maketrans(
    bytes(b for b in range(128) if not chr(b).isalnum()) + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b" " * (128 - 62) + b"abcdefghijklmnopqrstuvwxyz",
)
# The same for Spark's regular expressions.
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Postings that a worker indexes at once, and bytes of items that are searched for at once.
_POSTINGS = 1 << 20
_BLOCK = 1 << 24
# Rows that are taken up at once, and intervals that are split at once when a search has got going.
_ROWS = 256
_WIDTH = 4096


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, in order and with repeats."""
    return (text or b"").translate(_PARTS).split()


def weight(documents: int, df: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * df + 1)))


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """`item, terms`: the distinct terms of every item that has one; `item` is the key."""
    every = F.filter(F.split(lower_ascii(F.col(text)), _GAPS), lambda t: t != "")
    return items.select(F.col(key).alias("item"), F.array_distinct(every).alias("terms")).filter(F.size("terms") > 0)


def postings(docs: DataFrame, vocabulary: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc, n, terms, times` for every row with a term: how many terms it has, and which of the vocabulary how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows, sizes, found, times, ends = [], [], [], [], [0]
            for row, value in enumerate(batch.column(1)):
                words = terms(value.as_py())
                if words:
                    rows.append(row)
                    sizes.append(len(words))
                    held = Counter(filter(known.__contains__, words))
                    found.extend(map(known.__getitem__, held))
                    times.extend(held.values())
                    ends.append(len(found))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(found, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))],
                names=["doc", "n", "terms", "times"],
            )

    slim = docs.select(F.col(key).cast("long"), F.col(text).cast("binary"))
    return slim.mapInArrow(run, "doc long, n long, terms array<int>, times array<long>")


class Index:
    """Posting lists of some documents, one after another, with a table of range maxima over them.

    `best[k][i]` is the place of the greatest impact among the 2^k postings from `i` on.  A range of one list is
    covered by two such spans, so its maximum is two look-ups; a span that reaches into the next list is never asked
    for.  Documents are ordered by their most frequent term and length, so that an interval holds alike ones.
    """

    def __init__(self, docs: np.ma.MaskedArray, ends: np.ndarray, terms: np.ndarray, times: np.ndarray, m: np.ndarray, weights: np.ndarray):
        count = len(docs)
        owner = np.repeat(np.arange(count), np.diff(ends, prepend=0))
        by_times = np.lexsort((terms, -times, owner))
        first = by_times[np.searchsorted(owner[by_times], np.arange(count))] if len(owner) else np.zeros(0, np.int64)
        order = np.lexsort((m, terms[first])) if len(owner) else np.arange(count)
        place = np.empty(count, np.int64)
        place[order] = np.arange(count)
        self.docs = docs[order]
        self.span = count + 1
        owner = place[owner]
        sort = np.lexsort((owner, terms))
        self.at = owner[sort]
        self.keys = terms[sort].astype(np.int64) * self.span + self.at
        impact = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 20 * m[order][owner]))
        self.impact = impact[sort]
        self.starts = np.searchsorted(terms[sort], np.arange(len(weights) + 1))
        self.best = [np.arange(len(self.at), dtype=np.int32)]
        longest = int(np.diff(self.starts).max()) if len(self.at) else 0
        while 2 << (len(self.best) - 1) <= longest:
            half = 1 << (len(self.best) - 1)
            low, high = self.best[-1][:-half], self.best[-1][half:]
            self.best.append(np.where(self.impact[high] > self.impact[low], high, low))

    def maximum(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of the greatest impact in each range of postings [low, high), none of them empty."""
        found = np.empty(len(low), np.int64)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            some = np.flatnonzero(level == k)
            left, right = self.best[k][low[some]], self.best[k][high[some] - (1 << k)]
            found[some] = np.where(self.impact[right] > self.impact[left], right, left)
        return found

    def search(self, wanted: np.ndarray, top: Best) -> None:
        """Puts into `top` the documents with the highest sums of impacts of the wanted terms.

        An interval of documents is held as the ranges of the lists that have postings in it.  The sum of the range
        maxima bounds every score inside.  The best intervals are split at the document of their greatest impact:
        that one is scored, what lies left and right of it are new intervals.  Those whose bound does not reach the
        worst of the top go.
        """
        low, high = self.starts[wanted], self.starts[wanted + 1]
        held = np.flatnonzero(high > low)
        if not len(held):
            return
        term, low, high = wanted[held], low[held], high[held]
        peak = self.maximum(low, high)
        bound, size = np.array([self.impact[peak].sum()]), np.array([len(held)])
        width = 1
        while len(bound):
            # The best intervals of the front, ever more at a time; their ranges lie one after another.
            if len(bound) > width:
                chosen = np.zeros(len(bound), bool)
                chosen[np.argpartition(-bound, width - 1)[:width]] = True
            else:
                chosen = np.ones(len(bound), bool)
            mine = np.repeat(chosen, size)
            now = [x[mine] for x in (term, low, high, peak)]
            rest = [x[~mine] for x in (term, low, high, peak)]
            kept = [bound[~chosen], size[~chosen]]
            made = self._split(*now, size[chosen], top)
            least = top.least
            live = np.concatenate([kept[0], made[4]]) >= least
            size = np.concatenate([kept[1], made[5]])
            mine = np.repeat(live, size)
            term, low, high, peak = (np.concatenate([a, b])[mine] for a, b in zip(rest, made[:4], strict=True))
            bound, size = np.concatenate([kept[0], made[4]])[live], size[live]
            width = min(2 * width, _WIDTH)

    def _split(
        self, term: np.ndarray, low: np.ndarray, high: np.ndarray, peak: np.ndarray, size: np.ndarray, top: Best
    ) -> tuple[np.ndarray, ...]:
        """Splits intervals: `term, low, high, peak` of the new ones' ranges, their bounds and numbers of ranges."""
        starts = np.cumsum(size) - size
        own = np.repeat(np.arange(len(size)), size)
        value = self.impact[peak]
        greatest = np.maximum.reduceat(value, starts)
        hit = np.flatnonzero(value == greatest[own])
        hit = hit[np.unique(own[hit], return_index=True)[1]]
        split = self.at[peak[hit]]
        # Where the document is, or would be, in each range.
        found = np.searchsorted(self.keys, term * self.span + split[own])
        there = (found < high) & (self.at[np.minimum(found, len(self.at) - 1)] == split[own])
        score = np.add.reduceat(np.where(there, self.impact[np.minimum(found, len(self.at) - 1)], 0), starts)
        top.put(score, self.docs[split])
        sides = []
        for side, (a, b) in enumerate(((low, found), (found + there, high))):
            some = np.flatnonzero(b > a)
            sides.append((own[some] * 2 + side, term[some], a[some], b[some]))
        own, term, low, high = (np.concatenate(x) for x in zip(*sides, strict=True))
        order = np.argsort(own, kind="stable")
        own, term, low, high = own[order], term[order], low[order], high[order]
        if not len(own):
            return term, low, high, own, own, own
        peak = self.maximum(low, high)
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        bound = np.add.reduceat(self.impact[peak], starts)
        size = np.diff(np.append(starts, len(own)))
        live = bound >= top.least
        mine = np.repeat(live, size)
        return term[mine], low[mine], high[mine], peak[mine], bound[live], size[live]


class Best:
    """The best documents of one item so far: the highest scores above 0, equal ones by ascending key, null keys last."""

    def __init__(self, count: int):
        self.count = count
        self.score, self.doc = np.zeros(0, np.int64), np.ma.zeros(0, np.int64)
        # A score below it can't get in any more.
        self.least = 1

    def put(self, score: np.ndarray, doc: np.ma.MaskedArray) -> None:
        good = score >= self.least
        score, doc = np.concatenate([self.score, score[good]]), np.ma.concatenate([self.doc, doc[good]])
        order = np.lexsort((doc.data, np.ma.getmaskarray(doc), -score))[: self.count]
        self.score, self.doc = score[order], doc[order]
        if len(order) == self.count:
            self.least = int(self.score[-1])


def _searched(found: DataFrame, wanted: list[np.ndarray], weights: np.ndarray, documents: int, length: int, top: int) -> DataFrame:
    """`number, doc, score`: of every item the best documents of each task."""
    shared = found.sparkSession.sparkContext.broadcast((wanted, weights))  # of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights = shared.value
        tops = [Best(top) for _ in wanted]
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            # Documents come in small slices, so that an index never has many more postings than its bound.
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                held.append(part)
                size += len(part.column(2).flatten())
                if size > _POSTINGS:
                    _search(held, wanted, weights, documents, length, tops)
                    held, size = [], 0
        if held:
            _search(held, wanted, weights, documents, length, tops)
        number = np.repeat(np.arange(len(tops)), [len(t.doc) for t in tops])
        doc = np.ma.concatenate([np.ma.zeros(0, np.int64), *[t.doc for t in tops]])
        score = np.concatenate([np.zeros(0, np.int64), *[t.score for t in tops]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(number.astype(np.int32)), pa.array(doc.data, mask=np.ma.getmaskarray(doc)), pa.array(score)],
            names=["number", "doc", "score"],
        )

    return found.select("doc", "n", "terms", "times").mapInArrow(run, "number int, doc long, score long")


def _search(held: list, wanted: list[np.ndarray], weights: np.ndarray, documents: int, length: int, tops: list[Best]) -> None:
    rows = pa.Table.from_batches(held).combine_chunks()
    doc = rows.column("doc")
    doc = np.ma.array(doc.fill_null(0).to_numpy(), mask=doc.is_null().to_numpy())
    n = rows.column("n").to_numpy()
    lists = rows.column("terms").combine_chunks()
    ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
    found = lists.flatten().to_numpy()
    times = rows.column("times").combine_chunks().flatten().to_numpy()
    m = 50 + (50 * n * documents) // length
    some = np.diff(ends, prepend=0) > 0
    index = Index(doc[some], ends[some], found, times, m[some], weights)
    for item, top in zip(wanted, tops, strict=True):
        index.search(item, top)


def search(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text", top: int = TOP
) -> DataFrame:
    """`item, rank, doc, score`: the `top` documents of highest score for every row of `items`.

    Rows of `docs` without a term (null and empty texts among them) are neither counted nor found; items without one
    find nothing.  Repeated rows, and rows with a null key, are each a document or an item of its own; of equal scores
    the smaller key comes first, null last.  Keys of documents are integers.

    Items are searched for in blocks of bounded size.  For a block the postings of its terms are stored; every task
    indexes its documents part by part and hands on its best ones, which are ranked once more.
    """
    wanted = items.select(F.col(item).alias("item"), F.col(query).alias("text"))
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()["size"]
    blocks = size // _BLOCK + 1
    found = [_block(docs, wanted.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b), key, text, top) for b in range(blocks)]
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every


def _block(docs: DataFrame, items: DataFrame, key: str, text: str, top: int) -> DataFrame:
    spark = docs.sparkSession
    rows = item_terms(items, "item", "text").toArrow()
    lists = rows.column("terms").to_pylist()
    vocabulary = {t.encode(): i for i, t in enumerate(sorted({t for ts in lists for t in ts}))}
    held = stored(postings(docs, vocabulary, key, text), "postings")
    total = held.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    counts = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()  # a row for each term
    weights = np.zeros(len(vocabulary), np.int64)
    df = counts.column("df").to_pylist()
    weights[counts.column("term").to_numpy()] = [weight(total["documents"], n) for n in df]
    wanted = [np.array(sorted(vocabulary[t.encode()] for t in ts), np.int64) for ts in lists]
    best = _searched(held, wanted, weights, total["documents"], max(1, total["length"]), top)
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    names = spark.createDataFrame(pa.table({"number": pa.array(range(len(lists)), pa.int32()), "item": rows.column("item")}))
    return ranked.join(names, "number").select("item", "rank", "doc", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM sizes),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM tf, totals WHERE term IN (SELECT term FROM wanted) GROUP BY term, docs
), scores AS (
  SELECT item_id, tf.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // len))))) AS BIGINT) AS score
  FROM wanted JOIN tf USING (term) JOIN weights USING (term) JOIN sizes ON sizes.doc_id = tf.doc_id, totals
  GROUP BY item_id, tf.doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
