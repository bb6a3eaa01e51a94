"""Log-likelihood of whole documents under a recurrent language model and under word counts."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import gru
from lintlake.llm.common import fold, stored, table


@dataclass(frozen=True)
class Settings:
    """The counts and the model cover every training text.

    words: frequent words with a softmax of their own; others: classes of the other words, by their first two
    characters.  head: words whose counts each worker holds, the others are joined.  The model is fitted on all texts
    in `rounds` rounds, each from the mean of the weights of the last.  Whatever the size of the corpus, every text is
    trained on `rounds` times.  Those of a small corpus are in every round; as long as that moves more than about
    `rounds` times `share` times the training tokens to the power `growth` tokens, they are in fewer, and gone
    through again in their shard.  The texts of a round are dealt to shards of `shard` tokens each, of a large corpus
    of up to `most`.
    """

    words: int = 2048
    others: int = 64
    hidden: int = 40
    head: int = 65_536
    head_bytes: int = 64
    share: float = 400
    growth: float = 0.5
    shard: int = 150_000
    most: int = 1_000_000
    rounds: int = 3
    rate: float = 0.01

    def chosen(self, tokens: int) -> int:
        """So many of the training tokens the model is fitted on: all."""
        return tokens

    def passes(self, tokens: int) -> int:
        """In so many of the rounds every text is; see `times` for how often it is trained on in each."""
        wanted = self.rounds * self.share * tokens**self.growth / max(1, tokens)
        return max(1, min(self.rounds, round(wanted)))

    def times(self, passes: int, number: int) -> int:
        """So often a text is trained on in the round `number` of its `passes` rounds; `rounds` times in all."""
        return self.rounds // passes + (number < self.rounds % passes)

    def shards(self, tokens: int) -> int:
        """So many shards the texts of a round are dealt to."""
        size = tokens * self.passes(tokens) / self.rounds
        return max(1, round(size / min(max(self.shard, size / _SHARDS), self.most)))


# Shards of a round from which on they hold more.
_SHARDS = 64
# Words that a counting task holds before it hands them on.
_HELD = 250_000
# Bytes of texts that are split into words at once, beyond one text.
_BYTES = 1 << 23
END = b""


@dataclass(frozen=True)
class Vocabulary:
    """`index` of the head words; their `counts` and model `ids`; the class of other words by their first characters."""

    index: dict[bytes, int]
    counts: np.ndarray
    ids: np.ndarray
    prefixes: dict[str, int]
    shape: gru.Shape
    word_counts: np.ndarray
    other_counts: np.ndarray
    other_logs: np.ndarray
    tokens: int
    distinct: int

    @property
    def base_log(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.distinct + 1)))

    @cached_property
    def head(self) -> pa.Array:
        return pa.array(list(self.index), pa.binary()).view(pa.string())

    def other(self, word: bytes) -> int:
        """Model id of a word that is not a frequent one."""
        return self.shape.words + self.prefixes.get(word.decode("utf-8", "replace")[:2], self.shape.others - 1)


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """`word, n`: how often all texts have each word, A-Z in lower case; the empty word counts the ends of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for part in _pieces(batch.column(0)):
                found = _words(part)[1].value_counts()
                words = pa.concat_arrays([found.field("values"), pa.array([END], pa.binary()).view(pa.string())])
                numbers = pa.concat_arrays([found.field("counts"), pa.array([len(part)], pa.int64())])
                held.append(pa.table({"word": words, "n": numbers}))
                if sum(t.num_rows for t in held) > 4 * _HELD:
                    held = [_joined(held)]
                    if held[0].num_rows > _HELD:
                        yield from held.pop().to_batches()
        if held:
            yield from _joined(held).to_batches()

    partial = docs.select(F.col(text).cast("binary")).mapInArrow(run, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def _joined(counts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(counts).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts, as many at once as have `_BYTES` bytes, or one that has more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first, done = 0, 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, done + _BYTES, side="right")))
        yield texts.slice(first, last - first)
        first, done = last, int(ends[last - 1])


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and all words, A-Z in lower case; `texts` are bytes, a null has no word."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null(b"").view(pa.string())))
    words, at = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    # White space at either end of a text leaves an empty word.
    full = pc.binary_length(words).to_numpy() > 0
    before = np.concatenate([[0], np.cumsum(full)])[at - at[0]]
    return np.diff(before), words if full.all() else words.filter(pa.array(full))


def vocabulary(counts: DataFrame, settings: Settings) -> Vocabulary:
    """The head of the counts, and the sums over all of them that the model needs."""
    short = counts.filter(F.octet_length("word") <= settings.head_bytes)
    head = short.orderBy(F.desc("n"), "word").limit(settings.head).toArrow()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = [w.encode() for w in head.column("word").to_pylist()]
    n = head.column("n").to_numpy().astype(np.int64)
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    words, n = [words[i] for i in order], n[order]
    frequent = min(settings.words, len(words))
    size = max(gru.CLASS, -(-frequent // gru.CLASS) * gru.CLASS)
    word_counts = np.zeros(size)
    word_counts[:frequent] = n[:frequent]
    by_prefix = counts.groupBy(F.substring("word", 1, 2).alias("prefix")).agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    rows = by_prefix.orderBy(F.desc("n"), "prefix").limit(settings.others + settings.words).collect()
    mass = {r["prefix"]: [r["n"], r["v"]] for r in rows}
    for word, c in zip(words[:frequent], n[:frequent].tolist(), strict=True):
        held = mass.setdefault(word.decode()[:2], [0, 0])
        held[0] -= c
        held[1] -= 1
    best = sorted((p for p in mass if mass[p][0] > 0), key=lambda p: (-mass[p][0], p))[: settings.others - 1]
    sums = np.zeros((settings.others, 2))
    sums[: len(best)] = [mass[p] for p in best] if best else sums[:0]
    sums[-1] = [total[0] - n[:frequent].sum() - sums[:, 0].sum(), total[1] - frequent - sums[:, 1].sum()]
    prefixes = {p: i for i, p in enumerate(best)}
    shape = gru.Shape(size, settings.others, settings.hidden)
    ids = [i if i < frequent else size + prefixes.get(w.decode()[:2], settings.others - 1) for i, w in enumerate(words)]
    return Vocabulary(
        {w: i for i, w in enumerate(words)}, n, np.array(ids, np.int64), prefixes, shape, word_counts, sums[:, 0],
        np.log10(sums[:, 0] + 0.5 * (sums[:, 1] + 1)), int(total[0]), int(total[1]),
    )


@dataclass(frozen=True)
class Tokens:
    """Texts one after another: how many tokens each has, the head `number` of each token (-1 for others), its model id.

    `rest` are the words that are not in the head, `owner` the places of their texts.
    """

    sizes: np.ndarray
    number: np.ndarray
    ids: np.ndarray
    owner: np.ndarray
    rest: pa.Array

    def texts(self) -> list[np.ndarray]:
        return np.split(self.ids, np.cumsum(self.sizes)[:-1])


def tokens_of(texts: pa.Array, known: Vocabulary) -> Tokens:
    """The tokens of all texts, given as bytes: their words, then an end each."""
    sizes, words = _words(texts)
    place = pc.index_in(words, value_set=known.head)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    sizes = sizes + 1
    here = np.ones(len(words) + len(sizes), bool)
    here[np.cumsum(sizes) - 1] = False
    number = np.full(len(here), known.index.get(END, -1), np.int64)
    number[here] = pc.fill_null(place, -1).to_numpy()
    outside = pc.is_null(place)
    rest, owner = words.filter(outside), owner[outside.to_numpy(zero_copy_only=False)]
    ids = np.full(len(here), known.other(END), np.int64)
    inside = number >= 0
    ids[inside] = known.ids[number[inside]]
    classes, rest = _others(rest, known)
    ids[here & ~inside] = classes
    if END not in known.index:
        rest = pa.concat_arrays([rest, pa.array([END.decode()] * len(sizes), pa.string())])
        owner = np.concatenate([owner, np.arange(len(sizes))])
    return Tokens(sizes, number, ids, owner, rest)


def _others(words: pa.Array, known: Vocabulary) -> tuple[np.ndarray, pa.Array]:
    """The model ids of words that are not frequent ones, and the words as text."""
    try:
        words.validate(full=True)
    except pa.ArrowInvalid:  # not UTF-8
        raw = words.view(pa.binary()).to_pylist()
        return np.array([known.other(w) for w in raw], np.int64), pa.array([w.decode("utf-8", "replace") for w in raw], pa.string())
    place = pc.index_in(pc.utf8_slice_codeunits(words, 0, 2), value_set=pa.array(list(known.prefixes), pa.string()))
    return pc.fill_null(place, known.shape.others - 1).to_numpy().astype(np.int64) + known.shape.words, words


def model_ids(text: bytes | None, known: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Head numbers of a text's tokens (-1 for others), their model ids, and the words that are not in the head."""
    found = tokens_of(pa.array([text], pa.binary()), known)
    return found.number, found.ids, [w.encode() for w in found.rest.to_pylist()]


def learn(docs: DataFrame, known: Vocabulary, settings: Settings, key: str = "doc_id") -> dict[str, np.ndarray]:
    """Weights learnt from all texts, each gone through `settings.rounds` times: in every round each shard trains the
    model, and their mean is the next one."""
    passes, shards = settings.passes(known.tokens), settings.shards(known.tokens)
    lot = F.xxhash64(F.col(key), F.length("text"), F.lit(7))
    texts = docs.select(F.col("text").cast("binary").alias("text"), lot.alias("lot"))
    texts = texts.select(
        F.pmod(F.shiftright("lot", 20), F.lit(shards)).cast("long").alias("shard"),
        F.pmod("lot", F.lit(settings.rounds)).cast("int").alias("first"),
        "text",
    )
    weights = gru.initial(known.shape, known.word_counts, known.other_counts)
    for number in range(settings.rounds):
        rate = settings.rate if number < settings.rounds - 1 else settings.rate / 2
        turn = F.pmod(F.lit(number) - F.col("first"), F.lit(settings.rounds))
        times = F.get(F.array(*[F.lit(settings.times(passes, n)) for n in range(passes)]), turn)
        part = texts.filter(turn < passes).select("shard", "text", times.alias("times"))
        weights = _mean(_trained(part, known, weights, rate, number), shards) or weights
    return weights


_MODEL = "shard long, tokens long, weights binary"
# Models that one task adds up.
_FAN = 16


def _trained(rows: DataFrame, known: Vocabulary, weights: dict, rate: float, number: int) -> DataFrame:
    """Of every shard how many tokens it has, and the weights it has learnt times that; a text is gone through `times` times."""
    shared = rows.sparkSession.sparkContext.broadcast((known, weights))  # the head, and weights of a fixed size

    def run(group: pa.Table) -> pa.Table:
        known, weights = shared.value
        # The order of rows depends on how they came; the order of training must not.
        rows = zip(group.column("text").to_pylist(), group.column("times").to_pylist(), strict=True)
        texts, times = zip(*sorted((t or b"", n) for t, n in rows), strict=True)
        ids = [i for part in _pieces(pa.array(texts, pa.large_binary())) for i in tokens_of(part.cast(pa.binary()), known).texts()]
        tokens = sum(map(len, ids))
        learnt = gru.train(weights, known.shape, ids, list(times), rate, seed=number)
        return _as_model(group.column("shard")[0].as_py(), tokens, {k: w * np.float32(tokens) for k, w in learnt.items()})

    return stored(rows.groupBy("shard").applyInArrow(run, _MODEL), "models")


def _mean(models: DataFrame, shards: int) -> dict[str, np.ndarray] | None:
    """The mean of all weights, added up by Spark in a tree; one model comes to the driver."""

    def run(group: pa.Table) -> pa.Table:
        total: dict[str, np.ndarray] = {}
        for model in group.column("weights"):
            for name, value in _loaded(model.as_py()).items():
                total[name] = total[name] + value if name in total else value
        return _as_model(group.column("shard")[0].as_py(), sum(group.column("tokens").to_pylist()), total)

    while shards > 1:
        shards = -(-shards // _FAN)
        models = models.withColumn("shard", F.pmod("shard", F.lit(shards))).groupBy("shard").applyInArrow(run, _MODEL)
    summed = stored(models, "model").first()
    if not summed or not summed["tokens"]:
        return None
    return {name: (value / summed["tokens"]).astype(np.float32) for name, value in _loaded(summed["weights"]).items()}


def _as_model(shard: int, tokens: int, weights: dict[str, np.ndarray]) -> pa.Table:
    return pa.table({"shard": [shard], "tokens": [tokens], "weights": pa.array([_saved(weights)], pa.binary())})


def _saved(weights: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **weights)
    return out.getvalue()


def _loaded(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as arrays:
        return dict(arrays)


_FIELDS = "n_tokens long, head_known long, n_other long, base double, model double, others array<struct<word: string, n: long>>"


def scored(docs: DataFrame, known: Vocabulary, weights: dict[str, np.ndarray], *keep: str, text: str = "text") -> DataFrame:
    """The `keep` columns with `n_tokens, head_known, n_other, base, model, others`: all that a worker knows of a text.

    `base` and `model` lack the counts of the `others`, the words outside of the head.
    """
    shared = docs.sparkSession.sparkContext.broadcast((known, weights))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = shared.value
        for batch in batches:
            first = 0
            for part in _pieces(batch.column(len(keep))):
                columns = [c.slice(first, len(part)) for c in batch.columns[: len(keep)]]
                yield _rows(dict(zip(keep, columns, strict=True)), tokens_of(part, known), known, weights)
                first += len(part)

    slim = docs.select(*keep, F.col(text).cast("binary").alias("_text"))
    return slim.mapInArrow(run, f"{kept}, {_FIELDS}" if kept else _FIELDS)


def _rows(kept: dict[str, pa.Array], texts: Tokens, known: Vocabulary, weights: dict[str, np.ndarray]) -> pa.RecordBatch:
    model = gru.score(weights, known.shape, texts.texts()) / np.log(10)
    logs = np.log10(np.append(known.counts, 0.5) + 0.5)
    logs[-1] = 0  # the others' counts are joined
    first = np.cumsum(texts.sizes) - texts.sizes
    each = logs[texts.number]
    rare = np.flatnonzero(texts.ids >= known.shape.words)
    inside = np.zeros(len(each))
    inside[rare] = each[rare] - known.other_logs[texts.ids[rare] - known.shape.words]
    head_known = np.add.reduceat(texts.number >= 0, first, dtype=np.int64)
    base = np.add.reduceat(each, first) - texts.sizes * known.base_log
    out = {
        "n_tokens": pa.array(texts.sizes, pa.int64()),
        "head_known": pa.array(head_known, pa.int64()),
        "n_other": pa.array(texts.sizes - head_known, pa.int64()),
        "base": pa.array(base, pa.float64()),
        "model": pa.array(model + np.add.reduceat(inside, first), pa.float64()),
        "others": _counted(texts),
    }
    return pa.RecordBatch.from_arrays([*kept.values(), *out.values()], names=[*kept, *out])


def _counted(texts: Tokens) -> pa.ListArray:
    """Of every text its words that are not in the head, and how often it has each."""
    words = texts.rest.dictionary_encode()
    size = max(1, len(words.dictionary))
    pairs, n = np.unique(texts.owner * size + words.indices.to_numpy(), return_counts=True)
    at = np.searchsorted(pairs, np.arange(len(texts.sizes) + 1) * size)
    found = [words.dictionary.take(pa.array(pairs % size)), pa.array(n, pa.int64())]
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(found, names=["word", "n"]))


def log_scores(docs: DataFrame, training: DataFrame, settings: Settings = Settings(), key: str = "doc_id") -> DataFrame:
    """All columns of `docs` but the text, with `n_tokens, n_known, train_tokens, base_score, score` for every row.

    Both scores are logarithms to base 10 of the text's probability.  A frequent word has the model's probability of
    its class and of itself in it; another word that of its class, times its share of the counts of the class,
    smoothed like the base.  A null or empty text is its end alone; repeated rows are scored each.  Columns named
    like the new ones are replaced.
    """
    counts = stored(count_words(training), "counts")
    known = vocabulary(counts, settings)
    weights = learn(training, known, settings, key)
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = [c for c in docs.columns if c not in ("text", *new)]
    found = scored(docs.withColumnsRenamed({c: f"_{c}" for c in kept}), known, weights, *[f"_{c}" for c in kept])
    found = stored(found.withColumn("id", F.monotonically_increasing_id()), "scored")
    each = found.select("id", F.explode("others").alias("o")).select("id", "o.word", F.col("o.n").alias("times"))
    met = each.join(counts, "word", "left")
    rest = met.groupBy("id").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rest_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rest_log"),
    )
    every = found.drop("others").join(rest, "id", "left")
    more = F.coalesce("rest_log", F.lit(0.0))
    return every.select(
        *[F.col(f"_{c}").alias(c) for c in kept], "n_tokens", (F.col("head_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", fold(F.col("doc_id"), 5) == 1)
    return log_scores(docs, docs.filter(~F.col("held_out")))
