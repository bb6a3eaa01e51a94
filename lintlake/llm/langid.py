"""Language identification by bit-sliced Bloom filters over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.common import by_batch, cached, fold, stored, table

SIZES = (2, 3, 4)
UNKNOWN = "und"

_BLANK = 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Settings:
    """What bounds the learning.

    sample: expected number of labelled rows learnt from per language; whole texts, chosen by a hash of the key,
        all rows of a language that has no more.
    share: an n-gram enters a language's filter if it makes up at least this share of the language's n-grams of
        that size, so a filter holds at most 1/share n-grams of each size whatever the corpus.
    languages: most languages learnt, those of most rows first (of equal ones the first by name).
    bits: rows of the filter, a power of two.
    probes: rows that an n-gram reads.
    """

    sample: int = 4000
    share: float = 2e-5
    languages: int = 256
    bits: int = 1 << 20
    probes: int = 3


@dataclass(frozen=True)
class Model:
    """`rows[i]` is the bit mask, in bytes, of the languages that have a bit in row i of their filters."""

    languages: list[str]
    rows: np.ndarray
    false_positive: np.ndarray
    probes: int


def grams(texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Number of letters per text, and for each size the hashes of all n-grams with the text they are from.

    A word is a run of letters, in lower case, with a blank before and after; n-grams do not cross words.
    """
    letters = cached("letters", _letter_table)
    lowered = [t.lower() for t in texts]
    sizes = np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered))
    codes = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    is_letter = letters[codes]
    count = np.bincount(owner[is_letter], minlength=len(texts))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    is_letter = is_letter[keep]
    chars = np.where(is_letter, codes[keep], _BLANK).astype(np.uint64)
    owner = owner[keep]
    # A blank in front: the words' first n-grams need it.
    chars = np.concatenate([[np.uint64(_BLANK)], chars])
    owner = np.concatenate([owner[:1], owner])
    is_letter = np.concatenate([[False], is_letter])
    out = []
    for size in SIZES:
        n = len(chars) - size + 1
        if n <= 0:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int32)))
            continue
        whole = np.ones(n, bool)
        for inner in range(1, size - 1):
            whole &= is_letter[inner : inner + n]
        if size == 2:
            whole &= is_letter[:n] | is_letter[1 : n + 1]
        at = np.flatnonzero(whole)
        key = np.zeros(len(at), np.uint64)
        for place in range(size):
            key = key * _STEP + chars[at + place] + np.uint64(size)
        key ^= key >> np.uint64(29)
        key *= _MIX
        key ^= key >> np.uint64(32)
        # The text of the second character: the first may be the blank after the text before.
        out.append((key, owner[at + 1]))
    return count, out


def _letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _positions(keys: np.ndarray, bits: int, probes: int) -> list[np.ndarray]:
    low, high = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    return [((low + np.uint64(i) * high) & np.uint64(bits - 1)).astype(np.int64) for i in range(probes)]


def learn(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id") -> Model:
    """A model of the non-null `lang` values of all rows of `docs`, from a bounded sample of their texts.

    A table without a labelled row gives a model without languages.
    """
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.col(key).alias("key"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("rows"))
    most = counts.orderBy(F.desc("rows"), "lang").limit(settings.languages).collect()
    if not most:
        return Model([], np.zeros((settings.bits, 1), np.uint8), np.zeros(0), settings.probes)
    # A row's language gives its chance: no join, so that no text is moved.
    chances = F.create_map(*[F.lit(x) for r in most for x in (r["lang"], settings.sample / r["rows"])])
    lot = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.filter(lot < F.coalesce(chances[F.col("lang")], F.lit(0.0))).select("lang", "text")

    def count(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"lang": [], "size": [], "gram": [], "n": []}
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for start, end in _chunks(texts):
            some = np.array(langs[start:end], object)
            _, found = grams(texts[start:end])
            for size, (keys, owner) in zip(SIZES, found, strict=True):
                for lang in dict.fromkeys(some):
                    unique, n = np.unique(keys[some[owner] == lang], return_counts=True)
                    out["lang"] += [lang] * len(unique)
                    out["size"] += [size] * len(unique)
                    out["gram"].append(unique.view(np.int64))
                    out["n"].append(n)
        return out | {k: np.concatenate([np.zeros(0, np.int64), *out[k]]) for k in ("gram", "n")}

    partial = by_batch(sample, count, "lang string, size int, gram long, n long")
    # Stored: the totals and the n-grams are both taken from it.
    each = stored(partial.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")), "grams")
    total = each.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    common = each.join(total, ["lang", "size"]).filter(F.col("n") >= F.col("total") * settings.share)
    rows = common.select("lang", "gram").toArrow()  # at most 1/share rows per language and size
    languages = sorted(set(rows.column("lang").to_pylist()))
    filters = np.zeros((settings.bits, max(1, -(-len(languages) // 8))), np.uint8)
    number = {lang: i for i, lang in enumerate(languages)}
    which = np.array([number[lang] for lang in rows.column("lang").to_pylist()], np.int64)
    keys = rows.column("gram").to_numpy().astype(np.int64).view(np.uint64)
    for at in _positions(keys, settings.bits, settings.probes):
        np.bitwise_or.at(filters, (at, which // 8), (1 << which % 8).astype(np.uint8))
    fill = np.array([np.mean(filters[:, i // 8] >> (i % 8) & 1) for i in range(len(languages))])
    return Model(languages, filters, fill**settings.probes, settings.probes)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` with `lang_pred` and `score`; only `text` is an input.

    Each n-gram reads a mask of all languages that have it.  A language's count of masks, less the false positives
    that its filter would give anyway, is its share of known n-grams; the largest share decides (of equal ones the
    first language by name) and is the score.  A null text, one without a letter, or a model without languages
    gives `und` and 0.  Columns of `docs` named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed rows by the number of languages
    schema = docs.drop("lang_pred", "score").schema
    rest = schema.names
    full = T.StructType([*schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            best, score = _judge(batch.column(rest.index("text")).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best, pa.string()), pa.array(score, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return docs.select(*rest).mapInArrow(run, full)


# Characters taken at once; a longer text is taken alone.
_CHUNK = 1 << 19


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(texts):
        end, chars = start + 1, len(texts[start] or "")
        while end < len(texts) and chars + len(texts[end] or "") <= _CHUNK:
            chars += len(texts[end] or "")
            end += 1
        yield start, end
        start = end


def _judge(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    best, score = [], []
    for start, end in _chunks(texts):
        if not model.languages:
            best += [UNKNOWN] * (end - start)
            score += [0.0] * (end - start)
            continue
        shares, letters = _shares([t or "" for t in texts[start:end]], model)
        for row, winner in enumerate(shares.argmax(1)):
            known = letters[row] > 0
            best.append(model.languages[winner] if known else UNKNOWN)
            score.append(float(np.clip(shares[row, winner], 0, 1)) if known else 0.0)
    return best, score


def _shares(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each text and language the corrected share of n-grams, a mean over the sizes that occur."""
    letters, found = grams(texts)
    count, languages = len(texts), len(model.languages)
    bits = model.rows.shape[0]
    sums, sizes = np.zeros((count, languages)), np.zeros(count)
    for keys, owner in found:
        places = _positions(keys, bits, model.probes)
        total = np.bincount(owner, minlength=count)
        hits = np.zeros((count, languages))
        for byte in range(model.rows.shape[1]):
            column = model.rows[:, byte]
            mask = column[places[0]]
            for place in places[1:]:
                mask = mask & column[place]
            table_ = np.bincount(owner * np.int64(256) + mask, minlength=count * 256).reshape(count, 256)
            for bit in range(min(8, languages - 8 * byte)):
                hits[:, 8 * byte + bit] = table_[:, (np.arange(256) >> bit & 1).astype(bool)].sum(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            share = (hits / total[:, None] - model.false_positive) / (1 - model.false_positive)
        # A filter that is all but full says nothing.
        share = np.where(model.false_positive < 0.9, share, 0)
        sums += np.where(total[:, None] > 0, share, 0)
        sizes += total > 0
    return sums / np.maximum(sizes, 1)[:, None], letters


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    model = learn(docs.filter(~F.col("held_out")))
    found = predict(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


# A text is rejected if less than this share of its n-grams is known to the best language.
LEAST_SHARE = 0.2


def keep_known(docs: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """Pipeline stage: texts in a language that the table itself teaches; the others go, null and empty ones among them.

    A table without a labelled row teaches none: then every row stays.  Repeated rows stay or go each by its text.
    """
    model = learn(docs.filter(fold(F.col("doc_id"), 4) != 2))
    if not model.languages:
        return docs
    found = predict(docs.withColumnsRenamed({"lang_pred": "_lang_pred", "score": "_score"}), model)
    known = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).drop("lang_pred", "score")
    return known.withColumnsRenamed({"_lang_pred": "lang_pred", "_score": "score"}).select(*docs.columns)
