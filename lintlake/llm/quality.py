"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import SPACE, WORD, lower_ascii, table

# Marks that count as symbols, and frequent words of the languages in the corpus.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "a", "an", "and", "are", "as", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to",
    "was", "with", "als", "auch", "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "ich", "im",
    "mit", "nicht", "sich", "und", "von", "zu", "au", "aux", "avec", "ce", "dans", "de", "du", "elle", "en", "est", "et",
    "la", "le", "les", "pas", "pour", "que", "qui", "sur", "un", "une", "al", "con", "el", "es", "las", "lo", "los",
    "no", "para", "por", "se", "su", "y",
)


@dataclass(frozen=True)
class Rule:
    """A metric, the least and the most it may be; None is no bound.  A text fails outside of the bounds."""

    metric: str
    least: float | None = None
    most: float | None = None


# Read as: a kept text has at least / at most so much.  All metrics are ratios or counts of one row.
RULES = (
    Rule("n_words", least=50),
    Rule("mean_word_chars", least=3, most=10),
    Rule("symbols_per_word", most=0.1),
    Rule("stop_word_share", least=0.05),
    Rule("alphabetic_word_share", least=0.8),
    Rule("dup_line_share", most=0.5),
    Rule("repeat_word_share", most=0.5),
    Rule("bullet_line_share", most=0.9),
    Rule("ellipsis_line_share", most=0.5),
    Rule("upper_share", most=0.7),
)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of `docs` and, in a struct `_q`, the words, the lines and the counts that the rules are made of.

    A null text has no words and no lines.  Everything stays in the text's own row.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    words = docs.select(
        "*",
        value.alias("_value"),
        F.filter(F.split(value, SPACE + "+"), lambda w: w != "").alias("_words"),
        F.filter(F.split(value, "\n"), lambda x: x.rlike(WORD)).alias("_lines"),
    )
    n = F.size("_words").cast("long")
    windows = F.expr(
        "IF(size(_words) < 3, array(), sort_array(transform(sequence(0, size(_words) - 3), i -> struct("
        "xxhash64(_words[i], _words[i + 1], _words[i + 2]) AS h, i AS i))))"
    )
    counted = words.withColumn("_windows", windows)
    # The places of windows that have an equal neighbour in the order of hashes.
    again = F.expr(
        "array_sort(transform(filter(_windows, (w, k) -> (k > 0 AND _windows[k - 1].h = w.h) OR "
        "(k + 1 < size(_windows) AND _windows[k + 1].h = w.h)), w -> w.i))"
    )
    counted = counted.withColumn("_again", again)
    covered = F.expr(
        "aggregate(transform(_again, (p, k) -> IF(k + 1 < size(_again), least(3, _again[k + 1] - p), 3)), "
        "0L, (s, x) -> s + x)"
    )
    return counted.select(
        *docs.columns,
        F.struct(
            n.alias("n_words"),
            F.length(F.regexp_replace("_value", SPACE + "+", "")).cast("long").alias("word_chars"),
            (F.length("_value") - F.length(F.translate("_value", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size("_lines").cast("long").alias("n_lines"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            covered.alias("n_repeat_words"),
            F.size(F.filter("_words", lambda w: lower_ascii(w).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
            F.size(F.filter("_words", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_alphabetic"),
            F.size(F.filter("_lines", lambda x: x.rlike(r"^\s*[-*•]"))).cast("long").alias("n_bullets"),
            F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long").alias("n_ellipses"),
            F.length(F.regexp_replace("_value", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
            F.length(F.regexp_replace("_value", r"\P{L}+", "")).cast("long").alias("n_letters"),
        ).alias("_q"),
    )


def _ratio(part: str, whole: str) -> Column:
    count = F.col(f"_q.{whole}")
    return F.when(count > 0, F.col(f"_q.{part}") / count).otherwise(0.0)


def metrics() -> dict[str, Column]:
    """The metrics that rules can name, over the columns of `base_counts`."""
    return {
        "n_words": F.col("_q.n_words"),
        "mean_word_chars": _ratio("word_chars", "n_words"),
        "symbols_per_word": _ratio("n_symbols", "n_words"),
        "stop_word_share": _ratio("n_stop", "n_words"),
        "alphabetic_word_share": _ratio("n_alphabetic", "n_words"),
        "dup_line_share": _ratio("n_dup_lines", "n_lines"),
        "repeat_word_share": _ratio("n_repeat_words", "n_words"),
        "bullet_line_share": _ratio("n_bullets", "n_lines"),
        "ellipsis_line_share": _ratio("n_ellipses", "n_lines"),
        "upper_share": _ratio("n_upper", "n_letters"),
    }


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a row fails, in the order of the table."""
    known = metrics()
    failed = []
    for rule in rules:
        value = known[rule.metric]
        bounds = [value < rule.least] if rule.least is not None else []
        bounds += [value > rule.most] if rule.most is not None else []
        for bound in bounds:
            failed.append(F.when(bound, F.lit(rule.metric)))
    return F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of `docs` with `_q` (counts), `base_failed`, `failed` (rules) and `kept`.

    The base fails texts of under 50 words, or with over half of their words in three-word windows that the text has
    twice or more.  Rows of the table never meet: repeated rows are judged alike.
    """
    base = (F.col("_q.n_words") < 50) | (100 * F.col("_q.n_repeat_words") > 50 * F.col("_q.n_words"))
    judged = base_counts(docs).select("*", base.alias("base_failed"), compiled(rules).alias("failed"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.col(f"_q.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _failed(rules: tuple[Rule, ...]) -> str:
    bounds = [f"{r.metric} < {r.least}" for r in rules if r.least is not None]
    bounds += [f"{r.metric} > {r.most}" for r in rules if r.most is not None]
    return " OR ".join(bounds)


SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  split AS (
    SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM texts),
  word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM split),
  windows AS (
    SELECT doc_id, i, w, lead(w, 1) OVER (PARTITION BY doc_id ORDER BY i) AS w1, lead(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS w2
    FROM word),
  again AS (
    SELECT doc_id, i FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w1, w2) AS n FROM windows WHERE w2 IS NOT NULL) AS x
    WHERE n > 1),
  covered AS (
    SELECT doc_id, count(*) AS n_repeat_words FROM (
      SELECT doc_id, i FROM again UNION SELECT doc_id, i + 1 FROM again UNION SELECT doc_id, i + 2 FROM again) AS y
    GROUP BY doc_id),
  of_words AS (
    SELECT doc_id, sum(CASE WHEN translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({_STOPS})
                            THEN 1 ELSE 0 END) AS n_stop,
           sum(CASE WHEN regexp_matches(w, '\p{{L}}') THEN 1 ELSE 0 END) AS n_alphabetic
    FROM word GROUP BY doc_id),
  counts AS (
    SELECT s.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
           length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(ls) AS n_lines,
           len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n_repeat_words, 0) AS n_repeat_words,
           coalesce(n_stop, 0) AS n_stop, coalesce(n_alphabetic, 0) AS n_alphabetic,
           len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_bullets,
           len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipses,
           length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS n_upper, length(regexp_replace(t, '\P{{L}}+', '', 'g')) AS n_letters
    FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id LEFT JOIN of_words o ON s.doc_id = o.doc_id),
  metrics AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           {", ".join(f"CASE WHEN {whole} > 0 THEN {part} * 1.0 / {whole} ELSE 0.0 END AS {name}" for name, part, whole in (
               ("mean_word_chars", "word_chars", "n_words"), ("symbols_per_word", "n_symbols", "n_words"),
               ("stop_word_share", "n_stop", "n_words"), ("alphabetic_word_share", "n_alphabetic", "n_words"),
               ("dup_line_share", "n_dup_lines", "n_lines"), ("repeat_word_share", "n_repeat_words", "n_words"),
               ("bullet_line_share", "n_bullets", "n_lines"), ("ellipsis_line_share", "n_ellipses", "n_lines"),
               ("upper_share", "n_upper", "n_letters")))}
    FROM counts)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR {_failed(RULES)}) AS kept
FROM metrics
"""
