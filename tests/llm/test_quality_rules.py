import re
from collections import Counter

import pytest

from lintlake.llm import quality

TEXTS = [
    None, "", " \n\t", "one", "a b a b a b", "x\nx\n\n \nx", "a b c a b c d", "a b c d a b c", "é\xa0ü * # $|", "\x0b\x0c a\rb", "\x1c\x85 q",
    "the cat " * 60, " ".join(f"word{i} the" for i in range(60)), "日本 語" * 30, "a a a a", "a a a",
]


def naive(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    counts = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if counts[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    for i, text in enumerate(TEXTS):
        q = rows[i]["_q"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == naive(text), repr(text)
        n, repeats = naive(text)[0], naive(text)[4]
        assert rows[i]["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
        assert not (rows[i]["base_failed"] and rows[i]["kept"])


def test_rules_are_compiled_in_order(spark):
    docs = spark.createDataFrame([(1, "# # #")], "doc_id long, text string")
    rules = (quality.Rule("symbols_per_word", most=0.5), quality.Rule("n_words", least=3), quality.Rule("n_words", least=4, most=2))
    assert quality.quality(docs, rules).first()["failed"] == ["symbols_per_word", "n_words", "n_words"]
    assert quality.quality(docs, ()).first()["failed"] == []


def test_verdicts_follow_the_labels(spark):
    folder = "/root/testdata/sf0.01"
    found = quality.op4_quality_rules(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    found = found[~found.base_failed]
    assert (found.kept == (found.quality == 1)).mean() > 0.98


def test_no_python_in_the_plan(spark, capsys):
    quality.op4_quality_rules(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("text", ["a b c " * 3000, "\n".join(f"line {i % 7}" for i in range(3000))])
def test_long_texts(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    q = quality.quality(docs).first()["_q"]
    assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == naive(text)
