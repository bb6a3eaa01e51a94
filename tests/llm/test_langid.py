import numpy as np
import pytest

from lintlake.llm import langid
from lintlake.llm.common import fold, table

SF_DIR = "/root/testdata/sf0.01"


def test_grams_stay_in_words_and_texts():
    count, found = langid.grams(["Ab c", "", "d!é"])
    assert count.tolist() == [3, 0, 2]
    sizes = [np.bincount(owner, minlength=3).tolist() for _, owner in found]
    # " a" "ab" "b " " c" "c " / " d" "d " " é" "é "; then " ab" "ab " " c " / " d " " é "; then " ab ".
    assert sizes == [[5, 0, 4], [3, 0, 2], [1, 0, 0]]


def test_equal_words_have_equal_grams_anywhere():
    _, found = langid.grams(["xy", "zz xy", "xy\nq"])
    first = [set(keys[owner == 0].tolist()) for keys, owner in found]
    for text in (1, 2):
        assert all(a <= set(k[o == text].tolist()) for a, (k, o) in zip(first, found, strict=True))


def test_filter_holds_every_frequent_gram(spark):
    docs = spark.createDataFrame([(1, "aba abc", "x"), (2, "abd", "y")], "doc_id long, text string, lang string")
    model = langid.learn(docs, langid.Settings(bits=1 << 10))
    assert model.languages == ["x", "y"]
    _, found = langid.grams(["aba abc"])
    for keys, _ in found:
        rows = model.rows[langid._positions(keys, 1 << 10, model.probes)[0]]
        assert (rows[:, 0] & 1).all()


def test_more_than_eight_languages(spark):
    rows = [(i, chr(97 + i) * 3 + " " + chr(97 + i) * 4, f"l{i:02}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.predict(docs, langid.learn(docs)).collect()
    assert all(r["lang_pred"] == r["lang"] for r in found)


def test_no_letter_and_no_language(spark):
    docs = spark.createDataFrame([(1, "12", "x"), (2, None, "x")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.predict(docs, langid.learn(docs)).collect()} == {"und"}
    unlabelled = docs.limit(0)
    assert langid.learn(unlabelled).languages == []


def test_held_out_accuracy(spark):
    docs = table(spark, SF_DIR, "documents")
    found = langid.op1_language_id(spark, SF_DIR).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.filter("held_out AND lang IS NOT NULL").toPandas()
    assert len(held) > 150
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert held.score.between(0, 1).all()
    expected = docs.filter(fold(docs.doc_id, 4) == 2).count()
    assert expected == found.filter("held_out").count()


@pytest.mark.parametrize("bits", [1 << 8, 1 << 12, 1 << 20])
def test_correction_for_false_positives(spark, bits):
    """A crowded filter answers yes by chance: a text of unknown n-grams must not score."""
    rows = [(i, " ".join(f"{chr(97 + i % 20)}{chr(97 + i // 20 % 20)}o" for _ in range(3)), "xy"[i % 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, langid.Settings(bits=bits))
    other = spark.createDataFrame([(1, " ".join("ßüöäéèêñçó"[i % 10] * 3 + "ñ" * (i % 5) for i in range(50)))], "doc_id long, text string")
    assert langid.predict(other, model).first()["score"] < 0.5
