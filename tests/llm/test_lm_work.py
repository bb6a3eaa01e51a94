"""Less work for each token, with the results of the plain forms."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lintlake.llm import gru, lm

TEXTS = [None, b"", b"  A b\x0bb\tA rare1 ", b"\r\n", "É x y ßß\x1cz".encode(), b"\xff\xfe ab a", b"a " * 50 + b"rare2", b"rare2 rare2 b"]


@pytest.fixture(params=[4, 100])
def known(spark, request):
    docs = spark.createDataFrame([(i, "a b c rare1 x" + " a" * i) for i in range(20)], "doc_id long, text string")
    return lm.vocabulary(lm.count_words(docs), lm.Settings(words=64, others=3, head=request.param))


def test_words_outside_of_the_head_are_found_all_at_once(known, monkeypatch):
    calls = []
    other = lm.Vocabulary.other
    monkeypatch.setattr(lm.Vocabulary, "other", lambda self, word: calls.append(word) or other(self, word))
    ids = lm.model_ids(" ".join(f"new{i}" for i in range(1000)).encode(), known)[1]
    assert len(ids) == 1001 and len(calls) <= 1


@pytest.mark.parametrize("texts", [TEXTS, [t for t in TEXTS if t is None or b"\xff" not in t], [None], [b"new words"]])
def test_tokens_of_many_texts_are_those_of_each(known, texts):
    found = lm.tokens_of(pa.array(texts, pa.binary()), known)
    number, ids, rest = [], [], []
    for i, text in enumerate(texts):
        words = [*(text or b"").lower().split(), b""]
        assert found.sizes[i] == len(words)
        number += [known.index.get(w, -1) for w in words]
        ids += [known.ids[known.index[w]] if w in known.index else known.other(w) for w in words]
        rest += [(i, w.decode("utf-8", "replace")) for w in words if w not in known.index]
    assert (found.number.tolist(), found.ids.tolist()) == (number, ids)
    assert Counter(zip(found.owner.tolist(), found.rest.to_pylist(), strict=True)) == Counter(rest)
    counted = [(i, o["word"], o["n"]) for i, others in enumerate(lm._counted(found).to_pylist()) for o in others]
    assert sorted(counted) == sorted((*pair, n) for pair, n in Counter(rest).items())


def test_words_are_counted_whatever_the_pieces(spark, monkeypatch):
    rows = [(f"w{i % 7} W{i % 5}  x",) for i in range(300)] + [(None,), ("",), (" ",)]
    plain = Counter(w for (t,) in rows for w in [*(t or "").lower().split(), ""])
    for size in (1, 1 << 23):
        monkeypatch.setattr(lm, "_BYTES", size)
        raw = [None if t is None else t.encode() for (t,) in rows]
        assert [t for p in lm._pieces(pa.array(raw, pa.binary())) for t in p.to_pylist()] == raw
        found = lm.count_words(spark.createDataFrame(rows, "text string").repartition(3)).collect()
        assert {r["word"]: r["n"] for r in found} == plain


def test_rows_of_equal_tokens_are_added_up():
    rng = np.random.default_rng(3)
    tokens = np.concatenate([rng.integers(0, 50, 400), np.full(77, 3), [60]])
    rows = rng.normal(size=(len(tokens), 6))
    want = np.zeros((61, 6))
    np.add.at(want, tokens, rows)
    touched, sums = gru._sums(tokens, rows, gru.Shape(64, 3, 2), gru._Room(rows.dtype))
    assert touched.tolist() == sorted(set(tokens.tolist()))
    assert sums == pytest.approx(want[touched])


def test_training_is_that_of_plain_adam_on_all_weights():
    """Over more steps than the averages go without being brought up to date."""
    rng = np.random.default_rng(1)
    shape = gru.Shape(128, 5, 6)
    w = gru.initial(shape, rng.integers(1, 50, 128).astype(float), rng.integers(1, 50, 5).astype(float))
    w = {k: v.astype(np.float64) for k, v in w.items()}
    text, rows, rate = rng.integers(0, 40, 32 * 4 * 150), 4, 0.05
    found = gru.train(w, shape, [text], 1, rate, rows=rows)
    target = text.reshape(rows, -1)
    token = np.concatenate([[shape.start], text[:-1]]).reshape(rows, -1)
    fresh = np.zeros(target.shape, bool)
    fresh[0, 0] = True
    h, plain, steps = np.zeros((rows, 6)), {k: v.copy() for k, v in w.items()}, target.shape[1] // 32
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        part = slice(32 * step - 32, 32 * step)
        g, _, h = gru._gradients(plain, shape, h, token[:, part], target[:, part], fresh[:, part])
        size = max(1, sum((v**2).sum() for v in g.values()) ** 0.5)
        speed = rate * min(1, step / 20) * (1 - 0.9 * step / steps) * (1 - 0.995**step) ** 0.5 / (1 - 0.9**step)
        for k, v in g.items():
            mean[k] += 0.1 * (v / size - mean[k])
            square[k] += 0.005 * ((v / size) ** 2 - square[k])
            plain[k] -= speed * mean[k] / (np.sqrt(square[k]) + 1e-8)
    for k in w:
        assert found[k] == pytest.approx(plain[k], rel=1e-6, abs=1e-8)


def test_large_logits_are_shifted():
    logits = np.array([[500.0, 499.0], [-500.0, -500.0]], np.float32)
    assert gru._exponentials(logits, False)[1] == pytest.approx([500 + np.log1p(np.exp(-1)), -500 + np.log(2)], rel=1e-6)
