import zlib
from collections import Counter

import numpy as np
import pytest

from lintlake.llm import gru, lm

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def small():
    rng = np.random.default_rng(0)
    shape = gru.Shape(128, 5, 6)
    weights = gru.initial(shape, rng.integers(1, 50, 128).astype(float), rng.integers(1, 50, 5).astype(float))
    return shape, weights, rng


def test_gradients_are_those_of_the_loss(small):
    shape, weights, rng = small
    weights = {k: v.astype(np.float64) for k, v in weights.items()}
    token, target = rng.integers(0, 133, (2, 3, 7))
    fresh = np.zeros((3, 7), bool)
    fresh[0, 3] = fresh[1, 0] = True
    state = np.zeros((3, 6))
    found, _, _ = gru._gradients(weights, shape, state, token, target, fresh)
    for name, value in weights.items():
        for _ in range(4):
            at = tuple(int(rng.integers(0, s)) for s in value.shape)
            if name == "input":
                at = (int(token[0, 0]), at[1])
            losses = []
            kept = value[at]
            for step in (1e-5, -1e-5):
                value[at] = kept + step
                losses.append(gru._gradients(weights, shape, state, token, target, fresh)[1])
            value[at] = kept
            assert (losses[0] - losses[1]) / 2e-5 / 21 == pytest.approx(found[name][at], abs=1e-5, rel=1e-3)


def test_probabilities_sum_to_one(small):
    shape, weights, rng = small
    state = rng.normal(0, 1, (1, 6)).astype(np.float32)
    every = np.arange(shape.words + shape.others)
    logs = gru.log_likelihood(weights, shape, np.repeat(state, len(every), 0), every)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_score_is_the_same_alone_and_among_others(small):
    shape, weights, rng = small
    texts = [rng.integers(0, 133, n) for n in (1, 5, 31, 32, 33, 100, 0, 64)]
    together = gru.score(weights, shape, texts)
    alone = [gru.score(weights, shape, [t])[0] for t in texts]
    assert together == pytest.approx(alone, rel=1e-5)
    # Token by token, with the state carried through the whole text.
    for text, found in zip(texts, together, strict=True):
        h, before, total = np.zeros((1, 6), np.float32), shape.start, 0.0
        for token in text:
            h, _ = gru._step(weights, h, np.array([before]))
            total += gru.log_likelihood(weights, shape, h, np.array([token]))[0]
            before = token
        assert found == pytest.approx(total, rel=1e-5, abs=1e-6)


def test_training_learns_an_order(small):
    shape, weights, _ = small
    texts = [np.array([1, 2, 3, 4, 5, 6, 7, 8] * 10) for _ in range(60)]
    before = gru.score(weights, shape, texts[:1])[0]
    after = gru.score(gru.train(weights, shape, texts, 20, 0.02, rows=4), shape, texts[:1])[0]
    assert after > 0.5 * before


def test_whole_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").toPandas()
    words = {k: (t or "").encode().lower().split() + [b""] for k, t in zip(docs.doc_id, docs.text, strict=True)}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in words}
    counts = Counter(w for k, ws in words.items() if not held[k] for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    rows = lm.op3_lm_scores(spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    for row in rows:
        own = words[row["doc_id"]]
        base = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        assert (row["held_out"], row["n_tokens"]) == (held[row["doc_id"]], len(own))
        assert (row["n_known"], row["train_tokens"]) == (sum(w in counts for w in own), total)
        assert row["base_score"] == pytest.approx(base, rel=1e-9)
        assert row["score"] < 0
    unseen = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_head_and_joined_words_give_the_same_scores(spark):
    """The head only decides where a count is looked up."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 37}" for k in range(1, 40))) for i in range(30)], "doc_id long, text string")
    training = docs.filter("doc_id < 20")
    found = []
    for head in (64, 10_000):
        settings = lm.Settings(words=64, others=4, hidden=8, head=head, rounds=1)
        rows = lm.log_scores(docs, training, settings).collect()
        found.append({r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in rows})
    for key in found[0]:
        assert found[0][key] == pytest.approx(found[1][key], rel=1e-9)


def test_shares_of_other_classes_sum_to_one(spark):
    docs = spark.createDataFrame([(i, f"ab{i} ab{i % 7} zz{i % 3} c d e") for i in range(200)], "doc_id long, text string")
    counts = lm.count_words(docs)
    known = lm.vocabulary(counts, lm.Settings(words=64, others=3, head=64))
    rows = counts.collect()
    inside = Counter()
    for row in rows:
        word = row["word"].encode()
        number = known.index.get(word, -1)
        if number < 0 or known.ids[number] >= known.shape.words:
            inside[known.other(word) - known.shape.words] += row["n"]
    assert [inside[i] for i in range(3)] == known.other_counts.tolist()
    assert known.tokens == sum(r["n"] for r in rows)


def test_what_is_learnt_from_grows_with_the_corpus():
    chosen = [lm.Settings().chosen(10**k) for k in range(3, 13)]
    assert all(3 * a < b for a, b in zip(chosen, chosen[1:], strict=False))


def test_mean_of_many_models(spark):
    rng = np.random.default_rng(5)
    models = [(int(rng.integers(1, 9)), {"a": rng.normal(size=(3, 2)), "b": rng.normal(size=4)}) for _ in range(300)]
    rows = [(i, n, lm._saved({k: v * n for k, v in w.items()})) for i, (n, w) in enumerate(models)]
    mean = lm._mean(spark.createDataFrame(rows, "shard long, tokens long, weights binary").repartition(5), len(rows))
    total = sum(n for n, _ in models)
    for name in ("a", "b"):
        assert mean[name] == pytest.approx(sum(w[name] * n for n, w in models) / total, rel=1e-5, abs=1e-6)


def plain_score(w, shape, known, counts, text):
    """The model's probability of a text, token by token."""
    ids = lm.model_ids(text, known)[1]
    words = [*(text or b"").lower().split(), b""]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    n, h, before, total = shape.hidden, np.zeros(shape.hidden), shape.start, 0.0
    for token, word in zip(ids.tolist(), words, strict=True):
        into, recurrent = w["input"][before], h @ w["state"]
        update, reset = sigmoid(into[:n] + recurrent[:n]), sigmoid(into[n : 2 * n] + recurrent[n : 2 * n])
        fresh = np.tanh(into[2 * n :] + reset * recurrent[2 * n :])
        h = update * h + (1 - update) * fresh
        logits = np.exp(h @ w["class"] + w["class_bias"])
        probability = logits[gru.class_of(np.array([token]), shape)[0]] / logits.sum()
        if token < shape.words:
            c = token // gru.CLASS * gru.CLASS
            inside = np.exp(w["word"][c : c + gru.CLASS] @ h + w["word_bias"][c : c + gru.CLASS])
            probability *= inside[token - c] / inside.sum()
        else:
            mine = [x for x in counts if known.index.get(x, -1) < 0 or known.ids[known.index[x]] >= shape.words]
            mine = [x for x in mine if known.other(x) == token]
            probability *= (counts.get(word, 0) + 0.5) / (sum(counts[x] for x in mine) + 0.5 * (len(mine) + 1))
        total += np.log10(probability)
        before = token
    return total


def test_score_against_a_plain_loop(spark):
    docs = [(i, " ".join(f"w{(i * k) % 91}" for k in range(1, 30 + i % 50)) + " End") for i in range(60)] + [(60, None), (61, "new words here")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    training = frame.filter("doc_id < 40")
    settings = lm.Settings(words=64, others=5, hidden=8, head=70, shard=300)
    counts = {r["word"].encode(): r["n"] for r in lm.count_words(training).collect()}
    known = lm.vocabulary(lm.count_words(training), settings)
    weights = lm.learn(training, known, settings)
    found = {r["doc_id"]: r["score"] for r in lm.log_scores(frame, training, settings).collect()}
    for key, text in docs:
        assert found[key] == pytest.approx(plain_score(weights, known.shape, known, counts, (text or "").encode()), rel=1e-4)
