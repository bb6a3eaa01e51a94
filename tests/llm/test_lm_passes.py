"""Every text is trained on as often, whatever the size of the corpus."""

from collections import Counter

import numpy as np
import pytest

from lintlake.llm import gru, lm


@pytest.mark.parametrize("rounds", [3, 5])
@pytest.mark.parametrize("passes", [1, 2, 3])
def test_every_text_is_trained_on_in_every_size(spark, monkeypatch, rounds, passes):
    docs = spark.createDataFrame([(i, f"w{i} a b") for i in range(60)], "doc_id long, text string")
    settings = lm.Settings(words=64, others=4, hidden=8, head=70, shard=300, rounds=rounds)
    monkeypatch.setattr(lm.Settings, "passes", lambda self, tokens: passes)
    known = lm.vocabulary(lm.count_words(docs), settings)
    seen, turns = Counter(), Counter()

    def kept(rows, known, weights, rate, number):
        for r in rows.collect():
            seen[bytes(r.text)] += r.times
            turns[bytes(r.text)] += 1

    monkeypatch.setattr(lm, "_trained", kept)
    monkeypatch.setattr(lm, "_mean", lambda models, shards: None)
    lm.learn(docs, known, settings)
    assert seen == {f"w{i} a b".encode(): rounds for i in range(60)}
    assert set(turns.values()) == {passes}


def test_times_are_epochs_of_a_shard(spark):
    docs = spark.createDataFrame([(0, f"w{i % 7} a b", 3) for i in range(40)], "shard long, text string, times int")
    docs = docs.withColumn("text", docs.text.cast("binary"))
    settings = lm.Settings(words=64, others=4, hidden=8, head=70)
    known = lm.vocabulary(lm.count_words(docs), settings)
    weights = gru.initial(known.shape, known.word_counts, known.other_counts)
    found = lm._mean(lm._trained(docs, known, weights, 0.01, 5), 1)
    ids = [lm.model_ids(t, known)[1] for t in sorted(bytes(r.text) for r in docs.collect())]
    want = gru.train(weights, known.shape, ids, 3, 0.01, seed=5)
    for name in want:
        assert found[name] == pytest.approx(want[name], rel=1e-4, abs=1e-6)


def test_a_text_is_in_its_epochs_only(monkeypatch):
    shape = gru.Shape(64, 3, 4)
    weights = gru.initial(shape, np.ones(64), np.ones(3))
    seen, window = Counter(), gru._window
    monkeypatch.setattr(gru, "_window", lambda w, s, h, token, target, *rest: seen.update(target.ravel().tolist()) or window(w, s, h, token, target, *rest))
    gru.train(weights, shape, [np.full(64, 5), np.full(32, 6), np.full(0, 7), np.full(32, 8)], [3, 1, 2, 2], 0.01, rows=1)
    assert seen == {5: 3 * 64, 6: 32, 8: 2 * 32}
