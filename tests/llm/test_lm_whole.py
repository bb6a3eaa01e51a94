"""The language model is fitted on every training text."""

from lintlake.llm import lm


def test_every_text_is_trained_on(spark, monkeypatch):
    rows = [(i, f"w{i} a b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    settings = lm.Settings(words=64, others=4, hidden=8, head=70, shard=300, share=1)
    known = lm.vocabulary(lm.count_words(docs), settings)
    assert settings.passes(known.tokens) == 1
    rounds = []

    def kept(rows, known, weights, rate, number):
        rounds.append({bytes(r.text).decode() for r in rows.collect()})
        return None

    monkeypatch.setattr(lm, "_trained", kept)
    monkeypatch.setattr(lm, "_mean", lambda models, shards: None)
    lm.learn(docs, known, settings)
    assert len(rounds) == settings.rounds and sum(map(len, rounds)) == 400
    assert set().union(*rounds) == {text for _, text in rows}


def test_shards_are_bounded_and_small_corpora_are_seen_in_every_round():
    settings = lm.Settings()
    assert settings.passes(100_000) == settings.rounds and settings.passes(10**8) == 1
    for k in range(3, 12):
        tokens = 10**k
        each = tokens * settings.passes(tokens) / settings.rounds / settings.shards(tokens)
        assert each <= 1.5 * settings.most
