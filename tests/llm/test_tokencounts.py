import random

import pytest
from tokenizers import Tokenizer

from lintlake.llm import tokencounts
from lintlake.llm.wordids import vocabulary_path

SF_DIR = "/root/testdata/sf0.001"
NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = [
    "", " ", "Don't stop 'til you're... \"quoted\" it's", "a<|endoftext|>b <|startoftext|>x<|EndOfText|><|endoftext|><|endoftext|>",
    "ΟΔΟΣ ὈΔΥΣΣΕΎΣ", "日本語 テキスト 한국어 ไทย", "\x00\x01\x0b\x0c\x1c\x85x \r\n", "x" * 5000, "ab" * 3000, "aab" * 900, "\U0001f600" * 700,
    "a\tb\nc d\xa0e　f", "ÀÉÎ straße İstanbul ǅ", "é x̸= ≠", "....,,,;;; a.b.c a--b #### 123 4567 ½ ² ٣", "'s 's's don''t '. .' ***'s",
    "ª º µ × ÷ ÿ Ÿ", "zwj‍x ​ é ́ ퟿",
]


def expected(name, texts):
    return [len(e.ids) for e in Tokenizer.from_file(vocabulary_path(name)).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", NAMES)
def test_counts_are_those_of_the_library(name):
    rng = random.Random(8)
    letters = "aabcdeé ,.'’-_\n\t1½<>≠́ßİſ日ÀΣ\x1c\x85 ×÷ªµ"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts.append("".join(rng.choice("abcdefghij") for _ in range(20_000)))
    counter = tokencounts.Counter(vocabulary_path(name))
    assert counter.count(texts) == expected(name, texts)
    assert counter.count(texts) == expected(name, texts)


def by_hand(merges, text):
    """Byte-pair merging one pair at a time: the lowest rank, and of it the leftmost."""
    ranks = {pair: i for i, pair in enumerate(merges)}
    symbols = list(text)
    while True:
        pairs = [(ranks.get(p, 10**9), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False))]
        rank, at = min(pairs, default=(10**9, 0))
        if rank == 10**9:
            return len(symbols)
        symbols[at : at + 2] = ["".join(merges[rank])]


@pytest.mark.parametrize("seed", range(30))
def test_any_order_of_merges(monkeypatch, seed):
    """Also tables in which a merge comes before those that make its parts."""
    rng = random.Random(seed)
    made, merges = list("abc"), []
    for _ in range(25):
        pair = (rng.choice(made), rng.choice(made))
        if pair not in merges and len("".join(pair)) < 9:
            merges.append(pair)
            made.append("".join(pair))
    if seed % 2:
        rng.shuffle(merges)
    signs = tokencounts.byte_signs()
    vocabulary = {s: i for i, s in enumerate(dict.fromkeys([*signs, *made]))}
    table = tokencounts.Merges(vocabulary, merges)
    texts = ["".join(rng.choice("aabc") for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["a" * 33, "ab" * 20]
    want = [by_hand(merges, t) for t in texts]
    assert table.lengths([t.encode() for t in texts]).tolist() == want
    monkeypatch.setattr(tokencounts, "_LONG", 0)
    assert table.lengths([t.encode() for t in texts]).tolist() == want


def test_a_worker_that_starts_anew(monkeypatch):
    monkeypatch.setattr(tokencounts, "_KEPT", 5)
    counter = tokencounts.Counter(vocabulary_path())
    for _ in range(3):
        assert [counter.count([t])[0] for t in ODD] == expected(NAMES[0], ODD)
    assert max(map(len, counter.words)) <= 256


def test_whole_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").toPandas()
    found = tokencounts.op12_token_counts(spark, SF_DIR).toPandas()
    texts = [t or "" for t in docs.text]
    counts = expected(NAMES[0], texts)
    want = {(k, len(t.encode()), n, n > 2048) for k, t, n in zip(docs.doc_id, texts, counts, strict=True)}
    assert set(found.itertuples(index=False, name=None)) == want
    assert len(found) == len(docs)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(tokencounts, "_CHUNK", 10)
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, None, None), (3, None, "y"), (3, "a b", "y"), (3, "a b", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(2)
    found = sorted(map(repr, map(tuple, tokencounts.count_tokens(docs, limit=3).collect())))
    counts = expected(NAMES[0], [t or "" for _, t, _ in rows])
    assert found == sorted(repr((k, len((t or "").encode()), n, n > 3)) for (k, t, _), n in zip(rows, counts, strict=True))
    assert tokencounts.count_tokens(docs.limit(0)).collect() == []
