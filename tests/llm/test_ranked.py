import random
import re
from math import floor, log

import numpy as np
import pytest

from lintlake.llm import ranked

MAX = 2**63 - 1


def naive(docs, items, top):
    """Every document scored for every item: (item, rank, doc, score)."""
    parts = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(key, parts(text)) for key, text in docs if parts(text)]
    count, length = len(held), sum(len(words) for _, words in held)
    found = []
    for item, text in items:
        scores = []
        for key, words in held:
            score = 0
            for term in set(parts(text)):
                df = sum(term in other for _, other in held)
                m = 50 + 50 * len(words) * count // length
                if df:
                    tf = words.count(term)
                    score += floor(1000 * log((2 * count + 2) / (2 * df + 1))) * (1000000000 * tf // (1000 * tf + 20 * m))
            if score:
                scores.append((-score, key is None, key or 0, key))
        found += [(item, rank, key, -score) for rank, (score, _, _, key) in enumerate(sorted(scores)[:top], 1)]
    return found


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("postings,rows", [(ranked._POSTINGS, 256), (40, 7)])
def test_against_every_score(monkeypatch, seed, postings, rows):
    """Index and search alone, over one index and over many small ones."""
    monkeypatch.setattr(ranked, "_POSTINGS", postings)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    weights = np.array([rng.choice([0, 1, 50, 900, 4000]) for _ in vocabulary])
    held = [sorted(rng.sample(range(30), rng.randint(0, 12))) for _ in range(200)]
    held += [held[3]] * 40
    times = [[rng.choice([1, 1, 2, 9]) for _ in ids] for ids in held]
    m = np.array([rng.randint(50, 60) for _ in held])
    keys = rng.sample(range(1000), len(held))
    wanted = np.array(sorted(rng.sample(range(30), 9)))
    top = ranked.Best(13)
    for start in range(0, len(held), rows):
        part = slice(start, start + rows)
        some = [i for i in range(len(held))[part] if held[i]]
        if some:
            index = ranked.Index(
                np.ma.array([keys[i] for i in some]), np.cumsum([len(held[i]) for i in some]), np.concatenate([held[i] for i in some]),
                np.concatenate([times[i] for i in some]), m[some], weights,
            )
            index.search(wanted, top)
    scores = []
    for key, ids, tf, size in zip(keys, held, times, m.tolist(), strict=True):
        score = sum(int(weights[i]) * (1_000_000_000 * t // (1000 * t + 20 * size)) for i, t in zip(ids, tf, strict=True) if i in wanted)
        if score:
            scores.append((-score, key))
    assert list(zip((-top.score).tolist(), top.doc.tolist(), strict=True)) == sorted(scores)[:13]


def test_range_maxima():
    rng = np.random.default_rng(3)
    terms = np.repeat(np.arange(4), [1, 70, 200, 3])
    owner = np.concatenate([np.sort(rng.permutation(200)[:n]) for n in (1, 70, 200, 3)])
    order = np.lexsort((terms, owner))
    docs = np.unique(owner)
    index = ranked.Index(
        np.ma.array(docs), np.cumsum(np.bincount(owner)), terms[order], rng.integers(1, 5, len(terms)), np.full(len(docs), 60), np.array([5, 7, 3, 9])
    )
    for _ in range(300):
        term = rng.integers(0, 4)
        low, high = sorted(rng.integers(index.starts[term], index.starts[term + 1] + 1, 2))
        if low < high:
            at = index.maximum(np.array([low]), np.array([high]))[0]
            assert low <= at < high
            assert index.impact[at] == index.impact[low:high].max()


def test_few_documents_are_scored():
    rng = np.random.default_rng(1)
    n = 20_000
    lists = [np.unique(np.concatenate([rng.zipf(1.6, 12) % 200, [250] if i % 997 == 0 else []])).astype(int) for i in range(n)]
    weights = np.concatenate([np.full(200, 900), np.full(60, 9000)])
    index = ranked.Index(np.ma.arange(n), np.cumsum(list(map(len, lists))), np.concatenate(lists), np.ones(sum(map(len, lists)), int), np.full(n, 100), weights)
    seen = []
    top = ranked.Best(10)
    put = top.put
    top.put = lambda score, doc: (seen.append(len(doc)), put(score, doc))
    index.search(np.array([1, 3, 250]), top)
    assert set(top.doc.tolist()) <= set(range(0, n, 997))
    assert sum(seen) < n / 20


ODD = [
    (1, "The cat, the CAT"), (1, "The cat, the CAT"), (2, None), (3, ""), (None, "cat sat"), (4, " -- \n"), (5, "é É x_y 1-2 \U0001f600"),
    (MAX, "cat sat"), (-3, "cat sat"), (6, "dog " * 5000 + "cat"), (None, None), (7, "x" * 300_000),
]
ITEMS = [(1, "cat SAT"), (1, "cat SAT"), (2, None), (3, ""), (None, "É dog dog"), (4, "nothing here"), (5, "x y 1 the"), (6, "--")]


@pytest.mark.parametrize("top", [3, 50])
def test_odd_rows(spark, monkeypatch, top):
    monkeypatch.setattr(ranked, "_BLOCK", 8)
    docs = spark.createDataFrame([(k, t, "x", 0) for k, t in ODD], "doc_id long, text string, terms string, n long").repartition(3)
    items = spark.createDataFrame([(k, t, 1) for k, t in ITEMS], "item_id long, text string, doc long")
    found = [tuple(r) for r in ranked.search(docs, items, top=top).collect()]
    assert sorted(found, key=repr) == sorted(naive(ODD, ITEMS, top), key=repr)


def test_empty_tables(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked.search(docs.limit(0), items).collect() == []
    assert ranked.search(docs, items.limit(0)).collect() == []
