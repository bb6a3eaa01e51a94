import random

import numpy as np
import pytest
import xxhash

from lintlake.llm import simhash
from lintlake.llm.graph import components

SF_DIR = "/root/testdata/sf0.001"


def naive(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def roots(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in list(parent)}


def test_whole_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").toPandas()
    prints = {k: naive(t) for k, t in zip(docs.doc_id, docs.text, strict=True)}
    keys = list(prints)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i:] if (prints[a] ^ prints[b]).bit_count() <= 4]
    expected = {k: (f"{prints[k]:016x}", r) for k, r in roots(links).items()}
    found = simhash.op8_simhash_components(spark, SF_DIR).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == expected


@pytest.mark.parametrize("blocks", [None, 5, 6, 7, 8])
def test_links_of_dense_and_sparse_groups(spark, blocks):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {rng.getrandbits(64) for _ in range(300)}
    prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(400)}
    for p in list(prints)[:50]:
        prints.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.choice([4, 5]))))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    expected = roots([(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 4])
    found = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(frame, blocks=blocks).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    assert roots(found) == expected


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(1)
    for blocks in (5, 6, 7, 8):
        masks = [m % 2**64 for m in simhash.block_masks(blocks, 4)]
        for _ in range(500):
            change = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not change & m for m in masks)


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000 + 2 * i + 1) for i in range(100)] + [(5, 5)]
    frame = spark.createDataFrame(links, "a long, b long")
    found = {r["node"]: r["root"] for r in components(frame).collect()}
    assert found == {k: v for k, v in roots(links).items()}


def test_majority_of_very_many_shingles():
    words = " ".join(str(i) for i in range(70_000))
    import pyarrow as pa

    found = simhash._simhash(pa.array([words.encode(), b"a b", b""]), 4)
    assert found.tolist() == [naive(words), naive("a b"), 0]
    assert found.dtype == np.uint64


def firsts(texts):
    """The smallest keys of the groups of texts whose fingerprints are linked, each compared with each."""
    prints = {k: naive(t) for k, t in texts.items()}
    keys = sorted(prints)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i:] if (prints[a] ^ prints[b]).bit_count() <= 4]
    return {k for k, r in roots(links).items() if k == r}


def test_one_of_each_group_is_kept(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(2000)]
    docs = []
    for _ in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(60, 600))]
        for edits in (0, 0, 1, 2, 3, 6, 20):
            copy = list(text)
            for place in rng.sample(range(len(copy)), min(edits, len(copy))):
                copy[place] = rng.choice(words)
            docs.append(" ".join(copy))
    keys = rng.sample(range(10_000), len(docs))
    rows = [(k, t, "x") for k, t in zip(keys, docs, strict=True)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(5)
    kept = simhash.keep_one(frame).collect()
    wanted = firsts({k: t for k, t, _ in rows})
    assert sorted(r["doc_id"] for r in kept) == sorted(wanted)
    assert len(wanted) < len(rows) - 60
    assert {(r["doc_id"], r["text"], r["_row"]) for r in kept} <= set(rows)


def test_repeated_and_null_keys(spark):
    one, two = "a b c d e f", "some other text of quite other words"
    rows = [(3, one), (3, one), (None, one), (None, two), (None, two), (2, None), (2, ""), (5, " ")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r["doc_id"], r["text"] or "") for r in kept} == {(2, ""), (3, one), (None, two)}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 2), (False, 3), (True, 0)]
