import random
import re
from itertools import combinations

import numpy as np
import pytest

from lintlake.llm import decontam

SF_DIR = "/root/testdata/sf0.01"
WORDS = [f"w{i}" for i in range(3000)]


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))


def test_tokens_are_runs_of_letters_and_digits():
    text = "Ab, é-c\n\x00 日本 d1  Ab"
    hashes, starts = decontam.token_hashes(np.frombuffer(text.encode(), np.uint8))
    expected = words(text)
    assert len(hashes) == len(expected)
    assert len(set(hashes.tolist())) == len(set(expected))
    assert hashes[0] == hashes[-1]
    assert text.encode()[starts[-1] :] == b"Ab"


def test_masks_catch_two_substitutions_in_sixteen_tokens():
    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(300):
        item = rng.integers(0, 1 << 62, 20).astype(np.uint64)
        text = item.copy()
        text[rng.choice(20, 2, replace=False)] += np.uint64(1)
        missed += not any((decontam.seed_hashes(item, m) == decontam.seed_hashes(text, m)).any() for m in range(len(decontam.MASKS)))
    assert missed == 0


@pytest.mark.parametrize("seed", range(20))
def test_overlap_is_the_longest_that_agrees(seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2, 40).astype(np.uint64)
    b = np.where(rng.random(40) < 0.75, a, a + np.uint64(5))
    settings = decontam.Settings()
    first, end, equal = decontam.overlap(a, b, settings)
    same = a == b
    longest = max((j - i for i in range(40) for j in range(i, 41) if same[i:j].sum() >= 0.8 * (j - i)), default=0)
    assert equal == same[first:end].sum()
    assert equal >= 0.8 * (end - first) - 1e-9
    # Ends that differ are trimmed.
    assert end - first <= longest
    assert end - first >= longest - 2 or longest == 0 or not same[first : first + longest].all()


def test_planted_passages(spark):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(30))) for i in range(20)] + [(100, "nine little words that make up a whole item")]
    docs = []
    for i in range(200):
        text = [rng.choice(WORDS) for _ in range(rng.randint(20, 200))]
        kind = i % 4
        if kind == 1:
            text[5:5] = items[i % 20][1].upper().split()
        elif kind == 2:
            part = items[i % 20][1].split()
            for place in rng.sample(range(30), 3):
                part[place] = "other"
            text[7:7] = part
        elif kind == 3:
            text[9:9] = items[i % 20][1].split()[:8]
        docs.append((i, " ".join(text)))
    docs.append((1000, "so nine little words, that make up a WHOLE item."))
    docs.append((1001, "so nine little words that make up a whole thing"))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = decontam.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(r["doc"], r["item"]) for r in found}
    assert pairs == {(i, i % 20) for i in range(200) if i % 4 in (1, 2)} | {(1000, 100)}
    assert all(r["equal"] >= 0.8 * 16 or r["item"] == 100 for r in found)


def test_whole_query_finds_every_verbatim_item_and_no_clean_text(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").toPandas()
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").toPandas()
    found = {(r["doc_id"], r["item_id"]) for r in decontam.op10_benchmark_overlaps(spark, SF_DIR).collect()}
    texts = {k: " ".join(words(t)) for k, t in zip(docs.doc_id, docs.text, strict=True)}
    wanted = {k: words(t) for k, t in zip(items.item_id, items.text, strict=True)}
    whole = {(d, i) for d, t in texts.items() for i, w in wanted.items() if len(w) >= 8 and " ".join(w) in t}
    assert whole <= found
    for d, i in found - whole:
        grams = {tuple(wanted[i][k : k + 3]) for k in range(len(wanted[i]) - 2)}
        own = texts[d].split()
        assert sum(tuple(own[k : k + 3]) in grams for k in range(len(own) - 2)) >= 5


def missed(masks, length, places):
    """Choices of a fifth of `length` tokens, among `places`, that leave no room for a mask."""
    changed = np.array(list(combinations(places, length // 5)), np.int64)
    left = (np.int64(1) << changed).sum(1)
    for mask in masks:
        bits = sum(1 << i for i, c in enumerate(mask) if c == "1")
        for at in range(length - len(mask) + 1):
            left = left[left & np.int64(bits << at) != 0]
    return len(left)


# With as many substitutions, a longer stretch has all the room that a shorter one has; one of 32 or more has a half of 16.
@pytest.mark.parametrize("length", [16, 20, 25, 30])
def test_a_mask_fits_wherever_a_fifth_is_substituted(length):
    assert missed(decontam.MASKS, length, range(length)) == 0


@pytest.mark.parametrize("length", range(8, 16))
def test_a_mask_fits_in_a_short_item_wherever_a_fifth_is_substituted(length):
    assert missed(decontam.SHORT_MASKS, length, range(1, length - 1)) == 0


def test_substituted_passages(spark):
    rng = random.Random(8)
    sizes = [16] * 60 + [20] * 60 + [15] * 60 + [8] * 20
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(n))) for i, n in enumerate(sizes)]
    docs = []
    for i, item in items:
        part = item.split()
        inner = range(len(part)) if len(part) >= 16 else range(1, len(part) - 1)
        for place in rng.sample(inner, len(part) // 5):
            part[place] = "other"
        docs.append((i, " ".join(["before", *part, "after"])))
    docs.append((1000, " ".join([*items[0][1].split()[:12], "after"])))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = decontam.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc"], r["item"]) for r in found} == {(i, i) for i, _ in items}


def test_rows_go_by_their_own_text(spark):
    passage = " ".join(f"word{i}" for i in range(40))
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows = [(1, passage + " more", 0), (1, "clean text", 1), (None, "before " + passage, 2), (None, "clean", 3), (2, None, 4), (3, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text_hash int").repartition(3)
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["_text_hash"] for r in kept.collect()) == [1, 3, 4, 5]
