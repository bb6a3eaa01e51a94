import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from lintlake.llm import packing
from lintlake.llm.wordids import Words, vocabulary_path

SF_DIR = "/root/testdata/sf0.01"


def placed(counts, capacity):
    """Sequences of (offset, length) after the plan."""
    made = packing.plan(counts, capacity)
    sequences = {}
    for length, n in counts.items():
        for k in range(n):
            first, copies, sequence, offset = [run for run in made.runs[length] if run[0] <= k][-1]
            place = offset + (k - first) % copies * length
            sequences.setdefault(sequence + (k - first) // copies, []).append((place, length))
    return made.sequences, sequences


@pytest.mark.parametrize("seed", range(40))
def test_plan_fills_every_sequence_without_gaps(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 4096])
    n = rng.choice([1, 7, 500])
    lengths = [rng.randint(1, capacity) if seed % 2 else min(capacity, 1 + int(rng.expovariate(8 / capacity))) for _ in range(n)]
    if seed % 5 == 0:
        lengths = [rng.choice([capacity // 2, capacity // 3, capacity // 2 + 1, 1]) for _ in range(n)]
    count, sequences = placed(Counter(lengths), capacity)
    assert set(sequences) == set(range(count))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * length > capacity for _, length in pieces) <= 2


def test_plan_is_as_good_as_fitting_one_by_one():
    rng = random.Random(2)
    lengths = [min(4096, 1 + int(rng.expovariate(1 / 900))) for _ in range(3000)]
    gaps = []
    for length in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= length]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - length)
        else:
            gaps.append(4096 - length)
    assert packing.plan(Counter(lengths)).sequences <= len(gaps) * 1.01


def test_large_counts_make_short_plans():
    counts = {length: 10**9 + length for length in range(1, 4097)}
    made = packing.plan(counts)
    assert sum(len(runs) for runs in made.runs.values()) < 20_000
    assert made.sequences * 4096 >= sum(k * n for k, n in counts.items())


@pytest.mark.parametrize(
    "text",
    [
        "", " ", "Don't stop 'til you're... \"quoted\" it's", "a\tb\nc d\xa0e　f", "ÀÉÎ straße İstanbul ǅ", "é x̸= ≠",
        "<|endoftext|> <|startoftext|>x", "....,,,;;; a.b.c a--b #### 123 4567 ½ ² ٣", "\U0001f600\U0001f600 zwj‍x ​", "word, word. word! (word) [word] word",
        "'s 's's don''t '. .' ***'s", "ΟΔΟΣ ὈΔΥΣΣΕΎΣ", "日本語 テキスト 한국어 ไทย", "\x00\x01\x0b\x0c\x1c\x85x",
    ],
)
def test_ids_are_those_of_the_tokenizer(text):
    plain = Tokenizer.from_file(vocabulary_path())
    own = Words(vocabulary_path())
    ids, sizes = own.encode([text, "again " + text, text])
    expected = [plain.encode(t, add_special_tokens=False).ids for t in (text, "again " + text, text)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == expected


def test_ids_of_random_strings():
    rng = random.Random(8)
    letters = "aabcdeé ,.'’-_\n\t1½<>≠́ßİſ日"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    plain = Tokenizer.from_file(vocabulary_path())
    ids, sizes = Words(vocabulary_path()).encode(texts)
    found = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    for text, got, want in zip(texts, found, plain.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got == want.ids, text


def test_whole_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").toPandas()
    plain = Tokenizer.from_file(vocabulary_path())
    found = packing.op2_packed_sequences(spark, SF_DIR).toPandas()
    expected = set()
    for key, text in zip(docs.doc_id, docs.text, strict=True):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            expected.add((key, piece, start, len(part), zlib.crc32(part.tobytes())))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert set(found[columns].itertuples(index=False, name=None)) == expected
    assert len(found) == len(expected)
    for _, rows in found.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == [0, *rows.length.cumsum()[:-1]]
        assert rows.length.sum() <= 4096
    assert found.sequence_id.nunique() <= 1.01 * found.length.sum() / 4096 + 1
