import hashlib
import random

import numpy as np
import pytest

from lintlake.llm import substrings
from lintlake.llm.suffixes import SuffixBlocks, difference_cover, same_start, shifts


def naive(rows):
    """Marked bytes for every (key, text)."""
    first = {}
    for key, text in rows:
        for p in range(len(text) - 49):
            string = text[p : p + 50]
            first[string] = min(first.get(string, key), key)
    out = []
    for key, text in rows:
        marked = np.zeros(len(text), bool)
        for p in range(len(text) - 49):
            if first[text[p : p + 50]] < key:
                marked[p : p + 50] = True
        out.append(marked)
    return out


def expected_rows(rows):
    out = []
    for (key, text), marked in zip(rows, naive(rows), strict=True):
        edge = np.diff(np.concatenate([[0], marked.astype(int)]))
        kept = np.frombuffer(text, np.uint8)[~marked].tobytes() if text else b""
        out.append((key, len(text), int(marked.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("period", [4, 8, 16, 32, 64])
def test_cover_reaches_every_difference(period):
    cover = difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    table = shifts(period, cover)
    for i in range(period):
        for j in range(period):
            assert (i + table[i, j]) % period in cover
            assert (j + table[i, j]) % period in cover


@pytest.mark.parametrize("letters,repeat", [(b"a", 1), (b"ab", 1), (b"abcd", 1), (b"ab", 40), (bytes(range(256)), 1)])
@pytest.mark.parametrize("most", [1, 30, 10_000])
def test_blocks_are_in_suffix_order(letters, repeat, most):
    rng = random.Random(len(letters) + most)
    text = bytes(rng.choice(letters) for _ in range(1200 // repeat)) * repeat
    sort = SuffixBlocks(np.frombuffer(text, np.uint8))
    ordered = np.concatenate(list(sort.blocks(np.arange(len(text)), most)))
    assert sorted(ordered.tolist()) == list(range(len(text)))
    padded = text + bytes(300)
    keys = [padded[i : i + 64] for i in ordered]
    assert keys == sorted(keys)
    same = same_start(sort, ordered, 50)
    assert same.tolist() == [i > 0 and keys[i][:50] == keys[i - 1][:50] for i in range(len(keys))]


def test_fragments_hold_every_string_once():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (0, 10, 49, 50, 51, 400)] + [b"z" * 300]
    ends = np.cumsum([len(t) for t in texts])
    start, length, _ = substrings.fragments(np.frombuffer(b"".join(texts), np.uint8), ends)
    strings = [p for s, n in zip(start, length, strict=True) for p in range(s, s + n - 49)]
    expected = [p for e, t in zip(ends, texts, strict=True) for p in range(e - len(t), e - 49)]
    assert strings == expected


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [bytes(rng.choice(b"abcd ") for _ in range(rng.randint(30, 200))) for _ in range(8)]
    rows = []
    for key in range(60):
        parts = [rng.choice(pool)[rng.randint(0, 40) :] for _ in range(rng.randint(0, 5))]
        rows.append((key, b"".join(parts) + bytes(rng.choice(b"xyz") for _ in range(rng.randint(0, 80)))))
    rows += [(70, b"q" * 400), (71, b"q" * 120), (72, rows[3][1]), (72, rows[3][1]), (73, "é".encode() * 60), (74, "é".encode() * 26)]
    frame = spark.createDataFrame([(k, t.decode()) for k, t in rows], "doc_id long, text string").repartition(7)
    found = substrings.without_repeats(frame).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found) == expected_rows(rows)


def test_long_texts_are_cut_in_parts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "_CHUNK", 200)
    rng = random.Random(9)
    shared = bytes(rng.choice(b"abcd") for _ in range(700))
    rows = [(1, shared), (2, b"x" * 333 + shared[100:600]), (3, shared[:150] + b"y" * 90 + shared[400:])]
    held = list(substrings._segments(iter([_batch(rows)])))
    assert len(held) > 5
    got = {k: np.zeros(len(t), bool) for k, t in rows}
    blobs = {}
    for part in held:
        keys, tags, texts, offsets = zip(*part, strict=True)
        for bucket, blob in substrings._dealt(np.array(keys), np.array(tags), list(texts), np.array(offsets), 3):
            blobs.setdefault(bucket, []).append(blob)
    for bucket, some in blobs.items():
        found = substrings._marks(some, bucket < 0).to_pydict()
        for key, spans in zip(found["key"], found["spans"], strict=True):
            for a, b in np.frombuffer(spans, "<u4").reshape(-1, 2):
                got[key][a:b] = True
    for (key, _), marked in zip(rows, naive(rows), strict=True):
        assert (got[key] == marked).all()


def _batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in rows]), pa.array([0] * len(rows)), pa.array([t for _, t in rows], pa.binary())], names=["key", "tag", "text"]
    )


def test_whole_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    rows = [(k, (t or "").encode()) for k, t in zip(docs.doc_id, docs.text, strict=True)]
    found = substrings.op7_suffix_dedup(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found) == expected_rows(rows)
