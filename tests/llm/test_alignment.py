import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lintlake.llm import alignment
from lintlake.llm.tokencounts import byte_signs
from lintlake.llm.wordids import vocabulary_path

SF_DIR = "/root/testdata/sf0.001"
ODD = [
    "", " ", "a", "  a", "a ", "a  b   c", "a\n b", " a\tb\r\n", "a\0b \x1c \x85 x", "x▁y z", "▁", "ﬁ é́ ½", "<|endoftext|> <s> </s> <unk> <0x41>",
    "日本語 テキスト 한국어　ไทย", "\U0001f600\U0001f600 zwj‍x ​", "x" * 3000, "ab " * 900, "'s don't I'll 12345 3.14", "a\xa0 b  c", "the the the the",
]


@pytest.fixture(scope="module")
def tokenizers():
    first = Tokenizer.from_file(vocabulary_path(alignment.FIRST))
    first.encode_special_tokens = True
    return first, SentencePieceProcessor(model_file=vocabulary_path(alignment.SECOND))


def naive(texts, tokenizers):
    """Each pair of tokens of a text compared: its numbers, its groups, and its linked ids."""
    first, second = tokenizers
    signs = {s: b for b, s in enumerate(byte_signs())}
    found = []
    for text in texts:
        text = text or ""
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text)
        bytes_a = [bytes(signs[c] for c in first.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            found.append(((0, 0, 0, 0, ""), []))
            continue
        ends_a, ends_b = np.cumsum(list(map(len, bytes_a))).tolist(), np.cumsum(list(map(len, bytes_b))).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        groups, before = [], 0
        for end in common:
            groups.append(
                ",".join(str(i) for i, e in zip(a, ends_a, strict=True) if before < e <= end)
                + "|"
                + ",".join(str(i) for i, e in zip(b, ends_b, strict=True) if before < e <= end)
            )
            before = end
        links = []
        for i, high, low in zip(a, ends_a, [0, *ends_a], strict=False):
            links += [(i, j) for j, h, lo in zip(b, ends_b, [0, *ends_b], strict=False) if lo < high and low < h]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        found.append(((len(a), len(b), len(common), len(links), digest), links))
    counts = Counter(pair for _, links in found for pair in links)
    high = Counter()
    for (_, j), n in counts.items():
        high[j] = max(high[j], n)
    return [(*n, sum(counts[p] == high[p[1]] for p in links), sum(counts[p] for p in links)) for n, links in found]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


@pytest.mark.parametrize("seed", range(20))
def test_gallop_finds_ranks_from_any_guess(seed):
    rng = np.random.default_rng(seed)
    long = np.unique(rng.integers(0, 500, rng.integers(1, 300)))
    short = np.unique(rng.integers(-5, 510, rng.integers(0, 200)))
    guess = rng.integers(-10, 600, len(short))
    assert alignment.gallop(short, long, guess).tolist() == np.searchsorted(long, short).tolist()


@pytest.mark.parametrize("seed", range(30))
def test_align_against_all_pairs(seed):
    rng = random.Random(seed)
    ends, firsts, every = ([], []), ([0], [0]), 0
    texts = []
    for _ in range(rng.randint(1, 6)):
        size = rng.randint(1, 40)
        lists = [sorted({*rng.sample(range(1, size + 1), rng.randint(1, size)), size}) for _ in range(2)]
        texts.append(lists)
        for k in range(2):
            ends[k].extend(every + e for e in lists[k])
            firsts[k].append(len(ends[k]))
        every += size
    group_a, group_b, link_a, link_b = alignment.align(*map(np.array, ends), *map(np.array, firsts))
    common = sorted(set(ends[0]) & set(ends[1]))
    assert group_a.tolist() == np.searchsorted(common, ends[0]).tolist()
    assert group_b.tolist() == np.searchsorted(common, ends[1]).tolist()
    low = [[0, *e] for e in ends]
    want = {(i, j) for i, a in enumerate(ends[0]) for j, b in enumerate(ends[1]) if low[0][i] < b and low[1][j] < a}
    assert sorted(zip(link_a.tolist(), link_b.tolist(), strict=True)) == sorted(want)


def test_segments_have_the_ids_of_the_whole_text(tokenizers):
    rng = random.Random(4)
    letters = "aabcdeé ,.'’  -_\n\t1½<>́ß日▁\x1c\xa0 🙂"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    encoder = alignment.Encoder(vocabulary_path(alignment.FIRST), vocabulary_path(alignment.SECOND))
    for text in texts:
        segments = encoder.encode([alignment._CUT.split(text) if text else []])[0]
        a, b = tokenizers[0].encode(" " + text, add_special_tokens=False).ids, tokenizers[1].encode(text)
        sound = bool(encoder.sound[segments].all())
        assert sound == ("▁" not in text)
        if text and sound:
            assert encoder.tokens(0, segments).tolist() == a, text
            assert encoder.tokens(1, segments).tolist() == b, text


def test_a_worker_that_starts_anew(monkeypatch, tokenizers):
    monkeypatch.setattr(alignment, "_KEPT", 3)
    aligner = alignment.Aligner(vocabulary_path(alignment.FIRST), vocabulary_path(alignment.SECOND))
    for text, row in zip(ODD, naive(ODD, tokenizers), strict=True):
        columns = alignment._document_columns(aligner, [text])
        assert tuple(c[0].as_py() for c in columns[:5]) == row[:5]


def test_whole_query(spark, tokenizers):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").toPandas()
    found = alignment.op11_token_alignment(spark, SF_DIR).toPandas()
    want = {(k, *row) for k, row in zip(docs.doc_id, naive(docs.text, tokenizers), strict=True)}
    assert set(found[["doc_id", *COLUMNS]].itertuples(index=False, name=None)) == want
    assert len(found) == len(docs)


@pytest.mark.parametrize("head,chunk", [(1 << 18, 1 << 19), (3, 20), (1, 500)])
def test_odd_rows(spark, monkeypatch, tokenizers, head, chunk):
    """Also with hardly any common pairs, and with texts in parts."""
    monkeypatch.setattr(alignment, "_HEAD", head)
    monkeypatch.setattr(alignment, "_CHUNK", chunk)
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, None, None), (None, "the a", None), (3, "the a", "y"), (3, "the a", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").selectExpr("*", "1 AS n_a", "2 AS pairs").repartition(2)
    frame = alignment.alignments(docs)
    found = [(r["doc_id"], *(r[c] for c in COLUMNS)) for r in frame.collect()]
    want = [(k, *row) for (k, *_), row in zip(rows, naive([t for _, t, _ in rows], tokenizers), strict=True)]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert alignment.alignments(docs.limit(0)).collect() == []
