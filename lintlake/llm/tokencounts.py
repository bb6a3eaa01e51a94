"""Token counts by byte-pair merging on ragged arrays: in a round every sequence merges its lowest-ranked pair."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import cached, table
from lintlake.llm.wordids import vocabulary_path

LIMIT = 2048

# Fixed value: the splitting of the vocabulary with word ends.  It drops white space, so texts can be cut there first.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Words of these characters are composed already, and their case folds letter by letter; the splitting of such words.
_PLAIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
_PLAIN_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t-\ra-zß-öø-ÿ0-9]+")
# Words and parts that a worker keeps before it starts anew.
_KEPT = 600_000
# Characters counted at once; a longer text goes alone.  Symbols merged side by side; longer sequences go alone, too.
_CHUNK = 1 << 20
_SYMBOLS = 1 << 20
_LONG = 1024
_NONE = np.iinfo(np.int32).max


def _too_long(word: str) -> bool:
    """Not worth remembering: such a word rarely comes again, and its text would fill the memory."""
    return len(word) > 256


class Merges:
    """The merge table of a byte-level vocabulary as sorted arrays.

    `single` marks merges whose product is part of an earlier merge: in a sequence only the leftmost such pair may be
    merged before ranks are looked at again.  All others can be merged at all their places at once, since what they make
    ranks behind them.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str = ""):
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in merges]
        self.size = max(vocabulary.values()) + 1
        left, right, made = (np.array([vocabulary[x] for x in xs], np.int64) for xs in zip(*((a, b, a + b) for a, b in pairs), strict=True))
        first_use = np.full(self.size, _NONE, np.int64)
        ranks = np.arange(len(pairs))
        np.minimum.at(first_use, left, ranks)
        np.minimum.at(first_use, right, ranks)
        self.made = made
        self.single = first_use[made] < ranks
        order = np.argsort(left * self.size + right, kind="stable")
        self.keys = (left * self.size + right)[order]
        self.ranks = order
        signs = byte_signs()
        missing = [s for s in signs if s not in vocabulary or s + suffix not in vocabulary]
        if missing:
            raise ValueError(f"not a byte-level vocabulary: {missing[:5]} are not in it")
        self.inner = np.array([vocabulary[s] for s in signs], np.int64)
        self.final = np.array([vocabulary[s + suffix] for s in signs], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, `_NONE` where it is none."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)

    def lengths(self, sequences: list[bytes]) -> np.ndarray:
        """How many symbols each byte sequence has in the end."""
        sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
        found = np.zeros(len(sequences), np.int64)
        for row in np.flatnonzero(sizes > _LONG):
            found[row] = self._long(self._symbols([sequences[row]], sizes[row : row + 1]))
        short = np.flatnonzero((sizes > 0) & (sizes <= _LONG))
        part = np.cumsum(sizes[short]) // _SYMBOLS
        for rows in np.split(short, np.flatnonzero(np.diff(part)) + 1):
            if len(rows):
                found[rows] = self._ragged(self._symbols([sequences[i] for i in rows.tolist()], sizes[rows]), sizes[rows])
        return found

    def _symbols(self, sequences: list[bytes], sizes: np.ndarray) -> np.ndarray:
        every = np.frombuffer(b"".join(sequences), np.uint8)
        symbols = self.inner[every]
        last = np.cumsum(sizes) - 1
        symbols[last] = self.final[every[last]]
        return symbols

    def _ragged(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Rounds over all sequences; one that has no pair of the table any more leaves with its length."""
        found = sizes.copy()
        rows = np.arange(len(sizes))  # sequences still at work
        while len(rows):
            owner = np.repeat(np.arange(len(rows)), sizes)
            rank = np.full(len(symbols), _NONE, np.int64)
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inside] = self.rank(symbols[inside], symbols[inside + 1])
            lowest = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes)
            hit = np.flatnonzero((rank == lowest[owner]) & (rank != _NONE))
            hit = hit[self._taken(hit, hit[1:] == hit[:-1] + 1, owner[hit], rank[hit])]
            symbols[hit] = self.made[rank[hit]]
            sizes = sizes - np.bincount(owner[hit], minlength=len(rows))
            going = lowest != _NONE
            found[rows[~going]] = sizes[~going]
            keep = going[owner]
            keep[hit + 1] = False
            symbols, sizes, rows = symbols[keep], sizes[going], rows[going]
        return found

    def _taken(self, hit: np.ndarray, chained: np.ndarray, owner: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Which hits merge now: of overlapping ones every second from the left, of single ones the first of a sequence."""
        place = np.arange(len(hit))
        fresh = np.concatenate([[True], ~chained])[: len(hit)]
        taken = (place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0
        first = np.concatenate([[True], owner[1:] != owner[:-1]])[: len(hit)]
        return taken & (first | ~self.single[rank])

    def _long(self, symbols: np.ndarray) -> int:
        """The same rounds over one long sequence: places are kept by rank, so a round only touches those of its pair."""
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n + 1, _NONE, np.int64)
        rank[: n - 1] = self.rank(symbols[:-1], symbols[1:])
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[rank[at] != _NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            for part in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1) if len(at) else []:
                own = int(rank[part[0]])
                if own not in places:
                    heapq.heappush(ranks, own)
                places.setdefault(own, []).append(part)

        put(np.arange(n - 1))
        left = n
        while ranks:
            own = heapq.heappop(ranks)
            hit = np.unique(np.concatenate(places.pop(own)))
            hit = hit[rank[hit] == own]
            if not len(hit):
                continue
            taken = self._taken(hit, after[hit[:-1]] == hit[1:], np.zeros(len(hit), np.int64), rank[hit])
            rest, hit = hit[~taken], hit[taken]
            gone = after[hit]
            symbols[hit] = self.made[own]
            rank[gone] = _NONE
            left -= len(hit)
            after[hit] = after[gone]
            inner = hit[after[hit] < n]
            before[after[inner]] = inner
            changed = np.unique(np.concatenate([hit, before[hit[before[hit] >= 0]]]))
            rank[changed] = _NONE
            paired = changed[after[changed] < n]
            rank[paired] = self.rank(symbols[paired], symbols[after[paired]])
            put(np.concatenate([changed, rest[rank[rest] == own]]))
        return left


def byte_signs() -> list[str]:
    """The character that byte-level vocabularies write for each byte: printable Latin-1 as it is, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Counter:
    """Numbers of tokens as the library gives them: it normalizes and splits, the merges are done here.

    Special strings are one token each wherever they occur.  With the splitting `WORD_SPLIT` texts are cut at blanks,
    and words and their parts are remembered; with any other a text is taken whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        config = json.loads(Path(path).read_text(encoding="utf-8"))
        model = config["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} is not a plain byte-pair vocabulary")
        special = config["added_tokens"]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
            raise ValueError(f"{path} has special strings that depend on their surroundings")
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        names = sorted((t["content"] for t in special), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names)) if names else "(?!)")
        self.by_word = WORD_SPLIT in json.dumps(config["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\")
        self.by_word &= not any(c.isspace() for name in names for c in name)
        self.bytes_of = str.maketrans({sign: chr(b) for b, sign in enumerate(byte_signs())})
        self._reset()

    def _reset(self) -> None:
        self.words: dict[str, int] = {}
        self.parts: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self._learnt(texts)
        if len(self.words) > _KEPT or len(self.parts) > _KEPT:
            self._reset()
        cut = [t.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ") for t in texts]
        new = list(set(chain.from_iterable(cut)).difference(self.words))
        self.words.update(zip(new, self._learnt(new), strict=True))
        counts = [sum(map(self.words.__getitem__, words)) for words in cut]
        for word in filter(_too_long, new):
            del self.words[word]
        return counts

    def _learnt(self, words: list[str]) -> list[int]:
        split = [self._split(w) for w in words]
        known = self.parts if self.by_word else {}
        known[""] = 1
        new = list(set(chain.from_iterable(split)).difference(known))
        known.update(zip(new, self.merges.lengths([p.encode() for p in new]).tolist(), strict=True))
        counts = [known[parts[0]] if len(parts) == 1 else sum([known[p] for p in parts]) for parts in split]
        for part in filter(_too_long, new):
            del known[part]
        return counts

    def _split(self, text: str) -> list[str]:
        """The parts that are merged each by itself; a special string is an empty part, and one token."""
        if not self.special.search(text):
            return self._parts(text)
        found, at = [], 0
        for match in self.special.finditer(text):
            found += [*self._parts(text[at : match.start()]), ""]
            at = match.end()
        return found + self._parts(text[at:])

    def _parts(self, text: str) -> list[str]:
        if self.by_word and _PLAIN.fullmatch(text):
            return _PLAIN_SPLIT.findall(text.lower())
        normal = self.normalizer.normalize_str(text) if self.normalizer else text
        return [p.translate(self.bytes_of).encode("latin-1").decode() for p, _ in self.splitter.pre_tokenize_str(normal)]


def count_tokens(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT
) -> DataFrame:
    """`key, n_bytes, n_tokens, over_limit` for every row.

    Without begin, end or other added tokens; special strings in a text count as one token.  A null or empty text has
    zero of both.  Repeated rows and rows with a null key are counted each; other columns are not looked at.  Texts
    of any length are counted whole.
    """
    path = path or vocabulary_path()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = cached(f"counter {path}", lambda: Counter(path))
        for batch in batches:
            keys, texts = batch.columns
            sizes = pc.fill_null(pc.binary_length(texts.cast(pa.binary())), 0).cast(pa.int64())
            counts: list[int] = []
            while len(counts) < batch.num_rows:
                some, chars = [], 0
                while len(counts) + len(some) < batch.num_rows and chars <= _CHUNK:
                    some.append(texts[len(counts) + len(some)].as_py() or "")
                    chars += len(some[-1])
                counts += counter.count(some)
            n = np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays(
                [keys, sizes, pa.array(n), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
