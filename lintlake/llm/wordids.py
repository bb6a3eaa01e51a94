"""Token ids of whole texts by a public tokenizer, each distinct word encoded once per worker."""

from __future__ import annotations

import re
from itertools import chain
from unicodedata import is_normalized

import numpy as np

from lintlake.llm.common import cached

VOCABULARY = "word_bpe_49k.json"

# Words kept by a worker; beyond it starts anew.
_KEPT = 600_000
# A lower-case word of Latin letters, then marks: neither half can join the other in normalising or splitting.
_PARTS = re.compile(r"([a-zß-öø-ÿ]+)([!\"#$%&()*+,\-./:;?@\[\\\]^_`{|}~]*)")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words:
    """Ids of words between blanks, tabs and line ends; the tokenizer itself drops white space and the case.

    Its splitting never joins what white space parts, so a text's ids are those of its words one after another.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, np.uint16 if len(self.last) <= 1 << 16 else np.uint32)
        self.ends = np.zeros(1 << 18, np.int64)
        self.used = 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and how many each text has."""
        if len(self.number) > _KEPT:
            self._reset()
        words = [_folded(t.replace("\n", " ").replace("\t", " ")).split(" ") for t in texts]
        new = set(chain.from_iterable(words)).difference(self.number)
        if new:
            self._learn(new)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        starts, lengths = self._places(at)
        per_text = np.add.reduceat(np.append(lengths, 0), np.cumsum(sizes) - sizes) if len(texts) else lengths
        return self.ids[ranges(starts, lengths)], per_text

    def _places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.where(at > 0, self.ends[at - 1], 0)
        return starts, self.ends[at] - starts

    def _learn(self, words: set[str]) -> None:
        cores = [w for w in words if w.isascii() and w.isalpha()]
        others = words.difference(cores)
        parts = {w: m.groups() for w in others if (m := _PARTS.fullmatch(w))}
        whole = [w for w in others if w not in parts]
        self._learn_cores([*cores, *(w for w, (_, marks) in parts.items() if not marks)])
        self._add(whole, [e.ids for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)])
        joined = [w for w, (_, marks) in parts.items() if marks]
        self._learn_cores([p for p in {p for w in joined for p in parts[w]} if p not in self.number])
        pairs = np.array([self.number[p] for w in joined for p in parts[w]], np.int64)
        starts, lengths = self._places(pairs)
        self._extend(joined, self.ids[ranges(starts, lengths)], lengths.reshape(-1, 2).sum(1))

    def _learn_cores(self, cores: list[str]) -> None:
        """Every core is one piece to the tokenizer, and only its last id ends a word: many go in one call."""
        for start in range(0, len(cores), 4096):
            some = cores[start : start + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                self._extend(some, ids, np.diff(ends, prepend=0))
            else:
                self._add(some, [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)])

    def _add(self, words: list[str], ids: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self._extend(words, np.fromiter(chain.from_iterable(ids), np.int64, int(lengths.sum())), lengths)

    def _extend(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Takes up new words whose ids lie one after another."""
        count, used = len(self.number), self.used + len(ids)
        while count + len(words) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : used] = ids
        self.ends[count : count + len(words)] = self.used + np.cumsum(lengths)
        self.used = used
        self.number.update(zip(words, range(count, count + len(words)), strict=True))


def _folded(text: str) -> str:
    """In lower case, where the tokenizer would make the same of it: it composes first, and letter by letter."""
    lower = text.lower()
    if text.isascii():
        return lower
    safe = "\u03a3" not in text and is_normalized("NFC", text) and is_normalized("NFC", lower)
    return lower if safe else text


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    some = lengths > 0
    starts, lengths = starts[some], lengths[some]
    if not len(starts):
        return np.zeros(0, np.int64)
    step = np.ones(int(lengths.sum()), np.int64)
    first = np.cumsum(lengths) - lengths
    step[first[0]] = starts[0]
    step[first[1:]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)


def words(path: str) -> Words:
    return cached(f"words {path}", lambda: Words(path))
