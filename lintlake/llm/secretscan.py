"""Secrets in texts: fixed patterns, and strings that a text tokenizer can only spell out."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import by_batch, cached, table

# The base patterns and their least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12

# The added kind: strings of 16 characters and more of which a token holds at most so many characters, by the kinds of
# characters in them.  Of random strings of 16 to 64 characters under 2 % lie above the limit, words lie above it.
RANDOM = "random"
RANDOM_LEAST = 16
CHARS_PER_TOKEN = {
    # Kind: limit under 20 characters, and from there on.
    "lower": (2.0, 2.0), "upper": (2.0, 1.85), "digits": (2.9, 2.9), "letters": (1.8, 1.8), "hex": (2.3, 2.3), "mixed": (2.0, 1.86),
}

VOCABULARY = "byte_bpe_50k.tiktoken"

# Digests and identifiers that are public by nature: named digests, UUIDs, names made of words and numbers.
_NAMED = re.compile(
    r"(?:md5|sha-?(?:1|224|256|384|512)|crc32|blake[23][bs]?|digest|checksum|integrity|commit|revision|etag)"
    r"[\"']?\s*[:=\-/(]?\s*[\"']?$",
    re.IGNORECASE,
)
# Digests of 16 to 64 bytes, in hexadecimal digits or in base 64.
_DIGEST = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
    r"|[A-Za-z0-9+/]{22}==|[A-Za-z0-9+/]{27}=|[A-Za-z0-9+/]{43}=|[A-Za-z0-9+/]{64}|[A-Za-z0-9+/]{86}==)",
    re.IGNORECASE,
)
_UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
_WORDY = re.compile(r"[0-9]*+(?:[-_/=+]*+(?:[A-Z]?[a-z]{3,}+|[A-Z]{4,}+|[0-9]{1,8}+(?![A-Za-z0-9])))++[-_/=+]*+")
_MARKS = "-_/+="

Span = tuple[int, int, str]
Limits = dict[str, tuple[float, float]]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(path: str) -> Callable[[str], list[int]]:
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("texts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def base_spans(text: str) -> list[Span]:
    """`start, end, kind` of the fixed patterns, in order of start, then kind."""
    assign = cached("assign", lambda: re.compile(ASSIGN, re.IGNORECASE | re.ASCII))
    lowered = text.lower()
    found: list[Span] = []
    if any(word in lowered for word in ("passw", "secret", "token", "api")):
        found += [(*m.span(), KINDS[0]) for m in assign.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(*m.span(), KINDS[1]) for m in re.finditer(ACCESS, text)]
    found += [(*m.span(), KINDS[2]) for m in re.finditer(HEX, text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def random_spans(text: str, known: list[Span], encode: Callable[[str], list[int]], limits: Limits) -> list[Span]:
    """Strings of few characters per token.

    A string that lies within one of the `known` spans is none; one that reaches beyond is given whole.  UUIDs are cut
    out, and what stands beside them is tested by itself.
    """
    found: list[Span] = []
    for match in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text):
        at = match.start()
        for part in _UUID.sub(lambda m: " " * len(m.group()), match.group()).split(" "):
            start, end = at, at + len(part)
            at = end + 1
            if len(part) < RANDOM_LEAST or any(s <= start and end <= e for s, e, _ in known):
                continue
            if _DIGEST.fullmatch(part) and _NAMED.search(text[max(0, start - 24) : start]):
                continue
            # A fixed pattern within a longer run of letters and digits: all of the run is one string.
            longer = part.isalnum() and any(start <= s and e <= end for s, e, _ in known)
            if longer or _is_random(part, encode, limits):
                found.append((start, end, RANDOM))
    return found


def _is_random(word: str, encode: Callable[[str], list[int]], limits: Limits) -> bool:
    core = word.strip("-_=")
    plain = core.translate(str.maketrans("", "", _MARKS))
    if len(core) < RANDOM_LEAST or not plain:
        return False
    if all(ord(b) - ord(a) == 1 for a, b in zip(plain, plain[1:], strict=False)):
        return False  # an alphabet
    kind = _kind(plain)
    # Names of several words, with numbers: not where letters of one kind alone would always look like a word.
    if (kind not in ("lower", "upper") or plain != core) and _WORDY.fullmatch(word):
        return False
    return len(core) <= limits[kind][len(core) >= 20] * len(encode(core))


def _kind(word: str) -> str:
    if word.isdigit():
        return "digits"
    if word.isalpha():
        return "lower" if word.islower() else "upper" if word.isupper() else "letters"
    return "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", word) else "mixed"


def secret_spans(
    docs: DataFrame, *keep: str, text: str = "text", path: str | None = None, limits: Limits = CHARS_PER_TOKEN
) -> DataFrame:
    """The `keep` columns of each row with `base, spans`: arrays of (start, end, kind) in code points, end exclusive.

    `base` has the fixed patterns, `spans` these and the random strings.  A null or empty text has none.  The
    vocabulary is read by each Python worker from `path`, where it is installed like the library itself.
    """
    path = path or vocabulary_path()
    span = "array<struct<start: int, end: int, kind: string>>"
    fields = {f.name: f.dataType.simpleString() for f in docs.select(*keep).schema}
    schema = ", ".join([*(f"`{name}` {kind}" for name, kind in fields.items()), f"base {span}", f"spans {span}"])

    def batch(rows: pa.RecordBatch) -> dict:
        encode = cached(f"tiktoken {path}", lambda: _encoder(path))
        out: dict = {name: rows.column(i) for i, name in enumerate(fields)}
        out["base"], out["spans"] = [], []
        for value in rows.column(len(fields)):
            value = value.as_py() or ""
            known = base_spans(value)
            every = sorted(known + random_spans(value, known, encode, limits), key=lambda s: (s[0], (*KINDS, RANDOM).index(s[2])))
            for name, spans in (("base", known), ("spans", every)):
                out[name].append([{"start": s, "end": e, "kind": k} for s, e, k in spans])
        return out

    return by_batch(docs.select(*keep, F.col(text).alias("_text")), batch, schema)


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"), "doc_id")
    counts = [
        F.expr(f"CAST(size(filter(base, s -> s.kind = '{kind}')) AS LONG)").alias(f"n_{kind}") for kind in KINDS
    ]
    digest = F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, _joined("spans").alias("spans"))


# What a secret is replaced by, and rows that are held as Python strings at once.
MARK = "[SECRET]"
_ROWS = 256


def redacted(text: str | None, encode: Callable[[str], list[int]], limits: Limits = CHARS_PER_TOKEN) -> str | None:
    """The text with every secret replaced; of a pattern with a name only the value goes."""
    if text is None:
        return None
    known = base_spans(text)
    cut: list[tuple[int, int]] = []
    for start, end, kind in known + random_spans(text, known, encode, limits):
        if kind == KINDS[0]:
            start = re.compile(ASSIGN, re.IGNORECASE | re.ASCII).match(text, start).start(2)
        cut.append((start, end))
    out, at = [], 0
    for start, end in sorted(cut):
        if start >= at:
            out += [text[at:start], MARK]
        at = max(at, end)
    return "".join([*out, text[at:]]) if cut else text


def redact(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pipeline stage: every row stays, secrets are replaced in its text and `n_chars`, if there is one, is the new length.

    Rows without a secret keep `n_chars` as it was.
    """
    path = path or vocabulary_path()
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        encode = cached(f"tiktoken {path}", lambda: _encoder(path))
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                texts = part.column(at).to_pylist()
                clean = [redacted(t, encode) for t in texts]
                columns = list(part.columns)
                columns[at] = pa.array(clean, part.schema.field(at).type)
                if size is not None:
                    sizes = [n if c == t else len(c) for t, c, n in zip(texts, clean, part.column(size).to_pylist(), strict=True)]
                    columns[size] = pa.array(sizes, part.schema.field(size).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
