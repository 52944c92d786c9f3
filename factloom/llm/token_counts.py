"""Operator 4: token counts, with overlap resynchronisation for huge documents.

A document of at most ``chunk`` characters is encoded whole. A larger one is encoded in chunks that overlap;
two neighbours are spliced at a boundary in the overlap that both encodings have *and* that no token can
cross in any context: a space after a sign that is neither space nor other white space, before a letter. For a
byte-level vocabulary with the public pattern the pre-tokens are cut there; for a sentence-piece
vocabulary it is proved from the pieces, none of which has a space mark after another sign. Without such a
boundary the overlap is doubled, in the end to the whole rest. So a count is exact, while what is encoded at a
time is bounded by the chunk.

Null texts are empty: 0 bytes, 0 tokens. Repeated rows stay repeated. Other columns are not read.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import bpe

CHUNK, OVERLAP = 1 << 16, 1 << 10
_encoders: dict[str, "Tokens"] = {}


class Tokens:
    """count(text) and ends(text): the character position after each token, -1 inside a character."""

    def count(self, text: str) -> int:
        raise NotImplementedError

    def ends(self, text: str) -> np.ndarray:
        raise NotImplementedError

    #: Whether a space between a solid sign and a letter is a boundary in every context.
    spaces_cut = False


def _characters(text: str) -> np.ndarray:
    """Character position of each byte position; -1 inside a character."""
    data = np.frombuffer(text.encode(), np.uint8)
    head = (data & 0xC0) != 0x80
    return np.append(np.where(head, np.cumsum(head) - 1, -1), len(text))


class ByteLevel(Tokens):
    """A byte-level BPE .json whose ids are its merge ranks: the same merges in the faster library, special strings included."""

    spaces_cut = True

    def __init__(self, path: str, pattern: str):
        import tiktoken

        merges = bpe.load(path)
        special = dict(merges.special)
        self.size = np.array([len(t) for t in merges.tokens], np.int64)
        ranks = {t: k for k, t in enumerate(merges.tokens) if k not in special.values()}
        self.own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = tuple(special)

    def _ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.own.encode(text, allowed_special="all")
        return self.own.encode_ordinary(text)

    def count(self, text: str) -> int:
        return len(self._ids(text))

    def ends(self, text: str) -> np.ndarray:
        return _characters(text)[np.cumsum(self.size[self._ids(text)])]


class Library(Tokens):
    """Any other tokenizers file, by the tokenizers library; splices only where its pre-tokens are cut at white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        self.spaces_cut = "ByteLevel" in (self.own.pre_tokenizer.__class__.__name__ if self.own.pre_tokenizer else "")

    def count(self, text: str) -> int:
        return len(self.own.encode(text, add_special_tokens=False).ids)

    def ends(self, text: str) -> np.ndarray:
        return np.array([e for _, e in self.own.encode(text, add_special_tokens=False).offsets], np.int64)


class Pieces(Tokens):
    """A sentence-piece model; the cut at spaces is proved from its vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.own.id_to_piece(k) for k in range(self.own.get_piece_size())]
        self.spaces_cut = not any("▁" in p.lstrip("▁") for p in pieces)

    def count(self, text: str) -> int:
        return len(self.own.encode(text, num_threads=1))

    def ends(self, text: str) -> np.ndarray:
        return _characters(text)[[p.end for p in self.own.encode(text, return_type="proto").pieces]]


def tokens(path: str) -> Tokens:
    """The counter of a vocabulary file; one in each process."""
    if path not in _encoders:
        _encoders[path] = Pieces(path) if path.endswith(".model") else _json(path)
    return _encoders[path]


def _json(path: str) -> Tokens:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, model = spec.get("pre_tokenizer") or {}, spec.get("model", {})
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer")
    if plain and model.get("type", "BPE") == "BPE" and not model.get("end_of_word_suffix") and not model.get("dropout"):
        merges = bpe.load(path)
        if np.all(np.diff(merges.made) > 0) and sorted(merges.byte_id.tolist()) == list(range(256)):
            import public_tokenizers

            return ByteLevel(path, public_tokenizers.PATTERN)
    return Library(path)


def stable(text: str, ends: np.ndarray, start: int) -> set[int]:
    """Absolute positions of token ends that no context can move."""
    found = set()
    for e in ends.tolist():
        if 0 < e < len(text) - 1 and text[e] == " " and not text[e - 1].isspace() and text[e + 1].isalpha():
            found.add(start + e)
    return found


def count_tokens(own: Tokens, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, encoded in overlapping chunks if it is longer than ``chunk``."""
    if len(text) <= chunk or not own.spaces_cut:
        return own.count(text)
    total, start, begin = 0, 0, 0  # begin: where the counted part ends, a stable boundary
    size = chunk
    while True:
        stop = min(len(text), start + size)
        left = own.ends(text[start:stop])
        first = int(np.flatnonzero(left == begin - start)[-1]) + 1 if begin > start else 0
        if stop == len(text):
            return total + len(left) - first
        wide = overlap
        while True:
            next_start = max(begin, stop - wide)
            ahead = min(len(text), stop + wide)
            right = own.ends(text[next_start:ahead])
            # The left chunk's end and the right chunk's start are the parts that lacked context.
            common = stable(text[start:stop], left[left > next_start - start], start) & stable(text[next_start:ahead], right, next_start)
            common = {c for c in common if begin < c < stop}
            if common:
                break
            if next_start <= begin:  # the overlap holds the whole chunk: take a larger one
                break
            wide *= 2
        if not common:
            size *= 2
            continue
        cut = max(common)
        total += int(np.flatnonzero(left == cut - start)[-1]) + 1 - first
        start, begin, size = max(0, cut - overlap), cut, chunk


def token_counts(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of every whole text."""

    def run(batches):
        own = tokens(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = np.array([count_tokens(own, t, chunk, overlap) for t in texts], np.int64)
            size = np.array([len(t.encode()) for t in texts], np.int64)
            yield pa.record_batch([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["key", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
