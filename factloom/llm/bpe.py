"""Byte-level BPE over whole corpora blocks: vectorised pre-tokens and corpus-level merge replay.

The pre-tokens of a block of documents are found with array operations, reduced to distinct words,
and the merges are then replayed over the distinct words *together*: an inverted index holds, for
each token pair, the positions where it stands; the merges are applied in rank order, each to all its
positions at once, and only the two neighbours of a merged position enter new index entries. What has
been encoded stays in a bounded memo of the worker. Peak memory follows the block, not the partition.
"""

from __future__ import annotations

import base64
import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from factloom.llm import vectext as V

#: Text bytes whose distinct words are replayed together, and words that the memo of a worker may hold.
REPLAY_BYTES = 12 << 20
MEMO_WORDS = 800_000
#: Longer words are keyed by a 64-bit xxh3 hash, shorter ones by the block's 64-bit span hash; words are not compared by
#: bytes: among MEMO_WORDS of them, two share a key once in about 16 million workers' memos.
LONG_WORD = 256


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of bytes in byte-level vocabularies: bytes without a visible Latin-1 sign follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(c): b for c, b in [*((b, b) for b in shown), *((256 + k, b) for k, b in enumerate(rest))]}


class Merges:
    """Vocabulary and merges: ``tokens[id]`` bytes, ``keys``/``ids`` sorted pair keys and the id that each makes, in rank order."""

    def __init__(self, tokens: list[bytes], pairs: list[tuple[int, int, int]], special: dict[str, int]):
        self.tokens, self.special = tokens, special
        self.left = np.array([a for a, _, _ in pairs], np.int64)
        self.right = np.array([b for _, b, _ in pairs], np.int64)
        self.made = np.array([c for _, _, c in pairs], np.int32)
        keys = self.left << 20 | self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        known = {t: k for k, t in enumerate(tokens)}
        self.byte_id = np.array([known[bytes([b])] for b in range(256)], np.int32)
        #: Rank of each pair of single bytes, by 256 * (place of the first) + place of the second.
        self.byte_place = np.zeros(len(tokens), np.int32)
        self.byte_place[self.byte_id] = np.arange(256)
        self.byte_pairs = self.ranks(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the vocabulary has no such merge."""
        key = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.order[at], -1)


_loaded: dict[str, Merges] = {}


def load(path: str) -> Merges:
    """Merges of a .tiktoken rank file or of a byte-level BPE .json; read once in each process."""
    if path not in _loaded:
        _loaded[path] = _from_json(path) if path.endswith(".json") else _from_ranks(path)
    return _loaded[path]


def _from_ranks(path: str) -> Merges:
    """A rank file has no pairs: a token's pair is what the merges of lower rank leave of its bytes."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
    pairs = []
    for token in tokens:
        if len(token) == 1:
            continue
        parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
        while len(parts) > 2:
            best, at = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
            if best >= limit:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            pairs.append((ranks[parts[0]], ranks[parts[1]], ranks[token]))
    return Merges(tokens, pairs, {})


def _from_json(path: str) -> Merges:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    sign = _byte_alphabet()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
    vocab = {t: k for t, k in spec["model"]["vocab"].items() if t not in special}
    size = max([*vocab.values(), *special.values()]) + 1
    tokens = [b""] * size
    for t, k in vocab.items():
        tokens[k] = bytes(sign[c] for c in t)
    for t, k in special.items():
        tokens[k] = t.encode()
    pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])]
    return Merges(tokens, pairs, special)


def pretoken_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte starts of the pre-tokens of all documents of a block.

    The same cuts as the public pattern: a contraction after no space; runs of letters, of numbers, of
    other signs, each with one space before it; white space, of which the last sign before a solid
    one stands alone unless it is that space.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    points, at = V.code_points(data)
    kind = V.char_classes()[points]
    first = np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])  # first sign of each document that has any
    new = np.zeros(len(points) + 1, bool)
    new[first] = True
    new[-1] = True
    run = new[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    starts = run.copy()
    solid = np.flatnonzero(run & (kind != V.SPACE) & ~new[:-1])
    solid = solid[kind[solid - 1] == V.SPACE]
    starts[solid - 1] = True
    starts[solid[points[solid - 1] == 0x20]] = False
    quote = np.flatnonzero((points == 0x27) & starts)
    quote = quote[quote + 1 < len(points)]
    quote = quote[~new[quote + 1]]
    if len(quote):
        one, two = points[quote + 1], np.where(new[np.minimum(quote + 2, len(points))], 0, points[np.minimum(quote + 2, len(points) - 1)])
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for pair in ("re", "ve", "ll"):
            size[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
        quote, size = quote[size > 0], size[size > 0]
        starts[quote + 1] = False
        after = quote + 1 + size
        starts[after[after < len(points)]] = True
    return at[starts]


def replay(merges: Merges, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token ids of all words one after the other, tokens of each word) by replaying every merge in rank order."""
    words = len(starts)
    bounds = np.cumsum(lengths + 1)  # a stop sign follows each word
    sign = np.full(int(bounds[-1]) if words else 0, -1, np.int32)
    inner = np.ones(len(sign), bool)
    inner[bounds - 1] = False
    sign[inner] = merges.byte_id[data[V.ragged(starts, lengths)]]
    after = np.arange(1, len(sign) + 1, dtype=np.int32)
    before = np.arange(-1, len(sign) - 1, dtype=np.int32)
    index: dict[int, list[np.ndarray]] = defaultdict(list)

    def enter(rank: np.ndarray, where: np.ndarray) -> None:
        """Add positions to the index under the rank of the pair that starts there."""
        if len(rank) < 2:
            if len(rank) and rank[0] >= 0:
                index[int(rank[0])].append(where)
            return
        order = np.argsort(rank.astype(np.uint16) if len(merges.made) < 65_536 else rank, kind="stable")  # 16 bits: by radix
        rank, where = rank[order], where[order]
        cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        edges = [0, *cut.tolist(), len(rank)]
        for r, a, b in zip(rank[edges[:-1]].tolist(), edges[:-1], edges[1:], strict=True):
            if r >= 0:
                index[r].append(where[a:b])

    if len(sign) > 1:
        where = np.flatnonzero((sign[:-1] >= 0) & (sign[1:] >= 0)).astype(np.int32)
        if len(where):
            rank_of = merges.byte_pairs[merges.byte_place[sign[where]] * 256 + merges.byte_place[sign[where + 1]]]
            enter(rank_of[rank_of >= 0], where[rank_of >= 0])
    left, right, made = merges.left, merges.right, merges.made
    for rank in range(len(made)):  # a merge's product is part of later merges only
        entry = index.pop(rank, None)
        if entry is None:
            continue
        a, b, c = left[rank], right[rank], made[rank]
        where = entry[0] if len(entry) == 1 else np.concatenate(entry)
        where = where[sign[where] == a]
        follow = after[where]
        good = sign[follow] == b
        where = where[good]
        if not len(where):
            continue
        if a == b:  # of a run, each second position from its left end
            where = np.sort(where)
            chained = np.zeros(len(where), bool)
            chained[1:] = after[where[:-1]] == where[1:]
            head = np.flatnonzero(~chained)
            odd = (np.arange(len(where)) - np.repeat(head, np.diff([*head, len(where)]))) & 1
            where = where[odd == 0]
        follow = after[where]
        beyond = after[follow]
        sign[where] = c
        sign[follow] = -2
        after[where] = beyond
        before[beyond] = where
        nxt = sign[beyond]
        keep = nxt >= 0
        prev = before[where]
        behind = np.where(prev >= 0, sign[prev], -1)
        back = (behind >= 0) & (behind != c)
        new_at = np.concatenate([where[keep], prev[back]])
        if len(new_at):
            l = np.concatenate([np.full(int(keep.sum()), c, np.int32), behind[back]])
            r = np.concatenate([nxt[keep], np.full(int(back.sum()), c, np.int32)])
            rank_of = merges.ranks(l, r)
            some = rank_of >= 0
            if some.any():
                enter(rank_of[some], new_at[some])
    alive = sign >= 0
    total = np.cumsum(alive)
    ends = total[bounds - 1] if words else np.zeros(0, np.int64)
    return sign[alive], np.diff(np.concatenate([[0], ends]))


class Memo:
    """Ids of words by 64-bit key: sorted keys, and spans of one flat id array. Forgotten as a whole when full."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys, self.start, self.count, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 if unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, keys: np.ndarray, flat: np.ndarray, count: np.ndarray) -> None:
        start = np.cumsum(count) - count + len(self.flat)
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys, kind="stable")
        self.keys, self.start, self.count = all_keys[order], np.concatenate([self.start, start])[order], np.concatenate([self.count, count.astype(np.int32)])[order]
        self.flat = np.concatenate([self.flat, flat])


_memos: dict[str, Memo] = {}


def encode_blocks(path: str, batches, column: str, special: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids of all their texts one after the other, number of ids before each row and in all).

    ``special``: special strings of the vocabulary inside texts are single tokens, else plain text.
    """
    merges, memo = load(path), _memos.setdefault(path, Memo())
    held: list[tuple] = []
    size = 0
    for rows, data, offsets in V.blocks(batches, column):
        held.append(_words(merges, rows, data, offsets, special))
        size += len(data)
        if size >= REPLAY_BYTES:
            yield from _encode(merges, memo, held)
            held, size = [], 0
    if held:
        yield from _encode(merges, memo, held)


def _segments(merges: Merges, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets with a cut at both ends of every special string, and the special id of each segment or -1."""
    body, marks = data.tobytes(), []
    for text, number in merges.special.items():
        raw, at = text.encode(), body.find(text.encode())
        while at >= 0:
            doc = int(np.searchsorted(offsets, at, "right")) - 1
            if at + len(raw) <= offsets[doc + 1]:
                marks.append((at, at + len(raw), number))
                at = body.find(raw, at + len(raw))
            else:
                at = body.find(raw, at + 1)
    if not marks:
        return offsets, np.full(len(offsets) - 1, -1, np.int64)
    cuts = np.unique(np.concatenate([offsets, [m[0] for m in marks], [m[1] for m in marks]]))
    kind = np.full(len(cuts) - 1, -1, np.int64)
    kind[np.searchsorted(cuts, [m[0] for m in marks])] = [m[2] for m in marks]
    return cuts, kind


def _words(merges: Merges, rows, data, offsets, special: bool) -> tuple:
    cuts, kind = _segments(merges, data, offsets) if special and merges.special else (offsets, None)
    starts = pretoken_starts(data, cuts)
    if kind is not None and (kind >= 0).any():  # a special string is one word
        inside = np.searchsorted(cuts, starts, "right") - 1
        starts = starts[(kind[inside] < 0) | (starts == cuts[inside])]
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    keys = V.span_hashes(data, starts, ends)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    if len(long):
        import xxhash

        body = data.tobytes()
        keys[long] = [xxhash.xxh3_64_intdigest(body[s:e]) for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    if kind is not None and (kind >= 0).any():
        marked = kind[np.searchsorted(cuts, starts, "right") - 1]
        keys = np.where(marked >= 0, (np.uint64(0xFFFFFFFF00000000) + marked.astype(np.uint64)), keys)
    unique, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
    length = (ends - starts)[index]
    pick = V.ragged(starts[index], length)
    specials = {int(np.uint64(0xFFFFFFFF00000000)) + v: v for v in merges.special.values()} if kind is not None and (kind >= 0).any() else {}
    return rows, unique, data[pick], length, inverse.astype(np.int32), np.searchsorted(starts, offsets), specials


def _encode(merges: Merges, memo: Memo, held: list[tuple]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    if len(memo.keys) > MEMO_WORDS:
        memo.clear()
    keys = np.concatenate([h[1] for h in held])
    data = np.concatenate([h[2] for h in held])
    length = np.concatenate([h[3] for h in held])
    starts = np.cumsum(length) - length
    unique, index = np.unique(keys, return_index=True)
    new = np.flatnonzero(memo.find(unique) < 0)
    if len(new):
        specials = {k: v for h in held for k, v in h[6].items()}
        flat, count = replay(merges, data, starts[index[new]], length[index[new]])
        for k, v in specials.items():  # the only words that are not merged from bytes
            at = np.flatnonzero(unique[new] == np.uint64(k))
            if len(at):
                a = int(count[: at[0]].sum())
                flat = np.concatenate([flat[:a], np.array([v], np.int32), flat[a + count[at[0]] :]])
                count[at[0]] = 1
        memo.add(unique[new], flat, count)
    for rows, own, _, _, inverse, first, _ in held:
        at = memo.find(own)
        start, count = memo.start[at][inverse], memo.count[at][inverse]
        ids = memo.flat[V.ragged(start, count)]
        total = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        yield rows, ids, total[first]
