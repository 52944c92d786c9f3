"""Column-at-a-time text primitives over Arrow string buffers.

Everything here works on the UTF-8 bytes of a whole block of documents at once, so that no
per-character or per-word Python runs. A block is cut by bytes, never by content: a document is
always whole inside its block, and a document larger than the limit is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_tables: dict[str, np.ndarray] = {}


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + len(column) + 1)[column.offset :]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches, column: str, limit: int = 2 << 20, rows: int = 1 << 30) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the record batches of at most ``limit`` text bytes and ``rows`` rows (one row at least), with their buffers."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = string_buffers(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(max(end, start + 1), start + rows, batch.num_rows)
            yield batch.slice(start, end - start), data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
            start = end


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, byte position of each) of well-formed UTF-8."""
    if not len(data) or data.max() < 0x80:
        return data.astype(np.uint32), np.arange(len(data), dtype=np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    lead = padded[at].astype(np.uint32)
    points = lead.copy()
    for low, high, keep, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
        which = np.flatnonzero((lead >= low) & (lead < high))
        if len(which):
            value = lead[which] & keep
            for k in range(1, more + 1):
                value = (value << 6) | (padded[at[which] + k] & 0x3F)
            points[which] = value
    return points, at


def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    if "class" not in _tables:
        import regex

        every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))
        table = np.full(0x110000, OTHER, np.uint8)
        for pattern, value in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
            table[[m.start() for m in regex.finditer(pattern, every)]] = value
        _tables["class"] = table
    return _tables["class"]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M**i and M**-i modulo 2**64 for i < n."""
    have = _tables.get("pow")
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
        for name, base in (("pow", _MULT), ("inv", inverse)):
            out = np.ones(size, np.uint64)
            filled = 1
            with np.errstate(over="ignore"):
                factor = base
                while filled < size:
                    step = min(filled, size - filled)
                    out[filled : filled + step] = out[:step] * factor
                    factor = factor * factor
                    filled += step
            _tables[name] = out
    return _tables["pow"][:n], _tables["inv"][:n]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Final avalanche of a 64-bit hash."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans from one prefix array; equal spans hash alike wherever they lie."""
    power, inverse = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=prefix[1:])
        body = (prefix[ends] - prefix[starts]) * inverse[starts]
        return mix(body + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; nothing else changes."""
    upper = (data >= 0x41) & (data <= 0x5A)
    return data + upper.astype(np.uint8) * np.uint8(32)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each document) of runs without space, tab, LF, VT, FF, CR."""
    solid = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every span, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    lengths = lengths.astype(np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - first, lengths)
