"""Operator 3: document fingerprints from prefix polynomial hashes.

``Prefix`` holds, for a text, the polynomial hashes of all its prefixes modulo two primes. From them the hash of any
span comes in constant time, so any two spans can be compared, and the longest common extension of two positions is
found by binary search. A fingerprint is made of the same arrays: a hash of the whole text, and a sketch of the span
hashes of all windows of ``WINDOW`` code points (of the whole text, if it is shorter): in each of ``BINS`` classes
of hashes, ``BITS`` bits of the least one. A window that occurs again counts as another one, so repetitive texts are
compared by how much they share. The likeness of two fingerprints is the share of windows that their texts
have in common, 2 J / (1 + J) for the Jaccard similarity J that the sketches estimate (less the bins that agree by
chance, one in 2 ** BITS).

Null texts are empty; two empty texts are wholly alike, an empty and another text not at all. Equal texts have equal
fingerprints. Rows that repeat a key are neighbours in the order of their texts (if they fill more than a range of rows,
by a hash of the text first); null keys come last in the descending order. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from factloom.llm import vectext as V
from factloom.llm.common import plan_bytes

WINDOW, BINS, BITS = 12, 256, 8
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003, 998_244_353)
#: Code points whose windows are hashed at a time.
STEP = 1 << 18
#: Bytes of a range of keys, and the ranges and sampled keys a range at most: the driver holds a million keys, whatever the corpus.
RANGE_BYTES, MOST_RANGES, SAMPLED = 16 << 20, 50_000, 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers and inverse powers of a base modulo its prime, by doubling."""
    have = _powers.get(k)
    if have is None or len(have[0]) < n:
        size, out = max(1 << 14, 1 << (n - 1).bit_length()), []
        for base in (BASES[k], pow(BASES[k], -1, PRIMES[k])):
            table, filled, factor = np.ones(size, np.uint64), 1, base
            while filled < size:
                table[filled : 2 * filled] = table[:filled] * np.uint64(factor) % np.uint64(PRIMES[k])
                filled, factor = 2 * filled, factor * factor % PRIMES[k]
            out.append(table)
        _powers[k] = (out[0], out[1])
    return _powers[k][0][:n], _powers[k][1][:n]


class Prefix:
    """Prefix hashes of a sequence of code points."""

    def __init__(self, points: np.ndarray, base: Prefix | None = None, kept: int = 0):
        """Of ``points``; its first ``kept`` are those of ``base``, whose hashes are taken over."""
        self.size = len(points)
        self.arrays = []
        fresh = points[kept:].astype(np.uint64) + np.uint64(1)
        for k, prime in enumerate(PRIMES):
            power, _ = _power_tables(k, self.size + 1)
            total = np.zeros(self.size + 1, np.uint64)
            if kept:
                total[: kept + 1] = base.arrays[k][: kept + 1]
            terms = fresh * power[kept : self.size] % np.uint64(prime)
            terms[:1] += total[kept]
            np.cumsum(terms, out=total[kept + 1 :])  # under 2**31 * size, far below 2**64
            total[kept + 1 :] %= np.uint64(prime)
            self.arrays.append(total)

    def spans(self, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        """62-bit hashes of spans; equal spans of any texts hash alike."""
        out = np.uint64(0)
        for k, prime in enumerate(PRIMES):
            p = np.uint64(prime)
            _, inverse = _power_tables(k, self.size + 1)
            part = (self.arrays[k][ends] + p - self.arrays[k][starts]) * inverse[starts] % p  # below 2**63
            out = out << np.uint64(31) | part
        return out

    def span(self, start: int, end: int) -> int:
        out = 0
        for k, prime in enumerate(PRIMES):
            own = self.arrays[k]
            out = out << 31 | (int(own[end]) + prime - int(own[start])) * int(_powers[k][1][start]) % prime
        return out


def equal(a: Prefix, i: int, b: Prefix, j: int, length: int) -> bool:
    """Whether a[i : i + length] and b[j : j + length] are equal."""
    return i + length <= a.size and j + length <= b.size and a.span(i, i + length) == b.span(j, j + length)


def common_extension(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """Longest length at which a from i and b from j agree, by binary search."""
    low, high = 0, min(a.size - i, b.size - j)
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(i, i + middle) == b.span(j, j + middle):
            low = middle
        else:
            high = middle - 1
    return low


def _windows(prefix: Prefix, first: int, last: int, low: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Least mixed hash in each bin, of the windows that start in [first, last); their hashes in order.

    The k-th time a window occurs counts as another window; ``before`` has the ordered hashes of all windows ahead of ``first``.
    """
    width = min(WINDOW, prefix.size)
    h = np.empty(max(0, last - first), np.uint64)
    for start in range(first, last, STEP):
        stop = min(start + STEP, last)
        h[start - first : stop - first] = prefix.spans(slice(start, stop), slice(start + width, stop + width))
    ordered = np.sort(h)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(before) and len(h):
        at = np.minimum(np.searchsorted(before, ordered), len(before) - 1)
        again = np.append(again, ordered[before[at] == ordered])
    again = np.unique(again)
    if len(again):
        earlier = np.searchsorted(before, again, "right") - np.searchsorted(before, again)
        at = np.minimum(np.searchsorted(again, h), len(again) - 1)
        where = np.flatnonzero(again[at] == h)
        order = where[np.argsort(at[where], kind="stable")]
        group = at[order]
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        turn = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order)))) + earlier[group]
        with np.errstate(over="ignore"):
            h[order] += turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for start in range(0, len(h), STEP):
        mixed = V.mix(h[start : start + STEP], 31)
        np.minimum.at(low, (mixed & np.uint64(BINS - 1)).astype(np.int64), mixed)
    return ordered


def _split(size: int) -> tuple[int, int]:
    """(windows that lie in the first two thirds, all windows)."""
    width = min(WINDOW, size)
    return max(0, size - size // 3 - width + 1), size - width + 1


def sketch(prefix: Prefix, head: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(least hash of each bin, (the same of the first part alone, its windows' hashes in order)); all ones if there is none. ``head``: the first part's, if known."""
    none = np.full(BINS, np.uint64(0xFFFFFFFFFFFFFFFF))
    if not prefix.size:
        return none, (none, none[:0])
    cut, end = _split(prefix.size)
    if head is None:
        low = none.copy()
        head = low, _windows(prefix, 0, cut, low, none[:0])
    low = head[0].copy()
    _windows(prefix, cut, end, low, head[1])
    return low, head


def fingerprint(prefix: Prefix, low: np.ndarray) -> str:
    """Length and whole hash, then the bins' bits, in hexadecimal; an empty bin shows a dash for each digit."""
    whole = prefix.span(0, prefix.size) if prefix.size else 0
    bits = ((low >> np.uint64(8)) & np.uint64((1 << BITS) - 1)).astype(np.uint8).tobytes().hex()
    if low.max() == 0xFFFFFFFFFFFFFFFF:
        bits = "".join("--" if v == 0xFFFFFFFFFFFFFFFF else bits[2 * k : 2 * k + 2] for k, v in enumerate(low.tolist()))
    return f"{prefix.size:x}:{whole:016x}:{bits}"


def likeness(one: str, two: str) -> float:
    """Likeness of two texts, from their fingerprints alone."""
    if one == two:
        return 1.0
    (n, _, a), (m, _, b) = one.split(":"), two.split(":")
    if n == "0" or m == "0":
        return 0.0
    x, y = (np.frombuffer(t.encode(), np.uint16) for t in (a, b))  # two digits a bin
    empty = np.frombuffer(b"--", np.uint16)[0]
    share = float((x == y)[(x != empty) | (y != empty)].mean())
    share = max(0.0, (share - 2.0**-BITS) / (1 - 2.0**-BITS))
    return 2 * share / (1 + share)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint of every text: one pass, no shuffle."""

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                prefix = Prefix(np.frombuffer((t or "").encode("utf-32-le"), np.uint32))
                out.append(fingerprint(prefix, sketch(prefix)[0]))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["key", "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fingerprint string").withColumnRenamed("key", key)


def edited_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_edited, common_next.

    The next document is that of the next smaller key; the last one's is the first. Texts are dealt out once, by
    ranges of keys, a range a task; the first row of the next range comes along as a copy, one row for each range. A key
    (or none) that holds more rows than a range is cut, so no key fills a task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranges = min(MOST_RANGES, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), plan_bytes(rows) // RANGE_BYTES))
    many = rows.count()
    some = rows.select("key") if many <= SAMPLED * ranges else rows.select("key").sample(SAMPLED * ranges / many, seed=7)
    plan = _Ranges([r["key"] for r in some.collect()], ranges)  # keys alone, SAMPLED a range; they place rows, and change no result
    place, lot = plan.place(F.col("key"), F.xxhash64("text"))
    placed = rows.withColumns({"bucket": place, "lot": lot})
    # The first row of each range, which the range ahead of it needs as its neighbour: a key, and its lot if the key is cut.
    keys = rows.select("key").withColumns(dict(zip(("bucket", "lot"), plan.place(F.col("key"), None), strict=True)))
    heads = {r["bucket"]: (r["head"], None) for r in keys.filter("lot is null").groupBy("bucket").agg(F.max("key").alias("head")).collect()}
    if plan.cut_keys:
        heads |= {r["bucket"]: (r["head"], r["lot"]) for r in placed.filter("lot is not null").groupBy("bucket").agg(F.max("key").alias("head"), F.min("lot").alias("lot")).collect()}
    order = sorted(heads)
    table = spark.createDataFrame([(b, *heads[b], order[k - 1]) for k, b in enumerate(order)], "bucket int, head long, head_lot long, ahead int")  # a ring, MOST_RANGES rows
    copies = placed.join(F.broadcast(table), "bucket").filter(F.col("key").eqNullSafe(F.col("head")) & F.col("lot").eqNullSafe(F.col("head_lot"))).select("key", "text", F.col("ahead").alias("bucket"), "lot", F.lit(1).alias("copy"))
    dealt = placed.select("key", "text", "bucket", "lot", F.lit(0).alias("copy")).unionAll(copies).repartitionById(max(1, plan.size), F.col("bucket")).sortWithinPartitions("bucket", "copy", F.desc_nulls_last("key"), "lot", "text")

    def run(batches):
        last = None  # (bucket, key, text) that waits for its neighbour
        out: list[tuple] = []
        for batch in batches:
            for k, t, b, copy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is not None and last[0] == b:
                    out.append(_row(last, (b, k, t)))
                    last = None
                if not copy:
                    last = (b, k, t)
                if len(out) >= 500:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    result = dealt.select("key", "text", "bucket", "copy").mapInArrow(run, "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long")
    return result.withColumnRenamed("key", key)


class _Ranges:
    """Ranges of keys in falling order, null keys last; a key that would fill several is cut by lots, the hashes of its texts."""

    def __init__(self, sample: list[int | None], ranges: int):
        every = sorted(k for k in sample if k is not None)
        picked = [every[i * len(every) // ranges] for i in range(1, ranges)] if every else []
        self.cuts = sorted(set(picked))
        lots = {k: n for k in self.cuts if (n := picked.count(k)) > 1} if len(set(picked)) < len(picked) else {}
        missing = max(1, round(ranges * (len(sample) - len(every)) / max(1, len(sample))))
        self.cut_keys = bool(lots) or missing > 1
        # By the number of cuts at or below a key: the place of its range, and of the lots of the cut itself.
        self.rest, self.first, self.lots, at = [0] * (len(self.cuts) + 1), [0] * (len(self.cuts) + 1), [0] * (len(self.cuts) + 1), 0
        for b in range(len(self.cuts), -1, -1):
            self.rest[b], at = at, at + 1
            self.lots[b] = lots.get(self.cuts[b - 1], 0) if b else 0
            self.first[b], at = at, at + self.lots[b]
        self.null, self.missing, self.size = at, missing, at + missing

    def place(self, key: Column, mixed: Column | None) -> tuple[Column, Column]:
        """(number of a row's range, its lot: null unless its key is cut). Without ``mixed``, rows of cut keys have lot 0 and no exact place."""
        cuts = self.cuts
        below = sum((F.when(key >= c, 1).otherwise(0) for c in cuts), F.lit(0)) if len(cuts) < 64 else _search(cuts)
        table = lambda values: F.from_json(F.lit(json.dumps(values)), "array<bigint>")
        at = lambda values: F.element_at(table(values), below.cast("int") + 1)
        hit = F.lit(False) if not any(self.lots) else F.coalesce((at(self.lots) > 0) & (key == at([0, *cuts])), F.lit(False))
        cut = hit | (key.isNull() if self.missing > 1 else F.lit(False))
        lot = F.shiftrightunsigned(mixed, 11) if mixed is not None else F.lit(0).cast("long")
        part = lambda n: F.floor(lot * n / float(1 << 53)).cast("long")
        place = F.when(key.isNull(), F.lit(self.null) + part(F.lit(self.missing))).when(hit, at(self.first) + part(at(self.lots))).otherwise(at(self.rest))
        return place.cast("int"), F.when(cut, lot)


def _search(cuts: list[int]):
    """Number of cuts at or below the key, for many cuts: a binary search over batches of keys."""
    sorted_ = np.array(cuts, np.int64)

    @F.pandas_udf(IntegerType())
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(sorted_, key.fillna(0).to_numpy(np.int64), "right").astype(np.int32))

    return place(F.col("key"))


_next: dict[str, tuple] = {}


def _made(text: str) -> tuple[np.ndarray, Prefix, tuple[np.ndarray, np.ndarray], str]:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    prefix = Prefix(points)
    low, head = sketch(prefix)
    return points, prefix, head, fingerprint(prefix, low)


def _row(own: tuple, neighbour: tuple) -> tuple:
    """The result for one document; a neighbour's arrays are kept for its own turn."""
    held = _next.pop(own[2], None) or _made(own[2])
    _next.clear()
    other = held if neighbour[2] == own[2] else _made(neighbour[2])
    _next[neighbour[2]] = other
    points, prefix, head, mark = held
    size = len(points)
    kept = size - size // 3
    edited = np.concatenate([points[:kept], other[0][: size // 3]])
    changed = Prefix(edited, prefix, kept)
    after = fingerprint(changed, sketch(changed, head if len(edited) == size else None)[0])
    return (own[1], size, hashlib.sha256(edited.tobytes().decode("utf-32-le").encode()).hexdigest(), mark, after, likeness(mark, after), likeness(mark, other[3]), common_extension(prefix, 0, changed, 0), common_extension(prefix, 0, other[1], 0))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_edited", "common_next"]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
