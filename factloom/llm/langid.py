"""Operator 1: language identification by clustered TF-IDF centroids.

Character bigrams and trigrams of the lower-cased letters of a text (everything else is one blank) are
hashed into a fixed number of features, damped, weighted by the inverse document frequencies of all learnable
documents, and scaled to length 1. Each language has several centroids, found by spherical k-means
over a bounded sample of its labelled documents (``sample_rows`` a language). A text gets the language of the
nearest centroid by cosine; one that is farther from it than the sample's documents of like length
by a margin is rejected. What few letters can show is found by thinning the sample's counts to each size, so one rule
holds for texts of any length.

A null text, or one without a letter, is ``und`` with score 0 and counts as rejected. Null labels teach nothing;
without any label every text is ``und``. Repeated rows stay repeated; other columns are not read. Clashing columns of the
results' names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import vectext as V
from factloom.llm.common import chosen, held_out, stash, unstash, with_fields

SAMPLE_ROWS, CENTROIDS, FEATURES = 800, 4, 8192
#: A document is rejected below this share of the least cosine of the sample's documents of like length.
REJECT_SHARE = 0.5
#: Sample documents of a language that are thinned to show what shorter texts reach.
THINNED_ROWS = 200
#: Rows whose feature counts are in memory together.
BLOCK_ROWS = 128
_tables: dict[str, np.ndarray] = {}


def _letter_codes() -> np.ndarray:
    """A 32-bit code of the lower-case form of each letter, 0 for what is no letter."""
    if "code" not in _tables:
        kind = V.char_classes()
        low = np.arange(0x110000, dtype=np.uint64)
        for c in np.flatnonzero(kind == V.LETTER).tolist():
            lowered = chr(c).lower()
            if len(lowered) == 1:
                low[c] = ord(lowered)
        code = (V.mix(low, 1) & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
        code[kind != V.LETTER] = 0
        _tables["code"] = code
    return _tables["code"]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents x features counts, letters of each document) of a block."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros((rows, FEATURES), np.float32), np.zeros(rows, np.int64)
    points, at = V.code_points(data)
    code = _letter_codes()[points]
    first = np.searchsorted(at, offsets)
    owner = np.repeat(np.arange(rows), np.diff(first))
    letter = code != 0
    letters = np.bincount(owner[letter], minlength=rows)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    code, owner = code[keep], owner[keep]
    fresh = np.ones(len(code), bool)
    fresh[1:] = owner[1:] != owner[:-1]
    before = np.where(fresh, np.uint32(0), np.concatenate([[np.uint32(0)], code[:-1]]).astype(np.uint32))
    half = FEATURES // 2
    shift = np.uint32(32 - (half.bit_length() - 1))
    with np.errstate(over="ignore"):
        two = (before * np.uint32(0x9E3779B1) ^ code) * np.uint32(0x85EBCA77)
        bigram = (two >> shift).astype(np.int64)
        three = two[:-1] * np.uint32(0xC2B2AE3D) ^ code[1:]
        trigram = (three * np.uint32(0x27D4EB2F) >> shift).astype(np.int64) + half
    whole = ~fresh[1:]
    place = owner.astype(np.int64) * FEATURES
    counts = np.bincount(np.concatenate([place + bigram, (place[1:] + trigram)[whole]]), minlength=rows * FEATURES)
    return counts.reshape(rows, FEATURES).astype(np.float32), letters


def scaled(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped, weighted, of length 1 (all zero stays so)."""
    x = np.log1p(counts) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(norm, 1e-9)


def clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, from spread starts: each next start is the row least like the earlier ones."""
    starts = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[starts[0]]
    while len(starts) < min(k, len(x)):
        starts.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[starts[-1]])
    centers = x[starts].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centers.T, axis=1)
        for j in range(len(centers)):
            if (own == j).any():
                centers[j] = x[own == j].mean(axis=0)
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-9)
    return centers


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centers: np.ndarray
    owner: np.ndarray
    #: Least accepted cosine by the bit length of a text's letters.
    floor: np.ndarray

    def predict(self, counts: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        if not len(self.centers):
            return ["und"] * len(letters), np.zeros(len(letters)), np.ones(len(letters), bool)
        cosine = scaled(counts, self.idf) @ self.centers.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0, 1)
        bits = np.minimum(np.array([int(n).bit_length() for n in letters]), len(self.floor) - 1)
        none = letters == 0
        names = [("und" if z else self.languages[self.owner[b]]) for b, z in zip(best.tolist(), none.tolist(), strict=True)]
        return names, np.where(none, 0.0, score), none | (score < self.floor[bits])


def _counts(row) -> np.ndarray:
    return np.frombuffer(row["counts"], np.uint16 if len(row["counts"]) == 2 * FEATURES else np.float32).astype(np.float32)


def _thinned(width: int, own: list, letters: np.ndarray, idf: np.ndarray, centers: np.ndarray):
    """(letters, cosine) of sample documents thinned to 1, 2, 4, ... letters' worth of their grams, by a fixed draw."""
    draw = np.random.default_rng(5)
    rows = [(np.flatnonzero(c), c) for c in map(_counts, own[:THINNED_ROWS])]
    for bits in range(1, 13):
        want = 1 << (bits - 1)
        part = np.zeros((len(rows), width), np.float32)
        for k, (at, c) in enumerate(rows):
            part[k, at] = draw.binomial(c[at].astype(np.int64), min(1.0, want / max(1, letters[k])))
        some = (letters[: len(rows)] > want) & part.any(axis=1)
        if some.any():
            yield np.full(int(some.sum()), want), (scaled(part[some], idf) @ centers.T).max(axis=1)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, centroids: int = CENTROIDS) -> Model:
    """Learn from the rows that are not held out. Document frequencies cover all of them, the centroids a bounded sample."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("lang").isNotNull() & ~held_out("key"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.ones(FEATURES, np.float32), np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(33))
    many = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, n)])[F.col("lang")]
    mine = chosen(many, sample_rows, "key", "text")

    def count(batches):
        frequency = np.zeros(FEATURES, np.int64)
        documents = 0
        for part, data, offsets in V.blocks(batches, "text", 1 << 20, BLOCK_ROWS):
            counts, letters = grams(data, offsets)
            frequency += (counts > 0).sum(axis=0)
            documents += int((letters > 0).sum())
            mine = np.flatnonzero(np.array(part.column(2).to_pylist(), bool) & (letters > 0))
            if len(mine):
                yield pa.record_batch([part.column(1).take(pa.array(mine)), pa.array(letters[mine]), pa.array([counts[i].astype(np.uint16 if counts[i].max() < 65_536 else np.float32).tobytes() for i in mine], pa.binary())], names=["lang", "n", "counts"])
        some = np.flatnonzero(frequency)
        yield pa.record_batch([pa.nulls(len(some) + 1, pa.string()), pa.array(np.append(frequency[some], documents)), pa.array([int(i).to_bytes(4, "little") for i in [*some.tolist(), FEATURES]], pa.binary())], names=["lang", "n", "counts"])

    seen = stash(rows.select("text", "lang", F.coalesce(mine, F.lit(False)).alias("mine")).mapInArrow(count, "lang string, n long, counts binary"), "langid")
    drawn = {r["lang"]: r["n"] for r in seen.filter(F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    totals = seen.filter(F.col("lang").isNull()).groupBy("counts").agg(F.sum("n").alias("n")).collect()  # one row a feature
    frequency = np.zeros(FEATURES + 1)
    for r in totals:
        frequency[int.from_bytes(r["counts"], "little")] = r["n"]
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])).astype(np.float32) + np.float32(0.1)
    languages, centers, owner, least = sorted(sizes), [], [], np.full(33, np.inf)
    for number, name in enumerate(languages):
        rows = seen.filter(F.col("lang") == name).select("n", "counts")
        if drawn.get(name, 0) > 2 * sample_rows:  # rows that repeat key and text are drawn together
            rows = rows.orderBy(F.xxhash64("counts"), "n", "counts").limit(2 * sample_rows)
        own = sorted(rows.collect(), key=lambda r: (r["n"], bytes(r["counts"])))
        if not own:
            continue
        x = scaled(np.array([_counts(r) for r in own], np.float32), idf)
        found = clusters(x, centroids)
        centers.append(found)
        owner += [number] * len(found)
        near = (x @ found.T).max(axis=1)
        letters = np.array([r["n"] for r in own])
        for size, cosine in [(letters, near), *_thinned(x.shape[1], own, letters, idf, found)]:
            bits = np.minimum([int(n).bit_length() for n in size], 32)
            np.minimum.at(least, bits, cosine)
    unstash(seen)
    floor = np.minimum.accumulate(least[::-1])[::-1]  # a shorter text is never held to more than a longer one
    floor = np.where(np.isfinite(floor), floor, floor[np.isfinite(floor)].min() if np.isfinite(floor).any() else 0) * REJECT_SHARE
    return Model(languages, idf, np.concatenate(centers) if centers else np.zeros((0, FEATURES), np.float32), np.array(owner, np.int64), floor)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and lang_pred, score, rejected; clashing columns of these names are replaced."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score", "rejected")])
    held = docs.sparkSession.sparkContext.broadcast(model)  # centroids x features, whatever the corpus

    def run(batches):
        own = held.value
        for part, data, offsets in V.blocks(batches, text, 1 << 20, BLOCK_ROWS):
            names, score, rejected = own.predict(*grams(data, offsets))
            yield pa.record_batch([*part.columns, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], names=[*part.schema.names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, with_fields(docs, "lang_pred string, score double, rejected boolean"))
