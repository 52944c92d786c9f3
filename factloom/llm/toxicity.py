"""Operator 10: toxicity by multiple-instance learning.

A text is a bag of sentences (cut after . ! ? and at line ends). A sentence's logit is a bias and the weights
of its distinct features, its words and their beginnings of 4 to 7 signs (so that an inflected stem counts); the text's probability is the noisy-or of its sentences, so that only texts need
labels, and the sentences that carry the score can be located. Words are ASCII letters (lower-cased),
digits, apostrophes and all non-ASCII signs. Learnt from a bounded sample of labelled rows (``sample_rows`` of each
label and ``SAMPLE_BYTES`` of text in all, none of whose texts is longer than a sixteenth of that), with the ``FEATURES``
whose document frequencies differ most between the labels.

A null or empty text has no sentence: its score is the noisy-or of nothing, 0. Conflicting labels of one
document count as toxic; null labels teach nothing; with one label only, or none, every score is the share of toxic
labels. Repeated rows stay repeated; an id that several rows bear teaches by the greatest of its texts; other columns
are not read. Clashing columns of the results' names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import vectext as V
from factloom.llm.common import bounded_sample, held_out, stash, unstash, with_fields

SAMPLE_ROWS, SAMPLE_BYTES, FEATURES, THRESHOLD = 4000, 64 << 20, 4096, 0.3
BEGINNINGS = (4, 5, 6, 7)
#: Text whose features are in memory together, and counted pairs that leave a task together.
BLOCK_BYTES, COUNTED_PAIRS = 1 << 19, 400_000
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of features, sentence of each, document of each sentence, byte start of each sentence) of a block."""
    low = V.lower_ascii(data)
    solid = _WORD[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(low), bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.zeros(len(low), bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    cut = np.cumsum(_ENDS[low])
    owner = np.searchsorted(offsets, starts, "right") - 1
    mark = cut[starts] if len(starts) else starts
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (mark[1:] != mark[:-1]) | (owner[1:] != owner[:-1])
    number = np.cumsum(fresh) - 1
    heads = np.flatnonzero((low & 0xC0) != 0x80)
    at = np.searchsorted(heads, starts)
    heads = np.append(heads, np.full(max(BEGINNINGS) + 1, len(low)))
    words, sentence = [V.span_hashes(low, starts, ends)], [number]
    for size in BEGINNINGS:
        stop = heads[at + size]
        longer = np.flatnonzero(stop < ends)
        words.append(V.mix(V.span_hashes(low, starts[longer], stop[longer]), size))
        sentence.append(number[longer])
    return np.concatenate(words), np.concatenate(sentence), owner[fresh], starts[fresh]


@dataclass
class Model:
    words: np.ndarray
    weights: np.ndarray
    bias: float
    #: For want of two labels: the score of every text.
    constant: float | None = None

    def logits(self, words: np.ndarray, sentence: np.ndarray, many: int) -> np.ndarray:
        """One logit for each sentence; a feature counts once in it."""
        if not len(self.words) or not len(words):
            return np.full(many, self.bias)
        pair = entries(self.words, words, sentence)
        return self.bias + np.bincount(pair // len(self.words), weights=self.weights[pair % len(self.words)], minlength=many)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(score of each document, its likeliest sentence's byte start or -1 and probability, sentences)."""
        rows = len(offsets) - 1
        words, sentence, owner, start = sentences(data, offsets)
        logit = self.logits(words, sentence, len(owner))
        clean = np.bincount(owner, weights=np.logaddexp(0, logit), minlength=rows)  # -log(1 - p), summed
        score = -np.expm1(-clean)
        if self.constant is not None:
            score = np.full(rows, self.constant)
        best = np.full(rows, -1, np.int64)
        top = np.zeros(rows)
        order = np.lexsort((-np.arange(len(owner)), logit, owner))
        last = np.flatnonzero(np.append(owner[order][1:] != owner[order][:-1], True)) if len(owner) else np.zeros(0, np.int64)
        best[owner[order][last]] = start[order][last] - offsets[owner[order][last]]
        top[owner[order][last]] = 1 / (1 + np.exp(-logit[order][last]))
        return np.clip(score, 0, 1), best, top, np.bincount(owner, minlength=rows)


def entries(known: np.ndarray, hashes: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """sentence * len(known) + feature of each known feature, once a sentence."""
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = known[at] == hashes
    return np.unique(sentence[hit].astype(np.int64) * len(known) + at[hit])


def gradient(weight: np.ndarray, bias: float, labels: np.ndarray, owner: np.ndarray, row: np.ndarray, col: np.ndarray, decay: float) -> tuple[float, np.ndarray, float]:
    """(mean loss, its gradient by the weights, by the bias) of the noisy-or likelihood; ``row``, ``col``: each sentence's features."""
    logit = bias + np.bincount(row, weights=weight[col], minlength=len(owner))
    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    clean = np.bincount(owner, weights=np.logaddexp(0, logit), minlength=len(labels))  # -log of the chance of no toxic sentence
    whole = np.clip(-np.expm1(-clean), 1e-9, 1)
    loss = np.where(labels > 0, -np.log(whole), clean).mean() + decay / 2 * (weight @ weight)
    pull = np.where(labels > 0, (1 - whole) / whole, -1.0)[owner] * p
    return float(loss), -np.bincount(col, weights=pull[row], minlength=len(weight)) / len(labels) + decay * weight, -pull.sum() / len(labels)


def train(words: np.ndarray, start: np.ndarray, bags: list[tuple[int, int, np.ndarray]], rounds: int = 300, decay: float = 2e-4) -> Model:
    """bags: (label, sentences, entries). Noisy-or likelihood by Adam over the sampled bags, from the weights ``start``."""
    labels = np.array([b[0] for b in bags], float)
    owner = np.repeat(np.arange(len(bags)), [b[1] for b in bags])
    before = np.cumsum([0, *[b[1] for b in bags]])
    every = np.concatenate([b[2].astype(np.int64) + n * len(words) for b, n in zip(bags, before[:-1], strict=True)])
    row, col = every // len(words), every % len(words)
    weight, bias = start.copy(), -6.0
    moment, square, mb, sb = np.zeros(len(words)), np.zeros(len(words)), 0.0, 0.0
    for t in range(1, rounds + 1):
        _, grad, gb = gradient(weight, bias, labels, owner, row, col, decay)
        rate = 0.1 if t < rounds * 2 // 3 else 0.02
        moment, square = 0.9 * moment + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb**2
        weight -= rate * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.999**t)) + 1e-8)
    return Model(words, weight, float(bias))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most about ``sample_rows`` rows of each label, none of them held out."""
    known = labels.select(F.col(key).alias("key"), (F.col(label) > 0).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("key").isNotNull() & ~held_out("key"))
    known = known.groupBy("key").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -20.0, float(max(sizes, default=0)))
    parts = [bounded_sample(known.filter(F.col("label") == k), "key", n, sample_rows) for k, n in sorted(sizes.items())]
    ids = F.broadcast(parts[0].unionByName(parts[1]))  # about 2 x sample_rows ids
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(ids, "key").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES // 16)
    drawn = stash(found, "toxicity")
    repeated = drawn.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    if repeated.limit(1).count():
        once = drawn.groupBy("key").agg(F.max("text").alias("text"), F.max("label").alias("label"))
        held, drawn = drawn, stash(once, "toxicity")
        unstash(held)
    size = drawn.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    rows = bounded_sample(drawn, "key", size, SAMPLE_BYTES).select("text", "label")

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        every, n = np.unique(np.concatenate(held, axis=1), axis=1, return_counts=True)
        return pa.record_batch([pa.array(every[0].view(np.int64)), pa.array(every[1].astype(np.int32)), pa.array(n)], names=["word", "label", "n"])

    def frequencies(batches):
        held: list[np.ndarray] = []
        for part, data, offsets in V.blocks(batches, "text", BLOCK_BYTES):
            side = part.column(1).to_numpy().astype(np.int64)
            found, sentence, owner, _ = sentences(data, offsets)
            pair = np.unique(np.stack([found, owner[sentence].astype(np.uint64)]), axis=1) if len(found) else np.zeros((2, 0), np.uint64)
            held.append(np.stack([pair[0], side[pair[1].astype(np.int64)].astype(np.uint64)]))
            if sum(h.shape[1] for h in held) > COUNTED_PAIRS:
                yield counted(held)
                held = []
        if held:
            yield counted(held)

    counts = rows.mapInArrow(frequencies, "word long, label int, n long").groupBy("word").agg(F.sum(F.col("n") * F.col("label")).alias("ones"), F.sum("n").alias("all"))
    n1, n0 = float(rows.filter("label = 1").count()), float(rows.filter("label = 0").count())
    lift = F.log((F.col("ones") + 0.5) / (n1 + 1)) - F.log((F.col("all") - F.col("ones") + 0.5) / (n0 + 1))
    spread = F.abs(lift) / F.sqrt(1 / (F.col("ones") + 0.5) + 1 / (F.col("all") - F.col("ones") + 0.5))
    best = counts.filter("all >= 4").select("word", lift.alias("lift"), spread.alias("spread")).filter("spread > 1").orderBy(F.desc("spread"), "word").limit(FEATURES).collect()
    if not best:
        unstash(drawn)
        return Model(np.zeros(0, np.uint64), np.zeros(0), -20.0, n1 / max(1.0, n1 + n0))
    words = np.array([r["word"] for r in best], np.int64).view(np.uint64)
    order = np.argsort(words)
    words = words[order]
    start = np.array([min(max(r["lift"], -2.0), 3.0) if r["spread"] > 6 else 0.0 for r in best])[order]

    def reduce(batches):
        for part, data, offsets in V.blocks(batches, "text", BLOCK_BYTES):
            found, sentence, owner, _ = sentences(data, offsets)
            first = np.searchsorted(owner, np.arange(len(offsets)))
            pair = entries(words, found, sentence)
            cut = np.searchsorted(pair, first * len(words))
            own = [(pair[a:b] - s * len(words)).astype(np.uint32).tobytes() for a, b, s in zip(cut[:-1], cut[1:], first[:-1], strict=True)]
            yield pa.record_batch([part.column(1), pa.array(np.diff(first)), pa.array(own, pa.binary())], names=["label", "sentences", "entries"])

    found = rows.mapInArrow(reduce, "label int, sentences long, entries binary").collect()  # sampled rows only, of SAMPLE_BYTES of text
    bags = sorted(((r["label"], r["sentences"], bytes(r["entries"])) for r in found), key=lambda b: b)  # no order of tasks in the sums
    unstash(drawn)
    return train(words, start, [(k, n, np.frombuffer(e, np.uint32)) for k, n, e in bags])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and score, predicted, sentence_start (byte of its likeliest sentence, null if none), sentence_score, n_sentences."""
    new = ("score", "predicted", "sentence_start", "sentence_score", "n_sentences")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in new])
    held = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights at most

    def run(batches):
        own = held.value
        for part, data, offsets in V.blocks(batches, text, BLOCK_BYTES):
            value, start, top, many = own.score(data, offsets)
            yield pa.record_batch([*part.columns, pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32)), pa.array(start, mask=start < 0), pa.array(top), pa.array(many.astype(np.int32))], names=[*part.schema.names, *new])

    return docs.mapInArrow(run, with_fields(docs, "score double, predicted int, sentence_start long, sentence_score double, n_sentences int"))


def locate(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", least: float = THRESHOLD) -> DataFrame:
    """key, sentence, probability: every sentence whose own probability is at least ``least``."""

    def run(batches):
        for part, data, offsets in V.blocks(batches, "text", BLOCK_BYTES):
            words, sentence, owner, start = sentences(data, offsets)
            p = 1 / (1 + np.exp(-model.logits(words, sentence, len(owner))))
            stop = np.append(start[1:], len(data))
            stop = np.minimum(stop, offsets[owner + 1])
            hit = np.flatnonzero(p >= least)
            body = data.tobytes()
            yield pa.record_batch([part.column(0).take(pa.array(owner[hit])), pa.array([body[start[i] : stop[i]].decode(errors="replace").strip() for i in hit], pa.string()), pa.array(p[hit])], names=["key", "sentence", "probability"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, sentence string, probability double").withColumnRenamed("key", key)
