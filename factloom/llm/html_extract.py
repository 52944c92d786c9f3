"""Operator 7: main-text extraction by a tree-structured graphical model.

Every element of a page is a variable with three values, wrapper, content and boilerplate. A child's value depends
on its parent's through a potential of the child's tag, and shows itself in features: tag, words of its class and id,
the amount of its text, the share of links in it. Potentials and feature tables are counted on labelled pages
(``html_training``). Sum-product messages pass upward from the leaves and downward from the root, level by level
for a whole batch of pages; the result is each element's exact marginal. A wrapper has no text of its own, so text is
kept where its element, given that it is no wrapper, is likelier content than boilerplate.

Character references are decoded, white space inside a block becomes one space, blocks join by one space in page order.
A null or empty page has an empty text. Scripts, styles, the head, titles, comments, and what iframes and text areas hold never
are text. All other elements are read alike, and one that is not closed ends with its parent.
Repeated rows stay repeated; only the three columns named are read.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.html_tree import INLINE, SKIPPED, Page, parse
from factloom.llm.html_training import labelled_pages

STATES = {"w": 0, "c": 1, "b": 2}
TRAINING_PAGES = 600
BATCH_CHARS = 4 << 20


def features(page: Page) -> list[list[str]]:
    """Names of what each element shows."""
    many = len(page.tags)
    own, linked, stops = [0] * many, [0] * many, [0] * many
    in_link = [False] * many
    for k in range(1, many):
        in_link[k] = page.tags[k] == "a" or in_link[page.parents[k]]
    for node, text, _ in page.chunks:
        words = len(text.split())
        own[node] += words
        stops[node] += text.count(".") + text.count(",")
        if in_link[node]:
            linked[node] += words
    whole, links = own[:], linked[:]
    for k in range(many - 1, 0, -1):
        whole[page.parents[k]] += whole[k]
        links[page.parents[k]] += links[k]
    out = []
    for k in range(many):
        share = 0 if not whole[k] else int(4 * links[k] / whole[k] + 0.5)
        group = "inline" if page.tags[k] in INLINE else "block"
        found = [f"t:{page.tags[k]}", f"l:{group}:{min(whole[k].bit_length(), 8)}:{share}"]
        if own[k]:
            found.append(f"o:{group}:{min(own[k].bit_length(), 7)}:{min(stops[k], 2)}")
        found += [f"n:{w}" for w in page.names[k]]
        out.append(found)
    return out


class Model:
    """Log tables: what elements show in each state, and transitions (parent's state x own state) by tag."""

    def __init__(self, shown: dict[str, np.ndarray], moves: dict[str, np.ndarray], other: np.ndarray):
        self.shown, self.moves, self.other = shown, moves, other
        self.index = {t: k for k, t in enumerate(moves)}
        self.table = np.stack([*moves.values(), other])

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        """P(state) of every element of every page, by one upward and one downward pass over all levels."""
        none = np.zeros(3)
        parent, move, look, depth, cut = [], [], [], [], [0]
        for page in pages:
            base = cut[-1]
            level = [0] * len(page.tags)
            for k, (tag, up, seen) in enumerate(zip(page.tags, page.parents, features(page), strict=True)):
                level[k] = level[up] + 1 if k else 0
                parent.append(base + up if k else -1)
                move.append(self.index.get(tag, len(self.index)))
                total = none
                for f in seen:
                    total = total + self.shown.get(f, none)
                look.append(total)
            depth += level
            cut.append(base + len(page.tags))
        parent, move, depth = np.array(parent), np.array(move), np.array(depth)
        up = np.array(look)
        up[np.array(cut[:-1])] += np.array([0.0, -9.0, -9.0])  # a page's root is a wrapper
        message = np.zeros_like(up)
        order = np.argsort(depth, kind="stable")
        edges = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        for level in range(len(edges) - 2, 0, -1):
            node = order[edges[level] : edges[level + 1]]
            joint = self.table[move[node]] + up[node][:, None, :]  # parent's state x own state
            high = joint.max(axis=2)
            message[node] = high + np.log(np.exp(joint - high[:, :, None]).sum(axis=2))
            np.add.at(up, parent[node], message[node])
        belief = up.copy()  # of the root; below, all that comes from above is added
        for level in range(1, len(edges) - 1):
            node = order[edges[level] : edges[level + 1]]
            above = belief[parent[node]] - message[node]
            joint = above[:, :, None] + self.table[move[node]]
            high = joint.max(axis=1)
            belief[node] = up[node] + high + np.log(np.exp(joint - high[:, None, :]).sum(axis=1))
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return [p[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def states(page: Page) -> list[int]:
    """Labels of a training page; an element without one has its parent's."""
    out = [0]
    for k in range(1, len(page.tags)):
        out.append(STATES[page.labels[k]] if page.labels[k] else out[page.parents[k]])
    return out


def train(sources: list[str], smooth: float = 0.5) -> Model:
    """Count potentials and feature tables on labelled pages."""
    seen: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(3))
    move: dict[str, np.ndarray] = defaultdict(lambda: np.zeros((3, 3)))
    total, kinds = np.zeros(3), Counter()
    for source in sources:
        page = parse(source)
        label = states(page)
        for k, found in enumerate(features(page)):
            if k:
                total[label[k]] += 1
                move[page.tags[k]][label[page.parents[k]], label[k]] += 1
                for f in found:
                    seen[f][label[k]] += 1
                    kinds[f[0]] += 1
    # A tag speaks through its potential already; its own table is kept weak, and so is the text's shape.
    weight = {"t": 0.25, "l": 0.7, "o": 0.5, "n": 1.0}
    shown = {f: weight[f[0]] * np.log((n + smooth) / (total + 3 * smooth)) for f, n in seen.items()}
    shown = {f: v - v.max() for f, v in shown.items()}
    every = sum(move.values())
    other = np.log((every + smooth) / (every + smooth).sum(axis=1, keepdims=True))
    moves = {}
    for tag, n in move.items():
        mixed = n + 3 * np.exp(other)
        moves[tag] = np.log(mixed / mixed.sum(axis=1, keepdims=True))
    return Model(shown, moves, other)


_models: dict[int, Model] = {}


def model(pages: int = TRAINING_PAGES) -> Model:
    """The model of the generated training pages; trained once in each process that asks for it."""
    if pages not in _models:
        _models[pages] = train(labelled_pages(pages))
    return _models[pages]


def main_texts(sources: list[str], own: Model) -> list[str]:
    """Main text of every page."""
    pages = [parse(s) for s in sources]
    out = []
    for page, p in zip(pages, own.marginals(pages) if pages else [], strict=True):
        keep = p[:, 1] > p[:, 2]
        gone = [False] * len(page.tags)
        for k in range(1, len(page.tags)):
            gone[k] = page.tags[k] in SKIPPED or gone[page.parents[k]]
        blocks: dict[int, list[str]] = {}
        for node, text, run in page.chunks:
            if keep[node] and not gone[node]:
                blocks.setdefault(run, []).append(text)
        joined = (" ".join("".join(b).split()) for b in blocks.values())
        out.append(" ".join(b for b in joined if b))
    return out


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", own: Model | None = None) -> DataFrame:
    """key, url, text, n_chars of every page."""
    held = pages.sparkSession.sparkContext.broadcast(own or model())  # a few thousand features

    def run(batches):
        use = held.value
        for batch in batches:
            sources = [s or "" for s in batch.column(2).to_pylist()]
            texts, at = [], 0
            while at < len(sources):
                end, size = at, 0
                while end < len(sources) and (end == at or size + len(sources[end]) <= BATCH_CHARS):
                    size += len(sources[end])
                    end += 1
                texts += main_texts(sources[at:end], use)
                at = end
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["key", "url", "text", "n_chars"])

    kind = pages.schema[key].dataType.simpleString()
    out = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(source).alias("html"))
    return out.mapInArrow(run, f"key {kind}, url string, text string, n_chars long").withColumnRenamed("key", key)


__all__ = ["Model", "extract", "main_texts", "model", "train"]
