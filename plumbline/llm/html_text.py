"""The main text of web pages: boosted trees judge the nodes of the page, and one consistent choice is read off."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .page_dom import Node, features, parse
from .page_samples import MARK, sample_page

#: Pages laid out to learn from, trees and their depth, step, bins of a feature, least weight of a leaf, ridge.
SAMPLES, TREES, DEPTH, STEP, BINS, LEAST, RIDGE = 500, 50, 4, 0.25, 32, 4.0, 1.0
#: Pages whose nodes are judged at once.
BATCH = 256


class Forest(NamedTuple):
    """Trees as arrays of 2**DEPTH - 1 splits (feature, threshold) and 2**DEPTH leaves, and the first guess."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float


def predict(forest: Forest, x: np.ndarray) -> np.ndarray:
    """The probability of each row that it belongs to the main text."""
    score = np.full(len(x), forest.start)
    rows = np.arange(len(x))
    for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
        score += leaf[at - (2**DEPTH - 1)]
    return 1 / (1 + np.exp(-score))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Gradient boosting of the log-likelihood with second-order leaves, splits at quantiles of each feature."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)  # bin b: cuts[b - 1] < x <= cuts[b]
    lanes = binned + np.arange(width) * BINS
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score = np.full(n, start)
    features_, thresholds, leaves = [], [], []
    inner = 2**DEPTH - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, wide = 2**level - 1, 2**level
            slot = ((at - first)[:, None] * width * BINS + lanes).ravel()
            g = np.bincount(slot, np.repeat(grad, width), wide * width * BINS).reshape(wide, width, BINS).cumsum(2)
            h = np.bincount(slot, np.repeat(hess, width), wide * width * BINS).reshape(wide, width, BINS).cumsum(2)
            gr, hr = g[:, :, -1:] - g, h[:, :, -1:] - h
            gain = g * g / (h + RIDGE) + gr * gr / (hr + RIDGE) - g[:, :, -1:] ** 2 / (h[:, :, -1:] + RIDGE)
            gain = np.where((h >= LEAST) & (hr >= LEAST), gain, 0.0).reshape(wide, -1)
            best = gain.argmax(1)
            for k in range(wide):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, best[k]] > 1e-9 and b < len(cuts[f]):
                    feature[first + k], threshold[first + k] = f, cuts[f][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        place = at - inner
        leaf = STEP * np.bincount(place, grad, 2**DEPTH) / (np.bincount(place, hess, 2**DEPTH) + RIDGE)
        score += leaf[place]
        features_.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Forest(np.array(features_), np.array(thresholds), np.array(leaves), start)


def truth(nodes: list[Node]) -> np.ndarray:
    """Of a laid-out page: which nodes hold main text. The marks are taken out of the runs."""
    y = np.zeros(len(nodes))
    for k in range(len(nodes) - 1, -1, -1):
        if MARK in nodes[k].text:
            nodes[k].text = nodes[k].text.replace(MARK, "")
            y[k] = 1
        if y[k] and k:
            y[nodes[k].parent] = 1
    return y


def fit(samples: int = SAMPLES, seed: int = 0) -> Forest:
    """A forest learnt from ``samples`` pages laid out by chance; the same on every run."""
    xs, ys = [], []
    for k in range(samples):
        page = sample_page(seed * 1_000_003 + k)
        nodes = parse(page)
        ys.append(truth(nodes))
        xs.append(np.array(features(nodes, len(page)), np.float64))
    return boost(np.concatenate(xs), np.concatenate(ys))


def decode(nodes: list[Node], p: np.ndarray) -> list[bool]:
    """The likeliest choice of nodes in which whatever is kept lies in something kept, so no kept part sits in a dropped one."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    yes, no = np.log(p), np.log1p(-p)
    keep, drop = yes.tolist(), no.tolist()
    for k in range(len(nodes) - 1, 0, -1):
        up = nodes[k].parent
        keep[up] += max(keep[k], drop[k])
        drop[up] += drop[k]
    out = [keep[0] > drop[0]]
    for k in range(1, len(nodes)):
        out.append(out[nodes[k].parent] and keep[k] > drop[k])
    return out


def main_texts(pages: list[str | None], forest: Forest) -> list[str]:
    """The main text of each page: kept runs in page order, a blank line between them."""
    parsed = [parse(p or "") for p in pages]
    rows = [row for nodes, p in zip(parsed, pages) for row in features(nodes, len(p or ""))]
    found = predict(forest, np.array(rows, np.float64))
    out, at = [], 0
    for nodes in parsed:
        kept = decode(nodes, found[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n\n".join(n.text for n, k in zip(nodes, kept) if k and n.text))
    return out


def extract(pages: DataFrame, forest: Forest, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Pages with their main text in ``text_col``; all other columns stay, but one of that name is replaced.

    The article without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and
    readers' comments. Each task parses its pages into block elements and runs of text, takes features of every node
    (density of its subtree, words of its attributes, depth, how it stands among its siblings, the same of what is
    above it) and asks the forest; the choice of nodes then maximises the likelihood under the rule that nothing kept
    lies in something dropped. No shuffle; a page is held whole in memory, and BATCH pages at a time. Null, empty and
    unparsable pages give an empty text; a page cut off anywhere is read as far as it goes; equal pages get equal texts.
    """
    shared = pages.sparkSession.sparkContext.broadcast(forest)
    rest = [x for x in pages.columns if x != text_col]
    packed = pages.select(F.struct(*[F.col(f"`{x}`") for x in rest]).alias("page"), F.col(f"`{html_col}`").cast("string").alias("html"))
    schema = packed.select("page").schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH):
                batch = whole.slice(a, BATCH)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(main_texts(batch.column(1).to_pylist(), shared.value), pa.string())], ["page", "text"])

    found = packed.mapInArrow(run, schema)
    return found.select(*[F.col(f"page.`{x}`").alias(x) for x in rest], F.col("text").alias(text_col))
