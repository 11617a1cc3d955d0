"""Toxic spans by a linear-chain conditional random field with the states clean and toxic.

Labels of documents become labels of tokens: in a toxic document, a token is toxic if one of its features (the
word, its beginnings and endings) is far commoner in toxic than in clean documents. The field is fitted to those
token labels. Forward-backward marginals of every token give a document's score and its offending offsets.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.session import ship_package

from .text import spread

#: Bounds of the fit: documents of each label, characters of one and of all of a label's, features kept.
FIT_TOXIC, FIT_CLEAN, FIT_CHARS, FIT_ALL, FIT_FEATURES = 1000, 1500, 24_000, 8_000_000, 30_000
#: A telling feature occurs in so many toxic documents at least, and so much more often there (log of the ratio).
SUPPORT, TELLING = 3, 2.5
CHAIN, EPOCHS, RATE, DECAY = 128, 60, 0.5, 1e-4
#: Words whose emission a worker keeps, and tokens that are scored at once.
CACHE_WORDS, BATCH_TOKENS = 500_000, 1_500_000
EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»¿¡“”„’–—"


def features(word: str) -> list[str]:
    """The bare lower-cased word, its beginnings of 3 to 7 and endings of 3 and 4 characters."""
    w = word.lower().strip(EDGES)
    if not w:
        return []
    return [f"w {w}", *(f"b {w[:n]}" for n in range(3, min(7, len(w) - 1) + 1)), *(f"e {w[-n:]}" for n in range(3, min(4, len(w) - 1) + 1))]


def marginals(u: np.ndarray, sizes: np.ndarray, moves: np.ndarray, start: float) -> np.ndarray:
    """P(toxic) of every token. u: log-odds by token, documents one after the other; moves[i, j]: log-potential of i to j."""
    return expectations(u, sizes, moves, start, with_pairs=False)[0]


def expectations(u: np.ndarray, sizes: np.ndarray, moves: np.ndarray, start: float, with_pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of every token, and the expected number of each step: pairs[i, j] sums the marginals of neighbours in i and j (left at zero without with_pairs: only a fit asks for it).

    All documents take each step together, the longest first, so that memory is the number of tokens.
    """
    pairs = np.zeros((2, 2))
    if not len(u):
        return np.zeros(0), pairs
    e = np.exp(np.clip(u, -30, 30))
    order = np.argsort(-sizes, kind="stable")
    length = sizes[order]
    active = np.searchsorted(-length, -np.arange(length[0]), side="left")  # documents longer than t
    offset = np.r_[0, np.cumsum(active)]
    rank = np.empty(len(sizes), np.int64)
    rank[order] = np.arange(len(sizes))
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    step = np.arange(len(u)) - np.repeat(first, sizes)
    at = offset[step] + np.repeat(rank, sizes)
    x = np.empty(len(u))
    x[at] = e
    (oo, ot), (to, tt) = np.exp(moves)
    f = np.empty(len(u))  # P(toxic | the tokens so far)
    p = np.full(active[0], 1 / (1 + np.exp(-start)))
    p = p * x[: active[0]] / (p * x[: active[0]] + 1 - p)
    f[: active[0]] = p
    for t in range(1, len(active)):
        a, n = offset[t], active[t]
        p = p[:n]
        one = ((1 - p) * ot + p * tt) * x[a : a + n]
        p = one / (one + (1 - p) * oo + p * to)
        f[a : a + n] = p
    out = np.empty(len(u))
    g = np.zeros(0)  # the share of toxic in the backward message
    for t in range(len(active) - 1, -1, -1):
        a, n = offset[t], active[t]
        if len(g):
            nxt = x[offset[t + 1] : offset[t + 1] + active[t + 1]]
            here = f[a : a + len(g)]
            if with_pairs:
                steps = np.array([[(1 - here) * oo * (1 - g), (1 - here) * ot * nxt * g], [here * to * (1 - g), here * tt * nxt * g]])
                pairs += (steps / steps.sum(axis=(0, 1))).sum(axis=2)
            one, none = to * (1 - g) + tt * nxt * g, oo * (1 - g) + ot * nxt * g
            g = one / (one + none)
        g = np.r_[g, np.full(n - len(g), 0.5)]
        both = f[a : a + n] * g
        out[a : a + n] = both / (both + (1 - f[a : a + n]) * (1 - g))
    return out[at], pairs


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float
    moves: np.ndarray
    start: float
    #: Of the document's score: constant, of log(1 + expected toxic tokens), of the largest marginal.
    final: np.ndarray
    known: dict[str, float] = field(default_factory=dict)

    def emission(self, word: str) -> float:
        u = self.known.get(word)
        if u is None:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            u = self.bias + sum(self.weights.get(f, 0.0) for f in features(word))
            if len(word) <= 48:
                self.known[word] = u
        return u

    def score(self, texts: list[str | None], threshold: float = 0.5) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """A score for each text and the offsets (code points, end exclusive) of tokens above the threshold."""
        out, spans, i = np.zeros(len(texts)), [], 0
        while i < len(texts):
            words, sizes, total = [], [], 0
            while i < len(texts) and total < BATCH_TOKENS:
                w = (texts[i] or "").split()
                words.append(w)
                sizes.append(len(w))
                total += len(w)
                i += 1
            get = self.known.get
            u = np.fromiter((x if (x := get(w)) is not None else self.emission(w) for ws in words for w in ws), float, total)
            sizes = np.array(sizes)
            gamma = marginals(u, sizes, self.moves, self.start)
            ends = np.cumsum(sizes)
            for k, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True), i - len(sizes)):
                g = gamma[a:b]
                top = float(g.max()) if len(g) else 0.0
                z = self.final @ np.array([1.0, np.log1p(g[g > 0.02].sum()), top])
                out[k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                spans.append([m.span() for m, x in zip(re.finditer(r"\S+", texts[k]), g, strict=True) if x > threshold] if top > threshold else [])
        return out, spans


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> pd.DataFrame:
    """A bounded sample of labelled texts (columns t, y) for fit(): at most FIT_TOXIC and FIT_CLEAN rows of labels.

    Rows are drawn by a hash of the id, and of an id's texts that with the smallest hash, so reruns draw alike. Texts of any
    length teach: of one over FIT_CHARS characters, pieces that are spread over all of it. A label's texts are taken in
    the order of their hashes until FIT_ALL characters are reached, so long texts make the sample fewer and not blank.
    The chosen ids (bounded) are broadcast to the scan of docs, of whose texts only the chosen are shuffled.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    h = F.xxhash64(F.lit(5), "id")
    most = F.when(F.col("y") == 1, FIT_TOXIC).otherwise(FIT_CLEAN)
    part = F.when(F.col("y") == 1, 2.0 * FIT_TOXIC / max(1, n.get(1, 0))).otherwise(2.0 * FIT_CLEAN / max(1, n.get(0, 0)))
    some = known.withColumn("h", h).where(F.pmod("h", F.lit(1 << 20)) < F.lit(float(1 << 20)) * part)
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy("h", "id"))).where(F.col("k") <= most).select("id", "y", "h")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(some), "id").withColumn("t", spread(F.col("t"), FIT_CHARS))
    first = Window.partitionBy("id", "y").orderBy(F.xxhash64("t"), "t")
    rows = rows.withColumn("k", F.row_number().over(first)).where("k = 1")
    before = F.sum(F.length("t")).over(Window.partitionBy("y").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < FIT_ALL)
    return rows.select("id", "t", "y").toPandas().sort_values(["id", "y"])[["t", "y"]]


def fit(labelled: pd.DataFrame) -> ToxicityModel:
    """A model from a sample with columns t (text) and y (0 or 1). Without rows of both labels every text scores below 0.5."""
    texts, y = labelled["t"].tolist(), labelled["y"].to_numpy(int)
    blank = ToxicityModel({}, -8.0, np.zeros((2, 2)), -4.0, np.array([-4.0, 0.0, 0.0]))
    if not (y == 1).any() or not (y == 0).any():
        return blank
    docs = [t.split() for t in texts]
    vocabulary: dict[str, int] = {}
    ids = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in d), np.int64, len(d)) for d in docs]
    of = [features(w) for w in vocabulary]
    names: dict[str, int] = {}
    flat = np.fromiter((names.setdefault(f, len(names)) for fs in of for f in fs), np.int64, sum(map(len, of)))
    starts = np.r_[0, np.cumsum([len(fs) for fs in of])]
    seen = np.zeros((2, len(names)))
    for d, label in zip(ids, y, strict=True):
        words = np.unique(d)
        if len(words):
            fs = np.unique(np.concatenate([flat[starts[w] : starts[w + 1]] for w in words]))
            seen[label, fs] += 1
    odds = np.log((seen[1] + 0.5) / ((y == 1).sum() + 1)) - np.log((seen[0] + 0.5) / ((y == 0).sum() + 1))
    telling = (seen[1] >= SUPPORT) & (odds >= TELLING)
    keep = np.flatnonzero((seen.sum(axis=0) >= SUPPORT) & (np.abs(odds) >= 0.7))
    keep = keep[np.argsort(-np.abs(odds[keep]) * np.log1p(seen.sum(axis=0)[keep]), kind="stable")][:FIT_FEATURES]
    new = np.full(len(names), -1)
    new[keep] = np.arange(len(keep))
    owner = np.repeat(np.arange(len(of)), np.diff(starts))
    word_telling = np.bincount(owner, telling[flat], len(of)) > 0
    on = new[flat] >= 0
    word_of, feature_of = owner[on], new[flat][on]

    tokens = np.concatenate([d for d in ids if len(d)]) if any(map(len, ids)) else np.zeros(0, np.int64)
    labels = np.concatenate([word_telling[d] & (label == 1) for d, label in zip(ids, y, strict=True) if len(d)]) if len(tokens) else np.zeros(0, bool)
    if not labels.any():
        return blank
    sizes = np.array([s for d in ids if len(d) for s in [CHAIN] * (len(d) // CHAIN) + [len(d) % CHAIN] * bool(len(d) % CHAIN)])
    head = np.r_[0, np.cumsum(sizes)[:-1]]
    inner = np.ones(len(tokens), bool)
    inner[head] = False
    inner = np.flatnonzero(inner)
    true = labels.astype(float)
    pairs = np.array([[np.sum((1 - true[inner - 1]) * (1 - true[inner])), np.sum((1 - true[inner - 1]) * true[inner])], [np.sum(true[inner - 1] * (1 - true[inner])), np.sum(true[inner - 1] * true[inner])]])
    moves = np.log((pairs + 1) / (pairs.sum(axis=1, keepdims=True) + 2))
    start = float(np.log((true[head].sum() + 1) / (len(head) - true[head].sum() + 1)))
    weights, bias = np.zeros(len(keep)), 0.0
    square, square_bias, square_moves = np.full(len(keep), 1e-2), 1e-2, np.full((2, 2), 1e-2)
    scale = max(1.0, true.sum())
    for _ in range(EPOCHS):
        u = (np.bincount(word_of, weights[feature_of], len(of)) + bias)[tokens]
        gamma, want = expectations(u, sizes, moves, start)
        gap = np.bincount(tokens, true - gamma, len(of))
        g = np.bincount(feature_of, gap[word_of], len(keep)) / scale - DECAY * weights
        square += g * g
        weights += RATE * g / np.sqrt(square)
        gb = gap.sum() / scale
        square_bias += gb * gb
        bias += RATE * gb / np.sqrt(square_bias)
        gm = (pairs - want) / scale
        square_moves += gm * gm
        moves = moves + 0.1 * RATE * gm / np.sqrt(square_moves)
    model = ToxicityModel({f: float(weights[new[i]]) for f, i in names.items() if new[i] >= 0 and abs(weights[new[i]]) > 1e-3}, float(bias), moves, start, np.zeros(3))
    x = []
    for d in range(0, len(texts), 500):
        some = ids[d : d + 500]
        words = np.concatenate(some) if any(map(len, some)) else np.zeros(0, np.int64)
        g = marginals((np.bincount(word_of, weights[feature_of], len(of)) + bias)[words], np.array([len(s) for s in some]), moves, start)
        at = 0
        for s in some:
            own = g[at : at + len(s)]
            at += len(s)
            x.append([1.0, np.log1p(own[own > 0.02].sum()), own.max() if len(own) else 0.0])
    x, final = np.array(x), np.zeros(3)
    for _ in range(50):  # Newton steps of a logistic regression with a little decay
        p = 1 / (1 + np.exp(-x @ final))
        final += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (y - p) - 0.05 * final)
    model.final = final
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, spans) for every row of docs; other columns are ignored.

    spans holds the start and end (code points, end exclusive) of the tokens whose marginal is above one half. Null
    and empty texts have no tokens and get the score of no evidence. Row-wise with the broadcast model.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def per_batch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            score, spans = shared.value.score(texts.tolist())
            yield pd.DataFrame({"score": score, "spans": [[{"start": a, "end": b} for a, b in s] for s in spans]})

    got = F.pandas_udf(per_batch, "score double, spans array<struct<start:int,end:int>>")
    return docs.select(F.col(id_col), got(F.col(text_col)).alias("_g")).select(id_col, "_g.*")
