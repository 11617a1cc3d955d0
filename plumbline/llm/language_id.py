"""Language identification by nearest centroid.

A text is the normalised TF-IDF vector of its character n-grams, hashed to a fixed width. Every language
has several centroids, found by spherical k-means over a bounded sample of labelled rows. A text gets the language
of the nearest centroid by cosine; it is marked as rejected when it is farther from that centroid than the
language's own training texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.frames import durable, sized_join
from plumbline.functions.session import ship_package

from .text import spread

BUCKETS = 4096
#: Bounds of the fit: texts a language, texts of all languages (but LEAST_TEXTS of each), characters of one text and of all.
FIT_TEXTS, FIT_ALL, LEAST_TEXTS, FIT_CHARS, ALL_CHARS = 400, 25_600, 20, 20_000, 100_000_000
CENTROIDS, ROUNDS = 4, 12
UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def counts(text: str | None) -> np.ndarray | None:
    """Hashed counts of the letter 1-, 2- and 3-grams of the lower-cased text, word edges counting as a blank; None without letters."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    x = np.where(letters()[code], code, 0).astype(np.uint32)
    if not x.any():
        return None
    x = np.r_[np.uint32(0), x, np.uint32(0)]
    x = x[np.r_[True, (x[1:] != 0) | (x[:-1] != 0)]]
    a, b, c = x * np.uint32(0x9E3779B1), x * np.uint32(0x85EBCA77), x * np.uint32(0xC2B2AE3D)
    mid = x[1:-1] != 0
    grams = (a[x != 0], (a[:-1] ^ b[1:]) + np.uint32(1), ((a[:-2] ^ b[1:-1]) + c[2:] + np.uint32(2))[mid])
    h = np.concatenate(grams)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return np.bincount((h >> np.uint32(12)) & np.uint32(BUCKETS - 1), minlength=BUCKETS)


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    idf: np.ndarray
    #: One row for each centroid, its language's place in langs, and the cosine below which that language rejects.
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray

    def vectors(self, rows: list[np.ndarray]) -> np.ndarray:
        v = np.log1p(np.stack(rows)).astype(np.float32) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine (0 to 1) and whether it is rejected, for each text."""
        langs, score, odd = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        for i in range(0, len(texts), 256):
            found = [(k, c) for k, t in enumerate(texts[i : i + 256], i) if (c := counts(t)) is not None]
            if not found or not self.langs:
                continue
            cos = self.vectors([c for _, c in found]) @ self.centroids.T
            best = cos.argmax(axis=1)
            for (k, _), b, row in zip(found, best, cos, strict=True):
                own = self.owner[b]
                langs[k], score[k], odd[k] = self.langs[own], min(1.0, max(0.0, float(row[b]))), row[b] < self.floor[own]
        return langs, score, odd


def cluster(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first starts: the same data give the same centroids."""
    at = [v.mean(axis=0)]
    while len(at) < min(k, len(v)):
        at.append(v[(v @ np.stack(at).T).max(axis=1).argmin()])
    c = np.stack(at)
    for _ in range(ROUNDS):
        near = (v @ c.T).argmax(axis=1)
        c = np.stack([v[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", fit_texts: int = FIT_TEXTS) -> LanguageModel:
    """A model from a bounded sample of rows that have a text and a language.

    Texts are counted by language over all data, copies once; of every language about ``fit_texts`` texts (fewer if there
    are so many languages that FIT_ALL is passed) are drawn by a hash of the text, so that reruns draw alike. Of a text
    longer than FIT_CHARS characters (fewer, if all would pass ALL_CHARS) pieces that are spread over all of it are
    learned from. The sample alone reaches the driver, the languages' counts don't. Without any labelled row the model
    knows no language and says UNKNOWN.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t")).withColumn("h", F.xxhash64(F.lit(11), "t"))
    sizes = durable(rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")))
    known = max(1, sizes.count())
    most = min(fit_texts, max(LEAST_TEXTS, FIT_ALL // known))
    chars = max(500, min(FIT_CHARS, ALL_CHARS // (known * most)))
    part = sizes.select("lang", F.least(F.lit(1.0), 2.0 * most / F.greatest("n", F.lit(1))).alias("part"))
    drawn = sized_join(rows, part, "lang", "inner").where(F.pmod("h", F.lit(1 << 30)) < F.lit(float(1 << 30)) * F.col("part"))
    drawn = drawn.select("lang", "h", spread(F.col("t"), chars).alias("t")).dropDuplicates(["lang", "h", "t"])
    some = drawn.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))).where(F.col("k") <= most).select("lang", "t").toPandas().sort_values(["lang", "t"])
    got = [(lang, at := np.flatnonzero(c), c[at].astype(np.uint32)) for lang, t in zip(some["lang"], some["t"], strict=True) if (c := counts(t)) is not None]
    if not got:
        return LanguageModel((), np.ones(BUCKETS, np.float32), np.zeros((0, BUCKETS), np.float32), np.zeros(0, int), np.zeros(0))
    names = tuple(sorted({lang for lang, _, _ in got}))
    seen = np.bincount(np.concatenate([at for _, at, _ in got]), minlength=BUCKETS)
    model = LanguageModel(names, np.log((1 + len(got)) / (1 + seen)).astype(np.float32) + np.float32(0.1), np.zeros((0, BUCKETS), np.float32), np.zeros(0, int), np.zeros(0))
    centroids, owner, floor = [], [], []
    for i, lang in enumerate(names):
        own = [(at, n) for name, at, n in got if name == lang]
        dense = np.zeros((len(own), BUCKETS), np.uint32)
        for row, (at, n) in zip(dense, own, strict=True):
            row[at] = n
        v = model.vectors(list(dense))
        c = cluster(v, CENTROIDS)
        centroids.append(c)
        owner += [i] * len(c)
        floor.append(0.8 * float(np.quantile((v @ c.T).max(axis=1), 0.01)))
    return LanguageModel(names, model.idf, np.concatenate(centroids), np.array(owner), np.array(floor))


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls in the part that is kept from learning; a null id doesn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for every row of docs; other columns are ignored.

    lang_pred is the nearest centroid's language, and UNKNOWN for null texts and texts without letters (score 0,
    rejected). ``rejected`` marks texts farther from it than its training texts. Row-wise with the broadcast model.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def per_batch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, score, odd = shared.value.predict(texts.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": score, "rejected": odd})

    got = F.pandas_udf(per_batch, "lang_pred string, score double, rejected boolean")
    return docs.select(F.col(id_col), got(F.col(text_col)).alias("_g")).select(id_col, "_g.*")
