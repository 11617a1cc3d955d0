"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most 2r bits exactly if a value within r bits of both exists. So every
distinct fingerprint emits the ball of radius r around it, equal values meet in one shuffle, and what meets is
linked. A value's bucket holds no more fingerprints than a ball has values (65 for r = 1), however large the
groups of copies are, as copies share a fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.frames import durable, sized_join
from plumbline.functions.graph import connected_components
from plumbline.functions.session import ship_package

from .text import document_key

BITS = 64


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles as an unsigned integer; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1) - 1
    start = stop - size
    n = max(1, len(words) - width + 1)
    ends = stop[len(words) - n :] if len(words) >= width else stop[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], seed) for a, b in zip(start[:n].tolist(), ends.tolist(), strict=True)), "<u8", n)
    votes = np.zeros(BITS, np.int64)
    for i in range(0, n, 65536):  # bounded memory for very long texts
        votes += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, fp) for every row: the document's key and its fingerprint as a signed long. Null texts have no words."""

    def per_batch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts)).view(np.int64))

    ship_package(docs.sparkSession)
    return docs.select(*document_key(id_col, text_col), F.pandas_udf(per_batch, "long")(F.col(text_col)).alias("fp"))


def near_pairs(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within ``radius`` bits, from a table with column fp.

    What shares a value of a ball of half the radius lies within the radius of each other, so the members of a
    bucket are linked in a chain: no link between components is lost and none is emitted twice a bucket. An odd
    radius gives some buckets wider pairs; these fail the check, and a chain would not do, so it must be even.
    """
    if radius % 2 or radius < 0:
        raise ValueError("the radius must be even")
    masks = [sum(1 << i for i in c) for r in range(radius // 2 + 1) for c in combinations(range(BITS), r)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    ball = F.array(*[F.lit(m).cast("long") for m in signed])
    variants = fps.select("fp").distinct().select("fp", F.explode(ball).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("value"))
    met = variants.select(F.col("fp").alias("a"), F.lag("fp").over(Window.partitionBy("value").orderBy("fp")).alias("b"))
    return met.where(F.col("b").isNotNull()).distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def grouped(docs: DataFrame, width: int, radius: int, id_col: str, text_col: str) -> DataFrame:
    """(id, th, fp, low) for every row: low is the key of its component's first member, ids ascending and null ids last.

    Fingerprints are counted down to distinct ones before anything is joined, so a group of exact copies is one node.
    Documents whose fingerprint is neither repeated nor linked are their own group; the others' are looked up in a table
    of one row a fingerprint, which is broadcast if it is small and else joined with a shuffle in which AQE splits hot fingerprints.
    """
    docs = durable(fingerprints(docs, width, id_col, text_col))
    own = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("th"))
    nodes = durable(docs.groupBy("fp").agg(F.min(own).alias("low"), F.count("*").alias("n")))
    comp = connected_components(near_pairs(nodes, radius))
    linked = durable(sized_join(nodes.select("fp", "low"), comp.select(F.col("node").alias("fp"), "component"), "fp", "inner"))
    lows = durable(linked.groupBy("component").agg(F.min("low").alias("group_low")))
    moved = durable(sized_join(linked.select("fp", "component"), lows, "component", "inner").select("fp", "group_low"))
    decided = durable(sized_join(nodes, moved, "fp", "left").where("n > 1 or group_low is not null").select("fp", F.coalesce("group_low", "low").alias("low")))
    return sized_join(docs, decided, "fp", "left").select("id", "th", "fp", F.coalesce("low", own).alias("low"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row of docs; other columns are ignored.

    Documents are linked if their fingerprints differ in at most ``radius`` bits; component_id is the smallest
    id reachable (null if no member has one). Documents without words have fingerprint 0 and are linked like any
    other; repeated rows get repeated results; an empty table an empty result.
    """
    return grouped(docs, width, radius, id_col, text_col).select("id", "fp", F.col("low.id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each near-duplicate component: that with the smallest id, one with an id before those without.

    Of rows that are equal in id and text one stays. Texts move in no shuffle while the removed documents are few
    enough to be broadcast.
    """
    found = durable(grouped(docs, width, radius, id_col, text_col).select("id", "th", (F.col("id").eqNullSafe(F.col("low.id")) & (F.col("th") == F.col("low.th"))).alias("first")))
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("g.id")) & (F.xxhash64(F.col(f"d.{text_col}")) == F.col("g.th"))
    gone = durable(found.where("not first").select("id", "th").distinct())
    kept = sized_join(docs.alias("d"), gone.alias("g"), same, "left_anti")
    repeated = durable(found.where("first").groupBy("id", "th").count().where("count > 1").select("id", "th"))
    if repeated.isEmpty():
        return kept
    once = sized_join(kept.alias("d"), repeated.alias("g"), same, "left_anti")
    twice = sized_join(kept.alias("d"), repeated.alias("g"), same, "left_semi")
    return once.unionByName(twice.dropDuplicates([id_col, text_col]))
