"""Ranked lexical search: the highest-scoring documents of every query item, found by a dual-tree walk.

A document's coordinate for a term is the term's weight times its damped frequency; an item's is how often it asks
for the term; the score is their product summed over terms. Both sides are put in hierarchies whose nodes hold the
largest coordinate of each term below them, so the product of two nodes bounds every score between them, and a pair
of nodes that can't reach the weakest of the kth scores of its items is left out with all below it.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.frames import ensure_checkpoint_dir, written

#: Documents of one hierarchy and of one of its leaves; nodes below a node; items of a leaf.
BATCH, DOC_LEAF, FAN, ITEM_LEAF = 4096, 32, 8, 8
#: Terms of a group of items that are searched together, and coordinates that one group's documents take in memory.
GROUP_TERMS, CELLS = 4096, 16_000_000
#: Bytes of item texts that are taken at a time; more items are searched in further blocks.
ITEM_BYTES = 32_000_000
#: One in so many documents is searched first, to bound the kth scores of the rest from below.
FIRST = 16

_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
COORDINATES = "doc_id long, n long, terms array<int>, tfs array<int>, first boolean"


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all other than ASCII characters, only A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_ASCII).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Node(NamedTuple):
    """Items start to end, the columns they ask for, the most that one of them asks, and the nodes or items below."""

    start: int
    end: int
    cols: np.ndarray
    most: np.ndarray
    below: list
    asks: np.ndarray | None


class Group(NamedTuple):
    columns: np.ndarray
    root: Node


def item_groups(asked: list[dict[int, int]], weights: np.ndarray) -> tuple[list[int], list[Group]]:
    """Items ordered by their weightiest terms and their hierarchies, each over at most GROUP_TERMS terms or one item."""
    order = sorted(range(len(asked)), key=lambda i: sorted(((int(weights[t]), t) for t in asked[i]), reverse=True)[:3])
    groups, at = [], 0
    while at < len(order):
        columns: set[int] = set()
        end = at
        while end < len(order) and (end == at or len(columns | asked[order[end]].keys()) <= GROUP_TERMS):
            columns |= asked[order[end]].keys()
            end += 1
        cols = np.array(sorted(columns), np.int64)
        nodes = []
        for a in range(at, end, ITEM_LEAF):
            b = min(a + ITEM_LEAF, end)
            own = np.array(sorted(set().union(*(asked[order[i]] for i in range(a, b)))), np.int64)
            asks = np.array([[asked[order[i]].get(int(t), 0) for i in range(a, b)] for t in own], np.float64)
            nodes.append(Node(a, b, np.searchsorted(cols, own), asks.max(1), [], asks))
        while len(nodes) > 1:
            above = []
            for k in range(0, len(nodes), FAN):
                below = nodes[k : k + FAN]
                most = np.zeros(len(cols))
                for x in below:
                    most[x.cols] = np.maximum(most[x.cols], x.most)
                own = np.flatnonzero(most)
                above.append(Node(below[0].start, below[-1].end, own, most[own], below, None))
            nodes = above
        groups.append(Group(cols, nodes[0]))
        at = end
    return order, groups


class Best:
    """The best k of each item so far, as heaps of (score, -doc_id), and what a score must reach to enter."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.need, self.heaps = k, floors.copy(), [[] for _ in floors]

    def offer(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        heap = self.heaps[item]
        for at in np.flatnonzero(scores >= self.need[item]):
            entry = (int(scores[at]), -int(ids[at]))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.need[item] = max(self.need[item], heap[0][0])


def walk(root: Node, levels: list[np.ndarray], ids: np.ndarray, best: Best) -> int:
    """Search one hierarchy of documents (its leaves' documents first, its root last); the pairs of leaves that were scored."""
    scored = 0
    top = len(levels) - 1
    stack = [(float(levels[top][0, root.cols] @ root.most), root, top, 0)]
    while stack:
        bound, node, level, at = stack.pop()
        if bound < best.need[node.start : node.end].min():
            continue
        if level == 1 and not node.below:
            docs = slice(at * DOC_LEAF, (at + 1) * DOC_LEAF)
            scores = levels[0][docs][:, node.cols] @ node.asks
            for i in range(node.start, node.end):
                best.offer(i, scores[:, i - node.start], ids[docs])
            scored += 1
        elif level == 1 or (node.below and node.end - node.start > ITEM_LEAF * FAN ** (level - 1)):
            stack += sorted(((float(levels[level][at, x.cols] @ x.most), x, level, at) for x in node.below), key=lambda p: p[0])
        else:
            a, b = at * FAN, min((at + 1) * FAN, len(levels[level - 1]))
            bounds = levels[level - 1][a:b][:, node.cols] @ node.most
            stack += [(float(bounds[j]), node, level - 1, a + int(j)) for j in np.argsort(bounds, kind="stable")]
    return scored


def search_batch(ids: np.ndarray, row: np.ndarray, term: np.ndarray, value: np.ndarray, weights: np.ndarray, groups: list[Group], best: Best) -> int:
    """Search documents given by their coordinates (row, term, value), sorted by row, each row with one at least."""
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    lead = np.maximum.reduceat(weights[term] * len(weights) + term, starts)  # documents with a weighty term in common lie together
    place = np.empty(len(ids), np.int64)
    order = np.argsort(-lead, kind="stable")
    place[order] = np.arange(len(ids))
    ids, row = ids[order], place[row]
    most = np.zeros(len(weights))
    np.maximum.at(most, term, value)
    scored = 0
    for group in groups:
        root = group.root
        bound = float(most[group.columns[root.cols]] @ root.most)
        if bound < best.need[root.start : root.end].min():
            continue
        col = np.searchsorted(group.columns, term)
        own = (col < len(group.columns)) & (group.columns[np.minimum(col, len(group.columns) - 1)] == term)
        step = max(DOC_LEAF, min(len(ids), CELLS // len(group.columns) // DOC_LEAF * DOC_LEAF))
        for a in range(0, len(ids), step):
            part = own & (row >= a) & (row < a + step)
            # Sums of whole numbers below 2**53 are exact in doubles.
            dense = np.zeros((min(step, len(ids) - a), len(group.columns)), np.float64 if bound < 2**53 else np.int64)
            dense[row[part] - a, col[part]] = value[part]
            levels = [dense]
            while len(levels) == 1 or len(levels[-1]) > 1:
                levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), DOC_LEAF if len(levels) == 1 else FAN)))
            scored += walk(root, levels, ids[a : a + step], best)
    return scored


def coordinates(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs, first) of every document: its number of terms, and how often the known ones occur."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ns, found, tfs = [], [], []
            for text in batch.column(1):
                words = terms(text.as_py())
                tf = Counter(words)
                hit = [(known[t], c) for t, c in tf.items() if t in known]
                ns.append(len(words))
                found.append([t for t, _ in hit])
                tfs.append([c for _, c in hit])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(found, ints), pa.array(tfs, ints), batch.column(2)], ["doc_id", "n", "terms", "tfs", "first"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(FIRST)) == 0).alias("first"))
    return picked.mapInArrow(count, COORDINATES)


def search_part(coords: DataFrame, weights: np.ndarray, groups: list[Group], floors: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's best k of every item that reach the item's floor."""
    shared = coords.sparkSession.sparkContext.broadcast((weights, groups, floors))
    last_id = 2**63 - 1

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, groups, floors = shared.value
        best = Best(floors, k)
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH):
                batch = whole.slice(a, BATCH)
                ids = np.array([last_id if x is None else x for x in batch.column(0).to_pylist()], np.int64)
                n = batch.column(1).to_numpy()
                sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
                term, tf = batch.column(2).flatten().to_numpy().astype(np.int64), batch.column(3).flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(ids)), sizes)
                m = 100 - 25 + (25 * n * n_docs) // n_terms
                value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
                search_batch(ids, row, term, value, weights, groups, best)
        rows = [(i, None if -d == last_id else -d, s) for i, heap in enumerate(best.heaps) for s, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return coords.select("doc_id", "n", "terms", "tfs").mapInArrow(search, "item int, doc_id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, items: list[tuple], k: int, id_col: str, text_col: str) -> list[DataFrame]:
    """The results of one block of items, (item_id, rank, doc_id, score)."""
    spark = docs.sparkSession
    asked_terms = [Counter(terms(text)) for _, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*asked_terms)))}
    if not vocabulary:
        return []
    coords = written(coordinates(docs, vocabulary, id_col, text_col))
    n_docs, n_terms = coords.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in coords.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        df[r["t"]] = r["count"]
    if not df.any():
        return []
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    asked = [{vocabulary[t]: c for t, c in a.items() if df[vocabulary[t]]} for a in asked_terms]
    kept = [i for i, a in enumerate(asked) if a]
    order, groups = item_groups([asked[i] for i in kept], weights)
    hit = coords.where(F.size("terms") > 0)
    nothing = np.ones(len(order))
    early = written(best_of(search_part(hit.where("first"), weights, groups, nothing, n_docs, n_terms, k), k).drop("rank"))
    floors = nothing.copy()
    for r in early.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).toLocalIterator():
        floors[r.item] = r.least
    late = search_part(hit.where(~F.col("first")), weights, groups, floors, n_docs, n_terms, k)
    names = spark.createDataFrame([(i, items[kept[j]][0]) for i, j in enumerate(order)], f"item int, item_id {_item_type(items)}")
    ranked = best_of(early.unionByName(late), k)
    return [ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")]


def _item_type(items: list[tuple]) -> str:
    return "string" if any(isinstance(i, str) for i, _ in items) else "long"


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The k highest-scoring documents of each item with a score above 0: item_id, rank, doc_id, score.

    Terms are those of terms(). N counts the documents with a term, L all their terms, n one document's, df the
    documents with a term. A term weighs w = floor(1000 ln((2N + 2) / (2df + 1))); with m = 100 - 25 + 25 n N div L a
    document scores the sum of w * (10**9 tf div (1000 tf + 12 m)) over the item's terms, repeats included. Equal
    scores rank by id, null last.

    Texts are read once and shuffled never: what remains of a document are its counts of the items' terms. Each task
    builds hierarchies over batches of its documents and walks them against the items' hierarchy, best pairs first.
    One document in FIRST (by hash) is searched ahead; the kth scores it gives are floors for all others, which
    changes what is pruned and how few candidates a task returns, but no result. Items come to the driver, in blocks
    of about ITEM_BYTES of text, each block with a pass of its own. Null and empty texts have no terms: such items
    give no rows, such documents are never found. Repeated item rows count once, an item_id with several texts ranks
    for each of them; repeated documents each take a rank. Ids of documents are numbers; other columns are ignored.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    kind = items.schema[item_id_col].dataType.simpleString()
    wanted = items.select(F.col(item_id_col).alias("i"), F.col(item_text_col).alias("t")).where("t is not null").distinct()
    size = wanted.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    blocks = -(-size // ITEM_BYTES)
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for b in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t").collect()
        for found in search_block(docs, [tuple(r) for r in block], k, id_col, text_col):
            out = out.unionByName(found.withColumn("item_id", F.col("item_id").cast(kind)))
    return out
