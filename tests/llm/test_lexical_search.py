"""op12: the dual-tree walk against scoring every pair."""

import collections
import math
import random
import re

import numpy as np

from plumbline.llm import lexical_search

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def plain_terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def plain_search(docs, items, k=20):
    split = [(i, plain_terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in split), sum(len(w) for _, w in split)
    df = collections.Counter(t for _, w in split for t in set(w))
    out = []
    for item, text in set(items):
        scored = []
        for i, w in split:
            tf = collections.Counter(w)
            m = 75 + (25 * len(w) * n_docs) // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t in plain_terms(text) if tf[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def zipf(rng, n):
    return " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(n))


def found(spark, docs, items, **more):
    got = lexical_search.search(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS), **more)
    return sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_against_all_pairs(spark, monkeypatch):
    rng = random.Random(1)
    docs = [(i, zipf(rng, rng.randint(1, 60))) for i in range(900)]
    docs += [(1000 + i, docs[7][1]) for i in range(300)]  # equal scores by the hundred
    items = [(i, zipf(rng, rng.randint(1, 30))) for i in range(60)] + [(99, docs[7][1])]
    want = plain_search(docs, items)
    assert found(spark, docs, items) == want
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 2000)  # several blocks of items
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, k=3) == [r for r in want if r[1] <= 3]


def test_odd_rows(spark):
    docs = [(None, "alpha beta"), (1, None), (2, ""), (3, " .,; "), (4, "Alpha ALPHA beta"), (4, "Alpha ALPHA beta"), (4, "gamma"), (5, "ÀÉ ünï日本-語 x1y2"), (6, "filler " * 30_000 + "alpha"), (7, "delta")]
    items = [(1, "alpha beta"), (1, "alpha beta"), (1, "gamma gamma"), (2, None), (3, ""), (None, "ÀÉ x1y2"), (4, "unknown words only"), (5, "beta beta Beta alpha")]
    assert found(spark, docs, items) == plain_search(docs, [(i, t) for i, t in items if t])
    assert found(spark, [], items) == [] and found(spark, docs, []) == []
    clash = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as n", "2 as terms", "true as first", "3 as item", "4 as score", "5 as rank")
    assert lexical_search.search(clash, spark.createDataFrame(items, ITEMS)).count() == len(plain_search(docs, [(i, t) for i, t in items if t]))


def test_groups_and_pruning(monkeypatch):
    """Several item groups, dense parts of a few documents, and pairs left out, with the same best documents."""
    monkeypatch.setattr(lexical_search, "GROUP_TERMS", 40)
    monkeypatch.setattr(lexical_search, "CELLS", 40 * 64)
    rng = np.random.default_rng(5)
    n_terms, n_docs, n_items = 300, 2000, 50
    weights = rng.integers(1, 9000, n_terms)
    per = np.sort(rng.integers(0, n_docs, 12_000))
    term = rng.integers(0, n_terms, len(per))
    ids, row = np.unique(per, return_inverse=True)
    value = weights[term] * rng.integers(1, 50, len(per))
    pair = np.unique(row * n_terms + term, return_index=True)[1]
    row, term, value = row[pair], term[pair], value[pair]
    asked = [{int(t): int(rng.integers(1, 3)) for t in rng.choice(n_terms, 6, replace=False)} for _ in range(n_items)]
    order, groups = lexical_search.item_groups(asked, weights)
    best = lexical_search.Best(np.ones(n_items), 5)
    scored = lexical_search.search_batch(ids, row, term, value, weights, groups, best)
    dense = np.zeros((len(ids), n_terms), np.int64)
    dense[row, term] = value
    for place, item in enumerate(order):
        scores = sum(dense[:, t] * c for t, c in asked[item].items())
        want = sorted(((int(s), -int(i)) for s, i in zip(scores, ids) if s > 0), reverse=True)[:5]
        assert sorted(best.heaps[place], reverse=True) == want
    leaves = sum(-(-(g.root.end - g.root.start) // lexical_search.ITEM_LEAF) for g in groups) * -(-len(ids) // lexical_search.DOC_LEAF)
    assert len(groups) > 3 and scored < leaves
