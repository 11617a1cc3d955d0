"""op1, op2 and op4: exact counts and held-out accuracy."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import language_id, token_count, toxicity
from plumbline.llm import queries as q

tokenizers = pytest.importorskip("public_tokenizers")
MODEL = tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "the", " ", "  ", "\n", "\r\n", "é", "▁", "<s>", "</s>", "<unk>", "<0x41>", "日本", "ing", "\t", "\x00", "😀", "12", "...", "==", "İ", "ﬁ", "\u200b", "x" * 20]), max_size=30).map("".join) | st.text(max_size=60))
def test_token_counts_are_the_librarys(library, text):
    assert token_count.counter(MODEL).count([text])[0] == len(library.encode(text, num_threads=1))


def test_long_chunks(library):
    texts = ["a" * 20_000, "日本語" * 3_000, " " * 3_000, "".join(chr(97 + i * i % 26) for i in range(10_000))]
    assert token_count.counter(MODEL).count(texts).tolist() == [len(library.encode(t)) for t in texts]


def test_documents_and_odd_rows(spark, library, documents, odd_docs, no_docs):
    got = {(r.doc_id, r.n_bytes): r for r in token_count.count_tokens(documents, MODEL).collect()}
    for r in documents.collect():
        mine = got[r.doc_id, len(r.text.encode())]
        assert mine.n_tokens == len(library.encode(r.text)) and mine.over_limit == (mine.n_tokens > 4096)
    odd = token_count.count_tokens(odd_docs, MODEL).collect()
    assert len(odd) == 9 and sum(r.n_tokens == 0 and r.n_bytes == 0 for r in odd) == 2
    assert token_count.count_tokens(no_docs, MODEL).count() == 0


def test_language_accuracy_on_held_out_rows(spark, sf, documents):
    got = q.op2_language_id(spark, sf).toPandas().merge(documents.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all()


def test_language_odd_rows(spark, odd_docs, no_docs, documents):
    model = language_id.fit(documents)
    got = {r.doc_id: r for r in language_id.identify(odd_docs, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == language_id.UNKNOWN and got[1].score == 0
    assert language_id.identify(no_docs, model).count() == 0
    empty = language_id.fit(no_docs)
    assert {r.lang_pred for r in language_id.identify(documents.limit(3), empty).collect()} == {language_id.UNKNOWN}


def test_rejection_by_distance(spark, documents):
    model = language_id.fit(documents)
    langs, score, odd = model.predict(["the and that is of this", "щы жуы длрп ывапр", None])
    assert not odd[0] and odd[1] and odd[2] and score[1] < score[0]


def brute_marginals(u, moves, start):
    n, paths = len(u), []
    for code in range(2**n):
        s = [(code >> i) & 1 for i in range(n)]
        paths.append((s, np.exp(start * s[0] + sum(a * b for a, b in zip(u, s)) + sum(moves[a][b] for a, b in zip(s, s[1:])))))
    z = sum(w for _, w in paths)
    return [sum(w for s, w in paths if s[i]) / z for i in range(n)]


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 0, 6, 1, 4])
    u, moves = rng.normal(size=sizes.sum()), rng.normal(size=(2, 2))
    got, at = toxicity.marginals(u, sizes, moves, 0.3), 0
    for n in sizes:
        if n:
            assert np.allclose(got[at : at + n], brute_marginals(u[at : at + n], moves, 0.3))
        at += n


def log_likelihood(u, moves, start, labels):
    total, own = -np.inf, None
    for code in range(2 ** len(u)):
        s = [(code >> i) & 1 for i in range(len(u))]
        w = start * s[0] + sum(a * b for a, b in zip(u, s)) + sum(moves[a][b] for a, b in zip(s, s[1:]))
        total = np.logaddexp(total, w)
        own = w if s == labels else own
    return own - total


def test_expected_steps_are_the_likelihoods_gradient():
    rng = np.random.default_rng(5)
    sizes, chains = np.array([4, 1, 6]), [[0, 1, 1, 0], [1], [1, 0, 0, 1, 1, 1]]
    u, moves, start = rng.normal(size=11), rng.normal(size=(2, 2)), -0.4
    parts = np.split(u, np.cumsum(sizes)[:-1])
    value = lambda m, x: sum(log_likelihood(p, m, start, c) for p, c in zip(np.split(x, np.cumsum(sizes)[:-1]), chains))
    assert np.isfinite(value(moves, np.concatenate(parts)))
    gamma, want = toxicity.expectations(u, sizes, moves, start)
    true = np.zeros((2, 2))
    for c in chains:
        for a, b in zip(c, c[1:]):
            true[a, b] += 1
    for i in range(2):
        for j in range(2):
            d = np.zeros((2, 2))
            d[i, j] = 1e-5
            assert abs((value(moves + d, u) - value(moves - d, u)) / 2e-5 - (true - want)[i, j]) < 1e-6
    flat = np.concatenate(chains)
    for k in range(11):
        d = np.zeros(11)
        d[k] = 1e-5
        assert abs((value(moves, u + d) - value(moves, u - d)) / 2e-5 - (flat - gamma)[k]) < 1e-6


def brute_grams(text):
    low = "".join(x if x.isalpha() else " " for x in text.lower())
    padded = " " + " ".join(low.split()) + " "
    return [g for n in (1, 2, 3) for i in range(len(padded) - n + 1) if (g := padded[i : i + n]).strip() and not (n == 3 and g[1] == " ")]


def test_language_vectors_and_nearest_centroid(spark, documents):
    for text in ("Der Hund, die Katze!", "a", "l'été 2024 — où?", "日本 語x"):
        assert language_id.counts(text).sum() == len(brute_grams(text))
    assert language_id.counts("12 .. 34") is None and language_id.counts(None) is None
    model = language_id.fit(documents)
    texts = [r.text for r in documents.limit(60).collect()]
    langs, score, _ = model.predict(texts)
    for t, lang, s in zip(texts, langs, score):
        x = language_id.counts(t)
        if x is None:
            continue
        v = np.log1p(x) * model.idf.astype(float)
        cos = [float(v @ c) / np.linalg.norm(v) for c in model.centroids]
        assert abs(max(cos) - s) < 1e-4 and (max(cos) - max(c for c, o in zip(cos, model.owner) if model.langs[o] == lang)) < 1e-4


def test_language_copies_count_once_and_no_language_is_left_out(spark):
    word = lambda k, i: "".join(chr(97 + (k * 7 + i * j) % 26) for j in range(6))
    rows = [("aa", "one text copied over and over")] * 3000 + [("aa", " ".join(word(1, i + j) for j in range(30))) for i in range(50)]
    rows += [(f"l{k}", " ".join(word(k, j) for j in range(20))) for k in range(90)] + [("long", "zyx " * 9_000)]
    model = language_id.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert len(model.langs) == 92 and "long" in model.langs


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    got = q.op4_toxicity(spark, d).toPandas().merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.97
    assert held[held.toxic == 1].predicted.mean() > 0.85
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    row = next(r for r in got.itertuples() if r.predicted == 1 and len(r.spans))
    assert all(texts[row.doc_id][s["start"] : s["end"]].split() for s in map(lambda x: x.asDict() if hasattr(x, "asDict") else x, row.spans))


def test_toxicity_odd_rows(spark, odd_docs, no_docs, documents):
    import pandas as pd

    blank = toxicity.fit(pd.DataFrame({"t": [], "y": []}))
    got = toxicity.score_toxicity(odd_docs, blank).collect()
    assert len(got) == 9 and all(0 <= r.score < 0.5 and r.spans == [] for r in got)
    assert toxicity.score_toxicity(no_docs, blank).count() == 0


def test_long_texts_teach(spark):
    """All texts far over the bounds: both models learn from pieces that are spread over all of a text."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(60):
        text = [rng.choice(words) for _ in range(9_000)]
        if k % 2:
            for at in range(4_500, 9_000, 40):  # in the second half alone
                text[at] = rng.choice(["vilething", "nastything"])
        rows.append((k, " ".join(text)))
        labels.append((k, k % 2))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    some = toxicity.sample(docs, labels)
    assert set(some.y) == {0, 1} and some.t.str.len().max() <= toxicity.FIT_CHARS * 1.01 and len(some) == 60
    model = toxicity.fit(some)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert all((got[k] >= 0.5) == bool(k % 2) for k in got)


def test_sample_of_long_texts_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_ALL", 5_000)
    docs = spark.createDataFrame([(k, "word " * 400) for k in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, toxic int")
    some = toxicity.sample(docs, labels)
    assert sorted(some.groupby("y").t.apply(lambda t: t.str.len().sum()).tolist()) == [6_000, 6_000]


def test_spread_pieces(spark):
    from pyspark.sql import functions as F

    from plumbline.llm.text import spread

    texts = ["", "short", "a" * 100, "".join(chr(0x4E00 + k % 900) for k in range(1_003)), None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spread(F.col("t"), 100, 10).alias("s"))
    for r in df.collect():
        if r.t is None or len(r.t) <= 100:
            assert r.s == r.t
        else:
            parts = r.s.split(" ")
            assert len(parts) == 10 and parts[0] == r.t[:10] and parts[-1] == r.t[-10:] and all(p in r.t and len(p) == 10 for p in parts)
