"""op11: the trie of rebuilt conversations against a plain one, cut into any number of shards."""

import collections
import hashlib
import random
import zlib

import pytest

from plumbline.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain_trie(rows, block=20):
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in turns.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % block, [])[:h] + ts[h:])
    members = collections.defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    kids = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, cs in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += (len(cs) - 1) * len(n[-1][1].split()) if n else 0
    ends = {n: ",".join(str(c) for c in sorted(cs) if len(whole[c]) == len(n)) for n, cs in members.items()}
    return sorted((min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), kids[n], leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, cs in members.items())


def conversations(n, seed):
    """Few distinct turns, so that sequences share beginnings; a third of all conversations are alike."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        alike = rng.random() < 0.33
        for turn in range(3 if alike else rng.randint(1, 7)):
            rows.append((c, turn, "user", f"turn {turn} all alike") if alike else (c, turn, rng.choice("ua"), "word " * rng.randint(0, 3)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns", [20, 150, 100_000])
def test_trie_in_any_number_of_shards(spark, shard_turns):
    rows = conversations(400, shard_turns)
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(7), shard_turns=shard_turns)
    assert sorted(tuple(r) for r in got.collect()) == plain_trie(rows)


def test_odd_conversations(spark):
    rows = [(None, 1, "u", "no id"), (1, None, None, None), (1, 2, "user", ""), (1, 2, "user", ""), (1, 2, "user", "tie"), (2, 0, "us", "er"), (3, 0, "u", "ser"), (20, 5, "u", "w " * 50_000), (-5, 0, "u", "below zero"), (7, 3, None, "x")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as code", "2 as codes", "3 as shard", "4 as words", "5 as depth", "6 as digest")
    want = plain_trie([r for r in rows if r[0] is None or r[0] >= 0])
    assert sorted(tuple(r) for r in prefix_trie.conversation_trie(df.where("conv_id >= 0 or conv_id is null"), shard_turns=3).collect()) == want
    assert sum(r.depth == 0 for r in prefix_trie.conversation_trie(df).collect()) == 1
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_end_lists_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 3)
    rows = [(c, t, "u", f"turn {t}") for c in range(0, 2000, 20) for t in range(2)]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), shard_turns=25)
    assert sorted(tuple(r) for r in got.collect()) == plain_trie(rows)


def test_tree_is_balanced():
    seqs = [[k] for k in range(1023)]
    symbol, low, equal, high, path = prefix_trie.ternary_tree(seqs)
    depth = {equal[0]: 1}
    for node in sorted(depth | {n: 0 for n in range(1, len(symbol))}):
        for down in (low[node], high[node]):
            if down:
                depth[down] = depth[node] + 1
    assert max(depth.values()) == 10 and [symbol[p[0]] for p in path] == list(range(1023))
