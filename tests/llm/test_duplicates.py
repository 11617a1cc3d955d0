"""op3 and op7: fuzzy lines and near-duplicates against brute force."""

import collections
import random

import xxhash

from plumbline.llm import line_dedup, simhash


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark, documents):
    got = simhash.near_duplicates(documents).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    ids = [r.id for r in got]
    fps = [r.fp % 2**64 for r in got]
    assert fps == [brute_fingerprint(texts[i]) for i in ids]
    comp = components(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    low = collections.defaultdict(lambda: 1 << 60)
    for i, c in enumerate(comp):
        low[c] = min(low[c], ids[i])
    assert [r.component_id for r in got] == [low[c] for c in comp]


def test_links_of_random_fingerprints(spark):
    rng = random.Random(3)
    fps = {0, 2**64 - 1}
    while len(fps) < 300:
        x = rng.choice(sorted(fps)) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 3)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp bigint")
    got = [(r.a % 2**64, r.b % 2**64) for r in simhash.near_pairs(df).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in got)
    at = {f: i for i, f in enumerate(fps)}
    want = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert components(len(fps), [(at[a], at[b]) for a, b in got]) == components(len(fps), want)


def test_simhash_odd_rows(spark, odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == 9
    assert {r.component_id for r in got if r.fp == 0} == {1}
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    assert sum(r.doc_id == 3 and r.text == "one two three" for r in rows) == 1 and sum(r.text == "" for r in rows) == 1
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.drop_near_duplicates(no_docs).count() == 0


def brute_lines(docs):
    rows = []
    for i, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\r\x0b\x0c").lower()
            if line:
                rows.append((i, k, line))
    rows.sort()
    lines = sorted({x for _, _, x in rows})
    sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in lines]
    links = [(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    comp = dict(zip(lines, components(len(lines), links)))
    seen, gone = set(), collections.defaultdict(list)
    for i, k, x in rows:
        if comp[x] in seen:
            gone[i].append(k)
        seen.add(comp[x])
    return gone


def test_lines_against_brute_force(spark, documents):
    few = documents.where("doc_id < 90")
    want = brute_lines([(r.doc_id, r.text) for r in few.collect()])
    got = {r.id: list(r.gone) for r in line_dedup.dedup_report(few).collect() if r.gone}
    assert got == dict(want)


def test_hot_group_of_near_lines(spark):
    base = "the quick brown fox jumps over the lazy dog and runs along the river bank until the evening sun goes down behind the hills"
    rng = random.Random(5)
    docs = []
    for i in range(400):
        words = base.split()
        words[rng.randrange(len(words))] = f"w{i}"
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, f"a line of its own number {i * 7919} with nothing {i * i} shared {i ** 3}") for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.id for r in line_dedup.dedup_report(df).collect() if r.gone}
    want = set(brute_lines(docs))
    assert len(want - got) <= 0.01 * len(want) and not got - want


def templated(groups, size, seed=7):
    """Lines of one template: groups that differ in a long part, and lines of a group in a few characters."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head, tail = " ".join(word(6) for _ in range(10)), " ".join(word(6) for _ in range(9))
    docs = []
    for g in range(groups):
        own = word(13)
        docs += [(g + groups * k, f"{head} {own} {tail} {word(10)}") for k in range(size)]
    return docs


def test_groups_inside_a_crowded_bucket(spark):
    docs = templated(600, 2)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(12)
    want = brute_lines(docs)
    got = {r.id for r in line_dedup.dedup_report(df).collect() if r.gone}
    assert len(want) == 600 and not got - set(want)
    assert len(set(want) - got) <= 0.01 * len(want)


def altered(n, most, seed):
    """Copies of one sentence with 1 to ``most`` words changed: similar pairs and pairs that just aren't."""
    rng = random.Random(seed)
    base = "every crate that left the harbour last winter was weighed twice and entered by hand in the long ledger of the customs house".split()
    docs = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(1, most)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
        docs.append((i, " ".join(words)))
    return docs


def test_a_crowded_bucket_loses_no_link_and_partitions_do_not_matter(spark):
    docs = altered(900, 3, 11)
    want = set(brute_lines(docs))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = [{r.id for r in line_dedup.dedup_report(df.repartition(n)).collect() if r.gone} for n in (1, 60)]
    assert got[0] == got[1] and not got[0] - want
    assert len(got[0]) >= 0.99 * len(want) > 100


def test_shingle_numbers_are_exact():
    rng = random.Random(2)
    grams = lambda x: {x[i : i + 8] for i in range(max(1, len(x) - 7))}
    lines = ["", "short", "seven77", "eight888", "é" * 30, "ﬁ" * 9, "日本語" * 6] + ["".join(rng.choice("abé\xff") for _ in range(rng.randint(5, 40))) for _ in range(60)]
    for some in (lines, [x for x in lines if max(map(ord, x), default=0) < 256]):
        sets = line_dedup.shingles(some)
        for a, x in zip(some, sets):
            for b, y in zip(some, sets):
                both, either = len(grams(a) & grams(b)), len(grams(a) | grams(b))
                if min(len(a), len(b)) >= 8:
                    assert line_dedup.similar(x, y) == (both >= 0.8 * either), (a, b)


def test_pieces_find_what_brute_force_finds():
    for docs in (altered(300, 4, 3), templated(120, 2)):
        lines = [(i, line, i) for i, (_, line) in enumerate(docs)]
        sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for _, x, _ in lines]
        links = [(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        got = list(line_dedup.similar_across(lines, lines))
        assert components(len(lines), got) == components(len(lines), links)


def test_line_text_and_odd_rows(spark, odd_docs, no_docs):
    df = spark.createDataFrame([(1, "Same line here today\n\nonly mine", 5), (2, "  same line here TODAY \nother", 6), (3, None, 7), (4, "", 8)], "doc_id bigint, text string, gone int")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: "Same line here today\n\nonly mine", 2: "other", 3: None, 4: ""}
    out = line_dedup.dedup_lines(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == 9
    assert line_dedup.dedup_lines(no_docs).count() == 0 and line_dedup.dedup_report(no_docs).count() == 0
