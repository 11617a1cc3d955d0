"""Fuzzy line dedup: one line stays of every component of lines that resemble each other.

Lines are sets of character shingles. MinHash signatures by one-permutation hashing are cut into bands, lines
that share a band become candidates, exact Jaccard similarity decides, and connected components over the links
that hold give the groups. Exact copies are one node from the start.

Within a bucket every similar pair ends up connected, however large the bucket is: each line is compared with a
line at the head of its block, and only buckets that these links leave in several components are compared in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.frames import durable, sized_join, written
from plumbline.functions.graph import connected_components, merged_components
from plumbline.functions.session import ship_package

from .text import document_key

SHINGLE, SIMILARITY = 8, 0.8
#: Bands of rows: a pair at the similarity shares a band with probability 1 - (1 - 0.8^4)^10 = 0.995.
BANDS, ROWS = 10, 4
#: Lines of a bucket that are first compared with one of them; smaller than a bucket only to keep any one line from many partners.
BLOCK = 64
#: Lines and characters of a large bucket that meet at once in a task.
PIECE_LINES, PIECE_CHARS = 256, 1_000_000
#: Pairs of a piece that are compared as they are; for more, lines first have to share a rare shingle.
FEW_PAIRS = 256
#: Line numbers that a task remembers, so that it sends a line once however often it meets it.
MEMORY = 1_000_000
#: Lines and characters whose keys are made at once, and lines whose shingles a task keeps while it verifies pairs.
HASHED_LINES, HASHED_CHARS, KEPT_SETS = 2048, 120_000, 400
EMPTY = np.uint64(2**64 - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def band_keys(lines: list[str]) -> np.ndarray:
    """BANDS keys for each line; lines of the same shingles have the same keys.

    Each shingle is hashed once: some bits choose a bin, the others compete for its minimum. An empty bin borrows
    from a full one that only the bin's number and the attempt choose, so that lines borrow alike.
    """
    bins = BANDS * ROWS
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    code = np.frombuffer(("\n".join(lines) + "\n" * SHINGLE).encode("utf-32-le", "replace"), np.uint32)
    n = np.maximum(size - SHINGLE + 1, 1)
    start = np.r_[0, np.cumsum(size + 1)[:-1]]
    pos = np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    c = code.astype(np.uint64)
    two = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    four = two[:-2] * np.uint64(0x165667B19E3779F9) + (two[2:] ^ (two[2:] >> np.uint64(31)))
    m = len(code) - SHINGLE + 1
    eight = mixed(four[:m] * np.uint64(0x27D4EB2F165667C5) + (four[4 : 4 + m] ^ (four[4 : 4 + m] >> np.uint64(32))))
    short = size < SHINGLE  # the whole line is its one shingle
    h = eight[pos]
    owner = np.repeat(np.arange(len(lines)), n)
    if short.any():
        whole = np.fromiter((hash_text(lines[i]) for i in np.flatnonzero(short)), np.uint64)
        h[np.cumsum(n)[short] - 1] = whole
    cell = owner * bins + (((h >> np.uint64(44)) * np.uint64(bins)) >> np.uint64(20)).view(np.int64)
    sig = np.full(len(lines) * bins, EMPTY)
    np.minimum.at(sig, cell, h & np.uint64(2**44 - 1))
    sig = sig.reshape(len(lines), bins)
    full = sig != EMPTY
    out = sig.copy()
    column = np.arange(bins, dtype=np.uint64)
    row, col = np.nonzero(~full)
    attempt = 0
    while len(row):
        attempt += 1
        step = (mixed((column + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        lender = step[col]
        good = full[row, lender]
        out[row[good], col[good]] = sig[row[good], lender[good]]
        row, col = row[~good], col[~good]
    keys = np.zeros((len(lines), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mixed((keys ^ out[:, r::ROWS]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1))
    return mixed(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def hash_text(line: str) -> int:
    h = 1469598103934665603
    for ch in line:
        h = ((h ^ ord(ch)) * 1099511628211) & (2**64 - 1)
    return h


def shingles(lines: list[str]) -> list[np.ndarray]:
    """The set of shingles of each line, as sorted numbers that stand for the same shingle in all of them.

    Eight characters of one byte are a number of 64 bits as they are; if any line has others, shingles are numbered as
    they come. A line shorter than a shingle is its own; it resembles no other line.
    """
    try:
        held = [line.encode("latin-1") for line in lines]
    except UnicodeEncodeError:
        known: dict[str, int] = {}
        parts = ({line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))} for line in lines)
        return [np.sort(np.fromiter((known.setdefault(x, len(known)) for x in some), np.uint64, len(some))) for some in parts]
    out = []
    for line in held:
        x = np.sort(np.ndarray(max(1, len(line) - SHINGLE + 1), "<u8", line.ljust(SHINGLE, b"\0"), strides=(1,)))
        out.append(x[np.r_[True, x[1:] != x[:-1]]])
    return out


def similar(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sets of shingles is at least ``least``."""
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    every = np.sort(np.concatenate((x, y)))
    both = int((every[1:] == every[:-1]).sum())
    return both >= least * (len(x) + len(y) - both)


def hashed_groups(fresh: dict[int, tuple[int, str]]) -> Iterator[list[tuple[int, int, str]]]:
    """The lines (lid, mark, line) in groups that band_keys() takes at once."""
    group, chars = [], 0
    for lid, (mark, line) in fresh.items():
        if group and (len(group) >= HASHED_LINES or chars + len(line) > HASHED_CHARS):
            yield group
            group, chars = [], 0
        group.append((lid, mark, line))
        chars += len(line)
    if group:
        yield group


def read_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table of two kinds of rows, from one pass over the texts.

    Each row of docs gives (id, th, lids, marks): the two halves of a 128-bit hash of each of its lines, trimmed and
    lower-cased, null where a line is blank. Each line gives (lid, mark, line, keys) with its band keys, about once
    for each task that meets it. A null text has no lines.
    """
    keyed = docs.select(*document_key(id_col, text_col), F.col(text_col).alias("text"))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([keyed.schema["id"], T.StructField("th", T.LongType()), T.StructField("lids", longs), T.StructField("marks", longs)])
    schema = schema.add("lid", "long").add("mark", "long").add("line", "string").add("keys", longs)
    names = schema.names

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            lines, sizes = [], []
            for text in batch.column(2).to_pylist():
                some = text.split("\n") if text is not None else []
                sizes.append(len(some))
                lines += [x.strip(" \t\r\x0b\x0c").lower() for x in some]
            h = np.frombuffer(b"".join(digest(x.encode("utf-8", "replace")) for x in lines), "<i8").reshape(-1, 2)
            blank = np.fromiter((not x for x in lines), bool, len(lines))
            ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            halves = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(h[:, k]), mask=blank)) for k in (0, 1)]
            none = [pa.nulls(len(sizes), t) for t in (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *halves, *none], names)
            if len(met) > MEMORY:
                met.clear()
            fresh = {lid: (mark, line) for lid, mark, line in zip(h[:, 0].tolist(), h[:, 1].tolist(), lines, strict=True) if line and lid not in met}
            met.update(fresh)
            for group in hashed_groups(fresh):
                keys, n = band_keys([line for _, _, line in group]), len(group)
                held = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                empty = [pa.nulls(n, t) for t in (batch.schema.field(0).type, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
                own = [pa.array(x, t) for x, t in zip(zip(*group, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*empty, *own, held], names)

    return written(keyed.mapInArrow(per_batch, schema))


def bucket_links(rows: DataFrame) -> DataFrame:
    """(key, lid, head): every line of a bucket but the first, with the line it is compared with.

    Lines of a bucket are ordered by lid, alike in every band, so that lines that share several bands give the same
    pair. A line is paired with the head of its block of BLOCK lines, and a head with that of the block before. So pairs
    grow with the lines, no line has many partners, and each bucket is connected. A task reads its sorted partition as a stream.
    """
    spread = rows.select(F.explode("keys").alias("key"), "lid").repartition("key").sortWithinPartitions("key", "lid")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, lid, place in its bucket, and head of its block, of the last row
        for batch in batches:
            key, lid = (batch.column(k).to_numpy() for k in (0, 1))
            if last is not None:
                key, lid = np.r_[last[0], key], np.r_[last[1], lid]
            own = np.r_[True, (key[1:] != key[:-1]) | (lid[1:] != lid[:-1])]
            key, lid = key[own], lid[own]
            if not len(key):
                continue
            at = np.arange(len(key))
            begins = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], at, 0))
            place = at - begins
            if last is not None:
                place += np.where(begins == 0, last[2], 0)
            carried = last[3] if last is not None else lid[0]
            head_of = at - place + BLOCK * ((place - 1) // BLOCK)
            head = np.where(head_of >= 0, lid[np.maximum(head_of, 0)], carried)
            out = place > 0
            if last is not None:
                out[0] = False
            end = len(key) - 1
            block = end - place[end] % BLOCK
            last = key[end], lid[end], place[end], lid[block] if block >= 0 else carried
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(lid[out]), pa.array(head[out])], ["key", "lid", "head"])

    return written(spread.mapInArrow(per_batch, "key long, lid long, head long"))


def similar_across(left: list[tuple[int, str, int]], right: list[tuple[int, str, int]]) -> Iterator[tuple[int, int]]:
    """Links that join the (lid, line, component) of left to those of right: every pair of components with similar lines ends up connected.

    Lines of n shingles that are similar share one of their n - ceil(0.8 n) + 1 rarest; only these are looked up where
    the pairs are many. Pairs that the links found so far connect are left out.
    """
    texts = {lid: line for lid, line, _ in (*left, *right)}
    sets = dict(zip(texts, shingles(list(texts.values())), strict=True))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if len(left) * len(right) <= FEW_PAIRS:
        partners = lambda _: right
    else:
        _, number, often = np.unique(np.concatenate(list(sets.values())), return_inverse=True, return_counts=True)
        rank = np.empty(len(often), np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(len(often))
        ends = np.cumsum([len(x) for x in sets.values()])
        rare = {lid: np.sort(r)[: len(r) - math.ceil(SIMILARITY * len(r)) + 1].tolist() for lid, r in zip(sets, np.split(rank[number], ends[:-1]), strict=True)}
        held: dict[int, list[int]] = {}
        for i, (lid, _, _) in enumerate(right):
            for x in rare[lid]:
                held.setdefault(x, []).append(i)
        partners = lambda lid: [right[i] for i in sorted({i for x in rare[lid] for i in held.get(x, ())})]
    for lid, _, component in left:
        for other, _, there in partners(lid):
            if (x := root(component)) != (y := root(there)) and similar(sets[lid], sets[other]):
                parent[x] = y
                yield lid, other


def remaining_links(found: DataFrame, comp: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): similar lines of different components that share a bucket, each such pair of components connected.

    Only buckets of three lines and more in which a first comparison failed are looked at, and of those with the same lines
    only one. Lines outside a bucket's largest component meet all its lines, in pieces of PIECE_LINES lines
    or PIECE_CHARS characters, so that a hot bucket is spread over many tasks and links, not pairs, leave a task.
    """
    label = lambda end: comp.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
    rows = sized_join(sized_join(found, label("lid"), "lid", "left"), label("head"), "head", "left")
    rows = written(rows.select("key", *[F.struct(F.col(end).alias("lid"), F.coalesce(f"c_{end}", end).alias("component")).alias(end) for end in ("lid", "head")]))
    apart = rows.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("lid.component") != F.col("head.component")).alias("failed")).where("n > 1 and failed").select("key")
    members = sized_join(rows, durable(apart), "key", "left_semi").select("key", F.explode(F.array("lid", "head")).alias("m")).select("key", "m.*").distinct()
    members = written(members)
    sums = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("lid")).alias("x"), F.bit_xor(F.xxhash64("lid", F.lit(1))).alias("y")]
    parts = members.groupBy("key", "component").agg(*sums).groupBy("key").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.max(F.struct("n", "component")).alias("top"))
    one = parts.groupBy("n", "x", "y").agg(F.min(F.struct("key", "top")).alias("s"))
    chosen = durable(one.select("s.key", "n", F.col("s.top.component").alias("top"), F.col("s.top.n").alias("most")))
    met = sized_join(members, chosen, "key", "inner").join(texts.select("lid", "line"), "lid")
    met = written(met.select("key", "lid", "component", "line", "n", (F.col("component") != F.col("top")).alias("odd"), (F.col("n") - F.col("most")).alias("n_odd")))
    chars = durable(met.groupBy("key").agg(F.sum(F.length("line")).alias("chars"), F.sum(F.when(F.col("odd"), F.length("line")).otherwise(0)).alias("odd_chars")))
    met = sized_join(met, chars, "key", "inner")
    pieces = lambda n, size: F.greatest(F.ceil(n / PIECE_LINES), F.ceil(size / PIECE_CHARS), F.lit(1)).cast("int")
    met = met.withColumn("ka", pieces(F.col("n"), F.col("chars"))).withColumn("ks", pieces(F.col("n_odd"), F.col("odd_chars")))
    left = met.where("odd").select("key", F.pmod(F.xxhash64("lid"), F.col("ks")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ka") - 1)).alias("j"), F.lit(0).alias("side"), "lid", "component", "line")
    right = met.select("key", F.explode(F.sequence(F.lit(0), F.col("ks") - 1)).alias("i"), F.pmod(F.xxhash64("lid"), F.col("ka")).cast("int").alias("j"), F.lit(1).alias("side"), "lid", "component", "line")
    dealt = left.unionByName(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "lid")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, ([], [])
        out: list[tuple[int, int]] = []

        def packed() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])
            out.clear()
            return done

        for batch in batches:
            for key, i, j, side, lid, component, line in zip(*[col.to_pylist() for col in batch.columns], strict=True):
                if (key, i, j) != at:
                    out += similar_across(*sides)
                    at, sides = (key, i, j), ([], [])
                sides[side].append((lid, line, component))
            yield packed()
        out += similar_across(*sides)
        yield packed()

    return dealt.mapInArrow(per_batch, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose lines are similar; texts has one row (lid, line) for each line."""

    def per_batch(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        kept: dict[str, np.ndarray] = {}

        def of(line: str) -> np.ndarray:
            got = kept.get(line)
            if got is None:
                if len(kept) >= KEPT_SETS:
                    kept.clear()
                got = kept[line] = shingles([line])[0]
            return got

        def close(x: str, y: str) -> bool:
            try:
                x.encode("latin-1"), y.encode("latin-1")
            except UnicodeEncodeError:
                return similar(*shingles([x, y]))
            return similar(of(x), of(y))

        for xs, ys in batches:
            yield pd.Series([close(x, y) for x, y in zip(xs, ys, strict=True)], dtype=bool)

    both = pairs.select("a", "b").join(texts.select(F.col("lid").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("lid").alias("b"), F.col("line").alias("y")), "b")
    return both.where(F.pandas_udf(per_batch, "boolean")("x", "y")).select("a", "b")


def line_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lid, mark, component) of every line that resembles another one, and the table of read_lines().

    Each line is first compared with one other of each bucket; buckets that these links leave in several components are then
    compared in full across components. So a dense group costs a few comparisons for each line, and a bucket
    of lines that aren't similar all of them. Of lines that share 64 bits of their hash but aren't equal, one takes part.
    """
    ship_package(docs.sparkSession)
    table = read_lines(docs, id_col, text_col)
    lines = table.where("lid is not null")
    found = bucket_links(lines.select("lid", "keys"))
    pairs = durable(found.select(F.least("lid", "head").alias("a"), F.greatest("lid", "head").alias("b")).distinct())
    wanted = durable(pairs.select(F.explode(F.array("a", "b")).alias("lid")).distinct())
    texts = sized_join(lines.select("lid", "mark", "line"), wanted, "lid", "left_semi").groupBy("lid").agg(F.min(F.struct("mark", "line")).alias("m"))
    texts = written(texts.select("lid", "m.mark", "m.line"))
    comp = durable(connected_components(verified(pairs, texts)))
    more = durable(remaining_links(found, comp, texts))
    if not more.isEmpty():
        comp = merged_components(comp, more)
    return comp.select(F.col("node").alias("lid"), "component").join(texts.select("lid", "mark"), "lid"), table


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, th, gone): for each document that loses lines, their numbers (from 0, ascending); and the table of read_lines().

    Of every component the line with the smallest (id, number) stays, ids being compared first and null ids last.
    Lines are counted by hash with partial aggregation; only lines that repeat or resemble another one are
    gathered by document, so a common line never meets in one task.
    """
    comp, table = line_groups(docs, id_col, text_col)
    lines = table.where("lids is not null").select("id", "th", F.posexplode(F.arrays_zip("lids", "marks")).alias("no", "x")).select("id", "th", "no", F.col("x.lids").alias("lid"), F.col("x.marks").alias("mark")).where("lid is not null")
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("no"), F.col("th"))
    by_line = lines.groupBy("lid", "mark").agg(F.count("*").alias("n"), F.min(place).alias("at"))
    grouped = sized_join(by_line, durable(comp), ["lid", "mark"], "left").where((F.col("n") > 1) | F.col("component").isNotNull())
    fuzzy = F.col("component").isNotNull()
    group = F.struct(fuzzy.alias("fuzzy"), F.coalesce("component", "lid").alias("a"), F.when(fuzzy, F.lit(0)).otherwise(F.col("mark")).alias("b"))
    grouped = durable(grouped.select("lid", "mark", "at", group.alias("component")))
    stay = durable(grouped.groupBy("component").agg(F.min("at").alias("stay")))
    decided = durable(sized_join(grouped, stay, "component", "inner").select("lid", "mark", "stay"))
    hit = sized_join(lines, decided, ["lid", "mark"], "inner")
    here = F.col("id").eqNullSafe(F.col("stay.id")) & (F.col("no") == F.col("stay.no")) & (F.col("th") == F.col("stay.th"))
    return hit.where(~here).groupBy("id", "th").agg(F.sort_array(F.collect_set("no")).alias("gone")), table


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the removed lines cut out of the text; all columns kept, blank lines and null texts as they are.

    Rows that are equal in id and text lose the same lines: the first occurrence of a line within such a row stays in
    each of them. A document all of whose lines go keeps its row with what is left of the text.
    """
    gone = durable(removed_lines(docs, id_col, text_col)[0])
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *document_key(id_col, text_col))
    both = sized_join(d.alias("d"), gone.alias("g"), F.col("d.id").eqNullSafe(F.col("g.id")) & (F.col("d.th") == F.col("g.th")), "left")
    text = F.col(f"doc.`{text_col}`")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    new = F.when(F.col("gone").isNull(), text).otherwise(kept)
    return both.select(*[(new.alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c)) for c in docs.columns])


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_kept, gone) for every row of docs: its lines, those that stay, and the numbers of those that go."""
    gone, table = removed_lines(docs, id_col, text_col)
    d = table.where("lids is not null").select("id", "th", F.size("lids").cast("long").alias("n"))
    both = sized_join(d.alias("d"), durable(gone).alias("g"), F.col("d.id").eqNullSafe(F.col("g.id")) & (F.col("d.th") == F.col("g.th")), "left")
    lost = F.coalesce("gone", F.array().cast("array<int>"))
    return both.select("d.id", F.col("n").alias("n_lines"), (F.col("n") - F.size(lost)).alias("n_kept"), lost.alias("gone"))
