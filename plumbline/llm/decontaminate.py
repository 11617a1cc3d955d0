"""Benchmark decontamination: windows of test words looked up in every window of the training words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.frames import durable, sized_join

from .text import document_key, lower_ascii, pieces

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 10
#: Distinct test windows up to which their hash set is broadcast; more are joined with a shuffle.
BROADCAST_WINDOWS = 500_000


def words_of(text: Column) -> Column:
    return pieces(lower_ascii(text), SEPARATORS)


def window_hash(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *[F.get(words, at + k) for k in range(length)])


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(len, win, items): every distinct window of the items' words with the ids (as strings) of the items that hold it.

    An item of fewer words than ``width``, but not none, is one window of its length.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("len", F.least(F.size("w"), F.lit(width)))
    wins = items.select("item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("at"))
    wins = wins.select("item", "len", F.slice("w", F.col("at"), F.col("len")).alias("win"))
    return wins.groupBy("len", "win").agg(F.sort_array(F.collect_set("item")).alias("items"))


def hits(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, at, len, items): every occurrence of a test window, ``at`` its first word's position from 0.

    ``windows`` is read twice: pass a checkpoint. Each position's window is hashed inside the scan's stage and
    looked up in the broadcast hash set; what matches is verified word by word. Above BROADCAST_WINDOWS the
    windows' hashes are shuffled instead, with the window's words and not the document.
    """
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())  # at most WIDTH values
    if not lengths:
        return docs.select(*document_key(id_col, text_col), F.lit(0).alias("at"), F.lit(0).alias("len"), F.array().cast("array<string>").alias("items")).where(F.lit(False))
    small = windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    by_length = F.lit(None).cast("long")
    for n in lengths:
        by_length = F.when(F.col("len") == n, window_hash(F.col("win"), F.lit(0), n)).otherwise(by_length)
    hashed = windows.select("len", "win", "items", by_length.alias("h"))
    rows = docs.select(*document_key(id_col, text_col), words_of(F.col(text_col)).alias("w")).where(F.size("w") >= lengths[0])
    rows = rows.select("id", "th", "w", F.posexplode("w").alias("at", "first")).where(F.col("at") <= F.size("w") - lengths[0])
    if len(lengths) == 1:
        rows = rows.select("id", "th", "at", "w", F.lit(lengths[0]).alias("n"), window_hash(F.col("w"), F.col("at"), lengths[0]).alias("h"))
    else:  # a row for each length, from one scan and one split
        every = F.array(*[F.when(F.col("at") <= F.size("w") - n, F.struct(F.lit(n).alias("n"), window_hash(F.col("w"), F.col("at"), n).alias("h"))) for n in lengths])
        rows = rows.select("id", "th", "at", "w", F.explode(every).alias("x")).where("x is not null").select("id", "th", "at", "w", "x.n", "x.h")
    got = F.slice("w", F.col("at") + 1, F.col("n"))
    if not small:
        rows = rows.select("id", "th", "at", got.alias("w"), "n", "h")
        got = F.col("w")
    found = rows.join(F.broadcast(hashed) if small else hashed, "h")
    return found.where((F.col("n") == F.col("len")) & (got == F.col("win"))).select("id", "th", "at", "len", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, th, spots, items): one row for each contaminated (id, text), with the hit word positions and the items.

    Null texts have no words and are never contaminated; null item ids are left out of ``items``. Equal rows share
    one result. Hits are gathered by document, so no group is larger than one document's words.
    """
    windows = durable(benchmark_windows(benchmark, width, item_col, text_col))
    found = hits(docs, windows, id_col, text_col)
    by = found.groupBy("id", "th").agg(F.collect_set(F.struct("at", "len")).alias("at"), F.collect_set("items").alias("items"))
    spots = F.sort_array(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["at"], x["at"] + x["len"] - 1)))))
    return by.select("id", "th", spots.alias("spots"), F.sort_array(F.array_distinct(F.flatten("items"))).alias("items"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, n_words, n_hit, n_items, items, contaminated) for every row of docs; other columns are ignored.

    A document word is hit if it lies in any occurrence of a test window. An empty benchmark hits nothing; an empty
    docs table gives an empty result.
    """
    found = durable(contamination(docs, benchmark, width, id_col, text_col, item_col))
    rows = docs.select(*document_key(id_col, text_col), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    both = sized_join(rows.alias("d"), found.alias("f"), F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.th") == F.col("f.th")), "left", max_rows=100_000)
    n_hit = F.coalesce(F.size("spots"), F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return both.select("d.id", "n_words", F.greatest(n_hit, F.lit(0)).alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), F.col("f.th").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """docs without the contaminated documents, all columns kept; texts move only if the hit documents are too many to broadcast."""
    found = durable(contamination(docs, benchmark, width, id_col, text_col, item_col).select("id", "th"))
    return sized_join(docs.alias("d"), found.alias("f"), F.col(f"d.{id_col}").eqNullSafe(F.col("f.id")) & (F.xxhash64(F.col(f"d.{text_col}")) == F.col("f.th")), "left_anti")


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """docs with the hit words, and what separates each from the next word, cut out of the text; all columns kept.

    Documents without hits keep their text as it is, null included.
    """
    found = durable(contamination(docs, benchmark, width, id_col, text_col, item_col).select("id", "th", "spots"))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *document_key(id_col, text_col))
    both = sized_join(d.alias("d"), found.alias("f"), F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.th") == F.col("f.th")), "left", max_rows=100_000)
    text = F.col(f"doc.`{text_col}`")
    between = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    lead = F.regexp_extract(text, f"^{between}*+", 0)
    tokens = F.regexp_extract_all(text, F.lit(f"[^{between[1:-1]}]++{between}*+"), F.lit(0))
    kept = F.filter(tokens, lambda x, i: ~F.array_contains(F.col("spots"), i))
    cut = F.when(F.col("spots").isNull(), text).otherwise(F.concat(lead, F.array_join(kept, "")))
    return both.withColumn("_cut", cut).select(*[F.col("_cut").alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
