"""Mixing sources to target weights by repeating documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.frames import durable, sized_join

WEIGHTS = (3.0, 1.0, 2.0)
#: What all targets share, as a part of all sizes, and the most of its size that a source or document is taken.
SHARE, MOST = 1.5, 2.0


def n_words(text: str | Column) -> Column:
    """Number of runs of characters other than ASCII white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, source_size, target): one row for each source.

    Sources ordered by code point, null last, take the weights in turn. Each gets its weight's part of
    ``share`` times all sizes; no target passes ``most`` times its source's size, and what is cut off goes to the
    others by weight until none is above. That end state is one level l with target = min(cap, l * weight); it is
    read off running sums over the sources in order of cap / weight. The sizes are summed before the shuffle; the
    two windows see one row for each source, which one task must hold: a million sources take some 100 MB.
    """
    if share > most:
        raise ValueError("the share can't be met within the caps")
    by = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(n_words(text_col)).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ws = F.array(*[F.lit(float(w)) for w in weights])
    by = by.withColumn("w", F.get(ws, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    by = by.withColumn("cap", most * F.col("source_size"))
    rising = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    so_far, everything = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.select(
        "*",
        F.sum(F.col("source_size")).over(everything).alias("total"),
        F.coalesce(F.sum("cap").over(so_far), F.lit(0.0)).alias("capped"),
        F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing)).alias("open_w"),
    )
    by = by.withColumn("level", (share * F.col("total") - F.col("capped")) / F.col("open_w"))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))
    by = by.withColumn("l", F.first(fits, ignorenulls=True).over(everything))
    return by.select("source", "source_size", F.when(F.col("l").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("l") * F.col("w"))).alias("target"))


def uniform(id_col: str, text_col: str, seed: int) -> Column:
    """A number in [0, 1) that only the document's id (its text, if it has none) and the seed decide."""
    key = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(seed), F.col(text_col))).otherwise(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")))
    return F.shiftrightunsigned(key, 11) / F.lit(float(1 << 53))


def mixing_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The input's columns packed in ``doc``, with size, source_size, target and copies of each document.

    A document is taken floor(rate) times and once more with probability rate - floor(rate), where rate is its
    source's target / size. The draw hashes the document's id with the seed, so reruns and lost executors give the
    same mix. Null text has size 0; null sources are one source; sources without words have target 0 and rate 0;
    an empty table gives an empty result. Repeated rows draw alike. Packing keeps columns of any name apart.
    """
    targets = durable(source_targets(docs, weights, share, most, source_col, text_col))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), uniform(id_col, text_col, seed).alias("draw"))
    joined = sized_join(packed.alias("d"), targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")), "inner", max_rows=100_000)
    return joined.select("doc", "size", "source_size", "target", (F.floor(rate) + F.when(F.col("draw") < rate - F.floor(rate), 1).otherwise(0)).cast("int").alias("copies"))


def mix(docs: DataFrame, copy_col: str = "copy_no", **plan) -> DataFrame:
    """The mixed corpus: each document as often as mixing_plan takes it, numbered from 1 in ``copy_col``."""
    out = mixing_plan(docs, **plan)
    out = out.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
    return out.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns], F.col("copy_no").alias(copy_col))
