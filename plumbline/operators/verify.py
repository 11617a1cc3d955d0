"""Verification evidence (K) and the correction loop (L)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numbers import g_format, rounded

from .grammar import parse_pedestal

c = F.col
# Sections in order, and what a note says when the sheet left a figure out.
SECTIONS = ("Title block", "Pedestal", "Grade slab", "Position marks", "Curb wall", "Sump", "Level", "Insert plate", "Epoxy", "Rebar", "Thickness")
INCOMPLETE = ("not on drawing", "not stated", "not extracted", "incomplete on the drawing", "placeholder")


def check_items(titles: DataFrame, pedestals: DataFrame, slabs: DataFrame, marks: DataFrame, findings: DataFrame) -> DataFrame:
    """K1: everything a person should check, each with its section and place in it: (drawing_id, section, pos, kind, label, extracted, note, rect)."""
    at = lambda kind: F.lit(SECTIONS.index(kind))
    none = F.lit(None).cast("array<double>")
    whole = lambda x: F.round(x).cast("int").cast("string")
    shape = lambda df, section, pos, kind, label, text, note, rect: df.select("drawing_id", section.alias("section"), pos.cast("string").alias("pos"), kind.alias("kind"), label.alias("label"), text.alias("extracted"), note.alias("note"), rect.alias("rect"))
    t = shape(titles.where(F.coalesce("value", F.lit("")) != ""), at("Title block"), c("pos"), F.lit("Title block"), c("field"), c("value"), F.lit(""), none)
    p = shape(pedestals, at("Pedestal"), c("seq"), F.lit("Pedestal"), c("tag"), F.concat(whole(c("length_mm")), F.lit(" x "), whole(c("width_mm")), F.lit(" mm, "), c("quantity").cast("string"), F.lit(" Nos")), F.when(c("height_mm").isNull(), "height NOT on drawing").otherwise(""), c("rect"))
    s = shape(slabs.where("usable"), at("Grade slab"), c("seq"), F.lit("Grade slab"), c("tag"), F.concat_ws(" x ", whole(c("length_mm")), whole(c("width_mm")), whole(c("thickness_mm"))), F.lit("read off the plan view"), none)
    m = shape(marks, at("Position marks"), c("mark"), F.lit("Position marks"), c("mark"), F.concat(c("n").cast("string"), F.lit(" printed")), F.lit("labels counted, not a quantity"), none)
    rank = F.array_position(F.array(*[F.lit(x) for x in SECTIONS]), c("kind")) - 1
    f = shape(findings, rank.cast("int"), c("seq"), c("kind"), F.lit(""), c("detail"), F.lit("incomplete on the drawing"), c("rect"))
    return t.unionByName(p).unionByName(s).unionByName(m).unionByName(f)


def verification_rows(items: DataFrame) -> DataFrame:
    """K2: items numbered by drawing over all of them, with empty cells to sign."""
    w = Window.partitionBy("drawing_id").orderBy("section", F.length("pos"), "pos", "label", "extracted")
    return items.withColumn("number", F.row_number().over(w)).withColumn("corrected", F.lit("")).withColumn("verified_by", F.lit(""))


def evidence_source(note: Column, is_text: Column) -> Column:
    """K3: incomplete if the note says so, else exact on a text sheet, else model."""
    return F.when(F.rlike(F.lower(F.coalesce(note, F.lit(""))), F.lit("|".join(INCOMPLETE))), "incomplete").when(is_text, "exact").otherwise("model")


def traceable(items: DataFrame) -> DataFrame:
    """K4: items with a rectangle of four values."""
    return items.where(F.size("rect") == 4)


def ordered(items: DataFrame) -> DataFrame:
    """K4: items with a rank by drawing: those with a rectangle first, then by number."""
    w = Window.partitionBy("drawing_id").orderBy(F.when(F.size("rect") == 4, 0).otherwise(1), "number")
    return items.withColumn("rank", F.row_number().over(w))


def evidence_counts(items: DataFrame) -> DataFrame:
    """K5: items by drawing and source; what doesn't occur has no row."""
    return items.groupBy("drawing_id", "source").agg(F.count("*").alias("n"))


# ---- L: corrections


def norm_value(x: Column) -> Column:
    """L1: blank becomes empty, numbers are written with %g (600 = 600.0), other text is folded and lower-cased."""
    t = F.trim(F.coalesce(x, F.lit("")))
    n = F.when(F.rlike(t, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), t).try_cast("double")
    return F.when(t == "", "").when(n.isNotNull(), g_format(n)).otherwise(F.lower(F.regexp_replace(t, r"\s+", " ")))


def classify_rows(reviews: DataFrame) -> DataFrame:
    """L2: reviewed (corrected or signed) and changed (corrected to something else) for each row."""
    filled = lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""
    out = reviews.withColumn("reviewed", filled(c("corrected")) | filled(c("verified_by")))
    return out.withColumn("changed", (norm_value(c("corrected")) != "") & (norm_value(c("corrected")) != norm_value(c("extracted"))))


def accuracy(classified: DataFrame) -> DataFrame:
    """L3: reviewed, unchanged and per cent right by item, by drawing (its file's stem where the number is empty) and overall."""
    d = F.coalesce(F.nullif("drawing_no", F.lit("")), F.regexp_replace(F.element_at(F.split("source", "/"), -1), r"\.[^.]*$", ""))
    r = classified.where("reviewed").withColumn("drawing", d)
    g = r.groupingSets([["item"], ["drawing"], []], "item", "drawing").agg(F.count("*").alias("n_reviewed"), F.count_if(~c("changed")).alias("n_right"))
    return g.withColumn("pct", rounded(100 * c("n_right") / F.greatest(c("n_reviewed"), F.lit(1)), 1))


def is_pedestal(item: Column) -> Column:
    return F.lower(F.trim(F.coalesce(item, F.lit("")))) == "pedestal"


def unparsed_callouts(classified: DataFrame) -> DataFrame:
    """L4: corrected pedestal rows (without case) whose callout the grammar can't read."""
    return classified.where(is_pedestal(c("item")) & c("changed") & (F.trim(F.coalesce("callout", F.lit(""))) != "") & parse_pedestal(c("callout")).isNull())


def bank_examples(classified: DataFrame) -> DataFrame:
    """(source, drawing_no, n_pedestals, verified_by, pedestals) of the sheets worth keeping as examples.

    A sheet of a review with a number is kept if it has reviewed pedestals, none of them changed, and the grammar reads
    the callout of at least one. Its pedestals are those callouts as read, in order of their rows; rows that nobody
    reviewed count for nothing. ``verified_by`` is the first name among the reviewed rows, else "expert review".
    """
    p = classified.where(is_pedestal(c("item")) & c("reviewed") & (F.coalesce("drawing_no", F.lit("")) != "")).withColumn("p", parse_pedestal(c("callout")))
    shown = F.concat(c("p.tag"), F.lit(" "), g_format(c("p.length_mm")), F.lit("x"), g_format(c("p.width_mm")), F.lit(" "), c("p.quantity").cast("string"), F.lit(" Nos"))
    who = F.min_by("verified_by", F.when(F.trim(F.coalesce("verified_by", F.lit(""))) != "", c("row_no")))
    read = F.array_sort(F.collect_list(F.when(c("p").isNotNull(), F.struct("row_no", shown.alias("shown")))))
    g = p.groupBy("source", "drawing_no").agg(F.max("changed").alias("any_changed"), F.coalesce(who, F.lit("expert review")).alias("verified_by"), read.alias("read"))
    g = g.where(~c("any_changed") & (F.size("read") > 0))
    return g.select("source", "drawing_no", F.size("read").alias("n_pedestals"), "verified_by", F.array_join(F.transform("read", lambda x: x["shown"]), "; ").alias("pedestals"))


def failed_reviews(files: DataFrame, reviews: DataFrame) -> DataFrame:
    """(source, failure) of the files (source, readable) that gave nothing: they couldn't be read, or hold no verification rows."""
    none = files.join(reviews.select("source").distinct(), "source", "left_anti")
    return none.select("source", F.concat(F.element_at(F.split("source", "/"), -1), F.when(c("readable"), ": no verification rows").otherwise(": can't be read")).alias("failure"))


def ingest_reviews(reviews: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Accuracy, callouts to look at, examples to bank and failures, of one set of reviews; files as in failed_reviews, none without them."""
    rows = classify_rows(reviews)
    all_files = reviews.select("source", F.lit(True).alias("readable")).distinct() if files is None else files
    return accuracy(rows), unparsed_callouts(rows), bank_examples(rows), failed_reviews(all_files, reviews)
