"""Gaps and readiness (J): what a drawing did not say, and what was used instead."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbers import rounded

c = F.col
SEVERITIES = ("blocking", "assumed", "confirm", "note")
LABELS = ("Not priced", "Assumed — check before pricing", "Needs one figure from you", "For information")
PLACEHOLDER_M = 0.8
#: Kinds that a bill can't do without, and those it is expected to have.
CRITICAL, EXPECTED = (2, 3, 0, 1), (9, 10, 11, 8, 5)


def gap(df: DataFrame, severity: str, subject: Column, missing: Column, assumed: Column | None = None, affects: Column | str = "", fix: str = "", source: Column | str = "") -> DataFrame:
    """The common shape of a gap: what it is about, what isn't stated, what was used instead, what moves if that is wrong, where to mend it, and the sheet's own words."""
    text = lambda x: F.coalesce(F.lit(x) if isinstance(x, str) else x, F.lit(""))
    return df.select("drawing_id", F.lit(severity).alias("severity"), subject.alias("subject"), missing.alias("missing"), text("" if assumed is None else assumed).alias("assumed"), text(affects).alias("affects"), F.lit(fix).alias("fix"), text(source).alias("source"))


def gap_placeholder_height(pedestals: DataFrame) -> DataFrame:
    """Pedestals whose height is the placeholder."""
    held = pedestals.where(F.abs(c("height_m") - PLACEHOLDER_M) < 1e-9)
    return gap(held, "assumed", F.concat(F.lit("Pedestal "), "tag"), F.lit("height — the callout gives a footprint only"), F.lit("0.8 m placeholder"), "concrete volume, formwork area, rebar weight", "the Pedestals grid on this page, or the Pedestals sheet")


def gap_nothing_priced(drawings: DataFrame, concrete: DataFrame, items: DataFrame) -> DataFrame:
    """Drawings without a pedestal or slab, with read items or without."""
    bare = drawings.select("drawing_id").join(concrete.select("drawing_id").distinct(), "drawing_id", "left_anti")
    bare = bare.join(items.groupBy("drawing_id").agg(F.count("*").alias("n")), "drawing_id", "left")
    some, none = bare.where("n > 0"), bare.where("n is null")
    read = gap(some, "blocking", F.lit("This sheet"), F.lit("no pedestal or slab the bill can price"), F.concat(c("n").cast("string"), F.lit(" item(s) read from the drawing's own wording")), "the priced sheets are empty; the Drawing_Items sheet is not", "enter the element on the Input page if it belongs to this sheet")
    return read.unionByName(gap(none, "blocking", F.lit("This sheet"), F.lit("no quantities of any kind"), None, "nothing is priced from this drawing", "check the extraction, or re-run with profile='sweep'"))


def gap_text_sheet_no_slab(routes: DataFrame, slabs: DataFrame) -> DataFrame:
    """Sheets read as text that have no slab. routes: (drawing_id, is_text)."""
    bare = routes.where("is_text").select("drawing_id").distinct().join(slabs.select("drawing_id").distinct(), "drawing_id", "left_anti")
    return gap(bare, "blocking", F.lit("Grade slab"), F.lit("overall plan extent — a dimension string without the plan around it says nothing"), None, "excavation, blinding, liner, coating and joints, all of which follow from slab geometry", "measure it off the sheet and add it on the Input page")


def gap_derived(derived: DataFrame) -> DataFrame:
    """Every derived element, with the sum it comes from."""
    kinds = F.concat("kind", F.lit("s"))
    return gap(derived, "assumed", c("tag"), F.concat(kinds, F.lit(" is not printed on the drawing")), c("explanation") if "explanation" in derived.columns else None, kinds, "the derivation rules above, or the Derivation sheet")


def gap_unmeasured(items: DataFrame) -> DataFrame:
    """Items without a quantity."""
    words = c("source") if "source" in items.columns else ""
    return gap(items.where("qty is null"), "confirm", c("description"), F.coalesce("basis", F.lit("extent not stated")), None, F.concat(F.lit("its own line, in "), F.coalesce("uom", F.lit(""))), "the Drawing_Items sheet — type the figure and it prices itself", words)


def gap_marks(marks: DataFrame) -> DataFrame:
    """One row for each drawing with marks, listing them in order."""
    listed = marks.groupBy("drawing_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("mark", F.lit("x"), c("n").cast("string")))), ", ").alias("shown"))
    return gap(listed, "confirm", F.lit("Element marks"), F.lit("how many of each element there actually are"), F.concat(F.lit("labels counted on the sheet: "), c("shown")), "nothing yet — these are not priced", "count them against the plan; an element drawn in both plan and section is labelled twice")


def gap_provenance(drawings: DataFrame) -> DataFrame:
    """How each sheet was read, and sheets without a number. drawings: (drawing_id, drawing_no, is_text, n_passes)."""
    text = gap(drawings.where("is_text"), "note", F.lit("This sheet"), F.lit(""), F.lit("read from the drawing's own text layer, so the characters are exact and no model was involved"))
    passes = F.concat(F.lit("read by the vision model in "), c("n_passes").cast("string"), F.lit(" pass(es) — every value is an OCR reading"))
    seen = gap(drawings.where("not is_text and n_passes > 0"), "note", F.lit("This sheet"), F.lit(""), passes, "", "mark up the Verification sheet against the check print")
    bare = gap(drawings.where("coalesce(drawing_no, '') = ''"), "assumed", F.lit("Drawing number"), F.lit("not read from the title block"), F.lit("the filename"), "which sheet every quantity is attributed to", "the Project details box on this page")
    return text.unionByName(seen).unionByName(bare)


def gap_report(*gaps: DataFrame) -> DataFrame:
    """All gaps with the rank and the label of their severity; sort by (drawing_id, severity_rank, subject)."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), c("severity")).cast("int") - 1
    out = reduce(DataFrame.unionByName, gaps).withColumn("severity_rank", rank)
    return out.withColumn("label", F.get(F.array(*[F.lit(x) for x in LABELS]), c("severity_rank")))


def gap_headline(report: DataFrame) -> DataFrame:
    """Counts by severity, how many gaps need attention, and one sentence that says so, for each drawing."""
    n = [F.count_if(c("severity") == s).alias(f"n_{s}") for s in SEVERITIES]
    out = report.groupBy("drawing_id").agg(*n).withColumn("needs_attention", c("n_blocking") + c("n_assumed") + c("n_confirm"))
    told = lambda n, words: F.when(c(n) > 0, F.concat(c(n).cast("string"), F.lit(words)))
    parts = F.concat_ws("; ", told("n_assumed", " quantity(ies) rest on an assumption"), told("n_confirm", " item(s) need one figure from you"), told("n_blocking", " could not be priced at all"))
    text = F.concat(F.lit("This bill is usable and incomplete: "), parts, F.lit(". Each one is listed below with what to do about it."))
    return out.withColumn("headline", F.when(c("needs_attention") == 0, "Every quantity in this workbook was read from the drawing. Check it anyway before pricing.").otherwise(text))


def readiness(drawings: DataFrame, elements: DataFrame) -> DataFrame:
    """(drawing_id, n_elements, n_placeholders, score, blockers): three quarters for the critical kinds, one for the expected ones."""
    has = lambda kinds: sum((F.when(F.count_if(c("kind_no") == k) > 0, 1).otherwise(0) for k in kinds), F.lit(0))
    by = elements.groupBy("drawing_id").agg(F.count("*").alias("n_elements"), F.count_if((c("kind_no") == 2) & (F.abs(c("height_m") - PLACEHOLDER_M) < 1e-9)).alias("n_placeholders"), has(CRITICAL).alias("crit"), has(EXPECTED).alias("exp"))
    out = drawings.select("drawing_id", "drawing_no").join(by, "drawing_id", "left").na.fill(0, ["n_elements", "n_placeholders", "crit", "exp"])
    score = rounded(100 * (0.75 * c("crit") / len(CRITICAL) + 0.25 * c("exp") / len(EXPECTED)), 0).cast("int")
    blockers = F.concat_ws("; ", F.when(F.coalesce("drawing_no", F.lit("")) == "", "no drawing number"), F.when(c("n_placeholders") > 0, F.concat(c("n_placeholders").cast("string"), F.lit(" placeholder height(s)"))))
    return out.select("drawing_id", "n_elements", "n_placeholders", score.alias("score"), blockers.alias("blockers"))
