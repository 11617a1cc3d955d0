"""Replies, voting and merging (D): from what a model wrote about crops to elements of a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numbers import g_format, rounded

from .grammar import clean_drawing_no, clean_project_name, clean_revision, normalise_date, parse_pedestal, parse_thickness, parse_toc, validate_grade_slab, validate_pedestal

c = F.col
PLACEHOLDER_M = 0.8
# Fixed value: what the workbook says is never read.
NEVER_READ = "Tier 3 items (rebar bar-by-bar, joints, sumps, embedments, excavation extents, concrete grades) are NOT extracted — enter them by hand under BOQ → Project estimate."


def parse_transcripts(replies: DataFrame) -> DataFrame:
    """(drawing_id, montage, at, crop_id, lines) of replies that are {"crops": [{id, lines}]} or a bare list of lines; blank lines go, an id that is no integer is null, anything else gives no row."""
    shaped = F.from_json("reply", "struct<crops:array<struct<id:string,lines:array<string>>>>")["crops"]
    bare = F.from_json("reply", "array<string>")
    crops = F.when(F.ltrim("reply").startswith("["), F.array(F.struct(F.lit(None).cast("string").alias("id"), bare.alias("lines")))).otherwise(shaped)
    rows = replies.select("drawing_id", "montage", F.posexplode(crops).alias("at", "crop"))
    clean = F.filter(F.transform("crop.lines", lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("drawing_id", "montage", "at", c("crop.id").try_cast("int").alias("crop_id"), F.coalesce(clean, F.array().cast("array<string>")).alias("lines"))


def place_crops(crops: DataFrame, slots: DataFrame) -> DataFrame:
    """Crops with the slot they belong to: the printed id if it exists, else their position if no id was printed and all came back; else none."""
    n = slots.groupBy("drawing_id", "montage").agg(F.count("*").alias("n_slots"))
    w = Window.partitionBy("drawing_id", "montage")
    out = crops.join(n, ["drawing_id", "montage"], "left").withColumn("printed", F.count("crop_id").over(w)).withColumn("came", F.count("*").over(w))
    by_id = c("crop_id").between(1, c("n_slots"))
    return out.withColumn("slot", F.when(by_id, c("crop_id")).when((c("printed") == 0) & (c("came") == c("n_slots")), c("at") + 1)).drop("printed", "came", "n_slots")


def truncated_replies(crops: DataFrame, slots: DataFrame) -> DataFrame:
    """D3: montages of which some crops came back and some did not, with how many."""
    sent = slots.groupBy("drawing_id", "montage").agg(F.count("*").alias("sent"))
    back = crops.groupBy("drawing_id", "montage").agg(F.count("*").alias("returned"))
    return sent.join(back, ["drawing_id", "montage"]).where("returned > 0 and returned < sent").withColumn("missing", c("sent") - c("returned"))


def title_blocks(replies: DataFrame) -> DataFrame:
    """Cleaned title fields (drawing_no, revision, date, project) and a confidence by how many are filled."""
    date = normalise_date(c("date"))["date"]
    out = replies.select("drawing_id", clean_drawing_no(c("drawing_no")).alias("drawing_no"), clean_revision(c("revision")).alias("revision"), date.alias("date"), clean_project_name(c("project_name")).alias("project_name"))
    filled = sum((F.when(c(x) != "", 1).otherwise(0) for x in ("drawing_no", "revision", "date", "project_name")), F.lit(0))
    return out.withColumn("confidence", F.when(filled >= 3, "high").when(filled == 2, "medium").otherwise("low"))


def pedestals_from_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted pedestals and rejects with a reason. The grammar's reading of raw_text beats the reply's own fields; a difference is marked."""
    own = parse_pedestal(c("raw_text"))
    num = lambda x, kind: c(x).try_cast(kind)
    r = replies.withColumn("own", own)
    r = r.select("drawing_id", "seq", "region", "grid_ref", "raw_text", F.coalesce("own.tag", F.upper(F.replace(F.coalesce("tag", F.lit("")), F.lit(" "), F.lit("")))).alias("tag"), F.coalesce("own.length_mm", num("length_mm", "double")).alias("length_mm"), F.coalesce("own.width_mm", num("width_mm", "double")).alias("width_mm"), c("own.height_mm").alias("height_mm"), F.coalesce("own.quantity", num("quantity", "int")).alias("quantity"), c("own").isNotNull().alias("validated"), F.coalesce((c("own.length_mm") != num("length_mm", "double")) | (c("own.width_mm") != num("width_mm", "double")) | (c("own.quantity") != num("quantity", "int")), F.lit(False)).alias("disagrees"))
    r = r.withColumn("check", validate_pedestal(c("tag"), c("length_mm"), c("width_mm"), c("quantity")))
    return r.where("check.ok").drop("check"), r.where("not check.ok").select("drawing_id", "seq", "tag", c("check.reason").alias("reason"))


def grade_slabs_from_replies(replies: DataFrame) -> DataFrame:
    """Slabs, always GS-01 (a sheet has one; the reply's own tag isn't trusted), thickness and level from raw_text where the reply leaves them out; unusable ones are marked with their reason."""
    num = lambda x: c(x).try_cast("double")
    t = F.coalesce(num("thickness_mm"), parse_thickness(c("raw_text")))
    out = replies.select("drawing_id", F.lit("GS-01").alias("tag"), num("length_mm").alias("length_mm"), num("width_mm").alias("width_mm"), t.alias("thickness_mm"), F.coalesce(F.nullif("toc_level", F.lit("")), parse_toc(c("raw_text"))).alias("toc_level"), F.when(F.coalesce("raw_text", F.lit("")) != "", "medium").otherwise("low").alias("confidence"))
    ok = validate_grade_slab(c("length_mm"), c("width_mm"), c("thickness_mm"))
    return out.withColumn("usable", ok["ok"]).withColumn("reason", ok["reason"])


def tag_number(tag: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(tag, r"(\d+)", 1), F.lit("")).try_cast("int"), F.lit(9999))


def reconcile(sightings: DataFrame) -> DataFrame:
    """One row for each (drawing, tag): the most frequent size and quantity, first seen winning ties, among validated sightings if there are any.

    Regions are those of all sightings. Different readings, and readings that no grammar has validated, make the
    confidence low; validated agreement of several regions makes it high. Sightings are counted by reading before the best is chosen, so a tag that is seen
    everywhere costs one partial count a task.
    """
    key = ["drawing_id", "tag"]
    by = sightings.groupBy(*key, "validated", "length_mm", "width_mm", "quantity").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.collect_set("region").alias("regions"))
    w = Window.partitionBy(*key)
    ranked = w.orderBy(F.desc("n"), "first_seq")  # one order for all windows, so that a task sorts once
    every = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("any_valid", F.max("validated").over(every)).withColumn("all_regions", F.array_sort(F.array_distinct(F.flatten(F.collect_list("regions").over(every)))))
    by = by.where(~c("any_valid") | c("validated"))
    by = by.withColumn("readings", F.count("*").over(w)).withColumn("k", F.row_number().over(ranked))
    conf = F.when(c("readings") > 1, "low").when(c("validated") & (F.size("all_regions") > 1), "high").when(c("validated"), "medium").otherwise("low")
    return by.where("k = 1").select(*key, "length_mm", "width_mm", "quantity", "validated", "first_seq", F.array_join("all_regions", ", ").alias("regions"), conf.alias("confidence"), (c("readings") > 1).alias("disagreed"), tag_number(c("tag")).alias("tag_no"))


def vote_location(sightings: DataFrame) -> DataFrame:
    """(drawing_id, tag, place, tied): the grid reference that most sightings name; none where the top is tied."""
    votes = sightings.where(F.coalesce("grid_ref", F.lit("")) != "").groupBy("drawing_id", "tag", "grid_ref").agg(F.count("*").alias("n"))
    w = Window.partitionBy("drawing_id", "tag").orderBy(F.desc("n"), "grid_ref")
    top = votes.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("n").over(w)).where("k = 1")
    tied = F.coalesce(c("n") == c("next"), F.lit(False))
    return top.select("drawing_id", "tag", F.when(tied, "").otherwise(c("grid_ref")).alias("place"), tied.alias("tied"))


def quoted(text: Column) -> Column:
    """Text in single quotes, in double ones if it holds a single one."""
    q = F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), '"').otherwise("'")
    return F.concat(q, text, q)


def plan_merge(existing: DataFrame, fields: DataFrame, found: DataFrame) -> DataFrame:
    """(drawing_id, what, target, action, detail) of every field and element read: added, skipped or rejected, and why.

    existing: (drawing_id, kind, tag); fields: (drawing_id, field, current, read); found: (drawing_id, kind, tag, length_mm,
    width_mm, height_mm, thickness_mm, quantity). Fields are added where the project has none; slabs that lack a size are
    rejected, whether their tag is there or not; then elements whose tag is there (without case) are skipped. The
    detail of what is added tells its size in m, that of what is not the reason.
    """
    f = fields.where(F.coalesce("read", F.lit("")) != "")
    keeps = F.coalesce("current", F.lit("")) != ""
    f = f.select("drawing_id", F.lit("field").alias("what"), c("field").alias("target"), F.when(keeps, "skip").otherwise("add").alias("action"), F.when(keeps, F.concat(F.lit("keeping "), quoted(c("current")), F.lit(", extraction said "), quoted(c("read")))).otherwise(c("read")).alias("detail"))
    have = existing.select("drawing_id", "kind", F.upper("tag").alias("up"), F.lit(True).alias("there")).distinct()
    e = found.withColumn("up", F.upper("tag")).join(have, ["drawing_id", "kind", "up"], "left")
    slab, m = c("kind") == "grade_slab", lambda x: F.replace(F.format_number(x / 1000, 3), F.lit(","), F.lit(""))
    lacks = F.lit(False)
    for n in ("length_mm", "width_mm", "thickness_mm"):
        lacks = lacks | (F.coalesce(c(n), F.lit(0.0)) == 0)
    no_height = F.coalesce("height_mm", F.lit(0.0)) == 0
    third = F.when(slab, c("thickness_mm")).when(no_height, F.lit(1000 * PLACEHOLDER_M)).otherwise(c("height_mm"))
    size = F.concat_ws(" x ", m(c("length_mm")), m(c("width_mm")), m(third))
    added = F.when(slab, F.concat(size, F.lit(" m"))).otherwise(F.concat(size, F.lit(" m, "), c("quantity").cast("string"), F.lit(" Nos"), F.when(no_height, f"  [height is a {PLACEHOLDER_M:.3f} m PLACEHOLDER]").otherwise("")))
    action = F.when(slab & lacks, "reject").when(c("there"), "skip").otherwise("add")
    detail = F.when(action == "reject", "incomplete dimensions").when(action == "skip", "already entered — extraction ignored").otherwise(added)
    return f.unionByName(e.select("drawing_id", c("kind").alias("what"), c("tag").alias("target"), action.alias("action"), detail.alias("detail")))


def plan_warnings(existing: DataFrame, pedestals: DataFrame, slabs: DataFrame) -> DataFrame:
    """(drawing_id, part, seq, warning) of a merge: heights set to the placeholder (part 0), slab extents read off a plan (1), readings of low confidence (2).

    existing: (drawing_id, kind, tag); pedestals: (drawing_id, seq, tag, height_mm, confidence); slabs: (drawing_id, seq, tag, length_mm, width_mm, thickness_mm).
    Elements that are there already are only told where their reading is weak; slabs that lack a size give no warning. A height of null or 0 is missing.
    """
    there = lambda kind: existing.where(c("kind") == kind).select("drawing_id", F.upper("tag").alias("up")).distinct()
    fresh = lambda df, kind: df.withColumn("up", F.upper("tag")).join(there(kind), ["drawing_id", "up"], "left_anti")

    def told(df: DataFrame, part: int, before: str, after: str) -> DataFrame:
        tags = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "tag"))), lambda x: x["tag"]), ", ")
        return df.groupBy("drawing_id").agg(tags.alias("tags")).select("drawing_id", F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("seq"), F.concat(F.lit(before), "tags", F.lit(after)).alias("warning"))

    high = f"; merged at a placeholder {PLACEHOLDER_M:.3f} m. Concrete, formwork and rebar for these pedestals are WRONG until the real heights are entered (the drawing's review grid, or BOQ → Project estimate)."
    out = told(fresh(pedestals, "pedestal").where(F.coalesce("height_mm", F.lit(0.0)) == 0), 0, "UNVERIFIED: pedestal height is not on the callouts for ", high)
    sizes = ("length_mm", "width_mm", "thickness_mm")
    usable = fresh(slabs, "grade_slab")
    for x in sizes:
        usable = usable.where(F.coalesce(x, F.lit(0.0)) != 0)
    extent = F.concat_ws(" x ", *[g_format(c(x).cast("double")) for x in sizes])
    line = F.concat(F.lit("UNVERIFIED: grade slab "), "tag", F.lit(" extent was read off the plan view, not a callout. Confirm "), extent, F.lit(" mm against the sheet."))
    out = out.unionByName(usable.select("drawing_id", F.lit(1).alias("part"), c("seq").cast("bigint").alias("seq"), line.alias("warning")))
    return out.unionByName(told(pedestals.where("confidence = 'low'"), 2, "Low-confidence pedestal reading(s): ", ". Check these against the drawing before pricing."))


def extraction_warnings(readings: DataFrame, pedestals: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """(drawing_id, section, part, seq, line): what a drawing's workbook says about where its numbers come from.

    Section 0 is the banner of a draft, 1 the warnings of the merge plan (see plan_warnings), 2 a line for every pedestal read
    and 3 what is never read. readings: (drawing_id, source_pdf, model), one a drawing; pedestals: (drawing_id, seq, tag, length_mm, width_mm,
    quantity, raw_text, confidence, n_sightings), of those drawings only. A null or empty path is "a drawing".
    """
    name = F.coalesce(F.nullif(F.element_at(F.split("source_pdf", "/"), -1), F.lit("")), F.lit("a drawing"))
    banner = F.concat(F.lit("UNVERIFIED DRAFT — quantities below were derived from "), name, F.lit(" by "), F.coalesce("model", F.lit("")), F.lit(" vision extraction and have NOT been checked by an engineer."))
    fixed = F.array(F.struct(F.lit(0).alias("section"), banner.alias("line")), F.struct(F.lit(3).alias("section"), F.lit(NEVER_READ).alias("line")))
    out = readings.select("drawing_id", F.inline(fixed)).select("drawing_id", "section", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("seq"), "line")
    size = F.concat(F.lit("Pedestal "), "tag", F.lit(": read as "), g_format(c("length_mm")), F.lit("x"), g_format(c("width_mm")), F.lit(" mm, "), c("quantity").cast("string"), F.lit(" Nos"))
    quoted = F.when(F.coalesce("raw_text", F.lit("")) != "", F.concat(F.lit('from "'), "raw_text", F.lit('"')))
    trust = F.concat(F.lit("["), "confidence", F.lit(" confidence, "), c("n_sightings").cast("string"), F.lit(" tile sighting(s)]"))
    known = readings.select("drawing_id")
    read = pedestals.join(known, "drawing_id", "left_semi").select("drawing_id", F.lit(2).alias("section"), F.lit(0).alias("part"), c("seq").cast("bigint").alias("seq"), F.concat_ws(" ", size, quoted, trust).alias("line"))
    out = out.unionByName(read)
    if plan is None:
        return out
    return out.unionByName(plan.join(known, "drawing_id", "left_semi").select("drawing_id", F.lit(1).alias("section"), "part", c("seq").cast("bigint").alias("seq"), c("warning").alias("line")))


def merge_into_project(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Existing pedestals and the new ones among found (first of a tag, without case), mm turned to m, a missing height to the placeholder. Merging twice changes nothing."""
    w = Window.partitionBy("drawing_id", F.upper("tag")).orderBy("seq")
    new = found.withColumn("k", F.row_number().over(w)).where("k = 1").withColumn("up", F.upper("tag"))
    new = new.join(existing.select("drawing_id", F.upper("tag").alias("up")).distinct(), ["drawing_id", "up"], "left_anti")
    new = new.select("drawing_id", "tag", (c("length_mm") / 1000).alias("length_m"), (c("width_mm") / 1000).alias("width_m"), F.coalesce(c("height_mm") / 1000, F.lit(PLACEHOLDER_M)).alias("height_m"), "quantity")
    return existing.select("drawing_id", "tag", "length_m", "width_m", "height_m", "quantity").unionByName(new)


def merge_fields(projects: DataFrame, titles: DataFrame) -> DataFrame:
    """Project numbers kept, else read, else the sanitised stem of the file."""
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""), r"[^A-Za-z0-9._-]+", "_")
    out = projects.join(titles.select("drawing_id", c("drawing_no").alias("read_no")), "drawing_id", "left")
    return out.withColumn("drawing_no", F.coalesce(F.nullif("drawing_no", F.lit("")), F.nullif("read_no", F.lit("")), stem)).drop("read_no")


def extraction_summary(calls: DataFrame) -> DataFrame:
    """Per drawing: calls that were made and worked, their total and slowest seconds, and how many failed or were skipped."""
    fine = ~c("skipped") & (F.coalesce("error", F.lit("")) == "")
    return calls.groupBy("drawing_id").agg(F.count_if(fine).alias("calls"), rounded(F.coalesce(F.max(F.when(fine, c("elapsed_s"))), F.lit(0.0)), 2).alias("slowest_s"), rounded(F.coalesce(F.sum(F.when(fine, c("elapsed_s"))), F.lit(0.0)), 2).alias("total_s"), F.count_if(c("skipped")).alias("skipped"), F.count_if(~c("skipped") & (F.coalesce("error", F.lit("")) != "")).alias("failed"))


def audit_log(calls: DataFrame) -> DataFrame:
    """Every call with its status: skipped, err or ok."""
    return calls.withColumn("status", F.when(c("skipped"), "skipped").when(F.coalesce("error", F.lit("")) != "", "err").otherwise("ok"))
