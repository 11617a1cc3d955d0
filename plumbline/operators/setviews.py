"""Set views (G), pricing (H) and search and selection (I) over bill lines of many drawings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.frames import durable, numbered, sized_join, written
from plumbline.functions.numbers import rounded

c = F.col
ROLLUP = "ROLLUP"
#: Activities of the detail sheet by category, and groups of read items in order.
ACTIVITIES = {"Earthwork": "Earthwork", "PCC / Blinding": "PCC", "Structural Concrete": "Concrete", "Formwork": "Formwork", "Rebar (coefficient)": "Rebar", "Rebar (manual BBS)": "Rebar", "HDPE Liner": "Liner", "Epoxy Coating": "Coating", "Joints": "Joints", "Joint accessories": "Joints", "Embedments": "Embedments", "Sump Ancillaries": "Sump"}
KIND_ORDER = ("box3", "box2", "thickness", "compaction", "rebar", "rebar_spacing", "assembly", "diameter", "set")
SITE_ORDER = ("Brown Field", "Green Field", "Repair")


def set_members(drawings: DataFrame, *parts: DataFrame) -> DataFrame:
    """G1: drawings with any bill line, mark or item."""
    keys = parts[0].select("drawing_id")
    for p in parts[1:]:
        keys = keys.union(p.select("drawing_id"))
    return drawings.join(keys.distinct(), "drawing_id", "left_semi")


def unique_codes(drawings: DataFrame) -> DataFrame:
    """(drawing_id, code): the last part of the number; where several drawings share it, the first part that tells them apart goes before it; what still collides is numbered by drawing.

    Only drawings that share a tail are compared, by counts over (tail, place), never pair by pair.
    """
    d = drawings.select("drawing_id", F.split("drawing_no", "[-_ ]").alias("parts")).withColumn("tail", F.element_at("parts", -1))
    by = Window.partitionBy("tail")
    d = d.withColumn("n", F.count("*").over(by))
    spots = d.where("n > 1").select("drawing_id", "tail", "n", F.posexplode("parts").alias("place", "part"))
    spots = spots.withColumn("same", F.count("*").over(Window.partitionBy("tail", "place", "part")))
    lead = spots.where("same < n").groupBy("drawing_id").agg(F.min_by("part", "place").alias("lead"), F.min("place").alias("place"))
    d = d.join(lead, "drawing_id", "left")
    d = d.withColumn("code", F.when((c("n") == 1) | c("lead").isNull() | (c("place") == F.size("parts") - 1), c("tail")).otherwise(F.concat_ws("-", "lead", "tail")))
    k = F.row_number().over(Window.partitionBy("code").orderBy("drawing_id"))
    return d.select("drawing_id", F.when(k == 1, c("code")).otherwise(F.concat(c("code"), F.lit("_"), k.cast("string"))).alias("code"))


def assumption_reasons(lines: DataFrame, derived: DataFrame, placeholders: DataFrame) -> DataFrame:
    """Lines with ``assumption``: derived tags as they are, placeholder tags without their case."""
    d = derived.select("drawing_id", c("tag").alias("source_tag"), F.lit("derived, not printed on the drawing").alias("why1")).distinct()
    p = placeholders.select("drawing_id", F.upper("tag").alias("up"), F.lit("placeholder height").alias("why2")).distinct()
    out = lines.join(d, ["drawing_id", "source_tag"], "left").withColumn("up", F.upper("source_tag")).join(p, ["drawing_id", "up"], "left")
    return out.withColumn("assumption", F.concat_ws("; ", "why1", "why2")).drop("why1", "why2", "up")


def set_summary(lines: DataFrame) -> DataFrame:
    """G6 in long form: (category, item, unit, drawing_id, qty), rollups left out."""
    return lines.where(c("category") != ROLLUP).groupBy("category", "item", "unit", "drawing_id").agg(rounded(F.sum("qty_gross"), 3).alias("qty"))


def wide(cells: DataFrame, rows: list[str], column: str, value: str, width: int) -> tuple[DataFrame, DataFrame]:
    """Any number of columns in blocks of ``width``: (rows..., block, c0, c1, ...) and the codes, (block, place, column).

    The values of ``column`` are numbered in order; number n stands in block n // width as c<n % width>. A row of the
    sheet has one row in each block in which it has a cell, so that the width of a row and the plan are bounded,
    however many drawings there are.
    """
    codes = numbered(cells.select(column).distinct(), [column])
    codes = codes.select(column, F.floor(c("position") / width).alias("block"), (c("position") % width).cast("int").alias("place"))
    # the cells move as they are: a group has no more than width of them, and a row of a block is mostly empty until they have met
    placed = sized_join(cells, codes, column, "inner").repartition(*rows, "block")
    by = [F.first(F.when(c("place") == k, c(value)), ignorenulls=True).alias(f"c{k}") for k in range(width)]
    return placed.groupBy(*rows, "block").agg(*by), codes


def set_pivot(lines: DataFrame, width: int = 50) -> tuple[DataFrame, DataFrame]:
    """G6 as a sheet: the summary of all drawings in blocks of columns, each row with its total over all drawings; and the columns' codes."""
    keys = ["category", "item", "unit"]
    cells = written(set_summary(lines))
    sheet, codes = wide(cells, keys, "drawing_id", "qty", width)
    totals = durable(cells.groupBy(*keys).agg(rounded(F.sum("qty"), 3).alias("total")))
    return sized_join(sheet, totals, keys, "inner"), codes


def mark_pivot(marks: DataFrame, width: int = 50) -> tuple[DataFrame, DataFrame]:
    """G10 as a sheet: marks by drawing in blocks of columns, never totalled; and the columns' codes."""
    return wide(written(mark_counts(marks)), ["mark"], "drawing_id", "n", width)


def unmatched_lines(details: DataFrame, summary: DataFrame) -> DataFrame:
    """Per drawing, how many detail descriptions the summary lacks."""
    left = details.join(summary.select("drawing_id", "item").distinct(), ["drawing_id", "item"], "left_anti")
    return left.groupBy("drawing_id").agg(F.count("*").alias("n_unmatched"))


def discovered_summary(items: DataFrame) -> DataFrame:
    """(description, uom, drawing_id, qty, bases, places): the last quantity a drawing gives; nothing is totalled."""
    return items.groupBy("description", "uom", "drawing_id").agg(F.max_by("qty", "seq").alias("qty"), F.array_join(F.array_sort(F.collect_set("basis")), "; ").alias("bases"), F.array_join(F.array_sort(F.collect_set("grid_ref")), ", ").alias("places"))


def double_count_flags(items: DataFrame, footprints: DataFrame) -> DataFrame:
    """Boxes whose rounded size in mm is that of a pedestal or slab of the same drawing."""
    key = lambda a, b: (F.least(F.round(a), F.round(b)).cast("long").alias("lo"), F.greatest(F.round(a), F.round(b)).cast("long").alias("hi"))
    boxes = items.where(c("kind").isin("box2", "box3")).select("*", *key(c("dim_a"), c("dim_b")))
    feet = footprints.select("drawing_id", *key(c("length_m") * 1000, c("width_m") * 1000)).distinct()
    return boxes.join(feet, ["drawing_id", "lo", "hi"], "left_semi")


def mark_counts(marks: DataFrame) -> DataFrame:
    """G10 in long form: labels of each mark by drawing, never totalled."""
    return marks.groupBy("mark", "drawing_id").agg(F.sum("n").alias("n"))


def drawing_index(drawings: DataFrame, lines: DataFrame, elements: DataFrame, items: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Lines, pedestals, slabs and items of every drawing; each side is counted before it is joined.

    With notes (drawing_id, seq, note), also the drawing's notes in order with " | " between; blank ones are left out.
    """
    n = lines.where(c("category") != ROLLUP).groupBy("drawing_id").agg(F.count("*").alias("n_lines"))
    e = elements.groupBy("drawing_id").agg(F.count_if(c("kind_no") == 2).alias("n_pedestals"), F.count_if(c("kind_no") == 3).alias("n_slabs"))
    i = items.groupBy("drawing_id").agg(F.count("*").alias("n_items"))
    out = drawings.select("drawing_id", "drawing_no").join(n, "drawing_id", "left").join(e, "drawing_id", "left").join(i, "drawing_id", "left")
    out = out.na.fill(0, ["n_lines", "n_pedestals", "n_slabs", "n_items"])
    if notes is None:
        return out
    said = notes.where(F.trim("note") != "").groupBy("drawing_id").agg(F.array_sort(F.collect_list(F.struct("seq", "note"))).alias("said"))
    said = said.select("drawing_id", F.array_join(F.transform("said", lambda x: x["note"]), " | ").alias("notes"))
    return out.join(said, "drawing_id", "left").na.fill("", ["notes"])


def activity(category: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in ACTIVITIES.items() for x in kv])[category]


def detail_lines(lines: DataFrame) -> DataFrame:
    """Lines with the activity of their category; rollups and unknown categories are left out."""
    return lines.withColumn("activity", activity(c("category"))).where("activity is not null")


def unit_subtotals(lines: DataFrame) -> DataFrame:
    """Gross by (drawing, activity, unit), never across units."""
    return detail_lines(lines).groupBy("drawing_id", "activity", "unit").agg(rounded(F.sum("qty_gross"), 3).alias("qty"))


def items_by_kind(items: DataFrame) -> DataFrame:
    """Items with the rank of their kind: the known ones in order, then others."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), c("kind"))
    return items.withColumn("kind_rank", F.when(rank > 0, rank).otherwise(len(KIND_ORDER) + 1).cast("int"))


def site_rank(site: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(s) for s in SITE_ORDER]), site)
    return F.when(at > 0, at).otherwise(len(SITE_ORDER) + 1).cast("int")


def location_report(lines: DataFrame, items: DataFrame, classified: DataFrame) -> DataFrame:
    """One row for each line and read item: site class, component, drawing and its own quantity; read items come last."""
    site = classified.select("drawing_id", "classification")
    a = lines.where(c("category") != ROLLUP).select("drawing_id", c("category").alias("component"), c("item").alias("description"), "unit", c("qty_gross").alias("qty"), F.lit(0).alias("is_read"))
    b = items.select("drawing_id", F.lit("Read from drawing").alias("component"), "description", c("uom").alias("unit"), "qty", F.lit(1).alias("is_read"))
    out = a.unionByName(b).join(site, "drawing_id")
    return out.withColumn("site_rank", site_rank(c("classification")))


def location_totals(report: DataFrame) -> DataFrame:
    """Totals by (class, component, unit), and by unit over the set (class and component null)."""
    cube = report.where("is_read = 0").groupingSets([["classification", "component", "unit"], ["unit"]], "classification", "component", "unit")
    return cube.agg(rounded(F.sum("qty"), 3).alias("qty"))


def set_rollup(lines: DataFrame) -> DataFrame:
    """Gross by (category, item, unit) and in how many drawings it occurs."""
    return lines.where(c("category") != ROLLUP).groupBy("category", "item", "unit").agg(rounded(F.sum("qty_gross"), 3).alias("qty"), F.countDistinct("drawing_id").alias("n_drawings"))


def per_drawing_status(drawings: DataFrame, lines: DataFrame, errors: DataFrame) -> DataFrame:
    """Ok or FAILED for every drawing, with its lines and its error."""
    n = lines.groupBy("drawing_id").agg(F.count("*").alias("n_lines"))
    out = drawings.select("drawing_id").join(n, "drawing_id", "left").join(errors, "drawing_id", "left")
    return out.select("drawing_id", F.when(c("error").isNull(), "ok").otherwise("FAILED").alias("status"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("error", F.lit("")).alias("error"))


# ---- H: pricing


def cost_lines(lines: DataFrame, rates: DataFrame) -> DataFrame:
    """H1: lines with rate and amount; a pair of category and unit without a rate costs 0. The rates are broadcast if they are few (AQE decides)."""
    out = lines.where(c("category") != ROLLUP).join(rates.select("category", "unit", "rate"), ["category", "unit"], "left")
    return out.withColumn("rate", F.coalesce("rate", F.lit(0.0))).withColumn("amount", c("qty_gross") * c("rate"))


def priced_bill(costed: DataFrame) -> DataFrame:
    """H2: amount by category, and the grand total (category null)."""
    return costed.rollup("category").agg(rounded(F.sum("amount"), 2).alias("amount"))


def price_by_unit(lines: DataFrame, rates: DataFrame) -> DataFrame:
    """H3: quantity and amount by (category, unit); the amount comes from the quantity before it is rounded."""
    sums = lines.where(c("category") != ROLLUP).groupBy("category", "unit").agg(F.sum("qty_gross").alias("q"))
    out = sums.join(rates.select("category", "unit", "rate"), ["category", "unit"], "left")
    return out.select("category", "unit", rounded("q", 3).alias("qty"), F.coalesce("rate", F.lit(0.0)).alias("rate"), rounded(c("q") * F.coalesce("rate", F.lit(0.0)), 2).alias("amount"))


def ranked_subtotals(by_unit: DataFrame) -> DataFrame:
    """H4: amount by category, largest first; a rank makes ties plain. One row for each category reaches the window."""
    sums = by_unit.groupBy("category").agg(rounded(F.sum(c("qty") * c("rate")), 2).alias("amount"))
    return sums.withColumn("rank", F.rank().over(Window.orderBy(F.desc("amount"))))


# ---- I: search and selection


def line_rows(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Bill lines and read items in one table with a stable key."""
    a = lines.select("drawing_id", F.lit("BOQ").alias("source"), "category", c("item").alias("description"), "unit", c("qty_gross").alias("qty"), F.concat_ws("|", F.lit("B"), "drawing_id", "kind_no", "pos", "sub", "item").alias("key"))
    b = items.select("drawing_id", F.lit("Read from drawing").alias("source"), c("kind").alias("category"), "description", c("uom").alias("unit"), "qty", F.concat_ws("|", F.lit("D"), "drawing_id", "seq").alias("key"))
    return a.unionByName(b)


def search_rows(rows: DataFrame, query: str) -> DataFrame:
    """Rows in whose text every word of the query occurs; a blank query keeps all."""
    hay = F.lower(F.concat_ws(" ", "drawing_id", "source", "category", "description", "unit"))
    for word in query.lower().split():
        rows = rows.where(hay.contains(word))
    return rows


def filter_lines(rows: DataFrame, drawings: list[str] | None = None, sources: list[str] | None = None) -> DataFrame:
    """Rows of the chosen drawings and sources; None doesn't restrict."""
    if drawings is not None:
        rows = rows.where(c("drawing_id").isin(drawings))
    return rows if sources is None else rows.where(c("source").isin(sources))


def default_selection(rows: DataFrame) -> DataFrame:
    """I4: keys that are chosen at first: all from the bill, none of those read."""
    return rows.where(c("source") == "BOQ").select("key")


def apply_selection(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """I4: the rows with chosen keys, and every rollup."""
    chosen = keys.distinct().withColumn("chosen", F.lit(True))
    # a rollup asks for no key, so that its rows need no second pass
    marked = rows.where("category is not null").withColumn("asked", F.when(c("category") != ROLLUP, c("key"))).join(chosen.withColumnRenamed("key", "asked"), "asked", "left")
    return marked.where((c("category") == ROLLUP) | c("chosen")).select("key", *[x for x in rows.columns if x != "key"])
