"""Saved readings (A4) as typed tables: one JSON document a sheet, kept as VARIANT and opened where a field is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
#: The lists of a reading's findings, and the kind that a row of each has.
FINDINGS = {"pedestals": "pedestal", "curb_walls": "curb_wall", "sumps": "sump", "levels": "level", "insert_plates": "insert_plate", "epoxy": "epoxy", "rebar": "rebar", "thicknesses": "thickness"}
#: The lists and maps of a reading; each may be missing but must be what it is called.
LISTS = ("pedestals", "grade_slabs", "responses", "confidence_notes", "transcribed_lines", "transcript_blocks")
MAPS = ("title_block", "findings", "position_marks", "discovery")


def field(v: str | Column, path: str, kind: str) -> Column:
    """A field of a reading, null where it is missing or can't be read as that type."""
    return F.try_variant_get(c(v) if isinstance(v, str) else v, path, kind)


def text_of(v: str | Column, path: str) -> Column:
    return F.coalesce(field(v, path, "string"), F.lit(""))


def typed(v: str | Column, path: str, fields: str) -> Column:
    """A list as an array of structs, opened in one pass; a member that is no object is null, as a field that it lacks or that can't be read."""
    return field(v, path, f"array<struct<{fields}>>")


def looked_into(v: Column) -> Column:
    """What fault() asks of a document, in one pass for each: its fields with those that are lists or maps as something, its pedestals and its marks."""
    # a variant or a list of variants is a copy of all that it holds, so what a field is is asked by types that copy next to nothing
    return F.struct(
        field(v, "$", "map<string,array<array<boolean>>>").alias("lists"), field(v, "$", "map<string,struct<_:boolean>>").alias("maps"),
        typed(v, "$.pedestals", "tag:variant,length_mm:double,width_mm:double,quantity:double").alias("pedestals"), field(v, "$.position_marks", "map<string,double>").alias("marks"),
    )


def fault(v: Column, seen: Column) -> Column:
    """Why a document is no reading, or null: no JSON, no object, a list or map of another type, a pedestal without its tag, sizes or whole number. seen: see looked_into()."""
    other = lambda fields, name: F.map_contains_key(fields, F.lit(name)) & F.try_element_at(fields, F.lit(name)).isNull()
    out = F.when(v.isNull(), "not JSON").when(seen["lists"].isNull(), "not an object")
    for name in LISTS:
        out = out.when(other(seen["lists"], name), f"{name} is no list")
    for name in MAPS:
        out = out.when(other(seen["maps"], name), f"{name} is no object")
    whole = lambda x: F.coalesce(x == F.floor(x), F.lit(False))
    broken = lambda p: (F.coalesce(F.schema_of_variant(p["tag"]), F.lit("")) != "STRING") | p["length_mm"].isNull() | p["width_mm"].isNull() | ~whole(p["quantity"])
    out = out.when(F.coalesce(F.exists(seen["pedestals"], broken), F.lit(False)), "a pedestal lacks its tag, sizes or quantity")
    return out.when(F.coalesce(F.exists(F.map_values(seen["marks"]), lambda m: ~whole(m)), F.lit(False)), "a position mark has no whole number")


def parse_readings(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A4: (drawing_id, v) of the readings among files (drawing_id, value: JSON text), and (drawing_id, reason) of the others.

    No file is ever fatal: what isn't a reading goes to the second table with what is wrong with it.
    """
    # A generator holds the optimizer off putting the parser into each of the many places that ask for the document.
    opened = files.select("drawing_id", F.explode(F.array(F.try_parse_json("value"))).alias("v"))
    seen = opened.select("drawing_id", "v", F.explode(F.array(looked_into(c("v")))).alias("seen"))
    parsed = seen.select("drawing_id", "v", F.explode(F.array(fault(c("v"), c("seen")))).alias("reason"))
    return parsed.where("reason is null").drop("reason"), parsed.where("reason is not null").select("drawing_id", "reason")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """A4: (drawing_id, value) of every *_extraction.json below a folder, the file's path as its id. Spark's readers pass over files of no length."""
    files = spark.read.option("pathGlobFilter", "*_extraction.json").option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(c("_metadata.file_path").alias("drawing_id"), "value")


def titles(readings: DataFrame) -> DataFrame:
    """One row a reading: its title block, its file and how it was read. The number falls back to the stem of the file read, then of the reading's own."""
    stem = lambda path: F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(.)\.[^.]*$", "$1")
    pdf = text_of("v", "$.source_pdf")
    no = F.coalesce(F.nullif(text_of("v", "$.title_block.drawing_no"), F.lit("")), F.nullif(stem(pdf), F.lit("")), stem(c("drawing_id")))
    return readings.select("drawing_id", pdf.alias("source_pdf"), no.alias("drawing_no"), *[text_of("v", f"$.title_block.{x}").alias(x) for x in ("revision", "project_name", "date", "prepared_by")], F.coalesce(field("v", "$.used_text_layer", "boolean"), F.lit(False)).alias("used_text_layer"))


def rows_of(readings: DataFrame, path: str, fields: str) -> DataFrame:
    """(drawing_id, seq, x): the members of a list as structs (see typed()), numbered from 0."""
    return readings.select("drawing_id", F.posexplode(typed("v", path, fields)).alias("seq", "x"))


def said(name: str) -> Column:
    """A text of a member, empty where it has none."""
    return F.coalesce(c(f"x.{name}"), F.lit(""))


def pedestals(readings: DataFrame) -> DataFrame:
    """The pedestals of readings, as merge_into_project and plan_warnings take them; a height of 0 is none."""
    rows = rows_of(readings, "$.pedestals", "tag:string,length_mm:double,width_mm:double,quantity:int,height_mm:double,raw_text:string,grid_ref:string,confidence:string,regex_validated:boolean,seen_in_regions:array<array<boolean>>")
    return rows.select(
        "drawing_id", "seq", said("tag").alias("tag"), "x.length_mm", "x.width_mm", "x.quantity", F.nullif("x.height_mm", F.lit(0.0)).alias("height_mm"), *[said(n).alias(n) for n in ("raw_text", "grid_ref")],
        F.coalesce(c("x.confidence"), F.lit("low")).alias("confidence"), F.coalesce(c("x.regex_validated"), F.lit(False)).alias("validated"), F.size(F.coalesce(c("x.seen_in_regions"), F.array().cast("array<array<boolean>>"))).alias("n_sightings"),
    )


def slabs(readings: DataFrame) -> DataFrame:
    """The grade slabs of readings, in mm; one without a tag is GS-01."""
    sizes = ("length_mm", "width_mm", "thickness_mm")
    usable = F.lit(True)
    for n in sizes:
        usable = usable & (F.coalesce(c(n), F.lit(0.0)) != 0)
    rows = rows_of(readings, "$.grade_slabs", "tag:string,length_mm:double,width_mm:double,thickness_mm:double,toc_level:string,raw_text:string,confidence:string")
    out = rows.select("drawing_id", "seq", F.coalesce(c("x.tag"), F.lit("GS-01")).alias("tag"), *[f"x.{n}" for n in sizes], *[said(n).alias(n) for n in ("toc_level", "raw_text")], F.coalesce(c("x.confidence"), F.lit("low")).alias("confidence"))
    return out.withColumn("usable", usable)


def findings(readings: DataFrame, lists: tuple[str, ...] = tuple(FINDINGS)) -> DataFrame:
    """The eight lists of findings, or those named, in one table: kind, place in its list, its measures (null where a kind has none), text and place on the sheet."""
    sizes = ("length_mm", "width_mm", "height_mm", "thickness_mm", "level_m", "diameter_mm", "spacing_mm")
    fields = ",".join([f"{n}:double" for n in (*sizes, "count", "quantity")] + [f"{n}:string" for n in ("kind", "tag", "type", "raw_text", "grid_ref")])
    per_list = F.array(*[F.struct(F.lit(FINDINGS[name]).alias("kind"), typed("v", f"$.findings.{name}", fields).alias("xs")) for name in lists])
    rows = readings.select("drawing_id", F.explode(per_list).alias("l")).select("drawing_id", c("l.kind").alias("kind"), F.posexplode("l.xs").alias("seq", "x"))
    kind = F.when((c("kind") == "thickness") & (said("kind") == "blinding"), "blinding").otherwise(c("kind"))
    number = F.coalesce(c("x.count"), c("x.quantity")).alias("number")
    name = F.coalesce(c("x.tag"), c("x.type"), F.when(c("kind") == "level", said("kind"))).alias("name")
    return rows.select("drawing_id", kind.alias("kind"), "seq", name, number, *[f"x.{n}" for n in sizes], said("raw_text").alias("raw_text"), said("grid_ref").alias("grid_ref"))


def items(readings: DataFrame) -> DataFrame:
    """The discovered items of readings, as the set views and gaps take them; ``spec`` is a map of its sizes."""
    texts = ("kind", "description", "uom", "basis", "source", "grid_ref")
    rows = rows_of(readings, "$.discovery.items", ",".join([f"{n}:string" for n in texts] + ["qty:double", "occurrences:int", "spec:map<string,double>"]))
    spec = F.coalesce(c("x.spec"), F.create_map().cast("map<string,double>"))
    out = rows.select("drawing_id", "seq", *[said(n).alias(n) for n in texts], "x.qty", F.coalesce(c("x.occurrences"), F.lit(1)).alias("occurrences"), spec.alias("spec"))
    two = F.array_sort(F.array(c("spec")["length_mm"], c("spec")["width_mm"]))
    return out.withColumns({"dim_a": two[0], "dim_b": two[1]})


def marks(readings: DataFrame) -> DataFrame:
    """(drawing_id, mark, n): the position marks of readings."""
    return readings.select("drawing_id", F.explode(F.coalesce(field("v", "$.position_marks", "map<string,int>"), F.create_map().cast("map<string,int>"))).alias("mark", "n"))


def counts(readings: DataFrame) -> DataFrame:
    """(drawing_id, n_marks, n_items): how many position marks and discovered items the readings of a drawing have."""
    size = lambda path, kind: F.greatest(F.coalesce(F.size(field("v", path, kind)), F.lit(0)), F.lit(0))
    return readings.groupBy("drawing_id").agg(F.sum(size("$.position_marks", "map<string,int>")).alias("n_marks"), F.sum(size("$.discovery.items", "array<array<boolean>>")).alias("n_items"))
