"""Queries of sources, grammars, geometry, voting, verification, corrections and telemetry, with DuckDB SQL written apart from the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.frames import ensure_checkpoint_dir, written
from plumbline.functions.numbers import rounded, tolerant
from plumbline.operators import bill, derive, discovery, geometry, grammar, reconcile, telemetry, verify
from plumbline.sources import stores, versions
from plumbline.sources.synth import table, with_tables

from . import discovery_sql

c = F.col
NOW = "2026-01-01 00:00:00"


def sql(tables: str, body: str) -> str:
    names = tables.split()
    head = with_tables(*names)
    return head + tolerant(body) if body.lstrip().startswith(",") else head + " " + tolerant(body)


def callouts(s: SparkSession, d: str) -> DataFrame:
    p = grammar.parse_pedestal(grammar.normalised(c("text")))
    rows = table(s, d, "lines").select("drawing_id", "line_no", p.alias("p"), grammar.parse_thickness(c("text")).alias("thick"), grammar.parse_toc(c("text")).alias("toc"))
    ok = grammar.validate_pedestal(c("p.tag"), c("p.length_mm"), c("p.width_mm"), c("p.quantity"))
    return rows.select("drawing_id", "line_no", "p.*", "thick", "toc", ok["ok"].alias("ok"), ok["reason"].alias("reason"))


def cleaned(s, d):
    p = table(s, d, "projects")
    date = grammar.normalise_date(F.date_format("created_at", "d/M/yy"))
    return p.select("drawing_id", grammar.clean_drawing_no(F.concat(F.lit("Drawing No: "), "drawing_no", F.lit(" *"))).alias("no"), grammar.clean_revision(F.concat(F.lit("REV. "), F.lower("revision"))).alias("rev"), grammar.clean_project_name(F.concat(F.lit("  "), F.replace("project_name", F.lit(" "), F.lit(" \t ")))).alias("name"), date["date"].alias("date"), date["note"].alias("note"))


def scan(s, d):
    return grammar.scan_lines(table(s, d, "lines")).select("drawing_id", "line_no", "kind", "f1", "f2", "f3", "txt")


def provenance(s, d):
    return grammar.scan_with_provenance(table(s, d, "lines")).where("kind <> 'pedestal'").select("drawing_id", "line_no", "kind", "f1", "f2", "f3", "txt", "grid_ref")


def pedestals(s, d):
    return grammar.dedupe_pedestals(grammar.scan_with_provenance(table(s, d, "lines"))).select("drawing_id", c("txt").alias("tag"), "line_no", "grid_ref")


def visual(s, d):
    return geometry.visual_lines(table(s, d, "spans")).select("drawing_id", "page", "rotated", "text", "x0", "y0", "x1", "y1")


def drawing_nos(s, d):
    return geometry.sheet_drawing_no(table(s, d, "spans"), table(s, d, "sheets"), r"MD-\d{3}-\d{4}")


def grid_refs(s, d):
    x = table(s, d, "spans").select("span_id", (c("x0") / 1200).alias("a"), (c("y0") / 1000).alias("b"), (c("x1") / 1200).alias("e"), (c("y1") / 1000).alias("f"))
    return x.select("span_id", geometry.grid_ref(c("a"), c("b"), c("e"), c("f"), F.lit(16), F.lit(12), F.lit(True)).alias("ref"))


def tiles(s, d):
    x = table(s, d, "spans").select("span_id", (c("x0") / 1200).alias("x"), (c("y0") / 1000).alias("y"))
    return geometry.assign_to_tiles(x, 4, 3, 0.1).select("span_id", "tile")


def hashes(s, d):
    p = table(s, d, "projects")
    return p.select("drawing_id", "drawing_no", F.substring(F.md5(F.split_part("project_name", F.lit("#"), F.lit(2))), 1, 16).alias("image_hash"))


HASHES = ", h AS (SELECT drawing_id, drawing_no, substring(md5(split_part(project_name, '#', 2)), 1, 16) AS image_hash FROM projects)"


def similar(s, d):
    h = hashes(s, d)
    return geometry.find_similar(h.where("cast(drawing_id as long) % 50 = 0"), h, 3)


def hamming(s, d):
    h = hashes(s, d)
    other = h.select((c("drawing_id").cast("long") + 1).cast("string").alias("drawing_id"), c("image_hash").alias("o"))
    return h.join(other, "drawing_id").select("drawing_id", geometry.hamming(c("image_hash"), c("o")).alias("d"))


def crops(s, d):
    return reconcile.parse_transcripts(table(s, d, "replies"))


def slots(s, d):
    return table(s, d, "replies").select("drawing_id", "montage", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("slot"))


def placed(s, d):
    return reconcile.place_crops(crops(s, d), slots(s, d)).select("drawing_id", "montage", "at", "slot", F.array_join("lines", "|").alias("lines"))


def merged(s, d):
    votes = reconcile.reconcile(table(s, d, "sightings")).withColumn("seq", c("first_seq")).withColumn("height_mm", F.lit(None).cast("double"))
    have = table(s, d, "elements").where("kind_no = 2").select("drawing_id", F.lower("tag").alias("tag"), "length_m", "width_m", "height_m", "quantity")
    return reconcile.merge_into_project(have, votes).select("drawing_id", "tag", rounded("length_m", 3).alias("length_m"), rounded("width_m", 3).alias("width_m"), "height_m", "quantity")


# The spans' texts with revisions and dates among them, and file names that carry a revision on one page only; both engines run these.
MARKED = "CASE WHEN span_id % 97 = 0 THEN concat(text, ' B', lpad(CAST(span_id % 100 AS STRING), 2, '0')) WHEN span_id % 11 = 0 THEN concat(text, ' ', CAST(1 + span_id % 28 AS STRING), '/', CAST(1 + span_id % 12 AS STRING), '/2025') ELSE text END"
FILED = "CASE WHEN page = 0 THEN file_name ELSE replace(file_name, '_C01', '') END"


def revisions(s, d):
    spans = table(s, d, "spans").select("drawing_id", "page", c("span_id").alias("line_id"), F.expr(MARKED).alias("text"))
    return geometry.sheet_revision(spans, table(s, d, "sheets").select("drawing_id", "page", F.expr(FILED).alias("file_name")))


def voted(s, d):
    return reconcile.reconcile(table(s, d, "sightings")).withColumn("seq", c("first_seq")).withColumn("height_mm", F.when(c("first_seq") % 2 == 1, 900.0))


def entered(s, d):
    """The pedestals and slabs among the elements, written once: they are read for each kind, and all elements are dealt to number them."""
    return written(table(s, d, "elements").where("kind_no in (2, 3)").select("drawing_id", "kind_no", "pos", "tag", "quantity"))


def merge_warnings(s, d):
    e = entered(s, d)
    have = e.where("kind_no in (2, 3) and pos % 2 = 1").select("drawing_id", F.when(c("kind_no") == 2, "pedestal").otherwise("grade_slab").alias("kind"), "tag")
    slabs = e.where("kind_no = 3").select("drawing_id", c("pos").alias("seq"), F.lower("tag").alias("tag"), (c("quantity") * 100.5).alias("length_mm"), (c("quantity") % 3 * 1000.0).alias("width_mm"), F.lit(250.0).alias("thickness_mm"))
    return reconcile.plan_warnings(have, voted(s, d), slabs)


def provenance_lines(s, d):
    pedestals = voted(s, d).withColumn("raw_text", F.when(c("validated"), F.concat(F.lit("TYP "), "tag"))).withColumn("n_sightings", F.size(F.split("regions", ", ")))
    readings = table(s, d, "projects").select("drawing_id", F.when(c("drawing_id").cast("bigint") % 5 != 0, c("path")).alias("source_pdf"), F.lit("reader").alias("model"))
    return reconcile.extraction_warnings(readings, pedestals, merge_warnings(s, d))


def plan(s, d):
    p = table(s, d, "projects")
    fields = p.select("drawing_id", F.lit("revision").alias("field"), c("revision").alias("current"), F.lit("D01").alias("read"))
    e = table(s, d, "elements")
    have = e.where("kind_no in (2, 3) and pos % 2 = 1").select("drawing_id", F.when(c("kind_no") == 2, "pedestal").otherwise("grade_slab").alias("kind"), "tag")
    null = F.lit(None)
    peds = voted(s, d).select("drawing_id", F.lit("pedestal").alias("kind"), F.lower("tag").alias("tag"), "length_mm", "width_mm", "height_mm", null.cast("double").alias("thickness_mm"), "quantity")
    slabs = e.where("kind_no = 3").select("drawing_id", F.lit("grade_slab").alias("kind"), F.lower("tag").alias("tag"), (c("quantity") * 100.5).alias("length_mm"), (c("quantity") % 3 * 1000.0).alias("width_mm"), null.cast("double").alias("height_mm"), F.lit(250.0).alias("thickness_mm"), null.cast("int").alias("quantity"))
    return reconcile.plan_merge(have, fields, peds.unionByName(slabs))


def files_of(s, d):
    """Files in two folders, some of them twice by content, some hidden; the first folder comes first."""
    k = c("o_orderkey")
    name = F.concat(F.when(k % 13 == 0, ".").otherwise(""), F.lit("sheet_"), k.cast("string"), F.lit(".pdf"))
    return table(s, d, "orders").select(F.concat(F.when(k % 2 == 0, "b/").otherwise("a/"), name).alias("path"), name.alias("name"), (1 - k % 2).cast("int").alias("folder_no"), F.sha2(F.floor(k / 3).cast("string"), 256).alias("sha"))


def stored(s, d):
    """Three changes of a store, the second once more, compacted after the second; what it holds then."""
    ensure_checkpoint_dir(s)
    path = f"{s.sparkContext._jsc.sc().getCheckpointDir().get()}/store-{uuid.uuid4().hex}"
    rows = table(s, d, "orders").select(F.concat(F.lit("fp"), (c("o_orderkey") % 997).cast("string")).alias("fingerprint"), c("o_orderdate").cast("timestamp").alias("saved_at"), c("o_orderkey").alias("body"))
    for n, batch in ((0, 0), (1, 1), (1, 1), (2, 2)):
        versions.write_change(rows.where(F.pmod(F.floor(c("body") / 7), F.lit(3)) == n).groupBy("fingerprint", "saved_at").agg(F.max("body").alias("body")), path, batch)
        if batch == 1:
            versions.compact(s, path)
    return versions.read_store(s, path).select("fingerprint", "body")


def examples_of(s, d):
    k = c("o_orderkey")
    some = F.when(k % 3 == 0, F.create_map(F.lit("P1"), F.concat((k % 9 * 100).cast("string"), F.lit("x500")))).when(k % 3 == 1, F.create_map().cast("map<string,string>"))
    return table(s, d, "orders").select(F.concat(F.lit("MD-"), k.cast("string")).alias("drawing_no"), some.alias("verified_extraction"), F.concat(F.lit("eng"), (k % 4).cast("string")).alias("verified_by"))


def sunk(s, d):
    """A view written as files with a folder a class, and read again."""
    ensure_checkpoint_dir(s)
    path = f"{s.sparkContext._jsc.sc().getCheckpointDir().get()}/sink-{uuid.uuid4().hex}"
    stores.write_table(table(s, d, "classifications").select("file_name", "classification"), path, by="classification")
    return s.read.parquet(path).groupBy("classification").agg(F.count("*").alias("n"), F.min("file_name").alias("first"))


def glyph_blocks(s, d):
    kept = geometry.glyph_filter(table(s, d, "glyphs"))
    return geometry.text_blocks(geometry.merge_overlaps(kept), kept).select("drawing_id", "page", "x0", "y0", "x1", "y1", "n_glyphs", "height")


def failed(s, d):
    """Files of the reviews, and as many that can't be read; the rows that hold are those of even number."""
    rows = table(s, d, "reviews")
    files = rows.select("source", F.lit(True).alias("readable")).distinct()
    lost = rows.select(F.replace("source", F.lit("review"), F.lit("lost")).alias("source"), F.lit(False).alias("readable")).distinct()
    return verify.failed_reviews(files.unionByName(lost), rows.where("row_no % 2 = 0"))


def calls(s, d):
    return table(s, d, "jobs").select(c("owner").alias("drawing_id"), "job_id", (c("position") % 4 == 0).alias("skipped"), F.when(c("position") % 5 == 0, c("error")).otherwise("").alias("error"), "elapsed_s")


CALLS = ", k AS (SELECT owner AS drawing_id, job_id, position % 4 = 0 AS skipped, CASE WHEN position % 5 = 0 THEN error ELSE '' END AS error, elapsed_s FROM jobs)"


FINDING_KINDS = {"curb_wall": "Curb wall", "sump": "Sump", "level": "Level", "insert_plate": "Insert plate", "epoxy": "Epoxy", "rebar": "Rebar", "thickness": "Thickness", "blinding": "Thickness"}


def checks(s, d):
    p = table(s, d, "projects")
    titles = p.select("drawing_id", F.posexplode(F.create_map(F.lit("Drawing no"), c("drawing_no"), F.lit("Revision"), c("revision"))).alias("pos", "field", "value"))
    v = reconcile.reconcile(table(s, d, "sightings")).select("drawing_id", c("first_seq").alias("seq"), "tag", "length_mm", "width_mm", "quantity", F.lit(None).cast("double").alias("height_mm"), F.when(c("quantity") == 2, F.array(*[F.lit(x) for x in (0.1, 0.1, 0.2, 0.2)])).alias("rect"))
    slab = table(s, d, "elements").where("kind_no = 3").select("drawing_id", c("pos").alias("seq"), "tag", (c("length_m") * 1000).alias("length_mm"), (c("width_m") * 1000).alias("width_mm"), (c("thickness_m") * 1000).alias("thickness_mm"), (c("length_m") >= 1).alias("usable"))
    kinds = F.create_map(*[F.lit(x) for kv in FINDING_KINDS.items() for x in kv])
    found = scan(s, d).withColumn("kind", kinds[c("kind")]).where("kind is not null")
    found = found.select("drawing_id", c("line_no").alias("seq"), "kind", F.concat_ws(", ", "txt", *[c(f).cast("string") for f in ("f1", "f2", "f3")]).alias("detail"), F.lit(None).cast("array<double>").alias("rect"))
    return verify.verification_rows(verify.check_items(titles, v, slab, table(s, d, "marks"), found))


def evidence(s, d):
    rows = checks(s, d).withColumn("source", verify.evidence_source(c("note"), c("drawing_id").cast("long") % 3 == 0))
    return verify.evidence_counts(rows)


def title_replies(s, d):
    p = table(s, d, "projects")
    return p.select("drawing_id", F.when(c("revision") != "", F.concat(F.lit("DRAWING NO: "), "drawing_no")).otherwise("").alias("drawing_no"), c("revision"), F.when(c("drawing_id").cast("long") % 3 == 0, "").otherwise(F.date_format("created_at", "d/M/yyyy")).alias("date"), F.when(c("drawing_id").cast("long") % 2 == 0, c("project_name")).otherwise(" ").alias("project_name"))


def pedestal_replies(s, d):
    return table(s, d, "lines").select("drawing_id", c("line_no").alias("seq"), F.lit("r0c0").alias("region"), "grid_ref", F.when(c("line_no") % 5 == 0, "").otherwise(grammar.normalised(c("text"))).alias("raw_text"), F.concat(F.lit("p "), (c("block_id") + 1).cast("string")).alias("tag"), (100 * (c("line_no") + 1)).cast("string").alias("length_mm"), F.lit("500").alias("width_mm"), F.when(c("line_no") % 2 == 0, "2").otherwise("x").alias("quantity"))


def slab_replies(s, d):
    return table(s, d, "lines").where("text like '%GRADE SLAB' or text like 'TOC%'").select("drawing_id", F.when(c("line_no") % 2 == 0, "GS-02").otherwise("").alias("tag"), (1000 * (c("line_no") - 1)).cast("string").alias("length_mm"), F.lit("3000").alias("width_mm"), F.when(c("text").like("TOC%"), "250").alias("thickness_mm"), F.lit("").alias("toc_level"), c("text").alias("raw_text"))


def rule_findings(s, d):
    f = scan(s, d).where("kind in ('curb_wall', 'epoxy', 'blinding')")
    return f.select("drawing_id", c("line_no").alias("seq"), "kind", c("f1").alias("thickness_mm"), c("f2").alias("height_mm"))


def element_rows(s, d):
    e = table(s, d, "elements")
    return e.select("drawing_id", F.when(c("pos") % 6 == 0, "  ").otherwise(c("tag")).alias("tag"), F.when(c("quantity") % 7 == 0, "-1").otherwise(c("length_m").cast("string")).alias("length_m"), F.when(c("quantity") % 11 == 0, "wide").otherwise(c("width_m").cast("string")).alias("width_m"), c("height_m").cast("string").alias("height_m"), c("quantity").cast("string").alias("quantity"), F.when(c("pos") % 2 == 0, " ").otherwise(c("grade")).alias("grade"), F.when(c("pos") % 3 == 0, "").otherwise("90").alias("rebar_coefficient"))


def ingested(s, d):
    right, look, bank, _ = verify.ingest_reviews(table(s, d, "reviews"))
    rows = right.select(F.lit("accuracy").alias("what"), F.coalesce("item", "drawing", F.lit("all")).alias("name"), c("n_reviewed").cast("long").alias("n"))
    rows = rows.unionByName(look.select(F.lit("look at").alias("what"), c("callout").alias("name"), c("row_no").cast("long").alias("n")))
    return rows.unionByName(bank.select(F.lit("example").alias("what"), c("drawing_no").alias("name"), c("n_pedestals").cast("long").alias("n")))


def reviewed(s, d):
    return verify.classify_rows(table(s, d, "reviews"))


#: The pedestal callout, with its parts named; used by every SQL text that reads callouts.
PEDESTAL = r"'(?i)\b(P\s?\d{1,2})\b\s*[\(\[]\s*(\d{2,4})\s*[x×X*]\s*(\d{2,4})(?:\s*[x×X*]\s*(\d{2,4}))?\s*[\)\]]\s*[-–—:]?\s*(\d{1,3})\s*(?:N\s*[o0O]\s*s?|NOS|N[o0O]\.)'"
LINES = """, ln AS (SELECT drawing_id, block_id, line_no, grid_ref, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM lines),
ped AS (SELECT *, regexp_extract(t, '(?i)\\b(P\\s?\\d{1,2})\\b\\s*[\\(\\[]\\s*(\\d{2,4})\\s*[x×X*]\\s*(\\d{2,4})(?:\\s*[x×X*]\\s*(\\d{2,4}))?\\s*[\\)\\]]\\s*[-–—:]?\\s*(\\d{1,3})\\s*(?:N\\s*[o0O]\\s*s?|NOS|N[o0O]\\.)', ['tag', 'l', 'w', 'h', 'q']) AS m FROM ln),
pd AS (SELECT *, nullif(upper(replace(m.tag, ' ', '')), '') AS tag, TRY_CAST(m.l AS DOUBLE) AS l, TRY_CAST(m.w AS DOUBLE) AS w, TRY_CAST(m.h AS DOUBLE) AS h, TRY_CAST(m.q AS INT) AS q FROM ped),
raw AS (
  SELECT drawing_id, block_id, line_no, grid_ref, 1 AS o, 'curb_wall' AS kind, unnest(regexp_extract_all(t, '(?i)CURB\\s*WALL\\s*(\\d{2,4})\\s*THK\\s*[x×X]\\s*(\\d{2,4})\\s*HIGH', 1))::DOUBLE AS f1, unnest(regexp_extract_all(t, '(?i)CURB\\s*WALL\\s*(\\d{2,4})\\s*THK\\s*[x×X]\\s*(\\d{2,4})\\s*HIGH', 2))::DOUBLE AS f2, NULL::DOUBLE AS f3, NULL::VARCHAR AS txt FROM ln
  UNION ALL SELECT drawing_id, block_id, line_no, grid_ref, 2, 'sump', unnest(regexp_extract_all(t, '(?i)SUMP\\s*(?:PIT)?\\s*(\\d{3,4})\\s*[x×X]\\s*(\\d{3,4})', 1))::DOUBLE, unnest(regexp_extract_all(t, '(?i)SUMP\\s*(?:PIT)?\\s*(\\d{3,4})\\s*[x×X]\\s*(\\d{3,4})', 2))::DOUBLE, NULL, NULL FROM ln
  UNION ALL SELECT drawing_id, block_id, line_no, grid_ref, 3, 'level', unnest(regexp_extract_all(t, '(?i)\\b(TOC|FGL|BOC|HPP|LPP|IL|FFL|NGL)\\b\\s*\\.?\\s*(?:EL\\.?)?\\s*(\\d{1,3}\\.\\d{2,3})', 2))::DOUBLE, NULL, NULL, upper(unnest(regexp_extract_all(t, '(?i)\\b(TOC|FGL|BOC|HPP|LPP|IL|FFL|NGL)\\b\\s*\\.?\\s*(?:EL\\.?)?\\s*(\\d{1,3}\\.\\d{2,3})', 1))) FROM ln
  UNION ALL SELECT drawing_id, block_id, line_no, grid_ref, 4, 'insert_plate', NULL, NULL, NULL, replace(unnest(regexp_extract_all(t, '(?i)INSERT\\s*PLATE\\s*TYPE\\s*([A-Z]\\s?\\d{1,2}\\s?[a-z]?)', 1)), ' ', '') FROM ln
  UNION ALL SELECT drawing_id, block_id, line_no, grid_ref, 5, 'epoxy', unnest(regexp_extract_all(t, '(?i)(\\d{1,2})\\s*MM\\s*THK\\s*ACID\\s*RESISTANT', 1))::DOUBLE, NULL, NULL, NULL FROM ln
  UNION ALL SELECT * FROM (SELECT drawing_id, block_id, line_no, grid_ref, 6, 'rebar', unnest(regexp_extract_all(t, '(?i)\\(?(\\d{1,3})\\)?\\s*[-–—]\\s*[DØø]\\s?(\\d{1,2})\\b', 1))::DOUBLE AS n, unnest(regexp_extract_all(t, '(?i)\\(?(\\d{1,3})\\)?\\s*[-–—]\\s*[DØø]\\s?(\\d{1,2})\\b', 2))::DOUBLE AS d, NULL, NULL FROM ln) WHERE n BETWEEN 1 AND 200 AND d IN (6, 8, 10, 12, 16, 20, 25, 28, 32, 40)
  UNION ALL SELECT * FROM (SELECT drawing_id, block_id, line_no, grid_ref, 7, 'rebar', NULL, unnest(regexp_extract_all(t, '(?i)[DØø]\\s?(\\d{1,2})\\s*(?:[-–—@]|\\s)\\s*(\\d{2,3})\\s*(?:c/c|LINKS|CTS)?', 1))::DOUBLE AS d, unnest(regexp_extract_all(t, '(?i)[DØø]\\s?(\\d{1,2})\\s*(?:[-–—@]|\\s)\\s*(\\d{2,3})\\s*(?:c/c|LINKS|CTS)?', 2))::DOUBLE AS sp, NULL FROM ln) WHERE sp BETWEEN 50 AND 500 AND d IN (6, 8, 10, 12, 16, 20, 25, 28, 32, 40)
  UNION ALL SELECT * FROM (SELECT drawing_id, block_id, line_no, grid_ref, 8, 'thickness', TRY_CAST(regexp_extract(t, '(?i)\\(?\\s*(\\d{2,4})\\s*THK\\s*\\)?', 1) AS DOUBLE) AS th, NULL, NULL, NULL FROM ln) WHERE th BETWEEN 75 AND 2000
  UNION ALL SELECT drawing_id, block_id, line_no, grid_ref, 9, 'blinding', unnest(regexp_extract_all(t, '(?i)(\\d{2,4})\\s*THK\\s*(?:PCC|BLINDING)', 1))::DOUBLE, NULL, NULL, NULL FROM ln
  UNION ALL SELECT drawing_id, block_id, line_no, grid_ref, 10, 'pedestal', l, w, q, tag FROM pd WHERE tag IS NOT NULL AND l BETWEEN 150 AND 3000 AND w BETWEEN 150 AND 3000 AND q BETWEEN 1 AND 999),
seen AS (SELECT *, row_number() OVER (PARTITION BY drawing_id, kind, txt, CASE WHEN kind <> 'pedestal' THEN f1 END, CASE WHEN kind <> 'pedestal' THEN f2 END, CASE WHEN kind <> 'pedestal' THEN f3 END ORDER BY block_id, line_no, o) AS k,
  first_value(nullif(grid_ref, '') IGNORE NULLS) OVER (PARTITION BY drawing_id, kind, txt, CASE WHEN kind <> 'pedestal' THEN f1 END, CASE WHEN kind <> 'pedestal' THEN f2 END, CASE WHEN kind <> 'pedestal' THEN f3 END ORDER BY block_id, line_no, o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS place FROM raw)
"""

VOTES = """, by_reading AS (SELECT drawing_id, tag, validated, length_mm, width_mm, quantity, count(*) AS n, min(seq) AS first_seq FROM sightings GROUP BY ALL),
va AS (SELECT drawing_id, tag, bool_or(validated) AS any_valid, string_agg(DISTINCT region, ', ' ORDER BY region) AS regions, count(DISTINCT region) AS n_regions FROM sightings GROUP BY 1, 2),
vk AS (SELECT b.*, va.regions, va.n_regions, count(*) OVER (PARTITION BY b.drawing_id, b.tag) AS readings, row_number() OVER (PARTITION BY b.drawing_id, b.tag ORDER BY n DESC, first_seq) AS k FROM by_reading b JOIN va ON va.drawing_id = b.drawing_id AND va.tag = b.tag WHERE NOT any_valid OR validated),
vote AS (SELECT drawing_id, tag, length_mm, width_mm, quantity, validated, first_seq, regions, CASE WHEN readings > 1 THEN 'low' WHEN validated AND n_regions > 1 THEN 'high' WHEN validated THEN 'medium' ELSE 'low' END AS confidence, readings > 1 AS disagreed, CAST(regexp_extract(tag, '(\\d+)', 1) AS INT) AS tag_no FROM vk WHERE k = 1)
"""
CROPS = """, rp AS (SELECT drawing_id, montage, CASE WHEN json_valid(reply) THEN reply END AS j FROM replies),
cr AS (SELECT drawing_id, montage, unnest(range(0, CAST(json_array_length(j, '$.crops') AS BIGINT))) AS i, j FROM rp WHERE json_type(j) = 'OBJECT'),
crop AS (SELECT drawing_id, montage, CAST(i AS INT) AS i, TRY_CAST(json_extract_string(j, '$.crops[' || i || '].id') AS INT) AS crop_id, CAST(json_extract(j, '$.crops[' || i || '].lines') AS VARCHAR[]) AS raw FROM cr UNION ALL SELECT drawing_id, montage, 0, NULL, CAST(CAST(j AS JSON) AS VARCHAR[]) FROM rp WHERE json_type(j) = 'ARRAY'),
cp AS (SELECT drawing_id, montage, i, crop_id, array_to_string(list_filter(list_transform(raw, lambda x: trim(x)), lambda x: x <> ''), '|') AS lines, count(crop_id) OVER (PARTITION BY drawing_id, montage) AS printed, count(*) OVER (PARTITION BY drawing_id, montage) AS came FROM crop)
"""
REVIEWED = """, rv AS (SELECT *, trim(coalesce(corrected, '')) <> '' OR trim(coalesce(verified_by, '')) <> '' AS reviewed, trim(corrected) <> '' AND CAST(printf('%.6g', TRY_CAST(trim(corrected) AS DOUBLE)) AS VARCHAR) <> CAST(printf('%.6g', TRY_CAST(extracted AS DOUBLE)) AS VARCHAR) AS changed FROM reviews)"""

CHECKS = LINES + VOTES + """, al AS (
  SELECT drawing_id, 0 AS section, '0' AS pos, 'Title block' AS kind, 'Drawing no' AS label, drawing_no AS extracted, '' AS note, false AS boxed FROM projects WHERE coalesce(drawing_no, '') <> ''
  UNION ALL SELECT drawing_id, 0, '1', 'Title block', 'Revision', revision, '', false FROM projects WHERE coalesce(revision, '') <> ''
  UNION ALL SELECT drawing_id, 1, CAST(first_seq AS VARCHAR), 'Pedestal', tag, CAST(CAST(round(length_mm) AS INT) AS VARCHAR) || ' x ' || CAST(CAST(round(width_mm) AS INT) AS VARCHAR) || ' mm, ' || CAST(quantity AS VARCHAR) || ' Nos', 'height NOT on drawing', quantity = 2 FROM vote
  UNION ALL SELECT drawing_id, 2, CAST(pos AS VARCHAR), 'Grade slab', tag, CAST(CAST(round(length_m * 1000) AS INT) AS VARCHAR) || ' x ' || CAST(CAST(round(width_m * 1000) AS INT) AS VARCHAR) || ' x ' || CAST(CAST(round(thickness_m * 1000) AS INT) AS VARCHAR), 'read off the plan view', false FROM elements WHERE kind_no = 3 AND length_m >= 1
  UNION ALL SELECT drawing_id, 3, mark, 'Position marks', mark, CAST(n AS VARCHAR) || ' printed', 'labels counted, not a quantity', false FROM marks
  UNION ALL SELECT drawing_id, 3 + list_position(['Curb wall', 'Sump', 'Level', 'Insert plate', 'Epoxy', 'Rebar', 'Thickness'], kd), CAST(line_no AS VARCHAR), kd, '', concat_ws(', ', txt, CAST(f1 AS VARCHAR), CAST(f2 AS VARCHAR), CAST(f3 AS VARCHAR)), 'incomplete on the drawing', false
    FROM (SELECT *, CASE kind WHEN 'curb_wall' THEN 'Curb wall' WHEN 'sump' THEN 'Sump' WHEN 'level' THEN 'Level' WHEN 'insert_plate' THEN 'Insert plate' WHEN 'epoxy' THEN 'Epoxy' WHEN 'rebar' THEN 'Rebar' WHEN 'thickness' THEN 'Thickness' WHEN 'blinding' THEN 'Thickness' END AS kd FROM seen WHERE k = 1) WHERE kd IS NOT NULL),
ck AS (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY section, length(pos), pos, label, extracted) AS number FROM al)
"""
REPLIES = """, rr AS (SELECT drawing_id, line_no AS seq, line_no % 5 <> 0 AND tag IS NOT NULL AS validated, tag AS otag, l, w, h, q, 'P' || CAST(block_id + 1 AS VARCHAR) AS rtag, 100.0::DOUBLE * (line_no + 1) AS rl, 500.0::DOUBLE AS rw, CASE WHEN line_no % 2 = 0 THEN 2 END AS rq FROM pd),
rs AS (SELECT drawing_id, seq, validated, CASE WHEN validated THEN otag ELSE rtag END AS tag, CASE WHEN validated THEN l ELSE rl END AS length_mm, CASE WHEN validated THEN w ELSE rw END AS width_mm, CASE WHEN validated THEN h END AS height_mm, CASE WHEN validated THEN q ELSE rq END AS quantity, coalesce(validated AND (l <> rl OR w <> rw OR q <> rq), false) AS disagrees FROM rr),
rp AS (SELECT *, CASE WHEN NOT regexp_full_match(tag, 'P\\d{1,2}') THEN 'tag' WHEN NOT length_mm BETWEEN 150 AND 3000 THEN 'length_mm' WHEN NOT width_mm BETWEEN 150 AND 3000 THEN 'width_mm' WHEN quantity IS NULL OR NOT quantity BETWEEN 1 AND 999 THEN 'quantity' END AS reason FROM rs)
"""
TYPED = """, ty AS (SELECT *, CASE WHEN quantity % 7 = 0 THEN 'length_m' WHEN quantity % 11 = 0 THEN 'width_m' WHEN NOT coalesce(height_m > 0, false) THEN 'height_m' WHEN NOT quantity > 0 THEN 'quantity' END AS reason FROM elements WHERE pos % 6 <> 0)"""

QUERIES = {
    "display_labels": lambda s, d: stores.display_labels(table(s, d, "projects").select(F.concat(F.lit("/plans/f"), (c("drawing_id").cast("long") % 3).cast("string"), F.lit("/s"), (c("drawing_id").cast("long") % 700).cast("string"), F.lit(".pdf")).alias("path")).distinct()),
    "fingerprints": lambda s, d: table(s, d, "documents").select("doc_id", stores.fingerprint(c("text"), F.lit("thorough"), (c("doc_id") % 3).cast("int")).alias("fp")),
    "backfill_index": lambda s, d: stores.backfill_index(table(s, d, "projects").select(F.concat(F.lit("sheet_"), "drawing_id").alias("stem")), table(s, d, "projects").where("cast(drawing_id as long) % 3 <> 0").select("path", F.lit(0).alias("folder_no"), F.concat(F.lit("fp"), "drawing_id").alias("fingerprint")), table(s, d, "projects").where("cast(drawing_id as long) % 5 = 0").select(F.concat(F.lit("fp"), "drawing_id").alias("fingerprint")))[1],
    "cache_stats": lambda s, d: stores.cache_stats(table(s, d, "documents").select(c("n_chars").alias("length"))),
    "example_stats": lambda s, d: stores.example_stats(table(s, d, "projects").select("drawing_no", (c("drawing_id").cast("long") % 4).alias("n_pedestals"))),
    "upsert_rates": lambda s, d: stores.upsert_rates(table(s, d, "rates")),
    "rates_lookup": lambda s, d: stores.rates_lookup(table(s, d, "items").select(c("description").alias("category"), c("uom").alias("unit")).distinct().unionByName(table(s, d, "rates").select("category", "unit").distinct()), stores.upsert_rates(table(s, d, "rates"))),
    "classify_drawings": lambda s, d: stores.classify_drawings(table(s, d, "projects").select("drawing_id", "path"), table(s, d, "classifications")).select("drawing_id", "classification"),
    "read_reviews": lambda s, d: stores.read_reviews(table(s, d, "reviews").select("source", F.concat(F.lit("Drawing: "), "drawing_no", F.lit(" rev")).alias("header"), F.array(F.when(c("row_no") % 4 == 0, "x").otherwise(c("row_no").cast("string")), c("item"), c("tag"), c("extracted"), c("corrected"), c("verified_by")).alias("cells"))).select("row_no", "drawing_no", "item", "tag", "extracted", "corrected", "verified_by", "notes"),
    "parse_callouts": callouts,
    "clean_title_fields": cleaned,
    "scan_lines": scan,
    "scan_with_provenance": provenance,
    "dedupe_pedestals": pedestals,
    "drop_furniture": lambda s, d: discovery.drop_furniture(table(s, d, "lines")).select("drawing_id", "line_no", "text"),
    "discovered_items": lambda s, d: discovery.merge_items(discovery.discover(table(s, d, "lines"))),
    "discovered_callouts": lambda s, d: discovery.merge_items(discovery.discover(table(s, d, "callouts"))),
    "label_context": lambda s, d: discovery.label_context(table(s, d, "callouts")).select("drawing_id", "line_no", "text", "context", "below"),
    "sheet_levels": lambda s, d: discovery.sheet_levels(table(s, d, "lines")),
    "height_candidates": lambda s, d: discovery.height_candidates(table(s, d, "levels")),
    "strength_specs": lambda s, d: discovery.strength_specs(table(s, d, "lines")),
    "concrete_grades": lambda s, d: discovery.concrete_grades(table(s, d, "lines")),
    "discovery_summary": lambda s, d: discovery.discovery_summary(table(s, d, "items")),
    "route_sheets": lambda s, d: geometry.route_sheets(table(s, d, "spans")),
    "visual_lines": visual,
    "label_blocks": lambda s, d: geometry.label_blocks(table(s, d, "spans")).select("drawing_id", "page", "line_id", "block"),
    "position_marks": lambda s, d: geometry.position_marks(table(s, d, "spans")),
    "sheet_drawing_no": drawing_nos,
    "sheet_revision": revisions,
    "grid_refs": grid_refs,
    "detect_grid": lambda s, d: geometry.detect_grid(table(s, d, "glyphs"), table(s, d, "sheets")),
    "glyph_filter": lambda s, d: geometry.glyph_filter(table(s, d, "glyphs")).select("glyph_id"),
    "merge_overlaps": lambda s, d: geometry.merge_overlaps(geometry.glyph_filter(table(s, d, "glyphs"))),
    "callout_candidates": lambda s, d: geometry.callout_candidates(table(s, d, "glyphs").select("drawing_id", "page", c("glyph_id").alias("box"), (c("x0") * 2).alias("x0"), (c("y0") * 2).alias("y0"), (c("x0") * 2 + (c("x1") - c("x0")) * 40).alias("x1"), (c("y0") * 2 + (c("y1") - c("y0")) * 5).alias("y1"))).select("box", "reading"),
    "tile_labels": tiles,
    "hamming_distance": hamming,
    "find_similar": similar,
    "place_crops": placed,
    "truncated_replies": lambda s, d: reconcile.truncated_replies(crops(s, d), slots(s, d)),
    "reconcile": lambda s, d: reconcile.reconcile(table(s, d, "sightings")),
    "vote_location": lambda s, d: reconcile.vote_location(table(s, d, "sightings")),
    "plan_merge": plan,
    "plan_warnings": merge_warnings,
    "extraction_warnings": provenance_lines,
    "merge_into_project": merged,
    "extraction_summary": lambda s, d: reconcile.extraction_summary(calls(s, d)),
    "audit_log": lambda s, d: reconcile.audit_log(calls(s, d)).select("job_id", "status"),
    "verification_rows": lambda s, d: checks(s, d).select("drawing_id", "number", "kind", "label", "extracted", "note", "corrected", "verified_by"),
    "ordered_evidence": lambda s, d: verify.ordered(checks(s, d)).select("drawing_id", "number", "rank", F.coalesce(F.size("rect") == 4, F.lit(False)).alias("boxed")),
    "traceable_evidence": lambda s, d: verify.traceable(checks(s, d)).select("drawing_id", "number", "kind"),
    "title_blocks": lambda s, d: reconcile.title_blocks(title_replies(s, d)),
    "reply_pedestals": lambda s, d: reconcile.pedestals_from_replies(pedestal_replies(s, d))[0].select("drawing_id", "seq", "tag", "length_mm", "width_mm", "height_mm", "quantity", "validated", "disagrees"),
    "reply_rejects": lambda s, d: reconcile.pedestals_from_replies(pedestal_replies(s, d))[1],
    "reply_slabs": lambda s, d: reconcile.grade_slabs_from_replies(slab_replies(s, d)),
    "seeded_rules": lambda s, d: derive.seed_rules(derive.select_rules(derive.default_rules(s), "all"), rule_findings(s, d)).select("drawing_id", "rule_key", F.explode("params").alias("param", "value")),
    "typed_elements": lambda s, d: bill.elements_from_rows(element_rows(s, d))[0],
    "typed_rejects": lambda s, d: bill.elements_from_rows(element_rows(s, d))[1],
    "ingested_reviews": ingested,
    "evidence_counts": evidence,
    "classified_reviews": lambda s, d: reviewed(s, d).select("row_no", "reviewed", "changed"),
    "accuracy": lambda s, d: verify.accuracy(reviewed(s, d)),
    "unparsed_callouts": lambda s, d: verify.unparsed_callouts(reviewed(s, d)).select("row_no", "callout"),
    "bank_examples": lambda s, d: verify.bank_examples(reviewed(s, d)),
    "failed_reviews": failed,
    "scan_drawings": lambda s, d: stores.distinct_drawings(files_of(s, d)).select("path", "name", "folder_no", "sha"),
    "store_extractions": stored,
    "read_examples": lambda s, d: stores.verified_examples(examples_of(s, d)).select("drawing_no", F.to_json("verified_extraction").alias("verified"), "verified_by"),
    "write_table": sunk,
    "text_blocks": glyph_blocks,
    "dedupe_requests": lambda s, d: telemetry.dedupe_requests(table(s, d, "jobs").select(c("position").alias("seq"), "owner", "drawing_path", "page"), table(s, d, "jobs")),
    "latest_by_drawing": lambda s, d: telemetry.latest_by_drawing(table(s, d, "jobs")).select("drawing_path", "page", "job_id", "state"),
    "job_summary": lambda s, d: telemetry.job_summary(table(s, d, "jobs"), F.lit(NOW).cast("timestamp")),
    "stale_jobs": lambda s, d: telemetry.stale_jobs(table(s, d, "jobs"), F.lit(NOW).cast("timestamp")),
    "drawing_status": lambda s, d: telemetry.drawing_status(table(s, d, "jobs").select("drawing_path").distinct(), telemetry.latest_by_drawing(table(s, d, "jobs").withColumn("page", F.lit(0))), table(s, d, "jobs").where("state = 'done'"), table(s, d, "jobs").groupBy("drawing_path").agg((F.count("*") % 3).alias("needs_attention"))),
    "status_tally": lambda s, d: telemetry.status_tally(QUERIES["drawing_status"](s, d)),
    "queue_report": lambda s, d: telemetry.queue_report(table(s, d, "jobs"))[0],
    "queue_causes": lambda s, d: telemetry.queue_report(table(s, d, "jobs"))[1],
    "saved_reading": lambda s, d: telemetry.saved_reading(table(s, d, "jobs").groupBy("drawing_path").agg(F.concat(F.lit("sha"), (F.min("position") % 3).cast("string")).alias("content_sha"), F.min(F.concat(F.lit("fpd"), "fingerprint")).alias("default_fingerprint")), table(s, d, "jobs"), table(s, d, "jobs").select("fingerprint")),
    "cache_hits": lambda s, d: telemetry.cache_hits(table(s, d, "jobs").select("fingerprint", (c("position") % 4 == 0).alias("forced")), table(s, d, "jobs").where("state = 'done'").select("fingerprint")),
    "fold_job_state": lambda s, d: telemetry.fold_job_state(table(s, d, "job_events")).select("job_id", "state", "progress_pct", F.unix_micros("started_at").alias("started_us"), F.unix_micros("heartbeat_at").alias("heartbeat_us"), rounded(F.coalesce("elapsed_s", F.lit(0.0)), 3).alias("elapsed_s"), "error", "from_cache", "n_events"),
}

LATEST = ", lt AS (SELECT *, row_number() OVER (PARTITION BY drawing_path, page ORDER BY created_at DESC, position DESC, job_id DESC) AS k FROM jobs)"
STATUS = """, ld AS (SELECT *, row_number() OVER (PARTITION BY drawing_path ORDER BY created_at DESC, position DESC, job_id DESC) AS k FROM jobs),
st AS (SELECT drawing_path, CASE WHEN state = 'running' THEN 'reading' WHEN state = 'queued' THEN 'queued' WHEN state = 'failed' THEN 'failed' WHEN done AND n % 3 > 0 THEN 'needs_review' WHEN done THEN 'ready' ELSE 'not_read' END AS status
  FROM (SELECT l.drawing_path, l.state, (SELECT count(*) FROM jobs j WHERE j.drawing_path = l.drawing_path) AS n, EXISTS (SELECT 1 FROM jobs j WHERE j.drawing_path = l.drawing_path AND j.state = 'done') AS done FROM ld l WHERE k = 1))
"""
HEIGHTS = "; merged at a placeholder 0.800 m. Concrete, formwork and rebar for these pedestals are WRONG until the real heights are entered (the drawing''s review grid, or BOQ → Project estimate)."
WARNED = VOTES + """, there AS (SELECT DISTINCT drawing_id, kind_no, upper(tag) AS up FROM elements WHERE kind_no IN (2, 3) AND pos % 2 = 1),
warned AS (SELECT drawing_id, 0 AS part, CAST(0 AS BIGINT) AS seq, 'UNVERIFIED: pedestal height is not on the callouts for ' || string_agg(tag, ', ' ORDER BY first_seq) || '""" + HEIGHTS + """' AS warning
  FROM vote v WHERE first_seq % 2 = 0 AND NOT EXISTS (SELECT 1 FROM there t WHERE t.drawing_id = v.drawing_id AND kind_no = 2 AND up = upper(v.tag)) GROUP BY 1
  UNION ALL SELECT drawing_id, 1, CAST(pos AS BIGINT), 'UNVERIFIED: grade slab ' || lower(tag) || ' extent was read off the plan view, not a callout. Confirm ' || printf('%g', quantity * 100.5::DOUBLE) || ' x ' || printf('%g', quantity % 3 * 1000::DOUBLE) || ' x 250 mm against the sheet.'
  FROM elements e WHERE kind_no = 3 AND quantity <> 0 AND quantity % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM there t WHERE t.drawing_id = e.drawing_id AND t.kind_no = 3 AND up = upper(e.tag))
  UNION ALL SELECT drawing_id, 2, CAST(0 AS BIGINT), 'Low-confidence pedestal reading(s): ' || string_agg(tag, ', ' ORDER BY first_seq) || '. Check these against the drawing before pricing.' FROM vote WHERE confidence = 'low' GROUP BY 1)
"""
NO = "regexp_matches(text, 'MD-\\d{3}-\\d{4}')"

ORACLES = {
    "display_labels": sql("projects", ", f AS (SELECT DISTINCT '/plans/f' || CAST(CAST(drawing_id AS BIGINT) % 3 AS VARCHAR) || '/s' || CAST(CAST(drawing_id AS BIGINT) % 700 AS VARCHAR) || '.pdf' AS path FROM projects) SELECT path, CASE WHEN count(*) OVER (PARTITION BY split_part(path, '/', 4)) > 1 THEN split_part(path, '/', 4) || ' (' || split_part(path, '/', 3) || ')' ELSE split_part(path, '/', 4) END AS label FROM f"),
    "fingerprints": "SELECT doc_id, substring(sha256('thorough' || CASE WHEN doc_id % 3 <> 0 THEN '#page=' || CAST(doc_id % 3 AS VARCHAR) ELSE '' END || text), 1, 32) AS fp FROM documents",
    "backfill_index": sql("projects", "SELECT count(*) AS seen, count(*) FILTER (CAST(drawing_id AS BIGINT) % 3 <> 0 AND CAST(drawing_id AS BIGINT) % 5 <> 0) AS linked, count(*) FILTER (NOT (CAST(drawing_id AS BIGINT) % 3 <> 0 AND CAST(drawing_id AS BIGINT) % 5 <> 0)) AS skipped FROM projects"),
    "cache_stats": "SELECT count(*) AS entries, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents",
    "example_stats": sql("projects", "SELECT count(*) AS files, count(DISTINCT drawing_no) AS drawings, CAST(sum(CAST(drawing_id AS BIGINT) % 4) AS BIGINT) AS pedestals, count(*) >= 10 AS enough FROM projects"),
    "upsert_rates": sql("rates", "SELECT category, unit, arg_max(rate, seq) AS rate FROM rates GROUP BY 1, 2"),
    "rates_lookup": sql("rates items", "SELECT p.category, p.unit, coalesce(r.rate, 0.0) AS rate FROM (SELECT DISTINCT description AS category, uom AS unit FROM items UNION SELECT DISTINCT category, unit FROM rates) p LEFT JOIN (SELECT category, unit, arg_max(rate, seq) AS rate FROM rates GROUP BY 1, 2) r ON r.category = p.category AND r.unit = p.unit"),
    "classify_drawings": sql("projects classifications", "SELECT p.drawing_id, CASE WHEN k.classification IN ('Green Field', 'Brown Field', 'Repair') THEN k.classification ELSE 'Green Field' END AS classification FROM projects p LEFT JOIN classifications k ON k.file_name = split_part(p.path, '/', 2)"),
    "read_reviews": sql("reviews", "SELECT row_no, CASE WHEN drawing_no = '' THEN 'rev' ELSE drawing_no END AS drawing_no, item, tag, extracted, corrected, verified_by, '' AS notes FROM reviews WHERE row_no % 4 <> 0"),
    "parse_callouts": sql("lines", LINES + "SELECT drawing_id, line_no, tag, l AS length_mm, w AS width_mm, h AS height_mm, q AS quantity, TRY_CAST(regexp_extract(t, '(?i)\\(?\\s*(\\d{2,4})\\s*THK\\s*\\)?', 1) AS DOUBLE) AS thick, regexp_extract(t, '(?i)TOC\\s*\\.?\\s*EL\\.?\\s*([0-9]{1,3}\\.[0-9]{2,3})', 1) AS toc, tag IS NOT NULL AND l BETWEEN 150 AND 3000 AND w BETWEEN 150 AND 3000 AND q BETWEEN 1 AND 999 AS ok, CASE WHEN tag IS NULL THEN 'tag' WHEN NOT l BETWEEN 150 AND 3000 THEN 'length_mm' WHEN NOT w BETWEEN 150 AND 3000 THEN 'width_mm' WHEN NOT q BETWEEN 1 AND 999 THEN 'quantity' ELSE '' END AS reason FROM pd"),
    "clean_title_fields": sql("projects", "SELECT drawing_id, drawing_no AS no, revision AS rev, project_name AS name, strftime(created_at, '%Y-%m-%d') AS date, CASE WHEN day(created_at) <= 12 AND day(created_at) <> month(created_at) THEN 'ambiguous' ELSE '' END AS note FROM projects"),
    "scan_lines": sql("lines", LINES + "SELECT drawing_id, line_no, kind, f1, f2, f3, txt FROM seen WHERE k = 1"),
    "scan_with_provenance": sql("lines", LINES + "SELECT drawing_id, line_no, kind, f1, f2, f3, txt, coalesce(nullif(grid_ref, ''), place, '') AS grid_ref FROM seen WHERE k = 1 AND kind <> 'pedestal'"),
    "dedupe_pedestals": sql("lines", LINES + "SELECT drawing_id, txt AS tag, line_no, grid_ref FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id, txt ORDER BY grid_ref = '', block_id, line_no) AS k2 FROM seen WHERE kind = 'pedestal') WHERE k2 = 1"),
    "drop_furniture": sql("lines", LINES + "SELECT drawing_id, line_no, t AS text FROM ln WHERE NOT regexp_matches(t, '(?i)^\\s*(SECTION|DETAIL|SCALE|VIEW|REV|REVISION|MOMENT|HORIZONTAL|DRAWN|SHEET)\\b|^\\s*(LOOKING\\s+(NORTH|SOUTH|EAST|WEST)|KEY\\s*PLAN|PROPRIETARY|NOTES?|LEGEND|REMARK)') AND length(t) >= 3 AND NOT (length(t) > 110 AND length(t) - length(replace(t, ' ', '')) > 14)"),
    "sheet_levels": sql("lines", "SELECT DISTINCT drawing_id, upper(unnest(regexp_extract_all(text, '(?i)\\b(TOC|BOC|BOBP|BOP|FGL|FFL|NGL|IL|HPP|LPP|TOS|U/S)\\b[^0-9]{0,24}?(\\d{1,3}\\.\\d{2,3})\\b', 1))) AS kind, CAST(unnest(regexp_extract_all(text, '(?i)\\b(TOC|BOC|BOBP|BOP|FGL|FFL|NGL|IL|HPP|LPP|TOS|U/S)\\b[^0-9]{0,24}?(\\d{1,3}\\.\\d{2,3})\\b', 2)) AS DOUBLE) AS level_m FROM lines"),
    "height_candidates": sql("levels", "SELECT DISTINCT t.drawing_id, t.kind AS top, b.kind AS bottom, round(t.level_m - b.level_m, 3) AS height_m FROM levels t JOIN levels b ON t.drawing_id = b.drawing_id AND t.level_m > b.level_m WHERE t.kind IN ('BOBP', 'TOC', 'TOS', 'FFL', 'U/S') AND b.kind IN ('BOC', 'BOP', 'NGL', 'FGL') AND round(t.level_m - b.level_m, 3) BETWEEN 0.1 AND 15"),
    "strength_specs": sql("lines", "SELECT DISTINCT drawing_id, CAST(unnest(regexp_extract_all(text, '(?i)(\\d{2,3}(?:\\.\\d)?)\\s*(N/mm2|MPa)', 1)) AS DOUBLE) AS value, lower(unnest(regexp_extract_all(text, '(?i)(\\d{2,3}(?:\\.\\d)?)\\s*(N/mm2|MPa)', 2))) AS unit FROM lines WHERE length(text) >= 12"),
    "concrete_grades": sql("lines", "SELECT DISTINCT drawing_id, 'C' || n AS grade FROM (SELECT drawing_id, unnest(regexp_extract_all(text, '(?i)\\bC\\s?(\\d{2})(?:[^\\dx×*]|$)', 1)) AS n FROM lines) WHERE CAST(n AS INT) BETWEEN 10 AND 80"),
    "discovered_items": sql("lines", ", " + discovery_sql.items("lines")),
    "discovered_callouts": sql("callouts", ", " + discovery_sql.items("callouts")),
    "label_context": sql("callouts", ", " + discovery_sql.labels("callouts").strip() + " SELECT drawing_id, line_no, text, context, CASE WHEN regexp_matches(below, '[0-9]') THEN '' ELSE below END AS below FROM l WHERE NOT furniture"),
    "discovery_summary": sql("items", "SELECT drawing_id, count(qty) AS measured, count(*) - count(qty) AS to_confirm FROM items GROUP BY 1"),
    "route_sheets": sql("spans", "SELECT *, chars >= 1500 AND n_spans >= 60 AS is_text FROM (SELECT drawing_id, page, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS chars, count(*) FILTER (trim(text) <> '') AS n_spans FROM spans GROUP BY 1, 2)"),
    "visual_lines": sql("spans", """, sp AS (SELECT *, dir_x < 0.9 AS rotated, round(y0, 1) AS row_y FROM spans WHERE trim(text) <> ''),
sl AS (SELECT *, CASE WHEN abs(y0 - lag(y0) OVER w) > 0.6 * greatest(lag(y1 - y0) OVER w, 1.0) THEN 1 ELSE 0 END AS step FROM sp WINDOW w AS (PARTITION BY drawing_id, page, rotated ORDER BY row_y, x0, span_id)),
sg AS (SELECT *, sum(step) OVER (PARTITION BY drawing_id, page, rotated ORDER BY row_y, x0, span_id ROWS UNBOUNDED PRECEDING) AS line FROM sl)
SELECT drawing_id, page, rotated, string_agg(text, ' ' ORDER BY x0, span_id) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM sg GROUP BY drawing_id, page, rotated, line"""),
    "position_marks": sql("spans", "SELECT drawing_id, page, trim(text) AS mark, count(*) AS n FROM spans WHERE regexp_matches(trim(text), '^[PF]\\d{1,2}$') GROUP BY 1, 2, 3"),
    "sheet_drawing_no": sql("spans sheets", f", ow AS (SELECT s.drawing_id, s.page, first(text ORDER BY x0 / 1200.0::DOUBLE + y0 / 1000.0::DOUBLE, text) AS own FROM spans s WHERE {NO} GROUP BY 1, 2) SELECT h.drawing_id, h.page, coalesce(own, regexp_extract(file_name, 'MD-\\d{{3}}-\\d{{4}}'), '') AS drawing_no, own IS NULL AS from_name, coalesce(own <> regexp_extract(file_name, 'MD-\\d{{3}}-\\d{{4}}'), false) AS disagrees FROM sheets h LEFT JOIN ow ON ow.drawing_id = h.drawing_id AND ow.page = h.page"),
    "sheet_revision": sql("spans sheets", f", body AS (SELECT drawing_id, page, string_agg(txt, chr(10) ORDER BY span_id) AS body FROM (SELECT *, {MARKED} AS txt FROM spans) GROUP BY 1, 2), nm AS (SELECT drawing_id, page, regexp_extract(upper({FILED}), '_([A-D]\\d{{2}})\\b', 1) AS filed FROM sheets) "
        "SELECT h.drawing_id, h.page, coalesce(nullif(filed, ''), regexp_extract(right(body, 2000), '\\b([A-D]\\d{2})\\b', 1), '') AS revision, coalesce(regexp_extract_all(body, '\\b(\\d{1,2}[/\\-.]\\d{1,2}[/\\-.]\\d{2,4})\\b', 1)[-1], '') AS date_raw FROM nm h LEFT JOIN body b ON b.drawing_id = h.drawing_id AND b.page = h.page"),
    "plan_warnings": sql("sightings elements", WARNED + "SELECT * FROM warned"),
    "extraction_warnings": sql("sightings elements projects", WARNED + """SELECT drawing_id, 0 AS section, 0 AS part, CAST(0 AS BIGINT) AS seq, 'UNVERIFIED DRAFT — quantities below were derived from ' || CASE WHEN CAST(drawing_id AS BIGINT) % 5 <> 0 THEN split_part(path, '/', -1) ELSE 'a drawing' END || ' by reader vision extraction and have NOT been checked by an engineer.' AS line FROM projects
  UNION ALL SELECT drawing_id, 1, part, seq, warning FROM warned WHERE drawing_id IN (SELECT drawing_id FROM projects)
  UNION ALL SELECT drawing_id, 2, 0, CAST(first_seq AS BIGINT), 'Pedestal ' || tag || ': read as ' || printf('%g', length_mm::DOUBLE) || 'x' || printf('%g', width_mm::DOUBLE) || ' mm, ' || CAST(quantity AS VARCHAR) || ' Nos' || CASE WHEN validated THEN ' from "TYP ' || tag || '"' ELSE '' END || ' [' || confidence || ' confidence, ' || CAST(len(string_split(regions, ', ')) AS VARCHAR) || ' tile sighting(s)]' FROM vote WHERE drawing_id IN (SELECT drawing_id FROM projects)
  UNION ALL SELECT drawing_id, 3, 0, 0, 'Tier 3 items (rebar bar-by-bar, joints, sumps, embedments, excavation extents, concrete grades) are NOT extracted — enter them by hand under BOQ → Project estimate.' FROM projects"""),
    "grid_refs": sql("spans", ", g AS (SELECT span_id, chr(CAST(65 + least(floor(least(greatest(y0 / 1000, 0), 1) * 12), 11) AS INT)) || '-' || CAST(CAST(16 - least(floor(least(greatest(x0 / 1200, 0), 1) * 16), 15) AS INT) AS VARCHAR) AS a, chr(CAST(65 + least(floor(least(greatest(y1 / 1000, 0), 1) * 12), 11) AS INT)) || '-' || CAST(CAST(16 - least(floor(least(greatest(x1 / 1200, 0), 1) * 16), 15) AS INT) AS VARCHAR) AS b FROM spans) SELECT span_id, CASE WHEN a = b THEN a ELSE a || ' → ' || b END AS ref FROM g"),
    "glyph_filter": sql("glyphs", "SELECT glyph_id FROM glyphs WHERE y1 - y0 BETWEEN 9 AND 40 AND x1 - x0 BETWEEN 0.4 AND 40 AND (x1 - x0) * (y1 - y0) > 0.2"),
    "callout_candidates": sql("glyphs", "SELECT box, row_number() OVER (PARTITION BY drawing_id, page ORDER BY round(y0 / 40), x0, box) AS reading FROM (SELECT drawing_id, page, glyph_id AS box, x0 * 2 AS x0, y0 * 2 AS y0, (x0 * 2 + (x1 - x0) * 40) - x0 * 2 AS w, (y0 * 2 + (y1 - y0) * 5) - y0 * 2 AS h FROM glyphs) WHERE w BETWEEN 140 AND 520 AND h BETWEEN 40 AND 120"),
    "tile_labels": sql("spans", "SELECT span_id, 'r' || CAST(r AS VARCHAR) || 'c' || CAST(k AS VARCHAR) AS tile FROM (SELECT span_id, x0 / 1200 AS x, y0 / 1000 AS y FROM spans) s, (SELECT unnest(range(0, 4)) AS k) a, (SELECT unnest(range(0, 3)) AS r) b WHERE x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND x >= greatest((k - 0.1::DOUBLE) / 4, 0) AND x <= least((k + 1 + 0.1::DOUBLE) / 4, 1) AND y >= greatest((r - 0.1::DOUBLE) / 3, 0) AND y <= least((r + 1 + 0.1::DOUBLE) / 3, 1)"),
    "hamming_distance": sql("projects", HASHES + "SELECT a.drawing_id, CAST(bit_count(xor(('0x' || a.image_hash)::UBIGINT, ('0x' || b.image_hash)::UBIGINT)::BIT) AS INT) AS d FROM h a JOIN h b ON CAST(b.drawing_id AS BIGINT) + 1 = CAST(a.drawing_id AS BIGINT)"),
    "find_similar": sql("projects", HASHES + """, pr AS (SELECT q.drawing_no AS q_no, e.drawing_no AS e_no, CAST(bit_count(xor(('0x' || q.image_hash)::UBIGINT, ('0x' || e.image_hash)::UBIGINT)::BIT) AS INT) AS distance, array_to_string(string_split(q.drawing_no, '-')[1:4], '-') = array_to_string(string_split(e.drawing_no, '-')[1:4], '-') AS same
  FROM h q JOIN h e ON q.drawing_no <> e.drawing_no WHERE CAST(q.drawing_id AS BIGINT) % 50 = 0), tr AS (SELECT *, CASE WHEN distance <= 6 THEN 0 WHEN same THEN 1 WHEN distance <= 18 THEN 2 END AS tier FROM pr)
SELECT q_no, e_no, tier, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_no ORDER BY tier, distance, e_no) AS rank FROM tr WHERE tier IS NOT NULL) WHERE rank <= 3"""),
    "place_crops": sql("replies", CROPS + "SELECT drawing_id, montage, i AS \"at\", CASE WHEN crop_id BETWEEN 1 AND 2 THEN crop_id WHEN printed = 0 AND came = 2 THEN i + 1 END AS slot, lines FROM cp"),
    "truncated_replies": sql("replies", CROPS + "SELECT drawing_id, montage, 2 AS sent, count(*) AS returned, 2 - count(*) AS missing FROM cp GROUP BY 1, 2 HAVING count(*) < 2"),
    "reconcile": sql("sightings", VOTES + "SELECT * FROM vote"),
    "vote_location": sql("sightings", ", gv AS (SELECT drawing_id, tag, grid_ref, count(*) AS n FROM sightings WHERE grid_ref <> '' GROUP BY 1, 2, 3), gt AS (SELECT drawing_id, tag, max(n) AS m FROM gv GROUP BY 1, 2) SELECT gt.drawing_id, gt.tag, CASE WHEN count(*) > 1 THEN '' ELSE min(grid_ref) END AS place, count(*) > 1 AS tied FROM gt JOIN gv ON gv.drawing_id = gt.drawing_id AND gv.tag = gt.tag AND gv.n = gt.m GROUP BY 1, 2"),
    "plan_merge": sql("sightings projects elements", VOTES + """, have AS (SELECT DISTINCT drawing_id, kind_no, upper(tag) AS up FROM elements WHERE kind_no IN (2, 3) AND pos % 2 = 1)
SELECT drawing_id, 'field' AS what, 'revision' AS target, CASE WHEN revision = '' THEN 'add' ELSE 'skip' END AS action, CASE WHEN revision = '' THEN 'D01' ELSE 'keeping ''' || revision || ''', extraction said ''D01''' END AS detail FROM projects
UNION ALL SELECT v.drawing_id, 'pedestal', lower(v.tag), CASE WHEN h.up IS NULL THEN 'add' ELSE 'skip' END, CASE WHEN h.up IS NOT NULL THEN 'already entered — extraction ignored' ELSE printf('%.3f', v.length_mm / 1000) || ' x ' || printf('%.3f', v.width_mm / 1000) || ' x ' || CASE WHEN first_seq % 2 = 1 THEN '0.900' ELSE '0.800' END || ' m, ' || quantity || ' Nos' || CASE WHEN first_seq % 2 = 1 THEN '' ELSE '  [height is a 0.800 m PLACEHOLDER]' END END
  FROM vote v LEFT JOIN have h ON h.drawing_id = v.drawing_id AND h.kind_no = 2 AND h.up = upper(v.tag)
UNION ALL SELECT e.drawing_id, 'grade_slab', lower(e.tag), CASE WHEN quantity % 3 = 0 THEN 'reject' WHEN h.up IS NOT NULL THEN 'skip' ELSE 'add' END, CASE WHEN quantity % 3 = 0 THEN 'incomplete dimensions' WHEN h.up IS NOT NULL THEN 'already entered — extraction ignored' ELSE printf('%.3f', quantity * 100.5 / 1000) || ' x ' || (quantity % 3) || '.000 x 0.250 m' END
  FROM elements e LEFT JOIN have h ON h.drawing_id = e.drawing_id AND h.kind_no = 3 AND h.up = upper(e.tag) WHERE e.kind_no = 3"""),
    "merge_into_project": sql("sightings elements", VOTES + "SELECT drawing_id, lower(tag) AS tag, round(length_m, 3) AS length_m, round(width_m, 3) AS width_m, height_m, quantity FROM elements WHERE kind_no = 2 UNION ALL SELECT v.drawing_id, v.tag, round(length_mm / 1000, 3), round(width_mm / 1000, 3), 0.8, quantity FROM vote v WHERE NOT EXISTS (SELECT 1 FROM elements e WHERE e.drawing_id = v.drawing_id AND e.kind_no = 2 AND e.tag = v.tag)"),
    "extraction_summary": sql("jobs", CALLS + "SELECT drawing_id, count(*) FILTER (NOT skipped AND error = '') AS calls, round(coalesce(max(elapsed_s) FILTER (NOT skipped AND error = ''), 0), 2) AS slowest_s, round(coalesce(sum(elapsed_s) FILTER (NOT skipped AND error = ''), 0), 2) AS total_s, count(*) FILTER (skipped) AS skipped, count(*) FILTER (NOT skipped AND error <> '') AS failed FROM k GROUP BY 1"),
    "audit_log": sql("jobs", CALLS + "SELECT job_id, CASE WHEN skipped THEN 'skipped' WHEN error <> '' THEN 'err' ELSE 'ok' END AS status FROM k"),
    "classified_reviews": sql("reviews", REVIEWED + "SELECT row_no, reviewed, changed FROM rv"),
    "accuracy": sql("reviews", REVIEWED + ", rw AS (SELECT *, CASE WHEN drawing_no = '' THEN regexp_replace(split_part(source, '/', -1), '\\.[^.]*$', '') ELSE drawing_no END AS drawing FROM rv WHERE reviewed) SELECT item, drawing, count(*) AS n_reviewed, count(*) FILTER (NOT changed) AS n_right, round(100 * (count(*) FILTER (NOT changed)) / greatest(count(*), 1)::DOUBLE, 1) AS pct FROM rw GROUP BY GROUPING SETS ((item), (drawing), ())"),
    "unparsed_callouts": sql("reviews", REVIEWED + "SELECT row_no, callout FROM rv WHERE item = 'Pedestal' AND changed AND trim(callout) <> '' AND NOT regexp_matches(callout, " + PEDESTAL + ")"),
    "bank_examples": sql("reviews", REVIEWED + """, pr AS (SELECT *, regexp_extract(callout, '^(P[0-9]{1,2})[(]([0-9]+)x([0-9]+)[)] ([0-9]+)Nos$', ['t', 'l', 'w', 'n']) AS p FROM rv WHERE lower(trim(item)) = 'pedestal' AND reviewed AND drawing_no <> '')
SELECT source, drawing_no, CAST(count(*) FILTER (p.t <> '') AS INT) AS n_pedestals, coalesce(arg_min(verified_by, row_no) FILTER (verified_by <> ''), 'expert review') AS verified_by, string_agg(p.t || ' ' || p.l || 'x' || p.w || ' ' || p.n || ' Nos', '; ' ORDER BY row_no) FILTER (p.t <> '') AS pedestals
FROM pr GROUP BY 1, 2 HAVING NOT bool_or(changed) AND count(*) FILTER (p.t <> '') > 0"""),
    "label_blocks": sql("spans", """, s AS (SELECT drawing_id, page, span_id, x0, y0, x1, y1 FROM spans WHERE trim(text) <> '' AND dir_x >= 0.9),
near AS (SELECT a.span_id AS i, b.span_id AS u, abs(a.y0 - b.y1) AS g FROM s a JOIN s b ON a.drawing_id = b.drawing_id AND a.page = b.page AND a.span_id <> b.span_id AND a.x0 < b.x1 AND a.x1 > b.x0 AND a.y0 - b.y1 BETWEEN -1.0 AND 1.9 * greatest(a.y1 - a.y0, 8.0)),
link AS (SELECT i, arg_min(u, (g, u)) AS u FROM near GROUP BY i), e AS (SELECT i, u FROM link UNION SELECT u, i FROM link), r AS (SELECT DISTINCT i, i AS j FROM e UNION SELECT r.i, e.u FROM r JOIN e ON e.i = r.j), low AS (SELECT i, min(j) AS block FROM r GROUP BY i)
SELECT drawing_id, page, span_id AS line_id, coalesce(low.block, span_id) AS block FROM s LEFT JOIN low ON low.i = s.span_id""").replace("WITH ", "WITH RECURSIVE ", 1),
    "scan_drawings": "WITH f AS (SELECT concat(CASE WHEN o_orderkey % 2 = 0 THEN 'b/' ELSE 'a/' END, 'sheet_', o_orderkey, '.pdf') AS path, concat('sheet_', o_orderkey, '.pdf') AS name, CAST(1 - o_orderkey % 2 AS INT) AS folder_no, sha256(CAST(CAST(floor(o_orderkey / 3.0) AS BIGINT) AS VARCHAR)) AS sha FROM orders WHERE o_orderkey % 13 <> 0) SELECT arg_min(path, (folder_no, path)) AS path, arg_min(name, (folder_no, path)) AS name, min(folder_no) AS folder_no, sha FROM f GROUP BY sha",
    "store_extractions": "SELECT concat('fp', o_orderkey % 997) AS fingerprint, arg_max(o_orderkey, (CAST(floor(o_orderkey / 7.0) AS BIGINT) % 3, o_orderdate, o_orderkey)) AS body FROM orders GROUP BY o_orderkey % 997",
    "read_examples": "SELECT concat('MD-', o_orderkey) AS drawing_no, concat('{\"P1\":\"', o_orderkey % 9 * 100, 'x500\"}') AS verified, concat('eng', o_orderkey % 4) AS verified_by FROM orders WHERE o_orderkey % 3 = 0",
    "write_table": sql("classifications", "SELECT classification, count(*) AS n, min(file_name) AS first FROM classifications GROUP BY 1"),
    "failed_reviews": sql("reviews", "SELECT source, substr(source, 5) || ': no verification rows' AS failure FROM reviews GROUP BY source HAVING NOT bool_or(row_no % 2 = 0) UNION ALL SELECT DISTINCT replace(source, 'review', 'lost'), replace(substr(source, 5), 'review', 'lost') || ': can''t be read' FROM reviews"),
    "dedupe_requests": sql("jobs", "SELECT owner, drawing_path, page, min(position) AS seq FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM jobs x WHERE x.owner = j.owner AND x.drawing_path = j.drawing_path AND x.page = j.page AND x.state IN ('queued', 'running')) GROUP BY 1, 2, 3"),
    "latest_by_drawing": sql("jobs", LATEST + "SELECT drawing_path, page, job_id, state FROM lt WHERE k = 1"),
    "job_summary": sql("jobs", f""", js AS (SELECT owner, count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'cancelled') AS cancelled,
  coalesce(sum(progress_pct / 100) FILTER (state = 'running'), 0) AS part, avg(elapsed_s) FILTER (state = 'done' AND elapsed_s > 0 AND NOT from_cache) AS mean, coalesce(bool_or(state = 'running' AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(heartbeat_at) < 120000000), false) AS worker_alive FROM jobs GROUP BY 1)
SELECT owner, queued, running, done, failed, cancelled, round(100 * (done + failed + part) / (queued + running + done + failed), 1) AS percent, round(mean, 1) AS mean_s, round(mean * (queued + running), 1) AS eta_s, worker_alive FROM js"""),
    "stale_jobs": sql("jobs", f"SELECT job_id, CASE WHEN requeues >= 1 THEN 'failed' ELSE 'requeued' END AS becomes FROM jobs WHERE state = 'running' AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(heartbeat_at) > 900000000"),
    "drawing_status": sql("jobs", STATUS + "SELECT drawing_path, status FROM st"),
    "status_tally": sql("jobs", STATUS + "SELECT status, count(*) AS n, CASE status WHEN 'failed' THEN 1 WHEN 'needs_review' THEN 2 WHEN 'reading' THEN 3 WHEN 'queued' THEN 4 WHEN 'not_read' THEN 5 ELSE 6 END AS rank FROM st GROUP BY 1"),
    "queue_report": sql("jobs", "SELECT owner, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'done' AND from_cache) AS cached, round(coalesce(sum(elapsed_s) FILTER (NOT from_cache), 0), 2) AS model_s FROM jobs GROUP BY 1"),
    "queue_causes": sql("jobs", "SELECT job_id, owner, state, CASE WHEN error = '' THEN '' WHEN lower(error) LIKE 'the file is no longer at%' THEN 'file missing' WHEN lower(error) LIKE '%worker stopped twice%' THEN 'stopped twice' WHEN lower(error) LIKE '%cancel%' THEN 'cancelled' ELSE 'unreadable' END AS cause FROM jobs WHERE state IN ('done', 'failed')"),
    "saved_reading": sql("jobs", ", fl AS (SELECT drawing_path, 'sha' || CAST(min(position) % 3 AS VARCHAR) AS sha FROM jobs GROUP BY 1), dn AS (SELECT *, row_number() OVER (PARTITION BY drawing_path ORDER BY created_at DESC, position DESC, job_id DESC) AS k FROM jobs WHERE state = 'done') SELECT fl.drawing_path, dn.fingerprint FROM fl JOIN dn ON dn.drawing_path = fl.drawing_path AND k = 1 AND dn.content_sha = fl.sha"),
    "cache_hits": sql("jobs", "SELECT *, round(served / greatest(n, 1)::DOUBLE, 4) AS share FROM (SELECT count(*) AS n, count(*) FILTER (position % 4 <> 0 AND fingerprint IN (SELECT fingerprint FROM jobs WHERE state = 'done')) AS served FROM jobs)"),
    "detect_grid": sql("glyphs sheets", """, lb AS (SELECT g.drawing_id, g.page, glyph_id, 'r' AS axis, (y0 + y1) / 2 / height_pt AS v FROM glyphs g JOIN sheets s ON s.drawing_id = g.drawing_id AND s.page = g.page WHERE y1 - y0 BETWEEN 3 AND 30 AND x1 - x0 BETWEEN 1 AND 30 AND (x1 < 0.02 * width_pt OR x0 > 0.98 * width_pt)
  UNION ALL SELECT g.drawing_id, g.page, glyph_id, 'c', (x0 + x1) / 2 / width_pt FROM glyphs g JOIN sheets s ON s.drawing_id = g.drawing_id AND s.page = g.page WHERE y1 - y0 BETWEEN 3 AND 30 AND x1 - x0 BETWEEN 1 AND 30 AND (y1 < 0.02 * height_pt OR y0 > 0.98 * height_pt)),
st AS (SELECT *, v - lag(v) OVER (PARTITION BY drawing_id, page, axis ORDER BY v, glyph_id) > 0.012 AS new FROM lb),
ru AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY drawing_id, page, axis ORDER BY v, glyph_id ROWS UNBOUNDED PRECEDING) AS k FROM st),
ce AS (SELECT drawing_id, page, axis, k, avg(v) AS v, count(*) AS m FROM ru GROUP BY 1, 2, 3, 4),
ga AS (SELECT *, v - lag(v) OVER (PARTITION BY drawing_id, page, axis ORDER BY v) AS gap FROM ce),
ax AS (SELECT drawing_id, page, axis, CAST(round(1 / list_sort(list(gap) FILTER (gap IS NOT NULL))[(count(*) - 1) // 2 + 1]) AS INT) AS n FROM ga GROUP BY 1, 2, 3 HAVING sum(m) >= 4 AND count(*) >= 3 AND list_sort(list(gap) FILTER (gap IS NOT NULL))[(count(*) - 1) // 2 + 1] > 0.005),
bo AS (SELECT drawing_id, page, max(n) FILTER (axis = 'c') AS nc, max(n) FILTER (axis = 'r') AS nr FROM ax WHERE n BETWEEN 4 AND 40 GROUP BY 1, 2)
SELECT s.drawing_id, s.page, CASE WHEN nc IS NULL OR nr IS NULL THEN 16 ELSE nc END AS columns, CASE WHEN nc IS NULL OR nr IS NULL THEN 16 ELSE nr END AS rows, nc IS NOT NULL AND nr IS NOT NULL AS detected FROM sheets s LEFT JOIN bo ON bo.drawing_id = s.drawing_id AND bo.page = s.page"""),
    "fold_job_state": sql("job_events", """, ev AS (SELECT job_id, list({'ts': ts, 'event': event, 'pct': progress_pct, 'fc': from_cache, 'err': error, 'state': 'none', 'beat': NULL::TIMESTAMP, 'el': NULL::DOUBLE, 'n': 1} ORDER BY ts, event_id) AS l FROM job_events GROUP BY 1),
fo AS (SELECT job_id, list_reduce(l, lambda a, e: {
  'ts': CASE WHEN e.event = 'start' THEN e.ts WHEN e.event = 'retry' AND a.state IN ('failed', 'cancelled') THEN NULL ELSE a.ts END, 'event': '',
  'pct': CASE WHEN e.event IN ('enqueue', 'start') OR (e.event = 'retry' AND a.state IN ('failed', 'cancelled')) THEN 0 WHEN e.event = 'heartbeat' THEN greatest(least(e.pct, 100), 0) WHEN e.event = 'finish' THEN 100 ELSE a.pct END,
  'fc': CASE WHEN e.event = 'finish' THEN coalesce(e.fc, false) WHEN e.event = 'retry' AND a.state IN ('failed', 'cancelled') THEN false ELSE a.fc END,
  'err': CASE WHEN e.event = 'fail' THEN left(coalesce(e.err, ''), 2000) WHEN e.event = 'retry' AND a.state IN ('failed', 'cancelled') THEN '' ELSE a.err END,
  'state': CASE e.event WHEN 'enqueue' THEN 'queued' WHEN 'start' THEN 'running' WHEN 'finish' THEN 'done' WHEN 'fail' THEN 'failed' WHEN 'cancel' THEN 'cancelled' WHEN 'retry' THEN CASE WHEN a.state IN ('failed', 'cancelled') THEN 'queued' ELSE a.state END ELSE a.state END,
  'beat': CASE WHEN e.event IN ('start', 'heartbeat') THEN e.ts WHEN e.event = 'retry' AND a.state IN ('failed', 'cancelled') THEN NULL ELSE a.beat END,
  'el': CASE WHEN e.event IN ('finish', 'fail') AND a.ts IS NOT NULL THEN (epoch_us(e.ts) - epoch_us(a.ts)) / 1000000 WHEN e.event = 'retry' AND a.state IN ('failed', 'cancelled') THEN NULL ELSE a.el END, 'n': a.n + 1},
  {'ts': NULL::TIMESTAMP, 'event': '', 'pct': 0.0::DOUBLE, 'fc': false, 'err': '', 'state': 'none', 'beat': NULL::TIMESTAMP, 'el': NULL::DOUBLE, 'n': 0}) AS s FROM ev)
SELECT job_id, s.state AS state, s.pct AS progress_pct, epoch_us(s.ts) AS started_us, epoch_us(s.beat) AS heartbeat_us, round(coalesce(s.el, 0), 3) AS elapsed_s, s.err AS error, s.fc AS from_cache, CAST(s.n AS INT) AS n_events FROM fo"""),
    "verification_rows": sql("projects sightings elements marks lines", CHECKS + "SELECT drawing_id, number, kind, label, extracted, note, '' AS corrected, '' AS verified_by FROM ck"),
    "ordered_evidence": sql("projects sightings elements marks lines", CHECKS + "SELECT drawing_id, number, row_number() OVER (PARTITION BY drawing_id ORDER BY NOT boxed, number) AS rank, boxed FROM ck"),
    "traceable_evidence": sql("projects sightings elements marks lines", CHECKS + "SELECT drawing_id, number, kind FROM ck WHERE boxed"),
    "evidence_counts": sql("projects sightings elements marks lines", CHECKS + "SELECT drawing_id, CASE WHEN regexp_matches(lower(note), 'not on drawing|not stated|not extracted|incomplete on the drawing|placeholder') THEN 'incomplete' WHEN CAST(drawing_id AS BIGINT) % 3 = 0 THEN 'exact' ELSE 'model' END AS source, count(*) AS n FROM ck GROUP BY 1, 2"),
    "title_blocks": sql("projects", ", tb AS (SELECT drawing_id, CASE WHEN revision <> '' THEN drawing_no ELSE '' END AS drawing_no, revision, CASE WHEN CAST(drawing_id AS BIGINT) % 3 = 0 THEN '' ELSE strftime(created_at, '%Y-%m-%d') END AS date, CASE WHEN CAST(drawing_id AS BIGINT) % 2 = 0 THEN project_name ELSE '' END AS project_name FROM projects) SELECT *, CASE WHEN (drawing_no <> '')::INT + (revision <> '')::INT + (date <> '')::INT + (project_name <> '')::INT >= 3 THEN 'high' WHEN (drawing_no <> '')::INT + (revision <> '')::INT + (date <> '')::INT + (project_name <> '')::INT = 2 THEN 'medium' ELSE 'low' END AS confidence FROM tb"),
    "reply_pedestals": sql("lines", LINES + REPLIES + "SELECT drawing_id, seq, tag, length_mm, width_mm, height_mm, quantity, validated, disagrees FROM rp WHERE reason IS NULL"),
    "reply_rejects": sql("lines", LINES + REPLIES + "SELECT drawing_id, seq, tag, reason FROM rp WHERE reason IS NOT NULL"),
    "reply_slabs": sql("lines", """, sl AS (SELECT drawing_id, 'GS-01' AS tag, 1000.0::DOUBLE * (line_no - 1) AS length_mm, 3000.0::DOUBLE AS width_mm, CASE WHEN text LIKE 'TOC%' THEN 250.0::DOUBLE ELSE TRY_CAST(regexp_extract(text, '(\\d{2,4})\\s*THK', 1) AS DOUBLE) END AS thickness_mm, regexp_extract(text, 'TOC\\s*EL\\.?\\s*(\\d+\\.\\d+)', 1) AS toc_level, 'medium' AS confidence FROM lines WHERE text LIKE '%GRADE SLAB' OR text LIKE 'TOC%'),
ch AS (SELECT *, CASE WHEN NOT length_mm BETWEEN 500 AND 500000 THEN 'length_mm' WHEN NOT width_mm BETWEEN 500 AND 500000 THEN 'width_mm' WHEN thickness_mm IS NULL OR NOT thickness_mm BETWEEN 75 AND 2000 THEN 'thickness_mm' END AS bad FROM sl)
SELECT * EXCLUDE (bad), bad IS NULL AS usable, coalesce(bad, CASE WHEN length_mm < width_mm THEN 'length < width' ELSE '' END) AS reason FROM ch"""),
    "seeded_rules": sql("lines", LINES + """, fi AS (SELECT drawing_id, arg_min(f1, line_no) FILTER (kind = 'curb_wall') AS ct, arg_min(f2, line_no) FILTER (kind = 'curb_wall') AS chh, arg_min(f1, line_no) FILTER (kind = 'epoxy') AS ep, arg_min(f1, line_no) FILTER (kind = 'blinding') AS bl FROM seen WHERE k = 1 AND kind IN ('curb_wall', 'epoxy', 'blinding') GROUP BY 1),
du(rule_key, param, value) AS (VALUES %s)
SELECT drawing_id, rule_key, param, CASE WHEN rule_key = 'curb' AND param = 'thickness_m' THEN coalesce(round(ct / 1000, 3), value) WHEN rule_key = 'curb' AND param = 'height_m' THEN coalesce(round(chh / 1000, 3), value) WHEN rule_key = 'epoxy' AND param = 'thickness_mm' THEN coalesce(ep, value) WHEN (rule_key = 'blinding' AND param = 'thickness_m') OR (rule_key = 'excavation' AND param = 'blinding_thickness_m') THEN coalesce(round(bl / 1000, 3), value) ELSE value END AS value FROM fi, du""" % ", ".join(f"('{k}', '{n}', {float(v)}::DOUBLE)" for k, ps in derive.RULES.items() for n, v in ps.items())),
    "typed_elements": sql("elements", TYPED + "SELECT drawing_id, tag, length_m, width_m, height_m, quantity, CASE WHEN pos % 2 = 0 THEN 'RCC_M30' ELSE grade END AS grade, CASE WHEN pos % 3 = 0 THEN 120.0 ELSE 90.0 END::DOUBLE AS rebar_coefficient FROM ty WHERE reason IS NULL"),
    "typed_rejects": sql("elements", TYPED + "SELECT drawing_id, tag, reason FROM ty WHERE reason IS NOT NULL"),
    "ingested_reviews": sql("reviews", REVIEWED + ", rw AS (SELECT *, CASE WHEN drawing_no = '' THEN regexp_replace(split_part(source, '/', -1), '\\.[^.]*$', '') ELSE drawing_no END AS drawing FROM rv WHERE reviewed) SELECT 'accuracy' AS what, coalesce(item, drawing, 'all') AS name, count(*) AS n FROM rw GROUP BY GROUPING SETS ((item), (drawing), ()) UNION ALL SELECT 'look at', callout, row_no FROM rv WHERE item = 'Pedestal' AND changed AND trim(callout) <> '' AND NOT regexp_matches(callout, " + PEDESTAL + ") UNION ALL SELECT 'example', drawing_no, count(*) FILTER (regexp_matches(callout, " + PEDESTAL + ")) FROM rv WHERE item = 'Pedestal' AND reviewed AND drawing_no <> '' GROUP BY source, drawing_no HAVING NOT bool_or(changed) AND count(*) FILTER (regexp_matches(callout, " + PEDESTAL + ")) > 0"),
}
