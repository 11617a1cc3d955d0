"""Takeoff tables derived from the star-schema tables by SQL that Spark and DuckDB both run.

Each entry is a query over {base} tables and earlier entries; a query and its oracle start from the same rows.
Rows of an order get their position by a window over the order alone, so nothing is numbered globally.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.frames import more_parts
from plumbline.functions.numbers import tolerant

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SYNTH: dict[str, str] = {
    "elements": """
SELECT CAST(l.l_orderkey AS STRING) AS drawing_id, CAST((l.l_partkey + l.l_linenumber) % 15 AS INT) AS kind_no,
  CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus) AS INT) AS pos,
  concat('P', CAST(l.l_partkey % 99 + 1 AS STRING)) AS tag,
  (p.p_size + 5) / 1e1 AS length_m, (l.l_quantity + 4) / 1e1 AS width_m,
  CASE WHEN l.l_discount < 3e-2 THEN 8e-1 ELSE round(5e-1 + l.l_tax * 1e1, 3) END AS height_m,
  round(15e-1 + l.l_tax * 1e1, 3) AS depth_m, round(1e-1 + l.l_tax * 5e0, 3) AS thickness_m, 15e-1 AS thickness_mm,
  CAST(l.l_quantity AS INT) AS quantity,
  CASE p.p_size % 3 WHEN 0 THEN 'RCC_M30' WHEN 1 THEN 'RCC_M25' ELSE 'PCC_M15' END AS grade,
  CASE WHEN l.l_returnflag = 'R' THEN 'rock' ELSE 'ordinary' END AS soil_type,
  CASE WHEN l.l_linestatus = 'O' AND l.l_returnflag = 'A' THEN 0e0 WHEN l.l_linestatus = 'O' THEN 12e1 ELSE 8e1 END AS rebar_coefficient,
  l.l_returnflag = 'A' AS has_top_formwork, 2e-1 AS wall_thickness_m, 25e-2 AS base_thickness_m,
  round(l.l_extendedprice / 1e2, 3) AS area_m2, round(l.l_extendedprice / 1e3, 3) AS volume_m3,
  CASE WHEN l.l_returnflag = 'N' THEN NULL ELSE p.p_type END AS description,
  concat('Pedestal P', CAST(l.l_suppkey % 9 + 1 AS STRING)) AS parent_element,
  CASE p.p_size % 10 WHEN 0 THEN 6 WHEN 1 THEN 8 WHEN 2 THEN 10 WHEN 3 THEN 12 WHEN 4 THEN 16 WHEN 5 THEN 20 WHEN 6 THEN 25 WHEN 7 THEN 28 WHEN 8 THEN 32 ELSE 40 END AS diameter_mm,
  (p.p_size + 9) / 1e1 AS cut_length_m, CAST(l.l_linenumber + 3 AS INT) AS nos_per_element, CAST(l.l_suppkey % 5 + 1 AS INT) AS parent_quantity, CAST(l.l_linenumber % 3 + 1 AS INT) AS coats,
  CASE WHEN l.l_returnflag = 'R' THEN 'expansion' ELSE 'contraction' END AS joint_type,
  l.l_linestatus = 'O' AS has_waterstop, l.l_returnflag <> 'N' AS has_sealant, l.l_returnflag = 'R' AS has_backer_rod,
  CASE WHEN l.l_returnflag = 'R' THEN 'anchor_bolt' ELSE 'insert_plate' END AS embedment_type, p.p_brand AS size_description,
  CASE WHEN l.l_linestatus = 'O' THEN round(l.l_tax * 1e2 + 1e0, 2) END AS unit_weight_kg, 'PVC' AS material, 2e2 AS width_mm,
  CASE WHEN l.l_returnflag = 'A' THEN 'drain_pipe' ELSE 'sump_pump' END AS item_type
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey""",
    "projects": """
SELECT CAST(o.o_orderkey AS STRING) AS drawing_id, concat('Plant ', c.c_name) AS project_name,
  concat('MD-522-', CAST(1000 + o.o_custkey % 500 AS STRING), '-EG-CV-', CAST(1000 + o.o_orderkey % 4000 AS STRING)) AS drawing_no,
  CASE WHEN o.o_orderstatus = 'O' THEN 'C01' WHEN o.o_orderstatus = 'F' THEN 'B02' ELSE '' END AS revision,
  3e0 + o.o_custkey % 3 AS wastage_concrete, 5e0 AS wastage_rebar, 1e1 AS wastage_formwork, 8e0 AS wastage_hdpe, 15e0 AS wastage_epoxy, 5e0 AS wastage_pcc, 1e1 AS wastage_soil,
  concat('folder', CAST(o.o_custkey % 7 AS STRING), '/sheet_', CAST(o.o_orderkey AS STRING), '.pdf') AS path, o.o_orderdate AS created_at
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    "rates": """
SELECT category, unit, rate, seq FROM (
  SELECT CASE p_size % 8 WHEN 0 THEN 'Structural Concrete' WHEN 1 THEN 'Formwork' WHEN 2 THEN 'Earthwork' WHEN 3 THEN 'Rebar (coefficient)' WHEN 4 THEN 'Joints' WHEN 5 THEN 'HDPE Liner' WHEN 6 THEN 'PCC / Blinding' ELSE 'Embedments' END AS category,
    CASE p_size % 8 WHEN 0 THEN 'm3' WHEN 1 THEN 'm2' WHEN 2 THEN 'm3' WHEN 3 THEN 'kg' WHEN 4 THEN 'm' WHEN 5 THEN 'm2' WHEN 6 THEN 'm3' ELSE 'Nos' END AS unit,
    round(p_retailprice / 1e1, 2) AS rate, p_partkey AS seq FROM {part}) x""",
    "classifications": """
SELECT concat('sheet_', CAST(o_orderkey AS STRING), '.pdf') AS file_name, o_orderkey AS seq,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Brown Field' WHEN '2-HIGH' THEN 'Repair' WHEN '3-MEDIUM' THEN 'Green Field' ELSE 'Unknown' END AS classification
FROM {orders} WHERE o_orderkey % 4 <> 0""",
    "items": """
SELECT CAST(l_orderkey AS STRING) AS drawing_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS INT) AS seq,
  CASE l_partkey % 5 WHEN 0 THEN 'box3' WHEN 1 THEN 'box2' WHEN 2 THEN 'thickness' WHEN 3 THEN 'rebar' ELSE 'diameter' END AS kind,
  CASE l_suppkey % 4 WHEN 0 THEN 'Grout' WHEN 1 THEN 'Manhole' WHEN 2 THEN 'Bitumen Screed' ELSE 'Weep Holes' END AS description,
  CASE l_partkey % 5 WHEN 0 THEN 'm3' WHEN 1 THEN 'm2' WHEN 2 THEN 'm2' WHEN 3 THEN 'Nos' ELSE 'Nos' END AS uom,
  CASE WHEN l_partkey % 5 IN (0, 1, 3) THEN round(l_quantity / 4e0, 3) END AS qty,
  CASE WHEN l_partkey % 5 IN (0, 1) THEN 'size printed' WHEN l_partkey % 5 = 3 THEN 'count printed' ELSE 'extent not stated' END AS basis,
  (l_suppkey % 50 + 5) * 1e2 AS dim_a, (l_quantity + 4) * 1e2 AS dim_b, concat(CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END, '-', CAST(l_suppkey % 8 + 1 AS STRING)) AS grid_ref
FROM {lineitem} WHERE l_partkey % 3 = 0""",
    "marks": """
SELECT CAST(l_orderkey AS STRING) AS drawing_id, concat(CASE WHEN l_suppkey % 2 = 0 THEN 'P' ELSE 'F' END, CAST(l_partkey % 12 + 1 AS STRING)) AS mark, CAST(count(*) AS INT) AS n
FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY 1, 2""",
    "lines": """
SELECT CAST(l.l_orderkey AS STRING) AS drawing_id, 0 AS page, CAST(l.l_suppkey % 3 AS BIGINT) AS block_id,
  CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus) AS INT) AS line_no,
  CASE l.l_partkey % 20
    WHEN 0 THEN concat('PEDESTAL P', CAST(l.l_suppkey % 12 + 1 AS STRING), '(', CAST(100 * (p.p_size % 9 + 1) AS STRING), 'x', CAST(100 * (l.l_linenumber + 1) AS STRING), ') ', CAST(CAST(l.l_quantity AS INT) AS STRING), ' Nos')
    WHEN 1 THEN concat('P', CAST(l.l_suppkey % 12 + 1 AS STRING), ' [600 X 500x', CAST(100 * (p.p_size % 9 + 1) AS STRING), '] - ', CAST(CAST(l.l_quantity AS INT) AS STRING), 'NOS')
    WHEN 2 THEN concat('CURB  WALL 150THK x ', CAST(100 + 50 * (p.p_size % 4) AS STRING), 'HIGH') WHEN 3 THEN concat('SUMP PIT ', CAST(900 + 100 * l.l_linenumber AS STRING), ' x 1200')
    WHEN 4 THEN concat('TOC EL 97.', CAST(100 + p.p_size AS STRING), ' FGL EL. 96.500') WHEN 5 THEN concat('INSERT PLATE TYPE A', CAST(l.l_linenumber AS STRING), ' a')
    WHEN 6 THEN concat(CAST(l.l_linenumber AS STRING), 'MM THK ACID RESISTANT EPOXY') WHEN 7 THEN concat('(', CAST(l.l_linenumber AS STRING), ')-D', CAST(10 + p.p_size % 7 AS STRING), ' CLOSED LINK')
    WHEN 8 THEN concat('D16 @ ', CAST(100 + 50 * l.l_linenumber AS STRING), ' c/c') WHEN 9 THEN concat('(', CAST(100 * l.l_linenumber AS STRING), ' THK) GRADE SLAB')
    WHEN 10 THEN concat(CAST(50 * l.l_linenumber AS STRING), ' THK BLINDING') WHEN 11 THEN 'SECTION A-A' WHEN 12 THEN concat(CAST(10 * l.l_linenumber AS STRING), ' THK GROUT')
    WHEN 13 THEN concat('MANHOLE 1200x1200x', CAST(100 * (p.p_size + 2) AS STRING)) WHEN 14 THEN '95% COMPACTED SOIL'
    WHEN 15 THEN concat('BOBP EL. 98.', CAST(300 + p.p_size AS STRING)) WHEN 16 THEN concat('BOC EL. 95.', CAST(500 + l.l_linenumber AS STRING))
    WHEN 17 THEN 'GRADE C35 CONCRETE WITH 35 MPa' WHEN 18 THEN concat('AR-(', CAST(l.l_linenumber AS STRING), ')-B-M36-1345-N2') ELSE '25mm DIA WEEP HOLES' END AS text,
  CASE WHEN l.l_returnflag = 'N' THEN '' ELSE concat('B-', CAST(l.l_suppkey % 6 + 1 AS STRING)) END AS grid_ref
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey""",
    "callouts": """
SELECT CAST(l_orderkey AS STRING) AS drawing_id, 0 AS page, CAST(l_suppkey % 2 AS BIGINT) AS block_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS INT) AS line_no,
  CASE l_partkey % 26
    WHEN 0 THEN 'MANHOLE 1200x1200x1800 DEEP CHAMBER' WHEN 1 THEN 'PIT 1200x1200x1800 WITH 30 THK GROUT' WHEN 2 THEN '30 THK GROUT UNDER 600x500 PLATE' WHEN 3 THEN 'BACKFILL COMPACTED 95%' WHEN 4 THEN '(2 Nos./SET)'
    WHEN 5 THEN concat(CAST(8 * (l_suppkey % 3 + 1) AS STRING), '-D25') WHEN 6 THEN concat(CAST(l_linenumber AS STRING), 'MM THK ACID RESISTANT') WHEN 7 THEN 'EPOXY COATING (TYP)' WHEN 8 THEN 'TYP DETAIL OF PEDESTAL' WHEN 9 THEN 'P1(600x500) 2Nos'
    WHEN 10 THEN concat('20mm  DIA  LUGS AND ', CAST(10 * l_linenumber AS STRING), ' DIA. ANCHOR BARS') WHEN 11 THEN 'D10-100 LINKS (2 Nos./SET)' WHEN 12 THEN 'KERB 300x450' WHEN 13 THEN 'IP 20mm THK' WHEN 14 THEN concat('90% COMPACTED CRUSHED AGGREGATE ', CAST(l_linenumber AS STRING), 'M')
    WHEN 15 THEN '1200 x 3100' WHEN 16 THEN 'SECTION A-A' WHEN 17 THEN 'AR-(4)-B-M36-1345-N2, ar-(2)-c-M20-900-N1' WHEN 18 THEN 'acid resistant' WHEN 19 THEN '95% COMPACTED SOIL' WHEN 20 THEN 'SLEEVE Dia NOS./SET 40x40 450x300 BASE 25 THK' WHEN 21 THEN 'ANCHOR PLATE GS-01 250x250 20 THK. MILD STEEL FOR P12 STUB'
    WHEN 22 THEN 'MD-522-8110-EG-CV-LAD-0101' WHEN 23 THEN ' 16-D25  TOP ; (3)-D10 @150 ' WHEN 24 THEN '1.5MM THK HDPE LINER 2.50 THICK GEOTEXTILE' ELSE 'GENERAL NOTE THAT RUNS ON AND ON WITH MORE THAN FOURTEEN BLANKS SO THAT NOBODY TAKES THE 30 THK GROUT IN IT FOR ANY ITEM AT ALL' END AS text,
  CASE WHEN l_returnflag = 'N' THEN '' ELSE concat('B-', CAST(l_suppkey % 6 + 1 AS STRING)) END AS grid_ref
FROM {lineitem}""",
    "spans": """
SELECT CAST(CAST(floor(l_orderkey / 4e1) AS BIGINT) AS STRING) AS drawing_id, CAST(l_suppkey % 2 AS INT) AS page,
  l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS span_id,
  CASE WHEN l_partkey % 9 = 0 THEN concat('P', CAST(l_suppkey % 9 + 1 AS STRING)) WHEN l_partkey % 9 = 1 THEN concat('MD-522-', CAST(1000 + l_suppkey AS STRING)) WHEN l_partkey % 9 = 2 THEN ' ' ELSE concat('LABEL ', CAST(l_partkey % 100 AS STRING), ' NEAR GRID LINE') END AS text,
  floor(l_extendedprice) % 1000 * 1e0 AS x0, 12e0 * (l_partkey % 80) + l_linenumber / 4e0 AS y0, floor(l_extendedprice) % 1000 + 40e0 AS x1, 12e0 * (l_partkey % 80) + l_linenumber / 4e0 + 10e0 AS y1,
  8e0 AS size, CASE WHEN l_returnflag = 'R' AND l_partkey % 4 = 0 THEN 0e0 ELSE 1e0 END AS dir_x
FROM {lineitem}""",
    "sheets": """
SELECT CAST(d AS STRING) AS drawing_id, CAST(g AS INT) AS page, concat('MD-522-', CAST(1000 + d AS STRING), '_C01.pdf') AS file_name, 1200e0 AS width_pt, 1000e0 AS height_pt
FROM (SELECT DISTINCT CAST(floor(l_orderkey / 4e1) AS BIGINT) AS d FROM {lineitem}) a CROSS JOIN (SELECT DISTINCT l_suppkey % 2 AS g FROM {lineitem}) b""",
    "glyphs": """
SELECT CAST(CAST(floor(l_orderkey / 4e1) AS BIGINT) AS STRING) AS drawing_id, CAST(l_suppkey % 2 AS INT) AS page, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS glyph_id,
  CASE WHEN l_suppkey % 5 = 4 THEN 4e0 ELSE (l_partkey % 10) * 12e1 + 5e1 + l_linenumber / 1e1 END AS x0, CASE WHEN l_suppkey % 5 = 4 THEN (l_partkey % 12) * 8e1 + 5e1 WHEN l_suppkey % 3 = 0 THEN 4e0 ELSE 4e1 + floor(l_extendedprice) % 900 END AS y0,
  CASE WHEN l_suppkey % 5 = 4 THEN 4e0 ELSE (l_partkey % 10) * 12e1 + 5e1 + l_linenumber / 1e1 END + 6e0 + l_quantity / 1e1 AS x1, CASE WHEN l_suppkey % 5 = 4 THEN (l_partkey % 12) * 8e1 + 5e1 WHEN l_suppkey % 3 = 0 THEN 4e0 ELSE 4e1 + floor(l_extendedprice) % 900 END + 2e0 + l_quantity / 4e0 AS y1
FROM {lineitem}""",
    "sightings": """
SELECT CAST(l_orderkey AS STRING) AS drawing_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS INT) AS seq,
  concat('P', CAST(l_partkey % 3 + 1 AS STRING)) AS tag, 1e2 * (l_linenumber % 2 + 5) AS length_mm, 5e2 AS width_mm, CAST(l_suppkey % 2 + 2 AS INT) AS quantity, l_returnflag <> 'N' AS validated,
  concat('r', CAST(l_suppkey % 4 AS STRING), 'c0') AS region, CASE WHEN l_linestatus = 'O' THEN concat('A-', CAST(l_suppkey % 3 + 1 AS STRING)) ELSE '' END AS grid_ref
FROM {lineitem}""",
    "replies": """
SELECT CAST(o_orderkey AS STRING) AS drawing_id, o_orderkey % 3 AS montage,
  CASE o_orderkey % 5 WHEN 0 THEN '[" P1(600x500) 2Nos ", ""]' WHEN 1 THEN '{{"crops":[{{"id":1,"lines":["A"]}},{{"id":2,"lines":[" ","B"]}}]}}' WHEN 2 THEN '{{"crops":[{{"id":"x","lines":["C"]}},{{"lines":["D","E"]}}]}}' WHEN 3 THEN 'not json' ELSE '{{"crops":[{{"id":9,"lines":[]}}]}}' END AS reply
FROM {orders}""",
    "jobs": """
SELECT concat('j', CAST(o_orderkey AS STRING)) AS job_id, concat('u', CAST(o_custkey % 5 AS STRING)) AS owner, concat('f', CAST(o_custkey AS STRING), '.pdf') AS drawing_path, CAST(o_orderkey % 2 AS INT) AS page,
  CASE o_orderkey % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' WHEN 3 THEN 'cancelled' ELSE 'done' END AS state, o_orderdate AS created_at, o_orderkey AS position,
  CASE WHEN o_orderkey % 7 = 1 THEN o_orderkey % 100 * 1e0 ELSE 0e0 END AS progress_pct, round(o_totalprice / 1e3, 2) AS elapsed_s, o_orderkey % 3 = 0 AS from_cache, CAST(o_orderkey % 2 AS INT) AS requeues, o_orderdate AS heartbeat_at,
  CASE o_orderkey % 4 WHEN 0 THEN 'The file is no longer at x' WHEN 1 THEN 'worker stopped twice' WHEN 2 THEN 'Cancelled by user' ELSE '' END AS error,
  concat('fp', CAST(o_custkey AS STRING)) AS fingerprint, concat('sha', CAST(o_custkey % 3 AS STRING)) AS content_sha
FROM {orders}""",
    "job_events": """
SELECT event_id, ts, concat('j', CAST(user_id AS STRING)) AS job_id, concat('u', CAST(user_id % 5 AS STRING)) AS owner, concat('f', CAST(user_id AS STRING)) AS drawing_path, 0 AS page,
  CASE event_type WHEN 'view' THEN 'enqueue' WHEN 'signup' THEN 'start' WHEN 'click' THEN 'heartbeat' WHEN 'purchase' THEN 'finish' ELSE 'fail' END AS event, value AS progress_pct, event_id % 3 = 0 AS from_cache, concat('error ', CAST(event_id AS STRING)) AS error
FROM {events}""",
    "reviews": """
SELECT concat('set/review_', d.source, '.xlsx') AS source, CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE concat('MD-', d.source) END AS drawing_no, CAST(d.doc_id AS INT) AS row_no,
  CASE d.doc_id % 3 WHEN 0 THEN 'Pedestal' WHEN 1 THEN 'Level' ELSE 'Rebar' END AS item, concat('P', CAST(d.doc_id % 9 + 1 AS STRING)) AS tag, CAST(d.n_chars AS STRING) AS extracted,
  CASE WHEN d.doc_id % 2 = 0 THEN 'P1(600x500) 2Nos' ELSE 'P1 600 by 500' END AS callout,
  CASE WHEN l.quality = 0 THEN CAST(d.n_chars + 1 AS STRING) WHEN d.doc_id % 4 = 0 THEN concat(' ', CAST(d.n_chars AS STRING), '.0 ') ELSE '' END AS corrected, CASE WHEN l.toxic = 0 AND d.doc_id % 2 = 0 THEN concat('eng', CAST(d.doc_id % 3 AS STRING)) ELSE '' END AS verified_by
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    "levels": """
SELECT CAST(s_suppkey * 4 AS STRING) AS drawing_id, CASE s_suppkey % 4 WHEN 0 THEN 'TOC' WHEN 1 THEN 'BOC' WHEN 2 THEN 'BOBP' ELSE 'NGL' END AS kind, round(9e1 + s_acctbal / 1e3, 3) AS level_m FROM {supplier}
UNION ALL SELECT CAST(CAST(floor(p_partkey / 5e0) AS BIGINT) AS STRING), CASE p_partkey % 3 WHEN 0 THEN 'TOS' WHEN 1 THEN 'FGL' ELSE 'FFL' END, round(9e1 + p_size / 1e1, 3) FROM {part}""",
}
SYNTH = {name: tolerant(text) for name, text in SYNTH.items()}
#: Tables whose rows are numbered within the order that their drawing_id names.
BY_DRAWING = ("elements", "items", "lines", "callouts", "sightings")
NUMBER = re.compile(r"row_number\(\) OVER \(PARTITION BY (?:l\.)?l_orderkey (ORDER BY [^)]*)\)")


def dealt_by_drawing(text: str, parts: int | None = None) -> str:
    """The same rows for Spark, numbered before they are made up.

    The window is dealt by drawing_id and not by the number that it is written from, so its shuffle and order serve later joins and
    groups by drawing as well, and it carries the columns as given rather than those made from them. With parts they are dealt into so many.
    """
    bare = lambda s: re.sub(r"\b[lp]\.(?=[lp]_)", "", s)
    head, rows = text.rsplit("\nFROM ", 1)
    order = bare(NUMBER.search(head)[1])
    head = bare(NUMBER.sub("row_no", head)).replace("CAST(l_orderkey AS STRING)", "drawing_key")
    hint = f"/*+ REPARTITION({parts}, drawing_key) */ " if parts else ""
    return f"{head}\nFROM (SELECT *, row_number() OVER (PARTITION BY drawing_key {order}) AS row_no FROM (SELECT {hint}*, CAST(l_orderkey AS STRING) AS drawing_key FROM {rows}) keyed) numbered"


def needs(name: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", SYNTH[name])))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or a table of SYNTH with those it needs."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    given = {n: table(spark, sf_dir, n) for n in needs(name)}
    if name not in BY_DRAWING:
        return spark.sql(SYNTH[name], **given)
    parts = more_parts(spark, given["lineitem"].count())
    if parts and "part" in given:
        # where the parts are too many to be broadcast, the rows are dealt to them in as many parts as by drawing
        given["part"] = given["part"].repartition(parts, "p_partkey")
    return spark.sql(dealt_by_drawing(SYNTH[name], parts), **given)


def with_tables(*names: str) -> str:
    """A WITH clause (without what follows) that defines tables of SYNTH for an oracle."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in SYNTH and name not in order:
            for n in needs(name):
                add(n)
            order.append(name)

    for name in names:
        add(name)
    plain = lambda n: re.sub(r"[{](\w+)[}]", r"\1", SYNTH[n]).replace("{{", "{").replace("}}", "}")
    return "WITH " + ",\n".join(f"{n} AS ({plain(n)})" for n in order)
