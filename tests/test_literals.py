"""Literal expectations of the takeoff operators."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import bill, derive, discovery, geometry, grammar, reconcile, setviews, telemetry, verify
from plumbline.sources import stores, versions

WASTE = ", ".join(f"{v} as wastage_{k}" for k, v in (("concrete", "3d"), ("rebar", "5d"), ("formwork", "10d"), ("hdpe", "8d"), ("epoxy", "15d"), ("pcc", "5d"), ("soil", "10d")))
COLUMNS = (
    "drawing_id string, kind_no int, pos int, tag string, length_m double, width_m double, height_m double, depth_m double, thickness_m double, thickness_mm double, quantity int, grade string, soil_type string, rebar_coefficient double,"
    "has_top_formwork boolean, wall_thickness_m double, base_thickness_m double, area_m2 double, volume_m3 double, description string, parent_element string, diameter_mm int, cut_length_m double, nos_per_element int, parent_quantity int, coats int,"
    "joint_type string, has_waterstop boolean, has_sealant boolean, has_backer_rod boolean, embedment_type string, size_description string, unit_weight_kg double, material string, width_mm double, item_type string"
)


def elements(spark, *rows):
    names = [x.split()[0] for x in COLUMNS.split(",")]
    return spark.createDataFrame([tuple({"drawing_id": "d", "pos": i, "tag": "T", **r}.get(n) for n in names) for i, r in enumerate(rows)], COLUMNS)


@pytest.fixture(scope="module")
def mini(spark):
    els = elements(
        spark,
        dict(kind_no=2, tag="P1", length_m=0.6, width_m=0.5, height_m=0.8, quantity=2, grade="RCC_M30", rebar_coefficient=120.0),
        dict(kind_no=3, tag="GS-01", length_m=20.0, width_m=10.0, thickness_m=0.25, grade="RCC_M30", rebar_coefficient=80.0, has_top_formwork=False),
        dict(kind_no=4, tag="SP-01", length_m=2.0, width_m=2.0, depth_m=1.5, wall_thickness_m=0.2, base_thickness_m=0.25, grade="RCC_M30", rebar_coefficient=0.0),
        dict(kind_no=0, tag="EXC-01", length_m=10.0, width_m=5.0, depth_m=2.0, quantity=1, soil_type="soil"),
        dict(kind_no=1, tag="PCC-01", length_m=5.0, width_m=3.0, thickness_m=0.1, quantity=1, grade="PCC_M15"),
        dict(kind_no=10, tag="EP-01", area_m2=250.0, coats=2, thickness_mm=4.0),
        dict(kind_no=11, tag="EJ-01", length_m=25.5, joint_type="expansion", has_waterstop=True, has_sealant=False, has_backer_rod=False),
        dict(kind_no=7, tag="B1", cut_length_m=2.0, nos_per_element=8, parent_quantity=2, diameter_mm=16, parent_element="Pedestal P1"),
        dict(kind_no=6, tag="LF", area_m2=0.0625, description=""),
    )
    return els, spark.sql(f"select 'd' as drawing_id, 'MD-1' as drawing_no, {WASTE}")


def test_bill(mini):
    lines = {(r.source_tag, r.category, r.sub): r for r in bill.element_bill(*mini).collect()}
    p1 = lines["P1", "Structural Concrete", 0]
    assert (p1.qty_net, p1.qty_gross, p1.item) == (0.48, 0.494, "RCC_M30 - Pedestal P1")
    assert lines["P1", "Formwork", 1].qty_net == 3.52 and lines["P1", "Rebar (coefficient)", 2].qty_net == 57.6
    assert lines["GS-01", "Structural Concrete", 0].qty_net == 50.0 and lines["GS-01", "Formwork", 1].qty_net == 15.0
    assert lines["EXC-01", "Earthwork", 0].qty_gross == 100.0 and lines["PCC-01", "PCC / Blinding", 0].qty_net == 1.5
    assert (lines["EP-01", "Epoxy Coating", 0].qty_net, lines["EP-01", "Epoxy Coating", 0].qty_gross) == (500.0, 575.0)
    assert lines["EJ-01", "Joint accessories", 1].item == "Waterstop for EJ-01" and ("EJ-01", "Joint accessories", 2) not in lines
    assert ("SP-01", "Rebar (coefficient)", 2) not in lines and lines["LF", "Formwork", 0].qty_net == 0.063
    assert [r.tag for r in bill.double_count_warnings(mini[0]).collect()] == ["P1"]
    bars = {r.bar_mark: r for r in bill.rebar_schedule(*mini).collect()}
    assert bars["B1"].nos == 16 and bars["B1"].weight_kg == 50.5 and bars["COEFF"].diameter_mm is None
    bom = bill.build_bom(*mini).where("category = 'ROLLUP'").collect()
    assert {r["item"] for r in bom} == {"Total concrete — RCC_M30", "Total concrete — PCC_M15", "Total rebar — 16mm", "Total rebar — coefficient-based (unclassified dia)"}


def test_elements_from_rows(spark):
    rows = [("d", "P1", "0.6", "0.5", "0.8", "2", "", None), ("d", "P2", "x", "1", "1", "1", "G", "80"), ("d", " ", "1", "1", "1", "1", "", ""), ("d", None, None, None, None, None, None, None), ("d", "P3", "1", "1", "1", "0", "", "")]
    good, bad = bill.elements_from_rows(spark.createDataFrame(rows, "drawing_id string, tag string, length_m string, width_m string, height_m string, quantity string, grade string, rebar_coefficient string"))
    assert [(r.tag, r.grade, r.rebar_coefficient) for r in good.collect()] == [("P1", "RCC_M30", 120.0)]
    assert {(r.tag, r.reason) for r in bad.collect()} == {("P2", "length_m"), ("P3", "quantity")}


def test_derivation(spark):
    slab = spark.createDataFrame([("d", "GS-01", 24.43, 8.6, 0.3)], "drawing_id string, tag string, length_m double, width_m double, thickness_m double")
    got = {r.rule_key: r for r in derive.derived(slab, derive.select_rules(derive.default_rules(spark), "all")).collect()}
    assert (got["excavation"].length_m, got["excavation"].width_m, got["excavation"].depth_m) == (25.03, 9.2, 0.525)
    assert got["joints"].quantity == round(4 * 8.6 + 1 * 24.43, 3) and got["curb"].length_m == 66.06
    assert derive.derived(slab, derive.default_rules(spark)).count() == 0
    found = spark.createDataFrame([("d", 1, "curb_wall", 200.0, 300.0), ("d", 2, "curb_wall", 150.0, 150.0), ("d", 3, "blinding", 100.0, None), ("d", 4, "epoxy", 6.0, None)], "drawing_id string, seq int, kind string, thickness_mm double, height_mm double")
    seeded = {r.rule_key: r.params for r in derive.seed_rules(derive.default_rules(spark), found).collect()}
    assert seeded["curb"] == {"thickness_m": 0.2, "height_m": 0.3} and seeded["epoxy"]["thickness_mm"] == 6.0
    assert seeded["blinding"]["thickness_m"] == 0.1 and seeded["excavation"]["blinding_thickness_m"] == 0.1
    both = derive.derived(slab, derive.select_rules(derive.seed_rules(derive.default_rules(spark), found), ["curb"]))
    assert [(r.rule_key, r.depth_m) for r in both.collect()] == [("curb", 0.3)]


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [
        ("TYP DETAIL OF PEDESTAL P1(600x500) 2Nos", ("P1", 600, 500, None, 2)),
        ("PEDESTAL P2 (500x500) 20Nos", ("P2", 500, 500, None, 20)),
        ("P3 (350x350) 11 Nos", ("P3", 350, 350, None, 11)),
        ("P7(500X500) 4NOS", ("P7", 500, 500, None, 4)),
        ("P10 [600×400] 7 No.", ("P10", 600, 400, None, 7)),
        ("PEDESTAL P4(600x500x900) 3Nos", ("P4", 600, 500, 900, 3)),
        ("TYP DETAIL OF FOUNDATION F1", None),
        ("CURB WALL 150THK X 150HIGH", None),
        ("", None),
        ("P1", None),
    ],
)
def test_pedestal_callouts(spark, text, want):
    got = one(spark, text, grammar.parse_pedestal(F.col("text")))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    "raw, date, note",
    [("30/09/25", "2025-09-30", ""), ("05/09/25", "2025-09-05", "ambiguous"), ("2025-09-30", "2025-09-30", ""), ("30-SEP-85", "1985-09-30", ""), ("31/02/25", "", "not a calendar date"), ("garbage", "", "unknown format"), ("", "", ""), ("32/13/25", "", "not a calendar date")],
)
def test_dates(spark, raw, date, note):
    assert tuple(one(spark, raw, grammar.normalise_date(F.col("text")))) == (date, note)


def sheet(spark, *texts, block=0):
    rows = [("d", 0, block, i, t, "") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "drawing_id string, page int, block_id bigint, line_no int, text string, grid_ref string")


def test_blinding_keeps_its_kind(spark):
    got = {(r.kind, r.f1) for r in grammar.scan_lines(sheet(spark, "150 THK BLINDING", "50 THK BLINDING", "150 THK SLAB")).collect()}
    assert got == {("thickness", 150.0), ("blinding", 150.0), ("blinding", 50.0)}


def test_open_vocabulary(spark):
    """Each label in a block of its own, so that none lends another a name."""
    want = {
        "40 THK BITUMEN SCREED": [("thickness", "Bitumen Screed, 40 mm thick", None)],
        "2MM THK POLYUREA MEMBRANE": [("thickness", "Polyurea Membrane, 2 mm thick", None)],
        "150 THK GEOTEXTILE SEPARATOR": [("thickness", "Geotextile Separator, 150 mm thick", None)],
        "25mm DIA WEEP HOLES": [("diameter", "Weep Holes, 25 mm dia", None)],
        "90% COMPACTED CRUSHED AGGREGATE": [("compaction", "Compacted Crushed Aggregate, 90% compaction", None)],
        "MANHOLE 1200x1200x1800": [("box3", "Manhole 1200x1200x1800", 2.592)],
        "MANHOLE 1200x1200x1800 DEEP CHAMBER": [("box3", "Manhole 1200x1200x1800", 2.592)],
        "PIT 1200x1200x1800 WITH 30 THK GROUT": [("box3", "PIT 1200x1200x1800", 2.592), ("thickness", "Grout, 30 mm thick", None)],
        "30 THK GROUT UNDER 600x500 PLATE": [("box2", "THK Grout Under 600x500", 0.3), ("box3", "Grout Under, 30 mm thick", 0.009)],
        "30 THK GROUT": [("thickness", "Grout, 30 mm thick", None)],
        "IP 20mm THK": [("thickness", "IP, 20 mm thick", None)],
        "16-D25": [("rebar", "D25 bars — 16 Nos per element", 16.0)],
        "D10 @ 150 LINK": [("rebar_spacing", "D10 bars @ 150 c/c (Link)", None)],
        "AR-(4)-B-M36-1345-N2": [("assembly", "Anchor assembly AR M36 x 1345 (grade B)", 4.0)],
        "D10-100 LINKS (2 Nos./SET)": [("rebar_spacing", "D10 bars @ 100 c/c (Links)", None), ("set", "Links — 2 Nos per set", 2.0)],
        "KERB 300x450": [("box2", "Kerb 300x450", 0.135)],
        "KERB 300x450x900": [("box3", "Kerb 300x450x900", 0.1215)],
        "4MM THK ACID RESISTANT EPOXY COATING": [("thickness", "Acid Resistant Epoxy Coating, 4 mm thick", None)],
        "20mm DIA LUGS": [("diameter", "Lugs, 20 mm dia", None)],
        "Ø10 @ 150 TIES": [("rebar_spacing", "D10 bars @ 150 c/c (Ties)", None)],
        "25 Ø DOWELS": [("diameter", "Dowels, 25 mm dia", None)],
    }
    no_items = ["SECTION A-A", "(SCALE: 1:25 mm)", "LOOKING NORTH", "KEY PLAN", "REV", "MD-522-8110-EG-CV-LAD-0101", "N 3046406.500 FOR 37112-TNK-002", "PROPRIETARY & CONFIDENTIAL", "DIMENSIONS SHALL BE VERIFIED AT SITE BEFORE CONSTRUCTION"]
    no_items += ["1200 x 3100", "BACKFILL COMPACTED 95%", "(2 Nos./SET)", "", " ", None, "4 THK", "0 THK GROUT", "3001 THK GROUT", "16-D24", "201-D25", "D10 @ 45", "49% COMPACTED SOIL", "KERB 49x300"]
    texts = [*want, *no_items]
    rows = [("d", 0, k, 0, t, "") for k, t in enumerate(texts)] + [("d", 0, None, k, t, "") for k, t in enumerate(("GROUT BED", "30 THK", "600x500"))]  # without a block nothing lends names
    lines = spark.createDataFrame(rows, "drawing_id string, page int, block_id bigint, line_no int, text string, grid_ref string")
    got = sorted(discovery.discover(lines).collect(), key=lambda r: (r.block_id, r.grammar, r.at))
    assert [(texts[r.block_id], r.kind, r.description, r.qty) for r in got] == [(t, *w) for t, ws in want.items() for w in ws]
    parts = discovery.discover_boxes(lines)
    for f in (discovery.discover_thickness, discovery.discover_diameter, discovery.discover_rebar, discovery.discover_assembly, discovery.discover_compaction, discovery.discover_per_set):
        parts = parts.unionByName(f(lines))
    assert sorted(map(str, parts.collect())) == sorted(map(str, got))
    basis = {r.description: (r.basis, r.spec) for r in got}
    assert basis["Grout Under, 30 mm thick"] == ("600x500x30 mm, per unit", {"length_mm": 600.0, "width_mm": 500.0, "thickness_mm": 30.0})
    assert basis["Bitumen Screed, 40 mm thick"] == ("40 mm thick — area not stated on this sheet", {"thickness_mm": 40.0})
    assert basis["D10 bars @ 150 c/c (Link)"][0] == "D10 @ 150 c/c — run length not stated"
    assert basis["Anchor assembly AR M36 x 1345 (grade B)"][1] == {"count": 4.0, "size_mm": 36.0, "length_mm": 1345.0, "nuts": 2.0}


def test_block_context(spark):
    cases = [
        (("TYP DETAIL OF PEDESTAL", "P1(600x500) 2Nos"), ["Pedestal 600x500"]),
        (("REFERENCE DOCUMENTS", "16-D25"), ["D25 bars — 16 Nos per element"]),
        (("4MM THK ACID RESISTANT", "EPOXY COATING (TYP)"), ["Acid Resistant Epoxy Coating, 4 mm thick"]),
        (("4MM THK ACID RESISTANT", "ACID RESISTANT"), ["Acid Resistant, 4 mm thick"]),
        # the next label is furniture, holds a digit, or the phrase didn't run to the end of its own label
        (("4MM THK ACID RESISTANT", "SECTION A-A", "EPOXY COATING"), ["Acid Resistant, 4 mm thick"]),
        (("20mm DIA LUGS", "PLATE P12"), ["Lugs, 20 mm dia"]),
        (("30 THK GROUT (TYP)", "BASE PLATE"), ["Grout, 30 mm thick"]),
        (("90% COMPACTED ONE TWO THREE FOUR", "FIVE SIX SEVEN EIGHT NINE"), ["Compacted ONE TWO Three Four Five SIX, 90% compaction"]),
        # the block's first name without a digit wins, from its top; long labels lend none
        (("P12 STUB", "ANCHOR BLOCK", "600x500", "BASE"), ["Anchor Block 600x500"]),
        (("A LABEL THAT IS LONGER THAN SIXTY CHARACTERS LENDS NO NAME TO ANY", "600x500"), []),
        (("600x500", "NOTES", "KERB STONE"), ["Kerb Stone 600x500"]),
    ]
    rows = [("d", 0, b, i, t, "") for b, (texts, _) in enumerate(cases) for i, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, "drawing_id string, page int, block_id bigint, line_no int, text string, grid_ref string")
    got = [[] for _ in cases]
    for r in discovery.discover(lines).collect():
        got[r.block_id].append(r.description)
    assert got == [want for _, want in cases]


def test_merged_items(spark):
    lines = spark.createDataFrame([("d", 0, b, i, t, g) for b, (i, t, g) in enumerate([(0, "30 THK GROUT", "A-1"), (0, "30  THK  Grout", "B-2"), (0, "30 THK GROUT", "A-1"), (0, "16-D25", ""), (0, "8-D25", ""), (0, "30 THK GROUT", None)])], "drawing_id string, page int, block_id bigint, line_no int, text string, grid_ref string")
    got = {r.description: r for r in discovery.merge_items(discovery.discover(lines)).collect()}
    assert sorted(got) == ["D25 bars — 16 Nos per element", "D25 bars — 8 Nos per element", "Grout, 30 mm thick"]
    g = got["Grout, 30 mm thick"]
    assert (g.occurrences, g.qty, g.uom, g.texts, g.places, g.spec_json) == (4, None, "m2", "30 THK GROUT | 30 THK Grout", "A-1, B-2", '{"thickness_mm":30.0}')


def test_levels_and_grades_of_a_sheet(spark):
    assert [r.grade for r in discovery.concrete_grades(sheet(spark, "GRADE C35 CONCRETE", "C25x40", "AR-(4)-B-M36")).collect()] == ["C35"]
    levels = discovery.sheet_levels(sheet(spark, "BOBP EL. 98.380", "BOC EL. 95.500"))
    assert [r.height_m for r in discovery.height_candidates(levels).collect()] == [2.88]


def test_reconcile(spark):
    rows = [("d", i, "P1", 600.0, 500.0, q, v, r, g) for i, (q, v, r, g) in enumerate([(2, True, "r0", "A-1"), (3, True, "r1", "A-2"), (3, True, "r2", ""), (2, True, "r3", "A-1"), (9, False, "r4", "A-2")])]
    df = spark.createDataFrame(rows, "drawing_id string, seq int, tag string, length_mm double, width_mm double, quantity int, validated boolean, region string, grid_ref string")
    got = reconcile.reconcile(df).first()
    assert (got.quantity, got.confidence, got.regions) == (2, "low", "r0, r1, r2, r3, r4")
    assert tuple(reconcile.vote_location(df).first())[2:] == ("", True)
    base = spark.createDataFrame([("d", "p1", 1.0, 1.0, 1.0, 1)], "drawing_id string, tag string, length_m double, width_m double, height_m double, quantity int")
    found = spark.createDataFrame([("d", 1, "P1", 600.0, 500.0, None, 2), ("d", 2, "P2", 500.0, 500.0, None, 3), ("d", 3, "p2", 1.0, 1.0, None, 9)], "drawing_id string, seq int, tag string, length_mm double, width_mm double, height_mm double, quantity int")
    once = reconcile.merge_into_project(base, found)
    assert sorted(map(tuple, reconcile.merge_into_project(once, found).collect())) == sorted(map(tuple, once.collect())) == [("d", "P2", 0.5, 0.5, 0.8, 3), ("d", "p1", 1.0, 1.0, 1.0, 1)]


def test_norm_value(spark):
    for raw, want in (("600", "600"), ("600.0", "600"), (" 600 ", "600"), ("0.1", "0.1"), ("1234567", "1.23457e+06"), ("0.00001", "1e-05"), ("-2.50", "-2.5"), ("A  b", "a b"), (None, ""), ("0", "0"), ("999999.9", "1e+06"), ("123.4567", "123.457")):
        assert one(spark, raw, verify.norm_value(F.col("text"))) == want, raw


def test_codes_and_grid(spark):
    df = spark.createDataFrame([("1", "MD-522-8110-EG-0107"), ("2", "MD-522-8120-EG-0107"), ("3", "A-1"), ("4", "A-1")], "drawing_id string, drawing_no string")
    assert {r.drawing_id: r.code for r in setviews.unique_codes(df).collect()} == {"1": "8110-0107", "2": "8120-0107", "3": "1", "4": "1_2"}
    ref = lambda *v: spark.range(1).select(geometry.grid_ref(*[F.lit(float(x)) for x in v], F.lit(16), F.lit(12), F.lit(False)).alias("x")).first().x
    assert ref(0, 0, 0.01, 0.01) == "A-1" and ref(0, 0, 1, 1) == "A-1 → L-16"


def test_merged_boxes_do_not_touch(spark):
    import random

    rng = random.Random(2)
    rows = [("d", 0, i, x, y, x + 20, y + 10) for i in range(120) for x, y in [(rng.uniform(0, 2000), rng.uniform(0, 1500))]]
    got = geometry.merge_overlaps(spark.createDataFrame([tuple(map(lambda v: v, r)) for r in rows], "drawing_id string, page int, glyph_id bigint, x0 double, y0 double, x1 double, y1 double")).collect()
    boxes = [[r[3] - 26, r[4] - 9, r[5] + 26, r[6] + 9] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(len(boxes)):
            for j in range(i):
                a, b = boxes[i], boxes[j]
                if a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]:
                    boxes[j] = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]
                    boxes.pop(i)
                    changed = True
                    break
            if changed:
                break
    assert sorted((round(r.x0, 6), round(r.y1, 6)) for r in got) == sorted((round(b[0], 6), round(b[3], 6)) for b in boxes)


def test_fold_against_a_plain_loop(spark, sf):
    from plumbline.sources.synth import table

    events = table(spark, sf, "job_events")
    want = {}
    for e in sorted(events.collect(), key=lambda e: (e.ts, e.event_id)):
        j = want.setdefault(e.job_id, {"state": "none", "pct": 0.0, "start": None, "elapsed": None, "error": "", "cached": False})
        if e.event == "enqueue":
            j.update(state="queued", pct=0.0)
        elif e.event == "start":
            j.update(state="running", pct=0.0, start=e.ts)
        elif e.event == "heartbeat":
            j["pct"] = min(max(e.progress_pct, 0.0), 100.0)
        else:
            if j["start"] is not None:
                j["elapsed"] = (e.ts - j["start"]).total_seconds()
            j.update(state="done", pct=100.0, cached=e.from_cache) if e.event == "finish" else j.update(state="failed", error=e.error)
    got = telemetry.fold_job_state(events).collect()
    assert len(got) == len(want)
    for r in got:
        j = want[r.job_id]
        assert (r.state, r.progress_pct, r.error, r.from_cache) == (j["state"], j["pct"], j["error"], j["cached"])
        assert (r.elapsed_s is None) == (j["elapsed"] is None) and abs((r.elapsed_s or 0) - (j["elapsed"] or 0)) < 1e-3


def test_streams_match_the_batch(spark, sf, tmp_path):
    from plumbline.sources.synth import table
    from plumbline.streaming import jobs

    events = table(spark, sf, "job_events").selectExpr("event_id", "cast(ts as timestamp) as ts", "job_id", "owner", "drawing_path", "page", "event", "progress_pct", "from_cache", "error")
    ordered = events.orderBy("ts", "event_id").limit(400)
    ordered.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(jobs.EVENTS).parquet(str(tmp_path / "in"))
    for name, df, mode in (("folded", jobs.fold_stream(stream), "update"),):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    batch = telemetry.fold_job_state(ordered).select("job_id", "state", "progress_pct", "error", "from_cache", "n_events")
    got = spark.sql("select job_id, state, progress_pct, error, from_cache, n_events from folded")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_stale_and_latest_streams(spark, tmp_path):
    import datetime
    import time

    from plumbline.streaming import jobs

    at = lambda s: datetime.datetime(2026, 1, 1, 0, 0, s)
    event = lambda i, s, job, kind: (i, at(s), job, "o", f"/{job[0]}", 0, kind, 0.0, None, None)
    rows = [event(1, 1, "a1", "start"), event(2, 2, "b1", "start"), event(3, 3, "b1", "finish"), event(4, 3, "a2", "enqueue")]
    spark.createDataFrame(rows, jobs.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(jobs.EVENTS).parquet(str(tmp_path / "in"))
    q = jobs.latest_stream(stream).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.drawing_path, r.job_id, r.event) for r in spark.table("latest").collect()) == [("/a", "a2", "enqueue"), ("/b", "b1", "finish")]
    q = jobs.stale_stream(stream, 500).writeStream.format("memory").queryName("stale").outputMode("append").trigger(processingTime="1 second").start()
    try:
        end = time.time() + 90
        while time.time() < end and not spark.table("stale").count():
            time.sleep(1)
    finally:
        q.stop()
    assert {(r.job_id, r.becomes) for r in spark.table("stale").collect()} == {("a1", "requeued")}


def test_a_saved_reading_gives_lines_and_calls(spark, tmp_path):
    import json

    reading = {
        "source_pdf": "x.pdf",
        "findings": {"curb": [1]},
        "discovery": {"items": []},
        "pedestals": [{"tag": "P1", "seen_in_regions": ["r0c0"], "regex_validated": True}],
        "transcript_blocks": [{"region": "r0c0", "rect_norm": [0, 0, 1, 1], "grid_ref": "A-1", "lines": ["P1(600x500) 2Nos", None, "SECTION A-A"]}, {"region": "r0c1", "lines": []}],
        "responses": [{"region": "a", "stage": "s", "elapsed_s": 1.5, "error": ""}, {"region": "b", "skipped": True}, {"region": "c", "error": "boom", "elapsed_s": 2}],
    }
    (tmp_path / "a_extraction.json").write_text(json.dumps(reading))
    (tmp_path / "b_extraction.json").write_text(json.dumps({"transcribed_lines": ["30 THK GROUT"]}))
    (tmp_path / "c_extraction.json").write_text(json.dumps({}))
    good, bad = stores.read_extractions(spark, str(tmp_path))
    assert bad.count() == 0 and good.count() == 3
    a = good.where("source_pdf = 'x.pdf'").first()
    assert json.loads(a.findings) == {"curb": [1]} and json.loads(a.discovery) == {"items": []} and a.pedestals[0].seen_in_regions == ["r0c0"]
    lines = stores.reading_lines(good)
    assert sorted((r.block_id, r.line_no, r.text, r.grid_ref) for r in lines.collect()) == [(0, 0, "30 THK GROUT", ""), (0, 0, "P1(600x500) 2Nos", "A-1"), (0, 2, "SECTION A-A", "A-1")]
    assert {r.description for r in discovery.discover(lines).collect()} >= {"Grout, 30 mm thick"}
    s = reconcile.extraction_summary(stores.reading_calls(good)).collect()
    assert [(r.calls, r.slowest_s, r.skipped, r.failed) for r in s] == [(1, 1.5, 1, 1)]


def test_revision_and_date_of_a_sheet(spark):
    rows = [("d", 0, 1, "B07 01/02/2024"), ("d", 0, 2, "x" * 2500), ("d", 0, 3, "C03 A01"), ("d", 0, 4, None), ("d", 1, 1, "B07 12-3-24 and 1.1.2025"), ("e", 0, 1, "y" * 1990 + " D09"), ("e", 0, 2, "z" * 7)]
    sheets = [("d", 0, "n.pdf"), ("d", 1, "n_C01.PDF"), ("e", 0, "n_C011.pdf"), ("f", 0, "")]
    got = geometry.sheet_revision(spark.createDataFrame(rows, "drawing_id string, page int, line_id int, text string"), spark.createDataFrame(sheets, "drawing_id string, page int, file_name string"))
    assert {(r.drawing_id, r.page): (r.revision, r.date_raw) for r in got.collect()} == {("d", 0): ("C03", "01/02/2024"), ("d", 1): ("C01", "1.1.2025"), ("e", 0): ("D09", ""), ("f", 0): ("", "")}


def test_compound_specification_words_name_nothing(spark):
    words = ["NOS./SET", "nos/set", "MM", "A/C", "BOLTS", "/", "THK/DIA", "THK/PLATE"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", discovery.specifies(F.col("w")).alias("is")).collect()
    assert {r.w for r in got if r["is"]} == {"NOS./SET", "nos/set", "MM", "THK/DIA"}


def meets(a, b):
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def test_label_blocks_of_all_sheets(spark, sf):
    from collections import defaultdict

    from plumbline.plans import catalog
    from plumbline.sources.synth import table

    sheets = defaultdict(list)
    for r in table(spark, sf, "spans").collect():
        if r.text.strip() and r.dir_x >= 0.9:  # rotated spans belong to no block
            sheets[r.drawing_id, r.page].append((r.span_id, r.x0, r.y0, r.x1, r.y1))
    want = {}
    for spans in sheets.values():
        hangs = {}
        for i, x0, y0, x1, y1 in spans:
            above = [(abs(y0 - w1), u) for u, v0, w0, v1, w1 in spans if u != i and x0 < v1 and x1 > v0 and -1.0 <= y0 - w1 <= 1.9 * max(y1 - y0, 8.0)]
            if above:
                hangs[i] = min(above)[1]
        near = defaultdict(set)
        for a, b in hangs.items():
            near[a].add(b)
            near[b].add(a)
        for i, *_ in spans:
            todo, seen = [i], {i}
            while todo:
                fresh = near[todo.pop()] - seen
                seen |= fresh
                todo += fresh
            want[i] = min(seen)
    got = {r.line_id: r.block for r in catalog.QUERIES["label_blocks"](spark, sf).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_merged_boxes_of_all_sheets(spark, sf):
    from collections import defaultdict

    from plumbline.plans import catalog
    from plumbline.sources.synth import table

    sheets = defaultdict(list)
    for r in table(spark, sf, "glyphs").collect():
        w, h = r.x1 - r.x0, r.y1 - r.y0
        if 9 <= h <= 40 and 0.4 <= w <= 40 and w * h > 0.2:
            sheets[r.drawing_id, r.page].append([r.x0 - 26, r.y0 - 9, r.x1 + 26, r.y1 + 9])
    want = []
    for key, todo in sheets.items():
        done = []
        while todo:
            box = todo.pop()
            while hit := next((b for b in done if meets(b, box)), None):
                done.remove(hit)
                box = [min(box[0], hit[0]), min(box[1], hit[1]), max(box[2], hit[2]), max(box[3], hit[3])]
            done.append(box)
        want += [(*key, *(round(v, 6) for v in b)) for b in done]
    got = catalog.QUERIES["merge_overlaps"](spark, sf).collect()
    assert sorted((r.drawing_id, r.page, *(round(r[x], 6) for x in ("x0", "y0", "x1", "y1"))) for r in got) == sorted(want)


def test_files(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for d in (a, b):
        d.mkdir()
    (a / "x.pdf").write_bytes(b"one")
    (b / "y.pdf").write_bytes(b"one")
    (b / ".z.pdf").write_bytes(b"two")
    (b / "x.pdf").write_bytes(b"three")
    got = stores.scan_drawings(spark, [str(a), str(b)])
    assert sorted((r.name, r.folder_no) for r in got.collect()) == [("x.pdf", 0), ("x.pdf", 1)]
    assert {r.label for r in stores.display_labels(got).collect()} == {"x.pdf (a)", "x.pdf (b)"}
    (a / "s1_extraction.json").write_text('{"source_pdf": "x.pdf", "page_number": 0, "pedestals": [{"tag": "P1", "quantity": 2}]}')
    (a / "s2_extraction.json").write_text("{broken")
    good, bad = stores.read_extractions(spark, str(a))
    assert [r.source_pdf for r in good.collect()] == ["x.pdf"] and bad.count() == 1
    rows = spark.createDataFrame([("ab1", 1, "x"), ("ab2", 1, "y"), ("cd1", 1, "z")], "fingerprint string, saved_at int, body string")
    versions.write_change(rows, str(tmp_path / "store"))
    versions.write_change(spark.createDataFrame([("ab1", 2, "new")], rows.schema), str(tmp_path / "store"))
    assert {(r.fingerprint, r.body) for r in versions.read_store(spark, str(tmp_path / "store")).collect()} == {("ab1", "new"), ("ab2", "y"), ("cd1", "z")}
    (a / "ex1.json").write_text('{"drawing_no": "D1", "verified_extraction": {"P1": "600x500"}}')
    assert stores.read_examples(spark, str(a)).where("drawing_no is not null").count() == 1
    stores.write_table(rows, str(tmp_path / "out"), by="fingerprint")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_similar_sheets_keep_every_tier_above_the_bound(spark):
    spread = sum(1 << b for b in range(2, 64, 5))  # 13 bits, some in each seventh of the hash
    rows = [(f"P{i % 3}-A-B-C-{i}", f"{0x0123456789ABCDEF ^ (spread if i % 2 else 0) ^ (1 << i % 5):016x}") for i in range(60)]
    h = spark.createDataFrame(rows, "drawing_no string, image_hash string")
    few, many = [sorted(geometry.find_similar(h.where("drawing_no like '%-1_'"), h, 60, most).collect()) for most in (20_000, 10)]
    assert many == few and {r.tier for r in few} == {0, 1, 2}
    # k of one, with copies of a sheet by the dozen and a hash that is none, against plain loops
    rows += [("P1-A-B-C-1", rows[1][1])] * 3 + [(f"Q{i % 2}-A-B-C-{i}", rows[7][1]) for i in range(30)] + [("P2-A-B-C-900", "no hash"), ("Z-A-B-C-1", "f" * 16)]
    h = spark.createDataFrame(rows, "drawing_no string, image_hash string")
    for k in (1, 3, 50):
        got = sorted((r.q_no, r["rank"], r.e_no, r.tier, r.distance) for r in geometry.find_similar(h, h, k).collect())
        want = []
        for q_no in {n for n, _ in rows}:
            found = []
            for n, b in rows:
                for e, x in rows:
                    if n == q_no and e != n:
                        dist = 64 if "no hash" in (b, x) else (int(b, 16) ^ int(x, 16)).bit_count()
                        tier = 0 if dist <= 6 else 1 if e.split("-")[:4] == n.split("-")[:4] else 2 if dist <= 18 else None
                        if tier is not None:
                            found.append((tier, dist, e))
            want += [(q_no, r, e, t, x) for r, (t, x, e) in enumerate(sorted(found)[:k], 1)]
        assert got == sorted(want)


def test_text_blocks_hold_the_glyphs_that_touch_them(spark, sf):
    from collections import defaultdict

    from plumbline.plans import catalog
    from plumbline.sources.synth import table

    glyphs = defaultdict(list)
    for r in geometry.glyph_filter(table(spark, sf, "glyphs")).collect():
        glyphs[r.drawing_id, r.page].append((r.x0, r.y0, r.x1, r.y1))
    got = catalog.QUERIES["text_blocks"](spark, sf).collect()
    assert sum(r.n_glyphs for r in got) == sum(map(len, glyphs.values()))
    for r in got:
        own = sorted(b[3] - b[1] for b in glyphs[r.drawing_id, r.page] if meets(b, (r.x0, r.y0, r.x1, r.y1)))
        assert r.n_glyphs == len(own) and r.height == own[len(own) // 2]


def test_plan_and_reviews_in_words(spark):
    found = [("d", "pedestal", "P1", 600.0, 500.0, None, None, 2), ("d", "pedestal", "p2", 700.0, 500.0, 900.0, None, 1), ("d", "grade_slab", "GS-01", 20000.0, None, None, 250.0, None), ("d", "grade_slab", "GS-02", 20000.0, 10000.0, None, 250.0, None)]
    found = spark.createDataFrame(found, "drawing_id string, kind string, tag string, length_mm double, width_mm double, height_mm double, thickness_mm double, quantity int")
    have = spark.createDataFrame([("d", "pedestal", "P2"), ("d", "grade_slab", "gs-01")], "drawing_id string, kind string, tag string")
    fields = spark.createDataFrame([("d", "revision", "C01", "D'02"), ("d", "date", "", "2025-01-01"), ("d", "project_name", None, "")], "drawing_id string, field string, current string, read string")
    assert {(r.target, r.action, r.detail) for r in reconcile.plan_merge(have, fields, found).collect()} == {
        ("revision", "skip", "keeping 'C01', extraction said \"D'02\""), ("date", "add", "2025-01-01"), ("P1", "add", "0.600 x 0.500 x 0.800 m, 2 Nos  [height is a 0.800 m PLACEHOLDER]"),
        ("p2", "skip", "already entered — extraction ignored"), ("GS-01", "reject", "incomplete dimensions"), ("GS-02", "add", "20.000 x 10.000 x 0.250 m"),
    }
    rows = [
        ("a.xlsx", "D1", 1, " pedestal ", "P1", "P1(600x500) 2Nos", "1", "", "eng"), ("a.xlsx", "D1", 2, "Pedestal", "P2", "unreadable", "1", "", "eng"), ("a.xlsx", "D1", 3, "Pedestal", "P3", "P3(600x500) 2Nos", "1", "", ""),
        ("b.xlsx", "D2", 1, "Pedestal", "P1", "unreadable", "1", "", "eng"), ("b.xlsx", "D2", 2, "Pedestal", "P2", "P2(600x500) 2Nos", "1", "", ""),
        ("c.xlsx", "D3", 1, "Pedestal", "P1", "P1(600x500) 2Nos", "1", "", "eng"), ("c.xlsx", "D3", 2, "PEDESTAL", "P2", "odd words", "1", "2", ""),
        ("d.xlsx", "D4", 1, "Pedestal", "P1", "P1(600x500) 2Nos", "1", "1.0", ""),
    ]
    reviews = spark.createDataFrame(rows, "source string, drawing_no string, row_no int, item string, tag string, callout string, extracted string, corrected string, verified_by string")
    _, look, bank, failed = verify.ingest_reviews(reviews, spark.createDataFrame([("a.xlsx", True), ("x/e.xlsx", True), ("x/f.xlsx", False)], "source string, readable boolean"))
    assert [r.callout for r in look.collect()] == ["odd words"]
    assert sorted((r.drawing_no, r.n_pedestals, r.verified_by, r.pedestals) for r in bank.collect()) == [("D1", 1, "eng", "P1 600x500 2 Nos"), ("D4", 1, "expert review", "P1 600x500 2 Nos")]
    assert sorted(r.failure for r in failed.collect()) == ["e.xlsx: no verification rows", "f.xlsx: can't be read"]


def test_explanations_are_the_worked_sums(spark):
    slab = spark.createDataFrame([("d", "GS-01", 24.43, 8.6, 0.3)], "drawing_id string, tag string, length_m double, width_m double, thickness_m double")
    got = {r.rule_key: r.explanation for r in derive.derived(slab, derive.select_rules(derive.default_rules(spark), "all")).collect()}
    assert got == {
        "excavation": "(24.43 + 2x0.3) x (8.6 + 2x0.3) x (0.3 slab + 0.075 blinding + 0.15 fill) = 120.89 m3", "blinding": "(24.43 + 2x0.1) x (8.6 + 2x0.1) x 0.075 = 16.26 m3", "fill": "24.43 x 8.6 x 0.15 = 31.51 m3",
        "liner": "24.43 x 8.6 = 210.10 m2 at 1.5 mm", "epoxy": "top surface 24.43 x 8.6 = 210.10 m2 x 2 coats", "curb": "perimeter 2 x (24.43 + 8.6) = 66.06 m at 0.15 high x 0.15 thick", "joints": "5 m panels: 4 joint(s) x 8.6 m + 1 x 24.43 = 58.83 m",
    }


def test_drawing_no_is_read_to_its_last_digit(spark):
    spans = spark.createDataFrame([("1", 0, "MD-522-10031", 5.0, 5.0), ("1", 0, "MD-522-1003", 50.0, 5.0), ("2", 0, "DRG MD-522-1004 C01", 5.0, 5.0)], "drawing_id string, page int, text string, x0 double, y0 double")
    sheets = spark.createDataFrame([(d, 0, f"MD-522-100{n}_C01.pdf", 100.0, 100.0) for d, n in (("1", 3), ("2", 4), ("3", 5))], "drawing_id string, page int, file_name string, width_pt double, height_pt double")
    got = {r.drawing_id: tuple(r)[2:] for r in geometry.sheet_drawing_no(spans, sheets, r"MD-\d{3}-\d{4}").collect()}
    assert got == {"1": ("MD-522-10031", False, True), "2": ("MD-522-1004", False, False), "3": ("MD-522-1005", True, False)}


def test_repeated_labels_are_read_once(spark, monkeypatch):
    read = []
    monkeypatch.setattr(discovery, "items_of", lambda rows, grammars=(), of=discovery.items_of: read.append(rows.count()) or of(rows, grammars))
    lines = [(str(d), b, n, ("30 THK GROUT", "1200 x 3100", "MANHOLE COVER", None)[n % 4], "A-1") for d in range(50) for b in (0, None) for n in range(4)]
    got = discovery.discover(spark.createDataFrame(lines, "drawing_id string, block_id bigint, line_no int, text string, grid_ref string")).collect()
    assert read[0] <= 4 and len(got) == 150 and {r.description for r in got} == {"Grout, 30 mm thick", "Grout X, 30 mm thick", "Grout 1200x3100"}


def test_close_hashes_and_series_blocks_are_exact(spark, monkeypatch):
    import random

    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(20)]
    rows = [(f"A-1-1-{i % 2}-{rnd.randrange(90)}", base[i % 20] ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(9))) & (1 << 64) - 1) for i in range(160)] + [("A-1-1-0-5", None), ("A-1-1-0-5", base[0]), ("A-1-1-0-5", base[0]), (None, base[1])]
    bits = lambda a, b: 64 if a is None or b is None else (a ^ b).bit_count()
    h = spark.createDataFrame([(n, None if x is None else f"{x:016x}") for n, x in rows], "drawing_no string, image_hash string")
    signed = [(x - (1 << 64) if x >> 63 else x,) for _, x in rows if x is not None]
    one = spark.createDataFrame(signed, "x bigint")
    got = [tuple(r) for r in geometry.close_hashes(one.toDF("a"), one.toDF("b")).collect()]
    want = {(a, b) for (a,) in signed for (b,) in signed if ((a ^ b) & (1 << 64) - 1).bit_count() <= 6}
    assert len(got) == len(set(got)) and set(got) == want
    monkeypatch.setattr(geometry, "QUERY_BLOCK", 16)
    monkeypatch.setattr(geometry, "EXAMPLE_BLOCK", 16)
    series = lambda n: n.split("-")[:4]
    want = []
    for q in {n for n, _ in rows if n}:
        found = []
        for n, x in rows:
            for m, y in rows:
                d = bits(x, y)
                if n == q and m is not None and m != q and (d <= 6 or series(n) == series(m) or d <= 18):
                    found.append((0 if d <= 6 else 1 if series(n) == series(m) else 2, d, m))
        want += [(q, m, t, d, k + 1) for k, (t, d, m) in enumerate(sorted(found)[:4])]
    assert sorted(map(tuple, geometry.find_similar(h, h, 4).collect())) == sorted(want)
