"""A4, A5 and G19 on files: saved readings opened from JSON, rebuilt into a set, and stored by fingerprint."""

import datetime
import json

import pytest

from plumbline.functions import frames
from plumbline.operators import derive
from plumbline.plans import bill_queries, rebuild
from plumbline.plans.rebuild import rebuild_readings
from plumbline.sources import readings, versions

READING = {
    "source_pdf": "in/MD-1.pdf",
    "used_text_layer": True,
    "title_block": {"drawing_no": "", "revision": "C01"},
    "pedestals": [{"tag": "P1", "length_mm": 600, "width_mm": "500", "quantity": 2.0, "raw_text": "P1(600x500) 2Nos", "seen_in_regions": ["a", "b"], "height_mm": 0}, {"tag": "p1", "length_mm": 9, "width_mm": 9, "quantity": 9}, {"tag": "P2", "length_mm": 700, "width_mm": 500, "quantity": 1, "height_mm": 900}],
    "grade_slabs": [{"tag": "GS-01", "length_mm": 20000}, {"length_mm": 20000, "width_mm": 10000, "thickness_mm": 250}, {"tag": "gs-01", "length_mm": 1, "width_mm": 1, "thickness_mm": 1}],
    "findings": {"curb_walls": [{"thickness_mm": 200.0, "height_mm": 300.0, "raw_text": "CURB"}], "epoxy": [{"thickness_mm": 5}], "thicknesses": [{"thickness_mm": 150.0}, {"thickness_mm": 50.0, "kind": "blinding"}], "levels": [{"kind": "TOC", "level_m": 97.5}], "rebar": [{"count": 16, "diameter_mm": 25, "spacing_mm": None}], "insert_plates": [{"type": "A1a"}], "sumps": [{"length_mm": 900, "width_mm": 1200}], "pedestals": [{"tag": "P1", "length_mm": 600, "width_mm": 500, "quantity": 2}]},
    "position_marks": {"P1": 3, "F2": 1},
    "discovery": {"items": [{"kind": "box2", "description": "Kerb 300x450", "spec": {"length_mm": 450, "width_mm": 300}, "uom": "m2", "qty": 0.135, "basis": "b", "occurrences": 2}, {"kind": "thickness", "description": "Grout", "qty": None}]},
}
BAD = {"cut": '{"pedestals": [', "list": "[1]", "null": "null", "kind": '{"pedestals": {}}', "lost": '{"pedestals": null}', "half": '{"pedestals": [{"tag": "P1", "length_mm": 1, "width_mm": 1, "quantity": 1.5}]}', "tag": '{"pedestals": [{"tag": 1, "length_mm": 1, "width_mm": 1, "quantity": 1}]}', "marks": '{"position_marks": {"P1": "many"}}', "blank": " "}


@pytest.fixture
def folder(spark, tmp_path):
    (tmp_path / "a_extraction.json").write_text(json.dumps(READING))
    (tmp_path / "b_extraction.json").write_text(json.dumps({"source_pdf": "", "discovery": {"items": [{"kind": "x"}]}}))
    (tmp_path / "c_extraction.json").write_text("{}")
    (tmp_path / "other.json").write_text("{}")
    for name, text in BAD.items():
        (tmp_path / f"{name}_extraction.json").write_text(text)
    return readings.parse_readings(readings.read_folder(spark, str(tmp_path)))


def stem(path):
    return path.rsplit("/", 1)[-1].removesuffix("_extraction.json")


def test_files_that_are_no_readings_are_told(folder):
    good, bad = folder
    assert sorted(stem(r.drawing_id) for r in good.collect()) == ["a", "b", "c"]
    assert {stem(r.drawing_id): r.reason for r in bad.collect()} == {
        "cut": "not JSON", "blank": "not JSON", "list": "not an object", "null": "not an object", "kind": "pedestals is no list", "lost": "pedestals is no list", "half": "a pedestal lacks its tag, sizes or quantity",
        "tag": "a pedestal lacks its tag, sizes or quantity", "marks": "a position mark has no whole number",
    }
    odd = folder[0].sparkSession.createDataFrame([("x", ""), ("y", None), (None, "{}")], "drawing_id string, value string")
    good, bad = readings.parse_readings(odd)
    assert [r.drawing_id for r in good.collect()] == [None] and sorted((r.drawing_id, r.reason) for r in bad.collect()) == [("x", "not JSON"), ("y", "not JSON")]


def test_typed_tables_of_readings(folder):
    good, _ = folder
    got = {(r.kind, r.seq): r for r in readings.findings(good).collect()}
    assert sorted(got) == [("blinding", 1), ("curb_wall", 0), ("epoxy", 0), ("insert_plate", 0), ("level", 0), ("pedestal", 0), ("rebar", 0), ("sump", 0), ("thickness", 0)]
    assert (got["curb_wall", 0].thickness_mm, got["curb_wall", 0].height_mm, got["curb_wall", 0].raw_text) == (200.0, 300.0, "CURB")
    assert (got["level", 0].name, got["level", 0].level_m, got["rebar", 0].number, got["rebar", 0].spacing_mm, got["insert_plate", 0].name) == ("TOC", 97.5, 16.0, None, "A1a")
    items = {r.description: r for r in readings.items(good).where("description <> ''").collect()}
    assert items["Kerb 300x450"].spec == {"length_mm": 450.0, "width_mm": 300.0} and (items["Kerb 300x450"].dim_a, items["Kerb 300x450"].dim_b, items["Kerb 300x450"].occurrences) == (300.0, 450.0, 2)
    assert items["Grout"].qty is None and items["Grout"].spec == {}
    assert sorted((r.mark, r.n) for r in readings.marks(good).collect()) == [("F2", 1), ("P1", 3)]
    assert [(r.tag, r.quantity, r.width_mm, r.height_mm, r.n_sightings) for r in readings.pedestals(good).orderBy("seq").collect()][:1] == [("P1", 2, 500.0, None, 2)]


def test_a_set_rebuilt_from_a_folder(folder):
    summary, index = rebuild_readings(folder[0], "all")
    rows = {stem(r.drawing_id): r for r in index.collect()}
    assert (rows["a"].drawing_no, rows["a"].n_pedestals, rows["a"].n_slabs, rows["a"].n_marks, rows["a"].n_items) == ("MD-1", 2, 1, 2, 2)
    assert rows["a"].notes == "read from the sheet's own text layer (no model calls) | placeholder height on P1"
    assert rows["b"].drawing_no == "b_extraction" and rows["b"].notes == "no pedestal or slab on this sheet — 1 item(s) read from the drawing's own wording instead"
    assert rows["c"].notes == "no quantities on this sheet — marks and findings only"
    got = {(r.category, r.item): r.qty for r in summary.collect()}
    concrete = {i: q for (c, i), q in got.items() if c == "Structural Concrete"}
    # 0.6 x 0.5 x 0.8 x 2 and 0.7 x 0.5 x 0.9, a slab of 50 m3, a curb of 60 m by 0.3 by 0.2, each 3 % more
    assert sum(concrete.values()) == pytest.approx(1.03 * (0.48 + 0.315 + 50 + 3.6), abs=2e-3)
    # the sheet's own blinding of 50 mm
    assert [q for (c, i), q in got.items() if i.startswith("Excavation")] == [pytest.approx(20.6 * 10.6 * (0.25 + 0.05 + 0.15), abs=1e-3)]
    assert not any(c == "HDPE Liner" for c, _ in {(r.category, r.item): r.qty for r in rebuild_readings(folder[0], ["curb"])[0].collect()})


def rows_at(spark, *rows):
    return spark.createDataFrame([(f, datetime.datetime(2025, 1, d), v) for f, d, v in rows], "fingerprint string, saved_at timestamp, json string")


def test_store_keeps_the_newest_reading_of_a_fingerprint(spark, tmp_path):
    path = str(tmp_path / "store")
    held = lambda: sorted((r.fingerprint, r.json) for r in versions.read_store(spark, path).collect())
    with pytest.raises(FileNotFoundError):
        versions.read_store(spark, path)
    assert versions.compact(spark, path) is None and versions.vacuum(spark, path) == []
    assert versions.write_change(rows_at(spark, ("a", 1, "a1"), ("a", 3, "a3"), ("b", 1, "b1")), path) == 0
    assert held() == [("a", "a3"), ("b", "b1")]
    assert versions.write_change(rows_at(spark, ("a", 2, "later batch wins")), path) == 1
    versions.write_change(rows_at(spark, ("a", 2, "the batch once more")), path, 1)
    assert held() == [("a", "the batch once more"), ("b", "b1")]
    assert versions.compact(spark, path) == 1 and versions.compact(spark, path) is None and held() == [("a", "the batch once more"), ("b", "b1")]
    assert versions.write_change(rows_at(spark, ("c", 1, "c1")), path) == 2
    (tmp_path / "store" / "change" / "batch=3").mkdir()  # a write that died
    assert held() == [("a", "the batch once more"), ("b", "b1"), ("c", "c1")]
    assert versions.compact(spark, path) == 2
    assert versions.vacuum(spark, path) == ["change/batch=0", "change/batch=1", "change/batch=2", "version/v=1"]
    assert held() == [("a", "the batch once more"), ("b", "b1"), ("c", "c1")] and versions.write_change(rows_at(spark, ("d", 1, "d1")), path) == 3
    assert len(held()) == 4


def test_store_from_a_stream(spark, tmp_path):
    for k in range(3):
        rows_at(spark, ("a", k + 1, f"a{k}"), (f"only {k}", 1, "x")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("fingerprint string, saved_at timestamp, json string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "store")
    q = stream.writeStream.foreachBatch(versions.store_sink(path, 2)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(200) and q.exception() is None
    assert sorted((r.fingerprint, r.json) for r in versions.read_store(spark, path).collect()) == [("a", "a2"), ("only 0", "x"), ("only 1", "x"), ("only 2", "x")]
    assert versions.Files(spark, path).current() == 1


def test_joins_measure_the_side_that_they_broadcast(spark):
    right = spark.createDataFrame([(k, "x" * 100, [1, 2], [("a", 1)], {"k": "v"}, None) for k in range(50)], "k int, t string, n array<int>, s array<struct<a:string,b:int>>, m map<string,string>, z string")
    least = right.agg({"k": "count"}).first()[0] * 100
    size = right.select(frames.row_bytes(right).alias("b")).agg({"b": "sum"}).first()[0]
    assert least < size < 10 * least
    left = spark.range(50).selectExpr("cast(id as int) as k")
    plan = lambda **bound: frames.sized_join(left, right, "k", "inner", **bound)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan() and "broadcast" not in plan(max_bytes=size - 1) and "broadcast" not in plan(max_rows=49)


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(f"d{k:03}",) for k in range(500)], "d string").repartition(7)
    got = {r.d: r.position for r in frames.numbered(df, ["d"]).collect()}
    assert got == {f"d{k:03}": k for k in range(500)}
    assert frames.numbered(df.where("false"), ["d"]).count() == 0


def test_a_reading_is_parsed_once(spark):
    docs = [("ok", "{}"), ("text", "x"), ("list", "[]"), ("null", "null"), ("no list", '{"pedestals": null}'), ("map", '{"grade_slabs": {}}'), ("no map", '{"findings": [1]}'), ("word", '{"title_block": "a"}')]
    good, bad = readings.parse_readings(spark.createDataFrame(docs, "drawing_id string, value string"))
    for df in (good, bad):
        assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("parse_json") + df._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    assert [r.drawing_id for r in good.collect()] == ["ok"]
    want = {"text": "not JSON", "list": "not an object", "null": "not an object", "no list": "pedestals is no list", "map": "grade_slabs is no list", "no map": "findings is no object", "word": "title_block is no object"}
    assert {r.drawing_id: r.reason for r in bad.collect()} == want


def test_a_document_is_looked_into_once_for_all_its_faults(spark):
    docs = {
        "fine": '{"_": 1, "responses": ["a", 1, null, [2, "b"], {"x": []}], "title_block": {"_": [1]}, "findings": {"levels": 5}, "pedestals": [], "position_marks": {"P1": "3", "_": 2.0}}',
        "responses is no list": '{"responses": {"0": 1}}', "grade_slabs is no list": '{"grade_slabs": "none", "title_block": 1}', "transcript_blocks is no list": '{"transcript_blocks": null}',
        "title_block is no object": '{"title_block": ["x"]}', "findings is no object": '{"findings": null, "discovery": 1}', "discovery is no object": '{"discovery": "{}"}',
        "a pedestal lacks its tag, sizes or quantity": '{"pedestals": [{"tag": "P1", "length_mm": "1", "width_mm": 1, "quantity": 2}, "P2"], "position_marks": {"P1": null}}', "a position mark has no whole number": '{"position_marks": {"P1": 1, "P2": null}}',
    }
    good, bad = readings.parse_readings(spark.createDataFrame(list(docs.items()), "drawing_id string, value string"))
    assert [r.drawing_id for r in good.collect()] == ["fine"] and {r.reason: r.drawing_id for r in bad.collect()} == {n: n for n in docs if n != "fine"}
    assert good._jdf.queryExecution().optimizedPlan().toString().count("try_variant_get(") == 4


def test_an_index_bills_nothing(spark, sf, monkeypatch):
    monkeypatch.setattr(rebuild, "billed", None)
    assert bill_queries.QUERIES["rebuild_index"](spark, sf).limit(1).count() == 1


def test_rules_are_seeded_for_drawings_with_a_slab(spark, folder, monkeypatch):
    seeded = []
    monkeypatch.setattr(rebuild, "billed", lambda pedestals, slabs, projects, rules: seeded.append(rules))
    rebuild.summary_of(folder[0], "all")
    rows = seeded[0].collect()
    assert {stem(r.drawing_id) for r in rows} == {"a"} and len(rows) == 7
    assert {r.rule_key: r.params for r in rows}["curb"] == {"height_m": 0.3, "thickness_m": 0.2}


def test_parameters_that_nothing_states_are_passed_on(spark):
    rules = derive.default_rules(spark)
    found = spark.createDataFrame([("a", 0, "curb_wall", None, 300.0), ("b", 0, "blinding", 50.0, None), ("c", 0, "", None, None), ("d", 0, "epoxy", 5.0, None)], "drawing_id string, seq int, kind string, thickness_mm double, height_mm double")
    seeded = derive.seed_rules(rules, found)
    got = {(r.drawing_id, r.rule_key): r.params for r in seeded.collect()}
    want = {(d, r.rule_key): dict(r.params) for d in "abcd" for r in rules.collect()}
    want["a", "curb"]["height_m"], want["b", "blinding"]["thickness_m"], want["b", "excavation"]["blinding_thickness_m"], want["d", "epoxy"]["thickness_mm"] = 0.3, 0.05, 0.05, 5.0
    assert got == want
    text = seeded._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in text[: text.index("map_concat")] and "ELSE params" in text
