"""What the shared steps shuffle and hold: counted in plans, with the same rows as before."""

import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import frames
from plumbline.operators import discovery, geometry, grammar, setviews
from plumbline.plans import catalog, read_queries
from plumbline.sources import synth


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("rows_a_part", [250_000, 500])
@pytest.mark.parametrize("name", synth.BY_DRAWING)
def test_dealt_by_drawing_has_the_rows_of_its_sql(spark, sf, name, rows_a_part, monkeypatch):
    monkeypatch.setattr(frames, "ROWS_A_PART", rows_a_part)
    got = synth.table(spark, sf, name)
    own = spark.sql(synth.SYNTH[name], **{n: synth.table(spark, sf, n) for n in synth.needs(name)})
    assert got.dtypes == own.dtypes
    assert got.count() and got.exceptAll(own).count() == 0 == own.exceptAll(got).count()


def test_rows_of_a_drawing_are_dealt_once(spark, sf, no_broadcast):
    # the rows, their parts, and the projects with their customers; the vote needs nothing but the rows
    assert plan(catalog.QUERIES["element_bill"](spark, sf)).count("Exchange hashpartitioning") == 6
    assert plan(catalog.QUERIES["reconcile"](spark, sf)).count("Exchange hashpartitioning") == 1


def test_the_vote_sorts_once_after_its_count(spark, sf):
    text = plan(catalog.QUERIES["reconcile"](spark, sf))
    assert text.split("ObjectHashAggregate")[0].count("Sort [") == 1


def test_more_rows_make_more_parts(spark, sf, monkeypatch):
    monkeypatch.setattr(frames, "ROWS_A_PART", 500)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert "drawing_key#" in (text := plan(catalog.QUERIES["reconcile"](spark, sf))) and f", {-(-rows // 500)}), REPARTITION_BY_NUM" in text
    assert "REPARTITION_BY_NUM" in plan(catalog.QUERIES["rebuild_set"](spark, sf))


def test_selection_passes_once_over_the_rows(spark, tmp_path):
    rows = [("d", "BOQ", "A", "k1"), ("d", "BOQ", "A", "k2"), ("d", "BOQ", "A", "k1"), ("d", "BOQ", "A", None), ("d", "BOQ", None, "k1"), ("d", "BOQ", "ROLLUP", "k3"), ("d", "BOQ", "ROLLUP", None), ("d", "BOQ", "ROLLUP", "k1")]
    spark.createDataFrame(rows, "drawing_id string, source string, category string, key string").write.parquet(f"{tmp_path}/rows")
    keys = spark.createDataFrame([("k1",), ("k1",), (None,), ("k9",)], "key string")
    got = setviews.apply_selection(spark.read.parquet(f"{tmp_path}/rows"), keys)
    assert got.columns == ["key", "drawing_id", "source", "category"] and plan(got).count("FileScan parquet") == 1
    assert sorted((r.category, str(r.key)) for r in got.collect()) == [("A", "k1"), ("A", "k1"), ("ROLLUP", "None"), ("ROLLUP", "k1"), ("ROLLUP", "k3")]


def test_rollups_move_only_the_kinds_they_count(spark, sf):
    assert len(re.findall(r"as int\) IN \(", plan(catalog.QUERIES["build_bom"](spark, sf)))) >= 2


def test_each_different_text_is_scanned_once(spark, monkeypatch):
    kept, write = [], grammar.written
    monkeypatch.setattr(grammar, "written", lambda df: kept.append(df.count()) or write(df))
    rows = [(f"d{k % 3}", 0, 0, k, "150 THK  SLAB" if k % 2 else "150 THK SLAB", "") for k in range(40)] + [("d9", 0, 0, 1, None, ""), ("d9", 0, 0, 2, "NOTES", "")]
    got = grammar.scan_lines(spark.createDataFrame(rows, "drawing_id string, page int, block_id long, line_no int, text string, grid_ref string")).collect()
    assert kept == [1] and sorted((r.drawing_id, r.line_no, r.kind, r.f1) for r in got) == [(f"d{k}", k, "thickness", 150.0) for k in range(3)]


def test_boxes_of_labels_are_made_once(spark, sf, monkeypatch):
    kept, write = [], geometry.written
    monkeypatch.setattr(geometry, "written", lambda df: kept.append(df.columns) or write(df))
    assert catalog.QUERIES["label_blocks"](spark, sf).count()
    assert kept == [["drawing_id", "page", "line_id", "x0", "y0", "x1", "y1"]]


def test_cells_of_a_sheet_move_before_they_are_rows(spark, sf):
    assert plan(catalog.QUERIES["set_pivot"](spark, sf)).split("Exchange hashpartitioning")[0].count("Aggregate(") == 2


def test_warnings_deal_the_elements_once(spark, sf, no_broadcast, monkeypatch):
    kept, write = [], read_queries.written
    monkeypatch.setattr(read_queries, "written", lambda df: kept.append(df.columns) or write(df))
    text = plan(catalog.QUERIES["plan_warnings"](spark, sf))
    assert kept == [["drawing_id", "kind_no", "pos", "tag", "quantity"]] and "p_partkey" not in text
    assert len(re.findall(r"Exchange hashpartitioning\(drawing_id#\d+, (?:kind|up)#", text)) == 4  # distinct tags are dealt as their join needs them


def test_rows_that_are_searched_are_dealt_once_for_number_and_bill(spark, sf, no_broadcast):
    # the elements' rows and their parts, then by drawing; the projects with their customers, then by drawing; the items
    assert plan(catalog.QUERIES["search_rows"](spark, sf)).count("Exchange hashpartitioning") == 7


def test_rows_meet_their_parts_in_as_many_parts_as_by_drawing(spark, sf, no_broadcast, monkeypatch):
    monkeypatch.setattr(frames, "ROWS_A_PART", 500)
    n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500)
    text = plan(catalog.QUERIES["search_rows"](spark, sf))
    assert re.findall(r"hashpartitioning\([lp]_partkey#\d+L, (\d+)\)", text) == [str(n)] * 2


def test_more_parts_leave_a_broadcast_of_the_parts(spark, sf, monkeypatch):
    monkeypatch.setattr(frames, "ROWS_A_PART", 500)
    text = plan(catalog.QUERIES["search_rows"](spark, sf))
    assert "hashpartitioning(l_partkey#" not in text and "BroadcastHashJoin [l_partkey#" in text


def test_pieces_of_hashes_are_never_broadcast(spark):
    # 68 rows a hash: far more than the hashes that Spark judges them by
    few = spark.range(500).select((F.col("id") * 7919).alias("a"))
    got = geometry.close_hashes(few, few.withColumnRenamed("a", "b"))
    assert sum(r.a == r.b for r in got.collect()) == 500
    assert "Broadcast" not in plan(got)


def test_the_series_is_asked_only_for_sheets_short_of_close_ones(spark, monkeypatch):
    rows = [(f"A-1-1-1-{i}", f"{i % 2:016x}") for i in range(6)] + [("A-1-1-1-9", "f" * 16), ("A-1-1-1-10", None)]
    asked, series = [], geometry.nearest_of_series
    monkeypatch.setattr(geometry, "nearest_of_series", lambda q, e, k: asked.extend(r.q_no for r in q.collect()) or series(q, e, k))
    h = spark.createDataFrame(rows, "drawing_no string, image_hash string")
    got = geometry.find_similar(h, h, 3).collect()
    assert sorted(asked) == ["A-1-1-1-10", "A-1-1-1-9"] and len(got) == 24
    assert {r.tier for r in got if r.q_no not in asked} == {0} and {r.tier for r in got if r.q_no in asked} == {1}


@pytest.mark.parametrize("rows_a_part", [250_000, 500])
def test_what_lines_say_is_not_moved_to_be_merged(spark, sf, rows_a_part, monkeypatch):
    monkeypatch.setattr(frames, "ROWS_A_PART", rows_a_part)
    merged = catalog.QUERIES["discovered_callouts"](spark, sf)
    dealt = [x for x in plan(merged).splitlines() if "Exchange hashpartitioning" in x]
    assert len(dealt) == 1 and "hashpartitioning(drawing_id" in dealt[0] and ("REPARTITION_BY_NUM" in dealt[0]) == (rows_a_part == 500)
    apart = discovery.merge_items(discovery.discover(synth.table(spark, sf, "callouts")).repartition(3))
    assert merged.count() and merged.exceptAll(apart).count() == 0 == apart.exceptAll(merged).count()
