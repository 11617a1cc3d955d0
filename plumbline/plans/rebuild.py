"""A set rebuilt from saved readings: merge, derive, bill, summary, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.frames import more_parts, written
from plumbline.operators import bill, derive, reconcile, setviews
from plumbline.sources import readings as saved

c = F.col
#: Per cent of wastage of a project that names none.
WASTAGE = {"concrete": 3.0, "rebar": 5.0, "formwork": 10.0, "hdpe": 8.0, "epoxy": 15.0, "pcc": 5.0, "soil": 10.0}
#: Columns of an element beside its key, with their types; a kind leaves those it lacks null.
ELEMENT = {
    "length_m": "double", "width_m": "double", "height_m": "double", "depth_m": "double", "thickness_m": "double", "thickness_mm": "double", "quantity": "int", "grade": "string", "soil_type": "string",
    "rebar_coefficient": "double", "has_top_formwork": "boolean", "wall_thickness_m": "double", "base_thickness_m": "double", "area_m2": "double", "volume_m3": "double", "description": "string",
    "parent_element": "string", "diameter_mm": "int", "cut_length_m": "double", "nos_per_element": "int", "parent_quantity": "int", "coats": "int", "joint_type": "string", "has_waterstop": "boolean",
    "has_sealant": "boolean", "has_backer_rod": "boolean", "embedment_type": "string", "size_description": "string", "unit_weight_kg": "double", "material": "string", "width_mm": "double", "item_type": "string",
}


def as_elements(df: DataFrame, kind: str) -> DataFrame:
    """df as elements of a kind: missing columns are null, other columns are left out."""
    have = set(df.columns)
    cols = [(c(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in ELEMENT.items()]
    pos = c("pos") if "pos" in have else F.lit(0)
    return df.select("drawing_id", F.lit(bill.KINDS.index(kind)).alias("kind_no"), pos.cast("int").alias("pos"), "tag", *cols)


def elements_from_readings(pedestals: DataFrame, slabs: DataFrame) -> DataFrame:
    """Merged pedestals (m) and slabs as elements with the defaults of a reading: RCC_M30, 120 and 80 kg/m3."""
    p = pedestals.withColumn("grade", F.lit("RCC_M30")).withColumn("rebar_coefficient", F.lit(120.0))
    s = slabs.withColumn("grade", F.lit("RCC_M30")).withColumn("rebar_coefficient", F.lit(80.0)).withColumn("has_top_formwork", F.lit(False))
    return as_elements(p, "pedestal").unionByName(as_elements(s, "grade_slab"))


def elements_from_derived(new: DataFrame) -> DataFrame:
    """Derived rows as elements of their kinds, in one projection."""
    kind, null = c("kind"), F.lit(None)
    flat = kind.isin("hdpe_liner", "epoxy_coating")  # their thickness is in mm
    values = {
        "length_m": F.when(kind == "joint", c("quantity")).otherwise(c("length_m")),
        "width_m": c("width_m"),
        "height_m": F.when(kind == "curb_wall", c("depth_m")),
        "depth_m": F.when(kind == "excavation", c("depth_m")),
        "thickness_m": F.when(~flat, c("thickness_m")),
        "thickness_mm": F.when(flat, c("thickness_m")),
        "quantity": F.lit(1),
        "grade": F.when(kind == "pcc_blinding", "PCC_M15").otherwise("RCC_M30"),
        "soil_type": F.lit("ordinary"),
        "rebar_coefficient": F.lit(80.0),
        "area_m2": F.when(kind == "epoxy_coating", c("quantity")),
        "coats": F.when(kind == "epoxy_coating", c("depth_m")),
        "volume_m3": F.when(kind == "compacted_soil", c("quantity")),
        "description": F.when(kind == "compacted_soil", F.concat(F.lit("Compacted fill under "), F.substring("tag", 6, 100))),
        "joint_type": F.lit("contraction"),
        "has_waterstop": F.lit(False),
        "has_sealant": F.lit(True),
        "has_backer_rod": F.lit(False),
    }
    rank = F.array_position(F.array(*[F.lit(k) for k in bill.KINDS]), kind) - 1
    return new.select("drawing_id", rank.cast("int").alias("kind_no"), F.lit(0).alias("pos"), "tag", *[values.get(n, null).cast(t).alias(n) for n, t in ELEMENT.items()])


def rebuild_set(sightings: DataFrame, slabs: DataFrame, projects: DataFrame, rules: DataFrame) -> DataFrame:
    """(category, item, unit, drawing_id, qty) of a set: sightings voted on and merged, elements derived, billed and summed.

    Two wide shuffles: the vote by (drawing, tag), and the sums of the summary. Rules and wastages are small.
    """
    votes = reconcile.reconcile(sightings).withColumn("seq", c("first_seq")).withColumn("height_mm", F.lit(None).cast("double"))
    slabs = written(slabs)  # read three times below, as the elements are twice: what makes them is done once
    return billed(reconcile.merge_into_project(no_pedestals(projects), votes), slabs, projects, rules)


def no_pedestals(projects: DataFrame) -> DataFrame:
    return projects.select("drawing_id", F.lit("").alias("tag"), F.lit(0.0).alias("length_m"), F.lit(0.0).alias("width_m"), F.lit(0.0).alias("height_m"), F.lit(0).alias("quantity")).where(F.lit(False))


def billed(pedestals: DataFrame, slabs: DataFrame, projects: DataFrame, rules: DataFrame) -> DataFrame:
    """Merged pedestals and slabs (cheap to read again) with all that follows from them, as the summary of their bill."""
    read = written(elements_from_readings(pedestals, slabs))
    # only elements of the kinds that rules make can be there already
    kinds = [bill.KINDS.index(kind) for kind, _ in derive.TARGETS.values()]
    same = read.where(c("kind_no").isin(kinds)).select("drawing_id", F.get(F.array(*[F.lit(k) for k in bill.KINDS]), c("kind_no")).alias("kind"), "tag")
    new = derive.apply_derived(same, derive.derived(slabs, rules))
    whole = read.unionByName(elements_from_derived(new))
    # an element has up to three lines, and the sums are made where the join left them
    parts = more_parts(read.sparkSession, 3 * (read.count() + len(derive.RULES) * slabs.count()))
    return setviews.set_summary(bill.element_bill(whole.repartition(parts, "drawing_id") if parts else whole, projects))


def merged_slabs(found: DataFrame) -> DataFrame:
    """The usable slabs of readings in m, the first of a tag without case."""
    first = F.min_by(F.struct("tag", "length_mm", "width_mm", "thickness_mm"), "seq")
    one = found.where("usable").groupBy("drawing_id", F.upper("tag")).agg(first.alias("s"))
    return one.select("drawing_id", "s.tag", *[(c(f"s.{n}_mm") / 1000).alias(f"{n}_m") for n in ("length", "width", "thickness")])


def rebuild_readings(readings: DataFrame, derived: list[str] | str = (), wastage: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """G19 from saved readings (drawing_id, v), see parse_readings: the set's summary, and an index row a drawing.

    The parsed documents are written once and each table takes the fields that it asks for from there.
    """
    readings = written(readings)
    return summary_of(readings, derived, wastage), index_of(readings)


def pedestals_of(readings: DataFrame) -> DataFrame:
    """The pedestals of readings, each reading merged into an empty project (a reading is a drawing, whatever number it prints)."""
    return reconcile.merge_into_project(no_pedestals(readings), saved.pedestals(readings))


def summary_of(readings: DataFrame, derived: list[str] | str = (), wastage: DataFrame | None = None) -> DataFrame:
    """The set's summary of readings that are cheap to read again.

    The named rules ("all" or their keys) derive elements with the parameters that a reading's findings state, and all
    is billed and summed. wastage: (drawing_id, wastage_*) of projects; without it the defaults hold.
    """
    projects = readings.select("drawing_id", *[F.lit(v).alias(f"wastage_{k}") for k, v in WASTAGE.items()]) if wastage is None else wastage
    slabs = written(merged_slabs(saved.slabs(readings)))
    rules = derive.select_rules(derive.default_rules(readings.sparkSession), derived)
    none = [F.lit(None).cast("double").alias(n) for n in ("thickness_mm", "height_mm")]
    stated = saved.findings(readings, ("curb_walls", "epoxy", "thicknesses")).select("drawing_id", "seq", "kind", F.nullif("thickness_mm", F.lit(0.0)).alias("thickness_mm"), F.nullif("height_mm", F.lit(0.0)).alias("height_mm"))
    # rules are for drawings with a slab, whether these state anything or not
    drawings = slabs.select("drawing_id", F.lit(-1).alias("seq"), F.lit("").alias("kind"), *none)
    seeded = derive.seed_rules(rules, stated.unionByName(drawings), slabs.select("drawing_id"))
    return billed(pedestals_of(readings), slabs, projects, seeded)


def index_of(readings: DataFrame) -> DataFrame:
    """An index row a drawing of readings that are cheap to read again: drawing_no, source_pdf, the numbers of pedestals, slabs, marks and items, and the notes. Nothing is billed for it."""
    titles = saved.titles(readings)
    held = F.abs(c("height_m") - reconcile.PLACEHOLDER_M) < 1e-9
    p = pedestals_of(readings).groupBy("drawing_id").agg(F.count("*").alias("n_pedestals"), F.array_join(F.array_sort(F.collect_set(F.when(held, c("tag")))), ", ").alias("held"))
    n_slabs = merged_slabs(saved.slabs(readings)).groupBy("drawing_id").agg(F.count("*").alias("n_slabs"))
    numbers = ("n_slabs", "n_marks", "n_items")
    index = titles.select("drawing_id", "drawing_no", "source_pdf", "used_text_layer")
    for df in (p, n_slabs, saved.counts(readings)):
        index = index.join(df, "drawing_id", "left")
    index = index.na.fill(0, ["n_pedestals", *numbers]).na.fill("", ["held"])
    empty = (c("n_pedestals") + c("n_slabs")) == 0
    notes = [
        F.when(c("used_text_layer"), "read from the sheet's own text layer (no model calls)"),
        F.when(c("held") != "", F.concat(F.lit("placeholder height on "), "held")),
        F.when(empty & (c("n_items") > 0), F.concat(F.lit("no pedestal or slab on this sheet — "), c("n_items").cast("string"), F.lit(" item(s) read from the drawing's own wording instead"))).when(empty, "no quantities on this sheet — marks and findings only"),
    ]
    return index.select("drawing_id", "drawing_no", "source_pdf", "n_pedestals", *numbers, F.concat_ws(" | ", *notes).alias("notes"))
