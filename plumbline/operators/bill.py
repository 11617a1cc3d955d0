"""Takeoff (E): elements expanded into wastage-adjusted bill lines, with details, bar schedule and rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbers import rounded

#: Element kinds in build order, and unit weights of bars in kg/m by diameter in mm.
KINDS = ("excavation", "pcc_blinding", "pedestal", "grade_slab", "sump", "curb_wall", "formwork", "rebar_bar", "hdpe_liner", "compacted_soil", "epoxy_coating", "joint", "embedment", "waterstop", "sump_ancillary")
KG_PER_M = {6: 0.222, 8: 0.395, 10: 0.617, 12: 0.888, 16: 1.578, 20: 2.466, 25: 3.854, 28: 4.834, 32: 6.313, 40: 9.865}
STRUCTURAL, PCC, ROLLUP = "Structural Concrete", "PCC / Blinding", "ROLLUP"

c = F.col


def kg_per_m(diameter: Column) -> Column:
    """Unit weight of a bar; null for a diameter that isn't made."""
    return F.create_map(*[F.lit(x) for kv in KG_PER_M.items() for x in kv])[diameter]


def concrete_volume(kind: Column) -> Column:
    """m3 of concrete in a pedestal, slab, sump or curb wall."""
    depth = c("depth_m") - c("base_thickness_m")
    walls = 2 * c("length_m") * c("wall_thickness_m") * depth + 2 * (c("width_m") - 2 * c("wall_thickness_m")) * c("wall_thickness_m") * depth
    return (
        F.when(kind == "pedestal", c("length_m") * c("width_m") * c("height_m") * c("quantity"))
        .when(kind == "grade_slab", c("length_m") * c("width_m") * c("thickness_m"))
        .when(kind == "sump", c("length_m") * c("width_m") * c("base_thickness_m") + walls)
        .when(kind == "curb_wall", c("length_m") * c("height_m") * c("thickness_m"))
    )


def formwork_area(kind: Column) -> Column:
    """m2 of formwork of the same elements."""
    li, wi = c("length_m") - 2 * c("wall_thickness_m"), c("width_m") - 2 * c("wall_thickness_m")
    depth = c("depth_m") - c("base_thickness_m")
    around = 2 * (c("length_m") + c("width_m"))
    return (
        F.when(kind == "pedestal", around * c("height_m") * c("quantity"))
        .when(kind == "grade_slab", around * c("thickness_m") + F.when(c("has_top_formwork"), c("length_m") * c("width_m")).otherwise(0.0))
        .when(kind == "sump", around * depth + 2 * (li + wi) * depth + li * wi)
        .when(kind == "curb_wall", 2 * c("length_m") * c("height_m"))
    )


def bill_line(category: str, item: Column, unit: Column | str, net: Column, wastage: Column | float, only: Column | None = None) -> Column:
    """One line as a struct, or null where ``only`` doesn't hold. Net and gross are both rounded from the full net."""
    w = F.lit(wastage) if isinstance(wastage, float) else wastage
    net = net.cast("double")
    line = F.struct(F.lit(category).alias("category"), item.alias("item"), (F.lit(unit) if isinstance(unit, str) else unit).alias("unit"), rounded(net, 3).alias("qty_net"), w.cast("double").alias("wastage_pct"), rounded(net * (1 + w / 100), 3).alias("qty_gross"))
    return line if only is None else F.when(only, line)


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def concrete_lines(kind: str, label: str, form: Column) -> Column:
    k = F.lit(kind)
    vol, kg = concrete_volume(k), concrete_volume(k) * c("rebar_coefficient")
    return F.array(
        bill_line(STRUCTURAL, text(c("grade"), f" - {label} ", c("tag")), "m3", vol, c("wastage_concrete")),
        bill_line("Formwork", form, "m2", formwork_area(k), c("wastage_formwork")),
        bill_line("Rebar (coefficient)", text("Rebar for ", c("tag"), " @ ", c("rebar_coefficient"), " kg/m³"), "kg", kg, c("wastage_rebar"), kg > 0),
    )


def element_lines() -> dict[str, Column]:
    """The lines of each kind of element as an array column; conditional ones are null."""
    named = F.initcap(F.replace(c("embedment_type"), F.lit("_"), F.lit(" ")))
    run = (c("item_type") == "drain_pipe") & c("length_m").isNotNull() & (c("length_m") > 0)
    joint = lambda what, flag: bill_line("Joint accessories", text(f"{what} for ", c("tag")), "m", c("length_m"), 0.0, flag)
    return {
        "excavation": F.array(bill_line("Earthwork", text("Excavation (", c("soil_type"), ")"), "m3", c("length_m") * c("width_m") * c("depth_m") * c("quantity"), 0.0)),
        "pcc_blinding": F.array(bill_line(PCC, text(c("grade"), " blinding"), "m3", c("length_m") * c("width_m") * c("thickness_m") * c("quantity"), c("wastage_pcc"))),
        "pedestal": concrete_lines("pedestal", "Pedestal", text("Pedestal ", c("tag"))),
        "grade_slab": concrete_lines("grade_slab", "Grade Slab", text("Grade Slab ", c("tag"), F.when(c("has_top_formwork"), " (edges + top)").otherwise(" (edges)"))),
        "sump": concrete_lines("sump", "Sump", text("Sump ", c("tag"))),
        "curb_wall": concrete_lines("curb_wall", "Curb Wall", text("Curb Wall ", c("tag"))),
        "formwork": F.array(bill_line("Formwork", text("Loose formwork: ", F.coalesce(F.nullif(c("description"), F.lit("")), c("tag"))), "m2", c("area_m2"), c("wastage_formwork"))),
        "rebar_bar": F.array(bill_line("Rebar (manual BBS)", text(c("diameter_mm"), "mm bar ", c("tag"), " for ", c("parent_element")), "kg", bar_weight(), c("wastage_rebar"))),
        "hdpe_liner": F.array(bill_line("HDPE Liner", text("HDPE liner ", c("thickness_mm"), "mm"), "m2", c("length_m") * c("width_m"), c("wastage_hdpe"))),
        "compacted_soil": F.array(bill_line("Earthwork", text("Compacted fill: ", F.coalesce(F.nullif(c("description"), F.lit("")), c("tag"))), "m3", c("volume_m3"), c("wastage_soil"))),
        "epoxy_coating": F.array(bill_line("Epoxy Coating", text("Acid-resistant epoxy ", c("thickness_mm"), "mm × ", c("coats"), " coats"), "m2", c("area_m2") * c("coats"), c("wastage_epoxy"))),
        "joint": F.array(bill_line("Joints", text(F.initcap(c("joint_type")), " joint"), "m", c("length_m"), 0.0), joint("Waterstop", c("has_waterstop")), joint("Sealant", c("has_sealant")), joint("Backer rod", c("has_backer_rod"))),
        "embedment": F.array(bill_line("Embedments", text(named, ": ", c("size_description")), "Nos", c("quantity"), 0.0), bill_line("Embedments", text("Weight — ", named, " ", c("tag")), "kg", c("unit_weight_kg") * c("quantity"), 0.0, c("unit_weight_kg").isNotNull())),
        "waterstop": F.array(bill_line("Joint accessories", text("Waterstop ", c("material"), " ", c("width_mm"), "mm (standalone)"), "m", c("length_m"), 0.0)),
        "sump_ancillary": F.array(bill_line("Sump Ancillaries", F.when(run, text("Drain pipe: ", c("size_description"))).otherwise(text(F.initcap(F.replace(c("item_type"), F.lit("_"), F.lit(" "))), ": ", c("size_description"))), F.when(run, "m").otherwise("Nos"), F.when(run, c("length_m") * c("quantity")).otherwise(c("quantity").cast("double")), 0.0)),
    }


def bar_weight() -> Column:
    return c("cut_length_m") * c("nos_per_element") * c("parent_quantity") * kg_per_m(c("diameter_mm"))


def priced_elements(elements: DataFrame, projects: DataFrame) -> DataFrame:
    """Elements with their kind's name and their project's wastages."""
    names = F.array(*[F.lit(k) for k in KINDS])
    waste = projects.select("drawing_id", *[w for w in projects.columns if w.startswith("wastage_")])
    return elements.withColumn("kind", F.get(names, c("kind_no"))).join(waste, "drawing_id")


def element_bill(elements: DataFrame, projects: DataFrame) -> DataFrame:
    """(drawing_id, kind_no, pos, sub, category, item, unit, qty_net, wastage_pct, qty_gross, source_tag).

    One pass over the elements: the lines of an element are an array, exploded in place. Elements of an unknown kind
    give no line; a null measure gives a line with null quantities, except where a condition on it leaves it out.
    """
    rows = priced_elements(elements, projects)
    lines = reduce(lambda acc, kv: acc.when(c("kind") == kv[0], kv[1]), element_lines().items(), F)
    out = rows.select("drawing_id", "kind_no", "pos", c("tag").alias("source_tag"), F.posexplode(lines).alias("sub", "line"))
    return out.where("line is not null").select("drawing_id", "kind_no", "pos", "sub", "line.*", "source_tag")


def rebar_schedule(elements: DataFrame, projects: DataFrame) -> DataFrame:
    """Bars to bend: coefficient rows (no diameter), then manual ones; weights to 2 places."""
    rows = priced_elements(elements, projects)
    label = F.when(c("kind") == "pedestal", "Pedestal ").when(c("kind") == "grade_slab", "Grade Slab ").when(c("kind") == "sump", "Sump ").when(c("kind") == "curb_wall", "Curb Wall ")
    kg = concrete_volume(c("kind")) * c("rebar_coefficient")
    coeff = rows.where(kg > 0).select("drawing_id", "kind_no", "pos", text(label, c("tag")).alias("parent_element"), F.lit("COEFF").alias("bar_mark"), F.lit(None).cast("int").alias("diameter_mm"), F.lit(None).cast("int").alias("nos"), F.lit(None).cast("double").alias("total_length_m"), rounded(kg, 2).alias("weight_kg"))
    n = c("nos_per_element") * c("parent_quantity")
    manual = rows.where(c("kind") == "rebar_bar").select("drawing_id", "kind_no", "pos", "parent_element", c("tag").alias("bar_mark"), "diameter_mm", n.alias("nos"), rounded(c("cut_length_m") * n, 2).alias("total_length_m"), rounded(bar_weight(), 2).alias("weight_kg"))
    return coeff.unionByName(manual)


def concrete_rollup(lines: DataFrame) -> DataFrame:
    """Gross m3 of structural concrete and blinding by grade, from the rounded lines."""
    grade = F.when(c("item").contains(" - "), F.substring_index("item", " - ", 1)).otherwise(F.substring_index("item", " ", 1))
    return lines.where(c("category").isin(STRUCTURAL, PCC)).groupBy("drawing_id", grade.alias("grade")).agg(rounded(F.sum("qty_gross"), 3).alias("qty"))


def rebar_rollup(schedule: DataFrame) -> DataFrame:
    """Kg by diameter from manual bars, and one bucket (null diameter) for coefficient rows, only if above 0."""
    return schedule.groupBy("drawing_id", "diameter_mm").agg(rounded(F.sum("weight_kg"), 2).alias("weight_kg")).where(c("diameter_mm").isNotNull() | (c("weight_kg") > 0))


def build_bom(elements: DataFrame, projects: DataFrame) -> DataFrame:
    """The element lines and the rollup lines of every drawing; sort by (drawing_id, kind_no, pos, sub) to read."""
    lines = element_bill(elements, projects)
    # the rollups leave out the other kinds before any row moves, and need no place in the order
    has = lambda *kinds: elements.where(c("kind_no").isin([KINDS.index(k) for k in kinds]))
    poured = has("pcc_blinding", "pedestal", "grade_slab", "sump", "curb_wall")
    conc = concrete_rollup(element_bill(poured, projects)).select("drawing_id", F.lit(100).alias("kind_no"), text("Total concrete — ", c("grade")).alias("item"), F.lit("m3").alias("unit"), c("qty").alias("q"))
    name = F.when(c("diameter_mm").isNull(), "Total rebar — coefficient-based (unclassified dia)").otherwise(text("Total rebar — ", c("diameter_mm"), "mm"))
    bars = rebar_rollup(rebar_schedule(has("pedestal", "grade_slab", "sump", "curb_wall", "rebar_bar"), projects)).select("drawing_id", F.when(c("diameter_mm").isNull(), 102).otherwise(101).alias("kind_no"), name.alias("item"), F.lit("kg").alias("unit"), c("weight_kg").alias("q"))
    roll = conc.unionByName(bars).select("drawing_id", "kind_no", F.lit(0).alias("pos"), F.lit(0).alias("sub"), F.lit(ROLLUP).alias("category"), "item", "unit", c("q").alias("qty_net"), F.lit(0.0).alias("wastage_pct"), c("q").alias("qty_gross"), F.lit("rollup").alias("source_tag"))
    return lines.unionByName(roll)


def double_count_warnings(elements: DataFrame) -> DataFrame:
    """Tags with a rebar coefficient above 0 and manual bars for them."""
    kinds = [KINDS.index(k) for k in ("pedestal", "grade_slab", "sump", "curb_wall")]
    coeff = elements.where(c("kind_no").isin(kinds) & (c("rebar_coefficient") > 0)).select("drawing_id", "tag")
    bars = elements.where(c("kind_no") == KINDS.index("rebar_bar")).select("drawing_id", F.regexp_extract("parent_element", r"(\S+)$", 1).alias("tag"))
    return coeff.join(bars, ["drawing_id", "tag"], "left_semi").distinct()


def element_details(elements: DataFrame, projects: DataFrame) -> DataFrame:
    """The detail rows of pedestals, slabs, sumps, joints, coatings and embedments in one long table."""
    rows = priced_elements(elements, projects)
    kinds = ("pedestal", "grade_slab", "sump", "joint", "epoxy_coating", "embedment")
    conc = c("kind").isin("pedestal", "grade_slab", "sump")
    return rows.where(c("kind").isin(*kinds)).select(
        "drawing_id", "kind", "pos", "tag",
        F.when(conc, rounded(concrete_volume(c("kind")), 3)).alias("concrete_m3"),
        F.when(conc, rounded(formwork_area(c("kind")), 3)).alias("formwork_m2"),
        F.when(conc, rounded(concrete_volume(c("kind")) * c("rebar_coefficient"), 2)).alias("rebar_kg"),
        F.when(c("kind") == "joint", c("length_m")).alias("joint_m"),
        F.when(c("kind") == "epoxy_coating", rounded(c("area_m2") * c("coats"), 3)).alias("coated_m2"),
        F.when(c("kind") == "embedment", rounded(c("unit_weight_kg") * c("quantity"), 2)).alias("weight_kg"),
    )


def headline_metrics(lines: DataFrame) -> DataFrame:
    """Gross concrete, rebar, formwork and excavation of each drawing."""
    total = lambda cond: rounded(F.coalesce(F.sum(F.when(cond, c("qty_gross"))), F.lit(0.0)), 3)
    return lines.groupBy("drawing_id").agg(
        total(c("category").isin(STRUCTURAL, PCC)).alias("concrete_m3"),
        total(c("category").startswith("Rebar")).alias("rebar_kg"),
        total(c("category") == "Formwork").alias("formwork_m2"),
        total((c("category") == "Earthwork") & c("item").contains("Excavation")).alias("excavation_m3"),
    )


def elements_from_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text rows (drawing_id, tag, length_m, width_m, height_m, quantity, grade, rebar_coefficient) as typed pedestals, and rejects with a reason.

    Rows with nothing in them and rows with a blank tag are left out of both. Missing grades and coefficients take
    their defaults; sizes and counts must be positive numbers.
    """
    num = lambda name: F.expr(f"try_cast({name} as double)")
    filled = reduce(lambda a, b: a | b, [F.trim(F.coalesce(x, F.lit(""))) != "" for x in map(c, ("tag", "length_m", "width_m", "height_m", "quantity"))])
    kept = rows.where(filled & (F.trim(F.coalesce(c("tag"), F.lit(""))) != ""))
    reason = (
        F.when(~F.coalesce(num("length_m") > 0, F.lit(False)), "length_m")
        .when(~F.coalesce(num("width_m") > 0, F.lit(False)), "width_m")
        .when(~F.coalesce(num("height_m") > 0, F.lit(False)), "height_m")
        .when(~F.coalesce(F.expr("try_cast(quantity as int)") > 0, F.lit(False)), "quantity")
    )
    kept = kept.withColumn("reason", reason)
    good = kept.where("reason is null").select("drawing_id", F.trim("tag").alias("tag"), num("length_m").alias("length_m"), num("width_m").alias("width_m"), num("height_m").alias("height_m"), F.expr("try_cast(quantity as int)").alias("quantity"), F.coalesce(F.nullif(F.trim("grade"), F.lit("")), F.lit("RCC_M30")).alias("grade"), F.coalesce(num("rebar_coefficient"), F.lit(120.0)).alias("rebar_coefficient"))
    return good, kept.where("reason is not null").select("drawing_id", "tag", "reason")
