"""Derivation (F): elements that follow from slab geometry under enabled rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.numbers import g_format, rounded

c = F.col
#: The rules in order, with their parameters' defaults (m, except coats and thickness_mm).
RULES = {
    "excavation": {"working_space_m": 0.3, "blinding_thickness_m": 0.075, "fill_thickness_m": 0.15},
    "fill": {"thickness_m": 0.15},
    "blinding": {"offset_m": 0.1, "thickness_m": 0.075},
    "liner": {"thickness_mm": 1.5},
    "epoxy": {"thickness_mm": 4.0, "coats": 2.0},
    "curb": {"height_m": 0.15, "thickness_m": 0.15},
    "joints": {"panel_size_m": 5.0, "backer_rod": 0.0},
}
TARGETS = {"excavation": ("excavation", "EXC-"), "fill": ("compacted_soil", "FILL-"), "blinding": ("pcc_blinding", "PCC-"), "liner": ("hdpe_liner", "HDPE-"), "epoxy": ("epoxy_coating", "EP-"), "curb": ("curb_wall", "CW-"), "joints": ("joint", "CJ-")}


def default_rules(spark: SparkSession) -> DataFrame:
    """F8: (rule_key, rule_no, enabled, params) with everything disabled."""
    rows = [(k, i, False, p) for i, (k, p) in enumerate(RULES.items())]
    return spark.createDataFrame(rows, "rule_key string, rule_no int, enabled boolean, params map<string,double>")


def select_rules(rules: DataFrame, keys: list[str] | str) -> DataFrame:
    """F8: enables the named rules, or all of them for "all"."""
    on = F.lit(True) if keys == "all" else c("rule_key").isin(list(keys))
    return rules.withColumn("enabled", on)


def seed_rules(rules: DataFrame, findings: DataFrame, drawings: DataFrame | None = None) -> DataFrame:
    """(drawing_id, rule_key, rule_no, enabled, params) with parameters that the drawing itself states.

    findings: (drawing_id, seq, kind, thickness_mm, height_mm). The first curb wall sets the curb's size, the first
    epoxy note the coating, the first blinding thickness the blinding and the excavation. With drawings (drawing_id), only for these.
    """
    m = lambda x: rounded(x / 1000, 3)
    first = lambda kind, value: F.min_by(F.when(c("kind") == kind, value), F.when(c("kind") == kind, c("seq")))
    seen = findings.groupBy("drawing_id").agg(first("curb_wall", c("thickness_mm")).alias("curb_t"), first("curb_wall", c("height_mm")).alias("curb_h"), first("epoxy", c("thickness_mm")).alias("epoxy_t"), first("blinding", c("thickness_mm")).alias("blind_t"))
    if drawings is not None:
        seen = seen.join(drawings, "drawing_id", "left_semi")
    both = seen.crossJoin(F.broadcast(rules))
    said = lambda rule, key, value: F.when((c("rule_key") == rule) & value.isNotNull(), F.create_map(F.lit(key), value)).otherwise(F.create_map().cast("map<string,double>"))
    news = [said("curb", "thickness_m", m(c("curb_t"))), said("curb", "height_m", m(c("curb_h"))), said("epoxy", "thickness_mm", c("epoxy_t").cast("double")), said("blinding", "thickness_m", m(c("blind_t"))), said("excavation", "blinding_thickness_m", m(c("blind_t")))]
    fresh = F.map_concat(*news)
    kept = F.map_filter("params", lambda k, _: ~F.map_contains_key(fresh, k))
    # most drawings state nothing for a rule, and its parameters then stay as they are without a map being made
    stated = {"curb": ("curb_t", "curb_h"), "epoxy": ("epoxy_t",), "blinding": ("blind_t",), "excavation": ("blind_t",)}
    changed = F.lit(False)
    for rule, values in stated.items():
        for value in values:
            changed = changed | ((c("rule_key") == rule) & c(value).isNotNull())
    return both.select("drawing_id", "rule_key", "rule_no", "enabled", F.when(changed, F.map_concat(kept, fresh)).otherwise(c("params")).alias("params"))


def derived(slabs: DataFrame, rules: DataFrame) -> DataFrame:
    """(drawing_id, rule_key, kind, tag, length_m, width_m, depth_m, thickness_m, quantity) of each enabled rule and slab.

    slabs: (drawing_id, tag, length_m, width_m, thickness_m). The rules are a handful of rows and are broadcast. A
    rule whose parameter is missing gives null measures and its rows are left out; the others go on.
    """
    p = lambda key: c("params")[key]
    length, width, thick = c("length_m"), c("width_m"), c("thickness_m")
    panel = F.greatest(p("panel_size_m"), F.lit(0.5))
    across, along = F.greatest(F.ceil(length / panel) - 1, F.lit(0)), F.greatest(F.ceil(width / panel) - 1, F.lit(0))
    rule = lambda **kw: F.struct(*[kw.get(n, F.lit(None)).cast("double").alias(n) for n in ("l", "w", "d", "t", "q")])
    r3 = lambda x: rounded(x, 3)
    shape = (
        F.when(c("rule_key") == "excavation", rule(l=r3(length + 2 * p("working_space_m")), w=r3(width + 2 * p("working_space_m")), d=r3(thick + p("blinding_thickness_m") + p("fill_thickness_m")), q=(length + 2 * p("working_space_m")) * (width + 2 * p("working_space_m")) * (thick + p("blinding_thickness_m") + p("fill_thickness_m"))))
        .when(c("rule_key") == "fill", rule(t=p("thickness_m"), q=r3(length * width * p("thickness_m"))))
        .when(c("rule_key") == "blinding", rule(l=r3(length + 2 * p("offset_m")), w=r3(width + 2 * p("offset_m")), t=p("thickness_m"), q=(length + 2 * p("offset_m")) * (width + 2 * p("offset_m")) * p("thickness_m")))
        .when(c("rule_key") == "liner", rule(l=length, w=width, t=p("thickness_mm"), q=length * width))
        .when(c("rule_key") == "epoxy", rule(t=p("thickness_mm"), d=F.floor(p("coats")), q=r3(length * width)))
        .when(c("rule_key") == "curb", rule(l=r3(2 * (length + width)), d=p("height_m"), t=p("thickness_m"), q=r3(2 * (length + width))))
        .when(c("rule_key") == "joints", rule(q=r3(across * width + along * length)))
    )
    target = F.create_map(*[F.lit(x) for k, v in TARGETS.items() for x in (k, v[0])])[c("rule_key")]
    prefix = F.create_map(*[F.lit(x) for k, v in TARGETS.items() for x in (k, v[1])])[c("rule_key")]
    if "drawing_id" in rules.columns:
        both = slabs.join(rules.where("enabled"), "drawing_id")
    else:
        both = slabs.crossJoin(F.broadcast(rules.where("enabled")))
    out = both.select("drawing_id", "rule_key", target.alias("kind"), F.concat(prefix, c("tag")).alias("tag"), shape.alias("s"), explanation().alias("explanation"))
    out = out.where("s.q is not null and (rule_key <> 'joints' or s.q > 0)")
    return out.select("drawing_id", "rule_key", "kind", "tag", c("s.l").alias("length_m"), c("s.w").alias("width_m"), c("s.d").alias("depth_m"), c("s.t").alias("thickness_m"), rounded("s.q", 3).alias("quantity"), "explanation")


def explanation() -> Column:
    """the sum that a derived number comes from, written out with its result."""
    p = lambda key: c("params")[key]
    g = lambda x: g_format(x.cast("double"))
    length, width, thick = c("length_m"), c("width_m"), c("thickness_m")
    total = lambda x, unit: F.concat(F.lit(" = "), F.format_number(x, 2), F.lit(f" {unit}"))
    wider = lambda key: F.concat(F.lit("("), g(length), F.lit(" + 2x"), g(p(key)), F.lit(") x ("), g(width), F.lit(" + 2x"), g(p(key)), F.lit(") x "))
    area = F.concat(g(length), F.lit(" x "), g(width))
    ws, off = p("working_space_m"), p("offset_m")
    depth = thick + p("blinding_thickness_m") + p("fill_thickness_m")
    panel = F.greatest(p("panel_size_m"), F.lit(0.5))
    across, along = F.greatest(F.ceil(length / panel) - 1, F.lit(0)), F.greatest(F.ceil(width / panel) - 1, F.lit(0))
    run = 2 * (length + width)
    return (
        F.when(c("rule_key") == "excavation", F.concat(wider("working_space_m"), F.lit("("), g(thick), F.lit(" slab + "), g(p("blinding_thickness_m")), F.lit(" blinding + "), g(p("fill_thickness_m")), F.lit(" fill)"), total((length + 2 * ws) * (width + 2 * ws) * depth, "m3")))
        .when(c("rule_key") == "blinding", F.concat(wider("offset_m"), g(p("thickness_m")), total((length + 2 * off) * (width + 2 * off) * p("thickness_m"), "m3")))
        .when(c("rule_key") == "fill", F.concat(area, F.lit(" x "), g(p("thickness_m")), total(length * width * p("thickness_m"), "m3")))
        .when(c("rule_key") == "liner", F.concat(area, total(length * width, "m2"), F.lit(" at "), g(p("thickness_mm")), F.lit(" mm")))
        .when(c("rule_key") == "epoxy", F.concat(F.lit("top surface "), area, total(length * width, "m2"), F.lit(" x "), p("coats").cast("int").cast("string"), F.lit(" coats")))
        .when(c("rule_key") == "curb", F.concat(F.lit("perimeter 2 x ("), g(length), F.lit(" + "), g(width), F.lit(")"), total(run, "m"), F.lit(" at "), g(p("height_m")), F.lit(" high x "), g(p("thickness_m")), F.lit(" thick")))
        .when(c("rule_key") == "joints", F.concat(g(panel), F.lit(" m panels: "), across.cast("string"), F.lit(" joint(s) x "), g(width), F.lit(" m + "), along.cast("string"), F.lit(" x "), g(length), total(across * width + along * length, "m")))
    )


def apply_derived(existing: DataFrame, new: DataFrame) -> DataFrame:
    """the derived rows whose (drawing_id, kind, tag) isn't there yet; tags are compared with their case."""
    return new.join(existing.select("drawing_id", "kind", "tag").distinct(), ["drawing_id", "kind", "tag"], "left_anti")
