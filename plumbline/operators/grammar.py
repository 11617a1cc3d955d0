"""Text grammars (B1-B16): callouts and specifications read from lines of drawing text by native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.frames import sized_join, spread, written

c = F.col
# The callouts' patterns, and the bounds that a reading must keep.
NOS = r"\s*(?:N\s*[o0O]\s*s?|NOS|N[o0O]\.)"
PEDESTAL_2D = r"(?i)\b(P\s?\d{1,2})\b\s*[\(\[]\s*(\d{2,4})\s*[x×X*]\s*(\d{2,4})\s*[\)\]]\s*[-–—:]?\s*(\d{1,3})" + NOS
PEDESTAL_3D = r"(?i)\b(P\s?\d{1,2})\b\s*[\(\[]\s*(\d{2,4})\s*[x×X*]\s*(\d{2,4})\s*[x×X*]\s*(\d{2,4})\s*[\)\]]\s*[-–—:]?\s*(\d{1,3})" + NOS
THICKNESS = r"(?i)\(?\s*(\d{2,4})\s*THK\s*\)?"
TOC = r"(?i)TOC\s*\.?\s*EL\.?\s*([0-9]{1,3}\.[0-9]{2,3})"
CURB = r"(?i)CURB\s*WALL\s*(\d{2,4})\s*THK\s*[x×X]\s*(\d{2,4})\s*HIGH"
SUMP = r"(?i)SUMP\s*(?:PIT)?\s*(\d{3,4})\s*[x×X]\s*(\d{3,4})"
LEVEL = r"(?i)\b(TOC|FGL|BOC|HPP|LPP|IL|FFL|NGL)\b\s*\.?\s*(?:EL\.?)?\s*(\d{1,3}\.\d{2,3})"
PLATE = r"(?i)INSERT\s*PLATE\s*TYPE\s*([A-Z]\s?\d{1,2}\s?[a-z]?)"
EPOXY = r"(?i)(\d{1,2})\s*MM\s*THK\s*ACID\s*RESISTANT"
BAR_COUNT = r"(?i)\(?(\d{1,3})\)?\s*[-–—]\s*[DØø]\s?(\d{1,2})\b"
BAR_SPACING = r"(?i)[DØø]\s?(\d{1,2})\s*(?:[-–—@]|\s)\s*(\d{2,3})\s*(?:c/c|LINKS|CTS)?"
BLINDING = r"(?i)(\d{2,4})\s*THK\s*(?:PCC|BLINDING)"
DIAMETERS = (6, 8, 10, 12, 16, 20, 25, 28, 32, 40)
PEDESTAL_MM, PEDESTAL_NOS, SLAB_MM, SLAB_THICK_MM, LEVEL_M = (150, 3000), (1, 999), (500, 500_000), (75, 2000), (0, 500)
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")

FINDING = "array<struct<kind:string,f1:double,f2:double,f3:double,txt:string>>"


def normalised(text: Column) -> Column:
    """Whitespace folded to single blanks and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def number(text: Column, kind: str = "double") -> Column:
    return F.nullif(text, F.lit("")).try_cast(kind)


def parse_pedestal(text: Column) -> Column:
    """B1: (tag, length_mm, width_mm, height_mm, quantity) of the first callout, or null; three dimensions are looked for first, over the whole text."""
    def part(pattern: str, places: tuple[int | None, ...]) -> Column:
        get = lambda i: F.regexp_extract(text, pattern, i)
        tag, length, width, height, qty = places
        return F.when(F.rlike(text, F.lit(pattern)), F.struct(F.upper(F.replace(get(tag), F.lit(" "), F.lit(""))).alias("tag"), number(get(length)).alias("length_mm"), number(get(width)).alias("width_mm"), (number(get(height)) if height else F.lit(None).cast("double")).alias("height_mm"), number(get(qty), "int").alias("quantity")))

    return F.coalesce(part(PEDESTAL_3D, (1, 2, 3, 4, 5)), part(PEDESTAL_2D, (1, 2, 3, None, 4)))


def outside(value: Column, bounds: tuple[int, int]) -> Column:
    return F.coalesce(~value.between(*bounds), F.lit(True))


def validate_pedestal(tag: Column, length: Column, width: Column, quantity: Column) -> Column:
    """B2: (ok, reason): the first of tag, length, width and quantity that is missing or implausible."""
    bare = F.upper(F.replace(F.coalesce(tag, F.lit("")), F.lit(" "), F.lit("")))
    reason = F.when(~F.rlike(bare, F.lit(r"^P\d{1,2}$")), "tag").when(outside(length, PEDESTAL_MM), "length_mm").when(outside(width, PEDESTAL_MM), "width_mm").when(outside(quantity, PEDESTAL_NOS), "quantity")
    return F.struct(reason.isNull().alias("ok"), F.coalesce(reason, F.lit("")).alias("reason"))


def parse_thickness(text: Column) -> Column:
    """Millimetres of the first thickness, or null."""
    return number(F.regexp_extract(text, THICKNESS, 1))


def parse_toc(text: Column) -> Column:
    """The level after TOC EL, as written; empty if there is none."""
    return F.coalesce(F.regexp_extract(text, TOC, 1), F.lit(""))


def validate_grade_slab(length: Column, width: Column, thickness: Column) -> Column:
    """(ok, reason); a slab longer across than along passes with a remark."""
    reason = F.when(outside(length, SLAB_MM), "length_mm").when(outside(width, SLAB_MM), "width_mm").when(outside(thickness, SLAB_THICK_MM), "thickness_mm")
    return F.struct(reason.isNull().alias("ok"), F.coalesce(reason, F.when(length < width, "length < width"), F.lit("")).alias("reason"))


def normalise_date(raw: Column) -> Column:
    """(date as YYYY-MM-DD or empty, note): a month's name, else numbers, day first unless the first is above 31."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    named, plain = r"^(\d{1,2})\s*[-/ ]\s*([A-Za-z]{3,9})\s*[-/ ]\s*(\d{2,4})$", r"^(\d{1,4})\s*[/\-.]\s*(\d{1,2})\s*[/\-.]\s*(\d{1,4})$"
    year = lambda y: F.when(y >= 100, y).when(y < 80, y + 2000).otherwise(y + 1900)
    day = lambda y, m, d: F.date_format(F.try_to_date(F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd")
    get = lambda p, i: number(F.regexp_extract(text, p, i), "int")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.upper(F.substring(F.regexp_extract(text, named, 2), 1, 3))).cast("int")
    a, b, z = get(plain, 1), get(plain, 2), get(plain, 3)
    is_named, is_plain = F.rlike(text, F.lit(named)) & (month > 0), F.rlike(text, F.lit(plain))
    first_named = day(year(get(named, 3)), month, get(named, 1))
    numbers = F.when(a > 31, day(year(a), b, z)).otherwise(day(year(z), b, a))
    unclear = (a <= 12) & (b <= 12) & (a != b)
    out = F.when(text == "", "").when(is_named, F.coalesce(first_named, F.lit(""))).when(is_plain, F.coalesce(numbers, F.lit(""))).otherwise("")
    note = F.when(text == "", "").when((is_named | is_plain) & (out == ""), "not a calendar date").when(is_named, "").when(is_plain & unclear, "ambiguous").when(is_plain, "").otherwise("unknown format")
    return F.struct(out.alias("date"), note.alias("note"))


def clean_drawing_no(text: Column) -> Column:
    """The number alone: long dashes folded, its label and other characters taken off."""
    t = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "[–—]", "-")
    t = F.regexp_replace(t, r"(?i)^(DRAWING\s*(NUMBER|NO\.?)\s*[:\-]?\s*)", "")
    return F.btrim(F.regexp_replace(t, r"[^A-Za-z0-9\-_/]", ""), F.lit("-_/ "))


def clean_revision(text: Column) -> Column:
    """Letters and digits of a revision, upper case, without its label."""
    t = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?i)^(REV(ISION)?\.?\s*[:\-]?\s*)", "")
    return F.upper(F.regexp_replace(t, "[^A-Za-z0-9]", ""))


def clean_project_name(text: Column) -> Column:
    """Whitespace folded."""
    return normalised(text)


def finding(kind: str, f1: Column | None = None, f2: Column | None = None, f3: Column | None = None, txt: Column | None = None) -> Column:
    num = lambda x: (F.lit(None) if x is None else x).cast("double")
    return F.struct(F.lit(kind).alias("kind"), num(f1).alias("f1"), num(f2).alias("f2"), num(f3).alias("f3"), (F.lit(None) if txt is None else txt).cast("string").alias("txt"))


def matches(text: Column, pattern: str, build, groups: int) -> Column:
    """An array with build(group 1, group 2, ...) of every match of a pattern."""
    got = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)]
    return F.transform(got[0], lambda x, i: build(x, *[F.get(g, i) for g in got[1:]]))


def line_findings(text: Column) -> Column:
    """Everything the grammars read in one line, in their order, as one array."""
    level = matches(text, LEVEL, lambda k, v: finding("level", number(v), txt=F.upper(k)), 2)
    count = matches(text, BAR_COUNT, lambda n, d: finding("rebar", number(n), number(d)), 2)
    spacing = matches(text, BAR_SPACING, lambda d, s: finding("rebar", None, number(d), number(s)), 2)
    thick = parse_thickness(text)
    ped = parse_pedestal(text)
    good = validate_pedestal(ped["tag"], ped["length_mm"], ped["width_mm"], ped["quantity"])["ok"]
    one = lambda cond, x: F.when(cond, F.array(x)).otherwise(F.array().cast(FINDING))
    return F.concat(
        matches(text, CURB, lambda t, h: finding("curb_wall", number(t), number(h)), 2),
        matches(text, SUMP, lambda a, b: finding("sump", number(a), number(b)), 2),
        F.filter(level, lambda x: x["f1"].between(*LEVEL_M)),
        matches(text, PLATE, lambda t: finding("insert_plate", txt=F.regexp_replace(t, r"\s+", "")), 1),
        matches(text, EPOXY, lambda t: finding("epoxy", number(t)), 1),
        F.filter(count, lambda x: x["f1"].between(1, 200) & x["f2"].isin(*DIAMETERS)),
        F.filter(spacing, lambda x: x["f3"].between(50, 500) & x["f2"].isin(*DIAMETERS)),
        one(F.coalesce(thick.between(*SLAB_THICK_MM), F.lit(False)), finding("thickness", thick)),
        matches(text, BLINDING, lambda t: finding("blinding", number(t)), 1),
        one(F.coalesce(good, F.lit(False)), finding("pedestal", ped["length_mm"], ped["width_mm"], ped["quantity"], ped["tag"])),
    )


def all_findings(lines: DataFrame) -> DataFrame:
    """One row for each finding of each line; lines: (drawing_id, page, block_id, line_no, text, grid_ref).

    What a line gives follows from its text, so each different text is scanned once and its findings exploded once.
    """
    rows = lines.withColumn("text", normalised(c("text"))).where("text <> ''")
    found = written(spread(rows.select("text").distinct()).select("text", F.posexplode(line_findings(c("text"))).alias("at", "f")))
    return sized_join(rows, found, "text", "inner").select("drawing_id", "page", "block_id", "line_no", "at", "grid_ref", "text", "f.*")


def signature() -> Column:
    """What makes two findings the same: a pedestal's tag, else kind and values. A blinding keeps its kind."""
    return F.when(c("kind") == "pedestal", F.struct(c("kind"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"), F.lit(None).cast("double").alias("d"), c("txt"))).otherwise(F.struct(c("kind"), c("f1").alias("a"), c("f2").alias("b"), c("f3").alias("d"), c("txt")))


def scan_lines(lines: DataFrame) -> DataFrame:
    """The findings of every sheet, each signature once, where it was read first."""
    order = Window.partitionBy("drawing_id", "page", "sig").orderBy("block_id", "line_no", "at")
    out = all_findings(lines).withColumn("sig", signature()).withColumn("k", F.row_number().over(order))
    return out.where("k = 1").drop("k", "sig")


def scan_with_provenance(lines: DataFrame) -> DataFrame:
    """Pedestals at every sighting, other findings once, at the first place on the sheet that has a grid reference if any has."""
    by = Window.partitionBy("drawing_id", "page", "sig").orderBy("block_id", "line_no", "at")
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = all_findings(lines).withColumn("sig", signature())
    out = out.withColumn("k", F.row_number().over(by)).withColumn("place", F.first(F.nullif("grid_ref", F.lit("")), ignorenulls=True).over(every))
    out = out.where("kind = 'pedestal' or k = 1")
    return out.withColumn("grid_ref", F.when(c("kind") == "pedestal", c("grid_ref")).otherwise(F.coalesce(F.nullif("grid_ref", F.lit("")), "place", F.lit("")))).drop("k", "sig", "place")


def dedupe_pedestals(found: DataFrame) -> DataFrame:
    """One pedestal for each tag, one with a location if there is any, else the first."""
    w = Window.partitionBy("drawing_id", "txt").orderBy(F.coalesce("grid_ref", F.lit("")) == "", "page", "block_id", "line_no", "at")
    return found.where("kind = 'pedestal'").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
