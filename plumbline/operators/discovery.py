"""Discovery (B17-B33): items that a sheet names and measures in its own words, with no list of elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.frames import more_parts, sized_join, spread, written
from plumbline.functions.numbers import rounded

from .grammar import DIAMETERS, normalised, number

c = F.col
# Drafting furniture, references, words that end a phrase, words that only specify, patterns and bounds.
FURNITURE = (
    r"(?i)^\s*(?:SECTION\b|DETAIL\b|SCALE\b|\(?SCALE|ELEVATION\s+[A-Z]?-?[A-Z]?\s*$|VIEW\b|LOOKING\s+(?:NORTH|SOUTH|EAST|WEST)|KEY\s*PLAN|(?:PLANT|TRUE)\s+NORTH|PREVAILING\s+WIND|MAKKAH"
    r"|REV(?:ISION)?\b|DRAWING\s*(?:NUMBER|NO)|DRG\.?\s*NO|SHEET\b|TITLE\s*$|REMARK|NOTES?\s*:?|LEGEND|ISSUED\s+FOR|REACTION\s+TABLE|MAX\.?\s*(?:COMPRESSION|TENSION)|MOMENT\b|HORIZONTAL\b"
    r"|DIMENSIONS?\s+SHALL\s+BE|REFER\s+(?:TO\s+)?(?:DWG|DRAWING)|FOR\s+(?:DETAILS?|ORIENTATION)|CLIENT|CONTRACTOR\s*$|APPROVED|CHECKED|DESIGNED|DRAWN\b|PROPRIETARY|CONFIDENTIAL|THIS\s+DOCUMENT|INSIGNIA)"
)
REFERENCE = r"(?i)\b[A-Z]{2}-\d{3}-[0-9A-Z]{4}-[A-Z]{2}-[A-Z]{2}-[A-Z]{3}-\d{3,4}|\b[NE]\s?\d{6}\.\d{3}\b|\b\d{5}-[A-Z]{3}-\d{3}\b"
BOUNDARY = (
    "OF", "TO", "AT", "FOR", "REFER", "SEE", "AND", "WITH", "PER", "AS", "EL", "EL.", "ELEV", "LEVEL", "C/C", "CTS", "@", "=", "-", "&", "TYP", "(TYP)", "TYP.", "NTS", "(NTS)", "UNO", "(UNO)", "VARING", "VARYING", "SHALL",
    "BE", "IS", "ARE", "ON", "IN", "BY", "FROM", "SECTION", "DETAIL", "PLAN", "SCALE",
)
SPEC_WORDS = ("THK", "THICK", "THIK", "MM", "M", "DIA", "DIAMETER", "NOS", "NO", "NOS.", "CM", "KG", "SET", "SETS", "C/C", "CTS", "EL", "MPA", "N/MM2", "QTY", "EQ", "NTS", "UNO", "MAX", "MIN", "APPROX")
MARK = r"^[A-Z]{1,3}-?\d{1,2}[a-z]?$"
WORD = r"(?i)^[A-Z][A-Z&/'.\-]*$"
THICK = r"(?i)\b(\d{1,4}(?:\.\d{1,2})?)\s*(?:MM)?\s*TH(?:K|ICK|IK)\.?\b"
DIA = r"(?iU)\b(\d{1,4}(?:\.\d{1,2})?)\s*(?:MM)?\s*(?:DIA\.?|DIAMETER|[Øø])\b"
BOX = r"(?i)\(?\b(\d{2,5})\s*[x×*]\s*(\d{2,5})(?:\s*[x×*]\s*(\d{2,5}))?\b\)?"
COUNTED = r"(?iU)\(?(\d{1,3})\)?\s*[-–—]\s*[DTØø]\s?(\d{1,2})\b"
SPACED = r"(?iU)\b[DTØø]\s?(\d{1,2})\s*(?:@|[-–—]|\s)\s*(\d{2,3})\b"
PER_SET = r"(?i)\((\d{1,3})\s*N[o0]s?\.?\s*/\s*SET\)"
PERCENT = r"(?i)\b(\d{1,3})\s*%"
ASSEMBLY = r"(?i)\b([A-Z]{2})-\((\d{1,2})\)-([A-Z])-M(\d{1,3})-(\d{2,5})-N(\d{1,2})\b"
LEVELS = r"(?i)\b(TOC|BOC|BOBP|BOP|FGL|FFL|NGL|IL|HPP|LPP|TOS|U/S)\b[^0-9]{0,24}?(\d{1,3}\.\d{2,3})\b"
GRADE = r"(?i)\bC\s?(\d{2})\b(?!\s*[x×*])"
STRENGTH = r"(?i)(\d{2,3}(?:\.\d)?)\s*(N/mm2|MPa)"
TOPS, BOTTOMS = ("BOBP", "TOC", "TOS", "FFL", "U/S"), ("BOC", "BOP", "NGL", "FGL")
THICK_MM, DIA_MM, BOX_MM, LEVEL_M, HEIGHT_M = (1, 3000), (5, 2000), (50, 100_000), (0, 500), (0.1, 15.0)
#: Words of a phrase, of one that goes on below, and characters of a label that can lend its words.
PHRASE, LONG, LABEL = 5, 7, 60
UOM = {"thickness": "m2", "diameter": "Nos", "box2": "m2", "box3": "m3", "rebar": "Nos", "rebar_spacing": "m", "assembly": "Nos", "compaction": "m3", "set": "Nos"}

#: Grammars in the order in which a line's items are listed: name, pattern, groups. (?U) makes Ø a letter for \\b.
GRAMMARS = (("box", BOX, 3), ("thickness", THICK, 1), ("diameter", DIA, 1), ("rebar", COUNTED, 2), ("rebar_spacing", SPACED, 2), ("assembly", ASSEMBLY, 6), ("compaction", PERCENT, 1), ("set", PER_SET, 1))
NAMES = tuple(g[0] for g in GRAMMARS)
HIT = "struct<grammar:int,at:int,first:int,last:int,m:string>"


def is_furniture(text: Column) -> Column:
    """Whether a line describes the drawing and not the works: furniture, references, scraps, running prose."""
    prose = (F.length(text) > 110) & (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) > 14)
    return F.rlike(text, F.lit(FURNITURE)) | F.rlike(text, F.lit(REFERENCE)) | (F.length(text) < 3) | prose


def drop_furniture(lines: DataFrame) -> DataFrame:
    """Lines with their whitespace folded, without furniture."""
    return lines.withColumn("text", normalised(c("text"))).where(~is_furniture(c("text")))


def bare(token: Column) -> Column:
    return F.btrim(token, F.lit("(),:;·. "))


def ends_phrase(token: Column) -> Column:
    """A connective, another specification, or no word. A mark such as P1 belongs to a phrase."""
    t = F.upper(bare(token))
    return (t == "") | t.isin(*BOUNDARY) | (~F.rlike(t, F.lit(MARK)) & (F.rlike(t, F.lit("[0-9]")) | ~F.rlike(t, F.lit(WORD))))


def tokens_of(text: Column) -> Column:
    """The words of a text whose whitespace is folded; splitting at one character spares compiling a pattern each time."""
    return F.array_remove(F.split(text, " "), "")


def token_count(text: Column) -> Column:
    """The number of tokens that a beginning of a folded text holds, one that is cut included."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + F.when((text == "") | F.endswith(text, F.lit(" ")), 0).otherwise(1)


def upto_boundary(tokens: Column) -> Column:
    """The first words of an array of tokens, up to PHRASE of them, stopping at what ends a phrase."""
    look = F.slice(tokens, 1, PHRASE + 2)
    stop = F.array_position(F.transform(look, ends_phrase), F.lit(True))
    n = F.least(F.when(stop > 0, stop - 1).otherwise(F.size(look)), F.lit(PHRASE)).cast("int")
    return F.transform(F.slice(look, F.lit(1), n), bare)


def phrase_after(tokens: Column, start: Column) -> Column:
    """The words from position ``start`` (0 is the first token) on."""
    rest = F.slice(tokens, (start + 1).cast("int"), F.greatest(F.size(tokens) - start, F.lit(0)).cast("int"))
    return F.array_join(upto_boundary(rest), " ")


def phrase_before(tokens: Column, end: Column) -> Column:
    """The words that end before position ``end``."""
    head = F.slice(tokens, F.lit(1), F.greatest(end, F.lit(0)).cast("int"))
    return F.array_join(F.reverse(upto_boundary(F.reverse(head))), " ")


def specifies(word: Column) -> Column:
    """Whether a word only specifies, alone or as a compound such as NOS./SET, all of whose parts do."""
    up = F.upper(word)
    rest = F.array_except(F.split(F.replace(up, F.lit("."), F.lit("/")), "/"), F.array(*[F.lit(w) for w in ("", *SPEC_WORDS)]))
    return up.isin(*SPEC_WORDS) | ((F.size(rest) == 0) & F.rlike(up, F.lit("[^/.]")))


def described(text: Column) -> Column:
    """The words of a label that name something, at most PHRASE of them; empty for furniture and long labels."""
    kept = F.filter(F.transform(tokens_of(text), bare), lambda w: (w != "") & ~F.upper(w).isin(*BOUNDARY) & ~specifies(w) & (F.rlike(w, F.lit(WORD)) | F.rlike(F.upper(w), F.lit(MARK))))
    return F.when(is_furniture(text) | (F.length(text) > LABEL), "").otherwise(F.array_join(F.slice(kept, 1, PHRASE), " "))


def titled(phrase: Column) -> Column:
    """Capitalised words; marks and short words in capitals stay."""
    up = F.upper
    one = lambda w: F.when(F.rlike(up(w), F.lit(MARK)) | ((F.length(w) <= 3) & (w == up(w)) & (w != F.lower(w))), up(w)).otherwise(F.concat(up(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))
    return F.array_join(F.transform(F.filter(F.split(phrase, " "), lambda w: w != ""), one), " ")


def hits(at: int) -> Column:
    """Every match of a grammar: grammar, place among its matches, the tokens before it and up to its end, itself.

    The counts of tokens come from the text before the match, so a match inside a token counts that token with it.
    """
    def one(m: Column, i: Column) -> Column:
        head = F.concat(F.array_join(F.transform(F.slice(c(f"w{at}"), F.lit(1), i), lambda x, k: F.concat(F.get(c(f"g{at}"), k), x)), ""), F.get(c(f"g{at}"), i))
        return F.struct(F.lit(at).alias("grammar"), i.alias("at"), token_count(head).alias("first"), token_count(F.concat(head, m)).alias("last"), m.alias("m"))

    return F.when(c(f"w{at}").isNotNull(), F.transform(f"w{at}", one)).otherwise(F.expr(f"cast(array() as array<{HIT}>)"))


def whole_and_gaps(pattern: str, at: int) -> dict[str, Column]:
    """The matches of a pattern and what stands between them; null without a match."""
    text, cut = c("text"), "\x01"
    found = F.rlike(text, F.lit(pattern))
    return {f"w{at}": F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), f"g{at}": F.when(found, F.split(F.regexp_replace(F.replace(text, F.lit(cut), F.lit(" ")), pattern, cut), cut))}


def with_labels(lines: DataFrame) -> DataFrame:
    """Lines with their whitespace folded, ``context`` and ``below``, both taken before furniture is dropped.

    ``context`` is the first name without a digit that another label of the line's block gives, from the block's top;
    ``below`` the words of the next label of the block, unless they hold a digit. Lines without a block have neither.
    ``furniture`` tells whether it is. What follows from a text alone is worked out once for each different text.
    """
    by = Window.partitionBy("drawing_id", "block_id").orderBy("line_no")
    raw = F.coalesce("text", F.lit("")).alias("_raw")
    texts = spread(lines.select(raw).distinct()).withColumn("_text", normalised(c("_raw"))).withColumn("_words", described(c("_text")))
    texts = written(texts.select("_raw", "_text", F.when(~F.rlike("_words", F.lit("[0-9]")), F.nullif("_words", F.lit(""))).alias("_own"), is_furniture(c("_text")).alias("furniture")))
    rows = sized_join(lines.withColumn("_raw", raw), texts, "_raw", "inner")
    rows = rows.withColumn("text", c("_text")).withColumn("own", F.when(c("block_id").isNotNull(), c("_own"))).drop("_raw", "_text", "_own")
    before = F.first("own", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("own", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing))
    out = rows.withColumn("context", F.when(c("block_id").isNotNull(), F.coalesce(before, after))).withColumn("below", F.when(c("block_id").isNotNull(), F.lead("own").over(by)))
    return out.withColumn("context", F.coalesce("context", F.lit(""))).withColumn("below", F.coalesce("below", F.lit(""))).drop("own")


def label_context(lines: DataFrame) -> DataFrame:
    """Lines that aren't furniture with the name that their block lends them and the words of the label below."""
    return with_labels(lines).where(~c("furniture")).drop("furniture")


def continued(phrase: Column) -> Column:
    """A phrase that ran to the end of its label, with the new words of the label below; at most LONG words in all."""
    words = F.split(phrase, " ")
    ran_out = F.endswith(F.upper("text"), F.upper(F.element_at(words, -1)))
    have = F.transform(words, F.upper)
    extra = F.filter(F.split("below", " "), lambda w: (w != "") & ~F.array_contains(have, F.upper(w)))
    return F.when((phrase != "") & ran_out & (F.size(extra) > 0), F.array_join(F.slice(F.concat(words, extra), 1, LONG), " ")).otherwise(phrase)


def shown(x: Column) -> Column:
    """A size as it is written: no trailing .0."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def either(*names: Column) -> Column:
    return F.coalesce(*[F.nullif(n, F.lit("")) for n in names], F.lit(""))


def by_grammar(**values: Column) -> Column:
    """The value of the hit's grammar; null for a grammar that isn't named."""
    out = F.when(F.lit(False), F.lit(None))
    for name, value in values.items():
        out = out.when(c("grammar") == NAMES.index(name), value)
    return out


def first_box() -> Column:
    """The first box of the line that has sizes in range and a name, as (l, w, h); h is null for two sizes."""
    size = lambda m, g: number(F.nullif(F.regexp_extract(m, BOX, g), F.lit("")))
    fits = lambda x: x.between(*BOX_MM)
    boxes = F.transform(c("h0"), lambda h: F.struct(size(h["m"], 1).alias("l"), size(h["m"], 2).alias("w"), size(h["m"], 3).alias("h"), either(phrase_before(c("tokens"), h["first"]), phrase_after(c("tokens"), h["last"]), c("context")).alias("name")))
    return F.get(F.filter(boxes, lambda x: (x["name"] != "") & fits(x["l"]) & fits(x["w"]) & (x["h"].isNull() | fits(x["h"]))), F.lit(0))


def discover(lines: DataFrame, grammars: tuple[str, ...] = ()) -> DataFrame:
    """The items that lines name and measure, of all grammars or of those given.

    Each line is read once: the matches of all grammars go into one array of (grammar, tokens before, tokens up to
    the end, match), which one explode turns into rows; names, sizes and texts are expressions over those rows. A box
    (B19) is named by the words before it, else after it, else by its block; a thickness (B20) by those after it,
    continued on the label below, else before, else by its block, and it makes a volume of the line's first box if
    that has two sizes; a diameter (B21) and a compaction (B24) by those after, continued, else by their block; a
    number a set (B25) by those before or its block; bars (B22) and assemblies (B23) name themselves. Nothing else
    gets a quantity. Lines of null text, without digits or of furniture give none. What a line gives follows from its
    text, the name its block lends it and the words below, so each different set of these is read once. The rows of a
    drawing come out together.
    """
    says, place = ["text", "context", "below"], ["drawing_id", "block_id", "line_no", "grid_ref"]
    lined = written(with_labels(lines).where(F.rlike("text", F.lit("[0-9]")) & ~c("furniture")).select(*place, *says))
    seen = written(spread(lined.select(*says).distinct()).withColumn("said", F.monotonically_increasing_id()))
    found = written(items_of(spread(seen), grammars).drop("context", "below"))
    # lines move as their place and a number, and what they say is put to them where they are: wide rows needn't move to be merged by drawing
    placed = sized_join(lined, seen, says, "inner").select(*place, "said")
    parts = more_parts(lined.sparkSession, lined.count())
    placed = placed.repartition(parts, "drawing_id") if parts else placed.repartition("drawing_id")
    return sized_join(placed, found, "said", "inner").select("drawing_id", "block_id", "line_no", "grammar", "at", "kind", "description", "spec", "qty", "basis", "text", "grid_ref")


def items_of(rows: DataFrame, grammars: tuple[str, ...] = ()) -> DataFrame:
    """The items of rows (text, context, below), see discover(); other columns of the rows go with their items."""
    wanted = [k for k, name in enumerate(NAMES) if not grammars or name in grammars]
    read = sorted({0, *wanted})
    own = ["text", "context", "below", *[x for x in rows.columns if x not in ("text", "context", "below")]]
    rows = rows.select(*own, tokens_of(c("text")).alias("tokens"))
    rows = rows.withColumns({n: x for k in read for n, x in whole_and_gaps(GRAMMARS[k][1], k).items()}).withColumns({f"h{k}": hits(k) for k in read}).withColumn("box", first_box())
    keep = [*own, "tokens", "box"]
    rows = rows.select(*keep, F.explode(F.concat(*[c(f"h{k}") for k in wanted])).alias("hit")).select(*keep, "hit.*")
    rows = rows.withColumns({"after": phrase_after(c("tokens"), c("last")), "before": phrase_before(c("tokens"), c("first"))})
    rows = rows.withColumns({f"t{g}": F.nullif(by_grammar(**{n: F.regexp_extract("m", p, g) for n, p, groups in GRAMMARS if g <= groups}), F.lit("")) for g in range(1, 7)})
    rows = rows.withColumns({f"n{g}": number(c(f"t{g}")) for g in range(1, 7)})
    n1, n2, n3 = c("n1"), c("n2"), c("n3")
    valid = by_grammar(
        box=n1.between(*BOX_MM) & n2.between(*BOX_MM) & (n3.isNull() | n3.between(*BOX_MM)), thickness=n1.between(*THICK_MM), diameter=n1.between(*DIA_MM), rebar=n1.between(1, 200) & n2.cast("int").isin(*DIAMETERS),
        rebar_spacing=n1.cast("int").isin(*DIAMETERS) & n2.between(50, 500), assembly=F.lit(True), compaction=n1.between(50, 100), set=F.lit(True),
    )
    after, before, context = c("after"), c("before"), c("context")
    forward = continued(after)
    name = by_grammar(box=either(before, after, context), thickness=either(forward, before, context), diameter=either(forward, context), rebar=after, rebar_spacing=after, assembly=F.lit(""), compaction=either(forward, context), set=either(before, context))
    # Whether there is a name is asked of its sources: the optimizer moves filters down, and would build the name twice.
    front, back, block = after != "", before != "", context != ""
    has_name = by_grammar(box=front | back | block, thickness=front | back | block, diameter=front | block, rebar=F.lit(True), rebar_spacing=F.lit(True), assembly=F.lit(True), compaction=front | block, set=back | block)
    rows = rows.where(valid & has_name).withColumn("name", titled(name))
    body = (c("grammar") == NAMES.index("thickness")) & c("box").isNotNull() & c("box.h").isNull()
    kind = F.when(c("grammar") == 0, F.when(n3.isNull(), "box2").otherwise("box3")).when(body, "box3").otherwise(F.get(F.array(*[F.lit(n) for n in NAMES]), c("grammar")))
    bl, bw = c("box.l"), c("box.w")
    size = F.concat_ws("x", shown(n1), shown(n2), shown(n3))
    whose = F.when(c("name") != "", F.concat(F.lit(" ("), "name", F.lit(")"))).otherwise("")
    described_as = by_grammar(
        box=F.concat("name", F.lit(" "), size), thickness=F.concat("name", F.lit(", "), shown(n1), F.lit(" mm thick")), diameter=F.concat("name", F.lit(", "), shown(n1), F.lit(" mm dia")),
        rebar=F.concat(F.lit("D"), shown(n2), F.lit(" bars — "), shown(n1), F.lit(" Nos per element"), whose), rebar_spacing=F.concat(F.lit("D"), shown(n1), F.lit(" bars @ "), shown(n2), F.lit(" c/c"), whose),
        assembly=F.concat(F.lit("Anchor assembly "), F.upper("t1"), F.lit(" M"), shown(c("n4")), F.lit(" x "), shown(c("n5")), F.lit(" (grade "), F.upper("t3"), F.lit(")")),
        compaction=F.concat("name", F.lit(", "), shown(n1), F.lit("% compaction")), set=F.concat("name", F.lit(" — "), shown(n1), F.lit(" Nos per set")),
    )
    spec = by_grammar(
        box=spec_of(length_mm=n1, width_mm=n2, height_mm=n3), thickness=spec_of(length_mm=F.when(body, bl), width_mm=F.when(body, bw), thickness_mm=n1), diameter=spec_of(diameter_mm=n1), rebar=spec_of(count=n1, diameter_mm=n2),
        rebar_spacing=spec_of(diameter_mm=n1, spacing_mm=n2), assembly=spec_of(count=n2, size_mm=c("n4"), length_mm=c("n5"), nuts=c("n6")), compaction=spec_of(percent=n1), set=spec_of(per_set=n1),
    )
    qty = by_grammar(box=F.when(n3.isNull(), rounded(n1 * n2 / 1e6, 4)).otherwise(rounded(n1 * n2 * n3 / 1e9, 4)), thickness=F.when(body, rounded(bl * bw * n1 / 1e9, 4)), rebar=n1, assembly=n2, set=n1)
    basis = by_grammar(
        box=F.concat(size, F.when(n3.isNull(), " mm, plan area per unit").otherwise(" mm, per unit")), thickness=F.when(body, F.concat(shown(bl), F.lit("x"), shown(bw), F.lit("x"), shown(n1), F.lit(" mm, per unit"))).otherwise(F.concat(shown(n1), F.lit(" mm thick — area not stated on this sheet"))),
        diameter=F.concat(shown(n1), F.lit(" mm dia — count not stated on this sheet")), rebar=F.concat(F.trim("m"), F.lit(" — bars per element")), rebar_spacing=F.concat(F.lit("D"), shown(n1), F.lit(" @ "), shown(n2), F.lit(" c/c — run length not stated")),
        assembly=F.concat("m", F.lit(" — "), shown(n2), F.lit(" bolts per set")), compaction=F.concat(shown(n1), F.lit("% compaction — volume not stated on this sheet")), set=F.concat(shown(n1), F.lit(" Nos per set")),
    )
    return rows.select(*own, "grammar", "at", kind.alias("kind"), described_as.alias("description"), spec.alias("spec"), qty.cast("double").alias("qty"), basis.alias("basis"))


def spec_of(**sizes: Column) -> Column:
    """The sizes that are there, as a map in the order of their names."""
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), x.alias("value")) for n, x in sorted(sizes.items())])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def discover_boxes(lines: DataFrame) -> DataFrame:
    """Boxes of two sizes (m2) or three (m3)."""
    return discover(lines, ("box",))


def discover_thickness(lines: DataFrame) -> DataFrame:
    """Thicknesses, with a box of two sizes on their line as volumes."""
    return discover(lines, ("thickness",))


def discover_diameter(lines: DataFrame) -> DataFrame:
    """Diameters, never with a quantity."""
    return discover(lines, ("diameter",))


def discover_rebar(lines: DataFrame) -> DataFrame:
    """Counted bars, with their count, and spaced bars, without a quantity."""
    return discover(lines, ("rebar", "rebar_spacing"))


def discover_assembly(lines: DataFrame) -> DataFrame:
    """Anchor assemblies: count, size, length and nuts."""
    return discover(lines, ("assembly",))


def discover_compaction(lines: DataFrame) -> DataFrame:
    """Degrees of compaction, never with a quantity."""
    return discover(lines, ("compaction",))


def discover_per_set(lines: DataFrame) -> DataFrame:
    """Numbers a set."""
    return discover(lines, ("set",))


def merge_items(items: DataFrame) -> DataFrame:
    """Items of a drawing that agree in kind, description and sizes, in one row.

    Kept are the first one's description, quantity and basis, how often the item occurs (never a quantity), and its
    texts and places in the order of their first sight. Occurrences are summed by text and place before the rows of an
    item meet, so a label repeated a million times is one row by then.
    """
    seq = F.struct("block_id", "line_no", "grammar", "at")
    spec_json = F.to_json(F.transform_values("spec", lambda _, v: F.round(v, 4)))  # sizes are in the order of their names
    key = ["drawing_id", "kind", "name", "spec_json"]
    rows = items.withColumns({"name": F.lower("description"), "spec_json": spec_json, "seq": seq, "first": F.struct(seq.alias("seq"), "description", "qty", "basis")})
    seen = rows.groupBy(*key, "text", "grid_ref").agg(F.count("*").alias("n"), F.min_by("first", "seq").alias("first"))
    listed = lambda x: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(c("first.seq").alias("s"), c(x).alias("x")))), lambda e: e["x"]))
    uom = F.create_map(*[F.lit(x) for kv in UOM.items() for x in kv])[c("kind")]
    g = seen.groupBy(*key).agg(F.sum("n").alias("occurrences"), F.min_by("first", "first.seq").alias("first"), listed("text").alias("texts"), F.filter(listed("grid_ref"), lambda x: x.isNotNull() & (x != "")).alias("places"))
    return g.select("drawing_id", "kind", "first.description", "spec_json", uom.alias("uom"), "first.qty", "first.basis", "occurrences", F.array_join("texts", " | ").alias("texts"), F.array_join("places", ", ").alias("places"))


def sheet_levels(lines: DataFrame) -> DataFrame:
    """(drawing_id, kind, level_m): the different levels of a sheet."""
    ks, vs = (F.regexp_extract_all("text", F.lit(LEVELS), F.lit(g)) for g in (1, 2))
    rows = lines.select("drawing_id", F.explode(F.transform(ks, lambda k, i: F.struct(F.upper(k).alias("kind"), number(F.get(vs, i)).alias("level_m")))).alias("l"))
    return rows.select("drawing_id", "l.*").where(c("level_m").between(*LEVEL_M)).distinct()


def height_candidates(levels: DataFrame) -> DataFrame:
    """Heights between tops and bottoms of one sheet; equal drawings first, the range after, so that it stays a hash join of different levels."""
    levels = levels.select("drawing_id", "kind", "level_m").distinct()
    t = levels.where(c("kind").isin(*TOPS)).select("drawing_id", c("kind").alias("top"), c("level_m").alias("t"))
    b = levels.where(c("kind").isin(*BOTTOMS)).select("drawing_id", c("kind").alias("bottom"), c("level_m").alias("b"))
    h = rounded(c("t") - c("b"), 3)
    return t.join(b, "drawing_id").where(c("t") > c("b")).withColumn("height_m", h).where(c("height_m").between(*HEIGHT_M)).select("drawing_id", "top", "bottom", "height_m").distinct()


def strength_specs(lines: DataFrame) -> DataFrame:
    """(drawing_id, value, unit): the different strengths in texts of 12 characters and more."""
    v, u = (F.regexp_extract_all("text", F.lit(STRENGTH), F.lit(g)) for g in (1, 2))
    rows = lines.where(F.length("text") >= 12).select("drawing_id", F.explode(F.transform(v, lambda x, i: F.struct(number(x).alias("value"), F.lower(F.get(u, i)).alias("unit")))).alias("s"))
    return rows.select("drawing_id", "s.*").distinct()


def concrete_grades(lines: DataFrame) -> DataFrame:
    """(drawing_id, grade): C10 to C80 where no size follows."""
    rows = lines.select("drawing_id", F.explode(F.regexp_extract_all("text", F.lit(GRADE), F.lit(1))).alias("n"))
    return rows.where(number(c("n")).between(10, 80)).select("drawing_id", F.concat(F.lit("C"), "n").alias("grade")).distinct()


def discovery_summary(items: DataFrame) -> DataFrame:
    """Measured items and items to confirm of each sheet."""
    return items.groupBy("drawing_id").agg(F.count_if(c("qty").isNotNull()).alias("measured"), F.count_if(c("qty").isNull()).alias("to_confirm"))
