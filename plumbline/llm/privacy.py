"""Personal data: fixed patterns, and the terms around them that give the person away.

Patterns find protected entities (addresses, cards, phones). How often a term stands near one entity, and how
often it occurs at all, estimate how strongly it reveals the entity: the probability of the entity given the
term, and the bits it gains over the entity's own frequency. Terms above both thresholds are marked too, where
they stand near the entity, and generalised. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.frames import durable, sized_join

from .text import document_key

#: Patterns by kind, in the order of the output. Possessive forms match the same text as the plain ones, in one pass
#: over it: a local part or number is only tried from its first character, or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
TERM = "term"
#: Context: characters on either side of an entity, and the letters a term has at least.
CONTEXT, TERM_LETTERS = 60, 4
#: A term reveals an entity from so many different texts, this probability and this gain in bits on.
SUPPORT, PROBABILITY, BITS = 3, 0.5, 3.0


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.try_to_number(c, F.lit("9")).cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    n = F.length(digits(match))
    return (
        F.when(kind == "ip", F.rlike(match, F.lit(rf"^{part}(?:\.{part}){{3}}$")))
        .when(kind == "card", F.when(n.between(13, 19), luhn(digits(match))).otherwise(F.lit(False)))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(F.lit(True))
    )


def occurrences(rank: int, kind: str, pattern: str) -> Column:
    """An array of (rank, kind, i, gap, match): the pattern's matches in column t, each with the length of text since the last one."""
    matches = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
    gaps = F.split("t", pattern, -1)
    return F.transform(gaps, lambda g, i: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), i.alias("i"), F.length(g).alias("gap"), F.get(matches, i).alias("match")))


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, spans): for each (id, text) with personal data, an array of (rank, kind, start, end, entity), sorted.

    Offsets count code points, end exclusive. Splitting by a pattern gives the gaps between its matches; running
    sums over gaps and matches give the offsets. Only texts with a digit or an @ are looked at, only their matches are
    shuffled, and no group is larger than one document's matches. ``entity`` is a hash of the kind and value.
    """
    some = docs.where(F.rlike(F.col(text_col), F.lit("[0-9@]"))).select(*document_key(id_col, text_col), F.col(text_col).alias("t"))
    parts = [occurrences(rank, kind, pattern) for rank, (kind, pattern) in enumerate(KINDS.items())]
    rows = some.select("id", "th", F.explode(F.concat(*parts)).alias("m")).select("id", "th", "m.*").where(F.col("match").isNotNull())
    rows = rows.repartition("id", "th").dropDuplicates(["id", "th", "rank", "i"])
    w = Window.partitionBy("id", "th", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(w).cast("int"))
    rows = rows.where(valid(F.col("kind"), F.col("match")))
    span = F.struct("rank", "kind", (F.col("end") - F.length("match")).cast("int").alias("start"), "end", F.xxhash64("kind", F.lower("match")).alias("entity"))
    return rows.groupBy("id", "th").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def side_terms(piece: Column, start: Column, cut_before: Column, cut_after: Column) -> Column:
    """(start, end, term) of the runs of letters in a piece of text that begins at ``start``; runs that its ends may have cut are left out."""
    gaps, runs = F.split(piece, r"\p{L}++", -1), F.regexp_extract_all(piece, F.lit(r"\p{L}++"), F.lit(0))
    upto = lambda parts, i: F.aggregate(F.slice(parts, 1, i + 1), F.lit(0), lambda a, g: a + F.length(g))
    ends = F.transform(runs, lambda x, i: upto(gaps, i) + upto(runs, i))
    found = F.transform(runs, lambda x, i: F.struct((start + F.get(ends, i) - F.length(x)).alias("start"), (start + F.get(ends, i)).alias("end"), F.lower(x).alias("term")))
    return F.filter(found, lambda x: (F.length(x["term"]) >= TERM_LETTERS) & ~(cut_before & (x["start"] == start)) & ~(cut_after & (x["end"] == start + F.length(piece))))


def without_emails(text: Column) -> Column:
    """The text with digits in place of e-mail addresses, the only entities that hold letters; offsets stay."""
    matches = F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))
    parts = F.transform(F.split(text, EMAIL, -1), lambda g, i: F.concat(g, F.repeat(F.lit("0"), F.coalesce(F.length(F.get(matches, i)), F.lit(0)))))
    return F.when(text.contains("@"), F.array_join(parts, "")).otherwise(text)


def contexts(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, entity, start, end, term): the terms near every entity, outside all base spans.

    The pieces of text beside the entities are cut out inside the row; only these are exploded, never the text.
    """
    key = docs.where(F.rlike(F.col(text_col), F.lit("[0-9@]"))).select(*document_key(id_col, text_col), F.col(text_col).alias("t"))
    both = sized_join(key.alias("d"), spans.alias("s"), F.col("d.id").eqNullSafe(F.col("s.id")) & (F.col("d.th") == F.col("s.th")), "inner", max_rows=200_000)
    rows = both.select("d.id", "d.th", "spans", F.length("t").alias("n"), without_emails(F.col("t")).alias("t"))

    def sides(s: Column) -> Column:
        lo, hi = F.greatest(s["start"] - CONTEXT, F.lit(0)), F.least(s["end"] + CONTEXT, F.col("n"))
        return F.struct(s["entity"].alias("entity"), lo.alias("lo"), s["end"].alias("b"), (hi < F.col("n")).alias("cut"), F.substring("t", lo + 1, s["start"] - lo).alias("before"), F.substring("t", s["end"] + 1, hi - s["end"]).alias("after"))

    rows = rows.select("id", "th", F.explode(F.transform("spans", sides)).alias("s")).select("id", "th", "s.*")
    terms = F.concat(side_terms(F.col("before"), F.col("lo"), F.col("lo") > 0, F.lit(False)), side_terms(F.col("after"), F.col("b"), F.lit(False), F.col("cut")))
    return rows.select("id", "th", "entity", F.explode(terms).alias("x")).select("id", "th", "entity", "x.*").distinct()


def revealing(docs: DataFrame, near: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, term, probability, bits) of the terms that give an entity away, over the whole corpus.

    Counts are of different texts, so copies don't count as evidence. A term's occurrences are counted in all texts,
    near an entity or not. That is asked only of terms with the support, and only if the texts in which they stand near
    any entity, which are part of those in which they occur, leave the probability within reach; their set is
    broadcast if it is small.
    """
    texts = near.select("entity", "term", "th").distinct()
    pair = texts.groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= SUPPORT)
    beside = texts.select("term", "th").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    pair = durable(pair.join(beside, "term").where(F.col("n_both") >= PROBABILITY * F.col("n_near")).drop("n_near"))
    entity = near.select("entity", "th").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    asked = durable(pair.select("term").distinct())
    words = docs.select(F.xxhash64(text_col).alias("th"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(rf"(?<!\p{{L}})\p{{L}}{{{TERM_LETTERS},}}+"), F.lit(0)))).alias("term"))
    seen = sized_join(words, asked, "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    n = max(1, docs.count())
    found = pair.join(entity, "entity").join(seen, "term")
    probability = F.col("n_both") / F.col("n_term")
    bits = F.log2(probability * F.lit(float(n)) / F.col("n_entity"))
    return found.select("entity", "term", probability.alias("probability"), bits.alias("bits")).where((F.col("probability") >= PROBABILITY) & (F.col("bits") >= BITS))


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, spans, terms): base spans and revealing terms of each (id, text) with personal data.

    Null and empty texts have none; equal rows share a result. Terms are marked only near an entity that they reveal,
    so texts without personal data are left alone.
    """
    base = durable(base_spans(docs, id_col, text_col))
    near = durable(contexts(docs, base, id_col, text_col))
    told = durable(revealing(docs, near, text_col).select("entity", "term"))
    hit = sized_join(near, told, ["entity", "term"], "left_semi")
    terms = hit.groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("terms"))
    same = F.col("b.id").eqNullSafe(F.col("t.id")) & (F.col("b.th") == F.col("t.th"))
    return base.alias("b").join(terms.alias("t"), same, "left").select("b.id", "b.th", "spans", F.coalesce("terms", F.array().cast("array<struct<start:int,end:int>>")).alias("terms"))


def with_spans(docs: DataFrame, id_col: str, text_col: str, packed: bool) -> DataFrame:
    found = durable(private_spans(docs, id_col, text_col))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if packed else []
    d = docs.select(*row, *document_key(id_col, text_col))
    both = sized_join(d.alias("d"), found.alias("f"), F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.th") == F.col("f.th")), "left", max_rows=100_000)
    blank = "array<struct<rank:int,kind:string,start:int,end:int,entity:bigint>>"
    return both.select(*(["doc"] if packed else []), F.col("d.id").alias("id"), F.coalesce("spans", F.array().cast(blank)).alias("spans"), F.coalesce("terms", F.array().cast("array<struct<start:int,end:int>>")).alias("terms"))


def privacy_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_spans, all_spans) for every row of docs; other columns are ignored.

    Spans are written kind:start:end, by kind as listed (terms last), then start, comma-joined. Null text is empty.
    """
    found = with_spans(docs, id_col, text_col, packed=False)
    write = lambda kind, x: F.concat_ws(":", kind, x["start"].cast("string"), x["end"].cast("string"))
    base = F.transform("spans", lambda x: write(x["kind"], x))
    terms = F.transform("terms", lambda x: write(F.lit(TERM), x))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    n = [count(kind) for kind in KINDS]
    return found.select("id", *n, F.array_join(base, ",").alias("base_spans"), F.array_join(F.concat(base, terms), ",").alias("all_spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets (terms by [TERM]); all columns kept. Of spans that overlap, the first in the text is replaced and the rest of the other removed."""
    found = with_spans(docs, id_col, text_col, packed=True)
    text = F.col(f"doc.`{text_col}`")
    marks = F.array_sort(F.concat(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.upper(x["kind"]).alias("kind"))), F.transform("terms", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("TERM").alias("kind")))))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, x: F.struct(F.when(x["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit("["), x["kind"], F.lit("]"))).otherwise(a["out"]).alias("out"), F.greatest(a["at"], x["end"]).alias("at"))
    done = F.aggregate(marks, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    new = F.when(text.isNull() | (F.size(marks) == 0), text).otherwise(done)
    return found.select(*[(new.alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c)) for c in docs.columns])
