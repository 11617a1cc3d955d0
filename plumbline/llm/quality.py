"""Quality rules: fixed guards on a document's words, and divergence from what its language looks like.

A document's histograms of character classes and of common words are compared with those of every language
of the corpus by Jensen-Shannon distance; a document far from all of them is rejected, unless it is too
short to tell. All of it is DataFrame expressions on the row; only the references need a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.frames import durable, sized_join

from .text import SPACES, lower_ascii, pieces

WINDOW = 8
HALF = WINDOW // 2
#: Guards: the fewest words, and the most words in repeated windows, per cent.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: The distance above which a document is rejected, and the words it must have to be judged by it.
MOST_DISTANCE, JUDGED_WORDS = 0.27, 50
#: A language has a reference from so many words on, however many others there are; a word counts from this part of its words on.
LANGUAGE_WORDS, WORD_SHARE = 1_000, 0.01
CLASSES = {"lower": r"\p{Ll}", "space": r"\x20\x09-\x0D", "upper": r"\p{Lu}", "stop": r".,;:!?'\x22()-", "digit": r"\p{Nd}"}


@dataclass(frozen=True)
class Reference:
    """By language: shares of the character classes (others last), and the common words with their shares."""

    classes: dict[str, tuple[float, ...]]
    common: dict[str, dict[str, float]]

    @property
    def words(self) -> list[str]:
        return sorted({w for ws in self.common.values() for w in ws})


def with_class_counts(df: DataFrame, text_col: str) -> DataFrame:
    """df with ``k``, the characters of each class, then all others. Each class is taken out of what the last one left, so later passes are short."""
    left = text_col
    counts = []
    for name, chars in CLASSES.items():
        df = df.withColumn(f"_{name}", F.regexp_replace(left, f"[{chars}]+", ""))
        counts.append((F.length(left) - F.length(f"_{name}")).cast("double"))
        left = f"_{name}"
    return df.withColumn("k", F.array(*counts, F.length(left).cast("double"))).drop(*[f"_{name}" for name in CLASSES])


def learn_reference(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Reference:
    """References from all rows with a language, weighing every document by its length.

    Only sums by language and (language, word) are shuffled, after partial aggregation, each in one pass. What reaches the driver is
    bounded: 1 / WORD_SHARE words for each language with LANGUAGE_WORDS words.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"))
    n = len(CLASSES) + 1
    counted = with_class_counts(rows, "t").select("lang", "k", F.regexp_count("t", F.lit(r"[^\x20\x09-\x0D]+")).alias("n"))
    sums = counted.groupBy("lang").agg(F.sum("n").alias("all"), *[F.sum(F.get("k", F.lit(i))).alias(f"k{i}") for i in range(n)])
    known = durable(sums.where(F.col("all") >= LANGUAGE_WORDS))
    sums = known.collect()
    if not sums:
        return Reference({}, {})
    classes = {r["lang"]: tuple(r[f"k{i}"] / max(1.0, sum(r[f"k{j}"] for j in range(n))) for i in range(n)) for r in sums}
    words = sized_join(rows, known.select("lang", "all"), "lang", "inner").select("lang", "all", F.explode(pieces(lower_ascii(F.col("t")), SPACES)).alias("w"))
    words = words.groupBy("lang", "w").agg(F.count("*").alias("n"), F.first("all").alias("all")).where(F.col("n") >= WORD_SHARE * F.col("all"))
    shared = words.select("lang", "w", (F.col("n") / F.col("all")).alias("p")).collect()
    common: dict[str, dict[str, float]] = {lang: {} for lang in classes}
    for r in sorted(shared, key=lambda r: (r["lang"], r["w"])):
        common[r["lang"]][r["w"]] = r["p"]
    return Reference(classes, common)


def divergence(p: Column, q: tuple[float, ...]) -> Column:
    """Jensen-Shannon divergence in bits (0 to 1) between an array column and fixed shares."""
    half = lambda x, m: F.when(x > 0, 0.5 * x * F.log2(x / m)).otherwise(0.0)
    parts = F.zip_with(p, F.array(*[F.lit(float(x)) for x in q]), lambda x, y: half(x, (x + y) / 2) + half(y, (x + y) / 2))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def behind_barrier(df: DataFrame, *names: str) -> DataFrame:
    """The named columns of df, through a generator of one row each.

    A filter on what is computed here is never pushed below it, where every measure that it reads would be computed
    again inside it, once for each mention.
    """
    return df.select(F.explode(F.array(F.struct(*names))).alias("m")).select("m.*")


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's columns packed in ``doc``, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Null text has no words. Lines without a word don't count as repeats. Row-wise: no shuffle.
    """
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    out = out.withColumn("w", pieces(F.col("t"), SPACES))
    lines = F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    out = out.select(
        "doc",
        "t",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform("w", lambda x, i: F.xxhash64(x, *[F.get(F.col("w"), i + k) for k in range(1, HALF)])).alias("h"),
    )
    out = out.withColumn("h", F.transform("h", lambda x, i: F.xxhash64(x, F.get(F.col("h"), i + HALF))))
    out = out.withColumn("h", F.when(F.col("n_words") >= WINDOW, F.slice("h", F.lit(1), F.size("w") - (WINDOW - 1))).otherwise(F.array().cast("array<bigint>")))
    out = out.select("doc", "t", "w", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "h", (F.size(F.array_distinct("h")) < F.size("h")).alias("again"))
    out = out.withColumn("r", F.when(F.col("again"), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda e, o: F.coalesce(e["h"] == o["h"], F.lit(False))
    out = out.withColumn("r", F.when(F.col("again"), F.sort_array(F.transform(F.filter("r", lambda e, k: same(e, F.get(F.col("r"), k - 1)) | same(e, F.get(F.col("r"), k + 1))), lambda e: e["i"]))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("r", zero, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")))["n"]
    out = out.withColumn("n_repeat_words", F.when(F.col("again"), covered).otherwise(0).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return behind_barrier(out.withColumn("base_failed", failed), "doc", "t", "w", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def judge(docs: DataFrame, reference: Reference, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """measures() of every row with ``distance`` from the nearest language (null if there is none, the text has no word, or its own language has no reference) and ``kept``.

    The distance is the root of the mean of the two divergences, 0 to 1. Documents that fail a guard go; others go
    if they have JUDGED_WORDS words and their distance is above MOST_DISTANCE. Without any reference only the
    guards count, as for a document whose language is known but has none; one of no language is held against all. Common words are counted by the bytes that taking them out of the spaced words saves.
    """
    out = measures(docs, text_col)
    if reference.classes:
        words = reference.words
        at = {w: i for i, w in enumerate(words)}
        out = out.withColumn("spaced", F.concat(F.lit(" "), lower_ascii(F.array_join("w", "  ")), F.lit(" ")))
        if words:  # words that aren't common go first, to shorten the string that is searched for each of these
            any_word = "|".join(rf"\Q{w}\E" for w in words)
            out = out.withColumn("spaced", F.regexp_replace("spaced", f" (?!(?:{any_word}) )[^ ]++ ", ""))
        count = [((F.octet_length("spaced") - F.octet_length(F.replace(F.col("spaced"), F.lit(f" {w} "), F.lit("")))) / F.lit(float(len(w.encode()) + 2)) / F.col("n_words")) for w in words]
        known = F.col(f"doc.`{lang_col}`").isNull() | F.col(f"doc.`{lang_col}`").isin(sorted(reference.classes))
        judged = (F.col("n_words") > 0) & known
        out = with_class_counts(out.withColumn("c", F.when(judged, F.array(*count).cast("array<double>"))), "t")
        out = out.withColumn("k", F.when(judged, F.transform("k", lambda x: x / F.length("t"))))
        every = []
        for lang in sorted(reference.classes):
            own = reference.common[lang]
            shares = [F.get("c", F.lit(at[w])) for w in own]
            rest = F.lit(1.0)
            for x in shares:
                rest = rest - x
            every.append((divergence(F.col("k"), reference.classes[lang]) + divergence(F.array(*shares, F.greatest(rest, F.lit(0.0))), (*own.values(), max(0.0, 1.0 - sum(own.values()))))) / 2)
        out = out.withColumn("distance", F.when(judged, F.sqrt(F.greatest(F.array_min(F.array(*every)), F.lit(0.0)))))
    else:
        out = out.withColumn("distance", F.lit(None).cast("double"))
    odd = (F.col("n_words") >= JUDGED_WORDS) & F.coalesce(F.col("distance") > MOST_DISTANCE, F.lit(False))
    return behind_barrier(out.withColumn("kept", ~F.col("base_failed") & ~odd), "doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, measures, base_failed, distance, kept) for every row of docs, with references learned from docs.

    Null texts have no words and fail; null languages teach nothing; repeated rows get repeated results; an empty
    table gives an empty result; columns of other names are ignored.
    """
    judged = judge(docs, learn_reference(docs, lang_col, text_col), text_col, lang_col)
    return judged.select(F.col(f"doc.`{id_col}`").alias(id_col), *[c for c in judged.columns if c != "doc"])


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the documents that the rules reject, all columns kept. A filter on the row: texts move in no shuffle."""
    judged = judge(docs, learn_reference(docs, lang_col, text_col), text_col, lang_col)
    return judged.where("kept").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
