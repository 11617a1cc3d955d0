"""Column expressions over text that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the fast path takes texts that are ASCII throughout."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def pieces(text: Column, separators: str) -> Column:
    """The non-empty parts of a text between runs of separators; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def document_key(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart: id, and a hash of the text, as an id may come with several texts. Equal rows share it."""
    return [F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th")]


def spread(text: Column, most: int | Column, piece: int = 500) -> Column:
    """A text of up to ``most`` characters as it is; of a longer one as many pieces of ``piece`` characters as fit, evenly spread from its beginning to its end, a blank between them."""
    most = F.lit(most) if isinstance(most, int) else most
    n = F.greatest(F.floor(most / piece), F.lit(2)).cast("int")
    gap = (F.length(text) - piece) / (n - 1)
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substr(text, (F.floor(k * gap) + 1).cast("int"), F.lit(piece)))
    return F.when(text.isNull() | (F.length(text) <= most), text).otherwise(F.array_join(parts, " "))
