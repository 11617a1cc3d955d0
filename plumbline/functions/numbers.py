"""Rounding and writing of quantities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added before rounding, so that a half that binary arithmetic left a hair below goes up like any other.
HAIR = 1e-9


def rounded(x: Column | str, places: int) -> Column:
    """Half up at so many decimal places, for quantities that aren't negative."""
    return F.round((F.col(x) if isinstance(x, str) else x) + F.lit(HAIR), places)


def tolerant(sql: str) -> str:
    """The same rounding in SQL text: every round(x, n) becomes round(x + 1e-9, n)."""
    out, i = [], 0
    while (at := sql.find("round(", i)) >= 0:
        depth, k, comma = 1, at + 6, None
        while depth:
            ch = sql[k]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = k
            k += 1
        if comma is None:
            out.append(sql[i:k])
        else:
            out.append(sql[i : at + 6] + tolerant(sql[at + 6 : comma]) + " + 1e-9" + sql[comma:k])
        i = k
    return "".join(out) + sql[i:]


def g_format(x: Column) -> Column:
    """A double as %g writes it: six significant digits, no trailing zeros, an exponent below 1e-4 and from 1e6 on."""
    shown = F.format_string("%.5e", x)
    mantissa, power = F.split_part(shown, F.lit("e"), F.lit(1)), F.split_part(shown, F.lit("e"), F.lit(2)).cast("int")
    short = lambda s: F.when(s.contains("."), F.rtrim(F.rtrim(s, F.lit("0")), F.lit("."))).otherwise(s)
    sign = F.when(power < 0, "-").otherwise("+")
    small = F.concat(short(mantissa), F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), 2, "0"))
    scale = F.pow(F.lit(10.0), 5 - power)
    plain = short(F.format_string("%.10f", F.round(x * scale) / scale))
    return F.when(x == 0, "0").when((power < -4) | (power >= 6), small).otherwise(plain)
