"""XPath 1.0's scalar rules as Column expressions: IEEE numbers, XML white space, strings in characters.

Spark differs where NaN is equal to itself, division by zero fails, rounding
is half up from zero, floor gives integers and casts read more than numbers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS = " \t\r\n"
NAN, INFINITY = float("nan"), float("inf")
#: Fixed value: from here on doubles are integers.
WHOLE = float(1 << 52)


def ws_trim(s: Column) -> Column:
    return F.btrim(s, F.lit(WS))


def xnum_of_string(s: Column) -> Column:
    t = ws_trim(s)
    return F.coalesce(F.when(t.rlike(r"\A-?([0-9]+([.][0-9]*)?|[.][0-9]+)\z"), t.try_cast("double")), F.lit(NAN))


def xnum_of_bool(b: Column) -> Column:
    return F.when(b, 1.0).otherwise(0.0)


def xbool_of_num(x: Column) -> Column:
    return ~F.isnan(x) & (x != 0)


def xbool_of_string(s: Column) -> Column:
    return s != ""


def xeq_num(a: Column, b: Column) -> Column:
    return (a == b) & ~F.isnan(a) & ~F.isnan(b)


def xne_num(a: Column, b: Column) -> Column:
    return ~xeq_num(a, b)


def xlt(a: Column, b: Column) -> Column:
    return (a < b) & ~F.isnan(a) & ~F.isnan(b)


def xle(a: Column, b: Column) -> Column:
    return (a <= b) & ~F.isnan(a) & ~F.isnan(b)


def xdiv(a: Column, b: Column) -> Column:
    negative_zero = b.cast("string") == "-0.0"
    by_zero = F.when(a == 0, NAN).when((a > 0) != negative_zero, INFINITY).otherwise(-INFINITY)
    return F.when(F.isnan(a) | F.isnan(b), NAN).when(b == 0, by_zero).otherwise(a / F.when(b == 0, 1.0).otherwise(b))


def xmod(a: Column, b: Column) -> Column:
    bad = F.isnan(a) | F.isnan(b) | (b == 0) | (F.abs(a) == INFINITY)
    return F.when(bad, NAN).otherwise(a % F.when(b == 0, 1.0).otherwise(b))


def xfloor(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) >= WHOLE) | (x == 0), x).otherwise(F.floor(F.when(F.isnan(x) | (F.abs(x) >= WHOLE), 0.0).otherwise(x)).cast("double"))


def xceiling(x: Column) -> Column:
    up = F.ceil(F.when(F.isnan(x) | (F.abs(x) >= WHOLE), 0.0).otherwise(x)).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) >= WHOLE) | (x == 0), x).when((x < 0) & (up == 0), -0.0).otherwise(up)


def xround(x: Column) -> Column:
    """To the nearest integer, ties upwards; zeros keep their sign."""
    down = xfloor(x)
    up = F.when(x - down >= 0.5, down + 1.0).otherwise(down)
    return F.when(F.isnan(x) | (F.abs(x) >= WHOLE) | (x == 0), x).when((x < 0) & (up == 0), -0.0).otherwise(up)


def xsubstring(s: Column, start: Column, length: Column | None = None) -> Column:
    """Characters at places p with p >= round(start) and p < round(start) + round(length)."""
    first = xround(start)
    end = F.lit(INFINITY) if length is None else first + xround(length)
    low = F.greatest(first, F.lit(1.0))
    most = float((1 << 31) - 1)
    none = F.isnan(first) | F.isnan(end) | (end <= low)
    return F.when(none, "").otherwise(F.substring(s, F.least(low, F.lit(most)).cast("int"), F.least(end - low, F.lit(most)).cast("int")))


def xsubstring_before(s: Column, t: Column) -> Column:
    at = F.position(t, s)
    return F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise("")


def xsubstring_after(s: Column, t: Column) -> Column:
    at = F.position(t, s)
    return F.when(t == "", s).when(at > 0, F.substring(s, at + F.length(t), F.length(s))).otherwise("")


def xnormalize_space(s: Column) -> Column:
    return F.btrim(F.regexp_replace(s, "[ \t\r\n]+", " "))


def xtranslate(s: Column, a: Column, b: Column) -> Column:
    return F.translate(s, a, b) if isinstance(a, str) else F.call_function("translate", s, a, b)


def format_number(x: float) -> str:
    """XPath's string of a number: 15 significant digits, never an exponent."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    mantissa, exponent = f"{abs(x):.14e}".split("e")
    digits, point = mantissa.replace(".", ""), int(exponent) + 1
    if point <= 0:
        whole, rest = "0", "0" * -point + digits
    elif point >= len(digits):
        whole, rest = digits + "0" * (point - len(digits)), ""
    else:
        whole, rest = digits[:point], digits[point:]
    rest = rest.rstrip("0")
    return ("-" if x < 0 else "") + whole + (f".{rest}" if rest else "")


@F.pandas_udf(T.StringType())
def _format(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else format_number(float(v)), na_action=None)


def xstr_of_num(x: Column) -> Column:
    """Arrow batches: no built-in function rounds to 15 digits as XPath does."""
    return _format(x.cast("double"))


def xstr_of_bool(b: Column) -> Column:
    return F.when(b, "true").otherwise("false")
