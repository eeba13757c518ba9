"""Float arithmetic and comparison as IEEE 754 has them, where Spark's own differ.

Spark raises an error or gives null on division by zero, and orders NaN above all
numbers; the vector algebra needs infinities, and comparisons that NaN fails.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def divide(a: Column, b: Column) -> Column:
    """a / b: infinite for x / 0 with the sign of both zeros minded, null for 0 / 0 or NaN."""
    negative_zero = b.cast("string") == "-0.0"
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(None).cast("double")).otherwise(F.signum(a) * F.when(negative_zero, -INFINITY).otherwise(INFINITY))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of a; null by zero."""
    return F.try_mod(a, b)


def arithmetic(op: str, a: Column, b: Column) -> Column:
    """The result, or null where it would be NaN."""
    out = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: divide(a, b), "%": lambda: modulo(a, b)}[op]()
    return F.when(F.isnan(out), F.lit(None).cast("double")).otherwise(out)


def compare(op: str, a: Column, b: Column) -> Column:
    """NaN is unequal to everything and neither more nor less."""
    number = ~F.isnan(a) & ~F.isnan(b)
    if op == "!=":
        return ~number | (a != b)
    return number & {"==": a == b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]


def clamp_min(v: Column, bound: Column) -> Column:
    return F.when(F.isnan(v), v).otherwise(F.greatest(v, bound))


def clamp_max(v: Column, bound: Column) -> Column:
    return F.when(F.isnan(v), v).otherwise(F.least(v, bound))


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != INFINITY)


def shortest(v: Column) -> Column:
    """A float in the fewest digits that give it back: plain from 1e-4 up to a million (95 for 95.0), else like 1.5e+06."""
    *forms, most = [F.format_string(f"%.{n}e", v) for n in (0, 14, 15, 16)]  # the first is for the least floats, which have one digit
    form = F.coalesce(*(F.when(f.cast("double") == v, f) for f in forms), most)
    sign = F.when(form.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(form, r"^-|\.|e.*$", ""), "(?<=.)0+$", "")
    power = F.regexp_extract(form, r"e([+-]\d+)$", 1)
    x = power.cast("int")
    point = lambda text, at: F.when(at < F.length(text), F.concat(F.substring(text, F.lit(1), at), F.lit("."), F.substring(text, at + 1, F.length(text)))).otherwise(F.rpad(text, at, F.lit("0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -x - 1), digits)
    plain = F.when(x < 0, small).otherwise(point(digits, x + 1))
    return (
        F.when(F.isnan(v), "NaN")
        .when(v == INFINITY, "+Inf")
        .when(v == -INFINITY, "-Inf")
        .otherwise(F.concat(sign, F.when((x >= -4) & (x < 6), plain).otherwise(F.concat(point(digits, F.lit(1)), F.lit("e"), power))))
    )
