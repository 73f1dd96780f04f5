"""Typed scalar operators whose semantics differ from Spark's defaults; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agentlake.errors import BindError

#: Doubles at or beyond this have no exact long.
_TWO_63 = 9223372036854775808.0


def int_div(left: Column, right: Column, kind: str = "bigint") -> Column:
    """Division that truncates towards zero; a zero divisor raises."""
    return F.call_function("div", left, right).cast(kind)


def float_div(left: Column, right: Column) -> Column:
    return left.cast("double") / right.cast("double")


def exact_cmp(whole: Column, real: Column) -> Column:
    """-1, 0 or 1: a BIGINT against a DOUBLE by exact value, never by widening; NaN is greatest; null propagates."""
    floor = F.floor(real)
    inside = F.when(whole < floor, -1).when(whole > floor, 1).when(real > F.floor(real).cast("double"), -1).otherwise(0)
    known = F.when(F.isnan(real) | (real >= _TWO_63), -1).when(real < -_TWO_63, 1).otherwise(inside)
    return F.when(whole.isNotNull() & real.isNotNull(), known)


def exact_eq(whole: Column, real: Column) -> Column:
    return exact_cmp(whole, real) == 0


def exact_lt(whole: Column, real: Column) -> Column:
    return exact_cmp(whole, real) < 0


def decimal_key(text: Column) -> Column:
    """A binary-sortable key of a decimal's digit text of any length: equal numbers have equal keys.

    Sign, number of whole digits and digits; a negative number's digits are complemented.
    Texts that are no plain decimals give null.
    """
    plain = F.when(text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), text)
    body = F.regexp_replace(plain, r"^[+-]", "")
    whole = F.regexp_replace(F.regexp_extract(body, r"^([0-9]*)", 1), "^0+", "")
    part = F.regexp_replace(F.regexp_extract(body, r"\.([0-9]*)$", 1), "0+$", "")
    size = F.lpad(F.length(whole).cast("string"), 9, "0")
    digits = F.concat(size, whole, F.lit("."), part)
    zero = (F.length(whole) == 0) & (F.length(part) == 0)
    flipped = F.concat(F.translate(digits, "0123456789", "9876543210"), F.lit("~"))
    negative = plain.startswith("-") & ~zero
    return F.when(plain.isNotNull(), F.when(zero, F.lit("1")).when(negative, F.concat(F.lit("0"), flipped)).otherwise(F.concat(F.lit("2"), digits)))


def ts_shift(ts_ms: Column, delta: Column) -> Column:
    """TIMESTAMP plus a whole number of milliseconds."""
    return ts_ms + delta.cast("bigint")


def ts_diff(left_ms: Column, right_ms: Column) -> Column:
    return left_ms - right_ms


def arithmetic(op: str, left: Column, right: Column, lt: str, rt: str) -> tuple[Column, str]:
    """(expression, type) of a typed binary operator; types are the engine's names."""
    whole = {"INTEGER": "int", "BIGINT": "bigint"}
    if "NULL" in (lt, rt):
        other = rt if lt == "NULL" else lt
        return F.lit(None).cast(whole.get(other, "double")), other
    if lt in whole and rt in whole:
        out = "INTEGER" if lt == rt == "INTEGER" else "BIGINT"
        a, b = left.cast(whole[out]), right.cast(whole[out])
        return (int_div(a, b, whole[out]) if op == "/" else {"+": a + b, "-": a - b, "*": a * b}[op]), out
    if "FLOAT" in (lt, rt) and {lt, rt} <= {"FLOAT", *whole}:
        a, b = left.cast("double"), right.cast("double")
        return {"+": a + b, "-": a - b, "*": a * b, "/": a / b}[op], "FLOAT"
    if lt == rt == "TIMESTAMP" and op == "-":
        return ts_diff(left, right), "BIGINT"
    if lt == "TIMESTAMP" and rt in whole and op in "+-":
        return (ts_shift(left, right) if op == "+" else ts_shift(left, -right)), "TIMESTAMP"
    if lt in whole and rt == "TIMESTAMP" and op == "+":
        return ts_shift(right, left), "TIMESTAMP"
    raise BindError(f"operator {op} is not defined for {lt} and {rt}; DECIMAL and VARCHAR have no arithmetic, compare or cast instead")
