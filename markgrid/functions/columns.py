"""Scalar expressions shared by the operators: all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = ("A", "B", "C", "D", "E")
#: Choice labels of right-to-left sheets, by rank.
ARABIC = ("أ", "ب", "ج", "د", "هـ")


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def half_even(x: Column) -> Column:
    """Round to a whole number, halves to even."""
    return F.bround(x, 0).cast("int")


def choice_label(rank: Column, lang: Column | None = None) -> Column:
    """The label of a choice rank (0 is first); '?' out of range."""
    pick = lambda labels: F.coalesce(F.get(F.array(*map(F.lit, labels)), rank), F.lit("?"))
    return pick(LETTERS) if lang is None else F.when(lang == "ar", pick(ARABIC)).otherwise(pick(LETTERS))


def nano(x: Column) -> Column:
    """x in whole billionths: sums of it do not depend on the order of rows."""
    return F.floor(x * 1e9 + 0.5).cast("long")


def nano_mean(x: Column) -> Column:
    """Mean of x over a group from whole billionths, as a double."""
    return F.sum(nano(x)) / F.count(x) / F.lit(1e9)


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def code_role(value: Column) -> Column:
    """Role of a decoded code: student if it starts with STU in any case, else exam."""
    return F.when(F.upper(value).startswith("STU"), "student").otherwise("exam")


def template_id(n_questions: Column, n_choices: Column) -> Column:
    return F.format_string("Q%d_%dch", n_questions, n_choices)


def template_numbers(name: Column) -> tuple[Column, Column]:
    """Questions and choices of a template id; null if it isn't one."""
    pattern = r"^Q(\d+)_(\d+)ch$"
    part = lambda i: F.when(name.rlike(pattern), F.regexp_extract(name, pattern, i).cast("int"))
    return part(1), part(2)


def rounded(x: Column, digits: int) -> Column:
    """x (0 or more) to so many digits, at most 4, by its exact binary value, halves to even. Spark's own
    rounding works on the shortest decimal text of x, so 2.675 would become 2.68 there, not 2.67.

    The fraction is taken in units of 2^-60, or of 2^-67 below 2^-8, so that no bit that could decide is
    cut, and multiplied by 10^digits in two halves of 30 bits."""
    power, mask = 10**digits, F.lit((1 << 30) - 1)
    whole = F.floor(x)
    small = x - whole < 2.0**-8
    unit = F.floor((x - whole) * F.when(small, 2.0**67).otherwise(2.0**60)).cast("long")
    low = unit.bitwiseAND(mask) * power
    high = F.shiftright(unit, 30) * power + F.shiftright(low, 30)
    low = low.bitwiseAND(mask)
    part = lambda bits: (whole * power + F.shiftright(high, bits), high.bitwiseAND(F.lit((1 << bits) - 1)), F.lit(1 << bits - 1))

    def nearest(down: Column, rest: Column, half: Column) -> Column:
        return down + ((rest > half) | ((rest == half) & ((low > 0) | (down % 2 == 1)))).cast("int")

    return F.when(small, nearest(*part(37))).otherwise(nearest(*part(30))).cast("double") / F.lit(float(power))


def percent(x: Column) -> Column:
    """A share as whole percent, halves to even: '43%'."""
    return F.concat(rounded(x * 100, 0).cast("int").cast("string"), F.lit("%"))


def suffix(name: Column, default: str = ".jpg") -> Column:
    """The lower-cased suffix of a file name, or the default."""
    found = F.regexp_extract(F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/]*)$", 1), r"[^.](\.[^.]+)$", 1)
    return F.when(found == "", F.lit(default)).otherwise(F.lower(found))


def stem(name: Column) -> Column:
    """The last part of a path without its suffix."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/]*)$", 1), r"(?<=[^.])\.[^.]+$", "")
