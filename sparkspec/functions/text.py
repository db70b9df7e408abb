"""Identifiers, labels and formulas as text."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def clean_id(name: Column) -> Column:
    """An id without trailing white space and without non-word characters at its ends."""
    return F.regexp_replace(F.rtrim(name), r"^\W+|\W+$", "")


def excel_letters(index: Column) -> Column:
    """Letters of a zero-based column number: 0 is A, 25 Z, 26 AA, 702 AAA, 18278 AAAA; null below 0 and beyond seven letters (8 353 082 581)."""
    i, out, first = index.cast("long"), F.lit(None).cast("string"), 0
    for digits in range(1, 8):
        letters = [F.char((F.lit(65) + F.floor((i - first) / 26**d) % 26).cast("int")) for d in range(digits - 1, -1, -1)]
        out = F.when((i >= first) & (i < first + 26**digits), F.concat(*letters)).otherwise(out)
        first += 26**digits
    return out


def line_parts(key: Column) -> list[Column]:
    """element, line and suffix (null without one) of a key such as Fe_Ka1 or Fe_Ka1_escSiKa."""
    parts = F.split(key, "_", 3)
    return [F.get(parts, F.lit(0)).alias("element"), F.get(parts, F.lit(1)).alias("line"), F.get(parts, F.lit(2)).alias("suffix")]


def latex_formula(formula: str, dollars: bool = True) -> str:
    """A formula with its amounts as LaTeX subscripts; an amount of 1 is not shown, brackets may nest."""
    body = re.sub(r"(?<=[A-Za-z)\]}])(\d+\.?\d*)", lambda m: "" if float(m[1]) == 1 else f"_{{{m[1]}}}", formula)
    return f"${body}$" if dollars else body


def contamination_comment(value: Column, low: Column) -> Column:
    """The comment on a spectrum's least background under its reference lines."""
    return F.format_string("%.1f min. ref. bckgrnd counts%s", value, F.when(low, F.lit(", too low")).otherwise(F.lit("")))
