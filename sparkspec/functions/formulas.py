"""Chemical formulas as columns: a stack machine over their tokens, in Catalyst expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .chemistry import SYMBOLS, atomic_mass, atomic_number

_TOKEN = r"[A-Z][a-z]?|[(\[{]|[)\]}]|[0-9]+\.?[0-9]*|\.[0-9]+"


def _amounts(formula: Column) -> Column:
    """struct(ok, out): whether the formula reads well, and its atoms with their amounts, from right to left.

    Read from the right, an amount stands before what it multiplies: it waits
    in ``times`` until an element or a closing bracket takes it, which pushes
    it, multiplied, on the stack that the opening bracket pops.
    """
    clean = F.regexp_replace(F.coalesce(formula, F.lit("")), r"\s", "")
    tokens = F.regexp_extract_all(clean, F.lit(f"({_TOKEN})"), F.lit(1))
    start = F.struct(F.array(F.lit(1.0)).alias("stack"), F.lit(None).cast("double").alias("times"), F.array().cast("array<struct<el:string,n:double>>").alias("out"), (F.concat_ws("", tokens) == clean).alias("ok"))

    def read(now: Column, token: Column) -> Column:
        top, depth = F.element_at(now["stack"], -1), F.size(now["stack"])
        number, opens, closes = token.rlike("^[0-9.]"), token.isin("(", "[", "{"), token.isin(")", "]", "}")
        taken = top * F.coalesce(now["times"], F.lit(1.0))
        none = F.lit(None).cast("double")
        stack = F.when(closes, F.concat(now["stack"], F.array(taken))).when(opens & (depth > 1), F.slice(now["stack"], 1, depth - 1)).otherwise(now["stack"])
        out = F.when(number | opens | closes, now["out"]).otherwise(F.concat(now["out"], F.array(F.struct(token.alias("el"), taken.alias("n")))))
        fine = F.when(number, now["times"].isNull()).when(opens, (depth > 1) & now["times"].isNull()).otherwise(closes | token.isin(*SYMBOLS))
        return F.struct(stack.alias("stack"), F.when(number, token.cast("double")).otherwise(none).alias("times"), out.alias("out"), (now["ok"] & fine).alias("ok"))

    done = lambda end: F.struct((end["ok"] & (F.size(end["stack"]) == 1) & end["times"].isNull() & (F.size(end["out"]) > 0)).alias("ok"), end["out"].alias("out"))
    return F.aggregate(F.reverse(tokens), start, read, done)


def formula_amounts(formula: Column) -> Column:
    """Amount of each element as a map; nested brackets and decimal amounts are allowed, null for anything else. As ``chemistry.parse_formula``, with null in place of an error."""
    def merged(read: Column) -> Column:
        names = F.array_distinct(F.transform(read["out"], lambda x: x["el"]))
        total = lambda e: F.aggregate(F.filter(read["out"], lambda x: x["el"] == e), F.lit(0.0), lambda s, x: s + x["n"])
        return F.when(read["ok"], F.map_from_entries(F.transform(names, lambda e: F.struct(e, total(e)))))

    # a one-element array binds what was read, so it is read once
    return F.get(F.transform(F.array(_amounts(formula)), merged), F.lit(0))


def _gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two non-negative longs; 96 steps are enough for any."""
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.greatest(s["b"], F.lit(1))).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(96)), F.struct(a.alias("a"), b.alias("b")), step, lambda s: s["a"])


def reduced_of(amounts: Column) -> Column:
    """A key that is equal for amounts of one composition: elements by symbol, amounts in thousandths without a common divisor; null for null."""
    scaled = F.transform(F.array_sort(F.map_entries(amounts)), lambda x: F.struct(x["key"].alias("el"), F.round(x["value"] * 1000).cast("long").alias("n")))

    def shown(rows: Column) -> Column:
        step = F.aggregate(rows, F.lit(0).cast("long"), lambda s, x: _gcd(s, x["n"]))
        each = F.transform(rows, lambda x: F.concat(x["el"], F.when(x["n"] == step, "").otherwise((x["n"] / step).cast("long").cast("string"))))
        return F.when(F.size(rows) > 0, F.concat_ws("", each))

    return F.get(F.transform(F.array(F.filter(scaled, lambda x: x["n"] > 0)), shown), F.lit(0))


def reduced_formula_of(formula: Column) -> Column:
    return reduced_of(formula_amounts(formula))


def formula_mass_of(amounts: Column) -> Column:
    """Molar mass."""
    return F.aggregate(F.map_entries(amounts), F.lit(0.0), lambda s, x: s + x["value"] * atomic_mass(x["key"]))


def mass_fractions_of_amounts(amounts: Column) -> Column:
    total = formula_mass_of(amounts)
    return F.get(F.transform(F.array(total), lambda t: F.transform_values(amounts, lambda e, n: n * atomic_mass(e) / t)), F.lit(0))


def pretty_of(fractions: Column, least: float = 0.005) -> Column:
    """A formula for atomic fractions: those under ``least`` are dropped, amounts are relative to the smallest, one decimal, elements by atomic number; null for null, empty if nothing is left."""
    kept = F.filter(F.map_entries(fractions), lambda x: x["value"] >= least)
    rows = F.array_sort(F.transform(kept, lambda x: F.struct(F.coalesce(atomic_number(x["key"]), F.lit(0.0)).alias("z"), x["key"].alias("el"), x["value"].alias("n"))))

    def shown(all_: Column) -> Column:
        small = F.array_min(F.transform(all_, lambda x: x["n"]))
        text = lambda x: F.regexp_replace(F.bround(x["n"] / small, 1).cast("decimal(18,1)").cast("string"), r"\.0$", "")
        return F.concat_ws("", F.transform(all_, lambda x: F.concat(x["el"], F.when(text(x) == "1", "").otherwise(text(x)))))

    return F.when(fractions.isNotNull(), F.get(F.transform(F.array(rows), shown), F.lit(0)))


def latex_of(formula: Column, dollars: bool = True) -> Column:
    """A formula with its amounts as LaTeX subscripts; an amount of 1 is not shown, brackets may nest."""
    bare = F.regexp_replace(formula, r"(?<=[A-Za-z)\]}])0*1(\.0*)?(?![\d.])", "")
    body = F.regexp_replace(bare, r"(?<=[A-Za-z)\]}])(\d+\.?\d*)", r"_{$1}")
    return F.concat(F.lit("$"), body, F.lit("$")) if dollars else body
