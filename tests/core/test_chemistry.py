import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sparkspec.functions import chemistry as ch, formulas
from sparkspec.functions.text import latex_formula


def test_tables_are_whole():
    assert len(ch.SYMBOLS) == len(ch.MASSES) == 92 == len(set(ch.SYMBOLS))
    assert (ch.Z["Fe"], ch.Z["Pb"], ch.Z["U"]) == (26, 82, 92)
    assert ch.MASS["Fe"] == 55.845 and ch.MASS["Pb"] == 207.2


@pytest.mark.parametrize("text, amounts", [
    ("SiO2", {"Si": 1, "O": 2}), ("Ca(OH)2", {"Ca": 1, "O": 2, "H": 2}), ("K(Al2(Si3Al)O10)(OH)2", {"K": 1, "Al": 3, "Si": 3, "O": 12, "H": 2}), ("Li0.5CoO2", {"Li": 0.5, "Co": 1, "O": 2}), ("[Fe(CN)6]", {"Fe": 1, "C": 6, "N": 6}),
])
def test_formulas(text, amounts):
    assert ch.parse_formula(text) == amounts


@pytest.mark.parametrize("text", ["", "Xy2", "Si(O2", "SiO2)", "2", None, "()"])
def test_bad_formulas(text):
    with pytest.raises(ValueError):
        ch.parse_formula(text)


def test_reduced_and_pretty():
    assert ch.reduced_formula("Si2O4") == ch.reduced_formula("O2Si") != ch.reduced_formula("SiO")
    assert ch.pretty_formula({"Si": 0.333, "O": 0.666, "Fe": 0.001}) == "OSi2"[:0] + ch.pretty_formula({"O": 0.666, "Si": 0.333})
    assert latex_formula("Ca(OH)2") == "$Ca(OH)_{2}$" and latex_formula("Fe1O2", False) == "FeO_{2}"


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.sampled_from(ch.SYMBOLS[:40]), st.floats(0.01, 1), min_size=1, max_size=6))
def test_fractions_round_trip(spark, amounts):
    total = sum(amounts.values())
    rows = [(1, e, v / total) for e, v in amounts.items()]
    df = spark.createDataFrame(rows, "k int, element string, at_fr double")
    back = ch.mass_to_atomic(ch.atomic_to_mass(df, ["k"]).drop("at_fr"), ["k"]).collect()
    for r in back:
        assert math.isclose(r.at_fr, amounts[r.element] / total, rel_tol=1e-9)
    assert math.isclose(sum(r.w_fr for r in back), 1, rel_tol=1e-9)


def test_normalisation_cases(spark):
    rows = [("high", "Fe", 0.9), ("high", "O", 0.3), ("low", "Fe", 0.5), ("low", "O", 0.3), ("fine", "Fe", 0.7), ("fine", "O", 0.28)]
    df = spark.createDataFrame(rows, "k string, element string, w_fr double")
    sums = {r.k: r.s for r in ch.normalise_mass_fractions(df, ["k"], undetectable=0.05).groupBy("k").agg({"w_fr": "sum"}).toDF("k", "s").collect()}
    assert sums == pytest.approx({"high": 1, "low": 0.95, "fine": 0.98})
    forced = {r.k: r.s for r in ch.normalise_mass_fractions(df, ["k"], force=True).groupBy("k").agg({"w_fr": "sum"}).toDF("k", "s").collect()}
    assert forced == pytest.approx({"high": 1, "low": 1, "fine": 1})


def _column(spark, values, of, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").select("i", of(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


def _parsed(text):
    try:
        return ch.parse_formula(text)
    except ValueError:
        return None


def _nested(children):
    amount = st.sampled_from(["", "2", "3", "0.5", ".25", "10", "1.", "1.0"])
    return st.lists(st.tuples(children, amount), min_size=1, max_size=3).map(lambda xs: "".join(a + n for a, n in xs)).flatmap(lambda s: st.sampled_from([f"({s})", f"[{s}]", f"{{{s}}}"]))


WELL = st.lists(st.recursive(st.sampled_from(["Fe", "O", "H", "Si", "C", "Co", "Pb"]), _nested, max_leaves=6), min_size=1, max_size=4).map("".join)


def test_formula_columns_equal_the_parser(spark):
    """Well formed, mangled and arbitrary formulas: amounts, reduced forms and LaTeX as columns equal those of the parser, null where it raises."""
    import random

    rng = random.Random(6)
    some: list[str] = []

    @settings(max_examples=150, deadline=None, database=None, derandomize=True)
    @given(WELL, st.text(alphabet="FeOSi(2[.5)] x", max_size=9))
    def grow(formula, junk):
        cut = rng.randrange(len(formula))
        some.extend([formula, formula[:cut] + formula[cut + 1 :], formula + "2", "2" + formula, junk])

    grow()
    some += ["", None, "()", "()Fe", "Fe()2", " Ca (OH) 2", "(2Fe)", "Fe2.3.4", "Xy2", "Cx", "(Fe]2", "FeO)(", "Fe" * 40]
    want = [_parsed(f) for f in some]
    got = _column(spark, some, formulas.formula_amounts)
    assert [g is None for g in got] == [w is None for w in want] and sum(w is not None for w in want) > 100
    assert all(g == pytest.approx(w) for g, w in zip(got, want) if w is not None)
    small = [f for f, w in zip(some, want) if w is not None and all(abs(v * 1000 - round(v * 1000)) < 1e-9 and v < 900 for v in w.values())]
    assert _column(spark, small, formulas.reduced_formula_of) == [ch.reduced_formula(f) for f in small]
    latin = [f for f, w in zip(some, want) if w is not None]
    assert _column(spark, latin, formulas.latex_of) == [latex_formula(f) for f in latin]
    masses = _column(spark, latin, lambda c: formulas.formula_mass_of(formulas.formula_amounts(c)))
    assert masses == pytest.approx([ch.formula_mass(f) for f in latin])
    shares = _column(spark, latin, lambda c: formulas.mass_fractions_of_amounts(formulas.formula_amounts(c)))
    assert all(s == pytest.approx(ch.mass_fractions_of(f)) for s, f in zip(shares, latin))


def test_pretty_column(spark):
    maps = [{"Si": 0.333, "O": 0.666, "Fe": 0.001}, {}, None, {"Fe": 0.004}, {"O": 0.6, "Fe": 0.4}, {"Zz": 0.5, "O": 0.5}]
    got = _column(spark, maps, formulas.pretty_of, "map<string,double>")
    assert got == [None if m is None else ch.pretty_formula(m) for m in maps]


def test_formula_columns_stay_in_catalyst(spark):
    plan = spark.range(1).select(formulas.reduced_formula_of(F.lit("Ca(OH)2")).alias("x"))
    assert plan.first().x == "CaH2O2" and "Python" not in plan._jdf.queryExecution().executedPlan().toString()
