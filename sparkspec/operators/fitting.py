"""Spectrum fitting and quantification over DataFrames: one Arrow pass, one spectrum at a time inside it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.spectra import total_counts
from ..physics.fit import Instrument, SpectrumFit, Tables, quantify
from .lines import background_at
from .select import background_comment, fit_quality, post_fit_flag, spectrum_flag

_PEAK = "array<struct<element:string,line:string,energy_kev:double,center:double,sigma:double,fwhm:double,area:double,intensity:double,background:double,pb:double>>"
RESULT = f"w_fr map<string,double>, at_fr map<string,double>, an_err double, r_squared double, redchi_sq double, quant_flag int, comments string, peaks {_PEAK}, background array<double>, absorbed double"
#: Spectra whose results a task holds at once.
_AT_ONCE = 64
_FIELDS = ("element", "line", "energy_kev", "center", "sigma", "fwhm", "area", "intensity", "background", "pb")


def flagged(spectra: DataFrame, instrument: Instrument, target: float, min_background: float) -> DataFrame:
    """Spectra with ``quant_flag``: null where a fit may be tried (see ``spectrum_flag``)."""
    i = instrument
    window = F.slice("counts", i.start + 1, i.stop - i.start)
    axis = F.transform(F.sequence(F.lit(i.start), F.lit(i.stop - 1)), lambda c: F.lit(i.offset_kev) + F.lit(i.width_kev) * c)
    return spectra.withColumn("quant_flag", spectrum_flag(F.col("counts"), axis, target, min_background, window))


def judged(results: DataFrame, instrument: Instrument, min_background: float, substrate: list[str] = (), *, strict: bool = False) -> DataFrame:
    """Fitted spectra with their final flag: poor fit, analytical error, substrate or a low background under the reference lines.

    ``absorbed`` is the share that a particle absorbs, null for others. A low
    background is told in ``comments``.
    """
    flag, peaks = F.col("quant_flag"), F.col("peaks")
    total = total_counts(F.col("counts"))
    absorbed, particle = (F.col("absorbed"), F.lit(True)) if "absorbed" in results.columns else (F.lit(None).cast("double"), F.lit(False))
    held = lambda e: F.aggregate(F.filter(peaks, lambda p: p["element"] == e), F.lit(0.0), lambda a, p: a + p["intensity"])
    dirty = F.coalesce(F.greatest(F.lit(False), F.lit(False), *[held(e) > 0.1 * total for e in substrate]), F.lit(False))
    low = background_at(F.col("background"), peaks, instrument.offset_kev + instrument.start * instrument.width_kev, instrument.width_kev)
    found = post_fit_flag(fit_quality(F.col("redchi_sq"), total, F.col("an_err"), absorbed, particle), F.lit(False), dirty, low, min_background, flag == 0, strict=strict)
    fitted = flag.isin(0, -1)
    told = F.when(fitted & (low < min_background), background_comment(low, min_background)).otherwise(F.col("comments"))
    return results.withColumns({"quant_flag": F.when(fitted, found).otherwise(flag).cast("int"), "comments": told})


def quantified(spectra: DataFrame, elements: list[str], instrument: Instrument, tables: Tables, standards: dict[tuple[str, str], float] | None, *, key: list[str], target: float, min_background: float = 1.0, substrate: list[str] = (), parallelism: int | None = None, strict: bool = False) -> DataFrame:
    """``spectra`` (key, counts, ...) with the result columns of ``RESULT``.

    Rows are independent, so one Arrow pass without a shuffle does it;
    ``parallelism`` deals few large files out first. Invalid spectra are
    flagged in Catalyst and skip the fit. A failing fit gets flag 9 and its
    message; other rows are untouched. Fitted ones are judged (``judged``). Without ``standards`` only the fit is
    made, for standards themselves. A row whose ``is_particle`` is true gets
    the way out of a particle fitted. Tables are the user's line, absorption and
    ionisation data, some hundred kilobytes, and travel with the function.
    """
    spectra = spectra.drop("quant_flag", "absorbed")
    rows = flagged(spectra, instrument, target, min_background)
    if parallelism:
        rows = rows.repartition(parallelism)
    base = ", ".join(f"`{c}` {k}" for c, k in spectra.dtypes)
    names, particles = spectra.columns, "is_particle" in spectra.columns

    def one(counts, flag, particle, model):
        if flag is not None and flag == flag:
            return {"quant_flag": int(flag)}
        try:
            if standards is None:
                fit = model.again(counts)
                got = fit.solve(fit.shape({e: 1 / len(elements) for e in elements}))
                out = {"r_squared": got["r2"], "redchi_sq": got["redchi"], "quant_flag": 0 if got["ok"] else -1, "peaks": fit.peaks(got), "background": got["background"].tolist()}
            else:
                out = quantify(counts, elements, instrument, tables, standards, substrate, particle=particle is not None and bool(particle), model=model)
        except Exception as error:  # a row's failure is that row's result
            return {"quant_flag": 9, "comments": f"{type(error).__name__}: {error}"[:500]}
        out["peaks"] = [{k: p[k] for k in _FIELDS} for p in out["peaks"]]
        return out

    def run(batches):
        model = None
        for whole in batches:
            if model is None and len(whole):
                model = SpectrumFit(np.zeros(instrument.stop), elements, instrument, tables, substrate)
            for at in range(0, len(whole), _AT_ONCE):
                rows = whole.iloc[at : at + _AT_ONCE]
                done = pd.DataFrame([one(None if c is None else np.asarray(c, float), f, p, model) for c, f, p in zip(rows["counts"], rows["quant_flag"], rows["is_particle"] if particles else [None] * len(rows))], index=rows.index, columns=["w_fr", "at_fr", "an_err", "r_squared", "redchi_sq", "quant_flag", "comments", "peaks", "background", "absorbed"])
                done = done.astype(object).where(done.notna(), None)
                yield pd.concat([rows[names], done], axis=1)

    done = rows.mapInPandas(run, f"{base}, {RESULT}")
    return done if standards is None else judged(done, instrument, min_background, list(substrate), strict=strict)


def peak_rows(results: DataFrame, key: list[str]) -> DataFrame:
    """One row a fitted peak."""
    return results.select(*key, F.explode("peaks").alias("p")).select(*key, "p.*")


def fit_parameters(results: DataFrame, key: list[str]) -> DataFrame:
    """Wide parameters of each spectrum that has an accepted flag, for ``stats.with_summary_rows``: those of the fit, and area, width, background and ratio of each element's line."""
    good = results.where(F.col("quant_flag").isin(0, -1))
    names = sorted(r.n for r in good.select(F.explode(F.transform("peaks", lambda p: F.concat_ws("_", p["element"], p["line"]))).alias("n")).distinct().collect())  # lines of the elements
    of = lambda name, field: F.get(F.filter("peaks", lambda p: F.concat_ws("_", p["element"], p["line"]) == name), F.lit(0))[field]
    return good.select(*key, "an_err", "r_squared", "redchi_sq", *[of(n, f).alias(f"{n}_{f}") for n in names for f in ("center", "sigma", "area", "background", "pb")])
