"""Joins whose hot keys are salted."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def salted_join(rows: DataFrame, side: DataFrame, on: list[str], by: list[str], *, counts: DataFrame | None = None, how: str = "inner", parts: int = 200, least: int = 64) -> DataFrame:
    """``rows`` joined with ``side`` (at most a few rows a key) on the columns ``on``, none of which is null.

    A key with more than 1 / ``parts`` of all rows, so one of ``parts`` keys at
    most, is dealt by a hash of the columns ``by`` into as many pieces as it
    holds such shares, and its row of ``side`` is repeated for each piece. The
    list of hot keys, by hash, stands in the plan, so no join looks them up; a
    key that shares a hot one's hash is dealt like it on both sides.
    ``counts`` has the key and n, its number of rows; without it they are counted.
    """
    counts = counts if counts is not None else rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    total, top = counts.agg(F.sum("n"), F.max("n")).first()
    if not total or top <= least or top * parts <= total:
        return rows.join(side, on, how)
    kinds = dict(rows.dtypes)
    key = F.xxhash64(*[F.col(c).cast(kinds[c]) for c in on])
    first = counts.select(key.alias("k"), "n").orderBy(F.desc("n"), "k").limit(parts).collect()
    hot: dict[int, int] = {}
    for r in first:
        if r.n > least and r.n * parts > total:
            hot[r.k] = max(hot.get(r.k, 0), -(-r.n * parts // total))
    pieces = F.element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]), key)
    of = F.when(key.isin(list(hot)), pieces).otherwise(F.lit(1))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(F.lit(29), *by), of.cast("long")).cast("int"))
    many = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), of.cast("int") - 1)))
    return dealt.join(many, [*on, "_salt"], how).drop("_salt")
