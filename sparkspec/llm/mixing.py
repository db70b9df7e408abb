"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .work import Work, repeats, spare


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget_pct: int = 150, max_epochs: int = 2) -> DataFrame:
    """(source, source_size, target) from one row a source.

    Sources in the order of their code points, null last, take the weights in
    turn and share ``budget_pct`` percent of all sizes. A target stops at
    ``max_epochs`` times its source's size; the excess is shared by weight
    among the rest until none is above. That end state is found directly: the
    sources that stop are those with the least size per weight. Rows are as
    many as sources, so the global windows stay small.
    """
    ranked = sizes.withColumn("_i", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"_w": share, "_cap": (F.col("source_size") * max_epochs).cast("double")})
    before = W.orderBy(F.col("_cap") / F.col("_w"), "_i").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    level = ranked.withColumns({
        "_capped": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_left": F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
        "_budget": F.sum("source_size").over(whole) * (budget_pct / 100),
    }).withColumn("_level", (F.col("_budget") - F.col("_capped")) / F.col("_left"))
    # the first source in that order whose cap lies above its share ends the capped ones
    open_ = F.min(F.when(F.col("_cap") >= F.col("_level") * F.col("_w"), F.struct(F.col("_cap") / F.col("_w"), F.col("_i"), F.col("_level")))).over(whole)
    level = level.withColumn("_open", open_)
    target = F.when(F.col("_open").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_open")["_level"] * F.col("_w")))
    return level.select("source", "source_size", target.alias("target"))


#: Characters that are no letters: digits, marks and white space of ASCII.
_NO_LETTERS = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ \t\n\x0b\x0c\r"
_LEVELS = 16


def quality_level(words: Column, text: Column) -> Column:
    """Quality of a text in levels 1 to 16, from the statistics of its words.

    One level for being there, and up to five each for words of usual length
    (five for a mean of 4 to 10 characters, two for 3 to 12), for letters among
    the characters that are no white space, and for distinct words, measured
    as their square over four times the number of words.
    """
    n = F.greatest(F.size(words), F.lit(1))
    solid = F.char_length(F.translate(text, "\t\n\x0b\x0c\r ", ""))
    letters = F.char_length(F.translate(text, _NO_LETTERS, ""))
    distinct = F.size(F.array_distinct(words)).cast("long")
    usual = F.when(solid.between(n * 4, n * 10), 5).when(solid.between(n * 3, n * 12), 2).otherwise(0)
    rich = F.least(F.lit(5), F.floor(distinct * distinct / (n * 4)))
    return (F.lit(1) + usual + F.floor(letters * 5 / F.greatest(solid, F.lit(1))) + rich).cast("int")


def draw(docs: DataFrame, *, key: str = "doc_id", weight: str | None = None, weights: tuple[int, ...] = (3, 1, 2), budget_pct: int = 150, max_epochs: int = 2, seed: int = 17, bins: int = 4096) -> DataFrame:
    """(key, size, source_size, target, taken) for each row of ``docs`` (key, doc_id, source, text); see ``mix``."""
    work = Work(docs.sparkSession)
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double")
    u = (digest + 0.5) / float(1 << 48)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = F.least(F.lit(_LEVELS), F.greatest(F.lit(1), F.round(F.coalesce(F.col(weight), F.lit(0)) * _LEVELS))).cast("int") if weight else None
    # the array is bound once as a lambda variable, so the words are cut once a row
    measure = lambda w: F.struct(F.size(w).cast("long").alias("size"), (given if weight else quality_level(w, text)).alias("level"))
    found = F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0)), measure), F.lit(0))
    narrow = docs.select(F.col(key).alias("k"), "doc_id", "source", found.alias("f"), F.xxhash64("text").alias("tie"))
    rows = work.table(narrow.select("k", "doc_id", "source", "f.size", "f.level", "tie", (-F.log(u) / (F.col("f.level") / float(_LEVELS))).alias("draw")), "drawn")
    levels = rows.groupBy("source", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    # one row a source
    sources = levels.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.sum("n").alias("rows"), *[F.coalesce(F.sum(F.when(F.col("level") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(1, _LEVELS + 1)])
    sources = work.table(sources, "sources")
    targets = source_targets(sources.select("source", "source_size"), weights, budget_pct, max_epochs)
    targets = work.table(
        targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("long"))
        .withColumn("want", F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")), "targets")
    # the share of a source's rows expected below a draw, from the numbers of rows of each weight: it grows with the draw, and its slices hold equal shares
    below = sum(((F.col(f"n{i}") / F.col("rows")) * (1 - F.exp(-F.col("draw") * (i / _LEVELS))) for i in range(1, _LEVELS + 1)), F.lit(0.0))
    shares = sources.select(F.col("source").alias("s"), "rows", *[f"n{i}" for i in range(1, _LEVELS + 1)])
    binned = rows.join(shares, F.col("source").eqNullSafe(F.col("s"))).select("k", "doc_id", "source", "size", "tie", "draw", F.least(F.lit(bins - 1), F.floor(below * bins)).cast("int").alias("bin"))
    slices = work.table(binned.groupBy("source", "bin").agg(F.sum("size").alias("n")), "slices")
    upto = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    plan = slices.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        F.col("s.source").alias("s"), F.col("bin").alias("b"), "before", "source_size", "target", "epochs", "want")
    dealt = binned.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    run = W.partitionBy("s", "b").orderBy("draw", F.col("doc_id").asc_nulls_first(), "tie").rowsBetween(W.unboundedPreceding, -1)
    room = F.col("want") - F.col("before") - F.coalesce(F.sum("size").over(run), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), room))
    return dealt.select(F.col("k").alias(key), "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """All rows and columns of ``docs`` with size, source_size, target and taken.

    ``taken`` counts the words that the mix takes of a row: complete epochs of
    its source first, then a fraction of one. For the fraction each row gets
    an exponential key, -ln(u) / weight, with u from a hash of doc_id and
    ``seed``; rows in ascending order of key are taken until the source's
    budget is spent, the last one in part. The weight is the row's quality, by
    the statistics of its text in sixteenths (``quality_level``), or what the
    column named ``weight`` gives, from 0 to 1 (null: 0), in sixteenths and
    one at least. Null texts have size 0, take part and give nothing. Ties are
    broken by doc_id (null first), then a hash of the text. Reruns agree. An
    empty table gives an empty result.

    Only narrow rows are ranked, and the running sums never order a whole
    source in one task: keys fall into ``bins`` slices of a source that hold
    equal shares of its rows, slices are summed first, and rows are ordered
    within a slice. Texts meet their result by doc_id, or by a row number of a
    written copy where doc_ids repeat.
    """
    added = ("size", "source_size", "target", "taken")
    weight = how.get("weight")
    rest = docs.select(*[c for c in docs.columns if c not in added])
    key = spare(docs, "_key")
    if repeats(docs):
        keyed = Work(docs.sparkSession).table((docs if weight in added else rest).withColumn(key, F.monotonically_increasing_id()), "rows")
        return keyed.join(draw(keyed, key=key, **how), key).select(*rest.columns, *added)
    drawn = draw(docs, **how).withColumnRenamed("doc_id", key)
    return rest.join(drawn, F.col("doc_id").eqNullSafe(F.col(key))).select(*rest.columns, *added)


def mixed_documents(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: every document as often as whole, and at last cut after the words taken of it.

    ``mixed`` comes from ``mix``. Documents of which nothing is taken go,
    except those without words: they cost nothing and stay once.
    """
    copy = spare(mixed, "_copy")
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.ceil(F.col("taken") / F.col("size"))).cast("int")
    each = mixed.withColumn(copy, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
    part = F.least(F.col("size"), F.col("taken") - F.col("size") * (F.col(copy) - 1))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0)
    cut = F.when(part < F.col("size"), F.concat_ws("", F.slice(words, F.lit(1), part.cast("int")))).otherwise(F.col("text"))
    changed = each.withColumn("text", cut)
    return changed.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns) if "n_chars" in columns else changed.select(*columns)
