"""URL filters: rules by host and path first, then a tree of path templates for each host, judged by labelled purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .skew import salted_join
from .work import Work, spare

#: the rules of the contract: (verdict, host/path)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    rest = F.regexp_extract(rest, r"(?s)^[^?#]*", 0)
    return F.translate(F.regexp_extract(rest, r"(?s)^[^/]*", 0), *_AZ), F.regexp_replace(rest, r"(?s)^[^/]*", "")


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits (the first given, of equally long ones) and its verdict, or nulls."""
    named, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        named, verdict = F.when(fits, F.lit(rule)).otherwise(named), F.when(fits, F.lit(kind)).otherwise(verdict)
    return named, verdict


def shapes(path: Column, depth: int, longest: int = 64) -> Column:
    """The segments of a path with each run of digits as 0 and long hexadecimal or overlong segments as x; past ``depth`` segments, one ``**``."""
    parts = F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(path, "^/", ""), "/", depth + 1))
    shape = lambda s: F.when(F.regexp_like(s, F.lit("^[0-9A-Fa-f-]{16,}$")), F.lit("x")).otherwise(_short(F.regexp_replace(s, "[0-9]+", "0"), longest))
    named = F.transform(F.slice(parts, 1, depth), shape)
    return F.when(F.size(parts) > depth, F.concat(named, F.array(F.lit("**")))).otherwise(named)


def _short(shape: Column, longest: int) -> Column:
    return F.when(F.length(shape) > longest, F.lit("x")).otherwise(shape)


def _level(paths: DataFrame, i: int, fan: int, work: Work) -> DataFrame:
    """``paths`` (host, segs, n, bad, good, prefix) with segment ``i`` of each prefix generalised and merged.

    Of a node with more than ``fan`` shapes, those with less than 1 / ``fan`` of
    its pages become one wildcard. Two branches then merge if both resemble
    their node: in the shapes that follow, by a total variation within
    0.25 + 1 / sqrt(pages), and in their labels, by a share of bad ones within
    2.58 standard errors of the node's. Branches without labels only merge
    with such ones. So every test is against the node, none between siblings.
    """
    keys = ["host", "prefix"]
    some = paths.where(F.size("segs") > i).withColumns({"seg": F.element_at("segs", i + 1), "next": F.when(F.size("segs") > i + 1, F.element_at("segs", i + 2)).otherwise(F.lit("/"))})
    seen = work.table(some.groupBy(*keys, "seg", "next").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")]), "steps")
    kinds = seen.groupBy(*keys, "seg").agg(F.sum("n").alias("n"))
    nodes = work.table(kinds.groupBy(*keys).agg(F.count(F.lit(1)).alias("shapes"), F.sum("n").alias("pages")), "nodes")
    kinds = salted_join(kinds, nodes, keys, ["seg"])
    branch = F.when((F.col("shapes") > fan) & (F.col("n") * fan < F.col("pages")), F.lit("*")).otherwise(F.col("seg")).alias("branch")
    kinds = work.table(kinds.select(*keys, "seg", branch), "branches")
    steps = work.table(seen.join(kinds, [*keys, "seg"]).groupBy(*keys, "branch", "next").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")]), "followed")
    # at most fan + 1 branches a node from here on
    one = lambda by: [F.sum(c).alias(by + c) for c in ("n", "bad", "good")]
    each = steps.groupBy(*keys, "branch").agg(*one("b_"))
    node = each.groupBy(*keys).agg(*[F.sum("b_" + c).alias("t_" + c) for c in ("n", "bad", "good")])
    pooled = steps.groupBy(*keys, "next").agg(F.sum("n").alias("all"))
    each = work.table(salted_join(each, node, keys, ["branch"]), "sums")
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    near = steps.join(pooled, [*keys, "next"]).join(each.select(*keys, "branch", "b_n", "t_n"), [*keys, "branch"])
    near = near.groupBy(*keys, "branch").agg(F.sum(F.least(whole("n") * whole("t_n"), whole("all") * whole("b_n"))).alias("met"))
    each = each.join(near, [*keys, "branch"])
    alike = (1 - F.col("met").cast("double") / (F.col("b_n").cast("double") * F.col("t_n"))) <= 0.25 + 1 / F.sqrt("b_n")
    labelled, rate = F.col("b_bad") + F.col("b_good"), F.col("t_bad") / F.greatest(F.lit(1), F.col("t_bad") + F.col("t_good"))
    fair = F.abs(F.col("b_bad") - rate * labelled) <= 2.58 * F.sqrt(rate * (1 - rate) * labelled)
    group = F.when(~alike, F.concat(F.lit("="), "branch")).when(labelled == 0, F.lit("none")).when(fair, F.lit("some")).otherwise(F.concat(F.lit("="), "branch"))
    grouped = work.table(each.select(*keys, "branch", group.alias("group")), "alike")
    names = grouped.groupBy(*keys, "group").agg(F.sort_array(F.collect_set("branch")).alias("names"))
    name = F.when(F.size("names") == 1, F.element_at("names", 1)).otherwise(F.concat(F.lit("{"), F.array_join("names", "|"), F.lit("}")))
    named = grouped.join(names, [*keys, "group"]).select(*keys, "branch", name.alias("name"))
    step = work.table(kinds.join(named, [*keys, "branch"]).select(*keys, "seg", "name"), "names")
    held = paths.withColumn("seg", F.when(F.size("segs") > i, F.element_at("segs", F.least(F.size("segs"), F.lit(i + 1)))).otherwise(F.lit("/")))
    joined = salted_join(held, step, [*keys, "seg"], ["segs"], how="left")
    return work.table(joined.withColumn("prefix", F.when(F.size("segs") > i, F.concat("prefix", F.lit("/"), "name")).otherwise(F.col("prefix"))).drop("seg", "name"), "level")


def path_templates(pages: DataFrame, work: Work, *, depth: int, fan: int, weight: float) -> DataFrame:
    """(host, segs, template, n, bad, good, purity) for each host and tuple of shapes of ``pages`` (host, segs, bad: true, false or null)."""
    label = lambda v: F.count_if(F.col("bad") == v)
    paths = work.table(pages.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), label(True).alias("bad"), label(False).alias("good")).withColumn("prefix", F.lit("")), "paths")
    sums = paths.agg(F.max(F.size("segs")), F.sum("bad"), F.sum("good")).first()
    base = ((sums[1] or 0) + 1) / ((sums[1] or 0) + (sums[2] or 0) + 2)
    for i in range(sums[0] or 0):
        paths = _level(paths, i, fan, work)
    judged = paths.groupBy("host", "prefix").agg(*[F.sum(c).alias("t_" + c) for c in ("n", "bad", "good")])
    judged = judged.withColumn("purity", (F.col("t_bad") + F.lit(weight * base)) / (F.col("t_bad") + F.col("t_good") + F.lit(weight)))
    return salted_join(paths.select("host", "prefix", "segs", "n"), work.table(judged, "judged"), ["host", "prefix"], ["segs"]).select("host", "segs", F.col("prefix").alias("template"), "n", F.col("t_n").alias("pages"), F.col("t_bad").alias("bad"), F.col("t_good").alias("good"), "purity")


def judge_urls(pages: DataFrame, *, rules=RULES, labels: str | None = None, url: str = "url", depth: int = 6, fan: int = 8, weight: float = 4.0, reject: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, verdict (allow or block), template and purity.

    Rules (verdict, host/path) are a short list, part of the plan: one fits its
    host and all subdomains if the path starts with the rule's; the longest
    wins, of equally long ones the first. Pages of a rule are the labelled ones;
    the boolean column ``labels``, if named, labels the others (true: to
    block, null: not known).

    Every host has a tree over its paths. Segments are generalised by shape
    (``shapes``), then level by level by counts and likeness (``_level``), so a
    node keeps at most ``fan`` + 1 branches. A path's branches make its
    template, whose purity is the share of bad labelled pages, smoothed with
    ``weight`` pages of the share over all labelled pages. Pages without a rule
    are blocked where purity is at least ``reject`` and the template holds a bad
    labelled page; without such evidence they are allowed. Past ``depth``
    segments a path counts as ended.

    A null URL, or one without ``://``, has an empty host and path, and no rule.
    Repeated rows and null ids stay and count each. An empty table gives an
    empty result. Columns that would clash with the new ones give way.
    """
    spark = pages.sparkSession
    work = Work(spark)
    new = ["host", "path", "rule", "verdict", "template", "purity"]
    source = F.col(url).cast("string")
    host, path = host_and_path(source)
    bad = F.col(labels).cast("boolean") if labels else F.lit(None).cast("boolean")
    taken = [c for c in pages.columns if c.lower() not in new]
    seg, lab, kind = (spare(pages, c) for c in ("_segs", "_bad", "_kind"))
    found = pages.select(*taken, host.alias("host"), path.alias("path"), bad.alias(lab))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    found = found.withColumns({"rule": rule, kind: verdict, seg: shapes(F.col("path"), depth)}).withColumn(lab, F.coalesce(F.col(kind) == "block", F.col(lab)))
    found = work.table(found, "found")
    templates = work.table(path_templates(found.select("host", F.col(seg).alias("segs"), F.col(lab).alias("bad")), work, depth=depth, fan=fan, weight=weight), "templates")
    side = templates.select("host", F.col("segs").alias(seg), "template", "purity", (F.col("bad") > 0).alias(lab + "_"))
    counts = templates.select("host", F.col("segs").alias(seg), "n")
    joined = salted_join(found, side, ["host", seg], ["path", *taken[:1]], counts=counts)
    method = F.when(F.col(lab + "_") & (F.col("purity") >= reject), "block").otherwise("allow")
    return joined.select(*taken, "host", "path", "rule", F.coalesce(kind, method).alias("verdict"), "template", "purity")
