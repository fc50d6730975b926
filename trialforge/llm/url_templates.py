"""URL filter: host/path rules, and a tree of path templates for what no rule decides.

Paths are first reduced by form, row by row (runs of digits and long hexadecimal strings become placeholders), and
counted per host. Labels are votes on them: by default the verdicts of the rules, on the pages that rules cover. What
other hosts say of a path of the same form is its expected purity: each host has one vote at most, and the votes of all
hosts on paths that begin alike (up to the last segment), of all hosts on the same form, of those of its top-level domain
and of those of its registered domain (its last two labels) are smoothed one by the other, from a prior of mostly good. So pages of hosts without any label are judged by what the hosts that have
labels show, and rejected only where several agree.

The tree then grows one level at a time: a branch of a node becomes a wildcard if it is rare among many siblings and
too thin to be tested, or if what follows it and its purity are statistically like those of all its siblings together;
branches that differ keep their name. A template's purity is its own labels, smoothed by the expected purity of its
paths; it is rejected below `cut`. A path that is alone in its node keeps the rest of its segments as they are, and
levels go on until no node has two paths: there is no largest depth. Everything is DataFrame operations on counts; a
hot host is a group of partial counts and is never collected.

Edge cases: a null url, or one without "://", has an empty host and path, is covered by no rule, and is judged by the
template of the empty path; repeated rows get a row each; an empty table gives no rows. Labels that are null are no
evidence. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialforge.llm._common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What may follow a segment, for the profiles that are compared.
FOLLOWERS = {"end": lambda s: s.isNull(), "empty": lambda s: s == "", "number": lambda s: s == "{n}", "hex": lambda s: s == "{h}", "mixed": lambda s: s.contains("{"), "word": lambda s: F.lit(True)}


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where there is no "://"."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    found = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(found, pattern, 1), UPPER, LOWER), F.regexp_extract(found, pattern, 2)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict. rules: (verdict, "host/path")."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    fits = []
    for verdict, rule in ordered:
        top, _, rest = rule.partition("/")
        fits.append(((host == top) | host.endswith("." + top)) & path.startswith("/" + rest))
    pick = lambda values: reduce(lambda out, x: F.when(x[0], F.lit(x[1])).otherwise(out), reversed(list(zip(fits, values, strict=True))), F.lit(None).cast("string"))
    return pick([r for _, r in ordered]), pick([v for v, _ in ordered])


def shaped(path: Column) -> Column:
    """The path with long hexadecimal strings and runs of digits as placeholders."""
    return F.regexp_replace(F.regexp_replace(path, r"(?<![0-9A-Za-z])(?=[A-Fa-f-]*[0-9])[0-9A-Fa-f]{8,}(?:-[0-9A-Fa-f]{4,}){0,4}(?![0-9A-Za-z])", "{h}"), r"[0-9]+", "{n}")


def smoothed(good: Column, all_: Column, weight: float, prior: Column) -> Column:
    return (good + weight * prior) / (all_ + weight)


def expected(paths: DataFrame, weight: float = 4.0, prior: float = 0.9, hosts: float = 4.0) -> DataFrame:
    """paths (host, shaped, n, good, bad) with `expect`, the purity that the hosts' votes on paths of the same form give.

    A host's vote is its good share, and counts as much as its labels weigh against `weight` pages: one at most. Each
    wider circle of hosts is the prior of the narrower one, and counts as `hosts` votes.
    """
    label = F.regexp_extract("host", r"([^.]+\.)?([^.]+)$", 0)
    begin = F.regexp_replace("shaped", r"/[^/]*/?$", "")
    own = paths.withColumn("domain", label).withColumn("begin", F.when(begin != "", begin)).withColumn("top", F.regexp_extract("host", r"[^.]+$", 0)).withColumn("labels", F.col("good") + F.col("bad"))
    votes = own.where("labels > 0").withColumn("w", F.col("labels") / (F.col("labels") + weight)).withColumn("g", F.col("w") * F.col("good") / F.col("labels"))
    out = own.withColumn("expect", F.lit(prior))
    for circle in (["begin"], ["shaped"], ["shaped", "top"], ["shaped", "domain"]):
        told = votes.groupBy(*circle).agg(F.sum("g").alias("g"), F.sum("w").alias("w"))  # forms with labels only
        out = out.join(told, circle, "left")
        out = out.withColumn("expect", smoothed(F.coalesce("g", F.lit(0.0)), F.coalesce("w", F.lit(0.0)), hosts, F.col("expect"))).drop("g", "w")
    return out.select("host", "shaped", "n", "good", "bad", "expect")


def templates(paths: DataFrame, many: int = 8, rare: float = 0.02, thin: int = 16, apart: float = 0.15, purity_apart: float = 0.25, weight: float = 4.0) -> DataFrame:
    """host, shaped, template for each (host, shaped, n, good, bad, expect).

    many, rare, thin: a branch with less than `rare` of its node's pages is a wildcard if the node has `many` branches or
    more and the branch has too little evidence to be tested, at every size of the node: less than `thin` pages, and
    labels that weigh less than the prior. apart: largest total variation between a branch's followers and its node's,
    beside sampling noise. purity_apart: largest difference of a wildcard's purity to its siblings'.
    """
    # seg: the segments that are left of a path.
    open_ = paths.withColumn("weighed", F.col("n") * F.col("expect")).withColumn("seg", F.expr("slice(split(shaped, '/'), 2, greatest(size(split(shaped, '/')) - 1, 0))")).withColumn("template", F.lit(""))
    closed, level, counts = None, 1, ("n", "good", "bad", "weighed", *(f"f_{k}" for k in FOLLOWERS))
    while True:
        own, after = F.get("seg", F.lit(0)), F.get("seg", F.lit(1))
        kinds, earlier = {}, F.lit(False)
        for name, test in FOLLOWERS.items():
            kinds[name] = test(after) & ~earlier
            earlier = earlier | F.coalesce(test(after), F.lit(False))
        sums = [F.sum(c).alias(c) for c in ("n", "good", "bad", "weighed")] + [F.sum(F.when(F.coalesce(k, F.lit(False)), F.col("n")).otherwise(0)).alias(f"f_{name}") for name, k in kinds.items()]
        branch = open_.where(own.isNotNull()).groupBy("host", "template", own.alias("own")).agg(F.count("*").alias("paths"), F.min("seg").alias("low"), F.max("seg").alias("high"), *sums)
        # Pooled counts per node: a group-by and a join, so that a node with many branches is not one task's window.
        pooled = branch.groupBy("host", "template").agg(*[F.sum(c).alias(f"all_{c}") for c in (*counts, "paths")], F.count("*").alias("branches"), F.min("low").alias("low"), F.max("high").alias("high"))
        # What the first and the last of a node's paths have in common, all have: where a node has one branch, the way to
        # the next node that has more, or where a path ends, is gone in one step.
        same = F.zip_with("low", "high", lambda x, y: F.coalesce(x == y, F.lit(False)))
        common = F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same)).cast("int")
        pooled = pooled.withColumn("steps", F.when(F.col("branches") == 1, common).otherwise(1)).drop("low", "high")
        both = branch.drop("low", "high").join(pooled, ["host", "template"])
        far = reduce(lambda a, b: a + b, [F.abs(F.col(f"f_{k}") / F.col("n") - F.col(f"all_f_{k}") / F.col("all_n")) for k in FOLLOWERS]) / 2
        pure = lambda g, b, n, e: smoothed(g, g + b, weight, F.try_divide(e, n))
        # Purity is compared with the siblings' alone: few branches have labels, and one that has them all is not like itself.
        own_, others = [F.col(c) for c in ("good", "bad", "n", "weighed")], [F.col(f"all_{c}") - F.col(c) for c in ("good", "bad", "n", "weighed")]
        alike = (far <= apart + 1 / F.sqrt("n")) & (F.abs(pure(*own_) - pure(*others)) <= purity_apart)
        # What has no labels to speak of is compared by what other hosts say.
        foreign = F.abs(F.try_divide(own_[3], own_[2]) - F.try_divide(others[3], others[2])) > purity_apart
        untested = (F.col("branches") >= many) & (F.col("n") < rare * F.col("all_n")) & (F.col("n") < thin) & (F.col("good") + F.col("bad") < weight) & ~foreign
        wild = (F.col("branches") > 1) & ~F.col("own").contains("{") & (F.col("own") != "") & (untested | alike)
        step = both.select("host", "template", "own", "all_paths", "branches", "steps", F.when(wild, F.lit("*")).otherwise(F.col("own")).alias("name"))
        joined = open_.withColumn("own", own).join(step, ["host", "template", "own"], "left")
        ends, alone = F.col("own").isNull(), F.col("all_paths") == 1
        gone = F.when(F.col("branches") == 1, F.array_join(F.slice("seg", F.lit(1), F.col("steps")), "/")).otherwise(F.col("name"))
        grown = F.when(ends, F.col("template")).otherwise(F.concat("template", F.lit("/"), F.when(alone, F.array_join("seg", "/")).otherwise(gone)))
        left = F.when(ends | alone, F.col("seg")).otherwise(F.slice("seg", F.col("steps") + 1, F.greatest(F.lit(0), F.size("seg") - F.col("steps"))))
        table = stored(joined.select("host", "shaped", "n", "good", "bad", "expect", "weighed", left.alias("seg"), grown.alias("template"), (ends | alone).alias("closed")), f"level{level}")
        now = table.where("closed").select("host", "shaped", "template", "n", "good", "bad", "weighed")
        closed, open_, level = now if closed is None else closed.union(now), table.where("not closed").drop("closed"), level + 1
        if open_.isEmpty():
            return closed


def judged(pages: DataFrame, rules: list[tuple[str, str]], labels: Column | None = None, cut: float = 0.5, weight: float = 4.0, prior: float = 0.9, id_col: str = "page_id", url_col: str = "url", **growth) -> DataFrame:
    """id, host, path, rule, verdict, template, purity of every row.

    labels: a boolean column of pages, true for good; by default the verdicts of the rules label the pages they cover,
    and the templates carry them on to the pages that no rule covers.
    """
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), (labels if labels is not None else F.lit(None).cast("boolean")).alias("label"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("shaped", shaped(F.col("path")))
    if labels is None:
        rows = rows.withColumn("label", F.col("ruled") == "allow")
    paths = rows.groupBy("host", "shaped").agg(F.count("*").alias("n"), F.count_if("label").alias("good"), F.count_if(~F.col("label")).alias("bad"))
    tree = templates(stored(expected(stored(paths, "paths"), weight, prior), "expected"), weight=weight, **growth)
    totals = tree.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad", "weighed")])
    purity = totals.select("host", "template", smoothed(F.col("good"), F.col("good") + F.col("bad"), weight, F.col("weighed") / F.col("n")).alias("purity"))
    known = stored(tree.select("host", "shaped", "template").join(purity, ["host", "template"]), "templates")
    out = rows.join(known, ["host", "shaped"])
    method = F.when(F.col("purity") < cut, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "purity")
