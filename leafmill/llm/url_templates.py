"""URL filtering by rules and by a path-template tree.

A rule (verdict, host, path) fits its host, all subdomains, and paths that begin with its path; the longest rule
that fits decides.  Urls without a rule are judged by their host's tree of path templates.  Numbers, hex codes and
slugs in a segment become wildcards at once.  From the root down, a node with more than ``CHILDREN`` children turns
those with less than a ``CHILDREN``-th of its urls into one wildcard, and branches whose share of bad labels does not
differ statistically from the node's are merged.  A template is rejected if enough labelled urls fall on it and their
purity, the share of bad ones smoothed towards the host's (itself smoothed towards the whole corpus), is high.

The labels are the rules' own verdicts, or any boolean column ``bad`` (null: unlabelled) of the caller.  The tree is
made of counts per host and shape, never of rows.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed unless its
template is rejected; an empty path is a template of its own; segments below ``DEPTH`` are one wildcard; rules of equal
length are taken in the order given; repeated rows are judged each; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import checkpointed

CHILDREN, DEPTH = 20, 4
MIN_LABELLED, SMOOTHING, PURITY, Z = 10, 5.0, 0.9, 2.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WILD, MERGED, BELOW = "*", "{similar}", "**"
#: Shapes of variable segments, tried in order; digits inside other segments become {n} as well.
SHAPES = (("^[0-9]+$", "{n}"), ("^(?=.*[0-9])[0-9a-fA-F]{8,}$", "{hex}"), ("^[^-]+(-[^-]+){3,}$", "{slug}"), ("^.{49,}$", "{long}"))


def host(url: str = "url") -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(rules: list[tuple[str, str, str]], host_col: str = "host", path_col: str = "path") -> tuple[Column, Column]:
    """(rule as ``host`` + ``path``, its verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, own_host, own_path in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = ((F.col(host_col) == own_host) | F.col(host_col).endswith("." + own_host)) & F.col(path_col).startswith(own_path)
        name, verdict = F.when(fits, own_host + own_path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def shape(path_col: str = "path") -> Column:
    """The path's segments with their variable parts as wildcards, at most ``DEPTH`` and one more for the rest."""

    def one(segment: Column) -> Column:
        out = F.regexp_replace(segment, "[0-9]+", "{n}")
        for pattern, name in reversed(SHAPES):
            out = F.when(segment.rlike(pattern), name).otherwise(out)
        return out

    segments = F.transform(F.split(path_col, "/"), one)
    return F.when(F.size(segments) > DEPTH + 1, F.concat(F.slice(segments, 1, DEPTH + 1), F.array(F.lit(BELOW)))).otherwise(segments)


def _replaced(template: str, depth: int, name: Column) -> Column:
    return F.transform(template, lambda s, i: F.when(i == depth, name).otherwise(s))


def tree(urls: DataFrame) -> DataFrame:
    """(host, shape, bad or null) to one row per host and shape: template, labelled, n_bad, purity, rejected."""
    sums = [F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("n_bad").alias("n_bad")]
    rows = checkpointed(urls.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.count_if("bad").alias("n_bad")).withColumn("template", F.col("shape")))
    deepest = rows.agg(F.max(F.size("shape"))).first()[0] or 0  # at most DEPTH + 2
    for depth in range(1, deepest):
        at = rows.where(F.size("template") > depth).select(
            "host", F.slice("template", 1, depth).alias("above"), F.get("template", F.lit(depth)).alias("child"), "n", "labelled", "n_bad")
        children = at.groupBy("host", "above", "child").agg(*sums)
        nodes = children.groupBy("host", "above").agg(
            F.count("*").alias("k"), F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("n_bad").alias("all_bad"))
        rate, share = F.col("n_bad") / F.col("labelled"), F.col("all_bad") / F.col("all_labelled")
        error = F.sqrt(share * (1 - share) / F.col("labelled"))
        variable = (F.col("k") > CHILDREN) & (F.col("n") * CHILDREN < F.col("all_n"))
        alike = (F.col("k") > 1) & (F.col("labelled") >= MIN_LABELLED) & (F.abs(rate - share) <= Z * error)
        name = F.when(variable, WILD).when(alike, MERGED)
        named = children.join(nodes, ["host", "above"]).select(
            F.col("host").alias("h"), "above", "child", name.alias("name")).where("name is not null")
        key = (F.col("host") == F.col("h")) & (F.slice("template", 1, depth) == F.col("above")) & (F.get("template", F.lit(depth)) == F.col("child"))
        rows = checkpointed(rows.join(named, key, "left").select("host", "shape", "n", "labelled", "n_bad", _replaced(
            "template", depth, F.coalesce("name", F.get("template", F.lit(depth)))).alias("template")))
    hosts = rows.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("n_bad").alias("host_bad"))
    whole = rows.agg(F.sum("n_bad") / F.sum("labelled")).first()[0] or 0.0
    prior = (F.col("host_bad") + SMOOTHING * whole) / (F.col("host_labelled") + SMOOTHING)
    leaves = rows.groupBy("host", "template").agg(*sums).join(hosts, "host").withColumn(
        "purity", (F.col("n_bad") + SMOOTHING * prior) / (F.col("labelled") + SMOOTHING))
    rejected = (F.col("labelled") >= MIN_LABELLED) & (F.col("purity") >= PURITY)
    return rows.select("host", "shape", "template").join(
        leaves.select("host", "template", "labelled", "n_bad", "purity", rejected.alias("rejected")), ["host", "template"])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host().alias("host"), path().alias("path"))
    name, verdict = best_rule(rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("own")).withColumn("shape", shape())
    bad = tree(rows.select("host", "shape", (F.col("own") == "block").alias("bad"))).where("rejected").select("host", "shape", "rejected")
    method = F.when(F.col("rejected"), "block").otherwise("allow")
    return rows.join(bad, ["host", "shape"], "left").select("page_id", "host", "path", "rule", F.coalesce("own", method).alias("verdict"))
