"""URL filters by a path-template tree.  DataFrame functions only.

Rules come first: a rule (host, path) fits its host and all subdomains where the url's path starts with the rule's;
the longest one wins.  Rules are a literal list of at most MAX_RULES entries.

All other urls are judged by their host's tree of path templates; the urls that a rule decides are the labelled examples.

1. A template is the path's segments with variable ones generalised to wildcards: numbers, identifiers with digits, and
   the segments of a depth at which the host's values hardly repeat: the share of different values among them is at
   least ``variable``, by the lower end of its Wilson interval at three standard errors.
2. A branch (a template's prefix with all below it) is merged with its siblings if its labelled rate does not differ
   from their pooled rate by more than ``z`` standard errors; a branch without labels can't be told apart and is merged too.
   A branch's rate doesn't depend on merges below it, so all levels are decided at once; merged branches then share
   their children of the same name, down to the leaves.
3. From the root down, a node's purity is (blocked + alpha * its parent's purity) / (labelled + alpha); the root's parent is the
   labelled rate of all urls.  A template is judged by its deepest node with labels, which rejects it if its purity
   reaches ``purity`` and ``coverage`` of its urls are labelled.  A host without labels has no evidence: its urls are allowed.

Every step is an aggregation with partial sums on the map side, or an equi-join of pages or templates with template statistics
whose large partitions adaptive execution splits, so a host with a third of all pages is no hot task.  Nodes are named by
64-bit hashes of their segments.

Defined results: null urls and urls without ``://`` have empty host and path, no rule, and verdict allow (a host-less
template is never labelled); very long paths cost time in proportion to the square of their segments; repeated rows each give a
row; a null page_id is carried along; extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import load, written

MAX_RULES, SALTS = 1000, 64
#: The contract's rules: fixed values.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 2), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))


def by_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, action in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(action)).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """The path's segments; numbers and identifiers become wildcards, each keeping its file extension."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")

    def general(s: Column) -> Column:
        ext = F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1)
        stem = F.regexp_replace(s, r"\.[A-Za-z]{1,5}$", "")
        kind = F.when(stem.rlike(r"^[0-9]+$"), "<n>").when(stem.rlike(r"[0-9]") & (F.char_length(stem) >= 6), "<id>").otherwise(stem)
        return F.concat(kind, ext)

    return F.transform(parts, general)


def _depths(first: int, segs: str) -> Column:
    """first, ..., number of segments; empty if that is less."""
    return F.when(F.size(segs) >= first, F.sequence(F.lit(first), F.size(segs))).otherwise(F.array().cast("array<int>"))


def _node(segs: str, depth: Column) -> Column:
    return F.xxhash64(F.slice(segs, 1, depth))


def filter_urls(
    pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, variable: float = 0.5, z: float = 1.96, coverage: float = 0.5, alpha: float = 4.0, purity: float = 0.8
) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = by_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"), segments(F.col("path")).alias("segs"))

    # depths at which a host's segments are variable
    values = rows.select("host", F.posexplode("segs").alias("depth", "seg")).groupBy("host", "depth", "seg").agg(F.count("*").alias("n"))
    share, n = F.col("kinds") / F.col("n"), F.col("n")
    lower = (share + 4.5 / n - 3 * F.sqrt(share * (1 - share) / n + 2.25 / (n * n))) / (1 + 9 / n)
    spread = values.groupBy("host", "depth").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).where(lower >= variable)
    spread = spread.groupBy("host").agg(F.collect_set("depth").alias("depths"))
    free = F.coalesce(F.col("depths"), F.array().cast("array<int>"))
    salted = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a host's pages go to many tasks
    shaped = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    shaped = shaped.withColumn("segs", F.transform("segs", lambda s, i: F.when(F.array_contains(free, i), F.lit("<*>")).otherwise(s)))
    shaped = shaped.select("page_id", "host", "path", "rule", "ruled", "segs", F.xxhash64("segs").alias("template"))

    counts = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    templates = written(
        shaped.groupBy("host", "template").agg(
            F.first("segs").alias("segs"), F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked")
        ),
        "url-templates",
    )
    whole = templates.agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).first()
    prior = (whole["blocked"] or 0) / max(1, whole["labelled"] or 0)

    # branches, their siblings' pooled rate, and the merge
    each = templates.withColumn("depth", F.explode(_depths(1, "segs")))
    each = each.withColumns({"node": _node("segs", F.col("depth")), "parent": _node("segs", F.col("depth") - 1)})
    branches = each.groupBy("host", "depth", "parent", "node").agg(*counts)
    pooled = branches.groupBy("host", "depth", "parent").agg(F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
    rate = F.try_divide(F.col("all_blocked"), F.col("all_labelled"))
    error = F.sqrt(F.try_divide(rate * (1 - rate), F.col("labelled")))
    differs = F.abs(F.try_divide(F.col("blocked"), F.col("labelled")) - rate) > z * error + 1e-9
    alike = branches.join(pooled, ["host", "depth", "parent"]).select("host", "depth", "parent", "node", F.coalesce(~differs, F.lit(True)).alias("alike"))
    flags = each.select("host", "template", "depth", "parent", "node").join(alike, ["host", "depth", "parent", "node"])
    flags = flags.groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("depth", "alike"))).alias("flags"))
    way = F.transform("segs", lambda s, i: F.when(F.get(F.col("flags"), i)["alike"], F.lit("<+>")).otherwise(s))
    merged = written(templates.join(flags, ["host", "template"], "left").withColumn("way", way).drop("segs", "flags"), "url-merged")

    # each template's nodes from the root down
    steps = merged.withColumn("depth", F.explode(_depths(0, "way"))).withColumn("node", _node("way", F.col("depth")))
    nodes = steps.groupBy("host", "depth", "node").agg(*counts)
    chain = steps.select("host", "template", "depth", "node").join(nodes, ["host", "depth", "node"])
    chain = chain.groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("depth", "n", "labelled", "blocked"))).alias("chain"))

    def down(state: Column, x: Column) -> Column:
        p = (x["blocked"] + alpha * state["p"]) / (x["labelled"] + alpha)
        bad = F.when(x["labelled"] > 0, (p >= purity) & (x["labelled"] >= coverage * x["n"])).otherwise(state["bad"])
        return F.struct(p.alias("p"), bad.alias("bad"))

    judged = F.aggregate("chain", F.struct(F.lit(float(prior)).alias("p"), F.lit(False).alias("bad")), down)
    bad = written(chain.select("host", "template", judged["bad"].alias("bad")).where("bad"), "url-rejected")
    return shaped.join(bad, ["host", "template"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict")
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(load(spark, sf_dir, "pages"))
