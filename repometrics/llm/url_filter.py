"""Operator 8: URL rules, and host scores from the link graph where no rule fits.

Hosts are the nodes.  A page's links (``href``) make edges from its host, counted
per pair of hosts before anything else; a relative link stays on its host.  Trust starts
at hosts of pages that a rule allows, with the number of those pages, and
follows the links (personalised PageRank).  Distrust starts at hosts of pages that a
rule blocks and goes back along the links, to those that link there.  A
host is blocked if its distrust is above ``margin`` times its trust.
Mass that reaches a host without links ends there.  Propagation goes on until it has converged
and no further host is reached; the driver sees two numbers every few rounds.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, ``A-Z`` lowered; path:
from there up to ``?``, ``#`` or the end.  A missing url, or one without
``://``, has an empty host and path and is allowed.  Missing html has no
links; html of any length is read whole.  Repeated pages count each for itself.  An empty table has no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle

#: Rounds between two looks at what still moves.
EACH = 4


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return ascii_lower(F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(F.substr(url, F.instr(url, "://") + 3), "^[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits a host, or a parent of it, and the start of the path."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def link_edges(pages: DataFrame) -> DataFrame:
    """``source, target, n``: links between hosts, from ``host`` and ``html``."""
    links = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(r"""(?i)\shref\s*=\s*["']?([^"'\s>]+)"""), 1)

    def target(link: Column) -> Column:
        return (
            F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), host_of(link))
            .when(link.startswith("//"), host_of(F.concat(F.lit("http:"), link)))
            .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:|^#"), F.lit(""))
            .otherwise(F.col("host"))
        )

    rows = pages.select(F.col("host").alias("source"), F.explode(F.transform(links, target)).alias("target"))
    return rows.filter("source <> '' AND target <> ''").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """``kind, host, p``: personalised PageRank, carried on until what moves is at most ``tolerance`` of what the seeds gave.

    ``edges``: ``kind, source, target, n``; ``seeds``: ``kind, host, seed``.

    Only what has newly come to a host moves on.  What goes round on a host's links to itself is summed in closed form (a
    geometric series), so such hosts don't take rounds.  It also goes on while new hosts are reached, however far from
    a seed.  A round is one join and one grouping; ``EACH`` rounds are one job.
    """
    out = edges.groupBy("kind", "source").agg(F.sum("n").alias("total"))
    edges = settle(edges.join(out, ["kind", "source"]).select("kind", F.col("source").alias("host"), "target", (F.col("n") / F.col("total")).alias("w")))
    stays = edges.filter("host = target").select("kind", "host", (1 / (1 - damping * F.col("w"))).alias("gain"))
    gained = F.coalesce("gain", F.lit(1.0))
    moves = edges.filter("host <> target").join(stays.withColumnRenamed("host", "target"), ["kind", "target"], "left")
    moves = moves.select("kind", "host", "target", (damping * F.col("w") * gained).alias("f"), F.lit(0.0).alias("stay"))
    state = seeds.join(stays, ["kind", "host"], "left").select("kind", "host", ((1 - damping) * F.col("seed") * gained).alias("p"))
    # a host keeps its total: a move to itself
    hosts = moves.select("kind", "host").unionByName(moves.select("kind", F.col("target").alias("host"))).unionByName(state.select("kind", "host")).distinct()
    moves = settle(moves.unionByName(hosts.select("kind", "host", F.col("host").alias("target"), F.lit(0.0).alias("f"), F.lit(1.0).alias("stay"))))
    state = settle(state.withColumn("total", F.col("p")))
    size = F.struct(F.coalesce(F.sum("p"), F.lit(0.0)).alias("p"), F.count(F.lit(1)).alias("hosts"))
    last = state.agg(size).first()[0]
    given, reached = last.p, 0
    while last.p > tolerance * given or last.hosts > reached:
        reached = last.hosts
        for _ in range(EACH):
            step = state.join(moves, ["kind", "host"])
            state = step.groupBy("kind", F.col("target").alias("host")).agg(F.sum(F.expr("p * f")).alias("p"), F.sum(F.expr("total * stay + p * f")).alias("total"))
        state = settle(state)
        last = state.agg(size).first()[0]
    return state.select("kind", "host", F.col("total").alias("p"))


def judge_urls(pages: DataFrame, rules: dict[str, str], damping: float = 0.85, tolerance: float = 1e-9, margin: float = 1.0) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every page. ``rules``: rule to ``allow`` or ``block``."""
    url = pages["url"].cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), pages["html"].cast("string").alias("html"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    said = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        said = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(said)
    rows = rows.withColumn("_said", said)

    links = settle(link_edges(rows))
    edges = links.withColumn("kind", F.lit("trust")).unionByName(
        links.select(F.col("target").alias("source"), F.col("source").alias("target"), "n", F.lit("distrust").alias("kind")))
    seeds = rows.filter("_said IS NOT NULL AND host <> ''").groupBy(
        F.when(F.col("_said") == "allow", F.lit("trust")).otherwise(F.lit("distrust")).alias("kind"), "host").agg(F.count(F.lit(1)).alias("seed"))
    rank = propagate(edges, seeds, damping, tolerance)
    scores = settle(rank.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("p"))).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("p"))).alias("distrust"),
    ).fillna(0.0))
    rows = rows.drop("html").join(scores, "host", "left").fillna(0.0, ["trust", "distrust"])
    # sums of the same numbers in another order are ties
    above = F.col("distrust") - margin * F.col("trust") > 1e-9 * (F.col("distrust") + F.col("trust"))
    by_score = F.when(above, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("_said", by_score).alias("verdict"), "trust", "distrust")
