"""URL filters: rules, and for what no rule judges the trust of the host. DataFrame functions only, no Python on executors.

Trust starts at hosts whose pages rules allow and follows links; distrust starts at hosts whose pages rules block and
follows links backwards, to those who link there. Both are personalised PageRanks over host edges, in units of one seed.
A host that more distrust than trust reaches is blocked.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipworks.llm.frames import hot_keys, replicated, salted
from clipworks.session import checkpoint_dir
from clipworks.sources.tables import materialize

#: Share of a host's score that its links pass on, rounds, smallest score passed on, and trust needed for each unit of distrust.
DAMPING, ROUNDS, LEAST, RATIO = 0.85, 40, 1e-6, 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host of an absolute or scheme-relative address in a link attribute.
LINK_HOST = r"""(?i)\b(?:href|src|action|cite)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^\s"'<>/?#\\]+)"""


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z in lower case; empty for null and without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null and without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest of ``rules`` (host, path, verdict) that fits; null without one.

    A rule fits its host and all subdomains if the path starts with the rule's. Of equally long ones the longer host
    holds, then block, then the first in order of text.
    """
    order = sorted(set(rules), key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block", r))
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in order]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def join_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with ``ruled``, as ``fitting_rule`` gives it, for a table of rules of any size.

    Distinct (host, path) meet the rules by equal (domain, folder): a rule's folder is its path up to the last slash, and
    an address lists its domains and folders as deep as rules go.
    """
    folder = lambda c: F.regexp_extract(c, r"(?s)^(.*/)?", 0)
    known = rules.select(F.col("host").alias("domain"), folder("path").alias("folder"), F.concat("host", "path").alias("rule"), F.col("path").alias("start"), "verdict").dropna().distinct()
    deep = known.agg(F.max(F.size(F.split("domain", r"\."))).alias("labels"), F.max(F.size(F.split("folder", "/"))).alias("parts")).first()
    if not deep["labels"]:
        return urls.withColumn("ruled", F.lit(None).cast("struct<rule:string,verdict:string>"))
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    domains = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deep["labels"]))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    folders = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(deep["parts"]))), lambda k: F.array_join(F.concat(F.slice(parts, F.lit(1), k - 1), F.array(F.lit(""))), "/"))
    listed = urls.select("host", "path").distinct().select("host", "path", F.explode(domains).alias("domain"), folders.alias("folders")).select("host", "path", "domain", F.explode("folders").alias("folder"))
    met = listed.join(known, ["domain", "folder"]).where(F.startswith("path", "start"))
    rank = F.struct((-F.length("rule")).alias("a"), (-F.length("domain")).alias("b"), (F.col("verdict") != "block").alias("c"), "domain", "start", "rule", "verdict")
    best = met.groupBy("host", "path").agg(F.min(rank).alias("best")).select("host", "path", F.struct("best.rule", "best.verdict").alias("ruled"))
    return urls.join(best, ["host", "path"], "left")


def host_edges(pages: DataFrame, host: Column, html_col: str = "html") -> DataFrame:
    """(src, dst, n): pages of host ``src`` that link to the other host ``dst``. Relative links stay on their host."""
    linked = F.array_distinct(F.transform(F.regexp_extract_all(F.col(html_col), F.lit(LINK_HOST), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER)))
    pairs = pages.select(host.alias("src"), F.explode(linked).alias("dst"))
    return pairs.where("src <> dst AND src <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _shares(edges: DataFrame, kind: str, node: str, to: str) -> tuple[DataFrame, DataFrame]:
    """(kind, node, to, share): the part of a node's score that goes along each edge; and (kind, node, edges)."""
    sums = materialize(edges.groupBy(F.col(node).alias("node")).agg(F.sum("n").alias("all"), F.count("*").alias("edges")))
    hot = hot_keys(sums, ["node"], "edges")
    rows = salted(edges.select(F.col(node).alias("node"), F.col(to).alias("to"), "n"), hot, ["node"]).join(replicated(sums, hot, ["node"]), ["node", "_salt"])
    return rows.select(F.lit(kind).alias("kind"), "node", "to", (F.col("n") / F.col("all")).alias("share")), sums.select(F.lit(kind).alias("kind"), "node", "edges")


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, least: float = LEAST) -> DataFrame:
    """(node, trust, distrust): personalised PageRanks over ``edges`` (src, dst, n) from ``seeds`` (node, trust, distrust).

    A score passes on along links by their n, distrust against them. Scores of hosts without links go nowhere, which
    only rescales a rank. The edges are laid out by node once and stay where they are in every round; edges of a hub
    are dealt over several places. Scores under ``least`` go no further.
    """
    spark = edges.sparkSession
    forward, out = _shares(edges, "trust", "src", "dst")
    backward, into = _shares(edges, "distrust", "dst", "src")
    hot = materialize(hot_keys(out.unionByName(into), ["kind", "node"], "edges"))
    keys = ["kind", "node", "_salt"]
    name, places = f"edges_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = salted(forward.unionByName(backward), hot, ["kind", "node"]).repartition(places, *keys)
    laid.write.bucketBy(places, *keys).sortBy(*keys).option("path", f"{checkpoint_dir(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), "node", F.col(k).alias("x")) for k in ("trust", "distrust")])).alias("s")
    steps = [materialize(seeds.select(both).select("s.*").where("x > 0").withColumn("x", F.col("x") * (1 - damping)))]
    for _ in range(rounds):
        moving = replicated(steps[-1].where(F.col("x") >= least), hot, ["kind", "node"])
        passed = moving.join(table, keys).groupBy("kind", F.col("to").alias("node")).agg((F.sum(F.col("x") * F.col("share")) * damping).alias("x"))
        step = materialize(passed)
        if step.isEmpty():
            break
        steps.append(step)
    spark.sql(f"DROP TABLE {name}")
    total = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("x")).otherwise(0.0)).alias(kind)
    return reduce(DataFrame.unionByName, steps).groupBy("node").agg(total("trust"), total("distrust"))


def judge(pages: DataFrame, rules, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", damping: float = DAMPING, rounds: int = ROUNDS, ratio: float = RATIO) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust), one row per row of ``pages``.

    ``rules``: a list of (host, path, verdict) or a table of them. The longest fitting rule gives rule and verdict; without
    one the rule is null and the host is blocked if ``distrust > ratio * trust``, else allowed (also hosts that nothing
    reaches, and the empty host). A host is a seed by the shares of its judged pages that rules allow and block.
    Null urls have empty host and path, null pages no links; rows that repeat count each; other columns aren't read.
    """
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if isinstance(rules, DataFrame):
        urls = materialize(join_rules(urls, rules))
    else:
        urls = urls.withColumn("ruled", fitting_rule(F.col("host"), F.col("path"), rules))
    share = lambda v: F.coalesce(F.avg(F.when(F.col("ruled").isNotNull(), (F.col("ruled.verdict") == v).cast("double"))), F.lit(0.0))
    hosts = materialize(urls.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), share("allow").alias("trust"), share("block").alias("distrust")))
    edges = materialize(host_edges(pages, host_of(F.col(url_col)), html_col))
    scores = materialize(propagate(edges, hosts.select(F.col("host").alias("node"), "trust", "distrust"), damping, rounds))
    hot = hot_keys(hosts, ["host"], "n")
    out = salted(urls, hot, ["host"]).join(replicated(scores.withColumnRenamed("node", "host"), hot, ["host"]), ["host", "_salt"], "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when(distrust > ratio * trust, "block").otherwise("allow")
    return out.select("id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
