"""URL filters: rules by host and path, and trust and distrust carried over the links between hosts.

The rules decide every URL that one of them fits. For the others the hosts speak: hosts most of whose pages the rules
allow are trusted seeds, hosts most of whose pages they block are blocked ones. Trust walks along the links, as whoever
is linked by trusted hosts is likely sound; distrust walks against them, as whoever links to blocked hosts is likely
not. Both are personalised PageRanks, as sums of walks from the seeds: at each step a host hands DAMPING of what came to
it on, in equal parts. Masses are whole numbers, so sums do not depend on their order, and the walks end by themselves
when nothing is left to hand on. A host is blocked when its distrust outweighs its trust. DataFrame functions only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import ascii_lower, fresh, small, table
from loomgraph.session import Scratch

#: What a seed starts with; parts below one are not handed on.
UNIT = 1_000_000
#: Hundredths of its mass that a host hands on.
DAMPING = 85
#: A link target: any href with a scheme or starting with two slashes.
HREF = r"""(?i)(?:^|[^A-Za-z0-9_-])href[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?[\x20\x09-\x0D]*([^"'>\x20\x09-\x0D]+)"""
TARGET = r"^(?i)(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)"


class Rule(NamedTuple):
    """A verdict on the URLs of a host and its subdomains whose path starts so."""

    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lowered, and path of a URL; both empty where it is null or has no `://`."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, written as host and path, and its verdict; nulls if none does. Of equally long ones the longer host wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), len(r.host), r)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.host + r.path)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def links(pages: DataFrame) -> DataFrame:
    """source, target: the distinct links from a host to another one."""
    target = F.transform(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), lambda h: ascii_lower(F.regexp_extract(h, TARGET, 1)))
    found = pages.select(parts(F.col("url"))[0].alias("source"), F.array_distinct(target).alias("targets"))
    found = found.select("source", F.explode("targets").alias("target"))
    return found.where((F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target"))).groupBy("source", "target").agg(F.lit(1).alias("once")).drop("once")


def seeds(judged: DataFrame) -> DataFrame:
    """kind, host, mass: the trusted and the blocked hosts among (host, verdict of the rules) of every page."""
    count = lambda v: F.count(F.when(F.col("verdict") == v, True))
    hosts = judged.where(F.col("host") != "").groupBy("host").agg(F.count("*").alias("n"), count("allow").alias("allowed"), count("block").alias("blocked"))
    kind = F.when(2 * F.col("allowed") > F.col("n"), F.lit("trust")).when(2 * F.col("blocked") > F.col("n"), F.lit("distrust"))
    return hosts.select(kind.alias("kind"), "host", F.lit(UNIT).cast("long").alias("mass")).where(F.col("kind").isNotNull())


def ways(edges: DataFrame) -> DataFrame:
    """kind, host, to, degree: trust goes along the edges and distrust against them, in equal parts."""
    out = edges.groupBy("source").agg(F.count("*").alias("degree"))
    into = edges.groupBy("target").agg(F.count("*").alias("degree"))
    along = edges.join(out, "source").select(F.lit("trust").alias("kind"), F.col("source").alias("host"), F.col("target").alias("to"), "degree")
    against = edges.join(into, "target").select(F.lit("distrust").alias("kind"), F.col("target").alias("host"), F.col("source").alias("to"), "degree")
    return along.unionByName(against)


def masses(start: DataFrame, edges: DataFrame, damping: int = DAMPING) -> DataFrame:
    """host, trust and distrust: all that came to a host on walks of any length from the seeds, its own start included.

    Each round hands on what came in the last; it takes the hosts reached and their edges, and adds up before it
    shuffles. Whole numbers shrink by damping at every step, so there is an end: about 85 rounds at the very most for
    a single seed, and some 14 more for each tenfold of seeds that meet in one host.
    """
    keep = Scratch(start, "trust")
    at = keep(start)
    rounds = [at]
    ahead = keep(ways(edges))
    while not ahead.isEmpty() and not at.isEmpty():
        part = F.expr(f"mass * {damping} div (100 * degree)")
        at = keep(ahead.join(at, ["kind", "host"]).select("kind", F.col("to").alias("host"), part.alias("mass")).where("mass > 0").groupBy("kind", "host").agg(F.sum("mass").alias("mass")))
        rounds.append(at)
    whole = rounds[0]
    for r in rounds[1:]:
        whole = whole.unionByName(r)
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("mass")).otherwise(0)).alias(k)
    return whole.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: int = DAMPING) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages.

    A URL that is null or has no `://` has empty host and path, meets no rule and is allowed; so is any page of a host
    that no rule fits and that has no distrust. A null html has no links, links within a host carry nothing, links to
    hosts without pages carry on to nobody. Ties of trust and distrust allow. Repeated rows are judged each; they count
    as pages of their host, but a link between two hosts counts once, from however many pages. Other columns play no
    part, whatever their names; an empty table gives no rows.
    """
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    judged = split.withColumns({"rule": rule, "verdict": verdict})
    keep = Scratch(pages, "links")
    known = masses(seeds(judged), keep(links(pages)), damping)
    bad = small(keep(known.where(F.col("distrust") > F.col("trust")).select(F.col("host").alias(fresh(judged, "bad_host")))))
    own = F.when(F.col(bad.columns[0]).isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.join(bad, judged["host"] == bad[bad.columns[0]], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


OP13_SQL = r"""
WITH RECURSIVE u AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
j AS (SELECT p.page_id, p.html, p.host, p.path, (SELECT arg_max({'rule': r.host || r.path, 'verdict': r.verdict}, len(r.host || r.path)) FROM rules r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS fit FROM p),
hrefs AS (SELECT host AS source, unnest(regexp_extract_all(html, '(?i)(?:^|[^A-Za-z0-9_-])href[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["'']?[\x20\x09-\x0D]*([^"''>\x20\x09-\x0D]+)', 1)) AS href FROM p),
targets AS (SELECT source, translate(regexp_extract(href, '^(?i)(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS target FROM hrefs),
edges AS (SELECT DISTINCT source, target FROM targets WHERE source <> '' AND target <> '' AND source <> target),
ways AS (SELECT 'trust' AS kind, source AS host, target AS goal, count(*) OVER (PARTITION BY source) AS degree FROM edges
  UNION ALL SELECT 'distrust', target, source, count(*) OVER (PARTITION BY target) FROM edges),
seeds AS (SELECT CASE WHEN 2 * count(*) FILTER (fit.verdict = 'allow') > count(*) THEN 'trust' WHEN 2 * count(*) FILTER (fit.verdict = 'block') > count(*) THEN 'distrust' END AS kind, host FROM j WHERE host <> '' GROUP BY host),
walk(step, kind, host, mass) AS (
  SELECT 0, kind, host, 1000000::BIGINT FROM seeds WHERE kind IS NOT NULL
  UNION ALL
  SELECT step + 1, kind, goal, sum(part)::BIGINT FROM (SELECT step, kind, goal, mass * 85 // (100 * degree) AS part FROM walk JOIN ways USING (kind, host)) WHERE part > 0 GROUP BY step, kind, goal),
bad AS (SELECT host FROM walk GROUP BY host HAVING coalesce(sum(mass) FILTER (kind = 'distrust'), 0) > coalesce(sum(mass) FILTER (kind = 'trust'), 0))
SELECT page_id, j.host, path, fit.rule AS rule, coalesce(fit.verdict, CASE WHEN bad.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM j LEFT JOIN bad ON bad.host = j.host
"""
