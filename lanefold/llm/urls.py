"""URL filter: rules first, then trust and distrust spread over links between hosts.

A rule is a host and a path; it fits that host and its subdomains where the url's path starts with
the rule's, and the longest fitting rule decides. Pages that no rule fits go by their host. A host
is a seed to the share of its pages that rules allow (trust) or block (distrust). Trust flows
along links, as personalised PageRank from the trusted seeds; distrust flows against them,
from the blocked seeds to hosts that link there. A host is blocked if its distrust exceeds its
trust and reaches ``BLOCK_AT``, what a host gets that has a third of its pages blocked and no links.

Edges come from ``href`` values in the pages that name a host; links within a host count for
nothing. They are summed by pair of hosts first, so that a host in any share of the pages is one
row per task and neighbour; what leaves or enters one hub is joined by a join that can be split.
Each round is written out. What flows into a host without links of its own ends there.

A null url, or one without ``://``, has an empty host and path; an empty host is outside the graph and
allowed, like any host that nothing is known of. A null html has no links. Repeated rows count
as so many pages. Other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanefold.llm.common import own_columns, stored

DAMPING = 0.85
ROUNDS = 20
TOLERANCE = 1e-9
BLOCK_AT = 0.05
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'>\s]+)"""


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, by_rule, html): each page with the rule that decides it."""
    host, path = parts(F.col("url"))
    rows = own_columns(pages, page_id="page_id", url="url", html="html").select(
        "page_id", host.alias("host"), path.alias("path"), "html"
    )
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):  # the longest ends up outermost
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), "html")


def seeds(pages: DataFrame) -> DataFrame:
    """(host, trust, distrust): the shares of a host's pages that rules allow and block."""
    share = lambda verdict: F.avg(F.when(F.col("by_rule") == verdict, 1.0).otherwise(0.0))
    return (
        pages.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    )


def links(pages: DataFrame) -> DataFrame:
    """(source, target, forth, back): edges between hosts, with the shares of what flows along and against."""
    named = F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    pairs = (
        pages.where("host <> '' AND html IS NOT NULL")
        .select(F.col("host").alias("source"), named.alias("target"))
        .withColumn("target", F.translate("target", UPPER, LOWER))
        .where("source <> target")
        .groupBy("source", "target")
        .count()
    )
    pairs = stored(pairs, "links")
    out = pairs.groupBy("source").agg(F.sum("count").alias("sent"))
    into = pairs.groupBy("target").agg(F.sum("count").alias("got"))
    return (
        pairs.join(out, "source")
        .join(into, "target")
        .select("source", "target", (F.col("count") / F.col("sent")).alias("forth"), (F.col("count") / F.col("got")).alias("back"))
    )


def propagated(seed: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) after both have spread over the edges."""
    edges = stored(edges, "edges")
    own = lambda c: (F.lit(1 - damping) * F.coalesce(c, F.lit(0.0))).alias(c)
    if edges.isEmpty():
        return seed.select("host", own("trust"), own("distrust"))
    hosts = seed.select("host").unionByName(edges.select(F.explode(F.array("source", "target")).alias("host"))).distinct()
    base = stored(hosts.join(seed, "host", "left").select("host", own("trust"), own("distrust")), "seeds")
    now = base
    for _ in range(rounds):
        along = edges.join(now, edges["source"] == now["host"]).select(
            F.col("target").alias("host"), (damping * F.col("trust") * F.col("forth")).alias("trust"), F.lit(0.0).alias("distrust")
        )
        against = edges.join(now, edges["target"] == now["host"]).select(
            F.col("source").alias("host"), F.lit(0.0).alias("trust"), (damping * F.col("distrust") * F.col("back")).alias("distrust")
        )
        new = stored(
            base.unionByName(along).unionByName(against).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")),
            "round",
        )
        change = (
            new.join(now.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d")), "host")
            .agg(F.max(F.abs(F.col("trust") - F.col("t")) + F.abs(F.col("distrust") - F.col("d"))))
            .first()[0]
        )
        now = new
        if change <= TOLERANCE:
            break
    return now


def host_blocked() -> Column:
    trust, distrust = F.round("trust", 12), F.round("distrust", 12)
    return (distrust > trust) & (distrust >= F.lit(BLOCK_AT))


def filtered(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every page."""
    rows = judged(pages, rules)
    spread = propagated(seeds(rows), links(rows)).select(F.col("host").alias("_host"), "trust", "distrust")
    method = F.when(host_blocked(), "block").otherwise("allow")
    return rows.join(spread, F.col("host") == F.col("_host"), "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", method).alias("verdict"),
        F.round(F.coalesce("trust", F.lit(0.0)), 9).alias("trust"),
        F.round(F.coalesce("distrust", F.lit(0.0)), 9).alias("distrust"),
    )


def _case(value) -> str:
    fits = "WHEN (host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}') THEN '{2}'"
    longest = sorted(RULES, key=lambda r: -len(r.text))
    return "CASE " + " ".join(fits.format(r.host, r.path, value(r)) for r in longest) + " END"


_ROUNDS_SQL = ",\n".join(
    f"""s{k} AS MATERIALIZED (SELECT host, sum(t) AS t, sum(d) AS d FROM (SELECT host, t, d FROM s0
        UNION ALL SELECT target, {DAMPING} * t * forth, 0 FROM e JOIN s{k - 1} ON host = source
        UNION ALL SELECT source, 0, {DAMPING} * d * back FROM e JOIN s{k - 1} ON host = target) GROUP BY host)"""
    for k in range(1, ROUNDS + 1)
)

FILTERED_SQL = rf"""
WITH u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
p AS (SELECT *, {_case(lambda r: r.text)} AS rule, {_case(lambda r: r.verdict)} AS by_rule FROM h),
a AS (SELECT host AS source, translate(unnest(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1)), '{UPPER}', '{LOWER}') AS target
      FROM p WHERE host <> '' AND html IS NOT NULL),
c AS (SELECT source, target, count(*) AS n FROM a WHERE source <> target GROUP BY ALL),
e AS (SELECT source, target, n / sum(n) OVER (PARTITION BY source) AS forth, n / sum(n) OVER (PARTITION BY target) AS back FROM c),
seed AS (SELECT host, avg(CASE WHEN by_rule = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS t,
                avg(CASE WHEN by_rule = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS d FROM p WHERE host <> '' GROUP BY host),
s0 AS MATERIALIZED (SELECT host, {1 - DAMPING} * coalesce(t, 0) AS t, {1 - DAMPING} * coalesce(d, 0) AS d
      FROM (SELECT host FROM seed UNION SELECT source FROM e UNION SELECT target FROM e) LEFT JOIN seed USING (host)),
{_ROUNDS_SQL}
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN round(d, 12) > round(t, 12) AND round(d, 12) >= {BLOCK_AT} THEN 'block' ELSE 'allow' END) AS verdict,
       round(coalesce(t, 0), 9) AS trust, round(coalesce(d, 0), 9) AS distrust
FROM p LEFT JOIN s{ROUNDS} USING (host)"""
