"""URL filter: rules first, then trust and distrust spread over the graph of hosts.

Trusted seeds are the hosts with pages under an allow rule, blocked seeds those with pages under a block rule, each weighted by these
pages. Personalised PageRank carries trust along links and distrust against them (a host that links to blocked hosts is suspect). Edges
are the hyperlinks between hosts in the pages' html, and both ways between a host and its parent domain if that is a host too. Scores are
integers (parts of 10^12, each share rounded down), so the result does not depend on the order of sums. They start at what the seeds give
each round; from there no score ever falls, so rounds go on until the sum stays the same, when every score is at rest. A host is blocked if its
distrust is above its trust; this decides for the pages of the host that no rule fits.

Defined results: a null url, or one without `://`, has empty host and path, is outside the graph and allowed; repeated rows each get
their verdict and count each for the seeds; null html has no links; an empty table gives an empty result; other columns are ignored.
All steps are DataFrame operations. A host with many pages or links is summed before the exchange, and Spark splits its joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, settled, table

#: (verdict, host, path prefix)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
SCALE = 10**12
DAMPING = 85  # per cent
#: Rounds of the SQL; enough for the test pages, which link only within their hosts, but not for graphs with longer ways.
ROUNDS = 6
#: Rounds between two looks at the sum.
AT_ONCE = 6
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s<>]+)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))


def rule_columns(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, as its string and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in reversed(longest_rule(rules)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Distinct (src, dst) between different hosts: links of the html, and host to parent domain and back."""
    links = pages.select("host", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), ascii_lower))).alias("dst"))
    links = links.where((F.col("host") != "") & (F.col("host") != F.col("dst"))).select(F.col("host").alias("src"), "dst")
    up = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]*\.(.+)$", 1).alias("dst"))
    up = up.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi").select("src", "dst")
    return links.union(up).union(up.select("dst", "src")).distinct()


def spread(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, kind, score) at rest; seeds: (host, kind, seed), edges: (src, dst). Trust goes from src to dst, distrust back."""
    steps = edges.select(F.lit("t").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"))
    steps = steps.union(edges.select(F.lit("d").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to")))
    degrees = steps.groupBy("kind", "host").agg(F.count(F.lit(1)).alias("degree"))
    steps = settled(steps.join(degrees, ["kind", "host"]))
    base = seeds.select("kind", "host", F.expr(f"seed * {100 - DAMPING} DIV 100").alias("score"))
    score, before = base, None
    while True:
        for _ in range(AT_ONCE):
            given = steps.join(score, ["kind", "host"]).select("kind", F.col("to").alias("host"), F.expr(f"score * {DAMPING} DIV 100 DIV degree").alias("score"))
            score = base.union(given).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        score = settled(score)
        now = score.agg(F.sum("score").alias("s")).first()["s"] or 0
        if now == before:
            return score
        before = now


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of (page_id, url, html)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = cut.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    hosts = settled(ruled.where(F.col("host") != "").groupBy("host").agg(F.sum((F.col("ruled") == "allow").cast("long")).alias("t"), F.sum((F.col("ruled") == "block").cast("long")).alias("d")))
    total = hosts.agg(F.sum("t").alias("t"), F.sum("d").alias("d")).first()
    count = hosts.select("host", F.explode(F.create_map(F.lit("t"), F.col("t"), F.lit("d"), F.col("d"))).alias("kind", "n")).where("n > 0")
    share = F.when(F.col("kind") == "t", F.expr(f"CAST(CAST(n AS DECIMAL(20)) * {SCALE} DIV {total['t'] or 1} AS BIGINT)")).otherwise(F.expr(f"CAST(CAST(n AS DECIMAL(20)) * {SCALE} DIV {total['d'] or 1} AS BIGINT)"))
    seeds = settled(count.select("kind", "host", share.alias("seed")))
    score = spread(seeds, host_edges(cut.select("host", "html"), hosts.select("host")))
    blocked = score.groupBy("host").agg(F.sum(F.when(F.col("kind") == "d", F.col("score")).otherwise(-F.col("score"))).alias("excess")).where("excess > 0").select("host", F.lit(True).alias("bad"))
    out = ruled.join(blocked, "host", "left")
    verdict = F.coalesce("ruled", F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


def _sql() -> str:
    case = lambda i: " ".join(f"WHEN (host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}') THEN '{r[1] + r[2] if i else r[0]}'" for r in longest_rule(RULES))
    rounds = "".join(
        f""", r{n} AS MATERIALIZED (SELECT kind, host, sum(score) AS score FROM (
  SELECT kind, host, seed * {100 - DAMPING} // 100 AS score FROM seeds
  UNION ALL SELECT s.kind, s."to", r.score * {DAMPING} // 100 // s.degree FROM steps s JOIN r{n - 1} r ON r.kind = s.kind AND r.host = s.host) GROUP BY ALL)"""
        for n in range(1, ROUNDS + 1)
    )
    link = LINK.replace("'", "''")
    return f"""
WITH cut AS MATERIALIZED (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages
), ruled AS MATERIALIZED (SELECT page_id, host, path, CASE {case(1)} END AS rule, CASE {case(0)} END AS ruled FROM cut),
hosts AS MATERIALIZED (SELECT host, count(*) FILTER (ruled = 'allow') AS t, count(*) FILTER (ruled = 'block') AS d FROM ruled WHERE host <> '' GROUP BY host),
seeds AS MATERIALIZED (
  SELECT 't' AS kind, host, CAST(t AS HUGEINT) * {SCALE} // (SELECT greatest(sum(t), 1) FROM hosts) AS seed FROM hosts WHERE t > 0
  UNION ALL SELECT 'd', host, CAST(d AS HUGEINT) * {SCALE} // (SELECT greatest(sum(d), 1) FROM hosts) FROM hosts WHERE d > 0),
links AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM cut WHERE host <> ''),
up AS (SELECT host AS src, regexp_extract(host, '^[^.]*\\.(.+)$', 1) AS dst FROM hosts WHERE regexp_extract(host, '^[^.]*\\.(.+)$', 1) IN (SELECT host FROM hosts)),
edges AS MATERIALIZED (SELECT src, dst FROM links WHERE src <> dst UNION SELECT src, dst FROM up UNION SELECT dst, src FROM up),
ways AS (SELECT 't' AS kind, src AS host, dst AS "to" FROM edges UNION ALL SELECT 'd', dst, src FROM edges),
steps AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY kind, host) AS degree FROM ways),
r0 AS (SELECT kind, host, seed AS score FROM seeds){rounds},
blocked AS (SELECT host FROM r{ROUNDS} GROUP BY host HAVING sum(CASE WHEN kind = 'd' THEN score ELSE -score END) > 0)
SELECT page_id, host, path, rule, CASE WHEN ruled IS NOT NULL THEN ruled WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""


SQL = _sql()
