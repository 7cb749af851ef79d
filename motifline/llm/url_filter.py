"""URL filters: rules first, then trust and distrust propagated over the host graph.

Trust is a personalised PageRank from the hosts of allowed pages along host edges; distrust is one from the hosts of
blocked pages along reversed edges. Edges are the distinct host pairs of absolute links in the pages, and each host's
ties with the domain above it (both ways, down to two labels), since one owner holds both. A host whose distrust is
over ``ratio`` times its trust, and not below ``least``, is blocked; every other host is allowed, one that neither
reaches among them. Equal trust and distrust tie for allow.

Mass is counted in whole units of 1e-15, so scores do not depend on the order of additions: reruns agree exactly.
An edge table row is a distinct pair, counts are pre-aggregated, and ranks join edges by source, where AQE can split a
host with very many links. Ranks are written every few rounds, which cuts the lineage.

Null urls and urls without ``://`` have empty host and path, fit no rule and are allowed. Repeated rows each get a
verdict. A very long page is searched for links whole, in one row. An empty table gives no rows. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifline.llm.common import Scratch

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i:href|src)\s*=\s*["']?(?:[A-Za-z]+:)?//([^/?#"'\s<>]+)"""
UNITS = 1e15


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def match(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as text) and its verdict, or nulls; at equal length a block goes first. For up to 1,000 rules."""
    if len(rules) > 1000:
        raise ValueError("at most 1,000 rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "block")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Distinct (src, dst): links between different hosts, and each host with the domain above it."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    known = hosts.select("host").union(links.select("dst")).where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda k: F.array_join(F.slice(labels, k, F.size(labels) - k + 1), "."))
    ties = known.where(F.size(labels) > 2).select(F.explode(F.arrays_zip(F.slice(chain, 1, F.size(labels) - 2).alias("a"), F.slice(chain, 2, F.size(labels) - 2).alias("b"))).alias("e"))
    ties = ties.select(F.explode(F.array(F.struct(F.col("e.a").alias("src"), F.col("e.b").alias("dst")), F.struct(F.col("e.b").alias("src"), F.col("e.a").alias("dst")))).alias("e")).select("e.src", "e.dst")
    return links.union(ties).where("src <> dst AND src <> '' AND dst <> ''").distinct()


def propagate(scratch: Scratch, edges: DataFrame, seeds: DataFrame, rounds: int, keep: int, every: int) -> DataFrame:
    """Trust and distrust in units, (host, trust, distrust). seeds: (host, allowed, blocked) page counts; ``keep`` percent of mass flows on."""
    both = edges.select(F.lit(0).alias("kind"), "src", "dst").union(edges.select(F.lit(1), "dst", "src"))
    fan = both.groupBy("kind", "src").agg(F.count("*").alias("fan"))
    both = scratch.put(both.join(fan, ["kind", "src"]), "edges")
    total = seeds.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    start = seeds.select(F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("allowed").alias("n")), F.struct(F.lit(1).alias("kind"), F.col("blocked").alias("n")))).alias("e"), "host").select("e.kind", "host", "e.n").where("n > 0")
    share = F.when(F.col("kind") == 0, F.lit(float(total["a"] or 1))).otherwise(F.lit(float(total["b"] or 1)))
    start = scratch.put(start.select("kind", "host", F.floor(F.lit(UNITS) * (F.col("n") / share)).cast("long").alias("unit")), "seeds")
    ranks = start
    again = start.select("kind", "host", F.expr(f"unit * {100 - keep} div 100").alias("unit"))
    for k in range(1, rounds + 1):
        flow = both.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), F.expr(f"unit * {keep} div (100 * fan)").alias("unit"))
        ranks = flow.unionByName(again).groupBy("kind", "host").agg(F.sum("unit").alias("unit"))
        if k % every == 0 or k == rounds:
            ranks = scratch.put(ranks, f"ranks{k}")
    one = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("unit")).otherwise(0))
    return ranks.groupBy("host").agg(one(0).alias("trust"), one(1).alias("distrust"))


def judge(spark: SparkSession, pages: DataFrame, rules=RULES, rounds: int = 12, keep: int = 85, ratio: int = 1, least: int = 1000, every: int = 4) -> DataFrame:
    """pages (page_id, url, html) to page_id, host, path, rule, verdict, trust and distrust (units of 1e-15)."""
    scratch = Scratch(spark, "urls")
    host, path = host_and_path()
    out = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = match(F.col("host"), F.col("path"), rules)
    out = scratch.put(out.withColumn("rule", rule).withColumn("_by_rule", verdict), "pages")
    hosts = out.groupBy("host").agg(F.count(F.when(F.col("_by_rule") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("_by_rule") == "block", 1)).alias("blocked"))
    scores = propagate(scratch, host_edges(pages.select(host.alias("host"), "html"), hosts), hosts.where("host <> ''"), rounds, keep, every)
    out = out.join(scores, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0)), F.coalesce("distrust", F.lit(0))
    by_graph = F.when((distrust > trust * ratio) & (distrust >= least), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_by_rule", by_graph).alias("verdict"), trust.cast("long").alias("trust"), distrust.cast("long").alias("distrust"))


def sql(rounds: int = 12, keep: int = 85, ratio: int = 1, least: int = 1000) -> str:
    """The same for DuckDB, the rounds written out."""
    name, verdict = "NULL", "NULL"
    for h, p, v in sorted(RULES, key=lambda r: (len(r[0] + r[1]), r[2] == "block")):
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        name, verdict = f"CASE WHEN {fits} THEN '{h + p}' ELSE {name} END", f"CASE WHEN {fits} THEN '{v}' ELSE {verdict} END"
    link = LINK.replace("'", "''")
    parts = [
        rf"""cut AS MATERIALIZED (SELECT page_id, coalesce(html, '') AS html, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages)""",
        f"ruled AS MATERIALIZED (SELECT page_id, host, path, {name} AS rule, {verdict} AS by_rule FROM cut)",
        "hosts AS MATERIALIZED (SELECT host, count(*) FILTER (by_rule = 'allow') AS allowed, count(*) FILTER (by_rule = 'block') AS blocked FROM ruled GROUP BY host)",
        f"links AS MATERIALIZED (SELECT DISTINCT host AS src, translate(dst, '{UPPER}', '{LOWER}') AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS dst FROM cut))",
        "known AS (SELECT host FROM hosts WHERE host <> '' UNION SELECT dst FROM links WHERE dst <> '')",
        "labels AS (SELECT string_split(host, '.') AS l FROM known)",
        "ups AS (SELECT array_to_string(l[k:], '.') AS a, array_to_string(l[k + 1:], '.') AS b FROM (SELECT l, unnest(range(1, len(l) - 1)) AS k FROM labels WHERE len(l) > 2))",
        "pairs AS MATERIALIZED (SELECT src, dst FROM (SELECT src, dst FROM links UNION SELECT a, b FROM ups UNION SELECT b, a FROM ups) WHERE src <> dst AND src <> '' AND dst <> '')",
        "edges AS MATERIALIZED (SELECT kind, src, dst, count(*) OVER (PARTITION BY kind, src) AS fan FROM (SELECT 0 AS kind, src, dst FROM pairs UNION ALL SELECT 1, dst, src FROM pairs))",
        f"""seeds AS MATERIALIZED (SELECT kind, host, floor({UNITS:.0f}::DOUBLE * (n::DOUBLE / total::DOUBLE))::BIGINT AS unit FROM (
  SELECT 0 AS kind, host, allowed AS n, sum(allowed) OVER () AS total FROM hosts WHERE host <> '' UNION ALL SELECT 1, host, blocked, sum(blocked) OVER () FROM hosts WHERE host <> '') WHERE n > 0)""",
        f"r0 AS (SELECT * FROM seeds)",
    ]
    for k in range(1, rounds + 1):
        parts.append(f"""r{k} AS MATERIALIZED (SELECT kind, host, sum(unit)::BIGINT AS unit FROM (
  SELECT e.kind, e.dst AS host, (r.unit * {keep}) // (100 * e.fan) AS unit FROM edges e JOIN r{k - 1} r ON e.kind = r.kind AND e.src = r.host
  UNION ALL SELECT kind, host, (unit * {100 - keep}) // 100 FROM seeds) GROUP BY kind, host)""")
    parts.append(f"scores AS (SELECT host, coalesce(sum(unit) FILTER (kind = 0), 0)::BIGINT AS trust, coalesce(sum(unit) FILTER (kind = 1), 0)::BIGINT AS distrust FROM r{rounds} GROUP BY host)")
    return "WITH " + ",\n".join(parts) + f"""
SELECT page_id, ruled.host AS host, path, rule,
  coalesce(by_rule, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) * {ratio} AND coalesce(distrust, 0) >= {least} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM ruled LEFT JOIN scores ON ruled.host = scores.host"""
