"""URL verdicts: rules by host and path, and link-graph propagation where no rule fits. DataFrame operations only.

Hosts whose pages an allow rule fits are trusted seeds, hosts whose pages a block rule fits are blocked seeds. Trust is
personalised PageRank along links from the trusted seeds; distrust is personalised PageRank along reversed links from the
blocked seeds (who links to a blocked host is suspect). A host whose distrust exceeds its trust by more than MARGIN is
blocked, any other is allowed; so hosts that no propagation reaches are allowed. Both are carried on until no host is
reached anew and the mass still to be delivered is at most TOLERANCE of all.

Links are absolute (scheme://host) or scheme-relative (//host) href and src targets; a relative link stays on its host and
carries nothing. Repeated links count once for each page pair of hosts: an edge's weight is its number of links.

Defined cases: a null url or one without :// has an empty host and path, no rule, and the verdict allow; a null html has
no links; repeated pages count again; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DAMPING, ITERATIONS, MARGIN = 0.85, 8, 0.0  # ITERATIONS: of the SQL twin, which writes its rounds out
TOLERANCE = 1e-9
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>\\]+)"""


def _ascii_lower(value: Column) -> Column:
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str) -> tuple[Column, Column]:
    at = F.instr(F.col(url), "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(F.col(url), at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return _ascii_lower(host), path


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    rule = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(rule_verdict)).otherwise(verdict)
    return rule, verdict


def _rank(edges: DataFrame, seeds: DataFrame, scratch: Scratch, name: str, tolerance: float, damping: float) -> DataFrame:
    """Personalised PageRank (host, mass) along edges (src, dst, share); mass without out-links is dropped.

    A round delivers what the last one brought (fresh); all later rounds together bring damping / (1 - damping) of it at most.
    """
    edges = scratch.save(edges, f"{name}_edges")
    restart = seeds.select("host", (F.lit(1.0 - damping) * F.col("weight")).alias("mass"))
    ranks = scratch.save(restart.withColumn("fresh", F.col("mass")), f"{name}0")
    i, reached = 0, -1
    while True:
        state = ranks.agg(F.count("*").alias("hosts"), F.coalesce(F.sum("fresh"), F.lit(0.0)).alias("fresh")).first()
        if state.fresh * damping <= tolerance * (1.0 - damping) and (state.hosts == reached or not state.fresh):
            return ranks.select("host", "mass")
        reached, i = state.hosts, i + 1
        flow = edges.join(ranks.filter("fresh > 0"), edges.src == ranks.host).select(F.col("dst").alias("host"), (F.col("fresh") * F.col("share") * damping).alias("mass"))
        carried = ranks.select("host", "mass", F.lit(0.0).alias("fresh")).union(flow.select("host", "mass", F.col("mass").alias("fresh")))
        ranks = scratch.save(carried.groupBy("host").agg(F.sum("mass").alias("mass"), F.sum("fresh").alias("fresh")), f"{name}{i}")
        scratch.drop(f"{name}{i - 1}")


def judge_urls(pages: DataFrame, rules=RULES, tolerance: float = TOLERANCE, damping: float = DAMPING, margin: float = MARGIN) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust."""
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_and_path("url")
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("ruled", verdict)
    links = (
        pages.select(host.alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
        .select("src", _ascii_lower(F.col("dst")).alias("dst"))
        .filter("src != '' AND src != dst")
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("links"))
    )
    links = scratch.save(links, "links")
    hosts = judged.groupBy("host").agg(F.sum((F.col("ruled") == "allow").cast("double")).alias("allowed"), F.sum((F.col("ruled") == "block").cast("double")).alias("blocked"))
    hosts = scratch.save(hosts, "hosts")

    def propagate(src: str, dst: str, seeds: str, name: str) -> DataFrame:
        out = links.groupBy(F.col(src).alias("src")).agg(F.sum("links").alias("all"))
        edges = links.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "links").join(out, "src").select("src", "dst", (F.col("links") / F.col("all")).alias("share"))
        total = hosts.agg(F.sum(seeds)).first()[0] or 1.0
        seeded = hosts.filter(F.col(seeds) > 0).select("host", (F.col(seeds) / F.lit(float(total))).alias("weight"))
        return _rank(edges, seeded, scratch, name, tolerance, damping).withColumnRenamed("mass", name)

    trust = propagate("src", "dst", "allowed", "trust")
    distrust = propagate("dst", "src", "blocked", "distrust")
    scores = scratch.save(trust.join(distrust, "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")), "scores")
    # Only hosts that hold some page without a rule need their score.
    found = judged.join(scores, "host", "left")
    by_method = F.when(F.coalesce(F.col("distrust") - F.col("trust"), F.lit(0.0)) > margin, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    """The same in SQL, with the iterations written out."""
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ordered) + " END"
    ruled = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in ordered) + " END"
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = LINK.replace("'", "''")
    parts = [
        "rests AS (SELECT page_id, html, CASE WHEN coalesce(instr(url, '://'), 0) > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"parts AS (SELECT page_id, html, {lower("regexp_extract(rest, '(?s)^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM rests)",
        f"judged AS (SELECT page_id, host, path, {rule} AS rule, {ruled} AS ruled FROM parts)",
        f"links AS (SELECT src, dst, count(*)::double AS links FROM (SELECT host AS src, {lower('t')} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS t FROM parts)) WHERE src <> '' AND src <> dst GROUP BY src, dst)",
        "hosts AS (SELECT host, count(*) FILTER (ruled = 'allow')::double AS allowed, count(*) FILTER (ruled = 'block')::double AS blocked FROM judged GROUP BY host)",
    ]
    for name, src, dst, seeds in (("trust", "src", "dst", "allowed"), ("distrust", "dst", "src", "blocked")):
        parts.append(f"{name}_e AS (SELECT {src} AS s, {dst} AS d, links / sum(links) OVER (PARTITION BY {src}) AS share FROM links)")
        parts.append(f"{name}0 AS (SELECT host, {1 - DAMPING}::double * {seeds} / (SELECT sum({seeds}) FROM hosts) AS mass FROM hosts WHERE {seeds} > 0)")
        for i in range(1, ITERATIONS + 1):
            parts.append(f"{name}{i} AS MATERIALIZED (SELECT host, sum(mass) AS mass FROM (SELECT * FROM {name}0 UNION ALL SELECT d, mass * share * {DAMPING}::double FROM {name}_e JOIN {name}{i - 1} ON s = host) GROUP BY host)")
    t, d = f"trust{ITERATIONS}", f"distrust{ITERATIONS}"
    return f"WITH {', '.join(parts)} SELECT page_id, j.host AS host, path, rule, coalesce(ruled, CASE WHEN coalesce(d.mass, 0) - coalesce(t.mass, 0) > {MARGIN} THEN 'block' ELSE 'allow' END) AS verdict FROM judged j LEFT JOIN {t} t ON j.host = t.host LEFT JOIN {d} d ON j.host = d.host"


ORACLE = _oracle()
