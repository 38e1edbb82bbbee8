"""URL filters: rules, and for other hosts trust and distrust propagated over the link graph.

Trust is a personalised PageRank over host edges that restarts at hosts whose pages rules allow;
distrust is one over the reversed edges (who links to blocked hosts is suspect) that restarts at
hosts whose pages rules block. Edges come from the absolute links in the pages' html and are
counted per pair of hosts before anything is joined, so a popular host is one row per neighbour.
All of it is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.workspace import Workspace

#: (verdict, host and path); a rule fits its host and all subdomains if the path starts with its path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING, SETTLED = 0.85, 1e-9


def steps_to_settle(damping: float = DAMPING) -> int:
    """Steps after which ranks have settled on any graph: each shrinks what a kind still moves by
    the damping, from at most 2 for each of two kinds."""
    return math.ceil(math.log(SETTLED / 4) / math.log(damping)) + 1


#: A host is allowed if its trust is at least this share of its distrust; ranks that are closer than
#: what may still move when they count as settled are a tie, which allows.
SHARE, TIE = 1.0, 1e-8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?i)\bhref\s*=\s*[\"']?((?:[a-z][a-z0-9+.\-]*:)?//[^/?#\"'\s>]+)"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case;
    empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = None
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, start = rule.split("/", 1)
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return F.lit(None).cast("string") if out is None else out


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict by rule (null where none fits) of ``pages``."""
    df = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    df = df.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = F.lit(None).cast("string")
    for verdict, rule in rules:
        verdicts = F.when(F.col("rule") == rule, verdict).otherwise(verdicts)
    return df.withColumn("by_rule", verdicts)


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: how many links pages of one host have to another host. Links within a host and
    links without a host of their own (relative ones) are no edges."""
    links = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1)))
    target = F.translate(F.regexp_extract("link", r"//(.*)", 1), _UPPER, _LOWER)
    return (
        pages.select(host_of(F.col("url")).alias("src"), links.alias("link"))
        .select("src", target.alias("dst"))
        .where("src <> dst and src <> '' and dst <> ''")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )


#: Steps between two written tables.
STEPS_EACH = 6


def propagate(ws: Workspace, edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, settled: float = SETTLED) -> DataFrame:
    """kind, host, rank: PageRanks of several kinds at once.

    ``edges``: kind, src, dst, n; ``seeds``: kind, host, weight with weights of a kind summing to
    1. Mass at hosts without out-edges goes back to the seeds. Ends when all ranks together move by
    less than ``settled``, at the latest after the steps that the damping proves to be enough. Each
    step is a join and a sum per host; every STEPS_EACH of them are written to the shared folder.
    Without edges the seeds are the ranks, without seeds there are none.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    moves = ws.stage(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("total")).alias("share")), "moves")
    seeds = ws.stage(seeds, "seeds", 1)
    ranks = seeds.select("kind", "host", F.col("weight").alias("rank"))
    if moves.isEmpty():
        return ranks

    def step(ranks: DataFrame) -> DataFrame:
        moved = ranks.join(moves, ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("in"))
        # one row per kind: what links carried; the rest of the damped mass restarts at the seeds
        carried = F.broadcast(moved.groupBy("kind").agg(F.sum("in").alias("carried")))
        both = moved.join(seeds, ["kind", "host"], "full").join(carried, "kind", "left")
        restart = F.coalesce("weight", F.lit(0.0)) * (1 - damping * F.coalesce("carried", F.lit(0.0)))
        return both.select("kind", "host", (damping * F.coalesce("in", F.lit(0.0)) + restart).alias("rank"))

    for done in range(0, steps_to_settle(damping), STEPS_EACH):
        new = ranks
        for _ in range(STEPS_EACH):
            new = step(new)
        # hosts that have a rank never lose it
        old = ranks.withColumnRenamed("rank", "old")
        new = ws.stage(new.join(old, ["kind", "host"], "left").select("kind", "host", "rank", F.abs(F.col("rank") - F.coalesce("old", F.lit(0.0))).alias("change")), f"ranks-{done}")
        change = new.agg(F.sum("change")).first()[0]
        ws.drop(f"ranks-{done - STEPS_EACH}")
        ranks = new.drop("change")
        if (change or 0.0) < settled:
            break
    return ranks


def filter_urls(pages: DataFrame, rules=RULES, settled: float = SETTLED) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each row of ``pages`` (page_id, url,
    html).

    The rule's verdict stands where one fits; elsewhere the host is allowed if its trust is at
    least SHARE of its distrust (so hosts of which nothing is known are allowed). Null urls have
    an empty host and path and take the verdict of the empty host; null html has no links.
    Repeated rows and null page_ids stay; other columns are ignored.
    """
    ws = Workspace(pages.sparkSession, "urls")
    df = ws.stage(judged(pages, rules), "judged")
    counts = ws.stage(df.where("by_rule is not null").groupBy(F.when(F.col("by_rule") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").alias("n")), "counts")
    totals = {r[0]: r[1] for r in counts.groupBy("kind").agg(F.sum("n")).collect()}  # two rows at most
    weight = F.when(F.col("kind") == "trust", F.col("n") / float(totals.get("trust", 1))).otherwise(F.col("n") / float(totals.get("distrust", 1)))
    edges = ws.stage(host_edges(pages), "edges")
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    ranks = propagate(ws, both, counts.select("kind", "host", weight.alias("weight")), settled=settled)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    hosts = ranks.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))
    df = df.join(hosts, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    by_host = F.when(F.col("trust") + TIE >= SHARE * F.col("distrust"), "allow").otherwise("block")
    return df.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), "trust", "distrust")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return filter_urls(pages).drop("trust", "distrust")


def _sql() -> str:
    rule = "CASE " + " ".join(
        f"WHEN (host = '{r.split('/', 1)[0]}' OR ends_with(host, '.{r.split('/', 1)[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}') THEN '{r}'"
        for _, r in sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    ) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in RULES) + " END"
    lower = f"'{_UPPER}', '{_LOWER}'"
    url = _URL.replace("'", "''")
    link = _LINK.replace("'", "''")
    return f"""
WITH RECURSIVE u AS MATERIALIZED (SELECT page_id, html, translate(coalesce(regexp_extract(url, '{url}', 1), ''), {lower}) AS host, coalesce(regexp_extract(url, '{url}', 2), '') AS path FROM pages),
j AS MATERIALIZED (SELECT *, {verdict} AS by_rule FROM (SELECT page_id, host, path, {rule} AS rule FROM u)),
c AS (SELECT CASE by_rule WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM j WHERE by_rule IS NOT NULL GROUP BY 1, 2),
seeds AS MATERIALIZED (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS weight FROM c),
l AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS link FROM u),
g AS (SELECT src, translate(regexp_extract(link, '//(.*)', 1), {lower}) AS dst FROM l),
e AS (SELECT src, dst, count(*) AS n FROM g WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY 1, 2),
b AS (SELECT 'trust' AS kind, src, dst, n FROM e UNION ALL SELECT 'distrust', dst, src, n FROM e),
moves AS MATERIALIZED (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM b),
sources AS MATERIALIZED (SELECT DISTINCT kind, src FROM moves),
r AS (SELECT 0 AS step, kind, host, weight::DOUBLE AS rank FROM seeds UNION ALL
  SELECT step + 1, kind, host, sum(v) FROM (
    SELECT r.step, m.kind, m.dst AS host, {DAMPING} * r.rank * m.share AS v FROM r JOIN moves m ON m.kind = r.kind AND m.src = r.host
    UNION ALL
    SELECT k.step, s.kind, s.host, s.weight * (1 - {DAMPING} * k.kept) FROM
      (SELECT r.step, r.kind, sum(CASE WHEN x.src IS NULL THEN 0 ELSE r.rank END) AS kept FROM r LEFT JOIN sources x ON x.kind = r.kind AND x.src = r.host GROUP BY 1, 2) k JOIN seeds s ON s.kind = k.kind)
  WHERE step < {steps_to_settle()} GROUP BY 1, 2, 3),
h AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS t, coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS d FROM r WHERE step = {steps_to_settle()} GROUP BY 1)
SELECT j.page_id, j.host, j.path, j.rule,
       coalesce(j.by_rule, CASE WHEN coalesce(h.t, 0) + {TIE} >= {SHARE} * coalesce(h.d, 0) THEN 'allow' ELSE 'block' END) AS verdict
FROM j LEFT JOIN h ON h.host = j.host
"""


OP2_SQL = _sql()
