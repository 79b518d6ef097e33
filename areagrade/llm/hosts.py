"""URL filters: rules by host and path, then link-graph propagation between hosts.

Trust is a personalised PageRank that starts at hosts with allowed pages and follows their
links; distrust starts at hosts with blocked pages and runs against the links, to the hosts
that point at them. A host with more distrust than trust is blocked.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""
DAMPING = 0.85
STEPS_KEPT = 5  # steps from one checkpoint to the next
THRESHOLD = 1.0
LEAST = 0.01  # pages; less distrust blocks no host, and walks go on until less than this is left to place
HUB_LINKS = 100_000  # a host with more links is dealt to several tasks


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(rule_host, rule_path, rule, rule_verdict)."""
    rows = [(h, p, h + p, v) for h, p, v in rules]
    return spark.createDataFrame(rows, "rule_host string, rule_path string, rule string, rule_verdict string")


def matched_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, rule_verdict): the longest rule that fits each (host, path) that one fits.

    Every suffix of labels of the host meets, with the path cut to each length that rules have,
    the rules by equality, so any number of rules is one equi-join. Of equally long rules the one
    with the longer host wins.
    """
    lengths = F.array_sort(F.collect_set(F.char_length("rule_path")))
    by_host = rules.groupBy("rule_host").agg(lengths.alias("lengths"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = places.select("host").distinct().select("host", F.explode(suffixes).alias("rule_host")).join(by_host, "rule_host")
    cut = (
        places.join(hosts, "host")
        .select("host", "path", "rule_host", F.explode("lengths").alias("n"))
        .where(F.char_length("path") >= F.col("n"))
        .withColumn("rule_path", F.substr("path", F.lit(1), F.col("n")))
    )
    best = F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.char_length("rule"), F.char_length("rule_host"), "rule"))
    return cut.join(rules, ["rule_host", "rule_path"]).groupBy("host", "path").agg(best.alias("r")).select("host", "path", "r.*")


def host_links(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(source, target, pages): pages of a host with a link to another host. Relative links stay within."""
    links = F.array_distinct(F.transform(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER)))
    rows = pages.select(F.col(host).alias("source"), F.explode(links).alias("target"))
    return rows.where("source <> '' and target <> '' and source <> target").groupBy("source", "target").agg(F.count("*").alias("pages"))


def steps_until(mass: float, damping: float = DAMPING, least: float = LEAST) -> int:
    """Steps after which less than ``least`` of a ``mass`` is still to be placed."""
    return 0 if mass <= least else math.floor(math.log(mass / least) / -math.log(damping)) + 1


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, least: float = LEAST, hub_links: int = HUB_LINKS) -> DataFrame:
    """(host, trust, distrust) of all hosts that a seed reaches.

    ``seeds`` has (host, trust, distrust), the weights the two walks start with. In each step a
    walk goes on with probability ``damping``, along a link in proportion to its pages, backward
    for distrust; it ends where there is no link. After n steps no more than damping ** n
    of the seeds' weight is still to be placed, and there are as many steps as leave less than
    ``least``, so no host's value is further from its limit. The links are a table bucketed by the
    end that a walk leaves, so a step shuffles ranks, not links. A host with more than
    ``hub_links`` links has them dealt to several parts, and its rank goes to each of these. A
    checkpoint after every few steps keeps lineage short.
    """
    spark = links.sparkSession
    links = links.checkpoint()  # pages are looked through for links once
    both = links.selectExpr("'trust' as walk", "source as host", "target as next", "pages").unionByName(
        links.selectExpr("'distrust' as walk", "target as host", "source as next", "pages")
    )
    parts = F.ceil(F.count("*") / hub_links).cast("int")
    out = both.groupBy("walk", "host").agg(F.sum("pages").alias("all"), parts.alias("parts")).checkpoint()
    parts_of = out.select("walk", "host", "parts")
    table = f"host_links_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("next"), F.col("parts")).cast("int")
    shares = both.join(out, ["walk", "host"]).select("walk", "host", part.alias("part"), "next", (F.col("pages") / F.col("all")).alias("share"))
    shares = shares.join(parts_of.withColumnsRenamed({"host": "next", "parts": "next_parts"}), ["walk", "next"], "left")
    by = ["walk", "host", "part"]
    shares.repartition(buckets, *by).write.bucketBy(buckets, *by).saveAsTable(table)
    walks = "stack(2, 'trust', cast(trust as double), 'distrust', cast(distrust as double)) as (walk, rank)"
    start = seeds.selectExpr("host", walks).where("rank > 0").join(parts_of, ["walk", "host"], "left").select("walk", "host", "parts", "rank").checkpoint()
    again = start.withColumn("rank", F.col("rank") * (1 - damping))
    masses = start.groupBy("walk").agg(F.sum("rank").alias("rank")).agg(F.max("rank").alias("most"))
    steps = steps_until(masses.first()["most"] or 0.0, damping, least)
    ranks = start
    try:
        if spark.table(table).isEmpty():
            ranks, steps = again, 0
        for step in range(1, steps + 1):
            spread = ranks.where("parts > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
            moved = spread.join(spark.table(table), by).select(
                "walk", F.col("next").alias("host"), F.col("next_parts").alias("parts"), (F.col("rank") * F.col("share") * damping).alias("rank")
            )
            ranks = moved.unionByName(again).groupBy("walk", "host").agg(F.max("parts").alias("parts"), F.sum("rank").alias("rank"))
            if step % STEPS_KEPT == 0 or step == steps:
                ranks = ranks.checkpoint()
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table} PURGE")
    of = lambda walk: F.coalesce(F.sum(F.when(F.col("walk") == walk, F.col("rank"))), F.lit(0.0)).alias(walk)
    return ranks.groupBy("host").agg(of("trust"), of("distrust"))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", html: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``verdict``, ``trust`` and ``distrust``.

    The verdict is the longest fitting rule's. Where none fits it is ``block`` if the host's
    distrust is at least LEAST pages and more than ``threshold`` times its trust, else ``allow``. A
    host's seeds are the numbers of its pages that rules allow and block. A null url, or one without ``://``, has an
    empty host and path, fits no rule and is allowed; a null html has no links. Repeated rows
    count each. Columns of these names are replaced; an empty table gives no rows.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "trust", "distrust")]
    u = F.coalesce(F.col(url), F.lit(""))
    placed = pages.withColumns({"_host": host_of(u), "_path": path_of(u)})
    counted = placed.groupBy(F.col("_host").alias("host"), F.col("_path").alias("path")).agg(F.count("*").alias("pages")).checkpoint()
    ruled = matched_rules(counted.select("host", "path"), rules).checkpoint()
    of = lambda verdict: F.sum(F.when(F.col("rule_verdict") == verdict, F.col("pages")).otherwise(0))
    seeds = counted.join(ruled, ["host", "path"]).where("host <> ''").groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust"))
    scores = propagate(host_links(placed, "_host", html), seeds)
    zero = F.lit(0.0)
    distrusted = (F.col("distrust") >= LEAST) & (F.col("distrust") > threshold * F.coalesce("trust", zero))
    by_place = counted.join(ruled, ["host", "path"], "left").join(scores, "host", "left").select(
        F.col("host").alias("_host"),
        F.col("path").alias("_path"),
        "rule",
        F.coalesce("rule_verdict", F.when(distrusted, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", zero).alias("trust"),
        F.coalesce("distrust", zero).alias("distrust"),
    )
    return placed.select(*kept, "_host", "_path").join(by_place, ["_host", "_path"]).select(
        *kept, F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", "verdict", "trust", "distrust"
    )


def op2_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    from areagrade.sources.tables import read_table

    pages = read_table(spark, sf, "pages").select("page_id", "url", "html")
    return filter_urls(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op2_sql(rules=RULES) -> str:
    """The same with the steps as a recursion that carries what is still on its way."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for h, p, _ in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in ordered) + " END"
    link = LINK.removeprefix("(?i)").replace("'", "''")
    ctes = [
        "u AS (SELECT page_id, html, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages)",
        f"p AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)",
        f"j AS (SELECT *, {rule} AS rule, {verdict} AS ruled FROM p)",
        "seeds AS (SELECT host, CAST(count(*) FILTER (ruled = 'allow') AS DOUBLE) AS trust, CAST(count(*) FILTER (ruled = 'block') AS DOUBLE) AS distrust FROM j WHERE host <> '' GROUP BY host)",
        f"e0 AS (SELECT host AS source, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '{link}', 1, 'i'), lambda x: translate(x, '{UPPER}', '{LOWER}')))) AS target FROM p)",
        "e AS MATERIALIZED (SELECT source, target, count(*) AS n FROM e0 WHERE source <> '' AND target <> '' AND source <> target GROUP BY ALL)",
    ]
    for walk, a, b in (("trust", "source", "target"), ("distrust", "target", "source")):
        ctes.append(f"{walk}_e AS MATERIALIZED (SELECT {a} AS a, {b} AS b, n / sum(n) OVER (PARTITION BY {a}) AS share FROM e)")
    ctes.append(
        f"steps AS MATERIALIZED (SELECT CASE WHEN m > {LEAST} THEN CAST(floor(ln(m / {LEAST}) / -ln({DAMPING})) AS INT) + 1 ELSE 0 END AS steps"
        " FROM (SELECT greatest(coalesce(sum(trust), 0), coalesce(sum(distrust), 0)) AS m FROM seeds))"
    )
    for walk in ("trust", "distrust"):
        moved = f"SELECT step + 1, b, sum({DAMPING} * rank * share) FROM {walk}_w JOIN {walk}_e ON host = a WHERE step < (SELECT steps FROM steps) GROUP BY step, b"
        ctes.append(f"{walk}_w(step, host, rank) AS (SELECT 0, host, {walk} FROM seeds WHERE {walk} > 0 UNION ALL {moved})")
        placed = f"sum(CASE WHEN step < (SELECT steps FROM steps) THEN {1 - DAMPING!r} ELSE 1 END * rank)"
        ctes.append(f"{walk}_all AS (SELECT host, {placed} AS rank FROM {walk}_w GROUP BY host)")
    return (
        "WITH RECURSIVE " + ",\n".join(ctes) + f"""
SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN d.rank >= {LEAST} AND d.rank > {THRESHOLD} * coalesce(t.rank, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN trust_all t ON t.host = j.host LEFT JOIN distrust_all d ON d.host = j.host"""
    )
