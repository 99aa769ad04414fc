"""URL filter by link-graph propagation (DataFrame and SQL functions only).

Rules decide the pages they fit.  For all other pages the verdict comes from their
host: personalised PageRank spreads trust from the hosts of allowed pages along
the links between hosts, and distrust from the hosts of blocked pages along the
reversed links (whoever links to a blocked host is suspect).  A host is blocked
if its distrust exceeds both its trust and the share of pages it has.

Masses are whole numbers (``MASS`` in all), so sums do not depend on the
order of additions and the result is the same on every cluster.  What arrives at a host without
a link in the direction of travel goes back to the seeds, in their proportions (done at the end, by one
common factor), so nothing piles up at the end of a chain.  Steps are repeated until the masses of all
hosts together change by less than ``SETTLED``, however long the chains of links are; that they do
not settle within ``MOST_STEPS`` (damping needs about 130) is an error.

Scale: pages are reduced to one row per host and one per host pair with a
combine before the shuffle; the iteration only sees those.  Both directions travel
in one frame, one join and one aggregation a step, written to the shared folder
every few steps.  Verdicts return to the pages by a join salted by page, so a
host with a third of all pages is no hot key.

Defined results: NULL urls and urls without ``://`` have an empty host and path
and are judged as the host named by the empty string; NULL html has no links; repeated
rows count and are judged each; equal trust and distrust allow.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualityspark.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MASS = 10 ** 15
#: summed change (whole numbers) at which the masses count as settled
SETTLED = MASS // 10 ** 6
MOST_STEPS = 300
#: steps between two looks at the change
LOOK = 6
SALT = 16
#: fixed values: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/"'?#\s<>]+)"""


def host_of(url: Column) -> Column:
    """Lower-cased host of the column ``__u``."""
    rest = F.expr("substring(__u, instr(__u, '://') + 3)")
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def _parsed(pages: DataFrame, url_col: str) -> DataFrame:
    u = pages.withColumn("__u", F.coalesce(F.col(url_col), F.lit("")))
    u = u.withColumn("host", host_of(F.col("__u")))
    tail = F.expr("substring(__u, instr(__u, '://') + 3 + length(host))")
    return u.withColumn("path", F.when(F.instr("__u", "://") > 0, F.regexp_extract(tail, r"^[^?#]*", 0)).otherwise("")).drop("__u")


def _rule(rules: Sequence[tuple[str, str, str]], value) -> Column:
    """``value`` of the longest fitting rule, else NULL."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((F.col("host") == r[1]) | F.col("host").endswith("." + r[1])) & F.col("path").startswith(r[2])
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def propagate(edges: DataFrame, seeds: DataFrame, settled: int = SETTLED) -> DataFrame:
    """Personalised PageRank of several graphs at once, until the masses settle.  ``edges``: (kind, src,
    dst, w), w whole numbers; ``seeds``: (kind, host, mass).  Damping 0.85."""
    degree = edges.groupBy("kind", "src").agg(F.sum("w").alias("deg"))
    links = common.materialize(edges.join(degree, ["kind", "src"]))
    back = seeds.select("kind", "host", F.expr("15 * mass div 100").alias("mass"))
    state = seeds
    for _ in range(MOST_STEPS // LOOK):
        for _ in range(LOOK - 1):
            state = _step(state, links, back)
        last = common.materialize(state)
        state = common.materialize(_step(last, links, back))
        change = (state.unionByName(last.withColumn("mass", -F.col("mass"))).groupBy("kind", "host").agg(F.sum("mass").alias("d"))
                  .agg(F.sum(F.abs("d")).alias("d")).first()["d"])  # one row
        if change is None or change < settled:
            total = state.groupBy("kind").agg(F.sum("mass").alias("total"))  # a row per graph
            return state.join(F.broadcast(total), "kind").select("kind", "host", F.expr(f"{MASS} * mass div total").alias("mass"))
    raise RuntimeError("trust and distrust did not settle")


def _step(state: DataFrame, links: DataFrame, back: DataFrame) -> DataFrame:
    flow = (state.withColumnRenamed("host", "src").join(links, ["kind", "src"])
            .select("kind", F.col("dst").alias("host"), F.expr("cast(mass as decimal(38,0)) * w div deg").alias("mass")))
    flow = flow.groupBy("kind", "host").agg(F.sum("mass").alias("mass")).selectExpr("kind", "host", "85 * mass div 100 AS mass")
    out = flow.unionByName(back).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
    return out.withColumn("mass", F.col("mass").cast("decimal(38,0)"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, trust and distrust of its host."""
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = _parsed(pages, "url")
    judged = (rows.withColumn("rule", _rule(rules, lambda r: r[1] + r[2]))
              .withColumn("ruled", _rule(rules, lambda r: r[0])))
    hosts = common.materialize(judged.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "allow").alias("allow"),
        F.count_if(F.col("ruled") == "block").alias("block")))
    to = F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col("html"), F.lit(LINK), 1),
                                                lambda h: F.translate(h, UPPER, LOWER))))
    pairs = common.materialize(rows.select(F.col("host").alias("src"), to.alias("dst")).where("src <> dst")
                               .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")))
    edges = (pairs.select(F.lit("trust").alias("kind"), "src", "dst", "w")
             .unionByName(pairs.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))
    total = hosts.agg(F.sum("n").alias("pages"), F.sum("allow").alias("allowed"), F.sum("block").alias("blocked"))
    seeds = hosts.crossJoin(F.broadcast(total)).selectExpr(  # one row of totals
        "host", "stack(2, 'trust', allow, allowed, 'distrust', block, blocked) AS (kind, c, s)").where("c > 0").selectExpr(
        "kind", "host", f"cast({MASS} as decimal(38,0)) * c div s AS mass")
    rank = propagate(edges, common.materialize(seeds))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0)).alias(k)
    rank = rank.groupBy("host").agg(of("trust"), of("distrust"))
    verdicts = (hosts.join(rank, "host", "left").crossJoin(F.broadcast(total))
                .selectExpr("host", "coalesce(trust, 0) AS trust", "coalesce(distrust, 0) AS distrust", "n", "pages")
                .selectExpr("host", "trust", "distrust",
                            f"CASE WHEN distrust > trust AND cast(distrust as decimal(38,0)) * pages >= cast({MASS} as decimal(38,0)) * n"
                            " THEN 'block' ELSE 'allow' END AS host_verdict"))
    verdicts = common.materialize(verdicts).withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    left = judged.select("page_id", "host", "path", "rule", "ruled").withColumn(
        "__s", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALT)).cast("int"))
    return left.join(verdicts, ["host", "__s"]).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "host_verdict").alias("verdict"), "trust", "distrust")


def _oracle(steps_far: int = 150) -> str:
    """``steps_far``: steps after which nothing changes any more at a damping of 0.85."""
    fits = [(f"(host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}')", h + p, v)
            for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    case = lambda i: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) + " END"
    low = f"'{UPPER}', '{LOWER}'"
    steps = "".join(f""", s{i} AS MATERIALIZED (
  SELECT kind, host AS src0, sum(mass) AS mass FROM (
    SELECT kind, dst AS host, CAST(85 * sum(CAST(mass AS HUGEINT) * w // deg) // 100 AS HUGEINT) AS mass
    FROM s{i - 1} JOIN links USING (kind, src0) GROUP BY kind, dst
    UNION ALL SELECT kind, src0, CAST(15 * mass // 100 AS HUGEINT) FROM s0) GROUP BY kind, host
)""" for i in range(1, steps_far + 1))
    link = LINK.replace("'", "''")
    return f"""
WITH u AS (
  SELECT page_id, html, coalesce(url, '') AS u FROM pages
), h AS (
  SELECT page_id, html, u, CASE WHEN contains(u, '://') THEN
    translate(regexp_extract(substr(u, instr(u, '://') + 3), '^[^/?#]*'), {low}) ELSE '' END AS host FROM u
), p AS (
  SELECT page_id, html, host, CASE WHEN contains(u, '://') THEN
    regexp_extract(substr(u, instr(u, '://') + 3 + length(host)), '^[^?#]*') ELSE '' END AS path FROM h
), j AS MATERIALIZED (
  SELECT page_id, host, path, {case(1)} AS rule, {case(2)} AS ruled FROM p
), hosts AS MATERIALIZED (
  SELECT host, count(*) AS n, count(*) FILTER (ruled = 'allow') AS allow, count(*) FILTER (ruled = 'block') AS block
  FROM j GROUP BY host
), pairs AS MATERIALIZED (
  SELECT src, dst, count(*) AS w FROM (
    SELECT DISTINCT page_id, host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), {low}) AS dst FROM p)
  WHERE src <> dst GROUP BY src, dst
), edges AS (
  SELECT 'trust' AS kind, src AS src0, dst, w FROM pairs UNION ALL SELECT 'distrust', dst, src, w FROM pairs
), total AS (
  SELECT sum(n) AS pages, sum(allow) AS allowed, sum(block) AS blocked FROM hosts
), s0 AS MATERIALIZED (
  SELECT 'trust' AS kind, host AS src0, CAST({MASS} AS HUGEINT) * allow // allowed AS mass FROM hosts, total WHERE allow > 0
  UNION ALL SELECT 'distrust', host, CAST({MASS} AS HUGEINT) * block // blocked FROM hosts, total WHERE block > 0
), links AS MATERIALIZED (
  SELECT kind, src0, dst, w, sum(w) OVER (PARTITION BY kind, src0) AS deg FROM edges
){steps}, settled AS (
  SELECT kind, src0, {MASS} * mass // sum(mass) OVER (PARTITION BY kind) AS mass FROM s{steps_far}
), rank AS (
  SELECT src0 AS host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS trust,
         coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS distrust FROM settled GROUP BY src0
), v AS (
  SELECT hosts.host, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0)
         AND coalesce(distrust, 0) * pages >= CAST({MASS} AS HUGEINT) * n THEN 'block' ELSE 'allow' END AS host_verdict
  FROM hosts LEFT JOIN rank ON hosts.host = rank.host, total
)
SELECT page_id, j.host, path, rule, coalesce(ruled, host_verdict) AS verdict FROM j JOIN v ON j.host = v.host
"""


@common.register("op8_url_filter", _oracle())
def op8(spark, sf):
    return judge(common.table(spark, sf, "pages")).select("page_id", "host", "path", "rule", "verdict")
