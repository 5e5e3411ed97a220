"""Actor risk and network anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.similarity import clamp100
from ..plans.registry import query
from ..sources.adapters import TX, edges, transactions
from .graph import degrees, nodes_of

#: Weights of the risk components.
WEIGHTS = {
    "network_centrality": 0.13, "degree": 0.08, "txn_volume": 0.15, "txn_velocity": 0.10, "linked_entities": 0.08, "suspicious_patterns": 0.15,
    "community_position": 0.05, "bridge_score": 0.08, "shared_ids": 0.06, "temporal_correlation": 0.05, "evidence_confidence": 0.07,
}


def risk_components(a: DataFrame) -> dict[str, Column]:
    """Components of 0 to 100 from betweenness, max_betweenness, centrality, volume, total_volume, velocity,
    neighbours, findings, top_bridge, top_degree, bridge_share, shared, cooccurrences and confidence."""
    c = F.col
    part = lambda x, most: 100 * F.least(F.lit(1.0), x / most)
    return {
        "network_centrality": 100 * c("betweenness") / F.greatest("max_betweenness", F.lit(1e-9)),
        "degree": 100 * c("centrality"),
        "txn_volume": 100 * F.log10(1 + c("volume")) / F.log10(1 + F.greatest(F.lit(1.0), "total_volume")),
        "txn_velocity": part(c("velocity"), 20),
        "linked_entities": part(c("neighbours"), 20),
        "suspicious_patterns": part(c("findings"), 5),
        "community_position": F.when(c("top_bridge"), 100.0).when(c("top_degree"), 50.0).otherwise(0.0),
        "bridge_score": 100 * c("bridge_share"),
        "shared_ids": part(c("shared"), 5),
        "temporal_correlation": part(c("cooccurrences"), 10),
        "evidence_confidence": 100 * c("confidence"),
    }


def actor_risk(a: DataFrame) -> DataFrame:
    """id and score 0 to 100: the weighted sum of the clamped components."""
    parts = risk_components(a)
    score = sum((clamp100(parts[k].cast("double")) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return a.select("id", clamp100(score).alias("score"))


def tier(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 50, "medium").otherwise("low")


def cooccurrences(t: DataFrame, hour: int = 3_600_000_000, ahead: int = 64) -> DataFrame:
    """Per account: pairs with rows of other accounts, within an hour and at most ``ahead`` places apart.

    A row is an account of a transaction, sender and receiver alike; rows are ordered by time, id and account, and a
    pair counts for both of its accounts.  Rows of the hours before and after lie beside those of each hour, so pairs
    across its ends are found and a task sorts three hours at most.
    """
    both = t.select("id", "us", F.explode(F.array_distinct(F.array("sender", "receiver"))).alias("account")).where("account IS NOT NULL")
    cell = F.floor(F.col("us") / hour)
    rows = both.select("*", F.explode(F.array(*[F.struct((cell + k).alias("cell"), F.lit(k == 0).alias("own")) for k in (-1, 0, 1)])).alias("c")).select("id", "us", "account", "c.*")
    w = Window.partitionBy("cell").orderBy("us", "id", "account").rowsBetween(-ahead, ahead)
    near = rows.withColumn("near", F.collect_list(F.struct("us", "account")).over(w)).where("own")
    n = F.size(F.filter("near", lambda x: (F.abs(x["us"] - F.col("us")) <= hour) & (x["account"] != F.col("account"))))
    return near.groupBy("account").agg(F.sum(n).alias("n"))


def unusual_amounts(t: DataFrame, factor: float = 3.0) -> DataFrame:
    mean = t.agg(F.avg("amount").alias("mean"))  # one row
    return t.join(F.broadcast(mean)).where(F.col("amount") > factor * F.col("mean")).select("id", "sender", "receiver", "amount")


def unexpected_degrees(n: DataFrame, e: DataFrame) -> DataFrame:
    """Nodes whose half total degree is over 3 times the mean centrality and over 5."""
    d = degrees(n, e)
    s = d.agg(F.avg("centrality").alias("mean"), F.count(F.lit(1)).alias("size"))  # one row
    deg = F.col("centrality") * (F.col("size") - 1)
    return d.join(F.broadcast(s)).where((deg > 3 * F.col("mean")) & (deg > 5)).select("id", F.round(deg, 6).alias("degree"), F.when(deg > 5 * F.col("mean"), "high").otherwise("medium").alias("severity"))


_IN = f"""WITH {TX}, v AS (SELECT sender AS id, sum(amount) AS volume, count(*) AS n, count(DISTINCT receiver) AS nb FROM t GROUP BY 1),
a AS (SELECT id, (n % 7)::DOUBLE AS b, 7.0::DOUBLE AS mb, n / 100.0::DOUBLE AS c, volume, sum(volume) OVER () AS tv, n AS vel, nb, n % 6 AS f, n % 10 = 0 AS tb, n % 5 = 0 AS td,
  (n % 4) / 4.0::DOUBLE AS bs, n % 3 AS sh, n % 12 AS co, (n % 9) / 9.0::DOUBLE AS conf FROM v)"""


@query(
    "k01_actor_risk",
    _IN + """ SELECT id, round(0.13 * 100 * b / mb + 0.08 * least(100, 100 * c) + 0.15 * least(100, 100 * log10(1 + volume) / log10(1 + greatest(1, tv))) + 0.10 * 100 * least(1, vel / 20)
  + 0.08 * 100 * least(1, nb / 20) + 0.15 * 100 * least(1, f / 5) + 0.05 * (CASE WHEN tb THEN 100 WHEN td THEN 50 ELSE 0 END) + 0.08 * 100 * bs + 0.06 * 100 * least(1, sh / 5)
  + 0.05 * 100 * least(1, co / 10) + 0.07 * 100 * conf, 4) AS score FROM a""",
)
def k01(spark: SparkSession, d: str) -> DataFrame:
    v = transactions(spark, d).groupBy(F.col("sender").alias("id")).agg(F.sum("amount").alias("volume"), F.count(F.lit(1)).alias("n"), F.countDistinct("receiver").alias("nb"))
    total = v.agg(F.sum("volume").alias("total_volume"))
    n = F.col("n")
    a = v.join(F.broadcast(total)).select(
        "id", (n % 7).cast("double").alias("betweenness"), F.lit(7.0).alias("max_betweenness"), (n / 100).alias("centrality"), "volume", "total_volume", n.alias("velocity"),
        F.col("nb").alias("neighbours"), (n % 6).alias("findings"), (n % 10 == 0).alias("top_bridge"), (n % 5 == 0).alias("top_degree"), ((n % 4) / 4).alias("bridge_share"),
        (n % 3).alias("shared"), (n % 12).alias("cooccurrences"), ((n % 9) / 9).alias("confidence"),
    )
    return actor_risk(a).select("id", F.round("score", 4).alias("score"))


@query(
    "k03_cooccurrences",
    f"""WITH {TX}, u AS (SELECT id, us, sender AS account FROM t UNION SELECT id, us, receiver FROM t), r AS (SELECT *, row_number() OVER (ORDER BY us, id, account) AS k FROM u),
p AS (SELECT x.account AS a, y.account AS b FROM r x JOIN r y ON y.k > x.k AND y.k <= x.k + 64 AND y.us - x.us <= 3600000000 AND y.account <> x.account)
SELECT u.account, count(p.a) AS n FROM (SELECT DISTINCT account FROM u) u LEFT JOIN (SELECT a FROM p UNION ALL SELECT b FROM p) p ON p.a = u.account GROUP BY 1""",
)
def k03(spark, d):
    return cooccurrences(transactions(spark, d))


@query("k05_top_actors", _IN + " SELECT id, vel FROM a WHERE vel >= 10 ORDER BY vel DESC, id LIMIT 25")
def k05(spark, d):
    v = transactions(spark, d).groupBy(F.col("sender").alias("id")).agg(F.count(F.lit(1)).alias("vel"))
    return v.where("vel >= 10").orderBy(F.desc("vel"), "id").limit(25)


@query("a01_unusual_amounts", f"WITH {TX} SELECT id, sender, receiver, amount FROM t WHERE amount > 3 * (SELECT avg(amount) FROM t)")
def a01_amounts(spark, d):
    return unusual_amounts(transactions(spark, d))


@query(
    "a01_unexpected_degrees",
    f"""WITH {TX}, e AS (SELECT DISTINCT sender AS s, receiver AS r FROM t WHERE sender <> receiver), u AS (SELECT s AS id FROM e UNION ALL SELECT r FROM e),
g AS (SELECT id, count(*) AS deg FROM u GROUP BY 1), z AS (SELECT count(*) AS size FROM g), c AS (SELECT id, least(1, deg / (2.0::DOUBLE * (size - 1))) AS c, size FROM g, z)
SELECT id, round(c * (size - 1), 6) AS degree, CASE WHEN c * (size - 1) > 5 * (SELECT avg(c) FROM c) THEN 'high' ELSE 'medium' END AS severity FROM c WHERE c * (size - 1) > 3 * (SELECT avg(c) FROM c) AND c * (size - 1) > 5""",
)
def a01_degrees(spark, d):
    e = edges(spark, d)
    return unexpected_degrees(nodes_of(e), e)
