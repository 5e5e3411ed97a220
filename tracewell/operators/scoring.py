"""Scores of extraction and answers against a truth table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.adapters import TX, table, transactions


def f1(hits: Column, found: Column, truth: Column) -> Column:
    """Harmonic mean of precision and recall; 1 where nothing was to be found and nothing was."""
    p = F.when(found > 0, hits / found).otherwise(F.when(truth == 0, 1.0).otherwise(0.0))
    r = F.when(truth > 0, hits / truth).otherwise(1.0)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def set_f1(found: DataFrame, truth: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """F1 of distinct key sets per group."""
    f = found.select(group, *keys).distinct().withColumn("f", F.lit(1))
    t = truth.select(group, *keys).distinct().withColumn("t", F.lit(1))
    g = f.join(t, [group, *keys], "full").groupBy(group).agg(
        F.sum(F.col("f") * F.col("t")).alias("h"), F.sum("f").alias("n_found"), F.sum("t").alias("n_truth")
    ).na.fill(0)
    return g.select(group, F.round(f1(F.col("h"), F.col("n_found"), F.col("n_truth")), 6).alias("f1"))


def match_kind(found: Column, truth: Column) -> Column:
    """exact, lenient (one contains the other), subset (all words of one are in the other) or none."""
    a, b = F.lower(F.trim(found)), F.lower(F.trim(truth))
    wa, wb = F.split(a, "\\s+"), F.split(b, "\\s+")
    return (
        F.when(a == b, "exact").when(a.contains(b) | b.contains(a), "lenient")
        .when((F.size(F.array_except(wa, wb)) == 0) | (F.size(F.array_except(wb, wa)) == 0), "subset").otherwise("none")
    )


def weighted(scores: DataFrame, group: str) -> DataFrame:
    """Weighted mean of (score, weight) and the nearest-rank 95th percentile of latency."""
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    k = F.row_number().over(Window.partitionBy(group).orderBy("latency"))
    s = scores.withColumns({"n": n, "k": k})
    return s.groupBy(group).agg(
        F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 6).alias("overall"),
        F.min(F.when(F.col("k") >= F.ceil(0.95 * F.col("n")), F.col("latency"))).alias("p95"),
    )


_SETS = f"{TX}, f AS (SELECT DISTINCT day AS g, sender AS k, receiver AS r FROM t WHERE id % 4 <> 0), h AS (SELECT DISTINCT day AS g, sender AS k, receiver AS r FROM t WHERE id % 5 <> 0)"


def _f1_sql(keys: str) -> str:
    return f"""WITH {_SETS}, x AS (SELECT DISTINCT g, {keys} FROM f), y AS (SELECT DISTINCT g, {keys} FROM h),
c AS (SELECT g, sum(hit) AS h, sum(fo) AS n, sum(tr) AS m FROM (SELECT g, 0 AS hit, 1 AS fo, 0 AS tr FROM x UNION ALL SELECT g, 0, 0, 1 FROM y UNION ALL SELECT g, 1, 0, 0 FROM x JOIN y USING (g, {keys})) GROUP BY 1)
SELECT g, round(CASE WHEN h = 0 THEN 0 ELSE 2 * (h / n) * (h / m) / (h / n + h / m) END, 6) AS f1 FROM c"""


def _sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = transactions(spark, d).select("id", F.col("day").alias("g"), F.col("sender").alias("k"), F.col("receiver").alias("r"))
    return t.where("id % 4 <> 0"), t.where("id % 5 <> 0")


@query("b02_entity_f1", _f1_sql("k"))
def b02(spark: SparkSession, d: str) -> DataFrame:
    return set_f1(*_sets(spark, d), "g", ["k"])


@query("b03_triple_f1", _f1_sql("k, r"))
def b03(spark, d):
    return set_f1(*_sets(spark, d), "g", ["k", "r"])


@query("b04_grounding", f"WITH {TX} SELECT day, round(count(*) FILTER (WHERE receiver <> sender AND amount > 10) / count(*), 6) AS share FROM t GROUP BY 1")
def b04(spark, d):
    ok = (F.col("receiver") != F.col("sender")) & (F.col("amount") > 10)
    return transactions(spark, d).groupBy("day").agg(F.round(F.count_if(ok) / F.count(F.lit(1)), 6).alias("share"))


@query("b06_accuracy", "SELECT l_shipdate::DATE::VARCHAR AS day, round(avg(CASE WHEN l_returnflag = CASE WHEN l_linestatus = 'F' THEN 'R' ELSE 'N' END THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM lineitem GROUP BY 1")
def b06(spark, d):
    want = F.when(F.col("l_linestatus") == "F", "R").otherwise("N")
    return table(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(
        F.round(F.avg(F.when(F.col("l_returnflag") == want, 1.0).otherwise(0.0)), 6).alias("accuracy")
    )


@query(
    "b08_weighted",
    """WITH s AS (SELECT event_type AS g, value AS score, event_id % 3 + 1 AS weight, epoch_us(ts) AS latency FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY latency) AS k, count(*) OVER (PARTITION BY g) AS n FROM s)
SELECT g, round(sum(score * weight) / sum(weight), 6) AS overall, min(latency) FILTER (WHERE k >= ceil(0.95 * n)) AS p95 FROM k GROUP BY 1""",
)
def b08(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("g"), F.col("value").alias("score"), (F.col("event_id") % 3 + 1).alias("weight"), F.unix_micros(F.col("ts").cast("timestamp")).alias("latency"))
    return weighted(e, "g")


@query(
    "b10_match_kind",
    r"""WITH p AS (SELECT p_partkey, lower(p_name) AS a, lower(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ' x') WHEN 2 THEN concat('zz ', p_brand) ELSE concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1)) END) AS b FROM part)
SELECT p_partkey, CASE WHEN trim(a) = trim(b) THEN 'exact' WHEN contains(trim(a), trim(b)) OR contains(trim(b), trim(a)) THEN 'lenient'
  WHEN len(list_filter(regexp_split_to_array(trim(a), '\s+'), lambda x: NOT list_contains(regexp_split_to_array(trim(b), '\s+'), x))) = 0
    OR len(list_filter(regexp_split_to_array(trim(b), '\s+'), lambda x: NOT list_contains(regexp_split_to_array(trim(a), '\s+'), x))) = 0 THEN 'subset' ELSE 'none' END AS kind FROM p""",
)
def b10(spark, d):
    k = F.col("p_partkey") % 4
    other = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_name", F.lit(" x"))).when(k == 2, F.concat(F.lit("zz "), "p_brand")).otherwise(
        F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1)))
    )
    return table(spark, d, "part").select("p_partkey", match_kind(F.col("p_name"), other).alias("kind"))
