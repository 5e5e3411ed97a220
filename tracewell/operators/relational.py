"""Relational operators as the engine uses them: filters, joins, aggregates, windows, sets and merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.adapters import EDGES, ENTITIES, LINKS, TX, edges, entities, linked, links, table, transactions
from .near import near_pairs


def search(sources: dict[str, tuple[DataFrame, str, list[str]]], needle: str, most: int = 50) -> DataFrame:
    """Case-insensitive substring search over several tables (id column, text columns); newest ids first, at most 50 each."""
    n = needle.lower()
    parts = []
    for kind, (df, key, columns) in sources.items():
        hit = reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(n) for c in columns])
        parts.append(df.where(hit).orderBy(F.desc(key)).limit(most).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id")))
    return reduce(DataFrame.unionByName, parts)


def flow_direction(account: str) -> Column:
    me = F.lit(account)
    return F.when((F.col("sender") == me) & (F.col("receiver") == me), "self").when(F.col("sender") == me, "out").when(F.col("receiver") == me, "in").otherwise("other")


def either_end(e: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end in ``ids`` (id): a union of two semi joins, no OR join."""
    a = e.join(ids, e.source == ids.id, "left_semi")
    b = e.join(ids, e.target == ids.id, "left_semi")
    return a.unionByName(b).distinct()


def merge_weights(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of edges: weights of equal keys add up."""
    return old.unionByName(new).groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def resolve_id(keys: DataFrame, t: DataFrame) -> DataFrame:
    """The row whose id, or else whose value, is the key."""
    by_id = t.select(F.col("id").alias("key"), F.col("id").alias("i1"))
    by_value = t.groupBy(F.col("value").alias("key")).agg(F.min("id").alias("i2"))
    return keys.join(by_id, "key", "left").join(by_value, "key", "left").select("key", F.coalesce("i1", "i2").alias("id"))


@query("r01_projection", "SELECT o_orderkey, o_custkey FROM orders")
def r01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey")


@query("r02_predicates", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderpriority NOT IN ('5-LOW')")
def r02(spark, d):
    o = table(spark, d, "orders")
    return o.where(o.o_orderstatus.isin("F", "O") & o.o_totalprice.between(1000, 200000) & ~o.o_orderpriority.isin("5-LOW")).select("o_orderkey")


@query(
    "r03_search",
    """SELECT * FROM (SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license') ORDER BY doc_id DESC LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'message', CAST(conv_id * 100000 + turn AS VARCHAR) FROM conversations WHERE contains(lower(text), 'license') ORDER BY conv_id * 100000 + turn DESC LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'page', CAST(page_id AS VARCHAR) FROM pages WHERE contains(lower(html), 'license') ORDER BY page_id DESC LIMIT 50)""",
)
def r03(spark, d):
    c = table(spark, d, "conversations").withColumn("id", F.col("conv_id") * 100000 + F.col("turn"))
    return search({"document": (table(spark, d, "documents"), "doc_id", ["text", "source"]), "message": (c, "id", ["text"]), "page": (table(spark, d, "pages"), "page_id", ["html"])}, "License")


@query("r04_flow_direction", f"WITH {TX} SELECT id, CASE WHEN sender = 'U7' AND receiver = 'U7' THEN 'self' WHEN sender = 'U7' THEN 'out' ELSE 'in' END AS direction FROM t WHERE sender = 'U7' OR receiver = 'U7'")
def r04(spark, d):
    t = transactions(spark, d).where("sender = 'U7' OR receiver = 'U7'")
    return t.select("id", flow_direction("U7").alias("direction"))


@query("r05_timeline", "SELECT event_id, event_type AS kind FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-09' ORDER BY ts, event_id LIMIT 300")
def r05(spark, d):
    e = table(spark, d, "events").where("event_type = 'click' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-09'")
    return e.orderBy("ts", "event_id").limit(300).select("event_id", F.col("event_type").alias("kind"))


@query("r06_entity_listing", f"WITH {ENTITIES}, {LINKS} SELECT id, case_id, coalesce(c, 0) AS evidence FROM n LEFT JOIN (SELECT entity_id, count(*) AS c FROM k GROUP BY 1) ON entity_id = id")
def r06(spark, d):
    counts = links(spark, d).groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("c"))
    return entities(spark, d).join(counts, "id", "left").select("id", "case_id", F.coalesce("c", F.lit(0)).alias("evidence"))


@query("r07_relationship_listing", f"WITH {ENTITIES} SELECT o_orderkey, value, type, case_id FROM orders JOIN n ON id = concat('C', o_custkey)")
def r07(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("id"))
    return o.join(entities(spark, d), "id").select("o_orderkey", "value", "type", "case_id")


@query("r08_left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def r08(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left")


@query("r09_semi_join", f"WITH {ENTITIES}, {LINKS} SELECT id FROM n WHERE id IN (SELECT entity_id FROM k)")
def r09(spark, d):
    n, k = entities(spark, d), linked(spark, d)
    return n.join(k, n.id == k.entity_id, "left_semi").select("id")


@query("r10_anti_join", f"WITH {ENTITIES}, {LINKS} SELECT id FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE entity_id = id)")
def r10(spark, d):
    n, k = entities(spark, d), linked(spark, d)
    return n.join(k, n.id == k.entity_id, "left_anti").select("id")


@query("r11_either_end", f"WITH {EDGES} SELECT source, target FROM e WHERE source IN ('U1', 'U2') OR target IN ('U1', 'U2')")
def r11(spark, d):
    ids = spark.range(1, 3).select(F.concat(F.lit("U"), F.col("id").cast("string")).alias("id"))
    return either_end(edges(spark, d).select("source", "target"), ids)


@query("r12_self_join", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.event_type = 'error' AND b.event_type = 'error'")
def r12(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").select("event_id", "user_id")
    return e.select("user_id", F.col("event_id").alias("a")).join(e.select("user_id", F.col("event_id").alias("b")), "user_id").where("a < b").select("a", "b")


@query(
    "r13_fuzzy_join",
    "SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey AND abs(length(a.c_name) - length(b.c_name)) <= 2 AND levenshtein(a.c_name, b.c_name) <= 1",
)
def r13(spark, d):
    """Names one edit apart within a block; their lengths then differ by one at most."""
    return near_pairs(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_name"), "c_nationkey", "c_name", "c_custkey", 1)


@query(
    "r14_band_join",
    f"WITH {TX} SELECT x.id AS a, y.id AS b FROM t x JOIN t y ON x.receiver = y.sender AND y.us >= x.us AND y.us - x.us <= 3600000000 AND x.id <> y.id",
)
def r14(spark, d):
    """Money passed on within an hour: an equi-join on the account and hour buckets, then the exact band."""
    hour = 3_600_000_000
    t = transactions(spark, d)
    x = t.select(F.col("id").alias("a"), F.col("receiver").alias("acc"), F.col("us").alias("u1"), F.explode(F.array(F.floor(F.col("us") / hour), F.floor(F.col("us") / hour) + 1)).alias("h"))
    y = t.select(F.col("id").alias("b"), F.col("sender").alias("acc"), F.col("us").alias("u2"), F.floor(F.col("us") / hour).alias("h"))
    return x.join(y, ["acc", "h"]).where((F.col("u2") >= F.col("u1")) & (F.col("u2") - F.col("u1") <= hour) & (F.col("a") != F.col("b"))).select("a", "b")


@query("r16_group_count", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def r16(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("r17_statistics", "SELECT user_id, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high, round(median(value), 4) AS mid FROM events GROUP BY 1")
def r17(spark, d):
    g = table(spark, d, "events").groupBy("user_id")
    return g.agg(F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.median("value"), 4).alias("mid"))


@query("r18_distinct_count", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def r18(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("r19_collect", "SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM events WHERE event_type = 'error' GROUP BY 1")
def r19(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    return e.groupBy("user_id").agg(F.concat_ws(",", F.array_sort(F.collect_list("event_id")).cast("array<string>")).alias("ids"))


@query("r20_conditional_counts", "SELECT count(*) FILTER (WHERE o_totalprice >= 200000) AS high, count(*) FILTER (WHERE o_totalprice >= 100000 AND o_totalprice < 200000) AS medium, count(*) AS n FROM orders")
def r20(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").agg(F.count_if(p >= 200000).alias("high"), F.count_if((p >= 100000) & (p < 200000)).alias("medium"), F.count(F.lit(1)).alias("n"))


@query("r21_dashboard", f"WITH {ENTITIES} SELECT case_id, count(*) AS entities, count(*) FILTER (WHERE status = 'confirmed') AS confirmed, count(DISTINCT norm) AS norms, round(sum(balance), 2) AS balance FROM n GROUP BY 1")
def r21(spark, d):
    return entities(spark, d).groupBy("case_id").agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.countDistinct("norm").alias("norms"), F.round(F.sum("balance"), 2).alias("balance"))


@query(
    "r22_case_summary",
    f"WITH {ENTITIES}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY balance DESC, id) AS place FROM n) SELECT case_id, CAST(place AS INTEGER) AS place, id, balance FROM r WHERE place <= 5",
)
def r22(spark, d):
    w = Window.partitionBy("case_id").orderBy(F.desc("balance"), "id")
    return entities(spark, d).withColumn("place", F.row_number().over(w)).where("place <= 5").select("case_id", "place", "id", "balance")


@query("r23_bounds", "SELECT epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events")
def r23(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"))


@query("r25_top_n", "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 3")
def r25(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").withColumn("k", F.row_number().over(w)).where("k <= 3").select("p_brand", "p_partkey", "p_retailprice")


@query("r26_running_total", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events")
def r26(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("running"))


@query("r27_gaps", "SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS before_us, lead(epoch_us(ts)) OVER w - epoch_us(ts) AS after_us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def r27(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", (us - F.lag(us).over(w)).alias("before_us"), (F.lead(us).over(w) - us).alias("after_us"))


@query("r30_sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 100")
def r30(spark, d):
    return table(spark, d, "orders").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("r32_audit_feed", "SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS id, epoch_us(o_orderdate) AS us FROM orders UNION ALL SELECT 'event', event_id, epoch_us(ts) FROM events) ORDER BY us DESC, kind, id LIMIT 400")
def r32(spark, d):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias("us")
    o = table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), us("o_orderdate"))
    e = table(spark, d, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), us("ts"))
    return o.unionByName(e).orderBy(F.desc("us"), "kind", "id").limit(400)


@query("r33_set_difference", f"WITH {TX}, a AS (SELECT DISTINCT sender AS account FROM t WHERE day < '2024-01-15'), b AS (SELECT DISTINCT sender AS account FROM t WHERE day >= '2024-01-15') SELECT account, 'removed' AS change FROM a WHERE account NOT IN (SELECT account FROM b) UNION ALL SELECT account, 'added' FROM b WHERE account NOT IN (SELECT account FROM a)")
def r33(spark, d):
    t = transactions(spark, d)
    a, b = (t.where(c).select(F.col("sender").alias("account")).distinct() for c in ("day < '2024-01-15'", "day >= '2024-01-15'"))
    return a.join(b, "account", "left_anti").withColumn("change", F.lit("removed")).unionByName(b.join(a, "account", "left_anti").withColumn("change", F.lit("added")))


@query("r34_dedupe", "SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2")
def r34(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("price"))


@query("r35_upsert", f"WITH {TX} SELECT sender AS source, receiver AS target, count(*) AS weight FROM t WHERE sender <> receiver GROUP BY 1, 2")
def r35(spark, d):
    t = transactions(spark, d).where("sender <> receiver")
    count = lambda x: x.groupBy(F.col("sender").alias("source"), F.col("receiver").alias("target")).agg(F.count(F.lit(1)).alias("weight"))
    return merge_weights(count(t.where("day < '2024-01-15'")), count(t.where("day >= '2024-01-15'")))


@query("r36_delete", f"WITH {EDGES} SELECT source, target FROM e WHERE NOT (weight = 1 AND amount < 20)")
def r36(spark, d):
    return edges(spark, d).where(~((F.col("weight") == 1) & (F.col("amount") < 20))).select("source", "target")


@query("r38_resolve_id", f"WITH {ENTITIES}, q AS (SELECT concat('C', c_custkey * 3) AS key FROM customer UNION SELECT c_name FROM customer WHERE c_custkey < 100) SELECT key, coalesce((SELECT id FROM n WHERE id = key), (SELECT min(id) FROM n WHERE value = key)) AS id FROM q")
def r38(spark, d):
    c = table(spark, d, "customer")
    keys = c.select(F.concat(F.lit("C"), (F.col("c_custkey") * 3).cast("string")).alias("key")).union(c.where("c_custkey < 100").select("c_name")).distinct()
    return resolve_id(keys, entities(spark, d))
