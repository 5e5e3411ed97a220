"""Canonical tables from the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Partitions for each core of rows that are dealt out.
SPREAD = 3


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt over all cores by a hash of columns, for work that costs far more than their shuffle.

    A row group of a file (often a million rows) is read by one task, which would do all that work alone.
    """
    return df.repartition(SPREAD * df.sparkSession.sparkContext.defaultParallelism, *by)


def transactions(spark: SparkSession, sf_dir: str, event_type: str | None = "purchase") -> DataFrame:
    """id, sender, receiver, amount, us (epoch microseconds), day, kind from ``events``."""
    e = table(spark, sf_dir, "events")
    if event_type is not None:
        e = e.where(F.col("event_type") == event_type)
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("sender"),
        F.concat(F.lit("U"), F.regexp_extract("props", "([0-9]+)", 1)).alias("receiver"),
        F.col("value").alias("amount"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.col("event_type").alias("kind"),
    )


#: The same table for DuckDB, as a common table expression.
TX = """t AS (SELECT event_id AS id, concat('U', user_id) AS sender,
  concat('U', regexp_extract(props, '([0-9]+)', 1)) AS receiver, value AS amount, epoch_us(ts) AS us,
  strftime(ts, '%Y-%m-%d') AS day, event_type AS kind FROM events WHERE event_type = 'purchase')"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed account graph: source, target, weight (transactions), amount; no self-loops."""
    return (
        transactions(spark, sf_dir)
        .where("sender <> receiver")
        .groupBy(F.col("sender").alias("source"), F.col("receiver").alias("target"))
        .agg(F.count(F.lit(1)).alias("weight"), F.sum("amount").alias("amount"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    )


EDGES = TX + """, e AS (SELECT sender AS source, receiver AS target, count(*) AS weight, sum(amount) AS amount,
  min(us) AS first_us, max(us) AS last_us FROM t WHERE sender <> receiver GROUP BY 1, 2)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as persons and suppliers as organizations: id, case_id (region), type, value, norm, status."""
    region = table(spark, sf_dir, "region").join(
        table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey")
    ).select("n_nationkey", F.col("r_name").alias("case_id"))
    c = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"),
        F.col("c_nationkey").alias("n_nationkey"),
        F.lit("person").alias("type"),
        F.col("c_name").alias("value"),
        F.concat(F.lit("holder "), (F.col("c_custkey") % 97).cast("string")).alias("norm"),
        F.col("c_acctbal").alias("balance"),
    )
    s = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"),
        F.col("s_nationkey").alias("n_nationkey"),
        F.lit("organization").alias("type"),
        F.col("s_name").alias("value"),
        F.concat(F.lit("holder "), (F.col("s_suppkey") % 97).cast("string")).alias("norm"),
        F.col("s_acctbal").alias("balance"),
    )
    return c.unionByName(s).join(region, "n_nationkey").select(
        "id", "case_id", "type", "value", "norm", "balance",
        F.when(F.col("balance") > 0, "confirmed").otherwise("candidate").alias("status"),
    )


ENTITIES = """x AS (
  SELECT concat('C', c_custkey) AS id, c_nationkey AS k, 'person' AS type, c_name AS value,
    concat('holder ', c_custkey % 97) AS norm, c_acctbal AS balance FROM customer
  UNION ALL SELECT concat('S', s_suppkey), s_nationkey, 'organization', s_name, concat('holder ', s_suppkey % 97), s_acctbal
  FROM supplier),
n AS (SELECT x.id, r_name AS case_id, x.type, x.value, x.norm, x.balance,
    CASE WHEN x.balance > 0 THEN 'confirmed' ELSE 'candidate' END AS status
  FROM x JOIN nation ON n_nationkey = k JOIN region ON r_regionkey = n_regionkey)"""


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id of every entity that ``links`` has, from distinct keys: no pairs with evidence are made."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct()
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key")).distinct()
    name = lambda df, mark: df.select(F.concat(F.lit(mark), F.col("key").cast("string")).alias("entity_id"))
    return name(o, "C").unionByName(name(l, "S"))


def all_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``links`` with a row for each line, not distinct."""
    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("entity_id"), F.col("o_orderkey").alias("evidence_id")
    )
    l = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("entity_id"), F.col("l_orderkey").alias("evidence_id")
    )
    return o.unionByName(l)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, evidence_id: an order is a piece of evidence, its customer and its suppliers are linked to it."""
    return all_links(spark, sf_dir).distinct()


LINKS = """k AS (SELECT concat('C', o_custkey) AS entity_id, o_orderkey AS evidence_id FROM orders
  UNION SELECT concat('S', l_suppkey), l_orderkey FROM lineitem)"""
