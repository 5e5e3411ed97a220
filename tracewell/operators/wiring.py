"""From what was read to a case's graph: entities, record edges, events, and the gates for what a model proposed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalize, vocabulary
from ..functions.display import grouped
from ..plans.registry import query
from ..sources.adapters import ENTITIES, TX, entities, table, transactions
from .ledgers import _documents, ledger_transactions
from .messages import _chats, chat_lines
from .tables import relationship_table

#: Evidence and links of a kept proposal: what a verified quotation adds, what a paraphrase leaves, and its floor.
PROVEN, PARAPHRASED, FLOOR, UNSTATED = 0.1, 0.85, 0.3, 0.8
# firms' words, and a bare attribute cell.
_FIRM = r"(?i)\b(pvt|ltd|llp|inc|corp|bank|enterprises|traders|logistics|trading|imports|exports|finance|services|retail|wholesale|brokers)\b"
_CELL = "^[a-z][a-z0-9_ -]{1,23}==?.{1,60}$"


def wire_entities(found: DataFrame, known: DataFrame) -> DataFrame:
    """One row per (case_id, type, norm) of found and known entities.

    ``found`` has case_id, label, value, confidence and refs; ``known`` has id, case_id, type, norm, value, status, confidence
    and refs.  A label that is no type gives the type that the value looks like.  A known entity keeps its id and value;
    a candidate that is found again is confirmed, the confidence is the highest, the references are joined.  New
    ones have a null id and are candidates below 0.7.  Values without a norm are left out.
    """
    kind = F.coalesce(vocabulary.entity_type(F.col("label")), normalize.guess_type(F.col("value")))
    new = found.withColumn("type", kind).withColumn("norm", normalize.entity(F.col("type"), F.col("value"))).where("norm <> ''")
    none = F.array().cast("array<string>")
    new = new.select("case_id", "type", "norm", F.lit(None).cast("string").alias("id"), "value", F.lit(None).cast("string").alias("status"), "confidence", F.coalesce("refs", none).alias("refs"), F.lit(1).alias("seen"))
    old = known.select("case_id", "type", "norm", F.col("id").cast("string").alias("id"), "value", "status", "confidence", F.coalesce("refs", none).alias("refs"), F.lit(0).alias("seen"))
    g = old.unionByName(new).groupBy("case_id", "type", "norm").agg(
        F.min("id").alias("id"), F.min(F.struct("seen", "value")).alias("v"), F.max("status").alias("high"), F.min("status").alias("status"),
        F.max("confidence").alias("confidence"), F.sum("seen").alias("seen"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs"),
    )
    fresh = F.when(F.col("confidence") >= 0.7, "confirmed").otherwise("candidate")
    status = F.when(F.col("id").isNull(), fresh).when(F.col("seen") > 0, F.when(F.col("status") == "candidate", "confirmed").otherwise(F.col("status"))).otherwise(F.col("status"))
    return g.select("case_id", "type", "norm", "id", F.col("v.value").alias("value"), status.alias("status"), "confidence", "refs", (F.col("id").isNull()).alias("created"))


def endpoint_type(value: Column) -> Column:
    """Type of a record's endpoint that no entity has yet; null if it is neither an identifier nor a firm."""
    number = normalize.digits(value)
    return (
        F.when(value.rlike(r"(?i)^[\w.\-]{2,}@[a-z]{2,}$"), "upi")
        .when(F.trim(value).startswith("+") | number.rlike("^(91|0)?[6-9][0-9]{9}$"), "phone")
        .when(F.length(number).between(9, 18), "account").when(value.rlike(_FIRM), "organization")
    )


def record_edges(payments: DataFrame, messages: DataFrame, id_column: str) -> DataFrame:
    """Edges that records assert: transfers (0.85) and communications (0.8) between two different, named ends."""
    p = payments.select(
        id_column, F.trim("sender").alias("source"), F.trim("receiver").alias("target"), F.lit("TRANSFERRED_TO").alias("relation"), F.lit(0.85).alias("confidence"),
        F.col("txn_date").alias("at"), "amount", F.concat(F.lit("bank record"), F.coalesce(F.concat(F.lit(" UTR "), "utr"), F.lit("")), F.coalesce(F.concat(F.lit(" — ₹"), grouped(F.col("amount"))), F.lit(""))).alias("why"),
    )
    m = messages.select(
        id_column, F.trim("sender").alias("source"), F.trim("receiver").alias("target"), F.lit("COMMUNICATED_WITH").alias("relation"), F.lit(0.8).alias("confidence"), F.col("time").alias("at"),
        F.lit(None).cast("double").alias("amount"), F.concat("platform", F.lit(" record on "), F.substring("time", 1, 10)).alias("why"),
    )
    rows = p.unionByName(m)
    return rows.where("source <> '' AND target <> '' AND source <> target")


def missing_endpoints(records: DataFrame, known: DataFrame) -> DataFrame:
    """value and type of the ends of record edges that no known ``value`` names, in any case or punctuation."""
    ends = records.select(F.explode(F.array("source", "target")).alias("value")).distinct()
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    names = known.select(bare(F.col("value")).alias("bare")).where("length(bare) >= 2").distinct()
    left = ends.withColumn("bare", bare(F.col("value"))).join(names, "bare", "left_anti").drop("bare")
    return left.withColumn("type", endpoint_type(F.col("value"))).where("type IS NOT NULL")


def table_events(relations: DataFrame, id_column: str, most: int = 2000) -> DataFrame:
    """Timeline events of the dated rows of relationship tables, the first ``most`` of each document."""
    rows = relations.where("date IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy(id_column).orderBy("line"))).where(F.col("k") <= most)
    text = F.concat(F.coalesce(F.concat("row_id", F.lit(" · ")), F.lit("")), "source", F.lit(" —"), "verb", F.lit("→ "), "target")
    return rows.select(id_column, "line", F.substring("date", 1, 10).alias("ts"), F.lit("relationship").alias("kind"), F.substring(text, 1, 240).alias("summary"))


def drop_noise(proposed: DataFrame, known: DataFrame, noise: DataFrame, id_column: str) -> DataFrame:
    """Proposed entities (id, type, value) without references and cells of the document's own tables (id, token).

    Attribute cells, and people or firms that are one word without a capital's worth of meaning, go too; values that
    were found by rules (``known``: id, value) always stay.
    """
    norm = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    rows = proposed.withColumn("norm_", norm(F.col("value")))
    sure = known.select(id_column, norm(F.col("value")).alias("norm_"), F.lit(True).alias("sure")).distinct()
    bad = noise.select(id_column, norm(F.col("token")).alias("norm_"), F.lit(True).alias("bad")).where("length(norm_) BETWEEN 2 AND 60").distinct()
    rows = rows.join(sure, [id_column, "norm_"], "left").join(bad, [id_column, "norm_"], "left")
    word = F.col("type").isin("person", "organization") & F.col("norm_").rlike("^[a-z]{2,20}$")
    drop = F.coalesce("bad", F.lit(False)) | F.col("norm_").rlike(_CELL) | word
    return rows.where(F.coalesce("sure", F.lit(False)) | ~drop).select(*proposed.columns)


def proof_gate(proposed: DataFrame, docs: DataFrame, id_column: str) -> DataFrame:
    """Proposed links (id, quote, why, confidence) with ``proof`` and the confidence it leaves.

    A quotation that is in the document proves a link; a link that only says why, or says why beside a quotation that
    isn't there, is a paraphrase; a link with neither, or with such a quotation alone, is dropped.
    """
    quote, why = F.trim(F.coalesce("quote", F.lit(""))), F.trim(F.coalesce("why", F.lit("")))
    own = F.coalesce("confidence", F.lit(UNSTATED))
    found = (quote != "") & F.coalesce(normalize.quoted(quote, F.coalesce("text", F.lit(""))), F.lit(False))
    proof = F.when(found, "proven").when(why != "", "paraphrased")
    rows = proposed.join(docs.select(id_column, "text"), id_column, "left").withColumn("proof", proof).where("proof IS NOT NULL")
    kept = F.when(F.col("proof") == "proven", F.least(F.lit(1.0), own + PROVEN)).otherwise(F.greatest(F.lit(FLOOR), own * PARAPHRASED))
    return rows.withColumn("confidence", kept).select(*proposed.columns, "proof")


@query(
    "e01_wiring",
    "WITH " + ENTITIES + """, f AS (SELECT case_id, type, value, id FROM n WHERE type = 'organization'), o AS (SELECT case_id, type, id, lower(value) AS key FROM n WHERE type = 'organization' AND balance > 1000)
SELECT f.case_id, count(*) AS n, count(o.id) AS known, count(*) FILTER (WHERE o.id IS NULL) AS created FROM f LEFT JOIN o ON o.id = f.id GROUP BY 1""",
)
def e01(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers found again, a part of them known: matched by case, type and norm."""
    n = entities(spark, d).where("type = 'organization'")
    ref = F.array(F.concat(F.lit("R-"), "id"))
    known = n.where("balance > 1000").select("id", "case_id", "type", normalize.entity(F.lit("organization"), F.col("value")).alias("norm"), "value", F.lit("candidate").alias("status"), F.lit(0.5).alias("confidence"), F.array().cast("array<string>").alias("refs"))
    found = n.select("case_id", F.lit("Company").alias("label"), F.concat("value", F.lit(" ")).alias("value"), F.lit(0.9).alias("confidence"), ref.alias("refs"))
    rows = wire_entities(found, known).where("status = 'confirmed' AND size(refs) = 1 AND confidence = 0.9")
    return rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count("id").alias("known"), F.sum(F.col("created").cast("long")).alias("created"))


@query(
    "e04_record_edges",
    "WITH " + TX + """ SELECT sender AS document, concat('50100', lpad(substr(sender, 2), 7, '0')) AS source, concat('50100', lpad(substr(receiver, 2), 7, '0')) AS target, 'TRANSFERRED_TO' AS relation, day AS at FROM t WHERE sender <> receiver
UNION ALL SELECT sender, sender, receiver, 'COMMUNICATED_WITH', strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.000Z') FROM t WHERE sender <> receiver""",
)
def e04(spark, d):
    payments = ledger_transactions(_documents(spark, d, "lines"), "case").withColumnRenamed("case", "document")
    rows = record_edges(payments, chat_lines(_chats(spark, d, "whatsapp"), "chat").withColumnRenamed("chat", "document"), "document")
    return rows.select("document", "source", "target", "relation", "at")


@query(
    "e04_missing_endpoints",
    "WITH " + TX + ", u AS (SELECT sender AS x FROM t WHERE sender <> receiver UNION SELECT receiver FROM t WHERE sender <> receiver) SELECT concat('50100', lpad(substr(x, 2), 7, '0')) AS value, 'account' AS type FROM u WHERE CAST(substr(x, 2) AS INTEGER) % 2 = 1",
)
def e04_missing(spark, d):
    t = transactions(spark, d).where("sender <> receiver")
    account = lambda c: F.concat(F.lit("50100"), F.lpad(F.substring(c, 2, 20), 7, "0"))
    records = t.select(account("sender").alias("source"), account("receiver").alias("target"))
    known = records.select(F.explode(F.array("source", "target")).alias("value")).distinct().where("cast(substring(value, 6, 7) as int) % 2 = 0")
    return missing_endpoints(records, known.withColumn("value", F.concat_ws("-", F.substring("value", 1, 4), F.substring("value", 5, 20))))


@query(
    "e05_table_events",
    """SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS ts, concat('R', o_orderkey, ' · Ann Shaw ', o_custkey, ' —PAID→ Acme Ltd ', o_orderkey) AS summary FROM orders
QUALIFY count(*) OVER (PARTITION BY o_custkey) >= 5""",
)
def e05(spark, d):
    o = table(spark, d, "orders")
    row = F.concat_ws(",", F.concat(F.lit("R"), "o_orderkey"), F.concat(F.lit("Ann Shaw "), "o_custkey"), F.lit("PAID"), F.concat(F.lit("Acme Ltd "), "o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    g = o.select("o_custkey", row.alias("x")).groupBy("o_custkey").agg(F.array_sort(F.collect_list("x")).alias("r"))
    docs = g.select("o_custkey", F.concat(F.lit("id,source,relationship,target,date\n"), F.array_join("r", "\n")).alias("text"))
    return table_events(relationship_table(docs, "o_custkey"), "o_custkey").select("o_custkey", "ts", "summary")


@query(
    "e07_noise",
    "SELECT c_custkey, CASE k WHEN 0 THEN c_name WHEN 4 THEN 'watchlist' END AS value FROM customer, (VALUES (0), (4)) v(k)",
)
def e07(spark, d):
    """Kept: a name, and a word that rules had found; dropped: a row reference, an attribute cell, a lower-case word."""
    c = table(spark, d, "customer")
    proposed = c.select("c_custkey", F.explode(F.array(*[F.struct(F.lit("person").alias("type"), x.alias("value")) for x in (
        F.col("c_name"), F.concat(F.lit(" e0 "), F.col("c_custkey").cast("string")), F.lit("Status=Active person"), F.lit("ridian"), F.lit("watchlist"))])).alias("p")).select("c_custkey", "p.*")
    noise = c.select("c_custkey", F.concat(F.lit("E0  "), F.col("c_custkey").cast("string")).alias("token"))
    return drop_noise(proposed, c.select("c_custkey", F.lit("Watchlist").alias("value")), noise, "c_custkey").select("c_custkey", "value")


@query(
    "e08_proof_gate",
    """SELECT c_custkey, k, CASE k WHEN 0 THEN 'proven' ELSE 'paraphrased' END AS proof, CASE k WHEN 0 THEN 0.9 WHEN 1 THEN 0.68 WHEN 2 THEN 0.3 END::DOUBLE AS confidence
FROM customer, (VALUES (0), (1), (2)) v(k)""",
)
def e08(spark, d):
    c = table(spark, d, "customer")
    docs = c.select("c_custkey", F.concat(F.lit("It is said that "), "c_name", F.lit(" paid the broker in cash.")).alias("text"))
    cases = [(F.concat("c_name", F.lit(" PAID the broker")), F.lit(None), F.lit(None)), (F.lit("bought a ship"), F.lit("they met"), F.lit(None)), (F.lit(None), F.lit("they met"), F.lit(0.1)),
             (F.lit("bought a ship"), F.lit(" "), F.lit(0.9)), (F.lit(None), F.lit(None), F.lit(0.9))]
    proposed = c.select("c_custkey", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), q.cast("string").alias("quote"), w.cast("string").alias("why"), s.cast("double").alias("confidence")) for k, (q, w, s) in enumerate(cases)])).alias("p")).select("c_custkey", "p.*")
    return proof_gate(proposed, docs, "c_custkey").select("c_custkey", "k", "proof", F.round("confidence", 6).alias("confidence"))
