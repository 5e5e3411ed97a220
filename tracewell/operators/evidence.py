"""Entity resolution, collisions, contradictions, gaps, sufficiency, claims and snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.similarity import amounts_differ, half_up, name_similarity
from ..plans.registry import query
from ..sources.adapters import ENTITIES, LINKS, TX, edges, entities, links, table, transactions
from .near import near_pairs


def collisions(e: DataFrame, shortest: int = 4) -> DataFrame:
    """(type, norm) that two cases or more hold."""
    g = e.where(F.length("norm") >= shortest).groupBy("type", "norm").agg(
        F.countDistinct("case_id").alias("cases"), F.count(F.lit(1)).alias("n")
    )
    return g.where("cases >= 2")


def reference_contradictions(t: DataFrame) -> DataFrame:
    """Pairs of records of one reference whose amounts, directions or dates disagree (utr, id, amount, sender, receiver, us)."""
    other = t.select("utr", *[F.col(c).alias(f"{c}_b") for c in ("id", "amount", "sender", "receiver", "us")])
    p = t.where(F.length("utr") >= 4).join(other, "utr").where("id < id_b")
    days = half_up(F.abs(F.col("us") - F.col("us_b")) / 86_400_000_000)
    kinds = F.array_compact(
        F.array(
            F.when(amounts_differ(F.col("amount"), F.col("amount_b")), "amount"),
            F.when((F.col("sender") == F.col("receiver_b")) & (F.col("receiver") == F.col("sender_b")), "direction"),
            F.when(days > 1, "date"),
        )
    )
    return p.select("utr", F.col("id").alias("a"), F.col("id_b").alias("b"), F.explode(kinds).alias("kind"))


def type_contradictions(e: DataFrame, shortest: int = 5) -> DataFrame:
    """Norms that have two types or more."""
    g = e.where(F.length("norm") >= shortest).groupBy("norm").agg(F.array_sort(F.collect_set("type")).alias("types"))
    return g.where(F.size("types") >= 2).select("norm", F.concat_ws(" AND ", "types").alias("types"))


def without_known(new: DataFrame, known: DataFrame) -> DataFrame:
    """Idempotent insert: rows whose unordered pair and kind are not known yet."""
    key = lambda df: df.withColumns({"_l": F.least("a", "b"), "_h": F.greatest("a", "b")})
    return key(new).join(key(known).select("_l", "_h", "kind"), ["_l", "_h", "kind"], "left_anti").drop("_l", "_h")


def gaps(counts: Column | DataFrame) -> DataFrame:
    """Gap rules over one row of counts: rule, severity and number of those that apply."""
    c = F.col
    rules = [
        ("missing_bank_source", "high", (c("txns") > 0) & (c("bank_files") == 0), c("txns")),
        ("missing_cdr", "high", (c("phones") > 0) & (c("cdr_files") == 0), c("phones")),
        ("missing_id_document", "medium", (c("persons") > 0) & (c("id_files") == 0), c("persons")),
        ("missing_chat_source", "medium", (c("comms") > 0) & (c("chat_files") == 0) & (c("cdr_files") == 0), c("comms")),
        ("ocr_required", "medium", c("screenshots") > 0, c("screenshots")),
        ("unlinked_entities", None, c("unlinked") > 0, c("unlinked")),
        ("thin_evidence", "medium", c("thin") > 0, c("thin")),
        ("open_contradictions", "high", c("contradictions") > 0, c("contradictions")),
        ("unverified_hypotheses", "medium", c("unverified") > 0, c("unverified")),
        ("missing_references", "low", (c("txns") > 0) & (c("no_utr") / c("txns") > 0.2), c("no_utr")),
        ("missing_timestamps", "low", (c("comms") > 0) & (c("no_ts") / c("comms") > 0.3), c("no_ts")),
    ]
    rows = F.array(
        *[
            F.when(hit, F.struct(F.lit(name).alias("rule"), (F.lit(sev) if sev else F.when(n > 20, "high").otherwise("medium")).alias("severity"), n.cast("long").alias("n")))
            for name, sev, hit, n in rules
        ]
    )
    return counts.select("case_id", F.explode(F.array_compact(rows)).alias("g")).select("case_id", "g.*")


#: How much a class of source is worth.
SOURCE_QUALITY = {
    "bank_statement": 1.0, "fir": 0.95, "cdr": 0.9, "court_document": 0.9, "contract": 0.85, "invoice": 0.8, "property_document": 0.85,
    "id_document": 0.9, "ledger": 0.8, "whatsapp_chat": 0.7, "email": 0.7, "travel_record": 0.75, "medical_record": 0.75, "receipt": 0.65,
    "social_media": 0.5, "screenshot": 0.45, "other": 0.5,
}


def source_quality(kind: Column) -> Column:
    out = F.lit(0.5)
    for name, value in SOURCE_QUALITY.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def band(score: Column) -> Column:
    return F.when(score >= 75, "strong").when(score >= 50, "sufficient").when(score >= 25, "partial").otherwise("insufficient")


def sufficiency(sources: Column, quality: Column, corroboration: Column, provenance: Column, contradictions: Column) -> Column:
    """Score 0 to 100 from the parts; no source has quality 0.25."""
    s = F.when(sources == 0, 0.0).when(sources == 1, 0.3).when(sources == 2, 0.6).when(sources == 3, 0.8).otherwise(1.0)
    q = F.coalesce(quality, F.lit(0.25))
    penalty = F.least(F.lit(0.4), 0.15 * contradictions)
    raw = 100 * (0.3 * s + 0.25 * q + 0.2 * corroboration + 0.15 * provenance + 0.1) * (1 - penalty)
    return F.greatest(F.lit(0), F.least(F.lit(100), half_up(F.round(raw, 6)))).cast("int")


def contract_status(contradicting: Column, sources: Column, score: Column) -> Column:
    return (
        F.when((contradicting > 0) & (score < 50), "unresolved")
        .when((contradicting > 0) & (sources >= 2), "partial")
        .when((sources >= 2) & (score >= 50), "corroborated")
        .when(sources == 1, "unresolved")
        .when(score >= 25, "partial")
        .otherwise("unresolved")
    )


def duplicate_candidates(e: DataFrame) -> DataFrame:
    """Pairs of one case that may be the same: a norm shared across types (0.85), person names two edits apart (0.6)."""
    b = e.select("case_id", F.col("id").alias("b"), F.col("type").alias("type_b"), F.col("norm").alias("norm_b"), F.col("value").alias("value_b"))
    same = e.join(b, (e.case_id == b.case_id) & (e.norm == b.norm_b)).where("id < b AND type <> type_b").select("id", "b", F.lit(0.85).alias("confidence"))
    near = near_pairs(e.where("type = 'person'"), "case_id", "value", "id", 2).select(F.col("a").alias("id"), "b", F.lit(0.6).alias("confidence"))
    return same.unionByName(near).groupBy(F.col("id").alias("a"), "b").agg(F.max("confidence").alias("confidence"))


def merge_court(votes: DataFrame) -> DataFrame:
    """Types of keys by vote (key, type, det, confidence): a deterministic vote counts 5, a sighting 1, or 1.5 from 0.8 up.

    Confirmed with a deterministic vote, two sightings or a mean confidence of 0.8; in conflict where
    another type than the winner has more than 5.
    """
    v = votes.withColumn("w", F.when(F.col("det"), 5.0).when(F.coalesce("confidence", F.lit(0.7)) >= 0.8, 1.5).otherwise(1.0))
    g = v.groupBy("key", "type").agg(F.sum("w").alias("w"), F.max("det").alias("det"), F.count_if(~F.col("det")).alias("seen"), F.avg(F.coalesce("confidence", F.lit(0.7))).alias("mean"))
    w = Window.partitionBy("key").orderBy(F.desc("w"), "type")
    r = g.withColumns({"k": F.row_number().over(w), "rival": F.lead("w").over(w)})
    return r.where("k = 1").select(
        "key", "type", F.round("w", 4).alias("weight"),
        (F.col("det") | (F.col("seen") >= 2) | (F.col("mean") >= 0.8)).alias("confirmed"), F.coalesce(F.col("rival") > 5, F.lit(False)).alias("conflict"),
    )


def wire_edges(rows: DataFrame, directed: bool) -> DataFrame:
    """Accumulate edge rows (source, target, type, row_id): weights add up; records fold both directions into the earlier."""
    if directed:
        return rows.where("source <> target").groupBy("source", "target", "type").agg(F.count(F.lit(1)).alias("weight"))
    g = rows.where("source <> target").groupBy(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi"), "type").agg(
        F.count(F.lit(1)).alias("weight"), F.min(F.struct("row_id", "source", "target")).alias("first")
    )
    return g.select(F.col("first.source").alias("source"), F.col("first.target").alias("target"), "type", "weight")


def remap(e: DataFrame, mapping: DataFrame) -> DataFrame:
    """Re-point edges to survivors (old, new), drop what becomes a loop and add up what becomes equal."""
    a, b = (mapping.select(F.col("old").alias(x), F.col("new").alias(f"{x}_new")) for x in ("source", "target"))
    m = e.join(a, "source", "left").join(b, "target", "left").select(
        F.coalesce("source_new", "source").alias("source"), F.coalesce("target_new", "target").alias("target"), "weight"
    )
    return m.where("source <> target").groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "id", rank: str = "rank") -> DataFrame:
    """Added, removed and moved keys between two snapshots (key, rank)."""
    j = old.select(key, F.col(rank).alias("r0")).join(new.select(key, F.col(rank).alias("r1")), key, "full")
    change = F.when(F.col("r0").isNull(), "added").when(F.col("r1").isNull(), "removed").otherwise("moved")
    return j.where("r0 IS NULL OR r1 IS NULL OR r0 <> r1").select(key, change.alias("change"), (F.col("r0") - F.col("r1")).alias("rise"))


def firewall(tables: dict[str, DataFrame], case_id: str) -> DataFrame:
    """Rows checked and blocked of each table for a case."""
    parts = [df.agg(F.count(F.lit(1)).alias("checked"), F.count_if(~F.col("case_id").eqNullSafe(case_id)).alias("blocked")).select(F.lit(n).alias("kind"), "checked", "blocked") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


# Queries


@query("c01_collisions", f"WITH {ENTITIES} SELECT type, norm, count(DISTINCT case_id) AS cases, count(*) AS n FROM n WHERE length(norm) >= 4 GROUP BY 1, 2 HAVING count(DISTINCT case_id) >= 2")
def c01(spark: SparkSession, d: str) -> DataFrame:
    return collisions(entities(spark, d))


_REFS = TX + """, u AS (SELECT concat('REF', id // 3) AS utr, id, amount, CASE WHEN id % 3 = 1 THEN receiver ELSE sender END AS sender,
  CASE WHEN id % 3 = 1 THEN sender ELSE receiver END AS receiver, us FROM t)"""


def _refs(spark, d):
    t = transactions(spark, d)
    swap = F.col("id") % 3 == 1
    return t.select(
        F.concat(F.lit("REF"), F.floor(F.col("id") / 3).cast("string")).alias("utr"), "id", "amount",
        F.when(swap, F.col("receiver")).otherwise(F.col("sender")).alias("sender"), F.when(swap, F.col("sender")).otherwise(F.col("receiver")).alias("receiver"), "us",
    )


_C02 = f"""WITH {_REFS}, p AS (SELECT a.utr, a.id AS a, b.id AS b, a.amount AS x, b.amount AS y, a.sender = b.receiver AND a.receiver = b.sender AS swapped,
  floor(abs(a.us - b.us) / 86400000000.0 + 0.5) AS days FROM u a JOIN u b ON a.utr = b.utr AND a.id < b.id WHERE length(a.utr) >= 4),
k AS (SELECT utr, a, b, 'amount' AS kind FROM p WHERE abs(x - y) > 1 AND abs(x - y) > 0.005 * greatest(abs(x), abs(y))
  UNION ALL SELECT utr, a, b, 'direction' FROM p WHERE swapped UNION ALL SELECT utr, a, b, 'date' FROM p WHERE days > 1)"""


@query("c02_reference_contradictions", _C02 + " SELECT * FROM k")
def c02(spark, d):
    return reference_contradictions(_refs(spark, d))


@query("c02_type_contradictions", f"WITH {ENTITIES} SELECT norm, string_agg(DISTINCT type, ' AND ' ORDER BY type) AS types FROM n WHERE length(norm) >= 5 GROUP BY 1 HAVING count(DISTINCT type) >= 2")
def c02_types(spark, d):
    return type_contradictions(entities(spark, d))


@query("c02_idempotent", _C02 + " SELECT * FROM k WHERE NOT (a % 2 = 0)")
def c02_known(spark, d):
    k = reference_contradictions(_refs(spark, d))
    return without_known(k, k.where("a % 2 = 0").select(F.col("b").alias("a"), F.col("a").alias("b"), "kind")).select("utr", "a", "b", "kind")


_C04 = """WITH c AS (SELECT lang AS case_id, count(*) AS txns, count(*) FILTER (WHERE doc_id % 7 = 0) AS phones, count(*) FILTER (WHERE n_chars > 5000) AS unlinked,
  count(*) FILTER (WHERE doc_id % 4 = 0) AS no_utr FROM documents GROUP BY 1)
SELECT case_id, 'missing_bank_source' AS rule, 'high' AS severity, txns AS n FROM c WHERE txns > 0
UNION ALL SELECT case_id, 'missing_cdr', 'high', phones FROM c WHERE phones > 0
UNION ALL SELECT case_id, 'unlinked_entities', CASE WHEN unlinked > 20 THEN 'high' ELSE 'medium' END, unlinked FROM c WHERE unlinked > 0
UNION ALL SELECT case_id, 'missing_references', 'low', no_utr FROM c WHERE no_utr / txns > 0.2"""


@query("c04_gaps", _C04)
def c04(spark, d):
    zero = {x: F.lit(0) for x in "bank_files cdr_files persons id_files comms chat_files screenshots thin contradictions unverified no_ts".split()}
    c = table(spark, d, "documents").groupBy(F.col("lang").alias("case_id")).agg(
        F.count(F.lit(1)).alias("txns"), F.count_if(F.col("doc_id") % 7 == 0).alias("phones"), F.count_if(F.col("n_chars") > 5000).alias("unlinked"), F.count_if(F.col("doc_id") % 4 == 0).alias("no_utr")
    )
    return gaps(c.withColumns(zero))


@query(
    "c05_snapshot_diff",
    f"""WITH {TX}, a AS (SELECT sender AS id, rank() OVER (ORDER BY count(*) DESC) AS r0 FROM t WHERE day < '2024-01-15' GROUP BY 1),
b AS (SELECT sender AS id, rank() OVER (ORDER BY count(*) DESC) AS r1 FROM t WHERE day >= '2024-01-15' GROUP BY 1)
SELECT id, CASE WHEN r0 IS NULL THEN 'added' WHEN r1 IS NULL THEN 'removed' ELSE 'moved' END AS change, r0 - r1 AS rise FROM a FULL JOIN b USING (id)
WHERE r0 IS NULL OR r1 IS NULL OR r0 <> r1""",
)
def c05(spark, d):
    t = transactions(spark, d)
    rank = lambda c: t.where(c).groupBy(F.col("sender").alias("id")).agg(F.count(F.lit(1)).alias("n")).select("id", F.rank().over(Window.orderBy(F.desc("n"))).cast("long").alias("rank"))
    return snapshot_diff(rank("day < '2024-01-15'"), rank("day >= '2024-01-15'"))


_C06 = """WITH b AS (SELECT o_orderkey, o_custkey % 6 AS s, (o_orderkey % 5) / 4.0 AS q, (o_orderkey % 3) / 2.0 AS cor, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0.7 ELSE 0.3 END AS p, o_custkey % 4 AS k FROM orders),
r AS (SELECT *, round(100 * (0.3 * (CASE s WHEN 0 THEN 0 WHEN 1 THEN 0.3 WHEN 2 THEN 0.6 WHEN 3 THEN 0.8 ELSE 1 END)::DOUBLE + 0.25 * (CASE WHEN s = 0 THEN 0.25 ELSE q END)::DOUBLE + 0.2 * cor::DOUBLE + 0.15 * p::DOUBLE + 0.1::DOUBLE) * (1 - least(0.4, 0.15 * k)::DOUBLE), 6) AS raw FROM b),
f AS (SELECT o_orderkey, s, k, CAST(greatest(0, least(100, floor(raw + 0.5))) AS INTEGER) AS score FROM r)
SELECT o_orderkey, score, CASE WHEN score >= 75 THEN 'strong' WHEN score >= 50 THEN 'sufficient' WHEN score >= 25 THEN 'partial' ELSE 'insufficient' END AS band,
  CASE WHEN k > 0 AND score < 50 THEN 'unresolved' WHEN k > 0 AND s >= 2 THEN 'partial' WHEN s >= 2 AND score >= 50 THEN 'corroborated' WHEN s = 1 THEN 'unresolved'
    WHEN score >= 25 THEN 'partial' ELSE 'unresolved' END AS status FROM f"""


@query("c06_sufficiency", _C06)
def c06(spark, d):
    o = table(spark, d, "orders")
    s, k, m = F.col("o_custkey") % 6, F.col("o_custkey") % 4, F.col("o_orderkey") % 3
    quality = F.when(s == 0, F.lit(None)).otherwise((F.col("o_orderkey") % 5) / 4)
    score = sufficiency(s, quality, m / 2, F.when(m == 0, 1.0).when(m == 1, 0.7).otherwise(0.3), k)
    return o.select("o_orderkey", s.alias("s"), k.alias("k"), score.alias("score")).select("o_orderkey", "score", band(F.col("score")).alias("band"), contract_status(F.col("k"), F.col("s"), F.col("score")).alias("status"))


@query("c12_decisions", "SELECT o_orderkey, concat('DEC-', lpad(CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS VARCHAR), 6, '0')) AS uid FROM orders")
def c12(spark, d):
    """Sequential record ids within a case."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("DEC-"), F.lpad(F.row_number().over(w).cast("string"), 6, "0")).alias("uid"))


@query("c14_firewall", f"WITH {ENTITIES} SELECT 'entities' AS kind, count(*) AS checked, count(*) FILTER (WHERE case_id <> 'ASIA') AS blocked FROM n")
def c14(spark, d):
    return firewall({"entities": entities(spark, d)}, "ASIA")


@query(
    "e02_wire_records",
    f"""WITH {TX}, g AS (SELECT least(sender, receiver) AS lo, greatest(sender, receiver) AS hi, count(*) AS weight, min(id) AS first FROM t WHERE sender <> receiver GROUP BY 1, 2)
SELECT sender AS source, receiver AS target, 'TRANSFERRED_TO' AS type, weight FROM g JOIN t ON t.id = first""",
)
def e02(spark, d):
    rows = transactions(spark, d).select(F.col("sender").alias("source"), F.col("receiver").alias("target"), F.lit("TRANSFERRED_TO").alias("type"), F.col("id").alias("row_id"))
    return wire_edges(rows, directed=False)


@query("e02_wire_table", f"WITH {TX} SELECT sender AS source, receiver AS target, kind AS type, count(*) AS weight FROM t WHERE sender <> receiver GROUP BY 1, 2, 3")
def e02_table(spark, d):
    rows = transactions(spark, d).select(F.col("sender").alias("source"), F.col("receiver").alias("target"), F.col("kind").alias("type"), F.col("id").alias("row_id"))
    return wire_edges(rows, directed=True)


@query(
    "e06_merge_court",
    """WITH v AS (SELECT user_id AS key, event_type AS type, event_id % 40 = 0 AS det, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 10) / 10.0::DOUBLE END AS confidence FROM events),
g AS (SELECT key, type, sum(CASE WHEN det THEN 5 WHEN coalesce(confidence, 0.7) >= 0.8 THEN 1.5 ELSE 1 END)::DOUBLE AS w, max(det) AS det, count(*) FILTER (WHERE NOT det) AS seen, avg(coalesce(confidence, 0.7)) AS mean FROM v GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER x AS k, lead(w) OVER x AS rival FROM g WINDOW x AS (PARTITION BY key ORDER BY w DESC, type))
SELECT key, type, round(w, 4) AS weight, det OR seen >= 2 OR mean >= 0.8 AS confirmed, coalesce(rival > 5, false) AS conflict FROM r WHERE k = 1""",
)
def e06(spark, d):
    v = table(spark, d, "events").select(
        F.col("user_id").alias("key"), F.col("event_type").alias("type"), (F.col("event_id") % 40 == 0).alias("det"),
        F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 10) / 10).alias("confidence"),
    )
    return merge_court(v)


@query(
    "e11_duplicates",
    f"""WITH {ENTITIES}, p AS (SELECT a.id AS a, b.id AS b, 0.85::DOUBLE AS c FROM n a JOIN n b ON a.case_id = b.case_id AND a.norm = b.norm AND a.id < b.id AND a.type <> b.type
  UNION ALL SELECT a.id, b.id, 0.6 FROM n a JOIN n b ON a.case_id = b.case_id AND a.id < b.id AND a.type = 'person' AND b.type = 'person' AND levenshtein(a.value, b.value) <= 2)
SELECT a, b, max(c) AS confidence FROM p GROUP BY 1, 2""",
)
def e11(spark, d):
    return duplicate_candidates(entities(spark, d))


@query(
    "e12_merge",
    f"WITH {TX}, m AS (SELECT concat('U', i) AS old, concat('U', i - 1) AS new FROM range(1, 150, 2) r(i)), e AS (SELECT coalesce(a.new, sender) AS source, coalesce(b.new, receiver) AS target FROM t LEFT JOIN m a ON a.old = sender LEFT JOIN m b ON b.old = receiver WHERE sender <> receiver) SELECT source, target, count(*) AS weight FROM e WHERE source <> target GROUP BY 1, 2",
)
def e12(spark, d):
    m = spark.range(1, 150, 2).select(F.concat(F.lit("U"), F.col("id").cast("string")).alias("old"), F.concat(F.lit("U"), (F.col("id") - 1).cast("string")).alias("new"))
    return remap(edges(spark, d).select("source", "target", "weight"), m)


@query("e15_backfill", f"WITH {ENTITIES}, {LINKS} SELECT entity_id, evidence_id FROM k WHERE entity_id IN (SELECT id FROM n) AND NOT evidence_id % 2 = 0")
def e15(spark, d):
    """Observations that links imply and the ledger lacks."""
    return _backfill(spark, d, links(spark, d))


def _backfill(spark: SparkSession, d: str, k: DataFrame) -> DataFrame:
    n = entities(spark, d).select(F.col("id").alias("entity_id"))
    known = k.where("evidence_id % 2 = 0")
    return k.join(n, "entity_id", "left_semi").join(known, ["entity_id", "evidence_id"], "left_anti")


@query("e16_promote", f"WITH {ENTITIES}, {LINKS}, c AS (SELECT entity_id FROM k GROUP BY 1 HAVING count(*) >= 12) SELECT id, CASE WHEN id IN (SELECT entity_id FROM c) THEN 'confirmed' ELSE status END AS status FROM n")
def e16(spark, d):
    c = links(spark, d).groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n >= 12")
    return entities(spark, d).join(c, "id", "left").select("id", F.when(F.col("n").isNotNull(), "confirmed").otherwise(F.col("status")).alias("status"))
