"""Views for an investigator: explained connections and links, entity details, claims and the evidence matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.adapters import EDGES, ENTITIES, LINKS, TX, edges, entities, links, table, transactions
from .graph import enumerate_paths
from .patterns import high_fan

# How a relation is explained; others are "extracted".
SENTENCES = {
    "TRANSFERRED_TO": "A money transfer between the two is recorded in {}.", "COMMUNICATED_WITH": "A call/communication between the two is recorded in {}.",
    "CALLED": "A call/communication between the two is recorded in {}.", "SHARED_IDENTIFIER": "The two share an identifier across documents.",
    "CONTROLS_ACCOUNT": "The account is attributed to this actor in {}.", "LOCATED_AT": "The document places this actor/entity at this location.",
    "WORKS_FOR": "An employment/role link between the two is stated in {}.", "EMPLOYS": "An employment/role link between the two is stated in {}.",
    "DIRECTOR_OF": "A directorship between the two is stated in {}.", "AFFILIATED_WITH": "A membership/affiliation between the two is stated in {}.",
    "STUDIED_AT": "A membership/affiliation between the two is stated in {}.", "MEMBER_OF": "A membership/affiliation between the two is stated in {}.",
    "IDENTIFIED_BY": "{} identifies one entity as belonging to / describing the other (registration number, ID, attribute).",
    "ISSUED_BY": "The document/certificate was issued by this authority per {}.", "SIGNED_BY": "The document was signed by this person per {}.",
    "AUTHORIZED_BY": "The action/document was authorized by this person per {}.", "RECOMMENDS": "A recommendation between the two is made in {}.",
    "RELATED_TO": "A personal/family relationship between the two is stated in {}.", "USED_VEHICLE": "The vehicle is linked to this actor in {}.",
}
ORIGINS = {
    "ai-story": "Connection inferred by the AI story engine from the document narrative.",
    "ai-crosslink": "Connection inferred across separate evidence files by the AI cross-link engine.",
    "alias-resolution": "Connection created by identity/alias resolution.",
}
EXCERPTS, AROUND, FILES = 3, 170, 3


def why_connected(relation: Column, reference: Column, shared: Column, origin: Column, weight: Column, distance: Column) -> Column:
    """A sentence or two on why two entities are connected; nulls are left out."""
    ref = F.coalesce(F.concat(F.lit('"'), reference, F.lit('"')), F.lit("the source document"))
    near = F.concat(F.lit("Both values appear in the same passage of "), ref, F.coalesce(F.concat(F.lit(" ("), distance.cast("string"), F.lit(" chars apart)")), F.lit("")), F.lit("."))
    again = F.when(weight > 1, F.concat(F.lit("The pair was re-observed across "), weight.cast("string"), F.lit(" scan passes/documents.")))
    together = (relation == "CO_OCCURRED") | F.coalesce(origin, F.lit("")).contains("co-occurrence")
    known = F.lit(None).cast("string")
    for name, sentence in SENTENCES.items():
        before, _, after = sentence.partition("{}")
        known = F.when(relation == name, F.concat(F.lit(before), ref, F.lit(after)) if "{}" in sentence else F.lit(sentence)).otherwise(known)
    first = F.coalesce(known, F.when(together, F.concat_ws(" ", near, again)), F.concat(F.lit("This relationship was extracted from "), ref, F.lit(".")))
    files = F.when(shared > 1, F.concat(shared.cast("string"), F.lit(" evidence files mention both endpoints.")))
    last = F.lit(None).cast("string")
    for name, sentence in ORIGINS.items():
        last = F.when(origin == name, sentence).otherwise(last)
    return F.concat_ws(" ", first, files, last)


def hop_state(evidence: Column, origin: Column) -> Column:
    """A hop is corroborated by two pieces of evidence, inferred by a cross link, else observed."""
    return F.when(evidence >= 2, "corroborated").when(origin == "ai-crosslink", "inferred").otherwise("observed")


def explain_connection(e: DataFrame, evidence: DataFrame, start: str, goal: str, most_hops: int = 5) -> DataFrame:
    """path, hop (from 1), a, b, evidence and state of each hop of up to four paths; ``evidence`` has a, b, evidence_id, origin."""
    paths = enumerate_paths(e, start, goal, most_hops=most_hops)
    hops = paths.select(F.array_join("path", ">").alias("path"), F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.expr("slice(path, 2, size(path) - 1)").alias("b"))).alias("k", "h"))
    hops = hops.select("path", (F.col("k") + 1).alias("hop"), F.col("h.a").alias("a"), F.col("h.b").alias("b"))
    both = evidence.select("a", "b", "evidence_id", "origin").unionByName(evidence.select(F.col("b").alias("a"), F.col("a").alias("b"), "evidence_id", "origin"))
    g = hops.join(both, ["a", "b"], "left").groupBy("path", "hop", "a", "b").agg(F.countDistinct("evidence_id").alias("evidence"), F.min("origin").alias("origin"))
    return g.select("path", "hop", "a", "b", "evidence", hop_state(F.col("evidence"), F.col("origin")).alias("state"))


def link_rows(t: DataFrame, a: str, b: str) -> DataFrame:
    """The transactions between two accounts, either way, with their direction."""
    way = F.when((F.col("sender") == a) & (F.col("receiver") == b), "forward").when((F.col("sender") == b) & (F.col("receiver") == a), "backward")
    return t.withColumn("way", way).where("way IS NOT NULL")


def shared_evidence(k: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, shared: how many pieces of evidence name both ends of each pair (a, b)."""
    left = pairs.join(k.select(F.col("entity_id").alias("a"), "evidence_id"), "a")
    met = left.join(k.select(F.col("entity_id").alias("b"), "evidence_id"), ["b", "evidence_id"])
    return pairs.join(met.groupBy("a", "b").agg(F.countDistinct("evidence_id").alias("shared")), ["a", "b"], "left").fillna(0, "shared")


def excerpts(docs: DataFrame, id_column: str, a: str, b: str, files: int = FILES) -> DataFrame:
    """Up to three windows of 170 characters around the first places of either value, of the first ``files`` documents that hold both."""
    from .planning import places

    pa, pb = places(F.col("text"), F.lit(a)), places(F.col("text"), F.lit(b))
    rows = docs.select(id_column, "text", F.slice(pa, 1, 2).alias("pa"), F.slice(pb, 1, 2).alias("pb")).where("size(pa) > 0 AND size(pb) > 0")
    rows = rows.orderBy(id_column).limit(files)
    cut = lambda at: F.trim(F.regexp_replace(F.col("text").substr(F.greatest(at - AROUND, F.lit(0)) + 1, at + AROUND - F.greatest(at - AROUND, F.lit(0))), r"\s+", " "))
    return rows.select(id_column, F.transform(F.slice(F.concat("pa", "pb"), 1, EXCERPTS), cut).alias("snippets"))


def entity_details(t: DataFrame, findings: DataFrame) -> DataFrame:
    """A row for each account: neighbours, transactions and volume each way, first and last day, findings and their worst grade."""
    side = lambda me, other, sign: t.select(
        F.col(me).alias("id"), F.col(other).alias("other"), F.lit(sign).alias("way"), "amount", "day"
    )
    rows = side("sender", "receiver", "out").unionByName(side("receiver", "sender", "in"))
    out, into = F.col("way") == "out", F.col("way") == "in"
    g = rows.groupBy("id").agg(
        F.countDistinct(F.when(F.col("other") != F.col("id"), F.col("other"))).alias("neighbours"), F.count(F.when(out, 1)).alias("sent"), F.count(F.when(into, 1)).alias("received"),
        F.coalesce(F.sum(F.when(out, F.col("amount"))), F.lit(0.0)).alias("paid"), F.coalesce(F.sum(F.when(into, F.col("amount"))), F.lit(0.0)).alias("got"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
    )
    f = findings.groupBy(F.col("subject").alias("id")).agg(F.count(F.lit(1)).alias("findings"), F.min("severity").alias("worst"))
    return g.join(f, "id", "left").fillna(0, "findings")


def claim_ladder(observations: DataFrame, findings: DataFrame, manual: DataFrame) -> DataFrame:
    """level, id, status and sources of a case's claims, from evidence up.

    ``observations``: id, evidence (array); ``findings``: id, decision, sufficiency, sources; ``manual``: id, status, sources.
    Evidence is verified; an observation is verified by evidence; a finding by an approval and a sufficiency of 50; such
    findings become claims of their own.
    """
    none = F.array().cast("array<string>")
    row = lambda df, level, mark, id_, status, sources: df.select(F.lit(level).alias("level"), F.concat(F.lit(mark), id_).alias("id"), status.alias("status"), sources.alias("sources"))
    base = observations.select(F.explode("evidence").alias("e")).distinct()
    ev = row(base, "evidence", "ev-", F.col("e"), F.lit("verified"), none)
    ob = row(observations, "observation", "ob-", F.col("id"), F.when(F.size("evidence") > 0, "verified").otherwise("unsupported"), F.transform("evidence", lambda x: F.concat(F.lit("ev-"), x)))
    solid = (F.col("decision") == "approved") & (F.col("sufficiency") >= 50)
    status = F.when(F.col("decision") == "rejected", "rejected").when(solid, "verified").otherwise("supported")
    fi = row(findings, "finding", "fi-", F.col("id"), status, F.coalesce("sources", none))
    auto = row(findings.where(solid), "claim", "cl-auto-", F.col("id"), F.lit("verified"), F.array(F.concat(F.lit("fi-"), F.col("id"))))
    cl = row(manual, "claim", "cl-", F.col("id"), F.coalesce("status", F.lit("unsupported")), F.coalesce("sources", none))
    return ev.unionByName(ob).unionByName(fi).unionByName(auto).unionByName(cl)


def report_ready(ladder: DataFrame) -> DataFrame:
    """One row: nodes by level, claims without support, and whether a report may be written."""
    bare = F.count(F.when((F.col("level") == "claim") & (F.col("status") == "unsupported"), 1))
    return ladder.agg(*[F.count(F.when(F.col("level") == x, 1)).alias(f"{x}s") for x in ("observation", "finding", "claim")], bare.alias("unsupported"), (bare == 0).alias("ready"))


def attribution(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """id, account: an account's own value, and for others the values of the accounts next to them."""
    accounts = nodes.where(F.col("type").isin("account", "bank_account", "wallet"))
    both = e.select(F.col("source").alias("id"), F.col("target").alias("other")).unionByName(e.select(F.col("target").alias("id"), F.col("source").alias("other"))).distinct()
    others = nodes.join(accounts.select("id"), "id", "left_anti").select("id")
    near = both.join(others, "id", "left_semi").join(accounts.select(F.col("id").alias("other"), F.col("value").alias("account")), "other")
    return accounts.select("id", F.col("value").alias("account")).unionByName(near.select("id", "account")).distinct()


def top_share(values: DataFrame, value: str, share: float) -> DataFrame:
    """The rows among the highest ``share`` of the values, one at least; equal values go by id.

    The number that ranks before is counted by value first, so no task sorts all rows.
    """
    sizes = values.groupBy(value).agg(F.count(F.lit(1)).alias("n_"))
    total = values.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * share)).alias("keep_"))  # one row
    before = sizes.withColumn("before_", F.coalesce(F.sum("n_").over(Window.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = values.join(before, value).join(F.broadcast(total)).where("before_ < keep_")
    place = F.row_number().over(Window.partitionBy(value).orderBy("id")) + F.col("before_")
    return rows.withColumn("place_", place).where("place_ <= keep_").drop("n_", "keep_", "before_", "place_")


def matrix(evidence: DataFrame, claims: DataFrame, cited: DataFrame, against: DataFrame, mentions: DataFrame, concerns: DataFrame) -> DataFrame:
    """evidence_id, claim_id and cell: contradicts before supports before shared; pairs with none are left out.

    ``cited`` and ``against`` are (evidence_id, claim_id); ``mentions`` (evidence_id, entity_id) and ``concerns``
    (claim_id, entity_id) give the shared entities.  Only pairs that something joins are made.
    """
    shared = mentions.join(concerns, "entity_id").select("evidence_id", "claim_id", F.lit(2).alias("k"))
    rows = against.withColumn("k", F.lit(0)).unionByName(cited.withColumn("k", F.lit(1))).unionByName(shared)
    g = rows.join(evidence, "evidence_id", "left_semi").join(claims, "claim_id", "left_semi").groupBy("evidence_id", "claim_id").agg(F.min("k").alias("k"))
    return g.select("evidence_id", "claim_id", F.element_at(F.array(F.lit("contradicts"), F.lit("supports"), F.lit("shared")), F.col("k") + 1).alias("cell"))


_HOPS2 = """u AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e), p AS (SELECT ['U3', x.b, 'U140'] AS path FROM u x JOIN u y ON y.a = x.b AND y.b = 'U140' WHERE x.a = 'U3' AND x.b NOT IN ('U3', 'U140')
  UNION ALL SELECT ['U3', 'U140'] FROM u WHERE a = 'U3' AND b = 'U140'), q AS (SELECT path FROM p ORDER BY len(path), path LIMIT 4),
h AS (SELECT array_to_string(path, '>') AS path, i AS hop, path[i] AS a, path[i + 1] AS b FROM q, LATERAL (SELECT unnest(range(1, len(path))) AS i) z)"""


@query(
    "g24_explain_connection",
    "WITH " + EDGES + ", " + _HOPS2 + """ SELECT path, CAST(hop AS INTEGER) AS hop, a, b, count(DISTINCT t.id) AS evidence, CASE WHEN count(DISTINCT t.id) >= 2 THEN 'corroborated' ELSE 'observed' END AS state
FROM h LEFT JOIN t ON (t.sender = a AND t.receiver = b) OR (t.sender = b AND t.receiver = a) GROUP BY 1, 2, 3, 4""",
)
def g24(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    proof = t.select(F.col("sender").alias("a"), F.col("receiver").alias("b"), F.col("id").alias("evidence_id"), F.lit("record").alias("origin"))
    return explain_connection(edges(spark, d), proof, "U3", "U140", 2)


@query("g25_link_rows", "WITH " + TX + ", m AS (SELECT sender AS a, receiver AS b FROM t WHERE sender <> receiver GROUP BY 1, 2 ORDER BY count(*) DESC, 1, 2 LIMIT 1) SELECT t.id, amount, CASE WHEN sender = a THEN 'forward' ELSE 'backward' END AS way FROM t, m WHERE (sender = a AND receiver = b) OR (sender = b AND receiver = a)")
def g25(spark, d):
    """The rows between the pair with the most transfers."""
    t = transactions(spark, d)
    top = t.where("sender <> receiver").groupBy("sender", "receiver").count().orderBy(F.desc("count"), "sender", "receiver").first()
    return link_rows(t, top.sender, top.receiver).select("id", "amount", "way")


@query(
    "g25_shared_evidence",
    "WITH " + LINKS + """, p AS (SELECT concat('C', o_custkey) AS a, concat('S', l_suppkey) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1 GROUP BY 1, 2)
SELECT a, b, count(DISTINCT x.evidence_id) AS shared FROM p JOIN k x ON x.entity_id = a JOIN k y ON y.entity_id = b AND y.evidence_id = x.evidence_id GROUP BY 1, 2""",
)
def g25_shared(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "lineitem").where("l_linenumber = 1"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = o.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("a"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("b")).distinct()
    return shared_evidence(links(spark, d), pairs)


@query("g25_excerpts", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and') ORDER BY doc_id LIMIT 3")
def g25_excerpts(spark, d):
    rows = excerpts(table(spark, d, "documents"), "doc_id", "the", "and")
    ok = F.forall("snippets", lambda s: (F.length(s) <= 2 * AROUND) & (F.lower(s).contains("the") | F.lower(s).contains("and")))
    return rows.where(ok & F.size("snippets").between(1, EXCERPTS)).select("doc_id")


_FAN = "SELECT receiver AS subject, CASE WHEN count(DISTINCT sender) >= 10 THEN 'high' ELSE 'medium' END AS severity FROM t GROUP BY 1 HAVING count(DISTINCT sender) >= 5"


@query(
    "g28_entity_details",
    "WITH " + TX + f""", r AS (SELECT sender AS id, receiver AS other, 'out' AS way, amount, day FROM t UNION ALL SELECT receiver, sender, 'in', amount, day FROM t),
g AS (SELECT id, count(DISTINCT CASE WHEN other <> id THEN other END) AS neighbours, count(*) FILTER (WHERE way = 'out') AS sent, count(*) FILTER (WHERE way = 'in') AS received,
  round(coalesce(sum(amount) FILTER (WHERE way = 'out'), 0), 2) AS paid, round(coalesce(sum(amount) FILTER (WHERE way = 'in'), 0), 2) AS got, min(day) AS first_day, max(day) AS last_day FROM r GROUP BY 1),
f AS (SELECT subject AS id, count(*) AS findings, min(severity) AS worst FROM ({_FAN}) GROUP BY 1)
SELECT g.*, coalesce(findings, 0) AS findings, worst FROM g LEFT JOIN f USING (id)""",
)
def g28(spark, d):
    t = transactions(spark, d)
    rows = entity_details(t, high_fan(t, "in"))
    return rows.withColumn("paid", F.round("paid", 2)).withColumn("got", F.round("got", 2))


@query(
    "k02_attribution",
    "WITH " + LINKS + ", " + ENTITIES + """, y AS (SELECT id, CASE WHEN type = 'organization' THEN 'account' ELSE type END AS type, value FROM n),
e AS (SELECT DISTINCT p.entity_id AS a, q.entity_id AS b FROM k p JOIN k q ON p.evidence_id = q.evidence_id WHERE p.entity_id LIKE 'C%' AND q.entity_id LIKE 'S%')
SELECT id, value AS account FROM y WHERE type = 'account' UNION SELECT e.a, y.value FROM e JOIN y ON y.id = e.b JOIN y z ON z.id = e.a""",
)
def k02(spark, d):
    """Suppliers as accounts, customers as persons next to the suppliers of their orders."""
    n = entities(spark, d).select("id", F.when(F.col("type") == "organization", "account").otherwise(F.col("type")).alias("type"), "value")
    k = links(spark, d)
    person, account = k.where("entity_id LIKE 'C%'"), k.where("entity_id LIKE 'S%'")
    e = person.join(account.withColumnRenamed("entity_id", "target"), "evidence_id").select(F.col("entity_id").alias("source"), "target").distinct()
    return attribution(n, e)


@query(
    "k04_top_central",
    "WITH " + EDGES + """, g AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY 1)
SELECT id, degree FROM g QUALIFY row_number() OVER (ORDER BY degree DESC, id) <= greatest(1, ceil(count(*) OVER () * 0.2))""",
)
def k04(spark, d):
    g = edges(spark, d).select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return top_share(g, "degree", 0.2)


def _case(spark: SparkSession, d: str):
    """Observations from links, findings from fan-in with the real number of senders as sufficiency, claims by hand."""
    k = links(spark, d).where("entity_id LIKE 'S%'")
    ob = entities(spark, d).where("type = 'organization'").select("id").join(k, F.col("entity_id") == F.col("id"), "left").groupBy("id").agg(F.array_sort(F.collect_set(F.col("evidence_id").cast("string"))).alias("evidence"))
    g = transactions(spark, d).groupBy(F.col("receiver").alias("id")).agg(F.countDistinct("sender").alias("n"))
    fi = g.where("n >= 2").select("id", F.when(F.col("n") >= 3, "approved").otherwise("rejected").alias("decision"), (F.col("n") * 10).alias("sufficiency"), F.array(F.lit("ev-1")).alias("sources"))
    manual = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.lit(None).cast("string").alias("status"), F.array().cast("array<string>").alias("sources"))
    return ob, fi, manual


@query(
    "c08_claims",
    "WITH " + TX + ", " + ENTITIES + """, g AS (SELECT receiver AS id, count(DISTINCT sender) AS c FROM t GROUP BY 1 HAVING count(DISTINCT sender) >= 2), s AS (SELECT DISTINCT concat('S', l_suppkey) AS id, l_orderkey AS o FROM lineitem)
SELECT 'evidence' AS level, concat('ev-', o) AS id, 'verified' AS status FROM (SELECT DISTINCT o FROM s JOIN n USING (id))
UNION ALL SELECT 'observation', concat('ob-', id), CASE WHEN id IN (SELECT id FROM s) THEN 'verified' ELSE 'unsupported' END FROM n WHERE type = 'organization'
UNION ALL SELECT 'finding', concat('fi-', id), CASE WHEN c < 3 THEN 'rejected' WHEN c * 10 >= 50 THEN 'verified' ELSE 'supported' END FROM g
UNION ALL SELECT 'claim', concat('cl-auto-', id), 'verified' FROM g WHERE c >= 5 UNION ALL SELECT 'claim', concat('cl-', r_regionkey), 'unsupported' FROM region""",
)
def c08(spark, d):
    return claim_ladder(*_case(spark, d)).select("level", "id", "status")


@query("c08_report_ready", "SELECT 5 AS unsupported, false AS ready")
def c08_ready(spark, d):
    return report_ready(claim_ladder(*_case(spark, d))).select("unsupported", "ready")


@query(
    "c09_matrix",
    "WITH " + LINKS + """, c AS (SELECT s_suppkey AS claim_id, concat('S', s_suppkey) AS entity_id FROM supplier), x AS (SELECT l_orderkey AS evidence_id, l_suppkey AS claim_id, min(l_returnflag) AS low, max(l_returnflag) AS high FROM lineitem GROUP BY 1, 2)
SELECT k.evidence_id, c.claim_id, CASE WHEN high = 'R' THEN 'contradicts' WHEN low = 'A' THEN 'supports' ELSE 'shared' END AS cell FROM k JOIN c USING (entity_id) JOIN x ON x.evidence_id = k.evidence_id AND x.claim_id = c.claim_id""",
)
def c09(spark, d):
    """Orders as evidence and suppliers' deliveries as claims: returned lines contradict, accepted ones support."""
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("evidence_id"), F.col("l_suppkey").alias("claim_id"), "l_returnflag")
    pick = lambda flag: l.where(F.col("l_returnflag") == flag).select("evidence_id", "claim_id").distinct()
    concerns = table(spark, d, "supplier").select(F.col("s_suppkey").alias("claim_id"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("entity_id"))
    k = links(spark, d)
    return matrix(k.select("evidence_id").distinct(), concerns.select("claim_id"), pick("A"), pick("R"), k, concerns)


@query(
    "f40_why_connected",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat('A money transfer between the two is recorded in "order ', o_orderkey, '". 3 evidence files mention both endpoints.')
  WHEN 1 THEN 'Both values appear in the same passage of the source document (12 chars apart). The pair was re-observed across 2 scan passes/documents.'
  WHEN 2 THEN 'This relationship was extracted from the source document. Connection created by identity/alias resolution.' ELSE 'The two share an identifier across documents.' END AS why FROM orders""",
)
def f40(spark, d):
    k = F.col("o_orderkey") % 4
    why = why_connected(
        F.when(k == 0, "TRANSFERRED_TO").when(k == 1, "CO_OCCURRED").when(k == 2, "SOLD_TO").otherwise("SHARED_IDENTIFIER"), F.when(k == 0, F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))),
        F.when(k == 0, 3).otherwise(1), F.when(k == 2, "alias-resolution"), F.when(k == 1, 2).otherwise(1), F.when(k == 1, 12),
    )
    return table(spark, d, "orders").select("o_orderkey", why.alias("why"))
