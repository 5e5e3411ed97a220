"""Linking inside a case: reference stitching and pairs that occur close together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalize
from ..plans.lineage import cut
from ..plans.registry import query
from ..sources.adapters import EDGES, edges, table
from .graph import components
from .planning import cross_distance, places

# Types that say nothing, and types of people and of identifiers.
PLACEHOLDERS = "other document_id".split()
ANCHORS = "person organization".split()
IDENTIFIERS = "phone imei account ifsc upi email wallet mac device vehicle document_id ip url domain social aadhaar pan passport gstin".split()
WINDOW, IDENTIFIER_WINDOW = 420, 170


def stitch(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities with ``survivor``, relations re-pointed) of entities that share a reference token.

    ``entities`` has id, type, value, label, refs (array) and created; ``relations`` has source, target, type and weight.
    An entity's tokens are its references, and its value if that is one.  Of a group the entity with the best score
    stays: a real type and a real value count 2 each, a real label 0.5, ties to others up to 2; then the oldest.
    Relations of a group's members become the survivor's: equal ones add up their weights, those within a group go.
    """
    own = F.when(normalize.is_reference(F.col("value")), F.array("value")).otherwise(F.array().cast("array<string>"))
    tokens = entities.select("id", F.explode(F.array_union(F.coalesce("refs", F.array().cast("array<string>")), own)).alias("t"))
    # A token is a node of its own, so a token that very many share gives no pairs.
    links = tokens.select("id", F.concat(F.lit("\x00"), normalize.reference_key(F.col("t"))).alias("t")).distinct()
    nodes = links.select("id").unionByName(links.select(F.col("t").alias("id"))).distinct()
    parts = components(nodes, links.select(F.col("id").alias("source"), F.col("t").alias("target"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("amount")))
    degree = relations.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    real = lambda c: F.when(F.col(c).isNotNull() & ~normalize.is_reference(F.col(c)), 1).otherwise(0)
    score = (
        F.when(F.col("type").isin(PLACEHOLDERS), 0).otherwise(2) + 2 * real("value") + 0.5 * real("label")
        + F.least(F.lit(2.0), F.coalesce("degree", F.lit(0)) / 10)
    )
    marked = entities.join(parts, "id", "left").join(degree, "id", "left").withColumn("score", score).withColumn("part", F.coalesce("component", F.concat(F.lit("\x01"), "id")))
    best = marked.groupBy("part").agg(F.min(F.struct((-F.col("score")).alias("s"), "created", "id")).alias("b")).select("part", F.col("b.id").alias("survivor"))
    named = cut(marked.join(best, "part").select(*entities.columns, "survivor"))
    to = named.where("id <> survivor").select("id", "survivor")
    moved = relations
    for end in ("source", "target"):
        other = to.select(F.col("id").alias(end), F.col("survivor").alias("to_"))
        moved = moved.join(other, end, "left").withColumn(end, F.coalesce("to_", end)).drop("to_")
    return named, moved.where("source <> target").groupBy("source", "target", "type").agg(F.sum("weight").alias("weight"))


def close_pairs(docs: DataFrame, nodes: DataFrame, id_column: str, window: int = WINDOW, identifier_window: int = IDENTIFIER_WINDOW) -> DataFrame:
    """Pairs of a document's nodes (id, node, type, value) that occur within ``window`` characters of each other.

    Two identifiers must be within ``identifier_window``.  Gives a, b (a < b), distance, proximity and anchored.
    Only nodes in neighbouring stretches of the text are paired, so a long text does not give all its pairs.
    """
    at = nodes.dropDuplicates([id_column, "node"]).join(docs.select(id_column, "text"), id_column)
    at = at.select(id_column, "node", "type", F.explode(places(F.col("text"), F.trim("value"))).alias("at")).withColumn("cell", F.floor(F.col("at") / window))
    b = at.select(id_column, F.col("node").alias("b"), F.col("type").alias("tb"), F.col("at").alias("at_b"), F.explode(F.array(*[F.col("cell") + k for k in (-1, 0, 1)])).alias("cell"))
    met = at.withColumnsRenamed({"node": "a", "type": "ta"}).join(b, [id_column, "cell"]).where("a < b").withColumn("d", F.abs(F.col("at") - F.col("at_b"))).where(F.col("d") <= window)
    pairs = met.groupBy(id_column, "a", "b", "ta", "tb").agg(F.min("d").alias("distance"))
    anchored = F.col("ta").isin(ANCHORS) | F.col("tb").isin(ANCHORS)
    pairs = pairs.where(~(F.col("ta").isin(IDENTIFIERS) & F.col("tb").isin(IDENTIFIERS)) | (F.col("distance") <= identifier_window))
    return pairs.select(id_column, "a", "b", F.col("distance").cast("int").alias("distance"), F.greatest(F.lit(0.0), 1 - F.col("distance") / window).alias("proximity"), anchored.alias("anchored"))


def _registry(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Accounts twice: as typed register entries with a reference, and as bare references that relations name."""
    e = edges(spark, d)
    n = e.select(F.col("source").alias("u")).unionByName(e.select(F.col("target").alias("u"))).distinct()
    digits = F.substring("u", 2, 20)
    ref = F.concat(F.lit("per-"), F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), "0"))  # lpad alone would cut longer numbers
    entry = n.select(F.concat(F.lit("Z"), "u").alias("id"), F.lit("person").alias("type"), F.concat(F.lit("Holder of "), "u").alias("value"), F.lit(None).cast("string").alias("label"), F.array(ref).alias("refs"), F.lit(2).alias("created"))
    bare = n.select(F.concat(F.lit("A"), "u").alias("id"), F.lit("other").alias("type"), F.upper(ref).alias("value"), F.lit(None).cast("string").alias("label"), F.array().cast("array<string>").alias("refs"), F.lit(1).alias("created"))
    r = e.select(F.concat(F.lit("A"), "source").alias("source"), F.concat(F.when(F.col("weight") % 2 == 0, "A").otherwise("Z"), "target").alias("target"), F.lit("PAID").alias("type"), "weight")
    mirrored = e.select(F.concat(F.lit("Z"), "source").alias("source"), F.concat(F.lit("Z"), "target").alias("target"), F.lit("PAID").alias("type"), F.lit(1).cast("long").alias("weight"))
    same = n.select(F.concat(F.lit("A"), "u").alias("source"), F.concat(F.lit("Z"), "u").alias("target"), F.lit("SAME_AS").alias("type"), F.lit(1).cast("long").alias("weight"))
    return entry.unionByName(bare), r.unionByName(mirrored).unionByName(same)


@query("e10_survivors", "WITH " + EDGES + ", n AS (SELECT source AS u FROM e UNION SELECT target FROM e) SELECT concat(k, u) AS id, concat('Z', u) AS survivor FROM n, (VALUES ('A'), ('Z')) v(k)")
def e10(spark: SparkSession, d: str) -> DataFrame:
    return stitch(*_registry(spark, d))[0].select("id", "survivor")


@query("e10_relations", "WITH " + EDGES + " SELECT concat('Z', source) AS source, concat('Z', target) AS target, 'PAID' AS type, CAST(weight + 1 AS BIGINT) AS weight FROM e")
def e10_relations(spark, d):
    return stitch(*_registry(spark, d))[1].withColumn("weight", F.col("weight").cast("long"))


_WORDS = [("n1", "person", "the"), ("n2", "phone", "and"), ("n3", "email", "mail"), ("n4", "organization", "data"), ("n5", "account", "note")]


@query(
    "g26_close_pairs",
    "WITH w AS (SELECT * FROM (VALUES " + ", ".join(str(w) for w in _WORDS) + """) v(node, type, x)), p AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, node, type, list_sum(list_transform(s[1:k], lambda y: length(y))) + (k - 1) * length(x) AS i
  FROM (SELECT doc_id, node, type, x, string_split(t, x) AS s FROM p, w), LATERAL (SELECT unnest(range(1, least(25, len(s)))) AS k) q)
SELECT a.doc_id, a.node AS a, b.node AS b, CAST(min(abs(a.i - b.i)) AS INTEGER) AS distance, a.type IN ('person', 'organization') OR b.type IN ('person', 'organization') AS anchored
FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.node < b.node GROUP BY a.doc_id, a.node, b.node, a.type, b.type
HAVING min(abs(a.i - b.i)) <= CASE WHEN a.type IN ('phone', 'email', 'account') AND b.type IN ('phone', 'email', 'account') THEN 170 ELSE 420 END""",
)
def g26(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    listed = F.explode(F.array(*[F.struct(F.lit(n).alias("node"), F.lit(t).alias("type"), F.lit(v).alias("value")) for n, t, v in _WORDS])).alias("w")
    return close_pairs(docs, docs.select("doc_id", listed).select("doc_id", "w.*"), "doc_id").select("doc_id", "a", "b", "distance", "anchored")
