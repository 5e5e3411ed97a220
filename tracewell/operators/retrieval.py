"""Question routing and deterministic answers, retrieval of context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.adapters import ENTITIES, TX, entities, table, transactions

A, Z = "(?<![a-z0-9_])", "(?![a-z0-9_])"
#: Patterns of the routes in their order; the first that matches decides.
ROUTES = [
    ("ai", r"\b(who|whom)\b.*\??\s*$"),
    ("ai", r"^(who|what|tell me|explain|describe|summar[a-z0-9_]*|interpret|analy[sz]e)\b"),
    ("ai", r"\b(who is|who was|who are|what is this|tell me about|explain (this|the|why|how)|what does .{0,40} (mean|show|suggest)|summar[a-z0-9_]+ (this|the) (case|evidence|file|document))\b"),
    ("rules", r"\b(how many|count of|number of|total number|how much (money|amount)|total (amount|volume)|sum of)\b"),
    ("graph", r"\b(most central|centrality|hub|hubs|key player|key players|influential|betweenness|pagerank|bridge|broker|central actor)\b"),
    ("graph", r"\b(community|communities|cluster|clusters|group of)\b"),
    ("graph", r"\b(shortest path|path from|connected to|linked to|route between|does .* connect)\b"),
    ("rules", r"\b(circle|circular|round.tripping|layering|fan.in|fan.out|smurf)\b"),
    ("timeline", r"\b(when|what date|which date|timeline|chronolog|first transaction|last transaction)\b"),
    ("fts", r"\b(find|search|lookup|show me|list|which (transaction|evidence|entity))\b"),
]
_B = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def route(question: Column) -> Column:
    """ai, rules, graph, timeline or fts; lookups of 220 characters or more are open questions."""
    q = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    out = None
    for name, pattern in ROUTES:
        hit = q.rlike(pattern.replace(r"\b", _B))
        hit = hit & (F.length(q) < 220) if name == "fts" else hit
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("ai")


def snippets(docs: DataFrame, id_column: str, needle: str, before: int = 100, after: int = 500) -> DataFrame:
    """Text around the first occurrence of a keyword, case aside."""
    at = F.instr(F.lower("text"), F.lit(needle.lower()))
    first = F.greatest(F.lit(1), at - before)
    return docs.where(at > 0).select(id_column, F.col("text").substr(first, at + after - first).alias("snippet"))


_Q = "SELECT conv_id, turn, concat(CASE conv_id % 8 WHEN 0 THEN 'How many ' WHEN 1 THEN 'show me ' WHEN 2 THEN 'which hub is ' WHEN 3 THEN 'when did ' WHEN 4 THEN 'path from ' WHEN 5 THEN 'any circular ' WHEN 6 THEN 'explain ' ELSE '' END, text) AS q FROM conversations"


@query(
    "q01_route",
    f"WITH c AS ({_Q}), l AS (SELECT conv_id, turn, lower(trim(coalesce(q, ''))) AS q FROM c) SELECT conv_id, turn, CASE "
    + " ".join(f"WHEN regexp_matches(q, '{p}'){' AND length(q) < 220' if n == 'fts' else ''} THEN '{n}'" for n, p in ROUTES)
    + " ELSE 'ai' END AS route FROM l",
)
def q01(spark: SparkSession, d: str) -> DataFrame:
    starts = ["How many ", "show me ", "which hub is ", "when did ", "path from ", "any circular ", "explain ", ""]
    start = F.element_at(F.array(*map(F.lit, starts)), (F.col("conv_id") % 8 + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", route(F.concat(start, "text")).alias("route"))


@query("q02_rules_answer", f"WITH {TX} SELECT count(*) AS transactions, round(sum(amount), 4) AS volume, count(DISTINCT sender) AS senders FROM t")
def q02(spark, d):
    return transactions(spark, d).agg(F.count(F.lit(1)).alias("transactions"), F.round(F.sum("amount"), 4).alias("volume"), F.countDistinct("sender").alias("senders"))


@query("q04_search_answer", f"WITH {ENTITIES} SELECT id, value FROM n WHERE contains(lower(value), '00011') ORDER BY id LIMIT 20")
def q04(spark, d):
    return entities(spark, d).where(F.lower("value").contains("00011")).orderBy("id").limit(20).select("id", "value")


@query("q05_timeline_answer", f"WITH {TX} SELECT sender, min_by(id, CAST(us AS HUGEINT) * 1000000 + id) AS first_id, max_by(id, CAST(us AS HUGEINT) * 1000000 + id) AS last_id FROM t GROUP BY 1")
def q05(spark, d):
    at = F.struct("us", "id")
    return transactions(spark, d).groupBy("sender").agg(F.min_by("id", at).alias("first_id"), F.max_by("id", at).alias("last_id"))


@query(
    "q06_snippets",
    "SELECT doc_id, substr(text, greatest(1, instr(lower(text), 'license') - 100), instr(lower(text), 'license') + 500 - greatest(1, instr(lower(text), 'license') - 100)) AS snippet FROM documents WHERE contains(lower(text), 'license')",
)
def q06(spark, d):
    return snippets(table(spark, d, "documents"), "doc_id", "license")
