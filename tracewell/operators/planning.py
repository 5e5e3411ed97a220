"""Plans for model calls: chunks under a budget, digests of who matters, and reading what a model wrote."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.adapters import EDGES, edges, spread, table
from ..sources.perdoc import per_document
from .extract import token_estimate

ACTORS, LINKS, PARTICIPANTS = 15, 12, 24


def chunk_texts(text: str | None, most: int, overlap: int = 0) -> list[str]:
    """A text cut at line ends into chunks of at most ``most`` characters; longer lines are cut hard.

    With an overlap each chunk begins with whole lines from the end of the one before, as far as there is room.
    Blank chunks are dropped; a text within the budget is one chunk.
    """
    text = text or ""
    if len(text) <= most:
        return [text]
    pieces = [x[a : a + most] for x in text.split("\n") for a in range(0, max(1, len(x)), most)]
    groups, size = [[]], 0
    for piece in pieces:
        if groups[-1] and size + len(piece) + 1 > most:
            groups.append([])
            size = 0
        groups[-1].append(piece)
        size += len(piece) + 1
    plain = [c for c in ("\n".join(g) for g in groups) if c.strip()]
    if not overlap:
        return plain
    out = plain[:1]
    for before, own in zip(plain, plain[1:]):
        tail = before[-overlap:]
        tail = tail.partition("\n")[2] if "\n" in tail else tail
        room = most - len(own) - 1
        tail = tail[-room:] if room > 0 else ""
        out.append(f"{tail}\n{own}" if tail else own)
    return out


def plan_chunks(docs: DataFrame, id_column: str, most: int, overlap: int = 0) -> DataFrame:
    """id, chunk (from 0) and text: ``chunk_texts`` of each document in one pass."""

    def parse(text):
        yield from ({"chunk": k, "text": c} for k, c in enumerate(chunk_texts(text, most, overlap)))

    return per_document(docs, id_column, ["text"], parse, "chunk int, text string")


def plan_chunks_by_tokens(docs: DataFrame, id_column: str, tokens: int, overlap: int = 0) -> DataFrame:
    """The same under a budget of tokens: each document's own share of characters to a token gives its characters."""
    share = F.length("text") / F.greatest(token_estimate(F.col("text")), F.lit(1))
    rows = docs.withColumn("budget", F.greatest(F.lit(1), F.floor(share * tokens)).cast("int"))

    def parse(text, budget):
        yield from ({"chunk": k, "text": c} for k, c in enumerate(chunk_texts(text, budget or 1, overlap)))

    return per_document(rows, id_column, ["text", "budget"], parse, "chunk int, text string")


def participants(docs: DataFrame, values: DataFrame, id_column: str, top: int = PARTICIPANTS) -> DataFrame:
    """id, value and n of the values (id, value) of each document that its text holds most often, twice or more.

    Occurrences don't overlap; ties go by the value.  Values of under four characters don't count.
    """
    met = values.where("length(value) >= 4").distinct().join(docs.select(id_column, "text"), id_column)
    n = (F.length("text") - F.length(F.replace("text", "value"))) / F.length("value")
    counted = met.select(id_column, "value", n.cast("int").alias("n")).where("n > 1")
    place = F.row_number().over(Window.partitionBy(id_column).orderBy(F.desc("n"), "value"))
    return counted.withColumn("k", place).where(F.col("k") <= top).drop("k")


def manifest(values: DataFrame, key: str, budget: int) -> DataFrame:
    """The rows (key, value, weight) of each key whose lines fit the budget of characters, the heaviest first.

    A line takes its value, a hyphen, a space and the line break.
    """
    w = Window.partitionBy(key).orderBy(F.desc("weight"), "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return values.withColumn("used", F.sum(F.length("value") + 3).over(w)).where(F.col("used") <= budget)


def rolling_digest(actors: DataFrame, links: DataFrame, key: str, budget: int) -> DataFrame:
    """key and digest: the first ``ACTORS`` names (key, value, rank), then the latest ``LINKS`` links
    (key, at, source, relation, target), cut at the budget."""
    first = lambda df, order, most, x: (
        df.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("k") <= most)
        .groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", x.alias("x")))), lambda r: r["x"]).alias("xs"))
    )
    a = first(actors, ["rank", "value"], ACTORS, F.col("value")).select(key, F.concat(F.lit("ACTORS: "), F.array_join("xs", ", "), F.lit("\n")).alias("who"))
    link = F.concat("source", F.lit(" --"), "relation", F.lit("--> "), "target")
    b = first(links, [F.desc("at"), "source", "target"], LINKS, link).select(key, F.concat(F.lit("LINKS:\n"), F.array_join("xs", "\n")).alias("what"))
    return a.join(b, key, "full").select(key, F.substring(F.concat(F.coalesce("who", F.lit("")), F.coalesce("what", F.lit(""))), 1, budget).alias("digest"))


def read_object(said: str | None) -> dict | None:
    """The first JSON object in a model's answer: fences, words around it, trailing commas and a missing end are forgiven."""
    text = said or ""
    at = text.find("{")
    while at >= 0:
        depth, quoted, escaped, end, commas, stack = 0, False, False, None, [], []
        for k in range(at, len(text)):
            c = text[k]
            if quoted:
                quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
            elif c == '"':
                quoted = True
            elif c in "{[":
                stack.append("}" if c == "{" else "]")
            elif c in "}]":
                before = text[at:k].rstrip()
                if before.endswith(","):
                    commas.append(at + len(before) - 1)
                if stack:
                    stack.pop()
                if not stack:
                    end = k + 1
                    break
        body = "".join(c for k, c in enumerate(text[at:end], at) if k not in commas)
        if end is None:
            body = body + '"' * quoted
            body = body.rstrip().rstrip(",") + "".join(reversed(stack))
        try:
            found = json.loads(body, strict=False)
            if isinstance(found, dict):
                return found
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return None


def read_objects(answers: DataFrame, id_column: str) -> DataFrame:
    """id, found and body: the object in each answer (``text``) as canonical JSON, null if there is none."""

    def parse(text):
        got = read_object(text)
        yield {"found": got is not None, "body": None if got is None else json.dumps(got, sort_keys=True, ensure_ascii=False)}

    return per_document(answers, id_column, ["text"], parse, "found boolean, body string")


def cross_distance(a: Column, b: Column) -> Column:
    """Least distance between two arrays of places, null if either is empty."""
    return F.array_min(F.transform(a, lambda x: F.array_min(F.transform(b, lambda y: F.abs(x - y)))))


def places(text: Column, value: Column, most: int = 24) -> Column:
    """Places (from 0) of the first occurrences of a value, in any case, that don't overlap; [] if it is too short."""
    parts = F.split(F.lower(text), F.concat(F.lit(r"\Q"), F.lower(value), F.lit(r"\E")), -1)
    step = F.length(value)
    ends = F.aggregate(
        F.slice(parts, 1, F.least(F.lit(most), F.size(parts) - 1)), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda s, p: F.struct((s["at"] + F.length(p) + step).alias("at"), F.array_append(s["all"], s["at"] + F.length(p)).alias("all")),
        lambda s: s["all"],
    )
    return F.when((F.length(value) >= 2) & (F.size(parts) > 1), ends).otherwise(F.array().cast("array<int>"))


@query(
    "x48_chunks",
    """WITH x AS (SELECT doc_id, count(*) AS n, sum(length(x)) AS chars FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents) GROUP BY 1)
SELECT doc_id, chars FROM x""",
)
def x48(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 2,000 characters hold every character but line ends once: blank ones are counted from the text."""
    docs = spread(table(spark, d, "documents"), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = docs.withColumn("text", F.concat(F.lit("#"), F.regexp_replace("text", "\n", "\n#")))  # no chunk is blank
    chars = F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    kept = plan_chunks(marked, "doc_id", 2000).groupBy("doc_id").agg(F.sum(chars).alias("c"), F.max(F.length("text")).alias("longest"))
    lines = F.size(F.split("text", "\n", -1))
    return kept.join(docs, "doc_id").where("longest <= 2000").select("doc_id", (F.col("c") - lines).cast("long").alias("chars"))


@query("x48_chunks_by_tokens", "SELECT doc_id, true AS fits FROM documents WHERE text IS NOT NULL AND text <> ''")
def x48_tokens(spark, d):
    docs = spread(table(spark, d, "documents"), "doc_id").where("text <> ''").select("doc_id", "text", (F.length("text") / token_estimate(F.col("text")) * 256).alias("most"))
    kept = plan_chunks_by_tokens(docs, "doc_id", 256, 100).groupBy("doc_id").agg(F.max(F.length("text")).alias("longest"))
    return docs.join(kept, "doc_id", "left").select("doc_id", (F.coalesce("longest", F.lit(0)) <= F.ceil("most")).alias("fits"))


@query(
    "x50_participants",
    """WITH v AS (SELECT doc_id, unnest(['lorem', 'mail', 'note', 'ther', 'data', 'tion']) AS value, text FROM documents),
c AS (SELECT doc_id, value, CAST((length(text) - length(replace(text, value, ''))) // length(value) AS INTEGER) AS n FROM v)
SELECT doc_id, value, n FROM c WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, value) <= 3""",
)
def x50(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    values = docs.select("doc_id", F.explode(F.array(*[F.lit(v) for v in ("lorem", "mail", "note", "ther", "data", "tion")])).alias("value"))
    return participants(docs, values, "doc_id", 3)


@query(
    "x51_manifest",
    "WITH " + EDGES + """ SELECT source, target AS value, weight FROM e
QUALIFY sum(length(target) + 3) OVER (PARTITION BY source ORDER BY weight DESC, target ROWS UNBOUNDED PRECEDING) <= 60""",
)
def x51(spark, d):
    return manifest(edges(spark, d).select("source", F.col("target").alias("value"), "weight"), "source", 60).select("source", "value", "weight")


@query(
    "x53_digest",
    "WITH " + EDGES + """, k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, target) AS a, row_number() OVER (PARTITION BY source ORDER BY last_us DESC, source, target) AS b FROM e)
SELECT source, left(concat('ACTORS: ', string_agg(target, ', ' ORDER BY a) FILTER (WHERE a <= 15), chr(10), 'LINKS:', chr(10),
  string_agg(concat(source, ' --PAID--> ', target), chr(10) ORDER BY b) FILTER (WHERE b <= 12)), 150) AS digest FROM k GROUP BY 1""",
)
def x53(spark, d):
    e = edges(spark, d)
    actors = e.select("source", F.col("target").alias("value"), (-F.col("weight")).alias("rank"))
    links = e.select("source", F.col("source").alias("key"), F.col("last_us").alias("at"), F.lit("PAID").alias("relation"), "target")
    return rolling_digest(actors.withColumnRenamed("source", "key"), links, "key", 150).withColumnRenamed("key", "source")


@query(
    "x52_answers",
    """SELECT c_custkey, c_custkey % 5 <> 4 AS found, CASE c_custkey % 5 WHEN 4 THEN NULL WHEN 3 THEN concat('{"a": [1, {"b": "', c_name, '"}]}')
  ELSE concat('{"a": [1, 2], "b": "x } ', c_name, '"}') END AS body FROM customer""",
)
def x52(spark, d):
    """Fenced, with words around, with trailing commas, cut off, and without an object."""
    k, name = F.col("c_custkey") % 5, F.col("c_name")
    plain = F.concat(F.lit('{"b": "x } '), name, F.lit('", "a": [1, 2]}'))
    said = (
        F.when(k == 0, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Sure {ok}: "), plain, F.lit(" Done.")))
        .when(k == 2, F.concat(F.lit('{"b": "x } '), name, F.lit('", "a": [1, 2,],\n}'))).when(k == 3, F.concat(F.lit('{"a": [1, {"b": "'), name)).otherwise(F.lit("no object here"))
    )
    return read_objects(table(spark, d, "customer").select("c_custkey", said.alias("text")), "c_custkey")


@query(
    "f33_cross_distance",
    """WITH p AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL), w AS (SELECT * FROM (VALUES ('the'), ('and')) v(x)),
o AS (SELECT doc_id, x, i FROM (SELECT doc_id, x, string_split(t, x) AS s FROM p, w), LATERAL (SELECT unnest(range(1, least(25, len(s)))) AS k) q,
  LATERAL (SELECT list_sum(list_transform(s[1:k], lambda y: length(y))) + (k - 1) * length(x) AS i) z)
SELECT p.doc_id, CAST(min(abs(a.i - b.i)) AS INTEGER) AS distance FROM p LEFT JOIN o a ON a.doc_id = p.doc_id AND a.x = 'the' LEFT JOIN o b ON b.doc_id = p.doc_id AND b.x = 'and' GROUP BY 1""",
)
def f33(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", cross_distance(places(F.col("text"), F.lit("the")), places(F.col("text"), F.lit("and"))).cast("int").alias("distance"))
