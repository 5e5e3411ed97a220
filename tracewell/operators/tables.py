"""Relationship tables and entity registers inside texts.

A document's table is found and cut into rows in one pass over the texts; types, verbs and confidences are
expressions over those rows.
"""

from __future__ import annotations

import csv
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalize, vocabulary
from ..plans.registry import query
from ..sources.adapters import EDGES, edges, table
from ..sources.perdoc import per_document

MARKS = ",\t;|"
LEAST_LINES, LEAST_ROWS, REGISTER_ROWS = 6, 3, 5
# The column names of relationship tables.
_ENDS = {
    "source": ("source src from subject origin sender payer entity_a entity_1 node_a node_1 source_entity", "from_name subject_name a_name source_name person_a holder account_holder", "a"),
    "target": ("target tgt to object destination dest receiver recipient payee entity_b entity_2 node_b node_2 target_entity", "to_name object_name b_name target_name person_b counterpart connected_to", "b"),
}
_COLUMNS = {
    "verb": "relationship relationship_type relation relation_type rel rel_type relationship_name edge edge_type link_type connection connection_type verb interaction interaction_type association association_type",
    "row_id": "relationship_id row_id record_id id sr_no s_no serial_no sl_no no ref",
    "date": "event_date eventdate date timestamp when occurred_on occurredon occurred_at occurredat on txn_date txndate transaction_date transactiondate time dated observed_at observedat observed_on observedon valid_from validfrom valid_to validto valid_until first_seen firstseen last_seen lastseen event_time eventtime from_date fromdate to_date todate",
    "confidence": "confidence confidence_score conf score prob probability certainty",
    "state": "state status verdict corroboration",
    "method": "extraction_method method technique derived_from source_method basis",
    "evidence": "evidence evidence_id evidence_ids evidence_ref doc_ref document_ref source_doc source_document",
}
_TYPE_COLUMN = "entity_type entitytype type record_type recordtype row_type rowtype category classification".split()
_NAME_COLUMN = re.compile("(name|label|entity|entity_?name|full_?name|display_?name|value|holder|account_?holder|subject|title|alias)|.*_name")
_ID_COLUMN = "entity_id entityid id record_id recordid ref_id refid uid code identifier".split()


def header_name(cell: str) -> str:
    """A header cell in lower case, with underscores for white space and hyphens."""
    return re.sub(r"[^a-z0-9_]", "", re.sub(r"[\s-]+", "_", cell.lower().strip()))


def cells(line: str, mark: str) -> list[str]:
    """The cells of a line, quotes and doubled quotes read."""
    return [c.strip() for c in next(csv.reader([line], delimiter=mark), [])]


def _first(names: list[str], wanted) -> int | None:
    return next((i for i, n in enumerate(names) if n in wanted), None)


def _relation_columns(header: list[str]) -> dict | None:
    """Place of each known column; None unless both ends have one."""
    names, at = [header_name(h) for h in header], {}
    for end, (stems, more, letter) in _ENDS.items():
        base = [*stems.split(), letter]
        at[end] = _first(names, {*stems.split(), *more.split()})
        at[f"{end}_type"] = _first(names, {f"{s}_{m}type" for s in base for m in ("", "entity_")})
        at[f"{end}_id"] = _first(names, {f"{s}_{k}" for s in base for k in ("id", "uid", "key", "ref", "ref_id", "code")})
    spare = [i for i, n in enumerate(names) if re.fullmatch(r".*_name|name|entity|value|label|name_*[0-9a]", n) and i not in (at["source"], at["target"])]
    if len(spare) >= 2:
        at["source"] = spare[0] if at["source"] is None else at["source"]
        at["target"] = spare[1] if at["target"] is None else at["target"]
    if at["source"] is None or at["target"] is None or at["source"] == at["target"]:
        return None
    for field, wanted in _COLUMNS.items():
        at[field] = _first(names, wanted.split())
    if at["verb"] is None:
        at["verb"] = next((i for i, n in enumerate(names) if n == "type" and i not in (at["source"], at["target"])), None)
    return at


def _regions(lines: list[str]):
    """(mark, first line, last line) where a table may be: the whole text, then runs of lines, the longest first."""
    widths = {m: [sum(c != "" for c in cells(x, m)) for x in lines] for m in MARKS}
    whole = []
    for m, w in widths.items():
        modal, n = max(Counter(w).items(), key=lambda p: (p[1], p[0]))
        if modal >= 3 and n / len(w) >= 0.75:
            whole.append((-n / len(w), m))
    runs = []
    for m, w in widths.items():
        start = None
        for i, n in enumerate([*w, 0]):
            if n >= 3 and start is None:
                start = i
            elif n < 3 and start is not None:
                if i - start >= LEAST_LINES:
                    runs.append((start - i, m, start, i - 1))
                start = None
    for _, m in sorted(whole, key=lambda p: p[0]):
        yield m, 0, len(lines) - 1, True
    for _, m, a, b in sorted(runs, key=lambda p: p[0]):
        yield m, a, b, False


def _kept(text: str | None) -> list[str]:
    return [x.rstrip() for x in (text or "").split("\n") if x.strip()]


def relation_rows(text: str | None):
    """The rows of a document's first relationship table, as they were written; none under three rows."""
    lines = _kept(text)
    if len(lines) < LEAST_LINES:
        return
    for mark, a, b, whole in _regions(lines):
        for h in range(a, a + 1 if whole else min(a + 2, b - 4) + 1):
            header = cells(lines[h], mark)
            at = _relation_columns(header) if sum(c != "" for c in header) >= 3 else None
            if at is None:
                continue
            width, rows = sum(c != "" for c in header), []
            for k in range(h + 1, b + 1):
                row = cells(lines[k], mark)
                own = {f: row[i] if i is not None and i < len(row) else "" for f, i in at.items()}
                if len(row) >= 3 and abs(len(row) - width) <= 1 and own["source"] and own["target"]:
                    rows.append({"line": k + 1, **{f: v or None for f, v in own.items()}})
            if len(rows) >= LEAST_ROWS:
                yield from rows
            return


_RELATION = "line int, " + ", ".join(
    f"`{f}` string" for f in ("source", "target", "source_type", "target_type", "source_id", "target_id", *_COLUMNS)
)


def confidence(cell: Column) -> Column:
    """A share, or a percentage as a share; null for other cells."""
    n = F.regexp_replace(cell, "[^0-9.]", "").try_cast("double")
    return F.when((n > 0) & (n <= 1), n).when((n > 1) & (n <= 100), n / 100)


def date_cell(cell: Column) -> Column:
    """The cell if it is an ISO or a day-first date, else null."""
    t = F.trim(cell)
    return F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}|^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}$"), t)


def _reference(cell: Column, has_id: Column) -> Column:
    """struct(ref, name): a leading reference token ("E0001 Arjun Sharma") parted from the name."""
    lead = r"^([A-Za-z][A-Za-z0-9_-]{2,15})\s+(\S.*)$"
    ref, name = F.regexp_extract(cell, lead, 1), F.trim(F.regexp_extract(cell, lead, 2))
    fits = ~has_id & ref.rlike("[0-9]") & (F.length(name) >= 2) & (F.size(F.split(name, r"\s+")) <= 8)
    alone = ~has_id & normalize.is_reference(cell)
    return F.struct(F.when(fits, ref).when(alone, cell).alias("ref"), F.when(fits, name).otherwise(cell).alias("name"))


def relationship_table(docs: DataFrame, id_column: str) -> DataFrame:
    """Edges of each document that is, or holds, a relationship table.

    A table whose verbs are entity types in three of five rows or more is a register and gives no edge, nor does one with
    fewer than three edges.  Rows with equal ends give none.  A null text has no table.
    """
    rows = per_document(docs, id_column, ["text"], relation_rows, _RELATION)
    given = lambda c: F.max(F.col(c).isNotNull()).over(Window.partitionBy(id_column))
    rows = rows.withColumn("s", _reference(F.col("source"), given("source_id"))).withColumn("t", _reference(F.col("target"), given("target_id")))
    rows = rows.where(F.lower("s.name") != F.lower("t.name"))
    rows = rows.withColumn("r", vocabulary.evidence_relation(F.coalesce("verb", F.lit("ASSOCIATED_WITH"))))
    kind = lambda label, value: F.coalesce(vocabulary.entity_type(F.col(label)), normalize.guess_type(F.col(value)))
    side = lambda a, b: F.when(F.col("r.reversed"), F.col(b)).otherwise(F.col(a))
    rows = rows.withColumns({"st": kind("source_type", "s.name"), "tt": kind("target_type", "t.name"), "si": F.coalesce("source_id", "s.ref"), "ti": F.coalesce("target_id", "t.ref")})
    w = Window.partitionBy(id_column)
    labels = F.avg(F.when(vocabulary.entity_type(F.coalesce("verb", F.lit(""))).isNotNull(), 1.0).otherwise(0.0)).over(w)
    rows = rows.withColumns({"labels": labels, "n": F.count(F.lit(1)).over(w)}).where((F.col("labels") < 0.6) & (F.col("n") >= LEAST_ROWS))
    # Types and ids stay with the column they stood in; only the values change sides.
    return rows.select(
        id_column, "line", side("s.name", "t.name").alias("source"), side("t.name", "s.name").alias("target"), F.col("st").alias("source_type"), F.col("tt").alias("target_type"),
        F.col("r.type").alias("relation"), F.coalesce("verb", F.lit("ASSOCIATED_WITH")).alias("verb"), F.coalesce(confidence(F.col("confidence")), F.lit(0.8)).alias("confidence"),
        date_cell(F.col("date")).alias("date"), "row_id", F.col("si").alias("source_id"), F.col("ti").alias("target_id"), "state", "method",
        F.slice(F.filter(F.transform(F.split(F.coalesce("evidence", F.lit("")), "[;,|]"), lambda x: F.trim(x)), lambda x: x != ""), 1, 8).alias("evidence"),
    )


def register_rows(text: str | None):
    """Typed rows of the registers in a document, as they were written."""
    lines, labels = _kept(text), set(vocabulary.turned(vocabulary.TYPES))
    if len(lines) < LEAST_LINES:
        return
    found: list[dict] = []
    for mark, a, b, whole in _regions(lines):
        for h in range(a, min(a + 2, b - 4) + 1) if not whole else ():
            header = cells(lines[h], mark)
            names = [header_name(c) for c in header]
            kind = _first(names, _TYPE_COLUMN)
            ends = [_first(names, {*stems.split(), *more.split()}) for stems, more, _ in _ENDS.values()]
            rows = [(k + 1, r) for k, r in ((k, cells(lines[k], mark)) for k in range(h + 1, b + 1)) if abs(len(r) - len(header)) <= 1]
            name_columns = [i for i, n in enumerate(names) if i != kind and _NAME_COLUMN.fullmatch(n)]
            if kind is None or None not in ends or len(rows) < REGISTER_ROWS or not name_columns:
                continue
            get = lambda r, i: r[i].strip() if i is not None and i < len(r) else ""
            fill = {i: sum(get(r, i) != "" for _, r in rows) for i in name_columns}
            name = max(name_columns, key=lambda i: (fill[i], -i))
            if fill[name] / len(rows) < 0.3:
                continue
            key, own, mapped = _first(names, _ID_COLUMN), [], 0
            for k, r in rows:
                label = get(r, kind)
                known = re.sub(r"[\s-]+", "_", label.upper()) in labels
                value = get(r, name) or get(r, key)
                if (known or re.fullmatch(r"[A-Z][A-Z_]{1,23}", re.sub(r"\s+", "_", label))) and len(value) >= 2:
                    mapped += known
                    own.append({"line": k, "label": label, "value": value[:120], "ref": get(r, key) if get(r, key) != value and get(r, key) else None})
            if len(own) >= REGISTER_ROWS and mapped / len(own) >= 0.6:
                found += own
    yield from found


def entity_register(docs: DataFrame, id_column: str) -> DataFrame:
    """type, value, norm, confidence and references of the entities in each document's registers.

    A register has a type column that the vocabulary maps in three of five rows or more, a name column that is
    filled in three of ten, five rows or more, and no pair of ends.  An entity met twice is one.
    """
    rows = per_document(docs, id_column, ["text"], register_rows, "line int, label string, value string, ref string")
    kind = F.coalesce(vocabulary.entity_type(F.col("label")), F.lit("other"))
    named = F.trim(F.regexp_replace(F.regexp_replace(F.lower("value"), "[^a-z0-9 ]", ""), r"\s+", " "))
    rows = rows.withColumn("type", kind).withColumn("norm", F.when(kind.isin("person", "organization"), named).otherwise(F.regexp_replace(F.lower("value"), "[^a-z0-9@.+_-]", "")))
    g = rows.groupBy(id_column, "type", "norm").agg(
        F.min_by("value", "line").alias("value"), F.max(F.when(vocabulary.entity_type(F.col("label")).isNotNull(), 0.9).otherwise(0.7)).alias("confidence"),
        F.array_sort(F.collect_set("ref")).alias("refs"),
    )
    total = F.count(F.lit(1)).over(Window.partitionBy(id_column))
    return g.withColumn("n", total).where(F.col("n") >= REGISTER_ROWS).drop("n")


def _export(spark: SparkSession, d: str) -> DataFrame:
    """A generated relationship export for each sending account, between two lines of prose."""
    e = edges(spark, d)
    verb = F.element_at(F.array(*[F.lit(v) for v in ("PAID", "received-from", "SUPPLIED_GOODS_TO", "KNOWS")]), (F.col("weight") % 4 + 1).cast("int"))
    row = F.concat_ws("|", F.concat(F.lit("R"), F.substring("target", 2, 9)), F.concat(F.lit("E0"), F.substring("source", 2, 9), F.lit(" Ann Shaw "), "source"), F.lit("PERSON"), F.concat(F.lit('"Acme | '), "target", F.lit(' Ltd"')), F.lit("Company"), verb, F.concat((F.col("weight") * 10 + 20).cast("string"), F.lit("%")))
    g = e.select("source", F.struct("target", row.alias("x")).alias("r")).groupBy("source").agg(F.array_sort(F.collect_list("r")).alias("r"))
    head = F.lit("Annexure A lists what the tool found in the case so far.\nID|Source Name|Source Type|Target Name|Target Type|Relationship|Confidence\n")
    return g.select(F.col("source").alias("case"), F.concat(head, F.array_join(F.transform("r", lambda r: r["x"]), "\n"), F.lit("\nEnd of the annexure.")).alias("text"))


@query(
    "x38_relationships",
    "WITH " + EDGES + """, n AS (SELECT *, count(*) OVER (PARTITION BY source) AS n, concat('Ann Shaw ', source) AS a, concat('Acme | ', target, ' Ltd') AS b FROM e)
SELECT source AS "case", CASE WHEN weight % 4 = 1 THEN b ELSE a END AS source, CASE WHEN weight % 4 = 1 THEN a ELSE b END AS target, 'person' AS source_type, 'organization' AS target_type,
  ['PAID', 'TRANSFERRED_TO', 'SUPPLIED_GOODS_TO', 'KNOWS'][weight % 4 + 1] AS relation, CASE WHEN weight <= 8 THEN (weight * 10 + 20) / 100.0 ELSE 0.8 END AS confidence,
  concat('E0', substr(source, 2)) AS source_id, concat('R', substr(target, 2)) AS row_id FROM n WHERE n >= 5""",
)
def x38(spark: SparkSession, d: str) -> DataFrame:
    """Generated exports of five edges or more; shorter runs of lines are no table."""
    rows = relationship_table(_export(spark, d), "case")
    return rows.select("case", "source", "target", "source_type", "target_type", "relation", F.round("confidence", 6).alias("confidence"), "source_id", "row_id")


def _register(spark: SparkSession, d: str) -> DataFrame:
    """A generated register of each nation's customers and suppliers."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.concat_ws(",", F.concat(F.lit("PER-"), "c_custkey"), F.lit("Person"), F.concat(F.lit('"'), F.col("c_name"), F.lit('"')), "c_mktsegment").alias("x"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.concat_ws(",", F.concat(F.lit("ORG-"), "s_suppkey"), F.lit("COMPANY"), "s_name", F.lit("vendor")).alias("x"))
    g = c.unionByName(s).groupBy("k").agg(F.array_sort(F.collect_list("x")).alias("r"))
    return g.select(F.col("k").alias("nation"), F.concat(F.lit("entity_id,Entity Type,Full Name,role\n"), F.array_join("r", "\n")).alias("text"))


@query(
    "x39_register",
    """WITH c AS (SELECT c_nationkey AS nation, 'person' AS type, c_name AS value, concat('PER-', c_custkey) AS ref FROM customer
  UNION ALL SELECT s_nationkey, 'organization', s_name, concat('ORG-', s_suppkey) FROM supplier)
SELECT nation, type, value, 0.9::DOUBLE AS confidence, ref FROM c QUALIFY count(*) OVER (PARTITION BY nation) >= 5""",
)
def x39(spark, d):
    return entity_register(_register(spark, d), "nation").select("nation", "type", "value", "confidence", F.array_join("refs", ",").alias("ref"))


@query("x38_register_guard", "SELECT CAST(NULL AS INTEGER) AS nation, CAST(NULL AS VARCHAR) AS relation WHERE false")
def x38_guard(spark, d):
    """A register whose last column could be a verb gives no relationships."""
    docs = _register(spark, d).withColumn("text", F.regexp_replace("text", "^[^\n]*", "source,relationship,target,note"))
    return relationship_table(docs, "nation").select("nation", "relation")


_VERBS = ["paid", "Received From", "KNOWS", "laundered money for", "x", "", "employed-by", "ASSOCIATED_WIT", "9 lives", "a b c d e f"]
_VERB_WANT = [
    ("TRANSFERRED_TO", False, False), ("TRANSFERRED_TO", True, False), ("KNOWS", False, False), ("LAUNDERED_MONEY_FOR", False, True), ("ASSOCIATED_WITH", False, False),
    ("ASSOCIATED_WITH", False, False), ("EMPLOYS", True, False), ("ASSOCIATED_WITH", False, False), ("ASSOCIATED_WITH", False, False), ("ASSOCIATED_WITH", False, False),
]
_EVIDENCE_WANT = ["PAID", "TRANSFERRED_TO", "KNOWS", "LAUNDERED_MONEY_FOR", "ASSOCIATED_WITH", "ASSOCIATED_WITH", "EMPLOYS", "ASSOCIATED_WITH", "ASSOCIATED_WITH", "ASSOCIATED_WITH"]


def _pick(values: list) -> str:
    return "CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN {v!r}" for i, v in enumerate(values)) + " END"


@query(
    "f31_relations",
    f"SELECT o_orderkey, {_pick([t for t, _, _ in _VERB_WANT])} AS relation, {_pick([r for _, r, _ in _VERB_WANT])} AS reversed, {_pick([n for _, _, n in _VERB_WANT])} AS novel, {_pick(_EVIDENCE_WANT)} AS evidence FROM orders",
)
def f31(spark, d):
    """Golden verbs: reversed, canonical, synonym, new, cut off and badly formed ones."""
    verb = F.element_at(F.array(*[F.lit(v) for v in _VERBS]), (F.col("o_orderkey") % 10 + 1).cast("int"))
    r = vocabulary.relation(verb)
    return table(spark, d, "orders").select("o_orderkey", r["type"].alias("relation"), r["reversed"].alias("reversed"), r["novel"].alias("novel"), vocabulary.evidence_relation(verb)["type"].alias("evidence"))


@query(
    "f31_model_relations",
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'TRANSFERRED_TO' WHEN 1 THEN 'WORKS_FOR' WHEN 2 THEN 'OWNS' ELSE 'RECRUITED_BY' END AS relation, o_orderkey % 4 = 2 AS reversed FROM orders",
)
def f31_model(spark, d):
    verb = F.element_at(F.array(*[F.lit(v) for v in ("transferred_money", "worked for", "owned_by", "recruited_by")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    r = vocabulary.model_relation(verb)
    return table(spark, d, "orders").select("o_orderkey", r["type"].alias("relation"), r["reversed"].alias("reversed"))


@query(
    "f45_entity_types",
    "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'person' WHEN 1 THEN 'account' WHEN 2 THEN 'organization' WHEN 3 THEN 'imei' END AS type FROM orders",
)
def f45(spark, d):
    label = F.element_at(F.array(*[F.lit(v) for v in (" suspect ", "bank account", "Company", "IMEI", "banana")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", vocabulary.entity_type(label).alias("type"))


@query(
    "x42_cells",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0.45 WHEN 1 THEN 0.9 WHEN 2 THEN NULL ELSE 1.0 END::DOUBLE AS confidence,
  CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders""",
)
def x42(spark, d):
    k = F.col("o_orderkey")
    cell = F.element_at(F.array(*[F.lit(v) for v in ("45 %", "0.9", "high", "1")]), (k % 4 + 1).cast("int"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, d, "orders").select("o_orderkey", confidence(cell).alias("confidence"), date_cell(F.when(k % 2 == 0, F.concat(F.lit(" "), day)).otherwise(F.concat(F.lit("on "), day))).alias("date"))
