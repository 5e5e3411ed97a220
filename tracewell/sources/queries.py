"""Registered queries of the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.registry import query
from . import text
from .adapters import ENTITIES, entities, table


@query(
    "s02_file_kind",
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'sheet' WHEN 2 THEN 'image' ELSE 'binary' END AS kind FROM documents",
)
def s02(spark, d):
    name = F.concat(F.lit("file."), F.element_at(F.array(*map(F.lit, ("TXT", "xlsx", "jpeg", "exe"))), (F.col("doc_id") % 4 + 1).cast("int")))
    return table(spark, d, "documents").select("doc_id", text.file_kind(name).alias("kind"))


@query("s03_printable_share", r"SELECT doc_id, round(length(regexp_replace(left(text, 8192), '[^\x20-\x7E\t\n\r\x{A0}-\x{10FFFF}]', '', 'g')) / greatest(1, length(left(text, 8192))), 6) AS share FROM documents")
def s03(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(text.printable_share(F.col("text")), 6).alias("share"))


@query(
    "s04_csv_fields",
    "SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer",
)
def s04(spark, d):
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), F.col("c_name"), F.lit('"')), "c_mktsegment")
    return table(spark, d, "customer").select(F.from_csv(line, "k long, name string, segment string", {"quote": '"', "escape": '"'}).alias("r")).select(
        F.col("r.k").alias("c_custkey"), "r.name", "r.segment"
    )


@query("s05_json_fields", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type AS kind FROM events")
def s05(spark, d):
    body = F.to_json(F.struct("event_type", F.from_json("props", "k long").alias("p")))
    return table(spark, d, "events").select("event_id", F.from_json(body, "event_type string, p struct<k: long>").alias("r")).select(
        "event_id", F.col("r.p.k").alias("k"), F.col("r.event_type").alias("kind")
    )


def _duck(c: str, steps: list[tuple[str, str, str]]) -> str:
    for pattern, to, flags in steps:
        c = f"regexp_replace({c}, '{pattern}', {to}, 'g{flags}')"
    return c


_HTML = _duck(
    "html",
    [
        (r"<!--.*?-->", "chr(10)", "s"), (r"<script.*?</script>", "chr(10)", "is"), (r"<style.*?</style>", "chr(10)", "is"), (r"<head.*?</head>", "''", "is"),
        (r"<br\s*/?>", "chr(10)", "i"), (r"</t[dh]>\s*", "' | '", "i"), (r"</?tr[^>]*>", "chr(10)", "i"),
        (r"</?(div|p|li|h[1-6]|hr|section|article|header|footer|table|thead|tbody|caption)[^>]*>", "chr(10)", "i"), (r"<[^>]+>", "''", ""),
        ("&nbsp;", "' '", "i"), ("&amp;", "''&''".replace("''", "'"), "i"), ("&lt;", "'<'", "i"), ("&gt;", "'>'", "i"), ("&quot;", "chr(34)", "i"), ("&apos;|&#39;", "chr(39)", "i"),
        (r"[ \t]*\|[ \t]*(\n|\z)", r"'\1'", ""), (r"\n{3,}", "concat(chr(10), chr(10))", ""), (r"[ \t]+", "' '", ""), (r"^\s+|\s+\z", "''", ""),
    ],
)


@query("s07_html_to_text", f"SELECT page_id, {_HTML} AS text FROM pages")
def s07(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query(
    "s08_markdown_to_text",
    "SELECT s_suppkey, concat('Title ', s_suppkey, chr(10), 'bold link (u) code', chr(10), '- item') AS text FROM supplier",
)
def s08(spark, d):
    md = F.concat(F.lit("## Title "), F.col("s_suppkey").cast("string"), F.lit("\n**bold** [link](u) `code`\n* item"))
    return table(spark, d, "supplier").select("s_suppkey", text.markdown_to_text(md).alias("text"))


@query("s11_unfold", "SELECT s_suppkey, concat('FN:', s_name, chr(10), 'NOTE:longline') AS text FROM supplier")
def s11(spark, d):
    card = F.concat(F.lit("FN:"), F.col("s_name"), F.lit("\r\nNOTE:long\r\n line"))
    return table(spark, d, "supplier").select("s_suppkey", text.unfold(card).alias("text"))


@query("s18_content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def s18(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("s19_scan", "SELECT doc_id, n_chars FROM documents WHERE lang = 'de'")
def s19(spark, d):
    return table(spark, d, "documents").where("lang = 'de'").select("doc_id", "n_chars")


@query("s20_export", f"WITH {ENTITIES} SELECT case_id, count(*) AS n, count(DISTINCT id) AS ids FROM n GROUP BY 1")
def s20(spark, d):
    rows = text.export_case({"entities": entities(spark, d)})
    back = rows.select("case_id", F.from_json("body", "id string, type string").alias("r"))
    return back.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("r.id").alias("ids"))


@query("s22_report", "SELECT lang, count(*) AS files, sum(n_chars) AS chars, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def s22(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"), F.countDistinct("source").alias("sources"))


@query(
    "s23_ingest",
    """WITH i AS (SELECT doc_id AS id, lang AS case_id, sha256(text) AS sha256 FROM documents)
SELECT case_id, sha256, min(id) AS id FROM i WHERE (case_id, sha256) NOT IN (SELECT (case_id, sha256) FROM i WHERE id < 100) GROUP BY 1, 2""",
)
def s23(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("case_id"), F.sha2("text", 256).alias("sha256"))
    return text.new_evidence(rows, rows.where("id < 100"))


@query(
    "s24_versions",
    "SELECT conv_id AS evidence_id, turn AS id, row_number() OVER w AS version, lag(turn) OVER w AS supersedes FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
)
def s24(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("evidence_id"), F.col("turn").alias("id"), F.col("turn").alias("created"))
    return text.version_chain(rows)


@query(
    "s07_references",
    """SELECT s_suppkey, concat('₹', s_suppkey, ' ', s_name, ' 😀 & <b> ', chr(34), 'é', chr(34), ' &bad; &#0; &') AS text FROM supplier""",
)
def s07_references(spark, d):
    """Named, decimal and hexadecimal references, beyond the basic plane too; others stay as they are."""
    raw = F.concat(F.lit("<p>&#8377;"), F.col("s_suppkey").cast("string"), F.lit("&nbsp;"), F.col("s_name"), F.lit(" &#x1F600; &AMP; &lt;b&gt; &quot;&#xe9;&#34; &bad; &#0; &</p>"))
    return table(spark, d, "supplier").select("s_suppkey", text.html_to_text(raw).alias("text"))
