"""Entity extraction from text by patterns, classification and document structure.

Patterns run inside one projection over the text; word boundaries are those of ASCII.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import checksum, normalize
from ..plans.registry import query
from ..sources.adapters import spread, table

B0, B1 = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_SALUTE = "(?:Mr|Mrs|Ms|Dr|Sri|Smt|Sh)"
_LABEL = r"(?:Name|Holder|Customer|Acc(?:ount)?\s*Holder|Beneficiary|Sender|Receiver|Suspect|Owner)"
_NAME = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})"
_ORG = (
    r"(?:Pvt\.?\s*Ltd\.?|Private\s+Limited|Ltd\.?|Limited|LLP|Inc\.?|Corp\.?|Corporation|Bank|Banc|Banking|Trust|Foundation|"
    r"Holdings|Trading\s+Co\.?|Industries|Enterprises|Solutions|Technologies|Tech)"
)
_URL = B0 + r"(?i:https?)://[^\s<>\"')]+"
_EMAIL = B0 + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}" + B1
_IP = B0 + r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}" + B1
#: Endings of file names that are no domains.
FILE_ENDINGS = "pdf jpg jpeg png gif txt csv doc docx xls xlsx zip tar gz mp4 mp3 exe bin".split()


@dataclass(frozen=True)
class Rule:
    """How one kind of value is found: the pattern and its group, the norm, and what a norm must satisfy."""

    type: str
    pattern: str
    norm: Callable[[Column], Column]
    confidence: float
    keep: Callable[[Column], Column] = lambda n: n != ""
    group: int = 0
    label: str | None = None
    prepare: Callable[[Column], Column] | None = None


def _strip_hosts(t: Column) -> Column:
    for p in (_URL, _EMAIL, _IP):
        t = F.regexp_replace(t, F.lit(p), F.lit(" "))
    return t


def _plus(c: Column) -> Column:
    return F.concat(F.lit("+"), normalize.digits(c))


RULES = {
    "phone": Rule("phone", r"(?<![A-Za-z0-9_@.+])(?:(?:\+?91|0)[\s-]?)?[6-9][0-9]{4}[\s-]?[0-9]{5}(?![0-9])", normalize.phone, 0.9, lambda n: (F.length(n) >= 10) & ~n.rlike("^[0-9]{12}$|^[0-9]{14,}$")),
    "intl_phone": Rule("phone", r"\+(?!91(?![^0-9]))([0-9][0-9\s-]{8,17}[0-9])", _plus, 0.75, lambda n: F.length(n).between(9, 16) & ~n.startswith("+91"), label="International number"),
    "email": Rule("email", _EMAIL, normalize.email, 0.95),
    "upi": Rule("upi", B0 + r"(?i:[a-z0-9._+-]{2,40}@(?:ok[a-z]{2,8}|(?:ybl|ibl|axl|apl|upi|paytm)[a-z]{0,8}))" + B1, normalize.upi, 0.9, lambda n: n.rlike("^[^@]+@[^@.]{1,12}$") & n.rlike("@(.{1,6}|[a-z]+)$")),
    "ifsc": Rule("ifsc", B0 + "[A-Z]{4}0[A-Z0-9]{6}" + B1, normalize.compact_upper, 0.95),
    "ip": Rule("ip", _IP, normalize.ip, 0.85, lambda n: F.forall(F.split(n, "\\."), lambda x: x.cast("int") <= 255)),
    "url": Rule("url", _URL, normalize.url, 0.9),
    "domain": Rule("domain", B0 + r"(?i:(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24})" + B1, normalize.domain, 0.7, lambda n: ~F.element_at(F.split(n, "\\."), -1).isin(*FILE_ENDINGS), prepare=_strip_hosts),
    "imei": Rule("imei", B0 + "[0-9]{15}" + B1, normalize.imei, 0.7, checksum.valid_imei),
    "mac": Rule("mac", B0 + "(?:[0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}" + B1, normalize.mac, 0.85),
    "eth": Rule("wallet", B0 + "0x[0-9a-fA-F]{40}" + B1, normalize.wallet, 0.95),
    "btc": Rule("wallet", B0 + "[13][a-km-zA-HJ-NP-Z1-9]{25,34}" + B1, normalize.wallet, 0.8),
    "vehicle": Rule("vehicle", B0 + r"[A-Z]{2}[\s-]?[0-9]{1,2}[\s-]?[A-Z]{1,3}[\s-]?[0-9]{4}" + B1, normalize.dashless_upper, 0.85),
    "date": Rule(
        "date", B0 + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9]{2}:[0-9]{2}(?::[0-9]{2})?Z?)?|[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}|[A-Za-z]{3,9}\s+[0-9]{1,2},?\s+[0-9]{4}|[0-9]{1,2}\s+[A-Za-z]{3,9}\s+[0-9]{4})" + B1,
        normalize.date_iso, 0.8, lambda n: n.isNotNull(),
    ),
    "amount": Rule(
        "amount", r"(?i)(?:₹\s*[0-9][0-9,]*(?:\.[0-9]+)?|rs\.?\s*[0-9][0-9,]*(?:\.[0-9]+)?|inr\s*[0-9][0-9,]*(?:\.[0-9]+)?|[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:/-)?\s*(?:lakhs?|lacs?|cr|crores?|k|m|million)" + B1 + ")",
        lambda c: normalize.amount(c).cast("decimal(30,2)").cast("string"), 0.85, lambda n: n.cast("double") > 0,
    ),
    "aadhaar": Rule("document_id", B0 + r"[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}" + B1, normalize.aadhaar, 0.8, checksum.valid_aadhaar, label="Aadhaar"),
    "pan": Rule("document_id", B0 + "[A-Z]{5}[0-9]{4}[A-Z]" + B1, normalize.compact_upper, 0.95, label="PAN"),
    "gstin": Rule("document_id", B0 + "[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]" + B1, normalize.dashless_upper, 0.95, checksum.valid_gstin, label="GSTIN"),
    "passport": Rule("document_id", B0 + "[A-Z][0-9]{7}" + B1, normalize.compact_upper, 0.7, label="Passport"),
    "salutation": Rule("person", B0 + _SALUTE + r"\.?\s+" + _NAME, normalize.person, 0.55, lambda n: F.length(n) >= 3, 1, "Inferred person name"),
    "labelled_name": Rule("person", B0 + _LABEL + r"\s*[:\-]\s*" + _NAME, normalize.person, 0.55, lambda n: F.length(n) >= 3, 1, "Inferred person name"),
    "organization": Rule("organization", B0 + r"[A-Z][A-Za-z0-9&.,'-]*(?:\s+[A-Z][A-Za-z0-9&.,'-]*){0,4}\s+" + _ORG + B1, normalize.organization, 0.7, label="Inferred organization"),
    "account": Rule("account", B0 + r"(?i:a/c(?:count)?|acct|ac\s*no|account)\s*(?i:no\.?|number)?\s*[:\-]?\s*([Xx0-9][Xx0-9\- ]{8,17})" + B1, normalize.account, 0.85, lambda n: F.length(n) >= 6, 1, "Bank account"),
    "iban": Rule("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{8,20}(?![a-z0-9])", lambda c: F.lower(c), 0.85, lambda n: F.length(n).between(12, 26) & n.rlike("^.{4}.*([a-z]{4}|[0-9]{6})"), label="Bank account (IBAN-style)"),
    "reference": Rule(
        "document_id", B0 + r"(?i:utr|neft\s*utr|ref(?:erence)?(?:\s*no|number|#)?|rrn|txn\s*(?:id|no)|transaction\s*(?:id|ref(?:\s*no)?)?|upi\s*ref(?:\s*no)?)\s*[:#\-]?\s*([A-Za-z0-9]{8,22})" + B1,
        lambda c: F.upper(c), 0.85, group=1, label="UTR / Reference No",
    ),
}

_STRUCT = "struct<type:string,value:string,norm:string,label:string,confidence:double>"


def matches(text: Column, rule: Rule) -> Column:
    """Array of (type, value, norm, label, confidence) of a rule's matches, one for each norm."""
    t = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(rule.prepare(t) if rule.prepare else t, F.lit(rule.pattern), F.lit(rule.group))
    made = F.transform(
        F.array_distinct(found),
        lambda v: F.struct(
            F.lit(rule.type).alias("type"), F.trim(v).alias("value"), rule.norm(v).alias("norm"), F.lit(rule.label).cast("string").alias("label"), F.lit(rule.confidence).alias("confidence")
        ),
    )
    return F.filter(made, lambda s: F.coalesce(rule.keep(s["norm"]), F.lit(False)))


def extract(docs: DataFrame, id_column: str, names: list[str] | None = None) -> DataFrame:
    """One row per document, type and norm with the highest confidence, over all rules or some of them."""
    rules = [RULES[n] for n in names or RULES]
    every = F.concat(*[matches(F.col("text"), r) for r in rules]) if len(rules) > 1 else matches(F.col("text"), rules[0])
    rows = docs.select(id_column, F.explode(every).alias("e")).select(id_column, "e.*")
    best = rows.groupBy(id_column, "type", "norm").agg(F.max(F.struct("confidence", F.coalesce("label", F.lit("")).alias("label"), "value")).alias("b"))
    out = best.select(id_column, "type", "norm", F.col("b.value").alias("value"), F.col("b.confidence").alias("confidence"))
    accounts = out.where("type = 'account'").select(id_column, F.col("norm").alias("n2"))
    if any(r.type == "imei" for r in rules) and any(r.type == "account" for r in rules):
        clash = (out.type == "imei") & (out[id_column] == accounts[id_column]) & (out.norm == accounts.n2)
        out = out.join(accounts, clash, "left_anti")
    return out


def context(text: Column, start: Column, end: Column) -> Column:
    """A match with 40 characters around it, white space collapsed, at most 80 characters."""
    first = F.greatest(F.lit(0), start - 40)
    cut = text.substr(first + 1, F.least(F.length(text), end + 40) - first)
    return F.substring(F.trim(F.regexp_replace(cut, "\\s+", " ")), 1, 80)


def lines(docs: DataFrame, id_column: str) -> DataFrame:
    """Trimmed non-empty lines with their number."""
    return (
        docs.select(id_column, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n+")).alias("line_no", "line"))
        .withColumn("line", F.regexp_replace("line", "^\\s+|\\s+$", ""))
        .where("line <> ''")
    )


def prose(docs: DataFrame, id_column: str) -> DataFrame:
    """Whether at least 40 % of the lines have 8 words or more, no delimiter and under 3 commas."""
    one = F.col("line")
    good = (F.size(F.split(one, "\\s+")) >= 8) & ~one.rlike("[;\\t|]") & (F.length(F.regexp_replace(one, "[^,]", "")) < 3)
    share = lines(docs, id_column).groupBy(id_column).agg(F.avg(F.when(good, 1.0).otherwise(0.0)).alias("share"))
    return docs.select(id_column).join(share, id_column, "left").select(id_column, F.coalesce(F.col("share") >= 0.4, F.lit(False)).alias("prose"))


def structure(docs: DataFrame, id_column: str) -> DataFrame:
    """Structure score and kind: delimiters, repeated column counts, even line lengths, digits."""
    rows = lines(docs, id_column)
    n = rows.groupBy(id_column).agg(F.count(F.lit(1)).alias("n_lines"))
    step = F.when(F.col("n_lines") > 400, F.ceil(F.col("n_lines") / 400)).otherwise(1)
    w = Window.partitionBy(id_column).orderBy("line_no")
    rows = rows.withColumn("i", F.row_number().over(w) - 1).join(n, id_column).where(F.col("i") % step == 0)
    fields = lambda ch: F.size(F.filter(F.split("line", ch), lambda p: F.trim(p) != ""))
    marks = ["\\t", "\\|", ";", ","]
    rows = rows.select(id_column, "line", F.array(*[fields(m) for m in marks]).alias("cols"))
    agg = rows.groupBy(id_column).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("cols")[i] >= 3).alias(f"d{i}") for i in range(4)],
        F.avg(F.length("line")).alias("mean"), F.stddev_pop(F.length("line")).alias("sd"),
        F.sum(F.length(F.regexp_replace("line", "[^0-9]", ""))).alias("digits"), F.sum(F.length("line")).alias("chars"),
    )
    most = F.greatest("d0", "d1", "d2", "d3")
    best = F.when(most == 0, -1).when(F.col("d0") == most, 0).when(F.col("d1") == most, 1).when(F.col("d2") == most, 2).otherwise(3)
    agg = agg.withColumns({"most": most, "best": best})
    modes = (
        rows.join(agg.where("best >= 0").select(id_column, "best"), id_column)
        .groupBy(id_column, F.expr("cols[best]").alias("c")).agg(F.count(F.lit(1)).alias("m"))
        .groupBy(id_column).agg(F.max(F.struct("m", "c")).alias("mode"))
    )
    s = (
        F.when(F.col("most") / F.col("n") >= 0.6, 0.45).otherwise(0.0)
        + F.when((F.col("mode.m") / F.col("n") >= 0.7) & (F.col("mode.c") >= 3), 0.3).otherwise(0.0)
        + F.when((F.col("sd") / F.col("mean") < 0.45) & (F.col("n") >= 8), 0.15).otherwise(0.0)
        + F.when(F.col("digits") / F.col("chars") >= 0.25, 0.1).otherwise(0.0)
    )
    score = F.coalesce(F.round(F.least(F.lit(1.0), s), 2), F.lit(0.0))
    return (
        docs.select(id_column).join(agg, id_column, "left").join(modes, id_column, "left").withColumn("score", score)
        .select(id_column, "score", F.when(F.col("score") >= 0.6, "tabular").when(F.col("score") <= 0.25, "narrative").otherwise("mixed").alias("kind"))
    )


def token_estimate(text: Column) -> Column:
    """Conservative token count of a text of at most 12 000 characters."""
    mixed_re = "(?i)" + B0 + "(?=[a-z0-9]*[0-9])(?=[a-z0-9]*[a-z])[a-z0-9]{6,}" + B1
    cjk = F.length(F.regexp_replace(text, "[^\\x{4e00}-\\x{9fff}\\x{3040}-\\x{30ff}\\x{ac00}-\\x{d7af}]", ""))
    without = F.regexp_replace(text, mixed_re, "")
    mixed = F.length(text) - F.length(without)
    digits = F.length(F.regexp_replace(F.regexp_replace(text, mixed_re, " "), "[^0-9]", ""))
    rest = F.length(text) - cjk - mixed - digits
    total = cjk + F.ceil(mixed / 1.8) + F.ceil(digits / 2.0) + F.ceil(F.greatest(F.lit(0), rest) / 3.0)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), total)).cast("long")


# Queries.  ID_TEXT writes known identifiers of every kind into a sentence; the SQL states what must be found.

K = "c_custkey"
ID_TEXT = f"""concat('Call 98', 10000000 + {K} * 37, ' or +44 2', 100000000 + {K}, '; vpa user', {K}, '@okhdfc pays. IFSC HDFC0', right(concat('000000', {K}), 6),
 ' mac 0a:1b:2c:3d:4e:', 10 + {K} % 80, ' plate MH', 10 + {K} % 80, 'AB', 1000 + {K} % 9000, ' PAN ABCDE', 1000 + {K} % 9000, 'F passport K', 1000000 + {K},
 ' on 2024-03-', 10 + {K} % 19, ' for Rs. ', {K}, ',000 A/C no: ', 100000000000 + {K}, ' UTR: N', 10000000 + {K}, ' wallet 0x', right(concat('00000000000000000000000000000000000abcde', {K}), 40),
 ' iban IN77BANK', 1000000000 + {K}, ' by Mr. John Smith of Acme Mills Ltd. visit example', {K} % 9, '.org now')"""


def _probe(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "customer").select("c_custkey"), "c_custkey").select("c_custkey", F.expr(ID_TEXT).alias("text"))


_EXPECT = {
    "x02_phone": (["phone"], f"concat('98', 10000000 + {K} * 37)"),
    "x03_intl_phone": (["intl_phone"], f"concat('+442', 100000000 + {K})"),
    "x05_upi": (["upi"], f"concat('user', {K}, '@okhdfc')"),
    "x06_ifsc": (["ifsc"], f"concat('HDFC0', right(concat('000000', {K}), 6))"),
    "x11_mac": (["mac"], f"concat('0A:1B:2C:3D:4E:', 10 + {K} % 80)"),
    "x12_wallet": (["eth"], f"concat('0x', right(concat('00000000000000000000000000000000000abcde', {K}), 40))"),
    "x13_vehicle": (["vehicle"], f"concat('MH', 10 + {K} % 80, 'AB', 1000 + {K} % 9000)"),
    "x14_date": (["date"], f"concat('2024-03-', 10 + {K} % 19)"),
    "x15_amount": (["amount"], f"concat({K}, '000.00')"),
    "x16_pan": (["pan"], f"concat('ABCDE', 1000 + {K} % 9000, 'F')"),
    "x16_passport": (["passport"], f"concat('K', 1000000 + {K})"),
    "x17_person": (["salutation", "labelled_name"], "'John Smith'"),
    "x19_account": (["account"], f"concat('', 100000000000 + {K})"),
    "x20_iban": (["iban"], f"concat('in77bank', 1000000000 + {K})"),
    "x21_reference": (["reference"], f"concat('N', 10000000 + {K})"),
}


def _register(name: str, rules: list[str], norm: str) -> None:
    @query(name, f"SELECT c_custkey, '{RULES[rules[0]].type}' AS type, {norm} AS norm FROM customer WHERE c_custkey > 0")
    def run(spark, d):
        return extract(_probe(spark, d).where("c_custkey > 0"), "c_custkey", rules).select("c_custkey", "type", "norm")


for _name, (_rules, _norm) in _EXPECT.items():
    _register(_name, _rules, _norm)


@query("x18_organization")
def x18(spark, d):
    return extract(_probe(spark, d), "c_custkey", ["organization"])


@query("x10_imei")
def x10(spark, d):
    t = spread(table(spark, d, "customer").select("c_custkey"), "c_custkey").select("c_custkey", F.expr("concat('imei ', 350000000000000 + c_custkey * 7, ' seen')").alias("text"))
    return extract(t, "c_custkey", ["imei"])


@query(
    "x04_email",
    r"""SELECT DISTINCT doc_id, 'email' AS type, lower(m) AS norm FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS m FROM documents)""",
)
def x04(spark, d):
    return extract(spread(table(spark, d, "documents"), "doc_id"), "doc_id", ["email"]).select("doc_id", "type", "norm")


@query(
    "x07_ip",
    r"""SELECT DISTINCT doc_id, 'ip' AS type, array_to_string(list_transform(string_split(m, '.'), lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), '.') AS norm
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b')) AS m FROM documents)
WHERE len(list_filter(string_split(m, '.'), lambda x: CAST(x AS INTEGER) > 255)) = 0""",
)
def x07(spark, d):
    return extract(spread(table(spark, d, "documents"), "doc_id"), "doc_id", ["ip"]).select("doc_id", "type", "norm")


@query("x08_url", r"""SELECT page_id, 'url' AS type, lower(regexp_extract(url, '^([A-Za-z]+://[^/?#:]+)', 1)) AS norm FROM pages WHERE url LIKE 'http%'""")
def x08(spark, d):
    return extract(table(spark, d, "pages").select("page_id", F.concat(F.lit("see "), "url").alias("text")), "page_id", ["url"]).select("page_id", "type", "norm")


@query("x09_domain", f"SELECT c_custkey, 'domain' AS type, concat('example', {K} % 9, '.org') AS norm FROM customer")
def x09(spark, d):
    return extract(_probe(spark, d), "c_custkey", ["domain"]).where("norm LIKE 'example%'").select("c_custkey", "type", "norm")


@query("x01_entities")
def x01(spark, d):
    return extract(spread(table(spark, d, "documents"), "doc_id"), "doc_id")


@query(
    "x26_context",
    r"SELECT doc_id, left(trim(regexp_replace(substr(text, greatest(0, instr(text, 'the') - 41) + 1, least(length(text), instr(text, 'the') + 42) - greatest(0, instr(text, 'the') - 41)), '\s+', ' ', 'g')), 80) AS context FROM documents WHERE instr(text, 'the') > 0",
)
def x26(spark, d):
    at = F.instr("text", "the")
    t = table(spark, d, "documents").where(at > 0)
    return t.select("doc_id", context(F.col("text"), at - 1, at + 2).alias("context"))


_LINES = r"""l AS (SELECT doc_id, i, regexp_replace(x, '^\s+|\s+$', '', 'g') AS line FROM (
  SELECT doc_id, unnest(regexp_split_to_array(text, '\n+')) AS x, generate_subscripts(regexp_split_to_array(text, '\n+'), 1) AS i FROM documents)
  WHERE regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')"""


@query(
    "x47_prose",
    rf"""WITH {_LINES}, g AS (SELECT doc_id, avg(CASE WHEN len(regexp_split_to_array(line, '\s+')) >= 8 AND NOT regexp_matches(line, '[;\t|]')
  AND length(regexp_replace(line, '[^,]', '', 'g')) < 3 THEN 1.0 ELSE 0.0 END) AS s FROM l GROUP BY 1)
SELECT d.doc_id, coalesce(s >= 0.4, false) AS prose FROM documents d LEFT JOIN g USING (doc_id)""",
)
def x47(spark, d):
    return prose(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


_COUNTS = ", ".join(f"len(list_filter(string_split(line, {c}), lambda p: trim(p) <> '')) AS c{i}" for i, c in enumerate(("chr(9)", "'|'", "';'", "','")))


@query(
    "x46_structure",
    f"""WITH {_LINES}, f AS (SELECT doc_id, line, {_COUNTS} FROM l),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE c0 >= 3) AS d0, count(*) FILTER (WHERE c1 >= 3) AS d1, count(*) FILTER (WHERE c2 >= 3) AS d2,
  count(*) FILTER (WHERE c3 >= 3) AS d3, avg(length(line)) AS mean, stddev_pop(length(line)) AS sd,
  sum(length(regexp_replace(line, '[^0-9]', '', 'g'))) AS digits, sum(length(line)) AS chars FROM f GROUP BY 1),
b AS (SELECT *, greatest(d0, d1, d2, d3) AS most FROM a),
c AS (SELECT *, CASE WHEN most = 0 THEN -1 WHEN d0 = most THEN 0 WHEN d1 = most THEN 1 WHEN d2 = most THEN 2 ELSE 3 END AS best FROM b),
m AS (SELECT doc_id, c, count(*) AS m FROM (SELECT f.doc_id, [c0, c1, c2, c3][best + 1] AS c FROM f JOIN c USING (doc_id) WHERE best >= 0) GROUP BY 1, 2),
o AS (SELECT doc_id, max(m * 1000000 + c) AS mc FROM m GROUP BY 1),
s AS (SELECT d.doc_id, coalesce(round(least(1, CASE WHEN most / n >= 0.6 THEN 0.45 ELSE 0 END + CASE WHEN (mc // 1000000) / n >= 0.7 AND mc % 1000000 >= 3 THEN 0.3 ELSE 0 END
  + CASE WHEN sd / mean < 0.45 AND n >= 8 THEN 0.15 ELSE 0 END + CASE WHEN digits / chars >= 0.25 THEN 0.1 ELSE 0 END), 2), 0)::DOUBLE AS score
  FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id))
SELECT doc_id, score, CASE WHEN score >= 0.6 THEN 'tabular' WHEN score <= 0.25 THEN 'narrative' ELSE 'mixed' END AS kind FROM s""",
)
def x46(spark, d):
    return structure(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


@query(
    "x49_token_estimate",
    "SELECT c_custkey, CAST(CASE WHEN c_custkey % 2 = 0 THEN ceil((length(c_mktsegment) + 1) / 3.0) + 4 ELSE ceil(length(c_mktsegment) / 3.0) END AS BIGINT) AS tokens FROM customer",
)
def x49(spark, d):
    t = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit(" 1234567"))).otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", token_estimate(t).alias("tokens"))
