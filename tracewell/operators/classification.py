"""Evidence classes by weighted rules over a file's name and the beginning of its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.adapters import spread, table

# Phrases that speak strongly and weakly for a class, and patterns with weight and greatest sum.
STRONG, IN_NAME, WEAK, CAP, LEAST, HEAD, MOST_MATCHES = 0.35, 0.45, 0.08, 1.4, 0.25, 20_000, 40
RULES: dict[str, tuple[str, str, list[tuple[str, float, float]]]] = {
    "fir": (
        "first information report|fir no|f.i.r|police station|complainant|informant",
        "investigating officer|io |case crime number|sections 4|ipc section|bns section",
        [(r"\b(?:u/s|under section)\s+\d+[a-z]?\s*(?:ipc|bns)?", 0.15, 0.3), (r"\b\d{4}\s*/\s*fir\b|\bfir\s*/?\s*\d{2,4}\b", 0.2, 0.4)],
    ),
    "bank_statement": (
        "statement of account|account statement|closing balance|opening balance|ifsc|transaction remark|branch address|available balance",
        "debit|credit|balance|withdrawal|deposit|narration|utr|value date|transaction date|cr |dr |ref no|chq no|cheque number|particulars",
        [
            (r"\b(txn|value|trans)\s*date\b[\s\S]{0,80}\b(debit|credit|withdrawal|deposit)\b", 0.12, 0.24),
            (r"\bbalance\b[^\n]{0,30}\bdebit\b[^\n]{0,30}\bcredit\b", 0.18, 0.36), (r"\b(imps|neft|rtgs|upi)[\s/-][crd]{1,2}[\s/-]", 0.12, 0.36),
        ],
    ),
    "cdr": (
        "call detail record|call details record|cdr report|cell id|first cell id|last cell id|calling number|called number|dialed number|cell tower|traffic direction",
        "incoming|outgoing|roaming|imei|imsi|duration (sec)|b party|a party|tower|duration",
        [(r"\b\d{10,15}\b\s*,\s*\d{10,15}\b", 0.1, 0.3), (r"\b\d{15}\b", 0.08, 0.24), (r"(?:calling|called)[^\n]{0,20}number[^\n]{0,60}cell", 0.15, 0.3)],
    ),
    "whatsapp_chat": (
        "messages and calls are end-to-end encrypted|whatsapp chat with",
        "<media omitted>|this message was deleted|missed voice call|missed video call",
        [
            (r"(?m)^\[\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4},\s*\d{1,2}:\d{2}(:\d{2})?\s*(?:am|pm|AM|PM)?\]", 0.12, 0.5),
            (r"(?m)^\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4},?\s+\d{1,2}:\d{2}\s*-\s", 0.12, 0.5),
        ],
    ),
    "invoice": (
        "tax invoice|invoice no|invoice number|gst invoice|bill no|taxable value",
        "hsn|sac code|cgst|sgst|igst|total amount due|due date|purchase order", [],
    ),
    "receipt": ("payment receipt|amount received|received with thanks|cash receipt|paid receipt", "receipt no|received from|towards payment|rupees in words", []),
    "id_document": (
        "aadhaar|aadhar|unique identification|pan card|permanent account number card|passport no|driving licence|voter id",
        "date of birth|dob:|male / female|enrollment no|vid ", [(r"\b\d{4}\s?\d{4}\s?\d{4}\b", 0.18, 0.36)],
    ),
    "contract": (
        "this agreement|agreement made|witnesseth|whereas the parties|memorandum of understanding|terms and conditions of",
        "the party of the first part|the party of the second part|shall be binding|in witness whereof|clause", [],
    ),
    "email": (
        "message/rfc822|delivered-to|return-path|x-mailer|received: by|mime-version:",
        "subject:|from:|to:|cc:|reply-to|unsubscribe|regards,|dear sir|forwarded message", [(r"(?m)^(from|to|subject|date):\s", 0.1, 0.4)],
    ),
    "court_document": (
        "in the court of|hon'ble|honorable court| writ petition|affidavit|charge sheet|chargesheet|summons",
        "petitioner|respondent|plaintiff|defendant|judgment|decree|counsel|court hall", [],
    ),
    "property_document": (
        "sale deed|title deed|gift deed|lease deed|registry|mutation|khatauni|khasra|sale certificate",
        "property no|survey no|plot no|square feet|stamped|sub-registrar|registrar office", [],
    ),
    "travel_record": ("boarding pass|pnr|e-ticket|eticket|irctc|flight ticket|air ticket", "departure|arrival|gate|seat no|class of travel|coach|berth", []),
    "social_media": (
        "facebook|instagram|twitter|linkedin|telegram chat|snapchat", "followers|following|likes|retweet|share|profile picture|friend request", [],
    ),
    "medical_record": ("medical record|discharge summary|prescription|diagnosis|opd|ipd", "hospital|patient|doctor|dr.|medicine|dosage|treatment", []),
    "ledger": ("ledger|day book|cash book|hisab|khata|bahikhata", "debit|credit|balance b/f|balance c/f|carried forward", []),
    "letter": (
        "letter of recommendation|reference letter|offer letter|experience letter|cover letter|show cause notice|demand letter|legal notice|letter of intent",
        "dear sir|dear madam|to whom it may concern|yours faithfully|yours sincerely|with regards|subject:|re:|dated this|enclosed herewith|kindly find attached",
        [(r"\b(?:ref|reference)\s*(?:no\.?|number|#)\s*[:\-]?\s*[a-z0-9/-]{3,}", 0.12, 0.24), (r"\bsubject\s*:[^\n]{10,}", 0.1, 0.2)],
    ),
    "certificate": (
        "this is to certify|certificate of|bonafide certificate|bonafide|character certificate|transfer certificate|migration certificate|death certificate|birth certificate|registration certificate",
        "certified that|issued on|certificate no|registration no|place of issue", [(r"\bcertificate\s*(?:no\.?|number|#)\s*[:\-]?\s*[a-z0-9/-]{3,}", 0.18, 0.36)],
    ),
    "academic_document": (
        "marksheet|mark sheet|statement of marks|transcript of records|academic transcript|score card|semester grade|consolidated marksheet",
        "roll no|enrollment number|registration number|cgpa|sgpa|semester|university examination|board of examination|passed with division|result declared",
        [(r"\b(?:roll|enrol{1,2}ment|registration)\s*(?:no\.?|number|#)\s*[:\-]?\s*[a-z0-9/-]{4,}", 0.14, 0.28)],
    ),
    "application": (
        "application form|application for|form no|applicant name|name of applicant|duly filled|applicant signature",
        "date of birth|father name|mother name|nationality|occupation|annual income|declaration|signature of applicant|place:|pin code",
        [(r"\bfield\s*(?:no\.?|#)?\s*[:\-]\s*.{2,40}", 0.06, 0.18)],
    ),
}
#: A number of an account that a balance follows on its line; a lookahead, which not every engine has.
ACCOUNT_BALANCE = (r"\b\d{9,18}\b(?=.*balance)", 0.1, 0.2)
CHAT_LINE, CHAT_LINES, CHAT_BOOST = r"(?m)^\[\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}", 5, 0.4
IMAGE_NAME, SCREENSHOT_NAME = r"\.(png|jpe?g|webp|bmp|gif)$", "screenshot|screen[_-]?shot|screencapture"
# How other words for a class are read, in their order.
SYNONYMS = [
    (r"\bf\.?i\.?r\b|first information|police report|police complaint", "fir"),
    (r"bank[\s_-]*(statement|acct?ount)?|account statement|passbook|statement of account", "bank_statement"),
    (r"call[\s_-]*detail[sd]?[\s_-]*record|\bcd?r\b|call log|cell tower dump", "cdr"),
    (r"whats?app|wa[\s_-]*chat|chat[\s_-]*export|telegram(?!.*social)|instant message|im chat|signal chat|messenger chat", "whatsapp_chat"),
    (r"invoice|bill of|tax bill|purchase order", "invoice"),
    (r"receipt|payment proof|amount received", "receipt"),
    (r"aadhaa?r|pan card|passport|driving licen[cs]e|voter[\s_-]*id|id card|identity (card|document)|kyc document", "id_document"),
    (r"contract|agreement|mou|memorandum of understanding|deed of|lease agreement|terms of service", "contract"),
    (r"e-?mail|rfc822|eml", "email"),
    (r"court|judgment|judgement|charge ?sheet|summons|writ|petition|affidavit|fir copy", "court_document"),
    (r"sale deed|title deed|gift deed|property|registry|mutation|land record|khatauni", "property_document"),
    (r"boarding pass|\bpnr\b|e-?ticket|air ticket|flight|railway ticket|irctc|travel", "travel_record"),
    (r"social media|facebook|instagram|twitter|linkedin|snapchat|post(s)? from", "social_media"),
    (r"medical|discharge summary|prescription|diagnosis|hospital bill", "medical_record"),
    (r"screenshot|screen shot|screen capture|image capture", "screenshot"),
    (r"ledger|cash book|day book|khata|hisaab|accounts book", "ledger"),
    (r"letter of recommend|recommendation letter|reference letter|cover letter|correspondence|official letter|letter$", "letter"),
    (r"certificate|bonafide|bona fide|no objection|noc$", "certificate"),
    (r"academic|transcript|mark ?sheet|marksheet|grade (card|sheet)|score ?card|university document|school document", "academic_document"),
    (r"application( form)?|form submission|nomination", "application"),
]
CLASSES = [*RULES, "screenshot", "other"]


def _said(text: Column, phrases: str, weight: float) -> Column:
    return sum((F.when(F.contains(text, F.lit(p)), weight).otherwise(0.0) for p in phrases.split("|")), F.lit(0.0))


def _counted(text: Column, pattern: str, weight: float, most: float) -> Column:
    return F.least(F.lit(most), weight * F.least(F.regexp_count(text, F.lit(pattern)), F.lit(MOST_MATCHES)))


def classify(docs: DataFrame, id_column: str, name: Column | None = None, is_email: Column | None = None) -> DataFrame:
    """class, confidence, runner_up of each row of ``docs`` (id, text): one pass, no shuffle.

    A class's score adds its phrases in the file name and in the first 20,000 characters, and its patterns'
    matches; 1.4 at most.  The best score below 0.25 is ``other``.  Ties go to the class first in the rules.
    Null texts and names are empty.
    """
    empty = F.lit("")
    base = docs.select(
        id_column, F.substring(F.lower(F.coalesce("text", empty)), 1, HEAD).alias("t"), F.lower(F.coalesce(name if name is not None else empty, empty)).alias("f"),
        F.coalesce(is_email if is_email is not None else F.lit(False), F.lit(False)).alias("e"),
    )
    t, f, scores = F.col("t"), F.col("f"), []
    for k, (label, (strong, weak, patterns)) in enumerate(RULES.items()):
        extra = [ACCOUNT_BALANCE] if label == "bank_statement" else []
        score = _said(f, strong, IN_NAME) + _said(t, strong, STRONG) + _said(t, weak, WEAK)
        score = score + sum((_counted(t, *p) for p in (*patterns, *extra)), F.lit(0.0))
        if label == "email":
            score = score + F.when(F.col("e"), 0.7).otherwise(0.0)
        if label == "whatsapp_chat":
            score = score + F.when(F.regexp_count(t, F.lit(CHAT_LINE)) >= CHAT_LINES, CHAT_BOOST).otherwise(0.0)
        scores.append((label, score, k))
    shot = F.when(f.rlike(SCREENSHOT_NAME), 0.6).otherwise(0.0) + F.when(f.rlike(IMAGE_NAME), 0.25).otherwise(0.0)
    scores.append(("screenshot", shot, len(scores)))
    # The scores of one row as an array: an explode between the sums and their use keeps the plan small.
    listed = F.array(*[F.struct(F.least(F.lit(CAP), F.round(s, 6)).alias("s"), F.lit(-k).alias("k"), F.lit(c).alias("c")) for c, s, k in scores])
    rows = base.select(id_column, F.explode(F.array(listed)).alias("all")).withColumn("ranked", F.sort_array(F.filter("all", lambda x: x["s"] > 0), False))
    top, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    ok = F.coalesce(top["s"] >= LEAST, F.lit(False))
    share = F.round(top["s"] / (top["s"] + F.coalesce(second["s"], F.lit(0.2)) + 0.15), 2)
    return rows.select(
        id_column, F.when(ok, top["c"]).otherwise("other").alias("class"),
        F.when(ok, F.least(F.lit(0.95), share)).otherwise(F.least(F.lit(0.24), F.coalesce(top["s"], F.lit(0.0)))).alias("confidence"),
        F.when(ok, second["c"]).alias("runner_up"),
    )


def class_name(raw: Column) -> Column:
    """The class that a label means, null if none: the class's own name, with or without a filler word, then synonyms."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), r"[\s-]+", "_")
    bare = F.regexp_replace(s, "(_?(copy|scan|doc(ument)?|file|pdf))$", "")
    phrase = F.regexp_replace(s, "_", " ")
    out = F.when(s == "", F.lit(None).cast("string")).when(s.isin(CLASSES), s).when(bare.isin(CLASSES), bare)
    for pattern, label in SYNONYMS:
        out = out.when(phrase.rlike(pattern), label)
    return out


def arbitrate(model: Column, model_confidence: Column, rules: Column, rules_confidence: Column) -> Column:
    """struct(class, confidence) out of a model's and the rules' class; a null class is missing.

    Equal classes take the higher confidence; the rules win over a model's ``other`` and over a model that is
    not nearly certain (0.95, and 0.3 above the rules).
    """
    both = model.isNotNull() & rules.isNotNull()
    other = (model == "other") & (rules != "other")
    sure = (model_confidence >= 0.95) & (model_confidence >= rules_confidence + 0.3)
    take_model = F.when(~both, model.isNotNull()).when(model == rules, True).when(other, False).when(rules == "other", True).otherwise(sure)
    shown = F.when(both & (model == rules), F.greatest(model_confidence, rules_confidence)).when(take_model, model_confidence).otherwise(rules_confidence)
    return F.struct(F.when(take_model, model).otherwise(rules).alias("class"), shown.alias("confidence"))


def _sql(text: str, name: str, email: str) -> str:
    """The same rules for DuckDB, a row for each class; the lookahead is a search in the line's part before its last balance."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    said = lambda col, phrases, w: " + ".join(f"CASE WHEN contains({col}, {quote(p)}) THEN {w} ELSE 0 END" for p in phrases.split("|"))
    count = lambda p: f"least({MOST_MATCHES}, len(regexp_extract_all(t, {quote(p)})))"
    parts = []
    for k, (label, (strong, weak, patterns)) in enumerate(RULES.items()):
        score = [said("f", strong, IN_NAME), said("t", strong, STRONG), said("t", weak, WEAK), *[f"least({m}, {w} * {count(p)})" for p, w, m in patterns]]
        if label == "bank_statement":
            line = r"list_sum(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN contains(x, 'balance') THEN len(regexp_extract_all(left(x, length(x) - strpos(reverse(x), 'ecnalab') - 5), '\b\d{9,18}\b')) ELSE 0 END))"
            score.append(f"least(0.2, 0.1 * least({MOST_MATCHES}, coalesce({line}, 0)))")
        if label == "email":
            score.append("CASE WHEN e THEN 0.7 ELSE 0 END")
        if label == "whatsapp_chat":
            score.append(f"CASE WHEN len(regexp_extract_all(t, {quote(CHAT_LINE)})) >= {CHAT_LINES} THEN {CHAT_BOOST} ELSE 0 END")
        parts.append((label, k, " + ".join(score)))
    parts.append(("screenshot", len(parts), f"CASE WHEN regexp_matches(f, {quote(SCREENSHOT_NAME)}) THEN 0.6 ELSE 0 END + CASE WHEN regexp_matches(f, {quote(IMAGE_NAME)}) THEN 0.25 ELSE 0 END"))
    union = " UNION ALL ".join(f"SELECT id, '{c}' AS class, {k} AS k, least({CAP}, round(({s})::DOUBLE, 6)) AS s FROM b" for c, k, s in parts)
    return f"""b AS (SELECT id, left(lower(coalesce({text}, '')), {HEAD}) AS t, lower(coalesce({name}, '')) AS f, {email} AS e FROM d),
s AS ({union}), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, k) AS r FROM s WHERE s > 0),
a AS (SELECT id, max(CASE WHEN r = 1 THEN class END) AS class, max(CASE WHEN r = 1 THEN s END) AS s, max(CASE WHEN r = 2 THEN class END) AS c2, max(CASE WHEN r = 2 THEN s END) AS s2 FROM k GROUP BY 1)
SELECT d.id, CASE WHEN s >= {LEAST} THEN class ELSE 'other' END AS class,
  CASE WHEN s >= {LEAST} THEN least(0.95, round(s / (s + coalesce(s2, 0.2) + 0.15), 2)) ELSE least(0.24, coalesce(s, 0)) END AS confidence,
  CASE WHEN s >= {LEAST} THEN c2 END AS runner_up FROM d LEFT JOIN a USING (id)"""


@query("x44_classify", "WITH d AS (SELECT doc_id AS id, text, source FROM documents), " + _sql("text", "source", "false"))
def x44(spark: SparkSession, d: str) -> DataFrame:
    return classify(spread(table(spark, d, "documents"), "doc_id").withColumnRenamed("doc_id", "id"), "id", F.col("source"))


_PHRASES = [p for strong, _, _ in RULES.values() for p in strong.split("|")]
#: One strong phrase, weak words around it, lines for some patterns, and a name; all by the order's number.
_TEXT = (
    "concat('Page ', k, chr(10), 'the ', p, ' of ', o_clerk_, chr(10), CASE k % 6 WHEN 0 THEN 'debit 5 credit 7 balance' WHEN 1 THEN '1234567890, 9876543210 incoming' "
    "WHEN 2 THEN 'dear sir, subject: payment of the dues' WHEN 3 THEN 'acct 123456789012 balance 5' WHEN 4 THEN '[01/02/24, 10:30] a: b' ELSE 'under section 420 ipc' END)"
)
_NAME = "CASE k % 4 WHEN 0 THEN 'Screenshot_1.PNG' WHEN 1 THEN 'Ledger.xlsx' WHEN 2 THEN NULL ELSE 'a.txt' END"


@query(
    "x44_classes",
    "WITH p AS (SELECT * FROM (VALUES " + ", ".join("({}, '{}')".format(i, p.replace("'", "''")) for i, p in enumerate(_PHRASES)) + ") v(i, p)),\n"
    f"d AS (SELECT o_orderkey AS id, o_orderkey AS k, p, {_TEXT.replace('o_clerk_', 'o_orderpriority')} AS text, {_NAME} AS name FROM orders JOIN p ON i = o_orderkey % {len(_PHRASES)}),\n"
    + _sql("text", "name", "k % 7 = 0"),
)
def x44_classes(spark, d):
    """Every strong phrase of every class, with weak words, patterns, file names and mail marks."""
    o = spread(table(spark, d, "orders"), "o_orderkey").withColumn("k", F.col("o_orderkey")).withColumn("o_clerk_", F.col("o_orderpriority"))
    o = o.withColumn("p", F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), (F.col("k") % len(_PHRASES) + 1).cast("int")))
    docs = o.select(F.col("k").alias("id"), F.expr(_TEXT.replace("chr(", "char(")).alias("text"), F.expr(_NAME).alias("name"), (F.col("k") % 7 == 0).alias("mail"))
    return classify(docs, "id", F.col("name"), F.col("mail"))


_LABELS = ["Bank Statement", "whatsapp", "call detail records", "Aadhaar card", "FIR copy", "invoice_scan", "", "poem", "Letter", "court order"]
_LABEL_WANT = ["bank_statement", "whatsapp_chat", "cdr", "id_document", "fir", "invoice", None, None, "letter", "court_document"]


@query(
    "x45_class_names",
    "SELECT o_orderkey, CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_LABEL_WANT) if w) + " END AS class FROM orders",
)
def x45(spark, d):
    label = F.element_at(F.array(*[F.lit(v) for v in _LABELS]), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", class_name(label).alias("class"))


@query(
    "x45_arbitration",
    """WITH x AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'cdr' WHEN 1 THEN 'other' END AS m, (o_orderkey % 11) / 10.0 AS mc,
  CASE o_orderkey % 5 WHEN 0 THEN 'cdr' WHEN 1 THEN 'other' WHEN 2 THEN 'fir' WHEN 3 THEN 'invoice' END AS r, (o_orderkey % 7) / 10.0 AS rc FROM orders)
SELECT o_orderkey, CASE WHEN r IS NULL THEN m WHEN m IS NULL THEN r WHEN m = r THEN m WHEN m = 'other' THEN r WHEN r = 'other' THEN m WHEN mc >= 0.95 AND mc >= rc + 0.3 THEN m ELSE r END AS class FROM x""",
)
def x45_arbitration(spark, d):
    k = F.col("o_orderkey")
    m, r = F.when(k % 3 == 0, "cdr").when(k % 3 == 1, "other"), F.when(k % 5 == 0, "cdr").when(k % 5 == 1, "other").when(k % 5 == 2, "fir").when(k % 5 == 3, "invoice")
    return table(spark, d, "orders").select("o_orderkey", arbitrate(m, (k % 11) / 10.0, r, (k % 7) / 10.0)["class"].alias("class"))


@query("x54_model_class", "SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'bank_statement' ELSE 'other' END AS class, CAST(least(1, (o_orderkey % 13) / 10.0) AS DOUBLE) AS confidence FROM orders")
def x54(spark, d):
    """The class a model named, read into the known classes, and its confidence held to 0..1."""
    k = F.col("o_orderkey")
    label = F.when(k % 2 == 0, "account statement (scanned)").otherwise("a poem")
    return table(spark, d, "orders").select(
        "o_orderkey", F.coalesce(class_name(label), F.lit("other")).alias("class"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((k % 13) / 10.0).cast("double"))).alias("confidence")
    )
