"""Transactions out of text: JSON ledgers, delimited ledgers, statement lines and free lines.

Statement and free lines are expressions over the exploded lines.  JSON and delimited ledgers need a
parser and run in one pass over the documents.  Of the four readings of a document the first with a row counts.
"""

from __future__ import annotations

import csv
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalize
from ..plans.registry import query
from ..sources.adapters import TX, transactions
from ..sources.perdoc import per_document
from .extract import RULES

FIELDS = ["txn_date", "amount", "sender", "receiver", "account_no", "utr", "upi", "ifsc", "bank", "wallet", "merchant", "status", "remarks"]

# Words for the status in the order in which they are looked for.
STATUS = {
    "debited": "debit", "debit": "debit", "dr": "debit", "sent": "debit", "paid": "debit", "withdrawn": "debit", "transferred": "debit",
    "credited": "credit", "credit": "credit", "cr": "credit", "received": "credit", "deposited": "credit", "added": "credit",
    "success": "success", "successful": "success", "failed": "failed", "failure": "failed", "pending": "pending", "reversed": "reversed",
}
# The column headers of delimited ledgers.
HEADERS = {
    "txn_date": "date txn_date transaction_date value_date",
    "amount": "amount amt value debit credit withdrawal deposit withdrawl paid_out paid_in",
    "sender": "sender sender_account from from_account",
    "receiver": "receiver receiver_account to to_account",
    "account_no": "account account_no account_number acct",
    "utr": "utr utr_no utr_number ref reference reference_no ref_no chq_no cheque_no chq_ref_no cheque_ref chq_ref transaction_id txn_id",
    "upi": "upi upi_id vpa",
    "ifsc": "ifsc ifsc_code",
    "bank": "bank bank_name",
    "wallet": "wallet",
    "merchant": "merchant payee",
    "status": "status",
    "remarks": "remarks remark narration description desc details",
}
ALIAS = {h: field for field, hs in HEADERS.items() for h in hs.split()}
OUT_COLUMNS = set("withdrawal withdrawl debit paid_out dr".split())
IN_COLUMNS = set("deposit credit paid_in cr".split())
# The keys of JSON ledgers.
KEYS = {
    "sender": "from_account sender_account sender from src source",
    "receiver": "to_account receiver_account receiver to dst target payee",
    "amount": "amount amt value",
    "txn_date": "date txn_date transaction_date timestamp txnDate",
    "utr": "ref reference utr utr_no ref_no rrn txn_id",
    "upi": "upi upi_id vpa",
    "mode": "mode type channel",
    "note": "note narration remarks description",
}
# Patterns of statements.
_DATE = r"^([0-9]{1,2}[-/. ](?i:[0-9]{1,2}|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(?i:[a-z]*)[-/. ][0-9]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2})"
_GROUPED = r"([0-9]{1,3}(?:,[0-9]{2,3})+(?:\.[0-9]{1,2})?|[0-9]{4,}(?:\.[0-9]{1,2})?)"
_DIRECTION = r"\b(debit|credit|dr|cr|withdrawal|deposit|withdrawn|deposited|paid|received)\b"
_OWN = r"(?i)\b(?:account\s*(?:no|number)?|a\s*/\s*c\s*(?:no|number)?|acct\.?\s*(?:no|number)?)\s*[:\-]\s*([0-9][0-9 \t-]{7,17}[0-9])"
_LABELLED = r"(?i)\b(?:A/c(?:count)?|Acct|Ac|Account\s*No\.?|Account\s*Number|Wallet)\s*[:\-]?\s*([Xx0-9][Xx0-9\- ]{6,17})\b"
_OTHER = r"(?i)\b(?:to|from|by)\s+(?:A/c(?:count)?|Acct|Ac|Account\s*No\.?|Wallet)\s*[:\-]?\s*([Xx0-9][Xx0-9\- ]{6,17})\b"
_DEBITED = r"(?i)\b(?:debited\s+from|sent\s+from|paid\s+from|withdrawn\s+from|dr\.?\s+from|transferred\s+from|debited\s+to\s+your)\b"
_CREDITED = r"(?i)\b(?:credited\s+to|received\s+by|cr\.?\s+to|deposited\s+to|added\s+to)\b"
_UPI = r"(?i)\b([\w.\-]{2,}@[a-z]{2,})\b"
_PARTY = r"(?:^|[\s\-–])(?:TO|FROM|DR|CR|PAID TO|RECV)[-–\s]+([A-Z][A-Za-z&.' ]{3,48})(?:$|[.,;])"
_FIRM = (
    r"(?i)\b(pvt|ltd|llp|inc|corp|bank|enterprises|traders|trading|logistics|imports|exports|finance|services|retail|wholesale|brokers|co|"
    r"company|hotel|pharma|distributors|associates|agencies|motors|industries|infotech|solutions)\b"
)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """First match, null if there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _step(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns that later expressions take as they are, not written out again."""
    own = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("step_")
    return df.select("*", own).select(*df.columns, "step_.*")


def _match(name: str, text: Column) -> Column:
    return F.regexp_extract(text, RULES[name].pattern, RULES[name].group)


def _norm(name: str, found: str) -> Column:
    return F.nullif(RULES[name].norm(F.col(found)), F.lit(""))


def status(text: Column) -> Column:
    """Status of the first keyword, in the order of the keywords, that stands in the text; null if none does."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(rf"\b{word}\b"), kind) for word, kind in STATUS.items()])


def statement_account(text: Column) -> Column:
    """The account that a statement's first 4,000 characters declare as its own (9 to 18 digits), else null."""
    found = F.regexp_extract_all(F.substring(text, 1, 4000), F.lit(_OWN), F.lit(1))
    plain = F.transform(found, lambda x: F.regexp_replace(x, "[^0-9]", ""))
    return F.get(F.filter(plain, lambda x: F.length(x).between(9, 18)), F.lit(0))


def counterparty(remarks: Column, own: Column) -> Column:
    """struct(account, upi, name) of the other party in a narration; a name counts only without the others."""
    r = F.coalesce(remarks, F.lit(""))
    upi = _found(r, _UPI)
    account = F.get(F.filter(F.regexp_extract_all(r, F.lit(r"\b([0-9]{9,18})\b"), F.lit(1)), lambda x: ~x.eqNullSafe(own)), F.lit(0))
    name = F.regexp_replace(F.trim(F.regexp_extract(r, _PARTY, 1)), r"\s+", " ")
    words = F.size(F.split(name, " "))
    ok = account.isNull() & upi.isNull() & (words >= 2) & (name.rlike(_FIRM) | (words <= 4))
    return F.struct(account.alias("account"), upi.alias("upi"), F.when(ok, name).alias("name"))


def lines(docs: DataFrame, id_column: str) -> DataFrame:
    """The id, line (from 1) and content of each line that is not blank, and the statement's own account."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    rows = docs.select(id_column, statement_account(text).alias("own"), F.posexplode(F.split(text, "\n")).alias("i", "raw"))
    return rows.select(id_column, "own", (F.col("i") + 1).alias("line"), F.trim("raw").alias("content")).where("content <> ''")


def _complete(rows: DataFrame, id_column: str) -> DataFrame:
    """Rows with all fields; the statement's own account is the side that a row leaves open."""
    for c in FIELDS:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("double" if c == "amount" else "string"))
    rows = _step(rows, other=counterparty(F.concat_ws(" ", "remarks", "merchant"), F.col("own")))
    party = F.coalesce("other.account", "other.upi", "other.name")
    credit = (F.col("status") == "credit") | F.coalesce("remarks", F.lit("")).rlike(r"(?i)\b(cr|credit)\b")
    credit = F.coalesce(credit, F.lit(False))
    open_ = F.col("own").isNotNull() & (F.col("sender").isNull() | F.col("receiver").isNull())
    sender = F.when(open_, F.coalesce("sender", F.when(credit, party).otherwise(F.col("own")))).otherwise(F.col("sender"))
    receiver = F.when(open_, F.coalesce("receiver", F.when(credit, F.col("own")).otherwise(party))).otherwise(F.col("receiver"))
    done = {
        "sender": sender, "receiver": receiver,
        "account_no": F.when(open_, F.coalesce("account_no", "own")).otherwise(F.col("account_no")),
        "upi": F.when(open_, F.coalesce("upi", "other.upi")).otherwise(F.col("upi")),
    }
    return rows.select(id_column, "line", *[done.get(c, F.col(c)).alias(c) for c in FIELDS])


def statement_lines(docs: DataFrame, id_column: str) -> DataFrame:
    """Transactions of lines that begin with a date and hold an amount and a mark of a payment.

    The amount is the first grouped number, or one of four digits, after the date.  Lines of more than
    400 characters are none.  Null texts have no lines.
    """
    c = F.col("content")
    rows = _step(lines(docs, id_column).where(F.length(c) <= 400), date_text=_found(c, _DATE)).where("date_text IS NOT NULL")
    rows = rows.withColumn("rest", F.expr("substring(content, length(date_text) + 1)")).withColumn("low", F.lower(c))
    amount = F.expr("try_cast(replace(number, ',', '') AS double)")
    rows = _step(
        rows, number=_found(F.col("rest"), _GROUPED), utr=_found(c, r"\b([A-Z]{2,6}[0-9]{5,})\b"), upi=_found(c, _UPI),
        account_no=_found(c, r"\b([0-9]{9,18})\b"),
    ).withColumn("amount", amount).where("amount >= 1")
    rows = rows.where(F.col("low").rlike(_DIRECTION) | F.col("utr").isNotNull() | F.col("upi").isNotNull() | F.col("account_no").isNotNull())
    rows = rows.withColumns({
        "status": F.when(F.col("low").rlike(r"\b(credit|cr|deposit|deposited|received)\b"), "credit").otherwise("debit"),
        "remarks": F.substring("content", 1, 200),
        "merchant": F.when(F.col("low").rlike("atm|cash withdrawal"), "ATM"),
        "txn_date": F.coalesce(normalize.date_iso(F.col("date_text")), F.col("date_text")),
    })
    return _complete(rows, id_column)


def free_lines(docs: DataFrame, id_column: str) -> DataFrame:
    """Transactions of lines with an amount or a date, and something that names an account."""
    c = F.col("content")
    rows = _step(
        lines(docs, id_column), labelled=F.regexp_replace(_found(c, _LABELLED), r"[\s-]", ""), named=F.regexp_replace(_found(c, _OTHER), r"[\s-]", ""),
        upi=_match("upi", c), utr=_match("reference", c), ifsc=_match("ifsc", c), date_text=_match("date", c), money=_match("amount", c),
        status=status(c), remarks=F.trim(_found(c, r"(?i)\bRemarks?\s*[:\-]\s*(.+?)$")),
    )
    rows = _step(rows.withColumnsRenamed({"upi": "u", "utr": "r", "ifsc": "f"}), txn_date=_norm("date", "date_text"), amount=_norm("amount", "money").cast("double"),
                 upi=_norm("upi", "u"), utr=_norm("reference", "r"), ifsc=_norm("ifsc", "f"))
    rows = rows.withColumn("named", F.when(~F.col("named").eqNullSafe(F.col("labelled")), F.col("named")))
    rows = rows.where(
        (F.col("amount").isNotNull() | F.col("txn_date").isNotNull())
        & (F.col("labelled").isNotNull() | F.col("named").isNotNull() | F.col("upi").isNotNull() | F.col("utr").isNotNull())
    )
    into = c.rlike(_CREDITED) & ~c.rlike(_DEBITED)
    known = F.col("labelled").isNotNull()
    out = known & (c.rlike(_DEBITED) | (~into & F.col("named").isNotNull()))
    rows = rows.withColumns({
        "sender": F.when(out, F.col("labelled")).when(known & into, F.col("named")),
        "receiver": F.when(out, F.col("named")).when(known & into, F.col("labelled")),
    })
    alone = F.when(known & ~out & ~into, F.col("labelled"))
    rows = rows.withColumn("account_no", F.coalesce(alone, F.when(F.col("sender").isNull() & F.col("receiver").isNull(), F.col("upi"))))
    return _complete(rows, id_column)


def json_rows(text: str | None):
    """Objects of a JSON ledger, nested ones not; each must name both sides, and an amount or a date."""
    text, at, read = text or "", 0, json.JSONDecoder().raw_decode
    while (at := text.find("{", at)) >= 0:
        try:
            found, end = read(text, at)
        except ValueError:
            at += 1
            continue
        at = end
        own = {f: next((str(found[k]) for k in ks.split() if found.get(k) not in (None, "")), None) for f, ks in KEYS.items()}
        if not own["sender"] or not own["receiver"] or own["sender"] == own["receiver"] or not (own["amount"] or own["txn_date"]):
            continue
        yield {
            "line": text.count("\n", 0, end) + 1, "sender": own["sender"][:60], "receiver": own["receiver"][:60], "amount_text": own["amount"],
            "date_text": own["txn_date"], "utr": own["utr"] and own["utr"][:40], "upi": own["upi"], "merchant": own["mode"] and own["mode"][:40],
            "remarks": " ".join(x for x in (own["mode"], own["note"]) if x)[:200] or None, "stage": 0,
        }


def _cells(line: str, mark: str) -> list[str]:
    return next(csv.reader([line], delimiter=mark), [])


def _field(header: str) -> str | None:
    name = header.strip().lower().strip("\"'")
    return ALIAS.get(name) or ALIAS.get(re.sub(r"[\s.\-]+", "_", name))


def csv_rows(text: str | None):
    """Rows of a delimited ledger whose header, one of the first twelve lines, has two known columns or more."""
    kept = [(k + 1, x) for k, x in enumerate((text or "").replace("\r\n", "\n").split("\n")) if x.strip()]
    for mark in ",\t;|":
        for h, (_, line) in enumerate(kept[:12]):
            header = _cells(line, mark)
            fields = [_field(x) for x in header]
            if len(header) < 3 or sum(f is not None for f in fields) < 2:
                continue
            rows = [(k, r) for k, r in ((k, _cells(x, mark)) for k, x in kept[h + 1 :]) if len(header) - 1 <= len(r) <= len(header)]
            if rows:
                yield from (_ledger_row(header, fields, k, r) for k, r in rows)
                return


def _ledger_row(header: list[str], fields: list, line: int, row: list[str]) -> dict:
    out: dict = {"line": line, "stage": 1}
    for name, field, cell in zip(header, fields, row):
        if cell == "":
            continue
        side = re.sub(r"[\s.\-]+", "_", name.strip().lower())
        if side in OUT_COLUMNS or side in IN_COLUMNS:
            out.setdefault("status", "debit" if side in OUT_COLUMNS else "credit")
        if field == "amount":
            out["amount_text"] = cell
        elif field == "txn_date":
            out.setdefault("date_text", cell)
        elif field == "status":
            out["status"] = STATUS.get(cell.strip().lower(), out.get("status"))
        elif field:
            out[field] = cell
    return out


_PARSED = "line int, stage int, sender string, receiver string, account_no string, utr string, upi string, ifsc string, bank string, " \
    "wallet string, merchant string, status string, remarks string, amount_text string, date_text string"


def _parsed(docs: DataFrame, id_column: str, parse) -> DataFrame:
    own = docs.select(id_column, "text", statement_account(F.col("text")).alias("own"))
    rows = per_document(own, id_column, ["text", "own"], lambda t, o: ({"own": o, **r} for r in parse(t)), _PARSED + ", own string")
    plain = F.regexp_extract("date_text", r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    date = F.coalesce(F.nullif(plain, F.lit("")), normalize.date_iso(F.col("date_text")), F.substring("date_text", 1, 24))
    return rows.withColumn("amount", F.expr("try_cast(amount_text AS double)")).withColumn(
        "amount", F.coalesce("amount", normalize.amount(F.col("amount_text")).cast("double"))
    ).withColumn("txn_date", date)


def json_ledger(docs: DataFrame, id_column: str) -> DataFrame:
    return _complete(_parsed(docs, id_column, json_rows), id_column)


def csv_ledger(docs: DataFrame, id_column: str) -> DataFrame:
    rows = _complete(_parsed(docs, id_column, csv_rows), id_column)
    named = F.coalesce("sender", "receiver", "account_no", "upi", "wallet", "utr").isNotNull()
    return rows.where((F.col("amount").isNotNull() | F.col("txn_date").isNotNull()) & named)


def ledger_transactions(docs: DataFrame, id_column: str) -> DataFrame:
    """Transactions of each document by the first reading that finds any; rows of equal content are one.

    Only the rows found are shuffled, never the texts.  A null or empty text has none.
    """
    readings = [json_ledger, csv_ledger, statement_lines, free_lines]
    rows = None
    for k, reading in enumerate(readings):
        own = reading(docs, id_column).withColumn("reading", F.lit(k))
        rows = own if rows is None else rows.unionByName(own)
    best = F.min("reading").over(Window.partitionBy(id_column))
    kept = rows.withColumn("best", best).where("reading = best").drop("best")
    same = [id_column, "txn_date", "amount", "sender", "receiver", "utr", "upi", "wallet", "account_no"]
    rest = [c for c in kept.columns if c not in (*same, "line")]
    return kept.groupBy(*same).agg(F.min(F.struct("line", *rest)).alias("r")).select(*same, "r.line", *[f"r.{c}" for c in rest])


def _account(c: str) -> Column:
    return F.concat(F.lit("50100"), F.lpad(F.substring(c, 2, 20), 7, "0"))


def _statements(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """A generated text for each sending account, of one kind of ledger."""
    t = transactions(spark, d).where("sender <> receiver").withColumn("cents", F.round(F.col("amount") * 100).cast("long") + 100_000)
    money = F.concat((F.col("cents") / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    day, other, ref = F.col("day"), _account("receiver"), F.concat(F.lit("UTR"), F.lpad(F.col("id").cast("string"), 9, "0"))
    if kind == "lines":
        line = F.concat_ws("  ", F.concat_ws("/", F.substring(day, 9, 2), F.substring(day, 6, 2), F.substring(day, 1, 4)), F.lit("DR"), money, ref, F.concat(F.lit("TO "), other))
        head = F.concat(F.lit("STATEMENT OF ACCOUNT\nAccount Number: "), _account("sender"), F.lit("\n\n"))
    elif kind == "csv":
        line = F.concat_ws(",", day, F.concat(F.lit('"Transfer, to '), other, F.lit('"')), money, F.lit(""), ref)
        head = F.concat(F.lit("Account Number: "), _account("sender"), F.lit("\nTxn Date,Narration,Withdrawal,Deposit,Ref No\n"))
    elif kind == "json":
        line = F.to_json(F.struct(_account("sender").alias("from_account"), other.alias("to_account"), money.alias("amount"), day.alias("date"), ref.alias("ref")))
        head = F.lit("")
    else:
        line = F.concat(F.lit("A/c "), _account("sender"), F.lit(": Rs. "), money, F.lit(" paid from savings to A/c "), other, F.lit(" on "), day)
        head = F.lit("")
    g = t.select("sender", F.struct("id", line.alias("x")).alias("r")).groupBy("sender").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return g.select("sender", F.concat(head, F.array_join(F.transform("r", lambda r: r["x"]), "\n")).alias("text"))


#: What each generated row must give.
_WANT = "WITH " + TX + """, w AS (SELECT id, sender, concat('50100', lpad(substr(sender, 2), 7, '0')) AS a, concat('50100', lpad(substr(receiver, 2), 7, '0')) AS b,
  (CAST(round(amount * 100) AS BIGINT) + 100000) / 100.0 AS amount, day, concat('UTR', lpad(CAST(id AS VARCHAR), 9, '0')) AS utr FROM t WHERE sender <> receiver) """


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("case").alias("document"), F.col("sender").alias("account"), F.col("receiver").alias("other"), F.round("amount", 2).alias("amount"), "txn_date", "utr"
    )


def _documents(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return _statements(spark, d, kind).withColumnRenamed("sender", "case")


_SHOWN = _WANT + "SELECT sender AS document, a AS account, b AS other, round(amount, 2) AS amount, day AS txn_date, utr FROM w"


@query("x30_statement_lines", _SHOWN)
def x30(spark: SparkSession, d: str) -> DataFrame:
    return _shown(statement_lines(_documents(spark, d, "lines"), "case"))


@query("x29_csv_ledger", _SHOWN)
def x29(spark, d):
    return _shown(csv_ledger(_documents(spark, d, "csv"), "case"))


@query("x28_json_ledger", _SHOWN)
def x28(spark, d):
    return _shown(json_ledger(_documents(spark, d, "json"), "case"))


@query("x31_free_lines", _WANT + "SELECT sender AS document, a AS account, b AS other, round(amount, 2) AS amount, day AS txn_date, 'debit' AS status FROM w")
def x31(spark, d):
    rows = free_lines(_documents(spark, d, "free"), "case")
    return rows.select(F.col("case").alias("document"), F.col("sender").alias("account"), F.col("receiver").alias("other"), F.round("amount", 2).alias("amount"), "txn_date", "status")


@query("x32_statement_account", _WANT + "SELECT DISTINCT sender AS document, a AS account FROM w")
def x32(spark, d):
    return _documents(spark, d, "lines").select(F.col("case").alias("document"), statement_account(F.col("text")).alias("account"))


@query(
    "x33_status",
    """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'debit' WHEN 1 THEN 'credit' WHEN 2 THEN 'failed' WHEN 3 THEN 'pending' WHEN 4 THEN 'reversed'
  WHEN 5 THEN 'debit' END AS status FROM orders""",
)
def x33(spark, d):
    """Golden lines: the first keyword in the fixed order wins, parts of words do not count."""
    said = ["Rs 5 Debited and credited", "amount RECEIVED, success", "txn failed; pending", "is pending", "was Reversed.", "paid to you", "creditor drafts"]
    text = F.element_at(F.array(*[F.lit(x) for x in said]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", status(text).alias("status"))


@query(
    "x27_transactions",
    _WANT + """SELECT concat(k, sender) AS document, CAST(v AS INTEGER) AS reading, a AS account, b AS other, round(amount, 2) AS amount, day AS txn_date
  FROM w, (VALUES ('json-', 0), ('csv-', 1), ('lines-', 2), ('free-', 3)) x(k, v)
  QUALIFY v < 3 OR row_number() OVER (PARTITION BY k, sender, b, round(amount, 2), day ORDER BY id) = 1""",
)
def x27(spark, d):
    docs = None
    for kind in ("json", "csv", "lines", "free"):
        own = _documents(spark, d, kind).withColumn("case", F.concat(F.lit(f"{kind}-"), "case"))
        docs = own if docs is None else docs.unionByName(own)
    rows = ledger_transactions(docs, "case")
    return rows.select(F.col("case").alias("document"), "reading", F.col("sender").alias("account"), F.col("receiver").alias("other"), F.round("amount", 2).alias("amount"), "txn_date")
