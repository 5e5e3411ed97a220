"""Communications out of text: chat lines of five layouts and call records; who wrote them."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalize
from ..plans.registry import query
from ..sources.adapters import TX, table, transactions
from ..sources.perdoc import per_document
from .extract import extract

# The layouts of a chat line as (platform, pattern, groups of time, sender and body), in their order.
LAYOUTS = [
    ("whatsapp", r"(?i)^\[((?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}),?\s+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\s*(?:AM|PM)?)\]\s+([^:]+):\s+(.+)$", 1, (2,), 3),
    ("whatsapp", r"(?i)^([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4},?\s+[0-9]{1,2}:[0-9]{2}\s*(?:AM|PM)?)\s+-\s+([^:]+):\s+(.+)$", 1, (2,), 3),
    ("telegram", r"(?i)^\[([0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}\s+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)\]\s+([^:]+):\s+(.+)$", 1, (2,), 3),
    ("generic", r"(?i)^([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(?::[0-9]{2})?Z?)\s+(?:<([^>]+)>|([^:]+)):?\s+(.+)$", 1, (2, 3), 4),
    ("irc", r"(?i)^\[([0-9]{1,2}:[0-9]{2})\]\s+<([^>]+)>\s+(.+)$", 1, (2,), 3),
]
_SYSTEM = r"(?i)^(?:messages\s+and\s+calls|end-to-end|alice\s+added|.*\bchanged\b.*\bprofile)"
_PARTNER = r"(?i)(?:Chat with|Direct message with|DM with)\s+([^\n]+)"
_MENTION = r"@([A-Za-z0-9_.]{2,40})"
# The column headers of call records.
CALL_COLUMNS = {
    "source": "calling caller caller_number calling_number a_party a_number from_number from_no origin_number originating_number source_number dialer msisdn_a call_from from",
    "target": "called called_number dialed dialed_number dialled_number b_party b_number to_number to_no destination_number terminating_number target_number callee msisdn_b call_to to",
    "day": "date call_date cdr_date call_datetime start_time start_date_time date_of_call",
    "time": "time call_time start_time_of_day",
    "seconds": "duration duration_secs duration_sec duration_seconds call_duration dur(s) dur_s seconds",
    "imei": "imei imei_a caller_imei device_imei a_imei",
    "direction": "call_type direction traffic_direction type",
    "cell": "cell_id cell_id_first first_cell_id cell_tower tower_id bts_id lac ci site_id",
}


def timestamp_iso(raw: Column) -> Column:
    """ISO form of ISO, day-first and dotted times (UTC); other texts stay as they are."""
    t = F.trim(raw)
    clock = r"^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{2,4}),?\s+([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?\s*(?i:(AM|PM))?$"
    day, month, year, hour, minute, second = (F.regexp_extract(t, clock, k).try_cast("int") for k in range(1, 7))
    half = F.upper(F.regexp_extract(t, clock, 7))
    hour = F.when((half == "PM") & (hour < 12), hour + 12).when((half == "AM") & (hour == 12), 0).otherwise(hour)
    full = F.when(year < 100, year + 2000).otherwise(year)
    made = F.format_string("%04d-%02d-%02dT%02d:%02d:%02d.000Z", full, month, day, hour, minute, F.coalesce(second, F.lit(0)))
    plain = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}) ([0-9]{2}:[0-9]{2}(?::[0-9]{2})?)$"
    return (
        F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}"), F.when(t.endswith("Z"), t).otherwise(F.concat(t, F.lit("Z"))))
        .when(t.rlike(plain), F.concat(F.regexp_replace(t, plain, "$1T$2"), F.when(F.length(t) == 16, ":00.000Z").otherwise(".000Z")))
        .when(t.rlike(clock) & month.between(1, 12) & day.between(1, 31), made)
        .otherwise(t)
    )


def handle(raw: Column) -> Column:
    """A sender's handle: an address, a phone number, or the name as it is."""
    t = F.trim(raw)
    return (
        F.when(t.contains("@") & ~t.startswith("@"), normalize.email(t)).when(t.rlike(r"^\+?[0-9][0-9\s-]{6,}$"), normalize.phone(t)).otherwise(t)
    )


def chat_lines(docs: DataFrame, id_column: str) -> DataFrame:
    """A row for each line of a known layout: platform, sender, receiver, body and time.

    The document's first layout names the platform of all its rows.  The receiver is the partner that
    the first 500 characters name, else the first mention in the body.  Service lines are dropped; a
    null text has no lines.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    partner = F.trim(F.nullif(F.regexp_extract(F.substring(text, 1, 500), _PARTNER, 1), F.lit("")))
    rows = docs.select(id_column, partner.alias("partner"), F.posexplode(F.split(text, "\n")).alias("i", "raw")).withColumn("x", F.trim("raw"))
    found = F.lit(None)
    for name, pattern, at, by, body in reversed(LAYOUTS):
        who = F.coalesce(*[F.nullif(F.trim(F.regexp_extract("x", pattern, k)), F.lit("")) for k in by], F.lit(""))
        parts = F.struct(F.lit(name).alias("layout"), F.regexp_extract("x", pattern, at).alias("time"), who.alias("sender"), F.trim(F.regexp_extract("x", pattern, body)).alias("body"))
        found = F.when(F.col("x").rlike(pattern), parts).otherwise(found)
    rows = rows.select(id_column, "partner", (F.col("i") + 1).alias("line"), F.explode(F.array(found)).alias("m")).where("m IS NOT NULL")
    first = F.first("m.layout").over(Window.partitionBy(id_column).orderBy("line"))
    rows = rows.withColumn("platform", first).where(~F.col("m.body").rlike(_SYSTEM))
    mention = F.nullif(F.regexp_extract("m.body", _MENTION, 1), F.lit(""))
    by_hand = F.when(F.col("partner").contains("@"), normalize.email(F.col("partner"))).when(F.col("partner").rlike(r"^\+?[0-9]"), normalize.phone(F.col("partner")))
    return rows.select(
        id_column, "line", "platform", F.col("m.sender").alias("sender"), handle(F.col("m.sender")).alias("sender_handle"),
        F.coalesce("partner", mention).alias("receiver"), F.when(F.col("partner").isNull(), F.concat(F.lit("@"), mention)).otherwise(by_hand).alias("receiver_handle"),
        F.col("m.body").alias("body"), timestamp_iso(F.col("m.time")).alias("time"),
    )


def _number(x: str) -> bool:
    return bool(re.match(r"^[+\d][\d\s-]*$", x)) and 8 <= sum(c.isdigit() for c in x) <= 15


def call_rows(text: str | None):
    """Rows of a call table whose first line names both parties; repeated (parties, time) count once."""
    kept = [x.strip() for x in re.split(r"\r\n?|\n", text or "") if x.strip()]
    for mark in ",\t;|" if len(kept) >= 4 else "":
        header = [c.strip().lower() for c in next(csv.reader([kept[0]], delimiter=mark))]
        at = {f: next((k for k, h in enumerate(header) if h in names.split()), None) for f, names in CALL_COLUMNS.items()}
        if len(header) < 3 or at["source"] is None or at["target"] is None:
            continue
        seen = set()
        for k, line in enumerate(kept[1:], 2):
            cells = [c.strip() for c in next(csv.reader([line], delimiter=mark), [])]
            row = {f: cells[i] if i is not None and i < len(cells) else "" for f, i in at.items()}
            when = " ".join(x for x in (row["day"], row["time"]) if x)
            key = (row["source"], row["target"], when)
            if len(cells) >= 3 and _number(row["source"]) and _number(row["target"]) and key not in seen:
                seen.add(key)
                yield {"line": k, "when": when, **{f: row[f] or None for f in ("source", "target", "seconds", "imei", "direction", "cell")}}
        return


def call_records(docs: DataFrame, id_column: str) -> DataFrame:
    """Calls of each document that is a call table: parties, their handles, time, duration, device and cell."""
    rows = per_document(
        docs, id_column, ["text"], call_rows,
        "line int, `when` string, source string, target string, seconds string, imei string, direction string, cell string",
    )
    return rows.select(
        id_column, "line", F.lit("cdr").alias("platform"), F.col("source").alias("sender"), normalize.phone(F.col("source")).alias("sender_handle"),
        F.col("target").alias("receiver"), normalize.phone(F.col("target")).alias("receiver_handle"),
        F.concat_ws(
            " ", F.coalesce(F.lower("direction"), F.lit("call")), "source", F.lit("→"), "target",
            F.concat(F.lit("("), F.col("seconds"), F.lit("s)")), F.concat(F.lit("["), F.col("cell"), F.lit("]")), F.concat(F.lit("IMEI "), F.col("imei")),
        ).alias("body"),
        timestamp_iso(F.col("when")).alias("time"),
    )


def communications(docs: DataFrame, id_column: str) -> DataFrame:
    """Call records of the documents that have them, chat lines of the others."""
    calls = call_records(docs, id_column)
    chats = chat_lines(docs, id_column).join(calls.select(id_column).distinct(), id_column, "left_anti")
    return calls.unionByName(chats)


def message_entities(messages: DataFrame, id_column: str, rules: list[str] | None = None) -> DataFrame:
    """Entities of each distinct message body."""
    bodies = messages.select(F.col("body").alias("text")).distinct().withColumn(id_column, F.xxhash64("text"))
    return extract(bodies, id_column, rules) if rules else extract(bodies, id_column)


_SENDER = r"(?i)^[\x{200e}\x{200f}]?[\[(]?[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4},?\s+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\s*(?:[ap]\.?m\.?)?\s*\]?\s*-?\s*([^:\n]{1,64}):"


def chat_senders(docs: DataFrame, id_column: str) -> DataFrame:
    """Who writes in a chat: phone numbers (0.8) and names (0.7 from three lines on, else 0.55), with line counts."""
    x = F.explode(F.split(F.coalesce("text", F.lit("")), "\r\n?|\n"))
    rows = docs.select(id_column, x.alias("x")).select(id_column, F.regexp_replace(F.trim(F.regexp_extract("x", _SENDER, 1)), "^~+", "").alias("sender"))
    rows = rows.where("length(sender) >= 2")
    s = F.col("sender")
    number = normalize.digits(s)
    phone = s.rlike(r"^[+?0-9][0-9\s()-]{6,}$") & (F.length(number) >= 10) & (F.length(s) <= 20)
    norm = F.when(F.length(number) == 10, F.concat(F.lit("+91"), number)).when(F.length(number) == 12, F.concat(F.lit("+"), number)).otherwise(F.concat(F.lit("+91"), number))
    fine = phone | (~s.rlike(r"(?i)[<>]|https?:|www\.") & (F.size(F.split(s, r"\s")) <= 7))
    rows = rows.where(fine).select(id_column, F.when(phone, "phone").otherwise("person").alias("type"), F.when(phone, norm).otherwise(F.lower(s)).alias("key"), s.alias("sender"))
    g = rows.groupBy(id_column, "type", "key").agg(F.count(F.lit(1)).alias("lines"), F.min("sender").alias("sender"))
    person = F.col("type") == "person"
    out = g.withColumn("norm", F.when(person, normalize.person(F.col("sender"))).otherwise(F.col("key")))
    confidence = F.when(~person, 0.8).when(F.col("lines") >= 3, 0.7).otherwise(0.55)
    return out.where("length(norm) >= 3").select(id_column, "type", "norm", "lines", confidence.alias("confidence"))


def _chats(spark: SparkSession, d: str, layout: str) -> DataFrame:
    """A generated chat for each sending account."""
    t = transactions(spark, d)
    ts = F.timestamp_micros("us")
    head = {
        "whatsapp": F.concat(F.lit("["), F.date_format(ts, "dd/MM/yyyy, HH:mm:ss"), F.lit("] ")), "dash": F.concat(F.date_format(ts, "dd/MM/yyyy, hh:mm a"), F.lit(" - ")),
        "generic": F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" <")),
    }[layout]
    who = F.concat(F.col("sender"), F.lit("> " if layout == "generic" else ": "))
    line = F.concat(head, who, F.lit("pay @"), F.col("receiver"), F.lit(" ref "), F.col("id").cast("string"))
    g = t.select("sender", F.struct("id", line.alias("x")).alias("r")).groupBy("sender").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return g.select(F.col("sender").alias("chat"), F.concat(F.lit("Messages export\n\n"), F.array_join(F.transform("r", lambda r: r["x"]), "\n")).alias("text"))


def _want(name: str, layout: str, time: str) -> str:
    return f"""WITH {TX} SELECT sender AS chat, '{layout}' AS platform, sender, receiver, concat('pay @', receiver, ' ref ', id) AS body,
  {time} AS time FROM t"""


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("chat", "platform", "sender", "receiver", "body", "time")


@query("x34_whatsapp", _want("x34", "whatsapp", "strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.000Z')"))
def x34(spark: SparkSession, d: str) -> DataFrame:
    return _shown(chat_lines(_chats(spark, d, "whatsapp"), "chat"))


@query("x34_whatsapp_dash", _want("x34", "whatsapp", "strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:00.000Z')"))
def x34_dash(spark, d):
    return _shown(chat_lines(_chats(spark, d, "dash"), "chat"))


@query("x34_generic", _want("x34", "generic", "strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%SZ')"))
def x34_generic(spark, d):
    return _shown(chat_lines(_chats(spark, d, "generic"), "chat"))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    ts, phone = F.timestamp_micros("us"), lambda c: F.concat(F.lit("+9198"), F.lpad(F.substring(c, 2, 20), 8, "0"))
    line = F.concat_ws(",", phone("sender"), phone("receiver"), F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "HH:mm:ss"), (F.col("id") % 300).cast("string"), F.lit("outgoing"))
    g = t.select("sender", F.struct("id", line.alias("x")).alias("r")).groupBy("sender").agg(F.array_sort(F.collect_list("r")).alias("r"))
    head = F.lit("calling_number,called_number,date,time,duration_secs,call_type\n")
    return g.select(F.col("sender").alias("chat"), F.concat(head, F.array_join(F.transform("r", lambda r: r["x"]), "\n")).alias("text"))


_CALLS = "WITH " + TX + """, c AS (SELECT sender AS chat, concat('+9198', lpad(substr(sender, 2), 8, '0')) AS a, concat('+9198', lpad(substr(receiver, 2), 8, '0')) AS b,
  strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.000Z') AS time, id % 300 AS s, id, count(*) OVER (PARTITION BY sender) AS n FROM t)"""


@query(
    "x35_call_records",
    _CALLS + """ SELECT chat, a AS sender, right(a, 10) AS sender_handle, b AS receiver, time, concat('outgoing ', a, ' → ', b, ' (', s, 's)') AS body FROM c
  WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY chat, a, b, time ORDER BY id) = 1""",
)
def x35(spark, d):
    return call_records(_calls(spark, d), "chat").select("chat", "sender", "sender_handle", "receiver", "time", "body")


@query(
    "x36_timestamps",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN concat(strftime(o_orderdate, '%Y-%m-%d'), 'T10:30Z') WHEN 1 THEN concat(strftime(o_orderdate, '%Y-%m-%d'), 'T22:05:00.000Z')
  WHEN 2 THEN concat(strftime(o_orderdate, '%Y-%m-%d'), 'T07:08:09.000Z') WHEN 3 THEN concat(strftime(o_orderdate, '%Y-%m-%d'), 'T00:15:00.000Z') ELSE 'yesterday' END AS time FROM orders""",
)
def x36(spark, d):
    day = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey") % 5
    raw = (
        F.when(k == 0, F.concat(day("yyyy-MM-dd"), F.lit("T10:30"))).when(k == 1, F.concat(day("d/M/yyyy"), F.lit(", 10:05 PM")))
        .when(k == 2, F.concat(day("dd.MM.yyyy"), F.lit(" 07:08:09"))).when(k == 3, F.concat(day("dd-MM-yyyy"), F.lit(" 12:15 am"))).otherwise(F.lit(" yesterday "))
    )
    return table(spark, d, "orders").select("o_orderkey", timestamp_iso(raw).alias("time"))


@query("x37_message_entities", "WITH " + TX + " SELECT DISTINCT 'email' AS type, concat('u', id, '@mail.org') AS norm FROM t")
def x37(spark, d):
    t = transactions(spark, d).select(F.concat(F.lit("write to U"), F.col("id").cast("string"), F.lit("@Mail.org today")).alias("body"))
    return message_entities(t, "message_id", ["email"]).select("type", "norm").distinct()


@query(
    "x22_chat_senders",
    "WITH " + TX + """ SELECT sender AS chat, 'person' AS type, sender AS norm, count(*) AS lines, CASE WHEN count(*) >= 3 THEN 0.7 ELSE 0.55 END::DOUBLE AS confidence
  FROM t WHERE length(sender) >= 3 GROUP BY 1""",
)
def x22(spark, d):
    return chat_senders(_chats(spark, d, "dash"), "chat")


@query(
    "x34_communications",
    _CALLS + """ SELECT concat('c-', chat) AS chat, 'cdr' AS platform, a AS sender FROM c WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY chat, a, b, time ORDER BY id) = 1
  UNION ALL SELECT concat('m-', chat), 'whatsapp', chat FROM c""",
)
def x34_all(spark, d):
    calls, chats = _calls(spark, d), _chats(spark, d, "whatsapp")
    docs = calls.withColumn("chat", F.concat(F.lit("c-"), "chat")).unionByName(chats.withColumn("chat", F.concat(F.lit("m-"), "chat")))
    return communications(docs, "chat").select("chat", "platform", "sender")
