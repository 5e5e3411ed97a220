"""Names out of lists: places, banks, parties of bank narrations, and masked accounts near banking words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalize
from ..plans.registry import query
from ..sources.adapters import table

# Places, and the places that go by another name.
PLACES = (
    "Delhi|New Delhi|Mumbai|Navi Mumbai|Thane|Pune|Nagpur|Nashik|Bengaluru|Mysuru|Hubli|Hyderabad|Secunderabad|Warangal|Chennai|Coimbatore|Madurai|"
    "Kolkata|Howrah|Siliguri|Asansol|Ahmedabad|Surat|Vadodara|Rajkot|Jaipur|Jodhpur|Udaipur|Kota|Lucknow|Kanpur|Varanasi|Prayagraj|Agra|Mathura|Meerut|"
    "Ghaziabad|Noida|Greater Noida|Gurugram|Faridabad|Chandigarh|Panchkula|Bhopal|Indore|Gwalior|Jabalpur|Patna|Gaya|Muzaffarpur|Bhagalpur|Ranchi|"
    "Jamshedpur|Dhanbad|Bhubaneswar|Cuttack|Raipur|Bhilai|Dehradun|Haridwar|Roorkee|Guwahati|Shillong|Imphal|Aizawl|Kohima|Itanagar|Gangtok|Agartala|"
    "Port Blair|Puducherry|Goa|Panaji|Kochi|Ernakulam|Kozhikode|Thrissur|Thiruvananthapuram|Amritsar|Ludhiana|Patiala|Jalandhar|Shimla|Srinagar|Jammu|Leh|"
    "Uttar Pradesh|Maharashtra|Karnataka|Telangana|Tamil Nadu|Kerala|West Bengal|Gujarat|Rajasthan|Madhya Pradesh|Bihar|Jharkhand|Odisha|Chhattisgarh|"
    "Uttarakhand|Assam|Punjab|Haryana|Himachal Pradesh|Tripura|Manipur|Meghalaya|Nagaland|Mizoram|Arunachal Pradesh|Sikkim"
).split("|")
OTHER_NAMES = {"bangalore": "Bengaluru", "trichy": "Tiruchirappalli", "allahabad": "Prayagraj", "gurgaon": "Gurugram", "trivandrum": "Thiruvananthapuram"}
# How banks and payment services are written, and their names.
BANKS = {
    "state bank of india": "State Bank of India", "sbi": "State Bank of India", "hdfc": "HDFC Bank", "icici": "ICICI Bank", "axis bank": "Axis Bank", "kotak": "Kotak Mahindra Bank",
    "punjab national": "Punjab National Bank", "pnb": "Punjab National Bank", "bank of baroda": "Bank of Baroda", "bob": "Bank of Baroda", "canara bank": "Canara Bank",
    "union bank": "Union Bank of India", "idfc": "IDFC FIRST Bank", "yes bank": "Yes Bank", "indusind": "IndusInd Bank", "federal bank": "Federal Bank", "rbl bank": "RBL Bank",
    "bandhan bank": "Bandhan Bank", "idbi": "IDBI Bank", "indian bank": "Indian Bank", "indian overseas": "Indian Overseas Bank", "central bank of india": "Central Bank of India",
    "bank of india": "Bank of India", "uco bank": "UCO Bank", "mahabank": "Maharashtra Bank", "bank of maharashtra": "Bank of Maharashtra", "karnataka bank": "Karnataka Bank",
    "karur vysya": "Karur Vysya Bank", "city union bank": "City Union Bank", "tmb": "Tamilnad Mercantile Bank", "csb bank": "CSB Bank", "dcb bank": "DCB Bank",
    "au small finance": "AU Small Finance Bank", "equitas": "Equitas Small Finance Bank", "ujjivan": "Ujjivan Small Finance Bank", "paytm": "Paytm", "phonepe": "PhonePe",
    "phone pe": "PhonePe", "google pay": "Google Pay", "googlepay": "Google Pay", "gpay": "Google Pay", "amazon pay": "Amazon Pay", "amazonpay": "Amazon Pay", "bhim": "BHIM UPI",
    "freecharge": "Freecharge", "mobikwik": "MobiKwik", "jiomoney": "JioMoney", "airtel payments bank": "Airtel Payments Bank", "fino payments bank": "Fino Payments Bank",
    "western union": "Western Union", "moneygram": "MoneyGram", "wise": "Wise Transfer",
}
# A narration and the firms' words in it.
_NARRATION = (
    r"(?i)\b(?:UPI|IMPS|NEFT|RTGS|ACH|MMT|ECS|CLG|POS|PATM|INF|TXN)\s*[/-]\s*(?:CR|DR|BY DEBIT|TO CREDIT|[CD])\s*[/-]\s*[A-Z0-9]{2,26}\s*[/-]\s*"
    r"([A-Z0-9][A-Z0-9 .,&'_/-]{2,46}?)(?=\s*[/-]\s*[A-Z0-9@.]{2,26}|$|[,;\n])"
)
_FIRM = r"(?i)ltd|pvt|llp|inc|corp|enterprises|traders|store|agency|transport|hotel|hospital"
_MASKED = r"\b([Xx*]{4,8}[0-9]{3,5})\b"
_BANKING = r"(?i)(account|a/c|acct|ac no|card number|linked|beneficiary|debit card|credit card|upi)"
MOST_PLACES, MOST_PARTIES, AROUND = 50, 60, 60


def _listed(docs: DataFrame, id_column: str, names: list[tuple[str, str]], most: int, flat: bool) -> DataFrame:
    """The names of a list that a text holds after a space or at its beginning: one search for each, in one projection."""
    low = F.lower(F.coalesce("text", F.lit("")))
    t = F.concat(F.lit(" "), F.regexp_replace(low, r"\s+", " ") if flat else low)
    hits = F.array(*[F.when(F.contains(F.col("t"), F.lit(f" {needle}")), F.struct(F.lit(k).alias("k"), F.lit(name).alias("name"), F.lit(needle).alias("needle"))) for k, (needle, name) in enumerate(names)])
    rows = docs.select(id_column, t.alias("t")).select(id_column, F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    first = rows.groupBy(id_column, F.col("h.name").alias("value")).agg(F.min("h").alias("h"))
    place = F.row_number().over(Window.partitionBy(id_column).orderBy("h.k"))
    return first.select(id_column, "value", F.col("h.needle").alias("needle"), place.alias("place")).where(F.col("place") <= most)


def locations(docs: DataFrame, id_column: str) -> DataFrame:
    """value, norm and confidence (0.72 for long or compound names, else 0.6) of at most 50 places a document, in the list's order."""
    names = [*((p.lower(), p) for p in PLACES), *OTHER_NAMES.items()]
    rows = _listed(docs, id_column, names, MOST_PLACES, True)
    sure = F.col("needle").contains(" ") | (F.length("needle") > 6)
    return rows.select(id_column, "value", F.regexp_replace(F.lower("value"), "[^a-z0-9]", "").alias("norm"), F.when(sure, 0.72).otherwise(0.6).alias("confidence"))


def _title(name: Column) -> Column:
    return F.initcap(F.lower(name))


def narration_parties(docs: DataFrame, id_column: str) -> DataFrame:
    """type, value, norm and confidence: the parties that narrations name (0.62), then known banks (0.78); 60 at most."""
    found = F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_NARRATION), F.lit(1))).alias("k", "raw")
    name = F.trim(F.regexp_replace("raw", r"\s*/\s*$", ""))
    rows = docs.select(id_column, found).select(id_column, "k", name.alias("name")).where("length(name) >= 3")
    person = (F.size(F.split("name", r"\s+")) <= 4) & ~F.col("name").rlike(_FIRM)
    norm = normalize.person(_title(F.col("name")))
    rows = rows.select(id_column, "k", F.when(person, "person").otherwise("organization").alias("type"), F.when(person, norm).otherwise(F.col("name")).alias("value"), norm.alias("norm")).where("length(norm) >= 3")
    parties = rows.groupBy(id_column, "norm").agg(F.min(F.struct("k", "type", "value")).alias("m"))
    parties = parties.select(id_column, F.col("m.type").alias("type"), F.col("m.value").alias("value"), "norm", F.lit(0.62).alias("confidence"), F.col("m.k").alias("k"))
    banks = _listed(docs, id_column, list(BANKS.items()), len(BANKS), False).select(
        id_column, F.lit("organization").alias("type"), "value", F.regexp_replace(F.lower("value"), "[^a-z0-9]", "").alias("norm"), F.lit(0.78).alias("confidence"),
        (F.lit(1 << 20) + F.col("place")).alias("k"),
    )
    banks = banks.join(parties.select(id_column, "value"), [id_column, "value"], "left_anti").select(*parties.columns)
    place = F.row_number().over(Window.partitionBy(id_column).orderBy("k"))
    return parties.unionByName(banks).withColumn("k", place).where(F.col("k") <= MOST_PARTIES).drop("k")


def masked_accounts(docs: DataFrame, id_column: str) -> DataFrame:
    """value and norm of masked accounts (XXXX1234) with a banking word within 60 characters; 0.6."""
    # A match with its surroundings would hide the next one, so each is read in the piece between its neighbours' ends.
    text = F.coalesce("text", F.lit(""))
    marked = F.regexp_replace(text, _MASKED, "\x00$1\x00")
    parts = docs.select(id_column, F.split(marked, "\x00").alias("p"), text.alias("t"))
    sizes = F.transform("p", lambda x: F.length(x))
    rows = parts.select(id_column, "t", F.posexplode("p").alias("i", "value"), sizes.alias("n")).where("i % 2 = 1")
    start = F.aggregate(F.slice("n", 1, F.col("i")), F.lit(0), lambda a, x: a + x)
    rows = rows.withColumn("start", start).withColumn("from", F.greatest(F.col("start") - AROUND, F.lit(0)))
    window = F.substring(F.col("t"), F.col("from") + 1, F.col("start") - F.col("from") + F.length("value") + AROUND)
    return rows.where(window.rlike(_BANKING)).select(id_column, "value", F.concat(F.lit("MASKED-"), F.upper("value")).alias("norm")).groupBy(id_column, "norm").agg(F.min("value").alias("value")).withColumn("confidence", F.lit(0.6))


_TOWNS = ["Delhi", "Port Blair", "Bangalore", "Surat", "Leh"]
_TOWN_WANT = [("Delhi", 0.6), ("Port Blair", 0.72), ("Bengaluru", 0.72), ("Surat", 0.6), ("Leh", 0.6)]


@query(
    "x24_locations",
    "SELECT c_custkey, CASE c_custkey % 5 " + " ".join(f"WHEN {i} THEN '{w}'" for i, (w, _) in enumerate(_TOWN_WANT)) + " END AS value, CASE c_custkey % 5 "
    + " ".join(f"WHEN {i} THEN {c}" for i, (_, c) in enumerate(_TOWN_WANT)) + " END::DOUBLE AS confidence FROM customer",
)
def x24(spark: SparkSession, d: str) -> DataFrame:
    """Names at the beginning, over a line break and under another name; no name inside a word."""
    town = F.element_at(F.array(*[F.lit(t) for t in _TOWNS]), (F.col("c_custkey") % 5 + 1).cast("int"))
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(town, F.lit(" police"))).otherwise(F.concat(F.lit("met in\n"), town, F.lit(", xAgra")))
    return locations(table(spark, d, "customer").select("c_custkey", text.alias("text")), "c_custkey").select("c_custkey", "value", "confidence")


@query("x24_documents", "SELECT doc_id, p AS value FROM documents, (VALUES " + ", ".join(f"('{p}')" for p in PLACES) + ") v(p) WHERE contains(concat(' ', regexp_replace(lower(text), '\\s+', ' ', 'g')), concat(' ', lower(p)))\n  UNION SELECT doc_id, c FROM documents, (VALUES " + ", ".join(f"('{n}', '{c}')" for n, c in OTHER_NAMES.items()) + ") v(n, c) WHERE contains(concat(' ', regexp_replace(lower(text), '\\s+', ' ', 'g')), concat(' ', n))")
def x24_documents(spark, d):
    return locations(table(spark, d, "documents"), "doc_id").select("doc_id", "value")


@query(
    "x23_narration_parties",
    """SELECT c_custkey, 'person' AS type, 'Ravi Kumar' AS value, 0.62::DOUBLE AS confidence FROM customer UNION ALL
SELECT c_custkey, 'organization', concat('M/S ', upper(c_mktsegment), ' TRADERS'), 0.62 FROM customer UNION ALL SELECT c_custkey, 'organization', 'HDFC Bank', 0.78 FROM customer""",
)
def x23(spark, d):
    text = F.concat(F.lit("UPI/DR/512345678901/RAVI KUMAR/YBL\nIMPS/CR/567890123456/M/S "), F.upper("c_mktsegment"), F.lit(" TRADERS/ICIC0001\npaid by hdfc card"))
    return narration_parties(table(spark, d, "customer").select("c_custkey", text.alias("text")), "c_custkey").select("c_custkey", "type", "value", "confidence")


@query("x25_masked_accounts", "SELECT c_custkey, concat('MASKED-XXXX', 1000 + c_custkey % 9000) AS norm FROM customer")
def x25(spark, d):
    number = F.concat(F.lit("xxxx"), (F.col("c_custkey") % 9000 + 1000).cast("string"))
    text = F.concat(F.lit("Your A/c "), number, F.lit(" and again "), number, F.lit(". " + "far away words " * 8), F.lit("XXXX99999 " + "and nothing else " * 8))
    return masked_accounts(table(spark, d, "customer").select("c_custkey", text.alias("text")), "c_custkey").select("c_custkey", "norm")
