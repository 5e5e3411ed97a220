"""Registered queries of the scalar functions, over values made from the customer table.

A probe is an expression that both engines read alike; the function under test gets its value.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.adapters import spread, table
from . import checksum, normalize, similarity

K = "c_custkey"
# name, probe, Spark function, DuckDB expression over r
PROBES = [
    ("f01_phone", f"concat(CASE {K} % 5 WHEN 0 THEN '+91 ' WHEN 1 THEN '0' WHEN 2 THEN '+44-' WHEN 3 THEN '91' ELSE '' END, 7000000000 + {K} * 7919)", normalize.phone,
     "CASE WHEN regexp_replace(r, '[^0-9]', '', 'g') LIKE '91%' AND length(regexp_replace(r, '[^0-9]', '', 'g')) = 12 THEN regexp_replace(r, '[^0-9]', '', 'g')[3:] WHEN r LIKE '0%' AND length(r) = 11 THEN r[2:] WHEN r LIKE '+%' THEN concat('+', regexp_replace(r, '[^0-9]', '', 'g')) ELSE r END"),
    ("f02_email", f"concat(CASE WHEN {K} % 2 = 0 THEN '<' ELSE ' ' END, 'User.', {K}, '@Mail', {K} % 7, '.ORG', CASE WHEN {K} % 2 = 0 THEN '>' ELSE '.;' END)", normalize.email,
     "trim(regexp_replace(lower(trim(CASE WHEN trim(r) LIKE '<%>' THEN trim(r)[2:-2] ELSE r END)), '[.,;:!?]+$', ''))"),
    ("f03_upi", f"concat(' Name', {K}, '@OKbank', CASE WHEN {K} % 3 = 0 THEN '.,' ELSE '' END)", normalize.upi, "regexp_replace(lower(trim(r)), '[;,:.]+$', '')"),
    ("f04_ifsc", f"concat('hdfc 0', right(concat('000000', {K}), 6), ' ')", normalize.compact_upper, r"regexp_replace(upper(trim(r)), '\s+', '', 'g')"),
    ("f05_ip", f"concat('0', {K} % 10, '.', {K} % 300, '.007.', {K} % 256)", normalize.ip,
     "CASE WHEN CAST(string_split(r, '.')[2] AS INTEGER) > 255 THEN r ELSE array_to_string(list_transform(string_split(r, '.'), lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), '.') END"),
    ("f06_url", f"concat(CASE WHEN {K} % 3 = 0 THEN '' ELSE 'HTTPS://' END, 'Www.Site', {K} % 11, '.Com/Path?q=', {K})", normalize.url,
     r"lower(CASE WHEN r LIKE 'HTTPS%' THEN regexp_extract(r, '^([A-Za-z]+://[^/?#:]+)', 1) ELSE concat('http://', regexp_extract(r, '^([^/?#:]+)', 1)) END)"),
    ("f07_domain", f"concat('WWW.Site', {K} % 13, '.net', CASE WHEN {K} % 2 = 0 THEN '//' ELSE '' END)", normalize.domain, r"regexp_replace(regexp_replace(lower(r), '/+$', ''), '^www\.', '')"),
    ("f08_account", f"concat(CASE WHEN {K} % 4 = 0 THEN 'xxxx-' ELSE 'ac ' END, {K} * 1009, ' ', {K})", normalize.account,
     r"CASE WHEN r LIKE 'xxxx%' THEN regexp_replace(upper(r), '[\s-]+', '', 'g') ELSE regexp_replace(r, '[^0-9]', '', 'g') END"),
    ("f09_imei", f"concat('imei ', 350000000000000 + {K} * 104729, CASE WHEN {K} % 2 = 0 THEN '99' ELSE '' END)", normalize.imei, "regexp_replace(r, '[^0-9]', '', 'g')[1:15]"),
    ("f10_mac", f"concat('0a-1b-2c-', 10 + {K} % 80, '-3d-', CASE WHEN {K} % 5 = 0 THEN 'f' ELSE 'ff' END)", normalize.mac,
     "CASE WHEN length(regexp_replace(r, '[^0-9a-f]', '', 'g')) = 12 THEN replace(upper(r), '-', ':') ELSE upper(r) END"),
    ("f11_wallet", f"concat('0x', right(concat('00000000000000000000000000000000000ABCDE', {K}), CASE WHEN {K} % 2 = 0 THEN 40 ELSE 39 END))", normalize.wallet, "CASE WHEN length(r) = 42 THEN lower(r) ELSE r END"),
    ("f12_vehicle", f"concat('mh ', {K} % 50, '-ab ', 1000 + {K} % 9000)", normalize.dashless_upper, r"regexp_replace(upper(r), '[\s-]+', '', 'g')"),
    ("f13_amount", f"concat(CASE {K} % 3 WHEN 0 THEN 'Rs. ' WHEN 1 THEN 'INR ' ELSE '' END, {K} % 100, ',', 100 + {K} % 900, CASE {K} % 4 WHEN 0 THEN ' lakh' WHEN 1 THEN '/-' WHEN 2 THEN ' cr' ELSE ' units' END)", normalize.amount,
     r"CAST(regexp_replace(regexp_extract(r, '([0-9,]+)', 1), ',', '', 'g') AS DOUBLE) * CASE WHEN r LIKE '%lakh' THEN 1e5 WHEN r LIKE '% cr' THEN 1e7 ELSE 1 END"),
    ("f14_person", f"concat('  mr  jOHN ', CASE WHEN {K} % 2 = 0 THEN 'SMITH' ELSE 'doe' END, ' ')", normalize.person, "CASE WHEN r LIKE '%SMITH%' THEN 'Mr. John Smith' ELSE 'Mr. John Doe' END"),
    ("f15_organization", f"concat(' Acme   Unit  ', {K}, ' ')", normalize.organization, r"regexp_replace(trim(r), '\s+', ' ', 'g')"),
    ("f16_aadhaar", f"concat(1000 + {K} % 9000, ' ', 2000 + {K} % 7000, CASE WHEN {K} % 2 = 0 THEN ' 1234' ELSE ' 12' END)", normalize.aadhaar, "CASE WHEN length(r) = 14 THEN replace(r, ' ', '') ELSE '' END"),
    ("f17_row_glue", f"concat('E', {K}, CASE WHEN {K} % 2 = 0 THEN ',PERSON,' ELSE ' plain ' END, 'x')", normalize.is_row_glue, "r LIKE '%,PERSON,%'"),
    ("f18_entity", f"concat(' User', {K}, '@Host.com, ')", lambda c: normalize.entity(F.lit("email"), c), "regexp_replace(lower(trim(r)), '[.,;:!?]+$', '')"),
    ("f19_merge_key", f"concat(CASE {K} % 3 WHEN 0 THEN 'A/C-' WHEN 1 THEN 'Account No: ' ELSE 'Very Long Name ' END, 1000000 + {K})", normalize.merge_key,
     "CASE WHEN r LIKE 'Very%' THEN regexp_replace(lower(r), '[^a-z0-9]', '', 'g') ELSE regexp_replace(r, '[^0-9]', '', 'g') END"),
    ("f20_quoted", f"concat('Paid  Rs. ', {K} % 50, ', TO holder')", lambda c: normalize.quoted(F.lit("rs 7 to holder"), c), "r LIKE '% 7, TO holder'"),
    ("f21_date_iso", f"CASE {K} % 5 WHEN 0 THEN concat('2024-0', 1 + {K} % 9, '-11') WHEN 1 THEN concat({K} % 28 + 1, '/', 1 + {K} % 14, '/24') WHEN 2 THEN 'Sept 5, 2023' WHEN 3 THEN '7 January 2021' ELSE 'no date' END", normalize.date_iso,
     "CASE WHEN r LIKE '2024%' THEN r WHEN r LIKE 'Sept%' THEN '2023-09-05' WHEN r LIKE '7 J%' THEN '2021-01-07' WHEN r LIKE '%/24' AND CAST(string_split(r, '/')[2] AS INTEGER) <= 12 THEN concat('2024-', lpad(string_split(r, '/')[2], 2, '0'), '-', lpad(string_split(r, '/')[1], 2, '0')) END"),
    ("f23_duration", f"{K} * {K} * 397", similarity.human_duration,
     "CASE WHEN r < 60000 THEN concat(greatest(1, CAST(floor(r / 1000.0 + 0.5) AS BIGINT)), ' seconds') WHEN r < 3600000 THEN concat(CAST(floor(r / 60000.0 + 0.5) AS BIGINT), ' minutes') WHEN r < 86400000 THEN concat(CAST(floor(r / 3600000.0 + 0.5) AS BIGINT), ' hours') ELSE concat(CAST(floor(r / 86400000.0 + 0.5) AS BIGINT), ' days') END"),
    ("f24_luhn", f"concat('', 400000000000000 + {K} * 7919)", checksum.luhn,
     "list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN CAST(r[16 - i] AS INTEGER) WHEN CAST(r[16 - i] AS INTEGER) > 4 THEN CAST(r[16 - i] AS INTEGER) * 2 - 9 ELSE CAST(r[16 - i] AS INTEGER) * 2 END)) % 10 = 0"),
    ("f25_verhoeff", f"concat('', 200000000000 + {K} * 7919)", checksum.verhoeff, None),
    ("f26_gstin", f"concat('27ABCDE', 1000 + {K} % 9000, 'F1Z', {K} % 10)", checksum.gstin,
     "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'[CAST((36 - list_sum(list_transform(range(1, 15), lambda i: ((instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', r[i]) - 1) * (2 - i % 2)) // 36 + ((instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', r[i]) - 1) * (2 - i % 2)) % 36)) % 36) % 36 + 1 AS INTEGER)] = r[15]"),
    ("f30_verb", f"concat(' transferred - to ', CASE WHEN {K} % 3 = 0 THEN '!!' ELSE concat('x', {K} % 9) END, ' ')", normalize.verb,
     r"upper(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(r), '[\s-]+', '_', 'g'), '[^A-Za-z0-9_]', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g'))"),
    ("f42_reference", f"concat(CASE {K} % 3 WHEN 0 THEN 'PER-' WHEN 1 THEN '9PER-' ELSE 'Doc_a-' END, {K})", normalize.is_reference, "r NOT LIKE '9%'"),
    ("f42_reference_key", f"concat('per. ', {K}, '-x_')", normalize.reference_key, "regexp_replace(upper(r), '[^A-Z0-9_-]', '', 'g')"),
    ("f43_strip_label", f"concat(CASE {K} % 3 WHEN 0 THEN 'IFSC code: ' WHEN 1 THEN 'Reg No # ' ELSE 'Other: ' END, 'V', {K})", normalize.strip_label, "CASE WHEN r LIKE 'Other%' THEN r ELSE regexp_extract(r, '(V[0-9]+)$', 1) END"),
    ("f44_guess_type", f"CASE {K} % 8 WHEN 0 THEN concat('u', {K}, '@mail.org') WHEN 1 THEN 'name@okbank' WHEN 2 THEN '+44 7000 000000' WHEN 3 THEN 'HDFC0001234' WHEN 4 THEN 'ABCDE1234F' WHEN 5 THEN 'site.example.com' WHEN 6 THEN 'Acme Traders' ELSE 'Jane Mary Doe' END", normalize.guess_type,
     "CASE WHEN r LIKE '%mail.org' THEN 'email' WHEN r LIKE 'name%' THEN 'upi' WHEN r LIKE '+44%' THEN 'phone' WHEN r LIKE 'HDFC%' THEN 'ifsc' WHEN r LIKE 'ABCDE%' THEN 'document_id' WHEN r LIKE 'site%' THEN 'domain' WHEN r LIKE 'Acme%' THEN 'organization' ELSE 'person' END"),
    ("x41_reference_token", f"concat(CASE {K} % 4 WHEN 0 THEN '£' WHEN 1 THEN 'R' WHEN 2 THEN 'e-' ELSE '7' END, 'OS', {K} % 100)", normalize.reference_token,
     "CASE WHEN r LIKE '7%' THEN NULL WHEN r LIKE '£%' THEN concat('E05', r[4:]) WHEN r LIKE 'R%' THEN concat('R05', r[4:]) ELSE concat('E05', r[5:]) END"),
    ("f35_clamp", f"({K} % 40 - 10) / 20.0D", similarity.clamp01, "greatest(0.0, least(1.0, r))"),
]


def _register(name, probe, f, sql):
    duck = probe.replace("20.0D", "20.0::DOUBLE")
    oracle = sql and f"SELECT c_custkey, {sql} AS out FROM (SELECT c_custkey, {duck} AS r FROM customer)"

    @query(name, oracle)
    def run(spark, d):
        return table(spark, d, "customer").select("c_custkey", F.expr(probe).alias("r")).select("c_custkey", f(F.col("r")).alias("out"))


for _row in PROBES:
    _register(*_row)


@query("f28_levenshtein", "SELECT a.s_suppkey AS a, b.s_suppkey AS b, levenshtein(a.s_name, b.s_name) AS distance FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND a.s_nationkey = b.s_nationkey")
def f28(spark, d):
    s = table(spark, d, "supplier")
    a = spread(s, "s_suppkey").select(F.col("s_suppkey").alias("a"), "s_nationkey", F.col("s_name").alias("x"))
    b = s.select(F.col("s_suppkey").alias("b"), "s_nationkey", F.col("s_name").alias("y"))
    return a.join(b, "s_nationkey").where("a < b").select("a", "b", F.levenshtein("x", "y").cast("long").alias("distance"))


@query(
    "f29_name_similarity",
    r"""WITH p AS (SELECT p_partkey, p_name, concat(p_brand, ' ', p_name) AS other FROM part), t AS (SELECT p_partkey,
  list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(p_name), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: length(x) > 1)) AS x,
  list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(other), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: length(x) > 1)) AS y FROM p),
n AS (SELECT *, len(list_intersect(x, y)) AS i, len(list_distinct(list_concat(x, y))) AS u, least(len(x), len(y)) AS s, greatest(len(x), len(y)) AS l FROM t)
SELECT p_partkey, round(CASE WHEN s = 0 THEN 0 ELSE least(1, CASE WHEN i = s AND s < l THEN greatest(i / u, 0.72 + 0.05 * i) ELSE i / u END) END, 6) AS similarity FROM n""",
)
def f29(spark, d):
    p = spread(table(spark, d, "part"), "p_partkey")
    return p.select("p_partkey", F.round(similarity.name_similarity(F.col("p_name"), F.concat_ws(" ", "p_brand", "p_name")), 6).alias("similarity"))


@query(
    "f32_keywords",
    r"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN t = '' THEN '' ELSE concat_ws('|', t, (SELECT string_agg(w, '|' ORDER BY i) FROM (
  SELECT w, min(i) AS i FROM (SELECT unnest(string_split(t, ' ')) AS w, generate_subscripts(string_split(t, ' '), 1) AS i)
  WHERE length(w) > 2 AND w <> t AND w NOT IN (""" + ", ".join(f"'{w}'" for w in similarity.STOP_WORDS) + """) GROUP BY w))) END AS words FROM c""",
)
def f32(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(similarity.keywords(F.col("text")), "|").alias("words"))


@query(
    "f34_share_below",
    "SELECT c_custkey, round((rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) - 1) / count(*) OVER (PARTITION BY c_nationkey), 6) AS share FROM customer",
)
def f34(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(similarity.share_below("c_acctbal", "c_nationkey"), 6).alias("share"))


@query("f36_dedup_key", "SELECT event_id, substr(sha256(concat(event_type, '|', props, '|', user_id)), 1, 16) AS key FROM events")
def f36(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.substring(F.sha2(F.concat_ws("|", "event_type", "props", F.col("user_id").cast("string")), 256), 1, 16).alias("key"))


@query(
    "f37_content_hash",
    "SELECT lang, sha1(concat(count(*), '|', count(DISTINCT source), '|', sum(n_chars))) AS hash FROM documents GROUP BY lang",
)
def f37(spark, d):
    g = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("a"), F.countDistinct("source").alias("b"), F.sum("n_chars").alias("c"))
    return g.select("lang", F.sha1(F.concat_ws("|", *[F.col(x).cast("string") for x in "abc"])).alias("hash"))


@query(
    "f38_amounts_differ",
    "SELECT o_orderkey, abs(o_totalprice - s) > 1 AND abs(o_totalprice - s) > 0.005 * greatest(abs(o_totalprice), abs(s)) AS differ FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
)
def f38(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"))
    return table(spark, d, "orders").join(s, "o_orderkey").select("o_orderkey", similarity.amounts_differ(F.col("o_totalprice"), F.col("s")).alias("differ"))


@query(
    "f39_edge_state",
    """SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_discount < 0.03 THEN 'uncertain'
  WHEN l_returnflag = 'R' THEN CASE WHEN l_linenumber >= 3 THEN 'corroborated' ELSE 'inferred' END
  WHEN l_linenumber >= 3 OR (l_returnflag = 'A' AND l_discount >= 0.06) THEN 'corroborated' ELSE 'observed' END AS state FROM lineitem""",
)
def f39(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "CO_OCCURRED").when(F.col("l_returnflag") == "A", "TRANSFERRED_TO").otherwise("OWNS")
    conf = F.when(F.col("l_discount") < 0.03, 0.4).when(F.col("l_discount") >= 0.06, 0.95).otherwise(0.7)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", similarity.edge_state(kind, F.col("l_linenumber"), conf, F.lit(None).cast("string")).alias("state")
    )


@query(
    "f41_claim_tokens",
    r"""WITH c AS (SELECT conv_id, turn, regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}\s@._-]', ' ', 'g'), '\s+') AS t FROM conversations)
SELECT conv_id, turn, coalesce((SELECT string_agg(w, '|' ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest(t) AS w, generate_subscripts(t, 1) AS i)
  WHERE length(w) >= 4 AND w NOT IN (""" + ", ".join(f"'{w}'" for w in similarity.CLAIM_STOP_WORDS) + """) GROUP BY w ORDER BY i LIMIT 10)), '') AS words FROM c""",
)
def f41(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(similarity.claim_tokens(F.col("text")), "|").alias("words"))
