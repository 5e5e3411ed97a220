"""How values are shown, and how written times are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.adapters import table

NONE = "—"


def grouped(n: Column) -> Column:
    """A whole number with Indian grouping: the last three digits, then pairs."""
    whole = F.abs(F.round(n)).cast("decimal(30,0)").cast("string")
    head, tail = F.substring(whole, 1, F.length(whole) - 3), F.right(whole, F.lit(3))
    pairs = F.reverse(F.regexp_replace(F.reverse(head), "([0-9]{2})(?=[0-9])", "$1,"))
    text = F.when(F.length(whole) <= 3, whole).otherwise(F.concat(pairs, F.lit(","), tail))
    return F.coalesce(F.concat(F.when((F.round(n) < 0), "-").otherwise(""), text), F.lit(NONE))


def rupees(amount: Column) -> Column:
    """Rupees without paise, grouped; a dash for null."""
    n = grouped(amount)
    return F.when(n == NONE, n).when(n.startswith("-"), F.concat(F.lit("-₹"), F.substring(n, 2, 60))).otherwise(F.concat(F.lit("₹"), n))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(F.coalesce(text, F.lit("")))


def short_hash(h: Column) -> Column:
    return F.when(F.coalesce(F.length(h), F.lit(0)) == 0, NONE).when(F.length(h) > 12, F.concat(F.substring(h, 1, 8), F.lit("…"), F.right(h, F.lit(4)))).otherwise(h)


def shown_date(t: Column) -> Column:
    return F.coalesce(F.date_format(t, "dd MMM yyyy"), F.lit(NONE))


def written_time(raw: Column) -> Column:
    """Epoch milliseconds (UTC) of an ISO or a day-first date, with or without a time; null for other texts."""
    t = F.regexp_replace(F.trim(raw), r"\s+", " ")
    iso, dmy = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[T ]([0-9]{2}:[0-9]{2})(?::([0-9]{2}))?(?:\.[0-9]+)?Z?)?$", r"^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})(?:[ T]([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?)?"
    g = lambda p, k: F.nullif(F.regexp_extract(t, p, k), F.lit(""))
    two = lambda c: F.lpad(F.coalesce(c, F.lit("0")), 2, "0")
    first = F.concat(g(iso, 1), F.lit(" "), F.coalesce(g(iso, 2), F.lit("00:00")), F.lit(":"), two(g(iso, 3)))
    second = F.concat(g(dmy, 3), F.lit("-"), two(g(dmy, 2)), F.lit("-"), two(g(dmy, 1)), F.lit(" "), two(g(dmy, 4)), F.lit(":"), two(g(dmy, 5)), F.lit(":"), two(g(dmy, 6)))
    return F.unix_millis(F.try_to_timestamp(F.coalesce(F.when(t.rlike(iso), first), F.when(t.rlike(dmy), second)), F.lit("yyyy-MM-dd HH:mm:ss")))


@query(
    "f46_display",
    r"""WITH x AS (SELECT o_orderkey, CAST(round(o_totalprice * 10) AS BIGINT) AS n, o_orderdate AS d FROM orders), y AS (SELECT *, CAST(n AS VARCHAR) AS s FROM x)
SELECT o_orderkey, concat('₹', CASE WHEN length(s) <= 3 THEN s ELSE concat(reverse(rtrim(regexp_replace(reverse(left(s, length(s) - 3)), '(..)', '\1,', 'g'), ',')), ',', right(s, 3)) END) AS amount,
  concat(left(sha256(s), 8), '…', right(sha256(s), 4)) AS hash, strftime(d, '%d %b %Y') AS day, concat('Order ', left(s, 3), '…') AS label FROM y WHERE length(s) >= 5""",
)
def f46(spark: SparkSession, d: str) -> DataFrame:
    n = F.round(F.col("o_totalprice") * 10).cast("long")
    s = n.cast("string")
    rows = table(spark, d, "orders").where(F.length(s) >= 5)
    return rows.select(
        "o_orderkey", rupees(n).alias("amount"), short_hash(F.sha2(s, 256)).alias("hash"), shown_date(F.col("o_orderdate")).alias("day"),
        shortened(F.concat(F.lit("Order "), s), 10).alias("label"),
    )


@query(
    "f22_written_times",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE epoch_ms(o_orderdate::TIMESTAMP) + CASE o_orderkey % 5 WHEN 1 THEN 37800000 WHEN 2 THEN 34205000 ELSE 0 END END AS ms FROM orders""",
)
def f22(spark, d):
    day = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey") % 5
    raw = (
        F.when(k == 0, day("yyyy-MM-dd")).when(k == 1, F.concat(day("yyyy-MM-dd"), F.lit("T10:30:00Z"))).when(k == 2, F.concat(day("d/M/yyyy"), F.lit("  9:30:05")))
        .when(k == 3, F.concat(F.lit(" "), day("dd.MM.yyyy"))).otherwise(F.lit("31/02/2024"))
    )
    return table(spark, d, "orders").select("o_orderkey", written_time(raw).alias("ms"))
