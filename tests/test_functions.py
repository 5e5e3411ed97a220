"""Check digits and detectors that SQL does not state."""

from pyspark.sql import functions as F

from tracewell.functions import checksum, normalize
from tracewell.operators import patterns


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_check_digits(spark):
    assert one(spark, checksum.luhn(F.lit("490154203237518"))) and not one(spark, checksum.luhn(F.lit("490154203237519")))
    assert one(spark, checksum.verhoeff(F.lit("2363"))) and not one(spark, checksum.verhoeff(F.lit("2364")))
    assert one(spark, checksum.gstin(F.lit("27AAPFU0939F1ZV"))) and not one(spark, checksum.gstin(F.lit("27AAPFU0939F1ZA")))


def test_nulls_are_empty(spark):
    null = F.lit(None).cast("string")
    assert one(spark, normalize.phone(null)) == "" and one(spark, normalize.account(null)) == ""
    assert one(spark, normalize.amount(null)) is None and one(spark, normalize.date_iso(null)) is None


def test_temporal_sync_counts_days(spark):
    day, hour = 86_400_000_000, 3_600_000_000
    rows = [(f"x{d}", "x", "p", 1.0, d * day + 5 * hour, "d") for d in range(1, 4)]
    rows += [(f"y{d}", "y", "q", 1.0, d * day + 5 * hour + hour // 2, "d") for d in range(1, 4)]
    t = spark.createDataFrame(rows, "id string, sender string, receiver string, amount double, us long, day string")
    found = {r.subject: r.trigger for r in patterns.temporal_sync(t).collect()}
    assert found["x|y"] == "co_occurrences=3;window=1h"
