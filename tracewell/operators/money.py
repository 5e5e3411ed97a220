"""Money-flow operators over transactions (id, sender, receiver, amount, us, day).

Self-transfers count for accounts and fan statistics, and are no edges.  Ties in time are ordered by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..plans.registry import query
from ..sources.adapters import TX, transactions

DAY = 86_400_000_000
HOUR = 3_600_000_000


def r4(c: Column) -> Column:
    return F.round(c, 4)


def chronological(t: DataFrame) -> DataFrame:
    return t.orderBy("us", "id")


def account_nodes(t: DataFrame) -> DataFrame:
    """Volumes and counts in and out of every account."""
    both = t.select(
        F.explode(
            F.array(
                F.struct(F.col("sender").alias("account"), F.lit(0).alias("inward")),
                F.struct(F.col("receiver").alias("account"), F.lit(1).alias("inward")),
            )
        ).alias("p"),
        "amount",
    ).select("p.*", "amount")
    inward = F.col("inward") == 1
    return both.groupBy("account").agg(
        F.sum(F.when(inward, F.col("amount")).otherwise(0.0)).alias("in_volume"),
        F.sum(F.when(inward, F.lit(0.0)).otherwise(F.col("amount"))).alias("out_volume"),
        F.count_if(inward).alias("in_count"),
        F.count_if(~inward).alias("out_count"),
    )


def account_edges(t: DataFrame) -> DataFrame:
    return (
        t.where("sender <> receiver")
        .groupBy("sender", "receiver")
        .agg(
            F.sum("amount").alias("total"),
            F.count(F.lit(1)).alias("n"),
            F.min("day").alias("first_day"),
            F.max("day").alias("last_day"),
            F.array_sort(F.collect_list("id")).alias("txn_ids"),
        )
    )


def fan(t: DataFrame, side: str) -> DataFrame:
    """side "in": per receiver, its senders; "out": per sender, its receivers."""
    own, other = ("receiver", "sender") if side == "in" else ("sender", "receiver")
    return t.groupBy(F.col(own).alias("account")).agg(
        F.countDistinct(other).alias("counterparties"),
        F.count(F.lit(1)).alias("n"),
        F.sum("amount").alias("volume"),
    )


def velocity(t: DataFrame, days: int = DEFAULT.velocity_days) -> DataFrame:
    """Per account and own transaction: count and volume of the window of ``days`` that starts with it.

    Transactions at the same instant with a smaller id are before the window.  Rows are dealt by
    account and window-sized bucket (each also to the bucket before), so a busy account is many groups.
    """
    span = days * DAY
    own = t.select(
        "id", "us", "amount", F.explode(F.array_distinct(F.array("sender", "receiver"))).alias("account")
    ).withColumn("home", F.floor(F.col("us") / span))
    rows = own.withColumn("bucket", F.explode(F.array(F.col("home"), F.col("home") - 1)))
    ahead = Window.partitionBy("account", "bucket").orderBy("us").rangeBetween(0, span - 1)
    ties = Window.partitionBy("account", "bucket", "us").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumns({"c": F.count(F.lit(1)).over(ahead), "v": F.sum("amount").over(ahead)})
        .withColumns({"c0": F.count(F.lit(1)).over(ties), "v0": F.coalesce(F.sum("amount").over(ties), F.lit(0.0))})
        .where("bucket = home")
        .select("account", "id", "us", (F.col("c") - F.col("c0")).alias("n"), (F.col("v") - F.col("v0")).alias("volume"))
    )


def recurring(t: DataFrame, spread: float = DEFAULT.recurring_spread) -> DataFrame:
    g = t.groupBy("sender", "receiver").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.avg("amount").alias("avg_amount"),
        F.min("amount").alias("min_amount"),
        F.max("amount").alias("max_amount"),
    )
    ratio = F.when(F.col("avg_amount") == 0, 0.0).otherwise((F.col("max_amount") - F.col("min_amount")) / F.col("avg_amount"))
    return g.where((F.col("occurrences") >= 2) & (ratio <= spread))


def _by_sender() -> Window:
    return Window.partitionBy("sender").orderBy("us", "id")


def rapid_hops(t: DataFrame, gap: int = HOUR) -> DataFrame:
    """Successive transfers of one sender less than ``gap`` apart, the later not to the sender itself."""
    w = _by_sender()
    return (
        t.withColumns({"before_id": F.lag("id").over(w), "wait": F.col("us") - F.lag("us").over(w)})
        .where((F.col("wait") >= 0) & (F.col("wait") < gap) & (F.col("receiver") != F.col("sender")))
        .select("sender", "receiver", "before_id", "id", F.floor(F.col("wait") / 60_000_000).alias("minutes"))
    )


def spikes(t: DataFrame, factor: float = DEFAULT.spike_factor, rows: int = DEFAULT.spike_rows, days: int = 7) -> DataFrame:
    """Amounts above ``factor`` times the mean of the sender's at most ``rows`` earlier transfers of ``days`` days, of 3 or more."""
    w = _by_sender().rowsBetween(-rows, -1)
    near = F.filter(F.collect_list(F.struct("us", "amount")).over(w), lambda x: F.col("us") - x["us"] <= days * DAY)
    return (
        t.withColumn("near", near)
        .withColumn("seen", F.size("near"))
        .withColumn("avg_before", F.aggregate("near", F.lit(0.0), lambda a, x: a + x["amount"]) / F.greatest("seen", F.lit(1)))
        .where((F.col("seen") >= 3) & (F.col("avg_before") > 0) & (F.col("amount") > factor * F.col("avg_before")))
        .select("sender", "id", "amount", "avg_before", "seen")
    )


def dormant_then_active(t: DataFrame, days: float = DEFAULT.dormant_days) -> DataFrame:
    """A gap of ``days`` or more in a sender's transfers, and another transfer within a day after it."""
    w = _by_sender()
    return (
        t.withColumns(
            {
                "before_id": F.lag("id").over(w),
                "gap": F.col("us") - F.lag("us").over(w),
                "after_id": F.lead("id").over(w),
                "burst": F.lead("us").over(w) - F.col("us"),
            }
        )
        .where((F.col("gap") >= int(days * DAY)) & (F.col("burst") < DAY))
        .select("sender", "before_id", "id", "after_id", F.floor(F.col("gap") / DAY).alias("days"))
    )


def aggregate_stats(t: DataFrame) -> DataFrame:
    return t.agg(
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_volume"),
        F.count(F.lit(1)).alias("total_count"),
        F.coalesce(F.avg("amount"), F.lit(0.0)).alias("mean_amount"),
        F.coalesce(F.median("amount"), F.lit(0.0)).alias("median_amount"),
        F.coalesce(F.max("amount"), F.lit(0.0)).alias("max_amount"),
        F.coalesce(F.min("amount"), F.lit(0.0)).alias("min_amount"),
    )


def breakdown(t: DataFrame, columns: list[str]) -> DataFrame:
    """Count and volume by the values of several columns, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("key")) for c in columns])).alias("p")
    return t.select(pairs, "amount").select("p.*", "amount").where("key IS NOT NULL AND key <> ''").groupBy("field", "key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("volume")
    )


def trace(t: DataFrame, account: str, hops: int, backward: bool = False) -> DataFrame:
    """All simple transfer paths from an account (into it, if ``backward``): path of ids, accounts and how it ends.

    A path ends at ``hops`` transfers, at an account that sends no further, or with the transfer that
    closes a cycle.  The frontier is one join with the transfers for each hop.
    """
    a, b = ("receiver", "sender") if backward else ("sender", "receiver")
    step = t.where("receiver IS NOT NULL AND sender IS NOT NULL").select(F.col(a).alias("at"), F.col(b).alias("next"), "id")
    live = t.sparkSession.range(1).select(
        F.lit(account).alias("at"), F.array().cast("array<bigint>").alias("path"), F.array(F.lit(account)).alias("accounts")
    )
    done = None
    for hop in range(1, hops + 1):
        found = live.join(step, "at", "left")
        dead = found.where(F.col("id").isNull() & (F.size("path") > 0)).select("path", "accounts", F.lit("end").alias("ends"))
        onward = found.where(F.col("id").isNotNull())
        seen = F.array_contains("accounts", F.col("next"))
        cycle = onward.where(seen & (F.size("path") > 0)).select(
            F.array_append("path", F.col("id")).alias("path"), F.array_append("accounts", F.col("next")).alias("accounts"), F.lit("cycle").alias("ends")
        )
        live = onward.where(~seen).select(
            F.col("next").alias("at"), F.array_append("path", F.col("id")).alias("path"), F.array_append("accounts", F.col("next")).alias("accounts")
        )
        parts = dead.unionByName(cycle)
        done = parts if done is None else done.unionByName(parts)
        if hop == hops:
            done = done.unionByName(live.select("path", "accounts", F.lit("depth").alias("ends")))
    return done


def circular_flows(t: DataFrame, hops: int = DEFAULT.max_hops) -> DataFrame:
    """Closed transfer paths of 2 to ``hops`` transfers, one for each set of ids, started at its smallest id."""
    step = t.where("sender <> receiver").select(F.col("sender").alias("at"), F.col("receiver").alias("next"), "id")
    # Every account of a cycle both sends and receives.
    sends, receives = step.select(F.col("at").alias("next")).distinct(), step.select(F.col("next").alias("at")).distinct()
    step = step.join(sends, "next", "left_semi").join(receives, "at", "left_semi")
    live = step.select(
        F.col("at").alias("start"), F.col("next").alias("at"), F.array("id").alias("path"), F.array("at", "next").alias("accounts")
    )
    done = None
    for _ in range(2, hops + 1):
        # Every rotation of a cycle exists; following only ids above the first keeps one of them.
        found = live.join(step, "at").where(F.col("id") > F.get("path", F.lit(0)))
        closed = found.where("next = start").select(F.array_append("path", F.col("id")).alias("path"), "accounts")
        done = closed if done is None else done.unionByName(closed)
        live = found.where(~F.array_contains("accounts", F.col("next"))).select(
            "start", F.col("next").alias("at"), F.array_append("path", F.col("id")).alias("path"), F.array_append("accounts", F.col("next")).alias("accounts")
        )
    return done


# Queries


@query("m01_chronological", f"WITH {TX} SELECT id, us FROM t ORDER BY us, id")
def m01(spark: SparkSession, d: str) -> DataFrame:
    return chronological(transactions(spark, d).select("id", "us"))


@query(
    "m02_account_nodes",
    f"""WITH {TX}, p AS (SELECT receiver AS account, 1 AS i, amount FROM t UNION ALL SELECT sender, 0, amount FROM t)
SELECT account, round(sum(CASE WHEN i = 1 THEN amount ELSE 0 END), 4) AS in_volume,
  round(sum(CASE WHEN i = 0 THEN amount ELSE 0 END), 4) AS out_volume,
  count(*) FILTER (WHERE i = 1) AS in_count, count(*) FILTER (WHERE i = 0) AS out_count FROM p GROUP BY account""",
)
def m02(spark, d):
    n = account_nodes(transactions(spark, d))
    return n.withColumns({"in_volume": r4(F.col("in_volume")), "out_volume": r4(F.col("out_volume"))})


@query(
    "m03_account_edges",
    f"""WITH {TX} SELECT sender, receiver, round(sum(amount), 4) AS total, count(*) AS n, min(day) AS first_day,
  max(day) AS last_day, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS txn_ids
FROM t WHERE sender <> receiver GROUP BY 1, 2""",
)
def m03(spark, d):
    e = account_edges(transactions(spark, d))
    return e.withColumns({"total": r4(F.col("total")), "txn_ids": F.concat_ws(",", F.col("txn_ids").cast("array<string>"))})


_TRACE = """WITH RECURSIVE {tx}, s AS (SELECT * FROM t),
r AS (SELECT '{acc}' AS at, CAST([] AS BIGINT[]) AS path, ['{acc}'] AS accounts, 0 AS cyc
  UNION ALL SELECT s.{b}, list_append(r.path, s.id), list_append(r.accounts, s.{b}), CASE WHEN list_contains(r.accounts, s.{b}) THEN 1 ELSE 0 END
  FROM r JOIN s ON s.{a} = r.at WHERE r.cyc = 0 AND len(r.path) < {hops})
SELECT array_to_string(path, ',') AS path, CAST(len(path) AS INTEGER) AS hops,
  CASE WHEN cyc = 1 THEN 'cycle' WHEN len(path) = {hops} THEN 'depth' ELSE 'end' END AS ends FROM r
WHERE (cyc = 1 AND len(path) > 1) OR (cyc = 0 AND len(path) > 0 AND
  (len(path) = {hops} OR NOT EXISTS (SELECT 1 FROM s WHERE s.{a} = r.at)))"""


def _paths(p: DataFrame) -> DataFrame:
    return p.select(F.concat_ws(",", F.col("path").cast("array<string>")).alias("path"), F.size("path").alias("hops"), "ends")


def _account_paths(t: DataFrame) -> DataFrame:
    return trace(t, "U7", 4).select(F.concat_ws(">", "accounts").alias("accounts")).distinct()


@query("m04_trace_forward", _TRACE.format(tx=TX, acc="U7", a="sender", b="receiver", hops=4))
def m04(spark, d):
    return _paths(trace(transactions(spark, d), "U7", 4))


@query("m05_trace_backward", _TRACE.format(tx=TX, acc="U7", a="receiver", b="sender", hops=4))
def m05(spark, d):
    return _paths(trace(transactions(spark, d), "U7", 4, backward=True))


@query(
    "m06_account_paths",
    "SELECT DISTINCT accounts FROM ("
    + _TRACE.format(tx=TX, acc="U7", a="sender", b="receiver", hops=4).replace(
        "SELECT array_to_string(path, ',') AS path", "SELECT array_to_string(accounts, '>') AS accounts, array_to_string(path, ',') AS path"
    )
    + ")",
)
def m06(spark, d):
    return _account_paths(transactions(spark, d))


_FAN = """WITH {tx} SELECT {own} AS account, count(DISTINCT {other}) AS counterparties, count(*) AS n,
  round(sum(amount), 4) AS volume FROM t GROUP BY 1"""


@query("m07_fan_in", _FAN.format(tx=TX, own="receiver", other="sender"))
def m07_in(spark, d):
    return fan(transactions(spark, d), "in").withColumn("volume", r4(F.col("volume")))


@query("m07_fan_out", _FAN.format(tx=TX, own="sender", other="receiver"))
def m07_out(spark, d):
    return fan(transactions(spark, d), "out").withColumn("volume", r4(F.col("volume")))


# DuckDB takes too long for cycles of larger tables: tests compare them with plain Python.
@query("m08_circular_flows")
def m08(spark, d):
    return _cycles(transactions(spark, d))


def _cycles(t: DataFrame) -> DataFrame:
    c = circular_flows(t)
    return c.select(F.concat_ws(",", F.array_sort("path").cast("array<string>")).alias("txn_ids"), F.size("path").alias("hops")).distinct()


_VELOCITY = f"""WITH {TX}, a AS (SELECT id, us, amount, sender AS account FROM t
  UNION ALL SELECT id, us, amount, receiver FROM t WHERE receiver <> sender),
v AS (SELECT x.account, x.id, x.us, count(*) AS n, sum(y.amount) AS volume FROM a x JOIN a y ON x.account = y.account
  AND y.us < x.us + 604800000000 AND (y.us > x.us OR (y.us = x.us AND y.id >= x.id)) GROUP BY ALL)"""


@query("m09_velocity", _VELOCITY + " SELECT account, id, n, round(volume, 4) AS volume FROM v")
def m09(spark, d):
    return velocity(transactions(spark, d)).select("account", "id", "n", r4(F.col("volume")).alias("volume"))


@query(
    "m10_recurring",
    f"""WITH {TX} SELECT sender, receiver, count(*) AS occurrences, round(avg(amount), 4) AS avg_amount, min(amount) AS min_amount,
  max(amount) AS max_amount FROM t GROUP BY 1, 2
HAVING count(*) >= 2 AND (avg(amount) = 0 OR (max(amount) - min(amount)) / avg(amount) <= 0.2)""",
)
def m10(spark, d):
    return recurring(transactions(spark, d)).withColumn("avg_amount", r4(F.col("avg_amount")))


_LAGS = f"""WITH {TX}, l AS (SELECT *, lag(id) OVER w AS before_id, us - lag(us) OVER w AS wait, lead(id) OVER w AS after_id,
  lead(us) OVER w - us AS burst FROM t WINDOW w AS (PARTITION BY sender ORDER BY us, id))"""


@query(
    "m11_rapid_hops",
    _LAGS + " SELECT sender, receiver, before_id, id, CAST(floor(wait / 60000000) AS BIGINT) AS minutes FROM l WHERE wait >= 0 AND wait < 3600000000 AND receiver <> sender",
)
def m11(spark, d):
    return rapid_hops(transactions(spark, d))


@query(
    "m12_spikes",
    f"""WITH {TX}, r AS (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY us, id) AS k FROM t),
j AS (SELECT x.sender, x.id, x.amount, avg(y.amount) AS avg_before, count(*) AS seen FROM r x JOIN r y
  ON x.sender = y.sender AND y.k < x.k AND y.k >= x.k - 30 AND x.us - y.us <= 604800000000 GROUP BY ALL)
SELECT sender, id, amount, round(avg_before, 4) AS avg_before, CAST(seen AS INTEGER) AS seen FROM j
WHERE seen >= 3 AND avg_before > 0 AND amount > 5 * avg_before""",
)
def m12(spark, d):
    return spikes(transactions(spark, d)).withColumn("avg_before", r4(F.col("avg_before")))


@query(
    "m13_dormant_then_active",
    _LAGS + " SELECT sender, before_id, id, after_id, CAST(floor(wait / 86400000000) AS BIGINT) AS days FROM l WHERE wait >= 2 * 86400000000 AND burst < 86400000000",
)
def m13(spark, d):
    return dormant_then_active(transactions(spark, d), days=2)


@query(
    "m14_aggregate_stats",
    f"""WITH {TX} SELECT round(sum(amount), 4) AS total_volume, count(*) AS total_count, round(avg(amount), 4) AS mean_amount,
  round(median(amount), 4) AS median_amount, max(amount) AS max_amount, min(amount) AS min_amount FROM t""",
)
def m14(spark, d):
    s = aggregate_stats(transactions(spark, d))
    return s.withColumns({c: r4(F.col(c)) for c in ("total_volume", "mean_amount", "median_amount")})


@query(
    "m14_breakdown",
    f"""WITH {TX} SELECT 'day' AS field, day AS key, count(*) AS n, round(sum(amount), 4) AS volume FROM t GROUP BY day
UNION ALL SELECT 'receiver', receiver, count(*), round(sum(amount), 4) FROM t GROUP BY receiver""",
)
def m14_breakdown(spark, d):
    return breakdown(transactions(spark, d), ["day", "receiver"]).withColumn("volume", r4(F.col("volume")))


@query(
    "m16_flow_bundle",
    f"""WITH {TX}, i AS (SELECT receiver AS account, count(DISTINCT sender) AS v FROM t GROUP BY 1),
o AS (SELECT sender AS account, count(DISTINCT receiver) AS v FROM t GROUP BY 1),
f AS (SELECT concat(sender, '>', receiver) AS account, count(*) AS v FROM t WHERE sender <> receiver GROUP BY 1),
u AS (SELECT 'fan_in' AS list, * FROM i UNION ALL SELECT 'fan_out', * FROM o UNION ALL SELECT 'flow', * FROM f)
SELECT list, account, v AS score, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY v DESC, account) AS k FROM u) WHERE k <= 20""",
)
def m16(spark, d):
    t = transactions(spark, d)
    flows = account_edges(t).select(F.concat_ws(">", "sender", "receiver").alias("account"), F.col("n").alias("score"))
    lists = [("fan_in", fan(t, "in").select("account", F.col("counterparties").alias("score"))), ("fan_out", fan(t, "out").select("account", F.col("counterparties").alias("score"))), ("flow", flows)]
    u = None
    for name, df in lists:
        part = df.orderBy(F.desc("score"), "account").limit(20).select(F.lit(name).alias("list"), "account", "score")
        u = part if u is None else u.unionByName(part)
    w = Window.partitionBy("list").orderBy(F.desc("score"), "account")
    return u.withColumn("place", F.row_number().over(w))
