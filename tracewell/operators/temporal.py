"""Timelines: playback frames, activity windows, overlaps and anomalies of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.adapters import EDGES, TX, edges, transactions

DAY = 86_400_000_000


def step_micros(span_days: float, bins: int) -> tuple[str, float]:
    """Unit and width of a playback frame, as a ceiling of the span over 3 to 24 bins."""
    import math

    per = math.ceil(max(1.0, span_days) / max(1, min(max(bins, 3), 24)))
    if per <= 1:
        return "day", float(DAY)
    if per <= 42:
        return "week", max(1, math.floor(per / 7 + 0.5)) * 7.0 * DAY
    return "month", max(1, math.floor(per / 30 + 0.5)) * 30.44 * DAY


def playback(edge_times: DataFrame, entity_times: DataFrame, bins: int = 8) -> DataFrame:
    """frame, new_edges, new_entities and their running counts; both inputs have ``us``.

    Only the bounds of time come to the driver.  Frames without news are left out, but for the last.
    """
    import math

    low, high = (
        edge_times.select("us").unionByName(entity_times.select("us")).agg(F.min("us"), F.max("us")).first()
    )
    if low is None:
        return edge_times.sparkSession.createDataFrame([], "frame long, new_edges long, new_entities long, cum_edges long, cum_entities long")
    _, step = step_micros((high - low) / DAY, bins)
    frames = max(1, min(48, math.ceil((high - low) / step)))
    at = F.least(F.lit(frames - 1), F.floor((F.col("us") - low) / step)).cast("long")
    news = (
        edge_times.select(at.alias("frame"), F.lit(1).alias("e"), F.lit(0).alias("n"))
        .unionByName(entity_times.select(at.alias("frame"), F.lit(0).alias("e"), F.lit(1).alias("n")))
        .groupBy("frame")
        .agg(F.sum("e").alias("new_edges"), F.sum("n").alias("new_entities"))
    )
    all_ = edge_times.sparkSession.range(frames).withColumnRenamed("id", "frame").join(news, "frame", "left").na.fill(0)
    w = Window.orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)  # at most 48 rows
    return all_.withColumns({"cum_edges": F.sum("new_edges").over(w), "cum_entities": F.sum("new_entities").over(w)}).where(
        (F.col("new_edges") > 0) | (F.col("new_entities") > 0) | (F.col("frame") == frames - 1)
    )


def activity_windows(e: DataFrame) -> DataFrame:
    """First and last observation of every end of dated edges (source, target, first_us, last_us)."""
    ends = e.select(F.explode(F.array("source", "target")).alias("entity"), "first_us", "last_us")
    return ends.groupBy("entity").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


def overlaps(e: DataFrame, windows: DataFrame, most: int = 200) -> DataFrame:
    """Directly linked pairs whose windows overlap, by length of the overlap."""
    pairs = e.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    wa = windows.select(F.col("entity").alias("a"), F.col("first_us").alias("fa"), F.col("last_us").alias("la"))
    wb = windows.select(F.col("entity").alias("b"), F.col("first_us").alias("fb"), F.col("last_us").alias("lb"))
    o = pairs.join(wa, "a").join(wb, "b").withColumns({"start_us": F.greatest("fa", "fb"), "end_us": F.least("la", "lb")})
    return (
        o.where("end_us > start_us")
        .select("a", "b", "start_us", "end_us")
        .orderBy(F.desc(F.col("end_us") - F.col("start_us")), "a", "b")
        .limit(most)
    )


def day_bursts(t: DataFrame) -> DataFrame:
    """Days with more than twice the mean daily count and more than 3 rows; none under four days."""
    days = t.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(1))  # a row for each day
    return days.withColumns({"avg": F.avg("n").over(w), "days": F.count(F.lit(1)).over(w)}).where(
        "days >= 4 AND n > 2 * avg AND n > 3"
    ).select("day", "n")


_T01 = """, o AS (SELECT first_us AS us FROM e), f AS (SELECT min(first_us) AS us FROM (
  SELECT source AS x, first_us FROM e UNION ALL SELECT target, first_us FROM e) GROUP BY x),
b AS (SELECT min(us) AS lo, max(us) AS hi FROM (SELECT us FROM o UNION ALL SELECT us FROM f)),
p AS (SELECT lo, hi, ceil(greatest(1, (hi - lo) / 86400000000.0) / 8) AS per FROM b),
s AS (SELECT lo, hi, CASE WHEN per <= 1 THEN 86400000000.0 ELSE greatest(1, floor(per / 7 + 0.5)) * 7 * 86400000000.0 END AS step FROM p),
c AS (SELECT lo, step, greatest(1, least(48, ceil((hi - lo) / step))) AS frames FROM s),
n AS (SELECT least(frames - 1, floor((us - lo) / step)) AS frame, e1, n1 FROM (
  SELECT us, 1 AS e1, 0 AS n1 FROM o UNION ALL SELECT us, 0, 1 FROM f), c),
g AS (SELECT frame, sum(e1) AS ne, sum(n1) AS nn FROM n GROUP BY 1),
a AS (SELECT i AS frame, coalesce(ne, 0) AS ne, coalesce(nn, 0) AS nn, frames FROM c, range(48) r(i) LEFT JOIN g ON g.frame = i WHERE i < frames)
SELECT CAST(frame AS BIGINT) AS frame, CAST(ne AS BIGINT) AS new_edges, CAST(nn AS BIGINT) AS new_entities, CAST(ce AS BIGINT) AS cum_edges, CAST(cn AS BIGINT) AS cum_entities
FROM (SELECT *, sum(ne) OVER (ORDER BY frame) AS ce, sum(nn) OVER (ORDER BY frame) AS cn FROM a) WHERE ne > 0 OR nn > 0 OR frame = frames - 1"""


@query("t01_playback", f"WITH {EDGES}{_T01}")
def t01(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return playback(e.select(F.col("first_us").alias("us")), activity_windows(e).select(F.col("first_us").alias("us")))


_W = """, w AS (SELECT x AS entity, min(first_us) AS first_us, max(last_us) AS last_us FROM (
  SELECT source AS x, first_us, last_us FROM e UNION ALL SELECT target, first_us, last_us FROM e) GROUP BY 1)"""


@query("t02_activity_windows", f"WITH {EDGES}{_W} SELECT * FROM w")
def t02(spark, d):
    return activity_windows(edges(spark, d))


@query(
    "t03_overlaps",
    f"""WITH {EDGES}{_W}, p AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM e)
SELECT a, b, greatest(x.first_us, y.first_us) AS start_us, least(x.last_us, y.last_us) AS end_us
FROM p JOIN w x ON x.entity = a JOIN w y ON y.entity = b WHERE least(x.last_us, y.last_us) > greatest(x.first_us, y.first_us)
ORDER BY end_us - start_us DESC, a, b LIMIT 200""",
)
def t03(spark, d):
    e = edges(spark, d)
    return overlaps(e, activity_windows(e))


@query(
    "a01_day_bursts",
    f"""WITH {TX}, u AS (SELECT day, count(*) AS n FROM t GROUP BY 1)
SELECT day, n FROM u WHERE n > 2 * (SELECT avg(n) FROM u) AND n > 3 AND (SELECT count(*) FROM u) >= 4""",
)
def a01_bursts(spark, d):
    return day_bursts(transactions(spark, d))
