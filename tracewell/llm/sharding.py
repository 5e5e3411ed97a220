"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard draws a number from the key, u in (0, 1), and scores -weight / ln(u); the highest score
gets the record.  The key and the list of shards alone decide, so shards added take records only into
themselves, a removed shard's records alone move, and a shard holds its weight's share of the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

SHARDS = 8


def _draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) from 52 bits of MD5, the same on any engine and version."""
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.lit(str(shard))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def shard_of(key: Column, weights: dict[int, float]) -> Column:
    """The shard of a key; a null key is one key of its own; of equal scores the smaller shard wins."""
    scored = [
        F.struct((F.lit(float(w)) / -F.log(_draw(key, s))).alias("score"), F.lit(-s).alias("s"))
        for s, w in sorted(weights.items())
        if w > 0
    ]
    best = scored[0] if len(scored) == 1 else F.greatest(*scored)
    return (-best["s"]).cast("int")


def with_slots(ws: Workspace, placed: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Add ``slot``: each row's place in its shard by ``order``, counted from 0 without a gap.

    Rows are dealt by ranges of the order; a shard's rows of a range are ranked together, and ranges
    are set off by the running counts.  No task gets more than a range, however large a shard is.
    """
    ranged = ws.table(
        placed.repartitionByRange(*order).select("*", F.spark_partition_id().alias("_range")), "ranged"
    )
    # One row for each range and shard.
    sizes = ranged.groupBy(shard, "_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.selectExpr(
        f"{shard}", "_range", f"sum(_n) OVER (PARTITION BY {shard} ORDER BY _range) - _n AS _start"
    )
    rank = F.expr(f"row_number() OVER (PARTITION BY {shard}, _range ORDER BY {', '.join(order)}) - 1")
    return (
        ranged.withColumn("_rank", rank)
        .join(ws.table(starts, "starts"), [shard, "_range"])
        .withColumn("slot", F.col("_start") + F.col("_rank"))
        .drop("_range", "_rank", "_start")
    )


def assign_shards(spark: SparkSession, docs: DataFrame, weights: dict[int, float]) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard of every row of ``docs`` (doc_id, text).

    size is the text's UTF-8 bytes plus 1, and 1 for a null.  grown_shard is the shard with one more
    shard of the mean weight.  Rows that repeat an id share its shard and have slots of their own.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    grown = weights | {max(weights) + 1: sum(weights.values()) / len(weights)}
    placed = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        shard_of(F.col("doc_id"), weights).alias("shard"),
        shard_of(F.col("doc_id"), grown).alias("grown_shard"),
    )
    return with_slots(Workspace(spark, "shards"), placed, "shard", ["doc_id", "text_crc32", "size"])


def write_shards(spark: SparkSession, docs: DataFrame, path: str, weights: dict[int, float], files: int = 8) -> None:
    """Write ``docs`` as Parquet, a folder for each shard and ``files`` files in it."""
    placed = docs.withColumn("shard", shard_of(F.col("doc_id"), weights))
    dealt = placed.repartition(files * len(weights), "shard", F.pmod(F.xxhash64("doc_id"), F.lit(files)))
    dealt.write.mode("overwrite").partitionBy("shard").parquet(path)


def op9_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign_shards(spark, docs, {s: 1.0 for s in range(SHARDS)}).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
