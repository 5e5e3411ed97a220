"""Exact deduplication with a log-structured merge index of text digests, in DataFrame operations only.

* A write-ahead log holds (doc_id, digest) of every row.
* Memtables: the log is dealt into ``memtables`` slices by a hash of the id.  Each slice is flushed
  as a run of (digest, count, extreme ids), kept in digest order, with a blocked bit filter.
* Compaction: a digest whose filter position no other run has set passes through; all others are
  merged over the runs.  Counts add up, and the extreme identifier of the group survives.
* Hits (digests of two rows or more) are verified byte for byte; a digest shared by different texts
  is split by the texts themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyFilter, Workspace, bit_is_set, by_keys, next_pow2

#: Bits of one filter block: what bitmap_construct_agg holds.
BLOCK_BITS = 32768


def sha256(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def exact_groups(
    spark: SparkSession,
    docs: DataFrame,
    *,
    keep: str = "smallest",
    memtables: int = 8,
    digest: Column | None = None,
    workspace: Workspace | None = None,
) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its group of byte-identical texts.

    Returns doc_id, digest, row_id, keep_id, keep_row, group_size, kept.  A null text counts as
    empty.  Of rows that repeat both text and extreme id one stays.  Null ids are allowed and lose
    against any other.  An empty table gives an empty result; other columns are ignored.
    ``digest`` may be replaced by a weaker one in tests, byte verification then splits its groups.
    """
    ws = workspace or Workspace(spark, "exact")
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = sha256(F.col("text")) if digest is None else digest
    order = F.col("doc_id") if keep == "largest" else -F.col("doc_id")

    log = ws.table(
        docs.select(
            "doc_id",
            digest.alias("digest"),
            F.monotonically_increasing_id().alias("row_id"),
            F.pmod(F.xxhash64("doc_id"), F.lit(memtables)).cast("int").alias("run"),
        ),
        "log",
    )
    winner = F.max(F.struct(order.alias("o"), (-F.col("row_id")).alias("r"), F.col("doc_id")))
    runs = ws.table(
        log.groupBy("run", "digest")
        .agg(F.count(F.lit(1)).alias("n"), winner.alias("w"))
        .sortWithinPartitions("digest"),
        "runs",
    )
    merged = _compact(ws, runs)
    hits = ws.table(merged.where("n > 1"), "hits")

    # The filter of the hits drops the other texts where they are read; equal texts of a task are one
    # before the shuffle, so a hot group costs a text for each task.
    texts, _ = KeyFilter(ws, hits, F.xxhash64("digest"), "hit-filter").split(
        docs.select(digest.alias("digest"), text.alias("text")), F.xxhash64("digest")
    )
    verified = ws.table(
        texts.groupBy("digest")
        .agg((F.size(F.collect_set("text")) == 1).alias("same"))
        .join(hits.select("digest"), "digest", "left_semi"),
        "verified",
    )
    clash = verified.where(~F.col("same"))
    if clash.isEmpty():
        groups = hits.select("digest", F.col("w.doc_id").alias("keep_id"), (-F.col("w.r")).alias("keep_row"), "n")
        joined = log.join(groups, "digest", "left")
    else:
        joined = _split_by_text(ws, docs, log, hits, verified, digest, text, winner)
    return joined.select(
        "doc_id",
        "digest",
        "row_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("keep_row", "row_id").alias("keep_row"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce("keep_row", "row_id") == F.col("row_id")).alias("kept"),
    )


def _compact(ws: Workspace, runs: DataFrame) -> DataFrame:
    """One level: (digest, n, w) over all runs."""
    blocks = next_pow2(max(1, runs.count() * 16 // BLOCK_BITS))
    h = F.xxhash64("digest")
    placed = runs.select(
        "*",
        F.pmod(F.shiftright(h, 20), F.lit(blocks)).alias("block"),
        F.pmod(h, F.lit(BLOCK_BITS)).alias("bit"),
    )
    filters = ws.table(
        placed.groupBy("block", "run").agg(F.bitmap_construct_agg("bit").alias("bits")), "filters"
    )
    # A position set in two runs or more may be a repeated digest: pairwise ANDs of the runs'
    # filters would say so, and their union is the set of positions that two filters share.
    positions = (
        filters.groupBy("block")
        .agg(F.collect_list("bits").alias("all"))
        .where(F.size("all") > 1)
    )
    probed = placed.join(positions, "block", "left").select(
        "digest",
        "n",
        "w",
        F.coalesce(
            F.size(F.filter("all", lambda b: bit_is_set(b, F.col("bit")))) > 1, F.lit(False)
        ).alias("maybe"),
    )
    probed = ws.table(probed, "probed")
    alone = probed.where(~F.col("maybe")).select("digest", "n", "w")
    met = (
        probed.where("maybe").groupBy("digest").agg(F.sum("n").alias("n"), F.max("w").alias("w"))
    )
    return alone.unionByName(met)


def _split_by_text(ws, docs, log, hits, verified, digest, text, winner) -> DataFrame:
    """Digests that different texts share are grouped by (digest, text); their rows are dealt new row ids below 0."""
    clash = verified.where(~F.col("same")).select("digest")
    plain = hits.join(clash, "digest", "left_anti").select(
        "digest", F.col("w.doc_id").alias("keep_id"), (-F.col("w.r")).alias("keep_row"), "n"
    )
    rows = ws.table(
        docs.select("doc_id", digest.alias("digest"), text.alias("text"))
        .join(clash, "digest", "left_semi")
        .withColumn("row_id", -1 - F.monotonically_increasing_id()),
        "clash",
    )
    parts = rows.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), winner.alias("w"))
    split = rows.join(parts, ["digest", "text"]).select(
        "doc_id", "digest", "row_id", F.col("w.doc_id").alias("keep_id"), (-F.col("w.r")).alias("keep_row"), "n"
    )
    rest = log.drop("run").join(clash, "digest", "left_anti").join(plain, "digest", "left")
    return rest.unionByName(split)


def exact_dedup(spark: SparkSession, docs: DataFrame, *, keep: str = "smallest") -> DataFrame:
    """``docs`` without the rows whose text another, kept row has; all columns stay as they are.

    Rows are matched by id and text, so ids need not be unique; of wholly equal rows one stays.
    """
    ws = Workspace(spark, "exact-filter")
    dropped = ws.table(
        exact_groups(spark, docs, keep=keep, workspace=ws)
        .where(~F.col("kept"))
        .select("doc_id", "digest", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("twin")),
        "dropped",
    )
    ws.drop("log", "runs", "probed")
    values = [F.col("doc_id"), sha256(F.col("text"))]
    _, kept = by_keys(ws, docs, dropped.where("NOT twin").select("doc_id", "digest"), values, "dropped-filter")
    twins = dropped.where("twin").select("doc_id", "digest").distinct()
    if twins.isEmpty():
        return kept
    same, other = by_keys(ws, kept, twins, values, "twin-filter")
    return other.unionByName(same.dropDuplicates(["doc_id", "text"]))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all ``documents``, the largest id stays; odd rows as in ``exact_groups``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_groups(spark, docs, keep="largest").select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
