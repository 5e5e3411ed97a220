"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are hashed into k-grams of ``K`` words; of every ``WINDOW`` consecutive k-grams the one with
the smallest hash is a fingerprint (the rightmost on ties).  Any span of ``SPAN = K + WINDOW - 1``
shared words therefore shares a fingerprint.  Documents keep the fingerprints that pass a bit filter
of the benchmark's; these are joined with the benchmark's by hash, and each hit is extended to the
spans of ``SPAN`` words around it, which are compared word for word.  Benchmark items of fewer than
``SPAN`` words are one window each and are matched at every position of their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower, broadcast_if_small, by_keys, next_pow2

K = 4
WINDOW = 5
SPAN = K + WINDOW - 1
#: Bits of the benchmark's filter for each fingerprint, and at most.  A fuller filter lets more
#: fingerprints through to the join; the result is the same.
FILTER_BITS, FILTER_MOST = 64, 1 << 20

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words; a null text has none."""
    found = F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.filter(found, lambda w: w != "")


def kgrams(w: Column) -> Column:
    """64-bit hashes of the k-grams of an array of words, [] if it has fewer than K words."""
    starts = F.when(F.size(w) >= K, F.sequence(F.lit(0), F.size(w) - K)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(K)]))


def winnow(h: Column) -> Column:
    """Positions of the fingerprints of an array of k-gram hashes, ascending and distinct."""
    ends = F.when(F.size(h) >= WINDOW, F.sequence(F.lit(0), F.size(h) - WINDOW)).otherwise(F.array().cast("array<int>"))

    def pick(i: Column) -> Column:
        low = F.least(*[F.get(h, i + j) for j in range(WINDOW)])
        at = i + 0
        for j in range(1, WINDOW):
            at = F.when(F.get(h, i + j) == low, i + j).otherwise(at)
        return at

    return F.array_distinct(F.transform(ends, pick))


def _filter_literal(prints: DataFrame, count: int):
    """(bitmap as bytes, bits) of the benchmark's fingerprint hashes; the number of bits is bounded."""
    bits = min(FILTER_MOST, max(1024, next_pow2(count * FILTER_BITS)))
    block = min(bits, 32768)
    at = F.pmod("hash", F.lit(bits))
    rows = (
        prints.groupBy((at / block).cast("int").alias("block"))
        .agg(F.bitmap_construct_agg(at % block).alias("b"))
        .collect()
    )
    out = bytearray(bits // 8)
    for r in rows:  # at most FILTER_MOST / 32768 rows
        out[r.block * block // 8 : (r.block + 1) * block // 8] = r.b[: block // 8]
    return out, bits


def _passes(bitmap: Column, bits: int, h: Column) -> Column:
    at = F.pmod(h, F.lit(bits)).cast("int")
    byte = F.ascii(F.decode(bitmap.substr(F.shiftright(at, 3) + 1, F.lit(1)), "ISO-8859-1"))
    return F.getbit(byte, at % 8) == 1


def contamination(
    spark: SparkSession, docs: DataFrame, items: DataFrame, workspace: Workspace | None = None, *, digest: bool = False
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items, and the text's digest if asked for.

    ``items`` has item_id and text.  n_hit counts the document's words inside any occurrence of an
    item's window, n_items the items that have one, and ``items`` holds their ids as sorted strings.
    Null and empty texts have no words.  Rows that repeat an id are counted apart.  Either table may
    be empty; other columns are ignored.
    """
    ws = workspace or Workspace(spark, "winnow")
    bench = ws.table(items.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0"), "bench")
    # Every distinct window of the benchmark, with the items that have it.
    lengths = F.least(F.size("w"), F.lit(SPAN))
    grams = bench.select(
        "item_id",
        lengths.alias("len"),
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.size("w") - lengths),
                lambda i: F.concat_ws(" ", F.slice("w", i + 1, F.least(F.size("w"), F.lit(SPAN)))),
            )
        ).alias("window"),
    ).distinct()
    windows = ws.table(
        grams.groupBy("len", "window").agg(
            F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids")
        ),
        "windows",
    )
    n_windows = windows.count()
    prints = ws.table(
        bench.where(F.size("w") >= SPAN)
        .select(kgrams(F.col("w")).alias("h"))
        .select(F.explode(F.transform(winnow(F.col("h")), lambda i: F.get("h", i))).alias("hash"))
        .distinct(),
        "prints",
    )
    n_prints = prints.count()
    literal, bits = _filter_literal(prints, n_prints)
    lengths = windows.where(F.col("len") < SPAN).groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()
    short = sorted(r.len for r in lengths)  # SPAN - 1 rows at most
    brief = bench.where(F.size("w") < SPAN).select(_short_hash(F.size("w"), F.lit(0)).alias("hash"))
    brief_literal, brief_bits = _filter_literal(brief, sum(r.n for r in lengths))

    scanned = _scan(docs, F.lit(literal), bits, n_prints, short, F.lit(brief_literal), brief_bits, digest)
    rows = ws.table(scanned, "rows")

    hit = (
        rows.where("size(near) > 0")
        .select("row_id", F.explode("near").alias("c"))
        .select("row_id", "c.*")
        .join(broadcast_if_small(prints, n_prints), "hash", "left_semi")
    )
    spans = hit.select("row_id", F.lit(SPAN).alias("len"), F.explode("spans").alias("s")).select(
        "row_id", "len", F.col("s.at").alias("at"), F.col("s.window").alias("window")
    )
    if short:
        spans = spans.unionByName(
            rows.where("size(brief) > 0")
            .select("row_id", F.explode("brief").alias("s"))
            .select("row_id", "s.len", "s.at", "s.window")
        )
    met = ws.table(
        spans.join(broadcast_if_small(windows, n_windows), ["len", "window"]).select("row_id", "len", "at", "ids"), "met"
    )
    covered = (
        met.select("row_id", F.explode(F.sequence("at", F.expr("at + len - 1"))).alias("p"))
        .distinct()
        .groupBy("row_id")
        .agg(F.count(F.lit(1)).alias("n_hit"))
    )
    named = (
        met.select("row_id", "ids")
        .distinct()
        .select("row_id", F.explode("ids").alias("id"))
        .groupBy("row_id")
        .agg(F.array_sort(F.collect_set("id")).alias("items"))
    )
    return (
        rows.drop("near", "brief")
        .join(covered, "row_id", "left")
        .join(named, "row_id", "left")
        .select(
            "doc_id",
            F.col("n_words").cast("long").alias("n_words"),
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            *["digest"] * digest,
        )
    )


def _short_hash(n: Column, i: Column) -> Column:
    """Hash of the n < SPAN words from place i on, whose number it depends on."""
    return F.xxhash64(n, *[F.when(n > j, F.get("w", i + j)) for j in range(SPAN - 1)])


def _window_of(n: int):
    """A function of one place alone: a second argument would get the place's number in the array."""
    return lambda a: F.struct(
        F.lit(n).alias("len"), a.alias("at"), F.concat_ws(" ", F.slice("w", a + 1, F.lit(n))).alias("window")
    )


def _scan(
    docs: DataFrame, bitmap: Column, bits: int, n_prints: int, short: list[int], brief_bitmap: Column, brief_bits: int, digest: bool
) -> DataFrame:
    """One pass over the texts: word counts, and the candidates with the words around them.

    Windows of short items are candidates where their own filter lets their hash through.
    """
    w = docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row_id"),
        words(F.col("text")).alias("w"),
        *[_digest(F.col("text")).alias("digest")] * digest,
    )
    size = F.size("w")
    none = F.array().cast("array<int>")

    def around(i: Column) -> Column:
        first = F.greatest(i - WINDOW + 1, F.lit(0))
        last = F.least(i, F.size("w") - SPAN)
        return F.struct(
            F.get("h", i).alias("hash"),
            F.transform(
                F.sequence(first, last),
                lambda a: F.struct(a.alias("at"), F.concat_ws(" ", F.slice("w", a + 1, F.lit(SPAN))).alias("window")),
            ).alias("spans"),
        )

    h = w.withColumn("h", kgrams(F.col("w")) if n_prints else F.array().cast("array<bigint>"))
    picked = h.withColumn("picked", winnow(F.col("h")))
    kept = picked.withColumn("kept", F.filter("picked", lambda i: _passes(bitmap, bits, F.get("h", i))))
    brief = F.array().cast("array<struct<len:int,at:int,window:string>>")
    for n in short:
        at = F.when(size >= n, F.sequence(F.lit(0), size - n)).otherwise(none)
        at = F.filter(at, _brief_passes(brief_bitmap, brief_bits, n))
        brief = F.concat(brief, F.transform(at, _window_of(n)))
    return kept.select(
        "row_id", "doc_id", size.alias("n_words"), F.transform("kept", around).alias("near"), brief.alias("brief"), *["digest"] * digest
    )


def _brief_passes(bitmap: Column, bits: int, n: int):
    return lambda i: _passes(bitmap, bits, _short_hash(F.lit(n), i))


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, *, least_items: int = 2) -> DataFrame:
    """``docs`` without the rows that hold windows of ``least_items`` benchmark items or more.

    Rows are told apart by id and text, so ids may be null or repeat; null and empty texts stay, all
    columns stay as they are.  An empty table gives no rows, an empty benchmark drops none.
    """
    ws = Workspace(spark, "winnow-filter")
    found = contamination(spark, docs, items, ws, digest=True)
    dirty = ws.table(found.where(F.col("n_items") >= least_items).select("doc_id", "digest").distinct(), "dirty")
    ws.drop("rows", "met")
    return by_keys(ws, docs, dirty, [F.col("doc_id"), _digest(F.col("text"))], "dirty-filter")[1]


def op5_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all ``benchmark`` items; odd rows as in ``contamination``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contamination(spark, docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_items") >= 2).alias("contaminated"),
    )


OP5_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bg AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(0, len(w) - n + 1)) AS i
        FROM (SELECT item_id, w, least(8, len(w)) AS n FROM bw WHERE len(w) > 0))),
dg AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i
        FROM dw, (SELECT DISTINCT n FROM bg) WHERE len(w) >= n)),
m AS (SELECT doc_id, dg.n, i, item_id FROM dg JOIN bg USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM m)) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""
