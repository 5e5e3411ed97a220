"""Removal of globally repeated, content-defined chunks of lines, in DataFrame operations only.

Lines are hashed; a rolling hash over ``ROLL`` line hashes ends a chunk where it is 0 modulo
``DIVISOR``, and a line of ``LONG_LINE`` words or more is a chunk of its own.  Boundaries depend on
nearby lines alone, so an insertion elsewhere in a document does not shift them.  A chunk of two
lines or more, or of one long line, that occurs more than once in the corpus is removed wherever it
occurs but first (smallest doc_id, then the earliest place), after its bytes were compared.

Chunks miss short passages, so the same is done with windows: from each line with words the shortest
run of lines, forward and backward, of more than ``PASSAGE`` words.  Every line with words of a run of
more than ``PASSAGE`` words is in such a window inside the run, so a repeated run goes whole, whatever
its boundaries.  A piece that overlaps its first occurrence stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyFilter, Workspace

ROLL = 2
DIVISOR = 2
LONG_LINE = 40
PASSAGE = 50


def chunked(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, row_id, text) with ``lines`` and ``spans``, the first and last line of each chunk."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    base = docs.select("doc_id", "row_id", lines.alias("lines"))
    base = base.withColumn("h", F.transform("lines", lambda x: F.xxhash64(x))).withColumn(
        "long", F.transform("lines", lambda x: F.size(F.split(x, " ")) >= LONG_LINE)
    )
    last = F.size("lines") - 1

    def ends(i: Column) -> Column:
        rolled = F.lit(0).cast("long")
        for k in range(ROLL):
            rolled = F.xxhash64(rolled, F.coalesce(F.when(i >= k, F.get("h", F.greatest(i - k, F.lit(0)))), F.lit(0).cast("long")))
        return (
            (F.pmod(F.shiftright(rolled, 17), F.lit(DIVISOR)) == 0)
            | F.get("long", i)
            | F.coalesce(F.get("long", i + 1), F.lit(False))
            | (i == last)
        )

    base = base.withColumn("stops", F.filter(F.sequence(F.lit(0), last), ends))
    spans = F.transform(
        "stops",
        lambda e, k: F.struct(
            F.when(k > 0, F.get("stops", F.greatest(k - 1, F.lit(0))) + 1).otherwise(F.lit(0)).alias("a"), e.alias("b")
        ),
    )
    return base.select("doc_id", "row_id", "lines", "long", spans.alias("spans"))


def _reach(words: Column, name: str, base: DataFrame) -> DataFrame:
    """``base`` with the array ``name``: for each place the last one of its window, or the size if it has none.

    Each entry of ``words`` is 1 or more, so a window has at most ``PASSAGE`` + 1 of them; sums over
    runs of powers of two find its end in as many steps, in time that is linear in the lines.
    """
    much = F.lit(1 << 40)
    base = base.withColumn("sum0", F.transform(words, lambda w: w.cast("long")))
    steps = PASSAGE.bit_length()
    for k in range(1, steps):
        base = base.withColumn(f"sum{k}", _doubled(f"sum{k - 1}", 1 << (k - 1), much))
    base = base.withColumn(name, F.transform("sum0", lambda x, i: F.struct(i.alias("at"), F.lit(PASSAGE).cast("long").alias("left"))))
    for k in reversed(range(steps)):
        base = base.withColumn(name, _jumped(name, f"sum{k}", 1 << k, much))
    return base.withColumn(name, F.transform(name, lambda p: p["at"])).drop(*(f"sum{k}" for k in range(steps)))


def _doubled(sums: str, by: int, much: Column) -> Column:
    return F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i + by), much))


def _jumped(name: str, sums: str, by: int, much: Column) -> Column:
    def jump(p: Column) -> Column:
        s = F.coalesce(F.get(sums, p["at"]), much)
        fits = s <= p["left"]
        return F.struct(
            F.when(fits, p["at"] + by).otherwise(p["at"]).alias("at"), F.when(fits, p["left"] - s).otherwise(p["left"]).alias("left")
        )

    return F.transform(name, jump)


def _pieces(base: DataFrame) -> DataFrame:
    """A row for each chunk or window that may be removed: doc_id, row_id, a, b, chunk."""
    spans = F.transform(F.filter("spans", lambda s: (s["b"] > s["a"]) | F.get("long", s["a"])), lambda s: _pair(s["a"], s["b"]))
    rows = base.select("doc_id", "row_id", "lines", spans.alias("pairs"))
    rows = rows.withColumn("words", F.transform("lines", lambda x: F.regexp_count(x, F.lit(r"\S+"))))
    rows = rows.withColumn("full", F.filter(F.transform("words", lambda w, i: F.when(w > 0, i)), lambda i: i.isNotNull()))
    rows = rows.withColumn("words", F.filter("words", lambda w: w > 0)).withColumn("size", F.size("words"))
    rows = _reach(F.col("words"), "ahead", rows)
    rows = _reach(F.reverse("words"), "back", rows)
    none = F.lit(None).cast("long")
    ahead = F.transform("ahead", lambda e, i: F.when(e < F.col("size"), _pair(F.get("full", i), F.get("full", e))).otherwise(none))
    last = F.col("size") - 1
    back = F.transform("back", lambda e, i: F.when(e < F.col("size"), _pair(F.get("full", last - e), F.get("full", last - i))).otherwise(none))
    pairs = F.filter(F.array_union("pairs", F.array_union(ahead, back)), lambda x: x.isNotNull())
    rows = rows.select("doc_id", "row_id", "lines", pairs.alias("pairs"))

    def piece(x):
        a, b = F.shiftright(x, 32).cast("int"), F.pmod(x, F.lit(1 << 32)).cast("int")
        return F.struct(a.alias("a"), b.alias("b"), F.array_join(F.slice("lines", a + 1, b - a + 1), "\n").alias("chunk"))

    rows = rows.select("doc_id", "row_id", F.explode(F.transform("pairs", piece)).alias("s"))
    return rows.select("doc_id", "row_id", "s.a", "s.b", "s.chunk")


def _pair(a: Column, b: Column) -> Column:
    """Two line numbers as one long, which array functions compare by hash."""
    return F.shiftleft(a.cast("long"), 32) + b


def repeated_chunks(spark: SparkSession, docs: DataFrame, ws: Workspace) -> DataFrame:
    """row_id, a, b of every chunk to remove (``docs`` has doc_id, row_id and text)."""
    pieces = _pieces(chunked(docs))
    keyed = pieces.withColumn("key", F.xxhash64(F.lit(7), "chunk"))
    index = ws.table(keyed.select("key", "doc_id", "row_id", "a", "b"), "index")
    first = F.min(F.struct("doc_id", "row_id", "a"))
    repeated = ws.table(
        index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).where("n > 1"), "repeated"
    )
    # Neither the first place itself nor one that overlaps it.
    later = ~F.col("row_id").eqNullSafe(F.col("first.row_id")) | (F.col("a") > F.col("first.a") + F.col("b") - F.col("a"))
    # Bytes are compared where a key repeats; the filter drops all other chunks where they are read,
    # and equal chunks of a task are one before the shuffle.
    maybe, _ = KeyFilter(ws, repeated, F.col("key"), "repeated-filter").split(keyed.select("key", "chunk"), F.col("key"))
    same = (
        maybe.groupBy("key")
        .agg(F.collect_set("chunk").alias("texts"))
        .select("key", (F.size("texts") == 1).alias("same"))
        .join(repeated, "key")
    )
    same = ws.table(same, "same")
    gone = index.join(same.where("same"), "key").where(later).select("row_id", "a", "b")
    clash = same.where(~F.col("same")).select("key")
    if clash.isEmpty():
        return gone
    # Different chunks of one key: the chunk itself is the key.
    rows = ws.table(keyed.join(clash, "key", "left_semi"), "clash")
    own = rows.groupBy("chunk").agg(first.alias("first"))
    return gone.unionByName(
        rows.join(own, "chunk")
        .where(later)
        .select("row_id", "a", "b")
    )


def line_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_lines, n_removed, n_chunks_removed, removed_spans, clean_text.

    ``n_chunks_removed`` counts the removed chunks and windows, which may share lines.  A null text has
    no lines and stays null; an empty one has one empty line.  Rows that repeat an id
    are separate documents, whose first row keeps the chunk.  An empty table gives no rows.
    """
    ws = Workspace(spark, "lines")
    own = docs.select("doc_id", F.monotonically_increasing_id().alias("row_id"), "text")
    gone = ws.table(
        repeated_chunks(spark, own, ws)
        .groupBy("row_id")
        .agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("gone")),
        "gone",
    )
    hit, clean = KeyFilter(ws, gone, F.xxhash64("row_id"), "gone-filter").split(own, F.xxhash64("row_id"))
    none = F.lit(None).cast("array<struct<a:int,b:int>>")
    found = hit.join(gone, "row_id", "left").unionByName(clean.withColumn("gone", none))
    lines = F.split("text", "\n", -1)
    spans = F.coalesce("gone", F.array().cast("array<struct<a:int,b:int>>"))
    dead = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["a"], s["b"]))))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dead")), lambda i: F.get(lines, i))
    return (
        found.withColumn("spans", spans)
        .withColumn("dead", dead)
        .select(
            "doc_id",
            F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
            F.size("dead").cast("long").alias("n_removed"),
            F.size("spans").cast("long").alias("n_chunks_removed"),
            F.col("spans").alias("removed_spans"),
            F.when(F.size("dead") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("clean_text"),
        )
    )


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without their repeated lines; odd rows as in ``line_dedup``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(spark, docs).drop("removed_spans")
