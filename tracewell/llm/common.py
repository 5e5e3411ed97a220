"""Shared helpers of the training-data operators: tables, shared folders, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast by hint only when it has at most this many rows; beyond it Spark shuffles.
BROADCAST_ROWS = 200_000
#: Bytes of an Arrow batch between an executor and its Python workers; both hold a few at once.
BATCH_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where that is unset on a local master (tests) a temporary folder is made and set; on a
    cluster a folder of one machine would lose rows, so the setting is demanded there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Workspace:
    """Written tables under the shared folder that cut lineage and survive lost executors.

    ``table`` writes a frame as Parquet and returns the reread frame; ``drop`` deletes one that is
    no longer needed.  What is left is deleted when the Python driver ends, because lazily
    evaluated results may still read it.  With ``tidy`` the shuffle files of a write go at its end,
    not when the driver's garbage happens to be collected.
    """

    def __init__(self, spark: SparkSession, name: str, *, tidy: bool = False):
        self.spark, self.tidy = spark, tidy
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, None)
        if self.tidy:
            self.spark.conf.set(key, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            if self.tidy:
                self.spark.conf.unset(key) if before is None else self.spark.conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may have ended before the interpreter does
            if path.startswith("file:") and os.path.isdir(local := path.removeprefix("file://")):
                import shutil

                shutil.rmtree(local, ignore_errors=True)


class KeyFilter:
    """A blocked bit filter over the hashes of a set of keys, for dropping rows before a shuffle.

    The filter is broadcast as blocks of 4 KB; ``BLOCKS`` bounds it to 16 MB however many keys there
    are.  A fuller filter lets more rows through to the exact join behind it and never drops a match.
    """

    BITS, PER_KEY, BLOCKS = 32768, 64, 4096

    def __init__(self, ws: Workspace, keys: DataFrame, key_hash: Column, name: str):
        n = keys.count()
        self.blocks = min(self.BLOCKS, next_pow2(max(1, n * self.PER_KEY // self.BITS)))
        self.table = ws.table(
            keys.select(self._block(key_hash).alias("_block"), self._bit(key_hash).alias("_bit"))
            .groupBy("_block")
            .agg(F.bitmap_construct_agg("_bit").alias("_bits")),
            name,
        )

    def _block(self, h: Column) -> Column:
        return F.pmod(F.shiftright(h, 20), F.lit(self.blocks))

    def _bit(self, h: Column) -> Column:
        return F.pmod(h, F.lit(self.BITS))

    def split(self, df: DataFrame, key_hash: Column) -> tuple[DataFrame, DataFrame]:
        """(rows that may hold a key, rows that hold none); together they are ``df``."""
        block, bit, bits = fresh(df, 3)
        table = self.table.select(F.col("_block").alias(block), F.col("_bits").alias(bits))
        marked = df.withColumns({block: self._block(key_hash), bit: self._bit(key_hash)}).join(F.broadcast(table), block, "left")
        maybe = F.coalesce(bit_is_set(F.col(bits), F.col(bit)), F.lit(False))
        return marked.where(maybe).select(*df.columns), marked.where(~maybe).select(*df.columns)


def fresh(df: DataFrame, n: int) -> list[str]:
    """Column names that ``df`` does not have."""
    taken, out, k = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if (name := f"tw_{k}") not in taken:
            out.append(name)
        k += 1
    return out


def bit_is_set(bits: Column, position: Column) -> Column:
    """Whether bitmap_construct_agg set a position."""
    byte = F.ascii(F.decode(bits.substr((F.shiftright(position, 3) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
    return F.getbit(byte, (position % 8).cast("int")) == 1


def by_keys(ws: Workspace, df: DataFrame, keys: DataFrame, values: list[Column], name: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` whose ``values`` are a row of ``keys``, the other rows); nulls equal nulls.

    Only the rows which a bounded filter of the keys lets through are shuffled.
    """
    names = fresh(df, len(values))
    keys = keys.toDF(*names)
    on = None
    for value, key in zip(values, names):
        same = value.eqNullSafe(F.col(key))
        on = same if on is None else on & same
    maybe, none = KeyFilter(ws, keys, F.xxhash64(*names), name).split(df, F.xxhash64(*values))
    return maybe.join(keys, on, "left_semi"), none.unionByName(maybe.join(keys, on, "left_anti"))


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the counted rows are within the limit; otherwise leave the choice to Spark."""
    return F.broadcast(df) if rows <= limit else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone.  ``lower`` does that for pure ASCII; other texts go through ``translate``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def next_pow2(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


def open_shared(uri: str):
    """(filesystem, path) for a shared-folder URI, for Python code that runs on executors."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def trimmed(run):
    """``run`` for mapInArrow, giving freed memory back at its end: workers outlive their tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):  # glibc alone has it
                libc.malloc_trim(0)

    return wrapped


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes unless it has a bound: by rows alone, one is a whole input partition of texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers where their path does not hold it already."""
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    known = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)] + [Path.cwd()]
    app = spark.sparkContext.applicationId
    if root in known or app in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1].name
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package}", "zip", root, package)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
