"""Token ids in directly addressable files.

An id is split into chunks of 8 bits.  Level 1 holds the low chunk of every id and a continuation
bit for each; level k + 1 holds the next chunk of the ids whose bit is set, so id i of a level goes
on at position rank1(bitmap, i) of the next.  A rank directory (set bits before every block of 512)
makes that rank one lookup and a few popcounts: any token is read without decoding a block.

File: magic, segments of at most ``SEGMENT`` tokens, document directory, segment directory, footer.
One file is written for each range of document ids; a manifest gives the files' first tokens.
Files are written beside their place and moved there, so a task that is run again, or twice at the
same time, leaves the same file.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, open_shared, ship, trimmed
from .tokens import END_ID, batches_by_bytes, encoder

MAGIC = b"TWDAC\x00\x00\x01"
SEGMENT = 1 << 20
RANK_BLOCK = 512
FOOTER = struct.Struct("<QQQQ8s")  # places of the two directories, documents, segments, magic


def encode_levels(ids: np.ndarray) -> bytes:
    """One segment: n and, for each level, its length, chunks, bitmap and rank directory."""
    rest = ids.astype(np.uint32)
    out = [struct.pack("<I", len(rest))]
    while True:
        more = rest > 0xFF
        out += [struct.pack("<I", len(rest)), (rest & 0xFF).astype(np.uint8).tobytes()]
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), RANK_BLOCK)) if len(more) else []
        ranks = np.concatenate([[0], np.cumsum(counts)]).astype("<u4")
        out += [bits.tobytes(), ranks.tobytes()]
        if not more.any():
            return b"".join(out)
        rest = rest[more] >> 8


class Segment:
    """Reader of one encoded segment."""

    def __init__(self, data: bytes):
        self.n = struct.unpack_from("<I", data)[0]
        self.levels = []
        at = 4
        while at < len(data):
            (n,) = struct.unpack_from("<I", data, at)
            at += 4
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            bits = np.frombuffer(data, np.uint8, (n + 7) // 8, at)
            at += len(bits)
            ranks = np.frombuffer(data, "<u4", (n + RANK_BLOCK - 1) // RANK_BLOCK + 1, at)
            at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def token(self, i: int) -> int:
        """Id at position i, by one rank on each level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // RANK_BLOCK * RANK_BLOCK
            before = int.from_bytes(bits[first >> 3 : (i >> 3) + 1].tobytes(), "little") & ((1 << (i - first)) - 1)
            i = int(ranks[i // RANK_BLOCK]) + before.bit_count()
            shift += 8
        return value

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        out = np.zeros(self.n, np.uint32)
        where, shift = np.arange(self.n), 0
        for chunks, bits, _ in self.levels:
            out[where] |= chunks.astype(np.uint32) << np.uint32(shift)
            where = where[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
            shift += 8
        return out


class TokenFileWriter:
    """Writes one file; documents come in the order of their ids."""

    def __init__(self, uri: str):
        self.fs, self.path = open_shared(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temporary)
        self.out.write(MAGIC)
        self.place, self.n_tokens = len(MAGIC), 0
        self.waiting, self.n_waiting = [], 0
        self.segments, self.doc_ids, self.sizes = [], [], []

    def add(self, doc_ids: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.sizes.append(sizes)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= SEGMENT:
            self._flush(SEGMENT)

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.waiting)
        at = 0
        while len(ids) - at >= max(1, least):
            data = encode_levels(ids[at : at + SEGMENT])
            self.segments.append((self.place, len(data), self.n_tokens))
            self.out.write(data)
            self.place += len(data)
            self.n_tokens += min(SEGMENT, len(ids) - at)
            at += SEGMENT
        self.waiting, self.n_waiting = [ids[at:]], max(0, len(ids) - at)

    def close(self) -> int:
        if self.n_waiting:
            self._flush(1)
        ids = np.array([0 if d is None else d for d in self.doc_ids], "<i8")
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        sizes = np.concatenate(self.sizes).astype("<u8") if self.sizes else np.empty(0, "<u8")
        documents = self.place
        self.out.write(ids.tobytes() + known.tobytes() + sizes.tobytes())
        segments = documents + 17 * len(ids)
        self.out.write(np.array(self.segments, "<u8").tobytes())
        self.out.write(FOOTER.pack(documents, segments, len(ids), len(self.segments), MAGIC))
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return self.n_tokens


class TokenFile:
    """Random access to one file."""

    def __init__(self, uri: str):
        fs, path = open_shared(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        documents, segments, n, k, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, end - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        raw = self.file.read_at(17 * n, documents)
        known = np.frombuffer(raw, np.uint8, n, 8 * n)
        self.doc_ids = [int(d) if ok else None for d, ok in zip(np.frombuffer(raw, "<i8", n), known)]
        self.sizes = np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.segments = np.frombuffer(self.file.read_at(24 * k, segments), "<u8").reshape(k, 3).astype(np.int64)
        self._last: tuple[int, Segment] | None = None

    def segment(self, k: int) -> Segment:
        if self._last is None or self._last[0] != k:
            place, size, _ = self.segments[k]
            self._last = k, Segment(self.file.read_at(int(size), int(place)))
        return self._last[1]

    def token(self, i: int) -> int:
        k = int(np.searchsorted(self.segments[:, 2], i, "right")) - 1
        return self.segment(k).token(i - int(self.segments[k, 2]))

    def documents(self):
        """(doc_id, first token in the file, ids) of each document; one segment is held at a time."""
        k, held, first = -1, np.empty(0, np.uint32), 0
        for doc, start, size in zip(self.doc_ids, self.starts.tolist(), self.sizes.tolist()):
            parts, at = [], start
            while at < start + size:
                if at >= first + len(held) or k < 0:
                    k += 1
                    held, first = self.segment(k).all(), int(self.segments[k, 2])
                    continue
                part = held[at - first : start + size - first]
                parts.append(part)
                at += len(part)
            yield doc, start, np.concatenate(parts) if len(parts) != 1 else parts[0]


def write_token_files(
    spark: SparkSession, docs: DataFrame, root: str, *, tokenizer: str = "byte_bpe_50k.json", kind: str = "byte"
) -> list[tuple[str, int, int]]:
    """Encode ``docs`` (doc_id, text) into files under ``root``, in ascending doc_id order.

    Returns the manifest, also written as manifest.json: (file, first token, tokens) of each file,
    one for each range of ids.  A null text is empty and has only the end id; null ids come first;
    rows that repeat an id follow each other.  An empty table gives no file.
    """

    ship(spark)

    def write(batches):
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}.dac"
        code, writer = encoder(tokenizer, kind), None
        for batch in batches_by_bytes(batches, "text"):
            writer = writer or TokenFileWriter(f"{root}/{name}")
            ids, offsets = code.encode(batch.column("text"))
            sizes = np.diff(offsets)
            ends = np.insert(ids, offsets[1:], END_ID)
            writer.add(batch.column("doc_id").to_pylist(), ends, sizes + 1)
        if writer is not None:
            tokens = writer.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "n_tokens": [tokens]})

    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    files = sorted((r.file, r.n_tokens) for r in dealt.mapInArrow(trimmed(write), "file string, n_tokens long").collect())
    manifest, first = [], 0
    for file, n in files:
        manifest.append((file, first, n))
        first += n
    fs, path = open_shared(root)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_token_files(spark: SparkSession, root: str, manifest: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)

    def read(batches):
        for batch in batches:
            for file, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist()):
                rows = [
                    (doc, first + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for doc, start, ids in TokenFile(f"{root}/{file}").documents()
                ]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    files = spark.createDataFrame(manifest, "file string, first long, n long").repartition(len(manifest))
    return files.mapInArrow(trimmed(read), schema)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` written and read back; null texts are empty, odd rows as in ``write_token_files``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    root = Workspace(spark, "tokens").path("ids")
    return read_token_files(spark, root, write_token_files(spark, docs, root))
