"""Hierarchical multi-length packing of token documents into sequences.

Whole windows of the context size are cut off each document; the rest is routed to the smallest tier
(512, 1024, 2048 or 4096 tokens) that holds it.  A tier's open sequence has a gap; documents of
shorter tiers go into the smallest gap that holds them.  When more sequences than ``OPEN`` are open,
the fullest is closed by cutting what it lacks from the least full one.  The last sequence of a
partition is cut at powers of two, so no sequence is padded.  Closed sequences of a tier form step
groups of equal token counts.

Every partition of the input packs its own documents as they stream by: no shuffle, and the memory
of a task is ``OPEN`` sequences and one batch of texts.  A task that is run again gives the same rows.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ship, trimmed
from .tokens import END_ID, batches_by_bytes, encoder

CONTEXT = 4096
TIERS = (512, 1024, 2048, 4096)
OPEN = 64
#: Tokens of a step group: eight full windows, or as many shorter sequences as hold the same.
STEP_TOKENS = 8 * CONTEXT

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, sequence_tokens long, step_group long"
)


class Packer:
    """Streaming packer; ``done`` collects (tokens, pieces), a piece is (document, start, ids)."""

    def __init__(self):
        self.open: dict[int, tuple[int, list]] = {}  # gap and pieces
        self.gaps: list[tuple[int, int]] = []  # (gap, number), sorted
        self.number = 0
        self.done: list[tuple[int, list]] = []

    def add(self, document, ids: np.ndarray) -> None:
        whole = len(ids) // CONTEXT * CONTEXT
        for at in range(0, whole, CONTEXT):
            self.done.append((CONTEXT, [(document, at, ids[at : at + CONTEXT])]))
        if whole < len(ids):
            self._place((document, whole, ids[whole:].copy()))
            while len(self.open) > OPEN:
                self._close_one()

    def _remove(self, number: int) -> tuple[int, list]:
        gap, pieces = self.open.pop(number)
        del self.gaps[bisect.bisect_left(self.gaps, (gap, number))]
        return gap, pieces

    def _insert(self, number: int, gap: int, pieces: list) -> None:
        if gap:
            self.open[number] = gap, pieces
            bisect.insort(self.gaps, (gap, number))
        else:
            self.done.append((sum(len(p[2]) for p in pieces), pieces))

    def _place(self, piece) -> None:
        size = len(piece[2])
        at = bisect.bisect_left(self.gaps, (size, -1))
        if at < len(self.gaps):
            number = self.gaps[at][1]
            gap, pieces = self._remove(number)
            self._insert(number, gap - size, [*pieces, piece])
        else:
            tier = TIERS[bisect.bisect_left(TIERS, size)]
            self.number += 1
            self._insert(self.number, tier - size, [piece])

    def _close_one(self) -> None:
        """Fill the fullest open sequence from the one with the fewest tokens."""
        number = self.gaps[0][1]
        gap, pieces = self._remove(number)
        giver = min(self.open, key=lambda k: (sum(len(p[2]) for p in self.open[k][1]), k))
        _, stock = self._remove(giver)
        rest = []
        for document, start, ids in stock:
            if gap == 0:
                rest.append((document, start, ids))
                continue
            pieces = [*pieces, (document, start, ids[:gap])]
            if len(ids) > gap:
                rest.append((document, start + gap, ids[gap:]))
            gap -= min(gap, len(ids))
        self._insert(number, gap, pieces)
        for piece in rest:
            self._place(piece)

    def finish(self) -> None:
        while len(self.open) > 1:
            self._close_one()
        for _, pieces in self.open.values():
            left = sum(len(p[2]) for p in pieces)
            while left:
                size = 1 << (left.bit_length() - 1)
                taken, need = [], size
                while need:
                    document, start, ids = pieces[0]
                    taken.append((document, start, ids[:need]))
                    pieces = [(document, start + need, ids[need:]), *pieces[1:]] if len(ids) > need else pieces[1:]
                    need -= len(taken[-1][2])
                self.done.append((size, taken))
                left -= size
        self.open, self.gaps = {}, []


class _Steps:
    """Deals closed sequences into step groups of ``STEP_TOKENS`` tokens of one tier."""

    def __init__(self):
        self.waiting: dict[int, list] = {}
        self.step = 0

    def add(self, tokens: int, row) -> list:
        same = self.waiting.setdefault(tokens, [])
        same.append(row)
        return self._take(self.waiting.pop(tokens)) if len(same) * tokens == STEP_TOKENS else []

    def _take(self, rows: list) -> list:
        self.step += 1
        return [(self.step - 1, r) for r in rows]

    def rest(self) -> list:
        """What is left, longest first, in groups of at most ``STEP_TOKENS``."""
        out, group, room = [], [], STEP_TOKENS
        for tokens in sorted(self.waiting, reverse=True):
            for row in self.waiting[tokens]:
                if tokens > room:
                    out += self._take(group)
                    group, room = [], STEP_TOKENS
                group.append(row)
                room -= tokens
        self.waiting = {}
        return out + self._take(group) if group else out


def pack(docs: DataFrame, *, tokenizer: str = "word_bpe_49k.json", kind: str = "word", with_ids: bool = False) -> DataFrame:
    """Pack ``docs`` (doc_id, text); one row per piece, its ids too if asked for.

    A document's ids are its text's and the end id; a null text is empty.  Null and repeated ids are
    carried through (pieces of one row are told apart by sequence_id and offset).  An empty table
    gives no rows; other columns are ignored.
    """
    schema = SCHEMA + (", ids array<long>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64()] * 9 + [pa.list_(pa.int64())] * with_ids

    ship(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        code, packer, steps = encoder(tokenizer, kind), Packer(), _Steps()
        count = 0

        def rows(dealt):
            for step, (sequence, tokens, pieces) in dealt:
                at = 0
                for (doc, doc_tokens), start, length, crc, ids in pieces:
                    yield (doc, start, length, crc, doc_tokens, base + sequence, at, tokens, base + step, *ids)
                    at += length

        def drain():
            nonlocal count
            out = []
            for tokens, pieces in packer.done:
                kept = [
                    (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), [ids.tolist()] if with_ids else [])
                    for doc, start, ids in pieces
                ]
                out += steps.add(tokens, (count, tokens, kept))
                count += 1
            packer.done = []
            return out

        def emit(dealt):
            found = list(rows(dealt))
            for a in range(0, len(found), 5000):
                columns = list(zip(*found[a : a + 5000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches_by_bytes(batches, "text"):
            ids, offsets = code.encode(batch.column("text"))
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                own = np.append(ids[offsets[k] : offsets[k + 1]], np.uint32(END_ID))
                packer.add((doc, len(own)), own)
            yield from emit(drain())
        packer.finish()
        yield from emit(drain())
        yield from emit(steps.rest())

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), schema)


def op3_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed; null texts are empty, odd rows as in ``pack``."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
