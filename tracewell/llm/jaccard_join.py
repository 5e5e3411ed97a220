"""Exact similarity join of 4-word shingle sets with several global token orders.

A document's set holds the hashes of its distinct shingles.  Two sets of sizes a and b can reach the
similarity only if, under any one order of all tokens, their prefixes of n - ceil(t n) + 1 tokens
share a token.  Order 1 is an inverted index: documents that share one of its prefix tokens, at
places and with sizes that still allow the overlap, are candidates.  So that a group of copies with
many changes does not become all its pairs, a candidate's parity bits must allow the overlap too: bit
k of a set is the parity of its tokens that are k modulo ``PARITY``, and bits that differ between two
sets stand for at least as many tokens that only one of them has.  A candidate must then share
prefix tokens under orders 2 and 3 too, and what is left is verified on the whole sets.

All orders put the tokens that many documents hold last.  Any total order gives the same result, so
how well those tokens are known matters for speed alone.

Copies are one node.  Only what decides the components is verified: in every group of the index each
document is first compared with the group's hub, the member with the fewest tokens before the shared one (of a group of
copies that is the one with the fewest changes, which most others are similar to); then the pairs that the links found so far leave in
different components are compared, all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyFilter, Workspace, bounded_batches, by_keys, fresh, ship, trimmed
from .components import components
from .lm_scoring import _cut
from .tokens import batches_by_bytes

SHINGLE = 4
#: Similarity as a share of 100: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Tokens that the orders put last: those with the highest counts, no more than this.
FREQUENT = 200_000
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Shingle hashes that a task holds before it passes their counts on.
FLUSH_TOKENS = 2_000_000
#: Parity bits of a set, 64 to a column.
PARITY = 512
_BITS = [f"b{k}" for k in range(PARITY // 64)]
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of whole texts, many at a time; A-Z are lower-cased.

    Words stay in Arrow buffers; only a batch's distinct words become Python strings.
    """

    def __init__(self, shingle: int = SHINGLE):
        self.shingle = shingle

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """One array for each text of an Arrow string array; Arrow's ascii functions know ASCII alone."""
        if not pa.types.is_string(texts.type):  # Arrow's ascii_lower misreads slices of large strings
            texts = texts.take(pa.array(range(len(texts))))
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        bounds = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        known = coded.dictionary.to_pylist()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
        at = coded.indices.to_numpy(zero_copy_only=False)
        real = np.array([w != "" for w in known], bool)[at]  # white space at an end gives empty words
        h = hashes[at[real]]
        sizes = np.diff(np.concatenate([[0], np.cumsum(real)])[bounds - bounds[0]]).tolist()
        k = self.shingle
        whole = self._chain([h[j : len(h) - k + 1 + j] for j in range(k)]) if len(h) >= k else h[:0]
        out, at = [], 0
        for n in sizes:
            if n >= k:
                x = np.sort(whole[at : at + n - k + 1])
                out.append(x[np.append(True, x[1:] != x[:-1])])
            else:  # the whole sequence is one shingle
                out.append(self._chain([h[at + j : at + j + 1] for j in range(n)]) if n else h[:0])
            at += n
        return out

    @staticmethod
    def _chain(parts: list[np.ndarray]) -> np.ndarray:
        """One hash of a sequence of word hashes and its length."""
        x = np.full(len(parts[0]), len(parts), np.uint64)
        for p in parts:
            x = x * np.uint64(0x9E3779B97F4A7C15) + p
        return _mix(x)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


class Orders:
    """Prefixes under the orders: by frequency rank (rare tokens 0), then by a seeded hash.

    ``frequent`` is sorted by token, its columns are token and rank.
    """

    MASK = np.uint64((1 << 22) - 1)

    def __init__(self, frequent: np.ndarray, percent: int = PERCENT):
        self.frequent, self.percent = frequent, percent
        self.maybe = np.zeros(int(self.MASK) + 1, bool)
        self.maybe[(frequent[:, 0] & self.MASK).astype(np.int64)] = True

    def ranks(self, tokens: np.ndarray) -> np.ndarray:
        rank = np.zeros(len(tokens), np.int64)
        look = np.flatnonzero(self.maybe[(tokens & self.MASK).astype(np.int64)])
        if len(look):
            own = tokens[look]
            at = np.minimum(np.searchsorted(self.frequent[:, 0], own), len(self.frequent) - 1)
            rank[look] = np.where(self.frequent[at, 0] == own, self.frequent[at, 1].astype(np.int64), 0)
        return rank

    def prefix(self, tokens: np.ndarray, rank: np.ndarray, seed: int) -> np.ndarray:
        """The first tokens under one order, in that order."""
        n = prefix_length(len(tokens), self.percent)
        key = _mix(tokens ^ np.uint64(seed))
        rare = np.flatnonzero(rank == 0)
        if len(rare) > n:
            own = key[rare]
            return tokens[rare[(near := np.argpartition(own, n)[:n])[np.argsort(own[near])]]]
        return tokens[np.lexsort((key, rank))[:n]]


def parity(tokens: np.ndarray) -> np.ndarray:
    """The parity bits of a set, as 64-bit integers."""
    n = np.bincount((tokens & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY)
    return np.packbits((n & 1).astype(np.uint8)).view(np.int64)


def _texts(batches):
    for part in batches_by_bytes(batches, "text", 4 << 20):
        yield part, part.column("text")


def frequent_tokens(docs: DataFrame, ws: Workspace, shingle: int = SHINGLE) -> np.ndarray:
    """Tokens by document count over all documents, the highest counts, with their ranks from 1 up.

    A task passes on the tokens it has met in two different sets or more, so a token is missed only
    where no task meets it twice.
    """

    def run(batches):
        shingled, seen, waiting, size = Shingler(shingle), set(), [], 0

        def flush():
            tokens, n = np.unique(np.concatenate(waiting), return_counts=True)
            tokens, n = tokens[n > 1], n[n > 1]
            for a in range(0, len(tokens), 200_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens[a : a + 200_000].view(np.int64)), pa.array(n[a : a + 200_000])], ["token", "n"]
                )

        for _, texts in _texts(batches):
            for tokens in shingled(texts):
                key = xxhash.xxh3_128_digest(tokens)
                if key not in seen:
                    seen.add(key)
                    waiting.append(tokens)
                    size += len(tokens)
            if size >= FLUSH_TOKENS:
                yield from flush()
                waiting, size, seen = [], 0, set()
        if size:
            yield from flush()

    counted = ws.table(
        docs.select("text").mapInArrow(trimmed(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 2"),
        "frequent",
    )
    kept = counted.where(F.col("n") >= _cut(counted, FREQUENT)).toArrow()
    token = kept.column("token").to_numpy().astype(np.int64).view(np.uint64)
    rank = np.unique(kept.column("n").to_numpy().astype(np.int64), return_inverse=True)[1] + 1
    by = np.argsort(token)
    ws.drop("frequent")
    return np.stack([token[by], rank[by].astype(np.uint64)], axis=1) if len(token) else np.empty((0, 2), np.uint64)


def _signatures(docs: DataFrame, frequent: np.ndarray, percent: int, shingle: int) -> DataFrame:
    """doc_id, n, sig, the prefix under order 1 (null where the task has had the same set), and parity bits."""

    def run(batches):
        shingled, orders, seen = Shingler(shingle), Orders(frequent, percent), set()
        for part, texts in _texts(batches):
            n, sig, prefix, bits = [], [], [], []
            for tokens in shingled(texts):
                key = xxhash.xxh3_128_digest(tokens)
                n.append(len(tokens))
                sig.append(key)
                bits.append(parity(tokens))
                if key in seen:
                    prefix.append(None)
                else:
                    seen.add(key)
                    prefix.append(orders.prefix(tokens, orders.ranks(tokens), SEEDS[0]).view(np.int64))
            if len(seen) > 200_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int32()), pa.array(sig, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))]
                + [pa.array(c) for c in np.stack(bits, axis=1)],
                ["doc_id", "n", "sig", "prefix", *_BITS],
            )

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, n int, sig binary, prefix array<long>, " + ", ".join(f"{b} long" for b in _BITS))


def _sets(docs: DataFrame, ids: DataFrame, frequent: np.ndarray, ws: Workspace, name: str, percent: int, shingle: int) -> DataFrame:
    """id, tokens and the prefixes under orders 2 and 3 (as 32-bit ints, which can only let more through)."""

    def run(batches):
        shingled, orders = Shingler(shingle), Orders(frequent, percent)
        for part, texts in _texts(batches):
            sets = shingled(texts)
            ranks = [orders.ranks(t) for t in sets]
            second, third = (
                [orders.prefix(t, r, s).astype(np.uint32).view(np.int32) for t, r in zip(sets, ranks)] for s in SEEDS[1:]
            )
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([t.view(np.int64) for t in sets], pa.list_(pa.int64()))]
                + [pa.array(p, pa.list_(pa.int32())) for p in (second, third)],
                ["id", "tokens", "second", "third"],
            )

    maybe, _ = KeyFilter(ws, ids, F.xxhash64("id"), f"{name}-filter").split(docs, F.xxhash64("doc_id"))
    rows = maybe.withColumnRenamed("doc_id", "id").join(ids, "id", "left_semi").dropDuplicates(["id"])
    return ws.table(
        rows.select("id", "text").mapInArrow(trimmed(run), "id long, tokens array<long>, second array<int>, third array<int>"), name
    )


def _possible(na: Column, pa_: Column, nb: Column, pb: Column, percent: int) -> Column:
    """Whether sizes, and places of the first shared token, allow the similarity."""
    left = F.least(na - pa_, nb - pb)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * left >= percent * (na + nb))


def _near(n: Column, n_other: Column, mark: str, percent: int) -> Column:
    """Whether the parity bits of two rows (``mark`` ends the other's columns) allow the similarity."""
    apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}{mark}"))) for b in _BITS), F.lit(0))
    return (100 + percent) * apart <= (100 - percent) * (n + n_other)


def _marked(nodes: DataFrame, id_: str, mark: str) -> DataFrame:
    """id, n and parity bits of the nodes, with names that end in ``mark``."""
    return nodes.select(F.col("id").alias(id_), F.col("n").alias(f"n{mark}"), *[F.col(b).alias(f"{b}{mark}") for b in _BITS])


def _verify(ws: Workspace, docs: DataFrame, pairs: DataFrame, frequent: np.ndarray, name: str, percent: int, shingle: int) -> DataFrame:
    """Pairs (a, b) that reach the similarity."""
    pairs = ws.table(pairs.distinct(), f"{name}-pairs")
    ids = ws.table(pairs.selectExpr("a AS id").unionByName(pairs.selectExpr("b AS id")).distinct(), f"{name}-ids")
    sets = _sets(docs, ids, frequent, ws, f"{name}-sets", percent, shingle)

    def side(columns: list[str], s: str) -> DataFrame:
        return sets.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns])

    met = pairs.join(side(["second", "third"], "a"), "a").join(side(["second", "third"], "b"), "b")
    met = ws.table(
        met.where(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")).select("a", "b"),
        f"{name}-met",
    )
    whole = met.join(side(["tokens"], "a"), "a").join(side(["tokens"], "b"), "b")
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    union = F.size("tokens_a") + F.size("tokens_b") - shared
    linked = ws.table(whole.where(100 * shared >= percent * union).select("a", "b"), f"{name}-linked")
    ws.drop(f"{name}-pairs", f"{name}-ids", f"{name}-sets", f"{name}-met")
    return linked


def similar_components(
    spark: SparkSession, docs: DataFrame, *, percent: int = PERCENT, shingle: int = SHINGLE, workspace: Workspace | None = None
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    doc_id is integral.  Ids are taken as unique; rows that share one are linked.  A null or wordless text has the empty
    set and is linked with nothing; null ids have the component of their copies, else null.  An empty
    table gives no rows; other columns are ignored.
    """
    ship(spark)
    bounded_batches(spark)
    ws = workspace or Workspace(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent = frequent_tokens(docs, ws, shingle)
    rows = ws.table(_signatures(docs, frequent, percent, shingle), "rows")
    full = rows.where("n > 0")
    nodes = ws.table(
        full.groupBy("sig")
        .agg(F.min("doc_id").alias("id"), F.min("n").alias("n"), F.first("prefix", ignorenulls=True).alias("prefix"), *[F.min(b).alias(b) for b in _BITS])
        .where("id IS NOT NULL"),
        "nodes",
    )
    postings = nodes.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    groups = ws.table(
        postings.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("pos", "id", "n")).alias("hub")).where("size > 1"),
        "groups",
    )
    maybe, _ = KeyFilter(ws, groups, F.xxhash64("token"), "groups-filter").split(postings, F.xxhash64("token"))
    index = ws.table(maybe.join(groups, "token"), "index")
    first = (
        index.where(F.col("id") != F.col("hub.id"))
        .where(_possible(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"), percent))
        .select(F.col("hub.id").alias("a"), F.col("id").alias("b"))
        .distinct()
        .join(_marked(nodes, "a", ""), "a")
        .join(_marked(nodes, "b", "_b"), "b")
        .where(_near(F.col("n"), F.col("n_b"), "_b", percent))
        .select("a", "b")
    )
    linked = _verify(ws, docs, first, frequent, "hub", percent, shingle)
    found = components(ws, linked, "cc1")
    labelled = ws.table(
        index.join(found, "id", "left").select("token", "id", "n", "pos", F.coalesce("component", "id").alias("c")), "labelled"
    )
    split = labelled.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("token")
    open_ = ws.table(labelled.join(split, "token", "left_semi").join(nodes.select("id", *_BITS), "id"), "open")
    b = open_.select("token", *[F.col(x).alias(f"{x}_b") for x in ("id", "n", "pos", "c", *_BITS)])
    # The side of the smaller id; members of one component need no further link.
    rest = (
        open_.join(b, "token")
        .where((F.col("id") < F.col("id_b")) & (F.col("c") != F.col("c_b")))
        .where(_possible(F.col("n"), F.col("pos"), F.col("n_b"), F.col("pos_b"), percent))
        .where(_near(F.col("n"), F.col("n_b"), "_b", percent))
        .select(F.col("id").alias("a"), F.col("id_b").alias("b"))
    )
    more = _verify(ws, docs, rest, frequent, "rest", percent, shingle)
    final = components(ws, linked.unionByName(more), "cc2")
    named = nodes.select("sig", "id").join(final, "id", "left").select(
        "sig", F.coalesce("component", "id").alias("component")
    )
    ws.drop("groups", "index", "labelled", "open")
    out = full.select("doc_id", "n", "sig").join(named, "sig", "left").select("doc_id", "n", "component")
    empty = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component"))
    return out.unionByName(empty).select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id")
    )


def near_dedup(spark: SparkSession, docs: DataFrame, *, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group of linked documents: the one with the smallest id.

    Where ids are null or repeat, the rows get numbers of their own (in the order of the ids, nulls
    last) and one row of each group stays all the same; texts without words all stay.  All columns stay as
    they are, an empty table gives no rows.
    """
    ws = Workspace(spark, "near")
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    odd = not ids.groupBy("id").count().where("count > 1 OR id IS NULL").isEmpty()
    key = F.col("doc_id").cast("long")
    if odd:
        (name,) = fresh(docs, 1)
        # Numbers rise with the sorted partitions; the written table fixes them.
        placed = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
        docs = ws.table(placed.withColumn(name, F.monotonically_increasing_id()), "numbered")
        key = F.col(name)
    found = similar_components(spark, docs.select(key.alias("doc_id"), "text"), percent=percent, shingle=shingle, workspace=ws)
    gone = ws.table(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    ws.drop("rows", "nodes")
    kept = by_keys(ws, docs, gone, [key], "gone-filter")[1]
    return kept.drop(name) if odd else kept


def op8_multi_order_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` at 4-word shingles and 85 %: null or wordless texts are alone,
    repeated rows are linked, an empty table gives no rows."""
    return similar_components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + least(4, len(w))], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - least(4, len(w)) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM d JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
