"""Cross-entropy difference of two word-bigram models over one vocabulary.

The background model counts all documents, the target model those of a target set.  The vocabulary
is every word of either.  A word's probability after another mixes the bigram's share of its history
(``WEIGHT``) with the add-one share of the word; what a history's bigrams leave open is the end of
the text, so each distribution sums to one.  A document's score is the mean, over its tokens, of
target loss less background loss (nats): below 0 it is more like the target.

No word or bigram is cut: the tables of counts grow with the input.  The scorers hold the counts of
the most frequent words and bigrams (``HELD_WORDS``, ``HELD_BIGRAMS``); a token that needs another
count is looked up by a join, which no frequent key can skew.  A scored document is part of the
background, so a bigram that is in no table occurred in that document alone, once: a bounded bit
filter settles most of these where they are read.  Words and bigrams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyFilter, Workspace, bounded_batches, broadcast_if_small, open_shared, ship, trimmed

HELD_WORDS, HELD_BIGRAMS = 500_000, 4_000_000
WEIGHT = 0.75
#: Tokens that a task counts before it passes the counts on; words whose hashes it remembers.
FLUSH_TOKENS, KNOWN_WORDS = 3_000_000, 400_000
#: The filter has this many blocks of as many bits.
FILTER_BLOCKS, FILTER_BITS = 4096, 32768
#: Shares of the keys that are looked up one after the other, so that the shuffle files of one alone take disk.
ROUNDS = 4
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _cut(counted: DataFrame, most: int) -> int:
    """The smallest count of at least 2 that no more than ``most`` rows reach."""
    sizes = counted.groupBy("n").agg(F.count(F.lit(1)).alias("rows"))
    # Distinct counts are few: their sum is the corpus size, so there are at most its root of them.
    reached = (
        sizes.selectExpr("n", "sum(rows) OVER (ORDER BY n DESC) AS reached").where(F.col("reached") <= most)
    )
    return max(2, reached.agg(F.min("n")).first()[0] or (1 << 62))


class Codes(dict):
    """Hashes of words, computed once for each word while it is remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(history hashes, word hashes, tokens of each text)."""
        own = [np.fromiter(map(self.__getitem__, words(t)), np.uint64) for t in texts]
        sizes = np.array([len(x) for x in own], np.int64)
        word = np.concatenate(own or [np.empty(0, np.uint64)]).view(np.int64)
        history = np.append(START, word[:-1])[: len(word)]
        history[(np.cumsum(sizes) - sizes)[sizes > 0]] = START
        return history, word, sizes


#: The history of a text's first word: the hash of the empty string, which is no word.
START = np.array([xxhash.xxh64_intdigest(b"")], np.uint64).view(np.int64)[0]


def pairs(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of bigrams."""
    x = history.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n, t): bigrams (kind 0) and words (1) of all texts and of the target's, summed for some millions of tokens at a time."""

    def run(batches):
        code, size = Codes(), 0
        waiting = {(kind, goal): [] for kind in (0, 1) for goal in (False, True)}

        def flush():
            for (kind, goal), kept in waiting.items():
                keys, n = np.unique(np.concatenate(kept or [np.empty(0, np.int64)]), return_counts=True)
                kept.clear()
                for a in range(0, len(keys), 200_000):
                    part, m = keys[a : a + 200_000], n[a : a + 200_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (np.full(len(part), kind, np.int32), part, m, m * goal)], ["kind", "key", "n", "t"]
                    )

        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts, flags = part.column("text").to_pylist(), part.column("goal").to_pylist()
                for goal in {*flags}:
                    history, word, sizes = code([t for t, f in zip(texts, flags) if f == goal])
                    waiting[0, goal].append(pairs(history, word))
                    waiting[1, goal].append(np.append(word, np.full((sizes > 0).sum(), START)))
                    size += len(word)
                if size >= FLUSH_TOKENS:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    return docs.select("text", "goal").mapInArrow(trimmed(run), "kind int, key long, n long, t long")


class Arrays:
    """Arrays in a file of the shared folder; what is pickled is the path.

    Where the folder is a file system of the machine, its workers map one copy of the file.
    """

    def __init__(self, path: str, **arrays: np.ndarray):
        self.path = path
        fs, at = open_shared(path)
        fs.create_dir(at.rsplit("/", 1)[0])
        table = pa.RecordBatch.from_arrays([pa.array(a) for a in arrays.values()], list(arrays))
        with fs.open_output_stream(at) as out, pa.ipc.new_file(out, table.schema) as file:
            file.write_batch(table)

    def load(self) -> list[np.ndarray]:
        fs, at = open_shared(self.path)
        source = pa.memory_map(at) if fs.type_name == "local" else fs.open_input_file(at)
        file = pa.ipc.open_file(source)
        return [c.to_numpy() for c in file.get_batch(0).columns]


class Held:
    """Counts of frequent keys, and the least count that is held."""

    def __init__(self, counted: DataFrame, most: int, path: str):
        self.cut = _cut(counted, most)
        rows = counted.where(F.col("n") >= self.cut).select("key", "n", "t").toArrow()
        key = rows.column("key").to_numpy()
        order = np.argsort(key)
        n, t = (rows.column(c).to_numpy()[order] for c in "nt")
        self.arrays = Arrays(path, key=key[order], **{c: x.astype(np.min_scalar_type(x.max(initial=0))) for c, x in (("n", n), ("t", t))})

    def load(self) -> Held:
        self.key, self.n, self.t = self.arrays.load()
        return self

    def __call__(self, key: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether a key is held, its counts n and t, or those of a key that occurs here alone)."""
        if not len(self.key):
            return np.zeros(len(key), bool), np.ones(len(key)), goal * 1
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        found = self.key[at] == key
        return found, np.where(found, self.n[at], 1).astype(np.float64), np.where(found, self.t[at], goal).astype(np.float64)


class Filter:
    """A bit for each counted key; the bit of another key may be set as well."""

    def __init__(self, counted: DataFrame, path: str):
        block = F.pmod(F.shiftright("key", 20), F.lit(FILTER_BLOCKS)).alias("block")
        rows = counted.select(block, F.pmod("key", F.lit(FILTER_BITS)).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
        bits = np.zeros((FILTER_BLOCKS, FILTER_BITS // 8), np.uint8)
        for r in rows.toLocalIterator():  # 4 KB a block
            bits[r.block] = np.frombuffer(bytes(r.bits), np.uint8)
        self.arrays = Arrays(path, bits=bits.ravel())

    def load(self) -> Filter:
        self.bits = self.arrays.load()[0].reshape(FILTER_BLOCKS, FILTER_BITS // 8)
        return self

    def __call__(self, key: np.ndarray) -> np.ndarray:
        bit = key & (FILTER_BITS - 1)
        return (self.bits[(key >> 20) & (FILTER_BLOCKS - 1), bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _lookup(found: DataFrame, tokens: DataFrame, name: str) -> DataFrame:
    """``tokens`` with the counts of the words in a column."""
    return tokens.join(found.select(F.col("key").alias(name), F.col("n").alias(f"{name}n"), F.col("t").alias(f"{name}t")), name)


def score(spark: SparkSession, docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and xent_diff of every row of ``docs``.

    ``target`` holds the doc_id of the documents of the target set.  Losses are means over tokens in nats; they are
    null for a text without a word or a null one.  With an empty target set its model is uniform.
    Null and repeated ids are rows of their own; columns other than doc_id and text are not read.
    """
    ship(spark)
    bounded_batches(spark)
    ws = Workspace(spark, "lm", tidy=True)
    marked = mark(ws, docs.select("doc_id", "text"), target)
    counted = ws.table(
        _counts(marked).groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where("kind = 1 OR n >= 2"), "counts"
    )
    bigrams, one = counted.where("kind = 0").drop("kind"), counted.where("kind = 1").drop("kind")
    size, n_all, t_all = one.where(F.col("key") != int(START)).agg(F.count("key"), F.sum("n"), F.sum("t")).first()
    totals = ((n_all or 0) + size, (t_all or 0) + size)
    words_held, pairs_held = Held(one, HELD_WORDS, ws.path("held/words")), Held(bigrams, HELD_BIGRAMS, ws.path("held/bigrams"))
    counted_pairs = Filter(bigrams, ws.path("held/filter"))

    kind = dict(docs.dtypes)["doc_id"]
    schema = (
        f"kind int, row long, doc_id {kind}, n_tokens long, target double, background double, key long, goal int, "
        "a_n float, a_t float, u_n float, u_t float, h long, w long"
    )

    def run(batches):
        code, held_word, held_pair, maybe = Codes(), words_held.load(), pairs_held.load(), counted_pairs.load()
        for batch in batches:
            types = {"doc_id": batch.schema.field("doc_id").type}
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                history, word, sizes = code(part.column("text").to_pylist())
                place = np.repeat(np.arange(len(sizes)), sizes)
                row = part.column("row").to_numpy()
                key = pairs(history, word)
                goal = part.column("goal").to_numpy(zero_copy_only=False)[place].astype(np.int32)
                h_held, *h = held_word(history, goal)
                w_held, *w = held_word(word, goal)
                held, *pair = held_pair(key, goal)
                known = h_held & w_held
                sure = known & (held | ~maybe(key))
                shares, bases, sums = [], [], []
                for ch, cw, c, total in zip(h, w, pair, totals):
                    shares.append(np.where(ch > 0, WEIGHT / np.maximum(ch, 1), 0))
                    bases.append(np.where(ch > 0, 1 - WEIGHT, 1) * (cw + 1) / total)
                    loss = -np.log(shares[-1] * c + bases[-1])
                    sums.append(np.bincount(place[sure], loss[sure], len(sizes)))
                ask, lost = known & ~sure, ~known
                yield _rows(schema, types, 0, row, doc_id=part.column("doc_id"), n_tokens=sizes, background=sums[0], target=sums[1])
                if ask.any():
                    four = dict(zip(("a_n", "a_t", "u_n", "u_t"), (x[ask].astype(np.float32) for x in (*shares, *bases))))
                    yield _rows(schema, types, 1, row[place[ask]], key=key[ask], goal=goal[ask], **four)
                if lost.any():
                    yield _rows(schema, types, 2, row[place[lost]], key=key[lost], goal=goal[lost], h=history[lost], w=word[lost])

    numbered = marked.withColumn("row", F.monotonically_increasing_id())
    out = ws.table(numbered.mapInArrow(trimmed(run), schema), "tokens")
    ws.drop("held")
    tokens = out.where("kind = 2").select("row", "key", "goal", "h", "w")
    for name in "hw":
        tokens = _lookup(one, tokens, name)
    terms = [
        expr
        for c, total in zip("nt", totals)
        for expr in (
            f"float(if(h{c} > 0, {WEIGHT}D / h{c}, 0D)) AS a_{c}",
            f"float(if(h{c} > 0, 1 - {WEIGHT}D, 1D) * (w{c} + 1) / {max(1, total)}) AS u_{c}",
        )
    ]
    ask = out.where("kind = 1").select("row", "key", "goal", "a_n", "a_t", "u_n", "u_t").unionByName(tokens.selectExpr("row", "key", "goal", *terms))
    # A word that is not held occurs less often than its cut, and so do its bigrams.
    rare = bigrams.where(F.col("n") < max(words_held.cut, pairs_held.cut))
    known = ws.table(out.where("kind = 0").select("row", "doc_id", "n_tokens", "target", "background"), "known")
    sums = known
    for k in range(ROUNDS):
        own = F.pmod("key", F.lit(ROUNDS)) == k
        asked = ask.where(own).join(rare.where(own), "key", "left").selectExpr(
            "row", "-ln(a_t * coalesce(t, goal) + u_t) AS target", "-ln(a_n * coalesce(n, 1) + u_n) AS background"
        )
        asked = asked.groupBy("row").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
        sums = sums.unionByName(ws.table(asked, f"asked-{k}"), allowMissingColumns=True)
    ws.drop("tokens", "counts")
    sums = sums.groupBy("row").agg(
        F.first("doc_id", True).alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("target").alias("t"), F.sum("background").alias("b")
    )
    mean = lambda c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens"))
    return sums.select(
        "doc_id", "n_tokens", mean("t").alias("target_loss"), mean("b").alias("background_loss"), (mean("t") - mean("b")).alias("xent_diff")
    )


def _rows(schema: str, types: dict, kind: int, row: np.ndarray, **columns) -> pa.RecordBatch:
    """A batch of ``schema`` with nulls in the columns that are not given."""
    arrow = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "float": pa.float32()}
    columns |= {"kind": np.full(len(row), kind, np.int32), "row": row}
    fields = [(name, types.get(name) or arrow[of]) for name, of in (x.split() for x in schema.split(", "))]
    return pa.RecordBatch.from_arrays(
        [(c if isinstance(c, pa.Array) else pa.array(c, t)) if (c := columns.get(n)) is not None else pa.nulls(len(row), t) for n, t in fields],
        [n for n, _ in fields],
    )


def mark(ws: Workspace, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` with the column goal: whether doc_id is in ``ids``; only rows that a filter of the ids lets through are shuffled."""
    ids = ids.select("doc_id").where("doc_id IS NOT NULL").distinct()
    maybe, none = KeyFilter(ws, ids, F.xxhash64("doc_id"), "goal").split(docs, F.xxhash64("doc_id"))
    found = maybe.join(broadcast_if_small(ids.withColumn("found", F.lit(True)), ids.count()), "doc_id", "left")
    return found.select(*docs.columns, F.col("found").isNotNull().alias("goal")).unionByName(none.withColumn("goal", F.lit(False)))


def op6_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` scored against those labelled of good quality; odd rows as in ``score``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return score(spark, docs, good)
