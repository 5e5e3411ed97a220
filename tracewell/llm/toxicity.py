"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each model sees the text's features and the log-odds of
the categories before it.  A later model is trained on earlier probabilities that are out of fold, so
what it sees in training is as uncertain as what it will see.  Features are the hashed words of the
whole text and their beginnings, weighted by the logarithm of their count.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, ship, trimmed
from .tokens import batches_by_bytes

FEATURES = 1 << 18
#: Lengths of the word beginnings that are features of their own, so inflected forms share weight.
PREFIXES = (4, 5)
#: Bound of the training sample: labelled documents of each value of the last category, in the mean of the draw.
SAMPLE = 3000
FOLDS = 3
THRESHOLD = 0.5
L2 = 1.0
#: A feature of fewer sample rows is not used.
LEAST_ROWS = 3
#: Words whose feature numbers a worker process remembers; beyond it the memory starts anew.
CACHE_WORDS = 100_000
_WORD = re.compile(r"[^\W\d_]+")
#: Characters tokenised at a time; the unfinished word at a block's end goes to the next block.
BLOCK = 1 << 20


class Features:
    """Feature numbers and weights of whole texts.

    ``kept`` gives the number in use of each hashed feature, or -1; None keeps the hashed numbers.
    """

    def __init__(self, kept: np.ndarray | None = None):
        self.kept, self.known = kept, {}

    def _numbers(self, word: str) -> tuple[int, ...]:
        parts = {word + " ", *(word[:k] for k in PREFIXES if len(word) >= k)}
        found = sorted({zlib.crc32(p.encode()) & (FEATURES - 1) for p in parts})
        if self.kept is not None:
            found = [k for k in self.kept[found].tolist() if k >= 0]
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        self.known[word] = tuple(found)
        return self.known[word]

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(feature numbers, weights) of a whole text; none for a null or wordless one."""
        words: Counter = Counter()
        text, carry = (text or "").lower(), ""
        for at in range(0, len(text), BLOCK):
            part = carry + text[at : at + BLOCK]
            own, carry = _WORD.findall(part), ""
            if own and at + BLOCK < len(text) and part.endswith(own[-1]):
                carry = own.pop()
            words.update(own)
        found: dict[int, int] = {}
        get = self.known.get
        for word, n in words.items():
            numbers = get(word)
            for k in self._numbers(word) if numbers is None else numbers:
                found[k] = found.get(k, 0) + n
        at = np.fromiter(found, np.int64, len(found))
        return at, np.log1p(np.fromiter(found.values(), np.float32, len(found)))


class Rows:
    """Sparse rows: feature numbers, weights and row bounds, in 12 bytes a feature; sums are in doubles."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.width = width
        sizes = np.array([len(a) for a, _ in rows], np.int64)
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
        self.at = np.concatenate([a for a, _ in rows], dtype=np.int32, casting="same_kind") if rows else np.empty(0, np.int32)
        self.x = np.concatenate([x for _, x in rows], dtype=np.float32) if rows else np.empty(0, np.float32)
        self.n = len(rows)

    def take(self, keep: np.ndarray) -> Rows:
        out = object.__new__(Rows)
        new = np.cumsum(keep, dtype=np.int32) - np.int32(1)
        use = keep[self.row]
        out.row, out.at, out.x = new[self.row[use]], self.at[use], self.x[use]
        out.n, out.width = int(keep.sum()), self.width
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, np.multiply(self.x, w[self.at], dtype=np.float64), self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.x * r[self.row], self.width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: Rows, before: np.ndarray, y: np.ndarray, l2: float = L2, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic model (features, earlier log-odds, bias) by L-BFGS; both classes weigh the same."""
    m, k = rows.width, before.shape[1]
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * len(y)

    def loss(w):
        z = rows.dot(w[:m]) + before @ w[m:-1] + w[-1]
        value = (weight * np.logaddexp(0, np.where(y > 0, -z, z))).sum() + l2 / 2 * (w[:-1] @ w[:-1])
        r = weight * (_sigmoid(z) - y)
        return value, np.concatenate([rows.back(r) + l2 * w[:m], before.T @ r + l2 * w[m:-1], [r.sum()]])

    w = np.zeros(m + k + 1)
    value, g = loss(w)
    past: list = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, d, rho in reversed(past):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * d
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(g))
        for (s, d, rho), a in zip(past, reversed(alphas)):
            q += (a - rho * (d @ q)) * s
        step = 1.0
        while True:
            new = w - step * q
            new_value, new_g = loss(new)
            if new_value <= value - 1e-4 * step * (g @ q) or step < 1e-6:
                break
            step /= 2
        s, d = new - w, new_g - g
        if s @ d > 1e-10:
            past = [*past[-9:], (s, d, 1 / (s @ d))]
        done = value - new_value < 1e-4 * max(1.0, abs(value))
        w, value, g = new, new_value, new_g
        if done:
            break
    return w


class Chain:
    """Models in the order of their categories, over the features that ``kept`` numbers."""

    def __init__(self, categories: list[str], kept: np.ndarray, weights: list[np.ndarray]):
        self.categories, self.kept = categories, kept
        self.width, self.weights = int(kept.max()) + 1, [w.astype(np.float32) for w in weights]

    def predict(self, rows: Rows) -> np.ndarray:
        """Probabilities, a column for each category."""
        before, out = np.zeros((rows.n, 0)), []
        for w in self.weights:
            z = rows.dot(w[: rows.width]) + before @ w[rows.width : -1] + w[-1]
            before = np.column_stack([before, np.clip(z, -10, 10)])
            out.append(_sigmoid(z))
        return np.column_stack(out)


def train(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, categories: list[str], *, sample: int = SAMPLE
) -> Chain | None:
    """Fit on about ``sample`` labelled documents of each value of the last category (all, if there are fewer).

    Drawn are the ids whose hash is below a share of ``sample`` in that value's ids.  Labels with a null are
    left out; of repeated labels, or texts, of one id the largest counts.  None if no labelled document is found.
    """
    ship(spark)
    last = categories[-1]
    known = labels.select("doc_id", *[F.col(c).cast("double").alias(c) for c in categories]).dropna()
    known = known.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    sizes = known.groupBy(last).agg(F.count(F.lit(1)).alias("n"))
    drawn = (
        known.join(F.broadcast(sizes), last)  # a row for each value of a 0/1 label
        .where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(float(sample) * (1 << 20)) / F.col("n"))
        .drop("n")
    )
    joined = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # about two samples of ids
    joined = joined.groupBy("doc_id", *categories).agg(F.max("text").alias("text"))

    def run(batches):
        features = Features()
        for batch in batches:
            data = []
            for text in batch.column("text").to_pylist():
                at, x = features(text)
                data.append(at.astype("<u4").tobytes() + x.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[batch.column(c) for c in categories], pa.array(data, pa.binary())],
                ["doc_id", *categories, "f"],
            )

    schema = f"doc_id {dict(joined.dtypes)['doc_id']}, " + ", ".join(f"`{c}` double" for c in categories) + ", f binary"
    found = joined.select("doc_id", "text", *categories).mapInArrow(trimmed(run), schema).collect()
    if not found:
        return None
    found.sort(key=lambda r: (r.doc_id, r.f))
    sparse = [(np.frombuffer(r.f, "<u4", len(r.f) // 8), np.frombuffer(r.f, "<f4", -1, len(r.f) // 2)) for r in found]
    seen = np.zeros(FEATURES, np.int64)
    for at, _ in sparse:
        seen[at] += 1  # a row has a feature once
    common = seen >= LEAST_ROWS
    common[0] = True  # at least one feature
    kept = np.where(common, np.cumsum(common, dtype=np.int32) - np.int32(1), np.int32(-1))
    rows = Rows([(kept[at[common[at]]], x[common[at]]) for at, x in sparse], int(common.sum()))
    fold = np.array([zlib.crc32(str(r.doc_id).encode()) % FOLDS for r in found])
    answers = [np.array([float(r[c] > 0) for r in found]) for c in categories]
    del found, sparse  # the models need much memory themselves
    before, weights = np.zeros((rows.n, 0)), []
    for c, y in zip(categories, answers):
        weights.append(fit(rows, before, y))
        if c == last:
            break
        z = np.zeros(rows.n)
        for k in range(FOLDS):
            out = fold == k
            if out.any() and not out.all():
                w = fit(rows.take(~out), before[~out], y[~out])
                z[out] = rows.take(out).dot(w[: rows.width]) + before[out] @ w[rows.width : -1] + w[-1]
        before = np.column_stack([before, np.clip(z, -10, 10)])
    return Chain(categories, kept, weights)


def _predict(chain: Chain | None, features: Features, texts: list, width: int) -> np.ndarray:
    """Probabilities of texts; 0 for null and wordless ones, and where nothing was learnt."""
    p = np.zeros((len(texts), width))
    if chain is not None and texts:
        p = chain.predict(Rows([features(t) for t in texts], chain.width))
        p[[not _WORD.search(t or "") for t in texts]] = 0
    return p


def _blocks(batches):
    for batch in batches:
        for part in batches_by_bytes([batch], "text", 4 << 20):
            yield part


def score(spark: SparkSession, docs: DataFrame, chain: Chain | None, categories: list[str]) -> DataFrame:
    """doc_id and the probability ``p_<category>`` of each category, for every row of ``docs``.

    Null and wordless texts, and all texts where nothing was learnt, get 0.
    """
    ship(spark)
    names = [f"p_{c}" for c in categories]

    def run(batches):
        features = Features(None if chain is None else chain.kept)
        for part in _blocks(batches):
            p = _predict(chain, features, part.column("text").to_pylist(), len(names))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array(p[:, j]) for j in range(len(names))]], ["doc_id", *names]
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, " + ", ".join(f"`{n}` double" for n in names)
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), schema)


#: The label table's categories in chain order: how well a text is made says something of its tone.
CATEGORIES = ["quality", "toxic"]


def toxic_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic (boolean), toxic_score and quality_score of every row of ``docs``.

    Null and wordless texts score 0 and are not toxic; a score equal to the threshold is.  Equal
    texts get equal scores whatever their ids.  Without labels nothing is toxic; an empty table gives
    no rows; other columns are ignored.
    """
    chain = train(spark, docs, labels, CATEGORIES)
    return score(spark, docs, chain, CATEGORIES).select(
        "doc_id",
        (F.col("p_toxic") >= THRESHOLD).alias("toxic"),
        F.col("p_toxic").alias("toxic_score"),
        F.col("p_quality").alias("quality_score"),
    )


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text is toxic, decided row by row where the texts are read.

    Null and wordless texts stay, ids may be null or repeat, all columns stay as they are; an empty
    table gives no rows.
    """
    ship(spark)
    bounded_batches(spark)
    chain = train(spark, docs, labels, CATEGORIES)
    at = CATEGORIES.index("toxic")

    def run(batches):
        features = Features(None if chain is None else chain.kept)
        for part in _blocks(batches):
            p = _predict(chain, features, part.column("text").to_pylist(), len(CATEGORIES))
            yield part.filter(pa.array(p[:, at] < THRESHOLD))

    return docs.mapInArrow(trimmed(run), docs.schema)


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` by a chain fitted on ``labels``; odd rows as in ``toxic_scores``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxic_scores(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
