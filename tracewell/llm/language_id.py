"""Language identification by nearest centroid.

A text is the normalised TF-IDF vector of its hashed character 1-, 2- and 3-grams.  Each language has
several centroids, found by spherical k-means over a bounded sample of its texts.  A text gets the
language of the centroid with the highest cosine; one that is farther from that centroid than the
farthest of its own sample texts, by a margin, is marked as rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship

#: Buckets of hashed n-grams of each length.
BUCKETS = {1: 1 << 10, 2: 1 << 12, 3: 1 << 13}
#: Bound of the training sample: texts of each language (those with the smallest hash of their id).
SAMPLE = 300
CENTROIDS = 4
#: Characters hashed at a time, so a very long text needs no more memory than this.
BLOCK = 1 << 20
UNKNOWN = "und"
#: A text is rejected below this share of its centroid's lowest sample cosine.
MARGIN = 0.8


#: Which code points below 65536 are letters; those above count as letters.
_LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])


def counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text; a run of symbols other than letters is one space."""
    out = np.zeros(sum(BUCKETS.values()), np.float32)
    text = text.lower()
    carry = np.array([32], np.uint64)
    for at in range(0, len(text), BLOCK):
        code = np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(_LETTER[np.minimum(code, 0xFFFF)] | (code > 0xFFFF), code, 32).astype(np.uint64)
        space = code == 32
        code = code[~(space & np.concatenate([carry[-1:] == 32, space[:-1]]))]
        code, old = np.concatenate([carry, code]), len(carry)
        base = 0
        for n, size in BUCKETS.items():
            first = max(0, old - n + 1) if at else 0
            if len(code) - first >= n:
                own = code[first:]
                h = own[: len(own) - n + 1] * np.uint64(0x9E3779B97F4A7C15)
                for j in range(1, n):
                    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + own[j : len(own) - n + 1 + j]
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(40)
                out[base : base + size] += np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size)
            base += size
        carry = code[-(max(BUCKETS) - 1) :]
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _weigh(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf) * idf
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def _k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from the farthest points."""
    chosen = [0]
    while len(chosen) < min(k, len(x)):
        nearest = (x @ x[chosen].T).max(1)
        far = int(nearest.argmin())
        if nearest[far] > 1 - 1e-6:
            break
        chosen.append(far)
    centers = x[chosen].copy()
    for _ in range(rounds):
        own = (x @ centers.T).argmax(1)
        for j in range(len(centers)):
            if (own == j).any():
                mean = x[own == j].mean(0)
                centers[j] = mean / max(np.linalg.norm(mean), 1e-9)
    return centers


class Model:
    """Centroids, their languages and radii, and the idf weights."""

    def __init__(self, idf, centroids, langs, radii):
        self.idf, self.centroids, self.langs, self.radii = idf, centroids, langs, radii

    def predict(self, tf: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
        """(language, cosine, rejected) of each row of counts."""
        cosine = _weigh(tf, self.idf) @ self.centroids.T
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(tf)), best], 0, 1)
        return [self.langs[b] for b in best], score, score < self.radii[best]


def train(spark: SparkSession, rows: DataFrame, *, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model | None:
    """Fit on at most ``sample`` texts of each language of ``rows`` (doc_id, text, lang).

    Rows without a language or a letter teach nothing; None if no row is left.  The sample is drawn
    by a hash of the id, first by a share that fits the language's row count and then exactly.
    """
    ship(spark)
    known = rows.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    order = F.xxhash64("doc_id")
    drawn = (
        known.join(F.broadcast(sizes), "lang")  # a row for each language
        .where(F.pmod(order, F.lit(1 << 20)) < F.lit(4.0 * sample * (1 << 20)) / F.col("n") + 1)
        .selectExpr("lang", "text", "row_number() OVER (PARTITION BY lang ORDER BY xxhash64(doc_id), doc_id) AS k")
        .where(F.col("k") <= sample)
    )

    def features(batches):
        for batch in batches:
            lang, data = [], []
            for one, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if has_letter(text):
                    tf = counts(text)
                    at = np.flatnonzero(tf)
                    lang.append(one)
                    data.append(np.stack([at, tf[at]]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), "tf": pa.array(data, pa.binary())})

    found: dict[str, list] = {}
    for r in drawn.select("lang", "text").mapInArrow(features, "lang string, tf binary").collect():
        found.setdefault(r.lang, []).append(np.frombuffer(r.tf, "<u4").reshape(2, -1))
    if not found:
        return None
    width, df, n = sum(BUCKETS.values()), np.zeros(sum(BUCKETS.values())), 0
    for texts in found.values():
        for at, _ in texts:
            df[at] += 1
            n += 1
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    centers, langs, radii = [], [], []
    for lang in sorted(found):
        texts = sorted(found[lang], key=lambda t: t.tobytes())
        x = np.zeros((len(texts), width), np.float32)
        for i, (at, tf) in enumerate(texts):
            x[i, at] = tf
        x = _weigh(x, idf)
        own = _k_means(x, centroids)
        near = x @ own.T
        for j in range(len(own)):
            mine = near[near.argmax(1) == j, j]
            radii.append(MARGIN * float(mine.min()) if len(mine) else 0.0)
        centers.append(own)
        langs += [lang] * len(own)
    return Model(idf, np.concatenate(centers), langs, np.array(radii))


def predict(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected and the other columns but text, for every row of ``docs``.

    ``und`` with score 0 for a null text or one without a letter, and where nothing was learnt.
    """
    ship(spark)
    own = ("text", "lang_pred", "score", "rejected")  # columns of these names are not carried over
    others = [c for c in docs.columns if c not in own]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c not in own)
    step = 256

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                texts = part.column("text").to_pylist()
                lang, score, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
                use = [i for i, t in enumerate(texts) if has_letter(t)] if model is not None else []
                if use:
                    got = model.predict(np.stack([counts(texts[i]) for i in use]))
                    for i, one, s, no in zip(use, *got):
                        lang[i], score[i], rejected[i] = one, float(s), bool(no)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in others], pa.array(lang), pa.array(score), pa.array(rejected)],
                    [*others, "lang_pred", "score", "rejected"],
                )

    return docs.select(*others, "text").mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = train(spark, docs.where(~held_out).select("doc_id", "text", "lang"))
    return predict(spark, docs.select("doc_id", held_out.alias("held_out"), "text"), model)
