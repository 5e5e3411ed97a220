"""The training-data operators against brute force, exact round trips and held-out accuracy, and on odd input."""

import hashlib
import os
import pickle
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import (
    components, decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, lm_scoring, packing, sharding, token_files,
    tokens, toxicity,
)
from tracewell.llm.common import Workspace

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 911}" for i in range(30_000))
ODD = [
    (1, "a b c d e f g h i", "en", "s", 1), (2, None, "en", "s", None), (3, "", None, "s", 0), (4, "a b c d e f g h i", "en", None, 1),
    (5, "A B C D E F G H I", "fr", "s", 1), (6, "  \n\n ", "fr", "s", 1), (7, LONG, "en", "s", 1), (7, LONG, "en", "s", 1),
    (None, "x y", "en", "s", 1), (8, "é È  ü\tß 漢字　\x00end", "de", "s", 1), (9, "one", "de", "s", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    # Extra columns whose names the operators use inside.
    return spark.createDataFrame(ODD, DOCS).withColumns({"n": F.lit(1), "row_id": F.lit("x"), "token": F.lit(2), "_id": F.lit(3), "digest": F.lit("d"), "h": F.lit(0)})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


# Exact dedup


def test_exact_groups(spark, odd, empty):
    got = exact_dedup.exact_groups(spark, odd, keep="largest").collect()
    want = defaultdict(list)
    for i, t, *_ in ODD:
        want[t or ""].append(i)
    assert len(got) == len(ODD)
    for r in got:
        t = next(t or "" for i, t, *_ in ODD if i == r.doc_id)
        assert r.digest == hashlib.sha256(t.encode()).hexdigest()
        assert r.group_size == len(want[t])
        assert r.keep_id == max((i for i in want[t] if i is not None), default=None)
    assert Counter(r.digest for r in got if r.kept) == Counter({r.digest: 1 for r in got})
    assert exact_dedup.exact_groups(spark, empty).collect() == []


def test_weak_digest_is_verified_by_bytes(spark, odd):
    weak = exact_dedup.exact_groups(spark, odd, keep="largest", digest=F.lit("same")).collect()
    strong = exact_dedup.exact_groups(spark, odd, keep="largest").collect()
    key = lambda rows: Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows)
    assert key(weak) == key(strong)


def test_exact_dedup_keeps_columns(spark, odd):
    out = exact_dedup.exact_dedup(spark, odd, keep="largest")
    assert out.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 3, 4, 5, 6, 7, 8, 9]


# Decontamination


def brute_windows(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: word.findall((t or "").translate(low))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(8, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[a : a + n])].add(i)
    out = {}
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[k]
        out[d] = (len(w), len(hit), len(found), sorted(map(str, found)))
    return out


def test_contamination(spark):
    rnd = random.Random(5)
    pool = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rnd.choices(pool, k=n))) for i, n in enumerate((8, 9, 20, 30, 3, 1, 0, 30))] + [(50, None), (51, "Éa b c d e f g h")]
    rows = [(i, " ".join(rnd.choices(pool, k=60))) for i in range(60)]
    rows += [(100 + i, f"start {t} stop") for i, t in items] + [(200, None), (201, ""), (202, "éa b c d e f g h"), (203, LONG)]
    got = decontaminate.contamination(
        spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    want = brute_windows(rows, items)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r["items"]) for r in got.collect()} == want


def test_contamination_of_odd_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "b c d e f g h i"), (2, "a b c d e f g h")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contamination(spark, odd, items).where("n_items = 2").collect()} == {1, 4, 5}
    assert decontaminate.contamination(spark, empty, items).collect() == []
    assert decontaminate.contamination(spark, odd, items.where("false")).where("n_hit > 0").collect() == []
    left = decontaminate.decontaminate(spark, odd, items)
    assert left.columns == odd.columns and left.count() == len(ODD) - 3


# Similarity join


def brute_components(rows, percent=85, shingle=4):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[a : a + shingle]) for a in range(max(1, len(w) - shingle + 1))} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    for _ in ids:
        for a in ids:
            for b in ids:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in ids}


def test_similar_components(spark):
    rnd = random.Random(2)
    rows = []
    for base in range(6):
        words = [f"b{base}_{k}" for k in range(60)]
        for c in range(9):
            own = list(words)
            for _ in range(c % 4):
                own[rnd.randrange(60)] = f"x{rnd.random()}"
            rows.append((100 * base + c, " ".join(own)))
    common = " ".join(f"c{k}" for k in range(30))
    rows += [(1000 + k, common + " " + " ".join(f"z{k}_{j}" for j in range(k))) for k in range(12)]
    rows += [(2000, None), (2001, ""), (2002, "a b"), (2003, "A  B"), (2004, "a"), (2005, "a\x85b c"), (2006, " \t")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for percent, shingle in ((85, 4), (80, 5)):
        got = jaccard_join.similar_components(spark, d, percent=percent, shingle=shingle).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, percent, shingle)


def test_parity_bits_bound_the_difference():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rnd.integers(0, 2**63, rnd.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.append(rnd.choice(a, rnd.integers(1, len(a) + 1), replace=False), rnd.integers(0, 2**63, rnd.integers(0, 60)).astype(np.uint64)))
        x, y = jaccard_join.parity(a), jaccard_join.parity(b)
        assert len(x) == jaccard_join.PARITY // 64
        assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= len(np.setxor1d(a, b))


def test_shingles_of_slices():
    import pyarrow as pa

    words = [f"Wörd{k} É\x0b\x85x" for k in range(50)]
    texts = [None, "", " a b  ", *(" ".join(words[k : k + 9]) for k in range(40)), "x y z w\n"]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(texts, kind)
        for size in (3, 4, 5):
            shingled = jaccard_join.Shingler(size)
            whole = [x.tolist() for x in shingled(column)]
            assert [x.tolist() for k in range(0, len(texts), 7) for x in shingled(column.slice(k, 7))] == whole
            own = [t.encode().lower().split() if t else [] for t in texts]
            sets = [{tuple(w[a : a + size]) for a in range(max(1, len(w) - size + 1))} if w else set() for w in own]
            assert [len(x) for x in whole] == [len(x) for x in sets]


def test_similar_components_of_odd_tables(spark, odd, empty):
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_components(spark, odd).collect()}
    assert got[1] == got[4] == got[5] == 1 and got[2] == 2 and got[None] is None
    assert jaccard_join.similar_components(spark, empty).collect() == []
    kept = jaccard_join.near_dedup(spark, odd)
    # Rows 4 and 5 equal row 1 but for case; one of the two rows 7 stays, and the row without an id.
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 6, 7, 8, 9]


def test_arrow_batches_are_bounded_by_bytes(spark):
    """However long a partition's texts are, a Python worker of the join gets a few megabytes of them at a time."""
    d = spark.range(0, 40, 1, 1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 100000) AS text")
    assert {r.n_shingles for r in jaccard_join.similar_components(spark, d).collect()} == {1}

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "n"])

    got = d.mapInArrow(run, "rows long, n long").collect()
    assert sum(r.rows for r in got) == 40 and max(r.n for r in got) < 4 << 20


def test_near_copies_without_ids_go(spark):
    long = " ".join(f"k{j}" for j in range(200))
    rows = [(None, long), (None, long + " more"), (None, "alone here"), (3, long + " extra"), (3, "two words"), (3, None)]
    kept = jaccard_join.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), percent=80, shingle=5)
    texts = [r.text for r in kept.collect()]
    assert sum(t is not None and t.startswith("k0 ") for t in texts) == 1 and len(texts) == 4


def test_rejections_are_by_row(spark):
    items = spark.createDataFrame([(1, "b c d e f g h i"), (2, "a b c d e f g h")], "item_id long, text string")
    rows = [(None, "a b c d e f g h i"), (None, "clean text"), (4, "a b c d e f g h i"), (4, "clean as well"), (4, None)]
    left = decontaminate.decontaminate(spark, spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert sorted(r.text or "" for r in left.collect()) == ["", "clean as well", "clean text"]


def test_short_items_are_filtered_first(spark, docs, tmp_path):
    """The written candidates hardly grow by short items, and the result is that of brute force."""
    rows = sorted(texts_of(docs).items())[:60]
    items = [(n, " ".join((rows[n][1] or "").split()[:n])) for n in range(1, 8)] + [(9, rows[9][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.contamination(spark, d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r["items"]) for r in got} == brute_windows(rows, items)


def test_prefixes_of_similar_sets_meet():
    rnd = np.random.default_rng(1)
    frequent = np.array([[5, 1], [9, 2]], np.uint64)
    orders = jaccard_join.Orders(frequent)
    for _ in range(50):
        a = np.unique(rnd.integers(0, 2**63, 60).astype(np.uint64))
        b = np.sort(np.append(a[4:], np.uint64(5)))
        for seed in jaccard_join.SEEDS:
            pa_, pb = (orders.prefix(x, orders.ranks(x), seed) for x in (a, b))
            assert len(pa_) == jaccard_join.prefix_length(len(a)) and len(np.intersect1d(pa_, pb)) > 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (3, 20), (20, 21), (21, 22), (22, 23), (11, 30)]
    got = components.components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == dict.fromkeys((1, 2, 3, 20, 21, 22, 23), 1) | dict.fromkeys((10, 11, 30), 10)


# Tokens


def reference_ids(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path(name))
    return [[*e.ids, 2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_encoder_is_exact(name, kind):
    import pyarrow as pa

    rnd = random.Random(3)
    texts = [t for _, t, *_ in ODD] + ["don't, we'll.", "a\n\n\nb", "x   y", "end  ", "İ ǅ ﬁ", "<|endoftext|> x"]
    texts += ["".join(rnd.choice(" \n\tab,.'é1Z ") for _ in range(40)) for _ in range(400)]
    texts += ["<|endoftext|> x", "a <|startoftext|>b\nc", "x<|endoftext|>", "<|endof text|>", "a <| b |> <|ENDOFTEXT|>"]
    ids, at = tokens.Encoder(tokens.tokenizer_path(name), kind).encode(pa.array(texts))
    assert [[*ids[a:b].tolist(), 2] for a, b in zip(at, at[1:])] == reference_ids(name, texts)


def test_levels_round_trip():
    rnd = np.random.default_rng(0)
    for ids in (np.array([], np.uint32), np.array([0, 255, 256, 65535, 65536, 2**32 - 1], np.uint32), rnd.integers(0, 60000, 5000).astype(np.uint32)):
        s = token_files.Segment(token_files.encode_levels(ids))
        assert s.all().tolist() == ids.tolist()
        assert [s.token(i) for i in range(0, len(ids), 7)] == ids[::7].tolist()


def test_token_files(spark, docs, odd, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", 1000)
    rows = sorted(texts_of(docs).items())
    root = f"file://{tmp_path}/ids"
    manifest = token_files.write_token_files(spark, docs, root)
    want, at = {}, 0
    for (i, _), ids in zip(rows, reference_ids("byte_bpe_50k.json", [t for _, t in rows])):
        want[i] = (at, len(ids), crc(ids))
        at += len(ids)
    got = token_files.read_token_files(spark, root, manifest).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want
    flat = [i for ids in reference_ids("byte_bpe_50k.json", [t for _, t in rows]) for i in ids]
    for file, first, n in manifest:
        f = token_files.TokenFile(f"{root}/{file}")
        assert [f.token(k) for k in range(0, n, 997)] == flat[first : first + n : 997]
    for df, n in ((odd, len(ODD)), (empty, 0)):
        out = f"file://{tmp_path}/x{n}"
        assert token_files.read_token_files(spark, out, token_files.write_token_files(spark, df, out)).count() == n


def check_packing(rows, want):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert crc(want[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
    for i, ids in want.items():
        parts = sorted(by_doc[i], key=lambda r: r.start)
        assert [r.start for r in parts] == np.cumsum([0, *(r.length for r in parts)])[:-1].tolist() and sum(r.length for r in parts) == len(ids)
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        n = sum(r.length for r in parts)
        assert [r.offset for r in parts] == np.cumsum([0, *(r.length for r in parts)])[:-1].tolist()
        assert n <= 4096 and n & (n - 1) == 0
    steps = Counter()
    for parts in by_seq.values():
        steps[parts[0].step_group] += sum(r.length for r in parts)
    assert max(steps.values()) <= packing.STEP_TOKENS


def test_packing(spark, docs, odd, empty):
    rows = sorted(texts_of(docs).items())
    check_packing(packing.pack(docs).collect(), dict(zip([i for i, _ in rows], reference_ids("word_bpe_49k.json", [t for _, t in rows]))))
    unique = odd.where("doc_id IS NOT NULL AND doc_id <> 7")
    kept = texts_of(unique)
    check_packing(packing.pack(unique).collect(), dict(zip(kept, reference_ids("word_bpe_49k.json", kept.values()))))
    assert packing.pack(empty).collect() == []
    with_ids = packing.pack(unique, with_ids=True).collect()
    assert all(crc(r.ids) == r.ids_crc32 for r in with_ids)


def test_packer_keeps_every_token():
    rnd = random.Random(8)
    p, want = packing.Packer(), {}
    for d in range(700):
        n = rnd.choice((1, 7, 300, 511, 512, 513, 1500, 4095, 4096, 4097, 9000))
        want[d] = np.arange(n, dtype=np.uint32) + d
        p.add(d, want[d])
        assert len(p.open) <= packing.OPEN
    p.finish()
    got = defaultdict(dict)
    for size, pieces in p.done:
        assert sum(len(x[2]) for x in pieces) == size and size & (size - 1) == 0
        for d, start, ids in pieces:
            assert start not in got[d]
            got[d][start] = ids
    for d, ids in want.items():
        assert np.concatenate([got[d][k] for k in sorted(got[d])]).tolist() == ids.tolist()


# Languages, toxicity, language models


def test_language_id(spark, docs, odd, empty):
    out = language_id.op1_language_id(spark, SF)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = out.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.9
    assert all(0 <= r.score <= 1 for r in rows)
    model = language_id.train(spark, docs.select("doc_id", "text", "lang"))
    got = {r.doc_id: r.lang_pred for r in language_id.predict(spark, odd.select("doc_id", "text", "n"), model).collect()}
    assert got[2] == got[3] == got[6] == "und" and got[1] != "und"
    assert language_id.train(spark, empty) is None
    assert {r.lang_pred for r in language_id.predict(spark, odd.select("doc_id", "text"), None).collect()} == {"und"}


def test_language_counts_do_not_depend_on_blocks(monkeypatch):
    text = "Ab, 12 cd " * 500
    whole = language_id.counts(text)
    monkeypatch.setattr(language_id, "BLOCK", 97)
    assert (language_id.counts(text) == whole).all()


def test_toxicity(spark, odd, empty):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [f"word{rnd.randrange(300)}" for _ in range(40)] + (["slurry", "slurrish"] if bad else [])
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
        if i < 300:
            labels.append((i, int(i % 3 > 0), int(bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (9999, None, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.toxic_scores(spark, d, lab).collect()}
    assert np.mean([got[i] == (i % 4 == 0) for i in range(300, 400)]) >= 0.97
    assert toxicity.toxic_scores(spark, odd, lab.where("false")).where("toxic").collect() == []
    assert toxicity.toxic_scores(spark, empty, lab).collect() == []
    assert toxicity.drop_toxic(spark, d, lab).count() == 400 - sum(got.values())
    same_id = d.select(F.lit(None).cast("long").alias("doc_id"), "text")
    assert toxicity.drop_toxic(spark, same_id, lab).count() == 400  # no label names a row
    chain = toxicity.train(spark, d, lab, toxicity.CATEGORIES)
    assert chain is not None and toxicity.drop_toxic(spark, odd, lab).columns == odd.columns
    assert toxicity.drop_toxic(spark, empty, lab).collect() == []
    assert {r.doc_id: r.toxic for r in toxicity.toxic_scores(spark, odd, lab).collect()}[2] is False


def test_training_rows_are_small_and_summed_in_doubles():
    """A feature of a training row takes 12 bytes of the driver, and the sums are those of doubles."""
    rnd = np.random.default_rng(5)
    rows = [(np.sort(rnd.choice(50, 20, False)), np.log1p(rnd.integers(1, 9, 20)).astype(np.float32)) for _ in range(30)]
    got, w, r = toxicity.Rows(rows, 50), rnd.normal(size=50), rnd.normal(size=30)
    dense = np.zeros((30, 50))
    for k, (at, x) in enumerate(rows):
        dense[k, at] = x
    keep = np.arange(30) % 3 > 0
    for own, want, v in ((got, dense, r), (got.take(keep), dense[keep], r[keep])):
        assert own.row.nbytes + own.at.nbytes + own.x.nbytes == 12 * 20 * own.n
        assert np.allclose(own.dot(w), want @ w, rtol=1e-12) and np.allclose(own.back(v), want.T @ v, rtol=1e-12)
        assert np.allclose(own.dot(w.astype(np.float32)), want @ w.astype(np.float32).astype(float), rtol=1e-12)


def test_toxicity_features_do_not_depend_on_blocks(monkeypatch):
    text = "Slurry words, 12 and_others " * 200
    whole = dict(zip(*(x.tolist() for x in toxicity.Features()(text))))
    for size in (7, 97, 1000):
        monkeypatch.setattr(toxicity, "BLOCK", size)
        assert dict(zip(*(x.tolist() for x in toxicity.Features()(text)))) == whole


def brute_chain(chain, text):
    """Log-odds of each category from the weights and the words, one by one."""
    count = Counter()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        count.update({zlib.crc32(p.encode()) & (toxicity.FEATURES - 1) for p in {w + " ", *(w[:k] for k in (4, 5) if len(w) >= k)}})
    before, out = [], []
    for weights in chain.weights:
        z = float(weights[-1]) + sum(float(weights[chain.width + j]) * b for j, b in enumerate(before))
        z += sum(float(weights[chain.kept[k]]) * np.log1p(n) for k, n in count.items() if chain.kept[k] >= 0)
        before.append(min(10, max(-10, z)))
        out.append(1 / (1 + np.exp(-z)))
    return out


def test_toxicity_matches_brute_force(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    chain = toxicity.train(spark, docs, labels, toxicity.CATEGORIES)
    got = {r.doc_id: (r.quality_score, r.toxic_score) for r in toxicity.toxic_scores(spark, docs, labels).collect()}
    for i, text in sorted(texts_of(docs).items())[:40]:
        if re.search(r"[^\W\d_]", text or ""):
            assert np.allclose(got[i], brute_chain(chain, text), atol=1e-4)


def test_language_matches_brute_force(spark, docs):
    """The nearest centroid by cosine of plain TF-IDF vectors, computed one text at a time."""
    model = language_id.train(spark, docs.where("crc32(cast(doc_id as string)) % 5 <> 0").select("doc_id", "text", "lang"))
    got = {r.doc_id: r for r in language_id.op1_language_id(spark, SF).collect()}
    for i, text in sorted(texts_of(docs).items())[:40]:
        if not language_id.has_letter(text):
            continue
        x = np.log1p(language_id.counts(text).astype(float)) * model.idf
        cosines = [float(x @ c) / float(np.linalg.norm(x)) for c in model.centroids]
        assert got[i].lang_pred == model.langs[int(np.argmax(cosines))] and abs(got[i].score - max(cosines)) < 1e-3
        assert got[i].rejected == (max(cosines) < model.radii[int(np.argmax(cosines))])


def test_foreign_scripts_are_rejected(spark, docs):
    model = language_id.train(spark, docs.select("doc_id", "text", "lang"))
    odd = spark.createDataFrame([(1, "漢字仮名交じり文を書くことはできるか" * 5), (2, "ξεσκεπάζω την ψυχοφθόρα βδελυγμία" * 5)], "doc_id long, text string")
    assert all(r.rejected for r in language_id.predict(spark, odd, model).collect())


@pytest.mark.parametrize("held, filter_bits", [((500_000, 3_000_000), 32768), ((500_000, 0), 32768), ((500_000, 0), 8), ((1, 0), 8), ((0, 0), 32768), ((2, 3), 8)])
def test_lm_scores_match_plain_python(spark, monkeypatch, held, filter_bits):
    monkeypatch.setattr(lm_scoring, "HELD_WORDS", held[0])
    monkeypatch.setattr(lm_scoring, "HELD_BIGRAMS", held[1])
    if filter_bits == 8:  # a full filter: every bigram is asked for
        monkeypatch.setattr(lm_scoring.Filter, "__call__", lambda self, key: np.ones(len(key), bool))
    rows = [(1, "a b a b c"), (2, "a b b c"), (3, "b a zz a"), (4, None), (5, ""), (6, "c c a b"), (6, "Zz c once"), (None, "c c a b")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    texts = [lm_scoring.words(t) for _, t in rows]
    vocab = {w for t in texts for w in t}

    def losses(chosen, n):
        pairs = Counter(p for t in chosen for p in zip(["", *t], t))
        own, starts = Counter(w for t in chosen for w in t), sum(bool(t) for t in chosen)
        total = 0.0
        for h, w in zip(["", *n], n):
            base, all_h = (own[w] + 1) / (sum(own.values()) + len(vocab)), own[h] if h else starts
            total -= np.log(0.75 * pairs[h, w] / all_h + 0.25 * base if all_h else base)
        return total / len(n)

    for goal in (texts[:2], []):
        got = lm_scoring.score(spark, d, d.where("doc_id <= 2") if goal else d.limit(0)).collect()
        want = [(i, len(x), *((t := losses(goal, x)), (b := losses(texts, x)), t - b)) if x else (i, 0, None, None, None) for (i, _), x in zip(rows, texts)]
        order = lambda r: (str(r[0]), r[1], r[2] or 0)
        assert len(got) == len(want)
        for g, x in zip(sorted(map(tuple, got), key=order), sorted(want, key=order)):
            assert g[:2] == x[:2] and [*g[2:]] == [v if v is None else pytest.approx(v, abs=1e-5) for v in x[2:]]


def test_lm_counts_grow_with_the_texts(spark):
    """Every bigram that occurs twice is in the model, however many there are."""
    some, more = ([(i, f"w{i} x{i} y{i} w{i} x{i}") for i in range(n)] for n in (20, 200))
    for rows in (some, more):
        d = spark.createDataFrame(rows, "doc_id long, text string")
        got = lm_scoring.score(spark, d, d.limit(0)).collect()
        # Twice of two: the second and fifth words' share is whole.
        size, vocab = 5 * len(rows), 3 * len(rows)
        u = [(c + 1) / (size + vocab) for c in (2, 2, 1, 2, 2)]
        share = [1 / len(rows), 1, 0.5, 1, 1]
        want = -np.mean([np.log(0.75 * s + 0.25 * x) for s, x in zip(share, u)])
        assert all(abs(r.background_loss - want) < 1e-5 for r in got)


def test_lm_scorers_share_files_of_counts(spark, tmp_path):
    """What goes to a scorer with its task is a path, however many counts there are."""
    counted = spark.range(20_000).selectExpr("id * 7919 - 1000 AS key", "2 + id % 300 AS n", "id % 2 AS t")
    for held in (lm_scoring.Held(counted, 50_000, f"file://{tmp_path}/held/a"), lm_scoring.Filter(counted, f"file://{tmp_path}/held/b")):
        assert len(pickle.dumps(held)) < 2000
        own = pickle.loads(pickle.dumps(held)).load()
        keys = np.arange(20_000) * 7919 - 1000
        if isinstance(own, lm_scoring.Filter):
            assert own(keys).all() and own(keys + 1).mean() < 0.1
        else:
            found, n, t = own(np.append(keys, 5), np.append(keys, 5) % 1 + 1)
            assert found.tolist() == [True] * 20_000 + [False] and n.tolist() == [2 + i % 300 for i in range(20_000)] + [1]
            assert t.tolist() == [i % 2 for i in range(20_000)] + [1]


def test_shuffle_files_go_with_the_write(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    ids = lambda: {b.toString() for k in range(x.size()) for b in [x.apply(k)]} if (x := blocks.getAllBlocks()) is not None else set()
    before = ids()
    got = Workspace(spark, "tidy", tidy=True).table(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    assert ids() <= before and got.count() == 7


def test_lm_on_odd_tables(spark, odd, empty):
    assert lm_scoring.score(spark, odd, empty).count() == len(ODD)
    assert lm_scoring.score(spark, empty, empty).collect() == []


# Line chunks, shards


def test_line_chunks(spark, odd, empty):
    shared = "\n".join(f"line {k} of a shared passage" for k in range(12))
    long = " ".join(f"t{k}" for k in range(60))
    rows = [(1, f"start\n{shared}\nend"), (2, f"other\nbegin\n{shared}\nfinish"), (3, f"q\n{long}\nr"), (4, f"{long}\ns"), (5, "single"), (6, "single")]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[1].clean_text == rows[0][1]
    assert got[2].n_removed >= 4 and got[2].clean_text.startswith("other\nbegin")
    assert got[3].n_removed == 0 and got[4].clean_text == "s" and got[5].n_removed == got[6].n_removed == 0
    for i, t in rows:
        cut = {k for s in got[i].removed_spans for k in range(s.a, s.b + 1)}
        assert "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut) == got[i].clean_text
    out = {r.doc_id: r for r in line_dedup.line_dedup(spark, odd).collect()}
    assert out[2].clean_text is None and out[3].clean_text == ""
    assert line_dedup.line_dedup(spark, empty).collect() == []


def brute_lines(rows, most=50):
    """Lines with words in a run of more than ``most`` words that occurs at an earlier place and does not overlap it."""
    docs = [(i, t.split("\n")) for i, t in sorted(rows)]
    places, gone = {}, {i: set() for i, _ in docs}
    for i, lines in docs:
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if lines[a].split() and lines[b].split() and len(" ".join(lines[a : b + 1]).split()) > most:
                    run = tuple(lines[a : b + 1])
                    first = places.setdefault(run, (i, b))
                    if first[0] != i or a > first[1]:
                        gone[i] |= set(range(a, b + 1))
    return gone


def test_short_line_passages_go_whole(spark):
    rnd = random.Random(11)
    line = lambda n: " ".join(f"v{rnd.randrange(10**6)}" for _ in range(n))
    passages = [[line(27), line(27)] for _ in range(30)] + [[line(19), line(15), line(20)] for _ in range(30)]
    passages += [[line(40), line(45), line(5)], [line(30), "", line(10), line(30)], [line(20)] * 9, [line(25), line(25)]]
    rows, k = [], 0
    for passage in passages:
        for _ in range(2):
            k += 1
            rows.append((k, "\n".join([line(4) for _ in range(rnd.randrange(3))] + passage + [line(6) for _ in range(rnd.randrange(3))])))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines(rows)
    for r in line_dedup.line_dedup(spark, d).collect():
        cut = {x for s in r.removed_spans for x in range(s.a, s.b + 1)}
        # What the chunks remove besides (under 51 words) is repeated too: only the last passage.
        assert cut >= want[r.doc_id] and (cut == want[r.doc_id] or r.doc_id > k - 4)
        assert r.n_removed == len(cut)


def brute_shard(key, shards):
    draw = lambda s: (int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return max(shards, key=lambda s: (-1 / np.log(draw(s)), -s))


def test_shards(spark, docs, odd, empty):
    rows = sharding.op9_rendezvous_sharding(spark, SF).collect()
    text = texts_of(docs)
    for r in rows:
        assert r.shard == brute_shard(r.doc_id, range(8)) and r.grown_shard == brute_shard(r.doc_id, range(9))
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    out = sharding.assign_shards(spark, odd, {0: 1.0, 1: 3.0}).collect()
    assert len(out) == len(ODD) and {r.size for r in out if r.doc_id in (2, 3)} == {1}
    assert sharding.assign_shards(spark, empty, {0: 1.0}).collect() == []


def test_weights_are_kept(spark):
    got = spark.range(20_000).select(sharding.shard_of(F.col("id"), {0: 1.0, 1: 3.0}).alias("s")).groupBy("s").count().collect()
    assert {r.s: r["count"] for r in got}[1] == pytest.approx(15_000, rel=0.03)


# Pipeline


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    counts = [docs.count()]
    cur = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, cur, SF).write.parquet(f"{tmp_path}/{k}")
        new = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert new.columns == docs.columns
            counts.append(new.count())
        if k == 1:
            assert new.count() == new.select("text").distinct().count()
        if k == 2:
            rows = sorted(texts_of(cur).items())
            want = brute_components(rows, 80, 5)
            assert {r.doc_id for r in new.collect()} == {i for i, (_, c) in want.items() if c == i}
        cur = new
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0]
    left = texts_of(spark.read.parquet(f"{tmp_path}/{len(corpus_pipeline.STAGES) - 2}"))
    assert {r.doc_id for r in cur.select("doc_id").distinct().collect()} == set(left)


def test_pipeline_run(spark, odd, empty, tmp_path):
    """run() on the smallest tables, on odd rows and on an empty table."""
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF).collect()
    assert got and {"doc_id", "start", "length", "sequence_id"} <= set(got[0].asDict())
    for name, df in (("odd", odd.select("doc_id", "text", "lang", "source", "n_chars")), ("empty", empty.select("doc_id", "text", "lang", "source", "n_chars"))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for table in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(f"{tmp_path}/{name}/{table}.parquet")
    # Of the equal texts 1, 4 and, but for case, 5 one stays; null and empty texts are one.
    pieces = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert sorted({r.doc_id or 0 for r in pieces}) == [0, 3, 4, 6, 7, 8, 9]
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []


def test_shared_folder_is_demanded_on_a_cluster():
    from types import SimpleNamespace

    from tracewell.llm.common import shared_dir

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(bare)
