import random

import corpus_pipeline
from pyspark.sql import functions as F

from tidemark.llm import near_copies, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars int"


def runs(text):
    ws = (text or "").lower().split()
    return {tuple(ws[k:k + 5]) for k in range(len(ws) - 4)} or {tuple(ws)}


def brute_classes(rows):
    root = {r[0]: r[0] for r in rows}
    sets = {r[0]: runs(r[1]) for r in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {top(x) for x in root}


def test_stage_finds_copies_of_similarity_08(spark):
    rng = random.Random(5)
    texts = []
    for k in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(250)]
        texts.append(" ".join(base))
        for changed in (1, 3, 5, 5, 8):
            copy = list(base)
            for i in rng.sample(range(250), changed):
                copy[i] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += ["", None, " \n", "one two", "One Two", "one three"]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(brute_classes(rows))


def test_stage_on_given_documents_and_hard_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = near_copies.keep_one(docs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(brute_classes(rows))
    same = spark.createDataFrame([(None, "a b", "en", "s", 0)] * 2 + [(None, None, "en", "s", 0), (1, None, "en", "s", 0)], DOCS)
    assert sorted((r["doc_id"] is None, r["text"] is None) for r in near_copies.keep_one(same).collect()) == [(False, True), (True, False)]
    assert near_copies.keep_one(docs.where("false")).count() == 0


def chained(n, seed=9):
    """Copies around one text, many pairs of which are a little less than 0.8 similar, so that links run in chains; and others that are close to all and linked to none."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = []
    for k in range(n):
        copy = list(base)
        for i in rng.sample(range(150), rng.choice((0, 1, 2, 3, 4, 5, 9))):
            copy[i] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    return texts


def test_large_keys_are_compared_completely(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 7)
    monkeypatch.setattr(near_copies, "PARTNERS", 11)
    monkeypatch.setattr(near_copies, "SLICE", 3000)
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(chained(250))]
    got = near_copies.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    want = brute_classes(rows)
    assert 10 < len(want) < 150 and sorted(r["doc_id"] for r in got) == sorted(want)


def test_columns_with_the_names_of_the_code_are_carried(spark):
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(["a b c", "a b c", None, "x " * 3000, "other words here"])]
    df = spark.createDataFrame(rows, DOCS)
    names = ["_th", "th", "_n", "_n_", "_d", "_t", "node", "root", "keys", "size", "key", "seed", "hub", "part", "parts", "other", "main", "n", "x", "a", "b"]
    for c in names:
        df = df.withColumn(c, F.concat(F.lit("own "), F.col("doc_id")))
    got = near_copies.keep_one(df)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == [0, 2, 3, 4]
    assert all(r[c] == f"own {r['doc_id']}" for r in got.collect() for c in names)
    assert simhash.keep_one(df).columns == df.columns


def test_stage_links_by_fingerprints_too(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "band_keys", lambda shingles: [])  # what SimHash finds without MinHash
    base = " ".join(f"w{k}" for k in range(2000))
    texts = [base, base + " one more word", base.replace("w1999", "other"), "a b", "c d", "", None]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    got = near_copies.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(brute_classes(rows)) == [0, 3, 4, 5]
