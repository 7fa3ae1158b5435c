"""What bounds the memory of text operators changes no result."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm_operators import docs_of
from tidemark.llm import bpe, digest, line_dedup, queries, toxicity, url_filter


def test_long_words_have_the_same_kernel_values(monkeypatch):
    rng = random.Random(1)
    k = toxicity.Kernel(["idiot", "trash", "resting"], 2)
    words = ["".join(rng.choice("idotrash") for _ in range(n)) for n in (3, 17, 60, 61, 64, 65, 200)] + ["idiot" * 40, "trash" * 13 + "x"]
    monkeypatch.setattr(toxicity, "FLOOR", 1e-3)
    want = k._some(words)
    assert np.allclose(np.concatenate([k._long(w) for w in words]), want, atol=1e-6)
    monkeypatch.setattr(toxicity, "LETTERS", 20)
    assert np.allclose(np.concatenate([k._long(w) for w in words]), want, atol=1e-6)
    assert np.allclose(k(words), want, atol=1e-6) and k([]).shape == (0, 3)


def labelled(spark, repeats):
    bad = ["zorgnak is here.", "a blufwit and zorgnak", "krimple zorgnak", "zorg.nak krimple"]
    good = ["nothing here at all.", "some words stand here", "more of the same words", "and here is another one"]
    texts = [f"{(bad if k % 2 else good)[k // 2 % 4]} {k % 7}" for k in range(120)]
    docs = docs_of(spark, texts)
    return docs.unionByName(docs.where("doc_id in (1, 2)").crossJoin(spark.range(repeats)).drop("id")) if repeats else docs, spark.createDataFrame(
        [(k, k % 2) for k in range(120)], "doc_id bigint, toxic int")


def test_a_repeated_labelled_id_is_learnt_once(spark):
    once, often = (toxicity.train(*labelled(spark, n)) for n in (0, 500))
    assert once.kernel.landmarks == often.kernel.landmarks and once.weights == pytest.approx(often.weights) and once.logistic == pytest.approx(often.logistic)


def test_scores_do_not_depend_on_chunks(spark, monkeypatch):
    docs, labels = labelled(spark, 0)
    model = toxicity.train(docs, labels)
    texts = [r.text for r in docs.collect()] + [None, "", "word " * 500 + "zorgnak.", "zorgnak" * 30, "x" * 300 + " zorgnak"]
    want = model.scores(texts)
    monkeypatch.setattr(toxicity, "TOKENS", 3)
    monkeypatch.setattr(toxicity, "KEPT", 5)
    monkeypatch.setattr(toxicity, "REMEMBERED", 6)
    monkeypatch.setattr(toxicity, "LETTERS", 25)
    model.memory.clear()
    assert model.scores(texts) == pytest.approx(want, abs=1e-5)


def test_one_pass_equals_encode_then_decode(spark, monkeypatch):
    path, pattern = public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN
    docs = docs_of(spark, [None, "", "some words, more words", "é 日本 🙂" * 50, "x" * 3000] * 3)
    want = sorted(map(repr, bpe.decode(bpe.encode(docs, path, pattern), path, pattern).select("doc_id", "text", "ids", "decoded").collect()))
    monkeypatch.setattr(bpe, "SLICE", 10)
    monkeypatch.setattr(bpe, "KEPT", 500)
    assert sorted(map(repr, bpe.encode_and_decode(docs.withColumn("ids", F.lit(1)), path, pattern).select("doc_id", "text", "ids", "decoded").collect())) == want


def slow_digest_counts(text):
    """Bucket counts by hand: every shape at every place where it fits."""
    data = text.encode()
    data += b"\0" * (3 - len(data) if 0 < len(data) < 3 else 0)
    counts = [0] * digest.BUCKETS
    for k, (p, q) in enumerate(digest.SHAPES):
        for i in range(len(data) - q):
            x = (data[i] * 0x9E3779B1 ^ data[i + p] * 0x85EBCA77 ^ data[i + q] * 0xC2B2AE3D ^ 0x27D4EB2F * (k + 1)) & 0xFFFFFFFF
            counts[((x ^ x >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 25] += 1
    return counts


def test_digest_counts_every_triplet(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(digest, "BLOCK", 16)
    for text in ["", "a", "ab", "abc", "abcd", "abcde", "é", *("".join(rng.choice("abcdé ") for _ in range(n)) for n in (15, 16, 17, 19, 20, 21, 300))]:
        counts = slow_digest_counts(text)
        cuts = [sorted(counts)[k] for k in (31, 63, 95)]
        levels = [sum(c > x for x in cuts) for c in counts]
        assert digest._levels(bytes.fromhex(digest.digest(text))[2:]).ravel().tolist() == levels, text
    for a, b in (("abc", "xyz"), ("abcd", "wxyz"), ("ab", "zz"), ("a", "b"), ("", "a")):
        assert digest.likeness(digest.digest(a), digest.digest(b)) < 1
    assert digest.digest("ab") == digest.digest("ab") and digest.digest(None) == digest.digest("")


def test_columns_with_the_names_of_the_code_are_carried(spark):
    """Names that url filter and line dedup use inside are free for the caller's columns."""
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id int, url string")
    for c in ("won", "_won", "_host", "_path", "node", "key", "kind", "part", "parts", "stack", "open", "top"):
        pages = pages.withColumn(c, F.concat(F.lit(c), F.col("page_id")))
    got = url_filter.judge_urls(pages, spark.createDataFrame([("org", "/", "allow")], "host string, path string, verdict string")).collect()
    assert {r.page_id: (r.host, r.rule, r["_host"], r["won"], r["_won"], r["part"]) for r in got} == {
        1: ("a.org", "org/", "_host1", "won1", "_won1", "part1"), 2: ("", None, "_host2", "won2", "_won2", "part2")}
    rows = [(k, "a line that all sites have here\nown %d line of the text" % k, "en", f"s{k}", 0) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")
    for c in ("_drop", "_th", "_doc_id", "th", "h", "g", "pos", "first", "site", "sites", "sketch", "line", "n"):
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("doc_id")))
    got = line_dedup.dedup_lines(docs).collect()
    assert sorted((r.doc_id, r.n_removed, r["_drop"], r["_th"], r["_doc_id"], r["h"]) for r in got) == [(k, int(k > 0), f"_drop{k}", f"_th{k}", f"_doc_id{k}", f"h{k}") for k in range(6)]


def test_remembered_units_stay_within_their_bytes_and_change_no_ids(monkeypatch):
    import random

    import public_tokenizers

    from tidemark.llm import bpe
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rng = random.Random(3)
    texts = [" ".join(rng.choice(("the", "", "lichpf", "anenß", "qwzrt")) + rng.choice(("", ".", ".\nDer", "&&&", str(rng.randrange(900)))) for _ in range(60)) for _ in range(40)]
    whole = bpe.Codec(bpe.read_ranks(path), public_tokenizers.PATTERN)
    want = [[i for piece in whole.pieces.findall(t) for i in whole._merge(piece.encode())] for t in texts]
    monkeypatch.setattr(bpe, "KEPT", 40 * bpe.UNIT_COST)
    small = bpe.Codec(bpe.read_ranks(path), public_tokenizers.PATTERN)
    asked = []
    search = small._search
    monkeypatch.setattr(small, "_search", lambda data: asked.append(data) or search(data))
    got = []
    for t in texts:
        got.append(small.encode(t))
        assert len(small.known) <= 20 and len(small.older) <= 20
    assert got == want
    # a word met again beside another mark is not searched again
    small.encode(" qwzrtx?")
    asked.clear()
    small.encode(" qwzrtx!!")
    assert not any(b"qwzrtx" in a for a in asked)
