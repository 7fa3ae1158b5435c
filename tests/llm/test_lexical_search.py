"""Ranked lexical search against brute force, blocks of items, ties and hard rows."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm_operators import docs_of, hard
from tidemark.llm import lexical_search


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, items, top):
    """(item_id, rank, doc_id, score) rows; docs and items are (id, text) pairs."""
    counts = [(d, Counter(split(t))) for d, t in docs]
    df = Counter(w for _, c in counts for w in c)
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            n = sum(c.values())
            m = 50 + (50 * n * n_docs) // max(n_terms, 1)
            scored.append((sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(split(text)) if c[w]), d))
        best = sorted((s for s in scored if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:top]
        out += [(item, k, d, s) for k, (s, d) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("block,window,cells,top", [(4 << 20, 1 << 20, 500_000, 50), (40, 7, 60, 3), (1, 1, 1, 5)])
def test_ranks_equal_brute_force(spark, monkeypatch, block, window, cells, top):
    for name, value in (("BLOCK", block), ("WINDOW", window), ("CELLS", cells)):
        monkeypatch.setattr(lexical_search, name, value)
    rng = random.Random(2)
    vocabulary = ["a", "B", "ab", "abc", "é", "日本", "É", "x1", "1", "bc", "c", "Zz", "ab_c"]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", ".", "\n", "--", "\x00", "/", ""]) for _ in range(rng.randrange(25)))
    docs = [text() for _ in range(120)] + ["ab abc"] * 20 + [None, "", "..."]
    items = [(k, text()) for k in range(12)] + [(20, "ab AB ab."), (21, "none of these"), (22, None), (23, ""), (23, "abc")]
    got = lexical_search.search(docs_of(spark, docs).repartition(5), spark.createDataFrame(items, "item_id bigint, text string"), top)
    assert [c for c, _ in got.dtypes] == ["item_id", "rank", "doc_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(slow(list(enumerate(docs)), items, top))


def test_hard_rows(spark):
    df, rows = hard(spark)
    for c in ("item", "rank", "tie", "n", "term", "tf", "row", "item_id", "words", "bytes", "before", "block", "part"):
        df = df.withColumn(c, F.lit("clash"))
    items = [(1, "a b one"), (1, "a b one"), (None, "x" * 5000), (2, "日本 id"), (3, None)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumn("words", F.lit("clash")).withColumn("doc_id", F.lit(0))
    got = lexical_search.search(df, benchmark).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    want = slow([(d, t) for d, t, *_ in rows], dict.fromkeys(items), 50)
    assert sorted(map(key, got)) == sorted(map(key, want)) and {r.item_id for r in got} == {None, 1, 2}


def test_empty_tables(spark):
    docs, items = docs_of(spark, ["a b"]), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(docs_of(spark, [None, ""]), items).count() == 0
