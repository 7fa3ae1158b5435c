"""Katz backoff against brute force, exact normalisation, cut blocks and hard rows."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm_operators import docs_of, hard
from tidemark.llm import katz

A, END = "<begin>", "<end>"


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w] + [END]


class Slow:
    """Katz backoff by dictionaries."""

    def __init__(self, texts, order):
        self.order, self.count, self.after = order, [Counter() for _ in range(order + 1)], defaultdict(set)
        for t in texts:
            words = [A] * (order - 1) + split(t)
            for k in range(order - 1, len(words)):
                for m in range(1, order + 1):
                    gram = tuple(words[k - m + 1:k + 1])
                    self.count[m][gram] += 1
                    self.after[gram[:-1]].add(gram[-1])
        self.n, self.v = sum(self.count[1].values()), len(self.count[1])
        self.d = [None] + [katz.discounts([sum(c == r for c in self.count[m].values()) for r in range(1, katz.FITTED + 1)]) for m in range(1, order + 1)]

    def kept(self, m, r):
        small, power = self.d[m]
        return r * small[r - 1] if r <= katz.TURING else r * (1 + 1 / r) ** power

    def p(self, gram):
        m, h = len(gram), gram[:-1]
        total = sum(self.count[m][h + (w,)] for w in self.after[h])
        if not total:
            return self.p(gram[1:]) if m > 1 else 1.0
        if gram[-1] in self.after[h]:
            return self.kept(m, self.count[m][gram]) / total
        left = 1 - sum(self.kept(m, self.count[m][h + (w,)]) for w in self.after[h]) / total
        if m == 1:
            return left
        return left / (1 - sum(self.p(h[1:] + (w,)) for w in self.after[h])) * self.p(gram[1:])

    def score(self, text):
        words = [A] * (self.order - 1) + split(text)
        return sum(math.log10(self.p(tuple(words[k - self.order + 1:k + 1]))) for k in range(self.order - 1, len(words)))


TEXTS = ["a b c a b d", "a b c", "A B  c\n e a", "", None, "b b b b b b b b", "a a a b a b a c " * 30, "x y z", "the end", "a b q c", "the cat b c", "zz zz a"] * 2 + ["c d e f g"]


@pytest.mark.parametrize("order,block", [(1, 1 << 20), (2, 1 << 20), (3, 1 << 20), (2, 7), (3, 5), (2, 1)])
def test_scores_equal_brute_force(spark, monkeypatch, order, block):
    monkeypatch.setattr(katz, "BLOCK", block)
    monkeypatch.setattr(katz, "RANGE", 16)  # several ranges of keys
    docs = docs_of(spark, TEXTS).repartition(3)
    out = {r.doc_id: r for r in katz.score_corpus(docs, F.col("doc_id") % 3 != 1, order).rows.collect()}
    slow = Slow([t for k, t in enumerate(TEXTS) if k % 3 != 1], order)
    assert sorted(out) == list(range(len(TEXTS)))
    for k, t in enumerate(TEXTS):
        r, words = out[k], split(t)
        counts = [slow.count[1][(w,)] for w in words]
        assert (r.learns, r.n_tokens, r.n_known, r.train_tokens) == (k % 3 != 1, len(words), sum(c > 0 for c in counts), slow.n)
        assert r.base_score == pytest.approx(sum(math.log10((c + 1) / (slow.n + slow.v + 1)) for c in counts), rel=1e-9)
        assert r.score == pytest.approx(slow.score(t), rel=1e-9)


def test_every_context_sums_to_one(spark):
    """Over all known words and the unknown class, seen and unseen, by the brute-force model that the scores equal; and the stored tables hold its counts."""
    out = katz.score_corpus(docs_of(spark, TEXTS), F.lit(True), 2)
    slow = Slow(TEXTS, 2)
    vocabulary = [g[0] for g in slow.count[1]] + ["<unknown>"]
    for h in [w for w in vocabulary if w != END] + [A]:
        assert sum(slow.p((h, w)) for w in vocabulary) == pytest.approx(1, abs=1e-12)
    rows = katz.flat_counts(out.counts).collect()
    assert {m: sorted(r.times for r in rows if r.m == m) for m in (1, 2)} == {m: sorted(slow.count[m].values()) for m in (1, 2)}
    assert out.unknown == pytest.approx(slow.p(("<unknown>",)))
    weights = [r.weight for r in out.weights.where("m = 2").collect()]
    assert len(weights) == len({g[0] for g in slow.count[2]}) and all(w > 0 for w in weights)


def test_hard_rows(spark):
    df, rows = hard(spark)
    for c in ("uid", "block", "learns", "n_tokens", "context", "weight", "kind", "m", "bucket", "keys", "n", "left", "lower", "total"):
        df = df.withColumn(c, F.lit("clash"))
    got = katz.score_corpus(df, F.col("doc_id") % 2 == 0).rows.collect()
    key = lambda d: (d is None, d)
    assert sorted((key(r.doc_id), r.n_tokens) for r in got) == sorted((key(d), len(split(t))) for d, t, *_ in rows)
    assert all(r.score <= 0 and r.base_score <= 0 for r in got)


def test_nothing_to_learn_and_no_rows(spark):
    docs = docs_of(spark, ["a b", "c"])
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in katz.score_corpus(docs, F.lit(False)).rows.collect()] == [(0, 0, 0.0, 0.0)] * 2
    assert katz.score_corpus(docs.limit(0), F.lit(True)).rows.count() == 0


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    from tidemark.llm import queries
    got = queries.katz_query(spark, "/root/testdata/sf0.001").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[1] < got[0] < 0
