"""Fill-in-the-middle against a text-by-text version, exact round trips and hard rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm_operators import docs_of, hard
from tidemark.llm import fill_middle


def slow(doc_id, text, seed="7", rate=100, suffix_first=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < suffix_first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(5)
    parts = ["\n", "a", "é", "日本", "🙂", "<", "<S", "P>", "S>", ">", "word ", "\r\n", "", "\n\n"]
    return ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(300)] + ["<P>", "x<M>y\nz", "a\nb<S>", "\n", "\n\n\n", "no end", "end\n", None, "l\n" * 3000 + "🙂" * 5000]


@pytest.mark.parametrize("window,slice_", [(1 << 20, 8 << 20), (3, 50), (1, 1)])
@pytest.mark.parametrize("rate", [100, 40])
def test_outputs_and_round_trip(spark, monkeypatch, window, slice_, rate):
    monkeypatch.setattr(fill_middle, "WINDOW", window)
    monkeypatch.setattr(fill_middle, "SLICE", slice_)
    all_texts = texts() if window > 1 else texts()[:308]
    rows = fill_middle.restore(fill_middle.transform(docs_of(spark, all_texts), "7", rate)).collect()
    assert len(rows) == len(all_texts)
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == slow(r.doc_id, r.text, rate=rate)
        assert r.restored == (r.text or "")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_hard_rows(spark):
    df, rows = hard(spark)
    for c in ("n", "form", "output", "restored", "prefix_chars", "_draw0", "_draw1_"):
        df = df.withColumn(c, F.lit("clash"))
    got = fill_middle.restore(fill_middle.transform(df, "7"))
    assert {"_draw0", "_draw1_", "lang", "host"} <= set(got.columns) and len(got.columns) == len(set(got.columns))
    key = lambda x: tuple((v is None, v) for v in x)
    got = got.collect()
    assert sorted(key((r.doc_id, r.text, r.form, r.output)) for r in got) == sorted(key((d, t, slow(d, t)[1], slow(d, t)[4])) for d, t, *_ in rows)
    assert all(r.restored == (r.text or "") and r._draw0 == "clash" for r in got)


def test_outputs_that_are_none(spark):
    rows = spark.createDataFrame([(1, "psm", "<P>a<S>b"), (2, "spm", "<P>a<S>b<M>c"), (3, "psm", "x<P>a<S>b<M>c"), (4, "psm", None), (5, None, "abc"), (6, "odd", "abc"),
                                  (7, "spm", "<S>b<P>a<M>c"), (8, "psm", "<P><S><M>"), (9, "plain", "<P><P>"), (10, "psm", "<P>a<S>b<M>c<M>")], "k int, form string, output string")
    assert {r.k: r.restored for r in fill_middle.restore(rows).collect()} == {1: None, 2: None, 3: None, 4: None, 5: None, 6: None, 7: "acb", 8: "", 9: "<P><P>", 10: None}
    assert fill_middle.restore(rows.limit(0)).count() == 0


def test_empty_table(spark):
    assert fill_middle.transform(docs_of(spark, ["x"]).limit(0), "7").count() == 0
