"""Ranked lexical search by an Aho-Corasick scan of the documents.

All terms of a block of items form one automaton. Each term is guarded by a blank on both sides and every byte that is in no term
is read as a blank, so a hit is a whole term and the term frequencies come straight from the text; there is no index of the documents.
A first scan writes each document's length and hits; their totals give the weights; the hits are then mapped to items, each task
keeping an item's best.
"""

from __future__ import annotations

import math
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, text_key
from tidemark.session import staged

#: documents returned for an item
TOP = 50
#: bytes of items whose terms form one automaton; a longer item has one alone
BLOCK = 4 << 20
#: characters of a text that are scanned at once, up to the next character outside terms
WINDOW = 1 << 20
#: scores held at once: documents times items of a block
CELLS = 500_000
#: groups in which an item's candidates are cut to the best before they meet
TREE = 64

#: what separates terms: all of ASCII but digits and letters
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SEPARATOR = re.compile(SEPARATORS[:-1])
_TABLE = bytes(k + 32 if 65 <= k <= 90 else k if k >= 128 or chr(k).isalnum() else 32 for k in range(256))


def terms(text: Column) -> Column:
    """Terms of a text with repeats; NULL has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per item (item_id, words: its distinct terms) with a block number; blocks hold ``BLOCK`` bytes or one item. Rows that repeat count once."""
    rows = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text")).distinct()
    rows = rows.select("item_id", F.array_sort(F.array_distinct(terms(F.col("text")))).alias("words")).where(F.size("words") > 0)
    rows = staged(rows.withColumn("bytes", F.octet_length(F.concat_ws(" ", "words")).cast("bigint")))
    parts = (rows.agg(F.sum("bytes")).first()[0] or 0) // (8 * BLOCK) + 1
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)))
    # a block ends before the item that passes its bound, so none with several items is over twice the bound
    before = F.sum("bytes").over(Window.partitionBy("part").orderBy("item_id", "words").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", before).select("item_id", "words", F.expr(f"(part << 32) + coalesce(before, 0) div {BLOCK}").alias("block"))


def automaton(words: list[str]):
    """Guarded terms over UTF-8 bytes, each with its number."""
    found = ahocorasick.Automaton()
    for k, w in enumerate(words):
        found.add_word(f" {w} ".encode().decode("latin-1"), k)
    found.make_automaton()
    return found


def windows(text: str):
    """A text in parts that begin and end between terms."""
    start = 0
    while start < len(text):
        cut = None if start + WINDOW >= len(text) else _SEPARATOR.search(text, start + WINDOW)
        stop = cut.start() if cut else len(text)
        yield text[start:stop]
        start = stop


def scan(found, text: str | None) -> tuple[int, dict[int, int]]:
    """Number of terms of a text, and the occurrences of the automaton's terms."""
    n, hits = 0, {}
    for part in windows(text or ""):
        data = b" %b " % part.encode("utf-8", "replace").translate(_TABLE)
        inside = np.frombuffer(data, np.uint8) != 32
        n += int(np.count_nonzero(inside[1:] & ~inside[:-1]))
        if len(found):
            for _, k in found.iter(data.decode("latin-1")):
                hits[k] = hits.get(k, 0) + 1
    return n, hits


def term_hits(docs: DataFrame, words: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tie (a digest of the text), n, and the parallel arrays term and tf of each row of ``docs``; ``words`` must be a bounded list."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_key(F.col(f"`{text}`")).alias("tie"), F.col(f"`{text}`").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast({"words": words})  # at most BLOCK bytes, or one item's terms

    def run(batches):
        if "found" not in held.value:  # the broadcast value stays with the Python worker
            held.value["found"] = automaton(held.value["words"])
        found = held.value["found"]
        for b in batches:
            for start in range(0, b.num_rows, 256):
                s = b.slice(start, 256)
                ns, ks, tfs, ends = [], [], [], [0]
                for text in s.column(2):
                    n, hits = scan(found, text.as_py())
                    ns.append(n)
                    ks += hits.keys()
                    tfs += hits.values()
                    ends.append(len(ks))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(ks, pa.int32())),
                                                  pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], names=["doc_id", "tie", "n", "term", "tf"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, tie bigint, n bigint, term array<int>, tf array<bigint>")


def _best(rows: DataFrame, top: int, group: list) -> DataFrame:
    """The ``top`` rows of an item in each group; Spark cuts them before the shuffle as well."""
    order = Window.partitionBy("item", *group).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "tie", "row")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _ranked(hits: DataFrame, members: list[list[int]], weight: list[int], n_docs: int, n_terms: int, top: int) -> DataFrame:
    """item (number in the block), rank, doc_id, score of the ``top`` documents of each item."""
    pairs = np.array([(t, i) for i, ts in enumerate(members) for t in ts], np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    held = hits.sparkSession.sparkContext.broadcast((np.searchsorted(pairs[:, 0], np.arange(len(weight) + 1)), pairs[:, 1], np.array(weight, np.int64)))
    n_items = len(members)
    step = max(1, CELLS // max(n_items, 1))

    def scores(s: pa.RecordBatch) -> np.ndarray:
        """Scores of a run of documents with every item."""
        first, items, w = held.value
        n = s.column(2).to_numpy()
        m = 50 + (50 * n * n_docs) // max(n_terms, 1)
        term, tf = (s.column(k).flatten().to_numpy(zero_copy_only=False) for k in (3, 4))
        doc = np.repeat(np.arange(s.num_rows), s.column(3).value_lengths().to_numpy(zero_copy_only=False))
        gain = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        size = first[term + 1] - first[term]
        at = np.repeat(first[term] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        out = np.zeros(s.num_rows * n_items, np.int64)
        np.add.at(out, np.repeat(doc, size) * n_items + items[at], np.repeat(gain, size))
        return out.reshape(s.num_rows, n_items)

    def run(batches):
        kept = None  # the best so far: item, score, doc_id, tie, row
        for b in batches:
            for start in range(0, b.num_rows, step):
                s = b.slice(start, step)
                value = scores(s)
                doc, item = np.nonzero(value)
                if kept is not None and len(doc):  # below the worst of a full item nothing can enter
                    live = value[doc, item] >= floor[item]
                    doc, item = doc[live], item[live]
                if not len(doc):
                    continue
                new = pa.table({"item": pa.array(item, pa.int32()), "score": value[doc, item], **{c: s.column(c).take(pa.array(doc)) for c in ("doc_id", "tie", "row")}})
                kept = (new if kept is None else pa.concat_tables([kept, new])).combine_chunks()
                kept = kept.sort_by([("item", "ascending"), ("score", "descending"), ("doc_id", "ascending"), ("tie", "ascending"), ("row", "ascending")])
                place = np.asarray(kept["item"])
                start_of = np.searchsorted(place, np.arange(n_items))
                kept = kept.filter(pa.array(np.arange(len(place)) - start_of[place] < top))
                counts = np.bincount(np.asarray(kept["item"]), minlength=n_items)
                floor = np.zeros(n_items, np.int64)
                full = counts == top
                floor[full] = np.asarray(kept["score"])[np.cumsum(counts)[full] - 1]
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    kind = hits.schema["doc_id"].dataType.simpleString()
    found = hits.where(F.size("term") > 0).select("doc_id", "tie", "n", "term", "tf", "row").mapInArrow(run, f"item int, score bigint, doc_id {kind}, tie bigint, row bigint")
    return _best(_best(found, top, [F.pmod("row", F.lit(TREE))]), top, [])


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``top`` documents with a score above 0 for each item.

    Every row of ``docs`` is a document of its own, repeated rows and NULL ids (last among equal scores) too; equal scores and ids are
    told apart by a digest of the text. An item row that repeats counts once; items of one id with different texts are ranked apart.
    NULL and empty texts have no term, and items without terms have no rows. Other columns are not read. Without items, or without
    any term in the documents: no rows. Items are taken in blocks of ``BLOCK`` bytes, and every block scans all documents.
    """
    spark = docs.sparkSession
    blocks = staged(item_blocks(items, item_id, item_text))
    key = blocks.schema["item_id"].dataType.simpleString()
    out = None
    for r in blocks.select("block").distinct().orderBy("block").toLocalIterator():
        rows = sorted(((i.item_id, i.words) for i in blocks.where(F.col("block") == r.block).select("item_id", "words").collect()), key=lambda i: (i[0] is None, i[0], i[1]))
        words = sorted({w for _, ws in rows for w in ws})
        number = {w: k for k, w in enumerate(words)}
        hits = staged(term_hits(docs, words, doc_id, text).withColumn("row", F.monotonically_increasing_id()))
        n_docs, n_terms = hits.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {t: c for t, c in hits.select(F.explode("term").alias("term")).groupBy("term").count().collect()}  # at most the block's terms
        weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(k, 0) + 1))) for k in range(len(words))]
        ranked = _ranked(hits, [[number[w] for w in ws] for _, ws in rows], weight, n_docs, n_terms, top)
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(rows)], f"item int, item_id {key}")
        part = ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"item_id {key}, rank int, doc_id {docs.schema[doc_id].dataType.simpleString()}, score bigint")
