"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles.

An item of n distinct shingles is contained to a share t in a document only if at least ceil(t*n) of its shingles are
there; so of any n - ceil(t*n) + 1 of them one must be. The MinHash sketch of an item is that many of its smallest
shingle hashes: a document that holds none of them can't hold the item, however long it is, and none is missed. Items are
partitioned by size: a size class has the number of shingles that a document needs at least, and the greatest hash of its
sketches, so a document sends only hashes below its classes' bound. Found pairs are verified on the shingles themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_key
from tidemark.session import staged

SHINGLE = 5
CONTAINMENT = 0.8


def word_array(text: Column) -> Column:
    """Lower-cased words: runs of letters, digits and anything outside ASCII."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def shingles(rows: DataFrame, text: str, width: int, make) -> DataFrame:
    """One row per run of ``width`` words: the other columns, ``size`` (runs in the text) and ``make(words)`` as ``sh``.

    The run is taken apart after the explode, so it stays in compiled code; the outer explode keeps the optimizer from
    splitting the text a second time for a filter.
    """
    keys = [c for c in rows.columns if c != text]
    size = F.size("ws") - (width - 1)
    cut = (rows.select(*keys, word_array(F.col(text)).alias("ws"))
           .select(*keys, "ws", F.explode_outer(F.when(size > 0, F.sequence(F.lit(0), size - 1))).alias("at")).where("at is not null"))
    return cut.select(*keys, size.alias("size"), make([F.get("ws", F.col("at") + k) for k in range(width)]).alias("sh"))


def _hash(words: list[Column]) -> Column:
    return F.xxhash64(F.lit(len(words)), *words)


def _join(words: list[Column]) -> Column:
    return F.concat_ws(" ", F.lit(str(len(words))), *words)


def _items(items: DataFrame) -> DataFrame:
    """One row per distinct (item_id, text) that has words: its shingle width (its words if it has fewer than five)."""
    return (items.select("item_id", F.coalesce("text", F.lit("")).alias("item_text")).distinct()
            .withColumn("item", F.xxhash64(F.col("item_id").isNull(), "item_id", "item_text"))
            .withColumn("width", F.least(F.size(word_array(F.col("item_text"))), F.lit(SHINGLE))).where("width > 0"))


def _item_shingles(items: DataFrame, widths: list[int], make) -> DataFrame:
    """Distinct shingles of every item, each item cut at its own width, with their number ``n``."""
    parts = [shingles(items.where(F.col("width") == k).select("item_id", "item", "item_text"), "item_text", k, make) for k in widths]
    rows = reduce(DataFrame.unionByName, parts).select("item_id", "item", "sh").distinct()
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("item")))


def contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """Pairs of a document and an item of which it holds ``containment`` or more: doc_id, th, item_id, n_shingles, n_found, containment.

    Shingles are distinct runs of five lower-cased words, punctuation aside; an item of fewer words is one shingle as a whole. NULL or
    wordless texts and items meet nothing. Rows that repeat doc_id and text are one document, items that repeat id and
    text one item; ids may be NULL. ``th`` is the digest that tells apart texts with the same doc_id. Columns other than doc_id,
    text and item_id, text are not read. Empty tables give no pairs.
    """
    need = F.ceil(F.lit(containment) * F.col("n") - F.lit(1e-9)).cast("int")
    items = _items(items)
    widths = sorted(r[0] for r in items.select("width").distinct().collect()) or [SHINGLE]  # five at most
    by_hash = Window.partitionBy("item").orderBy("sh")
    sketches = staged(_item_shingles(items, widths, _hash).withColumn("need", need).withColumn("rank", F.row_number().over(by_hash))
                      .where("rank <= n - need + 1")
                      .select("item_id", "item", "need", F.floor(F.log2("n")).cast("int").alias("class"), F.col("sh").alias("h")))
    # one row per size class: at most 32
    classes = sketches.groupBy("class").agg(F.min("need").alias("need"), F.max("h").alias("bound")).collect()
    bound = F.lit(None).cast("bigint")
    for m in sorted({c["need"] for c in classes}):  # the most that any class within a document's reach can ask for
        bound = F.when(F.col("size") >= m, F.lit(max(c["bound"] for c in classes if c["need"] <= m))).otherwise(bound)
    docs = docs.select("doc_id", "text", text_key(F.col("text")).alias("th")).where("text is not null")
    probes = reduce(DataFrame.unionByName, [shingles(docs, "text", k, _hash) for k in widths]).where(F.col("sh") <= bound)
    found = staged(probes.join(sketches, probes["sh"] == sketches["h"]).where("size >= need")
                   .select("doc_id", "th", "item_id", "item").distinct())
    # verification on the shingles' words, for the found documents only
    hit = found.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).distinct()
    met = docs.join(hit, docs["doc_id"].eqNullSafe(hit["_d"]) & (docs["th"] == hit["_t"]), "left_semi")
    texts = reduce(DataFrame.unionByName, [shingles(met, "text", k, _join) for k in widths])
    wanted = _item_shingles(items, widths, _join).select("item", "n", "sh")
    counts = (texts.join(wanted, "sh").groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("item").alias("_i"))
              .agg(F.countDistinct("sh").cast("int").alias("n_found"), F.max("n").cast("int").alias("n")).where(F.col("n_found") >= need))
    return found.join(counts, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")) & (F.col("item") == F.col("_i"))).select(
        "doc_id", "th", "item_id", F.col("n").alias("n_shingles"), "n_found", (F.col("n_found") / F.col("n")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The documents that hold no item; all their columns and repeated rows stay, NULL and empty texts too."""
    bad = contaminated(docs, items, containment).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_d"]) & (text_key(docs["text"]) == bad["_t"]), "left_anti")
