"""SimHash near-duplicates: fingerprints, multi-index hashing, connected components.

A fingerprint has 64 bits. Two that differ in at most two bits differ in at most one bit of the upper half, or the lower
half is equal. So each fingerprint asks the table of upper halves with every value of its Hamming ball of radius one (33) and
the table of lower halves with its own; what it fetches is verified by the complete distance. Where many fingerprints share a half, both sides
add one of three pieces of the other half to the key: two differing bits leave one piece equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free, text_key
from tidemark.session import staged

RADIUS = 2
WORDS = 3
SEED = 42
#: fingerprints with an equal half beyond which keys get a piece of the other half
CROWDED = 64
#: shingle hashes whose bits are counted at a time
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of a text's word shingles: a bit is set if over half of the shingle hashes set it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes both touch ASCII only
    if not words:
        return 0
    runs = zip(*(words[k:] for k in range(WORDS))) if len(words) >= WORDS else [words]
    return majority(np.fromiter((xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in runs), dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit number of the bits that over half of the hashes set; zero without any."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[k:k + CHUNK].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(batches):
    for b in batches:
        names = b.schema.names
        i = names.index("text")
        prints = pa.array([fingerprint(t) for t in b.column(i).to_pylist()], type=pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(k) for k in range(len(names)) if k != i] + [prints], names=[n for n in names if n != "text"] + ["fp"])


def fingerprints(docs: DataFrame, *carry: str) -> DataFrame:
    """The columns ``carry`` and the fingerprint ``fp`` (bigint) of each row's whole text."""
    rows = docs.select(*carry, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_fingerprints, (schema + ", " if schema else "") + "fp bigint")


def _halves(fp: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _pieces(half: Column) -> Column:
    """Three pieces of a half, each tagged with its place."""
    return F.array(*[F.lit(tag << 16).bitwiseOR(F.shiftright(half, low).bitwiseAND(F.lit((1 << n) - 1)))
                     for tag, (low, n) in enumerate(((0, 11), (11, 11), (22, 10)), 1)])


def links(prints: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of the distinct fingerprints in column ``fp`` that differ in one or two bits."""
    fps = prints.select("fp").distinct()
    up, low = _halves(F.col("fp"))
    own = fps.select("fp", F.explode(F.array(
        F.struct(F.lit(0).alias("half"), up.alias("key"), low.alias("other")),
        F.struct(F.lit(1).alias("half"), low.alias("key"), up.alias("other")))).alias("t")).select("fp", "t.*")
    full = own.groupBy("half", "key").count().where(F.col("count") > crowded).select("half", "key", F.lit(True).alias("full"))
    ball = F.concat(F.array(F.col("key")), F.when(F.col("half") == 0, F.transform(
        F.sequence(F.lit(0), F.lit(31)), lambda j: F.col("key").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), j)))).otherwise(F.array().cast("array<bigint>")))
    asked = own.select("fp", "half", "other", F.explode(ball).alias("key"))

    def finer(rows: DataFrame) -> DataFrame:
        piece = F.when(F.col("full"), _pieces(F.col("other"))).otherwise(F.array(F.lit(0).cast("bigint")))
        return rows.join(full, ["half", "key"], "left").select("fp", "half", "key", F.explode(piece).alias("piece"))

    table = finer(own).withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    return (finer(asked).withColumnRenamed("fp", "a").join(table, ["half", "key", "piece"])
            .where((F.col("a") < F.col("b")) & near).select("a", "b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``: root is the smallest node that can be reached.

    Alternates the large-star and small-star steps on written tables until no edge changes; the number of rounds is
    logarithmic in practice and what reaches the driver is one count a round.
    """
    edges = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root"))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every node with smaller neighbours joins itself and them to the smallest
        least_of = large.groupBy("a").agg(F.min("b").alias("m"))
        small = staged(large.join(least_of, "a").select(F.explode(F.array(
            F.struct(F.col("a").alias("b"), F.col("m").alias("a")), F.struct(F.col("b").alias("b"), F.col("m").alias("a")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").distinct())
        # done when every edge was there before and every node has one root that is no member itself
        moved = small.join(edges, ["a", "b"], "left_anti").count()
        if moved == 0 and small.count() == edges.count():
            return small.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                small.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        edges = small


def classes(prints: DataFrame) -> DataFrame:
    """A written table with doc_id and ``fp``, with each row's class added: ``component_id`` (the smallest doc_id of the class), ``root`` (a fingerprint
    that names the class) and ``n_links`` (other fingerprints linked to the row's)."""
    edges = staged(links(prints))
    degree = edges.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    roots = components(edges).select(F.col("node").alias("fp"), "root")
    tied = prints.groupBy("fp").agg(F.min("doc_id").alias("low")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = tied.groupBy("root").agg(F.min("low").alias("component_id"))
    named = tied.select("fp", "root").join(names, "root").join(degree, "fp", "left").select(
        "fp", "root", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return prints.join(named, "fp", "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, ``fp``, ``component_id``, ``root`` and ``n_links``.

    Rows are linked if their fingerprints differ in at most two bits; classes are the connected components. NULL and wordless texts have
    fingerprint zero and are linked like any other. NULL doc_ids join a class but can't name it; a class without any id has a NULL
    ``component_id``. Repeated rows each come out. Other columns than doc_id and text are not read. No rows: no result rows.
    """
    return classes(staged(fingerprints(docs, "doc_id")))


def keep_first(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``root`` of ``rooted`` (doc_id, th, root; a row for each of docs): the smallest doc_id (NULL last), then text digest."""
    d, t, n, th = (free(c, docs) for c in ("_d", "_t", "_n", "_th"))
    first = (rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("k"))
             .select(F.col("k.doc_id").alias(d), F.col("k.th").alias(t)))
    copies = rooted.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias(n))
    first = first.join(copies, first[d].eqNullSafe(copies["doc_id"]) & (first[t] == copies["th"])).select(d, t, n)
    keyed = docs.withColumn(th, text_key(F.col("text")))
    kept = keyed.join(first, keyed["doc_id"].eqNullSafe(first[d]) & (keyed[th] == first[t]))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return kept.where(F.col(n) == 1).select(columns).unionByName(kept.where(F.col(n) > 1).dropDuplicates([d, t]).select(columns))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class with all its columns: the one with the smallest doc_id (NULL last), then text digest; of equal rows any one."""
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("th"))
    return keep_first(docs, classes(staged(fingerprints(rows, "doc_id", "th"))))
