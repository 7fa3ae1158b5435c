"""Quartile bucket digests of documents, and a bounded difference score.

Byte triplets from a sliding window are hashed into 128 buckets. The digest holds for each bucket in which quartile of the
bucket counts it falls (two bits), the logarithm of the length, and two ratios of the quartiles. Two digests differ by the sum of
their bucket steps, with the header's differences on top; the score is bounded and becomes a likeness from 0 to 1.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, text_key
from tidemark.session import staged

BUCKETS = 128
#: distances of the second and third byte of a triplet from the first
SHAPES = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: a bucket step of three counts double, as opposite quartiles are rarely chance
STEP = np.array([0, 1, 2, 6])
#: the difference at and beyond which two digests have likeness 0: about that of unrelated texts
FAR = 160
BLOCK = 1 << 20


def digest(text: str | None) -> str:
    """Hex digest of a whole text: 2 digits of length, 2 of quartile ratios, 64 of buckets. NULL is empty; equal texts have equal digests."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = len(raw)
    data = np.frombuffer(raw + b"\0" * (3 - size if 0 < size < 3 else 0), dtype=np.uint8).astype(np.uint32)  # one or two bytes stand as a triplet with zeros
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for start in range(0, len(data), BLOCK):  # blocks overlap by the window, so no triplet is lost, and the last bytes have the shapes that fit
        d = data[start:start + BLOCK + 4]
        for k, (p, q) in enumerate(SHAPES):
            n = min(len(d) - q, BLOCK)
            if n <= 0:
                continue
            mix = (d[:n] * np.uint32(0x9E3779B1)) ^ (d[p:p + n] * np.uint32(0x85EBCA77)) ^ (d[q:q + n] * np.uint32(0xC2B2AE3D)) ^ np.uint32(0x27D4EB2F * (k + 1) & 0xFFFFFFFF)
            counts += np.bincount((mix ^ (mix >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(25), minlength=BUCKETS)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    level = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = min(int(math.log(size + 1) / math.log(1.1)), 255)
    ratio = (int(q1 * 15 // q3) << 4 | int(q2 * 15 // q3)) if q3 else 0
    packed = (level.reshape(-1, 4) << np.array([6, 4, 2, 0], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    return bytes([length, ratio]).hex() + packed.tobytes().hex()


def _levels(body: bytes) -> np.ndarray:
    b = np.frombuffer(body, dtype=np.uint8)
    return ((b[:, None] >> np.array([6, 4, 2, 0], dtype=np.uint8)) & 3).astype(np.int64)


def difference(a: str, b: str) -> int:
    """Bounded difference of two digests: bucket steps, length beyond one step, and quartile ratios."""
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    steps = int(STEP[np.abs(_levels(x[2:]) - _levels(y[2:]))].sum())
    length = max(abs(x[0] - y[0]) - 1, 0)
    ratios = abs((x[1] >> 4) - (y[1] >> 4)) + abs((x[1] & 15) - (y[1] & 15))
    return min(steps + length + ratios, FAR)


def likeness(a: str, b: str) -> float:
    """1 for equal digests, falling to 0 at a difference of ``FAR``."""
    return 1.0 - difference(a, b) / FAR


def edited(text: str | None, following: str | None) -> str:
    """The text with its last third (code points, rounded down) replaced by as much of the start of the following text."""
    text = text or ""
    third = len(text) // 3
    return text[:len(text) - third] + (following or "")[:third]


_OUT = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_TYPES = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def compare(doc_id, text: str | None, mine: str, following: str | None, theirs: str) -> tuple:
    """The result row of one document and the one that follows it."""
    new = edited(text, following)
    print_new = digest(new)
    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text or ""), sha, mine, print_new, likeness(mine, print_new), likeness(mine, theirs)


def _walk(batches):
    """Compare each row of a sorted partition with the next; the partition's first text and its last row go out as they are."""
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    schema = pa.schema([*_TYPES, ("part", pa.int32()), ("edge", pa.string()), ("edge_text", pa.string())])
    empty = (None,) * len(_OUT)
    last = None
    for b in batches:
        for start in range(0, b.num_rows, 512):  # bounds what is held as Python objects
            s = b.slice(start, 512)
            rows = []
            for doc_id, text in zip(s.column(0).to_pylist(), s.column(1).to_pylist()):
                mine = digest(text)
                if last is None:
                    rows.append((*empty, part, "first", text))
                else:
                    rows.append((*compare(*last, text, mine), part, None, None))
                last = (doc_id, text, mine)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    if last is not None:
        row = (last[0], *empty[1:], part, "last", last[1])
        yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, schema)], schema=schema)


def _close(batches):
    for b in batches:
        rows = [compare(d, t, digest(t), n, digest(n)) for d, t, n in zip(*(b.column(k).to_pylist() for k in range(3)))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _TYPES)], schema=_TYPES)


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Digest of every document and of its edited text, and likeness to that and to the next document.

    The next document is the one before it in doc_id order (descending, NULL last; ties by a digest of the text, equal rows in any
    order); the last one's next is the first. A lone document is its own next. NULL texts are empty. Texts are
    shuffled once, into ranges of doc_id; only the first and last row of each range cross ranges. Other columns are not read.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("th")]
    rows = (docs.select(F.col("doc_id").cast("bigint"), "text", text_key(F.col("text")).alias("th"))
            .repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "text"))
    walked = staged(rows.mapInArrow(_walk, _SCHEMA + ", part int, edge string, edge_text string"))
    done = walked.where("edge is null").select(*_OUT)
    firsts = walked.where("edge = 'first'").select("part", F.col("edge_text").alias("following"))
    lasts = walked.where("edge = 'last'").select("part", "doc_id", "edge_text")
    # one row per range: which range comes after it, the last one's being the first
    ring = (firsts.select("part").withColumn("after", F.coalesce(
        F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(1))))))
    pairs = (lasts.join(ring, "part").join(firsts.select(F.col("part").alias("after"), "following"), "after")
             .select("doc_id", "edge_text", "following"))
    return done.unionByName(pairs.mapInArrow(_close, _SCHEMA))
