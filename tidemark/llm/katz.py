"""Language-model scores by Katz backoff over Good-Turing discounted n-gram counts.

An n-gram seen r times after a context seen C times has probability d(r) r / C; the mass that discounting leaves in a context goes to the
words not seen there, in proportion to the next shorter context's probabilities, and the backoff weight makes every context sum to one
exactly. Words unknown to the model are one class, with the mass that unigrams leave.

Token streams are cut into blocks. A block asks for the distinct n-grams it holds once, however often they stand in it, so a word or pair that is a
third of all tokens is one entry of a block and not a key that all its rows meet under. Counts meet in tables partitioned by order
and range of key digest, and each block gets its own n-grams' totals back. The mass of a context is summed from all blocks,
where each n-gram has one block that speaks for it; tokens that back off meet the weights by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import ascii_lower
from tidemark.session import stage_folder

#: words of context and the word itself
ORDER = 2
#: tokens of a block, and n-gram entries of a range of keys
BLOCK, RANGE = 1 << 20, 1 << 21
#: counts up to this one take Turing's estimate where it is between 0 and 1; larger ones the fitted line through the counts of counts below ``FITTED``
TURING, FITTED = 5, 64
#: steepest line that still leaves mass in every context
SLOPE = -1.05
#: digest of the end of a text; contexts before the first token have the digests ``START`` + order
END, START = 0, 0x5EED_0000_0000_0000


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; NULL and empty texts have none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def token_digests(text: Column) -> Column:
    """64-bit digests of a text's words and of its end. Two words of one digest are one word; among a thousand million words one such pair has odds of 1 in 37."""
    return F.concat(F.transform(words(text), lambda w: F.xxhash64(w)), F.array(F.lit(END).cast("bigint")))


def pack(values: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    planes = np.ascontiguousarray(values.reshape(-1, 1).view(np.uint8).reshape(len(values), values.itemsize).T)
    return values.dtype.char.encode() + len(values).to_bytes(8, "little") + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if planes.size else b"")


def unpack(data: bytes) -> np.ndarray:
    kind, n = np.dtype(data[:1].decode()), int.from_bytes(data[1:9], "little")
    if not n:
        return np.zeros(0, kind)
    planes = pa.decompress(data[9:], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel()


def mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Digest of an n-gram from those of its context and its last word."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + right
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def _cut(batches: Iterator[pa.RecordBatch], order: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Blocks of ``BLOCK`` tokens from rows (doc_id, learns, ids). A text that is cut goes on with the last ``order`` - 1 tokens before it as its lead."""
    part = TaskContext.get().partitionId()
    names = ["block", "uid", "doc_id", "learns", "lead", "size", "words", "codes"]
    segments: list[tuple] = []
    held = count = number = 0

    def block():
        uid, doc, learns, lead, size, ids = zip(*segments)
        distinct, code, times = np.unique(np.concatenate(ids).view(np.uint64), return_inverse=True, return_counts=True)
        rank = np.argsort(-times, kind="stable")  # frequent words get small codes
        place = np.empty(len(rank), np.uint32)
        place[rank] = np.arange(len(rank), dtype=np.uint32)
        columns = [pa.array([x], t) for x, t in (((part << 33) + number, pa.int64()), (uid, pa.list_(pa.int64())), (doc, pa.list_(kind)), (learns, pa.list_(pa.bool_())),
                                                 (lead, pa.list_(pa.int32())), (size, pa.list_(pa.int64())), (pack(distinct[rank]), pa.binary()), (pack(place[code]), pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for b in batches:
        docs, learns = b.column(0).to_pylist(), b.column(1).to_pylist()
        ends, flat = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy(zero_copy_only=False)
        for k, doc in enumerate(docs):
            at, stop, lead = ends[k], ends[k + 1], 0
            uid = (part << 33) + count
            count += 1
            while at < stop:
                size = min(stop - at, BLOCK - held)
                segments.append((uid, doc, learns[k], lead, int(size), flat[at - lead:at + size].copy()))
                at, held = at + size, held + size
                lead = min(order - 1, at - ends[k])
                if held >= BLOCK:
                    yield block()
                    segments, held, number = [], 0, number + 1
    if segments:
        yield block()


class Block:
    """Positions of a block: n-gram digests of every order, what is scored, and what the model learns from."""

    def __init__(self, lead: np.ndarray, size: np.ndarray, learns: np.ndarray, distinct: bytes, codes: bytes, order: int):
        total = lead + size
        self.first = np.r_[0, np.cumsum(total)[:-1]].astype(np.int64)
        self.segment = np.repeat(np.arange(len(total)), total)
        inside = np.arange(len(self.segment)) - self.first[self.segment]
        self.scored = inside >= lead[self.segment]
        self.begins = (inside == 0) & (lead[self.segment] == 0)
        self.learns = learns[self.segment] & self.scored
        word = unpack(distinct)[unpack(codes)]
        self.grams, self.context = [word], []
        for m in range(1, order):
            before = np.r_[np.uint64(START + m), self.grams[-1][:-1]]
            before[self.begins] = START + m
            self.context.append(before)
            self.grams.append(mix(before, word))

    def distinct(self, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted digests of the n-grams of order ``m``, the first place of each, and each position's index among them."""
        return np.unique(self.grams[m - 1], return_index=True, return_inverse=True)


def _requests(bits: int, order: int):
    bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                block = Block(*(np.array(r[c]) for c in ("lead", "size", "learns")), r["words"], r["codes"], order)
                for m in range(1, order + 1):
                    keys, _, index = block.distinct(m)
                    times = np.bincount(index[block.learns], minlength=len(keys)).astype(np.uint32)
                    cuts = np.r_[0, np.searchsorted(keys, bounds), len(keys)]
                    out = [(m, k, r["block"], pack(np.diff(keys[a:z], prepend=np.uint64(0))), pack(times[a:z])) for k, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                                                     names=["m", "bucket", "block", "keys", "times"])
    return run


_ANSWERS = "kind string, m int, bucket int, block bigint, keys binary, totals binary, stats array<bigint>"


def _totals(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """Totals of a range of keys, each block's share of them, and the counts of counts. In an answer the last bit marks the block that speaks for the n-gram."""
    m, bucket = (k.as_py() for k in key)
    asked = [np.cumsum(unpack(k.as_py()), dtype=np.uint64) for k in group["keys"]]
    times = np.concatenate([unpack(t.as_py()) for t in group["times"]]).astype(np.int64)
    keys, index = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, index, times)
    speaker = np.full(len(keys), len(times))
    giving = np.flatnonzero(times)
    np.minimum.at(speaker, index[giving], giving)
    answer = total[index] * 2
    answer[speaker[speaker < len(times)]] += 1
    ends = np.r_[0, np.cumsum([len(a) for a in asked])]
    seen = total > 0
    counts = np.bincount(np.minimum(total[seen], FITTED + 1), minlength=FITTED + 2)[1:FITTED + 1]
    rows = [("answer", m, bucket, b, None, pack(answer[a:z]), None) for b, a, z in zip(group["block"].to_pylist(), ends, ends[1:])]
    rows.append(("table", m, bucket, None, pack(np.diff(keys[seen], prepend=np.uint64(0))), pack(total[seen]), None))
    rows.append(("stats", m, bucket, None, None, None, [int(total.sum()), int(seen.sum()), *counts.tolist()]))
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["kind", "m", "bucket", "block", "keys", "totals", "stats"])


def discounts(counts: list[int]) -> tuple[list[float], float]:
    """Ratios d(1) to d(``TURING``) and the exponent of the ratio of larger counts, from the numbers of n-grams seen 1, 2, ... times.

    The line is fitted to the logarithms, each number spread over the gap to its neighbours; a larger count r has d(r) = (1 + 1/r)^exponent, which is below
    one, so every context keeps some mass.
    """
    seen = [r for r in range(1, len(counts) + 1) if counts[r - 1]]
    slope = SLOPE
    if len(seen) > 1:
        gap = [((seen[k + 1] if k + 1 < len(seen) else 2 * r - seen[k - 1]) - (seen[k - 1] if k else 0)) / 2 for k, r in enumerate(seen)]
        x, y = np.log(seen), np.log([counts[r - 1] / g for r, g in zip(seen, gap)])
        slope = min(SLOPE, float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()))
    small = []
    for r in range(1, TURING + 1):
        turing = (r + 1) * counts[r] / (r * counts[r - 1]) if counts[r - 1] else 0.0
        small.append(turing if 0 < turing < 1 else (1 + 1 / r) ** (slope + 1))
    return small, slope + 1


def discounted(times: np.ndarray, small: list[float], power: float) -> np.ndarray:
    """r d(r) of counts; 0 for those not seen."""
    times = times.astype(np.float64)
    out = times * (1 + 1 / np.maximum(times, 1)) ** power
    low = times <= TURING
    out[low] = np.r_[0, np.arange(1, TURING + 1) * small][times[low].astype(np.int64)]
    return out


class Model:
    """What every task needs: total of tokens, distinct tokens, texts, and each order's discounts."""

    def __init__(self, stats: dict[int, list[int]], n_texts: int):
        self.n, self.v = stats[1][:2] if 1 in stats else (0, 0)
        self.n_texts = n_texts
        self.discount = {m: discounts(s[2:]) for m, s in stats.items()}

    def value(self, m: int, times: np.ndarray) -> np.ndarray:
        return discounted(times, *self.discount[m])


_VALUES = "uid bigint, {doc_id}, learns boolean, n_tokens bigint, n_known bigint, base double, score double, m int, context bigint, total bigint, n bigint, left double, lower double, kind string"


def _evaluate(model: Model, order: int, kind: pa.DataType):
    kinds = {"uid": pa.int64(), "doc_id": kind, "learns": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64(),
             "m": pa.int32(), "context": pa.int64(), "total": pa.int64(), "n": pa.int64(), "left": pa.float64(), "lower": pa.float64(), "kind": pa.string()}

    def rows(what: str, size: int, **columns) -> pa.RecordBatch:
        filled = {"kind": [what] * size, **columns}
        return pa.RecordBatch.from_arrays([pa.array(filled[c], t) if c in filled else pa.nulls(size, t) for c, t in kinds.items()], names=list(kinds))

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.to_pylist()[0]
        block = Block(*(np.array(r[c]) for c in ("lead", "size", "learns")), r["words"], r["codes"], order)
        right = right.sort_by([("m", "ascending"), ("bucket", "ascending")])
        times, index, place, speaks, value, before = {}, {}, {}, {}, {}, {0: None}
        for m in range(1, order + 1):
            _, place[m], index[m] = block.distinct(m)
            got = np.concatenate([unpack(t) for t in right.filter(pc.equal(right["m"], m))["totals"].to_pylist()])
            times[m], speaks[m] = got >> 1, np.flatnonzero(got & 1)
            value[m] = model.value(m, times[m]) if m in model.discount else np.zeros(len(got))
            here = times[m][index[m]]
            before[m] = np.r_[model.n_texts, here[:-1]]  # how often the context of so many words was seen
            before[m][block.begins] = model.n_texts
        starts = block.first

        def chance(m: int, at: np.ndarray) -> np.ndarray:
            """Probability of n-grams that were seen, at some positions."""
            return value[m][index[m][at]] / (model.n if m == 1 else before[m - 1][at])

        out, log, todo = [], np.zeros(len(block.segment)), block.scored.copy()
        for m in range(order, 0, -1):
            seen = np.flatnonzero(todo & (times[m][index[m]] > 0))
            log[seen] = np.log10(chance(m, seen))
            todo[seen] = False
            if m > 1:
                back = np.flatnonzero(todo & (before[m - 1] > 0))
                contexts, which = np.unique(block.context[m - 2][back], return_inverse=True)
                pair, n = np.unique(block.segment[back] * max(len(contexts), 1) + which, return_counts=True)
                uid = np.array(r["uid"])[pair // max(len(contexts), 1)]
                out.append(rows("ask", len(pair), uid=uid, m=np.full(len(pair), m), context=contexts[pair % max(len(contexts), 1)].view(np.int64), n=n))
            # the mass of the contexts whose n-grams this block speaks for
            mine, at = speaks[m], place[m][speaks[m]]
            rest = times[m][mine] - value[m][mine]
            if m == 1:
                out.append(rows("mass", 1, m=[1], context=[0], total=[model.n], left=[rest.sum()], lower=[0.0]))
            else:
                contexts, first, which = np.unique(block.context[m - 2][at], return_index=True, return_inverse=True)
                out.append(rows("mass", len(contexts), m=np.full(len(contexts), m), context=contexts.view(np.int64), total=before[m - 1][at[first]],
                                left=np.bincount(which, rest, len(contexts)), lower=np.bincount(which, chance(m - 1, at), len(contexts))))
        count = times[1][index[1]]
        base = np.where(block.scored, np.log10((count + 1) / (model.n + model.v + 1)), 0.0)
        out.append(rows("text", len(starts), uid=r["uid"], doc_id=r["doc_id"], learns=r["learns"], n_tokens=r["size"],
                        n_known=np.add.reduceat((block.scored & (count > 0)).astype(np.int64), starts), base=np.add.reduceat(base, starts), score=np.add.reduceat(log, starts)))
        return pa.Table.from_batches(out)
    return run


def _stored(df: DataFrame, *by: str) -> DataFrame:
    """Write a table in partitions and go on from what was written."""
    path = stage_folder(df.sparkSession) + "/t"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scored:
    """``rows`` with a score for each text, and the model as two stored tables: ``counts`` (by order and range of keys) and ``weights`` (by order)."""

    def __init__(self, rows: DataFrame, counts: DataFrame, weights: DataFrame, unknown: float, model: Model):
        self.rows, self.counts, self.weights, self.unknown, self.model = rows, counts, weights, unknown, model


def flat_counts(counts: DataFrame) -> DataFrame:
    """The stored n-gram counts as rows (m, key, times)."""
    def run(batches):
        for b in batches:
            for m, keys, totals in zip(*(b.column(k).to_pylist() for k in range(3))):
                key = np.cumsum(unpack(keys), dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), m), pa.int32()), pa.array(key), pa.array(unpack(totals))], names=["m", "key", "times"])

    return counts.select("m", "keys", "totals").mapInArrow(run, "m int, key bigint, times bigint")


def score_corpus(docs: DataFrame, learns: Column, order: int = ORDER, text: str = "text", doc_id: str = "doc_id") -> Scored:
    """Learn from the rows where ``learns`` holds (NULL: it doesn't) and score every row's whole text.

    Rows: doc_id, learns, n_tokens (words and one end), n_known (tokens seen in learning), train_tokens, base_score (add-one unigram) and score,
    both sums of log10. Repeated rows and NULL ids come out once each; NULL and empty texts are the end alone. Other columns are not read.
    If nothing is learnt from, every token is unknown with probability one. No rows: none.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(learns, F.lit(False)).alias("learns"), token_digests(F.col(f"`{text}`")).alias("ids"))
    kind = source.schema["doc_id"].dataType
    doc_field = f"doc_id {kind.simpleString()}"
    arrow = to_arrow_type(kind)
    blocks = _stored(source.mapInArrow(lambda batches: _cut(batches, order, arrow), f"block bigint, uid array<bigint>, doc_id array<{kind.simpleString()}>, learns array<boolean>, "
                                       "lead array<int>, size array<bigint>, words binary, codes binary"))
    tokens = blocks.select(F.sum(F.aggregate("size", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, tokens * order / RANGE))))
    asked = blocks.mapInArrow(_requests(bits, order), "m int, bucket int, block bigint, keys binary, times binary")
    met = _stored(asked.groupBy("m", "bucket").applyInArrow(_totals, _ANSWERS), "kind", "m")
    stats: dict[int, list[int]] = {}
    for r in met.where("kind = 'stats'").select("m", F.posexplode("stats").alias("at", "x")).groupBy("m", "at").agg(F.sum("x").alias("x")).orderBy("m", "at").collect():
        stats.setdefault(r["m"], []).append(r["x"])  # a fixed number for each order
    n_texts = source.where("learns").count()
    model = Model({m: s for m, s in stats.items() if s[0]}, n_texts)
    answers = met.where("kind = 'answer'").select("block", "m", "bucket", "totals")
    values = _stored(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_evaluate(model, order, arrow), _VALUES.format(doc_id=doc_field)), "kind")
    mass = values.where("kind = 'mass'").groupBy("m", "context").agg(F.sum("left").alias("left"), F.sum("lower").alias("lower"), F.max("total").alias("total"))
    weights = _stored(mass.select("context", F.when(F.col("total") > 0, F.col("left") / F.col("total") / (1 - F.col("lower"))).alias("weight"), "m"), "m")
    unknown = (weights.where("m = 1").first() or {"weight": None})["weight"] or 1.0
    backed = (values.where("kind = 'ask'").select("uid", "m", "context", "n").join(weights.where("m > 1"), ["m", "context"])
              .select("uid", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("boolean").alias("learns"), F.lit(0).alias("n_tokens"), F.lit(0).alias("n_known"),
                      F.lit(0.0).alias("base"), (F.col("n") * F.log10("weight")).alias("score")))
    texts = values.where("kind = 'text'").select(backed.columns)
    summed = texts.unionByName(backed).groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("learns").alias("learns"), F.sum("n_tokens").alias("n_tokens"),
                                                          F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    rows = summed.select("doc_id", "learns", "n_tokens", "n_known", F.lit(model.n).cast("bigint").alias("train_tokens"), "base_score",
                         (F.col("score") + (F.col("n_tokens") - F.col("n_known")) * math.log10(unknown)).alias("score"))
    return Scored(rows, met.where("kind = 'table'").select("m", "bucket", "keys", "totals"), weights, unknown, model)
