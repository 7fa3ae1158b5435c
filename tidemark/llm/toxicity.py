"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two words counts the letter triples they share as subsequences, gaps weighted down and bounded; inserted letters, punctuation
and look-alike digits leave most triples in place. A sentence's kernel value with a landmark is that of its best word. Landmarks are words whose
presence goes with the label, and the ordinary words nearest to them. Labels stand on documents, so the machine is trained on sentences as
instances: in a toxic document the sentences it finds worst are positive, in a clean one all are negative. A document's score is a
logistic function of its worst sentences, fitted on documents that the machine was not trained on.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, text_key
from tidemark.session import staged

#: training documents of each label, those with the smallest digests of their id: the bound of the sample
MAX_TRAIN = 2500
#: sentences of a training document that the machine sees, those nearest to a landmark
MAX_SENTENCES = 16
#: landmarks that go with the label, and ordinary words near them
POSITIVE, NEGATIVE = 48, 16
#: documents a landmark must stand in, and the log-likelihood ratio it must reach
SUPPORT, MIN_G2 = 3, 12.0
#: a triple spans at most this many letters; each skipped letter counts by the decay
SPAN, DECAY = 5, 0.6
#: kernel values below this count as none
FLOOR = 0.35
#: words that stand out for the label, and most frequent words, among which landmarks are looked for
TELLING, COMMON = 2000, 4000
#: words remembered by a Python worker, each of so many letters at most; a full memory is emptied, which changes no result
KEPT, REMEMBERED = 150_000, 40
#: letters of words whose kernel values are computed at once; a longer word goes through in parts of so many
LETTERS = 40_000
#: bytes of text that are held as Python objects at once (or one text), and tokens whose sentences are scored at once
SLICE, TOKENS = 256 << 10, 20_000

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_INNER = re.compile(r"[\W_]+")
_LOOKALIKE = str.maketrans("01345780@$!", "oieastboasi")
_LATIN = {chr(97 + k): k + 1 for k in range(26)}
_GAPS = [(p, q) for q in range(2, SPAN) for p in range(1, q)]


def word(token: str) -> str:
    """A token's letters: outer punctuation off, look-alikes inside turned into letters, other marks removed."""
    token = token.strip("%*$#&!?.,;:|\"'()[]{}<>-_=+/\\~`^@")
    return token if token.isalpha() else _INNER.sub("", token.translate(_LOOKALIKE))


def sentences(text: str | None):
    """Token lists of a text's sentences; three or more single letters in a row are also read as one token."""
    for s in _SENTENCE.split((text or "").lower()):
        tokens = s.split()
        if not tokens:
            continue
        run = ""
        for t in [*tokens, "  "] if [*map(len, tokens)].count(1) > 1 else ():
            if len(t) < 4 and len(w := word(t)) == 1:
                run += w
            else:
                if len(run) > 2:
                    tokens.append(run)
                run = ""
        yield tokens


def _triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All weighted triples of the words: index of the word, triple code, weight."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    points = np.frombuffer(("\0" * SPAN).join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    latin = (points >= 97) & (points < 123)
    c = np.r_[np.where(latin, points - 96, np.where(points > 0, 27 + points % 37, 0)), np.zeros(2 * SPAN, dtype=np.int64)]
    owner = np.repeat(np.arange(len(words)), sizes + SPAN)
    n = len(owner)
    out = []
    for p, q in _GAPS:
        at = np.flatnonzero((c[:n] > 0) & (c[p:n + p] > 0) & (c[q:n + q] > 0))
        out.append((owner[at], (c[at] << 12) | (c[at + p] << 6) | c[at + q], np.full(len(at), DECAY ** (q - 2))))
    return tuple(np.concatenate(x) for x in zip(*out))


def _norms(own, code, weight, n: int) -> np.ndarray:
    key, back = np.unique((own << 18) | code, return_inverse=True)
    sums = np.bincount(back, weight, minlength=len(key))
    return np.sqrt(np.bincount(key >> 18, sums * sums, minlength=n))


@dataclass
class Kernel:
    """Normalised kernel values of words with the landmarks, of which the first ``telling`` go with the label."""

    landmarks: list[str]
    telling: int
    start: np.ndarray = field(init=False)
    mark: np.ndarray = field(init=False)
    part: np.ndarray = field(init=False)

    def __post_init__(self):
        own, code, weight = _triples(self.landmarks)
        norm = np.maximum(_norms(own, code, weight, len(self.landmarks)), 1e-9)
        order = np.argsort(code, kind="stable")
        self.start = np.searchsorted(code[order], np.arange((1 << 18) + 1))  # where a triple's landmarks are listed
        self.mark, self.part = own[order], (weight / norm[own])[order]

    def _some(self, words: list[str]) -> np.ndarray:
        m, n = len(self.landmarks), len(words)
        own, code, weight = _triples(words)
        count = self.start[code + 1] - self.start[code]
        hit = np.flatnonzero(count)
        count = count[hit]
        at = np.repeat(self.start[code[hit]] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        key = np.repeat(own[hit], count) * m + self.mark[at]
        out = np.bincount(key, np.repeat(weight[hit], count) * self.part[at], minlength=n * m).reshape(n, m)
        # repeated triples only add to a word's norm, so this bound is never below the kernel value
        bound = out[:, :self.telling].max(axis=1) / np.sqrt(np.maximum(np.bincount(own, weight * weight, minlength=n), 1e-9))
        live = np.flatnonzero(bound >= FLOOR)
        out[bound < FLOOR] = 0
        if len(live):
            place = np.full(n, -1)
            place[live] = np.arange(len(live))
            mine = place[own] >= 0
            out[live] /= np.maximum(_norms(place[own[mine]], code[mine], weight[mine], len(live)), 1e-9)[:, None]
        out[out[:, :self.telling].max(axis=1) < FLOOR] = 0
        return out.astype(np.float32)

    def _long(self, letters: str) -> np.ndarray:
        """As ``_some`` for one word of any length: triple weights are added up over parts, each triple where it begins."""
        total = np.zeros(1 << 18)
        for k in range(0, len(letters), LETTERS):
            own, code, weight = _triples([letters[k:k + LETTERS + SPAN - 1]])
            total += np.bincount(code, weight, minlength=1 << 18)
            if k + LETTERS < len(letters):  # those that begin in the overlap belong to the next part
                _, code, weight = _triples([letters[k + LETTERS:k + LETTERS + SPAN - 1]])
                total -= np.bincount(code, weight, minlength=1 << 18)
        live = np.flatnonzero(total)
        out = np.zeros((1, len(self.landmarks)))
        for code in live[self.start[live + 1] > self.start[live]]:
            at = slice(self.start[code], self.start[code + 1])
            np.add.at(out[0], self.mark[at], total[code] * self.part[at])
        out /= max(np.sqrt((total * total).sum()), 1e-9)
        out[out[:, :self.telling].max(axis=1) < FLOOR] = 0
        return out.astype(np.float32)

    def __call__(self, words: list[str]) -> np.ndarray:
        """One row a word; all zero unless it is near a telling landmark."""
        parts, start, size = [], 0, 0
        for k, w in enumerate([*words, ""]):
            if k == len(words) or size + len(w) + SPAN > LETTERS:
                if k > start:
                    part = words[start:k]
                    parts.append(self._long(part[0]) if len(part[0]) > LETTERS else self._some(part))
                start, size = k, 0
            size += len(w) + SPAN
        return np.concatenate(parts) if parts else np.zeros((0, len(self.landmarks)), np.float32)


@dataclass
class Model:
    """Landmarks, the machine's weights on kernel values, and the logistic function of a document's worst sentences."""

    kernel: Kernel | None
    weights: np.ndarray | None = None
    bias: float = 0.0
    logistic: np.ndarray | None = None
    memory: dict = field(default_factory=dict)

    def learn_words(self, tokens: set[str]) -> None:
        """Kernel values of tokens not seen yet; None for those without any."""
        new = [t for t in tokens if t not in self.memory]
        if len(self.memory) + len(new) > KEPT:
            self.memory.clear()
            new = list(tokens)
        values = self.kernel([word(t) for t in new])
        some = values.any(axis=1)
        for k, t in enumerate(new):
            self.memory[t] = values[k].copy() if some[k] else None

    def near(self, cut: list[list[str]]) -> list[tuple[int, np.ndarray]]:
        """Number and vector (its words' greatest values) of each sentence with a word near a telling landmark."""
        self.learn_words({t for s in cut for t in s})
        out, known = [], self.memory
        for k, s in enumerate(cut):
            values = [v for t in s if (v := known[t]) is not None]
            if values:
                out.append((k, np.max(values, axis=0)))
        for t in {t for s in cut for t in s if len(t) > REMEMBERED}:
            known.pop(t, None)
        return out

    def vectors(self, text: str | None) -> np.ndarray:
        """The vectors of a text's sentences that have one."""
        rows = [v for cut in _chunks([text]) for _, v in self.near([s for _, s in cut])]
        return np.array(rows, dtype=np.float32).reshape(len(rows), len(self.kernel.landmarks))

    def summary(self, values: np.ndarray) -> np.ndarray:
        """The three worst sentence values of a document and the logarithm of the number of positive ones."""
        worst = np.sort(np.r_[values, [self.bias] * 3])[::-1][:3]
        return np.r_[worst, np.log1p((values > 0).sum()), 1.0]

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.logistic is None:
            return [0.0] * len(texts)
        found: list[list[float]] = [[] for _ in texts]
        for cut in _chunks(texts):
            for k, v in self.near([s for _, s in cut]):
                found[cut[k][0]].append(float(v @ self.weights) + self.bias)
        x = np.array([self.summary(np.array(f)) for f in found]) @ self.logistic
        return (1 / (1 + np.exp(-np.clip(x, -30, 30)))).tolist()


def _chunks(texts: list[str | None]):
    """Sentences (number of the text, tokens) of ``TOKENS`` tokens together, or one sentence."""
    cut, size = [], 0
    for k, text in enumerate(texts):
        for s in sentences(text):
            if cut and size + len(s) > TOKENS:
                yield cut
                cut, size = [], 0
            cut.append((k, s))
            size += len(s)
    if cut:
        yield cut


def _machine(x: np.ndarray, y: np.ndarray, cost: float = 1.0) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps; classes weigh the same; the last weight is the bias."""
    x = np.c_[x, np.ones(len(x))].astype(np.float64)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y)
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        on = y * (x @ w) < 1
        a = x[on] * (cost * share[on])[:, None]
        new = np.linalg.solve(ridge + a.T @ x[on], a.T @ y[on])
        done = np.abs(new - w).max() < 1e-6
        w = new
        if done:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1]), x.T @ (p - y) + 0.1 * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _fold(bucket: int) -> bool:
    """Is a training document kept for the logistic function?"""
    return bucket % 3 == 0


def _word_batches(batches):
    for b in batches:
        seen = [(w, int(y)) for t, y in zip(*(b.column(b.schema.names.index(n)).to_pylist() for n in ("text", "toxic")))
                for w in {word(t) for s in sentences(t) for t in s} if len(w) > 2]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in seen], pa.string()), pa.array([y for _, y in seen], pa.int32())], names=["word", "toxic"])


def _pick_landmarks(counts: list, n_toxic: int, n_clean: int) -> tuple[list[str], int]:
    """Distinct words by log-likelihood ratio with the label, then the ordinary words nearest to them."""
    def g2(t, c):
        total, seen = n_toxic + n_clean, t + c
        cells = ((t, seen * n_toxic), (c, seen * n_clean), (n_toxic - t, (total - seen) * n_toxic), (n_clean - c, (total - seen) * n_clean))
        return 2 * sum(o * np.log(o * total / e) for o, e in cells if o > 0 and e > 0)

    ranked = sorted(((g2(t, c), w) for w, t, c in counts if t >= SUPPORT and t * n_clean > c * n_toxic), key=lambda r: (-r[0], r[1]))
    picked: list[str] = []
    for g, w in ranked:
        if g < MIN_G2 or len(picked) == POSITIVE:
            break
        if not picked or Kernel(picked, len(picked))([w]).max() < 0.9:
            picked.append(w)
    ordinary = [w for w, t, c in counts if c >= SUPPORT and t * n_clean <= c * n_toxic]
    if picked and ordinary:
        near = Kernel(picked, len(picked))(ordinary).max(axis=1)
        return picked + [ordinary[k] for k in np.lexsort((ordinary, -near))[:NEGATIVE] if near[k] > 0], len(picked)
    return picked, len(picked)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1); both bounded by ``MAX_TRAIN`` documents a label.

    Labels that are NULL or of a NULL doc_id are left out, of several for one doc_id the greatest counts. What reaches the
    driver is bounded by the parameters of this module. Without both labels, or without any word that goes with the label, the
    model scores every text 0.
    """
    chosen = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.withColumn("bucket", F.xxhash64("doc_id"))
    chosen = staged(chosen.where("toxic = 1").orderBy("bucket", "doc_id").limit(MAX_TRAIN).unionByName(
        chosen.where("toxic = 0").orderBy("bucket", "doc_id").limit(MAX_TRAIN)))
    # of rows that repeat a doc_id one is learnt from, so the sample keeps its bound
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "toxic", "bucket"), F.struct(text_key(F.col("text")), "text")).alias("r"))
    sample = staged(rows.select("r.text", "r.toxic", F.pmod("r.bucket", F.lit(3)).cast("int").alias("bucket")))
    fit = sample.where("bucket <> 0")
    sizes = {r["toxic"]: r["count"] for r in fit.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model(None)
    counts = staged(fit.select("text", "toxic").mapInArrow(_word_batches, "word string, toxic int").groupBy("word")
                    .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")))
    odds = F.col("t") * F.log((F.col("t") + 0.5) / (F.col("c") + 0.5) * (n_clean / n_toxic))
    telling = counts.where(F.col("t") >= SUPPORT).orderBy(odds.desc(), "word").limit(TELLING)
    common = counts.where(F.col("c") >= SUPPORT).orderBy(F.desc("c"), "word").limit(COMMON)
    marks, telling = _pick_landmarks([tuple(r) for r in telling.unionByName(common).distinct().collect()], n_toxic, n_clean)
    if not marks:
        return Model(None)
    blank = Model(Kernel(marks, telling))

    def bags(batches):
        for b in batches:
            rows = []
            for text, toxic, bucket in zip(*(b.column(k).to_pylist() for k in range(3))):
                v = blank.vectors(text)
                v = v[np.argsort(-v[:, :telling].max(axis=1), kind="stable")[:MAX_SENTENCES]] if len(v) else v
                rows.append((toxic, bucket, v.ravel().tolist()))
            blank.memory.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.list_(pa.float32())))] if rows else
                                             [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.list_(pa.float32()))], names=["toxic", "bucket", "v"])

    got = sample.select("text", "toxic", "bucket").mapInArrow(bags, "toxic int, bucket int, v array<float>").toArrow()
    toxic, bucket = (got.column(k).to_numpy() for k in (0, 1))
    flat, offsets = got.column(2).combine_chunks(), None
    offsets = flat.offsets.to_numpy()
    flat = flat.values.to_numpy(zero_copy_only=False)
    bag = [flat[a:b].reshape(-1, len(marks)) for a, b in zip(offsets[:-1], offsets[1:])]
    return _fit(Kernel(marks, telling), bag, toxic, bucket)


def _fit(kernel: Kernel, bag: list[np.ndarray], toxic: np.ndarray, bucket: np.ndarray) -> Model:
    marks = kernel.landmarks
    among = kernel(marks).astype(np.float64)
    value, vector = np.linalg.eigh((among + among.T) / 2)
    whiten = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T  # Nyström: kernel values to features
    fit = [k for k in range(len(bag)) if not _fold(int(bucket[k])) and len(bag[k])]
    clean = [bag[k] for k in fit if toxic[k] == 0]
    bad = [bag[k] for k in fit if toxic[k] == 1]
    if not bad:
        return Model(None)
    negative = np.concatenate(clean) if clean else np.zeros((1, len(marks)), np.float32)
    witness = [b[[b[:, :kernel.telling].max(axis=1).argmax()]] for b in bad]
    model = Model(kernel)
    for _ in range(4):
        x = np.concatenate([*witness, negative, np.zeros((1, len(marks)), np.float32)])
        y = np.r_[np.ones(sum(map(len, witness))), -np.ones(len(negative) + 1)]
        w = _machine(x @ whiten, y)
        model.weights, model.bias = (whiten @ w[:-1]).astype(np.float32), float(w[-1])
        values = [b @ model.weights + model.bias for b in bad]
        witness = [b[v > 0] if (v > 0).any() else b[[v.argmax()]] for b, v in zip(bad, values)]
    held = [k for k in range(len(bag)) if _fold(int(bucket[k]))]
    if len({int(toxic[k]) for k in held}) < 2:
        held = range(len(bag))
    model.logistic = _logistic(np.array([model.summary(bag[k] @ model.weights + model.bias) for k in held]), np.array([float(toxic[k]) for k in held]))
    return model


def score_documents(docs: DataFrame, model: Model, *carry: str) -> DataFrame:
    """The columns ``carry`` (the text may be one) and the ``score`` (0 to 1) of each row's whole text.

    Only the text is read for the score. NULL and empty texts score as a document without any telling sentence. Every row comes out once.
    """
    rows = docs.select(*[c for c in carry if c not in ("text", "score")], "text")
    with_text = "text" in carry
    # 64 landmarks and their weights: a fixed bound
    held = docs.sparkSession.sparkContext.broadcast({"fitted": (model.kernel and (model.kernel.landmarks, model.kernel.telling), model.weights, model.bias, model.logistic)})
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if with_text or f.name != "text")

    def run(batches):
        if "model" not in held.value:  # the broadcast value stays with the Python worker, and the memory of words with it
            marks, *rest = held.value["fitted"]
            held.value["model"] = Model(Kernel(*marks) if marks else None, *rest)
        m = held.value["model"]
        for b in batches:
            at = b.schema.names.index("text")
            keep = [k for k in range(len(b.schema.names)) if with_text or k != at]
            for s in slices(b, "text", SLICE):
                yield pa.RecordBatch.from_arrays([s.column(k) for k in keep] + [pa.array(m.scores(s.column(at).to_pylist()), pa.float64())],
                                                 names=[b.schema.names[k] for k in keep] + ["score"])

    return rows.mapInArrow(run, schema + "score double")
