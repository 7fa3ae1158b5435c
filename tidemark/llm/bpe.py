"""Byte-level BPE by a monoid tree: halves are encoded on their own and joined at the boundary.

Token sequences form a monoid under ``join``. Joining re-encodes a window around the boundary, at first the two tokens that meet; while
the token just outside the window and the one just inside don't stay apart when encoded together, the window grows by
that token. A sequence in which every neighbouring pair encodes to itself is the encoding of the whole: the first merge that
crosses a token border would have to cross it in the pair alone as well. So tokens outside a settled window are final. Decoding
concatenates up the same tree.
"""

from __future__ import annotations

import base64
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import slices

#: runs up to this many bytes are leaves
LEAF = 16
#: units of text up to this many characters are remembered
UNIT = 32
#: bytes that a task's remembered units, and pairs of tokens, may take; a full table is emptied, that of units by its older half, which changes no result
KEPT = 48 << 20
#: about so many bytes are taken by a unit with its ids, and by a pair
UNIT_COST, PAIR_COST = 240, 170
#: bytes of text that are held as Python objects at once, or one text
SLICE = 1 << 20


def read_ranks(path: str) -> list[tuple[str, int]]:
    """The rank file's pairs of base64 token and rank."""
    with open(path, encoding="ascii") as f:
        return [(a, int(b)) for a, b in (line.split() for line in f if line.strip())]


class Codec:
    """Encoder and decoder for one vocabulary; ``pattern`` cuts a text into pieces that are encoded separately."""

    def __init__(self, ranks: list[tuple[str, int]], pattern: str):
        self.ranks = {base64.b64decode(a): r for a, r in ranks}
        self.token = {r: b for b, r in self.ranks.items()}
        found: dict[bytes, set[int]] = {}
        for b in self.ranks:
            if len(b) >= 4:
                found.setdefault(b[:4], {3, 2, 1}).add(len(b))
        #: first four bytes -> lengths that a token which begins so can have, longest first
        self.lengths = {b: tuple(sorted(n, reverse=True)) for b, n in found.items()}
        self.pieces = regex.compile(pattern)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.met: dict[tuple[int, int], bool] = {}
        self.spines: dict[tuple[int, bool], list[tuple[bytes, float]]] = {}

    def _leaf(self, data: bytes, never: int = 1 << 40) -> list[int]:
        """Merge the neighbours of lowest rank, leftmost first, until none of a rank below ``never`` is left."""
        get = self.ranks.get
        parts = [data[k:k + 1] for k in range(len(data))]
        pairs = [get(data[k:k + 2], never) for k in range(len(data) - 1)]
        while pairs:
            best = min(pairs)
            if best >= never:
                break
            at = pairs.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at], never)
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1], never)
        return [self.ranks[p] for p in parts]

    def _merge(self, data: bytes) -> list[int]:
        """As ``_leaf`` for windows of any length: a heap of candidate merges over a linked list."""
        if len(data) <= 64:
            return self._leaf(data)
        get, n = self.ranks.get, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part runs from its start to end[start]
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := get(data[k:k + 2])) is not None]
        heapify(heap)
        alive = [True] * n + [False]
        while heap:
            _, k, stop = heappop(heap)
            if not alive[k] or not alive[m := end[k]] or end[m] != stop:
                continue
            alive[m], end[k] = False, stop
            if stop < n:
                before[stop] = k
                if (r := get(data[k:end[stop]])) is not None:
                    heappush(heap, (r, k, end[stop]))
            if k and (r := get(data[before[k]:stop])) is not None:
                heappush(heap, (r, before[k], stop))
        return [self.ranks[data[k:end[k]]] for k in range(n) if alive[k]]

    def _spine(self, token: int, right: bool) -> list[tuple[bytes, float]]:
        """The parts at one edge of a token from its single byte to the whole, each with the rank that absorbs it."""
        spine = self.spines.get((token, right))
        if spine is None:
            part, spine = self.token[token], []
            until = float("inf")
            while True:
                spine.append((part, until))
                if len(part) == 1:
                    break
                until = self.ranks[part]
                # its last merge: what the bytes merge to below the part's own rank
                head, tail = self._leaf(part, until)
                part = self.token[tail if right else head]
            spine.reverse()
            self.spines[token, right] = spine
        return spine

    def _apart(self, left: int, right: int) -> bool:
        """Do two tokens stay as they are side by side? Follows the parts that touch at the border through the order of merges:
        a merge across it must come before either part is absorbed, on a tie before the one to its right only."""
        ok = self.met.get((left, right))
        if ok is None:
            a, b, i, j, get = self._spine(left, True), self._spine(right, False), 0, 0, self.ranks.get
            top = float("inf")
            while True:
                (x, tx), (y, ty) = a[i], b[j]
                r = get(x + y)
                ok = r is None or r >= tx or r > ty
                if not ok or tx == ty == top:
                    break
                if tx <= ty:
                    i += 1
                else:
                    j += 1
            if len(self.met) * PAIR_COST >= KEPT:
                self.met.clear()
            self.met[left, right] = ok
        return ok

    def join(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the two sequences' bytes together."""
        if not a or not b:
            return a or b
        i, j, more_left, more_right = len(a) - 1, 1, 1, 1  # the window is a[i:] and b[:j]
        if self._apart(a[-1], b[0]):
            return a + b
        mid = tuple(self._merge(self.token[a[-1]] + self.token[b[0]]))
        while True:
            left = i == 0 or self._apart(a[i - 1], mid[0])
            right = j == len(b) or self._apart(mid[-1], b[j])
            if left and right:
                return a[:i] + mid + b[j:]
            if not left:
                i, more_left = max(i - more_left, 0), more_left * 2
            if not right:
                j, more_right = min(j + more_right, len(b)), more_right * 2
            mid = tuple(self._merge(b"".join(map(self.token.__getitem__, a[i:] + b[:j]))))

    def _search(self, data: bytes) -> tuple[int, ...]:
        """The token sequence of a leaf in which every neighbouring pair stays apart, by longest tokens first."""
        get, met, apart, lengths = self.ranks.get, self.met.get, self._apart, self.lengths.get
        out: list[int] = []
        cuts = [0]
        at, stop, size = 0, len(data), len(data)
        while at < size:
            for n in lengths(data[at:at + 4], (3, 2, 1)):
                if at + n > stop:
                    continue
                token = get(data[at:at + n])
                if token is not None:
                    if not out:
                        break
                    ok = met((out[-1], token))
                    if ok or ok is None and apart(out[-1], token):
                        break
            else:  # no token fits here: shorten the one before
                out.pop()
                stop = cuts.pop() - 1
                at = cuts[-1]
                continue
            out.append(token)
            at += n
            cuts.append(at)
            stop = size
        return tuple(out)

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """Encode the halves and join them, from leaves upwards."""
        if len(data) <= LEAF:
            return self._search(data)
        half = 1 << (len(data) - 1).bit_length() - 1  # a power of two, so that runs of one byte meet on token borders
        return self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    def _units(self, text: str):
        """Cut before every space that stands before a non-space: the pattern begins a piece there in any case."""
        words = iter(text.split(" "))
        unit = next(words)
        for w in words:
            if w and not w[0].isspace():
                yield unit
                unit = " " + w
            else:
                unit += " " + w
        yield unit

    def _recall(self, text: str) -> tuple[int, ...] | None:
        """Ids of a unit or piece that isn't in the newer table, from the older one."""
        ids = self.older.get(text)
        if ids is not None:
            self._remember(text, ids)
        return ids

    def _remember(self, text: str, ids: tuple[int, ...]) -> None:
        if len(text) <= UNIT:
            if len(self.known) * UNIT_COST >= KEPT // 2:
                self.older, self.known = self.known, {}
            self.known[text] = ids

    def _unit(self, unit: str) -> tuple[int, ...]:
        ids: tuple[int, ...] = ()
        pieces = self.pieces.findall(unit)
        for piece in pieces:
            data = piece.encode("utf-8", "surrogatepass")
            one = self.ranks.get(data)
            if one is not None:
                ids += (one,)
                continue
            part = self.known.get(piece) or self._recall(piece)
            if part is None:
                part = self.encode_bytes(data)
                if len(pieces) > 1:
                    self._remember(piece, part)
            ids += part
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, piece by piece; NULL is empty."""
        out: list[int] = []
        for unit in self._units(text or ""):
            ids = self.known.get(unit)
            if ids is None:
                ids = self._recall(unit)
                if ids is None:
                    ids = self._unit(unit)
                    self._remember(unit, ids)
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of a sequence: halves decoded and concatenated."""
        if len(ids) <= 4096:
            return b"".join(map(self.token.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def _encoded(codec: Codec, column: pa.Array) -> pa.Array:
    """Lists of ids, gathered in one flat array."""
    flat, ends = array("i"), [0]
    for text in column.to_pylist():
        flat.extend(codec.encode(text))
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32) if flat else [], pa.int32()))


def _decoded(codec: Codec, column: pa.Array) -> pa.Array:
    """Bytes of each list of ids; NULL stays NULL."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
    valid = column.is_valid().to_pylist()
    return pa.array([codec.decode(values[a:b].tolist()) if ok else None for ok, a, b in zip(valid, ends, ends[1:])], pa.binary())


def _mapper(held, pattern: str, column: str, rest: list[str], acts: list):
    """Batches with the columns ``rest`` and what each act makes of the one before it, the first of ``column``."""
    def run(batches):
        if "codec" not in held.value:  # the broadcast value stays with the Python worker, and the codec's memory with it
            held.value["codec"] = Codec(held.value["ranks"], pattern)
        codec = held.value["codec"]
        for b in batches:
            for s in slices(b, column, SLICE) if pa.types.is_string(b.schema.field(column).type) else (b.slice(k, 512) for k in range(0, b.num_rows, 512)):
                made = [s.column(column)]
                for _, act in acts:
                    made.append(act(codec, made[-1]))
                yield pa.RecordBatch.from_arrays([s.column(n) for n in rest] + made[1:], names=rest + [n for n, _ in acts])
    return run


def _with(df: DataFrame, path: str, pattern: str, column: str, acts: list[tuple]) -> DataFrame:
    """Add a column for each act (name, SQL type, function of codec and array)."""
    held = df.sparkSession.sparkContext.broadcast({"ranks": read_ranks(path)})  # the vocabulary: a fixed 50,256 tokens
    new = [n for n, _, _ in acts]
    rest = [f for f in df.schema if f.name not in new or f.name == column]
    df = df.select(*[f"`{f.name}`" for f in rest])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"`{n}` {kind}" for n, kind, _ in acts])
    return df.mapInArrow(_mapper(held, pattern, column, [f.name for f in rest], [(n, act) for n, _, act in acts]), schema)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids`` (array of int), the whole text's tokens. NULL and empty texts have none; every row stays; a column named ``ids`` is replaced."""
    return _with(docs, path, pattern, text, [(ids, "array<int>", _encoded)])


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """Add ``decoded`` (binary), the bytes of the tokens. NULL ids give NULL; a column named ``decoded`` is replaced."""
    return _with(tokens, path, pattern, ids, [(data, "binary", _decoded)])


def encode_and_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``decode`` of ``encode`` in one pass, with one codec in a task: adds ``ids`` and ``decoded``, which are replaced where they exist."""
    return _with(docs, path, pattern, text, [(ids, "array<int>", _encoded), (data, "binary", _decoded)])
