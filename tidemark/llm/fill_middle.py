"""Fill-in-the-middle by displacement scatter.

A text's bytes move in three runs (prefix, middle, suffix), so every byte's place in the output is its own place plus a shift that is
constant inside a run. A difference array holds the change of shift where a run begins; its cumulative sum gives every byte of a
batch its shift, one scatter builds all outputs, and a gather by the same kind of array restores the texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: percent of texts that are cut, and percent of these that begin with the suffix
CUT, SUFFIX_FIRST = 100, 50
#: bytes of text that are moved at once (one longer text is moved alone), and bytes that have a shift in memory at once
SLICE, WINDOW = 8 << 20, 1 << 20

_MARKER = re.compile(b"|".join((PREFIX, SUFFIX, MIDDLE)))


def draws(doc_id: Column, seed: str) -> list[Column]:
    """Four integers below 2^32 from the digest of ``seed:doc_id``; a NULL id stands for no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substr(digest, F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("bigint") for k in range(4)]


def move(source: np.ndarray, size: int, at: np.ndarray, to: np.ndarray, length: np.ndarray, gather: bool = False) -> np.ndarray:
    """An array of ``size`` bytes in which ``length`` bytes from ``at`` stand at ``to``; with ``gather`` the runs are read from ``to`` instead.

    Runs are in order of ``at`` and cover ``at[0]`` to the end of the last without holes. Shifts are summed a window at a time.
    """
    out = np.zeros(size, np.uint8)
    change = np.diff(to - at, prepend=0)  # runs without bytes begin where the next one does, so their changes add up there
    end = int(at[-1] + length[-1]) if len(at) else 0
    carry, start = 0, int(at[0]) if len(at) else 0
    while start < end:
        stop = min(start + WINDOW, end)
        low, high = np.searchsorted(at, [start, stop])
        shift = np.zeros(stop - start, np.int64)
        np.add.at(shift, at[low:high] - start, change[low:high])
        shift[0] += carry
        place = np.cumsum(shift)
        carry = int(place[-1])
        place += np.arange(start, stop)
        if gather:
            out[start:stop] = source[place]
        else:
            out[place] = source[start:stop]
        start = stop
    return out


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, one text after another, and where each begins (and the last ends); NULL is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def _strings(data: np.ndarray, ends: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    mask = None if null is None else pa.array(~null).buffers()[1]
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [mask, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.large_string()).cast(pa.string())


def _chars(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Code points between byte places: bytes that continue none."""
    return np.array([np.count_nonzero((data[a:b] & 0xC0) != 0x80) for a, b in zip(start, stop)], np.int64)


def cut(texts: pa.Array, h: np.ndarray, rate: int, suffix_first: int) -> tuple[list[pa.Array], pa.Array]:
    """For each text: n, prefix_chars, middle_chars, form (0 plain, 1 psm, 2 spm), and the output; ``h`` has four rows of draws."""
    data, ends = _bytes_of(texts)
    first, last = ends[:-1], ends[1:]
    breaks = np.flatnonzero(data == 10) + 1  # where a line ends
    low, high = np.searchsorted(breaks, first, "right"), np.searchsorted(breaks, last, "right")
    open_end = (last > first) & ((high == low) | (breaks[np.maximum(high - 1, 0)] != last if len(breaks) else True))
    n = high - low + open_end
    marked = np.array([_MARKER.search(data[a:b]) is not None for a, b in zip(first, last)], bool)
    plain = (n == 0) | marked | (h[2] % 100 >= rate)
    spm = ~plain & (h[3] % 100 < suffix_first)

    def place(units: np.ndarray) -> np.ndarray:
        """The byte after so many units."""
        at = np.where(units == 0, first, last)
        inner = (units > 0) & (units < n)
        at[inner] = breaks[(low + units - 1)[inner]]
        return at

    one, two = np.sort([h[0] % (n + 1), h[1] % (n + 1)], axis=0)
    one, two = np.where(plain, last, place(one)), np.where(plain, last, place(two))
    marks = np.where(plain, 0, 9)
    begin = np.r_[0, np.cumsum(last - first + marks)]
    size_p, size_m, size_s, o = one - first, two - one, last - two, begin[:-1]
    to_s = np.where(plain, o + size_p + size_m, np.where(spm, o + 3, o + 6 + size_p))
    to_p = np.where(plain, o, np.where(spm, o + 6 + size_s, o + 3))
    to_m = np.where(plain, o + size_p, o + 9 + size_p + size_s)
    runs = [np.column_stack(x).ravel() for x in ((first, one, two), (to_p, to_m, to_s), (size_p, size_m, size_s))]
    out = move(data, int(begin[-1]), *runs)
    for mark, at in ((PREFIX, to_p - 3), (SUFFIX, to_s - 3), (MIDDLE, to_m - 3)):
        for k, byte in enumerate(mark):
            out[at[~plain] + k] = byte
    chars = [pa.array(_chars(data, a, b), pa.int64(), mask=plain) for a, b in ((first, one), (one, two))]
    return [pa.array(n, pa.int64()), *chars, pa.array(np.where(plain, 0, np.where(spm, 2, 1)), pa.int8())], _strings(out, begin)


def rejoin(outputs: pa.Array, form: np.ndarray) -> pa.Array:
    """The texts behind outputs, from output and form alone; NULL where an output doesn't hold each marker once in the form's order."""
    data, ends = _bytes_of(outputs)
    first, last = ends[:-1], ends[1:]
    n = len(first)
    at = np.flatnonzero((data[:-2] == 60) & (data[2:] == 62) & np.isin(data[1:-1], [m[1] for m in (PREFIX, SUFFIX, MIDDLE)])) if len(data) > 2 else np.zeros(0, np.int64)
    owner = np.searchsorted(last, at, "right")
    own = (form[owner] > 0) & (at + 3 <= last[owner])  # three bytes of two outputs are no marker
    at, owner = at[own], owner[own]
    good = (form == 0) | (np.bincount(owner, minlength=n) == 3)
    at, owner = at[good[owner]], owner[good[owner]]
    marks = np.zeros((n, 3), np.int64)
    cutted = np.flatnonzero((form > 0) & good)
    marks[cutted] = at.reshape(-1, 3)
    order = data[marks + 1] if len(data) > 1 else marks
    want = np.where((form == 2)[:, None], [[SUFFIX[1], PREFIX[1], MIDDLE[1]]], [[PREFIX[1], SUFFIX[1], MIDDLE[1]]])
    good &= (form == 0) | ((order == want).all(axis=1) & (marks[:, 0] == first))
    plain, spm = (form == 0) | ~good, form == 2
    # in the order of the text: prefix, middle, suffix, each with its place in the output
    stop = np.column_stack([marks[:, 1], marks[:, 2]])
    size_1, size_2 = stop[:, 0] - marks[:, 0] - 3, stop[:, 1] - stop[:, 0] - 3
    p_at, s_at = np.where(spm, marks[:, 1], marks[:, 0]) + 3, np.where(spm, marks[:, 0], marks[:, 1]) + 3
    size_p, size_s = np.where(spm, size_2, size_1), np.where(spm, size_1, size_2)
    p_at, size_p = np.where(plain, first, p_at), np.where(plain, last - first, size_p)
    m_at, size_m = np.where(plain, last, marks[:, 2] + 3), np.where(plain, 0, last - marks[:, 2] - 3)
    s_at, size_s = np.where(plain, last, s_at), np.where(plain, 0, size_s)
    begin = np.r_[0, np.cumsum(size_p + size_m + size_s)]
    o = begin[:-1]
    runs = [np.column_stack(x).ravel() for x in ((o, o + size_p, o + size_p + size_m), (p_at, m_at, s_at), (size_p, size_m, size_s))]
    return _strings(move(data, int(begin[-1]), *runs, gather=True), begin, ~good | np.asarray(outputs.is_null()))


FORMS = ["plain", "psm", "spm"]


def transform(docs: DataFrame, seed: str, rate: int = CUT, suffix_first: int = SUFFIX_FIRST, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Add ``n`` (lines), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output`` to every row.

    Lines end after a line feed. The cuts, the choice to cut (``rate`` percent) and the order (``suffix_first`` percent) come from the
    digest of ``seed:doc_id``, so repeated rows get the same form. NULL and empty texts are plain with an empty output; texts that
    hold a marker are plain and come out as they are; plain rows have NULL chars. A NULL id draws like one without digits. Columns of
    the new names are replaced, all others stay.
    """
    new = ["n", "prefix_chars", "middle_chars", "form", "output"]
    rest = [f for f in docs.schema if f.name not in new or f.name in (text, doc_id)]
    clash = {f.name for f in rest}
    h = [next(name for name in (f"_draw{k}{'_' * j}" for j in range(1 + len(clash))) if name not in clash) for k in range(4)]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in rest], *[c.alias(name) for c, name in zip(draws(F.col(f"`{doc_id}`"), seed), h)])

    def run(batches):
        for b in batches:
            for s in slices(b, text, SLICE):
                draw = np.array([s.column(name).to_numpy() for name in h]).reshape(4, -1)
                (n, p, m, form), out = cut(s.column(text), draw, rate, suffix_first)
                yield pa.RecordBatch.from_arrays([s.column(f.name) for f in rest] + [n, p, m, pa.array(FORMS).take(form), out], names=[f.name for f in rest] + new)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return rows.mapInArrow(run, f"{kinds}, n bigint, prefix_chars bigint, middle_chars bigint, form string, output string")


def restore(rows: DataFrame, output: str = "output", form: str = "form", restored: str = "restored") -> DataFrame:
    """Add ``restored``, the text that ``transform`` read (NULL came out as empty), from the output and its form alone.

    An output that doesn't hold its form's markers once each and in order, or a form that is NULL or not known, gives NULL. A column
    named ``restored`` is replaced, all others stay.
    """
    rest = [f for f in rows.schema if f.name != restored]

    def run(batches):
        for b in batches:
            for s in slices(b, output, SLICE):
                code = pc.index_in(s.column(form), value_set=pa.array(FORMS))
                known = np.asarray(code.is_valid())
                text = rejoin(s.column(output), np.asarray(code.fill_null(0)))
                text = pc.if_else(pa.array(known), text, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([s.column(f.name) for f in rest] + [text], names=[f.name for f in rest] + [restored])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return rows.select(*[F.col(f"`{f.name}`") for f in rest]).mapInArrow(run, f"{kinds}, `{restored}` string")
