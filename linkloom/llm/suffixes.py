"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

The result is exact: every byte goes that lies in a `span`-byte string which
also starts earlier (smaller id, or further up in the same document).

Suffixes are sampled by content: a window of `span` bytes is represented by
its *anchor*, the k-byte string in it of least hash (the leftmost of equal
ones), so equal windows have equal anchors at equal offsets.  Consecutive
windows of one anchor make a *stretch*.  An entry is the suffix at an anchor,
cut where its stretch ends, followed by the bytes of the stretch before it.

A batch of documents gets a suffix array: its entries in alphabetical order,
and the length of the longest common prefix (LCP) of neighbours.  Neighbours
that share all of an entry are equal stretches; neighbours that share k bytes
or more have one anchor.  `Family` holds such arrays in levels.  A new array is
merge-scanned against every level for stretches that are there in full, and
leaves those it shares; levels of similar size are then merged, so sizes grow
geometrically and an entry is moved a logarithmic number of times.  A family
that holds `room` entries is closed and a new one begun, so memory does not
depend on a partition's size.

1. A closed family passes on the repeats among its own documents, and of each
   anchor one row at most: the 128-bit print of its only stretch, or the note
   that it has seen several.  So a passage of any frequency is one row a family.
2. These rows are sorted by anchor and print, as runs that spill and merge on
   disk, and scanned as a stream.  Equal prints are repeats between families.
   Anchors with different stretches mark the borders of matches.
3. Only there, each window is compared by itself in the same way.

Within a family stretches are compared byte by byte, between families by prints.

Defined results: null and empty texts are empty documents; documents shorter
than `span` stay; an id identifies a document, so rows repeated with it are
the same occurrence; a null id is left as it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop, shuffle_parts
from .shingles import mix

_U = np.uint64
_RNG = np.random.default_rng(20240917)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_POS = _U((1 << 24) - 1)
CHUNK = 1 << 18
BATCH = 40_000  # entries of a batch's suffix array
ROOM = 200_000  # entries of a family
WINDOWS = 1 << 18  # windows of a batch
# kinds of rows
LONE, SEVERAL, REPEAT, BORDER = 0, 1, 2, 3
_NOTE = np.int64(-1 << 63)  # sorts before every print


def prints(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit prints, in halves, of rows of bytes; their width is a multiple of 8."""
    words = rows.view("<u8")
    a, b = np.full(len(rows), 1, np.uint64), np.full(len(rows), 2, np.uint64)
    for i in range(words.shape[1]):
        w = words[:, i]
        a = mix(a * _BASE + w)
        b = mix((b ^ w) * _U(0xD6E8FEB86659FD93) + _U(1))
    return a.view(np.int64), b.view(np.int64)


def _cut_rows(buf: np.ndarray, lo: np.ndarray, size: np.ndarray, out: np.ndarray) -> None:
    """out[i] = buf[lo[i]:][:size[i]], filled up with zeros; buf reaches out's width beyond any lo."""
    width = out.shape[1]
    np.multiply(np.lib.stride_tricks.sliding_window_view(buf, width)[lo], np.arange(width) < size[:, None], out=out)


def entries(buf: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, span: int, k: int) -> np.ndarray:
    """The suffix at each anchor up to its stretch's end, and what of the stretch
    lies before it, as byte strings of one width; both lengths close an entry."""
    left = span - k
    width = -(-(span + left + 9) // 8) * 8
    out = np.zeros((len(at), width), np.uint8)
    padded = np.concatenate([buf, np.zeros(span, np.uint8)])
    _cut_rows(padded, at, hi + span - at, out[:, :span])
    if left:
        _cut_rows(padded, lo, at - lo, out[:, span : span + left])
    out[:, -9:-5] = (hi + span - at).astype("<u4")[:, None].view(np.uint8)
    out[:, -5:-1] = (at - lo).astype("<u4")[:, None].view(np.uint8)
    out[:, -1] = 1  # byte strings lose zeros at their end
    return out.view(f"S{width}").ravel()


def lcp(a: np.ndarray, b: np.ndarray, step: int = 8192) -> np.ndarray:
    """Length of the longest common prefix, entry by entry."""
    size, out = a.dtype.itemsize, np.zeros(len(a), np.int64)
    for i in range(0, len(a), step):
        x, y = (np.ascontiguousarray(v[i : i + step]).view(np.uint8).reshape(-1, size) for v in (a, b))
        differ = x != y
        out[i : i + step] = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
    return out


def stretches(buf: np.ndarray, doc: np.ndarray, span: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, entry, first and last window of every stretch.
    doc: the document of each byte; no window crosses documents."""
    empty = np.zeros(0, np.int64)
    if len(buf) < span:
        return empty.view(np.uint64), entries(buf, empty, empty, empty, span, k), empty, empty
    h, step, base = _BYTE[buf], 1, _BASE
    left = k
    total, done = None, 0
    while left:  # hash of k bytes from hashes of powers of two
        if left & 1:
            part = h[done : len(buf) - k + 1 + done]
            total = part.copy() if total is None else total * base + part
            done += step
        left >>= 1
        if left:
            h = h[:-step] * base + h[step:]
            step *= 2
            with np.errstate(over="ignore"):
                base = base * base + _U(2)
    h = mix(total)
    low = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    w, size = span - k + 1, 1
    while size * 2 <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < w:
        low = np.minimum(low[: len(low) - (w - size)], low[w - size :])
    at = (low & _POS).astype(np.int64)
    valid = doc[: len(at)] == doc[span - 1 :]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
    lo, hi = np.flatnonzero(new), np.flatnonzero(last)
    return h[at[lo]], entries(buf, at[lo], lo, hi, span, k), lo, hi


class Family:
    """Levels of sorted entries, none twice; of equal ones the earliest stays."""

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []
        self.repeats: list[list[np.ndarray]] = []

    def __len__(self) -> int:
        return sum(len(level[0]) for level in self.levels)

    def add(self, key: np.ndarray, doc: np.ndarray, at: np.ndarray, more: np.ndarray) -> None:
        """A batch. at: place in the document, in its upper bits; more: carried along."""
        if not len(key):
            return
        order = np.lexsort((at, doc))
        order = order[np.argsort(key[order], kind="stable")]
        new = [f[order] for f in (key, doc, at, more)]
        head = np.r_[True, lcp(new[0][1:], new[0][:-1]) < key.dtype.itemsize]
        first = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
        self._report(new, ~head & ((new[1] != new[1][first]) | (new[2] != new[2][first])))
        new = [f[head] for f in new]
        for level in self.levels:
            i = np.searchsorted(level[0], new[0])
            i[i == len(level[0])] = 0
            hit = np.flatnonzero(lcp(level[0][i], new[0]) == key.dtype.itemsize)
            if not len(hit):
                continue
            there = i[hit]
            before = (new[1][hit] < level[1][there]) | ((new[1][hit] == level[1][there]) & (new[2][hit] < level[2][there]))
            same = (new[1][hit] == level[1][there]) & (new[2][hit] == level[2][there])
            late = np.zeros(len(new[0]), bool)
            late[hit[~before & ~same]] = True
            self._report(new, late)
            self._report(level, there[before])
            for f, g in zip(level[1:], new[1:]):
                f[there[before]] = g[hit[before]]
            stay = np.ones(len(new[0]), bool)
            stay[hit] = False
            new = [f[stay] for f in new]
        if len(new[0]):
            self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            self._merge()

    def _report(self, rows: list[np.ndarray], which: np.ndarray) -> None:
        if which.any() if which.dtype == bool else len(which):
            self.repeats.append([f[which] for f in rows[1:3]])

    def _merge(self) -> None:
        b, a = self.levels.pop(), self.levels.pop()
        place = np.searchsorted(a[0], b[0]) + np.arange(len(b[0]))
        old = np.ones(len(a[0]) + len(b[0]), bool)
        old[place] = False
        level = []
        for x, y in zip(a, b):
            z = np.empty(len(old), x.dtype)
            z[place], z[old] = y, x
            level.append(z)
        self.levels.append(level)

    def finish(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Earliest entries in order (key, doc, at, more), and all repeats (doc, at)."""
        while len(self.levels) > 1:
            self._merge()
        none = np.zeros(0, np.int64)
        kept = self.levels[0] if self.levels else [np.zeros(0, "S8"), none, none, none.view(np.uint64)]
        return kept, [np.concatenate(f) for f in zip(*self.repeats)] if self.repeats else [none, none]


def _chunks(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, row of each byte, ids by row, and offset of each row's first byte;
    a long document comes in pieces that overlap by span - 1 bytes."""
    held, ids, offs, size = [], [], [], 0

    def close():
        buf = np.frombuffer(b"".join(held), np.uint8)
        return buf, np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for x in held]), np.array(ids, np.int64), np.array(offs, np.int64)

    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1)):
            text = text.as_py()
            if key is None or text is None or len(text) * 4 < span:
                continue
            data = text.encode("utf-8", "surrogatepass")
            for at in range(0, max(1, len(data) - span + 1), CHUNK):
                piece = data[at : at + CHUNK + span - 1]
                if len(piece) < span:
                    continue
                held.append(piece)
                ids.append(key)
                offs.append(at)
                size += len(piece)
                if size >= CHUNK:
                    yield close()
                    held, ids, offs, size = [], [], [], 0
    if held:
        yield close()


ROWS = "key long, p long, q long, doc long, at long"


def _rows(columns: list[np.ndarray], names: list[str], step: int = 50_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), step):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + step]) for c in columns], names=names)


def _passed_on(family: Family, k: int) -> Iterator[pa.RecordBatch]:
    """Rows of a closed family. at: first window << 12 | further windows << 4 | kind."""
    (entry, doc, at, anchor), repeats = family.finish()
    names = [x.split()[0] for x in ROWS.split(", ")]

    def settled(doc: np.ndarray, at: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
        zero = np.zeros(len(doc), np.int64)
        yield from _rows([mix(doc.view(np.uint64)).view(np.int64), zero, zero, doc, at | kind], names)

    yield from settled(*repeats, REPEAT)
    if not len(entry):
        return
    # neighbours with a common prefix of an anchor's length are stretches of one anchor
    group = np.cumsum(np.r_[True, lcp(entry[1:], entry[:-1]) < k]) - 1
    several = np.bincount(group)[group] > 1
    yield from settled(doc[several], at[several], BORDER)
    notes = np.unique(anchor[several]).view(np.int64)
    sign = np.full(len(notes), _NOTE)
    yield from _rows([notes, sign, sign, np.zeros(len(notes), np.int64), np.full(len(notes), SEVERAL, np.int64)], names)
    lone = np.flatnonzero(~several)
    for i in range(0, len(lone), 20_000):
        own = lone[i : i + 20_000]
        p, q = prints(entry[own].view(np.uint8).reshape(len(own), -1))
        yield from _rows([anchor[own].view(np.int64), p, q, doc[own], at[own] | LONE], names)


def _local(texts: DataFrame, span: int, k: int) -> DataFrame:
    """Repeats and borders within families of an input partition, and a row for each other anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, waiting, n = Family(), [], 0
        for buf, row, ids, offs in _chunks(batches, span):
            anchor, entry, lo, hi = stretches(buf, row, span, k)
            own = row[lo]
            begin = np.searchsorted(row, np.arange(len(ids)))[own]
            waiting.append((entry, ids[own], (lo - begin + offs[own]) << 12 | (hi - lo) << 4, anchor))
            n += len(entry)
            if n >= BATCH:
                family.add(*(np.concatenate(f) for f in zip(*waiting)))
                waiting, n = [], 0
                if len(family) >= ROOM:
                    yield from _passed_on(family, k)
                    family = Family()
        if waiting:
            family.add(*(np.concatenate(f) for f in zip(*waiting)))
        yield from _passed_on(family, k)

    return texts.mapInArrow(run, ROWS)


def _marks(key: np.ndarray, p: np.ndarray, q: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """doc, at: repeats and borders among rows sorted by key, print and place;
    and the rows that those to come have to be seen with."""
    fresh_key = np.r_[True, key[1:] != key[:-1]]
    fresh_print = fresh_key | np.r_[True, (p[1:] != p[:-1]) | (q[1:] != q[:-1])]
    group = np.cumsum(fresh_key) - 1
    several = np.bincount(group, weights=fresh_print)[group] > 1
    first = np.maximum.accumulate(np.where(fresh_print, np.arange(len(key)), 0))
    stretch = at & 15 == LONE
    again = stretch & ~fresh_print & ((doc != doc[first]) | (at != at[first]))
    border = stretch & fresh_print & several
    found = [np.concatenate([doc[again], doc[border]]), np.concatenate([at[again] | REPEAT, at[border] | BORDER])]
    start = len(key) - int(np.argmax(fresh_key[::-1])) - 1
    return found, np.unique([start, first[-1]])


def _global(rows: DataFrame, parts: int) -> DataFrame:
    """doc, at: repeats and borders of all families; a border may come twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            x = [b.column(i).to_numpy() for i in range(5)]
            done = x[4] & 15 >= REPEAT
            if done.any():
                yield from _rows([x[3][done], x[4][done]], ["doc", "at"])
                x = [f[~done] for f in x]
            if held is not None:
                x = [np.concatenate(f) for f in zip(held, x)]
            if len(x[0]):
                found, keep = _marks(*x)
                yield from _rows(found, ["doc", "at"])
                held = [f[keep] for f in x]

    order = [x.split()[0] for x in ROWS.split(", ")]
    return rows.repartition(parts, "key").sortWithinPartitions(*order).mapInArrow(run, "doc long, at long")


def _union(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of half-open intervals."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    head = np.r_[True, lo[1:] > hi[:-1]]
    return lo[head], hi[np.r_[np.flatnonzero(head)[1:] - 1, len(hi) - 1]]


def _cut_out(data: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs, and the remaining bytes."""
    keep = (lo < len(data)) & (hi > lo)
    if not keep.any():
        return 0, 0, data
    lo, hi = _union(lo[keep], np.minimum(hi[keep], len(data)))
    parts = [data[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(data)])]
    return int((hi - lo).sum()), len(lo), b"".join(parts)


_FORMS = {"bytes": bytes, "sha256": lambda x: hashlib.sha256(x).digest(), "text": lambda x: x.decode("utf-8", "ignore").encode()}
STATE = "done boolean, doc long, n_bytes long, n_removed long, n_spans long, kept binary, gone binary, borders binary"


def _state(more: list[pa.Array], **cols) -> pa.RecordBatch:
    n = len(cols["doc"])
    types = {"done": pa.bool_(), "doc": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary(), "gone": pa.binary(), "borders": pa.binary()}
    return pa.RecordBatch.from_arrays([*(pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in types.items()), *more], names=[*types, *["row"][: len(more)]])


def _schema(rows: DataFrame) -> T.StructType:
    return T.StructType([*T.StructType.fromDDL(STATE), *(f for f in rows.schema if f.name == "row")])


def _apply(rows: DataFrame, span: int, form: str) -> DataFrame:
    """Rows of STATE from doc, text, and the document's repeats and borders:
    documents without borders are done; others wait with the places of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at_row in range(0, whole.num_rows, 256):
                b = whole.slice(at_row, 256)
                out: dict[str, list] = {c: [] for c in ("done", "doc", "n_bytes", "n_removed", "n_spans", "kept", "gone", "borders")}
                for doc, text, ats in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                    data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                    at = ats.values.to_numpy() if ats.is_valid else np.zeros(0, np.int64)
                    kind, lo, n = at & 15, at >> 12, (at >> 4 & 255) + 1
                    fixed = kind == REPEAT
                    a, z = lo[fixed], lo[fixed] + n[fixed] - 1 + span
                    border = ~fixed & (lo + n - 1 + span <= len(data))
                    if border.any():
                        start = np.unique(np.concatenate([np.arange(x, x + m) for x, m in zip(lo[border].tolist(), n[border].tolist())]))
                        row = (False, doc, len(data), None, None, data, np.stack([a, z]).tobytes(), np.stack(_runs(start)).tobytes())
                    else:
                        removed, spans, kept = _cut_out(data, a, z)
                        row = (True, doc, len(data), removed, spans, _FORMS[form](kept), None, None)
                    for c, v in zip(out, row):
                        out[c].append(v)
                yield _state(b.columns[3:], **out)

    return rows.mapInArrow(run, _schema(rows))


def _runs(start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive numbers: their first ones and lengths."""
    head = np.flatnonzero(np.r_[True, np.diff(start) != 1])
    return start[head], np.diff(np.r_[head, len(start)])


def _windows(pending: DataFrame, span: int, parts: int) -> DataFrame:
    """doc, at: windows at borders that start earlier elsewhere."""
    width = -(-span // 8) * 8
    names = ["p", "q", "doc", "at"]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def close() -> Iterator[pa.RecordBatch]:
            """Of equal windows the earliest goes on; the others are settled: dealt by place, at negative."""
            x = [np.concatenate(f) for f in zip(*waiting)]
            order = np.lexsort(x[::-1])
            x = [f[order] for f in x]
            head = np.r_[True, (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])]
            first = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
            again = ~head & ((x[2] != x[2][first]) | (x[3] != x[3][first]))
            yield from _rows([f[head] for f in x], names)
            doc, at = x[2][again], x[3][again]
            key = mix(doc.view(np.uint64)).view(np.int64)
            yield from _rows([key, key, doc, ~at], names)

        for whole in batches:
            for at_row in range(0, whole.num_rows, 64):
                for doc, data, borders in zip(*(c.to_pylist() for c in whole.slice(at_row, 64).columns)):
                    lo, m = np.frombuffer(borders, np.int64).reshape(2, -1)
                    start = np.repeat(lo - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())
                    buf = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(width, np.uint8)])
                    for i in range(0, len(start), WINDOWS // 8):
                        s = start[i : i + WINDOWS // 8]
                        rows = np.zeros((len(s), width), np.uint8)
                        _cut_rows(buf, s, np.full(len(s), span), rows)
                        waiting.append((*prints(rows), np.full(len(s), doc, np.int64), s))
                        n += len(s)
                        if n >= WINDOWS:
                            yield from close()
                            waiting, n = [], 0
        if waiting:
            yield from close()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            x = [b.column(i).to_numpy() for i in range(4)]
            done = x[3] < 0
            if done.any():
                yield from _rows([x[2][done], ~x[3][done]], ["doc", "at"])
                x = [f[~done] for f in x]
            if held is not None:
                x = [np.concatenate(f) for f in zip(held, x)]
            if len(x[0]):
                head = np.r_[True, (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])]
                first = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
                again = ~head & ((x[2] != x[2][first]) | (x[3] != x[3][first]))
                yield from _rows([x[2][again], x[3][again]], ["doc", "at"])
                held = [f[first[-1:]] for f in x]

    sent = pending.select("doc", "kept", "borders").mapInArrow(local, "p long, q long, doc long, at long")
    return sent.repartition(parts, "p").sortWithinPartitions(*names).mapInArrow(merged, "doc long, at long")


def _finish(rows: DataFrame, span: int, form: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at_row in range(0, whole.num_rows, 256):
                b = whole.slice(at_row, 256)
                out: dict[str, list] = {c: [] for c in ("done", "doc", "n_bytes", "n_removed", "n_spans", "kept")}
                for doc, data, gone, ats in zip(*(c.to_pylist() for c in b.columns[:4])):
                    a, z = np.frombuffer(gone, np.int64).reshape(2, -1)
                    s = np.array(ats or [], np.int64)
                    removed, spans, kept = _cut_out(data, np.concatenate([a, s]), np.concatenate([z, s + span]))
                    for c, v in zip(out, (True, doc, len(data), removed, spans, _FORMS[form](kept))):
                        out[c].append(v)
                yield _state(b.columns[4:], **out)

    return rows.mapInArrow(run, _schema(rows))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = 100, k: int = 48, form: str = "bytes", carry: Column | None = None) -> DataFrame:
    """doc, n_bytes, n_removed, n_spans, kept of every document, and as row what carry has there.

    kept is by form the remaining "bytes", their "sha256", or as "text" those of
    them that make whole characters; k: length of anchors."""
    if not 1 <= k < span or span - k >= 256:
        raise ValueError("k must be less than span, and by less than 256")
    more = [] if carry is None else [carry.alias("row")]
    texts = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].cast("string").alias("text"), *more)
    rest = [F.col("row")][: len(more)]
    parts = shuffle_parts(docs.sparkSession)
    marks = cut(_global(_local(texts.select("doc", "text"), span, k), parts), "marks")
    own = marks.groupBy("doc").agg(F.collect_set("at").alias("ats"))  # as many as the document's length allows
    state = cut(_apply(texts.join(own, "doc", "left").select("doc", "text", "ats", *rest), span, form), "state")
    drop(marks)
    pending = state.where("not done")
    again = cut(_windows(pending, span, parts), "again").groupBy("doc").agg(F.collect_set("at").alias("ats"))
    late = _finish(pending.select("doc", "kept", "gone", *rest).join(again, "doc", "left").select("doc", "kept", "gone", "ats", *rest), span, form)
    return state.where("done").union(late).select("doc", "n_bytes", "n_removed", "n_spans", "kept", *rest)


def digest(documents: DataFrame) -> DataFrame:
    out = remove_repeats(documents, form="sha256")
    return out.select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))
