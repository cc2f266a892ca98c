"""Packing token pieces into training windows by Karmarkar-Karp multiway differencing.

`karmarkar_karp(sizes, k)` splits items into k parts of near-equal sum: every
item starts as a k-tuple of part sums with one part filled; again and again
the two tuples of largest spread are merged, largest part against smallest,
so that their imbalances oppose.  `pack_block` asks for as few windows as the
block's total allows, and for one more whenever a part exceeds the capacity.

`pack` streams each partition once: a document's full windows stand alone, and
its remainder is cut into units of at most `unit` tokens that wait in a block
of bounded size.  Nothing is shuffled; memory is a block of units.  A window's
id is its partition's number in the upper bits and a running number below, so
a task that runs again makes the same ids.

Defined results: a document without tokens still has its end token; repeated
rows are packed as often as they occur; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bpe

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def karmarkar_karp(sizes: list[int], k: int) -> tuple[list[int], np.ndarray]:
    """Part of each item, and the parts' sums."""
    if not sizes:
        return [], np.zeros(k, np.int64)
    # a tuple: sums ascending, less their least; members by part as linked item lists
    heap = []
    follow = [-1] * len(sizes)
    tail = list(range(len(sizes)))
    for i, s in enumerate(sizes):
        sums, head = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[-1], head[-1] = s, i
        heapq.heappush(heap, (-s, i, sums, head))
    n = len(sizes)
    while len(heap) > 1:
        _, _, a, ha = heapq.heappop(heap)
        _, _, b, hb = heapq.heappop(heap)
        b, hb = b[::-1], hb[::-1]
        sums = a + b
        for x, y in zip(*(h[(ha >= 0) & (hb >= 0)].tolist() for h in (ha, hb))):
            follow[tail[x]], tail[x] = y, tail[y]
        head = np.where(ha >= 0, ha, hb)
        order = np.argsort(sums, kind="stable")
        sums, head = sums[order], head[order]
        n += 1
        heapq.heappush(heap, (-int(sums[-1] - sums[0]), n, sums - sums[0], head))
    part = [0] * len(sizes)
    total = np.zeros(k, np.int64)
    for p, i in enumerate(heap[0][3].tolist()):
        while i >= 0:
            part[i] = p
            total[p] += sizes[i]
            i = follow[i]
    return part, total


def pack_block(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """Window of each item, and the number of windows: the least that
    differencing keeps within the capacity.  No item may exceed it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        part, total = karmarkar_karp(sizes, k)
        if not len(total) or total.max() <= capacity:
            return part, k
        k += 1


def _pack_rows(rows: Iterable[tuple[int, bytes, bool]], capacity: int, unit: int, block: int, first: int) -> Iterator[list[tuple]]:
    """rows: (doc_id, ids as bytes, whether they end the document). Yields lists of piece rows.

    Of a document only the ids that do not fill a window yet are held."""
    sequence = first
    waiting: list[tuple[int, int, int, int, int]] = []

    def flush() -> list[tuple]:
        nonlocal sequence
        part, k = pack_block([w[2] for w in waiting], capacity)
        filled, out = [0] * k, []
        for (doc, start, length, crc, total), p in zip(waiting, part):
            out.append((doc, start, length, crc, total, sequence + p, filled[p]))
            filled[p] += length
        sequence += k
        waiting.clear()
        return out

    held, at, full = b"", 0, []
    for doc, ids, ended in rows:
        held = held + ids if held else ids
        place = 0
        while len(held) - place >= 4 * capacity:
            full.append((at, zlib.crc32(held[place : place + 4 * capacity])))
            at += capacity
            place += 4 * capacity
        held = held[place:]
        if not ended:
            continue
        total = at + len(held) // 4
        if full:
            yield [(doc, start, capacity, crc, total, sequence + i, 0) for i, (start, crc) in enumerate(full)]
            sequence += len(full)
        for i in range(0, len(held), 4 * unit):
            part = held[i : i + 4 * unit]
            waiting.append((doc, at + i // 4, len(part) // 4, zlib.crc32(part), total))
        held, at, full = b"", 0, []
        if len(waiting) >= block:
            yield flush()
    if waiting:
        yield flush()


def pack(docs: DataFrame, vocab: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = 2048, unit: int = 512, block: int = 768) -> DataFrame:
    """Pieces of every document in windows of at most `capacity` tokens.

    end_id closes each document.  unit: largest piece of a remainder; block:
    number of units that are split at once."""
    if not 1 <= unit <= capacity:
        raise ValueError("unit must lie between 1 and the capacity")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(vocab)

        def rows():
            for b in batches:
                keys = iter(b.column(0).to_pylist())
                key = next(keys, None)
                for ids, ended in enc.pieces(x.as_py() for x in b.column(1)):
                    yield key, ids + end if ended else ids, ended
                    if ended:
                        key = next(keys, None)

        names = [x.split()[0] for x in PIECES.split(", ")]
        schema = pa.schema([(n, pa.int64()) for n in names])
        for out in _pack_rows(rows(), capacity, unit, block, TaskContext.get().partitionId() << 36):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, PIECES)
