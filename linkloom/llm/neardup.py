"""Near-duplicate documents by a chosen-path set similarity join.

Documents are sets of word shingles; equal sets form one class at once.  Each
class has `T` minwise tokens.  In each of several independent trees a node
selects one or two of the T places (1 / threshold on average, by a hash of the
node alone) and sends every member to the child named by its token there.  Two
sets of similarity s stay together in s / threshold children on average, so
pairs above the threshold keep meeting while others part at every level.

* A node of at most `leaf` members is compared exhaustively, on one-bit
  sketches of 128 minwise tokens; the sketch test is set 4.5 standard
  deviations below the threshold.  In a group of copies every pair would be a
  candidate, so a member first passes on the most central of its own only.
* A larger node compares its members with its most central one.

These candidates are confirmed on whole shingle sets, at first two for each
class, which join nearly all of a component.  Then every node of more than one
candidate a member that still has members of different components is compared
whole, on the shingle sets themselves: each member outside the node's main
component with all others.  Large nodes are split into blocks, of which each
pair is a task.  Only links come out, at most one for two components and task.
In the end what candidates remain between different components are confirmed.
Only classes with a candidate have their sets read.  Components come from
alternating stars; nothing of per-document size reaches the driver.

Recall: all nodes are compared at depth `depth`, 3, large or small.  A pair at
the threshold is still together there with a probability of 0.64 per tree, so
that twelve independent trees miss 4e-6; as all draw from the same 128 tokens,
it is 2e-5 (computed over the tokens' binomial spread), less for more similar
pairs.

Defined results: null and empty texts have no shingles and are linked with
nothing; repeated rows and equal texts share a class; very long texts are read
whole; an empty table gives an empty table; a null id is never a component's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, shuffle_parts
from .components import components
from .shingles import Shingler, mix

T = 128
_U = np.uint64
_RNG = np.random.default_rng(20240501)
_XOR = _RNG.integers(0, 1 << 32, T, dtype=np.uint32)[:, None]
_MUL = (_RNG.integers(0, 1 << 31, T, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
SIGNED = "doc_id long, c long, n long, sig binary"
MET = "kind int, a long, b long, agree int"


def minwise(sets: np.ndarray) -> np.ndarray:
    """The least value of each of T permutations of a nonempty set."""
    x = (sets >> _U(32)).astype(np.uint32)
    out = np.full(T, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, ((x[None, i : i + 2048] ^ _XOR) * _MUL).min(axis=1), out=out)
    return out


def class_of(sets: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(sets.tobytes(), digest_size=8).digest(), "little", signed=True)


def sign(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, class, set size and minwise tokens (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            c, n, sig = [], [], []
            for text in b.column(1):
                s = shingler.of(text.as_py())
                n.append(len(s))
                c.append(class_of(s) if len(s) else None)
                sig.append(minwise(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "c", "n", "sig"])

    return docs.mapInArrow(run, SIGNED)


def branch(node: np.ndarray, member: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes, for members (rows of sig): node and member of each."""
    share = 1 / threshold - 1  # of nodes that select a second place
    first = mix(node ^ _U(0xA5A5A5A55A5A5A5A))
    i = (first % _U(T)).astype(np.int64)
    two = np.flatnonzero((first >> _U(11)).astype(np.float64) / 2.0**53 < share)
    j = (i[two] + 1 + (mix(first[two]) % _U(T - 1)).astype(np.int64)) % T
    at, place = np.concatenate([np.arange(len(node)), two]), np.concatenate([i, j])
    token = sig[member[at], place].astype(np.uint64)
    return mix(mix(node[at] * _U(0x9E3779B97F4A7C15) + place.astype(np.uint64) + _U(1)) ^ token), member[at]


def sketch(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = np.packbits((sig * np.uint32(0x9E3779B1)) >> np.uint32(31), axis=1).view("<i8")
    return bits[:, 0], bits[:, 1]


def descend(rows: DataFrame, threshold: float, levels: int, trees: int) -> DataFrame:
    """node, c, sketches: where members stand `levels` below the roots of `trees` trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                c = b.column("c").to_numpy()
                sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(len(c), T)
                node = np.repeat(mix(np.arange(1, trees + 1, dtype=np.uint64)), len(c))
                member = np.tile(np.arange(len(c)), trees)
                for _ in range(levels):
                    node, member = branch(node, member, sig, threshold)
                s0, s1 = sketch(sig)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(c[member]), pa.array(s0[member]), pa.array(s1[member])], names=["node", "c", "s0", "s1"])

    return rows.mapInArrow(run, "node long, c long, s0 long, s1 long")


def meet(rows: DataFrame, leaf: int, threshold: float, parts: int) -> DataFrame:
    """Rows of MET from nodes: kind 0, a candidate pair a < b and how many of
    128 bits agree; kind 1, a member b of a node a to be compared whole.

    A member gives only its most central candidate, the one nearest to what
    most members of the node have; the members of a small node that has more,
    and of any large one, come as kind 1, to meet again once it is known which
    of them lie in one component."""
    agree = _least((1 + threshold) / 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        big_node, pivot = None, None

        def out(kind: int, a: np.ndarray, b: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(k.astype(np.int32))], names=["kind", "a", "b", "agree"])

        def near(x: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Those of the row pairs i, j that are candidates, and how many bits agree."""
            ok = x[1][i] != x[1][j]
            i, j = i[ok], j[ok]
            apart = [np.bitwise_count((f[i] ^ f[j]).view(np.uint64)).astype(np.int32) for f in x[2:4]]
            same = 128 - apart[0] - apart[1]
            ok = same >= agree
            i, j, same = i[ok], j[ok], same[ok]
            return i, j, same

        def pairs(x: list[np.ndarray], i: np.ndarray, j: np.ndarray, same: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(i):
                a, b = np.minimum(x[1][i], x[1][j]), np.maximum(x[1][i], x[1][j])
                order = np.lexsort((b, a))
                a, b, same = a[order], b[order], same[order]
                new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
                yield out(0, a[new], b[new], same[new])

        def central(x: list[np.ndarray]) -> np.ndarray:
            """How many of a row's bits are those of most rows of its node."""
            starts = np.flatnonzero(np.r_[True, x[0][1:] != x[0][:-1]])
            n = np.diff(np.r_[starts, len(x[0])])
            bits = np.unpackbits(np.stack([x[2], x[3]], axis=1).view(np.uint8), axis=1)
            most = 2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int32) >= n[:, None]
            return (bits == np.repeat(most, n, axis=0)).sum(axis=1)

        def small(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """Whole nodes of at most leaf rows."""
            n = len(x[0])
            if not n:
                return
            partner, partners, met = np.full(n, -1), np.zeros(n, np.int32), np.zeros(n, bool)
            cen = central(x)
            for d in range(1, leaf):
                i = np.flatnonzero(x[0][d:] == x[0][:-d])
                if not len(i):
                    break
                i, j, _ = near(x, i, i + d)
                met[i] = met[j] = True
                up = cen[i] >= cen[j]
                for hub, own in ((i[up], j[up]), (j[~up], i[~up])):
                    partners[own] += 1
                    better = (partner[own] < 0) | (cen[hub] > cen[partner[own]])
                    partner[own[better]] = hub[better]
            rest = np.isin(x[0], np.unique(x[0][partners > 1])) & met
            if rest.any():
                yield out(1, x[0][rest], x[1][rest], np.zeros(int(rest.sum()), np.int32))
            j = np.flatnonzero(partner >= 0)
            yield from pairs(x, *near(x, partner[j], j))

        def large(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """Rows of one large node: stars around the most central ones; pivot is a row of it that came before."""
            nonlocal pivot
            at = int(np.argmax(central(x)))
            hub = [f[at : at + 1] for f in x]
            y = [np.concatenate(f) for f in zip(hub, pivot, x)]
            yield from pairs(y, *near(y, np.zeros(len(y[0]) - 1, np.int64), np.arange(1, len(y[0]))))
            pivot = hub
            yield out(1, x[0], x[1], np.zeros(len(x[0]), np.int32))

        for b in batches:
            x = [b.column(n).to_numpy() for n in ("node", "c", "s0", "s1")]
            if held is not None:
                x = [np.concatenate(f) for f in zip(held, x)]
                held = None
            while len(x[0]):
                if big_node is not None:
                    other = x[0] != big_node
                    n = int(np.argmax(other)) if other.any() else len(x[0])
                    if n:
                        yield from large([f[:n] for f in x])
                    x = [f[n:] for f in x]
                    if len(x[0]):
                        big_node = None
                    continue
                starts = np.flatnonzero(np.r_[True, x[0][1:] != x[0][:-1]])
                sizes = np.diff(np.r_[starts, len(x[0])])
                over = np.flatnonzero(sizes > leaf)
                end = int(starts[over[0]]) if len(over) else int(starts[-1])
                if end:
                    keep = np.repeat(sizes > 1, sizes)[:end]
                    yield from small([f[:end][keep] for f in x])
                if len(over):
                    big_node, pivot = x[0][end], [f[end : end + 1] for f in x]
                    x = [f[end:] for f in x]
                else:
                    held = [f[end:] for f in x]
                    break
        if held is not None:
            yield from small(held)

    return rows.repartition(parts, "node").sortWithinPartitions("node", "c").mapInArrow(run, MET)


def _least(p: float) -> int:
    """4.5 standard deviations below the mean of T trials of chance p."""
    return int(T * p - 4.5 * (T * p * (1 - p)) ** 0.5)


def links_within(c: np.ndarray, comp: np.ndarray, sets: np.ndarray, ends: np.ndarray, threshold: int, room: int = 1 << 22) -> list[tuple[int, int]]:
    """Links that join components of one group as comparing all its pairs would:
    classes, their components, their sets one after another, and where these end."""
    n, sizes = len(c), np.diff(np.r_[0, ends])
    kinds, own = np.unique(comp, return_inverse=True)
    up = list(range(len(kinds)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    main = int(np.argmax(np.bincount(own)))
    minor = np.flatnonzero(own != main)
    if not len(minor):
        return []
    # shingles of one row only are nobody's; those of many rows are counted by a matrix product, others by their lists
    _, token, many = np.unique(sets, return_inverse=True, return_counts=True)
    order = np.argsort(token, kind="stable")
    row = np.repeat(np.arange(n), sizes)
    lists, start = row[order], np.cumsum(many) - many
    dense = (many > 1) & (many > n // 8)
    place = np.cumsum(dense) - 1
    often = dense[token]
    matrix = np.zeros((n, int(dense.sum())), np.float32)
    matrix[row[often], place[token[often]]] = 1
    rare = ~often & (many[token] > 1)
    cost = np.bincount(row[rare], weights=many[token[rare]], minlength=n).astype(np.int64) + n
    out, at = [], 0
    while at < len(minor):
        end = at + max(1, int(np.searchsorted(np.cumsum(cost[minor[at:]]), room, side="right")))
        mine, at = minor[at:end], end
        now = np.array([find(k) for k in range(len(up))])[own]
        mine = mine[now[mine] != find(main)]  # others meet these when it is their turn
        if not len(mine):
            continue
        both = np.rint(matrix[mine] @ matrix.T).astype(np.int64)
        t = [np.arange(ends[r] - sizes[r], ends[r])[rare[ends[r] - sizes[r] : ends[r]]] for r in mine]
        which, t = np.repeat(np.arange(len(mine)), [len(x) for x in t]), token[np.concatenate(t)]
        if len(t):
            long = many[t]
            entry = np.repeat(start[t] - np.cumsum(long) + long, long) + np.arange(int(long.sum()))
            both += np.bincount(np.repeat(which, long) * n + lists[entry], minlength=both.size).reshape(both.shape)
        i, j = np.nonzero((100 * both >= threshold * (sizes[mine][:, None] + sizes[None] - both)) & (now[mine][:, None] != now[None]))
        i = mine[i]
        _, one = np.unique(np.minimum(now[i], now[j]) * len(up) + np.maximum(now[i], now[j]), return_index=True)
        for a, b in zip(i[one].tolist(), j[one].tolist()):
            x, y = find(int(own[a])), find(int(own[b]))
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((int(min(c[a], c[b])), int(max(c[a], c[b]))))
    return out


def whole(rows: DataFrame, sets: DataFrame, threshold: int, parts: int, block_rows: int = 4096, block_shingles: int = 1 << 20) -> DataFrame:
    """a, b: links between the components that share a node, of rows node, c, comp, n
    (the set's size).  All pairs of a node are compared; the pairs of blocks of a
    node that exceeds a block are groups of their own."""
    sized = rows.groupBy(F.col("node").alias("m")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("r"), F.sum("n").alias("t")).where("lo != hi")
    blocks = F.greatest(F.ceil(F.col("r") / block_rows), F.ceil(F.col("t") / block_shingles)).cast("int")
    rows = rows.join(sized.select("m", blocks.alias("k")), rows["node"] == F.col("m")).withColumn("i", F.pmod(F.xxhash64("c"), F.col("k")).cast("int"))
    # two blocks that meet compare their own rows too
    rows = rows.withColumn("j", F.explode(F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda j: j != F.col("i")))))
    rows = rows.select(F.xxhash64("node", F.least("i", "j"), F.greatest("i", "j")).alias("node"), "c", "comp").join(sets, "c").select("node", "c", "comp", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                s = t["s"].combine_chunks()
                found = links_within(t["c"].to_numpy(), t["comp"].to_numpy(), s.flatten().to_numpy(), np.cumsum(s.value_lengths().to_numpy()), threshold)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])
                held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("node").to_numpy()
            cuts = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
            for lo, hi in zip(cuts, cuts[1:]):
                if x[lo] != node:
                    yield from close()
                    node = x[lo]
                held.append(b.slice(lo, hi - lo))
        yield from close()

    return rows.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """a, b of the pairs whose sets have 100 * intersection >= threshold * union."""
    one, two = sets.select(F.col("c").alias("a"), F.col("s").alias("x")), sets.select(F.col("c").alias("b"), F.col("s").alias("y"))
    sized = pairs.join(one, "a").join(two, "b")
    na, nb = F.size("x").cast("long"), F.size("y").cast("long")
    sized = sized.where((100 * na >= threshold * nb) & (100 * nb >= threshold * na))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    return sized.where(100 * both >= threshold * (na + nb - both)).select("a", "b")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: int = 80, trees: int = 12, depth: int = 3, leaf: int = 48) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; threshold in percent."""
    share = threshold / 100
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    parts = shuffle_parts(docs.sparkSession)
    signed = cut(sign(texts, words), "signed")
    classes = signed.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    classes = cut(classes, "classes")
    met = cut(meet(descend(classes.select("c", "sig"), share, depth, trees), leaf, share, parts), "met")
    pairs = met.where("kind = 0").select("a", "b", "agree")
    nodes = met.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("c"))

    wanted = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).union(nodes.select("c")).distinct()
    wanted = wanted.join(classes.select("c", "doc_id"), "c").where("doc_id is not null")
    sets = cut(_sets(texts.join(wanted, "doc_id").select("c", "text"), words), "sets")

    def best(p: DataFrame) -> DataFrame:
        """At most two pairs for each class: its likest partner, and its least."""
        ends = p.union(p.select("b", "a", "agree")).groupBy("a").agg(F.min("b").alias("low"), F.max_by("b", F.struct("agree", "b")).alias("like"))
        return ends.select("a", F.explode(F.array("low", "like")).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def apart(p: DataFrame) -> DataFrame:
        """Pairs whose classes lie in different components so far."""
        k = comp.select(F.col("node").alias("k"), F.col("comp").alias("v"))
        p = p.join(k, p["a"] == k["k"], "left").select("a", "b", "agree", F.coalesce("v", "a").alias("ca"))
        return p.join(k, p["b"] == k["k"], "left").where(F.coalesce("v", "b") != F.col("ca")).select("a", "b", "agree")

    rows, signed = signed, cut(signed.select("doc_id", "n", "c"), "own")
    drop(rows)
    links = cut(confirm(best(pairs), sets, threshold), "links")
    comp = cut(components(links), "comp")
    placed = nodes.join(comp, nodes["c"] == comp["node"], "left").select(nodes["node"], "c", F.coalesce("comp", "c").alias("comp")).join(classes.select("c", "n"), "c")
    found = cut(whole(placed, sets, threshold, parts), "links")
    if not found.isEmpty():
        links, first = links.union(found), comp
        comp = cut(components(links), "comp")
        drop(first)
    rest = cut(confirm(apart(pairs.groupBy("a", "b").agg(F.max("agree").alias("agree"))).select("a", "b"), sets, threshold), "links")
    if not rest.isEmpty():
        first = comp
        comp = cut(components(links.union(rest)), "comp")
        drop(first)
    drop(classes, met, sets, links, rest)
    own = signed.select("doc_id", "n", "c").join(comp.select(F.col("node").alias("c"), "comp"), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    low = own.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("low"))
    out = own.join(low, "comp", "left")
    component = F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """c, s: the shingle set of each wanted class, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                c, s = [], []
                for key, text in zip(b.column(0).slice(at, 256).to_pylist(), b.column(1).slice(at, 256).to_pylist()):
                    x = shingler.of(text)
                    if len(x) and class_of(x) == key:  # an id may be on several rows
                        c.append(key)
                        s.append(x.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(s, pa.list_(pa.int64()))], names=["c", "s"])

    return rows.mapInArrow(run, "c long, s array<long>").dropDuplicates(["c"])
