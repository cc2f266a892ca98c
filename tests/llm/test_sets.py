"""Near duplicates and repeated byte strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from linkloom.llm import neardup, suffixes
from linkloom.llm.components import components
from linkloom.llm.shingles import Shingler


def brute_components(texts: dict, words: int, threshold: int):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed: int, n: int = 150) -> dict[int, str | None]:
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts: list = [" ".join(rng.choice(vocab) for _ in range(rng.randint(20, 90))) for _ in range(n)]
    for _ in range(n):  # near copies, chains of them, exact copies
        words = rng.choice(texts).split(" ")
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        texts.append(" ".join(words))
    texts += [None, "", "   ", "one", "ONE", "one two", "One\ttwo ", "É one", "é one", "x " * 3000]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 0, 0.5) for i, t in texts.items()], "doc_id long, text string, c int, n double")


@pytest.mark.parametrize(("words", "leaf"), [(2, 48), (5, 48), (2, 4)])
def test_near_duplicates(spark, words, leaf):
    texts = corpus(words)
    got = neardup.near_duplicates(frame(spark, texts), words=words, leaf=leaf).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute_components(texts, words, 80)


def test_a_large_group(spark):
    """A group of near copies far beyond a leaf, with an outlier that only one of them reaches."""
    rng = random.Random(8)
    base = [f"v{i}" for i in range(100)]
    texts = {}
    for i in range(260):
        words = list(base)
        words[rng.randrange(100)] = f"x{i}"
        texts[i] = " ".join(words)
    words = texts[17].split(" ")
    for j in (10, 30, 50, 70, 90):
        words[j] = f"y{j}"
    texts[300] = " ".join(words)
    texts[301] = "nothing like the others at all"
    got = neardup.near_duplicates(frame(spark, texts), words=2, leaf=16).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute_components(texts, 2, 80)


@pytest.mark.parametrize("block", [4096, 16])
def test_large_nodes_are_compared_whole(spark, block):
    """All pairs of a node that comes in many batches and blocks, the first rows' among themselves too."""
    sets = [(c, [1000 * (c // 2) + i for i in range(20 + c % 2)] + list(range(-100 * (c % 7), 0, 100))) for c in range(60)]
    df = spark.createDataFrame([(1, c, c, len(s)) for c, s in sets], "node long, c long, comp long, n long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        got = {(r.a, r.b) for r in neardup.whole(df, spark.createDataFrame(sets, "c long, s array<long>"), 80, 2, block_rows=block).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(a, b) for a, x in sets for b, y in sets if a < b and 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y))} and len(got) > 20


def test_pairs_at_the_threshold_in_a_large_group(spark):
    """Many pairs of 0.8 whose members are 0.68 like all others."""
    core, texts = [f"c{i}" for i in range(80)], {}
    for i in range(400):
        texts[i] = " ".join(core + [f"p{i // 2}_{j}" for j in range(8)] + [f"u{i}_{j}" for j in range(11)])
    got = neardup.near_duplicates(frame(spark, texts), words=1, leaf=8).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute_components(texts, 1, 80)


def test_near_duplicate_edges(spark):
    empty = neardup.near_duplicates(frame(spark, {0: "a"}).limit(0))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "kept"] and empty.count() == 0
    rows = [(4, "a b c"), (4, "a b c"), (None, "a b c"), (2, "a b c"), (9, None), (None, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(4, 2, 2, False), (4, 2, 2, False), (None, 2, 2, False), (2, 2, 2, True), (9, 0, 9, True), (None, 0, None, True)]))


def test_sketches_estimate():
    s = Shingler(1)
    a, b = s.of(" ".join(f"a{i}" for i in range(900))), s.of(" ".join(f"a{i}" for i in range(100, 1000)))
    agree = (neardup.minwise(a) == neardup.minwise(b)).mean()
    assert abs(agree - 0.8) < 0.15


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {x: c for x, c in up.items() if any(a != b and x in (a, b) for a, b in edges)}


def brute_repeats(texts: dict, span: int):
    seen, out = set(), {}
    for i in sorted(texts):
        d = (texts[i] or "").encode("utf-8", "surrogatepass")
        gone = bytearray(len(d))
        for s in range(len(d) - span + 1):
            w = d[s : s + span]
            if w in seen:
                gone[s : s + span] = b"\1" * span
            else:
                seen.add(w)
        spans = sum(1 for j in range(len(d)) if gone[j] and (not j or not gone[j - 1]))
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out[i] = (len(d), sum(gone), spans, kept)
    return out


def passages(seed: int) -> dict[int, str | None]:
    rng = random.Random(seed)
    syllables = "the tion er and ou ing é ß ".split(" ")
    prose = lambda n: "".join(rng.choice(syllables) + rng.choice(["", " "]) for _ in range(n))
    shared = [prose(rng.randint(30, 200)) for _ in range(6)]
    texts: list = []
    for _ in range(60):
        parts = [prose(rng.randint(0, 120)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            piece = rng.choice(shared)
            lo = rng.randint(0, len(piece) // 2)
            parts.insert(rng.randint(0, 3), piece[lo : lo + rng.randint(60, len(piece))])
        texts.append("".join(parts))
    texts += [texts[3], texts[3], None, "", "a" * 99, "a" * 100, "a" * 101, "a" * 400, "ab" * 300, texts[5][:-1] + "!", "é" * 300]
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize(("span", "k"), [(100, 48), (100, 16), (40, 20)])
def test_repeats(spark, span, k):
    texts = passages(span + k)
    df = frame(spark, texts).repartition(5, "doc_id")
    want = brute_repeats(texts, span)
    got = {r.doc: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(df, span=span, k=k).collect()}
    assert got == want
    if span == 100:
        digests = {r.doc_id: r.kept_sha256 for r in suffixes.digest(df).collect()}
        assert digests == {i: hashlib.sha256(w[3]).hexdigest() for i, w in want.items()}
        as_text = {r.doc: bytes(r.kept) for r in suffixes.remove_repeats(df, form="text").collect()}
        assert as_text == {i: w[3].decode("utf-8", "ignore").encode() for i, w in want.items()}


def test_long_documents_come_in_pieces(spark, monkeypatch):
    texts = passages(9)
    texts[500] = "".join(t or "" for t in texts.values()) * 2
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    family, marks = suffixes.Family(), []
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(list(texts)), pa.array(list(texts.values()))], names=["doc", "text"])
    for buf, row, ids, offs in suffixes._chunks(iter([batch]), 100):
        _, _, lo, hi = suffixes.stretches(buf, row, 100, 48)
        begin = np.searchsorted(row, np.arange(len(ids)))[row[lo]]
        for d, a, n in zip(ids[row[lo]], lo - begin + offs[row[lo]], hi - lo + 1):
            marks += [(int(d), int(x)) for x in range(a, a + n)]
    assert sorted(marks) == [(i, s) for i in sorted(texts) for s in range(len((texts[i] or "").encode()) - 99)]
    assert not family.finish()[0][0].size


def test_a_long_text_and_many_families(spark, monkeypatch):
    """A text of several pieces through Spark, and families closed early."""
    rng = random.Random(6)
    words = ["the", "tion", "er", "and", "ou", "é"]
    long = "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(420_000))
    texts = dict(enumerate([long[900_000:900_400], long[:300], long + long[5:105], "x" + long[700_000:700_150]]))
    seen, want = {}, {}
    data = {i: t.encode() for i, t in texts.items()}
    for i in texts:  # brute force by window digests: the texts are long
        gone = np.zeros(len(data[i]), bool)
        for s in range(len(data[i]) - 99):
            w = data[i][s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            else:
                seen[w] = True
        want[i] = (len(gone), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), bytes(np.frombuffer(data[i], np.uint8)[~gone]))
    got = {r.doc: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(frame(spark, texts), form="bytes").collect()}
    assert len(data[2]) > suffixes.CHUNK and got == want

    import pyarrow as pa

    some = passages(11)
    monkeypatch.setattr(suffixes, "BATCH", 40)
    monkeypatch.setattr(suffixes, "ROOM", 100)
    monkeypatch.setattr(suffixes, "CHUNK", 2000)
    family, closed = suffixes.Family(), 0
    batch = pa.RecordBatch.from_arrays([pa.array(list(some)), pa.array(list(some.values()))], names=["doc", "text"])
    for buf, row, ids, offs in suffixes._chunks(iter([batch]), 100):
        anchor, entry, lo, hi = suffixes.stretches(buf, row, 100, 48)
        family.add(entry, ids[row[lo]], lo << 12, anchor)
        assert all((level[0][1:] > level[0][:-1]).all() for level in family.levels)  # alphabetical, none twice
        if len(family) >= suffixes.ROOM:
            closed += sum(1 for _ in suffixes._passed_on(family, 48)) > 0
            family = suffixes.Family()
    assert closed > 3


def test_longest_common_prefixes():
    a, b = np.array([b"abcd\1", b"abXd\1", b"\0\0\0\0\1"]), np.array([b"abcd\1", b"abcd\1", b"\0\0\1\0\1"])
    assert suffixes.lcp(a, b).tolist() == [5, 2, 2]


def test_repeat_edges(spark):
    df = frame(spark, {0: "a"})
    assert suffixes.digest(df.limit(0)).count() == 0
    same = "q" * 30 + "".join(map(str, range(60)))
    rows = [(1, same), (1, same), (None, same), (2, same), (None, None)]
    got = sorted(map(repr, (tuple(r)[:4] for r in suffixes.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    n = len(same)
    assert got == sorted(map(repr, [(1, n, 0, 0), (1, n, 0, 0), (None, n, 0, 0), (2, n, n, 1), (None, 0, 0, 0)]))
    with pytest.raises(ValueError):
        suffixes.remove_repeats(df, span=10, k=10)


def test_family_is_logarithmic():
    rng = np.random.default_rng(1)
    family = suffixes.Family()
    keys = rng.integers(0, 3000, 6400).astype(np.uint64)
    for i in range(64):
        k = keys[i * 100 : (i + 1) * 100]
        family.add(k, np.full(100, 63 - i, np.int64), np.arange(100), k)
        sizes = [len(x[0]) for x in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:])) and len(sizes) <= 8
    kept, repeats = family.finish()
    assert sorted(kept[0]) == sorted(set(keys.tolist())) and len(kept[0]) + len(repeats[0]) == len(keys)
    last = {}
    for i, k in enumerate(keys.tolist()):
        last.setdefault(k, []).append((63 - i // 100, i % 100))
    assert all(min(last[k]) == (d, a) for k, d, a in zip(kept[0].tolist(), kept[1].tolist(), kept[2].tolist()))
