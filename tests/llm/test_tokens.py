"""Transducer, its digest query, and the packer."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from linkloom.llm import bpe, bpe_digest, packing, queries

PATH = queries.vocab_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


ODD = ["", " ", "  a  b\n\n c", " x", "x ", "\n", "a b", " \n \n x<|endoftext|>y  <|endoftext|>", "<|endoftext|>", "<|endof", "日本語テキスト 😀👍🏽‍", "'s 's'll don't we'", " " * 700 + "x", "\t" * 900, "ab" * 700, "é" * 900, "\x00 \x00", "1" * 900 + " " + "!?" * 400, "a  b", "x\n y \n", "ſ's ''s", "Ⅷ²³ ٣٤", "word " * 50]


def test_encoder_equals_library(library):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(" \n\t'abst12.é,日<|") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    enc = bpe.Encoder(bpe.load(PATH), memo=50)  # a memo this small is cleared all the time
    for text, ids in zip(texts, enc.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:50]
        assert enc.stream(text) == ids
        assert "".join(bpe.decode(bpe.load(PATH), want, step=3)) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60), st.integers(1, 7))
def test_any_chunks(library, text, step):
    t = bpe.Transducer(bpe.load(PATH), window=16)
    ids = [i for at in range(0, len(text), step) for i in t.feed(text[at : at + step])] + list(t.feed("", True))
    assert ids == library.encode(text, add_special_tokens=False).ids


def test_memory_is_a_window(library):
    merges = bpe.load(PATH)
    assert 1 < merges.lookahead < 1000
    rng = random.Random(1)
    text = "".join(rng.choice("thetionerandouing") for _ in range(9000))  # one pretoken
    t = bpe.Transducer(merges)
    ids = []
    for at in range(0, len(text), 500):
        ids += t.feed(text[at : at + 500])
    assert len(ids) > 2000  # most came before the end
    ids += t.feed("", True)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert t.run.peak <= 1024 + 2 * merges.lookahead


def test_memory_of_a_long_text(library):
    """Beyond the text itself, encoding it holds a chunk's worth."""
    import tracemalloc

    rng = random.Random(2)
    words = [rng.choice(["the", "of", "blethe", "thtion", "12,", "é", "a\n\nb"]) + str(rng.randint(0, 200)) for _ in range(3000)]
    text = " ".join(words) + " "
    enc = bpe.Encoder(bpe.load(PATH), chunk=1 << 15)
    peaks = []
    for times in (40, 160):
        long = text * times
        tracemalloc.start()
        n = sum(len(ids) // 4 for ids, _ in enc.pieces([long]))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        if times == 40:
            assert n == len(library.encode(long, add_special_tokens=False).ids)
    assert len(text) * 160 > 3_000_000 and peaks[1] < 1.2 * peaks[0] + 100_000 and peaks[1] < 3_000_000


def test_invalid_bytes_decode(library):
    merges = bpe.load(PATH)
    for data in (b"\xe2\x82", b"a\xffb", b"\xf0\x9f\x98", b"\xc3\x28", b"\xed\xa0\x80"):
        ids = [int(merges.base[x]) for x in data]
        assert "".join(bpe.decode(merges, ids)) == data.decode("utf-8", "replace")


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


def test_digest(spark, library):
    texts = [*ODD, None, "b" * 3000 + " c"]
    got = {r.doc_id: r for r in bpe_digest.digest(docs_of(spark, texts), PATH).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert tuple(got[i])[1:] == want
    assert bpe_digest.digest(docs_of(spark, texts).limit(0), PATH).count() == 0
    from pyspark.sql import functions as F

    df = docs_of(spark, ["a b", None]).withColumn("ids", bpe_digest.encode(F.col("text"), PATH)).withColumn("back", bpe_digest.decode(F.col("ids"), PATH))
    assert [r.back for r in df.orderBy("doc_id").collect()] == ["a b", ""]


def test_karmarkar_karp():
    rng = random.Random(2)
    for _ in range(30):
        sizes = [rng.randint(1, 500) for _ in range(rng.randint(1, 80))]
        k = rng.randint(1, 12)
        part, total = packing.karmarkar_karp(sizes, k)
        assert [sum(s for s, p in zip(sizes, part) if p == i) for i in range(k)] == total.tolist()
    assert packing.karmarkar_karp([8, 7, 6, 5, 4], 2)[1].tolist() == [14, 16]
    part, total = packing.karmarkar_karp([rng.randint(100, 500) for _ in range(600)], 90)
    assert total.max() - total.min() < 60
    # capacity: three items of 6 can't share two windows of 10
    assert packing.pack_block([6, 6, 6], 10)[1] == 3


def check_pieces(rows, texts, ids_of, capacity=2048):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in texts.items():
        ids, at = ids_of(t) + [1], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return sum(capacity - sum(r.length for r in rs) for rs in by_seq.values()), len(by_seq)


def test_pack(spark, library):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "of", "blethe", "thtion"]) for _ in range(rng.choice([1, 30, 300, 3000]))) for _ in range(150)] + [None, ""]
    rows = packing.pack(docs_of(spark, texts), PATH).collect()
    padding, windows = check_pieces(rows, dict(enumerate(texts)), lambda t: library.encode(t or "", add_special_tokens=False).ids)
    assert padding < 0.05 * windows * 2048
    assert packing.pack(docs_of(spark, texts).limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs_of(spark, texts), PATH, unit=4096)
