"""Signature sniffing and archives."""

import hashlib
import random
import struct
import zlib

import pytest

from linkloom.llm import media, queries, warc


def png(data: bytes = b"\0" * 10) -> bytes:
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x21\xf9\x04\0\0\0\0\0" + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0" + b";"
JPEG = b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\0\0\1\0\1\0\0" + b"\xff\xc0\0\x0b\x08\0\1\0\1\1\1\x11\0" + b"\xff\xda\0\x08\1\1\0\0\x3f\0" + b"ab\xff\0cd\xff\xd0e" + b"\xff\xd9"
AU = b".snd" + struct.pack(">5I", 24, 4, 2, 8000, 1) + b"abcd"
MP4 = struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 12, b"moov") + b"abcd"
WEBP = b"RIFF" + struct.pack("<I", 16) + b"WEBP" + b"VP8 " + struct.pack("<I", 4) + b"abcd"
OGG = b"OggS\0\2" + b"\0" * 8 + b"abcd" + b"\0" * 8 + b"\1\3xyz"
FLAC = b"fLaC\x80" + (34).to_bytes(3, "big") + b"\0" * 34 + b"\xff\xf8data"
ITEMS = {"png": png(), "gif": GIF, "jpeg": JPEG, "au": AU, "mp4": MP4, "webp": WEBP, "ogg": OGG, "wav": media.wav_of(b"abc"), "bmp": media.bmp_of(b"x" * 192 * 3)}


def test_formats():
    for kind, item in ITEMS.items():
        assert media.sniff(item) == [(0, len(item), kind)], kind
        assert media.sniff(b"junk" + item + b"tail!") == [(4, len(item), kind)], kind
        if kind not in ("ogg", "mp4"):
            assert media.sniff(item[:-1]) == [], kind  # lengths are confirmed
    assert media.sniff(FLAC) == [(0, len(FLAC), "flac")]
    broken = bytearray(ITEMS["png"])
    broken[40] ^= 1
    assert media.sniff(bytes(broken)) == []
    both = b"--" + ITEMS["png"] + b"--" + ITEMS["wav"]
    assert [x.kind for x in media.sniff(both)] == ["png", "wav"]
    assert media.sniff(None) == [] == media.sniff(b"") == media.sniff(b"BM RIFF WAVE fLaC ftyp .snd OggS GIF89a")
    wrapped = media.wav_of(ITEMS["png"] * 2)  # what lies inside an item is not carved
    assert media.sniff(wrapped) == [(0, len(wrapped), "wav")]


def test_inspect(spark):
    df = spark.createDataFrame([(1, bytearray(ITEMS["png"]), "image/gif", "z"), (2, bytearray(GIF), "image/gif", "z"), (3, None, None, "z"), (4, bytearray(b""), "image/png", "z"), (5, bytearray(b"xx" + JPEG), None, "z")], "id int, body binary, said string, items string")
    rows = {r.id: r.media for r in media.inspect(df, "body", "said", carve=True).collect()}
    assert (rows[1].type, rows[1].declared_ok) == ("image/png", False) and (rows[2].type, rows[2].declared_ok) == ("image/gif", True)
    assert rows[3].type is None and rows[4].items == [] and rows[4].declared_ok is False
    assert rows[5].type is None and bytes(rows[5].items[0].bytes) == JPEG
    assert media.inspect(df.limit(0), "body").count() == 0


def test_digest(spark):
    texts = [None, "", "a", "é" * 96, "x" * 192, "BM GIF89a RIFF WAVE", "y" * 100_000, "\x89PNG\r\n\x1a\n"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, feature int")
    rows = {r.doc_id: r for r in media.digest(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = media.wav_of(payload) if len(payload) // 192 % 2 else media.bmp_of(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert rows[0][1:] == rows[1][1:]
    assert media.digest(df.limit(0)).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def test_archive_format():
    import zstandard

    rng = random.Random(1)
    words = [f"word{rng.randint(0, 500)}" for _ in range(300)]
    records = [warc.record(i, f"http://a/{i}", " ".join(rng.sample(words, 200)).encode(), "d", None, "1970-01-01T00:00:00Z") for i in range(60)]
    content = warc.archive(records)
    magic, size = struct.unpack_from("<II", content)
    assert magic == 0x184D2A5D
    words_dict = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(content[8 : 8 + size]))
    assert words_dict.dict_id()
    assert list(warc.records_of(content, step=100)) == records
    first = zstandard.ZstdDecompressor(dict_data=words_dict).decompressobj().decompress(content[8 + size :])
    assert first == records[0]  # each record is a frame of its own
    for some in (records[:1], records[:3], [b"x" * 50_000] * 40, [r * 100 for r in records[:20]]):  # too few or too alike to train on; long
        packed = warc.archive(some)
        assert struct.unpack_from("<I", packed)[0] == warc.DICT_FRAME and list(warc.records_of(packed)) == some
    with pytest.raises(ValueError):
        list(warc.records_of(content[:-5]))


def test_pages(spark):
    long = "p" * 150
    rows = [(5, "http://a", long), (3, None, long), (9, "x\r\ny", long), (7, "u", "short"), (8, "u", "short"), (1, "u", None), (2, "u", ""), (4, "u", "é" * 50), (6, "u", "é" * 50), (None, "u", "q" * 200), (10, "u", "q" * 200), (10, "u", "q" * 200), (11, "u", "z" * 200_000), (12, "u", "a\r\n\r\nb" * 40)]
    got = sorted((tuple(r)[:5] for r in warc.digest(pages(spark, rows)).collect()), key=repr)
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 100 and i is not None:
            first[p] = min(i, first.get(p, i))
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        of = first.get(p)
        revisit = of is not None and of != i
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", of if revisit else None))
    assert got == sorted(want, key=repr)
    import duckdb

    con = duckdb.connect()
    con.register("pages", pages(spark, rows).select("page_id", "html").toPandas().astype({"page_id": "Int64"}))
    assert sorted(con.sql(warc.ORACLE).fetchall(), key=repr) == got
    assert warc.digest(pages(spark, rows).limit(0)).count() == 0


def test_full_payloads_and_export(spark, sf_dir, tmp_path):
    source = queries.table(spark, sf_dir, "pages")
    archives = warc.write(source, archive_bytes=20_000).persist()
    assert archives.count() > 3
    back = warc.read(archives).where("record_type = 'response'").select("page_id", "payload").join(source, "page_id")
    assert back.where("cast(payload as string) = html").count() == source.count()
    warc.export(archives, str(tmp_path / "w"))
    assert len(list((tmp_path / "w").glob("*.warc.zst"))) == archives.count()
