"""Dictionary-compressed WARC archives.

`write` gives every page one record.  Of records with equal payloads of at
least `min_revisit` bytes the one with the smallest page_id is a response and
the others are revisits that name it.  Each archive is one byte string: a
skippable frame (magic 0x184D2A5D) holding a Zstandard dictionary that was
built from the archive's own records, then every record in a Zstandard frame
of its own.  An archive is closed at `archive_bytes` of uncompressed records,
which bounds what a task holds.  `read` takes archives alone and parses them.

Who is first in a group of equal payloads is found by an aggregate that
combines before its shuffle; rows meet it in a join that adaptive execution
splits where one payload is frequent.

Defined results: null html is an empty payload; a null page_id never is the
response where the group has another; repeated rows of the smallest page_id
are all responses; an empty table gives no archive.  Where Zstandard can't train
on an archive's records (too few, or too alike) its dictionary is their content.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

DICT_FRAME = 0x184D2A5D
ARCHIVES = "archive string, n_records long, content binary"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_HEAD = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """One record; first: page_id of the response it revisits."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """The fields of RECORDS; checks lengths and the payload's digest."""
    if not data.startswith(b"WARC/1.1\r\n"):
        raise ValueError("not a WARC record")
    end = data.index(b"\r\n\r\n") + 4
    head = {k.lower().decode(): v.decode("utf-8", "surrogatepass") for k, v in _HEAD.findall(data[10:end])}
    block = data[end : end + int(head["content-length"])]
    if data[end + len(block) :] != b"\r\n\r\n" or len(block) != int(head["content-length"]):
        raise ValueError("record length")
    cut_at = block.index(b"\r\n\r\n") + 4
    http = {k.lower(): v for k, v in _HEAD.findall(block[:cut_at])}
    digest, payload, size = head["warc-payload-digest"].removeprefix("sha256:"), block[cut_at:], int(http[b"content-length"])
    if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload digest")

    def page(field: str) -> int | None:
        name = head[field][len("<urn:page:") : -1] if field in head else "None"
        return None if name == "None" else int(name)

    return page("warc-record-id"), head["warc-target-uri"], size, digest, head["warc-type"], page("warc-refers-to"), payload if head["warc-type"] == "response" else None


def train(records: list[bytes], dict_bytes: int, sample_bytes: int) -> zstandard.ZstdCompressionDict:
    """A dictionary from pieces spread evenly over an archive and its records."""
    total, piece = sum(map(len, records)), 8192
    step = max(1, min(-(-total // sample_bytes), len(records) // 128))
    room = max(1, sample_bytes // (piece * -(-len(records) // step)))  # pieces of a record
    sample = []
    for r in records[::step]:
        n = min(room, -(-len(r) // piece))
        sample += [r[at : at + piece] for at in (len(r) * i // n for i in range(n))]
    size = sum(map(len, sample))
    try:
        return zstandard.train_dictionary(min(dict_bytes, max(256, size // 8)), sample, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(x[: max(256, dict_bytes // len(sample))] for x in sample)[:dict_bytes], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], dict_bytes: int = 65536, sample_bytes: int = 1 << 21, level: int = 3) -> bytes:
    words = train(records, dict_bytes, sample_bytes)
    packed = zstandard.ZstdCompressor(level=level).compress(words.as_bytes())
    words.precompute_compress(level=level)
    zc = zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=True)
    return b"".join([struct.pack("<II", DICT_FRAME, len(packed)) + packed, *map(zc.compress, records)])


def records_of(content: bytes, step: int = 65536) -> Iterator[bytes]:
    """The records of an archive, frame by frame."""
    at, words = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICT_FRAME:
        at = 8 + struct.unpack_from("<I", content, 4)[0]
        words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(content[8:at]))
    zd = zstandard.ZstdDecompressor(dict_data=words) if words is not None else zstandard.ZstdDecompressor()
    while at < len(content):
        frame, out = zd.decompressobj(), []
        while not frame.eof:
            if at >= len(content):
                raise ValueError("an archive ends within a frame")
            out.append(frame.decompress(content[at : at + step]))
            at = min(at + step, len(content))
        at -= len(frame.unused_data)
        yield b"".join(out)


def write(pages: DataFrame, *, min_revisit: int = 100, archive_bytes: int = 16 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives of all pages, as rows of ARCHIVES."""
    body = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), body.alias("html"), F.sha2(body, 256).alias("digest"))
    firsts = rows.where(F.octet_length("html") >= min_revisit).groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"))
    marked = rows.join(firsts, rows["digest"] == firsts["d"], "left").select("page_id", "url", "html", "digest", F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()), F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0
        name = f"part-{TaskContext.get().partitionId():06d}"
        schema = pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("content", pa.binary())])

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{name}-{n:05d}.warc.zst"]), pa.array([len(held)], pa.int64()), pa.array([archive(held)], pa.binary())], schema=schema)

        for b in batches:
            for page_id, url, html, digest, first in zip(*(c.to_pylist() for c in b.columns)):
                held.append(record(page_id, url, html, digest, first, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held, size, n = [], 0, n + 1
        if held:
            yield close()

    return marked.mapInArrow(run, ARCHIVES)


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for b in batches:
            for content in b.column(0):
                rows = []
                for data in records_of(content.as_py()):
                    row = parse(data)
                    rows.append(row if payloads else (*row[:-1], None))
                    if len(rows) >= 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return archives.select("content").mapInArrow(run, RECORDS)


def export(archives: DataFrame, folder: str) -> None:
    """Write archives as .warc.zst files to a folder that every executor mounts."""
    import os

    def put(rows) -> None:
        for row in rows:
            path = os.path.join(folder, row.archive)
            with open(f"{path}.tmp", "wb") as f:
                f.write(row.content)
            os.replace(f"{path}.tmp", path)

    os.makedirs(folder, exist_ok=True)
    archives.foreachPartition(put)


def digest(pages: DataFrame) -> DataFrame:
    """Write archives to the shared folder, read them back, and describe each page."""
    return read(cut(write(pages), "warc"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB SQL for digest()
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, strlen(html) AS n, CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f"""
