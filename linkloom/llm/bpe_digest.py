"""Encoding and decoding of text columns by the transducer of `bpe`."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe

DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(col: Column, vocab: str) -> Column:
    """array<int> of token ids."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        flat = [np.frombuffer(x, "<u4").astype("i4") for x in bpe.encoder(vocab).encode(texts.to_pylist())]
        ends = np.cumsum([0, *map(len, flat)]).astype("i4")
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.zeros(0, "i4")))

    return ids(col)


def decode(col: Column, vocab: str) -> Column:
    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        merges = bpe.load(vocab)
        return pa.array(["".join(bpe.decode(merges, x)) if x is not None else None for x in ids.to_pylist()], pa.string())

    return text(col)


def digest(docs: DataFrame, vocab: str) -> DataFrame:
    """Number and digest of each text's ids, and the digest of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, merges = bpe.encoder(vocab), bpe.load(vocab)
        shown = [str(i) for i in range(len(merges.bytes_of))].__getitem__
        for b in batches:
            n, digests, decoded = [], [], []
            count, of_ids, of_text, machine = 0, hashlib.sha256(), hashlib.sha256(), bpe.Decoder(merges)
            for data, ended in enc.pieces(x.as_py() for x in b.column(1)):
                ids = np.frombuffer(data, "<u4").tolist()
                if ids:
                    of_ids.update(f"{',' if count else ''}{','.join(map(shown, ids))}".encode())
                    count += len(ids)
                of_text.update(machine.feed(ids, ended).encode("utf-8"))
                if ended:
                    n.append(count)
                    digests.append(of_ids.hexdigest())
                    decoded.append(of_text.hexdigest())
                    count, of_ids, of_text, machine = 0, hashlib.sha256(), hashlib.sha256(), bpe.Decoder(merges)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, DIGEST)
