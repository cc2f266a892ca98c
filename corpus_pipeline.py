"""Training corpus from `documents`: toxic documents go, near copies and long
repeats go, personal data is replaced, and what is left is packed into windows.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of documents, with n_chars kept true to the text.

Defined results: null texts stay null up to packing, where they are empty;
documents without an id can't be told apart and pass both deduplications; of
rows with one id near_dedup keeps that of the least text, then of the least
digest of all columns; other columns of docs are kept; an empty table gives an
empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm import common, neardup, packing, pii, queries, suffixes
from linkloom.llm import toxicity as tox

THRESHOLD = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    prefix = "__p_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    scored = tox.score(docs, tox.fitted(docs, labels), tox.CATEGORIES, prefix=prefix)
    return scored.where(F.col(f"{prefix}toxic") < THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies."""
    (place,) = common.fresh(docs, "__place__")
    kept = neardup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*columns))
    first = docs.join(kept, "doc_id", "left_semi").withColumn(place, F.row_number().over(one)).where(F.col(place) == 1)
    return first.select(*columns).union(docs.where("doc_id is null").select(*columns))


def _with_text(docs: DataFrame, text) -> DataFrame:
    swap = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)}
    return docs.withColumns({c: x for c, x in swap.items() if c in docs.columns})


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without bytes that a 100-byte string repeats from further up."""
    row = F.struct(F.col("text").isNull().alias("null"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("of"))
    left = suffixes.remove_repeats(docs, form="text", carry=row)
    text = F.when(~F.col("row")["null"], F.col("kept").cast("string"))
    out = left.select(*(text.alias(c) if c == "text" else F.col("row")["of"][c].alias(c) for c in docs.columns))
    return _with_text(out, F.col("text"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    return pii.replace(docs, key=queries.pii_key(spark)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*(F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    return packing.pack(docs, queries.vocab_path())


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("pii", surrogates), ("packing", pack)]
ORACLE_SQL = None  # classifier, set join and packing are not for SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{common.own_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        with common.scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            common.delete(spark, f"{folder}/{before}")
        docs, before = spark.read.parquet(f"{folder}/{name}"), name
    return STAGES[-1][1](spark, docs, sf_dir)
