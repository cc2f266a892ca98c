"""The corpus pipeline on a small folder of tables."""

import random

import pytest
from pyspark.sql import functions as F
from test_sets import brute_components, brute_repeats
from test_text import labelled
from test_tokens import check_pieces
from tokenizers import Tokenizer

import corpus_pipeline as P
from linkloom.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    docs, labels = labelled(spark, 300)
    rng = random.Random(5)
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(400 + i, texts[i] + " end", "en", "s", 1) for i in range(20)]
    passage = " ".join(f"p{rng.randint(0, 999)}" for _ in range(60))
    rows += [(500 + i, " ".join(f"q{rng.randint(0, 999)}" for _ in range(50)) + passage + f" é{i} a{i}@mail.example.com", "en", "s", 1) for i in range(8)]
    rows += [(600, None, None, None, None), (601, "", "en", "s", 0), (None, "no id", "en", "s", 5), (0, texts[0], "en", "s", len(texts[0]))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    labels.write.parquet(f"{base}/labels.parquet")
    return str(base)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, before = docs.columns, docs
    states = {}
    for name, stage in P.STAGES:
        out = stage(spark, before, folder)
        out.write.parquet(str(tmp_path / name))
        before = spark.read.parquet(str(tmp_path / name))
        states[name] = before.collect()
        if name != "packing":
            assert before.columns == names and before.schema == docs.schema
    ids = lambda name: {r.doc_id for r in states[name]}
    bad = {r.doc_id for r in docs.where("text rlike 'idiot|scum|moron'").collect()}
    assert ids("toxicity") == {r.doc_id for r in docs.collect()} - bad
    texts = {r.doc_id: r.text for r in states["toxicity"] if r.doc_id is not None}
    kept = {i for i, (_, _, k) in brute_components(texts, 5, 80).items() if k}
    assert ids("near_dedup") == kept | {None} and len(states["near_dedup"]) == len(kept) + 1
    texts = {r.doc_id: r.text for r in states["near_dedup"] if r.doc_id is not None}
    want = {i: w[3].decode("utf-8", "ignore") for i, w in brute_repeats(texts, 100).items()}
    got = {r.doc_id: r for r in states["suffix_dedup"]}
    assert {i: got[i].text or "" for i in want} == want and got[None].text == "no id" and got[600].text is None
    assert all(r.n_chars == len(r.text) for r in states["suffix_dedup"] if r.text is not None and r.doc_id is not None)
    pii = {r.doc_id: r.text for r in states["pii"]}
    assert all(f"a{i}@mail.example.com" not in pii[500 + i] and "@" in pii[500 + i] for i in range(8))
    assert pii[3] == got[3].text if 3 in pii else True
    library = Tokenizer.from_file(queries.vocab_path())
    texts = {r.doc_id: r.text for r in states["pii"]}
    check_pieces(states["packing"], texts, lambda t: library.encode(t or "", add_special_tokens=False).ids)
    assert P.run(spark, folder).count() == len(states["packing"])


def test_empty(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clashing = docs.limit(0).withColumns({c: F.lit("x") for c in ("__p_toxic", "__kept__", "kept", "c", "node", "ids")})
    for name, stage in P.STAGES:
        out = stage(spark, clashing, folder)
        assert out.count() == 0 and (name == "packing" or out.columns == clashing.columns)
