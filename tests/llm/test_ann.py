"""One-bit codes against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import ann, queries


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0.5) for i, v in rows], "vec_id long, embedding array<float>, score double")


def brute(rows, asked, k):
    ok = {}
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    out = {}
    for q in asked:
        if q in ok:
            scored = sorted((-float((x * ok[q][0]).sum()), i) for i, xs in ok.items() if i != q for x in xs)[:k]
            out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return out


def test_estimates_and_bounds():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    index = ann.fit(x[:500], 1)
    codes, norm, own = ann.encode(x, np.zeros(2000, int), index)
    assert codes.shape == (2000, 8)
    est, bound = ann.estimate(q, codes, norm, own, index.centroids[0], index, 2.5)
    error = est - q @ x.T
    assert abs(error.mean()) < 0.1  # unbiased
    assert (np.abs(error) <= bound).mean() > 0.97
    assert np.allclose(index.rotation @ index.rotation.T, np.eye(64))


@pytest.mark.parametrize("block", [4096, 40])
def test_search_is_exact_when_all_cells_are_visited(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(12).round(2).tolist()) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(60)]  # a crowd of equal vectors
    rows += [(400, None), (401, [0.0] * 12), (402, [None] * 12), (403, [float("nan")] * 12), (404, [float("inf")] + [0.0] * 11), (405, [1.0, 2.0]), (406, [])]
    df = frame(spark, rows)
    asked = [i for i, _ in rows if i % 20 == 0]
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), cells=4, probes=4, block=block, query_block=7, eps=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    usable = [(i, v) for i, v in rows if i < 400]
    assert {q: sorted(v) for q, v in got.items()} == brute(usable, asked, 20)


def test_few_candidates_and_repeats(spark):
    df = frame(spark, [(0, [1, 0]), (20, [1, 1]), (20, [1, 1]), (7, [2, 0])])
    got = sorted(tuple(r) for r in ann.search(df.where("vec_id in (0, 7, 20)"), df.where("vec_id = 0")).collect())
    assert got == [(0, 1, 7, 2.0), (0, 2, 20, 1.0), (0, 3, 20, 1.0)]
    assert ann.search(df.limit(0), df).count() == 0
    assert ann.search(df, df.limit(0)).count() == 0
    assert ann.search(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0
    assert ann.search(frame(spark, [(0, [0, 0]), (1, None)]), df).count() == 0


def test_repeated_queries_and_small_cells(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(200)]
    rows += [rows[0]] * 25
    df = frame(spark, rows)
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), cells=60, probes=1).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert all(len(v) == 20 for v in got.values()) and len(got) == 10
    assert len(set(got[0])) == 20 and 0 not in got[0]


@pytest.mark.parametrize(("sf", "options", "least"), [("sf0.01", {"cells": 12}, 0.93), ("sf0.1", {}, 0.95)])
def test_recall(spark, sf, options, least):
    source = queries.table(spark, f"/root/testdata/{sf}", "embeddings")
    found = ann.search(source, source.where(F.col("vec_id") % 20 == 0), **options)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = source.collect()
    x, ids = np.array([r.embedding for r in rows]), np.array([r.vec_id for r in rows])
    hits = total = 0
    for q, near in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = set(ids[np.argsort(-s)[:20]].tolist())
        hits, total = hits + len(best & near), total + len(best)
    assert total == 20 * len(got) and hits / total > least
