"""Nearest neighbours by inner product on randomly rotated one-bit codes.

Vectors are assigned to cells around centroids.  A vector's residual from its
centroid is rotated at random and kept as the sign bit of each coordinate,
with two scalars: the residual's norm and the inner product of the residual's
direction with its own code.  They correct the code's inner product with a
query into an unbiased estimate, whose error is bounded, with a confidence
that `eps` sets, by a multiple of the spread that the second scalar leaves.

A query visits the cells whose centroids promise most.  In a cell it takes the
best estimates, scores them exactly, and then reranks every vector whose
estimate plus bound could still reach the worst of them.  Exact scores are
double-precision inner products of the original vectors.

A (cell, block) of vectors meets a (cell, block) of queries in one task; the
blocks have a bounded number of rows, so a crowded cell becomes more tasks.
Centroids come from a bounded sample; every vector is indexed.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part; equal scores go to the
smaller vec_id; rows repeated with one vec_id are all candidates, but none of
them for a query of that id; of queries with one id the one of the least vector
counts; a query visits further cells until they hold k candidates, so fewer than
k come back only where there are no more.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

PAIRS = "query_id long, vec_id long, score double"


class Index(NamedTuple):
    centroids: np.ndarray
    rotation: np.ndarray


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v: the vectors that take part."""
    v = F.col("v")
    rows = df.select(df[id_col].cast("long").alias("id"), df[vec_col].cast("array<double>").alias("v"))
    inf = F.lit(float("inf"))
    rows = rows.where(v.isNotNull() & F.col("id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(v, lambda x: x != 0))
    return rows


def fit(sample: np.ndarray, cells: int, seed: int = 7, rounds: int = 12) -> Index:
    """Centroids by k-means over the sample, and a random rotation."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    rotation, upper = np.linalg.qr(rng.standard_normal((d, d)))
    rotation *= np.sign(np.diag(upper))
    distinct = np.unique(sample, axis=0)
    cells = min(cells, len(distinct))
    c = distinct[rng.choice(len(distinct), cells, replace=False)]
    for _ in range(rounds if cells > 1 else 1):
        own = assign(sample, c)
        n = np.bincount(own, minlength=cells)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return Index(c, rotation)


def assign(x: np.ndarray, centroids: np.ndarray, step: int = 1024) -> np.ndarray:
    """Nearest centroid of each row, step rows at a time."""
    size = (centroids**2).sum(1)
    return np.concatenate([np.zeros(0, np.int64), *(np.argmin(size - 2 * (x[i : i + step] @ centroids.T), axis=1) for i in range(0, len(x), step))])


def encode(x: np.ndarray, cell: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, residual norms, and correction scalars."""
    r = (x - index.centroids[cell]) @ index.rotation
    norm = np.sqrt((r * r).sum(1))
    own = np.abs(r).sum(1) / np.maximum(norm, 1e-300) / np.sqrt(x.shape[1])
    return np.packbits(r > 0, axis=1), norm, np.where(norm > 0, own, 1.0)


def estimate(q: np.ndarray, codes: np.ndarray, norm: np.ndarray, own: np.ndarray, centroid: np.ndarray, index: Index, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of queries (rows) with coded vectors of one cell, and their error bounds."""
    d = q.shape[1]
    signs = (np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(d))
    dots = (q @ index.rotation).astype(np.float32) @ signs.T
    est = q @ centroid[:, None] + dots * (norm / own)[None, :]
    spread = norm * np.sqrt(np.maximum(1 - own**2, 0)) / own / np.sqrt(max(d - 1, 1))
    return est, eps * np.sqrt((q * q).sum(1))[:, None] * spread[None, :] + 1e-6 * (1 + np.abs(est))


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row in one fixed order of additions, so that equal vectors score alike."""
    return (x * q).sum(axis=1)


def enough_probes(sample: np.ndarray, index: Index, k: int, goal: float, asked: int = 256) -> int:
    """Cells to visit so that the share `goal` of the sample's true neighbours lies in them."""
    at = np.arange(0, len(sample), max(1, len(sample) // asked))
    q = sample[at]
    dots = q @ sample.T
    dots[np.arange(len(at)), at] = -np.inf  # itself, wherever it ranks
    near = np.argsort(-dots, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    order = np.argsort(-(q @ index.centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    own = assign(sample, index.centroids)
    ranks = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return 1 + int(ranks[int(np.ceil(goal * len(ranks))) - 1]) if len(ranks) else 1


def search_block(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, x: np.ndarray, codes: np.ndarray, norm: np.ndarray, own: np.ndarray, centroid: np.ndarray, index: Index, k: int, eps: float) -> tuple[list, list, list]:
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(q), 256):
        est, bound = estimate(q[at : at + 256], codes, norm, own, centroid, index, eps)
        for i in range(len(est)):
            e, me = est[i], qid[at + i]
            if len(e) > k + 1:
                best = np.argpartition(-e, k + 1)[: k + 2]
                best = best[vid[best] != me]
                floor = np.partition(exact(q[at + i], x[best]), len(best) - min(k, len(best)))[len(best) - min(k, len(best))] if len(best) >= k else -np.inf
                near = np.flatnonzero(e + bound[i] >= floor)
            else:
                near = np.arange(len(e))
            near = near[vid[near] != me]
            s = exact(q[at + i], x[near])
            top = np.lexsort((vid[near], -s))[:k]
            out[0].extend([me] * len(top))
            out[1].extend(vid[near][top].tolist())
            out[2].extend(s[top].tolist())
    return out


def search(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, cells: int | None = None, probes: int | None = None, sample: int = 20_000, block: int = 4096, query_block: int = 1024, eps: float = 2.5, recall: float = 0.98, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each query.

    sample: bound on the vectors that centroids are fitted on.  cells grows
    with the square root of the number of vectors unless it is given; probes
    is what the sample's own neighbours need for the share `recall` of them."""
    rows = usable(vectors, id_col, vec_col)
    sizes = sorted(rows.groupBy(F.size("v").alias("d")).count().collect(), key=lambda r: (-r["count"], r["d"]))[:1]
    spark = vectors.sparkSession
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = sizes[0]["d"], sum(r["count"] for r in sizes)
    rows = rows.where(F.size("v") == d)
    asked = usable(queries, id_col, vec_col).where(F.size("v") == d).groupBy("id").agg(F.min("v").alias("v"))
    same = rows.join(asked.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("same"))
    asked = asked.join(same, "id", "left").select("id", "v", F.coalesce("same", F.lit(0)).alias("same"))
    cells = cells or max(1, min(4096, round(n**0.5 / 4)))
    share = min(1.0, sample / n)
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("v").limit(2 * sample).toArrow()
    points = picked["v"].combine_chunks()
    points = points.values.to_numpy().reshape(-1, d) if len(points) else np.array([rows.first()["v"]])
    index = fit(points, cells, seed)
    cells = len(index.centroids)
    probes = min(cells, probes or max(4, enough_probes(points, index, k, recall)))

    @F.arrow_udf("struct<cell:int,code:binary,norm:double,own:double>")
    def coded(v: pa.Array) -> pa.Array:
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), d)
        cell = assign(x, index.centroids)
        codes, norm, own = encode(x, cell, index)
        return pa.StructArray.from_arrays([pa.array(cell.astype("i4")), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(own)], ["cell", "code", "norm", "own"])

    # written once: it is counted and then searched
    stored = "array<float>" if vectors.schema[vec_col].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    base = cut(rows.withColumn("c", coded("v")).select("id", F.col("v").cast(stored).alias("v"), "c.*"), "coded").withColumn("v", F.col("v").cast("array<double>"))
    nv = {r["cell"]: r["count"] for r in base.groupBy("cell").count().collect()}  # a row for each cell
    per_cell = np.array([nv.get(c, 0) for c in range(cells)])

    @F.arrow_udf("array<int>")
    def visited(v: pa.Array, same: pa.Array) -> pa.Array:
        q = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), d)
        own, out = same.to_numpy(zero_copy_only=False), []
        for i in range(0, len(q), 1024):
            near = np.argsort(-(q[i : i + 1024] @ index.centroids.T), axis=1, kind="stable")
            # cells until they hold k candidates besides the query's own rows
            need = 1 + (np.cumsum(per_cell[near], axis=1) < k + own[i : i + 1024, None]).sum(axis=1)
            out += [c[:n] for c, n in zip(near.astype("i4"), np.maximum(need, probes))]
        return pa.array(out, pa.list_(pa.int32()))

    asks = cut(asked.withColumn("cells", visited("v", "same")), "asked").withColumn("cell", F.explode("cells")).select("id", "v", "cell")
    nq = {r["cell"]: r["count"] for r in asks.groupBy("cell").count().collect()}
    per_v = F.array(*(F.lit(-(-nv.get(c, 0) // block)) for c in range(cells)))
    per_q = F.array(*(F.lit(-(-nq.get(c, 0) // query_block)) for c in range(cells)))
    side = lambda key, own: F.pmod(F.xxhash64("id"), F.get(own, F.col("cell"))).cast("int")
    many = lambda own: F.sequence(F.lit(0), F.get(own, F.col("cell")) - 1)
    base = base.where(F.get(per_q, F.col("cell")) > 0).withColumn("vb", side("id", per_v)).withColumn("qb", F.explode(many(per_q)))
    asks = asks.where(F.get(per_v, F.col("cell")) > 0).withColumn("qb", side("id", per_q)).withColumn("vb", F.explode(many(per_v)))

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        codes = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(left.num_rows, -1)
        found = search_block(right["id"].to_numpy(), matrix(right), left["id"].to_numpy(), matrix(left), codes, left["norm"].to_numpy(), left["own"].to_numpy(), index.centroids[key[0].as_py()], index, k, eps)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    keys = ["cell", "vb", "qb"]
    pairs = base.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(meet, PAIRS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
