"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Fit: on a bounded sample, several PCA + ITQ rotations (alternating sign codes and orthogonal Procrustes) give
``bits`` signs per vector. The sample also tells how far beyond its k-th nearest code a query's true neighbours lie:
``margin`` is the quantile WITHIN of that.

Search: codes split into 16-bit substrings and each substring has its own index from value to rows. A code
within radius r of the query agrees with it in some substring to within floor(r / m) bits, so probing every
bucket at that distance in each of the m indexes retrieves every code within the radius. Each query has a radius of
its own: it starts at the distance that one query in ten needs in the sample, widens by a sixteenth of the code until k
codes lie within it, and then becomes the k-th code's distance plus the margin. What it holds is reranked by Euclidean
distance on the original vectors in double precision. Queries near others so probe few buckets; where vectors
are spread evenly no radius is small, and a query's probes reach most rows (``reached`` measures the share).

Rows are dealt into index blocks and queries into query blocks of bounded size; a task holds one of each and
returns the k best per query, and the best of all blocks are merged. Every row is indexed. At most k + 1 ids
of equal vectors can be among a query's k nearest, so only the k + 1 smallest ids of a vector are searched.

Defined results: vectors that are null, zero, hold null or non-finite components or differ in length from
most others take no part, neither do rows without id; ties go to the smaller id; rows equal in id and vector are one
row, and those equal in id alone are rows of their own; a query skips all rows of its own id; queries equal in id alone
are queries of their own, each with its k nearest under the shared id; no other vectors gives no rows; an empty table
gives none; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import parallelism, table

BITS = 256
SUB = 16
#: Rows the rotation and margin are learned from at most; quantile of neighbours that must lie in the margin.
SAMPLE, WITHIN = 8_000, 0.98
INDEX_BLOCK, QUERY_BLOCK = 16_384, 2_048
K = 10


def learn(x: np.ndarray, bits: int = BITS, k: int = K, rounds: int = 25, seed: int = 1) -> dict:
    """Mean, rotations, first radius and margin from sample vectors (n, d)."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    mean = x.mean(axis=0)
    c = x - mean
    axes = np.linalg.eigh(c.T @ c / n)[1][:, ::-1]
    v = c @ axes
    turns = []
    for _ in range(-(-bits // d)):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(v.T @ np.where(v @ r >= 0, 1.0, -1.0))
            r = u @ w
        turns.append(axes @ r)
    model = {"mean": mean, "turn": np.concatenate(turns, axis=1)[:, :bits], "start": bits, "margin": 0}
    if n > 2 * k:
        codes = encode(model, x)
        kth, beyond = [], []
        for i in range(0, n, max(1, n // 512)):
            apart = np.bitwise_count(codes ^ codes[i]).sum(axis=1, dtype=np.int64)
            apart[i] = bits + 1
            dist = np.einsum("ij,ij->i", x - x[i], x - x[i])
            dist[i] = np.inf
            kth.append(int(np.partition(apart, k - 1)[k - 1]))
            beyond.append(apart[np.argpartition(dist, k)[:k]] - kth[-1])
        model["start"] = int(np.quantile(kth, 0.1))
        model["margin"] = max(0, int(np.quantile(np.concatenate(beyond), WITHIN)))
    return model


def encode(model: dict, x: np.ndarray) -> np.ndarray:
    """Codes as (n, bits / 16) 16-bit substrings."""
    signs = (x - model["mean"]) @ model["turn"] >= 0
    return np.packbits(signs, axis=1, bitorder="little").view("<u2")


class Index:
    """One table per substring, from value to the rows that hold it."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            values, first, bucket = np.unique(codes[order, j], return_index=True, return_inverse=True)
            of = np.empty(len(order), dtype=np.int32)
            of[order] = bucket
            self.tables.append((values, np.append(first, len(order)), order, of))

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows in the buckets that pigeonhole probing opens for the radius."""
        step = radius // len(self.tables)
        seen = np.zeros(len(self.codes), dtype=bool)
        for j, (values, first, order, of) in enumerate(self.tables):
            hit = np.bitwise_count(values ^ code[j]) <= step
            few = np.flatnonzero(hit)
            if len(few) > 32:  # many buckets: by each row's bucket
                seen |= hit[of]
            else:
                for b in few:
                    seen[order[first[b] : first[b + 1]]] = True
        return np.flatnonzero(seen)

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All rows whose code lies within the radius, and how far each is off."""
        rows = self.probed(code, radius)
        apart = np.bitwise_count(self.codes[rows] ^ code).sum(axis=1, dtype=np.int64)
        near = apart <= radius
        return rows[near], apart[near]

    def nearest(self, code: np.ndarray, k: int, model: dict, skip: np.ndarray) -> np.ndarray:
        """Rows to rerank: those within the k-th code's distance and the margin; rows marked in ``skip`` don't count."""
        width = 16 * self.codes.shape[1]
        radius = min(model["start"], width)
        while True:
            rows, apart = self.within(code, radius)
            rows, apart = rows[~skip[rows]], apart[~skip[rows]]
            if len(rows) >= k or radius >= width:
                break
            radius = min(width, radius + width // 16)
        if len(rows) < k:
            return rows
        goal = min(width, int(np.partition(apart, k - 1)[k - 1]) + model["margin"])
        if goal > radius:
            rows, apart = self.within(code, goal)
            return rows[~skip[rows]]
        return rows[apart <= goal]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col(vec_col)
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & ok)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0].n if sizes else 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS, sample: int = SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for each query row."""
    spark = vectors.sparkSession
    rows, asked = usable(vectors, id_col, vec_col).distinct(), usable(queries, id_col, vec_col).distinct()
    # tells queries of one id apart: the place of each among them
    asked = asked.withColumn("nth", F.row_number().over(W.partitionBy("vec_id").orderBy("v")))
    n = rows.count()
    schema = "query_id long, nth int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # The first by hash, from a range of hashes that holds about twice as many: tasks then send few rows that others beat.
    h = F.xxhash64("vec_id")
    near = rows.filter(h <= F.lit(min((1 << 63) - 1, (2 * sample << 64) // n - (1 << 63))))
    drawn = near.orderBy(h, "vec_id").limit(sample).collect() or rows.orderBy(h, "vec_id").limit(sample).collect()
    model = learn(np.array([r.v for r in drawn], dtype=float), bits, k)
    index_blocks = max(1, -(-n // INDEX_BLOCK))
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    first = W.partitionBy("v").orderBy("vec_id")
    kept = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1).drop("n")
    left = kept.withColumn("ib", F.pmod(F.xxhash64("vec_id", "v"), F.lit(index_blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    right = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(query_blocks))).withColumn("ib", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(index_blocks - 1).cast("long"))))

    def run(key, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(asked):
            ids, x = rows.vec_id.to_numpy(), np.stack(rows.v.to_numpy()).astype(float)
            index = Index(encode(model, x))
            qx = np.stack(asked.v.to_numpy()).astype(float)
            for q, nth, y, code in zip(asked.vec_id.to_numpy(), asked.nth.tolist(), qx, encode(model, qx), strict=True):
                got = index.nearest(code, k, model, ids == q)
                gap = x[got] - y
                dist = np.sqrt((gap * gap).sum(axis=1))
                best = np.lexsort((ids[got], dist))[:k]
                out += zip([int(q)] * len(best), [nth] * len(best), ids[got][best].tolist(), dist[best].tolist(), strict=True)
        return pd.DataFrame(out, columns=["query_id", "nth", "vec_id", "score"]).astype({"query_id": "int64", "nth": "int32", "vec_id": "int64", "score": "float64"})

    found = left.groupBy("ib", "qb").cogroup(right.groupBy("ib", "qb")).applyInPandas(run, schema)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "nth").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def reached(model: dict, x: np.ndarray, queries: np.ndarray, k: int = K) -> float:
    """The share of rows that probing opens, on average over some rows as queries."""
    codes = encode(model, x)
    index, none = Index(codes), np.zeros(len(x), dtype=bool)
    share = []
    for q in queries:
        rows = index.nearest(codes[q], k, model, none)
        radius = int(np.bitwise_count(codes[rows] ^ codes[q]).sum(axis=1).max())
        share.append(len(index.probed(codes[q], radius)) / len(x))
    return float(np.mean(share))


def op1_mih(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 100 = 0"))
