"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
#: Rows of one block at most on average: of codes, and of queries.
CODE_BLOCK, QUERY_BLOCK = 50_000, 20_000

_by_radius: list[np.ndarray] = []


def _flips(radius: int) -> np.ndarray:
    """All numbers of WIDTH bits with ``radius`` of them set."""
    while len(_by_radius) <= radius:
        _by_radius.append(np.array([sum(1 << b for b in bits) for bits in combinations(range(WIDTH), len(_by_radius))], np.int64))
    return _by_radius[radius]


class Index:
    """Rows of distinct codes under the value of each of their segments."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes.view(np.uint64)
        self.order, self.starts = [], []
        for s in range(SEGMENTS):
            v = self.segment(self.codes, s)
            self.order.append(np.argsort(v, kind="stable"))
            self.starts.append(np.concatenate(([0], np.cumsum(np.bincount(v, minlength=1 << WIDTH)))))

    @staticmethod
    def segment(codes: np.ndarray, s: int) -> np.ndarray:
        return ((codes >> np.uint64(WIDTH * s)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)

    def search(self, query: int, k: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of all codes as near as the kth nearest row; a code counts as ``weights`` rows.

        Segments grow their radius in turn. After radius r in segments 0..s every code
        within ``SEGMENTS * r + s`` bits has been met; the search ends when that covers the kth distance.
        """
        q = np.uint64(query)
        found = np.zeros(len(self.codes), bool)
        rows, dists = [], []
        count = np.zeros(BITS + 1, np.int64)
        for r in range(WIDTH + 1):
            flips = _flips(r)
            for s in range(SEGMENTS):
                v = int(self.segment(q[None], s)[0]) ^ flips
                a, b = self.starts[s][v], self.starts[s][v + 1]
                full = b > a
                a, n = a[full], (b - a)[full]
                if len(a):
                    at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                    new = self.order[s][at]
                    new = new[~found[new]]
                    found[new] = True
                    d = np.bitwise_count(self.codes[new] ^ q).astype(np.int64)
                    rows.append(new)
                    dists.append(d)
                    count += np.bincount(d, weights=weights[new], minlength=BITS + 1).astype(np.int64)
                kth = int(np.searchsorted(np.cumsum(count), k))
                if kth <= SEGMENTS * r + s:
                    rows, dists = np.concatenate(rows), np.concatenate(dists)
                    keep = dists <= kth
                    return rows[keep], dists[keep]
        return (np.concatenate(rows), np.concatenate(dists)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def sign_code(vector: str = "embedding"):
    """Bit i of the code is 1 if component i is over 0; null and missing components count as 0."""
    return F.expr(f"aggregate(transform(slice({vector}, 1, {BITS}), (x, i) -> if(coalesce(x, 0) > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, rank, id, distance)``: of each query the ``k`` rows of ``codes`` nearest by Hamming distance, ties by id.

    ``codes`` and ``queries`` have ``id`` and ``code`` (64-bit longs; rows with a null id or
    code are left out). A query's own row is an answer like any other; repeated ids are
    rows of their own. Fewer than ``k`` rows give fewer answers. Distinct codes are
    indexed in blocks and meet the queries in blocks, each pair of blocks a group; a
    block's answers are complete for its rows, and the k nearest of all blocks remain.
    Copies of a code are searched once and carry their ``k`` smallest ids.
    """
    own = stored(codes.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")), "codes")
    # the k smallest ids of a code: first within salts, then across them
    first = lambda df, *by: df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("r") <= k).drop("r")
    ids = stored(first(first(own, "code", "salt"), "code").select("code", "id"), "ids")
    distinct = stored(ids.groupBy("code").agg(F.count("*").alias("n")), "distinct")
    asked = stored(queries.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code"), "asked")
    asked_codes = asked.select("code").distinct()
    n_codes, n_asked = distinct.count(), asked_codes.count()
    cb, qb = max(1, -(-n_codes // CODE_BLOCK), min(12, n_codes // 1000)), max(1, -(-n_asked // QUERY_BLOCK))
    left = distinct.select(F.pmod(F.xxhash64("code"), F.lit(cb)).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("q"), "code", "n")
    right = asked_codes.select(F.explode(F.sequence(F.lit(0), F.lit(cb - 1))).alias("c"), F.pmod(F.xxhash64("code"), F.lit(qb)).alias("q"), "code")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "code": np.zeros(0, np.int64), "distance": np.zeros(0, np.int32)})
        index, weights, out = Index(a["code"].to_numpy()), a["n"].to_numpy(), []
        for q in b["code"].to_numpy():
            rows, dists = index.search(int(q.view(np.uint64)), k, weights)
            out.append((np.full(len(rows), q), index.codes[rows].view(np.int64), dists.astype(np.int32)))
        return pd.DataFrame(dict(zip(("query", "code", "distance"), map(np.concatenate, zip(*out)))))

    met = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInPandas(meet, "query long, code long, distance int")
    met = stored(met, "met")
    # the kth distance of a query over all blocks bounds what is looked up
    near = met.join(ids, "code").select("query", "distance", "id")
    best = near.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "id"))), 1, k).alias("best"))
    answers = asked.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(best, "query")
    return answers.select("query_id", F.posexplode("best").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("id"), F.col("x.distance").alias("distance"))


def op6_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code().alias("code"))
    return top_k(codes, codes.where("id % 20 = 0")).withColumnRenamed("id", "vec_id")


OP6_SQL = """
WITH codes AS (
  SELECT vec_id, list_reduce(list_prepend(0::UBIGINT, list_transform(range(0, 64), lambda i: CASE WHEN coalesce(embedding[i + 1], 0) > 0 THEN (1::UBIGINT << i::UBIGINT) ELSE 0::UBIGINT END)), lambda a, b: a | b) AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(bit_count(xor(q.code, c.code)) AS INTEGER) AS distance,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.code, c.code)), c.vec_id) AS r
  FROM codes q JOIN codes c ON q.vec_id % 20 = 0)
SELECT query_id, CAST(r AS INTEGER) AS "rank", vec_id, distance FROM ranked WHERE r <= 10
"""
