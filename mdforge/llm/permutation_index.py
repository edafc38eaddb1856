"""Nearest neighbours by inner product with a permutation index.

A vector is represented by the order of the pivots nearest to it. Its first pivots are
posted, with their places, in inverted files, one for each pivot. A query reads the files
of its own nearest pivots and adds up how far the places differ (the footrule distance);
the best share by that distance is ranked again by the exact inner product.

The rows are dealt by a hash to blocks of bounded size, each with inverted files of its
own; the queries visit every block and take its best, and the best of all blocks are the
result. All rows are indexed; only the pivots come from a bounded sample.

There are two sets of pivots, each with inverted files of its own. Those of the first are
distinct and far apart, so that a dense group, such as near copies, supplies few of them
and doesn't crowd the files that other queries read. Those of the second are dealt as
densely as the vectors lie, and tell the members of such a group apart. The best share by
either is ranked again.

Equal vectors are one class, indexed once under its smallest id. A class that is found
stands for its members with the smallest ids, which are joined to it after the search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mdforge.llm.common import settle
from mdforge.llm.lattice_hash import matrix, usable

#: Pivots of a set, the share of them posted for a row, and the share that a query reads.
PIVOTS, POSTED, READ = 256, 0.5, 0.25
#: Distinct vectors that the pivots are chosen from.
SAMPLE = 4096
#: Share of a block that is ranked again, and its least number of rows.
RERANK, RERANK_LEAST = 0.1, 256
#: Rows of a block.
BLOCK = 8192


class Pivots:
    """Order of the pivots as seen from rows and from queries.

    Rows get one more component that makes their norms equal, so that the largest inner
    product is the smallest distance; a query's is zero.
    """

    def __init__(self, vectors: np.ndarray, norm: float) -> None:
        self.norm, self.vectors = norm, self.lifted(vectors, norm)
        self.posted, self.read = (max(1, round(len(vectors) * x)) for x in (POSTED, READ))

    @staticmethod
    def lifted(x: np.ndarray, norm: float) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(norm**2 - (x**2).sum(1), 0))[:, None]])

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-(self.lifted(x, self.norm) @ self.vectors.T), axis=1, kind="stable")[:, : self.posted]

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return np.argsort(-(q @ self.vectors[:, :-1].T), axis=1, kind="stable")[:, : self.read]


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """Places of up to ``n`` distinct rows, each the farthest from those before it."""
    out, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(out) < n and far.max() > 0:
        out.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[out[-1]]) ** 2).sum(1))
    return np.array(out)


def pivot_sets(sample: np.ndarray, norm: float) -> list[Pivots]:
    """Pivots far apart, and the first ones of the sample."""
    return [Pivots(sample[spread(Pivots.lifted(sample, norm), PIVOTS)], norm), Pivots(sample[:PIVOTS], norm)]


class InvertedFiles:
    """For every pivot of a set: the place it has for each row of the block."""

    def __init__(self, x: np.ndarray, pivots: Pivots) -> None:
        order = pivots.of_rows(x)
        # Rows that don't post a pivot count with the first place that isn't posted.
        self.places = np.full((len(pivots.vectors), len(x)), pivots.posted, np.int16)
        self.places[order, np.arange(len(x))[:, None]] = np.arange(order.shape[1], dtype=np.int16)

    def near(self, order: np.ndarray, n: int) -> np.ndarray:
        """The n rows whose footrule distance is least."""
        far, one = np.zeros(self.places.shape[1], np.int32), np.empty(self.places.shape[1], np.int16)
        for place, pivot in enumerate(order):
            np.subtract(self.places[pivot], np.int16(place), out=one)
            far += np.abs(one, out=one)
        return np.argpartition(far, n - 1)[:n]


class Block:
    """Classes with the inverted files of every set of pivots."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, sets: list[Pivots]) -> None:
        self.ids, self.x, self.files = ids, x, [InvertedFiles(x, p) for p in sets]

    def best(self, q: np.ndarray, orders: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the k best of the classes that are near by any set."""
        n = min(len(self.ids), max(RERANK_LEAST, 8 * k, int(RERANK * len(self.ids))))
        found = np.zeros(len(self.ids), bool)
        for f, order in zip(self.files, orders, strict=True):
            found[f.near(order, n)] = True
        some = np.nonzero(found)[0]
        score = (self.x[some] * q).sum(1)
        top = np.lexsort((self.ids[some], -score))[:k]
        return self.ids[some][top], score[top]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each query, nearest first.

    Vectors that are null, empty, zero or hold a null or non-finite component take no
    part, nor do those whose length isn't the most frequent one of the table. Equal rows
    count once; a row with the query's id is no candidate. Ties go to the smaller id.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.where(usable() & F.col("vec_id").isNotNull()).distinct()
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    v = settle(v.select("vec_id", "embedding", norm.alias("norm"), F.size("embedding").alias("dim")), "vectors")
    sizes = v.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("norm")).orderBy(F.desc("n"), "dim").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, _, largest = sizes[0]
    v = v.where(F.col("dim") == dim)
    # One more than k: the query itself may be a member, and its class may hold no other.
    same = Window.partitionBy("embedding").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    members = v.select("vec_id", "embedding", F.first("vec_id").over(same).alias("cls"), F.row_number().over(same).alias("place"))
    members = settle(members.where(F.col("place") <= k + 1), "members")
    classes = members.where("place = 1").select("cls", "embedding")
    n = classes.count()
    chosen = classes.orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).select("embedding").collect()
    shared = spark.sparkContext.broadcast(pivot_sets(np.array([r[0] for r in chosen], np.float64), float(largest)))
    blocks = -(-n // BLOCK)
    own = F.pmod(F.xxhash64("cls", F.lit(1)), F.lit(blocks)).cast("int")
    rows = classes.select(own.alias("block"), F.lit(False).alias("asks"), F.col("cls").alias("vec_id"), "embedding")
    asks = v.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "vec_id", "embedding")
    dealt = rows.union(asks).repartition(blocks, "block").sortWithinPartitions("block", "asks")

    def run(batches):
        sets = shared.value
        block, ids, x, files = None, [], [], None
        for b in batches:
            of, ask = b.column("block").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            cut = np.nonzero(np.diff(of) | np.diff(ask.astype(np.int8)))[0] + 1
            for i, j in zip([0, *cut], [*cut, len(of)], strict=True):
                part = b.slice(i, j - i)
                if of[i] != block:
                    block, ids, x, files = of[i], [], [], None
                if not ask[i]:
                    ids.append(part.column("vec_id").to_numpy())
                    x.append(matrix(part.column("embedding")))
                    continue
                if files is None and ids:
                    files = Block(np.concatenate(ids), np.concatenate(x), sets)
                if files is not None:
                    yield found(files, part, sets)

    def found(files, part, sets):
        q = matrix(part.column("embedding"))
        out = [[], [], []]
        for query_id, vector, *orders in zip(part.column("vec_id").to_pylist(), q, *(p.of_queries(q) for p in sets), strict=True):
            ids, score = files.best(vector, orders, k + 1)
            for c, v in zip(out, (np.full(len(ids), query_id), ids, score), strict=True):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "cls", "score"])

    best = dealt.mapInArrow(run, "query_id long, cls long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "cls")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    best = best.drop("rank").join(members.select("cls", "vec_id"), "cls").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
