"""Near-duplicate vectors by lattice hashing.

Every table projects the vectors to eight dimensions at random and decodes them to points
of the E8 lattice; vectors of one cell, or of cells that are among the nearest
neighbouring cells of each other, are compared. A pair at the least cosine meets in one
table with probability 0.65, so ten tables miss one pair in 30,000; closer pairs meet
more often. A 64-bit sign sketch drops most of the pairs that are far apart before their
vectors are fetched; every link is verified on the original vectors in double precision.

Equal vectors are one class. Links that join a class to the smallest class of its cell and
sign pattern come first; what they join is one component, and after that only pairs of
different components are compared. Links within a component are then counted in blocks,
so a large group of near copies is never listed pair by pair, or held by one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdforge.llm import e8
from mdforge.llm.common import components, map_batches, settle
from mdforge.llm.shingles import mix

TABLES, PROBES, SCALE, SEED = 10, 8, 1.0, 5
#: Sketch bits that may differ: a pair at cosine 0.95 differs in 6.5 of 64 on average (deviation 2.4).
SKETCH_BITS = 20
#: Members of a component compared at a time.
BLOCK = 512


def usable(v: str = "embedding"):
    """Whether a vector is there, finite in all components, and not zero."""
    return F.col(v).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _tables(dim: int):
    rng = np.random.default_rng([SEED, dim])
    return [(rng.normal(size=(dim, 8)) * SCALE, rng.random(8)) for _ in range(TABLES)], rng.normal(size=(dim, 64)), rng.normal(size=(dim, 16 * TABLES))


def _cell_key(cells: np.ndarray, table: int, dim: int) -> np.ndarray:
    """64-bit keys of lattice points (doubled, so whole numbers), rows x 8."""
    h = np.full(cells.shape[0], np.uint64(table * 1_000_003 + dim))
    for k in range(8):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + (2 * cells[:, k]).astype(np.int64).view(np.uint64))
    return h.view(np.int64)


def _bits(signs: np.ndarray) -> np.ndarray:
    return np.packbits(signs, axis=1).copy().view(">u8").astype(np.uint64).reshape(len(signs)).view(np.int64)


def cell_keys(classes: DataFrame, probes: int) -> DataFrame:
    """(key, cls, sketch, fine, probe): the own cell (probe false) and neighbouring cells.

    ``fine``: the key with sixteen signs of the table, for the first links.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        cls, out = b.column("cls").to_numpy(), [[] for _ in range(5)]
        lengths = np.asarray(b.column("dim"))
        for dim in np.unique(lengths):
            at = np.nonzero(lengths == dim)[0]
            x = matrix(b.column("embedding").take(pa.array(at)))
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            tables, signs, fine = _tables(int(dim))
            sketch = _bits(x @ signs > 0)
            rough = (x @ fine > 0).reshape(len(x), TABLES, 16)
            for t, (a, shift) in enumerate(tables):
                y = x @ a + shift
                own = e8.decode(y)
                key = _cell_key(own, t, int(dim))
                pattern = mix(key.view(np.uint64) ^ np.packbits(rough[:, t], axis=1).copy().view(np.uint16).reshape(-1).astype(np.uint64))
                near = e8.neighbours(y, own, probes)
                probe = np.stack([_cell_key(near[:, k], t, int(dim)) for k in range(probes)], 1)
                for c, v in zip(out, (key, cls[at], sketch, pattern.view(np.int64), np.zeros(len(at), bool)), strict=True):
                    c.append(v)
                for c, v in zip(out, (probe.reshape(-1), np.repeat(cls[at], probes), np.repeat(sketch, probes), np.zeros(len(at) * probes, np.int64), np.ones(len(at) * probes, bool)), strict=True):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["key", "cls", "sketch", "fine", "probe"])

    return map_batches(classes.select("cls", "embedding", F.size("embedding").alias("dim")), run, "key long, cls long, sketch long, fine long, probe boolean")


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of all rows of x with all rows of y."""
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T


def verified(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose vectors reach the cosine."""
    x = pairs.join(classes.select(F.col("cls").alias("a"), F.col("embedding").alias("va")), "a")
    x = x.join(classes.select(F.col("cls").alias("b"), F.col("embedding").alias("vb")), "b")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lengths = np.asarray(pa.compute.list_value_length(b.column("va")))
        ok = np.zeros(b.num_rows, bool)
        for dim in np.unique(lengths):
            at = np.nonzero(lengths == dim)[0]
            p, q = (matrix(b.column(c).take(pa.array(at))) for c in ("va", "vb"))
            ok[at] = (p * q).sum(1) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1)) >= least
        return pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], ["a", "b"])

    return map_batches(x.where(F.size("va") == F.size("vb")).select("a", "b", "va", "vb"), run, "a long, b long")


def linked_classes(classes: DataFrame, least: float, probes: int = PROBES) -> DataFrame:
    """(cls, label): the component of every class that is linked to another."""
    keys = settle(cell_keys(classes, probes), "cells")
    own = keys.where("not probe")
    star = own.groupBy("fine").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).where("a < z").select("fine", "a")
    star = settle(star, "stars")
    star = own.join(star, "fine").where("a < cls").select("a", F.col("cls").alias("b")).distinct()
    links = settle(verified(star, classes, least), "links")
    label = components(links).select(F.col("id").alias("cls"), "label")
    keys = settle(keys.drop("fine").join(label, "cls", "left").withColumn("label", F.coalesce("label", "cls")), "cells")
    x = keys.where("not probe").select("key", F.col("cls").alias("x"), F.col("sketch").alias("sx"), F.col("label").alias("lx"))
    y = keys.select("key", F.col("cls").alias("y"), F.col("sketch").alias("sy"), F.col("label").alias("ly"))
    near = F.bit_count(F.col("sx").bitwiseXOR(F.col("sy"))) <= SKETCH_BITS
    pairs = x.join(y, (x.key == y.key) & (F.col("lx") != F.col("ly")) & near)
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = verified(pairs, classes, least)
    return components(links.union(more)).select(F.col("id").alias("cls"), "label")


def count_links(members: DataFrame, least: float) -> DataFrame:
    """(cls, n): vectors of other classes linked to each class, by blocks of a component.

    ``members``: label, cls, n (vectors of the class), embedding. A block of a component
    meets each of its blocks once; only counts leave a task.
    """
    size = members.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    m = members.join(size, "label").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    m = m.select("label", "cls", "n", "embedding", "block", other)
    m = m.select(
        "label", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") <= F.col("other")).alias("left"), (F.col("block") >= F.col("other")).alias("right"), "cls", "n", "embedding"
    )
    m = m.repartition("label", "x", "y").sortWithinPartitions("label", "x", "y")

    def counts(rows):
        x = np.array([r[5] for r in rows], np.float64)
        cls, n = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
        left, right = (np.nonzero([r[k] for r in rows])[0] for k in (6, 7))
        near = cosines(x[left], x[right]) >= least
        near &= cls[left][:, None] != cls[right][None, :]
        out = [cls[left], near @ n[right]]
        if rows[0][1] != rows[0][2]:
            out = [np.concatenate([out[0], cls[right]]), np.concatenate([out[1], n[left] @ near])]
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["cls", "n"])

    def run(batches):
        held = []
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("label", "x", "y", "cls", "n", "embedding", "left", "right")), strict=True):
                if held and held[0][:3] != r[:3]:
                    yield counts(held)
                    held = []
                held.append(r)
        if held:
            yield counts(held)

    return m.mapInArrow(run, "cls long, n long").groupBy("cls").agg(F.sum("n").alias("n"))


def near_vectors(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    A vector that is null, empty, zero or holds a null or non-finite component is linked
    with nothing; so are vectors of different lengths with each other. Rows that share an
    id are one vector each; other columns are left out.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = v.where(usable() & F.col("vec_id").isNotNull())
    classes = settle(good.groupBy("embedding").agg(F.min("vec_id").alias("cls"), F.count("*").alias("n")), "classes")
    label = settle(linked_classes(classes, least), "labels")
    members = classes.join(label, "cls").select("label", "cls", "n", "embedding")
    linked = count_links(members, least)
    info = classes.join(label, "cls", "left").join(linked.withColumnRenamed("n", "others"), "cls", "left")
    info = info.select("embedding", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("label", "cls").alias("component_id"))
    found = good.join(info, "embedding").select("vec_id", "n_links", "component_id")
    alone = v.where(~F.coalesce(usable() & F.col("vec_id").isNotNull(), F.lit(False)))
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
