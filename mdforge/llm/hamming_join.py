"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature has ``CHUNKS * WIDTH`` values of 16 bits. Two signatures that differ in at
most ``CHUNKS * (ERRORS + 1) - 1`` values have, by the pigeonhole principle, a chunk with
at most ``ERRORS`` differing values. Every chunk is indexed once for each set of positions
that may be wrong, so all pairs within that distance meet under some key. Pairs that meet
are confirmed on their full shingle sets.

Only components are asked for, so pairs are not listed within a group:

1. texts with equal sets are one class;
2. every class is compared with one lead: of the classes that meet most others under its
   keys, the one it shares most keys with. Classes joined by such edges, confirmed or
   not, are a cluster; confirmed ones have a common label;
3. in a cluster, classes outside its most frequent label are compared with all others
   in blocks, inside the tasks, which return links only;
4. classes of different clusters that share a key are compared pair by pair.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdforge.llm.common import components, map_batches, settle
from mdforge.llm.shingles import mix, shingle_set, text_words

#: 13 chunks of 5 values with one error: every pair that differs in up to 25 of 65 values.
#: At a similarity of 0.8 a pair differs in 13 values on average (standard deviation 3.2).
CHUNKS, WIDTH, ERRORS = 13, 5, 1
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Classes of a cluster that are compared at a time, on either side.
BLOCK = 1000
#: Classes whose keys a task counts: hardly any are equal there, so its table of counts grows
#: with its rows (65 keys a class, some 50 MB).
COUNTED = 8_000

_RNG = np.random.default_rng(77)
_XOR = _RNG.integers(0, 2**32, CHUNKS * WIDTH, dtype=np.uint32)
_MUL = _RNG.integers(0, 2**31, CHUNKS * WIDTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of the smallest hash under each of the fixed hash functions."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.empty(len(_XOR), np.uint32)
    for k in range(len(_XOR)):
        low[k] = ((x ^ _XOR[k]) * _MUL[k]).min()
    return (mix(low.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def sketches(docs: DataFrame, shingle_words: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, s1 and s2 (a 128-bit digest of the set), sig (null: empty set)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, s1, s2, sig = [], [], [], []
        for t in b.column("text").to_pylist():
            s = shingle_set(text_words(t), shingle_words)
            n.append(len(s))
            s1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
            s2.append(int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
            sig.append(signature(s).tobytes() if len(s) else None)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "text_hash", "n_shingles", "s1", "s2", "sig"])

    return map_batches(docs, run, "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, sig binary")


def chunk_keys(reps: DataFrame) -> DataFrame:
    """(key, cls) for each chunk and each choice of positions that may be wrong."""
    masks = [np.array(x) for x in combinations(range(WIDTH), WIDTH - ERRORS)]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
        keys = np.empty((len(sig), CHUNKS * len(masks)), np.uint64)
        for c in range(CHUNKS):
            for m, keep in enumerate(masks):
                k = c * len(masks) + m
                h = np.full(len(sig), np.uint64(k + 1))
                for i in keep:
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, c, i])
                keys[:, k] = h
        cls = np.repeat(b.column("cls").to_numpy(), keys.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(cls)], ["key", "cls"])

    return map_batches(reps.select("cls", "sig"), run, "key long, cls long")


def _planes(reps: DataFrame) -> DataFrame:
    """(cls, p0..p3): the low four bits of the first 64 values, a word for each bit."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(b.num_rows, -1)[:, :64]
        words = [np.packbits((sig >> k & 1).astype(np.uint8), axis=1).copy().view(np.int64).reshape(-1) for k in range(4)]
        return pa.RecordBatch.from_arrays([b.column("cls"), *map(pa.array, words)], ["cls", "p0", "p1", "p2", "p3"])

    return map_batches(reps.select("cls", "sig"), run, "cls long, p0 long, p1 long, p2 long, p3 long")


def shingle_sets(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, text_hash, hashes): the full sets of texts (doc_id, text_hash, text)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(text_words(t), shingle_words).view(np.int64) for t in b.column("text").to_pylist()]
        ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), values], ["doc_id", "text_hash", "hashes"])

    return map_batches(docs, run, "doc_id long, text_hash long, hashes array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    x = pairs.join(sets.select(F.col("cls").alias("a"), F.col("hashes").alias("ha")), "a")
    x = x.join(sets.select(F.col("cls").alias("b"), F.col("hashes").alias("hb")), "b")
    both = F.size(F.array_intersect("ha", "hb"))
    return x.where(100 * both >= percent * (F.size("ha") + F.size("hb") - both)).select("a", "b")


def _between(queries: list, targets: list, percent: int) -> list[tuple[int, int]]:
    """Links from each query to the first target of every label but its own.

    Rows: (class, label, hashes). Common hashes are counted over the targets' postings.
    """
    sizes = np.array([len(t[2]) for t in targets])
    held, by = np.concatenate([t[2] for t in targets]), np.repeat(np.arange(len(targets)), sizes)
    order = np.argsort(held, kind="stable")
    held, by = held[order], by[order]
    labels, ids = np.array([t[1] for t in targets]), np.array([t[0] for t in targets])
    out = []
    for cls, label, hashes in queries:
        first, last = np.searchsorted(held, hashes, "left"), np.searchsorted(held, hashes, "right")
        n = last - first
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(by[at], minlength=len(targets))
        near = np.nonzero((labels != label) & (100 * both >= percent * (sizes + len(hashes) - both)))[0]
        near = near[np.unique(labels[near], return_index=True)[1]]
        out.extend((cls, int(i)) for i in ids[near])
    return out


def links_in_clusters(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links within clusters that labels don't hold yet.

    ``classes``: cluster, cls, label. Clusters of one label have nothing to compare. The
    queries and the targets of a cluster are cut into blocks; a task holds one of each.
    """
    labels = classes.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    main = labels.groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("x"), F.count("*").alias("labels"), F.sum("n").alias("n"))
    main = settle(main.where("labels > 1").select("cluster", F.col("x.label").alias("main"), "n", (F.col("n") - F.col("x.n")).alias("asking")), "clusters")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    c = classes.join(main.select("cluster", "main", blocks("n").alias("ts"), blocks("asking").alias("qs")), "cluster").join(sets, "cls")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    targets = c.select("cluster", every("qs").alias("q"), own("ts").alias("t"), F.lit(False).alias("asks"), "cls", "label", "hashes")
    queries = c.where("label <> main").select("cluster", own("qs").alias("q"), every("ts").alias("t"), F.lit(True).alias("asks"), "cls", "label", "hashes")
    dealt = targets.union(queries).repartition("cluster", "q", "t").sortWithinPartitions("cluster", "q", "t", "asks")

    def run(batches):
        at, targets, queries = None, [], []

        def links():
            found = _between(queries, targets, percent) if targets and queries else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        for b in batches:
            hashes = b.column("hashes")
            flat, ends = hashes.values.to_numpy(), hashes.offsets.to_numpy()
            keys = zip(*(b.column(c).to_pylist() for c in ("cluster", "q", "t", "asks", "cls", "label")), strict=True)
            for k, (cluster, q, t, asks, cls, label) in enumerate(keys):
                if (cluster, q, t) != at:
                    if queries:
                        yield links()
                    at, targets, queries = (cluster, q, t), [], []
                (queries if asks else targets).append((cls, label, flat[ends[k] : ends[k + 1]].copy()))
        if queries:
            yield links()

    return dealt.mapInArrow(run, "a long, b long")


def labelled(docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) for every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    sketch = settle(sketches(docs, shingle_words), "sketches")
    filled = sketch.where("n_shingles > 0 and doc_id is not null")
    # A class of equal sets has a number of its own: its smallest doc_id may name others too.
    classes = filled.groupBy("s1", "s2", "n_shingles").agg(F.min(F.struct("doc_id", "text_hash", "sig")).alias("x"))
    classes = settle(classes.select("s1", "s2", "n_shingles", F.monotonically_increasing_id().alias("cls"), "x.*"), "classes")
    reps = classes.select("cls", "sig")

    # Settled before it is joined to the rows it comes from: both sides of the join are
    # then plain exchanges, whose hot partitions Spark splits.
    keys = chunk_keys(reps)
    dealt = reps.repartition(max(1, -(-reps.count() // COUNTED)), "cls")
    shared = chunk_keys(dealt).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = settle(keys.join(settle(shared, "shared"), "key"), "members")
    meets = settle(members.groupBy("cls").agg(F.sum("n").alias("meets")), "meets")
    # Texts are chosen by their ids alone, a table of few bytes; their sets are then told apart.
    wanted = settle(classes.join(meets.select("cls"), "cls").select("doc_id", "text_hash", "cls"), "wanted")
    chosen = docs.join(settle(wanted.select("doc_id").distinct(), "chosen"), "doc_id", "left_semi")
    name = ["doc_id", "text_hash"]
    sets = shingle_sets(chosen.select(*name, "text"), shingle_words).dropDuplicates(name).join(wanted, name)
    sets = settle(sets.select("cls", "hashes"), "sets")

    lead = members.join(meets, "cls").groupBy("key").agg(F.max(F.struct("meets", (-F.col("cls")).alias("m"))).alias("x"))
    lead = settle(lead.select("key", "x.meets", (-F.col("x.m")).alias("lead")), "leads")
    best = members.select("key", "cls").join(lead, "key").where("cls <> lead")
    best = best.groupBy("cls", "lead", "meets").agg(F.count("*").alias("n"))
    best = best.groupBy("cls").agg(F.max(F.struct("n", "meets", (-F.col("lead")).alias("m"))).alias("x"))
    best = settle(best.select((-F.col("x.m")).alias("a"), F.col("cls").alias("b")), "best")
    links = settle(confirmed(best, sets, percent), "links")

    label = components(links).select(F.col("id").alias("cls"), "label")
    cluster = components(best).select(F.col("id").alias("cls"), F.col("label").alias("cluster"))
    named = meets.select("cls").join(cluster, "cls", "left").join(label, "cls", "left")
    named = settle(named.select("cls", F.coalesce("cluster", "cls").alias("cluster"), F.coalesce("label", "cls").alias("label")), "clusters")
    inside = settle(links_in_clusters(named, sets, percent), "links")

    members = members.select("key", "cls").join(named.select("cls", "cluster"), "cls")
    members = settle(members, "members")
    mixed = members.groupBy("key").agg(F.min("cluster").alias("x"), F.max("cluster").alias("y")).where("x < y").select("key")
    members = members.join(settle(mixed, "mixed"), "key").join(_planes(reps), "cls")
    members = settle(members, "members")
    x, y = (members.select("key", *[F.col(c).alias(c + end) for c in ("cls", "cluster", "p0", "p1", "p2", "p3")]) for end in "xy")
    planes = [F.col(f"p{k}x").bitwiseXOR(F.col(f"p{k}y")) for k in range(4)]
    differ = F.bit_count(planes[0].bitwiseOR(planes[1]).bitwiseOR(planes[2]).bitwiseOR(planes[3]))
    pairs = x.join(y, (x.key == y.key) & (F.col("clusterx") < F.col("clustery")) & (differ <= DISTANCE))
    pairs = settle(pairs.select(F.col("clsx").alias("a"), F.col("clsy").alias("b")).distinct(), "pairs")
    across = confirmed(pairs, sets, percent)

    label = components(links.union(inside).union(across)).select(F.col("id").alias("cls"), "label")
    classes = classes.join(label, "cls", "left").select("s1", "s2", "n_shingles", "doc_id", F.coalesce("label", "cls").alias("label"))
    classes = settle(classes, "classes")
    least = settle(classes.groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    classes = settle(classes.join(least, "label").select("s1", "s2", "n_shingles", "component_id"), "components")
    named = filled.join(classes, ["s1", "s2", "n_shingles"]).select("doc_id", "text_hash", "n_shingles", "component_id")
    alone = sketch.where("n_shingles = 0 or doc_id is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.union(alone)


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    A text without words, or null, has an empty set and is linked with nothing; so is a
    row without an id. Rows that share an id are one document if their texts are equal;
    otherwise each row has the component of its own text. Other columns are left out.
    """
    out = labelled(docs, shingle_words, percent).drop("text_hash")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that are linked, over others, to one with a smaller id.

    Rows that share an id but not the text stay or go by their own text. Most ids go or stay
    with all their rows, so texts are only told apart where an id does both.
    """
    rows = labelled(docs, shingle_words, percent).where("doc_id is not null")
    rows = settle(rows.select("doc_id", "text_hash", F.expr("doc_id <> component_id").alias("gone")), "labelled")
    ids = settle(rows.groupBy("doc_id").agg(F.min("gone").alias("all_gone"), F.max("gone").alias("any_gone")).where("any_gone"), "gone")
    whole = ids.where("all_gone").select(F.col("doc_id").alias("_gone"))
    part = rows.where("gone").join(ids.where("not all_gone").select("doc_id"), "doc_id")
    part = settle(part.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "part")
    left = docs.join(settle(whole, "whole"), docs["doc_id"].cast("long") == F.col("_gone"), "left_anti")
    return left.join(part, (left["doc_id"].cast("long") == F.col("_id")) & (F.xxhash64(left["text"]) == F.col("_hash")), "left_anti")
