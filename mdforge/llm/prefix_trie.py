"""Prefix tries of conversations by a depth-band rollup.

Every conversation is a sequence of turns; equal sequences of first turns are one node of
the trie. A turn at its place is hashed to 128 bits, and a node is named by its depth and
the exclusive-or of its turns' hashes: a prefix scan, so a long conversation spans many
tasks. From then on a node is the pair (smallest member, depth).

Sums over subtrees are rolled up in bands of ``BAND`` depths. Every node adds its values
to its ancestors within its band, of which there are at most ``BAND``. The nodes on top of
the bands form a trie that is ``BAND`` times less deep; their completed totals are found
in the same way and added to their ancestors in the band above. Rounds grow with the
logarithm of the depth, and no row is multiplied by more than ``BAND``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mdforge.llm.common import ready, settle
from mdforge.llm.mixing import words
from mdforge.operators.crawl import rank_within

#: Depths of a band, and places of a conversation that one window holds.
BAND, STRETCH = 16, 1024
#: Conversations c - c % GROUP to c share first turns, fewer than MOST_SHARED of them.
GROUP, MOST_SHARED = 20, 4
#: Ids joined to one piece of text before they are digested.
PIECE = 4096
_NODE = ["conv_id", "depth"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): turns numbered from 0 by turn, null first.

    Turns with one number come by role, then by text; null roles and texts are empty;
    repeated rows are turns of their own; rows without a conv_id are left out, and so are
    other columns.
    """
    ready(conversations.sparkSession)
    df = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    ranked = rank_within(df, "conv_id", ("turn", "role", "text"))  # ascending: null first
    return ranked.select("conv_id", (F.col("rank") - 1).alias("place"), "role", "text")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with another's turns: their turns, and (conv_id, length).

    Conversation c begins with the first h turns of conversation c - c % 20 (all if there are
    fewer, none if it is absent) and goes on with its own after its first h; h is the crc32
    of its id modulo 4. ``turns`` (conv_id, place, ...) may have any further columns. A
    rebuilt conversation may have no turn; its length is 0 then.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED).alias("h"))
    convs = settle(convs, "convs")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("shared", F.least("h", F.coalesce("base_n", F.lit(0)))).drop("base_n")
    convs = settle(convs, "convs")
    place, rest = F.col("place"), [x for x in turns.columns if x not in ("conv_id", "place")]
    # A base gives at most MOST_SHARED - 1 turns to at most 2 * GROUP - 1 conversations.
    first = turns.where((place < MOST_SHARED - 1) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base")
    shared = convs.select("conv_id", "base", "shared").join(first, "base").where("place < shared").select("conv_id", "place", *rest)
    own = turns.join(convs.select("conv_id", "h", "shared"), "conv_id").where("place >= h")
    own = own.select("conv_id", (place - F.col("h") + F.col("shared")).alias("place"), *rest)
    lengths = convs.select("conv_id", (F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length"))
    return own.unionByName(shared), lengths


def scanned(df: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``df`` (conv_id, place, x1, x2, ...), x1 and x2 combined with those of all earlier places.

    A window holds ``stretch`` places; the totals of the stretches are scanned in the same
    way, so a conversation of any length is never one window.
    """
    df = df.withColumn("_stretch", F.floor(F.col("place") / stretch))
    w = Window.partitionBy("conv_id", "_stretch").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    inside = df.withColumns({x: F.bit_xor(x).over(w) for x in ("x1", "x2")})
    if not df.agg(F.max("_stretch")).first()[0]:
        return inside.drop("_stretch")
    totals = df.groupBy("conv_id", F.col("_stretch").alias("place")).agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    before = scanned(settle(totals, "totals"), stretch).select("conv_id", (F.col("place") + 1).alias("_stretch"), F.col("x1").alias("_b1"), F.col("x2").alias("_b2"))
    out = inside.join(before, ["conv_id", "_stretch"], "left")
    # Every stretch but the first has one before it: places have no gaps.
    both = {f"x{k}": F.col(f"x{k}").bitwiseXOR(F.coalesce(f"_b{k}", F.lit(0).cast("long"))) for k in (1, 2)}
    return out.withColumns(both).drop("_stretch", "_b1", "_b2")


def rollup(values: DataFrame, path: DataFrame, names: list[str], band: int = BAND) -> DataFrame:
    """Sums of the columns ``names`` over the subtree of every node.

    ``values`` (conv_id, depth, ...) has one row per node; ``path`` (conv_id, depth, rep)
    says whose node each conversation is in at each depth.
    """
    v = values.withColumn("_band", F.floor(F.col("depth") / band))
    p = path.withColumn("_band", F.floor(F.col("depth") / band)).withColumnsRenamed({"depth": "p_depth", "conv_id": "p_conv"})
    to_ancestors = lambda rows: p.join(rows, (p["p_conv"] == rows["conv_id"]) & (p["_band"] == rows["_band"]))
    per_node = lambda df: df.groupBy(F.col("rep").alias("conv_id"), F.col("p_depth").alias("depth")).agg(*[F.sum(x).alias(x) for x in names])
    inside = settle(per_node(to_ancestors(v).where("p_depth <= depth").select("rep", "p_depth", *names)), "inside")
    if (inside.agg(F.max("depth")).first()[0] or 0) < band:
        return inside
    top = F.col("depth") % band == 0
    level = (F.col("depth") / band).cast("long").alias("depth")
    done = rollup(inside.where(top).select("conv_id", level, *names), path.where(top).select("conv_id", level, "rep"), names, band)
    # The completed total of a band's top goes to its ancestors in the band above.
    done = done.where("depth > 0").select("conv_id", (F.col("depth") - 1).alias("_band"), *names)
    above = per_node(to_ancestors(done).select("rep", "p_depth", *names))
    return settle(inside.unionByName(above).groupBy(*_NODE).agg(*[F.sum(x).alias(x) for x in names]), "totals")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, depth, member) -> (conv_id, depth, first, piece): ids joined by commas."""
    node, ids = None, []

    def out():
        return pa.RecordBatch.from_pydict({"conv_id": [node[0]], "depth": [node[1]], "first": [ids[0]], "piece": [",".join(map(str, ids))]})

    for b in batches:
        for c, d, m in zip(*(b.column(x).to_pylist() for x in ("conv_id", "depth", "member")), strict=True):
            if ids and (node != (c, d) or len(ids) >= PIECE):
                yield out()
                ids = []
            node = c, d
            ids.append(m)
    if ids:
        yield out()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces -> (conv_id, depth, ends_sha256), one piece in memory at a time."""
    node, digest = None, None

    def out():
        return pa.RecordBatch.from_pydict({"conv_id": [node[0]], "depth": [node[1]], "ends_sha256": [digest.hexdigest()]})

    for b in batches:
        for c, d, piece in zip(*(b.column(x).to_pylist() for x in ("conv_id", "depth", "piece")), strict=True):
            if node == (c, d):
                digest.update(b",")
            else:
                if digest is not None:
                    yield out()
                node, digest = (c, d), hashlib.sha256()
            digest.update(piece.encode())
    if digest is not None:
        yield out()


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of a table (conv_id, depth, member).

    A digest is sequential: a node's ids are joined to pieces of PIECE ids in many tasks, and
    only the pieces meet in one, where they go through the digest one by one.
    """
    order = ["conv_id", "depth", "member"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = settle(pieces.mapInArrow(_pieces, "conv_id long, depth long, first long, piece string"), "pieces")
    sorted_ = pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").select(*_NODE, "piece")
    return sorted_.mapInArrow(_digested, "conv_id long, depth long, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame, band: int = BAND, stretch: int = STRETCH) -> DataFrame:
    """One row for every node of the trie of ``turns`` (conv_id, place, turn, words).

    ``turn`` is a digest of a turn, ``words`` the number of its words; places have no gaps;
    ``lengths`` (conv_id, length) lists all conversations. Columns: conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Without a conversation there is no node.
    """
    spark = turns.sparkSession
    digest = F.sha2(F.concat_ws(":", F.col("place").cast("string"), "turn"), 256)
    lane = [F.conv(F.substring(digest, 16 * k + 1, 16), 16, -10).cast("long").alias(f"x{k + 1}") for k in range(2)]
    prefixes = scanned(settle(turns.select("conv_id", "place", "words", *lane), "turns"), stretch)
    prefixes = settle(prefixes.select("conv_id", (F.col("place") + 1).alias("depth"), "x1", "x2", "words"), "prefixes")
    own = settle(prefixes.groupBy("depth", "x1", "x2").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.max("words").alias("words")), "nodes")
    top = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).first()
    roots = spark.createDataFrame([(top["conv_id"], 0, top["n"], 0)] if top["n"] else [], "conv_id long, depth long, n_convs long, words long")
    path = prefixes.join(own.drop("n_convs", "words"), ["depth", "x1", "x2"]).select("conv_id", "depth", "rep")
    path = settle(path.unionByName(lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(top["conv_id"]).cast("long").alias("rep"))), "path")
    nodes = own.select(F.col("rep").alias("conv_id"), "depth", "n_convs", "words").unionByName(roots)
    parents = path.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent_conv_id"))
    nodes = settle(nodes.join(parents, _NODE, "left"), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = settle(nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    own_values = nodes.select(*_NODE, (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = rollup(own_values, path, ["n_leaves", "saved_tokens"], band)
    ends = path.join(lengths.withColumnRenamed("length", "depth"), _NODE).select(F.col("rep").alias("conv_id"), "depth", F.col("conv_id").alias("member"))
    ends = end_digests(settle(ends, "ends"))
    out = nodes.join(totals, _NODE).join(ends, _NODE, "left")
    return out.select(*_NODE, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, band: int = BAND, stretch: int = STRETCH) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations of a table (conv_id, turn, role, text)."""
    turns = turns_of(conversations)
    # Texts stay behind: a turn is its digest from here on.
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    turns = settle(turns.select("conv_id", "place", digest.alias("turn"), words(F.col("text")).alias("words")), "turns")
    return trie(*rebuilt(turns), band, stretch)
