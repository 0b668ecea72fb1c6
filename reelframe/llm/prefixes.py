"""Prefix trie of rebuilt conversations, by Van Emde Boas recursion.

Sequences are cut at half depth. The prefixes up to the cut are named: the name of a prefix is the smallest conv_id that
starts with it. The upper trie and the forests below the cut are then cut likewise, all intervals of one size at a time,
as each needs nothing but the names at its start: so a level is one aggregation of the turns in the upper half of its
intervals, by the name where the interval starts and a 128-bit digest of the turns up to the cut. After as many levels
as the greatest depth has binary digits, each prefix has its name.

Totals are grafted from the smallest intervals upwards: when both halves of an interval are done, each node at the cut
adds the total of the forest below it to its ancestors in the upper half, and to itself.

No conversation and no node is gathered in one place: turns are numbered in ranges of the sort order, digests and
counts are aggregated before they are shuffled, and the lists of members that end at a node are joined piece by piece.

Defined results: rows without conv_id belong to no conversation. Turns with the same number stand in the order of role
and text; repeated rows are repeated turns. Null role or text is empty text. Columns besides those named are ignored.
An empty table gives an empty result, without a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import numbered
from ..sources.tables import hold
from .common import column, table

#: The base of conversation c is c - c % BASES, and it lends fewer than LENT turns.
BASES = 100
LENT = 6
#: Prefixes that hold more than this part of all turns at their depth are sent to every task, so there are fewer than HOT.
HOT = 1000


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv), and their rebuilt turns (conv, d, chars, a, b) with a digest of role and text."""
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = numbered(rows, ["conv_id"], [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")], "n").select(
        F.col("conv_id").alias("conv"), "n", F.length("text").cast("long").alias("chars"), F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(LENT), "text", "role").alias("b")
    )
    turns = hold(turns)
    own = F.crc32(F.col("conv").cast("string")) % LENT
    convs = turns.select("conv").distinct()
    lent = turns.where((F.col("conv") % BASES == 0) & (F.col("n") < LENT)).select(F.col("conv").alias("base"), F.col("n").alias("d"), "chars", "a", "b")
    based = lambda df: df.withColumn("base", F.col("conv") - F.col("conv") % BASES)
    heads = based(convs).join(lent, "base").where(F.col("d") <= own)
    have = lent.groupBy("base").agg(F.max("d").alias("have"))
    tails = based(turns).where(F.col("n") > own).join(have, "base", "left").withColumn("d", F.col("n") - own + F.least(own, F.coalesce("have", F.lit(0))))
    columns = ("conv", "d", "chars", "a", "b")
    return hold(convs), hold(heads.select(*columns).unionByName(tails.select(*columns)))


def _told(parts: DataFrame, names: DataFrame, key: list[str], hot: int) -> DataFrame:
    """parts with their names; names of more than hot parts go to every task, so that none gets all parts of one name."""
    many = parts.join(F.broadcast(names.where(F.col("n") > hot)), key, "left")
    few = many.where("node IS NULL").select(parts.columns).join(names.where(F.col("n") <= hot), key)
    return many.where("node IS NOT NULL").unionByName(few)


def named(convs: DataFrame, turns: DataFrame, root: int, levels: int) -> list[DataFrame]:
    """(conv, d, node, chars) for each rebuilt turn: the name of the prefix that ends with it; and d = 0 for all."""
    hot = max(1, turns.count() // HOT)  # a level has no more parts than there are turns, so fewer than HOT names are hot
    found = [convs.select("conv", F.lit(0).cast("long").alias("d"), F.lit(root).cast("long").alias("node"), F.lit(0).cast("long").alias("chars"))]
    for level in reversed(range(levels)):
        half = 1 << level
        start = F.shiftleft(F.shiftright(F.col("d") - 1, level + 1), level + 1)
        upper = turns.where(F.shiftright(F.col("d") - 1, level) % 2 == 0).withColumn("start", start)
        cut = F.max(F.when(F.col("d") == F.col("start") + half, F.col("chars")))
        parts = upper.groupBy("conv", "start").agg(F.bit_xor(F.xxhash64("d", "a")).alias("a"), F.bit_xor(F.xxhash64("b", "d")).alias("b"), cut.alias("chars")).where("chars IS NOT NULL")
        known = reduce(DataFrame.unionByName, found).select("conv", F.col("d").alias("start"), F.col("node").alias("above"))
        parts = hold(parts.join(known, ["conv", "start"]))
        key = ["start", "above", "a", "b"]
        names = parts.groupBy(key).agg(F.min("conv").alias("node"), F.count("*").alias("n"))
        found.append(hold(_told(parts, names, key, hot).select("conv", (F.col("start") + half).alias("d"), "node", "chars")))
    return found


def grafted(paths: DataFrame, own: DataFrame, levels: int) -> DataFrame:
    """Totals of leaves and saved over each node's subtree, as rows (d, node, leaves, saved) to be added up.

    paths has (conv, d, node, above), own the nodes' values (d, node, above, leaves, saved)."""
    added = [own]
    for level in range(levels):
        half = 1 << level
        # forests that hang below a cut of this level: their tops stand one below it
        tops = reduce(DataFrame.unionByName, added).where((F.col("d") - 1) % (2 * half) == half)
        forests = tops.groupBy("d", "above").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).select((F.col("d") - 1).alias("cut"), F.col("above").alias("conv"), "leaves", "saved")
        upper = paths.where(F.shiftright(F.col("d") - 1, level) % 2 == 0).withColumn("cut", F.shiftleft(F.shiftright(F.col("d") - 1, level) + 1, level))
        met = upper.join(forests, ["conv", "cut"]).groupBy("d", "node")
        added.append(hold(met.agg(F.min("above").alias("above"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))))
    rows = reduce(DataFrame.unionByName, added)
    whole = rows.where("d = 1").groupBy(F.col("above").alias("node")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return rows.select("d", "node", "leaves", "saved").unionByName(whole.select(F.lit(0).cast("long").alias("d"), "node", "leaves", "saved"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
    """d, node, first and last row of each run of rows of one node."""
    d, node = column(batch, "d").to_numpy(), column(batch, "node").to_numpy()
    cuts = [0, *(np.flatnonzero((np.diff(d) != 0) | (np.diff(node) != 0)) + 1).tolist(), len(d)]
    return ((int(d[a]), int(node[a]), a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)


def _pieced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted members of nodes as pieces of their list: d, node, the piece's first member, its text."""
    for batch in batches:
        conv = column(batch, "conv").to_pylist()
        rows = [(d, node, conv[a], ",".join(map(str, conv[a:b]))) for d, node, a, b in _runs(batch)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["d", "node", "first", "text"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's list, from its sorted pieces; a list that goes on is kept as the state of its hash."""
    at, sha = None, None
    out = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["d", "node", "ends_sha256"])
    for batch in batches:
        rows, text = [], column(batch, "text").to_pylist()
        for d, node, a, b in _runs(batch):
            piece = ",".join(text[a:b]).encode()
            if (d, node) == at:
                sha.update(b"," + piece)
            else:
                if at is not None:
                    rows.append((*at, sha.hexdigest()))
                at, sha = (d, node), hashlib.sha256(piece)
        yield out(rows)
    if at is not None:
        yield out([(*at, sha.hexdigest())])


def members(ends: DataFrame) -> DataFrame:
    """d, node and ends_sha256 of the conversations (conv) that end at a node."""
    near = ends.select("d", "node", "conv").repartitionByRange("d", "node", "conv").sortWithinPartitions("d", "node", "conv")
    parts = near.mapInArrow(_pieced, "d long, node long, first long, text string")
    return parts.repartition("d", "node").sortWithinPartitions("d", "node", "first").mapInArrow(_digested, "d long, node long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations."""
    convs, turns = rebuilt(conversations)
    root = convs.agg(F.min("conv")).first()[0]
    depth = turns.agg(F.coalesce(F.max("d"), F.lit(0))).first()[0]
    levels = int(depth).bit_length()
    names = reduce(DataFrame.unionByName, named(convs, turns, -1 if root is None else root, levels))
    above = names.select("conv", (F.col("d") + 1).alias("d"), F.col("node").alias("above"))
    paths = hold(names.join(above, ["conv", "d"], "left"))
    nodes = paths.groupBy("d", "node").agg(F.min("above").alias("above"), F.count("*").alias("n"), F.min("chars").alias("chars"))
    kids = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("above").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = hold(nodes.join(kids, ["d", "node"], "left").fillna(0, ["n_children"]))
    own = nodes.select("d", "node", "above", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("chars")).alias("saved"))
    totals = grafted(paths.where("d > 0"), own, levels).groupBy("d", "node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = members(paths.groupBy("conv").agg(F.max(F.struct("d", "node")).alias("x")).select("conv", "x.d", "x.node"))
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(totals, ["d", "node"])
        .join(ends, ["d", "node"], "left")
        .select(F.col("node").alias("conv_id"), F.col("d").alias("depth"), F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))
