"""Embedding near-dedup by an epsilon grid order join.

Equal vectors of a label are one representative with a count. Vectors are scaled to unit length, so that a cosine
bound is a bound on distance, and projected on leading principal axes (found from at most ``SAMPLE`` vectors; any
orthonormal axes give right results). They are sorted by label and grid cell and cut into blocks of at most ``BLOCK``.
Blocks meet by the cells of the first two axes that they touch; those whose boxes (on all axes and the length of the
rest) are farther apart than epsilon are skipped; blocks that
are within epsilon as wholes are linked without looking at pairs. The others meet in one task for each pair of blocks,
which halves both sequences again and again, skips distant intervals, and compares what remains in double precision.
A task returns counts and one link per vector and component, never all pairs.

Defined results: a vector that is null, empty, zero or has a null or non-finite component, and one with a null label or
null vec_id, has no links and is kept. Vectors of different lengths have no links. Rows with the same vec_id and vector
each count as a vector; where they differ, links of either count for both. Columns besides those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, hold, table
from .components import components, local_roots

COSINE = 0.93
AXES = 6
CELL_AXES = 4
SAMPLE = 4096
BLOCK = 2048
#: Rows on either side that are compared outright.
LEAF = 128
SLACK = 1e-9


def units(vectors: pa.Array) -> np.ndarray:
    """Rows of unit length; all vectors have one length."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def axes(sample: np.ndarray) -> np.ndarray:
    """Leading principal axes as columns."""
    return np.linalg.eigh(sample.T @ sample - len(sample) * np.outer(sample.mean(0), sample.mean(0)))[1][:, ::-1][:, :AXES]


def coordinates(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Projections on the axes, and the length of what they leave; distances here are never larger than between x."""
    p = x @ basis
    return np.column_stack([p, np.sqrt(np.maximum(0, 1 - (p * p).sum(1)))])


def _gap(p: np.ndarray, q: np.ndarray) -> float:
    """Least distance between the boxes around two sets of points."""
    d = np.maximum(0, np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)))
    return float(np.sqrt((d * d).sum()))


def joined(x: np.ndarray, p: np.ndarray, wx: np.ndarray, y: np.ndarray, q: np.ndarray, wy: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted link counts of both sequences and links (x number, y number) that connect what is connected."""
    epsilon = np.sqrt(2 - 2 * cosine) + SLACK
    nx, ny = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    links_a, links_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d or same and d <= a or _gap(p[a:b], q[c:d]) > epsilon:
            continue
        if b - a > LEAF or d - c > LEAF:
            m, n = (a + b) // 2, (c + d) // 2
            todo += [(e, f, g, h) for e, f in ((a, m), (m, b)) for g, h in ((c, n), (n, d))]
            continue
        hit = x[a:b] @ y[c:d].T >= cosine
        if same:
            hit &= np.arange(a, b)[:, None] < np.arange(c, d)[None]
        i, j = np.nonzero(hit)
        if len(i):
            nx[a:b] += hit @ wy[c:d]
            ny[c:d] += wx[a:b] @ hit
            root = local_roots(b - a + d - c, i, j + b - a)
            # a component's smallest node is on the left; the right side hangs on it, the left side on any right one
            first = np.unique(i, return_index=True)[1]
            right = np.unique(j)
            links_a += [a + root[right + b - a], a + i[first]]
            links_b += [c + right, c + j[first]]
    return nx, ny, np.concatenate(links_a), np.concatenate(links_b)


def _blocks(rows: DataFrame, basis: dict[int, np.ndarray], cell: float) -> DataFrame:
    """Rows in grid order with the number of their block."""
    shared = rows.sparkSession.sparkContext.broadcast(basis)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array(column(batch, "dim"))
            for d in np.unique(size):
                part = batch.take(pa.array(np.flatnonzero(size == d)))
                p = coordinates(units(column(part, "embedding")), shared.value[int(d)]) if int(d) in shared.value else np.zeros((part.num_rows, 1))
                cells = np.floor(p[:, :CELL_AXES] / cell).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(p), pa.list_(pa.float64())), pa.array(list(cells), pa.list_(pa.int32()))], [*part.schema.names, "place", "cells"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = rows.mapInArrow(project, f"{fields}, place array<double>, cells array<int>")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, last = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for i, group in enumerate(zip(column(batch, "label").to_pylist(), column(batch, "dim").to_pylist(), strict=True)):
                if group != last or size == BLOCK:
                    block, size, last = block + 1, 0, group
                size += 1
                out[i] = block
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "block"])

    order = ["label", "dim", "cells", "vec_id"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"{fields}, place array<double>, cells array<int>, block long")


def _summaries(blocks: DataFrame) -> DataFrame:
    """Of each block: its box, weight, smallest vec_id, centre and radius."""

    def of(key: tuple, rows: pa.Table) -> pa.Table:
        x = units(rows["embedding"])
        p = np.array(rows["place"].to_pylist())
        centre = x.mean(0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(1)).max())
        doubles, low = pa.list_(pa.float64()), rows["vec_id"]
        return pa.table(
            {
                "block": pa.array([key[0].as_py()]),
                "label": rows["label"].slice(0, 1),
                "dim": rows["dim"].slice(0, 1),
                "low": pa.array([p.min(0)], doubles),
                "high": pa.array([p.max(0)], doubles),
                "weight": pa.array([sum(rows["copies"].to_pylist())]),
                "least": pa.array([min(low.to_pylist())], low.type),
                "centre": pa.array([centre], doubles),
                "radius": pa.array([radius]),
            }
        )

    label, vec = (blocks.schema[c].dataType.simpleString() for c in ("label", "vec_id"))
    return blocks.groupBy("block").applyInArrow(of, f"block long, label {label}, dim int, low array<double>, high array<double>, weight long, least {vec}, centre array<double>, radius double")


def _block_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Pairs of blocks that may hold links, and whether all of their vectors are linked."""
    cell = max(epsilon, 0.05) + 1e-6  # no narrower than the largest distance of a link

    def celled(side: int, more: int) -> DataFrame:
        """The blocks once for each cell of the first two axes that their boxes, or their neighbourhoods, touch."""
        rows = blocks.select([F.col(c).alias(f"{c}{side}") for c in blocks.columns])
        for axis in (0, 1):
            edge = lambda end: F.floor(F.get(f"{end}{side}", F.lit(axis)) / cell)  # noqa: B023, E731
            rows = rows.withColumn(f"from{axis}{side}", edge("low") - more)
            rows = rows.withColumn(f"cell{axis}", F.explode(F.sequence(f"from{axis}{side}", edge("high") + more)))
        return rows

    one, two = celled(1, 0), celled(2, 1)
    pairs = one.join(two, (F.col("label1") == F.col("label2")) & (F.col("dim1") == F.col("dim2")) & (one.cell0 == two.cell0) & (one.cell1 == two.cell1) & (F.col("block1") <= F.col("block2")))
    # the cells that two blocks have in common are a rectangle, and its first corner stands for the pair
    pairs = pairs.where((one.cell0 == F.greatest("from01", "from02")) & (one.cell1 == F.greatest("from11", "from12")))
    root = lambda parts: F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v * v))
    sides = lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(F.lit(0.0), x - y))
    gap = root(F.zip_with(sides("low1", "high2"), sides("low2", "high1"), lambda x, y: F.greatest(x, y)))
    pairs = pairs.where(gap <= epsilon + SLACK)
    centres = root(F.zip_with("centre1", "centre2", lambda x, y: x - y))
    near = centres + F.col("radius1") + F.col("radius2") <= epsilon - SLACK
    return pairs.select("block1", "block2", "least1", "least2", "weight1", "weight2", near.alias("near"))


def _linked(blocks: DataFrame, pairs: DataFrame, cosine: float) -> DataFrame:
    """(vec_id, other, n): n links found, and one linked vector."""
    to = pairs.select("block1", "block2", F.explode(F.array_distinct(F.array("block1", "block2"))).alias("block"))
    rows = blocks.select("block", "vec_id", "copies", "place", "embedding").join(to, "block")

    def of(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        a, b = rows["block1"][0].as_py(), rows["block2"][0].as_py()
        block = rows["block"].to_numpy()
        p = np.array(rows["place"].to_pylist())
        order = np.lexsort(p.T[::-1])
        x, w, ids = units(rows["embedding"]), rows["copies"].to_numpy(), rows["vec_id"].to_numpy()
        i, j = order[block[order] == a], order[block[order] == b]
        nx, ny, la, lb = joined(x[i], p[i], w[i], x[j], p[j], w[j], cosine, a == b)
        count = np.zeros(len(x), np.int64)
        np.add.at(count, i, nx)
        np.add.at(count, j, ny)
        root = local_roots(len(x), i[la], j[lb])
        some = np.flatnonzero(count)
        return pa.table([ids[some], ids[root[some]], count[some]], names=["vec_id", "other", "n"])

    vec = blocks.schema["vec_id"].dataType.simpleString()
    return rows.groupBy("block1", "block2").applyInArrow(of, f"vec_id {vec}, other {vec}, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of (vec_id, label, embedding)."""
    epsilon = float(np.sqrt(2 - 2 * cosine))
    e = F.col("embedding")
    number = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = e.isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & number & F.exists(e, lambda x: x != 0)
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(valid, F.lit(False)).alias("valid"))
    groups = rows.where("valid").groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    groups = hold(groups.withColumn("dim", F.size("embedding")))
    basis = {}
    for (d,) in groups.select("dim").distinct().collect():
        sample = groups.where(F.col("dim") == d).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
        basis[d] = axes(units(sample["embedding"]))
    blocks = hold(_blocks(groups, basis, epsilon))
    summaries = hold(_summaries(blocks))
    pairs = hold(_block_pairs(summaries, epsilon))
    found = _linked(blocks, pairs.where("not near"), cosine)
    # blocks that are linked as wholes: each vector of the one has all vectors of the other
    near = pairs.where("near")
    sides = near.select(F.col("block1").alias("block"), F.col("least2").alias("other"), F.col("weight2").alias("n"), (F.col("block1") == F.col("block2")).alias("own"))
    sides = sides.unionByName(near.where("block1 <> block2").select(F.col("block2").alias("block"), F.col("least1").alias("other"), F.col("weight1").alias("n"), F.lit(False).alias("own")))
    sides = sides.groupBy("block").agg(F.min("other").alias("other"), F.sum("n").alias("n"), F.max("own").alias("own"))
    whole = blocks.join(sides, "block").select("vec_id", "other", (F.col("n") - F.when(F.col("own"), F.col("copies")).otherwise(0)).alias("n"))
    found = hold(found.unionByName(whole))
    links = found.select(F.col("vec_id").alias("a"), F.col("other").alias("b")).unionByName(near.select(F.col("least1").alias("a"), F.col("least2").alias("b")))
    tied = components(links)
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    # copies: the representative's links, its component, and the other copies
    copied = groups.where("copies > 1").select("label", "embedding", F.col("vec_id").alias("rep"), "copies")
    member = rows.where("valid").join(copied, ["label", "embedding"], "left").select("vec_id", F.coalesce("rep", "vec_id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
    member = member.join(counts.select(F.col("vec_id").alias("rep"), "n"), "rep", "left").join(tied.select(F.col("node").alias("rep"), "component"), "rep", "left")
    out = member.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
