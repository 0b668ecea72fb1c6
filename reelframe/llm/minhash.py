"""MinHash near-dedup with tensored banding and exact confirmation.

Words are runs of anything but ASCII white space, A-Z lower-cased; a document's set is its distinct shingles. Equal
sets are one representative. ``2 * SIDE * HALF`` minhashes make SIDE left and SIDE right half-keys of HALF values each;
each pair of a left and a right half-key is the key of one of SIDE**2 tables. Documents with a common key are candidates.

Candidates are confirmed on full sets, without emitting all pairs of a bucket. First each bucket's documents meet its
smallest; the confirmed links give components. Buckets that still hold several components are cut into cells of bounded
size, where a parity sketch of each set bounds the set difference from below: pairs that pass it and cross components
are reduced to a spanning forest and confirmed. A last round confirms every remaining pair across components that
passes, so no candidate is lost.

At a similarity of 0.8 a pair is a candidate with probability 0.9996, at 0.85 and more above 0.99997.

Sets are signed by 64-bit hashes of their shingles and equal ones found by a 128-bit digest of these; links between
different sets are confirmed on the words themselves. Ids may be numbers or strings.

Defined results: null text and text without words have an empty set and no links. A null doc_id has no links, and its
component is null. Repeated rows with one doc_id are one document; where their texts differ, links of either count.
Columns besides those named are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buffers, column, grams, hold, numbered, pieces, table, word_hashes
from .components import components

SIDE = 12
HALF = 3
PERCENT = 80
#: Documents on either side of a cell of a bucket.
CELL = 512
#: Groups of copies are sent to every task if they hold more than this part of all rows, so there are fewer than HOT.
HOT = 1000


def _fold() -> np.ndarray:
    fold = np.arange(256).astype(np.uint8)
    fold[0] = 0xFF  # NUL is part of a word, and this byte is in no text
    fold[0x41:0x5B] = fold[0x61:0x7B]
    fold[[0x20, *range(0x09, 0x0E)]] = 0
    return fold


FOLD = _fold()
_RANDOM = np.random.RandomState(20)
_TIMES = _RANDOM.randint(0, 2**63 - 1, 2 * SIDE * HALF, np.int64).astype(np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.randint(0, 2**63 - 1, 2 * SIDE * HALF, np.int64).astype(np.uint64)[:, None]


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, _, _, heads = word_hashes(*buffers(texts), FOLD)
    g = grams(words, k)
    for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
        yield np.unique(g[a : b - k + 1]) if b - a >= k else grams(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def halves(s: np.ndarray) -> np.ndarray:
    """The left, then the right half-keys of a set."""
    low = np.full(len(_TIMES), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1 << 14):
        x = (s[None, i : i + (1 << 14)] ^ _PLUS) * _TIMES
        low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(1))
    return grams(low, HALF)[::HALF].view(np.int64)


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of members in each of about twice as many classes as members."""
    bits = max(256, 1 << int(2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def fold_sketch(x: np.ndarray, size: int) -> np.ndarray:
    """A sketch of fewer bytes: halves are added modulo 2."""
    while x.shape[-1] > size:
        x = x[..., : x.shape[-1] // 2] ^ x[..., x.shape[-1] // 2 :]
    return x


def may_link(n: np.ndarray, m: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes whose difference is at least differ can be similar enough."""
    return ((100 + percent) * differ <= (100 - percent) * (n + m)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def _signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, a hash of the set (null if empty), half-keys and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = list(shingle_sets(column(part, "text"), k))
                some = [len(s) > 0 for s in sets]
                keys = [halves(s) if b else None for s, b in zip(sets, some, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        column(part, "doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if b else None for s, b in zip(sets, some, strict=True)], pa.binary()),
                        pa.array([x if x is None else x[:SIDE] for x in keys], pa.list_(pa.int64())),
                        pa.array([x if x is None else x[SIDE:] for x in keys], pa.list_(pa.int64())),
                        pa.array([sketch(s) if b else None for s, b in zip(sets, some, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "n", "same", "left", "right", "sketch"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, same binary, left array<long>, right array<long>, sketch binary")


def _buckets(reps: DataFrame) -> DataFrame:
    """(key, doc_id, least, crowded, table) of each document in each bucket of two or more, least being the bucket's smallest;
    crowded buckets have three or more."""
    left = reps.select("doc_id", "right", F.posexplode("left").alias("i", "l"))
    keys = left.select("doc_id", "i", "l", F.posexplode("right").alias("j", "r")).select(F.xxhash64("i", "l", "j", "r").alias("key"), "doc_id", (F.col("i") * SIDE + F.col("j")).alias("table"))
    kind = reps.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by key and doc_id; a bucket's first two rows wait until it is known how many there are
        key = least = second = last = table = None
        seen = 0
        for batch in batches:
            keys, docs, tables = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("key", "doc_id", "table"))
            shared = np.zeros(len(keys), bool)
            shared[1:] = keys[1:] == keys[:-1]
            shared[:-1] |= shared[1:]
            shared[:1] |= keys[:1] == key
            shared[-1:] = True  # it may go on in the next batch
            out: list[tuple] = []
            for x, d, t in zip(keys[shared].tolist(), docs[shared].tolist(), tables[shared].tolist(), strict=True):
                if x != key:
                    if seen == 2:
                        out.append((key, second, least, False, table))
                    key, least, last, seen, table = x, d, d, 1, t
                elif d != last:
                    last, seen = d, seen + 1
                    if seen == 2:
                        second = d
                    elif seen == 3:
                        out += [(key, x, least, True, table) for x in (least, second, d)]
                    else:
                        out.append((key, d, least, True, table))
            yield _rows(out, batch)
        if seen == 2:
            yield _rows([(key, second, least, False, table)], batch)

    def _rows(out: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        doc = column(like, "doc_id").type
        kinds = (pa.int64(), doc, doc, pa.bool_(), pa.int32())
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "doc_id", "least", "crowded", "table"])

    return keys.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(run, f"key long, doc_id {kind}, least {kind}, crowded boolean, table int")


def _passing(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches leave a link possible."""
    side = lambda c: signed.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = column(batch, "na").to_numpy(), column(batch, "nb").to_numpy()
            differ = np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(column(batch, "sa").to_pylist(), column(batch, "sb").to_pylist(), strict=True)):
                size = min(len(x), len(y))
                differ[i] = np.bitwise_count(fold_sketch(np.frombuffer(x, np.uint8), size) ^ fold_sketch(np.frombuffer(y, np.uint8), size)).sum()
            yield batch.select(["a", "b"]).filter(pa.array(may_link(n, m, differ, percent)))

    kind = pairs.schema["a"].dataType.simpleString()
    return rows.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


def exact_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text as numbers, which are equal within this call for equal words only."""
    raw, at = buffers(texts)
    hashes, starts, ends, heads = word_hashes(raw, at, FOLD)
    ids = numbered(FOLD[raw], starts, ends, hashes)
    joined = lambda x, y: np.unique(x, return_inverse=True)[1] * (len(ids) + 1) + y
    run, width = ids, 1
    for bit in bin(k)[3:]:  # runs of twice the words, and of one more
        run, width = joined(run[: max(0, len(run) - width)], np.unique(run, return_inverse=True)[1][width:]), 2 * width
        if bit == "1":
            run, width = joined(run[: max(0, len(run) - 1)], ids[width:]), width + 1
    whole: dict[tuple, int] = {}
    out = []
    for a, b in pairwise(heads.tolist()):
        few = [whole.setdefault(tuple(ids[a:b].tolist()), ~len(whole))] if 0 < b - a < k else []
        out.append(np.unique(run[a : b - k + 1]) if b - a >= k else np.array(few, np.int64))
    return out


def _confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; words are compared themselves, not their hashes."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "ta"):
                a, b = column(part, "ta"), column(part, "tb")
                # rows come by b, so that its set is seldom made anew
                told = b.to_pylist()
                new = np.array([i == 0 or told[i] != told[i - 1] for i in range(len(told))])
                sets = exact_sets(pa.concat_arrays([a, b.take(pa.array(np.flatnonzero(new)))]), k)
                keep = []
                for s, t in zip(sets, (len(a) + np.cumsum(new) - 1).tolist(), strict=False):
                    both = len(np.intersect1d(s, sets[t], assume_unique=True))
                    keep.append(100 * both >= percent * (len(s) + len(sets[t]) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return rows.mapInArrow(run, f"a {kind}, b {kind}")


def _crossing(buckets: DataFrame, signed: DataFrame, tied: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Candidate pairs (a, b) of different components in one bucket that pass: all, or as many as connect them."""
    placed = buckets.join(tied.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("size"), F.count("*").alias("kinds")).where("kinds > 1")
    # members of the main component meet the others only, so neither side is copied more often than the other has slots
    slots = lambda n: F.ceil(n / CELL).cast("int")
    rows = placed.join(mixed.select("key", "main", slots(F.col("most")).alias("inner"), slots(F.col("size") - F.col("most")).alias("outer")), "key")
    own = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    each = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    inside = F.transform(each(F.col("outer")), lambda j: cell(0, own(F.col("inner")), j))
    outside = F.concat(F.transform(each(F.col("inner")), lambda i: cell(0, i, own(F.col("outer")))), F.transform(each(F.col("outer")), lambda j: cell(1, F.least(j, own(F.col("outer"))), F.greatest(j, own(F.col("outer"))))))
    cells = rows.select("key", "table", "doc_id", "component", F.explode(F.when(F.col("component") == F.col("main"), inside).otherwise(outside)).alias("cell")).select("key", "table", "doc_id", "component", "cell.*")
    rows = cells.join(signed.select("doc_id", "n", "sketch", F.concat("left", "right").alias("halves")), "doc_id")
    kind = signed.schema["doc_id"].dataType.simpleString()

    def of(docs: np.ndarray, comps: np.ndarray, n: np.ndarray, marks: list[bytes], keys: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        size = min(map(len, marks))
        bits = np.stack([fold_sketch(np.frombuffer(x, np.uint8), size) for x in marks])
        found = []
        for x in range(len(docs) - 1):
            open_ = np.flatnonzero((comps[x + 1 :] != comps[x]) & may_link(n[x], n[x + 1 :], 0, percent)) + x + 1
            if len(open_):
                differ = np.bitwise_count(bits[open_] ^ bits[x]).sum(1)
                # a pair belongs to the first table in which it meets, so it is looked at once
                same = keys[open_] == keys[x]
                first = same[:, :SIDE].argmax(1) * SIDE + same[:, SIDE:].argmax(1)
                found.append((np.full(len(open_), x), open_, may_link(n[x], n[open_], differ, percent) & (first == table)))
        if not found:
            return docs[:0], docs[:0]
        a, b, good = map(np.concatenate, zip(*found, strict=True))
        a, b = a[good], b[good]
        if forest and len(a):
            _, node = np.unique(comps, return_inverse=True)  # a component is one node
            todo, parent = [], np.arange(node.max() + 1)
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                u, v = node[x], node[y]
                while parent[u] != u:
                    u = parent[u]
                while parent[v] != v:
                    v = parent[v]
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    todo.append((x, y))
            a, b = np.array(todo).T
        return docs[a], docs[b]

    def cells_of(t: pa.Table, end: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
        """Pairs of the table's whole cells, and the last cell's rows, which wait for more unless this is the end."""
        marks = np.stack([t[c].to_numpy() for c in ("key", "kind", "i", "j")])
        edges = np.concatenate(([0], np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1, [t.num_rows]))
        stop = len(edges) - 1 - (not end)
        docs, comps, n, bits, tables = t["doc_id"].to_numpy(), t["component"].to_numpy(), t["n"].to_numpy(), t["sketch"].to_pylist(), t["table"].to_numpy()
        keys = t["halves"].combine_chunks().flatten().to_numpy().reshape(-1, 2 * SIDE)
        found = [of(docs[a:b], comps[a:b], n[a:b], bits[a:b], keys[a:b], tables[a]) for a, b in zip(edges[:stop], edges[1 : stop + 1], strict=True) if b - a > 1]
        batches = [pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b), t["doc_id"].type), pa.array(np.minimum(a, b), t["doc_id"].type)], ["a", "b"]) for a, b in found if len(a)]
        return batches, t.slice(edges[stop])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                found, rest = cells_of(t if rest is None else pa.concat_tables([rest, t]), False)
                yield from found
        if rest is not None:
            yield from cells_of(rest, True)[0]

    rows = rows.repartition("key", "kind", "i", "j").sortWithinPartitions("key", "kind", "i", "j", "doc_id")
    return rows.select("key", "kind", "i", "j", "doc_id", "component", "n", "sketch", "table", "halves").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _same_ids(signed: DataFrame, groups: DataFrame) -> DataFrame:
    """Links (a, b) between the representatives of the different sets of one doc_id."""
    rows = signed.where("same is not null and doc_id is not null").select("doc_id", "same")
    several = rows.groupBy("doc_id").agg(F.min("same").alias("low"), F.max("same").alias("high")).where("low <> high").select("doc_id")
    sets = rows.join(several, "doc_id", "left_semi").distinct().join(groups.select("same", F.col("doc_id").alias("a")), "same").select("doc_id", "a")
    return sets.join(sets.groupBy("doc_id").agg(F.min("a").alias("b")), "doc_id").where("a <> b").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, k: int, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of (doc_id, text)."""
    signed = hold(_signed(docs, k))
    first = F.min_by(F.struct("doc_id", "n", "sketch", "left", "right"), "doc_id").alias("first")
    groups = signed.where("same is not null and doc_id is not null").groupBy("same").agg(first, F.count("*").alias("copies"))
    groups = hold(groups.select("same", "copies", "first.*"))
    reps = groups.drop("same", "copies")
    buckets = hold(_buckets(reps))
    stars = buckets.where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct()
    links = hold(_confirmed(hold(_passing(stars, reps, percent)), docs, k, percent)).unionByName(hold(_same_ids(signed, groups)))
    tied = hold(components(links))
    crowded = buckets.where("crowded").select("key", "table", "doc_id")
    for forest in (True, False):
        pairs = hold(_crossing(crowded, reps, tied, percent, forest))
        if pairs.isEmpty():
            break
        links = links.unionByName(hold(_confirmed(pairs, docs, k, percent)))
        tied = hold(components(links))
    tied = tied.select(F.col("node").alias("doc_id"), "component")
    found = hold(groups.select("same", "copies", "doc_id").join(tied, "doc_id", "left").where("copies > 1 or component is not null").select("same", "copies", F.coalesce("component", "doc_id").alias("component")))
    # sets of more than a HOT-th of the rows are fewer than HOT, so they can be sent to every task; the others meet in a join
    hot = found.where(F.col("copies") * HOT > signed.count())
    rows = signed.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("same")).alias("same"))
    rows = rows.join(F.broadcast(hot.select("same", F.col("component").alias("hot"))), "same", "left")
    ready = F.col("hot").isNotNull() | F.col("same").isNull()
    cold = rows.where(~ready).select("doc_id", "n", "same").join(found.select("same", "component"), "same", "left")
    out = rows.where(ready).select("doc_id", "n", F.col("hot").alias("component")).unionByName(cold.select("doc_id", "n", "component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 2)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def stage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of documents whose five-word shingles are similar to 0.8 or more, the smallest doc_id stays; of
    rows with one doc_id, one stays. Rows with a null doc_id all stay."""
    kept = near_duplicates(docs.select("doc_id", "text"), 5).where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.join(kept, "doc_id", "left_semi")
    spare = next(f"__{i}" for i in range(len(docs.columns) + 1) if f"__{i}" not in docs.columns)
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
    rows = rows.withColumn(spare, first).where(F.col(spare) == 1).drop(spare)
    return rows.unionByName(docs.where("doc_id is null"))
