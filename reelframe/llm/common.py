"""Helpers that the corpus operators share: folds, and text columns as byte arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import hold  # noqa: F401

#: Text bytes that one step inside a task works on; a longer document is taken alone and whole.
PIECE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_is(key: str, modulus: int, remainder: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as in the named fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == remainder, F.lit(True))


_HELD: dict = {}


def held_by_worker(key: tuple, make: Callable[[], object]) -> object:
    """The one large object that a worker keeps from task to task; asking for another one drops it."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null rows are empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most limit bytes of text, or of one row."""
    i = batch.schema.get_field_index(column)
    _, at = buffers(batch.column(i))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


#: Longest word, in bytes, that is hashed by table; longer ones by BLAKE2b.
TABLED = 64
_TABLE = np.frombuffer(np.random.RandomState(61).bytes(TABLED * 256 * 8), np.uint64)
#: Bytes of words whose table entries are held at once.
_SPAN = 1 << 22


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value well mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: the sum of a random number for each place and byte, so that two
    different spans have the same one with probability 2**-64."""
    size = ends - starts
    out = np.zeros(len(starts), np.uint64)
    for i in np.flatnonzero(size > TABLED).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(code[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    short = np.flatnonzero(size <= TABLED)
    total = np.cumsum(size[short])
    for lo, hi in pairwise([0, *np.unique(np.searchsorted(total, np.arange(_SPAN, total[-1], _SPAN))).tolist(), len(short)]) if len(short) else ():
        if lo == hi:
            continue
        which, n = short[lo:hi], size[short[lo:hi]]
        first = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(first, n)
        out[which] = np.add.reduceat(_TABLE.take(place * 256 + code.take(place + np.repeat(starts[which], n))), first)
    return mixed(out)


def word_hashes(raw: np.ndarray, at: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of consecutive texts: a 64-bit hash, byte start, byte end; and each text's first word.

    fold gives for each byte what it counts as, 0 for bytes between words."""
    code = fold[raw]
    inside = np.zeros(len(code) + 2, bool)
    inside[1:-1] = code != 0
    cut = np.zeros(len(code) + 1, bool)
    cut[at] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return span_hashes(code, starts, ends), starts, ends, np.searchsorted(starts, at)


def same_words(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size bytes of a from i on are those of b from j on, for each i, j and size."""
    wide = lambda x: np.ndarray(len(x), np.uint64, np.concatenate((x, np.zeros(8, np.uint8))), strides=(1,))
    x, y = wide(a), wide(b)
    out = np.ones(len(i), bool)
    left = np.arange(len(i))
    for done in range(0, int(size.max(initial=0)), 8):  # eight bytes at a time, of the words that are as long
        left = left[size[left] > done]
        keep = np.uint64(2**64 - 1) >> (np.uint64(8) * np.maximum(0, 8 - (size[left] - done)).astype(np.uint64))
        equal = ((x[i[left] + done] ^ y[j[left] + done]) & keep) == 0
        out[left[~equal]] = False
        left = left[equal]
    return out


def numbered(code: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each word, the same for words of the same bytes only."""
    order = np.argsort(hashes, kind="stable")
    alike = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    i, j = order[alike], order[alike + 1]
    size = ends - starts
    if (size[i] != size[j]).any() or not same_words(code, starts[i], code, starts[j], size[i]).all():
        known: dict[bytes, int] = {}  # different words with one hash
        return np.array([known.setdefault(code[a:b].tobytes(), len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    out = np.zeros(len(hashes), np.int64)
    out[order] = np.cumsum(np.concatenate(([0], hashes[order[1:]] != hashes[order[:-1]]))) if len(order) else 0
    return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; one fewer than k-1 short of the words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n]
    return mixed(total + np.uint64(k))


def carried(docs: DataFrame, added: set[str]) -> tuple[DataFrame, bool]:
    """The documents, with all columns in a struct "row" if one of them has a name that is about to be added."""
    if not added & {c.lower() for c in docs.columns}:
        return docs, False
    return docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("row")), True


def labelled_sample(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most per_class doc_ids of each label 0 and 1, spread by hash over all labelled rows, and the rows of the
    label that each one stands for. Null ids and other labels are left out; an id that has both labels keeps 1."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    slots = rows.groupBy("y", F.pmod(F.xxhash64("doc_id"), F.lit(per_class)).alias("slot")).agg(F.min_by("doc_id", F.xxhash64("doc_id", F.lit(7))).alias("doc_id"), F.count("*").alias("rows"))
    return slots.select("doc_id", "y", "rows")
