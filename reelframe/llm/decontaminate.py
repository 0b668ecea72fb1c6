"""Benchmark decontamination by winnowing.

Words are runs of bytes other than ASCII punctuation, spaces and controls, with A-Z lower-cased. In every window of
``WINDOW`` words, the smallest hash of ``GRAM`` consecutive words is kept as a fingerprint. Whatever document and item
share for at least WINDOW words shares a fingerprint. Fingerprints of documents and items are joined, and each hit is
extended to the windows around it, which are looked up among the distinct windows of the items. An item of fewer words
is one window of its own length.

Hashes find the places, and the words themselves are compared there; each distinct window counts once, so repetitive
texts cost no more than others. Benchmarks of up to ``BROADCAST_BYTES`` of text go to each task, and no document is
shuffled; of larger ones, a join of fingerprints tells which documents meet the items at all, and those do block by block.

Defined results: null and empty texts have no words and are clean; null and empty items match nothing. Items without
an id mark words but are not listed. Rows with the same id, or none, are each judged. Columns besides those named are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, carried, column, grams, hold, numbered, pieces, same_words, table, word_hashes

WINDOW = 10
GRAM = 5
#: Most bytes of benchmark text that are sent to every task.
BROADCAST_BYTES = 8 << 20
RESULT = "n_words long, n_hit long, items array<string>"
RUNS = "n_words long, runs array<struct<a:long,b:long>>, items array<string>"


def _fold() -> np.ndarray:
    fold = np.zeros(256, np.uint8)
    for lo, hi in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
        fold[lo:hi] = np.arange(lo, hi)
    fold[0x41:0x5B] = fold[0x61:0x7B]
    return fold


FOLD = _fold()


def fingerprints(words: np.ndarray, heads: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the leftmost smallest k-gram of every window that lies in one text, and their hashes."""
    g = grams(words, gram)
    span = window - gram + 1
    n = len(g) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low, first = g[:n].copy(), np.zeros(n, np.int8)
    for o in range(1, span):
        less = g[o : o + n] < low
        low[less] = g[o : o + n][less]
        first[less] = o
    end = np.repeat(heads[1:], np.diff(heads))[:n]
    at = np.arange(n)
    picked = np.unique((at + first)[at + window <= end])
    return picked, g[picked]


class Windows:
    """The distinct runs of n words at given places of the items, by hash, with the items that hold each."""

    def __init__(self, n: int, words: np.ndarray, number: np.ndarray, places: np.ndarray, owner: np.ndarray, items: int):
        self.n = n
        value = grams(words, n)[places] if len(places) else np.zeros(0, np.uint64)
        order = np.argsort(value, kind="stable")

        def differs(order: np.ndarray) -> np.ndarray:
            at = places[order]
            out = np.zeros(max(len(at) - 1, 0), bool)
            for o in range(n):
                out |= number[at[1:] + o] != number[at[:-1] + o]
            return out

        changed, jumped = differs(order), value[order][1:] != value[order][:-1]
        if (changed & ~jumped).any():  # different windows with one hash: put equal ones side by side
            order = np.lexsort((*(number[places + o] for o in reversed(range(n))), value))
            changed = differs(order)
        window = np.cumsum(np.append(0, changed)) if len(order) else np.zeros(0, np.int64)
        first = np.flatnonzero(np.append(True, changed)) if len(order) else np.zeros(0, np.int64)
        self.value, self.place = value[order][first], places[order][first]
        self.alike = int(np.unique(self.value, return_counts=True)[1].max(initial=0))
        held = np.unique(window * items + owner[places[order]])
        window, self.owners = held // max(items, 1), held % max(items, 1)
        self.cuts = np.searchsorted(window, np.arange(len(first) + 1))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.value & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def near(self, value: np.ndarray) -> np.ndarray:
        """Which of the values may be there."""
        return np.flatnonzero(self.seen[(value & np.uint64((1 << 20) - 1)).astype(np.int64)])


class Items:
    """The benchmark's words, the fingerprints of its windows, and its distinct windows; short items are one window."""

    def __init__(self, ids: list[str | None], texts: pa.Array):
        self.ids = np.array(ids, object)
        raw, at = buffers(texts)
        self.code = FOLD[raw]
        words, self.starts, self.ends, heads = word_hashes(raw, at, FOLD)
        number = numbered(self.code, self.starts, self.ends, words)
        sizes = np.diff(heads)
        owner = np.repeat(np.arange(len(ids)), sizes)
        place = np.arange(len(words))
        whole = place[place + WINDOW <= np.repeat(heads[1:], sizes)]
        self.prints = np.unique(fingerprints(words, heads)[1])
        self.windows = [Windows(WINDOW, words, number, whole, owner, len(ids))]
        for n in sorted(set(sizes[(sizes > 0) & (sizes < WINDOW)].tolist())):
            self.windows.append(Windows(n, words, number, heads[:-1][sizes == n], owner, len(ids)))
        # windows that the same items hold are one set of items, listed once for a text however many of them it has
        known: dict[bytes, int] = {}
        self.sets: list[np.ndarray] = []
        self.set_of = []
        for w in self.windows:
            out = np.zeros(len(w.value), np.int64)
            for i in range(len(w.value)):
                listed = w.owners[w.cuts[i] : w.cuts[i + 1]]
                key = listed.tobytes()
                if key not in known:
                    known[key] = len(known)
                    self.sets.append(listed)
                out[i] = known[key]
            self.set_of.append(out)


def occurrences(items: Items, code: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and set of items of each place in consecutive texts where a window of an item stands.

    Fingerprints that an item has too are hits; a hit is extended to the windows around it, each looked up once by its
    hash and then compared word by word, however often it stands in the items."""
    last = np.repeat(heads[1:], np.diff(heads))
    found = [(np.zeros(0, np.int64),) * 3]
    for w, set_of in zip(items.windows, items.set_of, strict=True):
        g = grams(words, w.n)
        at = np.arange(len(g))
        if w.n == WINDOW:
            place, value = fingerprints(words, heads)
            hit = place[np.isin(value, items.prints)]
            around = np.zeros(len(g) + 1, np.int64)
            np.add.at(around, np.clip(hit - (WINDOW - GRAM), 0, len(g)), 1)
            np.add.at(around, np.minimum(hit + 1, len(g)), -1)
            at = np.flatnonzero(np.cumsum(around[:-1]) > 0)
        at = at[at + w.n <= last[at]]
        at = at[w.near(g[at])]
        lo = np.searchsorted(w.value, g[at])
        for step in range(w.alike):
            entry = np.minimum(lo + step, len(w.value) - 1)
            x, y = at[w.value[entry] == g[at]], entry[w.value[entry] == g[at]]
            same = np.ones(len(x), bool)
            for o in range(w.n):
                i, j = x[same] + o, w.place[y[same]] + o
                size = ends[i] - starts[i]
                equal = size == items.ends[j] - items.starts[j]
                equal[equal] = same_words(code, starts[i[equal]], items.code, items.starts[j[equal]], size[equal])
                same[same] = equal
            found.append((x[same], np.full(same.sum(), w.n), set_of[y[same]]))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def _covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n words is inside any of the runs."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, start + length, -1)
    return np.cumsum(depth[:-1]) > 0


def judged(items: Items, texts: pa.Array, runs: bool = False) -> list[pa.Array]:
    """n_words, n_hit and items of each text; with runs, [from, to) of each run of hit words instead of n_hit."""
    raw, at = buffers(texts)
    words, starts, ends, heads = word_hashes(raw, at, FOLD)
    start, length, listed = occurrences(items, FOLD[raw], words, starts, ends, heads)
    covered = _covered(start, length, len(words))
    names: list[set[str]] = [set() for _ in range(len(texts))]
    doc = np.searchsorted(heads, start, "right") - 1
    for d, k in np.unique(np.stack([doc, listed]), axis=1).T.tolist() if len(start) else ():
        names[d].update(items.ids[items.sets[k]])
    shown = pa.array([sorted(x - {None}) for x in names], pa.list_(pa.string()))
    if not runs:
        hit = np.concatenate(([0], np.cumsum(covered)))
        return [pa.array(np.diff(heads)), pa.array(hit[heads[1:]] - hit[heads[:-1]]), shown]
    cut = np.zeros(len(words) + 1, bool)
    cut[heads] = True
    begin = np.flatnonzero(covered & (cut[:-1] | ~np.append(False, covered[:-1])))
    end = np.flatnonzero(covered & (cut[1:] | ~np.append(covered[1:], False))) + 1
    where = np.searchsorted(begin, heads)
    of = heads[np.searchsorted(heads, begin, "right") - 1]
    pairs = pa.StructArray.from_arrays([pa.array(begin - of), pa.array(end - of)], ["a", "b"])
    return [pa.array(np.diff(heads)), pa.ListArray.from_arrays(pa.array(where, pa.int32()), pairs), shown]


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """All columns of docs, then n_words, n_hit and items (ids as sorted strings), which must not be among them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    if size > broadcast_bytes:
        return _in_blocks(docs, items, -(-size // max(broadcast_bytes, 1)))
    return _judged(docs, items, "text", RESULT)


def _judged(docs: DataFrame, items: DataFrame, text: str, result: str) -> DataFrame:
    """The columns of docs and what its texts hold of the items, which every task gets."""
    rows = items.collect()
    shared = docs.sparkSession.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))
    names = [c.split()[0] for c in result.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = shared.value
        index = Items(ids, pa.array(texts, pa.string()))
        for batch in batches:
            for part in pieces(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, *judged(index, column(part, text), names[1] == "runs")], [*part.schema.names, *names])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), result]))


def _prints(rows: DataFrame, key: str, short: list[int], whole: bool) -> DataFrame:
    """Distinct fingerprints of each row: winnowed, and n-grams of the short lengths (of an item, only the whole)."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words, _, _, heads = word_hashes(*buffers(column(part, "text")), FOLD)
                place, value = fingerprints(words, heads)
                row = [np.searchsorted(heads, place, "right") - 1]
                out = [value]
                sizes, ends = np.diff(heads), np.repeat(heads[1:], np.diff(heads))
                for n in short:
                    g = grams(words, n)
                    at = np.arange(len(g))
                    at = heads[:-1][sizes == n] if whole else at[at + n <= ends[: len(g)]]
                    row.append(np.searchsorted(heads, at, "right") - 1)
                    out.append(g[at])
                pairs = np.unique(np.stack([np.concatenate(row).astype(np.uint64), np.concatenate(out)]), axis=1)
                yield pa.RecordBatch.from_arrays([column(part, key).take(pa.array(pairs[0].astype(np.int64))), pa.array(pairs[1].view(np.int64))], [key, "print"])

    return rows.select(key, "text").mapInArrow(run, f"{key} {kind}, print long")


def _in_blocks(docs: DataFrame, items: DataFrame, blocks: int) -> DataFrame:
    """contamination() for benchmarks of any size. Documents that share a fingerprint with an item are found by a join that
    knows nothing of the items but their distinct fingerprints; only those documents meet the items, block by block."""
    sizes = items.select(F.size(F.array_remove(F.split(F.lower(F.regexp_replace("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")), " "), "")).alias("n"))
    short = [r.n for r in sizes.where(f"n > 0 and n < {WINDOW}").distinct().collect()]
    names = docs.columns
    # a number for each row, as ids may be null or stand in several rows
    rows = hold(docs.select(F.monotonically_increasing_id().alias("doc"), "text", F.struct(*[docs[c] for c in names]).alias("row")))
    known = _prints(items.withColumn("item", F.lit(0)), "item", short, True).select("print").distinct()
    near = hold(_prints(rows, "doc", short, False).join(known, "print", "left_semi").select("doc").distinct())
    some = hold(rows.join(near, "doc", "left_semi").select("doc", "text"))
    parts = [_judged(some, items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b), "text", RUNS).drop("text") for b in range(blocks)]
    every = reduce(DataFrame.unionByName, parts).groupBy("doc").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # words inside any run: runs in order, each counted from where those before it end
    n_hit = F.expr("aggregate(runs, named_struct('k', 0L, 'upto', 0L), (s, r) -> named_struct('k', s.k + greatest(0L, r.b - greatest(r.a, s.upto)), 'upto', greatest(s.upto, r.b)), s -> s.k)")
    found = rows.select("doc", "row").join(every.select("doc", "n_words", n_hit.alias("n_hit"), "items"), "doc")
    far = _judged(rows.join(near, "doc", "left_anti"), items.limit(0), "text", RESULT).select("doc", "row", "n_words", "n_hit", "items")
    return found.unionByName(far).select("row.*", "n_words", "n_hit", "items")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark window go."""
    inner, boxed = carried(docs, {"n_words", "n_hit", "items"})
    kept = contamination(inner, table(spark, sf_dir, "benchmark")).where("n_hit = 0")
    return kept.select("row.*") if boxed else kept.select(*docs.columns)
