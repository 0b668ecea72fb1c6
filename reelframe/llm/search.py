"""Ranked lexical search over bags that many documents share.

Items are a stated query set, in blocks of bounded size: a block's terms and weights go to every task, so its texts are
sent only up to ``BLOCK_BYTES``; a larger set is worked off block by block. Each document is restricted to the block's
vocabulary, inside its task, as a vector of term counts. Documents with the same vector and the same m have the same
score for every item: they are one class, found by a hash and told apart by the vectors themselves. Each class is scored
once; as its members have one score, only its smallest ids can be in a list, and they are put in by ascending doc_id.

Words are looked up by hash and compared byte by byte.

Defined results: null and empty texts have no terms; they count in no statistic and are in no list. Each row is a
document, so repeated rows are listed as often as they stand there; rows without a doc_id come after others of the same
score. Items are told apart by item_id, null included: an item's terms are those of all its distinct texts, and items
without terms have no list. Columns besides those named are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buffers, column, hold, pieces, same_words, span_hashes, table, word_hashes
from .decontaminate import FOLD

#: Documents listed for each item.
TOP = 20
#: Most bytes of item texts whose terms are sent to every task.
BLOCK_BYTES = 8 << 20
#: Most scores that a task holds at once.
CELLS = 4_000_000
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


class Vocabulary:
    """The distinct terms of a block of items, numbered, with each term's items and repeats."""

    def __init__(self, rows: DataFrame):
        self.kind = rows.schema["item_id"].dataType.simpleString()
        items = rows.toArrow()
        ids, texts = items.column("item_id"), items.column("text")
        #: Item ids of the columns in which scores are kept.
        self.ids = pc.unique(ids)
        place = {x: i for i, x in enumerate(self.ids.to_pylist())}
        held: dict[bytes, Counter] = {}
        for i, text in zip(ids.to_pylist(), texts.to_pylist(), strict=True):
            for t in TERM.findall((text or "").encode().lower()):
                held.setdefault(t, Counter())[place[i]] += 1
        terms = list(held)
        self.code = np.frombuffer(b"".join(terms), np.uint8)
        self.size = np.array([len(t) for t in terms], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.items = [np.array(list(c), np.int64) for c in held.values()]
        self.times = [np.array(list(c.values()), np.int64) for c in held.values()]
        hashes = span_hashes(self.code, self.start, self.start + self.size)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        #: How many terms may have one hash.
        self.alike = int(np.unique(hashes, return_counts=True)[1].max(initial=0))

    def numbers(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words that are terms, and the number of each one's term."""
        at, where, term = np.searchsorted(self.hashes, hashes), [], []
        for step in range(self.alike):
            near = np.minimum(at + step, len(self.hashes) - 1)
            word = np.flatnonzero(self.hashes[near] == hashes)
            number = self.order[near[word]]
            same = ends[word] - starts[word] == self.size[number]
            word, number = word[same], number[same]
            same = same_words(code, starts[word], self.code, self.start[number], self.size[number])
            where.append(word[same])
            term.append(number[same])
        return np.concatenate(where), np.concatenate(term)


def bags(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """doc_id, n (terms of the whole text, repeats included), and the vocabulary's terms in it with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                raw, at = buffers(column(part, "text"))
                hashes, starts, ends, heads = word_hashes(raw, at, FOLD)
                place, term = words.numbers(FOLD[raw], starts, ends, hashes)
                doc = np.searchsorted(heads, place, "right") - 1
                key, count = np.unique(doc * len(words.size) + term, return_counts=True)
                cuts = pa.array(np.searchsorted(key, np.arange(part.num_rows + 1) * len(words.size)), pa.int32())
                listed = lambda x: pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(np.diff(heads), pa.int64()), listed(key % len(words.size)), listed(count)], ["doc_id", "n", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, counts array<int>")


def classes(held: DataFrame, m, top: int = TOP) -> DataFrame:
    """One row for each vector and m: the smallest ids of its documents in ascending order, as many as one list may take.

    The ids are cut before they are shuffled as well, so a class of very many copies is no task's group."""
    by = ["hash", "m", "terms", "counts"]
    rows = held.where(F.size("terms") > 0).select(F.xxhash64(m, "terms", "counts").alias("hash"), m.alias("m"), "terms", "counts", "doc_id")
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(F.asc_nulls_last("doc_id")))).where(F.col("k") <= top)
    return first.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("k", "doc_id"))).alias("x")).select("m", "terms", "counts", F.col("x.doc_id").alias("members"))


def best(rows: DataFrame, words: Vocabulary, weights: np.ndarray, top: int = TOP) -> DataFrame:
    """item_id, score and members of the classes that may stand in an item's list, out of those that a task sees
    together: the best ones, equal scores by their smallest id."""
    columns = len(words.ids)

    def scores(part: pa.RecordBatch) -> np.ndarray:
        terms, counts = column(part, "terms"), column(part, "counts")
        row = np.repeat(np.arange(part.num_rows), np.diff(terms.offsets.to_numpy()))
        term, tf = terms.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
        share = 1_000_000_000 * tf // (1000 * tf + 12 * column(part, "m").to_numpy()[row])
        order = np.argsort(term, kind="stable")
        out = np.zeros((part.num_rows, columns), np.int64)
        for at in np.split(order, np.flatnonzero(np.diff(term[order])) + 1):
            t = term[at[0]]
            out[np.ix_(row[at], words.items[t])] += share[at][:, None] * (weights[t] * words.times[t])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.ones(columns, np.int64)  # what an item's list asks for, by the classes seen so far
        step = max(1, CELLS // columns)
        for batch in batches:
            for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                smallest = pc.list_element(column(part, "members"), 0)
                part = part.take(pc.sort_indices(smallest, null_placement="at_end"))
                found = scores(part)
                item, row = [], []
                for i in range(columns):
                    good = np.flatnonzero(found[:, i] >= least[i])
                    if len(good) >= top:
                        good = good[np.argsort(-found[good, i], kind="stable")[:top]]
                        least[i] = found[good[-1], i]
                    item.append(np.full(len(good), i))
                    row.append(good)
                item, row = np.concatenate(item), np.concatenate(row)
                yield pa.RecordBatch.from_arrays([words.ids.take(pa.array(item)), pa.array(found[row, item]), column(part, "members").take(pa.array(row))], ["item_id", "score", "members"])

    members = rows.schema["members"].dataType.simpleString()
    return rows.mapInArrow(run, f"item_id {words.kind}, score long, members {members}")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of each item's best documents."""
    texts = items.select("item_id", "text").distinct()
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    kinds = {c: t.schema[c].dataType.simpleString() for c, t in (("item_id", items), ("doc_id", docs))}
    n_docs = n_terms = None
    lists = []
    for b in range(blocks):
        words = Vocabulary(texts.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b))
        if not len(words.size):
            continue
        held = hold(bags(docs, words))
        if n_docs is None:
            n_docs, n_terms = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(words.size), np.int64)
        for term, df in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a block's terms at most
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        m = F.lit(75) + F.expr(f"(25 * n * {n_docs}L) div {max(n_terms, 1)}L")
        lists.append(best(classes(held, m, top), words, weights, top))
    if not lists:
        return docs.sparkSession.createDataFrame([], f"item_id {kinds['item_id']}, rank int, doc_id {kinds['doc_id']}, score long")
    found = reduce(DataFrame.unionByName, lists).select("item_id", F.explode("members").alias("doc_id"), "score")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
