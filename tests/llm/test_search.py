"""Ranked search against brute force: blocks of items, classes of copies, ties, odd rows."""

import math
import random
import re
from collections import Counter

import pyarrow.parquet as pq

from reelframe.llm import search

from ..conftest import DATA
from . import brute


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", brute.low(text))


def ranked(docs, items, top=20):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    want = {}
    for item, text in set(items):
        want.setdefault(item, Counter()).update(terms(text))
    out = set()
    for item, q in want.items():
        found = []
        for d, b, n in bags:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t, r in q.items() if t in b)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        found.sort()
        out |= {(item, i, d, -s) for i, (s, _, _, d) in enumerate(found[:top], 1)}
    return out


def test_search(spark):
    t = pq.read_table(f"{DATA}/documents.parquet").to_pydict()
    b = pq.read_table(f"{DATA}/benchmark.parquet").to_pydict()
    rnd = random.Random(12)
    docs = [*zip(t["doc_id"], t["text"], strict=True), (90000, None), (90001, ""), (90002, " ,;"), (None, t["text"][0]), (None, t["text"][0]), (90003, "The the THE É é"), (90003, "the and of"), (90004, "the " * 30_000)]
    docs += [(91000 + rnd.randint(0, 500), "that and of it") for _ in range(120)]  # one class of many copies
    docs += [(92000 + i, " ".join(rnd.choices(["that", "and", "of", "it"], k=4))) for i in range(150)]  # many ties
    items = [*zip(b["item_id"], b["text"], strict=True), (900, "that and of it it"), (901, None), (902, "..."), (903, "nowherefound"), (None, "and of"), (900, "that and of it it"), (904, "É the"), (904, "in and")]
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n int, terms string").repartition(5)
    qs = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    want = ranked(docs, items)
    assert any(i == 900 and r == 20 for i, r, *_ in want)
    for block, cells in ((search.BLOCK_BYTES, search.CELLS), (1500, 40)):
        search_cells, search.CELLS = search.CELLS, cells
        try:
            got = [tuple(r) for r in search.search(df, qs, block_bytes=block).select("item_id", "rank", "doc_id", "score").collect()]
        finally:
            search.CELLS = search_cells
        assert len(got) == len(want) and set(got) == want


def test_ids_as_strings_and_short_lists(spark):
    docs = [("b", "one two"), ("a", "two one"), ("c", "two"), ("d", "three")]
    items = [("x", "two"), ("y", "three three")]
    got = search.search(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string"), top=2).collect()
    assert {(r.item_id, r["rank"], r.doc_id) for r in got} == {("x", 1, "c"), ("x", 2, "a"), ("y", 1, "d")}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs, items.where("item_id = 2"))):
        out = search.search(d, i)
        assert out.collect() == [] and out.columns == ["item_id", "rank", "doc_id", "score"]
