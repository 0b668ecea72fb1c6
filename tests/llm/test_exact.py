"""Operators that have an exact answer, against brute force: PII, decontamination, BPE, both kinds of near-dedup."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from reelframe.llm import bpe, components, decontaminate, embeddings, minhash, pii

from ..conftest import DATA
from . import brute


@pytest.fixture(scope="module")
def corpus():
    t = pq.read_table(f"{DATA}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"], strict=True))


ODD = [(90000, None), (90001, ""), (90002, " \n\t"), (90003, "One"), (90004, "one"), (90005, "🙂 é " * 20), (90006, "a" * 100_000), (90007, "1." * 20_000), (90008, "x@y.zz " * 500)]


def docs(spark, rows):
    """With columns whose names clash with what the operators use inside."""
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, same string, n long").repartition(3)


def test_pii(spark, corpus):
    rnd = random.Random(2)
    bits = ["a", "b.", "@", "x.y", "-", "+1", "23", "255.", "256.0.1.1 ", " ", "4111 1111 1111 1111", "(", "é🙂", "+44 20 7946 0958", "0005.1.2.3", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8"]
    rows = [*corpus, *ODD, *((95000 + i, "".join(rnd.choices(bits, k=rnd.randint(0, 25)))) for i in range(300))]
    out = pii.sanitise(docs(spark, rows)).select("doc_id", "text", pii.listed(pii._spans()).alias("base"), pii.listed("spans").alias("spans")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.base == ",".join(f"{k}:{a}:{b}" for k, spans in brute.private(r.text).items() for a, b in spans)
        assert r.spans.startswith(r.base)


def test_pii_terms(spark):
    """A rare word that keeps company with an address in several texts goes; words that stand everywhere stay."""
    told = [(i, f"report {i} says that wizard{'' if i else 's'} reach boss@corp.org about item number {i * 7}") for i in range(6)]
    told = [(i, t.replace("wizards", "wizard")) for i, t in told]
    other = [(100 + i, f"report {i} says that people reach someone about item number") for i in range(60)]
    rows = {r.doc_id: r for r in pii.sanitise(docs(spark, told + other)).withColumn("new", pii.rewritten("text", "spans")).collect()}
    for i, t in told:
        terms = [t[s.start : s.end] for s in rows[i].spans if s.kind.startswith("term")]
        assert terms == ["wizard"]
        assert rows[i].new == t.replace("wizard", "").replace("boss@corp.org", "[EMAIL]")
    assert all(not rows[d].spans for d, _ in other)


def test_pii_terms_far_from_the_value(spark):
    """A word counts wherever it stands in a text with the value, and goes from texts without the value and without id too."""
    gap = "and some other words that everyone has in between " * 3
    told = [(i if i else None, f"wizard {gap} report {i} reach boss@corp.org about it") for i in range(6)]
    other = [(100 + i, f"{gap} report {i} says about reach and it") for i in range(400)]
    rows = [*told, *other, (900, f"the wizard alone {gap}"), (901, "joe@x.net has a gadget"), (902, "joe@x.net has a gadget too")]
    got = {r.text: [r.text[s.start : s.end] for s in r.spans if s.kind.startswith("term")] for r in pii.sanitise(docs(spark, rows)).collect()}
    assert len(got) == len(rows) and {t: w for t, w in got.items() if w} == {t: ["wizard"] for _, t in [*told, rows[-3]]}


def test_decontamination(spark, corpus):
    t = pq.read_table(f"{DATA}/benchmark.parquet").to_pydict()
    items = [*zip(t["item_id"], t["text"], strict=True), (900, "the and"), (901, ""), (902, None), (903, "The for of"), (0, t["text"][0])]
    rows = [*corpus, *ODD]
    want = brute.contaminated(rows, items)
    assert sum(n > 0 for _, n, _ in want.values()) > 3
    for limit in (decontaminate.BROADCAST_BYTES, 3000):  # sent to the tasks, and joined by fingerprint
        out = decontaminate.contamination(docs(spark, rows).drop("n"), spark.createDataFrame(items, "item_id long, text string"), limit).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in out} == want


def test_decontamination_of_repetitive_texts(spark):
    """Equal words over and over, in documents and items, whichever way they meet; and a stock phrase in every item."""
    stock = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    items = [(1, "a " * 60), (2, "a b " * 30), (3, "0 " * 12), (4, "a a a"), *((10 + i, f"{stock} item {i} says so and more words follow here {i}") for i in range(40))]
    rows = [(0, "a " * 400), (1, "b a " * 200), (2, "a b a a " * 100), (3, "0 0 0 1 " * 90), (4, stock), (5, f"x {stock} x " * 20), (6, "a a"), (7, "0 " * 11)]
    want = brute.contaminated(rows, items)
    assert want[0][1] == 400 and len(want[5][2]) >= 40
    for limit in (decontaminate.BROADCAST_BYTES, 900):
        out = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), limit).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in out} == want


def test_decontamination_of_very_long_repetitive_texts():
    """100,000 equal words against an item of 10,000: seconds, and little memory."""
    started = time.time()
    index = decontaminate.Items(["i", "j"], pa.array(["a " * 10_000, "a b " * 5_000]))
    n_words, n_hit, items = decontaminate.judged(index, pa.array(["a " * 100_000, "b a " * 50_000, "c " * 100_000]))
    assert n_words.to_pylist() == [100_000] * 3 and n_hit.to_pylist() == [100_000, 100_000, 0] and items.to_pylist() == [["i"], ["j"], []]
    assert time.time() - started < 20


def test_decontamination_without_ids(spark, corpus):
    """Items without an id mark words and documents without one are judged, whichever way the texts meet."""
    t = pq.read_table(f"{DATA}/benchmark.parquet").to_pydict()
    items = [*zip(t["item_id"], t["text"], strict=True), (None, "alpha beta gamma"), (None, corpus[0][1]), (7000, corpus[1][1])]
    texts = [*(x for _, x in corpus[:40]), "so alpha beta gamma said", "alpha beta", None, *t["text"][:3], *t["text"][:3]]
    want = brute.contaminated(list(enumerate(texts)), items)
    assert want[0][1] and not want[0][2] and want[1][2] == ["7000"] and want[40][1:] == (3, [])
    rows = [(i if i % 2 and i > 1 else None, x) for i, x in enumerate(texts)]
    for limit in (decontaminate.BROADCAST_BYTES, 3000):
        out = decontaminate.contamination(docs(spark, rows).drop("n"), spark.createDataFrame(items, "item_id long, text string"), limit).collect()
        assert sorted((str(r.doc_id), str(r.text), r.n_words, r.n_hit, r["items"]) for r in out) == sorted((str(d), str(x), *want[i]) for i, (d, x) in enumerate(rows))


def test_winnowing_finds_every_long_span():
    rng = np.random.RandomState(0)
    shared = rng.randint(0, 2**62, 10).astype(np.uint64)
    for _ in range(200):
        a, b = (np.concatenate([rng.randint(0, 2**62, rng.randint(0, 9)).astype(np.uint64), shared, rng.randint(0, 2**62, rng.randint(0, 9)).astype(np.uint64)]) for _ in range(2))
        x, y = (decontaminate.fingerprints(w, np.array([0, len(w)]))[1] for w in (a, b))
        assert np.intersect1d(x, y).size


def test_bpe_equals_the_library(spark, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary())
    rnd = random.Random(1)
    letters = "aAbBzİΣσςßéÉ'st revelm \t\n\x1c\x85  ́²½Ⅷ٣漢🙂!?-_<|endoftext|>\0"
    rows = [*corpus, *ODD, (90100, "<|endoftext|>x<|startoftext|>"), (90101, "\0<|endoftext|>"), *((91000 + i, "".join(rnd.choices(letters, k=rnd.randint(0, 40)))) for i in range(300))]
    out = {r.doc_id: r for r in bpe.digests(docs(spark, rows), bpe.vocabulary()).collect()}
    real = {r.doc_id: r for r in bpe.encode(docs(spark, rows), bpe.vocabulary()).collect()}
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = " ".join(map(str, ids))
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (out[d].n_tokens, out[d].ids_sha256) == (len(ids), hashlib.sha256(text.encode()).hexdigest())
        assert out[d].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
        assert (real[d].ids, real[d].decoded) == (text, decoded)


def test_minhash(spark, corpus):
    rows = [*corpus, *ODD]
    out = minhash.near_duplicates(docs(spark, [*rows, rows[0]]), 2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute.near_texts(rows, 2)
    assert len(out) == len(rows) + 1


def test_minhash_of_borderline_groups(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", 16)
    rng = np.random.RandomState(3)
    rows = []
    for i in range(200):
        w = [f"{'wv'[i % 2]}{j}" for j in range(120 - 30 * (i % 2))]
        for p in rng.randint(0, len(w), rng.randint(0, 9)):
            w[p] = f"x{rng.randint(9999)}"
        rows.append((i, " ".join(w)))
    out = minhash.near_duplicates(docs(spark, rows), 2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute.near_texts(rows, 2)


def test_sketch_never_exceeds_the_difference():
    rng = np.random.RandomState(5)
    for _ in range(100):
        a = np.unique(rng.randint(0, 2**62, rng.randint(1, 900)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.rand(len(a)) < 0.8], rng.randint(0, 2**62, rng.randint(1, 300)).astype(np.uint64)]))
        x, y = (np.frombuffer(minhash.sketch(s), np.uint8) for s in (a, b))
        size = min(len(x), len(y))
        assert np.bitwise_count(minhash.fold_sketch(x, size) ^ minhash.fold_sketch(y, size)).sum() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize(("block", "leaf"), [(2048, 128), (32, 8)])
def test_embeddings(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "LEAF", leaf)
    rng = np.random.RandomState(1)
    centres = rng.randn(5, 16)
    rows = [(i, i % 3 if i % 17 else None, [float(x) for x in centres[i % 5] + rng.randn(16) * rng.choice([0, 0.001, 0.2])]) for i in range(400)]
    rows += [(700, 1, None), (701, 1, []), (702, 1, [0.0] * 16), (703, 1, [float("nan")] * 16), (704, 1, [None] * 16), (705, 1, [1.0, 2.0]), (706, 1, [2.0, 4.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, n string")
    out = embeddings.near_duplicates(df, 0.93).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == brute.near_vectors(rows, 0.93)


def test_components(spark):
    rng = random.Random(7)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500 + i, 501 + i) for i in range(40)] + [(700, 700 + i) for i in range(50)]
    groups = brute.Sets(1000)
    for a, b in links:
        groups.join(a, b)
    least = groups.least(list(range(1000)))
    nodes = {x for a, b in links if a != b for x in (a, b)}
    out = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {n: least[n] for n in nodes}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(docs(spark, ODD).drop("n"), items).where("n_hit > 0").count() == 0
    assert pii.sanitise(none).count() == 0
    assert bpe.digests(none, bpe.vocabulary()).count() == 0
    assert minhash.near_duplicates(none, 2).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def test_pii_terms_equal_the_sql(spark):
    import duckdb
    import pandas as pd

    from reelframe.llm import queries

    rnd = random.Random(2)
    bits = ["a", "b.", "@", "x.y", "-", "+1", "23", "255.", "256.0.1.1 ", " ", "4111 1111 1111 1111", "é🙂", "+44 20 7946 0958", "a@b.c_d@e.f"]
    rows = [(i, f"report {i} says that wizard reach boss@corp.org about itemé number {i * 7}") for i in range(6)]
    rows += [(100 + i, f"report {i} says that people reach someone about itemé number") for i in range(60)]
    gap = "and other words that all of them have in between somewhere " * 4
    rows += [(300 + i, f"goblin {gap} says so number {i} to call 1.2.3.4 now") for i in range(8)] + [(320 + i, f"{gap} goblin number {i}") for i in range(1)]
    rows += [(400 + i, f"{gap} says so number {i} to call someone now") for i in range(200)]
    rows += [(1000 + i, "".join(rnd.choices(bits, k=rnd.randint(0, 25)))) for i in range(300)] + ODD[:5]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = {r[0]: r[-1] for r in con.execute(queries.ORACLES["op1_pii"]).fetchall()}
    assert sum("term_removed" in x for x in want.values()) == 6 and sum("term_generalised" in x for x in want.values()) == 9
    assert {r.doc_id: r.spans for r in pii.found(docs(spark, rows)).select("doc_id", pii.listed("spans").alias("spans")).collect()} == want
    assert {r.doc_id: r.spans for r in pii.sanitise(docs(spark, rows)).select("doc_id", pii.listed("spans").alias("spans")).collect()} == want


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


def test_words_that_collide_under_polynomials(spark):
    """The Thue-Morse word and its complement have the same polynomial hash modulo 2**64 for any odd base."""
    x, y = thue_morse(1024)
    short = [x[:64], y[:64]]
    rows = [(1, x), (2, y), (3, x), (4, short[0]), (5, short[1])]
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows), 2).collect()}
    assert out == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    rest = " one two three four five six seven eight nine"
    for limit in (decontaminate.BROADCAST_BYTES, 3000):
        found = decontaminate.contamination(docs(spark, [(1, x + rest), (2, y + rest)]).drop("n"), spark.createDataFrame([(9, x + rest)], "item_id long, text string"), limit)
        assert {r.doc_id: r.n_hit for r in found.collect()} == {1: 10, 2: 0}


def test_links_are_confirmed_on_words(spark, monkeypatch):
    """With hashes that tell few words apart, candidates abound, and the words themselves decide."""
    from reelframe.llm import common

    raw = np.frombuffer(b"ab cd ab ef ab cd gh", np.uint8)
    hashes, starts, ends, _ = common.word_hashes(raw, np.array([0, len(raw)]), minhash.FOLD)
    want = [0, 1, 0, 2, 0, 1, 3]
    for h in (hashes, hashes % np.uint64(2), np.zeros_like(hashes)):
        got = common.numbered(minhash.FOLD[raw], starts, ends, h)
        assert [[i == j for j in got] for i in got] == [[i == j for j in want] for i in want]
    monkeypatch.setattr(decontaminate, "word_hashes", lambda *a: (common.word_hashes(*a)[0] % np.uint64(3), *common.word_hashes(*a)[1:]))
    rnd = random.Random(4)
    words = ["red", "blue", "green", "grey", "black", "white"]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 14)))) for i in range(8)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 40))) for _ in range(30)] + [f"red {items[3][1]} grey"]
    import pyarrow as pa

    index = decontaminate.Items([str(i) for i, _ in items], pa.array([t for _, t in items]))
    got = list(zip(*(x.to_pylist() for x in decontaminate.judged(index, pa.array(texts))), strict=True))
    want = brute.contaminated(list(enumerate(texts)), items)
    assert got == [want[i] for i in range(len(texts))]


@pytest.mark.parametrize("k", [1, 2, 3, 5, 6])
def test_exact_sets(k):
    import pyarrow as pa

    rnd = random.Random(k)
    texts = [" ".join(rnd.choices("ab", k=rnd.randint(0, 12))) for _ in range(60)] + [None, "", "A b", "\0 a"]
    want = []
    for t in texts:
        w = brute.low(t).split()
        want.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    got = minhash.exact_sets(pa.array(texts), k)
    for s, x in zip(got, want, strict=True):
        for t, y in zip(got, want, strict=True):
            assert len(s) == len(x) and len(np.intersect1d(s, t)) == len(x & y)


def test_near_dedup_of_odd_ids(spark):
    """String ids, null ids, one id with two texts, and copies that are more than a thousandth of all rows."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [("b", base), ("a", base + " more"), ("c", "other text here"), ("c", base), (None, base), ("d", None), ("e", None)]
    rows += [(f"z{i:03}", "copied text of many rows") for i in range(200)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id string, text string, component int").repartition(3)
    out = minhash.near_duplicates(df, 2).collect()
    assert len(out) == len(rows)
    got = {(r.doc_id, r.n_shingles): r.component_id for r in out}
    assert got[("a", 60)] == got[("b", 59)] == got[("c", 59)] == got[("c", 2)] == "a"
    assert got[(None, 59)] is None and got[("d", 0)] == "d" and got[("e", 0)] == "e"
    assert {c for (d, _), c in got.items() if d and d.startswith("z")} == {"z000"}


def test_bpe_forgets_old_words(spark, corpus, monkeypatch):
    """With a word table far too small, and with columns of the names used inside, the ids stay the same."""
    monkeypatch.setattr(bpe, "WORDS_KEPT", 5)
    codec = bpe.Codec(bpe.vocabulary())
    texts = [t or "" for _, t in corpus[:60]]
    small = [x for i in range(0, 60, 7) for x in codec.encode(texts[i : i + 7])]
    monkeypatch.setattr(bpe, "WORDS_KEPT", 10**6)
    assert small == list(bpe.Codec(bpe.vocabulary()).encode(texts))
    df = spark.createDataFrame([(1, "a text", 7), (1, "a text", 7), (2, None, 8)], "doc_id long, text string, __text int").withColumnRenamed("__text", "__0")
    df = df.withColumn("__text", F.lit("x")).withColumn("ids", F.lit(5))
    out = bpe.encode(df, bpe.vocabulary(), keep=("doc_id", "__0", "__text")).collect()
    assert sorted((r.doc_id, r["__0"], r["__text"], r.n_tokens) for r in out) == [(1, 7, "x", 2), (1, 7, "x", 2), (2, 8, "x", 0)]
