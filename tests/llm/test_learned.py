"""Operators with a learned part: held-out accuracy, and brute force for what is exact."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelframe.llm import language, licenses, quality, queries, toxicity, urls

SF = "/root/testdata/sf0.01"


def held(doc_id, modulus, remainder):
    return zlib.crc32(str(doc_id).encode()) % modulus == remainder


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_language(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.QUERIES["op9_language_id"](spark, SF).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == held(r.doc_id, 5, 0) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.98 * len(out)


def test_language_of_odd_texts(spark):
    model = language.Model({"xx": "abc abd " * 50, "yy": "uvw uvx " * 50, "zz": "123"})
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (4, "abd ABC"), (5, "uvx" * 30_000), (6, "é")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(df, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[4][0] == "xx" and got[5][0] == "yy" and got[6][0] in ("xx", "yy")
    assert language.predict(df, language.Model({})).where("lang_pred <> 'und'").count() == 0


def parsed(source, text):
    """Number of longest phrases of bytes, by searching the training text."""
    n = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in source:
            end += 1
        n, at = n + 1, end
    return n


@pytest.mark.parametrize("few", [0, 3, 1000])
def test_phrases_by_brute_force(monkeypatch, few):
    """Longest matches in the training text; a symbol that it lacks is a phrase of its own. Texts in step or alone."""
    monkeypatch.setattr(language, "FEW", few)
    text = "the cat sat on the mat and the rat sat on the cat"
    sources = tuple(t.encode() for t in (text, text[::-1], "漢字かな 漢字"))
    given = [t.encode() for t in ("", "the cat on the rat", "zebra cats sat", "x", "the mat " * 100, text * 3, "漢字 the かな", "日本", "")]
    if few == 0:
        given.append(b"t")
    got = language.Parser(sources).count(given)
    assert got.tolist() == [[parsed(s, t) for s in sources] for t in given]


def test_language_by_brute_force(spark):
    """The prediction is the language of the fewest phrases times log2 of the training length, by name where equal."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where("doc_id < 150")
    model = language.learn(rows)
    assert model.langs == ["de", "en", "es", "fr"] and all(len(t) > 2000 for t in model.texts)

    for r in language.predict(rows, model).where("doc_id < 40").collect():
        symbols = re.sub(r"[^a-zà-ÿœ]+", " ", (r.text or "").lower()).strip().encode()
        if len(symbols) < 3000:
            costs = [parsed(t, symbols) * np.log2(len(t) + 2) for t in model.texts]
            assert r.lang_pred == (model.langs[int(np.argmin(costs))] if symbols else "und")


def test_signs_that_are_no_letters(spark):
    """Fractions, circled and Roman number signs have no letter; letters of any script do."""
    model = language.learn(spark.createDataFrame([("a", "some words here", "en"), ("b", "ein paar worte", "de")], "doc_id string, text string, lang string"))
    rows = [("½ ²",), ("①",), ("Ⅷ 12 _",), ("٣",), ("x²",), ("é",), ("日本",), ("",), (None,)]
    got = [r.lang_pred != "und" for r in language.predict(spark.createDataFrame(rows, "text string").coalesce(1), model).collect()]
    assert got == [False, False, False, False, True, True, True, False, False]


def test_language_stage_without_lang(spark):
    df = spark.createDataFrame([(1, "some words"), (2, "½ ②"), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in language.stage_language(spark, df, "").collect()] == [1]


def test_language_sample_is_bounded(spark):
    """One long text doesn't crowd out the others; repeated rows, string ids, ties and an empty table."""
    rows = [("a", "long words " * 90_000, "xx"), *((f"b{i}", f"kurze texte nummer {'abcdefgh'[i % 8]}", "xx") for i in range(20)), *[("c", "otro", "yy")] * 50, (None, "none", "zz"), ("d", None, "zz")]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    model = language.learn(df)
    assert model.langs == ["xx", "yy"] and b"kurze" in model.texts[0] and len(model.texts[0]) < 2000 and model.texts[1] == b"otro"
    assert len({(r.lang_pred, r.score) for r in language.predict(df, model).where("doc_id = 'c'").collect()}) == 1
    assert language.predict(df.limit(0), model).count() == 0
    twins = language.Model({"b": "same text", "a": "same text"})
    assert {r.lang_pred for r in language.predict(df.where("doc_id = 'd' or doc_id = 'c'"), twins).collect()} == {"a", "und"}


def test_quality(spark, labels):
    rows = queries.QUERIES["op3_quality"](spark, SF).collect()
    assert all(r.held_out == held(r.doc_id, 3, 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    out = [(r.predicted, labels[r.doc_id].quality) for r in rows if r.held_out and r.doc_id in labels]
    good = [p for p, y in out if y == 1]
    assert sum(p == y for p, y in out) >= 0.95 * len(out) and sum(good) >= 0.98 * len(good)


def test_toxicity(spark, labels):
    rows = queries.QUERIES["op7_toxicity"](spark, SF).collect()
    assert all(r.held_out == held(r.doc_id, 5, 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    out = [(r.predicted, labels[r.doc_id].toxic) for r in rows if r.held_out and r.doc_id in labels]
    clean = [p for p, y in out if y == 0]
    assert sum(p == y for p, y in out) >= 0.9 * len(out) and sum(clean) <= 0.05 * len(clean)


def test_models_without_labels(spark):
    df = spark.createDataFrame([(1, None), (2, "text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(df, quality.learn(df, none)).collect()} == {0.5}
    assert {r.score for r in toxicity.Model(df, none).score(df).collect()} == {0.0}


def test_urls(spark):
    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, None)))

    odd = [(90000, None), (90001, ""), (90002, "nothing"), (90003, "http://A.EXAMPLE.net"), (90004, "http://x.net/en/?a=b#c"), (90005, "s://sub.example.com/de/#/fr/"), (90006, "http://myexample.net/en/"), (90007, "ftp://net/"), (90008, "http://h?x=/de/"), (90009, "a://b://net/"), (90010, "http://É.Org/fr/\nx")]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame(odd, "page_id long, url string"))
    given = {r.page_id: r.url for r in pages.collect()}
    rows = urls.judge(pages.withColumn("host", F.lit("clash")).withColumn("suffix", F.lit(1))).collect()
    assert len(rows) == len(given)
    for r in rows:
        host, path, rule, verdict = brute(given[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert urls.judge(spark.createDataFrame(odd[:3], "page_id long, url string")).where("verdict <> 'allow'").count() == 0


def test_licenses(spark):
    rows = {r.doc_id: r for r in queries.QUERIES["op8_license_scan"](spark, SF).collect()}
    lines = {t: n for n, t in licenses.TEMPLATES if "\n" not in t}
    for d in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        want = {(n, d.text.find(t)) for t, n in lines.items() if t in d.text}
        got = {(s.split(":")[0], int(s.split(":")[1])) for s in rows[d.doc_id].spans.split(",") if s}
        assert want <= got and len(got) == len(want)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("licensed under the Apache license version 2.0", ["Apache-2.0"]),
        ("Licensed under the Apache License, Version 1.1.", []),
        ("This work is licensed under\nthe GNU General Public License, version 3.", ["GPL-3.0"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("My licence to drive", []),
        ("x " * 9000 + "Released under the MIT License." + " y" * 9000, ["MIT"]),
        ("", []),
    ],
)
def test_license_wordings(text, found):
    assert [s[0] for s in licenses.Scanner(licenses.TEMPLATES).scan(text)] == found


def test_every_notice_of_a_line():
    """All notices of one line, second copies too, with odd words and among other text."""
    scanner, short = licenses.Scanner(licenses.TEMPLATES), [t for t in licenses.TEMPLATES if len(t[1]) < 100]
    line = " ".join(t for _, t in short * 2)
    got = scanner.scan(line)
    assert len(short) == 10 and [(s[0], line[s[1] : s[2]]) for s in got] == [(n, t.rstrip(".")) for n, t in short * 2]
    filler = "the license holder may copy the software and this permission to use the work under the terms of the license is granted to any person provided that copies of the software keep the copyright notice "
    for name, text in licenses.TEMPLATES:
        whole = filler * 8 + text + " " + filler * 8
        assert [(s[0], s[1], s[3]) for s in scanner.scan(whole) if s[0] == name] == [(name, len(filler) * 8, 0)]
    name, text = next(t for t in licenses.TEMPLATES if t[0] == "ISC")
    changed = text.replace("modify, and/or", "modify and also").replace("granted", "hereby granted")
    line = filler * 3 + changed + " " + filler + text
    assert [(s[0], line[s[1] : s[2]], s[3]) for s in scanner.scan(line)] == [(name, changed.rstrip("."), 3), (name, text.rstrip("."), 0)]
