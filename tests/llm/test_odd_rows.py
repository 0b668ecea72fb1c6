"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names; learned parts by hand."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from reelframe.llm import bpe, common, decontaminate, licenses, pii, quality, toxicity, urls

LONG = "some long text with many words " * 60_000
ROWS = [("a", "good clean text here"), ("a", "good clean text here"), ("b", None), ("c", ""), ("d", LONG), (None, "no id"), ("e", " \n"), ("f", "🙂 漢字")]


def odd(spark, rows=ROWS):
    """String ids, and columns with the names that operators use inside."""
    return spark.createDataFrame([(*r, i, "x", 1.5, "k") for i, r in enumerate(rows)], "doc_id string, text string, y int, raw string, weight double, host string").repartition(3)


LABELS = "doc_id string, quality int, toxic int"


def labels(spark):
    return spark.createDataFrame([("a", 1, 0), ("a", 0, 1), ("d", 0, 1), ("f", 1, 0), ("c", 0, 0), ("zz", 1, 1), (None, 1, 1), ("e", None, None), ("b", 7, 7)], LABELS)


def test_quality_of_odd_rows(spark):
    df = odd(spark)
    model = quality.learn(df, labels(spark))
    out = quality.score(df, model).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == "a"}) == 1
    assert len({r.score for r in out if r.doc_id in ("b", "c")}) == 1
    assert quality.score(df.limit(0), model).count() == 0


def test_quality_by_hand(spark):
    """Sizes by a compressor made here, and the weights where the gradient of the likelihood vanishes."""
    rng = np.random.RandomState(2)
    words = {1: [f"clean{i}" for i in range(40)], 0: [f"spam{i}!!" for i in range(40)]}
    rows = [(i, " ".join(rng.choice(words[i % 2], 60)), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.learn(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    made = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(c), write_content_size=False, write_checksum=False, write_dict_id=False) for c in model.contents]
    got = {r.doc_id: r.score for r in quality.score(df.drop("quality"), model).collect()}
    for d, text, y in rows:
        raw = text.encode()
        less = sum(len(made[1].compress(raw[i : i + 1024])) - len(made[0].compress(raw[i : i + 1024])) for i in range(0, len(raw), 1024))
        assert math.isclose(got[d], 1 / (1 + math.exp(-max(-30, min(30, model.weight * less / (len(raw) + 8) + model.bias)))))
        assert (got[d] > 0.5) == (y == 1)
    x, y = rng.randn(300), rng.rand(300) < 0.4
    (w,), b = quality.logistic(x[:, None], y.astype(float), np.ones(300), ridge=0.0)
    p = 1 / (1 + np.exp(-(w * x + b)))
    assert abs((p - y).sum()) < 1e-6 and abs(((p - y) * x).sum()) < 1e-6


def test_training_blocks_are_whole_texts(spark, monkeypatch):
    """A dictionary is made of every block of the documents that it is made of, however long they are."""
    seen = []
    monkeypatch.setattr(quality, "dictionary", lambda parts: seen.append(parts) or b"".join(parts)[:1000])
    text = "".join(chr(97 + i // 1024 % 26) for i in range(26 * 1024 + 5))
    df = spark.createDataFrame([(0, text), (1, text.upper()), (2, text), (3, "short")], "doc_id long, text string")
    quality.learn(df, spark.createDataFrame([(0, 1), (1, 0), (0, 1)], "doc_id long, quality int"))
    assert [b"".join(parts) for parts in seen] == [text.encode(), text.upper().encode()]
    assert all(len(p) <= 1024 for parts in seen for p in parts)
    monkeypatch.setattr(quality, "DOCUMENTS", 5)
    many = [(i, f"text {i} " * 300) for i in range(200)]
    quality.learn(spark.createDataFrame(many, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int"))
    texts = {t for _, t in many}
    for parts in seen[2:]:
        whole = b"".join(parts).decode()
        used = {t for t in texts if t in whole}
        assert 1 <= len(used) < 40 and sum(map(len, used)) == len(whole)


def test_toxicity_of_odd_rows(spark):
    df = odd(spark)
    model = toxicity.Model(df.select("doc_id", "text"), labels(spark))
    out = model.score(df.select("doc_id", "text", "y", "weight")).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == "a"}) == 1 and len({r.score for r in out if r.doc_id in ("b", "c")}) == 1
    assert model.score(df.select("doc_id", "text").limit(0)).count() == 0


def test_toxicity_features_by_brute_force():
    lexicon = ["scum", "idiot", "trash"]
    texts = ["You are SCUM!! you idiot", "the idiot and the trash, far away from any one that is addressed here you", "", None, "1d10t sc*m idi0t tr4sh", "Ünïcode idiot 42", "nothing to see here", "you " * 50 + "idiot " * 80]
    raw, at = common.buffers(pa.array(texts))
    got = toxicity.features(raw, at, toxicity._hash(lexicon))
    word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
    read = re.compile(rb"[0-9A-Za-z\x80-\xff@$!]+")
    signs = {ord(k): ord(v) for k, v in toxicity.SIGNS.items()}
    you = {w.encode() for w in toxicity.SECOND_PERSON}
    letter = lambda b: 97 <= b <= 122 or 65 <= b <= 90 or b >= 128
    for text, row in zip(texts, got, strict=True):
        b = (text or "").encode()
        ws = [m[0].lower() for m in word.finditer(b)]
        hits = [i for i, w in enumerate(ws) if w.decode() in lexicon]
        near = sum(any(x in you for x in ws[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]) for i in hits)
        hidden = max(0, sum(bytes(signs.get(c, c) for c in m[0].lower()).decode(errors="replace") in lexicon for m in read.finditer(b)) - len(hits))
        inner = sum(letter(x) and letter(z) and (y in signs or y == 42) for x, y, z in zip(b, b[1:], b[2:], strict=False))
        n, size = max(1, len(ws)), max(1, len(b))
        marks = sum(0x20 < c < 0x7F and not chr(c).isalnum() for c in b)
        want = [len(hits) / n, min(50, len(hits)), len({ws[i] for i in hits}), near / n, hidden / n, hidden, inner / n, sum(65 <= c <= 90 for c in b) / size, marks / size, b.count(b"!") / size, sum(48 <= c <= 57 for c in b) / size, math.log1p(n)]
        assert np.allclose(row, want), (text, row, want)


def test_licenses_of_odd_rows(spark):
    notice = "Released under the MIT License."
    rows = [*ROWS, ("g", notice), ("g", notice), ("h", LONG + notice + LONG), (None, notice)]
    df = odd(spark, rows).withColumn("found", F.lit(1))
    out = [(r.doc_id, [(s.license, s.start) for s in r.found]) for r in licenses.scan(df).collect()]
    assert len(out) == len(rows)
    assert Counter(str(x) for x in out if x[1]) == Counter({"('g', [('MIT', 0)])": 2, f"('h', [('MIT', {len(LONG)})])": 1, "(None, [('MIT', 0)])": 1})
    assert licenses.scan(df.limit(0)).count() == 0
    twins = licenses.Scanner((("B", notice), ("A", notice)))
    assert [s[0] for s in twins.scan(notice)] == ["A", "B"]


def test_licenses_by_brute_force():
    """Every place where a notice stands with at most a tenth of its words changed, by trying all places."""
    rnd = np.random.RandomState(3)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES:
        notice = [w for w, _, _ in licenses.words(text)]
        free = [i for i, w in enumerate(notice) if w not in licenses.NAMES and not any(c.isdigit() for c in w) and not any(c in w for c in licenses.CUES) and 0 < i < len(notice) - 1]
        limit = int(licenses.DIFFERENCE * len(notice))
        for odd_words in {0, limit // 2, limit // 2 + 1}:
            changed = list(notice)
            for i in sorted(rnd.choice(free, min(odd_words, len(free)), replace=False), reverse=True):
                del changed[i]  # one word is missing
            body = ["license", "filler", "words", *changed, "more", "filler"]
            found = [s for s in scanner.scan(" ".join(body)) if s[0] == name and s[2] - s[1] == len(" ".join(changed))]
            gone = len(notice) - len(changed)
            assert bool(found) == (gone <= limit), (name, odd_words)
            assert not found or found[0][3] == gone and found[0][5] >= 1


def test_urls_of_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "http://x.net/"), (3, "http://x.net/" + "a1/" * 20_000), (4, "http://a.org/fr/x"), (4, "http://b.net/")]
    df = spark.createDataFrame([(*r, 1, 2.0, 3) for r in rows], "page_id long, url string, numbers int, rule double, suffix_b int")
    out = urls.judge(df).collect()
    assert sorted((str(r.page_id), str(r.rule), r.verdict) for r in out if r.rule) == [("3", "net/", "block"), ("4", "net/", "block"), ("4", "org/fr/", "allow"), ("None", "net/", "block")]
    assert len(out) == len(rows) and len({r.verdict for r in out if r.page_id == 1}) == 1
    assert urls.judge(df.limit(0)).count() == 0


def test_url_features_by_brute_force(spark):
    given = ["http://a1.b-c.example.com/x/y2/?q=1&r=2#f", "https://example.org", "", None, "ftp://u/é?", "http://" + "a" * 500 + "/" + "9" * 300]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(given)], "page_id long, url string")
    host, path = urls.parsed(F.col("url"))
    rows = df.withColumn("host", host).withColumn("path", path)
    got = {r.page_id: r for r in rows.withColumn("numbers", F.array(*urls.lexical(F.col("url"), F.col("host"), F.col("path")))).collect()}

    def entropy(t):
        return -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) if t else 0.0

    for i, u in enumerate(given):
        u, h, p = u or "", got[i].host, got[i].path
        query = (re.search(r"\?([^#]*)", u) or ["", ""])[1]
        share = lambda t: sum(c in "0123456789" for c in t) / max(1, len(t))
        want = [len(u), len(h), len(p), p.count("/"), h.count("."), share(u), share(h), h.count("-"), entropy(u), entropy(h), query.count("&") + 1 if query else 0, len(query), u.startswith("https:")]
        assert np.allclose(got[i].numbers, np.array(want, float))


def test_urls_without_a_rule_are_judged_by_their_looks(spark):
    """Trees learn from labelled hosts and judge others of the same looks, whose suffix tells nothing."""
    rnd = np.random.RandomState(6)

    def url(bad, suffix):
        host = "".join(rnd.choice(list("abcdefgh0123456789" if bad else "abcdefgh"), 22 if bad else 8))
        return f"http://{host}.{suffix}/" + ("x9/" * 5 + "?a=1&b=2&c=3" if bad else "page")

    rules = (*((f"bad{i}", "/", "block") for i in range(6)), *((f"good{i}", "/", "allow") for i in range(6)))
    rows = [(i, url(i % 2, f"{'bad' if i % 2 else 'good'}{i % 12 // 2}")) for i in range(600)] + [(1000 + i, url(i % 2, "other")) for i in range(200)]
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    assert all(r.verdict == ("block" if r.page_id % 2 else "allow") and r.rule for r in out if r.page_id < 1000)
    free = [r for r in out if r.page_id >= 1000]
    assert sum(r.verdict == ("block" if r.page_id % 2 else "allow") for r in free) >= 0.9 * len(free)


def test_suffix_rates_leave_the_row_out(spark):
    """A single labelled URL of its suffix has the rate of all, whatever its own verdict is."""
    seen = []
    real = urls.hold

    def spy(df):
        if "features" in df.columns:
            seen.extend((r.y, r.features[-2]) for r in df.collect())
        return real(df)

    pages = spark.createDataFrame([(i, f"http://only{i}.{'net' if i % 2 else 'org'}/fr/") for i in range(40)], "page_id long, url string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(urls, "hold", spy)
        urls.judge(pages).count()
    assert len({round(x, 9) for _, x in seen}) == 1 and {y for y, _ in seen} == {0.0, 1.0}


def test_decontamination_of_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [*ROWS, ("g", f"so {item} ends"), ("g", f"so {item} ends"), ("g", "other"), (None, item.upper())]
    items = spark.createDataFrame([("q", item), ("q", item), ("p", item), (None, item), ("r", None), ("s", "")], "item_id string, text string")
    for limit in (decontaminate.BROADCAST_BYTES, 0):
        out = decontaminate.contamination(odd(spark, rows).drop("y"), items, limit).collect()
        assert len(out) == len(rows)
        assert sorted((str(r.doc_id), r.n_hit, r["items"]) for r in out if r.n_hit) == [("None", 10, ["p", "q"]), ("g", 10, ["p", "q"]), ("g", 10, ["p", "q"])]


def test_pii_of_odd_rows(spark):
    rows = [*ROWS, ("g", "mail a@b.cd"), ("g", "mail a@b.cd"), (None, "mail a@b.cd"), ("h", LONG + " a@b.cd")]
    out = pii.sanitise(odd(spark, rows)).collect()
    assert len(out) == len(rows) and sorted((str(r.doc_id), len(r.spans)) for r in out if r.spans) == [("None", 1), ("g", 1), ("g", 1), ("h", 1)]


def test_terms_are_generalised_to_their_class(spark):
    rows = [(1, "NASA met Wizards and gnomes or x@y.zz", [("term_generalised", 0, 4), ("term_generalised", 9, 16), ("term_generalised", 21, 27), ("email", 31, 37)]), (2, "gone word", [("term_removed", 0, 4)]), (3, None, [])]
    df = spark.createDataFrame(rows, f"doc_id long, text string, spans {pii.SPAN}")
    got = {r.doc_id: r.new for r in df.withColumn("new", pii.rewritten(F.col("text"), F.col("spans"))).collect()}
    assert got == {1: "[ACRONYM] met [NAME] and [TERM] or [EMAIL]", 2: " word", 3: None}


def test_intermediate_tables_need_a_shared_folder():
    """On a cluster without a checkpoint folder, hold() refuses rather than writing where other executors can't read."""

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Settings:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext = Context()
        conf = Settings()

    class Frame:
        sparkSession = Session()

    with pytest.raises(ValueError, match="checkpoint"):
        common.hold(Frame())


def test_bpe_stage_with_clashing_columns(spark, tmp_path):
    """Columns of the result's names, in any letters, give way to it, and the result can be written."""
    df = spark.createDataFrame([(1, "one two", "x", 5, "y")], "doc_id long, text string, IDS string, N_Tokens int, kept string")
    out = bpe.stage_bpe(spark, df, "")
    out.write.parquet(str(tmp_path / "out"))
    assert sorted(out.columns) == ["decoded", "doc_id", "ids", "kept", "n_tokens"]
