"""Readers, published tables and incremental operators on small files."""

import json
import random
import time

import pandas as pd
import pytest
from pyspark import TaskContext
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from reelframe.operators import layers, photos, presence, publish, records, validation
from reelframe.sources import documents
from reelframe.streaming import incremental
from reelframe.streaming.ledger import Ledger


def test_film_documents(spark, tmp_path):
    for film, content in {"a": json.dumps({"film": "A", "plans": [{"n": 1, "debut": 0, "fin": 2, "analyse": {"echelle": "gros plan", "mots_cles": ["x"]}, "other": 1}]}), "b": '{"film": "B", "plans": [', "c": ""}.items():
        (tmp_path / film).mkdir()
        (tmp_path / film / "plans.json").write_text(content)
    docs = documents.film_documents(spark, str(tmp_path)).cache()
    assert [(r.film_id, r.n, r.analyse.echelle) for r in documents.shots(docs).collect()] == [("a", 1, "gros plan")]
    assert [r.film_id for r in documents.quarantined(docs).collect()] == ["b"]
    flat = publish.flattened(documents.shots(docs)).first()
    assert (flat.echelle, flat.lieu, flat.machine, flat.timecode) == ("gros plan", "", False, "00:00:00.000")
    assert documents.film_documents(spark, str(tmp_path), "a").count() == 1


def test_subtitles(spark):
    srt = "1\r\n00:00:01,500 --> 00:00:03,000 X1:0\r\n<i>Bonjour</i>\r\n{\\an8}vous\r\n\r\nbad --> stamp\nx\n\n00:00:05,000 --> 00:00:06,000\n\n3\n00:01:00,000 --> 00:01:02,250\nlast"
    got = [tuple(r) for r in documents.subtitles(spark.createDataFrame([("f", srt)], "film_id string, value string")).collect()]
    assert got == [("f", 1.5, 3.0, "Bonjour vous"), ("f", 60.0, 62.25, "last")]


def test_markup_and_names(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(documents.plain_text(F.lit("'''Film''' <!-- x -->{{a|{{b}}}} by [[John Doe|Doe]]<ref>r</ref> &amp; co"))) == "Film by Doe & co"
    assert one(documents.names(F.lit("Ann Lee (writer), Bob Ray\n* Ann Lee | X 9"))) == ["Ann Lee", "Bob Ray"]
    title, year = documents.title_and_year(F.lit("The Night (1971).mkv"))
    assert (one(title), one(year)) == ("The Night", 1971)


def test_listing_and_progress(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("a.MKV", "d/b.mp4", ".hidden.mp4", "c.txt"):
        (tmp_path / name).write_text("x")
    got = {r.path.rsplit("/", 1)[1] for r in documents.media_listing(spark, str(tmp_path), [".mkv", ".mp4"]).collect()}
    assert got == {"a.MKV", "b.mp4"}
    lines = spark.createDataFrame([("j", 1, "[1/4] a"), ("j", 2, "[4/4] b"), ("j", 3, "done"), ("k", 1, "[1/3] c")], "job string, line_no int, value string")
    assert {r.job: (r.percent, r.finished) for r in documents.job_progress(lines, r"\[(\d+)/(\d+)\]").collect()} == {"j": (100, True), "k": (33, False)}


def test_selection(spark):
    shots = spark.createDataFrame([("f", 1), ("f", 2)], "film_id string, n long")
    ids = spark.createDataFrame([(1, "f#2"), (2, "f#1"), (3, "f#2")], "pos int, id string")
    assert [r.id for r in publish.selection(ids, shots).collect()] == ["f#2", "f#1"]
    with pytest.raises(Exception, match="no such shot"):
        publish.selection(spark.createDataFrame([(1, "f#9")], "pos int, id string"), shots).collect()


def test_prompt_and_names(spark):
    df = spark.createDataFrame([("Nuit", "nuit", "", "a  b")], "a string, b string, c string, d string")
    assert df.select(publish.prompt([("Titre", F.col("a"), 50), ("Autre", F.col("b"), 50), ("Vide", F.col("c"), 9), ("Texte", F.col("d"), 2)])).first()[0] == "Titre : Nuit\nTexte : a "
    names = publish.all_names(F.array(F.lit("b"), F.lit("A")), F.lit(None).cast("array<string>"), F.array(F.lit("b"), F.lit("")))
    assert df.select(names).first()[0] == ["A", "b"]


def test_write_index_touches_only_its_films(spark, tmp_path):
    path = str(tmp_path / "index")
    publish.write_index(spark.createDataFrame([("a", 1), ("b", 1)], "film_id string, n long"), path)
    publish.write_index(spark.createDataFrame([("a", 2)], "film_id string, n long"), path)
    assert {(r.film_id, r.n) for r in spark.read.parquet(path).collect()} == {("a", 2), ("b", 1)}


def test_facets_meet_inside_a_facet(spark):
    df = spark.createDataFrame([(1, ["Rouge", "bleu"], "x"), (2, ["rouge"], "y")], "photo_id long, couleurs array<string>, kind string")
    assert [r.photo_id for r in photos.crossed(df, {"couleurs": ["rouge", "BLEU"]}).collect()] == [1]
    assert photos.crossed(df, {"kind": ["x", "y"]}).count() == 0


@pytest.mark.parametrize("n", [1, 2, 10, 11, 30])
def test_p90(spark, n):
    df = spark.createDataFrame([("e", float(i)) for i in range(n)], "engine string, seconds double")
    assert validation.timing(df, "engine").first().p90 == float(int(0.9 * (n - 1)))


def test_presence(spark):
    df = spark.createDataFrame([("Deux femmes et un chien",), ("Une rue vide",), ("Trois enfants, silhouettes",)], "description string")
    rows = presence.presences(df).collect()
    assert rows[0]["count"] == 2 and rows[0].animals == ["chien"] and "femme visible" in rows[0].categories
    assert rows[1].categories == ["aucune personne visible", "aucun animal visible"]
    assert "groupe" in rows[2].categories and "silhouette" in rows[2].categories


def _listing(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("path", "size", "mtime", "seen"), r, strict=True))) for r in rows))


def test_settled_files(spark, tmp_path):
    """A file that two listings show alike, one that grows, one that is never listed again; time goes on by listings of
    others, and old paths leave the state."""
    src = tmp_path / "in"
    src.mkdir()
    t = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    stream = spark.readStream.schema(incremental.LISTING).option("maxFilesPerTrigger", 1).json(str(src))

    def run():
        q = incremental.settled(stream, keep=300, late="5 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        return q.recentProgress

    _listing(src, "0.json", [("a", 1, 1, t(0)), ("b", 1, 1, t(0)), ("c", 1, 1, t(0))])
    _listing(src, "1.json", [("a", 1, 1, t(25)), ("b", 2, 2, t(10))])
    run()
    read = lambda: sorted((r.path, r["size"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert read() == [("a", 1), ("c", 1)]  # c by its timer at 20 seconds, as the listings went on to 25 less 5
    _listing(src, "2.json", [("d", 1, 1, t(60))])
    run()
    assert read() == [("a", 1), ("b", 2), ("c", 1)]
    _listing(src, "3.json", [("d", 1, 1, t(500))])
    rows = [s["numRowsTotal"] for p in run() for s in json.loads(p.json)["stateOperators"]]
    assert read() == [("a", 1), ("b", 2), ("c", 1), ("d", 1)]
    assert rows[-1] < max(rows) and rows[-1] <= 3  # d alone: its value and timers


def test_settling_goes_by_buckets_of_paths(spark, tmp_path):
    """Many paths are few values and timers of the state, and each settles by itself, in any time zone of the session."""
    src = tmp_path / "in"
    src.mkdir()
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        stream = spark.readStream.schema(incremental.LISTING).option("maxFilesPerTrigger", 1).json(str(src))
        files = [(f"f{i}", i, 1, "2024-01-01 00:00:00") for i in range(300)]
        _listing(src, "0.json", [*files, (None, 1, 1, "2024-01-01 00:00:00")])
        _listing(src, "1.json", [("f1", 9, 2, "2024-01-01 00:00:10"), ("late", 1, 1, "2024-01-01 00:00:30")])
        q = incremental.settled(stream, late="1 second", buckets=4).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        rows = [s["numRowsTotal"] for p in q.recentProgress for s in json.loads(p.json)["stateOperators"]]
        got = {(r.path, r["size"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == {(p, s) for p, s, *_ in files if p != "f1"} | {(None, 1)}  # f1 has stood for 19 seconds
    assert 0 < max(rows) <= 12  # a value and a timer, which is two rows, a bucket


@pytest.mark.parametrize("clock", [None, 50])
def test_listed_anew(clock):
    """Listings as columns give what a loop over them gives."""

    def loop(state, rows):
        for path, size, mtime, at in sorted(rows, key=lambda r: (r[3], r[2], r[1])):
            now, s = at if clock is None else clock, state.get(path)
            if s and (size, mtime) == (s[0], s[1]):
                state[path] = (size, mtime, min(s[2], now), max(s[3], now), s[4])
            elif not s or clock is not None or (now, mtime, size) > (s[3], s[1], s[0]):
                state[path] = (size, mtime, now, now, False)
        return state

    for seed in range(40):
        rng = random.Random(seed)
        state = {p: (rng.randint(1, 2), rng.randint(1, 2), 3, 3 + rng.randint(0, 3), rng.random() < 0.5) for p in "ab"}
        rows = [(rng.choice("abc"), rng.randint(1, 2), rng.randint(1, 2), rng.randint(0, 9)) for _ in range(rng.randint(1, 9))]
        old = pd.DataFrame([(p, *s) for p, s in state.items()], columns=incremental.STATE)
        got = incremental.listed_anew(old, pd.DataFrame(rows, columns=["path", "size", "mtime", "at"]), clock)
        assert {r[0]: tuple(r[1:]) for r in got.itertuples(index=False)} == loop(state, rows)


def test_settled_by_the_clock(spark, tmp_path):
    """A file settles though no listing comes any more."""
    src = tmp_path / "in"
    src.mkdir()
    _listing(src, "0.json", [("a", 1, 1, "2024-01-01 00:00:00")])
    stream = spark.readStream.schema(incremental.LISTING).json(str(src))
    q = incremental.settled(stream, wait=2, keep=3600).writeStream.format("memory").queryName("by_clock").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 90
        while time.time() < until and not spark.sql("SELECT * FROM by_clock").count():
            time.sleep(1)
        assert [(r.path, r["size"]) for r in spark.sql("SELECT * FROM by_clock").collect()] == [("a", 1)]
    finally:
        q.stop()


def test_refresh(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    schema = "film_id string, n long, version long"
    for k, rows in enumerate([[("a", 1, 1), ("b", 1, 1)], [("a", 1, 2)]]):
        (src / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("film_id", "n", "version"), r, strict=True))) for r in rows))
        incremental.refresh(spark.readStream.schema(schema).json(str(src)), out, str(tmp_path / "c"), availableNow=True).awaitTermination(120)
    assert {(r.film_id, r.version) for r in Ledger(spark, out).latest(schema, "film_id").collect()} == {("a", 2), ("b", 1)}


def test_refresh_whose_driver_dies(spark, tmp_path, monkeypatch):
    """What was written and not committed stays unseen, and the batch is published once the query runs again."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    schema = "film_id string, n long, version long"
    (src / "0.json").write_text(json.dumps({"film_id": "a", "n": 1, "version": 1}))
    run = lambda: incremental.refresh(spark.readStream.schema(schema).json(str(src)), out, str(tmp_path / "c"), availableNow=True).awaitTermination(120)
    run()
    (src / "1.json").write_text(json.dumps({"film_id": "a", "n": 1, "version": 2}))

    def die(*_):
        raise KeyError("driver died")

    with monkeypatch.context() as m:
        m.setattr(Ledger, "commit", die)
        with pytest.raises(StreamingQueryException):
            run()
    read = lambda: [r.version for r in Ledger(spark, out).latest(schema, "film_id").collect()]
    assert read() == [1]
    run()
    assert read() == [2]


def test_ledger(spark, tmp_path):
    """Batches count once, whatever is delivered again; a base stands for those before it."""
    ledger, schema = Ledger(spark, str(tmp_path / "l")), "k string, v int"
    rows = lambda *x: spark.createDataFrame([*x], schema)
    read = lambda: sorted(tuple(r) for r in ledger.latest(schema, "k").collect())
    assert read() == [] and ledger.read(schema).columns == ["k", "v", "batch"]
    assert ledger.append(0, rows(("a", 1), ("b", 1))) and ledger.append(1, rows(("a", 2)))
    assert not ledger.append(1, rows(("a", 9)))
    ledger.write(rows(("b", 9)))
    assert read() == [("a", 2), ("b", 1)]
    ledger.compact(schema, "k")
    assert read() == [("a", 2), ("b", 1)] and ledger.read(schema).select("batch").distinct().count() == 1
    assert not ledger.append(0, rows(("b", 9))) and ledger.append(2, rows(("c", 3)))
    assert read() == [("a", 2), ("b", 1), ("c", 3)]


def test_upserted(spark, tmp_path):
    """Late, equal and changed items, over several runs."""
    src, schema = tmp_path / "in", "k string, v int, at timestamp"
    src.mkdir()
    read = lambda: sorted((r.k, r.v) for r in Ledger(spark, str(tmp_path / "l")).latest(schema, "k").collect())
    t = lambda s: f"2024-01-01 00:00:{s:02d}"
    for i, (rows, want) in enumerate([([("a", 1, 10), ("b", 1, 10), ("a", 1, 10)], [("a", 1), ("b", 1)]), ([("a", 1, 11), ("b", 2, 12)], [("a", 1), ("b", 2)]), ([("b", 1, 9), ("a", 3, 30)], [("a", 3), ("b", 2)])]):
        (src / f"{i}.json").write_text("\n".join(json.dumps({"k": k, "v": v, "at": t(s)}) for k, v, s in rows))
        incremental.upserted(spark.readStream.schema(schema).json(str(src)), "k", ["v"], "at", str(tmp_path / "l"), str(tmp_path / "c"), "1 minute", availableNow=True).awaitTermination(120)
        assert read() == want


def test_resumed_after_a_failure(spark, tmp_path, monkeypatch):
    """A run that dies between write and commit; the next one asks for what wasn't committed, and nothing twice."""
    work, path = spark.range(1, 11).withColumnRenamed("id", "n"), str(tmp_path / "l")
    ask = lambda rows: pd.DataFrame({"answer": rows.n.astype(str)})
    true = Ledger.commit

    def die(self, batch, *rest):
        if batch == 1:
            raise KeyError("driver died")
        true(self, batch, *rest)

    with monkeypatch.context() as m:
        m.setattr(Ledger, "commit", die)
        with pytest.raises(KeyError):
            incremental.resumed(work, path, ["n"], ask, "answer string", 4)
    assert Ledger(spark, path).read("n long, answer string, error string").count() == 4
    assert sorted((r.n, r.answer) for r in incremental.resumed(work, path, ["n"], ask, "answer string", 4).collect()) == [(n, str(n)) for n in range(1, 11)]


def test_enriched_keeps_failed_rows(spark):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        if (pdf.n == 3).any():
            raise ValueError("model said no")
        return pd.DataFrame({"answer": pdf.n.astype(str)})

    rows = incremental.enriched(spark.range(1, 5).withColumnRenamed("id", "n").coalesce(1), fn, "answer string", 2).orderBy("n").collect()
    assert [(r.n, r.answer, r.error) for r in rows] == [(1, "1", None), (2, "2", None), (3, None, "model said no"), (4, None, "model said no")]


def test_enriched_is_spread_and_keeps_types(spark):
    """Ten thousand batches of one row come as few tables, in more tasks than the rows have bytes for; large numbers stay
    exact beside failed rows."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        if (pdf.n % 5 == 0).any():
            raise ValueError("no")
        return pd.DataFrame({"answer": pdf.n + 2**60 + 1})

    tables = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            tables.add(1)
            yield part

    work = incremental.spread(spark.range(10000).withColumnRenamed("id", "n").coalesce(1))
    made = incremental.enriched(work, fn, "answer long", 1)
    assert made.select(F.spark_partition_id()).distinct().count() >= 4
    assert made.where("n % 5 = 0 AND answer IS NULL AND error = 'no' OR n % 5 <> 0 AND answer = n + 1152921504606846977 AND error IS NULL").count() == 10000
    made.mapInPandas(counted, made.schema).count()
    assert tables.value < 100


def test_batches_of_a_resumed_portion(spark, tmp_path):
    """A portion's rows lie in one file and are asked in more than one task, in batches of neighbours."""
    ask = lambda rows: pd.DataFrame({"answer": [f"{rows.n.min()}-{rows.n.max()}"] * len(rows), "task": [TaskContext.get().partitionId()] * len(rows)})
    out = incremental.resumed(spark.range(1000).withColumnRenamed("id", "n"), str(tmp_path), ["n"], ask, "answer string, task long", 600, 10).collect()
    assert {(r.n, r.answer) for r in out} == {(n, f"{n - n % 10}-{n - n % 10 + 9}") for n in range(1000)}
    assert len({r.task for r in out}) > 1


def test_many_portions(spark, tmp_path, monkeypatch):
    """Manifests are read a few times for a run and not for each portion, committed portions are one scan of few files, their
    numbers are those of their commits, and a run with nothing left asks nothing."""
    reads, true = [], Ledger.committed
    monkeypatch.setattr(Ledger, "committed", lambda self: reads.append(1) or true(self))
    work, path, asked = spark.range(1, 205).withColumnRenamed("id", "n"), str(tmp_path / "l"), spark.sparkContext.accumulator(0)

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        asked.add(len(rows))
        return pd.DataFrame({"answer": rows.n.astype(str)})

    out = incremental.resumed(work, path, ["n"], ask, "answer string", 10, 2)
    assert len(reads) < 5 and "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.n, r.answer) for r in out.collect()) == [(n, str(n)) for n in range(1, 205)] and asked.value == 204
    rows = Ledger(spark, path).read("n long, answer string, error string").collect()
    assert {(r.n, r.batch) for r in rows} == {(n, (n - 1) // 10) for n in range(1, 205)}
    assert len(list((tmp_path / "l" / "data").glob("*/*.parquet"))) == 21
    assert incremental.resumed(work, path, ["n"], ask, "answer string", 10, 2).count() == 204 and asked.value == 204


def test_prefilled_year(spark):
    """The year that stands alone, whatever other digits look like one; else the first one."""
    stems = ["cut src0-1975 1951", "a_2049_(2017)", "film-1975-1080p", "x 12051 y", "2001 odyssey 1968"]
    files = spark.createDataFrame([(s, s, s) for s in stems], "file_name string, stem string, slug string")
    out = records.prefilled(files, spark.createDataFrame([], "key string, titre string, annee string"), ["titre", "annee"])
    assert {r.file_name: r.annee for r in out.collect()} == dict(zip(stems, ["1951", "2017", "1975", "", "2001"], strict=True))


def test_equal_photos_come_by_file(spark):
    rows = [("b", "d1", "c1", True), ("a", "d1", "c1", True), ("c", "d1", "c1", True), ("0", "d0", "c2", False)]
    photos = spark.createDataFrame(rows, "fichier string, date_photo string, certitude string, a_verifier boolean").repartition(4)
    for mode in ("date", "certainty", "verify"):
        assert [r.fichier for r in layers.catalogue_order(photos, mode).collect()] == ["a", "b", "c", "0"]


def test_films_hold_every_supplier(spark):
    """The films adapter has a row for each supplier, whatever the size of the table."""
    from reelframe.plans.adapters import adapted

    sf = "/root/testdata/sf0.01"
    want = {f"src{r.s_suppkey % 20}-{r.s_suppkey // 20}" for r in spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey").collect()}
    assert len(want) > 25 and {r.film_id for r in adapted(spark, sf, "films").collect()} == want


def test_sound_layers_of_turns_without_text(spark, tmp_path):
    """A null text is an empty one: what the turn's cues tell stays."""
    import duckdb

    from reelframe.plans.catalogue import ORACLES, QUERIES

    spark.createDataFrame([(1, 0, None), (1, 1, None), (1, 2, "a b")], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(f"SELECT conv_id, turn, kinds, music, sounds FROM ({ORACLES['sound_layers']}) x ORDER BY turn").fetchall()
    assert [tuple(r) for r in QUERIES["sound_layers"](spark, str(tmp_path)).orderBy("turn").collect()] == want and want[0][3] == "musique signalée"


def test_operators_without_a_query(spark, tmp_path):
    """What COVERAGE.md lists and no query calls."""
    from pyspark.sql import functions as F

    from reelframe.operators import labels, layers, publish
    from reelframe.sources import documents

    (tmp_path / "photos.json").write_text('{"photos": [\n{"id": 1, "titre": "a"},\n{"id": 2, "titre": "b"}]}')
    assert sorted(tuple(r) for r in documents.photo_store(spark, str(tmp_path / "photos.json"), "id: long, titre: string").collect()) == [(1, "a"), (2, "b")]

    df = spark.createDataFrame([(1, "t", ["a", "b", "c"]), (2, "", ["a", "b", "c"]), (3, "t", ["a", "b"]), (4, "t", None), (5, "t", ["a", " ", "c", "d"])], "i int, t string, ts array<string>")
    assert [r.i for r in df.where(labels.prepared(F.col("t"), F.col("ts"))).collect()] == [1]

    groups = spark.createDataFrame([("f", [1, 2], 1, "x"), ("f", [2], 2, "y")], "film_id string, plans array<int>, k int, name string")
    shots = spark.createDataFrame([("f", 1), ("f", 2), ("f", 3)], "film_id string, n int")
    assert {r.n: r.name for r in layers.last_member(groups, shots, ["name"], "k").collect()} == {1: "x", 2: "y", 3: None}

    publish.archive(shots, str(tmp_path / "kept"), "a1")
    assert spark.read.parquet(str(tmp_path / "kept" / "ts=a1")).count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        publish.archive(shots, str(tmp_path / "kept"), "a1")
