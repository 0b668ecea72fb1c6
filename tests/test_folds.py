"""Ordered folds and rules on small hand-made rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelframe.functions import numbers, text
from reelframe.operators import characters, cutting, dialogue, movement, records, scenes, scoring, sequences, validation

THEMES = ["feu", "groupe"]
BITS = {t: 1 << i for i, t in enumerate(scenes.order_of(dict.fromkeys(THEMES, [])))}


def shot(a, b, tags, words):
    return scenes.Shot(a, b, sum(BITS[t] for t in tags), frozenset(words))


def grouped(rows):
    return scenes.numbered(rows, scenes.Limits())


def test_credits_stand_alone():
    rows = [shot(0, 5, ["générique"], "ab"), shot(5, 9, ["générique"], "ab"), shot(9, 14, ["feu"], "ab")]
    assert grouped(rows) == [1, 1, 2]


def test_most_shots_of_a_scene():
    got = grouped([shot(i, i + 1, ["feu"], "ab") for i in range(30)])
    assert max(got.count(k) for k in set(got)) == 12


def test_theme_change_without_likeness():
    rows = [shot(0, 10, ["feu"], "ab"), shot(10, 20, ["feu"], "ab"), shot(20, 30, ["groupe"], "xy")]
    assert grouped(rows) == [1, 1, 2]


@pytest.mark.parametrize(
    ("rule", "rows", "cut"),
    [
        ("length", [(0, 70, "feu", "ab"), (70, 136, "feu", "ab"), (136, 140, "feu", "xyzuvwqrst")], True),
        ("alike", [(0, 70, "feu", "ab"), (70, 136, "feu", "ab"), (136, 140, "feu", "abxy")], False),
        ("short", [(0, 7, "feu", "ab"), (7, 17, "feu", "ab"), (17, 27, "groupe", "xy")], False),
        ("no common tag", [(9 * i, 9 * i + 9, "feu", "ab") for i in range(6)] + [(54, 60, "groupe", "xy")], True),
        ("main theme", [(8 * i, 8 * i + 8, "feu" if i < 9 else "groupe", "abcdefghijk") for i in range(10)] + [(80, 88, "groupe", "kxyzuvwmnopqrst")], True),
        ("five of ten", [(4 * i, 4 * i + 4, "feu", "ab") for i in range(11)] + [(44, 48, "groupe", "xy")], True),
    ],
)
def test_rules_of_a_break(rule, rows, cut):
    """Each rule at its bounds, before neighbours join."""
    made = scenes.runs([shot(a, b, [t], w) for a, b, t, w in rows], scenes.Limits())
    assert [s.size for s in made] == ([len(rows) - 1, 1] if cut else [len(rows)]), rule


def test_short_neighbours_join_until_none_does():
    limits = scenes.Limits()
    alone = lambda k, tag="feu": scenes.Scene(k, shot(5 * k, 5 * k + 5, [tag], "ab"))
    joined = scenes.settled([alone(k) for k in range(5)], limits)
    assert [(s.first, s.at) for s in joined] == [(0, 1), (2, 4)]  # two pairs, then the last one, as it adds little
    assert len(scenes.settled([alone(0), alone(1, "groupe"), alone(2)], limits)) == 3
    assert len(scenes.settled([alone(0), alone(1, "générique")], limits)) == 2
    assert [s.size for s in scenes.settled([alone(k) for k in range(14)], limits)] == [2] * 7
    long = [scenes.Scene(0, shot(0, 100, ["feu"], "a")), scenes.Scene(1, shot(100, 160, ["feu"], "a"))]
    assert len(scenes.settled(long, limits)) == 2


def test_scenes_partition_the_shots():
    rng = random.Random(4)
    for _ in range(50):
        t, rows = 0.0, []
        for _ in range(rng.randint(1, 60)):
            d = rng.choice([1, 4, 20, 50])
            rows.append(shot(t, t + d, rng.sample(["feu", "groupe", "générique", "continuité"], rng.randint(1, 2)), rng.sample("abcdefghij", 3)))
            t += d
        got = grouped(rows)
        assert len(got) == len(rows) and got[0] == 1
        assert all(b - a in (0, 1) for a, b in zip(got, got[1:], strict=False))


def test_window_stays_in_its_run_and_length():
    run = lambda bounds: sequences.Run(*map(np.array, zip(*bounds, strict=True)))
    assert run([(0, 10), (10, 20), (20, 30), (35, 45), (45, 55)]).around(1) == (0, 2)
    assert run([(0, 80), (80, 95), (95, 99)]).around(1) == (1, 2)
    assert run([(k, k + 1) for k in range(200)]).around(100) == (59, 103)  # three rounds, then to the left where gaps are equal
    assert run([(0, 10), (10.5, 20), (20, 30)]).around(1, aim=19, rounds=0) == (1, 2)  # across the smaller gap
    assert run([(0, 10), (10, 20), (20, 30), (30, 95)]).united([(0, 2, 4), (2, 3, 9)]) == [(0, 2, 4), (2, 3, 9)]
    assert run([(0, 10), (10, 20), (20, 30), (30, 40)]).united([(2, 3, 9), (0, 1, 4)]) == [(0, 3, 9)]


def test_packed(spark):
    rows = [("f", i, 15.0 * i, 15.0 * i + 15) for i in range(7)] + [("f", 7, 200.0, 300.0)]
    got = {(r.first, r.last) for r in sequences.packed(spark.createDataFrame(rows, "film_id string, n long, debut double, fin double")).collect()}
    assert got == {(0, 2), (3, 5), (6, 6), (7, 7)}


def test_leaders_open_and_join():
    v = np.array([[1, 0], [1, 0.1], [0, 1], [0.1, 1], [1, 1]], float)
    assert characters.leaders(v).tolist()[:4] == [0, 0, 1, 1]


@pytest.mark.parametrize(
    ("row", "camera"),
    [
        ((1, 0, 0, 0, 0, 0, 1), "indéterminé"),
        ((4, 0.01, 0, 0, 0, 0.02, 1), "caméra portée"),
        ((4, 0, 0, 0.02, 0, 0, 1), "zoom in"),
        ((4, 0, 0, -0.02, 0, 0, 1), "zoom out"),
        ((4, 0, 0, 0, 0.6, 0, 1), "rotation horaire"),
        ((4, 0, 0, 0, 0, 0, 1), "fixe"),
        ((4, 0.05, 0, 0, 0, 0, 1), "panoramique gauche"),
        ((4, 0, -0.05, 0, 0, 0, 1), "tilt bas"),
        ((4, 0.05, 0.05, 0, 0, 0, 1), "mouvement complexe"),
    ],
)
def test_movement_rules(spark, row, camera):
    df = spark.createDataFrame([tuple(map(float, row))], "pairs double, dx double, dy double, scale_delta double, rotation double, jitter double, inliers double")
    assert movement.classified(df).first().camera == camera


def test_decision(spark):
    rows = [(1, "zoom in", "zoom in", "douteux"), (2, "mouvement complexe", "mouvement complexe", "sûr"), (3, "zoom in", "travelling avant", "douteux"), (4, "fixe", "zoom in", "sûr"), (5, "", "fixe", "sûr"), (6, "fixe", "indéterminé", "sûr")]
    df = spark.createDataFrame(rows, "shot_id long, camera string, video string, video_confidence string")
    got = {r.shot_id: (r.final, r.conflict, r.basis) for r in movement.decided(df, df).collect()}
    assert got == {1: ("zoom in", False, "accord"), 2: ("mouvement complexe", True, "désaccord"), 3: ("zoom in", True, "ambiguïté"), 4: ("zoom in", True, "désaccord"), 5: ("fixe", False, "vidéo"), 6: ("fixe", False, "mesure")}


def test_overlap_bound(spark):
    shots = spark.createDataFrame([("f", 1, 0.0, 10.0), ("f", 2, 10.0, 100.0), ("f", 3, 200.0, 210.0)], "film_id string, n long, debut double, fin double")
    said = spark.createDataFrame([("f", 9.0, 10.03, "a"), ("f", 9.949, 10.051, "b"), ("f", 5.0, 250.0, "c")], "film_id string, debut double, fin double, texte string")
    got = {(r.n, r.texte) for r in dialogue.attached(shots, said).collect()}
    assert got == {(1, "a"), (1, "b"), (2, "b"), (1, "c"), (2, "c"), (3, "c")}
    assert {r.n: r.n_segments for r in dialogue.with_dialogue(shots, said).collect()} == {1: 3, 2: 2, 3: 1}


def test_cuts(spark):
    frames = spark.createDataFrame([("f", 5.0, 0.9), ("f", 5.02, 0.9), ("f", 0.01, 0.9), ("f", 50.0, 0.2)], "film_id string, t double, score double")
    clips = spark.createDataFrame([("f", 0.0, 60.0)], "film_id string, debut double, fin double")
    assert {(r.debut, r.fin) for r in cutting.detect(frames, clips).collect()} == {(0.0, 5.0), (5.02, 60.0)}
    assert {(r.debut, r.fin, r.refined) for r in cutting.detect_twice(frames, clips).collect()} == {(0.0, 5.0, False), (5.02, 50.0, True), (50.0, 60.0, True)}
    bounds = spark.createDataFrame([("f", 1, 0.0, 5.0), ("f", 2, 5.05, 9.0), ("f", 3, 12.0, 12.0), ("f", 4, 20.0, 30.0)], "film_id string, pos int, debut double, fin double")
    assert {(r.debut, r.fin) for r in cutting.clean_bounds(bounds).collect()} == {(0.0, 5.0), (5.0, 9.0), (9.0, 20.0), (20.0, 30.0)}


def test_second_pass_over_long_spans(spark):
    """A span of a thousand billion seconds is one row; frames at its edges and without a film cut nothing."""
    end = 1e12
    frames = spark.createDataFrame([("f", 5.0, 0.9), ("f", 5.0, 0.2), ("f", 100.0, 0.2), ("f", end - 0.01, 0.2), (None, 50.0, 0.2), ("f", None, 0.9)], "film_id string, t double, score double")
    clips = spark.createDataFrame([("f", 0.0, end), (None, 0.0, 90.0)], "film_id string, debut double, fin double")
    got = {(r.film_id, r.debut, r.fin, r.refined) for r in cutting.detect_twice(frames, clips).collect()}
    assert got == {("f", 0.0, 5.0, False), ("f", 5.0, 100.0, True), ("f", 100.0, end, True), (None, 0.0, 90.0, False)}


def test_merges(spark):
    old = spark.createDataFrame([("a", "", ["x"], "seen"), ("b", "kept", ["y"], "")], "k string, pitch string, sources array<string>, notes string")
    new = spark.createDataFrame([("a", "filled", ["w", "x"], "seen"), ("c", "new", ["z"], "n")], "k string, pitch string, sources array<string>, notes string")
    got = {r.k: (r.pitch, r.sources, r.notes) for r in records.merged(old, new, "k", ["pitch"]).collect()}
    assert got == {"a": ("filled", ["x", "w"], "seen"), "b": ("kept", ["y"], ""), "c": ("new", ["z"], "n")}
    assert records.merged(old, new, "k", ["pitch"], ordered_sources=False).where("k = 'a'").first().sources == ["w", "x"]


def test_doubt_of_refined(spark):
    df = spark.createDataFrame([(None, None, "d", "k", "e", None, True, True), ("douteux", None, "d", "k", "e", "l", False, None)], "certitude string, interface string, description string, mots_cles string, echelle string, lieu string, machine boolean, done boolean")
    assert [r.score for r in scoring.doubt(df, F.col("done")).collect()] == [0, 5]


@pytest.mark.parametrize(("given", "folded"), [("Dvořák Šárka Ākāśa", "dvoraksarkaakasa"), ("e\u0301te\u0301", "ete"), ("ﬁn ½ …", "fin12"), ("Œuvre", "uvre"), ("l’écran", "lecran"), ("a b", "ab"), ("漢 Été", "ete")])
def test_fold(spark, given, folded):
    assert spark.range(1).select(text.fold(F.lit(given))).first()[0].replace(" ", "") == folded.replace(" ", "")


def test_marks_of_all_scripts(spark):
    df = spark.createDataFrame([("L’Été, Šárka e\u0301 Ελλάς й 漢",)], "t string")
    assert df.select(text.fold_marks(F.col("t")).alias("x")).first().x == "l'ete, sarka e ελλας и 漢"


def test_equal_runs_have_one_latest(spark):
    rows = [("f", 1, 5, "b"), ("f", 1, 5, "a"), ("f", 1, 4, "c"), ("f", 2, 1, None)]
    for given in (rows, rows[::-1]):
        got = sequences.latest(spark.createDataFrame(given, "film_id string, id int, run_ts int, note string").repartition(3)).collect()
        assert sorted((r.id, r.run_ts, r.note) for r in got) == [(1, 5, "b"), (2, 1, None)]


def test_schema_choices():
    both = {"oneOf": [{"type": "string"}, {"type": "array", "items": {"type": "string"}}], "description": "x"}
    assert validation.simplified({"properties": {"a": both, "b": {"oneOf": [{"type": "null"}, {"type": "string"}]}}, "required": ["a"]}) == {"properties": {"a": {"type": "array", "items": {"type": "string"}, "description": "x"}, "b": {"type": "null"}}, "required": ["a"]}


def test_quantiles_of_equal_times(spark):
    df = spark.createDataFrame([("e", float(x)) for x in [1, 1, 1, 2, 9, 9, 9, 9, 9, 30]] + [("f", 4.0), ("f", 2.0)], "engine string, seconds double")
    got = {r.engine: (r.answers, r.median, r.p90) for r in validation.timing(df, "engine").collect()}
    assert got == {"e": (10, 9.0, 9.0), "f": (2, 3.0, 2.0)}


def test_digest_is_cut_at_its_limit(spark):
    df = spark.createDataFrame([("f", i, f"line {i:04d} " + "x" * 40) for i in range(500)], "film_id string, n int, texte string")
    whole = " | ".join(f"plan {i} : line {i:04d} " + "x" * 40 for i in range(500))
    assert dialogue.digest(df, ["film_id"]).first().text == whole[:900].rstrip() + "…"


def test_small_helpers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.shorten(F.lit("one two three"), 8)) == "one two…"
    assert one(text.shorten(F.lit("exact"), 5)) == "exact"
    assert one(text.slug(F.lit("L'été — 1971!"))) == "l-ete-1971"
    assert one(numbers.timecode(F.lit(3661.5))) == "01:01:01.500"
    assert one(numbers.timecode_of_ms(F.lit(0.9996))) == "00:00:01,000"
    assert one(numbers.human_duration(F.lit(65.0))) == "1 min 05 s"
    assert one(numbers.decade(F.lit("1987"))) == "1980s" and one(numbers.decade(F.lit("x"))) == ""
    assert one(numbers.share(F.lit(1), F.lit(0))) == 100
    assert one(numbers.jaccard(F.array(F.lit("a")), F.array().cast("array<string>"))) == 0.0
    assert one(text.looks_english(F.lit("The story of a crew and their planet"))) is True
