"""Steps that several results share are made once, and medians of a shot's pairs come from one gathering."""

from pyspark.sql import functions as F

from reelframe.functions.text import ascii_only, shorten
from reelframe.functions.ranks import parted
from reelframe.operators import movement, scenes
from reelframe.plans.catalogue import QUERIES

from .conftest import DATA


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scenes_are_made_once(spark):
    for name in ("scene_faults", "scene_lookup"):
        assert "FlatMapGroups" not in plan(QUERIES[name](spark, DATA))


def test_medians_of_shots_and_segments(spark):
    """Even and odd numbers of pairs, nulls, no values at all and a null segment; one aggregate for shots and segments."""
    rows = [("a", None, 1.0), ("a", None, 4.0), ("a", 1, None), ("b", 1, 3.0), ("b", 1, 1.0), ("b", 2, 2.0), ("c", 1, None), (None, 1, 5.0)]
    pairs = spark.createDataFrame(rows, "shot_id string, segment int, dx double").withColumns({m: F.col("dx") for m in movement.MEASURES})
    got = {r.shot_id: (r.pairs, r.dx) for r in movement.medians(pairs, "shot_id").collect()}
    assert got == {"a": (3, 2.5), "b": (3, 2.0), "c": (1, 0.0), None: (1, 5.0)}
    assert plan(movement.fused(pairs)).count("Aggregate") == 1


def test_clean_bounds_keep_no_table_of_points(spark):
    """Equal points drop out between neighbours, so no task holds all points of its films in a hash table."""
    assert "Aggregate" not in plan(QUERIES["clean_bounds"](spark, DATA))


def test_texts_of_scenes_are_gone_through_once(spark):
    """Scene rows come from a table of short rows: neither the shots nor their texts are made again for them."""
    made = plan(QUERIES["scene_rows"](spark, DATA))
    assert "Window" not in made and "documents" not in made


def test_scenes_from_the_ends_of_texts(spark):
    """A moment inside a long text, one that begins in a shot and ends in the next, none where an empty text is between,
    and descriptions that are cut where a space stands."""
    long = "mot " * 300
    told = [("inside", [long + "le matin " + long]), ("across", [long + "soleil", "couchant " + long]), ("apart", [long + "soleil", "", "couchant " + long]), ("short", ["soleil", "couchant"])]
    rows = [(film, n, float(n), n + 1.0, text) for film, texts in told for n, text in enumerate(texts, 1)]
    shots = scenes.tagged(spark.createDataFrame(rows, "film_id string, n long, debut double, fin double, description string"), {})
    one = shots.select("film_id", "n", F.lit(1).cast("long").alias("scene"))
    got = {r.film_id: r for r in scenes.described(shots, one, {}).collect()}
    assert {f: r.temporalite for f, r in got.items()} == {"inside": "matin", "across": "soleil couchant", "apart": "indéterminée", "short": "soleil couchant"}
    assert got["inside"].resume_scene == " ".join(["mot"] * 57) + "… " + " ".join(["mot"] * 55) + "…"  # the last shot's has 220 signs
    assert got["short"].resume_scene == "soleil couchant"


def test_shorten_reads_what_it_needs(spark):
    """Texts with long white space at any place, and such as end at the limit."""
    texts = ["", " " * 50 + "ab cd", "ab" + " " * 50 + "cd ef gh", "abcd efgh", "abcd efgh ", "abcd efghi", "a b c d e f g h", "x" * 60, ("ab" + "\n" * 9) * 9]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def plain(t, limit=9):
        flat = " ".join(t.split())
        return flat if len(flat) <= limit else flat[:limit].rsplit(" ", 1)[0].rstrip(" .,;:") + "…"

    assert [r[0] for r in df.select(shorten(F.col("t"), 9)).collect()] == [plain(t) for t in texts]


def test_ascii_of_few_and_many_signs(spark):
    """Letters with marks, ligatures, signs without ASCII and beyond the first plane, alone and among many others."""
    some, other = "é œ ﬁ ½ 中 😀 𝐀 x", "".join(map(chr, range(0x4E00, 0x4E50)))
    df = spark.createDataFrame([(some,), (some + other,)], "t string")
    few, many = (r[0] for r in df.select(ascii_only(F.col("t"))).collect())
    assert few == many == "e  fi 12   A x"


def test_tasks_of_windows_grow_in_number_not_in_size(spark):
    """Both windows of the clean bounds use one parting by films, over more tasks where there are more rows."""
    rows = spark.range(1000).select((F.col("id") % 200).alias("k"), "id")
    made = parted(rows, "k", most=100)
    assert made.rdd.getNumPartitions() == 10 and made.count() == 1000
    assert parted(rows, "k").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    physical = QUERIES["clean_bounds"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange") == 1 and "REPARTITION_BY_NUM" in physical
