"""Projections from one table of columns, and the layout of requests."""

import json

from pyspark.sql import functions as F

from reelframe.operators import columns, publish
from reelframe.plans.adapters import adapted
from reelframe.plans.wide import _nested
from reelframe.sources import documents

from .conftest import DATA


def test_columns():
    """The compact row is a part of the wide one, in its order."""
    assert len(columns.WIDE) == len(set(columns.WIDE)) == 139 and len(columns.COMPACT) == 82
    assert [c for c in columns.WIDE if c in columns.COMPACT] == columns.COMPACT


def test_only_what_is_asked_is_read(spark):
    """Of nested Parquet, the fields of the asked columns."""
    rows = _nested(adapted(spark, DATA, "shots"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = columns.projected(rows, ["echelle", "titre", "composition_cadre"])._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema") :].splitlines()[0]
    assert all(f in read for f in ("echelle", "titre", "composition", "film_id")) and not any(f in read for f in ("description", "dialogue", "pitch", "profondeur", "vignette"))


def test_documents_by_their_columns(spark, tmp_path):
    """A document is parsed for the asked columns only; what it lacks has a typed default, null rows too."""
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "plans.json").write_text(json.dumps({"film": "A", "fiche": {"titre": "T", "scenaristes": ["x"]}, "plans": [
        {"n": 1, "debut": 0, "fin": 2.5, "analyse": {"machine": True, "types": ["écran"], "analyse_detaillee": {"cadrage_optique": {"composition": ["centrée"]}}, "presences": {"nombre_personnes": 2}}, "affinage": {"modele": "m", "raisons": ["r", "s"]}},
        {"n": 2, "scene_titre": "S", "presences": {"nombre_personnes": 3}},
    ]}))
    names = ["film", "titre", "n", "machine", "machine_types", "composition_cadre", "nombre_personnes", "affinage_raisons", "scene_titre", "lieu", "credits", "audio_global_debut", "credits_par_fonction"]
    docs = documents.film_documents(spark, str(tmp_path), schema=columns.schema(names))
    shots = docs.where("_corrupt is null").select("film_id", "fiche", F.inline("plans"))
    got = [tuple(r) for r in columns.projected(shots, names).orderBy("n").collect()]
    assert got == [
        ("a", "T", 1, True, ["écran"], ["centrée"], 2, ["r", "s"], "", "", ["x"], None, {"Scénario": ["x"]}),
        ("a", "T", 2, False, [], [], 3, [], "S", "", ["x"], None, {"Scénario": ["x"]}),
    ]
    # a document with none of the fields
    bare = columns.projected(spark.createDataFrame([("b", 1)], "film_id string, n long"))
    assert bare.columns == columns.WIDE and bare.first().vignettes == [] and bare.first().titre == "b"


def test_batches_of_requests(spark):
    """No batch has two constant parts, none is larger than asked, no task has more batches than asked."""
    rows = [("same", f"f{i % 7}", i) for i in range(500)] + [(f"c{i}", "", i) for i in range(40)] + [("", "", 1), ("", "", 1)]
    df = spark.createDataFrame(rows, "constant string, film string, n int")
    out = publish.batched(df, ["n"], 8, 5).withColumn("part", F.spark_partition_id()).collect()
    assert len(out) == len(rows)
    held, tasks = {}, {}
    for r in out:
        held.setdefault(r.batch, []).append(r)
        tasks.setdefault(r.part, set()).add(r.batch)
    assert sorted(held) == list(range(len(held)))
    assert all(len({r.constant for r in b}) == 1 and sorted(r.pos for r in b) == list(range(len(b))) and len(b) <= 8 and len({r.part for r in b}) == 1 for b in held.values())
    assert all(len(b) <= 5 for b in tasks.values())
    films = [r.film for r in sorted((r for r in out if r.constant == "same"), key=lambda r: (r.batch, r.pos))]
    assert films == sorted(films)
