"""Answers against JSON schemas: the compiled expression and a plain recursive walk say the same."""

import json
import random

from pyspark.sql import functions as F

from reelframe.operators import photos, validation

SCHEMA = {
    "type": "object",
    "required": ["a", "b c", "d"],
    "properties": {
        "a": {"enum": ["x", "y", None, 1, True]},
        "b c": {"type": "array", "items": {"oneOf": [{"enum": ["p", 2.5]}, {"type": "object", "properties": {"k": {"enum": ["q"]}}}]}},
        "d": {"type": "object", "properties": {"e": {"type": "object", "properties": {"f": {"type": "array", "items": {"type": "array", "items": {"enum": ["z"]}}}, "it's": {"anyOf": [{"enum": ["o"]}, {"type": "array", "items": {"enum": ["o"]}}]}}}, "g": {"type": "string"}}},
    },
}


def same(value, words):
    return any(type(value) is type(w) and value == w or not isinstance(value, bool | str) and not isinstance(w, bool | str) and None not in (value, w) and not isinstance(value, list | dict) and float(value) == float(w) for w in words)


def walked(schema, value, path=""):
    choices = schema.get("oneOf") or schema.get("anyOf")
    if choices:
        return [] if any(not walked(c, value, path) for c in choices) else [(path or "(racine)", value, validation.NO_CHOICE)]
    if "enum" in schema:
        return [] if same(value, schema["enum"]) else [(path or "(racine)", value, validation.UNKNOWN_VALUE)]
    if schema.get("type") == "object" and isinstance(value, dict):
        return [x for k, s in schema["properties"].items() if k in value for x in walked(s, value[k], f"{path}.{k}" if path else k)]
    if schema.get("type") == "array" and isinstance(value, list):
        return [x for i, v in enumerate(value) for x in walked(schema["items"], v, f"{path}[{i}]")]
    return []


def drawn(rnd, depth=0):
    kinds = ["x", "y", None, 1, 1.0, True, "p", 2.5, "q", "z", "o", "odd", 7, False, ""]
    if depth > 4 or rnd.random() < 0.4:
        return rnd.choice(kinds)
    if rnd.random() < 0.4:
        return [drawn(rnd, depth + 1) for _ in range(rnd.randint(0, 3))]
    return {k: drawn(rnd, depth + 1) for k in rnd.sample(["a", "b c", "d", "e", "f", "g", "k", "it's"], rnd.randint(0, 6))}


def test_deviations_and_missing_keys(spark):
    rnd = random.Random(8)
    answers = [{"a": drawn(rnd, 3), "b c": drawn(rnd, 1), "d": {"e": {"f": drawn(rnd, 1), "it's": drawn(rnd, 3)}, "g": 1}} for _ in range(150)] + [drawn(rnd) for _ in range(150)]
    rows = [(i, json.dumps(a)) for i, a in enumerate(answers)] + [(900, "{broken"), (901, None)]
    df = spark.createDataFrame(rows, "id int, text string").select("id", F.try_parse_json("text").alias("v"))
    got = {(r.id, r.path, json.dumps(json.loads(r.value)), r.reason) for r in validation.deviations(df, ["id"], "v", SCHEMA).collect()}
    number = lambda v: v if not isinstance(v, float) or v != int(v) else int(v)
    plain = lambda v: {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else number(v)
    order = lambda v: json.dumps(plain(v), sort_keys=True)
    want = {(i, p, order(v), r) for i, a in enumerate(answers) for p, v, r in walked(SCHEMA, a)}
    assert {(i, p, order(json.loads(v)), r) for i, p, v, r in got} == want and len(want) > 100
    lacking = {(i, k) for i, a in enumerate(answers) for k in SCHEMA["required"] if not isinstance(a, dict) or k not in a}
    assert {(r.id, r.missing) for r in validation.missing_keys(df, ["id"], "v", SCHEMA).collect()} == lacking


def test_facets_in_the_order_of_a_dictionary(spark):
    df = spark.createDataFrame([(1, "zoo"), (2, "état"), (3, "Etat"), (4, "etat"), (5, "œuvre"), (6, "abc"), (7, "")], "photo_id int, lieu string")
    assert [r.value for r in photos.domains(df, ["lieu"], 6).orderBy("position").collect()] == ["abc", "etat", "Etat", "état", "œuvre", "zoo"]
    assert [r.value for r in photos.domains(df, ["lieu"], 2).orderBy("position").collect()] == ["abc", "etat"]


def test_exif_without_entries(spark):
    df = spark.sql("SELECT 1 AS id, 10L AS largeur, 10L AS hauteur, CAST(NULL AS MAP<STRING, VARIANT>) AS exif UNION ALL SELECT 2, 5L, 9L, map('Make', CAST('Acme' AS VARIANT), 'FNumber', CAST(array(28, 10) AS VARIANT), 'Model', parse_json('null'))")
    rows = {r.id: r for r in photos.shaped(df, "exif").collect()}
    assert (rows[1].orientation, rows[1].appareil, rows[1].date_photo) == ("carré", "", "")
    assert (rows[2].orientation, rows[2].appareil, rows[2].ouverture, rows[2].iso) == ("portrait", "Acme", "28/10", "")
