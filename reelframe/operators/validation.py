"""Attempts and engines: best of several answers, timing and validity summaries, agreement, closed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.functions.ranks import numbered


def best_attempts(attempts: DataFrame, full: int) -> DataFrame:
    """Of each shot the attempt with most required, then most fields, earlier ones first; none after the first full one."""
    stop = Window.partitionBy("shot_id")
    last = F.min(F.when(F.col("score") >= full, F.col("attempt"))).over(stop)
    rows = attempts.withColumn("_stop", last).where(F.col("_stop").isNull() | (F.col("attempt") <= F.col("_stop")))
    order = stop.orderBy(F.desc("score"), F.desc("nfields"), "attempt")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_stop")


def timing(attempts: DataFrame, *keys: str) -> DataFrame:
    """Answers, median and 90th of 100 seconds (the value at the floor of nine tenths of the last position), shots an hour.

    Places are counted in ranges of the order, so an engine with most of the answers is no task's."""
    placed = numbered(attempts.select(*keys, "seconds"), list(keys), [F.asc("seconds")], "_r")
    counts = attempts.groupBy(*keys).agg(F.count("*").alias("answers"), F.sum("seconds").alias("_all"))
    same = F.lit(True)
    for k in keys:
        same = same & placed[k].eqNullSafe(counts[k])
    last = F.col("answers") - 1
    places = {"_low": F.floor(last / 2), "_high": F.ceil(last / 2), "p90": F.floor(last * 9 / 10)}
    near = placed.join(counts, same).where(F.array_contains(F.array(*(c + 1 for c in places.values())), F.col("_r")))
    found = near.groupBy(*(counts[k] for k in keys), "answers", "_all").agg(*(F.min(F.when(F.col("_r") == c + 1, F.col("seconds"))).alias(name) for name, c in places.items()))
    return found.select(*keys, "answers", ((F.col("_low") + F.col("_high")) / 2).alias("median"), "p90", F.try_divide(F.col("answers") * 3600, F.col("_all")).alias("per_hour"))


def agreement(attempts: DataFrame, a: str, b: str, fields: list[str]) -> DataFrame:
    """Of each field, shots that both engines answered and the share in which they agree."""
    one = attempts.groupBy("shot_id", "engine").agg(*(F.min(F.struct("attempt", f))[f].alias(f) for f in fields))
    x, y = (one.where(F.col("engine") == e).select("shot_id", F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields)).alias(e)) for e in (a, b))
    rows = x.join(y, "shot_id").select(F.explode(F.arrays_zip(a, b)).alias("p")).select(F.col(f"p.{a}.field").alias("field"), F.col(f"p.{a}.value").alias("x"), F.col(f"p.{b}.value").alias("y"))
    rows = rows.where("x is not null and y is not null")
    return rows.groupBy("field").agg(F.count("*").alias("shots"), F.round(100 * F.avg(F.when(F.col("x") == F.col("y"), 1).otherwise(0)), 1).alias("percent"))


def mean_agreement(rows: DataFrame) -> DataFrame:
    """One row: compared fields, and the mean of their agreement in per cent, to a tenth."""
    return rows.agg(F.count("*").alias("fields"), F.round(F.avg("percent"), 1).alias("percent"))


def violations(rows: DataFrame, key: str, vocabulary: dict[str, list[str]]) -> DataFrame:
    """(key, path, value) of each value of a column, or entry of an array column, that its closed vocabulary lacks."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    values = {p: F.col(p) if kinds[p].startswith("array") else F.array(p) for p in vocabulary}
    odd = [F.transform(F.array_except(F.filter(v, lambda x: x.isNotNull()), F.array(*(F.lit(w) for w in vocabulary[p]))), _entry(p)) for p, v in values.items()]
    return rows.select(key, F.explode(F.concat(*odd)).alias("x")).select(key, "x.*")


def _entry(path: str):
    return lambda v: F.struct(F.lit(path).alias("path"), v.alias("value"))


def running_time(runs: DataFrame, key: str) -> DataFrame:
    """Seconds spent up to each run, to a tenth."""
    order = Window.partitionBy(key).orderBy("run", "seconds").rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("spent", F.bround(F.sum("seconds").over(order), 1))


def validity(answers: DataFrame, key: str, required: list[str], vocabulary: dict[str, list[str]]) -> DataFrame:
    """(key, answers, valid, percent, out_of_vocabulary, missing) of answers whose column valid says that they parsed.

    Values outside a closed vocabulary and required fields that are null are counted over valid answers."""
    odd = [F.size(F.array_except(F.filter(F.array(c), lambda x: x.isNotNull()), F.array(*(F.lit(w) for w in words)))) for c, words in vocabulary.items()]
    none = [F.col(c).isNull().cast("int") for c in required]
    total = lambda parts: F.coalesce(F.sum(F.when(F.col("valid"), sum(parts, F.lit(0)))), F.lit(0)).cast("long")
    valid = F.count_if(F.coalesce("valid", F.lit(False)))
    return answers.groupBy(key).agg(F.count("*").alias("answers"), valid.alias("valid"), F.round(100 * valid / F.greatest(F.count("*"), F.lit(1)), 1).alias("percent"), total(odd).alias("out_of_vocabulary"), total(none).alias("missing"))


def simplified(schema: object) -> object:
    """A JSON schema in which each choice between a scalar and a list is the list, and any other choice its first entry."""
    if isinstance(schema, list):
        return [simplified(s) for s in schema]
    if not isinstance(schema, dict):
        return schema
    choices = schema.get("oneOf") or []
    rest = {k: v for k, v in schema.items() if k != "oneOf"} if choices else {k: simplified(v) for k, v in schema.items()}
    lists = [c for c in choices if isinstance(c, dict) and c.get("type") == "array"]
    return rest | simplified((lists or choices)[0]) if choices else rest


# answers against a JSON schema

#: What a deviation tells: where it is, what stands there as JSON, and whether it is the value or the choice that fails.
DEVIATION = "array<struct<path: string, value: string, reason: string>>"
UNKNOWN_VALUE, NO_CHOICE = "hors vocabulaire", "aucune variante ne convient"


def deviations(rows: DataFrame, keys: list[str], answer: str, schema: dict) -> DataFrame:
    """(keys, path, value, reason) of all that a closed vocabulary of a JSON schema doesn't have in a column of variants.

    The schema is compiled into one expression: enum, oneOf and anyOf (a value fits if it has no deviation from one of
    them), object with properties, array with items; anything else fits. Paths read a.b[2]. Null answers have none."""
    found = _checked(schema, F.col(answer), F.lit(""))
    return rows.where(F.col(answer).isNotNull()).select(*keys, F.inline(found))


def missing_keys(rows: DataFrame, keys: list[str], answer: str, schema: dict) -> DataFrame:
    """(keys, missing) of the required keys that an answer lacks; one that is no object lacks all. Null answers lack none."""
    value = F.col(answer)
    lacking = F.array_compact(F.array(*(F.when(~(_is(value, "OBJECT") & _at(value, k).isNotNull()), F.lit(k)) for k in schema.get("required") or []))).cast("array<string>")
    return rows.where(value.isNotNull()).select(*keys, F.explode(lacking).alias("missing"))


def _at(value: Column, key: str) -> Column:
    """What stands under a key, a JSON null included; SQL's null where the key isn't there."""
    quote = '"' if "'" in key else "'"
    if quote in key:
        raise ValueError(f"a key with both kinds of quotes can't be looked up: {key}")
    return F.variant_get(value, f"$[{quote}{key}{quote}]", "variant")


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _one_of(value: Column, words: list) -> Column:
    """Whether a variant is one of some JSON scalars; numbers are equal by value, whatever their form."""
    out = F.is_variant_null(value) if None in words else F.lit(False)
    texts, flags = [w for w in words if isinstance(w, str)], [w for w in words if isinstance(w, bool)]
    numbers = [float(w) for w in words if isinstance(w, int | float) and not isinstance(w, bool)]
    get = lambda kind: F.try_variant_get(value, "$", kind)
    if texts:
        out = out | (_is(value, "STRING") & get("string").isin(texts))
    if flags:
        out = out | (_is(value, "BOOLEAN") & get("boolean").isin(flags))
    if numbers:
        out = out | (F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & get("double").isin(numbers))
    return F.coalesce(out, F.lit(False))


def _checked(schema: dict, value: Column, path: Column) -> Column:
    """The deviations of a variant that stands at path."""
    none = F.array().cast(DEVIATION)
    fails = lambda reason: F.array(F.struct(F.when(path == "", "(racine)").otherwise(path).alias("path"), F.to_json(value).alias("value"), F.lit(reason).alias("reason")))
    choices = schema.get("oneOf") or schema.get("anyOf")
    if choices:
        fits = F.lit(False)
        for c in choices:
            fits = fits | (F.size(_checked(c, value, path)) == 0)
        return F.when(fits, none).otherwise(fails(NO_CHOICE))
    if schema.get("enum") is not None:
        return F.when(_one_of(value, schema["enum"]), none).otherwise(fails(UNKNOWN_VALUE))
    if schema.get("type") == "object" and schema.get("properties"):
        parts = [F.when(_at(value, k).isNotNull(), _checked(s, _at(value, k), F.when(path == "", k).otherwise(F.concat(path, F.lit(f".{k}"))))).otherwise(none) for k, s in schema["properties"].items()]
        return F.when(_is(value, "OBJECT"), F.concat(*parts)).otherwise(none)
    if schema.get("type") == "array" and schema.get("items"):
        items = F.try_variant_get(value, "$", "array<variant>")
        each = F.transform(items, lambda x, i: _checked(schema["items"], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.when(_is(value, "ARRAY"), F.flatten(each)).otherwise(none)
    return none
