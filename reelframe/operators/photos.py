"""Photos: search by words and crossed facets, counts for each facet value, totals, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.functions.text import blank, first_truthy


def searched(photos: DataFrame, words: str, fields: list[str]) -> DataFrame:
    """Photos whose joined lower-case fields hold every word."""
    text = F.lower(F.concat_ws(" ", *fields))
    rows = photos
    for w in words.lower().split():
        rows = rows.where(F.contains(text, F.lit(w)))
    return rows


def facet_values(value: Column, kind: str) -> Column:
    """The values of a facet as an array of text: a flag is oui or non, no value is no entry."""
    if kind == "boolean":
        return F.when(value.isNotNull(), F.array(F.when(value, "oui").otherwise("non")))
    if kind.startswith("array"):
        return F.filter(value, lambda v: v != "")
    return F.when(~blank(value.cast("string")), F.array(value.cast("string")))


def crossed(photos: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """Photos that have all chosen values of all facets, regardless of case."""
    rows = photos
    for facet, values in chosen.items():
        have = F.transform(F.coalesce(facet_values(F.col(facet), photos.schema[facet].dataType.simpleString()), F.array().cast("array<string>")), F.lower)
        for v in values:
            rows = rows.where(F.array_contains(have, v.lower()))
    return rows


def _long(photos: DataFrame, facets: list[str]) -> DataFrame:
    named = [F.struct(F.lit(f).alias("facet"), facet_values(F.col(f), photos.schema[f].dataType.simpleString()).alias("values")) for f in facets]
    return photos.select(F.explode(F.array(*named)).alias("x")).select("x.facet", F.explode("x.values").alias("value"))


def domains(photos: DataFrame, facets: list[str], most: int = 80) -> DataFrame:
    """The first values of each facet over all photos, in the order of a French dictionary; values that it takes for the
    same follow by their bytes."""
    rows = _long(photos, facets).distinct()
    order = Window.partitionBy("facet").orderBy(F.collate("value", "fr"), "value")
    return rows.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= most)


def facet_counts(photos: DataFrame, facets: list[str], chosen: dict[str, list[str]]) -> DataFrame:
    """For each value of each facet, the photos that would remain were it chosen too: one aggregate, no rescans."""
    counts = _long(crossed(photos, chosen), facets).groupBy("facet", F.lower("value").alias("low")).agg(F.count("*").alias("n"))
    rows = domains(photos, facets).withColumn("low", F.lower("value")).join(counts, ["facet", "low"], "left")
    return rows.select("facet", "value", F.coalesce("n", F.lit(0)).alias("n"))


def totals(photos: DataFrame, files: DataFrame) -> DataFrame:
    """Counts over all photos; a thumbnail counts if it is among the files (path)."""
    there = files.select(F.col("path").alias("vignette"), F.lit(True).alias("_there")).distinct()
    rows = photos.join(there, "vignette", "left")
    return rows.agg(F.count("*").alias("photos"), F.count_if("a_verifier").alias("to_verify"), F.count_if(~blank(F.col("description"))).alias("described"), F.count_if("_there").alias("with_thumbnail"), F.count_distinct(F.nullif("type_image", F.lit(""))).alias("types"))


#: The entries of an EXIF table that a photo keeps, and what they are called.
EXIF = {"objectif": "LensModel", "iso": "ISOSpeedRatings", "ouverture": "FNumber", "vitesse": "ExposureTime", "focale": "FocalLength"}


def exif_texts(exif: Column) -> Column:
    """An EXIF table of variants as a map of texts: a rational is a/b, bytes (hidden as objects) and nulls are no text."""

    def text(_: Column, v: Column) -> Column:
        kind = F.schema_of_variant(v)
        parts = F.array_join(F.try_variant_get(v, "$", "array<string>"), "/")
        return F.when(kind.startswith("ARRAY"), parts).when(kind.startswith("OBJECT") | kind.startswith("BINARY") | F.is_variant_null(v), "").otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))

    return F.transform_values(exif, text)


def shaped(photos: DataFrame, exif: str) -> DataFrame:
    """Photos with orientation, date (of the shot, else of the file), device and EXIF values, from a map of variants."""
    rows = photos.withColumn("_exif", F.coalesce(exif_texts(F.col(exif)), F.create_map().cast("map<string,string>")))
    get = lambda k: F.coalesce(F.try_element_at("_exif", F.lit(k)), F.lit(""))
    device = F.trim(F.array_join(F.filter(F.array(get("Make"), get("Model")), lambda x: x != ""), " "))
    shape = F.when(F.col("largeur") > F.col("hauteur"), "paysage").when(F.col("hauteur") > F.col("largeur"), "portrait").otherwise("carré")
    made = {"orientation": shape, "date_photo": first_truthy(get("DateTimeOriginal"), get("DateTime")), "appareil": device, **{name: get(tag) for name, tag in EXIF.items()}}
    return rows.withColumns(made).drop("_exif", exif)


def upserted(old: DataFrame, new: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """All keys; facts from the new row, texts in kept from the old row where it has them."""
    a, b = old.alias("a"), new.alias("b")
    rows = a.join(b, key, "full_outer")
    cols = [F.coalesce(F.nullif(F.col(f"a.{c}"), F.lit("")), F.col(f"b.{c}")).alias(c) if c in kept else F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in new.columns if c != key]
    return rows.select(key, *cols)


def replaced(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """rows with those that are in new taken from there."""
    return rows.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def media(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """Files with one of the suffixes, whatever its case; hidden ones are left out."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.where(suffix.isin(suffixes) & ~F.col("path").rlike(r"(^|/)\.[^/]*$"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two listings: added, removed or changed."""
    a, b = before.select("path", F.struct("size", "mtime").alias("a")), after.select("path", F.struct("size", "mtime").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return a.join(b, "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("path", change.alias("change"))


#: Fields of a photo's analysis in the published index, with their types.
INDEXED = {
    "description": "string",
    "type_image": "string",
    "sujets": "array<string>",
    "personnes": "array<string>",
    "objets": "array<string>",
    "lieux": "array<string>",
    "texte_visible": "string",
    "lumiere": "string",
    "composition": "string",
    "couleurs": "array<string>",
    "ambiance": "array<string>",
    "qualite_technique": "string",
    "usage_catalogue": "array<string>",
    "mots_cles": "array<string>",
    "criteres_repondus": "array<string>",
    "certitude": "string",
    "a_verifier": "string",
    "note": "string",
}


def synchronised(listing: DataFrame, stored: DataFrame, key: str, kept: list[str], most: int = 20) -> tuple[DataFrame, DataFrame]:
    """The photos of a listing, and the first errors by key.

    Known ones keep the stored columns in kept, new ones have none, those that are listed no more are gone. A listed
    file that couldn't be read (column error) is no photo but an error."""
    facts = [c for c in listing.columns if c != "error"]
    rows = listing.where("error is null").select(facts).join(stored.select(key, *kept), key, "left")
    errors = listing.where("error is not null").select(key, "error").orderBy(key).limit(most)
    return rows, errors


def index(photos: DataFrame, analysis: str = "analyse") -> DataFrame:
    """Photos with the fields of their analysis (a struct) as columns: an empty list or text where one is missing."""
    known = {f.name: f.dataType.simpleString() for f in photos.schema[analysis].dataType.fields}

    def cell(name: str, kind: str) -> Column:
        empty = F.array().cast(kind) if kind != "string" else F.lit("")
        return F.coalesce(F.col(f"{analysis}.{name}").cast(kind), empty) if name in known else empty

    return photos.select(*(c for c in photos.columns if c not in INDEXED), *(cell(n, k).alias(n) for n, k in INDEXED.items()))


def progress(listing: DataFrame, done: DataFrame, key: str, active: bool, model: str) -> DataFrame:
    """One row on a run: active, phase, how many of how many, per cent, the last item, model, finished."""
    total = listing.agg(F.count("*").alias("total"))
    made = done.agg(F.count("*").alias("current"), F.max(key).alias("item"))
    rows = total.crossJoin(made)
    return rows.select(
        F.lit(active).alias("active"),
        F.lit("analyse photo active" if active else "photo arrêtée").alias("phase"),
        "current",
        "total",
        F.when(F.col("total") > 0, F.bround(100 * F.col("current") / F.col("total"))).otherwise(0).cast("long").alias("percent"),
        F.col("item").cast("string").alias("item"),
        F.lit(model).alias("model"),
        (F.lit(not active) & (F.col("total") > 0) & (F.col("current") >= F.col("total"))).alias("finished"),
    )
