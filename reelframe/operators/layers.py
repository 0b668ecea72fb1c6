"""Layers back on shots, and small derived fields: members, previews, provenance, identification, sort orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.functions.text import blank, first_truthy, shorten

#: Phrases of descriptions that speak of several images, and what a single shot's description says.
ORDINALS = {"première image": "au début du plan", "premier plan": "au début du plan", "seconde image": "puis", "deuxième plan": "puis", "troisième image": "enfin", "troisième plan": "enfin"}
VERBS = {"affiche": {"au début du plan": "Au début du plan apparaît", "puis": "puis apparaît", "enfin": "enfin apparaît"}, "montre": {"au début du plan": "Au début du plan, on voit", "puis": "puis on voit", "enfin": "enfin on voit"}}


def members(groups: DataFrame, shots: DataFrame, fields: list[str], into: str) -> DataFrame:
    """shots with an array of the groups that they belong to; groups: (film_id, plans, fields)."""
    rows = groups.select("film_id", F.explode("plans").alias("n"), F.struct(*fields).alias("g"))
    listed = rows.groupBy("film_id", "n").agg(F.array_sort(F.collect_list("g")).alias(into))
    none = F.array().cast(listed.schema[into].dataType)
    return shots.join(listed, ["film_id", "n"], "left").withColumn(into, F.coalesce(into, none))


def last_member(groups: DataFrame, shots: DataFrame, fields: list[str], order: str) -> DataFrame:
    """shots with the fields of the last group, by order, that they belong to."""
    rows = groups.select("film_id", F.explode("plans").alias("n"), order, F.struct(*fields).alias("g"))
    last = rows.groupBy("film_id", "n").agg(F.max_by("g", order).alias("g"))
    return shots.join(last, ["film_id", "n"], "left").select(*shots.columns, *(F.col(f"g.{f}").alias(f) for f in fields))


def preview(start: Column, end: Column) -> tuple[Column, Column]:
    """Bounds of a shot's preview, never empty."""
    return F.bround(start, 3), F.bround(F.when(end <= start, start + 0.20).otherwise(end), 3)


def preview_rate(start: Column, end: Column, rate: float, most: int) -> Column:
    """Frames a second of a preview of at most so many images."""
    return F.least(F.lit(rate), F.greatest(F.lit(2.0), most / F.greatest(end - start, F.lit(0.2))))


def preview_length(start: Column, end: Column, rate: float, most: int, trim: int) -> Column:
    """Seconds of a preview: its last trim images are left out, unless it gets shorter than two images or 0.08 seconds."""
    per_second = F.greatest(preview_rate(start, end, rate, most), F.lit(1.0))
    whole, least = F.greatest(end - start, F.lit(0.2)), F.greatest(F.lit(0.08), 2.0 / per_second)
    return F.when((F.lit(trim) > 0) & (whole > least), F.greatest(least, whole - trim / per_second)).otherwise(whole)


def orientation(width: Column, height: Column) -> Column:
    return F.when(width > height, "paysage").when(width < height, "portrait").otherwise("carré")


def up_to_date(description: Column, stored: Column, current: Column) -> Column:
    """Whether a photo has a description and the signature it was made for still holds."""
    return ~blank(description) & stored.eqNullSafe(current)


def provenance(title: Column, year: Column, pitch: Column, synopsis: Column, scenario: Column, sources: Column) -> Column:
    """Which of a film's texts a request was given."""
    has, text = (lambda c: ~blank(c)), (lambda c: F.coalesce(c, F.lit("")))
    return F.struct(text(title).alias("titre"), year.alias("annee"), has(pitch).alias("pitch"), shorten(pitch, 240).alias("pitch_extrait"), has(synopsis).alias("synopsis"), has(scenario).alias("scenario"), F.coalesce(sources, F.array().cast("array<string>")).alias("sources"))


def scene_provenance(scene: Column) -> Column:
    """Which of a scene's texts (a struct) a request was given; null without a scene."""
    has, text = (lambda f: ~blank(scene[f])), (lambda f: F.coalesce(scene[f], F.lit("")))
    made = F.struct(text("scene_id").alias("scene_id"), scene["numero_scene"].alias("numero_scene"), text("titre").alias("titre"), has("resume_scene").alias("resume_scene"), has("contexte_pour_plans").alias("contexte_pour_plans"), text("methode").alias("methode"))
    return F.when(scene.isNotNull(), made)


def one(rows: DataFrame, film: object, n: int) -> DataFrame:
    """The one shot of this number; an error if it is missing or there are several."""
    found = rows.where((F.col("film_id") == film) & (F.col("n") == n))
    count = found.agg(F.count("*").alias("_c"))
    checked = count.select(F.when(F.col("_c") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("shots found: "), F.col("_c").cast("string")))).alias("_ok"))
    return F.broadcast(checked).crossJoin(found).where("_ok").drop("_ok")


def overridden(rows: DataFrame, overrides: DataFrame, key: str, field: str) -> DataFrame:
    given = overrides.select(key, F.col(field).alias("_o"))
    return rows.join(given, key, "left").withColumn(field, F.coalesce("_o", field)).drop("_o")


def single_shot(description: Column) -> Column:
    """A description that speaks of first, second and third images, told as one shot."""
    out = F.trim(F.coalesce(description, F.lit("")))
    for verb, told in VERBS.items():
        for name, place in ORDINALS.items():
            out = F.regexp_replace(out, rf"\b[Ll][ae] {name} {verb}\b", told[place])
    for name, place in ORDINALS.items():
        out = F.regexp_replace(out, rf"\b[Ll][ae] {name}\b", place)
    out = F.regexp_replace(F.regexp_replace(out, r"\s+,", ","), r"\s{2,}", " ")
    for start in ("puis apparaît", "puis on voit", "enfin apparaît", "enfin on voit"):
        out = F.replace(out, F.lit(f", {start}"), F.lit(f". {start[0].upper()}{start[1:]}"))
    return F.trim(out)


def timeline(segments: DataFrame, *fields: str) -> DataFrame:
    """(film_id, n, timeline): each shot's segments in order."""
    return segments.groupBy("film_id", "n").agg(F.array_sort(F.collect_list(F.struct("debut", "fin", *fields))).alias("timeline"))


def rolled_up(sequences: DataFrame) -> DataFrame:
    """Of each film, how many audio sequences there are and how many have music, and their distinct families, sub-genres and
    kinds of sound design in order regardless of case. Fingerprints aren't carried.

    sequences: film_id, musique_presente, and three lists"""
    lists = ["musique_familles", "musique_sous_genres", "design_sonore_types"]
    # each value once before anything is gathered
    values = sequences.select("film_id", F.inline(F.array(*(F.struct(F.lit(c).alias("kind"), F.coalesce(c, F.array().cast("array<string>")).alias("values")) for c in lists))))
    values = values.select("film_id", "kind", F.explode("values").alias("v")).where("v <> ''").distinct()
    of = lambda c: F.transform(F.array_sort(F.array_compact(F.collect_list(F.when(F.col("kind") == c, F.struct(F.lower("v").alias("low"), "v"))))), lambda x: x["v"]).alias(c)
    counts = sequences.groupBy("film_id").agg(F.count("*").alias("sequences_count"), F.count_if(F.coalesce("musique_presente", F.lit(False))).alias("sequences_musicales_count"))
    rows = counts.join(values.groupBy("film_id").agg(*(of(c) for c in lists)), "film_id", "left")
    return rows.select("film_id", "sequences_count", "sequences_musicales_count", *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in lists))


def catalogue_order(photos: DataFrame, mode: str) -> DataFrame:
    """Photos in one of the catalogue's orders, texts by French collation: file; date (as text, newest first; the time of
    change where there is none); type; certainty; those to verify first. What is equal comes by file, so the order is one."""
    has = set(photos.columns)
    text = lambda c: F.collate(F.coalesce(F.col(c).cast("string"), F.lit("")), "fr")
    when = F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("date_photo", "mtime") if c in has), F.lit(""))
    orders = {"file": lambda: [], "date": lambda: [F.desc(when)], "type": lambda: [text("type_image")], "certainty": lambda: [text("certitude")], "verify": lambda: [F.desc("a_verifier")]}
    return photos.orderBy(*orders[mode](), *([text("fichier"), "fichier"] if "fichier" in has else []))
