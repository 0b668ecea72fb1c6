"""Counts by film and over the whole catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.functions.numbers import share
from reelframe.functions.text import blank, first_truthy

from .labels import prepared
from .scoring import attempted, complete3, complete4


def _counted(shots: DataFrame, complete: Column) -> DataFrame:
    """Shots of each film in all, prepared, attempted and complete; a film is finished if all are complete, or all are
    prepared and attempted and at most five in a thousand aren't complete."""
    rows = shots.groupBy("film_id").agg(F.count("*").alias("total"), F.count_if(prepared(F.col("vignette"), F.col("vignettes"))).alias("prepared"), F.count_if(attempted(shots)).alias("attempted"), F.count_if(complete).alias("complete"))
    nearly = (F.col("prepared") >= F.col("total")) & (F.col("attempted") >= F.col("total")) & (F.col("complete") / F.col("total") >= 0.995)
    return rows.withColumn("finished", (F.col("total") > 0) & ((F.col("complete") >= F.col("total")) | nearly))


def film_progress(shots: DataFrame) -> DataFrame:
    """Counts of each film, with a shot complete once it has description, scale and place, and whole per cents."""
    rows = _counted(shots, complete3())
    return rows.withColumns({"percent_prepared": share(F.col("prepared"), F.col("total")), "percent": share(F.col("complete"), F.col("total"))})


def unfinished(shots: DataFrame) -> DataFrame:
    """Films with shots that aren't complete in all four fields."""
    return shots.groupBy("film_id").agg(F.count_if(complete4()).alias("done"), F.count("*").alias("total")).where("done < total")


def totals(films: DataFrame, shots: DataFrame) -> DataFrame:
    """One row of counts over all films and shots."""
    set_ = lambda c: F.count_if(~blank(F.trim(c)))
    context = ~(blank(first_truthy(F.col("pitch"), F.col("synopsis"))) | blank(F.col("scenario")))
    of_films = films.agg(F.count("*").alias("films"), F.count_if(context).alias("contextes_films"), F.coalesce(F.sum("scenes"), F.lit(0)).cast("long").alias("scenes"), F.coalesce(F.sum("personnages_recurrents"), F.lit(0)).cast("long").alias("personnages_recurrents"))
    of_shots = shots.agg(
        F.count("*").alias("plans"),
        F.count_if("machine").alias("machines"),
        F.count_if("dialogue").alias("dialogues"),
        F.count_if(F.col("affinage").isNotNull()).alias("affinages"),
        set_("mouvement_camera").alias("mouvements_camera"),
        set_("mouvement_video_modele").alias("mouvements_camera_video"),
        set_("mouvement_camera_final").alias("mouvements_camera_final"),
        F.count_if("mouvement_camera_conflit").alias("mouvements_camera_conflits"),
    )
    return of_films.crossJoin(of_shots)  # one row each


def dominant_model(shots: DataFrame, films: DataFrame, default: str = "") -> DataFrame:
    """The model that annotated most shots of a film; of equally frequent ones the first by name. A shot's model is its
    own, else that of its analysis; a film without any takes the one of its record (films.modele), or the default."""
    model = first_truthy(F.trim("modele"), F.trim("modele_analyse"))
    counts = shots.select("film_id", model.alias("m")).where("m <> ''").groupBy("film_id", "m").count()
    best = counts.groupBy("film_id").agg(F.min_by("m", F.struct(-F.col("count"), F.col("m"))).alias("best"))
    rows = shots.select("film_id").distinct().join(best, "film_id", "left").join(films.select("film_id", F.trim("modele").alias("told")), "film_id", "left")
    return rows.select("film_id", first_truthy(F.col("best"), F.col("told"), F.lit(default)).alias("modele"))


def film_states(films: DataFrame, shots: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """Of each film of the listing: absent (no shots), illisible (its document can't be read), incomplet or complet. Here a
    shot is complete with all four fields."""
    seen = _counted(shots, complete4()).select("film_id", "finished")
    rows = films.join(seen, "film_id", "left")
    broken = F.lit(False)
    if unreadable is not None:
        rows, broken = rows.join(unreadable.select("film_id", F.lit(True).alias("_broken")).distinct(), "film_id", "left"), F.col("_broken").isNotNull()
    state = F.when(broken, "illisible").when(F.col("finished").isNull(), "absent").when(F.col("finished"), "complet").otherwise("incomplet")
    return rows.select("film_id", state.alias("state"))


def without(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows that have no counterpart."""
    return rows.join(others.select(key).distinct(), key, "left_anti")


def top(rows: DataFrame, group: list[str], value: str, k: int) -> DataFrame:
    """The k most frequent values of each group, ties by value, with their count and rank."""
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("n"))
    window = Window.partitionBy(*group).orderBy(F.desc("n"), value)
    return counts.withColumn("rank", F.row_number().over(window).cast("long")).where(F.col("rank") <= k)


def dialogue_summary(segments: DataFrame, attached: DataFrame) -> DataFrame:
    """Segments and shots with dialogue of each film, and grand totals where film_id is null.

    attached: (film_id, n) of the shots that segments overlap, repeats allowed"""
    heard = attached.select("film_id", "n").distinct()
    rows = segments.select("film_id", F.lit(1).alias("segment"), F.lit(0).alias("shot")).unionByName(heard.select("film_id", F.lit(0).alias("segment"), F.lit(1).alias("shot")))
    return rows.rollup("film_id").agg(F.sum("segment").cast("long").alias("segments"), F.sum("shot").cast("long").alias("shots_with_dialogue"))


def layer_coverage(shots: DataFrame, films: DataFrame) -> DataFrame:
    """Of each film with shots: those with dialogue, where the dialogue comes from (stated by the film, else the first two
    sources of its shots), those with music, audio sequences, refined shots."""
    said = F.coalesce("dialogue", F.lit(False)) | ~blank(F.trim("dialogue_texte"))
    music = F.coalesce("musique_presente", F.lit(False)) | F.col("audio_detaille").isNotNull() | ~blank(F.col("audio_global_ref"))
    sources = F.array_sort(F.collect_set(F.nullif(F.trim("dialogue_source"), F.lit(""))))
    rows = shots.groupBy("film_id").agg(F.count_if(said).alias("dialogues_plans"), sources.alias("sources"), F.count_if(music).alias("musique_plans"), F.count_if(F.col("affinage").isNotNull()).alias("affinages_plans"))
    rows = rows.join(films.select("film_id", F.col("dialogue_source").alias("stated"), "sequences"), "film_id", "left")
    source = first_truthy(F.col("stated"), F.array_join(F.slice("sources", 1, 2), " · "))
    return rows.select("film_id", "dialogues_plans", source.alias("dialogues_source"), "musique_plans", F.coalesce("sequences", F.lit(0)).cast("long").alias("musique_sequences"), "affinages_plans")


def movement_summary(shots: DataFrame, most: int = 5) -> DataFrame:
    """Of each film: shots with a measured movement and with a video class, with their whole per cents of all shots;
    conflicts; the most frequent final movements (the measured one where there is no final one) and video classes as
    (label, plans, pourcentage); shots by confidence as a map; video models in order.

    Each shot gives a few (kind, label) rows, which are counted before they are shuffled: what is gathered for a film is
    one row for each label, however many shots it has."""
    final = F.trim(first_truthy(F.col("mouvement_camera_final"), F.col("mouvement_camera")))
    entry = lambda kind, label, when: F.when(when, F.struct(F.lit(kind).alias("kind"), label.alias("label")))
    none, set_ = F.lit(""), lambda c: ~blank(F.trim(c))
    entries = [
        entry("all", none, F.lit(True)),
        entry("measured", none, ~blank(F.col("mouvement_camera")) | ~blank(F.col("mouvement_camera_final"))),
        entry("conflict", none, F.coalesce("mouvement_camera_conflit", F.lit(False))),
        entry("classed", none, ~blank(F.col("mouvement_video_camera"))),
        entry("final", final, final != ""),
        entry("video", F.trim("mouvement_video_camera"), set_("mouvement_video_camera")),
        entry("trust", F.trim("mouvement_confiance"), set_("mouvement_confiance")),
        entry("model", F.trim("mouvement_video_modele"), set_("mouvement_video_modele")),
    ]
    rows = shots.select("film_id", F.inline(F.array_compact(F.array(*entries))))
    counts = rows.groupBy("film_id", "kind", "label").agg(F.count("*").alias("k"))
    only = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("k"))), F.lit(0))
    listed = lambda kind, what: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, what)))
    ranked = F.struct((-F.col("k")).alias("k"), "label")
    films = counts.groupBy("film_id").agg(
        *(only(k).alias(k) for k in ("all", "measured", "conflict", "classed")),
        listed("final", ranked).alias("final"),
        listed("video", ranked).alias("video"),
        listed("trust", F.struct("label", "k")).alias("trust"),
        listed("model", F.col("label")).alias("models"),
    )
    top = lambda c: F.transform(F.slice(c, 1, most), lambda x: F.struct(x["label"].alias("label"), (-x["k"]).alias("plans"), share(-x["k"], F.col("all")).alias("pourcentage")))
    return films.select(
        "film_id",
        F.col("measured").alias("mouvements_camera_plans_mesures"),
        share(F.col("measured"), F.col("all")).alias("mouvements_camera_pourcentage"),
        top("final").alias("mouvements_camera_principaux"),
        F.map_from_entries("trust").alias("mouvements_camera_confiances"),
        F.col("conflict").alias("mouvements_camera_conflits"),
        F.col("classed").alias("mouvements_video_plans_classes"),
        share(F.col("classed"), F.col("all")).alias("mouvements_video_pourcentage"),
        top("video").alias("mouvements_video_principaux"),
        F.col("models").alias("mouvements_video_modeles"),
    )
