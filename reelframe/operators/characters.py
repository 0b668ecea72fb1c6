"""Recurring characters: ordered leader clustering of face vectors, profile groups, summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.functions.text import fold

JOIN = 0.82
LEAST_SHOTS = 2
LEAST_PROFILE_SHOTS = 6
MOST = 24
#: Folded values that tell nothing of a person, and what a person without a profile is called.
UNDETERMINED = ["genre indetermine", "age indetermine"]
STOP = [*UNDETERMINED, "aucun", "aucune", "indetermine", "indeterminee", "non visible"]
NAMELESS = "personnage visible récurrent probable"


def leaders(vectors: np.ndarray, join: float = JOIN) -> np.ndarray:
    """The cluster of each vector, in order: the most similar centre if it is similar enough, else a new one.

    A centre is the running mean of its members, scaled to unit length."""
    out = np.zeros(len(vectors), np.int64)
    centres = np.zeros((16, vectors.shape[1]))
    counts: list[int] = []
    for i, v in enumerate(vectors):
        if counts:
            c = centres[: len(counts)]
            likeness = c @ v / (np.sqrt((c * c).sum(1)) * np.sqrt(v @ v) + 1e-9)
            best = int(likeness.argmax())
        if not counts or likeness[best] < join:
            if len(counts) == len(centres):
                centres = np.concatenate([centres, np.zeros_like(centres)])
            best = len(counts)
            centres[best] = v
            counts.append(1)
        else:
            counts[best] += 1
            mean = (centres[best] * (counts[best] - 1) + v) / counts[best]
            norm = np.sqrt(mean @ mean)
            centres[best] = mean / norm if norm > 0 else mean
        out[i] = best
    return out


def clustered(faces: DataFrame, join: float = JOIN) -> DataFrame:
    """(film_id, n, cluster) of each face. The centre moves with each member, so a film is read in order as one group."""

    def fold_film(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        return pd.DataFrame({"film_id": rows.film_id, "n": rows.n, "cluster": leaders(np.stack(rows.embedding).astype(float), join)})

    kind = {f.name: f.dataType.simpleString() for f in faces.schema}
    return faces.select("film_id", "n", "embedding").groupBy("film_id").applyInPandas(fold_film, f"film_id {kind['film_id']}, n {kind['n']}, cluster long")


def _chosen(values: Column) -> Column:
    """Folded values that say something."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), fold), lambda x: (x != "") & ~x.isin(*UNDETERMINED))


def profile_key(genders: Column, ages: Column) -> Column:
    """The first two genders and ages in folded order, as "a+b|c+d"; a bar alone where there are none."""
    part = lambda c: F.array_join(F.slice(F.array_sort(_chosen(c)), 1, 2), "+")
    return F.concat_ws("|", part(genders), part(ages))


def profile_label(genders: Column, ages: Column, subjects: Column, attitudes: Column) -> Column:
    """What a profile is called: genders, ages, and of subjects and attitudes the first one of two that says something."""
    empty = F.array().cast("array<string>")
    telling = lambda c: F.filter(F.coalesce(c, empty), lambda x: (x != "") & ~fold(x).isin(*STOP))
    two = lambda c: F.nullif(F.array_join(F.slice(telling(c), 1, 2), "/"), F.lit(""))
    one = lambda c: F.try_element_at(F.filter(F.slice(telling(c), 1, 2), lambda x: F.length(fold(x)) > 4), F.lit(1))
    made = F.concat_ws(" · ", two(genders), two(ages), one(subjects), one(attitudes))
    return F.when(made == "", NAMELESS).otherwise(made)


def profiles(shots: DataFrame, least: int = LEAST_PROFILE_SHOTS) -> DataFrame:
    """(film_id, profile, shots, first) of the profiles that enough shots with visible persons have.

    shots: film_id, n, persons, profile (a key; one without any value is none)"""
    rows = shots.where(F.col("persons") & (F.replace("profile", F.lit("|"), F.lit("")) != ""))
    return rows.groupBy("film_id", "profile").agg(F.count_distinct("n").alias("shots"), F.min("n").alias("first")).where(F.col("shots") >= least)


def recurring(faces: DataFrame, shots: DataFrame, most: int = MOST) -> DataFrame:
    """Characters of each film: clusters of faces and, as a safety net, groups of shots with one profile, by number of
    shots, faces first, then in order of appearance; the first ones, numbered.

    faces: film_id, n, cluster. shots: film_id, n, scene_id, image, persons, profile, label. A character has its detections,
    shots and scenes, their lists, its most common label (the first of equally common ones) and its first image."""
    seen = shots.select("film_id", "n", "scene_id", "image", "label")
    by_face = faces.select("film_id", "n", F.lit(0).alias("source"), F.col("cluster").cast("string").alias("key"), F.col("cluster").alias("at")).join(seen, ["film_id", "n"], "left")
    groups = profiles(shots).select("film_id", F.col("profile").alias("key"), F.col("first").alias("at"))
    by_profile = shots.where("persons").withColumnRenamed("profile", "key").join(groups, ["film_id", "key"]).select("film_id", "n", F.lit(1).alias("source"), "key", "at", "scene_id", "image", "label")
    rows = by_face.unionByName(by_profile)
    group = ["film_id", "source", "key"]
    # labels are counted before a group is gathered
    names = rows.where(F.coalesce("label", F.lit("")) != "").groupBy(*group, "label").agg(F.count("*").alias("c"), F.min("n").alias("first"))
    names = names.groupBy(*group).agg(F.min(F.struct((-F.col("c")).alias("c"), "first", "label"))["label"].alias("profil_resume"))
    set_ = lambda c: F.nullif(F.col(c), F.lit(""))
    made = rows.groupBy(*group).agg(
        F.min("at").alias("at"),
        F.count("*").alias("occurrences_visuelles"),
        F.count_distinct("n").alias("occurrences_plans"),
        F.count_distinct(set_("scene_id")).alias("occurrences_scenes"),
        F.array_sort(F.collect_set("n")).alias("plans"),
        F.array_sort(F.collect_set(set_("scene_id"))).alias("scenes"),
        F.min(F.when(set_("image").isNotNull(), F.struct("n", "image")))["image"].alias("vignette"),
    )
    made = made.where((F.col("source") == 1) | (F.col("occurrences_plans") >= LEAST_SHOTS)).join(names, group, "left")
    order = Window.partitionBy("film_id").orderBy(F.desc("occurrences_plans"), "source", "at")
    made = made.withColumn("number", F.row_number().over(order).cast("long")).where(F.col("number") <= most)
    sure = (F.col("source") == 0) & (F.col("occurrences_plans") >= max(3, LEAST_SHOTS))
    return made.select(
        "film_id",
        F.format_string("personnage_%03d", "number").alias("personnage_id"),
        F.format_string("Personnage récurrent probable %03d", "number").alias("label"),
        F.coalesce("profil_resume", F.lit("personnage récurrent probable")).alias("profil_resume"),
        "occurrences_visuelles",
        "occurrences_plans",
        "occurrences_scenes",
        "plans",
        "scenes",
        F.coalesce("vignette", F.lit("")).alias("vignette"),
        F.when(F.col("source") == 0, "visage").otherwise("profil").alias("methode"),
        F.when(sure, "moyenne").otherwise("faible").alias("confiance"),
    )
