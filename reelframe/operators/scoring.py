"""Predicates and scores of shots: completeness, doubt, typography, sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.functions.text import blank, fold_keeping_signs

#: Hints of visible writing, matched inside words.
WRITING = ["texte", "typographie", "titre", "générique", "generique", "carton", "intertitre", "sous-titre", "soustitre", "credit", "crédit", "enseigne", "signalétique", "signaletique", "affiche", "journal", "lettrage", "lettre", "logo", "panneau"]


def complete4() -> Column:
    return ~(blank(F.col("echelle")) | blank(F.col("lieu")) | blank(F.col("description")) | blank(F.col("mots_cles")))


def complete3() -> Column:
    return ~(blank(F.col("echelle")) | blank(F.col("lieu")) | blank(F.col("description")))


def attempted(shots: DataFrame) -> Column:
    """Whether a shot is complete or anything says that a model has read it: the model's name on the shot or in its
    analysis, when it was measured, or how long that took, a zero included. Columns that the shots lack say nothing."""
    out = complete4()
    for c in ("modele", "modele_analyse", "analyse_mesuree_le"):
        if c in shots.columns:
            out = out | ~blank(F.trim(c))
    return out | F.col("temps_analyse_secondes").isNotNull() if "temps_analyse_secondes" in shots.columns else out


def context_current(pitch: Column, synopsis: Column, scenario: Column) -> Column:
    """Whether a shot was analysed with all three texts on its film."""
    return ~(blank(pitch) | blank(synopsis) | blank(scenario))


def analysed(mode: str, current: Column | None = None) -> Column:
    """Whether a shot needs no analysis: of the mode triage if machine is stated at all, of complet if the four
    descriptive fields are there, of any other if one is; with current, only if that holds too."""
    fields = ["echelle", "lieu", "description", "mots_cles"]
    some = F.lit(False)
    for f in fields:
        some = some | ~blank(F.col(f))
    done = {"triage": F.col("machine").isNotNull(), "complet": complete4()}.get(mode, some | F.col("machine").isNotNull())
    return done if current is None else done & F.coalesce(current, F.lit(False))


def _sum(parts: list[Column]) -> Column:
    total = F.lit(0)
    for p in parts:
        total = total + p
    return total.cast("long")


def _reasons(parts: list[tuple[Column, Column]]) -> Column:
    return F.array_compact(F.array(*(F.when(c, r) for c, r in parts)))


def doubt(shots: DataFrame, refined: Column | None = None, analysed: Column | None = None) -> DataFrame:
    """score and reasons: how much a shot needs to be read again; a shot refined without error, or not analysed, scores 0.

    Weights: certainty in doubt 5, probable 3, none 2; a machine without type 4 or without display 2; 2 for each of the
    descriptive fields that is missing. Columns that the shots lack count as missing, but a lighting column that isn't
    there at all is left out."""
    has = set(shots.columns)
    col = lambda c: F.col(c) if c in has else F.lit("")
    sure, machine = F.col("certitude"), F.coalesce("machine", F.lit(False))
    typed = ~blank(col("machine_types")) if "machine_types" in has else F.lit(False)
    named = [("description", "description absente"), ("mots_cles", "mots-clés absents"), ("echelle", "échelle absente"), ("lieu", "lieu absent")]
    if "lumiere" in has:
        named.append(("lumiere", "lumière absente"))
    rules = [
        (sure == "douteux", 5, F.lit("certitude douteux")),
        (sure == "probable", 3, F.lit("certitude probable")),
        (blank(sure), 2, F.lit("certitude absente")),
        (machine & ~typed, 4, F.lit("machine visible sans type d’appareil")),
        (machine & blank(col("interface")), 2, F.lit("machine visible sans typologie d’affichage")),
        *((blank(F.col(c)), 2, F.lit(label)) for c, label in named),
    ]
    rules = [(F.coalesce(c, F.lit(False)), w, r) for c, w, r in rules]
    score = _sum([F.when(c, w).otherwise(0) for c, w, _ in rules])
    reasons = _reasons([(c, r) for c, _, r in rules])
    done = F.lit(False) if refined is None else F.coalesce(refined, F.lit(False))
    return shots.withColumns(_gated(score, reasons, done | _without(analysed)))


def _without(analysed: Column | None) -> Column:
    return F.lit(False) if analysed is None else ~F.coalesce(analysed, F.lit(False))


def _gated(score: Column, reasons: Column, done: Column, forced: str | None = None) -> dict[str, Column]:
    """score and reasons, nothing where a shot is done; where all shots are forced, 1 for that reason."""
    if forced is not None:
        score, reasons = F.lit(1), F.array(F.lit(forced))
    return {"score": F.when(done, 0).otherwise(score).cast("long"), "reasons": F.when(done, F.array().cast("array<string>")).otherwise(reasons)}


def typography(shots: DataFrame, hints: list[str] | None = None, done: Column | None = None, forced: bool = False, analysed: Column | None = None) -> DataFrame:
    """score and reasons of a shot as a bearer of writing, from flags and from hints inside its folded text.

    A shot without analysis, or done without error, scores 0; with forced, every other one scores 1."""
    has = set(shots.columns)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in has else F.lit(False)
    # the folded text and what is found in it are columns, so that each is made once
    text, found = F.col("_text"), F.col("_found")
    hints = WRITING if hints is None else hints
    rows = shots.withColumn("_text", fold_keeping_signs(F.concat_ws(" ", "description", "mots_cles", "interface")))
    rows = rows.withColumn("_found", F.array_compact(F.array(*(F.when(F.contains(text, F.lit(h)), F.lit(h)) for h in hints))))
    oversized = F.coalesce(F.col("interface") == "typographie surdimensionnée", F.lit(False))
    score = _sum([F.when(flag("texte_visible"), 8).otherwise(0), F.when(flag("generique"), 8).otherwise(0), F.when(oversized, 5).otherwise(0), F.when(F.size(found) > 0, F.least(F.lit(6), F.size(found) + 2)).otherwise(0)])
    told = [(flag("texte_visible"), F.lit("texte visible déjà détecté")), (flag("generique"), F.lit("plan lié au générique déjà détecté")), (oversized, F.lit("interface typographique déjà signalée"))]
    listed = F.slice(F.array_sort(F.array_distinct(found)), 1, 4)
    told.append((F.size(found) > 0, F.concat(F.lit("indices textuels : "), F.array_join(listed, ", "))))
    past = (F.lit(False) if done is None else F.coalesce(done, F.lit(False))) | _without(analysed)
    made = {"hints": listed, **_gated(score, _reasons(told), past, "relecture typographique forcée sur tout le corpus" if forced else None)}
    return rows.withColumns(made).drop("_text", "_found")


def sound(shots: DataFrame, done: Column | None = None, forced: bool = False, number: int | None = None) -> DataFrame:
    """score and reasons of a shot for a closer listening; dialogue is a flag, the two kinds are arrays where there are any.

    A shot done without error scores 0, and with a number every shot of another number; with forced, the others score 1."""
    has = set(shots.columns)
    kinds = lambda c, none: F.exists(F.coalesce(F.col(c), F.array()), lambda x: (x != "") & (x != none)) if c in has else F.lit(False)
    rules = [
        (F.coalesce("dialogue", F.lit(False)) | (~blank(F.trim("dialogue_texte")) if "dialogue_texte" in has else F.lit(False)), 4, "dialogue déjà indexé"),
        (kinds("musique_types", "aucune musique signalée"), 5, "indices de musique déjà signalés"),
        (kinds("ambiance_types", "ambiance non qualifiée"), 3, "indices d’ambiance sonore déjà signalés"),
        (F.coalesce(F.col("duree"), F.lit(0.0)) >= 8, 1, "plan assez long pour une lecture sonore"),
    ]
    long = F.when(F.coalesce(F.col("duree"), F.lit(0.0)) >= 20, 1).otherwise(0)
    score, reasons = _sum([F.when(c, w).otherwise(0) for c, w, _ in rules] + [long]), _reasons([(c, F.lit(r)) for c, _, r in rules])
    past = F.lit(False) if done is None else F.coalesce(done, F.lit(False))
    past = past if number is None else past | (F.col("n") != number)
    return shots.withColumns(_gated(score, reasons, past, "analyse audio détaillée forcée sur tous les plans" if forced else None))


def ranked(scored: DataFrame, least: int, most: int = 0) -> DataFrame:
    """Shots that score enough, by (score descending, film, number); the first of them if most isn't 0."""
    rows = scored.where(F.col("score") >= least).orderBy(F.desc("score"), "film_id", "n")
    return rows.limit(most) if most else rows


def first_shots(shots: DataFrame, films: int, each: int) -> DataFrame:
    """The first shots of each of the first films."""
    chosen = shots.select("film_id").distinct().orderBy("film_id").limit(films)
    return shots.join(F.broadcast(chosen), "film_id", "left_semi").withColumn("_shot", F.row_number().over(Window.partitionBy("film_id").orderBy("n"))).where(F.col("_shot") <= each).drop("_shot")
