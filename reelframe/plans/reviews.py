"""Registered queries on how far films have come: progress, states, layers, movements, and which shots come next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.operators import movement, progress, scoring

from .adapters import query

_SET = "trim(coalesce({0}, '')) <> ''"
_C3 = "coalesce(echelle, '') <> '' AND coalesce(lieu, '') <> '' AND coalesce(description, '') <> ''"
_C4 = f"{_C3} AND coalesce(mots_cles, '') <> ''"
_PREPARED = "vignette <> '' AND len(string_split(vignettes, '|')) >= 3 AND len(list_filter(string_split(vignettes, '|')[1:3], lambda v: trim(v) <> '')) = 3"
_TRIED = f"({_C4}) OR {_SET.format('modele')} OR {_SET.format('modele_analyse')} OR {_SET.format('analyse_mesuree_le')} OR temps_analyse_secondes IS NOT NULL"
_DONE = "complete >= total OR prepared >= total AND attempted >= total AND complete / total >= 0.995"


def _counts(complete: str) -> str:
    return f"SELECT film_id, count(*) AS total, count(*) FILTER ({_PREPARED}) AS prepared, count(*) FILTER ({_TRIED}) AS attempted, count(*) FILTER ({complete}) AS complete FROM states GROUP BY film_id"


def _states(states: DataFrame) -> DataFrame:
    return states.withColumn("vignettes", F.split("vignettes", r"\|"))


@query("states", oracle=f"SELECT *, {_DONE} AS finished, CAST(round_even(100.0 * prepared / total, 0) AS BIGINT) AS percent_prepared, CAST(round_even(100.0 * complete / total, 0) AS BIGINT) AS percent FROM ({_counts(_C3)}) x")
def film_progress(states: DataFrame) -> DataFrame:
    return progress.film_progress(_states(states))


@query("cards", "states", oracle=f"SELECT c.film_id, CASE WHEN illisible THEN 'illisible' WHEN x.film_id IS NULL THEN 'absent' WHEN {_DONE} THEN 'complet' ELSE 'incomplet' END AS state FROM cards c LEFT JOIN ({_counts(_C4)}) x ON c.film_id = x.film_id")
def film_states(cards: DataFrame, states: DataFrame) -> DataFrame:
    return progress.film_states(cards, _states(states), cards.where("illisible"))


@query("cards", "states", oracle=f"""SELECT * FROM (SELECT count(*) AS films, count(*) FILTER (({_SET.format("pitch")} OR {_SET.format("synopsis")}) AND {_SET.format("scenario")}) AS contextes_films, CAST(sum(scenes) AS BIGINT) AS scenes, CAST(sum(personnages_recurrents) AS BIGINT) AS personnages_recurrents FROM cards) a,
(SELECT count(*) AS plans, count(*) FILTER (machine) AS machines, count(*) FILTER (dialogue) AS dialogues, count(affinage) AS affinages, count(*) FILTER ({_SET.format("mouvement_camera")}) AS mouvements_camera, count(*) FILTER ({_SET.format("mouvement_video_modele")}) AS mouvements_camera_video,
 count(*) FILTER ({_SET.format("mouvement_camera_final")}) AS mouvements_camera_final, count(*) FILTER (mouvement_camera_conflit) AS mouvements_camera_conflits FROM states) b""")
def corpus_totals(cards: DataFrame, states: DataFrame) -> DataFrame:
    return progress.totals(cards, states)


@query("states", "cards", oracle="""SELECT f.film_id, coalesce(b.m, nullif(trim(c.modele), ''), 'none') AS modele FROM (SELECT DISTINCT film_id FROM states) f LEFT JOIN
(SELECT film_id, m FROM (SELECT film_id, coalesce(nullif(trim(modele), ''), trim(modele_analyse)) AS m FROM states) x WHERE m <> '' GROUP BY film_id, m QUALIFY row_number() OVER (PARTITION BY film_id ORDER BY count(*) DESC, m) = 1) b ON f.film_id = b.film_id LEFT JOIN cards c ON f.film_id = c.film_id""")
def dominant_models(states: DataFrame, cards: DataFrame) -> DataFrame:
    return progress.dominant_model(states, cards, "none")


@query("states", "cards", oracle=f"""SELECT s.film_id, dialogues_plans, coalesce(nullif(c.dialogue_source, ''), array_to_string(sources[1:2], ' · '), '') AS dialogues_source, musique_plans, CAST(coalesce(sequences, 0) AS BIGINT) AS musique_sequences, affinages_plans
FROM (SELECT film_id, count(*) FILTER (dialogue OR {_SET.format("dialogue_texte")}) AS dialogues_plans, list_sort(list(DISTINCT trim(dialogue_source)) FILTER ({_SET.format("dialogue_source")})) AS sources, count(*) FILTER (musique_presente OR audio_detaille IS NOT NULL OR audio_global_ref <> '') AS musique_plans, count(affinage) AS affinages_plans FROM states GROUP BY film_id) s LEFT JOIN cards c ON s.film_id = c.film_id""")
def layer_coverage(states: DataFrame, cards: DataFrame) -> DataFrame:
    return progress.layer_coverage(states, cards)


_TOP = "SELECT film_id, string_agg(concat(v, ':', k, ':', CAST(round_even(100.0 * k / total, 0) AS BIGINT)), '|' ORDER BY k DESC, v) AS {1} FROM (SELECT film_id, v, total, count(*) AS k FROM (SELECT film_id, trim({0}) AS v, count(*) OVER (PARTITION BY film_id) AS total FROM states) x WHERE v <> '' GROUP BY film_id, v, total QUALIFY row_number() OVER (PARTITION BY film_id ORDER BY count(*) DESC, v) <= 5) y GROUP BY film_id"


@query("states", oracle=f"""SELECT s.film_id, measured AS mouvements_camera_plans_mesures, CAST(round_even(100.0 * measured / total, 0) AS BIGINT) AS mouvements_camera_pourcentage, coalesce(f, '') AS mouvements_camera_principaux, coalesce(t, '') AS mouvements_camera_confiances, conflicts AS mouvements_camera_conflits,
classed AS mouvements_video_plans_classes, CAST(round_even(100.0 * classed / total, 0) AS BIGINT) AS mouvements_video_pourcentage, coalesce(v, '') AS mouvements_video_principaux, coalesce(models, '') AS mouvements_video_modeles
FROM (SELECT film_id, count(*) AS total, count(*) FILTER (coalesce(mouvement_camera, '') <> '' OR coalesce(mouvement_camera_final, '') <> '') AS measured, count(*) FILTER (mouvement_camera_conflit) AS conflicts, count(*) FILTER (mouvement_video_camera <> '') AS classed, string_agg(DISTINCT trim(mouvement_video_modele), '|' ORDER BY trim(mouvement_video_modele)) FILTER ({_SET.format("mouvement_video_modele")}) AS models FROM states GROUP BY film_id) s
LEFT JOIN ({_TOP.format("coalesce(nullif(mouvement_camera_final, ''), mouvement_camera)", "f")}) f ON s.film_id = f.film_id LEFT JOIN ({_TOP.format("mouvement_video_camera", "v")}) v ON s.film_id = v.film_id
LEFT JOIN (SELECT film_id, string_agg(concat(c, ':', k), '|' ORDER BY c) AS t FROM (SELECT film_id, trim(mouvement_confiance) AS c, count(*) AS k FROM states WHERE {_SET.format("mouvement_confiance")} GROUP BY ALL) x GROUP BY film_id) t ON s.film_id = t.film_id""")
def movement_summary(states: DataFrame) -> DataFrame:
    """The summary with its lists and its map as texts."""
    rows = progress.movement_summary(states)
    top = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["label"], x["plans"], x["pourcentage"])), "|")
    trust = F.array_join(F.transform(F.map_entries("mouvements_camera_confiances"), lambda x: F.concat_ws(":", x["key"], x["value"])), "|")
    return rows.withColumns({"mouvements_camera_principaux": top("mouvements_camera_principaux"), "mouvements_video_principaux": top("mouvements_video_principaux"), "mouvements_camera_confiances": trust, "mouvements_video_modeles": F.array_join("mouvements_video_modeles", "|")})


@query("states", oracle="SELECT film_id, n, CAST(duree AS VARCHAR) AS tc, coalesce(nullif(mouvement_camera, ''), 'n/a') AS mouvement_camera, coalesce(nullif(mouvement_video_camera, ''), 'n/a') AS mouvement_video_camera, coalesce(nullif(mouvement_camera_final, ''), 'n/a') AS mouvement_camera_final FROM states WHERE mouvement_camera_conflit")
def movement_conflicts(states: DataFrame) -> DataFrame:
    return movement.conflicts(states.withColumn("tc", F.col("duree").cast("string")))


@query("states", oracle="SELECT count(*) FILTER (mouvement_camera_conflit) AS conflicts, count(*) FILTER (coalesce(mouvement_camera, '') <> '' AND coalesce(mouvement_video_camera, '') = '') AS without_video FROM states")
def movement_without_video(states: DataFrame) -> DataFrame:
    return movement.unclassed(states)


_VALUES = " UNION ALL ".join(f"SELECT '{c}' AS metric, coalesce(nullif({c}, ''), 'non renseigné') AS value FROM states" for c in ("mouvement_camera", "mouvement_video_camera", "mouvement_camera_final"))


@query("states", oracle=f"SELECT metric, value, count(*) AS n, CAST(row_number() OVER (PARTITION BY metric ORDER BY count(*) DESC, value) AS BIGINT) AS rank FROM ({_VALUES}) x GROUP BY metric, value QUALIFY rank <= 4")
def movement_frequencies(states: DataFrame) -> DataFrame:
    return movement.compared(states, ["mouvement_camera", "mouvement_video_camera", "mouvement_camera_final"], 4)


# which shots come next, for shots in all states

_READ = "coalesce(description, '') <> '' OR coalesce(echelle, '') <> ''"
_HEARD = "CASE WHEN dialogue OR trim(coalesce(dialogue_texte, '')) <> '' THEN 4 ELSE 0 END + CASE WHEN duree >= 8 THEN 1 ELSE 0 END + CASE WHEN duree >= 20 THEN 1 ELSE 0 END"


@query("states", oracle=f"""SELECT film_id, n, CAST(CASE WHEN affinage IS NOT NULL AND NOT affinage_erreur OR NOT ({_READ}) THEN 0 ELSE 2 + CASE WHEN machine THEN 6 ELSE 0 END + CASE WHEN coalesce(description, '') = '' THEN 2 ELSE 0 END + CASE WHEN coalesce(mots_cles, '') = '' THEN 2 ELSE 0 END
 + CASE WHEN coalesce(echelle, '') = '' THEN 2 ELSE 0 END END AS BIGINT) AS score FROM states""")
def gated_doubt(states: DataFrame) -> DataFrame:
    """Doubt of shots that a model has read and that no pass has refined without error."""
    rows = states.withColumns({"certitude": F.lit(None).cast("string"), "lieu": F.lit("rue")})
    read = (F.coalesce("description", F.lit("")) != "") | (F.coalesce("echelle", F.lit("")) != "")
    return scoring.doubt(rows, F.col("affinage").isNotNull() & ~F.col("affinage_erreur"), read).select("film_id", "n", "score")


@query("states", oracle=f"SELECT film_id, n, pass, CAST(CASE WHEN done OR pass = 'number' AND n % 100 <> 9 THEN 0 WHEN pass = 'forced' THEN 1 ELSE {_HEARD} END AS BIGINT) AS score FROM (SELECT *, audio_detaille IS NOT NULL AND NOT audio_erreur AS done FROM states) s, (VALUES ('open'), ('forced'), ('number')) p(pass)")
def gated_audio(states: DataFrame) -> DataFrame:
    """Audio scores of the open pass, the forced one, and one for a single shot number."""
    done = F.col("audio_detaille").isNotNull() & ~F.col("audio_erreur")
    rows = states.withColumn("true_n", F.col("n"))
    passes = {"open": scoring.sound(rows, done), "forced": scoring.sound(rows, done, forced=True), "number": scoring.sound(rows.withColumn("n", F.col("n") % 100), done, number=9)}
    made = [df.select("film_id", F.col("true_n").alias("n"), F.lit(name).alias("pass"), "score") for name, df in passes.items()]
    return made[0].unionByName(made[1]).unionByName(made[2])


_PAST = f"affinage IS NOT NULL AND NOT affinage_erreur OR NOT ({_READ})"


@query("states", oracle=f"""SELECT film_id, n, CAST(CASE WHEN {_PAST} THEN 0 ELSE CASE WHEN machine THEN 8 ELSE 0 END + CASE WHEN dialogue THEN 5 ELSE 0 END + CASE WHEN description = 'told' THEN 3 ELSE 0 END END AS BIGINT) AS score,
 CASE WHEN {_PAST} THEN '' ELSE concat_ws('|', CASE WHEN machine THEN 'texte visible déjà détecté' END, CASE WHEN dialogue THEN 'interface typographique déjà signalée' END, CASE WHEN description = 'told' THEN 'indices textuels : told' END) END AS reasons,
 CAST(CASE WHEN {_PAST} THEN 0 ELSE 1 END AS BIGINT) AS forced FROM states""")
def gated_typography(states: DataFrame) -> DataFrame:
    """Typography scores, and what they are where the whole corpus is forced."""
    read = (F.coalesce("description", F.lit("")) != "") | (F.coalesce("echelle", F.lit("")) != "")
    rows = states.withColumns({"texte_visible": F.col("machine"), "interface": F.when(F.col("dialogue"), "typographie surdimensionnée").otherwise(""), "read": read})
    done = F.col("affinage").isNotNull() & ~F.col("affinage_erreur")
    forced = scoring.typography(rows, ["told"], done, True, F.col("read")).withColumnRenamed("score", "forced")
    return scoring.typography(forced, ["told"], done, analysed=F.col("read")).select("film_id", "n", "score", F.array_join("reasons", "|").alias("reasons"), "forced")
