"""Registered queries on shots, progress, cutting, movement and dialogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.functions.numbers import clusters_in, decade, evenly, frame_times, human_duration, share, timecode, timecode_of_ms
from reelframe.operators import cutting, dialogue, movement, progress, scoring

from .adapters import query

# what the oracles share
_BLANK = "coalesce({0}, '') = ''"
_DOUBT = """CASE WHEN certitude = 'douteux' THEN 5 WHEN certitude = 'probable' THEN 3 WHEN coalesce(certitude, '') = '' THEN 2 ELSE 0 END
 + CASE WHEN machine AND coalesce(machine_types, '') = '' THEN 4 ELSE 0 END + CASE WHEN machine AND coalesce(interface, '') = '' THEN 2 ELSE 0 END
 + CASE WHEN coalesce(description, '') = '' THEN 2 ELSE 0 END + CASE WHEN coalesce(mots_cles, '') = '' THEN 2 ELSE 0 END
 + CASE WHEN coalesce(echelle, '') = '' THEN 2 ELSE 0 END + CASE WHEN coalesce(lieu, '') = '' THEN 2 ELSE 0 END"""
_REASONS = """concat_ws('|', CASE WHEN certitude = 'douteux' THEN 'certitude douteux' END, CASE WHEN certitude = 'probable' THEN 'certitude probable' END,
 CASE WHEN coalesce(certitude, '') = '' THEN 'certitude absente' END, CASE WHEN machine AND coalesce(machine_types, '') = '' THEN 'machine visible sans type d’appareil' END,
 CASE WHEN machine AND coalesce(interface, '') = '' THEN 'machine visible sans typologie d’affichage' END,
 CASE WHEN coalesce(description, '') = '' THEN 'description absente' END, CASE WHEN coalesce(mots_cles, '') = '' THEN 'mots-clés absents' END,
 CASE WHEN coalesce(echelle, '') = '' THEN 'échelle absente' END, CASE WHEN coalesce(lieu, '') = '' THEN 'lieu absent' END)"""
_C4 = "coalesce(echelle, '') <> '' AND coalesce(lieu, '') <> '' AND coalesce(description, '') <> '' AND coalesce(mots_cles, '') <> ''"
_C3 = "coalesce(echelle, '') <> '' AND coalesce(lieu, '') <> '' AND coalesce(description, '') <> ''"
_TC = "printf('%02d:%02d:%06.3f', CAST(floor({0} / 3600) AS BIGINT), CAST(floor({0} % 3600 / 60) AS BIGINT), {0} % 60)"


@query("shots", oracle=f"SELECT film_id, n, CAST({_DOUBT} AS BIGINT) AS score, {_REASONS} AS reasons FROM shots WHERE {_DOUBT} >= 3 ORDER BY score DESC, film_id, n LIMIT 20")
def reread_ranking(shots: DataFrame) -> DataFrame:
    return scoring.ranked(scoring.doubt(shots), 3, 20).select("film_id", "n", "score", F.array_join("reasons", "|").alias("reasons"))


@query("shots", oracle=f"SELECT film_id, n, CAST({_DOUBT} AS BIGINT) AS score, {_REASONS} AS reasons FROM shots")
def doubt_scores(shots: DataFrame) -> DataFrame:
    return scoring.doubt(shots).select("film_id", "n", "score", F.array_join("reasons", "|").alias("reasons"))


_HINTS = ["the", "des", "und", "que", "tion", "hologram"]


@query("shots", oracle=f"""SELECT film_id, n, CASE WHEN h = 0 THEN 0 ELSE least(6, h + 2) END + CASE WHEN generique THEN 8 ELSE 0 END AS score FROM (SELECT film_id, n, generique, CAST({" + ".join(f"CASE WHEN contains(t, '{h}') THEN 1 ELSE 0 END" for h in _HINTS)} AS BIGINT) AS h
FROM (SELECT film_id, n, generique, lower(regexp_replace(strip_accents(concat_ws(' ', description, mots_cles, interface)), '[^\x00-\x7F]', '', 'g')) AS t FROM shots) a) b""")
def typography_scores(shots: DataFrame) -> DataFrame:
    return scoring.typography(shots, _HINTS).select("film_id", "n", "score")


@query("shots", "segments", oracle="""SELECT s.film_id, s.n, CAST(CASE WHEN h.n IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN duree >= 8 THEN 1 ELSE 0 END + CASE WHEN duree >= 20 THEN 1 ELSE 0 END AS BIGINT) AS score
FROM shots s LEFT JOIN (SELECT DISTINCT s.film_id, s.n FROM shots s JOIN segments t ON s.film_id = t.film_id AND least(s.fin, t.fin) - greatest(s.debut, t.debut) > 0.05) h ON s.film_id = h.film_id AND s.n = h.n""")
def audio_scores(shots: DataFrame, segments: DataFrame) -> DataFrame:
    return scoring.sound(dialogue.with_dialogue(shots, segments)).select("film_id", "n", "score")


@query("shots", oracle=f"SELECT film_id, count(*) FILTER ({_C4}) AS done, count(*) AS total FROM shots GROUP BY film_id HAVING count(*) FILTER ({_C4}) < count(*)")
def unfinished_films(shots: DataFrame) -> DataFrame:
    return progress.unfinished(shots)


@query("films", "shots", oracle="SELECT film_id, titre FROM films WHERE film_id NOT IN (SELECT film_id FROM shots)")
def films_without_shots(films: DataFrame, shots: DataFrame) -> DataFrame:
    return progress.without(films, shots, "film_id").select("film_id", "titre")


@query("films", "shots", oracle="SELECT coalesce(f.film_id, s.film_id) AS film_id, coalesce(titre, '') AS titre, CASE WHEN annee IS NULL THEN '' ELSE concat(CAST(annee // 10 * 10 AS VARCHAR), 's') END AS decennie, coalesce(total, 0) AS total FROM films f FULL JOIN (SELECT film_id, count(*) AS total FROM shots GROUP BY film_id) s ON f.film_id = s.film_id")
def film_list(films: DataFrame, shots: DataFrame) -> DataFrame:
    """All films, those without shots with a count of zero."""
    counts = shots.groupBy("film_id").agg(F.count("*").alias("total"))
    return films.join(counts, "film_id", "full_outer").select("film_id", F.coalesce("titre", F.lit("")).alias("titre"), decade(F.col("annee")).alias("decennie"), F.coalesce("total", F.lit(0)).alias("total"))


@query("shots", "films", oracle=f"""SELECT s.film_id, n, coalesce(titre, '') AS titre, coalesce(echelle, '') AS echelle, coalesce(lieu, '') AS lieu, {_TC.format('s.debut')} AS tc, replace({_TC.format('s.debut')}, '.', ',') AS tc_ms,
 CASE WHEN s.fin >= 3600 THEN printf('%d h %02d min', CAST(floor(s.fin / 3600) AS BIGINT), CAST(floor(s.fin % 3600 / 60) AS BIGINT)) WHEN s.fin >= 60 THEN printf('%d min %02d s', CAST(floor(s.fin / 60) AS BIGINT), CAST(s.fin % 60 AS BIGINT)) ELSE printf('%d s', CAST(s.fin AS BIGINT)) END AS ends
 FROM shots s LEFT JOIN films f ON s.film_id = f.film_id""")
def shot_catalogue(shots: DataFrame, films: DataFrame) -> DataFrame:
    rows = shots.join(films.select("film_id", "titre"), "film_id", "left")
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("titre", "echelle", "lieu")]
    return rows.select("film_id", "n", *text, timecode(F.col("debut")).alias("tc"), timecode_of_ms(F.col("debut")).alias("tc_ms"), human_duration(F.col("fin")).alias("ends"))


@query("shots", oracle="SELECT film_id, n, score FROM (SELECT film_id, n, duree AS score, row_number() OVER (PARTITION BY film_id ORDER BY n) AS r, dense_rank() OVER (ORDER BY film_id) AS f FROM shots) x WHERE r <= 5 AND f <= 3")
def first_shots(shots: DataFrame) -> DataFrame:
    return scoring.first_shots(shots, 3, 5).select("film_id", "n", F.col("duree").alias("score"))


@query("shots", oracle="""SELECT film_id, n, w AS window_no, round(a, 3) AS a, round(least(a + 12, fin), 3) AS b FROM (SELECT film_id, n, fin, unnest(range(k)) AS w, unnest(list_transform(range(k), lambda i: CASE WHEN k = 1 THEN debut ELSE debut + (fin - 12 - debut) * i / (k - 1) END)) AS a
FROM (SELECT *, CASE WHEN duree <= 12 * 1.35 THEN 1 ELSE least(4, greatest(2, CAST(ceil(duree / 12) AS BIGINT))) END AS k FROM shots) x) y WHERE true""".replace("round(least(a + 12, fin), 3)", "round(CASE WHEN w = 0 AND fin - a <= 12 * 1.35 THEN fin ELSE least(a + 12, fin) END, 3)"))
def shot_windows(shots: DataFrame) -> DataFrame:
    rows = shots.select("film_id", "n", F.posexplode(clusters_in(F.col("debut"), F.col("fin"), 12.0, 4)).alias("window_no", "w"))
    return rows.select("film_id", "n", F.col("window_no").cast("long").alias("window_no"), F.bround("w.start", 3).alias("a"), F.bround("w.end", 3).alias("b"))


@query("shots", oracle="SELECT film_id, n, round(greatest(debut, least(debut + duree * 0.25, fin - 0.04)), 3) AS t1, round(greatest(debut, least(debut + duree * 0.5, fin - 0.04)), 3) AS t2, round(greatest(debut, least(debut + duree * 0.75, fin - 0.04)), 3) AS t3 FROM shots")
def frame_sample_times(shots: DataFrame) -> DataFrame:
    t = frame_times(F.col("debut"), F.col("fin"))
    return shots.select("film_id", "n", *(t[i].alias(f"t{i + 1}") for i in range(3)))


@query("shots", oracle="""SELECT film_id, n FROM (SELECT film_id, n, count(*) OVER (PARTITION BY film_id) AS c FROM shots) x
WHERE c <= 5 OR n - 1 IN (0, CAST(round_even((c - 1) / 4.0, 0) AS BIGINT), CAST(round_even(2 * (c - 1) / 4.0, 0) AS BIGINT), CAST(round_even(3 * (c - 1) / 4.0, 0) AS BIGINT), c - 1)""")
def spread_shots(shots: DataFrame) -> DataFrame:
    """Five shots of each film, evenly spread."""
    chosen = shots.groupBy("film_id").agg(F.count("*").alias("c")).select("film_id", F.explode(evenly(F.col("c"), 5)).alias("p"))
    return shots.join(chosen.select("film_id", (F.col("p") + 1).cast("long").alias("n")), ["film_id", "n"]).select("film_id", "n")


@query("shots", oracle="""SELECT film_id, metric, value, n, CAST(row_number() OVER (PARTITION BY film_id, metric ORDER BY n DESC, value) AS BIGINT) AS rank FROM (SELECT film_id, 'echelle' AS metric, echelle AS value, count(*) AS n FROM shots GROUP BY ALL) x QUALIFY rank <= 2""")
def frequent_scales(shots: DataFrame) -> DataFrame:
    return progress.top(shots.withColumn("metric", F.lit("echelle")).withColumnRenamed("echelle", "value"), ["film_id", "metric"], "value", 2).select("film_id", "metric", "value", "n", "rank")


# dialogue

_JOIN = "shots s JOIN segments t ON s.film_id = t.film_id AND least(s.fin, t.fin) - greatest(s.debut, t.debut) > 0.05"


@query("shots", "segments", oracle=f"SELECT s.film_id, s.n, t.debut, t.texte, round(least(s.fin, t.fin) - greatest(s.debut, t.debut), 3) AS common FROM {_JOIN}")
def dialogue_join(shots: DataFrame, segments: DataFrame) -> DataFrame:
    return dialogue.attached(shots, segments).select("film_id", "n", "debut", "texte", F.bround("common", 3).alias("common"))


@query("shots", "segments", oracle=f"SELECT s.film_id, s.n, coalesce(k, 0) AS n_segments, coalesce(x, '') AS dialogue_texte FROM shots s LEFT JOIN (SELECT s.film_id, s.n, count(*) AS k, string_agg(t.texte, ' ' ORDER BY t.debut, t.fin, t.texte) AS x FROM {_JOIN} GROUP BY s.film_id, s.n) h ON s.film_id = h.film_id AND s.n = h.n")
def shot_dialogue(shots: DataFrame, segments: DataFrame) -> DataFrame:
    return dialogue.with_dialogue(shots, segments).select("film_id", "n", "n_segments", "dialogue_texte")


@query("shots", "segments", oracle=f"""SELECT film_id, CASE WHEN length(x) > 900 THEN concat(rtrim(substr(x, 1, 900)), '…') ELSE x END AS text FROM (SELECT film_id, string_agg(concat('plan ', CAST(n AS VARCHAR), ' : ', texte), ' | ' ORDER BY n, texte) AS x
FROM (SELECT *, row_number() OVER (PARTITION BY film_id, substr(texte, 1, 160) ORDER BY n) AS r FROM (SELECT s.film_id, s.n, string_agg(t.texte, ' ' ORDER BY t.debut, t.fin, t.texte) AS texte FROM {_JOIN} GROUP BY s.film_id, s.n) d) e WHERE r = 1 GROUP BY film_id) y""")
def dialogue_digest(shots: DataFrame, segments: DataFrame) -> DataFrame:
    lines = dialogue.with_dialogue(shots, segments).select("film_id", "n", F.col("dialogue_texte").alias("texte"))
    return dialogue.digest(lines, ["film_id"])


# cutting

_CLIPS = "clips AS (SELECT film_id, 0.0 AS debut, max(t) + 2 AS fin FROM frames GROUP BY film_id)"
_ONE = "SELECT film_id, t AS debut, lead(t) OVER (PARTITION BY film_id ORDER BY t) AS fin FROM (SELECT film_id, unnest([debut, round(fin, 3)]) AS t FROM clips UNION SELECT f.film_id, round(t, 3) FROM frames f JOIN clips c ON f.film_id = c.film_id WHERE score > 0.3 AND t > debut + 0.05 AND t < fin - 0.05) p"


def _clips(frames: DataFrame) -> DataFrame:
    return frames.groupBy("film_id").agg(F.lit(0.0).alias("debut"), (F.max("t") + 2).alias("fin"))


@query("frames", oracle=f"WITH {_CLIPS} SELECT * FROM ({_ONE}) x WHERE fin - debut >= 0.04")
def shot_cuts(frames: DataFrame) -> DataFrame:
    return cutting.detect(frames, _clips(frames), 3.0).select("film_id", "debut", "fin")


@query("frames", oracle=f"""WITH {_CLIPS}, one AS ({_ONE}), long AS (SELECT film_id, debut AS a, fin AS b FROM one WHERE fin - debut > 30),
two AS (SELECT film_id, a, b, t AS debut, lead(t) OVER (PARTITION BY film_id, a, b ORDER BY t) AS fin FROM (SELECT film_id, a, b, unnest([a, b]) AS t FROM long UNION SELECT l.film_id, a, b, round(t, 3) FROM frames f JOIN long l ON f.film_id = l.film_id WHERE score > 0.18 AND t > a + 0.05 AND t < b - 0.05) p)
SELECT film_id, debut, fin, false AS refined FROM one WHERE fin - debut >= 0.04 AND fin - debut <= 30 UNION ALL SELECT film_id, debut, fin, debut > a OR fin < b FROM two WHERE fin - debut >= 0.04""")
def two_pass_cuts(frames: DataFrame) -> DataFrame:
    return cutting.detect_twice(frames, _clips(frames)).select("film_id", "debut", "fin", "refined")


@query("frames", oracle=f"WITH {_CLIPS} SELECT film_id, debut, round(fin - debut, 3) AS duree, row_number() OVER (PARTITION BY film_id ORDER BY debut, fin) AS n FROM ({_ONE}) x WHERE fin - debut >= 0.04")
def shot_numbers(frames: DataFrame) -> DataFrame:
    return cutting.numbered(cutting.detect(frames, _clips(frames))).select("film_id", "debut", "duree", "n")


# movement

_MED = ", ".join(f"coalesce(quantile_cont({m}, 0.5), 0) AS {m}" for m in movement.MEASURES)
_CLASS = """CASE WHEN pairs < 2 THEN 'indéterminé' WHEN jitter > 0.012 AND amp > 0.006 THEN 'caméra portée' WHEN abs(scale_delta) > 0.010 AND abs(scale_delta) > amp * 0.8 THEN CASE WHEN scale_delta > 0 THEN 'zoom in' ELSE 'zoom out' END
 WHEN abs(rotation) > 0.55 AND abs(rotation) > amp * 20 THEN CASE WHEN rotation > 0 THEN 'rotation horaire' ELSE 'rotation antihoraire' END WHEN amp < 0.004 AND abs(scale_delta) < 0.006 AND abs(rotation) < 0.35 THEN 'fixe'
 WHEN abs(dx) > abs(dy) * 1.45 THEN CASE WHEN dx < 0 THEN 'panoramique droite' ELSE 'panoramique gauche' END WHEN abs(dy) > abs(dx) * 1.45 THEN CASE WHEN dy < 0 THEN 'tilt bas' ELSE 'tilt haut' END ELSE 'mouvement complexe' END"""
_SURE = "CASE WHEN pairs < 2 THEN 'douteux' WHEN inliers > 0.55 AND pairs >= 4 THEN 'sûr' WHEN inliers > 0.35 THEN 'probable' ELSE 'douteux' END"
_FORCE = "greatest(abs(scale_delta) * 18, abs(rotation) / 2.5, amp * 7, jitter * 12)"
_LEVEL = f"CASE WHEN pairs < 2 OR camera = 'fixe' THEN 'faible' WHEN {_FORCE} < 0.08 THEN 'faible' WHEN {_FORCE} < 0.22 THEN 'moyenne' ELSE 'forte' END"


def _measured(keys: str, source: str = "pairs") -> str:
    return f"SELECT *, {_CLASS} AS camera, {_SURE} AS confidence FROM (SELECT *, sqrt(dx * dx + dy * dy) AS amp FROM (SELECT {keys}, count(*) AS pairs, {_MED} FROM {source} GROUP BY {keys}) m) a"


@query("pairs", oracle=f"SELECT shot_id, pairs, {', '.join(f'round(CAST({m} AS DECIMAL(18, 9)), {d})::DOUBLE + 0.0 AS {m}' for m, d in movement.MEASURES.items())} FROM ({_measured('shot_id')}) x")
def movement_medians(pairs: DataFrame) -> DataFrame:
    return movement.medians(pairs, "shot_id").select("shot_id", "pairs", *((F.round(F.col(m).cast("decimal(18,9)"), d).cast("double") + 0.0).alias(m) for m, d in movement.MEASURES.items()))


@query("pairs", oracle=f"SELECT shot_id, camera, {_LEVEL} AS intensity, confidence FROM ({_measured('shot_id')}) x")
def movement_classes(pairs: DataFrame) -> DataFrame:
    return movement.classified(movement.medians(pairs, "shot_id")).select("shot_id", "camera", "intensity", "confidence")


_PARTED = "(SELECT *, pair % 2 AS segment FROM pairs)"
_FUSED = f"""SELECT w.shot_id, CASE WHEN coalesce(k, 0) > 1 THEN 'mouvement complexe' ELSE camera END AS camera, CASE WHEN coalesce(k, 0) > 1 THEN CASE WHEN pairs >= 3 THEN 'probable' ELSE 'douteux' END ELSE confidence END AS confidence FROM ({_measured('shot_id')}) w
LEFT JOIN (SELECT shot_id, count(DISTINCT camera) FILTER (camera <> 'fixe') AS k FROM ({_measured('shot_id, segment', _PARTED)}) y WHERE camera <> 'indéterminé' GROUP BY shot_id) p ON w.shot_id = p.shot_id"""


@query("pairs", oracle=_FUSED)
def movement_fusion(pairs: DataFrame) -> DataFrame:
    return movement.fused(pairs.withColumn("segment", F.col("pair") % 2)).select("shot_id", "camera", "confidence")


_NAME = "CASE label WHEN 'pan_left' THEN 'panoramique gauche' WHEN 'static' THEN 'fixe' WHEN 'shake' THEN 'caméra portée' WHEN 'zoom_in' THEN 'zoom in' ELSE 'indéterminé' END"
_KEPT = f"SELECT * FROM (SELECT shot_id, segment, label, score, row_number() OVER (PARTITION BY shot_id, segment ORDER BY score DESC, label) AS rank FROM (SELECT shot_id, segment, {_NAME} AS label, max(round_even(score, 4)) AS score FROM vlabels GROUP BY ALL) a) b WHERE (score >= 0.35 OR rank = 1) AND rank <= 6"
_VIDEO = f"""SELECT shot_id, CASE WHEN count(DISTINCT camera) FILTER (useful) > 1 THEN 'mouvement complexe' ELSE coalesce(min_by(camera, segment) FILTER (useful), min_by(camera, segment)) END AS video,
CASE WHEN max(score) >= 0.7 THEN 'sûr' WHEN max(score) >= 0.45 THEN 'probable' ELSE 'douteux' END AS video_confidence FROM (SELECT *, camera NOT IN ('indéterminé', 'fixe') AS useful FROM (SELECT shot_id, segment, max(score) AS score,
CASE WHEN count(DISTINCT label) FILTER (label NOT IN ('fixe', 'indéterminé')) > 1 THEN 'mouvement complexe' ELSE min_by(label, CASE label WHEN 'caméra portée' THEN 1 WHEN 'panoramique gauche' THEN 14 WHEN 'zoom in' THEN 20 WHEN 'fixe' THEN 26 ELSE 27 END) END AS camera FROM ({_KEPT}) k GROUP BY shot_id, segment) s) u GROUP BY shot_id"""


@query("vlabels", oracle=f"SELECT shot_id, segment, label, score FROM ({_KEPT}) x")
def video_labels(vlabels: DataFrame) -> DataFrame:
    return movement.kept_labels(vlabels).select("shot_id", "segment", "label", "score")


@query("vlabels", oracle=_VIDEO)
def video_movements(vlabels: DataFrame) -> DataFrame:
    return movement.video_movement(movement.kept_labels(vlabels)).select("shot_id", "video", "video_confidence")


_FINAL = f"""SELECT coalesce(f.shot_id, g.shot_id) AS shot_id, coalesce(camera, '') AS m, coalesce(video, '') AS v, coalesce(video_confidence, 'douteux') AS c FROM ({_FUSED}) f FULL JOIN ({_VIDEO}) g ON f.shot_id = g.shot_id"""
_DECIDED = f"""SELECT shot_id, CASE WHEN v IN ('', 'indéterminé') THEN CASE WHEN m = '' THEN 'indéterminé' ELSE m END WHEN m IN ('', 'indéterminé') OR (m = v AND v <> 'mouvement complexe') THEN v WHEN c IN ('sûr', 'probable') THEN v ELSE m END AS final,
NOT (v IN ('', 'indéterminé') OR m IN ('', 'indéterminé') OR (m = v AND v <> 'mouvement complexe')) AS conflict FROM ({_FINAL}) x"""


@query("pairs", "vlabels", oracle=_DECIDED)
def movement_decision(pairs: DataFrame, vlabels: DataFrame) -> DataFrame:
    measured = movement.fused(pairs.withColumn("segment", F.col("pair") % 2))
    return movement.decided(measured, movement.video_movement(movement.kept_labels(vlabels))).select("shot_id", "final", "conflict")


@query("pairs", "vlabels", oracle=f"""SELECT metric, value, count(*) AS n, CAST(row_number() OVER (PARTITION BY metric ORDER BY count(*) DESC, value) AS BIGINT) AS rank FROM (SELECT 'final' AS metric, final AS value FROM ({_DECIDED}) a UNION ALL SELECT 'camera', coalesce(nullif(m, ''), 'non renseigné') FROM ({_FINAL}) b UNION ALL SELECT 'video', coalesce(nullif(v, ''), 'non renseigné') FROM ({_FINAL}) c) x GROUP BY metric, value QUALIFY rank <= 15""")
def movement_comparison(pairs: DataFrame, vlabels: DataFrame) -> DataFrame:
    measured = movement.fused(pairs.withColumn("segment", F.col("pair") % 2))
    video = movement.video_movement(movement.kept_labels(vlabels))
    rows = movement.decided(measured, video).join(measured.select("shot_id", "camera"), "shot_id", "left").join(video.select("shot_id", "video"), "shot_id", "left")
    return movement.compared(rows, ["final", "camera", "video"])
