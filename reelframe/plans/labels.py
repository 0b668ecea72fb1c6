"""Registered queries on small rules, subtitles, selections and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.functions.text import url_of_poster
from reelframe.operators import labels, photos as photo_ops, publish, records, sequences
from reelframe.sources import documents as sources

from .adapters import query

_BIO = " OR ".join(f"contains(t, '{b}')" for b in labels.BIOGRAPHIC)


@query("films", oracle=f"SELECT film_id, t = '' OR {_BIO} AS suspect FROM (SELECT film_id, lower(trim(coalesce(nullif(pitch, ''), nullif(pays, ''), ''))) AS t FROM films) x")
def suspect_pitches(films: DataFrame) -> DataFrame:
    return films.select("film_id", labels.suspect_pitch(F.col("pitch"), F.col("pays")).alias("suspect"))


@query("films", oracle="SELECT film_id, trim(coalesce(nullif(pitch, ''), nullif(pays, ''), '')) <> '' AND trim(coalesce(titre, '')) <> '' AS enough FROM films")
def sufficient_contexts(films: DataFrame) -> DataFrame:
    return films.select("film_id", labels.context_sufficient(F.col("pitch"), F.col("pays"), F.col("titre")).alias("enough"))


@query("photos", oracle="SELECT photo_id, regexp_matches(lower(strip_accents(concat(titre, ' ', lieu, CASE WHEN photo_id % 9 = 0 THEN ' x264 BluRay' ELSE '' END))), '" + "|".join(labels.TECHNICAL) + "') AS technical FROM photos")
def technical_names(photos: DataFrame) -> DataFrame:
    name = F.concat("titre", F.lit(" "), "lieu", F.when(F.col("photo_id") % 9 == 0, " x264 BluRay").otherwise(""))
    return photos.select("photo_id", labels.technical_name(name).alias("technical"))


@query("events", oracle="SELECT event_type, count(*) AS n, count(*) FILTER (value <= 20 OR value / 2 <= 5) AS silent FROM events GROUP BY event_type")
def silent_events(events: DataFrame) -> DataFrame:
    quiet = labels.silent(F.col("value") - 72, F.col("value") / 2 - 39)
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(quiet).alias("silent"))


@query("conversations", oracle="SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'aucune source' WHEN turn % 4 = 1 THEN 'sous-titres intégrés' WHEN turn % 4 = 2 THEN 'transcription whisper locale' ELSE role END AS source FROM conversations")
def audio_sources(conversations: DataFrame) -> DataFrame:
    given = F.when(F.col("turn") % 4 == 0, " ").when(F.col("turn") % 4 == 1, "Sous-Titres fr").when(F.col("turn") % 4 == 2, "Whisper large").otherwise(F.concat(F.lit(" "), "role"))
    return conversations.select("conv_id", "turn", labels.audio_source(given).alias("source"))


_LAYER = "concat(text, CASE WHEN turn % 3 = 0 THEN ' [music] - Yes? - No!!' WHEN turn % 3 = 1 THEN ' [door]' ELSE '' END)"


@query("conversations", oracle=f"""SELECT conv_id, turn, coalesce(nullif(concat_ws('|', CASE WHEN turn % 3 = 0 THEN 'conversation' END, CASE WHEN w >= 18 THEN 'monologue' END, CASE WHEN contains(t, '?') THEN 'questions / réponses' END, CASE WHEN w <= 8 THEN 'réplique brève' END,
CASE WHEN len(t) - len(replace(t, '!', '')) >= 2 THEN 'dialogue expressif' END, CASE WHEN {' OR '.join(f"contains(f, '{w}')" for w in labels.ANNOUNCED)} THEN 'annonce / message' END), ''), 'dialogue continu') AS kinds, CASE WHEN turn % 3 = 0 THEN 'musique signalée' ELSE 'aucune musique signalée' END AS music, CASE WHEN turn % 3 = 1 THEN 'effets / ambiance' WHEN turn % 3 = 2 THEN 'ambiance non qualifiée' ELSE '' END AS sounds
FROM (SELECT *, len(regexp_extract_all(f, '[a-z0-9_'']+')) AS w FROM (SELECT *, regexp_replace(lower(strip_accents(t)), '[^\\x00-\\x7F]', '', 'g') AS f FROM (SELECT conv_id, turn, {_LAYER} AS t FROM conversations) a) b) c""")
def sound_layers(conversations: DataFrame) -> DataFrame:
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 0, " [music] - Yes? - No!!").when(F.col("turn") % 3 == 1, " [door]").otherwise(""))
    rows = conversations.select("conv_id", "turn", text.alias("dialogue_texte"), F.lit(True).alias("dialogue"), F.lit(1).alias("n_segments"))
    rows = labels.sound_layers(rows)
    return rows.select("conv_id", "turn", *(F.array_join(c, "|").alias(n) for c, n in (("dialogue_types", "kinds"), ("musique_types", "music"), ("ambiance_types", "sounds"))))


@query("pairs", oracle="SELECT shot_id, pair, pair > 3 AND (jitter < 0.005 OR inliers < 0.4 OR rotation > 0.5) AS candidate FROM pairs")
def video_candidates(pairs: DataFrame) -> DataFrame:
    model = F.when(F.col("pair") <= 3, "m")
    camera = F.when(F.col("jitter") < 0.005, "indéterminé").otherwise("fixe")
    sure = F.when(F.col("inliers") < 0.4, "douteux").otherwise("sûr")
    return pairs.select("shot_id", "pair", labels.video_candidate(model, camera, sure, F.col("rotation") > 0.5, True).alias("candidate"))


@query("shots", oracle="SELECT film_id, n, CASE WHEN trim(coalesce(description, '')) = '' THEN '' ELSE concat(rtrim(trim(description)), ' (analyse : ', modele, ')') END AS description FROM shots")
def attributed_descriptions(shots: DataFrame) -> DataFrame:
    once = labels.attributed(F.col("description"), F.lit("older"))
    return shots.select("film_id", "n", labels.attributed(once, F.col("modele")).alias("description"))


@query("photos", oracle="SELECT photo_id, CASE WHEN photo_id % 3 = 2 THEN NULL ELSE concat('{\"id\": ', CAST(photo_id AS VARCHAR), '}') END AS answer FROM photos")
def json_answers(photos: DataFrame) -> DataFrame:
    body = F.concat(F.lit('{"id": '), F.col("photo_id").cast("string"), F.lit("}"))
    given = F.when(F.col("photo_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("photo_id") % 3 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" ok"))).otherwise("nothing {")
    return photos.select("photo_id", labels.json_object(given).alias("answer"))


@query("shots", oracle="SELECT film_id, n, CASE WHEN n % 3 = 0 THEN 'refait' ELSE coalesce(echelle, '') END AS echelle, coalesce(echelle, '-') AS was FROM shots")
def refined_shots(shots: DataFrame) -> DataFrame:
    rows = shots.select(F.concat_ws("#", "film_id", "n").alias("id"), "film_id", "n", "echelle")
    new = rows.where("n % 3 = 0").select("id", F.lit("refait").alias("echelle"))
    out = labels.overlaid(rows.select("id", "echelle"), new, "id", ["echelle"])
    return out.join(rows.select("id", "film_id", "n"), "id").select("film_id", "n", "echelle", F.coalesce("original.echelle", F.lit("-")).alias("was"))


@query("orders", oracle="SELECT o_custkey AS film_id, arg_min(o_orderkey, (CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 2 END) * 1000000000 + o_orderkey) AS stream FROM orders GROUP BY o_custkey")
def preferred_streams(orders: DataFrame) -> DataFrame:
    language = F.when(F.col("o_orderpriority").startswith("1"), "FRE").when(F.col("o_orderpriority").startswith("2"), "eng").otherwise("de")
    return labels.preferred_stream(orders.select(F.col("o_custkey").alias("film_id"), F.col("o_orderkey").alias("stream"), language.alias("language")))


@query("lineitem", oracle="SELECT l_orderkey AS sequence_id, CAST(l_partkey AS VARCHAR) AS title, CASE WHEN l_quantity >= 45 THEN 'élevée' WHEN l_quantity >= 35 THEN 'moyenne' ELSE 'faible' END AS confidence, l_quantity < 47.5 AS a_verifier FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS r FROM lineitem) x WHERE r = 1 AND l_suppkey % 4 <> 0")
def identified_music(lineitem: DataFrame) -> DataFrame:
    rank = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = lineitem.select(F.col("l_orderkey").alias("sequence_id"), rank.alias("rank"), (F.col("l_quantity") / 50).alias("score"), F.col("l_partkey").cast("string").alias("title"), F.when(F.col("l_suppkey") % 4 != 0, "someone").alias("artist"))
    return labels.identified(rows).select("sequence_id", "title", "confidence", "a_verifier")


_PROBES = "SELECT p_name || p_partkey AS path, unnest(range(CASE WHEN p_size % 7 = 0 THEN 2 ELSE 1 END)) AS stream, p_retailprice AS seconds, CASE p_size % 4 WHEN 0 THEN 25.0 WHEN 1 THEN 24000 / 1001.0 WHEN 2 THEN 0.0 ELSE 24.5 END AS mean, CASE p_size % 4 WHEN 0 THEN 25.0 WHEN 1 THEN 24.0 ELSE 25.0 END AS stated FROM part"


def _probed(part: DataFrame) -> DataFrame:
    """Probe rows of video streams: steady, a little off, unreadable and varying rates; some files have two streams."""
    return part.select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"), F.explode(F.expr("sequence(0, if(p_size % 7 = 0, 1, 0))")).alias("stream"), F.col("p_retailprice").alias("seconds"), F.expr("CASE p_size % 4 WHEN 0 THEN '25/1' WHEN 1 THEN '24000/1001' WHEN 2 THEN '0/0' ELSE '49/2' END AS avg_frame_rate"), F.expr("CASE p_size % 4 WHEN 0 THEN '25/1' WHEN 1 THEN '24/1' ELSE '25/1' END AS r_frame_rate"))


@query("part", oracle=f"SELECT path, any_value(seconds) AS seconds, round(any_value(seconds) / 60, 1) AS minutes, round(any_value(mean), 2) AS rate, abs(any_value(mean) - any_value(stated)) > 0.05 AND any_value(mean) > 0 AS varying, count(*) > 1 AS several_streams FROM ({_PROBES}) x GROUP BY path")
def library_files(part: DataFrame) -> DataFrame:
    return labels.library_files(_probed(part))


@query("part", oracle="SELECT count(*) AS files, round(sum(p_retailprice) / 3600, 3) AS hours, count(*) FILTER (p_size % 4 = 3) AS varying, count(*) FILTER (p_size % 7 = 0) AS several_streams FROM part")
def library_report(part: DataFrame) -> DataFrame:
    return labels.library_hours(labels.library_files(_probed(part)))


@query("frames", oracle="SELECT film_id, t, next FROM (SELECT film_id, t, score, lead(t) OVER (PARTITION BY film_id, CAST(floor(t / 600) AS BIGINT) ORDER BY t) AS next FROM frames) x WHERE score >= 0.12 AND next IS NOT NULL")
def frame_pairs(frames: DataFrame) -> DataFrame:
    rows = frames.select("film_id", F.floor(F.col("t") / 600).alias("segment"), F.col("t").alias("pos"), (F.col("score") * 100).alias("points"))
    return labels.frame_pairs(rows).select("film_id", F.col("pos").alias("t"), "next")


@query("segments", oracle="SELECT film_id, debut, fin, trim(regexp_replace(texte, '\\s+', ' ', 'g')) AS texte FROM segments WHERE trim(texte) <> ''")
def parsed_subtitles(segments: DataFrame) -> DataFrame:
    """Segments written as one subtitle file a film, and read again."""
    from reelframe.functions.numbers import timecode_of_ms

    block = F.concat_ws("\n", F.lit("1"), F.concat_ws(" --> ", timecode_of_ms(F.col("debut")), timecode_of_ms(F.col("fin"))), F.concat(F.lit("<i>"), F.regexp_replace("texte", r"\n\s*\n", "\n"), F.lit("</i>")))
    files = segments.select("film_id", "debut", block.alias("b")).groupBy("film_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("debut", "b"))), lambda x: x["b"]), "\n\n").alias("value"))
    return sources.subtitles(files)


@query("events", oracle="SELECT user_id AS job, event_id % 50 AS current, 49::BIGINT AS total, CAST(round_even((event_id % 50) / 49.0 * 100, 0) AS BIGINT) AS percent, event_id % 50 >= 49 AS finished FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type <> 'error') x WHERE r = 1")
def job_states(events: DataFrame) -> DataFrame:
    line = F.when(F.col("event_type") == "error", "failed").otherwise(F.concat(F.lit("["), (F.col("event_id") % 50).cast("string"), F.lit("/49] done")))
    return sources.job_progress(events.select(F.col("user_id").alias("job"), F.col("event_id").alias("line_no"), line.alias("value")), r"\[(\d+)/(\d+)\]")


@query("photos", oracle="SELECT photo_id, titre AS title, CAST(1900 + photo_id % 90 AS INT) AS year FROM photos")
def titles_and_years(photos: DataFrame) -> DataFrame:
    name = F.concat("titre", F.lit(" ("), (1900 + F.col("photo_id") % 90).cast("string"), F.lit(").mkv"))
    title, year = sources.title_and_year(name)
    return photos.select("photo_id", title.alias("title"), year.alias("year"))


@query("films", oracle="SELECT film_id AS file_name, CASE WHEN annee % 2 = 0 AND coalesce(titre, '') <> '' THEN titre ELSE concat('cut ', film_id, ' ', CAST(annee AS VARCHAR)) END AS titre, CAST(annee AS VARCHAR) AS annee FROM films")
def prefilled_records(films: DataFrame) -> DataFrame:
    files = films.select(F.col("film_id").alias("file_name"), F.concat_ws(" ", F.lit("cut"), "film_id", F.col("annee").cast("string")).alias("stem"), F.lower("film_id").alias("slug"))
    known = films.where("annee % 2 = 0").select(F.concat_ws(" ", F.lit("cut"), "film_id", F.col("annee").cast("string")).alias("key"), "titre", F.lit("").alias("annee"))
    return records.prefilled(files, known, ["titre", "annee"])


@query("lineitem", oracle="SELECT l_orderkey AS recording_id, string_agg(a, ', ' ORDER BY p) AS authors FROM (SELECT l_orderkey, a, p, row_number() OVER (PARTITION BY l_orderkey ORDER BY p) AS r FROM (SELECT l_orderkey, concat('artist ', CAST(l_suppkey % 10 AS VARCHAR)) AS a, min(l_linenumber * 100 + l_suppkey % 10) AS p FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL) x) y WHERE r <= 4 GROUP BY l_orderkey")
def music_authors(lineitem: DataFrame) -> DataFrame:
    role = F.when(F.col("l_returnflag") == "N", "performer").when(F.col("l_returnflag") == "A", "composer").otherwise("writer")
    return records.authors(lineitem.select(F.col("l_orderkey").alias("recording_id"), F.col("l_linenumber").alias("pos"), role.alias("role"), F.concat(F.lit("artist "), (F.col("l_suppkey") % 10).cast("string")).alias("artist")))


@query("films", oracle="SELECT film_id, CASE WHEN annee % 2 = 0 THEN 'fr' ELSE coalesce(pitch, '') END AS pitch, coalesce(pays, '') AS pays, titre FROM films")
def translated_records(films: DataFrame) -> DataFrame:
    fields = films.select("film_id", F.lit("pitch").alias("field"), F.when(F.col("annee") % 2 == 0, "fr").otherwise("").alias("value"))
    return records.translated(films.select("film_id", "pitch", "pays", "titre"), fields, "film_id", ["pitch", "pays"])


_SLUG = "trim(lower(regexp_replace(film_id, '[^a-zA-Z0-9]+', '-', 'g')), '-')"


@query("shots", oracle=f"SELECT film_id, n, echelle, array_to_string(list_transform(list_filter(list_concat([{{'r': 'vignette', 'p': vignette}}], list_transform(string_split(vignettes, '|'), lambda v, i: {{'r': concat('vignette_', i - 1), 'p': v}}), [{{'r': 'apercu', 'p': CASE WHEN n % 2 = 0 THEN 'p/a.mp4' ELSE '' END}}]), lambda m: m.p <> ''), lambda m: concat(m.r, '=', {_SLUG}, '_', film_id, printf('/plan_%05d/', n), regexp_extract(m.p, '[^/]*$'))), '|') AS medias FROM shots WHERE n % 7 = 0")
def selected_shots(shots: DataFrame) -> DataFrame:
    """Every seventh shot, asked for twice, with the media of its export."""
    ids = shots.where("n % 7 = 0").select(F.explode(F.array(F.col("n"), F.col("n") + 1000)).alias("pos"), F.concat_ws("#", "film_id", "n").alias("id"))
    rows = shots.select("film_id", "n", "echelle", "vignette", F.split("vignettes", r"\|").alias("vignettes"), F.when(F.col("n") % 2 == 0, "p/a.mp4").alias("apercu"))
    chosen = publish.selection(ids, rows)
    medias = F.transform(publish.media_of(chosen, F.col("film_id")), lambda m: F.concat_ws("=", m["role"], m["fichier"]))
    return chosen.select("film_id", "n", "echelle", F.array_join(medias, "|").alias("medias"))


@query("shots", "films", oracle="SELECT s.film_id, n, concat_ws(chr(10), 'Titre : ' || nullif(titre, ''), 'Pays : ' || nullif(pays, ''), 'Lieu : ' || nullif(lieu, ''), 'Plan : ' || nullif(echelle, '')) AS prompt FROM shots s LEFT JOIN films f ON s.film_id = f.film_id")
def shot_prompts(shots: DataFrame, films: DataFrame) -> DataFrame:
    rows = shots.join(films.select("film_id", "titre", "pays"), "film_id", "left")
    return rows.select("film_id", "n", publish.prompt([("Titre", F.col("titre"), 80), ("Pays", F.col("pays"), 80), ("Lieu", F.col("lieu"), 80), ("Plan", F.col("echelle"), 80)]).alias("prompt"))


@query("shots", oracle="SELECT film_id, n FROM shots WHERE n % 3 <> 0")
def pending_shots(shots: DataFrame) -> DataFrame:
    return publish.pending(shots.select("film_id", "n"), shots.where("n % 3 = 0"), "film_id", "n")


@query("films", oracle="SELECT film_id, concat_ws('|', CASE WHEN coalesce(titre, '') <> '' THEN concat('Titre=', titre) END, CASE WHEN coalesce(pays, '') <> '' THEN concat('Pays=', pays) END) AS credits FROM films")
def film_credits(films: DataFrame) -> DataFrame:
    rows = publish.credits(films, {"Titre": "titre", "Pays": "pays"})
    pairs = F.transform(F.map_entries("credits"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return rows.select("film_id", F.array_join(F.reverse(F.array_sort(pairs)), "|").alias("credits"))


@query("attempts", oracle="SELECT shot_id AS film_id, attempt AS id, max(seconds) AS seconds FROM attempts GROUP BY ALL")
def latest_runs(attempts: DataFrame) -> DataFrame:
    runs = attempts.select(F.col("shot_id").alias("film_id"), F.col("attempt").alias("id"), F.col("seconds").alias("run_ts"), "seconds")
    return sequences.latest(runs).select("film_id", "id", "seconds")


@query("files", oracle="SELECT path, concat('https://commons.wikimedia.org/wiki/Special:FilePath/', path) AS url FROM files")
def poster_urls(files: DataFrame) -> DataFrame:
    return files.select("path", url_of_poster(F.col("path")).alias("url"))


@query("photos", oracle="SELECT photo_id FROM photos WHERE description = '' OR photo_id % 2 = 0")
def photos_to_analyse(photos: DataFrame) -> DataFrame:
    """Listed photos that have no described record."""
    described = photo_ops.searched(photos.where("photo_id % 2 <> 0 and description <> ''"), "", ["titre"])
    return photos.join(described.select("photo_id"), "photo_id", "left_anti").select("photo_id")
