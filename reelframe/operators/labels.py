"""Small rules over records, sound tracks and descriptions, each a Column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.functions.text import blank, first_truthy, fold_keeping_signs, squashed

#: Phrases of biographies, which a pitch shouldn't hold.
BIOGRAPHIC = ["était un cinéaste", "dramaturge et acteur", "parfois crédité sous le nom", "nouveau cinéma allemand", "new german cinema", "was a german film director"]
#: Patterns of codec and release names in folded text.
TECHNICAL = [r"e[- ]?ac[- ]?3", r"ac[- ]?3", r"\bdolby\b", r"\bdts\b", r"\bpcm\b", r"[57][\., ]1", r"\bstereo\b", r"\bmono\b", r"\baudio\b", r"\btrack\b", r"\bversion\b", r"\b(480p|576p|720p|1080p|2160p|4k|uhd)\b", r"\b(blu[- ]?ray|brrip|dvdrip|hdrip|webrip|web[- ]?dl|remux)\b", r"\b(x264|x265|h264|h265|hevc|aac|rarbg|yify|proper|repack)\b"]
#: Words of announcements, and words in brackets of subtitles.
ANNOUNCED = ["welcome", "attention", "please state", "this is", "announcement", "voiceprint", "recording", "message", "captain speaking", "ordinateur", "systeme", "transmission"]
SUNG = [" sing ", " singing", "song", "chanson", "musique", "orchestra", "theme"]
CUE_MUSIC = ["music", "musique", "song", "theme", "♪", "orchestra", "band", "radio"]
CUE_SONG = ["singing", "chant", "song", "lyrics", "chorus", "choir", "♪"]
CUE_NOISE = ["wind", "thunder", "rain", "applause", "laugh", "scream", "crying", "gun", "explosion", "door", "alarm", "sirens", "engine", "static", "noise", "howling", "breathing", "panting"]
CUE_REMOTE = ["speaking in", "radio", "over pa", "intercom", "offscreen"]
NO_MUSIC, PLAIN = "aucune musique signalée", "ambiance non qualifiée"


def suspect_pitch(pitch: Column, synopsis: Column) -> Column:
    text = F.lower(F.trim(first_truthy(pitch, synopsis)))
    return (text == "") | F.exists(F.array(*(F.lit(b) for b in BIOGRAPHIC)), lambda b: F.contains(text, b))


def context_sufficient(pitch: Column, synopsis: Column, scenario: Column) -> Column:
    return (squashed(first_truthy(pitch, synopsis)) != "") & (squashed(F.coalesce(scenario, F.lit(""))) != "")


def technical_name(text: Column) -> Column:
    return fold_keeping_signs(text).rlike("|".join(TECHNICAL))


def audio_source(source: Column) -> Column:
    low = fold_keeping_signs(source)
    return F.when(low == "", "aucune source").when(low.rlike("sous[- ]titres"), "sous-titres intégrés").when(F.contains(low, F.lit("whisper")), "transcription whisper locale").otherwise(F.trim(source))


def silent(mean_db: Column, max_db: Column) -> Column:
    return F.coalesce(mean_db <= -52, F.lit(False)) | F.coalesce(max_db <= -34, F.lit(False))


def sound_layers(shots: DataFrame) -> DataFrame:
    """shots (dialogue, dialogue_texte, n_segments) with dialogue_types, musique_types and ambiance_types."""
    said, on = F.coalesce("dialogue_texte", F.lit("")), F.coalesce("dialogue", F.lit(False))
    # what the rules share are columns, so that each is made once
    found = F.array_join(F.transform(F.regexp_extract_all(said, F.lit(r"\[[^\]]{0,60}\]"), 0), lambda c: F.lower(c)), "|")
    rows = shots.withColumns({"_low": fold_keeping_signs(said), "_cues": found})
    rows = rows.withColumn("_words", F.size(F.regexp_extract_all("_low", F.lit(r"\b[\w']+\b"), 0)))
    low, cues, words, count = F.col("_low"), F.col("_cues"), F.col("_words"), F.coalesce("n_segments", F.lit(0))
    has = lambda text, terms: F.exists(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(text, t))
    spoken = on & (F.trim(said) != "")
    rules = [
        ("conversation", (count >= 3) | (F.regexp_count(said, F.lit(r"(?:^|\s)-\s*\w")) >= 2)),
        ("monologue", (count <= 2) & (words >= 18)),
        ("questions / réponses", F.contains(said, F.lit("?"))),
        ("réplique brève", words <= 8),
        ("dialogue expressif", F.regexp_count(said, F.lit("!")) >= 2),
        ("annonce / message", has(low, ANNOUNCED)),
    ]
    kinds = F.array_compact(F.array(*(F.when(spoken & c, k) for k, c in rules)))
    kinds = F.when(on & (F.size(kinds) == 0), F.array(F.lit("dialogue continu"))).otherwise(kinds)
    song, music = (spoken & has(low, SUNG)) | has(cues, CUE_SONG), has(cues, CUE_MUSIC)
    tunes = F.array_compact(F.array(F.when(song, "chant / chanson"), F.when(music, "musique signalée")))
    noises = F.array_compact(F.array(F.when(has(cues, CUE_NOISE), "effets / ambiance"), F.when(has(cues, CUE_REMOTE), "voix hors-champ / médiatisée")))
    noises = F.when(on & (F.size(noises) == 0) & (cues == ""), F.array(F.lit(PLAIN))).otherwise(noises)
    rows = rows.withColumns({"dialogue_types": kinds, "musique_types": F.when(F.size(tunes) > 0, tunes).otherwise(F.array(F.lit(NO_MUSIC))), "ambiance_types": noises})
    return rows.drop("_low", "_cues", "_words")


def video_candidate(model: Column, camera: Column, confidence: Column, conflict: Column, difficult: bool, again: bool = False) -> Column:
    """Whether a shot still needs video classification; with difficult, only unsure measures do."""
    new = F.lit(True) if again else blank(model)
    if not difficult:
        return new
    unsure = F.coalesce(camera, F.lit("")).isin("", "indéterminé", "mouvement complexe") | F.coalesce(confidence, F.lit("")).isin("", "douteux", "probable")
    return new & (unsure | F.coalesce(conflict, F.lit(False)))


def prepared(thumbnail: Column, thumbnails: Column) -> Column:
    return ~blank(thumbnail) & (F.coalesce(F.size(thumbnails), F.lit(0)) >= 3) & F.forall(F.slice(thumbnails, 1, 3), lambda t: F.trim(t) != "")


def attributed(description: Column, model: Column) -> Column:
    """The description with the model's name at its end, once."""
    base = F.rtrim(F.regexp_replace(F.trim(F.coalesce(description, F.lit(""))), r"\s*\(analyse : [^)]*\)\s*$", ""))
    return F.when((base == "") | blank(model), base).otherwise(F.concat(base, F.lit(" (analyse : "), F.trim(model), F.lit(")")))


def json_object(text: Column) -> Column:
    """The JSON object in a model's answer: fences go, else what lies between the first and the last brace; null if none."""
    bare = F.regexp_replace(F.trim(text), r"(?s)^```[a-z]*\s*|\s*```$", "")
    braced = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(*(F.when(F.try_parse_json(t).isNotNull() & t.startswith("{"), t) for t in (bare, braced)))


def overlaid(rows: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Non-empty answers replace the fields; the first original is kept as a struct."""
    a, b = rows.alias("a"), new.alias("b")
    out = a.join(b, key, "left")
    first = F.coalesce("a.original", F.struct(*(F.col(f"a.{f}") for f in fields))) if "original" in rows.columns else F.struct(*(F.col(f"a.{f}") for f in fields))
    return out.select(key, *(first_truthy(F.col(f"b.{f}"), F.col(f"a.{f}")).alias(f) for f in fields), first.alias("original"))


def preferred_stream(streams: DataFrame) -> DataFrame:
    """(film_id, stream) of the first French, else English, else first track of (film_id, stream, language)."""
    low = F.lower(F.coalesce("language", F.lit("")))
    rank = F.when(low.startswith("fr"), 0).when(low.startswith("en"), 1).otherwise(2)
    return streams.groupBy("film_id").agg(F.min_by("stream", F.struct(rank, F.col("stream"))).alias("stream"))


def identified(candidates: DataFrame, most: int = 5) -> DataFrame:
    """The first candidate of each sequence_id where title and artist are set, with its confidence."""
    order = Window.partitionBy("sequence_id").orderBy("rank")
    rows = candidates.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).where("_r = 1").where(~blank(F.col("title")) & ~blank(F.col("artist")))
    trust = F.when(F.col("score") >= 0.90, "élevée").when(F.col("score") >= 0.70, "moyenne").otherwise("faible")
    return rows.select("sequence_id", "title", "artist", trust.alias("confidence"), (F.col("score") < 0.95).alias("a_verifier"))


def rate(fraction: Column) -> Column:
    """Images a second from a fraction like 25000/1001; 0 where it can't be read."""
    part = F.split(fraction, "/")
    over = lambda i: F.try_element_at(part, F.lit(i)).try_cast("double")
    return F.coalesce(F.try_divide(over(1), F.nullif(over(2), F.lit(0.0))), F.lit(0.0))


def library_files(streams: DataFrame) -> DataFrame:
    """Of each file its minutes, mean rate, and whether its rate varies or it has several video streams.

    streams: path, stream, seconds, avg_frame_rate, r_frame_rate; the first stream of a file tells its rates"""
    first = lambda c: F.min_by(c, "stream")
    files = streams.groupBy("path").agg(F.max("seconds").alias("seconds"), F.count("*").alias("streams"), first(rate(F.col("avg_frame_rate"))).alias("mean"), first(rate(F.col("r_frame_rate"))).alias("stated"))
    varying = (F.abs(F.col("mean") - F.col("stated")) > 0.05) & (F.col("mean") > 0)
    return files.select("path", "seconds", F.round(F.col("seconds") / 60, 1).alias("minutes"), F.round("mean", 2).alias("rate"), varying.alias("varying"), (F.col("streams") > 1).alias("several_streams"))


def library_hours(files: DataFrame) -> DataFrame:
    """Files, hours, and how many have a varying rate or several video streams, from library_files()."""
    return files.agg(F.count("*").alias("files"), F.round(F.sum("seconds") / 3600, 3).alias("hours"), F.count_if("varying").alias("varying"), F.count_if("several_streams").alias("several_streams"))


def frame_pairs(frames: DataFrame) -> DataFrame:
    """Each frame of a segment with the next one; pairs with too few tracked points go."""
    order = Window.partitionBy("film_id", "segment").orderBy("pos")
    return frames.withColumn("next", F.lead("pos").over(order)).where((F.col("points") >= 12) & F.col("next").isNotNull())
