"""Registered queries on identification, pages, images, photo stores, context and validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.functions.ranks import in_order
from reelframe.functions.text import listed
from reelframe.operators import cutting, dialogue, identification, labels, layers, photos as photo_ops, presence, progress, publish, records, scoring, validation
from reelframe.sources import documents as sources, pages as wiki

from .adapters import query


def _placed(rows: DataFrame, *names: str) -> DataFrame:
    """Some columns of ordered rows, and each row's place."""
    return in_order(rows.select(*names), "position")


# identification of music

_TECH = "regexp_matches(lower({0}), 'e[- ]?ac[- ]?3|ac[- ]?3|\\bdolby\\b|\\bdts\\b|[57][., ]1|\\btrack\\b|\\bversion\\b|\\bx265\\b|\\bremux\\b')"
_CLEAN = "trim(regexp_replace({0}, '\\s+', ' ', 'g'), ' .,:;–-')"
_Q1, _Q2 = "(?i)[«\"]([^\"]+)[»\"]\\s+(?:by|de)\\s+([^\\n]+)", "(?i)(?:song|chanson|musique)\\s*[:\\-]\\s*[«\"]?([^\"\\n]+?)[»\"]?\\s+(?:by|de)\\s+([^\\n]+)"
_NO = "coalesce({0}, '') = ''"
_IDENTIFIED = f"""WITH q AS (SELECT *, coalesce(nullif({_CLEAN.format(f"regexp_extract(dialogue, '{_Q1}', 1)")}, ''), {_CLEAN.format(f"regexp_extract(dialogue, '{_Q2}', 1)")}) AS qt, coalesce(nullif({_CLEAN.format(f"regexp_extract(dialogue, '{_Q1}', 2)")}, ''), {_CLEAN.format(f"regexp_extract(dialogue, '{_Q2}', 2)")}) AS qa FROM answers),
a AS (SELECT shot_id, musique_presente, tag_title, tag_artist, tag_composer, trim(print_title) AS pt, trim(print_artist) AS pa, print_author, CASE WHEN u THEN qt ELSE titre_morceau END AS t, CASE WHEN u THEN qa ELSE artiste_morceau END AS r, CASE WHEN u THEN qa ELSE auteur_morceau END AS w,
 CASE WHEN u THEN 'indices textuels / sous-titres' ELSE identification_methode END AS m, CASE WHEN u THEN 'moyenne' ELSE identification_confiance END AS c, CASE WHEN u THEN true ELSE a_verifier END AS v FROM (SELECT *, qt <> '' AND qa <> '' AND ({_NO.format("titre_morceau")} OR {_NO.format("artiste_morceau")}) AS u FROM q) x),
b AS (SELECT shot_id, musique_presente, pt, pa, print_author, CASE WHEN u THEN tag_title ELSE t END AS t, CASE WHEN u THEN coalesce(nullif(r, ''), tag_artist) ELSE r END AS r, CASE WHEN u THEN coalesce(nullif(w, ''), nullif(tag_composer, ''), tag_artist) ELSE w END AS w,
 CASE WHEN u THEN coalesce(nullif(m, ''), 'métadonnées locales') ELSE m END AS m, CASE WHEN u THEN coalesce(nullif(c, ''), 'faible') ELSE c END AS c, CASE WHEN u THEN coalesce(v, true) ELSE v END AS v FROM (SELECT *, {_NO.format("t")} AND tag_title <> '' AS u FROM a) x),
c AS (SELECT shot_id, musique_presente, CASE WHEN u THEN pt ELSE t END AS t, CASE WHEN u THEN pa ELSE r END AS r, CASE WHEN u THEN coalesce(nullif(print_author, ''), pa) ELSE w END AS w, CASE WHEN u THEN 'empreinte acoustid + musicbrainz' ELSE m END AS m, CASE WHEN u THEN 'moyenne' ELSE c END AS c, CASE WHEN u THEN true ELSE v END AS v
 FROM (SELECT *, ({_NO.format("t")} OR {_NO.format("r")}) AND pt <> '' AND pa <> '' AS u FROM b) x),
d AS (SELECT *, coalesce({_TECH.format("t")}, false) OR coalesce(t, '') <> '' AND (m = 'analyse spectrale locale' OR NOT musique_presente AND m = 'métadonnées locales') AS bad FROM c)
SELECT shot_id, CASE WHEN bad THEN '' ELSE t END AS titre, CASE WHEN bad THEN '' ELSE r END AS artiste, CASE WHEN bad THEN '' ELSE w END AS auteur, CASE WHEN bad THEN '' ELSE m END AS methode, CASE WHEN bad THEN '' ELSE c END AS confiance, CASE WHEN bad THEN false ELSE v END AS a_verifier FROM d"""


def _identified(answers: DataFrame) -> DataFrame:
    tags = F.struct(F.col("tag_title").alias("title"), F.col("tag_artist").alias("artist"), F.col("tag_composer").alias("composer"))
    none = F.lit(None).cast("string")
    prints = F.struct(F.col("print_title").alias("title"), F.col("print_artist").alias("artist"), F.col("print_author").alias("author"), none.alias("method"), none.alias("confidence"), F.lit(None).cast("boolean").alias("a_verifier"))
    return identification.identified(answers, F.col("dialogue"), tags, prints)


@query("answers", oracle=_IDENTIFIED)
def identified_answers(answers: DataFrame) -> DataFrame:
    rows = _identified(answers)
    return rows.select("shot_id", F.col("titre_morceau").alias("titre"), F.col("artiste_morceau").alias("artiste"), F.col("auteur_morceau").alias("auteur"), F.col("identification_methode").alias("methode"), F.col("identification_confiance").alias("confiance"), "a_verifier")


@query("answers", oracle=f"SELECT shot_id, coalesce({_TECH.format('titre_morceau')}, false) OR coalesce(titre_morceau, '') <> '' AND (identification_methode = 'analyse spectrale locale' OR NOT musique_presente AND identification_methode = 'métadonnées locales') AS misleading FROM answers")
def misleading_answers(answers: DataFrame) -> DataFrame:
    return answers.select("shot_id", identification.misleading().alias("misleading"))


@query(
    "part",
    oracle=f"""WITH s AS (SELECT p_partkey AS film_id, p_name AS titre, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN '' ELSE 'E-AC-3 5.1' END AS title, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS artist, concat(p_brand, repeat('x', p_size * 5)) AS album FROM part),
f AS (SELECT *, coalesce(nullif(title, ''), CASE WHEN film_id % 3 <> 0 THEN concat('Cue ', film_id) END, '') AS t, coalesce(nullif(artist, ''), CASE WHEN film_id % 3 <> 0 THEN 'Ann' END, '') AS a FROM s)
SELECT film_id, CASE WHEN lower(t) = lower(titre) OR {_TECH.format("t")} THEN '' ELSE t END AS title, a AS artist, CASE WHEN film_id % 3 <> 0 THEN 'Bob' ELSE '' END AS composer, CASE WHEN length(album) > 180 THEN '' ELSE album END AS album FROM f""",
)
def local_tags(part: DataFrame) -> DataFrame:
    """Tags of containers, gaps filled from the first audio stream, which every third file lacks."""
    size, none = F.col("p_size"), F.lit("")
    title = F.when(size % 4 == 0, F.col("p_name")).when(size % 4 == 1, F.upper("p_name")).when(size % 4 == 2, "").otherwise("E-AC-3 5.1")
    files = part.select(F.col("p_partkey").alias("film_id"), F.col("p_name").alias("titre"), title.alias("title"), F.when(size % 2 == 0, F.col("p_brand")).otherwise("").alias("artist"), none.alias("composer"), F.concat("p_brand", F.repeat(F.lit("x"), size * 5)).alias("album"))
    first = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("film_id"), F.lit(1).alias("pos"), F.lit("audio").alias("codec_type"), F.concat(F.lit("Cue "), F.col("p_partkey").cast("string")).alias("title"), F.lit("Ann").alias("artist"), F.lit("Bob").alias("composer"))
    others = part.select(F.col("p_partkey").alias("film_id"), F.lit(0).alias("pos"), F.lit("video").alias("codec_type"), *(F.lit("no").alias(c) for c in ("title", "artist", "composer")))
    later = first.withColumns({"pos": F.lit(2), "title": F.lit("later")})
    return identification.local_tags(files, later.unionByName(others).unionByName(first))


@query("answers", oracle="SELECT shot_id, shot_id % 4 = 2 AS musique_presente, CASE shot_id % 4 WHEN 1 THEN 'indéterminé' WHEN 2 THEN '' ELSE 'silence / quasi-silence' END AS design, CASE WHEN shot_id % 4 IN (0, 3) THEN 'très faible' ELSE '' END AS intensite, shot_id % 4 = 1 AS a_verifier, CASE shot_id % 4 WHEN 1 THEN 'Analyse locale non concluante.' WHEN 2 THEN '' ELSE 'Extrait très faible ou quasi silencieux.' END AS notes FROM answers")
def default_answers(answers: DataFrame) -> DataFrame:
    """Silent shots with an answer and without one, other shots without an answer, and with one."""
    known = F.col("shot_id") % 4 >= 2
    empty = {"boolean": F.lit(True), "array<string>": F.array().cast("array<string>"), "string": F.lit("")}
    given = answers.select("shot_id", *(F.when(known, F.lit(False) if c == "a_verifier" else empty[k]).alias(c) for c, k in identification.ANSWER.items()))
    rows = identification.answered(given, (F.col("shot_id") % 4).isin(0, 3))
    return rows.select("shot_id", "musique_presente", F.array_join("design_sonore_types", "|").alias("design"), F.col("intensite_sonore").alias("intensite"), "a_verifier", F.col("notes_audio").alias("notes"))


@query("answers", oracle="SELECT shot_id, CASE WHEN shot_id % 3 = 0 THEN musique_presente END AS musique_presente, CASE WHEN shot_id % 3 = 0 THEN coalesce(titre_morceau, '') ELSE 'avant' END AS musique_titre, CASE WHEN shot_id % 3 = 0 THEN coalesce(a_verifier, false) END AS musique_a_verifier, CASE WHEN shot_id % 3 = 0 THEN '' END AS audio_notes FROM answers")
def audio_overlay(answers: DataFrame) -> DataFrame:
    """Every third shot gets its answer, which lacks notes, and loses the title that it had."""
    shots = answers.select("shot_id", F.lit("avant").alias("musique_titre"))
    given = answers.where("shot_id % 3 = 0")
    given = given.select("shot_id", *(F.col(c) if c in answers.columns else F.lit(None).cast(k).alias(c) for c, k in identification.ANSWER.items()))
    return identification.overlaid(shots, given, ["shot_id"]).select("shot_id", "musique_presente", "musique_titre", "musique_a_verifier", "audio_notes")


@query("shots", oracle="SELECT film_id, n, CASE WHEN n % 2 = 0 THEN generique ELSE n % 5 = 0 END AS generique, CASE WHEN n % 2 = 0 THEN texte_role ELSE 'avant' END AS texte_role, CASE WHEN n % 2 = 0 THEN false END AS texte_visible, CASE WHEN n % 2 = 0 THEN '' END AS styles FROM shots")
def typography_overlay(shots: DataFrame) -> DataFrame:
    before = shots.select("film_id", "n", (F.col("n") % 5 == 0).alias("generique"), F.lit("avant").alias("texte_role"))
    given = shots.where("n % 2 = 0").select("film_id", "n", *(F.col(c) if c in ("generique", "texte_role") else F.lit(None).cast(k).alias(c) for c, k in identification.WRITING.items()))
    return identification.overlaid(before, given, ["film_id", "n"], identification.WRITING).select("film_id", "n", "generique", "texte_role", "texte_visible", F.array_join("typographie_styles", "|").alias("styles"))


# pages


@query(
    "wikis",
    oracle="""SELECT page_id, CASE WHEN k < 2 THEN concat('Film ', source) END AS name, CASE WHEN k < 2 THEN concat('{{duration|m=', len, '}}') END AS running_time, CASE WHEN k < 2 THEN concat('{{Plainlist|', chr(10), '* [[Ann ', source, ']]', chr(10), '| x = y', chr(10), '}}') END AS starring, CASE WHEN k < 2 THEN 5 ELSE 0 END AS fields,
CASE k WHEN 2 THEN '' ELSE concat('The film ', source, ' has ', len, ' signs.') END AS pitch, concat('It is about ', source, ' & ', lang, '.') AS scenario, CASE WHEN k < 2 THEN concat('Poster ', page_id, '.jpg') ELSE '' END AS poster_fichier, CASE WHEN k < 2 THEN concat('Poster of ', source) ELSE '' END AS poster_legende FROM wikis WHERE k <> 2
UNION ALL SELECT page_id, NULL, NULL, NULL, 0, NULL, concat('It is about ', source, ' & ', lang, '.'), '', '' FROM wikis WHERE k = 2""",
)
def wiki_fields(wikis: DataFrame) -> DataFrame:
    """Fields of pages with an infobox, without one, and with one that isn't closed (whose lead is left open here)."""
    rows = wiki.extracted(wikis)
    value = lambda name: F.try_element_at("infobox", F.lit(name)).alias(name)
    return rows.select("page_id", value("name"), value("running_time"), value("starring"), F.size("infobox").alias("fields"), F.when(F.col("k") != 2, F.col("pitch")).alias("pitch"), "scenario", "poster_fichier", "poster_legende")


@query("films", oracle="SELECT film_id AS file_name, CASE WHEN number % 5 = 0 THEN concat('Own ', number) WHEN number % 5 < 3 THEN concat('Hit ', number) ELSE titre END AS page FROM films")
def page_titles(films: DataFrame) -> DataFrame:
    text = lambda word: F.concat(F.lit(word), F.col("number").cast("string"))
    files = films.select(F.col("film_id").alias("file_name"), "titre", "annee")
    own = films.where("number % 5 = 0").select(F.col("film_id").alias("file_name"), text("Own ").alias("page"))
    asked = F.concat_ws(" ", "titre", F.col("annee").cast("string"), F.lit("film"))
    hits = films.where("number % 5 < 3").select(asked.alias("query"), F.explode(F.array(F.lit(2), F.lit(1))).alias("rank"), text("Hit ").alias("page")).withColumn("page", F.when(F.col("rank") == 1, F.col("page")).otherwise("later"))
    return wiki.page_titles(files, own, hits)


# images and photos

_IMAGES = """WITH c AS (SELECT film_id, n, g, i, path FROM (SELECT film_id, n, 0 AS g, unnest(range(2)) AS i, unnest(string_split(vignettes, '|')[1:2]) AS path FROM shots UNION ALL SELECT film_id, n, 1, 0, vignette FROM shots) x WHERE path IN (SELECT path FROM stills)),
used AS (SELECT film_id, n, row_number() OVER (PARTITION BY film_id, n ORDER BY i) AS pos, path FROM (SELECT *, min(g) OVER (PARTITION BY film_id, n) AS best FROM c) y WHERE g = best)"""


def _with_thumbnails(shots: DataFrame) -> DataFrame:
    return shots.withColumns({"vignettes": F.split("vignettes", r"\|"), "frames": F.array().cast("array<string>")})


@query("shots", "stills", oracle=f"{_IMAGES} SELECT * FROM used")
def shot_images(shots: DataFrame, stills: DataFrame) -> DataFrame:
    return publish.images(_with_thumbnails(shots), stills, ["film_id", "n"], "first", 2)


@query("shots", "stills", oracle="SELECT film_id, n, 1 AS pos, path FROM (SELECT film_id, n, path, row_number() OVER (PARTITION BY film_id, n ORDER BY i) AS k FROM (SELECT film_id, n, unnest([0, 1, 2]) AS i, unnest([string_split(vignettes, '|')[2], string_split(vignettes, '|')[1], string_split(vignettes, '|')[3]]) AS path FROM shots) x WHERE path IN (SELECT path FROM stills)) y WHERE k = 1")
def face_images(shots: DataFrame, stills: DataFrame) -> DataFrame:
    return publish.images(_with_thumbnails(shots), stills, ["film_id", "n"], "face")


@query("shots", "stills", oracle=f"{_IMAGES}, s AS (SELECT DISTINCT film_id, n - (n - 1) % 5 AS first FROM shots), m AS (SELECT s.film_id, first, max(n) AS last FROM s JOIN shots x ON x.film_id = s.film_id AND x.n BETWEEN first AND first + 4 GROUP BY ALL) SELECT m.film_id, first, row_number() OVER (PARTITION BY m.film_id, first ORDER BY u.n) AS pos, path FROM m JOIN used u ON u.film_id = m.film_id AND u.pos = 1 AND u.n IN (first, first + (last - first + 1) // 2, last)")
def sequence_images(shots: DataFrame, stills: DataFrame) -> DataFrame:
    """Images of runs of five shots."""
    runs = shots.groupBy("film_id", (F.col("n") - (F.col("n") - 1) % 5).alias("first")).agg(F.max("n").alias("last"))
    return publish.sequence_images(runs, publish.images(_with_thumbnails(shots), stills, ["film_id", "n"], "first", 2))


def _listing(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return part.where("p_partkey % 6 <> 0").select(k.alias("photo_id"), F.col("p_name").alias("fichier"), F.when(k % 11 == 5, "OSError").alias("error"))


@query("part", oracle="SELECT p_partkey AS photo_id, p_name AS fichier, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS description FROM part WHERE p_partkey % 6 <> 0 AND p_partkey % 11 <> 5")
def synced_photos(part: DataFrame) -> DataFrame:
    stored = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("photo_id"), F.col("p_type").alias("description"))
    return photo_ops.synchronised(_listing(part), stored, "photo_id", ["description"])[0]


@query("part", oracle="SELECT p_partkey AS photo_id, 'OSError' AS error FROM part WHERE p_partkey % 6 <> 0 AND p_partkey % 11 = 5 ORDER BY p_partkey LIMIT 20")
def photo_errors(part: DataFrame) -> DataFrame:
    """The first twenty files that couldn't be read."""
    stored = part.select(F.col("p_partkey").alias("photo_id"), F.col("p_type").alias("description")).where("false")
    return photo_ops.synchronised(_listing(part), stored, "photo_id", ["description"])[1]


@query("part", oracle="SELECT p_partkey AS photo_id, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS description, CASE WHEN p_size % 3 = 0 THEN '' ELSE replace(p_name, ' ', '|') END AS sujets, CASE WHEN p_size % 3 = 0 OR p_size % 2 = 0 THEN '' ELSE p_type END AS type_image, CASE WHEN p_size % 3 = 0 THEN '' ELSE CASE WHEN p_size % 2 = 1 THEN 'true' ELSE 'false' END END AS a_verifier, '' AS couleurs FROM part")
def photo_index(part: DataFrame) -> DataFrame:
    told = F.struct(F.col("p_name").alias("description"), F.split("p_name", " ").alias("sujets"), F.when(F.col("p_size") % 2 == 1, F.col("p_type")).alias("type_image"), (F.col("p_size") % 2 == 1).alias("a_verifier"))
    rows = photo_ops.index(part.select(F.col("p_partkey").alias("photo_id"), F.when(F.col("p_size") % 3 != 0, told).alias("analyse")))
    return rows.select("photo_id", "description", F.array_join("sujets", "|").alias("sujets"), "type_image", "a_verifier", F.array_join("couleurs", "|").alias("couleurs"))


@query("photos", oracle="SELECT false AS active, 'photo arrêtée' AS phase, count(*) FILTER (a_verifier) AS current, count(*) AS total, CAST(round_even(100.0 * count(*) FILTER (a_verifier) / count(*), 0) AS BIGINT) AS percent, CAST(max(photo_id) FILTER (a_verifier) AS VARCHAR) AS item, 'm' AS model, count(*) FILTER (a_verifier) >= count(*) AS finished FROM photos")
def photo_progress(photos: DataFrame) -> DataFrame:
    return photo_ops.progress(photos, photos.where("a_verifier"), "photo_id", False, "m")


_ORDERS = {"file": "fichier", "date": "date_photo DESC", "type": "type_image, fichier", "certainty": "certitude", "verify": "a_verifier DESC, fichier"}


@query("part", oracle=" UNION ALL ".join(f"SELECT '{m}' AS mode, {o.split(',')[0].split()[0]}::VARCHAR AS first_key, fichier, row_number() OVER (ORDER BY {o}, fichier) AS position FROM (SELECT concat('img', p_partkey % 7, '-', lpad(CAST(p_partkey AS VARCHAR), 6, '0')) AS fichier, concat('2020-0', p_partkey % 9 + 1, '-', lpad(CAST(p_partkey AS VARCHAR), 6, '0')) AS date_photo, lower(p_type) AS type_image, concat('c', lpad(CAST(p_partkey AS VARCHAR), 6, '0')) AS certitude, p_size % 3 = 0 AS a_verifier FROM part) x" for m, o in _ORDERS.items()))
def catalogue_orders(part: DataFrame) -> DataFrame:
    """Photos in each of the catalogue's orders, with their place in it."""
    six = F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    rows = part.select(F.concat(F.lit("img"), (F.col("p_partkey") % 7).cast("string"), F.lit("-"), six).alias("fichier"), F.concat(F.lit("2020-0"), (F.col("p_partkey") % 9 + 1).cast("string"), F.lit("-"), six).alias("date_photo"), F.lower("p_type").alias("type_image"), F.concat(F.lit("c"), six).alias("certitude"), (F.col("p_size") % 3 == 0).alias("a_verifier"))
    out = None
    for mode, order in _ORDERS.items():
        placed = _placed(layers.catalogue_order(rows, mode).withColumn("first_key", F.col(order.split(",")[0].split()[0]).cast("string")), "first_key", "fichier")
        placed = placed.select(F.lit(mode).alias("mode"), "first_key", "fichier", "position")
        out = placed if out is None else out.unionByName(placed)
    return out


# context, records and requests


@query("shots", "films", oracle="SELECT s.film_id, n, true AS triage, coalesce(echelle, '') <> '' AND coalesce(lieu, '') <> '' AND coalesce(description, '') <> '' AND coalesce(mots_cles, '') <> '' AS complet, coalesce(pitch, '') <> '' AND coalesce(pays, '') <> '' AS actuel FROM shots s LEFT JOIN films f ON s.film_id = f.film_id")
def analysed_shots(shots: DataFrame, films: DataFrame) -> DataFrame:
    rows = shots.join(films.select("film_id", "pitch", "pays", "titre"), "film_id", "left")
    current = scoring.context_current(F.col("pitch"), F.col("pays"), F.col("titre"))
    return rows.select("film_id", "n", scoring.analysed("triage").alias("triage"), scoring.analysed("complet").alias("complet"), scoring.analysed("triage", current).alias("actuel"))


@query("films", oracle="SELECT film_id, unnest(['pitch', 'synopsis']) AS field, unnest([concat('The story of a crew and ', titre), concat('Its mission is after ', titre)]) AS value FROM films WHERE annee % 2 = 0 UNION ALL SELECT film_id, 'synopsis', concat('Its mission is after ', titre) FROM films WHERE annee % 2 = 1 AND annee % 3 = 0")
def translation_work(films: DataFrame) -> DataFrame:
    even, third = F.col("annee") % 2 == 0, F.col("annee") % 3 == 0
    text = lambda words: F.concat(F.lit(words), "titre")
    rows = films.select("film_id", F.when(even, text(" The story of a crew and ")).otherwise(text("Le film de la mission ")).alias("pitch"), F.when(even | third, text("Its mission is after ")).otherwise("  ").alias("synopsis"), F.lit(None).cast("string").alias("scenario"))
    return records.to_translate(rows, "film_id")


@query("part", oracle="SELECT p_partkey AS film_id, CASE p_size % 4 WHEN 0 THEN concat(p_name, ' — ', p_brand, ' (', p_type, ' · sûre) ; ', p_type) WHEN 1 THEN concat(p_brand, ' (', p_type, ') ; ', p_type) WHEN 2 THEN p_type ELSE '' END AS music FROM part")
def known_music(part: DataFrame) -> DataFrame:
    size, none = F.col("p_size") % 4, F.lit(None).cast("string")
    item = lambda title, author, composer, usage, kind, trust: F.struct(title.alias("titre"), author.alias("auteur"), composer.alias("compositeur"), none.alias("artiste"), usage.alias("usage"), kind.alias("type"), trust.alias("confiance"))
    one = item(F.when(size == 0, F.col("p_name")).otherwise(""), none, F.when(size < 2, F.col("p_brand")), none, F.col("p_type"), F.when(size == 0, "sûre"))
    two = item(F.when(size < 3, F.col("p_type")), F.lit(""), none, F.lit(""), none, none)
    return part.select(F.col("p_partkey").alias("film_id"), publish.known_music(F.when(size < 3, F.array(one, two))).alias("music"))


@query(
    "shots",
    oracle="""SELECT film_id, n, CASE n % 4 WHEN 3 THEN concat('Seul ', lang) WHEN 2 THEN concat('Question unique : ', lang, '?', chr(10), 'Fin.') ELSE concat('Bonjour.', chr(10), chr(10), '- Question unique : ', lang, '?', chr(10), 'Fin.') END AS constant, CASE n % 4 WHEN 0 THEN concat('Contexte du film, à utiliser avec prudence : ', film_id) ELSE '' END AS film, CASE WHEN n % 4 < 2 THEN trim(concat('> Contexte de scène, à utiliser pour désambiguïser le plan : ', echelle)) ELSE '' END AS scene FROM (SELECT film_id, n, lang, coalesce(echelle, 'x') AS echelle FROM shots) s""",
)
def request_parts(shots: DataFrame) -> DataFrame:
    k, line = F.col("n") % 4, F.lit("\n")
    film = F.when(k == 0, F.concat(F.lit(publish.FILM_MARK), F.lit(" "), "film_id", line, line)).otherwise("")
    scene = F.when(k < 2, F.concat(F.lit("> "), F.lit(publish.SCENE_MARK), F.lit(" "), F.coalesce("echelle", F.lit("x")), line)).otherwise("")
    task = F.concat(F.when(k == 2, "").otherwise("- "), F.lit("Question unique : "), "lang", F.lit("?"), line, F.lit("Fin.\n"))
    text = F.when(k == 3, F.concat(F.lit("Seul "), "lang")).otherwise(F.concat(F.when(k == 2, "").otherwise("Bonjour.\n"), film, scene, task))
    return shots.select("film_id", "n", publish.prompt_parts(text).alias("p")).select("film_id", "n", "p.*")


def _requests(shots: DataFrame) -> DataFrame:
    task = F.concat(F.lit("Bonjour.\n\n"), F.when(F.col("n") % 2 == 0, F.concat(F.lit(publish.FILM_MARK), F.lit(" "), "film_id", F.lit("\n"))).otherwise(""), F.lit("Question unique : "), F.when(F.col("n") % 5 == 0, F.col("lang")).otherwise("tout"), F.lit("?"))
    return shots.select("film_id", "n", publish.prompt_parts(task).alias("p")).select("film_id", "n", "p.*")


_ASKED = """SELECT film_id, n, concat('Bonjour.', chr(10), chr(10), 'Question unique : ', CASE WHEN n % 5 = 0 THEN lang ELSE 'tout' END, '?') AS constant, CASE WHEN n % 2 = 0 THEN concat('Contexte du film, à utiliser avec prudence : ', film_id) ELSE '' END AS film FROM shots"""


@query("shots", oracle=f"SELECT film_id, n, (r - 1) % 6 AS pos, dense_rank() OVER (ORDER BY sha256(constant), (r - 1) // 6) - 1 AS batch FROM (SELECT *, row_number() OVER (PARTITION BY constant ORDER BY film, film_id, n) AS r FROM ({_ASKED}) x) y")
def request_batches(shots: DataFrame) -> DataFrame:
    """Requests in batches that share their constant part, and as far as may be their film's."""
    return publish.batched(_requests(shots), ["film_id", "n"]).select("film_id", "n", "pos", "batch")


# presences and lists

_SHOWN = """WITH c AS (SELECT *, doc_id % 6 AS m, CASE WHEN contains(description, 'Trois') THEN 3 WHEN contains(description, 'Deux') THEN 2 WHEN contains(description, 'Un enf') THEN 1 ELSE 0 END AS w FROM captions),
d AS (SELECT *, coalesce(personnages, CASE m WHEN 0 THEN k WHEN 1 THEN w ELSE 0 END) AS n FROM c),
e AS (SELECT *, n > 0 OR m IN (0, 1, 2, 4) OR m = 5 OR personnages_sujets <> '' AS p, CASE WHEN m = 3 THEN CASE WHEN contains(description, 'chien') THEN 'chien' WHEN contains(description, 'cheval') THEN 'cheval' ELSE 'rat' END ELSE '' END AS a,
 CASE m WHEN 0 THEN 'homme|femme' WHEN 5 THEN 'homme|femme' WHEN 1 THEN 'femme' WHEN 4 THEN 'homme' ELSE '' END AS g0, CASE m WHEN 0 THEN 'adulte' WHEN 1 THEN 'enfant' WHEN 2 THEN 'personne âgée' WHEN 4 THEN 'adulte' WHEN 5 THEN 'adolescent' ELSE '' END AS g1 FROM d)"""


@query(
    "captions",
    oracle=f"""{_SHOWN} SELECT doc_id, p AS persons, CAST(n AS INT) AS n, a AS animals, CASE WHEN g0 = '' AND p THEN 'genre indéterminé' ELSE g0 END AS genders, CASE WHEN g1 = '' AND p THEN 'âge indéterminé' ELSE g1 END AS ages, CASE WHEN a = '' THEN 'sûr' ELSE 'probable' END AS animal_confiance,
concat_ws('|', CASE WHEN p THEN 'personne visible' ELSE 'aucune personne visible' END, CASE WHEN contains(g0, 'homme') THEN 'homme visible' END, CASE WHEN contains(g0, 'femme') THEN 'femme visible' END, CASE WHEN g1 <> '' THEN concat(g1, ' visible') END, CASE WHEN n >= 3 THEN 'groupe' END, CASE WHEN m = 2 THEN 'silhouette' END, CASE WHEN a <> '' THEN 'animal visible' ELSE 'aucun animal visible' END) AS categories FROM e""",
)
def shown_persons(captions: DataFrame) -> DataFrame:
    rows = presence.presences(captions)
    join = lambda c: F.array_join(c, "|").alias(c)
    return rows.select("doc_id", "persons", F.col("count").cast("int").alias("n"), join("animals"), join("genders"), join("ages"), "animal_confiance", join("categories"))


@query("captions", oracle=f"{_SHOWN} SELECT count(*) AS shots, count(*) FILTER (p) AS with_persons, count(*) FILTER (contains(g0, 'homme')) AS with_men, count(*) FILTER (contains(g0, 'femme')) AS with_women, count(*) FILTER (g1 = 'enfant') AS with_children, count(*) FILTER (a <> '') AS with_animals, count(*) FILTER (n >= 3) AS groups, count(*) FILTER (personnages IS DISTINCT FROM n) AS modified FROM e")
def presence_statistics(captions: DataFrame) -> DataFrame:
    """Statistics of all captions; those have changed whose count isn't the stated one."""
    return presence.statistics(presence.presences(captions), ~F.col("count").eqNullSafe(F.col("personnages")))


@query("part", oracle="SELECT p_partkey AS shot_id, CASE p_size % 3 WHEN 0 THEN concat(p_type, '|', p_brand) WHEN 1 THEN p_type ELSE '' END AS origins FROM part")
def documented_origins(part: DataFrame) -> DataFrame:
    k, none = F.col("p_size") % 3, F.array().cast("array<string>")
    person = lambda a, b: F.struct(a.alias("origine_ethnique_documentee"), b.alias("origine_ethnique"), none.alias("ethnie_documentee"), F.col("p_name").alias("nom"))
    people = F.array(person(F.array("p_type"), none), person(none, F.when(k == 0, F.array(F.concat(F.lit(" "), "p_brand"), F.col("p_type"))).otherwise(F.array(F.lit("")))))
    return part.select(F.col("p_partkey").alias("shot_id"), F.array_join(presence.origins(F.when(k < 2, people)), "|").alias("origins"))


@query("documents", oracle="SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat(lang, '|', source) WHEN 1 THEN source WHEN 2 THEN CAST(n_chars AS VARCHAR) ELSE '' END AS listed FROM documents")
def listed_values(documents: DataFrame) -> DataFrame:
    """Scalars and lists of one field, as lists."""
    k, quote = F.col("doc_id") % 5, F.lit('"')
    raw = F.when(k == 0, F.concat(F.lit('["'), "lang", F.lit('"," ","'), "source", F.lit(' "]'))).when(k == 1, F.concat(quote, F.lit(" "), "source", quote)).when(k == 2, F.col("n_chars").cast("string")).when(k == 3, "null").otherwise('""')
    return documents.select("doc_id", F.array_join(listed(F.parse_json(raw), "variant"), "|").alias("listed"))


# validity, summaries, small rules


@query("attempts", oracle="SELECT engine, count(*) AS answers, count(*) FILTER (score > 0) AS valid, round(100.0 * count(*) FILTER (score > 0) / count(*), 1) AS percent, CAST(coalesce(sum(CASE WHEN echelle NOT IN ('A', 'N') THEN 1 ELSE 0 END + CASE WHEN lieu <> 'O' THEN 1 ELSE 0 END) FILTER (score > 0), 0) AS BIGINT) AS out_of_vocabulary, CAST(coalesce(sum(CASE WHEN nfields = 0 THEN 1 ELSE 0 END) FILTER (score > 0), 0) AS BIGINT) AS missing FROM attempts GROUP BY engine")
def answer_validity(attempts: DataFrame) -> DataFrame:
    rows = attempts.withColumns({"valid": F.col("score") > 0, "fields": F.nullif("nfields", F.lit(0))})
    return validation.validity(rows, "engine", ["fields", "lieu"], {"echelle": ["A", "N"], "lieu": ["O"]})


@query("shots", "segments", oracle="SELECT film_id, CAST(sum(g) AS BIGINT) AS segments, CAST(sum(s) AS BIGINT) AS shots_with_dialogue FROM (SELECT film_id, 1 AS g, 0 AS s FROM segments UNION ALL SELECT film_id, 0, 1 FROM (SELECT DISTINCT s.film_id, s.n FROM shots s JOIN segments t ON s.film_id = t.film_id AND least(s.fin, t.fin) - greatest(s.debut, t.debut) > 0.05) d) x GROUP BY ROLLUP (film_id)")
def dialogue_summary(shots: DataFrame, segments: DataFrame) -> DataFrame:
    return progress.dialogue_summary(segments, dialogue.attached(shots, segments))


@query("shots", oracle="SELECT film_id, n, n % 3 = 0 AND n % 2 = 0 AS prepared FROM shots")
def prepared_shots(shots: DataFrame) -> DataFrame:
    thumbs = F.when(F.col("n") % 3 == 0, F.split("vignettes", r"\|")).when(F.col("n") % 3 == 1, F.array("vignette", F.lit(" "), F.lit("x")))
    return shots.select("film_id", "n", labels.prepared(F.when(F.col("n") % 2 == 0, F.col("vignette")), thumbs).alias("prepared"))


@query("shots", oracle="SELECT film_id, n, CASE WHEN film_id LIKE '%1-0' THEN debut + 1 ELSE debut END AS debut FROM shots WHERE film_id NOT LIKE '%1-0' OR n % 2 = 0")
def visible_shots(shots: DataFrame) -> DataFrame:
    """Films of some sources have a re-cut with every other shot, which counts; an empty proposal doesn't."""
    plan = F.struct("n", "debut")
    recut = F.collect_list(F.when((F.col("n") % 2 == 0) & F.col("film_id").like("%1-0"), F.struct("n", (F.col("debut") + 1).alias("debut"))))
    films = shots.groupBy("film_id").agg(F.collect_list(plan).alias("plans"), recut.alias("plans_proposes"))
    return publish.visible(films.withColumn("strategie", F.lit("non-destructive-add-only-v2")))


@query("pairs", oracle="SELECT shot_id AS film_id, a AS debut, b AS fin FROM (SELECT shot_id, t AS a, lead(t) OVER (PARTITION BY shot_id ORDER BY t) AS b FROM (SELECT DISTINCT shot_id, t FROM (SELECT shot_id, unnest(CASE WHEN round_even(debut - last, 6) < 0.08 THEN [fin] ELSE [debut, fin] END) AS t FROM (SELECT *, lag(fin) OVER (PARTITION BY shot_id ORDER BY pair, debut, fin) AS last FROM (SELECT shot_id, pair, CAST(pair * 10 + CAST(inliers * 10 AS BIGINT) % 3 * 0.05 AS DOUBLE) AS debut, CAST(pair * 10 + 10 AS DOUBLE) AS fin FROM pairs) p) q) r) s) u WHERE b - a >= 0.04")
def clean_bounds(pairs: DataFrame) -> DataFrame:
    late = (F.bround(F.col("inliers") * 10).cast("long") % 3) * 0.05
    rows = pairs.select(F.col("shot_id").alias("film_id"), F.col("pair").alias("pos"), (F.col("pair") * 10 + late).cast("double").alias("debut"), (F.col("pair") * 10 + 10).cast("double").alias("fin"))
    return cutting.clean_bounds(rows)


def _names(*columns: str) -> Column:
    return F.array(*(F.col(c) for c in columns))


@query("part", oracle="SELECT p_partkey AS film_id, array_to_string(list_transform(list_sort(list_transform(list_distinct([p_name, p_brand, p_type]), lambda x: {'k': lower(x), 'v': x})), lambda s: s.v), '|') AS people FROM part")
def all_people(part: DataFrame) -> DataFrame:
    return part.select(F.col("p_partkey").alias("film_id"), F.array_join(publish.all_names(_names("p_name", "p_brand"), F.array(F.lit("")), _names("p_type", "p_name")), "|").alias("people"))


@query("part", oracle="SELECT p_partkey AS film_id, concat_ws('|', p_name, CASE WHEN p_size % 2 = 0 THEN p_type END, 'Zoë Last') AS people FROM part")
def credit_names(part: DataFrame) -> DataFrame:
    line = F.concat("p_name", F.lit(" (as himself) and "), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("Agent 47"), F.lit(", Zoë Last\n"), F.col("p_name"))
    return part.select(F.col("p_partkey").alias("film_id"), F.array_join(sources.names(line), "|").alias("people"))
