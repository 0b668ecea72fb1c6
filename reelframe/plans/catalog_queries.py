"""Registered queries on scenes, sequences, characters, photos, files, attempts, claims, records and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.functions.numbers import cosine, unit
from reelframe.functions.text import fold, fold_keeping_signs, looks_english, photo_id, shorten, slug, tokens
from reelframe.operators import characters, photos as photo_ops, records, validation
from reelframe.sources import documents as sources

from .adapters import query
from .scenes import FOLD as _FOLD


@query("faces", oracle="SELECT a.n, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-9), 6) AS cosine FROM faces a JOIN faces b ON b.n = a.n + 1")
def face_cosines(faces: DataFrame) -> DataFrame:
    a, b = faces.select("n", F.col("embedding").alias("x")), faces.select((F.col("n") - 1).alias("n"), F.col("embedding").alias("y"))
    return a.join(b, "n").select("n", F.round(cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query("faces", oracle="SELECT n, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS x FROM faces")
def unit_faces(faces: DataFrame) -> DataFrame:
    return faces.select("n", F.round(unit(F.col("embedding"))[0], 6).alias("x"))


# photos

_FACETS = ["type_image", "lieu", "orientation", "a_verifier"]
_LONG = "SELECT 'type_image' AS facet, type_image AS value, photo_id FROM photos UNION ALL SELECT 'lieu', lieu, photo_id FROM photos UNION ALL SELECT 'orientation', orientation, photo_id FROM photos UNION ALL SELECT 'a_verifier', CASE WHEN a_verifier THEN 'oui' ELSE 'non' END, photo_id FROM photos"
_CHOSEN = "orientation = 'paysage' AND NOT a_verifier"


@query("photos", oracle="SELECT photo_id, titre FROM photos WHERE contains(lower(concat_ws(' ', titre, type_image, lieu)), 'a') AND contains(lower(concat_ws(' ', titre, type_image, lieu)), 'brand#1')")
def photo_search(photos: DataFrame) -> DataFrame:
    return photo_ops.searched(photos, "A Brand#1", ["titre", "type_image", "lieu"]).select("photo_id", "titre")


@query("photos", oracle=f"SELECT photo_id, titre FROM photos WHERE {_CHOSEN}")
def photo_filter(photos: DataFrame) -> DataFrame:
    return photo_ops.crossed(photos, {"orientation": ["Paysage"], "a_verifier": ["non"]}).select("photo_id", "titre")


@query("photos", oracle=f"WITH long AS ({_LONG}), dom AS (SELECT facet, value, row_number() OVER (PARTITION BY facet ORDER BY value COLLATE fr, value) AS p FROM (SELECT DISTINCT facet, value FROM long) d QUALIFY p <= 80) SELECT d.facet, d.value, coalesce(n, 0) AS n FROM dom d LEFT JOIN (SELECT facet, lower(value) AS low, count(*) AS n FROM long WHERE photo_id IN (SELECT photo_id FROM photos WHERE {_CHOSEN}) GROUP BY ALL) c ON d.facet = c.facet AND lower(d.value) = c.low")
def photo_facet_counts(photos: DataFrame) -> DataFrame:
    return photo_ops.facet_counts(photos, _FACETS, {"orientation": ["paysage"], "a_verifier": ["non"]})


@query("photos", oracle=f"WITH long AS ({_LONG}) SELECT facet, value, CAST(row_number() OVER (PARTITION BY facet ORDER BY value COLLATE fr, value) AS BIGINT) AS position FROM (SELECT DISTINCT facet, value FROM long) d QUALIFY position <= 80")
def photo_facet_domains(photos: DataFrame) -> DataFrame:
    return photo_ops.domains(photos, _FACETS)


@query("photos", "previews", oracle="SELECT count(*) AS photos, count(*) FILTER (a_verifier) AS to_verify, count(*) FILTER (coalesce(description, '') <> '') AS described, count(*) FILTER (vignette IN (SELECT path FROM previews)) AS with_thumbnail, count(DISTINCT nullif(type_image, '')) AS types FROM photos")
def photo_totals(photos: DataFrame, previews: DataFrame) -> DataFrame:
    return photo_ops.totals(photos, previews)


@query("exifs", oracle="""SELECT photo_id, CASE WHEN largeur > 1000 THEN 'paysage' WHEN largeur < 1000 THEN 'portrait' ELSE 'carré' END AS orientation, coalesce(nullif(original, ''), generic, '') AS date_photo, trim(concat_ws(' ', make, nullif(model, ''))) AS appareil,
 '' AS objectif, CAST(iso AS VARCHAR) AS iso, CASE WHEN num IS NULL THEN '' ELSE concat(num, '/', den) END AS ouverture, '' AS vitesse, CAST(iso / 10.0 AS VARCHAR) AS focale FROM exifs""")
def photo_metadata(exifs: DataFrame) -> DataFrame:
    """Photos with an EXIF table of texts, numbers, rationals, nulls and bytes."""
    as_variant = lambda c: F.expr(f"CAST({c} AS VARIANT)")
    tags = {"DateTimeOriginal": "original", "DateTime": "generic", "Make": "make", "Model": "model", "ISOSpeedRatings": "iso", "FNumber": "if(num IS NOT NULL, array(num, den), NULL)", "ExposureTime": "encode(make, 'utf-8')", "FocalLength": "iso / 10.0D"}
    table = F.map_filter(F.create_map(*(x for k, c in tags.items() for x in (F.lit(k), as_variant(c)))), lambda _, v: v.isNotNull())
    rows = exifs.select("photo_id", "largeur", "hauteur", table.alias("exif"))
    return photo_ops.shaped(rows, "exif").drop("largeur", "hauteur")


@query("photos", oracle="SELECT photo_id, CASE WHEN photo_id % 3 = 0 OR description = '' THEN 'new' ELSE description END AS description, coalesce(orientation, 'carré') AS orientation FROM photos WHERE photo_id % 3 = 0 OR true")
def photo_upsert(photos: DataFrame) -> DataFrame:
    """A listing of all photos meets stored records of two in three."""
    old = photos.where("photo_id % 3 <> 0").select("photo_id", "description", "orientation")
    new = photos.select("photo_id", F.lit("new").alias("description"), "orientation")
    return photo_ops.upserted(old, new, "photo_id", ["description"])


@query("photos", oracle="SELECT photo_id, CASE WHEN photo_id % 4 = 0 THEN 'again' ELSE description END AS description FROM photos")
def photo_rerun(photos: DataFrame) -> DataFrame:
    rows = photos.select("photo_id", "description")
    return photo_ops.replaced(rows, rows.where("photo_id % 4 = 0").withColumn("description", F.lit("again")), "photo_id")


@query("files", oracle="SELECT path, size, mtime FROM files WHERE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ('.mkv', '.mp4')")
def media_files(files: DataFrame) -> DataFrame:
    return photo_ops.media(files, [".mkv", ".mp4"])


@query("files", oracle="SELECT path, CASE WHEN mtime % 5 = 0 THEN 'added' WHEN mtime % 5 = 1 THEN 'removed' ELSE 'changed' END AS change FROM files WHERE mtime % 5 < 3")
def listing_changes(files: DataFrame) -> DataFrame:
    before = files.where("mtime % 5 <> 0")
    after = files.where("mtime % 5 <> 1").withColumn("size", F.when(F.col("mtime") % 5 == 2, F.col("size") + 1).otherwise(F.col("size")))
    return photo_ops.changes(before, after)


@query("files", oracle="SELECT path, concat(coalesce(nullif(lower(trim(regexp_replace(regexp_replace(strip_accents(regexp_replace(list_last(string_split(path, '/')), '\\.[^.]*$', '')), '[^\\x00-\\x7F]', '', 'g'), '[^a-zA-Z0-9]+', '-', 'g'), '-')), ''), 'photo'), '-', substr(sha1(path), 1, 8)) AS id FROM files")
def photo_ids(files: DataFrame) -> DataFrame:
    return files.select("path", photo_id(F.col("path")).alias("id"))


# attempts


@query("attempts", oracle="SELECT shot_id, attempt, score FROM (SELECT *, min(attempt) FILTER (score >= 4) OVER (PARTITION BY shot_id) AS stop FROM attempts) x WHERE stop IS NULL OR attempt <= stop QUALIFY row_number() OVER (PARTITION BY shot_id ORDER BY score DESC, nfields DESC, attempt) = 1")
def best_attempts(attempts: DataFrame) -> DataFrame:
    return validation.best_attempts(attempts, 4).select("shot_id", "attempt", "score")


@query("attempts", oracle="SELECT engine, count(*) AS answers, round(quantile_cont(seconds, 0.5), 6) AS median, list_sort(list(seconds))[CAST(floor((count(*) - 1) * 9 / 10.0) AS BIGINT) + 1] AS p90, round(count(*) * 3600 / sum(seconds), 4) AS per_hour FROM attempts GROUP BY engine")
def engine_timing(attempts: DataFrame) -> DataFrame:
    return validation.timing(attempts, "engine").select("engine", "answers", F.round("median", 6).alias("median"), "p90", F.round("per_hour", 4).alias("per_hour"))


_AGREED = "WITH one AS (SELECT shot_id, engine, first(echelle ORDER BY attempt, echelle) AS echelle, first(lieu ORDER BY attempt, lieu) AS lieu FROM attempts GROUP BY ALL) SELECT field, count(*) AS shots, round(100 * avg(CASE WHEN x = y THEN 1 ELSE 0 END), 1) AS percent FROM (SELECT unnest(['echelle', 'lieu']) AS field, unnest([a.echelle, a.lieu]) AS x, unnest([b.echelle, b.lieu]) AS y FROM one a JOIN one b ON a.shot_id = b.shot_id AND a.engine = 'a' AND b.engine = 'b') p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY field"


@query("attempts", oracle=_AGREED)
def engine_agreement(attempts: DataFrame) -> DataFrame:
    return validation.agreement(attempts, "a", "b", ["echelle", "lieu"])


@query("attempts", oracle=f"SELECT count(*) AS fields, round(avg(percent), 1) AS percent FROM ({_AGREED}) x")
def engine_agreement_mean(attempts: DataFrame) -> DataFrame:
    return validation.mean_agreement(validation.agreement(attempts, "a", "b", ["echelle", "lieu"]))


@query("shots", oracle="SELECT film_id, path, value, count(*) AS n FROM (SELECT film_id, 'echelle' AS path, echelle AS value FROM shots WHERE echelle NOT IN ('gros plan', 'plan moyen') UNION ALL SELECT film_id, 'certitude', certitude FROM shots WHERE certitude NOT IN ('sûr', 'probable')) x GROUP BY ALL")
def vocabulary_violations(shots: DataFrame) -> DataFrame:
    return validation.violations(shots, "film_id", {"echelle": ["gros plan", "plan moyen"], "certitude": ["sûr", "probable"]}).groupBy("film_id", "path", "value").agg(F.count("*").alias("n"))


_REPLY = {
    "type": "object",
    "required": ["lieu", "echelle", "certitude", "analyse"],
    "properties": {
        "lieu": {"type": "string"},
        "echelle": {"oneOf": [{"enum": ["gros plan", "plan large"]}, {"type": "array", "items": {"enum": ["gros plan", "plan large"]}}]},
        "certitude": {"enum": ["sûr", "douteux", None]},
        "analyse": {"type": "object", "properties": {
            "lumiere": {"type": "object", "properties": {"type": {"enum": ["naturelle", "artificielle"]}, "sources": {"type": "array", "items": {"anyOf": [{"enum": ["soleil", "lampe", 3]}, {"type": "array", "items": {"enum": ["feu"]}}]}}}},
            "sons": {"type": "array", "items": {"type": "object", "properties": {"genre": {"enum": ["voix", "musique"]}, "niveau": {"enum": [1, 2, 3]}}}},
        }},
    },
}
#: Leaves of each answer with their JSON types; what stands in lists is told from what they say about it.
_LEAVES = r"""parsed AS (SELECT shot_id, reply::JSON AS j FROM replies WHERE json_valid(reply)),
leaves AS (SELECT shot_id, substr(fullkey, 3) AS p, regexp_replace(substr(fullkey, 3), '\[\d+\]', '[]', 'g') AS g, type AS y, json_extract_string(j, fullkey) AS v, json_extract(j, fullkey) AS w FROM (SELECT p.shot_id, p.j, t.fullkey, t.type FROM parsed p, json_tree(p.j) t) x)"""


@query("replies", oracle=f"""WITH {_LEAVES}
SELECT shot_id, p AS path, CASE WHEN g = 'echelle' OR g LIKE '%sources[]' THEN 'aucune variante ne convient' ELSE 'hors vocabulaire' END AS reason FROM leaves l
WHERE g = 'echelle' AND y = 'ARRAY' AND EXISTS (SELECT 1 FROM leaves m WHERE m.shot_id = l.shot_id AND m.g = 'echelle[]' AND (m.y <> 'VARCHAR' OR m.v NOT IN ('gros plan', 'plan large')))
 OR g = 'certitude' AND NOT (y = 'NULL' OR y = 'VARCHAR' AND v IN ('sûr', 'douteux')) OR g = 'analyse.lumiere.type' AND (y <> 'VARCHAR' OR v NOT IN ('naturelle', 'artificielle'))
 OR g = 'analyse.lumiere.sources[]' AND y = 'ARRAY' AND EXISTS (SELECT 1 FROM leaves m WHERE m.shot_id = l.shot_id AND starts_with(m.p, l.p || '[') AND m.v <> 'feu') OR g = 'analyse.sons[].genre' AND (y <> 'VARCHAR' OR v NOT IN ('voix', 'musique')) OR g = 'analyse.sons[].niveau' AND NOT (y IN ('UBIGINT', 'DOUBLE') AND TRY_CAST(v AS DOUBLE) IN (1, 2, 3))""")
def reply_deviations(replies: DataFrame) -> DataFrame:
    """Deviations of nested answers; those that don't parse have none. A choice that has a list among its forms lets every
    scalar pass, as a list's entries are all that is looked at."""
    return validation.deviations(replies.select("shot_id", F.try_parse_json("reply").alias("answer")), ["shot_id"], "answer", _REPLY).drop("value")


@query("replies", oracle="SELECT shot_id, k AS missing FROM (SELECT shot_id, reply, unnest(['lieu', 'echelle', 'certitude', 'analyse']) AS k FROM replies WHERE json_valid(reply)) x WHERE json_type(reply) <> 'OBJECT' OR NOT json_exists(reply, '$.' || k)")
def reply_missing_keys(replies: DataFrame) -> DataFrame:
    return validation.missing_keys(replies.select("shot_id", F.try_parse_json("reply").alias("answer")), ["shot_id"], "answer", _REPLY)


@query("replies", oracle=f"""WITH {_LEAVES}
SELECT shot_id, p AS path, v AS value FROM leaves WHERE g = 'echelle[]' AND v NOT IN ('gros plan', 'plan large') OR g = 'certitude' AND NOT (y = 'NULL' OR y = 'VARCHAR' AND v IN ('sûr', 'douteux'))""")
def strict_deviations(replies: DataFrame) -> DataFrame:
    """Deviations from the schema without choices, where a scalar in the place of a list isn't looked at."""
    schema = validation.simplified({"type": "object", "properties": {k: _REPLY["properties"][k] for k in ("echelle", "certitude")}})
    found = validation.deviations(replies.select("shot_id", F.try_parse_json("reply").alias("answer")), ["shot_id"], "answer", schema)
    return found.select("shot_id", "path", F.regexp_replace("value", '^"|"$', "").alias("value"))


@query("attempts", oracle="SELECT shot_id, attempt, round(sum(seconds) OVER (PARTITION BY shot_id ORDER BY attempt, seconds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS spent FROM attempts")
def running_times(attempts: DataFrame) -> DataFrame:
    return validation.running_time(attempts.withColumnRenamed("attempt", "run"), "shot_id").select("shot_id", F.col("run").alias("attempt"), "spent")


# claims and records


_NAMED = "c AS (SELECT c.*, coalesce(n.name, CAST(c.value_id AS VARCHAR)) AS name FROM claims c LEFT JOIN (SELECT value_id, coalesce(min(label) FILTER (lang = 'fr' AND label <> ''), min(label) FILTER (lang = 'en' AND label <> '')) AS name FROM names GROUP BY value_id) n ON c.value_id = n.value_id)"
_FILLED = ", ".join(f"coalesce((list(name ORDER BY pos, value_id) FILTER (prop = '{p}'))[1], '') AS {f}" if f in records.SINGLE else f"coalesce(array_to_string((list(name ORDER BY pos, value_id) FILTER (prop = '{p}'))[1:{records.LONG_LISTS.get(f, 1000)}], ','), '') AS {f}" for f, p in records.PROPERTIES.items() if f != records.DATE)


@query("claims", "names", oracle=f"WITH {_NAMED} SELECT entity, {_FILLED}, coalesce(min(value_time) FILTER (prop = 'P577'), '') AS date_sortie, CAST(substr(min(value_time) FILTER (prop = 'P577'), 1, 4) AS INT) AS annee FROM c GROUP BY entity")
def claim_columns(claims: DataFrame, names: DataFrame) -> DataFrame:
    """All thirteen properties by name; lists as texts."""
    rows = records.pivoted(claims, names)
    return rows.withColumns({f: F.array_join(f, ",") for f in records.PROPERTIES if f not in (*records.SINGLE, records.DATE)})


@query("films", "claims", oracle="SELECT titre AS title, entity FROM (SELECT f.titre, c.entity, row_number() OVER (PARTITION BY f.titre ORDER BY c.prop, c.pos, c.entity) AS r FROM films f JOIN claims c ON c.entity % 1000 = f.number WHERE (c.prop = 'P58' OR c.value_time LIKE '%-05-%') AND abs(f.annee - 1950 - c.value_id % 50) <= 1) x WHERE r = 1")
def resolved_entities(films: DataFrame, claims: DataFrame) -> DataFrame:
    wanted = films.select(F.col("titre").alias("title"), F.col("annee").alias("year"), F.col("number").alias("k"))
    found = claims.select((F.col("entity") % 1000).alias("k"), F.col("prop").alias("attempt"), F.col("pos").alias("rank"), "entity", (F.col("prop") == "P58").alias("is_film"), F.when(F.col("value_time").like("%-05-%"), "a film").alias("description"), (1950 + F.col("value_id") % 50).alias("found_year"))
    return records.resolved(wanted.drop("k"), found.join(wanted.select("k", "title"), "k").drop("k"))


@query("films", oracle="SELECT film_id, coalesce(nullif(pays, ''), 'inconnu') AS pays, coalesce(pitch, 'sans') AS pitch, CASE annee % 3 WHEN 0 THEN 'b|a' WHEN 1 THEN 'b|c|a' ELSE 'a' END AS sources, substr(CASE annee % 4 WHEN 0 THEN 'Vu à Paris.' WHEN 1 THEN 'Déjà noté : Crédits complétés. Et plus.' WHEN 2 THEN 'Vu à Paris. Crédits complétés.' ELSE 'Crédits complétés.' END, 1, 20) AS notes FROM films")
def merged_records(films: DataFrame) -> DataFrame:
    """Records that lack some fields, have sources and notes in part, and new ones that fill them."""
    old = films.select("film_id", "pays", "pitch", F.expr("CASE annee % 3 WHEN 0 THEN array('b') WHEN 1 THEN array('b', 'c') END AS sources"), F.expr("CASE annee % 4 WHEN 0 THEN 'Vu à Paris.' WHEN 1 THEN 'Déjà noté : Crédits complétés. Et plus.' WHEN 2 THEN 'Vu à Paris.' END AS notes"))
    new = films.select("film_id", F.lit("inconnu").alias("pays"), F.lit("sans").alias("pitch"), F.expr("CASE annee % 3 WHEN 0 THEN array('a', 'b') ELSE array('a') END AS sources"), F.when(F.col("annee") % 4 > 0, "Crédits complétés.").otherwise("").alias("notes"))
    return records.merged(old, new, "film_id", ["pays", "pitch"], longest_notes=20).withColumn("sources", F.array_join("sources", "|"))


@query("films", oracle="SELECT film_id, CASE WHEN annee % 2 = 0 THEN '' ELSE coalesce(pays, '') END AS pays FROM films")
def forced_records(films: DataFrame) -> DataFrame:
    return records.forced(films.select("film_id", "pays"), films.where("annee % 2 = 0").select("film_id", F.lit("").alias("pays")), "film_id", ["pays"])


@query("films", oracle="SELECT film_id, CASE WHEN annee % 3 = 0 THEN 'created' WHEN annee % 3 = 1 THEN 'updated' ELSE 'unchanged' END AS change FROM films")
def record_changes(films: DataFrame) -> DataFrame:
    old = films.where("annee % 3 <> 0").withColumn("titre", F.when(F.col("annee") % 3 == 1, "old").otherwise(F.col("titre")))
    return records.synchronised(old, films, "film_id")


@query("films", oracle="SELECT film_id, CASE WHEN annee % 2 = 0 THEN '' ELSE titre END AS titre, coalesce(pays, '') AS pays FROM films")
def overlaid_records(films: DataFrame) -> DataFrame:
    overlay = films.where("annee % 2 = 0").select("film_id", F.create_map(F.lit("titre"), F.lit("")).alias("values"))
    return records.overlaid(films.select("film_id", "titre", F.coalesce("pays", F.lit("")).alias("pays")), overlay, "film_id", ["titre", "pays"])


# texts


@query("documents", oracle="SELECT doc_id, " + _FOLD.format("text") + " AS folded FROM documents")
def folded_texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", fold(F.col("text")).alias("folded"))


@query("documents", oracle="SELECT doc_id, lower(trim(regexp_replace(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g'))) AS folded FROM documents")
def folded_with_signs(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", fold_keeping_signs(F.col("text")).alias("folded"))


@query("documents", oracle="SELECT doc_id, CASE WHEN length(t) <= 230 THEN t ELSE concat(regexp_replace(regexp_replace(substr(t, 1, 230), ' [^ ]*$', ''), '[ .,;:]+$', ''), '…') END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) x")
def shortened_texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", shorten(F.col("text"), 230).alias("short"))


@query("documents", oracle="SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9]+'))) AS BIGINT) AS n FROM documents")
def distinct_tokens(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n"))


@query("pages", oracle="SELECT page_id, lower(trim(regexp_replace(url, '[^a-zA-Z0-9]+', '-', 'g'), '-')) AS slug FROM pages")
def page_slugs(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", slug(F.col("url")).alias("slug"))


_EN = ", ".join(f"'{w}'" for w in "the and with from into after before while about their there where which that this these those his her its film story crew mission planet space american directed written starring returns discovers becomes".split())
_FR = ", ".join(f"'{w}'" for w in "le la les des une un dans avec pour par sur film histoire mission équipage planète espace américain réalisé écrit mettant retourne découvre devient alors après avant pendant qui que dont son sa ses".split())


@query("documents", oracle=f"SELECT doc_id, (en >= 2 AND en >= fr + 1) OR (fr = 0 AND en >= 1 AND n > 12) AS english FROM (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x IN ({_EN}))) AS en, len(list_filter(w, lambda x: x IN ({_FR}))) AS fr FROM (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[a-z'']+') AS w FROM documents) a) b")
def english_texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", looks_english(F.col("text")).alias("english"))


@query("documents", oracle="SELECT id, line_no, kind FROM (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(len(string_split(text, chr(10))))) AS BIGINT) AS line_no FROM documents) x, (VALUES ('mail', '[a-z0-9.]+@[a-z0-9.-]+\\.[a-z]+'), ('key', '(?i)(api|secret|token)[_ -]?key')) p(kind, r) WHERE regexp_matches(line, r)")
def sensitive_lines(documents: DataFrame) -> DataFrame:
    return sources.sensitive_lines(documents.withColumnRenamed("doc_id", "id"), {"mail": r"[a-z0-9.]+@[a-z0-9.-]+\.[a-z]+", "key": "(?i)(api|secret|token)[_ -]?key"})


@query("pages", oracle="SELECT page_id, CASE WHEN length(t) <= 700 THEN t ELSE concat(regexp_replace(regexp_replace(substr(t, 1, 700), ' [^ ]*$', ''), '[ .,;:]+$', ''), '…') END AS text FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<ref[^>/]*/>|<ref[^>]*>.*?</ref>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|\\{\\|.*?\\|\\}', ' ', 'g'), '\\{\\{[^{}]*\\}\\}', ' ', 'g'), '(?i)\\[\\[(?:file|image|fichier):[^\\[\\]]*\\]\\]', ' ', 'g'), '\\[\\[(?:[^\\[\\]|]*\\|)?([^\\[\\]]*)\\]\\]', '\\1', 'g'), '\\[https?://\\S+ ?([^\\]]*)\\]', '\\1', 'g'), '''{2,}|(?m)^=+.*?=+$|(?m)^[*#:;]+', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS t FROM pages) x")
def page_texts(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", sources.plain_text(F.col("html"), 700).alias("text"))


@query("shots", oracle="SELECT film_id, CAST(row_number() OVER (ORDER BY film_id) AS BIGINT) AS rank, count(*) OVER () AS total FROM (SELECT DISTINCT film_id FROM shots) x")
def film_positions(shots: DataFrame) -> DataFrame:
    return sources.positions(shots, "film_id")
