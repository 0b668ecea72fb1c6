"""The catalogue's tables derived from the star-schema test tables; each statement runs in Spark SQL and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

ADAPTERS = {
    # a film is a part of a source, so that films are many and bounded however large the tables are
    "shots": """SELECT film_id, n, fin - duree AS debut, fin, duree, description, lang, certitude, echelle, lieu, machine, interface, mots_cles, modele, generique, texte_role, lieu_decors, objets_cles, personnages_sujets, machine_types, vignettes, vignette
FROM (SELECT d.film_id, CAST(row_number() OVER (PARTITION BY d.film_id ORDER BY d.doc_id) AS BIGINT) AS n,
  CAST(1 + d.n_chars % 40 AS DOUBLE) AS duree,
  CAST(sum(1 + d.n_chars % 40) OVER (PARTITION BY d.film_id ORDER BY d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS fin,
  CASE WHEN d.doc_id % 17 = 0 THEN '' ELSE d.text END AS description, d.lang,
  CASE WHEN l.quality = 1 THEN 'sûr' WHEN l.quality = 0 THEN 'probable' WHEN d.doc_id % 3 = 0 THEN 'douteux' ELSE NULL END AS certitude,
  CASE d.doc_id % 5 WHEN 0 THEN 'gros plan' WHEN 1 THEN 'plan moyen' WHEN 2 THEN 'plan large' WHEN 3 THEN '' ELSE NULL END AS echelle,
  CASE WHEN d.doc_id % 7 = 0 THEN NULL WHEN d.doc_id % 2 = 0 THEN 'intérieur' ELSE 'extérieur' END AS lieu,
  d.doc_id % 4 = 0 AS machine, CASE WHEN d.doc_id % 8 = 0 THEN 'hologramme' ELSE '' END AS interface,
  substr(d.text, 1, 40) AS mots_cles, concat('model-', CAST(d.doc_id % 3 AS VARCHAR(9))) AS modele,
  d.doc_id % 41 = 0 AS generique, CASE WHEN d.doc_id % 41 = 0 THEN 'carton de fin' ELSE '' END AS texte_role,
  CASE CAST((d.doc_id - d.doc_id % 20) / 20 AS BIGINT) % 6 WHEN 0 THEN 'Intérieur' WHEN 1 THEN 'rue' WHEN 2 THEN 'Rue' WHEN 3 THEN 'indéterminé' ELSE substr(d.text, 60, 12) END AS lieu_decors,
  CASE CAST((d.doc_id - d.doc_id % 20) / 20 AS BIGINT) % 7 WHEN 0 THEN 'aucun' WHEN 1 THEN 'Tension' WHEN 2 THEN 'lampe' WHEN 3 THEN 'Lampe !' WHEN 4 THEN ' voiture' ELSE substr(d.text, 90, 9) END AS objets_cles,
  CASE CAST((d.doc_id - d.doc_id % 20) / 20 AS BIGINT) % 5 WHEN 0 THEN 'Un homme' WHEN 1 THEN 'une foule' WHEN 2 THEN 'Un Homme' WHEN 3 THEN '' ELSE d.lang END AS personnages_sujets,
  CASE WHEN d.doc_id % 4 > 0 THEN NULL WHEN d.doc_id % 3 = 0 THEN '' WHEN d.doc_id % 9 = 1 THEN 'Écran' WHEN d.doc_id % 9 = 2 THEN 'ecran' WHEN d.doc_id % 9 = 4 THEN 'Aucune' ELSE 'tableau de bord' END AS machine_types,
  concat('t/', CAST(d.doc_id AS VARCHAR(19)), '-1.jpg|t/', CAST(d.doc_id AS VARCHAR(19)), '-2.jpg|t/', CAST(d.doc_id AS VARCHAR(19)), '-3.jpg') AS vignettes, concat('m/', CAST(d.doc_id AS VARCHAR(19)), '.jpg') AS vignette
  FROM (SELECT *, concat(source, '-', CAST(CAST((doc_id - doc_id % 2000) / 2000 AS BIGINT) AS VARCHAR(19))) AS film_id FROM documents) d LEFT JOIN labels l ON d.doc_id = l.doc_id) s""",
    # how far the shots of a film have come; a film's remainder by eight says what is lacking: nothing, a few shots, a few
    # shots and a thumbnail, a few shots that weren't tried, some shots, a third of the shots
    "states": """SELECT concat('f', CAST(film AS VARCHAR(19))) AS film_id, n, CASE WHEN lacking AND k % 2 = 0 THEN '' ELSE 'told' END AS description, CASE WHEN lacking AND k % 2 = 1 THEN NULL ELSE 'plan large' END AS echelle, 'rue' AS lieu,
  CASE WHEN lacking OR r = 6 THEN '' ELSE l_returnflag END AS mots_cles, CASE WHEN r = 3 AND lacking THEN ' ' WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN '' ELSE concat('model-', CAST(k % 4 AS VARCHAR(9))) END AS modele,
  CASE WHEN r = 3 AND lacking THEN '' WHEN k % 3 = 0 THEN concat(' model-', CAST(l_suppkey % 2 AS VARCHAR(9))) ELSE NULL END AS modele_analyse, CASE WHEN k % 3 = 1 AND l_suppkey % 2 = 0 AND r <> 3 THEN '2026-01-02' ELSE '' END AS analyse_mesuree_le,
  CASE WHEN k % 3 = 1 AND l_suppkey % 2 = 1 AND r <> 3 THEN CAST(0 AS DOUBLE) ELSE NULL END AS temps_analyse_secondes, CASE WHEN r = 2 AND k % 211 = 7 THEN '' ELSE 'm.jpg' END AS vignette, CASE WHEN r = 4 AND k % 97 = 5 THEN 'a| |c' WHEN r = 5 AND k % 50 = 6 THEN 'a|b' ELSE 'a|b|c' END AS vignettes,
  k % 4 = 0 AS machine, CASE WHEN l_suppkey % 3 = 0 THEN TRUE WHEN l_suppkey % 3 = 1 THEN FALSE ELSE NULL END AS dialogue, CASE WHEN l_suppkey % 7 = 1 THEN 'bonjour' WHEN l_suppkey % 7 = 2 THEN ' ' ELSE NULL END AS dialogue_texte, CASE l_suppkey % 5 WHEN 0 THEN 'whisper' WHEN 1 THEN ' sous-titres ' WHEN 2 THEN concat('piste ', CAST(film % 3 AS VARCHAR(9))) ELSE '' END AS dialogue_source,
  l_suppkey % 11 = 0 AS musique_presente, CASE WHEN l_suppkey % 13 = 0 THEN 'heard' ELSE NULL END AS audio_detaille, l_suppkey % 26 = 0 AS audio_erreur, CASE WHEN l_suppkey % 17 = 0 THEN 'seq_00001_00002' ELSE '' END AS audio_global_ref, CASE WHEN k % 10 = 3 THEN 'refined' ELSE NULL END AS affinage, k % 20 = 3 AS affinage_erreur,
  CASE l_suppkey % 6 WHEN 0 THEN 'fixe' WHEN 1 THEN 'zoom in' WHEN 2 THEN 'tilt haut' WHEN 3 THEN '' ELSE NULL END AS mouvement_camera, CASE l_partkey % 9 WHEN 0 THEN 'fixe' WHEN 1 THEN 'zoom out' WHEN 2 THEN 'panoramique gauche' WHEN 3 THEN ' caméra portée' WHEN 4 THEN 'mouvement complexe' ELSE NULL END AS mouvement_camera_final,
  CASE l_partkey % 5 WHEN 0 THEN 'sûr' WHEN 1 THEN 'probable' WHEN 2 THEN 'douteux' ELSE '' END AS mouvement_confiance, CASE WHEN l_partkey % 14 = 0 THEN TRUE ELSE NULL END AS mouvement_camera_conflit, CASE l_partkey % 7 WHEN 0 THEN 'fixe' WHEN 1 THEN 'zoom in' WHEN 2 THEN 'travelling' ELSE '' END AS mouvement_video_camera,
  CASE WHEN l_partkey % 7 < 3 THEN concat('video-', CAST(l_suppkey % 2 AS VARCHAR(9))) ELSE NULL END AS mouvement_video_modele, l_quantity AS duree
FROM (SELECT *, CASE WHEN r = 0 OR r = 6 THEN FALSE WHEN r <= 4 THEN k % 211 = 3 WHEN r = 5 THEN k % 50 = 3 ELSE k % 3 = 0 END AS lacking FROM (SELECT *, film % 8 AS r, l_partkey + l_linenumber * 31 + l_orderkey * 7 AS k FROM (SELECT *, CAST((l_orderkey - l_orderkey % 100) / 100 AS BIGINT) AS film, l_orderkey * 8 + l_linenumber AS n FROM lineitem) a) b) c""",
    "cards": """SELECT concat('f', CAST(CAST(s_suppkey AS BIGINT) * 2 AS VARCHAR(19))) AS film_id, CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 3 = 1 THEN NULL ELSE s_name END AS pitch, CASE WHEN s_suppkey % 2 = 0 THEN 'synopsis' ELSE '' END AS synopsis, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'scenario' END AS scenario,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_nationkey END AS scenes, CAST(s_suppkey % 6 AS BIGINT) AS personnages_recurrents, CASE WHEN s_suppkey % 4 = 1 THEN ' model-x ' ELSE NULL END AS modele, CASE WHEN s_suppkey % 6 = 1 THEN 'sous-titres intégrés' ELSE '' END AS dialogue_source, CASE WHEN s_suppkey % 5 = 2 THEN NULL ELSE s_suppkey % 5 END AS sequences,
  s_suppkey % 9 = 4 AS illisible FROM supplier""",
    "replies": """SELECT shot_id, CASE WHEN k % 13 = 5 THEN 'broken {' WHEN k % 17 = 3 THEN '"no object"' WHEN k % 19 = 4 THEN 'null' ELSE concat('{"lieu": "', p_brand, '"', CASE k % 6 WHEN 0 THEN ', "echelle": "gros plan"' WHEN 1 THEN ', "echelle": ["gros plan", "plan large"]' WHEN 2 THEN ', "echelle": ["gros plan", "flou"]' WHEN 3 THEN ', "echelle": "flou"' WHEN 4 THEN ', "echelle": null' ELSE '' END,
  CASE k % 5 WHEN 0 THEN ', "certitude": "sûr"' WHEN 1 THEN ', "certitude": null' WHEN 2 THEN ', "certitude": "moyen"' WHEN 3 THEN ', "certitude": true' ELSE '' END, CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN ', "analyse": "rien"' ELSE concat(', "analyse": {"lumiere": {"type": "', CASE WHEN p_size % 3 = 0 THEN 'naturelle' ELSE p_type END, '", "sources": ["soleil", ', CASE p_size % 5 WHEN 0 THEN '"lampe"' WHEN 1 THEN '3' WHEN 2 THEN '3.0' WHEN 3 THEN '4' ELSE '"3"' END, CASE WHEN p_size % 2 = 0 THEN ', ["feu"]]}, "sons": [' ELSE ', ["eau", "feu"]]}, "sons": [' END,
  CASE p_size % 7 WHEN 0 THEN '' WHEN 1 THEN '{"genre": "voix"}' WHEN 2 THEN '{"genre": "bruit", "niveau": 2}, {"genre": "voix", "niveau": 9}' WHEN 3 THEN '"voix"' ELSE concat('{"genre": "', lower(p_name), '", "niveau": null}') END, ']}') END, '}') END AS reply FROM (SELECT p_partkey AS shot_id, p_partkey + p_size AS k, * FROM part) x""",
    "films": """SELECT concat('src', CAST(s_suppkey % 20 AS VARCHAR(9)), '-', CAST(CAST((s_suppkey - s_suppkey % 20) / 20 AS BIGINT) AS VARCHAR(19))) AS film_id, CAST(s_suppkey AS BIGINT) AS number, s_name AS titre, CAST(1950 + s_suppkey % 50 AS INT) AS annee,
  CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE n_name END AS pays, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE r_name END AS pitch
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "segments": """SELECT film_id, CAST(6 * k AS DOUBLE) + 0.5 AS debut, CAST(6 * k + 1 + length(text) % 9 AS DOUBLE) + 0.5 AS fin, text AS texte
FROM (SELECT film_id, row_number() OVER (PARTITION BY film_id ORDER BY conv_id, turn) AS k, text FROM (SELECT *, concat('src', CAST(conv_id % 20 AS VARCHAR(9)), '-', CAST(CAST((conv_id - conv_id % 2000) / 2000 AS BIGINT) AS VARCHAR(19))) AS film_id FROM conversations) v) c""",
    "pairs": """SELECT l_orderkey AS shot_id, l_linenumber AS pair, (l_discount - 0.05) / 5 AS dx, (l_tax - 0.04) / 5 AS dy, (l_quantity - 25) / 1500 AS scale_delta,
  (CAST(l_partkey % 21 AS DOUBLE) - 10) / 10 AS rotation, CAST(l_suppkey % 16 AS DOUBLE) / 1000 AS jitter, CAST(l_partkey % 10 AS DOUBLE) / 10 AS inliers FROM lineitem""",
    "vlabels": """SELECT user_id AS shot_id, CAST(event_id % 3 AS BIGINT) AS segment, CASE event_type WHEN 'click' THEN 'pan_left' WHEN 'view' THEN 'static' WHEN 'error' THEN 'shake' WHEN 'signup' THEN 'zoom_in' ELSE 'undefined' END AS label,
  least(CAST(1 AS DOUBLE), value / 100) AS score FROM events""",
    "frames": "SELECT user_id AS film_id, CAST(event_id AS DOUBLE) * 1.5 AS t, least(CAST(1 AS DOUBLE), value / 60) AS score FROM events",
    "faces": "SELECT CAST((vec_id - vec_id % 300) / 300 AS BIGINT) AS film_id, vec_id AS n, label, embedding FROM embeddings",
    "persons": """SELECT CAST((vec_id - vec_id % 300) / 300 AS BIGINT) AS film_id, vec_id AS n, CASE WHEN vec_id % 11 = 0 THEN '' ELSE concat('scene_00', CAST(vec_id % 5 AS VARCHAR(9))) END AS scene_id, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE concat('m/', CAST(vec_id AS VARCHAR(19)), '.jpg') END AS image, vec_id % 7 <> 3 AS persons,
  CASE vec_id % 5 WHEN 0 THEN 'Homme|Femme' WHEN 1 THEN 'femme|homme' WHEN 2 THEN 'genre indéterminé' WHEN 3 THEN 'femme' ELSE '' END AS genders, CASE vec_id % 4 WHEN 0 THEN 'âge indéterminé' WHEN 1 THEN 'Adulte' ELSE '' END AS ages, CASE vec_id % 6 WHEN 0 THEN 'aucun|cavalier' WHEN 1 THEN 'roi|Reine|x' ELSE '' END AS subjects, CASE vec_id % 8 WHEN 0 THEN 'souriant' ELSE 'ah' END AS attitudes FROM embeddings""",
    "photos": """SELECT p_partkey AS photo_id, p_name AS titre, p_type AS type_image, concat(CASE p_size % 6 WHEN 0 THEN 'état ' WHEN 1 THEN 'Etat ' WHEN 2 THEN 'zoo ' WHEN 3 THEN 'œuvre ' WHEN 4 THEN 'Île ' ELSE '' END, p_brand) AS lieu, p_size % 3 = 0 AS a_verifier, CASE WHEN p_size % 4 = 0 THEN '' ELSE concat('v/', CAST(p_partkey AS VARCHAR(19)), '.jpg') END AS vignette,
  CASE WHEN p_size % 5 = 0 THEN '' ELSE lower(p_name) END AS description, CASE WHEN p_size % 2 = 0 THEN 'paysage' ELSE 'portrait' END AS orientation FROM part""",
    "previews": "SELECT concat('v/', CAST(p_partkey AS VARCHAR(19)), '.jpg') AS path FROM part WHERE p_partkey % 3 > 0",
    "exifs": """SELECT p_partkey AS photo_id, CAST(p_size * 40 AS BIGINT) AS largeur, CAST(1000 AS BIGINT) AS hauteur, CASE WHEN p_size % 3 = 0 THEN '2019:05:06 07:08:09' WHEN p_size % 3 = 1 THEN '' ELSE NULL END AS original, CASE WHEN p_size % 4 = 0 THEN NULL ELSE '2020:01:02 03:04:05' END AS generic,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS make, CASE WHEN p_size % 7 = 0 THEN '' ELSE concat(' ', p_type, ' ') END AS model, p_size AS iso, CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_partkey % 8 + 1 END AS num, 10 AS den FROM part""",
    "files": """SELECT concat('lib/', CAST(p_partkey % 7 AS VARCHAR(9)), '/', replace(p_name, ' ', '_'), '-', CAST(p_partkey AS VARCHAR(9)), CASE WHEN p_size % 4 = 0 THEN '.MKV' WHEN p_size % 4 = 1 THEN '.jpg' WHEN p_size % 4 = 2 THEN '.mp4' ELSE '.txt' END) AS path,
  CAST(p_size * 1000 AS BIGINT) AS size, CAST(1700000000 + p_partkey AS BIGINT) AS mtime FROM part""",
    "attempts": """SELECT l_orderkey AS shot_id, l_linenumber AS attempt, CASE WHEN l_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS engine, l_quantity / 10 AS seconds, CAST(l_partkey % 5 AS BIGINT) AS score, CAST(l_suppkey % 7 AS BIGINT) AS nfields,
  l_returnflag AS echelle, l_linestatus AS lieu FROM lineitem""",
    "answers": """SELECT p_partkey AS shot_id, p_partkey % 2 = 0 AS musique_presente, CASE p_partkey % 9 WHEN 0 THEN 'Dolby 5.1 track' WHEN 4 THEN p_name WHEN 5 THEN p_name WHEN 6 THEN NULL ELSE '' END AS titre_morceau,
  CASE WHEN p_partkey % 9 = 4 THEN p_brand ELSE '' END AS artiste_morceau, '' AS auteur_morceau, CASE WHEN p_partkey % 9 = 5 THEN 'analyse spectrale locale' WHEN p_partkey % 9 = 4 THEN 'métadonnées locales' ELSE '' END AS identification_methode,
  '' AS identification_confiance, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 3 = 1 END AS a_verifier,
  CASE p_partkey % 9 WHEN 1 THEN concat('On entend « ', p_name, ' » de ', p_brand, '.') WHEN 2 THEN concat('song: ', p_type, ' by ', p_name) ELSE 'rien' END AS dialogue,
  CASE p_partkey % 9 WHEN 3 THEN p_name WHEN 7 THEN 'x265 remux' WHEN 5 THEN p_brand ELSE '' END AS tag_title, p_brand AS tag_artist, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS tag_composer,
  CASE WHEN p_partkey % 9 = 8 THEN concat(' ', p_name) ELSE '' END AS print_title, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END AS print_artist, CASE WHEN p_size % 4 = 0 THEN p_type ELSE '' END AS print_author FROM part""",
    "wikis": """SELECT doc_id AS page_id, doc_id % 4 AS k, source, lang, CAST(n_chars AS VARCHAR(19)) AS len, concat(CASE doc_id % 4 WHEN 3 THEN '' ELSE concat('{{Short description|', lang, '}}', chr(10), '{{Infobox film', chr(10), '| name = Film ', source, chr(10), '| Running time = {{duration|m=', CAST(n_chars AS VARCHAR(19)), '}}', chr(10),
  '| starring = {{Plainlist|', chr(10), '* [[Ann ', source, ']]', chr(10), '| x = y', chr(10), '}}', chr(10), '| image = [[File:Poster_', CAST(doc_id AS VARCHAR(19)), '.jpg|thumb]]', chr(10), '| caption = Poster of ', chr(39), chr(39), source, chr(39), chr(39), '<!-- no -->', chr(10), CASE doc_id % 4 WHEN 2 THEN '' ELSE concat('}}', chr(10)) END) END,
  CASE doc_id % 4 WHEN 2 THEN '' ELSE concat('The film ', source, ' has [[', lang, '|', CAST(n_chars AS VARCHAR(19)), ' signs]].<ref>x</ref>', chr(10), chr(10), 'Second.', chr(10), chr(10)) END, '== Cast ==', chr(10), 'Ann', chr(10), CASE doc_id % 2 WHEN 0 THEN '== Plot ==' ELSE '===Synopsis===' END, chr(10), 'It is about ', source, ' &amp; ', lang, '.', chr(10), '== Notes ==', chr(10), 'None') AS body FROM documents""",
    "stills": """SELECT concat('t/', CAST(doc_id AS VARCHAR(19)), '-1.jpg') AS path FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT concat('t/', CAST(doc_id AS VARCHAR(19)), '-2.jpg') FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT concat('t/', CAST(doc_id AS VARCHAR(19)), '-3.jpg') FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT concat('m/', CAST(doc_id AS VARCHAR(19)), '.jpg') FROM documents WHERE doc_id % 7 <> 0""",
    "captions": """SELECT doc_id, n_chars % 5 + 1 AS k, CASE WHEN doc_id % 7 = 0 THEN CAST(n_chars % 4 AS INT) ELSE NULL END AS personnages, CASE WHEN doc_id % 13 = 0 THEN lang ELSE '' END AS personnages_sujets,
  CASE doc_id % 6 WHEN 0 THEN concat(CAST(n_chars % 5 + 1 AS VARCHAR(9)), ' femmes et hommes dans la rue') WHEN 1 THEN concat(CASE n_chars % 3 WHEN 0 THEN 'Trois' WHEN 1 THEN 'Deux' ELSE 'Un' END, ' enfants, une fillette') WHEN 2 THEN 'Foule : personne âgée, silhouettes'
  WHEN 3 THEN concat('Un ', CASE n_chars % 3 WHEN 0 THEN 'chien' WHEN 1 THEN 'vieux cheval' ELSE 'rat' END, ' court') WHEN 4 THEN 'Rue vide, hommes-grenouilles absents' ELSE concat('Genres mixtes, ', CAST(n_chars % 5 + 1 AS VARCHAR(9)), ' adolescents') END AS description FROM documents""",
    "names": """SELECT CAST(s_suppkey AS BIGINT) AS value_id, 'en' AS lang, s_name AS label FROM supplier WHERE s_suppkey % 3 > 0 UNION ALL SELECT CAST(s_suppkey AS BIGINT), 'fr', CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE concat('Nom ', CAST(s_suppkey AS VARCHAR(19))) END FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT CAST(s_suppkey AS BIGINT), 'de', 'Name' FROM supplier""",
    "claims": """SELECT l_orderkey AS entity, CASE l_partkey % 13 WHEN 0 THEN 'P57' WHEN 1 THEN 'P58' WHEN 2 THEN 'P161' WHEN 3 THEN 'P162' WHEN 4 THEN 'P344' WHEN 5 THEN 'P2554' WHEN 6 THEN 'P1040' WHEN 7 THEN 'P86' WHEN 8 THEN 'P2515' WHEN 9 THEN 'P272' WHEN 10 THEN 'P495' WHEN 11 THEN 'P136' ELSE 'P577' END AS prop, l_linenumber AS pos, CAST(l_suppkey AS BIGINT) AS value_id, substr(CAST(l_shipdate AS VARCHAR(30)), 1, 10) AS value_time FROM lineitem""",
}

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def adapted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the catalogue's tables over the test tables in sf_dir."""
    sql = ADAPTERS.get(name)
    if sql is None:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for t in TABLES:
        if f" {t}" in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def _with(given: str, sql: str) -> str:
    """SQL whose first common tables are the given ones."""
    for head in ("WITH RECURSIVE ", "WITH "):
        if given and sql.startswith(head):
            return f"{head}{given}, {sql.removeprefix(head)}"
    return f"WITH {given} {sql}" if given else sql


def query(*tables: str, oracle: str | None = None):
    """Registers a function of the named tables under its own name; the oracle SQL reads them by the same names."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(adapted(spark, sf_dir, t) for t in tables))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if oracle is not None:
            given = ", ".join(f"{t} AS ({ADAPTERS[t]})" for t in tables if t in ADAPTERS)
            ORACLES[f.__name__] = _with(given, oracle.lstrip())
        return run

    return register
