"""Registered queries of the wide and the compact shot rows, over nested shots that are written as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.operators import columns, publish
from reelframe.sources.tables import folder, hold

from .adapters import query


def _nested(shots: DataFrame) -> DataFrame:
    """Shots with the nested fields of film documents: some fields always there, some now and then, most never."""
    return hold(shots.selectExpr(
        "film_id", "n", "debut", "fin", "duree", "concat('tc ', n) AS tc", "vignette", "split(vignettes, '[|]') AS vignettes", "n % 3 = 0 AS dialogue", "CASE WHEN n % 3 = 0 THEN '- Oui ? - Non ?' ELSE '' END AS dialogue_texte",
        "CASE WHEN n % 2 = 0 THEN ' Transcription Whisper ' END AS dialogue_source", "CASE WHEN n % 3 = 0 THEN array(map('texte', 'Oui ?'), map('texte', 'Non ?')) END AS dialogues", "CASE WHEN n % 4 = 0 THEN 'scene_009' ELSE '' END AS scene_id",
        "named_struct('scene_id', 'scene_001', 'numero_scene', 1L, 'titre', concat('Scène ', film_id), 'a_verifier', n % 5 = 0, 'motifs_structurants', array('feu', lang)) AS scene",
        "CASE WHEN n % 6 = 0 THEN 'fixe' END AS mouvement_camera", "CASE WHEN n % 6 = 1 THEN 'zoom in' ELSE '' END AS mouvement_video_camera", "CASE WHEN n % 6 = 2 THEN 'tilt haut' ELSE '' END AS mouvement_camera_final", "n % 6 = 0 AS mouvement_camera_conflit",
        "CASE WHEN n % 5 = 0 THEN array(map('personnage_id', 'personnage_001', 'label', 'Visage', 'profil_resume', lang), map('label', 'Profil')) END AS personnages_recurrents", "CASE WHEN n % 7 = 0 THEN array(map('nom', 'Ann'), map('nom', ''), map('role', 'x')) END AS personnes_reconnues",
        "CASE WHEN n % 3 = 1 THEN NULL ELSE named_struct('personnes_visibles', n % 2 = 0, 'nombre_personnes', CASE WHEN n % 3 = 0 THEN 4L END, 'genres_personnes', CASE WHEN n % 3 = 0 THEN array('femme') END) END AS presences",
        "CASE WHEN n % 7 = 0 THEN map('modele', 'm2', 'raisons', '[\"a\",\"b\"]') END AS affinage", "array(n, n + 1) AS audio_global_plans", "debut + 1 AS audio_global_debut",
        "named_struct('machine', machine, 'types', array('écran'), 'interface', interface, 'certitude', certitude, 'echelle', echelle, 'lieu', lieu, 'description', CASE WHEN n % 9 > 0 THEN substr(description, 1, 20) ELSE '' END, 'note', 'note', 'mots_cles', array(lang), 'personnages', 2L, 'generique', generique,"
        " 'presences', named_struct('personnes_visibles', true, 'nombre_personnes', 1L), 'modele_analyse', CASE WHEN n % 2 = 0 THEN modele END, 'analyse_detaillee', named_struct('cadrage_optique', named_struct('profondeur_champ', 'faible', 'composition', array('centrée')), 'description_diegetique', CASE WHEN n % 2 = 0 THEN named_struct('lieu_decors', array(lieu_decors), 'objets_cles', array(objets_cles, 'x')) END)) AS analyse",
        "named_struct('titre', CASE WHEN film_id LIKE '%1-0' THEN '' ELSE concat('Film ', film_id) END, 'annee', '1987', 'realisateur', 'Zoe', 'scenaristes', array('bob', 'Zoe', ''), 'acteurs', array('Ann'), 'pitch', 'Pitch.', 'scenario', 'Script.', 'distributeurs', array('Big')) AS fiche", "'base-model' AS modele",
    ))


def _texts(rows: DataFrame) -> DataFrame:
    """Lists as texts, maps as their keys, lists of maps as their number."""
    shown = {f.name: f.kind for f in columns.FIELDS}
    kinds = {"list": lambda c: F.array_join(c, "|"), "ints": lambda c: F.array_join(F.col(c).cast("array<string>"), "|"), "records": lambda c: F.size(c).cast("long"), "record": lambda c: F.array_join(F.array_sort(F.map_keys(c)), "|"), "people": lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), "|")}
    return rows.select(*(kinds[shown[c]](c).alias(c) if shown[c] in kinds else F.col(c) for c in rows.columns))


_NOTHING = {"text": "''", "list": "''", "flag": "FALSE", "int": "CAST(NULL AS BIGINT)", "number": "CAST(0 AS BIGINT)", "real": "CAST(NULL AS DOUBLE)", "ints": "''", "record": "''", "people": "''", "records": "CAST(0 AS BIGINT)"}
_MODEL = "CASE WHEN n % 2 = 0 AND coalesce(modele, '') <> '' THEN modele ELSE 'base-model' END"
#: What the nested shots say, column by column.
_SAID = {
    "film": "film_id", "titre": "CASE WHEN film_id LIKE '%1-0' THEN film_id ELSE concat('Film ', film_id) END", "annee": "'1987'", "decennie": "'1980s'", "realisateur": "'Zoe'", "scenaristes": "'bob|Zoe|'", "acteurs": "'Ann'", "credits": "'Ann|bob|Zoe'",
    "credits_par_fonction": "'Réalisation=Zoe|Scénario=bob,Zoe|Acteurs=Ann|Distribution=Big'", "pitch": "'Pitch.'", "scenario": "'Script.'", "contexte_film": "'Pitch. Script.'", "personnes_reconnues": "CASE WHEN n % 7 = 0 THEN 3 ELSE 0 END", "personnes_visibles": "CASE WHEN n % 7 = 0 THEN 'Ann' ELSE '' END",
    "personnages_recurrents": "CASE WHEN n % 5 = 0 THEN 2 ELSE 0 END", "personnages_recurrents_ids": "CASE WHEN n % 5 = 0 THEN 'personnage_001' ELSE '' END", "personnages_recurrents_labels": "CASE WHEN n % 5 = 0 THEN concat('Visage', CASE WHEN lang <> '' THEN concat(' · ', lang) ELSE '' END, '|Profil') ELSE '' END",
    "presence_personnes": "n % 3 = 1 OR n % 2 = 0", "nombre_personnes": "CASE n % 3 WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 2 END", "genres_personnes": "CASE WHEN n % 3 = 0 THEN 'femme' ELSE '' END", "n": "n", "tc": "concat('tc ', n)", "debut": "debut", "fin": "fin", "duree": "duree",
    "scene_id": "CASE WHEN n % 4 = 0 THEN 'scene_009' ELSE 'scene_001' END", "scene_numero": "CAST(1 AS BIGINT)", "scene_titre": "concat('Scène ', film_id)", "scene_motifs_structurants": "array_to_string(['feu', lang], '|')", "scene_a_verifier": "n % 5 = 0", "vignette": "vignette", "vignettes": "vignettes",
    "machine": "machine", "machine_types": "'écran'", "interface": "interface", "certitude": "coalesce(certitude, '')", "echelle": "coalesce(echelle, '')", "lieu": "coalesce(lieu, '')", "generique": "generique", "profondeur_champ": "'faible'", "composition_cadre": "'centrée'",
    "mouvement_camera": "CASE WHEN n % 6 = 0 THEN 'fixe' ELSE '' END", "mouvement_video_camera": "CASE WHEN n % 6 = 1 THEN 'zoom in' ELSE '' END", "mouvement_camera_final": "CASE n % 6 WHEN 0 THEN 'fixe' WHEN 1 THEN 'zoom in' WHEN 2 THEN 'tilt haut' ELSE '' END", "mouvement_camera_conflit": "n % 6 = 0",
    "lieu_decors": "CASE WHEN n % 2 = 0 THEN coalesce(lieu_decors, '') ELSE '' END", "objets_cles": "CASE WHEN n % 2 = 0 THEN array_to_string([objets_cles, 'x'], '|') ELSE '' END", "analyse_modele": _MODEL, "mots_cles": "coalesce(lang, '')",
    "description": f"concat(rtrim(regexp_replace(trim(CASE WHEN n % 9 > 0 AND substr(description, 1, 20) <> '' THEN substr(description, 1, 20) ELSE 'note' END), '\\s*\\(analyse : [^)]*\\)\\s*$', '')), ' (analyse : ', {_MODEL}, ')')",
    "dialogue": "n % 3 = 0", "dialogues": "CASE WHEN n % 3 = 0 THEN 2 ELSE 0 END", "dialogue_texte": "CASE WHEN n % 3 = 0 THEN '- Oui ? - Non ?' ELSE '' END", "dialogue_source": "CASE WHEN n % 2 = 0 THEN ' Transcription Whisper ' ELSE '' END",
    "audio_source": "CASE WHEN n % 2 = 0 THEN 'transcription whisper locale' ELSE 'aucune source' END", "dialogue_types": "CASE WHEN n % 3 = 0 THEN 'conversation|questions / réponses|réplique brève' ELSE '' END", "musique_types": "'aucune musique signalée'", "ambiance_types": "CASE WHEN n % 3 = 0 THEN 'ambiance non qualifiée' ELSE '' END",
    "audio_global_plans": "concat(n, '|', n + 1)", "audio_global_debut": "debut + 1", "affinage": "CASE WHEN n % 7 = 0 THEN 'modele|raisons' ELSE '' END", "affinage_modele": "CASE WHEN n % 7 = 0 THEN 'm2' ELSE '' END", "affinage_raisons": "CASE WHEN n % 7 = 0 THEN 'a|b' ELSE '' END",
    "analyse_detaillee": "CASE WHEN n % 2 = 0 THEN 'cadrage_optique|description_diegetique' ELSE 'cadrage_optique' END",
}


def _oracle(names: list[str]) -> str:
    kinds = {f.name: f.kind for f in columns.FIELDS}
    return "SELECT " + ", ".join(f"{f'CAST({_SAID[c]} AS BIGINT)' if c in _SAID and kinds[c] in ('number', 'records') else _SAID.get(c, _NOTHING[kinds[c]])} AS {c}" for c in names) + " FROM shots"


@query("shots", oracle=_oracle(columns.WIDE))
def wide_shots(shots: DataFrame) -> DataFrame:
    return _texts(columns.projected(_nested(shots)))


@query("shots", oracle=_oracle(columns.COMPACT))
def compact_shots(shots: DataFrame) -> DataFrame:
    return _texts(columns.projected(_nested(shots), columns.COMPACT))


@query("shots", oracle=_oracle(columns.WIDE) + " WHERE film_id NOT LIKE '%1-0' OR n % 2 = 0")
def full_index(shots: DataFrame) -> DataFrame:
    """The full index of each film, of the shots that count: some films have a re-cut with every other shot. It is written
    by film, and read again."""
    rows = _nested(shots)
    plan = F.struct(*(c for c in rows.columns if c != "film_id"))
    recut = F.when((F.col("n") % 2 == 0) & F.col("film_id").like("%1-0"), plan)
    films = rows.groupBy("film_id").agg(F.collect_list(plan).alias("plans"), F.collect_list(recut).alias("plans_proposes")).withColumn("strategie", F.lit("non-destructive-add-only-v2"))
    wide = columns.projected(publish.visible(films))
    path = folder(shots.sparkSession)
    publish.write_index(wide.withColumn("film_id", F.col("film")), path)
    return _texts(shots.sparkSession.read.schema(wide.schema).parquet(path).select(columns.WIDE))


#: Closed vocabularies of the index, in their order.
VOCABULARIES = {
    "echelles": ("echelle", ["très gros plan", "gros plan", "plan poitrine", "plan taille", "plan américain", "plan moyen", "plan large", "plan d'ensemble", "plan général"]),
    "mouvements_camera_final": ("mouvement_camera_final", ["fixe", "zoom in", "zoom out", "tilt haut", "tilt bas", "indéterminé"]),
    "dialogue_types": ("dialogue_types", ["conversation", "monologue", "questions / réponses", "réplique brève", "dialogue expressif", "annonce / message", "dialogue continu"]),
    "musique_types": ("musique_types", ["musique signalée", "chant / chanson", "aucune musique signalée"]),
}
_VALUES = " UNION ALL ".join(f"SELECT '{name}' AS name, CAST({i} AS BIGINT) AS position, '{v.replace(chr(39), chr(39) * 2)}' AS value" for name, (_, values) in VOCABULARIES.items() for i, v in enumerate(values))
_USED = " UNION ALL ".join(f"SELECT '{name}' AS name, unnest(list_distinct(string_split({_SAID[c]}, '|'))) AS value FROM shots" for name, (c, _) in VOCABULARIES.items())


@query("shots", oracle=f"SELECT v.name, v.position, v.value, coalesce(k, 0) AS shots FROM ({_VALUES}) v LEFT JOIN (SELECT name, value, count(*) AS k FROM ({_USED}) x GROUP BY ALL) u ON v.name = u.name AND v.value = u.value")
def index_vocabulary(shots: DataFrame) -> DataFrame:
    """The vocabulary table of the index, with the number of shots that have each value."""
    rows = columns.projected(_nested(shots), [c for c, _ in VOCABULARIES.values()])
    return columns.vocabulary_use(rows, VOCABULARIES)
