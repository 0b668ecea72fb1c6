"""Wide and compact shot rows: one table of columns gives both projections and the schema that documents are read with.

Each line names a column, where its value is found, its kind, and "compact" if the global catalogue has it too. Places are
paths into a shot; "|" leads to the next place where one says nothing. fiche is the film's record, scene the scene that the
shot lies in. What is asked for decides what is read: a projection of a few columns touches their fields only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelframe.functions.numbers import decade

from .labels import attributed, audio_source, sound_layers

#: Columns of a shot's row, with their places. Appearance terms are left out on purpose.
TABLE = """
film                              film_id                                                          text     compact
titre                             fiche.titre|film_id                                              text
annee                             fiche.annee                                                      text
decennie                          =decade                                                          text
realisateur                       fiche.realisateur                                                text
directeur_photo                   fiche.directeur_photo                                            text
scenaristes                       fiche.scenaristes                                                list
acteurs                           fiche.acteurs                                                    list
credits                           =credits                                                         list
credits_par_fonction              =by_function                                                     people
synopsis                          fiche.synopsis                                                   text
pitch                             fiche.pitch                                                      text
scenario                          fiche.scenario                                                   text
contexte_film                     =context                                                         text
personnes_reconnues               personnes_reconnues                                              records
personnes_visibles                =recognised                                                      list
personnages_recurrents            personnages_recurrents                                           records
personnages_recurrents_ids        =character_ids                                                   list
personnages_recurrents_labels     =character_labels                                                list     compact
presence_personnes                presences.personnes_visibles                                     flag     compact
nombre_personnes                  presences.nombre_personnes|analyse.personnages                   number   compact
genres_personnes                  presences.genres_personnes                                       list     compact
ages_personnes                    presences.ages_personnes                                         list     compact
origines_ethniques_documentees    presences.origines_ethniques_documentees                         list
animal_visible                    presences.animal_visible                                         flag     compact
animaux_visibles                  presences.animaux_visibles                                       list     compact
animal_confiance                  presences.animal_confiance                                       text
categories_presence               presences.categories_presence                                    list     compact
presences_note                    presences.note                                                   text
n                                 n                                                                int      compact
tc                                tc                                                               text     compact
debut                             debut                                                            real     compact
fin                               fin                                                              real     compact
duree                             duree                                                            real     compact
scene_id                          scene_id|scene.scene_id                                          text     compact
scene_numero                      scene_numero|scene.numero_scene                                  int      compact
scene_type                        scene_type|scene.type_scene                                      text     compact
scene_titre                       scene_titre|scene.titre                                          text     compact
scene_resume                      scene_resume|scene.resume_scene                                  text
scene_lieu                        scene_lieu|scene.lieu                                            text     compact
scene_temporalite                 scene_temporalite|scene.temporalite                              text     compact
scene_action_principale           scene_action_principale|scene.action_principale                  text
scene_ambiance                    scene_ambiance|scene.ambiance                                    text
scene_personnages_visibles        scene_personnages_visibles|scene.personnages_visibles            list     compact
scene_objets_significatifs        scene_objets_significatifs|scene.objets_significatifs            list
scene_motifs_structurants         scene_motifs_structurants|scene.motifs_structurants              list
scene_enjeu_narratif              scene_enjeu_narratif|scene.enjeu_narratif                        text
scene_contexte                    scene_contexte|scene.contexte_pour_plans                         text
scene_confiance                   scene_confiance|scene.confiance                                  text     compact
scene_a_verifier                  scene_a_verifier|scene.a_verifier                                flag     compact
vignette                          vignette                                                         text     compact
vignettes                         vignettes                                                        list     compact
apercu                            apercu                                                           text
couleurs                          couleurs                                                         list     compact
machine                           analyse.machine                                                  flag     compact
machine_types                     analyse.machine_types|analyse.types                              list     compact
machine_role                      analyse.machine_role                                             text     compact
interface                         analyse.interface                                                text     compact
texte_visible                     analyse.texte_visible                                            flag     compact
texte_lisible                     analyse.texte_lisible                                            flag
generique                         analyse.generique                                                flag     compact
texte_role                        analyse.texte_role                                               text     compact
typographie_categorie             analyse.typographie_categorie                                    text     compact
typographie_styles                analyse.typographie_styles                                       list     compact
typographie_description           analyse.typographie_description                                  text
certitude                         analyse.certitude                                                text     compact
echelle                           analyse.echelle                                                  text     compact
angle                             analyse.angle                                                    text     compact
profondeur_champ                  optique.profondeur_champ                                         text     compact
details_profondeur_champ          optique.details_profondeur_champ                                 text
composition_cadre                 optique.composition                                              list     compact
mouvement                         analyse.mouvement                                                text     compact
mouvement_camera                  mouvement_camera                                                 text     compact
mouvement_direction               mouvement_direction                                              text     compact
mouvement_intensite               mouvement_intensite                                              text     compact
mouvement_confiance               mouvement_confiance                                              text     compact
mouvement_mesures                 mouvement_mesures                                                record
mouvement_mecanique_timeline      mouvement_mecanique_timeline                                     records
mouvement_video_modele            mouvement_video_modele                                           text     compact
mouvement_video_camera            mouvement_video_camera                                           text     compact
mouvement_video_labels            mouvement_video_labels                                           records
mouvement_video_scores            mouvement_video_scores                                           record
mouvement_video_segments          mouvement_video_segments                                         records
mouvement_video_confiance         mouvement_video_confiance                                        text     compact
mouvement_camera_final            mouvement_camera_final|mouvement_video_camera|mouvement_camera   text     compact
mouvement_camera_sources          mouvement_camera_sources                                         list     compact
mouvement_camera_conflit          mouvement_camera_conflit                                         flag     compact
mouvement_camera_notes            mouvement_camera_notes                                           text     compact
lumiere                           analyse.lumiere                                                  text     compact
palette_colorimetrique            couleur.palette_colorimetrique                                   list     compact
lumiere_etalonnage                couleur.lumiere_etalonnage                                       list     compact
direction_lumiere_principale      couleur.direction_lumiere_principale                             text     compact
matiere_texture                   couleur.matiere_texture                                          list     compact
lieu                              analyse.lieu                                                     text     compact
lieu_decors                       recit.lieu_decors                                                list
analyse_modele                    analyse_modele|analyse.modele_analyse|modele                     text
description                       =description                                                     text
mots_cles                         analyse.mots_cles                                                list
personnages_sujets                recit.personnages_sujets                                         list
attitudes_expressions             recit.attitudes_expressions                                      list
objets_cles                       recit.objets_cles                                                list
presence_texte_types              graphisme.presence_texte                                         list
classification_typographique      graphisme.classification_typographique                           list     compact
composition_graphique             graphisme.composition_graphique                                  text     compact
dialogue                          dialogue                                                         flag     compact
dialogues                         dialogues                                                        records
dialogue_texte                    dialogue_texte                                                   text
dialogue_source                   dialogue_source                                                  text
audio_source                      =audio_source                                                    text     compact
dialogue_types                    =dialogue_types                                                  list     compact
musique_types                     =musique_types                                                   list     compact
ambiance_types                    =ambiance_types                                                  list     compact
musique_presente                  musique_presente                                                 flag
parole_chantee                    parole_chantee                                                   flag
musique_familles                  musique_familles                                                 list     compact
musique_sous_genres               musique_sous_genres                                              list     compact
design_sonore_types               design_sonore_types                                              list     compact
intensite_sonore                  intensite_sonore                                                 text
musique_titre                     musique_titre                                                    text     compact
musique_artiste                   musique_artiste                                                  text     compact
musique_auteur                    musique_auteur                                                   text     compact
musique_methode                   musique_methode                                                  text     compact
musique_confiance                 musique_confiance                                                text     compact
musique_a_verifier                musique_a_verifier                                               flag     compact
audio_global_ref                  audio_global_ref                                                 text     compact
audio_global_debut                audio_global_debut                                               real     compact
audio_global_fin                  audio_global_fin                                                 real     compact
audio_global_plans                audio_global_plans                                               ints     compact
audio_global_mode                 audio_global_mode                                                text     compact
audio_notes                       audio_notes                                                      text
audio_detaille                    audio_detaille                                                   record
affinage                          affinage                                                         record
affinage_modele                   affinage.modele                                                  text     compact
affinage_raisons                  =refine_reasons                                                  list     compact
typographie                       typographie                                                      record
typographie_modele                typographie.modele                                               text     compact
analyse_detaillee                 =detail                                                          record
contexte_film_utilise             contexte_film_utilise                                            record
contexte_scene_utilise            contexte_scene_utilise                                           record
"""
KINDS = {"text": "string", "list": "array<string>", "flag": "boolean", "int": "bigint", "number": "bigint", "real": "double", "ints": "array<bigint>", "record": "map<string,string>", "people": "map<string,array<string>>", "records": "array<map<string,string>>"}
#: Parts of the detailed analysis, by the first word of a place.
PARTS = {"optique": "cadrage_optique", "couleur": "direction_artistique_couleur", "graphisme": "design_graphique_typographie", "recit": "description_diegetique"}
#: The fields of each part.
DETAILS = {
    "optique": ["profondeur_champ", "details_profondeur_champ", "composition"],
    "couleur": ["palette_colorimetrique", "lumiere_etalonnage", "direction_lumiere_principale", "matiere_texture"],
    "graphisme": ["presence_texte", "classification_typographique", "composition_graphique"],
    "recit": ["lieu_decors", "personnages_sujets", "attitudes_expressions", "objets_cles"],
}
#: The film's credits, in the order in which they are gathered.
CREDITS = ["realisateur", "directeur_photo", "scenaristes", "acteurs", "producteurs", "chef_decorateur", "monteur", "musique", "costumes", "effets_speciaux"]
LISTED = {"scenaristes", "acteurs", "producteurs", "effets_speciaux", "societes_production", "distributeurs"}
#: What the film's people are called by their work.
FUNCTIONS = {
    "Réalisation": "realisateur",
    "Scénario": "scenaristes",
    "Acteurs": "acteurs",
    "Production": "producteurs",
    "Photographie": "directeur_photo",
    "Décors": "chef_decorateur",
    "Montage": "monteur",
    "Musique": "musique",
    "Costumes": "costumes",
    "Effets spéciaux": "effets_speciaux",
    "Sociétés de production": "societes_production",
    "Distribution": "distributeurs",
}
#: What the columns that are worked out are worked out from.
NEEDS = {
    "decade": ["fiche.annee"],
    "credits": [f"fiche.{c}" for c in CREDITS],
    "by_function": [f"fiche.{c}" for c in FUNCTIONS.values()],
    "detail": [f"{part}.{c}" for part, fields in DETAILS.items() for c in fields],
    "context": ["fiche.pitch", "fiche.synopsis", "fiche.scenario"],
    "recognised": ["personnes_reconnues"],
    "character_ids": ["personnages_recurrents"],
    "character_labels": ["personnages_recurrents"],
    "description": ["analyse.description", "analyse.note", "analyse_modele", "analyse.modele_analyse", "modele"],
    "audio_source": ["dialogue_source"],
    "dialogue_types": ["dialogue", "dialogue_texte", "dialogues"],
    "musique_types": ["dialogue", "dialogue_texte", "dialogues"],
    "ambiance_types": ["dialogue", "dialogue_texte", "dialogues"],
    "refine_reasons": ["affinage"],
}


@dataclass(frozen=True)
class Field:
    name: str
    places: tuple[str, ...]
    kind: str
    compact: bool

    @property
    def needs(self) -> list[str]:
        return NEEDS[self.places[0][1:]] if self.places[0].startswith("=") else list(self.places)


FIELDS = [Field(w[0], tuple(w[1].split("|")), w[2], len(w) > 3) for w in map(str.split, TABLE.strip().splitlines())]
WIDE = [f.name for f in FIELDS]
COMPACT = [f.name for f in FIELDS if f.compact]


def _asked(names: list[str] | None) -> list[Field]:
    if names is None:
        return FIELDS
    known = {f.name: f for f in FIELDS}
    return [known[n] for n in names]


def _kind_of(place: str) -> str:
    """The type of what stands at a place."""
    for f in FIELDS:
        if place in f.places:
            return KINDS[f.kind]
    return KINDS["list"] if place.removeprefix("fiche.") in LISTED else KINDS["text"]


def schema(names: list[str] | None = None) -> str:
    """Of a document, the fields that the named columns need: those of the film, and of its shots under plans."""
    film, shot = {"_corrupt": "string"}, {}
    for place in dict.fromkeys(p for f in _asked(names) for p in f.needs):
        if place == "film_id" or place.startswith("scene."):
            continue
        kind, path = _kind_of(place), place.split(".")
        if path[0] in ("fiche", "modele"):
            _put(film, path, kind)
        elif path[0] == "presences":
            _put(shot, path, kind)
            _put(shot, ["analyse", *path], kind)
        elif path[0] in PARTS:
            _put(shot, ["analyse", "analyse_detaillee", PARTS[path[0]], *path[1:]], kind)
        elif path[0] in ("affinage", "typographie"):
            shot[path[0]] = KINDS["record"]
        else:
            _put(shot, path, kind)
    film["plans"] = f"array<{_struct(shot)}>"
    return ", ".join(f"`{k}` {_struct(v)}" for k, v in film.items())


def _put(tree: dict, path: list[str], kind: str) -> None:
    for p in path[:-1]:
        tree = tree.setdefault(p, {})
    tree[path[-1]] = kind


def _struct(tree: dict | str) -> str:
    return tree if isinstance(tree, str) else "struct<" + ", ".join(f"`{k}`: {_struct(v)}" for k, v in tree.items()) + ">"


def _at(rows: DataFrame, path: str) -> Column | None:
    """What stands at a path, None where the rows have no such field."""
    here: T.DataType = rows.schema
    col = None
    for p in path.split("."):
        if isinstance(here, T.MapType):
            return F.try_element_at(col, F.lit(p))
        if not isinstance(here, T.StructType) or p not in here.names:
            return None
        col, here = (F.col(p) if col is None else col[p]), here[p].dataType
    return col


def _found(rows: DataFrame, place: str) -> Column | None:
    head, _, rest = place.partition(".")
    if head in PARTS:
        return _at(rows, f"analyse.analyse_detaillee.{PARTS[head]}.{rest}")
    if head == "presences":  # the analysis's presences count where the shot states none at all
        own, other = _at(rows, place), _at(rows, f"analyse.{place}")
        if own is None or other is None:
            return other if own is None else own
        none = F.lit(True)
        for f in rows.schema["presences"].dataType.names:
            none = none & F.col("presences")[f].isNull()
        return F.when(none, other).otherwise(own)
    return _at(rows, place)


def _says(value: Column, kind: str) -> Column:
    """The value, null where it is empty."""
    if kind in ("list", "ints", "records", "record"):
        return F.when(F.size(value) > 0, value)
    return F.nullif(value, F.lit("")) if kind == "text" else F.when(value, value) if kind == "flag" else F.when(value != 0, value) if kind == "int" else value


def _default(kind: str) -> Column:
    empty = {"text": F.lit(""), "flag": F.lit(False), "number": F.lit(0), "list": F.array(), "ints": F.array(), "records": F.array(), "record": F.create_map(), "people": F.create_map()}
    return empty.get(kind, F.lit(None)).cast(KINDS[kind])


def _worked_out(rows: DataFrame, what: str) -> Column:
    text = lambda p: c if (c := _at(rows, p)) is not None else F.lit("")
    many = lambda p: c if (c := _at(rows, p)) is not None else F.array().cast(KINDS["records"])
    if what == "decade":
        return decade(text("fiche.annee"))
    if what == "context":
        return F.array_join(F.filter(F.array(*(text(f"fiche.{c}") for c in ("pitch", "synopsis", "scenario"))), lambda x: x != ""), " ")
    if what == "credits":
        lists = [c if isinstance(rows.schema["fiche"].dataType[n].dataType, T.ArrayType) else F.array(c) for n in CREDITS if (c := _at(rows, f"fiche.{n}")) is not None]
        every = F.array_distinct(F.filter(F.flatten(F.array_compact(F.array(*lists))), lambda x: x != "")) if lists else F.array().cast(KINDS["list"])
        return F.transform(F.array_sort(F.transform(every, lambda x: F.struct(F.lower(x).alias("low"), x.alias("x")))), lambda s: s["x"])
    if what == "by_function":
        many = {label: c if isinstance(rows.schema["fiche"].dataType[n].dataType, T.ArrayType) else F.array(c) for label, n in FUNCTIONS.items() if (c := _at(rows, f"fiche.{n}")) is not None}
        pairs = [x for label, c in many.items() for x in (F.lit(label), F.filter(c, lambda v: v != ""))]
        return F.map_filter(F.create_map(*pairs).cast(KINDS["people"]), lambda _, v: F.size(v) > 0)
    if what == "detail":
        parts = {p: c for p in PARTS.values() if (c := _at(rows, f"analyse.analyse_detaillee.{p}")) is not None}
        return F.map_filter(F.create_map(*(x for p, c in parts.items() for x in (F.lit(p), F.to_json(c)))).cast(KINDS["record"]), lambda _, v: v.isNotNull())
    if what == "recognised":
        return F.filter(F.transform(many("personnes_reconnues"), lambda x: F.try_element_at(x, F.lit("nom"))), lambda x: x != "")
    if what == "character_ids":
        return F.filter(F.transform(many("personnages_recurrents"), lambda x: F.try_element_at(x, F.lit("personnage_id"))), lambda x: x != "")
    if what == "character_labels":
        told = lambda x: F.array_join(F.filter(F.array(F.try_element_at(x, F.lit("label")), F.try_element_at(x, F.lit("profil_resume"))), lambda t: t != ""), " · ")
        return F.transform(many("personnages_recurrents"), told)
    if what == "description":
        model = F.coalesce(*(F.nullif(text(p), F.lit("")) for p in ("analyse_modele", "analyse.modele_analyse", "modele")), F.lit(""))
        return attributed(F.coalesce(F.nullif(text("analyse.description"), F.lit("")), text("analyse.note")), model)
    if what == "audio_source":
        return audio_source(text("dialogue_source"))
    if what == "refine_reasons":
        reasons = F.from_json(text("affinage.raisons"), "array<string>")
        return F.coalesce(reasons, F.array().cast("array<string>"))
    return F.col(f"_{what}")


def projected(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The named columns (all by default) of shots with nested fields: what their places say, or a typed default."""
    asked = _asked(names)
    if any(f.places[0][1:] in ("dialogue_types", "musique_types", "ambiance_types") for f in asked):
        get = lambda p, kind: c if (c := _at(rows, p)) is not None else F.lit(None).cast(kind)
        heard = {"dialogue": get("dialogue", "boolean"), "dialogue_texte": get("dialogue_texte", "string"), "n_segments": F.size(get("dialogues", KINDS["records"]))}
        layers = sound_layers(rows.withColumns(heard))
        rows = layers.select(*rows.columns, *(F.col(c).alias(f"_{c}") for c in ("dialogue_types", "musique_types", "ambiance_types")))
    out = []
    for f in asked:
        if f.places[0].startswith("="):
            value = _worked_out(rows, f.places[0][1:])
        else:
            found = [c for p in f.places if (c := _found(rows, p)) is not None]
            value = F.coalesce(*(_says(c.cast(KINDS[f.kind]), f.kind) for c in found[:-1]), found[-1].cast(KINDS[f.kind])) if found else F.lit(None).cast(KINDS[f.kind])
        out.append(F.coalesce(value.cast(KINDS[f.kind]), _default(f.kind)).alias(f.name))
    return rows.select(*out)


def vocabulary_use(rows: DataFrame, lists: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """(name, position, value, shots): closed vocabularies in their own order, and how many rows of a projection have each
    value. lists gives for each vocabulary its column and its values."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(name, i, v) for name, (_, values) in lists.items() for i, v in enumerate(values)], "name string, position long, value string")
    kinds = {f.name: f.dataType for f in rows.schema}
    entries = [F.struct(F.lit(name).alias("name"), (F.col(c) if isinstance(kinds[c], T.ArrayType) else F.array(c)).alias("values")) for name, (c, _) in lists.items()]
    used = rows.select(F.inline(F.array(*entries))).select("name", F.explode(F.array_distinct("values")).alias("value")).groupBy("name", "value").agg(F.count("*").alias("shots"))
    return F.broadcast(known).join(used, ["name", "value"], "left").select("name", "position", "value", F.coalesce("shots", F.lit(0)).alias("shots"))
