"""What a sequence's music is: clean local tags, quotes in dialogue, fingerprints, and when to distrust an answer.

Answers are rows with the columns of ANSWER; each step fills what is still missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.functions.text import blank, first_truthy, fold_keeping_signs

from .labels import technical_name

#: Columns of an answer on sound, and their types.
ANSWER = {
    "musique_presente": "boolean",
    "parole_chantee": "boolean",
    "musique_familles": "array<string>",
    "musique_sous_genres": "array<string>",
    "design_sonore_types": "array<string>",
    "intensite_sonore": "string",
    "titre_morceau": "string",
    "artiste_morceau": "string",
    "auteur_morceau": "string",
    "identification_methode": "string",
    "identification_confiance": "string",
    "a_verifier": "boolean",
    "notes_audio": "string",
}
#: Columns of a shot that an answer on sound overwrites, where they have another name.
RENAMED = {"titre_morceau": "musique_titre", "artiste_morceau": "musique_artiste", "auteur_morceau": "musique_auteur", "identification_methode": "musique_methode", "identification_confiance": "musique_confiance", "a_verifier": "musique_a_verifier", "notes_audio": "audio_notes"}
#: Columns of an answer on writing, and their types.
WRITING = {"texte_visible": "boolean", "texte_lisible": "boolean", "generique": "boolean", "texte_role": "string", "typographie_categorie": "string", "typographie_styles": "array<string>", "typographie_description": "string"}
#: Patterns of a title and an artist in dialogue.
QUOTES = [r"(?i)[«\"]([^\"]+)[»\"]\s+(?:by|de)\s+([^\n]+)", r"(?i)(?:song|chanson|musique)\s*[:\-]\s*[«\"]?([^\"\n]+?)[»\"]?\s+(?:by|de)\s+([^\n]+)"]
#: Where an identification comes from, and how far it is trusted.
FROM_TEXT, FROM_TAGS, FROM_PRINT, FROM_SPECTRUM = "indices textuels / sous-titres", "métadonnées locales", "empreinte acoustid + musicbrainz", "analyse spectrale locale"
FAIR, WEAK = "moyenne", "faible"
#: Answers where there is nothing to hear, and where listening led to nothing.
SILENCE = {"design_sonore_types": ["silence / quasi-silence"], "intensite_sonore": "très faible", "notes_audio": "Extrait très faible ou quasi silencieux."}
INCONCLUSIVE = {"design_sonore_types": ["indéterminé"], "a_verifier": True, "notes_audio": "Analyse locale non concluante."}
_IDENTITY = [c for c in ANSWER if c.endswith("_morceau") or c.startswith("identification_")]


def default_answer(stated: dict) -> dict[str, Column]:
    """A whole answer from the few columns that are stated: no music, empty lists and texts besides."""

    def cell(name: str, kind: str) -> Column:
        if kind.startswith("array"):
            return F.array(*(F.lit(v) for v in stated.get(name, []))).cast(kind)
        return F.lit(stated.get(name, False if kind == "boolean" else "")).cast(kind)

    return {name: cell(name, kind).alias(name) for name, kind in ANSWER.items()}


def answered(rows: DataFrame, silent: Column) -> DataFrame:
    """rows with answers (null columns where a model gave none): silence is stated, no answer is inconclusive."""
    quiet, none = default_answer(SILENCE), default_answer(INCONCLUSIVE)
    given = F.coalesce(*(F.when(F.col(c).isNotNull(), True) for c in ANSWER), F.lit(False))
    return rows.withColumns({c: F.when(silent, quiet[c]).when(~given, none[c]).otherwise(F.col(c)) for c in ANSWER})


def local_tag(value: Column, film: Column) -> Column:
    """A tag of a media file, or nothing where it is the film's title, a technical name or too long for a title."""
    tag = F.trim(F.coalesce(value, F.lit("")))
    own = ~blank(fold_keeping_signs(film)) & (fold_keeping_signs(tag) == fold_keeping_signs(film))
    return F.when(own | technical_name(tag) | (F.length(tag) > 180), "").otherwise(tag)


def local_tags(files: DataFrame, streams: DataFrame) -> DataFrame:
    """(film_id, title, artist, composer, album) of files whose gaps the first audio stream fills.

    files: (film_id, titre, title, artist, composer, album); streams: (film_id, pos, codec_type, title, artist, composer)"""
    names = ["title", "artist", "composer"]
    first = streams.where("codec_type = 'audio'").groupBy("film_id").agg(F.min_by(F.struct(*names), "pos").alias("_s"))
    filled = {n: local_tag(first_truthy(F.col(n), F.col(f"_s.{n}")), F.col("titre")).alias(n) for n in names}
    return files.join(first, "film_id", "left").select("film_id", *filled.values(), local_tag(F.col("album"), F.col("titre")).alias("album"))


def quoted(text: Column) -> Column:
    """Struct of the title and artist that dialogue names, null if it names none."""

    def part(pattern: str, group: int) -> Column:
        flat = F.regexp_replace(F.regexp_extract(text, pattern, group), r"(?U)\s+", " ")
        return F.regexp_replace(flat, r"^[ .,:;–-]+|[ .,:;–-]+$", "")

    each = [(part(p, 1), part(p, 2)) for p in QUOTES]
    return F.coalesce(*(F.when((t != "") & (a != ""), F.struct(t.alias("titre"), a.alias("artiste"))) for t, a in each))


def _stated() -> Column:
    return ~blank(F.col("titre_morceau")) & ~blank(F.col("artiste_morceau"))


def _set(rows: DataFrame, when: Column, values: dict[str, Column]) -> DataFrame:
    return rows.withColumns({c: F.when(when, v).otherwise(F.col(c)) for c, v in values.items()})


def identified(rows: DataFrame, text: Column, tags: Column, prints: Column) -> DataFrame:
    """Answers completed from dialogue, local tags (title, artist, composer) and a fingerprint (title, artist, author,
    method, confidence, a_verifier), each only where title or artist are still missing; misleading ones are reset."""
    named, missing = quoted(text), ~_stated()
    rows = rows.withColumns({"_q": named, "_t": tags, "_p": prints})
    rows = _set(
        rows,
        missing & F.col("_q").isNotNull(),
        {"titre_morceau": F.col("_q.titre"), "artiste_morceau": F.col("_q.artiste"), "auteur_morceau": F.col("_q.artiste"), "identification_methode": F.lit(FROM_TEXT), "identification_confiance": F.lit(FAIR), "a_verifier": F.lit(True)},
    )
    rows = _set(
        rows,
        blank(F.col("titre_morceau")) & ~blank(F.col("_t.title")),
        {
            "artiste_morceau": first_truthy(F.col("artiste_morceau"), F.col("_t.artist")),
            "auteur_morceau": first_truthy(F.col("auteur_morceau"), F.col("_t.composer"), F.col("_t.artist")),
            "identification_methode": first_truthy(F.col("identification_methode"), F.lit(FROM_TAGS)),
            "identification_confiance": first_truthy(F.col("identification_confiance"), F.lit(WEAK)),
            "a_verifier": F.coalesce("a_verifier", F.lit(True)),
            "titre_morceau": F.col("_t.title"),
        },
    )
    rows = _set(
        rows,
        ~_stated() & ~blank(F.trim("_p.title")) & ~blank(F.trim("_p.artist")),
        {
            "titre_morceau": F.trim("_p.title"),
            "artiste_morceau": F.trim("_p.artist"),
            "auteur_morceau": first_truthy(F.col("_p.author"), F.trim("_p.artist")),
            "identification_methode": first_truthy(F.col("_p.method"), F.lit(FROM_PRINT)),
            "identification_confiance": first_truthy(F.col("_p.confidence"), F.lit(FAIR)),
            "a_verifier": F.coalesce("_p.a_verifier", F.lit(True)),
        },
    )
    return reset(rows.drop("_q", "_t", "_p"))


def misleading() -> Column:
    """A technical name as title, a title read from a spectrum, or one from metadata where there is no music."""
    titled, method = ~blank(F.col("titre_morceau")), F.coalesce("identification_methode", F.lit(""))
    silent = ~F.coalesce("musique_presente", F.lit(False))
    return technical_name(F.col("titre_morceau")) | (titled & (method == FROM_SPECTRUM)) | (titled & silent & (method == FROM_TAGS))


def reset(rows: DataFrame) -> DataFrame:
    """Answers with the six fields of a misleading identification blanked."""
    return _set(rows, misleading(), {**{c: F.lit("") for c in _IDENTITY}, "a_verifier": F.lit(False)})


def _default(value: Column, kind: str) -> Column:
    empty = F.array().cast(kind) if kind.startswith("array") else F.lit(False if kind == "boolean" else "")
    return F.coalesce(value, empty)


def overlaid(shots: DataFrame, answers: DataFrame, keys: list[str], kind: dict[str, str] | None = None) -> DataFrame:
    """Shots with an answer get all its columns, whatever they had before; what the answer lacks is a typed default.

    kind is ANSWER, whose columns take the shot's names, or WRITING; shots without an answer stay as they are."""
    kind = ANSWER if kind is None else kind
    told = answers.select(*keys, F.struct(*(_default(F.col(c), k).alias(RENAMED.get(c, c) if kind is ANSWER else c) for c, k in kind.items())).alias("_a"))
    names = told.schema["_a"].dataType.names
    rows = shots.join(told, keys, "left")
    kept = {n: F.col(n) if n in shots.columns else F.lit(None) for n in names}
    return rows.select(*(c for c in shots.columns if c not in names), *(F.when(F.col("_a").isNotNull(), F.col(f"_a.{n}")).otherwise(kept[n]).alias(n) for n in names))
