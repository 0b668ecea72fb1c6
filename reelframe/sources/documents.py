"""Readers: film documents, photo stores, subtitles, job logs, media listings, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.functions.ranks import numbered
from reelframe.functions.text import squashed

#: One shot of a film document; unknown keys are dropped, missing ones are null.
SHOT = "n int, debut double, fin double, duree double, tc string, vignette string, vignettes array<string>, dialogue boolean, dialogue_texte string, analyse struct<echelle:string,lieu:string,description:string,mots_cles:array<string>,machine:boolean,machine_types:array<string>,interface:string,certitude:string,generique:boolean,texte_visible:boolean>"
FILM = f"film string, id string, source string, modele string, fiche map<string,string>, plans array<struct<{','.join(p.replace(' ', ':', 1) for p in SHOT.split(', '))}>>, _corrupt string"


def film_documents(spark: SparkSession, root: str, film: str | None = None, schema: str = FILM, layout: str = "{film}/plans.json") -> DataFrame:
    """One row per document below root, with film_id from its folder; damaged ones have _corrupt.

    With film, only that folder is listed and read. A schema of fewer fields (of the columns that are asked for, say) is
    all that is parsed. layout says where a film's documents lie; the folder may be named film_id=..., as Spark does."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(f"{root}/{layout.format(film=film or '*')}")
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.withColumn("film_id", F.url_decode(F.regexp_replace(folder, "^film_id=", "")))


def shots(documents: DataFrame) -> DataFrame:
    return documents.where("_corrupt is null").select("film_id", F.inline(F.coalesce("plans", F.array().cast(documents.schema["plans"].dataType))))


def quarantined(documents: DataFrame) -> DataFrame:
    """Damaged documents; what could be read of the film stays, as the raw text can't be queried alone."""
    return documents.where("_corrupt is not null").select("film_id", "film", "_corrupt")


def photo_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"photos array<struct<{schema}>>").option("multiLine", True).json(path).select(F.inline("photos"))


def media_listing(spark: SparkSession, root: str, suffixes: list[str]) -> DataFrame:
    """(path, size, mtime) of the files below root with one of the suffixes; contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return rows.select("path", F.col("length").alias("size"), F.floor(F.unix_micros("modificationTime") / 1_000_000).alias("mtime")).where(suffix.isin(suffixes) & ~name.startswith("."))


def _stamp(text: Column) -> Column:
    part = lambda i, t: F.try_element_at(F.split(F.replace(t, F.lit(","), F.lit(".")), ":"), F.lit(i)).try_cast("double")
    return F.bround(part(-3, text) * 3600 + part(-2, text) * 60 + part(-1, text), 3)


def subtitles(texts: DataFrame) -> DataFrame:
    """(film_id, debut, fin, texte) from whole subtitle files (film_id, value): blocks apart by blank lines, with two stamps."""
    blocks = texts.select("film_id", F.posexplode(F.split(F.regexp_replace("value", r"\r\n?", "\n"), r"\n[ \t]*\n\s*")).alias("pos", "block"))
    stamps = r"(\S+)[ \t]*-->[ \t]*(\S+)"
    said = F.regexp_replace(F.regexp_replace(F.regexp_replace("block", r"(?s)^.*?-->[^\n]*\n?", ""), r"<[^>]*>", ""), r"\{\\[^}]*\}", "")
    rows = blocks.where(F.contains("block", F.lit("-->"))).select("film_id", "pos", _stamp(F.regexp_extract("block", stamps, 1)).alias("debut"), _stamp(F.regexp_extract("block", stamps, 2)).alias("fin"), squashed(said).alias("texte"))
    return rows.where("debut is not null and fin is not null and texte <> ''").select("film_id", "debut", "fin", "texte")


def job_progress(lines: DataFrame, pattern: str, active: Column | None = None) -> DataFrame:
    """Of each job the numbers of its last line that matches: current, total, per cent, finished.

    lines: (job, line_no, value); pattern has the groups current and total first."""
    rows = lines.where(F.col("value").rlike(pattern))
    last = rows.groupBy("job").agg(F.max_by("value", "line_no").alias("value"))
    number = lambda i: F.regexp_extract("value", pattern, i).cast("long")
    rows = last.select("job", number(1).alias("current"), number(2).alias("total"))
    running = F.lit(False) if active is None else active
    return rows.select("job", "current", "total", F.bround(F.col("current") / F.greatest("total", F.lit(1)) * 100).cast("long").alias("percent"), ((F.col("current") >= F.col("total")) & ~running).alias("finished"))


def title_and_year(name: Column) -> tuple[Column, Column]:
    """Title without a last "(year)", and the year in parentheses, from a file name."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.trim(F.regexp_replace(stem, r"\s*\([0-9]{4}\)\s*$", "")), F.regexp_extract(stem, r"\(([0-9]{4})\)", 1).try_cast("int")


def plain_text(markup: Column, limit: int | None = None) -> Column:
    """Readable text of wiki markup or HTML: comments, references, templates, tables, tags and link syntax go."""
    out = F.regexp_replace(markup, r"(?s)<!--.*?-->|<ref[^>/]*/>|<ref[^>]*>.*?</ref>|<(script|style)[^>]*>.*?</\1>|\{\|.*?\|\}", " ")
    for _ in range(8):  # templates lie inside each other; each pass peels the innermost
        out = F.regexp_replace(out, r"\{\{[^{}]*\}\}", " ")
    out = F.regexp_replace(out, r"(?i)\[\[(?:file|image|fichier):[^\[\]]*\]\]", " ")
    out = F.regexp_replace(out, r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", "$1")
    out = F.regexp_replace(out, r"\[https?://\S+ ?([^\]]*)\]", "$1")
    out = F.regexp_replace(out, r"'{2,}|(?m)^=+.*?=+$|(?m)^[*#:;]+", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    out = squashed(out)
    if limit is None:
        return out
    cut = F.regexp_replace(F.regexp_replace(F.substring(out, 1, limit), r" [^ ]*$", ""), "[ .,;:]+$", "")
    return F.when(F.length(out) <= limit, out).otherwise(F.concat(cut, F.lit("…")))


def names(credits: Column, most: int = 12) -> Column:
    """Person names of a credit line: split, without parentheses, digits and overlong ones, distinct."""
    flat = F.regexp_replace(credits, r"\([^)]*\)", "")
    parts = F.transform(F.split(flat, r"[\n*|;]| and | & |,\s*(?=\p{Lu})"), lambda p: F.trim(p))
    kept = F.filter(parts, lambda p: (p != "") & (F.length(p) <= 80) & ~p.rlike("[0-9]"))
    return F.slice(F.array_distinct(kept), 1, most)


def sensitive_lines(texts: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(id, line_no, kind) of the lines that match one of the patterns."""
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    kinds = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), k) for k, p in patterns.items())))
    return lines.select("id", F.col("line_no").cast("long").alias("line_no"), F.explode(kinds).alias("kind"))


def positions(rows: DataFrame, key: str) -> DataFrame:
    """1-based rank of each key in order, and how many there are."""
    keys = rows.select(key).distinct()
    return numbered(keys, [], [F.asc(key)], "rank").crossJoin(F.broadcast(keys.agg(F.count("*").alias("total"))))  # one row
