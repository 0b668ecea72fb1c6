"""Encyclopedia pages: infobox fields, lead, sections, poster and caption from wiki markup, all as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.functions.text import first_truthy, squashed

from .documents import plain_text

#: Headings of sections that tell the story, and endings of image files.
STORY = ["Plot", "Synopsis", "Premise", "Plot summary"]
IMAGES = ["jpg", "jpeg", "png", "webp", "gif", "tif", "tiff", "svg"]
_BRACES = r"\{\{|\}\}"


def _balanced(text: Column) -> Column:
    """Length of the text up to the braces that close the first ones, null if they don't."""
    state = "struct<depth:int,at:int,end:int>"
    signs, gaps = F.regexp_extract_all(text, F.lit(_BRACES), F.lit(0)), F.split(text, _BRACES)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("end")).cast(state)

    def step(a: Column, x: Column) -> Column:
        at = a["at"] + F.length(x["gap"]) + 2
        depth = a["depth"] + F.when(x["sign"] == "{{", 1).otherwise(-1)
        return F.struct(depth.alias("depth"), at.alias("at"), F.coalesce(a["end"], F.when(depth == 0, at)).alias("end")).cast(state)

    pairs = F.filter(F.arrays_zip(signs.alias("sign"), gaps.alias("gap")), lambda x: x["sign"].isNotNull())
    return F.aggregate(pairs, start, step)["end"]


def infobox(markup: Column) -> Column:
    """The text of the first infobox, empty if there is none or it has no end."""
    at = F.instr(F.lower(markup), "{{infobox")
    rest = F.substring(markup, at, F.length(markup))
    return F.when(at > 0, F.coalesce(F.substring(rest, F.lit(1), _balanced(rest)), F.lit(""))).otherwise("")


def fields(box: Column) -> Column:
    """Map of an infobox's fields: a line that begins with a bar outside of inner braces and brackets opens one, other
    lines go on with it. Of fields with one name the last counts."""
    state = "struct<open:int,rows:array<struct<k:string,v:string>>>"
    count = lambda line, sign: F.regexp_count(line, F.lit(sign))

    def step(a: Column, line: Column) -> Column:
        name, value = F.lower(F.replace(F.trim(F.regexp_extract(line, r"^\|([^=]*)=", 1)), F.lit(" "), F.lit("_"))), F.trim(F.regexp_extract(line, r"(?s)^\|[^=]*=(.*)$", 1))
        n = F.size(a["rows"])
        last = F.element_at(a["rows"], -1)
        longer = F.concat(F.slice(a["rows"], 1, F.greatest(n, F.lit(1)) - 1), F.array(F.struct(last["k"].alias("k"), F.concat(last["v"], F.lit("\n"), F.trim(line)).alias("v"))))
        opens = (a["open"] == 0) & line.rlike(r"^\|[^=]*=")
        rows = F.when(opens, F.concat(a["rows"], F.array(F.struct(name.alias("k"), value.alias("v"))))).when(n > 0, longer).otherwise(a["rows"])
        depth = a["open"] + count(line, r"\{\{|\[\[") - count(line, r"\}\}|\]\]")
        return F.struct(depth.alias("open"), rows.alias("rows")).cast(state)

    # the braces that close the box belong to no field
    inner = F.regexp_replace(box, r"\}\}$", "")
    lines = F.slice(F.split(inner, "\n"), 2, 1 << 30)
    rows = F.aggregate(lines, F.struct(F.lit(0).alias("open"), F.array().cast("array<struct<k:string,v:string>>").alias("rows")).cast(state), step)["rows"]
    names = F.array_distinct(rows["k"])
    value = lambda k: F.trim(F.element_at(F.filter(rows, lambda r: r["k"] == k), -1)["v"])
    return F.map_from_arrays(names, F.transform(names, value))


def lead(markup: Column, limit: int = 700) -> Column:
    """The first paragraph with text, before any heading and without the boxes at the top."""
    box = infobox(markup)
    text = F.when(box != "", F.replace(markup, box, F.lit(""))).otherwise(markup)
    before = F.split(text, r"(?m)^==")[0]
    told = F.filter(F.transform(F.split(before, "\n\n"), lambda p: plain_text(p, limit)), lambda p: p != "")
    return F.coalesce(F.get(told, F.lit(0)), F.lit(""))


def section(markup: Column, titles: list[str], limit: int = 2200) -> Column:
    """Text of the first section under one of the headings, up to the next heading."""
    heading = rf"(?im)^==+\s*(?:{'|'.join(titles)})\s*==+\s*$"
    parts = F.split(markup, heading, 2)
    body = F.split(F.get(parts, F.lit(1)), r"(?m)^==+\s*[^=].*?==+\s*$")[0]
    return F.coalesce(plain_text(body, limit), F.lit(""))


def poster(value: Column) -> Column:
    """The image file that a field names."""
    bare = F.regexp_replace(value, r"(?is)<!--.*?-->|<ref[^>]*>.*?</ref>|<ref[^/]*/>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)\[\[(?:File|Image):([^\]|]+).*?\]\]", "$1"), r"\{\{[^{}]*\}\}", " ")
    names = F.transform(F.split(F.replace(bare, F.lit("_"), F.lit(" ")), r"[\n|]"), lambda m: F.trim(F.regexp_replace(F.regexp_replace(m, r"^[\[\] ]+|[\[\] ]+$", ""), r"(?i)^(?:File|Image):", "")))
    return F.coalesce(F.get(F.filter(names, lambda m: m.rlike(rf"(?i)\.(?:{'|'.join(IMAGES)})$")), F.lit(0)), F.lit(""))


def extracted(pages: DataFrame, body: str = "body") -> DataFrame:
    """page columns but the body, then infobox (map), pitch, scenario, poster_fichier and poster_legende."""
    rows = pages.withColumn("infobox", fields(infobox(F.col(body))))
    of = lambda *names: first_truthy(*(F.try_element_at("infobox", F.lit(n)) for n in names))
    return rows.select(
        *(c for c in pages.columns if c != body),
        "infobox",
        lead(F.col(body)).alias("pitch"),
        section(F.col(body), STORY).alias("scenario"),
        poster(of("image", "poster", "image_name")).alias("poster_fichier"),
        plain_text(of("caption", "image_caption", "alt"), 320).alias("poster_legende"),
    )


def page_titles(files: DataFrame, overrides: DataFrame, hits: DataFrame) -> DataFrame:
    """(file_name, page): the override of a file, else the first search hit for its title, year and "film", else the title.

    files: (file_name, titre, annee); overrides: (file_name, page); hits: (query, rank, page)"""
    asked = files.withColumn("query", squashed(F.concat_ws(" ", "titre", F.col("annee").cast("string"), F.lit("film"))))
    first = hits.groupBy("query").agg(F.min_by("page", "rank").alias("_hit"))
    rows = asked.join(overrides.select("file_name", F.col("page").alias("_own")), "file_name", "left").join(first, "query", "left")
    return rows.select("file_name", first_truthy(F.col("_own"), F.col("_hit"), F.col("titre")).alias("page"))
