"""Published tables: compact and full shot indexes, film list, selections, resumable results, archives, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.functions.numbers import decade, timecode
from reelframe.functions.ranks import numbered
from reelframe.functions.text import first_truthy, slug, squashed
from reelframe.sources.tables import hold


def flattened(shots: DataFrame, films: DataFrame | None = None) -> DataFrame:
    """Shots of film documents as flat rows: nested fields as columns, a typed default for what is missing."""
    rows = shots
    if "analyse" in shots.columns:
        inner = [f for f in shots.schema["analyse"].dataType.fields]
        rows = rows.select(*[c for c in shots.columns if c != "analyse"], *(F.col(f"analyse.{f.name}").alias(f.name) for f in inner))
    default = {"string": F.lit(""), "boolean": F.lit(False), "array<string>": F.array().cast("array<string>")}
    cols = [F.coalesce(F.col(f.name), default[k]).alias(f.name) if (k := f.dataType.simpleString()) in default and f.name != "film_id" else F.col(f.name) for f in rows.schema]
    rows = rows.select(*cols, timecode(F.col("debut")).alias("timecode"))
    if films is None:
        return rows
    return rows.join(films.select("film_id", "titre", "annee", decade(F.col("annee")).alias("decennie")), "film_id", "left")


def visible(documents: DataFrame) -> DataFrame:
    """Shots that count: proposals of a non-destructive re-cut where there are any, else the originals.

    documents: (film_id, strategie, plans, plans_proposes)"""
    recut = F.col("strategie").startswith("non-destructive-add-only") & (F.size("plans_proposes") > 0)
    return documents.select("film_id", F.inline(F.when(F.coalesce(recut, F.lit(False)), F.col("plans_proposes")).otherwise(F.col("plans"))))


def write_index(shots: DataFrame, path: str) -> None:
    """One folder per film; only the films at hand are overwritten."""
    shots.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("film_id").parquet(path)


def archive(old: DataFrame, path: str, stamp: str) -> None:
    """Keeps shots as they were before a re-cut."""
    old.write.mode("errorifexists").parquet(f"{path}/ts={stamp}")


def pending(work: DataFrame, results: DataFrame, *key: str) -> DataFrame:
    """Work whose key has no result yet; results are appended, so a rerun goes on where the last one stopped."""
    return work.join(results.select(*key).distinct(), list(key), "left_anti")


def selection(ids: DataFrame, shots: DataFrame) -> DataFrame:
    """Rows of the selected "film#n" ids in their order, each once; an id that is malformed or has no shot is an error.

    ids: (pos, id)"""
    part = F.split("id", "#")
    wanted = ids.groupBy("id").agg(F.min("pos").alias("pos"))
    wanted = wanted.select("id", "pos", part[0].alias("film_id"), F.try_element_at(part, F.lit(2)).try_cast("long").alias("n"))
    rows = wanted.join(shots.withColumn("_known", F.lit(True)), ["film_id", "n"], "left")
    checked = F.when(F.col("_known"), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("no such shot: "), "id")))
    return rows.withColumn("id", checked).drop("_known").orderBy("pos")


def media_of(shots: DataFrame, title: Column) -> Column:
    """The media of a selected shot in order, as (role, fichier): thumbnail, numbered thumbnails, preview. A file has one
    place in the export; what is missing or repeated in the shot has the place it had.

    shots: vignette, vignettes, apercu, film_id, n"""
    place = F.concat(slug(title), F.lit("_"), "film_id", F.format_string("/plan_%05d/", "n"))
    numbered_ = F.transform(F.coalesce("vignettes", F.array().cast("array<string>")), lambda v, i: F.struct(F.concat(F.lit("vignette_"), i.cast("string")).alias("role"), v.alias("path")))
    every = F.concat(F.array(F.struct(F.lit("vignette").alias("role"), F.col("vignette").alias("path"))), numbered_, F.array(F.struct(F.lit("apercu").alias("role"), F.col("apercu").alias("path"))))
    there = F.filter(every, lambda m: F.coalesce(m["path"], F.lit("")) != "")
    return F.transform(there, lambda m: F.struct(m["role"].alias("role"), F.concat(place, F.element_at(F.split(m["path"], "/"), -1)).alias("fichier")))


def credits(film: DataFrame, functions: dict[str, str]) -> DataFrame:
    """film_id and a map of label to names, without empty entries."""
    pairs = F.create_map(*(x for label, c in functions.items() for x in (F.lit(label), F.col(c))))
    return film.select("film_id", F.map_filter(pairs, lambda _, v: F.coalesce(v, F.lit("")) != "").alias("credits"))


def all_names(*lists: Column) -> Column:
    """Distinct names of several lists, in order regardless of case."""
    flat = F.array_distinct(F.filter(F.flatten(F.array(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists))), lambda x: x != ""))
    return F.transform(F.array_sort(F.transform(flat, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))), lambda x: x["v"])


def prompt(lines: list[tuple[str, Column, int]]) -> Column:
    """Labelled lines of a request: each cut to its length, empty ones and repeated values left out."""
    texts = F.array(*(F.struct(F.lit(label).alias("label"), F.substring(squashed(F.coalesce(c.cast("string"), F.lit(""))), 1, n).alias("text")) for label, c, n in lines))
    kept = F.filter(texts, lambda x: x["text"] != "")
    seen = F.transform(kept, lambda x, i: F.struct(x["label"].alias("label"), x["text"].alias("text"), i.alias("i")))
    lows = F.transform(kept, lambda x: F.lower(x["text"]))
    once = F.filter(seen, lambda x: F.array_position(lows, F.lower(x["text"])) == x["i"] + 1)
    return F.array_join(F.transform(once, lambda x: F.concat_ws(" : ", x["label"], x["text"])), "\n")


def known_music(items: Column) -> Column:
    """Documented music as "title — author (usage · confidence)", apart by semicolons; items without both are left out.

    items: array of structs with titre, auteur, compositeur, artiste, usage, type and confiance"""
    filled = lambda sign, *parts: F.array_join(F.filter(F.array(*(F.coalesce(p, F.lit("")) for p in parts)), lambda x: x != ""), sign)

    def line(i: Column) -> Column:
        name = filled(" — ", i["titre"], first_truthy(i["auteur"], i["compositeur"], i["artiste"]))
        more = filled(" · ", first_truthy(i["usage"], i["type"]), i["confiance"])
        return F.when((name != "") & (more != ""), F.concat(name, F.lit(" ("), more, F.lit(")"))).otherwise(name)

    return F.coalesce(F.array_join(F.filter(F.transform(items, line), lambda x: x != ""), " ; "), F.lit(""))


#: What the parts of a request begin with.
FILM_MARK, SCENE_MARK = "Contexte du film, à utiliser avec prudence :", "Contexte de scène, à utiliser pour désambiguïser le plan :"
TASK_MARKS = ["Question unique :", "Réponds uniquement par un objet JSON"]


def prompt_parts(prompt: Column, film: str = FILM_MARK, scene: str = SCENE_MARK, tasks: list[str] | None = None) -> Column:
    """Struct (constant, film, scene) of a request: what all have, what a film's have, what is the scene's own.

    The parts begin on the lines with their marks; the opening and the task are the constant one. Without a task the
    whole request is constant. Requests sorted by constant and film share the longest beginnings."""
    let = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  a value that is worked out once
    cut = lambda a, b: F.regexp_replace(F.substring(prompt, a, b - a), r"(?U)^\s+|\s+$", "")

    def line(text: Column, marks: list[str]) -> Column:
        """Where the line with the first of the marks begins, null if there is none."""
        first = F.array_min(F.array_compact(F.array(*(F.nullif(F.instr(text, F.lit(m)), F.lit(0)) for m in marks))))
        return let(first, lambda at: at - F.instr(F.reverse(F.concat(F.lit("\n"), F.substring(prompt, F.lit(1), at - 1))), "\n") + 1)

    def parts(task: Column, f: Column, s: Column) -> Column:
        opening = cut(F.lit(1), F.array_min(F.array_compact(F.array(f, s, task))))
        whole = let(opening, lambda o: F.when(o != "", F.concat(o, F.lit("\n\n"), cut(task, F.length(prompt) + 1))).otherwise(cut(task, F.length(prompt) + 1)))
        of_film = F.coalesce(F.when(f.isNotNull(), cut(f, F.when(s > f, s).otherwise(task))), F.lit(""))
        of_scene = F.coalesce(F.when(s.isNotNull(), cut(s, task)), F.lit(""))
        return F.struct(whole.alias("constant"), of_film.alias("film"), of_scene.alias("scene"))

    none = F.struct(prompt.alias("constant"), F.lit("").alias("film"), F.lit("").alias("scene"))
    before = lambda task: F.substring(prompt, F.lit(1), task - 1)
    found = lambda task: let(line(before(task), [film]), lambda f: let(line(before(task), [scene]), lambda s: parts(task, f, s)))
    return let(line(prompt, TASK_MARKS if tasks is None else tasks), lambda task: F.when(task.isNotNull(), found(task)).otherwise(none))


def images(shots: DataFrame, files: DataFrame, keys: list[str], purpose: str = "first", k: int = 3) -> DataFrame:
    """(keys, pos, path): the images of a shot that there are, in the order of their use.

    shots have keys, vignettes (array), vignette and frames (array); files: (path). first: the first k thumbnails that
    exist, else the main one; face: the middle thumbnail, else any; full: the frames, else thumbnails, else the main one."""
    none = F.array().cast("array<string>")
    list_of = lambda c: F.filter(F.coalesce(F.col(c), none), lambda v: F.coalesce(v, F.lit("")) != "")
    thumbs, main = list_of("vignettes"), F.filter(F.array("vignette"), lambda v: F.coalesce(v, F.lit("")) != "")
    middle = F.when(F.size(thumbs) >= 2, F.slice(thumbs, F.floor(F.size(thumbs) / 2).cast("int") + 1, 1)).otherwise(none)
    # groups of candidates: the first group of which one exists is used
    groups = {
        "first": [F.slice(thumbs, 1, k), main],
        "face": [F.concat(middle, F.when(F.size(thumbs) > 0, thumbs).otherwise(main))],
        "full": [list_of("frames"), F.when(F.size(thumbs) > 0, thumbs).otherwise(main)] if purpose == "full" else [],
    }[purpose]
    ordered = lambda n: lambda v, i: F.struct(F.lit(n).alias("g"), i.alias("i"), v.alias("path"))
    listed = F.flatten(F.array(*(F.transform(F.array_distinct(g), ordered(n)) for n, g in enumerate(groups))))
    rows = shots.select(*keys, F.inline(listed)).join(files.select("path").distinct(), "path", "left_semi")
    window = Window.partitionBy(*keys)
    rows = rows.withColumn("_g", F.min("g").over(window)).where("g = _g")
    rows = rows.withColumn("pos", F.row_number().over(window.orderBy("i")).cast("long"))
    return (rows.where("pos = 1") if purpose == "face" else rows).select(*keys, "pos", "path")


def sequence_images(sequences: DataFrame, images_: DataFrame) -> DataFrame:
    """(film_id, first, pos, path): the first image of the first, middle and last shot of a sequence, each path once.

    sequences: (film_id, first, last) of consecutive numbers; images_: (film_id, n, pos, path)"""
    n = F.array_distinct(F.array(F.col("first"), F.col("first") + F.floor((F.col("last") - F.col("first") + 1) / 2), F.col("last")))
    rows = sequences.select("film_id", "first", F.explode(n).alias("n")).join(images_.where("pos = 1").select("film_id", "n", "path"), ["film_id", "n"])
    once = rows.groupBy("film_id", "first", "path").agg(F.min("n").alias("n"))
    order = Window.partitionBy("film_id", "first").orderBy("n")
    return once.select("film_id", "first", F.row_number().over(order).cast("long").alias("pos"), "path")


def batched(requests: DataFrame, order: list[str], size: int = 6, each: int = 64) -> DataFrame:
    """Requests (with constant, film and scene as prompt_parts() makes them) with batch, pos and task, laid out so.

    A batch holds at most size requests with one constant part, those of one film side by side; pos is the place in it.
    Batches are numbered in the order of their constant parts; each consecutive ones are one task's, and no task has more.
    A constant part of very many requests is parted like any other, as places are counted in ranges of the order."""
    key = F.sha2("constant", 256)
    placed = numbered(requests.withColumn("_key", key), ["_key"], [F.asc("film"), *(F.asc(c) for c in order)], "_pos")
    placed = placed.withColumn("_part", F.floor((F.col("_pos") - 1) / size))
    batches = hold(numbered(placed.select("_key", "_part").distinct(), [], [F.asc("_key"), F.asc("_part")], "batch"))
    rows = placed.join(batches, ["_key", "_part"]).select(*requests.columns, (F.col("batch") - 1).alias("batch"), ((F.col("_pos") - 1) % size).alias("pos"))
    tasks = max(1, -(-batches.count() // each))
    rows = rows.withColumn("task", F.floor(F.col("batch") / each))
    return rows.repartitionById(tasks, F.col("task").cast("int")).sortWithinPartitions("batch", "pos")
