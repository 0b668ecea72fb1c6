"""Registered queries that write film documents, indexes and streams made of the test tables, and read them again."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.operators import publish
from reelframe.sources import documents as sources
from reelframe.sources.tables import folder, hold
from reelframe.streaming import incremental
from reelframe.streaming.ledger import Ledger

from .adapters import query


def _film_documents(shots: DataFrame) -> str:
    """A folder with one JSON document for each film; those of some films are cut off in the middle."""
    plan = F.struct("n", "debut", "fin", F.struct("echelle", "lieu", F.substring("description", 1, 30).alias("description")).alias("analyse"))
    films = shots.groupBy("film_id").agg(F.array_sort(F.collect_list(plan)).alias("plans"))
    text = F.to_json(F.struct(F.col("film_id").alias("film"), "plans"))
    damaged = F.when(F.col("film_id").like("%3-0"), F.substring(text, F.lit(1), F.length(text) - 5)).otherwise(text)
    path = folder(shots.sparkSession)
    films.select("film_id", damaged.alias("value")).repartition("film_id").write.partitionBy("film_id").option("lineSep", "\n").text(path)
    return path


def _documents(shots: DataFrame, film: str | None = None) -> DataFrame:
    return sources.film_documents(shots.sparkSession, _film_documents(shots), film, layout="film_id={film}/part-*")


_GOOD = "film_id NOT LIKE '%3-0'"


@query("shots", oracle=f"SELECT film_id, CAST(n AS INT) AS n, debut, fin, coalesce(echelle, '') AS echelle, coalesce(lieu, '') AS lieu, substr(description, 1, 30) AS description FROM shots WHERE {_GOOD}")
def scanned_shots(shots: DataFrame) -> DataFrame:
    """Shots of film documents that were written as JSON, flattened; damaged documents give none."""
    flat = publish.flattened(sources.shots(_documents(shots)))
    return flat.select("film_id", "n", "debut", "fin", "echelle", "lieu", "description")


@query("shots", oracle="SELECT DISTINCT film_id FROM shots WHERE film_id LIKE '%3-0'")
def damaged_documents(shots: DataFrame) -> DataFrame:
    return hold(sources.quarantined(_documents(shots))).select("film_id")


@query("shots", oracle="SELECT film_id, CAST(n AS INT) AS n, debut FROM shots WHERE film_id = 'src1-0'")
def one_film_scan(shots: DataFrame) -> DataFrame:
    """Shots of one film, of which only the folder is read."""
    return sources.shots(_documents(shots, "src1-0")).select("film_id", "n", "debut")


@query("shots", oracle="SELECT film_id, n, CASE WHEN film_id LIKE 'src1%' THEN debut + 1 ELSE debut END AS debut FROM shots")
def rewritten_index(shots: DataFrame) -> DataFrame:
    """An index by film, of which some films are written anew."""
    path = folder(shots.sparkSession)
    rows = shots.select("film_id", "n", "debut")
    publish.write_index(rows, path)
    publish.write_index(rows.where("film_id LIKE 'src1%'").withColumn("debut", F.col("debut") + 1), path)
    return shots.sparkSession.read.parquet(path).select("film_id", "n", "debut")


@query("shots", oracle="SELECT film_id, n, fin FROM shots")
def archived_shots(shots: DataFrame) -> DataFrame:
    path = folder(shots.sparkSession)
    publish.archive(shots.select("film_id", "n", "fin"), path, "a1")
    return shots.sparkSession.read.parquet(path).where("ts = 'a1'").select("film_id", "n", "fin")


@query("photos", oracle="SELECT photo_id, titre FROM photos")
def stored_photos(photos: DataFrame) -> DataFrame:
    """Photos from JSON stores of some thousands each."""
    path = folder(photos.sparkSession)
    part = F.floor(F.col("photo_id") / 2000).alias("part")
    stores = photos.groupBy(part).agg(F.to_json(F.struct(F.collect_list(F.struct("photo_id", "titre")).alias("photos"))).alias("value"))
    stores.repartition("part").write.partitionBy("part").option("lineSep", "\n").text(path)
    return sources.photo_store(photos.sparkSession, path, "photo_id: long, titre: string")


# streams


def _streamed(rows: DataFrame, parts: int, later: DataFrame | None = None) -> DataFrame:
    """rows as a stream of some files, in any order, and then later ones."""
    path = folder(rows.sparkSession)
    rows.repartition(parts).write.parquet(path)
    if later is not None:
        later.write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("files", oracle="SELECT path, CASE WHEN mtime % 4 = 2 THEN size + 50 ELSE size END AS size, mtime FROM files")
def settled_files(files: DataFrame) -> DataFrame:
    """Files from listings at 0, 25 and 50 seconds, in any order, and the folder itself much later.

    Every fourth file is seen once, every fourth one grows from listing to listing: both settle as time goes on, without
    being listed again. The folder itself hasn't stood long enough."""
    kind, at = F.col("mtime") % 4, F.explode(F.when(F.col("mtime") % 4 == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(25), F.lit(50)))).alias("at")
    rows = files.select("path", "size", "mtime", at)
    rows = rows.withColumn("size", F.when(kind == 2, F.col("size") + F.col("at")).otherwise(F.col("size")))
    rows = rows.select("path", "size", "mtime", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("at")).alias("seen"))
    path, spark = folder(files.sparkSession), files.sparkSession
    later = spark.sql("SELECT 'lib' AS path, 0L AS size, 0L AS mtime, timestamp_seconds(1700001000) AS seen")
    stream = _streamed(rows, 3, later)
    incremental.settled(stream, late="1 minute").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("path string, size long, mtime long").parquet(f"{path}/out")


@query("shots", oracle="SELECT film_id, n, CASE WHEN n % 3 = 0 THEN debut + 2 WHEN n % 3 = 1 THEN debut + 1 ELSE debut END AS debut FROM shots")
def refreshed_index(shots: DataFrame) -> DataFrame:
    """The index of shots that come in one to three versions, in any order."""
    rows = shots.select("film_id", "n", "debut", F.explode(F.sequence(F.lit(0), F.when(F.col("n") % 3 == 0, 2).when(F.col("n") % 3 == 1, 1).otherwise(0))).alias("version"))
    rows = rows.withColumn("debut", F.col("debut") + F.col("version"))
    path, spark = folder(shots.sparkSession), shots.sparkSession
    incremental.refresh(_streamed(rows, 4), f"{path}/index", f"{path}/state", availableNow=True).awaitTermination()
    return Ledger(spark, f"{path}/index").latest(rows.schema, "film_id").select("film_id", "n", "debut")


@query("events", oracle="SELECT DISTINCT user_id AS film_id, event_id % 4 AS version FROM events WHERE event_id % 4 >= 2")
def fresh_versions(events: DataFrame) -> DataFrame:
    """Versions of films that haven't been enriched: the first two have."""
    seen = events.select(F.col("user_id").alias("film_id"), (F.col("event_id") % 4).alias("version"))
    return incremental.newer(seen.distinct(), seen.where("version < 2"))


@query("states", oracle="SELECT film_id, count(*) FILTER (coalesce(mouvement_camera, '') <> '') AS measured, count(*) AS total FROM states GROUP BY film_id HAVING count(*) FILTER (coalesce(mouvement_camera, '') <> '') < count(*)")
def unmeasured_films(states: DataFrame) -> DataFrame:
    return incremental.unmeasured(states, F.coalesce("mouvement_camera", F.lit("")) != "")


@query("events", oracle="SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value + 1 ELSE value END AS value FROM events")
def delivered_once(events: DataFrame) -> DataFrame:
    """A stream of events that come twice, every third of them changed later, every fifth in an outdated form besides."""
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") % 50 + s)
    first = events.select("event_id", "value", at(10).alias("at"))
    changed = events.where("event_id % 3 = 0").select("event_id", (F.col("value") + 1).alias("value"), at(20).alias("at"))
    old = events.where("event_id % 5 = 0").select("event_id", (F.col("value") - 1).alias("value"), at(0).alias("at"))
    rows = first.unionByName(first).unionByName(changed).unionByName(old)
    path, spark = folder(events.sparkSession), events.sparkSession
    incremental.upserted(_streamed(rows, 4), "event_id", ["value"], "at", f"{path}/items", f"{path}/state", "5 minutes", availableNow=True).awaitTermination()
    return Ledger(spark, f"{path}/items").latest(rows.schema, "event_id").select("event_id", "value")


@query("shots", oracle="SELECT film_id, n, CAST(n * 2 AS VARCHAR) AS answer, CAST(NULL AS VARCHAR) AS error FROM shots")
def resumed_shots(shots: DataFrame) -> DataFrame:
    """Answers on a third of the films, written and committed, and a portion that was written only; then on all shots."""
    path, spark = folder(shots.sparkSession), shots.sparkSession
    work, ask = hold(shots.select("film_id", "n")), lambda rows: pd.DataFrame({"answer": (rows.n * 2).astype(str)})
    incremental.resumed(work.where("film_id LIKE 'src1%'"), path, ["film_id", "n"], ask, "answer string", 1000)
    Ledger(spark, path).write(work.select("film_id", "n", F.lit("torn").alias("answer"), F.lit("torn").alias("error")))  # its driver died here
    return incremental.resumed(work, path, ["film_id", "n"], ask, "answer string", max(1000, 1 + work.count() // 4))


@query("shots", oracle="SELECT film_id, n, CASE WHEN n % 7 = 0 THEN NULL ELSE CAST(n * 2 AS VARCHAR) END AS answer, CASE WHEN n % 7 = 0 THEN 'no answer' END AS error FROM shots")
def enriched_shots(shots: DataFrame) -> DataFrame:
    """Answers of a function that fails on some shots, asked shot by shot."""

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        if (rows.n % 7 == 0).any():
            raise ValueError("no answer")
        return pd.DataFrame({"answer": (rows.n * 2).astype(str)})

    return incremental.enriched(incremental.spread(shots.select("film_id", "n")), ask, "answer string", 1)


@query("shots", oracle="SELECT film_id, n, CASE WHEN bad THEN NULL ELSE concat(n, ' of ', k) END AS answer, CASE WHEN bad THEN 'no answer' END AS error FROM (SELECT film_id, n, count(*) OVER w AS k, bool_or(n % 31 = 0) OVER w AS bad FROM shots WINDOW w AS (PARTITION BY film_id, (n - 1) // 8)) x")
def batched_shots(shots: DataFrame) -> DataFrame:
    """Answers by batches of eight shots of a film, in order; a batch that holds a bad shot has no answers at all."""

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        if (rows.n % 31 == 0).any():
            raise ValueError("no answer")
        return pd.DataFrame({"answer": [f"{n} of {len(rows)}" for n in rows.n]})

    return incremental.enriched(shots.select("film_id", "n"), ask, "answer string", 8, ["film_id"], "n")
