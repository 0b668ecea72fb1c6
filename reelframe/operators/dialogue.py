"""Subtitle segments and shots: an interval join by time buckets, digests and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelframe.functions.numbers import overlap

LEAST = 0.05


def attached(shots: DataFrame, segments: DataFrame, bucket: float = 30.0) -> DataFrame:
    """(film_id, n, debut, fin, texte, common) of each segment and each shot that it overlaps by more than LEAST.

    Both sides are exploded into buckets of time, so the join has an equality on film and bucket and no film is one
    group; a pair counts in the bucket where its overlap begins, so it isn't found twice."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.greatest(F.col(a), F.col(b)) / bucket)))
    s = shots.select("film_id", "n", F.col("debut").alias("a"), F.col("fin").alias("b")).withColumn("bucket", span("a", "b"))
    t = segments.select("film_id", "debut", "fin", "texte").withColumn("bucket", span("debut", "fin"))
    common = overlap(F.col("a"), F.col("b"), F.col("debut"), F.col("fin"))
    rows = s.join(t, ["film_id", "bucket"]).where((common > LEAST) & (F.col("bucket") == F.floor(F.greatest("a", "debut") / bucket)))
    return rows.select("film_id", "n", "debut", "fin", "texte", common.alias("common"))


def with_dialogue(shots: DataFrame, segments: DataFrame) -> DataFrame:
    """Shots with their segments in order, number of them and joined text; silent shots stay."""
    heard = attached(shots, segments).groupBy("film_id", "n").agg(F.array_sort(F.collect_list(F.struct("debut", "fin", "texte"))).alias("dialogues"))
    rows = shots.join(heard, ["film_id", "n"], "left")
    count = F.coalesce(F.size("dialogues"), F.lit(0)).cast("long")
    return rows.withColumns({"n_segments": count, "dialogue": count > 0, "dialogue_texte": F.coalesce(F.array_join(F.col("dialogues.texte"), " "), F.lit(""))})


def digest(lines: DataFrame, group: list[str], limit: int = 900) -> DataFrame:
    """Lines of (group, n, texte) as "plan n : text", those that begin alike once, joined and cut."""
    start = F.substring("texte", 1, 160)
    first = Window.partitionBy(*group, start).orderBy("n")
    rows = lines.where("texte <> ''").withColumn("_r", F.row_number().over(first)).where("_r = 1")
    rows = rows.withColumn("_t", F.concat(F.lit("plan "), F.col("n").cast("string"), F.lit(" : "), "texte"))
    # lines that begin beyond the limit are cut off anyway, so they aren't gathered
    before = F.sum(F.length("_t") + 3).over(Window.partitionBy(*group).orderBy("n", "_t").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") <= limit + 3)
    listed = F.array_sort(F.collect_list(F.struct("n", F.col("_t").alias("t"))))
    text = F.array_join(F.transform(listed, lambda x: x["t"]), " | ")
    rows = rows.groupBy(*group).agg(text.alias("text"))
    return rows.withColumn("text", F.when(F.length("text") > limit, F.concat(F.rtrim(F.substring("text", 1, limit)), F.lit("…"))).otherwise(F.col("text")))
