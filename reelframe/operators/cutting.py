"""Shots from frame scores: cuts, a second finer pass over long shots, clean bounds, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.functions.ranks import parted

SHORTEST = 0.04
EDGE = 0.05


def cuts(frames: DataFrame, threshold: float, clips: DataFrame) -> DataFrame:
    """(film_id, t) where the score passes a tenth of the threshold, away from the edges of (film_id, debut, fin)."""
    rows = frames.where(F.col("score") > _least(threshold)).join(clips.select("film_id", "debut", "fin"), "film_id")
    return rows.where(_within("debut", "fin")).select("film_id", F.bround("t", 3).alias("t"))


def _least(threshold: float) -> float:
    return min(1.0, max(0.01, threshold / 10))


def _within(start: str, end: str) -> Column:
    return (F.col("t") > F.col(start) + EDGE) & (F.col("t") < F.col(end) - EDGE)


def between(points: DataFrame, *keys: str) -> DataFrame:
    """Shots between consecutive points of time; those that are too short are dropped, and so what lies between equal
    points: they needn't be distinct."""
    window = Window.partitionBy(*keys).orderBy("t")
    rows = points.withColumn("fin", F.lead("t").over(window)).withColumnRenamed("t", "debut")
    return rows.where((F.col("fin") > F.col("debut")) & (F.bround(F.col("fin") - F.col("debut"), 6) >= SHORTEST))


def detect(frames: DataFrame, clips: DataFrame, threshold: float = 3.0) -> DataFrame:
    """(film_id, debut, fin) of the shots of each clip in one pass."""
    ends = clips.select("film_id", F.explode(F.array(F.bround("debut", 3), F.bround("fin", 3))).alias("t"))
    return between(parted(cuts(frames, threshold, clips).unionByName(ends), "film_id", given=frames), "film_id")


def detect_twice(frames: DataFrame, clips: DataFrame, threshold: float = 3.0, second: float | None = None, longest: float = 30.0) -> DataFrame:
    """detect(), with long shots cut again at a lower threshold; refined tells which pass made a shot.

    Frames and shots are rows of one sequence per film, in which the last start of a shot before a frame is carried
    forward: a shot is one row however long it is. Short shots go through the second pass without a cut."""
    shots = detect(frames, clips, threshold)
    least = _least(second or max(0.8, threshold * 0.6))
    fine = frames.where((F.col("score") > least) & F.col("film_id").isNotNull()).select("film_id", "t", F.lit(1).alias("kind"))
    rows = shots.select("film_id", F.col("debut").alias("t"), F.lit(0).alias("kind"), F.struct(F.col("debut").alias("a"), F.col("fin").alias("b")).alias("shot")).unionByName(fine, allowMissingColumns=True)
    before = Window.partitionBy("film_id").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parted(rows, "film_id", given=frames).withColumn("shot", F.last("shot", ignorenulls=True).over(before)).select("film_id", "t", "kind", "shot.a", "shot.b")
    cut = (F.col("b") - F.col("a") > longest) & _within("a", "b")
    points = F.when(F.col("kind") == 0, F.array("a", "b")).when(cut, F.array(F.bround("t", 3)))
    finer = between(placed.select("film_id", "a", "b", F.explode(points).alias("t")), "film_id", "a", "b")
    return finer.select("film_id", "debut", "fin", ((F.col("debut") > F.col("a")) | (F.col("fin") < F.col("b"))).alias("refined"))


def clean_bounds(bounds: DataFrame, gap: float = 0.08) -> DataFrame:
    """Shots from bounds that may overlap or leave holes: a start counts unless it is too near the last point."""
    rows = parted(bounds, "film_id").select("film_id", F.bround("debut", 3).alias("debut"), F.bround("fin", 3).alias("fin"), "pos").where("fin > debut")
    # the last point is always the end of the row before
    last = F.lag("fin").over(Window.partitionBy("film_id").orderBy("pos", "debut", "fin"))
    near = F.coalesce(F.bround(F.col("debut") - last, 6) < gap, F.lit(False))
    points = F.when(near, F.array("fin")).otherwise(F.array("debut", "fin"))
    return between(rows.withColumn("_t", points).select("film_id", F.explode("_t").alias("t")), "film_id")


def numbered(shots: DataFrame) -> DataFrame:
    window = Window.partitionBy("film_id").orderBy("debut", "fin")
    return shots.withColumns({"n": F.row_number().over(window).cast("long"), "duree": F.bround(F.col("fin") - F.col("debut"), 3)})
