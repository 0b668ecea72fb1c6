"""Camera movement: medians of frame-pair measures, classes by rules, video labels, and the decision between both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Video labels and their names in the catalogue.
NAMES = {
    "arc_left": "arc gauche", "arc_right": "arc droite", "arc_cw": "arc horaire", "arc_ccw": "arc antihoraire", "dolly_in": "travelling avant", "dolly_out": "travelling arrière",
    "pan_left": "panoramique gauche", "pan_right": "panoramique droite", "pedestal_down": "pedestal bas", "pedestal_up": "pedestal haut", "roll_left": "rotation antihoraire",
    "roll_right": "rotation horaire", "static": "fixe", "tilt_down": "tilt bas", "tilt_up": "tilt haut", "truck_left": "travelling gauche", "truck_right": "travelling droite",
    "undefined": "indéterminé", "zoom_in": "zoom in", "zoom_out": "zoom out", "pov": "point de vue subjectif", "shake": "caméra portée", "track": "travelling de suivi",
    "tracking": "travelling de suivi", "side_tracking": "travelling de suivi latéral", "lead_tracking": "travelling de suivi frontal", "aerial_tracking": "travelling de suivi aérien",
    "complex_motion": "mouvement complexe", "no_motion": "fixe",
}
#: Names in the order in which one is preferred.
PREFERRED = ["caméra portée", "travelling de suivi", "travelling de suivi latéral", "travelling de suivi frontal", "travelling de suivi aérien", "travelling avant", "travelling arrière", "travelling gauche", "travelling droite", "arc gauche", "arc droite", "arc horaire", "arc antihoraire", "panoramique gauche", "panoramique droite", "tilt haut", "tilt bas", "pedestal haut", "pedestal bas", "zoom in", "zoom out", "rotation horaire", "rotation antihoraire", "point de vue subjectif", "mouvement complexe", "fixe", "indéterminé"]
#: Measured and seen movements that look alike.
ALIKE = [("zoom in", "travelling avant"), ("zoom out", "travelling arrière"), ("panoramique gauche", "travelling gauche"), ("panoramique droite", "travelling droite"), ("tilt haut", "pedestal haut"), ("tilt bas", "pedestal bas")]
#: Movements for which measure and video can agree.
AGREEING = ["fixe", "zoom in", "zoom out", "panoramique gauche", "panoramique droite", "tilt haut", "tilt bas", "rotation horaire", "rotation antihoraire", "caméra portée"]
UNKNOWN, STILL, COMPLEX = "indéterminé", "fixe", "mouvement complexe"
MEASURES = {"dx": 5, "dy": 5, "scale_delta": 5, "rotation": 4, "jitter": 5, "inliers": 3}


def _gathered(pairs: DataFrame, *keys: str, more: tuple[str, ...] = ()) -> DataFrame:
    """The measures of the pairs of each group as one array: a group is one shot's pairs, so it is small."""
    return pairs.groupBy(*keys).agg(F.collect_list(F.struct(*more, *(F.col(m).cast("double").alias(m) for m in MEASURES))).alias("s"))


def _median(values: Column) -> Column:
    """The exact median of an array without nulls, 0 of none."""
    middle = lambda a, n: F.when(n > 0, 0.5 * F.get(a, F.floor((n - 1) / 2).cast("int")) + 0.5 * F.get(a, F.floor(n / 2).cast("int"))).otherwise(0.0)
    return F.transform(F.array(F.sort_array(values)), lambda a: middle(a, F.size(a)))[0]


def _medians(s: Column) -> list[Column]:
    of = lambda m: F.array_compact(F.transform(s, lambda x: x[m]))
    return [F.size(s).cast("long").alias("pairs"), *(_median(of(m)).alias(m) for m in MEASURES)]


def medians(pairs: DataFrame, *keys: str) -> DataFrame:
    """Number of pairs and exact medians of the six measures."""
    return _gathered(pairs, *keys).select(*keys, *_medians(F.col("s")))


def classified(rows: DataFrame) -> DataFrame:
    """rows of medians(), with camera, direction, intensity and confidence."""
    return rows.withColumns(_classes(F.struct(*(F.col(x) for x in ("pairs", *MEASURES)))))


def _classes(of: Column) -> dict[str, Column]:
    c = lambda m: of[m]
    amp = F.hypot(c("dx"), c("dy"))
    scale, rot = F.abs(c("scale_delta")), F.abs(c("rotation"))
    force = F.greatest(scale * 18, rot / 2.5, amp * 7, c("jitter") * 12)
    few = c("pairs") < 2
    level = F.when(force < 0.08, "faible").when(force < 0.22, "moyenne").otherwise("forte")
    rules: list[tuple[Column, Column, Column]] = [
        (few, F.lit(UNKNOWN), F.lit("")),
        ((c("jitter") > 0.012) & (amp > 0.006), F.lit("caméra portée"), F.lit("instable")),
        ((scale > 0.010) & (scale > amp * 0.8), F.when(c("scale_delta") > 0, "zoom in").otherwise("zoom out"), F.when(c("scale_delta") > 0, "avant").otherwise("arrière")),
        ((rot > 0.55) & (rot > amp * 20), F.when(c("rotation") > 0, "rotation horaire").otherwise("rotation antihoraire"), F.lit("rotation")),
        ((amp < 0.004) & (scale < 0.006) & (rot < 0.35), F.lit(STILL), F.lit("")),
        (F.abs(c("dx")) > F.abs(c("dy")) * 1.45, F.when(c("dx") < 0, "panoramique droite").otherwise("panoramique gauche"), F.lit("horizontal")),
        (F.abs(c("dy")) > F.abs(c("dx")) * 1.45, F.when(c("dy") < 0, "tilt bas").otherwise("tilt haut"), F.lit("vertical")),
    ]
    camera, direction = F.lit(COMPLEX), F.lit("mixte")
    for test, name, way in reversed(rules):
        camera, direction = F.when(test, name).otherwise(camera), F.when(test, way).otherwise(direction)
    sure = F.when(few, "douteux").when((c("inliers") > 0.55) & (c("pairs") >= 4), "sûr").when(c("inliers") > 0.35, "probable").otherwise("douteux")
    return {"camera": camera, "direction": direction, "intensity": F.when(few | (camera == STILL), "faible").otherwise(level), "confidence": sure}


def fused(pairs: DataFrame) -> DataFrame:
    """One movement for each shot_id over its segments: classes of the pooled pairs, or complex where segments differ."""
    # a shot's pairs are gathered once, for itself and for its segments
    shots = _gathered(pairs, "shot_id", more=("segment",))
    of = lambda g: F.filter("s", lambda x: x["segment"].eqNullSafe(g))
    segments = F.array_distinct(F.transform("s", lambda x: F.struct(x["segment"].alias("segment"))))
    made = F.transform(segments, lambda g: F.transform(F.array(of(g["segment"])), lambda s: F.struct(*_medians(s)))[0])
    kinds = F.array_distinct(F.filter(F.transform(made, lambda p: _classes(p)["camera"]), lambda c: ~c.isin(UNKNOWN, STILL)))
    rows = classified(shots.select("shot_id", *_medians(F.col("s")), F.size(kinds).alias("moving")))
    mixed = (F.col("moving") > 1) & F.col("shot_id").isNotNull()
    return rows.withColumns({"confidence": F.when(mixed, F.when(F.col("pairs") >= 3, "probable").otherwise("douteux")).otherwise(F.col("confidence")), "direction": F.when(mixed, "mixte").otherwise(F.col("direction")), "camera": F.when(mixed, COMPLEX).otherwise(F.col("camera"))}).drop("moving")


def named(label: Column) -> Column:
    key = F.replace(F.replace(F.lower(label), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    table = F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv))
    return F.coalesce(table[key], F.replace(key, F.lit("_"), F.lit(" ")))


def trust(score: Column) -> Column:
    return F.when(score >= 0.70, "sûr").when(score >= 0.45, "probable").otherwise("douteux")


def kept_labels(labels: DataFrame, least: float = 0.35, most: int = 6) -> DataFrame:
    """Labels of each segment that score enough, or the best one; at most so many, by score."""
    window = Window.partitionBy("shot_id", "segment").orderBy(F.desc("score"), "label")
    rows = labels.withColumns({"label": named(F.col("label")), "score": F.bround("score", 4)}).groupBy("shot_id", "segment", "label").agg(F.max("score").alias("score"))
    rows = rows.withColumn("rank", F.row_number().over(window))
    return rows.where(((F.col("score") >= least) | (F.col("rank") == 1)) & (F.col("rank") <= most))


def video_movement(labels: DataFrame) -> DataFrame:
    """One movement for each shot_id from kept_labels(): of each segment, then of the shot."""
    moving = F.count_distinct(F.when(~F.col("label").isin(STILL, UNKNOWN), F.col("label")))
    order = F.coalesce(F.array_position(F.array(*(F.lit(p) for p in PREFERRED)), F.col("label")).cast("int"), F.lit(999))
    segments = labels.groupBy("shot_id", "segment").agg(moving.alias("moving"), F.min_by("label", order).alias("first"), F.max("score").alias("score"))
    segments = segments.select("shot_id", "segment", F.when(F.col("moving") > 1, COMPLEX).otherwise(F.col("first")).alias("camera"), "score")
    useful = F.when(~F.col("camera").isin("", UNKNOWN, STILL), F.col("camera"))
    shot = segments.groupBy("shot_id").agg(F.count_distinct(useful).alias("kinds"), F.min_by(useful, F.when(useful.isNotNull(), F.col("segment"))).alias("moving"), F.min_by("camera", "segment").alias("any"), F.max("score").alias("score"))
    return shot.select("shot_id", F.when(F.col("kinds") > 1, COMPLEX).otherwise(F.coalesce("moving", "any")).alias("video"), trust(F.col("score")).alias("video_confidence"), "score")


def decided(measured: DataFrame, video: DataFrame) -> DataFrame:
    """final and conflict of each shot_id that has a measured camera, a video movement, or both."""
    rows = measured.select("shot_id", "camera").join(video.select("shot_id", "video", "video_confidence"), "shot_id", "full_outer")
    m, v = F.coalesce("camera", F.lit("")), F.coalesce("video", F.lit(""))
    agree = (m == v) & v.isin(AGREEING)
    preferred = F.when(F.coalesce("video_confidence", F.lit("douteux")).isin("sûr", "probable"), v).otherwise(m)
    unseen, unmeasured = v.isin("", UNKNOWN), m.isin("", UNKNOWN)
    final = F.when(unseen, F.when(m == "", UNKNOWN).otherwise(m)).when(unmeasured | agree, v).otherwise(preferred)
    pair = F.struct(m.alias("m"), v.alias("v"))
    alike = F.coalesce(pair.isin([F.struct(F.lit(a).alias("m"), F.lit(b).alias("v")) for a, b in ALIKE]), F.lit(False))
    basis = F.when(unseen, "mesure").when(unmeasured, "vidéo").when(agree, "accord").when(alike, "ambiguïté").otherwise("désaccord")
    return rows.select("shot_id", final.alias("final"), (~unseen & ~unmeasured & ~agree).alias("conflict"), basis.alias("basis"))


def compared(rows: DataFrame, columns: list[str], k: int = 15) -> DataFrame:
    """The k most frequent values of each column, missing ones named."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("non renseigné")).alias("value")) for c in columns))).alias("x")).select("x.*")
    counts = long.groupBy("metric", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("n"), "value")).cast("long")).where(F.col("rank") <= k)


def conflicts(shots: DataFrame) -> DataFrame:
    """The shots whose measured and video movements disagree, with what each says."""
    said = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("n/a")).alias(c)
    return shots.where(F.coalesce("mouvement_camera_conflit", F.lit(False))).select("film_id", "n", "tc", *(said(c) for c in ("mouvement_camera", "mouvement_video_camera", "mouvement_camera_final")))


def unclassed(shots: DataFrame) -> DataFrame:
    """How many shots are in conflict, and how many have a measured movement and no video class."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return shots.agg(F.count_if("mouvement_camera_conflit").alias("conflicts"), F.count_if(some("mouvement_camera") & ~some("mouvement_video_camera")).alias("without_video"))
