"""Registered queries on layers and derived fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.operators import layers

from .adapters import query


@query("lineitem", "orders", oracle="SELECT o_custkey % 50 AS film_id, o_orderkey AS n, coalesce(k, 0) AS n_groups FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY l_orderkey) g ON o_orderkey = l_orderkey")
def shot_members(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Groups of one shot each: the line items of an order."""
    shots = orders.select((F.col("o_custkey") % 50).alias("film_id"), F.col("o_orderkey").alias("n"))
    rows = lineitem.select(F.col("l_orderkey").alias("n"), "l_partkey", "l_linenumber").join(shots, "n")
    groups = rows.select("film_id", F.array("n").alias("plans"), "l_partkey", "l_linenumber")
    return layers.members(groups, shots, ["l_partkey", "l_linenumber"], "groups").select("film_id", "n", F.size("groups").cast("long").alias("n_groups"))


_RATE = "least(12.0, greatest(2.0, 24 / greatest(fin - debut, 0.2)))"
_LEAST = f"greatest(0.08, 2.0 / greatest({_RATE}, 1.0))"


@query("shots", oracle=f"SELECT film_id, n, round(debut, 3) AS a, round(CASE WHEN n % 4 = 0 THEN debut + 0.2 ELSE fin END, 3) AS b, round({_RATE}, 6) AS rate, round(CASE WHEN greatest(fin - debut, 0.2) > {_LEAST} THEN greatest({_LEAST}, greatest(fin - debut, 0.2) - 3 / greatest({_RATE}, 1.0)) ELSE greatest(fin - debut, 0.2) END, 6) AS seconds FROM (SELECT film_id, n, debut, CASE WHEN n % 9 = 5 THEN debut + 0.1 ELSE fin END AS fin FROM shots) x")
def shot_previews(shots: DataFrame) -> DataFrame:
    """Bounds, rate and length of previews of at most 24 images, without their last three; some shots are very short."""
    rows = shots.withColumn("fin", F.when(F.col("n") % 9 == 5, F.col("debut") + 0.1).otherwise(F.col("fin")))
    a, b = layers.preview(F.col("debut"), F.when(F.col("n") % 4 == 0, F.col("debut")).otherwise(F.col("fin")))
    shape = (F.col("debut"), F.col("fin"), 12.0, 24)
    return rows.select("film_id", "n", a.alias("a"), b.alias("b"), F.round(layers.preview_rate(*shape), 6).alias("rate"), F.round(layers.preview_length(*shape, 3), 6).alias("seconds"))


@query("part", oracle="SELECT p_partkey AS photo_id, CASE WHEN p_size > 25 THEN 'paysage' WHEN p_size < 25 THEN 'portrait' ELSE 'carré' END AS orientation, p_size % 3 <> 0 AND p_size % 4 <> 1 AS fresh FROM part")
def photo_shapes(part: DataFrame) -> DataFrame:
    stored = F.when(F.col("p_size") % 4 == 1, F.struct((F.col("p_size") + 1).alias("s"))).otherwise(F.struct(F.col("p_size").alias("s")))
    fresh = layers.up_to_date(F.when(F.col("p_size") % 3 != 0, "told"), stored, F.struct(F.col("p_size").alias("s")))
    return part.select(F.col("p_partkey").alias("photo_id"), layers.orientation(F.col("p_size"), F.lit(25)).alias("orientation"), fresh.alias("fresh"))


@query("films", oracle="SELECT film_id, coalesce(titre, '') AS titre, annee, coalesce(pitch, '') <> '' AS pitch, coalesce(pitch, '') AS pitch_extrait, coalesce(pays, '') <> '' AS synopsis, annee % 2 = 0 AS scenario, CASE WHEN annee % 3 = 0 THEN 'a|b' ELSE '' END AS sources, CASE WHEN annee % 5 > 0 THEN concat('scene_', annee % 5) END AS scene_id, CASE WHEN annee % 5 > 0 THEN annee % 5 = 1 END AS resume_scene FROM films")
def context_provenance(films: DataFrame) -> DataFrame:
    """What requests on films and their scenes were given; every fifth film has no scene."""
    k = F.col("annee") % 5
    scene = F.when(k > 0, F.struct(F.concat(F.lit("scene_"), k.cast("string")).alias("scene_id"), k.alias("numero_scene"), F.lit(None).cast("string").alias("titre"), F.when(k == 1, "told").otherwise("").alias("resume_scene"), F.lit("").alias("contexte_pour_plans"), F.lit("v2").alias("methode")))
    film = layers.provenance(F.col("titre"), F.col("annee"), F.col("pitch"), F.col("pays"), F.when(F.col("annee") % 2 == 0, "x"), F.when(F.col("annee") % 3 == 0, F.array(F.lit("a"), F.lit("b"))))
    rows = films.select("film_id", film.alias("f"), layers.scene_provenance(scene).alias("s"))
    return rows.select("film_id", "f.*", "s.scene_id", "s.resume_scene").withColumn("sources", F.array_join("sources", "|"))


@query("films", oracle="SELECT film_id, CASE WHEN annee % 5 = 0 THEN 2 ELSE 0 END AS track FROM films")
def overridden_tracks(films: DataFrame) -> DataFrame:
    return layers.overridden(films.select("film_id", F.lit(0).alias("track")), films.where("annee % 5 = 0").select("film_id", F.lit(2).alias("track")), "film_id", "track")


@query("shots", oracle="SELECT film_id, n, CASE n % 3 WHEN 0 THEN concat('Au début du plan apparaît ', lang, '. Puis on voit ', film_id) WHEN 1 THEN concat('Un ', lang, ', puis ', film_id) ELSE lang END AS description FROM shots")
def single_shot_descriptions(shots: DataFrame) -> DataFrame:
    text = lambda *parts: F.concat(*(F.col(p) if p in shots.columns else F.lit(p) for p in parts))
    given = F.when(F.col("n") % 3 == 0, text("La première image affiche ", "lang", " , la seconde image montre  ", "film_id")).when(F.col("n") % 3 == 1, text("Un ", "lang", ", le deuxième plan ", "film_id")).otherwise(text(" ", "lang", " "))
    return shots.select("film_id", "n", layers.single_shot(given).alias("description"))


@query("segments", oracle="SELECT film_id, n, string_agg(CAST(debut AS VARCHAR), '|' ORDER BY debut) AS starts FROM (SELECT film_id, CAST(floor(debut / 60) AS BIGINT) AS n, debut FROM segments) x GROUP BY ALL")
def segment_timelines(segments: DataFrame) -> DataFrame:
    rows = layers.timeline(segments.withColumn("n", F.floor(F.col("debut") / 60)), "texte")
    return rows.select("film_id", "n", F.array_join(F.transform("timeline", lambda x: x["debut"].cast("string")), "|").alias("starts"))


_ROLLED = lambda c, name: f"coalesce(array_to_string(list_transform(list_sort(list_transform(list_distinct(flatten(list({c}))), lambda z: {{'k': lower(z), 'v': z}})), lambda s: s.v), '|'), '') AS {name}"


@query("events", oracle=f"""WITH seqs AS (SELECT user_id, event_type, CASE WHEN event_type = 'error' THEN [] ELSE [event_type, upper(event_type)] END AS fams, CASE WHEN event_id % 3 = 0 THEN [concat('é ', event_type)] ELSE [] END AS subs, CASE WHEN event_id % 5 = 0 THEN ['Vent', 'pluie'] ELSE ['vide'] END AS designs FROM events)
SELECT user_id AS film_id, count(*) AS sequences_count, count(*) FILTER (event_type <> 'error') AS sequences_musicales_count, {_ROLLED('fams', 'musique_familles')}, {_ROLLED('subs', 'musique_sous_genres')}, {_ROLLED('designs', 'design_sonore_types')} FROM seqs GROUP BY user_id""")
def audio_roll_up(events: DataFrame) -> DataFrame:
    """Audio sequences of each film, rolled up; lists as texts."""
    rows = events.selectExpr("user_id AS film_id", "event_type <> 'error' AS musique_presente", "CASE WHEN event_type <> 'error' THEN array(event_type, upper(event_type), '') END AS musique_familles", "CASE WHEN event_id % 3 = 0 THEN array('é ' || event_type) ELSE array() END AS musique_sous_genres", "CASE WHEN event_id % 5 = 0 THEN array('Vent', 'pluie') ELSE array('vide') END AS design_sonore_types")
    made = layers.rolled_up(rows)
    return made.withColumns({c: F.array_join(c, "|") for c in ("musique_familles", "musique_sous_genres", "design_sonore_types")})


@query("shots", oracle="SELECT film_id, n, duree FROM shots WHERE film_id = 'src3-0' AND n = 2")
def one_shot(shots: DataFrame) -> DataFrame:
    return layers.one(shots, "src3-0", 2).select("film_id", "n", "duree")
