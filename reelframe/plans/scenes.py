"""Registered queries on scenes, audio sequences and recurring characters, and SQL that makes the same by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelframe.functions.numbers import jaccard
from reelframe.functions.ranks import in_order
from reelframe.operators import characters, dialogue, layers, scenes, scoring, sequences
from reelframe.sources.tables import hold

from .adapters import query
from .shots import _TC

#: Terms that occur in the test texts.
THEMES = {"feu": ["the", "tion"], "groupe": ["que", "eau"], "voiture/ville": ["und", "ung"], "refuge/intérieur": ["los", "cion"]}
FOLD = "trim(regexp_replace(lower(regexp_replace(strip_accents({0}), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_SEEN = "concat_ws(' ', " + ", ".join(f"nullif(trim({c}), '')" for c in ("description", "lieu", "echelle", "texte_role", "mots_cles", "machine_types", "lieu_decors", "objets_cles", "personnages_sujets")) + ")"
_TEXT = FOLD.format(_SEEN)
_STOP = ", ".join(f"'{w}'" for w in sorted(scenes.STOP))
_WHOLE = ", ".join(FOLD.format(f"nullif(trim({c}), '')") for c in scenes.SIGNED if c != "attitudes_expressions")
_SIGNED = f"list_distinct(list_filter(list_concat(string_split({_TEXT}, ' '), [{_WHOLE}]), lambda w: length(w) >= 4 AND w NOT IN ({_STOP})))"
_ORDER = scenes.order_of(THEMES)
_HAS = [f"CASE WHEN {' OR '.join(f"contains(t, '{x}')" for x in terms)} THEN {{}} END" for terms in THEMES.values()]
_TAGS = ", ".join(["CASE WHEN generique THEN 1 END", *(h.format(i) for i, h in enumerate(_HAS, 2))])
_ALIKE = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END"
_MAIN = f"list_sort(list_transform(range(1, {len(_ORDER) + 1}), lambda i: [-len(list_filter({{0}}, lambda x: x = i)), i]))[1][2]"

#: Scenes by the stated rules: shots are read one after the other, then neighbours are joined, one step a row.
_MEMBERS = f"""WITH RECURSIVE marked AS (SELECT *, CASE WHEN len(m) = 0 THEN [{len(_ORDER)}] ELSE m END AS tags FROM (SELECT *, list_filter([{_TAGS}], lambda x: x IS NOT NULL) AS m FROM
 (SELECT *, {_TEXT} AS t, {_SIGNED} AS sig, row_number() OVER (PARTITION BY film_id ORDER BY debut, n) AS r FROM shots) a) b),
grown AS (SELECT film_id, r, 1 AS scene, debut AS start, fin AS stop, 1 AS size, tags AS every, sig AS words, tags, sig FROM marked WHERE r = 1
 UNION ALL SELECT film_id, r, scene + CASE WHEN cut THEN 1 ELSE 0 END, CASE WHEN cut THEN debut ELSE start END, fin, CASE WHEN cut THEN 1 ELSE size + 1 END, CASE WHEN cut THEN tags ELSE list_concat(every, tags) END, CASE WHEN cut THEN sig ELSE list_distinct(list_concat(words, sig)) END, tags, sig
 FROM (SELECT *, list_contains(tags, 1) <> list_contains(ptags, 1) OR NOT list_contains(every, 1) AND (size >= 12
  OR size >= 2 AND stop - start >= 135 AND likeness < 0.14
  OR size >= 2 AND stop - start >= 18 AND list_min(tags) <> list_min(ptags) AND {_ALIKE.format("sig", "psig")} < 0.05 AND likeness < 0.05
  OR size >= 6 AND stop - start >= 45 AND likeness < 0.045 AND len(list_intersect(tags, every)) = 0
  OR size >= 10 AND stop - start >= 70 AND likeness < 0.08 AND list_min(tags) <> {_MAIN.format("every")}) AS cut
 FROM (SELECT s.film_id, s.r, s.debut, s.fin, s.tags, s.sig, g.scene, g.start, g.stop, g.size, g.every, g.words, g.tags AS ptags, g.sig AS psig, {_ALIKE.format("s.sig", "g.words")} AS likeness FROM grown g JOIN marked s ON s.film_id = g.film_id AND s.r = g.r + 1) c) d),
groups AS (SELECT film_id, list({{'a': a, 'b': b, 'st': st, 'en': en, 'm': m}} ORDER BY a) AS rest FROM (SELECT film_id, scene, min(r) AS a, max(r) AS b, min(start) AS st, max(stop) AS en, list_distinct(flatten(list(tags))) AS m FROM grown GROUP BY film_id, scene) x GROUP BY film_id),
steps AS (SELECT film_id, rest, rest[1:0] AS done, false AS changed FROM groups
 UNION ALL SELECT film_id, CASE WHEN joins THEN rest[3:] WHEN len(rest) > 0 THEN rest[2:] ELSE done END,
  CASE WHEN joins THEN list_append(done, {{'a': rest[1].a, 'b': rest[2].b, 'st': rest[1].st, 'en': rest[2].en, 'm': list_distinct(list_concat(rest[1].m, rest[2].m))}}) WHEN len(rest) > 0 THEN list_append(done, rest[1]) ELSE rest[1:0] END,
  CASE WHEN joins THEN true WHEN len(rest) > 0 THEN changed ELSE false END
 FROM (SELECT *, len(rest) >= 2 AND NOT list_contains(rest[1].m, 1) AND NOT list_contains(rest[2].m, 1) AND (rest[1].b = rest[1].a OR rest[2].en - rest[1].en < 10) AND len(list_intersect(rest[1].m, rest[2].m)) > 0 AND rest[2].b - rest[1].a < 12 AND rest[2].en - rest[1].st <= 150 AS joins FROM steps) s WHERE len(rest) > 0 OR changed),
made AS (SELECT film_id, unnest(done) AS g, generate_subscripts(done, 1) AS scene FROM steps WHERE len(rest) = 0 AND NOT changed),
members AS (SELECT marked.*, CAST(made.scene AS BIGINT) AS scene FROM marked JOIN made ON marked.film_id = made.film_id AND marked.r BETWEEN made.g.a AND made.g.b)"""


def _featured(shots: DataFrame) -> DataFrame:
    return scenes.signed(scenes.tagged(shots, THEMES))


def _distilled(shots: DataFrame) -> DataFrame:
    return scenes.distilled(scenes.tagged(shots, THEMES), THEMES)


@query("shots", oracle=f"""SELECT film_id, n, coalesce(nullif(concat_ws('|', CASE WHEN generique THEN 'générique' END, {', '.join(h.format(f"'{name}'") for name, h in zip(THEMES, _HAS, strict=True))}), ''), 'continuité') AS tags FROM (SELECT film_id, n, generique, {_TEXT} AS t FROM shots) x""")
def shot_tags(shots: DataFrame) -> DataFrame:
    return scenes.tagged(shots, THEMES).select("film_id", "n", F.array_join("tags", "|").alias("tags"))


@query("shots", oracle=f"SELECT film_id, n, CAST(len({_SIGNED}) AS BIGINT) AS words, md5(array_to_string(list_sort({_SIGNED}), '|')) AS digest FROM shots")
def shot_signatures(shots: DataFrame) -> DataFrame:
    return scenes.signed(shots).select("film_id", "n", F.size("signature").cast("long").alias("words"), F.md5(F.array_join("signature", "|")).alias("digest"))


@query("shots", oracle=f"WITH s AS (SELECT film_id, n, {_SIGNED} AS g FROM shots) SELECT a.film_id, a.n, round({_ALIKE.format('a.g', 'b.g')}, 9) AS likeness FROM s a JOIN s b ON a.film_id = b.film_id AND a.n + 1 = b.n")
def neighbour_likeness(shots: DataFrame) -> DataFrame:
    rows = scenes.signed(shots).select("film_id", "n", "signature")
    rows = rows.withColumn("next", F.lead("signature").over(Window.partitionBy("film_id").orderBy("n"))).where("next is not null")
    return rows.select("film_id", "n", F.round(jaccard(F.col("signature"), F.col("next")), 9).alias("likeness"))


@query("shots", oracle=f"SELECT film_id, {_TEXT.replace('x00', 'x00')} AS seen, n FROM shots")
def visible_texts(shots: DataFrame) -> DataFrame:
    """All that can be searched of a shot, folded."""
    from reelframe.functions.text import fold, joined

    return shots.select("film_id", "n", fold(joined(shots, scenes.VISIBLE)).alias("seen"))


@query("shots", oracle=f"{_MEMBERS} SELECT film_id, n, scene FROM members")
def scene_members(shots: DataFrame) -> DataFrame:
    return scenes.scenes_of(_distilled(shots), THEMES)


_N = len(_ORDER)
_COUNT = "len(list_filter(tg, lambda x: x = {0}))"
_BEST = f"list_sort(list_transform(range(1, {len(THEMES) + 2}), lambda i: [-{_COUNT.format('i')}, i]))[1]"
_SHORT = "list_transform([{{'t': trim(regexp_replace({0}, '\\s+', ' ', 'g')), 'n': {1}}}], lambda s: CASE WHEN length(s.t) <= s.n THEN s.t ELSE concat(regexp_replace(regexp_replace(substr(s.t, 1, s.n), ' [^ ]*$', ''), '[ .,;:]+$', ''), '…') END)[1]"
_HINT = " ".join(f"WHEN {' AND '.join('(' + ' OR '.join(f"contains(h, '{t}')" for t in g.split('|')) + ')' for g in groups)} THEN '{said}'" for groups, said in scenes.HINTS)
_KINDS = "[" + ", ".join(f"'{t}'" for t in _ORDER) + "]"
_MOMENTS = " ".join(f"WHEN contains(words, {FOLD.format(f"'{m}'")}) THEN '{m}'" for m in scenes.MOMENTS)
#: What the themes of the test texts are called, and what is at stake in them; those left out have the general words.
LABELS = {"feu": "Autour du feu", "groupe": "Rencontre d’un groupe"}
STAKES = {"feu": "Affrontement autour des flammes."}
_NAMES = "[" + ", ".join(f"'{(scenes.LABELS | LABELS).get(t, scenes.LABELS[scenes.FLOW])}'" for t in _ORDER) + "]"
_AT_STAKE = "[" + ", ".join(f"'{(scenes.STAKES | STAKES).get(t, scenes.STAKES[scenes.FLOW])}'" for t in _ORDER) + "]"
_LISTS = {"o": "objets_cles", "d": "lieu_decors", "m": "mots_cles", "a": "machine_types", "p": "personnages_sujets"}
_NEUTRAL = ", ".join(f"'{w}'" for w in scenes.NEUTRAL)
_COMMON = ", ".join(f"'{w}'" for w in scenes.GENERIC)


def _tells(c: str) -> str:
    short = _SHORT.format(f"trim({c})", 90)
    return f"{{'t': {short}, 'k': {FOLD.format(short)}}}"


#: Terms of a list, most frequent first, first seen first; then each folded form once.
_BY_COUNT = "list_transform(list_sort(list_transform(list_distinct({0}), lambda v: {{'c': -len(list_filter({0}, lambda x: x = v)), 'p': list_position({0}, v), 'v': v}})), lambda s: s.v)"
_ONCE = "list_filter({0}, lambda x, i: x.k <> '' AND list_position(list_transform({0}, lambda y: y.k), x.k) = i)[1:{1}]"
_SPECIFIC = f"list_filter({{0}}, lambda x: lower(x.t) NOT IN ({_COMMON}))"
_TOLD = "array_to_string(list_transform({0}, lambda x: x.t), '{1}')"
_SCENES = f"""{_MEMBERS},
told_of AS (SELECT *, {", ".join(f"{_tells(c)} AS t_{k}" for k, c in _LISTS.items())} FROM members),
gathered AS (SELECT film_id, scene, list(n ORDER BY n) AS plans, count(*) AS size, min_by(debut, n) AS debut, max_by(fin, n) AS fin, flatten(list(tags ORDER BY n)) AS tg, coalesce(list(trim(lieu) ORDER BY n) FILTER (trim(lieu) <> ''), []) AS lx,
 {", ".join(f"coalesce(list(t_{k} ORDER BY n) FILTER (t_{k}.t <> '' AND t_{k}.k NOT IN ({_NEUTRAL})), []) AS l_{k}" for k in _LISTS)},
 list(coalesce(description, '') ORDER BY n) AS ds, string_agg(t, ' ' ORDER BY n) AS words, {FOLD.format("string_agg(nullif(trim(texte_role), ''), ' ' ORDER BY n)")} AS role FROM told_of GROUP BY film_id, scene),
ordered AS (SELECT *, {", ".join(f"{_BY_COUNT.format(f'l_{k}')} AS b_{k}" for k in _LISTS)}, {_BY_COUNT.format("lx")}[1] AS l1 FROM gathered),
picked AS (SELECT *, {", ".join(f"{_SPECIFIC.format(f'b_{k}')} AS s_{k}" for k in "odm")}, {_ONCE.format("b_d", 3)} AS d3, {_ONCE.format("b_a", 8)} AS a8, {_ONCE.format("b_p", 8)} AS p8 FROM ordered),
pooled AS (SELECT *, {_ONCE.format("s_o", 10)} AS o10, {_ONCE.format("s_d", 8)} AS d8, {_ONCE.format("s_m", 10)} AS m10, list_concat({_ONCE.format("s_o", 10)}, {_ONCE.format("s_d", 8)}, {_ONCE.format("s_m", 10)}, a8) AS pool FROM picked),
motived AS (SELECT *, list_transform({_ONCE.format("w", 10)}, lambda x: x.t) AS motifs FROM (SELECT *, {_SPECIFIC.format(_BY_COUNT.format("pool"))} AS w FROM pooled) x),
typed AS (SELECT *, CASE WHEN {_COUNT.format(1)} = size THEN 1 WHEN {_BEST}[1] < 0 AND -{_BEST}[1] >= greatest(1, size // 3) THEN {_BEST}[2] WHEN {_COUNT.format(_N - 1)} >= greatest(1, size // 2) THEN {_N - 1} ELSE {_MAIN.format("tg")} END AS k,
 {_TOLD.format("list_concat(o10, d8, m10)", " ").replace("x.t", "x.k")} AS h, list_filter([{_SHORT.format("ds[1]", 230)}, {_SHORT.format("ds[CAST(size // 2 + 1 AS BIGINT)]", 230)}, {_SHORT.format("ds[-1]", 220)}], lambda x: x <> '') AS told FROM motived),
hinted AS (SELECT *, list_filter(told, lambda x, i: list_position(list_transform(told, lambda y: {FOLD.format("y")}), {FOLD.format("x")}) = i) AS once,
 {_COUNT.format(1)} BETWEEN 1 AND size - 1 OR size > 10 AND {_COUNT.format("k")} < greatest(2, size // 3) OR size > 1 AND fin - debut > 180 AS doubt,
 CASE WHEN k = 1 THEN CASE WHEN plans[1] <= 25 THEN 'Générique d’ouverture' WHEN plans[1] > 500 OR contains(role, 'fin') AND plans[1] > 400 THEN 'Générique de fin' ELSE 'Générique' END ELSE {_NAMES}[k] END AS label,
 concat({_AT_STAKE}[k], CASE WHEN len(motifs) > 0 AND k NOT IN (1, {_N - 1}) THEN concat(' Motifs dominants : ', array_to_string(motifs[1:3], ', '), '.') ELSE '' END) AS action FROM typed),
rows_ AS (SELECT film_id, scene, printf('scene_%03d', scene) AS scene_id, scene AS numero_scene, concat(printf('Scène %03d — ', scene), label, CASE WHEN k = 1 THEN '' WHEN len(motifs) > 0 THEN concat(' — ', array_to_string(motifs[1:2], ', ')) ELSE concat(' — plans ', plans[1], '-', plans[-1]) END) AS titre,
 {_KINDS}[k] AS type_scene, plans[1] AS plan_debut, plans[-1] AS plan_fin, array_to_string(plans, ',') AS plans, round_even(debut, 3) AS debut, round_even(fin, 3) AS fin, round_even(fin - debut, 3) AS duree, {_TC.format("debut")} AS tc_debut, {_TC.format("fin")} AS tc_fin,
 CASE WHEN len(once) > 0 THEN {_SHORT.format("array_to_string(once, ' ')", 620)} ELSE '{scenes.UNTOLD}' END AS resume_scene, {_SHORT.format(f"concat_ws(' — ', coalesce(l1, 'indéterminé'), nullif({_TOLD.format('d3', ', ')}, ''))", 220)} AS lieu,
 CASE {_MOMENTS} ELSE 'indéterminée' END AS temporalite, {_SHORT.format("action", 260)} AS action_principale, {_SHORT.format(_TOLD.format("m10[1:5]", ", "), 220)} AS ambiance, {_TOLD.format("p8", "|")} AS personnages_visibles, {_TOLD.format("o10", "|")} AS objets_significatifs,
 array_to_string(motifs, '|') AS motifs_structurants, {_SHORT.format("action", 320)} AS enjeu_narratif,
 {_SHORT.format(f"CASE {_HINT} ELSE concat('{scenes.AROUND}', CASE WHEN len(motifs) > 0 THEN array_to_string(motifs[1:6], ', ') ELSE '{scenes.SAME}' END, '{scenes.CAUTION}') END", 620)} AS contexte_pour_plans,
 CASE WHEN doubt THEN 'moyenne' ELSE 'bonne' END AS confiance, doubt AS a_verifier FROM hinted)"""
_JOINED = {"plans": ",", "personnages_visibles": "|", "objets_significatifs": "|", "motifs_structurants": "|"}


def _rows(shots: DataFrame) -> DataFrame:
    """Scene rows; lists as texts."""
    rows = hold(_distilled(shots))
    made = scenes.described(rows, scenes.scenes_of(rows, THEMES), THEMES, labels=LABELS, stakes=STAKES)
    return made.withColumns({c: F.array_join(F.col(c).cast("array<string>"), sign) for c, sign in _JOINED.items()})


@query("shots", oracle=f"{_SCENES} SELECT * FROM rows_")
def scene_rows(shots: DataFrame) -> DataFrame:
    return _rows(shots)


_AS = "scene_id, numero_scene AS scene_numero, titre AS scene_titre, type_scene AS scene_type, resume_scene AS scene_resume, lieu AS scene_lieu, temporalite AS scene_temporalite, action_principale AS scene_action_principale, ambiance AS scene_ambiance, personnages_visibles AS scene_personnages_visibles, objets_significatifs AS scene_objets_significatifs, motifs_structurants AS scene_motifs_structurants, enjeu_narratif AS scene_enjeu_narratif, contexte_pour_plans AS scene_contexte, confiance AS scene_confiance, a_verifier AS scene_a_verifier"


@query("shots", oracle=f"{_SCENES} SELECT s.film_id, s.n, r.* EXCLUDE (film_id, plan_debut, plan_fin) FROM shots s LEFT JOIN (SELECT film_id, plan_debut, plan_fin, {_AS} FROM rows_ WHERE scene % 4 <> 2) r ON s.film_id = r.film_id AND s.n BETWEEN r.plan_debut AND r.plan_fin")
def shot_scenes(shots: DataFrame) -> DataFrame:
    """What each shot takes over from its scene; every fourth scene isn't there, so its shots have none."""
    return scenes.with_scene(shots.select("film_id", "n"), _rows(shots).where("scene % 4 <> 2"))


@query("shots", oracle=f"""{_MEMBERS}, x AS (SELECT film_id, scene, n, pos, {_tells("v")} AS s FROM (SELECT film_id, scene, n, unnest([0, 1, 2]) AS pos, unnest([lieu_decors, objets_cles, personnages_sujets]) AS v FROM members) y),
c AS (SELECT film_id, scene, s.t AS t, s.k AS k, count(*) AS c, min([n, pos]) AS f FROM x WHERE s.t <> '' AND s.k NOT IN ({_NEUTRAL}, '') AND lower(s.t) NOT IN ({_COMMON}) GROUP BY ALL)
SELECT film_id, scene, string_agg(t, ' | ' ORDER BY c DESC, f, t) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY film_id, scene ORDER BY c DESC, f, t) AS r FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY film_id, scene, k ORDER BY c DESC, f, t) = 1) u) w WHERE r <= 8 GROUP BY film_id, scene""")
def scene_terms(shots: DataFrame) -> DataFrame:
    rows = _featured(shots)
    placed = rows.join(scenes.scenes_of(rows, THEMES), ["film_id", "n"])
    fields = F.array(*(F.coalesce(F.trim(c), F.lit("")) for c in ("lieu_decors", "objets_cles", "personnages_sujets")))
    return scenes.frequent_terms(placed.withColumn("x", fields), "x", 8, ["film_id", "scene"])


@query(
    "shots",
    oracle=f"""{_MEMBERS}, worn AS (SELECT film_id, n, scene FROM members WHERE n % 7 <> 0 UNION ALL SELECT film_id, n, scene + 1 FROM members WHERE n % 11 = 0)
SELECT film_id, 'gap' AS fault, scene AS number FROM worn GROUP BY film_id, scene HAVING max(n) - min(n) + 1 <> count(*) UNION ALL SELECT film_id, 'lost', n FROM shots WHERE (film_id, n) NOT IN (SELECT (film_id, n) FROM worn) UNION ALL SELECT film_id, 'twice', n FROM worn GROUP BY film_id, n HAVING count(*) > 1""",
)
def scene_faults(shots: DataFrame) -> DataFrame:
    """Faults of scenes that have lost every seventh shot, and have every eleventh one in the next scene too."""
    made = hold(scenes.scenes_of(_distilled(shots), THEMES))
    worn = made.where("n % 7 <> 0").unionByName(made.where("n % 11 = 0").withColumn("scene", F.col("scene") + 1))
    return scenes.faults(shots, worn)


@query("shots", oracle=f"{_MEMBERS} SELECT film_id, n, CASE WHEN n % 2 = 0 THEN 1 WHEN n % 5 = 0 THEN least(2, scene_max) ELSE scene END AS scene FROM (SELECT *, max(scene) OVER (PARTITION BY film_id) AS scene_max FROM members) x")
def scene_lookup(shots: DataFrame) -> DataFrame:
    """Shots of even numbers state the first scene, every other fifth one stands in the second scene's list (the last
    one's, where there is only one); the others are looked up by their number."""
    made = scenes.scenes_of(_distilled(shots), THEMES).groupBy("film_id", "scene").agg(F.min("n").alias("plan_debut"), F.max("n").alias("plan_fin"), F.format_string("scene_%03d", F.first("scene")).alias("scene_id"))
    made = hold(made)
    listed = shots.where("n % 5 = 0").groupBy("film_id").agg(F.collect_list("n").alias("plans"))
    last = made.groupBy("film_id").agg(F.least(F.lit(2), F.max("scene")).alias("scene"))
    made = made.join(last.join(listed, "film_id"), ["film_id", "scene"], "left")
    keyed = shots.select("film_id", "n", F.when(F.col("n") % 2 == 0, "scene_001").alias("scene_id"))
    return scenes.looked_up(keyed, made).select("film_id", "n", "scene")


# sequences

_WINDOWS = """WITH RECURSIVE scored AS (SELECT s.film_id, s.n, s.debut, greatest(s.debut, s.fin) AS fin, row_number() OVER (PARTITION BY s.film_id ORDER BY s.debut, s.n) AS r, CAST(CASE WHEN h.n IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN duree >= 8 THEN 1 ELSE 0 END + CASE WHEN duree >= 20 THEN 1 ELSE 0 END AS BIGINT) AS score
 FROM shots s LEFT JOIN (SELECT DISTINCT s.film_id, s.n FROM shots s JOIN segments t ON s.film_id = t.film_id AND least(s.fin, t.fin) - greatest(s.debut, t.debut) > 0.05) h ON s.film_id = h.film_id AND s.n = h.n),
bounds AS (SELECT film_id, list(debut ORDER BY r) AS s, list(fin ORDER BY r) AS e, list(n ORDER BY r) AS ns FROM scored GROUP BY film_id),
ways AS (SELECT film_id, r AS i, r AS a, r AS b, 0 AS k, score, s, e FROM scored JOIN bounds USING (film_id) WHERE score >= 4
 UNION ALL SELECT film_id, i, CASE WHEN k < 6 THEN CASE WHEN k % 2 = 0 AND lft THEN a - 1 ELSE a END WHEN first_left THEN a - 1 ELSE a END, CASE WHEN k < 6 THEN CASE WHEN k % 2 = 1 AND rgt THEN b + 1 ELSE b END WHEN first_left THEN b ELSE b + 1 END, least(k + 1, 6), score, s, e
 FROM (SELECT *, lft AND (NOT rgt OR [greatest(0.0, s[a] - e[a - 1]), e[b] - s[a - 1]] <= [greatest(0.0, s[b + 1] - e[b]), e[b + 1] - s[a]]) AS first_left
  FROM (SELECT *, a > 1 AND s[a] - e[a - 1] <= 1.2 AND e[b] - s[a - 1] <= 90 AS lft, b < len(s) AND s[b + 1] - e[b] <= 1.2 AND e[b + 1] - s[a] <= 90 AS rgt FROM ways) x) y WHERE k < 6 OR e[b] - s[a] < 45 AND (lft OR rgt)),
placed AS (SELECT film_id, i, score, min(a) AS a, max(b) AS b FROM ways GROUP BY ALL),
sorted AS (SELECT p.*, s, e, row_number() OVER (PARTITION BY film_id ORDER BY a, b, i) AS w FROM placed p JOIN bounds USING (film_id)),
united AS (SELECT film_id, w, a, b, score, 1 AS grp FROM sorted WHERE w = 1
 UNION ALL SELECT film_id, w, CASE WHEN joins THEN least(pa, a) ELSE a END, CASE WHEN joins THEN greatest(pb, b) ELSE b END, CASE WHEN joins THEN greatest(ps, score) ELSE score END, grp + CASE WHEN joins THEN 0 ELSE 1 END
 FROM (SELECT n.film_id, n.w, n.a, n.b, n.score, u.a AS pa, u.b AS pb, u.score AS ps, u.grp, n.a <= u.b + 1 AND n.e[greatest(u.b, n.b)] - n.s[least(u.a, n.a)] <= 90 AS joins FROM united u JOIN sorted n ON n.film_id = u.film_id AND n.w = u.w + 1) x),
windows AS (SELECT u.film_id, ns[u.a] AS first, ns[u.b] AS last, s[u.a] AS debut, e[u.b] AS fin, u.score FROM (SELECT *, row_number() OVER (PARTITION BY film_id, grp ORDER BY w DESC) AS k FROM united) u JOIN bounds USING (film_id) WHERE k = 1)"""


def _windows(shots: DataFrame, segments: DataFrame) -> DataFrame:
    return sequences.candidates(scoring.sound(dialogue.with_dialogue(shots, segments)), 4)


@query("shots", "segments", oracle=f"{_WINDOWS} SELECT * FROM windows")
def audio_windows(shots: DataFrame, segments: DataFrame) -> DataFrame:
    return _windows(shots, segments)


@query("shots", "segments", oracle=f"{_WINDOWS} SELECT film_id, first, score, row_number() OVER (ORDER BY score DESC, film_id, debut) AS position FROM windows")
def ranked_windows(shots: DataFrame, segments: DataFrame) -> DataFrame:
    """Windows in the order of their ranking, with their place in it."""
    rows = sequences.ranked(_windows(shots, segments))
    return in_order(rows.select("film_id", "first", "score"), "position")


_PACKED = """WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY film_id ORDER BY debut, n) AS r FROM shots),
packed AS (SELECT film_id, r, n AS first, n AS last, debut, fin, 1 AS grp FROM s WHERE r = 1
 UNION ALL SELECT film_id, r, CASE WHEN new THEN n ELSE first END, n, CASE WHEN new THEN b ELSE a END, f, grp + CASE WHEN new THEN 1 ELSE 0 END
 FROM (SELECT s.film_id, s.r, s.n, p.first, p.debut AS a, s.debut AS b, s.fin AS f, p.grp, s.debut - p.fin > 1.2 OR p.fin - p.debut >= 45 OR s.fin - p.debut > 90 AS new FROM packed p JOIN s ON s.film_id = p.film_id AND s.r = p.r + 1) x),
windows AS (SELECT film_id, first, last, debut, fin FROM (SELECT *, row_number() OVER (PARTITION BY film_id, grp ORDER BY r DESC) AS k FROM packed) y WHERE k = 1)"""


@query("shots", oracle=f"{_PACKED} SELECT * FROM windows")
def packed_sequences(shots: DataFrame) -> DataFrame:
    return sequences.packed(shots)


@query("shots", oracle=f"{_PACKED} SELECT s.film_id, s.n, w.first, w.last FROM s LEFT JOIN windows w ON s.film_id = w.film_id AND s.n BETWEEN w.first AND w.last")
def shot_sequences(shots: DataFrame) -> DataFrame:
    """The audio sequence that each shot belongs to."""
    groups = sequences.packed(shots).select("film_id", F.sequence("first", "last").alias("plans"), "first", "last")
    return layers.last_member(groups, shots.select("film_id", "n"), ["first", "last"], "first")


_GAPS = "SELECT film_id, n, debut + CASE WHEN n % 5 = 0 THEN 2.5 ELSE 0 END AS debut, fin FROM shots"


@query("shots", oracle=f"SELECT film_id, n, CAST(sum(CASE WHEN debut - p <= 1.2 THEN 0 ELSE 1 END) OVER (PARTITION BY film_id ORDER BY debut, n) AS BIGINT) AS island FROM (SELECT *, lag(fin) OVER (PARTITION BY film_id ORDER BY debut, n) AS p FROM ({_GAPS}) y) x")
def contiguous_runs(shots: DataFrame) -> DataFrame:
    """Runs of contiguous shots where every fifth one begins two and a half seconds late."""
    late = F.col("debut") + F.when(F.col("n") % 5 == 0, 2.5).otherwise(0.0)
    return sequences.islands(shots.withColumn("debut", late)).select("film_id", "n", F.col("island").cast("long").alias("island"))


# characters

_DOT = "list_dot_product({0}, {1})"
_CLUSTERS = f"""WITH RECURSIVE v AS (SELECT film_id, n, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY film_id ORDER BY n) AS r FROM faces),
led AS (SELECT film_id, r, n, 0 AS cluster, [v] AS centres, [1] AS counts FROM v WHERE r = 1
 UNION ALL SELECT film_id, r, n, pick - 1, CASE WHEN pick > len(centres) THEN list_append(centres, v) ELSE list_transform(centres, lambda c, i: CASE WHEN i = pick THEN unit ELSE c END) END, CASE WHEN pick > len(counts) THEN list_append(counts, 1) ELSE list_transform(counts, lambda c, i: CASE WHEN i = pick THEN c + 1 ELSE c END) END
 FROM (SELECT *, list_transform(mean, lambda x: x / sqrt({_DOT.format("mean", "mean")})) AS unit FROM (SELECT *, list_transform(v, lambda x, i: (coalesce(centres[pick][i], 0) * coalesce(counts[pick], 0) + x) / (coalesce(counts[pick], 0) + 1)) AS mean
  FROM (SELECT *, CASE WHEN list_max(sims) < 0.3 THEN len(centres) + 1 ELSE list_position(sims, list_max(sims)) END AS pick
  FROM (SELECT v.film_id, v.r, v.n, v.v, l.centres, l.counts, list_transform(l.centres, lambda c: {_DOT.format("c", "v.v")} / (sqrt({_DOT.format("c", "c")}) * sqrt({_DOT.format("v.v", "v.v")}) + 1e-9)) AS sims FROM led l JOIN v ON v.film_id = l.film_id AND v.r = l.r + 1) a) b) c) d),
clusters AS (SELECT film_id, n, CAST(cluster AS BIGINT) AS cluster FROM led)"""


@query("faces", oracle=f"{_CLUSTERS} SELECT * FROM clusters")
def face_clusters(faces: DataFrame) -> DataFrame:
    return characters.clustered(faces, 0.3)


def _persons(persons: DataFrame) -> DataFrame:
    lists = {c: F.split(c, r"\|") for c in ("genders", "ages", "subjects", "attitudes")}
    rows = persons.withColumns(lists)
    return rows.withColumns({"profile": characters.profile_key(F.col("genders"), F.col("ages")), "label": characters.profile_label(*(F.col(c) for c in lists))})


_SAYS = "list_filter(string_split({0}, '|'), lambda x: x <> '' AND " + FOLD.format("x") + " NOT IN ('genre indetermine', 'age indetermine', 'aucun', 'aucune', 'indetermine', 'indeterminee', 'non visible'))"
_KEYED = "array_to_string(list_sort(list_transform(list_filter(string_split({0}, '|'), lambda x: x <> '' AND " + FOLD.format("x") + " NOT IN ('genre indetermine', 'age indetermine')), lambda x: " + FOLD.format("x") + "))[1:2], '+')"
_PERSONS = f"""persons_ AS (SELECT *, concat({_KEYED.format("genders")}, '|', {_KEYED.format("ages")}) AS profile, coalesce(nullif(concat_ws(' · ', nullif(array_to_string({_SAYS.format("genders")}[1:2], '/'), ''), nullif(array_to_string({_SAYS.format("ages")}[1:2], '/'), ''),
 list_filter({_SAYS.format("subjects")}[1:2], lambda x: length({FOLD.format("x")}) > 4)[1], list_filter({_SAYS.format("attitudes")}[1:2], lambda x: length({FOLD.format("x")}) > 4)[1]), ''), '{characters.NAMELESS}') AS label FROM persons)"""


@query("persons", oracle=f"WITH {_PERSONS} SELECT film_id, profile, count(DISTINCT n) AS shots, min(n) AS first FROM persons_ WHERE persons AND profile <> '|' GROUP BY film_id, profile HAVING count(DISTINCT n) >= 6")
def profile_groups(persons: DataFrame) -> DataFrame:
    return characters.profiles(_persons(persons))


@query(
    "faces",
    "persons",
    oracle=f"""{_CLUSTERS}, {_PERSONS},
d AS (SELECT c.film_id, 0 AS source, CAST(cluster AS VARCHAR) AS k, cluster AS pos, c.n, scene_id, image, label FROM clusters c LEFT JOIN persons_ p ON c.film_id = p.film_id AND c.n = p.n
 UNION ALL SELECT film_id, 1, profile, min(n) OVER (PARTITION BY film_id, profile), n, scene_id, image, label FROM (SELECT * FROM persons_ WHERE persons AND profile <> '|') x QUALIFY count(*) OVER (PARTITION BY film_id, profile) >= 6),
named AS (SELECT film_id, source, k, label FROM d WHERE label <> '' GROUP BY film_id, source, k, label QUALIFY row_number() OVER (PARTITION BY film_id, source, k ORDER BY count(*) DESC, min(n)) = 1),
made AS (SELECT film_id, source, k, min(pos) AS pos, count(*) AS occurrences_visuelles, count(DISTINCT n) AS occurrences_plans, count(DISTINCT nullif(scene_id, '')) AS occurrences_scenes, string_agg(DISTINCT n, ',' ORDER BY n) AS plans, coalesce(string_agg(DISTINCT nullif(scene_id, ''), ',' ORDER BY nullif(scene_id, '')), '') AS scenes, coalesce(min_by(image, n) FILTER (image <> ''), '') AS vignette FROM d GROUP BY film_id, source, k HAVING source = 1 OR count(DISTINCT n) >= 2)
SELECT film_id, printf('personnage_%03d', r) AS personnage_id, printf('Personnage récurrent probable %03d', r) AS label, coalesce(l, 'personnage récurrent probable') AS profil_resume, occurrences_visuelles, occurrences_plans, occurrences_scenes, plans, scenes, vignette, CASE WHEN source = 0 THEN 'visage' ELSE 'profil' END AS methode, CASE WHEN source = 0 AND occurrences_plans >= 3 THEN 'moyenne' ELSE 'faible' END AS confiance
FROM (SELECT m.*, n.label AS l, row_number() OVER (PARTITION BY m.film_id ORDER BY occurrences_plans DESC, m.source, pos) AS r FROM made m LEFT JOIN named n ON m.film_id = n.film_id AND m.source = n.source AND m.k = n.k) x WHERE r <= 24""",
)
def recurring_characters(faces: DataFrame, persons: DataFrame) -> DataFrame:
    """Faces and profiles ranked together, with scenes, labels and images; lists as texts."""
    made = characters.recurring(characters.clustered(faces, 0.3), _persons(persons))
    return made.withColumns({"plans": F.array_join(F.col("plans").cast("array<string>"), ","), "scenes": F.array_join("scenes", ",")})
