"""The registered queries of the corpus operators, one for each, and oracle SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op4_bpe
from .decontaminate import op2_decontamination
from .embeddings import op6_embedding_dedup
from .language import op9_language_id
from .licenses import op8_license_scan
from .minhash import op10_minhash_dedup
from .pii import op1_pii
from .prefixes import op11_prefix_trie
from .quality import op3_quality
from .search import op12_lexical_search
from .sentences import op13_sentencepiece
from .toxicity import op7_toxicity
from .urls import op5_url_filter

QUERIES = {
    "op1_pii": op1_pii,
    "op2_decontamination": op2_decontamination,
    "op3_quality": op3_quality,
    "op4_bpe": op4_bpe,
    "op5_url_filter": op5_url_filter,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_license_scan": op8_license_scan,
    "op9_language_id": op9_language_id,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_lexical_search": op12_lexical_search,
    "op13_sentencepiece": op13_sentencepiece,
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_CONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0) x),
gram AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) s WHERE len(w) >= n) x),
hit AS (SELECT doc_id, k, gram.n, item_id FROM gram JOIN win ON gram.g = win.g AND gram.n = win.n),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) x GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN listed USING (doc_id)"""

_VECTORS = """
WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.93),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.vec_id)
SELECT r.vec_id, coalesce(any_value(n), 0) AS n_links, min(c) AS component_id, r.vec_id = min(c) AS kept FROM r LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) k ON r.vec_id = k.a GROUP BY r.vec_id"""

_NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])) END) AS g FROM d),
n AS (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.doc_id)
SELECT r.doc_id, any_value(n.n) AS n_shingles, min(c) AS component_id, r.doc_id = min(c) AS kept FROM r JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id"""

_LENGTHS = "coalesce(list_sum(list_transform({0}, lambda s: length(s))), 0)"
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"

_PRIVATE = rf"""
WITH t AS (SELECT doc_id, text, coalesce(text, '') AS s FROM documents),
raw AS (SELECT doc_id, text, kind, o, regexp_extract_all(s, p) AS m, string_split_regex(s, p) AS g FROM t, (VALUES ('email', 1, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), ('ip', 2, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'), ('card', 3, '[0-9](?:[ -]?[0-9])+'), ('phone', 4, '\+[0-9][ ().0-9-]+[0-9]')) k(kind, o, p)),
pos AS (SELECT doc_id, text, kind, o, m[i] AS x, CAST({_LENGTHS.format("g[1:i]")} + {_LENGTHS.format("m[1:i - 1]")} AS BIGINT) AS a FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw WHERE len(m) > 0) e),
good AS (SELECT *, a + length(x) AS b FROM pos WHERE CASE kind WHEN 'email' THEN true WHEN 'ip' THEN list_bool_and(list_transform(string_split(x, '.'), lambda s: coalesce(TRY_CAST(s AS HUGEINT) <= 255, false))) WHEN 'phone' THEN length({_DIGITS}) BETWEEN 8 AND 15
 ELSE length({_DIGITS}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 1 THEN 2 * CAST({_DIGITS}[i] AS INT) // 10 + 2 * CAST({_DIGITS}[i] AS INT) % 10 ELSE CAST({_DIGITS}[i] AS INT) END)) % 10 = 0 END),
cut AS (SELECT doc_id, text, regexp_extract_all(s, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS m, string_split_regex(s, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS g FROM t),
shadow AS (SELECT doc_id, text, array_to_string(list_transform(range(1, len(g) + 1), lambda i: concat(g[i], repeat(' ', coalesce(length(m[i]), 0)))), '') AS s FROM cut),
told AS (SELECT doc_id, text, s, list_distinct(list_transform(regexp_extract_all(s, '\p{{L}}{{4,}}'), lambda w: lower(w))) AS words FROM shadow),
near AS (SELECT DISTINCT doc_id, text, concat(kind, ':', CASE kind WHEN 'email' THEN lower(x) WHEN 'ip' THEN x ELSE {_DIGITS} END) AS entity FROM good),
ent AS (SELECT entity, count(*) AS n_entity FROM near GROUP BY entity HAVING count(DISTINCT text) >= 3),
seen AS (SELECT DISTINCT entity, doc_id, text, unnest(words) AS word FROM near JOIN ent USING (entity) JOIN told USING (doc_id, text)),
together AS (SELECT entity, word, count(*) AS both_ FROM seen GROUP BY ALL HAVING count(DISTINCT text) >= 3),
wrd AS (SELECT word, count(*) AS n_word FROM (SELECT unnest(words) AS word FROM told) w GROUP BY word),
terms AS (SELECT word, max(d) AS d FROM (SELECT word, greatest(0, ln(n * both_ / (n_entity * greatest(n_word, both_))) / ln(n / n_entity)) AS d FROM together JOIN ent USING (entity) JOIN wrd USING (word), (SELECT count(text) AS n FROM documents) c WHERE n_entity < n) x WHERE d >= 0.9 GROUP BY word),
found AS (SELECT doc_id, regexp_extract_all(s, '\p{{L}}{{4,}}') AS m, string_split_regex(s, '\p{{L}}{{4,}}') AS g FROM told WHERE list_has_any(words, coalesce((SELECT list(word) FROM terms), []))),
extra AS (SELECT doc_id, CASE WHEN d >= 0.98 THEN 'term_removed' ELSE 'term_generalised' END AS kind, a, a + n AS b FROM (SELECT doc_id, lower(m[i]) AS word, length(m[i]) AS n, CAST({_LENGTHS.format("g[1:i]")} + {_LENGTHS.format("m[1:i - 1]")} AS BIGINT) AS a FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found) e) w JOIN terms USING (word)),
spans AS (SELECT doc_id, kind, o, a, b FROM good UNION ALL SELECT doc_id, kind, 5, a, b FROM extra)
SELECT t.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
 sha256(coalesce(string_agg(concat_ws(':', kind, a, b), ',' ORDER BY o, kind, a, b) FILTER (o < 5), '')) AS base_sha256, coalesce(string_agg(concat_ws(':', kind, a, b), ',' ORDER BY o, kind, a, b) FILTER (o IS NOT NULL), '') AS spans
FROM t LEFT JOIN spans ON t.doc_id = spans.doc_id GROUP BY t.doc_id"""

_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT))),
 lambda p, q: list_reduce(list_prepend(xor(p, q), [0, 1, 2, 3, 4, 5, 6, 7]), lambda y, k: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295)"""

_TRIE = f"""
WITH t AS (SELECT conv_id, list({{'r': r, 't': t}} ORDER BY turn NULLS FIRST, r, t) AS s FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL) x GROUP BY conv_id),
h AS (SELECT conv_id, s, conv_id - conv_id % 100 AS base, CAST({_CRC} % 6 AS BIGINT) AS h FROM t),
b AS (SELECT h.conv_id, list_concat(coalesce(t.s, [])[1:h], h.s[h + 1:]) AS s FROM h LEFT JOIN t ON t.conv_id = h.base),
p AS (SELECT conv_id AS c, d, len(s) AS n, s[1:d] AS k, s[1:d - 1] AS up, CASE WHEN d = 0 THEN 0 ELSE length(s[d].t) END AS chars FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM b) x),
v AS (SELECT d, k, any_value(up) AS up, min(c) AS node, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d) AS ends FROM p GROUP BY d, k),
kid AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM v WHERE d > 0 GROUP BY ALL),
sub AS (SELECT a.d, a.k, count(*) FILTER (kid.n IS NULL) AS leaves, sum(v.saved) AS saved FROM v JOIN p ON p.c = v.node AND p.d <= v.d JOIN v a ON a.d = p.d AND a.k = p.k LEFT JOIN kid ON kid.d = v.d AND kid.k = v.k GROUP BY a.d, a.k)
SELECT v.node AS conv_id, v.d AS depth, CASE WHEN v.d > 0 THEN o.node END AS parent_conv_id, v.n_convs, coalesce(kid.n, 0) AS n_children, sub.leaves AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN sub ON sub.d = v.d AND sub.k = v.k LEFT JOIN kid ON kid.d = v.d AND kid.k = v.k LEFT JOIN v o ON o.d = v.d - 1 AND o.k = v.up"""

_RANKED = rf"""
WITH d AS (SELECT doc_id, len(w) AS n, w FROM (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents) x),
c AS (SELECT count(*) FILTER (n > 0) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM d),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark) x GROUP BY ALL),
f AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM d) x WHERE t IN (SELECT t FROM q) GROUP BY ALL),
v AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY t),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt)))) AS BIGINT) AS score FROM q JOIN v USING (t) JOIN f USING (t), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20"""

#: No entry where SQL cannot express the result (trained models, BPE); tests hold those against brute force or
#: held-out accuracy.
ORACLES: dict[str, str] = {"op1_pii": _PRIVATE, "op2_decontamination": _CONTAMINATION, "op6_embedding_dedup": _VECTORS, "op10_minhash_dedup": _NEAR, "op11_prefix_trie": _TRIE, "op12_lexical_search": _RANKED}
