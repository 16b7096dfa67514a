"""DuckDB SQL for the results of the queries that SQL can express.

No SQL: op1 (vocabulary merges), op5 (a fitted classifier), op8 (seeded draws) and op10 (all
200-byte strings of a table are too slow there). Tests hold those against plain versions.
"""

from __future__ import annotations

from .licenses import BLOCK_WORDS, PHRASES, TEMPLATES
from .mixing import MOST_COPIES, WEIGHTS

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = f"regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+')"
PLAIN = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {SPACED} AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]]
  ELSE list_distinct([words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) END AS grams FROM w),
n AS (SELECT doc_id, len(grams) AS n FROM s),
g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * n_both >= 80 * (a.n + b.n - n_both)),
ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT id, y FROM reach JOIN ways ON node = x)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT id, min(node) AS component_id FROM reach GROUP BY id) c ON c.id = n.doc_id
"""

_phrases = ", ".join(f"('{label}', string_split('{text}', ' '))" for text, label in PHRASES)
_templates = ", ".join(f"({k}, '{label}', list_distinct(string_split('{text}', ' ')))" for k, (text, label) in enumerate(TEMPLATES))
HALF = BLOCK_WORDS // 2

OP3 = f"""
WITH w AS (SELECT doc_id, {PLAIN} AS words FROM documents),
p(label, phrase) AS (VALUES {_phrases}),
places AS (SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w) JOIN p
  ON words[i] = phrase[1] AND words[i:i + len(phrase) - 1] = phrase),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
t(k, label, wanted) AS (VALUES {_templates}),
words_at AS (SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) // {HALF} AS half FROM w),
blocks AS (SELECT DISTINCT doc_id, word, half AS block FROM words_at UNION SELECT doc_id, word, half - 1 FROM words_at WHERE half > 0),
hits AS (SELECT doc_id, block, k, label, len(wanted) AS size, count(*) AS shared FROM blocks JOIN (SELECT k, label, wanted, unnest(wanted) AS word FROM t) USING (word) GROUP BY ALL),
found AS (SELECT doc_id, label, shared / size AS share FROM hits WHERE shared >= ceil(0.8 * size - 1e-9)),
labelled AS (SELECT doc_id, label FROM found UNION SELECT doc_id, label FROM places),
named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM labelled GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, (CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END)::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)
"""

OP4 = f"""
WITH b AS (SELECT item_id, {PLAIN} AS words FROM benchmark),
windows AS (SELECT DISTINCT item_id, k, array_to_string(words[i:i + k - 1], ' ') AS run FROM
  (SELECT item_id, words, least(10, len(words)) AS k, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)),
w AS (SELECT doc_id, {PLAIN} AS words FROM documents),
d AS (SELECT doc_id, k, i, array_to_string(words[i:i + k - 1], ' ') AS run FROM
  (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, (SELECT DISTINCT k FROM windows))),
m AS (SELECT doc_id, k, i, item_id FROM d JOIN windows USING (k, run)),
hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS word FROM (SELECT DISTINCT doc_id, k, i FROM m)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id),
-- The longest verbatim match that begins with a window: grow each occurrence word by word.
starts AS (SELECT DISTINCT m.doc_id, m.i, m.item_id, j FROM m JOIN
  (SELECT item_id, least(10, len(words)) AS k, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS j, words AS own FROM b WHERE len(words) > 0) c
  ON c.item_id = m.item_id AND c.k = m.k JOIN w ON w.doc_id = m.doc_id AND w.words[m.i:m.i + m.k - 1] = c.own[j:j + m.k - 1]),
grown AS (SELECT doc_id, i, item_id, (SELECT count(*) FROM range(0, least(len(b.words) - j + 1, len(w.words) - i + 1)) r(n) WHERE w.words[i:i + n] = b.words[j:j + n]) AS n
  FROM starts JOIN w USING (doc_id) JOIN b USING (item_id)),
longest AS (SELECT doc_id, max(n) AS longest FROM grown GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(longest, 0)::BIGINT AS longest, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS bytes FROM pages),
r AS (SELECT payload, max(page_id) AS response FROM p WHERE bytes >= 1000 GROUP BY payload)
SELECT page_id, bytes::BIGINT AS payload_bytes, sha1(p.payload) AS payload_digest,
  CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN response <> page_id THEN response END AS refers_to
FROM p LEFT JOIN r ON p.payload = r.payload AND p.bytes >= 1000
"""

OP7 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
good AS (SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len([c FOR c IN x IF c IS NULL OR NOT isfinite(c)]) = 0 AND len([c FOR c IN x IF c <> 0]) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id < b.vec_id WHERE len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(id, node) AS (SELECT vec_id, vec_id FROM v UNION SELECT id, y FROM reach JOIN ways ON node = x)
SELECT vec_id, (SELECT count(*) FROM ways WHERE x = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN (SELECT id, min(node) AS component_id FROM reach GROUP BY id) ON id = vec_id
"""

_weight = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(WEIGHTS))

OP9 = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {_weight} END AS weight, {MOST_COPIES} * source_size AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s),
l AS (SELECT *, cap / weight AS own, (sum(source_size) OVER () - (sum(cap) OVER (ORDER BY cap / weight, n) - cap))::DOUBLE / (sum(weight) OVER () - (sum(weight) OVER (ORDER BY cap / weight, n) - weight))::DOUBLE AS level FROM k),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(max(CASE WHEN level <= own THEN level END) OVER (), 0.0) * weight) AS target FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY floor(sqrt(size)), substr(h, 1, 1), size, h) AS place FROM d),
c AS (SELECT r.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
  ('0x' || substr(md5('mix:' || coalesce(r.source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS move FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (least(floor(place * rate + move) - floor((place - 1) * rate + move), {MOST_COPIES}) * size)::BIGINT AS taken, source FROM c
"""

OP12 = r"""
WITH RECURSIVE steps(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS entries FROM steps WHERE k = 8),
runs AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM
  (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, [('0x' || substr(x, i, 2))::BIGINT FOR i IN range(1, len(x), 2)]),
  lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM runs, crc),
w AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS gone FROM (SELECT word, unnest(range(0, length(word))) AS i FROM w)),
pairs AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.gone = b.gone AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, w.word FROM cut JOIN w ON gone = w.word UNION SELECT w.word, cut.word FROM cut JOIN w ON gone = w.word),
near AS (SELECT p.word, count(*) AS n_near, first(other ORDER BY o.n DESC, other) AS form, max(o.n) AS form_n FROM pairs p JOIN w o ON o.word = other GROUP BY p.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM w LEFT JOIN near ON near.word = w.word),
chain(word, place, k) AS (SELECT word, word, 0 FROM f UNION ALL SELECT chain.word, f.form, k + 1 FROM chain JOIN f ON f.word = place WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near::BIGINT AS n_near, form_n FROM f JOIN (SELECT word, arg_max(place, k) AS root FROM chain GROUP BY word) r ON r.word = f.word
"""

OP13 = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
  ('0x' || substr(sha256(coalesce(conv_id::VARCHAR, '') || ':' || turn::VARCHAR), 1, 8))::BIGINT AS h FROM conversations WHERE turn IS NOT NULL),
f AS (SELECT conv_id AS conv, min(turn) AS first FROM c GROUP BY 1),
a AS (SELECT conv_id, turn, role, text, h % 10 AS batch FROM c UNION ALL SELECT conv_id, turn, 'user', text, (h + 5) % 10 FROM c WHERE h % 7 < 2),
p AS (SELECT conv_id, turn, batch, min(role || '|' || text) AS payload, arg_min(role, role || '|' || text) AS role FROM a GROUP BY ALL),
g AS (SELECT conv_id, batch, lead(batch) OVER (PARTITION BY conv_id ORDER BY batch) AS next FROM (SELECT DISTINCT conv_id, batch FROM p)),
e AS (SELECT conv_id AS conv, min(CASE WHEN next - batch >= 3 OR next IS NULL AND batch + 2 <= 9 THEN batch + 2 WHEN next IS NULL THEN 10 END) AS closed FROM g GROUP BY 1),
d AS (SELECT p.*, first, closed FROM p JOIN f ON f.conv IS NOT DISTINCT FROM conv_id JOIN e ON e.conv IS NOT DISTINCT FROM conv_id),
k AS (SELECT conv_id, turn, first, closed, min(batch) AS batch, arg_min(payload, batch) AS payload, arg_min(role, batch) AS role FROM d WHERE batch <= closed GROUP BY ALL),
r AS (SELECT *, turn - first = row_number() OVER w - 1 AS run, max(batch) OVER w AS since, coalesce(lag(turn) OVER w = turn - 1 AND lag(role) OVER w = role, false) AS breaks FROM k
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT 'release' AS event, conv_id, turn, since AS batch, sha256(payload) AS sha256, NULL::BIGINT AS n_missing, NULL::BIGINT AS n_breaks FROM r WHERE run
UNION ALL SELECT 'reject', conv_id, turn, batch, sha256(payload), NULL, NULL FROM d WHERE batch > closed
UNION ALL SELECT 'close', conv_id, -1, closed, sha256(coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (NOT run), '')),
  max(turn) - first + 1 - count(*), sum(breaks::BIGINT)::BIGINT FROM r GROUP BY conv_id, first, closed
"""

ORACLES: dict[str, str] = {
    "op2_minhash_near_dedup": OP2,
    "op3_license_scan": OP3,
    "op4_benchmark_decontamination": OP4,
    "op6_warc_round_trip": OP6,
    "op7_lattice_near_dedup": OP7,
    "op9_systematic_mixing": OP9,
    "op12_spelling_variants": OP12,
    "op13_turn_reassembly": OP13,
}
