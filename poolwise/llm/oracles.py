"""The rows of the operators' queries, stated in the checking engine's SQL in their plainest form."""

_TEXT = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_REACH = """reach(id, r) AS (SELECT id, id FROM nodes UNION SELECT reach.id, l.b FROM reach JOIN links l ON reach.r = l.a)"""

DECONTAMINATE = f"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, {_PLAIN.format("coalesce(text, '')")} AS w FROM documents),
items AS (SELECT item_id, {_PLAIN.format("coalesce(text, '')")} AS w FROM benchmark),
patterns AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS p FROM (
  SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
windows AS (SELECT id, m, i, array_to_string(w[i:i + m - 1], ' ') AS p FROM (
  SELECT id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM patterns) WHERE len(w) >= m)),
hits AS (SELECT id, i, m, item_id FROM windows JOIN patterns USING (m, p)),
words AS (SELECT id, count(DISTINCT j) AS n FROM (SELECT id, unnest(range(i, i + m)) AS j FROM hits) GROUP BY id),
found AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT id, item_id::VARCHAR AS item FROM hits) GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (id) LEFT JOIN found USING (id)"""

JACCARD = f"""
WITH RECURSIVE docs AS (SELECT doc_id AS id, {_TEXT.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
sets AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT id, count(*) AS n FROM sets GROUP BY id),
shared AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM sets x JOIN sets y USING (s) WHERE x.id <> y.id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
nodes AS (SELECT id FROM docs), {_REACH}
SELECT docs.id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(r) FROM reach WHERE reach.id = docs.id) AS component_id
FROM docs LEFT JOIN sizes USING (id)"""

MIX = rf"""
WITH docs AS (SELECT doc_id, source, len({_TEXT.format("coalesce(text, '')")})::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS s FROM docs GROUP BY source),
weighed AS (SELECT source, s, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM sizes),
ranked AS (SELECT *, sum(s) OVER () - 3 * coalesce(sum(s) OVER before, 0) AS left_size, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS left_weight FROM weighed
  WINDOW before AS (ORDER BY s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, 3 * s * left_weight <= left_size * w AS stops FROM ranked),
level AS (SELECT left_size, left_weight FROM marked WHERE NOT stops ORDER BY s / w, source NULLS LAST LIMIT 1),
targets AS (SELECT source, s, CASE WHEN stops THEN (3 * s)::DOUBLE ELSE (SELECT (level.left_size * w)::DOUBLE / level.left_weight::DOUBLE FROM level) END AS target FROM marked),
placed AS (SELECT docs.*, s, target, row_number() OVER (PARTITION BY docs.source ORDER BY size, doc_id)::DOUBLE AS place,
  CASE WHEN s > 0 THEN target / s::DOUBLE ELSE 0.0::DOUBLE END AS step,
  ('0x' || substr(sha256('17:' || coalesce(docs.source, chr(0))), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS start
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, s AS source_size, target, ((floor(start + step * place) - floor(start + step * (place - 1.0::DOUBLE))) * size)::BIGINT AS taken FROM placed"""

VECTORS = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS n FROM embeddings),
links AS (SELECT x.id AS a, y.id AS b FROM nodes x JOIN nodes y ON x.id <> y.id AND x.n > 0 AND y.n > 0 WHERE list_dot_product(x.v, y.v) / (sqrt(x.n) * sqrt(y.n)) >= 0.95),
{_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, (SELECT min(r) FROM reach WHERE reach.id = nodes.id) AS component_id,
  (SELECT min(r) FROM reach WHERE reach.id = nodes.id) = id AS kept FROM nodes"""

WINDOWS = f"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, {_TEXT.format("coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT id, doc_id, i, array_to_string(w[i:i + 12], ' ') AS p FROM (SELECT id, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)),
first AS (SELECT p, min(doc_id) AS least FROM windows GROUP BY p),
hit AS (SELECT DISTINCT id, unnest(range(i, i + 13)) AS i FROM windows JOIN first USING (p) WHERE least < doc_id),
words AS (SELECT id, i, w[i] AS word, hit.i IS NOT NULL AS gone FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM docs) LEFT JOIN hit USING (id, i)),
per AS (SELECT id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM words GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN per USING (id)"""

_SCALED = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE))"

SCORES = f"""
WITH rows AS (SELECT vec_id, {_SCALED} AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM rows q JOIN rows c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER best)::INTEGER AS rank, vec_id, score FROM scores WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5"""

FILTERS = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
flags AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
marked AS (SELECT part, coalesce(good, false) AS good, coalesce(f.toxic, false) AS toxic,
  (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(split.doc_id > min(split.doc_id) OVER (PARTITION BY text), false)::INT AS failed FROM split LEFT JOIN flags f ON f.doc_id = split.doc_id),
counts AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM marked GROUP BY ALL),
orders AS (SELECT '' AS o UNION ALL SELECT o || l FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(o, l)),
steps AS (SELECT o, s, (1 << (ord(o[s]) - 65))::INT AS own, coalesce(list_sum([(1 << (ord(x) - 65))::INT for x in string_split(o[1:s - 1], '') if x <> '']), 0)::INT AS gone
  FROM (SELECT o, unnest(range(1, 6)) AS s FROM orders WHERE len(o) = 5)),
per AS (SELECT part, o, s, own, sum(n) FILTER (failed & (gone | own) = 0) AS kept, sum(n) FILTER (failed & gone = 0 AND failed & own > 0) AS removed,
  sum(n) FILTER (failed & gone > 0 AND failed & own > 0) AS redundant, sum(n) FILTER (failed = own) AS sole, sum(g) FILTER (failed & gone = 0 AND failed & own > 0) AS good,
  sum(t) FILTER (failed & gone = 0 AND failed & own > 0) AS toxic FROM counts, steps GROUP BY ALL)
SELECT part, o AS filter_order, s::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(sole, 0)::BIGINT AS unique_fails, coalesce(good, 0)::BIGINT AS good_lost, coalesce(toxic, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM per"""


def _edits(state: int, wanted: str, after: int, kept: str, to: str) -> str:
    """The cheapest edit of a row in one state of the grammar, by cost, then audit."""
    new = "CASE WHEN fault IN ('blank', 'duplicate') THEN NULL ELSE {{'c': {}, 'a': {}, 'r': {}}} END"
    options = [f"{{'c': f{state}.c + 2, 'a': 'D' || f{state}.a, 'r': f{state}.r}}",
               new.format(f"f{after}.c + extra + 1", f"'R' || f{after}.a", f"chr(10) || '{wanted}:' || text || f{after}.r")]
    for initial, target in zip(kept, to, strict=True):
        options.append(f"CASE WHEN role[1] = '{initial}' THEN " + new.format(f"f{target}.c + extra", f"'K' || f{target}.a", f"chr(10) || role || ':' || text || f{target}.r") + " END")
    return f"list_min([x for x in [{', '.join(options)}] if x IS NOT NULL])"


def _inserts(state: int, wanted: str, source: str) -> str:
    return f"least(b{state}, {{'c': {source}.c + 5, 'a': 'I' || {source}.a, 'r': chr(10) || '{wanted}:' || {source}.r}}) AS f{state}"


REPAIR = f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT) AS key FROM conversations),
kinds AS (SELECT named.*, xor(list_reduce(list_concat([4294967295], key), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS kind FROM named, crc),
rows AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS body FROM rows),
faults AS (SELECT *, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before, CASE WHEN body = '' THEN 'blank'
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(body, '[.!?]$') THEN 'truncated' ELSE 'none' END AS fault FROM placed),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faults GROUP BY conv_id),
walk AS (SELECT conv_id, n AS left_rows, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS f0, {{'c': 10::BIGINT, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS f1,
    {{'c': 5::BIGINT, 'a': 'I', 'r': chr(10) || 'assistant:'}} AS f2, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS f3 FROM facts
  UNION ALL SELECT conv_id, left_rows - 1, {_inserts(0, "user", "f2")}, {_inserts(1, "user", "f2")}, f2, f3 FROM (
    SELECT conv_id, left_rows, b0, b1, {_inserts(2, "assistant", "b3")}, {_inserts(3, "user", "b2")} FROM (
      SELECT walk.conv_id, left_rows, {_edits(0, "user", 2, "su", "12")} AS b0, {_edits(1, "user", 2, "u", "2")} AS b1, {_edits(2, "assistant", 3, "a", "3")} AS b2, {_edits(3, "user", 2, "u", "2")} AS b3
      FROM (SELECT *, 1 AS one FROM walk) walk JOIN (SELECT *, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM faults) f ON f.conv_id IS NOT DISTINCT FROM walk.conv_id AND f.i = left_rows)))
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(f0.c, 0)::BIGINT AS cost, coalesce(f0.a, '') AS audit, sha256(coalesce(f0.r[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN walk ON walk.conv_id IS NOT DISTINCT FROM c.conv_id AND left_rows = 0"""
