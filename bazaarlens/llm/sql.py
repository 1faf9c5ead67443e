"""SQL statements for DuckDB with the results of the queries that SQL can express.

They state the definitions directly: all pairs, all distances, recursive reachability and
closed forms. Tokenizers, learned models and random draws have no SQL form; the tests hold
those queries against brute force.
"""

from __future__ import annotations

from bazaarlens.llm import chat, hard_negatives, prob_minhash, queries

#: Vectors that may take part.
USABLE = """
  embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0
"""


def _reach(links: str) -> str:
    """Smallest node that links reach from each node, as ``component``."""
    return f"""
    reach AS (
      SELECT a AS node, a AS other FROM ({links})
      UNION
      SELECT r.node, l.b FROM reach r JOIN ({links}) l ON r.other = l.a
    ),
    component AS (SELECT node, min(other) AS root FROM reach GROUP BY node)"""


LINKS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND {USABLE}
),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= {queries.LINK_COSINE}
),
{_reach("SELECT a, b FROM links")}
SELECT d.vec_id, (SELECT count(*) FROM links l WHERE l.a = d.vec_id) AS n_links,
       coalesce(c.root, d.vec_id) AS component_id, coalesce(c.root, d.vec_id) = d.vec_id AS kept
FROM embeddings d LEFT JOIN component c ON c.node = d.vec_id
"""

NEAREST = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {USABLE}),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))),
                          lambda s, x: s + x)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {queries.NEIGHBOURS}
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped(text: str) -> str:
    mark = chat.ESCAPE
    out = f"replace({text}, {_quoted(mark)}, {_quoted(mark * 2)})"
    for word in chat.CONTROL:
        out = f"replace({out}, {_quoted(word)}, {_quoted(word[0] + mark + word[1:])})"
    return out


CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {_quoted(queries.CONTROL_TEXT)}
  UNION ALL SELECT -1, 1, 'assistant', {_quoted(queries.CONTROL_TEXT)}
),
whole AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS learnt,
         sum({len(chat.TURN + chat.TEXT + chat.END)} + length({_escaped("role")}) + length({_escaped("text")})) AS chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars,
       sha256(learnt) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM whole
"""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR) || ':' || coalesce(text, '')) AS hash,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i
  FROM d GROUP BY source
),
w AS (SELECT *, CAST([3, 1, 2][i % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS most FROM s),
o AS (
  SELECT *, sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS weights,
         1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER earlier, 0) AS rest
  FROM w WINDOW earlier AS (ORDER BY most / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
f AS (
  SELECT *, bool_and(most / weight <= rest / weights) OVER (ORDER BY most / weight, i ROWS UNBOUNDED PRECEDING) AS filled
  FROM o
),
lvl AS (SELECT *, max(CASE WHEN NOT filled THEN rest END) OVER () AS open_rest,
               max(CASE WHEN NOT filled THEN weights END) OVER () AS open_weights FROM f),
t AS (SELECT source, source_size, max(n) OVER () AS largest,
             CASE WHEN filled THEN most ELSE open_rest * weight / open_weights END AS target FROM lvl),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS goal,
         CAST(sum(d.size) OVER (PARTITION BY d.source
              ORDER BY CAST('0x' || substr(hash, 1, 8) AS BIGINT) % greatest(1, largest // 8192), hash, doc_id
              ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       greatest(0, least(size, goal - start)) + greatest(0, least(size, goal - source_size - start)) AS taken
FROM placed
"""

URLS = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest,
         coalesce(instr(url, '://') > 0, false) AS known
  FROM pages
),
a AS (
  SELECT page_id, html, known, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail
  FROM p
),
tags AS (
  SELECT host, path, host || tail AS node,
         unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>')) AS tag,
         '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)' AS form
  FROM a WHERE known AND html IS NOT NULL
  UNION ALL
  SELECT host, path, host || tail,
         unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')),
         '(?is)\burl\s*=\s*["'']?([^"''\s>]+)'
  FROM a WHERE known AND html IS NOT NULL
),
targets AS (
  SELECT node, host, regexp_extract(path, '^(.*/)?', 1) AS folder,
         replace(CASE WHEN form LIKE '%href%' THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
                      ELSE regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END, '&amp;', '&') AS link
  FROM tags
),
whole AS (
  SELECT node, CASE WHEN instr(link, '://') > 0 THEN substr(link, instr(link, '://') + 3)
                    WHEN link LIKE '//%' THEN substr(link, 3)
                    WHEN link LIKE '/%' THEN host || link
                    ELSE host || CASE WHEN folder = '' THEN '/' ELSE folder END || link END AS rest
  FROM targets WHERE link <> ''
),
e AS (
  SELECT node AS a, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                    || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS b
  FROM whole
),
both_ways AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
{reach},
rules(host, path, verdict) AS (VALUES {rules}),
nodes AS (
  SELECT node, root, regexp_extract(node, '^[^/?#]*') AS host, regexp_extract(node, '^[^/?#]*([^?#]*)', 1) AS path FROM component
),
node_rules AS (
  SELECT n.root, n.node, arg_max(r.verdict, (length(r.host || r.path), r.host || r.path)) AS verdict
  FROM nodes n JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)
  GROUP BY n.root, n.node
),
shared AS (
  SELECT c.node, CASE WHEN bool_or(s.verdict = 'allow') THEN 'allow' WHEN bool_or(s.verdict = 'block') THEN 'block' END AS verdict
  FROM component c JOIN node_rules s ON s.root = c.root GROUP BY c.node
),
own AS (
  SELECT a.page_id, a.host, a.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS verdict, any_value(CASE WHEN known THEN a.host || a.tail END) AS node
  FROM a LEFT JOIN rules r ON (a.host = r.host OR ends_with(a.host, '.' || r.host)) AND starts_with(a.path, r.path)
  GROUP BY a.page_id, a.host, a.path
)
SELECT o.page_id, o.host, o.path, o.rule, coalesce(o.verdict, s.verdict, 'allow') AS verdict
FROM own o LEFT JOIN shared s ON s.node = o.node
""".replace("{reach}", _reach("SELECT a, b FROM both_ways")).replace(
    "{rules}", ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in queries.RULES)
)

NEAR = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS words FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5
    THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
    ELSE [array_to_string(words, ' ')] END) AS shingle
  FROM w WHERE len(words) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id
),
links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE common >= {prob_minhash.SIMILARITY} * (x.n + y.n - common) - 1e-9
),
{_reach("SELECT a, b FROM links")}
SELECT d.doc_id, coalesce(c.root, d.doc_id) AS component_id, coalesce(c.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN component c ON c.node = d.doc_id
"""

#: Windows are lists of words; a text is cut into words once, and each place is compared with the windows of each length.
CONTAMINATION = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
),
item_places AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, w[p : p + 9] AS win, len(w[p : p + 9]) AS n FROM item_places),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM texts, lengths WHERE len(w) >= n),
hits AS (SELECT p.doc_id, p.p, p.n, i.item_id FROM places p JOIN windows i ON p.n = i.n AND p.w[p.p : p.p + p.n - 1] = i.win),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS place FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY doc_id
),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.names, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM texts t LEFT JOIN covered c ON t.doc_id = c.doc_id LEFT JOIN named n ON t.doc_id = n.doc_id
"""

HARD_NEGATIVES = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({hard_negatives.SCALE} * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, CAST(list_inner_product(a.e, o.e) AS BIGINT) AS score
  FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {hard_negatives.POSITIVES}
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
WHERE {hard_negatives.LEAST_PCT} * p.positive_score <= 100 * s.score AND 100 * s.score <= {hard_negatives.MOST_PCT} * p.positive_score
QUALIFY rank <= {hard_negatives.NEGATIVES}
"""

SQL: dict[str, str] = {
    "op2_vector_links": LINKS,
    "op5_redirect_equivalence": URLS,
    "op6_low_discrepancy_mix": MIX,
    "op7_nearest_vectors": NEAREST,
    "op8_chat_format": CHAT,
    "op9_prob_minhash": NEAR,
    "op12_item_automaton": CONTAMINATION,
    "op13_vertical_scan": HARD_NEGATIVES,
}
