"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from regressa.llm.licenses import PHRASES, TEMPLATES, THRESHOLD, stride_of

_EXACT = """
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g'))
             AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM t JOIN g USING (text_sha256)
"""

#: Turns are rows here; the rendered forms and spans are string aggregates and running sums.
_PREFERENCES = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id
             ORDER BY turn NULLS FIRST, role, text) AS i, role, text
           FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
                 FROM conversations)),
c AS (SELECT conv_id, count(*) AS n, max(i) FILTER (role = 'assistant') AS last,
        coalesce(min(i) FILTER (role = 'user'), min(i) FILTER (role != 'system'), max(i)) AS request
      FROM t GROUP BY 1),
prefix AS (SELECT conv_id, i AS depth, list({'role': role, 'text': text}) OVER (
             PARTITION BY conv_id ORDER BY i) AS turns FROM t),
node AS (SELECT prefix.*, n FROM prefix JOIN c ON c.conv_id IS NOT DISTINCT FROM prefix.conv_id
         AND depth >= request),
best AS (SELECT turns, conv_id AS chosen_id FROM node
         QUALIFY row_number() OVER (PARTITION BY turns ORDER BY n DESC, conv_id NULLS LAST) = 1
           AND count(*) OVER (PARTITION BY turns) > 1),
link AS (SELECT conv_id, max(depth) AS depth FROM node JOIN best USING (turns)
         WHERE chosen_id IS DISTINCT FROM conv_id GROUP BY 1),
pair AS (SELECT link.conv_id, chosen_id FROM link
         JOIN node ON node.conv_id IS NOT DISTINCT FROM link.conv_id AND node.depth = link.depth
         JOIN best USING (turns)),
p AS (SELECT c.conv_id, CASE WHEN link.depth IS NULL THEN c.conv_id ELSE pair.chosen_id END AS chosen_id,
        link.depth IS NULL AS own, c.last, c.n
      FROM c LEFT JOIN link ON link.conv_id IS NOT DISTINCT FROM c.conv_id
      LEFT JOIN pair ON pair.conv_id IS NOT DISTINCT FROM c.conv_id),
before AS (SELECT p.conv_id, max_by(t.text, t.i) AS said FROM p JOIN t
           ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.role = 'assistant' AND t.i < p.last
           GROUP BY 1),
a AS (SELECT p.conv_id, t.i, t.role, t.text FROM p JOIN t
      ON t.conv_id IS NOT DISTINCT FROM p.chosen_id),
b AS (SELECT p.conv_id, t.i, t.role, CASE WHEN own AND t.i = p.last THEN coalesce(said, '')
                                          ELSE t.text END AS text
      FROM p JOIN t ON t.conv_id IS NOT DISTINCT FROM p.conv_id
      LEFT JOIN before ON before.conv_id IS NOT DISTINCT FROM p.conv_id),
d AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, min(coalesce(a.i, b.i)) AS i
      FROM a FULL JOIN b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND a.i = b.i
      WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text GROUP BY 1),
m AS (SELECT p.conv_id, p.chosen_id, own, coalesce(d.i - 1, p.n) AS k FROM p
      LEFT JOIN d ON d.conv_id IS NOT DISTINCT FROM p.conv_id),
u AS (SELECT 'a' AS side, a.* FROM a UNION ALL SELECT 'b', b.* FROM b),
r AS (SELECT u.side, u.conv_id, u.i, u.i <= m.k AS shared, u.role,
        '<|im_start|>' || u.role || chr(10) || u.text || '<|im_end|>' || chr(10) AS piece,
        length(u.role) + 13 AS opens, length(u.text) + 10 AS body
      FROM u JOIN m ON m.conv_id IS NOT DISTINCT FROM u.conv_id),
s AS (SELECT *, sum(length(piece)) OVER (PARTITION BY side, conv_id, shared ORDER BY i)
        - length(piece) + opens AS opens_at FROM r),
g AS (SELECT conv_id,
        coalesce(string_agg(piece, '' ORDER BY i) FILTER (side = 'a' AND shared), '') AS prompt,
        coalesce(string_agg(piece, '' ORDER BY i) FILTER (side = 'a' AND NOT shared), '') AS chosen,
        coalesce(string_agg(piece, '' ORDER BY i) FILTER (side = 'b' AND NOT shared), '') AS rejected,
        coalesce(string_agg(opens_at || ':' || (opens_at + body), ',' ORDER BY i) FILTER (
          side = 'a' AND NOT shared AND role = 'assistant'), '') AS chosen_loss,
        coalesce(string_agg(opens_at || ':' || (opens_at + body), ',' ORDER BY i) FILTER (
          side = 'b' AND NOT shared AND role = 'assistant'), '') AS rejected_loss
      FROM s GROUP BY 1)
SELECT m.conv_id, chosen_id, CASE WHEN own THEN 'stale' ELSE 'sibling' END AS kind,
  k::INTEGER AS common_turns, prompt, chosen, rejected, chosen_loss, rejected_loss,
  chosen_loss != '' AND rejected_loss != '' AND chosen != rejected AS usable
FROM m JOIN g ON g.conv_id IS NOT DISTINCT FROM m.conv_id
"""

_T = ", ".join(f"('{label}', {stride_of(len(text.split()))}, '{text}')"
               for label, text in TEMPLATES.items())
_P = ", ".join(f"('{label}', '{text}')" for text, label in PHRASES.items())

#: Every template word of every block is counted; no word order, no filters.
_LICENSES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM d),
l AS (SELECT r, i, word, word || ' ' || lead(word, 1, '') OVER o AS two,
        word || ' ' || lead(word, 1, '') OVER o || ' ' || lead(word, 2, '') OVER o || ' ' ||
        lead(word, 3, '') OVER o AS four FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
base AS (SELECT r, i, p.label FROM l JOIN (VALUES {_P}) p(label, phrase)
         ON phrase = two OR phrase = four),
tw AS (SELECT DISTINCT label, stride, unnest(string_split(text, ' ')) AS word
       FROM (VALUES {_T}) t(label, stride, text)),
size AS (SELECT label, count(*) AS n FROM tw GROUP BY 1),
hit AS (SELECT r, label, word, unnest([i // stride, i // stride - 1]) AS block
        FROM w JOIN tw USING (word)),
block AS (SELECT r, label, count(DISTINCT word) / any_value(n) AS share
          FROM hit JOIN size USING (label) WHERE block >= 0 GROUP BY r, label, block
          HAVING count(DISTINCT word) >= ceil({THRESHOLD} * any_value(n) - 1e-9)),
b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY 1),
m AS (SELECT r, max(share) AS share FROM block GROUP BY 1),
a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
      FROM (SELECT r, label FROM base UNION ALL SELECT r, label FROM block) GROUP BY 1)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
  first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r) LEFT JOIN a USING (r)
"""

#: Every document against every item's terms: an exhaustive search.
_SEARCH = r"""
WITH lowered AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
      FROM lowered),
corpus AS (SELECT count(*) FILTER (len(ts) > 0) AS nd, sum(len(ts))::BIGINT AS l FROM d),
i AS (SELECT item_id, text, unnest(regexp_extract_all(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item_id, text, term, count(*) AS times FROM i GROUP BY ALL),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2.0 * nd + 2) / (2 * count(*) + 1)))::BIGINT AS w
      FROM p, corpus GROUP BY term, nd),
s AS (SELECT item_id, text, p.r, sum(times * w * ((1000000000 * tf) //
        (1000 * tf + 12 * (75 + (25 * len(ts) * nd) // l))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN d ON d.r = p.r, corpus GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id, text
             ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score
           FROM s JOIN d USING (r) WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""

ORACLE: dict[str, str] = {
    "op1_preference_formatting": _PREFERENCES,
    "op5_license_scan": _LICENSES,
    "op9_exact_dedup": _EXACT,
    "op13_lexical_search": _SEARCH,
}
