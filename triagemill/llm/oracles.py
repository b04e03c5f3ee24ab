"""SQL for the queries whose results it can express, over whole tables."""

from __future__ import annotations

from . import chat

EXACT = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""

_RESTS = "|".join(
    "".join("\\" + c if c in "|[]()" else c for c in control[1:]) for control in sorted(chat.CONTROL, key=len, reverse=True)
)


def _escaped(text: str) -> str:
    return f"regexp_replace({text}, '([<\\[])(\\\\*)({_RESTS})', '\\1\\\\\\2\\3', 'g')"


_HEADER = _escaped("replace(replace(role, '\\', '\\\\'), chr(10), '\\n')")
CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_HEADER}) + length({_escaped('text')}) + {len(chat.START) + len(chat.STOP) + 2}) + 7 AS BIGINT)
    AS formatted_chars
FROM turns GROUP BY conv_id
"""

# Runs of starts that overlap or touch, and what is left between them.
_RUNS = """
repeats AS (SELECT doc_id, p FROM starts JOIN (SELECT s, min(doc_id) AS m FROM starts GROUP BY s) USING (s) WHERE m < doc_id),
marked AS (
  SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {window}, true) AS opens FROM repeats),
numbered AS (SELECT doc_id, p, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked),
runs AS (SELECT doc_id, min(p) AS a, max(p) + {window} AS b FROM numbered GROUP BY doc_id, k),
gaps AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM runs),
sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)"""

BYTES = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (
  SELECT doc_id, p, substring(h, 2 * p + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)),{_RUNS.format(window=50)},
kept AS (
  SELECT doc_id, string_agg(substring(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substring(any_value(h), 2 * max(b) + 1) AS k
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN sums ON sums.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

WORDS = rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS h FROM documents),
starts AS (
  SELECT doc_id, p, array_to_string(h[p + 1 : p + 13], ' ') AS s
  FROM (SELECT doc_id, h, unnest(range(0, len(h) - 12)) AS p FROM d)),{_RUNS.format(window=13)},
kept AS (
  SELECT doc_id, flatten(list(h[since + 1 : a] ORDER BY a)) || any_value(h)[max(b) + 1 :] AS k
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) AS BIGINT) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(coalesce(k, h), ' '), '')) AS kept_sha256
FROM d LEFT JOIN sums ON sums.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def _words(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS h FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_words('text')} AS h FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(h[p + 1 : p + n], ' ') AS s
  FROM (SELECT item_id, h, least(10, len(h)) AS n, unnest(range(0, len(h) - least(10, len(h)) + 1)) AS p FROM items WHERE len(h) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
starts AS (
  SELECT doc_id, n, p, array_to_string(h[p + 1 : p + n], ' ') AS s
  FROM (SELECT doc_id, h, n, unnest(range(0, len(h) - n + 1)) AS p FROM d, sizes)),
hits AS (SELECT doc_id, n, p, item_id FROM starts JOIN windows USING (n, s)),
covered AS (
  SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS w FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id
"""

AUDIT = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, part, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
f AS (
  SELECT w.doc_id, part,
    CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
      + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
      + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
      + CASE WHEN first_id < w.doc_id THEN 16 ELSE 0 END AS failed,
    CASE WHEN quality = 1 THEN 1 ELSE 0 END AS good, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS toxic
  FROM w LEFT JOIN labels ON labels.doc_id = w.doc_id),
m AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failed),
l(c, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT l1.c || l2.c || l3.c || l4.c || l5.c AS filter_order, [l1.b, l2.b, l3.b, l4.b, l5.b] AS bits
  FROM l AS l1, l AS l2, l AS l3, l AS l4, l AS l5 WHERE l1.b | l2.b | l3.b | l4.b | l5.b = 31),
s AS (
  SELECT filter_order, step, bits[step] AS own, CAST(coalesce(list_sum(bits[1 : step - 1]), 0) AS INTEGER) AS before
  FROM o, range(1, 6) AS r(step)),
steps AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (failed & (before | own) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (failed & before = 0 AND failed & own <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (failed & before <> 0 AND failed & own <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (failed = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (failed & before = 0 AND failed & own <> 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (failed & before = 0 AND failed & own <> 0), 0) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM steps
"""

MIDDLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
k AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS c2,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
        OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
c AS (
  SELECT *, substring(text, 1, least(c1, c2)) AS p, substring(text, least(c1, c2) + 1, abs(c1 - c2)) AS m,
    substring(text, greatest(c1, c2) + 1) AS s FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(c1, c2) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN abs(c1 - c2) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""
