"""SQL of the queries of this package that SQL can express, for DuckDB."""

from __future__ import annotations

from panelgrid.llm import mixing

CONTENT = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

EXACT_DEDUP = f"""
WITH rows AS (SELECT doc_id, {CONTENT} AS content, length(coalesce(text, '')) AS points FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY points DESC, doc_id) AS place,
                  count(*) OVER (PARTITION BY content) AS group_size FROM rows),
kept AS (SELECT content, doc_id AS keep_id FROM ranked WHERE place = 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256
FROM ranked JOIN kept USING (content)
"""

_ITEM_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _lowered(text: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"translate({text}, '{upper}', '{lower}')"


DECONTAMINATION = f"""
WITH item_words AS (SELECT item_id, regexp_extract_all({_lowered("coalesce(text, '')")}, {_ITEM_WORD}) AS w FROM benchmark),
item_lengths AS (SELECT *, least(10, len(w)) AS n FROM item_words WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS win
            FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM item_lengths)),
lengths AS (SELECT DISTINCT n FROM windows),
doc_words AS (SELECT doc_id, regexp_extract_all({_lowered("coalesce(text, '')")}, {_ITEM_WORD}) AS w FROM documents),
doc_windows AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
                FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc_words, lengths)),
found AS (SELECT doc_id, n, s, item_id FROM doc_windows JOIN windows USING (n, win)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _weights(level: str, column: str) -> str:
    cases = " ".join(f"WHEN '{n}' THEN {w}" for n, w in mixing.LEVEL_WEIGHTS.get(level, {}).items())
    return f"CASE {column} {cases} ELSE 1 END" if cases else "1"


def _shares(depth: int, levels: list[str]) -> str:
    """Shares of the nodes of one level out of those of the level above."""
    path, name = ", ".join(levels[: depth + 1]), levels[depth]
    parent = levels[:depth]
    joined = f"JOIN shared{depth - 1} USING ({', '.join(parent)})" if parent else "CROSS JOIN shared_root"
    split = f"PARTITION BY {', '.join(parent)}" if parent else ""
    same = " AND ".join(f"o.{p} = r.{p}" for p in parent) or "true"
    group = f"GROUP BY {', '.join(parent)}" if parent else ""
    keep = ", ".join([*parent, ""]) if parent else ""
    return f"""
nodes{depth} AS (SELECT {path}, capacity, weight, budget FROM (
    SELECT {path}, sum(tokens) * 2 AS capacity, {_weights({'language': 'lang'}.get(name, name), name)} AS weight FROM leaves GROUP BY {path}) {joined}),
ordered{depth} AS (SELECT *, row_number() OVER w AS place,
    greatest(budget - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS left_budget,
    sum(weight) OVER ({split}) - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight
    FROM nodes{depth} WINDOW w AS ({split} ORDER BY capacity / weight, {name})),
rates{depth} AS (SELECT {keep} min(place) AS first_place, arg_min(left_budget, place) AS rate_budget, arg_min(left_weight, place) AS rate_weight
    FROM ordered{depth} WHERE capacity * left_weight > left_budget * weight {group}),
shared{depth} AS (SELECT {', '.join('o.' + x for x in levels[: depth + 1])},
    CAST(CASE WHEN first_place IS NULL OR place < first_place THEN capacity ELSE rate_budget * weight // rate_weight END AS HUGEINT) AS budget
    FROM ordered{depth} o LEFT JOIN rates{depth} r ON {same})"""


_LEVELS = ["domain", "language", "origin"]

MIXING = f"""
WITH base AS (SELECT doc_id, lang, source, coalesce(lang, 'unknown') AS language, coalesce(source, 'unknown') AS origin,
    CASE WHEN number < 5 THEN 'web' WHEN number < 10 THEN 'forum' WHEN number < 15 THEN 'news'
         WHEN number IS NOT NULL THEN 'books' ELSE 'unknown' END AS domain, tokens
    FROM (SELECT *, try_cast(regexp_extract(source, '(\\d+)$', 1) AS INT) AS number,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS HUGEINT) AS tokens FROM documents)),
leaves AS (SELECT domain, language, origin, sum(tokens) AS tokens FROM base GROUP BY ALL HAVING sum(tokens) > 0),
shared_root AS (SELECT sum(tokens) * 60 // 100 AS budget FROM leaves),
{",".join(_shares(d, _LEVELS) for d in range(3))},
quotas AS (SELECT domain, language, origin, budget // tokens AS full_epochs, budget % tokens AS rest
    FROM leaves JOIN shared2 USING (domain, language, origin)),
placed AS (SELECT b.*, full_epochs, rest, coalesce(sum(tokens) OVER (PARTITION BY domain, language, origin
        ORDER BY md5('11:' || (full_epochs + 1) || ':' || doc_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM base b JOIN quotas USING (domain, language, origin))
SELECT doc_id, CAST(epoch AS INT) AS epoch, lang, source
FROM (SELECT *, unnest(range(1, CAST(full_epochs + CASE WHEN start < rest THEN 1 ELSE 0 END AS BIGINT) + 1)) AS epoch FROM placed)
"""

_WORD = r"'[^\x20\x09-\x0D]+'"

NEAR_DEDUP = f"""
WITH RECURSIVE doc_words AS (
    SELECT doc_id, regexp_extract_all({_lowered("coalesce(text, '')")}, {_WORD}) AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda s : array_to_string(w[s : s + 2], ' ')) END) AS sh
    FROM doc_words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b USING (sh)
    WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * k >= 85 * (x.n + y.n - k)),
two_way AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM documents
    UNION SELECT doc_id, b FROM reached JOIN two_way ON a = other),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""

SUBSTRING_DEDUP = f"""
WITH doc_words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
windows AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS win
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM doc_words)),
repeats AS (SELECT doc_id, s FROM windows
    QUALIFY rank() OVER (PARTITION BY win ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM repeats),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM doc_words),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM doc_words LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""

#: CRC-32 of an ASCII string, byte by byte and bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({0}, ''), lambda x : ascii(x)::UBIGINT)),
    lambda c, b : list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
        lambda v, k : CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)), 4294967295::UBIGINT)"""

CONVERSATION_REPAIR = f"""
WITH RECURSIVE base AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {_CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fate
    FROM conversations),
damaged AS (
    SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
           CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM base WHERE fate <> 0),
ordered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
numbered AS (
    SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
           right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS last FROM ordered),
faults AS (
    SELECT *, last = '' AS blank, last <> '' AND seen AS duplicate,
           last <> '' AND NOT seen AND last NOT IN ('.', '!', '?') AS truncated,
           lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM numbered),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank,
           sum(duplicate::INT) AS duplicate, sum(truncated::INT) AS truncated, coalesce(sum(illegal::INT), 0) AS illegal,
           max(i) AS n FROM faults GROUP BY conv_id),
inserts(q, p, letters, lines) AS (VALUES
    (0, 0, '', []), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 1, '', []), (1, 2, 'I', ['user:']),
    (1, 3, 'II', ['user:', 'assistant:']), (2, 2, '', []), (2, 3, 'I', ['assistant:']), (3, 3, '', []), (3, 2, 'I', ['user:'])),
edits(p, letter, initial, role, price, next_q) AS (VALUES
    (0, 'K', 's', NULL, 0, 1), (0, 'K', 'u', NULL, 0, 2), (1, 'K', 'u', NULL, 0, 2), (2, 'K', 'a', NULL, 0, 3), (3, 'K', 'u', NULL, 0, 2),
    (0, 'R', NULL, 'user', 3, 2), (1, 'R', NULL, 'user', 3, 2), (2, 'R', NULL, 'assistant', 3, 3), (3, 'R', NULL, 'user', 3, 2),
    (0, 'D', NULL, NULL, 4, 0), (1, 'D', NULL, NULL, 4, 1), (2, 'D', NULL, NULL, 4, 2), (3, 'D', NULL, NULL, 4, 3)),
dp AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM faults
    UNION ALL
    SELECT f.conv_id, f.i, e.next_q,
           d.cost + 3 * len(s.letters) + e.price + CASE WHEN f.truncated AND e.letter <> 'D' THEN 3 ELSE 0 END AS new_cost,
           d.audit || s.letters || e.letter AS new_audit,
           d.lines || s.lines || CASE WHEN e.letter = 'D' THEN []::VARCHAR[] ELSE [coalesce(e.role, f.role) || ':' || f.text] END
    FROM dp d JOIN faults f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i + 1
         JOIN inserts s USING (q) JOIN edits e ON e.p = s.p AND (e.initial IS NULL OR e.initial = f.initial)
              AND (e.letter = 'D' OR NOT (f.blank OR f.duplicate))
    QUALIFY row_number() OVER (PARTITION BY f.conv_id, e.next_q ORDER BY new_cost, new_audit) = 1),
ends AS (
    SELECT d.conv_id, cost + 3 * len(letters) AS cost, audit || letters AS audit, d.lines || s.lines AS lines
    FROM dp d JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.n = d.i JOIN inserts s USING (q) WHERE p IN (0, 3)
    QUALIFY row_number() OVER (PARTITION BY d.conv_id ORDER BY cost + 3 * len(letters), audit || letters) = 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
     LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""

FILTER_AUDIT = f"""
WITH words AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
bits AS (
    SELECT doc_id, part, (len(w) < 200)::INT AS A, (100 * len(list_distinct(w)) < 50 * len(w))::INT AS B,
           (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT AS C, regexp_matches(t, '[#$%&*|]')::INT AS D,
           coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS E FROM words),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
cells AS (
    SELECT part, A + 2 * B + 4 * C + 8 * D + 16 * E AS bits, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad
    FROM bits LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letters(x, m) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.m + b.m + c.m + d.m + e.m = 31 AND a.m | b.m | c.m | d.m | e.m = 31),
steps AS (
    SELECT filter_order, step, m AS own, (SELECT coalesce(sum(z.m), 0) FROM letters z WHERE contains(left(filter_order, step - 1), z.x)) AS earlier
    FROM orders, (SELECT unnest(range(1, 6))::INT AS step), letters WHERE x = substring(filter_order, step, 1)),
outcome AS (
    SELECT part, filter_order, step, own, sum(CASE WHEN bits & (own | earlier::INT) = 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN bits & own <> 0 AND bits & earlier::INT = 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN bits & own <> 0 AND bits & earlier::INT <> 0 THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN bits = own THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN bits & own <> 0 AND bits & earlier::INT = 0 THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN bits & own <> 0 AND bits & earlier::INT = 0 THEN bad ELSE 0 END) AS toxic_lost
    FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM outcome
"""

SQL = {
    "op11_conversation_repair": CONVERSATION_REPAIR,
    "op12_filter_audit": FILTER_AUDIT,
    "op7_near_dedup": NEAR_DEDUP,
    "op10_substring_dedup": SUBSTRING_DEDUP,
    "op2_mixing": MIXING,
    "op5_exact_dedup": EXACT_DEDUP,
    "op6_decontamination": DECONTAMINATION,
}
