"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_HOST = "translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10 = f"""
WITH cut AS (
  SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (
  SELECT parts.page_id, host, path, 
    arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS rule_verdict
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY parts.page_id, host, path)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN list_has_any(string_split(host, '.'),
  ['ads-track', 'spam-farm', 'casino-win', 'adult-x', 'cheap-pills', 'free-bets']) THEN 'block' ELSE 'allow' END) AS verdict
FROM fit
"""

OP5 = r"""
WITH all_rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
esc AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e') AS safe FROM all_rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + length(safe) + 8) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id
"""

# Windows as strings; every occurrence marks its words.
OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS win
  FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS u(s) WHERE len(w) > 0),
spots AS (
  SELECT doc_id, s, size, array_to_string(w[s : s + size - 1], ' ') AS win
  FROM d, (SELECT DISTINCT size FROM wins) AS z, unnest(generate_series(1, len(w) - size + 1)) AS u(s)),
hits AS (SELECT doc_id, s, spots.size, item_id FROM spots JOIN wins USING (win, size)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(generate_series(s, s + size - 1)) AS u(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# crc32 of a decimal number, bit by bit: each byte is folded in, then eight shifts.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split({x}::VARCHAR, '')])),
  lambda c, x: xor(xor(c, greatest(x, 0)) >> 1, 3988292384 * (xor(c, greatest(x, 0)) & 1))), 4294967295)"""

OP12 = rf"""
WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, CAST({_CRC.format(x="conv_id")} % 4 AS BIGINT) AS h FROM own),
conv AS (
  SELECT h.conv_id, list_concat(coalesce(own.turns[:h], []), h.turns[h + 1:]) AS turns
  FROM h LEFT JOIN own ON own.conv_id = h.conv_id - h.conv_id % 20),
member AS (
  SELECT conv_id, d, turns[:d] AS prefix, d = len(turns) AS ends,
    CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].text, '[^ 	-]+')) ELSE 0 END AS words
  FROM conv, unnest(generate_series(0, len(turns))) AS u(d)),
node AS (
  SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM member GROUP BY prefix, d),
child AS (SELECT prefix[:d - 1] AS prefix, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
below AS (
  SELECT node.prefix[:u.a] AS prefix, sum(CASE WHEN child.prefix IS NULL THEN 1 ELSE 0 END) AS n_leaves,
    sum((node.n_convs - 1) * node.words) AS saved_tokens
  FROM node LEFT JOIN child ON child.prefix = node.prefix, unnest(generate_series(0, node.d)) AS u(a) GROUP BY 1)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n_convs,
  coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, node.ends_sha256
FROM node LEFT JOIN child ON child.prefix = node.prefix LEFT JOIN below ON below.prefix = node.prefix
  LEFT JOIN node AS up ON up.prefix = node.prefix[:node.d - 1] AND node.d > 0
"""


def _op13(lang_levels: int = 8, group_levels: int = 8) -> str:
    """Levels of runs of eight, unrolled; a lone node stays as it is. 8**8 leaves a language, and as many languages."""
    fields = ["doc_id", "source", "lang", "n_chars", "{text}"]
    told = " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE octet_length(encode({f}::VARCHAR)) || ':' || {f}::VARCHAR END" for f in fields)
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = [f"""leaves AS (
  SELECT doc_id, lang AS g, sha256({told.format(text="text")}) AS leaf,
    CASE WHEN {_CRC.format(x="doc_id")} % 3 = 0 THEN sha256({told.format(text=lower)}) ELSE sha256({told.format(text="text")}) END AS shown
  FROM documents),
x0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, shown) - 1 AS r FROM leaves),
l0 AS (SELECT g, r, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM x0),
p0 AS (SELECT doc_id, leaf, g, r, '' AS sib, shown AS cur FROM x0)"""]

    def climb(l: str, p: str, k: int, ids: str) -> str:  # noqa: E741
        up = f"""{l}{k + 1} AS (
  SELECT g, r // 8 AS r, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY r)) ELSE any_value(h) END AS h,
    CAST(ceil(any_value(n) / 8) AS BIGINT) AS n FROM {l}{k} GROUP BY g, r // 8)"""
        path = f"""{p}{k + 1} AS (
  SELECT {ids}, p.g, p.r // 8 AS r, any_value(p.sib) || coalesce(string_agg(l.h, '' ORDER BY l.r) FILTER (WHERE l.r <> p.r AND l.n > 1), '') AS sib,
    CASE WHEN any_value(l.n) > 1 THEN sha256(string_agg(CASE WHEN l.r = p.r THEN p.cur ELSE l.h END, '' ORDER BY l.r)) ELSE any_value(p.cur) END AS cur
  FROM {p}{k} p JOIN {l}{k} l ON l.g IS NOT DISTINCT FROM p.g AND l.r // 8 = p.r // 8 GROUP BY ALL)"""
        return up + ",\n" + path.replace("GROUP BY ALL", f"GROUP BY {ids}, p.g, p.r")

    for k in range(lang_levels):
        sql.append(climb("l", "p", k, "p.doc_id, p.leaf"))
    n = lang_levels
    sql.append(f"""subs AS (SELECT g AS lang, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS r FROM l{n}),
m0 AS (SELECT 0 AS g, r, subroot AS h, count(*) OVER () AS n FROM subs),
q0 AS (SELECT p.doc_id, p.leaf, s.subroot, 0 AS g, s.r, p.sib, p.cur FROM p{n} p JOIN subs s ON s.lang IS NOT DISTINCT FROM p.g)""")
    for k in range(group_levels):
        sql.append(climb("m", "q", k, "p.doc_id, p.leaf, p.subroot"))
    m = group_levels
    return f"""WITH {", ".join(sql)}
SELECT doc_id, leaf, subroot, h AS root, sha256(sib) AS proof_sha256, cur AS folded_root, cur = h AS verified
FROM q{m}, (SELECT h FROM m{m}) AS top"""


SQL = {"op12_prefix_trie": OP12, "op13_merkle": _op13(), "op9_decontaminate": OP9, "op10_url_cascade": OP10, "op5_chat_format": OP5}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
