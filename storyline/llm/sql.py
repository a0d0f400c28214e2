"""The queries that DuckDB can express, written from their contracts."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = {}

SQL["op12_collocations"] = rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
grams AS (
  SELECT lang, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: list_slice(ws, i, i + m - 1))) AS g
  FROM pieces, (VALUES (1), (2), (3)) AS sizes(m)),
f AS (SELECT lang, g, len(g) AS m, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang),
candidates AS (SELECT * FROM f WHERE m > 1 AND a >= 10),
inside AS (
  SELECT lang, part, max(a) AS most FROM (
    SELECT lang, a, unnest([g[1:2], g[2:3]]) AS part FROM candidates WHERE m = 3) GROUP BY ALL),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN inside i ON c.lang = i.lang AND c.g = i.part
  WHERE i.most IS NULL OR 100 * i.most < 50 * c.a),
cuts AS (
  SELECT k.lang, k.g, k.a, cut, x.a AS l, y.a AS r,
         (1000000::HUGEINT * k.a * k.a) // (x.a::HUGEINT * y.a) AS score
  FROM kept k JOIN (VALUES (1), (2)) AS places(cut) ON cut < k.m
  JOIN f x ON x.lang = k.lang AND x.g = k.g[1:cut]
  JOIN f y ON y.lang = k.lang AND y.g = k.g[cut + 1:]),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
ranked AS (
  SELECT *, array_to_string(g, ' ') AS phrase,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM scored)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

_CRC32 = ("xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split({0}, ''), lambda b: ascii(b)::UBIGINT)), "
          "lambda v, b: list_reduce(list_concat([xor(v, b)], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), "
          "lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT)")

SQL["op13_prefix_trie"] = rf"""
WITH own AS (
  SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT *, {_CRC32.format("c::VARCHAR")} % 4 AS h FROM own),
built AS (
  SELECT a.c, list_concat(coalesce(b.ts, [])[1:a.h], a.ts[a.h + 1:]) AS ts
  FROM heads a LEFT JOIN own b ON b.c = a.c - a.c % 20),
prefixes AS (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM built),
nodes AS (
  SELECT d, ts[1:d] AS p, min(c) AS conv_id, count(*) AS n,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(ts) = d), '')) AS ends_sha256,
         coalesce(len(regexp_extract_all(any_value(ts[d].text), '[^\x20\x09-\x0D]+')), 0) AS words
  FROM prefixes GROUP BY d, ts[1:d]),
grown AS (
  SELECT n.*, (SELECT count(*) FROM nodes k WHERE k.d = n.d + 1 AND k.p[1:n.d] = n.p) AS n_children FROM nodes n),
summed AS (
  SELECT u.d, u.p, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, sum((v.n - 1) * v.words) AS saved_tokens
  FROM grown u JOIN grown v ON v.d >= u.d AND v.p[1:u.d] = u.p GROUP BY ALL)
SELECT g.conv_id, g.d::BIGINT AS depth, up.conv_id AS parent_conv_id, g.n::BIGINT AS n_convs,
       g.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, g.ends_sha256
FROM grown g JOIN summed s ON s.d = g.d AND s.p = g.p
LEFT JOIN nodes up ON up.d = g.d - 1 AND up.p = g.p[1:g.d - 1]
"""
