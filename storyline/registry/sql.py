"""SQL building blocks of the oracles (DuckDB)."""
from __future__ import annotations

# Fixed values, written out here so that the check does not use those it checks.
_ABBR = ("['mr', 'mrs', 'ms', 'dr', 'sr', 'jr', 'st', 'vs', 'etc', 'e.g', 'i.e', 'u.s', 'u.k', 'no', 'gen', 'hon', 'prof', "
         "'inc', 'ltd', 'co', 'ave', 'blvd', 'rd', 'dept', 'approx', 'min', 'max', 'jan', 'feb', 'mar', 'apr', 'jun', 'jul', "
         "'aug', 'sep', 'oct', 'nov', 'dec']")


def clean(x: str) -> str:
    x = f"translate({x}, '‘’‚“”„—– ​‌‍*_', '''''''\"\"\",, ')"
    x = f"replace({x}, '…', '...')"
    x = rf"regexp_replace({x}, '(?m)^#{{1,6}}\s+', '', 'g')"
    x = f"replace({x}, '`', '')"
    x = rf"regexp_replace({x}, '<[^>\n]{{1,80}}>', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?:,\s*){{2,}}', ', ', 'g')"
    x = rf"regexp_replace({x}, ',\s*\.', '.', 'g')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def sentences(source: str, keys: str, text: str, name: str = "sent") -> str:
    """CTEs ending in ``name(keys, k, text)``; ``text`` must be single-spaced."""
    return rf"""
{name}_w AS (SELECT {keys}, string_split({text}, ' ') AS w FROM {source} WHERE {text} <> ''),
{name}_b AS (SELECT {keys}, w, list_concat(list_filter(range(1, len(w)), lambda i:
    regexp_matches(w[i], '[.!?…]["''”’»)\]]*$')
    AND regexp_matches(w[i + 1], '^["''“‘”’(—\-–\[]*[\p{{Lu}}\p{{Nd}}]')
    AND NOT list_contains({_ABBR}, lower(regexp_replace(w[i], '[."''”’»\])]+$', '')))
    AND NOT regexp_full_match(regexp_replace(w[i], '[."''”’»\])]+$', ''), '\p{{L}}')),
    [len(w)]) AS e FROM {name}_w),
{name}_k AS (SELECT {keys}, w, e, unnest(range(1, len(e) + 1)) AS k FROM {name}_b),
{name} AS (SELECT {keys}, k - 1 AS k, array_to_string(
    w[(CASE WHEN k = 1 THEN 1 ELSE e[k - 1] + 1 END):e[k]], ' ') AS text FROM {name}_k)"""


def oversize(source: str, keys: str, name: str = "part") -> str:
    """CTEs ending in ``name(keys, k, p, text)``: recursive cutting, ``p`` orders the parts."""
    return rf"""
{name}_r AS (
  SELECT {keys}, k, '' AS p, text, false AS fin FROM {source}
  UNION ALL
  SELECT {keys}, k, p || side, piece, fin2 FROM (
    SELECT {keys}, k, p, unnest(['0', '1']) AS side, fin2,
      unnest(CASE WHEN fin2 THEN [text, '']
        WHEN cut IS NOT NULL AND cut - 1 >= 20
          THEN [rtrim(substr(text, 1, cut - 1), ' ,;:') || ',', trim(substr(text, cut + 1))]
        ELSE [rtrim(array_to_string(w[1:half], ' '), ' ,;:'), array_to_string(w[half + 1:], ' ')] END) AS piece
    FROM (SELECT *, NOT (cut IS NOT NULL AND cut - 1 >= 20) AND half >= len(w) AS fin2 FROM (
      SELECT *, string_split(text, ' ') AS w,
        greatest(4, least(30, len(string_split(text, ' ')) // 2)) AS half,
        list_max(list_filter(range(1, least(length(text), 200) + 1), lambda i:
          (substr(text, i, 1) IN (';', ':')
           OR regexp_matches(substr(text, i, 8), '(?i)^,\s+(?:and|but|so|yet)(?:[^\w]|$)'))
          AND len(list_filter(string_split(substr(text, 1, i - 1), ' '), lambda t: t <> '')) <= 30)) AS cut
      FROM {name}_r WHERE NOT fin AND (length(text) > 200 OR len(string_split(text, ' ')) > 30)))
  ) WHERE piece <> ''),
{name} AS (SELECT {keys}, k, p, text FROM {name}_r
  WHERE fin OR NOT (length(text) > 200 OR len(string_split(text, ' ')) > 30))"""


def cards(text: str) -> str:
    """List of caption cards of a single-spaced text."""
    packed = f"""list_reduce(string_split({text}, ' '), lambda a, x:
      CASE WHEN a.n = 0 THEN {{'g': a.g, 'c': x, 'n': 1}}
           WHEN a.n >= 8 OR length(a.c) + 1 + length(x) > 42
             THEN {{'g': list_append(a.g, a.c), 'c': x, 'n': 1}}
           ELSE {{'g': a.g, 'c': a.c || ' ' || x, 'n': a.n + 1}} END,
      {{'g': []::VARCHAR[], 'c': '', 'n': 0}})"""
    return f"""(SELECT CASE WHEN z.n = 1 AND len(z.g) >= 1
        THEN list_append(z.g[1:len(z.g) - 1], z.g[len(z.g)] || ' ' || z.c)
        ELSE list_append(z.g, z.c) END FROM (SELECT {packed} AS z))"""


def conv_units() -> str:
    """CTEs ending in ``u(conv_id, turn, s, text, groups, ends_story, nbytes)``."""
    return f"""
c0 AS (SELECT conv_id, turn, {clean('text')} AS text FROM conversations),
{sentences('c0', 'conv_id, turn', 'text')},
{oversize('sent', 'conv_id, turn')},
u AS (SELECT conv_id, turn, s, text, {cards('text')} AS groups,
        s = max(s) OVER (PARTITION BY conv_id, turn) AS ends_story, 2880 * length(text) AS nbytes
      FROM (SELECT conv_id, turn, text,
              row_number() OVER (PARTITION BY conv_id, turn ORDER BY k, p) - 1 AS s FROM part))"""


def conv_chunks() -> str:
    """... and ``ch``: units on the clock."""
    return f"""{conv_units()},
ch AS (SELECT *, CASE WHEN ends_story THEN 1200 ELSE 200 END AS sil,
    row_number() OVER o - 1 AS i,
    38400 + coalesce(sum(nbytes + 48 * (CASE WHEN ends_story THEN 1200 ELSE 200 END))
      OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS t0b,
    coalesce(sum(len(groups)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ev0
  FROM u WINDOW o AS (PARTITION BY conv_id ORDER BY turn, s))"""


def conv_events() -> str:
    """... and ``ev``: caption events."""
    return f"""{conv_chunks()},
ev0 AS (SELECT *, len(groups) AS g, least(900, nbytes // (48 * len(groups))) * 48 AS fl,
    list_sum(list_transform(groups, lambda x: length(x)))::BIGINT AS tot,
    unnest(range(0, len(groups))) AS grp FROM ch),
ev1 AS (SELECT *, groups[grp + 1] AS card,
    coalesce(list_sum(list_transform(groups[1:grp], lambda x: length(x))), 0)::BIGINT AS pre0,
    list_sum(list_transform(groups[1:grp + 1], lambda x: length(x)))::BIGINT AS pre1 FROM ev0),
ev AS (SELECT conv_id, ev0 + grp AS id, turn AS story, i AS sentence, grp, card AS text,
    CASE WHEN grp = 0 THEN t0b / 48
         ELSE ((t0b + fl * grp) * tot + (nbytes - fl * g) * pre0) / (tot * 48) END AS t0_ms,
    CASE WHEN grp = g - 1 THEN (t0b + nbytes) / 48
         ELSE ((t0b + fl * (grp + 1)) * tot + (nbytes - fl * g) * pre1) / (tot * 48) END AS t1_ms,
    ends_story AND grp = g - 1 AS story_end FROM ev1),
tot AS (SELECT conv_id, max(t0b + nbytes + 48 * sil) / 48 AS total_ms FROM ch GROUP BY conv_id)"""


def conv_segments(max_ms: float) -> str:
    """... and ``seg(conv_id, idx, t0_ms, t1_ms, story_first)``."""
    return f"""{conv_events()},
st AS (SELECT conv_id, id, t1_ms FROM ev UNION ALL SELECT conv_id, -1, 0.0 FROM tot),
jump AS (SELECT s.conv_id, s.id,
    coalesce(max(e.id) FILTER (e.story_end), max(e.id), s.id + 1) AS nxt
  FROM st s LEFT JOIN ev e ON e.conv_id = s.conv_id AND e.id > s.id AND e.t1_ms - s.t1_ms <= {max_ms}
  GROUP BY s.conv_id, s.id),
walk AS (
  SELECT conv_id, 0 AS idx, -1::BIGINT AS p, 0.0::DOUBLE AS t0 FROM tot
  UNION ALL
  SELECT w.conv_id, w.idx + 1, j.nxt, e.t1_ms FROM walk w
  JOIN jump j ON j.conv_id = w.conv_id AND j.id = w.p
  JOIN ev e ON e.conv_id = w.conv_id AND e.id = j.nxt
  JOIN tot ON tot.conv_id = w.conv_id WHERE w.t0 < tot.total_ms - 1),
seg AS (SELECT w.conv_id, w.idx, w.t0 AS t0_ms, coalesce(e.t1_ms, tot.total_ms) AS t1_ms,
    coalesce(f.story, l.story) AS story_first
  FROM walk w JOIN tot ON tot.conv_id = w.conv_id
  JOIN jump j ON j.conv_id = w.conv_id AND j.id = w.p
  LEFT JOIN ev e ON e.conv_id = w.conv_id AND e.id = j.nxt
  LEFT JOIN ev f ON f.conv_id = w.conv_id AND f.id = w.p + 1
  LEFT JOIN ev l ON l.conv_id = w.conv_id AND l.id = w.p
  WHERE w.t0 < tot.total_ms - 1)"""


def draw(text: str) -> str:
    """A whole number below 2**32: the first eight hex digits of a hash."""
    return f"('0x' || substr(sha256({text}), 1, 8))::BIGINT"
