"""SQL of the phrase query, by plain lists of words."""

PHRASES = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
lines AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
occurrences AS (
  SELECT lang, k, unnest(list_transform(generate_series(1, CAST(len(w) - k + 1 AS BIGINT)), lambda i: list_slice(w, i, i + k - 1))) AS g
  FROM lines, (SELECT CAST(unnest(generate_series(1, 5)) AS BIGINT) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM occurrences GROUP BY lang, k, g),
totals AS MATERIALIZED (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
frequent AS MATERIALIZED (SELECT lang, k, g, f AS a FROM f WHERE f >= 100),
candidates AS MATERIALIZED (SELECT * FROM frequent WHERE k >= 2),
covered AS (
  SELECT lang, list_slice(g, i, i + j - 1) AS part, max(a) AS most
  FROM (SELECT *, unnest(generate_series(1, CAST(k AS BIGINT))) AS i FROM candidates), (SELECT unnest(generate_series(2, 4)) AS j)
  WHERE i + j - 1 <= k AND j < k GROUP BY lang, part),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN covered v ON v.lang = c.lang AND v.part = c.g WHERE v.most IS NULL OR 100 * v.most < 100 * c.a),
cuts AS (
  SELECT c.lang, c.g, c.a, c.k, cut, x.a AS l, y.a AS r, t.n, CAST(1000 * CAST(c.a AS HUGEINT) * t.n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(generate_series(1, CAST(k - 1 AS BIGINT))) AS cut FROM kept) c
  JOIN frequent x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, cut)
  JOIN frequent y ON y.lang = c.lang AND y.g = list_slice(c.g, cut + 1, c.k) JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
         array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM best)
SELECT * FROM ranked WHERE rank <= 2000"""
