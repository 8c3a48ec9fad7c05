"""The SQL of the source mix."""

MIXING = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord
    FROM documents
), numbered AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k
    FROM sized GROUP BY source
), caps AS (
    SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM numbered
), levels AS (
    SELECT *, ((sum(source_size) OVER ())::BIGINT
               - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
              / (sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
    FROM caps
), share AS (
    SELECT level FROM levels WHERE cap >= level * weight ORDER BY cap / weight, k LIMIT 1
), targets AS MATERIALIZED (
    SELECT source, k, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM share), 0.0) * weight) AS target FROM levels
), queued AS MATERIALIZED (
    SELECT s.doc_id, s.size, s.ord, t.k, t.source_size, t.target,
           (sum(s.size) OVER (PARTITION BY t.k ORDER BY s.ord, s.doc_id, s.size))::BIGINT AS upto
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copies AS (
    SELECT q.*, (upto + turn * source_size) / target AS finish
    FROM queued q, (SELECT unnest([0, 1, 2]) AS turn) WHERE size > 0
), ordered AS (
    SELECT *, sum(size) OVER (ORDER BY finish, k, ord, doc_id) AS total FROM copies
), taken AS (
    SELECT doc_id, k, size, count(*) * size AS words FROM ordered
    WHERE total <= (SELECT sum(source_size) FROM targets) GROUP BY doc_id, k, size
)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.words, 0)::BIGINT AS taken
FROM queued q LEFT JOIN taken t ON q.doc_id = t.doc_id AND q.k = t.k AND q.size = t.size
"""
