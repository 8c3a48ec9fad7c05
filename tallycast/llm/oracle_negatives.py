"""SQL of the hard negative query: every anchor against every row."""

NEGATIVES = """
WITH usable AS (
  SELECT row_number() OVER () AS key, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.key, a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.code, b.code) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.key <> b.key AND (a.vec_id <> b.vec_id OR a.label <> b.label) WHERE a.vec_id % 100 = 0),
positives AS MATERIALIZED (
  SELECT key, anchor_id, other AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY key ORDER BY score DESC, other) AS place
  FROM scored WHERE same QUALIFY place <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.key, place ORDER BY score DESC, other) AS INTEGER) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.key = p.key AND NOT s.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""
