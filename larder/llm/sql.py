"""SQL of the queries that SQL can express."""

from __future__ import annotations

#: Exact pairs by counting shared three-word sequences.
NEAR_COPIES = r"""WITH w AS MATERIALIZED (SELECT DISTINCT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM all_chunks WHERE text IS NOT NULL),
t AS MATERIALIZED (SELECT DISTINCT chunk_id, hash(w[i], w[i + 1], w[i + 2]) AS t FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
n AS (SELECT chunk_id, count(*) AS n FROM t GROUP BY chunk_id),
p AS (SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b, count(*) AS shared FROM t a JOIN t b ON a.t = b.t AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
SELECT chunk_id_a, chunk_id_b FROM p JOIN n a ON a.chunk_id = chunk_id_a JOIN n b ON b.chunk_id = chunk_id_b WHERE shared >= 0.6 * (a.n + b.n - shared)"""

#: Every chunk of three words or more with the smallest id it reaches over links, and the number of its links.
CLASSES = (
    NEAR_COPIES.replace("WITH w AS", "WITH RECURSIVE w AS").replace("\nSELECT chunk_id_a, chunk_id_b FROM p", ",\nlinks AS MATERIALIZED (SELECT chunk_id_a, chunk_id_b FROM p")
    + """),
ways AS MATERIALIZED (SELECT chunk_id_a AS a, chunk_id_b AS b FROM links UNION ALL SELECT chunk_id_b, chunk_id_a FROM links),
reached AS (SELECT chunk_id AS node, chunk_id AS root FROM n UNION SELECT ways.b, reached.root FROM reached JOIN ways ON ways.a = reached.node)
SELECT node AS chunk_id, min(root) AS class_id, (SELECT count(*) FROM ways WHERE ways.a = node) AS links FROM reached GROUP BY node"""
)

OVERSIZED = """SELECT DISTINCT chunk_id FROM (SELECT chunk_id, length(text) + coalesce(length(metadata.folder), 0) + coalesce(length(metadata.doc_type), 0) + coalesce(length(metadata.source), 0) AS size
FROM all_chunks WHERE text IS NOT NULL) WHERE size > 2400"""
