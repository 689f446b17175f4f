"""DuckDB SQL of the queries that SQL can express.

The others have no SQL form (MinHash is only a way to the exact pairs of op1,
but zstandard ratios, token ids, sampling hashes, character models and page
layout have none); tests/llm holds them against brute force.
"""

from __future__ import annotations

from sparkloom.llm import collocations, cosine, fill_middle, licenses

OP1 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x09-\x0D ]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) END)) AS s FROM w),
d AS (SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(1))) AS t, s FROM s),
texts AS (SELECT t, n, any_value(s) AS s, count(*) AS copies, min(doc_id) AS first_id FROM d WHERE n > 0 GROUP BY 1, 2),
x AS (SELECT t, n, hash(unnest(s)) AS g FROM texts),
pairs AS (SELECT a.t AS a, b.t AS b FROM x a JOIN x b ON a.g = b.g AND a.t <> b.t GROUP BY a.t, b.t, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
reach AS (SELECT t AS node, t AS label FROM texts UNION SELECT p.b, r.label FROM reach r JOIN pairs p ON p.a = r.node),
class AS (SELECT node, min(label) AS label FROM reach GROUP BY 1),
ids AS (SELECT label, min(first_id) AS class_id FROM class JOIN texts ON node = t GROUP BY 1),
links AS (SELECT a, count(*) AS n_texts, sum(copies) AS n_docs FROM pairs JOIN texts ON b = t GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.n = 0 THEN d.doc_id ELSE class_id END AS class_id, CASE WHEN d.n = 0 THEN 0 ELSE copies - 1 + coalesce(n_docs, 0) END::BIGINT AS n_links, coalesce(n_texts, 0)::BIGINT AS n_text_links
FROM d LEFT JOIN texts ON d.t = texts.t AND d.n > 0 LEFT JOIN class ON texts.t = node LEFT JOIN ids ON class.label = ids.label LEFT JOIN links ON texts.t = a"""

OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20"""

OP6 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard": OP1, "op3_bitslice": OP3, "op5_licenses": licenses.oracle_sql(), "op6_warc": OP6, "op11_cosine": cosine.ORACLE, "op12_collocations": collocations.ORACLE, "op13_fill_middle": fill_middle.ORACLE}
