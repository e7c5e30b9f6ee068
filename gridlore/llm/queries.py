"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridlore.llm import asof, dedup, language, lines, mixing, negatives, packing, pages, pii, quality, sharding, vectors, warc


#: All pairs by label and cosine, then the least vector reachable over links.
VECTORS = """
    WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
    r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id WHERE r.root < l.b),
    c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
    SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON id = vec_id"""

#: All pairs by shared shingles, then the least document reachable over links.
SHINGLES = """
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
    r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id WHERE r.root < l.b),
    c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c ON id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": packing.op1,
        "op2_embedding_near_dedup": vectors.op2,
        "op3_sharding": sharding.op3,
        "op4_minhash_near_dedup": dedup.op4,
        "op5_language_id": language.op5,
        "op6_mixing": mixing.op6,
        "op7_pii": pii.op7,
        "op8_warc": warc.op8,
        "op9_html_extraction": pages.op9,
        "op10_quality_rules": quality.op10,
        "op11_line_dedup": lines.op11,
        "op12_tolerant_asof_join": asof.op12,
        "op13_hard_negatives": negatives.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_near_dedup": VECTORS, "op4_minhash_near_dedup": SHINGLES, "op8_warc": warc.ORACLE, "op10_quality_rules": quality.oracle(), "op11_line_dedup": lines.ORACLE, "op12_tolerant_asof_join": asof.ORACLE, "op13_hard_negatives": negatives.ORACLE}
