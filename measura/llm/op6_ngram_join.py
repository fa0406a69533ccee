"""Query op6: groups of documents that 3-word shingles link at a Jaccard similarity of 0.9 or more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from measura.llm import ngram_join
from measura.sources.tables import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, num=90, den=100, keep=["doc_id"])


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + least(3, len(w)) - 1), ' ') AS token
           FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
     n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
     c AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM s a JOIN s b ON a.token = b.token AND a.doc_id <> b.doc_id GROUP BY 1, 2),
     e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
     r(node, label) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node)
SELECT r.node AS doc_id, coalesce(MAX(n.n), 0) AS n_shingles, MIN(label) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY r.node
"""
