"""Query op2: secrets in every whole document, with the corpus-wide ownership of their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.llm import secrets
from measura.sources.tables import spread, table


def count(kind: str) -> Column:
    return F.size(F.filter("found", lambda x: x["kind"] == secrets.KINDS.index(kind))).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    found = secrets.scan(docs, keep=["doc_id"])
    base = F.filter("found", lambda x: x["kind"] < len(secrets.BASE))
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in secrets.BASE),
        F.sha2(secrets.rendered(base), 256).alias("base_sha256"),
        secrets.rendered(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda x: x["live"])).cast("long").alias("n_live"),
    )


def found_by(kind: str) -> str:
    """SQL of the spans of one kind: starts from the lengths of matches and of what lies between them."""
    pattern, group, least = (secrets.BASE | secrets.ADDED)[kind]
    pattern = (secrets.QUICK | {"token": "[A-Za-z0-9_-]{24,}"}).get(kind, pattern).replace("'", "''")
    more = " AND regexp_matches(v[i], '[0-9]') AND regexp_matches(v[i], '[A-Z]') AND regexp_matches(v[i], '[a-z]')" if kind in secrets.ADDED else ""
    return f"""
    SELECT * EXCLUDE (fine) FROM (
      SELECT id, {secrets.KINDS.index(kind)} AS kind, '{kind}' AS name, v[i] AS value, length(v[i]) >= {least}{more} AS fine,
             CAST(SUM(length(g[i])) OVER (PARTITION BY id ORDER BY i) + coalesce(SUM(length(m[i])) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, length(m[i]) AS n
      FROM (SELECT id, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v, string_split_regex(t, '{pattern}') AS g FROM d))) WHERE fine"""


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t, source FROM documents),
     base AS ({" UNION ALL ".join(found_by(k) for k in secrets.BASE)}),
     added AS ({" UNION ALL ".join(found_by(k) for k in secrets.ADDED)}),
     spans AS (SELECT * FROM base UNION ALL SELECT * FROM added a WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.id = a.id AND a.s < b.s + b.n AND b.s < a.s + a.n)),
     used AS (SELECT value, COUNT(DISTINCT coalesce(source, chr(0))) AS owners, COUNT(DISTINCT t) AS repositories FROM spans JOIN d USING (id) GROUP BY value),
     kept AS (SELECT spans.*, owners <= 2 AND repositories <= 8 AS live FROM spans JOIN used USING (value) WHERE kind < {len(secrets.BASE)} OR (owners <= 2 AND repositories <= 8)),
     r AS (SELECT id, {", ".join(f"COUNT(*) FILTER (name = '{k}') AS n_{k}" for k in secrets.BASE)}, string_agg(name || ':' || s || ':' || (s + n), ',' ORDER BY s, kind) FILTER (kind < {len(secrets.BASE)}) AS b,
                  string_agg(name || ':' || s || ':' || (s + n), ',' ORDER BY s, kind) AS a, COUNT(*) FILTER (live) AS n_live FROM kept GROUP BY id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.BASE)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans, coalesce(n_live, 0) AS n_live FROM d LEFT JOIN r USING (id)
"""
