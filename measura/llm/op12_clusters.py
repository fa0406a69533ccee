"""Query op12: 40 centroids of the quantised embeddings, by five exact rounds over distinct vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.llm import lloyd
from measura.sources.tables import table

CLUSTERS, ROUNDS, DIMENSION, SCALE, SEED = 40, 5, 64, 256, 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centres = lloyd.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), CLUSTERS, ROUNDS, dimension=DIMENSION, scale=SCALE, seed=SEED)
    own = centres.select("cluster", F.col("inertia").alias("cluster_inertia"), F.col("total").alias("inertia"), "centroid_sha256")
    return rows.join(F.broadcast(own), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def assigned(centres: str) -> str:
    """SQL of the nearest centroid (c) and its distance (d) of every vector."""
    far = "list_sum(list_transform(list_zip(k.q, m.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    return f"SELECT id, v, q, w.d AS d, w.c AS c FROM (SELECT k.id, any_value(k.v) AS v, any_value(k.q) AS q, min(struct_pack(d := CAST({far} AS BIGINT), c := m.c)) AS w FROM kept k CROSS JOIN {centres} m GROUP BY k.id)"


def moved(r: int) -> str:
    mean = "(s - ((s % n) + n) % n) // n"  # a floor: division cuts towards zero
    each = "SELECT c, i, SUM(q[i]) AS s, COUNT(*) AS n FROM (SELECT c, q, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY c, i".format(r=r)
    new = f"SELECT c, list(CAST({mean} AS BIGINT) ORDER BY i) AS q FROM ({each}) GROUP BY c"
    return f"a{r} AS MATERIALIZED ({assigned(f'm{r}')}), m{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.q, o.q) AS q FROM m{r} o LEFT JOIN ({new}) n USING (c))"


ORACLE = f"""
WITH kept AS MATERIALIZED (
       SELECT row_number() OVER () AS id, vec_id AS v, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
       WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSION}),
     m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT q, sha256('{SEED}:' || v) AS h FROM kept WHERE v IS NOT NULL ORDER BY h, q LIMIT {CLUSTERS})),
     {", ".join(moved(r) for r in range(ROUNDS))},
     last AS MATERIALIZED ({assigned(f"m{ROUNDS}")}),
     own AS (SELECT c, CAST(SUM(d) AS BIGINT) AS inertia FROM last GROUP BY c)
SELECT l.v AS vec_id, CAST(l.c AS INTEGER) AS cluster, l.d AS distance, own.inertia AS cluster_inertia, (SELECT CAST(SUM(d) AS BIGINT) FROM last) AS inertia, sha256(array_to_string(m.q, ',')) AS centroid_sha256
FROM last l JOIN own USING (c) JOIN m{ROUNDS} m USING (c)
"""
