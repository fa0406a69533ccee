"""Query op5: all documents mixed to target weights over domain, language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.llm import mixing
from measura.sources.tables import table

#: The sources of every domain; other sources are of the domain OTHER.  A parameter of the mix, as are the weights.
DOMAINS = {"web": [f"src{i}" for i in range(8)], "books": [f"src{i}" for i in range(8, 13)], "forums": [f"src{i}" for i in range(13, 17)], "code": [f"src{i}" for i in range(17, 20)]}
OTHER = "other"
#: Weights by node name at each level; nodes without one weigh 1.
WEIGHTS = [{"web": 4, "books": 3, "forums": 2, "code": 1}, {"en": 5, "de": 2, "fr": 2, "es": 1}, {"src0": 2}]
MAX_EPOCHS = 2


def levels() -> dict[str, Column]:
    domain = F.lit(OTHER)
    for name, sources in DOMAINS.items():
        domain = F.when(F.col("source").isin(sources), name).otherwise(domain)
    return {"domain": domain, "language": F.col("lang"), "origin": F.col("source")}


def budget() -> Column:
    """Three quarters of the tokens there are."""
    return F.expr("total * 3 div 4")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs, levels(), WEIGHTS, budget(), MAX_EPOCHS, keep=["doc_id"]).select("doc_id", "domain", "language", "origin", "leaf_budget", "uses")


def dealt(k: int, names: list[str], weights: dict[str, int], parent_budget: str) -> str:
    """SQL of one level: the children of every node of level k - 1 with their budgets."""
    own, up = ", ".join(names[:k]), ", ".join(names[: k - 1])
    weight = "CASE " + " ".join(f"WHEN {names[k - 1]} = '{n}' THEN {w}" for n, w in sorted(weights.items())) + " ELSE 1 END" if weights else "1"
    part = f"PARTITION BY {up} " if up else ""
    line = f"({part}ORDER BY cap::DOUBLE / greatest(weight, 1), {names[k - 1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
    c{k} AS (SELECT {own}, SUM(cap)::HUGEINT AS cap, ({weight})::HUGEINT AS weight FROM leaves GROUP BY {own}),
    p{k} AS (SELECT c{k}.*, {parent_budget} AS pb FROM c{k} {f"JOIN b{k - 1} USING ({up})" if up else ", root"}),
    f{k} AS (SELECT *, coalesce(SUM(cap) OVER {line}, 0) AS filled, SUM(weight) OVER ({part}) - coalesce(SUM(weight) OVER {line}, 0) AS onward FROM p{k}),
    g{k} AS (SELECT *, weight > 0 AND cap * onward <= greatest(0, pb - filled) * weight AS is_full FROM f{k}),
    h{k} AS (SELECT *, greatest(0, pb - coalesce(SUM(CASE WHEN is_full THEN cap END) OVER ({part}), 0)) AS rest, coalesce(SUM(CASE WHEN NOT is_full THEN weight END) OVER ({part}), 0) AS shares FROM g{k}),
    b{k} AS (SELECT {own}, (CASE WHEN is_full THEN cap ELSE least(cap, CASE WHEN shares > 0 THEN rest * weight // shares ELSE 0 END) END)::HUGEINT AS budget FROM h{k})"""


DOMAIN = "CASE " + " ".join(f"WHEN source IN ({', '.join(repr(x) for x in sources)}) THEN '{name}'" for name, sources in DOMAINS.items()) + f" ELSE '{OTHER}' END"
NAMES = ["domain", "language", "origin"]
ORACLE = f"""
WITH d AS (SELECT doc_id, {DOMAIN} AS domain, coalesce(lang, '') AS language, coalesce(source, '') AS origin, (strlen(coalesce(text, '')) + 3) // 4 AS tokens FROM documents),
     leaves AS (SELECT domain, language, origin, SUM(tokens)::HUGEINT AS supply, (SUM(tokens) * {MAX_EPOCHS})::HUGEINT AS cap FROM d GROUP BY ALL),
     root AS (SELECT least(SUM(supply) * 3 // 4, SUM(cap)) AS total FROM leaves),
     {dealt(1, NAMES, WEIGHTS[0], "total")}, {dealt(2, NAMES, WEIGHTS[1], "budget")}, {dealt(3, NAMES, WEIGHTS[2], "budget")},
     x AS (SELECT d.*, b.budget, CASE WHEN l.supply > 0 THEN b.budget // l.supply ELSE 0 END AS epochs, CASE WHEN l.supply > 0 THEN b.budget % l.supply ELSE 0 END AS front
           FROM d JOIN b3 b USING (domain, language, origin) JOIN leaves l USING (domain, language, origin)),
     y AS (SELECT *, SUM(tokens) OVER (PARTITION BY domain, language, origin ORDER BY md5('17:' || epochs || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM x)
SELECT doc_id, domain, language, origin, budget::BIGINT AS leaf_budget, (epochs + CASE WHEN upto <= front THEN 1 ELSE 0 END)::BIGINT AS uses FROM y
WHERE epochs + CASE WHEN upto <= front THEN 1 ELSE 0 END > 0
"""
