"""Censuses, n-grams, byte pairs and word profiles of text (survey 2.2, 2.3, 2.5).

Ranks follow the rule: by count, then by first appearance (document, then place).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.operators import census
from measura.plans.shared import family, other_form
from measura.session import materialize
from measura.sources import views
from measura.sources.tables import table


def collision_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.collision_census(table(spark, sf_dir, "documents"), "doc_id", "text")


RANKED = """ranked AS (
          SELECT sym, n, CAST(ROW_NUMBER() OVER (ORDER BY n DESC, first_at) AS BIGINT) AS place FROM (
            SELECT sym, SUM(n) AS n, MIN(PAIR(doc_id, first_pos)) AS first_at FROM (
              SELECT sym, doc_id, COUNT(*) AS n, MIN(pos) AS first_pos FROM s GROUP BY sym, doc_id) x GROUP BY sym) y)"""

#: Pairs are counted before their symbols are ranked, so that only distinct pairs meet the ranks.
WEB = """,
             j AS (SELECT x.place AS a, y.place AS b, p.n FROM (SELECT sym, nxt, COUNT(*) AS n FROM s2 WHERE nxt IS NOT NULL GROUP BY sym, nxt) p
                   JOIN ranked x ON p.sym = x.sym JOIN ranked y ON p.nxt = y.sym WHERE x.place <= 24 AND y.place <= 24)"""

CENTROIDS = """
        WITH c AS (SELECT word, COUNT(*) AS n, MIN(PAIR(doc_id, pos)) AS first_at FROM w GROUP BY word),
             top AS (SELECT word FROM (SELECT word, ROW_NUMBER() OVER (ORDER BY n DESC, first_at) AS place FROM c) x WHERE place <= 30),
             d AS (SELECT w.doc_id, w.lang, w.word, COUNT(*) AS n FROM w JOIN top t ON w.word = t.word GROUP BY w.doc_id, w.lang, w.word),
             m AS (SELECT lang, COUNT(DISTINCT doc_id) AS docs FROM d GROUP BY lang),
             l AS (SELECT lang, word, CAST(SUM(n) AS BIGINT) AS n FROM d GROUP BY lang, word),
             f AS (SELECT m.lang, t.word, m.docs, COALESCE(l.n, 0) AS n FROM m CROSS JOIN top t LEFT JOIN l ON l.lang = m.lang AND l.word = t.word),
             g AS (SELECT x.doc_id, x.lang AS own, f.lang, SUM(POWER(COALESCE(d.n, 0) - CAST(f.n - CASE WHEN x.lang = f.lang THEN COALESCE(d.n, 0) ELSE 0 END AS DOUBLE) / GREATEST(1, f.docs - CASE WHEN x.lang = f.lang THEN 1 ELSE 0 END), 2)) AS dist
                   FROM (SELECT DISTINCT doc_id, lang FROM d) x CROSS JOIN f LEFT JOIN d ON d.doc_id = x.doc_id AND d.word = f.word GROUP BY x.doc_id, x.lang, f.lang)
        SELECT own, picked, COUNT(*) AS n FROM (SELECT own, lang AS picked, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY ROUND(dist, 6), lang) AS place FROM g) y WHERE place = 1 GROUP BY own, picked"""
TOP_WORDS = 30


def nearest_centroid_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the language whose mean profile of the commonest words is the nearest, its own text left out of the mean.

    A document is one row with its counts of the top words, and meets each language once; rows that share an id and differ in
    language are compared with all counts of the id, as the SQL form does.
    """
    words = views.words(spark, sf_dir)
    ranks = words.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first_at")).orderBy(F.desc("n"), "first_at").limit(TOP_WORDS)
    top = materialize(ranks.select("word").coalesce(1).withColumn("k", F.monotonically_increasing_id()), "centroid-words")
    size = top.count()
    counts = F.array(*(F.count(F.when(F.col("k") == k, 1)) for k in range(size))) if size else F.array().cast("array<bigint>")
    docs = materialize(words.join(F.broadcast(top), "word").groupBy("doc_id", "lang").agg(counts.alias("d")), "centroid-docs")
    sums = F.array(*(F.sum(F.get("d", F.lit(k))) for k in range(size))) if size else F.array().cast("array<bigint>")
    means = docs.groupBy("lang").agg(F.count("doc_id").alias("docs"), sums.alias("n"))
    # A null language's words aren't its own in the SQL form.
    means = means.select("lang", "docs", F.when(F.col("lang").isNull(), F.transform("n", lambda x: F.lit(0).cast("long"))).otherwise(F.col("n")).alias("n"))
    entries = docs.groupBy("doc_id").agg(F.collect_list(F.struct("lang", "d")).alias("es"))
    held = F.when(F.col("doc_id").isNotNull(), F.transform("es", lambda e: e["d"])).otherwise(F.array().cast("array<array<bigint>>"))
    asked = entries.select("doc_id", held.alias("ds"), F.explode(F.transform("es", lambda e: e["lang"])).alias("own"))
    same = F.coalesce(F.col("own") == F.col("lang"), F.lit(False)).cast("long")
    over = F.greatest(F.lit(1).cast("long"), F.col("docs") - same)
    step = lambda d, n: F.pow(d - (n - same * d).cast("double") / over, F.lit(2.0))
    alone = F.aggregate(F.zip_with(F.col("ds")[0], "n", step), F.lit(0.0), lambda s, x: s + x)

    def at(n: Column, k: Column) -> Column:
        found = F.filter(F.transform("ds", lambda d: F.get(d, k)), lambda c: c > 0)
        return F.aggregate(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(0).cast("long"))), F.lit(0.0), lambda s, c: s + step(c, n))

    several = F.aggregate(F.transform("n", at), F.lit(0.0), lambda s, x: s + x)
    far = asked.crossJoin(F.broadcast(means)).select("doc_id", "own", "lang", F.when(F.size("ds") == 1, alone).otherwise(several).alias("far"))
    picked = far.groupBy("doc_id").agg(F.min(F.struct(F.round("far", 6).alias("far"), "lang", "own")).alias("m"))
    return picked.groupBy(F.col("m.own").alias("own"), F.col("m.lang").alias("picked")).agg(F.count("*").alias("n"))


REGISTRY = {
    "nearest_centroid_lang": (nearest_centroid_lang, other_form(CENTROIDS)),
    "collision_census": (
        collision_census,
        """
        WITH s AS (SELECT doc_id, unnest(string_split(text, '')) AS sym FROM documents),
             c AS (SELECT doc_id, sym, COUNT(*) AS n FROM s GROUP BY ALL)
        SELECT doc_id, CAST(SUM(n) AS BIGINT) AS total, COUNT(*) AS distinct_syms,
               CAST(SUM(n * n) AS BIGINT) AS sum_sq,
               100 * SUM(n) * SUM(n) < 85 * COUNT(*) * SUM(n * n) AS prefers_free
        FROM c GROUP BY doc_id
        """,
    ),
} | family(
    collision_entropy="""
        WITH n AS (SELECT doc_id, sym, COUNT(*) AS n FROM s GROUP BY doc_id, sym)
        SELECT doc_id, ROUND(-LOG2(CAST(SUM(n * n) AS DOUBLE) / (CAST(SUM(n) AS DOUBLE) * CAST(SUM(n) AS DOUBLE))), 9) AS bits FROM n GROUP BY doc_id""",
    top_share="""
        WITH n AS (SELECT doc_id, sym, COUNT(*) AS n FROM s GROUP BY doc_id, sym)
        SELECT doc_id, MAX(n) AS top, CAST(SUM(n) AS BIGINT) AS total, COUNT(*) AS distinct_syms FROM n GROUP BY doc_id""",
    block_census=(
        """
        WITH n AS (SELECT doc_id, b2, COUNT(*) AS n FROM s3 WHERE b2 IS NOT NULL GROUP BY doc_id, b2)
        SELECT doc_id, COUNT(*) AS blocks, CAST(SUM(n) AS BIGINT) AS total, CAST(SUM(n * n) AS BIGINT) AS sum_sq FROM n GROUP BY doc_id""",
        """
        WITH g AS (SELECT doc_id, sym || LEAD(sym) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM s),
             n AS (SELECT doc_id, block, COUNT(*) AS n FROM g WHERE block IS NOT NULL GROUP BY doc_id, block)
        SELECT doc_id, COUNT(*) AS blocks, CAST(SUM(n) AS BIGINT) AS total, CAST(SUM(n * n) AS BIGINT) AS sum_sq FROM n GROUP BY doc_id""",
    ),
    block_increments=(
        """
        WITH d AS (SELECT doc_id, EXPLODE(FILTER(ARRAY(STRUCT(1L AS k, k1 AS kinds, CAST(NULL AS BIGINT) AS fewer), STRUCT(2L AS k, k2 AS kinds, k1 AS fewer), STRUCT(3L AS k, k3 AS kinds, k2 AS fewer)), x -> x.kinds > 0)) AS x FROM block_kinds)
        SELECT doc_id, x.k AS k, x.kinds, x.kinds - x.fewer AS more FROM d""",
        """
        WITH g AS (SELECT doc_id, sym AS b1, sym || LEAD(sym) OVER (PARTITION BY doc_id ORDER BY pos) AS b2,
                          sym || LEAD(sym) OVER (PARTITION BY doc_id ORDER BY pos) || LEAD(sym, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS b3 FROM s),
             f AS (SELECT doc_id, 1 AS k, b1 AS b FROM g UNION ALL SELECT doc_id, 2, b2 FROM g WHERE b2 IS NOT NULL UNION ALL SELECT doc_id, 3, b3 FROM g WHERE b3 IS NOT NULL),
             n AS (SELECT doc_id, k, b, COUNT(*) AS n FROM f GROUP BY doc_id, k, b),
             d AS (SELECT doc_id, k, CAST(COUNT(*) AS BIGINT) AS kinds FROM n GROUP BY doc_id, k)
        SELECT doc_id, CAST(k AS BIGINT) AS k, kinds, kinds - LAG(kinds) OVER (PARTITION BY doc_id ORDER BY k) AS more FROM d""",
    ),
    block_entropy=(
        "SELECT doc_id, ROUND(bits, 6) AS bits FROM pair_bits",
        """
        WITH g AS (SELECT doc_id, sym || LEAD(sym) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM s),
             n AS (SELECT doc_id, b, COUNT(*) AS n FROM g WHERE b IS NOT NULL GROUP BY doc_id, b),
             t AS (SELECT doc_id, b, n, SUM(n) OVER (PARTITION BY doc_id) AS t FROM n)
        SELECT doc_id, ROUND(-SUM(CAST(n AS DOUBLE) / t * LOG2(CAST(n AS DOUBLE) / t)), 6) AS bits FROM t GROUP BY doc_id""",
    ),
    reseat_first_seen="""
        WITH f AS (SELECT doc_id, sym, MIN(pos) AS first_pos, COUNT(*) AS n FROM s GROUP BY doc_id, sym)
        SELECT doc_id, sym, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY first_pos) - 1 AS BIGINT) AS seat, n FROM f""",
    coarsen_top=(
        """
        WITH """ + RANKED + """,
             n AS (SELECT doc_id, sym, COUNT(*) AS n FROM s GROUP BY doc_id, sym)
        SELECT n.doc_id, CASE WHEN r.place <= 15 THEN r.sym ELSE '#' END AS sym, SUM(n.n) AS n
        FROM n JOIN ranked r ON n.sym = r.sym GROUP BY n.doc_id, CASE WHEN r.place <= 15 THEN r.sym ELSE '#' END""",
        """
        WITH """ + RANKED + """
        SELECT s.doc_id, CASE WHEN r.place <= 15 THEN r.sym ELSE '#' END AS sym, COUNT(*) AS n
        FROM s JOIN ranked r ON s.sym = r.sym GROUP BY s.doc_id, CASE WHEN r.place <= 15 THEN r.sym ELSE '#' END""",
    ),
    symbol_ranks="WITH " + RANKED + " SELECT sym, CAST(n AS BIGINT) AS n, place FROM ranked",
    utf8_widths="""
        SELECT doc_id, CASE WHEN b < 128 THEN 1 WHEN b >= 240 THEN 4 WHEN b >= 224 THEN 3 WHEN b >= 192 THEN 2 END AS width, COUNT(*) AS n
        FROM o WHERE b < 128 OR b >= 192 GROUP BY doc_id, CASE WHEN b < 128 THEN 1 WHEN b >= 240 THEN 4 WHEN b >= 224 THEN 3 WHEN b >= 192 THEN 2 END""",
    case_runs="""
        WITH u AS (SELECT doc_id, pos, pos - ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM o WHERE b BETWEEN 65 AND 90),
             r AS (SELECT doc_id, island, COUNT(*) AS len FROM u GROUP BY doc_id, island)
        SELECT doc_id, COUNT(*) AS runs, MAX(len) AS longest, CAST(SUM(CASE WHEN len >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS long_runs, CAST(SUM(len) AS BIGINT) AS capitals FROM r GROUP BY doc_id""",
    script_share="""
        SELECT doc_id, CAST(SUM(CASE WHEN b BETWEEN 65 AND 90 OR b BETWEEN 97 AND 122 THEN 1 ELSE 0 END) AS BIGINT) AS latin,
               CAST(SUM(CASE WHEN b >= 192 THEN 1 ELSE 0 END) AS BIGINT) AS wide, CAST(SUM(CASE WHEN b < 128 OR b >= 192 THEN 1 ELSE 0 END) AS BIGINT) AS characters FROM o GROUP BY doc_id""",
    byte_pair_support=(
        """
        SELECT pair, SUM(n) AS n, COUNT(*) AS docs FROM (SELECT pair, doc_id, COUNT(*) AS n FROM o2 GROUP BY pair, doc_id) x GROUP BY pair""",
        """
        WITH p AS (SELECT doc_id, b * 256 + LEAD(b) OVER (PARTITION BY doc_id ORDER BY pos) AS pair FROM o)
        SELECT pair, COUNT(*) AS n, COUNT(DISTINCT doc_id) AS docs FROM p WHERE pair IS NOT NULL GROUP BY pair""",
    ),
    byte_levels="""
        SELECT b, COUNT(*) AS n, CAST(MIN(pos) AS BIGINT) AS first_pos FROM o GROUP BY b""",
    total_variation_lang="""
        WITH c AS (SELECT lang, word, COUNT(*) AS n FROM w GROUP BY lang, word),
             t AS (SELECT lang, CAST(SUM(n) AS BIGINT) AS t FROM c GROUP BY lang),
             l AS (SELECT a.lang AS l1, b.lang AS l2, a.t AS t1, b.t AS t2 FROM t a CROSS JOIN t b WHERE a.lang < b.lang),
             v AS (SELECT DISTINCT word FROM c)
        SELECT l.l1, l.l2, CAST(SUM(ABS(COALESCE(x.n, 0) * l.t2 - COALESCE(y.n, 0) * l.t1)) AS BIGINT) AS numerator, MAX(2 * l.t1 * l.t2) AS denominator
        FROM l CROSS JOIN v LEFT JOIN c x ON x.lang = l.l1 AND x.word = v.word LEFT JOIN c y ON y.lang = l.l2 AND y.word = v.word
        WHERE x.n IS NOT NULL OR y.n IS NOT NULL GROUP BY l.l1, l.l2""",
    split_half_distance=(
        "SELECT doc_id, numerator, denominator FROM halves",
        """
        WITH h AS (SELECT doc_id, sym, pos, MAX(pos) OVER (PARTITION BY doc_id) + 1 AS n FROM s),
             c AS (SELECT doc_id, sym, CAST(SUM(CASE WHEN pos < DIV(n, 2) THEN 1 ELSE 0 END) AS BIGINT) AS a, CAST(SUM(CASE WHEN pos >= DIV(n, 2) THEN 1 ELSE 0 END) AS BIGINT) AS b FROM h GROUP BY doc_id, sym),
             t AS (SELECT doc_id, CAST(SUM(a) AS BIGINT) AS ta, CAST(SUM(b) AS BIGINT) AS tb FROM c GROUP BY doc_id)
        SELECT c.doc_id, CAST(SUM(ABS(c.a * t.tb - c.b * t.ta)) AS BIGINT) AS numerator, MAX(2 * t.ta * t.tb) AS denominator FROM c JOIN t ON c.doc_id = t.doc_id GROUP BY c.doc_id""",
    ),
    common_vocabulary="""
        WITH c AS (SELECT word, COUNT(*) AS n, MIN(PAIR(doc_id, pos)) AS first_at FROM w GROUP BY word)
        SELECT word, n, place FROM (SELECT word, n, CAST(ROW_NUMBER() OVER (ORDER BY n DESC, first_at) AS BIGINT) AS place FROM c) x WHERE place <= 50""",
    word_profile="""
        WITH c AS (SELECT word, COUNT(*) AS n, MIN(PAIR(doc_id, pos)) AS first_at FROM w GROUP BY word),
             top AS (SELECT word FROM (SELECT word, ROW_NUMBER() OVER (ORDER BY n DESC, first_at) AS place FROM c) x WHERE place <= 50)
        SELECT w.doc_id, w.word, COUNT(*) AS n FROM w JOIN top t ON w.word = t.word GROUP BY w.doc_id, w.word""",
    word_length_hist="""
        SELECT lang, CAST(LEAST(LENGTH(word), 20) AS BIGINT) AS len, COUNT(*) AS n FROM w GROUP BY lang, CAST(LEAST(LENGTH(word), 20) AS BIGINT)""",
    word_length_spread="""
        SELECT doc_id, COUNT(*) AS n, CAST(SUM(LEAST(LENGTH(word), 20)) AS BIGINT) AS total, CAST(SUM(LEAST(LENGTH(word), 20) * LEAST(LENGTH(word), 20)) AS BIGINT) AS squares FROM w GROUP BY doc_id""",
    line_surprise=(
        """
        WITH c AS (SELECT pair, SUM(n) AS n FROM on2 GROUP BY pair), t AS (SELECT SUM(n) AS t FROM c),
             d AS (SELECT doc_id, pair, n AS m FROM on2)
        SELECT /*+ BROADCAST(c) */ d.doc_id, ROUND(SUM(-d.m * LOG2((c.n + 1.0E0) / (t.t + 65536.0E0))) / SUM(d.m), 6) AS bits FROM d JOIN c ON d.pair = c.pair CROSS JOIN t GROUP BY d.doc_id""",
        """
        WITH p AS (SELECT doc_id, b * 256 + LEAD(b) OVER (PARTITION BY doc_id ORDER BY pos) AS pair FROM o),
             c AS (SELECT pair, COUNT(*) AS n FROM p WHERE pair IS NOT NULL GROUP BY pair),
             t AS (SELECT CAST(SUM(n) AS BIGINT) AS t FROM c),
             d AS (SELECT doc_id, pair, COUNT(*) AS m FROM p WHERE pair IS NOT NULL GROUP BY doc_id, pair)
        SELECT d.doc_id, ROUND(SUM(-d.m * LOG2((c.n + 1.0E0) / (t.t + 65536.0E0))) / SUM(d.m), 6) AS bits FROM d JOIN c ON d.pair = c.pair CROSS JOIN t GROUP BY d.doc_id""",
    ),
    bigram_web=(
        "WITH " + RANKED + WEB + " SELECT a, b, n FROM j",
        """
        WITH """ + RANKED + """,
             r AS (SELECT s.doc_id, s.pos, k.place, LEAD(k.place) OVER (PARTITION BY s.doc_id ORDER BY s.pos) AS next_place FROM s JOIN ranked k ON s.sym = k.sym)
        SELECT place AS a, next_place AS b, COUNT(*) AS n FROM r WHERE place <= 24 AND next_place <= 24 GROUP BY place, next_place""",
    ),
    bigram_pmi=(
        "WITH " + RANKED + WEB + """,
             x AS (SELECT a, b, n, SUM(n) OVER (PARTITION BY a) AS na, SUM(n) OVER (PARTITION BY b) AS nb, SUM(n) OVER () AS t FROM j)
        SELECT a, b, ROUND(LOG2((n + 0.5E0) * t / (CAST(na AS DOUBLE) * nb)), 6) AS pmi FROM x""",
        """
        WITH """ + RANKED + """,
             r AS (SELECT s.doc_id, k.place AS a, LEAD(k.place) OVER (PARTITION BY s.doc_id ORDER BY s.pos) AS b FROM s JOIN ranked k ON s.sym = k.sym),
             j AS (SELECT a, b, COUNT(*) AS n FROM r WHERE a <= 24 AND b <= 24 GROUP BY a, b),
             x AS (SELECT a, b, n, SUM(n) OVER (PARTITION BY a) AS na, SUM(n) OVER (PARTITION BY b) AS nb, SUM(n) OVER () AS t FROM j)
        SELECT a, b, ROUND(LOG2((n + 0.5E0) * t / (CAST(na AS DOUBLE) * nb)), 6) AS pmi FROM x""",
    ),
    profile_distance="""
        WITH c AS (SELECT lang, word, COUNT(*) AS n FROM w GROUP BY lang, word),
             t AS (SELECT lang, word, CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY lang) AS p FROM c),
             v AS (SELECT DISTINCT word FROM c), l AS (SELECT DISTINCT lang FROM c)
        SELECT a.lang AS l1, b.lang AS l2, ROUND(SQRT(SUM(POWER(COALESCE(x.p, 0) - COALESCE(y.p, 0), 2))), 9) AS distance
        FROM l a JOIN l b ON a.lang < b.lang CROSS JOIN v LEFT JOIN t x ON x.lang = a.lang AND x.word = v.word LEFT JOIN t y ON y.lang = b.lang AND y.word = v.word GROUP BY a.lang, b.lang""",
)
