"""Exact pattern search as a cascade of filters (survey 2.7, 2.16).

Needles are slices of benchmark items: 12 code points from place 8.  Occurrences overlap.  Anchors are three code
points of the needle from the places slot * (m div 4) + (slot * 7) mod (m div 4).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.operators import membership, sift
from measura.plans.shared import family, other_form
from measura.session import materialize
from measura.sources import views
from measura.sources.tables import spread, table

HASHES, BITS = 3, 1 << 16


def bloom_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of the benchmark the documents' Bloom filter may hold."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(views.WORD), F.lit(0))
    words = texts(spark, sf_dir).select(F.explode(F.array_distinct(found)).alias("word"))
    held = membership.build(words, "word", HASHES, BITS)
    asked = table(spark, sf_dir, "benchmark").select(F.explode(found).alias("word")).distinct()
    return membership.contains(asked, "word", held, HASHES, BITS)


NEEDLES = "needles AS (SELECT item_id, SUBSTR(text, 9, 12) AS needle FROM benchmark WHERE LENGTH(text) >= 20)"
ANCHORS = NEEDLES + """,
             slots AS (SELECT k AS slot, k * 3 + (k * 7) % 3 AS off FROM rungs WHERE k < 4),
             anchors AS (SELECT item_id, slot, off, SUBSTR(needle, CAST(off + 1 AS INT), 3) AS sym, needle FROM needles CROSS JOIN slots),
             grams AS (SELECT doc_id, pos, sym || LEAD(sym, 1) OVER (PARTITION BY doc_id ORDER BY pos) || LEAD(sym, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS sym FROM s)"""
SURVIVORS = ANCHORS + """,
             hits AS (SELECT a.item_id, s.doc_id, s.pos - a.off AS spot, COUNT(*) AS agree FROM anchors a JOIN grams s ON s.sym = a.sym WHERE s.pos >= a.off GROUP BY a.item_id, s.doc_id, s.pos - a.off),
             alive AS (SELECT item_id, doc_id, spot FROM hits WHERE agree = 4)"""

WIDTH, SLOTS, LEVELS, STRIDE = 12, 4, 3, 4
OFFSETS = (0, 4, 8, 9)


def needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where("length(text) >= 20").select("item_id", F.expr(f"substring(text, 9, {WIDTH})").alias("needle"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, needle, slot, off, run): the four anchors of every needle."""
    slot = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("slot"), F.lit(o).cast("long").alias("off")) for k, o in enumerate(OFFSETS)))).alias("a")
    rows = needles(spark, sf_dir).select("item_id", "needle", slot).select("item_id", "needle", "a.*")
    return rows.withColumn("run", sift.run_code(F.expr("substring(needle, CAST(off + 1 AS INT), 3)")))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchors() with their counts in the documents and places from rare to frequent."""
    return materialize(sift.rarest(anchors(spark, sf_dir), sift.run_counts(texts(spark, sf_dir)), "item_id", "slot"), "sift-anchors")


def holds(off: Column | int) -> Column:
    """Whether a window holds its needle's anchor at an offset."""
    off = off if isinstance(off, Column) else F.lit(off)
    part = lambda c: F.substring(F.col(c), (off + 1).cast("int"), F.lit(3))
    return (part("win") == part("needle")) & (F.char_length(part("win")) == 3)


def first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, needle, off, doc, length, spot, win): places of each needle's rarest anchor."""
    rare = ranked(spark, sf_dir).where("place = 1").select("item_id", "needle", "off", "run")
    return sift.places(texts(spark, sf_dir), rare, WIDTH)


def alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that hold all four anchors."""
    found = first_hits(spark, sf_dir)
    for off in OFFSETS:
        found = found.where(holds(off))
    return found


def survivor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alive(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("alive"), F.count_distinct("doc").alias("docs"))


def needle_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alive(spark, sf_dir).where("win = needle").groupBy("item_id", F.col("doc").alias("doc_id")).agg(F.count("*").alias("found"))


def probe_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).select("item_id", "slot", "n", "place")


def probe_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that the first anchor is compared with, and those that are left for the second."""
    total = table(spark, sf_dir, "documents").agg(F.coalesce(F.sum(F.char_length("text").cast("long")), F.lit(0)).alias("first_reads"))
    return ranked(spark, sf_dir).where("place = 1").crossJoin(F.broadcast(total)).select("item_id", "first_reads", F.col("n").alias("second_reads"))


def death_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At which anchor, from rare to frequent, the places of the first one end."""
    order = ranked(spark, sf_dir)
    later = order.where("place > 1").groupBy("item_id").agg(*(F.max(F.when(F.col("place") == k, F.col("off"))).alias(f"off{k}") for k in (2, 3, 4)))
    hits = sift.places(texts(spark, sf_dir), order.where("place = 1").select("item_id", "needle", "off", "run"), WIDTH).join(later, "item_id")
    levels = F.when(~holds(F.col("off2")), 1).when(~holds(F.col("off3")), 2).when(~holds(F.col("off4")), 3).otherwise(4)
    return hits.groupBy("item_id", levels.cast("long").alias("levels")).agg(F.count("*").alias("n"))


def raster_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.expr("spot * 16 div length").alias("cell")
    return alive(spark, sf_dir).groupBy("item_id", cell).agg(F.count("*").alias("n"), F.min("spot").alias("lo"), F.max("spot").alias("hi"))


def survivors_by_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the first anchor that hold the last one too."""
    first = anchors(spark, sf_dir).where("slot = 0").select("item_id", "needle", "off", "run")
    first = first.withColumn("later", sift.run_code(F.substring("needle", OFFSETS[-1] + 1, 3)))
    found = sift.places(texts(spark, sf_dir), first, WIDTH, gap=OFFSETS[-1]).where(holds(0)).where(holds(OFFSETS[-1]))
    return found.select("item_id", F.col("doc").alias("doc_id"), "spot").distinct()


def descended(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[DataFrame]]:
    found = first_hits(spark, sf_dir).select("item_id", "needle", "doc", "spot", "win")
    return sift.descend(found, "item_id", "needle", WIDTH, LEVELS, STRIDE)


def descent_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What needle_count finds, by greedy descent from the rarest anchor."""
    return descended(spark, sf_dir)[0].where("win = needle").groupBy("item_id", F.col("doc").alias("doc_id")).agg(F.count("*").alias("found"))


def descent_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probes that the descent chose and what each left standing."""
    _, plan = descended(spark, sf_dir)
    out = plan[0]
    for level in plan[1:]:
        out = out.unionByName(level)
    return out


WORDS = views.WORD.replace("'", "''")
FNV = "list_reduce(list_prepend(CAST({start} AS BIGINT), [CAST(('0x' || x) AS BIGINT) for x in regexp_extract_all(hex(encode(word)), '..')]), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"
BLOOM = f"""
        WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORDS}')) AS word FROM documents), q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORDS}')) AS word FROM benchmark),
             hw AS (SELECT word, {FNV.format(start=membership.START)} AS a, {FNV.format(start=membership.START + 1)} AS b FROM w), hq AS (SELECT word, {FNV.format(start=membership.START)} AS a, {FNV.format(start=membership.START + 1)} AS b FROM q),
             bits AS (SELECT DISTINCT (a + i * b) % {BITS} AS bit FROM hw, (SELECT unnest(range({HASHES})) AS i)),
             asked AS (SELECT DISTINCT word, (a + i * b) % {BITS} AS bit FROM hq, (SELECT unnest(range({HASHES})) AS i))
        SELECT asked.word, COUNT(*) = COUNT(bits.bit) AS maybe FROM asked LEFT JOIN bits ON asked.bit = bits.bit GROUP BY asked.word"""

NEEDLE_SQL = other_form(
    "WITH " + SURVIVORS + """
        SELECT v.item_id, v.doc_id, COUNT(*) AS found FROM alive v JOIN documents d ON d.doc_id = v.doc_id JOIN needles n ON n.item_id = v.item_id
        WHERE SUBSTR(d.text, CAST(v.spot + 1 AS INT), 12) = n.needle GROUP BY v.item_id, v.doc_id"""
)


def level_sql(k: int) -> str:
    earlier = "".join(f" AND o.range <> (SELECT b.o FROM b{j} b WHERE b.item_id = i.item_id)" for j in range(1, k))
    return f"""
             h{k} AS MATERIALIZED (SELECT item_id, o.range AS o, SUM(CASE WHEN SUBSTR(win, CAST(o.range + 1 AS INT), 1) = SUBSTR(needle, CAST(o.range + 1 AS INT), 1) THEN 1 ELSE 0 END) AS standing FROM a{k - 1} CROSS JOIN range({WIDTH}) o WHERE spot % {STRIDE} = 0 GROUP BY item_id, o.range),
             b{k} AS MATERIALIZED (SELECT i.item_id, min(struct_pack(standing := coalesce(h.standing, 0), o := o.range)).o AS o FROM (SELECT DISTINCT item_id FROM a{k - 1}) i CROSS JOIN range({WIDTH}) o LEFT JOIN h{k} h ON h.item_id = i.item_id AND h.o = o.range WHERE true{earlier} GROUP BY i.item_id),
             a{k} AS MATERIALIZED (SELECT a.* FROM a{k - 1} a JOIN b{k} b ON b.item_id = a.item_id WHERE SUBSTR(a.win, CAST(b.o + 1 AS INT), 1) = SUBSTR(a.needle, CAST(b.o + 1 AS INT), 1))"""


DESCENT_SQL = other_form(
    "WITH " + ANCHORS + """,
             f AS (SELECT sym, COUNT(*) AS n FROM grams WHERE sym IS NOT NULL GROUP BY sym),
             p AS (SELECT a.item_id, a.needle, a.off, a.sym, ROW_NUMBER() OVER (PARTITION BY a.item_id ORDER BY COALESCE(f.n, 0), a.slot) AS place FROM anchors a LEFT JOIN f ON a.sym = f.sym),
             a0 AS MATERIALIZED (SELECT p.item_id, p.needle, x.pos - p.off AS spot, SUBSTR(d.text, CAST(x.pos - p.off + 1 AS INT), 12) AS win FROM p JOIN grams x ON x.sym = p.sym JOIN documents d ON d.doc_id = x.doc_id WHERE p.place = 1 AND x.pos >= p.off),"""
    + ",".join(level_sql(k) for k in range(1, LEVELS + 1))
    + " UNION ALL ".join(f" SELECT b.item_id, CAST({k} AS BIGINT) AS level, CAST(b.o AS BIGINT) AS off, (SELECT COUNT(*) FROM a{k} a WHERE a.item_id = b.item_id) AS standing FROM b{k} b" for k in range(1, LEVELS + 1))
)

REGISTRY = {
    "bloom_membership": (bloom_membership, BLOOM),
    "survivor_counts": (survivor_counts, other_form("WITH " + SURVIVORS + " SELECT item_id, COUNT(*) AS alive, COUNT(DISTINCT doc_id) AS docs FROM alive GROUP BY item_id")),
    "needle_count": (needle_count, NEEDLE_SQL),
    "probe_order": (probe_order, other_form("WITH " + ANCHORS + """,
             f AS (SELECT sym, COUNT(*) AS n FROM grams WHERE sym IS NOT NULL GROUP BY sym)
        SELECT a.item_id, a.slot, COALESCE(f.n, 0) AS n, CAST(ROW_NUMBER() OVER (PARTITION BY a.item_id ORDER BY COALESCE(f.n, 0), a.slot) AS BIGINT) AS place FROM anchors a LEFT JOIN f ON a.sym = f.sym""")),
    "probe_reads": (probe_reads, other_form("WITH " + ANCHORS + """,
             f AS (SELECT sym, COUNT(*) AS n FROM grams WHERE sym IS NOT NULL GROUP BY sym), t AS (SELECT COUNT(*) AS t FROM s),
             p AS (SELECT a.item_id, COALESCE(f.n, 0) AS n, ROW_NUMBER() OVER (PARTITION BY a.item_id ORDER BY COALESCE(f.n, 0), a.slot) AS place FROM anchors a LEFT JOIN f ON a.sym = f.sym)
        SELECT item_id, t.t AS first_reads, MAX(CASE WHEN place = 1 THEN n END) AS second_reads FROM p CROSS JOIN t GROUP BY item_id, t.t""")),
    "death_levels": (death_levels, other_form("WITH " + ANCHORS + """,
             f AS (SELECT sym, COUNT(*) AS n FROM grams WHERE sym IS NOT NULL GROUP BY sym),
             p AS (SELECT a.item_id, a.off, a.sym, ROW_NUMBER() OVER (PARTITION BY a.item_id ORDER BY COALESCE(f.n, 0), a.slot) AS place FROM anchors a LEFT JOIN f ON a.sym = f.sym),
             first_hit AS (SELECT p.item_id, s.doc_id, s.pos - p.off AS spot FROM p JOIN grams s ON s.sym = p.sym WHERE p.place = 1 AND s.pos >= p.off),
             later AS (SELECT f.item_id, f.doc_id, f.spot, p.place FROM first_hit f JOIN p ON p.item_id = f.item_id JOIN grams s ON s.doc_id = f.doc_id AND s.pos = f.spot + p.off AND s.sym = p.sym WHERE p.place > 1),
             l AS (SELECT f.item_id, f.doc_id, f.spot, 1 AS h1, MAX(CASE WHEN v.place = 2 THEN 1 ELSE 0 END) AS h2, MAX(CASE WHEN v.place = 3 THEN 1 ELSE 0 END) AS h3, MAX(CASE WHEN v.place = 4 THEN 1 ELSE 0 END) AS h4
                   FROM first_hit f LEFT JOIN later v ON v.item_id = f.item_id AND v.doc_id = f.doc_id AND v.spot = f.spot GROUP BY f.item_id, f.doc_id, f.spot)
        SELECT item_id, CAST(h1 + h1 * h2 + h1 * h2 * h3 + h1 * h2 * h3 * h4 AS BIGINT) AS levels, COUNT(*) AS n FROM l WHERE h1 = 1 GROUP BY item_id, CAST(h1 + h1 * h2 + h1 * h2 * h3 + h1 * h2 * h3 * h4 AS BIGINT)""")),
    "raster_cells": (raster_cells, other_form("WITH " + SURVIVORS + """,
             len AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id)
        SELECT v.item_id, DIV(v.spot * 16, l.n) AS cell, COUNT(*) AS n, MIN(v.spot) AS lo, MAX(v.spot) AS hi FROM alive v JOIN len l ON l.doc_id = v.doc_id GROUP BY v.item_id, DIV(v.spot * 16, l.n)""")),
    "survivors_by_intersection": (survivors_by_intersection, other_form("WITH " + ANCHORS + """
        SELECT a.item_id, x.doc_id, x.pos - a.off AS spot FROM anchors a JOIN grams x ON x.sym = a.sym WHERE a.slot = 0 AND x.pos >= a.off
        INTERSECT SELECT a.item_id, x.doc_id, x.pos - a.off AS spot FROM anchors a JOIN grams x ON x.sym = a.sym WHERE a.slot = 3 AND x.pos >= a.off""")),
    "descent_count": (descent_count, NEEDLE_SQL),
    "descent_plan": (descent_plan, DESCENT_SQL),
} | family(
    anchor_offsets="WITH " + ANCHORS + " SELECT item_id, slot, off, sym FROM anchors",
    equality_pattern_count=(
        """
        SELECT doc_id, SUM(CASE WHEN c0 = c2 AND c1 = c3 THEN 1 ELSE 0 END) AS abab, SUM(CASE WHEN c0 = c3 AND c1 = c2 THEN 1 ELSE 0 END) AS abba FROM s4 WHERE c3 IS NOT NULL GROUP BY doc_id""",
        """
        WITH p AS (SELECT doc_id, pos, sym, LEAD(sym, 1) OVER (PARTITION BY doc_id ORDER BY pos) AS s1, LEAD(sym, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS s2, LEAD(sym, 3) OVER (PARTITION BY doc_id ORDER BY pos) AS s3 FROM s)
        SELECT doc_id, CAST(SUM(CASE WHEN sym = s2 AND s1 = s3 THEN 1 ELSE 0 END) AS BIGINT) AS abab, CAST(SUM(CASE WHEN sym = s3 AND s1 = s2 THEN 1 ELSE 0 END) AS BIGINT) AS abba FROM p WHERE s3 IS NOT NULL GROUP BY doc_id""",
    ),
    rank_projection="""
        WITH f AS (SELECT doc_id, sym, COUNT(*) AS n, MIN(pos) AS first_pos FROM s GROUP BY doc_id, sym)
        SELECT doc_id, sym, LEAST(255, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY n, first_pos) - 1 AS BIGINT)) AS rank_byte FROM f""",
    dispatch_choice="""
        WITH n AS (SELECT doc_id, sym, COUNT(*) AS n FROM s GROUP BY doc_id, sym)
        SELECT doc_id, CASE WHEN 100 * SUM(n) * SUM(n) < 85 * COUNT(*) * SUM(n * n) THEN 'free' ELSE 'in order' END AS engine FROM n GROUP BY doc_id""",
)
