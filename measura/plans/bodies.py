"""Nearest points against a null, bodies and their cores (survey 2.5, 2.8, 2.11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.operators import cloud, erosion, frames
from measura.session import materialize
from measura.sources import views
from measura.sources.tables import table

AXES, SCALE, SEED = ["x", "y", "z"], 1000, 1


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, z): the first three components of the embeddings in whole thousandths."""
    rows = table(spark, sf_dir, "embeddings").where("size(embedding) >= 3")
    part = lambda k: F.floor(F.get("embedding", k).cast("double") * SCALE).cast("long")
    return rows.select(F.col("vec_id").alias("id"), *(part(k).alias(a) for k, a in enumerate(AXES)))


def cloud_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud.nearest(points(spark, sf_dir), AXES).select("id", "nearest", "distance")


def cloud_against_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared distances and directions of the nearest steps, of the cloud and of its axes dealt anew."""
    rows = points(spark, sf_dir)
    real = cloud.tensor(cloud.nearest(rows, AXES), AXES).select(F.lit("cloud").alias("of"), "*")
    return real.unionByName(cloud.tensor(cloud.nearest(cloud.shuffled(rows, AXES, seed=SEED), AXES), AXES).select(F.lit("null").alias("of"), "*"))


def erosion_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return erosion.widths(views.occupied(spark, sf_dir), ["day"], ["z", "y"])


def body_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's bodies with their mass, their largest width, the cells that have it, and the body of the next day that shares most
    cells with them (ties: the smallest)."""
    cells = materialize(views.occupied(spark, sf_dir).withColumn("cell", F.expr("day * 1024 + z * 32 + y")), "body-cells")
    rooted = materialize(frames.components_of_cells(cells, "cell", ["day"], ["z", "y"]), "body-roots")
    wide = rooted.join(erosion.widths(cells, ["day"], ["z", "y"]), ["day", "z", "y"])
    census = wide.groupBy("day", "root", "width").agg(F.count("*").alias("n")).groupBy("day", "root").agg(F.sum("n").alias("mass"), F.max(F.struct("width", "n")).alias("core"))
    later = rooted.select((F.col("day") - 1).alias("day"), "z", "y", F.col("root").alias("next"))
    met = rooted.join(later, ["day", "z", "y"]).groupBy("day", "root", "next").agg(F.count("*").alias("shared"))
    best = met.groupBy("day", "root").agg(F.max(F.struct("shared", (-F.col("next")).alias("minus"))).alias("m")).select("day", "root", (-F.col("m.minus")).alias("next"), F.col("m.shared").alias("shared"))
    return census.join(best, ["day", "root"], "left").select("day", "root", "mass", F.col("core.width").alias("width"), F.col("core.n").alias("core"), "next", F.coalesce("shared", F.lit(0)).alias("shared"))


POINTS = f"""p AS MATERIALIZED (SELECT vec_id AS id, {", ".join(f"CAST(floor(CAST(embedding[{k + 1}] AS DOUBLE) * {SCALE}) AS BIGINT) AS {a}" for k, a in enumerate(AXES))} FROM embeddings WHERE len(embedding) >= 3)"""
DEALT = f"""d AS MATERIALIZED (SELECT a.id, a.x, b.y, c.z FROM (SELECT id, x, row_number() OVER (ORDER BY id) AS n FROM p) a
             JOIN (SELECT y, row_number() OVER (ORDER BY md5('{SEED}:y:' || id), id) AS n FROM p) b USING (n) JOIN (SELECT z, row_number() OVER (ORDER BY md5('{SEED}:z:' || id), id) AS n FROM p) c USING (n))"""


def near_sql(of: str) -> str:
    far = " + ".join(f"(b.{a} - a.{a}) * (b.{a} - a.{a})" for a in AXES)
    return f"SELECT a.id, min(struct_pack(d := {far}, n := b.id, x := b.x - a.x, y := b.y - a.y, z := b.z - a.z)) AS m FROM {of} a JOIN {of} b ON a.id <> b.id GROUP BY a.id"


def tensor_sql(name: str, of: str) -> str:
    products = ", ".join(f"CAST(SUM(m.{a} * m.{b}) AS BIGINT) AS {a}{b}" for i, a in enumerate(AXES) for b in AXES[i:])
    return f"SELECT '{name}' AS of, COUNT(*) AS points, CAST(SUM(m.d) AS BIGINT) AS distance, {products} FROM ({near_sql(of)})"


CELLS = f"c AS MATERIALIZED ({views.SQL['c']})"
#: The nearest place outside, by steps along the axes.
WIDTHS = "w AS MATERIALIZED (SELECT c.day, c.z, c.y, CAST(MIN(abs(i.range) + abs(j.range)) AS BIGINT) AS width FROM c CROSS JOIN range(-9, 10) i CROSS JOIN range(-17, 18) j WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.day = c.day AND o.z = c.z + i.range AND o.y = c.y + j.range) GROUP BY c.day, c.z, c.y)"
ROOTS = """n AS MATERIALIZED (SELECT *, day * 1024 + z * 32 + y AS cell FROM c),
         reach(day, cell, label) AS (SELECT day, cell, cell FROM n UNION SELECT b.day, b.cell, r.label FROM reach r JOIN n a ON a.cell = r.cell JOIN n b ON b.day = a.day AND abs(a.z - b.z) + abs(a.y - b.y) = 1 AND b.cell > r.label),
         rooted AS MATERIALIZED (SELECT day, cell, MIN(label) AS root FROM reach GROUP BY day, cell)"""
COMPONENTS = f"WITH RECURSIVE {CELLS}, {ROOTS} SELECT n.day, n.z, n.y, n.cell, r.root FROM n JOIN rooted r ON r.cell = n.cell"

REGISTRY = {
    "cloud_nearest": (cloud_nearest, f"WITH {POINTS} SELECT id, m.n AS nearest, m.d AS distance FROM ({near_sql('p')})"),
    "cloud_against_null": (cloud_against_null, f"WITH {POINTS}, {DEALT} {tensor_sql('cloud', 'p')} UNION ALL {tensor_sql('null', 'd')}"),
    "erosion_widths": (erosion_widths, f"WITH {CELLS}, {WIDTHS} SELECT * FROM w"),
    "body_cores": (
        body_cores,
        f"""
    WITH RECURSIVE {CELLS}, {WIDTHS}, {ROOTS},
         b AS MATERIALIZED (SELECT n.day, n.z, n.y, r.root, w.width FROM n JOIN rooted r USING (cell) JOIN w ON w.day = n.day AND w.z = n.z AND w.y = n.y),
         k AS (SELECT day, root, COUNT(*) AS mass, MAX(width) AS width FROM b GROUP BY day, root),
         m AS (SELECT a.day, a.root, o.root AS next, COUNT(*) AS shared FROM b a JOIN b o ON o.day = a.day + 1 AND o.z = a.z AND o.y = a.y GROUP BY ALL),
         best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY day, root ORDER BY shared DESC, next) = 1)
    SELECT k.day, k.root, k.mass, k.width, (SELECT COUNT(*) FROM b WHERE b.day = k.day AND b.root = k.root AND b.width = k.width) AS core, best.next, coalesce(best.shared, 0) AS shared
    FROM k LEFT JOIN best ON best.day = k.day AND best.root = k.root""",
    ),
}
