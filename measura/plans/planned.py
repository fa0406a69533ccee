"""Arrays written by tasks, one file or folder of shards a year, and read back by planned byte ranges (survey 2.1)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.session import shared_dir
from measura.sources import hdf5, planned
from measura.sources.tables import table

MONTHS, HEIGHT, WIDTH, LANES = 12, 40, 24, 1 << 16
CHUNK, SHARD = (5, 1, 16, 16), (10, 1, 32, 32)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, t, y, x, lane): quantities by month and two keys."""
    place = lambda c, n: F.pmod(c, F.lit(n)).cast("int")
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate IS NOT NULL").groupBy(F.year("l_shipdate").alias("year"), (F.month("l_shipdate") - 1).alias("t"), place("l_partkey", HEIGHT).alias("y"), place("l_suppkey", WIDTH).alias("x"))
    return rows.agg((F.sum(F.col("l_quantity").cast("long")) % LANES).cast("int").alias("lane"))


def hdf5_files(a: np.ndarray, name: str) -> dict[str, bytes]:
    return {f"{name}.h5": hdf5.write(a, CHUNK)}


def shard_files(a: np.ndarray, name: str) -> dict[str, bytes]:
    return {f"{name}/{k}": v for k, v in planned.zarr_shards(a, SHARD, CHUNK).items()}


def written(spark: SparkSession, sf_dir: str, files: Callable[[np.ndarray, str], dict[str, bytes]]) -> str:
    """The folder that the tasks have written, a year's array each: MONTHS x HEIGHT x WIDTH places at most."""
    folder = f"{shared_dir(spark)}/planned-{uuid.uuid4().hex}"

    def run(group: pa.Table) -> pa.Table:
        a = np.zeros((MONTHS, 1, HEIGHT, WIDTH), np.uint16)
        t, y, x = (group[c].to_numpy() for c in ("t", "y", "x"))
        a[t, 0, y, x] = group["lane"].to_numpy()
        store, root = planned.opened(folder)
        year, total = group["year"][0].as_py(), 0
        for name, data in files(a, str(year)).items():
            path = f"{root}/{name}"
            store.create_dir(path.rsplit("/", 1)[0])
            part = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"  # a task that runs twice replaces whole files by equal ones
            with store.open_output_stream(part) as out:
                out.write(data)
            store.move(part, path)
            total += len(data)
        return pa.table({"year": pa.array([year], pa.int32()), "bytes": pa.array([total], pa.int64())})

    store, root = planned.opened(folder)
    store.create_dir(root)
    cells(spark, sf_dir).groupBy("year").applyInArrow(run, "year int, bytes long").agg(F.sum("bytes")).collect()
    return folder


def plain(df: DataFrame) -> DataFrame:
    """The year and the lattice's places as whole numbers."""
    year = F.substring("sample", 1, 4).cast("long").alias("year")
    return df.select(year, *(F.col(c).cast("long").alias(c) for c in ("t", "y", "x", "lane")))


BOX = "t >= 3 AND t < 6 AND y >= 32 AND x <= 9"


def source_hdf5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(planned.arrays(spark, written(spark, sf_dir, hdf5_files)))


def source_hdf5_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of every year's array: of its 18 chunks, the two that hold it are read."""
    return plain(planned.arrays(spark, written(spark, sf_dir, hdf5_files)).where(BOX))


def source_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(planned.arrays(spark, written(spark, sf_dir, shard_files))).where("lane > 0")


def source_shards_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(planned.arrays(spark, written(spark, sf_dir, shard_files)).where(BOX)).where("lane > 0")


def hdf5_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of every file, from their indexes: places and how many of the array's cells each holds."""
    index = planned.chunk_index(spark, written(spark, sf_dir, hdf5_files))
    size = lambda c, chunk, n: F.least(F.lit(chunk), F.lit(n) - F.col(c))
    held = size("t", CHUNK[0], MONTHS) * size("y", CHUNK[2], HEIGHT) * size("x", CHUNK[3], WIDTH)
    return index.select(F.substring("sample", 1, 4).cast("long").alias("year"), "t", "y", "x", held.cast("long").alias("cells"), (F.col("bytes") > 0).alias("stored"))


GRID = f"""
    WITH g AS (SELECT CAST(year(l_shipdate) AS BIGINT) AS year, month(l_shipdate) - 1 AS t, l_partkey % {HEIGHT} AS y, l_suppkey % {WIDTH} AS x, CAST(SUM(CAST(l_quantity AS BIGINT)) % {LANES} AS BIGINT) AS lane FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY ALL),
         cells AS (SELECT k.year, t.range AS t, y.range AS y, x.range AS x, coalesce(lane, 0) AS lane FROM (SELECT DISTINCT year FROM g) k CROSS JOIN range({MONTHS}) t CROSS JOIN range({HEIGHT}) y CROSS JOIN range({WIDTH}) x
                   LEFT JOIN g ON g.year = k.year AND g.t = t.range AND g.y = y.range AND g.x = x.range)
    SELECT * FROM cells"""

REGISTRY = {
    "source_hdf5": (source_hdf5, GRID),
    "source_hdf5_box": (source_hdf5_box, f"{GRID} WHERE {BOX}"),
    "source_shards": (source_shards, f"{GRID} WHERE lane > 0"),
    "source_shards_box": (source_shards_box, f"{GRID} WHERE {BOX} AND lane > 0"),
    "hdf5_chunks": (
        hdf5_chunks,
        f"""
    SELECT k.year, t.range AS t, y.range AS y, x.range AS x, CAST(least({CHUNK[0]}, {MONTHS} - t.range) * least({CHUNK[2]}, {HEIGHT} - y.range) * least({CHUNK[3]}, {WIDTH} - x.range) AS BIGINT) AS cells, true AS stored
    FROM (SELECT DISTINCT CAST(year(l_shipdate) AS BIGINT) AS year FROM lineitem WHERE l_shipdate IS NOT NULL) k CROSS JOIN range(0, {MONTHS}, {CHUNK[0]}) t CROSS JOIN range(0, {HEIGHT}, {CHUNK[2]}) y CROSS JOIN range(0, {WIDTH}, {CHUNK[3]}) x""",
    ),
}
