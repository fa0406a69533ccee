"""Sources and sinks as queries: a lattice is written in a format, read back by its source and held against the table
(survey 2.1, 2.9).

The lattice is small by construction: 16 x 16 cells for each ship year.  What is large goes through Spark's own sinks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from measura.functions import coding
from measura.session import materialize, shared_dir
from measura.sources import arrays, views, writers
from measura.sources.tables import spread, table

SIDE, LANES = 16, 1 << 16
CODECS = ("deflate", "zlib", "gzip", "zstd", "lz4", "snappy")


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, y, x, lane): every cell of the lattice, years numbered from 0, lanes modulo 2^16."""
    g = views.grid(spark, sf_dir)
    years = g.groupBy("t").agg(F.count("*").alias("cells")).withColumn("k", F.row_number().over(W.orderBy("t")) - 1)  # one row a year
    cells = years.select("t", "k").crossJoin(spark.range(SIDE * SIDE).select(F.floor(F.col("id") / SIDE).alias("y"), (F.col("id") % SIDE).alias("x")))
    return cells.join(g, ["t", "y", "x"], "left").select(F.col("k").cast("long").alias("t"), "y", "x", F.coalesce(F.col("lane") % LANES, F.lit(0)).alias("lane"))


def as_array(spark: SparkSession, sf_dir: str) -> np.ndarray:
    rows = whole(spark, sf_dir).collect()  # SIDE x SIDE cells a year
    out = np.zeros((max((r["t"] for r in rows), default=-1) + 1, SIDE, SIDE), np.uint16)
    for r in rows:
        out[r["t"], r["y"], r["x"]] = r["lane"]
    return out


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def longs(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) for c in ("t", "y", "x", "lane")))


def frames_first(df: DataFrame) -> DataFrame:
    """Formats of three axes have their frames on the axis that arrays calls z."""
    return df.select(F.col("z").alias("t"), "y", "x", "lane")


def source(suffix: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = folder(spark, "source")
        writers.put(spark, f"{path}/lattice.{suffix}", writers.WRITERS[suffix](as_array(spark, sf_dir)))
        return longs(frames_first(arrays.lattice(spark, path)))

    return query


def source_zarr(version: Callable[[np.ndarray, int], dict[str, bytes]]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{folder(spark, 'source')}/lattice"
        for name, data in version(as_array(spark, sf_dir), 5).items():
            writers.put(spark, f"{path}/{name}", data)
        return longs(frames_first(arrays.zarr(spark, path)))

    return query


def source_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of an archive as planes of little-endian lanes."""
    path = folder(spark, "source")
    writers.put(spark, f"{path}/lattice.zip", writers.zipped(as_array(spark, sf_dir)))

    def planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for member, data in zip(batch["member"].to_pylist(), batch["content"].to_pylist(), strict=True):
                lane = np.frombuffer(data, "<u2").astype(np.int64)
                place = np.arange(len(lane))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lane), int(member.rsplit("/", 1)[-1]))), pa.array(place // SIDE), pa.array(place % SIDE), pa.array(lane)], names=["t", "y", "x", "lane"])

    return arrays.zip_members(spark, path).mapInArrow(planes, "t long, y long, x long, lane long")


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, lanes, bits, payload): the lattice's frames in Rice codes, written to the shared folder."""
    lanes = whole(spark, sf_dir).groupBy("t").agg(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "lane"))), lambda c: c["lane"]).alias("lanes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [coding.encode(np.array(v, np.int64)) for v in batch["lanes"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["t"], pa.array([len(v) for v in batch["lanes"].to_pylist()], pa.int64()), pa.array([n for _, n in packed], pa.int64()), pa.array([b for b, _ in packed], pa.binary())], names=["t", "lanes", "bits", "payload"])

    return materialize(lanes.mapInArrow(run, "t long, lanes long, bits long, payload binary"), "coded")


def coding_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark, sf_dir).select("t", "lanes", "bits")


def coding_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lane, place = coding.decode(row["payload"], row["lanes"]), np.arange(row["lanes"])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), row["t"])), pa.array(place // SIDE), pa.array(place % SIDE), pa.array(lane)], names=["t", "y", "x", "lane"])

    return coded(spark, sf_dir).select("t", "lanes", "payload").mapInArrow(run, "t long, y long, x long, lane long")


def ingested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(what was read back, seals taken before writing): the quantities of all line items, a sample for each ship year."""
    rows = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("long").alias("sample"), "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("lane"))
    path = folder(spark, "ingest")
    rows.write.partitionBy("sample").parquet(path)
    back = spark.read.schema("l_orderkey long, l_linenumber long, lane long, sample long").parquet(path)
    return back, rows


def roots(rows: DataFrame) -> DataFrame:
    """(sample, root): a seal of each sample, which doesn't depend on the order of its rows: the digests of 64 buckets of
    rows, each the sum of its rows' digests."""
    leaf = F.conv(F.substring(F.sha2(F.concat_ws(":", "l_orderkey", "l_linenumber", "lane"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    buckets = rows.withColumn("bucket", F.pmod(F.col("l_orderkey"), F.lit(64))).groupBy("sample", "bucket").agg(F.sum(leaf).alias("sum"), F.count("*").alias("n"), F.sum("lane").alias("total"))
    parts = F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("bucket", "sum"))), lambda x: x["sum"].cast("string")))
    return buckets.groupBy("sample").agg(F.sum("n").alias("lanes"), F.sum("total").alias("total"), F.sha2(parts, 256).alias("root"))


def ingest_prove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample read back with the seal it had before it was written."""
    back, rows = ingested(spark, sf_dir)
    before = roots(rows).select("sample", F.col("root").alias("kept"))
    return roots(back).join(before, "sample", "full").select("sample", "lanes", "total", F.coalesce(F.col("root") == F.col("kept"), F.lit(False)).alias("proved"))


def set_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents of the set's samples, from the written files."""
    back, _ = ingested(spark, sf_dir)
    return back.groupBy("sample").agg(F.count("*").alias("lanes"), F.min("l_orderkey").alias("first_key"), F.max("l_orderkey").alias("last_key"))


def codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all documents packed and unpacked by every codec."""
    docs = spread(table(spark, sf_dir, "documents").select(F.encode("text", "UTF-8").alias("body")).where("body IS NOT NULL"))
    out = None
    for codec in CODECS:
        back = docs.withColumn("packed", arrays.encoded_as("body", codec)).withColumn("back", arrays.decoded("packed", codec))
        one = back.agg(F.lit(codec).alias("codec"), F.count("*").alias("texts"), F.sum(F.octet_length("back").cast("long")).alias("bytes"), F.sum(F.when(F.col("back") == F.col("body"), 0).otherwise(1)).alias("changed"))
        out = one if out is None else out.unionByName(one)
    return out


LATTICE = f"""
    WITH g AS (SELECT year(l_shipdate) AS t, l_partkey % {SIDE} AS y, l_suppkey % {SIDE} AS x, SUM(CAST(l_quantity AS BIGINT)) AS lane FROM lineitem GROUP BY ALL),
         k AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS k FROM (SELECT DISTINCT t FROM g)),
         cells AS (SELECT CAST(k AS BIGINT) AS t, y.range AS y, x.range AS x, CAST(coalesce(lane, 0) % {LANES} AS BIGINT) AS lane
                   FROM k CROSS JOIN range({SIDE}) y CROSS JOIN range({SIDE}) x LEFT JOIN g ON g.t = k.t AND g.y = y.range AND g.x = x.range)
"""
READ_BACK = LATTICE + "SELECT * FROM cells"
BITS = LATTICE + f""",
         d AS (SELECT t, y * {SIDE} + x AS i, lane - lag(lane, 1, 0) OVER (PARTITION BY t ORDER BY y, x) AS step FROM cells),
         v AS (SELECT t, i // {coding.BLOCK} AS block, CASE WHEN step < 0 THEN -2 * step - 1 ELSE 2 * step END AS v FROM d),
         c AS (SELECT t, block, k.range AS k, SUM(1 + k.range + (v >> k.range)) AS cost FROM v CROSS JOIN range({coding.PARAMETERS}) k GROUP BY ALL),
         b AS (SELECT t, block, MIN(cost) + 4 AS bits FROM c GROUP BY ALL)
    SELECT t, CAST({SIDE * SIDE} AS BIGINT) AS lanes, CAST(SUM(bits) AS BIGINT) AS bits FROM b GROUP BY t
"""

REGISTRY = {f"source_{name}": (source(suffix), READ_BACK) for name, suffix in (("npy", "npy"), ("npz", "npz"), ("stack", "stack"), ("nrrd", "nrrd"), ("nifti", "nii.gz"), ("tiff", "tif"), ("tiff_tiles", "tiled.tif"), ("dicom", "dcm"))} | {
    "source_zarr": (source_zarr(writers.zarr), READ_BACK),
    "source_zarr_3": (source_zarr(writers.zarr_3), READ_BACK),
    "source_zip": (source_zip, READ_BACK),
    "coding_bits": (coding_bits, BITS),
    "coding_round_trip": (coding_round_trip, READ_BACK),
    "ingest_prove": (ingest_prove, "SELECT year(l_shipdate) AS sample, COUNT(*) AS lanes, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, true AS proved FROM lineitem GROUP BY 1"),
    "set_extents": (set_extents, "SELECT year(l_shipdate) AS sample, COUNT(*) AS lanes, MIN(l_orderkey) AS first_key, MAX(l_orderkey) AS last_key FROM lineitem GROUP BY 1"),
    "codec_round_trip": (codec_round_trip, "SELECT codec, COUNT(*) AS texts, CAST(SUM(strlen(text)) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS changed FROM documents, (SELECT unnest(" + str(list(CODECS)) + ") AS codec) WHERE text IS NOT NULL GROUP BY codec"),
}
