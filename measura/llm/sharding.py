"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.  Native: DataFrame functions only.

The ring has ``cells`` equal cells.  Every shard owns ``vnodes`` points on it, and a cell belongs to the first point
at or after it, clockwise.  A row's cell is a hash of its key.  Each shard may hold its share of the rows and no more
(shares differ by one row at most and add up to all rows), so loads are bounded exactly.  A row stays in the shard of
its cell while that shard has room; the rows above that continue clockwise, first come first served, to the next
points whose shards have room.  Only rows of full shards move.

Edge cases: rows without a key are spread by a hash of their text; null and empty texts have size ``overhead``;
repeated rows are separate rows with slots of their own; ties within a cell are broken by hash, key, size and
checksum, so that only identical rows can trade places; an empty table gives an empty result.  Input columns named
like an output column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from measura.session import materialize

LAW = "rows"


def ring_points(spark, shards: int, vnodes: int, cells: int, seed: int) -> DataFrame:
    """(pos, shard, v): where the virtual nodes stand."""
    ids = spark.range(shards * vnodes)
    shard, v = (F.col("id") % shards).cast("int"), F.floor(F.col("id") / shards).cast("int")
    return ids.select(F.pmod(F.xxhash64(F.lit(seed), shard, v), F.lit(cells)).cast("int").alias("pos"), shard.alias("shard"), v.alias("v"))


def next_or_first(column: str) -> Column:
    """The value of the first cell at or after a cell that has one, or of the first of all: a running value from behind,
    as a frame that reaches ahead would be walked again for every row."""
    behind = W.orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, W.currentRow)
    value = F.when(F.col(column).isNotNull(), F.struct("cell", F.col(column).alias("v")))
    return F.coalesce(F.last(column, True).over(behind), F.min(value).over(W.partitionBy())["v"])


def cell_owners(spark, points: DataFrame, cells: int) -> DataFrame:
    """(cell, shard): the first point at or after the cell; past the last point the ring starts again."""
    first = points.groupBy("pos").agg(F.min_by("shard", F.struct("shard", "v")).alias("at"))
    ring = spark.range(cells).select(F.col("id").cast("int").alias("cell")).join(F.broadcast(first), F.col("cell") == F.col("pos"), "left")
    return ring.select("cell", next_or_first("at").alias("shard"))


def clockwise(points: DataFrame, room: DataFrame, overflow: DataFrame) -> DataFrame:
    """(first, shard, take): the overflowing rows, numbered along the ring, as the points take them in two turns.

    One fold over shards x vnodes points: its size is a parameter and doesn't depend on the rows.
    """
    stops = (
        points.join(F.broadcast(overflow.groupBy("pos").agg(F.sum("over").alias("over"))), "pos", "left")
        .groupBy()
        .agg(F.sort_array(F.collect_list(F.struct("pos", "shard", "v", F.coalesce("over", F.lit(0)).alias("over")))).alias("stops"))
    )
    rooms = room.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "free"))), lambda x: x["free"]).alias("rooms"))
    # A cell's overflow joins the queue once, at its own point; several shards may stand on one point.
    turns = F.expr("concat(transform(stops, (x, i) -> named_struct('shard', x.shard, 'over', IF(i > 0 AND stops[i - 1].pos = x.pos, 0L, x.over))), transform(stops, x -> named_struct('shard', x.shard, 'over', 0L)))")
    fold = F.expr(
        """aggregate(turns,
             named_struct('queue', 0L, 'done', 0L, 'rooms', rooms, 'out', cast(array() AS array<struct<first: bigint, shard: int, take: bigint>>)),
             (s, x) -> named_struct(
               'queue', s.queue + x.over - least(s.queue + x.over, s.rooms[x.shard]),
               'done', s.done + least(s.queue + x.over, s.rooms[x.shard]),
               'rooms', IF(least(s.queue + x.over, s.rooms[x.shard]) = 0, s.rooms,
                           transform(s.rooms, (r, i) -> IF(i = x.shard, r - least(s.queue + x.over, r), r))),
               'out', IF(least(s.queue + x.over, s.rooms[x.shard]) = 0, s.out,
                         array_append(s.out, named_struct('first', s.done, 'shard', x.shard, 'take', least(s.queue + x.over, s.rooms[x.shard])))) ),
             s -> s.out)"""
    )
    both = stops.join(F.broadcast(rooms))
    return both.withColumn("turns", turns).select(F.explode(fold).alias("x")).select("x.first", "x.shard", "x.take")


def segments(counts: DataFrame, points: DataFrame, shards: int) -> DataFrame:
    """(cell, lo, hi, shard, base): rows of a cell with lo <= rank < hi go to the shard, at slots from base."""
    everything = W.partitionBy()
    cap = F.floor(F.col("total") / shards) + F.when(F.col("shard") < F.col("total") % shards, 1).otherwise(0)
    before = F.sum("n").over(W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    own = (
        counts.withColumn("total", F.sum("n").over(everything))
        .withColumn("cap", cap)
        .withColumn("keep", F.greatest(F.lit(0), F.least(F.col("n"), F.col("cap") - F.coalesce(before, F.lit(0)))))
        .withColumn("over", F.col("n") - F.col("keep"))
    )
    own = materialize(own.coalesce(1), "ring-own")
    # A shard may own no cell at all when its points coincide with others': it still has room.
    total = own.groupBy().agg(F.coalesce(F.max("total"), F.lit(0)).alias("total"))
    every = points.select("shard").distinct().join(F.broadcast(total))
    kept = own.groupBy("shard").agg(F.sum("keep").alias("kept"))
    room = every.join(kept, "shard", "left").select("shard", (cap - F.coalesce("kept", F.lit(0))).cast("long").alias("free"))
    # An overflowing cell enters the walk at the point that owns it.
    stand = points.select("pos").distinct().withColumn("cell", F.col("pos")).withColumn("is_point", F.lit(True))
    over = own.join(F.broadcast(stand), "cell", "left").withColumn("to", next_or_first("pos"))
    over = over.where("over > 0").select("cell", F.col("to").alias("pos"), "keep", "over", "n")
    # Cells after the last point wrap to the first one and so come first in its queue.
    wraps = F.when(F.col("cell") > F.col("pos"), 0).otherwise(1)
    line = W.orderBy(wraps, "cell").rowsBetween(W.unboundedPreceding, -1)
    over = materialize(over.withColumn("first", F.coalesce(F.sum("over").over(line), F.lit(0))).coalesce(1), "ring-over")
    taken = clockwise(points, room, over)
    marks = over.select("first", F.col("cell"), F.lit(None).cast("int").alias("shard"), "keep", "over").unionByName(
        taken.select("first", F.lit(None).cast("int").alias("cell"), "shard", F.lit(None).cast("long").alias("keep"), F.lit(None).cast("long").alias("over"))
    )
    at = W.orderBy("first", F.col("cell").isNull())
    upto = at.rowsBetween(W.unboundedPreceding, W.currentRow)
    cuts = marks.select(
        F.col("first").alias("start"),
        F.lead("first").over(at).alias("stop"),
        F.last("cell", True).over(upto).alias("cell"),
        F.last("shard", True).over(upto).alias("shard"),
        F.last(F.when(F.col("cell").isNotNull(), F.struct("first", "keep", "over")), True).over(upto).alias("c"),
    ).withColumn("stop", F.coalesce("stop", F.col("c.first") + F.col("c.over")))
    moved = cuts.where("stop > start").select(
        "cell", (F.col("start") - F.col("c.first") + F.col("c.keep")).alias("lo"), (F.col("stop") - F.col("c.first") + F.col("c.keep")).alias("hi"), "shard"
    )
    stay = own.where("keep > 0").select("cell", F.lit(0).cast("long").alias("lo"), F.col("keep").alias("hi"), "shard")
    rows = stay.unionByName(moved)
    lined = W.partitionBy("shard").orderBy(F.col("lo") > 0, "cell", "lo").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("base", F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(lined), F.lit(0)))


def shard_ring(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, vnodes: int = 64, cells: int = 1 << 14, overhead: int = 8, seed: int = 7
) -> DataFrame:
    """docs with size, text_crc32, shard and slot.  See the module for the method and the edge cases.

    Written in one part and broadcast: tables of at most ``cells + 2 * shards * vnodes`` narrow rows, which are parameters.
    """
    spark = docs.sparkSession
    new = ("size", "text_crc32", "shard", "slot")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in new])
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    placed = docs.select(
        row.alias("row"),
        (F.octet_length(body) + overhead).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.when(F.col(f"`{key}`").isNotNull(), F.xxhash64(F.lit(seed), F.lit("key"), F.col(f"`{key}`"))).otherwise(F.xxhash64(F.lit(seed), F.lit("text"), body)).alias("h"),
        F.col(f"`{key}`").alias("key"),
    ).withColumn("cell", F.pmod(F.shiftright("h", 20), F.lit(cells)).cast("int"))
    points = ring_points(spark, shards, vnodes, cells, seed)
    # Added up by all tasks first: a row for each cell is left for the single part.
    filled = materialize(placed.groupBy("cell").agg(F.count("*").alias("n")), "ring-cells")
    counts = cell_owners(spark, points, cells).join(F.broadcast(filled), "cell", "left").select("cell", "shard", F.coalesce("n", F.lit(0)).alias("n"))
    parts = materialize(segments(materialize(counts.coalesce(1), "ring-counts"), points, shards).coalesce(1), "ring-segments")
    ranked = placed.withColumn("rank", F.row_number().over(W.partitionBy("cell").orderBy("h", "key", "size", "text_crc32")) - 1)
    joined = ranked.join(F.broadcast(parts), (ranked.cell == parts.cell) & (ranked["rank"] >= parts.lo) & (ranked["rank"] < parts.hi))
    return joined.select("row.*", "size", "text_crc32", parts.shard.alias("shard"), (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"))
