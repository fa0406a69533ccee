"""Event-time operators on streams: windows, sessions, deduplication, joins and a stateful ledger.

Each takes and returns a streaming (or batch) DataFrame; replay() runs one over a stored table until it has been read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from measura.session import shared_dir

LATE = "1 hour"


def timed(events: DataFrame) -> DataFrame:
    """Events with ts as a time stamp that watermarks take."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, length: str = "6 hours") -> DataFrame:
    counted = events.withWatermark("ts", LATE).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("hundredths"))
    return counted.select(F.unix_seconds("window.start").alias("start_s"), "event_type", "n", "hundredths")


def sliding(events: DataFrame, length: str = "12 hours", every: str = "6 hours") -> DataFrame:
    counted = events.withWatermark("ts", LATE).groupBy(F.window("ts", length, every)).agg(F.count("*").alias("n"))
    return counted.select(F.unix_seconds("window.start").alias("start_s"), "n")


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    counted = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.unix_seconds("session_window.start").alias("start_s"), F.unix_seconds("session_window.end").alias("end_s"), "n")


def first_of_each(events: DataFrame) -> DataFrame:
    """One event of each id."""
    return events.withWatermark("ts", LATE).dropDuplicates(["event_id"]).select("event_id", "user_id", "event_type")


def ledger(events: DataFrame, capacity: int = 500) -> DataFrame:
    """Jobs of each user: an event's value is its size; a job is admitted while the user's running jobs fit the
    capacity, and every ``purchase`` releases all of them.  (user_id, admitted, refused, peak) after each batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, admitted, refused, peak = state.get if state.exists else (0, 0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind, size in zip(rows["event_type"], rows["size"], strict=True):
            if kind == "purchase":
                used = 0
            elif used + size <= capacity:
                used, admitted = used + int(size), admitted + 1
                peak = max(peak, used)
            else:
                refused += 1
        state.update((used, admitted, refused, peak))
        yield pd.DataFrame({"user_id": [key[0]], "admitted": [admitted], "refused": [refused], "peak": [peak]})

    sized = events.select("user_id", "event_id", "ts", "event_type", F.abs(F.round("value")).cast("long").alias("size"))
    return sized.groupBy("user_id").applyInPandasWithState(step, "user_id long, admitted long, refused long, peak long", "used long, admitted long, refused long, peak long", "update", GroupStateTimeout.NoTimeout)


def led_to(events: DataFrame, within: str = "2 hours") -> DataFrame:
    """Purchases with the clicks of the same user at most ``within`` before them: two streams, each with its watermark, whose
    state is kept for as long as a partner may still come."""
    side = lambda kind, name: events.where(F.col("event_type") == kind).select(F.col("user_id").alias(f"{name}_user"), F.col("event_id").alias(name), F.col("ts").alias(f"{name}_ts")).withWatermark(f"{name}_ts", LATE)
    near = F.expr(f"click_user = purchase_user AND click_ts <= purchase_ts AND click_ts >= purchase_ts - INTERVAL {within}")
    return side("purchase", "purchase").join(side("click", "click"), near).select(F.col("purchase_user").alias("user_id"), "purchase", "click")


class Idle(StatefulProcessor):
    """Reports each rest of a user longer than ``rest`` seconds, by its beginning: at the next event, or by a timer that goes off
    once the watermark has passed the rest's end."""

    def __init__(self, rest: int) -> None:
        self.rest = rest * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")

    def out(self, user: int, found: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"user_id": pd.Series([user] * len(found), dtype="int64"), "idle_from_s": pd.Series([x // 1_000_000 for x in found], dtype="int64")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, the interface's names
        times = sorted(int(t) for frame in rows for t in frame["us"])
        last = self.last.get()[0] if self.last.exists() else None
        found = [a for a, b in zip([last, *times] if last is not None else times, times if last is not None else times[1:], strict=False) if b - a > self.rest]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        latest = max(times[-1], last if last is not None else times[-1])
        self.last.update((latest,))
        self.handle.registerTimer((latest + self.rest) // 1000 + 1)
        yield self.out(key[0], found)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = [self.last.get()[0]] if self.last.exists() else []
        self.last.clear()
        yield self.out(key[0], found)

    def close(self) -> None:
        pass


def rests(events: DataFrame, rest: int = 6 * 3600) -> DataFrame:
    """(user_id, idle_from_s): rests of more than ``rest`` seconds, the last one of each user among them."""
    timed_rows = events.withWatermark("ts", LATE).select("user_id", "ts", F.unix_micros("ts").alias("us"))
    return timed_rows.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Idle(rest), outputStructType="user_id long, idle_from_s long", outputMode="Append", timeMode="EventTime")


def late_counted(spark: SparkSession, path: str, days: int = 10, every: int = 97) -> DataFrame:
    """(kept, late): a table read as a stream, and after it copies of every ``every``-th event ``days`` back in time, under ids of their
    own: how many distinct events were kept, and how many rows came behind the watermark."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    table = spark.read.parquet(path)
    table.write.parquet(f"{folder}/in")
    # The time is part of the key, so that state older than the watermark goes and rows behind it are told.
    out = timed(spark.readStream.schema(table.schema).parquet(f"{folder}/in")).withWatermark("ts", LATE).dropDuplicates(["event_id", "ts"]).select("event_id", "ts")
    dropped = 0

    def run() -> int:
        query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])

    dropped += run()
    # Rows are late by the watermark of the batch before theirs: the latest row, again, makes a batch between.
    table.orderBy(F.desc("ts")).limit(1).write.mode("append").parquet(f"{folder}/in")
    dropped += run()
    ids = table.schema["event_id"].dataType
    behind = table.where(F.pmod("event_id", F.lit(every)) == 0).withColumn("ts", F.col("ts") - F.expr(f"INTERVAL {days} DAYS")).withColumn("event_id", (-1 - F.col("event_id")).cast(ids)).select(*table.columns)
    # Behind the watermark of every row of the table, however early: only these are planted.
    latest = table.agg(F.max("ts").alias("m")).first()["m"]
    if latest is not None:
        behind.where(F.col("ts") < F.lit(latest) - F.expr(f"INTERVAL {LATE}")).write.mode("append").parquet(f"{folder}/in")
        dropped += run()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").agg(F.count_distinct("event_id").alias("kept")).withColumn("late", F.lit(dropped).cast("long"))


def replay(spark: SparkSession, path: str, operator: Callable[[DataFrame], DataFrame], mode: str = "append", drain: bool = True) -> DataFrame:
    """What the operator has written once the table at ``path`` has been read as a stream.

    With drain, an event far in the future follows, so that the watermark passes every real window; windows of that
    event stay open and aren't written.
    """
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    table = spark.read.parquet(path)
    table.write.parquet(f"{folder}/in")
    source = spark.readStream.schema(table.schema).parquet(f"{folder}/in")
    out = operator(timed(source))
    options = {"checkpointLocation": f"{folder}/state"}

    def run() -> None:
        if mode == "append":
            query = out.writeStream.format("parquet").option("path", f"{folder}/out").options(**options).outputMode("append").trigger(availableNow=True).start()
        else:
            query = out.writeStream.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{folder}/out")).options(**options).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    if drain:
        last = table.limit(1).withColumn("ts", F.expr("timestamp_ntz'2200-01-01 00:00:00'")).withColumn("event_id", F.lit(-1).cast(table.schema["event_id"].dataType)).select(*table.columns)
        last.write.mode("append").parquet(f"{folder}/in")
        run()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
