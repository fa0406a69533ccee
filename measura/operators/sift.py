"""Pattern search inside the rows: a text leaves its row only where a rare run of three code points stands.

A run of three code points is a whole number (21 bits each), so a text's runs are one array, made and searched without a
loop over its characters.  The runs that are sought are told to the tasks as a bit array of bounded size, whatever their
number; what it lets through by chance is dropped by the join on the run itself.

Edge cases: null texts have no places; places are counted in code points, from 0; repeated rows are separate rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from measura.session import drop_materialized, materialize

RUN, POINT_BITS = 3, 21
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27  # of the bit array: 16 MB at most
PER_RUN = 64
MIX, COUPLE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
PIECE = 1_000_000  # code points of a batch that are arrays at once
ROWS = 64  # rows whose texts are Python objects at once


def runs_of(text: str) -> np.ndarray:
    """The run that begins at every place of a text but its last two."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    n = max(len(points) - RUN + 1, 0)
    out = np.zeros(n, np.int64)
    for k in range(RUN):
        out = out << POINT_BITS | points[k : k + n]
    return out


def run_code(run: Column) -> Column:
    """The number of a column of runs; null if it isn't one run long."""
    points = F.transform(F.split(run, ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long"))
    code = F.aggregate(points, F.lit(0).cast("long"), lambda s, p: F.shiftleft(s, POINT_BITS).bitwiseOR(p))
    return F.when(F.char_length(run) == RUN, code)


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """The texts of a column, ROWS of them as Python objects at once."""
    for a in range(0, len(column), ROWS):
        yield from column.slice(a, ROWS).to_pylist()


def coupled(runs: np.ndarray, later: np.ndarray) -> np.ndarray:
    """One number for two runs."""
    return (runs.astype(np.uint64) ^ later.astype(np.uint64) * COUPLE).view(np.int64)


def slots(runs: np.ndarray, size: int) -> np.ndarray:
    return (runs.astype(np.uint64) * MIX >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


def run_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(run, n): how often every run occurs; added up for each batch before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for at, body in enumerate(chain(texts_of(batch[text]), [None])):
                if held and (at == len(batch) or size > PIECE):
                    runs, n = np.unique(np.concatenate(held), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(runs), pa.array(n, pa.int64())], names=["run", "n"])
                    held, size = [], 0
                if body:
                    held.append(runs_of(body))
                    size += len(body)

    return docs.select(text).where(F.col(text).isNotNull()).mapInArrow(count, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))


def sought(runs: DataFrame) -> np.ndarray:
    """The bit array of (run), or of (run, later) coupled; the runs pass the driver one at a time."""
    count = runs.count()
    size = 1 << (min(MOST_BITS, max(LEAST_BITS, PER_RUN * count)) - 1).bit_length()
    bits = np.zeros(size, bool)
    for r in runs.toLocalIterator():
        code = np.array([r["run"]], np.int64)
        bits[slots(coupled(code, np.array([r["later"]], np.int64)) if "later" in runs.columns else code, size)] = True
    return np.packbits(bits)


def finding(shared: Any, key: str, text: str, back: int, ahead: int, gap: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            for doc, body in zip(batch[key], texts_of(batch[text]), strict=True):
                if not body:
                    continue
                runs = runs_of(body)
                codes = coupled(runs[: max(len(runs) - gap, 0)], runs[gap:]) if gap else runs
                at = np.flatnonzero(bits[slots(codes, len(bits))])
                if len(at):
                    begin = np.maximum(at - back, 0)
                    near = [body[b : p + ahead] for b, p in zip(begin.tolist(), at.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(at), batch[key].type), pa.array(np.full(len(at), len(body))), pa.array(at), pa.array(runs[at]), pa.array(begin), pa.array(near, pa.string())], names=["doc", "length", "pos", "run", "begin", "near"])

    return run


def places(docs: DataFrame, anchors: DataFrame, width: int, key: str = "doc_id", text: str = "text", gap: int = 0) -> DataFrame:
    """(anchors' columns, doc, length, spot, win) of every place where an anchor's run stands at its offset: the needle would
    begin at ``spot``, and ``win`` holds the ``width`` code points there, fewer at the end.

    anchors: (run, off, ...), off the run's place in its needle, below ``width``.  With gap there is a second run, ``later``,
    in the anchors, and places are left out, if not all of them, whose run isn't followed by it at that distance: whoever asks
    for both compares them in ``win``.
    """
    spark = docs.sparkSession
    asked = ["run", "later"] if gap else ["run"]
    bits = spark.sparkContext.broadcast(sought(anchors.select(*asked).dropna().distinct()))
    schema = f"doc {docs.schema[key].dataType.simpleString()}, length long, pos long, run long, begin long, near string"
    found = docs.select(key, text).mapInArrow(finding(bits, key, text, width, width, gap), schema)
    met = found.join(anchors, "run").withColumn("spot", F.col("pos") - F.col("off")).where("spot >= 0")
    win = F.expr(f"substring(near, CAST(spot - begin + 1 AS INT), {width})")
    return met.select(*(c for c in anchors.columns if c not in ("run", "later")), "doc", "length", "spot", win.alias("win"))


def rarest(anchors: DataFrame, counts: DataFrame, needle: str, slot: str) -> DataFrame:
    """anchors (needle, slot, run, ...) with n, the run's count, and place, from 1, by count and then slot."""
    known = anchors.join(counts, "run", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return known.withColumn("place", F.row_number().over(W.partitionBy(needle).orderBy("n", slot)).cast("long"))


def descend(found: DataFrame, needle: str, pattern: str, width: int, levels: int, stride: int) -> tuple[DataFrame, list[DataFrame]]:
    """Greedy descent over what places() found: at each level, of each needle's symbols not yet asked for, the one that the fewest
    sampled survivors hold at its place (ties: the first) is the next probe, and those without it are dropped.

    Returns (survivors, [(needle, level, off, standing) of each level]).  Survivors are sampled by their spot, one in
    ``stride``; all are probed.  A needle whose sample is empty is asked for its first symbol.  Survivors are compared in full
    by whoever counts them: a descent only narrows, so it may end at any level.
    """
    alive, plan, asked = materialize(found.select(*dict.fromkeys([needle, pattern, "doc", "spot", "win"])), "descent"), [], None
    offs = F.sequence(F.lit(0), F.lit(width - 1))
    at = lambda text, off: F.expr(f"substring({text}, CAST({off} + 1 AS INT), 1)")
    for level in range(1, levels + 1):
        sample = alive.where(F.pmod("spot", F.lit(stride)) == 0).withColumn("o", F.explode(offs))
        held = sample.groupBy(needle, F.col("o").alias("off")).agg(F.sum((at("win", "o") == at(pattern, "o")).cast("long")).alias("standing"))
        every = alive.select(needle).distinct().withColumn("off", F.explode(offs)).join(held, [needle, "off"], "left").withColumn("standing", F.coalesce("standing", F.lit(0)))
        if asked is not None:
            every = every.join(asked, [needle, "off"], "left_anti")
        best = every.groupBy(needle).agg(F.min(F.struct("standing", "off")).alias("m")).select(needle, F.col("m.off").alias("off"))
        best = materialize(best, "descent-best")
        asked = best if asked is None else asked.unionByName(best)
        next_ = materialize(alive.join(best, needle).where(at("win", "off") == at(pattern, "off")).drop("off"), "descent")
        standing = next_.groupBy(needle).agg(F.count("*").alias("standing"))
        plan.append(best.join(standing, needle, "left").select(needle, F.lit(level).cast("long").alias("level"), F.col("off").cast("long").alias("off"), F.coalesce("standing", F.lit(0)).alias("standing")))
        if level < levels:
            # The counts of a level are small; they are written before what they count is dropped.
            plan[-1] = materialize(plan[-1], "descent-plan")
            drop_materialized(alive.sparkSession, alive)
        alive = next_
    return alive, plan
