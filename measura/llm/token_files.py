"""Token-id files: whole documents encoded, laid end to end in ascending key order and stored as Simple-8b records.

Documents are dealt by ranges of the key, sorted, encoded and written; each file row is a record of whole documents:
the part, the place of its first id in the part, the documents' keys and lengths, and the Simple-8b payload.  Spark's own Parquet writer
carries the records, so they can be in any store that Spark reaches.  A document's first position in the whole
sequence is the sum of the parts before its own plus its place in the part.

Ids are the library's: pieces that the pre-tokenizer separates are encoded once each by the library and looked up after
that, in a table of bounded size, by a hash and then code point by code point; texts with special strings, and any in which equal
hashes turn out to be different pieces, are given to the library whole.

Edge cases: null and empty texts hold the end id alone; null keys come first; equal keys are ordered by text; repeated
rows are kept; an empty table gives files without records.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.llm import simple8b
from measura.llm.pretoken import KEY, added, pieces
from measura.llm.textops import HashTable, differ, parts, span_hashes, unequal
from measura.session import shared_dir

MEMO = 1_000_000
GROUP = 64  # pieces given to the library in one string
RECORD = "part int, first bigint, keys array<bigint>, lengths array<int>, payload binary"


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"
        from tokenizers import Tokenizer

        self.library, self.special = Tokenizer.from_file(path), added(path)
        self.bar = self.library.token_to_id(self.special[0]) if self.special else None
        self.known = HashTable(MEMO)
        self.clear()

    def clear(self) -> None:
        self.known.clear()
        self.lengths, self.offsets, self.flat, self.slots, self.used = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, np.int32), 0, 0
        # The pieces' own code points, one after the other, and where each begins and ends.
        self.points, self.bounds = np.zeros(4096, np.uint32), np.zeros(1025, np.int64)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) from the library."""
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.array([len(x) for x in ids], np.int64)

    def apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """whole() of many short texts without special strings: a special string, which the library always takes as
        a token of its own, parts them, so that it is called less often."""
        if self.bar is None:
            return self.whole(texts)
        bar = self.special[0]
        ids, _ = self.whole([bar.join([*texts[i : i + GROUP], ""]) for i in range(0, len(texts), GROUP)])
        bars = np.flatnonzero(ids == self.bar)
        return ids[ids != self.bar], np.diff(np.append(-1, bars)) - 1

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        new, size = self.apart(texts)
        start, n = self.slots, len(size)
        if start + n > len(self.lengths):
            self.lengths, self.offsets = (np.resize(x, 2 * (start + n)) for x in (self.lengths, self.offsets))
        if self.used + len(new) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(new)))
        self.flat[self.used : self.used + len(new)] = new
        self.lengths[start : start + n] = size
        self.offsets[start : start + n] = self.used + np.cumsum(size) - size
        self.used, self.slots = self.used + len(new), start + n
        self.known.put(hashes, np.arange(start, start + n))
        spelled, begin = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), int(self.bounds[start])
        if begin + len(spelled) > len(self.points):
            self.points = np.resize(self.points, 2 * (begin + len(spelled)))
        if start + n + 1 > len(self.bounds):
            self.bounds = np.resize(self.bounds, 2 * (start + n) + 1)
        self.points[begin : begin + len(spelled)] = spelled
        self.bounds[start + 1 : start + n + 1] = begin + np.cumsum([len(t) for t in texts])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other, their lengths)."""
        plain = [not any(s in t for s in self.special) for t in texts]
        if not all(plain):
            return self.whole(texts)
        p = pieces(texts)
        hashes, first, back = np.unique(span_hashes(p.points, p.starts, p.ends, KEY), return_index=True, return_inverse=True)
        if len(unequal(p.points, p.starts, p.ends, first[back])):
            return self.whole(texts)
        if self.known.full(len(hashes)):
            self.clear()
        slot = self.known.get(hashes)
        old, new = np.flatnonzero(slot >= 0), np.flatnonzero(slot < 0)
        begin, size = self.bounds[slot[old]], p.ends[first[old]] - p.starts[first[old]]
        if (self.bounds[slot[old] + 1] - begin != size).any() or differ(p.points, p.starts[first[old]], size, self.points, begin):
            return self.whole(texts)
        if len(new):
            slot[new] = self.slots + np.arange(len(new))
            self.learn(hashes[new], p.strings(first[new]))
        slot = slot[back]
        size = self.lengths[slot].astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.offsets[slot] - ends + size, size) + np.arange(total)]
        sums = np.append(0, ends)
        return ids, sums[p.first[1:]] - sums[p.first[:-1]]


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def writer(path: str, key: str, text: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, machine = TaskContext.get().partitionId(), 0, encoder(path)
        for batch in batches:
            keys = batch[key]
            for a, b, part_of in parts(batch[text]):
                ids, lengths = machine.encode([t or "" for t in part_of.to_pylist()])
                ids = np.insert(ids, np.cumsum(lengths), end_id)
                row = {"part": part, "first": first, "keys": keys.slice(a, b - a).to_pylist(), "lengths": (lengths + 1).tolist(), "payload": simple8b.encode(ids)}
                first += len(ids)
                yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("first", pa.int64()), ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("payload", pa.binary())]))

    return run


def reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = simple8b.decode(row["payload"]).astype("<u4")
            ends = np.cumsum(row["lengths"])
            starts = ends - row["lengths"]
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["keys"], pa.int64()), pa.array(starts + row["first"] + row["base"], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(crcs, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"]
            )


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, key: str = "doc_id", text: str = "text") -> str:
    """Writes the records and returns their folder.  The key is a whole number."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    body = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    body.repartitionByRange("key").sortWithinPartitions("key", "text").mapInArrow(writer(tokenizer, "key", "text", end_id), RECORD).write.parquet(folder)
    return folder


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files alone."""
    records = spark.read.schema(RECORD).parquet(folder)
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)
    totals = records.groupBy("part").agg(F.sum(size).alias("n")).collect()  # one row for each written part
    base, bases = 0, []
    for r in sorted(totals, key=lambda r: r["part"]):
        bases.append((r["part"], base))
        base += r["n"]
    parts = spark.createDataFrame(bases, "part int, base long")
    placed = records.join(F.broadcast(parts), "part").select("keys", "lengths", "payload", "first", "base")
    return placed.mapInArrow(reader, "key long, start long, n_tokens long, ids_crc32 long")
