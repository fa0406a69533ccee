"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The strings sought are windows of ``window`` consecutive words of the benchmark items (an item of fewer words is one
window).  Windows of one length share a pair of tables: a shift table over blocks of two words, which says how far the
search may jump, and buckets by the block that ends a window, whose windows are compared word by word with the text.
Texts are read whole.

Words are numbers in the tables: the windows of one length are places in one array of word numbers, sorted by the block
that ends them and then by the block that begins them, so that of a bucket only windows with the text's own first block
are compared.  Beside that there is one entry for each distinct block.

The benchmark is put into tables of at most ``block_bytes`` of item text, which the workers compile from the texts they are
sent.  With several tables, each searches all texts and writes the documents it hits, and the results are merged by row.

Edge cases: null and empty texts have no words and no hits; null item ids and items without words take no part;
repeated items count once by id; repeated documents are separate rows; an empty benchmark hits nothing.  Input columns
named like an output column are replaced by it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measura.llm.textops import encoded
from measura.session import materialize

#: Lower-cases A-Z; keeps digits, letters and every byte of a non-ASCII character; all else parts words.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BLOCK = 2

OUT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


class Patterns:
    """Windows of one length (starts: their places in ``codes``, owners: their items) with shift table and buckets."""

    def __init__(self, length: int, codes: np.ndarray, starts: np.ndarray, owners: np.ndarray) -> None:
        self.length, self.block = length, min(BLOCK, length)
        self.jump = length - self.block + 1
        ends = self.blocks(codes, starts + length - self.block)
        order = np.lexsort((owners, self.blocks(codes, starts), ends))
        self.codes, self.starts, self.owners = codes, starts[order], owners[order]
        self.firsts = self.blocks(codes, self.starts)
        keys, at = np.unique(ends[order], return_index=True)
        self.bounds = np.append(at, len(starts)).tolist()
        # Shift of every block: below zero, the bucket of a block that ends a window.
        self.shift: dict[int, int] = {}
        for back in range(self.jump - 1, 0, -1):
            self.shift.update(dict.fromkeys(np.unique(self.blocks(codes, starts + length - self.block - back)).tolist(), back))
        self.shift.update(zip(keys.tolist(), range(-1, -1 - len(keys), -1), strict=True))

    def blocks(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        first = codes[at].astype(np.int64)
        return first << 32 | codes[at + 1] if self.block == 2 else first

    def search(self, text: list[int | None]) -> Iterator[tuple[int, set[int]]]:
        """(start, items) of every occurrence."""
        m, two, jump, shift = self.length, self.block == 2, self.jump, self.shift
        at, last = m - 1, len(text)
        while at < last:
            b = text[at]
            if b is None:
                at += m
                continue
            if two:
                a = text[at - 1]
                step = jump if a is None else shift.get(a << 32 | b, jump)
            else:
                step = shift.get(b, jump)
            if step > 0:
                at += step
                continue
            items = self.compare(-1 - step, text[at - m + 1 : at + 1])
            if items:
                yield at - m + 1, items
            at += 1

    def compare(self, bucket: int, found: list[int | None]) -> set[int]:
        if None in found:
            return set()
        lo, hi = self.bounds[bucket], self.bounds[bucket + 1]
        first = found[0] << 32 | found[1] if self.block == 2 else found[0]
        lo, hi = (lo + int(np.searchsorted(self.firsts[lo:hi], first, side)) for side in ("left", "right"))
        return {int(self.owners[k]) for k in range(lo, hi) if self.codes[self.starts[k] : self.starts[k] + self.length].tolist() == found}


class Tables:
    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        by_length: dict[int, list[tuple[int, list[int]]]] = {}
        for item, text in items:
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            if codes:
                by_length.setdefault(min(window, len(codes)), []).append((number[item], codes))
        self.patterns = []
        for n, of in sorted(by_length.items()):
            sizes = np.array([len(c) for _, c in of])
            codes = np.fromiter(chain.from_iterable(c for _, c in of), np.int32, int(sizes.sum()))
            counts = sizes - n + 1
            first = np.repeat(np.cumsum(sizes) - sizes - np.cumsum(counts) + counts, counts)
            self.patterns.append(Patterns(n, codes, first + np.arange(len(first)), np.repeat(np.array([i for i, _ in of], np.int32), counts)))


def compile_items(items: list[tuple[str, bytes]], window: int) -> Tables:
    return Tables(items, window)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(tables: Tables, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
    ws = words(text)
    codes = list(map(tables.vocabulary.get, ws))
    ranges, items = [], set()
    for t in tables.patterns:
        for start, of in t.search(codes):
            ranges.append((start, start + t.length))
            items |= of
    return len(ws), merged(ranges), {tables.names[i] for i in items}


#: The tables that this worker compiled last, and of which broadcast.
LAST: dict[str, Tables] = {}


def tables_of(shared: Any, number: str, window: int) -> Tables:
    if number not in LAST:
        LAST.clear()
        LAST[number] = compile_items(shared.value, window)
    return LAST[number]


HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def scanner(shared: Any, number: str, window: int, text: str, keep: list[str], only_hits: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = tables_of(shared, number, window)
        for batch in batches:
            n, hits, items = [], [], []
            for body in encoded(batch[text]):
                count, ranges, found = scan(tables, body)
                n.append(count)
                hits.append([{"start": a, "end": b} for a, b in ranges])
                items.append(sorted(found))
            rows = pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(n, pa.int64()), pa.array(hits, HITS), pa.array(items, pa.list_(pa.string()))], names=[*keep, "n_words", "hits", "items"])
            yield rows.filter(pa.array([bool(x) for x in items], pa.bool_())) if only_hits else rows

    return run


def merger(keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merges the ranges and items that further tables found into those of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, items = [], []
            for own, more, a, b in zip(*(batch[c].to_pylist() for c in ("hits", "more_hits", "items", "more_items")), strict=True):
                hits.append([{"start": x, "end": y} for x, y in merged([(r["start"], r["end"]) for r in own + [r for of in more or [] for r in of]])])
                items.append(sorted({*a, *(i for of in b or [] for i in of)}))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), batch["n_words"], pa.array(hits, HITS), pa.array(items, pa.list_(pa.string()))], names=[*keep, "n_words", "hits", "items"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """docs with n_words, hits (merged word ranges inside occurring windows) and items (ids with occurring windows,
    as strings, sorted)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.encode(F.col(f"`{item_text}`"), "UTF-8").alias("body")).where("item IS NOT NULL AND body IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    keep = [c for c in docs.columns if c not in OUT.names]
    docs = docs.select(*(F.col(f"`{c}`") for c in keep))
    schema = T.StructType(docs.schema.fields + OUT.fields)

    def searched(df: DataFrame, k: int, columns: list[str], only_hits: bool) -> DataFrame:
        part = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == k) if blocks > 1 else items
        shared = spark.sparkContext.broadcast([(r["item"], bytes(r["body"])) for r in part.collect()])
        fields = [f for f in df.schema.fields if f.name in columns]
        return df.mapInArrow(scanner(shared, uuid.uuid4().hex, window, text, columns, only_hits), T.StructType(fields + OUT.fields))

    if blocks == 1:
        return searched(docs, 0, keep, False)
    row = "decontaminate_row"
    stored = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
    more = [materialize(searched(stored.select(F.col(f"`{text}`"), row), k, [row], True), "decontaminate-hits") for k in range(1, blocks)]
    found = reduce(DataFrame.unionByName, more).groupBy(row).agg(F.collect_list("hits").alias("more_hits"), F.collect_list("items").alias("more_items"))
    first = searched(stored, 0, [*keep, row], False)
    return first.join(found, row, "left").drop(row).mapInArrow(merger(keep), schema)
