"""Token counts by a compiled finite-state tokenizer.

Two machines work in turn.  The pre-tokenizer (see pretoken) marks the pieces of all texts by composing the state maps
of chunks.  The merge machine then counts the tokens of each distinct piece: its state after a prefix is the last
token of the prefix's encoding, and a transition from token p to token t is allowed if and only if the two stay apart
when encoded side by side.  The encoding of a prefix has exactly one such last token, so the machine is deterministic,
and each transition carries the tokens emitted so far.  Transitions are compiled when first met.  Many pieces are
advanced at once, one column of bytes at a time; their counts are kept, in a table of bounded size.  Hashes narrow the
search for equal pieces and for tokens; what they find is compared byte by byte.

Edge cases: null and empty texts have no bytes and no tokens; a special string inside a text is one token, as the
library counts it by default; repeated rows are counted alike.  Input columns named like an output column are
replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measura.llm.pretoken import KEY, Pieces, added, pieces, spec
from measura.llm.textops import parts, span_hashes

MEMO = 400_000
WIDE = 24  # longer pieces are taken one by one
BEGIN = -2


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte: bytes that print stand for themselves, the others for 256, 257, ..."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeMachine:
    def __init__(self, path: str) -> None:
        model, alphabet = spec(path)["model"], byte_alphabet()
        special = set(added(path))
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.token = {as_bytes(s): i for s, i in model["vocab"].items() if s not in special}
        self.spelling = {i: b for b, i in self.token.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(as_bytes(a), as_bytes(b)): r for r, (a, b) in enumerate(pairs)}
        self.allowed: dict[int, bool] = {}
        self.longest = max(map(len, self.token))
        lengths = np.array([len(b) for b in self.token])
        joined, ids = np.frombuffer(b"".join(self.token), np.uint8), np.array(list(self.token.values()))
        ends = np.cumsum(lengths)
        keys = span_hashes(joined, ends - lengths, ends, KEY)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        self.bytes, self.starts, self.sizes = joined, (ends - lengths)[order], lengths[order]

    def merge(self, text: bytes) -> list[bytes]:
        """The encoding by the merge list itself: the first of the lowest-ranked pairs is joined until none is left."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays(self, key: int) -> bool:
        """Whether the token pair of a key (from * 2^20 + to; from BEGIN as 2^20 - 1) is its own encoding."""
        known = self.allowed.get(key)
        if known is None:
            left, right = key >> 20, self.spelling[key & 0xFFFFF]
            parts = [right] if left == 0xFFFFF else [self.spelling[left], right]
            known = self.allowed[key] = self.merge(b"".join(parts)) == parts
        return known

    def count_one(self, text: bytes) -> int:
        last, count = [BEGIN], [0]
        for end in range(1, len(text) + 1):
            for n in range(min(end, self.longest), 0, -1):
                t = self.token.get(text[end - n : end])
                if t is not None and self.stays((last[end - n] & 0xFFFFF if last[end - n] >= 0 else 0xFFFFF) << 20 | t):
                    last.append(t)
                    count.append(count[end - n] + 1)
                    break
        return count[-1]

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of every piece."""
        out = np.zeros(len(texts), np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        for i in np.flatnonzero(lengths > WIDE):
            out[i] = self.count_one(texts[i])
        short = np.flatnonzero((lengths > 0) & (lengths <= WIDE))
        short = short[np.argsort(-lengths[short], kind="stable")]  # so that those still running come first
        if not len(short):
            return out
        size = lengths[short]
        joined = np.frombuffer(b"".join(texts[i] for i in short), np.uint8)
        begin = np.cumsum(size) - size
        width = int(size[0])
        last, count = np.full((len(short), width + 1), -1, np.int64), np.zeros((len(short), width + 1), np.int64)
        last[:, 0] = 0xFFFFF
        for end in range(1, width + 1):
            open_ = np.arange(np.searchsorted(-size, -end, side="right"))
            for n in range(min(end, self.longest), 0, -1):
                if not len(open_):
                    break
                at = begin[open_] + end
                keys = span_hashes(joined, at - n, at, KEY) if len(open_) * 8 > len(joined) else self.few(joined, at - n, n)
                hit, place = self.tokens_at(joined, at - n, n, keys)
                rows, to = open_[hit], self.ids[place]
                pair = last[rows, end - n] << 20 | to
                distinct, back = np.unique(pair, return_inverse=True)
                fine = np.array([self.stays(int(k)) for k in distinct], bool)[back] if len(distinct) else np.zeros(0, bool)
                rows, to = rows[fine], to[fine]
                last[rows, end] = to
                count[rows, end] = count[rows, end - n] + 1
                open_ = open_[last[open_, end] < 0]
        out[short] = count[np.arange(len(short)), size]
        return out

    def tokens_at(self, joined: np.ndarray, starts: np.ndarray, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which spans of n bytes are tokens, the places of these): those of an equal hash whose bytes are equal."""
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero((self.keys[place] == keys) & (self.sizes[place] == n))
        run = np.arange(n)
        same = (joined[starts[hit][:, None] + run] == self.bytes[self.starts[place[hit]][:, None] + run]).all(1)
        return hit[same], place[hit[same]]

    @staticmethod
    def few(joined: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """span_hashes of a few spans of one length."""
        rows = joined[starts[:, None] + np.arange(n)]
        return span_hashes(rows.ravel(), np.arange(len(starts)) * n, np.arange(1, len(starts) + 1) * n, KEY)


@cache
def merge_machine(path: str) -> MergeMachine:
    return MergeMachine(path)


class Counter:
    def __init__(self, path: str) -> None:
        self.machine, self.special = merge_machine(path), added(path)
        self.known: dict[str, int] = {}

    def of_pieces(self, p: Pieces) -> np.ndarray:
        strings, back = p.distinct()
        if self.known and len(self.known) + len(strings) > MEMO:
            self.known.clear()
        counts = np.fromiter(map(self.known.get, strings, repeat(-1)), np.int64, len(strings))
        new = np.flatnonzero(counts < 0)
        if len(new):
            fresh = [strings[i] for i in new]
            counts[new] = self.machine.count([s.encode() for s in fresh])
            self.known.update(zip(fresh, counts[new].tolist(), strict=True))
        return counts[back]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of every text; parts between special strings are texts of their own."""
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            rest = [text]
            for s in self.special:
                if s in text:
                    rest = [x for r in rest for x in r.split(s)]
            extra[i] = len(rest) - 1
            parts += rest
            owner += [i] * len(rest)
        p = pieces(parts)
        sums = np.concatenate([[0], np.cumsum(self.of_pieces(p))])
        return extra + np.bincount(owner, sums[p.first[1:]] - sums[p.first[:-1]], len(texts)).astype(np.int64)


@cache
def counter(path: str) -> Counter:
    """One for each worker process, so that later tasks find what earlier ones compiled."""
    return Counter(path)


def counting(path: str, text: str, keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(path)
        for batch in batches:
            counts = [machine.count([t or "" for t in part.to_pylist()]) for _, _, part in parts(batch[text])]
            counts = pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), counts], names=[*keep, "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit.  ``path`` is a tokenizer file that every executor has."""
    keep = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    docs = docs.select(*(F.col(f"`{c}`") for c in keep))
    out = docs.mapInArrow(counting(path, text, keep), T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType())]))
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long")
    return out.select(*(F.col(f"`{c}`") for c in keep), size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
