"""Near-duplicate groups by an exact n-gram Jaccard join with several global token orders.

A text's set holds its distinct shingles of ``words`` words (a shorter text is one shingle).  Two sets whose Jaccard
similarity reaches num/den share l tokens or more among the first n - ceil(n * num/den) + l tokens of each (n: its
size) under *any* order of all tokens.  Candidates must do so under ORDERS different orders before they are verified:

1. A set's sample are its tokens whose hash lies in a fixed share of the range, or its prefix if that is longer.  As
   all sets sample alike, the number of classes with a sampled token is exact.
2. Equal sets are one class, told by sums of token hashes.  The first order puts tokens of one class first, then
   sampled tokens from rare to frequent, then the others by hash.  Tokens of very many classes (found in a share of the
   classes, at most HOT_TOKENS of them at any size) are ordered by an estimate of their number, so that no task has to
   hold the classes of one token to count them.
3. At their first shared token under the first order, at places i and j of their prefixes, two linked sets of n and m
   tokens have 1 + min(n - i, m - j) tokens left to share at most; pairs for which that is less than a link needs, or
   whose sizes don't fit, aren't candidates by that token.
4. Tokens of up to SMALL classes list their candidate pairs.  For a token of more, the classes that stand early enough
   to be the smaller set of a link are its heads: all classes are paired with one head (the hub), and nothing more is
   done where no head is.  Pairs that share enough tokens of the prefixes under the other orders are verified on the full
   sets, and the links make components.  What candidates connect is verified in one place, to which every set is sent
   once; where that is more than BLOCK_TOKENS tokens or NEAR_PAIRS pairs, sets are joined to single pairs.
5. Tokens with heads whose classes still make several components are compared: heads with all, in blocks of about
   BLOCK classes or BLOCK_TOKENS tokens; in large groups blocks hold sets of one band of sizes, and meet their own and
   the next band only.  Blocks hold the prefixes first, and full sets of what fits another's prefixes then, once for all
   tokens where that sends fewer sets.  No more links are returned than connect what is linked.  So pairs of a large group aren't listed, nothing is capped, and no link
   between different components is lost.

Words and shingles are told by 64-bit hashes under a key drawn for each run, so no text can have been made to collide; two
tokens that don't depend on it do so with a chance of about 2^-60.  Sets are told by two sums of such hashes, 128 bits
together: where the first sums of different sets agree, the run is repeated with another key.

Edge cases: null and empty texts and texts without words have an empty set and are groups of their own; null ids are never
a group's id unless all its ids are null; repeated rows are separate rows of one class; an empty table gives an empty
result.  Input columns named like an output column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from measura.llm.textops import encoded, mix, new_key, parts, span_hashes, word_spans
from measura.operators.graph import components
from measura.session import drop_materialized, free_shuffles, materialize
from measura.sources.tables import spread

#: Lower-cases A-Z; white space parts words.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
#: Seeds of the orders besides the first.
SEEDS = np.array([0x9E6C63D0876A9A47, 0xB5026F5AA96619E9], np.uint64)
ORDERS = 1 + len(SEEDS)
TWIN = np.uint64(0xD6E8FEB86659FD93)
SMALL, BLOCK, BLOCK_TOKENS = 32, 1024, 1_000_000
DEPTH, PER_TOKEN = 3, 40  # l under the seeded orders: one more for every PER_TOKEN tokens of a set, DEPTH at most
HOT_SHARE, HOT_LEAST, HOT_TOKENS = 64, 16, 1 << 16  # hot: in HOT_LEAST classes of one in HOT_SHARE, HOT_TOKENS at most
SPREAD = 1.5  # share of the hash range sampled, as a multiple of 1 - num/den
BROADCAST_ROWS = 1_000_000
NEAR_PAIRS = 1 << 17  # candidate pairs that are verified in one place
SALTS = 256  # parts of a hot token's classes
PAIRS = 512  # pairs whose sets are Python objects at once
SLICE = 300_000  # bytes of text whose arrays are held at once
FEW = 20  # below one pair in so many, pairs of blocks are verified one by one


def token_sets(texts: list[bytes], words: int, key: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; the key decides how words and shingles are hashed."""
    data, starts, ends, first = word_spans(texts, WORD_TABLE)
    out = []
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in texts]
    hashes = span_hashes(data, starts, ends, key)
    step = mix(np.array([key], np.uint64))[0] | np.uint64(1)
    total = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for k in range(words):
        total = total * step + hashes[k : k + len(total)]
    total = mix(total + np.uint64(words))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(total[a : b - words + 1]))
        elif b > a:
            short = np.zeros(1, np.uint64)
            for k in range(a, b):
                short = short * step + hashes[k : k + 1]
            out.append(mix(short + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_shared(n: int) -> int:
    """How many prefix tokens a set of n tokens asks for; never more than it must share."""
    return min(DEPTH, 1 + n // PER_TOKEN)


def fingerprint(tokens: np.ndarray) -> int:
    return int(mix(np.array([tokens.sum(dtype=np.uint64)], np.uint64) + np.uint64(len(tokens))).view(np.int64)[0])


def second_print(tokens: np.ndarray) -> int:
    """A print of its own, by which two sets of one fingerprint() are told apart."""
    return int(mix(tokens ^ TWIN).sum(dtype=np.uint64).view(np.int64))


def prefix_size(n: int, num: int, den: int, shared: int = 1) -> int:
    return n - -(-num * n // den) + shared


def prefixes(tokens: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """The tokens' keys in the prefix under every seeded order, sorted."""
    size = prefix_size(len(tokens), num, den, least_shared(len(tokens)))
    return [np.sort(np.partition(keys, size - 1)[:size]) for keys in (mix(tokens ^ seed) for seed in SEEDS)]


def sample_limit(num: int, den: int) -> int:
    """Hashes below it are sampled: under half of the range, so that they are also the non-negative signed ones below it."""
    return int(min(SPREAD * (den - num) / den, 0.49) * (1 << 63)) * 2


def sample(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """The tokens below the limit, or as many as the prefix holds; tokens are sorted."""
    return tokens[: max(int(np.searchsorted(tokens, np.uint64(sample_limit(num, den)))), prefix_size(len(tokens), num, den))]


def read_sets(batches: Iterator[pa.RecordBatch], text: str, words: int, key: int) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    for batch in batches:
        for a, _, part in parts(batch[text], SLICE):
            yield batch, a, token_sets(encoded(part), words, key)


def sampler(text: str, words: int, key: int, num: int, den: int, keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds n_shingles, the class's print, its second print, and the sample in the first row of a class that the task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int | None] = {None}
        for batch, a, sets in read_sets(batches, text, words, key):
            prints = [fingerprint(s) if len(s) else None for s in sets]
            picked = []
            for f, s in zip(prints, sets, strict=True):
                picked.append(np.zeros(0, np.int64) if f in seen else sample(s, num, den).view(np.int64))
                seen.add(f)
            part = batch.slice(a, len(sets))
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, picked)]).astype(np.int32), np.concatenate([*picked, np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays(
                [*(part[c] for c in keep), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.int64()), pa.array([second_print(s) for s in sets], pa.int64()), lists],
                names=[*keep, "n_shingles", "print", "twin", "sample"],
            )

    return run


SETS = "print long, n int, p1 binary, p2 binary, tokens binary"


def wanted_sets(batches: Iterator[pa.RecordBatch], words: int, key: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows whose text has the class's print that they name, and their sets: the first row of a class that the task meets."""
    seen: set[int] = set()
    for batch, a, sets in read_sets(batches, "text", words, key):
        part, rows = batch.slice(a, len(sets)), []
        for i, (f, s) in enumerate(zip(part["print"].to_pylist(), sets, strict=True)):
            if f not in seen and len(s) and fingerprint(s) == f:
                seen.add(f)
                rows.append(i)
        yield part.take(pa.array(rows, pa.int64())), [sets[i] for i in rows]


def set_maker(words: int, key: int, num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in wanted_sets(batches, words, key):
            p1, p2 = zip(*(prefixes(s, num, den) for s in sets), strict=True) if sets else ((), ())
            columns = [part["print"], pa.array([len(s) for s in sets], pa.int32()), *(pa.array([s.tobytes() for s in side], pa.binary()) for side in (p1, p2, sets))]
            yield pa.RecordBatch.from_arrays(columns, names=["print", "n", "p1", "p2", "tokens"])

    return run


def near_sets(words: int, key: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in wanted_sets(batches, words, key):
            yield pa.RecordBatch.from_arrays([part["near"], part["print"], pa.array([s.tobytes() for s in sets], pa.binary())], names=["near", "print", "tokens"])

    return run


def meets(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    place = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[place] == a).sum())


def array(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def passing(fine: Callable[[dict, int], bool]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b) of the rows for which fine(columns, row) holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, PAIRS) for b in batches for a in range(0, len(b), PAIRS)):
            cols = {c: batch[c].to_pylist() for c in batch.schema.names}
            rows = [i for i in range(len(batch)) if fine(cols, i)]
            yield pa.RecordBatch.from_arrays([pa.array([cols[k][i] for i in rows], pa.int64()) for k in ("a", "b")], names=["a", "b"])

    return run


def share_prefixes(cols: dict, i: int) -> bool:
    least = least_shared(min(cols["a_n"][i], cols["b_n"][i]))
    return all(meets(array(cols[f"a_{p}"][i]), array(cols[f"b_{p}"][i])) >= least for p in ("p1", "p2"))


def similar(num: int, den: int) -> Callable[[dict, int], bool]:
    def fine(cols: dict, i: int) -> bool:
        x, y = array(cols["a_tokens"][i]), array(cols["b_tokens"][i])
        both = meets(x, y)
        return den * both >= num * (len(x) + len(y) - both)

    return fine


def find(root: dict[int, int], x: int) -> int:
    while root[x] != x:
        root[x] = x = root[root[x]]
    return x


def near_links(num: int, den: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Links among the pairs (a, b) of what candidates connect, as many as connect it."""

    def run(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        tokens = {f: array(t) for f, t in zip(sets["print"].to_pylist(), sets["tokens"].to_pylist(), strict=True)}
        orders = {f: prefixes(s, num, den) for f, s in tokens.items()}
        root, out = {f: f for f in tokens}, []
        for a, b in sorted(zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True)):
            x, y = find(root, a), find(root, b)
            if x == y:
                continue
            least = least_shared(min(len(tokens[a]), len(tokens[b])))
            if all(meets(p, q) >= least for p, q in zip(orders[a], orders[b], strict=True)):
                both = meets(tokens[a], tokens[b])
                if den * both >= num * (len(tokens[a]) + len(tokens[b]) - both):
                    root[max(x, y)] = min(x, y)
                    out.append((a, b))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, a stretch of the tokens at a time."""
    sides = []
    for sets in (left, right):
        tokens = np.concatenate([*sets, np.zeros(0, np.uint64)])
        sides.append((tokens, np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
    common = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.int64)
    for a in range(0, len(common), width):
        part = common[a : a + width]
        planes = []
        for (tokens, who), n in zip(sides, (len(left), len(right)), strict=True):
            place = np.minimum(np.searchsorted(part, tokens), len(part) - 1)
            hit = part[place] == tokens
            plane = np.zeros((n, len(part)), np.float32)
            plane[who[hit], place[hit]] = 1
            planes.append(plane)
        out += (planes[0] @ planes[1].T).astype(np.int64)
    return out


def fitting(group: pa.Table, num: int, den: int) -> tuple[list[dict], list[dict], np.ndarray]:
    """(left, right, fits): the heads of one block (lb), the members of another (rb), and which of them may be linked."""
    rows = sorted(group.to_pylist(), key=lambda r: r["print"])
    left, right = [r for r in rows if r["head"] and r["lb"] == r["i"]], [r for r in rows if r["rb"] == r["j"]]
    if not left or not right:
        return left, right, np.zeros((len(left), len(right)), bool)
    column = lambda side, c: np.array([r[c] for r in side], np.int64)
    n, m = column(left, "n")[:, None], column(right, "n")[None, :]
    # Pairs of one component are left, and those that the place of the token rules out.
    fits = column(left, "root")[:, None] != column(right, "root")
    fits &= (n <= m) & (den * n >= num * m)
    fits &= (1 + np.minimum(n - column(left, "place")[:, None], m - column(right, "place"))) * (num + den) >= num * (n + m)
    least = np.minimum(DEPTH, 1 + n // PER_TOKEN)
    for p in ("p1", "p2"):
        if fits.any():
            fits &= shared_counts([array(r[p]) for r in left], [array(r[p]) for r in right]) >= least
    return left, right, fits


def block_fits(num: int, den: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """The classes of a pair of blocks that fit another's prefixes, and a class (near) that is equal in those that fits connect."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        left, right, fits = fitting(group, num, den)
        across, label = np.flatnonzero(fits.any(1)), np.arange(len(right))
        for k in across:
            label[np.isin(label, label[fits[k]])] = label[fits[k]].min()
        near = {(left[k]["print"], right[label[fits[k]][0]]["print"]) for k in across} | {(right[k]["print"], right[label[k]]["print"]) for k in np.flatnonzero(fits.any(0))}
        token, i, j = (x.as_py() for x in key)
        columns = {"token": pa.array([token] * len(near), pa.int64()), "i": pa.array([i] * len(near), pa.string()), "j": pa.array([j] * len(near), pa.string())}
        return pa.table(columns | {"print": pa.array([a for a, _ in near], pa.int64()), "near": pa.array([b for _, b in near], pa.int64())})

    return run


def block_links(num: int, den: int) -> Callable[[pa.Table], pa.Table]:
    """Links between the heads of one block and the members of another, as many as connect them."""

    def run(group: pa.Table) -> pa.Table:
        left, right, fits = fitting(group, num, den)
        out = []
        if fits.any():
            across, down = np.flatnonzero(fits.any(1)), np.flatnonzero(fits.any(0))
            x, y = [array(left[k]["tokens"]) for k in across], [array(right[k]["tokens"]) for k in down]
            if fits.sum() * FEW < len(x) * len(y):
                both = np.zeros((len(x), len(y)), np.int64)
                for a, b in zip(*np.nonzero(fits[np.ix_(across, down)]), strict=True):
                    both[a, b] = meets(x[a], y[b])
            else:
                both = shared_counts(x, y)
            union = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y]) - both
            fits[np.ix_(across, down)] &= den * both >= num * union
            root = {r["root"]: r["root"] for r in left + right}
            for a, b in zip(*np.nonzero(fits), strict=True):
                x, y = find(root, left[a]["root"]), find(root, right[b]["root"])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((left[a]["print"], right[b]["print"]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Linked pairs.  The prefixes, a fraction of the sets, are read for all pairs, and full sets for those that pass."""
    side = lambda s, *more: sets.select(F.col("print").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in more))
    passed = pairs.join(side("a", "n", "p1", "p2"), "a").join(side("b", "n", "p1", "p2"), "b").mapInArrow(passing(share_prefixes), "a long, b long")
    passed = materialize(passed, "ngram-passed")
    links = materialize(passed.join(side("a", "tokens"), "a").join(side("b", "tokens"), "b").mapInArrow(passing(similar(num, den)), "a long, b long"), "ngram-links")
    drop_materialized(pairs.sparkSession, passed)
    return links


def hot_tokens(postings: DataFrame, total: int) -> DataFrame:
    """(token, classes) of the tokens of very many classes, by an estimate; at most HOT_TOKENS rows (total: all postings)."""
    least = max(HOT_LEAST, -(-total // HOT_TOKENS))
    some = postings.where(F.pmod("print", F.lit(HOT_SHARE)) == 0).groupBy("token").agg(F.count("*").alias("seen"))
    return materialize(some.where(F.col("seen") >= least).select("token", (F.col("seen") * HOT_SHARE).alias("classes")).coalesce(1), "ngram-hot")


def candidate(a: str, b: str, num: int, den: int) -> str:
    """SQL: whether sets with n tokens and a shared token at ``place`` may be linked by it."""
    return f"({den} * least({a}.n, {b}.n) >= {num} * greatest({a}.n, {b}.n) AND {num + den} * (1 + least({a}.n - {a}.place, {b}.n - {b}.place)) >= {num} * ({a}.n + {b}.n))"


def listed_pairs(few: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs of every token, which has at most SMALL classes."""
    members = few.groupBy("token").agg(F.collect_list(F.struct("print", "n", "place")).alias("g")).where("size(g) > 1")
    pair = "named_struct('a', least(x.print, y.print), 'b', greatest(x.print, y.print))"
    found = f"flatten(transform(g, (x, k) -> transform(filter(slice(g, k + 2, size(g)), y -> {candidate('x', 'y', num, den)}), y -> {pair})))"
    return members.select(F.explode(F.expr(found)).alias("p")).select("p.a", "p.b").distinct()


def dealt_blocks(placed: DataFrame, num: int, den: int) -> DataFrame:
    """placed (token, print, n, place, head, root) once for every pair of blocks (i, j) in which it is a head or a member."""
    banded = placed.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + 1e-9).cast("int"))
    heads, head_tokens = F.sum(F.when(F.col("head"), 1).otherwise(0)).alias("heads"), F.sum(F.when(F.col("head"), F.col("n")).otherwise(0)).alias("head_tokens")
    bands = banded.groupBy("token", "band").agg(heads, head_tokens, F.count("*").alias("members"), F.sum("n").alias("tokens"))
    blocks = lambda n, tokens: F.ceil(F.greatest(F.col(n) / BLOCK, F.col(tokens) / BLOCK_TOKENS)).cast("int")
    # At most one entry for each band of sizes: about 100 for sets of up to 40,000 tokens at a similarity of 0.9.
    by_band = F.map_from_entries(F.collect_list(F.struct("band", F.struct(blocks("heads", "head_tokens").alias("l"), blocks("members", "tokens").alias("r")))))
    bands = bands.groupBy("token").agg(by_band.alias("by_band"), *(F.sum(c).alias(c) for c in ("heads", "members", "tokens")))
    one = (F.col("members") <= BLOCK) & (F.col("tokens") <= BLOCK_TOKENS)
    whole = F.create_map(F.lit(0), F.struct(F.when(F.col("heads") > 0, 1).otherwise(0).alias("l"), F.lit(1).alias("r")))
    bands = bands.select("token", one.alias("one"), F.when(one, whole).otherwise(F.col("by_band")).alias("bands"))
    at = "coalesce(try_element_at(bands, {}).{}, 0)"
    name = "named_struct('i', concat({}, ':', {}), 'j', concat({}, ':', {}))"
    turn = lambda band, of, i, j: f"flatten(transform({band}, w -> transform(filter(sequence(0, {at.format('w', of)}), k -> k < {at.format('w', of)}), k -> {name.format(*i, *j)})))"
    as_head = turn("array(band, band + 1)", "r", ("band", "l"), ("w", "k"))
    as_member = turn("array(band - 1, band)", "l", ("w", "k"), ("band", "r"))
    out = banded.join(bands, "token").withColumn("band", F.when(F.col("one"), 0).otherwise(F.col("band")))
    out = out.withColumn("l", F.expr(f"pmod(xxhash64(print), greatest(1, {at.format('band', 'l')}))")).withColumn("r", F.expr(f"pmod(xxhash64(print), greatest(1, {at.format('band', 'r')}))"))
    out = out.withColumn("lb", F.concat_ws(":", "band", "l")).withColumn("rb", F.concat_ws(":", "band", "r"))
    turns = F.expr(f"array_distinct(concat(IF(head, {as_head}, array()), {as_member}))")
    return out.withColumn("turn", F.explode(turns)).select("token", "print", "place", "head", "root", "lb", "rb", "turn.i", "turn.j")


def fewer_blocks(dealt: DataFrame, placed: DataFrame, fit: DataFrame, num: int, den: int) -> DataFrame:
    """dealt, with the blocks of many tokens replaced by those of what fits connect, where sets are sent less often so.

    Classes that share many hot tokens are compared under every one of them otherwise.
    """
    linked = materialize(components(fit.select(F.col("print").alias("a"), F.col("near").alias("b"))), "ngram-spots")
    spots = linked.select(F.col("node").alias("print"), F.col("root").alias("spot"))
    members = placed.select("print", "n", "root").distinct().join(spots, "print")
    rows = dealt.join(spots, "print")
    size = members.groupBy("spot").agg(F.count("*").alias("members"), F.sum("n").alias("tokens")).join(rows.groupBy("spot").agg(F.count("*").alias("rows")), "spot")
    parts = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("tokens") / BLOCK_TOKENS))
    fewer = materialize(size.where(F.col("members") * F.when(parts == 1, 1).otherwise(4 * parts) <= F.col("rows")).select("spot"), "ngram-fewer")
    together = members.join(fewer, "spot", "left_semi").select(F.col("spot").alias("token"), "print", "n", F.lit(1).alias("place"), F.lit(True).alias("head"), "root")
    out = materialize(rows.join(fewer, "spot", "left_anti").drop("spot").unionByName(dealt_blocks(together, num, den)), "ngram-dealt")
    drop_materialized(placed.sparkSession, linked, fewer)
    return out


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, num: int = 90, den: int = 100, keep: list[str] | None = None, mark: str | None = None) -> DataFrame:
    """docs with n_shingles and component_id (the smallest key that links reach).

    keep: the columns of docs to return (None: all); the key is read besides.  mark: the name of one more column, which is
    equal in rows of one group and in no others, whatever their keys, and null for empty sets.
    """
    spark, docs, secret = docs.sparkSession, spread(docs), new_key()
    new = ("n_shingles", "component_id", mark)
    columns = [c for c in (docs.columns if keep is None else keep) if c not in new]
    body = F.col(f"`{text}`").alias("text")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(f"`{key}`").alias("key"), body, F.xxhash64(body).alias("text_key"))
    held = ["row", "key", "text_key"] if columns != [key] else ["key", "text_key"]
    schema = T.StructType([f for f in rows.schema.fields if f.name in held] + [T.StructField("n_shingles", T.LongType()), T.StructField("print", T.LongType()), T.StructField("twin", T.LongType()), T.StructField("sample", T.ArrayType(T.LongType()))])
    nodes = materialize(rows.select("text", *held).mapInArrow(sampler("text", words, secret, num, den, held), schema), "ngram-nodes")
    size = nodes.agg(F.coalesce(F.sum(F.size("sample")), F.lit(0)).alias("n")).first()["n"]
    ids = materialize(nodes.drop("sample", "twin"), "ngram-ids")
    found = nodes.where("print IS NOT NULL").groupBy("print")
    classes = found.agg(F.min("key").alias("least"), F.min("text_key").alias("text_key"), F.max("n_shingles").cast("int").alias("n"), F.max(F.size("sample")).alias("sampled"), (F.min("twin") < F.max("twin")).alias("mixed"))
    classes = materialize(classes, "ngram-classes")
    if not classes.where("mixed").isEmpty():  # sets of one print that differ: another key tells them apart
        drop_materialized(spark, nodes, ids, classes)
        return groups(docs, key, text, words, num, den, keep, mark)

    # Tokens of several classes; equal rows of (token, print) come from different tasks.  A hot token's mark holds the estimate
    # and a part of its classes, so that they come to many tasks.
    postings = nodes.where(F.size("sample") > 0).select("print", F.explode("sample").alias("token"))
    hot = hot_tokens(postings, size)
    marked = postings.join(F.broadcast(hot), "token", "left").select("token", "print", (F.col("classes") * SALTS + F.pmod(F.xxhash64("print"), F.lit(SALTS))).alias("mark"))
    counted = marked.repartition("token", "mark").groupBy("token", "mark", "print").agg(F.lit(0).alias("classes"))
    counted = counted.withColumn("classes", F.count("*").over(W.partitionBy("token", "mark"))).where("mark IS NOT NULL OR classes > 1")
    shared = counted.select("token", "print", F.coalesce(F.expr(f"mark div {SALTS}"), "classes").alias("classes")).join(classes.select("print", "n", "sampled"), "print")
    by_class = W.partitionBy("print")
    # Tokens of one class come first.
    own = F.col("sampled") - F.count("*").over(by_class)
    rank = F.row_number().over(by_class.orderBy((F.col("token") < 0) | (F.col("token") >= sample_limit(num, den)), "classes", "token"))
    live = shared.withColumn("place", (own + rank).cast("int")).where(f"place <= n - ({num}L * n + {den - 1}) div {den} + 1").select("token", "print", "n", "place")
    live = materialize(live, "ngram-live")
    drop_materialized(spark, nodes, hot)
    free_shuffles(spark)

    head = F.expr(f"{num + den} * (1 + n - place) >= {2 * num} * n")
    many = live.groupBy("token").agg(F.count("*").alias("members"), F.min(F.when(head, F.struct("print", "n", "place"))).alias("hub")).where(F.col("members") > SMALL)
    many = materialize(many.select("token", "hub"), "ngram-many")
    small = F.broadcast(many.select("token")) if many.count() <= BROADCAST_ROWS else many.select("token")
    grouped = materialize(live.join(many.where("hub IS NOT NULL"), "token").select("token", "print", "n", "place", head.alias("head"), "hub"), "ngram-grouped")
    star = grouped.withColumn("own", F.struct("print", "n", "place")).where(f"print <> hub.print AND {candidate('own', 'hub', num, den)}")
    star = star.select(F.least("print", "hub.print").alias("a"), F.greatest("print", "hub.print").alias("b"))
    pairs = materialize(listed_pairs(live.join(small, "token", "left_anti"), num, den).unionByName(star).distinct(), "ngram-pairs")
    drop_materialized(spark, live, many)

    def texts_of(some: DataFrame) -> DataFrame:
        """Rows with the text of one of these classes (print, text_key, and more columns)."""
        some = F.broadcast(some) if some.count() <= BROADCAST_ROWS else some
        return docs.select(body).withColumn("text_key", F.xxhash64("text")).join(some, "text_key")

    def sets_of(prints: DataFrame) -> DataFrame:
        chosen = materialize(classes.join(prints, "print", "left_semi").select("print", "text_key"), "ngram-chosen")
        texts = texts_of(chosen).withColumn("digest", F.sha2("text", 256)).dropDuplicates(["print", "text_key", "digest"])
        sets = materialize(texts.select("text", "print").mapInArrow(set_maker(words, secret, num, den), SETS), "ngram-sets")
        drop_materialized(spark, chosen)
        return sets

    # Everything that candidates connect is verified in one place, if it isn't too large for that.
    near = materialize(components(pairs), "ngram-near")
    told = materialize(pairs.join(near.select(F.col("node").alias("a"), F.col("root").alias("near")), "a"), "ngram-told")
    ends = materialize(classes.join(near.select(F.col("node").alias("print"), F.col("root").alias("near")), "print").select("print", "text_key", "n", "near"), "ngram-ends")
    figures = ends.groupBy("near").agg(F.sum("n").alias("tokens")).join(told.groupBy("near").agg(F.count("*").alias("pairs")), "near")
    large = F.broadcast(materialize(figures.where(f"tokens > {BLOCK_TOKENS} OR pairs > {NEAR_PAIRS}").select("near"), "ngram-large"))
    drop_materialized(spark, pairs, near)
    near_texts = materialize(ends.join(large, "near", "left_anti").select("print", "text_key", "near"), "ngram-chosen")
    found = texts_of(near_texts).select("near", "print", "text").mapInArrow(near_sets(words, secret), "near long, print long, tokens binary")
    links = found.groupBy("near").cogroup(told.join(large, "near", "left_anti").groupBy("near")).applyInArrow(near_links(num, den), "a long, b long")
    links = materialize(links, "ngram-links")
    if not large.isEmpty():
        sets = sets_of(ends.join(large, "near", "left_semi"))
        links = links.unionByName(verify(told.join(large, "near", "left_semi").select("a", "b"), sets, num, den))
        drop_materialized(spark, sets)
    drop_materialized(spark, told, ends, near_texts, large)
    free_shuffles(spark)
    roots = materialize(components(links), "ngram-roots")
    free_shuffles(spark)

    rooted = grouped.drop("hub").join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    rooted = materialize(rooted, "ngram-rooted")
    drop_materialized(spark, grouped)
    open_ = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token")
    open_ = materialize(rooted.join(open_, "token", "left_semi"), "ngram-open")
    drop_materialized(spark, rooted)
    more = spark.createDataFrame([], "a long, b long")
    if not open_.isEmpty():
        at = ["token", "i", "j"]
        dealt = materialize(dealt_blocks(open_, num, den), "ngram-dealt")
        sets = sets_of(open_.select("print").distinct())
        fit = dealt.join(sets.select("print", "n", "p1", "p2"), "print").groupBy(*at).applyInArrow(block_fits(num, den), "token long, i string, j string, print long, near long")
        fit = materialize(fit, "ngram-fit")
        if not fit.isEmpty():
            dealt_again = fewer_blocks(dealt.join(fit, [*at, "print"], "left_semi"), open_, fit, num, den)
            blocks = dealt_again.join(sets.join(fit, "print", "left_semi"), "print")
            more = materialize(blocks.groupBy(*at).applyInArrow(block_links(num, den), "a long, b long"), "ngram-more")
            drop_materialized(spark, dealt_again)
        drop_materialized(spark, dealt, sets, fit)
    drop_materialized(spark, open_)
    free_shuffles(spark)

    final = materialize(components(links.unionByName(more)), "ngram-final") if not more.isEmpty() else roots
    named = classes.join(final.withColumnRenamed("node", "print"), "print", "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    named = materialize(named, "ngram-named")
    drop_materialized(spark, links, more, classes)
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    out = ids.join(named.join(least, "root").select("print", "component", "root"), "print", "left")
    component = F.when(F.col("print").isNull(), F.col("key")).otherwise(F.col("component")).alias("component_id")
    return out.select(*(["row.*"] if "row" in held else [F.col("key").alias(key)]), "n_shingles", component, *([F.col("root").alias(mark)] if mark else []))
