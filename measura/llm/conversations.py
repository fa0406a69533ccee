"""Conversation repair by signature deduplication.

Every row of a conversation, in order, becomes one letter: the kind of its role (system, user, assistant, other: by the role's
first character) times its first fault (none, blank, duplicate, truncated).  The letters of a conversation are its signature.
Each distinct signature is solved once, by recursion over its endings with a memo that all signatures share, and its audit
(the cheapest edits' initials) is joined back to the conversations; then the edits are replayed over the rows.

Edits: Keep, Rerole (to the role that the place calls for), Delete, Insert (a row without text).  Kept and inserted roles
must read ``(s?(ua)+)?`` by their initials.  From any place of that grammar an edit leads to one place only, so of the
cheapest audits the one that is least in ASCII order follows from choosing the least cheapest edit at every step.

Faults, the first that holds: blank (nothing but ASCII blanks), duplicate (role and text occur earlier in the conversation),
truncated (the last character that isn't a blank is none of ``.!?``).

What crosses the network: rows without texts (texts as SHA-256) for the signatures, then every text once for the replay.
Rows that agree in all that matters are counted before they are shuffled.  A conversation is read as a stream in its order, so
of a long one a task holds a letter for each row, never the texts.  Common signatures are joined by (signature, salt).

Edge cases: rows go by turn, nulls first; ties by role and then by the text's digest, so equal rows are neighbours.  Null
ids are one conversation; null roles and texts are one space; a role that is empty or begins otherwise must be changed or
go.  A conversation all of whose rows have no copies has no rows: zeros, and an empty audit.  An empty table gives an empty
result.  Other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from measura.session import materialize

BLANKS = " \t\n\x0b\x0c\r"
KINDS, FAULTS = "sua", ("none", "blank", "duplicate", "truncated")
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
SALTS = 64
TAIL = 24  # endings of up to so many letters are remembered across signatures
REMEMBERED = 200_000

#: Places of the grammar: 0 start, 1 after the system row, 2 after a user row, 3 after an assistant row (0 and 3 may end).
KEEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
CALLS = (2, 2, 3, 2)  # the place after the role that a place calls for
ROLE = {2: "user", 3: "assistant"}
INSERT, DELETE, REROLE, CUT = 5, 2, 1, 5
NEVER = 1 << 60


def letter(kind: int, fault: int) -> str:
    return chr(97 + 4 * kind + fault)


def read(code: str) -> tuple[str, int]:
    """(initial of the role, fault) of a letter; the initial of other roles is ``x``."""
    kind, fault = divmod(ord(code) - 97, 4)
    return (KINDS + "x")[kind], fault


def inserted(costs: list[int]) -> tuple[int, ...]:
    """Least costs of the four places where rows may be inserted first."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[CALLS[at]]) for at, c in enumerate(costs)]
    return tuple(costs)


def edits(code: str, at: int) -> Iterator[tuple[str, int, int]]:
    """(initial, cost, next place) of the edits that a row allows at a place."""
    initial, fault = read(code)
    yield "D", DELETE, at
    if fault in (BLANK, DUPLICATE):
        return
    extra = CUT if fault == TRUNCATED else 0
    if initial in KEEPS[at]:
        yield "K", extra, KEEPS[at][initial]
    yield "R", REROLE + extra, CALLS[at]


class Solver:
    """Solves signatures; the costs of short endings are kept for the next ones."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {"": inserted([0, NEVER, NEVER, 0])}
        self.moves = {letter(k, f): [list(edits(letter(k, f), at)) for at in range(4)] for k in range(4) for f in range(4)}

    def before(self, code: str, after: tuple[int, ...]) -> tuple[int, ...]:
        return inserted([min(c + after[to] for _, c, to in self.moves[code][at]) for at in range(4)])

    def ending(self, tail: str) -> tuple[int, ...]:
        """Least cost of an ending from each place of the grammar."""
        found = self.known.get(tail)
        if found is None:
            found = self.before(tail[0], self.ending(tail[1:]))
            if len(self.known) < REMEMBERED:
                self.known[tail] = found
        return found

    def costs(self, signature: str) -> list[tuple[int, ...]]:
        """ending() of every ending, the whole signature first; long ones are built up without recursion."""
        n = len(signature)
        out = [self.ending(signature[n - k :]) for k in range(min(n, TAIL) + 1)]
        for k in range(TAIL, n):
            out.append(self.before(signature[n - k - 1], out[-1]))
        return out[::-1]

    def audit(self, signature: str) -> tuple[int, str]:
        costs, at, i, out = self.costs(signature), 0, 0, []
        while i < len(signature) or costs[i][at]:
            options = [("I", INSERT, CALLS[at], i)]
            if i < len(signature):
                options += [(e, c, to, i + 1) for e, c, to in self.moves[signature[i]][at]]
            edit, _, at, i = min(o for o in options if o[1] + costs[o[3]][o[2]] == costs[i][at])
            out.append(edit)
        return costs[0][0], "".join(out)


def solve(solver: Solver, signature: str) -> dict[str, Any]:
    row = [read(c) for c in signature]
    cost, audit = solver.audit(signature)
    pairs = zip(row, row[1:], strict=False)
    return {
        **{name: sum(f == k for _, f in row) for k, name in enumerate(FAULTS) if k},
        "illegal": sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in pairs), "cost": cost, "audit": audit,
    }


SOLVED = "signature string, salts array<int>, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
SOLVED_ARROW = pa.schema([("signature", pa.string()), ("salts", pa.list_(pa.int32())), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])


def solving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    solver = Solver()
    for batch in batches:
        for a in range(0, len(batch), 1024):
            rows = batch.slice(a, 1024).to_pylist()
            yield pa.RecordBatch.from_pylist([r | solve(solver, r["signature"]) for r in rows], SOLVED_ARROW)


def signing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, signature, gaps) of conversations that come row by row, in order."""
    conv: Any = None
    kind: pa.DataType | None = None
    letters: list[str] = []
    low = high = last = None
    turns, open_ = 0, False
    done: list[tuple] = []

    def close() -> None:
        gaps = 0 if low is None else min(high - low + 1 - turns, (1 << 63) - 1)
        done.append((conv, "".join(letters), gaps))

    def out() -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) or [[], [], []]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["conv", "signature", "gaps"])

    for batch in batches:
        kind = batch["conv"].type
        for c, turn, code, again, n in zip(*(batch[x].to_pylist() for x in ("conv", "turn", "code", "again", "n")), strict=True):
            if not open_ or c != conv:
                if open_:
                    close()
                conv, letters, low, high, last, turns, open_ = c, [], None, None, None, 0, True
            if not n:
                continue
            letters.append(code)
            if n > 1:
                letters.append(again * (n - 1))
            if turn is not None:
                if turn != last:
                    turns, last = turns + 1, turn
                low, high = turn if low is None else low, turn
        if done:
            yield out()
    if open_:
        close()
        yield out()


def told(rows: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    """(conv, turn, role, text, digest, copies) of the rows."""
    named = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    out = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), named(role).alias("role"), named(text).alias("text"), (F.col(f"`{copies}`") if copies else F.lit(1)).cast("long").alias("copies"))
    return out.withColumn("digest", F.unhex(F.sha2("text", 256)))


def lettered(kind: Column, fault: Column) -> Column:
    return F.char((F.lit(97) + F.lit(4) * kind + fault).cast("long"))


def audits(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> DataFrame:
    """(conv, signature, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation.

    copies: a column that says how many times a row stands in its conversation (none: once).  The signatures are in a
    materialized table, which drop_materialized() deletes once the result has been used.
    """
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(F.length(bare) == 0, BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    kind = F.instr(F.lit(KINDS), F.left("role", F.lit(1)))  # from 1; 0: another
    kind = F.when((kind == 0) | (F.length("role") == 0), len(KINDS)).otherwise(kind - 1)
    narrow = told(rows, conv, turn, role, text, copies).select("conv", "turn", "role", "digest", fault.alias("fault"), kind.alias("kind"), "copies")
    counted = narrow.groupBy("conv", "turn", "role", "digest", "fault", "kind").agg(F.sum("copies").alias("n"))
    first = F.row_number().over(W.partitionBy("conv", "role", "digest", F.col("n") > 0).orderBy(F.col("turn").asc_nulls_first())) == 1
    fault = F.when((F.col("fault") == BLANK) | F.col("first"), F.col("fault")).otherwise(DUPLICATE)
    again = F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE)
    coded = counted.repartition("conv").withColumn("first", first).select("conv", "turn", "role", "digest", lettered(F.col("kind"), fault).alias("code"), lettered(F.col("kind"), again).alias("again"), "n")
    ordered = coded.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "digest").select("conv", "turn", "code", "again", "n")
    schema = T.StructType([T.StructField("conv", narrow.schema["conv"].dataType), T.StructField("signature", T.StringType()), T.StructField("gaps", T.LongType())])
    salt = F.pmod(F.xxhash64("conv"), F.lit(SALTS)).cast("int")
    signed = materialize(ordered.mapInArrow(signing, schema).withColumn("salt", salt), "conversation-signatures")
    distinct = signed.groupBy("signature", "salt").agg(F.lit(1).alias("one")).groupBy("signature").agg(F.collect_set("salt").alias("salts"))
    solved = distinct.mapInArrow(solving, SOLVED).withColumn("salt", F.explode("salts")).drop("salts")
    return signed.join(solved, ["signature", "salt"]).select("conv", "signature", "gaps", *FAULTS[1:], "illegal", "cost", "audit")


REPLAYED = [("place", T.LongType(), pa.int64()), ("edit", T.StringType(), pa.string()), ("role", T.StringType(), pa.string()), ("text", T.StringType(), pa.string())]
ROWS = 4096


def replaying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edited rows of conversations that come as their audit followed by their rows, in order."""
    conv: Any = None
    audit, step, at, place = "", 0, 0, 0
    kind: pa.DataType | None = None
    done: list[tuple] = []

    def put(edit: str, role: str | None, text: str | None) -> None:
        nonlocal place
        done.append((conv, place, edit, role, text))
        place += 1

    def insertions() -> None:
        nonlocal step, at
        while step < len(audit) and audit[step] == "I":
            at = CALLS[at]
            put("I", ROLE[at], "")
            step += 1

    def out() -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) or [[]] * 5
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, t) for c, (_, _, t) in zip(cols[1:], REPLAYED, strict=True))], names=["conv", *(n for n, _, _ in REPLAYED)])

    for batch in batches:
        kind = batch["conv"].type
        for a in range(0, len(batch), ROWS):
            part = batch.slice(a, ROWS)
            for c, plan, role, text, n in zip(*(part[x].to_pylist() for x in ("conv", "audit", "role", "text", "copies")), strict=True):
                if plan is not None:
                    insertions()  # what the conversation before ends with
                    conv, audit, step, at, place = c, plan, 0, 0, 0
                    continue
                for _ in range(n):
                    insertions()
                    edit = audit[step]
                    step += 1
                    if edit == "D":
                        put("D", role, None)
                    elif edit == "K":
                        at = KEEPS[at][role[:1]]
                        put("K", role, text)
                    else:
                        at = CALLS[at]
                        put("R", ROLE[at], text)
            yield out()
    insertions()
    if done:
        yield out()


def repaired(rows: DataFrame, audited: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> DataFrame:
    """(conv, place, edit, role, text): the rows after their edits, in order within partitions; deleted ones have no text.

    ``audited``: (conv, audit) of every conversation, as audits() gives them for the same rows.
    """
    body = told(rows, conv, turn, role, text, copies).where("copies > 0").withColumn("audit", F.lit(None).cast("string")).withColumn("part", F.lit(1))
    heads = audited.select("conv", "audit", F.lit(0).alias("part"))
    both = body.unionByName(heads, allowMissingColumns=True).repartition("conv")
    ordered = both.sortWithinPartitions("conv", "part", F.col("turn").asc_nulls_first(), "role", "digest").select("conv", "audit", "role", "text", "copies")
    return ordered.mapInArrow(replaying, T.StructType([T.StructField("conv", body.schema["conv"].dataType), *(T.StructField(n, t) for n, t, _ in REPLAYED)]))


def digesting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, repaired_sha256) of conversations that come row by row, in order."""
    conv: Any = None
    digest, lines, kind = None, 0, None
    for batch in batches:
        kind, convs, hexes = batch["conv"].type, [], []
        for c, edit, role, text in zip(*(batch[x].to_pylist() for x in ("conv", "edit", "role", "text")), strict=True):
            if digest is None or c != conv:
                if digest is not None:
                    convs.append(conv)
                    hexes.append(digest.hexdigest())
                conv, digest, lines = c, hashlib.sha256(), 0
            if edit != "D":
                digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
        yield pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(hexes, pa.string())], names=["conv", "repaired_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()], pa.string())], names=["conv", "repaired_sha256"])


def digests(edited: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): SHA-256 of the ``role:text`` lines of what repaired() gives, which must come straight from it."""
    return edited.mapInArrow(digesting, T.StructType([edited.schema["conv"], T.StructField("repaired_sha256", T.StringType())]))
