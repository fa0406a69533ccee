"""Conversation repair against exhaustive search over all edits, and the query against a plain version."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from functools import cache

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from measura.llm import catalog, conversations, op13_conversations

BLANK = " \t\n\x0b\x0c\r"
LEGAL = re.compile("(s?(ua)+)?")


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        end = text.rstrip(BLANK)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def search(rows, most):
    """(cost, audit, lines) of the cheapest edits, least in ASCII order, of all edits up to a cost."""
    found = faults(rows)
    best = None

    def go(i, cost, audit, lines, roles):
        nonlocal best
        if cost > most or (best and cost > best[0]):
            return
        if i == len(rows) and LEGAL.fullmatch(roles):
            best = min(best or (cost, audit, lines), (cost, audit, lines))
        for role in ("user", "assistant"):
            if len(roles) <= len(rows) + 2:
                go(i, cost + 5, audit + "I", [*lines, f"{role}:"], roles + role[0])
        if i < len(rows):
            _, role, text = rows[i]
            go(i + 1, cost + 2, audit + "D", lines, roles)
            if found[i] not in ("blank", "duplicate"):
                extra = 5 if found[i] == "truncated" else 0
                go(i + 1, cost + extra, audit + "K", [*lines, f"{role}:{text}"], roles + (role[:1] or "?"))
                for new in ("user", "assistant"):
                    go(i + 1, cost + extra + 1, audit + "R", [*lines, f"{new}:{text}"], roles + new[0])

    go(0, 0, "", [], "")
    return best


@cache
def solver():
    return conversations.Solver()


@pytest.mark.parametrize("n", range(5))
def test_every_short_signature_against_search(n):
    kinds = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    shapes = [(k, f) for k in kinds for f in (0, 3)] + [("u", 1)] if n < 4 else [("s", 0), ("u", 0), ("a", 0), ("x", 3), ("u", 3), ("a", 1)]
    for of in itertools.product(shapes, repeat=n):
        rows = [(0, kinds[k], "" if f == 1 else f"t{i}" + ("." if f == 0 else "")) for i, (k, f) in enumerate(of)]
        signature = "".join(conversations.letter("suax".index(k), f) for k, f in of)
        cost, audit, _ = search(rows, 2 * n)
        assert solver().audit(signature) == (cost, audit), of


def test_long_signatures_need_no_deep_recursion():
    n = 40_000
    cost, audit = solver().audit((conversations.letter(1, 0) + conversations.letter(2, 0)) * n)
    assert (cost, audit) == (0, "K" * (2 * n))


def plain(rows):
    """Brute force of the query over (conv_id, turn, role, text) rows."""
    by = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        deed, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if deed == 1 else re.sub("[.!?]", "", text) if deed == 2 else text
        row = (turn, "user" if deed == 4 else role, text)
        by.setdefault(conv, []).extend([row] * {0: 0, 3: 2}.get(deed, 1))
    out = {}
    for conv, of in by.items():
        of.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns, found = [t for t, _, _ in of if t is not None], faults(of)
        initials = [r[:1] for _, r, _ in of]
        cost, audit, lines = search(of, 2 * len(of)) or (0, "", [])
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


SCHEMA = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.string())])


def run(spark, folder, rows):
    pq.write_table(pa.Table.from_pylist([dict(zip(SCHEMA.names, (*r, "x"), strict=True)) for r in rows], SCHEMA), f"{folder}/conversations.parquet")
    df = catalog.QUERIES["op13_conversations"](spark, str(folder))
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {t for c, t in df.dtypes if c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} == {"bigint"}
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(c, t, ["system", "user", "assistant", "user"][(t + c) % 4], f"Said {c % 7} {t % 2}" + ".!?x"[(c + t) % 4]) for c in range(120) for t in range(1 + c % 6)]
    rows += [(1000, None, "user", "No turn."), (1000, None, "user", "No turn."), (1000, 3, None, None), (1000, 9, "assistant", " \n"), (None, 1, "user", "No id!"), (None, 2, "assistant", "Yes \t")]
    rows += [(1001, 1, "", "Nobody said."), (1001, 1, "tool", "B."), (1001, 1, "tool", "A."), (1001, 4, "User", "Caps."), (1002, 1, "user", "x" * 200_000 + "."), (1002, 2, "assistant", ". \x85")]
    want = plain(rows)
    assert run(spark, tmp_path, rows) == want
    # A conversation of which nothing is left.
    gone = next(k for k in range(2000, 3000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    (tmp_path / "b").mkdir()
    assert run(spark, tmp_path / "b", [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_query_takes_an_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == {}


def test_hot_signature_and_hot_conversation(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in range(600) for t in range(2)] + [(-1, t, "user", f"{t}") for t in range(3000)] + [(-2, 5, "user", "Same.")] * 700
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv"]: r for r in conversations.audits(docs).collect()}
    assert {(found[c]["audit"], found[c]["cost"]) for c in range(600)} == {("KK", 0)}
    assert (found[-1]["audit"], found[-1]["truncated"], found[-1]["gaps"]) == ("D" * 3000, 3000, 0)
    assert (found[-2]["duplicate"], found[-2]["audit"]) == (699, "D" * 700)


def test_repaired_rows_are_the_edited_rows(spark):
    rows = [(1, 1, "assistant", "First."), (1, 2, "assistant", "Second."), (1, 3, "user", " "), (1, 4, "user", "Third."), (2, 1, "user", "A."), (2, 2, "assistant", "B.")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    edited = conversations.repaired(docs, conversations.audits(docs))
    got = sorted((r["conv"], r["place"], r["edit"], r["role"], r["text"]) for r in edited.collect())
    assert got == [(1, 0, "R", "user", "First."), (1, 1, "K", "assistant", "Second."), (1, 2, "D", "user", None), (1, 3, "D", "user", None), (2, 0, "K", "user", "A."), (2, 1, "K", "assistant", "B.")]
    assert op13_conversations.damaged(docs).count() == len(rows)
