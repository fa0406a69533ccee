"""The byte-level pre-tokenizer as a finite-state transducer, run over many texts at once.

The machine reads one symbol per character (its class, with the two characters after it taken into account where the
split pattern looks ahead) and marks where a piece starts.  Texts are laid end to end, cut into chunks of equal
length, and each chunk's map from entry state to exit state is computed for all states; the maps are composed by a
parallel prefix scan, which gives every chunk its entry state; a second pass then marks the starts.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np

from measura.llm.textops import new_key, span_hashes, unequal

LETTER, NUMBER, OTHER, SHORT, LONG, SPACES, LAST_BLANK, LAST_SPACE, END = range(9)
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, IN_SPACES, ONE_MORE, TWO_MORE = range(8)
STATES = 8
SYNC = 4  # columns after which maps are compared
SENTINEL = 0x110000
LETTERS_END = 0x40000  # no letter or number stands in the planes from here on
#: Characters of the Unicode property White_Space.
WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Endings that follow an apostrophe as one piece.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")


@cache
def classes() -> np.ndarray:
    """Class of every code point, and END for the sentinel."""
    out = np.full(SENTINEL + 1, OTHER, np.uint8)
    kinds = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(LETTERS_END)).encode(), "S1")
    out[:LETTERS_END][kinds == b"L"] = LETTER
    out[:LETTERS_END][kinds == b"N"] = NUMBER
    out[list(WHITE)] = SPACES
    out[SENTINEL] = END
    return out


@cache
def machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a piece), both indexed by symbol * STATES + state."""
    step, starts = np.zeros((9, STATES), np.intp), np.zeros((9, STATES), bool)
    joins = {LETTER: (IN_LETTERS, (IN_LETTERS, AFTER_BLANK)), NUMBER: (IN_NUMBERS, (IN_NUMBERS, AFTER_BLANK)), OTHER: (IN_OTHERS, (IN_OTHERS, AFTER_BLANK))}
    for q in range(STATES):
        for x, (kind, ok) in joins.items():
            step[x, q], starts[x, q] = kind, q not in ok
        for x, inside in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):
            joined = q in (IN_OTHERS, AFTER_BLANK)
            step[x, q], starts[x, q] = IN_OTHERS if joined else inside, not joined
        step[SPACES, q], starts[SPACES, q] = IN_SPACES, q != IN_SPACES
        step[LAST_BLANK, q], starts[LAST_BLANK, q] = AFTER_BLANK, True
        step[LAST_SPACE, q], starts[LAST_SPACE, q] = IN_SPACES, True
    for x in range(9):
        step[x, TWO_MORE], step[x, ONE_MORE] = ONE_MORE, START
        starts[x, [TWO_MORE, ONE_MORE]] = False
    step[END], starts[END] = START, True
    return step.ravel(), starts.ravel()


def symbols(points: np.ndarray) -> np.ndarray:
    kind = classes()[points]
    after = np.append(points[1:], SENTINEL)
    after2 = np.append(points[2:], [SENTINEL, SENTINEL])[: len(points)]
    quote = points == ord("'")
    if quote.any():
        at = np.flatnonzero(quote)
        kind[at[np.isin(after[at], [ord(c) for c in SHORT_ENDINGS])]] = SHORT
        for a, b in LONG_ENDINGS:
            kind[at[(after[at] == ord(a)) & (after2[at] == ord(b))]] = LONG
    next_kind = np.append(kind[1:], END)
    last = (kind == SPACES) & (next_kind != SPACES) & (next_kind != END)
    kind[last] = np.where(points[last] == 32, LAST_BLANK, LAST_SPACE)
    return kind


def piece_starts(kind: np.ndarray, chunk: int = 512) -> np.ndarray:
    """Positions at which pieces start, the sentinels' own among them."""
    step, starts = machine()
    lanes = -(-len(kind) // chunk)
    padded = np.full(lanes * chunk, END, np.intp)
    padded[: len(kind)] = kind
    columns = np.ascontiguousarray(padded.reshape(lanes, chunk).T) * STATES
    maps = np.tile(np.arange(STATES), (lanes, 1))
    at = np.empty_like(maps)
    one = None  # the exit states, once no chunk's map depends on its entry state any more
    for j, column in enumerate(columns):
        if one is not None:
            one = step[column + one]
            continue
        np.take(step, np.add(column[:, None], maps, out=at), out=maps, mode="clip")
        if j % SYNC == SYNC - 1 and (maps == maps[:, :1]).all():
            one = maps[:, 0]
    if one is not None:
        maps = np.repeat(one[:, None], STATES, 1)
    reach = 1
    while reach < lanes:  # after each round a map covers twice as many chunks
        maps = np.concatenate([maps[:reach], np.take_along_axis(maps[reach:], maps[:-reach], 1)])
        reach *= 2
    state = np.append(START, maps[:-1, START])
    flags = np.empty((chunk, lanes), bool)
    for j, column in enumerate(columns):
        place = column + state
        flags[j] = starts[place]
        state = step[place]
    return np.flatnonzero(flags.T.ravel()[: len(kind)])


KEY = new_key()  # of this process: hashes are compared inside it only


@dataclass
class Pieces:
    text: str  # all texts, a character between them
    points: np.ndarray  # its code points
    starts: np.ndarray
    ends: np.ndarray
    #: first[i]:first[i + 1] are the pieces of text i.
    first: np.ndarray

    def strings(self, which: np.ndarray) -> list[str]:
        text = self.text
        return [text[a:b] for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist(), strict=True)]

    def distinct(self) -> tuple[list[str], np.ndarray]:
        """(distinct pieces, the place among them of every piece): told by hash, and compared with what stands for them."""
        _, first, back = np.unique(span_hashes(self.points, self.starts, self.ends, KEY), return_index=True, return_inverse=True)
        strings, back = self.strings(first), back.ravel()
        wrong = unequal(self.points, self.starts, self.ends, first[back])
        if len(wrong):
            place: dict[str, int] = {}
            for i, s in zip(wrong.tolist(), self.strings(wrong), strict=True):
                back[i] = place.setdefault(s, len(strings) + len(place))
            strings += place
        return strings, back


def pieces(texts: list[str]) -> Pieces:
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    text = "\n".join([*texts, ""])
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint32)
    inside = np.ones(len(points), bool)
    inside[ends] = False
    points[ends] = SENTINEL
    starts = piece_starts(symbols(points)) if len(points) else np.zeros(0, np.int64)
    stops = np.append(starts[1:], len(points))
    real = inside[starts]
    starts, stops = starts[real], stops[real]
    first = np.searchsorted(starts, np.append(0, ends + 1))
    return Pieces(text, points, starts, stops, first)


@cache
def spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def added(path: str) -> list[str]:
    return [t["content"] for t in spec(path)["added_tokens"]]
