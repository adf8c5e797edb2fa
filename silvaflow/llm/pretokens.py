"""Texts as arrays of code points, cut into pre-tokens that are then counted once each.

A batch of texts is one array of code points. Rules over arrays say where pre-tokens begin; equal pre-tokens are found by
two 64-bit hashes (one sorts, the other confirms; of long ones they are the halves of a cryptographic hash), so that tokenizers see each distinct pre-token of a batch once.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import regex

#: Classes of code points for the byte-level pattern: letters, numbers, white space, everything else.
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: White space as Unicode's property White_Space has it (fixed values).
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: What may follow an apostrophe and is cut off with it (fixed values of the pattern).
SHORT = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    table[list(WHITE)] = SPACE
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@cache
def _plain() -> np.ndarray:
    """For each code point itself if it is a letter, a number or a line feed, else a blank."""
    table, kind = np.arange(0x110000, dtype=np.uint32), classes()
    table[(kind != LETTER) & (kind != NUMBER)] = 32
    table[10] = 10
    return table


def plain(text: str) -> str:
    """text in lower case, with a blank for all that is no letter, number or line feed."""
    return _plain()[code_points(text.lower())].tobytes().decode("utf-32-le", "surrogatepass")


def byte_level_starts(cp: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of the byte-level pattern begin in cp, the texts that begin at doc_starts one after another:

    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|white space but its last if more follows|white space
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[cp]
    first = np.zeros(n + 1, bool)  # a document begins here
    first[doc_starts[doc_starts < n]] = True
    first[n] = True
    first[0] = True
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = (kind[1:] != kind[:-1]) | first[1:n]
    white = kind == SPACE
    # the last white character before something else of the same document begins a token: alone, or as the prefix ' '
    lone = np.zeros(n, bool)
    lone[:-1] = white[:-1] & ~white[1:] & ~first[1:n]
    start |= lone
    glued = lone & (cp == 32)
    start[1:] &= ~glued[:-1]
    # contractions: an apostrophe that begins a token, and letters after it
    mark = np.flatnonzero((cp[:-1] == 39) & start[:-1] & (kind[1:] == LETTER) & ~first[1:n])
    if len(mark):
        a = cp[mark + 1]
        inside = mark + 2 < n
        b = np.where(inside & ~first[np.minimum(mark + 2, n)], cp[np.minimum(mark + 2, n - 1)], 0)
        two = np.zeros(len(mark), bool)
        for s in SHORT:
            if len(s) == 2:
                two |= (a == ord(s[0])) & (b == ord(s[1]))
        one = np.isin(a, [ord(s) for s in SHORT if len(s) == 1])
        start[(mark + 1)[one | two]] = False
        for length, chosen in ((2, one), (3, two & ~one)):
            at = (mark + length)[chosen]
            start[at[at < n]] = True
    return np.flatnonzero(start)


def byte_level_spans(texts: list[str], special: str) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined, their code points, where pre-tokens begin and end, and for each text (and the end) the index of
    its first one. The string special is a pre-token wherever it stands in a text."""
    parts: list[str] = []
    first_part, whole = [], []
    for text in texts:
        first_part.append(len(parts))
        if special in text:
            for i, x in enumerate(re.split(f"({re.escape(special)})", text)):
                if x:
                    whole += [len(parts)] * (i % 2)
                    parts.append(x)
        else:
            parts.append(text)
    joined = "".join(parts)
    cp = code_points(joined)
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=at[1:])
    starts = byte_level_starts(cp, at[:-1])
    for i in whole:
        starts = starts[(starts <= at[i]) | (starts >= at[i + 1])]
    ends = np.append(starts[1:], len(cp))[: len(starts)]
    first = np.searchsorted(starts, at[np.array([*first_part, len(parts)], np.int64)])
    return joined, cp, starts, ends, first


#: Two odd numbers, each with its inverse modulo 2^64.
BASES = [(b, pow(b, -1, 1 << 64)) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
#: Powers are kept up to 2^LOW; those beyond are products of two, made anew for each array, so that a worker holds no table
#: as long as its longest text.
LOW = 16


def _accumulated(base: int, n: int) -> np.ndarray:
    step = np.full(n, base, np.uint64)
    step[0] = 1
    return np.multiply.accumulate(step)


@cache
def _low_powers(base: int) -> np.ndarray:
    return _accumulated(base, 1 << LOW)


def _times_powers(x: np.ndarray, base: int, at: np.ndarray | None = None) -> np.ndarray:
    """x times the powers of base modulo 2^64 whose exponents are at, or the places of x."""
    n = len(x) if at is None else int(at.max(initial=0)) + 1
    low, high = _low_powers(base), _accumulated(pow(base, 1 << LOW, 1 << 64), (n >> LOW) + 1)
    if at is not None:
        return x * low[at & ((1 << LOW) - 1)] * high[at >> LOW]
    out = x.copy()
    for k, h in enumerate(high.tolist()):
        part = out[k << LOW : (k + 1) << LOW]
        part *= low[: len(part)]
        part *= np.uint64(h)
    return out


def _mix(cp: np.ndarray) -> np.ndarray:
    x = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


#: Longer spans are hashed by blake2b: polynomials modulo 2^64 have equal values for some different spans of 1024 and more.
SIMPLE = 64


def span_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each span of cp, equal for equal contents wherever they lie."""
    x = _mix(cp)
    out = []
    for base, inverse in BASES:
        s = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(_times_powers(x, base), out=s[1:])
        h = _times_powers(s[ends] - s[starts], inverse, starts)
        h ^= h >> np.uint64(31)
        out.append(h * np.uint64(0x94D049BB133111EB))
    for i in np.flatnonzero(ends - starts > SIMPLE).tolist():
        digest = hashlib.blake2b(cp[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        out[0][i], out[1][i] = np.frombuffer(digest, np.uint64)
    return out[0], out[1]


def distinct(text: str, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct spans of text, and for each span the index of its content."""
    if not len(starts):
        return [], np.zeros(0, np.int64)
    h1, h2 = span_hashes(cp, starts, ends)
    _, at, inverse = np.unique(h1, return_index=True, return_inverse=True)
    if (h2[at][inverse] == h2).all() and ((ends - starts)[at][inverse] == ends - starts).all():
        return [text[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], inverse
    known: dict[str, int] = {}  # two contents with one hash: tell them apart by what they are
    inverse = np.fromiter((known.setdefault(text[s:e], len(known)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))
    return list(known), inverse


class Memo:
    """What was found for pre-tokens, in two generations of at most so many entries and characters."""

    def __init__(self, most: int = 300_000, chars: int = 12_000_000):
        self.most, self.chars, self.new, self.old, self.held = most, chars, {}, {}, 0

    def look_up(self, keys: list[str], make) -> list:
        """The values of keys; make gets the list of those not known and gives theirs."""
        out = []
        missing = {}
        new, old = self.new, self.old
        for k in keys:
            v = new.get(k)
            if v is None:
                v = old.get(k)
                if v is not None:
                    new[k] = v
            if v is None:
                missing[k] = None
            out.append(v)
        if missing:
            missing = dict(zip(missing, make(list(missing)), strict=True))
            out = [missing[k] if v is None else v for k, v in zip(keys, out, strict=True)]
            new |= missing
            self.held += sum(map(len, missing))  # characters of the keys
        if len(new) > self.most or self.held > self.chars:
            self.old, self.new, self.held = new, {}, 0
        return out
