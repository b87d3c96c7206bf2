"""Boundaries of the byte-level pre-tokens of texts, found with arrays instead of a regular expression.

Every code point gets a class, every position a symbol (its class and what follows), every symbol a transition function over
the states of a small automaton. Functions compose associatively, so an array scan over composition ids (the automaton's
transition monoid, enumerated once) gives the state at every position, and with it where a token begins.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

LETTER, NUMBER, OTHER, BLANK, LAST_SPACE, LAST_BLANK, SHORT, LONG, BREAK = range(9)
START, IN_L, IN_N, IN_O, IN_W, AFTER_SPACE, ONE_LEFT, TWO_LEFT, CLOSED = range(9)
BLOCK = 256


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point: LETTER, NUMBER, OTHER or BLANK."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, name in ((LETTER, "L"), (NUMBER, "N"), (BLANK, "White_Space")):
        for m in regex.finditer(rf"\p{{{name}}}+", points):
            table[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether the symbol begins a token."""
    if symbol == BREAK:
        return START, True
    if state in (ONE_LEFT, TWO_LEFT):
        return (CLOSED if state == ONE_LEFT else ONE_LEFT), False
    if symbol in (LETTER, NUMBER, OTHER):
        inside = (IN_L, IN_N, IN_O)[symbol]
        return inside, state not in (inside, AFTER_SPACE)
    if symbol in (SHORT, LONG):
        if state in (IN_O, AFTER_SPACE):
            return IN_O, False
        return (ONE_LEFT if symbol == SHORT else TWO_LEFT), True
    if symbol == BLANK:
        return IN_W, state != IN_W
    return (AFTER_SPACE if symbol == LAST_SPACE else CLOSED), True


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol its function's id; the composition table, flat; each function's image of each state; who begins a token."""
    single = [tuple(step(s, c)[0] for s in range(9)) for c in range(9)]
    known = {tuple(range(9)): 0}
    todo = [*known]
    while todo:
        f = todo.pop()
        for g in single:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    images = np.array(list(known), np.uint8)
    compose = np.array([[known[tuple(g[s] for s in f)] for g in known] for f in known], np.uint16)
    begins = np.array([[step(s, c)[1] for c in range(9)] for s in range(9)])
    return np.array([known[f] for f in single], np.uint16), compose.ravel(), images, begins


def prefix(ids: np.ndarray, compose: np.ndarray, size: int) -> np.ndarray:
    """The composition of all functions up to each position."""
    n = len(ids)
    if n <= 64:
        out = ids.copy()
        for k in range(1, n):
            out[k] = compose[int(out[k - 1]) * size + int(out[k])]
        return out
    rows = -(-n // BLOCK)
    grid = np.zeros(rows * BLOCK, np.uint16)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    for k in range(1, BLOCK):
        grid[k] = compose[grid[k - 1].astype(np.intp) * size + grid[k]]
    before = np.zeros(rows, np.uint16)
    before[1:] = prefix(grid[-1], compose, size)[:-1]
    return np.ascontiguousarray(compose[before.astype(np.intp) * size + grid].T).ravel()[:n]


def boundaries(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Positions where a token begins, among code points; those at breaks stand between texts and are tokens of their own."""
    n = len(points)
    kind = classes()[points]
    kind[breaks] = BREAK
    after = np.full(n, BREAK, np.uint8)
    after[:-1] = kind[1:]
    symbol = kind.copy()
    last = np.flatnonzero((kind == BLANK) & (after != BLANK) & (after != BREAK))
    symbol[last] = np.where(points[last] == 0x20, LAST_SPACE, LAST_BLANK)
    for at in (quote := np.flatnonzero((points == 0x27) & (kind == OTHER)),):
        one = points[np.minimum(at + 1, n - 1)]
        two = points[np.minimum(at + 2, n - 1)]
        in_one = (at + 1 < n) & (kind[np.minimum(at + 1, n - 1)] == LETTER)
        in_two = in_one & (at + 2 < n) & (kind[np.minimum(at + 2, n - 1)] == LETTER)
        symbol[at[in_one & np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        symbol[at[in_two & pair]] = LONG
    ids, compose, images, begins = monoid()
    state = images[prefix(ids[symbol], compose, len(images)), START]
    before = np.full(n, START, np.uint8)
    before[1:] = state[:-1]
    return np.flatnonzero(begins[before, symbol])


#: A letter or number is followed by something of another class: a token begins there whatever stands around.
_SAFE = regex.compile(r"(?<=\p{L})\P{L}|(?<=\p{N})\P{N}")
_LETTERS = regex.compile(r"\p{L}{4}")


def fused_pairs(tokens) -> np.ndarray:
    """Which byte pairs (first * 256 + second) stand within any token: merges never cross a place with another pair."""
    out = np.zeros(1 << 16, bool)
    for t in tokens:
        for a, b in zip(t, t[1:]):
            out[a << 8 | b] = True
    return out


def _between(text: str, lo: int, hi: int, fused: np.ndarray) -> int:
    """The first place among letters from lo on that no merge can cross; hi if there is none before."""
    for p in range(max(lo, 3), min(hi, len(text))):
        if not fused[text[p - 1].encode("utf-8", "surrogatepass")[-1] << 8 | text[p].encode("utf-8", "surrogatepass")[0]] and _LETTERS.fullmatch(text, p - 3, p + 1):
            return p
    return hi


def cuts(text: str, chars: int, fused: np.ndarray | None = None):
    """Parts of about so many characters of a long text, cut where a token begins or, within longer runs of letters, where no merge crosses."""
    at = 0
    while len(text) - at > chars:
        m = _SAFE.search(text, at + chars, min(len(text), at + 2 * chars))
        to = m.start() if m else len(text)
        if not m and fused is not None:
            to = _between(text, at + chars, len(text), fused)
        if to >= len(text):
            break
        yield text[at:to]
        at = to
    yield text[at:]


def parts(texts: list[str], limit: int, fused: np.ndarray | None = None):
    """Lists of (row, text) of about limit bytes (UTF-8); longer texts are cut (see cuts), so each of their parts has a list of its own."""
    group, total = [], 0
    for row, text in enumerate(texts):
        size = len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))
        if group and total + size > limit:
            yield group
            group, total = [], 0
        if size > limit:
            for part in cuts(text, max(limit * len(text) // size, 16), fused):
                yield [(row, part)]
            continue
        group.append((row, text))
        total += size
    if group:
        yield group


def pieces(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All pre-tokens of the texts in order, the index of each text's first one (one more entry closes the last), and where each begins in its text."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    begin = boundaries(points, ends)
    stop = np.append(begin[1:], len(points))
    solid = ~np.isin(begin, ends, assume_unique=True)
    begin, stop = begin[solid], stop[solid]
    first = np.searchsorted(begin, np.concatenate([[0], ends + 1]))
    own = begin - np.repeat(np.concatenate([[0], ends[:-1] + 1]), np.diff(first))
    return [joined[a:b] for a, b in zip(begin.tolist(), stop.tolist())], first, own
