"""Plain versions of the operators, for tests only."""

from __future__ import annotations

import hashlib
import re
import struct
from html.parser import HTMLParser
from itertools import combinations

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Texts that every operator on documents must take.
EDGE_TEXTS = [None, "", " \t\n", "a", "one two three", "été naïve \U0001f600 中文字 don't  I'LL", "line a\nline b\nline c\nline d", "line a\nline b\nline c\nline d", "12345 !!!  x​", "<|endoftext|> end", "word " * 9000, "\x00nul"]


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def substring_dedup(docs: dict[int, str | None], n: int = 13) -> dict[int, tuple[int, int, str]]:
    first: dict[tuple, int] = {}
    for d in sorted(docs):
        w = words(docs[d])
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), d)
    out = {}
    for d, text in docs.items():
        w = words(text)
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < d:
                gone.update(range(k, k + n))
        out[d] = len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def simhash(text: str | None, n: int) -> int:
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(links: list[tuple[int, int]], nodes: list[int]) -> dict[int, int]:
    root = {n: n for n in nodes}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(docs: dict[int, str | None], n: int, radius: int = 4) -> dict[int, tuple[str, int]]:
    fp = {d: simhash(t, n) for d, t in docs.items()}
    links = [(a, b) for a, b in combinations(sorted(docs), 2) if (fp[a] ^ fp[b]).bit_count() <= radius]
    root = components(links, list(docs))
    return {d: (f"{fp[d]:016x}", root[d]) for d in docs}


def _xx(data: bytes, seed: int = 42) -> int:
    h = xxhash.xxh64_intdigest(data, seed)
    return h - (1 << 64) if h >> 63 else h


def line_chunks(text: str, spacing: int) -> list[tuple[int, int]]:
    """Begin and end of each chunk: one closes after the second of a pair of lines that meets the condition, unless the pair before did."""
    lines = text.split("\n")
    h = [_xx(x.encode()) for x in lines]
    meets = [False] + [_xx(struct.pack("<q", b), _xx(struct.pack("<q", a)) % (1 << 64)) % spacing == 0 for a, b in zip(h, h[1:])]
    ends = [n + 1 for n in range(len(lines)) if n + 1 == len(lines) or meets[n] and not meets[n - 1]]
    return list(zip([0, *ends], ends))


def line_dedup(rows: dict[int, str], spacing: int = 2, least: int = 2) -> dict[int, str]:
    lines, chunks, first = {d: t.split("\n") for d, t in rows.items()}, {d: line_chunks(t, spacing) for d, t in rows.items()}, {}
    for d in sorted(rows):
        for c, (a, b) in enumerate(chunks[d]):
            first.setdefault(tuple(lines[d][a:b]), (d, c))
    out = {}
    for d in rows:
        later = {c for c, (a, b) in enumerate(chunks[d]) if b - a >= least and first[tuple(lines[d][a:b])] != (d, c)}
        gone = set()
        for c in later:
            a, b = chunks[d][c]
            other, n = first[tuple(lines[d][a:b])]
            x, y = chunks[other][n]
            gone.update(range(a, b))
            if c and c - 1 not in later and n:
                k = 1
                while k <= min(a - chunks[d][c - 1][0], x - chunks[other][n - 1][0]) and lines[d][a - k] == lines[other][x - k]:
                    gone.add(a - k)
                    k += 1
            if c + 1 < len(chunks[d]) and c + 1 not in later and n + 1 < len(chunks[other]):
                k = 0
                while k < min(chunks[d][c + 1][1] - b, chunks[other][n + 1][1] - y) and lines[d][b + k] == lines[other][y + k]:
                    gone.add(b + k)
                    k += 1
        out[d] = "\n".join(x for n, x in enumerate(lines[d]) if n not in gone)
    return out


def _chain(values: list[bytes]) -> int:
    """Spark's 64-bit hash of several values: each is hashed with the hash so far as its seed."""
    seed = 42
    for v in values:
        seed = _xx(v, seed % (1 << 64))
    return seed


def fingerprint(text: str | None, bins: int = 128, n: int = 5) -> list[int]:
    """One-permutation MinHash of word shingles, empty bins filled from probed ones, low bytes packed eight to a long."""
    w = [struct.pack("<q", _xx(x.encode())) for x in words(text)]
    hashes = [_chain(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [_chain(w)] if w else [_chain([struct.pack("<q", 0)])]
    least: dict[int, int] = {}
    for h in hashes:
        j = (h >> 57) + bins // 2
        least[j] = min(least.get(j, h), h)
    held = [least[j] for j in sorted(least)]
    int32 = lambda x: struct.pack("<i", x)
    full = []
    for i in range(bins):
        donor = next((p for p in (i, *(_chain([int32(i), int32(t)]) % bins for t in range(1, 201))) if p in least), None)
        full.append((least[donor] if donor is not None else held[_chain([int32(i)]) % len(held)]) & 255)
    packed = [int.from_bytes(bytes(full[k : k + 8]), "big") for k in range(0, bins, 8)]
    return [x - (1 << 64) if x >> 63 else x for x in packed]


class _Article(HTMLParser):
    """Texts of the blocks of article elements, for pages whose only boilerplate stands outside of them."""

    INLINE = {"b", "i", "em", "strong", "a", "span"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.runs, self.silent = 0, [""], False

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.silent = tag in ("script", "style")
        if tag == "br":
            self.runs[-1] += " "
        elif tag not in self.INLINE:
            self.runs.append("")

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.runs.append("")
        self.depth -= tag == "article"
        self.silent = False

    def handle_data(self, data):
        if self.depth and not self.silent:
            self.runs[-1] += data


def article(page: str | None) -> str:
    parser = _Article()
    parser.feed(page or "")
    parser.close()
    return "\n\n".join(t for t in (" ".join(r.split()) for r in parser.runs) if t)
