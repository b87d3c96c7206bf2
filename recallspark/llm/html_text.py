"""Main text of web pages, with boilerplate found by a suffix array per host.

Markup rules out what is no text by its element (menus, forms, scripts, footers and the like) and says where the article is. Names
are evidence: sure ones rule a container out, likely ones where its own size or links say the same, and what stays in doubt is for the suffix array. The token streams of each page's undecided blocks are concatenated host by host: all
blocks outside an article, and within one those whose container is named like a notice, a share bar or the like. A suffix array by
prefix doubling finds long token runs that repeat across distinct pages, covered tokens go, and the unique runs stay. On large hosts the
same runs are counted by digest over all of the host's pages instead. On a page with an article container only its blocks are text; the
others still stand as evidence of what its host repeats.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.llm.common import in_task, materialize, table, texts_of

#: Tokens of a repeated run, distinct pages that make it boilerplate, pages of a host that one suffix array takes, and bytes of their html.
RUN, PAGES, SHARD, SHARD_BYTES = 8, 3, 400, 32 << 20
#: Larger hosts that may be sent to every task; more are joined by a shuffle, each dealt over so many salts.
BROADCAST_HOSTS, SALTS = 100_000, 16

# fixed values: element names of HTML
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
NEVER = {"head", "title", "nav", "aside", "footer", "form", "style", "script", "noscript", "template", "svg", "math", "button", "select", "textarea", "iframe", "object", "canvas", "audio", "video", "dialog", "menu", "fieldset", "datalist"}
ENDS_PARAGRAPH = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S | re.I)
_NAMES = re.compile(r"(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
# fixed values: words of names that say what a container is (what adverts, comments and consent are is sure; the likely ones are held against its size, and hints against its links), and words that only say how it is laid out
SURE = {"ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "sponsor", "sponsored", "cookie", "cookies", "consent", "gdpr", "comment", "comments", "commentlist", "disqus", "replies", "popup", "modal", "breadcrumb", "breadcrumbs", "pagination", "login", "signup"}
LIKELY = {"banner", "promo", "promotion", "menu", "nav", "navbar", "navigation", "notice", "alert", "newsletter", "subscribe", "subscription", "related", "recommended", "search", "sidebar", "side", "footer", "masthead", "overlay", "skip"}
HINTS = {"share", "sharing", "social", "promoted", "popular", "trending"}
LAYOUT = {"box", "bar", "wrap", "wrapper", "container", "inner", "outer", "block", "section", "list", "area", "unit", "slot", "widget", "panel", "item", "items", "links", "link", "buttons", "button", "top", "bottom", "left", "right", "main", "site", "page", "post", "up", "form", "row", "col", "column", "header", "text", "message", "thread", "the"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form"}
#: Evidence by names: none, a doubt, likely (a short or link-dense container goes), sure.
NONE, DOUBT, PROBABLE, RULED = 0, 1, 2, 3
#: Words up to which a likely container is a notice, and the share of its characters in links from which it is a list of links.
NOTICE_WORDS, LINK_SHARE = 40, 0.5
#: Containers that such names may rule out or put in doubt within an article.
HOLDERS = {"div", "section", "article", "ul", "ol", "table", "figure"}
#: What a block is: text of an article, undecided outside of one, in doubt within one.
TEXT, LOOSE, DOUBTED = 0, 1, 2
_MAIN = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)


def evidence(attributes: str) -> int:
    """What the names in an element's attributes say. A name counts in full if all its words are telling or of layout (`cookie-consent`, `ad-box`), else it raises a doubt (`search-guide`); an id, which may be an anchor into the text, raises no more than a doubt but for comments."""
    level = NONE
    for m in _NAMES.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "role":
            level = max(level, RULED if value.strip().lower() in ROLES else NONE)
            continue
        for name in [value] if kind == "aria-label" else value.split():
            words = [w.lower() for w in _WORD.findall(name)]
            telling = [w for w in words if w in SURE or w in LIKELY or w in HINTS]
            if not telling:
                continue
            if all(w in HINTS for w in telling) or not all(w in SURE or w in LIKELY or w in HINTS or w in LAYOUT or w.isdigit() for w in words):
                level = max(level, DOUBT)
            elif kind == "id":
                level = max(level, RULED if words[0] in ("comments", "disqus") else DOUBT)
            else:
                level = max(level, RULED if any(w in SURE for w in telling) else PROBABLE)
    return level


def blocks(page: str) -> tuple[list[str], list[int]]:
    """Texts of a page's blocks in order, and what each is (TEXT, LOOSE or DOUBTED); what markup rules out is not among them.

    A container of doubtful names is judged when it is whole: one that is likely a notice or the like goes if it is short, and any goes that is mostly links;
    what remains of them is for the suffix array.
    """
    texts: list[str] = []
    kinds: list[int] = []
    boxes: list[int] = []  # of each block: the container with doubtful names that it is in, or -1
    judged: list[list[int]] = []  # of each such container: evidence, characters, characters in links, words
    stack: list[tuple[str, bool, int, int]] = []  # open elements: name, ruled out, what blocks in it are, container
    run: list[str] = []
    links = 0

    def close() -> None:
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text:
                texts.append(text)
                kinds.append(stack[-1][2] if stack else LOOSE)
                boxes.append(stack[-1][3] if stack else -1)
                if boxes[-1] >= 0:
                    judged[boxes[-1]][3] += text.count(" ") + 1

    def said(text: str) -> None:
        run.append(text)
        if stack and stack[-1][3] >= 0:
            n = len("".join(text.split()))
            judged[stack[-1][3]][1] += n
            judged[stack[-1][3]][2] += n * (links > 0)

    junk, at = False, 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not junk:
            said(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        level = evidence(m[4]) if m[4] and not m[2] else NONE
        above = stack[-1] if stack else ("", False, LOOSE, -1)
        if name in INLINE:  # no block of its own; outside an article only ruled-out ones are followed, with those of the same name within
            if name == "a":
                links = max(0, links + (-1 if m[2] else 1))
            if m[2]:
                if stack and stack[-1][0] == name:
                    stack.pop()
            elif above[2] == LOOSE and level == RULED or above[0] == name:
                stack.append((name, junk or above[2] == LOOSE and level == RULED, above[2], above[3]))
            junk = bool(stack) and stack[-1][1]
            continue
        if name == "br":
            run.append(" ")
            continue
        close()
        if name in VOID:
            continue
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        else:
            if name in ENDS_PARAGRAPH and stack and stack[-1][0] == name:
                stack.pop()
                above = stack[-1] if stack else ("", False, LOOSE, -1)
            main = name in ("article", "main") or bool(_MAIN.search(m[4]))
            told = level if name in HOLDERS or above[2] == LOOSE and not main and name not in ("html", "body") else NONE
            bad = above[1] or name in NEVER or name == "header" and above[2] == LOOSE or told == RULED
            kind, box = above[2], above[3]
            if main and kind == LOOSE:
                kind = TEXT
            elif told in (DOUBT, PROBABLE) and not bad:
                kind = DOUBTED if kind == TEXT else kind
                if box < 0 or told > judged[box][0]:
                    box = len(judged)
                    judged.append([told, 0, 0, 0])
            if not m[4].rstrip().endswith("/"):
                stack.append((name, bad, kind, box))
        junk = bool(stack) and stack[-1][1]
    if at < len(page) and not junk:
        said(page[at:])
    close()
    gone = {k for k, (told, chars, linked, words) in enumerate(judged) if told == PROBABLE and words <= NOTICE_WORDS or chars and linked >= LINK_SHARE * chars}
    kept = [k for k, box in enumerate(boxes) if box not in gone]
    return [texts[k] for k in kept], [kinds[k] for k in kept]


def undecided(texts: list[str], kinds: list[int]) -> list[str]:
    """The blocks of a page that are for the suffix array."""
    return [t for t, k in zip(texts, kinds) if k != TEXT]


def main_text(texts: list[str], kinds: list[int], gone: np.ndarray) -> str:
    """The text of a page, given which tokens of its undecided blocks repeat: its article without covered doubtful blocks, else its unique runs."""
    article, at, kept = any(k != LOOSE for k in kinds), 0, []
    for text, kind in zip(texts, kinds):
        if kind == TEXT:
            kept.append(text)
            continue
        n = text.count(" ") + 1
        if article == (kind == DOUBTED):
            kept += unique_runs([text], gone[at : at + n])
        at += n
    return "\n\n".join(kept)


def repeated(streams: list[list[str]], run: int = RUN, pages: int = PAGES) -> list[np.ndarray]:
    """For each page's tokens, whether a run of that many tokens that occurs on that many distinct pages covers them."""
    ids = {t: k for k, t in enumerate(dict.fromkeys(t for s in streams for t in s))}
    n = sum(len(s) + 1 for s in streams)
    text, page, at = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for k, s in enumerate(streams):
        text[at : at + len(s)] = [ids[t] for t in s]
        text[at + len(s)] = len(ids) + k  # parts pages; occurs once, so no run crosses it
        page[at : at + len(s) + 1] = k
        at += len(s) + 1
    rank = np.unique(text, return_inverse=True)[1]
    covered = np.zeros(n + 1, np.int64)
    length, suffixes = 1, np.argsort(rank, kind="stable")
    while length < run:  # suffixes sorted by their first `length` tokens; equal ones share a rank
        step = min(length, run - length)
        ahead = np.full(n, -1)
        ahead[: max(n - step, 0)] = rank[step:]
        suffixes = np.lexsort((ahead, rank))
        new = (np.diff(rank[suffixes], prepend=-1) != 0) | (np.diff(ahead[suffixes], prepend=-2) != 0)
        rank = np.empty(n, np.int64)
        rank[suffixes] = np.cumsum(new) - 1
        length += step
    pairs = np.unique(rank * len(streams) + page) // max(len(streams), 1)
    common = np.bincount(pairs, minlength=n)[rank] >= pages
    where = np.flatnonzero(common)
    np.add.at(covered, where, 1)
    np.add.at(covered, np.minimum(where + run, n), -1)
    mask = np.cumsum(covered[:n]) > 0
    ends = np.cumsum([len(s) + 1 for s in streams])
    return [mask[e - len(s) - 1 : e - 1] for s, e in zip(streams, ends)]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [blocks(t) for t in texts_of(b, "html")]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in found], pa.list_(pa.string())), pa.array([x[1] for x in found], pa.list_(pa.int8()))], ["id", "url", "texts", "kinds"])


def unique_runs(page: list[str], gone: np.ndarray, run: int = RUN) -> list[str]:
    """The blocks of a page without covered ones and without covered runs within one; a run that only touches a block leaves it whole."""
    at, kept = 0, []
    for block in page:
        words = block.split(" ")
        mask = gone[at : at + len(words)]
        at += len(words)
        if mask.all():
            continue
        step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)):
            if b - a < run:
                mask[a:b] = False
        kept.append(" ".join(w for w, g in zip(words, mask) if not g))
    return kept


def _thinned(pdf: pd.DataFrame) -> pd.DataFrame:
    streams = [[t for block in undecided(texts, kinds) for t in block.split(" ")] for texts, kinds in zip(pdf.texts, pdf.kinds)]
    text = [main_text(list(texts), list(kinds), gone) for texts, kinds, gone in zip(pdf.texts, pdf.kinds, repeated(streams))]
    return pd.DataFrame({"id": pdf.id, "url": pdf.url, "text": text})


def _digests(page: list[str], run: int = RUN) -> list[bytes]:
    """A 128-bit digest of each run of that many tokens of a page."""
    tokens = " ".join(page).encode().split(b" ") if page else []
    return [hashlib.blake2b(b" ".join(tokens[k : k + run]), digest_size=16).digest() for k in range(len(tokens) - run + 1)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct runs of each page (host, page, html)."""
    for b in batches:
        for host, page, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b, "html")):
            found = [*dict.fromkeys(_digests(undecided(*blocks(text))))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(found), pa.string()), pa.array([page] * len(found), pa.string()), pa.array(found, pa.binary())], ["host", "page", "run"])


def _without_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of pages (id, url, html, runs) without the tokens that any of these runs covers."""
    for b in batches:
        out = []
        for html, runs in zip(texts_of(b, "html"), b.column(3).to_pylist()):
            texts, kinds = blocks(html)
            stream = undecided(texts, kinds)
            gone = np.zeros(sum(block.count(" ") + 1 for block in stream), bool)
            if runs:
                common = set(runs)
                for k, d in enumerate(_digests(stream)):
                    if d in common:
                        gone[k : k + RUN] = True
            out.append(main_text(texts, kinds, gone))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["id", "url", "text"])


def _large_hosts(pages: DataFrame, kind: str) -> DataFrame:
    """id, url and text of pages (id, url, html, host) of hosts too large for one suffix array, by the runs on PAGES pages of a host."""
    pages = pages.withColumn("page", F.sha2(F.concat_ws("|", F.hex("host"), F.coalesce("html", F.lit(""))), 256))
    runs = pages.select("host", "page", "html").mapInArrow(in_task(_runs), "host string, page string, run binary")
    common = runs.groupBy("host", "run").agg(F.count("*").alias("n")).where(F.col("n") >= PAGES).select("host", "run", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = runs.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int"))
    marks = salted.join(common, ["host", "run", "salt"]).groupBy("page").agg(F.collect_set("run").alias("runs"))
    return pages.join(marks, "page", "left").select("id", "url", "html", "runs").mapInArrow(in_task(_without_runs), f"id {kind}, url string, text string")


def html_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col and text (blocks joined by two line feeds, empty if none) of every row of pages.

    Null or empty html gives an empty text; null ids and urls stay null (pages without a url are one host); repeated rows are
    distinct pages; an empty table gives no rows; other columns are not read. Inside an article or main container a block stays,
    however often it repeats, unless its container's name puts it in doubt and PAGES pages of the host hold it; of pages without
    one all blocks are thinned out so.
    """
    kind = dict(pages.dtypes)[id_col]
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    # hosts are told apart before their pages are parsed, so that pages of small hosts are parsed once, into the shuffle by host
    large = materialize(source.groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.sum(F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")).alias("bytes")).where((F.col("pages") > SHARD) | (F.col("bytes") > SHARD_BYTES)).drop("bytes"))
    hosts, named = large.count(), source.withColumn("host", host)
    if hosts <= BROADCAST_HOSTS:
        named = named.join(F.broadcast(large), "host", "left")
    else:
        named = named.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
        named = named.join(large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")
    small = named.where("pages is null").select("id", "url", "html")
    read = small.mapInArrow(in_task(_read), f"id {kind}, url string, texts array<string>, kinds array<tinyint>").withColumn("host", host)
    thin = read.groupBy("host").applyInPandas(_thinned, f"id {kind}, url string, text string")
    if hosts:
        thin = thin.unionByName(_large_hosts(named.where("pages is not null").select("id", "url", "html", "host"), kind))
    return thin.withColumnsRenamed({"id": id_col, "url": url_col})


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's text of all pages."""
    return html_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op10_html_text": op10_html_text}
ORACLES: dict[str, str] = {}
