"""HTML extraction: nearest-URL page differencing, with markup to veto and to clear what differs.

A page is cut into blocks of text, its lines. Every page is paired with the
page of the nearest URL path on its host, their lines are aligned by longest
common subsequence, and the lines they share are deleted. Markup then has two
says. Blocks of a marked article stay though they are shared, since articles do
repeat on a host. And blocks that no other page shares go if they stand in a
container that is never main text (menus, headers, footers, sidebars, forms,
adverts, notices, reader comments, told by tags, roles and class names) or
outside the article of a page that marks one, since menus and adverts may
differ from page to page. Scripts and styles are no text at all. Every row says
how many blocks each rule took.

Neighbours: distinct (host, path) pairs are sorted over the cluster and
numbered; each page meets the pairs just before and after its own on its host
and takes the one with the longer common beginning (the former at a tie). Of
pages with the same path the smallest page_id stands for all, so copies of one
page are never differenced against each other. Line hashes move to find the
neighbours; then every page's text meets them in one shuffle, for which html is
parsed a second time: that moves and stores less than keeping the text.

Null html is empty text; null or odd URLs have the host "" and what is left as
path. Repeated rows get equal results; very long pages are parsed whole; empty
tables give no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as _html
import os
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, pieces, same, tune

_RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "select", "object", "title")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(" + "|".join(_RAW) + r")\b[^>]*(?:>|\Z)(?:.*?</\1\s*>|.*\Z)|<([!/?]?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)|<[!/?][^>]*(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_SKIP = frozenset("head nav header footer aside form button menu dialog label fieldset audio video canvas figure-caption".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_CLASSES = frozenset("ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice nav navbar navigation menu breadcrumb breadcrumbs sidebar header footer masthead comment comments disqus respond replies share sharing social related recommended newsletter subscribe subscription popup modal overlay widget pagination pager toolbar search login signup copyright".split())
_SPACE = re.compile(r"\s+")


#: Tags of text and its sections: in an article their ids and classes often come from what they are about.
_TEXT = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th label caption figcaption blockquote pre section".split())


def _boilerplate(tag: str, attributes: str, article: bool = False) -> bool:
    """Whether a container is never main text. In an article a text tag is only if a whole class (or a section's whole id) says so: not for one word of it, nor for a heading's id."""
    if tag in _SKIP:
        return not (article and tag == "label")
    if tag in ("html", "body", "main") or not attributes.strip():
        return False
    for name, a, b, c in _ATTR.findall(attributes):
        value, name = (a or b or c).lower(), name.lower()
        if name == "role" and value in _ROLES:
            return True
        if name in ("class", "id"):
            if not (article and tag in _TEXT):
                said = re.split(r"[^a-z]+", value)
            else:
                said = value.split() if name == "class" or tag == "section" else ()
            if not _CLASSES.isdisjoint(said):
                return True
        if name == "aria-hidden" and value == "true":
            return True
    return False


#: What a block is: free, part of a marked article, or inside a container that is never main text.
FREE, ARTICLE, SHELL = 0, 1, 2


def blocks(page: str) -> tuple[list[str], list[int], bool]:
    """(blocks of text, what each is, whether the page marks an article)."""
    out: list[str] = []
    kinds: list[int] = []
    part: list[str] = []
    skip, depth, article, marked, at = "", 0, 0, False, 0

    def end() -> None:
        if part:
            text = _SPACE.sub(" ", _html.unescape("".join(part))).strip()
            part.clear()
            if text:
                out.append(text)
                kinds.append(SHELL if skip else ARTICLE if article else FREE)

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            part.append(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue  # a comment, a declaration or raw text
        closing, attributes = m[2] == "/", m[4] or ""
        if m[2] and not closing:
            continue
        if skip:
            if tag not in _INLINE:
                end()
            if skip == "head" and tag == "body" or skip in ("p", "li") and tag not in _INLINE and tag not in _VOID:
                depth = 0  # it is closed by what follows
            elif tag == skip and not attributes.endswith("/"):
                depth += -1 if closing else 1
            if depth > 0:
                continue
            end()
            skip = ""
            if closing and tag not in ("article", "main"):
                continue
        if tag not in _INLINE:
            end()
        if closing:
            if tag in ("article", "main"):
                article = max(0, article - 1)
            continue
        if tag in _VOID:
            continue
        if _boilerplate(tag, attributes, article > 0) and not (tag == "header" and article):
            end()
            if not attributes.endswith("/"):
                skip, depth = tag, 1
            continue
        if tag in ("article", "main"):
            article, marked = article + 1, True
    if at < len(page):
        part.append(page[at:])
    end()
    return out, kinds, marked


#: Pairs of equal lines up to which their places are listed; beyond, bit vectors give a subsequence of the same length.
LISTED = 1 << 16


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence of a and b, ascending."""
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append(i0)
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append(i1)
        if i0 == i1 or j0 == j1:
            continue
        places: dict[int, list[int]] = {}
        for j in range(j0, j1):
            places.setdefault(b[j], []).append(j)
        if i1 - i0 == 1 or sum(len(places.get(x, ())) for x in a[i0:i1]) <= LISTED:
            out += _listed(a, i0, i1, places)
            continue
        # halves of a, and where b is best parted between them
        mid = (i0 + i1) // 2
        head = _prefix_lengths(a[i0:mid], b[j0:j1])
        tail = _prefix_lengths(a[mid:i1][::-1], b[j0:j1][::-1])[::-1]
        j = j0 + int(np.argmax(head + tail))
        todo += [(i0, mid, j0, j), (mid, i1, j, j1)]
    return sorted(out)


def _listed(a: list[int], i0: int, i1: int, places: dict[int, list[int]]) -> list[int]:
    """Hunt and Szymanski: a longest increasing subsequence over the listed places."""
    ends: list[int] = []
    nodes: list[tuple] = []  # (place in a, previous node)
    top: list[int] = []
    for i in range(i0, i1):
        for j in reversed(places.get(a[i], ())):
            k = bisect_left(ends, j)
            nodes.append((i, top[k - 1] if k else -1))
            if k == len(ends):
                ends.append(j)
                top.append(len(nodes) - 1)
            else:
                ends[k], top[k] = j, len(nodes) - 1
    out, at = [], top[-1] if top else -1
    while at >= 0:
        out.append(nodes[at][0])
        at = nodes[at][1]
    return out


def _prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a and each beginning of b, by one bit a line of b."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        if u := v & masks.get(x, 0):
            v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def parsed(pages: DataFrame, text: bool) -> DataFrame:
    """page_id, url, host, path, hashes of all lines; with text also what each line is, whether the page marks an article, and the lines that may stay."""

    def run(it):
        for b in pieces(it, 2):
            hashes, kinds, marks, lines = [], [], [], []
            for page in b.column(2).to_pylist():
                out, kind, marked = blocks(page or "")
                hashes.append(np.array([_hash(x) for x in out], "<i8").tobytes())
                if text:
                    kinds.append(bytes(kind))
                    marks.append(marked)
                    lines.append([x if k == ARTICLE or k == FREE and not marked else "" for x, k in zip(out, kind, strict=True)])
            more = [pa.array(kinds, pa.binary()), pa.array(marks, pa.bool_()), pa.array(lines, pa.list_(pa.string()))] if text else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hashes, pa.binary()), *more], ["page_id", "url", "hashes", "kinds", "marked", "lines"][: 3 + len(more)])

    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    out = raw.mapInArrow(run, "page_id long, url string, hashes binary" + (", kinds binary, marked boolean, lines array<string>" if text else ""))
    url = F.coalesce("url", F.lit(""))
    return out.withColumns({"host": F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), "path": F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", ""), r"/+$", "")})


def neighbours(table: DataFrame, scratch: Scratch) -> DataFrame:
    """host, path, and (path, hashes) of the pages before and after in the order of (host, path)."""
    ones = table.groupBy("host", "path").agg(F.min_by("hashes", F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("hashes"))
    ordered = ones.repartitionByRange("host", "path").sortWithinPartitions("host", "path")

    def number(it):
        part, n = TaskContext.get().partitionId(), 0
        for b in it:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int64)), pa.array(np.arange(n, n + b.num_rows))], ["host", "path", "hashes", "part", "place"])
            n += b.num_rows

    ordered = scratch.save(ordered.mapInArrow(number, "host string, path string, hashes binary, part long, place long"))
    # one number a partition: as many rows as there were partitions
    sizes = sorted((r.part, r.n) for r in ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    offset, base = [], 0
    for part, n in sizes:
        offset.append((part, base))
        base += n
    offsets = table.sparkSession.createDataFrame(offset or [(0, 0)], "part long, base long")
    at = ordered.join(F.broadcast(offsets), "part").select("host", "path", "hashes", (F.col("base") + F.col("place")).alias("at"))
    before, after = (at.select((F.col("at") + d).alias("at"), F.col("host").alias("h"), F.struct("path", "hashes").alias(n)) for d, n in ((1, "before"), (-1, "after")))
    out = at.join(before, "at", "left").withColumn("before", F.when(F.col("h") == F.col("host"), F.col("before"))).drop("h")
    out = out.join(after, "at", "left").withColumn("after", F.when(F.col("h") == F.col("host"), F.col("after"))).drop("h")
    return out.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "before", "after")


def kept_lines(lines: list[str], kinds: bytes, marked: bool, shared: set[int]) -> tuple[list[str], int, int, int]:
    """(lines that stay, number of lines that differencing, markup took; number of shared lines that an article kept)."""
    out, differenced, by_markup, vetoed = [], 0, 0, 0
    for i, (line, kind) in enumerate(zip(lines, kinds, strict=True)):
        if kind == ARTICLE:
            vetoed += i in shared
            out.append(line)
        elif i in shared:
            differenced += 1
        elif kind == SHELL or marked:
            by_markup += 1
        else:
            out.append(line)
    return out, differenced, by_markup, vetoed


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, and the numbers of kept_lines()."""
    scratch, work = Scratch(pages.sparkSession), Scratch(pages.sparkSession)
    near = scratch.save(neighbours(work.save(parsed(pages, False)), work))
    work.close()
    scratch.free()
    pairs = parsed(pages, True).join(near, same(F.col("host"), F.col("_host")) & same(F.col("path"), F.col("_path")), "left")

    def run(it):
        for b in pieces(it, 1):
            rows = []
            for path, own, kinds, marked, lines, x, y in zip(*(b.column(i).to_pylist() for i in range(2, 9)), strict=True):
                alike = lambda z, path=path: -1 if z is None else len(os.path.commonprefix([path, z["path"]]))
                other, shared = x if alike(x) >= alike(y) else y, set()
                if other is not None:
                    shared = set(common_lines(*(np.frombuffer(h, "<i8").tolist() for h in (own, other["hashes"]))))
                out, *counts = kept_lines(lines, kinds, marked, shared)
                rows.append((" ".join(out), *counts))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(cols[0]), pa.string()), *(pa.array(list(c), pa.int64()) for c in cols[1:])], ["page_id", "url", "text", "n_differenced", "n_by_markup", "n_vetoed"])

    out = pairs.select("page_id", "url", "path", "hashes", "kinds", "marked", "lines", "before", "after").mapInArrow(run, "page_id long, url string, text string, n_differenced long, n_by_markup long, n_vetoed long")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_differenced", "n_by_markup", "n_vetoed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(tune(spark).read.parquet(f"{sf_dir}/pages.parquet"))
