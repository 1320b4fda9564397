"""Main text of web pages by wrapper induction.

Every page becomes a folded tree: sibling elements of the same tag, classes and id in one run share a node. A
few pages of each host are references; every page is aligned with them by simple tree matching, and each
text block is counted at the reference node it falls on. A block that most pages of the host have at the
same node is template; what varies is content. Elements that say they are menus, notices, adverts, forms and
the like are left out by name, unless they hold the article, the main part or most of the page's text; where a
page marks its article or main part only that part counts.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkfield.llm.common import Scratch

REFERENCES = 3
#: Wrappers of up to so many hosts and bytes are broadcast; more are joined by a shuffle.
BROADCAST_HOSTS, BROADCAST_BYTES = 20_000, 32 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I) for tag in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_LEFT_OUT = frozenset("head script style noscript template nav footer aside button select option textarea iframe svg math object video audio canvas dialog menu input title".split())
_NAMES = frozenset("""ad ads advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo promotion cookie cookies consent gdpr notice
 newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus respond related
 recommended recommendations share sharing social popup modal overlay widget pagination pager toolbar""".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
_CLOSES_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
 header hgroup hr main menu nav ol p pre search section table ul""".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("article section div body html main table td th ul ol dl nav aside footer header form blockquote".split())


class Folded:
    """A node of the folded tree; ``runs`` numbers repeated runs of one label among its children."""

    __slots__ = ("at", "tag", "sign", "kids", "by_key", "runs", "last")

    def __init__(self, at: int, tag: str, sign: str):
        self.at, self.tag, self.sign, self.kids = at, tag, sign, []
        self.by_key, self.runs, self.last = {}, {}, None

    def shape(self) -> list:
        return [self.at, self.tag, self.sign, [k.shape() for k in self.kids]]


def _sign(attrs: str) -> tuple[str, bool, bool, bool]:
    """Classes and id in order; whether the element is out by role or hidden, or by name, or is the main part."""
    if "=" not in attrs:
        return "", " hidden" in attrs, False, False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    sign = f"{found.get('class', '')}#{found.get('id', '')}".lower()
    words = set(re.split(r"[^a-z]+", sign))
    role = found.get("role", "").lower()
    named = bool(words & _NAMES) or role == "form"
    left = role in _ROLES or found.get("aria-hidden") == "true" or " hidden" in attrs
    if re.search(r"display\s*:\s*none", found.get("style", "")):
        left = True
    return re.sub(r"\d+", "0", sign) if sign != "#" else "", left, named, role == "main"


def _summed(sizes: list[int], parents: list[int]) -> list[int]:
    """Sizes with those of all elements inside; outer elements come before inner ones."""
    for i in range(len(sizes) - 1, -1, -1):
        if parents[i] >= 0:
            sizes[parents[i]] += sizes[i]
    return sizes


def _kept(blocks: list[tuple[int, int, int, str]], named: list[int], parts: list[tuple[int, int, str]]) -> tuple[list[bool], bool]:
    """Which blocks ``(folded node, innermost named element, innermost part, text)`` may be content, and whether a part marks them.

    ``named`` has the outer named element of each; ``parts``, articles and main parts, have the outer part, the innermost
    named element (their own too) and the tag.
    """
    name_size, part_size, total = [0] * len(named), [0] * len(parts), sum(len(t) for *_, t in blocks)
    outer = [p[0] for p in parts]
    for _, name, part, text in blocks:
        if name >= 0:
            name_size[name] += len(text)
        if part >= 0:
            part_size[part] += len(text)
    held = [2 * size > total for size in _summed(name_size, named)]  # most of the page's text
    part_size = _summed(part_size, outer)
    filled = [i for i, size in enumerate(part_size) if size]

    def settle() -> tuple[list[bool], list[bool]]:
        """Named elements that stay, and parts that do, themselves or inside one; the last entry is for none (-1)."""
        free, good = [True] * (len(named) + 1), [False] * (len(parts) + 1)
        for i, up in enumerate(named):
            free[i] = held[i] and free[up]
        for i, (up, name, _) in enumerate(parts):
            good[i] = bool(part_size[i]) and free[name] or good[up]
        return free, good

    free, good = settle()
    if filled and not any(good):
        # No part outside named elements: the main part, the only one, or one longer than the text outside counts.
        outside = sum(len(t) for _, name, _, t in blocks if free[name])
        mains = [i for i in filled if parts[i][2] == "main"]
        longest = max(mains or filled, key=lambda i: part_size[i])
        if mains or len(filled) == 1 or part_size[longest] > outside:
            name = parts[longest][1]
            while name >= 0:
                held[name], name = True, named[name]
            free, good = settle()
    marked = any(good)
    return [free[name] and (not marked or good[part]) for _, name, part, _ in blocks], marked


def read_page(page: str) -> tuple[list[tuple[int, str]], list, bool]:
    """Blocks ``(folded node, text)`` that may be content, the folded tree, and whether an article marks them."""
    root = Folded(0, "", "")
    count = 1
    stack = [("", root, False, -1, -1)]  # tag, folded node, left out, innermost named element and article
    blocks: list[tuple[int, int, int, str]] = []
    names: list[int] = []
    articles: list[tuple[int, int, str]] = []
    parts: list[str] = []
    place = (0, -1, -1)

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                blocks.append((*place, text))
            parts = []

    def text_of(text: str) -> None:
        nonlocal place
        tag, node, left, name, article = stack[-1]
        if left:
            return
        depth = len(stack) - 1
        while depth and stack[depth][0] in _INLINE:
            depth -= 1
        spot = (stack[depth][1].at, name, article)
        if spot != place:
            flush()
            place = spot
        parts.append(text)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text_of(page[at:])
            break
        if m.start() > at:
            text_of(page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    if any(t not in _INLINE for t, *_ in stack[depth:]):
                        flush()
                    del stack[depth:]
                    break
                if tag in _INLINE and stack[depth][0] not in _INLINE or tag not in _SCOPE and stack[depth][0] in _SCOPE:
                    break
            continue
        if tag in _VOID:
            if tag == "br" or tag == "hr":
                if parts:
                    parts.append(" ")
                if tag == "hr":
                    flush()
            continue
        if tag in _RAW:
            stop = _RAW[tag].search(page, at)
            at = stop.end() if stop else end
            continue
        if tag not in _INLINE:
            flush()
            ends = _SAME.get(tag, ("p",) if tag in _CLOSES_P else ())
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in ends:
                    del stack[depth:]
                    break
                if stack[depth][0] in _SCOPE:
                    break
        _, parent, left, name, article = stack[-1]
        sign, hidden, named, main = _sign(m["attrs"])
        main = main or tag == "main"
        out = left or tag in _LEFT_OUT or (hidden and tag not in ("html", "body")) or (tag == "header" and article < 0)
        if not out and tag not in ("html", "body") and not main and (named or tag == "form"):
            names.append(name)
            name = len(names) - 1
        if not out and (main or tag == "article"):
            articles.append((article, name, "main" if main else tag))
            article = len(articles) - 1
        label = (tag, sign)
        if parent.last != label:
            parent.runs[label] = min(parent.runs.get(label, 0) + 1, 3)
            parent.last = label
        key = (label, parent.runs[label])
        node = parent.by_key.get(key)
        if node is None:
            node = parent.by_key[key] = Folded(count, tag, sign)
            parent.kids.append(node)
            count += 1
        if m["attrs"].endswith("/") and tag not in _CLOSES_P and tag not in _INLINE:
            continue
        stack.append((tag, node, out, name, article))
    flush()
    kept, marked = _kept(blocks, names, articles)
    return [(n, t) for (n, _, _, t), keep in zip(blocks, kept) if keep], root.shape(), marked


def align(a: list, b: list) -> tuple[float, list[tuple[int, int]]]:
    """Simple tree matching of two trees: the weight of the best ordered matching and its node pairs."""
    if a[1] != b[1]:
        return 0.0, []
    left, right = a[3], b[3]
    best = [[0.0] * (len(right) + 1) for _ in range(len(left) + 1)]
    pairs = {}
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            weight, own = align(x, y)
            if weight:
                pairs[i, j] = weight, own
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight)
    found, i, j = [(a[0], b[0])], len(left), len(right)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found += pairs[i, j][1]
    return 1.0 + (a[2] == b[2]) + best[-1][-1], found


class Aligner:
    """Places of a page's nodes in the best reference, remembered by the two shapes."""

    def __init__(self):
        self.known: dict[tuple[str, str], tuple[float, dict[int, int]]] = {}

    def best(self, shape: list, references: list[tuple[int, str]]) -> tuple[int, dict[int, int]]:
        own, top, choice, places = json.dumps(shape), -1.0, -1, {}
        for number, other in references:
            if (own, other) not in self.known:
                if len(self.known) > 4000:
                    self.known.clear()
                weight, pairs = align(shape, json.loads(other))
                self.known[own, other] = weight, dict(pairs)
            weight, pairs = self.known[own, other]
            if weight > top:
                top, choice, places = weight, number, pairs
        return choice, places


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shapes = [json.dumps(read_page(p.as_py())[1]) for p in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shapes, pa.string())], ["host", "number", "shape"])


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _references(value) -> list[tuple[int, str]]:
    return [(r["number"], r["shape"]) for r in value or []]


def _found_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page with text: its reference (node -1), and the blocks at each node once; ``copy`` is equal for pages of equal content."""
    aligner = Aligner()
    for batch in batches:
        rows = []
        for host, page, wrappers in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            blocks, shape, marked = read_page(page.as_py())
            number, places = aligner.best(shape, _references(wrappers))
            if blocks:
                copy = _hash("\n".join(t for _, t in blocks))
                rows.append((host, number, copy, -1, 0))
                rows += {(host, number, copy, places[n], _hash(t)) for n, t in blocks if n in places}
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))],
            ["host", "number", "copy", "node", "text"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    aligner = Aligner()
    for batch in batches:
        texts = []
        for page, wrappers in zip(batch.column(2), batch.column(3).to_pylist()):
            blocks, shape, _ = read_page(page.as_py())
            number, places = aligner.best(shape, _references(wrappers))
            fixed = next(({(c["node"], c["text"]) for c in w["fixed"] or []} for w in wrappers or [] if w["number"] == number), set())
            own = [t for n, t in blocks if not fixed or (places.get(n), _hash(t)) not in fixed]
            texts.append(" ".join(own or [t for _, t in blocks]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page", "url", "text"])


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 least_pages: int = 5, share: float = 0.6) -> DataFrame:
    """``<id>, <url>, text`` for every page.

    A block is template when at least ``least_pages`` pages (all, if there are two to four) and ``share`` of those aligned
    with the same reference have it at the same node. Pages of equal content count once, so copies make no
    template, and a page that is all template keeps its text. Hosts of few pages have one reference. Null pages give an empty text; pages
    without a url form a host of their own. Repeated rows are extracted each; other columns are ignored.
    """
    host = F.lower(F.coalesce(F.regexp_extract(url_col, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(html_col, F.lit("")).alias("html"),
                        F.xxhash64(id_col, url_col).alias("draw"))
    rows = rows.withColumn("number", F.pmod("draw", F.lit(REFERENCES)).cast("int"))
    chosen = rows.groupBy("host", "number").agg(F.min("draw").alias("draw"), F.count("*").alias("n"))
    own = Window.partitionBy("host")  # REFERENCES rows at most
    chosen = chosen.select("host", "number", "draw", F.sum("n").over(own).alias("all"), F.min("number").over(own).alias("first"))
    chosen = chosen.where((F.col("all") >= REFERENCES * least_pages) | (F.col("number") == F.col("first"))).drop("all", "first")
    few = chosen.limit(BROADCAST_HOSTS * REFERENCES + 1).count() <= BROADCAST_HOSTS * REFERENCES
    sized = lambda df: F.broadcast(df) if few else df
    shapes = rows.join(sized(chosen), ["host", "number", "draw"]).select("host", "number", "html").mapInArrow(
        _shapes, "host string, number int, shape string").groupBy("host", "number").agg(F.min("shape").alias("shape"))
    scratch = Scratch(pages.sparkSession)
    shapes = scratch.keep(shapes, "shapes")
    few = few and (shapes.agg(F.sum(F.length("shape"))).first()[0] or 0) <= BROADCAST_BYTES
    references = shapes.groupBy("host").agg(F.collect_list(F.struct("number", "shape")).alias("wrappers"))  # REFERENCES at most
    found = rows.select("host", "html").join(sized(references), "host", "left").mapInArrow(
        _found_blocks, "host string, number int, copy long, node int, text long").distinct()
    counts = scratch.keep(found.groupBy("host", "number", "node", "text").agg(F.count("*").alias("n"))
                          .where((F.col("n") >= 2) | (F.col("node") == -1)), "blocks")
    totals = counts.where("node = -1").select("host", "number", F.col("n").alias("pages"))
    fixed = counts.where("node >= 0").join(totals, ["host", "number"]).where(
        F.col("n") >= F.greatest(F.least(F.lit(least_pages), "pages"), F.col("pages") * share))
    fixed = fixed.groupBy("host", "number").agg(F.collect_list(F.struct("node", "text")).alias("fixed"))
    wrappers = scratch.keep(shapes.join(fixed, ["host", "number"], "left").groupBy("host").agg(
        F.collect_list(F.struct("number", "shape", "fixed")).alias("wrappers")), "wrappers")
    kind = rows.schema["page"].dataType.simpleString()
    out = rows.select("host", "page", "url", "html").join(sized(wrappers), "host", "left").select("page", "url", "html", "wrappers")
    return out.mapInArrow(_extracted, f"page {kind}, url string, text string").withColumnsRenamed({"page": id_col, "url": url_col})
