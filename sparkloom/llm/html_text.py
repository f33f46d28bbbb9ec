"""Main text of web pages by wrappers inferred per host: union-free regular expressions over tag and text streams.

1. A page is its stream of block tags and texts, read as nested groups; tags that only style text don't count.
2. Pages of one host are aligned one after another: groups that both have, in order (those of the same text first), are aligned inside in turn; a group that
   one side lacks becomes optional; neighbours of one kind become one repeated group; a text that is the same on all pages stays what it is, one
   that differs becomes a slot. No unions arise, and the wrapper says what any page of the host may look like.
3. What differs from page to page is the article, what stays is the template: the wrapper's article is the group marked as such that has slots, else
   the group that most of the text in slots is under. Menus, forms and the like are told by their tags; words in class, id or role
   choose between groups, but take nothing out of an article unless it is the same on all pages, or names adverts or comments.
4. Each page is read by its host's wrapper: the texts under the article's path are decoded and joined. Where no group is marked,
   groups (not paragraphs, lists and the like) beside the article whose text is the same on all pages are left out.

Every task aligns its own pages of each host; the wrappers that come of it are aligned in three rounds of salted groups, so a host with very
many pages is no long task. Wrappers are joined to pages by host as Spark sees fit. A host with one page, or copies of one, has no
slots: then all of its text counts. The order of alignment follows the partitions; what all pages share doesn't depend on it.

Edge cases: a null page is empty; a null or odd URL has the host ""; a page that doesn't have its wrapper's article path is read by its own
wrapper; unclosed and cut-off tags, comments and scripts end with the page; groups over ``DEPTH`` deep are
text of the group at that depth, as in browsers; no pages give no rows.
"""

from __future__ import annotations

import html
import json
import re
import sys
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import staged

#: Attributes as browsers read them: a quote counts after an equals sign alone, elsewhere it is part of a name. Nothing is tried twice.
_ATTRIBUTES = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+|(?=>)))?+)*+"""
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|[^<]++|<""", re.S)
#: Elements that hold no text of the page, up to their closing tag; the first two to the page's end without one.
SWALLOWED = tuple("script style noscript template svg iframe textarea select".split())
_CLOSING = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in SWALLOWED}
_MARK = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")

#: HTML's inline, void and paragraph-ending elements.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
ENDS_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What isn't part of an article, by tag. A header is, within an article.
OUTSIDE_TAGS = set("head title nav footer aside form button dialog menu fieldset".split())
#: Words of class, id or role that say the same; those of STRONG_WORDS within an article too.
STRONG_WORDS = set("ad ads adv advert adverts advertisement advertising sponsored sidebar navbar breadcrumb breadcrumbs comment comments disqus cookie cookies gdpr".split())
OUTSIDE_WORDS = STRONG_WORDS | set("banner sponsor promo promotion menu menubar nav navigation footer masthead topbar discussion replies consent notice notices popup modal overlay newsletter subscribe signup login search share sharing social related recommended widget toolbar pager pagination alert complementary contentinfo".split())
#: HTML's own groups, which a slash at the end of the tag doesn't close.
CLOSED_BY_TAG = ENDS_P | set(ENDS_SELF) | OUTSIDE_TAGS | set("html body".split())
#: Never told to be outside by words; ids of the latter only name a place.
KEPT_TAGS = set("html body main article".split())
NAMED_BY_ID = set("h1 h2 h3 h4 h5 h6 section".split())
ARTICLE_WORDS = {"article", "articlebody", "post", "entry", "story", "main", "content"}
#: Groups of running text: neighbours of one kind are one repeated group, whatever they say.
RUNNING = set("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd tr td th table tbody thead tfoot pre blockquote option figure figcaption hr #".split())
#: Groups within groups that a page can have, as in browsers; pairs of children up to which the best alignment is worked out.
DEPTH, PAIRS = 512, 40_000
sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
#: Wrappers that a task holds at once.
HELD = 2000

Node = list  # [key, children, characters of text directly inside, optional, repeated, literal]; a text's key is "#"; literal: hash of all its text, 0 if it differs


def _key(tag: str, attributes: str) -> str:
    """The tag, and the words of its class, id, role or itemprop."""
    words = {w for m in _MARK.finditer(attributes) if m[1].lower() != "id" or tag not in NAMED_BY_ID for w in _NAME.findall((m[2] or m[3] or m[4] or "").lower())} if attributes else ()
    return ".".join([tag, *sorted(words)]) if words else tag


def outside(key: str, within: bool = False) -> bool:
    """Whether a group is not part of an article; ``within``: that it lies in."""
    tag, *words = key.split(".")
    if tag in OUTSIDE_TAGS or tag == "header" and not within:
        return True
    return tag not in KEPT_TAGS and not (STRONG_WORDS if within else OUTSIDE_WORDS).isdisjoint(words)


def parse(page: str) -> Iterator[tuple[str, str]]:
    """("open", key), ("close", key) and ("text", raw) of a page, nested properly whatever the page does; line breaks are ("text", " ")."""
    stack: list[tuple[str, str]] = []  # tag, key
    held: Counter[str] = Counter()

    def close() -> tuple[str, str]:
        tag, key = stack.pop()
        held[tag] -= 1
        return tag, key

    at, unclosed = 0, set()
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                yield "text", m[0]
            continue
        tag = tag.lower()
        if tag in INLINE:
            continue
        if tag in SWALLOWED and not m[1] and tag not in unclosed and not (m[3].endswith("/") and tag not in ("script", "style")):
            end = _CLOSING[tag].search(page, at)
            if end or tag in ("script", "style"):
                at = page.find(">", end.end() - 1) + 1 or len(page) if end else len(page)
                continue
            unclosed.add(tag)  # nor is a later one closed
        if tag in VOID or m[3].endswith("/") and tag not in CLOSED_BY_TAG:
            yield "text", " "
            continue
        if m[1]:
            while held[tag]:
                top, key = close()
                yield "close", key
                if top == tag:
                    break
            continue
        if tag in ENDS_P:
            while held["p"]:
                yield "close", close()[1]
        elif stack and stack[-1][0] in ENDS_SELF.get(tag, ()):
            cell = close()
            yield "close", cell[1]
            if tag == "tr" and cell[0] != "tr" and stack and stack[-1][0] == "tr":
                yield "close", close()[1]
        key = _key(tag, m[3])
        stack.append((tag, key))
        held[tag] += 1
        yield "open", key
    while stack:
        yield "close", close()[1]


def _literal(parts: list[int]) -> int:
    """What stands for a group's text: a hash of those of its parts; without any, or of one alone, that one."""
    return parts[0] if len(parts) == 1 else xxhash.xxh64_intdigest(",".join(map(str, parts))) >> 1 | 1


def read(page: str) -> Iterator[tuple[str, str, int]]:
    """As ``parse``, but with texts between tags together (those of white space left out), and with the literal of texts and closed groups."""
    parts: list[list[int]] = [[]]
    run: list[str] = []
    for what, value in parse(page):
        if what == "text":
            run.append(value)
            continue
        if run:
            text = "".join(run)
            run = []
            if bare := text.strip():
                parts[-1].append(xxhash.xxh64_intdigest(bare) >> 1 | 1)
                yield "text", text, parts[-1][-1]
        if what == "open":
            parts.append([])
            yield what, value, 0
        else:
            literal = _literal(parts.pop())
            parts[-1].append(literal)
            yield what, value, literal
    if bare := "".join(run).strip():
        yield "text", "".join(run), xxhash.xxh64_intdigest(bare) >> 1 | 1


def shape(page: str) -> Node:
    """The page's own wrapper: one group without a name over all."""
    root: Node = ["", [], 0, False, False, 0]
    path = [root]
    deeper = 0  # groups below DEPTH
    for what, value, literal in read(page):
        if what == "open":
            if deeper or len(path) > DEPTH:
                deeper += 1
            else:
                path.append([value, [], 0, False, False, 0])
        elif what == "close":
            if deeper:
                deeper -= 1
                continue
            done = path.pop()
            done[1], done[5] = fold(done[1]), literal
            path[-1][1].append(done)
        else:
            path[-1][1].append(["#", [], len(value.strip()), False, False, literal])
    root[1] = fold(root[1])
    root[5] = _literal([c[5] for c in root[1]])
    return root


def _alike(a: Node, b: Node) -> bool:
    """Whether two neighbours are one repeated group: of running text, or both with slots."""
    return a[0] == b[0] and (a[0].partition(".")[0] in RUNNING or not a[5] and not b[5])


def fold(children: list[Node]) -> list[Node]:
    """Like neighbours as one repeated group; the same for runs of two unlike groups (terms and their texts, rows and rules)."""
    out: list[Node] = []
    for c in children:
        if out and _alike(out[-1], c):
            out[-1] = merge(out[-1], c)
            out[-1][4] = True
        elif len(out) >= 3 and _alike(out[-3], out[-1]) and _alike(out[-2], c):
            out[-3], out[-2] = merge(out[-3], out[-1]), merge(out[-2], c)
            out[-3][4] = out[-2][4] = True
            out.pop()
        else:
            out.append(c)
    return out


def _worth(c: Node, d: Node) -> int:
    return (2 + (c[5] == d[5] != 0)) if c[0] == d[0] else 0


def _pairs(x: list[Node], y: list[Node]) -> Iterator[tuple[int, int]]:
    """Children of either side that are aligned, in order: the best alignment, or where there are very many children, each with the next of its kind."""
    start, end = 0, 0
    while start < min(len(x), len(y)) and _worth(x[start], y[start]) == 3:
        yield start, start
        start += 1
    while end < min(len(x), len(y)) - start and _worth(x[-1 - end], y[-1 - end]) == 3:
        end += 1
    x, y = x[start : len(x) - end], y[start : len(y) - end]
    if len(x) * len(y) > PAIRS:
        places: dict[tuple, deque[int]] = defaultdict(deque)
        for j, d in enumerate(y):
            places[d[0]].append(j)
        least = 0
        for i, c in enumerate(x):
            of = places[c[0]]
            while of and of[0] < least:
                of.popleft()
            if of:
                least = of.popleft() + 1
                yield start + i, start + least - 1
    else:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                fit = _worth(x[i], y[j])
                best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + fit if fit else 0)
        i = j = 0
        while i < len(x) and j < len(y):
            fit = _worth(x[i], y[j])
            if fit and best[i][j] == best[i + 1][j + 1] + fit:
                yield start + i, start + j
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    for k in range(end):
        yield start + len(x) + k, start + len(y) + k


def merge(a: Node, b: Node) -> Node:
    """The least wrapper of one kind of group that has both: children aligned in order, the rest optional."""
    literal = a[5] if a[5] == b[5] else 0
    if literal and not a[4] and not b[4] or a[0] == "#":
        return [a[0], a[1], a[2] + b[2], a[3] or b[3], a[4] or b[4], literal]
    x, y = a[1], b[1]
    out, i, j = [], 0, 0
    optional = lambda c: [*c[:3], True, *c[4:]]
    for p, q in [*_pairs(x, y), (len(x), len(y))]:
        out += map(optional, [*x[i:p], *y[j:q]])
        if p < len(x):
            out.append(merge(x[p], y[q]))
        i, j = p + 1, q + 1
    return [a[0], fold(out), a[2] + b[2], a[3] or b[3], a[4] or b[4], literal]


def expression(node: Node) -> str:
    """The wrapper as a regular expression over tags, ``#`` being a text slot and ``=`` a text that all pages share: groups with ``?`` are optional, with ``+`` repeated."""
    tag = node[0].split(".")[0]
    inner = ("=" if node[5] else "#") if tag == "#" else (f"<{node[0]}>" if tag else "") + "".join(map(expression, node[1])) + (f"</{tag}>" if tag else "")
    mark = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[bool(node[3]), bool(node[4])]
    return f"({inner}){mark}" if mark and tag != "#" else inner


def _has_text(node: Node) -> bool:
    return node[0] == "#" or any(map(_has_text, node[1]))


class Reading:
    """Where a wrapper's article is: ``paths`` (keys joined by spaces) of its groups, and of those under them that stay against their words;
    ``drops``: literals and paths of groups in it that are the template's; ``marked``: whether the page says so itself."""

    def __init__(self, root: Node):
        self.root = root
        self.spared: set[str] = set()
        self.differs = not root[5]
        self.differs = self.differs and self.mass(root, "") > 0
        self._spare()
        self.paths, self.marked = self._article()
        self.drops: set[str] = set()
        if self.differs:
            self._template(root, "")

    def mass(self, node: Node, path: str, within: bool = False) -> int:
        """Characters under a group, but for what is outside and, where pages differ, for what they share."""
        if outside(node[0], within) and path not in self.spared:
            return 0
        if self.differs and node[5]:
            return 0
        own = node[2] if node[0] == "#" else 0
        within = within or node[0].partition(".")[0] in ("article", "main")
        return own + sum(self.mass(c, f"{path} {c[0]}".strip(), within) for c in node[1])

    def _spare(self) -> None:
        """Groups that words of layout tell to be outside stay if they enclose an article: one with a heading of the page, an article or main, or
        by words of their own. Comments, sidebars and adverts don't stay, however much they hold."""

        def encloses(node: Node) -> bool:
            tag, *words = node[0].split(".")
            return tag in ("article", "main", "h1") or not ARTICLE_WORDS.isdisjoint(words) or any(encloses(c) for c in node[1] if not outside(c[0], True))

        def look(node: Node, path: str) -> None:
            for c in node[1]:
                at = f"{path} {c[0]}".strip()
                tag = c[0].partition(".")[0]
                if tag in OUTSIDE_TAGS or tag in ("#", "header") or outside(c[0], True):
                    continue
                if outside(c[0]):
                    if not encloses(c):
                        continue
                    self.spared.add(at)
                look(c, at)

        look(self.root, "")

    def _article(self) -> tuple[list[str], bool]:
        named: dict[int, set[str]] = {}

        def look(node: Node, path: str, deep: bool) -> None:
            for c in node[1]:
                at = f"{path} {c[0]}".strip()
                tag, *words = c[0].split(".")
                if tag in ("#", "header") or outside(c[0]) and at not in self.spared and not (deep and tag not in OUTSIDE_TAGS):
                    continue
                rank = 0 if tag == "article" else 1 if tag == "main" else 2 if not deep and not ARTICLE_WORDS.isdisjoint(words) else None
                if rank is not None and any(self.mass(x, f"{at} {x[0]}", True) for x in c[1]):
                    named.setdefault(rank, set()).add(at)
                elif rank in (0, 1) and c[5] and _has_text(c):
                    named.setdefault(rank + 3, set()).add(at)  # marked, but the same on all pages: if there is no other
                if rank != 0:
                    look(c, at, deep)

        look(self.root, "", False)
        if not named or min(named) == 2:
            look(self.root, "", True)  # an article or main within a group whose words are of layout
        if named:
            paths = named[min(named)]
            return sorted(paths | {s for s in self.spared if any(s.startswith(at + " ") for at in paths)}), min(named) != 2
        node, path = self.root, ""
        while True:  # down while one group holds most of the text that differs
            inner = [(self.mass(c, f"{path} {c[0]}".strip()), c) for c in node[1]]
            total = sum(held for held, _ in inner)
            held, top = max(inner, key=lambda x: x[0], default=(0, None))
            if top is None or top[4] or not held or held < 0.6 * total or top[0].partition(".")[0] in RUNNING:
                return sorted({path} | {s for s in self.spared if not path or s.startswith(path + " ")}), False
            node, path = top, f"{path} {top[0]}".strip()

    def _template(self, node: Node, path: str) -> None:
        for c in node[1]:
            at = f"{path} {c[0]}".strip()
            tag = c[0].partition(".")[0]
            inside = any(at == p or at.startswith(p + " ") or not p for p in self.paths)
            if c[5] and inside and not c[4] and tag not in RUNNING and (not self.marked or outside(c[0]) and not outside(c[0], True)):
                self.drops.add(f"{c[5]} {at}")
            elif not c[5] or not inside:
                self._template(c, at)


def main_text(page: str, paths: list[str], drops: set[str] = frozenset()) -> str | None:
    """The text under these paths, without groups whose literal and path are in ``drops``; None if the page has none of them."""
    blocks: list[list[str]] = [[]]
    path: list[str] = []
    begun: list[int] = []
    within, out, found = -1, -1, "" in paths
    wanted = set(paths)
    if found:
        within = 0
    marks = 0  # articles and mains around
    for what, value, literal in read(page):
        if what == "open":
            path.append(value)
            chosen = len(path) <= DEPTH and " ".join(path) in wanted
            if within < 0 and chosen:
                within, found = len(path), True
            if within >= 0 and out < 0 and not chosen and outside(value, within > 0 and (marks > 0 or "" not in wanted)):
                out = len(path)
            marks += value.partition(".")[0] in ("article", "main")
            begun.append(len(blocks))
            blocks.append([])
        elif what == "close":
            if within == len(path) and within:
                within = -1
            if out == len(path):
                out = -1
            at = begun.pop()
            if drops and f"{literal} {' '.join(path)}" in drops:
                del blocks[at:]
            marks -= path.pop().partition(".")[0] in ("article", "main")
            blocks.append([])
        elif within >= 0 and out < 0:
            blocks[-1].append(value)
    if not found:
        return None
    return " ".join(t for t in (" ".join(html.unescape("".join(b)).split()) for b in blocks if b) if t)


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def infer_wrappers(pages: DataFrame, url_col="url", html_col="html") -> DataFrame:
    """host, wrapper (as JSON), expression, paths, drops: of every host, from all its pages."""
    text = lambda node: json.dumps(node, separators=(",", ":"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A wrapper of each host's pages in this task (of several, with many hosts)."""
        held: dict[str, Node] = {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(map(text, held.values()), pa.string())], ["host", "wrapper"])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = shape(page.as_py() or "")
                held[host] = merge(held[host], found) if host in held else found
                if len(held) >= HELD:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    def aligned(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups:
            out = []
            for found in batch.column(1):
                wrapper = None
                for s in sorted(x.as_py() for x in found.values):
                    s = json.loads(s)
                    wrapper = s if wrapper is None else merge(wrapper, s)
                out.append(text(wrapper))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["host", "wrapper"])

    whole = pages.select(_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(own, "host string, wrapper string")
    for salts in (4096, 64, 1):
        salted = whole.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(salts)).alias("__salt")).agg(F.collect_list("wrapper").alias("wrappers"))
        whole = salted.select("host", "wrappers").mapInArrow(aligned, "host string, wrapper string")

    @F.pandas_udf("expression string, paths array<string>, drops array<string>")
    def decided(wrappers: pd.Series) -> pd.DataFrame:
        parsed = [json.loads(w) for w in wrappers]
        readings = [Reading(w) for w in parsed]
        return pd.DataFrame({"expression": [expression(w) for w in parsed], "paths": [r.paths for r in readings], "drops": [sorted(r.drops) for r in readings]})

    return whole.withColumn("__read", decided("wrapper")).select("host", "wrapper", "__read.expression", "__read.paths", "__read.drops")


def main_text_table(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    wrappers = staged(infer_wrappers(pages, url_col, html_col).select("host", "paths", "drops"), "wrappers")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), _host(F.col(url_col)).alias("host"))

    @F.pandas_udf("string")
    def extract(texts: pd.Series, paths: pd.Series, drops: pd.Series) -> pd.Series:
        out = []
        for t, p, d in zip(texts, paths, drops, strict=True):
            t = t or ""
            found = main_text(t, list(p), set(d)) if p is not None else None
            out.append(main_text(t, Reading(shape(t)).paths) or "" if found is None else found)
        return pd.Series(out, dtype=object)

    found = rows.join(wrappers, "host", "left").withColumn("text", extract("html", "paths", "drops"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
