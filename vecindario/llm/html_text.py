"""Main text of web pages as the maximum-scoring run of their tokens.

A page is read once as a list of tags and text runs. Words score positive and tags negative; how much is learned
from labelled pages (``LABELLED``, or any list of (before, content, after)) as the log-odds of content. Words in
menus, page headers, footers, sidebars, notices, adverts, forms and reader comments score negative
outside an article and nothing inside one. One linear scan finds the contiguous run with the highest sum; its
text, without the parts just named, is the result.

Edge cases: null and empty html give an empty text; unclosed tags, comments and quotes end with the page; without
any positive run the text is empty; repeated rows are read one by one; other columns pass through, but for one that
has the output's name; of runs with equal sums the earliest is taken, and the shortest of those; a very long page is read whole.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

# Elements by how they are shown, and names that tell what a container holds.
RAW = "script|style|noscript|template|iframe|svg|math|object|canvas|textarea|select|title"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
          "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
MAIN = {"article", "main"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
            "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
BY_TAG = {"nav": "menu", "menu": "menu", "footer": "footer", "aside": "sidebar", "form": "form", "button": "form", "fieldset": "form",
          "dialog": "notice", "head": "head"}
BY_ROLE = {"navigation": "menu", "menu": "menu", "menubar": "menu", "banner": "header", "contentinfo": "footer", "complementary": "sidebar",
           "search": "form", "form": "form", "alert": "notice", "dialog": "notice", "alertdialog": "notice"}
BY_NAME = {"menu": "menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar",
           "header": "masthead topbar siteheader pageheader", "footer": "footer sitefooter pagefooter copyright colophon",
           "sidebar": "sidebar aside widget widgets related recommended recommendations",
           "notice": "notice cookie cookies consent gdpr banner alert modal popup newsletter subscribe subscription paywall",
           "advert": "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted",
           "form": "form search searchbox login signup", "comments": "comment comments commentlist reply replies respond disqus discussion"}
NAMES = {name: kind for kind, names in BY_NAME.items() for name in names.split()}
LAYOUT = {"has", "with", "no", "without"}  # "has-sidebar" is not a sidebar
SPLIT_NAMES = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + RAW + r")\b(?P<rawattrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>.*?(?:</(?P=raw)\s*>|\Z)|"
    r"<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(?:[!?]|/?[a-z])[^>]*(?:>|\Z)", re.I | re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")

#: Labelled pages: what stands before the main text, the main text, what stands after it.
LABELLED = (
    ("<html><head><title>Tides</title></head><body><nav><ul><li><a>Home</a></li><li><a>News</a></li><li><a>Contact us</a></li></ul></nav>",
     "<article><h1>Why the sea rises</h1><p>Twice a day the water climbs the harbour wall and sinks again.</p><p>The moon pulls at the "
     "<b>near</b> side of the earth, the far side lags behind, and the coast turns through both.</p></article>",
     "<footer>Copyright the harbour office</footer></body></html>"),
    ("<body><header><a>Logo</a><span>The daily paper</span></header><div class='menu'><a>Politics</a> <a>Sport</a> <a>Weather</a></div>",
     "<div><h2>Bridge opens</h2><p>After nine years of work the bridge over the river was opened on Monday.</p><p>Crowds crossed it on "
     "foot before the first cars came, and <em>many</em> stayed until night.</p><ul><li>It is four hundred metres long.</li></ul></div>",
     "<aside><h3>Related</h3><ul><li><a>Older bridges</a></li><li><a>River maps</a></li></ul></aside><form><input><button>Search</button></form></body>"),
    ("<div class='ad'>Buy two, pay one, only today</div><table><tr><td><a>Index</a></td><td><a>Archive</a></td></tr></table>",
     "<p>The recipe needs flour, water and salt.<br>Mix them well and let the dough rest for an hour.</p><p>Bake it hot, on a stone if you "
     "have one, until the crust is dark and the loaf sounds hollow.</p><blockquote>Patience is the fourth ingredient.</blockquote>",
     "<div id='comments'><p>Great recipe, thanks</p><p>Did not work for me</p></div><div class='cookie-notice'>We use cookies<button>OK</button></div>"),
)
IN_ARTICLE = -0.1  # the lowest weight of a tag inside an article


class Run:
    """One text run or tag, with the container kind around it."""

    __slots__ = ("block", "inside", "kind", "name", "text")

    def __init__(self, name, text, kind, inside, block):
        self.name, self.text, self.kind, self.inside, self.block = name, text, kind, inside, block


def container(name: str, attrs: str, inside: bool) -> str | None:
    """The kind of part that a tag opens, or None. ``inside``: within an article, where a header has the title."""
    if name in BY_TAG:
        return BY_TAG[name]
    found = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(attrs)} if attrs else {}
    if (kind := BY_ROLE.get(found.get("role", "").lower())) and name not in INLINE:
        return kind
    if name == "header":
        return None if inside else "header"
    if name in ("body", "html") or not found:
        return None
    words = [x.lower() for key in ("class", "id") for x in SPLIT_NAMES.split(found.get(key, ""))]
    if not LAYOUT.isdisjoint(words):
        return None
    named = [NAMES[x] for x in words if x in NAMES and (name not in MAIN or NAMES[x] in ("comments", "advert"))]
    return named[0] if named else None


def runs(html: str) -> Iterator[Run]:
    """Tags and text runs in page order. Text of scripts, styles and the like is left out."""
    stack: list[tuple[str, str | None, bool]] = []
    names: Counter[str] = Counter()
    kind, inside, block, at = None, False, 0, 0

    def text(part: str):
        if part and not part.isspace():
            yield Run(None, part, kind, inside, block)

    for m in TOKEN.finditer(html):
        yield from text(html[at:m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            if names[name]:
                while (closed := stack.pop()[0]) != name:
                    names[closed] -= 1
                names[name] -= 1
        elif name not in VOID:
            if name in CLOSES_P and names["p"]:
                last = len(stack)
                while stack[last - 1][0] in INLINE:
                    last -= 1
                if stack[last - 1][0] == "p":  # an open paragraph ends here
                    for closed, *_ in stack[last - 1:]:
                        names[closed] -= 1
                    del stack[last - 1:]
                    kind, inside = stack[-1][1:] if stack else (None, False)
            opened = container(name, m["attrs"], inside) if kind is None or name in MAIN else None
            stack.append((name, opened or kind, inside or (name in MAIN and not opened)))
            names[name] += 1
        kind, inside = stack[-1][1:] if stack else (None, False)
        if name not in INLINE:
            block += 1
        elif name == "br":
            yield Run(None, " ", kind, inside, block)
        yield Run(name, "", kind, inside, block)
    yield from text(html[at:])


@cache
def default_weights() -> dict[tuple[str, str], float]:
    return fit(LABELLED)


def features(run: Run) -> tuple[str, str]:
    return ("tag", run.name) if run.name else ("word", run.kind or "text")


def fit(labelled: Iterable[tuple[str, str, str]]) -> dict[tuple[str, str], float]:
    """Log-odds of content, smoothed by one half: words of plain text end above zero, tags and other words below."""
    content, other = Counter(), Counter()
    for before, middle, after in labelled:
        for part, counts in ((before, other), (middle, content), (after, other)):
            for run in runs(part):
                counts[features(run)] += 1 if run.name else len(run.text.split())
    weights = {}
    for key in content.keys() | other.keys() | {("word", kind) for kind in (*BY_NAME, "head", "text")} | {("tag", "")}:
        odds = math.log((content[key] + 0.5) / (other[key] + 0.5))
        if key == ("word", "text"):
            weights[key] = max(odds, 0.5)
        else:
            weights[key] = min(odds, -0.01) if key[0] == "tag" else max(min(odds, -0.01), -1.0)
    return weights


def score(run: Run, weights: dict[tuple[str, str], float]) -> float:
    if run.name:
        weight = weights.get(("tag", run.name), weights["tag", ""])
        return max(weight, IN_ARTICLE) if run.inside else weight
    if run.kind and run.inside:
        return 0.0
    return weights["word", run.kind or "text"] * len(run.text.split())


def best(scores: list[float]) -> tuple[int, int]:
    """First and last + 1 of the run of ``scores`` with the highest positive sum; the earliest of equal ones, (0, 0) if none."""
    top, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > top:
            top, found = total, (start, i + 1)
    return found


def main_text(html: str | None, weights: dict[tuple[str, str], float] | None = None) -> str:
    if not html:
        return ""
    weights = weights or default_weights()
    page = list(runs(html))
    first, last = best([score(x, weights) for x in page])
    blocks: list[list[str]] = []
    now = None
    for run in page[first:last]:
        if not run.name and not run.kind:
            if run.block != now:
                blocks.append([])
                now = run.block
            blocks[-1].append(entities.unescape(run.text))
    joined = (" ".join("".join(parts).split()) for parts in blocks)
    return "\n".join(x for x in joined if x)


def extract(pages: DataFrame, html: str = "html", name: str = "text", labelled: Iterable[tuple[str, str, str]] | None = None) -> DataFrame:
    """Replace ``html`` by the main text as column ``name``."""
    weights = fit(labelled) if labelled else default_weights()
    kept = [c for c in pages.columns if c not in (html, name)]
    schema = T.StructType([*[pages.schema[c] for c in kept], T.StructField(name, T.StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = pa.array([main_text(x.as_py(), weights) for x in part.column(len(kept))], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], texts], names=schema.names)

    return pages.select(*kept, html).mapInArrow(read, schema)
