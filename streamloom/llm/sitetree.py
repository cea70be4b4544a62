"""Main text of web pages by site style trees.

The DOMs of a host are merged into one style tree: a node is the path of tags
and classes that leads to it. For each node and page the presentation (the
sequence of its children) and the content (its text) are hashed, and counted
over the host's pages by one map-side combined aggregate. A node's importance
is the larger of the two entropies, divided by that of all pages differing: a
menu or footer that looks and reads alike on every page has importance near 0,
the article's nodes near 1. Few pages prove little: importance is taken as if
PRIOR_PAGES more pages had all differed, for every host alike, so on two pages
nothing goes and on hundreds what recurs goes even inside an article. From each
page branches are removed whose importance is below OUTSIDE times that of the
host's most important node or, inside a marked article or main part, below
INSIDE; but only where the page's own presentation and content at the node recur
as much: for a value on c of n pages ln(n / c) / ln(n), taken in the same way, is
below the same bound. Copies lower a node's importance for all pages, but don't
remove what few of them have. What is noise by name has no part in the
importance of the nodes around it.

What a page says about itself comes on top, since a host may have one page:
elements and class names that stand for menus, notices, adverts, forms,
comments and the like are never main text, and if the page marks an article or
a main part, only that is. A name, a role or a form says so only of a branch
that holds at most half of the page's text, or of its marked text if there is
any; and names are whole class tokens, not their parts.

Only counts by host and node travel; pages are parsed twice and never shuffled
while the low values of all hosts fit a broadcast of checked size. Beyond it each
page's nodes are joined with them, and the pages with what was found for them; no
row ever holds a whole host. With ``hints`` off the tree alone decides, but for
elements that hold no text to read; this shows what it does by itself.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbered, table

#: pages that count as if all had differed, besides those of a host
PRIOR_PAGES = 6.0
OUTSIDE = 0.7
INSIDE = 0.1
#: a host whose most important node is below this shows too few different pages to judge by
DIVERSE = 0.5
#: values of low nodes up to which they are broadcast (about 100 bytes each)
BROADCAST_NODES = 200_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
NOISE_TAGS = frozenset("nav footer aside script style noscript template iframe object applet select button input textarea svg canvas audio video dialog menu head title xmp noembed noframes map datalist".split())
#: noise with and without hints: nothing in them is text to read
TEXTLESS = frozenset("script style noscript template iframe object applet select button input textarea svg canvas audio video head title xmp noembed noframes map datalist".split())
MAIN_TAGS = frozenset(("article", "main"))
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense adbox adslot adbanner adunit sponsor sponsored sponsors promo promos promotion promoted banner banners"
    " cookie cookies cookiebar cookiebanner cookienotice consent gdpr notice notices notification notifications announcement announcements alert alerts popup modal overlay toast"
    " newsletter subscribe subscription signup sidebar sidebars sidenav widget widgets nav navbar navigation navmenu mainnav sitenav topnav menu menus mainmenu sidemenu submenu"
    " breadcrumb breadcrumbs footer sitefooter pagefooter masthead siteheader pageheader topbar toolbar social share sharing sharebar related recommended recommendations"
    " comment comments commentlist respond responses reactions disqus replies reply discussion feedback guestbook search searchform login pagination pager skip hidden"
    " tags tagcloud disclaimer paywall outbrain taboola".split()
)
#: a name made of those above and these is one too
NOISE_PARTS = frozenset("site page main global primary secondary top bottom left right box block bar container wrapper wrap list area section inner outer item items link links".split())
#: names that content has as well: as the id of a section, or of anything in an article or main part, they are anchors
DOUBTFUL = frozenset(
    "discussion recommendations recommended related responses reactions feedback reply replies respond notice notices notification notifications announcement announcements alert alerts"
    " disclaimer promotion promotions consent social share sharing search tags cookies navigation comment sponsors subscription".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: elements of the head; any other closes an open one
HEAD_TAGS = frozenset("head title base link meta style script noscript template".split())
#: noise only outside an article or main part: inside they also name the article's own title and lead
NOISE_OUTSIDE = frozenset("header teaser teasers".split())
NOISE_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alertdialog alert menu menubar toolbar note".split())
#: an open element of the first is closed by a start tag of the second
CLOSES = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option", "optgroup")),
    "tr": frozenset(("tr", "tbody", "thead", "tfoot")), "td": frozenset(("td", "th", "tr", "tbody")), "th": frozenset(("td", "th", "tr", "tbody")),
}
#: start tags that end an open paragraph
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dt dd".split()
)
#: an implied end tag doesn't reach out of these
SCOPE = frozenset(("table", "td", "th", "ul", "ol", "dl", "article", "main", "section", "div", "body", "html", "button", "select"))

_TOKEN = re.compile(
    r"<!--(?:.*?)(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"""(?:^|\s|["'/])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[^\W_]+")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in _NAMES.finditer(raw)} if raw and not raw.isspace() else {}


def _is_noise_name(name: str, in_main: bool) -> bool:
    """Whether a class or id stands for noise: as a whole, but for a number at its end."""
    parts = _PART.findall(re.sub(r"[-_]?[0-9]+\Z", "", name))
    noise = [p in NOISE_NAMES or (not in_main and p in NOISE_OUTSIDE) for p in parts]
    return any(noise) and all(n or p in NOISE_PARTS for n, p in zip(noise, parts))


def _noise(tag: str, attrs: dict[str, str], in_main: bool) -> int:
    """2 if an element is noise, 1 if it is unless it holds most of the page's text, else 0."""
    if tag in NOISE_TAGS or (tag == "header" and not in_main):
        return 2
    if tag in ("html", "body"):
        return 0
    if attrs and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""))):
        return 2
    if tag == "form":
        return 1
    if not attrs or tag in HEADINGS:
        return 0
    if attrs.get("role") in NOISE_ROLES:
        return 1
    ids = attrs.get("id", "").split()
    if in_main or tag == "section":
        ids = [n for n in ids if n not in DOUBTFUL]
    return int(any(_is_noise_name(n, in_main) for n in attrs.get("class", "").split() + ids))


class Segment:
    """A run of text of one block: where it stands in the tree, and whether it may be main text."""

    __slots__ = ("path", "text", "main", "noise", "block", "depth")

    def __init__(self, path, text, main, noise, block, depth):
        self.path, self.text, self.main, self.noise, self.block, self.depth = path, text, main, noise, block, depth


def parse(page: str, hints: bool = True):
    """(segments in page order, children: {path: child tags in order}).

    A path is a tuple of 64-bit style-tree nodes from the root; a text's path is
    that of its element. Tag soup is closed as browsers do for paragraphs, list
    items and table cells; an end tag that nothing opened is ignored.
    """
    segments: list[Segment] = []
    children: dict[tuple, list[str]] = {}
    # tag, path, inside main, noise, depth of the main part's parent, innermost mark that text may lift
    stack: list[tuple] = [("#root", (), False, False, 0, -1)]
    above: list[int] = []  # of each such mark the one around it
    marks: list[int] = []  # of each segment its innermost mark
    block = at = 0

    def text(raw: str) -> None:
        if raw:
            if stack[-1][0] == "head" and not raw.isspace():
                stack.pop()
            _, path, main, noise, depth, mark = stack[-1]
            segments.append(Segment(path, html.unescape(raw) if "&" in raw else raw, main, noise, block, depth))
            marks.append(mark)

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag
            if tag not in INLINE:
                block += 1
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k][0] not in INLINE or tag == "p" and stack[k][0] in SCOPE:
                    break
            continue
        raw = m[3] or m[6] or ""
        if tag not in HEAD_TAGS and stack[-1][0] == "head":
            stack.pop()
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in SCOPE:
                    break
        closes = CLOSES.get(tag)
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in closes:
                    del stack[k:]
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
        if tag == "br":
            text(" ")
            continue
        if tag not in INLINE:
            block += 1
        _, path, main, noise, depth, mark = stack[-1]
        attrs = {} if tag in VOID else _attributes(raw)
        degree = 0 if noise or tag in VOID else _noise(tag, attrs, main) if hints else 2 * (tag in TEXTLESS)
        if len(path) < 64 and not noise and not degree:
            children.setdefault(path, []).append(tag)
        if tag in VOID:
            continue
        noise = noise or degree == 2
        if degree == 1:
            above.append(mark)
            mark = len(above) - 1
        if not main:
            depth = len(path)
        main = main or (hints and (tag in MAIN_TAGS or attrs.get("role") == "main" or attrs.get("itemprop") == "articlebody"))
        # deeper nodes of very deep pages count to the branch at depth 64
        own = path if len(path) >= 64 else (*path, _node(path[-1] if path else 0, tag, attrs.get("class", "")))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if not raw.endswith("/") or tag not in ("svg", "path", "g"):
            stack.append((tag, own, main, noise, depth, mark))
    _settle(segments, marks, above)
    return segments, children


def _settle(segments: list[Segment], marks: list[int], above: list[int]) -> None:
    """Makes segments noise below marks that hold at most half of the page's text, or of its marked text."""
    if not above:
        return
    sizes = [0 if s.noise else len("".join(s.text.split())) for s in segments]
    if any(size and s.main for s, size in zip(segments, sizes)):
        sizes = [size if s.main else 0 for s, size in zip(segments, sizes)]
    held = [0] * len(above)
    for mark, size in zip(marks, sizes):
        if mark >= 0:
            held[mark] += size
    for k in range(len(above) - 1, -1, -1):
        if above[k] >= 0:
            held[above[k]] += held[k]
    half = sum(sizes) / 2
    noise: list[bool] = []
    for h, k in zip(held, above):
        noise.append(h <= half or (k >= 0 and noise[k]))
    for s, mark in zip(segments, marks):
        s.noise = s.noise or (mark >= 0 and noise[mark])


def _node(parent: int, tag: str, names: str) -> int:
    name = f"{tag}.{names}".encode("utf-8", "surrogatepass")
    mixed = (parent * 0x9E3779B97F4A7C15 + (zlib.crc32(name) << 32 | zlib.adler32(name))) & 0xFFFFFFFFFFFFFFFF
    mixed = ((mixed ^ (mixed >> 29)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    return mixed - (1 << 64) if mixed >> 63 else mixed


def page_nodes(page: str, hints: bool = True) -> dict[int, tuple[int, int, bool]]:
    """{node: (presentation hash, content hash, inside a main part)} of one page; nodes with no text below them, or only noise, are left out."""
    return _nodes(*parse(page, hints))


def _nodes(segments: list[Segment], children: dict[tuple, list[str]]) -> dict[int, tuple[int, int, bool]]:
    outside: set[int] = set()
    content: dict[int, int] = {}
    paths: dict[int, tuple] = {}
    for s in segments:
        bare = b"" if s.noise else " ".join(s.text.split()).encode("utf-8", "surrogatepass")
        if bare:
            if not s.main:
                outside.update(s.path)
            for d, node in enumerate(s.path):
                content[node] = zlib.crc32(bare, content.get(node, 0))
                paths.setdefault(node, s.path[: d + 1])
    for s in segments:  # the nodes that lead to a main part are not in it
        if s.main and s.path:
            outside.update(s.path[: s.depth])
    return {node: (zlib.crc32(",".join(children.get(paths[node], ())).encode()), c, node not in outside) for node, c in content.items()}


def main_text(page: str, low: frozenset | set = frozenset(), gone: frozenset | set = frozenset(), hints: bool = True) -> str:
    """The page's main text without noise, without the branches in ``gone`` and without those whose (node, presentation)
    and (node, content) are in ``low``, marked as in ``VALUE``."""
    segments, children = parse(page, hints)
    if low:
        nodes = _nodes(segments, children).items()
        gone = {node for node, (look, content, _) in nodes if (node, look) in low and (node, content + (1 << 32)) in low}
    good = [s for s in segments if not s.noise]
    if any(s.main and s.text.strip() for s in good):
        good = [s for s in good if s.main]
    if gone:
        good = [s for s in good if gone.isdisjoint(s.path)]
    blocks: list[str] = []
    last = None
    for s in good:
        if s.block == last:
            blocks[-1] += s.text
        else:
            blocks.append(s.text)
            last = s.block
    return " ".join(t for t in (" ".join(b.split()) for b in blocks) if t)


#: presentation hashes stand below the content hashes
VALUE = "value + shiftleft(cast(kind as bigint), 32)"


def node_values(pages: DataFrame, hints: bool = True) -> DataFrame:
    """pages: host, html -> host, node, kind (0: presentation, 1: content), value, c (pages that have it), inside. Values of one page are counted together as null."""

    def nodes(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for host, page in zip(batch["host"], batch["html"]):
                for node, (look, content, inside) in page_nodes(page or "", hints).items():
                    out.append((host, node, inside, 0, look))
                    out.append((host, node, inside, 1, content))
            yield pd.DataFrame(out, columns=["host", "node", "inside", "kind", "value"])

    counted = pages.mapInPandas(nodes, "host string, node bigint, inside boolean, kind int, value bigint").groupBy("host", "node", "kind", "value").agg(F.count("*").alias("c"), F.min("inside").alias("inside"))
    return counted.groupBy("host", "node", "kind", F.when(F.col("c") > 1, F.col("value")).alias("value")).agg(F.sum("c").alias("c"), F.min("inside").alias("inside"))


def _importance(values: DataFrame) -> DataFrame:
    entropy = values.groupBy("host", "node", "kind").agg(F.sum("c").alias("pages"), F.sum(F.expr("if(value is null, 0D, c * ln(c))")).alias("s"), F.min("inside").alias("inside"))
    by_kind = entropy.withColumn("h", F.expr("if(pages > 1, (ln(pages) - s / pages) / ln(pages), 1D)"))
    return by_kind.groupBy("host", "node").agg(F.max("pages").alias("pages"), F.max("h").alias("importance"), F.min("inside").alias("inside"))


def node_importance(pages: DataFrame) -> DataFrame:
    """pages: host, html -> host, node, pages, importance (0 to 1), inside (a main part, on every page)."""
    return _importance(node_values(pages))


def low_values(values: DataFrame, prior: float = PRIOR_PAGES, outside: float = OUTSIDE, inside: float = INSIDE) -> DataFrame:
    """host, node, v: presentations and contents (marked as in ``VALUE``) with which nodes go; a node goes from a page if both of the page's are listed.

    A value of a node on n pages is listed only if it is on more than n ** (1 - bound), so there are at most n ** bound.
    """
    nodes = _importance(values)
    most = materialise(nodes.groupBy("host").agg(F.max("importance").alias("most")).filter(F.col("most") >= DIVERSE))
    taken = lambda x: f"(pages * {x} + {prior}D) / (pages + {prior}D)"
    bound = F.expr(f"if(inside, {inside}D, {outside}D * most)")
    low = materialise(nodes.filter("pages > 1").join(most, "host").withColumn("bound", bound).filter(f"{taken('importance')} < bound").select("host", "node", "pages", "bound"))
    # presentation and content of a node are on the same pages
    recurring = values.filter("value is not null").select("host", "node", "c", F.expr(VALUE).alias("v")).join(low, ["host", "node"])
    return recurring.filter(f"{taken('(ln(pages / c) / ln(pages))')} < bound").select("host", "node", "v")


def _gone_nodes(rows: DataFrame, low: DataFrame, hints: bool) -> DataFrame:
    """rows: uid, host, html -> uid, gone: the nodes whose presentation and content on that page are both in ``low``."""

    def nodes(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for uid, host, page in zip(batch["uid"], batch["host"], batch["html"]):
                for node, (look, content, _) in page_nodes(page, hints).items():
                    out += [(uid, host, node, look), (uid, host, node, content + (1 << 32))]
            yield pd.DataFrame(out, columns=["uid", "host", "node", "v"])

    found = rows.select("uid", "host", "html").mapInPandas(nodes, "uid bigint, host string, node bigint, v bigint").join(low, ["host", "node", "v"])
    return found.groupBy("uid", "node").agg(F.count("*").alias("n")).filter("n = 2").groupBy("uid").agg(F.collect_list("node").alias("gone"))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", prior: float = PRIOR_PAGES, hints: bool = True) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars.

    A null html is empty and has the empty text; a null or hostless url belongs
    to the host ''. Repeated pages are extracted alike; other columns are not
    read.
    """
    host = F.coalesce(F.regexp_extract(F.lower(F.col(url_col).cast("string")), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), host.alias("host"))
    low = materialise(low_values(materialise(node_values(rows.select("host", "html"), hints)), prior))
    small = low.count() <= BROADCAST_NODES
    if small:
        of_host = materialise(low.groupBy("host").agg(F.flatten(F.collect_list(F.array("node", "v"))).alias("low")))
        found = rows.join(F.broadcast(of_host), "host", "left").withColumn("gone", F.lit(None).cast("array<bigint>"))
    else:
        rows = numbered(rows)
        found = rows.join(materialise(_gone_nodes(rows, low, hints)), "uid", "left").withColumn("low", F.lit(None).cast("array<bigint>"))
    id_type = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        known: dict[str, frozenset] = {}
        for batch in batches:
            texts = []
            for name, page, nodes, gone in zip(batch["host"], batch["html"], batch["low"], batch["gone"]):
                if nodes is not None and name not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[name] = frozenset(zip(map(int, nodes[::2]), map(int, nodes[1::2])))
                texts.append(main_text(page, frozenset() if nodes is None else known[name], frozenset() if gone is None else frozenset(map(int, gone)), hints))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    found = found.withColumn("page_id", F.col("page_id").cast("string"))
    out = found.select("page_id", "url", "html", "host", "low", "gone").mapInPandas(run, "page_id string, url string, text string, n_chars bigint")
    return out.withColumn("page_id", F.col("page_id").cast(id_type))


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
