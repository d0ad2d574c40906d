"""Main text of web pages by site template removal.

A page is parsed into elements. The subtrees of all elements that hold text are hashed (tag, class, id, role, text, children), the
hashes are counted per host in Spark, and subtrees that recur on many pages of the host (at least MIN_PAGES and
SHARE of them) are its template. Pages count by their text outside declared parts, so that copies of a page count once and cannot
turn its own text into a template. What remains after removing the template and the parts that markup declares to be no article
(menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles) is the text. If a page has an article
or main element, the text is what is inside; there, a recurring subtree is removed if it mostly consists of links, or else if
ARTICLE_SHARE of the pages have it inside, so that a passage which some articles share stays. Recurrence is asked first, for
declared parts too; the declarations decide about what does not recur. Class and id names declare by their last word (share-price is
no share bar), articles by words for comments only. A header inside an article is its heading and stays.

A host has at most (subtrees per page) / SHARE template hashes, however many pages it has, so its list travels with the
host and not with every page's subtrees.

Text: character references are decoded, white space is collapsed, blocks are joined by one space in page order.

Defined cases: a null html is an empty page with empty text; a null or broken url belongs to the host ''; repeated rows give one row
each (and count as one page); unclosed elements end with their parent, an unclosed comment, script or style with the page.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from netledger.llm.storage import stage

MIN_PAGES = 4
SHARE = 0.01
#: Share of a host's pages that a subtree must be on to be removed from inside articles.
ARTICLE_SHARE = 0.5
#: Parts that the pages of a host are dealt to where the templates are too large to be broadcast.
SALTS = 32
REMOVED = ("n_template", "n_declared", "n_outside")
#: Element names of the HTML standard by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form iframe svg math button select textarea dialog menu "
    "object audio video canvas xmp noembed noframes".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub "
    "sup time tt u var wbr img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
    "nav ol p pre section table ul".split()
)
#: Words in class or id that declare an element to be no part of the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices notification popup modal overlay sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs footer header "
    "masthead topbar comment comments commentlist disqus respond reply replies related recommended share sharing social "
    "newsletter subscribe signup login pagination pager widget widgets toolbar skip".split()
)
#: Words that follow the one that says what an element is (ad-slot, related-articles).
PLACE_WORDS = frozenset(
    "area articles bar block body bottom box button buttons col column container content desktop form group holder icons inner item "
    "items left link links list main mobile outer panel posts region right row section site slot small stories text title top unit "
    "wrap wrapper".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
_INSIDE = 0x9E3779B97F4A7C15
NEVER_BY_NAME = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
_COMMENT = r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
_PLAIN_TAG = r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
_TOKEN = re.compile(_COMMENT + r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|" + _PLAIN_TAG, re.S)
#: For pages where unclosed quotes cost more than QUOTE_WORK times their length: quotes no longer hide the end of a tag.
_TOKEN_NO_QUOTES = re.compile(_COMMENT + r"|(?!)()()()|" + _PLAIN_TAG, re.S)
QUOTE_WORK = 8
_OPEN_COMMENT = re.compile(_COMMENT + r"|(?!)()()()()()()", re.S)
_ATTRIBUTE = re.compile(
    r"(?<![^\s=/\"'>])([^\s=/\"'>]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?<![^\s/\"'])(hidden)(?![^\s/>])")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Element:
    __slots__ = ("tag", "key", "dropped", "parts", "hash", "chars", "linked")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.parts, self.hash, self.chars, self.linked = tag, [], 0, 0, 0
        self.dropped, self.key = tag in DROPPED, ""
        if attributes and not attributes.isspace():
            found = {}
            for name, double, single, bare, hidden in _ATTRIBUTE.findall(attributes):
                found[(name or hidden).lower()] = double or single or bare
            if "class" in found or "id" in found or "role" in found:
                self.key = "\x1f".join(found.get(n, "") for n in ("class", "id", "role"))
            role = found.get("role", "").lower()
            heads = {_head(name) for n in ("class", "id") for name in found.get(n, "").split()}
            if tag not in NEVER_BY_NAME and (heads & ASIDE_WORDS or role in ASIDE_ROLES) or tag == "article" and heads & COMMENT_WORDS:
                self.dropped = True
            if "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower():
                self.dropped = True
            if role == "main" and not self.dropped:
                self.tag = "main"


def _head(name: str) -> str:
    """The word that says what a class or id is: the last one but for places and numbers (share-price: price, ad-slot: ad)."""
    words = [w.lower() for w in _NAME.findall(name)]
    while len(words) > 1 and (words[-1] in PLACE_WORDS or words[-1].isdigit() or len(words[-1]) == 1):
        words.pop()
    return words[-1] if words else ""


def parse(page: str) -> Element:
    """The tree of a page; element parts are texts (decoded) and elements in page order. Time is linear in the page."""
    root = Element("#page", "")
    stack = [root]
    at, n = 0, len(page)
    token, quote_work = _TOKEN, 0
    last_end = page.rfind(">")
    # Depths of the open elements by tag, and of those that are no inline elements.
    depths: dict[str, list[int]] = defaultdict(list)
    blocks: list[int] = []

    def deepest(*tags: str) -> int:
        return max(depths[t][-1] if depths[t] else 0 for t in tags)

    def text(piece: str) -> None:
        if piece:
            stack[-1].parts.append(html.unescape(piece) if "&" in piece else piece)

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            element = stack.pop()
            if stack:
                depths[element.tag].pop()
                if element.tag not in INLINE:
                    blocks.pop()
            _seal(element)

    while at < n:
        # Behind the last > there are no tags, only text or an unclosed comment.
        match = (token if at <= last_end else _OPEN_COMMENT).search(page, at)
        if match is None:
            text(page[at:])
            break
        text(page[at:match.start()])
        at = match.end()
        end, name, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        if not name:
            continue
        name = name.lower()
        if match[5] and ('"' in attributes or "'" in attributes):
            quote_work += n - match.start()
            if quote_work > QUOTE_WORK * n:
                token = _TOKEN_NO_QUOTES
        if end:
            depth = deepest(name)
            # A stray end tag does not close an article around it.
            around = deepest("article", "main", "table") if name in ("p", "li", "b", "i", "span", "a") else 0
            if depth > around:
                close_to(depth)
            continue
        if name in CLOSES_P:
            if blocks and stack[blocks[-1]].tag == "p":
                close_to(blocks[-1])
        elif name in ("li", "dt", "dd", "option", "tr", "td", "th"):
            depth = deepest(*(("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,)))
            if depth and depth >= deepest("ul", "ol", "dl", "table", "tr", "tbody", "select", "article", "div", "section"):
                close_to(depth)
        element = Element(name, attributes)
        stack[-1].parts.append(element)
        if name in VOID or attributes.endswith("/") and name in ("svg", "path"):
            _seal(element)
            continue
        depths[element.tag].append(len(stack))
        if element.tag not in INLINE:
            blocks.append(len(stack))
        stack.append(element)
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            raw = page[at:stop.start() if stop else n]
            if name in ("title", "textarea"):
                text(raw)
            at = stop.start() if stop else n
    close_to(0)
    return root


def _seal(element: Element) -> None:
    """Hash and text lengths of a finished element."""
    digest = xxhash.xxh64(f"{element.tag}\x1e{element.key}")
    linked = 0
    for part in element.parts:
        if isinstance(part, str):
            clean = " ".join(part.split())
            element.chars += len(clean)
            digest.update(clean.encode("utf-8", "surrogatepass"))
        else:
            element.chars += part.chars
            linked += part.linked
            digest.update(part.hash.to_bytes(8, "little"))
        digest.update(b"\x1d")
    element.linked = element.chars if element.tag == "a" else linked
    element.hash = digest.intdigest()


def _walk(root: Element) -> Iterator[tuple[object, bool, bool, bool]]:
    """(element or text, inside an article, entering, declared to be no article) in page order; declared ones are not entered."""
    has_article = _has(root, "article")
    main = "article" if has_article else "main" if _has(root, "main") else None
    stack: list[tuple[object, bool, bool]] = [(root, main is None, True)]
    while stack:
        item, inside, entering = stack.pop()
        if isinstance(item, str) or not entering:
            yield item, inside, entering, False
            continue
        declared = item.dropped or item.tag == "header" and not inside
        inside = inside or item.tag == main and not declared
        keep = yield item, inside and main is not None, True, declared
        if keep is False or declared:
            continue
        stack.append((item, inside, False))
        for part in reversed(item.parts):
            stack.append((part, inside, True))


def _has(root: Element, tag: str) -> bool:
    stack = [root]
    while stack:
        element = stack.pop()
        if element.dropped:
            continue
        if element.tag == tag:
            return True
        stack += [p for p in element.parts if not isinstance(p, str)]
    return False


def _mostly_links(element: Element) -> bool:
    return element.linked * 2 > element.chars


def _template_key(element: Element, in_main: bool) -> tuple[int, bool]:
    """Signed key of a subtree, and whether it is an article's own content; the same subtree outside has another key."""
    own = in_main and not _mostly_links(element)
    key = element.hash ^ _INSIDE if own else element.hash
    return key - (1 << 64) if key >> 63 else key, own


def _countable(element: Element) -> bool:
    return element.chars > 0 and element.tag not in ("#page", "html", "body")


def subtree_hashes(tree: Element) -> set[tuple[int, bool]]:
    """Keys of the subtrees with text that may be a template, declared parts too, and whether they stand inside an article."""
    found = set()
    for item, in_main, entering, _ in _walk(tree):
        if entering and not isinstance(item, str) and _countable(item):
            found.add(_template_key(item, in_main))
    return found


def clean(tree: Element, template: set[int]) -> tuple[str, int, int, int]:
    """Text of the page, and the characters removed as template, as declared parts, and as standing outside the article."""
    out: list[str] = []
    by_template = by_declaration = outside = 0
    walk = _walk(tree)
    try:
        item, in_main, entering, declared = next(walk)
        while True:
            keep = None
            if isinstance(item, str):
                if in_main:
                    out.append(item)
                else:
                    outside += len(" ".join(item.split()))
            else:
                if item.tag not in INLINE and not declared:
                    out.append(" ")
                # Recurrence decides first; what markup declares is left for subtrees that do not recur.
                if entering and template and _countable(item) and _template_key(item, in_main)[0] in template:
                    keep = False
                    by_template += item.chars
                elif declared:
                    by_declaration += item.chars
            item, in_main, entering, declared = walk.send(keep)
    except StopIteration:
        pass
    return " ".join("".join(out).split()), by_template, by_declaration, outside


def main_text(page: str, template: set[int]) -> str:
    """Text of the page without the subtrees whose key is in the template."""
    return clean(parse(page), template)[0]


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE,
              article_share: float = ARTICLE_SHARE) -> DataFrame:
    """(host, template): packed keys of the subtrees that recur on the host's different pages."""
    rows = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("hash", pa.int64()), ("own", pa.bool_())])
        for batch in batches:
            sets, bodies = [], []
            for page in batch.column(1).to_pylist():
                tree = parse(page)
                sets.append([{"hash": h, "own": own} for h, own in sorted(subtree_hashes(tree))])
                bodies.append(xxhash.xxh64(clean(tree, set())[0].encode("utf-8", "surrogatepass")).intdigest() - (1 << 63))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bodies, pa.int64()), pa.array(sets, pa.list_(kind))], ["host", "body", "subtrees"])

    per_page = rows.mapInArrow(hashes, "host string, body bigint, subtrees array<struct<hash:bigint,own:boolean>>")
    # Every page gives one row without a hash: their different bodies are the number of pages of the host.
    page = F.array(F.struct(F.lit(None).cast("bigint").alias("hash"), F.lit(False).alias("own")))
    counted = stage(
        per_page.select("host", "body", F.explode(F.concat("subtrees", page)).alias("s"))
        .groupBy("host", "s.hash", "s.own", "body").agg(F.lit(1).alias("one"))
        .groupBy("host", "hash", "own").agg(F.count("*").alias("n"))
        .filter(F.col("hash").isNull() | (F.col("n") >= min_pages)), "counted",
    )
    of_host = counted.filter("hash is null").select("host", F.col("n").alias("pages"))
    least = F.col("pages") * F.when(F.col("own"), F.lit(article_share)).otherwise(F.lit(share))
    wanted = counted.filter("hash is not null").join(of_host, "host").filter(F.col("n") >= least)
    return wanted.groupBy("host").agg(F.collect_list("hash").alias("template"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars per page row, then the characters that each rule removed."""
    # Written first, so that Spark knows its size: small templates are broadcast, larger ones joined on host and salt.
    hosts = stage(templates(pages, min_pages, share), "templates").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"),
        F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    joined = rows.join(hosts, ["host", "salt"], "left").select("page_id", "url", "html", "template")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, set[int]] = {}
        for batch in batches:
            lists = batch.column(3)
            out = []
            for k, page in enumerate(batch.column(2).to_pylist()):
                own = np.zeros(0, np.int64)
                if lists[k].is_valid:
                    own = lists[k].values.to_numpy(zero_copy_only=False)
                packed = own.tobytes()
                if packed not in known:
                    known.clear()
                    known[packed] = set(own.tolist())
                out.append(clean(parse(page), known[packed]))
            removed = [pa.array([t[k] for t in out], pa.int64()) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([t[0] for t in out], pa.string()),
                pa.array([len(t[0]) for t in out], pa.int64()), *removed,
            ], ["page_id", "url", "text", "n_chars", *REMOVED])

    return joined.mapInArrow(texts, "page_id bigint, url string, text string, n_chars bigint, " + ", ".join(
        f"{name} bigint" for name in REMOVED))
