"""Main text of web pages by deduction of each host's template from equivalence classes of tokens.

Tokens are elements, named by their path of block elements, and whole text blocks at a path. A token's occurrence
vector says how often it occurs on each page of the host; tokens that share a vector form an equivalence class. Classes
with enough support are the template, nested by path: tokens that occur once a page are its frame, those that occur
more often are the repeated parts of the frame's slots. Elements of one path that every page has equally often are told
apart by their order. Nothing is read from names: the slot of the main text is the
innermost frame element with most of the text that isn't in links; repeated parts that are links, and text blocks that
every page has, belong to the template and are left out of it.

Vectors are never built: a token's vector is told by two sums of hashes of (page, count), which every task adds up for
its own pages and Spark adds up per (host, path, block), so a host with a third of all pages is split over tasks like
any other. Templates, a row a host, meet the pages in a join that shuffles pages only if Spark finds the templates too
large to send to all tasks.

Names of tags and classes are a last resort: for pages whose host shows no template, and for adverts, forms and
comments that stand within the main slot.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, written

#: Pages of different content that a host must show before classes count as its template.
SUPPORT_PAGES = 3
#: Share of a host's pages that a class of the template is on.
SUPPORT = 0.5
#: Pages of different content that a host must have before text at one path on all of them counts as its template.
FRAME_PAGES = 12
#: Share of a page's own text that the main element must hold, and of its text that makes an element one of links.
MAIN_SHARE = 0.7
LINK_SHARE = 0.8
#: Longer paths are told by a hash of their beginning, so that a page's paths grow with its elements only.
PATH_CHARS = 400

# Elements whose content is never text, elements without end tags, inline elements, running text.
RAW = frozenset("script style noscript template iframe svg math canvas object audio video select textarea button".split())
SPACED = frozenset("select textarea button object audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p".split())
PARTS = PROSE | frozenset("li dt dd blockquote pre figcaption".split())
HIDDEN = frozenset("head title".split())
#: An open element on the left is ended by the start of one on the right.
ENDED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}

# Fixed values of the last resort: tags, words of classes and ids, and roles of what is not main text.
DROPPED_TAGS = frozenset("nav header footer aside fieldset menu dialog".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert sidebar comment comments disqus reply replies "
    "nav navbar navigation menu breadcrumb breadcrumbs footer masthead share sharing social related recommended newsletter subscribe signup login popup modal overlay widget skip pagination pager".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu form".split())

_START = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)


class Page:
    """Elements of a page, parents first, and its text blocks in page order.

    Element 0 is the page itself. texts are (element, text, characters in links): references decoded, white space
    folded. One pass over the page; an open quote that is never closed makes quotes plain characters from there on.
    """

    def __init__(self, html: str):
        self.tag, self.path, self.parent, self.attributes = [""], [""], [-1], [""]
        self.texts: list[tuple[int, str, int]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        stack, held, open_tags = [0], [], {}
        at, linked, in_link, quotes = 0, 0, False, True

        def hold(piece: str) -> None:
            nonlocal linked
            if piece:
                held.append(piece)
                linked += len(piece.strip()) if in_link else 0

        def flush() -> None:
            nonlocal linked
            raw = "".join(held)
            held.clear()
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                self.texts.append((stack[-1], text, min(linked, len(text))))
            linked = 0

        def close(n: int) -> None:
            for i in stack[n:]:
                open_tags[self.tag[i]] -= 1
            del stack[n:]

        while m := _START.search(html, at):
            i = m.start()
            hold(html[at:i])
            at = m.end()
            if m[0] == "<!--":
                at = html.find("-->", at) + 3 if html.find("-->", at) >= 0 else len(html)
                continue
            if m[0] in ("<!", "<?"):
                stop = html.find(">", at)
                if stop < 0:
                    hold(html[i:])
                    at = len(html)
                    break
                at = stop + 1
                continue
            m = _NAME.match(html, i)
            stop = _QUOTED.match(html, m.end()).end() if quotes else -1
            if stop < 0 or stop >= len(html) or html[stop] != ">":
                quotes = False
                stop = html.find(">", m.end())
                if stop < 0:  # no tag ends any more: the rest is text
                    hold(html[i:])
                    at = len(html)
                    break
            tag, ends, attributes = m[1].lower(), html[i + 1] == "/", html[m.end() : stop]
            at = stop + 1
            if tag in RAW:
                if not ends and not (tag in ("svg", "math") and attributes.endswith("/")):
                    last = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(html, at)
                    at = last.end() if last else len(html)
                if tag in SPACED:
                    hold(" ")
                continue
            if tag in VOID:
                hold(" ")
                continue
            if tag in INLINE:
                in_link = not ends if tag == "a" else in_link
                continue
            flush()
            if ends:
                if open_tags.get(tag):
                    n = len(stack) - 1
                    while self.tag[stack[n]] != tag:
                        n -= 1
                    close(n)
                continue
            top = self.tag[stack[-1]]
            if top in ENDED_BY and ((by := ENDED_BY[top]) is None or tag in by):
                close(len(stack) - 1)
            if attributes.rstrip().endswith("/") and tag not in ("p", "div", "article", "section", "main", "body", "html"):
                continue
            self._open(tag, attributes, stack[-1])
            stack.append(len(self.tag) - 1)
            open_tags[tag] = open_tags.get(tag, 0) + 1
        hold(html[at:])
        flush()

    def _open(self, tag: str, attributes: str, parent: int) -> None:
        name = tag
        if attributes:
            for kind, a, b, c in _ATTRIBUTE.findall(attributes):
                if kind.lower() == "class" and (value := (a or b or c).lower().split()):
                    name = f"{tag}.{re.sub(r'[0-9]+', '#', value[0])}"
        before = self.path[parent]
        if len(before) > PATH_CHARS:
            before = f"{xxhash.xxh64_hexdigest(before.encode('utf-8', 'surrogatepass'))}"
        self.path.append(f"{before}>{name}" if before else name)
        self.tag.append(tag)
        self.parent.append(parent)
        self.attributes.append(attributes)

    def spread(self, marks: list[bool]) -> list[bool]:
        """Whether an element or one around it is marked."""
        out: list[bool] = []
        for mark, up in zip(marks, self.parent, strict=True):
            out.append(mark or up >= 0 and out[up])
        return out

    def summed(self, own: list[int]) -> list[int]:
        """own of each element and of those inside it."""
        out = list(own)
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out

    def shown(self) -> list[tuple[int, str, int]]:
        """Texts outside of the head."""
        hidden = self.spread([t in HIDDEN for t in self.tag])
        return [x for x in self.texts if not hidden[x[0]]]


def block_hash(path: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\n{text}".encode("utf-8", "surrogatepass")) >> 1 or 1


def places(paths: list[str]) -> list[str]:
    """path[k] for the k-th element of its path on a page, from 1."""
    seen: dict[str, int] = {}
    out = []
    for path in paths:
        seen[path] = k = seen.get(path, 0) + 1
        out.append(f"{path}[{k}]")
    return out


def page_tokens(page: str) -> dict[tuple[str, int], tuple[int, int, int, str, str]]:
    """(path, block hash or 0) -> (count, characters below it, of those in links, tag, path around it).

    ("", 0) is the page itself. Containers of a path that occurs several times have tokens of their own besides,
    named by their place. A page without elements and text has no tokens.
    """
    p = Page(page)
    texts = p.shown()
    if len(p.tag) == 1 and not texts:
        return {}
    own, own_links = [0] * len(p.tag), [0] * len(p.tag)
    out: dict[tuple[str, int], tuple[int, int, int, str, str]] = {}
    for i, text, linked in texts:
        own[i] += len(text)
        own_links[i] += linked
        key = p.path[i], block_hash(p.path[i], text)
        out[key] = (out[key][0] + 1 if key in out else 1, 0, 0, "", "")
    rows = list(zip(p.path, p.tag, p.parent, p.summed(own), p.summed(own_links), strict=True))
    for path, tag, up, n, links in rows:
        times, a, b, *_ = out.get((path, 0), (0, 0, 0))
        out[path, 0] = (times + 1, a + n, b + links, tag, p.path[up] if up >= 0 else "")
    for place, (path, tag, up, n, links) in zip(places(p.path), rows, strict=True):
        if out[path, 0][0] > 1 and tag not in PARTS:
            out[place, 0] = (1, n, links, tag, p.path[up])
    return out


def host_of(url: str = "url") -> Column:
    """Host of a URL in lower case; '' for null and for what isn't a URL."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def token_vectors(pages: DataFrame) -> DataFrame:
    """(host, path, block, pages, times, once, v1, v2, chars, links, low, high, tag, around) of every token of every host.

    v1 and v2 stand for the token's occurrence vector, low and high are its least and largest entries; once is the
    number of pages that have it once.
    """
    fields = "host string, path string, block long, pages long, times long, once long, v1 long, v2 long, chars long, links long, low long, high long, tag string, around string"
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = [pa.string() if f.endswith("string") else pa.int64() for f in fields.split(", ")]

    def rows(held: dict[tuple[str, str, int], list]) -> pa.RecordBatch:
        cols = list(zip(*((*k, *v) for k, v in held.items()), strict=True)) or [()] * len(names)
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str, int], list] = {}
        for b in batches:
            for host, key, page in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for (path, block), (n, chars, links, tag, around) in page_tokens(page or "").items():
                    h = xxhash.xxh64_intdigest(f"{key}:{n}")
                    own = held.setdefault((host, path, block), [0, 0, 0, 0, 0, 0, 0, n, n, tag, around])
                    for k, x in enumerate((1, n, n == 1, h >> 34, h & (1 << 30) - 1, chars, links)):
                        own[k] += x
                    own[7], own[8] = min(own[7], n), max(own[8], n)
                if len(held) > 50_000:
                    yield rows(held)
                    held = {}
        yield rows(held)

    texts = pages.select(host_of().alias("host"), F.xxhash64("page_id", "url").alias("key"), F.col("html").cast("string"))
    totals = [F.sum(x).alias(x) for x in ("pages", "times", "once", "v1", "v2", "chars", "links")]
    return texts.mapInArrow(run, fields).groupBy("host", "path", "block").agg(*totals, F.min("low").alias("low"), F.max("high").alias("high"), F.min("tag").alias("tag"), F.min("around").alias("around"))


def equivalence_classes(vectors: DataFrame, least_pages: int = 2) -> DataFrame:
    """(host, pages, times, v1, v2, paths, tokens): elements of a host with one occurrence vector, on `least_pages` pages or more."""
    own = vectors.where((F.col("block") == 0) & (F.col("pages") >= least_pages))
    token = F.struct("path", "around", "tag", "once", "chars", "links", "low", "high")
    held = own.groupBy("host", "pages", "times", "v1", "v2").agg(F.array_sort(F.collect_list(token)).alias("tokens"))
    return held.select("host", "pages", "times", "v1", "v2", F.col("tokens.path").alias("paths"), "tokens")


class Template:
    """Classes of a host nested by path: frame has the elements that pages have once, parts the repeated ones.

    slot[path] is the innermost frame element around an element; classes go in from those on most pages to those on
    fewest, so a class finds the slots that larger ones leave.
    """

    def __init__(self, pages: int, classes: list[dict]):
        self.frame: dict[str, dict] = {}
        self.parts: dict[str, dict] = {}
        self.slot: dict[str, str | None] = {}
        tokens = {t["path"]: t for c in classes for t in c["tokens"]}
        # Places count where every page has as many elements of the path; elsewhere they say nothing.
        even = {p for p, t in tokens.items() if t["low"] == t["high"] > 1}
        tokens = {p: t for p, t in tokens.items() if not p.endswith("]") or p.rpartition("[")[0] in even}
        for c in sorted(classes, key=lambda c: (-c["pages"], c["tokens"][0]["path"])):
            for t in (t for t in c["tokens"] if t["path"] in tokens):
                (self.frame if t["once"] >= SUPPORT * pages else self.parts)[t["path"]] = t
        for path, t in tokens.items():
            around = t["around"] if path else None
            while around and around not in self.frame and around in tokens:
                around = tokens[around]["around"]
            self.slot[path] = around if around in self.frame else "" if path else None

    def depth(self, path: str) -> int:
        n = 0
        while path and n <= len(self.slot):
            path, n = self.slot.get(path) or "", n + 1
        return n

    def main(self) -> str | None:
        """The slot of the main text, or None if the template doesn't tell it from the rest of the page."""
        plain = {p: t["chars"] - t["links"] for p, t in self.frame.items()}
        total = plain.get("", 0)
        full = [p for p, t in self.frame.items() if p and t["tag"] not in PARTS and plain[p] >= MAIN_SHARE * total > 0]
        if not full:
            return None
        best = min(full, key=lambda p: (-self.depth(p), -plain[p], p))
        # An element around it that adds headings and paragraphs rather than other things is the article.
        while (up := self.slot[best]) and up in full and self.frame[up]["tag"] not in ("html", "body"):
            prose = sum(t["chars"] - t["links"] for p, t in (self.frame | self.parts).items() if t["tag"] in PROSE and t["around"] == up)
            if not plain[up] > plain[best] or 2 * prose < plain[up] - plain[best]:
                break
            best = up
        return None if self.frame[best]["tag"] in ("html", "body") else best

    def link_parts(self) -> list[str]:
        """Elements of the template whose text is links."""
        return sorted(p for p, t in (self.frame | self.parts).items() if p and t["tag"] not in PROSE and t["chars"] and t["links"] >= LINK_SHARE * t["chars"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, element, frame_blocks, link_parts): the slot of the main text, if the host's template has one, the
    hashes of text blocks of the template, and its elements that are links."""
    vectors = written(token_vectors(pages).where((F.col("block") == 0) | (F.col("pages") >= FRAME_PAGES)), "token-vectors")
    once = vectors.where("path = '' and block = 0").select("host", F.col("pages").alias("all"), F.col("v1").alias("p1"), F.col("v2").alias("p2"))
    contents = pages.select(host_of().alias("host"), F.xxhash64(F.col("html").cast("string")).alias("content")).distinct()
    contents = contents.groupBy("host").agg(F.count(F.lit(1)).alias("contents")).where(F.col("contents") >= SUPPORT_PAGES)
    hosts = written(once.join(contents, "host"), "template-hosts")
    supported = vectors.join(hosts.select("host", "all"), "host").where(F.col("pages") >= SUPPORT * F.col("all"))
    classes = equivalence_classes(supported, 1).groupBy("host").agg(F.collect_list(F.struct("pages", "tokens")).alias("classes"))
    shared = vectors.where("block <> 0").join(hosts.where(F.col("contents") >= FRAME_PAGES), "host").where("pages = all and v1 = p1 and v2 = p2")
    shared = shared.groupBy("host").agg(F.collect_set("block").alias("frame_blocks"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [Template(n, cs) for n, cs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            columns = [b.column(0), pa.array([t.main() for t in every], pa.string()), b.column(3), pa.array([t.link_parts() for t in every], pa.list_(pa.string()))]
            yield pa.record_batch(columns, names=["host", "element", "frame_blocks", "link_parts"])

    known = hosts.select("host", "all").join(classes, "host").join(shared, "host", "left").select("host", "all", "classes", "frame_blocks")
    return known.mapInArrow(choose, "host string, element string, frame_blocks array<long>, link_parts array<string>")


def odd_words(tag: str, attributes: str, inside: bool) -> bool:
    """Last resort: whether words of class, id or role, or a form's tag, say that an element is not main text.

    inside: whether it stands in the main text. Words never count for html and body, nor there for headings and
    paragraphs; an id, which may be an anchor, counts there only if it has no other words.
    """
    if tag in ("html", "body"):
        return False
    out, prose = tag == "form", tag in PROSE
    for kind, a, b, c in _ATTRIBUTE.findall(attributes):
        kind, value = kind.lower(), (a or b or c).lower()
        words = [w for w in re.split(r"[^a-z]+", value) if w]
        if prose and (inside or kind == "id"):
            continue
        if kind == "role":
            out |= value.strip() in DROPPED_ROLES
        elif kind == "id" and inside:
            out |= bool(words) and DROPPED_WORDS.issuperset(words)
        else:
            out |= not DROPPED_WORDS.isdisjoint(words) or not inside and "header" in words
    return out


def lone_page(p: Page) -> tuple[int, list[bool]]:
    """Last resort, for a page without a template: (main element, whether an element is left out).

    Words and forms that would leave out every article and main of the page don't count for the elements around the
    largest one. On a page without any, forms with MAIN_SHARE of the text don't count, nor, where no text is left,
    what stands around the heaviest text.
    """
    texts = p.shown()
    own = [0] * len(p.tag)
    for i, text, _ in texts:
        own[i] += len(text)
    named = [t in ("article", "main") for t in p.tag]
    inside = p.spread(named)
    hard = p.spread([t in DROPPED_TAGS or t in HIDDEN for t in p.tag])
    soft = [odd_words(t, a, up >= 0 and inside[up]) for t, a, up in zip(p.tag, p.attributes, p.parent, strict=True)]
    size = p.summed([0 if h else n for n, h in zip(own, hard, strict=True)])

    def out() -> list[bool]:
        return [a or b for a, b in zip(hard, p.spread(soft), strict=True)]

    left_out = out()
    articles = [i for i, x in enumerate(named) if x and not hard[i] and size[i]]
    if articles:
        if all(left_out[i] for i in articles):
            i = max(articles, key=lambda i: (size[i], -i))
            while i >= 0:
                soft[i], i = False, p.parent[i]
    else:
        for i, t in enumerate(p.tag):
            soft[i] &= not (t == "form" and size[i] >= MAIN_SHARE * size[0])
        left_out = out()
        prose = p.summed([int(t in PROSE) for t in p.tag])
        if size[0] and all(left_out[i] for i, *_ in texts):
            children: dict[int, list[int]] = {}
            for i in range(1, len(p.tag)):
                if prose[i] and size[i]:
                    children.setdefault(p.parent[i], []).append(i)
            i = 0
            while i in children:
                i = max(children[i], key=lambda k: (size[k], -k))
                soft[i] = False
    left_out = out()
    chars = p.summed([0 if o else n for n, o in zip(own, left_out, strict=True)])
    times: dict[str, int] = {}
    for path in p.path:
        times[path] = times.get(path, 0) + 1
    once = [i for i, path in enumerate(p.path) if times[path] == 1]
    main = [i for i in once if named[i] and chars[i] >= 0.3 * max(1, chars[0])]
    if main:
        return min(main, key=lambda i: (-chars[i], i)), left_out
    full = [i for i in once if i and p.tag[i] not in PARTS and chars[i] >= MAIN_SHARE * max(1, chars[0])]
    return max(full, default=0), left_out  # parents come first, so the last is the innermost


def main_text(page: str, element: str | None, frame: frozenset[int] = frozenset(), links: frozenset[str] = frozenset(), words: bool = True) -> str:
    """Own text of a page inside its element (None, '' or not on this page: found from this page alone).

    frame: hashes of text blocks of the template, which go from pages without a main element (inside one nothing goes for
    being shared); links: paths of its elements that are links; words: whether names of tags and classes inside the
    element count.
    """
    p = Page(page)
    main = [element in (x, place) for x, place in zip(p.path, places(p.path), strict=True)] if element else []
    if any(main):
        inside = p.spread(main)
        within, slot = [up >= 0 and inside[up] for up in p.parent], True
        drop = p.spread([i and (path in links or words and (t in DROPPED_TAGS or odd_words(t, a, True))) for i, path, t, a in zip(within, p.path, p.tag, p.attributes, strict=True)])
    else:
        i, drop = lone_page(p)
        slot = i != 0
        inside = p.spread([k == i for k in range(len(p.tag))])
    return " ".join(t for i, t, _ in p.shown() if inside[i] and not drop[i] and not (frame and not slot and block_hash(p.path[i], t) in frame))


def extract(pages: DataFrame, words: bool = True) -> DataFrame:
    """(page_id, url, text): the main text of every page; empty if it has none or html is null.

    Pages with a null or odd url share the host ''. Repeated rows each give a row; an empty table gives none;
    columns besides page_id, url and html are ignored. words: whether names count inside the main slot.
    """
    known = written(templates(pages).withColumnRenamed("host", "template_host"), "templates")
    rows = pages.select("page_id", "url", F.col("html").cast("string"), host_of().alias("host"))
    rows = rows.join(known, F.col("host") == F.col("template_host"), "left").select("page_id", "url", "html", "element", "frame_blocks", "link_parts")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            page, element, frame, links = (b.column(i).to_pylist() for i in (2, 3, 4, 5))
            text = [main_text(p or "", e, frozenset(f or ()), frozenset(k or ()), words) for p, e, f, k in zip(page, element, frame, links, strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op9_query(spark, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
