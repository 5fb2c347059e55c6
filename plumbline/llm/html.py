"""Main text of web pages by the container paths that the pages of a host agree on.

A page is read as blocks of text inside containers.  Each page scores its
containers and votes for the generalised tag-class paths of the best; Spark sums
the votes of a host; every page is then extracted again with the winning path.
"""

import html as entities
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored

_TOKEN = re.compile(
    r"<!--(?s:.*?)(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs2>[^>]*+)>|<[!?][^>]*+(?:>|\Z)")
_ATTR = re.compile(r"([a-zA-Z_:][a-zA-Z0-9_:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

# Elements by their role in HTML.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title xmp iframe noembed noframes".split())
_SKIP = set("head nav footer aside noscript template object svg math button select menu dialog canvas audio video "
            "script style textarea title xmp iframe noembed noframes datalist map".split())
_CONTAINER = set("html body main article section div td th center blockquote figure header details fieldset form".split())
_BLOCK = _CONTAINER | _SKIP - {"svg", "math", "button", "select", "map"} | set(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption pre address hr figcaption summary hgroup".split())
_LANDMARK = set("article main h1 nav header footer aside".split())       # what no form for input holds
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}}

# Names (parts of class, id or role) of what is not the article.
_NOT_TEXT = set("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted cookie "
                "cookies consent gdpr newsletter subscribe subscription signup login popup modal overlay comment comments "
                "disqus respond reply replies share sharing social related recommended recommendations breadcrumb "
                "breadcrumbs pagination pager menu nav navbar navigation navigations sidebar sidenav aside complementary footer "
                "contentinfo toolbar topbar masthead banner notice notices alert disclaimer widget widgets skip hidden "
                "search form".split())
_TOP = set("header".split())
_MAIN = set("content main article post body entry story text page wrapper container layout".split())
_ARTICLE = set("content main article post entry story".split())
_WITH = {"with", "has", "no", "without"}
# Names that also stand for a topic (related-work, share-price, search-term): with a word that is
# neither a name above nor a kind of box they say nothing about text inside an article.
_TOPIC = set("related recommended recommendations share sharing social search form notice notices alert banner menu respond "
             "reply replies skip sponsor sponsored promotion subscription signup widget widgets pager toolbar topbar".split())
_BOX = set("a area article articles bar block body bottom box btn button buttons card cards col column container content count "
           "entry group header heading holder icon icons inline inner item items left link links list main media news outer panel "
           "post posts products read reads right row rows section slot stories text title tools top unit videos wrap wrapper".split())
_PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote figcaption".split())


class Page:
    """Containers and text blocks of a page; ``parse`` fills both."""

    def __init__(self):
        self.parent: list[int] = [-1]
        self.label: list[str] = [""]
        self.tag: list[str] = ["#"]
        self.landmarks: set[int] = set()      # forms that hold elements of a page's frame
        self.blocks: list[tuple[int, str, int, bool]] = []   # container, text, characters in links, heading


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(source)}


def _named(attrs: dict[str, str], in_article: bool, in_prose: bool) -> set[str]:
    """Words of class, id and role that mark what is not the article."""
    out: set[str] = set()
    for name in " ".join(attrs.get(a, "") for a in ("class", "id", "role")).split():
        words = {w.lower() for w in _TOKENS.findall(name)}
        bad = words & _NOT_TEXT
        plain = {w for w in words - bad - _BOX if len(w) > 2 and not w.isdigit()}
        if bad <= _TOPIC and (in_prose or in_article and plain):
            continue
        out |= bad
    return out


def _is_furniture(tag: str, attrs: dict[str, str], in_article: bool, in_prose: bool) -> str:
    """"" for text, "all" for what is left out, "top" where only headings stay.

    A name that is also a topic counts neither for an element within a sentence
    nor, beside a word of its own, inside an article.
    """
    if tag in _SKIP or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return "all"
    style = attrs.get("style", "").replace(" ", "").lower()
    if "display:none" in style:
        return "all"
    if tag in ("html", "body", "main", "article"):
        return ""
    words = {w.lower() for a in ("class", "id", "role") for w in _TOKENS.findall(attrs.get(a, ""))}
    bad = _named(attrs, in_article, in_prose)
    if tag == "form":       # whether it is one for input shows when the page is read
        bad -= {"form", "search"}
    if bad and not words & _WITH:
        weak = bad <= {"sidebar", "banner", "notice", "widget", "form", "search", "nav", "menu"}
        if not (weak and words & _MAIN):
            return "all"
    if tag == "header" or words & _TOP:
        return "top" if in_article else "all"
    return ""


@lru_cache(maxsize=20_000)
def _element(tag: str, source: str, in_article: bool, in_prose: bool) -> tuple[str, str, bool]:
    """What is left out below an element, its label, and whether it is part of an article."""
    attrs = _attributes(source) if source else {}
    words = {w.lower() for a in ("class", "id", "role") for w in _TOKENS.findall(attrs.get(a, ""))}
    inside = in_article or tag in ("article", "main") or bool(words & _ARTICLE)
    return _is_furniture(tag, attrs, in_article, in_prose), _label(tag, attrs), inside


def _label(tag: str, attrs: dict[str, str]) -> str:
    """Tag and classes; numbers become #, names that look generated are left out."""
    names = []
    for name in sorted(set(attrs.get("class", "").split())):
        general = re.sub(r"\d+", "#", name)
        if len(general) <= 30 and general.count("#") <= 2:
            names.append(general)
    return ".".join([tag, *names])


def parse(source: str) -> Page:
    """Blocks and containers of any HTML, well formed or not.

    A form is left out with all that is in it, unless it is wrapped around the
    page: then it holds an article, a main heading or parts of the page's frame,
    or more prose than lies outside of it.
    """
    page = Page()
    stack: list[tuple[str, int, str, bool]] = [("#", 0, "", False)]   # tag, container, what is left out, in an article
    pieces: list[str] = []
    links = 0
    in_link = 0

    def text(piece: str) -> None:
        nonlocal links
        where = stack[-1][2]
        if where == "all" or where == "top" and not any(s[0] in _HEADING for s in stack):
            return
        piece = entities.unescape(piece) if "&" in piece else piece
        pieces.append(piece)
        if in_link:
            links += len(piece)

    def flush() -> None:
        nonlocal links
        if pieces:
            whole = " ".join("".join(pieces).split())
            if whole:
                page.blocks.append((stack[-1][1], whole, links, stack[-1][0] in _HEADING))
            pieces.clear()
        links = 0

    def close(index: int) -> None:
        nonlocal in_link
        in_link -= sum(s[0] == "a" for s in stack[index:])
        del stack[index:]

    at, size = 0, len(source)
    while at < size:
        start = source.find("<", at)
        m = _TOKEN.match(source, start) if start >= 0 else None
        while start >= 0 and m is None:  # a bare < is text
            start = source.find("<", start + 1)
            m = _TOKEN.match(source, start) if start >= 0 else None
        if m is None:
            text(source[at:])
            break
        if start > at:
            text(source[at:start])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if any(s[0] in _BLOCK for s in stack[i:]):
                        flush()
                    close(i)
                    break
                # a stray end tag of an inline element or paragraph closes no container
                if stack[i][0] in _CONTAINER and tag not in _BLOCK - {"p"}:
                    break
            continue
        if tag == "br":
            flush()
            continue
        if tag in _BLOCK:
            flush()
            closes = _CLOSES.get(tag, set()) | {"p"}
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in closes:
                    close(i)
                elif stack[i][0] in _CONTAINER or stack[i][0] in ("ul", "ol", "dl", "table"):
                    break
        if tag in _VOID or (m["attrs"] or m["attrs2"] or "").endswith("/") and tag not in _BLOCK:
            continue
        if tag in _RAW:
            stop = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(source, at)
            at = stop.end() if stop else size
            continue
        _, container, skip, in_article = stack[-1]
        if tag in _LANDMARK:
            above = container
            while above >= 0:
                if page.tag[above] == "form":
                    page.landmarks.add(above)
                above = page.parent[above]
        if skip != "all":
            in_prose = tag not in _BLOCK and any(s[0] in _PROSE for s in stack)
            own, label, in_article = _element(tag, m["attrs"] or m["attrs2"] or "", in_article, in_prose)
            skip = own or skip
            if tag in ("label", "legend") and any(s[0] == "form" for s in stack):
                skip = "all"
            if tag in _CONTAINER and skip != "all":
                page.parent.append(container)
                above = page.label[container]
                # html and body may be left out of a page, and are left out of paths, as forms are
                page.label.append(above if tag in ("html", "body", "form") else f"{above}>{label}" if above else label)
                page.tag.append(tag)
                container = len(page.parent) - 1
        in_link += tag == "a"
        stack.append((tag, container, skip, in_article))
    flush()
    return _without_forms(page)


def _without_forms(page: Page) -> Page:
    """The page without the blocks of forms for input."""
    forms = [i for i, tag in enumerate(page.tag) if tag == "form" and i not in page.landmarks]
    if forms:
        prose = sum(len(b[1]) for b in page.blocks)
        for form in forms:
            inside = [b for b in page.blocks if _inside(page, b[0], {form})]
            if 2 * sum(len(b[1]) for b in inside if len(b[1]) >= 80 and 2 * b[2] <= len(b[1])) <= prose:
                gone = {id(b) for b in inside}
                page.blocks = [b for b in page.blocks if id(b) not in gone]
    return page


def score(page: Page) -> list[float]:
    """How much a container looks like the article.

    A block of prose counts for the container around it and, less, for the next
    two outward; text in links counts against; article and main count more.
    """
    points = [0.0] * len(page.parent)
    prose = [0.0] * len(page.parent)
    link = [0.0] * len(page.parent)
    for container, text, links, heading in page.blocks:
        value = (len(text) + 25.0) * (0.5 if heading else 1.0)
        for weight in (1.0, 0.6, 0.2):
            points[container] += weight * value
            prose[container] += len(text)
            link[container] += links
            container = page.parent[container]
            if container < 0:
                break
    for i, tag in enumerate(page.tag):
        points[i] *= max(0.0, 1 - link[i] / (prose[i] + 1)) * {"article": 1.5, "main": 1.3, "html": 0.4, "#": 0.3}.get(tag, 1.0)
    return points


def best(page: Page) -> list[tuple[float, int]]:
    """Containers by score, the best first; outer ones first where scores are equal."""
    return sorted(((s, i) for i, s in enumerate(score(page)) if s > 0), key=lambda x: (-x[0], x[1]))


def _inside(page: Page, container: int, chosen: set[int]) -> bool:
    while container >= 0:
        if container in chosen:
            return True
        container = page.parent[container]
    return False


def _widened(page: Page, container: int) -> int:
    """The outermost container that a chosen one is the main part of.

    Article, main and what is named like one are taken up to the nearest article
    or main element.  Another parent is taken when all else in it is text of its
    own or parts of the same form, such as further sections.  What would be added
    must not be mostly links.
    """
    out, below, climbing = container, container, True
    while page.tag[out] not in ("article", "main") and page.parent[below] >= 0:
        above = page.parent[below]
        tag, last = page.tag[above], page.label[above].rpartition(">")[2]
        rest, same = [], True
        for block in page.blocks:
            path = block[0]
            inner = path
            while path >= 0 and path != above:
                inner, path = path, page.parent[path]
            if path < 0 or _inside(page, block[0], {container}):
                continue
            rest.append(block)
            if block[0] != above and inner != below:
                same &= page.label[inner] == page.label[below] or page.tag[inner] in ("section", "blockquote", "figure", "details")
        plain = sum(b[2] for b in rest) <= 0.5 * sum(len(b[1]) for b in rest)
        named = tag not in ("#", "html", "body") and bool({w.lower() for w in _TOKENS.findall(last)} & _ARTICLE)
        climbing &= same
        if plain and (tag in ("article", "main") or named and page.tag[below] != "article" or climbing):
            out = above
        below = above
    return out


def _lead(page: Page, chosen: set[int]) -> set[int]:
    """Numbers of the blocks before an article, in the main element around it, when its headline is among them."""
    out: set[int] = set()
    for article in (i for i in chosen if page.tag[i] == "article"):
        own = [k for k, b in enumerate(page.blocks) if _inside(page, b[0], {article})]
        around, at = [], page.parent[article]
        while at >= 0 and page.tag[at] != "main":
            around.append(at)
            at = page.parent[at]
        if at < 0 or not own or sum(t == "article" for t in page.tag) > 1 or any(page.blocks[k][3] for k in own[:1]):
            continue
        around = {at, *around}
        around |= {i for i, tag in enumerate(page.tag) if tag == "header" and page.parent[i] in around}
        first = [k for k, b in enumerate(page.blocks[:own[0]]) if b[0] in around]
        if any(page.blocks[k][3] for k in first) and 2 * sum(page.blocks[k][2] for k in first) <= sum(
                len(page.blocks[k][1]) for k in first):
            out |= set(first)
    return out


def _text_of(page: Page, chosen: set[int]) -> list[str]:
    lead = _lead(page, chosen)
    return [b[1] for k, b in enumerate(page.blocks) if k in lead or _inside(page, b[0], chosen)]


def extract(source: str | None, path: str | None = None) -> str:
    """The blocks inside the containers of a path, or of the page's own best container, widened to the whole article."""
    if not source:
        return ""
    page = parse(source)
    if not page.blocks:
        return ""
    chosen = {_widened(page, i) for i, label in enumerate(page.label) if label == path} if path else set()
    out = _text_of(page, chosen) if chosen else []
    if not out:
        ranked = best(page)
        own = page.label[ranked[0][1]] if ranked else None
        chosen = {_widened(page, i) for i, label in enumerate(page.label) if label == own} if own else {0}
        out = _text_of(page, chosen)
    return " ".join(out)


def _votes(batches):
    for batch in batches:
        rows = []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = parse(source or "")
            ranked = best(page)[:3]
            total = sum(s for s, _ in ranked)
            rows += [(host, page.label[i], s / total) for s, i in ranked if page.label[i]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
             pa.array([r[2] for r in rows], pa.float64())], ["host", "path", "vote"])


def _texts(batches):
    for batch in batches:
        texts = [extract(s, p) for s, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                         ["page_id", "url", "text"])


MOST_BROADCAST_HOSTS = 20_000     # winning paths of a few hundred bytes each: some megabytes


def host_paths(pages: DataFrame) -> DataFrame:
    """``(host, path)``: the path with most votes of every host, votes rounded so that order can't matter."""
    votes = pages.where("host != ''").select("host", "html").mapInArrow(_votes, "host string, path string, vote double")
    return votes.groupBy("host", "path").agg(F.sum(F.round(F.col("vote") * 1_000_000).cast("long")).alias("votes")) \
        .groupBy("host").agg(F.max(F.struct("votes", "path")).alias("top")).select("host", "top.path")


def extract_pages(pages: DataFrame, most_broadcast: int = MOST_BROADCAST_HOSTS) -> DataFrame:
    """``(page_id, url, text)`` of every row; an absent html gives an empty text.

    Votes of a host are summed where the pages are read, so a host with a third of
    all pages costs each task a few rows.  The winners are broadcast when they are
    few; beyond that the pages are joined by host, and adaptive execution splits a
    common one.  Without a host a page is extracted by its own best container.
    Repeated rows are extracted alike.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"),
                        F.coalesce(F.lower(F.regexp_extract(
                            "url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("")).alias("host"))
    winners = stored(host_paths(rows), "paths")
    if winners.count() <= most_broadcast:
        winners = F.broadcast(winners)
    return rows.join(winners, "host", "left").select("page_id", "url", "html", "path") \
        .mapInArrow(_texts, "page_id long, url string, text string")


def page_table(pages: DataFrame) -> DataFrame:
    return extract_pages(pages).withColumn("n_chars", F.char_length("text").cast("long"))
