"""Operator 9: main text of web pages by template deduction.

Tokens of a page are its structural tags with their path and its text blocks with their path.  Over the pages of a host,
tokens whose occurrence vectors (which page holds how many) are equal form a class; the vectors are compared by a
commutative hash, so one grouped aggregation finds the classes of any host.  Pages of the same text count once.  Classes
that enough pages and tokens share are valid: their texts are the template, and their tags, which nest by path, the
containers that leave slots between them.  The main container is the deepest one that holds most of the slots' text; what
is left in it when the template's texts are taken out is the main text.  Slots beside it count if they hold a fair share
of the host's text.  Names of tags and classes only break ties: in slots of under half of the host's text they tell menus,
notices, comments and the like, and on hosts of too few pages for a template they decide alone.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches, saved

#: Pages of different text that must share a class, its tokens, and the share of the host's pages from which any number is enough.
LEAST_PAGES, LEAST_TOKENS, MAJORITY = 3, 3, 0.5
#: Share of the text of its pages that a class of fewer pages holds at most, or else its pages are copies of each other.
MOST_SHARE = 0.5
#: Share of a page's text from which a mark does not count; words of a block beside the main container from which it is text.
MARK_SHARE, TEXT_WORDS = 0.5, 4
#: Share of a host's slot text that the main container holds at least, and that an article element does to be it.
MAIN_SHARE, ARTICLE_SHARE = 0.8, 0.5
#: Times that a page holds a container, on average: what repeats is a part of the text and not what holds it.
MOST_TIMES = 1.5
#: Share of a host's slot text from which a slot beside the main container is text, and from which no mark counts in a slot.
FAIR_SHARE, STRONG_SHARE = 0.05, 0.5
#: Share of a block's characters in links from which it is no running text.
LINKED_SHARE = 0.5
#: Bytes of templates up to which they are broadcast, and parts into which a host's pages are dealt beyond that.
BROADCAST_BYTES, PARTS = 32 << 20, 32

#: HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
HIDDEN = frozenset("head title script style noscript template iframe object svg math select button textarea form".split())
OUTSIDE = frozenset("nav header footer aside menu dialog".split())
ARTICLE = frozenset("article main".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: Elements that hold a page or its running text, for which marks never count; first words of names that tell a state.
UNMARKED = frozenset("html body article main p h1 h2 h3 h4 h5 h6 blockquote pre".split())
STATES = frozenset("has have with without no is".split())
#: Words of class, id and role that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb "
    "breadcrumbs header masthead footer sidebar aside notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login "
    "comment comments respond replies disqus share sharing social related recommended widget toolbar skip search contentinfo complementary alert".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_PIECES = re.compile(r"[a-z0-9]+")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math")}


@dataclass
class Block:
    text: str
    path: str  # open structural elements with their classes
    hidden: bool  # never text: forms, hidden elements
    out: bool  # inside something whose name says that it is not the article
    inside: bool  # inside an article element
    linked: bool  # mostly links


def _marked(names: list[str], marks: frozenset[str] = MARKS) -> bool:
    """Whether a name has a word that marks what is not the article; names of a state (has-sidebar) do not count."""
    pieces = [_PIECES.findall(n) for n in names]
    return any(w in marks for p in pieces if p and p[0] not in STATES for w in p)


def _kind(tag: str, attributes: str) -> tuple[str, bool, bool, list[str], bool]:
    """A path step, whether it is hidden, whether its tag is not the article's, names that may mark it so, whether it is the article."""
    found = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
    step = tag + "".join(f".{w.replace('/', '-')}" for w in found.get("class", "").split()) if found else tag
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or tag in HIDDEN
    article = tag in ARTICLE or found.get("role") in ("main", "article")
    names = [] if article or tag in UNMARKED else [w for k in ("class", "id", "role") for w in found.get(k, "").split()]
    return step, hidden, tag in OUTSIDE, names, article


def blocks_of(page: str | None) -> tuple[list[Block], list[str]]:
    """Text blocks in page order, and the paths of the structural tags."""
    page, blocks, tags = page or "", [], []
    stack: list[tuple[str, str, bool, bool, bool, tuple[int, ...]]] = []  # tag, path, hidden, out, inside, marked elements
    run: list[str] = []
    within: list[tuple[int, ...]] = []  # marked elements around each block
    n_marked = links = in_link = 0

    def close_block() -> None:
        nonlocal links
        if run:
            raw = "".join(run)
            text = " ".join(_html.unescape(raw).split())
            run.clear()
            if text:
                top = stack[-1] if stack else ("", "", False, False, False, ())
                blocks.append(Block(text, *top[1:5], links > LINKED_SHARE * len(raw.strip())))
                within.append(top[5])
        links = 0

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            run.append(page[at:])
            break
        if m.start() > at:
            run.append(page[at : m.start()])
            if in_link:
                links += m.start() - at
        at = m.end()
        if m[0] == "<":
            run.append("<")
            continue
        tag = (m[2] or "").lower()
        if not tag or tag in INLINE:
            if tag == "a":
                in_link = not m[1]
            continue
        if m[1]:  # an end tag closes what is open inside it; a stray one nothing
            close_block()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        close_block()
        if tag in VOID:
            continue
        if tag in CLOSES_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            while stack and (stack[-1][0] == "p" or stack[-1][0] == tag and tag not in ("div", "section", "article", "ul", "ol", "table", "blockquote", "nav", "aside", "main", "header", "footer", "form", "fieldset", "menu")):
                stack.pop()
        if tag in _RAW and not m[3].endswith("/"):
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        step, hidden, out, names, inside = _kind(tag, m[3])
        above = stack[-1] if stack else ("", "", False, False, False, ())
        own_header = tag == "header" and above[4]  # the heading of the article itself
        out = out and not own_header
        marks = above[5]
        if _marked(names, MARKS - {"header"} if own_header else MARKS):
            marks, n_marked = (*marks, n_marked), n_marked + 1
        path = f"{above[1]}/{step}" if tag not in ("p", "html", "body") else above[1]
        if not m[3].endswith("/"):
            stack.append((tag, path, above[2] or hidden, above[3] or out, above[4] or inside, marks))
        tags.append(f"{path}/p" if tag == "p" else path)
    close_block()
    # a mark is a hint: it does not count for an element that holds most of the page's text
    if n_marked:
        chars = [0] * n_marked
        for block, marks in zip(blocks, within, strict=True):
            for k in marks if not (block.out or block.hidden) else ():
                chars[k] += len(block.text)
        most = MARK_SHARE * sum(len(x.text) for x in blocks if not (x.out or x.hidden))
        for block, marks in zip(blocks, within, strict=True):
            block.out = block.out or any(chars[k] < most for k in marks)
    return [b for b in blocks if not b.hidden], tags


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


@dataclass(frozen=True)
class Template:
    """What a host's pages share: hashes of texts, the main container's path, and the paths of slots of some weight."""

    texts: frozenset[int] = frozenset()
    container: str | None = None
    fair: frozenset[str] = frozenset()  # beside the container, FAIR_SHARE of the slots' text at least
    strong: frozenset[str] = frozenset()  # STRONG_SHARE at least: what their names say does not count


def _below(path: str, container: str) -> bool:
    return path == container or path.startswith(container + "/")


def extract(page: str | None, template: Template = Template()) -> str:
    """The text that is left in the slots of the main container, given a host's template.

    A block beside the container is text if its slot has a fair share of the host's text, it has TEXT_WORDS words, most of
    it is no link and no name speaks against it.  On a page without the container, the article counts, and without one
    all that is no template text and has no name that speaks against it.
    """
    blocks = blocks_of(page)[0]
    own = [template.container is not None and _below(b.path, template.container) for b in blocks]
    if any(own):
        chosen = [
            b
            for b, main in zip(blocks, own, strict=True)
            if (not b.out or b.path in template.strong) and (main or b.path in template.fair and len(b.text.split()) >= TEXT_WORDS and not b.linked)
        ]
    else:
        free = [b for b in blocks if not b.out]
        chosen = [b for b in free if b.inside] or free
    return " ".join(b.text for b in chosen if _hash(f"{b.path}\n{b.text}") not in template.texts)


#: The token of a page itself.
_ROOT = _hash("")


def host_of(url: Column) -> Column:
    """The host of a URL; '' if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


def occurrence_classes(pages: DataFrame) -> DataFrame:
    """(host, vector, n_pages, n_tokens, chars, page_chars, times, texts, tags): the equivalence classes of tags and texts on each host.

    ``vector`` is a commutative hash of (page text, count) over the pages that hold a token; ``n_pages`` counts pages of
    different text.  ``texts`` holds the hashes of the class's texts that may be template, ``tags`` the paths of its tags;
    ``chars`` and ``page_chars`` are the characters of its texts, and of all texts of its pages, a page; ``times`` is how often a page holds
    each of its tokens.
    """
    return _classes(_tokens(pages))


def _classes(tokens: DataFrame) -> DataFrame:
    text = F.col("is_text")
    return tokens.groupBy("host", "vector", "n_pages").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.coalesce(F.sum(F.when(text, F.col("chars") / F.col("n_pages"))), F.lit(0.0)).alias("chars"),
        F.max(F.col("page_chars") / F.col("n_pages")).alias("page_chars"),
        F.max(F.col("times") / F.col("n_pages")).alias("times"),
        F.collect_list(F.when(text, F.col("token"))).alias("texts"),
        F.collect_list(F.when(~F.col("is_text"), F.col("path"))).alias("tags"),
    )


def _tokens(pages: DataFrame) -> DataFrame:
    """(host, token, path, is_text, inside, chars, page_chars, times, n_pages, vector) of each token of each host.

    Pages of the same text, without what names speak against, count once; each page with tags or text has the root, whose
    path is ''.
    """

    def rows(columns):
        for host, page in zip(*columns, strict=True):
            blocks, tags = blocks_of(page)
            seen: dict[tuple[int, str, bool, bool], list[int]] = {}
            for t in tags:
                seen.setdefault((_hash(t), t, False, False), [0, 0])[0] += 1
            if blocks or tags:
                seen[_ROOT, "", False, False] = [1, 0]
            for b in blocks:
                got = seen.setdefault((_hash(f"{b.path}\n{b.text}"), b.path, True, b.inside), [0, 0])
                got[0] += 1
                got[1] += len(b.text)
            same = _hash("\n".join(b.text for b in blocks if not b.out))
            all_chars = sum(len(b.text) for b in blocks)
            for (token, path, is_text, inside), (n, chars) in seen.items():
                yield host, token, path, is_text, inside, n, chars, all_chars, same, _hash(f"{same}:{n}")

    held = pages.select(host_of(F.col("url")).alias("host"), "html")
    found = map_batches(held, rows, "host string, token long, path string, is_text boolean, inside boolean, times long, chars long, page_chars long, same long, mark long")
    kinds = [F.min("path").alias("path"), F.max("is_text").alias("is_text"), F.max("inside").alias("inside")]
    once = found.groupBy("host", "token", "same").agg(*kinds, F.max("times").alias("times"), F.max("chars").alias("chars"), F.max("page_chars").alias("page_chars"), F.min("mark").alias("mark"))
    return once.groupBy("host", "token").agg(
        *kinds, F.sum("times").alias("times"), F.sum("chars").alias("chars"), F.sum("page_chars").alias("page_chars"), F.count(F.lit(1)).alias("n_pages"), F.bit_xor("mark").alias("vector")
    )


def templates(pages: DataFrame) -> DataFrame:
    """(host, template, container, fair, strong): what :class:`Template` holds, for each host with a valid class.

    A class is valid if LEAST_PAGES pages of different text hold it, and either most pages of the host do, or it has
    LEAST_TOKENS tokens, a tag among them, and its pages hold other text as well.  Its texts are the template; its tags,
    which nest by path, are the containers, and the text below a container that is not template fills its slots.  The
    main container is the deepest that most pages hold once and that holds MAIN_SHARE of it, or an article element that holds ARTICLE_SHARE.
    """
    tokens = saved(_tokens(pages))
    hosts = tokens.where(~F.col("is_text") & (F.col("token") == _ROOT)).select("host", F.col("n_pages").alias("of"))
    layout = (F.size("tags") > 0) & (F.col("n_tokens") >= LEAST_TOKENS) & (F.col("chars") <= MOST_SHARE * F.col("page_chars"))
    enough = (F.col("n_pages") >= LEAST_PAGES) & ((F.col("n_pages") >= MAJORITY * F.col("of")) | layout)
    valid = saved(_classes(tokens).join(hosts, "host").where(enough).select("host", "vector", "n_pages", "times", "texts", "tags"))
    # characters in slots by path, then by every path above
    slots = tokens.where("is_text").join(valid.select("host", "vector", "n_pages"), ["host", "vector", "n_pages"], "left_anti")
    slots = slots.groupBy("host", "path").agg(F.sum("chars").alias("chars"), F.max("inside").alias("inside"))
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    held = slots.select("host", F.explode(above).alias("path"), "chars", "inside").groupBy("host", "path").agg(F.sum("chars").alias("chars"), F.max("inside").alias("inside"))
    whole = held.where("path = ''").select("host", F.col("chars").alias("whole"))
    containers = valid.where(F.col("times") <= MOST_TIMES).select("host", F.explode("tags").alias("path")).distinct().join(held, ["host", "path"]).join(whole, "host")
    article = F.col("inside") & F.col("path").rlike(r"/(?:article|main)(?:\.[^/]*)?$") & (F.col("chars") >= ARTICLE_SHARE * F.col("whole"))
    containers = containers.where((F.col("chars") >= MAIN_SHARE * F.col("whole")) | article)
    rank = F.struct(F.size(F.split("path", "/")), "chars", "path")
    chosen = containers.groupBy("host").agg(F.max_by("path", rank).alias("container"))
    texts = valid.groupBy("host").agg(F.flatten(F.collect_list("texts")).alias("template"))
    # at most 1 / FAIR_SHARE paths a host
    fair = slots.join(whole, "host").where(F.col("chars") >= FAIR_SHARE * F.col("whole"))
    fair = fair.groupBy("host").agg(F.collect_list("path").alias("fair"), F.collect_list(F.when(F.col("chars") >= STRONG_SHARE * F.col("whole"), F.col("path"))).alias("strong"))
    return texts.join(chosen, "host", "left").join(fair, "host", "left")


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Null and empty html give an empty text; a null or hostless url belongs to the host ''; repeated rows stay; other columns
    are left out.  The hosts' templates are broadcast while they are small, so that no page is shuffled; beyond that pages
    are dealt out by host and, as one host may hold most of them, by a part of their id.
    """

    def rows(columns):
        for page_id, url, page, texts, container, fair, strong in zip(*columns, strict=True):
            text = extract(page, Template(frozenset(texts or ()), container, frozenset(fair or ()), frozenset(strong or ())))
            yield page_id, url, text, len(text)

    known = saved(templates(pages))
    names = F.octet_length("host") + F.coalesce(F.octet_length("container"), F.lit(0)) + F.coalesce(F.octet_length(F.array_join("fair", "")), F.lit(0))
    size = known.agg(F.coalesce(F.sum(8 * F.size("template") + 3 * names + 64), F.lit(0)).alias("n")).first()["n"]
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    if size <= BROADCAST_BYTES:
        joined = held.join(F.broadcast(known), "host", "left")
    else:
        part = F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)).cast("int")
        each = known.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        joined = held.withColumn("part", part).join(each, ["host", "part"], "left")
    return map_batches(joined.select("page_id", "url", "html", "template", "container", "fair", "strong"), rows, "page_id long, url string, text string, n_chars long", most=512)
