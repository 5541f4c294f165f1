"""Main text of web pages by equivalence-class template deduction.

Distinct pages of one host are compared in groups of about PAGES, dealt by hash where a host has more. A
token is a tag under its parents, a block of text as a whole, or a word in its element. Tokens that share
their occurrence vector (how often each page of the group has them) form a class. A class is valid if enough
pages have it and its tokens come in one order, over and over. The class of tokens that every page has
once is the template's root; its gaps are slots. Every other class is nested in the deepest class of which
one gap holds all of it. Blocks whose text is in valid classes are template; what remains in the slots is data.

The main element is the deepest one that the template has at most once on a page and that holds most of
the data; links count little there, and so does text under elements that tell of navigation, adverts, forms
or comments, while an article element speaks for its text. Within the main element the same telling elements
are left out, and so are elements of the template that hold links alone. A sub-heading that the template has stays if data follows it. A name tells nothing where the main
element itself lies under it. A host with fewer than three distinct pages in a group has no template; there
the elements decide alone.

Defined cases: ids are whole numbers of 64 bits, or missing; a null or empty page gives an empty text; copies of a page count once for the vectors;
a page all of whose main text is on most pages of its host keeps that text; a url without a host counts as
one host; rows are extracted as often as they occur; a text of any length is one run of blocks; extra
columns play no part; an empty table gives no row.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect, bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.storage import cut, partitions

#: Pages of a host that are compared at once.
PAGES = 64
#: Rows (host and number) of a table that is sent to every task; some 20 MB.
HOSTS_SENT = 200_000
#: Distinct pages from which a template is deduced, and the share of them that must have a tag, or a text.
LEAST_PAGES, TAG_SUPPORT, TEXT_SUPPORT = 3, 0.5, 0.8
#: Pages from which words tell a template where no block as a whole does, and the share of a block's words.
WORD_PAGES, WORD_SHARE = 6, 0.8
#: Share of the data that the main element holds.
MAIN_SHARE = 0.6
#: What a word counts in an article, in a link, under a telling element, and in the template.
ARTICLE, LINK, TELLING, REPEATED = 4.0, 0.2, 0.1, 0.02

#: What follows the name in a tag. A quote opens a value after = alone; a value in quotes that holds < or > and ends
#: in a space or in = is a quote that nothing closes, so the tag ends at the next >.
WITHIN = r"""(?:[^>=]++|=\s*+(?:"(?:[^"<>]*+"|[^"]*+(?<![=\s])")|'(?:[^'<>]*+'|[^']*+(?<![=\s])'))?+)*+"""
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)"
    r"|<(?P<raw>script|style|noscript|template|svg|annotation|iframe|object|textarea|select|title|canvas|audio|video)\b" + WITHIN + r">.*?(?:</(?P=raw)\s*>|$)"
    r"|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attr>" + WITHIN + r")>|<[!?][^>]*>",
    re.S | re.I,
)
ATTR = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NOT_IN_NAMES = re.compile(r"[<>./]")
DIGITS = re.compile(r"\d{2,}")

# Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow msqrt msub msubsup msup mtext nobr q rp rt ruby s samp semantics small span strike strong sub sup time tt u var wbr".split())
#: Elements whose end tag may be left out before another of them or before any block.
ENDS_BEFORE_SAME = frozenset("li dt dd tr td th option".split())
SUBHEADINGS = frozenset("h2 h3 h4 h5 h6".split())
#: Elements that hold runs of text, and are no container of an article.
TEXTUAL = frozenset("p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre table thead tbody tfoot tr th figure figcaption caption address".split())
ASIDE = frozenset("nav header footer aside form menu dialog head button fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Names in class and id that tell of what is beside an article, and words that say nothing in a name joined by - or _.
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement adbox adslot sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar footer "
    "sidebar side aside widget widgets related recommended cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist "
    "disqus replies reply respond share sharing social toolbar pagination pager skip copyright legal disclaimer search form".split()
)
NEUTRAL_NAMES = frozenset("area bar block bottom box btn button buttons col column container desktop element group inner item items js l left link links list main mobile outer page panel post posts r right row section site slot thread top unit wrap wrapper".split())

#: A missing id is 0 with no_id, as pandas has no longs with gaps.
EXTRACTED = "page_id long, no_id boolean, url string, text string"

Piece = tuple[str, tuple[str, ...], bool]
#: Path of the element around it, whether in an article, and the pieces: text, telling elements around it, in a link.
Block = tuple[str, bool, list[Piece]]


def _attributes(raw: str) -> tuple[set[str], str, bool, bool]:
    """Names in class and id, the role, if it is hidden, and if it is the body of an article."""
    names, role, hidden, article = set(), "", False, False
    for m in ATTR.finditer(raw):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            names.update(value.split())
        elif key == "role":
            role = value.strip()
        elif key == "itemprop":
            article = value.strip() == "articlebody"
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    return names, role, hidden, article or role == "article"


def _tells(name: str) -> bool:
    """Whether a name of class or id tells of what is beside an article: as a whole, or by all its parts."""
    if name in ASIDE_NAMES:
        return True
    parts = [p for p in re.split("[-_]+", name) if p and not p.isdigit()]
    return len(parts) > 0 and any(p in ASIDE_NAMES for p in parts) and all(p in ASIDE_NAMES or p in NEUTRAL_NAMES for p in parts)


def _is_aside(name: str, names: set[str], role: str, hidden: bool, in_article: bool) -> bool:
    """An article may have a header of its own."""
    if hidden or role in ASIDE_ROLES:
        return True
    if name in ASIDE:
        return not (in_article and name == "header")
    if name in ("main", "body", "html", "h1", "h2", "h3", "p"):
        return False
    if name == "article":
        return bool(names & {"comment", "comments", "reply"})
    return any(map(_tells, names))


def _inside(path: str, element: str) -> bool:
    return path == element or path.startswith(element + "<")


def _name(path: str) -> str:
    """The element that a path ends with."""
    return path[path.rfind("<") + 1 :].split(".", 1)[0]


def _above(path: str) -> str:
    return path[: max(0, path.rfind("<"))]


def _element(token: str | tuple[str, str]) -> str:
    """The element of a tag, or around a text."""
    return token[0] if type(token) is tuple else token[: max(token.rfind(">"), token.rfind("/"))]


class Page:
    """The tags and the blocks of text, in the order of the page."""

    __slots__ = ("items",)

    def __init__(self, html: str):
        self.items: list[str | Block] = []
        stack: list[tuple[str, str, bool, tuple[str, ...], bool]] = []
        path, article, asides, linked, at = "", False, (), False, 0
        pieces: list[Piece] = []
        for m in TOKEN.finditer(html):
            if m.start() > at:
                pieces.append((html[at : m.start()], asides, linked))
            at = m.end()
            name = m["name"]
            if name is None:
                continue
            name = name.lower()
            if name not in INLINE and pieces:
                if any(not p[0].isspace() for p in pieces):
                    self.items.append((path, article, pieces))
                pieces = []
            if m["end"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        _, path, article, asides, linked = stack[k]
                        del stack[k:]
                        break
                self.items.append(f"{path}/{name}")
                continue
            names, role, hidden, body = _attributes(m["attr"]) if m["attr"].strip(" /\n\t") else (set(), "", False, False)
            if name not in INLINE and name not in VOID:
                k = len(stack) - 1
                while k >= 0 and stack[k][0] in INLINE:
                    k -= 1
                if k >= 0 and (stack[k][0] == "p" or stack[k][0] == name and name in ENDS_BEFORE_SAME):
                    _, path, article, asides, linked = stack[k]
                    del stack[k:]
            own = f"{path}<{name}"
            if names:
                own += "." + ".".join(sorted(NOT_IN_NAMES.sub("_", DIGITS.sub("0", n)) for n in names))
            self.items.append(f"{own}>{name}")
            if name not in VOID and not m["attr"].endswith("/"):
                stack.append((name, path, article, asides, linked))
                linked = linked or name == "a"
                if _is_aside(name, names, role, hidden, article):
                    asides = (*asides, own)
                elif name == "article" or body:
                    article = not asides
                if name not in INLINE:
                    path = own
        if at < len(html):
            pieces.append((html[at:], asides, linked))
        if any(not p[0].isspace() for p in pieces):
            self.items.append((path, article, pieces))

    def blocks(self) -> Iterator[Block]:
        return (i for i in self.items if type(i) is tuple)

    def words(self) -> dict[str, set[str]]:
        """By element, the words, and the blocks as a whole (a space before each)."""
        out: dict[str, set[str]] = defaultdict(set)
        for path, _, pieces in self.blocks():
            out[path].update(block_words(pieces), (whole(pieces),))
        return out


def block_words(pieces: list[Piece]) -> list[str]:
    return pieces[0][0].split() if len(pieces) == 1 else "".join([p[0] for p in pieces]).split()


def whole(pieces: list[Piece]) -> str:
    return " " + " ".join(block_words(pieces))


class Template:
    """Classes of tokens by occurrence vector, nested in each other's gaps.

    root: tokens in order. nested: (tokens in order, number of the class around or -1 for the root, its gap).
    """

    def __init__(self, pages: list[Page]):
        self.pages = n = len(pages)
        least_tags, least_texts = max(LEAST_PAGES, TAG_SUPPORT * n), max(LEAST_PAGES, TEXT_SUPPORT * n)
        have: dict[str, Counter] = defaultdict(Counter)
        for p in pages:
            for path, words in p.words().items():
                have[path].update(words)
        #: Texts that enough pages have: no other can be in a valid class.
        often = {path: own for path, c in have.items() if (own := {w for w, k in c.items() if k >= least_texts})}
        places = [self._places(p, often) for p in pages]
        vectors: dict[str | tuple[str, str], list[int]] = defaultdict(lambda: [0] * n)
        for k, own in enumerate(places):
            for token, at in own.items():
                vectors[token][k] = len(at)
        classes: dict[tuple[int, ...], list] = defaultdict(list)
        for token, v in vectors.items():
            if sum(x > 0 for x in v) >= (least_tags if type(token) is str else least_texts):
                classes[tuple(v)].append(token)
        self.classes = {v: frozenset(own) for v, own in classes.items()}
        #: Start tags that no page has twice.
        self.single = {t for v, own in classes.items() if max(v) == 1 for t in own if type(t) is str and ">" in t}
        self.root = self._chain(classes.pop((1,) * n, []), places)
        self.nested: list[tuple[list, int, int]] = []
        self._nest(classes, places)
        texts = [t for own in (self.root, *(c for c, _, _ in self.nested)) for t in own if type(t) is tuple]
        #: By element, the template's words and whole blocks.
        self.texts: dict[str, set[str]] = defaultdict(set)
        for path, w in texts:
            self.texts[path].add(w)

    @staticmethod
    def _places(page: Page, often: dict[str, set[str]]) -> dict[str | tuple[str, str], list[int]]:
        """Where the page has each token, in order."""
        out: dict[str | tuple[str, str], list[int]] = defaultdict(list)
        at = 0
        for item in page.items:
            if type(item) is str:
                out[item].append(at)
                at += 1
                continue
            path, _, pieces = item
            if own := often.get(path):
                words = block_words(pieces)
                if (run := " " + " ".join(words)) in own:
                    out[path, run].append(at)
                    at += 1
                if not own.isdisjoint(words):
                    for w in words:
                        if w in own:
                            out[path, w].append(at)
                        at += 1
                    continue
                at += len(words)
        return out

    @staticmethod
    def _chain(tokens: list, places: list[dict]) -> list:
        """Of tokens that every page has once, those that come in one order on all; the steadiest are taken first."""
        if not tokens:
            return []
        at = {t: [p[t][0] for p in places] for t in tokens}
        ranks: dict = {t: [] for t in tokens}
        for k in range(len(places)):
            for r, t in enumerate(sorted(tokens, key=lambda t, k=k: at[t][k])):
                ranks[t].append(r)
        chain: list = []
        firsts: list[int] = []
        for t in sorted(tokens, key=lambda t: (max(ranks[t]) - min(ranks[t]), at[t][0])):
            k = bisect_left(firsts, at[t][0])
            if (k == 0 or all(a < b for a, b in zip(at[chain[k - 1]], at[t], strict=True))) and (k == len(chain) or all(a < b for a, b in zip(at[t], at[chain[k]], strict=True))):
                chain.insert(k, t)
                firsts.insert(k, at[t][0])
        return chain

    def _nest(self, classes: dict, places: list[dict]) -> None:
        """Valid classes, from the rarest, each in the gap that holds it."""
        borders = [sorted(p[t][0] for t in self.root) for p in places]
        found: list[tuple[list, list[list[int]], int, int]] = []
        for v, tokens in sorted(classes.items(), key=lambda c: (sum(c[0]), c[0])):
            if len(tokens) < 2:
                continue
            order, merged = [], []
            for k, own in enumerate(places):
                seq = sorted((a, t) for t in tokens for a in own.get(t, ())) if v[k] else []
                merged.append([a for a, _ in seq])
                if seq:
                    order = order or [t for _, t in seq[: len(tokens)]]
                    if len(set(order)) < len(tokens) or any(t != order[j % len(order)] for j, (_, t) in enumerate(seq)):
                        break
            else:
                gaps = {bisect(b, a) for b, own in zip(borders, merged, strict=True) for a in own}
                # What the root has within the class's own element, such as the text of the first of a list, parts no gap.
                if len(gaps) > 1 and not all(_inside(_element(t), _element(order[0])) for t in self.root[min(gaps) : max(gaps)]):
                    continue
                around, gap = -1, min(gaps)
                for j, (outer, positions, _, _) in enumerate(found):
                    inner = {(bisect(b, a) % len(outer) if bisect(b, a) < len(b) else 0) for b, own in zip(positions, merged, strict=True) for a in own}
                    if len(inner) == 1 and (g := inner.pop()):
                        around, gap = j, g
                found.append((order, merged, around, gap))
        self.nested = [(order, around, gap) for order, _, around, gap in found]

    def has(self, block: Block) -> bool:
        """Whether a block is template: as a whole or, in larger groups, by nearly all its words."""
        path, _, pieces = block
        own = self.texts.get(path)
        if not own:
            return False
        words = block_words(pieces)
        if " " + " ".join(words) in own:
            return True
        known = sum(w in own for w in words)
        return self.pages >= WORD_PAGES and known >= 3 and known >= WORD_SHARE * len(words)


def main_element(pages: list[Page], template: Template | None) -> str:
    """The path of the element that holds the main text; empty for the whole page."""
    mass: Counter = Counter()
    for p in pages:
        for block in p.blocks():
            path, article, pieces = block
            weight = (ARTICLE if article else 1) * (REPEATED if template is not None and template.has(block) else 1)
            for text, asides, linked in pieces:
                mass[path] += weight * len(text.split()) * (LINK if linked else 1) * (TELLING if asides else 1)
    total: Counter = Counter()
    for path, n in mass.items():
        while path:
            total[path] += n
            path = _above(path)
        total[""] += n
    deep = [p for p, n in total.items() if p and n >= MAIN_SHARE * total[""] and _holds(p, template)]
    main = max(deep, key=lambda p: (p.count("<"), total[p], p), default="")
    # An article is taken whole.
    above = [main]
    while above[-1]:
        above.append(_above(above[-1]))
    return next((p for p in reversed(above) if _name(p) == "article"), main)


def _holds(path: str, template: Template | None) -> bool:
    """Whether an element may be the main one: it is no run of text, and no page of the template has it twice. Articles may come one after another."""
    name = _name(path)
    if name == "article":
        return True
    if template is None:
        return name not in TEXTUAL and name != "td"
    return name not in TEXTUAL and f"{path}>{name}" in template.single


def _link_elements(pages: list[Page], template: Template, main: str) -> set[str]:
    """Elements of the template within the main one that hold links alone."""
    words, links = Counter(), Counter()
    for p in pages:
        for path, _, pieces in p.blocks():
            if _inside(path, main):
                n = sum(len(t.split()) for t, _, _ in pieces)
                k = sum(len(t.split()) for t, _, linked in pieces if linked)
                while len(path) > len(main):
                    words[path] += n
                    links[path] += k
                    path = _above(path)
    return {p for p, n in words.items() if links[p] >= 0.9 * n and _name(p) not in ("p", "h1", "h2", "h3") and f"{p}>{_name(p)}" in template.single}


def _text(page: Page, template: Template | None, main: str, without: set[str]) -> str:
    """The data within the main element, and the heading before it."""
    out: list[str] = []
    waiting: list[str] = []  # headings that the template has, too: they go with the data that follows them
    heading, headed = "", False
    for block in page.blocks():
        path, _, pieces = block
        own = "".join([t for t, asides, _ in pieces if all(_inside(main, a) for a in asides)])
        if template is not None and template.has(block):
            if _name(path) in SUBHEADINGS and _inside(path, main) and own and not own.isspace() and not any(_inside(path, e) for e in without):
                waiting.append(own)
            else:
                waiting.clear()
            continue
        if not own or own.isspace():
            if any(t and not t.isspace() for t, _, _ in pieces):
                waiting.clear()
            continue
        if not _inside(path, main):
            if not out and _name(path) == "h1" and (_inside(main, _above(path)) or _inside(main, _above(_above(path)))):
                heading = own
            continue
        if any(_inside(path, e) for e in without):
            waiting.clear()
            continue
        headed = headed or _name(path) == "h1"
        out += [*waiting, own]
        waiting.clear()
    if out and heading and not headed:
        out.insert(0, heading)
    text = " ".join(out)
    return " ".join((unescape(text) if "&" in text else text).split())


def extract_group(htmls: list[str | None]) -> list[str]:
    """The main text of each page of one host."""
    distinct: dict[str, Page] = {}
    for h in htmls:
        if h and h not in distinct:
            distinct[h] = Page(h)
    pages = list(distinct.values())
    template = Template(pages) if len(pages) >= LEAST_PAGES else None
    main = main_element(pages, template) if template else ""
    without = _link_elements(pages, template, main) if template else set()
    texts = {h: _text(p, template, main, without) if template else "" for h, p in distinct.items()}
    for h, p in distinct.items():  # pages of another kind, and those without a template
        if not texts[h] and template is not None:
            texts[h] = _text(p, template, main_element([p], template), set())
        if not texts[h]:
            texts[h] = _text(p, None, main_element([p], None), set())
    return [texts[h] if h else "" for h in htmls]


def _shrunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["html"] = [None if h is None else zlib.compress(h.encode("utf-8", "replace"), 1) for h in batch["html"]]
        yield batch


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Equal rows fall in one group, which keeps one of them and their number.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("page_id"), F.col(id_col).isNull().alias("no_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    groups = rows.groupBy("host").agg(F.ceil(F.count("*") / PAGES).cast("int").alias("groups"))
    # A table of few hosts is sent to every task, so that the pages are dealt only once, by host and part.
    groups = cut(groups)
    groups = F.broadcast(groups) if groups.count() <= HOSTS_SENT else groups
    dealt = rows.join(groups, "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.col("groups")).cast("int")).drop("groups")
    n = partitions(pages.sparkSession)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups lie one behind another."""
        rest: Counter = Counter()  # distinct rows in the order of their group, and their number
        key = None

        def done() -> Iterator[pd.DataFrame]:
            rows = list(rest)
            texts = extract_group([None if r[2] is None else zlib.decompress(r[2]).decode("utf-8") for r in rows])
            for lo in range(0, max(rest.values()), 1000):
                out = [(r[0], r[3], r[1], t) for r, t in zip(rows, texts, strict=True) for _ in range(min(1000, rest[r] - lo))]
                yield pd.DataFrame(out, columns=["page_id", "no_id", "url", "text"])

        for batch in batches:
            for page, none, url, html, own, part in zip(batch["page_id"], batch["no_id"], batch["url"], batch["html"], batch["host"], batch["part"], strict=True):
                if rest and key != (own, part):
                    yield from done()
                    rest.clear()
                key = (own, part)
                rest[page, url, html, none] += 1
        if rest:
            yield from done()

    # Markup shrinks to a third before it is dealt.
    small = dealt.select("page_id", "no_id", "url", "html", "host", "part").mapInPandas(_shrunk, "page_id long, no_id boolean, url string, html binary, host string, part int")
    out = small.repartition(n, "host", "part").sortWithinPartitions("host", "part", "page_id", "url").mapInPandas(each, EXTRACTED)
    return out.select(F.when(~F.col("no_id"), F.col("page_id")).alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
