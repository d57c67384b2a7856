"""Main text of web pages by consensus of the pages of a host.

First pass: every page scores its containers and votes for the generalised
tag-class path of the best one. The votes are summed per host (combined before
the shuffle), and the leading paths of each host go back to its pages. Second
pass: a page is read again under the first of those paths that holds a fair
share (`FAIR`) of what its own best container has, and under that container
where there is none.

A path is the chain of all elements around a container, each with its sorted
classes, runs of digits as `#`; it travels as a digest and the last element.

What is left out: elements that are noise by their tag or role or are hidden, and
elements one of whose whole classes (or the id) is made of noise words and
neutral ones only, so `site-footer` and `post-comments` but neither `has-sidebar`
nor `social-studies`; the header of a post or article is its own. An element of the
latter kind (comments excepted), or a form, stays if it holds the page's only `main`
or `article`, or (unless it is marked as advert, consent or the like) another
container with most of the page's text. What no name tells, repetition does: a block
that stands in the main text of at least half of a host's different pages (MANY of
them at least) is dropped, unless it is all that a page has.

What is taken in besides the winning containers: the prose beside them, which is
their parent's own text and their sibling containers, if it has the title, or a
sentence and LEAST characters, and few links (LINKS); beside an `article` or a `main` only what stands
before it. So a lead, an introduction or the smaller of several parts is not lost.

Defined cases: null or empty html gives an empty text; a null url has the host
""; text without any tags is its own main text; a page cut off inside a tag
loses that tag only; pages of any length and nesting are read whole, in time
proportional to their length; of containers with equal scores the first counts,
of paths with equal votes the one with more text, then the smaller; repeated
rows are read each; of siblings of any size the prose counts, whichever has won; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrowtext import column
from docloom.llm.common import LOWER, UPPER, checkpoint, map_arrow

BROADCAST_PATHS = 20_000
LOWER_CASE = str.maketrans(UPPER, LOWER)

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DIGITS = re.compile(r"\d+")

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes noembed".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset("body article main section div td center content".split())
NOISE_TAGS = frozenset("nav header footer aside script style noscript template iframe svg button select textarea dialog menu head title object canvas audio video".split())
LAYOUT_WORDS = frozenset(
    "banner breadcrumb breadcrumbs footer foot header masthead menu menubar modal nav navbar navigation notice notices pager pagination "
    "gdpr sharing share sidebar sidebars skip social tags toolbar topbar widget widgets disclaimer".split()
)
FOREIGN_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense cookie cookies consent newsletter "
    "notification notifications paywall popup promo promoted promotion recommended related sponsor sponsored subscribe subscription".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
TALK_WORDS = frozenset("discussion discussions forum".split())
NEUTRAL_WORDS = frozenset(
    "area bar block body bottom box col column container form global group holder inner item items left links list main outer page panel "
    "primary right row secondary section site slot text top unit wrap wrapper "
    "article articles button buttons entry facebook fb gdpr google message messages news post posts reader readers signup story thread threads user users".split()
)
OWN_WORDS = frozenset("article entry post story".split())
TOP_WORDS = frozenset("header masthead banner".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert toolbar".split())
CLOSES = {
    **{t: frozenset(["p"]) for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()},
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]),
    "option": frozenset(["option"]),
}
LISTS = frozenset("table ul ol dl".split())
BARRIER = {"li": frozenset(["ul", "ol"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"])}

STOPS = {t: (BARRIER.get(t, CONTAINERS) | LISTS) - closed for t, closed in CLOSES.items()}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: The share of a page's best score that its host's path must have on it, and of a host's votes that a path must have.
FAIR, LEADING = 0.1, 0.1
#: Prose: characters at least, share of them in links at most, an end of a sentence.
LEAST, LINKS = 40, 0.3
_SENTENCE = re.compile(r"[.!?\u2026\u3002\u061f](?:\W|\Z)")
#: Different pages of a host from which repeated blocks are looked for, and the share of them that makes a block repeated.
MANY, REPEATED = 8, 0.5

PLAIN, LAYOUT, FOREIGN, HARD = range(4)  # how sure an element is noise


def _noise(tag: str, attributes: dict[str, str]) -> int:
    if tag in NOISE_TAGS or "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return HARD
    if attributes.get("role", "").lower() in NOISE_ROLES and tag not in ("html", "body", "main"):
        return HARD
    kind = LAYOUT if tag == "form" else PLAIN
    if tag in ("html", "body", "main"):
        return kind
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = {w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w}
        rest = words - (NEUTRAL_WORDS - LAYOUT_WORDS)
        if not rest or not rest <= LAYOUT_WORDS | FOREIGN_WORDS | COMMENT_WORDS | TALK_WORDS:
            continue
        if words & OWN_WORDS and rest <= TOP_WORDS:
            continue
        if rest & COMMENT_WORDS:
            return HARD
        if rest & FOREIGN_WORDS:
            kind = FOREIGN
        elif tag != "article" and tag not in HEADINGS:
            kind = max(kind, LAYOUT)
    return kind


class Page:
    """Elements, and pieces of text with the element each lies in; None as text marks the border of a block."""

    def __init__(self, source: str):
        # of each element, in page order: tag, parent, nearest container (itself included), path, kind of noise, inside a link
        self.tag, self.parent, self.holder, self.path, self.kind, self.link = [""], [-1], [0], [":"], [PLAIN], [False]
        self.pieces: list[tuple[int, str | None]] = []
        self._read(source)
        self.noise = self._judged()
        self.scores = self._scored()

    def _read(self, source: str) -> None:
        stack, places, at, end = [0], {}, 0, len(source)  # places: of each open tag, where it stands in the stack
        pieces = self.pieces

        def cut(depth: int) -> None:
            while len(stack) > depth:
                places[self.tag[stack.pop()]].pop()

        while at < end:
            begin = source.find("<", at)
            if begin < 0:
                pieces.append((stack[-1], source[at:]))
                return
            m = _TAG.match(source, begin)
            if m is None:
                following = source.find("<", begin + 1)
                following = end if following < 0 else following
                pieces.append((stack[-1], source[at:following]))
                at = following
                continue
            if begin > at:
                pieces.append((stack[-1], source[at:begin]))
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if not source.endswith(">", begin, at):
                return  # cut off inside a tag
            if m[1]:
                if places.get(tag):
                    cut(places[tag][-1])
                if tag not in INLINE:
                    pieces.append((stack[-1], None))
                continue
            if tag in VOID:
                if tag not in ("wbr", "img", "input"):
                    pieces.append((stack[-1], None))
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                at = close.start() if close else end
                if close:
                    at = (source.find(">", at) + 1) or end
                continue
            if closes := CLOSES.get(tag):
                last = max((places[t][-1] for t in closes if places.get(t)), default=0)
                if last > max((places[t][-1] for t in STOPS[tag] if places.get(t)), default=0):
                    cut(last)
            if tag not in INLINE:
                pieces.append((stack[-1], None))
            self._add(tag, m[3], stack[-1])
            places.setdefault(tag, []).append(len(stack))
            stack.append(len(self.tag) - 1)

    def _add(self, tag: str, attributes: str, parent: int) -> None:
        found = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(attributes)} if attributes else {}
        path = self.path[parent]
        if tag not in INLINE:
            name = tag
            if tag in CONTAINERS and found.get("class"):
                name += "." + _DIGITS.sub("#", ".".join(sorted(found["class"].lower().split())))
            path = f"{hashlib.blake2b(f'{path}/{name}'.encode('utf-8', 'replace'), digest_size=8).hexdigest()}:{name}"
        self.holder.append(len(self.tag) if tag in CONTAINERS else self.holder[parent])
        self.tag.append(tag)
        self.parent.append(parent)
        self.path.append(path)
        self.kind.append(_noise(tag, found))
        self.link.append(self.link[parent] or tag == "a")

    def _judged(self) -> list[bool]:
        """Which elements are noise or lie in noise."""
        n = len(self.tag)
        most_sure = list(self.kind)  # of an element and those around it
        for k in range(1, n):
            most_sure[k] = max(most_sure[k], most_sure[self.parent[k]])
        stories = [k for k in range(n) if self.tag[k] in ("article", "main") and self.kind[k] == PLAIN]
        free = any(most_sure[k] == PLAIN for k in stories)
        size, largest, story = [0] * n, [0] * n, [False] * n  # of each element: its text; that of the largest plain container in it; an article or main in it
        for k in stories:
            story[k] = True
        for k, text in self.pieces:
            if text is not None and most_sure[k] < FOREIGN:
                size[k] += len(text.strip())
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            size[up] += size[k]
            largest[up] = max(largest[up], largest[k], size[k] if self.kind[k] == PLAIN and self.holder[k] == k else 0)
            story[up] = story[up] or (story[k] and self.kind[k] != HARD)
        noise = [False] * n
        for k in range(1, n):
            spared = (story[k] and not free) or (self.kind[k] == LAYOUT and 2 * largest[k] > size[0])
            noise[k] = noise[self.parent[k]] or self.kind[k] == HARD or (self.kind[k] != PLAIN and not spared)
        return noise

    def _scored(self) -> dict[int, float]:
        """Containers by the text of their blocks: whole for the nearest, half for the next one, links against it."""
        out: dict[int, float] = {}
        for k, text in self.pieces:
            if text is None or self.noise[k] or not (size := len(text.strip())):
                continue
            worth = -size if self.link[k] else size
            for share in (1.0, 0.5, 0.25):
                k = self.holder[k]
                out[k] = out.get(k, 0.0) + share * worth
                if k <= 0 or self.tag[k] in ("article", "main"):
                    break
                k = self.parent[k]
        return {k: v * (1.5 if self.tag[k] in ("article", "main") else 1.0) for k, v in out.items()}

    def best(self) -> tuple[str, float]:
        scores = self.scores
        if not scores:
            return "", 0.0
        k = max(scores, key=lambda k: (scores[k], -k))
        return self.path[k], scores[k]

    def chosen(self, paths: list[str]) -> str:
        """The first of the paths that has a fair share of the page's best score, or the path of its best container."""
        own, most = self.best()
        of: dict[str, float] = {}
        for k, score in self.scores.items():
            of[self.path[k]] = of.get(self.path[k], 0.0) + score
        return next((p for p in paths if of.get(p, 0.0) > 0 and of[p] >= FAIR * most), own)

    def _beside(self, tops: list[int]) -> list[bool]:
        """Which containers hold prose beside the winning ones: their parents' own text, and their siblings with all that is in them."""
        n = len(self.tag)
        up = [self.holder[self.parent[k]] if k and self.holder[k] == k else self.holder[k] for k in range(n)]  # the container around a container
        first: dict[int, int] = {}  # of each parent container the last place up to which text counts
        for k in tops:
            if k:
                early = self.tag[k] in ("article", "main")
                first[up[k]] = max(first.get(up[k], 0), k if early else n)
        out = [False] * n
        if not first:
            return out
        group = [-1] * n  # the sibling (or parent) whose prose an element's text belongs to
        for k in range(n):
            if k in first:
                group[k] = k
            elif self.holder[k] == k:
                around = up[k]
                group[k] = k if around in first else group[around] if group[around] != around or around not in first else -1
            else:
                group[k] = group[self.holder[k]]
        title = [t == "h1" for t in self.tag]
        for k in range(1, n):
            title[k] = title[k] or title[self.parent[k]]
        size, linked, prose = [0] * n, [0] * n, [False] * n
        for k, text in self.pieces:
            g = group[k]
            if g < 0 or text is None or self.noise[k] or not (length := len(text.strip())):
                continue
            if g in first and k > first[g] or g not in first and g > first.get(up[g], n):
                continue
            size[g] += length
            linked[g] += length if self.link[k] else 0
            prose[g] = prose[g] or title[k] or bool(_SENTENCE.search(text))
            size[g] += LEAST if title[k] else 0
        for k in range(n):
            g = group[k]
            late = g in first and k > first[g] or g >= 0 and g not in first and g > first.get(up[g], n)
            out[k] = g >= 0 and not late and prose[g] and size[g] >= LEAST and linked[g] <= LINKS * size[g]
        return out

    def blocks(self, path: str) -> list[str]:
        """The blocks under the outermost elements with that path and of the prose beside them, without noise."""
        inside, tops = [self.path[0] == path] * len(self.tag), []
        for k in range(1, len(self.tag)):
            above = inside[self.parent[k]]
            inside[k] = above or (self.holder[k] == k and self.path[k] == path)
            if inside[k] and not above and not self.noise[k]:
                tops.append(k)
        beside = self._beside(tops)
        blocks: list[list[str]] = [[]]
        for k, text in self.pieces:
            if text is None:
                if blocks[-1]:
                    blocks.append([])
            elif (inside[k] or beside[k]) and not self.noise[k]:
                blocks[-1].append(html.unescape(text))
        return [b for b in (" ".join("".join(block).split()) for block in blocks) if b]

    def text(self, path: str, repeated: frozenset[int] = frozenset()) -> str:
        """The blocks joined, without those that the host repeats (unless nothing else is there)."""
        blocks = self.blocks(path)
        own = [b for b in blocks if digest(b) not in repeated] if repeated else blocks
        return " ".join(own or blocks)


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def host_of(url: str | None) -> str:
    m = re.search(r"://([^/?#]*)", url or "")
    return m[1].translate(LOWER_CASE) if m else ""


_VOTE = "host string, path string, score double, page long, blocks array<long>"
_VOTE_KINDS = [pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.int64())]


def _vote(batches):
    for batch in batches:
        rows = []
        urls = batch.column(0).to_pylist()
        for url, source in zip(urls, column(batch, "_html").to_pylist(), strict=True):
            page = Page(source)
            path, score = page.best()
            if score > 0:
                blocks = page.blocks(path)
                rows.append((host_of(url), path, score, digest("\n".join(blocks)), list({digest(b) for b in blocks})))
        cells = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, _VOTE_KINDS, strict=True)], [x.split()[0] for x in _VOTE.split(", ")])


def votes_of(pages: DataFrame) -> DataFrame:
    """host, path, score, page (digest of its text), blocks (digests) of the pages (url, html) that have a best container."""
    return checkpoint(map_arrow(pages.select("url", F.col("html").alias("_html")), _vote, _VOTE))


def host_paths(votes: DataFrame, share: float = LEADING) -> DataFrame:
    """host, paths: those that at least `share` of a host's voting pages chose, the leading ones first."""
    counted = checkpoint(votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.log1p("score")).alias("weight")))
    all_of = counted.groupBy(F.col("host").alias("_host")).agg(F.sum("n").alias("all"))
    led = counted.join(all_of, F.col("host") == F.col("_host")).where(F.col("n") >= F.lit(share) * F.col("all"))
    leading = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.col("weight")).alias("w"), "path")))
    return led.groupBy("host").agg(F.transform(leading, lambda x: x["path"]).alias("paths"))


def host_repeats(votes: DataFrame) -> DataFrame:
    """host, repeated: the blocks of at least REPEATED of a host's different pages, if it has MANY; at most 1 / REPEATED times the blocks of a page.

    Pages of equal text are one page, so that copies don't make their own text repeated.
    """
    pages = votes.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= MANY)
    once = votes.dropDuplicates(["host", "page"]).join(pages, "host").select("host", "pages", F.explode("blocks").alias("block"))
    often = once.groupBy("host", "block").agg(F.count("*").alias("n"), F.first("pages").alias("pages")).where(F.col("n") >= REPEATED * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("block").alias("repeated"))


def _extract(batches):
    for batch in batches:
        texts = []
        for source, paths, repeated in zip(column(batch, "_html").to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            page = Page(source)
            texts.append(page.text(page.chosen(paths or []), frozenset(repeated or [])))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    votes = votes_of(pages)
    paths = checkpoint(host_paths(votes).join(host_repeats(votes), "host", "left"))
    side = paths.select(F.col("host").alias("_host"), "paths", "repeated")
    if paths.count() <= BROADCAST_PATHS:
        side = F.broadcast(side)
    host = F.translate(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)
    rows = pages.select("page_id", "url", F.col("html").alias("_html"), host.alias("_own"))
    joined = rows.join(side, F.col("_own") == F.col("_host"), "left").select("page_id", "url", "_html", "paths", "repeated")
    return map_arrow(joined, _extract, "page_id long, url string, text string, n_chars long")
