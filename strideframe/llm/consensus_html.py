"""Main text of web pages by consensus of their host.

Each page is read once into blocks of text with the path of containers around
them. Containers are scored by the prose they hold, and every page votes with
the generalised path (tags and classes, digits dropped) of its best container.
Spark sums the votes per host; pages are then extracted from the path that won
on their host, or from their own best container where they lack that path.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.session import settle

# HTML element names and their roles.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "template", "noscript"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CONTAINER = {"article", "body", "center", "div", "html", "main", "section", "table", "tbody", "td", "tr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: elements whose text is never part of the article
ASIDE = {"aside", "button", "dialog", "footer", "form", "head", "header", "menu", "nav", "search", "select", "svg", "canvas", "object", "audio", "video", "math"}
#: words in class or id that mark text beside the article
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal",
    "newsletter", "subscribe", "subscription", "signup", "login", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "side", "widget", "header", "masthead", "topbar", "footer", "bottom", "copyright",
    "comment", "comments", "disqus", "replies", "respond", "share", "sharing", "social", "related", "recommended", "recommendations", "pagination", "pager", "tags", "toolbar", "skip", "form", "search", "hidden",
}
#: words before and after a mark in the name of a part, as in site-footer, related-posts or post-comments
BEFORE = {"global", "inner", "left", "main", "outer", "primary", "right", "secondary", "site", "top"}
BEFORE_TEXT = {"article", "entry", "page", "post"}
AFTER = {"area", "bar", "block", "blocks", "box", "btn", "button", "buttons", "container", "icons", "inner", "item", "items", "left", "link", "links", "list", "outer", "panel", "posts", "right", "section", "slot", "top", "unit", "widgets", "wrap", "wrapper"}
#: marks that are also plain or layout words: no mark by leading a longer name
LOOSE = {"hidden", "side", "header", "form", "search", "alert", "notice", "notices", "social", "share", "sharing", "tags", "related", "bottom", "comment", "skip", "menu", "banner", "promotion", "consent", "login", "navigation", "replies", "respond"}
#: marks of text that is no article wherever it stands and however long it is
FOREIGN = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "newsletter", "subscribe", "subscription"}
#: marks of text by readers or about other pages: often long, and made of articles of their own
OTHERS = {"comment", "comments", "disqus", "replies", "respond", "related", "recommended", "recommendations"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}

#: the table of winning paths, a row per host, travels whole up to this size
BROADCAST_BYTES = 16 << 20
#: one page in so many makes a host a large one; no more hosts than this can be
LARGE_SHARE = 1000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+))?)?|=")
_NAMES = {"class", "id", "role", "hidden", "aria-hidden", "style"}
_WORDS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")

Block = tuple[tuple[int, ...], str, int]


def _attributes(text: str) -> dict[str, str]:
    """The wanted attributes, read one after another as name or name=value; the first of a name counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        if m[1] and (name := m[1].lower()) in _NAMES:
            found.setdefault(name, m[2] or m[3] or m[4] or "")
    return found


def _marks(token: str, whole: bool) -> set[str]:
    """The marks that name a part beside the article: the token itself, its leading word, or a mark among words for parts."""
    token = token.lower() if whole else token
    words = [w.lower() for w in _WORDS.split(token) if w]
    named = MARKS.intersection(words)
    if not named or whole and token not in MARKS:
        return set()
    if words[0] in MARKS - LOOSE:
        return named
    # the header of a post or page holds its title
    before = BEFORE if "header" in named else BEFORE | BEFORE_TEXT
    first = next(i for i, w in enumerate(words) if w in MARKS)
    last = max(i for i, w in enumerate(words) if w in MARKS)
    fits = all(w in before for w in words[:first]) and all(w in MARKS for w in words[first:last]) and all(w in AFTER for w in words[last + 1:])
    return named if fits else set()


def _beside(tag: str, attributes: str) -> tuple[bool, set[str], dict[str, str]]:
    """Whether an element never holds the article, the marks in its class and id, and its attributes."""
    found = _attributes(attributes) if attributes else {}
    role = found.get("role", "").strip().lower()
    if tag in ASIDE or role in ROLES or "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.IGNORECASE):
        return True, set(), found
    if tag in ("html", "body", "article", "main") or role == "main":
        return False, set(), found
    classes = found.get("class", "").split()
    # headings and words in a line are marked by whole classes alone; ids of headings and sections are anchors
    whole = tag in HEADINGS or tag not in BLOCK
    named = set().union(*(_marks(c, whole) for c in classes))
    if tag in HEADINGS:
        named -= LOOSE - {"hidden"}
    if not whole and tag != "section" and "section" not in classes:
        named |= _marks(found.get("id", ""), False)
    return False, named, found


def _step(tag: str, classes: str) -> str:
    """A path step: the tag and its classes in order of name, digits dropped."""
    named = sorted({c for c in (re.sub(r"[\d_-]+$|\d+", "", c.lower()) for c in classes.split()) if c})
    return ".".join([tag, *named])


def _prose(text: str, linked: int) -> int:
    """How much prose a block holds: its text outside links, and its punctuation."""
    return max(0, len(text) - 2 * linked) + 10 * sum(text.count(c) for c in ".,;")


class Page:
    """Blocks of a page and its containers.

    ``blocks`` are (container numbers from the outermost, text, linked characters);
    ``paths`` the generalised path of each container.
    """

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.paths: list[str] = ["", ]
        #: the container around each container, and the containers that are articles
        self._parent: list[int] = [0]
        self._own_article: set[int] = set()
        self._text: list[str] = []
        self._linked = 0
        # marked elements: their marks; the marked elements around each block, and around each article or main
        self._marked: list[set[str]] = []
        self._around: list[tuple[int, ...]] = []
        self._articles: list[tuple[str, tuple[int, ...]]] = []
        self._read(source)
        if self._marked:
            dropped = self._dropped()
            self.blocks = [b for b, around in zip(self.blocks, self._around, strict=True) if dropped.isdisjoint(around)]

    def _flush(self, inside: tuple[int, ...], marks: tuple[int, ...]) -> None:
        text = " ".join(html.unescape("".join(self._text)).split())
        if text:
            self.blocks.append((inside, text, self._linked))
            self._around.append(marks)
        self._text, self._linked = [], 0

    def _dropped(self) -> set[int]:
        """Marked elements to leave out: all but those around the article.

        A marked element stays if it encloses a main, the page's only article,
        or, without either, most of the prose. Where nothing else is left, all
        stay but advertising and consent.
        """
        every = set(range(len(self._marked)))
        foreign = {k for k in every if self._marked[k] & FOREIGN}
        plain = {k for k in every - foreign if not self._marked[k] & OTHERS}
        kept = {k for tag, around in self._articles if tag == "main" for k in around}
        articles = [set(around) - kept for _, around in self._articles]
        if articles and all(articles):
            kept |= min((a for a in articles if a <= plain), key=len, default=set())
        if not any(set(around) <= kept for _, around in self._articles):
            prose = [_prose(text, linked) for _, text, linked in self.blocks]
            held = dict.fromkeys(plain, 0)
            for around, n in zip(self._around, prose, strict=True):
                for k in plain.intersection(around):
                    held[k] += n
            kept |= {k for k, n in held.items() if 2 * n > sum(prose)}
        if not any(kept.issuperset(around) for around in self._around):
            kept |= every - foreign
        return every - kept

    def _read(self, source: str) -> None:
        # open elements: tag, containers around its text, whether it stands beside the article, marked elements around its text
        stack: list[tuple[str, tuple[int, ...], bool, tuple[int, ...]]] = []
        inside, beside, marks, links, at, size = (0,), False, (), 0, 0, len(source)
        while at < size:
            m = _TAG.search(source, at)
            piece = source[at:m.start() if m else size]
            if piece and not beside:
                self._text.append(piece)
                if links:
                    self._linked += len(piece.strip())
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if tag in BLOCK and not beside:
                    self._flush(inside, marks)
                if depth is None:
                    continue
                if tag not in BLOCK and any(s[0] in BLOCK for s in stack[depth + 1:]):
                    continue
                links = max(0, links - sum(s[0] == "a" for s in stack[depth:]))
                del stack[depth:]
                before = marks
                inside, beside, marks = stack[-1][1:] if stack else ((0,), False, ())
                if marks != before:
                    self._flush(inside, before)
                continue
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(source, at)
                at = source.find(">", stop.start()) + 1 or size if stop else size
                continue
            if tag == "br":
                if not beside:
                    self._text.append(" ")
                continue
            if tag in BLOCK and not beside:
                self._flush(inside, marks)
            if tag in VOID or tag in ("svg", "math") and m[3].endswith("/"):
                continue
            if tag in BLOCK:
                # an open paragraph or item ends where another block begins
                while stack and (stack[-1][0] == "p" or stack[-1][0] == tag == "li" or stack[-1][0] in ("dt", "dd") and tag in ("dt", "dd")):
                    stack.pop()
                    inside, beside, marks = stack[-1][1:] if stack else ((0,), False, ())
            never, named, found = _beside(tag, m[3])
            # classes in code are those of its colours
            named = named if named and not any(s[0] in ("pre", "code") for s in stack) else ()
            if (never or named) and not beside:
                self._flush(inside, marks)
            beside = beside or never
            if named and not beside:
                self._marked.append(named)
                marks = (*marks, len(self._marked) - 1)
            if tag in CONTAINER and not beside:
                self.paths.append(f"{self.paths[inside[-1]]}>{_step(tag, found.get('class', ''))}")
                self._parent.append(inside[-1])
                inside = (*inside, len(self.paths) - 1)
                if tag == "article":
                    self._own_article.add(inside[-1])
            if (tag in ("article", "main") or found.get("role", "").strip().lower() == "main") and not beside:
                self._articles.append(("article" if tag == "article" else "main", marks))
            links += tag == "a"
            stack.append((tag, inside, beside, marks))
        if not beside:
            self._flush(inside, marks)

    def container_scores(self) -> dict[int, float]:
        """Prose in each container: text outside links counts whole for the nearest, less for those around it."""
        out: dict[int, float] = {}
        for inside, text, linked in self.blocks:
            prose = _prose(text, linked)
            for distance, c in enumerate(reversed(inside)):
                out[c] = out.get(c, 0.0) + prose * (1.0, 0.75, 0.5)[min(distance, 2)]
        return out

    def best(self) -> tuple[str, float]:
        """Path and score of the best container; the first of equals."""
        scores = self.container_scores()
        if not scores:
            return "", 0.0
        c = max(scores, key=lambda k: (scores[k], -k))
        return self.paths[c], scores[c]

    def _whole(self, c: int) -> int:
        """The container to take for a winning one: its article, headline, lead and siblings included.

        Without an article, one around it as long as that is not the page itself
        and adds only blocks of its own, without links: no other container.
        """
        at = c
        while at:
            if at in self._own_article:
                return at
            at = self._parent[at]
        while True:
            around = self._parent[c]
            if not around or self.paths[around].rsplit(">", 1)[-1].split(".")[0] in ("html", "body"):
                return c
            if any(linked or inside[-1] != around for inside, _, linked in self.blocks if around in inside and c not in inside):
                return c
            c = around

    def text(self, path: str | None) -> str:
        """Blocks inside the containers with that path, joined; of the page's own best if there are none."""
        wanted = {i for i, p in enumerate(self.paths) if p == path} if path is not None else set()
        if not any(wanted.intersection(b[0]) for b in self.blocks):
            own = self.best()[0]
            wanted = {i for i, p in enumerate(self.paths) if p == own}
        wanted = {self._whole(c) for c in wanted}
        return "\n\n".join(b[1] for b in self.blocks if wanted.intersection(b[0]))


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user and port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def votes(pages: DataFrame, url: str = "url", markup: str = "html") -> DataFrame:
    """host, path, n, weight: pages that vote for each path of a host, and their summed scores."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: dict[tuple[str, str], list[float]] = {}
            for host, source in zip(batch.column(0), batch.column(1), strict=True):
                path, score = Page(source.as_py() or "").best()
                if score > 0:
                    t = tally.setdefault((host.as_py(), path), [0, 0.0])
                    t[0] += 1
                    t[1] += score
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in tally], pa.string()), pa.array([k[1] for k in tally], pa.string()), pa.array([int(v[0]) for v in tally.values()], pa.int64()), pa.array([round(v[1]) for v in tally.values()], pa.int64())], names=["host", "path", "n", "weight"])

    cast = pages.select(host_of(F.col(url)).alias("host"), F.col(markup).alias("markup")).mapInArrow(scan, "host string, path string, n long, weight long")
    return cast.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))


def _with_path(base: DataFrame, winner: DataFrame) -> DataFrame:
    """Pages with their host's path. Pages stay where they are if the winners are few enough to travel.

    Otherwise winners of large hosts still do, which a share of all pages
    bounds in number, and only pages of the other hosts are shuffled.
    """
    size = winner.agg(F.sum(F.octet_length("host") + F.octet_length("path")).alias("bytes"), F.sum("n").alias("n")).first()
    if (size["bytes"] or 0) <= BROADCAST_BYTES:
        return base.join(F.broadcast(winner.select("host", "path")), "host", "left")
    large = winner.filter(F.col("n") * LARGE_SHARE >= size["n"]).select("host", F.col("path").alias("large"))
    told = base.join(F.broadcast(large), "host", "left")
    rest = told.filter("large IS NULL").join(winner.select("host", "path"), "host", "left").drop("large")
    return told.filter("large IS NOT NULL").withColumnRenamed("large", "path").unionByName(rest)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: the main text of each page, one row per page.

    Null, empty and text-free pages give an empty text. A page without a host
    shares the consensus of all such pages. Ties of votes go to the larger
    summed score, then to the path that is first. Unclosed and truncated markup
    is read as far as it goes. Repeated rows get equal results.
    """
    # the path of most votes: highest count, then weight, then the first in order
    winner = votes(pages, url, markup).groupBy("host").agg(F.min_by("path", F.struct((-F.col("n")).alias("n"), (-F.col("weight")).alias("w"), "path")).alias("path"), F.sum("n").alias("n"))
    winner = settle(winner, "winners")
    kind = pages.schema[page_id].dataType.simpleString()
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(markup).alias("markup"), host_of(F.col(url)).alias("host"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(source.as_py() or "").text(path.as_py()) for source, path in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = _with_path(base, winner).select("page_id", "url", "markup", "path")
    return joined.mapInArrow(scan, f"page_id {kind}, url string, text string, n_chars long")
