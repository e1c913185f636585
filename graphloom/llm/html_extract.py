"""HTML extraction: a template for each host from equivalence classes of tokens.

Tokens are elements, by their path of tags with id and class, and the texts of
blocks, by path and words. A token's occurrence vector holds its count on every
page of a host; a sum of hashes of (page, count) stands for the vector, so
vectors are compared without bringing a host's pages together. Tokens of one
vector form a class. A class is valid if its tokens occur exactly once on each
of its pages, it has an element, and these pages are half of the host's or
more. Valid classes nest by path into the host's template: a text whose class
holds an element around it is a part of the template, all other texts are what
fills its slots. The main region is the template's deepest element that holds
(nearly) all slots, its heading included, or its article. A page's text is what
the region's slots hold. Hosts of few pages take the template of all pages.

Names of tags, classes and roles only help: blocks of menus, adverts, comments
and the like are no prose, unless an article lies inside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, reliable, table
from .url_filter import url_host

#: A host's own template needs so many pages; a valid class so large a share of them; the region so large a share of the slots' prose, an article's region so large a one.
LEAST_PAGES, SUPPORT, SHARE, ARTICLE_SHARE = 4, 0.5, 0.95, 0.5
#: Rows of templates that are sent to every executor; beyond, pages are joined with them by host.
BROADCAST_ROWS = 100_000
EVERY = "*"

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|math|object|canvas|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(id|class|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_HOLDS = frozenset("article main section div body html table ul ol dl blockquote aside nav footer header form td th".split())
_SECTIONS = frozenset(("article", "main"))
_HEADING = "h1"
#: Elements that never hold an article's text.
_OUT_TAGS = frozenset("head nav aside footer header form menu dialog button select fieldset".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_OUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menus|topbar|header|masthead|footer|sidebar|side|aside|widget|widgets|ad|ads|adv|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|sponsors|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|comment|comments|commentlist|disqus|respond|reply|replies|related|recommended|recommendations|breadcrumb|breadcrumbs|pagination|pager|toolbar|search|form|skip|copyright|legal|disclaimer)(?:$|[\s_-]|\d)", re.I
)


#: What a name says of its element's own parts, and names of an article's own parts.
_ABOUT = re.compile(r"^(?:has|no|with|without|is|not)[-_]|(?:^|[-_])(?:article|post|entry|content|page|story)[-_]?(?:header|body|title|content|text)", re.I)


@lru_cache(4096)
def _named(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """(path part, whether the attributes say that the element is outside of an article's text, whether they say that it is the main part)."""
    given = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(attributes)}
    name = tag
    for k, sign in (("id", "#"), ("class", ".")):
        if v := given.get(k):
            name += sign + re.sub(r"\d+", "", " ".join(v.split()))
    role = given.get("role", "").lower()
    out = role in _OUT_ROLES or "hidden" in given or given.get("aria-hidden", "").lower() == "true"
    if not out and tag not in ("html", "body", "article", "main", "h1"):
        out = any(_OUT_NAMES.search(x) and not _ABOUT.search(x) for x in f"{given.get('id', '')} {given.get('class', '')}".split())
    return name, out, role == "main"


def _hash(*parts: int | str) -> int:
    x = xxhash.xxh3_64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


class Page:
    """One walk over a page: its text blocks and its elements, in order."""

    __slots__ = ("blocks", "holds", "kind", "out", "parent", "path", "section")

    def __init__(self, html: str):
        #: (element, text, characters in links)
        self.blocks: list[tuple[int, str, int]] = []
        #: Of each element but inline ones: that around it (-1: none), hash of its path, tag, whether it is out, holds an article, or is one.
        self.parent: list[int] = []
        self.path: list[int] = []
        self.kind: list[str] = []
        self.out: list[bool] = []
        self.holds: list[bool] = []
        self.section: list[bool] = []
        #: (tag, block element around or itself, open links, inside of an article)
        stack: list[tuple[str, int, int, bool]] = []
        none = ("", -1, 0, False)
        top = none
        text: list[str] = []
        links = at = 0
        blocks, known = self.blocks, {}

        def flush() -> None:
            nonlocal links
            if text:
                joined = "".join(text)
                if "&" in joined:
                    joined = unescape(joined)
                if block := " ".join(joined.split()):
                    blocks.append((top[1], block, links))
                text.clear()
                links = 0

        for m in _TOKEN.finditer(html):
            if (begin := m.start()) > at:
                text.append(html[at:begin])
                if top[2]:
                    links += begin - at
            at = m.end()
            tag = m[3]
            if not tag:
                continue
            tag = tag.lower()
            inline = tag in _INLINE
            if m[2]:
                for n in range(len(stack) - 1, -1, -1):
                    t = stack[n][0]
                    if t == tag:
                        if not inline:
                            flush()
                        del stack[n:]
                        top = stack[-1] if stack else none
                        break
                    if t not in _INLINE and (inline or (tag not in _HOLDS and t in _HOLDS)):
                        break  # closes nothing that holds it
                continue
            if tag == "br":
                text.append(" ")
                continue
            if not inline:
                flush()
                ends = _CLOSES.get(tag, ())
                for n in range(len(stack) - 1, -1, -1):
                    t = stack[n][0]
                    if t == "p" or t in ends:
                        del stack[n:]
                        top = stack[-1] if stack else none
                        break
                    if t in _HOLDS:
                        break
            if tag in _VOID:
                continue
            name, out, main = _named(tag, m[4]) if m[4] else (tag, False, False)
            section = tag in _SECTIONS or main
            around, inside = top[1], top[3]
            if inline:
                if out and not links and not text:  # a hidden or foreign inline element is a block of its own
                    inline = False
                else:
                    top = (tag, around, top[2] + (tag == "a"), inside)
                    stack.append(top)
                    continue
            if tag == "header" and inside:
                out = False  # an article's own header keeps its headings
            elif tag in _OUT_TAGS:
                out = True
            above = self.path[around] if around >= 0 else 0
            path = known.get((above, name))
            if path is None:
                path = known[above, name] = _hash(above, name)
            if section:
                n = around
                while n >= 0 and not self.holds[n]:
                    self.holds[n] = True
                    n = self.parent[n]
            top = (tag, len(self.parent), top[2], inside or section)
            for held, x in ((self.parent, around), (self.path, path), (self.kind, tag), (self.out, out), (self.holds, False), (self.section, section)):
                held.append(x)
            stack.append(top)
        if at < len(html):
            text.append(html[at:])
        flush()

    def left_out(self) -> list[bool]:
        """Of each element, whether it or one around it is out and holds no article."""
        made: list[bool] = []
        for p, out, holds in zip(self.parent, self.out, self.holds):
            made.append((p >= 0 and made[p]) or (out and not holds))
        return made

    def text(self, region: int | None, fixed: frozenset[int]) -> str:
        """Texts of the slots in ``region``; a page without it, or without any slot there, has those of its articles, or all that is not left out."""
        gone, inside, article = self.left_out(), [], []
        for p, path, section in zip(self.parent, self.path, self.section):
            inside.append(path == region or (p >= 0 and inside[p]))
            article.append(section or (p >= 0 and article[p]))
        own = [b for b in self.blocks if b[0] < 0 or not gone[b[0]]]
        some = [b for b in own if b[0] >= 0 and inside[b[0]]] or [b for b in own if b[0] >= 0 and article[b[0]]] or own
        slots = [b for b in some if b[0] < 0 or _hash(self.path[b[0]], "", b[1]) not in fixed] if fixed else some
        return "\n".join(b[1] for b in slots or some)


_SUMS = "host string, token bigint, parent bigint, kind string, pages bigint, ones bigint, prose bigint, vector bigint"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a batch by (host, token): that around it, its kind (tag; "": a text), pages, pages with one, prose characters inside, vector.

    The token 0 stands for the page.
    """
    for b in batches:
        sums: dict[tuple[str, int], list] = {}
        for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
            page = Page(html or "")
            gone, prose = page.left_out(), [0] * len(page.parent)
            #: token: [around, kind, count, prose]
            seen: dict[int, list] = {0: [0, "", 1, 0]}
            for e, text, links in page.blocks:
                if e < 0 or gone[e]:
                    continue
                n = max(0, len(text) - links)
                prose[e] += n
                seen[0][3] += n
                t = seen.setdefault(_hash(page.path[e], "", text), [page.path[e], "", 0, 0])
                t[2] += 1
                t[3] += n
            for e in range(len(prose) - 1, -1, -1):  # what is around stands before
                if (p := page.parent[e]) >= 0:
                    prose[p] += prose[e]
                kind = "section" if page.section[e] else page.kind[e]
                t = seen.setdefault(page.path[e], [page.path[p] if p >= 0 else 0, "" if gone[e] and not kind else kind, 0, 0])
                t[2] += 1
                t[3] += prose[e]
            own = xxhash.xxh64_intdigest((html or "").encode("utf-8", "replace"))
            for token, (around, kind, n, inside) in seen.items():
                s = sums.setdefault((host, token), [around, kind, 0, 0, 0, 0])
                s[2] += 1
                s[3] += n == 1
                s[4] += inside
                s[5] += (own * (2 * n + 1) & 0xFFFFFFFFFFFFFFFF) >> 24
        cols = list(zip(*((*k, *v) for k, v in sums.items()))) or [()] * 8
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in _SUMS.split(", ")])


def token_classes(pages: DataFrame) -> DataFrame:
    """Tokens of the valid classes of every host of ``pages`` (host, html) with LEAST_PAGES, and of all pages (host ``*``).

    Returns host, host_pages, host_prose and tokens: token, parent (the token around), kind, pages, prose, vector.
    """
    arrow_batches(pages.sparkSession)
    sums = pages.select("host", "html").mapInArrow(_counts, _SUMS)
    first = [F.first("parent").alias("parent"), F.first("kind").alias("kind")]
    added = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    sums = reliable(sums.groupBy("host", "token").agg(*first, *[F.sum(c).alias(c) for c in ("pages", "ones", "prose")], added("vector")))
    every = sums.groupBy("token").agg(*first, *[F.sum(c).alias(c) for c in ("pages", "ones", "prose")], added("vector"))
    sums = sums.unionByName(every.withColumn("host", F.lit(EVERY)))
    there = sums.where("token = 0").select("host", F.col("pages").alias("host_pages"), F.col("prose").alias("host_prose"))
    there = there.where((F.col("host_pages") >= LEAST_PAGES) | (F.col("host") == EVERY))
    valid = sums.where("token <> 0 AND ones = pages").join(there, "host").where(F.col("pages") >= SUPPORT * F.col("host_pages"))
    return valid.groupBy("host").agg(F.first("host_pages").alias("host_pages"), F.first("host_prose").alias("host_prose"), F.collect_list(F.struct("token", "parent", "kind", "pages", "prose", F.col("vector").cast("string").alias("vector"))).alias("tokens"))


def deduced(pages: int, prose: int, tokens: list[dict]) -> tuple[int | None, list[int]]:
    """(main region, texts of the template) of a host with so many pages and so much prose, from its valid tokens."""
    elements = {t["token"]: t for t in tokens if t["kind"]}
    texts = [t for t in tokens if not t["kind"]]

    def around(token: int) -> list[int]:
        """The valid elements around a token's place, from inside; one that is not valid hides no other as paths go by hash."""
        found = []
        while token in elements:
            found.append(token)
            token = elements[token]["parent"]
        return found

    fixed = [t for t in texts if any(elements[e]["vector"] == t["vector"] for e in around(t["parent"]))]
    for least, of in ((0.9, fixed), (0.5, [t for t in fixed if any(elements[e]["kind"] == "section" for e in around(t["parent"]))])):
        if sum(t["prose"] for t in of) > least * prose:  # copies of one page: nothing tells its text from a template
            fixed = [t for t in fixed if t not in of]
    inside = {e: t["prose"] for e, t in elements.items()}
    for t in fixed:
        for e in around(t["parent"]):
            inside[e] -= t["prose"]
    slots = prose - sum(t["prose"] for t in fixed)
    depth = {e: len(around(e)) for e in elements}
    if slots <= 0:
        return None, []
    heads = [e for e, t in elements.items() if t["kind"] == _HEADING and inside[e] > 0]
    sections = [e for e, t in elements.items() if t["kind"] == "section" and inside[e] >= ARTICLE_SHARE * slots]
    wide = [e for e in elements if inside[e] >= SHARE * slots]
    if sections:
        region = max(sections, key=lambda e: (inside[e], depth[e], e))
        if deeper := [e for e in sections if region in around(e) and inside[e] >= SHARE * inside[region] and all(e in around(h) for h in heads if region in around(h))]:
            region = max(deeper, key=lambda e: (depth[e], inside[e], e))
    elif wide:
        region = max(wide, key=lambda e: (depth[e], inside[e], e))
        for h in heads:  # the heading may stand beside the text
            up = around(region)
            region = next((e for e in up if e in around(h)), region)
    else:
        region = None
    return region, [t["token"] for t in fixed]


def _deduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [deduced(r["host_pages"], r["host_prose"], r["tokens"]) for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int64()))], ["__host", "region", "fixed"])


def templates(pages: DataFrame) -> DataFrame:
    """One row for each host with a template of its own, and for ``*``: __host, region, fixed (texts of the template)."""
    return token_classes(pages).mapInArrow(_deduced, "__host string, region bigint, fixed array<bigint>")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [Page(h or "").text(r, frozenset(f or ())) for h, r, f in zip(b.column("html").to_pylist(), b.column("region").to_pylist(), b.column("fixed").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every row of ``pages`` (page_id, url, html), whose other columns do not matter.

    A null or empty html has an empty text; a null url is of the host "", whose
    pages form a template like any other's. Equal pages of a host have equal
    texts; repeated rows, null ids among them, give a row each. A host of copies
    of one page alone has no template texts. Pages may be of any length and
    depth. An empty table gives no rows.
    """
    spark = pages.sparkSession
    arrow_batches(spark)
    own = pages.select("page_id", "url", "html", url_host(F.col("url")).alias("host"))
    found = reliable(templates(own))
    hosts = found.where(F.col("__host") != EVERY)
    if hosts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        hosts = F.broadcast(hosts)
    every = F.broadcast(found.where(F.col("__host") == EVERY).select(F.col("region").alias("__region"), F.col("fixed").alias("__fixed"), F.lit(True).alias("__all")))
    joined = own.join(hosts, own["host"] == hosts["__host"], "left").withColumn("__one", F.lit(True)).join(every, F.col("__one") == F.col("__all"), "left")
    known = F.col("__host").isNotNull()
    region, fixed = F.when(known, F.col("region")).otherwise(F.col("__region")), F.when(known, F.col("fixed")).otherwise(F.col("__fixed"))
    return joined.select("page_id", "url", "html", region.alias("region"), fixed.alias("fixed")).mapInArrow(_texts, "page_id bigint, url string, text string, n_chars bigint")


def op9_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op9_template_text": op9_template_text}
ORACLES: dict[str, str] = {}
