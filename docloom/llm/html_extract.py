"""Main text of web pages by deducing each host's template from equivalence classes.

A page is a sequence of tokens: an element is a token by its path, and a block of words between two block elements is one by
its path and its words.  (Words of a block stand together or not at all, so they share one occurrence vector and one token.)
Over the different pages of a host, tokens with the same occurrence vector form an equivalence class.  A class is
valid if it is large enough and stands on nearly all pages, if its tokens come in the same order on each of them, and if it
lies in one and the same slot of the root class, the class of tokens that stand once on a page.  The valid classes, so nested,
are the host's template.  Its constant blocks are no text of a page that does not mark its article, and its elements tell menus and
adverts by their links and names.  What remains in the slots of the article, or of the body where there is none, is the page's text.

Spark forms vectors, classes and their validity by sums over pages; a page is parsed once for that.  The busiest hosts meet
their pages by broadcast, the others by a shuffle.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import HUBS, by_key, settle

#: Element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br img object canvas audio video math mrow mi mo mn ms mtext msup msub msubsup mfrac msqrt mroot mstyle munder mover munderover semantics annotation".split())
BANNED = frozenset("nav header footer aside form script style noscript template textarea title iframe svg select menu dialog head".split())
CONTENT = frozenset("article main".split())
WHOLE = frozenset("html body article main".split())
CLOSED_BY = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("html body div article section main aside nav header footer ul ol dl table td th form blockquote".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Elements that hold others: only these are judged by a part of a name.
CONTAINERS = frozenset("div section ul ol dl table details fieldset figure center".split())
#: Names in class, id or role that mark what is no main text, and parts that may stand beside them without changing that.
BANNED_NAMES = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice notices gdpr alert popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar aside related recommended share sharing social comment comments commentlist respond reply replies disqus newsletter subscribe signup login search widget widgets pagination pager toolbar skip complementary contentinfo".split())
BESIDE = frozenset("site main page top bottom left right primary secondary global list box slot unit container wrapper wrap block bar area section inner outer links link form button buttons group module panel zone region google text".split())
#: Names inside an article that mark its own headline.
HEADS = frozenset("header masthead".split())
#: What marks an article element as a reader's or an advertiser's.
READER_NAMES = frozenset("comment comments reply replies respond sponsored ad ads advert promo related teaser".split())
#: Names of elements that hold the article where no element does so by its kind.
CONTENT_NAMES = frozenset("article articlebody article-body article-content post-body post-content entry-content main-content story story-body".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z", re.S)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[^a-z]+")
#: A template is deduced from so many different pages of a host at least; a class has so many tokens, and stands on this share of pages.
LEAST_PAGES, LEAST_TOKENS, SUPPORT = 10, 3, 0.9
#: Constant blocks may hold at most this share of a host's text; else pages are copies of one another and not of a template.
CONSTANT = 0.5
#: An element of the template with three links or more, and this share of its characters in links, is a menu.
MENU = 0.8
SIGN = 1 << 63


def names_of(attributes: str) -> list[str]:
    return [x.lower() for m in NAMED.finditer(attributes) for x in (m[2] or m[3] or m[4] or "").split()]


def banned_name(names: list[str], inside: bool, loosely: bool) -> bool:
    """Does a name say that this is no main text?  Strictly: all of its parts do or are neutral.  Loosely: one part does."""
    for name in names:
        if re.match(r"(?:has|have|with|without|no|is|show|hide)-", name):
            continue
        parts = [p for p in PARTS.split(name) if p]
        bad = [p for p in parts if p in BANNED_NAMES and not (inside and p in HEADS)]
        if bad and (loosely or all(p in BANNED_NAMES or p in BESIDE for p in parts)):
            return True
    return False


def signed(x: int) -> int:
    return x - (1 << 64) if x >= SIGN else x


class Page:
    """A parsed page: tokens in order, sums by token, and blocks (token, region, words).

    region is 0 for text that is left out, else 1 plus 2 in an article, 4 in a main element, 8 in an element named as content.
    template and menus are tokens of the host's template.  Each element and each run of text is looked at once.
    """

    def __init__(self, page: str, template: frozenset[int] = frozenset(), menus: frozenset[int] = frozenset()):
        self.sequence: list[int] = []
        self.sums: dict[int, list[int]] = {}  # token: characters, of these in links, links
        self.blocks: list[tuple[int, int, str]] = []
        self.template, self.menus = template, menus
        # tag, token of the path, region, in a link, and while open: characters, of these in links, links
        self.stack: list[list] = [["", 0, 1, False, 0, 0, 0]]
        self.open: Counter[str] = Counter()
        self.held: list[str] = []
        self.linked = 0
        self.read(page)

    def flush(self):
        if not self.held:
            return
        words = " ".join(html.unescape("".join(self.held)).split())
        self.held = []
        top = self.stack[-1]
        if words:
            token = signed(xxhash.xxh64_intdigest(words.encode("utf-8", "surrogatepass"), top[1] & (2 * SIGN - 1)))
            self.sequence.append(token)
            self.sums.setdefault(token, [0, 0, 0])[0] += len(words) if top[2] else 0
            self.blocks.append((token, top[2], words))
            top[4] += len(words)
            top[5] += min(self.linked, len(words))
        self.linked = 0

    def pop(self):
        tag, token, _, _, chars, linked, links = self.stack.pop()
        self.open[tag] -= 1
        above = self.stack[-1]
        above[4] += chars
        above[5] += linked
        above[6] += links
        if tag not in INLINE:
            own = self.sums.setdefault(token, [0, 0, 0])
            own[0] += chars
            own[1] += linked
            own[2] += links

    def push(self, tag: str, names: list[str]):
        _, path, region, link, *_ = self.stack[-1]
        if tag in INLINE:
            self.open[tag] += 1
            self.stack.append([tag, path, region, link or tag == "a", 0, 0, int(tag == "a")])
            return
        step = ".".join([tag, *sorted({re.sub(r"\d+", "#", n) for n in names})])
        token = signed(xxhash.xxh64_intdigest(step, path & (2 * SIGN - 1)))
        self.sequence.append(token)
        if region:
            inside = bool(region & 14)
            if tag in WHOLE:
                bad = tag == "article" and any(p in READER_NAMES for n in names for p in PARTS.split(n))
            else:
                kind = tag in BANNED and not (inside and tag == "header")
                bad = kind or banned_name(names, inside, tag in CONTAINERS and token in self.template) or (token in self.menus and not inside)
            if bad:
                region = 0
            elif tag == "article":
                region |= 2
            elif tag == "main" or "main" in names:
                region |= 4
            elif any(n in CONTENT_NAMES for n in names):
                region |= 8
        self.open[tag] += 1
        self.stack.append([tag, token, region, link, 0, 0, 0])

    def read(self, page: str):
        at, stack = 0, self.stack
        while at < len(page):
            m = TOKEN.search(page, at)
            text = page[at : m.start() if m else len(page)]
            if text:
                self.held.append(text)
                if stack[-1][3]:
                    self.linked += len(text)
            if not m:
                break
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                if tag not in INLINE:
                    self.flush()
                if self.open[tag] > 0:
                    if tag in INLINE:  # an inline element that stands outside the innermost block stays open
                        k = len(stack) - 1
                        while stack[k][0] != tag and stack[k][0] in INLINE:
                            k -= 1
                        if stack[k][0] != tag:
                            continue
                    while stack[-1][0] != tag:
                        self.pop()
                    self.pop()
                continue
            shut = CLOSED_BY.get(tag, ()) + (("p",) if tag in CLOSES_P else ())
            if tag not in INLINE:
                self.flush()
            if any(self.open[t] > 0 for t in shut):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in shut:
                        while len(stack) > k:
                            self.pop()
                        break
                    if stack[k][0] in SCOPES:
                        break
            if tag == "br":
                self.held.append(" ")
            if tag in VOID or m[3].rstrip().endswith("/"):
                continue
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
                close = page.find(">", end.start()) if end else -1
                at = close + 1 if close >= 0 else len(page)
                continue
            self.push(tag, names_of(m[3]) if "=" in m[3] else [])
        self.flush()
        while len(stack) > 1:
            self.pop()

    def text(self, constant: frozenset[int] = frozenset()) -> list[str]:
        """Blocks of text: those of articles, with what stands beside them in one main element, else of a main element, else of elements
        named as content, else all.

        Blocks of the template are left out in the last case alone: where the page itself marks its article, a heading or a
        sentence that all pages of the host have is text like any other.
        """
        kept = [(region, words) for token, region, words in self.blocks if region]
        total = sum(len(w) for _, w in kept)
        for bit, least in ((2, 0), (4, 0), (8, total / 2)):
            if any(r & bit for r, _ in kept) and sum(len(w) for r, w in kept if r & bit) >= least:
                break
        else:
            return [words for token, region, words in self.blocks if region and token not in constant]
        if bit == 2 and all(r & 4 for r, _ in kept if r & 2):
            bit = 4
        return [words for region, words in kept if region & bit]


def hosted(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#:]*)", 1), F.lit("")))
    return pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))


def parsed(rows: DataFrame) -> DataFrame:
    """(host, key, chars, sequence, tokens, sums): the tokens of each page, key being a hash of the page."""

    def run(batches):
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            found = [Page(p) for p in batch.column(2).to_pylist()]
            chars = [sum(len(w) for _, region, w in p.blocks if region) for p in found]
            sequence = pa.array([p.sequence for p in found], pa.list_(pa.int64()))
            tokens = pa.array([list(p.sums) for p in found], pa.list_(pa.int64()))
            sums = [pa.array([[s[k] for s in p.sums.values()] for p in found], pa.list_(pa.int64())) for k in range(3)]
            times = pa.array([[n[t] for t in p.sums] for p in found for n in [Counter(p.sequence)]], pa.list_(pa.int64()))
            block = pa.array([[t in words for t in p.sums] for p in found for words in [{b[0] for b in p.blocks}]], pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(chars, pa.int64()), sequence, tokens, *sums, times, block], ["host", "key", "chars", "sequence", "token", "size", "linked", "links", "times", "block"])

    schema = "host string, key long, chars long, sequence array<long>, token array<long>, size array<long>, linked array<long>, links array<long>, times array<long>, block array<boolean>"
    return rows.select("host", F.xxhash64("html").alias("key"), "html").mapInArrow(run, schema)


def templates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((host, template, constant, menus) of hosts that have a template, busy hosts); tokens as arrays of longs."""
    pages = settle(parsed(rows).where(F.col("host").isNotNull()).dropDuplicates(["host", "key"]))
    sizes = settle(pages.groupBy("host").agg(F.count("*").alias("of"), F.sum("chars").alias("all_chars")))
    total = sizes.agg(F.sum("of")).first()[0] or 1
    busy = sizes.where(F.col("of") * HUBS > total)
    sizes = sizes.where(F.col("of") >= LEAST_PAGES)
    each = pages.select("host", "key", F.explode(F.arrays_zip("token", "size", "linked", "links", "times", "block")).alias("t")).select("host", "key", "t.*")
    # the exclusive or of page and times stands for the occurrence vector
    vectors = each.groupBy("host", "token").agg(
        F.bit_xor(F.xxhash64("key", "times")).alias("vector"), F.count("*").alias("pages"), F.sum("times").alias("times"), F.sum("size").alias("size"), F.sum("linked").alias("linked"), F.sum("links").alias("links"), F.max("block").alias("block")
    )
    vectors = by_key(vectors.where(F.col("pages") >= LEAST_PAGES * SUPPORT), sizes, busy, "host").where(F.col("pages") >= SUPPORT * F.col("of"))
    # what is left of a host has at most 1 / SUPPORT times as many tokens as a page
    menu = ~F.col("block") & (F.col("links") >= 3 * F.col("times")) & (F.col("linked") >= MENU * F.col("size"))
    classes = vectors.groupBy("host", "vector").agg(F.count("*").alias("n"), F.max(F.col("times") == F.col("pages")).alias("once"), F.max("of").alias("of"), F.max("all_chars").alias("all_chars"), F.collect_list(F.struct("token", "block", "size", menu.alias("menu"))).alias("members"))
    classes = settle(classes.where(F.col("n") >= LEAST_TOKENS))
    by_host = classes.groupBy("host").agg(F.collect_list(F.struct("vector", "n", "once", F.col("members.token").alias("tokens"))).alias("classes"))

    def check(batches):
        names = ["host", "vector", "order", "slot"]
        for batch in batches:
            out: dict[tuple, int] = {}
            for host, sequence, classes in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                s = np.array(sequence, np.int64)
                roots = [c for c in classes if c["once"]]
                root = max(roots, key=lambda c: (c["n"], c["vector"]))["tokens"] if roots else []
                marks = np.flatnonzero(np.isin(s, root))
                for c in classes:
                    at = np.flatnonzero(np.isin(s, c["tokens"]))
                    if not len(at):
                        continue
                    k, sub = c["n"], s[at]
                    ordered = len(sub) % k == 0 and (sub.reshape(-1, k) == sub[:k]).all()
                    slots = np.searchsorted(marks, at)
                    nested = c["once"] or slots[0] == slots[-1]
                    order = signed(xxhash.xxh64_intdigest(sub[:k].tobytes())) if ordered else 0
                    key = (host, c["vector"], order, -1 if c["once"] else int(slots[0]) if nested else -2)
                    out[key] = out.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int32()))], names)

    met = by_key(pages.select("host", "sequence"), by_host, busy, "host").select("host", "sequence", "classes")
    seen = met.mapInArrow(check, "host string, vector long, order long, slot int")
    valid = seen.groupBy("host", "vector").agg(F.min("order").alias("a"), F.max("order").alias("b"), F.min("slot").alias("c"), F.max("slot").alias("d")).where("a = b and a <> 0 and c = d and c > -2").select("host", "vector")
    good = classes.join(valid.hint("merge"), ["host", "vector"])
    flat = good.groupBy("host").agg(F.flatten(F.collect_list("members")).alias("m"), F.max("of").alias("of"), F.max("all_chars").alias("all_chars"))
    blocks = F.filter("m", lambda x: x["block"])
    share = F.aggregate(blocks, F.lit(0).cast("long"), lambda a, x: a + x["size"])
    found = flat.select("host", F.col("m.token").alias("template"), F.when(share <= CONSTANT * F.col("all_chars"), blocks["token"]).otherwise(F.array().cast("array<long>")).alias("constant"), F.filter("m", lambda x: x["menu"])["token"].alias("menus"))
    return settle(found), busy


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text (blocks joined by an empty line), n_chars (code points).

    Null, empty and textless pages give the empty text.  Pages without a host share one template.  Copies of a page count
    once for its template, and each has its row.  Hosts with fewer than LEAST_PAGES different pages have no template:
    there, kinds and names of elements decide alone.  Very long and deeply nested pages cost time and memory in proportion
    to their length.  Extra columns are neither read nor returned.
    """
    rows = hosted(pages, id_col, url_col, html_col)
    found, busy = templates(rows)
    columns = ["id", "url", "html", "template", "constant", "menus"]
    joined = by_key(rows, found, busy, "host", "left").select(*columns)

    def run(batches):
        held: dict[tuple, frozenset] = {}

        def as_set(tokens):
            key = tuple(tokens or ())
            if key not in held:
                if len(held) > 600:
                    held.clear()
                held[key] = frozenset(key)
            return held[key]

        for part in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            texts = ["\n\n".join(Page(page, as_set(t), as_set(m)).text(as_set(c))) for page, t, c, m in zip(*(part.column(k).to_pylist() for k in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    kinds = f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, `{url_col}` {pages.schema[url_col].dataType.simpleString()}"
    return joined.mapInArrow(run, f"{kinds}, text string, n_chars long")


def op10_html_extraction(spark, sf_dir):
    from docloom.llm.shared import read

    return extract(read(spark, sf_dir, "pages"))
