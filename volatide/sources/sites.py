"""News sites: sitemaps and article pages.

Pages are parsed in Arrow batches with the standard library's parser. A site is a table of selectors; a selector is a
chain of simple ones (tag, .class, #id, [attribute=value]), each below the one before it, or its child after ">".
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volatide.functions.dates import extract_date, five_day_blocks
from volatide.functions.text import infer_category
from volatide.storage import cut

# Url keywords and their categories, tried in this order.
BUSINESS_KEYWORDS = {
    "chung-khoan": "Chứng khoán",
    "thi-truong-chung-khoan": "Chứng khoán",
    "doanh-nghiep": "Doanh nghiệp",
    "tai-chinh": "Tài chính",
    "tai-chinh-ngan-hang": "Tài chính ngân hàng",
    "kinh-te": "Kinh tế",
    "kinh-te-vi-mo": "Vĩ mô",
    "vi-mo": "Vĩ mô",
    "bat-dong-san": "Bất động sản",
    "kinh-doanh": "Kinh doanh",
}
DEFAULT_CATEGORY = "Kinh doanh"

# Selectors of each site, in order of preference.
SITES = {
    "cafef": {
        "title": ["h1.title", "h1.title_post", "h1"],
        "date_meta": ["meta[property=article:published_time]", "meta[name=pubdate]"],
        "date_text": [".pdate", ".td-post-date", ".date"],
        "lead": [".sapo"],
        "body": [".detail-content p", ".knc-content p", "[data-role=content] p", ".content_detail p", "#content_detail p"],
    },
    "vnexpress": {
        "title": ["h1.title-detail", "h1.title_post", "h1"],
        "date_meta": ["meta[name=pubdate]", "meta[property=article:published_time]"],
        "date_text": ["span.date", ".date"],
        "lead": ["p.description"],
        "body": ["article.fck_detail p", ".fck_detail > p", ".fck_detail p"],
    },
    "vietstock": {
        "title": ["h1.article-title", "h1.title-detail", "h1"],
        "date_meta": ["meta[itemprop=datePublished]", "meta[property=article:published_time]"],
        "date_text": [".date", ".article-date", ".date-published"],
        "lead": [],
        "body": [".article-content p", ".article-body p", ".article-content div", ".fck_detail p"],
    },
    "plain": {"title": ["h1"], "date_meta": [], "date_text": [".date"], "lead": [], "body": ["article p"]},
}
#: Bytes of rows that are sent to a Python worker at once; rows and bytes of pages that are parsed before their articles go out.
BATCH_BYTES, DEFAULT_BATCH = 8 << 20, "67108864b"
TOGETHER, PARSED_BYTES = 64, 1 << 20
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What ends an open paragraph by beginning, and what a paragraph isn't looked for beyond (as HTML has it).
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
ENCLOSES = frozenset("applet button caption html marquee object table td template th".split())
_STEP = re.compile(r"([a-zA-Z][\w-]*)?((?:\.[\w-]+|#[\w-]+|\[[\w:-]+=[^\]]+\])*)")
_PART = re.compile(r"\.([\w-]+)|#([\w-]+)|\[([\w:-]+)=([^\]]+)\]")


@dataclass
class Node:
    tag: str
    attributes: dict[str, str]
    parent: "Node | None" = None
    pieces: list = field(default_factory=list)  # texts and nodes
    classes: frozenset = frozenset()
    in_paragraph: bool = False  # below a paragraph that the next block ends

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                out.append(item.strip())
            elif item.tag not in ("script", "style"):
                todo += reversed(item.pieces)
        return " ".join(" ".join(x for x in out if x).split())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("", {})
        self.nodes: list[Node] = []

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH and self.now.in_paragraph:
            while self.now.tag != "p":
                self.now = self.now.parent
            self.now = self.now.parent
        attributes = {k: v or "" for k, v in attrs}
        inside = tag == "p" or (self.now.in_paragraph and tag not in ENCLOSES)
        node = Node(tag, attributes, self.now, classes=frozenset(attributes.get("class", "").split()), in_paragraph=inside)
        self.now.pieces.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.now = node

    def handle_endtag(self, tag):
        at = self.now
        while at.parent is not None and at.tag != tag:
            at = at.parent
        if at.parent is not None:
            self.now = at.parent

    def handle_data(self, data):
        self.now.pieces.append(data)


@functools.cache
def _simple(text: str) -> tuple:
    """(tag, classes, ids, attributes) of a simple selector; None if it isn't one."""
    found = _STEP.fullmatch(text)
    parts = _PART.findall(found[2] or "") if found else []
    return found and (found[1], frozenset(p[0] for p in parts if p[0]), [p[1] for p in parts if p[1]], [(p[2], p[3]) for p in parts if p[2]])


@functools.cache
def _steps(selector: str) -> tuple:
    """The simple selectors from the last to the first, each with whether the one before it is the parent."""
    words = selector.replace(">", " > ").split()
    return tuple((_simple(w), i > 0 and words[i - 1] == ">") for i, w in reversed(list(enumerate(words))) if w != ">")


def _fits(node: Node, simple: tuple | None) -> bool:
    if simple is None:
        return False
    tag, classes, ids, attributes = simple
    return (not tag or node.tag == tag) and classes <= node.classes and all(node.attributes.get("id") == i for i in ids) and all(node.attributes.get(k) == v for k, v in attributes)


def select(nodes: list[Node], selector: str) -> list[Node]:
    """Nodes in page order that a selector picks."""
    steps = _steps(selector)

    def reaches(node: Node | None, i: int, direct: bool) -> bool:
        if i == len(steps):
            return True
        while node is not None:
            if _fits(node, steps[i][0]) and reaches(node.parent, i + 1, steps[i][1]):
                return True
            if direct:
                return False
            node = node.parent
        return False

    return [n for n in nodes if _fits(n, steps[0][0]) and reaches(n.parent, 1, steps[0][1])]


def parse(html: str, site: str) -> tuple[str, str, str]:
    """(title, date text, body) of a page; empty where a part is missing."""
    rules, tree = SITES[site], _Tree()
    tree.feed(html or "")
    tree.close()
    nodes = tree.nodes
    order = {id(n): i for i, n in enumerate(nodes)}
    first = lambda selectors: min((n for s in selectors for n in select(nodes, s)), key=lambda n: order[id(n)], default=None)
    title, meta, shown = first(rules["title"]), first(rules["date_meta"]), first(rules["date_text"])
    date = (meta.attributes.get("content", "") if meta else "") or (shown.text() if shown else "")
    parts = [n.text() for s in [*rules["lead"], *rules["body"]] for n in select(nodes, s)]
    found = title.text() if title else "", date, " ".join(p for p in parts if p)
    # Children and parents hold each other: a page's tree is taken apart here, and doesn't wait for the collector.
    for node in nodes:
        node.parent = None
        node.pieces.clear()
    return found


def parse_articles(pages: DataFrame, site: str, require_date: bool = True) -> DataFrame:
    """(url, source, category, title, date, published_at, body) of the pages (url, html) that have all parts."""
    if site not in SITES:
        raise ValueError(f"No selectors are known for site {site!r}.")

    def run(batches):
        for batch in batches:
            for part in _pieces(batch):
                found = [parse(h, site) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("url"), *(pa.array([f[i] for f in found], pa.string()) for i in range(3))], ["url", "title", "date_text", "body"])

    option = "spark.sql.execution.arrow.maxBytesPerBatch"
    if pages.sparkSession.conf.get(option) == DEFAULT_BATCH:  # unless the session asks for something else
        pages.sparkSession.conf.set(option, f"{BATCH_BYTES}b")
    return as_articles(pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "url string, title string, date_text string, body string"), site, require_date)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The pages of a batch in runs of at most TOGETHER rows and, but for single pages, PARSED_BYTES bytes."""
    at, sizes = 0, pc.fill_null(pc.binary_length(batch.column("html")), 0).to_pylist()
    while at < len(sizes):
        to, held = at + 1, sizes[at]
        while to < min(len(sizes), at + TOGETHER) and held + sizes[to] <= PARSED_BYTES:
            held, to = held + sizes[to], to + 1
        yield batch.slice(at, to - at)
        at = to


def as_articles(raw: DataFrame, site: str, require_date: bool = True) -> DataFrame:
    """Articles of the parts (url, title, date_text, body) that were found in pages."""
    out = raw.withColumn("day", extract_date(F.col("date_text"))).where((F.col("title") != "") & (F.col("body") != ""))
    if require_date:
        out = out.where(F.col("day").isNotNull())
    return out.select(
        "url",
        F.lit(site).alias("source"),
        infer_category(F.col("url"), BUSINESS_KEYWORDS, DEFAULT_CATEGORY).alias("category"),
        "title",
        F.coalesce(F.col("day").cast("string"), F.lit("")).alias("date"),
        F.coalesce("date_text", F.lit("")).alias("published_at"),
        "body",
    )


def sitemap_blocks(spans: DataFrame, start: str, end: str, base: str) -> DataFrame:
    """Add sitemap_url: a file for every five-day block."""
    blocks = five_day_blocks(spans, start, end)
    b, e = F.col("block_start"), F.col("block_end")
    return blocks.withColumn("sitemap_url", F.concat_ws("-", F.lit(f"{base}/sitemaps/sitemaps"), F.year(b), F.month(b), F.dayofmonth(b), F.concat(F.dayofmonth(e).cast("string"), F.lit(".xml"))))


#: A sitemap, or an index of sitemaps, as the XML reader sees it.
SITEMAP = "url array<struct<loc string, lastmod string>>, sitemap array<struct<loc string>>, broken string"


def read_sitemaps(files: DataFrame, xml: str = "xml") -> DataFrame:
    """Add urls (of articles, trimmed), children (other sitemaps) and broken (files that aren't XML; they list nothing).

    Namespaces with and without a prefix, CDATA and character references are the XML reader's.
    """
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
    # A prefix is a namespace's own business, but the reader keeps it in names.
    plain = F.regexp_replace(F.col(xml), r"(</?)[A-Za-z_][\w.-]*:(urlset|sitemapindex|url|sitemap|loc|lastmod)\b", "$1$2")
    found = files.withColumn("__found", F.from_xml(plain, SITEMAP, options))
    listed = lambda part: F.filter(F.transform(F.coalesce(part, F.array()), lambda x: F.trim(F.regexp_replace(x["loc"], r"^\s+|\s+$", ""))), lambda u: u != "")
    return found.withColumns({"urls": listed(F.col("__found.url")), "children": listed(F.col("__found.sitemap")), "broken": F.col("__found.broken").isNotNull() | F.col(xml).isNull()}).drop("__found")


def reachable_sitemaps(files: DataFrame, roots: list[str]) -> DataFrame:
    """The rows of files (sitemap_url, xml) that the roots lead to through indexes of any depth, each once, read."""
    read = cut(read_sitemaps(files.dropDuplicates(["sitemap_url"])))
    near = files.sparkSession.createDataFrame([(r,) for r in dict.fromkeys(roots)], "sitemap_url string")
    seen = near
    while True:
        beyond = read.join(near, "sitemap_url").select(F.explode("children").alias("sitemap_url")).distinct()
        near = cut(beyond.join(seen, "sitemap_url", "left_anti"))
        if near.isEmpty():
            return read.join(seen, "sitemap_url")
        seen = cut(seen.union(near))


def sitemap_urls(files: DataFrame, xml: str = "xml", suffix: str = ".chn") -> DataFrame:
    """Distinct article urls of sitemap files that hold a business keyword."""
    urls = read_sitemaps(files, xml).select(F.explode("urls").alias("url"))
    wanted = F.lit(False)
    for key in BUSINESS_KEYWORDS:
        wanted = wanted | F.col("url").contains(key)
    return urls.where(F.col("url").contains(suffix) & wanted).distinct()
