"""Main text of web pages by the style tree of their site.

The pages of a host are merged into one tree of elements.  An element whose pages
agree in how its children follow each other, and whose texts recur on many pages,
says nothing about any single page.  Both are measured by entropy:

* *presentation*: the entropy of the sequences of children, in logarithms to the
  base of the number of pages that have the element: 0 when all agree, 1 when all
  differ;
* *content*: one minus the mean entropy of its texts over the pages that have them.

A branch of a page is removed when neither its element nor any below it reaches
``THRESHOLD``.  An element that fewer than ``LEAST_PAGES`` different pages have is
important, as there is nothing to hold it against.  What HTML itself or common
names of classes declare as no article (menus, forms, comments and so on) has
importance 0, an ``article`` or ``main`` element importance 1; where such elements
hold most of what remains, the rest goes.

Statistics count different pages only, so that copies of a page do not make its
article look like a frame.  They are plain aggregations with partial sums; pages are
shuffled once, compressed, to meet the importance of their elements.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .html_dom import UNSEEN, Element, Page, hash64
from .rows import Steps
from .words import slices

LEAST_PAGES = 4
THRESHOLD = 0.5
_FADE = 0.9          # weight of the children where a page's element has one way to follow
_SALTS = 16

# What HTML and ARIA declare not to be the article.
NO_ARTICLE = UNSEEN | frozenset("nav header footer aside form menu dialog search head frameset".split())
NO_ARTICLE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
MAIN = frozenset(("article", "main"))
# Common names of classes and ids of what is not the article.
NO_ARTICLE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored sponsors "
    "promo promos promotion cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter "
    "subscribe subscription signup login register share sharing social comment comments disqus respond replies reply "
    "discussion guestbook sidebar sidebars related recommended recommendations breadcrumb breadcrumbs nav navbar "
    "navigation menu menus topbar toolbar footer colophon copyright masthead pagination pager search header disclaimer".split())
# Names that are also written together with others, such as commentlist.
NO_ARTICLE_STEMS = ("comment", "advert", "sponsor", "newsletter", "breadcrumb", "sidebar", "cookieb", "cookien")
_NEGATIONS = frozenset("no non not has with without".split())
# Elements of running text; without attributes they are judged with what holds them.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre caption figcaption tr td th tbody thead tfoot".split())


def _declared(page: Page, element: Element, heading: list[bool], in_main: bool) -> bool:
    """Whether markup alone says that the element is no part of the article."""
    if element.hidden or element.tag in UNSEEN:
        return True
    if element.tag in ("html", "body", "main"):
        return False
    if element.tag == "header" and in_main:
        return False   # the heading of the article
    number = page.elements[element.parent].children[element.label]
    if element.tag in NO_ARTICLE and element.tag != "form" or element.role in NO_ARTICLE_ROLES - {"form"}:
        return True
    if heading[number]:
        return False   # a wrapper around the article, whatever it is called
    if element.tag == "form" or element.role == "form":
        return True
    return any((word in NO_ARTICLE_WORDS or word.startswith(NO_ARTICLE_STEMS)) and (i == 0 or element.words[i - 1] not in _NEGATIONS)
               for i, word in enumerate(element.words)) and not (in_main and element.tag == "h1")


def main_blocks(page: Page, importance: dict[int, tuple[float, float | None, int]]) -> list[str]:
    """The blocks of the page that belong to its article, in order.

    ``importance`` has presentation, content (None without texts) and the number of
    different sequences of children for the elements, by key, that enough pages share.
    """
    n = len(page.elements)
    weight, best, heading = [1.0] * n, [0.0] * n, [False] * n
    for i in range(n - 1, -1, -1):     # children come after their parents
        e = page.elements[i]
        below = list(e.children.values())
        heading[i] = e.tag in ("h1", "main") or any(heading[c] for c in below)
        known = importance.get(e.key)
        if known is None:
            weight[i] = 1.0
        else:
            look, content, ways = known
            parts = [weight[c] for c in below] + ([content] if e.texts and content is not None else [])
            if below:
                fade = _FADE ** ways
                weight[i] = (1 - fade) * look + fade * sum(parts) / len(parts)
            else:
                weight[i] = content if content is not None else look
        best[i] = max([weight[i], *[best[c] for c in below]])
    keep, inside = [True] * n, [False] * n
    for i in range(1, n):
        e = page.elements[i]
        keep[i], inside[i] = keep[e.parent], inside[e.parent] or e.tag in MAIN
        if not keep[i]:
            continue
        if _declared(page, e, heading, inside[e.parent]):
            keep[i] = False
        elif e.tag not in MAIN and not (e.tag in TEXT and e.plain) and best[i] < THRESHOLD:
            keep[i] = inside[e.parent] and e.plain   # a bare list or table of the article stays
    kept = [(at, text) for at, text in page.blocks if keep[at]]
    main = [text for at, text in kept if inside[at]]
    if 2 * sum(map(len, main)) >= sum(len(text) for _, text in kept):
        return main
    return [text for _, text in kept]


def _host(url: str) -> Column:
    """The host of a url in lower case, without user and port; null if there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, element, style, texts): every element of every page, with hashes of its texts."""
    for batch in slices(batches, "html"):
        out: list[tuple] = []
        for number, host, html in zip(*[batch.column(c).to_pylist() for c in ("page", "host", "html")]):
            page = Page(html or "", hash64(host.encode()))
            for element in page.elements:
                texts = {hash64(page.blocks[b][1].encode()) for b in element.texts}
                out.append((number, element.key, page.style(element), list(texts)))
        columns = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.list_(pa.int64()))],
            names=["page", "element", "style", "texts"])


def importance_of(elements: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(element, look, content, ways) of the elements that enough different pages share."""
    different = elements.dropDuplicates(["page", "element"])
    seen = (different.select("element", F.explode(F.concat(
                F.array(F.struct(F.lit(True).alias("look"), F.col("style").alias("value"))),
                F.transform("texts", lambda t: F.struct(F.lit(False).alias("look"), t.alias("value"))))).alias("x"))
            .groupBy("element", "x.look", "x.value").agg(F.count("*").alias("n")))
    n, look = F.col("n").cast("double"), F.col("look")
    sums = seen.groupBy("element").agg(
        F.sum(F.when(look, F.col("n"))).alias("m"), F.sum(F.when(look, n * F.ln(n))).alias("styles"),
        F.count_if(look).cast("int").alias("ways"), F.sum(F.when(~look, F.ln(n))).alias("texts"), F.count_if(~look).alias("k"))
    m = F.col("m").cast("double")
    # rounded, as the order in which doubles are summed is not fixed
    return sums.filter(F.col("m") >= max(2, least_pages)).select(
        "element", F.round(1 - F.col("styles") / m / F.ln(m), 9).alias("look"),
        F.when(F.col("k") > 0, F.round(1 - F.col("texts") / F.col("k") / F.ln(m), 9)).alias("content"), "ways")


def _per_page(elements: DataFrame, importance: DataFrame) -> DataFrame:
    """(page, known): the importance of the elements of each page.

    The frame of a large host is on all its pages, so each element is dealt over some tasks.
    """
    salted = importance.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    own = elements.select("page", "element", F.pmod(F.xxhash64("page"), F.lit(_SALTS)).cast("int").alias("salt"))
    return (own.join(salted, ["element", "salt"]).groupBy("page")
            .agg(F.collect_set(F.struct("element", "look", "content", "ways")).alias("known")))


def with_main_text(pages: DataFrame, html: str = "html", url: str = "url", out: str = "text") -> DataFrame:
    """All rows and columns of ``pages``, and the main text of each page in ``out``.

    White space inside a block becomes one space; blocks stand in page order, one a
    line.  Null html is empty and has an empty text.  A page whose url is null or
    names no host is a site of its own.  Repeated rows and copies of a page under
    several urls of a host get the same text.  A column named ``out`` is an error.
    """
    if out.lower() in [c.lower() for c in pages.columns]:
        raise ValueError(f"the table has a column {out!r} already; choose another name in out=")
    html_text = F.coalesce(F.col(html), F.lit(""))
    page = F.xxhash64(html_text, F.coalesce(_host(url), F.lit("")))
    host = F.coalesce(_host(url), F.concat(F.lit("?"), page.cast("string")))
    steps = Steps(pages.sparkSession)
    elements = steps.write(pages.select(page.alias("page"), host.alias("host"), html_text.alias("html")).mapInArrow(
        _elements, "page long, element long, style long, texts array<long>"))
    known = _per_page(elements.select("page", "element"), importance_of(elements))

    def packed_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=6)
        for batch in slices(batches, "html"):
            texts = [t.encode() for t in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page"), batch.column("host"), batch.column("missing"), batch.column("row"),
                 pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page", "host", "missing", "row", "packed", "size"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, texts = [], []
            for data, size, host, known in zip(*[batch.column(c).to_pylist() for c in ("packed", "size", "host", "known")]):
                sources.append(pa.decompress(data, size, "zstd", asbytes=True).decode())
                texts.append("\n".join(main_blocks(
                    Page(sources[-1], hash64(host.encode())),
                    {k["element"]: (k["look"], k["content"], k["ways"]) for k in known or ()})))
            yield pa.RecordBatch.from_arrays([batch.column("missing"), batch.column("row"), pa.array(sources, pa.string()),
                                              pa.array(texts, pa.string())], names=["missing", "row", "html", "text"])

    # the other columns travel in one struct, so that their names cannot clash
    others = T.StructType([f for f in pages.schema if f.name != html])
    row = F.struct(*others.names)
    moved = pages.select(page.alias("page"), host.alias("host"), F.col(html).isNull().alias("missing"), row.alias("row"),
                         html_text.alias("html")).mapInArrow(packed_row, T.StructType([
                             T.StructField("page", T.LongType()), T.StructField("host", T.StringType()),
                             T.StructField("missing", T.BooleanType()), T.StructField("row", others),
                             T.StructField("packed", T.BinaryType()), T.StructField("size", T.LongType())]))
    done = moved.join(known, "page", "left").select("host", "missing", "row", "packed", "size", "known").mapInArrow(
        extract, T.StructType([T.StructField("missing", T.BooleanType()), T.StructField("row", others),
                               T.StructField("html", T.StringType()), T.StructField("text", T.StringType())]))
    columns = [F.when(~F.col("missing"), F.col("html")).alias(html) if c == html else F.col("row")[c].alias(c)
               for c in pages.columns]
    return done.select(*columns, F.col("text").alias(out))
