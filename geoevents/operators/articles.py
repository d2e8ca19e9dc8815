"""Article, link and text-chunk jobs over page and document tables."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from geoevents.functions import text as X


def html_links(pages: DataFrame, *, page_id: str = "page_id", html: str = "html", base: str | None = None,
               suffix: str | None = None, section: str | None = None) -> DataFrame:
    """``(page_id, pos, url)``: link targets in document order, each canonical URL once a page."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), 1)
    links = pages.select(page_id, F.posexplode(hrefs).alias("pos", "href"))
    if suffix:
        links = links.filter(F.col("href").endswith(suffix))
    if section:
        links = links.filter(F.col("href").contains(section))
    full = F.col("href")
    if base:
        full = F.when(full.startswith("http"), full).otherwise(F.concat(F.lit(base.rstrip("/")), full))
    links = links.withColumn("url", X.canonical_url(full))
    return links.groupBy(page_id, "url").agg(F.min("pos").alias("pos"))


def _first_match(c: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, pattern, 1)), F.lit(""))


class _Paragraphs(HTMLParser):
    """Texts of the <p> elements inside <article>."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.open, self.parts, self.out = 0, False, [], []

    def _close(self) -> None:
        text = "".join(self.parts).strip()
        if self.open and len(text) > 1:
            self.out.append(text)
        self.open, self.parts = False, []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.depth += 1
        elif tag == "p" and self.depth:
            self._close()
            self.open = True

    def handle_endtag(self, tag):
        if tag == "p" or tag == "article":
            self._close()
        if tag == "article":
            self.depth = max(0, self.depth - 1)

    def handle_data(self, data):
        if self.open:
            self.parts.append(data)


@F.pandas_udf(ArrayType(StringType()))
def html_paragraphs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Paragraph texts of an article page, nested markup included."""
    def read(html) -> list[str]:
        parser = _Paragraphs()
        parser.feed(html or "")
        parser.close()
        parser._close()
        return parser.out

    for series in batches:
        yield series.map(read)


def parse_articles(pages: DataFrame, *, url: str = "url", html: str = "html", page_id: str = "page_id",
                   bad_titles: tuple[str, ...] = ("Desculpe-nos", "Ops")) -> DataFrame:
    """Article fields of every page with a heading: id, canonical URL, domain, title, subtitle,
    body, author, publication time, section. Pages without a title or with an error title drop."""
    h = F.col(html)
    title = X.strip_tags(F.regexp_extract(h, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))
    line = X.strip_tags(F.regexp_extract(h, r"""(?is)class=["'][^"']*publication-data[^"']*["'][^>]*>(.*?)</(?:div|p|span|time)>""", 1))
    sections = F.regexp_extract_all(html, F.lit(r"""(?is)itemprop=["']articleSection["'][^>]*content=["']([^"']+)["']"""), 1)
    clean = X.canonical_url(F.col(url))
    out = pages.select(
        page_id, X.article_id(clean).alias("article_id"), clean.alias("url"),
        _first_match(clean, r"^[a-z]+://([^/]+)").alias("domain"), title.alias("title"),
        X.strip_tags(F.regexp_extract(h, r"(?is)<h2\b[^>]*>(.*?)</h2>", 1)).alias("subtitle"),
        F.array_join(html_paragraphs(h), "\n\n").alias("body_text"),
        X.article_author(line).alias("author"), X.article_published(line).alias("published_at"),
        F.nullif(F.array_join(sections, " > "), F.lit("")).alias("section"))
    bad = F.lit(False)
    for word in bad_titles:
        bad = bad | F.col("title").contains(word)
    return out.filter((F.col("title") != "") & ~bad)


# ------------------------------------------------------------------ chunks
def chunk_text(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", target: int = 2000,
               maximum: int = 3500) -> DataFrame:
    """``(doc, chunk_index, chunk_id, chunk)``: paragraphs joined up to the target size.

    A heading opens a chunk, and only a single long paragraph exceeds the maximum. One fold over a text's paragraphs, inside the JVM:
    its state is the chunks that are closed, the open one and that one's size. NULL and empty texts have no chunk.
    """
    paragraphs = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), X.strip), lambda p: p != "")
    none = F.lit(None).cast("string")
    state = lambda closed, going, size: F.struct(closed.alias("closed"), going.alias("going"), size.cast("int").alias("size"))
    with_open = lambda s: F.when(s["going"].isNull(), s["closed"]).otherwise(F.concat(s["closed"], F.array(s["going"])))

    def step(s: Column, p: Column) -> Column:
        heading, size = p.startswith("##"), F.length(p) + 1
        joins = s["going"].isNotNull() & ~(heading | (s["size"] + size > maximum))
        grown = F.when(joins, F.concat(s["going"], F.lit("\n"), p)).otherwise(p)
        total = F.when(joins, s["size"]).otherwise(0) + size
        before = F.when(joins, s["closed"]).otherwise(with_open(s))
        full = (total >= target) & ~heading
        return state(F.when(full, F.concat(before, F.array(grown))).otherwise(before), F.when(~full, grown), F.when(full, 0).otherwise(total))

    chunks = F.aggregate(paragraphs, state(F.array().cast("array<string>"), none, F.lit(0)), step, with_open)
    out = df.select(F.col(id_col).alias("doc"), F.posexplode(chunks).alias("chunk_index", "chunk"))
    return out.withColumn("chunk_id", F.concat_ws(":", F.col("doc").cast("string"), F.col("chunk_index").cast("string")))
