"""Web pages: links, freshness, text, tables, routing."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
_DROP = {"script", "style", "head", "noscript"}
_BREAK = {"p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "table", "ul", "ol"}


def links(pages: DataFrame, allow: str | None = None, deny: str | None = None, cap: int = 200) -> DataFrame:
    """Distinct absolute http(s) links of each page without query and fragment, in order of first appearance."""
    found = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"'#?]*)"), F.lit(1))).alias("at", "href"))
    root, base = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1), F.regexp_extract("url", r"^([a-z]+://[^?#]*/)", 1)
    href = c("href")
    link = F.when(href.rlike("^https?://"), href).when(href.startswith("//"), F.concat(F.regexp_extract("url", r"^([a-z]+:)", 1), href)).when(href.startswith("/"), F.concat(root, href)).when(~href.rlike("^[a-zA-Z]+:") & (href != ""), F.concat(base, href))
    rows = found.select("page_id", link.alias("link"), "at").where("link is not null")
    for pattern, keep in ((allow, True), (deny, False)):
        if pattern:
            rows = rows.where(c("link").rlike(pattern) == keep)
    rows = rows.groupBy("page_id", "link").agg(F.min("at").alias("at"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("at", "link"))).where(c("rank") <= cap).select("page_id", "link", "rank")


def not_crawled(found: DataFrame, crawled: DataFrame) -> DataFrame:
    return found.join(crawled.select("link").distinct(), "link", "left_anti")


#: The notations of dates in texts, the year alone last.
DATES = (
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b\d{1,2}/\d{1,2}/\d{4}\b",
    r"(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2}, \d{4}\b",
    r"(?i)\b\d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{4}\b",
    r"\b\d{4}\b",
)


def freshness(pages: DataFrame, as_of: str, days: int = 180, plausible_years: int = 5) -> DataFrame:
    """The newest plausible date in the text, and whether the page is fresh: no such date, or one at most ``days`` old.

    Dates of the last ``plausible_years`` years and up to the day itself count; a year alone stands for the day of ``as_of`` in it.
    """
    text = F.regexp_replace("html", r"<[^>]*>", " ")
    day = F.to_date(F.lit(as_of))
    month = lambda d: F.format_string("%02d", F.floor((F.position(F.lower(F.regexp_extract(d, r"([A-Za-z]{3})", 1)), F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) + 2) / 3))
    part = lambda d, k: F.regexp_extract(d, r"(\d+)\D+(\d+)", k)
    put = lambda *x: F.try_to_date(F.concat_ws("-", *x), "yyyy-M-d")
    first, other = part, lambda d, k: F.regexp_extract(d, r"(\d+)/(\d+)/(\d+)", k)
    read = [
        lambda d: F.try_to_date(d, "yyyy-MM-dd"),
        lambda d: F.when(other(d, 1).cast("int") > 12, put(other(d, 3), other(d, 2), other(d, 1))).otherwise(put(other(d, 3), other(d, 1), other(d, 2))),
        lambda d: put(first(d, 2), month(d), first(d, 1)),
        lambda d: put(first(d, 2), month(d), first(d, 1)),
        lambda d: put(d, F.month(day).cast("string"), F.dayofmonth(day).cast("string")),
    ]
    found = F.array_compact(F.concat(*(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), r) for p, r in zip(DATES, read, strict=True))))
    newest = F.array_max(F.filter(found, lambda d: (d > F.date_sub(day, 365 * plausible_years)) & (d <= day)))
    return pages.select("page_id", newest.alias("newest")).withColumn("fresh", F.coalesce(c("newest") >= F.date_sub(day, days), F.lit(True)))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in _DROP
        if tag in _BREAK:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in _DROP and self.skip > 0
        if tag in _BREAK:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def html_text(html: str | None) -> str:
    parser = _Text()
    parser.feed(html or "")
    lines = (" ".join(line.split()) for line in "".join(parser.parts).split("\n"))
    return "\n".join(line for line in lines if line)


def to_text(pages: DataFrame) -> DataFrame:
    """``page_id, text``: the visible text, a line for each block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"], "text": batch["html"].map(html_text)})

    return pages.select("page_id", "html").mapInPandas(run, "page_id bigint, text string")


class _Cells(HTMLParser):
    """The cells with a ``data-stat`` key of the table of one id."""

    def __init__(self, table_id: str) -> None:
        super().__init__(convert_charrefs=True)
        self.table_id, self.depth, self.row, self.key, self.out = table_id, 0, -1, None, []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "table" and (self.depth or given.get("id") == self.table_id):
            self.depth += 1
        elif self.depth and tag == "tr":
            self.row += 1
        elif self.depth and tag in ("td", "th") and "data-stat" in given:
            self.key = given["data-stat"]
            self.out.append([self.row, self.key, ""])

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
        elif tag in ("td", "th"):
            self.key = None

    def handle_data(self, data):
        if self.depth and self.key is not None:
            self.out[-1][2] += data.strip()


def table_cells(pages: DataFrame, table_id: str) -> DataFrame:
    """``page_id, row, key, value`` of every keyed cell of the table; the page's HTML goes no further."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, html in zip(batch["page_id"], batch["html"], strict=True):
                parser = _Cells(table_id)
                parser.feed(html or "")
                rows += [(page, *cell) for cell in parser.out]
            yield pd.DataFrame(rows, columns=["page_id", "row", "key", "value"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id bigint, row int, key string, value string")


def table_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy("page_id", "row").pivot("key", keys).agg(F.first("value"))


def fill_with_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    means = df.agg(*(F.avg(F.expr(f"try_cast({x} as double)")).alias(f"_{x}") for x in columns))
    df = df.crossJoin(F.broadcast(means))  # one row
    return df.withColumns({x: F.coalesce(F.expr(f"try_cast({x} as double)"), c(f"_{x}")) for x in columns}).drop(*(f"_{x}" for x in columns))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def route(pages: DataFrame) -> DataFrame:
    """Domain and file name of each page, for a partitioned write."""
    domain = F.regexp_extract("url", r"^[a-z]+://(?:www\.)?([^/?#:]+)", 1)
    return pages.select("page_id", domain.alias("domain"), F.concat(slug(F.regexp_replace("url", r"^[a-z]+://", "")), F.lit(".html")).alias("file"))


class _Boxes(HTMLParser):
    """Pairs of label and value of list items: the label is the item's first ``i`` element, the value its other text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pairs: list[tuple[str, str]] = []
        self.inside, self.in_label, self.label, self.value = False, False, None, ""

    def close_item(self) -> None:
        if self.inside and self.label:
            self.pairs.append((self.label.strip().rstrip(":"), " ".join(self.value.split())))
        self.inside, self.in_label, self.label, self.value = False, False, None, ""

    def handle_starttag(self, tag, attrs):
        if tag == "li":
            self.close_item()
            self.inside = True
        elif tag == "i" and self.inside and self.label is None:
            self.in_label, self.label = True, ""

    def handle_endtag(self, tag):
        if tag == "i":
            self.in_label = False
        elif tag in ("li", "ul"):
            self.close_item()

    def handle_data(self, data):
        if self.in_label:
            self.label += data
        elif self.inside:
            self.value += data


def box_values(html: str | None) -> list[tuple[str, str]]:
    parser = _Boxes()
    parser.feed(html or "")
    parser.close_item()
    return parser.pairs


def list_boxes(pages: DataFrame) -> DataFrame:
    """``page_id, label, value`` of the labelled list items of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *pair) for k, html in zip(batch["page_id"], batch["html"], strict=True) for pair in box_values(html)]
            yield pd.DataFrame(rows, columns=["page_id", "label", "value"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id bigint, label string, value string")


def box_records(boxes: DataFrame, labels: list[str]) -> DataFrame:
    """One row a page, a column for each of the labels (its greatest value, if it has several)."""
    return boxes.groupBy("page_id").pivot("label", labels).agg(F.max("value"))


def merge_seasons(tables: list[DataFrame], keys: tuple[str, ...] = ("player", "year")) -> DataFrame:
    """Several season tables as one: a row for each key with the greatest value of each column that any has."""
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t, allowMissingColumns=True)
    return whole.groupBy(*keys).agg(*(F.max(n).alias(n) for n in whole.columns if n not in keys))
