"""HTML pages: blocks with heading context, and compact period tables."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as nu
from ..functions.periods import header_weight
from ..operators.windows import fill_forward, first_of
from .parts import in_parts

_SKIP = {"script", "style", "noscript", "template", "svg", "head"}
_BLOCK = set("address article aside blockquote center div dd dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_TITLE = re.compile(r"(?:item|part)\s+(?:\d+[a-c]?|[ivx]+)\b", re.I)
_PAGE = re.compile(r"(?:page\s+)?(\d{1,4})", re.I)


class Blocks(HTMLParser):
    """Text blocks in document order, each with tag, path, anchor and page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []
        self.counts: list[dict[str, int]] = [{}]
        self.skip = self.bold = self.page = 0
        self.anchor: str | None = None
        self.parts: list[str] = []
        self.all_bold, self.out, self.recent = True, [], []

    def path(self) -> str:
        return "/" + "/".join(f"{t}[{n}]" for t, n in self.stack)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        bold, self.parts, self.all_bold = self.all_bold, [], True
        if not text:
            return
        m = _PAGE.fullmatch(text)
        if m and text.lower().startswith("page"):
            self.page = int(m.group(1))
        tag = next((t for t, _ in reversed(self.stack) if t in _BLOCK), "body")
        heading = tag in ("h1", "h2", "h3", "h4") or (bold and tag in ("p", "div") and 5 <= len(text) <= 180) or (bool(_TITLE.match(text)) and len(text) <= 180)
        self.out.append({"tag": tag, "text": text, "path": self.path(), "anchor": self.anchor, "page": self.page or None, "is_heading": heading})

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += tag not in _VOID
        if tag in _BLOCK or tag == "br":
            self.flush()
        for k, v in attrs:
            if k == "id" or (tag == "a" and k == "name"):
                self.anchor = v
        if tag not in _VOID:
            n = self.counts[-1][tag] = self.counts[-1].get(tag, 0) + 1
            self.stack.append((tag, n))
            self.counts.append({})
        self.bold += tag in ("b", "strong")

    def handle_endtag(self, tag):
        if tag in _SKIP and self.skip:
            self.skip -= 1
        if tag in _BLOCK:
            self.flush()
        self.bold -= tag in ("b", "strong") and self.bold > 0
        if any(t == tag for t, _ in self.stack):
            while self.stack:
                t, _ = self.stack.pop()
                self.counts.pop()
                if t == tag:
                    break

    def handle_data(self, data):
        if not self.skip and data:
            if data.strip() and not self.bold:
                self.all_bold = False
            self.parts.append(data)


def blocks_of(html: str | None) -> list[dict]:
    p = Blocks()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.out


#: The tail of a parenthesis that a line break cut off.
FRAGMENT = r"(?i)^\W*(and|of|or)\b.+\)$"


def text_rows(pages: DataFrame, file: str = "file", html: str = "html") -> DataFrame:
    """``file, position, text, part, item, heading, section_path`` of each page.

    Repeated texts of a page go before headings are carried down, so a repeated
    heading does not switch context; fragments below 3 characters go too.
    """
    raw = in_parts(pages, file, html, blocks_of, tag="string", text="string", path="string", anchor="string", page="int", is_heading="boolean").where(F.length("text") >= 3)
    raw = raw.where(~((F.length("text") < 25) & F.col("text").rlike(FRAGMENT)))
    kept = first_of(raw, ["file", "text"], ["position"])
    low = F.lower("text")
    part = F.when(F.col("is_heading") & low.rlike(r"^part\s+[ivx]+\b"), F.upper(F.regexp_extract("text", r"(?i)^(part\s+[ivx]+)", 1)))
    item = F.when(F.col("is_heading") & low.rlike(r"^item\s+[0-9]+[a-c]?\b"), F.regexp_replace("text", r"(?i)^(item\s+[0-9]+)([a-c]?)\.?\s*", "$1$2. "))
    head = F.when(F.col("is_heading"), F.col("text"))
    out = fill_forward(kept, ["file"], ["position"], {"part": part, "item": item, "heading": head})
    return out.withColumn("section_path", F.concat_ws(" / ", "part", "item", "heading"))


class Tables(HTMLParser):
    """Cells of every table: (table, row, column, text); nested tables apart."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[list[int]] = []
        self.n, self.cell, self.out = 0, None, []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([self.n, -1, 0])
            self.n += 1
        elif tag == "tr" and self.open:
            self.open[-1][1] += 1
            self.open[-1][2] = 0
        elif tag in ("td", "th") and self.open:
            self.cell = []
            self.span = next((int(v) for k, v in attrs if k == "colspan" and v and v.isdigit()), 1)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.open and self.cell is not None:
            t, r, c = self.open[-1]
            self.out.append({"table": t, "row": max(r, 0), "col": c, "text": " ".join("".join(self.cell).split())})
            self.open[-1][2] += max(1, min(self.span, 100))
            self.cell = None
        elif tag == "table" and self.open:
            self.open.pop()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def cells_of(html: str | None) -> list[dict]:
    p = Tables()
    p.feed(html or "")
    p.close()
    return p.out


def cells(pages: DataFrame, file: str = "file", html: str = "html") -> DataFrame:
    """Long cells ``file, table, row, col, text`` (blank cells go)."""
    return in_parts(pages, file, html, cells_of, table="int", row="int", col="int", text="string").drop("position").where("text <> ''")


def compact_tables(long: DataFrame, look: int = 50, max_rows: int = 120) -> DataFrame:
    """``file, table, row, account, header, value`` of the two latest periods.

    The account column has most non-numeric cells in the first ``look`` rows;
    period columns are those with most numbers, ordered by their header's
    weight.  Tables show at most ``max_rows`` rows.
    """
    keys = ["file", "table"]
    # one exchange brings a table together; windows over it spill, where joins would be broadcast through the driver
    table, column, line = W.partitionBy(*keys), W.partitionBy(*keys, "col"), W.partitionBy(*keys, "row")
    cell = long.repartition(*keys).withColumn("number", nu.human_number(F.col("text")))
    body = (F.col("row") > 0) & (F.col("row") <= look)
    head, number = F.col("row") == 0, F.col("number").isNotNull()
    cell = cell.withColumns({"_n": F.count_if(body).over(column), "_numbers": F.count_if(body & number).over(column), "header": F.max(F.when(head, F.col("text"))).over(column), "_weight": F.max(F.when(head, header_weight(F.col("text")))).over(column)})
    cell = cell.withColumn("_account", -F.max(F.when(F.col("_n") > 0, F.struct(F.col("_n") - F.col("_numbers"), (-F.col("col")).alias("left")))).over(table)["left"])
    cell = cell.withColumn("_period", (F.col("_n") > 0) & (F.col("_numbers") * 2 >= F.col("_n")) & (F.col("col") != F.col("_account")))
    cell = cell.withColumn("period_rank", F.dense_rank().over(table.orderBy(F.desc("_period"), F.desc("_weight"), "col")))
    cell = cell.withColumn("account", F.max(F.when(F.col("col") == F.col("_account"), F.col("text"))).over(line))
    values = cell.where(F.col("_period") & (F.col("period_rank") <= 2) & (F.col("row") > 0) & (F.col("row") <= max_rows))
    return values.select(*keys, "row", "account", "header", "period_rank", F.col("number").alias("value"))


CODES = "USD|EUR|GBP|JPY|CNY|RMB|AUD|CAD|CHF|HKD|NTD|SGD|TWD"


def unit_of(text):
    """(unit, currency) announced in a table's surroundings: a scale word, then a
    currency code or else the first known sign."""
    low = F.lower(F.coalesce(text, F.lit("")))
    word = F.regexp_extract(low, r"\b(thousand|million|billion)s\b", 1)
    unit = F.when(word != "", F.concat(word, F.lit("s")))
    code = F.regexp_extract(F.upper(low), rf"\b({CODES})\b", 1)
    sign = F.when(low.contains("$"), "USD").when(low.contains("€"), "EUR").when(low.contains("£"), "GBP").when(low.contains("¥"), "JPY").when(low.contains("￥"), "CNY")
    return unit, F.when(code != "", code).otherwise(sign)


def shown_header(header, unit, currency):
    """``header (USD, millions)`` of what is known."""
    tail = F.concat_ws(", ", currency, unit)
    return F.when(tail == "", header).otherwise(F.concat(header, F.lit(" ("), tail, F.lit(")")))


def largest_tables(long: DataFrame) -> DataFrame:
    """``file, table``: the table with most cells of each page, the first of equals."""
    sizes = long.groupBy("file", "table").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("file").agg(F.max_by("table", F.struct("n", (-F.col("table")).alias("first"))).alias("table"))
