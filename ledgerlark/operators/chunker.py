"""Section-aware chunking: sections by window, packing per section."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .windows import numbered, sections

_CUT = re.compile(r"(?<=[!.?。！？:;–—])\s+")
_BULLET = re.compile(r"\s*(?:[-•—–]|\(\s*(?:\d+|[ivxlcdm]+|[A-Za-z])\s*\)|(?:[A-Za-z]|\d+)\.)\s+")
_LEAD = re.compile(r"(?:the following(?: table)?|(?:were|are) as follows|presents? (?:as follows|below)|presented (?:as follows|below)|[(]in (?:thousands|millions)[)]:)\s*(?:\x5b\w+\x5d)?\s*$", re.I)
_MARK = re.compile(r"\s*\[(?:Table|TABLE)\b.*\]\s*$")


def cost(unit: str) -> int:
    """A quarter of the characters, one at least."""
    return len(unit) // 4 or 1


def split_units(paragraph: str) -> list[str]:
    out: list[str] = []
    for line in (x.strip() for x in (paragraph or "").splitlines()):
        if line:
            out += [line] if _BULLET.match(line) else ([p.strip() for p in _CUT.split(line) if p.strip()] or [line])
    return out


class Packer:
    """Greedy packing of one section's units into overlapping chunks."""

    def __init__(self, heading: str | None, max_tokens: int = 900, max_chars: int = 3600, overlap: int = 80):
        self.prefix = heading.strip() + "\n\n" if heading and heading.strip() else ""
        self.max_tokens, self.max_chars, self.overlap = max_tokens, max_chars, overlap
        self.units: list[str] = []
        self.size = self.chars = 0
        self.tail = self.lead = ""
        self.chunks: list[str] = []

    def over(self, tokens: int, chars: int) -> bool:
        return tokens > self.max_tokens or chars > self.max_chars

    def flush(self) -> None:
        if self.units or self.lead:
            body = "\n\n".join(x for x in (self.tail, self.lead, *self.units) if x).strip()
            if body:
                self.chunks.append(self.prefix + body)
                words = body.split()
                self.tail = body if len(words) <= self.overlap else " ".join(words[-self.overlap :])
            self.units, self.size, self.chars, self.lead = [], 0, 0, ""

    def hold(self, unit: str) -> None:
        self.units.append(unit)
        self.size += cost(unit)
        self.chars += len(unit)

    def add(self, paragraph: str) -> None:
        if _MARK.match(paragraph.strip()) or _LEAD.search(paragraph.strip()):
            self.lead = f"{self.lead}\n\n{paragraph.strip()}".strip()
            return
        for unit in split_units(paragraph):
            if self.units and self.over(self.size + cost(unit), self.chars + len(unit)):
                self.flush()
            if not self.over(cost(unit), len(unit)):
                self.hold(unit)
                if self.size >= self.max_tokens * 0.9 or self.chars >= self.max_chars * 0.9:
                    self.flush()
                continue
            self.flush()
            for part in [p.strip() for p in _CUT.split(unit) if p.strip()] or [unit]:
                if self.units and self.over(self.size + cost(part), self.chars + len(part)):
                    self.flush()
                self.hold(part)
            self.flush()


def pack_paragraphs(paragraphs: list[str], heading: str | None = None, max_tokens: int = 900, max_chars: int = 3600, overlap: int = 80) -> list[str]:
    """Chunks of one section: at most ``max_tokens`` and ``max_chars`` of new text
    (the overlap is not counted), flushed from nine tenths on; table lead-ins
    wait for the text that follows; the heading opens every chunk."""
    p = Packer(heading, max_tokens, max_chars, overlap)
    for paragraph in paragraphs:
        p.add(paragraph)
    p.flush()
    return p.chunks


def chunks(rows: DataFrame, file: str = "file", position: str = "position", heading: str = "heading", text: str = "text", max_tokens: int = 900, max_chars: int = 3600, overlap: int = 80) -> DataFrame:
    """``file, section, heading, chunk_index, chunk_count, id, content, ...`` of
    ordered rows.

    A section's heading is its last row's.  Paragraphs are gathered by (file,
    section), which one filing bounds; packing is a vectorised UDF over them.
    """
    keep = F.nullif(F.trim(F.coalesce(F.col(text), F.lit(""))), F.lit(""))
    marked = sections(rows.select(F.col(file).alias("file"), F.col(position).alias("position"), F.col(heading).alias("heading"), keep.alias("text")), ["file"], ["position"], "heading")
    whole = marked.groupBy("file", "section").agg(F.max_by("heading", "position").alias("heading"), F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("position", "text")))).alias("paras"))

    @F.pandas_udf("array<string>")
    def pack(paras: pd.Series, heads: pd.Series) -> pd.Series:
        return pd.Series([pack_paragraphs([r["text"] for r in p], h, max_tokens, max_chars, overlap) for p, h in zip(paras, heads)])

    spread = whole.where(F.size("paras") > 0).select("file", "section", "heading", F.posexplode(pack(F.col("paras"), F.col("heading"))).alias("part", "content"))
    out = numbered(spread, ["file"], ["section", "part"])
    tag = F.coalesce(tx.section_tag(F.col("heading")), tx.section_tag(F.col("content")))
    return out.withColumn("id", F.concat(F.col("file").cast("string"), F.lit("::text::chunk-"), F.col("chunk_index").cast("string"))).withColumn("section_tag", tag).withColumn("mentions_other_years", tx.mentions_other_years(F.col("content")))
