"""XBRL linkbases: labels and arcs from XML, resolved by joins."""

from __future__ import annotations

import re
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import array_of
from ..operators.labels import edges_of, joined_arcs

_XLINK = "{http://www.w3.org/1999/xlink}"
_LANG = "{%s/1998/namespace}lang" % "http://www.w3.org/XML"
_ITEM = array_of(**dict.fromkeys(("kind", "label", "from", "to", "concept", "arcrole", "role", "lang", "text"), "string"), link="int", ord="double", weight="double")


def _concept(href: str | None) -> str | None:
    """``us-gaap_Assets`` of a locator's fragment, with a colon for the prefix."""
    name = (href or "").rpartition("#")[2]
    return name.replace("_", ":", 1) if name else None


def _num(v: str | None) -> float | None:
    try:
        return float(v) if v else None
    except ValueError:
        return None


_STRAY = re.compile(r"&(?!#?\w+;)|[\x00-\x08\x0b\x0c\x0e-\x1f]")


def recovered(xml: str | None) -> ET.Element | None:
    """The tree of an XML text; stray ampersands and control signs are mended, and
    where that does not do the tree ends at the first error."""
    text = xml or ""
    for attempt in (text, _STRAY.sub(lambda m: "&amp;" if m.group() == "&" else " ", text)):
        try:
            return ET.fromstring(attempt)
        except ET.ParseError:
            pull, root = ET.XMLPullParser(["start"]), None
            try:
                pull.feed(attempt)
                events = list(pull.read_events())
            except ET.ParseError:
                events = _before_error(pull)
            root = events[0][1] if events else None
    return root


def _before_error(pull: ET.XMLPullParser) -> list:
    """Events read before the error that the parser reports as its last one."""
    out = []
    try:
        for event in pull.read_events():
            out.append(event)
    except ET.ParseError:
        pass
    return out


def parse_linkbase(xml: str | None) -> list[dict]:
    """Locators, label resources and arcs; labels of one extended link share
    its number.  Of broken XML what stands before the break counts; a missing
    file yields nothing."""
    root = recovered(xml)
    if root is None:
        return []
    out = []
    links = [e for e in root.iter() if e.get(f"{_XLINK}type") == "extended"] or [root]
    for n, link in enumerate(links):
        for e in link.iter():
            kind, get = e.get(f"{_XLINK}type"), lambda k, e=e: e.get(_XLINK + k)
            if kind in ("locator", "resource", "arc"):
                out.append(
                    {
                        "kind": kind, "link": n, "label": get("label"), "from": get("from"), "to": get("to"), "concept": _concept(get("href")) if kind == "locator" else None, "arcrole": get("arcrole"),
                        "role": get("role"), "lang": e.get(_LANG), "text": (" ".join("".join(e.itertext()).split()) or None) if kind == "resource" else None, "ord": _num(e.get("order")), "weight": _num(e.get("weight")),
                    }
                )
    return out


@F.pandas_udf(_ITEM)
def linkbase_items(xml: pd.Series) -> pd.Series:
    return xml.map(parse_linkbase)


def items(files: DataFrame, file: str = "file", xml: str = "xml") -> DataFrame:
    rows = files.select(F.col(file).alias("file"), F.explode(linkbase_items(xml)).alias("x")).select("file", "x.*")
    return rows.withColumn("doc", F.concat_ws("#", F.col("file").cast("string"), F.col("link").cast("string")))


def labels(parsed: DataFrame) -> DataFrame:
    """``file, concept, role, lang, label_text``: arcs joined with locators and resources."""
    loc = parsed.where("kind = 'locator'").select("doc", F.col("label").alias("from"), "concept")
    res = parsed.where("kind = 'resource'").select("doc", F.col("label").alias("to"), "role", "lang", F.col("text").alias("label_text"))
    return parsed.where("kind = 'arc'").select("file", "doc", "from", "to").join(loc, ["doc", "from"]).join(res, ["doc", "to"]).select("file", "concept", "role", "lang", "label_text").distinct()


def arcs(parsed: DataFrame, arcroles: list[str] | None = None) -> DataFrame:
    """``file, from_concept, to_concept, arcrole, order, weight`` of relations.

    Calculation, presentation and definition differ by their arc roles alone.
    """
    loc = parsed.where("kind = 'locator'").select("doc", "label", "concept")
    arc = parsed.where("kind = 'arc'").select("file", "doc", "from", "to", "arcrole", F.col("ord").alias("order"), "weight")
    out = joined_arcs(edges_of(arc, arcroles) if arcroles else arc, loc)
    return out.select(*"file from_concept to_concept arcrole order weight".split()).distinct()


ROLES = ("standard", "terse", "verbose", "total", "documentation", "negated")


def wanted_labels(long: DataFrame, roles: tuple[str, ...] = ROLES, langs: tuple[str, ...] = ("en-US", "en")) -> DataFrame:
    return long.where(F.col("role").isin(list(roles)) & F.col("lang").isin(list(langs)))
