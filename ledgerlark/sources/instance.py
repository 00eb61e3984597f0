"""XBRL instances: facts, contexts and units of landed XML files."""

from __future__ import annotations

from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import array_of
from .parts import in_parts

_XBRLI = "{http://www.xbrl.org/2003/instance}"
_DIMS = "{http://xbrl.org/2006/xbrldi}"
_NIL = "{http://www.w3.org/2001/XMLSchema-instance}nil"

_SHAPE = T.StructType(
    [
        T.StructField("facts", array_of(**dict.fromkeys(("qname", "context_id", "unit_id", "decimals", "value_raw"), "string"), doc_order="int")),
        T.StructField("contexts", array_of(**dict.fromkeys(("context_id", "entity", "period_start", "period_end", "instant", "dimensions_json"), "string"))),
        T.StructField("units", array_of(**dict.fromkeys(("unit_id", "numerator", "denominator", "measure"), "string"))),
    ]
)


def _short(tag: str, names: dict[str, str]) -> str:
    """``{uri}local`` as ``prefix:local`` by the last part of the URI's path that is no date."""
    uri, _, local = tag[1:].partition("}") if tag.startswith("{") else ("", "", tag)
    return f"{names[uri]}:{local}" if uri in names else local


class _Named(ET.TreeBuilder):
    """A tree and the prefixes of its name spaces, of one parse."""

    def __init__(self):
        super().__init__()
        self.names: dict[str, str] = {}

    def start_ns(self, prefix, uri):
        if prefix:
            self.names[uri] = prefix


def parse_instance(xml: str | None) -> dict:
    """Non-nil facts in order, contexts with sorted dimensions, units.

    Broken XML yields empty lists.
    """
    out: dict[str, list[dict]] = {"facts": [], "contexts": [], "units": []}
    try:
        tree = _Named()
        parser = ET.XMLParser(target=tree)
        parser.feed(xml or "")
        root, names = parser.close(), tree.names
    except ET.ParseError:
        return out
    text = lambda e, path: (e.findtext(path) or "").strip() or None
    for c in root.iter(f"{_XBRLI}context"):
        dims = {}
        for m in c.iter():
            if m.tag in (f"{_DIMS}explicitMember", f"{_DIMS}typedMember"):
                dims[m.get("dimension") or ""] = " ".join("".join(m.itertext()).split())
        json = "{" + ", ".join(f'"{k}": "{v}"' for k, v in sorted(dims.items())) + "}"
        out["contexts"].append({"context_id": c.get("id"), "entity": text(c, f"{_XBRLI}entity/{_XBRLI}identifier"), "period_start": text(c, f"{_XBRLI}period/{_XBRLI}startDate"), "period_end": text(c, f"{_XBRLI}period/{_XBRLI}endDate"), "instant": text(c, f"{_XBRLI}period/{_XBRLI}instant"), "dimensions_json": json})
    for u in root.iter(f"{_XBRLI}unit"):
        side = lambda part, u=u: "*".join((m.text or "").strip() for m in u.findall(f"{_XBRLI}divide/{_XBRLI}{part}/{_XBRLI}measure")) or None
        flat = "*".join((m.text or "").strip() for m in u.findall(f"{_XBRLI}measure")) or None
        num, den = side("unitNumerator") or flat, side("unitDenominator")
        out["units"].append({"unit_id": u.get("id"), "numerator": num, "denominator": den, "measure": f"{num}/{den}" if den else num})
    for n, f in enumerate(e for e in root if e.get("contextRef")):
        if (f.get(_NIL) or "").lower() not in ("true", "1"):
            out["facts"].append({"qname": _short(f.tag, names), "context_id": f.get("contextRef"), "unit_id": f.get("unitRef"), "decimals": f.get("decimals"), "value_raw": "".join(f.itertext()).strip() or None, "doc_order": n})
    return out


@F.pandas_udf(_SHAPE)
def instance_parts(xml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(xml.map(parse_instance).tolist(), columns=["facts", "contexts", "units"])


def instances(files: DataFrame, filing: str = "filing_id", xml: str = "xml") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, contexts, units) of instance files, each with its filing."""
    parsed = files.select(F.col(filing).alias("filing_id"), instance_parts(xml).alias("p"))
    return tuple(parsed.select("filing_id", F.explode(f"p.{part}").alias("x")).select("filing_id", "x.*") for part in ("facts", "contexts", "units"))


_RESOLVED = ("qname", "value_raw", "decimals", "context_id", "entity", "period_start", "period_end", "instant", "dimensions_json", "unit_id", "numerator", "denominator", "measure")


def resolved_facts(xml: str | None) -> list[dict]:
    """The facts of an instance, each with its context and its unit; facts
    without one of them go."""
    parts = parse_instance(xml)
    by = {}
    for kind in ("context", "unit"):
        for x in parts[f"{kind}s"]:
            by.setdefault((kind, x[f"{kind}_id"]), []).append(x)
    met = lambda kind, f: by.get((kind, f[f"{kind}_id"]), []) if f[f"{kind}_id"] is not None else []
    return [f | c | u for f in parts["facts"] for c in met("context", f) for u in met("unit", f)]


def facts_in_context(files: DataFrame, filing: str = "filing_id", xml: str = "xml") -> DataFrame:
    """Facts of instance files joined with contexts and units within their file,
    which is parsed once and not exchanged."""
    return in_parts(files, filing, xml, resolved_facts, **dict.fromkeys(_RESOLVED, "string"), doc_order="int").drop("position").withColumnRenamed("file", "filing_id")
