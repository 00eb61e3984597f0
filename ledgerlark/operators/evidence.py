"""Evidence packing: boosts, anchors, signature caps, stitching and MMR.

The input is one query's top records (bounded by its top-k), so the greedy part
runs as one group per query; the rest is expressions and windows.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import signature
from ..functions.text import PACK_STOPWORDS
from .aggregates import mode_of

_CUT = re.compile(r"(?<=[.?!|。！？；;：:…—–-])\s+")
_BULLET = re.compile(r"\s*(?:[(]\s*(?:\d+|[A-Za-z]|[ivxlcdm]+)\s*[)]|[•–—-]|(?:\d+|[A-Za-z])[.])\s+")
_CHUNK = re.compile(r"chunk-([0-9]+)\Z")
_WORD = re.compile(r"[\w一-鿿]+")


def boosted(records: DataFrame) -> DataFrame:
    """Section priors x1.20 / 0.92 / 0.85 and x0.90 for other years' mentions."""
    tag = F.lower(F.coalesce("section_tag", F.lit("")))
    prior = F.when(tag == "risk_factors", 1.20).when(tag == "fwd_statements", 0.92).when(tag.contains("md&a"), 0.85).otherwise(1.0)
    other = F.when(F.coalesce("mentions_other_years", F.lit(False)), 0.90).otherwise(1.0)
    return records.withColumn("boosted", F.col("final_score") * prior * other)


def anchored(records: DataFrame, key: str = "query_id", coverage: bool = True, head: int = 20) -> DataFrame:
    """Penalties for records off the modal ticker, form and year of the head.

    A gap of years costs 0.9 * e^(-lambda (gap - 1)); lambda, ticker and form
    factors are milder in coverage mode.
    """
    lam, off_ticker, off_form = (0.2, 0.8, 0.9) if coverage else (0.6, 0.5, 0.8)
    ranked = records.withColumn("_at", F.row_number().over(W.partitionBy(key).orderBy(F.desc("boosted"), "rid")))
    first = ranked.where(F.col("_at") <= head)
    out = ranked
    for c in ("ticker", "form", "fy"):
        low = first.withColumn("_v", F.lower(F.col(c).cast("string")))
        out = out.join(mode_of(low, [key], "_v", "_at", f"_anchor_{c}"), key, "left")
    same = lambda c: F.lower(F.col(c).cast("string"))
    gap = F.abs(F.col("fy").cast("string").try_cast("int") - F.col("_anchor_fy").try_cast("int"))
    factor = F.when(F.coalesce(same("ticker"), F.lit("")).isin("") | F.col("_anchor_ticker").isNull() | (same("ticker") == F.col("_anchor_ticker")), 1.0).otherwise(off_ticker)
    factor = factor * F.when(F.coalesce(same("form"), F.lit("")).isin("") | F.col("_anchor_form").isNull() | (same("form") == F.col("_anchor_form")), 1.0).otherwise(off_form)
    decay = F.when(gap > 0, 0.9 * F.pow(F.lit(2.71828), -lam * F.greatest(F.lit(0), gap - 1))).otherwise(1.0)
    return out.withColumn("boosted", F.col("boosted") * factor * F.coalesce(decay, F.lit(1.0))).drop("_at", "_anchor_ticker", "_anchor_form", "_anchor_fy")


def signature_capped(records: DataFrame, key: str = "query_id", text: str = "content", cap: int = 10) -> DataFrame:
    """At most ``cap`` records of one signature (metadata and first 80 words)."""
    sig = signature([F.col(c) for c in ("ticker", "form", "fy", "heading")], F.col(text))
    w = W.partitionBy(key, "_sig").orderBy(F.desc("boosted"), "rid")
    return records.withColumn("_sig", sig).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_sig", "_n")


def estimate_tokens(s: str) -> int:
    cjk = sum("一" <= ch <= "鿿" for ch in s)
    return max(1, cjk + (len(s) - cjk) // 4)


def pieces(s: str) -> list[str]:
    """Bullet lines whole, other lines cut at sentence marks and dashes."""
    out: list[str] = []
    for line in (x.strip() for x in s.splitlines()):
        if line:
            out += [line] if _BULLET.match(line) else [p.strip() for p in _CUT.split(line) if p.strip()]
    return out


def word_set(s: str) -> frozenset[str]:
    return frozenset(w for w in _WORD.findall(" ".join(s.lower().split())) if w not in PACK_STOPWORDS)


def stitch(items: list[dict]) -> list[dict]:
    """Chunks with consecutive numbers of one filing and heading become one."""
    place = lambda r: (r["rid"].split("::text::")[0], int(m.group(1)) if (m := _CHUNK.search(r["rid"])) else math.inf)
    out: list[dict] = []
    last = None
    for r in sorted(items, key=place):
        here = place(r)
        if last and here[0] == last[0] and here[1] == last[1] + 1 and r["heading"] == out[-1]["heading"]:
            out[-1] = out[-1] | {"content": out[-1]["content"] + "\n\n" + r["content"]}
        else:
            out.append(dict(r))
        last = here
    return out


def select_evidence(rows: list[dict], budget: int, coverage: bool, per_heading: int, lam: float = 0.65) -> list[dict]:
    """The greedy selection: the best record of each heading within 30 % of the
    budget, in coverage mode the stitched best of each heading, then maximal
    marginal relevance; what does not fit is cut at a sentence."""
    rows = sorted((r for r in rows if (r["content"] or "").strip()), key=lambda r: (-r["boosted"], r["rid"]))
    groups: dict[str, list[dict]] = {}
    for r in rows:
        groups.setdefault(r["heading"] or "", []).append(r)
    chosen, sets, used, taken = [], [], 0, set()
    safe = int(budget * 0.30)
    for heading, items in groups.items():  # in the order of their best record
        cost = estimate_tokens(items[0]["content"].strip())
        if (not heading and used + cost > safe // 3) or used + cost > safe:
            continue
        chosen.append(items[0])
        sets.append(word_set(items[0]["content"]))
        taken.add(items[0]["rid"])
        used += cost
    if coverage:
        for items in groups.values():
            extra = [r for r in stitch(items[:per_heading]) if r["rid"] not in taken]
            chosen += extra
            taken.update(r["rid"] for r in extra)
    left = [r for r in rows if r["rid"] not in taken]
    bags = {r["rid"]: word_set(r["content"]) for r in left}
    near = {r["rid"]: max((len(bags[r["rid"]] & s) / len(bags[r["rid"]] | s) for s in sets if s), default=0.0) for r in left}
    while left and used < budget:
        r = max(left, key=lambda x: (lam * x["boosted"] - (1 - lam) * near[x["rid"]], -x["boosted"], x["rid"]))
        left.remove(r)
        text = r["content"].strip()
        cost = estimate_tokens(text)
        if used + cost > budget:
            if budget - used <= 50:
                break
            kept, cost = [], 0
            for p in pieces(text):
                step = estimate_tokens(p + " ")
                if cost + step > budget - used:
                    break
                kept.append(p)
                cost += step
            if not kept:
                continue
            text = " ".join(kept).rstrip() + " …"
        chosen.append(r | {"content": text})
        used += cost
        new = word_set(text)
        for x in left:
            if new:
                near[x["rid"]] = max(near[x["rid"]], len(bags[x["rid"]] & new) / len(bags[x["rid"]] | new))
    return chosen


def packed(records: DataFrame, key: str = "query_id", budget: int = 2400, coverage: bool = True, per_heading: int = 3) -> DataFrame:
    """``key, place, rid, text, score``: the evidence of each query in order."""
    ready = signature_capped(anchored(boosted(records), key, coverage), key, cap=10 if coverage else 2)
    kind = dict(records.dtypes)[key]

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame[["rid", "heading", "content", "boosted"]].astype(object).where(frame.notna(), None).to_dict("records")
        got = select_evidence(rows, budget, coverage, per_heading)
        return pd.DataFrame({key: frame[key].iloc[0], "place": range(len(got)), "rid": [r["rid"] for r in got], "text": [r["content"].strip() for r in got], "score": [float(r["boosted"]) for r in got]})

    return ready.select(key, "rid", "heading", "content", "boosted").groupBy(key).applyInPandas(one, f"{key} {kind}, place int, rid string, text string, score double")


def evidence_block(packed_rows: DataFrame, key: str = "query_id", max_chars: int | None = None) -> DataFrame:
    """``key, block``: ``[rid]`` and text of each record in order; with
    ``max_chars`` longer texts are cut there and end in an ellipsis."""
    text = F.col("text") if max_chars is None else F.when(F.length("text") > max_chars, F.concat(F.rtrim(F.substring("text", 1, max_chars)), F.lit(" …"))).otherwise(F.col("text"))
    line = F.concat(F.lit("["), F.col("rid"), F.lit("]\n"), text, F.lit("\n"))
    return packed_rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("block"))


def guarded_citations(citations: DataFrame, evidence: DataFrame, size: int = 240) -> DataFrame:
    """Citations whose id was packed, quotes cut at ``size`` characters.

    The packed ids are bounded by their queries' top-k and go to the citations,
    which stay where they are."""
    return citations.join(F.broadcast(evidence.select("rid").distinct()), "rid", "left_semi").withColumn("quote", F.substring(F.trim("quote"), 1, size))
