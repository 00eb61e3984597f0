"""Secret scanning: three fixed patterns and sliding-window Shannon entropy.

Candidates are maximal runs of key characters.  A candidate's character class
(hex, lower or upper letters with digits, mixed with digits, mixed with
symbols, letters only) fixes the entropy that a window must reach.  A window's
entropy comes from its character counts, updated as one character enters and
one leaves.  What the allow list names is cut out of a candidate and the rest is
judged on its own; a rest made of words, as in paths, is no key unless a segment
of it reaches the threshold of its own class.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = {"assign": 0, "access": 1, "hex": 2, "entropy": 3}
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: class -> bits that a window of 20 characters must reach.
THRESHOLDS = {"hex": 3.0, "lower": 3.5, "upper": 3.4, "mixed": 3.6, "symbols": 3.8, "letters": 3.6, "one_case": 4.0}
#: Public placeholders and identifiers that look random but are no secrets.
ALLOW = (
    r"\AwJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY\Z",
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]",
    r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}(?![0-9a-fA-F])",
    r"\A(.)\1*\Z",
    r"(?i)0123456789|abcdefghijkl",
)
_BREAK = re.compile("[+/_=-]+")
#: A segment that reads as a word, a name in camel case, a number or a short mark.
_WORDY = re.compile(r"[A-Za-z]{0,3}[0-9]{0,4}|[0-9]+[A-Za-z]{0,2}|(?:[A-Z]?[a-z]{2,})+[A-Z]{0,4}[0-9]{0,4}|[A-Z]+[0-9]{0,4}")
#: So many characters in segments that are not wordy make a run key material.
ODD = 6
_XLOG = [0.0] + [n * math.log2(n) for n in range(1, 4097)]


def character_class(s: str) -> str | None:
    """The class whose threshold holds; None for runs that are no key material."""
    digit, low, up = re.search("[0-9]", s), re.search("[a-z]", s), re.search("[A-Z]", s)
    if not (low or up):
        return None
    if not digit and not re.search("[+/_=-]", s):
        return "one_case" if not (low and up) else None if _WORDY.fullmatch(s) else "letters"
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", s):
        return "hex"
    if re.search("[+/_=-]", s):
        return "symbols"
    return "mixed" if low and up else "lower" if low else "upper"


def wordy(s: str) -> bool:
    """True for paths and slugs: all but a few characters are in wordy segments."""
    return sum(len(p) for p in _BREAK.split(s) if not _WORDY.fullmatch(p)) < ODD


def hot_windows(s: str, bits: float, width: int) -> tuple[int, int] | None:
    """Hull of the windows of ``width`` characters with at least ``bits`` bits
    of Shannon entropy.  n*H = n*log n - sum c*log c, kept by two updates a step.
    """
    need = width * (math.log2(width) - bits)
    counts: dict[str, int] = {}
    load, first, last = 0.0, -1, -1
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        load += _XLOG[c + 1] - _XLOG[c]
        counts[ch] = c + 1
        if i >= width:
            old = s[i - width]
            c = counts[old]
            load += _XLOG[c - 1] - _XLOG[c]
            counts[old] = c - 1
        if i >= width - 1 and load <= need + 1e-9:
            first = first if first >= 0 else i - width + 1
            last = i + 1
    return None if first < 0 else (first, last)


class Scanner:
    def __init__(self, thresholds: dict[str, float] | None = None, allow: tuple[str, ...] = ALLOW, width: int = 20):
        if not 2 <= width <= 4096:
            raise ValueError("width must be between 2 and 4096")
        self.thresholds, self.width = thresholds or THRESHOLDS, width
        self.allow = [re.compile(a) for a in allow]
        self.candidate = re.compile(rf"[A-Za-z0-9+/_=-]{{{width},}}")

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind number, end) of the three fixed patterns, sorted."""
        found = []
        low = text.lower()
        if any(w in low for w in _WORDS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(found)

    def entropy(self, text: str) -> list[tuple[int, int, int]]:
        found = []
        for m in self.candidate.finditer(text):
            for a, b in self.rests(m.group()):
                hull = self.hull(m.group()[a:b])
                if hull:
                    found.append((m.start() + a + hull[0], 3, m.start() + a + hull[1]))
        return found

    def rests(self, s: str) -> list[tuple[int, int]]:
        """What the allow list leaves of a candidate, where it can hold a window."""
        cuts = sorted(m.span() for a in self.allow for m in a.finditer(s))
        out, at = [], 0
        for a, b in [*cuts, (len(s), len(s))]:
            if a - at >= self.width:
                out.append((at, a))
            at = max(at, b)
        return out

    def hull(self, s: str) -> tuple[int, int] | None:
        """Hull of the hot windows of ``s`` under its class and of its segments under theirs."""
        spans = []
        kind = character_class(s)
        if kind and not (kind == "symbols" and wordy(s)):
            spans.append(hot_windows(s, self.thresholds.get(kind, THRESHOLDS[kind]), self.width))
        if kind == "symbols":
            at = 0
            for end in [*(m.start() for m in _BREAK.finditer(s)), len(s)]:
                part = s[at:end].lstrip("+/_=-")
                kind = character_class(part) if len(part) >= self.width else None
                got = kind and hot_windows(part, self.thresholds.get(kind, THRESHOLDS[kind]), self.width)
                if got:
                    spans.append((end - len(part) + got[0], end - len(part) + got[1]))
                at = end
        spans = [x for x in spans if x]
        return (min(a for a, _ in spans), max(b for _, b in spans)) if spans else None


def _joined(spans: list[tuple[int, int, int]]) -> str:
    names = list(KINDS)
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_entropy", pa.int64()), ("base_spans", pa.string()), ("spans", pa.string()), ("base_sha256", pa.string())])


def scan_mapper(scanner: Scanner):
    def scan(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in batch.column(1).to_pylist():
                base = scanner.base(text) if text else []
                extra = scanner.entropy(text) if text else []
                joined = _joined(base)
                row = [sum(k == j for _, k, _ in base) for j in range(3)]
                row += [len(extra), joined, _joined(sorted(base + extra)) if extra else joined, hashlib.sha256(joined.encode()).hexdigest()]
                for c, v in zip(cols, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip(cols, list(_OUT)[1:])]], schema=_OUT)

    return scan


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """Spans of secrets in every whole text, one row per input row, no shuffle.

    ``doc_id, n_assign, n_access, n_hex, n_entropy, base_spans, spans,
    base_sha256``; a span is ``kind:start:end`` in code points, end exclusive.
    Null and empty texts have no spans.  Null and repeated ids pass through;
    columns other than the two named are not read.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ddl = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_spans string, spans string, base_sha256 string"
    return rows.mapInArrow(scan_mapper(scanner or Scanner()), ddl)


def redact(docs: DataFrame, text_col: str = "text", scanner: Scanner | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; rows, order and columns stay.

    Spans that overlap share one mark.  Null and empty texts stay as they are, an
    empty table stays empty, repeated rows are treated alike; only ``text_col`` is
    read and replaced, whatever the other columns are called.
    """
    scanner = scanner or Scanner()

    @F.pandas_udf("string")
    def cleaned(texts):
        def one(text):
            if not text:
                return text
            out, at = [], 0
            for a, _, b in sorted(scanner.base(text) + scanner.entropy(text)):
                if b <= at:
                    continue
                if a >= at:
                    out += [text[at:a], mark]
                at = b
            return "".join([*out, text[at:]]) if out else text

        return texts.map(one)

    name = "`" + text_col.replace("`", "``") + "`"
    return docs.withColumn(text_col, cleaned(F.col(name).cast("string")))
