"""Licence scan by canonical digest lookup.

A text's canonical form drops copyright lines, case, punctuation and spelling
variants that licence-matching guidelines treat as equal.  The SHA-256 of that
form is joined with the known digests.  The same form of each single line that
speaks of a licence is looked up among known notices.
"""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright[^a-z\n]*([0-9(]|by |[^\n]*(19|20)[0-9][0-9])|c\) (19|20)[0-9][0-9]|all rights reserved)[^\n]*"
#: Where terms begin, a line begins: a notice on the same line ends there.
TERMS = r"(permission is |permission to |redistribution and |licensed under |released under |everyone is permitted |copying and distribution |this is free |boost software license |this (software|program|work|file|package|library|font) )"
#: Spellings that count as equal, applied in order to the spaced canonical text.
SPELLINGS = (
    (" licence", " license"), (" sublicence", " sublicense"), ("licenced", "licensed"), ("authoris", "authoriz"), ("organis", "organiz"),
    ("recognis", "recogniz"), ("favour", "favor"), ("behaviour", "behavior"), ("merchantibility", "merchantability"), ("acknowledgement", "acknowledgment"),
    ("fulfilment", "fulfillment"), ("judgement", "judgment"), (" non commercial", " noncommercial"), (" sub license", " sublicense"), (" http ", " https "), (" copyright holder s ", " copyright holders "),
)

NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "Licensed under the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "MIT License", "The MIT License (MIT)", "SPDX-License-Identifier: MIT"),
    "GPL-3.0-only": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0"),
    "GPL-2.0-only": ("This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
}


def canonical(text: str | None) -> str:
    """The canonical form in plain Python, for building digest tables."""
    t = re.sub(TERMS, r"\n\1", (text or "").translate(str.maketrans(UPPER, LOWER)))
    t = " " + re.sub(r"[^a-z0-9]+", " ", re.sub(COPYRIGHT_LINE, "\n", t)) + " "
    for a, b in SPELLINGS:
        t = t.replace(a, b)
    return t.strip(" ")


def digest(text: str | None) -> str:
    return hashlib.sha256(canonical(text).encode()).hexdigest()


def notice_digests() -> dict[str, str]:
    return {digest(s): name for name, texts in NOTICES.items() for s in texts}


def text_digests() -> dict[str, str]:
    """Digests of whole licence texts, and of notices that are a whole text."""
    return json.loads(Path(__file__).with_name("licence_digests.json").read_text()) | notice_digests()


def read_texts(folder: str) -> dict[str, str]:
    """Digests of the licence texts ``<id>.txt`` in a local folder, for instance the
    SPDX licence list's; pass the result, with the library's own, as ``texts``."""
    return {digest(f.read_text(errors="replace")): f.stem for f in sorted(Path(folder).glob("*.txt"))}


def canonical_column(text: Column) -> Column:
    t = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), TERMS, "\n$1")
    t = F.regexp_replace(t, COPYRIGHT_LINE, "\n")
    t = F.concat(F.lit(" "), F.regexp_replace(t, "[^a-z0-9]+", " "), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(t)


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, text_digest, licence, n_notices, notices`` per input row.

    ``licence`` is the known licence whose text the whole document is, else
    null.  ``n_notices`` counts lines that are a known notice and ``notices``
    lists their licences, sorted and comma-joined ("" if none).  Null and
    empty texts have the digest of the empty form and no licence.  The digest
    table is the library's own (its size is fixed by ``texts``) and is
    broadcast; documents are not shuffled.  Ids pass through; only the two
    named columns are read.
    """
    spark = docs.sparkSession
    texts, notices = texts or text_digests(), notices or notice_digests()
    empty = digest("")
    known = spark.createDataFrame([(k, v) for k, v in sorted(texts.items()) if k != empty], "text_digest string, licence string")
    lookup = F.create_map(*[F.lit(x) for kv in sorted(notices.items()) for x in kv])
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: s.rlike("[Ll][Ii][Cc][Ee][Nn][SsCc]"))
    found = F.filter(F.transform(lines, lambda s: F.try_element_at(lookup, F.sha2(canonical_column(s), 256))), lambda s: s.isNotNull())
    scanned = rows.select("doc_id", F.sha2(canonical_column(F.col("text")), 256).alias("text_digest"), found.alias("found"))
    return scanned.join(F.broadcast(known), "text_digest", "left").select("doc_id", "text_digest", "licence", F.size("found").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"))


def oracle() -> str:
    """DuckDB SQL of the same rows."""

    def form(x: str) -> str:
        line = COPYRIGHT_LINE.replace("'", "''")
        t = f"regexp_replace(translate(coalesce({x}, ''), '{UPPER}', '{LOWER}'), '{TERMS}', chr(10) || '\\1', 'g')"
        t = f"regexp_replace({t}, '{line}', chr(10), 'g')"
        t = f"' ' || regexp_replace({t}, '[^a-z0-9]+', ' ', 'g') || ' '"
        for a, b in SPELLINGS:
            t = f"replace({t}, '{a}', '{b}')"
        return f"sha256(trim({t}, ' '))"

    values = lambda d: ", ".join(f"('{k}', '{v}')" for k, v in sorted(d.items()) if k != digest(""))
    return f"""
WITH known(d, licence) AS (VALUES {values(text_digests())}),
notice(d, licence) AS (VALUES {values(notice_digests())}),
line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s FROM documents),
hit AS (SELECT doc_id, n.licence FROM line JOIN notice n ON regexp_matches(s, '[Ll][Ii][Cc][Ee][Nn][SsCc]') AND n.d = {form('s')}),
per AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS names FROM hit GROUP BY doc_id),
doc AS (SELECT doc_id, {form('text')} AS text_digest FROM documents)
SELECT doc.doc_id, doc.text_digest, known.licence, coalesce(per.n, 0) AS n_notices, coalesce(per.names, '') AS notices
FROM doc LEFT JOIN known ON known.d = doc.text_digest LEFT JOIN per ON per.doc_id = doc.doc_id
"""
