"""String expressions: tokens, sentences, titles, snippets, ids (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Retrieval stop words, kept sorted.
STOPWORDS = tuple(
    "a also an and are as at be but by can could for from had has have here in into is it its may might no not of on or our shall should than that the their then there this to was we were which will with would".split()
)
#: The evidence packer's own, shorter list.
PACK_STOPWORDS = tuple("a an and are as at be been being by for from in is it its of on or that the these this those to was were with".split())

TOKEN = r"[0-9A-Za-z.%$£¥€-]+"
MAPPING_TOKEN = r"[0-9A-Za-z./%-]+"
RID = r"^[0-9]{10}(-[0-9]{2})(-[0-9]{6})::text::chunk-[0-9]+$"
CHUNK_NO = r"::text::chunk-([0-9]+)$"


def _in(values) -> list:
    return [F.lit(v) for v in values]


def tokens(text: Column, least: int = 2, stop: tuple[str, ...] = STOPWORDS) -> Column:
    """BM25 tokens: lower case, at least ``least`` characters, no stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= least) & ~t.isin(list(stop)))


def mapping_tokens(text: Column) -> Column:
    """Tokens of the concept mapping: no stop list, slash allowed."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(MAPPING_TOKEN), F.lit(0))


def collapsed(text: Column) -> Column:
    """Lower case with every white-space run one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def word_set(text: Column, stop: tuple[str, ...] = PACK_STOPWORDS) -> Column:
    """Distinct words of the packer, CJK included."""
    found = F.regexp_extract_all(collapsed(text), F.lit(r"(?U)[\w一-鿿]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(list(stop))))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def sentences(text: Column) -> Column:
    """CJK marks become ASCII ones; a mark before space or the end closes a sentence."""
    marked = F.translate(F.coalesce(text, F.lit("")), "。；！？", ".;!?")
    cut = F.regexp_replace(marked, r"([.!?])(\s|$)", "$1\n")
    return F.filter(F.transform(F.split(cut, "\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def units(text: Column) -> Column:
    """Chunking units: bullet lines whole, other lines cut after . ? ! ; : and dashes."""
    bullet = r"^([•–—-]|\(\s*([ivxlcdm]+|[0-9]+|[A-Za-z])\s*\)|([0-9]+|[A-Za-z])\.)\s+"
    stripped = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    per_line = F.transform(F.filter(stripped, lambda s: s != ""), lambda s: F.when(s.rlike(bullet), F.array(s)).otherwise(F.split(s, r"(?<=[.?!。！？;:—–])\s+")))
    return F.filter(F.transform(F.flatten(per_line), F.trim), lambda s: s != "")


def ascii_marks(text: Column) -> Column:
    """Typographic marks to ASCII, blanks and line ends normalised."""
    t = F.translate(text, "—–• ", "--* ")
    t = F.replace(F.replace(t, F.lit("☒"), F.lit("[X]")), F.lit("☐"), F.lit("[ ]"))
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), r"\s*[\n]\s*", "\n"))


def spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), " ", " "), r"\s+", " "))


def strip_html(html: Column) -> Column:
    """Tags become blanks; white space collapses."""
    return spaces(F.regexp_replace(html, "<[^>]+>", " "))


def search_tokens(*parts: Column) -> Column:
    """Label search tokens: lower case, other signs than ``- / %`` become blanks;
    null where nothing is left."""
    clean = [F.trim(F.regexp_replace(F.lower(p), r"(?U)[^\w\s/%-]+", " ")) for p in parts]
    joined = F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in clean])
    return F.nullif(F.regexp_replace(joined, r"\s+", " "), F.lit(""))


def title(heading: Column, ticker: Column, form: Column, fy: Column) -> Column:
    """``Heading [TICKER FORM FYyear]`` with whatever is known."""
    blank = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    tail = F.concat_ws(" ", blank(ticker), blank(form), F.concat(F.lit("FY"), blank(fy)))
    head = F.coalesce(blank(heading), F.lit("Untitled"))
    return F.when(tail == "", head).otherwise(F.concat(head, F.lit(" ["), tail, F.lit("]")))


def snippet(text: Column, size: int = 420) -> Column:
    """The first ``size`` characters, with dots where cut."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\n", " "))
    return F.when(F.length(t) <= size, t).otherwise(F.concat(F.substring(t, 1, size), F.lit("...")))


def best_window(text: Column, terms: Column, size: int = 700) -> Column:
    """Keyword window: the first word position whose +-20 words hold most terms;
    eighty words from twenty before it, cut at ``size`` characters."""
    t = F.trim(F.translate(F.coalesce(text, F.lit("")), "\n", " "))
    words = F.split(t, r"\s+")
    hit = F.transform(words, lambda w: F.array_contains(terms, F.regexp_replace(F.lower(w), r"^[.,;:()]+|[.,;:()]+$", "")))
    at = F.filter(F.transform(hit, lambda h, i: F.when(h, i)), lambda i: i.isNotNull())
    left = lambda p: F.greatest(F.lit(0), p - 20)
    count = lambda p: F.size(F.filter(F.slice(hit, left(p) + 1, F.lit(20) + p - left(p)), lambda h: h))
    best = F.aggregate(at, F.struct(F.lit(-1).alias("n"), F.lit(0).alias("l")), lambda a, p: F.when(count(p) > a["n"], F.struct(count(p).alias("n"), left(p).alias("l"))).otherwise(a))
    cut = F.substring(F.array_join(F.slice(words, best["l"] + 1, F.lit(80)), " "), 1, size)
    return F.when(F.length(t) <= size, t).when(F.size(at) == 0, F.substring(t, 1, size)).otherwise(cut)


def section_tag(text: Column) -> Column:
    """Risk factors, forward-looking statements or management's discussion."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(low.contains("item 1a") & low.contains("risk"), "risk_factors")
        .when(low.contains("forward-looking"), "fwd_statements")
        .when(low.contains("md&a") | low.rlike("management['’]s discussion"), "md&a")
    )


def mentions_other_years(text: Column) -> Column:
    """A year 2010-2025 followed by an annual-report form name."""
    return F.coalesce(text, F.lit("")).rlike(r"(?i)\b20(1[0-9]|2[0-5])\b\s+(form\s+|annual\s+report\s+(on\s+form\s+)?)?10[-–—]k")


def is_table_lead(text: Column) -> Column:
    """A ``[TABLE ...]`` mark, or words that announce a table at the line's end."""
    lead = r"(?i)(the following( table)?|(are|were) as follows|present(ed)? (below|as follows)|presents (below|as follows)|\(in (thousands|millions)\):)\s*(\[\w+\])?\s*$"
    t = F.trim(text)
    return t.rlike(r"^\[(TABLE|Table)\b.*\]$") | t.rlike(lead)


def is_heading(text: Column) -> Column:
    """Note or item numbers, short capitals, or a short capitalised line."""
    s = F.trim(text)
    return s.rlike(r"(?i)^(note\s+[0-9]+|item\s+[0-9]+[a-z]?)\b") | ((s == F.upper(s)) & s.rlike(r"\p{L}") & F.length(s).between(3, 70)) | s.rlike(r"^[A-Z][0-9A-Za-z\s,&-]{0,70}$")


def is_noise(text: Column, retrieval_only: bool = True, min_chars: int = 30) -> Column:
    """Empty or punctuation-only lines; with ``retrieval_only`` off also short
    lines without a number, date or rule, and running heads."""
    bare = (F.coalesce(text, F.lit("")) == "") | text.rlike(r"^[\W_]+$")
    if retrieval_only:
        return bare
    telling = text.rlike(r"[0-9]|[☒☐]|(?i)\bP[0-9]+[YMD]|\bcommission file number\b")
    head = text.rlike(r"(?i)^\s*((table of )?contents|index|signatures?|united states|(page|exhibit)\s+[0-9]+|securities and exchange commission)\s*$")
    return bare | (~is_heading(text) & (((F.length(text) < min_chars) & ~telling) | head))


def keep_for_retrieval(text: Column) -> Column:
    """Drops short figures, boilerplate titles and the regulator's address line."""
    t = F.trim(F.coalesce(text, F.lit("")))
    junk = t.rlike(r"^[0-9.,-]{1,6}$") | t.rlike(r"(?i)^(form\s+10-[kq]|index|signatures|table\s+of\s+contents)$") | (t.rlike(r"(?i)^washington,\s*d\.c\.(\s*[0-9]{5}(-[0-9]{4})?)?$") & (F.length(t) <= 30))
    return (t != "") & ~junk


def split_words(text: Column) -> Column:
    """Words between runs of SQL's white space (no vertical tab), the outer
    Unicode blanks cut off; an empty text is one empty word, null stays null."""
    return F.split(F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+\z", ""), r"[\t\n\f\r ]+")


def tail_words(text: Column, n: int) -> Column:
    words = split_words(text)
    return F.when(F.size(words) <= n, text).otherwise(F.array_join(F.slice(words, -n, n), " "))


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int"))


def mixed_tokens(text: Column) -> Column:
    """CJK characters count one each, others a quarter."""
    cjk = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[一-鿿]"))
    return F.greatest(F.lit(1), (cjk + F.floor((F.length(F.coalesce(text, F.lit(""))) - cjk) / 4)).cast("int"))


def word_count(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def chunk_no(rid: Column) -> Column:
    """The chunk number of a record id, null where it has none."""
    return F.nullif(F.regexp_extract(F.coalesce(rid, F.lit("")), CHUNK_NO, 1), F.lit("")).cast("int")


def fact_line(**parts: Column) -> Column:
    """``name: value | ...`` of the parts that are not blank."""
    return F.concat_ws(" | ", *[F.concat(F.lit(k + ": "), F.nullif(F.trim(v.cast("string")), F.lit(""))) for k, v in parts.items()])


ROLE_NAMES = {"label": "standard", "terseLabel": "terse", "verboseLabel": "verbose", "totalLabel": "total"}
LANG_NAMES = {"en-us": "en-US", "en-gb": "en-GB", "zh-cn": "zh"} | {k: k for k in ("en", "nl", "zh")}


def _named(names: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)


def role_name(uri: Column) -> Column:
    """Short name of a label role: the last path part, shortened for the common
    roles; ``standard`` where there is none."""
    last = F.regexp_extract(F.coalesce(uri, F.lit("")), r"([^/]*)$", 1)
    return F.when(F.coalesce(uri, F.lit("")) == "", "standard").otherwise(F.coalesce(_named(ROLE_NAMES, last), last))


def lang_tag(lang: Column) -> Column:
    """Known language tags in their usual spelling, others unchanged, blank null."""
    return F.when(F.trim(lang) != "", F.coalesce(_named(LANG_NAMES, F.lower(F.trim(lang))), lang))


def path_meta(path: Column) -> dict[str, Column]:
    """Ticker, year, form and accession number from a file path."""
    accno = F.regexp_extract(path, r"([0-9]{10})-?([0-9]{2})-?([0-9]{6})", 0)
    named = r"(?:^|/)US_([A-Za-z0-9.]+)_([0-9]{4})_([0-9A-Za-z-]+)_[0-9-]+\."
    blank = lambda c: F.nullif(c, F.lit(""))
    return {
        "ticker": F.coalesce(blank(F.upper(F.regexp_extract(path, named, 1))), blank(F.upper(F.regexp_extract(path, r"([A-Za-z.]+)/[0-9]{4}/[^/]+_[0-9-]+/[^/]*$", 1)))),
        "year": F.coalesce(blank(F.regexp_extract(path, named, 2)), blank(F.regexp_extract(path, r"/((?:19|20)[0-9]{2})/", 1))).try_cast("int"),
        "form": F.coalesce(blank(F.upper(F.regexp_extract(path, named, 3))), blank(F.upper(F.regexp_extract(path, r"/((?:10-[KQ]|8-K|20-F|6-K|DEF14A)(?:/A)?)_[0-9-]+/", 1)))),
        "accno": blank(F.regexp_replace(F.regexp_replace(accno, "-", ""), r"^([0-9]{10})([0-9]{2})([0-9]{6})$", "$1-$2-$3")),
    }
