"""Toxicity of deobfuscated text.

Noisy channel: an obfuscated word is the observation of a clean one whose
letters were replaced by look-alikes, repeated, or set apart.  Its character
lattice is decoded by Viterbi under a character trigram model counted over all
documents.  Blanks and separators are arcs of the lattice: between single
characters a word may end, and between fragments, one of which is no usual short
word, a word may go on.  Words that hold nothing but single letters have a
lattice of one path and need no decoding.  The restored words are scored by
logistic regression over word stems, learned from labelled rows outside the
held-out fold.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, pick, stored

#: Look-alikes and their channel costs (nats).
LOOKALIKE = {
    "0": (("o", 1.0),), "1": (("i", 1.0), ("l", 1.2)), "3": (("e", 1.0),), "4": (("a", 1.0),), "5": (("s", 1.0),), "6": (("g", 1.6), ("b", 1.8)), "7": (("t", 1.0),),
    "8": (("b", 1.0),), "9": (("g", 1.2),), "2": (("z", 1.6),), "@": (("a", 0.8),), "$": (("s", 0.8),), "!": (("i", 1.0), ("l", 1.6)), "|": (("l", 1.0), ("i", 1.0)),
    "+": (("t", 1.2),), "(": (("c", 1.6),), "€": (("e", 1.0),), "£": (("l", 1.0),), "¡": (("i", 1.0),), "#": (("h", 2.0),), "%": (("o", 2.5),),
}
DROP_EDGE, DROP_INSIDE, DOUBLE, SINGLE, MASKED, SPLIT, JOIN = 9.0, 12.0, 0.5, 1.0, 1.5, 1.0, 2.0
#: Share of all words below which a word of up to three letters is no usual one.
RARE = 1e-5
_LETTERS = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile(r"\W*([^\W\d_]+(?:['’,;:/?]+[^\W\d_]+)*)\W*\Z")
_RUN3 = re.compile(r"([^\W\d_])\1\1")
_RUN = re.compile(r"(.)\1*", re.S)
_MARKS = "".join(chr(c) for c in range(0x2100) if not chr(c).isalnum() and chr(c) not in LOOKALIKE)
_APART = re.compile("[" + re.escape(_MARKS.replace("*", "")) + "]+")
_CODES = 64
_CODE = np.array([0 if not chr(c).isalpha() else c - 96 if 97 <= c <= 122 else 27 + c % 37 for c in range(0x110000)], np.int64)


def code_of(ch: str) -> int:
    return int(_CODE[ord(ch)])


def trigram_table(texts: list[str | None]) -> np.ndarray:
    """Counts of folded character trigrams, then of words of up to three letters,
    flat; non-letters are the boundary.  The last cell counts all words."""
    c = _CODE[np.frombuffer((" " + "  ".join((t or "").lower() for t in texts) + "    ").encode("utf-32-le", "surrogatepass"), np.uint32)]
    tri = np.bincount((c[:-2] * _CODES + c[1:-1]) * _CODES + c[2:], minlength=_CODES**3)
    at = np.flatnonzero((c[:-4] == 0) & (c[1:-3] != 0)) + 1
    brief = at[(c[at + 1] == 0) | (c[at + 2] == 0) | (c[at + 3] == 0)]
    second = c[brief + 1]
    words = np.bincount((c[brief] * _CODES + second) * _CODES + np.where(second == 0, 0, c[brief + 2]), minlength=_CODES**3)
    return np.concatenate([tri, words, [len(at)]])


class CharModel:
    """Interpolated character trigram model over folded letters."""

    def __init__(self, counts: np.ndarray):
        tri = counts[: _CODES**3].reshape(_CODES, _CODES, _CODES).astype(float)
        tri[:, 0, 0] = 0
        bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
        p1 = (uni + 1) / (uni.sum() + _CODES)
        p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
        p3 = (tri + 5 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).astype(np.float32)
        self.usual = counts[_CODES**3 : 2 * _CODES**3] > RARE * counts[-1]
        self.known: dict[str, bool] = {}
        self.joined: dict[str, tuple] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "joined": {}}

    def odd(self, token: str) -> bool:
        """True for a token of one to three characters that is no usual word."""
        got = self.known.get(token)
        if got is None:
            if len(self.known) > 100_000:
                self.known.clear()
            word = token.strip(_MARKS) if len(token) > 1 else token
            got = 0 < len(word) < 4 and all(ch.isalpha() or ch in LOOKALIKE for ch in word) and any(ch.isalpha() for ch in word)
            if got and word.isalpha():
                code = [code_of(ch) for ch in word] + [0, 0]
                got = not self.usual[(code[0] * _CODES + code[1]) * _CODES + code[2]]
            self.known[token] = got
        return got

    def rejoined(self, tokens: list[str], reach: int = 8) -> list[str]:
        """Words that the lattice puts together from fragments next to each other.

        A fragment has up to three characters; a run of two or more with an odd
        one is decoded with its blanks, each of which may stay or go.  Runs of
        single characters are left to ``set_apart``; a longer run than ``reach``
        is decoded around each odd fragment.
        """
        odd = [i for i, t in enumerate(tokens) if len(t) < 6 and self.odd(t)]
        out: list[str] = []
        end = -1
        for i in odd:
            if i < end:
                continue
            a = b = i
            while a > max(0, i - reach) and brief(tokens[a - 1]):
                a -= 1
            b = i + 1
            while b < min(len(tokens), i + reach) and brief(tokens[b]):
                b += 1
            end = b
            run = [t.strip(_MARKS) if len(t) > 1 else t for t in tokens[a:b]]
            if b - a > 1 and any(len(t) > 1 for t in run):
                out += self._join(" ".join(run))
        return out

    def _join(self, seen: str) -> tuple:
        got = self.joined.get(seen)
        if got is None:
            if len(self.joined) > 50_000:
                self.joined.clear()
            before = set(seen.split(" "))
            got = self.joined[seen] = tuple(w for w in self.restore(seen).split(" ") if len(w) > 3 and w not in before)
        return got

    def restore(self, seen: str, split: bool = False) -> str:
        """Viterbi decoding of one lower-case token; states are the last two codes.

        With ``split`` a space may follow each character, as the boundary code;
        a space that is there stays or goes.
        """
        cost = self.cost
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        runs = [m.group() for m in _RUN.finditer(seen)]
        for at, run in enumerate(runs):
            ch, edge = run[0], at in (0, len(runs) - 1)
            if ch == " ":
                options = [(" ", 0.0), ("", JOIN)]
            elif ch.isalpha():
                options = [(ch, 0.0)] if len(run) == 1 else [(ch * 2, DOUBLE if len(run) > 2 else 0.0), (ch, SINGLE)]
            elif ch in LOOKALIKE:
                options = [("", DROP_EDGE if edge else DROP_INSIDE)]
                for letter, price in LOOKALIKE[ch]:
                    options.append((letter, price))
                    if len(run) > 1:
                        options.append((letter * 2, price + DOUBLE))
            else:
                options = [("", 0.0 if edge else 0.5)]
                if ch == "*" and not edge:
                    options += [(v, MASKED) for v in "aeiou"]
            if split and at < len(runs) - 1:
                options += [(piece + " ", price + SPLIT) for piece, price in options if piece]
                if ch in LOOKALIKE:
                    options.append((" ", DROP_EDGE + SPLIT))
            if split and ch.isalpha() and len(run) > 1:
                options.append((f"{ch} {ch}", SPLIT + (DOUBLE if len(run) > 2 else 0.0)))
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (total, back) in paths.items():
                for piece, price in options:
                    x, y, t = a, b, total + price
                    for letter in piece:
                        z = code_of(letter)
                        t += float(cost[x, y, z])
                        x, y = y, z
                    if (x, y) not in step or t < step[x, y][0]:
                        step[x, y] = (t, (back, piece) if piece else back)
            paths = step
        _, back = min(((t + float(cost[a, b, 0]), back) for (a, b), (t, back) in paths.items()), key=lambda p: p[0])
        out = []
        while back:
            back, piece = back
            out.append(piece)
        return "".join(reversed(out))

    def words(self, token: str) -> list[str]:
        """Clean words of one lower-case space-delimited token."""
        inner = parts(token)
        if not inner:
            return self._whole(token)
        found = self.set_apart(inner) if "'" in token or "’" in token else self.apart(inner)  # an apostrophe is spelling
        return [*(w for w in found if len(w) > 1), *self._whole(token)]

    def apart(self, tokens: list[str]) -> list[str]:
        """Words written apart: single characters, and fragments."""
        return [*self.set_apart(tokens), *self.rejoined(tokens)]

    def set_apart(self, tokens: list[str]) -> list[str]:
        """Words of the runs of single characters: as split by the lattice, and as one."""
        return [w for run in spaced_words(tokens) for w in dict.fromkeys([*self.restore(run, True).split(), self.restore(run)]) if w]

    def _whole(self, token: str) -> list[str]:
        m = _PLAIN.match(token)
        if m and not _RUN3.search(token) and not (len(token) > m.end(1) and token[m.end(1) :] in LOOKALIKE) and not (m.start(1) == 1 and token[0] in LOOKALIKE):
            return _LETTERS.findall(m.group(1))
        if not any(ch.isalpha() for ch in token):
            return []
        got = self.restore(token)
        plain = _LETTERS.findall(token) if not _RUN3.search(token) else []
        return [got, *(w for w in plain if w != got and len(w) > 2)] if got else plain


@lru_cache(1 << 16)
def brief(token: str) -> bool:
    """True for one to three letters or look-alikes, besides marks."""
    word = token.strip(_MARKS) if 1 < len(token) < 6 else token
    return 0 < len(word) < 4 and all(ch.isalpha() or ch in LOOKALIKE for ch in word)


def parts(token: str) -> list[str]:
    """What marks inside a token separate; nothing if there are none."""
    return _APART.split(token) if len(token) > 4 and not token.isalnum() and _APART.search(token, 1, len(token) - 1) else []


@lru_cache(1 << 16)
def single(token: str) -> str:
    """The one letter or look-alike that a token holds besides marks, or nothing."""
    if len(token) > 1:
        token = token.strip(_MARKS)
        if len(token) == 2 and (token[0].isalpha() != token[1].isalpha()) and not token.isalnum():
            token = token[0] if token[0].isalpha() else token[1]
    return token if len(token) == 1 and (token.isalpha() or token in LOOKALIKE) else ""


def spaced_words(tokens: list[str]) -> list[str]:
    """Runs of three or more single characters, joined: words set apart letter by letter."""
    out, run, before = [], [], -2
    for i in [i for i, t in enumerate(tokens) if len(t) < 5 and (len(t) == 1 or not t.isalnum()) and single(t)] + [-9]:
        if i == before + 1:
            run.append(single(tokens[i]))
        else:
            if len(run) > 2:
                out.append("".join(run))
            run = [single(tokens[i])] if i >= 0 else []
        before = i
    return out


STEMS = (4, 5, 6, 7)


def stems(word: str) -> list[str]:
    """Prefixes of a word, and the whole word with an end mark."""
    return [word[:k] for k in STEMS if len(word) >= k] + ([word + "."] if len(word) > 2 else [])


def low_hashes(text: str) -> tuple[int, int, int]:
    """Three minimum hashes of a text's word trigrams (of its words, if fewer)."""
    c = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in text.lower().split()], np.uint64)
    if len(c) > 2:
        c = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:]
    if not len(c):
        return 0, 0, 0
    h = c ^ (c >> np.uint64(29))
    return tuple(int((h * np.uint64(m) >> np.uint64(2)).min()) for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def none_of(token: str, heads: set[str]) -> bool:
    """True if the token is plain letters, perhaps with one mark behind, and its
    first three letters start no stem: a quick no for most tokens."""
    word = token if token.isalpha() else token[:-1] if token[-1] in ".,;:" else ""
    return word.isalpha() and word[:3] not in heads and (len(word) < 3 or (word[0] != word[1] != word[2] != word[3:4])) and not _RUN3.search(word)


def stem_counts(tokens: set[str], known: dict[str, tuple]) -> dict:
    """Distinct tokens by stem, for tokens with a stem that counts."""
    out: dict = {}
    for t in tokens & known.keys():
        for k in known[t]:
            out[k] = out.get(k, 0) + 1
    return out


def fit_logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, ridge: float = 0.02, rounds: int = 800) -> tuple[np.ndarray, float]:
    """Weights and bias of ridge logistic regression over sparse features (Adam)."""
    w, bias = np.zeros(width + 1), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    w[width] = bias
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(rows, values * w[cols], minlength=len(y)) + w[width]
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.append(np.bincount(cols, values * miss[rows], minlength=width)[:width] + ridge * w[:width], miss.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w[:width], float(w[width])


class Scorer:
    """Logistic model over how many distinct words of a text share each stem."""

    def __init__(self, model: CharModel, weights: dict[str, float], bias: float):
        self.model, self.weights, self.bias = model, weights, bias
        self.heads = {k[:3] for k in weights}
        self.clean: set[str] = set()
        self.hot: dict[str, tuple] = {}

    def __getstate__(self):
        return self.__dict__ | {"clean": set(), "hot": {}}

    def stems_of(self, token: str) -> tuple:
        if none_of(token, self.heads):
            return ()
        found = set()
        for w in (*self.model.words(token), *self.starts(parts(token))):
            found.update(k for k in stems(w) if k in self.weights)
            short = _RUN.sub(r"\1", w)
            if short != w and len(short) > 3 and short + "." in self.weights:
                found.update(k for k in stems(short) if k in self.weights)
        return tuple(found)

    def starts(self, tokens: list[str]) -> list[str]:
        """What follows each place in a word put together from single characters or
        fragments where a stem that speaks for label 1 starts: it may begin anywhere."""
        whole = [*(self.model.restore(run) for run in spaced_words(tokens)), *self.model.rejoined(tokens)]
        return [w[i : i + STEMS[-1]] for w in whole for i in range(len(w) - STEMS[0] + 1) if any(self.weights.get(w[i : i + k], 0) > 0 for k in STEMS)]

    def score(self, text: str | None) -> tuple[float, int]:
        """(probability that the label is 1, distinct words that count)."""
        tokens = text.lower().split() if text else []
        mine = set(tokens)
        mine.update(self.model.apart(tokens), self.starts(tokens))
        new = mine - self.clean
        new -= self.hot.keys()
        if new:
            if len(self.clean) > 300_000:
                self.clean = set()
            if len(self.hot) > 100_000:
                self.hot, new = {}, mine
            for t in new:
                found = self.stems_of(t)
                if found:
                    self.hot[t] = found
                else:
                    self.clean.add(t)
        counts = stem_counts(mine, self.hot) if self.hot else {}
        logit = self.bias + sum(self.weights[k] * math.log1p(n) for k, n in counts.items())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))), len(mine & self.hot.keys()) if counts else 0


def char_model(docs: DataFrame, text_col: str = "text") -> CharModel:
    """Counts over all texts: one dense table a task, summed; 2 * 64**3 + 1 cells at most."""
    schema = pa.schema([("slot", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(2 * _CODES**3 + 1, np.int64)
        for batch in batches:
            for s in range(0, len(batch), 64):
                total += trigram_table(batch.column(0).slice(s, 64).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], schema=schema)

    rows = pick(docs, text=text_col).select(F.col("text").cast("string")).where("text is not null")
    got = rows.mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * _CODES**3 + 1, np.int64)
    counts[got["slot"].to_numpy()] = got["n"].to_numpy()
    return CharModel(counts)


def learn(docs: DataFrame, labels: DataFrame, model: CharModel, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 20_000, decisive: bool = True, margin: float = 6.0, least: int = 5) -> Scorer:
    """Stem weights from at most ``max_labelled`` labelled rows, chosen by hash.

    Rows of the held-out fold, without a label or with a null id are not used;
    a document with conflicting labels counts under its largest.  Of rows that
    share one of three minimum hashes of their word trigrams one counts, or a
    text with many copies would teach its rare words.  Stems are candidates if
    twice as frequent in texts of label 1 as overall and their likelihood ratio
    beats what as many random stems would reach by ``margin`` nats; ridge
    logistic regression then weighs how many distinct words of a text share
    each of those in ``least`` texts of label 1.  With ``decisive`` a stem
    that is all but certain weighs enough to decide alone.  At most ``max_labelled`` rows of stem counts
    reach the driver.
    """
    spark = docs.sparkSession
    known = pick(labels, doc_id=id_col, y=label_col).select(F.col("doc_id").cast("long"), F.col("y").cast("int")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out())
    chosen = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")

    def sketch(batches):
        names = ["doc_id", "text", "y", "a", "b", "c"]
        for batch in batches:
            marks = np.array([low_hashes(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(marks[:, i]) for i in range(3)]], names=names)

    held = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
    sample = stored(held.mapInArrow(sketch, "doc_id long, text string, y int, a long, b long, c long").withColumn("r", F.monotonically_increasing_id()), "labelled")
    singles = sample.select("doc_id", "r", "a", "b", "c")
    for mark in ("a", "b", "c"):  # the smallest id stays, whatever the order of rows
        singles = singles.groupBy(mark).agg(F.min_by(F.struct(*singles.columns), F.struct("doc_id", "r")).alias("s")).select("s.*")
    singles = stored(singles.select("r"), "labelled-once")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)  # few small files would give few tasks
    sample = sample.join(F.broadcast(singles), "r", "left_semi").select("text", "y", "r").repartition(tasks, "r")
    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([("token", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())])

    def tally(batches):
        counts = (Counter(), Counter())

        def flush():
            keys = list(counts[0].keys() | counts[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([c[k] for k in keys], pa.int64()) for c in (counts[1], counts[0])]], schema=schema)
            counts[0].clear()
            counts[1].clear()
            return out

        docs_of = [0, 0]
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                y = int(y > 0)
                docs_of[y] += 1
                tokens = text.lower().split()
                counts[y].update({*tokens, *shared.value.apart(tokens)})
                if len(counts[0]) + len(counts[1]) > 400_000:
                    yield flush()
        counts[0][""], counts[1][""] = docs_of
        yield flush()

    def spread(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for token, pos, neg in zip(*[c.to_pylist() for c in batch.columns]):
                for stem in {s for w in shared.value.words(token) for s in stems(w)} if token else ("",):
                    for o, v in zip(out, (stem, pos, neg)):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(out, schema)], names=["stem", "pos", "neg"])

    tokens = sample.mapInArrow(tally, "token string, pos long, neg long").groupBy("token").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    summed = stored(tokens.mapInArrow(spread, "stem string, pos long, neg long").groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos > 0"), "stems")
    total = summed.where("stem = ''").first()
    p, n = (total["pos"], total["neg"]) if total else (0, 0)
    if not p or not n:
        return Scorer(model, {}, -2.0 if not p else 2.0)
    rate = p / (p + n)
    gain = F.col("pos") * F.log(F.col("pos") / (F.col("pos") + F.col("neg")) / rate) + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (F.col("pos") + F.col("neg")) / (1 - rate))).otherwise(0.0)
    tried = summed.where("pos >= 3").count()
    likely = summed.where("stem <> ''").where((F.col("pos") >= 3) & (F.col("pos") >= 2 * rate / (1 - rate) * F.col("neg"))).withColumn("gain", gain).where(F.col("gain") > math.log(max(tried, 1)) + margin)
    names = sorted(likely.select("stem").toArrow()["stem"].to_pylist())
    place = spark.sparkContext.broadcast({k: i for i, k in enumerate(names)})

    def hits(batches):
        """Row, label, stem and count of distinct words, for texts that hold a stem."""
        known: dict[str, tuple] = {}
        heads = {k[:3] for k in place.value}
        for batch in batches:
            out: list[list] = [[], [], []]
            for r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = text.lower().split()
                mine = {*tokens, *shared.value.apart(tokens)}
                if len(known) > 300_000:
                    known.clear()
                for t in mine - known.keys():
                    known[t] = () if none_of(t, heads) else tuple({place.value[s] for w in shared.value.words(t) for s in stems(w) if s in place.value})
                for k, n in stem_counts(mine, known).items():
                    for o, v in zip(out, (r, k, n)):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, f) for o, f in zip(out, (pa.int64(), pa.int32(), pa.int32()))], names=["r", "k", "n"])

    found = sample.select("r", "text").mapInArrow(hits, "r long, k int, n int").toArrow()
    truth = sample.select("r", F.col("y").cast("double").alias("y")).toArrow().to_pydict()
    row_of = {r: i for i, r in enumerate(truth["r"])}
    rows_at = np.array([row_of[r] for r in found["r"].to_pylist()], np.int64)
    y, k, n = np.array(truth["y"]), found["k"].to_numpy().astype(np.int64), np.log1p(found["n"].to_numpy())
    pos = np.bincount(k, (y[rows_at] > 0).astype(float), minlength=len(names))
    neg = np.bincount(k, minlength=len(names)) - pos
    seen = pos >= least  # in that many texts, not just in that many words
    use = seen[k]
    w, bias = fit_logistic(rows_at[use], k[use], n[use], (y > 0).astype(float), len(names))
    sure = pos / (pos + neg + 2)
    strong = seen & (sure >= 0.9) & decisive  # one word with such a stem decides alone
    w[strong] = np.maximum(w[strong], (np.log(sure[strong] / (1 - sure[strong])) - bias) / math.log(2))
    return Scorer(model, {name: float(v) for name, v, s in zip(names, w, seen) if s and abs(v) > 1e-3}, bias)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", scorer: Scorer | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_words`` per input row, no shuffle.

    ``score`` is the probability that the label is 1; null and empty texts have
    the score of a text without toxic words.  The model sent to tasks is
    64**3 floats, as many bits, and the stems that pass the test on the sample.  Null and repeated ids pass
    through; labels, language and ids are no inputs of a score.
    """
    scorer = scorer or learn(docs, labels, char_model(docs, text_col), id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_words", pa.int32())])

    def run(batches):
        one = shared.value.score
        for batch in batches:
            got = [one(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array([n for _, n in got], pa.int32())], schema=schema)

    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, score double, n_words int").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words")


def restore(docs: DataFrame, model: CharModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` with every token replaced by its restored words, joined by
    spaces.  Null stays null, a text without a token is empty, a token without a
    letter stays; ids pass through, repeated or null; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def one(text):
        if text is None:
            return None
        tokens = text.lower().split()
        out, i, model = [], 0, shared.value
        while i < len(tokens):
            j = i
            while j < len(tokens) and single(tokens[j]):
                j += 1
            if j - i > 2:
                out.append(model.restore("".join(map(single, tokens[i:j])), True))
                i = j
                continue
            j = i
            while j < len(tokens) and brief(tokens[j]):
                j += 1
            if j - i > 1 and any(map(model.odd, tokens[i:j])):
                out.append(model.restore(" ".join(t.strip(_MARKS) if len(t) > 1 else t for t in tokens[i:j])))
                i = j
            else:
                out += model.words(tokens[i])[:1] or [tokens[i]]
                i += 1
        return " ".join(out)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(t) for t in batch.column(1).to_pylist()], pa.string())], schema=schema)

    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, text string")
