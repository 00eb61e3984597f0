"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

Frequent space-delimited words, counted over the whole corpus, are compiled
into one automaton with shared suffixes.  Its arcs carry numbers whose sum along
a word's path is the word's place in an id table, so suffixes are shared although
ids differ.  The automaton is a set of flat arrays in the shared folder that
every worker maps into memory.  Words it lacks are merged exactly by the
tokenizer's own rules, and both kinds stay in a bounded cache of the worker.

Space never takes part in a token of such a vocabulary, so encoding word by
word equals encoding the text.
"""

from __future__ import annotations

import io
import json
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import local_file, one_thread, pick, scratch, stored

#: White space as the tokenizer's normaliser sees it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = re.compile(f"[^{SPACE}]+")
#: Words for which normalisation is lower-casing: ASCII and composed Latin letters.
_SIMPLE = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+\Z")
_LOW = r"a-z\u00df-\u00f6\u00f8-\u017f"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LOW}]+|[0-9]|[^{_LOW}0-9]+")
_ODD = re.compile("[\x1c-\x1f]")  # space for str.split, not for the tokenizer


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text) if _ODD.search(text) else text.split()


class Transducer:
    """Minimal acyclic automaton from words to values, as flat arrays.

    ``arcs`` holds ``state * 256 + byte`` in order, ``to`` and ``add`` the
    target and the number added on that arc.  ``final`` marks accepting states.
    ``first`` and ``ids`` are the value table.
    """

    NAMES = ("arcs", "to", "add", "final", "first", "ids")

    def __init__(self, arcs, to, add, final, first, ids):
        self.arcs, self.to, self.add, self.final, self.first, self.ids = arcs, to, add, final, first, ids

    @classmethod
    def build(cls, entries: dict[bytes, bytes]) -> Transducer:
        """Words (UTF-8) to values (little-endian 32-bit ids); incremental
        construction over sorted words, each state registered once its right
        language is complete."""
        register: dict[tuple, int] = {}
        states: list[tuple[tuple[tuple[int, int], ...], bool]] = []
        path: list[list] = [[[], False]]  # unfinished states: [arcs, final]

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                arcs, final = path.pop()
                key = (tuple(arcs), final)
                if key not in register:
                    register[key] = len(states)
                    states.append(key)
                path[-1][0][-1] = (path[-1][0][-1][0], register[key])

        before = b""
        order = sorted(entries)
        for word in order:
            common = 0
            while common < min(len(word), len(before)) and word[common] == before[common]:
                common += 1
            close(common)
            for byte in word[common:]:
                path[-1][0].append((byte, -1))
                path.append([[], False])
            path[-1][1] = True
            before = word
        close(0)
        states.append((tuple(path[0][0]), path[0][1]))
        words = [0] * len(states)  # accepted words from each state; targets come first
        arcs, to, add = [], [], []
        for s, (out, final) in enumerate(states):
            total = int(final)
            for byte, target in out:
                arcs.append(s * 256 + byte)
                to.append(target)
                add.append(total)
                total += words[target]
            words[s] = total
        values = [entries[w] for w in order]
        first = np.concatenate([[0], np.cumsum([len(v) // 4 for v in values], dtype=np.int64)]).astype(np.int64)
        return cls(np.array(arcs, np.int64), np.array(to, np.int32), np.array(add, np.int32), np.array([f for _, f in states], bool), first, np.frombuffer(b"".join(values), np.uint32))

    def save(self, folder: str) -> None:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for name in self.NAMES:
            buf = io.BytesIO()
            np.save(buf, getattr(self, name))
            with fs.open_output_stream(f"{root}/{name}.npy") as out:
                out.write(buf.getvalue())

    @classmethod
    def load(cls, folder: str) -> Transducer:
        """Map the arrays of a shared mount into memory; other file systems are read."""
        at = Path(local_file(folder))
        if at.is_dir():
            return cls(*[np.load(at / f"{n}.npy", mmap_mode="r") for n in cls.NAMES])
        fs, root = pafs.FileSystem.from_uri(folder)
        return cls(*[np.load(io.BytesIO(fs.open_input_file(f"{root}/{n}.npy").read())) for n in cls.NAMES])

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """Values of the words, None where the automaton lacks one.

        All words step together, one byte a round.
        """
        if not words or not len(self.arcs):
            return [None] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        joined = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        state, total = np.full(len(words), len(self.final) - 1, np.int64), np.zeros(len(words), np.int64)
        alive, depth = np.arange(len(words)), 0
        while True:
            live = alive[size[alive] > depth]
            if not len(live):
                break
            key = state[live] * 256 + joined[start[live] + depth]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            ok = self.arcs[at] == key
            state[live[~ok]] = -1
            hit = live[ok]
            state[hit], total[hit] = self.to[at[ok]], total[hit] + self.add[at[ok]]
            alive, depth = hit, depth + 1
        out: list[bytes | None] = [None] * len(words)
        for i in np.flatnonzero((state >= 0) & self.final[state] & (size > 0)).tolist():
            out[i] = self.ids[self.first[total[i]] : self.first[total[i] + 1]].tobytes()
        return out


def _is_word_vocabulary(model) -> bool:
    """Whether the tokenizer normalises and splits as the quick path does."""
    told = json.loads(model.to_str())
    norm = [n["type"] for n in (told["normalizer"] or {}).get("normalizers", [])]
    split = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
    pattern = split[0].get("pattern", {}).get("Regex") if split else None
    return norm == ["NFC", "Replace", "Lowercase"] and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and [p["type"] for p in split] == ["Split", "ByteLevel"] and not told["model"]["dropout"]


class Codec:
    """Encoder and decoder of one worker: automaton, exact merges, cache."""

    _mine: dict[tuple, Codec] = {}

    def __init__(self, tokenizer: str, lexicon: str | None = None, cache: int = 250_000):
        one_thread()
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(tokenizer)
        self.model.no_padding()
        self.model.no_truncation()
        self.lexicon = Transducer.load(lexicon) if lexicon else None
        self.limit, self.cache, self.pieces, self.letters = cache, {}, {}, _byte_letters()
        self.simple = _is_word_vocabulary(self.model)
        self.tokens = [self.model.id_to_token(i) or "" for i in range(max(self.model.get_vocab(with_added_tokens=True).values()) + 1)]
        self.numbers = [str(i) for i in range(len(self.tokens))]
        self.four = [i.to_bytes(4, "little") for i in range(len(self.tokens))]

    @classmethod
    def of(cls, tokenizer: str, lexicon: str | None = None, cache: int = 250_000) -> Codec:
        """The worker's codec; another lexicon or cache size replaces it."""
        key = (tokenizer, lexicon, cache)
        if key not in cls._mine:
            cls._mine.clear()
            cls._mine[key] = cls(tokenizer, lexicon, cache)
        return cls._mine[key]

    def merge(self, words: list[str]) -> list[bytes]:
        """Exact merges of words, as little-endian 32-bit ids.

        A simple word is cut into the pre-tokeniser's pieces, each merged by
        the model; any other word takes the whole tokenizer.
        """
        out, odd, pieces, tokenize, four = [], [], self.pieces, self.model.model.tokenize, self.four
        for i, word in enumerate(words):
            # A plain word, perhaps with one mark behind it, needs no pattern.
            stem = word if word.isalpha() else word[:-1]
            if self.simple and _SIMPLE.match(word) and "<|" not in word:
                if stem.isalpha() and (stem is word or word[-1] != "'"):
                    cut = (stem.lower(),) if stem is word else (stem.lower(), word[-1])
                    if stem is not word and (word[-1].isalnum() or not word[-1].isascii()):
                        cut = _PIECE.findall(word.lower())
                else:
                    cut = _PIECE.findall(word.lower())
                got = []
                for piece in cut:
                    ids = pieces.get(piece)
                    if ids is None:
                        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
                        ids = b"".join([four[t.id] for t in tokenize(shown)])
                        if len(pieces) >= self.limit // 2:
                            pieces.clear()
                        pieces[piece] = ids
                    got.append(ids)
                out.append(got[0] if len(got) == 1 else b"".join(got))
            else:
                odd.append(i)
                out.append(b"")
        if odd:
            for i, e in zip(odd, self.model.encode_batch_fast([words[i] for i in odd], add_special_tokens=False)):
                out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def learn(self, words: list[str]) -> None:
        """Put words into the cache, from the automaton or by merging."""
        if len(self.cache) + len(words) > self.limit:
            self.cache.clear()
        if self.lexicon is not None:
            found = self.lexicon.find([w.encode("utf-8", "surrogatepass") for w in words])
            self.cache.update((w, v) for w, v in zip(words, found) if v is not None)
            words = [w for w, v in zip(words, found) if v is None]
        if words:
            self.cache.update(zip(words, self.merge(words)))

    def encode_texts(self, texts: list[str | None], step: int = 64) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit integers; null is empty."""
        out = []
        for s in range(0, len(texts), step):
            get, missing, todo = self.cache.get, set(), []
            for t in texts[s : s + step]:
                words = words_of(t) if t else []
                got = list(map(get, words))
                gaps = [i for i, v in enumerate(got) if v is None] if None in got else ()
                missing.update([words[i] for i in gaps])
                todo.append((words, got, gaps))
            if missing:
                self.learn(list(missing))
            one = self.cache.__getitem__
            for words, got, gaps in todo:
                for i in gaps:
                    got[i] = one(words[i])
                out.append(b"".join(got))
        return out

    def decode(self, ids) -> str:
        """Tokens of the ids joined by a space: this vocabulary has no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


def frequent_words(docs: DataFrame, text_col: str = "text", limit: int = 65_536, least: int = 2) -> list[str]:
    """The ``limit`` most frequent space-delimited words of all texts.

    One pass with map-side counts.  The frequency that at most ``limit`` words
    reach comes from a histogram of counts (16 levels an octave), so the driver
    and the lexicon hold no more than that, whatever the corpus holds.
    """
    words = pick(docs, text=text_col).select(F.explode(F.split("text", r"[ \t-\r]+")).alias("w")).where("w <> '' and octet_length(w) <= 64")
    counts = stored(words.groupBy("w").count().where(F.col("count") >= least), "word-counts")
    level = F.floor(F.log2("count") * 16)
    room, floor = limit, None
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        room -= r["count"]
        if room < 0:
            break
        floor = r["level"]
    return [] if floor is None else sorted(r["w"] for r in counts.where(level >= floor).select("w").collect())


def compile_lexicon(docs: DataFrame, tokenizer: str, text_col: str = "text", limit: int = 65_536) -> str:
    """Compile the frequent words and return the automaton's shared folder.

    Null and empty texts hold no word; repeated rows count each; words met once or
    longer than 64 bytes are left to merging, and an empty table gives an empty
    automaton, with which encoding is the same but slower.  Only ``text_col`` is read.
    """
    words = [w for w in frequent_words(docs, text_col, limit) if len(words_of(w)) == 1]
    codec = Codec(tokenizer)
    folder = scratch(docs.sparkSession, "lexicon")
    Transducer.build({w.encode(): v for w, v in zip(words, codec.merge(words))} if words else {}).save(folder)
    return folder


def encode(docs: DataFrame, tokenizer: str, lexicon: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` per row; null and empty texts have no ids.

    Ids equal those of the tokenizers library without added special tokens;
    special tokens in a text are recognised as the library does.  No shuffle.
    Null and repeated ids pass through; only the two named columns are read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        codec = Codec.of(tokenizer, lexicon)
        for batch in batches:
            got = codec.encode_texts(batch.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in got])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(got), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], schema=schema)

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` per row of ids, special tokens kept; null ids give null."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        codec = Codec.of(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if i is None else codec.decode(i) for i in batch.column(1).to_pylist()], pa.string())], schema=schema)

    rows = pick(encoded, doc_id=id_col, ids=ids_col).select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return rows.mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str, lexicon: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: both directions in one
    pass over Arrow batches, so ids never travel back to the JVM."""
    from hashlib import sha256

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        codec = Codec.of(tokenizer, lexicon)
        number = codec.numbers.__getitem__
        for batch in batches:
            n, a, b = [], [], []
            for raw in codec.encode_texts(batch.column(1).to_pylist()):
                ids = np.frombuffer(raw, "<u4").tolist()
                n.append(len(ids))
                a.append(sha256(" ".join(map(number, ids)).encode()).hexdigest())
                b.append(sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], schema=schema)

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
