"""Language identification of mixed documents by expectation-maximisation.

A character trigram model for each language gives every word a log-likelihood.
A document is a mixture of languages: EM estimates the proportions under which
its words are most likely, and the set of languages is chosen by backward
elimination under a penalised likelihood (BIC).

Words of a document are pooled by their likelihood pattern, rounded to
``1 / GRAIN`` nats and cut at ``FLOOR`` below the best language, so the EM of a
batch is a few small matrix products whatever the texts' lengths.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, pick

TABLE_BITS = 17
GRAIN, FLOOR = 2, 14.0
_MUL = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
_LETTER = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.uint8).astype(bool)


def word_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table slot of each trigram, first trigram of each word, text of each word).

    Letters are lower-cased; a word is a maximal run of letters, padded with a
    space on both sides, so a word of n letters has n trigrams.
    """
    low = [(t or "").lower() for t in texts]
    size = np.array([len(t) + 1 for t in low], np.int64)
    cp = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[cp]
    at = np.flatnonzero(letter)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.where(letter, cp, np.uint32(32))
    left = np.where(at > 0, c[at - 1], np.uint32(32))
    h = left * _MUL[0] ^ (c[at] * _MUL[1] + np.uint32(0x27D4EB2F)) ^ c[at + 1] * _MUL[2]
    h ^= h >> np.uint32(15)
    slot = (h * np.uint32(0x2C1B3C6D) >> np.uint32(32 - TABLE_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
    return slot, first, np.searchsorted(np.cumsum(size), at[first], side="right")


def trigram_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, slot, n`` over every labelled row outside the held-out fold.

    Each task sums dense tables, one a language it met, and emits its non-zero
    cells once, so what is shuffled is at most languages x table a task.
    """
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("text", F.col("lang").cast("string"))
    schema = pa.schema([("lang", pa.string()), ("slot", pa.int32()), ("n", pa.int64())])

    def run(batches):
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for s in range(0, len(langs), 256):
                part = batch.column(0).slice(s, 256).to_pylist()
                for lang in set(langs[s : s + 256]):
                    slot, _, _ = word_codes([t for t, g in zip(part, langs[s : s + 256]) if g == lang])
                    tables.setdefault(lang, np.zeros(1 << TABLE_BITS, np.int64))
                    tables[lang] += np.bincount(slot, minlength=1 << TABLE_BITS)
        for lang, t in tables.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(t[at])], schema=schema)

    return rows.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def in_parts(texts, step: int, most: int = 1 << 19):
    """Lists of up to ``step`` texts, ended by the one that reaches ``most`` characters."""
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text or "")
        if len(part) == step or held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part


class Mixture:
    """Learned languages and their log-probabilities by table slot."""

    def __init__(self, langs: list[str], logp: np.ndarray, seen: np.ndarray | None = None):
        self.langs, self.logp = langs, logp
        self.seen = np.ones(len(logp), bool) if seen is None else seen

    @classmethod
    def fit(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Mixture:
        """Counts of all training rows; at most languages x 2**TABLE_BITS cells reach the driver."""
        got = trigram_counts(docs, id_col, text_col, lang_col).toArrow()
        langs = sorted(set(got["lang"].to_pylist()))
        count = np.zeros((1 << TABLE_BITS, len(langs)))
        if langs:
            col = {g: i for i, g in enumerate(langs)}
            count[got["slot"].to_numpy(), [col[g] for g in got["lang"].to_pylist()]] = got["n"].to_numpy()
        met = count.sum(axis=1) > 0
        seen = max(int(met.sum()), 1)
        share = (count + 0.5) / (count.sum(axis=0) + 0.5 * (seen + 1))
        return cls(langs, np.log(share).astype(np.float32), met)

    def predict(self, texts: list[str | None], rounds: int = 30, penalty: float = 0.5) -> tuple[list[str], list[float], list[str]]:
        """(language, its proportion, JSON proportions of the chosen set) of each text."""
        m = len(texts)
        pi, on = self.proportions(texts, rounds, penalty)
        langs, score, mix = ["und"] * m, [0.0] * m, ["{}"] * m
        best = pi.argmax(axis=1) if pi.shape[1] else []
        for r in np.flatnonzero(on.any(axis=1)).tolist():
            p = pi[r].tolist()
            langs[r], score[r] = self.langs[best[r]], min(1.0, p[best[r]])
            mix[r] = json.dumps({self.langs[j]: round(p[j], 4) for j in range(len(p)) if on[r, j]})
        return langs, score, mix

    def known(self, texts: list[str | None]) -> np.ndarray:
        """Share of each text that is in learned languages, of which none need lead."""
        pi, _ = self.proportions(texts, unknown=True)
        return pi[:, : len(self.langs)].sum(axis=1)

    def known_in_parts(self, texts: list[str | None], step: int = 128) -> np.ndarray:
        """``known`` of any number of texts, a bounded part at a time."""
        return np.concatenate([np.zeros(0), *(self.known(part) for part in in_parts(texts, step))])

    def proportions(self, texts: list[str | None], rounds: int = 30, penalty: float = 0.5, unknown: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(proportion, whether chosen) by text and language; zeros without a letter.

        With ``unknown`` a last component gives all table slots the same
        probability, and what a language keeps for unseen slots is shared among
        those no training row has.  For trigrams that fall anywhere no learned
        table is likelier than the even one (Jensen), so they are unknown.
        """
        slot, first, text = word_codes(texts)
        k, m = len(self.langs), len(texts)
        if not len(first) or not k:
            return np.zeros((m, k + unknown)), np.zeros((m, k + unknown), bool)
        like = np.add.reduceat(self.logp[slot], first, axis=0)
        if unknown:
            free = max(len(self.seen) - int(self.seen.sum()), 1)
            rare = np.add.reduceat((~self.seen[slot]).astype(np.float32), first) * np.log(free)
            even = -np.diff(np.append(first, len(slot))) * np.log(len(self.seen))
            like = np.column_stack([like - rare[:, None], even])
            k += 1
        like -= like.max(axis=1, keepdims=True)
        grade = np.round(np.maximum(like, -FLOOR) * GRAIN).astype(np.int64)
        key = grade @ (int(FLOOR * GRAIN) + 1) ** np.arange(k, dtype=np.int64) if k <= 12 else None
        if key is not None:
            _, pick_at, code = np.unique(key, return_index=True, return_inverse=True)
            pattern = grade[pick_at]
        else:
            pattern, code = np.unique(grade, axis=0, return_inverse=True)
        code = code.reshape(-1)
        lik = np.exp(pattern / GRAIN)  # (patterns, languages), best is 1
        flat = np.bincount(text * len(lik) + code, minlength=m * len(lik)).astype(np.float64)
        hist = flat.reshape(m, len(lik))
        total = hist.sum(axis=1)
        some = total > 0

        def em(h, n, on):
            pi = on / on.sum(axis=1, keepdims=True)
            for _ in range(rounds):
                mix = np.maximum(pi @ lik.T, 1e-300)
                pi = pi * ((h / mix) @ lik) / n[:, None]
                pi = np.where(on > 0, pi, 0.0)
                pi /= np.maximum(pi.sum(axis=1, keepdims=True), 1e-300)
            return pi, (h * np.log(np.maximum(pi @ lik.T, 1e-300))).sum(axis=1)

        rows = np.flatnonzero(some)
        h, n = hist[rows], total[rows]
        on = np.ones((len(rows), k))
        pi, ll = em(h, n, on)
        cost = penalty * np.log(np.maximum(n, 2))
        todo = np.arange(len(rows))
        for _ in range(k - 1):  # drop the smallest language while that pays
            if not len(todo):
                break
            trial = on[todo].copy()
            weakest = np.where(trial > 0, pi[todo], np.inf).argmin(axis=1)
            trial[np.arange(len(todo)), weakest] = 0
            pi2, ll2 = em(h[todo], n[todo], trial)
            pays = ll2 + cost[todo] >= ll[todo]
            won = todo[pays]
            on[won], pi[won], ll[won] = trial[pays], pi2[pays], ll2[pays]
            todo = won[on[won].sum(axis=1) > 1]
        share, chosen = np.zeros((m, k)), np.zeros((m, k), bool)
        share[rows], chosen[rows] = pi, on > 0
        return share, chosen


def predict_languages(docs: DataFrame, model: Mixture, id_col: str = "doc_id", text_col: str = "text", step: int = 128) -> DataFrame:
    """``doc_id, lang_pred, score, mixture`` per row, no shuffle.

    ``und`` with score 0 where the text is null or has no letter.  The model is
    at most languages x 2**TABLE_BITS floats and is broadcast.  Null and
    repeated ids pass through; only the two named columns are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("mixture", pa.string())])

    def run(batches):
        for batch in batches:
            out = [[], [], []]
            for part in in_parts((t.as_py() for t in batch.column(1)), step):  # one batch never holds many long texts
                for o, v in zip(out, shared.value.predict(part)):
                    o += v
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(o, f.type) for o, f in zip(out, list(schema)[1:])]], schema=schema)

    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, mixture string")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the rows outside the held-out fold, predict every row."""
    model = Mixture.fit(docs, id_col, text_col, lang_col)
    out = predict_languages(docs, model, id_col, text_col)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "mixture")
