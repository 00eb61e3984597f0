import zlib

import pytest

from ledgerlark.llm import language_id as g


@pytest.fixture(scope="module")
def predicted(table):
    return table("documents", "sf0.01"), g.language_id(table("documents", "sf0.01")).collect()


def test_held_out_accuracy(predicted):
    docs, out = predicted
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in out if r["held_out"]]
    assert len(held) > 100 and len(out) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) >= 0.97


def test_mixture_of_two_languages(predicted, table):
    docs, _ = predicted
    model = g.Mixture.fit(docs)
    pick = lambda lang: next(r["text"] for r in docs.where(f"lang = '{lang}' and n_chars between 1500 and 4000").orderBy("doc_id").collect())
    en, de = pick("en")[:1200], pick("de")[:1200]
    import json

    langs, score, mix = model.predict([en + "\n" + de, en, None, "12 -- 34", ""])
    both = json.loads(mix[0])
    assert set(both) == {"de", "en"} and min(both.values()) > 0.25
    assert langs[1] == "en" and score[1] > 0.9
    assert langs[2:] == ["und"] * 3 and score[2:] == [0.0] * 3


def test_batches_do_not_change_results(predicted):
    docs, _ = predicted
    model = g.Mixture.fit(docs)
    texts = [r["text"] for r in docs.limit(40).collect()]
    whole = model.predict(texts)
    single = [model.predict([t]) for t in texts]
    assert whole[0] == [s[0][0] for s in single]
    assert all(abs(a - s[1][0]) < 1e-9 for a, s in zip(whole[1], single))


def test_odd_rows(odd, odd_rows, none):
    out = g.language_id(odd).collect()
    assert len(out) == len(odd_rows)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(by[i][0]["lang_pred"] == "und" for i in (60, 61, 62)) and len(by[65]) == 2
    assert g.language_id(none).count() == 0
    untaught = odd.withColumn("lang", odd["lang"].substr(9, 9)).where("lang is null")
    assert {r["lang_pred"] for r in g.language_id(untaught).collect()} <= {"und"}


def exact(docs, rows):
    """(language, proportion) of each text by EM over exact likelihoods: trigrams
    told apart, nothing rounded, no floor; written out word by word."""
    import math
    from collections import Counter

    import numpy as np

    def words(text):
        return "".join(ch if ch.isalpha() else " " for ch in (text or "").lower()).split()

    def grams(word):
        w = f" {word} "
        return [w[i : i + 3] for i in range(len(word))]

    counts = {}
    for r in docs:
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            counts.setdefault(r["lang"], Counter()).update(t for w in words(r["text"]) for t in grams(w))
    langs, seen = sorted(counts), len(set().union(*counts.values()))
    total = {g: sum(c.values()) + 0.5 * (seen + 1) for g, c in counts.items()}
    out = []
    for text in rows:
        like = np.array([[sum(math.log((counts[g][t] + 0.5) / total[g]) for t in grams(w)) for g in langs] for w in words(text)])
        if not len(like):
            out.append(("und", 0.0))
            continue
        lik = np.exp(like - like.max(axis=1, keepdims=True))

        def em(on, lik=lik):
            pi = on / on.sum()
            for _ in range(30):
                post = pi * lik
                pi = (post / np.maximum(post.sum(axis=1, keepdims=True), 1e-300)).mean(axis=0)
            return pi, np.log(np.maximum(lik @ pi, 1e-300)).sum()

        on = np.ones(len(langs))
        pi, ll = em(on)
        while on.sum() > 1:
            trial = on.copy()
            trial[np.where(on > 0, pi, np.inf).argmin()] = 0
            pi2, ll2 = em(trial)
            if ll2 + 0.5 * math.log(max(len(lik), 2)) < ll:
                break
            on, pi, ll = trial, pi2, ll2
        out.append((langs[int(pi.argmax())], float(pi.max())))
    return out


def test_agrees_with_exact_em(table):
    docs = table("documents")
    rows = docs.collect()
    got = {r["doc_id"]: r for r in g.language_id(docs).collect()}
    want = exact(rows, [r["text"] for r in rows])
    same = [got[r["doc_id"]]["lang_pred"] == lang for r, (lang, _) in zip(rows, want)]
    gap = [abs(got[r["doc_id"]]["score"] - share) for r, (_, share) in zip(rows, want)]
    assert sum(same) >= len(rows) - 1 and sum(gap) / len(gap) < 0.01


def test_parts_are_bounded():
    texts = ["a" * 400_000, "b" * 400_000, None, "", *["c"] * 300]
    parts = list(g.in_parts(texts, 128))
    assert [t for p in parts for t in p] == texts and [len(p) for p in parts] == [2, 128, 128, 46]
