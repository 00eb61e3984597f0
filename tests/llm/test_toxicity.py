import itertools

import numpy as np
import pytest

from ledgerlark.llm import toxicity as x


@pytest.fixture(scope="module")
def trained(table):
    docs, labels = table("documents", "sf0.1"), table("labels", "sf0.1")
    model = x.char_model(docs)
    return docs, labels, x.learn(docs, labels, model)


def test_viterbi_equals_exhaustive_search():
    model = x.CharModel(x.trigram_table(["stupid idiot class loss moon still toast " * 20]))

    def options(seen):
        runs = [m.group() for m in x._RUN.finditer(seen)]
        for at, run in enumerate(runs):
            ch, edge = run[0], at in (0, len(runs) - 1)
            if ch.isalpha():
                yield [(ch, 0.0)] if len(run) == 1 else [(ch * 2, x.DOUBLE if len(run) > 2 else 0.0), (ch, x.SINGLE)]
            elif ch in x.LOOKALIKE:
                out = [("", x.DROP_EDGE if edge else x.DROP_INSIDE)]
                for letter, price in x.LOOKALIKE[ch]:
                    out += [(letter, price)] + ([(letter * 2, price + x.DOUBLE)] if len(run) > 1 else [])
                yield out
            else:
                yield [("", 0.0 if edge else 0.5)] + ([(v, x.MASKED) for v in "aeiou"] if ch == "*" and not edge else [])

    def total(pieces):
        word, cost = "".join(p for p, _ in pieces), sum(c for _, c in pieces)
        codes = [0, 0, *[x.code_of(ch) for ch in word], 0]
        return cost + sum(float(model.cost[a, b, c]) for a, b, c in zip(codes, codes[1:], codes[2:])), word

    for seen in ("st00pid", "1d10t", "cl4$$", "lo55", "m00n", "s.t!ll", "t*ast", "ssstttupid"):
        best = min(total(p)[0] for p in itertools.product(*options(seen)))
        got = model.restore(seen)
        assert min(c for c, w in map(total, itertools.product(*options(seen))) if w == got) == pytest.approx(best)


def test_obfuscated_words_are_restored(trained):
    model = trained[2].model
    for seen, want in {"m0r0n": "moron", "stuuuupid": "stupid", "$tup1d": "stupid", "s.t.u.p.i.d": "stupid", "p@thetic": "pathetic", "cl0wn!": "clown", "l0$er": "loser", "tra$h": "trash"}.items():
        assert want in model.words(seen), (seen, model.words(seen))
    assert model.words("hello,") == ["hello"] and model.words("12345") == [] and model.words("don't") == ["don", "t"]
    assert x.spaced_words("a b s t u p 1 d".split()) == ["abstup1d"] and x.spaced_words("a b cd e".split()) == []


def test_scores_of_obfuscated_texts(trained):
    score = trained[2].score
    assert score("what an i d i o t he is")[0] > 0.5 and score("such a l0$er")[0] > 0.5
    assert score("what a day it was")[0] < 0.5 and score(None)[0] == score("")[0] < 0.5


def test_words_set_apart_end_where_the_lattice_says(trained):
    score, model = trained[2].score, trained[2].model
    assert {"stupid", "idiot"} <= set(model.set_apart("s t u p i d i d i o t".split()))
    for text in ("such a s t u p i d thing", "he is i d i o t s t u p i d now", "you i d i o t.", "an i/d/i/o/t he is", "so s,t,u,p,i,d it is", "a/s/t/u/p/i/d thing", "i:d:i:o:t", "i'd'i'o't", "I? D? I? O? T?"):
        assert score(text)[0] > 0.5, text
    assert set(model.set_apart("s c u m.".split())) >= {"scum"} and "idiot" in model.words("i;d;i;o;t")
    assert score("points a b c d e f of plan a/b/c and x, y, z")[0] < 0.5


def test_separators_and_blanks_are_in_the_lattice(trained):
    score, model = trained[2].score, trained[2].model
    for seen, want in {"s/t/u/p/i/d": "stupid", "s:t:u:p:i:d": "stupid", "s,t,u,p,i,d": "stupid", "s?t?u?p?i?d": "stupid", "i;d;i;o;t": "idiot", "s.t.u.p.i.d": "stupid", "s-t-u-p-i-d": "stupid", "id/iot": "idiot", "st-up-id": "stupid"}.items():
        assert want in model.words(seen) and score(seen)[0] > 0.5, seen
    assert "stupid" in model.apart("s t u p i d a n d d u m b".split())
    assert model.rejoined("you st up id man".split()) == ["stupid"]
    for text in ("st up id", "you st up id man", "an id iot he is", "so st up. id!"):
        assert score(text)[0] > 0.5, text
    assert model.rejoined("of the and to in a".split()) == [] and model.rejoined([]) == []


def test_fragments_equal_exhaustive_search():
    model = x.CharModel(x.trigram_table(["stupid idiot st class up still of the id loss " * 20]))
    for seen in ("st up id", "of the id iot", "i di ot"):
        found = []
        for keep in itertools.product((0, 1), repeat=seen.count(" ")):
            out, gaps = "", iter(keep)
            for ch in seen:
                out += ch if ch != " " or next(gaps) else ""
            codes = [0, 0, *map(x.code_of, out), 0]
            found.append((sum(float(model.cost[a, b, c]) for a, b, c in zip(codes, codes[1:], codes[2:])) + x.JOIN * (len(keep) - sum(keep)), out))
        assert model.restore(seen) == min(found)[1]


def test_score_equals_slow_scoring(trained, table):
    scorer = trained[2]
    model, weights = scorer.model, scorer.weights

    def slow(text):
        tokens = (text or "").lower().split()
        counts = {}
        for t in {*tokens, *model.set_apart(tokens), *model.rejoined(tokens), *scorer.starts(tokens)}:
            mine = set()
            for w in [*model.words(t), *scorer.starts(x.parts(t))]:
                mine |= {k for k in [*(w[:n] for n in (4, 5, 6, 7) if len(w) >= n), *([w + "."] if len(w) > 2 else [])] if k in weights}
                short = x._RUN.sub(r"\1", w)
                if short != w and len(short) > 3 and short + "." in weights:
                    mine |= {k for k in [*(short[:n] for n in (4, 5, 6, 7) if len(short) >= n), short + "."] if k in weights}
            for k in mine:
                counts[k] = counts.get(k, 0) + 1
        z = scorer.bias + sum(weights[k] * np.log(1 + n) for k, n in counts.items())
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    fresh = x.Scorer(model, weights, scorer.bias)
    texts = [r["text"] for r in table("documents").select("text").collect()] + ["", None, "you St Up Id man, an i.d.i.o.t", "w0rthle$$ trash***"]
    for text in texts:
        assert fresh.score(text)[0] == pytest.approx(slow(text), abs=1e-12)


def test_weights_are_at_the_optimum():
    rng = np.random.default_rng(0)
    dense = (rng.random((200, 6)) < 0.3).astype(float)
    rows, cols = np.nonzero(dense)
    y = (rng.random(200) < 0.4).astype(float)
    w, bias = x.fit_logistic(rows, cols, np.ones(len(rows)), y, 6)
    wide, ridge = np.column_stack([dense, np.ones(200)]), np.diag([0.02] * 6 + [0.0])

    def loss(v):
        z = wide @ v
        return (np.logaddexp(0, z) - y * z).sum() + v @ ridge @ v / 2

    best = np.zeros(7)
    for _ in range(50):  # Newton
        p = 1 / (1 + np.exp(-wide @ best))
        best -= np.linalg.solve(wide.T @ (wide * (p * (1 - p))[:, None]) + ridge, wide.T @ (p - y) + ridge @ best)
    assert loss(np.append(w, bias)) <= loss(best) + 1e-2


def test_held_out_quality(trained):
    docs, labels, scorer = trained
    out = x.toxicity(docs, labels, scorer=scorer).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    pos, neg = out[out.toxic == 1].score.to_numpy(), out[out.toxic == 0].score.to_numpy()
    auc = ((pos[:, None] > neg[None]).mean() + (pos[:, None] == neg[None]).mean() / 2)
    assert auc > 0.95 and out.score.between(0, 1).all()
    assert np.mean(out.predicted == out.toxic) > 0.93


def test_odd_rows_and_no_labels(odd, odd_rows, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (1, 0)], "doc_id long, toxic int")
    assert x.toxicity(odd, labels).count() == len(odd_rows)
    assert x.toxicity(odd, labels.where("false")).where("predicted = 1").count() == 0
    assert x.toxicity(none, labels).count() == 0
    assert x.restore(odd, x.char_model(odd)).count() == len(odd_rows)


def test_labels_with_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "vile muck here" if i % 4 == 0 else f"plain words n{i}") for i in range(80)], "doc_id long, text string")
    plain = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int")
    crowded = plain.selectExpr("doc_id", "toxic", "'z' text", "1 y", "2 r", "3 a", "'q' token")
    got = [sorted(map(tuple, x.toxicity(docs, t).collect())) for t in (plain, crowded)]
    assert got[0] == got[1]


def test_copies_teach_once(spark):
    bad = "vile " + " ".join(f"rare{i}" for i in range(20))
    rows = [(i, bad if i < 40 else f"plain words number n{i} here") for i in range(400)] + [(i, f"awful m{i} thing {i % 17} vile x{i} y{i * 3}") for i in range(400, 440)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40 or i >= 400)) for i in range(440)], "doc_id long, toxic int")
    s = x.learn(docs, labels, x.char_model(docs))
    assert "vile." in s.weights and not any(k.startswith("rare") for k in s.weights)
