import random
from collections import Counter

import numpy as np

from aqengine.llm import langid

from .conftest import ODD, frame, words


def text(lang, seed, n=60):
    r = random.Random(f"{lang}{seed}")
    parts = {"xx": ["ka", "ro", "ti", "mun"], "yy": ["sch", "ein", "ü", "ver"], "zz": ["que", "oi", "é", "la"]}[lang]
    return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(n))


def corpus(n=150):
    return [(i, text("xx yy zz".split()[i % 3], i), "xx yy zz".split()[i % 3], "s", 0, 0.0, 0, 0, 0, 0, "") for i in range(n)]


def test_held_out_accuracy_and_rejection(spark):
    rows = [(i, t, "xx yy zz".split()[(i + i // 7) % 3], *r) for i, t, _, *r in corpus()]
    rows = [(i, text(lang, i), lang, *r) for i, _, lang, *r in rows] + [(900, "qwxzj kjhgf pqzzx wvvbk " * 5, None, "s", 0, 0.0, 0, 0, 0, 0, "")]
    docs = frame(spark, rows)
    held = langid.held_out(4, 2)
    model = langid.fit(docs.filter(~held))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == lang and not got[i].rejected and 0.9 < got[i].score <= 1 for i, _, lang, *_ in rows if lang)
    assert got[900].rejected and got[900].lang_pred in ("xx", "yy", "zz")


def slow_probability(counts, word, order=langid.ORDER):
    """Interpolated Kneser-Ney from dictionaries, one character after the other."""
    raw = [Counter() for _ in range(order + 1)]
    for w, n in counts.items():
        s = f" {w} "
        for k in range(1, order + 1):
            for i in range(1, len(s)):
                if i - k + 1 >= 0:
                    raw[k][s[i - k + 1 : i + 1], i == k - 1] += n
    grams = [Counter() for _ in range(order + 1)]
    starts = [set() for _ in range(order + 1)]
    for k in range(1, order + 1):
        for (g, first), n in raw[k].items():
            grams[k][g] += n
            if first:
                starts[k].add(g)
    used = [None, *[dict(g) for g in grams[1:]]]
    for k in range(1, order):
        before = Counter(g[1:] for g in grams[k + 1])
        used[k] = {g: grams[k][g] if k > 1 and g in starts[k] else max(before[g], 1e-9 if k > 1 else 0) for g in grams[k]}
    letters = len(used[1])

    def p(c, ctx, k):
        if k == 0:
            return 1 / (letters + 1)
        own = {g: n for g, n in used[k].items() if g[:-1] == ctx}
        total = sum(own.values())
        if not total:
            return p(c, ctx[1:], k - 1)
        one, two = (sum(n == m for n in used[k].values()) for m in (1, 2))
        d = one / (one + 2 * two) if one and two else 0.5
        weight = max(min(d * sum(n > 0 for n in own.values()) / total, 1), 1e-6)
        return max(own.get(ctx + c, 0) - d, 0) / total + weight * p(c, ctx[1:], k - 1)

    s = f" {word} "
    return sum(np.log(p(s[i], s[max(0, i - order + 1) : i], min(i, order - 1) + 1)) for i in range(1, len(s)))


def test_model_equals_a_plain_one():
    counts = {"a": Counter("kata kato tika moka taka kata".split()), "b": Counter("sein seil ein vein seen".split())}
    model = langid.fit_words(counts)
    for word in ("kata", "tiko", "sein", "ka", "k", "mokatika", "nies"):
        got = model.score([word])[0]
        for j, lang in enumerate(model.langs):
            if set(word) <= set("".join(counts[lang])):
                assert abs(got[j] - slow_probability(counts[lang], word)) < 1e-6, (word, lang)


def test_odd_rows(spark, odd, none):
    model = langid.fit(frame(spark, corpus(30)))
    got = langid.predict(odd, model).collect()
    assert len(got) == len(ODD)
    assert all(r.lang_pred == "und" and r.rejected and r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 6}) == 1
    assert langid.predict(none, model).collect() == []
    empty = langid.fit(none)
    assert all(r.lang_pred == "und" for r in langid.predict(odd, empty).collect())
    assert len(langid.predict(odd, langid.fit(odd)).collect()) == len(ODD)


def test_long_words_and_a_full_memo_change_nothing(spark, monkeypatch):
    docs = frame(spark, [*corpus(30), (50, "ka" * 5000 + " ro", "xx", "s", 0, 0.0, 0, 0, 0, 0, "")])
    model = langid.fit(docs)
    texts = [r[1] for r in corpus(30)] + ["ka" * 5000 + " ro", "ka ro"]
    want = langid.Scorer(model)(texts)[0]
    monkeypatch.setattr(langid, "KEPT", 5)
    small = langid.Scorer(model)
    assert np.allclose(np.concatenate([small([t])[0] for t in texts]), want)
    assert (want[-2].argmin(), want[-1].argmin()) == (0, 0)


def test_odd_texts_do_not_lift_the_level(spark):
    """With one language left out its texts are rejected, though a few sampled texts are in no language's letters."""
    odd = ["zzz " + " ".join(chr(first + (7 * i + j) % 20) * 3 for i in range(12) for j in range(3)) for first in (0x3B1, 0x430, 0x5D0, 0x627, 0x561)]
    known = [r for r in corpus(240) if r[2] != "zz"]
    model = langid.fit(frame(spark, known + [(1000 + i, t, "xx", "s", 0, 0.0, 0, 0, 0, 0, "") for i, t in enumerate(odd)]))
    new = [(2000 + i, text("zz" if i < 20 else "xx", 5000 + i), None, "s", 0, 0.0, 0, 0, 0, 0, "") for i in range(40)]
    got = {r.doc_id: r.rejected for r in langid.predict(frame(spark, new), model).collect()}
    assert all(got[2000 + i] == (i < 20) for i in range(40))


def test_all_labels_are_learned(spark):
    docs = frame(spark, [(i, text("xx", i, 5), f"l{i:03}", "s", 0, 0.0, 0, 0, 0, 0, "") for i in range(210)])
    assert len(langid.fit(docs).langs) == 210


def test_number_signs_are_no_letters(spark):
    learned = [(i, words(i, 20), "en", "s", 0, 0.0, 0, 0, 0, 0, "") for i in range(30)]
    model = langid.fit(frame(spark, learned))
    signs = ["½", "² ①", "Ⅷ ↉ ½", "12 345", "_", "٣"]
    got = langid.predict(frame(spark, [(i, t, "en", "s", 0, 0.0, 0, 0, 0, 0, "") for i, t in enumerate(signs)]), model).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert langid.letters("Añ²b é½ Ωmega") == ["añ", "b", "é", "ωmega"]


def test_the_driver_gets_counts_of_a_bounded_vocabulary(spark, monkeypatch):
    """Very long texts and words: what the models are made of stays within its bound, and languages are told apart."""
    rows = [(i, " ".join([text(lang, i, 8000), "ka" * 2000]), lang, *r) for i, _, lang, *r in corpus(30)]
    docs = frame(spark, rows)
    monkeypatch.setattr(langid, "VOCABULARY", 300)
    learned = []
    fit_words = langid.fit_words
    monkeypatch.setattr(langid, "fit_words", lambda counts: learned.append(counts) or fit_words(counts))
    model = langid.fit(docs)
    assert all(len(c) <= 100 for counts in learned for c in counts.values()) and len(learned) == 2
    assert all(len(w) <= langid.LONG_WORD for c in learned[0].values() for w in c)
    got = langid.predict(frame(spark, corpus(60)), model).collect()
    assert all(r.lang_pred == "xx yy zz".split()[r.doc_id % 3] and not r.rejected for r in got)


def test_counts_of_tasks_equal_plain_ones(spark):
    docs = frame(spark, corpus(60)).repartition(7)
    sample = langid.learned_sample(docs)
    got = {(r.lang, r.word): (r.n, r.part) for r in langid._word_counts(sample).collect()}
    want = {}
    for r in sample.collect():
        for w in langid.letters(r.text):
            n, part = want.get((r.lang, w), (0, 0))
            want[r.lang, w] = (n + 1, part + (r.r % 5 > 0))
    assert got == want
