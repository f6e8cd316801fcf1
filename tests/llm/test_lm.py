import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from aqengine.llm import langid, lm
from aqengine.llm.common import written

from .conftest import ODD, frame, words


def scored(docs, **how):
    held = langid.held_out(5, 1)
    learned = docs.filter(~held)
    counts = written(lm.word_counts(learned), "counts")
    return lm.score(docs, lm.fit(learned, counts, **how), counts, {"held_out": held}).collect()


def base(rows):
    words_of = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    train = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in words_of(t))
    n, v = sum(train.values()), len(train)
    return n, {i: (len(words_of(t)), sum(train[w] > 0 for w in words_of(t)), sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words_of(t))) for i, t in rows}


def test_counts_base_and_better_model(spark):
    half = lambda i: " ".join(w.replace("w", "ab"[i % 2]) for w in words(i, 120, 40).split())
    rows = [(i, half(i // 3) + " " + words(i + 1000, 3, 100_000)) for i in range(150)]
    docs = frame(spark, [(i, t, "en", "s", 0, 0.0, 0, 0, 0, 0, "") for i, t in rows])
    total, want = base(rows)
    got = scored(docs)
    for r in got:
        n, known, b = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and abs(r.base_score - b) < 1e-6
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert r.score < 0 and math.isfinite(r.score)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def some_soft(seed=0, n=30_000):
    r = np.random.default_rng(seed)
    return lm.Soft.of(r.integers(0, lm.VOCAB**2, n), 100 * r.random((n, lm.TABLES)).astype(np.float32))


def some_net():
    return lm.Attention.new(some_soft())


def test_each_token_is_scored_once_with_earlier_ones_only():
    ids = [np.arange(1, n, dtype=np.uint16) % 300 for n in (1, 2, 25, 26, 100)]
    x, y = lm.windows(ids)
    assert [int(t) for t in y[y >= 0]] == [int(t) for i in ids for t in [*i, 0]]
    net = some_net()
    a = net.log_probs(x, y)
    later = x.copy()
    later[:, -1] = 5
    b = net.log_probs(later, y)
    assert np.allclose(a[:, :-1], b[:, :-1])


def test_gradients():
    rng = np.random.default_rng(0)
    x, y = lm.windows([rng.integers(1, 500, 40).astype(np.uint16)])
    net = some_net()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.tables = lm.Tables(net.tables.row, *(t.astype(np.float64) for t in (net.tables.met, net.tables.base, net.tables.scale)))
    net.p["b"] += 0.3
    share, g = net.gradients(x, y)
    assert np.allclose(share.sum(1), 1) and np.allclose(share, lm.Scorer(net).shares(x, y))
    for name in net.p:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        loss = []
        for step in (1e-4, -2e-4):
            net.p[name][at] += step
            loss.append(-net.log_probs(x, y).sum() / (y >= 0).sum())
        net.p[name][at] += 1e-4
        assert abs((loss[0] - loss[1]) / 2e-4 - g[name][at]) < 1e-3 * max(1, abs(g[name][at])), name


def test_probabilities_sum_to_one():
    net = some_net()
    x = np.full((lm.VOCAB, lm.WINDOW), lm.VOCAB)
    x[:, lm.WINDOW - lm.SCORED] = 0
    y = np.full((lm.VOCAB, lm.SCORED), -1)
    y[:, 0] = np.arange(lm.VOCAB)
    assert abs(np.exp(net.log_probs(x, y)[y >= 0]).sum() - 1) < 1e-4


def plain_log10(net, ids):
    """Forward pass token after token, without tables or batches: each token sees what its window holds of the text before it."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    line, total, lead = [0, *ids], 0.0, lm.WINDOW - lm.SCORED
    for t, y in enumerate([*ids, 0]):
        first = t // lm.SCORED * lm.SCORED - lead  # where the window of this token begins
        seen = [i for i in range(first, t + 1) if i >= 0]
        e = np.array([p["e"][line[i]] + p["pos"][i - first] for i in seen])
        w = np.exp(e @ p["k"] @ (e[-1] @ p["q"]) / lm.WIDTH**0.5)
        h = np.maximum(e[-1] @ p["w"] + (w / w.sum()) @ (e @ p["v"]) @ p["c"] + p["b"], 0)
        mix = np.exp(h @ p["u"] + p["z"])
        total += math.log10(mix / mix.sum() @ net.tables.of(np.array([line[t] * lm.VOCAB + y]))[0])
    return total


def test_score_is_that_of_a_plain_forward_pass(spark):
    docs = frame(spark, [(i, words(i, 150, 60) + " é" * (i % 3), "en", "s", 0, 0.0, 0, 0, 0, 0, "") for i in range(40)] + [(40, None, "en", "s", 0, 0.0, 0, 0, 0, 0, "")])
    counts = written(lm.word_counts(docs), "counts")
    model = lm.fit(docs, counts)
    sub = lm.Subwords(model.tokenizer, list(model.vocab))
    got = {r.doc_id: r.score for r in lm.score(docs, model, counts).collect()}
    for r in docs.filter("doc_id in (0, 1, 5, 40)").collect():
        assert abs(got[r.doc_id] - plain_log10(model.net, sub((r.text or "").lower().encode().split())[0].tolist())) < 1e-3 * max(1, -got[r.doc_id]), r.doc_id


def test_soft_counts():
    r, soft = np.random.default_rng(3), some_soft(3)
    back = lm._unpacked(list(lm._packed(soft).values()))
    assert (back.pair == soft.pair).all() and np.allclose(back.sums, soft.sums, rtol=0.005)
    counts = lm.SoftCounts()
    x, y = lm.windows([r.integers(1, 500, 100).astype(np.uint16) for _ in range(30)])
    share = r.random(((y >= 0).sum(), lm.TABLES)).astype(np.float32)
    for part in (slice(0, 50), slice(50, None)):
        own = (y[part] >= 0).sum()
        counts.add(x[part], y[part], share[:own] if part.start == 0 else share[-own:])
        counts.sums()
    want = np.zeros((lm.VOCAB**2, lm.TABLES), np.float32)
    np.add.at(want, lm.pairs(x, y)[y.ravel() >= 0], share)
    got = np.zeros_like(want)
    got[counts.total.pair] = counts.total.sums
    assert np.allclose(got, want, atol=1e-3)


def test_small_shares_count_beside_large_sums():
    share = np.ones((1001, lm.TABLES), np.float32)
    share[0] = 2**24
    soft = lm.Soft.of(np.full(1001, 7), share)
    assert soft.pair.tolist() == [7] and (soft.sums == 2**24 + 1000).all()
    assert len(lm.Soft.of(np.zeros(0, np.int64), share[:0]).pair) == 0


def test_pairs_are_spread_as_their_windows_share_them():
    soft = some_soft(5, 2000)
    pair, count = lm._counted(np.concatenate([soft.pair, soft.pair[:500], [3, 5]]), np.concatenate([np.full(len(soft.pair), 7), np.full(500, 2), [4, 4]]))
    got = soft.spread(pair, count)
    assert np.allclose(got.sums.sum(1), count, rtol=1e-4) and len(np.unique(pair)) == len(pair)
    at = np.searchsorted(soft.pair, pair[100])
    if soft.pair[at] == pair[100]:
        assert got.sums[100].argmax() == soft.sums[at].argmax()
    back = [lm._unpacked_pairs(w) for w in lm._packed_pairs(pair, count).values()]
    assert sum(c.sum() for _, c in back) == count.sum() and sorted(p for b, _ in back for p in b.tolist()) == pair.tolist()


def test_tables_are_distributions():
    t = some_net().tables.of(np.arange(lm.VOCAB**2)).reshape(lm.VOCAB, lm.VOCAB, -1)
    assert np.allclose(t.sum(1), 1, atol=1e-3) and t.min() > 0


def test_odd_rows(odd, none):
    got = scored(odd)
    assert len(got) == len(ODD) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert [r.n_tokens for r in got if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert len({(round(r.score, 4), r.n_known) for r in got if r.doc_id == 6}) == 1
    assert scored(none) == []


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    got = scored(frame(spark, [(i, "a b", "en", "s", 0, 0.0, 0, 0, 0, 0, "") for i in ids]))
    assert len(got) == len(ids) and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in got)


def test_bytes_stand_in_for_unknown_pieces():
    sub = lm.Subwords(lm.default_tokenizer(), [])
    ids, sizes = sub(["né".encode(), b"x"])
    assert [bytes([i - 1]) for i in ids] == [bytes([b]) for b in " né x".encode()] and sizes.tolist() == [4, 2]
    assert F is not None


def test_context_outside_the_sample_is_learned(spark):
    n, few = 240, 20
    h = spark.range(n).select("id", F.pmod(F.xxhash64(F.lit("lm"), F.col("id")), F.lit(1_000_000)).alias("h"))
    sampled = {r.id for r in h.orderBy("h").limit(few).collect()}

    def mean(other):
        rows = [(i, words(i, 40, 30) if i in sampled else other, "en", "s", 0, 0.0, 0, 0, 0, 0, "") for i in range(n)]
        docs = frame(spark, rows)
        counts = written(lm.word_counts(docs), "counts")
        model = lm.fit(docs, counts, sample=few)
        sub = lm.Subwords(model.tokenizer, list(model.vocab))
        return lm.word_log_probs([b"ka mo ka mo ka mo ka mo".split()], sub, model.net)[0].mean()

    # The same counts, and the same sample: only the order of the other texts' words differs.
    assert mean("ka mo " * 40) > mean("ka " * 40 + "mo " * 40) + 0.2


def test_every_window_is_read_in_one_round():
    for rounds in (1, 2, 3):
        assert (sum(lm.in_round(17, r, rounds).astype(int) for r in range(rounds)) == 1).all()


def test_words_are_encoded_as_one_text_and_as_if_alone():
    sub = lm.Subwords(lm.default_tokenizer(), [11, 300, 5000])
    odd = ["", "a\u00a0", "\u00a0", "\u3000x", "y\u2028z", "\x85", "\x1c", "end\u2003", "e\u0301", "\U0001f600", "it's", "a1b2"]
    many = [w.encode() for w in words(4, 3000, 2000).split() + odd * 2] + [b"\xff\xe2\x82", b"\xe2"]
    alone = [sub.raw(w) for w in many]
    ids, size = sub.raw_all(lm.pa.array(many, lm.pa.binary()))
    assert size.tolist() == [len(i) for i in alone] and ids.tolist() == [i for one in alone for i in one]
    calls = []

    class Spy:
        def encode_ordinary(self, text, own=sub.own):
            calls.append(text)
            return own.encode_ordinary(text)

    sub.own = Spy()
    plain = [w for w in many if w.isalnum()]
    sub(plain)
    assert len(plain) > 2000 and len(calls) == 1


def test_common_words_are_encoded_once():
    sub = lm.Subwords(lm.default_tokenizer(), [])
    texts = lm.pa.array(["Ab  cd ab", None, "", "x y\tcd"])
    sub.keep(lm.pa.array(["ab", "y", "z"]))
    ids, sizes, (named, codes, count, place) = sub.of_texts(texts)
    want = [sub(w)[0].tolist() if w else [] for w in ([b"ab", b"cd", b"ab"], [], [], [b"x", b"y", b"cd"])]
    assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want] and count.tolist() == [3, 0, 0, 3]
    at = dict(zip(named.to_pylist(), place.tolist(), strict=True))
    assert (at["ab"], at["y"], at["cd"], at["x"]) == (0, 1, -1, -1)


def test_exponentials_far_out_of_range():
    rows = np.array([[0, 1, -1], [-300, -301, -302], [5, -200, 5], [-90, -90, -91]], np.float32)
    for mix in (rows, rows + np.float32(20), np.concatenate([rows, 100 - rows])):
        want = np.exp(mix.astype(float) - mix.max(1, keepdims=True))
        got = lm._exps(mix.copy()).astype(float)
        assert np.allclose(got / got.sum(1, keepdims=True), want / want.sum(1, keepdims=True), atol=1e-5)


def test_places_of_words_in_a_list(monkeypatch):
    known = lm.pa.array(["b", "a", "é", "x" * 64, "ab", "ba"])
    ask = lm.pa.array(["", "a", "q", "é", "x" * 64, "x" * 65, "ba", "b", "", "ab", ""])
    assert lm.Places(known)(ask[1:]).tolist() == [1, -1, 2, 3, -1, 5, 0, -1, 4, -1]
    assert lm.Places(known[:0])(ask).tolist() == [-1] * len(ask) and len(lm.Places(known)(ask[:0])) == 0
    monkeypatch.setattr(lm.Places, "_hashes", lambda self, words: np.full(len(words), 7, np.uint64))
    assert lm.Places(known)(lm.pa.array(["b", "a", "q"])).tolist() == [0, -1, -1]  # never another word's


def test_shares_of_a_table_lie_in_one_piece():
    x, y = lm.windows([np.arange(1, n, dtype=np.uint16) % 300 for n in (2, 90, 7000)])
    share = lm.Scorer(some_net()).shares(x, y)
    assert share.shape == ((y >= 0).sum(), lm.TABLES) and share.flags.f_contiguous and np.allclose(share.sum(1), 1, atol=1e-5)
