import re

from aqengine.llm import mixing

from .conftest import ODD, frame, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes, weights=(5, 2, 1), budget=1.5, epochs=2):
    """Clamp, reshare, until nothing is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left = {}, dict(sizes)
    while True:
        rest = budget * sum(sizes.values()) - sum(full.values())
        share = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if share[s] > epochs * sizes[s]]
        if not over:
            return share | full
        for s in over:
            full[s] = epochs * sizes[s]
            del left[s]
        if not left:
            return full


def test_targets_and_taken_words(spark):
    docs = [(i, words(i, 1 + i % 40), "en", s, 0, 0.0, 0, 0, 0, 0, "") for i in range(600) for s in [["b", "a", "c", None, "é", "big"][min(5, i % 9)]]]
    got = mixing.mix_sources(frame(spark, docs)).collect()
    size = {i: len(WORD.findall(t)) for i, t, *_ in docs}
    source = {d[0]: d[3] for d in docs}
    sizes = {}
    for i, n in size.items():
        sizes[source[i]] = sizes.get(source[i], 0) + n
    want = filled(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert len(got) == len(docs) and abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 40 for s in sizes)
    assert sorted(got) == sorted(mixing.mix_sources(frame(spark, docs)).collect())


def test_seed_changes_the_choice_only(spark):
    docs = frame(spark, [(i, words(i, 10), "en", "ab"[i % 2], 0, 0.0, 0, 0, 0, 0, "") for i in range(200)])
    a, b = (sorted((r.doc_id, r.taken) for r in mixing.mix_sources(docs, seed=s, budget=1.3).collect()) for s in (1, 2))
    assert a != b and sum(t for _, t in a) == sum(t for _, t in b)


def test_odd_rows(odd, none):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == len(ODD)
    assert all(r.size == len(WORD.findall(t or "")) for r, t in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.size)), [x[1] for x in sorted(ODD, key=lambda x: (x[0] or 0, len(WORD.findall(x[1] or ""))))], strict=True))
    assert mixing.mix_sources(none).collect() == []


def test_documents_are_repeated(odd, none):
    times = {}
    for r in mixing.mixed_documents(odd).collect():
        times[r.doc_id, r.text] = times.get((r.doc_id, r.text), 0) + 1
    want = {}
    for r in mixing.mix_sources(odd, keep=("text",)).collect():
        want[r.doc_id, r.text] = want.get((r.doc_id, r.text), 0) + r.copies
    assert times == {k: v for k, v in want.items() if v}
    assert mixing.mixed_documents(odd).columns == odd.columns and mixing.mixed_documents(none).count() == 0


def test_texts_without_words_are_taken_as_often_as_others(spark):
    rows = [(i, "" if i % 2 else words(i, 9), "en", "small", 0, 0.0, 0, 0, 0, 0, "") for i in range(60)] + [(i, words(i, 30), "en", "t", 0, 0.0, 0, 0, 0, 0, "") for i in range(60, 200)]
    got = mixing.mix_sources(frame(spark, rows), weights=(5, 1)).collect()
    assert {r.copies for r in got if r.doc_id < 60} == {2}
    docs = mixing.mixed_documents(frame(spark, rows), weights=(5, 1)).groupBy("doc_id").count().collect()
    assert max(r["count"] for r in docs) == 2 and sum(r["count"] for r in docs) == sum(r.copies for r in got)
