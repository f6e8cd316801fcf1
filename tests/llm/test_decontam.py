import random
from collections import Counter

import numpy as np

from aqengine.llm import decontam

from .conftest import ODD, frame, words

ITEMS = "item_id long, text string, doc_id long, _text string"


def shingles(w, k=5):
    k = min(k, len(w))
    return Counter(" ".join(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def brute(rows, items, least=0.8):
    items = [(i, t.encode().lower().split()) for i, t in items if i is not None and t is not None and t.split()]
    own = [shingles([x.decode() for x in w]) for _, w in items]
    df = Counter(s for c in own for s in c)
    out = set()
    for doc, text, *_ in rows:
        w = [x.decode() for x in (text or "").encode().lower().split()]
        for (i, iw), c in zip(items, own, strict=True):
            weight = {s: np.log1p(len(items) / df[s]) for s in c}
            total = sum(weight[s] * n for s, n in c.items())
            for a in range(max(1, len(w) - len(iw) + 1)):
                if not w:
                    break
                win = shingles(w[a : a + len(iw)]) if len(w) - a >= min(5, len(iw)) else Counter()
                if sum(weight[s] * min(n, win[s]) for s, n in c.items()) / total >= least - 1e-12:
                    out.add((doc, i))
                    break
    return out


def test_against_brute_force(spark):
    r = random.Random(0)
    items = [(i, words(i + 500, 14 + i % 40)) for i in range(30)] + [(77, "only three words"), (78, words(500, 20) + " Extra")]
    rows = []
    for i in range(150):
        w = words(i, 60).split()
        if i % 2:
            t = r.choice(items)[1].upper().split() if i % 4 == 1 else r.choice(items)[1].split()
            if i % 3 == 0:
                t[r.randrange(len(t))] = "changed"
            if i % 5 == 0:
                t.insert(r.randrange(len(t)), "added")
            if i % 7 == 0:
                t = t[: len(t) // 2]
            w[30:30] = t
        rows.append((i, "\n ".join(w), "en", "s", 0, 0.0, 0, 0, 0, 0, ""))
    bench = spark.createDataFrame([(*x, 1, "x") for x in items], ITEMS)
    got = decontam.contaminated(frame(spark, rows), bench).collect()
    want = brute(rows, items)
    assert {(g.doc_id, g.item_id) for g in got} == want and len(want) > 30
    clean = {x.doc_id for x in decontam.decontaminated(frame(spark, rows), bench).collect()}
    assert clean == {x[0] for x in rows} - {d for d, _ in want}


def test_odd_rows_and_items(spark, odd, none):
    items = [(1, "the same text of two rows"), (1, "the same text of two rows"), (2, None), (None, "no id at all here"), (3, ""), (4, words(4, 20000)), (5, "no id at all here")]
    bench = spark.createDataFrame([(*x, 1, "x") for x in items], ITEMS)
    got = sorted((g.doc_id or -1, g.item_id) for g in decontam.contaminated(odd, bench).collect())
    assert got == [(-1, 5), (4, 4), *[(6, 1)] * 4, *[(7, 1)] * 2]
    left = decontam.decontaminated(odd, bench)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 5, 8, 9]
    nothing = spark.createDataFrame([], ITEMS)
    assert decontam.contaminated(odd, nothing).count() == 0 and decontam.decontaminated(odd, nothing).count() == len(ODD)
    assert decontam.contaminated(none, bench).count() == 0 and decontam.decontaminated(none, bench).count() == 0


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 2**64, (500, decontam.PARTS), dtype=np.uint64)
    for radius in (24, 88, 110):
        index = decontam.HammingIndex(fps, radius)
        for q in rng.integers(0, 2**64, (20, decontam.PARTS), dtype=np.uint64):
            for bits in (1.0, 0.5, 0.3):  # unlike ones, and ones that differ in some 128, 64 and 38 bits from the first
                flips = np.packbits(rng.random(256) < bits / 2, bitorder="little").view(np.uint64)
                q = q if bits == 1.0 else fps[0] ^ flips
                assert index.near(q).tolist() == np.flatnonzero(np.bitwise_count(fps ^ q).sum(1, dtype=int) <= radius).tolist()


def test_index_rules_out_nearly_all_of_many_items():
    rng = np.random.default_rng(1)
    index = decontam.HammingIndex(rng.integers(0, 2**64, (50_000, decontam.PARTS), dtype=np.uint64), decontam.RADIUS)
    asked = rng.integers(0, 2**64, (50, decontam.PARTS), dtype=np.uint64)
    assert sum(len(index.candidates(q)) for q in asked) < 50 * 50_000 * 0.06
    assert sum(len(index.near(q)) for q in asked) <= 5


def test_recall_of_items_that_share_text(spark):
    """Edited items between similarity 0.8 and 0.9, whose first half all items share, or that share nothing."""
    r = random.Random(5)
    for size in (20, 40):
        for shared in (0, size // 2):
            head = words(900, shared)
            items = [(i, f"{head} {words(i + 500, size - shared)}".strip()) for i in range(60)]
            rows = []
            for i in range(300):
                t = items[i % 60][1].split()
                for _ in range(r.randrange(1, 5)):
                    t[r.randrange(len(t))] = r.choice(["changed", "other", items[(i + 7) % 60][1].split()[-1]])
                rows.append((i, " ".join([words(i, 10), *t, words(i + 70, 10)]), "en", "s", 0, 0.0, 0, 0, 0, 0, ""))
            want = brute(rows, items)
            bench = spark.createDataFrame([(*x, 1, "x") for x in items], ITEMS)
            got = {(g.doc_id, g.item_id) for g in decontam.contaminated(frame(spark, rows), bench).collect()}
            assert len(want) >= 20 and got == want


def test_items_in_blocks(spark, monkeypatch):
    items = [(i, words(i + 500, 20)) for i in range(10)]
    rows = [(i, words(i, 30) + " " + items[i % 10][1], "en", "s", 0, 0.0, 0, 0, 0, 0, "") for i in range(20)]
    bench = spark.createDataFrame([(*x, 1, "x") for x in items], ITEMS)
    assert len(list(decontam._blocks(bench, 3))) == 4
    blocks = decontam._blocks
    monkeypatch.setattr(decontam, "_blocks", lambda b: blocks(b, 3))
    assert {(g.doc_id, g.item_id) for g in decontam.contaminated(frame(spark, rows), bench).collect()} == {(i, i % 10) for i in range(20)}
    assert decontam.decontaminated(frame(spark, rows), bench).count() == 0


def test_blocks_change_no_result(spark, monkeypatch):
    shared = words(900, 12)
    items = [(i, words(i + 500, 14) + " " + shared) for i in range(12)]
    rows = []
    for i in range(60):
        t = items[i % 12][1].split()
        for j in range(1 + i // 12):
            t[(5 * j + i) % len(t)] = "changed"
        rows.append((i, words(i, 30) + " " + " ".join(t) + " " + words(i + 70, 30), "en", "s", 0, 0.0, 0, 0, 0, 0, ""))
    bench = spark.createDataFrame([(*x, 1, "x") for x in items], ITEMS)
    found = lambda: sorted((g.doc_id, g.item_id, round(g.similarity, 12), g.first_word) for g in decontam.contaminated(frame(spark, rows), bench, 0.5).collect())
    want = found()
    assert {(d, i) for d, i, *_ in want} == brute(rows, items, 0.5) and any(0.5 < s < 0.9 for _, _, s, _ in want)
    blocks = decontam._blocks
    for size in (1, 5):
        monkeypatch.setattr(decontam, "_blocks", lambda b, size=size: blocks(b, size))
        assert found() == want
