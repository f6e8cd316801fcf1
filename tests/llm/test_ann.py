import numpy as np

from aqengine.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score double, c long, v string"


def brute(rows, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v))]
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            every = sorted((-float(sum(a * b for a, b in zip(q, x, strict=True))), j) for j, x in ok if j != i)
            out[i] = [(j, -s) for s, j in every[:k]]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.standard_normal(32) * rng.uniform(0.5, 2)).astype(np.float32).tolist(), 0, 0.0, 1, "x") for i in range(3000)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA), rerank=150).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, 20)
    assert set(got) == set(want)
    hits = 0
    vectors = {i: np.array(v, np.float32).astype(float) for i, v, *_ in rows}
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(abs(s - vectors[q] @ vectors[j]) < 1e-9 for _, j, s in found)
        assert [(-s, j) for _, j, s in found] == sorted((-s, j) for _, j, s in found)
        hits += len({j for _, j, _ in found} & {j for j, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    same = rng.standard_normal(8).astype(np.float32).tolist()
    rows = [(i, same, 0, 0.0, 1, "x") for i in range(0, 300)]
    rows += [(i, rng.standard_normal(8).astype(np.float32).tolist(), 0, 0.0, 1, "x") for i in range(300, 400)]
    rows += [(400, None, 0, 0.0, 1, "x"), (420, [0.0] * 8, 0, 0.0, 1, "x"), (440, [float("nan")] * 8, 0, 0.0, 1, "x"), (460, [None] * 8, 0, 0.0, 1, "x"), (480, [float("inf")] * 8, 0, 0.0, 1, "x"), (None, same, 0, 0.0, 1, "x")]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows, 20)
    assert {q: [j for j, _ in v] for q, v in got.items()} == {q: [j for j, _ in v] for q, v in want.items()}


def test_few_and_none(spark):
    rows = [(i, [1.0, float(i)], 0, 0.0, 1, "x") for i in range(5)]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA)).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, i, i, 1.0) for i in range(1, 5)]
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_parallel_errors_weigh_more():
    """With the anisotropic loss inner products with the vectors themselves are kept better than with the plain one."""
    x = np.random.default_rng(2).standard_normal((2000, 16)).astype(np.float32)

    def error(parallel):
        book = ann.Codebook.fit(x, parallel=parallel)
        codes = book.encode(x, parallel)
        back = book.centres[np.arange(8), codes].reshape(len(x), -1)
        return np.abs(((x - back) * x).sum(1)).mean()

    assert error(4.0) < error(1.0)


def agrees(spark, rows, **how):
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA), **how).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows, 20)
    assert {q: [j for j, _ in v] for q, v in got.items()} == {q: [j for j, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-9 for q in want for a, b in zip(got[q], want[q], strict=True))


def test_near_copies_at_two_sizes(spark):
    rng = np.random.default_rng(3)
    for n in (600, 2400):
        base = rng.standard_normal(16)
        x = rng.standard_normal((n, 16))
        x[::3] = base + 1e-4 * rng.standard_normal((len(x[::3]), 16))
        agrees(spark, [(i, v.astype(np.float32).tolist(), 0, 0.0, 1, "x") for i, v in enumerate(x)])


def test_repeated_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist(), 0, 0.0, 1, "x") for i in range(200)]
    agrees(spark, rows + [rows[0]] * 25 + [rows[20]] + [rows[7]] * 3)


def test_many_groups_and_blocks_give_the_same(spark, monkeypatch):
    """Queries in some ten groups against blocks of 100: nothing depends on how they meet."""
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "QUERY_BYTES", 8 * 8 * 6)
    rng = np.random.default_rng(5)
    agrees(spark, [(i, rng.standard_normal(8).astype(np.float32).tolist(), 0, 0.0, 1, "x") for i in range(1200)], rerank=30)


def test_vectors_are_not_shuffled_for_queries(spark):
    """Scanning the codes for a group of queries is one pass over their table, without an exchange."""
    x = np.random.default_rng(6).standard_normal((50, 4))
    coded = spark.createDataFrame([(1, [1.0] * 4, [1], [1], b"\0", 0.0)], "c long, v array<double>, ids array<long>, times array<long>, code binary, left_out double")
    sent = spark.sparkContext.broadcast((np.arange(50), x))
    found = ann._against(coded, sent, ann.Codebook.fit(x), 20, 200, 100)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 50
