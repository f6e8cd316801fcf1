import random

import numpy as np
from pyspark.sql import functions as F

from aqengine.llm import quality

from .conftest import frame, rows, words


def texts(seed, n):
    """Prose and three kinds of junk, with their labels."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = words(seed * 1000 + i, r.randrange(20, 300)).split()
        kind = r.randrange(8)
        if kind == 0:
            out.append((" ".join(w[:1] * len(w)), 0))
        elif kind == 1:
            out.append(("!! ".join(w).upper(), 0))
        elif kind == 2:
            out.append((" | ".join(w), 0))
        else:
            out.append((". ".join(" ".join(w[j : j + 9]) for j in range(0, len(w), 9)), 1))
    return out


def table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_texts_are_told_apart(spark):
    every = texts(1, 400)
    docs = frame(spark, rows(*[t for t, _ in every]))
    model = quality.fit(docs.filter("doc_id < 300"), table(spark, [(i, q, 0) for i, (_, q) in enumerate(every)]))
    got = {r["doc_id"]: r for r in quality.scored(docs, model).collect()}
    right = sum(got[i]["predicted"] == every[i][1] for i in range(300, 400))
    assert right >= 97 and 0 < len(model.rules) < 100 and all(0 <= r["score"] <= 1 for r in got.values())


def test_expressions_score_as_the_rules_do(spark):
    every = texts(2, 200)
    docs = frame(spark, rows(*[t for t, _ in every]))
    labels = table(spark, [(i, q, 0) for i, (_, q) in enumerate(every)])
    x, y = quality.labelled(docs, labels)
    model = quality.fit_rules(x, y)
    want = 1 / (1 + np.exp(-(model.start + quality.met(model.rules, x) @ np.array(model.weights))))
    got = sorted(r["score"] for r in quality.scored(docs, model).collect())
    assert len(x) == 200 and np.allclose(got, sorted(want), atol=1e-6)
    plan = quality.scored(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_statistics(spark):
    stats = quality.statistics(F.col("text"))
    docs = frame(spark, rows("One two | two.\nAB 12 ***\nAB 12 ***", None, ""))
    one, null, empty = docs.select("doc_id", *[c.alias(n) for n, c in stats.items()]).orderBy("doc_id").collect()
    assert one["words"] == 10 and one["lines"] == 3 and one["distinct_lines"] == 2 / 3 and one["lone_symbols"] == 3 / 10 and one["symbol_runs"] == 2 / 10 and one["stops"] == 1 / 10 and one["digits"] == 4 / one["chars"]
    assert null[1:] == empty[1:] and null["words"] == 0


def test_path_rules():
    x = np.array([[0.0, 1.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]] * 50)
    y = (x[:, 0] * x[:, 1]).astype(float)
    model = quality.fit_rules(x, y)
    p = 1 / (1 + np.exp(-(model.start + quality.met(model.rules, x) @ np.array(model.weights))))
    assert ((p > 0.5) == (y > 0)).all()
    assert all(len({(j, above) for j, above, _ in rule}) == len(rule) <= 3 for rule in model.rules)


def test_odd_rows(spark, odd, none):
    labels = table(spark, [(2, 0, 0), (2, 1, 0), (4, 1, None), (6, None, 1), (None, 1, 0), (7, 0, 0), (8, 0, 0), (99, 1, 0)])
    model = quality.fit(odd, labels)
    got = quality.scored(odd, model).collect()
    assert len(got) == odd.count() and all(r["score"] is not None and r["predicted"] in (0, 1) for r in got)
    assert quality.scored(none, model).collect() == [] and len(quality.labelled(odd, labels, 2)[1]) == 2
    assert {r["score"] for r in quality.scored(odd, quality.fit(odd, labels.limit(0))).collect()} == {0.5}
    assert all(r["predicted"] == 1 for r in quality.scored(odd, quality.fit(odd, table(spark, [(4, 1, 0)]))).collect())
