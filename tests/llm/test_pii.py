import hashlib
import random
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aqengine.llm import pii

from .conftest import ODD, frame, words

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    ok = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 16 <= len(d := re.sub("[ -]", "", s)) <= 19 and luhn(d),
        "phone": lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15,
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok[k](m[0])] for k, p in PLAIN.items()}


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("a.@-+% 0123459()é\n")), max_size=60))
def test_base_formats(text):
    assert pii.base_spans(text) == brute(text)


def sample(n=400, seed=0):
    r = random.Random(seed)
    card = lambda: next(c for c in iter(lambda: "4" + "".join(r.choice("0123456789") for _ in range(15)), None) if luhn(c))
    made = {
        "email": lambda: f"user{r.randrange(999)}@mail{r.randrange(9)}.example.com",
        "ip": lambda: ".".join(str(r.randrange(256)) for _ in range(4)),
        "card": card,
        "phone": lambda: f"+1 ({r.randrange(200, 999)}) {r.randrange(200, 999)}-{r.randrange(1000, 9999)}",
    }
    out = []
    for i in range(n):
        kind = r.choice([*made, "none", "none"])
        mid = made[kind]() if kind in made else f"{r.randrange(99)}.{r.randrange(99)} {r.randrange(9999)}"
        out.append((i, f"{words(i, 12)} {mid} {words(i + 1, 9)}", "en", "s", 0, 0.0, 0, 0, 0, 0, ""))
    return out


def test_counts_digest_and_kept_base_spans(spark):
    rows = sample()
    docs = frame(spark, rows)
    model = pii.fit(docs)
    got = {r.doc_id: r for r in pii.personal_data(docs, model, redact=True).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        base = brute(text)
        assert tuple(got[i][f"n_{k}"] for k in pii.KINDS) == tuple(len(base[k]) for k in pii.KINDS)
        line = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k])
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(got[i].spans.split(","))
        for v in base.values():
            assert not any(text[a:b] in got[i].text for a, b in v)


def test_trees_learn_other_spellings(spark):
    docs = frame(spark, sample(2500))
    model = pii.fit(docs)
    assert model.threshold
    text = f"{words(1, 12)} user17 at mail3.example.com {words(2, 9)}"
    (base, every) = pii.find_spans([text], model)[0]
    assert base == brute(text)
    if "email" in model.threshold:
        assert [text[a:b] for a, b in every["email"]] == ["user17 at mail3.example.com"]
    clean = [words(i, 40) + " 3.14 12 2024" for i in range(50)]
    assert all(not any(v.values()) for _, v in pii.find_spans(clean, model))


def test_boosting_fits_and_stops_at_constant_labels():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    assert (((pii.boost(x, y).predict(x)) > 0.5) == y).mean() > 0.97
    assert pii.boost(x, np.zeros(2000)).predict(x).max() < 0.01


def test_odd_rows(odd, none):
    model = pii.fit(odd)
    got = pii.personal_data(odd, model).collect()
    assert len(got) == len(ODD) and all(r.spans == "" for r in got if r.doc_id in (1, 2, 3))
    assert pii.personal_data(none, pii.fit(none)).collect() == []


def test_addresses_are_those_of_the_pattern_in_linear_time():
    import time

    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    r = random.Random(0)
    for _ in range(3000):
        text = "".join(r.choice("ab.@@_-% ") for _ in range(r.randrange(40)))
        assert pii._mails(text) == [m.span() for m in plain.finditer(text)], text
    began = time.time()
    for text in ("a" * 1_000_000 + "@b", "a@" * 500_000, "a.b@c_" * 200_000, "@" * 1_000_000):
        assert pii._mails(text) == []
    assert time.time() - began < 5


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), max_size=30), st.integers(0, 10))
def test_taken_stretches(spans, first):
    spans = [(a, a + n) for a, n in spans]
    taken, held = pii.Taken(spans[:first]), spans[:first]
    for a, b in spans[first:]:
        free = not any(a < y and x < b for x, y in held)
        assert taken.free(a, b) == free
        if free:
            taken.add(a, b)
            held.append((a, b))


def test_many_added_spans_in_one_text():
    model = pii.Boosted(start=5.0, threshold={"phone": 0.5})
    text = "call 0049 30 1234567, " * 20_000
    started = time.monotonic()
    ((base, every),) = pii.find_spans([text], model)
    assert not any(base.values()) and len(every["phone"]) == 20_000
    assert time.monotonic() - started < 30


def test_trees_learn_from_all_documents(spark):
    ids = spark.range(4500).select("id", F.pmod(F.xxhash64(F.lit("pii"), F.col("id")), F.lit(1_000_000)).alias("h"))
    first = {r.id for r in ids.orderBy("h").limit(3000).collect()}
    docs = frame(spark, [(i, "nothing here" if i in first else text, *rest) for i, text, *rest in sample(4500)])
    assert "email" in pii.fit(docs).threshold


def test_boosting_of_a_table_is_that_of_its_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 40, (3000, 4)).astype(float)
    y = ((x[:, 0] > 20) ^ (x[:, 2] > 11)) & (rng.random(3000) < 0.9)
    cells = spark.createDataFrame([(r.tolist(), int(v), 1) for r, v in zip(x, y, strict=True)], "x array<double>, y long, n long").repartition(3).groupBy("x", "y").agg(F.sum("n").alias("n"))
    want, got = pii.boost(x, y.astype(float), 5), pii.boosted(cells, 5)
    assert (want.feature == got.feature).all() and (want.cut == got.cut).all() and np.allclose(want.leaf, got.leaf)
    assert np.allclose(want.predict(x), got.predict(x))
