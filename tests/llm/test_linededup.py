import itertools

from aqengine.llm import linededup

from .conftest import ODD, frame, words


def near(a, b):
    if min(len(a), len(b)) < linededup.MIN_WORDS or abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def brute(rows):
    seen, out = [], {}
    order = sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0]))
    for at, (doc, text, *_) in order:
        same, close = [], []
        for i, line in enumerate((text or "").split("\n")):
            w = line.encode().lower().split()
            if w:
                if w in seen:
                    same.append(i)
                elif any(near(w, s) for s in seen):
                    close.append(i)
                seen.append(w)
        out.setdefault((doc, text), []).append((len((text or "").split("\n")), len(same), len(close), ",".join(map(str, sorted(same + close)))))
    return out


def report(df, rows):
    got = {}
    ids = [r for r in df.collect()]
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(r[1])
    for r in ids:
        got.setdefault(r.doc_id, []).append((r.n_lines, r.n_same, r.n_near, r.removed))
    return {k: sorted(v) for k, v in got.items()}


def test_against_brute_force(spark):
    lines = [words(i, 5 + i % 9, 30) for i in range(60)]
    docs = []
    for i in range(80):
        own = []
        for j in range(4):
            w = lines[(i * 7 + j * 13) % 60].split()
            kind = (i + j) % 6
            if kind == 1:
                w[i % len(w)] = f"x{i}"
            if kind == 2:
                del w[i % len(w)]
            if kind == 3:
                w.insert(i % len(w), f"y{i % 3}")
            if kind == 4:
                w = [x.upper() for x in w]
            own.append("  ".join(w) if kind == 5 else " ".join(w))
        docs.append((i, "\n".join(own), "en", "s", 0, 0.0, 0, 0, 0, 0, ""))
    want = {}
    for (doc, _), v in brute(docs).items():
        want.setdefault(doc, []).extend(v)
    got = report(linededup.line_report(frame(spark, docs)), docs)
    assert got == {k: sorted(v) for k, v in want.items()}
    assert sum(x[2] for v in got.values() for x in v) > 20 and sum(x[1] for v in got.values() for x in v) > 20


def test_variants_of_all_places(spark):
    a = "a b c d e f g".split()
    texts = [" ".join(a)]
    texts += [" ".join(a[:i] + a[i + 1 :]) for i in range(7)] + [" ".join([*a[:i], "Z", *a[i + 1 :]]) for i in range(7)] + [" ".join([*a[:i], "Y", *a[i:]]) for i in range(8)]
    got = linededup.line_report(frame(spark, [(i, t, "en", "s", 0, 0.0, 0, 0, 0, 0, "") for i, t in enumerate(texts)])).collect()
    assert {r.doc_id for r in got if r.n_near} == set(range(1, len(texts)))


def test_odd_rows(odd, none):
    got = report(linededup.line_report(odd), ODD)
    want = {}
    for (doc, _), v in brute(ODD).items():
        want.setdefault(doc, []).extend(v)
    assert got == {k: sorted(v) for k, v in want.items()}
    assert linededup.line_report(none).collect() == []
    assert linededup.without_repeated_lines(none).collect() == []


def test_lines_go_from_the_text(spark):
    docs = frame(spark, [(i, t, "en", "s", 0, 0.0, 0, 0, 0, 0, "") for i, t in enumerate(["one two three four five\nkeep me", "first\nOne two three four five\n\nlast", None, "one two three four six"])])
    got = {r.doc_id: r.text for r in linededup.without_repeated_lines(docs).collect()}
    assert got == {0: "one two three four five\nkeep me", 1: "first\n\nlast", 2: None, 3: ""}
    assert linededup.without_repeated_lines(docs).columns == docs.columns
    assert itertools is not None


def test_lines_go_from_the_right_rows_whatever_the_columns(spark):
    text = "one two three four five\nown line {} with some more words"
    rows = [(i // 3, text.format(f"x{i} y{i} z{i}"), f"u{i}", i, "a", [i]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string, row int, doc string, _gone array<int>").repartition(7)
    got = linededup.without_repeated_lines(docs)
    assert got.columns == docs.columns
    kept = {r.row: r.text for r in got.collect()}
    assert all(f"x{i} y{i} z{i}" in kept[i] for i in range(30)) and sum(t.startswith("one two") for t in kept.values()) == 1
