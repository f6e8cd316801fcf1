"""Operator 6: personal data, by generated candidates and boosted trees."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..interim import sized
from .common import batches, dropped

KINDS = ("email", "ip", "card", "phone")
#: Trees, their depth, and bins of a feature.
TREES, DEPTH, BINS = 40, 3, 16
#: Share of added candidates that must be right, on the documents that calibrate the thresholds; steps of a threshold.
PRECISION, STEPS = 0.98, 10_000
#: Distinct candidates that a task of the first pass holds, and that a task of the later ones reads.
HELD, SHARE = 50_000, 200_000

# The base formats. They are written so that a failed attempt isn't repeated inside the same run of characters; an
# address is looked for at each @, its characters before it and its host after it.
_USER = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Generators of further candidates; high recall, overlaps welcome.
_MORE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64}(?:\x20?[(\[]at[)\]]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}(?:(?:\x20?[(\[]dot[)\]]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{2,63})+"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])[0-9]{3,6}(?:[\x20./-]?[0-9]{3,7}){2,4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:00[1-9]|\([0-9]{2,4}\)|[0-9]{2,4}(?=[\x20./-]))[\x20./-]?[0-9]{2,4}(?:[\x20./-]?[0-9]{2,4}){1,3}(?![0-9])"),
}
_WORDS = {
    "email": re.compile(r"mail|contact|write|correo|courriel|kontakt", re.I),
    "ip": re.compile(r"\bip\b|host|addr|server|client|node", re.I),
    "card": re.compile(r"card|visa|credit|karte|carte|tarjeta|pay", re.I),
    "phone": re.compile(r"phone|tel\b|tel[:.]|call|mobile|fax|handy|anruf|tél", re.I),
}


def luhn(digits: str) -> bool:
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(twice[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _mails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in time linear in the text: what stands before an @ begins after the @ or the address before."""
    out, lo, at = [], 0, text.find("@")
    while at >= 0:
        before = text[lo:at]
        n = len(before) - len(before.rstrip(_USER))
        lo = at + 1
        if n and (m := _HOST.match(text, at)):
            out.append((at - n, m.end()))
            lo = m.end()
        at = text.find("@", lo)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each base format that pass its check."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    out["email"] = _mails(text)
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out["card"] = [m.span() for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def more_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates beyond the base formats, overlapping ones too."""
    out = []
    for kind, pattern in _MORE.items():
        if kind == "email" and not re.search(r"\bat\b", text):
            continue
        out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return out


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context of a candidate. The last column tells nothing but the kind."""
    s, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 20]
    d = _digits(s)
    groups = re.findall(r"[0-9]+", s) or [""]
    return [
        float(len(s)), float(len(d)), float(len(groups)), float(max(map(len, groups))), float(min(map(len, groups))), float(len(groups[0])), float(len(groups[-1])),
        float(len(set(re.findall(r"[^0-9A-Za-z]", s)))), float(bool(d) and luhn(d)), float(d[:1] in "3456" and bool(d)), float(d[:2] == "00"), float("(" in s), float(len(set(d))),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "+.-/:#$€%" and bool(before)), float(after[:1] in "-/:%€$" and bool(after)), float(bool(re.search(r"\.[A-Za-z]{2,}$", s))),
        float(s.count(":")), float(len(re.findall(r"[A-Za-z]", s))), float(sum(c.isdigit() for c in before + after)),
        *[float(bool(p.search(before))) for p in _WORDS.values()], float(KINDS.index(kind)),
    ]


@dataclass
class Boosted:
    """Trees of one depth as arrays: for each tree the features and cuts of its inner nodes, and its leaves' values."""

    start: float = -20.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 2**DEPTH - 1), np.int64))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, 2**DEPTH - 1)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 2**DEPTH)))
    threshold: dict[str, float] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability that a candidate is personal data."""
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-out))


def _split(g: list[np.ndarray], h: list[np.ndarray], gs: float, hs: float, cuts: list[np.ndarray], reg: float) -> tuple[float, int, int]:
    """The best cut of a node: its gain, feature and number (-1: none). ``g``, ``h``: sums of gradients for each feature by bin; ``gs``, ``hs``: all."""
    best = (1e-9, 0, -1)
    for j, q in enumerate(cuts):
        left_g, left_h = np.cumsum(g[j])[: len(q)], np.cumsum(h[j])[: len(q)]
        gain = left_g**2 / (left_h + reg) + (gs - left_g) ** 2 / (hs - left_h + reg) - gs**2 / (hs + reg)
        if len(gain) and gain.max() > best[0]:
            best = (float(gain.max()), j, int(gain.argmax()))
    return best


def _log_odds(share: float) -> float:
    share = np.clip(share, 1e-3, 1 - 1e-3)
    return float(np.log(share / (1 - share)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = 0.2, reg: float = 5.0) -> Boosted:
    """Gradient boosting on the logistic loss, with cuts at quantiles of each feature."""
    model = Boosted(start=_log_odds(y.mean()))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(q, c) for q, c in zip(cuts, x.T, strict=True)], 1)  # bin > i means value > cut i
    score = np.full(len(y), model.start)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    fs, cs, ls = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        f, c, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for at in range(inner):
            own = np.flatnonzero(node == at)
            if len(own) >= 20:
                by_bin = lambda w, own=own: [np.bincount(binned[own, j], w[own], len(q) + 1) for j, q in enumerate(cuts)]
                _, j, i = _split(by_bin(g), by_bin(h), g[own].sum(), h[own].sum(), cuts, reg)
                if i >= 0:
                    f[at], c[at] = j, cuts[j][i]
            node[own] = 2 * at + 1 + (x[own, f[at]] > c[at])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + reg)
        score += value[leaf]
        fs.append(f), cs.append(c), ls.append(value)
    model.feature, model.cut, model.leaf = np.array(fs), np.array(cs), np.array(ls)
    return model


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    """The features (first column) of a batch of candidates."""
    return b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _sums(cells: DataFrame, model: Boosted, f: np.ndarray, c: np.ndarray, level: int, cuts: list[np.ndarray]) -> np.ndarray:
    """Of all candidates, for each node of a level of the next tree (so far ``f``, ``c``), each feature and bin: the sums of gradients, their slopes, and the number."""
    nodes = 2**level

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((nodes, 3, len(cuts), BINS))
        for b in it:
            x, y, n = _matrix(b), b.column(1).to_numpy(), b.column(2).to_numpy().astype(float)
            p, node, rows = model.predict(x), np.zeros(len(x), np.int64), np.arange(len(x))
            for _ in range(level):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            for j, q in enumerate(cuts):
                at = (node - (nodes - 1)) * BINS + np.searchsorted(q, x[:, j])
                for k, w in enumerate((n * (y - p), n * p * (1 - p), n)):
                    out[:, k, j] += np.bincount(at, w, nodes * BINS).reshape(nodes, BINS)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["w"])

    parts = batches(cells.select("x", "y", "n"), step, "w binary", 20_000).collect()
    return sum(np.frombuffer(r["w"]) for r in parts).reshape(nodes, 3, len(cuts), BINS)


def boosted(cells: DataFrame, trees: int = TREES, rate: float = 0.2, reg: float = 5.0) -> Boosted:
    """``boost`` of candidates in a table: x (features), y (1: right), n (how many are alike). Every level of a tree is one pass, from which the driver gets sums by bin."""
    right, n = cells.agg(F.sum(F.col("n") * F.col("y")), F.sum("n")).first()
    probs = np.linspace(0, 1, BINS + 1)[1:-1].tolist()
    values = cells.select("n", F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.percentile("v", probs, F.col("n")).alias("q")).orderBy("j").collect()
    cuts, model = [np.unique(r["q"]) for r in values], Boosted(start=_log_odds(right / n))
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    for _ in range(trees):
        f, c, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(leaves)
        for level in range(DEPTH):
            for i, (g, h, n) in enumerate(_sums(cells, model, f, c, level, cuts)):
                at, j, k = 2**level - 1 + i, 0, BINS  # without a cut all go left
                if n[0].sum() >= 20:
                    _, j, best = _split(g, h, g[0].sum(), h[0].sum(), cuts, reg)
                    if best >= 0:
                        f[at], c[at], k = j, cuts[j][best], best + 1
                if level == DEPTH - 1:
                    value[2 * i : 2 * i + 2] = [rate * g[j, own].sum() / (h[j, own].sum() + reg) for own in (slice(k), slice(k, None))]
        model.feature, model.cut, model.leaf = np.vstack([model.feature, f]), np.vstack([model.cut, c]), np.vstack([model.leaf, value])
    return model


def _rewritten(kind: str, s: str) -> list[str]:
    """A base span as it is written where the base format misses it."""
    if kind == "email":
        user, host = s.split("@", 1)
        return [f"{user} at {host}", f"{user}[at]{host.replace('.', ' dot ', 1)}"]
    if kind == "phone":
        return ["00" + s[1:], re.sub(r"[().]", " ", s[1:]).strip()]
    if kind == "card":
        d = _digits(s)
        return [".".join(d[i : i + 4] for i in range(0, len(d), 4)), "/".join(d[i : i + 4] for i in range(0, len(d), 4))]
    return [":".join(f"{int(p):x}" for p in s.split(".") * 2)]


class Taken:
    """Stretches of a text, those that touch or overlap joined; a question and an addition take a bisection each."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        i = bisect_right(self.ends, a)
        return i == len(self.starts) or self.starts[i] >= b

    def add(self, a: int, b: int) -> None:
        """A span that is free."""
        i = bisect_right(self.ends, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def training_rows(text: str) -> list[tuple[int, list[float]]]:
    """(label, features): base spans in other spellings, in their places, are right; candidates that fail the checks of their
    kind, and right ones with changed digits, are wrong."""
    rows, base = [], base_spans(text)
    for kind, spans in base.items():
        for a, b in spans:
            for other in _rewritten(kind, text[a:b]):
                # Candidates within 60 characters of it, and room for what features look at around these.
                left, at, end = text[max(0, a - 160) : a], min(a, 160), min(a, 160) + len(other)
                there, lo = left + other + text[b : b + 160], max(0, at - 60)
                for k, x, y in more_spans(there[lo : end + 60]):
                    x, y = x + lo, y + lo
                    covered = min(y, end) - max(x, at)
                    if k == kind and covered >= 0.9 * len(other) and y - x <= 1.2 * len(other):
                        rows.append((1, features(there, kind, x, y)))
                    elif covered > 0:
                        rows.append((0, features(there, k, x, y)))
    taken = Taken(s for spans in base.values() for s in spans)
    rows += [(0, features(text, k, a, b)) for k, a, b in more_spans(text) if taken.free(a, b)]
    return rows


def training_cells(docs: DataFrame) -> DataFrame:
    """Candidates of all texts (see ``training_rows``), alike ones as one row: calibrates (those of every third document, by a hash), x, y, n. Written."""
    h = F.pmod(F.xxhash64(F.lit("pii"), "doc_id"), F.lit(1_000_000))

    def out(held: Counter) -> pa.RecordBatch:
        cols = [*zip(*held, strict=True), held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.bool_(), pa.list_(pa.float64()), pa.int64(), pa.int64()), strict=True)], names=["calibrates", "x", "y", "n"])

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in it:
            for text, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.update((c, tuple(x), y) for y, x in training_rows(text))
                if len(held) > HELD:
                    yield out(held)
                    held.clear()
        if held:
            yield out(held)

    rows = batches(docs.filter("text is not null").select("text", (h % 3 == 0).alias("calibrates")), step, "calibrates boolean, x array<double>, y long, n long")
    return sized(rows.groupBy("calibrates", "x", "y").agg(F.sum("n").alias("n")).sortWithinPartitions("calibrates", "x", "y"), "candidates", SHARE)


def fit(docs: DataFrame) -> Boosted:
    """Trees and thresholds from the whole texts of all ``docs``; see ``training_rows``.

    Every third document calibrates: a kind's threshold is the lowest (in STEPS) at which PRECISION of its candidates there are right;
    a kind with fewer than 20 right ones adds nothing. Null texts are left out; repeated rows count each; without candidates, as in an empty
    table, no kind adds anything.
    """
    cells = training_cells(docs)
    learned, rest = cells.filter("not calibrates"), cells.filter("calibrates")
    if learned.isEmpty() or rest.isEmpty():
        dropped(cells)
        return Boosted()
    model = boosted(learned)

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x, n = _matrix(b), b.column(2).to_numpy()
            at = np.floor(model.predict(x) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (x[:, -1].astype(np.int64), at, n * b.column(1).to_numpy(), n)], names=["kind", "at", "good", "n"])

    # At most a row for each kind and step.
    found = batches(rest.select("x", "y", "n"), step, "kind long, at long, good long, n long", 20_000).groupBy("kind", "at").agg(F.sum("good"), F.sum("n")).filter(F.col("at") >= STEPS // 2).collect()
    for i, kind in enumerate(KINDS):
        own = np.array(sorted((r[1:] for r in found if r["kind"] == i), reverse=True), np.int64).reshape(-1, 3)
        right, n = own[:, 1].cumsum(), own[:, 2].cumsum()
        good = np.flatnonzero((right >= PRECISION * n) & (right >= 20))
        if len(good):
            model.threshold[kind] = float(own[good[-1], 0]) / STEPS
    dropped(cells)
    return model


def find_spans(texts: list[str], model: Boosted) -> list[tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]]:
    """Base spans and all spans of each text. Added spans pass their kind's threshold, and overlap no base span and no better one."""
    out, asked = [], []
    for i, t in enumerate(texts):
        base = base_spans(t)
        out.append((base, {k: list(v) for k, v in base.items()}))
        if model.threshold:
            asked += [(i, k, a, b) for k, a, b in more_spans(t) if k in model.threshold]
    if asked:
        p = model.predict(np.array([features(texts[i], k, a, b) for i, k, a, b in asked]))
        taken: dict[int, Taken] = {}
        for j in np.argsort(-p, kind="stable").tolist():
            i, k, a, b = asked[j]
            if p[j] < model.threshold[k]:
                continue
            if i not in taken:
                taken[i] = Taken(s for v in out[i][0].values() for s in v)
            if taken[i].free(a, b):
                taken[i].add(a, b)
                out[i][1][k].append((a, b))
    for _, every in out:
        for v in every.values():
            v.sort()
    return out


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def personal_data(docs: DataFrame, model: Boosted, redact: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each document; with ``redact`` also its text with every span
    replaced by its kind in brackets.

    Counts and digest are those of the base formats; spans (kind:start:end, code points, by kind and start) holds base and
    added ones. A null text is an empty one, without spans. Texts are taken one by one, so repeated rows agree; an empty
    table gives an empty result; further columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = find_spans(texts, model)
            cols = [b.column(0), *[pa.array([len(base[k]) for base, _ in found], pa.int64()) for k in KINDS]]
            cols.append(pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()))
            cols.append(pa.array([joined(every) for _, every in found], pa.string()))
            names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
            if redact:
                cols.append(pa.array([redacted(t, every) for t, (_, every) in zip(texts, found, strict=True)], pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return batches(docs.select("doc_id", "text"), step, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string" + ", text string" * redact)


def redacted(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, v in spans.items() for a, b in v):
        if b > at:
            out += [text[at : max(a, at)], f"[{k}]"]
            at = b
    return "".join(out) + text[at:]
