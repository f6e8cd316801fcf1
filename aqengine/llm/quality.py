"""Operator 13: quality of texts, by a sparse ensemble of rules over statistics, compiled into column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pii import DEPTH, Boosted, boost

#: Labelled documents that are learned from at most, chosen by a hash of doc_id; trees whose paths become rules; penalties that are tried; score at which a text is kept.
LABELLED, TREES, PENALTIES, KEPT = 20_000, 60, (0.03, 0.01, 0.003, 0.001, 0.0003), 0.7
STATISTICS = (
    "chars", "words", "word_length", "distinct_words", "letters", "upper", "digits", "symbols", "symbol_runs", "lone_symbols", "stops", "long_words", "lines", "distinct_lines", "line_words", "spaces", "controls",
)


def statistics(text: Column) -> dict[str, Column]:
    """Counts and shares of a whole text, as column expressions; those of a null or empty text are 0."""
    t = F.coalesce(text, F.lit(""))
    n = lambda p: F.regexp_count(t, F.lit(p)).cast("double")
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.split(t, r"\n")
    size, chars, n_lines = F.size(words).cast("double"), F.length(t).cast("double"), F.size(lines).cast("double")
    letters = n(r"\p{L}")
    return {
        "chars": chars, "words": size, "word_length": over(chars, size), "distinct_words": over(F.size(F.array_distinct(words)).cast("double"), size), "letters": over(letters, chars), "upper": over(n(r"\p{Lu}"), letters),
        "digits": over(n(r"\p{Nd}"), chars), "symbols": over(n(r"[^\p{L}\p{N}\s]"), chars), "symbol_runs": over(n(r"[^\p{L}\p{N}\s]{2,}+"), size), "lone_symbols": over(n(r"(?<!\S)[^\p{L}\p{N}\s]++(?!\S)"), size),
        "stops": over(n(r"[.!?](?=\s|$)"), size), "long_words": over(n(r"\S{20,}+"), size), "lines": n_lines, "distinct_lines": over(F.size(F.array_distinct(lines)).cast("double"), n_lines), "line_words": over(size, n_lines),
        "spaces": over(n(r"\s"), chars), "controls": over(n(r"[\p{Cc}\x{FFFD}&&[^\s]]"), chars),
    }


@dataclass
class Rules:
    """Weighted conjunctions; each condition is a statistic, whether it lies above, and a cut."""

    start: float = 0.0
    weights: list[float] = field(default_factory=list)
    rules: list[tuple[tuple[int, bool, float], ...]] = field(default_factory=list)

    def score(self, columns: list[Column]) -> Column:
        """Probability of good quality, as one expression of the statistics' columns."""
        total = F.lit(self.start)
        for w, rule in zip(self.weights, self.rules, strict=True):
            met = F.lit(True)
            for j, above, cut in rule:
                met = met & ((columns[j] > cut) if above else (columns[j] <= cut))
            total = total + F.when(met, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def paths(trees: Boosted) -> list[tuple[tuple[int, bool, float], ...]]:
    """Every path from a tree's root to one of its nodes, as a conjunction; of a statistic's bounds in one direction the tightest stays."""
    out = set()
    for feature, cut in zip(trees.feature.tolist(), trees.cut.tolist(), strict=True):
        for node in range(1, 2 ** (DEPTH + 1) - 1):
            bounds: dict[tuple[int, bool], float] = {}
            at = node
            while at:
                up = (at - 1) // 2
                if np.isfinite(cut[up]):
                    key, c = (feature[up], at == 2 * up + 2), cut[up]
                    bounds[key] = c if key not in bounds else (max if key[1] else min)(bounds[key], c)
                at = up
            if bounds:
                out.add(tuple(sorted((j, above, c) for (j, above), c in bounds.items())))
    return sorted(out)


def met(rules: list[tuple[tuple[int, bool, float], ...]], x: np.ndarray) -> np.ndarray:
    """(rows, rules): 1 where a rule holds."""
    out = np.ones((len(x), len(rules)), np.float32)
    for i, rule in enumerate(rules):
        for j, above, cut in rule:
            out[:, i] *= (x[:, j] > cut) if above else (x[:, j] <= cut)
    return out


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None, steps: int = 400) -> np.ndarray:
    """Logistic weights (the first is the constant, which isn't penalised) by accelerated proximal steps."""
    w = np.zeros(x.shape[1] + 1) if start is None else start.copy()
    v = np.random.default_rng(0).standard_normal(x.shape[1])
    for _ in range(20):  # the largest eigenvalue of x'x bounds the curvature
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) or 1.0
    rate = 4 / ((np.linalg.norm(x @ v) ** 2 / len(x) + 1) * 1.05)
    z, t = w, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z[0] + x @ z[1:], -40, 40)))
        g = p - y
        new = z - rate * np.concatenate([[g.mean()], x.T @ g / len(x)])
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / after * (new - w)
        if np.abs(new - w).max() < 1e-6:
            return new
        w, t = new, after
    return w


def loss(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    s = np.clip(w[0] + x @ w[1:], -40, 40)
    return float(np.mean(np.logaddexp(0, s) - y * s))


def fit_rules(x: np.ndarray, y: np.ndarray) -> Rules:
    """Rules of boosted trees, weighted by the penalty that predicts every fifth row best from the others."""
    if not len(y):
        return Rules()
    if y.min() == y.max():
        return Rules(start=4.0 if y[0] else -4.0)
    rules = paths(boost(x, y, TREES))
    holds, test = met(rules, x), np.arange(len(y)) % 5 == 0
    best, w = (np.inf, PENALTIES[0]), None
    for penalty in PENALTIES:  # each starts from the weights of the one before
        w = lasso(holds[~test], y[~test], penalty, w)
        best = min(best, (loss(w, holds[test], y[test]), penalty))
    w = lasso(holds, y, best[1])
    on = np.flatnonzero(w[1:])
    return Rules(float(w[0]), [float(w[1 + i]) for i in on], [rules[i] for i in on])


def labelled(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``most`` documents of ``docs`` that have a label. Labels of one doc_id are averaged, and count as good from a half."""
    h = F.xxhash64(F.lit("quality"), "doc_id")
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("_good"))
    few = known.withColumn("_h", h).orderBy("_h", "doc_id").limit(most)  # a bounded number of rows
    stats = statistics(F.col("text"))
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("_h", "doc_id", "_good", *[stats[s].alias(s) for s in STATISTICS])
    table = rows.orderBy("_h", "doc_id", *STATISTICS).limit(most).select("_good", *STATISTICS).toPandas()
    return table[list(STATISTICS)].to_numpy(float), table["_good"].to_numpy(float)


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Rules:
    """Rules learned from the documents in ``docs`` that ``labels`` (doc_id, quality) marks. Rows with a null doc_id or quality aren't learned from; repeated rows count each;
    without labelled rows the score is 0.5, with those of one label alone near that label."""
    return fit_rules(*labelled(docs, labels, most))


def scored(docs: DataFrame, model: Rules, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and score (0 to 1), predicted (1 from KEPT on) of every whole text.

    A null text counts as empty, and an empty one has a score too. Rows are scored one by one, so repeated rows agree; an empty table gives an empty result; further columns are
    ignored unless kept.
    """
    stats = statistics(F.col("_text"))
    rows = docs.select(*keep, F.col("text").alias("_text")).select(*keep, *[stats[s].alias(f"_{s}") for s in STATISTICS])
    rows = rows.select(*keep, model.score([F.col(f"_{s}") for s in STATISTICS]).alias("score"))
    return rows.select(*keep, "score", (F.col("score") >= KEPT).cast("int").alias("predicted"))
