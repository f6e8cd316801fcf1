"""Operator 8: language of each document, by interpolated Kneser-Ney character models."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, dropped, written

LETTERS = re.compile(r"[^\W\d_]+")
ORDER = 5
#: Whole texts that are learned from, for each language at most.
TEXTS = 400
#: Labels that are learned at most, most frequent first; bytes of the longest word that is learned from, and words learned at most, all languages together.
LANGS, LONG_WORD, VOCABULARY = 1000, 256, 2_000_000
#: Robust deviations above the median cost at which a text is rejected.
SPREADS = 10
#: Words whose scores a worker keeps, and the longest of them.
KEPT, LONGEST = 300_000, 40
_MIX = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str) -> list[str]:
    """The runs of letters of a text, in lower case. Number signs (fractions, superscripts, numbers in circles), which the pattern lets through, are none."""
    found = LETTERS.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in ([w] if w.isalpha() else "".join([c if c.isalpha() else " " for c in w]).split())]


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n codes that end at each position; meaningless for the first n - 1."""
    h = np.full(len(codes), n, np.uint64)
    for i in range(n - 1, -1, -1):
        h[i:] = (h[i:] ^ codes[: max(0, len(codes) - i)]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _laid_out(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the words one after the other, each between two spaces; for each code its word and its place in it."""
    line = " " + "  ".join(words) + " "
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    word = np.repeat(np.arange(len(words)), size)
    return codes, word, np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places in a sorted array, -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


@dataclass
class Model:
    """For each order a sorted array of n-gram hashes and a row of log probabilities, one for each language; and likewise for
    contexts the log weights of the next lower order."""

    langs: list[str]
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    logw: list[np.ndarray]
    floor: np.ndarray
    reject_above: float = np.inf

    def score(self, words: list[str]) -> np.ndarray:
        """(words, languages): log probability of each word and its end."""
        codes, word, place = _laid_out(words)
        total = np.zeros((len(codes), len(self.langs)))
        open_ = place > 0
        for n in range(ORDER, 0, -1):
            at = np.flatnonzero(open_ & (place >= n - 1))
            if not len(at):
                continue
            row = _find(self.grams[n - 1], _hashes(codes, n)[at])
            hit = row >= 0
            total[at[hit]] += self.logp[n - 1][row[hit]]
            open_[at[hit]] = False
            if n > 1 and len(missed := at[~hit]):
                row = _find(self.contexts[n - 2], _hashes(codes, n - 1)[missed - 1])
                total[missed[row >= 0]] += self.logw[n - 2][row[row >= 0]]
        total[open_] += self.floor
        out = np.zeros((len(words), len(self.langs)))
        np.add.at(out, word, total)
        return out


def fit_words(counts: dict[str, Counter]) -> Model:
    """Interpolated Kneser-Ney over each language's word counts; characters of a word are predicted within the word."""
    langs = sorted(counts, key=lambda x: x.encode())
    raw: list[list[tuple[np.ndarray, ...]]] = []  # language, order: n-gram, context, shorter n-gram, count
    for lang in langs:
        words = list(counts[lang])
        codes, word, place = _laid_out(words)
        times = np.array([counts[lang][w] for w in words], float)[word]
        hs = [_hashes(codes, n) for n in range(1, ORDER + 1)]
        per = []
        for n in range(1, ORDER + 1):
            at = np.flatnonzero((place >= n - 1) & (place > 0))
            grams, first, back = np.unique(hs[n - 1][at], return_index=True, return_inverse=True)
            where = at[first]
            # All orders below the highest count distinct continuations; n-grams at the start of a word have none before them.
            c = np.bincount(back, times[at], len(grams))
            per.append([grams, hs[n - 2][where - 1] if n > 1 else np.zeros(len(grams), np.uint64), hs[n - 2][where] if n > 1 else grams, c, place[where] == n - 1])
        for n in range(1, ORDER):
            here, longer = per[n - 1], per[n]
            c = np.bincount(_find(here[0], longer[2]), minlength=len(here[0])).astype(float)
            here[3] = np.where(here[4] & (n > 1), here[3], np.maximum(c, 1e-9 if n > 1 else 0.0))
        raw.append(per)
    letters = max((len(per[0][0]) for per in raw), default=1)
    floor = np.full(len(langs), np.log(1e-4 / (letters + 1)))
    grams, logp, contexts, logw = [], [], [], []
    lower = None
    for n in range(1, ORDER + 1):
        union = np.unique(np.concatenate([per[n - 1][0] for per in raw])) if raw else np.zeros(0, np.uint64)
        ctxs = np.unique(np.concatenate([per[n - 1][1] for per in raw])) if raw else np.zeros(0, np.uint64)
        p, w = np.zeros((len(union), len(langs))), np.zeros((len(ctxs), len(langs)))
        ctx_of, short_of = np.zeros(len(union), int), np.zeros(len(union), np.uint64)
        for per in raw:
            at = np.searchsorted(union, per[n - 1][0])
            ctx_of[at], short_of[at] = np.searchsorted(ctxs, per[n - 1][1]), per[n - 1][2]
        for j, per in enumerate(raw):
            g, c = per[n - 1][0], per[n - 1][3]
            once, twice = (c == 1).sum(), (c == 2).sum()
            d = once / (once + 2 * twice) if once and twice else 0.5
            ctx = np.searchsorted(ctxs, per[n - 1][1])
            total = np.bincount(ctx, c, len(ctxs))
            kinds = np.bincount(ctx, c > 0, len(ctxs))
            weight = np.where(total > 0, np.minimum(d * kinds / np.maximum(total, 1e-9), 1.0), 1.0)
            weight = np.maximum(weight, 1e-6)
            w[:, j] = np.log(weight)
            below = np.exp(lower[1][_find(lower[0], short_of), j]) if lower else np.full(len(union), 1 / (letters + 1))
            own = np.zeros(len(union))
            own[np.searchsorted(union, g)] = np.maximum(c - d, 0) / np.maximum(total[ctx], 1e-9)
            p[:, j] = np.log(own + weight[ctx_of] * below)
        grams.append(union)
        logp.append(p)
        if n > 1:
            contexts.append(ctxs)
            logw.append(w)
        lower = (union, p)
    return Model(langs, grams, logp, contexts, logw, floor)


class Scorer:
    """Scores of texts; those of words are kept."""

    def __init__(self, model: Model) -> None:
        self.model, self.place = model, {}
        self.table = np.zeros((0, len(model.langs)))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages): negative log probability for each letter or word end; and how many of these there are."""
        found = [letters(t) for t in texts]
        new = list({w for ws in found for w in ws}.difference(self.place))
        if len(self.place) + len(new) > KEPT:
            self.place, self.table = {}, self.table[:0]
            new = list({w for ws in found for w in ws})
        if new:
            n = len(self.table)
            self.place.update(zip(new, range(n, n + len(new)), strict=True))
            self.table = np.concatenate([self.table, *(self.model.score(new[i : i + 20_000]) for i in range(0, len(new), 20_000))])
        out, sizes = np.zeros((len(texts), len(self.model.langs))), np.zeros(len(texts), np.int64)
        for i, ws in enumerate(found):
            if ws:
                sizes[i] = sum(map(len, ws)) + len(ws)
                out[i] = -self.table[list(map(self.place.__getitem__, ws))].sum(0) / sizes[i]
        if len(self.place) and max(map(len, new), default=0) > LONGEST:  # very long words aren't kept
            self.place = {w: i for w, i in self.place.items() if len(w) <= LONGEST}
        return out, sizes


def learned_sample(docs: DataFrame, texts: int = TEXTS) -> DataFrame:
    """(lang, text, r) of at most ``texts`` whole texts of each of the LANGS most frequent languages, chosen and numbered from 1 by a hash of doc_id.

    Rows without a language or a text are left out; rows that repeat a doc_id are ordered by their texts; an empty table gives an empty result.
    """
    known = docs.filter("lang is not null and text is not null")
    h = F.pmod(F.xxhash64(F.lit("learned"), "doc_id"), F.lit(1_000_000))
    n = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS)
    near = known.select("lang", "text", h.alias("h")).join(F.broadcast(n), "lang").filter(F.col("h") < F.greatest(F.lit(1), F.ceil(F.lit(2e6 * texts) / F.col("n"))))
    first = Window.partitionBy("lang").orderBy("h", "text")
    return near.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= texts).select("lang", "text", "r")


def _word_counts(sample: DataFrame) -> DataFrame:
    """(lang, word, n, part): how often the texts of each language have each word, and how often those that are not for calibration have it."""

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found: dict[tuple[str, bool], Counter] = {}
            for lang, text, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found.setdefault((lang, r % 5 > 0), Counter()).update(w for w in letters(text) if len(w.encode("utf-8", "surrogatepass")) <= LONG_WORD)
            rows = [(lang, w, n, n if part else 0) for (lang, part), words in found.items() for w, n in words.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["lang", "word", "n", "part"])

    counted = batches(sample.select("lang", "text", "r"), step, "lang string, word string, n long, part long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("part").alias("part"))


def fit(docs: DataFrame, texts: int = TEXTS) -> Model:
    """A model of each language in ``docs`` (lang, text, doc_id), and the rejection level.

    Words of the sampled texts are counted in tasks; the driver gets the counts of at most VOCABULARY words, the most frequent of each language,
    and no text. The level is calibrated on every fifth sampled text of a language, scored by models of the others: the highest ``_level`` of any language. It is made
    of medians, so a few odd or mislabelled texts don't move it. Languages with fewer than five texts have none for it.

    Rows without a language or a text are not learned from; of repeated rows each counts; an empty table gives a model without languages, which rejects nothing by its level.
    """
    sample = written(learned_sample(docs, texts), "learned")
    counted = written(_word_counts(sample), "words")
    langs = counted.select("lang").distinct().count()
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    rows = counted.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= VOCABULARY // max(langs, 1)).select("lang", "word", "n", "part").toPandas().sort_values(["lang", "word"])
    dropped(counted)

    def counts(column: str) -> dict[str, Counter]:
        some = rows[rows[column] > 0]
        return {lang: Counter(dict(zip(of["word"], of[column].tolist(), strict=True))) for lang, of in some.groupby("lang", sort=True)}

    model = fit_words(counts("n"))
    part = fit_words(counts("part"))
    if part.langs:
        tried = predict(sample.filter("r % 5 = 0"), part, ("lang",), sizes=True).filter("n >= 20").select("lang", "cost").collect()
        by: dict[str, list[float]] = {}
        for r in tried:
            by.setdefault(r["lang"], []).append(r["cost"])
        if by:
            model.reject_above = max(map(_level, by.values()))
    dropped(sample)
    return model


def _level(costs: list[float]) -> float:
    """1.75 times the median, or SPREADS robust deviations (1.4826 times the median distance) above it, whichever is more."""
    mid = float(np.median(costs))
    return max(1.75 * mid, mid + SPREADS * 1.4826 * float(np.median(np.abs(np.array(costs) - mid))))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), sizes: bool = False) -> DataFrame:
    """The columns in ``keep`` and lang_pred, score (0 to 1), cost (nats for each letter or word end, null if there is none), rejected.

    The language is the one whose model has the lowest cost of the whole text, ties to the smaller name; score is its share among
    all languages, given at most 60 letters' evidence. A text that is null or has no letter is ``und`` with score 0, and
    rejected; so are texts that cost more than the calibrated level, though their lang_pred stands. Without learned languages
    all are ``und``. Rows are predicted one by one, so repeated rows agree; an empty table gives an empty result; further
    columns are ignored unless kept. With ``sizes`` there is n as well, the letters and word ends of a text.
    """
    langs, kinds = model.langs, dict(docs.dtypes)

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in it:
            texts = [t or "" for t in b.column(len(keep)).to_pylist()]
            if langs:
                cost, n = scorer(texts)
                best = cost.argmin(1)
                low = cost.min(1)
                share = 1 / np.exp((low[:, None] - cost) * np.minimum(n, 60)[:, None]).sum(1)
            else:
                n, best, low, share = np.zeros(len(texts), int), np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts))
            ok = n > 0
            pred = [langs[j] if k else "und" for j, k in zip(best.tolist(), ok.tolist(), strict=True)]
            out = [*b.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(np.where(ok, share, 0.0)), pa.array(low, mask=~ok), pa.array(~ok | (low > model.reject_above))]
            names = [*keep, "lang_pred", "score", "cost", "rejected"]
            yield pa.RecordBatch.from_arrays([*out, pa.array(n, pa.int64())] if sizes else out, names=[*names, "n"] if sizes else names)

    return batches(docs.select(*keep, F.col("text").alias("_text")), step, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double, cost double, rejected boolean" + (", n long" if sizes else ""))


def held_out(mod: int, remainder: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), F.lit(mod)) == remainder
