"""Operator 3: log probability of texts under a causal self-attention model over subword ids, and under word counts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, dropped, written
from .memo import flat_binary, flat_bytes, gathered, places, sums

#: Inputs of a window, and how many of its last targets it scores; windows overlap by the rest, so each token is scored once.
WINDOW, SCORED = 32, 24
#: Model's subwords: the end, 256 bytes, and the most frequent subwords of the corpus.
VOCAB = 1024
#: Width of attention and of the hidden layer; tables that the network mixes.
WIDTH, HIDDEN, TABLES = 16, 32, 16
#: Windows that are scored at a time.
ROWS = 128
#: Texts and windows of them that the weights start from at most, passes over these, and least steps.
SAMPLE, WINDOWS, PASSES, STEPS = 1000, 40_000, 2, 600
#: Rounds over all training texts; each window of a text belongs to one of them. All pairs of neighbouring subwords are counted, how the tables share them is learned from all windows,
#: and every GRADED-th window of a round goes into the network's steps. The rate of the first round; windows of a step; windows after which a task renews its own tables.
ROUNDS, GRADED, RATE, SIZE, RENEWED = 2, 4, 0.003, 128, 40_000
#: Slices of the pairs in which tasks' counts are summed.
SLICES = 16
#: Words with counts that every task has at hand, and the longest of them in bytes; all others are joined.
COMMON, LONGEST = 262_144, 64
#: Bytes of texts that a worker takes at a time, words of them that it encodes at a time, and windows whose shares it takes at a time.
GATHERED, ENCODED, SHARED = 4 << 20, 32_768, 8192
END = b"\n"  # no word can hold it
#: Fixed value: a word with its space is cut into letters, digits and others before pairs are merged.
PIECES = r"\x20?\p{L}+|\x20?\p{N}+|\x20?[^\s\p{L}\p{N}]+|\s+"
#: White space that a word can hold: ``\s`` there without a space.
SPACES = re.compile("[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Subwords:
    """Model ids of words: the byte-pair ids of the lower-case word with a space before it; ids outside the model's vocabulary are
    spelled in bytes. ``vocab``: the file's ids, from the model's id 257 on; 0 is the end, 1 to 256 are bytes."""

    def __init__(self, path: str, vocab: list[int]) -> None:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.own = tiktoken.Encoding("words", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        place, n = {t: i + 257 for i, t in enumerate(vocab)}, max(ranks.values()) + 1
        spelled, self.begins = [b""] * n, np.zeros(n, bool)
        for token, rank in ranks.items():
            spelled[rank] = np.array([place[rank]] if rank in place else [1 + b for b in token], "<u2").tobytes()
            self.begins[rank] = token[:1] == b" "
        self.size = np.fromiter(map(len, spelled), np.int64, n) // 2
        self.start, self.pool = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(spelled), "<u2")
        self.common = self.kept = self.find = None

    def raw(self, word: bytes) -> list[int]:
        """The file's own ids."""
        return self.own.encode_ordinary(" " + word.decode("utf-8", "replace"))

    def raw_all(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The file's own ids of all words one after the other, and how many each word has.

        Words are encoded as one text: a piece holds a space at its start alone, so no pair is merged across words, and a word begins with each id that begins with a space.
        Empty words and those with other white space, which could be one piece with the next word's space, are encoded one by one."""
        words = words.cast(pa.binary())
        if len(words) > ENCODED:
            ids, n = zip(*(self.raw_all(words[a : a + ENCODED]) for a in range(0, len(words), ENCODED)), strict=True)
            return np.concatenate(ids), np.concatenate(n)
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        alone = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        text = " " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b" ")[0].as_py().decode("utf-8", "replace")
        if SPACES.search(text):
            alone = alone | np.array([SPACES.search(w.decode("utf-8", "replace")) is not None for w in words.to_pylist()])
        if not alone.any():
            ids = np.array(self.own.encode_ordinary(text), np.int64)
            return ids, np.diff(np.flatnonzero(self.begins[ids]), append=len(ids))
        single = [self.raw(w) for w in words.filter(pa.array(alone)).to_pylist()]
        ids, n = self.raw_all(words.filter(pa.array(~alone)))
        size = np.empty(len(words), np.int64)
        size[alone], size[~alone] = [len(i) for i in single], n
        out, which = np.empty(int(size.sum()), np.int64), np.repeat(alone, size)
        out[which], out[~which] = [i for one in single for i in one], ids
        return out, size

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each word has."""
        raw, n = self.raw_all(words)
        size = self.size[raw]
        return self.pool[places(self.start[raw], size)], sums(size, n)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``of_words`` of a list."""
        return self.of_words(pa.array(words, pa.binary()))

    def keep(self, common: pa.Array) -> None:
        """Encodes these words once and for all."""
        if self.common is None or not self.common.equals(common):
            ids, size = self.of_words(common)
            self.common, self.kept, self.find = common, (ids, np.cumsum(size) - size, size), Places(common)

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of all texts one after the other, how many each text has, and its words: distinct ones, numbers of these one after the other, how many
        a text has, and the distinct ones' places among the common words of ``keep``, which comes first (-1: none)."""
        words, codes, count = split_words(texts)
        pool, start, size = self.kept
        at = self.find(words)
        ids, n = self.of_words(words.filter(pa.array(at < 0)))
        starts, each = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        starts[at < 0], each[at < 0] = len(pool) + np.cumsum(n) - n, n
        starts[at >= 0], each[at >= 0] = start[at[at >= 0]], size[at[at >= 0]]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), pa.array(np.concatenate([pool, ids])[places(starts, each)]))
        return lists.take(pa.array(codes)).flatten().to_numpy(), sums(each[codes], count), (words, codes, count, at)


class Places:
    """The places of words in a list that stays the same. Arrow's ``index_in`` hashes the whole list again each time."""

    def __init__(self, known: pa.Array) -> None:
        self.mixed = np.random.default_rng(11).integers(1, 2**63, LONGEST, np.uint64) * np.uint64(2) + np.uint64(1)
        h = self._hashes(known)
        self.order = np.argsort(h, kind="stable")
        self.known, self.hashes = known, h[self.order]

    def __call__(self, words: pa.Array) -> np.ndarray:
        """-1: not in the list, as are words that share a hash with an earlier one of it."""
        if not len(self.known) or not len(words):
            return np.full(len(words), -1)
        h = self._hashes(words)
        near = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        at, hit = self.order[near], np.flatnonzero(self.hashes[near] == h)
        same = pc.equal(words.take(pa.array(hit)), self.known.take(pa.array(at[hit]))).to_numpy(zero_copy_only=False)
        out = np.full(len(words), -1)
        out[hit[same]] = at[hit[same]]
        return out

    def _hashes(self, words: pa.Array) -> np.ndarray:
        words = words.cast(pa.binary())
        size = pc.binary_length(words).to_numpy().astype(np.int64)
        data, first = flat_bytes(words), np.cumsum(size) - size
        each = (data + np.uint64(1)) * self.mixed[places(np.zeros(len(size), np.int64), size) % LONGEST]
        return np.add.reduceat(np.append(each, np.uint64(0)), first) if len(size) else each


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of lower-cased texts: distinct words, the numbers of all words one after the other, and how many each text has. Null counts as empty."""
    low = pc.replace_substring(pc.ascii_lower(pc.fill_null(texts, "")), "\n", " ")
    if pc.any(pc.match_substring_regex(low, r"[\t-\r]")).as_py():
        low = pc.replace_substring_regex(low, r"[\t-\r]", " ")
    cut = pc.split_pattern(low, " ")
    flat, ends = cut.flatten(), cut.offsets.to_numpy() - (cut.offsets[0].as_py() if len(cut) else 0)
    named = flat.dictionary_encode()
    codes, words = named.indices.to_numpy().astype(np.int32), named.dictionary
    blank = pc.index(words, "").as_py()
    if blank >= 0:  # beside white space there are empty strings, which are no words
        filled = codes != blank
        ends, codes = np.concatenate([[0], np.cumsum(filled)])[ends], codes[filled]
    return words, codes, np.diff(ends).astype(np.int64)


_subwords: dict[tuple, Subwords] = {}


def subwords(path: str, vocab: tuple[int, ...]) -> Subwords:
    if (path, vocab) not in _subwords:
        _subwords.clear()
        _subwords[path, vocab] = Subwords(path, list(vocab))
    return _subwords[path, vocab]


def laid_out(ids: np.ndarray, sizes: np.ndarray, pick: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) inputs and (windows, SCORED) targets of texts whose ids stand one after the other; only windows for whose number in
    the text ``pick`` (of as many as the longest text has) is true. Every text ends with the end (0) and begins after one; VOCAB pads inputs, -1 targets."""
    lead = WINDOW - SCORED
    n = sizes + 1
    m = -(-n // SCORED)
    width = lead + m * SCORED
    at = np.cumsum(width) - width
    x = np.full(int(width.sum()), VOCAB, np.int32)
    x[at + lead] = 0
    x[places(at + lead + 1, sizes)] = ids
    upto = np.cumsum(m) * SCORED
    y = np.full(int(m.sum()) * SCORED, -1, np.int32)
    first = upto - m * SCORED
    y[places(first, sizes)] = ids
    y[first + sizes] = 0
    number = places(np.zeros(len(m), np.int64), m)
    start = np.repeat(at, m) + number * SCORED
    y = y.reshape(-1, SCORED)
    if pick is not None:
        start, y = start[pick[number]], y[pick[number]]
    return x[start[:, None] + np.arange(WINDOW)], y


def windows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``laid_out`` of a list of texts' ids."""
    return laid_out(np.concatenate([*docs, np.zeros(0, np.uint16)]), np.array([len(d) for d in docs], np.int64))


def pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of the tables: each target after its own input."""
    return (np.minimum(x[:, WINDOW - SCORED :], VOCAB - 1).astype(np.int64) * VOCAB + np.maximum(y, 0)).ravel()


@dataclass
class Soft:
    """Sums of shares by table, of the pairs of subwords that were met: pairs in order, and a row of sums for each."""

    pair: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, pair: np.ndarray, share: np.ndarray) -> Soft:
        place = np.zeros(VOCAB * VOCAB, np.int32)
        place[pair] = 1
        met = np.flatnonzero(place)
        place[met] = np.arange(len(met))
        at, sums = place[pair], np.empty((len(met), TABLES), share.dtype)
        for k in range(TABLES):  # faster than in the order of pairs, and summed in double precision
            sums[:, k] = np.bincount(at, share[:, k], len(met))
        return cls(met, sums)

    @classmethod
    def none(cls) -> Soft:
        return cls(np.zeros(0, np.int64), np.zeros((0, TABLES), np.float32))

    def spread(self, pair: np.ndarray, count: np.ndarray) -> Soft:
        """The counts of pairs, shared among the tables as here: a pair's own sums, eked out by those of its first subword."""
        total = np.zeros((VOCAB, TABLES))
        for k in range(TABLES):
            total[:, k] = np.bincount(self.pair // VOCAB, self.sums[:, k], VOCAB) + 1e-3
        share = (total / total.sum(1, keepdims=True)).astype(np.float32)[pair // VOCAB]
        at = np.minimum(np.searchsorted(self.pair, pair), max(0, len(self.pair) - 1))
        if len(self.pair):
            share += self.sums[at] * (self.pair[at] == pair)[:, None]
        return Soft(pair, share * (count / share.sum(1)).astype(np.float32)[:, None])

    def plus(self, other: Soft, share: float = 1) -> Soft:
        """Both; this one counts ``share``."""
        place = np.full(VOCAB * VOCAB, -1, np.int32)
        place[self.pair] = place[other.pair] = 0
        both = np.flatnonzero(place >= 0)
        place[both] = np.arange(len(both))
        sums = np.zeros((len(both), TABLES), np.result_type(self.sums, other.sums))
        sums[place[self.pair]] = self.sums * np.float32(share)
        sums[place[other.pair]] += other.sums  # each pair is once in either
        return Soft(both, sums)


@dataclass
class Tables:
    """Distributions of the next subword after each, TABLES of them: rows of P(y | x, k) for the pairs that were met, and base[x, y] * scale[x, k] for the others."""

    row: np.ndarray
    met: np.ndarray
    base: np.ndarray
    scale: np.ndarray

    @classmethod
    def smoothed(cls, soft: Soft, eke: float = 5) -> Tables:
        """From soft counts: a table's counts are eked out by those of all tables together, these by the counts of single subwords, and these evenly."""
        every = np.zeros(VOCAB * VOCAB, np.float32)
        every[soft.pair] = soft.sums.sum(1)
        every = every.reshape(VOCAB, VOCAB)
        one = every.sum(0) + 0.5
        one /= one.sum()
        n = every.sum(1, keepdims=True)
        held = np.minimum(every, 0.6)
        base = eke * ((every - held + (held.sum(1, keepdims=True) + 1e-3) * one) / (n + 1e-3))
        total, x = np.zeros((VOCAB, TABLES)), soft.pair // VOCAB
        for k in range(TABLES):
            total[:, k] = np.bincount(x, soft.sums[:, k], VOCAB)
        scale = (1 / (total + base.sum(1, dtype=float)[:, None])).astype(np.float32)
        base, row = base.ravel(), np.full(VOCAB * VOCAB, -1, np.int32)
        row[soft.pair] = np.arange(len(soft.pair))
        return cls(row, (soft.sums + base[soft.pair][:, None]) * scale[x], base, scale)

    def of(self, pair: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """The probabilities of pairs."""
        row = self.row[pair]
        if len(self.met):
            out = np.take(self.met, row, 0, out=out, mode="clip")
        elif out is None:
            out = np.empty((len(pair), TABLES), self.scale.dtype)
        if len(new := np.flatnonzero(row < 0)):
            out[new] = self.base[pair[new]][:, None] * self.scale[pair[new] // VOCAB]
        return out


@dataclass
class Attention:
    """One layer of causal self-attention, whose output mixes TABLES transitions from the last subword to the next: P(y) = sum of mix[k] * P(y | x, k).

    The network (``p``) is learned by gradients, the tables from the soft counts of what follows what: each target counts in a table by the share that
    the table has in its probability.
    """

    p: dict[str, np.ndarray]
    tables: Tables

    @classmethod
    def new(cls, soft: Soft, seed: int = 3) -> Attention:
        """Random weights; tables from soft counts."""
        r = np.random.default_rng(seed)
        f = lambda *s: r.standard_normal(s) / np.sqrt(s[0])
        p = {"e": 0.5 * r.standard_normal((VOCAB + 1, WIDTH)), "pos": 0.1 * r.standard_normal((WINDOW, WIDTH)), "q": f(WIDTH, WIDTH), "k": f(WIDTH, WIDTH), "v": f(WIDTH, WIDTH), "w": f(WIDTH, HIDDEN), "c": f(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "u": f(HIDDEN, TABLES), "z": np.zeros(TABLES)}
        return cls({k: np.ascontiguousarray(v, np.float32) for k, v in p.items()}, Tables.smoothed(soft))

    @classmethod
    def begun(cls, x: np.ndarray, y: np.ndarray) -> tuple[Attention, Soft]:
        """A network trained on these windows, and its soft counts. Its tables begin alike but for noise, which the network makes into differences."""
        soft = Soft.of(pairs(x, y)[y.ravel() >= 0], np.full((int((y >= 0).sum()), TABLES), 1 / TABLES, np.float32))
        soft.sums *= np.exp(0.7 * np.random.default_rng(1).standard_normal(soft.sums.shape, np.float32))
        net = cls.new(soft)
        return net, net.train(x, y)

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Inputs, keys, values, scored inputs, queries, attention, what it brings, and the hidden layer; all places are rows of one matrix where they can be."""
        p, n = self.p, len(x)
        e = np.take(p["e"], x, 0) + p["pos"]
        own = np.ascontiguousarray(e[:, WINDOW - SCORED :])
        flat, last = e.reshape(-1, WIDTH), own.reshape(-1, WIDTH)
        k, v = (flat @ p[w] for w in "kv")
        q = last @ (p["q"] * np.float32(WIDTH**-0.5))
        s = q.reshape(n, SCORED, WIDTH) @ k.reshape(n, WINDOW, WIDTH).transpose(0, 2, 1)
        _attention(s, x)
        s /= (s.reshape(-1, WINDOW) @ np.ones(WINDOW, s.dtype)).reshape(n, SCORED, 1)
        c = (s @ v.reshape(n, WINDOW, WIDTH)).reshape(-1, WIDTH)
        h = last @ p["w"]
        h += c @ p["c"]
        h += p["b"]
        return flat, k, v, last, q, s, c, np.maximum(h, 0, out=h)

    def log_probs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probability of each target, 0 for padding."""
        return Scorer(self).log_probs(x, y)

    def shares(self, h: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mix, and each table's share in the probability of the target."""
        mix = h @ self.p["u"]
        mix += self.p["z"]
        mix, one = _exps(mix), np.ones(TABLES, mix.dtype)
        mix /= (mix @ one)[:, None]
        joint = mix * self.tables.of(pairs(x, y))
        joint /= (joint @ one)[:, None]
        return mix, joint

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Each table's share in each target, and the gradients of the mean negative log probability."""
        p, lead, n = self.p, WINDOW - SCORED, len(x)
        e, k, v, own, q, s, c, h = self.hidden(x)
        mix, share = self.shares(h, x, y)
        real = y.ravel() >= 0
        d = (mix - share) * (real / np.maximum(1, real.sum())).astype(h.dtype)[:, None]
        one = np.ones(len(d), d.dtype)
        g = {"u": h.T @ d, "z": one @ d}
        dz = d @ p["u"].T
        dz *= h > 0
        g["b"], g["w"], g["c"] = one @ dz, own.T @ dz, c.T @ dz
        dc = dz @ p["c"].T
        inner = (dc * c) @ np.ones(WIDTH, dc.dtype)  # of each row of attention with its gradients
        by_window = lambda a: a.reshape(n, -1, WIDTH)
        ds = by_window(dc) @ by_window(v).transpose(0, 2, 1)
        dv = (s.transpose(0, 2, 1) @ by_window(dc)).reshape(-1, WIDTH)
        ds -= inner.reshape(n, SCORED, 1)
        ds *= s
        dq, dk = (ds @ by_window(k)).reshape(-1, WIDTH) * np.float32(WIDTH**-0.5), (ds.transpose(0, 2, 1) @ by_window(q)).reshape(-1, WIDTH)
        g["q"], g["k"], g["v"] = own.T @ dq, e.T @ dk, e.T @ dv
        de = dk @ p["k"].T
        de += dv @ p["v"].T
        by_window(de)[:, lead:] += by_window(dz @ p["w"].T + dq @ p["q"].T)
        g["pos"] = (np.ones(n, de.dtype) @ de.reshape(n, -1)).reshape(WINDOW, WIDTH)
        at = x.reshape(-1, 1).astype(np.int64) * WIDTH + np.arange(WIDTH)
        g["e"] = np.bincount(at.ravel(), de.ravel(), (VOCAB + 1) * WIDTH).astype(h.dtype).reshape(-1, WIDTH)
        return share if real.all() else share[real], g

    def train(self, x: np.ndarray, y: np.ndarray, passes: int = PASSES, rate: float = 0.01, seed: int = 5) -> Soft:
        """Steps over shuffled windows, the rate falling to nothing; few windows are passed over more often. Tables are renewed from the shares of the windows
        since the last time and, less and less, before. Returns the soft counts."""
        r, counts = np.random.default_rng(seed), SoftCounts()
        steps = -(-len(x) // SIZE)
        passes = max(passes, -(-STEPS // max(1, steps)))
        adam, steps, renew = Adam(self), max(1, passes * steps), 50
        for _ in range(passes):
            order = r.permutation(len(x))
            for a in range(0, len(x), SIZE):
                at = order[a : a + SIZE]
                counts.add(x[at], y[at], adam.step(x[at], y[at], rate * (1 - adam.done / steps)))
                if adam.done >= renew:
                    self.tables, renew = Tables.smoothed(counts.sums()), renew * 1.5
                    counts.total.sums *= np.float32(0.5)
        self.tables = Tables.smoothed(counts.sums())
        return counts.total


class SoftCounts:
    """Soft counts that grow: new shares are held back until there are many."""

    def __init__(self) -> None:
        self.total, self.held, self.size = Soft.none(), [], 0

    def add(self, x: np.ndarray, y: np.ndarray, share: np.ndarray) -> None:
        self.held.append((pairs(x, y)[y.ravel() >= 0], share))
        self.size += len(share)
        if self.size > 300_000:
            self.sums()

    def sums(self) -> Soft:
        if self.held:
            pair, share = zip(*self.held, strict=True)
            by_table, at = np.empty((TABLES, self.size), share[0].dtype), 0  # each table's shares in one piece
            for part in share:
                by_table[:, at : at + len(part)] = part.T
                at += len(part)
            self.total = self.total.plus(Soft.of(np.concatenate(pair), by_table.T))
            self.held, self.size = [], 0
        return self.total


class Adam:
    """Steps of a network's weights; the first 50 are shorter."""

    def __init__(self, net: Attention) -> None:
        self.net, self.done = net, 0
        self.m, self.v = ({n: np.zeros_like(w) for n, w in net.p.items()} for _ in range(2))

    def step(self, x: np.ndarray, y: np.ndarray, rate: float) -> np.ndarray:
        """Each table's share in each target before the step."""
        self.done += 1
        share, g = self.net.gradients(x, y)
        lr, m, v = rate * min(1, self.done / 50), self.m, self.v
        for n, w in self.net.p.items():
            m[n] += 0.1 * (g[n] - m[n])
            v[n] += 0.01 * (g[n] * g[n] - v[n])
            w -= np.float32(lr) * (m[n] / (1 - 0.9**self.done)) / (np.sqrt(v[n] / (1 - 0.99**self.done)) + 1e-8)
        return share


class Scorer:
    """The network as tables: what depends on one subword and place alone is looked up, and only the attention is computed."""

    def __init__(self, net: Attention) -> None:
        p, lead, n = net.p, WINDOW - SCORED, VOCAB + 1
        kind, scale = p["e"].dtype, WIDTH**-0.5
        self.tables = net.tables
        self.key, self.key_pos = p["e"] @ p["k"], p["pos"] @ p["k"]
        self.value, self.value_pos = p["e"] @ p["v"], p["pos"] @ p["v"]
        self.query, self.query_pos = p["e"] @ p["q"] * scale, p["pos"][lead:] @ p["q"] * scale
        self.own, self.own_pos = p["e"] @ p["w"] + p["b"], p["pos"][lead:] @ p["w"]
        self.through, self.mix = p["c"], p["u"]
        # The mix's offsets are factors of its exponentials, so they are sums' weights.
        self.weight = np.exp(p["z"] - p["z"].max())
        # Numpy takes whole arrays several times faster than one number or a short row for each row.
        self.weights, self.none, self.ones = np.tile(self.weight, (ROWS * SCORED, 1)), np.zeros((ROWS * SCORED, HIDDEN), kind), np.ones(WINDOW, kind)
        # Room for ROWS windows is used again and again: new pages for each step would cost as much as the work.
        shapes = {"k": (WINDOW, WIDTH), "v": (WINDOW, WIDTH), "q": (SCORED, WIDTH), "s": (SCORED, WINDOW), "c": (SCORED, WIDTH), "h": (SCORED, HIDDEN), "m": (SCORED, HIDDEN), "l": (SCORED, TABLES), "t": (SCORED, TABLES)}
        self.room = {n: np.empty((ROWS, *shape), kind) for n, shape in shapes.items()}

    def log_probs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probability of each target, 0 for padding."""
        out = np.zeros(y.shape)
        for a in range(0, len(x), ROWS):
            joint, mix = self._joint(x[a : a + ROWS].astype(np.int64), y[a : a + ROWS])
            out[a : a + ROWS] = np.log((joint @ self.weight) / (mix @ self.weight)).reshape(-1, SCORED)
        out[y < 0] = 0
        return out

    def shares(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Each table's share in each target that is not padding."""
        real, at = y.ravel() >= 0, 0
        out = np.empty((TABLES, np.count_nonzero(real)), self.key.dtype)  # as they are summed
        for a in range(0, len(x), ROWS):
            joint, _ = self._joint(x[a : a + ROWS].astype(np.int64), y[a : a + ROWS])
            if not (own := real[a * SCORED : a * SCORED + len(joint)]).all():
                joint = joint[own]
            joint *= self.weights[: len(joint)]
            joint /= (joint @ self.ones[:TABLES])[:, None]
            out[:, at : at + len(joint)] = joint.T
            at += len(joint)
        return out.T

    def _joint(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mix (without its offsets, and not yet divided by its sum) times the tables' probabilities of the targets, and the mix."""
        own = np.ascontiguousarray(x[:, WINDOW - SCORED :])
        k, v, q, s, c, h, m, mix, t = (self.room[n][: len(x)] for n in "kvqschmlt")
        for table, at, place, out in ((self.key, x, self.key_pos, k), (self.value, x, self.value_pos, v), (self.query, own, self.query_pos, q), (self.own, own, self.own_pos, h)):
            np.take(table, at, 0, out=out, mode="clip")
            out += place
        np.matmul(q, k.transpose(0, 2, 1), out=s)
        _attention(s, x)
        np.matmul(s, v, out=c)
        c, h, m, mix, t = c.reshape(-1, WIDTH), h.reshape(-1, HIDDEN), m.reshape(-1, HIDDEN), mix.reshape(-1, TABLES), t.reshape(-1, TABLES)
        c /= (s.reshape(-1, WINDOW) @ self.ones)[:, None]
        np.matmul(c, self.through, out=m)
        h += m
        np.maximum(h, self.none[: len(h)], out=h)
        np.matmul(h, self.mix, out=mix)
        _exps(mix)
        self.tables.of(pairs(x, y), t)
        t *= mix
        return t, mix


def _exps(mix: np.ndarray) -> np.ndarray:
    """Exponentials in place, up to a factor of each row. The rows' maxima cost as much as all else here, so they are taken off only where it is needed."""
    if len(mix) and mix.max() > 60:
        mix -= mix.max(1, keepdims=True)
    elif len(mix) and mix.min() < -60:
        kept = mix.copy()
        np.exp(mix, out=mix)
        low = np.flatnonzero(mix @ np.ones(mix.shape[1], mix.dtype) < 1e-20)
        mix[low] = np.exp(kept[low] - kept[low].max(1, keepdims=True))
        return mix
    return np.exp(mix, out=mix)


def _attention(s: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exponentials of queries times keys in place, none for what comes later or is padding."""
    if s.size and s.max() > 60:
        np.minimum(s, 60, out=s)
    np.exp(s, out=s)
    s *= _CAUSAL
    if len(padded := np.flatnonzero((x == VOCAB).any(1))):
        s[padded] *= (x[padded] != VOCAB)[:, None]
    return s


_CAUSAL = (np.arange(WINDOW) <= np.arange(SCORED)[:, None] + WINDOW - SCORED).astype(np.float32)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts, each text's end being a word; counted within tasks before the shuffle."""

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0

        def out() -> pa.RecordBatch:
            t = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).combine_chunks()
            return pa.RecordBatch.from_arrays([t["word"].combine_chunks().cast(pa.binary()), t["n_sum"].combine_chunks()], names=["word", "n"])

        for (texts,) in gathered(it, 0, GATHERED):
            words, codes, _ = split_words(texts)
            ends += len(texts)
            n = np.bincount(codes, minlength=len(words))
            met = pa.array(np.flatnonzero(n))
            held.append(pa.table({"word": words.take(met), "n": pa.array(n).take(met)}))
            size += len(met)
            pa.default_memory_pool().release_unused()
            if size > 1_000_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()
        pa.default_memory_pool().release_unused()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["word", "n"])

    return batches(docs.select(F.col("text").alias("_text")), step, "word binary, n long", 500).groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    tokenizer: str
    vocab: tuple[int, ...]
    common: pa.Array
    counts: np.ndarray
    ends: int
    total: int
    distinct: int
    net: Attention | None = None


def encoded(docs: DataFrame, model: Model, keep: dict[str, Column] | None = None) -> DataFrame:
    """Each text, written: _row, doc_id, h (a hash of doc_id below a million), the columns in ``keep``, ids (two bytes each), n_tokens, known and part (base score) of the common
    words, rare (the other words)."""
    kind, keep, z = dict(docs.dtypes)["doc_id"], keep or {}, model.total + 0.5 * (model.distinct + 1)
    names = ["_row", "doc_id", "h", *keep, "ids", "n_tokens", "known", "part", "rare"]
    # Its parts are all of bounded size.
    shared = docs.sparkSession.sparkContext.broadcast((model.tokenizer, model.vocab, model.common, model.counts, model.ends))

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, vocab, common, times, ends = shared.value
        sub = subwords(tokenizer, vocab)
        sub.keep(common)
        for *rest, texts in gathered(it, -1, GATHERED):
            ids, sizes, (words, codes, count, place) = sub.of_texts(texts)
            c = np.where(place >= 0, times[place], 0) if len(times) else np.zeros(len(words), np.int64)
            hit = c[codes] > 0
            hits = sums(hit.astype(np.int64), count)
            part = sums(np.where(c > 0, np.log10((c + 0.5) / z), 0.0)[codes], count) + np.log10((ends + 0.5) / z)
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count - hits)]), pa.int32()), words.take(pa.array(codes[~hit])).cast(pa.binary()))
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([*rest, flat_binary(ids, 2 * sizes), pa.array(count + 1), pa.array(hits + (1 if ends else 0)), pa.array(part), rare], names=names)

    h = F.pmod(F.xxhash64(F.lit("lm"), "doc_id"), F.lit(1_000_000))
    own = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", h.alias("h"), *[c.alias(n) for n, c in keep.items()], F.col("text").alias("_text"))
    kinds = dict(own.dtypes)
    kept = "".join(f"`{n}` {kinds[n]}, " for n in keep)
    return written(batches(own, step, f"_row long, doc_id {kind}, h long, {kept}ids binary, n_tokens long, known long, part double, rare array<binary>", 500), "encoded")


def in_round(windows: int, r: int, rounds: int) -> np.ndarray:
    """Which windows of a text a round reads: each is read in one."""
    return np.arange(windows) % rounds == r


def learned_from_all(texts: DataFrame, net: Attention, soft: Soft, rounds: int = ROUNDS, rate: float = RATE) -> Attention:
    """``net`` and its ``soft`` counts after rounds over all ``texts`` (ids).

    In each round every task goes on from the same weights and tables over its own texts. The weights that the tasks end with are averaged, each by its number of
    windows; their counts are summed in the cluster. All pairs of neighbours in all texts are counted in the first round; what share of a pair each table has is
    learned from all windows, each in one of the rounds.
    """
    spark, every = texts.sparkSession, None
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((net.p, soft))

        def learn(it: Iterator[pa.RecordBatch], shared=shared, rate=rate * (1 - r / rounds), r=r) -> Iterator[pa.RecordBatch]:
            p, start = shared.value
            net, soft, n, since, fresh = Attention({k: w.copy() for k, w in p.items()}, Tables.smoothed(start)), SoftCounts(), 0, 0, []
            adam, times = Adam(net), np.zeros(VOCAB * VOCAB, np.int64)
            for (col,) in gathered(it, 0, GATHERED):
                ids, sizes = flat_bytes(col).view("<u2"), pc.binary_length(col).to_numpy().astype(np.int64) // 2
                if not r:
                    after = np.zeros(len(ids) + len(sizes), np.int64)
                    before, first = after.copy(), np.cumsum(sizes + 1) - sizes - 1
                    after[places(first, sizes)], before[places(first + 1, sizes)] = ids, ids
                    times += np.bincount(before * VOCAB + after, minlength=VOCAB * VOCAB)
                x, y = laid_out(ids, sizes, in_round(1 + (sizes.max() + 1) // SCORED, r, rounds))
                graded = np.arange(len(x)) % GRADED == 0
                fresh.append((x[graded], y[graded]))
                scorer, rest = Scorer(net), np.flatnonzero(~graded)
                for a in range(0, len(rest), SHARED):
                    at = rest[a : a + SHARED]
                    soft.add(x[at], y[at], scorer.shares(x[at], y[at]))
                n, since = n + len(x), since + len(x)
                gx, gy = (np.concatenate(part) for part in zip(*fresh, strict=True))
                for a in range(0, len(gx) - SIZE + 1, SIZE):
                    soft.add(gx[a : a + SIZE], gy[a : a + SIZE], adam.step(gx[a : a + SIZE], gy[a : a + SIZE], rate))
                fresh = [(gx[len(gx) // SIZE * SIZE :], gy[len(gx) // SIZE * SIZE :])]
                if since >= RENEWED:
                    net.tables, since = Tables.smoothed(start.plus(soft.sums())), 0
            pa.default_memory_pool().release_unused()
            if fresh and len(fresh[0][0]):
                soft.add(*fresh[0], adam.step(*fresh[0], rate))
            if n:
                flat = np.concatenate([net.p[k].ravel() for k in sorted(net.p)]).astype(np.float64)
                yield _rows("net", n, {0: (flat * n).tobytes()})
                yield _rows("soft", 0, _packed(soft.sums()))
            if times.any():
                yield _rows("pairs", 0, _packed_pairs(np.flatnonzero(times), times[times > 0]))

        parts = written(batches(texts.select("ids"), learn, "kind string, n long, slice int, w binary"), "learned")
        n, flat = parts.filter("kind = 'net'").rdd.map(lambda row: (row["n"], np.frombuffer(row["w"]))).treeAggregate((0, None), _added, _added)
        if n:
            # Sums within 64 parts of the tasks first, then of these: no group holds a row of every task.
            sums = parts.filter("kind <> 'net'").select("kind", "slice", "w", F.pmod(F.xxhash64("w"), F.lit(64)).alias("part"))
            schema = "kind string, slice int, w binary"
            got = sums.groupBy("kind", "slice", "part").applyInPandas(_sum_rows, schema).groupBy("kind", "slice").applyInPandas(_sum_rows, schema).collect()
            soft = soft.plus(_unpacked([bytes(row["w"]) for row in got if row["kind"] == "soft"]), 0.5 if r else 0.1)
            if found := [_unpacked_pairs(bytes(row["w"])) for row in got if row["kind"] == "pairs"]:
                every = _counted(*(np.concatenate(x) for x in zip(*found, strict=True)))
        if every is not None:
            net = Attention(_parts(flat / n, net.p) if n else net.p, Tables.smoothed(soft.spread(*every)))
        dropped(parts)
        shared.unpersist()
    return net


def _counted(pair: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, in order, with its sum."""
    pair, at = np.unique(pair, return_inverse=True)
    return pair, np.bincount(at, count, len(pair)).astype(np.int64)


def _rows(kind: str, n: int, by_slice: dict[int, bytes]) -> pa.RecordBatch:
    k = len(by_slice)
    return pa.RecordBatch.from_arrays([pa.array([kind] * k), pa.array([n] * k, pa.int64()), pa.array(list(by_slice), pa.int32()), pa.array(list(by_slice.values()), pa.binary())], names=["kind", "n", "slice", "w"])


def _parts(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A network's weights from all of them in a row, by name."""
    ends = np.cumsum([like[k].size for k in sorted(like)])[:-1]
    return {k: w.astype(np.float32).reshape(like[k].shape) for k, w in zip(sorted(like), np.split(flat, ends), strict=True)}


def _packed(soft: Soft) -> dict[int, bytes]:
    """By slice of the first subwords: pairs (four bytes each), then their soft counts, rounded to the upper half of a single."""
    bits = ((np.ascontiguousarray(soft.sums).view(np.uint32) + np.uint32(0x8000)) >> np.uint32(16)).astype("<u2")
    own = soft.pair // VOCAB % SLICES
    return {i: soft.pair[own == i].astype("<u4").tobytes() + bits[own == i].tobytes() for i in np.unique(own).tolist()}


def _unpacked(packed: list[bytes]) -> Soft:
    pair, sums = [np.zeros(0, np.int64)], [np.zeros((0, TABLES), np.float32)]
    for w in packed:
        n = len(w) // (2 * TABLES + 4)
        pair.append(np.frombuffer(w, "<u4", n).astype(np.int64))
        sums.append((np.frombuffer(w, "<u2", offset=4 * n).astype(np.uint32) << np.uint32(16)).view(np.float32).reshape(n, TABLES))
    return Soft.of(np.concatenate(pair), np.concatenate(sums))


def _packed_pairs(pair: np.ndarray, count: np.ndarray) -> dict[int, bytes]:
    own = pair // VOCAB % SLICES
    return {i: pair[own == i].astype("<i8").tobytes() + count[own == i].astype("<i8").tobytes() for i in np.unique(own).tolist()}


def _unpacked_pairs(w: bytes) -> tuple[np.ndarray, np.ndarray]:
    pair, count = np.split(np.frombuffer(w, "<i8"), 2)
    return pair, count


def _sum_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    kind, i = pdf["kind"].iloc[0], int(pdf["slice"].iloc[0])
    if kind == "soft":
        w = _packed(_unpacked(list(pdf["w"])))[i]
    else:
        w = _packed_pairs(*_counted(*(np.concatenate(x) for x in zip(*map(_unpacked_pairs, pdf["w"]), strict=True))))[i]
    return pd.DataFrame({"kind": [kind], "slice": [i], "w": [w]})


def _added(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], b[1] if a[1] is None else a[1] if b[1] is None else a[1] + b[1]


def vocabulary(counts: DataFrame, tokenizer: str | None = None) -> Model:
    """The model's vocabulary and common words, by the word counts of all texts; its network is still to be learned."""
    tokenizer = tokenizer or default_tokenizer()
    total, distinct, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("n"))), F.lit(0))).first()
    words = counts.filter(F.col("word") != F.lit(END))
    common = words.filter(F.octet_length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(COMMON).toArrow()

    def pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = subwords(tokenizer, ())
        held = np.zeros(len(own.size), np.int64)
        for words, n in gathered(it, 0, GATHERED // 4):
            raw, size = own.raw_all(words)
            held += np.bincount(raw, np.repeat(n.to_numpy(), size), len(held)).astype(np.int64)
        met = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(held[met])], names=["id", "n"])

    ids = batches(words, pieces, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(VOCAB - 257).collect()
    vocab = tuple(r["id"] for r in ids)
    return Model(tokenizer, vocab, common.column("word").combine_chunks().cast(pa.string()), common.column("n").to_numpy(), int(ends), int(total), int(distinct))


def learned(texts: DataFrame, model: Model, sample: int = SAMPLE) -> Attention:
    """The network, from ``texts`` (see ``encoded``): weights and tables start from at most WINDOWS windows of ``sample`` texts and then learn from all; see
    ``learned_from_all``. They depend on how the rows are dealt to tasks."""
    near = texts.filter(F.col("h") < max(1, int(1.5e6 * sample / max(model.ends, 1)))).orderBy("h", "ids").limit(sample)

    def begin(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, n = [], 0
        for (col,) in gathered(it, 0, GATHERED):
            got.append(laid_out(flat_bytes(col).view("<u2"), pc.binary_length(col).to_numpy().astype(np.int64) // 2))
            n += len(got[-1][0])
            if n >= WINDOWS:
                break
        if got:
            x, y = (np.concatenate(part)[:WINDOWS] for part in zip(*got, strict=True))
            net, soft = Attention.begun(x, y)
            yield _rows("net", 1, {0: np.concatenate([net.p[k].ravel() for k in sorted(net.p)]).astype(np.float64).tobytes()})
            yield _rows("soft", 0, _packed(soft))

    rows = batches(near.select("ids"), begin, "kind string, n long, slice int, w binary").collect()
    net = Attention.new(Soft.none())
    if rows:
        start = _unpacked([bytes(r["w"]) for r in rows if r["kind"] == "soft"])
        net = Attention(_parts(np.frombuffer(next(r["w"] for r in rows if r["kind"] == "net")), net.p), Tables.smoothed(start))
        net = learned_from_all(texts, net, start)
    return net


def fit(docs: DataFrame, counts: DataFrame, tokenizer: str | None = None, sample: int = SAMPLE) -> Model:
    """The model of ``docs``, whose word counts are ``counts``."""
    model = vocabulary(counts, tokenizer)
    texts = encoded(docs, model)
    model.net = learned(texts, model, sample)
    dropped(texts)
    return model


_ONE = np.ones(1, np.int64)


def word_log_probs(docs: list[list[bytes]], sub: Subwords, net: Attention | Scorer) -> list[np.ndarray]:
    """Natural log probability of each word and the end of each text: the sum over its subwords, each scored once."""
    ids, sizes = zip(*(sub(w) for w in docs), strict=True)
    x, y = windows(ids)
    lp = net.log_probs(x, y)[y >= 0]
    every = np.concatenate([x for s in sizes for x in (s, _ONE)])
    return np.split(np.add.reduceat(lp, np.cumsum(every) - every), np.cumsum([len(s) + 1 for s in sizes])[:-1])


def score(docs: DataFrame, model: Model, counts: DataFrame, keep: dict[str, Column] | None = None) -> DataFrame:
    """``scored`` of texts that aren't encoded yet, with the columns in ``keep``."""
    return scored(encoded(docs, model, keep), model, counts, tuple(keep or {}))


def scored(texts: DataFrame, model: Model, counts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, and the columns in ``keep``, for every row of ``texts`` (see ``encoded``).

    score: log10 probability of the lower-case words and the end under the attention model, the sum over all subwords. base_score: under counts
    of words, the sum over tokens of log10((c + 0.5) / (N + 0.5 (V + 1))). Common words' counts are at hand in each task; the
    others are joined to the table of counts by word, so its size does not matter.

    A null text is an empty one: its end alone is scored. Repeated rows agree (to single precision); an empty table gives an empty result; without
    training texts all weights are initial and N = V = 0. Further columns are ignored unless kept.
    """
    kinds, z = dict(texts.dtypes), model.total + 0.5 * (model.distinct + 1)
    shared = texts.sparkSession.sparkContext.broadcast(model.net)

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Scorer(shared.value)
        for *rest, col in gathered(it, -1, GATHERED):
            ids, sizes = flat_bytes(col).view("<u2"), pc.binary_length(col).to_numpy().astype(np.int64) // 2
            lp, at, upto = np.zeros(len(sizes)), 0, np.cumsum(sizes)
            while at < len(sizes):  # at most some 200 000 subwords at a time, or one longer text
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 200_000)))
                x, y = laid_out(ids[upto[at] - sizes[at] : upto[to - 1]], sizes[at:to])
                lp[at:to] = sums(net.log_probs(x, y).sum(1), -(-(sizes[at:to] + 1) // SCORED))
                at = to
            yield pa.RecordBatch.from_arrays([*rest, pa.array(lp / np.log(10))], names=[*own, "score"])

    own = ["_row", "doc_id", *keep, "n_tokens", "known", "part"]
    done = batches(texts.select(*own, "ids"), step, "".join(f"`{c}` {kinds[c]}, " for c in own) + "score double", 500)
    rest = texts.select("_row", F.explode("rare").alias("word")).join(counts, "word", "left")
    p = (F.coalesce("n", F.lit(0)) + 0.5) / F.lit(float(z))
    rest = rest.groupBy("_row").agg(F.count("n").alias("more"), F.sum(F.log10(p)).alias("others"))
    out, zero = done.join(rest, "_row", "left"), F.lit(0.0)
    return out.select("doc_id", *keep, "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(model.total)).cast("long").alias("train_tokens"), (F.col("part") + F.coalesce("others", zero)).alias("base_score"), "score")
