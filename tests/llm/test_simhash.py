import random
import re

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from aqengine.llm import simhash

from .conftest import ODD, frame, words


def fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [fp(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted((r[0] is not None, r[0] or 0, f"{fps[i]:016x}", least.get(root(i))) for i, r in enumerate(rows))


def got(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.fingerprint, r.component_id) for r in df.collect())


def test_against_brute_force(spark):
    r = random.Random(0)
    rows = []
    for i in range(300):
        w = words(i % 40, 300).split()
        for _ in range(i % 4):
            w[r.randrange(300)] = f"z{r.randrange(9)}"
        rows.append((1000 - i, " ".join(w), "en", "s", 0, 0.0, 0, 0, 0, 0, ""))
    want = brute(rows)
    assert got(simhash.near_duplicates(frame(spark, rows))) == want
    assert 40 < len({w[3] for w in want}) < 300


def test_odd_rows(odd, none):
    assert got(simhash.near_duplicates(odd)) == brute(ODD)
    assert simhash.near_duplicates(none).collect() == []


def test_one_of_each(spark, odd, none):
    kept = [r.doc_id for r in simhash.one_of_each(odd).collect()]
    want = {c for _, _, _, c in brute(ODD)} - {None}
    assert sorted(i for i in kept if i is not None) == sorted(want) and None in kept
    assert simhash.one_of_each(odd).columns == odd.columns and simhash.one_of_each(none).count() == 0


def groups(pairs, values):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        parent[root(a)] = root(b)
    return {v: min(u for u in values if root(u) == root(v)) for v in values}


def pairs_of(values):
    return [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**12 - 1), max_size=60, unique=True), st.integers(0, 30))
def test_trees_join_what_all_pairs_join(values, cut):
    assert groups(simhash.links(values, 3), values) == groups(pairs_of(values), values)
    a, b = values[:cut], values[cut:]
    across = [(x, y) for x, y in pairs_of(values) if (x in a) != (y in a)]
    assert groups(simhash.links(a, 3, b), values) == groups(across, values)
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    assert all(sorted(tree.value[i] for i in tree.within(v, 3)) == sorted(u for u in values if (u ^ v).bit_count() <= 3) for v in values)


def test_large_shards_are_split_without_losing_links(spark):
    r = random.Random(1)
    base = r.getrandbits(64)
    values = {base}
    for _ in range(400):  # one dense group in which all shards are large
        v = r.choice(sorted(values))
        for _ in range(r.randrange(1, 3)):
            v ^= 1 << r.randrange(64)
        values.add(v)
    values |= {r.getrandbits(64) for _ in range(200)}
    signed = lambda x: x - (x >> 63 << 64)
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    for tree in (4, 40):
        found = [(p.a % 2**64, p.b % 2**64) for p in simhash.near_pairs(fps, tree=tree).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in found)
        assert groups(found, sorted(values)) == groups(pairs_of(sorted(values)), sorted(values))


def test_one_of_each_keeps_unlike_rows_of_one_doc_id(spark):
    one, other = words(1, 60), words(2, 60)
    rows = [(5, one, 1, 1, "a", 0), (5, other, 2, 2, "b", 0), (5, other, 3, 3, "b", 0), (7, one, 4, 4, "c", 0), (None, one, 5, 5, "d", 0), (None, words(3, 60), 6, 6, "e", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, fp long, doc string, _kept int")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.doc) for r in got.collect()) == [(0, "e"), (5, "a"), (5, "b")]


class Counted(list):
    """A list that counts how often its elements are read."""

    reads = 0

    def __getitem__(self, i):
        self.reads += 1
        return super().__getitem__(i)


def test_searches_of_a_shard_leave_most_of_its_tree_out():
    r = random.Random(2)
    block, tree = r.getrandbits(16), simhash.BKTree()
    tree.value = Counted()
    values = [r.getrandbits(48) << 16 | block for _ in range(2000)]
    for v in values:
        tree.add(v)
    tree.value.reads = 0
    for v in values[:200]:
        assert tree.value.index(v) in tree.within(v ^ 0x7 << 40, 3)
    assert tree.value.reads < 200 * 2000 / 3
