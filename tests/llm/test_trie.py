import hashlib
import random
import zlib

import numpy as np
import pytest

from aqengine.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, rep string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def brute(rows, rebuild=True):
    """Every node by a plain walk over the rebuilt conversations."""
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        built[c] = [*(turns.get(c - c % 5, [])[:h] if rebuild else []), *own[h:]]
    nodes = {}
    for c, path in sorted(built.items()):
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = set()
    for p, members in nodes.items():
        leaves = saved = 0
        todo = [p]
        while todo:
            x = todo.pop()
            leaves += x not in kids
            saved += (len(nodes[x]) - 1) * len(x[-1][1].encode()) if x else 0
            todo += kids.get(x, [])
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(p))
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def made(seed, n=120, vocabulary=2, longest=7):
    r = random.Random(seed)
    return [(c * r.choice((1, 1, 1, 3)), t, r.choice(("user", None)), f"t{r.randrange(vocabulary)}é") for c in range(n) for t in range(r.randrange(1, longest))]


@pytest.mark.parametrize("shard", [5, 64, 200_000])
def test_equals_a_plain_walk_whatever_the_shards(spark, shard):
    rows = made(1)
    assert set(map(tuple, trie.prefix_trie(frame(spark, rows), True, shard).collect())) == brute(rows)


def test_conversations_as_they_stand(spark):
    rows = made(2, vocabulary=1)
    got = trie.prefix_trie(frame(spark, rows), rebuild=False, shard=3).collect()
    assert set(map(tuple, got)) == brute(rows, rebuild=False) and len(got) == len(brute(rows, rebuild=False))


def test_a_long_conversation_lies_in_many_shards(spark):
    """A third of all turns belong to one conversation, another begins as it does and goes on a little less; a third of the conversations are copies."""
    rows = [(7, i, "user", f"turn {i}") for i in range(3000)] + [(8, i, "user", f"turn {i}") for i in range(2500)] + [(20 + c, i, "user", f"copy {i}") for c in range(600) for i in range(2)] + [(c + 10_000, *r) for c, *r in made(3, 300)]
    got = {(r["conv_id"], r["depth"]): r for r in trie.prefix_trie(frame(spark, rows), rebuild=False, shard=250).collect()}
    size = [len(f"turn {i}") for i in range(3000)]
    assert [got[7, d]["saved_tokens"] for d in (1, 1000, 2500, 2501)] == [sum(size[d - 1 : 2500]) for d in (1, 1000, 2500)] + [0]
    assert all(got[7, d]["n_leaves"] == 1 for d in range(1, 3001)) and got[7, 2500]["ends_sha256"] == hashlib.sha256(b"8").hexdigest()
    copies = got[20, 2]
    assert copies["n_convs"] == 600 and copies["ends_sha256"] == hashlib.sha256(",".join(str(20 + c) for c in range(600)).encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(None, 1, "user", "no conversation"), (1, None, None, None), (1, 3, "user", ""), (1, 3, "user", ""), (2, 0, "user", "x" * 50_000), (2, 0, "user", "a tie"), (-6, 1, "user", "below zero"), (3, 1, None, "only"), (4, 1, None, "only"), (5, -(2**40), "user", "early")]
    assert set(map(tuple, trie.prefix_trie(frame(spark, rows), rebuild=False).collect())) == brute(rows, rebuild=False)
    assert trie.prefix_trie(frame(spark, rows).filter("conv_id is null")).collect() == []
    assert set(map(tuple, trie.prefix_trie(frame(spark, [(11, 1, "a", "b")])).collect())) == brute([(11, 1, "a", "b")])


def test_closing_parentheses():
    r = random.Random(4)
    for n in (1, 3, 64, 200, 3000):
        bits, depth = [], 0
        for _ in range(n):
            step = 1 if depth == 0 or r.random() < 0.55 else -1
            depth += step
            bits.append(step)
        excess = np.cumsum(bits)
        opens = np.flatnonzero(np.array(bits) == 1)
        stack, want = [], {}
        for i, b in enumerate(bits):
            if b == 1:
                stack.append(i)
            else:
                want[stack.pop()] = i
        assert trie.closing(excess, opens).tolist() == [want.get(i, -1) for i in opens.tolist()]
