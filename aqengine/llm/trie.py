"""Operator 11: the prefix trie of conversations, as balanced parentheses cut into shards.

Conversations become turns with fingerprints of all that comes before them, turns with equal fingerprints become nodes, and nodes are put
into preorder. A slice of that order is a shard: its parentheses, an opening one for each node, are searched for their closing ones by a
tree over the least excess of blocks. What a shard leaves open is closed in a later one; both ends meet by depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, written

#: Turns of a conversation that are numbered together (2**10 values of ``turn``), and conversation ids whose hash input is joined at once.
CHUNK_BITS, IDS_BITS = 10, 12
#: Nodes of a shard, about; and bits of a block.
SHARD, BLOCK = 200_000, 64
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
FOUND = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, i (from 1), role, digest, bytes of each turn, in the order of turn (null first), role and digest of the text."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    t = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.md5(text).alias("digest"), F.length(text).cast("long").alias("bytes")
    )
    t = t.withColumn("q", F.coalesce(F.shiftright("turn", CHUNK_BITS), F.lit(-(1 << 60))))
    sizes = t.groupBy("conv_id", "q").agg(F.count("*").alias("n"))
    before = sizes.select("conv_id", "q", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("q")) - F.col("n")).alias("before"))
    within = Window.partitionBy("conv_id", "q").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    return t.withColumn("i", F.row_number().over(within)).join(before, ["conv_id", "q"]).select("conv_id", (F.col("i") + F.col("before")).alias("i"), "role", "digest", "bytes")


def plain_plan(turns: DataFrame) -> DataFrame:
    """conv_id, head, skip, size of each conversation as it stands: nothing is taken from another."""
    return turns.groupBy("conv_id").agg(F.max("i").alias("size")).select("conv_id", F.col("conv_id").alias("head"), F.lit(0).cast("long").alias("skip"), F.lit(0).cast("long").alias("taken"), "size")


def rebuilt_plan(turns: DataFrame) -> DataFrame:
    """conv_id, head, skip, taken, size: each conversation begins with the first ``skip`` turns of ``head`` (``taken``: how many there are)
    and goes on with its own turns after its first ``skip``."""
    n = turns.groupBy("conv_id").agg(F.max("i").alias("n"))
    c = n.withColumn("skip", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).withColumn("head", F.col("conv_id") - F.col("conv_id") % 5)
    heads = n.select(F.col("conv_id").alias("head"), F.col("n").alias("of_head"))
    taken = F.least("skip", F.coalesce("of_head", F.lit(0)))
    return c.join(heads, "head", "left").select("conv_id", "head", "skip", taken.cast("long").alias("taken"), (taken + F.greatest(F.col("n") - F.col("skip"), F.lit(0))).cast("long").alias("size"))


def rebuilt_turns(turns: DataFrame, plan: DataFrame) -> DataFrame:
    """conv_id, d (from 1), role, digest, bytes, last of each turn of the planned conversations."""
    most = plan.agg(F.max("skip")).first()[0] or 0
    own = turns.join(plan, "conv_id").filter("i > skip").withColumn("d", F.col("i") - F.col("skip") + F.col("taken"))
    first = turns.filter(F.col("i") <= most).withColumnRenamed("conv_id", "head").join(plan, "head").filter("i <= taken").withColumn("d", F.col("i"))
    cols = ["conv_id", "d", "role", "digest", "bytes", (F.col("d") == F.col("size")).alias("last")]
    return own.select(*cols).unionByName(first.select(*cols))


def with_prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` with a, b: 128 bits that stand for the sequence of all turns up to each. Each half is the exclusive or of a hash of place, role and text over
    the turns so far, taken by chunks, so no window holds a long conversation."""
    half = lambda salt: F.xxhash64(F.lit(salt), "d", "role", "digest")
    t = turns.select("conv_id", "d", "bytes", "last", half("a").alias("ha"), half("b").alias("hb"), F.shiftright("d", CHUNK_BITS).alias("q"))
    sums = t.groupBy("conv_id", "q").agg(F.bit_xor("ha").alias("ca"), F.bit_xor("hb").alias("cb"))
    upto = Window.partitionBy("conv_id").orderBy("q")
    sums = sums.select("conv_id", "q", *[F.bit_xor(c).over(upto).bitwiseXOR(F.col(c)).alias(c) for c in ("ca", "cb")])
    within = Window.partitionBy("conv_id", "q").orderBy("d")
    t = t.select("*", F.bit_xor("ha").over(within).alias("xa"), F.bit_xor("hb").over(within).alias("xb")).join(sums, ["conv_id", "q"])
    return t.select("conv_id", "d", "bytes", "last", F.col("xa").bitwiseXOR(F.col("ca")).alias("a"), F.col("xb").bitwiseXOR(F.col("cb")).alias("b"))


def closing(excess: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """For each opening parenthesis (a place in ``excess``, the balance after each) the place of its closing one, or -1 if it stays open.

    The rest of its block first; then up a binary tree of least balances until a right neighbour falls below, down to a block, and along it.
    """
    n = -(-max(len(excess), 1) // BLOCK) * BLOCK
    padded = np.full(n, np.iinfo(np.int64).max)
    padded[: len(excess)] = excess
    rows = padded.reshape(-1, BLOCK)
    levels = [rows.min(1)]
    while len(levels[-1]) > 1:
        low = levels[-1]
        low = np.append(low, np.iinfo(np.int64).max) if len(low) % 2 else low
        levels[-1] = low
        levels.append(low.reshape(-1, 2).min(1))
    below, out = excess[opens], np.full(len(opens), -1, np.int64)
    open_ = np.arange(len(opens))
    for step in range(1, BLOCK):
        at = opens[open_] + step
        inside = at // BLOCK == opens[open_] // BLOCK
        open_, at = open_[inside], at[inside]
        if not len(open_):
            break
        hit = padded[at] < below[open_]
        out[open_[hit]] = at[hit]
        open_ = open_[~hit]
    todo = np.flatnonzero(out < 0)
    node, block = opens[todo] // BLOCK, np.full(len(todo), -1, np.int64)
    for k in range(len(levels) - 1):
        go = np.flatnonzero(block < 0)
        if not len(go):
            break
        x = node[go]
        right = (x % 2 == 0) & (levels[k][np.minimum(x + 1, len(levels[k]) - 1)] < below[todo[go]])
        down, target = x[right] + 1, below[todo[go[right]]]
        for lower in range(k - 1, -1, -1):
            left = 2 * down
            down = np.where(levels[lower][left] < target, left, left + 1)
        block[go[right]] = down
        node[go] = np.where(right, x, x // 2)
    for lo in range(0, len(todo), 100_000):
        part = slice(lo, lo + 100_000)
        own, b = todo[part], block[part]
        own, b = own[b >= 0], b[b >= 0]
        out[own] = b * BLOCK + (rows[b] < below[own, None]).argmax(1)
    return out


def shard_sums(depth: np.ndarray, leaf: np.ndarray, weight: np.ndarray, before: int) -> dict[str, np.ndarray | tuple[int, int]]:
    """A shard's nodes in preorder, and what is still open before it (``before``: how many nodes).

    Gives for each node whether it closes here, and the leaves and weights from it to its end (or, if it stays open, those before it); the depths that close
    here though they were opened before, with leaves and weights until then; and the shard's totals.
    """
    n = len(depth)
    closes = np.concatenate([[before], depth[:-1] + 1]) - depth
    opens = np.arange(n) + np.cumsum(closes)
    size = int(opens[-1] + 1 + leaf[-1])  # a leaf's own closing parenthesis follows it at once
    bits = np.full(size, -1, np.int64)
    bits[opens] = 1
    excess = before + np.cumsum(bits)
    pairs = np.zeros(size, np.int64)
    pairs[:-1] = (bits[:-1] == 1) & (bits[1:] == -1)
    leaves = np.concatenate([[0], np.cumsum(pairs)])
    nodes, weights = np.concatenate([[0], np.cumsum(bits == 1)]), np.concatenate([[0], np.cumsum(weight)])
    end = closing(excess, opens)
    shut = end >= 0
    n_leaves, saved = leaves[opens].copy(), weights[nodes[opens]].copy()
    n_leaves[shut] = leaves[end[shut]] - n_leaves[shut]
    saved[shut] = weights[nodes[end[shut]]] - saved[shut]
    low = np.minimum.accumulate(np.concatenate([[before], excess]))
    ends = np.flatnonzero(low[1:] < low[:-1])
    return {"shut": shut, "leaves": n_leaves, "saved": saved, "depths": excess[ends], "end_leaves": leaves[ends], "end_saved": weights[nodes[ends]], "totals": (int(leaves[-1]), int(weights[-1]))}


def _encode(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by([("rank", "ascending"), ("depth", "ascending")])
    col = lambda c: table[c].to_numpy().astype(np.int64)
    got = shard_sums(col("depth"), (col("n_children") == 0).astype(np.int64), col("weight"), int(table["before"][0].as_py()))
    n, m = table.num_rows, len(got["depths"])
    nulls = pa.nulls(m + 1, pa.int64())
    tail = lambda c: pa.concat_arrays([table[c].combine_chunks(), nulls])
    kind = np.concatenate([np.where(got["shut"], 0, 1), np.full(m, 2), [3]])
    join = lambda own, ends, total: pa.array(np.concatenate([own, ends, [total]]).astype(np.int64))
    return pa.table(
        {
            "kind": pa.array(kind.astype(np.int32)), "shard": pa.array(np.full(n + m + 1, key[0].as_py(), np.int32)), "depth": join(col("depth"), got["depths"], -1),
            "rep": tail("rep"), "up": tail("up"), "n_convs": tail("n_convs"), "n_children": tail("n_children"),
            "leaves": join(got["leaves"], got["end_leaves"], got["totals"][0]), "saved": join(got["saved"], got["end_saved"], got["totals"][1]),
        }
    )


def subtree_sums(nodes: DataFrame, shard: int = SHARD) -> DataFrame:
    """``nodes`` (rank, depth, rep, up, n_convs, n_children, weight; preorder is that of rank and depth) with leaves and saved over each subtree."""
    n = nodes.count()
    cut = nodes.repartitionByRange(max(1, -(-n // shard)), "rank", "depth").sortWithinPartitions("rank", "depth").withColumn("shard", F.spark_partition_id())
    cut = written(cut, "preorder")
    ends = cut.groupBy("shard").agg(F.max_by(F.col("depth") + F.when(F.col("n_children") == 0, 0).otherwise(1), F.struct("rank", "depth")).alias("open"))
    # One row for each shard.
    before = ends.select("shard", F.coalesce(F.lag("open").over(Window.orderBy("shard")), F.lit(0)).alias("before"))
    kinds = "kind int, shard int, depth long, rep long, up long, n_convs long, n_children long, leaves long, saved long"
    found = written(cut.join(before, "shard").groupBy("shard").applyInArrow(_encode, kinds), "shards")
    totals = found.filter("kind = 3")
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select("shard", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{c}_before") for c in ("leaves", "saved")])
    whole = totals.agg(F.sum("leaves").alias("all_leaves"), F.sum("saved").alias("all_saved"))
    spine = found.filter("kind in (1, 2)").join(start, "shard").withColumns({c: F.col(c) + F.col(f"{c}_before") for c in ("leaves", "saved")})
    # Nodes of one depth follow one another, so what one leaves open is closed by the next closing end of its depth; at most two rows of a depth in a shard.
    order = Window.partitionBy("depth").orderBy("shard", F.desc("kind"))
    spine = spine.select("*", *[F.lead(c).over(order).alias(f"{c}_end") for c in ("leaves", "saved")]).filter("kind = 1").crossJoin(whole)
    spine = spine.withColumns({c: F.coalesce(f"{c}_end", f"all_{c}") - F.col(c) for c in ("leaves", "saved")})
    cols = ["rep", "depth", "up", "n_convs", "n_children", "leaves", "saved"]
    return found.filter("kind = 0").select(*cols).unionByName(spine.select(*cols))


def ends_digests(ends: DataFrame) -> DataFrame:
    """rep, depth, ends_sha256 of all conversations (conv_id) that end at a node. Ids are joined by ranges of ids, and the hash goes over sorted ranges, so no
    task holds all the copies of a conversation."""
    q = F.shiftright("conv_id", IDS_BITS)
    pieces = ends.groupBy("rep", "depth", q.alias("q")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    pieces = pieces.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "q").select("rep", "depth", "ids")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, hashlib.sha256()
        for b in it:
            done = []
            for own, ids in zip(zip(b["rep"].to_pylist(), b["depth"].to_pylist(), strict=True), b["ids"].to_pylist(), strict=True):
                if own != key:
                    if key is not None:
                        done.append((*key, h.hexdigest()))
                    key, h = own, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield _three(done)
        if key is not None:
            yield _three([(*key, h.hexdigest())])

    return batches(pieces, run, "rep long, depth long, ends_sha256 string")


def _three(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["rep", "depth", "ends_sha256"])


def prefix_trie(conversations: DataFrame, rebuild: bool = True, shard: int = SHARD) -> DataFrame:
    """One row for each distinct beginning of conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    With ``rebuild`` conversations take the first turns of conversation c - c % 5, as the query's contract says; without, they stay as they are. Turns are ordered by turn
    (null first), equal ones by role and a digest of the text; a null role or text is empty; rows with a null conv_id take no part. Repeated rows are turns of their
    own. An empty table gives no rows, not even a root. Further columns are ignored.
    """
    turns = written(placed_turns(conversations), "turns")
    plan = written((rebuilt_plan if rebuild else plain_plan)(turns), "plan")
    n_convs, root = plan.agg(F.count("*"), F.min("conv_id")).first()
    if not n_convs:
        return conversations.sparkSession.createDataFrame([], FOUND)
    keyed = written(with_prefixes(rebuilt_turns(turns, plan)), "prefixes")
    nodes = keyed.groupBy("a", "b", "d").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("rep"), F.max("bytes").alias("bytes"))
    nodes = written(nodes, "nodes")
    shared = nodes.filter("n_convs > 1").select("a", "b", "d", "rep")
    member = written(keyed.join(shared, ["a", "b", "d"], "left").select("conv_id", F.col("d").alias("depth"), F.coalesce("rep", "conv_id").alias("rep"), "last"), "members")
    # A path's smallest members change where it leaves that of the smaller one. Such a path has at most about the root of twice the number of turns changes: as many other
    # conversations are as long as it is up to there.
    runs = member.groupBy("conv_id", "rep").agg(F.min("depth").alias("start"), F.max("depth").alias("deep"))
    paths = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", "rep"))).alias("path"), F.max_by("deep", "start").alias("deep"))
    own = paths.filter(F.element_at("path", -1)["rep"] == F.col("conv_id"))
    # Of two paths that part, the one that stays longer comes first: then each subtree is one range, and its smallest member leads it.
    own = own.orderBy(F.transform("path", lambda x: F.struct((-x["start"]).alias("s"), x["rep"].alias("r"))))
    up = F.when(F.size("path") > 1, F.try_element_at("path", F.lit(-2))["rep"]).otherwise(F.lit(root))
    chains = written(own.select(F.col("conv_id").alias("rep"), F.monotonically_increasing_id().alias("rank"), F.element_at("path", -1)["start"].alias("start"), up.alias("above"), "deep"), "chains")
    branches = chains.groupBy(F.col("above").alias("rep"), (F.col("start") - 1).alias("depth")).agg(F.count("*").alias("branches"))
    below = nodes.select("rep", F.col("d").alias("depth"), "n_convs", "bytes").join(chains, "rep").join(branches, ["rep", "depth"], "left")
    on = F.when(F.col("depth") < F.col("deep"), 1).otherwise(0)
    cols = ["rank", "depth", "rep", "up", "n_convs", "n_children", "weight"]
    below = below.withColumns({"up": F.when(F.col("depth") == F.col("start"), F.col("above")).otherwise(F.col("rep")), "n_children": F.coalesce("branches", F.lit(0)) + on, "weight": (F.col("n_convs") - 1) * F.col("bytes")})
    first = chains.filter("start = 1").agg(F.count("*").alias("n_children"))
    top = first.select(F.lit(-1).cast("long").alias("rank"), F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("rep"), F.lit(None).cast("long").alias("up"), F.lit(n_convs).cast("long").alias("n_convs"), "n_children", F.lit(0).cast("long").alias("weight"))
    summed = subtree_sums(written(below.select(*cols).unionByName(top.select(*cols)), "nodes"), shard)
    ends = member.filter("last").select("rep", "depth", "conv_id").unionByName(plan.filter("size = 0").select(F.lit(root).cast("long").alias("rep"), F.lit(0).cast("long").alias("depth"), "conv_id"))
    found = summed.join(ends_digests(ends), ["rep", "depth"], "left")
    return found.select(F.col("rep").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
