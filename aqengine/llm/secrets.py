"""Operator 9: secrets and linked credentials. DataFrame expressions only.

Base formats are found in each row by itself. Weak candidates (strings that could be a secret, or an endpoint) count only where a
complementary part stands near: a scope is what lies within SCOPE code points, and an interval join over bins of that width
brings parts together.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Code points within which parts of one credential stand.
SCOPE = 256
#: Lengths that are summed up at a time.
CHUNK = 64

# The base formats; ``hex`` and ``access`` with their least lengths, which here give the same matches.
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"[0-9a-f]{24,}+",
}
#: Start of an assignment up to its value.
HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
# Weak candidates, by the part of a credential that they can be.
WEAK = {
    "key": r"[A-Za-z0-9+/_=-]{40,}+",
    "ident": r"(?i:access_?key(?:_?id)?|client_?id|account_?key|user_?id|login)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9_.@-]{4,}+",
    "endpoint": r"(?i:https?|s3|jdbc:[a-z0-9]{2,16}|mongodb|postgres|redis|amqp|ftp)://[A-Za-z0-9_.:@/?&=%-]{4,}+",
}
#: Of these a key is what is 40 long, in base 64 without padding, and has all three kinds of characters.
KEY = (r"^[A-Za-z0-9+/]{40}$", "[0-9]", "[a-z]", "[A-Z]")
#: A cheap test that some weak candidate's format may match at all.
HINT = r"://|(?i:access_?key|client_?id|account_?key|user_?id|login)|[A-Za-z0-9+/]{40}"
ORDER = ("assign", "access", "hex", "endpoint", "ident", "key")


def _starts(lengths: Column) -> Column:
    """The sum of the lengths before each: within chunks of CHUNK, and of whole chunks, so that no long array is copied for each element."""
    added = lambda first, a: F.aggregate(a, F.array(first), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int")), lambda c: F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK)))
    before = added(F.lit(0), F.transform(chunks, lambda a: F.aggregate(a, F.lit(0), lambda acc, n: acc + n)))
    return F.flatten(F.transform(F.arrays_zip(chunks.alias("a"), before.alias("at")), lambda c: F.when(c["a"].isNull(), F.array().cast("array<int>")).otherwise(F.slice(added(c["at"], c["a"]), F.lit(1), F.size(c["a"])))))


def _matches(text: Column, pattern: str, kind: str) -> Column:
    """Array of (kind, start, end, value) of a pattern's leftmost non-overlapping matches; positions in code points.

    What stands between matches and the matches themselves alternate, so running sums of their lengths place them.
    """
    between = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    got = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.transform(F.arrays_zip(F.slice(between, F.lit(1), F.size(got)).alias("gap"), got.alias("value")), lambda x: F.struct(x["gap"].alias("gap"), F.char_length(x["value"]).alias("n"), x["value"].alias("value")))
    placed = F.zip_with(found, _starts(F.transform(found, lambda x: x["gap"] + x["n"])), lambda x, at: F.struct(F.lit(kind).alias("kind"), (at + x["gap"]).alias("start"), (at + x["gap"] + x["n"]).alias("end"), x["value"].alias("value")))
    return F.when(F.size(got) > 0, placed).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>"))


def _spans(found: Column) -> Column:
    """kind:start:end by start, then kind in ORDER, joined by commas."""
    place = {k: i for i, k in enumerate(ORDER)}
    keyed = F.transform(found, lambda x: F.struct(x["start"].alias("s"), F.create_map(*[F.lit(v) for kv in place.items() for v in kv])[x["kind"]].alias("k"), x["end"].alias("e"), x["kind"].alias("n")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["n"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def candidates(docs: DataFrame) -> DataFrame:
    """_row, doc_id, base and weak: arrays of (kind, start, end) of each row. Values are dropped but for their checks."""
    slim = lambda a: F.transform(a, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", text.alias("text"))
    assign = F.filter(_matches(F.col("text"), BASE["assign"], "assign"), lambda x: F.char_length(F.regexp_replace(x["value"], HEAD, "")) >= 6)
    base = F.concat(slim(assign), slim(_matches(F.col("text"), BASE["access"], "access")), slim(_matches(F.col("text"), BASE["hex"], "hex")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    found = {k: _matches(F.col("text"), p, k) for k, p in WEAK.items()}
    found["key"] = F.filter(found["key"], lambda x: reduce(and_, [x["value"].rlike(p) for p in KEY]))
    weak = F.when(F.col("text").rlike(HINT), F.concat(*map(slim, found.values()))).otherwise(none)
    return own.select(F.monotonically_increasing_id().alias("_row"), "doc_id", base.alias("base"), weak.alias("weak"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(_row, added): weak candidates near which a complementary part stands.

    A key needs an identifier (``access`` or ident) or an endpoint; an ident needs a secret (``assign``, ``hex`` or key); an endpoint needs both
    an identifier and a secret. Parts are gathered for each row, bin and role by their starts, at most ``scope`` of them, so the join
    brings three rows at most to a candidate and role, however many parts a text has.
    """
    asked = found.filter(F.size("weak") > 0)
    role = F.when(F.col("p.kind").isin("access", "ident"), "identifier").when(F.col("p.kind") == "endpoint", "endpoint").otherwise("secret")
    parts = asked.select("_row", F.explode(F.concat("base", "weak")).alias("p")).select("_row", role.alias("role"), F.floor(F.col("p.start") / scope).alias("bin"), F.col("p.start").alias("s"))
    parts = parts.groupBy("_row", "role", "bin").agg(F.collect_set("s").alias("at"))
    weak = asked.select("_row", F.explode("weak").alias("w")).withColumn("bin", F.explode(F.sequence(F.floor(F.col("w.start") / scope) - 1, F.floor(F.col("w.end") / scope) + 1)))
    near = weak.join(parts, ["_row", "bin"]).filter(F.exists("at", lambda s: (s <= F.col("w.end") + scope) & (s >= F.col("w.start") - scope) & ~((s >= F.col("w.start")) & (s < F.col("w.end")))))
    roles = near.groupBy("_row", "w").agg(F.collect_set("role").alias("roles"))
    has = lambda r: F.array_contains("roles", r)
    ok = F.when(F.col("w.kind") == "key", has("identifier") | has("endpoint")).when(F.col("w.kind") == "ident", has("secret")).otherwise(has("identifier") & has("secret"))
    return roles.filter(ok).groupBy("_row").agg(F.collect_list("w").alias("added"))


def secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each document.

    Counts and digest are those of the base formats; spans (kind:start:end in code points, by start, then kind) holds base spans and
    linked weak ones (endpoint, ident, key). A null text is an empty one, without spans. Rows that repeat a doc_id are
    scanned each for itself; an empty table gives an empty result; further columns are ignored.
    """
    found = written(candidates(docs), "parts")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    both = found.join(linked(found, scope), "_row", "left")
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return both.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"), _spans(F.concat("base", F.coalesce("added", none))).alias("spans"))
