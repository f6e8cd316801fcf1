"""Operator 1: mix sources to target weights, by capped water-filling. DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

#: Hexadecimal digits of the hash that part a source's rows. One part of a source, a 65 536th of its rows, is all that is ever ordered as one group.
DIGITS = 4
#: Copies of a source's row of the plan, so that joining it to a source with a third of all rows is spread over tasks.
SALTS = 32


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def plan_sources(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """One row for each source of ``sizes`` (source, source_size): its weight and target.

    The budget times all sizes is shared by weight; a source stops at ``max_epochs`` times its size and what it leaves is
    shared again by weight. Ordered by cap for each unit of weight, sources fill one after the other, so one pass over
    running sums finds the level: source i is full if its cap is below the level that the sources before it leave.
    The windows run over one row for each source, never over documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w.cast("long")).withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.lit(float(budget)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    open_ = F.col("cap") >= F.col("weight") * F.col("level")
    s = s.withColumn("final", F.max(F.when(open_, F.col("level"))).over(every))
    s = s.withColumn("first_open", F.min(F.when(open_, F.col("cap") / F.col("weight"))).over(every))
    full = F.col("final").isNull() | (F.col("cap") / F.col("weight") < F.col("first_open"))
    return s.select("source", "source_size", "weight", F.when(full, F.col("cap").cast("double")).otherwise(F.least(F.col("weight") * F.col("final"), F.col("cap").cast("double"))).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, max_epochs: int = 2, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """How often the mix takes each document: doc_id, size, source_size, target, taken, copies, and the columns in ``keep``.

    A source is taken whole floor(target / size) times; for the rest its documents are taken once more in the order of
    md5(seed:doc_id), until their words come nearest to what is left. Within a source the words of each of 65 536 hash ranges are
    summed, so only the range in which the order stops is sorted. Reruns agree; no document is taken more than
    ``max_epochs`` times.

    Null sources are one source, sorted last. A null or empty text has size 0 and takes no words; it goes along with each whole
    repetition, and with the rest if its place in the order comes before the last one taken. Rows that repeat a doc_id are documents of their own. An empty table gives an empty result. Further
    columns are ignored unless kept.
    """
    own = docs.select(*keep, *[c for c in ("doc_id",) if c not in keep], F.col("source").alias("_source"), word_count().alias("size"))
    own = own.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    own = own.withColumn("_part", F.conv(F.substring("_h", 1, DIGITS), 16, 10).cast("int"))
    if not keep:  # few columns: texts are read once
        own = written(own, "sizes")
    parts = written(own.groupBy(F.col("_source").alias("source"), "_part").agg(F.sum("size").alias("part_size")), "parts")
    sizes = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    plan = plan_sources(sizes, weights, budget, max_epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    # The range in which the order stops: the last whose predecessors hold no more than what is needed.
    upto = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cut = parts.withColumn("before", F.coalesce(F.sum("part_size").over(upto), F.lit(0)))
    cut = cut.join(plan.select(F.col("source").alias("p"), "need"), F.col("source").eqNullSafe(F.col("p"))).filter(F.col("before") <= F.col("need"))
    cut = cut.groupBy("source").agg(F.max_by(F.struct("_part", "before"), "_part").alias("cut")).select(F.col("source").alias("cut_source"), "cut")
    plan = plan.join(cut, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    plan = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.conv(F.substring("_h", DIGITS + 1, 4), 16, 10).cast("int"), F.lit(SALTS))
    got = own.withColumn("_s", salt).join(plan, F.col("_source").eqNullSafe(F.col("source")) & (F.col("_s") == F.col("_salt")))
    at = F.col("_part") == F.col("cut._part")
    running = Window.partitionBy("_source").orderBy("_h", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = [*keep, *[c for c in ("doc_id",) if c not in keep], "size", "source_size", "target"]
    rest = got.filter(~F.coalesce(at, F.lit(False))).withColumn("more", F.coalesce(F.col("_part") < F.col("cut._part"), F.lit(False)))
    last = got.filter(at).withColumn("more", F.col("cut.before") + F.sum("size").over(running) - F.col("size") / 2.0 <= F.col("need"))
    copies = F.col("whole") + (F.col("more") & (F.col("need") > 0) & (F.col("whole") < max_epochs)).cast("long")
    both = rest.select(*out, copies.alias("copies")).unionByName(last.select(*out, copies.alias("copies")))
    return both.select(*out, (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as many times as the mix takes it, in the columns of ``docs``, whatever their names.

    ``mix_sources`` says how often; nulls, texts without words and repeated rows are taken as there, and documents of size 0 never more than ``max_epochs`` times.
    An empty table gives an empty result.
    """
    packed = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    times = mix_sources(packed, keep=("_doc",), **how)
    return times.filter("copies > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_doc.*")
