"""Mixing sources to target weights.

Rows get hash-random keys, are range-sorted within their source, and are cut
where the distributed prefix sum of their sizes meets the source's budget;
a budget above the source's size repeats whole epochs first.  All of it is
DataFrame operations: only per-partition and per-source sums are ever joined
back, and a hot source spreads over as many range partitions as it fills.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckloom.llm.store import materialise

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(keys: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``keys`` with ``rank`` from 0 in global order, without one task seeing
    all rows: range partitions, their counts, and a rank inside each."""
    parts = materialise(
        keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()),
        "rank",
    )
    sizes = sorted((r["part"], r["n"]) for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    starts = keys.sparkSession.createDataFrame(starts or [(0, 0)], "part int, start long")
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return parts.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + own).drop("part", "start")


def _water_level(sources: DataFrame, share: float, most: int) -> float:
    """The level L with sum(min(most * size, L * weight)) = share * sum(size).

    Sources reach their limit in the order of size / weight, so prefix sums in
    that order give each source's level if all before it are at their limit;
    the first whose own limit that level does not pass has the answer.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * most
    upto = Window.orderBy(limit / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)  # one row a source
    fixed, before = F.coalesce(F.sum(limit).over(upto), F.lit(0)), F.coalesce(F.sum("weight").over(upto), F.lit(0))
    weight = sources.agg(F.sum("weight")).first()[0] or 0
    levels = sources.select("src", "weight", limit.alias("limit"), ((share * total - fixed) / (weight - before)).alias("level"))
    row = levels.where(F.col("level") * F.col("weight") <= F.col("limit"))
    row = row.agg(F.min_by("level", F.struct(F.col("limit") / F.col("weight"), "src")).alias("level")).first()
    return row["level"] or 0.0


def mix_sources(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """Decide how many words of each document the mix takes.

    Returns doc_id, source, size, source_size, target, taken.  Sources in code
    point order, null last, weigh ``weights`` in turn; they share ``share`` of
    all words, none more than ``most`` times its own.  ``taken`` sums exactly
    to the whole words of the target in every source.

    Null text has size 0; empty texts, and all rows of a source without words,
    are taken 0 times.  Null ids and repeated rows count as rows of their own,
    ordered by key, id and size (rows alike in these are interchangeable).  An
    empty table gives an empty result.  Other columns are ignored.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        word_count(F.col(text)).alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))).alias("key"),
    )
    order = [F.col("source"), F.col("key"), F.col("doc_id"), F.col("size")]
    rows = materialise(rows, "mix-sizes")  # texts are read once; what follows moves sizes alone
    rows = materialise(
        rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-rows"
    ).withColumn("src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    sums = rows.groupBy("src", "part").agg(F.sum("size").alias("part_size"), F.first("source").alias("source"))
    sums = materialise(sums, "mix-sums")
    sources = sums.groupBy("src").agg(F.sum("part_size").alias("source_size"), F.first("source").alias("source"))
    sources = _ranked(sources, [F.col("source").isNull(), F.col("source")])
    turn = F.array(*[F.lit(int(w)) for w in weights])
    sources = sources.withColumn("weight", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int")))
    sources = materialise(sources.select("src", "source_size", "weight"), "mix-sources")
    level = _water_level(sources, share, most)
    target = F.least(F.lit(level) * F.col("weight"), (F.col("source_size") * most).cast("double"))
    sources = sources.select("src", "source_size", target.alias("target"))
    earlier = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("src", "part", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("start"))
    starts = starts.join(sources, "src")
    inside = Window.partitionBy("part", "src").orderBy("key", "doc_id", "size")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("inside", upto - F.col("size")).join(starts, ["part", "src"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - epochs * F.col("source_size") - F.col("start") - F.col("inside")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: each row once per epoch that takes any
    of its words, all columns kept.  Rows with no word taken go.

    Rows of the same id, source and size share one decision (the largest), so
    they may exceed the budget by what the others of them were not to give.
    Null and empty texts go; an empty table stays empty.  Columns of any name
    are allowed: rows travel as one struct.
    """
    ident, text, src = (options.get(c, c) for c in ("doc_id", "text", "source"))
    plan = mix_sources(docs, **options)
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    plan = plan.groupBy(F.col("doc_id").alias("id"), F.col("source").alias("source"), F.col("size").alias("size")).agg(F.max(times).alias("times"))
    mine = docs.select(
        F.struct("*").alias("row"), F.col(ident).alias("own_id"), F.col(src).cast("string").alias("own_source"), word_count(F.col(text)).alias("words")
    )
    same = F.col("own_id").eqNullSafe(F.col("id")) & F.col("own_source").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size"))
    out = mine.join(plan, same).where(F.col("times") > 0)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
