"""Connected components without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckloom.llm.store import discard, materialise

#: Labels sent to all tasks while they are at most so many (two short keys
#: each); more are joined by shuffle.
BROADCAST_LABELS = 200_000
#: Rows of an output file: tables of few rows need few tasks.
FILE_ROWS = 100_000


def components(links: DataFrame, a: str = "a", b: str = "b", broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """(node, label) of every node that ``links`` name: the smallest node that
    can be reached.

    Each round takes the minimum of the neighbours' labels, pre-aggregated
    before it shuffles, and jumps to the label's label, so stars take two
    rounds and chains a logarithm of their length or little more.  Each round
    is written out; only numbers of labels come to the driver.
    """
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    n = links.count()
    files = max(1, -(-4 * n // FILE_ROWS))  # few rows need few tasks and files
    both = F.explode(F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in ("uv", "vu", "uu", "vv")]))
    both = materialise(links.select(both.alias("e")).select("e.u", "e.v").distinct().coalesce(files), "links")
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
    labels = materialise(labels.coalesce(files), "labels")
    few = F.broadcast if labels.count() <= broadcast_labels else lambda df: df
    while True:
        near = both.join(few(labels), both.v == labels.node).groupBy("u")
        near = near.agg(F.min("label").alias("next"), F.max(F.when(F.col("u") == F.col("v"), F.col("label"))).alias("old"))
        step = materialise(near.coalesce(files), "step")
        far = step.select(F.col("u").alias("at"), F.col("next").alias("far"))
        jumped = step.join(few(far), step.next == far.at, "left")
        jumped = jumped.select(F.col("u").alias("node"), F.coalesce("far", "next").alias("label"), "old")
        before, labels = labels, materialise(jumped.coalesce(files), "labels")
        discard(before)
        discard(step)
        done = labels.where("label != old").isEmpty()
        if done:
            discard(both)
            return labels.select("node", "label")
