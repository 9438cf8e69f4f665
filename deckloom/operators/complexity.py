"""Visual complexity of slides and the routing that follows from it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights and limits of the score.
THRESHOLD = 4
MANY_SHAPES, W_MANY_SHAPES = 8, 1
MIN_COLUMNS, W_COLUMNS = 3, 4
MIN_CONNECTORS, W_CONNECTORS = 2, 4
W_CHART, W_TABLE, W_GROUP = 4, 2, 2
CONNECTORS, CHARTS = ("LINE", "CONNECTOR"), ("CHART", "DIAGRAM")
BAND_HEIGHT, COLUMN_STEP = 250_000, 100_000


def _columns(lefts: Column) -> Column:
    """Greedily distinct left edges: each a step from the last one counted."""
    none = F.struct(F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("last"))

    def step(done: Column, left: Column) -> Column:
        new = done["last"].isNull() | (left - done["last"] >= COLUMN_STEP)
        return F.struct(F.when(new, done["n"] + 1).otherwise(done["n"]).alias("n"), F.when(new, left).otherwise(done["last"]).alias("last"))

    return F.aggregate(F.sort_array(lefts), none, step)["n"]


def _wide(lefts: Column) -> Column:
    return (F.size(lefts) >= MIN_COLUMNS) & (_columns(lefts) >= MIN_COLUMNS)


def has_columns(texts: Column) -> Column:
    """Whether texts, an array of (top, left), stand side by side in a band
    that starts at its first member's top."""
    none = F.struct(
        F.lit(None).cast("bigint").alias("anchor"), F.array().cast("array<bigint>").alias("lefts"), F.lit(False).alias("hit")
    )

    def step(done: Column, text: Column) -> Column:
        next_band = done["anchor"].isNotNull() & (text["top"] - done["anchor"] > BAND_HEIGHT)
        own = F.array(text["left"])
        return F.struct(
            F.when(next_band, text["top"]).otherwise(F.coalesce(done["anchor"], text["top"])).alias("anchor"),
            F.when(next_band, own).otherwise(F.concat(done["lefts"], own)).alias("lefts"),
            (done["hit"] | (next_band & _wide(done["lefts"]))).alias("hit"),
        )

    return F.aggregate(F.sort_array(texts), none, step, lambda done: done["hit"] | _wide(done["lefts"]))


def complexity_scores(slides: DataFrame, shapes: DataFrame) -> DataFrame:
    """(deck_id, slide_index, score, is_complex) of every slide."""
    other = F.col("kind") == "other"
    spot = F.struct(F.coalesce("top", F.lit(0)).cast("bigint").alias("top"), F.coalesce("left", F.lit(0)).cast("bigint").alias("left"))
    signals = shapes.groupBy("deck_id", "slide_index").agg(
        F.count("*").alias("n"),
        F.count_if(other & F.col("mso_shape_type").isin(*CONNECTORS)).alias("connectors"),
        F.bool_or(other & F.col("mso_shape_type").isin(*CHARTS)).alias("chart"),
        F.bool_or(F.col("kind") == "table").alias("table"),
        F.bool_or(F.col("kind") == "group").alias("group"),
        F.collect_list(F.when(F.col("kind") == "text", spot)).alias("texts"),
    )
    points = lambda flag, weight: F.when(flag, F.lit(weight)).otherwise(0)
    score = (
        points(F.col("n") > MANY_SHAPES, W_MANY_SHAPES)
        + points(has_columns(F.col("texts")), W_COLUMNS)
        + points(F.col("connectors") >= MIN_CONNECTORS, W_CONNECTORS)
        + points(F.col("chart"), W_CHART)
        + points(F.col("table"), W_TABLE)
        + points(F.col("group"), W_GROUP)
    )
    scored = signals.select("deck_id", "slide_index", score.alias("score"))
    scored = slides.select("deck_id", "slide_index").join(scored, ["deck_id", "slide_index"], "left")
    return scored.select("deck_id", "slide_index", F.coalesce("score", F.lit(0)).alias("score")).withColumn(
        "is_complex", F.col("score") >= THRESHOLD
    )


def route_slides(
    scored: DataFrame,
    *,
    max_slides: int | None = None,
    force_render: Iterable[int] = (),
    force_text: Iterable[int] = (),
    complex_when: Column | None = None,
) -> DataFrame:
    """The slides to render: complex or forced ones, never those forced to
    text; at most ``max_slides`` a deck, by score and then index."""
    wanted = F.col("slide_index").isin(*force_render) if force_render else F.lit(False)
    wanted = wanted | (F.col("is_complex") if complex_when is None else complex_when)
    if force_text:
        wanted &= ~F.col("slide_index").isin(*force_text)
    routed = scored.where(wanted)
    if max_slides is None:
        return routed
    if max_slides <= 0:
        return routed.where(F.lit(False))
    rank = F.row_number().over(Window.partitionBy("deck_id").orderBy(F.desc("score"), "slide_index"))
    return routed.withColumn("rank", rank).where(F.col("rank") <= max_slides).drop("rank")
