"""Descriptions of images and reconstructions of slides by providers.

Work that costs is done once for each distinct content: groups by content
hash, one call for a group's first member, results joined back.  A failed call
leaves its group without a result and touches nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.functions.images import is_vector, shape_hint
from deckloom.functions.text import MaskingOptions, data_url, flowchart_fence, mask_count, normalize_text
from deckloom.operators.complexity import complexity_scores, route_slides
from deckloom.operators.render import assemble_slides
from deckloom.providers import ImageDescriber, SlideContext, SlideReconstructor
from deckloom.sources.convert import DPI, convert_vector, render_available, render_deck


def described(jobs: DataFrame, describer: ImageDescriber) -> DataFrame:
    """(hash, extension, hint, text) of one call a job, in Arrow batches;
    text is null where the call failed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for _, ext, hint, data in batch.itertuples(index=False):
                raw: bytes | None = bytes(data)
                kind = ext
                if ext in ("emf", "wmf"):
                    raw, kind = convert_vector(raw, ext), "png"
                try:
                    texts.append(describer.describe(raw, kind, hint) if raw is not None else None)
                except Exception:  # one image leaves the others whole
                    texts.append(None)
            yield batch[["hash", "extension", "hint"]].assign(text=pd.Series(texts, dtype=object))

    return jobs.select("hash", "extension", "hint", "image_bytes").mapInPandas(run, "hash STRING, extension STRING, hint STRING, text STRING")


def image_groups(shapes: DataFrame, *, diagram_mermaid: bool = False) -> DataFrame:
    """A row for each distinct image of a deck, with the extension, class and
    hint of the first shape that shows it in slide and depth-first order."""
    images = shapes.where((F.col("kind") == "image") & (F.length("image_bytes") > 0))
    keyed = images.select(
        "deck_id", F.sha2("image_bytes", 256).alias("hash"), F.struct("slide_index", "path").alias("place"),
        F.struct(F.lower(F.coalesce("image_ext", F.lit(""))).alias("extension"), "classification").alias("first"),
    )
    groups = keyed.groupBy("deck_id", "hash").agg(F.min_by("first", "place").alias("first"), F.count("*").alias("n_shapes"))
    return groups.select(
        "deck_id", "hash", "n_shapes", "first.extension", "first.classification",
        shape_hint(F.col("first.classification"), diagram_mermaid=diagram_mermaid).alias("hint"),
    )


def enrich_descriptions(
    shapes: DataFrame, describer: ImageDescriber | None, *, diagram_mermaid: bool = False, max_workers: int | None = 4
) -> DataFrame:
    """``shapes`` with ``description`` filled for images; without a describer,
    as they are.

    Calls are made once for each distinct content, extension and hint over all
    decks; ``max_workers``, at least 1, bounds the tasks that make them (a task
    without a job makes none), and none leaves that to Spark.  Persist the
    result before reading it twice: each read makes the calls again.
    """
    if describer is None:
        return shapes
    groups = image_groups(shapes, diagram_mermaid=diagram_mermaid)
    contents = shapes.where(F.col("kind") == "image").select(F.sha2("image_bytes", 256).alias("hash"), "image_bytes").dropDuplicates(["hash"])
    jobs = groups.select("hash", "extension", "hint").distinct().join(contents, "hash")
    if max_workers is not None:
        jobs = jobs.repartition(max(1, max_workers))
    done = described(jobs, describer)
    same = ["hash", "extension"]
    found = groups.join(done.withColumnRenamed("hint", "asked"), same, "left").where(F.col("hint").eqNullSafe(F.col("asked")))
    text = F.col("text")
    if diagram_mermaid:
        text = F.when(F.col("classification") == "diagram", F.coalesce(flowchart_fence(text), text)).otherwise(text)
    found = found.select("deck_id", "hash", text.alias("found"))
    is_image = F.coalesce((F.col("kind") == "image") & (F.length("image_bytes") > 0), F.lit(False))
    joined = shapes.where(is_image).withColumn("hash", F.sha2("image_bytes", 256)).join(found, ["deck_id", "hash"], "left")
    joined = joined.withColumn("description", F.coalesce("found", "description")).select(*shapes.columns)
    return shapes.where(~is_image).unionByName(joined)  # shapes without an image take no part in the join


def reconstruct_slides(
    decks: DataFrame,
    slides: DataFrame,
    shapes: DataFrame,
    reconstructor: SlideReconstructor | None,
    *,
    renderer: Callable[..., dict[int, bytes | None]] = render_deck,
    available: Callable[[], bool] | None = None,
    complex_when: Column | None = None,
    max_slides: int | None = None,
    force_render: Iterable[int] = (),
    force_text: Iterable[int] = (),
    embed: bool = False,
    render_dpi: int = DPI,
    max_workers: int = 4,
    contents: DataFrame | None = None,
) -> DataFrame:
    """``slides`` with ``reconstructed_md`` filled for those that are routed,
    rendered and reconstructed; all others are as they were.

    A deck's selected slides are rendered by one call and reconstructed by one
    call for each distinct render, whose first slide gives the context, at
    most ``max_workers`` of a deck at a time.  Decks are rendered from their
    bytes in ``contents`` (path, content), so that they may lie on any file
    system that Spark reads; without it from ``source_path``.  No-op
    without a reconstructor or where decks cannot be rendered; ``available``
    tells that, and counts as true for a renderer other than the default.
    """
    if available is None:
        available = render_available if renderer is render_deck else (lambda: True)
    if reconstructor is None or not available() or (max_slides is not None and max_slides <= 0):
        return slides
    scored = complexity_scores(slides, shapes)
    chosen = route_slides(
        scored, max_slides=max_slides, force_render=tuple(force_render), force_text=tuple(force_text), complex_when=complex_when
    )
    outline = assemble_slides(slides, shapes)
    work = (
        chosen.select("deck_id", "slide_index")
        .join(slides.select("deck_id", "slide_index", F.coalesce("title", F.lit("")).alias("title")), ["deck_id", "slide_index"])
        .join(outline, ["deck_id", "slide_index"])
        .join(decks.select("deck_id", "source_path"), "deck_id", "left")
    )
    files = None
    if contents is not None:  # bytes once a deck, not once a slide
        wanted = work.select("deck_id", "source_path").distinct()
        files = wanted.join(contents.select(F.col("path").alias("source_path"), "content"), "source_path").select(F.col("deck_id").alias("owner"), "content")

    def run(deck: pd.DataFrame, file: pd.DataFrame | None = None) -> pd.DataFrame:
        deck = deck.sort_values("slide_index")
        if not len(deck):
            return pd.DataFrame([], columns=["deck_id", "slide_index", "found", "png"])
        source = bytes(file["content"].iloc[0]) if file is not None and len(file) else deck["source_path"].iloc[0]
        pngs = renderer(source, deck["slide_index"].tolist(), dpi=render_dpi)
        rows = [(r, png, hashlib.sha256(png).hexdigest()) for r in deck.itertuples() if (png := pngs.get(r.slide_index)) is not None]
        first = {key: (r, png) for r, png, key in reversed(rows)}

        def call(job: tuple[Any, bytes]) -> str | None:
            r, png = job
            try:
                return reconstructor.reconstruct(png, "png", SlideContext(r.slide_index, r.title, r.markdown)) or None
            except Exception:  # this render falls back to text
                return None

        with ThreadPoolExecutor(max(1, min(max_workers, len(first)))) as pool:
            texts = dict(zip(first, pool.map(call, first.values()), strict=True))
        out = [(r.deck_id, r.slide_index, texts[key], png if embed else None) for r, png, key in rows if texts[key] is not None]
        return pd.DataFrame(out, columns=["deck_id", "slide_index", "found", "png"])

    schema = "deck_id STRING, slide_index INT, found STRING, png BINARY"
    if files is None:
        found = work.groupBy("deck_id").applyInPandas(lambda deck: run(deck), schema)
    else:
        found = work.groupBy("deck_id").cogroup(files.groupBy("owner")).applyInPandas(lambda deck, file: run(deck, file), schema)
    text = F.concat(F.coalesce(data_url(F.col("png")), F.lit("")), F.col("found"))
    joined = slides.join(found.select("deck_id", "slide_index", text.alias("found")), ["deck_id", "slide_index"], "left")
    return joined.withColumn("reconstructed_md", F.coalesce("found", "reconstructed_md")).select(*slides.columns)


def reconstruction_metrics(routed: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(deck_id, routed, success, fallback) of a reconstruction: counts alone,
    never content."""
    key = ["deck_id", "slide_index"]
    done = after.where("reconstructed_md IS NOT NULL").join(before.where("reconstructed_md IS NOT NULL"), key, "left_anti").select(*key, F.lit(1).alias("ok"))
    counts = routed.select(*key).join(done, key, "left").groupBy("deck_id")
    return counts.agg(F.count("*").alias("routed"), F.count("ok").alias("success"), (F.count("*") - F.count("ok")).alias("fallback"))


def masking_metrics(shapes: DataFrame, masking: MaskingOptions) -> DataFrame:
    """(deck_id, matches) of masking the decks' texts: counts alone, never
    content."""
    texts = F.transform("paragraphs", lambda p: mask_count(normalize_text(F.coalesce(p["text"], F.lit(""))), masking))
    total = F.coalesce(F.aggregate(texts, F.lit(0).cast("long"), lambda a, n: a + n), F.lit(0))
    return shapes.groupBy("deck_id").agg(F.sum(total).alias("matches"))


def description_metrics(shapes: DataFrame) -> DataFrame:
    """(deck_id, images, calls, cache_hits): counts alone, never content."""
    groups = image_groups(shapes).groupBy("deck_id")
    return groups.agg(F.sum("n_shapes").alias("images"), F.count("*").alias("calls"), (F.sum("n_shapes") - F.count("*")).alias("cache_hits"))


__all__ = [
    "described", "description_metrics", "enrich_descriptions", "image_groups", "is_vector", "masking_metrics", "reconstruct_slides", "reconstruction_metrics",
]
