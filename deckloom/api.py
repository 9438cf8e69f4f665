"""Decks to Markdown, end to end."""

from __future__ import annotations

import logging
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.errors import ParseError
from deckloom.functions.headings import GENERATOR
from deckloom.functions.text import MaskingOptions
from deckloom.operators.assemble import assemble_documents, assemble_records
from deckloom.operators.enrich import enrich_descriptions, reconstruct_slides
from deckloom.operators.validate import check, checked
from deckloom.providers import ImageDescriber, SlideReconstructor
from deckloom.sources.convert import render_deck
from deckloom.sources.decks import Deck, parse_files, split_records
from deckloom.sources.ooxml import Package
from deckloom.sources.pixels import classify_images

_log = logging.getLogger("deckloom")


@dataclass(frozen=True)
class ConvertOptions:
    """What a conversion does; all of it is off unless asked for.

    ``describe_max_workers`` bounds the tasks that call the describer over all
    decks (none: as many as Spark runs), ``reconstruct_max_workers`` the calls
    for one deck at a time.  ``complex_when`` replaces the score's threshold in
    choosing the slides to reconstruct: a condition on the columns of
    :func:`deckloom.operators.complexity.complexity_scores`.  With ``validate``
    tables of documents have the columns ``valid`` and ``warnings`` too.
    """

    describer: ImageDescriber | None = None
    masking: MaskingOptions | None = None
    validate: bool = False
    describe_max_workers: int | None = 4
    diagram_mermaid: bool = False
    heading_hierarchy: bool = False
    emit_toc: bool = False
    emit_frontmatter: bool = False
    include_notes: bool = False
    reconstructor: SlideReconstructor | None = None
    visual_reconstruct: bool = False
    max_vlm_slides: int | None = None
    embed_rendered_image: bool = False
    force_render: frozenset[int] = frozenset()
    force_text: frozenset[int] = frozenset()
    render_dpi: int = 150
    reconstruct_max_workers: int = 4
    complex_when: Column | None = field(default=None, repr=False)
    generator: str = GENERATOR
    renderer: object = field(default=render_deck, repr=False)


@dataclass
class ValidationResult:
    valid: bool
    warnings: list[str] = field(default_factory=list)


def _validated(documents: DataFrame, options: ConvertOptions) -> DataFrame:
    if not options.validate:
        return documents
    return documents.withColumn("__found", checked(F.col("markdown"))).select(*documents.columns, "__found.valid", "__found.warnings")


def to_markdown(deck: Deck, options: ConvertOptions | None = None, *, contents: DataFrame | None = None) -> DataFrame:
    """(deck_id, markdown) of parsed decks: the plan of one conversion over
    any number of them.  ``contents`` (path, content) has the files' bytes, for
    renders of decks that no local path leads to."""
    o = options or ConvertOptions()
    shapes = classify_images(deck.shapes)
    shapes = enrich_descriptions(shapes, o.describer, diagram_mermaid=o.diagram_mermaid, max_workers=o.describe_max_workers)
    slides = deck.slides
    if o.visual_reconstruct:
        slides = reconstruct_slides(
            deck.decks, slides, shapes, o.reconstructor, renderer=o.renderer, max_slides=o.max_vlm_slides,
            force_render=o.force_render, force_text=o.force_text, embed=o.embed_rendered_image, render_dpi=o.render_dpi,
            max_workers=o.reconstruct_max_workers, contents=contents, complex_when=o.complex_when,
        )
    documents = assemble_documents(
        slides, shapes, masking=o.masking, heading_hierarchy=o.heading_hierarchy, emit_toc=o.emit_toc,
        emit_frontmatter=o.emit_frontmatter, include_notes=o.include_notes, generator=o.generator, decks=deck.decks,
    )
    return _validated(documents, o)


def convert_contents(files: DataFrame, options: ConvertOptions | None = None, *, mode: str = "PERMISSIVE") -> DataFrame:
    """(deck_id, markdown) of a table of (path, content).

    Without providers the files are parsed once and image bytes never leave
    the task that reads them; with providers the tables are read as needed.
    """
    o = options or ConvertOptions()
    if o.describer is not None or (o.visual_reconstruct and o.reconstructor is not None):
        return to_markdown(split_records(parse_files(files, mode=mode)), o, contents=files)
    records = parse_files(files, mode=mode, classify=True, keep_images=False)
    documents = assemble_records(
        records, masking=o.masking, heading_hierarchy=o.heading_hierarchy, emit_toc=o.emit_toc, emit_frontmatter=o.emit_frontmatter,
        include_notes=o.include_notes, generator=o.generator,
    )
    return _validated(documents, o)


def convert_files(spark: SparkSession, paths: str | Iterable[str], options: ConvertOptions | None = None, *, mode: str = "PERMISSIVE") -> DataFrame:
    """(deck_id, markdown) of files, folders or globs."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return convert_contents(spark.read.format("binaryFile").load(paths), options, mode=mode)


def _session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def convert(source: str | Path, *, options: ConvertOptions | None = None, spark: SparkSession | None = None) -> str:
    """One local deck as a Markdown string; :class:`ParseError` if it is none."""
    spark, path = _session(spark), Path(source)
    if not path.is_file():
        raise ParseError(f"file not found: {path}")
    o = options or ConvertOptions()
    data = path.read_bytes()
    Package(data)  # what is no deck fails here
    row = convert_contents(spark.createDataFrame([(str(path), data)], "path STRING, content BINARY"), o, mode="FAILFAST").first()
    text = row["markdown"] if row else ""
    if o.validate:
        result = ValidationResult(row["valid"], row["warnings"]) if row else validate_markdown(text)
        if not result.valid:
            _log.warning("invalid document (warnings=%d)", len(result.warnings))
        elif result.warnings:
            _log.info("%d warning(s)", len(result.warnings))
    return text


def validate_markdown(text: str, *, spark: SparkSession | None = None) -> ValidationResult:
    """The checks of ``validate_documents`` for one string; needs no session."""
    return ValidationResult(*check(text))
