"""Rendered slides assembled into one document a deck."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deckloom.functions.headings import GENERATOR, body_is_empty, frontmatter, notes_block, section_of, slide_comment
from deckloom.functions.text import MaskingOptions, labels, split_lines, strip
from deckloom.operators.render import render_records, render_slides

SEPARATOR = "\n\n---\n\n"


def slide_blocks(rendered: DataFrame, *, emit_toc: bool = False, emit_frontmatter: bool = False, include_notes: bool = False) -> DataFrame:
    """(deck_id, slide_index, block); a null block is dropped: with
    ``emit_toc``, an empty slide without a title of its own."""
    empty = body_is_empty(F.col("body_parts"))
    body = F.when(empty, F.array().cast("array<string>")).otherwise(F.col("body_parts")) if emit_toc else F.col("body_parts")
    parts = F.concat("heading_lines", body)
    if include_notes:
        notes = notes_block(F.col("notes"))
        parts = F.when(notes != "", F.concat(parts, F.array(notes))).otherwise(parts)
    block = F.array_join(parts, "\n\n")
    if emit_frontmatter:
        comment = slide_comment(F.col("slide_index") + 1, section_of(F.col("heading_lines")), F.col("has_diagram"))
        block = F.concat(comment, F.lit("\n"), block)
    if emit_toc:
        block = F.when(~(empty & F.col("title_is_fallback")), block)
    block = F.when(F.col("slide_index").isNotNull(), block)
    return rendered.select("deck_id", "slide_index", "title", block.alias("block"))


def suppress_repeated_labels(blocks: DataFrame) -> DataFrame:
    """Drop lines that the block before has too, headings never, and a blank
    line right after a dropped one.  A deck's first block stays as it is, and
    null blocks are passed over."""
    before = Window.partitionBy("deck_id").orderBy("slide_index", "title").rowsBetween(Window.unboundedPreceding, -1)
    seen = blocks.withColumn("before", F.last(labels(F.col("block")), ignorenulls=True).over(before))
    lines = split_lines(F.col("block"))
    repeated = F.transform(lines, lambda x: ~x.startswith("#") & (strip(x) != "") & F.array_contains("before", strip(x)))
    seen = seen.withColumns({"lines": lines, "repeated": repeated})

    def stays(line, i):
        after = (strip(line) == "") & F.coalesce(F.get("repeated", i - 1), F.lit(False)) & (i > 0)
        return ~(F.get("repeated", i) | after)

    kept = F.array_join(F.filter("lines", stays), "\n")
    return seen.select("deck_id", "slide_index", "title", F.when(F.col("before").isNull(), F.col("block")).otherwise(kept).alias("block"))


def assemble_documents(
    slides: DataFrame,
    shapes: DataFrame,
    *,
    masking: MaskingOptions | None = None,
    suppress_labels: bool = False,
    table_fallback: str = "mermaid",
    heading_hierarchy: bool = False,
    emit_toc: bool = False,
    emit_frontmatter: bool = False,
    include_notes: bool = False,
    generator: str = GENERATOR,
    decks: DataFrame | None = None,
) -> DataFrame:
    """(deck_id, markdown): blocks by slide index, a rule between them.

    Two shuffles, by slide and by deck.  With ``decks``, decks without slides
    have an empty document too.
    """
    rendered = render_slides(slides, shapes, masking=masking, table_fallback=table_fallback, heading_hierarchy=heading_hierarchy)
    documents = _documents(rendered, suppress_labels, emit_toc, emit_frontmatter, include_notes, generator)
    if decks is None:
        return documents
    nothing = F.concat(frontmatter(F.lit(0), generator), F.lit("\n\n")) if emit_frontmatter else F.lit("")
    return decks.select("deck_id").join(documents, "deck_id", "left").select("deck_id", F.coalesce("markdown", nothing).alias("markdown"))


def assemble_records(
    records: DataFrame,
    *,
    masking: MaskingOptions | None = None,
    suppress_labels: bool = False,
    table_fallback: str = "mermaid",
    heading_hierarchy: bool = False,
    emit_toc: bool = False,
    emit_frontmatter: bool = False,
    include_notes: bool = False,
    generator: str = GENERATOR,
) -> DataFrame:
    """(deck_id, markdown) straight from the records of deck files, which are
    read once; decks without slides have an empty document."""
    rendered = render_records(records, masking=masking, table_fallback=table_fallback, heading_hierarchy=heading_hierarchy)
    return _documents(rendered, suppress_labels, emit_toc, emit_frontmatter, include_notes, generator)


def _documents(
    rendered: DataFrame, suppress_labels: bool, emit_toc: bool, emit_frontmatter: bool, include_notes: bool, generator: str
) -> DataFrame:
    blocks = slide_blocks(rendered, emit_toc=emit_toc, emit_frontmatter=emit_frontmatter, include_notes=include_notes)
    if suppress_labels:
        blocks = suppress_repeated_labels(blocks)
    ordered = F.sort_array(F.collect_list(F.struct("slide_index", "title", "block")))
    documents = blocks.groupBy("deck_id").agg(ordered.alias("blocks"), F.count("slide_index").alias("slide_count"))
    text = F.array_join(F.transform("blocks", lambda b: b["block"]), SEPARATOR)
    if emit_frontmatter:
        text = F.concat(frontmatter(F.col("slide_count"), generator), F.lit("\n\n"), text)
    return documents.select("deck_id", text.alias("markdown"))
