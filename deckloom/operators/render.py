"""Shapes rendered to the heading and body parts of their slide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckloom.functions.headings import heading_lines
from deckloom.functions.images import image_markdown
from deckloom.functions.tables import table_markdown
from deckloom.functions.text import MaskingOptions, mask_text, paragraphs_markdown, strip

#: Shapes whose tops fall into one band of so many EMU (an inch) read left to right.
ROW_BAND = 914_400

RENDERED = "deck_id, slide_index, title, notes, heading_lines, body_parts, title_is_fallback, has_diagram"


def row_band(top: Column) -> Column:
    """Rounded down, so that positions above the slide band too."""
    return F.floor(top / F.lit(ROW_BAND))


def reading_order(shapes: DataFrame) -> DataFrame:
    """Top-level shapes with their ``rank`` in reading order, from 1."""
    order = Window.partitionBy("deck_id", "slide_index").orderBy(row_band(F.col("top")), "left", "path")
    return shapes.where(F.size("path") == 1).withColumn("rank", F.row_number().over(order))


def shape_part(masking: MaskingOptions | None = None, table_fallback: str = "mermaid") -> Column:
    """Markdown of a shape row; null for images, whose number is not known
    yet, and for groups, which are only an order."""
    kind = F.col("kind")
    return (
        F.when(kind == "text", F.coalesce(paragraphs_markdown(F.col("paragraphs"), masking), F.lit("")))
        .when(kind == "table", F.coalesce(table_markdown(F.col("rows"), F.col("n_rows"), F.col("n_cols"), table_fallback), F.lit("")))
        .when(kind == "other", F.coalesce(mask_text(F.col("fallback_text"), masking), F.lit("")))
    )


def render_slides(
    slides: DataFrame,
    shapes: DataFrame,
    *,
    masking: MaskingOptions | None = None,
    table_fallback: str = "mermaid",
    heading_hierarchy: bool = False,
) -> DataFrame:
    """One row a slide: its heading lines, its body parts in reading order,
    whether the heading is only its position, and whether it holds a diagram.

    Top-level shapes are ordered by band, left edge and position; shapes of a
    group follow the group's place in their own order.  One shuffle by slide;
    image bytes are never read.
    """
    grouped = shapes.groupBy("deck_id", "slide_index").agg(F.sort_array(F.collect_list(_leaf(masking, table_fallback))).alias("shapes"))
    rows = slides.join(grouped, ["deck_id", "slide_index"], "left")
    return _rendered(rows, masking, heading_hierarchy)


def render_records(
    records: DataFrame, *, masking: MaskingOptions | None = None, table_fallback: str = "mermaid", heading_hierarchy: bool = False
) -> DataFrame:
    """As :func:`render_slides`, from the records of deck files: one pass over
    the files and one shuffle.  A deck's own record gives a row without a
    slide index, so that decks without slides stay."""
    leaf = F.when(F.col("record") == "shape", _leaf(masking, table_fallback))
    rows = records.where(F.col("record") != "error").groupBy("deck_id", "slide_index").agg(
        F.max(F.when(F.col("record") == "slide", F.col("title"))).alias("title"),
        F.max(F.when(F.col("record") == "slide", F.col("notes"))).alias("notes"),
        F.lit(None).cast("string").alias("reconstructed_md"),
        F.sort_array(F.collect_list(leaf)).alias("shapes"),
    )
    return _rendered(rows, masking, heading_hierarchy)


def _leaf(masking: MaskingOptions | None, table_fallback: str) -> Column:
    """What rendering needs of a shape, its path first."""
    return F.struct(
        "path", "kind", "top", "left", "description", "alt_text", "classification",
        F.coalesce("is_title", F.lit(False)).alias("is_title"),
        F.coalesce("is_footer", F.lit(False)).alias("is_footer"),
        F.get("paragraphs", F.lit(0))["text"].alias("first_text"),
        (F.size("path") == 1).alias("on_top"),
        shape_part(masking, table_fallback).alias("part"),
    )


def _rendered(rows: DataFrame, masking: MaskingOptions | None, heading_hierarchy: bool) -> DataFrame:
    """Slides with their ``shapes``, in depth-first order, rendered."""
    empty = F.array().cast(rows.schema["shapes"].dataType)
    rows = rows.withColumns(
        {
            "shapes": F.coalesce("shapes", empty),
            "title": F.coalesce("title", F.lit("")),
            "notes": F.coalesce("notes", F.lit("")),
            "slide_number": F.col("slide_index") + 1,
        }
    )
    titled = F.col("title") != ""
    named = F.filter("shapes", lambda s: s["on_top"] & (s["kind"] == "text") & s["is_title"] & s["first_text"].isNotNull())
    same = F.get(F.filter(named, lambda s: strip(s["first_text"]) == strip(F.col("title"))), F.lit(0))
    first = F.get(F.filter(named, lambda s: strip(s["first_text"]) != ""), F.lit(0))
    rows = rows.withColumn("heading_shape", F.when(titled, same).otherwise(first))
    chosen = strip(F.col("heading_shape")["first_text"])
    position = F.array(F.concat(F.lit("## Slide "), F.col("slide_number").cast("string")))
    fallback = ~titled & F.col("heading_shape").isNull()
    headings = (
        F.when(titled, heading_lines(F.col("title"), hierarchy=heading_hierarchy))
        .when(fallback, position)
        .otherwise(heading_lines(chosen, hierarchy=heading_hierarchy))
    )
    roots = F.filter("shapes", lambda s: s["on_top"])

    def placed(s: Column) -> Column:
        root = F.get(F.filter(roots, lambda r: r["path"][0] == s["path"][0]), F.lit(0))
        return F.struct(row_band(F.coalesce(root["top"], F.lit(0))).alias("band"), F.coalesce(root["left"], F.lit(0)).alias("x"), s.alias("s"))

    order = F.sort_array(F.transform("shapes", placed))
    rows = rows.withColumn("ordered", F.transform(order, lambda o: o["s"]))
    rows = rows.withColumn("images", F.transform(F.filter("ordered", lambda s: s["kind"] == "image"), lambda s: s["path"]))
    heading_path = F.col("heading_shape")["path"]
    shown = F.filter(
        "ordered",
        lambda s: (s["kind"] != "group") & ~((s["kind"] == "text") & s["is_footer"]) & ~F.coalesce(s["path"] == heading_path, F.lit(False)),
    )

    def part(s: Column) -> Column:
        number = F.array_position("images", s["path"])
        image = image_markdown(s["description"], s["alt_text"], s["classification"], F.col("slide_number"), number, masking)
        return F.when(s["kind"] == "image", image).otherwise(F.coalesce(s["part"], F.lit("")))

    parts = F.filter(F.transform(shown, part), lambda x: x != "")
    rebuilt = F.array(mask_text(F.col("reconstructed_md"), masking))
    return rows.select(
        "deck_id",
        "slide_index",
        "title",
        "notes",
        headings.alias("heading_lines"),
        F.when(F.col("reconstructed_md").isNotNull(), rebuilt).otherwise(parts).alias("body_parts"),
        fallback.alias("title_is_fallback"),
        F.exists("shapes", lambda s: (s["kind"] == "image") & F.coalesce(s["classification"] == "diagram", F.lit(False))).alias("has_diagram"),
    )


def assemble_slides(slides: DataFrame, shapes: DataFrame, *, masking: MaskingOptions | None = None, table_fallback: str = "mermaid") -> DataFrame:
    """(deck_id, slide_index, markdown) of single slides."""
    rendered = render_slides(slides, shapes, masking=masking, table_fallback=table_fallback)
    return rendered.select("deck_id", "slide_index", F.array_join(F.concat("heading_lines", "body_parts"), "\n\n").alias("markdown"))
