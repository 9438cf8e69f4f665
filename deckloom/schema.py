"""Tables that decks are read into.

Shapes are rows; a group is only an ordering path, so that no recursive type is
needed: ``path`` is the position in the slide, then in each group below it, and
``ARRAY<INT>`` sorts prefix first, which is depth-first order.
"""

from __future__ import annotations

DECKS = "deck_id STRING, source_path STRING, slide_width_emu BIGINT, slide_height_emu BIGINT"
SLIDES = "deck_id STRING, slide_index INT, title STRING, notes STRING, reconstructed_md STRING"
PARAGRAPHS = "ARRAY<STRUCT<text: STRING, level: INT>>"
SHAPE_FIELDS = (
    "deck_id STRING, slide_index INT, path ARRAY<INT>, kind STRING, shape_id INT, name STRING, `left` BIGINT, top BIGINT, "
    f"width BIGINT, height BIGINT, paragraphs {PARAGRAPHS}, is_title BOOLEAN, is_footer BOOLEAN, rows ARRAY<ARRAY<STRING>>, "
    "n_rows INT, n_cols INT, image_bytes BINARY, image_format STRING, image_ext STRING, alt_text STRING, mso_shape_type STRING, "
    "fallback_text STRING, classification STRING, description STRING"
)
SHAPES = SHAPE_FIELDS
IMAGE_FEATURES = (
    "STRUCT<width: INT, height: INT, aspect_ratio: DOUBLE, n_unique_colors: INT, color_fraction: DOUBLE, edge_density: DOUBLE, "
    "bg_fraction: DOUBLE, has_alpha: BOOLEAN>"
)
#: One row of a deck file: a deck, a slide or a shape; ``record`` says which.
RECORDS = (
    "record STRING, source_path STRING, slide_width_emu BIGINT, slide_height_emu BIGINT, title STRING, notes STRING, "
    f"{SHAPE_FIELDS}, features {IMAGE_FEATURES}, error STRING"
)


def names(ddl: str) -> list[str]:
    """Column names of one of the schemas above, in order."""
    found, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            found.append(ddl[start:i].split()[0].strip("`"))
            start = i + 1
    return found
