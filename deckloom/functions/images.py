"""Image rules, markers and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deckloom.functions.text import MaskingOptions, mask_text

VECTOR_EXTENSIONS = ("emf", "wmf")
# Thresholds of the classes.
TEXT_EDGE_MIN, TEXT_COLORS_MAX, TEXT_BG_MIN, TEXT_COLOR_FRAC_MAX = 0.08, 32, 0.35, 0.05
LOGO_AREA_MAX, LOGO_ASPECT_MIN, LOGO_COLORS_MAX, LOGO_BG_MIN = 16384, 3.0, 48, 0.30
DIAGRAM_COLORS_MAX, DIAGRAM_BG_MIN, DIAGRAM_EDGE_MIN, DIAGRAM_EDGE_MAX, DIAGRAM_COLOR_FRAC_MAX = 128, 0.25, 0.02, 0.30, 0.80
PHOTO_COLORS_MIN, PHOTO_COLOR_FRAC_MIN = 200, 0.30
# What providers are told of an image of each class.
HINTS = {
    "text": "This image appears to contain primarily text; transcribe the text content accurately.",
    "diagram": "This image appears to be a diagram or chart; describe its structure, components, and relationships.",
    "photo": "This image appears to be a photograph; describe the scene and visible objects.",
    "logo": "This image appears to be a logo or icon; identify it concisely.",
}
DIAGRAM_HINT_SUFFIX = (
    "If this is a flowchart or process diagram, additionally output the structure as a Mermaid 'flowchart TD' code block fenced with ```mermaid."
)
# Media types by extension.
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp"}


def image_class(f: Column) -> Column:
    """Class of an image by its features: the first rule that holds, or null."""
    colors, edge, background, colorful = f["n_unique_colors"], f["edge_density"], f["bg_fraction"], f["color_fraction"]
    text = (edge >= TEXT_EDGE_MIN) & (colors <= TEXT_COLORS_MAX) & (background >= TEXT_BG_MIN) & (colorful < TEXT_COLOR_FRAC_MAX)
    small = (f["width"] * f["height"] <= LOGO_AREA_MAX) | (f["aspect_ratio"] >= LOGO_ASPECT_MIN)
    logo = small & (colors <= LOGO_COLORS_MAX) & (f["has_alpha"] | (background >= LOGO_BG_MIN))
    diagram = (colors <= DIAGRAM_COLORS_MAX) & (background >= DIAGRAM_BG_MIN) & (edge >= DIAGRAM_EDGE_MIN) & (edge < DIAGRAM_EDGE_MAX)
    diagram &= colorful < DIAGRAM_COLOR_FRAC_MAX
    photo = (colors >= PHOTO_COLORS_MIN) & (colorful >= PHOTO_COLOR_FRAC_MIN)
    return F.when(text, F.lit("text")).when(logo, F.lit("logo")).when(diagram, F.lit("diagram")).when(photo, F.lit("photo"))


def is_vector(extension: Column) -> Column:
    return F.lower(extension).isin(*VECTOR_EXTENSIONS)


def shape_hint(classification: Column, *, diagram_mermaid: bool = False) -> Column:
    """What a provider is told of an image; null without a class."""
    hint = F.lit(None).cast("string")
    for name, text in HINTS.items():
        if diagram_mermaid and name == "diagram":
            text = f"{text} {DIAGRAM_HINT_SUFFIX}"
        hint = F.when(classification == name, F.lit(text)).otherwise(hint)
    return hint


def prompt(hint: Column, alt_text: Column) -> Column:
    """The request for a description."""
    said = F.when(F.coalesce(alt_text, F.lit("")) != "", F.concat(F.lit("Alt text: "), alt_text))
    return F.concat_ws(" ", F.nullif(hint, F.lit("")), said, F.lit("Describe this image in detail."))


def media_type(extension: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(extension)), F.lit("image/png"))


def image_markdown(
    description: Column, alt_text: Column, classification: Column, slide_number: Column, image_number: Column, masking: MaskingOptions | None = None
) -> Column:
    """The description (an empty one too), else the alt text, else a marker
    with the numbers of the slide and of the image in it."""
    described = mask_text(description, masking)
    labelled = F.concat(described, F.lit("\n\n_["), classification, F.lit(" image]_"))
    place = F.concat(F.lit("![슬라이드 "), slide_number.cast("string"), F.lit(" 이미지 "), image_number.cast("string"))
    return (
        F.when(description.isNotNull(), F.coalesce(labelled, described))
        .when(F.coalesce(alt_text, F.lit("")) != "", F.concat(F.lit("!["), mask_text(alt_text, masking), F.lit("](...)")))
        .otherwise(F.concat(place, F.coalesce(F.concat(F.lit(" — "), classification), F.lit("")), F.lit("]")))
    )
