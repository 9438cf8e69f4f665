"""Text expressions with the white-space rules of Unicode strings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

VERTICAL_TAB = "\x0b"
MASK_TOKEN = "[REDACTED]"
#: E-mail addresses and domestic phone numbers (Java regex).
DEFAULT_PATTERNS = (
    r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    r"(?U)0\d{1,2}[-.\s\x1C-\x1F]\d{3,4}[-.\s\x1C-\x1F]\d{4}",
)
_SPACE = r"[\s\x1C-\x1F]"
_LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


@dataclass(frozen=True)
class MaskingOptions:
    """What to mask; ``patterns``, Java regular expressions, are applied in
    order and replace the default ones."""

    enabled: bool = False
    patterns: tuple[str, ...] = DEFAULT_PATTERNS


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(text, F.lit(rf"(?U)^{_SPACE}+|{_SPACE}+$"), F.lit(""))


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(rf"(?U){_SPACE}+$"), F.lit(""))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def split_lines(text: Column) -> Column:
    """Lines by every line boundary; a final boundary starts no line."""
    lines = F.split(text, _LINE_END, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def normalize_text(text: Column) -> Column:
    """Vertical tabs become line feeds, then runs of spaces and tabs one space."""
    return F.regexp_replace(F.replace(text, F.lit(VERTICAL_TAB), F.lit("\n")), F.lit(r"[ \t]{2,}"), F.lit(" "))


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"\n{3,}"), F.lit("\n\n"))


def mask_text(text: Column, masking: MaskingOptions | None) -> Column:
    """Every match of every pattern replaced by the token; without masking,
    the text."""
    if masking is None or not masking.enabled:
        return text
    for pattern in masking.patterns:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(MASK_TOKEN))
    return text


def mask_count(text: Column, masking: MaskingOptions | None) -> Column:
    """How many matches :func:`mask_text` replaces."""
    total = F.lit(0).cast("long")
    if masking is None or not masking.enabled:
        return total
    for pattern in masking.patterns:
        total = total + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, F.lit(pattern), F.lit(MASK_TOKEN))
    return total


def paragraphs_markdown(paragraphs: Column, masking: MaskingOptions | None = None) -> Column:
    """Paragraphs as lines, those below level 0 as indented bullets."""

    def line(p: Column) -> Column:
        text = mask_text(normalize_text(p["text"]), masking)
        return F.when(p["level"] > 0, F.concat(F.repeat(F.lit("  "), p["level"]), F.lit("- "), text)).otherwise(text)

    return collapse_blank_lines(F.array_join(F.transform(paragraphs, line), "\n"))


def labels(block: Column) -> Column:
    """The distinct stripped lines of a block that are neither blank nor headings."""
    lines = F.transform(split_lines(block), lambda x: strip(x))
    return F.array_distinct(F.filter(lines, lambda x: (x != "") & ~x.startswith("#")))


def join_nonempty(parts: Sequence[Column] | Column, separator: str) -> Column:
    array = parts if isinstance(parts, Column) else F.array(*parts)
    return F.array_join(F.filter(array, lambda x: x != ""), separator)


def data_url(png: Column) -> Column:
    """An image line with the bytes in it, and a blank line after."""
    body = F.regexp_replace(F.base64(png), F.lit(r"[\r\n]"), F.lit(""))
    return F.concat(F.lit("![slide render](data:image/png;base64,"), body, F.lit(")\n\n"))


def flowchart_fence(text: Column) -> Column:
    """The first fenced diagram of a text where it is a flowchart: lines
    without trailing space, no blank ones at its ends; else null."""
    body = F.regexp_extract(text, r"(?is)```mermaid\s*\n(.*?)```", 1)
    found = F.regexp_like(text, F.lit(r"(?is)```mermaid\s*\n(.*?)```"))
    lines = F.transform(split_lines(F.regexp_replace(body, F.lit(r"^\n+|\n+$"), F.lit(""))), lambda x: rstrip(x))
    filled = F.transform(lines, lambda x: x != "")
    first = F.array_position(filled, F.lit(True)).cast("int")
    last = F.size(lines) - F.array_position(F.reverse(filled), F.lit(True)).cast("int") + 1
    kept = F.slice(lines, first, last - first + 1)
    usable = F.regexp_like(strip(kept[0]), F.lit(r"(?i)^(flowchart|graph)\b"))
    return F.when(found & (first > 0) & usable, F.concat(F.lit("```mermaid\n"), F.array_join(kept, "\n"), F.lit("\n```")))
