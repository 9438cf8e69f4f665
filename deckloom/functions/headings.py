"""Headings, notes and metadata of slides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deckloom.functions.text import VERTICAL_TAB, is_blank, strip

DELIMITER = "---"
NOTES_HEADER = "> notes"
#: What the frontmatter names as its generator unless told otherwise.
GENERATOR = "deckloom"


def heading_path(title: Column) -> Column:
    """Stripped parts of a title between ``>``, empty ones dropped."""
    return F.filter(F.transform(F.split(title, ">", -1), lambda x: strip(x)), lambda x: x != "")


def heading_lines(title: Column, *, hierarchy: bool = False) -> Column:
    """One second-level heading, or with ``hierarchy`` a chain of them down to
    the sixth level for a title of several parts."""
    plain = F.array(F.concat(F.lit("## "), title))
    if not hierarchy:
        return plain
    parts = heading_path(title)
    chain = F.transform(parts, lambda x, i: F.concat(F.repeat(F.lit("#"), F.least(i + 2, F.lit(6))), F.lit(" "), x))
    return F.when(F.size(parts) > 1, chain).otherwise(plain)


def notes_block(notes: Column) -> Column:
    """Notes as a quotation; blank notes give an empty string."""
    lines = F.replace(F.replace(notes, F.lit(VERTICAL_TAB), F.lit("\n")), F.lit("\n"), F.lit("\n> "))
    return F.when(is_blank(notes), F.lit("")).otherwise(F.concat(F.lit(NOTES_HEADER + "\n> "), lines))


def frontmatter(slide_count: Column, generator: str = GENERATOR) -> Column:
    return F.format_string(f"{DELIMITER}\ngenerator: {generator.replace('%', '%%')}\nslide_count: %d\n{DELIMITER}", slide_count)


def slide_comment(number: Column, section: Column, has_diagram: Column) -> Column:
    """One line of metadata; the section cannot break it."""
    safe = F.replace(F.replace(section, F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("/"))
    flag = F.when(has_diagram, F.lit("true")).otherwise(F.lit("false"))
    return F.concat(
        F.lit("<!-- slide_index: "), number.cast("string"), F.lit(" | section: "), safe, F.lit(" | has_diagram: "), flag, F.lit(" -->")
    )


def section_of(lines: Column) -> Column:
    """Text of the first second-level heading, or an empty string."""
    second = F.filter(lines, lambda x: x.startswith("## ") & ~x.startswith("### "))
    return F.coalesce(strip(F.substr(F.get(second, F.lit(0)), F.lit(4))), F.lit(""))


def body_is_empty(parts: Column) -> Column:
    return is_blank(F.array_join(parts, ""))
