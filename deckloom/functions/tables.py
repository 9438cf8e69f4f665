"""Table shapes (rows of cells) as Markdown, fenced text or HTML."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from deckloom.functions.text import VERTICAL_TAB, strip

MAX_CELLS = 50
MAX_COLUMNS = 8
FALLBACKS = ("mermaid", "table-data", "html")


def is_blank_table(rows: Column) -> Column:
    """No rows, or nothing but white space in them."""
    return ~F.exists(rows, lambda row: F.exists(row, lambda cell: strip(cell) != ""))


def has_repeated_cells(rows: Column) -> Column:
    """Equal neighbours in a row, as merged cells leave them."""

    def repeats(row: Column) -> Column:
        cells = F.transform(row, lambda c: strip(c))
        pairs = F.zip_with(cells, F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1))), lambda a, b: (a != "") & a.eqNullSafe(b))
        return F.exists(pairs, lambda p: p)

    return F.exists(rows, repeats)


def is_complex_table(rows: Column, n_rows: Column, n_cols: Column) -> Column:
    """Too many cells or columns by the declared size, or merged cells."""
    return (n_rows * n_cols > MAX_CELLS) | (n_cols > MAX_COLUMNS) | has_repeated_cells(rows)


def sanitise_cell(cell: Column) -> Column:
    """Line breaks as ``<br>``, pipes escaped."""
    lines = F.replace(F.replace(cell, F.lit(VERTICAL_TAB), F.lit("<br>")), F.lit("\n"), F.lit("<br>"))
    return F.replace(lines, F.lit("|"), F.lit("\\|"))


def one_line_cell(cell: Column) -> Column:
    return F.replace(F.replace(cell, F.lit(VERTICAL_TAB), F.lit(" ")), F.lit("\n"), F.lit(" "))


def escape_html(cell: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        cell = F.replace(cell, F.lit(raw), F.lit(safe))
    return cell


def _data_rows(rows: Column) -> Column:
    return F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))


def _pipe_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def gfm_table(rows: Column) -> Column:
    """Header, separator and data rows cut or padded to the header's width."""
    header = F.get(rows, F.lit(0))
    width = F.size(header)

    def fitted(row: Column) -> Column:
        padded = F.concat(row, F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0))))
        return _pipe_row(F.transform(F.slice(padded, 1, width), lambda c: sanitise_cell(c)))

    lines = F.concat(
        F.array(_pipe_row(F.transform(header, lambda c: sanitise_cell(c)))),
        F.array(_pipe_row(F.transform(header, lambda _: F.lit("---")))),
        F.transform(_data_rows(rows), fitted),
    )
    return F.array_join(lines, "\n")


def _fenced(rows: Column, n_rows: Column, n_cols: Column, fence: str, mark: str) -> Column:
    cells: Callable[[Column], Column] = lambda row: F.array_join(F.transform(row, lambda c: one_line_cell(c)), " | ")
    head = F.concat(F.lit(f"{mark}table: "), n_rows.cast("string"), F.lit("x"), n_cols.cast("string"))
    lines = F.concat(
        F.array(F.lit(f"```{fence}"), head, F.concat(F.lit(f"{mark}headers: "), cells(F.get(rows, F.lit(0))))),
        F.transform(_data_rows(rows), lambda r, i: F.concat(F.lit(f"{mark}row "), (i + 1).cast("string"), F.lit(": "), cells(r))),
        F.array(F.lit("```")),
    )
    return F.array_join(lines, "\n")


def mermaid_table(rows: Column, n_rows: Column, n_cols: Column) -> Column:
    return _fenced(rows, n_rows, n_cols, "mermaid", "%% ")


def table_data(rows: Column, n_rows: Column, n_cols: Column) -> Column:
    return _fenced(rows, n_rows, n_cols, "table-data", "")


def html_table(rows: Column) -> Column:
    def row_lines(row: Column, i: Column) -> Column:
        tag = F.when(i == 0, F.lit("th")).otherwise(F.lit("td"))
        cells = F.transform(row, lambda c: F.concat(F.lit("    <"), tag, F.lit(">"), escape_html(c), F.lit("</"), tag, F.lit(">")))
        return F.concat(F.array(F.lit("  <tr>")), cells, F.array(F.lit("  </tr>")))

    lines = F.concat(F.array(F.lit("<table>")), F.flatten(F.transform(rows, row_lines)), F.array(F.lit("</table>")))
    return F.array_join(lines, "\n")


def table_markdown(rows: Column, n_rows: Column, n_cols: Column, fallback: str = "mermaid") -> Column:
    """A pipe table, or the fallback for complex ones; blank ones are empty."""
    if fallback not in FALLBACKS:
        raise ValueError(f"unknown table fallback {fallback!r}")
    other = {"mermaid": mermaid_table, "table-data": table_data}.get(fallback, lambda r, _n, _m: html_table(r))
    return (
        F.when(F.coalesce(is_blank_table(rows), F.lit(True)), F.lit(""))
        .when(is_complex_table(rows, n_rows, n_cols), other(rows, n_rows, n_cols))
        .otherwise(gfm_table(rows))
    )
