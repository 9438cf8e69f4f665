"""Rows of the schemas, and reading strings by the plain rules they follow."""

import re

from deckloom.schema import SHAPES, SLIDES, names


def slide(index, title="", notes="", reconstructed_md=None, deck="d"):
    return deck, index, title, notes, reconstructed_md


def shape(index, path, kind, deck="d", **fields):
    base = dict.fromkeys(names(SHAPES)) | {"left": 0, "top": 0, "width": 0, "height": 0, "deck_id": deck, "slide_index": index, "path": path, "kind": kind}
    if "lines" in fields:
        base["paragraphs"] = [{"text": t, "level": n} for t, n in fields.pop("lines")]
    if "rows" in fields:
        base |= {"n_rows": len(fields["rows"]), "n_cols": max(map(len, fields["rows"]), default=0)}
    base |= fields
    return tuple(base[n] for n in names(SHAPES))


def frames(spark, slides, shapes):
    return spark.createDataFrame(slides, SLIDES), spark.createDataFrame(shapes, SHAPES)


def plain_cells(line):
    cells = re.split(r"(?<!\\)\|", line.strip())
    cells = cells[1:] if cells and cells[0] == "" else cells
    cells = cells[:-1] if cells and cells[-1] == "" else cells
    return [c.replace("\\|", "|") for c in cells]
