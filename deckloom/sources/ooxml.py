"""Deck packages (zip of XML parts) read with the standard library.

``records`` turns one file's bytes into rows of :data:`deckloom.schema.RECORDS`.
A shape that fails becomes a row of kind ``other``; only a package that cannot
be opened is an error, as ``ParseError`` or a row with ``error``.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from deckloom.errors import ParseError

# Namespaces and names of the file format.
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
TYPES = "{http://schemas.openxmlformats.org/package/2006/content-types}"
TABLE_URI = "http://schemas.openxmlformats.org/drawingml/2006/table"
CHART_URI = "http://schemas.openxmlformats.org/drawingml/2006/chart"
DIAGRAM_URI = "http://schemas.openxmlformats.org/drawingml/2006/diagram"
OLE_URI = "http://schemas.openxmlformats.org/presentationml/2006/ole"
TITLE_TYPES = {"title": "TITLE", "ctrTitle": "CENTER_TITLE", "subTitle": "SUBTITLE"}
FOOTER_TYPES = ("ftr", "sldNum", "dt")

_EMPTY = {
    "source_path": None, "slide_width_emu": None, "slide_height_emu": None, "title": None, "notes": None, "slide_index": None, "path": None,
    "kind": None, "shape_id": None, "name": None, "left": None, "top": None, "width": None, "height": None, "paragraphs": None,
    "is_title": None, "is_footer": None, "rows": None, "n_rows": None, "n_cols": None, "image_bytes": None, "image_format": None,
    "image_ext": None, "alt_text": None, "mso_shape_type": None, "fallback_text": None, "classification": None, "description": None,
    "features": None, "error": None,
}


def _number(value: str | None) -> int:
    try:
        return int(value or 0)
    except ValueError:
        return 0


class Package:
    """Parts of a deck by name, with their relationships."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
            self.names = set(self.zip.namelist())
            self.types = self._types()
            self.main = next(t for kind, t in self.relations("").values() if kind.endswith("/officeDocument"))
            self.root = self.xml(self.main)
        except Exception as e:
            raise ParseError(f"not a deck package: {type(e).__name__}") from e
        if self.root.tag != P + "presentation":
            raise ParseError("not a deck package: another kind of document")

    def _types(self) -> dict[str, str]:
        root = ElementTree.fromstring(self.zip.read("[Content_Types].xml"))
        found = {e.get("Extension", "").lower(): e.get("ContentType", "") for e in root.iter(TYPES + "Default")}
        return found | {e.get("PartName", ""): e.get("ContentType", "") for e in root.iter(TYPES + "Override")}

    def content_type(self, part: str) -> str:
        return self.types.get("/" + part) or self.types.get(part.rpartition(".")[2].lower(), "")

    def xml(self, part: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(part))

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """Relationship id to (type, target part)."""
        folder, _, name = part.rpartition("/")
        path = posixpath.join(folder, "_rels", f"{name}.rels")
        if path not in self.names:
            return {}
        found = {}
        for e in ElementTree.fromstring(self.zip.read(path)).iter(REL + "Relationship"):
            target = e.get("Target", "")
            if e.get("TargetMode") != "External":
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            found[e.get("Id", "")] = (e.get("Type", ""), target)
        return found

    def slides(self) -> list[str]:
        relations = self.relations(self.main)
        ids = self.root.find(P + "sldIdLst")
        return [relations[e.get(R + "id")][1] for e in (ids if ids is not None else ())]


def _paragraph_text(paragraph: ElementTree.Element, *, breaks: bool) -> str:
    """Runs joined; ``breaks`` adds line breaks, as vertical tabs, and fields."""
    runs = "".join(t.text or "" for r in paragraph.findall(A + "r") for t in r.findall(A + "t"))
    if not breaks and paragraph.find(A + "r") is not None:
        return runs
    out = []
    for e in paragraph:
        if e.tag in (A + "r", A + "fld"):
            out += [t.text or "" for t in e.findall(A + "t")]
        elif e.tag == A + "br":
            out.append("\x0b")
    return "".join(out)


def _frame_text(body: ElementTree.Element | None) -> str:
    return "\n".join(_paragraph_text(p, breaks=True) for p in body.findall(A + "p")) if body is not None else ""


def _placeholder(shape: ElementTree.Element) -> ElementTree.Element | None:
    return shape.find(f"./*/{P}nvPr/{P}ph")


class _Slide:
    def __init__(self, package: Package, part: str):
        self.package, self.part = package, part
        self.relations = package.relations(part)
        self.tree = package.xml(part).find(f"{P}cSld/{P}spTree")
        self.layouts = self._layouts()

    def _layouts(self) -> list[ElementTree.Element]:
        """Shape trees of the slide's layout and its master."""
        trees, relations = [], self.relations
        for ending in ("/slideLayout", "/slideMaster"):
            target = next((t for kind, t in relations.values() if kind.endswith(ending)), None)
            if target is None or target not in self.package.names:
                break
            tree = self.package.xml(target).find(f"{P}cSld/{P}spTree")
            if tree is not None:
                trees.append(tree)
            relations = self.package.relations(target)
        return trees

    def bounds(self, shape: ElementTree.Element) -> tuple[int, int, int, int]:
        """Left, top, width, height; a placeholder without its own takes those
        of the layout's."""
        for own in self._inheritance(shape):
            frame = own.find(f"{P}spPr/{A}xfrm")
            frame = frame if frame is not None else own.find(f"{P}grpSpPr/{A}xfrm")
            frame = frame if frame is not None else own.find(f"{P}xfrm")
            if frame is not None:
                at, size = frame.find(A + "off"), frame.find(A + "ext")
                get = lambda e, k: _number(e.get(k)) if e is not None else 0
                return get(at, "x"), get(at, "y"), get(size, "cx"), get(size, "cy")
        return 0, 0, 0, 0

    def _inheritance(self, shape: ElementTree.Element) -> Iterator[ElementTree.Element]:
        yield shape
        mark = _placeholder(shape)
        if mark is None:
            return
        kind, index = mark.get("type", "obj"), mark.get("idx", "0")
        for n, tree in enumerate(self.layouts):
            for other in tree:
                own = _placeholder(other)
                if own is not None and (own.get("idx", "0") == index if n == 0 else own.get("type", "obj") == kind):
                    yield other
                    break

    def placeholder_type(self, mark: ElementTree.Element) -> str:
        if mark.get("type"):
            return mark.get("type", "")
        for tree in self.layouts[:1]:
            for other in tree:
                own = _placeholder(other)
                if own is not None and own.get("idx", "0") == mark.get("idx", "0"):
                    return own.get("type", "obj")
        return "obj"

    def title(self) -> str:
        for shape in self.tree if self.tree is not None else ():
            mark = _placeholder(shape)
            if mark is not None and mark.get("idx", "0") == "0" and shape.tag == P + "sp":
                return _frame_text(shape.find(P + "txBody"))
        return ""

    def notes(self) -> str:
        target = next((t for kind, t in self.relations.values() if kind.endswith("/notesSlide")), None)
        if target is None:
            return ""
        for shape in self.package.xml(target).iter(P + "sp"):
            mark = _placeholder(shape)
            if mark is not None and mark.get("type") == "body":
                return _frame_text(shape.find(P + "txBody"))
        return ""

    def shapes(self, tree: ElementTree.Element | None = None, path: tuple[int, ...] = ()) -> Iterator[dict]:
        tree = tree if tree is not None else self.tree
        known = (P + "sp", P + "pic", P + "grpSp", P + "graphicFrame", P + "cxnSp", P + "contentPart")
        for n, shape in enumerate(e for e in (tree if tree is not None else ()) if e.tag in known):
            yield from self.shape(shape, (*path, n))

    def shape(self, shape: ElementTree.Element, path: tuple[int, ...]) -> Iterator[dict]:
        own = shape.find(f"./*/{P}cNvPr")
        named = {"shape_id": _number(own.get("id")) if own is not None else 0, "name": own.get("name", "") if own is not None else ""}
        row = {"path": list(path), **named}
        row |= dict(zip(("left", "top", "width", "height"), self.bounds(shape), strict=True))
        below: list[dict] = []
        try:
            if shape.tag == P + "grpSp":
                row["kind"] = "group"
                below = list(self.shapes(shape, path))
            elif shape.tag == P + "pic":
                row |= {"kind": "image"} | self.picture(shape)
            elif shape.find(f"{A}graphic/{A}graphicData/{A}tbl") is not None:
                row |= {"kind": "table"} | self.table(shape)
            elif shape.tag == P + "sp":
                row |= {"kind": "text"} | self.text(shape)
            else:
                row |= {"kind": "other"} | self.other(shape)
        except Exception:  # one bad shape leaves the others whole
            row |= {"kind": "other", "mso_shape_type": "UNKNOWN", "fallback_text": ""}
        yield row
        yield from below

    def text(self, shape: ElementTree.Element) -> dict:
        mark, title, footer = _placeholder(shape), False, False
        if mark is not None:
            kind = self.placeholder_type(mark)
            title, footer = "TITLE" in TITLE_TYPES.get(kind, ""), kind in FOOTER_TYPES
        paragraphs = []
        for p in shape.findall(f"{P}txBody/{A}p"):
            settings = p.find(A + "pPr")
            paragraphs.append((_paragraph_text(p, breaks=False), _number(settings.get("lvl")) if settings is not None else 0))
        return {"paragraphs": [{"text": t, "level": n} for t, n in paragraphs], "is_title": title, "is_footer": footer}

    def table(self, shape: ElementTree.Element) -> dict:
        grid = shape.find(f"{A}graphic/{A}graphicData/{A}tbl")
        rows = [[_frame_text(c.find(A + "txBody")) for c in r.findall(A + "tc")] for r in grid.findall(A + "tr")]
        return {"rows": rows, "n_rows": len(rows), "n_cols": max(map(len, rows), default=0)}

    def picture(self, shape: ElementTree.Element) -> dict:
        blip = shape.find(f"{P}blipFill/{A}blip")
        target = self.relations.get(blip.get(R + "embed", ""), ("", ""))[1] if blip is not None else ""
        found = {"image_bytes": b"", "image_format": "", "image_ext": "", "alt_text": ""}
        if target:
            kind = self.package.content_type(target)
            form = kind.rpartition("/")[2].lower()
            found |= {"image_format": form, "image_ext": target.rpartition(".")[2].lower() if "." in target else form}
            if target in self.package.names:
                found["image_bytes"] = self.package.zip.read(target)
        described = shape.find(f"{P}nvPicPr/{A}cNvPr")  # only this namespace counts as alt text
        return found | {"alt_text": described.get("descr", "") if described is not None else ""}

    def other(self, shape: ElementTree.Element) -> dict:
        data = shape.find(f"{A}graphic/{A}graphicData")
        uri = data.get("uri", "") if data is not None else ""
        chart = data.find(C + "chart") if data is not None else None
        if shape.tag == P + "cxnSp":
            kind = "LINE"
        elif chart is not None or uri == CHART_URI:
            kind = "CHART"
        elif uri == DIAGRAM_URI:
            kind = "DIAGRAM"
        elif uri == OLE_URI:
            ole = data.find(f".//{P}oleObj")
            kind = "LINKED_OLE_OBJECT" if ole is not None and ole.find(P + "link") is not None else "EMBEDDED_OLE_OBJECT"
        else:
            kind = "GRAPHIC_FRAME" if uri else "UNKNOWN"
        texts = [t.text.strip() for t in shape.iter(A + "t") if t.text and t.text.strip()]
        if chart is not None:
            target = self.relations.get(chart.get(R + "id", ""), ("", ""))[1]
            if target in self.package.names:
                root = self.package.xml(target)
                texts += [t.text.strip() for t in root.iter(A + "t") if t.text and t.text.strip()]
                texts += [v.text.strip() for cache in root.iter(C + "strCache") for v in cache.iter(C + "v") if v.text and v.text.strip()]
        return {"mso_shape_type": kind, "fallback_text": " ".join(dict.fromkeys(texts))}


def records(deck_id: str, source_path: str, data: bytes) -> Iterator[dict]:
    """All rows of a deck; raises :class:`ParseError`."""
    package = Package(data)
    size = package.root.find(P + "sldSz")
    width, height = (_number(size.get(k)) if size is not None else 0 for k in ("cx", "cy"))
    base = _EMPTY | {"deck_id": deck_id}
    yield base | {"record": "deck", "source_path": source_path, "slide_width_emu": width, "slide_height_emu": height}
    for index, part in enumerate(package.slides()):
        try:
            slide = _Slide(package, part)
        except Exception as e:
            raise ParseError(f"broken slide: {type(e).__name__}") from e
        texts = {}
        for name in ("title", "notes"):
            try:
                texts[name] = getattr(slide, name)()
            except Exception:  # neither stops a slide
                texts[name] = ""
        yield base | {"record": "slide", "slide_index": index} | texts
        for row in slide.shapes():
            yield base | {"record": "shape", "slide_index": index} | row
