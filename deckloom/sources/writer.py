"""Minimal deck packages, for tests and for decks made from tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, quoteattr

from deckloom.sources import ooxml

_NS = " ".join(
    f'xmlns:{k}="{v.strip("{}")}"' for k, v in {"p": ooxml.P, "a": ooxml.A, "r": ooxml.R, "c": ooxml.C}.items()
)
_OFFICE = ooxml.R.strip("{}")


def _frame(left: int, top: int, width: int, height: int, tag: str = "a:xfrm") -> str:
    return f'<{tag}><a:off x="{left}" y="{top}"/><a:ext cx="{width}" cy="{height}"/></{tag}>'


def _body(paragraphs: Sequence[tuple[str, int]], tag: str = "p:txBody") -> str:
    def runs(text: str) -> str:
        return "<a:br/>".join(f"<a:r><a:t>{escape(t)}</a:t></a:r>" if t else "" for t in text.split("\x0b"))

    inner = "".join(f'<a:p><a:pPr lvl="{level}"/>{runs(text)}</a:p>' for text, level in paragraphs)
    return f"<{tag}><a:bodyPr/>{inner}</{tag}>"


@dataclass
class SlideXml:
    """A slide under construction: shapes as XML, parts that they need."""

    shapes: list[str] = field(default_factory=list)
    parts: list[tuple[str, str, bytes, str]] = field(default_factory=list)  # relation id, kind, content, extension
    notes: str = ""

    def _head(self, tag: str, name: str, mark: str = "") -> str:
        return f'<p:{tag}><p:cNvPr id="{len(self.shapes) + 2}" name={quoteattr(name)}/><p:cNvSpPr/><p:nvPr>{mark}</p:nvPr></p:{tag}>'

    def text(self, paragraphs: Sequence[tuple[str, int]], at=(0, 0, 0, 0), placeholder: str | None = None, index: int = 0) -> SlideXml:
        mark = f'<p:ph type="{placeholder}" idx="{index}"/>' if placeholder else ""
        self.shapes.append(f"<p:sp>{self._head('nvSpPr', 'Text', mark)}<p:spPr>{_frame(*at)}</p:spPr>{_body(paragraphs)}</p:sp>")
        return self

    def table(self, rows: Sequence[Sequence[str]], at=(0, 0, 0, 0)) -> SlideXml:
        cell = lambda c: f"<a:tc>{_body([(p, 0) for p in c.split(chr(10))], 'a:txBody')}</a:tc>"
        inner = "".join(f"<a:tr>{''.join(map(cell, r))}</a:tr>" for r in rows)
        data = f'<a:graphic><a:graphicData uri="{ooxml.TABLE_URI}"><a:tbl>{inner}</a:tbl></a:graphicData></a:graphic>'
        self.shapes.append(f"<p:graphicFrame>{self._head('nvGraphicFramePr', 'Table')}{_frame(*at, tag='p:xfrm')}{data}</p:graphicFrame>")
        return self

    def _part(self, kind: str, content: bytes, extension: str) -> str:
        self.parts.append((f"rIdP{len(self.parts)}", kind, content, extension))
        return self.parts[-1][0]

    def image(self, content: bytes, extension: str = "png", at=(0, 0, 0, 0)) -> SlideXml:
        rid = self._part("image", content, extension)
        fill = f'<p:blipFill><a:blip r:embed="{rid}"/></p:blipFill><p:spPr>{_frame(*at)}</p:spPr>'
        self.shapes.append(f"<p:pic>{self._head('nvPicPr', 'Picture')}{fill}</p:pic>")
        return self

    def connector(self, at=(0, 0, 0, 0)) -> SlideXml:
        self.shapes.append(f"<p:cxnSp>{self._head('nvCxnSpPr', 'Connector')}<p:spPr>{_frame(*at)}</p:spPr></p:cxnSp>")
        return self

    def chart(self, title: str, categories: Sequence[str], series: str, at=(0, 0, 0, 0)) -> SlideXml:
        cache = lambda values: "<c:strCache>" + "".join(f"<c:pt><c:v>{escape(v)}</c:v></c:pt>" for v in values) + "</c:strCache>"
        xml = f"<c:chartSpace {_NS}><c:title><a:p><a:r><a:t>{escape(title)}</a:t></a:r></a:p></c:title>{cache([series])}{cache(categories)}</c:chartSpace>"
        rid = self._part("chart", xml.encode(), "xml")
        data = f'<a:graphic><a:graphicData uri="{ooxml.CHART_URI}"><c:chart r:id="{rid}"/></a:graphicData></a:graphic>'
        self.shapes.append(f"<p:graphicFrame>{self._head('nvGraphicFramePr', 'Chart')}{_frame(*at, tag='p:xfrm')}{data}</p:graphicFrame>")
        return self

    def diagram(self, texts: Sequence[str], at=(0, 0, 0, 0)) -> SlideXml:
        inner = "".join(f"<a:t>{escape(t)}</a:t>" for t in texts)
        data = f'<a:graphic><a:graphicData uri="{ooxml.DIAGRAM_URI}">{inner}</a:graphicData></a:graphic>'
        self.shapes.append(f"<p:graphicFrame>{self._head('nvGraphicFramePr', 'Diagram')}{_frame(*at, tag='p:xfrm')}{data}</p:graphicFrame>")
        return self

    def group(self, inner: SlideXml, at=(0, 0, 0, 0)) -> SlideXml:
        shift = {rid: self._part(kind, content, ext) for rid, kind, content, ext in inner.parts}
        body = "".join(inner.shapes)
        for old, new in shift.items():
            body = body.replace(f'"{old}"', f'"_{new}"')
        self.shapes.append(f"<p:grpSp>{self._head('nvGrpSpPr', 'Group')}<p:grpSpPr>{_frame(*at)}</p:grpSpPr>{body.replace(chr(34) + '_rId', chr(34) + 'rId')}</p:grpSp>")
        return self


def _relations(rows: Sequence[tuple[str, str, str]]) -> str:
    inner = "".join(f'<Relationship Id="{i}" Type="{_OFFICE}/{kind}" Target="{target}"/>' for i, kind, target in rows)
    return f'<Relationships xmlns="{ooxml.REL.strip("{}")}">{inner}</Relationships>'


def write_deck(slides: Sequence[SlideXml], *, width: int = 9_144_000, height: int = 6_858_000) -> bytes:
    """The package's bytes; the same slides give the same bytes."""
    parts: dict[str, bytes] = {}
    ids = "".join(f'<p:sldId id="{256 + n}" r:id="rId{n}"/>' for n in range(len(slides)))
    parts["ppt/presentation.xml"] = f'<p:presentation {_NS}><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="{width}" cy="{height}"/></p:presentation>'.encode()
    parts["_rels/.rels"] = _relations([("rId1", "officeDocument", "ppt/presentation.xml")]).encode()
    parts["ppt/_rels/presentation.xml.rels"] = _relations([(f"rId{n}", "slide", f"slides/slide{n + 1}.xml") for n in range(len(slides))]).encode()
    extensions = {"xml": "application/xml", "rels": "application/vnd.openxmlformats-package.relationships+xml"}
    for n, slide in enumerate(slides, 1):
        parts[f"ppt/slides/slide{n}.xml"] = f"<p:sld {_NS}><p:cSld><p:spTree>{''.join(slide.shapes)}</p:spTree></p:cSld></p:sld>".encode()
        relations = []
        for rid, kind, content, extension in slide.parts:
            name = f"{kind}s/slide{n}_{rid}.{extension}"
            parts[f"ppt/{name}"] = content
            extensions.setdefault(extension, f"image/{'jpeg' if extension == 'jpg' else extension}")
            relations.append((rid, kind, f"../{name}"))
        if slide.notes:
            note = f'<p:sp><p:nvSpPr><p:cNvPr id="2" name="Notes"/><p:cNvSpPr/><p:nvPr><p:ph type="body" idx="1"/></p:nvPr></p:nvSpPr>{_body([(t, 0) for t in slide.notes.split(chr(10))])}</p:sp>'
            parts[f"ppt/notesSlides/notesSlide{n}.xml"] = f"<p:notes {_NS}><p:cSld><p:spTree>{note}</p:spTree></p:cSld></p:notes>".encode()
            relations.append(("rIdNotes", "notesSlide", f"../notesSlides/notesSlide{n}.xml"))
        parts[f"ppt/slides/_rels/slide{n}.xml.rels"] = _relations(relations).encode()
    types = "".join(f'<Default Extension="{e}" ContentType="{t}"/>' for e, t in sorted(extensions.items()))
    parts["[Content_Types].xml"] = f'<Types xmlns="{ooxml.TYPES.strip("{}")}">{types}</Types>'.encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), content)
    return out.getvalue()
