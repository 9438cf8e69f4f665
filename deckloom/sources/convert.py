"""Renders and vector images through an office program, where there is one."""

from __future__ import annotations

import io
import shutil
import subprocess
import tempfile
from collections.abc import Sequence
from pathlib import Path

PROGRAMS = ("soffice", "soffice.bin", "libreoffice")
DECK_SECONDS, VECTOR_SECONDS, DPI = 90, 30, 150


def office_program() -> str | None:
    return next((found for p in PROGRAMS if (found := shutil.which(p))), None)


def office_available() -> bool:
    return office_program() is not None


def render_available() -> bool:
    """Whether decks can be rendered here, looked up when asked."""
    try:
        import pypdfium2  # noqa: F401
    except Exception:
        return False
    return office_available()


def _converted(data: bytes, name: str, to: str, seconds: int) -> bytes | None:
    """One conversion in a folder of its own; null on any failure."""
    program = office_program()
    if program is None:
        return None
    try:
        with tempfile.TemporaryDirectory() as folder:
            source = Path(folder, name)
            source.write_bytes(data)
            command = [program, "--headless", "--convert-to", to, "--outdir", folder, str(source)]
            done = subprocess.run(command, capture_output=True, timeout=seconds, check=False)
            result = source.with_suffix(f".{to}")
            return result.read_bytes() or None if done.returncode == 0 and result.exists() else None
    except (OSError, subprocess.SubprocessError):
        return None


def convert_vector(data: bytes, extension: str) -> bytes | None:
    """PNG of an EMF or WMF image, or null."""
    extension = extension.lower()
    return _converted(data, f"in.{extension}", "png", VECTOR_SECONDS) if extension in ("emf", "wmf") else None


def render_deck(deck: bytes | str, indices: Sequence[int], *, dpi: int = DPI) -> dict[int, bytes | None]:
    """PNG of slides of a deck, given as bytes or as a path, one conversion for
    all; null where it fails."""
    found: dict[int, bytes | None] = dict.fromkeys(indices)
    if not found or not render_available():
        return found
    try:
        data = deck if isinstance(deck, bytes) else Path(deck.removeprefix("file:")).read_bytes()
    except OSError:
        return found
    pdf = _converted(data, "deck.pptx", "pdf", DECK_SECONDS)
    if pdf is None:
        return found
    try:
        import pypdfium2

        document = pypdfium2.PdfDocument(pdf)
    except Exception:
        return found
    try:
        for index in found:
            if 0 <= index < len(document):
                try:
                    out = io.BytesIO()
                    document[index].render(scale=dpi / 72).to_pil().save(out, format="PNG")
                    found[index] = out.getvalue() or None
                except Exception:  # one page leaves the others whole
                    continue
    finally:
        document.close()
    return found


def render_slide(deck: bytes | str, index: int, *, dpi: int = DPI) -> bytes | None:
    return render_deck(deck, [index], dpi=dpi)[index]
