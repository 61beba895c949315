"""Text of PDF files with whichever parser the workers have.

For ``operators.extract.extract_text``, which takes a missing parser like one that fails.
The parsers are imported where they run; ship this package to the workers (``--py-files``).
"""

from __future__ import annotations

from collections.abc import Iterable
from io import BytesIO


def _joined(pages: Iterable[str | None]) -> str:
    return "\n\n".join(page or "" for page in pages)


def _pymupdf(data: bytes) -> str:
    import fitz

    with fitz.open(stream=data, filetype="pdf") as document:
        return _joined(page.get_text() for page in document)


def _pdfminer(data: bytes) -> str:
    from pdfminer.high_level import extract_text

    return extract_text(BytesIO(data))


def _pypdf(data: bytes) -> str:
    from pypdf import PdfReader

    return _joined(page.extract_text() for page in PdfReader(BytesIO(data)).pages)


# In order of preference: the best layout first.
PDF_EXTRACTORS = (("pymupdf", _pymupdf), ("pdfminer", _pdfminer), ("pypdf", _pypdf))
