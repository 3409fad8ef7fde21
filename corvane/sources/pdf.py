"""Page texts of PDF files. The PDF library is optional; without it every file is a failure row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

PAGES = "path string, page int, text string, is_scan boolean, failure string"
#: Share of a page that a single picture must cover to make it a scan.
SCAN_SHARE = 0.8


def _read(path: str, content: bytes) -> list[tuple]:
    if content[:5] != b"%PDF-":
        return [(path, None, None, None, "invalid_pdf_header")]
    try:
        import pypdfium2
    except ImportError:
        return [(path, None, None, None, "reader_unavailable")]
    try:
        document = pypdfium2.PdfDocument(content)
    except pypdfium2.PdfiumError as error:
        return [(path, None, None, None, "encrypted" if "password" in str(error).lower() else "corrupt_structure")]
    out = []
    for number, page in enumerate(document, 1):
        text = page.get_textpage().get_text_range()
        pictures = [o.get_pos() for o in page.get_objects() if o.type == 3]
        area = page.get_width() * page.get_height()
        covered = [(p[2] - p[0]) * (p[3] - p[1]) / area for p in pictures] if area else []
        scan = len(covered) == 1 and covered[0] >= SCAN_SHARE
        out.append((path, number, text or None, scan, None if text.strip() else "empty_page"))
    return out


def parse_pdf_pages(files: DataFrame) -> DataFrame:
    """Rows (path, page, text, is_scan, failure) of binary PDF files (path, content)."""

    def run(batches):
        for batch in batches:
            found = [r for p, c in zip(batch["path"], batch["content"], strict=True) for r in _read(p, bytes(c))]
            yield pd.DataFrame(found, columns=["path", "page", "text", "is_scan", "failure"]).astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(run, PAGES)
