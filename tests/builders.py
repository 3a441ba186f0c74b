"""Documents and archives that the tests are made of."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path


def book(title: str, first: str = "", last: str = "", lang: str = "en", extra: str = "", tail: str = "") -> str:
    return (
        '<?xml version="1.0" encoding="UTF-8"?>\n<FictionBook xmlns:l="x"><description><title-info>'
        f"<genre>travel</genre><author><first-name>{first}</first-name><last-name>{last}</last-name></author>"
        f"<book-title>{title}</book-title><date>1987</date><lang>{lang}</lang>"
        f'<sequence name="Coasts" number="7"/>{extra}</title-info></description>'
        f"<body><p>text</p></body>{tail}</FictionBook>"
    )


def write_zip(path: Path, entries: dict[str, str | bytes], method: int = zipfile.ZIP_DEFLATED) -> None:
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", method) as archive:
        for name, content in entries.items():
            archive.writestr(name, content)
    path.write_bytes(packed.getvalue())
