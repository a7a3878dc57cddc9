"""Which documents of a survey to show first (DOC-01)."""

from __future__ import annotations

import re
import zipfile
from pathlib import Path

from ..functions.text import language_score_of


def documents(folder: str, lang: str = "eng", mask: str | None = None) -> list[str]:
    """PDFs of the folder, else of its archives, else of its parent, else text files;
    those that match the mask, in the wanted language first, else in order of
    their paths."""
    root = Path(folder)

    def found(where: Path, ending: str) -> list[str]:
        return sorted(str(p) for p in where.rglob("*") if p.suffix.lower() == ending and (mask is None or re.search(mask, p.name)))

    def packed() -> list[str]:
        out = []
        for z in sorted(root.rglob("*.zip")):
            if zipfile.is_zipfile(z):
                into = z.with_name(z.stem + "_documents")
                with zipfile.ZipFile(z) as archive:
                    for info in archive.infolist():
                        name = Path(info.filename).name
                        if name.lower().endswith(".pdf") and (mask is None or re.search(mask, name)):
                            into.mkdir(exist_ok=True)
                            (into / name).write_bytes(archive.read(info))
                            out.append(str(into / name))
        return sorted(out)

    for look in (lambda: found(root, ".pdf"), packed, lambda: found(root.parent, ".pdf"), lambda: found(root, ".txt")):
        if got := look():
            return sorted(got, key=lambda p: -language_score_of(p, lang))
    return []
