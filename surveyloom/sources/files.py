"""Driver-side work on a survey's directory: archives, data files, file names."""

from __future__ import annotations

import re
import zipfile
from pathlib import Path

EXCLUDED = ("metadata", "__macosx")


def unzip(archive: str, into: str) -> list[str]:
    """SRC-14: extracts an archive and those inside it; names that climb out of the
    folder are refused, and a folder in the way of a file gets a new name."""
    root = Path(into)
    root.mkdir(parents=True, exist_ok=True)
    out = []
    with zipfile.ZipFile(archive) as z:
        for info in z.infolist():
            if info.is_dir():
                continue
            to = (root / info.filename).resolve()
            if root.resolve() not in to.parents:
                raise ValueError(f"{info.filename} leaves the folder")
            if to.is_dir() or to == Path(archive).resolve():
                to = to.with_name(to.name + ".file")
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(z.read(info))
            out.append(str(to))
    for inner in [x for x in out if x.lower().endswith((".zip", ".zip.file")) and zipfile.is_zipfile(x)]:
        out += unzip(inner, re.sub(r"(?i)\.zip(\.file)?$", "", inner) + "_zip")
    return out


def find_data_file(directory: str, file_mask: str | None = None, fixed_width: bool = False, weights_mask: str | None = None) -> str:
    """SRC-05: the data file of a survey directory.

    Text or CSV files by preference, without codebooks, layouts and replicate
    weights; of files with one name the shallowest; one must be left.
    """
    endings = (".txt", ".dat", ".asc", ".prn", ".sdf") if fixed_width else (".csv",)
    found: dict[str, Path] = {}
    for p in sorted(Path(directory).rglob("*"), key=lambda p: (len(p.parts), str(p))):
        name = p.name.lower()
        if not p.is_file() or not name.endswith(endings) or any(x.lower() in EXCLUDED for x in p.relative_to(directory).parts[:-1]):
            continue
        if re.search(r"codebook|variables\.csv|layout|(^|[_-])bsw|bootstrap", name) or weights_mask and re.search(weights_mask, p.name):
            continue
        if file_mask is None or re.search(file_mask, p.name):
            found.setdefault(name, p)
    if not found:
        raise FileNotFoundError(f"no data file in {directory}")
    return str(next(iter(found.values())))


def lfs_files(directory: str) -> list[str]:
    """SRC-08: pub*.csv in order, else any CSV that is no codebook."""
    all_csv = sorted(p for p in Path(directory).rglob("*") if p.name.lower().endswith(".csv"))
    pub = [p for p in all_csv if p.name.lower().startswith("pub")]
    return [str(p) for p in pub or [p for p in all_csv if "codebook" not in p.name.lower()]]


def lfs_kind(path: str) -> str:
    """SRC-09: annual if the name's first two digits are over 12, monthly if they
    can be a month, else unknown."""
    m = re.search(r"(\d{2})", Path(path).name)
    return "unknown" if not m else "annual" if int(m[1]) > 12 else "monthly"
