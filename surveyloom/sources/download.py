"""Downloads to the driver's disk: whole or not at all (SRC-15, SRC-16)."""

from __future__ import annotations

import shutil
import urllib.error
import urllib.request
from pathlib import Path


class NetworkError(OSError):
    """The file could not be fetched; nothing was left behind."""


def download(url: str, to: str, timeout: float = 60.0) -> str:
    path = Path(to)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    try:
        with urllib.request.urlopen(url, timeout=timeout) as source, part.open("wb") as out:
            shutil.copyfileobj(source, out)
    except (urllib.error.URLError, OSError, ValueError) as e:
        part.unlink(missing_ok=True)
        raise NetworkError(f"{url}: {e}") from e
    part.rename(path)
    return str(path)


def located(folder: str, url: str | None, refresh: bool = False, redownload: bool = False) -> str:
    """The version's folder, with its archive. ``refresh`` clears what was derived,
    ``redownload`` everything, once the new archive is there; what is there is not
    fetched again."""
    root = Path(folder)
    if refresh and not redownload:
        for name in ("metadata", "tables"):
            shutil.rmtree(root / name, ignore_errors=True)
    have = root.exists() and any(p.is_file() for p in root.rglob("*"))
    if redownload or not have:
        if not url:
            raise FileNotFoundError(f"there is no address to fetch {folder} from")
        beside = root.parent / f".{root.name}.download"
        try:
            fresh = Path(download(url, str(beside / url.split("?")[0].rsplit("/", 1)[-1])))
            if redownload:
                shutil.rmtree(root, ignore_errors=True)
            root.mkdir(parents=True, exist_ok=True)
            fresh.rename(root / fresh.name)
        finally:
            shutil.rmtree(beside, ignore_errors=True)
    return str(root)
