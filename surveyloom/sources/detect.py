"""What metadata a survey directory holds, by file names and contents (PAR-19, PAR-21)."""

from __future__ import annotations

import re
from pathlib import Path

from ..model import Metadata
from . import parsers
from .merge import merged
from .parsers.dictionaries import HEADER, NAMES

# Marks of French files in names.
FRENCH = re.compile(r"(?i)(^|[/_\-. ])(fra|fr|french|fran[cç]ais|f)([/_\-. ]|$)")
#: Ends of stems that mark French files without a mark before them.
FRENCH_END = re.compile(r"(?i)(fre|(spss|sas)f|dictionnaire|livredescodes)$")
#: What names of texts that were extracted from PDFs hold, and what such texts hold.
EXTRACTED = {"dictionary": "pdf_dict", "dictionnaire": "pdf_dict", "codebook": "pdf_codebook", "livredescodes": "pdf_codebook"}
KNOWN_BY = {"pdf_dict": (HEADER,), "pdf_codebook": NAMES}
#: Roles by what the name's stem ends in; the order matters, as ``vare`` ends in ``e``.
SPLIT = {"vare": "labels_en", "varf": "labels_fr", "vale": "codes_en", "valf": "codes_fr", "miss": "missing", "_i": "layout"}
CARDS = {".lay": "layout", ".lbe": "labels_en", ".lbf": "labels_fr", ".cde": "codes_en", ".cdf": "codes_fr", ".mvs": "missing"}


def read_text(path: Path, encoding: str) -> str:
    data = path.read_bytes()
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode(encoding, "replace")


def is_french(path: Path, root: Path) -> bool:
    return bool(FRENCH.search(str(path.relative_to(root).with_suffix(""))) or FRENCH_END.search(path.stem))


def _by_language(texts: list[tuple[Path, str]], root: Path) -> dict[str, str]:
    """One English text and, if there is another, the French one: told by name, else
    of several the one that has the most accented letters, if any has more."""
    french = [x for p, x in texts if is_french(p, root)]
    english = [x for p, x in texts if not is_french(p, root)]
    if not french and len(english) > 1:
        accents = [sum(c >= "\xc0" for c in x) for x in english]
        if max(accents) > min(accents):
            french = [english.pop(accents.index(max(accents)))]
    if not english:
        return {"english": french[0]}
    return {"english": english[0]} | ({"french": french[0]} if french else {})


def unique_file(directory: str, ending: str, mask: str | None = None) -> Path:
    """PAR-22: the one command file or layout card that is meant. Names must match
    ``mask``, if there is one; of several the one counts that no other equals in
    having the ending, and then in having it right after the mask."""
    found = {p.name: p for p in Path(directory).glob("*") if p.suffix.lower() in (".sps", ".lay")}
    if mask in found:
        return found[mask]
    after = f"{mask or ''}{'' if ending.startswith('_') or not mask else '_'}{ending}"
    score = {name: (bool(re.search(ending, name)), bool(re.search(after, name))) for name in found if not mask or re.search(mask, name)}
    best = sorted(name for name, points in score.items() if points == max(score.values()))
    if len(best) == 1:
        return found[best[0]]
    raise FileNotFoundError(f"{'several layout files: ' + ', '.join(best) if best else 'no layout file'} in {directory}")


def detect(directory: str, mask: str | None = None, encoding: str = "CP1252") -> dict[str, dict[str, str]]:
    """Format to the texts of its parts; only files whose names match the mask.

    Dictionaries and codebooks are texts that were extracted from PDFs. A codebook
    is taken where there is nothing else.
    """
    root = Path(directory)
    found: dict[str, dict[str, str]] = {}
    by_kind: dict[str, list[tuple[Path, str]]] = {}
    for p in sorted(root.rglob("*"), key=lambda p: (len(p.parts), str(p))):
        name = p.name.lower()
        if not p.is_file() or "metadata" in p.relative_to(root).parts[:-1]:
            continue
        in_mask = mask is None or re.search(mask, p.name)
        if name.endswith((".sps", ".xmf", "spss.txt")) and in_mask:
            role = next((r for end, r in SPLIT.items() if p.stem.lower().endswith(end)), None) if name.endswith(".sps") else None
            text = read_text(p, encoding)
            if role:
                found.setdefault("spss_split", {}).setdefault(role, text)
            elif re.search(r"(?i)VARIABLE\s+LABELS|VALUE\s+LABELS", text):
                by_kind.setdefault("spss_mono", []).append((p, text))
        elif name.endswith(".sav") and in_mask:
            found.setdefault("spss_sav", {}).setdefault("path", str(p))
        elif name.endswith(".sas"):
            if re.search(r"(?im)^\s*LABEL\s+[a-z]", text := read_text(p, encoding)):
                by_kind.setdefault("sas_labels", []).append((p, text))
        elif p.suffix.lower() in CARDS and in_mask:
            found.setdefault("sas_cards", {}).setdefault(CARDS[p.suffix.lower()], read_text(p, encoding))
        elif name.endswith(".txt") and (kind := next((k for word, k in EXTRACTED.items() if word in name), None)) and "zerofreq" not in name:
            text = read_text(p, encoding)
            if any(x in text.lower() for x in (KNOWN_BY[kind])):
                by_kind.setdefault(kind, []).append((p, text))
        elif name.endswith(".csv"):
            with p.open("rb") as f:
                head = f.readline().decode(encoding, "replace").lower()
            if "field_champ" in head or head.startswith("field") and "englishlabel" in head:
                found.setdefault("lfs_csv", {}).setdefault("text", read_text(p, encoding))
            elif "variable name - english" in head:
                found.setdefault("cpss_csv", {}).setdefault("text", read_text(p, encoding))
    if set(found.get("spss_split", {})) < {"layout", "labels_en"}:
        found.pop("spss_split", None)
    found |= {kind: _by_language(texts, root) for kind, texts in by_kind.items()}
    if {"spss_mono", "spss_split"} & set(found):
        found.pop("spss_sav", None)  # only where there is no command file
    if "sas_cards" in found:
        found.pop("sas_labels", None)
    if len(found) > 1:
        found.pop("pdf_codebook", None)
    return found


def parse(directory: str, mask: str | None = None, encoding: str = "CP1252", english: str | None = None) -> Metadata:
    """All that is found, parsed and merged. With the text of an ``english`` command
    file from elsewhere, the one that is found is the French."""
    readers = {
        "spss_mono": lambda t: parsers.parse_mono(t["english"], t.get("french")),
        "spss_split": lambda t: parsers.parse_split(t["layout"], t["labels_en"], t.get("codes_en", ""), t.get("missing", ""), t.get("labels_fr", ""), t.get("codes_fr", "")),
        "sas_cards": lambda t: parsers.parse_cards(t.get("layout", ""), t.get("labels_en", ""), t.get("codes_en", ""), t.get("missing", ""), t.get("labels_fr", ""), t.get("codes_fr", "")),
        "spss_sav": lambda t: parsers.parse_sav(Path(t["path"]).read_bytes(), encoding),
        "lfs_csv": lambda t: parsers.parse_lfs_codebook(t["text"]),
        "cpss_csv": lambda t: parsers.parse_cpss(t["text"]),
        "sas_labels": lambda t: parsers.parse_labels(t["english"], t.get("french", "")),
        "pdf_dict": lambda t: parsers.parse_dictionary(t["english"], t.get("french", "")),
        "pdf_codebook": lambda t: parsers.parse_codebook(t["english"], t.get("french", "")),
    }
    found = detect(directory, mask, encoding)
    if english is not None:
        own = found.get("spss_mono", {})
        found["spss_mono"] = {"english": english} | ({"french": own.get("french", own["english"])} if own else {})
    if not found:
        raise FileNotFoundError(f"no command file or codebook in {directory}")
    return merged({k: readers[k](t) for k, t in found.items()})
