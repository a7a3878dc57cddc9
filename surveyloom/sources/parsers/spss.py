"""SPSS command files, in one piece or split by section."""

from __future__ import annotations

import re

from ...model import Code, Metadata
from .common import Facts, layout_items, missing_items, plain, resolve

SECTION = re.compile(r"^\s*(DATA\s+LIST|FORMATS|VARIABLE\s+LABELS|VALUE\s+LABELS|MISSING\s+VALUES|EXECUTE|SAVE|GET|RECODE|COMPUTE|SET)\b", re.I)
STRING = r""""((?:[^"]|"")*)"|'((?:[^']|'')*)'"""


def _joined(text: str) -> str:
    """Tabs to spaces, strings continued by + joined, one kind of quote."""
    text = text.replace("\r", "").replace("\x1a", "").replace("\t", " ")
    text = re.sub(r"(['\"])[ ]*\+\s*\n?\s*(['\"])", "", text)
    return re.sub(r"(?<![A-Za-z])'((?:[^'\n]|'')*)'", lambda m: '"' + m[1].replace("''", "'").replace('"', "''") + '"', text)


def _sections(text: str) -> dict[str, list[str]]:
    """Bodies by section; a section can occur more than once."""
    out: dict[str, list[str]] = {}
    name = None
    for line in _joined(text).split("\n"):
        if re.match(r"^\s*(/\*|\*|COMMENT\b)", line, re.I) and not re.match(r"^\s*\*?\s*/[A-Za-z]", line):
            continue
        if m := SECTION.match(line):
            name = re.sub(r"\s+", " ", m[1].upper())
            out.setdefault(name, []).append("")
            line = line[m.end() :]
        if name:
            out[name][-1] += line + "\n"
    return out


def _end(body: str) -> str:
    """Up to the full stop that ends a command."""
    m = re.search(r"(^|\s)\.\s*$|\.\s*$", re.sub(r'"[^"\n]*"', lambda q: "x" * len(q[0]), body), re.M)
    return body[: m.start()] if m else body


def variable_labels(body: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, label in re.findall(r'^\s*/?\s*([A-Za-z_@#$][\w.@#$]*)\s+"([^"]*)"', body, re.M):
        out.setdefault(name.upper(), label.strip())
    return out


def value_labels(body: str) -> list[Code]:
    """Groups begin with ``/`` or a line of names; each holds value and label pairs.

    Quoted values stay as they are, others are numbers.
    """
    tokens = re.findall(r'"[^"]*"|/|[^\s/"]+', body)
    codes, names, k, fresh = [], [], 0, True
    while k < len(tokens):
        t = tokens[k]
        label = tokens[k + 1] if k + 1 < len(tokens) and tokens[k + 1].startswith('"') else None
        if t == "/":
            names, fresh = [], True
        elif label is not None and not (fresh and not names) and not (fresh and re.match(r"[A-Za-z_@#$]", t) and "".join(tokens[k + 2 : k + 3]).startswith('"')):
            value = t[1:-1].strip() if t.startswith('"') else plain(t.rstrip("."))
            codes += [Code(n, value, label[1:-1].strip() or None) for n in names]
            fresh, k = False, k + 1
        elif re.match(r"[A-Za-z_@#$]", t):
            if not fresh:
                names, fresh = [], True
            names.append(t.strip(",").upper())
        k += 1
    seen: dict[tuple[str, str], Code] = {}
    for c in codes:
        seen.setdefault((c.name, c.val), c)
    return list(seen.values())


def formats(body: str) -> dict[str, tuple[str, int]]:
    out = {}
    for names, letter, decimals in re.findall(r"([A-Za-z_][\w\s.@#$]*?)\s*\(\s*([A-Za-z]+)\d*(?:\.(\d+))?\s*\)", body):
        for n in names.split():
            out.setdefault(n.upper(), (letter.upper(), int(decimals or 0)))
    return out


def _facts(text: str) -> Facts:
    parts = _sections(text)
    f = Facts()
    for body in parts.get("VARIABLE LABELS", []):
        for k, v in variable_labels(_end(body)).items():
            f.labels.setdefault(k, v)
    for body in parts.get("VALUE LABELS", []):
        f.codes += value_labels(_end(body))
    for body in parts.get("DATA LIST", [])[:1]:
        body = re.sub(r"^.*?/", "", body, count=1, flags=re.S)
        f.layout, f.formats = layout_items(_end(body))
    for body in parts.get("FORMATS", [])[:1]:
        f.formats |= formats(_end(body))
    for body in parts.get("MISSING VALUES", []):
        f.missing |= missing_items(_end(body))
    return f


def parse_mono(english: str, french: str | None = None) -> Metadata:
    """PAR-01: a command file of all sections, and its French one if there is one."""
    return resolve(_facts(english), _facts(french) if french else None)


def parse_split(layout: str, labels_en: str, codes_en: str, missing: str = "", labels_fr: str = "", codes_fr: str = "") -> Metadata:
    """PAR-09: one file a section."""
    english, french = _facts("\n".join([layout, labels_en, codes_en, missing])), None
    if labels_fr or codes_fr:
        french = _facts("\n".join([labels_fr, codes_fr]))
    return resolve(english, french)


def layout_of(text: str):
    """The fields of a file that holds a DATA LIST alone."""
    return _facts(text).layout
