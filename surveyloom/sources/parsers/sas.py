"""SAS reading cards: layout, labels, codes and missing values in files of their own."""

from __future__ import annotations

import re
from dataclasses import replace

from ...model import Field, Metadata
from .common import Facts, missing_items, resolve
from .spss import _facts


def at_layout(text: str) -> tuple[list[Field], dict[str, tuple[str, int]]]:
    """PAR-12: ``@position NAME $CHARw.`` or ``w.d`` lines."""
    fields, formats = [], {}
    for start, name, letter, width, decimals in re.findall(r"@\s*(\d+)\s+([A-Za-z_]\w*)\s+(\$(?:CHAR)?)?(\d+)\.(\d*)", text, re.I):
        name = name.upper()
        fields.append(Field(name, int(start), int(start) + int(width) - 1))
        formats[name] = ("A", 0) if letter else ("F", int(decimals or 0))
    return fields, formats


def _sas_labels(text: str) -> dict[str, str]:
    return {n.upper(): x.strip() for n, x in re.findall(r"""([A-Za-z_]\w*)\s*=\s*["']([^"'\n]*)["']""", text)}


def parse_cards(layout: str, labels_en: str, codes_en: str = "", missing: str = "", labels_fr: str = "", codes_fr: str = "") -> Metadata:
    """PAR-14: the six cards; labels in SAS (``NAME = "label"``) or SPSS syntax.

    Codes that are ranges (``a:b``) or have no label are left out.
    """

    def facts(labels: str, codes: str) -> Facts:
        f = _facts(labels + "\n" + codes)
        if not f.labels:
            f.labels = _sas_labels(labels)
        f.codes = [replace(c) for c in f.codes if c.label_en and ":" not in c.val]
        return f

    english = facts(labels_en, codes_en)
    if "@" in layout:
        english.layout, english.formats = at_layout(layout)
    else:
        own = _facts(layout)
        english.layout, english.formats = own.layout, own.formats
    english.missing = missing_items(re.sub(r"(?i)MISSING\s+VALUES", "", missing))
    french = facts(labels_fr, codes_fr) if labels_fr or codes_fr else None
    return resolve(english, french)


def parse_labels(english: str, french: str = "") -> Metadata:
    """PAR-13: ``LABEL name = "..."`` statements, and VALUE blocks whose variables
    the comment before them names (``... format applies to: A B``)."""
    from ...model import Code, Variable

    def read(text: str):
        labels = {n.upper(): x for n, x in re.findall(r'(?im)^\s*LABEL\s+([A-Za-z]\w*)\s*=\s*"([^"]+)"', text)}
        codes: dict[tuple[str, str], str] = {}
        users = {f.upper(): names.upper().split() for f, names in re.findall(r"(?is)/\*\s*(\S+)\s+format applies to:(.*?)\*/", text)}
        for name, body in re.findall(r"(?is)\bVALUE\s+\$?(\w+)\s+(.*?);", text):
            for value, label in re.findall(r"""["']?([^\s"'=]+)["']?\s*=\s*"([^"]*)\"""", body):
                for v in users.get(name.upper(), []):
                    if value.lower() != "other":
                        codes.setdefault((v, value), label.strip())
        return labels, codes

    labels, codes = read(english)
    fr_labels, fr_codes = read(french)
    names = dict.fromkeys([*labels, *(v for v, _ in codes)])
    coded = {v for v, _ in codes}
    variables = tuple(Variable(n, labels.get(n), fr_labels.get(n), "character" if n in coded else "numeric") for n in names)
    return Metadata(variables, tuple(Code(v, x, label, fr_codes.get((v, x))) for (v, x), label in codes.items()))
