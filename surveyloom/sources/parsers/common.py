from __future__ import annotations

import re
from dataclasses import dataclass, field

from ...functions.convert import NUMBER
from ...model import Code, Field, Metadata, Variable
from ..sentinels import sentinel_ranges


@dataclass
class Facts:
    """What command files tell, before types are derived."""

    labels: dict[str, str] = field(default_factory=dict)
    codes: list[Code] = field(default_factory=list)
    formats: dict[str, tuple[str, int]] = field(default_factory=dict)  # letter, decimals
    missing: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    layout: list[Field] | None = None


def plain(value: str) -> str:
    """An unquoted code: a number without needless zeros, or the text."""
    if re.match(NUMBER, value):
        number = float(value)
        return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)
    return value


def resolve(english: Facts, french: Facts | None = None) -> Metadata:
    """Joins the languages, derives sentinel ranges and types (JOIN-03/04).

    A variable with decimals is numeric; with categories it is character, as
    with an A format; with a missing range, any other format or a place in the
    layout it is numeric; else it is character.
    """
    fr_labels = french.labels if french else {}
    fr_codes: dict[tuple[str, str], str | None] = {}
    for c in french.codes if french else []:
        fr_codes.setdefault((c.name, c.val), c.label_en)
    codes = [Code(c.name, c.val, c.label_en, fr_codes.get((c.name, c.val))) for c in english.codes]
    ranges = sentinel_ranges(Metadata((), tuple(codes)))
    codes = [c for c in codes if c.name not in ranges]
    coded = {c.name for c in codes}
    in_layout = {f.name for f in english.layout or []}
    names = dict.fromkeys([*english.labels, *(f.name for f in english.layout or [])])
    variables = []
    for name in names:
        letter, decimals = english.formats.get(name, ("", 0))
        low, high = english.missing.get(name) or ranges.get(name) or (None, None)
        if decimals > 0:
            kind = "numeric"
        elif name in coded or letter == "A":
            kind = "character"
        elif low is not None or letter or name in in_layout or name in ranges:
            kind = "numeric"
        else:
            kind = "character"
        variables.append(Variable(name, english.labels.get(name), fr_labels.get(name), kind, decimals if kind == "numeric" else None, low, high))
    return Metadata(tuple(variables), tuple(codes), tuple(english.layout) if english.layout is not None else None)


PLACE = re.compile(r"([A-Za-z_@#$][\w.@#$]*)\s+(\d+)(?:\s*-\s*(\d+))?(?:\s*\(([^)]*)\))?")


def layout_items(body: str) -> tuple[list[Field], dict[str, tuple[str, int]]]:
    """``NAME first - last (note)`` items, any number a line."""
    fields, formats = [], {}
    for name, first, last, note in PLACE.findall(body):
        name = name.upper()
        fields.append(Field(name, int(first), int(last or first)))
        note = note.strip().upper()
        if note.isdigit():
            formats[name] = ("F", int(note))
        elif m := re.fullmatch(r"([A-Z]+)(\d*)(?:\.(\d+))?", note):
            formats[name] = (m[1], int(m[3] or 0))
        else:
            formats[name] = ("F", 0)
    return fields, formats


def missing_items(body: str) -> dict[str, tuple[float | None, float | None]]:
    """``NAME (a)``, ``NAME (a THRU b)``; an open end is null."""
    out = {}
    for names, inner in re.findall(r"([A-Za-z_][\w\s.,/]*?)\s*\(([^)]*)\)", body):
        if not (m := re.match(r"\s*([-+.\deE]+)(?:\s+THRU\s*([-+.\deE]*))?", inner, re.I)):
            continue
        low = float(m[1])
        high = low if m[2] is None else float(m[2]) if m[2] else None
        for name in re.split(r"[\s,/]+", names.strip()):
            if name:
                out[name.upper()] = (low, high)
    return out
