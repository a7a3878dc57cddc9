"""The canonical metadata: variables, codes and layout."""

from __future__ import annotations

import csv
from dataclasses import dataclass, field, replace
from pathlib import Path

VARIABLE_FIELDS = ("name", "label_en", "label_fr", "type", "decimals", "missing_low", "missing_high")
CODE_FIELDS = ("name", "val", "label_en", "label_fr")
LAYOUT_FIELDS = ("name", "start", "end")


@dataclass(frozen=True)
class Variable:
    name: str
    label_en: str | None = None
    label_fr: str | None = None
    type: str = "character"
    decimals: int | None = None
    missing_low: float | None = None
    missing_high: float | None = None


@dataclass(frozen=True)
class Code:
    name: str
    val: str
    label_en: str | None = None
    label_fr: str | None = None


@dataclass(frozen=True)
class Field:
    """Columns ``start`` to ``end`` of a fixed-width line, from 1, both included."""

    name: str
    start: int
    end: int


@dataclass(frozen=True)
class Metadata:
    """A survey file's metadata; the order of each list is the file's order."""

    variables: tuple[Variable, ...] = ()
    codes: tuple[Code, ...] = ()
    layout: tuple[Field, ...] | None = None

    def upper(self) -> Metadata:
        up = lambda xs: tuple(replace(x, name=x.name.upper()) for x in xs)
        return Metadata(up(self.variables), up(self.codes), None if self.layout is None else up(self.layout))

    def validate(self) -> Metadata:
        """Checks types and that no name is empty; returns self."""
        for v in self.variables:
            if v.type not in ("character", "numeric"):
                raise ValueError(f"variable {v.name}: type {v.type!r} is neither character nor numeric")
        for x in (*self.variables, *self.codes, *(self.layout or ())):
            if not x.name:
                raise ValueError("a metadata row has no name")
        for f in self.layout or ():
            if f.start < 1 or f.end < f.start:
                raise ValueError(f"layout of {f.name}: {f.start} to {f.end}")
        return self

    def codes_of(self, name: str) -> list[Code]:
        """The codes of a variable, the first of each value."""
        seen: dict[str, Code] = {}
        for c in self.codes:
            if c.name == name:
                seen.setdefault(c.val, c)
        return list(seen.values())


def bilingual_coverage(metadata: Metadata, threshold: float = 0.2) -> list[str]:
    """Warnings where some but not all French labels are missing, beyond the threshold."""
    out = []
    for what, rows in (("variables", metadata.variables), ("codes", metadata.codes)):
        if rows:
            share = sum(x.label_fr is None for x in rows) / len(rows)
            if threshold < share < 1:
                out.append(f"{what}: {share:.0%} have no French label")
    return out


def _text(x) -> str:
    if x is None:
        return "NA"
    return repr(x).removesuffix(".0") if isinstance(x, float) else str(x)


def write_metadata(metadata: Metadata, directory: str) -> list[str]:
    """Writes variables.csv, codes.csv and layout.csv; returns coverage warnings."""
    metadata.validate()
    Path(directory).mkdir(parents=True, exist_ok=True)
    tables = [("variables", VARIABLE_FIELDS, metadata.variables), ("codes", CODE_FIELDS, metadata.codes)]
    if metadata.layout is not None:
        tables.append(("layout", LAYOUT_FIELDS, metadata.layout))
    for name, fields, rows in tables:
        with open(f"{directory}/{name}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f)
            out.writerow(fields)
            out.writerows([_text(getattr(x, c)) for c in fields] for x in rows)
    return bilingual_coverage(metadata)


def read_metadata(directory: str) -> Metadata:
    """Reads what ``write_metadata`` wrote; a missing ``decimals`` column or layout is fine."""

    def rows(name):
        with open(f"{directory}/{name}.csv", newline="", encoding="utf-8") as f:
            for r in csv.DictReader(f):
                yield {k: None if v in ("NA", "") else v for k, v in r.items()}

    number = lambda x, kind: None if x is None else kind(float(x))
    variables = tuple(
        Variable(r["name"], r["label_en"], r["label_fr"], r["type"], number(r.get("decimals"), int), number(r["missing_low"], float), number(r["missing_high"], float))
        for r in rows("variables")
    )
    codes = tuple(Code(r["name"], r["val"], r["label_en"], r["label_fr"]) for r in rows("codes")) if Path(f"{directory}/codes.csv").exists() else ()
    layout = tuple(Field(r["name"], int(r["start"]), int(r["end"])) for r in rows("layout")) if Path(f"{directory}/layout.csv").exists() else None
    return Metadata(variables, codes, layout)


@dataclass(frozen=True)
class Fixups:
    """What is corrected in one survey version's data and metadata."""

    na_values: tuple[str, ...] = ()
    str_pad: tuple[dict, ...] = ()
    rename: dict = field(default_factory=dict)
    cols_swap: tuple[tuple[str, str], ...] = ()
    force_numeric: tuple[str, ...] = ()
    force_character: tuple[str, ...] = ()
    force_integer: tuple[str, ...] = ()
    force_bigint: tuple[str, ...] = ()
    codes_supplement: tuple[Code, ...] = ()
    missing_supplement: dict = field(default_factory=dict)
    labels_supplement: dict = field(default_factory=dict)

    def check(self) -> Fixups:
        """The force_* lists must not share a name (FIX-05)."""
        seen: dict[str, str] = {}
        for kind in ("force_numeric", "force_character", "force_integer", "force_bigint"):
            for name in getattr(self, kind):
                if seen.setdefault(name.upper(), kind) != kind:
                    raise ValueError(f"{name} is in both {seen[name.upper()]} and {kind}")
        return self
