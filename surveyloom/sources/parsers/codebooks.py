"""Codebooks in CSV: one row a variable, then one row a code."""

from __future__ import annotations

import csv
import io
import re

from ...model import Code, Metadata, Variable
from ..sentinels import sentinel_ranges


def _rows(text: str):
    rows = list(csv.reader(io.StringIO(text.lstrip("﻿"))))
    head = [h.strip().lower() for h in rows[0]]
    return head, [[c.strip() or None for c in r] + [None] * (len(head) - len(r)) for r in rows[1:] if any(c.strip() for c in r)]


def parse_lfs_codebook(text: str) -> Metadata:
    """PAR-15: the first column is filled down; ranges and blanks are no codes."""
    head, rows = _rows(text)
    at = {k: next(i for i, h in enumerate(head) if h.startswith(k)) for k in ("field", "variable", "english", "french")}
    variables, codes, name = [], [], None
    for r in rows:
        if r[at["field"]]:
            name = r[at["field"]].upper()
            variables.append((name, r[at["english"]], r[at["french"]]))
            continue
        value = r[at["variable"]]
        if name is None or not value or value.lower() == "blank" or re.fullmatch(r"[\d.]+\s*[-–:]\s*[\d.]+", value):
            continue
        if name == "SURVMNTH" and value.isdigit():
            value = value.zfill(2)
        codes.append(Code(name, value, r[at["english"]], r[at["french"]]))
    ranges = sentinel_ranges(Metadata((), tuple(codes)))
    codes = tuple(c for c in codes if c.name not in ranges)
    coded = {c.name for c in codes}
    out = tuple(
        Variable(n, en, fr, "character" if n in coded else "numeric", None, *(ranges.get(n) or (None, None))) for n, en, fr in variables
    )
    return Metadata(out, codes)


def parse_cpss(text: str) -> Metadata:
    """PAR-16: variable name filled down, all variables character."""
    head, rows = _rows(text)
    head = [h.split(" / ")[0].strip() for h in head]
    at = {k: head.index(k) for k in ("variable", "variable name - english", "variable name - french", "code", "label - english", "label - french")}
    variables, codes, name = [], [], None
    for r in rows:
        if r[at["variable"]]:
            name = r[at["variable"]].upper()
            variables.append(Variable(name, r[at["variable name - english"]], r[at["variable name - french"]]))
        if name and r[at["code"]]:
            codes.append(Code(name, r[at["code"]], r[at["label - english"]], r[at["label - french"]]))
    return Metadata(tuple(variables), tuple(codes))
