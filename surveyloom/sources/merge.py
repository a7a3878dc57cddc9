"""Merging what several parsers found about one survey (PAR-20)."""

from __future__ import annotations

import warnings

from ..model import CODE_FIELDS, VARIABLE_FIELDS, Code, Metadata, Variable

# Fixed order of trust.
PRIORITY = ("spss_mono", "spss_split", "sas_cards", "spss_sav", "lfs_csv", "cpss_csv", "sas_labels", "pdf_dict", "pdf_codebook")
# Fixed: sources whose labels are often cut or reformatted, so that they contradict none.
LOSSY = ("sas_labels", "pdf_dict", "pdf_codebook")


def conflicts(found: dict[str, Metadata]) -> list[tuple[str, str, list[str]]]:
    """Codes (name, val) for which sources that count give several English labels, the
    one that is used first."""
    labels: dict[tuple[str, str], dict[str, None]] = {}
    for k in PRIORITY:
        for c in found[k].codes if k in found and k not in LOSSY else ():
            if c.label_en is not None:
                labels.setdefault((c.name, c.val), {})[c.label_en] = None
    return [(*key, list(x)) for key, x in sorted(labels.items()) if len(x) > 1]


def merged(found: dict[str, Metadata]) -> Metadata:
    """Per row and column the first non-null value by PRIORITY; rows in the order
    of the most trusted source that has them. The layout is the first there is.
    Conflicts are told by a warning."""
    sources = [found[k] for k in PRIORITY if k in found] + [m for k, m in found.items() if k not in PRIORITY]
    if len(sources) == 1:
        return sources[0]
    for name, val, labels in conflicts(found):
        warnings.warn(f"{name} {val}: of the labels {labels} the first is used", stacklevel=2)

    def rows(lists, fields, key, make):
        out: dict = {}
        for row in (r for rows in lists for r in rows):
            kept = out.setdefault(key(row), dict.fromkeys(fields))
            for f in fields:
                if kept[f] is None:
                    kept[f] = getattr(row, f)
        return tuple(make(**v) for v in out.values())

    variables = rows([m.variables for m in sources], VARIABLE_FIELDS, lambda v: v.name, Variable)
    codes = rows([m.codes for m in sources], CODE_FIELDS, lambda c: (c.name, c.val), Code)
    return Metadata(variables, codes, next((m.layout for m in sources if m.layout is not None), None))
