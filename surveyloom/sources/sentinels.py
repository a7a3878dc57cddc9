"""Codes that stand for a missing answer."""

from __future__ import annotations

import re

from ..functions import convert
from ..model import Metadata


def sentinel_ranges(metadata: Metadata, lang: str = "eng") -> dict[str, tuple[float | None, float | None]]:
    """SEN-01: variables whose labels all mean missing or none, with the range of
    the codes that mean missing."""
    out = {}
    for name in dict.fromkeys(c.name for c in metadata.codes):
        codes = metadata.codes_of(name)
        labels = [(c.label_fr or c.label_en if lang == "fra" else c.label_en) or "" for c in codes]
        if all(re.match(convert.SENTINEL_PATTERN, x.strip()) for x in labels):
            values = [float(c.val) for c, x in zip(codes, labels) if re.match(convert.MISSING_PATTERN, x.strip()) and re.match(convert.NUMBER, c.val.strip())]
            out[name] = (min(values), max(values)) if values else (None, None)
    return out
