"""Column expressions that turn raw strings into values and labels."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER = r"^-?[0-9]+$"

# Labels that mean a missing answer, and those that mean none of
# a quantity, as anchored alternatives.
MISSING_LABELS = (
    r"not (applicable|stated|asked|in (the )?universe|available|in sample)( [(][^)]*[)])?|data not available|"
    r"valid skip|refusal|refused|don.?t know( [(][^)]*[)])?|do not know( [(][^)]*[)])?|"
    r"missing|n/a|does not apply|not in scope|"
    r"sans objet|non (disponible|déclaré|applicable)|"
    r"(ne )?s.?applique pas|ne sait pas|refus$|enchaîen|"
    r"inconnu|manquant|non demandé|hors .chantillon"
)
ZERO_LABELS = r"zero(\s+\w+)*|none|no\s+\w+(\s+\w+)*|aucun(e)?(\s+\w+)*"
MISSING_PATTERN = f"(?i)^({MISSING_LABELS})$"
SENTINEL_PATTERN = f"(?i)^({MISSING_LABELS}|{ZERO_LABELS})$"


def number(raw: Column) -> Column:
    """A plain decimal number of a trimmed string, else null (CST-01).

    The pattern keeps out what try_cast would take besides, such as 1d or Inf.
    """
    text = F.trim(raw)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def numeric_value(raw: Column, low: float | None = None, high: float | None = None, na_values: Iterable[str] = ()) -> Column:
    """NUM-01: a number, or null if unparsable, in the closed range low to high
    (both must be given) or written as one of ``na_values``."""
    value = number(raw)
    tokens = list(na_values)
    if tokens:
        value = F.when(~F.trim(raw).isin(tokens), value)
    if low is not None and high is not None:
        value = F.when(~value.between(F.lit(float(low)), F.lit(float(high))), value)
    return value


def code_key(value: Column) -> Column:
    """The integer form of an integer string: 01 and 1 are one code."""
    text = F.trim(value)
    return F.when(text.rlike(INTEGER), text.try_cast("bigint").cast("string")).otherwise(text)


def label_pairs(codes: Sequence, lang: str) -> tuple[list[tuple[str, str | None]], bool]:
    """(value, label) of each code, the first of a value, and whether values are
    integers throughout. French falls back to English code by code."""
    whole = bool(codes) and all(c.val.strip().lstrip("-").isdigit() for c in codes)
    pairs: dict[str, str | None] = {}
    for c in codes:
        key = str(int(c.val)) if whole else c.val.strip()
        label = (c.label_fr if c.label_fr is not None else c.label_en) if lang == "fra" else c.label_en
        pairs.setdefault(key, label)
    return list(pairs.items()), whole


def levels(codes: Sequence, lang: str) -> list[str]:
    """All labels in code order, each once."""
    return list(dict.fromkeys(label for _, label in label_pairs(codes, lang)[0] if label is not None))


def labelled(raw: Column, codes: Sequence, lang: str = "eng", na_values: Iterable[str] = ()) -> Column:
    """LAB-01: a code's label; null if it has none or is one of ``na_values``."""
    pairs, whole = label_pairs(codes, lang)
    known = [(k, v) for k, v in pairs if v is not None]
    if not known:
        return F.lit(None).cast("string")
    key = code_key(raw) if whole else F.trim(raw)
    lookup = F.create_map(*[F.lit(x) for pair in known for x in pair])
    label = F.element_at(lookup, key)
    tokens = list(na_values)
    return F.when(~F.trim(raw).isin(tokens), label) if tokens else label


def unmatched(raw: Column, codes: Sequence, na_values: Iterable[str] = ()) -> Column:
    """The raw value if no code, not even one without a label, is its."""
    pairs, whole = label_pairs(codes, "eng")
    key = code_key(raw) if whole else F.trim(raw)
    return F.when(raw.isNotNull() & ~key.isin([k for k, _ in pairs]) & ~F.trim(raw).isin(list(na_values) or [""]), F.trim(raw))


def padded(value: Column, width: int, side: str = "left", pad: str = " ") -> Column:
    """FIX-01: pads to the width and never cuts."""
    fill = {"left": F.lpad, "right": F.rpad}[side]
    return F.when(F.length(value) < width, fill(value, width, pad)).otherwise(value)


def plain_number(value: Column) -> Column:
    """CHR-01: decimal digits without exponent or trailing zeros."""
    text = F.format_string("%.10f", value.cast("double"))
    return F.when(value.isNotNull(), F.regexp_replace(F.regexp_replace(text, "(\\.[0-9]*?)0+$", "$1"), "\\.$", ""))


def level_order(value: Column, labels: Sequence[str]) -> Column:
    """A label's place among its levels, from 1; the order that sorting follows."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in labels]), value), F.lit(0))


def missing_label(label: Column) -> Column:
    return F.trim(label).rlike(MISSING_PATTERN)


def sentinel_label(label: Column) -> Column:
    return F.trim(label).rlike(SENTINEL_PATTERN)
