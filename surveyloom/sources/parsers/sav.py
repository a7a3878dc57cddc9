"""The dictionary of an SPSS system file (`.sav`), without its cases (SRC-12).

The file begins with a header, then records: variables (type 2), value labels
and the variables they hold for (3, 4), documents (6) and extensions (7, of
which 13 has the long names and 20 the encoding), up to 999.
"""

from __future__ import annotations

import re
import struct

from ...model import Code, Metadata, Variable
from ...plans.build import sentinel_ranges
from .common import plain


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.order = "<"

    def raw(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the file ends within its dictionary")
        self.at += n
        return self.data[self.at - n : self.at]

    def ints(self, n: int) -> tuple[int, ...]:
        return struct.unpack(f"{self.order}{n}i", self.raw(4 * n))

    def doubles(self, n: int) -> tuple[float, ...]:
        return struct.unpack(f"{self.order}{n}d", self.raw(8 * n))


def _padded(n: int, to: int) -> int:
    return (n + to - 1) // to * to


def parse_sav(data: bytes, encoding: str = "CP1252") -> Metadata:
    """Variables and codes in file order; there is no layout.

    A variable with decimals is numeric; with codes beyond those that mean
    missing or none it is character, as strings are.
    """
    r = _Reader(data)
    if r.raw(4) not in (b"$FL2", b"$FL3"):
        raise ValueError("not an SPSS system file")
    r.raw(60)
    if struct.unpack("<i", data[64:68])[0] not in (2, 3):
        r.order = ">"
    r.at = 176
    slots: list[dict | None] = []  # by 8-byte slot; the rest of a long string is None
    labels: list[tuple[list[tuple[bytes, bytes]], list[int]]] = []
    names: dict[str, str] = {}
    pending: list[tuple[bytes, bytes]] = []
    while True:
        (kind,) = r.ints(1)
        if kind == 999:
            break
        if kind == 2:
            width, has_label, n_missing, shown, _ = r.ints(5)
            name = r.raw(8)
            label = b""
            if has_label:
                (size,) = r.ints(1)
                label = r.raw(_padded(size, 4))[:size]
            missing = r.doubles(abs(n_missing))
            slots.append(None if width < 0 else {"width": width, "name": name, "label": label, "decimals": shown & 255, "missing": missing, "range": n_missing < 0})
        elif kind == 3:
            pending = []
            for _ in range(r.ints(1)[0]):
                value = r.raw(8)
                size = r.raw(1)[0]
                pending.append((value, r.raw(_padded(size + 1, 8) - 1)[:size]))
        elif kind == 4:
            labels.append((pending, list(r.ints(r.ints(1)[0]))))
        elif kind == 6:
            r.raw(80 * r.ints(1)[0])
        elif kind == 7:
            sub, size, count = r.ints(3)
            body = r.raw(size * count)
            if sub == 20:
                encoding = body.decode("ascii").strip() or encoding
            elif sub == 13:
                for pair in body.split(b"\t"):
                    short, _, long = pair.decode(encoding, "replace").partition("=")
                    if long:
                        names[short.strip().upper()] = long
        else:
            raise ValueError(f"unknown record type {kind}")
    text = lambda b: b.decode(encoding, "replace").strip()

    def name_of(slot: dict) -> str:
        short = text(slot["name"]).upper()
        return names.get(short, short).upper()

    codes = []
    for pairs, where in labels:
        for k in where:
            slot = slots[k - 1]
            for value, label in pairs:
                code = text(value) if slot["width"] else plain(repr(struct.unpack(f"{r.order}d", value)[0]))
                codes.append(Code(name_of(slot), code, text(label) or None))
    ranges = sentinel_ranges(Metadata((), tuple(codes)))
    coded = {c.name for c in codes} - set(ranges)
    variables = []
    for slot in slots:
        # Parts of very long strings bear generated names and no label of their own.
        if slot is None or re.fullmatch(rb"@\w*\s*", slot["name"]):
            continue
        name, low, high = name_of(slot), None, None
        if slot["missing"] and not slot["width"]:
            low, high = (slot["missing"][0], slot["missing"][1]) if slot["range"] else (min(slot["missing"]), max(slot["missing"]))
        elif name in ranges:
            low, high = ranges[name]
        numeric = not slot["width"] and (slot["decimals"] > 0 or name not in coded)
        variables.append(Variable(name, text(slot["label"]) or None, None, "numeric" if numeric else "character", slot["decimals"] if numeric else None, low, high))
    return Metadata(tuple(variables), tuple(c for c in codes if c.name in coded))
