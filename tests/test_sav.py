import struct

import pytest
from surveyloom.model import Code
from surveyloom.sources.parsers import parse_sav


def variable(o, name, width=0, label=None, missing=(), ranged=False, decimals=0):
    out = struct.pack(f"{o}6i", 2, width, int(label is not None), -2 if ranged else len(missing), (5 << 16) | (8 << 8) | decimals, 0) + name.ljust(8).encode()
    if label is not None:
        text = label.encode("utf-8")
        out += struct.pack(f"{o}i", len(text)) + text + b"\0" * (-len(text) % 4)
    return out + struct.pack(f"{o}{len(missing)}d", *missing)


def value_labels(o, pairs, where):
    out = struct.pack(f"{o}2i", 3, len(pairs))
    for value, label in pairs:
        text = label.encode("utf-8")
        out += (value.ljust(8).encode() if isinstance(value, str) else struct.pack(f"{o}d", value)) + bytes([len(text)]) + text + b"\0" * (-(len(text) + 1) % 8)
    return out + struct.pack(f"{o}{2 + len(where)}i", 4, len(where), *where)


@pytest.mark.parametrize("order", ["<", ">"])
def test_dictionary(order):
    o = order
    long = b"REGION_=region_of_home\tPAY=pay"
    data = b"$FL2" + b" " * 60 + struct.pack(f"{o}i", 2) + b"\0" * 108
    data += variable(o, "REGION_", label="Région") + variable(o, "PAY", missing=(96.0, 99.0), ranged=True, decimals=2)
    data += variable(o, "NAME", 12, "Name") + struct.pack(f"{o}6i", 2, -1, 0, 0, 0, 0) + b" " * 8 + variable(o, "HOURS")
    data += value_labels(o, [(1.0, "North"), (2.0, "South")], [1]) + value_labels(o, [(997.0, "Valid skip"), (999.0, "Not stated")], [5]) + value_labels(o, [("a", "Alpha")], [3])
    data += struct.pack(f"{o}4i", 7, 13, 1, len(long)) + long + struct.pack(f"{o}4i", 7, 20, 1, 5) + b"UTF-8" + struct.pack(f"{o}2i", 999, 0)
    m = parse_sav(data)
    v = {x.name: x for x in m.variables}
    assert list(v) == ["REGION_OF_HOME", "PAY", "NAME", "HOURS"]
    assert (v["REGION_OF_HOME"].label_en, v["REGION_OF_HOME"].type) == ("Région", "character")
    assert (v["PAY"].type, v["PAY"].decimals, v["PAY"].missing_low, v["PAY"].missing_high) == ("numeric", 2, 96, 99)
    assert (v["HOURS"].type, v["HOURS"].missing_low, v["HOURS"].missing_high) == ("numeric", 997, 999)
    assert m.codes == (Code("REGION_OF_HOME", "1", "North"), Code("REGION_OF_HOME", "2", "South"), Code("NAME", "a", "Alpha"))
    with pytest.raises(ValueError):
        parse_sav(b"nothing at all")
    with pytest.raises(ValueError):
        parse_sav(data[:300])
