"""Command files and codebooks to canonical metadata; round trips; builds."""

import zipfile

import pytest
from surveyloom.model import Code, Field, Fixups, Metadata, Variable, bilingual_coverage, read_metadata, write_metadata
from surveyloom.plans import build
from surveyloom.sources.merge import merged
from surveyloom.plans.registry import Entry, Registry, resolve_version
from surveyloom.plans.store import Store, wider
from surveyloom.sources import files, raw
from surveyloom.sources.parsers import parse_cards, parse_cpss, parse_lfs_codebook, parse_mono, parse_split

MONO = """/* a comment */
DATA LIST FILE=X/
   AGE 1-2
   REG 3-4  PAY 5 - 10
   SEX 11
   .
FORMATS
   AGE (F2.0) / REG (A2) / PAY (F6.2) / SEX (F1.0) / .
VARIABLE LABELS
   AGE 'Age group'
   REG 'Region of residence'
   PAY 'Total pay'
   SEX 'Sex at ' +
       'birth'
   .
VALUE LABELS
/AGE
   1 "Young"
   2 "Old"
   99 "Not available"
/REG
   10 "North"
   "011" "South"
/SEX
   1 "Male"
   9 "Not available"
   .
MISSING VALUES
   PAY (9999999)
   AGE (97 THRU 99)
   .
"""


def by_name(m):
    return {v.name: v for v in m.variables}


def test_mono():
    m = parse_mono(MONO, MONO.replace("Old", "Vieux").replace("Age group", "Âge"))
    v = by_name(m)
    assert [f.name for f in m.layout] == ["AGE", "REG", "PAY", "SEX"]
    assert m.layout[2] == Field("PAY", 5, 10) and m.layout[3] == Field("SEX", 11, 11)
    assert (v["PAY"].type, v["PAY"].decimals, v["PAY"].missing_low) == ("numeric", 2, 9999999)
    assert (v["REG"].type, v["AGE"].type) == ("character", "character")
    assert (v["AGE"].missing_low, v["AGE"].missing_high) == (97, 99)
    assert v["SEX"].label_en == "Sex at birth" and v["AGE"].label_fr == "Âge"
    assert Code("REG", "011", "South", "South") in m.codes and Code("AGE", "2", "Old", "Vieux") in m.codes


def test_split_and_cards():
    layout = "DATA LIST FILE = IN NOTABLE/\n  ID 1 - 6 (A)\n  AGE 7 - 8 (A)\n  PAY 9 - 16 (4)\n"
    labels = 'VARIABLE LABELS\n  ID "Identifier"\n  AGE "Age"\n  PAY "Pay"\n'
    codes = 'VALUE LABELS\n /AGE\n  "01" "Young"\n  2 "Old"\n /PAY\n 99999996 "Valid skip"\n 99999999 "Not stated"\n'
    m = parse_split(layout, labels, codes, "Comment text\nMISSING VALUES\n AGE (9 THRU )\n")
    v = by_name(m)
    assert {c.val for c in m.codes if c.name == "AGE"} == {"01", "2"}
    assert (v["PAY"].type, v["PAY"].decimals, v["PAY"].missing_low, v["PAY"].missing_high) == ("numeric", 4, 99999996, 99999999)
    assert not any(c.name == "PAY" for c in m.codes)
    assert (v["AGE"].missing_low, v["AGE"].missing_high) == (9, None)
    cards = parse_cards("@1 ID $CHAR6.\n@7 AGE $CHAR2.\n@9 PAY 10.4\n", 'ID = "Identifier"\nAGE = "Age"\nPAY = "Pay"\n', "VALUE LABELS\nAGE\n  1 \"Young\"\n  2:5 \"Range\"\n/\n.\n", "MISSING VALUES\nPay (99 THRU 100)\n.")
    assert cards.layout[2] == Field("PAY", 9, 18) and by_name(cards)["PAY"].missing_high == 100
    assert [c.val for c in cards.codes] == ["1"]


def test_codebooks():
    m = parse_lfs_codebook("Field_X,Variable_V,EnglishLabel,FrenchLabel\nREG,REG,Region,Région\n,1,North,Nord\n,2-5,skip,\nSURVMNTH,SURVMNTH,Month,Mois\n,1,January,Janvier\nPAY,PAY,Pay,Paie\n")
    assert [c.val for c in m.codes] == ["1", "01"] and by_name(m)["PAY"].type == "numeric"
    c = parse_cpss("Variable,Variable Name - English,Variable Name - French,Code,Label - English,Label - French\nREG,Region,Région,,,\n,,,10,North,Nord\n")
    assert c.codes == (Code("REG", "10", "North", "Nord"),) and c.variables[0].type == "character"


def test_metadata_round_trip(tmp_path):
    m = Metadata((Variable("A", "a", None, "numeric", 2, 9.5, 10.0), Variable("B", "b", "bé")), (Code("B", "01", "x", None),), (Field("A", 1, 3),))
    assert write_metadata(m, str(tmp_path)) == ["variables: 50% have no French label"]
    assert read_metadata(str(tmp_path)) == m
    assert bilingual_coverage(Metadata((Variable("A", "a"), Variable("B", "b", "c")))) == ["variables: 50% have no French label"]
    with pytest.raises(ValueError):
        Metadata((Variable("A", type="date"),)).validate()


def test_merge_priority():
    a = Metadata((Variable("X", None, "fr"),), (Code("X", "1", "one"),))
    b = Metadata((Variable("X", "en", "other"), Variable("Y", "y")), (Code("X", "1", "uno", "un"), Code("X", "2", "two")), (Field("X", 1, 2),))
    m = merged({"pdf_dict": b, "spss_mono": a})
    assert (m.variables[0].label_en, m.variables[0].label_fr) == ("en", "fr") and m.codes[0] == Code("X", "1", "one", "un")
    assert len(m.codes) == 2 and m.layout == b.layout


def test_build_from_a_fixed_width_file(spark, tmp_path):
    (tmp_path / "d.txt").write_bytes("0110001234 \r\n9910  99.5x\r\n02é19999999\r\n\x1a".encode("cp1252"))
    m = parse_mono(MONO)
    rows = raw.read_fixed_width(spark, str(tmp_path / "d.txt"), m.layout)
    assert rows.count() == 3
    out = build.typed(rows, m, Fixups(force_character=("REG",))).collect()
    assert [r.AGE for r in out] == ["Young", "Not available", "Old"]
    assert [r.REG for r in out] == ["10", "10", "é1"]
    assert out[0].PAY == 1234.0 and out[1].PAY == 99.5 and out[2].PAY == 999999.0
    assert build.levels_of(build.typed(rows, m), "AGE") == ["Young", "Old", "Not available"]
    assert build.unmatched_values(rows, m) == {"REG": ["é1"], "SEX": ["x"]}
    with pytest.raises(ValueError):
        Fixups(force_integer=("A",), force_bigint=("a",)).check()


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "lfs"))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    assert s.load("2022-01", frame([(1, 10)], "SURVMNTH int, X int"))
    assert not s.load("2022-01", frame([(1, 11)], "SURVMNTH int, X int"))
    assert s.load("2022-02", frame([(2, 2.5, "n")], "SURVMNTH int, X double, NEW string"))
    df = s.read()
    assert dict(df.dtypes)["X"] == "double" and df.count() == 2
    assert s.load("2022-01", frame([(1, 12), (1, 13)], "SURVMNTH int, X int"), refresh=True) and s.read("2022").count() == 3
    assert s.load("2022", frame([(m, m) for m in range(1, 13)], "SURVMNTH int, X int"))
    assert s.versions() == ["2022"] and s.read("2022-03").count() == 1
    assert not s.load("2022-03", frame([(3, 9)], "SURVMNTH int, X int"), refresh=True)
    assert s.missing(["2021", "2022-05", "2023-01"]) == ["2021", "2023-01"]
    s.remove("2022")
    with pytest.raises(KeyError):
        s.read()
    assert wider("int", "double") == "double" and wider("timestamp", "int") == "string"


def test_registry():
    r = Registry([Entry("S", "2016", file_mask="a"), Entry("S", "2019", file_mask="b"), Entry("M", "1", modules={"A": {}, "B": {"file_mask": "x"}})])
    assert r.lookup("S", "2018").file_mask == "a" and r.lookup("S", "2010").file_mask == "a" and r.lookup("S", "2030").file_mask == "b"
    assert [(m.name, m.primary) for m in r.modules("M", "1")] == [("A", True), ("B", False)]
    assert r.overridden(file_mask="z").lookup("S", "2019").file_mask == "z"
    with pytest.raises(ValueError):
        r.overridden(nothing=1)
    known = ["Cycle 16 (2002)", "Cycle 32 (2018)", "Cycle 33 (2018)"]
    assert resolve_version("GSS", "16", known) == "Cycle 16 (2002)" == resolve_version("GSS", "2002", known)
    with pytest.raises(ValueError):
        resolve_version("GSS", "2018", known)


def test_aliases():
    known = ["Cycle 16 (2002)", "Cycle 31 (2017)", "1", "2016 (individuals)", "1991/individuals_prov"]
    for alias in ("cycle16", "Aging and Social Support 2002", "aging and social support", "Cycle 16 2002"):
        assert resolve_version("GSS", alias, known) == "Cycle 16 (2002)"
    assert resolve_version("GSS", "Family 2017", known) == "Cycle 31 (2017)"
    assert resolve_version("CPSS", "Series 4", known) == "4" and resolve_version("CCAHS", "2022", []) == "1"
    assert resolve_version("Census", "1991", known) == "1991/individuals_prov" and resolve_version("Census", "2016", known) == "2016 (individuals)"
    assert resolve_version("CIS", "2019", []) == "2019" and len(Registry().table()) > 25


def test_files(tmp_path):
    inner, outer = tmp_path / "in.zip", tmp_path / "out.zip"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep/pub2022.csv", "a\n1")
    with zipfile.ZipFile(outer, "w") as z:
        z.write(inner, "in.zip")
        z.writestr("codebook.csv", "x")
    files.unzip(str(outer), str(tmp_path / "x"))
    assert files.find_data_file(str(tmp_path / "x")).endswith("pub2022.csv")
    assert len(files.lfs_files(str(tmp_path / "x"))) == 1
    assert [files.lfs_kind(x) for x in ("pub0122.csv", "pub2022.csv", "pub.csv")] == ["monthly", "annual", "unknown"]


def test_detection(tmp_path):
    from surveyloom.sources.detect import detect, parse, unique_file

    labels = 'VARIABLE LABELS\n  A "%s"\n  .\n'
    for folder, files in {
        "accents": {"a.sps": labels % "Âgé", "b.sps": labels % "Aged"},
        "end": {"afre.sps": labels % "x", "b.sps": labels % "y"},
        "alone": {"b_f.sps": labels % "x"},
        "sas": {"m.sas": 'DATA x;\nLABEL A = "Age";\n', "m.lay": "", "n.sas": "PROC x;"},
        "labels": {"m.sas": 'LABEL A = "Age";\n', "m_fre.sas": 'LABEL A = "Âge";\n'},
        "last": {"codebook.txt": "Variable name: A\n", "a.sps": labels % "x"},
    }.items():
        (tmp_path / folder).mkdir()
        for name, text in files.items():
            (tmp_path / folder / name).write_text(text)
    at = lambda x: str(tmp_path / x)
    assert [(v.label_en, v.label_fr) for f in ("accents", "end", "labels") for v in parse(at(f)).variables] == [("Aged", "Âgé"), ("y", "x"), ("Age", "Âge")]
    assert list(detect(at("sas"))) == ["sas_cards"] and list(detect(at("last"))) == ["spss_mono"] and "french" not in detect(at("alone"))["spss_mono"]
    assert [(v.label_en, v.label_fr) for v in parse(at("alone"), english=labels % "own").variables] == [("own", "x")]

    (tmp_path / "u").mkdir()
    for name in ("main_i.sps", "main_vare.sps", "other_i.sps", "data.txt"):
        (tmp_path / "u" / name).write_text("")
    assert unique_file(at("u"), "_i", "main").name == "main_i.sps" and unique_file(at("u"), "vare").name == "main_vare.sps"
    assert unique_file(at("u"), "_i", "other").name == "other_i.sps" and unique_file(at("u"), "_i", "other_i.sps").name == "other_i.sps"
    for ending, mask in (("_i", None), ("_i", "none"), ("i", "_")):
        with pytest.raises(FileNotFoundError):
            unique_file(at("u"), ending, mask)


def test_conflicts_are_told():
    one, other = (Metadata((), (Code("A", "1", x),)) for x in ("x", "y"))
    with pytest.warns(UserWarning, match="A 1"):
        assert merged({"cpss_csv": other, "spss_mono": one}).codes[0].label_en == "x"


def test_page_lines_are_whole_lines():
    from surveyloom.sources.parsers.dictionaries import _page_line

    assert all(map(_page_line, ("page 3 - 4", "page 3-4", "public use microdata file", "totals may not add up due to rounding", "a survey - data dictionary")))
    assert not any(map(_page_line, ("page 2 of the form", "public use microdata file identifier", "page", "data dictionary of terms", "")))
