import pytest
from pyspark.sql import functions as F
from surveyloom.model import Code
from surveyloom.plans import catalogue
from surveyloom.sources import documentation, download
from surveyloom.sources.parsers import parse_codebook, parse_dictionary, parse_labels

DICTIONARY = """ ABC1   Position: 1   Length: 2  Numeric
     Long name:   First variable
     Codes:       01   One thing
                  02   Another
                       that wraps
     Reserved Codes: 96   Valid skip
                  07   Yes

 NUM2   Position: 3   Numeric
     Long name:   A number
     Range:  1:500
     Reserved Codes: 999  Not stated
"""
CODEBOOK = """ Variable Name:  HHSIZE
 Concept:  Household
    size
 Question Text: How many?
 Answer Categories    Code   Frequency   %
   One person          1      2,320     10.5
   More than
   one person          2      4 627     80.1
   Total                      6,947    100.0
"""


def test_dictionary_and_codebook():
    m = parse_dictionary(DICTIONARY, DICTIONARY.replace("One thing", "Une chose"))
    assert m.codes[:2] == (Code("ABC1", "01", "One thing", "Une chose"), Code("ABC1", "02", "Another that wraps", "Another that wraps"))
    a, n = m.variables
    assert (a.label_en, a.missing_low, a.missing_high) == ("First variable", 96, 96)
    assert (n.type, n.missing_low) == ("numeric", 999) and [c.val for c in m.codes if c.name == "NUM2"] == ["999"]
    c = parse_codebook(CODEBOOK)
    assert c.variables[0].label_en == "Household size"
    assert [(x.val, x.label_en) for x in c.codes] == [("1", "One person"), ("2", "More than one person")]


def test_sas_labels():
    m = parse_labels('/* V1F format applies to:\n A B */\nVALUE V1F\n 100 = "Many"\n 999.7 = "Not asked"\n other = [Z5.1];\nLABEL A = "First" ;\nLABEL C = "Third" ;\n')
    assert {(c.name, c.val) for c in m.codes} == {("A", "100"), ("A", "999.7"), ("B", "100"), ("B", "999.7")}
    assert {v.name: (v.label_en, v.type) for v in m.variables} == {"A": ("First", "character"), "C": ("Third", "numeric"), "B": (None, "character")}


def test_collection(spark):
    rows = [
        ("GSS", "General Social Survey – Files", "2010", "https://x/c31_2017_CSV.zip", "CSV"), ("GSS", "General Social Survey – Files", "2010", "https://x/c31_2017_SAS.zip", "SAS"),
        ("CPSS", "Canadian Perspectives Survey Series 6: Use", "2021", "https://x/a.zip", None), ("ZZZ", "Other", "2000", "u", "CSV"), ("CHS", "Housing", None, "u", "CSV"),
    ]
    c = spark.createDataFrame(rows, "Acronym string, Title string, edition string, url string, format string")
    got = catalogue.collection(c, ["GSS", "CPSS", "CHS"])
    assert {(r.Acronym, r.Version, r.url) for r in got.collect()} == {("GSS", "Cycle 31 (2017)", rows[0][3]), ("CPSS", "6", "https://x/a.zip")}
    curated = spark.createDataFrame([("LFS", "2022", "l"), ("GSS", "Cycle 31 (2017)", "old")], "Acronym string, Version string, url string")
    assert catalogue.resolved(got, curated, "GSS", "Cycle 31 (2017)").first().url == rows[0][3]
    assert catalogue.resolved(got, curated, "LFS", "2022").first().url == "l"
    d = spark.createDataFrame([("x_CSV.zip", None, "h/2019-2020/x_CSV.zip"), ("f.zip", "SAS 2012", "h/2020001/f.zip"), ("f.zip", "?", "h/2020001/f.zip"), ("cen16_hous_x.zip", "", "h/cen16_hous_x.zip")], "n string, t string, u string")
    d = d.select(catalogue.detected_format(F.col("n"), F.col("t")), catalogue.detected_edition(F.col("n"), F.col("t"), F.col("u")))
    assert [tuple(r) for r in d.collect()] == [("CSV", "2019-2020"), ("SAS", "2012"), (None, "2020"), (None, "2016 (households)")]


def test_download_and_documents(tmp_path):
    (tmp_path / "src.zip").write_bytes(b"data")
    url = (tmp_path / "src.zip").as_uri()
    at = download.located(str(tmp_path / "s"), url)
    assert (tmp_path / "s" / "src.zip").read_bytes() == b"data" and download.located(at, None) == at
    with pytest.raises(download.NetworkError):
        download.download((tmp_path / "absent").as_uri(), str(tmp_path / "t" / "x"))
    assert list((tmp_path / "t").iterdir()) == []
    for n in ("guide_e.pdf", "guide_f.pdf", "z.pdf"):
        (tmp_path / "s" / n).write_text("x")
    assert [p.rsplit("/", 1)[1] for p in documentation.documents(at, "fra")] == ["guide_f.pdf", "z.pdf", "guide_e.pdf"]
