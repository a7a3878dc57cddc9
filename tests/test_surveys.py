"""A survey directory end to end: archive, metadata, tables, labels, replicates."""

import zipfile

import pytest
from pyspark.sql import functions as F
from surveyloom.plans.registry import Entry, Registry, resolve_version
from surveyloom.plans.surveys import Surveys

LAYOUT = "DATA LIST FILE = IN NOTABLE/\n  ID 1 - 3 (A)\n  REG 4 - 5 (A)\n  WT 6 - 11 (2)\n"
LABELS = 'VARIABLE LABELS\n  ID "Identifier"\n  REG "Region"\n  WT "Weight"\n'
FRENCH = 'VARIABLE LABELS\n  ID "Identifiant"\n  REG "Région"\n  WT "Poids"\n'
CODES = 'VALUE LABELS\n /REG\n  10 "North"\n  24 "South"\n'


@pytest.fixture
def surveys(spark, tmp_path):
    folder = tmp_path / "S" / "2020"
    folder.mkdir(parents=True)
    with zipfile.ZipFile(folder / "data.zip", "w") as z:
        z.writestr("x_i.sps", LAYOUT)
        z.writestr("x_vare.sps", LABELS)
        z.writestr("x_varf.sps", FRENCH.encode("cp1252"))
        z.writestr("x_vale.sps", CODES)
        z.writestr("x_valf.sps", CODES.replace("North", "Nord").replace("South", "Sud"))
        z.writestr("x.txt", "".join(f"{k:03d}{10 if k % 2 else 24}{k + 0.5:6.2f}\n" for k in range(1, 21)) + "\x1a\n")
    return Surveys(spark, str(tmp_path), Registry([Entry("S", "2020", bsw_join_key="ID", bsw_strata=("REG",))]))


def test_shipped_weights(surveys, spark):
    folder = surveys.folder("S", "2020")
    (folder / "layout_bsw.txt").write_text("@1 ID $CHAR3.\n@4 BSW1 5.1\n")
    (folder / "s_bsw.txt").write_text("".join(f"{k:03d}{k:5.1f}\n" for k in range(1, 11)))
    surveys.registry = Registry([Entry("S", "2020", bsw_join_key="ID", bsw_file_mask="bsw\\.txt")])
    rows = {r.ID: r.BSW1 for r in surveys.open("S", "2020").df.collect()}
    assert rows["007"] == 7.0 and rows["015"] is None and len(rows) == 20


def test_open_label_and_bootstrap(surveys):
    t = surveys.open("S", "2020")
    assert t.df.count() == 20 and {r.REG for r in t.df.collect()} == {"North", "South"}
    assert {r.REG for r in surveys.open("S", "2020", "fra").df.collect()} == {"Nord", "Sud"}
    assert surveys.open("S", "2020", "fra").relabelled().df.columns == ["Identifiant", "Région", "Poids"]
    assert t.labels()[1] == ("REG", "Region", "Région")
    north = t.with_df(t.df.filter("REG = 'North'"))
    b = surveys.bootstrap_weights(north, "Weight", replicates=6).df
    assert b.count() == 10 and {len(r.weights) for r in b.collect()} == {6}
    every = surveys.bootstrap_weights(t, "WT", replicates=4).df.select("ID", "WT", "REG", "weights")
    draws = every.select("REG", F.posexplode("weights").alias("b", "w"), "WT").groupBy("REG", "b").agg(F.round(F.sum(F.col("w") / F.col("WT"))).alias("n"))
    assert {r.n for r in draws.collect()} == {10}
    assert [(x["weight"], x["replicates"]) for x in surveys.bootstrap_info("S", "2020")] == [("wt", 6)]
    assert surveys.remove_bootstrap("S", "2020") == 1
    assert [(x["series"], x["has_raw"], x["has_tables"]) for x in surveys.listing()] == [("S", True, True)]
    with pytest.raises(ValueError):
        surveys.open("S", "2020", "deu")
    surveys.remove("S", "2020", keep_raw=True)
    assert surveys.open("S", "2020").df.count() == 20


def test_replicates_of_a_table_without_an_id(surveys):
    surveys.registry = Registry([Entry("S", "2020")])
    t = surveys.open("S", "2020")
    south = t.with_df(t.df.filter("REG = 'South'"))
    b = surveys.bootstrap_weights(south, "WT", strata=["REG"], replicates=5).df
    assert b.count() == 10 and {r.REG for r in b.select("REG").collect()} == {"South"} and {len(r.weights) for r in b.collect()} == {5}
    every = surveys.bootstrap_weights(surveys.open("S", "2020", "fra").relabelled(), "Poids", strata=["Région"], replicates=3).df
    assert sorted(r.row_id for r in every.collect()) == list(range(1, 21))
    same = {r.row_id: r.weights[:3] for r in b.collect()}
    assert all(r.weights == same[r.row_id] for r in every.collect() if r.row_id in same)
    assert surveys.tables("S", "2020") == ["main", "main_pumf_bsw_wt"]
    with pytest.raises(ValueError, match="before its columns are changed"):
        surveys.bootstrap_weights(t.with_df(t.df.drop("REG")), "WT")
    rows = surveys.folder("S", "2020") / "tables" / "main_rows"
    assert rows.exists() and surveys.remove_bootstrap("S", "2020", "WT") == 1 and not rows.exists()


def test_builds_tell_what_is_lost(surveys):
    folder = surveys.folder("S", "2020")
    with zipfile.ZipFile(folder / "data.zip", "a") as z:
        z.writestr("x_vale.sps", CODES.replace('  24 "South"\n', '  11 "East"\n  12 "West"\n'))
        z.writestr("x_valf.sps", CODES.replace('  24 "South"\n', ""))
    with pytest.warns(UserWarning) as told:
        surveys.open("S", "2020")
    said = " | ".join(str(w.message) for w in told)
    assert "REG: 1 values without a code become null: 24" in said and "REG: some codes have no French label" in said
    with pytest.warns(UserWarning, match="rows have no"):
        t = surveys.open("S", "2020")
        whole = surveys.spark.read.parquet(surveys.table_path("S", "2020")).withColumn("WT", F.when(F.col("ID") != "003", F.col("WT")))
        whole.write.parquet(f"{folder}/changed")
        for old in (folder / "tables" / "main").iterdir():
            old.unlink()
        (folder / "tables" / "main").rmdir()
        (folder / "changed").rename(folder / "tables" / "main")
        assert all(not any(r.weights) for r in surveys.bootstrap_weights(t.with_df(surveys.open("S", "2020").df), "WT", replicates=2).df.filter("ID = '003'").collect())


def test_long_lists_are_joined_like_short_ones(spark, monkeypatch):
    from surveyloom.model import Code, Metadata, Variable
    from surveyloom.plans import build

    m = Metadata((Variable("A"), Variable("B")), tuple(Code(c, f"{k:02d}", None if k == 4 else f"label {k % 7}", "fr" if k % 3 else None) for c in "AB" for k in range(9)) + (Code("B", "x", "an x"),))
    df = spark.createDataFrame([(f"{k}", f"0{k}", k) for k in range(12)] + [(None, "x", 1), (" 3 ", "", 2)], "A string, B string, key_ int")
    short = {str(r) for r in build.labelled(df, m, None, "fra").collect()}
    monkeypatch.setattr(build, "LONG", 3)
    for chars in (8_000_000, 0):
        monkeypatch.setattr(build, "BROADCAST_CHARS", chars)
        out = build.labelled(df, m, None, "fra")
        assert {str(r) for r in out.collect()} == short and out.count() == 14
        assert build.levels_of(out, "A") == build.levels_of(build.labelled(df, m, None, "fra"), "A") and out.columns == df.columns


def test_row_ids(spark):
    from surveyloom.operators.columns import with_row_id

    rows = [(k % 7, "x" * (k % 3), k % 2 == 0) for k in range(500)] + [(3, "hot", True)] * 700 + [(None, None, None)]
    df = spark.createDataFrame(rows, "a int, b string, row_id boolean").withColumnRenamed("row_id", "salt__")
    out = sorted((tuple(r) for r in with_row_id(df, ["a", "b"]).collect()), key=lambda r: r[3])
    assert [r[3] for r in out] == list(range(1, len(rows) + 1)) and out[0][:3] == (None, None, None)
    assert [r[:2] for r in out[1:]] == sorted(r[:2] for r in rows[:-1]) and sorted(map(str, (r[:3] for r in out))) == sorted(map(str, rows))
    assert with_row_id(df.limit(0), ["a"]).collect() == []


def test_get(surveys, spark, tmp_path):
    away = tmp_path / "S" / "2020" / "data.zip"
    kept = tmp_path / "away" / "data.zip"
    kept.parent.mkdir()
    away.rename(kept)
    with pytest.raises(FileNotFoundError):
        surveys.get("S")
    surveys = Surveys(spark, str(tmp_path / "cache"), surveys.registry, spark.createDataFrame([("S", "2020", kept.as_uri())], "Acronym string, Version string, url string"))
    t = surveys.get("S")
    assert (t.version, t.df.count(), surveys.tables("S", "2020")) == ("2020", 20, ["main"]) and surveys.versions("S") == ["2020"]
    with pytest.warns(UserWarning, match="built already"):
        surveys.get("S", "2020", registry={"data_encoding": "UTF-8"})
    assert surveys.get("S", "2020", "fra", redownload=True).df.count() == 20
    kept.unlink()
    with pytest.warns(UserWarning):  # nothing is lost where nothing can be fetched
        assert surveys.get("S", redownload=True) is None
    assert surveys.get("S", refresh=True).df.count() == 20
    for wrong in ({"series": ""}, {"series": "T"}, {"series": "S", "lang": "deu"}, {"series": "S", "refresh": "auto"}, {"series": "S", "refresh": "later"}, {"series": "LFS", "module": "M"}, {"series": "LFS", "redownload": True, "refresh": "auto"}):
        with pytest.raises(ValueError):
            surveys.get(**wrong)


def test_get_modules(surveys, spark):
    patch = {"file_mask": "x\\.txt"}
    surveys.registry = Registry([Entry("S", "Cycle 9 (2020)", modules={"A": patch, "B": patch}, module_key="ID")])
    surveys.folder("S", "2020").rename(surveys.folder("S", "Cycle 9 (2020)"))
    with pytest.warns(UserWarning, match="also has B, joined on ID"):
        assert surveys.get("S", "cycle 9").df.count() == 20
    assert surveys.get("S", "9", module="B").module == "B" and surveys.tables("S", "Cycle 9 (2020)") == ["B", "main"]


def test_get_labour_force(spark, tmp_path):
    folder = tmp_path / "LFS" / "2022-01"
    folder.mkdir(parents=True)
    (folder / "codebook.csv").write_text("Field_Champ,Variable_Variable,EnglishLabel_EtiquetteAnglais,FrenchLabel_EtiquetteFrancais\nSEX,SEX,Sex,Sexe\n,1,Male,Homme\nGENDER,GENDER,Gender,Genre\n,1,Men+,Hommes+\n")
    (folder / "pub0122.csv").write_text("SURVYEAR,GENDER,SURVMNTH,SEX\n2022,1,1,1\n")
    surveys = Surveys(spark, str(tmp_path))
    df = surveys.get("LFS", refresh="auto")
    assert df.columns[df.columns.index("SEX") + 1] == "GENDER" and df.first().GENDER == "Men+"
    assert surveys.get("LFS", "2022-01", "fra").first().SEX == "Homme"


def test_built_in_entries():
    r = Registry()
    assert len([e for e in r.table() if e["series"] != "LFS"]) == 83
    for (series, version), e in r.entries.items():
        e.fixups.check()
        assert resolve_version(series, version, r.versions(series)) == version
        for t in r.modules(series, version):
            t.entry.fixups.check()
    assert resolve_version("Census", "1971 families cma", r.versions("Census")) == "1971/families_cma"
    assert r.lookup("Census", "2006 (hierarchical)").fixups.na_values == ("9999999", "8888888")
    more = r.with_numeric([("GSS", "Cycle 12 (1998)", "Main", "DDAY"), ("GSS", "Cycle 26 (2012)", "", "X"), ("GSS", "Cycle 26 (2012)", "", "PHS_Q10")])
    assert [t.entry.fixups.force_numeric for t in more.modules("GSS", "Cycle 12 (1998)")] == [("DDAY",), ()]
    assert more.lookup("GSS", "Cycle 26 (2012)").fixups.force_numeric[-2:] == ("PHS_Q10", "X")
    with pytest.raises(ValueError):
        r.with_numeric([("GSS", "Cycle 12 (1998)", "Other", "DDAY")])
