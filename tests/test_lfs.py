import pytest
from surveyloom.operators.columns import gender_sex, survey_date
from surveyloom.plans.lfs import LabourForce
from surveyloom.streaming.drops import load_drops
from surveyloom.plans.store import Store

CODEBOOK = "Field_Champ,Variable_Variable,EnglishLabel_EtiquetteAnglais,FrenchLabel_EtiquetteFrancais\nPROV,PROV,Province,Province\n,10,East,Est\n,35,West,Ouest\nSURVMNTH,SURVMNTH,Month,Mois\n,1,January,Janvier\nEXTRA,EXTRA,Extra,Extra\n"


def put(root, version, rows, name, extra=False):
    folder = root / version
    folder.mkdir()
    (folder / "codebook.csv").write_text(CODEBOOK.replace("West", f"West {version}"))
    head = "SURVYEAR,SURVMNTH,PROV" + (",EXTRA" if extra else "")
    (folder / name).write_text("\n".join([head, *rows]) + "\n")


def test_accumulates_and_supersedes(spark, tmp_path):
    put(tmp_path, "2022-01", ["2022,1,10", "2022,1,35"], "pub0122.csv")
    put(tmp_path, "2022-02", ["2022,2,10,7"], "pub0222.csv", True)
    put(tmp_path, "2022", [f"2022,{m},{10 if m % 2 else 35},{m}" for m in range(1, 13)], "pub2022.csv", True)
    put(tmp_path, "2023-01", ["2023,1,99"], "pub0123.csv")
    lfs = LabourForce(spark, str(tmp_path))
    assert lfs.load("2022-01") and lfs.load("2022-02") and not lfs.load("2022-02")
    rows = {(r.SURVMNTH, r.PROV, r.EXTRA) for r in lfs.open("2022").collect()}
    assert rows == {(1, "East", None), (1, "West 2022-02", None), (2, "East", 7.0)}
    assert lfs.load("2022") and lfs.store.versions() == ["2022"]
    assert lfs.open("2022-03").count() == 1 and lfs.open("2022-03", "fra").first().PROV == "Est"
    assert lfs.refresh(["2022-05", "2023-01", "2024-01"]).keys() == {"2024-01"}
    assert lfs.open().count() == 13 and len(lfs.status()) == 2
    (tmp_path / "2022-01" / "pub2021.csv").write_text("x\n1\n")
    with pytest.raises(ValueError):
        lfs.load("2022-01")


def test_dates_and_gender(spark):
    df = spark.createDataFrame([(2022, "January", "Male", None), (2022, "x", "Female", "Men+"), (2022, None, None, None)], "SURVYEAR int, SURVMNTH string, SEX string, GENDER string")
    out = gender_sex(survey_date(df, names=["January", "February"])).collect()
    assert [str(r.SURVDATE) for r in out] == ["2022-01-01", "None", "None"]
    assert [r.GENDER_SEX for r in out] == ["Men+", "Men+", None]
    assert gender_sex(df.drop("GENDER")).columns == ["SURVYEAR", "SURVMNTH", "SEX", "GENDER_SEX"]
    with pytest.raises(ValueError):
        gender_sex(df.drop("GENDER", "SEX"))


def test_drops_are_loaded_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("SURVMNTH,X\n1,5\n1,6\n")
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        q = load_drops(spark, str(tmp_path / "in"), "SURVMNTH int, X int", store, lambda df: f"2022-{df.first().SURVMNTH:02d}", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert store.versions() == ["2022-01"] and store.read().count() == 2
