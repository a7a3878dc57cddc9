"""The store's log: writers at once, removal of what is left over, scans by schema."""

import threading

import pytest
from surveyloom.plans.store import Conflict, Store


def month(spark, k, kind="int"):
    return spark.range(1).selectExpr(f"CAST({k} AS {kind}) AS x")


def test_two_writers_are_both_kept(spark, tmp_path):
    a, b = Store(spark, f"{tmp_path}/s"), Store(spark, f"{tmp_path}/s")
    state = a._state
    told = []

    def late():  # b commits between a's look and a's commit
        out = state()
        if not told:
            told.append(b.load("2020-02", month(spark, 2)))
        return out

    assert a.load("2020-01", month(spark, 1))
    a._state = lambda: late() if len(told) == 0 and threading.current_thread() else state()
    assert a._change(lambda parts: [*parts, {"version": "2020-03", "folder": parts[0]["folder"], "rows": 1, "at": 0.0, "schema": parts[0]["schema"]}])
    assert told == [True] and b.versions() == ["2020-01", "2020-02", "2020-03"]
    with pytest.raises(Conflict):
        a._commit(1, [])
    names = sorted(p.name for p in (tmp_path / "s" / "log").glob("v*.json"))
    assert names == [f"v{k:020d}.json" for k in (1, 2, 3)]


def test_many_writers(spark, tmp_path):
    found = []
    run = lambda k: found.append(Store(spark, f"{tmp_path}/s").load(f"2021-{k:02d}", month(spark, k)))
    workers = [threading.Thread(target=run, args=(k,)) for k in (1, 2, 3, 4, 4)]
    [w.start() for w in workers]
    [w.join() for w in workers]
    s = Store(spark, f"{tmp_path}/s")
    assert sorted(found) == [False, True, True, True, True] and s.versions() == ["2021-01", "2021-02", "2021-03", "2021-04"]
    assert sorted(r.x for r in s.read().collect()) == [1, 2, 3, 4]
    assert len(list((tmp_path / "s" / "data").glob("part=*"))) == 4  # the loser took its files away


def test_parts_of_a_schema_are_one_scan(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    for k in range(1, 7):
        s.load(f"2020-{k:02d}", month(spark, k, "int" if k < 5 else "double"))
    df = s.read()
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 2
    assert df.dtypes[0] == ("x", "double") and sorted((r.x, r.SURVYEAR, r.SURVMNTH) for r in df.collect()) == [(float(k), 2020, k) for k in range(1, 7)]
    assert "part" not in df.columns and s.read("2020-05").first().x == 5.0


def test_clean(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    for k in (1, 2):
        s.load(f"2020-{k:02d}", month(spark, k))
    s.load("2020-02", month(spark, 20), refresh=True)
    s.remove("2020-01")
    assert s.clean() == []  # too young: a reader may hold them
    gone = s.clean(hours=0)
    assert sum(g.startswith("part=2020-01") for g in gone) == 1 and sum(g.startswith("part=2020-02") for g in gone) == 1
    assert s.versions() == ["2020-02"] and [r.x for r in s.read().collect()] == [20]
    assert s.load("2020", month(spark, 7).selectExpr("x", "'3' AS SURVMNTH")) and s.versions() == ["2020"]
