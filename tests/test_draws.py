"""Draws by splitting: exact totals, the multinomial's moments, independence of how they are made."""

import re

import numpy as np
from surveyloom.operators import bootstrap, draws
from surveyloom.plans import survey_queries
from surveyloom.plans.queries import QUERIES


def every(n, b, h=12345):
    """Draws of all rows (rows x replicates), block by block."""
    out = np.zeros((n, len(b)), np.int64)
    for low, bits, c in draws.runs(n, h, b):
        lows, c = np.array([low], np.int64), c[None, :]
        for k in range(bits, 0, -1):
            lows, c = draws.halved(h, lows, k, c, b)
        out[lows] = c
    return out


def test_totals_and_moments():
    b = np.arange(1, 401)
    for n in (1, 2, 3, 7, 64, 100, 1000):
        c = every(n, b)
        assert (c >= 0).all() and (c.sum(axis=0) == n).all()
    assert abs(c.var() - (1 - 1 / n)) < 0.01 and abs((c == 0).mean() - (1 - 1 / n) ** n) < 0.003
    # Every row's mean is one, first, last and around the runs' ends, and replicates differ.
    assert np.abs(c.mean(axis=1) - 1).max() < 5 / np.sqrt(len(b)) and np.abs(np.corrcoef(c.T) - np.eye(len(b))).max() < 0.2
    # Rows of one replicate hinder each other as they should.
    assert abs(np.mean([np.cov(c[3], c[k])[0, 1] for k in range(10, 200)]) + 1 / n) < 0.01


def test_few_rows_are_exactly_multinomial():
    c = every(3, np.arange(30_000))
    seen = {tuple(k): n for k, n in zip(*np.unique(c.T, axis=0, return_counts=True))}
    ways = {k: np.prod(range(1, 4)) / np.prod([np.prod(range(1, x + 1)) for x in k]) for k in seen}
    chi = sum((seen[k] - 30_000 * w / 27) ** 2 / (30_000 * w / 27) for k, w in ways.items())
    assert len(seen) == 10 and chi < 30


def test_heads_of_many_words(monkeypatch):
    count = np.array([[0, 1, 31, 32, 33, 64, 65, 5000, 100_000]])
    want = draws.ones(count, np.array([[7]]), np.arange(9)[None, :])
    monkeypatch.setattr(draws, "WORDS", 13)
    assert (draws.ones(count, np.array([[7]]), np.arange(9)[None, :]) == want).all()
    assert want[0, 0] == 0 and (want <= count).all() and abs(want[0, -1] - 50_000) < 1000


def test_parts_are_made_alone(spark, monkeypatch):
    """Replicates and strata by themselves, and other chunks, give the same draws."""
    rows = spark.createDataFrame([(k, "ab"[k % 2], float(k)) for k in range(2500)], "id long, s string, w double")
    whole = {r.id: r.draws for r in bootstrap.drawn(rows, "id", ["s"], 1, 70, 5).collect()}
    assert len(whole) == 2500 and all(sum(d[b] for d in whole.values()) == 2500 for b in range(70))
    some = {r.id: r.draws for r in bootstrap.drawn(rows.filter("s = 'b'"), "id", ["s"], 60, 68, 5).collect()}
    assert len(some) == 1250 and all(d == whole[k][59:68] for k, d in some.items())
    monkeypatch.setattr(bootstrap, "MANY", 100)
    monkeypatch.setattr(bootstrap, "NUMBERED", 1)
    again = {r.id: r.draws for r in bootstrap.drawn(rows, "id", ["s"], 1, 70, 5).collect()}
    assert again == whole


def test_odd_ids_and_empty_tables(spark):
    assert bootstrap.replicate_weights(spark.createDataFrame([], "id string, w double"), "w", "id", (), 3).collect() == []
    rows = spark.createDataFrame([(None, None), ("a", 2.0), ("a", 2.0), ("é", None)], "id string, w double")
    out = bootstrap.replicate_weights(rows, "w", "id", (), 40).collect()
    assert len(out) == 4 and {r.id for r in out} == {None, "a", "é"} and all(len(r.weights) == 40 for r in out)
    assert all(not any(r.weights) for r in out if r.id != "a")


def test_stored_replicates_follow_the_table(spark, tmp_path):
    path = f"{tmp_path}/w"
    rows = [(k, "ab/c"[k % 4], 1.0 + k) for k in range(80)]
    df = lambda rows: spark.createDataFrame(rows, "id long, s string, w double")
    read = lambda d: {r.id: list(r.weights) for r in d.collect()}
    first = read(bootstrap.update_stored(path, df(rows), "w", "id", ["s"], 5))
    assert len(first) == 80
    # b gets a row, c goes, a and / stay as they are; fewer replicates take nothing away.
    changed = [r for r in rows if r[1] != "c"] + [(500, "b", 9.0)]
    second = read(bootstrap.update_stored(path, df(changed), "w", "id", ["s"], 3, seed=7))
    assert set(second) == {r[0] for r in changed} and all(len(w) == 5 for w in second.values())
    assert all(second[k] == first[k] for k, s, _ in rows if s in "a/") and any(second[k] != first[k] for k, s, _ in rows if s == "b")
    more = read(bootstrap.update_stored(path, df(changed), "w", "id", ["s"], 8))
    assert all(len(w) == 8 for w in more.values()) and all(more[k][:5] == second[k] for k in second)
    assert read(bootstrap.update_stored(path, df(rows), "w", "id", ["s"], 2, overwrite=True)).keys() == first.keys()


def test_replicates_are_never_broadcast(spark):
    """Spark's estimate of their arrays is far too small (F4)."""
    df = spark.range(200).selectExpr("id", "id % 3 AS s", "1.0D AS w")
    have = bootstrap.replicate_weights(df, "w", "id", ["s"], 3)
    for out in (bootstrap.attach(df, have, "id"), bootstrap.extended(have, df, "w", "id", ["s"], 40), bootstrap.stale_strata(have, df, "id", ["s"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [id" in plan and not re.search(r"BroadcastHashJoin \[(id|stratum#\d+, (id|block))", plan)


def test_affected_strata_tell_of_every_row(spark, small):
    """The query's SQL has a row an order, not one a stratum (F5)."""
    got = sorted(tuple(r) for r in QUERIES["bootstrap_affected_strata"](spark, small).select("id", "kept").collect())
    assert got == sorted((r[0], r[1] != "P") for r in spark.read.parquet(f"{small}/orders.parquet").select("o_orderkey", "o_orderstatus").collect())
