"""Stages against plain all-pairs code, with null, empty, repeated, long and clashing rows."""

import re

import xxhash
from pyspark.sql import functions as F
from surveyloom.llm import common, lines, simhash

DOCS = "doc_id long, text string, extra int"


def with_clashes(df, *names):
    return df.selectExpr("*", *[f"'{n}' AS `{n}`" for n in names])


def roots(n, near):
    """The least member of each one's component, by all pairs."""
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if near(i, j):
                    root[i] = root[j] = min(root[i], root[j])
    return root


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_keep_one_is_the_plain_one(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    texts = [None, "", "  \n", "one two three four", "One two  three four", "other words stand here", long, long + " more", long.upper(), "é ü", "ab"]
    rows = [(k, t, k) for k, t in enumerate(texts)] + [(None, "one two three four", 7), (None, None, 1), (3, "one two three four", 9), (20, "ab", 3)]
    df = with_clashes(spark.createDataFrame(rows, DOCS), "_stays", "_as", "_text", "_text_", "root", "th", "fp", "first", "n")
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    prints = [fingerprint(t) for _, t, _ in rows]
    root = roots(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    first = {}
    for k, r in enumerate(root):
        best = first.get(r)
        order = lambda row: (row[0] is not None, row[0] or 0)
        if best is None or order(rows[k]) < order(rows[best]):
            first[r] = k
    got = out.collect()
    # Of a group's rows of the first id any text may stay (by its hash), but one row alone.
    want = {(rows[k][0], root[k]) for k in first.values()}
    group = {(i, t): root[k] for k, (i, t, _) in enumerate(rows)}
    assert len(got) == len(want) and {(r.doc_id, group[r.doc_id, r.text]) for r in got} == want
    assert all(r["_stays"] == "_stays" and r["_as"] == "_as" for r in got)


def test_dedup_lines_keeps_clashing_columns(spark):
    rows = [(1, "a line that is here\nsecond\n\nsecond", 1), (2, "a line that is here\nthird", 2), (2, "a line that is here\nthird", 3), (3, None, 4), (4, "", 5), (None, "third\nnew", 6)]
    names = ("n_lines", "n_lines_in", "N_dropped", "_doc", "_doc_in", "_th", "_gone", "_lines", "pos", "line", "keep")
    df = with_clashes(spark.createDataFrame(rows, DOCS), *names)
    out = lines.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "extra", "n_lines_in_", "n_lines_in", "N_dropped_in", "_doc_in_", "_doc_in", "_th_in", "_gone_in", "_lines_in", *names[8:], "n_lines", "n_dropped"]
    # The first of equal lines stays: by doc_id, nulls first, then by place.
    got = {(r.doc_id, r.extra): (r.text, r.n_lines, r.n_dropped) for r in out.collect()}
    assert got == {
        (1, 1): ("a line that is here\nsecond\n", 4, 1), (2, 2): ("", 2, 2), (2, 3): ("", 2, 2), (3, 4): (None, 0, 0), (4, 5): ("", 1, 0), (None, 6): ("third\nnew", 2, 0),
    }
    assert {(r["_doc_in_"], r["_doc_in"]) for r in out.collect()} == {("_doc", "_doc_in")}


def test_growing_sides_are_not_broadcast(spark):
    """Estimates of what joins meet are far too small, which filled the driver (F1, F2)."""
    docs = spark.createDataFrame([(k, f"a line that says number {k % 7} and more\nanother one, of {k % 3}") for k in range(30)], "doc_id long, text string")
    plan = lines.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    rows = spark.range(500).selectExpr("id % 50 AS key", "id")
    facts = rows.groupBy("key").agg(F.count("id").alias("n")).withColumn("many", F.sequence(F.lit(0), F.lit(50)))
    plan = common.meet(rows, facts, "key", 500)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_line_dedup_takes_few_steps(spark, monkeypatch):
    """Rounds that find little took jobs, CPU and the driver's memory; small sides need no sort."""
    base = [f"word{k}" for k in range(30)]
    texts = [" ".join(base[:k] + [f"other{j}{k}" for j in range(6)] + base[k + 6 :]) for k in range(0, 24, 2)]
    calls = []
    compared = lines._compared
    monkeypatch.setattr(lines, "_compared", lambda *a: calls.append(1) or compared(*a))
    docs = spark.createDataFrame(list(enumerate(texts + texts[:1])), "doc_id long, text string")
    assert [r.n_dropped for r in lines.dedup_lines(docs).orderBy("doc_id").collect()] == [0] * 12 + [1]
    assert len(calls) <= 3
    rows = spark.range(500).selectExpr("id % 50 AS key", "id")
    facts = rows.groupBy("key").agg(F.count("id").alias("n"))
    met = common.meet(rows, facts, "key", 500, dealt=common.looked_up)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan and met.count() == 500
