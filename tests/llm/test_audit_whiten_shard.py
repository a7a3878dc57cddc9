"""Divergence audit, whitening and sharding against plain versions in Python."""

import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from surveyloom.llm import divergence, sharding, whitening

DOCS = "doc_id long, text string, lang string, source string"


def plain_audit(rows, least=10, top=10):
    words = lambda t: [w.translate({k: k + 32 for k in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        found = words(text)
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        whole = sum(groups.values(), Counter())

        def share(c):
            of = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + (10**9 * (c[t] + 2)) // of for t in kept}

        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            parts = {
                "pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s],
                "term": [(f(p[s][t], q[t]), t) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]],
            }
            for part, values in parts.items():
                ranked = sorted(values, key=lambda v: (-v[0], v[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def audit_rows():
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("Lo", "mé", "Ñu", "\U0001f600")] + ["ÉTÉ", "été"]
    rows = []
    for k in range(400):
        lang, source = ("en", "fr", None)[k % 3], f"s{rng.integers(0, 1 + 7 * (k % 2 + 1))}"
        rows.append((k, " ".join(rng.choice(words, rng.integers(0, 40))) + "-x1y_", lang, source))
    rows += [(k, None, "en", "silent") for k in range(3)] + [(None, "", "", None), (7, "aLo", "xx", "only"), (8, "aLo " * 30_000, "en", "long"), (1, "abc", "de", "a"), (1, "abc", "de", "b")]
    return rows + rows[:40]


@pytest.mark.parametrize("block, chunk, band", [(64, 1024, 64), (2, 3, 2), (1, 1, 1)])
def test_audit_is_the_plain_one(spark, block, chunk, band):
    rows = audit_rows()
    df = spark.createDataFrame(rows, DOCS).withColumnsRenamed({}).selectExpr("*", "1 AS chunk", "2 AS n", "3 AS `at`", "4 AS p")
    got = sorted(tuple(r) for r in divergence.audit(df, block=block, chunk=chunk, band=band).collect())
    assert got == plain_audit(rows)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []
    empty = divergence.audit(spark.createDataFrame([(1, None, None, "a"), (2, "", None, "b")], DOCS)).collect()
    assert sorted(tuple(r) for r in empty) == [("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)]


def test_shares_of_large_counts_are_exact():
    counts, of = np.array([[2, 8 * 10**15, 123456789012345]]), np.array([[9 * 10**15]])
    assert divergence.shares(counts, of).tolist() == [[1 + 10**9 * int(c) // (9 * 10**15) for c in counts[0]]]


def test_words_of_long_texts_are_whole(monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 10)
    text = ("Abc, défg " * 9 + "w" * 50 + " e").encode()
    assert [w for ws in divergence._words(text) for w in ws] == (["abc".encode(), "défg".encode()] * 9) + [b"w" * 50, b"e"]


VECTORS = "vec_id long, embedding array<float>"


def plain_whitening(vectors, k):
    """Exact covariance by fractions; numpy's eigenvectors."""
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    z = [[Fraction(n * r[j] - s[j], n) for j in range(d)] for r in x]
    v = np.array([[float(sum(r[i] * r[j] for r in z) / n) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    w = np.array([[float(c) for c in r] for r in z]) @ u / np.sqrt(e)
    return n, [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x], w, e / np.trace(v)


@pytest.mark.parametrize("far", [False, True])
def test_whitening_is_the_plain_one(spark, far):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((120, 12)) * np.geomspace(1, 0.02, 12) + rng.standard_normal(12)
    if far:
        base[0, 3] = 3e6
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(base)]
    odd = [(900, None), (901, [float("nan")] * 12), (902, [1.0] * 11 + [float("inf")]), (903, [None] + [1.0] * 11), (904, [1.0]), (905, []), (906, [1e30] * 12)]
    df = spark.createDataFrame(rows + odd + [(None, rows[0][1]), rows[1]], VECTORS).selectExpr("*", "1 AS x", "2 AS n", "3 AS component")
    n, dev, w, explained = plain_whitening([v for _, v in rows] + [rows[0][1], rows[1][1]], 8)
    got = whitening.whiten(df).collect()
    assert len(got) == 122 * 8 and {r.n for r in got} == {n == 122 and 122}
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    by = {(r.vec_id, r.component): r for r in got}
    assert all(int(by[k, 1].deviation) == dev[k] for k, _ in rows)
    for c in range(8):
        # numpy's own small eigenvalues are only as good as the largest one's rounding.
        assert abs(by[0, c + 1].explained / explained[c] - 1) < (1e-4 if far else 1e-9)
        if far and c:
            continue
        mine = np.array([by[k, c + 1].whitened for k, _ in rows])
        sign = np.sign(mine @ w[:120, c])
        assert np.abs(mine * sign - w[:120, c]).max() < 1e-6
    assert sum(r.vec_id is None for r in got) == 8 and sum(r.vec_id == 1 for r in got) == 16


def test_whitening_without_variance(spark):
    out = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 5.0])], VECTORS)).collect()
    got = {(r.vec_id, r.component): r for r in out}
    assert len(out) == 6 and abs(abs(got[1, 1].whitened) - 1) < 1e-12 and got[1, 1].explained == 1.0 and got[2, 2].whitened is None
    assert out[0].identity_error < 1e-12
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], VECTORS)).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(0, None, None, None)] * 2
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []


def test_jacobi_keeps_small_eigenvalues():
    scale = 10.0 ** np.array([6, 3, 0, -3, -6])
    b = np.full((5, 5), 0.3) + 0.7 * np.eye(5)
    values, vectors = whitening.jacobi(b * scale[:, None] * scale)
    assert np.isclose(np.prod(values), np.linalg.det(b) * np.prod(scale) ** 2, rtol=1e-10)
    assert np.abs(vectors.T @ vectors - np.eye(5)).max() < 1e-12 and (np.diff(values) < 0).all()


def plain_capacity(sizes, shards):
    """Least largest shard of a contiguous cut, by the table of all cuts."""
    sums = np.r_[0, np.cumsum(sizes)]
    best = sums.astype(float)
    for _ in range(shards - 1):
        best = np.array([np.maximum(best[: i + 1], sums[i] - sums[: i + 1]).min() for i in range(len(sums))])
    return int(best[-1])


SHARD_DOCS = "doc_id long, text string"


@pytest.mark.parametrize("shards, copies", [(24, 0), (5, 0), (24, 300), (1, 3)])
def test_sharding_is_minimal(spark, shards, copies):
    rng = np.random.default_rng(shards)
    rows = [(k, "é" * int(rng.integers(0, 60)) + str(rng.integers(0, 400))) for k in range(500)]
    rows += [(1000 + k, "the same text " * 3) for k in range(copies)] + [(None, None), (None, ""), (5, None), rows[0], rows[0], (6, "x" * 900)]
    df = spark.createDataFrame(rows, SHARD_DOCS).selectExpr("*", "1 AS size", "2 AS shard", "3 AS key", "4 AS chunk")
    out = sharding.assign(df, shards).collect()
    key = lambda i, t: (i is None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text_crc32, r.size) for r in out) == sorted(key(*r) for r in rows)
    shard_of = defaultdict(set)
    sizes, slots = Counter(), defaultdict(list)
    for r in out:
        shard_of[r.text_crc32, r.size].add(r.shard)
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in shard_of.values()) and set(sizes) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)}
    # The capacity of what is cut, in the same order, is the least there is.
    groups = Counter()
    for r in sharding.sized(df).collect():
        groups[r.key] += r["size"]
    cuts = sharding.cuts_of(sharding.sized(df), shards)
    rest = [n for k, n in sorted(groups.items()) if k not in cuts.alone]
    assert len(cuts.alone) == (1 if copies == 300 else 0)
    assert max(n for k, n in sizes.items() if k >= len(cuts.alone)) == plain_capacity(rest, shards - len(cuts.alone))


def test_sharding_splits_ranges_until_sure(spark, monkeypatch):
    """Few ranges a round give the same cuts as many."""
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(int(k), int(n)) for k, n in zip(rng.integers(-(2**63), 2**63 - 1, 3000), rng.integers(8, 900, 3000))], "key long, size long")
    want = sharding.cuts_of(rows, 24)
    monkeypatch.setattr(sharding, "FIRST_BITS", 3)
    monkeypatch.setattr(sharding, "SPLIT", 64)
    monkeypatch.setattr(sharding, "SPANS", 16)
    few = sharding.cuts_of(rows, 24)
    held = sorted(tuple(r) for r in rows.collect())
    largest = lambda starts: max(sum(n for k, n in held if a <= k < b) for a, b in zip([-(2**63), *starts], [*starts, 2**63]))
    assert largest(want.starts) == largest(few.starts) == plain_capacity([n for _, n in held], 24)


def test_sharding_few_and_none(spark, tmp_path):
    assert sharding.assign(spark.createDataFrame([], SHARD_DOCS)).collect() == []
    two = sharding.assign(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], SHARD_DOCS), 24).collect()
    assert len({r.shard for r in two}) == 2
    docs = spark.createDataFrame([(k, f"text {k % 50}") for k in range(200)], SHARD_DOCS)
    cuts = sharding.write_shards(docs, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 200 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3} and len(cuts.starts) == 3
