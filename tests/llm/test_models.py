"""Learned operators: exact parts against brute force, learned parts on held-out rows."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from surveyloom.llm import hmm, language, neighbours, toxicity

EXTRA = [(900001, None, "en"), (900002, "", "en"), (900003, "12 34² ½ !!", "en"), (900004, "Hello the and", None), (900004, "Hello the and", None)]


@pytest.fixture(scope="module")
def docs(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    return table.unionByName(spark.createDataFrame(EXTRA, "doc_id long, text string, lang string")).selectExpr("*", "'x' AS score", "1 AS k").cache()


def remainder(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(0)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    m = hmm.Model(norm(rng.random(3)), norm(rng.random((3, 3))), norm(rng.random((3, 5))))
    texts = [np.array(rng.integers(0, 5, n)) for n in (6, 4, 4, 1)]
    for part, ids, lengths in hmm._padded(texts):
        got, _ = hmm.forward(m, ids, lengths)
        for stretch in (1, 2, 4, 100):  # however the way back is cut
            start, move, emit = hmm._zero(3, 5)
            total = hmm.expected(m, ids, lengths, start, move, emit, stretch)
    want, counts = [], np.zeros((3, 5))
    for k in part:
        x, like, c = texts[k], 0.0, np.zeros((3, 5))
        for path in itertools.product(range(3), repeat=len(x)):
            p = m.start[path[0]] * m.emit[path[0], x[0]]
            for a, b, s in zip(path, path[1:], x[1:]):
                p *= m.move[a, b] * m.emit[b, s]
            like += p
            for z, s in zip(path, x):
                c[z, s] += p
        want.append(math.log10(like))
        counts += c / like
    assert np.allclose(got, want) and abs(total - sum(want)) < 1e-9
    assert np.allclose(emit, counts, atol=1e-5) and abs(start.sum() - 4) < 1e-5
    assert abs(move.sum() - sum(len(t) - 1 for t in texts)) < 1e-4


def test_hmm_scores(spark, docs):
    rows = docs.collect()
    got = hmm.score(docs).collect()
    assert len(got) == len(rows)
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    c = Counter(w for r in rows if remainder(r.doc_id, 7) != 2 for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    texts = {r.doc_id: r.text for r in rows}
    for r in got:
        w = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(r.doc_id, 7) == 2, len(w), sum(x in c for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert r.score < 0
    assert len({(r.score, r.base_score) for r in got if r.doc_id == 900004}) == 1
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert hmm.score(docs.limit(0)).count() == 0


def test_hmm_is_a_distribution(spark):
    """Over all one-word texts and one never seen of each class, the mass is at most one."""
    rows = [(k, t) for k, t in enumerate(["aa bb aa", "aa cc", "bb aa dd dd", "ee"] * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prepared = hmm.rows_of(df)
    s = hmm.symbols_of(hmm.count_tokens(prepared))
    m = hmm.train(hmm.encode(prepared, s), s)
    assert np.allclose(m.emit.sum(axis=1), 1) and np.allclose(m.move.sum(axis=1), 1)
    assert s.base().sum() == pytest.approx(1)


def test_hmm_score_is_the_sum_over_paths(spark, monkeypatch):
    """A whole score, of rare and unseen words too, against all paths of states."""
    rows = [(k, t) for k, t in enumerate(["aa bb aa", "aa cc", "bb aa dd", "ee", None, "AA zz", "qq"] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {}
    train = hmm.train
    monkeypatch.setattr(hmm, "STATES", 2)
    monkeypatch.setattr(hmm, "train", lambda encoded, s, passes: kept.update(s=s, m=train(encoded, s, passes)) or kept["m"])
    got = {r.doc_id: r for r in hmm.score(df).collect()}
    m, s = kept["m"], kept["s"]
    c = Counter(w for k, t in rows if remainder(k, 7) != 2 for w in (t or "").lower().encode().split())
    for k, t in rows:
        words = (t or "").lower().encode().split()
        ids, within = [], 0.0
        for w in words:
            if w in s.words:
                ids.append(s.words[w])
            else:
                cls = zlib.crc32(w[-3:]) % hmm.CLASSES
                ids.append(len(s.words) + 1 + cls)
                within += math.log10((c[w] + 1) / s.mass[cls])
        ids.append(0)
        like = 0.0
        for path in itertools.product(range(len(m.start)), repeat=len(ids)):
            p = m.start[path[0]] * m.emit[path[0], ids[0]]
            for a, b, i in zip(path, path[1:], ids[1:]):
                p *= m.move[a, b] * m.emit[b, i]
            like += p
        assert got[k].score == pytest.approx(math.log10(like) + within, rel=1e-6)


def test_language_on_held_out_rows(spark, docs):
    rows = {r.doc_id: r for r in docs.collect()}
    got = language.identify(docs).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.doc_id < 900000]
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in held) / len(held) > 0.9
    for r in got:
        assert r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in rows[r.doc_id].text or ""))
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {900001, 900002, 900003}.isdisjoint(r.doc_id for r in kept.collect())
    assert kept.count() >= docs.count() - 4
    assert language.identify(docs.limit(0)).count() == 0


def test_crf_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(1)
    m = language.Model(["a", "b"], None, {}, None, rng.standard_normal((2, 2)), rng.standard_normal(2))
    lengths = np.array([5, 3])
    e = rng.standard_normal((5, 2, 2))
    got, pairs = language._marginals(e.copy(), lengths, m)
    move = np.zeros((2, 2))
    for b, n in enumerate(lengths):
        mass, want = 0.0, np.zeros((n, 2))
        each = np.zeros((2, 2))
        for path in itertools.product(range(2), repeat=int(n)):
            p = math.exp(m.start[path[0]] + sum(e[t, b, y] for t, y in enumerate(path)) + sum(m.transitions[x, y] for x, y in itertools.pairwise(path)))
            mass += p
            for t, y in enumerate(path):
                want[t, y] += p
            for x, y in itertools.pairwise(path):
                each[x, y] += p
        assert np.allclose(got[:n, b], want / mass)
        move += each / mass
    assert np.allclose(pairs, move)


def test_code_switched_words():
    a, b = "the of and with that was", "und der die nicht ist ein"
    m = language.fit([(a, "en"), (b, "de")] * 40)
    (lang, share, n, switches), *_ = language.predict(m, [f"{a} {b} {a}"])
    assert (lang, n) == ("en", 18) and switches >= 1 and 0.5 < share < 0.9


def test_long_texts_in_stretches():
    rng = np.random.default_rng(2)
    a, b = "the of and with that was", "und der die nicht ist ein"
    m = language.fit([(a, "en"), (b, "de")] * 40)
    text = " ".join(rng.choice([a, b, "12 !", "\n  "], 300))
    lang, share, n, switches = language.predict(m, [text])[0]
    for long in (50, 400, 3000):
        got = language.predict(m, [text], long=long)[0]
        assert (got[0], got[2], got[3]) == (lang, n, switches) and got[1] == pytest.approx(share)


def test_evenly_mixed_texts_are_kept(spark):
    parts = {"en": "the of and with that was", "de": "und der die nicht ist ein", "fr": "les dans une pour est avec", "es": "los para del como pero muy"}
    m = language.fit([(t, y) for y, t in parts.items()] * 40)
    mixed = " ".join(parts.values())
    assert language.predict(m, [mixed])[0][1] < 0.35
    df = spark.createDataFrame([(1, mixed), (2, None), (3, "12 34 !"), (4, ""), (5, parts["de"])], "doc_id long, text string")
    assert sorted(r.doc_id for r in language.keep_identified(df, model=m).collect()) == [1, 5]


def test_toxicity_on_held_out_rows(spark, docs, small):
    larger = spark.read.parquet(f"{small.replace('0.001', '0.1')}/documents.parquet")
    labels = spark.read.parquet(f"{small.replace('0.001', '0.1')}/labels.parquet").withColumnRenamed("quality", "score")
    both = larger.select("doc_id", "text").unionByName(docs.filter("doc_id > 900000").select("doc_id", "text"))
    got = {r.doc_id: r for r in toxicity.score(both, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect() if remainder(r.doc_id, 4) == 2}
    assert all(got[i].held_out for i in truth)
    found = [i for i in truth if got[i].predicted]
    # 300 toxic texts to learn from: a few stems are toxic by chance.
    assert sum(truth[i] for i in found) / len(found) > 0.9
    assert sum(truth[i] for i in found) / sum(truth.values()) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert got[900001].predicted == 0
    assert toxicity.score(both.limit(0), labels).count() == 0
    assert toxicity.score(docs.select("doc_id", "text")).count() == docs.count()


def test_grammar_clauses():
    x = toxicity
    i, h, n, t, r, s, o, k = x.INSULT, x.THREAT, x.NEGATION, x.TARGET, x.REPORT, x.STOP, x.OTHER, x.LINK
    got = lambda classes: [(c.kind, c.first, c.last, c.marks) for c in x.clauses(classes)]
    assert got([t, k, i]) == [(i, 2, 2, x.AIMED)]  # you are (a) moron
    assert got([t, k, k, i, o, i, s]) == [(i, 3, 5, x.AIMED)]  # one clause of two heads
    assert got([i, o, o, o, i]) == [(i, 0, 0, 0), (i, 4, 4, 0)]
    assert got([i, o, t]) == [(i, 0, 0, x.AIMED)]
    assert got([n, o, i]) == [(i, 2, 2, x.NEGATED)]
    assert got([n, o, o, o, i]) == [(i, 4, 4, 0)]
    assert got([r, o, o, o, i, s, i]) == [(i, 4, 4, x.REPORTED), (i, 6, 6, 0)]
    assert got([t, s, i, s, t]) == [(i, 2, 2, 0)]
    assert got([o, t, n]) == []
    assert got([t, k, h, t, o, o, i]) == [(h, 2, 2, x.AIMED), (i, 6, 6, x.AIMED)]
    assert x.clauses([i, k, i], [2.0, 0.0, 3.0])[0].weight == 5.0


def test_grammar_is_the_product_of_its_parts():
    rng = np.random.default_rng(3)
    parts = [toxicity.pattern(toxicity.INSULT), toxicity.reach(toxicity.NEGATION, 3, toxicity.NEGATED), toxicity.reach(toxicity.TARGET, 5, toxicity.AIMED)]
    after, marks = toxicity.compose(parts)
    for _ in range(200):
        state, own = 0, [0, 0, 0]
        for c in rng.integers(0, toxicity.CLASSES, 30).tolist():
            steps = [p.arcs[q][c] for p, q in zip(parts, own)]
            assert marks[state][c] == tuple(m for _, m in steps)
            state, own = after[state][c], [q for q, _ in steps]


def test_grammar_reads_phrases():
    g = toxicity.fit([])
    read = toxicity._reader(g)
    assert toxicity.features(read, "You will regret this.")[1] == 1
    assert toxicity.features(read, "A regret. You will pass")[1] == 0
    aimed, alone = (toxicity.features(read, x)[0] for x in ("you are a stupid moron", "a moron is there"))
    assert aimed[2] > 0 and alone[2] == 0


def exact(vectors, k, every):
    ok = {i: np.array(v, dtype=float) for i, v in vectors if v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    return {q: sorted(((-float((ok[i] * ok[q]).sum()), i) for i in ok if i != q))[:k] for q in ok if q % every == 0}


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(np.float32(x)) for x in rng.standard_normal(8) * rng.choice([0.5, 2])]) for i in range(600)]
    vectors += [(i, vectors[3][1]) for i in range(1000, 1200)]
    vectors += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] + [1.0] * 7), (2060, [None] + [1.0] * 7), (2080, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, rank int")
    want = exact(vectors, 20, 20)
    rows = neighbours.nearest(df).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]], q
    assert neighbours.nearest(df.limit(0)).count() == 0
    few = neighbours.nearest(df.filter("vec_id < 4")).collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(0, 1), (0, 2), (0, 3)]


@pytest.mark.parametrize("own, many", [(400, 0), (0, 60), (30, 0), (400, 60)])
def test_neighbours_of_repeated_rows(spark, own, many):
    """``own`` copies of a query's row, ``many`` vectors of one id; one task, so that all meet."""
    rng = np.random.default_rng(12)
    flat = lambda x: [float(np.float32(c)) for c in x]
    n = 25 if own == 30 else 600  # the few are one leaf
    vectors = [(i, flat(rng.standard_normal(8))) for i in range(n)]
    hot = np.array(vectors[20][1])
    vectors += [(700 + i, flat(hot + 0.1 * rng.standard_normal(8))) for i in range(5)]
    vectors += [(20, vectors[20][1])] * own
    vectors += [(9, flat(hot + 0.1 * rng.standard_normal(8))) for _ in range(many)]
    vectors = [vectors[k] for k in rng.permutation(len(vectors))]
    x, ids = np.array([v for _, v in vectors]), np.array([i for i, _ in vectors])
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<float>").coalesce(1)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q, rows in got.items():
        best = {}
        for i, p in zip(ids.tolist(), (x @ x[ids == q].T).max(axis=1)):
            if i != q:
                best[i] = max(p, best.get(i, -np.inf))
        want = sorted(best, key=lambda i: (-best[i], i))[:20]
        assert [i for _, i, _ in sorted(rows)] == want, q
        assert np.allclose([s for _, _, s in sorted(rows)], [best[i] for i in want])


def test_neighbours_recall(spark):
    """The hardest case, directions without any structure, with fewer products than exact search."""
    rng = np.random.default_rng(6)
    n = 12_000
    x = rng.standard_normal((n, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    x = x.astype(np.float64)
    assert 0.4 * n + 2500 < 0.65 * n
    got = {}
    for r in neighbours.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in got:
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == n // 20 and hit / (20 * len(got)) >= 0.9


def test_forest_fits_its_broadcast_whatever_the_dimensions():
    """32 trees of 769 components were 403 MB on these points, over the bound (F3)."""
    points = np.random.default_rng(3).standard_normal((4096, 769))
    depth, trees = neighbours.grow(points, 32, 2.0, 1)
    assert depth == 10 and sum(t.normals.nbytes for t in trees) <= neighbours.FOREST_BYTES
    held = np.bincount(neighbours.leaves(trees[0], depth, points), minlength=2**depth)
    assert held.sum() == 4096 and held.min() >= 1 and held.max() <= 8
