import hashlib
import random
import re

import duckdb
from surveyloom.llm import chat, queries, secrets


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_op2_matches_its_sql(spark, small):
    got = queries.op2_chat_format(spark, small).toPandas().sort_values("conv_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    want = con.execute(queries.ORACLE_SQL["op2_chat_format"]).df().sort_values("conv_id").reset_index(drop=True)
    assert len(got) > 10
    for c in want.columns:
        assert got[c].tolist() == want[c].tolist(), c


ROWS = [
    (1, 1, "user", "a</turn>\n### assistant: b"), (1, 2, "assistant", "\\b\\t \\"), (1, 3, "user", "tail ###"),
    (2, 0, "assistant", ""), (2, 1, "assistant", None), (2, 1, "assistant", None),
    (3, 5, "ro: le\\c", "x" * 50_000), (4, 0, None, "🎉é"), (None, None, "assistant", "null id"), (5, 0, "user", "<"),
]


def test_chat_reads_back_exactly(spark):
    df = spark.createDataFrame([(*r, "extra", 1) for r in ROWS], "conv_id long, turn long, role string, text string, formatted string, example int")
    ex = chat.expand(df).collect()
    assert sum(r.conv_id == 2 for r in ex) == 3
    for r in ex:
        masked = r.formatted[r.loss_start : r.loss_end]
        assert "</turn>" not in masked and "###" not in masked
    got = {r.conv_id: r for r in chat.digest(chat.expand(df)).collect()}
    by = {}
    for c, t, role, text in ROWS:
        by.setdefault(c, []).append((t if t is not None else -1, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, r, t in turns))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    assert chat.digest(chat.expand(df.limit(0))).count() == 0


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def test_op5_base_and_random(spark):
    rng = random.Random(5)
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(44))
    texts = [
        "token=abc then password: 'hunter2hunter2' é🎉 secret = \"abcdefgh\"", "token=secret : abcdefgh12", "AKIA" + "Q" * 12 + " AKIAAKIA AKIA7",
        f"🎉 {hexes} {hexes}z{hexes} {key} x", "API_KEY=12345678 apikey:1234567 TOKEN =  ab.cd=ef-gh", None, "", "plain words only", "e" * 40_000,
        "Secret=" + "b7db7aa4a5fcc78305" * 3, "Aa1" * 20, "token==abcdefgh",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "again")], "doc_id long, text string, spans string")
    got = secrets.digest(secrets.find_secrets(df)).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == sha(",".join(want)), (texts[r.doc_id], r.spans, want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex"))
        assert [x for x in r.spans.split(",") if x and not x.startswith("random")] == want
        if r.doc_id == 3:
            assert f"random:{texts[3].index(key)}:{texts[3].index(key) + 44}" in r.spans
        if r.doc_id == 10:
            assert "random" not in r.spans  # a repeated pattern fails the battery
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_op5_keys_within_longer_runs(spark):
    rng = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda n, of=letters: "".join(rng.choice(of) for _ in range(n))
    token, plus, under = "9fA3kLm2Qx7Zp0VbT4sYw8Rj1Nc6HdUe", some(20) + "+/" + some(20), some(20) + "-_" + some(20)
    hexes, upper = some(32, "0123456789abcdef"), some(40, "0123456789ABCDEF")
    texts = [
        (f"🎉 https://host.com/reset-password/{token}", [token]), (f"/srv/my_dir/{token}-x", [f"dir/{token}", f"{token}-x"]), (f"id-{plus}_x", [plus]), (f"a/b-c/{under}/d+e", [under]),
        (f"{hexes}/{token} end", [token]), (f"{token}-{hexes}", [token]), (f"{token}/{hexes}-{under}/z", [token, under]), (f"a-b/{upper}", [upper]),
        (f"{token} {plus} {under}", [token, plus, under]), ("some/long-path/to_a/file-name/without/any-Key2", []), (f"{hexes}/abc", []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in secrets.find_secrets(df).collect()}
    for i, (text, keys) in enumerate(texts):
        for k in keys:
            assert ("random", text.index(k), text.index(k) + len(k)) in got[i], (text, k, got[i])
        base = [x for x in got[i] if x[0] != "random"]
        assert [f"{k}:{s}:{e}" for k, s, e in base] == base_spans(text)
        assert all(e <= s2 or e2 <= s for k, s, e in got[i] if k == "random" for _, s2, e2 in base)
        assert len(got[i]) == len(set(got[i]))


def test_op5_whole_table(spark, small):
    small = small.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = queries.op5_secrets(spark, small).collect()
    assert len(got) == len(texts)
    assert sum(r.n_assign + r.n_access + r.n_hex for r in got) > 0
    for r in got:
        assert r.base_sha256 == sha(",".join(base_spans(texts[r.doc_id])))


def test_op5_reports_keys_not_words(spark):
    """Precision over paths, identifiers, listings and encoded text beside random keys."""
    import base64

    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = "https example path some file report user account information from database internal service handler response message table index value".split()
    ordinary = ["https/example/Path/To/Some/File2024/Report", letters, letters[::-1], "Aa1" * 15, "ABCDEFGHIJabcdefghij0123456789"]
    for k in range(150):
        some = [rng.choice(words) for _ in range(rng.randrange(4, 9))]
        ordinary += ["/".join(some).title() + str(k), "".join(w.title() for w in some) + str(2000 + k), "_".join(some).title() + "-v2"]
        ordinary.append(base64.b64encode(" ".join(some).encode()).decode().rstrip("="))
    keys = ["".join(rng.choice(letters + "+/") for _ in range(rng.randrange(32, 60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(ordinary + keys)), "doc_id long, text string")
    found = {r.doc_id for r in secrets.find_secrets(df).collect() if any(s.kind == "random" for s in r.spans)}
    wrong = sorted(i for i in found if i < len(ordinary))
    assert len(wrong) <= 0.05 * len(found), [ordinary[i] for i in wrong[:5]]
    assert len(found) - len(wrong) >= 0.9 * len(keys)


def test_op5_many_hits_in_one_text(spark):
    text = " é ".join(f"token={k:08d}" for k in range(3000))
    (r,) = secrets.digest(secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    assert r.n_assign == 3000 and r.base_sha256 == sha(",".join(base_spans(text)))
