"""Line dedup, SimHash, decontamination and pieces against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from surveyloom.llm import lines, pieces, simhash, tiling
from surveyloom.llm.common import words_of
from surveyloom.llm.graph import components

EDGES = [None, "", "   ", "\n\n", "x", "same text here now", "same text here now", "é🎉 ß\x00", "w " * 3000]


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "key", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, root string, lid int")


def union_find(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_match_union_find(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)] + [(900, k) for k in range(500, 560)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {n: r for n, r in union_find(linked, pairs).items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in s) > len(s)) if s else 0


def test_simhash_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = ["w%d" % k for k in range(400)]
    texts = list(EDGES)
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(150)]
        for _ in range(8):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(150)] = rng.choice(vocab)
            texts.append(" ".join(words))
    df = frame(spark, texts)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(texts)
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.fp % 2**64 for r in got} == fps
    pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    assert {r.doc_id: r.component_id for r in got} == union_find(fps, pairs)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(union_find(fps, pairs).values()))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_mih_finds_all_pairs(spark):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for d in range(1, 6):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), d)))
    signed = [np.uint64(f).astype(np.int64).item() for f in fps]
    got = {frozenset((r.a % 2**64, r.b % 2**64)) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert got == {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 4)


def jaccard(a, b, n=8):
    s = [{x[i : i + n] for i in range(len(x) - n + 1)} or {x} for x in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(4)
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet", "kilo"]
    words = [a + b for a in words for b in words]
    fresh = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [fresh(n) for n in (3, 6, 12, 14, 20, 40, 200)]
    texts = list(EDGES)
    for _ in range(60):
        out = []
        for _ in range(4):
            x = rng.choice(base) if rng.random() < 0.6 else fresh(rng.choice([2, 10, 25]))
            if rng.random() < 0.4 and len(x) > 150:
                at = rng.randrange(len(x) - 3)
                x = x[:at] + "zz" + x[at + 2 :]
            out.append(x)
        texts.append("\n".join(out + [""]))
    df = frame(spark, texts)
    got = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    assert len(got) == len(texts)
    places = [(d, p, x) for d, t in enumerate(texts) if t is not None for p, x in enumerate(t.split("\n")) if x.strip(" ")]
    distinct = sorted({x for _, _, x in places})
    near = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if jaccard(a, b) >= 0.8]
    assert near
    root = union_find(distinct, near)
    first = {}
    for d, p, x in places:
        first.setdefault(root[x], (d, p))
    for d, t in enumerate(texts):
        if t is None:
            assert got[d].text is None and got[d].n_dropped == 0
            continue
        stay = [x for p, x in enumerate(t.split("\n")) if not x.strip(" ") or first[root[x]] == (d, p)]
        assert got[d].text == "\n".join(stay), d
        assert got[d].n_lines - got[d].n_dropped == len(stay)
    assert lines.dedup_lines(df.limit(0)).count() == 0
    clash = lines.dedup_lines(df.selectExpr("doc_id", "text", "lid AS n_lines", "root AS _gone"))
    assert clash.columns == ["doc_id", "text", "n_lines_in", "_gone_in", "n_lines", "n_dropped"]


def test_line_dedup_repeated_rows_and_ids(spark):
    df = frame(spark, ["one line of text\nand another", "one line of text\nand another", "a third one\none line of text"], [5, 5, None])
    got = sorted((r.doc_id or -1, r.text) for r in lines.dedup_lines(df).collect())
    # The null id comes first and keeps the shared line.
    assert got == [(-1, "a third one\none line of text"), (5, "and another"), (5, "and another")]


def test_line_dedup_long_lines(spark):
    rng = random.Random(8)
    free = "aeostlc "  # none of the characters that long lines' shingles once had to begin with
    some = lambda n, of=free: "".join(rng.choice(of) for _ in range(n))
    texts = [c * n for c in "-=_#" for n in (200, 210)]
    body = some(300)
    texts += [body, body[:150] + "t" + body[151:]]
    digits = some(260, "01345789")
    texts += [digits, digits[:-1] + "9", digits[:-1] + "8"]
    short = some(120, free + "bfjnrvz")
    texts += [short, short + short, (short + " ") * 5, "ab " * 50, "ab " * 90, some(220), some(220, "bfjnrvz26.")]
    got = {r.doc_id: r for r in lines.dedup_lines(frame(spark, texts)).collect()}
    near = [(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if jaccard(a, b) >= 0.8]
    assert len(near) > 8
    root = union_find(texts, near)
    first = {}
    for d, x in enumerate(texts):
        first.setdefault(root[x], d)
    assert {d for d, r in got.items() if r.n_dropped == 0} == set(first.values())


def test_line_dedup_long_lines_at_exactly_the_least(spark):
    # A band is shared with a probability of 0.975 at 0.8, so a few pairs may stay apart.
    rng = random.Random(15)
    texts = []
    for _ in range(60):
        a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(8 * 40 + 7))
        b = a + "".join(rng.choice("BFJNRVZ") for _ in range(80))  # all of them once chosen, of a's few
        assert jaccard(a, b) == 0.8
        texts += [a, b]
    got = lines.dedup_lines(frame(spark, texts)).collect()
    assert {r.doc_id for r in got if r.n_dropped} <= set(range(1, 120, 2))
    assert sum(r.n_dropped for r in got) >= 54


def plain_tiles(doc, item, shortest):
    """Greedy string tiling by definition: the longest unmarked match, again and again."""
    md, mi, tiles = [False] * len(doc), [False] * len(item), 0
    while True:
        best = None
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and not md[d + n] and not mi[i + n]:
                    n += 1
                if n >= shortest and (best is None or (-n, d, i) < best):
                    best = (-n, d, i)
        if best is None:
            return tiles
        n, d, i = -best[0], best[1], best[2]
        md[d : d + n] = [True] * n
        mi[i : i + n] = [True] * n
        tiles += n


def test_tiling_matches_definition(spark):
    rng = random.Random(6)
    items = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 2, 5, 9, 25, 30]))) for _ in range(14)]
    docs = list(EDGES)
    for _ in range(25):
        parts = []
        for _ in range(3):
            w = rng.choice(items).split()
            at = rng.randrange(len(w) + 1)
            parts += w[at:] + w[:at] + [rng.choice("abcdxyz") for _ in range(4)]
        docs.append(" ".join(parts).upper())
    bench = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)] + [(99, None, "x")], "item_id long, text string, doc_id string")
    df = frame(spark, docs)
    got = {(r.doc_id, r.item_id): r.tiled_words for r in tiling.contaminated(df, bench).collect()}
    want = {}
    for d, t in enumerate(docs):
        for i, x in enumerate(items):
            dw, iw = words_of(t), words_of(x)
            if iw and len(dw) < 500:
                n = plain_tiles(dw, iw, min(5, len(iw)))
                if n and n >= 0.4 * len(iw):
                    want[d, i] = n
    assert got == want and len(want) > 20
    blocks = tiling.contaminated(df, bench, block_bytes=200)
    assert {(r.doc_id, r.item_id): r.tiled_words for r in blocks.collect()} == want
    clean = tiling.keep_clean(df, bench, block_bytes=200)
    assert {r.doc_id for r in clean.collect()} == set(range(len(docs))) - {d for d, _ in want}
    assert tiling.contaminated(df, bench.limit(0)).count() == 0
    assert tiling.contaminated(df.limit(0), bench).count() == 0


@pytest.fixture(scope="module")
def piece_library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)


def test_pieces_match_the_library(spark, small, piece_library):
    rng = random.Random(2)
    texts = [*EDGES, "  a", " " * 40, "a" + " " * 35 + "bcd", "▁ ▁▁x", "Hello  world.\n\tx,y", "日本語 梦 🎉🎉", "a　b\xa0c\r\n"]
    texts += ["".join(rng.choice("ab cde ▁ \n\téü日zZ09.,-the") for _ in range(rng.randrange(60))) for _ in range(400)]
    got = pieces.encode_decode(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        assert r.ids == piece_library.encode(text), text
        assert r.decoded == piece_library.decode(r.ids)
        assert r.n_ids == len(r.ids) and r.reversible == (r.decoded == text)
        assert r.reversible or "▁" in text
    docs = spark.read.parquet(f"{small}/documents.parquet")
    whole = {r.doc_id: r.text for r in docs.collect()}
    for r in pieces.encode_decode(docs).collect():
        assert r.ids == piece_library.encode(whole[r.doc_id])
    assert pieces.encode_decode(docs.limit(0)).count() == 0


def _field(number, value):
    """A protocol-buffer field: bytes, an int or a float."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def _character_map(pairs):
    """A compiled character map by the format's definition: a trie, one unit a place."""
    import struct

    trie, targets, at = {}, b"", {}
    for source, target in pairs.items():
        at[source], targets = len(targets), targets + target + b"\0"
        node = trie
        for byte in source:
            node = node.setdefault(byte, {})
        node[0] = at[source]
    units = [0] * 4096
    free = iter(range(1, 16))

    def place(node, unit, keep):
        base = next(free) * 256
        units[unit] = keep | (unit ^ base) << 10
        for label, child in node.items():
            if label == 0:
                units[base] = 1 << 31 | child
            else:
                place(child, base ^ label, label | (0x100 if 0 in child else 0))

    place(trie, 0, 0)
    return struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + targets


def _model(pieces_, kind, normaliser=b"", fallback=True):
    body = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, k)) for p, s, k in pieces_)
    return body + _field(2, _field(3, kind) + _field(35, int(fallback)) + _field(40, 0)) + _field(3, normaliser)


def test_unigram_takes_the_shortest_path():
    rng = random.Random(3)
    found = [("<unk>", 0.0, 2)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(14)} | {"▁", "▁a"}
    found += [(w, -rng.random() * 5 - 1, 1) for w in sorted(words)]
    t = pieces.Transducer(_model(found, pieces.UNIGRAM, _field(4, 0)))
    weights = {w: -s for w, s, _ in found[257:]}

    def all_paths(text):
        if not text:
            yield 0.0, ()
        for n in range(1, len(text) + 1):
            w = weights.get(text[:n], t.lexicon.worst if n == 1 else None)
            if w is not None:
                for rest, out in all_paths(text[n:]):
                    yield w + rest, (text[:n], *out)

    for _ in range(60):
        text = "".join(rng.choice("abcdü") for _ in range(rng.randrange(1, 9)))
        cost, ids = pieces.shortest_path(text, t.lexicon, t.acceptor, 0)
        assert cost == pytest.approx(min(all_paths(text))[0], rel=1e-5)
        assert t.decode(ids) == text
        assert t.decode(t.encode(text + " a")) == text + " a"


def test_normaliser_with_a_character_map(spark, tmp_path):
    pairs = {"ﬁ": "fi", "Ａ": "A", "a\u0301": "á", "½": "1/2", "\t": " "}
    blob = _character_map({k.encode(): v.encode() for k, v in pairs.items()})
    assert {k.decode(): v.decode() for k, v in pieces.character_map(blob).items()} == pairs
    found = [("<unk>", 0.0, 2)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] + [(c, -1.0 - k / 100, 1) for k, c in enumerate("▁fiA1/2áx")]
    data = _model(found, pieces.UNIGRAM, _field(2, blob) + _field(3, 1) + _field(4, 1) + _field(5, 1))
    t = pieces.Transducer(data)
    assert t.normalise("  ﬁ\tＡ  a\u0301 ½ ") == "▁fi▁A▁á▁1/2"
    assert t.decode(t.encode("ﬁ  x")) == "fi x"
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    for text in ("ﬁ Ａx", " a\u0301  ½\tx ", "üx", ""):
        assert t.encode(text) == library.encode(text)
    (tmp_path / "m.model").write_bytes(data)
    (row,) = pieces.encode_decode(spark.createDataFrame([(1, "ﬁ x")], "doc_id long, text string"), str(tmp_path / "m.model")).collect()
    assert (row.decoded, row.reversible) == ("fi x", False)


def test_neighbours_are_told_by_each_pieces_merges(monkeypatch):
    """Work grows with the pieces, not with the pairs of pieces, and words end before
    signs that no piece has after a letter."""
    with open(pieces.DEFAULT_MODEL, "rb") as f:
        t = pieces.Transducer(f.read())
    merged, calls = t.acceptor.merged, []
    rng = random.Random(5)
    words = ["".join(rng.choices(["th", "on", "é", "tion", "a", "sh", "ou", "q", "er", "W", "9", "ly"], k=5)) for _ in range(2000)]
    with monkeypatch.context() as m:
        m.setattr(t.acceptor, "merged", lambda text: calls.append(text) or merged(text))
        for w in words:
            t.path(w)
    assert not calls and len(t.acceptor.known) > len(t.acceptor.ends) > 20
    ids = list(t.lexicon.ids.values())
    pairs = [(k >> 24, k & 0xFFFFFF) for k in t.acceptor.known] + [tuple(rng.choices(ids, k=2)) for _ in range(3000)]
    for x, y in pairs:
        a, b = t.text[x], t.text[y]
        assert t.acceptor.follows(x, y) == (merged(a + b) == [a, b])
    assert t.parts("▁word&&&▁it,▁x") == ["▁word", "&&&", "▁it", ",", "▁x"]


def test_rows_are_decoded_without_a_call_a_row(monkeypatch, piece_library):
    """Only rows with bytes of 128 or more, or without a text of their own, go alone."""
    with open(pieces.DEFAULT_MODEL, "rb") as f:
        t = pieces.Transducer(f.read())
    texts = ["", " two  lines\nand \t a tab", "plain", "▁ ", "日本語 \U0001f600\n", "é\r\n", "a  b "]
    rows = [t.encode(x) for x in texts]
    rng = random.Random(11)
    odd = [[rng.randrange(3, 259) if rng.random() < 0.6 else rng.randrange(len(t.text)) for _ in range(rng.randrange(9))] for _ in range(500)]
    alone, decode = [], t.decode
    expected = [decode(x) for x in rows + odd]
    assert expected[: len(rows)] == [piece_library.decode(x) for x in rows]
    with monkeypatch.context() as m:
        m.setattr(t, "decode", lambda ids: alone.append(ids) or decode(ids))
        assert t.decode_rows(pa.array(rows, pa.list_(pa.int32()))).to_pylist() == expected[: len(rows)]
        assert len(alone) <= 1
        assert t.decode_rows(pa.array(odd, pa.list_(pa.int32()))).to_pylist() == expected[len(rows) :]
        assert t.decode_rows(pa.array([], pa.list_(pa.int32()))).to_pylist() == []


def test_only_path_is_the_composition_shortest(piece_library):
    rng = random.Random(7)
    with open(pieces.DEFAULT_MODEL, "rb") as f:
        t = pieces.Transducer(f.read(), 4000)  # a cache that turns over
    for _ in range(150):
        word = "".join(rng.choice("theonrgiß日") for _ in range(rng.randrange(1, 14)))
        assert t.path(word) == list(pieces.shortest_path(word, t.lexicon, t.acceptor)[1])
        assert t.encode(word) == piece_library.encode(word)


def test_keep_one_tells_rows_of_one_id_apart(spark):
    a, b = "one text of some words here", "another text that is not like it at all"
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (5, b, 3), (None, "a third one with words", 4), (7, None, 5), (8, "", 6), (8, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text int")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    # Null and blank texts share fingerprint 0.
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [(-1, "a third one with words"), (3, a), (5, b), (7, "")]
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_words_come_in_blocks(spark):
    from surveyloom.llm.common import word_blocks

    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice("abÄ \n\t\u00a0") for _ in range(rng.randrange(80)))
        for size in (1, 7, 1000):
            assert [w for ws in word_blocks(text, size) for w in ws] == words_of(text)


@pytest.mark.parametrize("length", [30, 80, 200, 400, 1500])
def test_line_recall_by_length(spark, length):
    """Pairs just above the least similarity, at each length: a line and one with more."""
    rng = random.Random(length)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    texts, wanted = [], 0
    for _ in range(150):
        a = some(length)
        n = length - 7
        b = a + some(int(n / rng.uniform(0.8, 0.86)) - n)
        wanted += jaccard(a, b) >= 0.8
        texts += [a, b]
    got = lines.dedup_lines(frame(spark, texts)).collect()
    assert sum(r.n_dropped for r in got) >= 0.95 * wanted > 100


def test_line_families_lose_no_link(spark):
    """Diffuse families: most copies are unlike the original, some near each other."""
    rng = random.Random(21)
    words = [a + b for a in ("ala", "bro", "chi", "dela", "eko") for b in ("na", "vik", "ster", "mon", "qua")]
    texts = []
    for _ in range(3):
        base = [rng.choice(words) for _ in range(40)]
        for _ in range(45):
            copy = list(base)
            for _ in range(rng.randrange(1, 7)):
                copy[rng.randrange(40)] = rng.choice(words)
            if rng.random() < 0.3:
                copy = copy[: rng.randrange(26, 40)]
            texts.append(" ".join(copy))
            if rng.random() < 0.3:
                copy[rng.randrange(len(copy))] = rng.choice(words)
                texts.append(" ".join(copy))
    texts = list(dict.fromkeys(texts))
    got = {r.doc_id: r for r in lines.dedup_lines(frame(spark, texts)).collect()}
    near = [(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if jaccard(a, b) >= 0.8]
    root = union_find(texts, near)
    first = {}
    for d, x in enumerate(texts):
        first.setdefault(root[x], d)
    kept = {d for d, r in got.items() if r.n_dropped == 0}
    # Pairs that no band proposes may stay apart; few do, and none is linked wrongly.
    assert kept >= set(first.values()) and len(kept) <= 1.05 * len(first) + 1
