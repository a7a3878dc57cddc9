"""Parsers over DataFrames give, for each survey, what the parser of one file gives."""

import pytest
from surveyloom.sources.parsers import frames, parse_cpss, parse_lfs_codebook, parse_mono, parse_split

ENGLISH = """* head
data list file='x' /
  V1 1 - 4 (2)  V2 5
  V3 6 - 9 (A)   V4 10-12 (F8.3) V5 13
.
VARIABLE LABELS
  V1 "One"
  /V2 'It''s two'
  V3\t"Thr" +
     "ee"
  V1 "again"
.
stray "text"
VALUE LABELS
 /V2 V5,
  V6
   1 "a/b" 02.50 "half"
   '03' "three."
 /V3 "A" "first" "B" ""
 V4 1 "One" 1 "twice" .
Variable  labels
  V6 "six" .
FORMATS V1 (F8.0) V2 V6 (A2) .
MISSING VALUES V1 (9) V4 (1E3 THRU ) V4, V5 (-1 THRU 3.5) .
EXECUTE .
"""
FRENCH = ENGLISH.replace("One", "Un").replace("first", "le premier").replace("six", "l'été")


def tables(parsed):
    rows = lambda df, names: [tuple(r[n] for n in names) for r in df.orderBy("survey", "ord").collect()]
    out = {}
    for r in rows(parsed.variables, ("survey", "name", "label_en", "label_fr", "type", "decimals", "missing_low", "missing_high")):
        out.setdefault(r[0], ([], [], []))[0].append(r[1:])
    for r in rows(parsed.codes, ("survey", "name", "val", "label_en", "label_fr")):
        out.setdefault(r[0], ([], [], []))[1].append(r[1:])
    if parsed.layout is not None:
        for r in rows(parsed.layout, ("survey", "name", "start", "end")):
            out.setdefault(r[0], ([], [], []))[2].append(r[1:])
    return out


def plain(m):
    return (
        [(v.name, v.label_en, v.label_fr, v.type, v.decimals, v.missing_low, v.missing_high) for v in m.variables],
        [(c.name, c.val, c.label_en, c.label_fr) for c in m.codes], [(f.name, f.start, f.end) for f in m.layout or ()],
    )


def same(got, want):
    # A file's codes of several names come name by name here, group by group there.
    assert got[0] == want[0] and sorted(got[1], key=str) == sorted(want[1], key=str) and got[2] == want[2]


def test_command_files(spark):
    sentinel = "VARIABLE LABELS\n X 'only missing'\n.\nVALUE LABELS\n/X 97 \"Don't know\" 99 \"Not stated\"\n.\n"
    texts = {"a": (ENGLISH, FRENCH), "b": (ENGLISH.replace("V", "W"), None), "c": (sentinel, None), "d": ("", None), "e": (None, FRENCH), "f": ("no sections at all", None)}
    rows = [(k, lang, 0, t) for k, both in texts.items() for lang, t in zip(("eng", "fra"), both) if t is not None or lang == "eng"]
    got = tables(frames.command_files(spark.createDataFrame(rows, "survey string, lang string, part int, text string")))
    assert set(got) == {"a", "b", "c"}
    for k in got:
        same(got[k], plain(parse_mono(*texts[k])))
    assert got["a"][0][0] == ("V1", "One", "Un", "numeric", 0, 9.0, 9.0)
    assert ("V3", "B", None, None) in got["a"][1] and ("V2", "2.5", "half", "half") in got["a"][1]


def test_split_files(spark):
    roles = {
        "layout": "DATA LIST FILE = IN NOTABLE/\n  V1 1 - 8 (A)\n  V2 9 - 12 (2)\n  V3 13\n", "labels_en": 'VARIABLE LABELS\n  V1 "one"\n  V2 "two"\n', "codes_en": 'VALUE LABELS\n /V1\n "01" "x"\n',
        "missing": "Comment text\nMISSING VALUES\n V2 (9996 THRU 9999)\n", "labels_fr": 'VARIABLE LABELS\n  V1 "un"\n', "codes_fr": 'VALUE LABELS\n /V1\n "01" "le x"\n',
    }
    rows = [(s, role, t) for s in ("p", "q") for role, t in roles.items()] + [("p", "notes", 'VARIABLE LABELS\n V9 "not read"')]
    got = tables(frames.split_files(spark.createDataFrame(rows, "survey string, role string, text string")))
    want = plain(parse_split(*(roles[k] for k in ("layout", "labels_en", "codes_en", "missing", "labels_fr", "codes_fr"))))
    assert set(got) == {"p", "q"}
    for s in got:
        same(got[s], want)


LFS = '﻿Field_Champ,Variable_Variable,EnglishLabel,FrenchLabel\nrec_num,,"Order, of ""record""\nin file",Ordre\n,,,\nSURVMNTH,,Month,Mois\n,1,January,Janvier\n,12,December,\nAGE,,Age,\n,15-70,years,ans\n,blank,None,\nHRS,,Hours,Heures\n,97,Valid skip,\n,99,Not stated,\n'
CPSS = "Variable / V,Variable name - English / E,Variable name - French / F,Code / C,Label - English / E,Label - French / F\nage,Age,Âge,1,Young,Jeune\n,,,2,Old,\nsex,Sex,,,,\n"


@pytest.mark.parametrize("text, many, one", [(LFS, frames.lfs_codebooks, parse_lfs_codebook), (CPSS, frames.cpss_codebooks, parse_cpss)])
def test_codebooks(spark, text, many, one):
    rows = [("a", text), ("b", text.replace("\n", "\r\n")), ("c", ""), ("d", None)]
    got = tables(many(spark.createDataFrame(rows, "survey string, text string")))
    assert set(got) == {"a", "b"}
    for s in got:
        same(got[s], plain(one(text)))


def test_command_files_keep_a_survey_in_its_row(spark):
    """No window over lines or tokens (F7 to F11), and lines are told as they were."""
    text = "* old\nrecode a.\n  Data  list file='x.'.\n/ a 1 - 2\n.\n lost\nVALUE LABELS a 1 'one.'\n  \x0b/* no\n comment x\n 2 'two' / b c 'x' 'y' , d 3 \"z\".\nnot read 'x'\nvalue\tlabels e 4 'four'\n"
    texts = spark.createDataFrame([("s", "eng", 1, text), ("s", "eng", 2, " 5 'five'\n"), ("s", "eng", 3, None), ("t", "eng", 0, "")], "survey string, lang string, part int, text string")
    parts = frames.sections(texts)
    assert [(r.section, r.body) for r in sorted(parts.collect(), key=lambda r: r.k)] == [
        ("RECODE", " a"), ("DATA LIST", " file='x.'"), ("VALUE LABELS", " a 1 'one.'\n 2 'two' / b c 'x' 'y' , d 3 \"z\""), ("VALUE LABELS", " e 4 'four'\n\n 5 'five'\n"),
    ]
    codes = frames.value_labels(parts)
    assert sorted((r.name, r.val, r.label) for r in codes.collect()) == [("A", "1", "one."), ("A", "2", "two"), ("B", "x", "y"), ("C", "x", "y"), ("D", "3", "z"), ("E", "4", "four"), ("E", "5", "five")]
    assert "Window" not in codes._jdf.queryExecution().executedPlan().toString()


def test_texts_are_dealt_by_their_bytes(spark, small, monkeypatch):
    """Partitions of made files and of sections follow the rows and bytes, not Spark's own number (F8 to F10)."""
    from surveyloom.plans import file_queries

    monkeypatch.setattr(frames, "PART_BYTES", 20_000)
    monkeypatch.setattr(file_queries, "PART_ROWS", 100)
    dealt = {}

    def kept(df, name):
        dealt[name] = df
        return df

    monkeypatch.setattr(frames, "kept", kept)
    parsed = frames.command_files(file_queries._mono(spark, small))
    total = sum(len(r.text.encode()) for r in dealt["texts"].collect())
    rows = spark.read.parquet(f"{small}/orders.parquet").count()
    assert dealt["texts"].rdd.getNumPartitions() == 1 + rows // 100
    assert dealt["sections"].rdd.getNumPartitions() == 1 + total // 20_000 > 8
    assert parsed.layout.count() == rows
    plan = dealt["texts"]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1
