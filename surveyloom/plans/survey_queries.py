"""Queries of parsers, builds, registry and store, and the SQL that tells their results.

Command files are made of the tables ``nation`` and ``region`` (25 and 5 rows at any
scale): nations are variables, named V and their key, regions their categories.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import convert
from ..model import Code, Field, Fixups, Metadata, Variable, bilingual_coverage
from ..operators import bootstrap, columns, estimate
from ..sources import detect, files, raw
from ..sources.merge import conflicts, merged
from ..sources.parsers import parse_cards, parse_codebook, parse_cpss, parse_dictionary, parse_labels, parse_lfs_codebook, parse_mono, parse_split
from ..sources.parsers.common import missing_items
from ..sources.parsers.sas import at_layout
from ..sources.parsers.spss import formats, value_labels, variable_labels
from ..sources.shared import kept, put_text, shared_folder
from . import build, catalogue, store
from .queries import _query, _t
from .registry import Entry, Registry, resolve_version

VARIABLES = "name string, label_en string, label_fr string, type string, decimals int, missing_low double, missing_high double"
CODES = "name string, val string, label_en string, label_fr string"


def _nations(spark: SparkSession, sf_dir: str) -> list[tuple[int, str, int]]:
    return sorted(tuple(r) for r in _t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect())


def _regions(spark: SparkSession, sf_dir: str) -> list[tuple[int, str]]:
    return sorted(tuple(r) for r in _t(spark, sf_dir, "region").select("r_regionkey", "r_name").collect())


def _frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(getattr(r, n) for n in names) if not isinstance(r, tuple) else r for r in rows], schema)


# -- one SPSS command file ---------------------------------------------------------


def _mono(spark, sf_dir, french: bool = False) -> str:
    """Variables of width k % 3 + 1; those of region 0 have decimals, of region 1 codes
    (regions), of region 2 a missing range."""
    n, r = _nations(spark, sf_dir), _regions(spark, sf_dir)
    fr = "fr " if french else ""
    place = lambda k: f"V{k} {10 * k + 1} - {10 * k + k % 3 + 1}"
    lines = ["DATA LIST FILE=X/", *[f"  {place(k)}" for k, _, _ in n], "  .", "FORMATS"]
    lines += ["  " + " / ".join(f"V{k} (F{k % 3 + 1}.{2 if g == 0 else 0})" for k, _, g in n) + " / .", "VARIABLE LABELS"]
    lines += [f"  V{k} '{fr}{name}'" for k, name, _ in n] + ["  .", "VALUE LABELS"]
    for k, _, g in n:
        if g == 1:
            lines += [f"/V{k}", *[f'   {key} "{fr}{name}"' for key, name in r]]
    return "\n".join([*lines, "  .", "MISSING VALUES", *[f"  V{k} ({90 + k} THRU {99 + k})" for k, _, g in n if g == 2], "  ."]) + "\n"


_TYPE = "CASE n_regionkey WHEN 1 THEN 'character' ELSE 'numeric' END"


@_query(f"""SELECT 'V' || n_nationkey AS name, n_name AS label_en, 'fr ' || n_name AS label_fr, {_TYPE} AS type, CASE WHEN n_regionkey = 0 THEN 2 WHEN n_regionkey <> 1 THEN 0 END::INT AS decimals,
  CASE WHEN n_regionkey = 2 THEN 90.0 + n_nationkey END::DOUBLE AS missing_low, CASE WHEN n_regionkey = 2 THEN 99.0 + n_nationkey END::DOUBLE AS missing_high FROM nation""")
def spss_mono(spark, sf_dir):
    """PAR-01/02, JOIN-03/04: both languages joined, types and ranges derived."""
    return _frame(spark, parse_mono(_mono(spark, sf_dir), _mono(spark, sf_dir, True)).variables, VARIABLES)


@_query("SELECT 'V' || n_nationkey AS name, r_regionkey::VARCHAR AS val, r_name AS label_en, 'fr ' || r_name AS label_fr FROM nation, region WHERE n_regionkey = 1")
def spss_mono_codes(spark, sf_dir):
    """PAR-01/05"""
    return _frame(spark, parse_mono(_mono(spark, sf_dir), _mono(spark, sf_dir, True)).codes, CODES)


@_query("SELECT 'V' || n_nationkey AS name, (10 * n_nationkey + 1)::INT AS start, (10 * n_nationkey + n_nationkey % 3 + 1)::INT AS \"end\" FROM nation")
def spss_data_list(spark, sf_dir):
    """PAR-08"""
    return _frame(spark, parse_mono(_mono(spark, sf_dir)).layout, "name string, start int, end int")


@_query("SELECT 'V' || n_nationkey AS name, n_name || ' at birth' AS label FROM nation")
def spss_strings_joined(spark, sf_dir):
    """PAR-03/04: a label continued over lines by + is one string."""
    text = "VARIABLE LABELS\n" + "".join(f"  V{k}\t'{name} at ' +\n     'birth'\n" for k, name, _ in _nations(spark, sf_dir)) + "  .\n"
    return _frame(spark, [(v.name, v.label_en) for v in parse_mono(text).variables], "name string, label string")


@_query("SELECT 'V' || n_nationkey AS name, n_name AS label FROM nation")
def spss_variable_labels(spark, sf_dir):
    """PAR-04"""
    found = variable_labels("".join(f'  /V{k} "{name}"\n' for k, name, _ in _nations(spark, sf_dir)))
    return _frame(spark, list(found.items()), "name string, label string")


@_query("SELECT 'V' || n_nationkey AS name, CASE WHEN r_regionkey = 0 THEN '00' ELSE r_regionkey::VARCHAR END AS val, r_name AS label_en, NULL::VARCHAR AS label_fr FROM nation, region")
def spss_value_labels(spark, sf_dir):
    """PAR-05: one group of codes for many variables; quoted codes stay as they are."""
    n, r = _nations(spark, sf_dir), _regions(spark, sf_dir)
    head = "\n  ".join(f"V{k}" for k, _, _ in n)
    body = f"/{head}\n" + "\n".join(f'  "00" "{name}"' if key == 0 else f'  {key}.0 "{name}"' for key, name in r)
    return _frame(spark, value_labels(body), CODES)


@_query("SELECT 'V' || n_nationkey AS name, CASE WHEN n_regionkey = 0 THEN 'A' ELSE 'F' END AS letter, CASE WHEN n_regionkey = 0 THEN 0 ELSE n_regionkey END::INT AS decimals FROM nation")
def spss_formats(spark, sf_dir):
    """PAR-06"""
    found = formats(" / ".join(f"V{k} (A5)" if g == 0 else f"V{k} (F8.{g})" for k, _, g in _nations(spark, sf_dir)))
    return _frame(spark, [(k, *v) for k, v in found.items()], "name string, letter string, decimals int")


@_query("""SELECT 'V' || n_nationkey AS name, CASE n_regionkey WHEN 0 THEN n_nationkey WHEN 1 THEN 100000.0 ELSE 9 END::DOUBLE AS low,
  CASE n_regionkey WHEN 0 THEN n_nationkey WHEN 1 THEN 200000.0 END::DOUBLE AS high FROM nation""")
def spss_missing_values(spark, sf_dir):
    """PAR-07: one value, a range in scientific notation, an open end."""
    item = {0: lambda k: f"({k})", 1: lambda k: "(1E5 THRU 2e5)"}
    found = missing_items("\n".join(f"  V{k} {item.get(g, lambda k: '(9 THRU )')(k)}" for k, _, g in _nations(spark, sf_dir)))
    return _frame(spark, [(k, *v) for k, v in found.items()], "name string, low double, high double")


def _split(spark, sf_dir) -> Metadata:
    n, r = _nations(spark, sf_dir), _regions(spark, sf_dir)
    layout = "DATA LIST FILE = IN NOTABLE/\n" + "".join(f"  V{k} {10 * k + 1} - {10 * k + 8} {'(A)' if g == 0 else '(2)' if g == 1 else ''}\n" for k, _, g in n)
    labels = lambda fr: "* a comment\nVARIABLE LABELS\n" + "".join(f'  V{k} "{fr}{name}"\n' for k, name, _ in n)
    codes = lambda fr: "VALUE LABELS\n" + "".join(f" /V{k}\n" + "".join(f'  "0{key}" "{fr}{x}"\n' for key, x in r) for k, _, g in n if g == 0)
    missing = "Comment text\nMISSING VALUES\n" + "".join(f" V{k} (9999996 THRU 9999999)\n" for k, _, g in n if g == 1)
    return parse_split(layout, labels(""), codes(""), missing, labels("fr "), codes("fr "))


@_query("""SELECT 'V' || n_nationkey AS name, n_name AS label_en, 'fr ' || n_name AS label_fr, CASE n_regionkey WHEN 0 THEN 'character' ELSE 'numeric' END AS type,
  CASE n_regionkey WHEN 1 THEN 2 WHEN 0 THEN NULL ELSE 0 END::INT AS decimals, CASE WHEN n_regionkey = 1 THEN 9999996.0 END::DOUBLE AS missing_low, CASE WHEN n_regionkey = 1 THEN 9999999.0 END::DOUBLE AS missing_high FROM nation""")
def spss_split(spark, sf_dir):
    """PAR-09/10/11"""
    return _frame(spark, _split(spark, sf_dir).variables, VARIABLES)


@_query("SELECT 'V' || n_nationkey AS name, '0' || r_regionkey AS val, r_name AS label_en, 'fr ' || r_name AS label_fr FROM nation, region WHERE n_regionkey = 0")
def spss_split_codes(spark, sf_dir):
    """PAR-09, JOIN-03"""
    return _frame(spark, _split(spark, sf_dir).codes, CODES)


@_query("SELECT 'V' || n_nationkey AS name, (10 * n_nationkey + 1)::INT AS start, (10 * n_nationkey + 5)::INT AS \"end\", CASE WHEN n_regionkey = 0 THEN 'A' ELSE 'F' END AS letter FROM nation")
def sas_at_layout(spark, sf_dir):
    """PAR-12: a field ends where its width says."""
    fields, kinds = at_layout("".join(f"@{10 * k + 1} V{k} {'$CHAR5.' if g == 0 else '5.2'}\n" for k, _, g in _nations(spark, sf_dir)))
    return _frame(spark, [(f.name, f.start, f.end, kinds[f.name][0]) for f in fields], "name string, start int, end int, letter string")


@_query("SELECT 'V' || n_nationkey AS name, r_regionkey::VARCHAR AS val, r_name AS label_en, 'fr ' || r_name AS label_fr FROM nation, region WHERE n_regionkey IN (0, 1)")
def sas_labels(spark, sf_dir):
    """PAR-13: a comment tells which variables a format applies to; others have no codes."""
    n, r = _nations(spark, sf_dir), _regions(spark, sf_dir)

    def text(fr: str) -> str:
        users = " ".join(f"V{k}" for k, _, g in n if g < 2)
        values = "\n".join(f' {key} = "{fr}{name}"' for key, name in r)
        return f"/* REGF format applies to:\n {users} */\nVALUE REGF\n{values}\n other = [Z5.1];\nVALUE FREE\n 1 = \"none\";\n" + "".join(f'LABEL V{k} = "{fr}{name}" ;\n' for k, name, _ in n)

    return _frame(spark, parse_labels(text(""), text("fr ")).codes, CODES)


@_query("""SELECT 'V' || n_nationkey AS name, n_name AS label_en, 'fr ' || n_name AS label_fr, CASE n_regionkey WHEN 0 THEN 'character' ELSE 'numeric' END AS type, CASE n_regionkey WHEN 0 THEN NULL ELSE 2 END::INT AS decimals,
  CASE WHEN n_regionkey = 1 THEN 9.0 END::DOUBLE AS missing_low, NULL::DOUBLE AS missing_high FROM nation""")
def sas_cards(spark, sf_dir):
    """PAR-14: labels in either syntax; ranges of codes and empty labels are left out."""
    n, r = _nations(spark, sf_dir), _regions(spark, sf_dir)
    lay = "".join(f"@{10 * k + 1} V{k} {'$CHAR5.' if g == 0 else '5.2'}\n" for k, _, g in n)
    lab = lambda fr: "".join(f'V{k} = "{fr}{name}"\n' for k, name, _ in n)
    cde = lambda fr: "VALUE LABELS\n" + "".join(f"V{k}\n" + "".join(f'  {key} "{fr}{x}"\n' for key, x in r) + '  6:9 "range"\n/\n' for k, _, g in n if g == 0) + ".\n"
    mvs = "MISSING VALUES\n" + "".join(f"v{k} (9 THRU )\n" for k, _, g in n if g == 1) + ".\n"
    return _frame(spark, parse_cards(lay, lab(""), cde(""), mvs, lab("fr "), cde("fr ")).variables, VARIABLES)


def _lfs_codebook(spark, sf_dir) -> str:
    n, r = _nations(spark, sf_dir), _regions(spark, sf_dir)
    rows = ["Field_Champ,Variable_Variable,EnglishLabel_EtiquetteAnglais,FrenchLabel_EtiquetteFrancais"]
    for k, name, g in n:
        rows.append(f"V{k},V{k},{name},fr {name}")
        if g == 0:
            rows += [f",{key},{x},fr {x}" for key, x in r] + [",10-19,range,", ",blank,none,"]
    return "\n".join([*rows, "SURVMNTH,SURVMNTH,Month,Mois", ",1,January,Janvier"]) + "\n"


@_query("""SELECT 'V' || n_nationkey AS name, r_regionkey::VARCHAR AS val, r_name AS label_en, 'fr ' || r_name AS label_fr FROM nation, region WHERE n_regionkey = 0
  UNION ALL SELECT 'SURVMNTH', '01', 'January', 'Janvier'""")
def lfs_codebook(spark, sf_dir):
    """PAR-15: names filled down, ranges and blanks left out, months of two digits."""
    return _frame(spark, parse_lfs_codebook(_lfs_codebook(spark, sf_dir)).codes, CODES)


@_query("SELECT 'V' || n_nationkey AS name, r_regionkey::VARCHAR AS val, r_name AS label_en, 'fr ' || r_name AS label_fr FROM nation, region")
def cpss_codebook(spark, sf_dir):
    """PAR-16"""
    rows = ["Variable,Variable Name - English / Anglais,Variable Name - French,Code,Label - English,Label - French"]
    for k, name, _ in _nations(spark, sf_dir):
        rows += [f"V{k},{name},fr {name},,,"] + [f",,,{key},{x},fr {x}" for key, x in _regions(spark, sf_dir)]
    return _frame(spark, parse_cpss("\n".join(rows) + "\n").codes, CODES)


@_query("""SELECT 'V' || n_nationkey AS name, n_name AS label_en, 'fr ' || n_name AS label_fr, 'numeric' AS type, NULL::INT AS decimals, 96.0::DOUBLE AS missing_low, 99.0::DOUBLE AS missing_high FROM nation""")
def pdf_dictionary(spark, sf_dir):
    """PAR-17, JOIN-06: of the reserved codes only labels that mean missing make the range."""
    n, r = _nations(spark, sf_dir), _regions(spark, sf_dir)

    def text(fr: str) -> str:
        out = ""
        for k, name, _ in n:
            out += f" V{k}    Position: {k}   Length: 2  Numeric\n     Long name:   {fr}{name}\n     Codes:       01   {fr}{r[0][1]}\n                  02   {fr}{r[1][1]}\n"
            out += "     Reserved Codes: 96   Valid skip\n                  99   Not stated\n                  07   Yes\n\n"
        return out

    return _frame(spark, parse_dictionary(text(""), text("fr ")).variables, VARIABLES)


@_query("SELECT 'V' || n_nationkey AS name, r_regionkey::VARCHAR AS val, 'More than ' || r_name AS label_en, 'More than fr ' || r_name AS label_fr FROM nation, region")
def pdf_codebook(spark, sf_dir):
    """PAR-18: rows of counts, labels wrapped before them, up to the total."""
    n, r = _nations(spark, sf_dir), _regions(spark, sf_dir)

    def text(fr: str) -> str:
        out = ""
        for k, name, _ in n:
            out += f" Variable Name:  V{k}\n Concept:  {name}\n Question Text: How many?\n Answer Categories    Code   Frequency   %\n"
            out += "".join(f"   More than\n   {fr}{x}          {key}      {1000 + k},320     10.5\n" for key, x in r) + "   Total                      6,947    100.0\n"
        return out

    return _frame(spark, parse_codebook(text(""), text("fr ")).codes, CODES)


@_query("""SELECT 'V' || n_nationkey AS name, CASE WHEN n_regionkey = 0 THEN 'second ' ELSE '' END || n_name AS label_en, 'fr ' || n_name AS label_fr, 'character' AS type FROM nation""")
def meta_merge_priority(spark, sf_dir):
    """PAR-20: column by column the first value by the order of trust."""
    n = _nations(spark, sf_dir)
    first = Metadata(tuple(Variable(f"V{k}", None if g == 0 else name) for k, name, g in n))
    second = Metadata(tuple(Variable(f"V{k}", f"second {name}", f"fr {name}") for k, name, _ in n))
    return _frame(spark, [(v.name, v.label_en, v.label_fr, v.type) for v in merged({"pdf_dict": second, "spss_mono": first}).variables], "name string, label_en string, label_fr string, type string")


@_query("SELECT 'variables' AS what, round(count(*) FILTER (n_regionkey = 0) / count(*), 2) AS share FROM nation")
def bilingual_share(spark, sf_dir):
    """LAB-03: warns of the share without a French label, if some but not all lack it."""
    m = Metadata(tuple(Variable(f"V{k}", name, None if g == 0 else name) for k, name, g in _nations(spark, sf_dir)))
    rows = [(x.split(":")[0], round(int(x.split(": ")[1].split("%")[0]) / 100, 2)) for x in bilingual_coverage(m, 0.1)]
    return _frame(spark, rows, "what string, share double")


# -- scans -----------------------------------------------------------------------------


@_query("SELECT c_custkey::VARCHAR AS C_CUSTKEY, c_name AS C_NAME, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS C_SEG FROM customer")
def csv_scan(spark, sf_dir):
    """SRC-02: a delimited file, all cells strings, names in upper case, NA as null."""
    c = _t(spark, sf_dir, "customer")
    at = shared_folder(spark, "csv") + "/customer"
    cells = c.select(c.c_custkey.cast("string").alias("c_custkey"), c.c_name, F.when(c.c_custkey % 5 != 0, F.concat(F.lit(" "), c.c_mktsegment, F.lit(" "))).otherwise("NA").alias("c_seg"))
    cells.write.option("header", True).csv(at)
    return raw.read_delimited(spark, at)


@_query("SELECT s_suppkey, replace(replace(s_name, 'S', 'é'), 'u', 'ç') AS s_name FROM supplier")
def charset_cp850(spark, sf_dir):
    """SRC-03: CP850 bytes, read as ISO-8859-1, to their characters."""
    s = _t(spark, sf_dir, "supplier")
    return raw.decoded(s.select("s_suppkey", F.translate("s_name", "Su", "\x82\x87").alias("s_name")), "CP850")


@_query("SELECT p_partkey::DOUBLE AS P_PARTKEY, p_name AS P_NAME, p_size::DOUBLE AS P_SIZE FROM part")
def raw_scan_guessed(spark, sf_dir):
    """SRC-10: columns of numbers alone become double."""
    at = shared_folder(spark, "raw") + "/part"
    _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").write.option("header", True).csv(at)
    return raw.read_raw(spark, at, guess_numeric=True)


@_query("SELECT o_orderkey::VARCHAR AS ID, o_totalprice AS BSW1 FROM (SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders)")
def weights_scan(spark, sf_dir):
    """SRC-07: a replicate-weight file; all but the key become double."""
    o = _t(spark, sf_dir, "orders")
    return raw.numeric_except(o.select(o.o_orderkey.cast("string").alias("ID"), F.round("o_totalprice", 2).cast("string").alias("BSW1")), ["ID"])


@_query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS extra FROM orders")
def union_by_name(spark, sf_dir):
    """SRC-08/SET-01: files of two shapes, missing columns null."""
    o = _t(spark, sf_dir, "orders")
    even = o.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("extra"))
    return raw.union_files([even, o.filter("o_orderkey % 2 <> 0").select("o_custkey", "o_orderkey")]).select("o_orderkey", "o_custkey", "extra")


@_query("""SELECT DISTINCT strftime(o_orderdate, 'pub%m%y.csv') AS name, 'monthly' AS kind FROM orders
  UNION SELECT DISTINCT strftime(o_orderdate, 'pub%Y.csv'), 'annual' FROM orders""")
def lfs_file_kinds(spark, sf_dir):
    """SRC-09: by the first two digits of a name; a year's begin with 19 or 20."""
    names = _t(spark, sf_dir, "orders").select(F.explode(F.array(F.date_format("o_orderdate", "'pub'MMyy'.csv'"), F.date_format("o_orderdate", "'pub'yyyy'.csv'"))).alias("name")).distinct()
    return _frame(spark, [(r.name, files.lfs_kind(r.name)) for r in names.collect()], "name string, kind string")  # at most 13 a year


@_query("SELECT c_custkey, 'Customer ' || c_mktsegment AS C_SEG FROM customer")
def survey_end_to_end(spark, sf_dir):
    """SRC-06, PAR-19/21, MOD-02, SNK-01, API-01: detected command files, a coded table and its labels."""
    import os

    from .surveys import Surveys

    root = shared_folder(spark, "surveys").removeprefix("file:")
    c = _t(spark, sf_dir, "customer")
    segments = sorted(r[0] for r in c.select("c_mktsegment").distinct().collect())
    at = f"{root}/S/2020"
    put = lambda name, text: put_text(spark, f"{at}/{name}", text.encode())
    put("x_i.sps", "DATA LIST FILE = IN NOTABLE/\n  C_CUSTKEY 1 - 10 (A)\n  C_SEG 11 - 30 (A)\n")
    put("x_vare.sps", 'VARIABLE LABELS\n  C_CUSTKEY "Key"\n  C_SEG "Segment"\n')
    put("x_vale.sps", "VALUE LABELS\n /C_SEG\n" + "".join(f'  "{s}" "Customer {s}"\n' for s in segments))
    c.select(F.rpad(F.concat(F.lpad(c.c_custkey.cast("string"), 10, " "), c.c_mktsegment), 30, " ")).coalesce(1).write.text(f"{at}/lines")
    lines = next(f"{at}/lines/{f}" for f in os.listdir(f"{at}/lines") if f.startswith("part-"))
    os.rename(lines, f"{at}/data.txt")
    df = Surveys(spark, root, Registry([Entry("S", "2020")])).open("S", "2020").df
    return df.select(F.col("C_CUSTKEY").cast("long").alias("c_custkey"), "C_SEG")


@_query("""SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'spss_mono' WHEN 1 THEN 'spss_split' WHEN 2 THEN 'sas_cards' WHEN 3 THEN 'sas_labels'
    WHEN 4 THEN 'pdf_dict' ELSE 'pdf_codebook' END AS formats, n_nationkey % 6 IN (0, 3, 4, 5) AND n_regionkey > 1 AS french FROM nation""")
def detected_metadata(spark, sf_dir):
    """PAR-19: the format of what lies in a folder, and whether a French text is beside it:
    told by the name (regions 2 and 3) or by its accents (region 4)."""
    root = shared_folder(spark, "formats").removeprefix("file:")
    mono = 'VARIABLE LABELS\n  A "%s"\n  .\n'
    kinds = [[("x{}.sps", mono)], [("x_i.sps", "A 1 - 3"), ("x_vare.sps", mono)], [("x.lay", "@1 A $CHAR3."), ("x.lbe", 'A = "a"')],
             [("x{}.sas", 'LABEL A = "%s";\n')], [("xDictionary{}.txt", "Position: 1\n%s\n")], [("xcodebook{}.txt", "Variable name: A\n%s\n")]]
    rows = []
    for k, name, g in _nations(spark, sf_dir):
        for ends, text in kinds[k % 6]:
            copies = [("", "", name)] + ([("_fr", "", "x")] if g in (2, 3) else [("2", "", "\xe9t\xe9")] if g == 4 else [])
            for mark, _, label in copies if "{}" in ends else copies[:1]:
                put_text(spark, f"{root}/{k}/{ends.format(mark)}", (text % label if "%s" in text else text).encode())
        found = detect.detect(f"{root}/{k}")
        rows.append((k, ",".join(found), any("french" in x for x in found.values())))
    return _frame(spark, rows, "n_nationkey int, formats string, french boolean")


@_query("SELECT 'V' || n_nationkey AS name, n_regionkey::VARCHAR AS val, n_name AS used, 'other ' || n_name AS also FROM nation WHERE n_regionkey = 1")
def label_conflicts(spark, sf_dir):
    """PAR-20: labels of a code that differ between sources that count; those read from
    SAS statements or PDFs don't."""
    n = _nations(spark, sf_dir)
    of = lambda keep, mark: Metadata((), tuple(Code(f"V{k}", str(g), f"{mark}{name}") for k, name, g in n if keep(g)))
    found = {"cpss_csv": of(lambda g: g == 1, "other "), "spss_mono": of(lambda g: True, ""), "pdf_dict": of(lambda g: g == 2, "cut "), "sas_cards": of(lambda g: g == 3, "")}
    return _frame(spark, [(name, val, *labels) for name, val, labels in conflicts(found)], "name string, val string, used string, also string")


# -- fixups and conversion -----------------------------------------------------------


def _sized(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select(p.p_partkey.cast("string").alias("ID"), F.lpad(p.p_size.cast("string"), 2, "0").alias("SIZE"))


SIZES = Metadata((Variable("ID", "Id"), Variable("SIZE", "Size")), (Code("SIZE", "48", "Refused"), Code("SIZE", "50", "Not stated")))


@_query("SELECT p_partkey::VARCHAR AS ID, CASE WHEN p_size NOT BETWEEN 48 AND 50 THEN p_size END::DOUBLE AS SIZE FROM part")
def force_numeric(spark, sf_dir):
    """FIX-03: codes become a missing range, the rest numbers."""
    return build.typed(_sized(spark, sf_dir), SIZES, Fixups(force_numeric=("SIZE",)))


@_query("SELECT p_partkey::BIGINT AS ID, lpad(p_size::VARCHAR, 2, '0') AS SIZE FROM part")
def force_bigint_character(spark, sf_dir):
    """FIX-04: raw values as whole numbers, or as they are, codes unused."""
    return build.typed(_sized(spark, sf_dir), SIZES, Fixups(force_bigint=("ID",), force_character=("SIZE",)))


@_query("SELECT p_partkey::VARCHAR AS ID, CASE p_size WHEN 48 THEN 'Refused' WHEN 50 THEN 'Not stated' WHEN 7 THEN 'Seven' END AS SIZE FROM part")
def codes_supplement(spark, sf_dir):
    """FIX-06: added codes; one without a label is null."""
    return build.typed(_sized(spark, sf_dir), SIZES, Fixups(codes_supplement=(Code("SIZE", "7", "Seven"), Code("SIZE", "8"))))


@_query("SELECT p_partkey::VARCHAR AS ID, CASE WHEN p_size NOT BETWEEN 10 AND 20 THEN p_size END::DOUBLE AS SIZE FROM part")
def missing_supplement(spark, sf_dir):
    """FIX-07: a range that replaces the metadata's."""
    m = replace(SIZES, variables=(SIZES.variables[0], Variable("SIZE", "Size", type="numeric", missing_low=1, missing_high=5)), codes=())
    return build.typed(_sized(spark, sf_dir), m, Fixups(missing_supplement={"SIZE": (10, 20)}))


@_query("SELECT 'V' || n_nationkey AS name, CASE WHEN n_regionkey = 0 THEN 'added' ELSE n_name END AS label_en, 'ajouté' AS label_fr FROM nation")
def labels_supplement(spark, sf_dir):
    """FIX-08: fills labels that lack, and no others."""
    n = _nations(spark, sf_dir)
    m = Metadata(tuple(Variable(f"V{k}", None if g == 0 else name) for k, name, g in n))
    out = build.prepared(m, Fixups(labels_supplement={f"v{k}": ("added", "ajouté") for k, _, _ in n}))
    return _frame(spark, [(v.name, v.label_en, v.label_fr) for v in out.variables], "name string, label_en string, label_fr string")


@_query("SELECT p_partkey::VARCHAR AS ID, CASE p_size WHEN 1 THEN 'One' WHEN 2 THEN 'Two' END AS SIZE FROM part")
def promoted_to_category(spark, sf_dir):
    """FIX-09: a numeric variable with codes beyond missing ones is a category."""
    m = Metadata((Variable("ID"), Variable("SIZE", "Size", type="numeric")), (Code("SIZE", "1", "One"), Code("SIZE", "2", "Two"), Code("SIZE", "50", None)))
    return build.typed(_sized(spark, sf_dir), m)


@_query("SELECT o_orderkey::VARCHAR AS ID, CASE WHEN o_custkey % 10 <> 9 AND o_custkey < 1400 THEN 'Customer ' || o_custkey END AS CUST FROM orders")
def labels_joined(spark, sf_dir):
    """LAB-01, JOIN-11: a list of 1,400 codes is joined as a table; padded keys are met."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("ID"), F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("CUST"))
    m = Metadata((Variable("ID"), Variable("CUST", "Customer")), tuple(Code("CUST", str(k), f"Customer {k}" if k % 10 != 9 else None) for k in range(1400)))
    return build.labelled(o, m)


@_query("""SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY value)::INT AS rank, count(*) OVER (PARTITION BY name) AS n FROM (
  SELECT DISTINCT 'CUST' AS name, o_custkey::VARCHAR AS value FROM orders WHERE o_custkey >= 20 UNION SELECT DISTINCT 'STATUS', o_orderstatus FROM orders WHERE o_orderstatus <> 'F') QUALIFY rank <= 5""")
def unmatched_counted(spark, sf_dir):
    """LAB-01: of each column the first codes that the metadata lacks, and how many there are."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("CUST"), F.col("o_orderstatus").alias("STATUS"), "o_orderkey")
    codes = (*(Code("CUST", str(k), None if k == 3 else f"c{k}") for k in range(20)), Code("STATUS", "F", "filled"))
    return build.unmatched(o, Metadata((Variable("CUST"), Variable("STATUS")), codes))


@_query("SELECT name, value FROM (SELECT DISTINCT 'SIZE' AS name, lpad(p_size::VARCHAR, 2, '0') AS value, p_size FROM part WHERE p_size NOT IN (48, 50)) ORDER BY value LIMIT 5")
def unmatched_codes(spark, sf_dir):
    """LAB-01: the first values that no code has, for the warning."""
    found = build.unmatched_values(_sized(spark, sf_dir), SIZES)
    return _frame(spark, [(k, v) for k, values in found.items() for v in values], "name string, value string")


@_query("SELECT o_orderkey, o_orderpriority, position(left(o_orderpriority, 1) IN '12345')::INT AS place FROM orders")
def level_places(spark, sf_dir):
    """SNK-02/SRT-06: a label's place among the levels that its column carries."""
    o = _t(spark, sf_dir, "orders")
    codes = [Code("P", r[0], r[0]) for r in o.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]
    df = build.typed(o.select(F.col("o_orderkey").cast("string").alias("ID"), F.col("o_orderpriority").alias("P")), Metadata((Variable("P"),), tuple(codes)))
    place = convert.level_order(F.col("P"), build.levels_of(df, "P"))
    return df.select(F.col("ID").cast("long").alias("o_orderkey"), F.col("P").alias("o_orderpriority"), place.cast("int").alias("place"))


@_query("SELECT DISTINCT p_size::VARCHAR AS value FROM part")
def harvested_levels(spark, sf_dir):
    """AGG-05"""
    return columns.distinct_values(_t(spark, sf_dir, "part"), "p_size")


@_query("SELECT l_orderkey, l_linenumber, (row_number() OVER (ORDER BY l_orderkey, l_linenumber))::BIGINT AS row_id FROM lineitem")
def row_ids(spark, sf_dir):
    """WIN-05/DML-08"""
    return columns.with_row_id(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@_query("SELECT l_returnflag, total, round(total / sum(total) OVER (), 10) AS share FROM (SELECT l_returnflag, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1)")
def share_of_all(spark, sf_dir):
    """WIN-02: shares of the whole, over one row a group."""
    t = estimate.weighted_total(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity").withColumn("total", F.round("total", 2))
    return estimate.share(t, "total").withColumn("share", F.round("share", 10))


@_query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice < 100000 AND NOT regexp_matches(o_orderpriority, 'LOW')")
def filters(spark, sf_dir):
    """PRJ-11"""
    o = _t(spark, sf_dir, "orders")
    return o.filter(o.o_orderstatus.isin("F", "O") & (o.o_totalprice < 100000) & ~o.o_orderpriority.rlike("LOW")).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@_query("SELECT n_name AS before, n_nationkey, n_regionkey FROM nation")
def adjacent_columns(spark, sf_dir):
    """PRJ-06"""
    n = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("before"), "n_regionkey", "n_nationkey")
    return columns.adjacent(n, "before", "n_nationkey")


@_query("SELECT 'V' || n_nationkey AS name, 'V' || n_nationkey AS coded FROM nation UNION ALL SELECT n_name, 'V' || n_nationkey FROM nation")
def coded_names(spark, sf_dir):
    """PRJ-03: a column by its name or its label."""
    n = _nations(spark, sf_dir)
    m, names = Metadata(tuple(Variable(f"V{k}", name) for k, name, _ in n)), [f"V{k}" for k, _, _ in n]
    return _frame(spark, [(x, columns.coded_name(names, m, x)) for k, name, _ in n for x in (f"V{k}", name)], "name string, coded string")


@_query("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS place, 'BSW' || n_nationkey AS name FROM nation")
def replicate_names_in_order(spark, sf_dir):
    """SRT-02: 10 follows 9."""
    names = estimate.replicate_order(sorted(f"BSW{k}" for k, _, _ in _nations(spark, sf_dir)))
    return _frame(spark, list(enumerate(names)), "place int, name string")


# Names and whether they are weights.
WEIGHT_NAMES = (
    ("WEIGHT", True), ("PWEIGHT", True), ("FINWGH", True), ("WGHT_PER", True), ("WGT_PUMF", True), ("FAMWGT", True), ("WTPP", True), ("COVID_WT", True),
    ("WT1", False), ("WTBS_001", False), ("WTI_110", False), ("BSW12", False), ("AGEGRP", False), ("GROWTH", False),
)


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {str(w).lower()})" for n, w in WEIGHT_NAMES) + ") t(name, weight)")
def weight_names(spark, sf_dir):
    """AGG-11/PRJ-13"""
    found = set(estimate.weight_columns([n for n, _ in WEIGHT_NAMES]))
    return _frame(spark, [(n, n in found) for n, _ in WEIGHT_NAMES], "name string, weight boolean")


# -- bootstrap -----------------------------------------------------------------------------


@_query("SELECT o_orderstatus AS stratum, b::INT AS b, (count(*) * 100.0)::DOUBLE AS total FROM orders, generate_series(1, 40) g(b) GROUP BY ALL")
def bootstrap_constant_weight(spark, sf_dir):
    """BSW-03: with a constant weight each replicate keeps each stratum's total."""
    o = _t(spark, sf_dir, "orders").withColumn("w", F.lit(100.0))
    w = bootstrap.replicate_weights(o, "w", "o_orderkey", ["o_orderstatus"], 40)
    return estimate.replicate_totals(w, ["stratum"]).select("stratum", F.col("replicate").cast("int").alias("b"), "total")


@_query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 END::DOUBLE AS of_null_weights FROM orders")
def bootstrap_null_weight(spark, sf_dir):
    """BSW-02: replicates of a null weight are zero."""
    o = _t(spark, sf_dir, "orders").withColumn("w", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")))
    r = bootstrap.replicate_weights(o, "w", "o_orderkey", (), 3)
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    return r.select("id", F.when(F.col("id") % 3 == 0, total).alias("of_null_weights"))


@_query("SELECT o_orderkey AS id, true AS kept FROM orders")
def bootstrap_fewer(spark, sf_dir):
    """BSW-06: fewer replicates than stored are the first of them."""
    o = _t(spark, sf_dir, "orders")
    have = kept(bootstrap.replicate_weights(o, "o_totalprice", "o_orderkey", ["o_orderstatus"], 6), "replicates")
    now = bootstrap.extended(have, o, "o_totalprice", "o_orderkey", ["o_orderstatus"], 4, seed=9)
    both = now.join(have.withColumnRenamed("weights", "old").hint("merge"), "id")
    return both.select("id", (F.col("weights") == F.slice("old", 1, 4)).alias("kept"))


@_query("SELECT o_orderkey AS id, o_orderstatus <> 'P' AS kept FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey IS NOT NULL")
def bootstrap_affected_strata(spark, sf_dir):
    """BSW-09: new rows of a stratum renew it alone; the others keep their replicates. Each
    row tells whether all weights of its stratum are the old ones."""
    o = _t(spark, sf_dir, "orders")
    least = o.filter("o_orderstatus = 'P'").agg(F.min("o_orderkey")).first()[0]
    have = kept(bootstrap.replicate_weights(o.filter(F.col("o_orderkey") != F.lit(least)), "o_totalprice", "o_orderkey", ["o_orderstatus"], 4, seed=3), "replicates")
    now = kept(bootstrap.extended(have, o, "o_totalprice", "o_orderkey", ["o_orderstatus"], 4, seed=4), "replicates")
    both = now.join(have.select("id", F.col("weights").alias("old")).hint("merge"), "id", "left")
    same = both.groupBy("stratum").agg(F.min(F.col("weights").eqNullSafe(F.col("old"))).alias("kept"))
    return now.join(same, "stratum").select("id", "kept")


@_query("SELECT o_orderstatus AS stratum, count(*)::BIGINT AS n, o_orderstatus <> 'P' AS untouched FROM orders GROUP BY o_orderstatus")
def bootstrap_stored_strata(spark, sf_dir):
    """SNK-07, BSW-09: a stratum's new rows renew its files; the files of others stay."""
    o, path = _t(spark, sf_dir, "orders"), f"{shared_folder(spark, 'replicates')}/w"
    least = o.filter("o_orderstatus = 'P'").agg(F.min("o_orderkey")).first()[0]
    files = lambda df: df.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.col("_metadata.file_name"))).alias("files"))
    before = files(bootstrap.update_stored(path, o.filter(F.col("o_orderkey") != F.lit(least)), "o_totalprice", "o_orderkey", ["o_orderstatus"], 4)).collect()
    had = spark.createDataFrame([(r["stratum"], r["files"]) for r in before], "stratum string, had array<string>")
    now = files(bootstrap.update_stored(path, o, "o_totalprice", "o_orderkey", ["o_orderstatus"], 3))
    return now.join(had, "stratum").select("stratum", "n", (F.col("files") == F.col("had")).alias("untouched"))


@_query("SELECT o_orderkey AS id, true AS same FROM orders")
def bootstrap_extends_columns(spark, sf_dir):
    """BSW-07: more replicates keep the first ones, and are those that one run makes."""
    o = _t(spark, sf_dir, "orders")
    have = kept(bootstrap.replicate_weights(o, "o_totalprice", "o_orderkey", ["o_orderstatus"], 3), "replicates")
    now = bootstrap.extended(have, o, "o_totalprice", "o_orderkey", ["o_orderstatus"], 40)
    whole = bootstrap.replicate_weights(o, "o_totalprice", "o_orderkey", ["o_orderstatus"], 40)
    return now.join(whole.select("id", F.col("weights").alias("w")).hint("merge"), "id").select("id", (F.col("weights") == F.col("w")).alias("same"))


# -- store and versions ------------------------------------------------------------------


def _orders_of(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("SURVMNTH"))


_OY = "SELECT o_orderkey, year(o_orderdate)::INT AS SURVYEAR, month(o_orderdate)::INT AS SURVMNTH FROM orders"


@_query(f"SELECT * FROM ({_OY}) WHERE SURVYEAR = (SELECT min(SURVYEAR) FROM ({_OY})) AND SURVMNTH = 3")
def lfs_covered_month(spark, sf_dir):
    """LFS-03/05, PRJ-08: a month that its year covers is read from there."""
    o = _orders_of(spark, sf_dir)
    year = o.agg(F.min("y")).first()[0]
    s = store.Store(spark, shared_folder(spark, "store"))
    s.load(f"{year}-03", o.filter((F.col("y") == year + 1) & (F.col("SURVMNTH") == 3)).drop("y"))  # of another year, so that it would show
    for (y,) in sorted(o.select("y").distinct().collect()):
        s.load(f"{y}", o.filter(F.col("y") == y).drop("y"))
    assert not s.load(f"{year}-03", o.drop("y"), refresh=True)
    return s.read(f"{year}-03").select("o_orderkey", "SURVYEAR", "SURVMNTH")


@_query(f"SELECT * FROM ({_OY}) WHERE SURVYEAR = (SELECT min(SURVYEAR) FROM ({_OY})) AND SURVMNTH IN (1, 2)")
def lfs_refresh_month(spark, sf_dir):
    """LFS-06, DML-02: loading one month again leaves the others."""
    o = _orders_of(spark, sf_dir)
    year = o.agg(F.min("y")).first()[0]
    s = store.Store(spark, shared_folder(spark, "store"))
    one = lambda m: o.filter((F.col("y") == year) & (F.col("SURVMNTH") == m)).drop("y")
    s.load(f"{year}-01", one(1))
    s.load(f"{year}-02", one(3))
    s.load(f"{year}-02", one(2), refresh=True)
    return s.read(f"{year}").select("o_orderkey", "SURVYEAR", "SURVMNTH")


@_query(f"SELECT * FROM ({_OY})")
def lfs_two_writers(spark, sf_dir):
    """DML-10, SNK-06: two writers in turn, each from the state that it saw before the other
    committed, and the whole table read back."""
    o = _orders_of(spark, sf_dir)
    one, other = (store.Store(spark, path) for path in [shared_folder(spark, "store")] * 2)
    years = sorted(r[0] for r in o.select("y").distinct().collect())
    late, writers = one.log(), [one, other]
    for k, y in enumerate(years):
        writers[k % 2].load(f"{y}", o.filter(F.col("y") == y).drop("y"))
    try:
        one._commit(1, late)
    except store.Conflict:
        pass  # what was seen at the start can't be committed any more
    return other.read().select("o_orderkey", "SURVYEAR", "SURVMNTH")


@_query(f"SELECT SURVYEAR::VARCHAR AS version, count(*)::BIGINT AS n FROM ({_OY}) WHERE SURVYEAR <> (SELECT min(SURVYEAR) FROM ({_OY})) GROUP BY 1")
def lfs_versions_log(spark, sf_dir):
    """LFS-08, DML-01/03, SRT-01: loaded versions with their rows; a removed year is gone."""
    o = _orders_of(spark, sf_dir)
    years = sorted(r[0] for r in o.select("y").distinct().collect())
    s = store.Store(spark, shared_folder(spark, "store"))
    for y in years:
        s.load(f"{y}", o.filter(F.col("y") == y).drop("y"))
    s.remove(f"{years[0]}")
    assert s.versions() == [str(y) for y in years[1:]]
    return _frame(spark, [(p["version"], p["rows"]) for p in s.log()], "version string, n long")


@_query("""WITH v AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS version FROM orders)
  SELECT version FROM v WHERE left(version, 4) <> (SELECT min(left(version, 4)) FROM v)""")
def lfs_missing_versions(spark, sf_dir):
    """LFS-07/SET-03: available months that neither are loaded nor belong to a loaded year."""
    o = _orders_of(spark, sf_dir)
    available = sorted(r[0] for r in _t(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM")).distinct().collect())
    s = store.Store(spark, shared_folder(spark, "store"))
    s.load(available[0][:4], o.filter(F.col("y") == int(available[0][:4])).drop("y"))
    return _frame(spark, [(v,) for v in s.missing(available)], "version string")


@_query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS version, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m FROM orders UNION SELECT DISTINCT year(o_orderdate)::VARCHAR, year(o_orderdate)::INT, NULL FROM orders")
def lfs_version_parts(spark, sf_dir):
    """LFS-01"""
    v = _t(spark, sf_dir, "orders").select(F.explode(F.array(F.date_format("o_orderdate", "yyyy-MM"), F.date_format("o_orderdate", "yyyy")))).distinct().collect()
    return _frame(spark, [(r[0], *store.version_parts(r[0])) for r in v], "version string, y int, m int")


# -- registry and catalogue ----------------------------------------------------------------


@_query("""WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), w AS (SELECT unnest(range(1985, 2005)) AS wanted)
  SELECT wanted::VARCHAR AS wanted, coalesce((SELECT max(y) FROM y WHERE y <= wanted), (SELECT min(y) FROM y))::VARCHAR AS found FROM w""")
def registry_sibling(spark, sf_dir):
    """REG-03/04, SRT-05: the newest year up to the one wanted, else the oldest."""
    years = [r[0] for r in _t(spark, sf_dir, "orders").select(F.year("o_orderdate")).distinct().collect()]
    registry = Registry([Entry("S", str(y), file_mask=str(y)) for y in years])
    return _frame(spark, [(str(w), registry.lookup("S", str(w)).file_mask) for w in range(1985, 2005)], "wanted string, found string")


@_query("SELECT r_name AS module, r_regionkey = 0 AS primary, 'mask ' || r_regionkey AS file_mask FROM region")
def registry_modules(spark, sf_dir):
    """MOD-01: modules in order, the first primary, each with its own settings."""
    patches = {name: {"file_mask": f"mask {key}"} for key, name in _regions(spark, sf_dir)}
    return _frame(spark, [(t.name, t.primary, t.entry.file_mask) for t in Registry([Entry("S", "1", modules=patches)]).modules("S", "1")], "module string, primary boolean, file_mask string")


@_query("SELECT 'S' AS series, n_nationkey::VARCHAR AS version, CASE WHEN n_regionkey = 0 THEN 'file_mask,module_key' ELSE 'file_mask' END AS sets FROM nation")
def registry_table(spark, sf_dir):
    """REG-01/07: what each entry sets."""
    registry = Registry([Entry("S", str(k), file_mask=name, module_key="ID" if g == 0 else None) for k, name, g in _nations(spark, sf_dir)])
    return _frame(spark, [(e["series"], e["version"], ",".join(e["sets"])) for e in registry.table()], "series string, version string, sets string")


@_query("SELECT n_nationkey::VARCHAR AS version, 'own' AS file_mask, 'kept ' || n_nationkey AS layout_mask FROM nation")
def registry_override(spark, sf_dir):
    """REG-06/08: an override holds for all look-ups, in the fields that it gives."""
    registry = Registry([Entry("S", str(k), file_mask=name, layout_mask=f"kept {k}") for k, name, _ in _nations(spark, sf_dir)]).overridden(file_mask="own")
    found = [(str(k), registry.lookup("S", str(k))) for k, _, _ in _nations(spark, sf_dir)]
    return _frame(spark, [(v, e.file_mask, e.layout_mask) for v, e in found], "version string, file_mask string, layout_mask string")


@_query("SELECT alias, 'Cycle ' || (n_nationkey + 40) || ' (' || (n_nationkey + 2040) || ')' AS version FROM (SELECT n_nationkey, unnest(['cycle' || (n_nationkey + 40), (n_nationkey + 40)::VARCHAR, (n_nationkey + 2040)::VARCHAR, 'Cycle ' || (n_nationkey + 40) || ' ' || (n_nationkey + 2040)]) AS alias FROM nation)")
def version_aliases(spark, sf_dir):
    """REG-05: a cycle by its number, its year or both."""
    keys = [k for k, _, _ in _nations(spark, sf_dir)]
    known = [f"Cycle {k + 40} ({k + 2040})" for k in keys]
    aliases = [a for k in keys for a in (f"cycle{k + 40}", f"{k + 40}", f"{k + 2040}", f"Cycle {k + 40} {k + 2040}")]
    return _frame(spark, [(a, resolve_version("GSS", a, known)) for a in aliases], "alias string, version string")


def _files(spark, sf_dir):
    """One file a part and format, with made-up names."""
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    kinds = p.withColumn("format", F.explode(F.array(F.lit("SAS"), F.lit("CSV"), F.lit("TXT"))))
    return kinds.filter("NOT (format = 'CSV' AND p_size % 2 = 0)")


@_query("""SELECT p_brand AS "Acronym", p_partkey::VARCHAR AS "Version", 'https://x/' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '_SAS' ELSE '_CSV' END || '.zip' AS url FROM part""")
def catalogue_best_format(spark, sf_dir):
    """CAT-04, WIN-06: of a version's files the one of the preferred format."""
    f = _files(spark, sf_dir)
    c = f.select(F.col("p_brand").alias("Acronym"), F.lit("A Title, 2020").alias("Title"), F.col("p_partkey").cast("string").alias("edition"), F.concat(F.lit("https://x/"), "p_partkey", F.lit("_"), "format", F.lit(".zip")).alias("url"), "format")
    return catalogue.collection(c).select("Acronym", "Version", "url")


@_query("""SELECT p_partkey, (CASE WHEN p_size % 50 <= 30 THEN 2000 ELSE 1900 END + p_size % 50) || CASE p_partkey % 4 WHEN 0 THEN ' (individuals)' WHEN 1 THEN ' (families)' WHEN 2 THEN ' (households)' ELSE ' (hierarchical)' END AS edition
  FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 5 = 0""")
def census_editions(spark, sf_dir):
    """STR-09: a census file's year and kind; other names give none."""
    p = _t(spark, sf_dir, "part")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("ind", "fam", "hous", "hier")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    study = F.when(F.col("p_partkey") % 5 == 0, "xcen").when(F.col("p_partkey") % 2 == 0, "cen").otherwise("NHS")
    name = F.concat(study, F.lpad((F.col("p_size") % 50).cast("string"), 2, "0"), F.lit("_"), kind, F.lit("_e.zip?v=1"))
    from ..functions import text

    return p.select("p_partkey", text.census_edition(F.concat(F.lit("https://x/n/"), name)).alias("edition"))


@_query("SELECT p_brand AS catalogue_id, count(DISTINCT CASE WHEN p_size > 5 THEN p_size END)::BIGINT AS editions FROM part GROUP BY 1")
def catalogue_editions(spark, sf_dir):
    """AGG-08"""
    p = _t(spark, sf_dir, "part")
    return catalogue.editions(p.select(F.col("p_brand").alias("catalogue_id"), F.when(F.col("p_size") > 5, F.col("p_size").cast("string")).alias("edition")))


@_query("SELECT n_nationkey AS id, n_regionkey AS cat, CASE WHEN r_regionkey < 3 THEN r_name END AS title FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def scraped_categories(spark, sf_dir):
    """JOIN-07"""
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    rows = n.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("cat"))
    return catalogue.with_categories(rows, r.filter("r_regionkey < 3").select(F.col("r_regionkey").alias("cat"), F.col("r_name").alias("title"))).select("id", "cat", "title")


@_query("""SELECT DISTINCT make_date(year(o_orderdate), month(o_orderdate), 1) AS "Date", strftime(o_orderdate, '%Y-%m') AS version, 'https://x/' || strftime(o_orderdate, '%Y-%m') || '.zip' AS url FROM orders""")
def monthly_downloads(spark, sf_dir):
    """CAT-02, DAT-01, SRC-17: dated archives that saved pages link to."""
    o = _t(spark, sf_dir, "orders")
    link = F.concat(F.lit('<p><a class="x" href="https://x/'), F.date_format("o_orderdate", "yyyy-MM"), F.lit('.zip">zip</a><a href="/guide.pdf">y</a><a href="https://x/notes.zip">z</a></p>'))
    return catalogue.monthly_versions(o.select(link.alias("html")))


@_query("SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-01-01') > 180 AS stale FROM orders")
def stale_snapshots(spark, sf_dir):
    """DAT-02/SNK-09"""
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", catalogue.stale(F.to_date("o_orderdate"), F.lit("1998-01-01").cast("date")).alias("stale"))


@_query("SELECT page_id, lower(regexp_replace(url, '[^A-Za-z0-9]', '', 'g')) AS id, starts_with(url, 'https') AS secure, len(string_split(url, '/'))::INT AS parts FROM pages")
def string_parts(spark, sf_dir):
    """STR-01, STR-05, STR-06"""
    from ..functions import text

    p = _t(spark, sf_dir, "pages")
    return p.select("page_id", text.normal_id(p.url).alias("id"), F.startswith(p.url, F.lit("https")).alias("secure"), F.size(F.split(p.url, "/")).alias("parts"))
