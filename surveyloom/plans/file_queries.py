"""Queries of the parsers that read many surveys' files at once.

A survey is a customer, its variables are the customer's orders, named V and their
key: open ones are categories, filled ones have two decimals, and those in part
have only codes for missing answers. The command files and codebooks are made of
the whole table by Spark, and the SQL tells what is to be found in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.parsers import frames
from .queries import _query, _t


#: Variables whose files one task makes.
PART_ROWS = 25_000


def _orders(spark, sf_dir: str) -> DataFrame:
    """Dealt by survey once, in as many partitions as there are variables for: the files
    made of them are not shuffled, nor put together by their compressed size."""
    place = F.row_number().over(Window.partitionBy("survey").orderBy("o_orderkey"))
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("survey"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    o = o.repartition(1 + o.count() // PART_ROWS, "survey")
    return o.select("survey", F.concat(F.lit("V"), "o_orderkey").alias("v"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), place.alias("r"))


def _each(line: Column, kept: Column | None = None, by: str = "\n") -> Column:
    """A survey's lines in the order of its variables."""
    lines = F.array_sort(F.collect_list(F.when(F.lit(True) if kept is None else kept, F.struct("r", line.alias("line")))))
    return F.array_join(lines["line"], by)


def _with(template: str) -> Column:
    """A line of a variable: {v}, {p}, {a} and {b} stand for its name, label and columns."""
    out = F.lit(template)
    for mark, value in (("{v}", F.col("v")), ("{p}", F.col("p")), ("{a}", (F.col("r") * 10).cast("string")), ("{b}", (F.col("r") * 10 + 7).cast("string"))):
        out = F.replace(out, F.lit(mark), value)
    return out


def _is(status: str) -> Column:
    return F.col("s") == status


def _pieces(fr: str) -> dict[str, Column]:
    """The sections of a survey's files in a language."""
    codes = f"""    "00" '{fr}l''un'\n    '01'  "{fr}two" \n 2.0 "{fr}it's 3/4"\n   2 "{fr}again"\n"""
    labels = F.concat(F.lit("* a comment\nVariable  Labels\n"), _each(F.when(F.col("r") % 2 == 0, _with(f"  {{v}}\t'{fr}{{p}} at ' +\n     'birth'")).otherwise(_with(f'  /{{v}} "{fr}{{p}} at birth"'))), F.lit("\n .\nnot \"read\"\n"))
    values = F.concat(
        F.lit("VALUE LABELS\n/"), _each(_with("{v}"), _is("O"), "\n  "), F.lit(f"\n{codes}"), _each(_with(f'  {{v}} 96 "{"Enchaînement valide" if fr else "Valid skip"}" 99 "{"Non déclaré" if fr else "Not stated"}"'), _is("P")), F.lit("\n .\n")
    )
    return {"labels": labels, "values": values}


def _sections() -> dict[str, Column]:
    layout = F.concat(F.lit("DATA LIST FILE = 'a/b' NOTABLE/\n"), _each(_with("  {v} {a} - {b}"), by="  \n"), F.lit("\n.\n"))
    formats = F.concat(F.lit("FORMATS\n"), _each(_with("{v} (F8.2)"), _is("F"), " / "), F.lit("\n.\n"))
    missing = F.concat(F.lit("MISSING VALUES\n"), _each(F.when(F.col("r") % 3 == 0, _with("  {v} (1E5 THRU 2e5)")).when(F.col("r") % 3 == 1, _with("  {v} (9 THRU )")).otherwise(_with("  {v} (7)")), _is("F")), F.lit("\n.\nEXECUTE.\n"))
    return {"layout": layout, "formats": formats, "missing": missing}


def _mono(spark, sf_dir: str) -> DataFrame:
    o, s = _orders(spark, sf_dir), _sections()
    english, french = _pieces(""), _pieces("fr ")
    made = o.groupBy("survey").agg(F.concat(s["layout"], english["labels"], english["values"], s["formats"], s["missing"]).alias("eng"), F.concat(french["labels"], french["values"]).alias("fra"))
    each = F.explode(F.create_map(F.lit("eng"), "eng", F.lit("fra"), "fra")).alias("lang", "text")
    return made.select("survey", each).withColumn("part", F.lit(0))


_O = "(SELECT o_custkey AS survey, 'V' || o_orderkey AS name, o_orderstatus AS s, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)"
_VARIABLES = """SELECT survey, name, p || ' at birth' AS label_en, 'fr ' || p || ' at birth' AS label_fr, CASE s WHEN 'O' THEN 'character' ELSE 'numeric' END AS type,
  CASE s WHEN 'F' THEN {decimals} WHEN 'P' THEN 0 END::INT AS decimals,
  CASE WHEN s = 'P' THEN {sentinel} WHEN s = 'F' THEN CASE r % 3 WHEN 0 THEN 1e5 WHEN 1 THEN 9 ELSE 7 END END::DOUBLE AS missing_low,
  CASE WHEN s = 'P' THEN {high} WHEN s = 'F' THEN CASE r % 3 WHEN 0 THEN 2e5 WHEN 2 THEN 7 END END::DOUBLE AS missing_high FROM """ + _O
_CODES = f"""SELECT survey, name, val, label AS label_en, 'fr ' || label AS label_fr FROM {_O},
  (VALUES ('00', 'l''un'), ('01', 'two'), ('2', 'it''s 3/4')) t(val, label) WHERE s = 'O'"""
_VARIABLE = ("survey", "name", "label_en", "label_fr", "type", "decimals", "missing_low", "missing_high")
_CODE = ("survey", "name", "val", "label_en", "label_fr")


@_query(_VARIABLES.format(decimals=2, sentinel=96, high=99))
def spss_files_variables(spark, sf_dir):
    """PAR-01..04, PAR-06, PAR-07, JOIN-03, SEN-01: the variables of many command files."""
    return frames.command_files(_mono(spark, sf_dir)).variables.select(*_VARIABLE)


@_query(_CODES)
def spss_files_codes(spark, sf_dir):
    """PAR-05, JOIN-04: codes of groups of variables, in many command files."""
    return frames.command_files(_mono(spark, sf_dir)).codes.select(*_CODE)


@_query(f'SELECT survey, name, (10 * r)::INT AS start, (10 * r + 7)::INT AS "end" FROM {_O}')
def spss_files_layout(spark, sf_dir):
    """PAR-08: the layouts of many command files."""
    return frames.command_files(_mono(spark, sf_dir)).layout.select("survey", "name", "start", "end")


def _split_files(spark, sf_dir: str) -> DataFrame:
    o, s = _orders(spark, sf_dir), _sections()
    english, french = _pieces(""), _pieces("fr ")
    note = F.when(_is("O"), _with("  {v} {a} - {b} (A)")).when(_is("F"), _with("  {v} {a} - {b} (2)")).otherwise(_with("  {v} {a} - {b} (F8.0)"))
    layout = F.concat(F.lit("DATA LIST FILE = IN NOTABLE/\n"), _each(note), F.lit("\n.\n"))
    roles = {"layout": layout, "labels_en": english["labels"], "codes_en": english["values"], "missing": s["missing"], "labels_fr": french["labels"], "codes_fr": french["values"]}
    made = o.groupBy("survey").agg(*[c.alias(k) for k, c in roles.items()])
    return made.select("survey", F.explode(F.create_map(*[x for k in roles for x in (F.lit(k), F.col(k))])).alias("role", "text"))


@_query(_VARIABLES.format(decimals=2, sentinel=96, high=99))
def split_files_variables(spark, sf_dir):
    """PAR-09, PAR-10, PAR-11: surveys with a file a section; decimals from the layout."""
    return frames.split_files(_split_files(spark, sf_dir)).variables.select(*_VARIABLE)


@_query(_CODES)
def split_files_codes(spark, sf_dir):
    """PAR-09, PAR-10"""
    return frames.split_files(_split_files(spark, sf_dir)).codes.select(*_CODE)


def _lfs(spark, sf_dir: str) -> DataFrame:
    own = _with('"{v}",8,"{p}, ""so""\nat birth",fr {p}')
    codes = F.when(_is("O"), F.lit('\n,1,One,Un\n,"1 - 7",a range,\n,blank,Blank,\n,02,"Two, three",')).when(_is("P"), F.lit("\n,96,Valid skip,\n,99,Not stated,")).otherwise(F.lit(",\n,,,"))
    book = F.concat(F.lit("﻿Field_Champ,Variable_Variable,EnglishLabel_EtiquetteAnglais,FrenchLabel_EtiquetteFrancais\r\n"), _each(F.concat(own, codes)))
    return _orders(spark, sf_dir).groupBy("survey").agg(book.alias("text"))


@_query(f"""SELECT survey, name, p || ', "so"' || chr(10) || 'at birth' AS label_en, 'fr ' || p AS label_fr, CASE s WHEN 'O' THEN 'character' ELSE 'numeric' END AS type, NULL::INT AS decimals,
  CASE WHEN s = 'P' THEN 96.0 END::DOUBLE AS missing_low, CASE WHEN s = 'P' THEN 99.0 END::DOUBLE AS missing_high FROM {_O}""")
def lfs_codebooks_variables(spark, sf_dir):
    """PAR-15, WIN-04: the variables of many codebooks, labels with commas and line ends."""
    return frames.lfs_codebooks(_lfs(spark, sf_dir)).variables.select(*_VARIABLE)


@_query(f"SELECT survey, name, val, label_en, label_fr FROM {_O}, (VALUES ('1', 'One', 'Un'), ('02', 'Two, three', NULL)) t(val, label_en, label_fr) WHERE s = 'O'")
def lfs_codebooks_codes(spark, sf_dir):
    """PAR-15: ranges and blanks are no codes; those of missing answers alone make a range."""
    return frames.lfs_codebooks(_lfs(spark, sf_dir)).codes.select(*_CODE)


@_query(f"SELECT survey, name, val, label_en, label_fr FROM {_O}, (VALUES ('1', 'Yes', 'Oui'), ('2', 'No', 'Non')) t(val, label_en, label_fr) WHERE s = 'O'")
def cpss_codebooks_codes(spark, sf_dir):
    """PAR-16: codes of many codebooks, the variable's name filled down."""
    head = "Variable / Variable,Variable name - English / Nom,Variable name - French / Nom,Code / Code,Label - English / A,Label - French / F\n"
    first = F.when(_is("O"), _with("{v},{p},fr {p},1,Yes,Oui\n,,,2,No,Non")).otherwise(_with("{v},{p},fr {p},,,"))
    books = _orders(spark, sf_dir).groupBy("survey").agg(F.concat(F.lit(head), _each(first)).alias("text"))
    return frames.cpss_codebooks(books).codes.select(*_CODE)
