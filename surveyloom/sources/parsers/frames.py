"""Command files and codebooks of many surveys at once, as stages over DataFrames.

A row is a file. Lines, sections, tokens and cells are arrays and rows of it. Command
files are cut as arrays in a survey's row; in codebooks what holds for the lines that
follow is carried down by windows within the file. So files are spread and none is
gathered with another survey's. Results are tables with a ``survey`` column beside the canonical ones.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions import convert
from ..shared import kept

SECTION = r"(?i)^\s*(DATA\s+LIST|FORMATS|VARIABLE\s+LABELS|VALUE\s+LABELS|MISSING\s+VALUES|EXECUTE|SAVE|GET|RECODE|COMPUTE|SET)\b"
#: The same within a line, and what a line can begin or end with.
COMMAND = SECTION.removeprefix("(?i)^").replace(r"\s", r"[ \x0B\f]")
BLANKS = " \x0b\x0c\x85\u2028\u2029"
QUOTED = r"""("[^"]*"|'(?:[^'\n]|'')*+')"""
TOKEN = QUOTED[:-1] + r"""|/|[^\s/"']+)"""
NAME = r"[A-Za-z_@#$][\w.@#$]*"
COMMENT, NO_COMMENT = r"(?i)^\s*(/\*|\*|COMMENT\b)", r"^\s*\*?\s*/[A-Za-z]"
PLACE = rf"({NAME})\s+(\d+)(?:\s*-\s*(\d+))?(?:\s*\(([^)]*)\))?"
FORMAT = r"([A-Za-z_][\w\s.@#$]*?)\s*\(\s*([A-Za-z]+)\d*(?:\.(\d+))?\s*\)"
MISSING = r"([A-Za-z_][\w\s.,/]*?)\s*\(\s*([-+.\deE]+)(\s+THRU)?\s*([-+.\deE]*)[^)]*\)"

#: Bytes of texts that one task cuts and parses.
PART_BYTES = 4_000_000
#: What the parts of a split survey are, in the order they are read in.
ENGLISH_ROLES, FRENCH_ROLES = ("layout", "labels_en", "codes_en", "missing"), ("labels_fr", "codes_fr")


class Parsed(NamedTuple):
    """variables (survey, ord, name, label_en, label_fr, type, decimals, missing_low,
    missing_high), codes (survey, ord, name, val, label_en, label_fr), layout
    (survey, ord, name, start, end)."""

    variables: DataFrame
    codes: DataFrame
    layout: DataFrame | None


def _matches(text: Column, pattern: str, *groups: int) -> Column:
    """An array of structs (g1, g2, ...) of a pattern's groups, '' where one is absent."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups])


def _unquoted(token: Column) -> Column:
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.when(F.startswith(token, F.lit('"')), inner).when(F.startswith(token, F.lit("'")), F.replace(inner, F.lit("''"), F.lit("'"))).otherwise(token)


def _is_quoted(token: Column) -> Column:
    return token.rlike("^[\"']")


def _filled(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def _plain(value: Column) -> Column:
    """An unquoted code: a number without needless zeros, or the text."""
    number = value.try_cast("double")
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(value.rlike(convert.NUMBER), F.when(whole, number.try_cast("long").cast("string")).otherwise(number.cast("string"))).otherwise(value)


def _first(rows: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; ``ord`` is its place."""
    return rows.groupBy(*keys).agg(F.min(F.struct(F.struct(*order).alias("ord"), *values)).alias("first")).select(*keys, *[f"first.{c}" for c in values], "first.ord")


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once; plain reuse would copy its tree."""
    return F.get(F.transform(F.array(value), then), 0)


def _runs(rows: Column, starts: Column) -> Column:
    """An array cut before each of the places ``starts`` (from 0, in order); what comes
    before the first place is left out."""
    end = lambda i: F.coalesce(F.get(starts, i + 1), F.size(rows))
    return F.transform(starts, lambda at, i: F.slice(rows, at + 1, end(i) - at))


def _places(rows: Column, told) -> Column:
    """The places (from 0) of the entries of which ``told`` (entry, place) is true."""
    return F.filter(F.transform(rows, lambda x, i: F.when(told(x, i), i)), lambda i: i.isNotNull())


def sections(texts: DataFrame) -> DataFrame:
    """(survey, lang, k, section, body) of texts (survey, lang, part, text): PAR-03, PAR-10.

    Parts of a survey and language are read one after another. Tabs are spaces,
    strings continued by + are joined, comment lines go; a command ends with the
    first line that ends in a full stop outside quotes. A survey's text stays in
    one row until it is cut before each command; patterns see few of its lines.
    """
    text = F.translate("text", "\t\r\x1a", " ")
    text = F.regexp_replace(text, r"""(['"]) *\+\s*(['"])""", "")
    may_be_comment = lambda x: F.substring(F.ltrim(x, F.lit(BLANKS)), 1, 1).isin("/", "*", "C", "c")
    lines = F.filter(F.split(text, "\n"), lambda x: ~(may_be_comment(x) & x.rlike(COMMENT)) | x.rlike(NO_COMMENT))
    read = texts.filter("text IS NOT NULL").select("survey", "lang", "part", lines.alias("lines"))
    whole = read.groupBy("survey", "lang").agg(F.array_join(F.flatten(F.array_sort(F.collect_list(F.struct("part", "lines")))["lines"]), "\n").alias("text"))
    each = whole.select("survey", "lang", F.posexplode(F.split(F.concat("text", F.lit("\n")), f"(?dim)(?=^{COMMAND})")).alias("k", "text")).filter(F.col("text").rlike(f"(?i)^{COMMAND}"))
    named = F.upper(F.regexp_replace(F.regexp_extract("text", SECTION, 1), r"\s+", " "))
    # Each chunk ends with a line end.
    rest = F.split(F.regexp_replace(F.regexp_replace("text", r"\n\z", ""), SECTION, ""), "\n")
    each = each.select("survey", "lang", F.col("k").cast("long").alias("k"), named.alias("section"), rest.alias("rest"))
    may_end = lambda x: F.endswith(F.rtrim(x, F.lit(BLANKS)), F.lit("."))
    ends = F.transform("rest", lambda x: may_end(x) & F.regexp_replace(x, QUOTED, "x").rlike(r"\.\s*$"))
    each = each.withColumn("last", F.array_position(ends, True).cast("int"))
    own = F.when(F.col("last") > 0, F.concat(F.slice("rest", F.lit(1), F.greatest(F.col("last") - 1, F.lit(0))), F.array(F.regexp_replace(F.get("rest", F.col("last") - 1), r"\s*\.\s*$", "")))).otherwise(F.col("rest"))
    return each.select("survey", "lang", "k", "section", F.array_join(own, "\n").alias("body"))


def variable_labels(parts: DataFrame) -> DataFrame:
    """(survey, lang, name, label, ord): PAR-04, the first label of a name."""
    tokens = F.regexp_extract_all("body", F.lit(TOKEN), F.lit(1))
    rows = parts.filter("section = 'VARIABLE LABELS'").select("survey", "lang", "k", tokens.alias("t"))
    pairs = F.transform("t", lambda x, i: F.struct(i.alias("at"), x.alias("name"), F.get(F.col("t"), i + 1).alias("label")))
    named = F.filter(pairs, lambda p: p["name"].rlike(f"^{NAME}$") & F.coalesce(_is_quoted(p["label"]), F.lit(False)))
    found = rows.select("survey", "lang", "k", F.explode(named).alias("p"))
    found = found.select("survey", "lang", "k", F.col("p.at").alias("at"), F.upper("p.name").alias("name"), _filled(_unquoted(F.col("p.label"))).alias("label"))
    return _first(found, ["survey", "lang", "name"], ["label"], ["k", "at"])


def value_labels(parts: DataFrame) -> DataFrame:
    """(survey, lang, name, val, label, ord): PAR-05, the first label of a name's value.

    A word and the quoted strings after it are one item. An odd number of strings
    makes the word a value with its label, an even one a name; strings left are
    quoted values with their labels. A group begins at a slash, or at a name after
    a group's codes, and every name of a group has all of its codes.
    """
    tokens = F.regexp_extract_all("body", F.lit(TOKEN), F.lit(1))
    rows = parts.filter("section = 'VALUE LABELS'").select("survey", "lang", "k", tokens.alias("tokens"))
    rows = rows.select("survey", "lang", "k", "tokens", _places(F.col("tokens"), lambda x, i: ~_is_quoted(x)).alias("starts"))
    pairs = lambda every: F.transform(F.sequence(F.lit(1), F.size(every), F.lit(2)), lambda i: F.struct(F.get(every, i - 1).alias("val"), F.get(every, i).alias("label")))

    def item(run: Column) -> Column:
        word, odd = F.get(run, 0), F.size(run) % 2 == 0
        every = F.when(odd, run).otherwise(F.slice(run, F.lit(2), F.size(run)))
        return F.struct(
            word.alias("word"), (~odd & word.rlike("^[A-Za-z_@#$]")).alias("is_name"), (word == "/").alias("is_slash"),
            _let(every, lambda e: F.when(F.size(e) > 0, pairs(e)).otherwise(F.array().cast("array<struct<val:string,label:string>>"))).alias("pairs"),
        )

    items = rows.select("survey", "lang", "k", F.transform(_runs(F.col("tokens"), F.col("starts")), item).alias("items"))
    items = items.select("survey", "lang", "k", F.filter("items", lambda x: x["is_name"] | x["is_slash"] | (F.size(x["pairs"]) > 0)).alias("items"))
    begins = lambda x, i: (i == 0) | x["is_slash"] | x["is_name"] & F.coalesce(F.size(F.get(F.col("items"), i - 1)["pairs"]) > 0, F.lit(False))
    items = items.select("survey", "lang", "k", "items", _places(F.col("items"), begins).alias("starts"))
    groups = items.select("survey", "lang", "k", F.posexplode(_runs(F.col("items"), F.col("starts"))).alias("g", "run"))
    names = F.transform(F.filter("run", lambda x: x["is_name"]), lambda x: F.upper(F.regexp_replace(x["word"], "^,+|,+$", "")))
    each = groups.select("survey", "lang", "k", "g", F.explode(names).alias("name"), F.flatten(F.transform("run", lambda x: x["pairs"])).alias("pairs"))
    each = each.select("survey", "lang", "k", "g", "name", F.posexplode("pairs").alias("at", "p"))
    value = F.when(_is_quoted(F.col("p.val")), F.trim(_unquoted(F.col("p.val")))).otherwise(_plain(F.rtrim(F.col("p.val"), F.lit("."))))
    each = each.select("survey", "lang", "k", "g", "at", "name", value.alias("val"), _filled(_unquoted(F.col("p.label"))).alias("label"))
    return _first(each, ["survey", "lang", "name", "val"], ["label"], ["k", "g", "at"])


def _only_first(parts: DataFrame, section: str) -> DataFrame:
    found = parts.filter(F.col("section") == section)
    return found.groupBy("survey", "lang").agg(F.min_by("body", "k").alias("body"))


def layout(parts: DataFrame) -> DataFrame:
    """(survey, lang, ord, name, start, end, letter, decimals): PAR-08, PAR-11, of the
    first DATA LIST."""
    body = F.regexp_replace("body", r"(?s)^[^/]*+/", "")
    rows = _only_first(parts, "DATA LIST").select("survey", "lang", F.posexplode(_matches(body, PLACE, 1, 2, 3, 4)).alias("ord", "m"))
    note = F.upper(F.trim("m.g4"))
    last = F.coalesce(F.nullif(F.col("m.g3"), F.lit("")), F.col("m.g2"))
    kind = r"^([A-Z]+)\d*(?:\.(\d+))?$"
    letter = F.when(note.rlike(kind), F.regexp_extract(note, kind, 1)).otherwise("F")
    decimals = F.when(note.rlike(r"^\d+$"), note).when(note.rlike(kind), F.nullif(F.regexp_extract(note, kind, 2), F.lit("")))
    return rows.select(
        "survey", "lang", "ord", F.upper("m.g1").alias("name"), F.col("m.g2").cast("int").alias("start"), last.cast("int").alias("end"),
        letter.alias("letter"), F.coalesce(decimals.cast("int"), F.lit(0)).alias("decimals"),
    )


def formats(parts: DataFrame) -> DataFrame:
    """(survey, lang, name, letter, decimals): PAR-06; FORMATS go before the layout's notes,
    and of a name's several the first before the others."""
    own = _only_first(parts, "FORMATS").select("survey", "lang", F.posexplode(_matches(F.col("body"), FORMAT, 1, 2, 3)).alias("at", "m"))
    decimals = F.coalesce(F.nullif(F.col("m.g3"), F.lit("")).cast("int"), F.lit(0))
    names = F.explode(F.filter(F.split("m.g1", r"\s+"), lambda x: x != ""))
    own = own.select("survey", "lang", F.lit(0).alias("k"), "at", names.alias("name"), F.upper("m.g2").alias("letter"), decimals.alias("decimals"))
    # The layout's last note of a name counts, as a later item replaces an earlier one.
    noted = layout(parts).select("survey", "lang", F.lit(1).alias("k"), (-F.col("ord")).alias("at"), "name", "letter", "decimals")
    both = own.withColumn("name", F.upper("name")).unionByName(noted)
    return _first(both, ["survey", "lang", "name"], ["letter", "decimals"], ["k", "at"]).drop("ord")


def missing(parts: DataFrame) -> DataFrame:
    """(survey, lang, name, low, high): PAR-07, the last range of a name; an open end is null."""
    rows = parts.filter("section = 'MISSING VALUES'").select("survey", "lang", "k", F.posexplode(_matches(F.col("body"), f"(?i){MISSING}", 1, 2, 3, 4)).alias("at", "m"))
    low = F.col("m.g2").try_cast("double")
    high = F.when(F.col("m.g3") == "", low).otherwise(F.col("m.g4").try_cast("double"))
    names = F.explode(F.filter(F.split("m.g1", r"[\s,/]+"), lambda x: x != ""))
    rows = rows.select("survey", "lang", (-F.col("k")).alias("k"), (-F.col("at")).alias("at"), names.alias("name"), low.alias("low"), high.alias("high"))
    return _first(rows.withColumn("name", F.upper("name")), ["survey", "lang", "name"], ["low", "high"], ["k", "at"]).drop("ord")


def _sentinel(label: str) -> tuple[Column, Column, Column]:
    """Over a variable's codes: do all labels mean missing or none, and the least and most
    code of those that mean missing."""
    text = F.coalesce(F.col(label), F.lit(""))
    number = F.when(convert.missing_label(text) & F.trim("val").rlike(convert.NUMBER), F.trim("val").try_cast("double"))
    return F.min(convert.sentinel_label(text)), F.min(number), F.max(number)


def sentinels(codes: DataFrame, label: str = "label_en") -> DataFrame:
    """(survey, name, low, high) of variables whose labels all mean missing or none, with
    the range of the codes that mean missing (SEN-01)."""
    every, low, high = _sentinel(label)
    found = codes.groupBy("survey", "name").agg(every.alias("every"), low.alias("low"), high.alias("high"))
    return found.filter("every").select("survey", "name", "low", "high")


def command_files(texts: DataFrame) -> Parsed:
    """PAR-01, PAR-02: texts (survey, lang, part, text), lang ``eng`` or ``fra``, to tables.

    The English files tell what there is; French labels join it by name and value.
    A variable with decimals is numeric; with categories or an A format it is
    character; with a missing range, any other format or a place in the layout
    numeric; else character. A null text has no lines; a survey without English
    files gives no rows.
    """
    # Dealt by survey, in as many partitions as the texts need: Spark would put them
    # together by their size in a shuffle, where such rows shrink to a fiftieth.
    texts = kept(texts, "texts")
    n = 1 + (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES
    parts = kept(sections(texts.repartition(n, "survey")), "sections").repartition(n, "survey")  # read several times
    english, french = parts.filter("lang = 'eng'"), parts.filter("lang = 'fra'")
    of = lambda lang, column: F.max(F.when(F.col("lang") == lang, F.col(column)))
    met = value_labels(parts).groupBy("survey", "name", "val").agg(of("eng", "ord").alias("ord"), of("eng", "label").alias("label_en"), of("fra", "label").alias("label_fr")).filter("ord IS NOT NULL")
    every, low, high = (c.over(Window.partitionBy("survey", "name")) for c in _sentinel("label_en"))
    codes = kept(met.withColumns({"every": every, "low": low, "high": high}), "codes")
    ranges = codes.filter("every").groupBy("survey", "name").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    codes = codes.filter("NOT every").select("survey", "ord", "name", "val", "label_en", "label_fr")

    # What is told of a name, one row each, met by one grouping.
    labelled = variable_labels(english).select("survey", "name", F.lit(0).alias("o1"), F.col("ord.k").cast("int").alias("o2"), F.col("ord.at").alias("o3"), F.col("label").alias("label_en"))
    placed = layout(english).select("survey", "name", F.lit(1).alias("o1"), F.lit(0).alias("o2"), F.col("ord").alias("o3"), F.lit(True).alias("in_layout"))
    facts = [
        labelled, placed, variable_labels(french).select("survey", "name", F.col("label").alias("label_fr")), formats(english).select("survey", "name", "letter", "decimals"),
        missing(english).select("survey", "name", "low", "high", F.lit(True).alias("ranged")), ranges.select("survey", "name", F.col("low").alias("s_low"), F.col("high").alias("s_high"), F.lit(True).alias("sentinel")),
        codes.select("survey", "name", F.lit(True).alias("coded")).distinct(),
    ]
    told = facts[0]
    for more in facts[1:]:
        told = told.unionByName(more, allowMissingColumns=True)
    known = told.repartition(n, "survey").groupBy("survey", "name").agg(
        F.min(F.when(F.col("o1").isNotNull(), F.struct("o1", "o2", "o3"))).alias("ord"),
        *[F.max(c).alias(c) for c in ("label_en", "label_fr", "letter", "decimals", "low", "high", "ranged", "s_low", "s_high", "sentinel", "coded", "in_layout")],
    ).filter("ord IS NOT NULL")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    low, high = (F.when(yes("ranged"), F.col(c)).otherwise(F.col(f"s_{c}")) for c in ("low", "high"))
    kind = (
        F.when(F.coalesce("decimals", F.lit(0)) > 0, "numeric").when(yes("coded") | (F.coalesce("letter", F.lit("")) == "A"), "character")
        .when(low.isNotNull() | F.col("letter").isNotNull() | yes("in_layout") | yes("sentinel"), "numeric").otherwise("character")
    )
    variables = known.withColumn("type", kind).select(
        "survey", "ord", "name", "label_en", "label_fr", "type", F.when(F.col("type") == "numeric", F.coalesce("decimals", F.lit(0))).alias("decimals"), low.alias("missing_low"), high.alias("missing_high")
    )
    return Parsed(variables, codes, layout(english).select("survey", "ord", "name", "start", "end"))


def split_files(files: DataFrame) -> Parsed:
    """PAR-09: one file a section, as rows (survey, role, text)."""
    roles = [*ENGLISH_ROLES, *FRENCH_ROLES]
    part = F.array_position(F.lit(roles), F.col("role"))
    lang = F.when(F.col("role").isin(*FRENCH_ROLES), "fra").otherwise("eng")
    return command_files(files.filter(F.col("role").isin(*roles)).select("survey", lang.alias("lang"), part.alias("part"), "text"))


RECORD = r"""((?:[^"\n]++|"(?:[^"]++|"")*+")++)"""
CELL = r""",("(?:[^"]++|"")*+"|[^,]*+)"""


def records(texts: DataFrame) -> DataFrame:
    """(survey, ord, head, cells) of delimited texts (survey, text): quoted cells can hold
    commas, quotes and line ends. Cells are trimmed, empty ones null; rows of empty
    cells go, and what the first record has is lower-cased in ``head``."""
    rows = F.regexp_extract_all(F.translate(F.regexp_replace("text", "^﻿", ""), "\r", ""), F.lit(RECORD), F.lit(1))
    cells = F.transform(F.regexp_extract_all(F.concat(F.lit(","), "record"), F.lit(CELL), F.lit(1)), lambda c: _filled(F.when(F.startswith(c, F.lit('"')), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)))
    each = texts.select("survey", F.posexplode(rows).alias("ord", "record")).select("survey", "ord", cells.alias("cells"))
    head = F.first(F.transform("cells", lambda c: F.lower(F.coalesce(c, F.lit(""))))).over(Window.partitionBy("survey").orderBy("ord"))
    return each.withColumn("head", head).filter("ord > 0").filter(F.exists("cells", lambda c: c.isNotNull()))


def _cell(column: Column) -> Column:
    """The cell under the first heading of which ``column`` (of the heading) is true."""
    return F.get(F.col("cells"), F.array_position(column, F.lit(True)).cast("int") - 1)


def _down(name: Column) -> Column:
    return F.last(name, ignorenulls=True).over(Window.partitionBy("survey").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))


def lfs_codebooks(texts: DataFrame) -> Parsed:
    """PAR-15: the first column is filled down; ranges and blanks are no codes."""
    at = lambda key: _cell(F.transform("head", lambda h: F.startswith(h, F.lit(key))))
    rows = records(texts).select("survey", "ord", F.upper(at("field")).alias("own"), at("variable").alias("val"), at("english").alias("label_en"), at("french").alias("label_fr"))
    rows = rows.withColumn("name", _down(F.col("own")))
    val = F.when((F.col("name") == "SURVMNTH") & F.col("val").rlike(r"^\d+$"), F.lpad("val", F.greatest(F.length("val"), F.lit(2)), F.lit("0"))).otherwise(F.col("val"))
    codes = rows.filter("own IS NULL AND name IS NOT NULL AND val IS NOT NULL").filter(~F.col("val").rlike(r"(?i)^blank$|^[\d.]+\s*[-–:]\s*[\d.]+$"))
    codes = codes.select("survey", "ord", "name", val.alias("val"), "label_en", "label_fr")
    ranges = sentinels(codes)
    codes = codes.join(ranges, ["survey", "name"], "left_anti")
    coded = codes.select("survey", "name", F.lit(True).alias("coded")).distinct()
    variables = rows.filter("own IS NOT NULL").join(coded, ["survey", "name"], "left").join(ranges, ["survey", "name"], "left")
    kind = F.when(F.col("coded"), "character").otherwise("numeric")
    columns = ["survey", "ord", "name", "label_en", "label_fr", kind.alias("type"), F.lit(None).cast("int").alias("decimals"), F.col("low").alias("missing_low"), F.col("high").alias("missing_high")]
    return Parsed(variables.select(*columns), codes.select("survey", "ord", "name", "val", "label_en", "label_fr"), None)


def cpss_codebooks(texts: DataFrame) -> Parsed:
    """PAR-16: variable name filled down, all variables character; a heading's French,
    after a slash, plays no part."""
    at = lambda key: _cell(F.transform("head", lambda h: F.trim(F.get(F.split(h, " / "), 0)) == key))
    rows = records(texts).select(
        "survey", "ord", F.upper(at("variable")).alias("own"), at("variable name - english").alias("name_en"), at("variable name - french").alias("name_fr"),
        at("code").alias("val"), at("label - english").alias("label_en"), at("label - french").alias("label_fr"),
    )
    rows = rows.withColumn("name", _down(F.col("own")))
    none = lambda kind: F.lit(None).cast(kind)
    variables = rows.filter("own IS NOT NULL").select(
        "survey", "ord", "name", F.col("name_en").alias("label_en"), F.col("name_fr").alias("label_fr"), F.lit("character").alias("type"),
        none("int").alias("decimals"), none("double").alias("missing_low"), none("double").alias("missing_high"),
    )
    codes = rows.filter("name IS NOT NULL AND val IS NOT NULL").select("survey", "ord", "name", "val", "label_en", "label_fr")
    return Parsed(variables, codes, None)
