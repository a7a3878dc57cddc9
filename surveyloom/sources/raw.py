"""Raw scans: every cell a string, trimmed, with missing tokens as null."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Field

MISSING_TOKENS = ("", "NA")
#: Encodings that Spark reads itself; the others are read as ISO-8859-1 and translated.
DIRECT = {"UTF-8": "UTF-8", "LATIN1": "ISO-8859-1", "ISO-8859-1": "ISO-8859-1"}


def code_page(name: str) -> tuple[str, str]:
    """The characters that ISO-8859-1 reads for bytes 80 to FF, and those meant."""
    read, meant = [], []
    for byte in range(0x80, 0x100):
        try:
            char = bytes([byte]).decode(name)
        except UnicodeDecodeError:
            continue
        if char != chr(byte):
            read.append(chr(byte))
            meant.append(char)
    return "".join(read), "".join(meant)


def decoded(df: DataFrame, encoding: str) -> DataFrame:
    """SRC-03: string columns read as ISO-8859-1 to what ``encoding`` means."""
    if encoding.upper() in DIRECT:
        return df
    read, meant = code_page(encoding)
    return df.select(*[F.translate(c, read, meant).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def _clean(col, tokens: Sequence[str] = MISSING_TOKENS):
    text = F.trim(col)
    return F.when(~text.isin(*tokens), text)


def read_lines(spark: SparkSession, path, encoding: str = "CP1252") -> DataFrame:
    """(value): a file's lines, decoded, without carriage returns."""
    charset = DIRECT.get(encoding.upper(), "ISO-8859-1")
    lines = spark.read.schema("value string").csv(path, sep="\u0001", quote="", encoding=charset, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return decoded(lines, encoding).select(F.regexp_replace("value", r"[\r]+$", "").alias("value"))


def fixed_width(lines: DataFrame, layout: Sequence[Field], tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """SRC-01: cuts ``value`` into the layout's fields, in one projection."""
    return lines.select(*[_clean(F.substring("value", f.start, f.end - f.start + 1), tokens).alias(f.name) for f in layout])


def read_fixed_width(spark: SparkSession, path, layout: Sequence[Field], encoding: str = "CP1252") -> DataFrame:
    return drop_junk(fixed_width(read_lines(spark, path, encoding), layout))


def read_delimited(spark: SparkSession, path, encoding: str = "CP1252", sep: str = ",", tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """SRC-02: a delimited file with a header, names in upper case."""
    charset = DIRECT.get(encoding.upper(), "ISO-8859-1")
    df = decoded(spark.read.csv(path, header=True, inferSchema=False, sep=sep, encoding=charset, escape='"'), encoding)
    return df.select(*[_clean(F.col(f"`{c}`"), tokens).alias(c.strip().upper()) for c in df.columns])


def drop_junk(df: DataFrame, least: int = 2) -> DataFrame:
    """SRC-04: rows with fewer than ``least`` cells go (the DOS end-of-file line)."""
    least = min(least, len(df.columns))
    return df.filter(reduce(add, [F.col(f"`{c}`").isNotNull().cast("int") for c in df.columns]) >= least)


def numeric_except(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SRC-07: a replicate-weight file; all but the keys become double."""
    from ..functions.convert import number

    return df.select(*[F.col(c) if c in keys else number(F.col(c)).alias(c) for c in df.columns])


def union_files(frames: Sequence[DataFrame]) -> DataFrame:
    """SRC-08/SET-01: rows by name, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_raw(spark: SparkSession, path, layout: Sequence[Field] | None = None, encoding: str = "CP1252", guess_numeric: bool = False) -> DataFrame:
    """SRC-10: a file that is in no cache, without labels; fixed-width with a layout, else
    delimited. ``guess_numeric`` makes columns double that hold numbers alone."""
    from ..functions.convert import number

    df = read_fixed_width(spark, path, layout, encoding) if layout else drop_junk(read_delimited(spark, path, encoding))
    if not guess_numeric:
        return df
    broken = df.agg(*[F.max((F.col(f"`{c}`").isNotNull() & number(F.col(f"`{c}`")).isNull()).cast("int")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") if broken[c] else number(F.col(f"`{c}`")).alias(c) for c in df.columns])
