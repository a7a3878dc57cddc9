"""Operators on a table's columns: relabelling, renaming, swapping, placing."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Metadata
from ..sources.shared import kept

DERIVED_LABELS = {
    "SURVDATE": {"eng": "Survey date", "fra": "Date d'enquête"},
    "GENDER_SEX": {"eng": "Gender or sex", "fra": "Genre ou sexe"},
}


def label_map(metadata: Metadata, columns: Sequence[str], lang: str = "eng") -> dict[str, str]:
    """PRJ-01: column name to label; labels that several columns share get
    `` (NAME)`` on each of them, columns without a label stay out."""
    labels = {}
    for v in metadata.variables:
        label = (v.label_fr or v.label_en) if lang == "fra" else v.label_en
        if label and v.name in columns:
            labels.setdefault(v.name, label)
    for name, by in DERIVED_LABELS.items():
        if name in columns:
            labels.setdefault(name, by[lang])
    often = Counter(labels.values())
    return {n: f"{x} ({n})" if often[x] > 1 else x for n, x in labels.items()}


def relabel(df: DataFrame, metadata: Metadata, lang: str = "eng") -> DataFrame:
    return df.withColumnsRenamed(label_map(metadata, df.columns, lang))


def coded_name(df_columns: Sequence[str], metadata: Metadata, name: str, lang: str = "eng") -> str:
    """PRJ-03: a column argument given by name or by label, as the coded name."""
    if name in df_columns:
        return name
    for coded, label in label_map(metadata, [v.name for v in metadata.variables], lang).items():
        if label == name:
            return coded
    raise ValueError(f"no column or label {name!r}")


def rename_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """PRJ-04: renames the columns that are there."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def swap_names(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """PRJ-05: exchanges the names of each pair, all at once."""
    other = {}
    for a, b in pairs:
        if a in df.columns and b in df.columns:
            other |= {a: b, b: a}
    return df.toDF(*[other.get(c, c) for c in df.columns])


def place_after(df: DataFrame, name: str, value: Column, after: str) -> DataFrame:
    """PRJ-07: adds (or moves) a column to stand after another."""
    out = []
    for c in df.columns:
        if c != name:
            out.append(F.col(f"`{c}`"))
        if c == after:
            out.append(value.alias(name))
    return df.select(*out)


def adjacent(df: DataFrame, first: str, second: str) -> DataFrame:
    """PRJ-06: the second column right after the first, if both are there."""
    if first not in df.columns or second not in df.columns:
        return df
    return place_after(df, second, F.col(second), first)


def survey_date(df: DataFrame, year: str = "SURVYEAR", month: str = "SURVMNTH", names: Sequence[str] = ()) -> DataFrame:
    """LFS-10: SURVDATE, the first of the month, after the month column.

    The month is a number, or one of ``names`` in calendar order; what is
    neither gives null.
    """
    for c in (year, month):
        if c not in df.columns:
            raise ValueError(f"no column {c}")
    m = F.col(month).try_cast("int") if not names else F.nullif(F.array_position(F.array(*[F.lit(x) for x in names]), F.col(month)), F.lit(0)).cast("int")
    made = F.when(m.between(1, 12), F.make_date(F.col(year).cast("int"), m, F.lit(1)))
    return place_after(df, "SURVDATE", made, month)


def gender_sex(df: DataFrame) -> DataFrame:
    """LFS-11: GENDER_SEX from GENDER, else from SEX; either column may be absent."""
    sex = F.when(F.col("SEX") == "Male", "Men+").when(F.col("SEX") == "Female", "Women+") if "SEX" in df.columns else None
    if "GENDER" in df.columns:
        value = F.coalesce(F.col("GENDER"), sex) if sex is not None else F.col("GENDER")
        return place_after(df, "GENDER_SEX", value, "GENDER")
    if sex is None:
        raise ValueError("neither GENDER nor SEX is there")
    return place_after(df, "GENDER_SEX", sex, "SEX")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """PRJ-15/WIN-06: the first row of each key in the given order."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def fill_down(df: DataFrame, column: str, order: str, within: Sequence[str] = ()) -> DataFrame:
    """WIN-04: a null takes the last value before it. ``within`` splits the work;
    without it all rows of the (small, codebook-sized) table are one window."""
    from pyspark.sql import Window

    w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def with_row_id(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """WIN-05/DML-08: numbers the rows of a table without an id, from 1, in the order of
    ``order`` (nulls first); rows equal in all of it are interchangeable.

    The rows are dealt by ranges of sampled keys, sorted and written once, one file a
    range; a file's rows are then told by their place in it, after the counts of
    the files before. There are as many ranges as the session has shuffle
    partitions, and a key that many rows share is spread over several.
    """
    width = 1 + max(map(len, df.columns))  # names that no column has
    salt, at, shift, place = (k.ljust(width, "_") for k in ("salt", "file", "shift", "place"))
    keys = [F.col(f"`{c}`") for c in order]
    ranged = df.withColumn(salt, F.rand(11)).repartitionByRange(*keys, F.col(f"`{salt}`")).sortWithinPartitions(*keys)
    rows = kept(ranged.drop(salt), "row-ids")
    numbers = F.regexp_extract_all(F.col("_metadata.file_name"), F.lit(r"^part-(\d+)|-c(\d+)"), F.lit(0))
    file = F.transform(numbers, lambda x: F.regexp_replace(x, r"\D", "").cast("int"))  # the task, then its several files
    placed = rows.select("*", file.alias(at), F.col("_metadata.row_index").alias(place))
    sizes = placed.groupBy(f"`{at}`").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(F.col(f"`{at}`")).rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    shifts = sizes.select(F.col(f"`{at}`"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(shift))
    numbered = placed.join(F.broadcast(shifts), at)
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns if c != name], (F.col(f"`{shift}`") + F.col(f"`{place}`") + 1).cast("long").alias(name))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """AGG-05: a column's values as text, which become its levels."""
    return df.select(F.col(f"`{column}`").cast("string").alias("value")).filter("value is not null").distinct()
