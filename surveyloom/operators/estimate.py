"""Survey estimates: weighted totals and shares, errors and intervals from
replicates, age standardisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_total(df: DataFrame, by: Sequence[str], weight: str, name: str = "total") -> DataFrame:
    return df.groupBy(*by).agg(F.sum(weight).alias(name))


def share(df: DataFrame, value: str, within: Sequence[str] = (), name: str = "share", guarded: bool = False) -> DataFrame:
    """WIN-01..03: a value's share of the sum within groups (or of all rows);
    guarded, a value of zero has share zero whatever the sum."""
    part = F.col(value) / F.sum(value).over(Window.partitionBy(*within))
    return df.withColumn(name, F.when(F.col(value) == 0, F.lit(0.0)).otherwise(part) if guarded else part)


def weighted_share(df: DataFrame, by: Sequence[str], within: Sequence[str], weight: str) -> DataFrame:
    """Totals by ``by`` and their shares within ``within``: one shuffle of the data;
    the window sees one row a group."""
    return share(weighted_total(df, by, weight), "total", within)


def many_totals(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """AGG-02: totals over many columns at once."""
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in columns])


def replicate_totals(df: DataFrame, by: Sequence[str], weights: str = "weights", value: Column | None = None) -> DataFrame:
    """(by, replicate, total) from an array of replicate weights a row."""
    rows = df.select(*by, F.posexplode(weights).alias("replicate", "w"), *([value.alias("_v")] if value is not None else []))
    w = F.col("w") * F.col("_v") if value is not None else F.col("w")
    return rows.groupBy(*by, (F.col("replicate") + 1).alias("replicate")).agg(F.sum(w).alias("total"))


def standard_error(replicates: DataFrame, point: DataFrame, by: Sequence[str], value: str = "total") -> DataFrame:
    """AGG-06: sqrt(mean((replicate - point)^2)) by group."""
    p = point.select(*by, F.col(value).alias("point"))
    off = F.col(value) - F.col("point")
    return replicates.join(p, list(by)).groupBy(*by).agg(F.first("point").alias("point"), F.sqrt(F.avg(off * off)).alias("se"))


def interval(replicates: DataFrame, by: Sequence[str], value: str = "total", level: float = 0.95) -> DataFrame:
    """AGG-07: percentile interval, quantiles interpolated linearly."""
    tail = (1 - level) / 2
    at = F.percentile(F.col(value), F.array(F.lit(tail), F.lit(1 - tail)))
    return replicates.groupBy(*by).agg(at.alias("q")).select(*by, F.get("q", 0).alias("low"), F.get("q", 1).alias("high"))


def standardised(df: DataFrame, group: str, stratum: str, value: str, weight: str, standard: DataFrame) -> DataFrame:
    """JOIN-10: each group's rate, its strata weighted as in ``standard``
    (stratum, share). The strata's shares are re-scaled to those a group has."""
    rates = df.groupBy(group, stratum).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("rate"))
    both = rates.join(standard, stratum)
    return both.groupBy(group).agg((F.sum(F.col("rate") * F.col("share")) / F.sum("share")).alias("rate"))


def crosstab(df: DataFrame, rows: str, row_levels: Sequence[str], cols: str, col_levels: Sequence[str]) -> DataFrame:
    """Counts for all combinations of levels, those that don't occur being zero."""
    spark = df.sparkSession
    cells = spark.createDataFrame([(a, b) for a in row_levels for b in col_levels], f"{rows} string, {cols} string")
    return cells.join(df.groupBy(rows, cols).count(), [rows, cols], "left").select(rows, cols, F.coalesce("count", F.lit(0)).alias("n"))


def null_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AGG-11: null counts of weight columns, which must all be zero."""
    return df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns])


def weight_columns(columns: Sequence[str]) -> list[str]:
    """AGG-11/PRJ-13: names of person or household weights, without replicates.

    A name is taken apart at underscores and digits; a weight's has a part that is
    one of the short words, or begins or ends with a longer one. Numbered names
    are replicates, as are those with a replicate's mark.
    """
    # How weights, and marks of replicates, are written.
    weight, whole, replicate = ("WEIGHT", "WGHT", "WGT", "FINWGH"), ("WT", "WTPP"), ("BS", "BSW", "WTI")
    out = []
    for c in columns:
        letters = "".join(x if x.isalpha() else " " for x in c.upper()).split()
        marked = any(x in whole or x.startswith(weight) or x.endswith(weight) for x in letters)
        copied = c[-1:].isdigit() or any(x.endswith(replicate) or x.startswith(replicate) for x in letters)
        if marked and not copied:
            out.append(c)
    return out


def replicate_order(columns: Sequence[str]) -> list[str]:
    """SRT-02: by the number at the end, so that 10 follows 9."""
    import re

    return sorted(columns, key=lambda c: int(m[0]) if (m := re.search(r"\d+$", c)) else -1)
