"""The build of one survey table: raw strings and metadata to typed, labelled columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import convert
from ..model import Code, Fixups, Metadata, Variable
from ..operators.columns import rename_present, swap_names
from ..sources.sentinels import sentinel_ranges

#: Codes of a variable from which labels are joined, and characters of a broadcast table.
LONG, BROADCAST_CHARS = 500, 8_000_000


def prepared(metadata: Metadata, fix: Fixups) -> Metadata:
    """Metadata after the fixups, in the build's order of steps 3 and 7 to 12."""
    fix.check()
    m = metadata.upper()
    up = lambda names: {n.upper() for n in names}
    labels = {k.upper(): v for k, v in fix.labels_supplement.items()}
    variables = [
        replace(v, label_en=v.label_en or labels.get(v.name, (None, None))[0], label_fr=v.label_fr or labels.get(v.name, (None, None))[1]) for v in m.variables
    ]
    codes = [*m.codes, *(replace(c, name=c.name.upper()) for c in fix.codes_supplement)]
    numeric, verbatim = up(fix.force_numeric), up(fix.force_character) | up(fix.force_integer) | up(fix.force_bigint)

    def forced(v: Variable) -> Variable:
        if v.name in numeric:
            values = [float(c.val) for c in codes if c.name == v.name and c.val.strip().replace(".", "", 1).lstrip("+-").isdigit()]
            low = v.missing_low if v.missing_low is not None else min(values, default=None)
            high = v.missing_high if v.missing_high is not None else max(values, default=None)
            return replace(v, type="numeric", missing_low=low, missing_high=high)
        return replace(v, type="character") if v.name in verbatim else v

    variables = [forced(v) for v in variables]
    codes = [c for c in codes if c.name not in numeric | verbatim]
    ranges = {k.upper(): v for k, v in fix.missing_supplement.items()}
    variables = [replace(v, missing_low=ranges[v.name][0], missing_high=ranges[v.name][1]) if v.name in ranges else v for v in variables]
    # A numeric variable with codes beyond sentinels is a category after all.
    now = Metadata(tuple(variables), tuple(codes), m.layout)
    coded, sentinel = {c.name for c in codes}, set(sentinel_ranges(now))
    variables = tuple(replace(v, type="character") if v.type == "numeric" and v.name in coded - sentinel else v for v in variables)
    return Metadata(variables, tuple(codes), m.layout)


def typed(raw: DataFrame, metadata: Metadata, fix: Fixups | None = None, lang: str | None = "eng") -> DataFrame:
    """The labelled table of a raw one, as a single projection.

    A labelled column carries its complete, ordered levels in its metadata.
    Columns without metadata stay strings. With ``lang`` None codes stay codes:
    what is stored, and labelled in either language when it is read.
    """
    fix = fix or Fixups()
    m = prepared(metadata, fix)
    df = raw
    if fix.str_pad:
        pads = {c.upper(): p for p in fix.str_pad for c in p["cols"]}
        df = df.select(*[convert.padded(F.col(c), pads[c]["width"], pads[c].get("side", "left"), pads[c].get("pad", " ")).alias(c) if c in pads else F.col(c) for c in df.columns])
    df = swap_names(rename_present(df, fix.rename), fix.cols_swap)
    variables = {v.name: v for v in m.variables}
    integers, bigints = {n.upper() for n in fix.force_integer}, {n.upper() for n in fix.force_bigint}
    out = []
    for c in df.columns:
        v, col = variables.get(c), F.col(f"`{c}`")
        if c in integers or c in bigints:
            # ANSI casts: a value out of range is an error, not a null.
            out.append(col.cast("int" if c in integers else "bigint").alias(c))
        elif v is not None and v.type == "numeric":
            out.append(convert.numeric_value(col, v.missing_low, v.missing_high, fix.na_values).alias(c))
        elif v is not None and lang is not None and (codes := m.codes_of(c)):
            label = convert.labelled(col, codes, lang, fix.na_values)
            out.append(label.alias(c, metadata={"levels": convert.levels(codes, lang)}))
        else:
            out.append(col)
    return df.select(*out)


def labelled(coded: DataFrame, metadata: Metadata, fix: Fixups | None = None, lang: str = "eng") -> DataFrame:
    """A stored, coded table with labels: one projection over its string columns; lists
    of more than LONG codes are joined as a table instead."""
    fix = fix or Fixups()
    m = prepared(metadata, fix)
    out, long = [], {}
    for c, kind in coded.dtypes:
        codes = m.codes_of(c) if kind == "string" else []
        if len(codes) > LONG:
            long[c] = codes
        label = convert.labelled(F.col(f"`{c}`"), codes, lang, fix.na_values) if codes and c not in long else None
        out.append(F.col(f"`{c}`") if label is None else label.alias(c, metadata={"levels": convert.levels(codes, lang)}))
    done = coded.select(*out)
    for c, codes in long.items():
        done = joined_labels(done, c, codes, lang, fix.na_values)
    return done


def joined_labels(df: DataFrame, column: str, codes: Sequence[Code], lang: str = "eng", na_values: Iterable[str] = ()) -> DataFrame:
    """LAB-01 for long lists: as ``convert.labelled``, by a join with a table of codes, which
    is broadcast up to BROADCAST_CHARS characters. Every code is one row there, so no
    row is lost or doubled, and a code that many rows have is split as the join runs."""
    pairs, whole = convert.label_pairs(codes, lang)
    known = [(k, v) for k, v in pairs if v is not None]
    key, label = (x.ljust(1 + max(map(len, df.columns)), "_") for x in ("key", "label"))  # names that no column has
    table = df.sparkSession.createDataFrame(known, f"`{key}` string, `{label}` string")
    if sum(len(k) + len(v) for k, v in known) <= BROADCAST_CHARS:
        table = F.broadcast(table)
    raw = F.trim(F.col(f"`{column}`"))
    tokens = list(na_values)
    own = convert.code_key(raw) if whole else raw
    met = df.join(table, (F.when(~raw.isin(tokens), own) if tokens else own) == F.col(f"`{key}`"), "left")
    levels = convert.levels(codes, lang)
    return met.select(*[F.col(f"`{label}`").alias(c, metadata={"levels": levels}) if c == column else F.col(f"`{c}`") for c in df.columns])


def unmatched(raw: DataFrame, metadata: Metadata, fix: Fixups | None = None, most: int = 5) -> DataFrame:
    """(name, value, rank, n): for each column the first ``most`` codes in the data, by
    value, that the metadata lacks, and how many different ones there are.

    All columns are counted in one pass: a task hands on each value once, and only
    counts and first values meet.
    """
    fix = fix or Fixups()
    m = prepared(metadata, fix)
    coded = [c for c in raw.columns if m.codes_of(c)]
    if not coded:
        return raw.sparkSession.createDataFrame([], "name string, value string, rank int, n long")
    found = [F.struct(F.lit(c).alias("name"), convert.unmatched(F.col(f"`{c}`"), m.codes_of(c), fix.na_values).alias("value")) for c in coded]
    lacking = F.filter(F.array(*found), lambda x: x["value"].isNotNull())
    values = raw.select(F.explode(lacking).alias("x")).select("x.name", "x.value").distinct()
    rank = F.row_number().over(Window.partitionBy("name").orderBy("value"))
    first = values.withColumn("rank", rank).filter(F.col("rank") <= most)
    sizes = values.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return first.join(sizes, "name").select("name", "value", F.col("rank").cast("int").alias("rank"), "n")


def unmatched_values(raw: DataFrame, metadata: Metadata, fix: Fixups | None = None, most: int = 5) -> dict[str, list[str]]:
    """The first codes in the data that the metadata lacks, by column."""
    out: dict[str, list[str]] = {}
    for r in sorted(unmatched(raw, metadata, fix, most).collect()):
        out.setdefault(r["name"], []).append(r["value"])
    return out


def label_warnings(raw: DataFrame, metadata: Metadata, fix: Fixups | None = None) -> list[str]:
    """LAB-01, LAB-02: what a build should tell of codes without a label, and of labels that
    stay English in French."""
    told: dict[str, tuple[int, list[str]]] = {}
    for r in sorted(unmatched(raw, metadata, fix).collect()):
        told.setdefault(r["name"], (r["n"], []))[1].append(r["value"])
    out = [f"{c}: {n} values without a code become null: {', '.join(first)}{' ...' if n > len(first) else ''}" for c, (n, first) in told.items()]
    m = prepared(metadata, fix or Fixups())
    french = {c.name for c in m.codes if c.label_fr is not None}
    english = sorted({c.name for c in m.codes if c.name in french and c.label_fr is None and c.label_en is not None and c.name in raw.columns})
    return out + [f"{c}: some codes have no French label, so the English one stands" for c in english]


def levels_of(df: DataFrame, column: str) -> list[str] | None:
    """The ordered levels a labelled column carries."""
    return df.schema[column].metadata.get("levels")


def with_shipped_weights(df: DataFrame, weights: DataFrame, key: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """JOIN-01: shipped replicate weights by key; null keys match null keys.

    Weight columns the table has already are dropped from the right side.
    """
    right = weights.drop(*[c for c in weights.columns if c != key and (c in df.columns or c in drop)])
    right = right.withColumnRenamed(key, "_key")
    return df.join(right, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
