"""Bootstrap replicate weights by splitting draws down a tree of rows.

Replicate b draws, within each stratum, as many rows as the stratum has, with
replacement; a row's replicate weight is its weight times the number of draws.
No draw is a row anywhere. A stratum's n rows are cut into runs whose lengths are
powers of two, and n draws are dealt to the runs one after another: how many fall
into the next is binomial, found by comparing that many binary fractions with the
run's share digit by digit, all draws of a digit as the bits of a few hashed
words. Runs are then halved, the count of a half being the bits set among as many,
down to blocks; a block's counts of all replicates meet its rows as one array, and
are halved on down to the rows (module ``draws``).

The bits are a hash of (seed, stratum, place, size, b), so any replicate or stratum
can be made again, or added, on its own. The hash is whole-number arithmetic,
the same in any SQL engine; as nested column expressions it takes some twenty
times as long as in numpy, so the splitting is done in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept, shipped
from .draws import BLOCK_BITS, RUNS, to_blocks, to_rows

#: Rows that one task numbers, about.
NUMBERED = 50_000
#: Replicates whose draws one task splits together, and rows of a stratum from which it
#: takes one alone.
TOGETHER, MANY = 64, 10_000_000
#: The column that stored replicates are partitioned by.
FOLDER = "stratum_key"


def _stratum(columns: Sequence[str]) -> Column:
    """One string a stratum; a null is a stratum of its own."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]
    return F.concat_ws("\u0001", *parts) if parts else F.lit("")


def _met(one: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join of two sides with a row a row of the table. Their arrays are much larger than
    Spark's estimate, which knows the file alone, so neither may be broadcast."""
    return one.join(other.hint("merge"), on, how)


def _number(text: Column, digits: int) -> Column:
    """The first hexadecimal digits of a text's md5 as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def _key(id_col: str) -> Column:
    return F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def placed(df: DataFrame, id_col: str, strata: Sequence[str], *more: Column) -> DataFrame:
    """(id, stratum, place, ...): rows numbered from 0 within strata, in the order of their
    ids' md5, then of ids. Ranges of the md5 are numbered apart, as many as rows need,
    and shifted by the counts of those before, so a stratum of any size is spread."""
    rows = df.select(F.col(id_col).alias("id"), _stratum(strata).alias("stratum"), _key(id_col).alias("key"), *more)
    digits = 2
    total = df.count()
    while 16**digits * NUMBERED < total:
        digits += 1
    rows = rows.withColumn("range", F.substring("key", 1, digits))
    sizes = rows.groupBy("stratum", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("stratum").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("stratum", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = F.row_number().over(Window.partitionBy("stratum", "range").orderBy("key", "id")) - 1
    numbered = rows.withColumn("own", own).join(shifts, ["stratum", "range"])
    return numbered.withColumn("place", F.col("own") + F.col("shift")).drop("key", "range", "own", "shift")


def _blocks(df: DataFrame, strata: Sequence[str], first: int, last: int, seed: int) -> DataFrame:
    """(stratum, h, low, bits, c) of each block, c an array over the replicates."""
    sizes = df.groupBy(_stratum(strata).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    step = F.when(F.col("n") >= MANY, F.lit(1)).otherwise(TOGETHER).cast("long")
    b = F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"), step))
    begun = sizes.select("stratum", _number(F.col("stratum"), 7).alias("s"), "n", b.alias("b"))
    last_b = F.least(F.lit(last).cast("long"), F.when(F.col("n") >= MANY, F.col("b")).otherwise(F.col("b") + TOGETHER - 1))
    work = begun.select("stratum", _seeded(F.col("s"), seed).alias("h"), "n", "b", last_b.alias("last")).repartition("stratum", "b")
    arrays = F.flatten(F.array_sort(F.collect_list(F.struct("b", "c")))["c"])
    return work.mapInArrow(to_blocks, RUNS).groupBy("stratum", "h", "low", "bits").agg(arrays.alias("c"))


def _seeded(s: Column, seed: int) -> Column:
    """``draws.hashed`` of a stratum's number and the seed, as a column."""
    x = (s + F.lit(seed % 2**32).cast("long") * 1640531527 % 2**32) % 2**32 * 73244475 % 2**32
    y = x.bitwiseXOR(F.shiftright(x, 15)) * 1540483477 % 2**32
    return y.bitwiseXOR(F.shiftright(y, 16))


def drawn(df: DataFrame, id_col: str, strata: Sequence[str], first: int, last: int, seed: int, value: Column | None = None) -> DataFrame:
    """(id, stratum, value, draws): how often each row is drawn, an array over replicates
    first..last. Rows and counts meet by blocks, and the array is made where the row is."""
    shipped(df.sparkSession)
    value = F.lit(None).cast("double") if value is None else value
    rows = placed(df, id_col, strata, value.alias("value"))
    block = F.shiftright("place", BLOCK_BITS).alias("block")
    held = rows.groupBy("stratum", block).agg(F.array_sort(F.collect_list(F.struct("place", "id", "value"))).alias("rows"))
    begin = (F.col("low") - F.shiftleft(F.shiftright("low", BLOCK_BITS), BLOCK_BITS) + 1).cast("int")
    size = F.call_function("shiftleft", F.lit(1), F.col("bits"))
    met = _blocks(df, strata, first, last, seed).withColumn("block", F.shiftright("low", BLOCK_BITS))
    met = _met(met, held, ["stratum", "block"]).select("stratum", "h", "low", "bits", "c", F.slice("rows", begin, size).alias("rows"))
    kind = df.schema[id_col].dataType.simpleString()
    return met.mapInArrow(to_rows(first), f"id {kind}, stratum string, value double, draws array<int>")


def counts(df: DataFrame, id_col: str, strata: Sequence[str] = (), first: int = 1, last: int = 500, seed: int = 1) -> DataFrame:
    """BSW-01/03: (id, stratum, b, draws) for replicates first..last, where draws > 0."""
    each = drawn(df, id_col, strata, first, last, seed).select("id", "stratum", F.posexplode("draws").alias("at", "draws"))
    return each.filter("draws > 0").select("id", "stratum", (F.col("at") + first).alias("b"), "draws")


def replicate_weights(df: DataFrame, weight: str, id_col: str, strata: Sequence[str] = (), replicates: int = 500, seed: int = 1, first: int = 1) -> DataFrame:
    """(id, stratum, weights): an array of replicates first..first+n-1 for each row.

    A null weight counts as zero (BSW-02).
    """
    value = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    rows = drawn(df, id_col, strata, first, first + replicates - 1, seed, value)
    return rows.select("id", "stratum", F.transform("draws", lambda n: n * F.col("value")).alias("weights"))


def stale_strata(stored: DataFrame, df: DataFrame, id_col: str, strata: Sequence[str]) -> DataFrame:
    """(stratum) of the strata whose ids are no longer those of the stored replicates."""
    now = df.select(F.col(id_col).alias("id"), _stratum(strata).alias("stratum"))
    was = stored.select("id", "stratum")
    gone, new = _met(was, now, ["id", "stratum"], "left_anti"), _met(now, was, ["id", "stratum"], "left_anti")
    return gone.unionByName(new).select("stratum").distinct()


def _filed(replicated: DataFrame) -> DataFrame:
    """With the folder that a stratum's rows are stored in: any text is a good stratum, so
    the folder has its hash."""
    return replicated.withColumn(FOLDER, F.substring(F.md5(F.col("stratum").cast("binary")), 1, 16))


def _write(replicated: DataFrame, path: str, mode: str) -> None:
    # A small stratum is one file; one that is too large for a task is split as it runs.
    _filed(replicated).hint("rebalance", FOLDER).write.option("partitionOverwriteMode", mode).mode("overwrite").partitionBy(FOLDER).parquet(path)


def update_stored(path: str, df: DataFrame, weight: str, id_col: str, strata: Sequence[str], replicates: int, seed: int = 1, overwrite: bool = False) -> DataFrame:
    """SNK-07, BSW-06..10: brings the replicates stored under ``path`` up to the table.

    They are filed by stratum. Strata whose ids changed are written anew, and
    those without rows left go; the files of all others stay as they are. Only
    where more replicates are asked for than there are, all files are replaced, by
    a folder that takes the old one's place once it is whole. Gives what is
    stored then, which can be more replicates than asked for.
    """
    spark = df.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if overwrite or not fs.exists(fs_path(path)):
        whole = replicate_weights(df, weight, id_col, strata, replicates, seed)
    else:
        stored = spark.read.parquet(path)
        have = stored.select(F.max(F.size("weights"))).first()[0] or 0
        whole = extended(stored.drop(FOLDER), df, weight, id_col, strata, replicates, seed) if replicates > have or FOLDER not in stored.columns else None
        if whole is None:
            stale = kept(stale_strata(stored, df, id_col, strata), "stale")
            base = df.withColumn("_stratum", _stratum(strata))
            again = base.join(stale.withColumnRenamed("stratum", "_stratum"), "_stratum", "left_semi").drop("_stratum")
            left = again.select(_stratum(strata).alias("stratum")).distinct()
            gone = [r[0] for r in _filed(stale.join(left, "stratum", "left_anti")).select(FOLDER).toLocalIterator()]
            if not left.isEmpty():
                _write(replicate_weights(again, weight, id_col, strata, have, seed), path, "dynamic")
            for folder in gone:
                fs.delete(fs_path(f"{path}/{FOLDER}={folder}"), True)
    if whole is not None:
        _write(whole, f"{path}.new", "static")
        fs.delete(fs_path(path), True)
        fs.rename(fs_path(f"{path}.new"), fs_path(path))
    return spark.read.parquet(path)


def extended(stored: DataFrame, df: DataFrame, weight: str, id_col: str, strata: Sequence[str], replicates: int, seed: int = 1) -> DataFrame:
    """BSW-06..09: brings stored replicates up to the table and the number asked for.

    Fewer replicates than stored are a slice; strata whose ids changed are made
    anew (without strata, all); others keep theirs and get the missing ones.
    """
    have = stored.select(F.max(F.size("weights"))).first()[0] or 0
    stale = kept(stale_strata(stored, df, id_col, strata), "stale")
    old = stored.join(stale, "stratum", "left_anti")
    if replicates <= have:
        old = old.withColumn("weights", F.slice("weights", 1, replicates))
    base = df.withColumn("_stratum", _stratum(strata))
    again = base.join(stale.withColumnRenamed("stratum", "_stratum"), "_stratum", "left_semi").drop("_stratum")
    made = replicate_weights(again, weight, id_col, strata, replicates, seed)
    if replicates > have:
        more = replicate_weights(df, weight, id_col, strata, replicates - have, seed, first=have + 1)
        old = _met(old, more.select("id", F.col("weights").alias("_more")), ["id"]).select("id", "stratum", F.concat("weights", "_more").alias("weights"))
    return old.unionByName(made)


def wide(replicated: DataFrame, replicates: int, prefix: str = "CPBSW") -> DataFrame:
    """The array as columns prefix1..prefixN, for those who ask for them."""
    return replicated.select("id", *[F.get("weights", i).alias(f"{prefix}{i + 1}") for i in range(replicates)])


def attach(df: DataFrame, replicated: DataFrame, id_col: str) -> DataFrame:
    """JOIN-02: the table with its replicate weights; rows without are left out."""
    return _met(df, replicated.select(F.col("id").alias(id_col), "weights"), [id_col])


def table_name(weight: str) -> str:
    return f"pumf_bsw_{weight.lower()}"


def view_name(table: str, weight: str) -> str:
    return f"{table}_bsw_{weight.lower()}"
