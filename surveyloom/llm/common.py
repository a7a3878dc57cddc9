"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_surveyloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    name = Path(tempfile.mkdtemp(prefix="surveyloom-")) / "surveyloom-package.zip"
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(name))
    sc._surveyloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Without that setting a local session (as in tests) uses a temporary folder; a
    cluster has no folder of its own that all share, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="surveyloom-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores at its end as no column has, in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage with a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame, rows_a_part: int = 20_000) -> DataFrame:
    """``cut``, then read in as few partitions as its rows need, so that what is small
    isn't dealt from thousands of tasks to thousands."""
    out = cut(df)
    return out.coalesce(1 + out.count() // rows_a_part)


def written(df: DataFrame, name: str) -> DataFrame:
    """Ends the lineage with a compressed table in the shared folder.

    Smaller on disk than a checkpoint, so it suits wide rows; columns are read
    back as needed. The table goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


#: A key is heavy if it has more rows than this share of all, so few keys are.
HEAVY_SHARE = 1e-4
HEAVY_LEAST = 100


HEAVY_BYTES = 64_000_000


def merged(one: DataFrame, other: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two sides that grow with the input, by sort and merge. Spark estimates
    what comes out of explosions, windows and arrays far too small, and would send
    such a side through the driver as a broadcast."""
    return one.join(other.hint("merge"), on, how)


def looked_up(rows: DataFrame, few: DataFrame, on, how: str = "inner") -> DataFrame:
    """``merged`` where ``few`` is the smaller side and has few rows a key: both are dealt by
    key, and a task holds its share of ``few`` in a table, so that ``rows`` isn't sorted."""
    return rows.join(few.hint("shuffle_hash"), on, how)


def meet(rows: DataFrame, facts: DataFrame, key: str | list[str], total: int, size: str | None = None, dealt=merged) -> DataFrame:
    """``rows`` joined (inner) with ``facts``, which has one row a key and, as ``n``, how
    many rows of the key there are, ``total`` in all.

    Heavy keys, at most 1 / HEAVY_SHARE of them, are broadcast, so that their rows
    stay where they are; the others are dealt by key, and joined by ``dealt``. A string column ``size`` of
    the facts is held to HEAVY_BYTES first; beyond that all are dealt by key.
    Both sides are read more than once and should be written before.
    """
    most = max(HEAVY_LEAST, int(total * HEAVY_SHARE))
    keys = [key] if isinstance(key, str) else key
    heavy, light = facts.filter(F.col("n") > most).drop("n"), facts.filter(F.col("n") <= most).drop("n")
    held = heavy.agg(F.count(F.lit(1)), F.sum(F.length(size)) if size else F.lit(0)).first()
    if not held[0] or 4 * (held[1] or 0) > HEAVY_BYTES:
        return dealt(rows, facts.drop("n"), keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(heavy), keys).unionByName(dealt(rest, light, keys))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of `[^\\x20\\x09-\\x0D]+`, as UTF-8.

    ``bytes.split`` cuts at exactly those six ASCII characters.
    """
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(text: str | None, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """``words_of`` in lists of about ``size`` bytes of text each, so that a very long
    text's words are never all held; a text of less is one list."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            cut_at = SPACE.search(data, end)
            end = cut_at.start() if cut_at else len(data)
        yield data[at:end].split() if at or end < len(data) else data.split()
        at = end


#: What frees a module's caches in a Python worker, by module.
HELD: dict[str, Callable[[], None]] = {}


def free_caches(keep: str = "") -> None:
    """Workers serve one operator after another: frees what others have cached."""
    for name, free in HELD.items():
        if name != keep:
            free()
    gc.collect()
    # What Python has freed goes back to the system, not to the worker's reserve.
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def broadcast_value(spark: SparkSession, value, size: int, bound: int, what: str) -> Broadcast:
    """Broadcasts a value only if its size, in bytes, is within the bound."""
    if size > bound:
        raise ValueError(f"{what}: {size} bytes, over the bound of {bound} for a broadcast")
    return spark.sparkContext.broadcast(value)


def arrow_slices(batches: Iterable[pa.RecordBatch], size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows of about ``size`` bytes on average.

    Keeps a worker's memory bounded when texts are long.
    """
    for whole in batches:
        step = max(1, min(max(1, whole.num_rows), size * whole.num_rows // max(1, whole.nbytes)))
        for at in range(0, whole.num_rows, step):
            yield whole.slice(at, step)


def sampled(rows: DataFrame, wanted: int, margin: float = 1.3) -> DataFrame:
    """Of rows (id: string, ...) about ``wanted`` ids' rows, by a threshold on the id's hash.

    The number of different ids sets the threshold, so what passes keeps its
    size however many rows there are. With ``wanted`` ids or fewer, all pass.
    """
    n = rows.agg(F.approx_count_distinct("id", 0.02)).first()[0]
    if n <= wanted:
        return rows
    of = 1_000_000_000
    return rows.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(of)) < int(of * min(1.0, margin * wanted / n)))
