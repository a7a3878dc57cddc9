"""The accumulating store of a longitudinal survey (LFS-01..08, SNK-06, DML).

One Parquet table, partitioned by year and month, and a version log. An annual
file supersedes the months of its year; a month that its year covers is read
from there. A write first goes to a new folder, then the log names it, so a
failed load leaves the store as it was. Columns may come, and change from int
to double or string: each part is read by its own schema and cast to the union.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = re.compile(r"^(\d{4})(?:-(\d{2}))?$")
#: Types that a column can widen to, in order.
WIDER = ("boolean", "int", "bigint", "double", "string")


def version_parts(version: str) -> tuple[int, int | None]:
    """LFS-01: year and month; the month is null for an annual version."""
    m = VERSION.match(version)
    if not m or (m[2] and not 1 <= int(m[2]) <= 12):
        raise ValueError(f"version {version!r} is neither YYYY nor YYYY-MM")
    return int(m[1]), int(m[2]) if m[2] else None


def wider(a: str, b: str) -> str:
    if a == b:
        return a
    return max(a, b, key=WIDER.index) if a in WIDER and b in WIDER else "string"


def union_schema(frames: list[DataFrame]) -> list[tuple[str, str]]:
    kinds: dict[str, str] = {}
    for f in frames:
        for c, t in f.dtypes:
            kinds[c] = wider(kinds[c], t) if c in kinds else t
    return list(kinds.items())


def evolved_union(frames: list[DataFrame]) -> DataFrame:
    """SNK-06: rows by name, columns of the union of schemas, types widened."""
    kinds = union_schema(frames)
    parts = [f.select(*[(F.col(c).cast(t) if c in f.columns else F.lit(None).cast(t)).alias(c) for c, t in kinds]) for f in frames]
    return reduce(DataFrame.unionAll, parts)


class Conflict(Exception):
    """Another writer has committed meanwhile."""


class Store:
    """Parts and log under one path that driver and executors share.

    The log is one small file a change, numbered without gaps; the last holds all
    parts in force. A writer that finds its number taken starts again from what
    the other has committed, so that of two at once neither is lost.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _children(self, folder: str):
        fs, path = self._fs()
        at = path(f"{self.path}/{folder}")
        return list(fs.listStatus(at)) if fs.exists(at) else []

    def _state(self) -> tuple[int, list[dict]]:
        """The last change's number and the parts in force."""
        numbers = [int(n[1:-5]) for n in (f.getPath().getName() for f in self._children("log")) if re.fullmatch(r"v\d+\.json", n)]
        if not numbers:
            return 0, []
        text = self.spark.read.text(f"{self.path}/log/v{max(numbers):020d}.json", wholetext=True).first()
        return max(numbers), json.loads(text[0])

    def log(self) -> list[dict]:
        return self._state()[1]

    def _commit(self, number: int, parts: list[dict]) -> None:
        """Writes change ``number``; Conflict if there is one of that number.

        The file gets its name once it is whole, by a rename that doesn't replace.
        """
        fs, path = self._fs()
        sc = self.spark.sparkContext
        temporary, final = path(f"{self.path}/tmp/{uuid.uuid4().hex}"), path(f"{self.path}/log/v{number:020d}.json")
        fs.mkdirs(path(f"{self.path}/log"))
        out = fs.create(temporary)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        try:
            context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
            context.rename(fs.makeQualified(temporary), fs.makeQualified(final), sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(temporary, False)
            if fs.exists(final):
                raise Conflict(f"change {number} of {self.path} is there already") from e
            raise

    def _change(self, change, tries: int = 20) -> bool:
        """Commits what ``change`` makes of the parts in force, again and again until no
        other writer was faster; False if it makes None of them."""
        for _ in range(tries):
            number, parts = self._state()
            new = change(parts)
            if new is None:
                return False
            try:
                self._commit(number + 1, new)
                return True
            except Conflict:
                continue
        raise Conflict(f"{tries} changes of other writers came before this one")

    def versions(self) -> list[str]:
        """SRT-01: loaded versions by year, annual before months."""
        return sorted(p["version"] for p in self.log())

    @staticmethod
    def _without(parts: list[dict], version: str) -> list[dict]:
        """Without a month, or without all parts of an annual version's year."""
        year, month = version_parts(version)
        return [p for p in parts if (p["version"] != version if month is not None else version_parts(p["version"])[0] != year)]

    def load(self, version: str, df: DataFrame, refresh: bool = False) -> bool:
        """LFS-03..06: adds a version; False if it (or its year) is there already.

        With ``refresh`` that version alone is replaced; a month that an annual
        version covers is not loaded even then.
        """
        year, month = version_parts(version)

        def there(parts: list[dict]) -> bool:
            annual = any(p["version"] == f"{year}" for p in parts)
            return month is not None and annual or not refresh and any(p["version"] == version for p in parts)

        if there(self.log()):
            return False
        folder = f"{self.path}/data/part={version}-{uuid.uuid4().hex}"
        dated = df.withColumn("SURVYEAR", F.lit(year)).withColumn("SURVMNTH", F.col("SURVMNTH").cast("int") if month is None else F.lit(month))
        dated.write.partitionBy("SURVMNTH").parquet(folder)
        n = self.spark.read.parquet(folder).count()
        part = {"version": version, "folder": folder, "rows": n, "at": time.time(), "schema": dated.schema.jsonValue()}
        loaded = self._change(lambda parts: None if there(parts) else [*self._without(parts, version), part])
        if not loaded:  # another writer has loaded it meanwhile
            fs, path = self._fs()
            fs.delete(path(folder), True)
        return loaded

    def remove(self, version: str) -> None:
        """DML-01/02: an annual version goes with its year, a month alone; ``clean`` then
        takes its files."""
        self._change(lambda parts: self._without(parts, version))

    def clean(self, hours: float = 24.0) -> list[str]:
        """DML-11: deletes folders that no part in force has, old changes but the last, and
        leavings of failed commits, all older than ``hours``, so that neither a
        reader of an earlier state nor a writer at work loses its files. Names go."""
        fs, _ = self._fs()
        number, parts = self._state()
        held = {p["folder"].rsplit("/", 1)[-1] for p in parts} | {f"v{number:020d}.json"}
        gone = []
        for folder in ("data", "log", "tmp"):
            for f in self._children(folder):
                name = f.getPath().getName()
                if name not in held and f.getModificationTime() / 1000 <= time.time() - hours * 3600:
                    fs.delete(f.getPath(), True)
                    gone.append(name)
        return sorted(gone)

    def _scans(self, parts: list[dict]) -> list[DataFrame]:
        """One scan for all parts of a schema, which the log has."""
        by_schema: dict[str, list[str]] = {}
        alone = []
        for p in parts:
            if "schema" in p:
                by_schema.setdefault(json.dumps(p["schema"], sort_keys=True), []).append(p["folder"])
            else:
                alone.append(self.spark.read.parquet(p["folder"]))
        one = lambda schema, folders: self.spark.read.schema(StructType.fromJson(json.loads(schema))).option("basePath", f"{self.path}/data").parquet(*folders).drop("part")
        return alone + [one(s, f) for s, f in by_schema.items()]

    def read(self, version: str | None = None) -> DataFrame:
        """PRJ-08, SNK-06: all rows, or those of a year or month; partitions are pruned.
        Parts of equal schemas are one scan, however many versions there are."""
        parts = self.log()
        year, month = version_parts(version) if version else (None, None)
        wanted = [p for p in parts if year is None or version_parts(p["version"])[0] == year]
        if not wanted:
            raise KeyError(f"nothing loaded for {version or 'any version'}")
        df = evolved_union(self._scans(wanted))
        if year is not None:
            df = df.filter(F.col("SURVYEAR") == year)
        return df.filter(F.col("SURVMNTH") == month) if month is not None else df

    def missing(self, available: list[str]) -> list[str]:
        """LFS-07: available versions that are neither loaded nor covered."""
        have = set(self.versions())
        return [v for v in available if v not in have and v[:4] not in have]


def superseded(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """LFS-04 in DataFrame form: rows (version, year, month, ...) without the months
    of years for which ``versions`` has an annual one."""
    annual = versions.filter(F.col("version").rlike("^[0-9]{4}$")).select(F.col("version").cast("int").alias("year"), F.col("version").alias("_annual")).distinct()
    # Different texts of four digits are 10,000 at most, so these may be broadcast; years are hot as keys.
    marked = rows.join(F.broadcast(annual), "year", "left")
    return marked.filter(F.col("_annual").isNull() | (F.col("version") == F.col("_annual"))).drop("_annual")
