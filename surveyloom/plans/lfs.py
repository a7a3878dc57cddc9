"""The labour force survey: versions built from their files into one store (LFS-02, LFS-03)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Fixups, Metadata
from ..sources import files, raw
from ..sources.detect import read_text
from ..sources.parsers import parse_lfs_codebook
from . import build
from .store import Store, version_parts

#: Columns that stay whole numbers; their codes are not applied.
KEYS = ("SURVYEAR", "SURVMNTH", "REC_NUM")


def build_version(spark: SparkSession, directory: str, metadata: Metadata, lang: str | None = "eng", encoding: str = "CP1252") -> DataFrame:
    """LFS-02: all data files of a version, typed and labelled.

    Annual and monthly files together are an error, as are missing key columns.
    """
    paths = files.lfs_files(directory)
    if not paths:
        raise FileNotFoundError(f"no data file in {directory}")
    kinds = {files.lfs_kind(p) for p in paths} - {"unknown"}
    if len(kinds) > 1:
        raise ValueError(f"annual and monthly files are mixed in {directory}")
    rows = raw.union_files([raw.drop_junk(raw.read_delimited(spark, p, encoding)) for p in paths])
    if missing := {"SURVYEAR", "SURVMNTH"} - set(rows.columns):
        raise ValueError(f"{directory}: no column {', '.join(sorted(missing))}")
    return build.typed(rows, metadata, Fixups(force_integer=KEYS), lang)


class LabourForce:
    """Versions of the survey under a cache folder, accumulated in one coded store."""

    def __init__(self, spark: SparkSession, cache: str):
        self.spark, self.cache = spark, cache.rstrip("/")
        self.store = Store(spark, f"{self.cache}/store")

    def metadata(self, version: str) -> Metadata:
        found = sorted(p for p in Path(self.cache, version).rglob("*.csv") if "codebook" in p.name.lower())
        if not found:
            raise FileNotFoundError(f"no codebook for {version}")
        return parse_lfs_codebook(read_text(found[0], "CP1252")).upper()

    def load(self, version: str, refresh: bool = False) -> bool:
        """LFS-03: adds a version unless it, or its year, is loaded."""
        year, month = version_parts(version)
        df = build_version(self.spark, str(Path(self.cache, version)), self.metadata(version), None).filter(F.col("SURVYEAR") == year)
        return self.store.load(version, df if month is None else df.filter(F.col("SURVMNTH") == month), refresh)

    def refresh(self, available: list[str]) -> dict[str, str]:
        """LFS-07: loads what is neither loaded nor covered; failures by version."""
        failed = {}
        for version in self.store.missing(available):
            try:
                self.load(version)
            except (OSError, ValueError) as e:
                failed[version] = str(e)
        return failed

    def merged_metadata(self) -> Metadata:
        """LFS-09: over all loaded versions, a variable's newest description."""
        variables, codes = {}, {}
        for version in self.store.versions():
            m = self.metadata(version)
            variables |= {v.name: v for v in m.variables}
            codes |= {(c.name, c.val): c for c in m.codes}
        return Metadata(tuple(variables.values()), tuple(codes.values()))

    def open(self, version: str | None = None, lang: str = "eng") -> DataFrame:
        """LFS-05/08: a version's rows, or all, with labels of all loaded codebooks; SEX
        comes right before GENDER, where the first of them is."""
        df = build.labelled(self.store.read(version), self.merged_metadata(), Fixups(force_integer=KEYS), lang)
        pair = [c for c in df.columns if c in ("SEX", "GENDER")]
        if len(pair) < 2:
            return df
        return df.select(*[c for x in df.columns for c in (("SEX", "GENDER") if x == pair[0] else () if x in pair else (x,))])

    def status(self) -> list[dict]:
        return [{"version": p["version"], "rows": p["rows"], "loaded_at": p["at"]} for p in self.store.log()]
