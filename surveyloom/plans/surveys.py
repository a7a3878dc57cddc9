"""From a survey key to a table: archive, metadata, coded store, labelled read."""

from __future__ import annotations

import re
import shutil
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Metadata, read_metadata, write_metadata
from ..operators import bootstrap
from ..operators.columns import coded_name, relabel, with_row_id
from ..sources import detect, files, raw
from ..sources.download import NetworkError, located
from ..sources.parsers import sas, spss
from . import build, catalogue, crawl
from .lfs import LabourForce
from .registry import Entry, Registry, resolve_version

LANGUAGES = ("eng", "fra")
#: Bytes of replicate weights from which a warning tells their size.
MANY_BYTES = 2_000_000_000
#: The number that a table without an id gets, and what its stored copy's name ends in.
ROW_ID, NUMBERED = "row_id", "_rows"


def safe_name(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]", "_", text)


@dataclass(frozen=True)
class SurveyTable:
    """A table with what it came from; ``df`` may be filtered at will, since
    estimates that need the whole table go back to ``surveys``."""

    df: DataFrame
    series: str
    version: str
    lang: str
    module: str
    surveys: Surveys = field(repr=False)

    def with_df(self, df: DataFrame) -> SurveyTable:
        return SurveyTable(df, self.series, self.version, self.lang, self.module, self.surveys)

    def metadata(self) -> Metadata:
        return self.surveys.metadata(self.series, self.version, self.module)

    def labels(self) -> list[tuple[str, str | None, str | None]]:
        """PRJ-02: name and both labels of each variable."""
        return [(v.name, v.label_en, v.label_fr) for v in self.metadata().variables]

    def relabelled(self) -> SurveyTable:
        return self.with_df(relabel(self.df, self.metadata(), self.lang))

    def sibling(self, module: str) -> SurveyTable:
        """API-03: another module of the same survey and version."""
        return self.surveys.open(self.series, self.version, self.lang, module)


class Surveys:
    """Surveys under one cache folder: ``series/version/`` with the raw files,
    ``metadata/`` and ``tables/`` (Parquet, one a module).

    ``collection`` (Acronym, Version, url) tells where archives can be fetched,
    and ``curated``, of the same columns, where it does not.
    """

    def __init__(self, spark: SparkSession, cache: str, registry: Registry | None = None, collection: DataFrame | None = None, curated: DataFrame | None = None):
        self.spark, self.cache, self.registry = spark, cache.rstrip("/"), registry or Registry()
        self.collection, self.curated = collection if collection is not None else curated, curated
        self._announced: set[tuple[str, str]] = set()

    def folder(self, series: str, version: str) -> Path:
        return Path(self.cache, safe_name(series), safe_name(version))

    def _metadata_folder(self, series: str, version: str, module: str) -> Path:
        return self.folder(series, version) / "metadata" / safe_name(module)

    def metadata(self, series: str, version: str, module: str = "") -> Metadata:
        """API-05/PAR-21: parsed once, then read from the canonical files."""
        at = self._metadata_folder(series, version, module)
        if not (at / "variables.csv").exists():
            e = self._entry(series, version, module)
            english = detect.read_text(Path(e.english_commands), e.metadata_encoding) if e.english_commands else None
            for told in write_metadata(detect.parse(str(self.folder(series, version)), e.layout_mask, e.metadata_encoding, english).upper(), str(at)):
                warnings.warn(f"{series} {version}: {told}", stacklevel=2)
        return read_metadata(str(at))

    def _entry(self, series: str, version: str, module: str) -> Entry:
        tables = self.registry.modules(series, version)
        for t in tables:
            if t.name == module or not module and t.primary:
                return t.entry
        raise ValueError(f"{series} {version} has no module {module!r}: {', '.join(t.name for t in tables)}")

    def table_path(self, series: str, version: str, module: str = "") -> str:
        return str(self.folder(series, version) / "tables" / (safe_name(module) or "main"))

    def prepare(self, series: str, version: str) -> None:
        """SRC-14: extracts archives that lie in the version's folder, once."""
        for z in self.folder(series, version).glob("*.zip"):
            into = z.with_suffix("")
            if not into.exists():
                files.unzip(str(z), str(into))

    def build(self, series: str, version: str, module: str = "", refresh: bool = False) -> str:
        """MOD-02/SNK-01: writes the coded table of one module, unless it is there."""
        path = Path(self.table_path(series, version, module))
        if path.exists() and not refresh:
            return str(path)
        self.prepare(series, version)
        e = self._entry(series, version, module)
        if refresh:
            shutil.rmtree(self._metadata_folder(series, version, module), ignore_errors=True)
        m = self.metadata(series, version, module)
        root = str(self.folder(series, version))
        try:
            data = files.find_data_file(root, e.file_mask, m.layout is not None, e.bsw_file_mask)
        except FileNotFoundError:
            data = files.find_data_file(root, e.file_mask, m.layout is None, e.bsw_file_mask)
        if m.layout is not None and not data.lower().endswith(".csv"):
            rows = raw.read_fixed_width(self.spark, data, m.layout, e.data_encoding)
        else:
            rows = raw.drop_junk(raw.read_delimited(self.spark, data, e.data_encoding))
        if e.bsw_file_mask and e.bsw_join_key and (shipped := self._shipped_weights(root, e)) is not None:
            weights = raw.numeric_except(shipped, [e.bsw_join_key])
            coded = build.with_shipped_weights(build.typed(rows, m, e.fixups, None), weights, e.bsw_join_key, e.bsw_drop)
        else:
            coded = build.typed(rows, m, e.fixups, None)
        coded.write.mode("overwrite").parquet(str(path))
        shutil.rmtree(f"{path}{NUMBERED}", ignore_errors=True)  # numbers of rows that were
        for told in build.label_warnings(self.spark.read.parquet(str(path)), m, e.fixups):
            warnings.warn(f"{series} {version}: {told}", stacklevel=2)
        return str(path)

    def _shipped_weights(self, root: str, e: Entry) -> DataFrame | None:
        """SRC-07: the replicate-weight file, delimited or fixed-width; the layout is
        that of its own command files, else of a ``layout`` text beside it."""
        found = [p for p in sorted(Path(root).rglob("*")) if p.is_file() and re.search(e.bsw_file_mask, p.name, re.I) and "layout" not in p.name.lower()]
        if not found:
            return None
        path = found[0]
        if path.suffix.lower() == ".csv":
            return raw.read_delimited(self.spark, str(path), e.data_encoding)
        layout = None
        if e.bsw_mask:
            text = detect.detect(root, f"(?i){e.bsw_mask}", e.metadata_encoding).get("spss_split", {}).get("layout")
            layout = text and spss.layout_of(text)
        if not layout:
            beside = next((p for p in sorted(path.parent.glob("*")) if p.name.lower().startswith("layout") and p.suffix.lower() == ".txt"), None)
            layout = beside and sas.at_layout(detect.read_text(beside, e.metadata_encoding))[0]
        return raw.read_fixed_width(self.spark, str(path), layout, e.data_encoding) if layout else None

    def open(self, series: str, version: str, lang: str = "eng", module: str = "", refresh: bool = False) -> SurveyTable:
        """API-01: the labelled table, built first where need be."""
        if lang not in LANGUAGES:
            raise ValueError(f"lang {lang!r} is neither eng nor fra")
        path = self.build(series, version, module, refresh)
        e, m = self._entry(series, version, module), self.metadata(series, version, module)
        df = build.labelled(self.spark.read.parquet(path), m, e.fixups, lang)
        return SurveyTable(df, series, version, lang, module, self)

    # -- the way in ---------------------------------------------------------------------

    def versions(self, series: str) -> list[str]:
        """SET-05: versions in the registry, the collection and the cache."""
        found = dict.fromkeys(self.registry.versions(series))
        if self.collection is not None:
            found |= dict.fromkeys(r[0] for r in self.collection.filter(F.col("Acronym") == series).select("Version").distinct().collect())
        safe = {safe_name(v) for v in found}
        return [*found, *sorted(p.name for p in Path(self.cache, safe_name(series)).glob("*") if p.is_dir() and p.name not in safe and not p.name.startswith("."))]

    def resolve(self, series: str, version: str | None) -> str:
        """REG-05: an alias to its version; none given stands for the only one there is."""
        known = self.versions(series)
        if version is not None:
            return resolve_version(series, version, known)
        if not known:
            raise ValueError(f"unknown series {series!r}")
        if len(known) > 1:
            raise ValueError(f"{series} has several versions: {', '.join(known)}")
        return known[0]

    def with_catalogue(self, pages: DataFrame, roots: Sequence[str] | DataFrame, days: int = 180, refresh: bool = False) -> Surveys:
        """CAT-01, CAT-03: these surveys with the addresses that the catalogue's pages (url,
        html) lead to. What the crawl found is stored under the cache folder and read
        again for ``days``; the collection given before stands behind it."""
        rows = crawl.snapshot(self.spark, str(Path(self.cache, "catalogue")), lambda: crawl.survey_catalogue(pages, roots), days, refresh)
        found = catalogue.collection(rows.filter(F.col("url") != crawl.NO_DOWNLOAD))
        both = found if self.collection is None else catalogue.joined_collections(found, self.collection)
        return Surveys(self.spark, self.cache, self.registry, both, self.curated)

    def address(self, series: str, version: str) -> str | None:
        """CAT-05: where the version's archive is, if that is known."""
        if self.collection is None:
            return None
        hit = catalogue.resolved(self.collection, self.curated if self.curated is not None else self.collection, series, version).first()
        return hit["url"] if hit else None

    def tables(self, series: str, version: str) -> list[str]:
        """API-02: names of the tables that are built, replicate weights included."""
        return sorted(p.name for p in (self.folder(series, version) / "tables").glob("*") if p.is_dir() and not p.name.endswith(NUMBERED))

    def get(
        self, series: str, version: str | None = None, lang: str = "eng", refresh: bool | str = False,
        redownload: bool = False, module: str = "", registry: dict | None = None,
    ) -> SurveyTable | DataFrame | None:
        """API-01/09/10: the table of a survey, fetched and built where need be.

        The version may be an alias. ``refresh`` builds it again, ``redownload`` fetches
        it again too, and ``registry`` has fields that replace the registry's for this
        table. Without a network there is a warning, and None. The labour force survey
        has one table of all versions: it takes neither module nor registry, no version
        stands for all, and ``refresh="auto"`` loads what lies in the cache.
        """
        if not series:
            raise ValueError("a series must be given")
        if lang not in LANGUAGES:
            raise ValueError(f"lang {lang!r} is neither eng nor fra")
        if refresh not in (False, True, "auto"):
            raise ValueError("refresh is False, True or 'auto'")
        if series == "LFS":
            if module or registry:
                raise ValueError("LFS has one shared table: neither module nor registry applies")
            if redownload and refresh == "auto":
                raise ValueError("redownload does not go with refresh='auto'")
            return self._warned(lambda: self._labour_force(version, lang, refresh, redownload))
        if refresh == "auto":
            raise ValueError("refresh='auto' is for LFS only")
        version = self.resolve(series, version)
        again = bool(refresh or redownload)
        at = self
        if registry:
            at = Surveys(self.spark, self.cache, self.registry.overridden(**registry), self.collection, self.curated)
            if not again and Path(self.table_path(series, version, module)).exists():
                warnings.warn(f"{series} {version} is built already: registry fields apply with refresh=True", stacklevel=2)
        found = self._warned(lambda: self._fetched(at, series, version, redownload))
        if found is None:
            return None
        table = at.open(series, version, lang, module, again)
        self._announce(series, version, module)
        return table

    def _fetched(self, at: Surveys, series: str, version: str, redownload: bool) -> str:
        folder = at.folder(series, version)
        there = any(p.is_file() for p in folder.rglob("*")) and not redownload
        return located(str(folder), None if there else self.address(series, version), redownload=redownload)

    @staticmethod
    def _warned(what):
        try:
            return what()
        except NetworkError as e:
            warnings.warn(str(e), stacklevel=3)
            return None

    def _labour_force(self, version: str | None, lang: str, refresh: bool | str, redownload: bool) -> DataFrame:
        root = Path(self.cache, "LFS")
        lfs = LabourForce(self.spark, str(root))
        if refresh == "auto":
            here = sorted(p.name for p in root.glob("*") if re.fullmatch(r"\d{4}(-\d{2})?", p.name))
            for v, why in lfs.refresh(here).items():
                warnings.warn(f"LFS {v}: {why}", stacklevel=4)
        elif version is not None:
            have = lfs.store.versions()
            if refresh or redownload or version not in have and version[:4] not in have:
                self._fetched(self, "LFS", version, redownload)
                lfs.load(version, bool(refresh or redownload))
        return lfs.open(version, lang)

    def _announce(self, series: str, version: str, module: str) -> None:
        """API-04: once a version, which other modules it has and what they join on."""
        tables = self.registry.modules(series, version)
        if len(tables) < 2 or (series, version) in self._announced:
            return
        self._announced.add((series, version))
        mine = module or tables[0].name
        others = ", ".join(t.name for t in tables if t.name != mine)
        warnings.warn(f"{series} {version} also has {others}, joined on {self.registry.lookup(series, version).module_key}", stacklevel=3)

    # -- replicate weights ------------------------------------------------------------

    def _weights_path(self, t: SurveyTable, weight: str) -> str:
        return f"{self.table_path(t.series, t.version, t.module)}_{bootstrap.table_name(weight)}"

    def numbered(self, t: SurveyTable) -> DataFrame:
        """BSW-05, DML-08: the coded table with a number for each row, stored beside it on
        first use and dropped with its last replicates."""
        path = self.table_path(t.series, t.version, t.module)
        if not Path(f"{path}{NUMBERED}").exists():
            whole = self.spark.read.parquet(path)
            with_row_id(whole, whole.columns, ROW_ID).write.mode("overwrite").parquet(f"{path}{NUMBERED}.new")
            Path(f"{path}{NUMBERED}.new").rename(f"{path}{NUMBERED}")
        return self.spark.read.parquet(f"{path}{NUMBERED}")

    def _with_numbers(self, t: SurveyTable, numbered: DataFrame) -> DataFrame:
        """The rows that ``t`` has left, with their numbers. A filter keeps or drops equal
        rows alike, so its rows are known by their columns."""
        e, m = self._entry(t.series, t.version, t.module), self.metadata(t.series, t.version, t.module)
        mine = t.with_df(build.labelled(numbered, m, e.fixups, t.lang))
        for df in (mine.df, mine.relabelled().df):
            if [c for c in df.columns if c != ROW_ID] == t.df.columns:
                left = t.df.distinct().toDF(*[f"{c} left" for c in t.df.columns])
                same = [df[f"`{c}`"].eqNullSafe(left[f"`{c} left`"]) for c in t.df.columns]
                return df.join(left, same, "left_semi")
        raise ValueError("the table has no id: take its replicates before its columns are changed")

    def bootstrap_weights(self, t: SurveyTable, weight: str, id_col: str | None = None, strata: list[str] | None = None, replicates: int = 500, seed: int = 1, overwrite: bool = False) -> SurveyTable:
        """BSW-04..14: the table with its replicate weights, made or brought up to date.

        Resampling covers the whole stored table, whatever rows ``t`` has left;
        columns may be given by label; strata default to the registry's.
        """
        e, m = self._entry(t.series, t.version, t.module), self.metadata(t.series, t.version, t.module)
        whole = self.spark.read.parquet(self.table_path(t.series, t.version, t.module))
        if not (id_col or e.bsw_join_key):
            id_col = ROW_ID
        if id_col == ROW_ID and ROW_ID not in whole.columns:
            whole = self.numbered(t)
            t = t if ROW_ID in t.df.columns else t.with_df(self._with_numbers(t, whole))
        named = lambda c: coded_name(whole.columns, m, c, t.lang)
        weight, id_col = named(weight), named(id_col or e.bsw_join_key)
        strata = [named(c) for c in (e.bsw_strata if strata is None else strata)]
        path = self._weights_path(t, weight)
        if without := whole.filter(F.col(f"`{weight}`").isNull()).count():  # BSW-02
            warnings.warn(f"{without} rows have no {weight}: their replicates are zero", stacklevel=2)
        if (size := whole.count() * replicates * 8) > MANY_BYTES:  # BSW-18
            warnings.warn(f"{replicates} replicates of {weight} take {size / 1e9:.1f} GB", stacklevel=2)
        stored = bootstrap.update_stored(path, whole, weight, id_col, strata, replicates, seed, overwrite).withColumn("weights", F.slice("weights", 1, replicates))
        label = next((c for c in t.df.columns if c == id_col or c == relabel(whole.select(id_col), m, t.lang).columns[0]), id_col)
        return t.with_df(bootstrap.attach(t.df, stored, label))

    def bootstrap_info(self, series: str, version: str) -> list[dict]:
        """BSW-16: the stored replicate tables with their sizes in bytes."""
        out = []
        for p in sorted((self.folder(series, version) / "tables").glob(f"*_{bootstrap.table_name('')}*")):
            df = self.spark.read.parquet(str(p))
            weight = p.name.split(bootstrap.table_name(""), 1)[1]
            out.append({"weight": weight, "table": p.name, "replicates": df.select(F.max(F.size("weights"))).first()[0], "bytes": size_of(p)})
        return out

    def remove_bootstrap(self, series: str, version: str, weight: str | None = None) -> int:
        """BSW-17: removes one weight's replicates or all; how many tables went."""
        tail = bootstrap.table_name(weight or "") + ("" if weight else "*")
        tables = self.folder(series, version) / "tables"
        gone = list(tables.glob(f"*_{tail}"))
        for p in gone:
            shutil.rmtree(p)
        for p in tables.glob(f"*{NUMBERED}"):  # row numbers go with the last replicates
            if not list(tables.glob(f"{p.name.removesuffix(NUMBERED)}_{bootstrap.table_name('')}*")):
                shutil.rmtree(p)
        return len(gone)

    # -- the cache ------------------------------------------------------------------

    def listing(self) -> list[dict]:
        """CAH-01: one row a version: what it has, and bytes of raw files and tables."""
        out = []
        for v in sorted(p for p in Path(self.cache).glob("*/*") if p.is_dir()):
            own = sum(size_of(v / x) for x in ("metadata", "tables"))
            out.append({"series": v.parent.name, "version": v.name, "has_raw": size_of(v) > own, "has_metadata": (v / "metadata").exists(), "has_tables": (v / "tables").exists(), "raw_bytes": size_of(v) - own, "table_bytes": size_of(v / "tables")})
        return out

    def remove(self, series: str, version: str, keep_raw: bool = False) -> None:
        """CAH-02"""
        folder = self.folder(series, version)
        for p in [folder / "metadata", folder / "tables"] if keep_raw else [folder]:
            shutil.rmtree(p, ignore_errors=True)


def size_of(path: Path) -> int:
    return sum(p.stat().st_size for p in path.rglob("*") if p.is_file()) if path.exists() else 0
