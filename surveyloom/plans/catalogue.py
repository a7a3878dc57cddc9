"""The catalogue of downloads: one row a file, and the one to take for each version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators.columns import first_by

# Formats by preference, with what tells them in a name.
FORMATS = {"CSV": "CSV", "SPSS": "SPSS", "SAS": "SAS", "Stata": "STATA", "TXT": "TXT"}


def detected_format(name, label=None):
    """STR-09: by the file's name, else by the link's text."""
    at = lambda c: F.coalesce(*[F.when(F.contains(F.upper(c), F.lit(mark)), F.lit(kind)) for kind, mark in FORMATS.items()])
    return at(name) if label is None else F.coalesce(at(name), at(label))


def detected_edition(name, label, url):
    """STR-09: a census year and kind, else the longer period in name or text, else the
    folder before the file."""
    period = lambda c: F.nullif(F.regexp_extract(c, r"(\d{4}(?:-\d{2,4})?)", 1), F.lit(""))
    a, b = period(name), period(label)
    named = F.when(F.length(b) > F.coalesce(F.length(a), F.lit(0)), b).otherwise(a)
    folder = F.split_part(url, F.lit("/"), F.lit(-2))
    by_folder = F.when(folder.rlike(r"^\d{4}(-\d{2,4})?$"), folder).when(folder.rlike(r"^\d{7}$"), F.substring(folder, 1, 4))
    return F.coalesce(text.census_edition(url), named, by_folder)


def collection(catalogue: DataFrame, supported: Sequence[str] | None = None, prefer: Sequence[str] = tuple(FORMATS)) -> DataFrame:
    """CAT-04: one row a series and version, of the preferred format (ties by url).

    Surveys of the GSS are told apart by cycle, CPSS and CCAHS by the cycle in
    their titles; rows without a version go.
    """
    c = catalogue if supported is None else catalogue.filter(F.col("Acronym").isin(list(supported)))
    version = (
        F.when(F.col("Acronym") == "GSS", text.gss_version(F.col("url"), F.col("edition")))
        .when(F.col("Acronym").isin("CPSS", "CCAHS"), text.cycle_version(F.col("Title"), F.col("edition")))
        .otherwise(F.col("edition"))
    )
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in prefer]), F.col("format")), F.lit(0)), F.lit(len(prefer) + 1))
    kept = first_by(c.withColumn("Version", version).filter("Version is not null"), ["Acronym", "Version"], [rank, F.col("url")])
    return kept.select("Acronym", "Version", text.series_title(F.col("Title")).alias("SeriesTitle"), "Title", "url")


def joined_collections(found: DataFrame, curated: DataFrame) -> DataFrame:
    """CAT-01: what the catalogue gives, and of the curated rows those of series and
    versions that it lacks."""
    more = curated.join(found.select("Acronym", "Version"), ["Acronym", "Version"], "left_anti")
    return found.unionByName(more, allowMissingColumns=True)


def resolved(adapter: DataFrame, curated: DataFrame, series: str, version: str) -> DataFrame:
    """CAT-05: the adapter's row, else the curated one; at most one row."""
    hit = (F.col("Acronym") == series) & (F.col("Version") == version)
    both = adapter.filter(hit).select("Acronym", "Version", "url", F.lit(0).alias("_o")).unionByName(curated.filter(hit).select("Acronym", "Version", "url", F.lit(1).alias("_o")))
    return both.orderBy("_o", "url").limit(1).drop("_o")


def stale(fetched, now, days: int = 180):
    """DAT-02/SNK-09: whether a snapshot is older than so many days."""
    return F.datediff(now, fetched) > days


def editions(catalogue: DataFrame) -> DataFrame:
    """AGG-08: how many editions each catalogue id has; null ones don't count."""
    return catalogue.groupBy("catalogue_id").agg(F.countDistinct("edition").alias("editions"))


def with_categories(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """JOIN-07: scraped rows with what is known of their category (``cat``); rows of an
    unknown one stay. Categories are a page's headings, so few."""
    return rows.join(categories, "cat", "left")


def monthly_versions(pages: DataFrame) -> DataFrame:
    """CAT-02: (Date, version, url) of the archives that pages (html) link to whose
    names carry a year and month, such as 2023-06.zip, or a year."""
    url = pages.select(F.explode(text.links(F.col("html"))).alias("url")).distinct()
    stem = F.element_at(F.split(text.file_name(F.col("url")), r"\.zip"), 1)
    year, month = F.left(stem, F.lit(4)), F.substring(stem, 6, 2)
    dated = F.when(F.length(stem) == 7, F.try_to_date(F.concat(stem, F.lit("-01")), "yyyy-MM-dd"))
    annual = F.when((F.length(stem) == 4) & (F.translate(stem, "0123456789", "") == ""), F.try_to_date(F.concat(year, F.lit("-12-31")), "yyyy-MM-dd"))
    found = url.filter(F.endswith("url", F.lit(".zip"))).select(F.coalesce(dated, annual).alias("Date"), stem.alias("version"), "url")
    return found.filter("Date is not null")
