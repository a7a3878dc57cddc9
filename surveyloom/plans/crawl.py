"""Web sites as tables of pages: what is reached from where, and the catalogue in it.

Pages are rows (url, html), fetched ones or a stored snapshot. Links are taken out
and resolved once; then each round joins the newest addresses with their pages'
links and takes off what was seen, so a round's work follows what is new. The
catalogue's three levels (listing, survey pages, product pages) are joins over the
same links.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import kept, shared_folder
from .catalogue import FORMATS, detected_edition, detected_format, stale

ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>"""
#: An address without blanks, control characters or line ends.
PLAIN_ADDRESS = r"^https?://[^\x00-\x20\x7F-\xA0\u2028\u2029]*+\z"
#: What stands in place of an address where a survey's files are not on the site.
NO_DOWNLOAD = "(EFT)"
#: Parts of addresses: fixed values.
SURVEY_MARK, PRODUCT_MARK, PRODUCT_END, ARCHIVE_END = "/catalogue/", "/pub/", "-eng.htm", ".zip"


def anchors(html: Column) -> Column:
    """A page's links, in order: an array of (href, label) as the page has them."""
    return F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("label"))


def _unescaped(text: Column) -> Column:
    return F.trim(F.replace(text, F.lit("&amp;"), F.lit("&")))


def _base(url: Column) -> Column:
    """What of a page's address its links are resolved with."""
    path = F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    scheme, host = F.regexp_extract(url, r"^(https?:)", 1), F.regexp_extract(url, r"^(https?://[^/?#]*)", 1)
    return F.struct(scheme.alias("scheme"), host.alias("host"), path.alias("path"), F.when(folder == "", "/").otherwise(folder).alias("folder"))


def _absolute(base: Column, href: Column) -> Column:
    """The address of a link, on the page of a ``_base``, with its steps still to take."""
    href = F.split_part(href, F.lit("#"), F.lit(1))
    with_path = (
        F.when(F.startswith(href, F.lit("//")), F.concat(base["scheme"], href)).when(F.startswith(href, F.lit("/")), F.concat(base["host"], href))
        .when(F.startswith(href, F.lit("?")), F.concat(base["host"], base["path"], href)).otherwise(F.concat(base["host"], base["folder"], href))
    )
    absolute = F.concat(F.lower(F.split_part(href, F.lit(":"), F.lit(1))), F.substring(href, F.instr(href, ":"), F.length(href)))
    return F.when(href.rlike(r"(?i)^https?://"), absolute).when(href.rlike(r"^[A-Za-z][\w+.-]*:") | (href == ""), F.lit(None)).otherwise(with_path)


def _stepped(full: Column) -> Column:
    """An address after its ``./`` and ``../`` steps; most have none, and are not cut."""
    own, query = F.regexp_extract(full, r"^(https?://[^?]*)", 1), F.regexp_extract(full, r"^[^?]*(\?.*)?$", 1)
    root, rest = F.regexp_extract(own, r"^(https?://[^/]*)", 1), F.regexp_extract(own, r"^https?://[^/]*(.*)$", 1)
    step = lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    walked = F.aggregate(F.split(F.substring(rest, F.lit(2), F.length(rest)), "/"), F.array().cast("array<string>"), step)
    last_is_step = rest.rlike(r"/\.\.?$")
    stepped = F.concat(F.lit("/"), F.array_join(walked, "/"), F.when(last_is_step & (F.size(walked) > 0), "/").otherwise(""))
    as_it_is = ~F.contains(full, F.lit("/.")) & full.rlike(PLAIN_ADDRESS)
    return F.when(as_it_is, full).otherwise(F.concat(root, F.when(rest.rlike(r"/\.\.?(/|$)"), stepped).otherwise(rest), query))


def resolved(base: Column, href: Column) -> Column:
    """The address that a link on the page ``base`` leads to, without its fragment; null
    for other schemes than http, and for links within the page.

    ``./`` and ``../`` steps are taken; a query alone keeps the page's path.
    """
    return _stepped(_absolute(_base(base), href))


def linked(pages: DataFrame) -> DataFrame:
    """(url, at, target, label) of every link of pages (url, html) that leads somewhere;
    labels without tags.

    Done in stages, so that nothing is worked out twice: ``resolved`` as one
    expression repeats its parts in every branch.
    """
    each = pages.filter("url IS NOT NULL").select("url", _base(F.col("url")).alias("base"), "html")  # once a page
    each = each.select("url", "base", F.posexplode(anchors(F.col("html"))).alias("at", "a"))
    each = each.select("url", "at", "base", _unescaped(F.col("a.href")).alias("href"), _unescaped(F.regexp_replace("a.label", "<[^>]*>", "")).alias("label"))
    each = each.select("url", "at", _absolute(F.col("base"), F.col("href")).alias("full"), "label").filter("full IS NOT NULL")
    return each.select("url", "at", _stepped(F.col("full")).alias("target"), "label")


def crawl(pages: DataFrame, seeds: Sequence[str] | DataFrame, most: int | None = None, follow: Callable[[Column], Column] | None = None) -> DataFrame:
    """(url, depth, known): what is reached from the seeds, by the fewest links.

    Depth 0 are the seeds, and ``known`` tells whether the address is among the
    pages. ``follow`` says of an address whether links to it are taken, and
    ``most`` is the last depth. An address counts once, however many pages link to
    it; a round reads the links of the newest pages alone and ends the crawl when
    it finds nothing new.
    """
    spark = pages.sparkSession
    edges = linked(pages).select("url", "target")
    if follow is not None:
        edges = edges.filter(follow(F.col("target")))
    edges = kept(edges.distinct(), "links")
    begun = seeds.toDF("url") if isinstance(seeds, DataFrame) else spark.createDataFrame([(s,) for s in seeds], "url string")
    seen = f"{shared_folder(spark, 'seen')}/rows"
    depth, frontier = 0, begun.distinct()
    while True:
        newest = f"{seen}/depth={depth}"
        frontier.write.parquet(newest)
        frontier = spark.read.schema("url string").parquet(newest)
        if frontier.isEmpty() or depth == most:
            break
        before = spark.read.schema("url string, depth int").parquet(seen)
        frontier = frontier.join(edges, "url").select(F.col("target").alias("url")).distinct().join(before, "url", "left_anti")
        depth += 1
    reached = spark.read.schema("url string, depth int").parquet(seen)
    there = pages.select("url", F.lit(True).alias("known")).distinct()
    return reached.join(there, "url", "left").select("url", "depth", F.coalesce("known", F.lit(False)).alias("known"))


def _first(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def listing(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(catalogue_id, key, Title, survey_url): level 1, the surveys that the root pages
    (url) list; of a survey's several links one to its own page comes first."""
    code = lambda mark: F.nullif(F.regexp_extract("target", mark + r"([0-9A-Za-z-]+)", 1), F.lit(""))
    own, product = code(SURVEY_MARK), code(PRODUCT_MARK)
    rows = links.join(roots, "url", "left_semi").select(F.coalesce(own, product).alias("catalogue_id"), own.isNotNull().alias("own"), F.col("label").alias("Title"), F.col("target").alias("survey_url"), "url", "at")
    rows = rows.filter("catalogue_id IS NOT NULL").withColumn("key", text.normal_id(F.col("catalogue_id")))
    return _first(rows, ["key"], F.desc("own"), F.col("url"), F.col("at")).select("catalogue_id", "key", "Title", "survey_url", "own")


def products(links: DataFrame, surveys: DataFrame) -> DataFrame:
    """(key, product_url): level 2, the product pages of each listed survey.

    A page's product belongs to the survey if its code begins with the survey's. A
    survey whose links all lead to other listed surveys' products has moved there:
    it gets a row with a null product_url.
    """
    code = text.normal_id(F.regexp_extract("product_url", PRODUCT_MARK + "([^/]+)/", 1))
    direct = surveys.filter("NOT own").select("key", F.col("survey_url").alias("product_url"))
    found = surveys.filter("own").join(links.select(F.col("url").alias("survey_url"), F.col("target").alias("product_url")), "survey_url")
    found = found.filter(F.contains("product_url", F.lit(PRODUCT_MARK)) & F.endswith("product_url", F.lit(PRODUCT_END))).select("key", "product_url").distinct()
    found = found.withColumn("code", code).withColumn("mine", F.startswith("code", F.col("key")))
    # Of surveys without a product of their own: are all those linked listed?
    listed = surveys.select(F.col("key").alias("code"), F.lit(True).alias("listed"))
    moved = found.join(listed, "code", "left").groupBy("key").agg(F.max("mine").alias("any"), F.min(F.coalesce("listed", F.lit(False))).alias("every"))
    moved = moved.filter("NOT any AND every").select("key", F.lit(None).cast("string").alias("product_url"))
    return direct.unionByName(found.filter("mine").select("key", "product_url")).unionByName(moved)


def downloads(links: DataFrame, product_pages: DataFrame, prefer: Sequence[str] = tuple(FORMATS)) -> DataFrame:
    """(key, product_url, edition, format, url): level 3, a row for each edition's file, of
    its formats the preferred one; files are the same whose names differ by format."""
    archive = F.endswith(F.lower(F.split_part("target", F.lit("?"), F.lit(1))), F.lit(ARCHIVE_END))
    rows = links.filter(archive).select(F.col("url").alias("product_url"), "at", F.col("target").alias("url"), "label").join(product_pages.filter("product_url IS NOT NULL"), "product_url")
    rows = rows.withColumn("name", text.file_name(F.col("url")))
    name = F.col("name")
    rows = rows.withColumns({"format": detected_format(name, F.col("label")), "edition": detected_edition(name, F.col("label"), F.col("url"))})
    plain = F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))
    token = F.lower(F.element_at(F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair]), F.col("format")))
    stem = text.normal_id(F.when(F.col("format").isNotNull(), F.replace(plain, token, F.lit(""))).otherwise(plain))
    rank = F.coalesce(F.nullif(F.array_position(F.lit(list(prefer)), F.col("format")), F.lit(0)), F.lit(len(prefer) + 1))
    best = _first(rows.withColumn("stem", stem), ["key", "edition", "stem"], rank, F.col("product_url"), F.col("at"))
    return best.select("key", "product_url", "edition", "format", "url")


def survey_catalogue(pages: DataFrame, roots: Sequence[str] | DataFrame, prefer: Sequence[str] = tuple(FORMATS)) -> DataFrame:
    """CAT-03: catalogue_id, Acronym, SeriesTitle, Title, survey_url, edition, format, url,
    product_url of every file that the catalogue's pages (url, html) lead to.

    A survey without files on the site has one row, with ``(EFT)`` in place of an
    address; one whose products are other listed surveys' has none. Where an entry
    has several editions, its title gets the edition.
    """
    spark = pages.sparkSession
    roots = roots.toDF("url") if isinstance(roots, DataFrame) else spark.createDataFrame([(r,) for r in roots], "url string")
    links = kept(linked(pages), "links")
    # A title's words are taken apart once a survey, not once a file.
    surveys = listing(links, roots).withColumns({"Acronym": text.acronym(F.col("Title")), "SeriesTitle": text.series_title(F.col("Title"))})
    surveys = kept(surveys, "surveys")
    found = kept(products(links, surveys), "products")
    files = kept(downloads(links, found, prefer), "files")  # read twice
    gone = found.filter("product_url IS NULL").select("key")
    several = files.groupBy("key").agg(F.countDistinct("edition").alias("editions"))
    rows = surveys.join(gone, "key", "left_anti").join(files, "key", "left").join(several, "key", "left")
    series = F.col("SeriesTitle")
    titled = F.when((F.col("editions") > 1) & F.col("edition").isNotNull() & series.isNotNull(), F.concat(series, F.lit(" — "), F.col("edition"))).otherwise(F.col("Title"))
    return rows.select(
        "catalogue_id", "Acronym", "SeriesTitle", titled.alias("Title"), "survey_url", "edition", "format",
        F.coalesce("url", F.lit(NO_DOWNLOAD)).alias("url"), "product_url",
    )


def snapshot(spark: SparkSession, folder: str, make: Callable[[], DataFrame], days: int = 180, refresh: bool = False) -> DataFrame:
    """CAT-03, SNK-09, DAT-02: the newest stored catalogue, made anew where there is none, it
    is older than ``days``, or ``refresh`` asks for it.

    Snapshots stand under ``folder``, one a ``taken`` time; an older one stays until a
    new one is whole, and is read where making one fails.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    whole = sorted(n for n in names if n.startswith("taken=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))
    now = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMdd'T'HHmmssSSS").alias("now")).first()["now"]
    taken = F.to_timestamp(F.lit(whole[-1][6:] if whole else now), "yyyyMMdd'T'HHmmssSSS")
    old = not whole or spark.range(1).select(stale(taken, F.current_timestamp(), days)).first()[0]
    if old or refresh:
        try:
            make().write.parquet(f"{folder}/taken={now}")
            whole.append(f"taken={now}")
        except OSError:  # no network: what is there serves on
            if not whole:
                raise
    return spark.read.parquet(f"{folder}/{whole[-1]}")
