from urllib.parse import urljoin, urldefrag

import pytest
from pyspark.sql import functions as F
from surveyloom.plans import crawl

BASES = ("http://a.org", "http://a.org/x", "https://a.org/x/y.htm?q=1", "http://a.org/x/y/z/")
HREFS = ("", "b.htm", "./b", "../b", "../../../b", "/c", "/c/../d", "//e.org/f", "?p=2", "#top", "b#top", "HTTP://g.org/h", "mailto:x@y", "javascript:void(0)", "d/./e/..", "b.htm?x=1/2")


def test_links_resolve_as_in_browsers(spark):
    rows = spark.createDataFrame([(b, h) for b in BASES for h in HREFS], "b string, h string")
    got = {(r.b, r.h): r.u for r in rows.select("b", "h", crawl.resolved(F.col("b"), F.col("h")).alias("u")).collect()}
    for (b, h), u in got.items():
        if h.startswith(("mailto", "java", "#")) or not h:
            assert u is None
        else:
            want = urldefrag(urljoin(b, h.replace("HTTP", "http")))[0]
            assert u == want, (b, h)


PAGES = [
    ("http://s/a", '<a href="b">B</a><a href="c">C</a><a href="b">again</a>'), ("http://s/b", "<a href='a'>A</a><a href='d?x=1#y'>D</a>"),
    ("http://s/c", "<a href='http://other/z'>Z</a>"), ("http://s/d?x=1", "<a href=''>self</a>"), ("http://s/e", "<a href='a'>unreached</a>"), (None, "<a href='a'>x</a>"), ("http://s/f", None),
]


@pytest.mark.parametrize("most, want", [
    (None, {("http://s/a", 0, True), ("http://s/b", 1, True), ("http://s/c", 1, True), ("http://s/d?x=1", 2, True), ("http://other/z", 2, False)}),
    (1, {("http://s/a", 0, True), ("http://s/b", 1, True), ("http://s/c", 1, True)}), (0, {("http://s/a", 0, True)}),
])
def test_crawl(spark, most, want):
    pages = spark.createDataFrame(PAGES + PAGES[:2], "url string, html string")
    assert {tuple(r) for r in crawl.crawl(pages, ["http://s/a", "http://s/a"], most).collect()} == want


def test_crawl_follows_what_it_may(spark):
    pages = spark.createDataFrame(PAGES, "url string, html string")
    out = crawl.crawl(pages, ["http://s/a"], follow=lambda u: F.startswith(u, F.lit("http://s/")))
    assert {r.url for r in out.collect()} == {"http://s/a", "http://s/b", "http://s/c", "http://s/d?x=1"}
    assert crawl.crawl(pages, []).collect() == []
    assert [tuple(r) for r in crawl.crawl(pages.limit(0), ["http://s/a"]).collect()] == [("http://s/a", 0, False)]


def test_links_with_blanks_and_line_ends(spark):
    """Addresses that aren't plain go the long way, as all did before."""
    rows = [("http://a.org/x", "b c/../d"), ("http://a.org/x", "b?q=1\n"), ("http://a.org/x", "b?q=1\n2"), ("http://a.org/x", "b\nc"), ("file:///x", "b"), ("http://a.org/x", "b?p=/../c"), ("http://a.org/x", "é/.b"), (None, "b"), ("http://a.org/x", None)]
    got = spark.createDataFrame(rows, "b string, h string").select(crawl.resolved(F.col("b"), F.col("h")).alias("u")).collect()
    assert [r.u for r in got] == ["http://a.org/d", "http://a.org/b?q=1", "http://a.org/b", "http://a.org", "", "http://a.org/b?p=/../c", "http://a.org/é/.b", None, None]


SITE = [
    ("http://s/list", '<a href="/catalogue/82M0013X">Health Survey (HSV): Public Use Microdata File</a><a href="/pub/11c/index-eng.htm">Income Survey, 2019</a>'
     '<a href="/catalogue/11C">Income Survey of Canada</a><a href="/catalogue/OLD1">Old Cycle</a><a href="/catalogue/EFT9">Elsewhere Survey</a><a href="/about">About</a>'),
    ("http://s/catalogue/82M0013X", '<a href="/pub/82m0013x2020/h-eng.htm">x</a><a href="/pub/82-003-s/h-eng.htm">article</a>'),
    ("http://s/pub/82m0013x2020/h-eng.htm", '<a href="2019/data_SAS.zip">2019 SAS</a><a href="2019/data_CSV.ZIP">2019 CSV</a><a href="/z/2020/data.zip">SPSS, 2020</a><a href="guide.pdf">guide</a>'),
    ("http://s/catalogue/11C", '<a href="/pub/11c/index-eng.htm">x</a>'), ("http://s/pub/11c/index-eng.htm", '<a href="http://t/2018-19_STATA.zip">files</a>'),
    ("http://s/catalogue/OLD1", '<a href="/pub/11c/index-eng.htm">moved</a>'), ("http://s/catalogue/EFT9", "<a href='/pub/unlisted/x-eng.htm'>y</a>"),
]


def test_survey_catalogue(spark):
    out = crawl.survey_catalogue(spark.createDataFrame(SITE, "url string, html string"), ["http://s/list"]).collect()
    got = {(r.catalogue_id, r.edition, r.format, r.url) for r in out}
    assert got == {
        ("82M0013X", "2019", "CSV", "http://s/pub/82m0013x2020/2019/data_CSV.ZIP"), ("82M0013X", "2020", "SPSS", "http://s/z/2020/data.zip"),
        ("11C", "2018-19", "Stata", "http://t/2018-19_STATA.zip"), ("EFT9", None, None, crawl.NO_DOWNLOAD),
    }
    assert {r.Title for r in out if r.catalogue_id == "82M0013X"} == {"Health Survey (HSV) — 2019", "Health Survey (HSV) — 2020"}
    assert {r.Acronym for r in out if r.catalogue_id == "82M0013X"} == {"HSV"}


def test_catalogue_works_out_a_title_once_a_survey(spark, tmp_path):
    """Files are found once, titles taken apart in the surveys' rows (F6), and a link's address in stages."""
    pages = spark.createDataFrame(SITE, "url string, html string")
    plan = crawl.survey_catalogue(pages, ["http://s/list"])._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan and "Window" not in plan and "RLIKE" not in plan
    links = crawl.linked(pages)._jdf.queryExecution().optimizedPlan().toString()
    above = links[: links.index("Generate")]
    assert above.count("^(https?://[^/?#]*)") == 0 and above.count("(?i)^https?://") <= 2


def test_snapshot_is_made_once_and_again_when_old(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(len(made),)], "n int")

    at = f"{tmp_path}/snapshots"
    assert crawl.snapshot(spark, at, make).first().n == 1
    assert crawl.snapshot(spark, at, make).first().n == 1
    assert crawl.snapshot(spark, at, make, refresh=True).first().n == 2
    assert crawl.snapshot(spark, at, make, days=-1).first().n == 3

    def fails():
        raise OSError("no network")

    assert crawl.snapshot(spark, at, fails, refresh=True).first().n == 3
    with pytest.raises(OSError):
        crawl.snapshot(spark, f"{tmp_path}/none", fails)


def test_surveys_find_archives_by_the_catalogue(spark, tmp_path):
    from surveyloom.plans.surveys import Surveys

    pages = spark.createDataFrame(SITE, "url string, html string")
    own = spark.createDataFrame([("ISC", "2018-19", "http://old"), ("SFS", "2019", "http://sfs")], "Acronym string, Version string, url string")
    surveys = Surveys(spark, str(tmp_path), collection=own).with_catalogue(pages, ["http://s/list"])
    assert surveys.address("HSV", "2019") == "http://s/pub/82m0013x2020/2019/data_CSV.ZIP"
    assert surveys.address("ISC", "2018-19") == "http://t/2018-19_STATA.zip" and surveys.address("SFS", "2019") == "http://sfs"
    again = Surveys(spark, str(tmp_path)).with_catalogue(pages.limit(0), [])
    assert again.address("HSV", "2020") == "http://s/z/2020/data.zip" and again.address("EFT9", "2019") is None
