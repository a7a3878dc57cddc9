"""Queries of the crawl, over ``pages`` and over a site made of customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crawl
from .queries import _query, _t

# A page's address keeps its id; each links to the pages of twice its id and one more,
# by links of four kinds, and to one of a fifth of its id, beside its own links.
_SITE = "http://site.example.org/a/b/"


def _site(spark, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "pages")
    i = F.col("page_id")
    address = lambda n: F.concat(F.lit("p"), n.cast("string"), F.lit(".htm"))
    n = 2 * i
    href = (
        F.when(i % 4 == 0, F.concat(F.lit("/a/b/"), address(n))).when(i % 4 == 1, F.concat(F.lit("../b/./"), address(n)))
        .when(i % 4 == 2, F.concat(F.lit("//site.example.org/a/b/"), address(n), F.lit("#top"))).otherwise(F.concat(F.lit(_SITE), address(n)))
    )
    tail = F.concat(F.lit("<A class=x\n HREF='"), href, F.lit("'>one</a><a href=\"mailto:x@y.z\">m</a><a href=\""), address(n + 1), F.lit('">two</a><a href="'), address(F.floor(i / 5)), F.lit('">back</a>'))
    return p.select(F.concat(F.lit(_SITE), address(i)).alias("url"), F.concat(F.coalesce("html", F.lit("")), tail).alias("html"))


@_query("""WITH RECURSIVE n AS (SELECT max(page_id) AS n FROM pages), e AS (
  SELECT page_id AS a, unnest([2 * page_id, 2 * page_id + 1, page_id // 5]) AS b FROM pages
), own AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a\\s*>', 1)) AS h FROM pages),
w AS (SELECT 1 AS page_id, 0 AS depth UNION SELECT e.b, w.depth + 1 FROM w JOIN e ON e.a = w.page_id WHERE w.depth < 40),
d AS (SELECT page_id, min(depth) AS depth FROM w GROUP BY page_id),
x AS (SELECT replace(split_part(trim(replace(h, '&amp;', '&')), '#', 1), '&amp;', '&') AS h, min(depth) + 1 AS depth FROM own JOIN d USING (page_id) GROUP BY ALL),
r AS (SELECT CASE WHEN regexp_matches(h, '(?i)^https?://') THEN h WHEN regexp_matches(h, '^[A-Za-z][\\w+.-]*:') OR h = '' THEN NULL WHEN h LIKE '/%' THEN 'http://site.example.org' || h END AS url, depth FROM x)
SELECT 'http://site.example.org/a/b/p' || page_id || '.htm' AS url, depth::INT AS depth, page_id IN (SELECT page_id FROM pages) AS known FROM d
UNION ALL SELECT url, min(depth)::INT, false FROM r WHERE url IS NOT NULL GROUP BY url""")
def crawl_depths(spark, sf_dir):
    """SRC-17, CAT-03: how many links lead to each address, from one page on."""
    return crawl.crawl(_site(spark, sf_dir), [f"{_SITE}p1.htm"])


def _catalogue_site(spark, sf_dir: str) -> DataFrame:
    """A listing a nation; a survey a customer; its orders are the files on its product
    page, in two formats where the order's number is even."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("y"))
    k = F.col("c_custkey").cast("string")
    title = F.concat(F.lit("Survey of Customers "), F.translate(k, "0123456789", "bcdefghijk"), F.lit(", 2020: Public Use Microdata File"))
    listed = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<li><a href="/n1/en/catalogue/C'), F.lpad(k, 9, "0"), F.lit('-x"><b>'), title, F.lit("</b></a></li>")))), "\n")
    roots = c.groupBy("c_nationkey").agg(listed.alias("html")).select(F.concat(F.lit("http://s.example.org/n1/en/type/"), F.col("c_nationkey").cast("string")).alias("url"), "html")
    code = F.concat(F.lit("c"), F.lpad(k, 9, "0"), F.lit("x"))
    other = F.concat(F.lit("c"), F.lpad((F.col("c_custkey") - 1).cast("string"), 9, "0"), F.lit("x"))
    own = F.when(F.col("c_custkey") % 10 == 9, other).otherwise(code)  # moved to the one before
    surveys = c.select(F.concat(F.lit("http://s.example.org/n1/en/catalogue/C"), F.lpad(k, 9, "0"), F.lit("-x")).alias("url"), F.concat(F.lit("<a href='/n1/pub/"), own, F.lit("/index-eng.htm'>p</a><a href='/n1/pub/zz/index-fra.htm'>q</a>")).alias("html"))
    stem = F.translate(F.col("o_orderkey").cast("string"), "0123456789", "abcdefghij")
    link = lambda kind, ext: F.concat(F.lit('<a href="'), F.lit("files/"), F.col("y").cast("string"), F.lit("/f"), stem, F.lit(f'{ext}.zip?v=1">'), F.lit(f"{kind}</a>"))
    each = F.when(F.col("o_orderkey") % 2 == 0, F.concat(link("SAS", "_SAS"), link("CSV", "_CSV"))).otherwise(link("SPSS", ""))
    files = F.array_join(F.array_sort(F.collect_list(F.struct("o_orderkey", each.alias("a"))))["a"], "\n")
    product = F.concat(F.lit("http://s.example.org/n1/pub/c"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("x/index-eng.htm"))
    return roots.unionByName(surveys).unionByName(o.groupBy("o_custkey").agg(files.alias("html")).select(product.alias("url"), "html"))


@_query("""WITH o AS (SELECT o_custkey AS k, year(o_orderdate) AS y, 'f' || translate(o_orderkey::VARCHAR, '0123456789', 'abcdefghij') || CASE WHEN o_orderkey % 2 = 0 THEN '_CSV' ELSE '' END AS f,
    CASE WHEN o_orderkey % 2 = 0 THEN 'CSV' ELSE 'SPSS' END AS format FROM orders),
n AS (SELECT k, count(DISTINCT y) AS n FROM o GROUP BY k),
c AS (SELECT c_custkey AS k, lpad(c_custkey::VARCHAR, 9, '0') AS d, 'Survey of Customers ' || translate(c_custkey::VARCHAR, '0123456789', 'bcdefghijk') AS t FROM customer
  WHERE NOT (c_custkey % 10 = 9 AND c_custkey - 1 IN (SELECT c_custkey FROM customer)))
SELECT 'C' || d || '-x' AS catalogue_id, 'SC' || upper(substr(t, 21, 1)) AS Acronym, t AS SeriesTitle,
  CASE WHEN n > 1 THEN t || ' — ' || y ELSE t || ', 2020: Public Use Microdata File' END AS Title, 'http://s.example.org/n1/en/catalogue/C' || d || '-x' AS survey_url,
  y::VARCHAR AS edition, format, CASE WHEN f IS NULL THEN '(EFT)' ELSE 'http://s.example.org/n1/pub/c' || d || 'x/files/' || y || '/' || f || '.zip?v=1' END AS url,
  CASE WHEN f IS NOT NULL THEN 'http://s.example.org/n1/pub/c' || d || 'x/index-eng.htm' END AS product_url
FROM c LEFT JOIN o USING (k) LEFT JOIN n USING (k)""")
def crawled_catalogue(spark, sf_dir):
    """CAT-03, JOIN-07, PRJ-15: three levels of pages to one row a survey's file."""
    site = _catalogue_site(spark, sf_dir)
    roots = site.filter(F.contains("url", F.lit("/type/"))).select("url")
    return crawl.survey_catalogue(site, roots)
