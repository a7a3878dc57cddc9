"""One query an operator over the driver's tables, and the SQL that tells its result.

Doubles are rounded, since engines add them up in different orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import convert, text
from ..model import Code, Field, Fixups, Metadata, Variable
from ..operators import bootstrap, columns, estimate
from ..sources import raw
from . import build, store

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- scans and conversion ---------------------------------------------------------

PART_LAYOUT = (Field("P_PARTKEY", 1, 10), Field("P_BRAND", 11, 22), Field("P_SIZE", 23, 28))


@_query("SELECT CAST(p_partkey AS VARCHAR) AS P_PARTKEY, trim(p_brand) AS P_BRAND, CAST(p_size AS VARCHAR) AS P_SIZE FROM part")
def fwf_parse(spark, sf_dir):
    """SRC-01: fixed-width lines cut back into their fields."""
    p = _t(spark, sf_dir, "part")
    line = F.concat(F.lpad(p.p_partkey.cast("string"), 10, " "), F.rpad(F.substring(p.p_brand, 1, 12), 12, " "), F.lpad(p.p_size.cast("string"), 6, " "))
    return raw.fixed_width(p.select(line.alias("value")), PART_LAYOUT)


@_query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 7 <> 0")
def junk_row_filter(spark, sf_dir):
    """SRC-04: rows with fewer than two cells go."""
    c = _t(spark, sf_dir, "customer")
    return raw.drop_junk(c.select("c_custkey", F.when(c.c_custkey % 7 != 0, c.c_name).alias("c_name")))


@_query("SELECT s_suppkey, replace(replace(s_name, 'S', '€'), 'u', 'œ') AS s_name FROM supplier")
def charset_cp1252(spark, sf_dir):
    """SRC-03: bytes of a code page, read as ISO-8859-1, to their characters."""
    s = _t(spark, sf_dir, "supplier")
    return raw.decoded(s.select("s_suppkey", F.translate("s_name", "Su", "\x80\x9c").alias("s_name")), "CP1252")


@_query("SELECT p_partkey, CASE WHEN p_size NOT BETWEEN 40 AND 50 THEN CAST(p_size AS DOUBLE) END AS p_size FROM part")
def numeric_missing_range(spark, sf_dir):
    """NUM-01: numbers in a missing range are null."""
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", convert.numeric_value(p.p_size.cast("string"), 40, 50).alias("p_size"))


@_query("SELECT o_orderkey, CASE WHEN o_custkey NOT IN (1, 2, 7) THEN CAST(o_custkey AS DOUBLE) END AS o_custkey FROM orders")
def na_values(spark, sf_dir):
    """FIX-02: certain raw values are null."""
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", convert.numeric_value(o.o_custkey.cast("string"), na_values=("1", "2", "7")).alias("o_custkey"))


@_query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS value FROM (SELECT event_id, round(value, 6) AS value FROM events)")
def numeric_parse_guard(spark, sf_dir):
    """CST-01: what is no plain number is null, not an error."""
    e = _t(spark, sf_dir, "events")
    value = F.when(e.event_id % 3 == 0, F.round("value", 6).cast("string")).when(e.event_id % 3 == 1, "1d").otherwise("Inf")
    return e.select("event_id", convert.number(value).alias("value"))


FLAGS = (Code("l_returnflag", "A", "Accepted", "Accepté"), Code("l_returnflag", "N", "None yet", None), Code("l_returnflag", "R", "Returned", "Retourné"), Code("l_returnflag", "A", "Second", None))


def _flags(spark, sf_dir, lang):
    li = _t(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", convert.labelled(li.l_returnflag, FLAGS, lang).alias("flag"))


@_query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'Accepted' WHEN 'N' THEN 'None yet' WHEN 'R' THEN 'Returned' END AS flag FROM lineitem")
def label_codes_eng(spark, sf_dir):
    """LAB-01: codes to labels; the first of a repeated code holds."""
    return _flags(spark, sf_dir, "eng")


@_query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'Accepté' WHEN 'N' THEN 'None yet' WHEN 'R' THEN 'Retourné' END AS flag FROM lineitem")
def label_codes_fra(spark, sf_dir):
    """LAB-02: French labels, English where one lacks."""
    return _flags(spark, sf_dir, "fra")


@_query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS region FROM nation")
def label_zero_pad_norm(spark, sf_dir):
    """LAB-01: 01 and 1 are one code if all codes are integers."""
    n = _t(spark, sf_dir, "nation")
    codes = [Code("r", "00", "zero"), Code("r", "01", "one"), Code("r", "2", "two")]
    return n.select("n_nationkey", convert.labelled(F.lpad(n.n_regionkey.cast("string"), 3, "0"), codes).alias("region"))


@_query("SELECT s_suppkey, CASE WHEN length(s) < 2 THEN lpad(s, 2, '0') ELSE s END AS padded FROM (SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS s FROM supplier)")
def str_pad_no_truncate(spark, sf_dir):
    """FIX-01: padding never cuts."""
    s = _t(spark, sf_dir, "supplier")
    return s.select("s_suppkey", convert.padded(s.s_suppkey.cast("string"), 2, "left", "0").alias("padded"))


@_query("SELECT n_nationkey AS n_regionkey, n_regionkey AS n_nationkey, n_name FROM nation")
def cols_swap(spark, sf_dir):
    """PRJ-05"""
    return columns.swap_names(_t(spark, sf_dir, "nation"), [("n_nationkey", "n_regionkey"), ("n_name", "absent")])


@_query("SELECT r_regionkey, r_name AS region FROM region")
def rename_if_present(spark, sf_dir):
    """PRJ-04"""
    return columns.rename_present(_t(spark, sf_dir, "region"), {"r_name": "region", "absent": "x"})


@_query('SELECT n_nationkey AS "Key (n_nationkey)", n_name AS "Name", n_regionkey AS "Key (n_regionkey)" FROM nation')
def relabel_columns(spark, sf_dir):
    """PRJ-01: labels that two columns share are told apart by their names."""
    m = Metadata((Variable("n_nationkey", "Key"), Variable("n_name", "Name"), Variable("n_regionkey", "Key"), Variable("gone", "Key")))
    return columns.relabel(_t(spark, sf_dir, "nation"), m)


@_query("SELECT CAST(x AS VARCHAR) AS code FROM (SELECT p_partkey * 100000 AS x FROM part)")
def plain_codes(spark, sf_dir):
    """CHR-01: large codes without exponent."""
    p = _t(spark, sf_dir, "part")
    return p.select(convert.plain_number(p.p_partkey.cast("double") * 100000).alias("code"))


@_query("""SELECT p_partkey, CASE WHEN p_size <> 50 THEN CAST(p_size AS DOUBLE) END AS P_SIZE,
  CASE WHEN p_brand = 'Brand#11' THEN 'Eleven' WHEN p_brand = 'Brand#12' THEN 'Twelve' END AS P_BRAND, CAST(p_partkey AS INTEGER) AS P_ID FROM part""")
def typed_build(spark, sf_dir):
    """The build's order of steps on one table: ranges, labels, forced integers."""
    p = _t(spark, sf_dir, "part")
    rows = p.select("p_partkey", F.lpad(p.p_size.cast("string"), 4, " ").alias("P_SIZE"), p.p_brand.alias("P_BRAND"), p.p_partkey.cast("string").alias("P_ID"))
    m = Metadata(
        (Variable("p_size", "Size", type="numeric"), Variable("p_brand", "Brand"), Variable("p_id", "Id", type="numeric")),
        (Code("p_size", "50", "Not stated"), Code("p_brand", "Brand#11", "Eleven"), Code("p_brand", "Brand#12", "Twelve")),
    )
    return build.typed(rows, m, Fixups(force_integer=("P_ID",), missing_supplement={"P_SIZE": (50, 50)}))


# -- joins, totals, shares ------------------------------------------------------------


@_query("SELECT o_orderkey, o_custkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def module_inner_join(spark, sf_dir):
    """JOIN-09"""
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(li, "o_orderkey")


@_query("SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) ON o_orderkey = l_orderkey")
def module_left_join(spark, sf_dir):
    """JOIN-09"""
    li = _t(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return _t(spark, sf_dir, "orders").select("o_orderkey").join(li, "o_orderkey", "left")


@_query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 50 END AS k FROM orders),
  w AS (SELECT DISTINCT k, coalesce(k, -1) * 2.0 AS BSW1 FROM o)
  SELECT o_orderkey, o.k, CAST(BSW1 AS DOUBLE) AS BSW1 FROM o LEFT JOIN w ON o.k IS NOT DISTINCT FROM w.k""")
def bsw_left_join(spark, sf_dir):
    """JOIN-01: null keys match null keys."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") % 50).alias("k"))
    w = o.select("k").distinct().select("k", (F.coalesce("k", F.lit(-1)) * 2.0).cast("double").alias("BSW1"))
    return build.with_shipped_weights(o, w, "k")


@_query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS total FROM lineitem GROUP BY ALL")
def weighted_total(spark, sf_dir):
    """AGG-01"""
    df = estimate.weighted_total(_t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")
    return df.withColumn("total", F.round("total", 4))


@_query("""SELECT l_returnflag, l_linestatus, round(total, 4) AS total, round(total / sum(total) OVER (PARTITION BY l_returnflag), 10) AS share
  FROM (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS total FROM lineitem GROUP BY ALL)""")
def weighted_share(spark, sf_dir):
    """WIN-01"""
    df = estimate.weighted_share(_t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_returnflag"], "l_quantity")
    return df.select("l_returnflag", "l_linestatus", F.round("total", 4).alias("total"), F.round("share", 10).alias("share"))


@_query("""SELECT o_orderstatus, o_orderpriority, n, CASE WHEN n = 0 THEN 0 ELSE round(n / sum(n) OVER (PARTITION BY o_orderstatus), 10) END AS share FROM (
  SELECT s.o_orderstatus, p.o_orderpriority, count(o.o_orderkey) AS n FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS o_orderstatus) s
  CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p LEFT JOIN orders o USING (o_orderstatus, o_orderpriority) GROUP BY ALL)""")
def share_guarded(spark, sf_dir):
    """WIN-03 on a cross-table with empty cells."""
    o = _t(spark, sf_dir, "orders")
    levels = [r[0] for r in o.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]
    cells = estimate.crosstab(o, "o_orderstatus", ["F", "O", "P", "X"], "o_orderpriority", levels)
    out = estimate.share(cells, "n", ["o_orderstatus"], guarded=True)
    return out.withColumn("share", F.round("share", 10))


@_query("SELECT round(sum(l_quantity), 2) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice, round(sum(l_tax), 4) AS l_tax, l_returnflag FROM lineitem GROUP BY l_returnflag")
def many_totals(spark, sf_dir):
    """AGG-02"""
    df = estimate.many_totals(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_tax"])
    return df.select("l_returnflag", F.round("l_quantity", 2).alias("l_quantity"), F.round("l_extendedprice", 2).alias("l_extendedprice"), F.round("l_tax", 4).alias("l_tax"))


@_query("SELECT o_orderpriority, CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders ORDER BY list_position(['2-HIGH', '1-URGENT', '5-LOW'], o_orderpriority) NULLS LAST, o_orderkey LIMIT 50")
def enum_sort_topk(spark, sf_dir):
    """SRT-06: sorting follows the order of levels."""
    o = _t(spark, sf_dir, "orders")
    rank = convert.level_order(o.o_orderpriority, ["2-HIGH", "1-URGENT", "5-LOW"])
    return o.orderBy(rank.asc_nulls_last(), "o_orderkey").limit(50).select("o_orderpriority", "o_orderkey")


@_query("""WITH x AS (SELECT c_mktsegment AS g, o_orderpriority AS s, o_totalprice AS w, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS v FROM orders JOIN customer ON o_custkey = c_custkey),
  r AS (SELECT g, s, sum(v * w) / sum(w) AS rate FROM x GROUP BY ALL), std AS (SELECT s, sum(w) AS share FROM x GROUP BY s)
  SELECT g, round(sum(rate * share) / sum(share), 10) AS rate FROM r JOIN std USING (s) GROUP BY g""")
def age_standardised_rate(spark, sf_dir):
    """JOIN-10"""
    o, c = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    x = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_mktsegment").alias("g"), F.col("o_orderpriority").alias("s"), F.col("o_totalprice").alias("w"), (F.col("o_orderstatus") == "F").cast("double").alias("v"))
    standard = x.groupBy("s").agg(F.sum("w").alias("share"))
    return estimate.standardised(x, "g", "s", "v", "w", standard).withColumn("rate", F.round("rate", 10))


@_query("SELECT count(*) FILTER (o_totalprice IS NULL)::BIGINT AS o_totalprice, count(*) FILTER (o_custkey IS NULL)::BIGINT AS o_custkey FROM orders")
def weight_null_audit(spark, sf_dir):
    """AGG-11"""
    return estimate.null_audit(_t(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"])


@_query("SELECT l_orderkey, l_linenumber, name, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem) ON l_quantity, l_tax INTO NAME name VALUE value)")
def pivot_long(spark, sf_dir):
    """RSH-01"""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return li.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"], "name", "value")


@_query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 ELSE 3 END, event_id) AS k FROM events) WHERE k = 1")
def best_per_key(spark, sf_dir):
    """WIN-06/CAT-04"""
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    rank = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    return columns.first_by(e, ["user_id"], [rank, F.col("event_id")])


@_query("SELECT p_partkey, p_brand, last_value(CASE WHEN p_partkey % 4 = 1 THEN p_type END IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS field FROM part")
def codebook_fill_down(spark, sf_dir):
    """WIN-04"""
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 4 == 1, F.col("p_type")).alias("field"))
    return columns.fill_down(p, "field", "p_partkey", ["p_brand"])


# -- bootstrap ------------------------------------------------------------------------

def _let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _hashed(h: str, v: str) -> str:
    x = f"((({h}) + ({v}) % 4294967296 * 1640531527) % 4294967296 * 73244475) % 4294967296"
    return _let(_let(x, "y", "(xor(y, y >> 15) * 1540483477) % 4294967296"), "z", "xor(z, z >> 16)")


def _ones(count: str) -> str:
    """Bits set among as many, by words of 32 of the hash ``w0``."""
    word = f"CASE WHEN j = 0 THEN w0 ELSE {_hashed('w0', 'j')} END"
    return f"list_sum(list_transform(range(greatest(({count} + 31) // 32, 1)), lambda j: bit_count(({word}) & ((1::BIGINT << least(32, {count} - 32 * j)::INT) - 1))))::BIGINT"


def _node(low: str, tag: str) -> str:
    """The first word of a node: of (stratum's hash, place, tag, b)."""
    return _hashed(_hashed(_hashed("h", low), f"{tag} + ({low} >> 32) * 1024"), "b")


# A stratum's runs get their draws by comparing digits (a row a digit), then are halved.
_DRAWS = f"""z AS (SELECT stratum, count(*) AS n, {_hashed("CAST('0x' || substr(md5(stratum), 1, 7) AS BIGINT)", "{seed}")} AS h FROM r GROUP BY stratum),
a AS (
  SELECT stratum, h, b, 0::BIGINT AS low, n AS m, 1::BIGINT << (length(bin(n)) - 1) AS e, n AS c, 0 AS i, n AS u, 0::BIGINT AS s, 1::BIGINT << (length(bin(n)) - 1) AS r FROM z, generate_series(1, {{n}}) g(b)
  UNION ALL
  SELECT stratum, h, b, CASE WHEN over THEN low + e ELSE low END, CASE WHEN over THEN m - e ELSE m END, CASE WHEN over THEN f ELSE e END, CASE WHEN over THEN c - s ELSE c END,
    CASE WHEN over THEN 0 ELSE i + 1 END, CASE WHEN over THEN c - s WHEN 2 * r >= m THEN ones ELSE u - ones END, CASE WHEN over THEN 0 WHEN 2 * r >= m THEN s + u - ones ELSE s END,
    CASE WHEN over THEN f WHEN 2 * r >= m THEN 2 * r - m ELSE 2 * r END
  FROM (SELECT *, {_ones("u")} AS ones, 1::BIGINT << (length(bin(m - e)) - 1) AS f FROM (SELECT *, u = 0 OR i = 62 AS over, {_node("low", "(100 + i)")} AS w0 FROM a WHERE m > e))
), v AS (
  SELECT stratum, h, b, low, length(bin(e)) - 1 AS k, CASE WHEN m = e THEN c ELSE s END AS c FROM a WHERE m = e OR u = 0 OR i = 62
  UNION ALL
  SELECT stratum, h, b, low + side * (1::BIGINT << (k - 1)), k - 1, CASE side WHEN 0 THEN ones ELSE c - ones END
  FROM (SELECT *, {_ones("c")} AS ones, unnest([0, 1]) AS side FROM (SELECT *, {_node("low", "k")} AS w0 FROM v WHERE k > 0 AND c > 0))
),
c AS (SELECT stratum, low AS place, b, c AS draws FROM v WHERE k = 0 AND c > 0)"""
_ROWS = """r AS (SELECT o_orderkey AS id, {stratum} AS stratum, o_totalprice AS w, row_number() OVER (PARTITION BY {stratum} ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) - 1 AS place FROM orders)"""


def _boot(seed: int, n: int, stratum: str, tail: str) -> str:
    return f"WITH RECURSIVE {_ROWS.format(stratum=stratum)}, {_DRAWS.replace('{seed}', str(seed)).replace('{n}', str(n))} {tail}"


@_query(_boot(5, 2, "''", "SELECT r.id, CAST(b AS INTEGER) AS b, CAST(draws AS BIGINT) AS draws FROM r JOIN c USING (stratum, place)"))
def bootstrap_counts(spark, sf_dir):
    """BSW-01"""
    return bootstrap.counts(_t(spark, sf_dir, "orders"), "o_orderkey", last=2, seed=5).select("id", "b", "draws")


@_query(_boot(1, 4, "o_orderstatus", "SELECT stratum, CAST(b AS INTEGER) AS b, CAST(sum(draws) AS BIGINT) AS draws, round(sum(draws * w), 2) AS total FROM r JOIN c USING (stratum, place) GROUP BY ALL"))
def bootstrap_stratified(spark, sf_dir):
    """BSW-03: a stratum's draws are as many as its rows."""
    o = _t(spark, sf_dir, "orders")
    n = bootstrap.counts(o, "o_orderkey", ["o_orderstatus"], last=4)
    both = n.join(o.select(F.col("o_orderkey").alias("id"), "o_totalprice"), "id")
    return both.groupBy("stratum", "b").agg(F.sum("draws").alias("draws"), F.round(F.sum(F.col("draws") * F.col("o_totalprice")), 2).alias("total"))


def _replicated(spark, sf_dir, n=8):
    o = _t(spark, sf_dir, "orders")
    w = bootstrap.replicate_weights(o, "o_totalprice", "o_orderkey", ["o_orderstatus"], n)
    return o, bootstrap.attach(o.select("o_orderkey", "o_orderpriority", "o_totalprice"), w, "o_orderkey")


_REPS = "p AS (SELECT o_orderpriority, sum(o_totalprice) AS point FROM orders GROUP BY 1), t AS (SELECT o_orderpriority, b, sum(draws * w) AS total FROM r JOIN c USING (stratum, place) JOIN orders ON o_orderkey = id GROUP BY ALL)"


@_query(_boot(1, 8, "o_orderstatus", f", {_REPS} SELECT o_orderpriority, round(any_value(point), 2) AS point, round(sqrt(avg((total - point) ** 2)), 2) AS se FROM t JOIN p USING (o_orderpriority) GROUP BY 1"))
def bootstrap_se(spark, sf_dir):
    """AGG-06"""
    o, df = _replicated(spark, sf_dir)
    point = estimate.weighted_total(o, ["o_orderpriority"], "o_totalprice")
    se = estimate.standard_error(estimate.replicate_totals(df, ["o_orderpriority"]), point, ["o_orderpriority"])
    return se.select("o_orderpriority", F.round("point", 2).alias("point"), F.round("se", 2).alias("se"))


@_query(_boot(1, 8, "o_orderstatus", f", {_REPS} SELECT o_orderpriority, round(quantile_cont(total, 0.025), 0) AS low, round(quantile_cont(total, 0.975), 0) AS high FROM t GROUP BY 1"))
def bootstrap_ci(spark, sf_dir):
    """AGG-07"""
    _, df = _replicated(spark, sf_dir)
    ci = estimate.interval(estimate.replicate_totals(df, ["o_orderpriority"]), ["o_orderpriority"])
    return ci.select("o_orderpriority", F.round("low", 0).alias("low"), F.round("high", 0).alias("high"))


@_query(_boot(1, 6, "o_orderstatus", "SELECT r.id, round(coalesce(sum(draws * w), 0), 2) AS total FROM r LEFT JOIN c USING (stratum, place) GROUP BY ALL"))
def bootstrap_extend(spark, sf_dir):
    """BSW-07/09: four stored replicates of half the strata's rows become six of all."""
    o = _t(spark, sf_dir, "orders")
    have = bootstrap.replicate_weights(o.filter("o_orderstatus <> 'P'"), "o_totalprice", "o_orderkey", ["o_orderstatus"], 4)
    now = bootstrap.extended(have, o, "o_totalprice", "o_orderkey", ["o_orderstatus"], 6)
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    return now.select("id", F.round(total, 2).alias("total"))


# -- the longitudinal store -------------------------------------------------------------

_EV = "SELECT event_id, year(ts) AS year, month(ts) AS month, round(value, 4) AS value FROM events"


def _events(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.year("ts").alias("year"), F.month("ts").alias("month"), F.round("value", 4).alias("value"))


@_query("""SELECT o_orderkey, year, month, CASE WHEN year % 2 = 0 THEN year::VARCHAR ELSE strftime(make_date(year, month, 1), '%Y-%m') END AS version
  FROM (SELECT o_orderkey, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month FROM orders)""")
def lfs_supersede(spark, sf_dir):
    """LFS-04: an annual version takes its months' place; odd years have none and keep theirs."""
    e = _t(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    monthly = e.withColumn("version", F.format_string("%04d-%02d", "year", "month"))
    annual = e.filter("year % 2 = 0").withColumn("version", F.col("year").cast("string"))
    both = monthly.unionByName(annual)
    return store.superseded(both, both.select("version").distinct()).select("o_orderkey", "year", "month", "version")


@_query(f"SELECT event_id, CASE WHEN month % 2 = 0 THEN CAST(event_id AS DOUBLE) ELSE value END AS x, CASE WHEN month % 2 = 0 THEN 1 END AS extra FROM ({_EV})")
def lfs_schema_evolution(spark, sf_dir):
    """SNK-06: a column widens from integer to double, another appears."""
    e = _events(spark, sf_dir)
    first = e.filter("month % 2 = 0").select("event_id", F.col("event_id").alias("x"), F.lit(1).alias("extra"))
    second = e.filter("month % 2 <> 0").select("event_id", F.col("value").alias("x"))
    return store.evolved_union([first, second])


@_query(f"SELECT event_id, year, month, CAST(make_date(year, month, 1) AS DATE) AS SURVDATE FROM ({_EV})")
def survdate(spark, sf_dir):
    """LFS-10"""
    return columns.survey_date(_events(spark, sf_dir).drop("value"), "year", "month").select("event_id", "year", "month", "SURVDATE")


@_query("""SELECT doc_id, GENDER, SEX, coalesce(GENDER, CASE SEX WHEN 'Male' THEN 'Men+' ELSE 'Women+' END) AS GENDER_SEX FROM (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE toxic WHEN 0 THEN 'Men+' WHEN 1 THEN 'Women+' END END AS GENDER, CASE quality WHEN 0 THEN 'Male' ELSE 'Female' END AS SEX FROM labels)""")
def gender_sex(spark, sf_dir):
    """LFS-11: GENDER where it is known (here for even ids), else SEX."""
    x = _t(spark, sf_dir, "labels")
    gender = F.when(F.col("doc_id") % 2 == 0, F.when(F.col("toxic") == 0, "Men+").when(F.col("toxic") == 1, "Women+"))
    x = x.select("doc_id", gender.alias("GENDER"), F.when(F.col("quality") == 0, "Male").otherwise("Female").alias("SEX"))
    return columns.gender_sex(x)


# -- catalogue strings -----------------------------------------------------------------


@_query("SELECT page_id, len(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1))::INTEGER AS n, regexp_replace(url, '\\?.*$', '').regexp_extract('([^/]*)$', 1) AS file, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS id FROM pages")
def html_links(spark, sf_dir):
    """SRC-17, STR-06, STR-10"""
    p = _t(spark, sf_dir, "pages")
    return p.select("page_id", F.size(text.links(p.html)).alias("n"), text.file_name(p.url).alias("file"), text.normal_id(p.url).alias("id"))


TITLES = (
    ("General Social Survey – Public Use Microdata Files", "GSS", "General Social Survey"),
    ("Canadian Housing Survey, 2021: Public Use Microdata File", "CHS", "Canadian Housing Survey"),
    ("Mental Health and Access to Care Survey (MHACS): Public Use", "MHACS", "Mental Health and Access to Care Survey (MHACS)"),
    ("2016 Census of Population - individuals", "Census", "2016 Census of Population"),
    ("Canadian Perspectives Survey Series 6: Substance Use", "CPSS", "Canadian Perspectives Survey Series"),
)


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in TITLES) + ") t(title, acronym, series)")
def acronym_series(spark, sf_dir):
    """STR-07, STR-08"""
    t = spark.createDataFrame([(x[0],) for x in TITLES], "title string")
    return t.select("title", text.acronym(F.col("title")).alias("acronym"), text.series_title(F.col("title")).alias("series"))


FILES = (
    ("https://x/n1/cen16_ind_e.zip?st=1", "'2016 (individuals)'", "2010", 2), ("https://x/c27_2013_f.pdf", None, "Cycle 27 (2013)", 0), ("https://x/nhs11_hier_csv.zip", "'2011 (hierarchical)'", "2010", 1),
    ("https://x/cen96_fam_x.zip", "'1996 (families)'", "2010", 1), ("https://x/cen96.zip", None, "2010", 1), ("https://x/a_cen01_hous_x.zip", None, "2010", 1), ("https://x/CSGVP_2007_eng.zip", None, "CSGVP (2007)", 2), ("https://x/TU_ET_2022.zip", None, "Cycle 36 (2022)", 1),
)


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', {'NULL' if b is None else b}, '{c}', {d})" for a, b, c, d in FILES) + ") t(url, edition, version, score)")
def url_edition_decode(spark, sf_dir):
    """STR-09, STR-11"""
    t = spark.createDataFrame([(x[0],) for x in FILES], "url string")
    u = F.col("url")
    return t.select("url", text.census_edition(u).alias("edition"), text.gss_version(u, F.lit("2010")).alias("version"), text.language_score(text.file_name(u), "eng").alias("score"))


CODES = (
    ("A", "97", "Not asked"), ("A", "98", "Not stated"), ("A", "0", "None"), ("B", "1", "Male"), ("B", "9", "Not stated"), ("C", "6", "Valid skip"),
)


@_query("SELECT * FROM (VALUES ('A', true, 97.0::DOUBLE, 98.0::DOUBLE), ('B', false, 9.0, 9.0), ('C', true, 6.0, 6.0)) t(name, sentinel_only, low, high)")
def sentinel_detect(spark, sf_dir):
    """SEN-01: all labels mean missing or none; the range is of the missing ones."""
    c = spark.createDataFrame(CODES, "name string, val string, label string")
    value = F.when(convert.missing_label(F.col("label")), convert.number(F.col("val")))
    return c.groupBy("name").agg(F.bool_and(convert.sentinel_label(F.col("label"))).alias("sentinel_only"), F.min(value).alias("low"), F.max(value).alias("high"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled, weighted shares by category with bootstrap errors and intervals."""
    o, df = _replicated(spark, sf_dir, 20)
    by = ["o_orderpriority"]
    point = estimate.share(estimate.weighted_total(o, by, "o_totalprice"), "total")
    reps = estimate.replicate_totals(df, by)
    se, ci = estimate.standard_error(reps, point, by), estimate.interval(reps, by)
    return point.join(se.drop("point"), by).join(ci, by).select("o_orderpriority", "total", "share", "se", "low", "high")
