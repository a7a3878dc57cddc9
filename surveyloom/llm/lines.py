"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

A line is known by a 128-bit hash of its text, so copies meet as one node.
All of a line's shingles of eight characters are hashed and 28 minima are kept,
taken as each task reads and merged in the shuffle; runs of four minima make
seven bands. Pairs of lines are compared by their exact Jaccard similarity, and
distributed union-find gives the components; the first line of each stays.

Which pairs of a band's lines are compared keeps the work near the number of
lines, not of pairs, and yet loses no link that banding proposes. Every line is
compared with one representative T; those unlike it then with a representative
of theirs, and so on for a few rounds. What may still be near in spite of that
is found by gains, the shingles that a line has beyond T: unless their sizes
leave room, two lines near each other but not to T share some gains, and of a
line's gains only so many of the rarest need be looked up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, looked_up, meet, merged, settled, unused, written
from .graph import components

BANDS, ROWS = 7, 4
#: Shingles that one row stands for while minima are taken.
AT_ONCE = 8
#: Rounds of representatives before gains are looked up; more rounds find no more links.
ROUNDS = 2
#: Ratio of the sizes that a class of line sizes spans.
STEP = 1.1
#: Candidate lines whose 128-bit keys may be broadcast (24 bytes each in memory).
BROADCAST_LINES = 400_000


def _place(doc: Column, text_hash: Column, pos: Column) -> Column:
    """Order of lines: doc_id (nulls first), then texts of one id, then position."""
    big = lambda c, p: c.cast(f"decimal({p},0)")
    ids = big(F.coalesce(doc, F.lit(-(2**63))), 19) * big(F.lit(10**18), 19)
    return (ids + big(F.pmod(text_hash, F.lit(10**8)) * F.lit(10**10) + pos, 19)).cast("decimal(38,0)")


def _occurrences(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut_up = rows.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode_outer(F.split("text", "\n", -1)).alias("pos", "line"))
    return cut_up.filter(F.trim("line") != "").select(
        "doc_id", "th", "pos", "line",
        F.xxhash64("line", F.lit(1)).alias("h1"), F.xxhash64("line", F.lit(2)).alias("h2"),
    )


def _wide(line: Column) -> Column:
    """Four bytes a character, so that a shingle is a slice at a known place."""
    return F.encode(line, "UTF-32")


def _starts(line: Column, width: int) -> Column:
    """Where in ``_wide`` the shingles begin; a shorter line is its own one."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), (F.length(line) - width) * 4 + 1), F.lit(4))


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once; plain reuse would copy its tree."""
    return F.get(F.transform(F.array(value), then), 0)


def _hashes(line: Column, width: int) -> Column:
    """64-bit hashes of all shingles, in order."""
    return _let(_wide(line), lambda w: F.transform(_starts(line, width), lambda at: F.xxhash64(w.substr(at, F.lit(4 * width)))))


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """(h1, h2, weight, m0...): minima of shingle hashes in as many orders.

    The rows of a band take different sixteen bits of the hash for the highest, and
    each minimum has a mask of its own, so that orders differ in short lines too.
    A row made of a line stands for AT_ONCE shingles in a row (the last ones
    of a line may count again, which moves no minimum). What one row makes is
    a generator's output, which the optimizer doesn't compute again after it.
    """
    text = F.col("text").cast("string")
    both = F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("line"), _wide(x).alias("wide")))
    lines = docs.select(F.explode_outer(both).alias("x")).filter(F.trim("x.line") != "")
    lines = lines.select(F.xxhash64("x.line", F.lit(1)).alias("h1"), F.xxhash64("x.line", F.lit(2)).alias("h2"), "x.wide")
    last = F.greatest(F.lit(1), F.octet_length("wide") - 4 * width + 1)
    rows = lines.select("h1", "h2", "wide", F.explode_outer(F.sequence(F.lit(1), last, F.lit(4 * AT_ONCE))).alias("at"))
    several = range(AT_ONCE)
    rows = rows.select("h1", "h2", *[F.xxhash64(F.col("wide").substr(F.least(F.col("at") + 4 * i, last), F.lit(4 * width))).alias(f"s{i}r0") for i in several])
    turned = lambda i, r: F.shiftleft(f"s{i}r0", 64 * r // ROWS).bitwiseOR(F.shiftrightunsigned(f"s{i}r0", 64 - 64 * r // ROWS)).alias(f"s{i}r{r}")
    rows = rows.select("h1", "h2", *[f"s{i}r0" for i in several], *[turned(i, r) for i in several for r in range(1, ROWS)])
    xors = [F.xxhash64(F.lit(k), F.lit("permutation")) for k in range(BANDS * ROWS)]
    least = lambda k, x: F.min(F.least(*[F.col(f"s{i}r{k % ROWS}").bitwiseXOR(x) for i in several])).alias(f"m{k}")
    return rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("weight"), *[least(k, x) for k, x in enumerate(xors)])


def _bands(signatures: DataFrame) -> DataFrame:
    """(lid, h1, h2, weight, bands); lid numbers the distinct lines, once written."""
    keys = [F.xxhash64(F.lit(b), *[F.col(f"m{b * ROWS + r}") for r in range(ROWS)]) for b in range(BANDS)]
    return signatures.select(F.monotonically_increasing_id().alias("lid"), "h1", "h2", "weight", F.array(*keys).alias("bands"))


def _with_hashes(pairs: DataFrame, width: int) -> DataFrame:
    """``pairs`` with the hashes of their lines' shingles as sa and sb in place of la and lb.
    A generator's output, like the rows in ``_signatures``: what follows is compiled and
    doesn't make them again, while within a lambda each hash would be boxed."""
    others = [c for c in pairs.columns if c not in ("la", "lb")]
    both = F.struct(_hashes(F.col("la"), width).alias("sa"), _hashes(F.col("lb"), width).alias("sb"))
    return pairs.select(*others, F.explode_outer(F.array(both)).alias("s")).select(*others, "s.sa", "s.sb")


def _pair_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with both lines; a line that is ``a`` of very many pairs is
    broadcast, if such lines are short enough in all, and meets them where they are."""
    often = settled(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    firsts = cut(merged(texts.withColumnRenamed("line", "la"), often.withColumnRenamed("a", "lid"), "lid").withColumnRenamed("lid", "a"))
    return merged(meet(pairs, firsts, "a", total, size="la").coalesce(1 + total // 5000), texts.toDF("b", "lb"), "b")


def _compared(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(pairs' columns, na, nb, inner): sizes of the shingle sets and of what they share."""
    both = _with_hashes(_pair_texts(pairs, texts), width)
    sizes = F.size(F.array_distinct("sa")).alias("na"), F.size(F.array_distinct("sb")).alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("inner")
    # Checkpointed: a filter on it would compute the sets again.
    return settled(both.select(*pairs.columns, *sizes))


def _alike(least: float) -> Column:
    return F.col("inner") >= least * (F.col("na") + F.col("nb") - F.col("inner"))


def _rounds(members: DataFrame, texts: DataFrame, width: int, least: float) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Compares each band's lines with a representative, then those that were unlike
    it with another, and so on.

    ``members`` (key, lid, central). Gives the links found, the comparisons (a,
    b, ...) with the first representative, and the last rounds' unlike lines.
    """
    links = first = None
    for _ in range(ROUNDS):
        reps = members.groupBy("key").agg(F.max_by("lid", F.struct("central", "lid")).alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        reps = settled(reps)
        n = reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not n:
            break
        against = settled(meet(members, reps, "key", n, dealt=looked_up).filter("lid <> rep"))
        pairs = settled(against.select(F.col("rep").alias("a"), F.col("lid").alias("b")).distinct())
        told = _compared(pairs, texts, width)
        found = told.filter(_alike(least)).select("a", "b")
        links = found if links is None else settled(links.unionAll(found))
        first = first if first is not None else (told, against)
        unlike = told.filter(~_alike(least)).select(F.col("a").alias("rep"), F.col("b").alias("lid"))
        members = settled(merged(against, unlike, ["rep", "lid"]).select("key", "lid", "central"))
    return links, first, members


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(STEP)).cast("int")


def _apart(told: DataFrame, against: DataFrame, texts: DataFrame, roots: DataFrame, width: int, least: float) -> DataFrame:
    """Pairs (a, b) of one band's lines in different components that may be alike
    though their representative T doesn't link them.

    Two sets of sizes n and m that are alike share at least alpha = least * (n + m)
    / (1 + least). Let x be the one that shares less with T, namely i. Then x
    and y share alpha - i gains at least, shingles that both have beyond T. So if
    x has g gains, one of the g - (alpha - i) + 1 rarest is among y's. alpha
    grows with m; y is looked up by classes of sizes. Where alpha <= i the sizes
    alone tell the pairs.
    """
    named = merged(told, roots.select(F.col("node").alias("b"), "root"), "b", "left").withColumn("root", F.coalesce("root", "b"))
    named = named.withColumn("off", ~_alike(least)).withColumn("far", 1 - F.col("inner") / (F.col("na") + F.col("nb") - F.col("inner")))
    placed = settled(merged(against.select("key", F.col("rep").alias("a"), F.col("lid").alias("b")), settled(named), ["a", "b"]))
    # Jaccard distance is a metric: y can't be near x if x is much farther from T.
    keys = placed.groupBy("key").agg(
        F.min(F.when(F.col("off"), F.col("far"))).alias("nearest"), F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")
    ).filter("nearest is not null and low <> high").select("key", "nearest", "n")
    keys = settled(keys)
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return placed.select("a", "b").limit(0)
    asked = meet(placed, keys, "key", total, dealt=looked_up).filter(F.col("off") | (F.col("far") >= F.col("nearest") - (1 - least) - 1e-9))
    asked = asked.select("key", "a", "b", "root", "off", "far", F.col("nb").alias("n"), F.col("inner").alias("i"))
    asked = settled(asked.withColumn("class", _size_class(F.col("n"))).withColumn("member", F.monotonically_increasing_id()))

    both = _with_hashes(_pair_texts(asked.select("a", "b").distinct(), texts), width)
    gains = written(both.select("a", "b", F.array_except("sb", "sa").alias("gains")), "line-gains")
    # A gain of one band's lines, by a hash: should two meet, more pairs are compared.
    tokens = merged(asked, gains, ["a", "b"]).select("member", "root", "key", F.explode("gains").alias("gain"))
    tokens = written(tokens.select("member", "root", F.xxhash64("key", "gain").alias("token")), "line-tokens")
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    shared = settled(shared.select("token", "n", F.col("n").alias("often")))
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    live = written(meet(tokens.drop("root"), shared, "token", total, dealt=looked_up), "line-shared-tokens")

    # The classes that a partner can be of, and the gains to share with the least of each.
    reach = math.ceil(math.log(1 / least) / math.log(STEP))

    def by_class(rows: DataFrame, n: Column, i: Column) -> DataFrame:
        out = rows.withColumn("with", F.explode(F.sequence(F.col("class") - reach, F.col("class") + reach)))
        least_n = F.greatest(F.pow(F.lit(STEP), F.col("with")) - 1e-6, least * n)
        return out.withColumn("lacks", F.ceil(least / (1 + least) * (n + least_n) - i - 1e-6).cast("int"))

    # Gains that no other component shares are the rarest, and looked up already.
    mine = Window.partitionBy("member")
    ranked = live.withColumn("place", F.row_number().over(mine.orderBy("often", "token"))).withColumn("alive", F.count(F.lit(1)).over(mine))
    facts = asked.select("member", "class", "root", "n", "i", F.col("b").alias("line"))
    probes = by_class(merged(ranked, facts, "member"), F.col("n"), F.col("i")).filter("place <= alive - greatest(lacks, 1) + 1")
    parts = 1 + total // 50_000
    probes = probes.coalesce(parts).select("token", F.col("with").alias("class"), F.col("line").alias("x"), F.col("root").alias("rx"), F.col("i").alias("ix"))
    y = merged(live.select("member", "token"), facts, "member").coalesce(parts).select("token", "class", F.col("line").alias("y"), F.col("root").alias("ry"), F.col("i").alias("iy"))
    less = (F.col("ix") < F.col("iy")) | ((F.col("ix") == F.col("iy")) & (F.col("x") < F.col("y")))
    met = merged(probes, y, ["token", "class"]).filter((F.col("rx") != F.col("ry")) & less).select("x", "y")

    room = by_class(asked, F.col("n"), F.col("i")).filter("lacks < 1")
    room = room.select("key", F.col("with").alias("class"), F.col("b").alias("x"), F.col("root").alias("rx"), F.col("i").alias("ix"), F.col("n").alias("nx"), F.col("far").alias("fx"), F.col("off").alias("ox"))
    y = asked.select("key", "class", F.col("b").alias("y"), F.col("root").alias("ry"), F.col("i").alias("iy"), "n", "far", "off")
    fits = (F.col("ix") >= least / (1 + least) * (F.col("nx") + F.col("n")) - 1e-6) & (F.abs(F.col("fx") - F.col("far")) <= 1 - least + 1e-9) & (F.col("ox") | F.col("off"))
    by_size = merged(room, y, ["key", "class"]).filter((F.col("rx") != F.col("ry")) & less & fits).select("x", "y")
    pairs = met.unionAll(by_size).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs.coalesce(parts).distinct()


def line_components(docs: DataFrame, width: int = 8, least: float = 0.8) -> DataFrame:
    """(h1, h2, root) for the distinct lines that have a near copy among others."""
    lines = _occurrences(docs)
    bands = written(_bands(_signatures(docs, width)), "line-bands")
    filed = bands.select("lid", "weight", F.explode("bands").alias("key"))
    shared = settled(filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "n", F.col("n").alias("size")))
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return bands.select("h1", "h2", F.col("lid").alias("root")).limit(0)
    members = settled(meet(filed, shared, "key", total, dealt=looked_up))
    # A line in many large bands is likeliest the one that others vary; of such
    # lines the one with most copies.
    central = settled(members.groupBy("lid").agg((F.sum("size") * 1000 + F.least(F.first("weight"), F.lit(999))).alias("central")))
    members = settled(looked_up(members.select("key", "lid"), central, "lid"))
    keys = settled(looked_up(bands.select("lid", "h1", "h2"), central.select("lid"), "lid"))
    wanted = F.broadcast(keys) if keys.count() <= BROADCAST_LINES else keys.hint("shuffle_hash")
    texts = written(lines.select("h1", "h2", "line").join(wanted, ["h1", "h2"]).groupBy("lid").agg(F.min("line").alias("line")), "line-texts")
    links, first, _ = _rounds(members, texts, width, least)
    roots = components(links)
    more = settled(_apart(*first, texts, roots, width, least))
    if not more.isEmpty():
        found = _compared(more, texts, width).filter(_alike(least)).select("a", "b")
        # The components so far are their own stars.
        roots = components(roots.toDF("a", "b").unionAll(found))
    return merged(roots.withColumnRenamed("node", "lid"), keys, "lid").select("h1", "h2", "root")


def dedup_lines(docs: DataFrame, width: int = 8, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with ``text`` cut to the lines that stay, and two more
    columns: n_lines (before) and n_dropped.

    Of each component of equal or near lines the first stays, by doc_id (nulls
    first), then position. Lines shorter than a shingle are near only to equal
    lines. Blank lines are no lines: they stay. A null text stays null and an
    empty one empty; a document whose lines all go is kept with its blank lines.
    Rows with equal doc_id and text are one document. Other columns stay as
    they are; those named like the two new ones (or like a working column) get
    ``_in`` at the end, and underscores after it where that name is taken too.
    """
    doc, under, cut_out, whole = working = ("_doc", "_th", "_gone", "_lines")
    roots = settled(line_components(docs, width, least))
    # Written: three passes read it, and each would cut and hash all texts again.
    places = written(_occurrences(docs).select("h1", "h2", "doc_id", "th", "pos"), "line-places")
    places = places.withColumn("place", _place(F.col("doc_id"), F.col("th"), F.col("pos")))
    firsts = places.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count(F.lit(1)).alias("n"))
    named = settled(looked_up(firsts, roots, ["h1", "h2"], "left").filter("root is not null or first < last"))
    near = named.filter("root is not null")
    kept = settled(near.groupBy("root").agg(F.min("first").alias("keep"), F.count(F.lit(1)).alias("n")))
    lines_near = kept.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    one = near.select("h1", "h2", "root", F.col("n").alias("copies"))
    keep = meet(one, kept, "root", lines_near).select("h1", "h2", "keep", F.col("copies").alias("n"))
    keep = settled(keep.unionAll(named.filter("root is null").select("h1", "h2", F.col("first").alias("keep"), "n")))
    total = keep.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    gone = cut(
        meet(places, keep, ["h1", "h2"], total, dealt=looked_up).filter("place <> keep")
        .groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone"))
        .select(F.col("doc_id").alias(doc), F.col("th").alias(under), F.col("gone").alias(cut_out))
    )
    own = [c.lower() in ("n_lines", "n_dropped", *working) for c in docs.columns]
    docs = docs.toDF(*[unused(docs.columns, f"{c}_in")[0] if new else c for c, new in zip(docs.columns, own)])
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(under))
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(whole) - 1), F.col(cut_out))
    text = F.when(F.col(cut_out).isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(F.col(whole), i)), "\n")
    )
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(whole))
    out = merged(docs, gone, on, "left").withColumn(whole, lines)
    return out.select(
        *[(text.alias("text") if c == "text" else F.col(f"`{c}`")) for c in docs.columns],
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size(cut_out), F.lit(0)).cast("long").alias("n_dropped"),
    )
