"""Shards of near equal bytes that keep equal texts together.

Groups of equal texts stand in the order of their text's hash and are cut into
contiguous shards whose largest is as small as can be. The smallest capacity
comes from a binary search with a greedy check; neither needs every group on the
driver. Hash ranges with their sums stand for the groups: a range taken whole
gives an upper bound of the capacity, one that may be cut anywhere a lower one, and
the ranges around the cuts are split, by a scan each round, until the two meet.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bits that tell the first ranges apart, ranges that a round splits, and parts that
#: it makes, at most; the widest span of hashes that is taken at once.
FIRST_BITS, SPANS, SPLIT, WIDEST = 12, 128, 16_384, 2**62
#: Rows that one task numbers at most, on average.
NUMBERED = 50_000


class Range(NamedTuple):
    """Groups with a hash from ``low`` to ``high``; ``single`` if they are one."""

    low: int
    high: int
    bytes: int
    single: bool


class Cuts(NamedTuple):
    """Shards of texts: ``alone`` has the hashes of groups with a shard of their own,
    the first ones; the others begin at the hashes in ``starts``."""

    alone: list[int]
    starts: list[int]

    def shard(self, key: Column) -> Column:
        place = F.lit(len(self.alone))
        if self.starts:
            place = place + F.size(F.filter(F.lit(self.starts), lambda s: s <= key))
        for k, h in enumerate(self.alone):
            place = F.when(key == h, k).otherwise(place)
        return place.cast("int")


def key_of(text: Column) -> Column:
    """The hash that orders groups; a null text is as an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _filled(sums: list[int], ranges: list[Range], capacity: int, shards: int, whole: bool) -> list[int] | None:
    """The bytes before each next shard, greedily filled; None if ``shards`` don't do.

    ``whole`` takes ranges as they are; else one of several groups is cut anywhere.
    """
    at, out = 0, []
    for _ in range(shards):
        to = min(at + capacity, sums[-1])
        k = bisect_right(sums, to) - 1  # the range that ``to`` is in
        if sums[k] < to and (whole or ranges[k].single):
            to = sums[k]
        if to <= at and at < sums[-1]:
            return None
        at = to
        out.append(at)
    return out if at >= sums[-1] else None


def _least(sums: list[int], ranges: list[Range], shards: int, whole: bool) -> int:
    """The least feasible capacity, by binary search."""
    low, high = -(-sums[-1] // shards), sums[-1]
    while low < high:
        mid = (low + high) // 2
        if _filled(sums, ranges, mid, shards, whole) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _unsure(sums: list[int], ranges: list[Range], low: int, high: int, shards: int) -> list[int]:
    """Ranges of several groups in which a cut can fall at capacities low to high, those
    of most bytes first."""
    found, early, late = set(), 0, 0
    for _ in range(shards):
        # The earliest place: ranges taken whole at a capacity of ``low``, and one that
        # doesn't fit passed; the latest: ranges cut anywhere, at ``high``.
        begun = bisect_right(sums, early) - 1
        first = max(bisect_right(sums, early + low) - 1, begun)
        early = sums[min(max(first, begun + 1), len(ranges))]
        late = min(late + high, sums[-1])
        last = min(bisect_right(sums, late) - 1, len(ranges) - 1)
        found.update(k for k in range(min(first, last), last + 1) if not ranges[k].single)
    return sorted(found, key=lambda k: (-ranges[k].bytes, k))


def _split(rows: DataFrame, spans: list[Range]) -> list[list[Range]]:
    """Each span of hashes, in order, in parts with their sums, by one scan."""
    parts = max(2, SPLIT // len(spans))
    # No piece is so wide that a difference of its hashes passes a long.
    pieces = [(k, low, min(low + WIDEST - 1, r.high)) for k, r in enumerate(spans) for low in range(r.low, r.high + 1, WIDEST)]
    owner, lows, highs = map(list, zip(*pieces))
    widths = [-(-(high - low + 1) // parts) for low, high in zip(lows, highs)]
    at = F.size(F.filter(F.lit(lows), lambda s: s <= F.col("key"))) - 1
    within = rows.withColumn("piece", at).filter("piece >= 0").filter(F.col("key") <= F.get(F.lit(highs), "piece"))
    part = F.call_function("div", F.col("key") - F.get(F.lit(lows), "piece"), F.get(F.lit(widths), "piece"))
    sums = within.groupBy("piece", part.alias("part")).agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
    out: list[list[Range]] = [[] for _ in spans]
    for r in sorted(sums.collect()):
        out[owner[r["piece"]]].append(Range(r["low"], r["high"], r["bytes"], r["low"] == r["high"]))
    return out


def cuts_of(rows: DataFrame, shards: int) -> Cuts:
    """The cuts for rows (key, size): one scan a round, of the two or three columns alone.

    The driver holds some ten thousand ranges, however many groups there are. A
    group that has an even share of the rest or more gets a shard of its own
    first; there are fewer of these than shards.
    """
    total = rows.agg(F.sum("size")).first()[0]
    if total is None:
        return Cuts([], [])
    large = rows.groupBy("key").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") * shards >= total)
    alone: list[int] = []
    rest = total
    for h, n in sorted(((r["key"], r["bytes"]) for r in large.collect()), key=lambda r: (-r[1], r[0])):
        if len(alone) < shards - 1 and n * (shards - len(alone)) >= rest:
            alone.append(h)
            rest -= n
    rows, shards = rows.filter(~F.col("key").isin(alone)) if alone else rows, shards - len(alone)
    begun = rows.groupBy(F.shiftright("key", 64 - FIRST_BITS).alias("part")).agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
    ranges = [Range(r["low"], r["high"], r["bytes"], r["low"] == r["high"]) for r in sorted(begun.collect())]
    while ranges:
        sums = [0, *accumulate(r.bytes for r in ranges)]
        low, high = (_least(sums, ranges, shards, whole) for whole in (False, True))
        unsure = _unsure(sums, ranges, low, high, shards)[:SPANS] if low < high else []
        if not unsure:
            filled = _filled(sums, ranges, high, shards, True)
            starts = [bisect_right(sums, at) - 1 for at in filled[:-1]]
            return Cuts(alone, [ranges[k].low for k in starts if k < len(ranges)])
        unsure.sort()
        finer = _split(rows, [ranges[k] for k in unsure])
        for k, new in reversed([*zip(unsure, finer)]):
            ranges[k : k + 1] = new
    return Cuts(alone, [])


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, key, size, text_crc32), without the texts."""
    text = F.col("text").cast("string")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    return documents.select(F.col("doc_id"), key_of(text).alias("key"), size_of(text).alias("size"), crc.alias("text_crc32"))


def assign(documents: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: each document's place.

    The law is ``bytes``: shards are near equal in bytes of text, plus eight a
    document, and the largest is as small as any contiguous cut of the groups in
    hash order allows. Groups are equal texts (a null text is as an empty one, of
    no bytes), kept whole; texts whose 64-bit hashes collide count as one group. A
    group of an even share or more has a shard of its own. With fewer groups than
    shards some stay empty. Slots run from 0 without gaps within each shard, by
    text and doc_id within chunks by hash; rows equal in both are interchangeable.
    grown_shard is null, as only the law ``key`` has it. Ids can be null or
    repeated; an empty table gives no rows, and other columns play no part.
    """
    rows = written(sized(documents), "sized")
    cuts = cuts_of(rows, shards)
    placed = rows.withColumn("shard", cuts.shard(F.col("key")))
    held = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    each = max(256, min(NUMBERED, sum(held.values()) // 512))
    chunks = F.get(F.lit([-(-held.get(k, 0) // each) or 1 for k in range(shards)]), "shard")
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "key"), chunks))
    sizes = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("key", "doc_id")) - 1
    numbered = placed.withColumn("own", own).join(shifts, ["shard", "chunk"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("own") + F.col("shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(documents: DataFrame, path: str, shards: int = 24) -> Cuts:
    """Writes all columns of the documents under ``path``, a folder a shard (shard=k).
    A row's shard follows from its text alone, so nothing is joined."""
    cuts = cuts_of(written(sized(documents).select("key", "size"), "sized"), shards)
    documents.withColumn("shard", cuts.shard(key_of(F.col("text")))).write.partitionBy("shard").parquet(path)
    return cuts
