"""SimHash near-duplicates by multi-index hashing.

A fingerprint sums up the XXH64 hashes of a text's 3-word shingles. Two
fingerprints of 64 bits that differ in at most 3 bits differ in at most one
bit in one of their two halves (two bits in both would make four). So every
fingerprint is filed under each half, looks up that half and all halves at
one bit's distance, and the few rows fetched are compared over all bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_slices, cut, free_caches, meet, ship, unused, word_blocks
from .graph import components

HALF = 32
#: Shingles hashed and counted at once; bounds the memory for a very long text.
BLOCK = 1 << 15


def _hashes(blocks: Iterator[list[bytes]], width: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of words that come block by block."""
    digest, carried, few = xxhash.xxh64_intdigest, [], True
    for block in blocks:
        words = carried + block
        for at in range(0, len(words) - width + 1, BLOCK):
            few = False
            part = words[at : at + BLOCK + width - 1]
            shifted = [part[k:] for k in range(width)]
            yield np.fromiter((digest(b" ".join(x), seed) for x in zip(*shifted)), dtype=">u8")
        carried = words[max(0, len(words) - width + 1) :] if width > 1 else []
    if few and carried:
        yield np.array([digest(b" ".join(carried), seed)], dtype=">u8")


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint; 0 without words."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for h in _hashes(word_blocks(text), width, seed):
        counts += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, th, fp): fp is the fingerprint's 64 bits as a signed long, th the text's hash."""

    ship(docs.sparkSession)

    def run(batches):
        free_caches()
        for b in arrow_slices(batches):
            fps = np.array([fingerprint(t.as_py(), width, seed) for t in b.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fps.view(np.int64))], ["doc_id", "th", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, "doc_id long, th long, fp long")


def links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b) of different fingerprints in ``distinct`` (fp) at the distance or less.

    Each pair is found at least once: under an equal half by the smaller of
    the two, under halves at one bit's distance by the one with that bit unset.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two halves with balls of one bit find distances of 0 to 3")
    halves = F.array(
        F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned("fp", HALF).alias("half")),
        F.struct(F.lit(1).alias("seg"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("half")),
    )
    filed = distinct.select("fp", F.explode(halves).alias("h")).select(
        "fp", (F.col("h.half") * 2 + F.col("h.seg")).alias("key")
    )
    ball = F.expr("concat(array(key), filter(transform(sequence(1, 32), i -> key | shiftleft(1L, i)), k -> k <> key))")
    looked = filed.select(F.col("fp").alias("a"), F.col("key").alias("own"), F.explode(ball).alias("key"))
    found = looked.join(filed.withColumnRenamed("fp", "b"), "key")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    once = (F.col("own") != F.col("key")) | (F.col("a") < F.col("b"))
    return found.filter(near & once & (F.col("a") != F.col("b"))).select("a", "b").distinct()


def groups(docs: DataFrame, distance: int = 3, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, th, fp, root, component_id) of each row; root tells the group."""
    fps = cut(fingerprints(docs, width, seed))
    firsts = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    roots = components(links(firsts.select("fp"), distance))
    named = cut(firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")))
    least = cut(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")))
    nodes = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ids = cut(meet(named.select("fp", "root", F.col("n").alias("rows")), least, "root", nodes).withColumnRenamed("rows", "n"))
    return meet(fps, ids, "fp", total).select("doc_id", "th", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, distance: int = 3, width: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed long), component_id.

    Equal fingerprints are one node, so a group of copies costs one look-up.
    component_id is the least doc_id reachable over links (null only if all
    ids there are null). Null or blank texts have fingerprint 0 and are linked
    like any other; an empty table gives no rows.
    """
    return groups(docs, distance, width, seed).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near duplicates.

    Of each group one document stays, the first by doc_id (nulls first), then by
    the text's hash; rows of equal doc_id and text are one document, of which
    one row stays. Null and blank texts are near duplicates of one another.
    """
    mark, stays, under = unused(docs.columns, "_text", "_stays", "_as")
    first = F.min(F.struct("doc_id", "th")).alias("first")
    stay = groups(docs, distance).groupBy("root").agg(first).select(F.col("first.doc_id").alias(stays), F.col("first.th").alias(under))
    marked = docs.withColumn(mark, F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(stays)) & (F.col(mark) == F.col(under))
    return marked.join(stay.distinct(), same, "left_semi").dropDuplicates(["doc_id", mark]).drop(mark)
