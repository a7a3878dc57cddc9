"""How each source's use of words differs from its language's and its other sources'.

A (language, source) group's counts over its language's kept terms are cut into
vocabulary chunks and packed, a row a group and chunk. Groups are dealt to blocks,
and each pair of blocks is a tile: packed rows are copied to the tiles of their
block, and a task goes through a tile's chunks one after another, adding to the
submatrix of its pairs. So it holds one chunk of two blocks, whatever the
vocabulary; long vocabularies are cut in bands of chunks, whose submatrices add up.

All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, written

#: Bytes that are part of a term: letters, lower-cased, and all beyond ASCII; others part.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Text bytes at once, and entries that a task counts before it hands them on.
BLOCK_BYTES, ENTRIES = 1 << 20, 250_000
#: Facts of languages or groups are broadcast up to so many rows and bytes of keys.
FACT_ROWS, FACT_BYTES = 100_000, 16_000_000

COUNTS = "lang string, source string, term string, n long, docs long"
PAIRS = "lang string, source string, item string, value long"


def _words(data: bytes) -> Iterator[list[bytes]]:
    """A text's terms, a block of it at a time."""
    data = data.translate(TERMS)
    at = 0
    while at < len(data):
        end = at + BLOCK_BYTES
        if end < len(data):
            end = data.find(b" ", end)
            end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's texts; a row without a term tells that
    a group occurs."""
    held: dict[tuple[str, str], tuple[Counter, Counter, list[int]]] = {}
    size = 0

    def out():
        for (lang, source), (n, docs, texts) in held.items():
            terms = pa.array([*n, None], pa.binary()).cast(pa.string())
            k = len(terms)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k), pa.array([source] * k), terms, pa.array([*n.values(), 0], pa.int64()), pa.array([*map(docs.__getitem__, n), texts[0]], pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    for b in batches:
        texts, langs, sources = b.column("text").cast(pa.binary()), b.column("lang").to_pylist(), b.column("source").to_pylist()
        for k in range(b.num_rows):
            n, docs, seen_texts = held.setdefault((langs[k], sources[k]), (Counter(), Counter(), [0]))
            before, data, seen = len(n), texts[k].as_py(), set()
            for words in _words(data):
                n.update(words)
                seen.update(words)
            docs.update(seen)
            seen_texts[0] += 1
            size += len(n) - before
            if size >= ENTRIES or len(data) > 16 * BLOCK_BYTES:
                yield from out()
                size = 0
    yield from out()


def counted(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group and the
    documents that hold it; a row with a null term for every group."""
    ship(documents.sparkSession)
    texts = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return texts.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _joined(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the facts of their language or group: by a broadcast where these are
    few, else dealt by key, where large keys are split as the join runs."""
    held = facts.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.concat(*keys)))).first()
    few = held[0] <= FACT_ROWS and (held[1] or 0) <= FACT_BYTES
    return rows.join(F.broadcast(facts) if few else facts, keys)


def _share(count: Column, of: Column) -> Column:
    """1 + floor(10^9 * count / of) for count <= of, in three steps of a thousand, so that
    no product passes a long up to 9 * 10^15 terms."""
    div = lambda a, b: F.call_function("div", a, b)
    first = count * 1000
    second = (first % of) * 1000
    third = (second % of) * 1000
    return 1 + (div(first, of) * 1000 + div(second, of)) * 1000 + div(third, of)


def shares(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """``_share`` for a matrix of counts and a column of sums."""
    out, rest = np.zeros_like(counts), counts
    for _ in range(3):
        whole, rest = np.divmod(rest * 1000, of)
        out = out * 1000 + whole
    return out + 1


def difference(p, q):
    """floor((p - q)^2 / (p + q)), of arrays."""
    d = p - q
    return d * d // (p + q)


class _Packed(NamedTuple):
    tile: tuple
    chunk: int
    block: int
    slot: int
    source: str
    terms: int  # of the chunk
    of: int
    at: np.ndarray
    n: np.ndarray


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[_Packed]:
    for b in batches:
        c = {name: b.column(name).to_pylist() for name in ("lang", "low", "high", "band", "chunk", "block", "slot", "source", "terms", "of")}
        at, n = b.column("at"), b.column("n")
        for k in range(b.num_rows):
            tile = (c["lang"][k], c["low"][k], c["high"][k], c["band"][k])
            yield _Packed(tile, c["chunk"][k], c["block"][k], c["slot"][k], c["source"][k], c["terms"][k], c["of"][k], at[k].values.to_numpy(), n[k].values.to_numpy())


def _matrix(rows: list[_Packed]) -> np.ndarray:
    counts = np.zeros((len(rows), rows[0].terms), np.int64)
    for k, r in enumerate(rows):
        counts[k, r.at] = r.n
    return shares(counts + 2, np.array([max(1, r.of) for r in rows], np.int64)[:, None])


def _tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pair values of each tile, whose rows come together and by chunk."""
    for (lang, low, high, _), tile in groupby(_rows(batches), lambda r: r.tile):
        total = left = right = None
        for _, chunk in groupby(tile, lambda r: r.chunk):
            rows = sorted(chunk, key=lambda r: r.slot)  # one of each group
            left, right = [r for r in rows if r.block == low], [r for r in rows if r.block == high]
            if not left or not right:
                break  # a block that no group was dealt to
            p = _matrix(left)
            q = p if low == high else _matrix(right)
            if total is None:
                total = np.zeros((len(left), len(right)), np.int64)
            for k in range(len(left)):
                first = k + 1 if low == high else 0
                total[k, first:] += difference(p[k], q[first:]).sum(axis=1)
        if total is None:
            continue
        a, b = np.triu_indices(len(left), 1) if low == high else map(np.ravel, np.indices(total.shape))
        ones, others, value = [left[k].source for k in a], [right[k].source for k in b], np.tile(total[a, b], 2)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(ones + others, pa.string()), pa.array(others + ones, pa.string()), pa.array(value)], ["lang", "source", "item", "value"])


def pair_values(kept: DataFrame, groups: DataFrame, chunks: DataFrame, block: int, band: int) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language.

    kept: (lang, source, chunk, at, n); groups: (lang, source, of, n_groups, n_chunks);
    chunks: (lang, chunk, terms).
    """
    blocks = F.ceil(F.col("n_groups") / block).cast("int")
    dealt = groups.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("slot", F.row_number().over(Window.partitionBy("lang", "block").orderBy("source")))
    # A row for each group and chunk, also where the group has none of its terms.
    grid = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    packed = kept.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("at", "n")).alias("held"))
    filled = grid.join(packed, ["lang", "source", "chunk"], "left").join(chunks, ["lang", "chunk"], "left")
    none = F.array().cast("array<struct<at:int,n:bigint>>")
    held = F.coalesce("held", none)
    filled = filled.select("lang", "source", "chunk", "block", "blocks", "slot", "of", F.coalesce("terms", F.lit(0)).cast("int").alias("terms"), held["at"].alias("at"), held["n"].alias("n"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    copied = filled.withColumn("other", other).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other"), "band": F.floor(F.col("chunk") / band).cast("int")})
    tile = ["lang", "low", "high", "band"]
    sorted_ = copied.drop("blocks", "other").repartition(*tile).sortWithinPartitions(*tile, "chunk")
    return sorted_.mapInArrow(_tiles, PAIRS).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(documents: DataFrame, least: int = 10, top: int = 10, block: int = 64, chunk: int = 1024, band: int = 64) -> DataFrame:
    """lang, source, part, item, value, rank: how far sources are from one another (part
    ``pair``, all ranks) and which terms they use more than their language does (part
    ``term``, ranks to ``top``).

    A null text, lang or source is an empty one. Terms are runs of letters and of
    characters beyond ASCII, lower-cased by A-Z alone; a language keeps those that
    ``least`` of its documents hold (a repeated row is another document). Every
    group takes part, with empty texts too; where a language keeps no term, its
    pairs have the value 0. A language's only source has no pair. An empty table
    gives no rows, and other columns play no part.

    Tiles are of ``block`` by ``block`` groups on average, chunks of about ``chunk``
    terms and bands of ``band`` chunks: what a task holds at once, and the most that
    it reads for one tile.
    """
    counts = written(counted(documents), "term-counts")
    of_lang = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
    vocabulary = written(of_lang.filter(F.col("docs") >= least).select("lang", "term", "total"), "vocabulary")
    groups = counts.filter("term is null").select("lang", "source")
    by_lang = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("total_lang"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_groups")).join(by_lang, "lang", "left")
    langs = langs.fillna(0, ["v", "total_lang"]).withColumn("n_chunks", F.greatest(F.lit(1), F.ceil(F.col("v") / chunk)).cast("int"))
    langs = written(langs, "languages")

    dealt = _joined(vocabulary, langs.select("lang", "n_chunks"), ["lang"])
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("n_chunks")).cast("int"))
    placed = dealt.withColumn("at", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1).drop("n_chunks")
    kept = counts.filter("term is not null").select("lang", "source", "term", "n").join(placed, ["lang", "term"])
    kept = written(kept, "kept-counts")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total_group"))
    facts = _joined(groups.join(totals, ["lang", "source"], "left").fillna(0, ["total_group"]), langs, ["lang"])
    facts = facts.withColumn("of", F.col("total_group") + 2 * F.col("v")).withColumn("of_lang", F.col("total_lang") + 2 * F.col("v"))
    facts = written(facts.select("lang", "source", "of", "of_lang", "n_groups", "n_chunks"), "groups")

    chunks = kept.select("lang", "chunk", "term").distinct().groupBy("lang", "chunk").agg(F.count(F.lit(1)).alias("terms"))
    pairs = pair_values(kept.select("lang", "source", "chunk", "at", "n"), facts, chunks, block, band)
    known = _joined(kept, facts.select("lang", "source", "of", "of_lang"), ["lang", "source"])
    known = known.withColumn("p", _share(F.col("n") + 2, F.col("of"))).withColumn("q", _share(F.col("total") + 2, F.col("of_lang")))
    d = F.col("p") - F.col("q")
    terms = known.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.call_function("div", d * d, F.col("p") + F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.cast("int").alias("rank"))
    return out(pairs, "pair").unionByName(out(terms, "term").filter(F.col("rank") <= top))
