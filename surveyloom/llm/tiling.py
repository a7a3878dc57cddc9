"""Benchmark decontamination by greedy string tiling.

Running Karp-Rabin: rolling hashes of the shortest tile's length find the
seeds that a document shares with a benchmark item; seeds on one diagonal grow
into maximal matches, the longest are marked first, and what earlier tiles
have taken is cut off. The share of an item's words under tiles decides, so
passages are caught in any order.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_slices, broadcast_value, free_caches, ship, word_blocks, words_of

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words of a document whose seeds are looked up at once.
STRETCH = 1 << 18


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n ids (wrapping 64-bit polynomials)."""
    h = np.zeros(len(ids) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = h * BASE + ids[k : k + len(h)].astype(np.uint64) + np.uint64(1)
    return h


def _maximal(d: np.ndarray, i: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Seeds (document and item positions) to maximal matches (length, d, i)."""
    order = np.lexsort((d, d - i))
    d, i = d[order], i[order]
    starts = np.flatnonzero(np.r_[True, (np.diff(d - i) != 0) | (np.diff(d) != 1)])
    ends = np.r_[starts[1:], len(d)] - 1
    return [(int(d[e] - d[s]) + n, int(d[s]), int(i[s])) for s, e in zip(starts, ends)]


def tile(matches: list[tuple[int, int, int]], doc_len: int, item_len: int, shortest: int) -> list[tuple[int, int, int]]:
    """Marks the longest matches first (ties: earlier in the document, then item).

    A match that meets marked words is cut into its unmarked pieces; pieces
    shorter than ``shortest`` go.
    """
    in_doc, in_item = np.zeros(doc_len, dtype=bool), np.zeros(item_len, dtype=bool)
    heap = [(-n, d, i) for n, d, i in matches]
    heapq.heapify(heap)
    tiles = []
    while heap:
        n, d, i = heapq.heappop(heap)
        n = -n
        taken = in_doc[d : d + n] | in_item[i : i + n]
        if not taken.any():
            in_doc[d : d + n] = in_item[i : i + n] = True
            tiles.append((n, d, i))
            continue
        edges = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))
        for s, e in zip(edges[::2], edges[1::2]):
            if e - s >= shortest:
                heapq.heappush(heap, (-int(e - s), d + int(s), i + int(s)))
    return tiles


class Index:
    """The shared-seed index of one block of items."""

    def __init__(self, items: list[tuple[int, list[bytes]]], shortest: int):
        self.vocab: dict[bytes, int] = {}
        self.items = [(k, np.array([self.vocab.setdefault(w, len(self.vocab)) for w in ws], dtype=np.int64)) for k, ws in items if ws]
        by_n: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for at, (_, ids) in enumerate(self.items):
            n = min(shortest, len(ids))
            by_n[n].append((_rolling(ids, n), at))
        self.tables = {}
        for n, got in by_n.items():
            h = np.concatenate([x for x, _ in got])
            item = np.concatenate([np.full(len(x), at) for x, at in got])
            pos = np.concatenate([np.arange(len(x)) for x, _ in got])
            order = np.argsort(h, kind="stable")
            self.tables[n] = (h[order], item[order], pos[order])

    def _seeds(self, ids: np.ndarray, n: int):
        """(place in the document, item, place in it) of all shared seeds of n words,
        looked up stretch by stretch of the document."""
        hashes, item, pos = self.tables[n]
        for low in range(0, len(ids) - n + 1, STRETCH):
            part = ids[low : low + STRETCH + n - 1]
            unknown = np.cumsum(np.r_[0, part < 0])
            at = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(at):
                continue
            h = _rolling(part, n)[at]
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                continue
            reps = (hi - lo)[hit]
            k = np.repeat(lo[hit] - np.r_[0, np.cumsum(reps)[:-1]], reps) + np.arange(reps.sum())
            yield np.repeat(at[hit] + low, reps), item[k], pos[k]

    def search(self, text: str | None):
        """Yields (item key, item words, tiles) for each item that shares a seed."""
        get = self.vocab.get
        blocks = [np.fromiter((get(w, -1) for w in ws), dtype=np.int32, count=len(ws)) for ws in word_blocks(text)]
        ids = np.concatenate(blocks) if blocks else np.zeros(0, dtype=np.int32)
        for n in self.tables:
            found = list(self._seeds(ids, n))
            if not found:
                continue
            d, it, i = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(it, kind="stable")
            d, it, i = d[order], it[order], i[order]
            starts = np.flatnonzero(np.r_[True, np.diff(it) != 0])
            for s, e in zip(starts, np.r_[starts[1:], len(it)]):
                key, own = self.items[it[s]]
                dd, ii = d[s:e], i[s:e]
                same = np.all([ids[dd + j] == own[ii + j] for j in range(n)], axis=0)
                if same.any():
                    dd, ii = dd[same], ii[same]
                    low = int(dd.min())  # marks are kept for the stretch with seeds alone
                    tiles = tile(_maximal(dd - low, ii, n), int(dd.max()) - low + n, len(own), n)
                    yield key, len(own), [(size, at + low, to) for size, at, to in tiles]


def _blocks(benchmark: DataFrame, most_bytes: int):
    """Items in blocks of at most ``most_bytes`` of text, read one by one."""
    block, held = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for row in rows.filter("text is not null").distinct().toLocalIterator():
        words = words_of(row["text"])
        size = sum(map(len, words)) + 64 * len(words)
        if block and held + size > most_bytes:
            yield block, held
            block, held = [], 0
        block.append((row["item_id"], words))
        held += size
    if block:
        yield block, held


def _shared_blocks(docs: DataFrame, benchmark: DataFrame, block_bytes: int):
    """Broadcasts block after block; a block is over its bound only if one item is."""
    ship(docs.sparkSession)
    for items, size in _blocks(benchmark, block_bytes):
        bound = size if len(items) == 1 else block_bytes
        yield broadcast_value(docs.sparkSession, items, size, bound, "benchmark block")


OUT = "doc_id long, item_id long, tiled_words long, item_words long, n_tiles long, longest_tile long, coverage double"


def contaminated(
    docs: DataFrame, benchmark: DataFrame, shortest: int = 5, least: float = 0.4, block_bytes: int = 16_000_000
) -> DataFrame:
    """Rows (doc_id, item_id, ...) where tiles of at least ``shortest`` words
    cover the share ``least`` of the item's words.

    Items shorter than that are one seed as a whole. All documents meet all
    items: items come in blocks of bounded size, each broadcast to one pass, so
    no document is shuffled. Null or blank documents and items match nothing;
    repeated rows give repeated results; with no items or documents there are
    no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = []
    for shared in _shared_blocks(docs, benchmark, block_bytes):

        def run(batches, shared=shared):
            free_caches()
            index = Index(shared.value, shortest)
            for b in arrow_slices(batches):
                out = []
                for doc, text in zip(b.column("doc_id").to_pylist(), map(_py, b.column("text"))):
                    for key, n, tiles in index.search(text):
                        tiled = sum(t[0] for t in tiles)
                        if tiled >= least * n:
                            out.append((doc, key, tiled, n, len(tiles), max(t[0] for t in tiles), tiled / n))
                kinds = [pa.float64() if c.endswith("double") else pa.int64() for c in OUT.split(", ")]
                columns = [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OUT.split(", ")])

        parts.append(rows.mapInArrow(run, OUT))
    if not parts:
        return docs.sparkSession.createDataFrame([], OUT)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, shortest: int = 5, least: float = 0.4, block_bytes: int = 16_000_000
) -> DataFrame:
    """The rows of ``docs`` that ``contaminated`` would not report.

    Whole rows pass through in their batches, so nothing is shuffled. Null and
    blank texts are clean, repeated rows share their fate, and without items (or
    with null ones alone) all rows stay; an empty table stays empty.
    """
    at = docs.columns.index("text")
    for shared in _shared_blocks(docs, benchmark, block_bytes):

        def run(batches, shared=shared):
            free_caches()
            index = Index(shared.value, shortest)
            for b in arrow_slices(batches):
                clean = [all(sum(t[0] for t in tiles) < least * n for _, n, tiles in index.search(x)) for x in map(_py, b.column(at))]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _py(x):
    return x.as_py()
