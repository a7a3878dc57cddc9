"""How often each of n rows is drawn: counts split down a tree, in numpy.

A row's hash is whole-number arithmetic on 32 bits (module ``bootstrap`` tells the
rule); replicates are columns, so every step is done for many of them at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: The hash: its mask and multipliers.
MASK = np.uint64(2**32 - 1)
STEP, FIRST, SECOND = np.uint64(1640531527), np.uint64(73244475), np.uint64(1540483477)
#: Binary digits of a share that are compared, and the tag of the first.
DIGITS, DIGIT_TAG = 62, 100
#: Rows of a block, as a power of two.
BLOCK_BITS = 10
#: Words that are hashed at once.
WORDS = 1 << 21

RUNS = "stratum string, h long, low long, bits int, b long, c array<long>"


def hashed(h, v):
    """The next hash from one (below 2^32) and a whole number."""
    h, v = np.asarray(h, np.uint64), np.asarray(v, np.uint64)
    x = ((h + (v & MASK) * STEP & MASK) & MASK) * FIRST & MASK
    y = (x ^ (x >> np.uint64(15))) * SECOND & MASK
    return y ^ (y >> np.uint64(16))


def node(h, low, tag):
    """The hash of a place in a stratum's tree."""
    low = np.asarray(low, np.uint64)
    return hashed(hashed(h, low), np.asarray(tag, np.uint64) + (low >> np.uint64(32)) * np.uint64(1024))


def _low_bits(count: np.ndarray) -> np.ndarray:
    return (np.uint64(1) << np.minimum(count, 32).astype(np.uint64)) - np.uint64(1)


def ones(count: np.ndarray, nodes, b) -> np.ndarray:
    """How many of ``count`` fair coins show heads: bits of as many words as it takes."""
    first = np.broadcast_to(hashed(nodes, b), count.shape)
    out = np.bitwise_count(first & _low_bits(count)).astype(np.int64)
    at = np.flatnonzero(count.ravel() > 32)
    if len(at):
        many, start = count.ravel()[at], first.ravel()[at]
        more = (many + 31) // 32 - 1  # words after the first
        ends = np.cumsum(more)
        total = np.zeros(len(at), np.int64)
        for k in range(0, int(ends[-1]), WORDS):
            place = np.arange(k, min(k + WORDS, int(ends[-1])))
            own = np.searchsorted(ends, place, "right")
            word = place - (ends[own] - more[own]) + 1
            heads = np.bitwise_count(hashed(start[own], word) & _low_bits(many[own] - 32 * word))
            total += np.bincount(own, heads, len(at)).astype(np.int64)
        out.ravel()[at] += total
    return out


def _fell(c: np.ndarray, part: int, whole: int, h: int, low: int, b: np.ndarray) -> np.ndarray:
    """How many of c draws from ``whole`` rows fall into the first ``part`` of them: the
    draws' binary fractions are compared with the share's, digit by digit."""
    unsure, under, r = c.copy(), np.zeros_like(c), part
    for i in range(DIGITS):
        if not unsure.any():
            break
        heads = ones(unsure, node(h, low, DIGIT_TAG + i), b)
        r *= 2
        if r >= whole:
            under += unsure - heads
            unsure, r = heads, r - whole
        else:
            unsure = unsure - heads
    return under


def runs(n: int, h: int, b: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(low, bits, draws of each replicate) of each run of n rows."""
    c, low = np.full(len(b), n, np.int64), 0
    while low < n:
        bits = (n - low).bit_length() - 1
        size = 1 << bits
        k = c if size == n - low else _fell(c, size, n - low, h, low, b)
        yield low, bits, k
        c, low = c - k, low + size


def halved(h: int, low: np.ndarray, bits: int, c: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The halves of nodes of 2^bits rows, in order; c has a row a node, a column a replicate."""
    heads = ones(c, node(h, low, bits)[:, None], b[None, :])
    return np.stack([low, low + (1 << (bits - 1))], 1).ravel(), np.stack([heads, c - heads], 1).reshape(-1, c.shape[1])


def to_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stratum, h, n, b, last) to the blocks' draws by replicates b to last."""
    for batch in batches:
        for stratum, h, n, begin, last in zip(*(batch.column(k).to_pylist() for k in ("stratum", "h", "n", "b", "last"))):
            b = np.arange(begin, last + 1, dtype=np.int64)
            for low, bits, c in runs(n, h, b):
                lows, c = np.array([low], np.int64), c[None, :]
                while bits > BLOCK_BITS:
                    lows, c = halved(h, lows, bits, c, b)
                    bits -= 1
                step = max(1, 500_000 // len(b))
                for s in range(0, len(lows), step):
                    k = len(lows[s : s + step])
                    values = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * len(b)), pa.array(c[s : s + step].ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([stratum] * k, pa.string()), pa.array([h] * k, pa.int64()), pa.array(lows[s : s + step]), pa.array([bits] * k, pa.int32()), pa.array([begin] * k, pa.int64()), values], ["stratum", "h", "low", "bits", "b", "c"])


def to_rows(first: int):
    """(stratum, h, low, bits, c, rows) to a line for each of the block's rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                bits, c = batch.column("bits")[k].as_py(), batch.column("c")[k].values.to_numpy()[None, :]
                h, low, b = batch.column("h")[k].as_py(), np.array([batch.column("low")[k].as_py()], np.int64), first + np.arange(c.shape[1])
                while bits:
                    low, c = halved(h, low, bits, c, b)
                    bits -= 1
                rows = batch.column("rows")[k].values
                draws = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * c.shape[1]), pa.array(c.ravel().astype(np.int32)))
                stratum = pa.array([batch.column("stratum")[k].as_py()] * len(rows), pa.string())
                yield pa.RecordBatch.from_arrays([rows.field("id"), stratum, rows.field("value"), draws], ["id", "stratum", "value", "draws"])

    return run
