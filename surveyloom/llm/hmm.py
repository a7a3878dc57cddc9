"""Language-model scores by a hidden Markov model over a corpus's own words.

States emit symbols. A word that holds a share of SHARE of all tokens is a
symbol (so at most 1/SHARE are), and other words fall into classes by their
last three bytes; a class's words share its probability by their counts, so
the model stays a distribution over all words with one slot for what was never
seen in each class. Baum-Welch starts from a bounded sample; each pass after
that sums expected counts over all partitions. Scores are exact likelihoods by
the scaled forward recursion.
"""

from __future__ import annotations

import zlib
from array import array
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, arrow_slices, broadcast_value, fold, free_caches, sampled, ship, word_blocks, written

#: Stands for the end in counts; white space, so no word.
END = "\n"
SHARE = 2.0**-19
CLASSES = 256
STATES = 8
MODEL_BYTES = 128_000_000


class Symbols(NamedTuple):
    """What is known of the training tokens; symbol 0 is the end."""

    total: int  # N
    distinct: int  # V
    words: dict[bytes, int]  # word to symbol, from 1
    counts: np.ndarray  # tokens of each word symbol
    mass: np.ndarray  # of each class: sum of c + 1 over its words, and 1 for the unseen

    def base(self) -> np.ndarray:
        """A symbol's probability under smoothed counts."""
        p = np.r_[self.counts + 1.0, self.mass]
        return p / p.sum()


class Model(NamedTuple):
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # (states, symbols)


# -- counts -------------------------------------------------------------------


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), k (tells texts of one id apart), held_out."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k"), (fold(F.col("doc_id"), 7) == 2).alias("held_out")
    )


def tokens_of(rows: DataFrame) -> DataFrame:
    """Rows of (doc_id, k, w) for all words, without ends."""
    words = F.split(F.translate(F.col("text"), UPPER + "\t\n\x0b\f\r", UPPER.lower() + " " * 5), " ", -1)
    return rows.select("doc_id", "k", F.explode(words).alias("w")).filter("w <> ''")


def count_tokens(rows: DataFrame) -> DataFrame:
    """(w, c) over the training rows, the end included."""
    train = rows.filter(~F.col("held_out"))
    words = tokens_of(train).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    ends = train.agg(F.count(F.lit(1)).alias("c")).filter("c > 0").select(F.lit(END).alias("w"), "c")
    return words.unionAll(ends)


def _class(w: Column) -> Column:
    return (F.crc32(F.substring(w.cast("binary"), F.lit(-3), F.lit(3))) % CLASSES).cast("int")


def symbols_of(counts: DataFrame) -> Symbols:
    """Reads the totals, the words with a SHARE of all tokens and the classes' masses."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    floor = max(2, n * SHARE)
    frequent = counts.filter((F.col("c") >= floor) & (F.col("w") != END)).orderBy("w").collect()
    ends = counts.filter(F.col("w") == END).select("c").first()
    mass = np.ones(CLASSES)
    for r in counts.filter((F.col("c") < floor) & (F.col("w") != END)).groupBy(_class(F.col("w")).alias("k")).agg(F.sum(F.col("c") + 1).alias("m")).collect():
        mass[r["k"]] += r["m"]
    words = {r["w"].encode("utf-8", "surrogatepass"): i for i, r in enumerate(frequent, 1)}
    return Symbols(int(n), int(v), words, np.array([ends["c"] if ends else 0, *[r["c"] for r in frequent]], dtype=np.float64), mass)


def encode(rows: DataFrame, symbols: Symbols) -> DataFrame:
    """doc_id, k, held_out, ids: each text's symbols, the end last."""
    spark = rows.sparkSession
    ship(spark)
    size = sum(map(len, symbols.words)) + 120 * len(symbols.words)
    shared = broadcast_value(spark, symbols.words, size, MODEL_BYTES, "word symbols")

    def run(batches):
        known = shared.value
        get, first, crc = known.get, len(known) + 1, zlib.crc32
        rare: dict[bytes, int] = {}
        free_caches()
        for b in arrow_slices(batches):
            ids, offsets = array("i"), array("i", [0])
            for text in b.column("text"):
                for w in chain.from_iterable(word_blocks(text.as_py())):
                    s = get(w)
                    if s is None:
                        tail = w[-3:]
                        s = rare.get(tail)
                        if s is None:
                            s = rare[tail] = first + crc(tail) % CLASSES
                            if len(rare) > 200_000:
                                rare.clear()
                    ids.append(s)
                ids.append(0)
                offsets.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, dtype=np.int32)), pa.array(np.frombuffer(ids, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k"), b.column("held_out"), lists], ["doc_id", "k", "held_out", "ids"])

    return rows.mapInArrow(run, "doc_id long, k long, held_out boolean, ids array<int>")


# -- the recursions -------------------------------------------------------------


def _padded(texts: list[np.ndarray], cells: int = 800_000):
    """Texts of like length side by side: (their places, ids (T, B), lengths)."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    at = 0
    while at < len(order):
        longest = max(1, len(texts[order[at]]))
        part = order[at : at + max(1, min(2048, cells // longest))]
        at += len(part)
        lengths = np.array([len(texts[k]) for k in part])
        ids = np.zeros((longest, len(part)), dtype=np.int32)
        for b, k in enumerate(part):
            ids[: lengths[b], b] = texts[k]
        yield part, ids, lengths


def _open_at(steps: int, lengths: np.ndarray) -> np.ndarray:
    """How many texts go on at each step; lengths don't increase."""
    return np.searchsorted(-lengths, -np.arange(steps), side="left")


def forward(m: Model, ids: np.ndarray, lengths: np.ndarray, marks: int = 0):
    """log10 likelihoods of padded texts whose lengths don't increase, by scaling;
    with ``marks`` also the forward vectors before every ``marks``-th step."""
    steps, width = ids.shape
    emit = np.ascontiguousarray(m.emit.T)
    log, open_at, kept = np.zeros(width), _open_at(steps, lengths), []
    a = np.broadcast_to(m.start, (width, len(m.start)))  # of the model's own precision
    for t in range(steps):
        if marks and t % marks == 0:
            kept.append(a)
        n = open_at[t]
        a = (a[:n] if t == 0 else a[:n] @ m.move) * emit[ids[t, :n]]
        scale = a.sum(axis=1)
        log[:n] += np.log10(scale)
        a = a / scale[:, None]
    return log, kept


#: Steps whose forward vectors are held at once; longer texts compute them twice.
STRETCH = 4096


def expected(m: Model, ids: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray, stretch: int = STRETCH) -> float:
    """Adds Baum-Welch's expected counts of padded texts; the sum of likelihoods (log10).

    The forward vectors are kept before each stretch only, and those within one
    computed anew when the way back comes to it; texts of one stretch need no
    such first pass.
    """
    steps, width = ids.shape
    once = steps <= stretch
    log, kept = (np.zeros(width), [np.broadcast_to(m.start, (width, len(m.start)))]) if once else forward(m, ids, lengths, stretch)
    by_symbol = np.ascontiguousarray(m.emit.T)
    open_at = _open_at(steps + 1, lengths)
    beta = np.ones((width, len(m.start)), dtype=m.move.dtype)
    for block in range(len(kept) - 1, -1, -1):
        low, high = block * stretch, min(steps, (block + 1) * stretch)
        n = open_at[low]
        gammas = np.zeros((high - low, n, len(m.start)), dtype=np.float32)
        a = kept[block]
        for t in range(low, high):
            n = open_at[t]
            a = (a[:n] if t == 0 else a[:n] @ m.move) * by_symbol[ids[t, :n]]
            scale = a.sum(axis=1)
            if once:
                log[:n] += np.log10(scale)
            a = a / scale[:, None]
            gammas[t - low, :n] = a
        for t in range(high - 1, low - 1, -1):
            n, o = open_at[t], open_at[t + 1]
            if o:
                right = by_symbol[ids[t + 1, :o]] * beta[:o]
                b = right @ m.move.T
                left = gammas[t - low, :o]
                norm = (left * b).sum(axis=1)
                move += m.move * ((left / norm[:, None]).T @ right)
                beta[:o] = b / b.sum(axis=1, keepdims=True)
            g = gammas[t - low, :n] * beta[:n]
            gammas[t - low, :n] = g / g.sum(axis=1, keepdims=True)
        if not block:
            start += gammas[0].sum(axis=0)
        inside = np.arange(low, high)[:, None] < lengths[: gammas.shape[1]]
        flat, sym = gammas[inside], ids[low:high, : gammas.shape[1]][inside]
        for s in range(len(m.start)):
            emit[s] += np.bincount(sym, weights=flat[:, s], minlength=emit.shape[1])
    return float(log.sum())


def _maximised(start, move, emit, base: np.ndarray, prior: float = 200.0) -> Model:
    """Probabilities from counts, each emission smoothed towards ``base``."""
    e = emit + prior * base
    return Model((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(axis=1, keepdims=True), e / e.sum(axis=1, keepdims=True))


def _zero(states: int, symbols: int):
    return np.zeros(states), np.zeros((states, states)), np.zeros((states, symbols))


def initial(texts: list[np.ndarray], base: np.ndarray, states: int = STATES, rounds: int = 12, seed: int = 3) -> Model:
    """Baum-Welch over a bounded sample, from perturbed emissions and sticky moves."""
    rng = np.random.default_rng(seed)
    emit = base * rng.gamma(1.0, 1.0, (states, len(base)))
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    m = Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))
    for _ in range(rounds if texts else 0):
        counts = _zero(states, len(base))
        for _, ids, lengths in _padded(texts):
            expected(m, ids, lengths, *counts)
        m = _maximised(*counts, base, prior=20.0)
    return m


def _texts(batch: pa.RecordBatch) -> list[np.ndarray]:
    lists = batch.column("ids")
    flat, off = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    off = off - off[0]
    return [flat[off[k] : off[k + 1]] for k in range(len(off) - 1)]


def _slices(batches, ids: int = 6_000_000):
    """Batches of about ``ids`` bytes of symbols."""
    for b in arrow_slices(batches, ids):
        if b.num_rows:
            yield b


def baum_welch(encoded: DataFrame, m: Model, base: np.ndarray) -> Model:
    """One pass over all training texts: expected counts are summed within each
    task, then by symbol over all tasks; what returns is bounded by the symbols."""
    spark = encoded.sparkSession
    states, symbols = m.emit.shape
    shared = broadcast_value(spark, m, m.emit.nbytes + m.move.nbytes, MODEL_BYTES, "hidden Markov model")

    def run(batches):
        m = Model(*(x.astype(np.float32) for x in shared.value))  # counts need no more
        start, move, emit = _zero(states, symbols)
        for b in _slices(batches):
            for _, ids, lengths in _padded(_texts(b)):
                expected(m, ids, lengths, start, move, emit)
        seen = np.flatnonzero(emit.any(axis=0))
        key = np.r_[seen, symbols + np.arange(states + 1)]
        values = np.concatenate([emit[:, seen].T, move, start[None]])
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), *[pa.array(values[:, s]) for s in range(states)]], ["key", *[f"s{s}" for s in range(states)]])

    parts = encoded.filter(~F.col("held_out")).select("ids").mapInArrow(run, "key long, " + ", ".join(f"s{s} double" for s in range(states)))
    sums = parts.groupBy("key").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(states)]).toPandas()
    values = np.zeros((symbols + states + 1, states))
    values[sums["key"].to_numpy(dtype=np.int64)] = sums[[f"s{s}" for s in range(states)]].to_numpy(dtype=np.float64)
    return _maximised(values[-1], values[symbols : symbols + states], values[:symbols].T, base)


def start_sample(encoded: DataFrame, texts: int = 1500, symbols: int = 400_000, length: int = 512) -> list[np.ndarray]:
    """The bounded sample that Baum-Welch starts from: of the training texts of about
    ``texts`` ids the stretches of ``length`` symbols, by hash, that hold about
    ``symbols``. What comes to the driver keeps its size."""
    rows = encoded.filter(~F.col("held_out")).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "k", "ids")
    chosen = sampled(rows, texts, 1.0)
    total = chosen.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    at = F.explode(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / length).cast("int"))).alias("at")
    key = F.pmod(F.xxhash64("id", "k", "at"), F.lit(1_000_000))
    kept = chosen.select("id", "k", "ids", at).filter(key < int(1_000_000 * min(1.0, symbols / max(1, total))))
    got = kept.select("id", "k", "at", F.slice("ids", F.col("at") * length + 1, F.lit(length)).alias("ids")).collect()
    return [np.asarray(r["ids"], dtype=np.int32) for r in sorted(got, key=lambda r: (r["id"], r["k"], r["at"]))]


def train(encoded: DataFrame, symbols: Symbols, passes: int = 2) -> Model:
    """A start on ``start_sample``, then ``passes`` over all training texts."""
    base = symbols.base()
    m = initial(start_sample(encoded), base)
    for _ in range(passes):
        m = baum_welch(encoded, m, base)
    return m


def _likelihoods(encoded: DataFrame, m: Model, symbols: Symbols) -> DataFrame:
    """The texts' likelihoods over symbols, and the base sum over word symbols."""
    # Classes count nothing here: their words' counts come from the join.
    log = np.r_[np.log10(symbols.counts + 1), np.zeros(CLASSES)]
    size = m.emit.nbytes + m.move.nbytes + log.nbytes
    shared = broadcast_value(encoded.sparkSession, (m, log, len(symbols.counts)), size, MODEL_BYTES, "hidden Markov model")

    def run(batches):
        m, log, first = shared.value
        for b in _slices(batches):
            texts = _texts(b)
            out = np.zeros(len(texts))
            for part, ids, lengths in _padded(texts):
                out[part] = forward(m, ids, lengths)[0]
            columns = {
                "n_tokens": [len(x) for x in texts], "lik": out,
                "often": [log[x].sum() for x in texts], "n_often": [int((x < first).sum()) for x in texts],
            }
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k"), b.column("held_out"), *map(pa.array, columns.values())], ["doc_id", "k", "held_out", *columns])

    return encoded.mapInArrow(run, "doc_id long, k long, held_out boolean, n_tokens long, lik double, often double, n_often long")


# -- the operator -----------------------------------------------------------------


def score(docs: DataFrame, passes: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score.

    Learned from the rows outside the held-out fold alone. A null text is an
    empty one, which is one end; rows with equal doc_id and text are scored
    alike; with no training row every count is zero and the model is the
    smoothed one; an empty table gives no rows.
    """
    rows = rows_of(docs)
    counts = written(count_tokens(rows), "token-counts")
    symbols = symbols_of(counts)
    encoded = written(encode(rows, symbols), "symbols")
    model = train(encoded, symbols, passes)
    scored = _likelihoods(encoded, model, symbols)

    # Frequent words' counts are in the symbols; the other tokens, told by a
    # broadcast of at most 1/SHARE words, meet the counts in a join.
    floor = max(2, symbols.total * SHARE)
    frequent = counts.filter((F.col("c") >= floor) & (F.col("w") != END)).select("w")
    mass = F.array(*[F.lit(float(x)) for x in np.log10(symbols.mass)])
    rare = counts.filter((F.col("c") < floor) & (F.col("w") != END))
    met = tokens_of(rows).join(F.broadcast(frequent), "w", "left_anti").join(rare, "w", "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + 1)
    seldom = met.select("doc_id", "k", log.alias("base"), (log - F.get(mass, _class(F.col("w")))).alias("within"), F.col("c").isNotNull().cast("int").alias("known"))
    by_doc = seldom.groupBy("doc_id", "k").agg(*[F.sum(x).alias(x) for x in ("base", "within", "known")])

    one = scored.groupBy("doc_id", "k").agg(F.first("held_out").alias("held_out"), F.first("n_tokens").alias("n_tokens"), *[F.first(x).alias(x) for x in ("lik", "often", "n_often")], F.count(F.lit(1)).alias("copies"))
    b = by_doc.select(F.col("doc_id").alias("_doc"), F.col("k").alias("_k"), *[(F.col(x)).alias(x) for x in ("base", "within", "known")])
    both = one.join(b, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("k") == F.col("_k")), "left")
    part = lambda x: F.coalesce(F.col(x) / F.col("copies"), F.lit(0.0))
    n, v = symbols.total, symbols.distinct
    no_end = 0 if symbols.counts[0] else 1
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "doc_id", "held_out", "n_tokens",
        (part("known").cast("long") + F.col("n_often") - no_end).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (part("base") + F.col("often") - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (F.col("lik") + part("within")).alias("score"),
    )
