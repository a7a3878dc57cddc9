"""Language identification by a linear-chain conditional random field.

Words are labelled one by one, so text that switches between languages is no
special case. A word's score for a label sums weights of its prefixes and
suffixes, its character bigrams and trigrams, and its place in a lexicon of
frequent words; learned transitions tie neighbours. Forward-backward gives each
word's label probabilities, and their mean over a text's words decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_slices, broadcast_value, fold, free_caches, sampled, ship

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
GAP = re.compile(r"\s")


def has_letter(text: str) -> bool:
    m = LETTER.search(text)
    while m and not m[0].isalpha():  # a number sign such as a superscript
        m = LETTER.search(text, m.end())
    return m is not None


MIX = np.uint64(0x9E3779B97F4A7C15)


class Model(NamedTuple):
    labels: list[str]
    grams: np.ndarray  # (buckets, labels)
    lexicon: dict[str, int]
    words: np.ndarray  # (lexicon, labels)
    transitions: np.ndarray  # (labels, labels), from row to column
    start: np.ndarray


# -- features -----------------------------------------------------------------


def _grams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all words in a row, and the offset where each begins.

    Each word, between marks, has its affixes of one to three characters and
    all its bigrams and trigrams; every word has at least one feature.
    """
    text = "".join(f"\x02{w}\x03" for w in words)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    left = start[owner] + size[owner] - np.arange(len(c))  # characters from here to the word's end
    with np.errstate(over="ignore"):
        h1 = (c + np.uint64(1)) * MIX
        h2 = (h1[:-1] ^ (c[1:] + np.uint64(7))) * MIX
        h3 = (h2[:-1] ^ (c[2:] + np.uint64(13))) * MIX
        two, three = np.flatnonzero(left[:-1] >= 2), np.flatnonzero(left[:-2] >= 3)
        parts = [(owner[two], h2[two] ^ np.uint64(1)), (owner[three], h3[three] ^ np.uint64(2))]
        for n in (1, 2, 3):
            have = np.flatnonzero(size >= n + 2)
            for at, salt in ((start[have] + 1, 10 + n), (start[have] + size[have] - 1 - n, 20 + n)):
                h = (h1, h2, h3)[n - 1][at] ^ np.uint64(salt)
                parts.append((have, h))
        at = np.concatenate([p[0] for p in parts])
        h = np.concatenate([p[1] for p in parts])
        h = (h ^ (h >> np.uint64(29))) * MIX
    order = np.argsort(at, kind="stable")
    bucket = (h[order] >> np.uint64(32)).astype(np.int64) % buckets
    return bucket, np.searchsorted(at[order], np.arange(len(words)))


def _scores(m: Model, words: list[str]) -> np.ndarray:
    """(words, labels) emission scores."""
    if not words:
        return np.zeros((0, len(m.labels)))
    bucket, offset = _grams(words, len(m.grams))
    out = np.add.reduceat(m.grams[bucket], offset, axis=0).astype(np.float64)
    known = np.fromiter((m.lexicon.get(w, -1) for w in words), dtype=np.int64, count=len(words))
    out[known >= 0] += m.words[known[known >= 0]]
    return out


def _marginals(e: np.ndarray, lengths: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over padded scores (T, B, L); also expected transitions.

    ``lengths`` must not increase, so that the first ones are those still open.
    """
    steps, _, labels = e.shape
    x = np.exp(e - e.max(axis=2, keepdims=True))
    t = np.exp(m.transitions - m.transitions.max())
    open_at = np.searchsorted(-lengths, -np.arange(steps), side="left")
    alpha = np.zeros_like(x)
    alpha[0] = x[0] * np.exp(m.start - m.start.max())
    alpha[0] /= alpha[0].sum(axis=1, keepdims=True)
    for k in range(1, steps):
        n = open_at[k]
        a = (alpha[k - 1, :n] @ t) * x[k, :n]
        alpha[k, :n] = a / a.sum(axis=1, keepdims=True)
    beta = np.ones_like(x[0])
    gamma, pairs = alpha, np.zeros((labels, labels))
    for k in range(steps - 2, -1, -1):
        n = open_at[k + 1]
        right = x[k + 1, :n] * beta[:n]
        b = right @ t.T
        weight = alpha[k, :n, :, None] * t * right[:, None, :]
        pairs += (weight / weight.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[:n] = b / b.sum(axis=1, keepdims=True)
        # gamma shares alpha's memory: step k is no longer read below.
        g = alpha[k] * beta
        gamma[k] = g / np.maximum(g.sum(axis=1, keepdims=True), 1e-300)
    return gamma, pairs


# -- learning -------------------------------------------------------------------


def _sequences(docs: list[tuple[str, str]], rng, length: int = 48):
    """Segments of whole texts; every third is spliced with one of another text,
    so that switches between languages are seen."""
    segments = []
    for text, lang in docs:
        words = text.lower().split()
        segments += [(words[k : k + length], lang) for k in range(0, len(words), length)]
    order = rng.permutation(len(segments))
    out, k = [], 0
    while k < len(order):
        words, lang = segments[order[k]]
        tags = [lang] * len(words)
        if k % 3 == 0 and k + 1 < len(order):
            k += 1
            more, other = segments[order[k]]
            words, tags = words + more, tags + [other] * len(more)
        out.append((words, tags))
        k += 1
    return out


def fit(docs: list[tuple[str, str]], buckets: int = 1 << 16, epochs: int = 4, batch: int = 96, rate: float = 0.25, seed: int = 7) -> Model:
    """Maximum conditional likelihood by AdaGrad on (text, label) pairs."""
    rng = np.random.default_rng(seed)
    labels = sorted({lang for _, lang in docs})
    number = {x: k for k, x in enumerate(labels)}
    n_labels = len(labels)
    counts: dict[str, int] = {}
    for text, _ in docs:
        for w in text.lower().split():
            counts[w] = counts.get(w, 0) + 1
    frequent = sorted((w for w, c in counts.items() if c >= 5), key=lambda w: (-counts[w], w))[:20_000]
    m = Model(labels, np.zeros((buckets, n_labels), np.float32), {w: k for k, w in enumerate(frequent)}, np.zeros((len(frequent), n_labels), np.float32), np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    if n_labels < 2:
        return m
    squares = [np.full(p.shape, 1e-3, p.dtype) for p in (m.grams, m.words, m.transitions, m.start)]

    def step(param, square, grad):
        square += grad * grad
        param -= rate * grad / np.sqrt(square)

    for _ in range(epochs):
        seqs = _sequences(docs, rng)
        for at in range(0, len(seqs), batch):
            part = sorted(seqs[at : at + batch], key=lambda s: -len(s[0]))
            part = [s for s in part if s[0]]
            if not part:
                continue
            lengths = np.array([len(s[0]) for s in part])
            unique: dict[str, int] = {}
            ids = [[unique.setdefault(w, len(unique)) for w in s[0]] for s in part]
            words = list(unique)
            scores = _scores(m, words)
            e = np.zeros((lengths[0], len(part), n_labels))
            tags = np.zeros((lengths[0], len(part)), dtype=np.int64)
            for b, (s, k) in enumerate(zip(part, ids)):
                e[: len(k), b] = scores[k]
                tags[: len(k), b] = [number[t] for t in s[1]]
            gamma, pairs = _marginals(e, lengths, m)
            inside = np.arange(lengths[0])[:, None] < lengths
            gamma[~inside] = 0
            tt, bb = np.nonzero(inside)
            gamma[tt, bb, tags[tt, bb]] -= 1
            scale = 1.0 / lengths.sum()
            per_word = np.zeros_like(scores)
            np.add.at(per_word, np.concatenate([np.array(k) for k in ids]), np.concatenate([gamma[: len(k), b] for b, k in enumerate(ids)]))
            per_word *= scale
            bucket, offset = _grams(words, buckets)
            owner = np.repeat(np.arange(len(words)), np.diff(np.r_[offset, len(bucket)]))
            touched, where = np.unique(bucket, return_inverse=True)
            g = np.zeros((len(touched), n_labels))
            np.add.at(g, where, per_word[owner])
            sq = squares[0][touched] + (g * g).astype(np.float32)
            squares[0][touched] = sq
            m.grams[touched] -= (rate * g / np.sqrt(sq)).astype(np.float32)
            known = np.fromiter((m.lexicon.get(w, -1) for w in words), dtype=np.int64, count=len(words))
            g = np.zeros_like(m.words)
            g[known[known >= 0]] = per_word[known >= 0]
            step(m.words, squares[1], g)
            for s in part:
                for x, y in pairwise(s[1]):
                    pairs[number[x], number[y]] -= 1
            step(m.transitions, squares[2], pairs * scale)
            step(m.start, squares[3], gamma[0].sum(axis=0) * scale)
    return m


def sample(docs: DataFrame, docs_bound: int = 3000, words_bound: int = 400_000, length: int = 48) -> list[tuple[str, str]]:
    """The bounded training sample: (segment of a text, language).

    Of the labelled rows with a letter outside the held-out fold, those of about
    ``docs_bound`` ids, by a threshold on the id's hash; of their segments of
    ``length`` words as many, by hash, as hold about ``words_bound`` words. So
    texts of any length are learned from, and what comes to the driver keeps
    its size.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), fold(F.col("doc_id"), 5).alias("f"))
    chosen = sampled(rows.filter("f <> 0 and lang is not null").filter(F.col("text").rlike(r"\p{L}")), docs_bound, 1.0)
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    counted = chosen.select(F.coalesce("id", F.lit("")).alias("id"), "lang", words.alias("words"))
    total = counted.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    at = F.explode(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / length).cast("int"))).alias("at")
    cut_up = counted.filter(F.size("words") > 0).select("id", "lang", "words", at)
    key = F.pmod(F.xxhash64("id", "at", F.lit("segment")), F.lit(1_000_000))
    kept = cut_up.filter(key < int(1_000_000 * min(1.0, words_bound / max(1, total))))
    segment = F.array_join(F.slice("words", F.col("at") * length + 1, F.lit(length)), " ")
    return sorted((r["segment"], r["lang"]) for r in kept.select(segment.alias("segment"), "lang").collect())


# -- prediction -----------------------------------------------------------------


def _words(text: str) -> list[str]:
    return [w for w in text.lower().split() if w.isalpha() or has_letter(w)]


def _stretches(text: str, size: int) -> Iterator[str]:
    """The text in stretches of about ``size`` characters, cut at white space."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            m = GAP.search(text, end)
            end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def _transfer(e: np.ndarray, t: np.ndarray, side: int = 64) -> np.ndarray:
    """The product of all steps' matrices t * diag(exp(e)), scaled to a sum of one.

    Stretches of ``side`` words advance side by side, then their products are joined.
    """
    n, labels = e.shape
    x = np.exp(e - e.max(axis=1, keepdims=True))
    columns = -(-n // side)
    m = np.broadcast_to(np.eye(labels), (columns, labels, labels)).copy()
    for k in range(side):
        at = np.arange(columns) * side + k
        at = at[at < n]
        m[: len(at)] = (m[: len(at)] @ t) * x[at][:, None, :]
        m[: len(at)] /= m[: len(at)].sum(axis=(1, 2), keepdims=True)
    out = np.eye(labels)
    for one in m:
        out = out @ one
        out /= out.sum()
    return out


def _long(m: Model, text: str, size: int) -> tuple[str, float, int, int]:
    """``predict`` for one long text in memory that its length doesn't set.

    A first pass keeps what each stretch does to the forward vector, and a
    second one computes every stretch's marginals between the vectors at its ends.
    """
    t = np.exp(m.transitions - m.transitions.max())
    transfers = []
    for part in _stretches(text, size):
        words = _words(part)
        transfers.append(_transfer(_scores(m, words), t) if words else None)
    begin = np.exp(m.start - m.start.max())
    ends = [np.ones(len(m.labels))]
    for x in reversed(transfers):
        after = ends[-1] if x is None else x @ ends[-1]
        ends.append(after / after.sum())
    ends.reverse()
    a, total, n, switches, last = begin, np.zeros(len(m.labels)), 0, 0, -1
    for k, part in enumerate(_stretches(text, size)):
        words = _words(part)
        if not words:
            continue
        e = _scores(m, words)
        x = np.exp(e - e.max(axis=1, keepdims=True))
        alpha = np.empty_like(x)
        for i in range(len(x)):
            alpha[i] = a * x[i]
            alpha[i] /= alpha[i].sum()
            a = alpha[i] @ t
        beta = ends[k + 1]
        for i in range(len(x) - 1, -1, -1):
            g = alpha[i] * beta
            alpha[i] = g / g.sum()
            beta = t @ (x[i] * beta)
            beta = beta / beta.sum()
        best = alpha.argmax(axis=1)
        switches += int((np.diff(best) != 0).sum()) + (last >= 0 and last != best[0])
        total, n, last = total + alpha.sum(axis=0), n + len(x), best[-1]
    y = int(total.argmax())
    return m.labels[y], float(min(1.0, total[y] / n)), n, int(switches)


def predict(m: Model, texts: list[str | None], cells: int = 150_000, block: int = 10_000, long: int = 2_000_000) -> list[tuple[str, float, int, int]]:
    """(label, mean probability, words, switches) for each whole text.

    ``und`` with 0.0 if a text is null or has no letter. ``cells`` (words side by
    side) and ``block`` (words scored at once) trade memory for speed; a text of
    more than ``long`` characters is read in stretches of a quarter of that.
    """
    out: list[tuple[str, float, int, int]] = [(UNKNOWN, 0.0, 0, 0)] * len(texts)
    unique: dict[str, int] = {}
    todo = []
    for k, text in enumerate(texts):
        if isinstance(text, str) and m.labels and has_letter(text):
            if len(text) > long:
                out[k] = _long(m, text, max(1, long // 4))
                continue
            words = _words(text)
            todo.append((k, np.fromiter((unique.setdefault(w, len(unique)) for w in words), dtype=np.int64, count=len(words))))
    words = list(unique)
    blocks = [_scores(m, words[k : k + block]) for k in range(0, len(words), block)]
    scores = np.concatenate(blocks) if blocks else _scores(m, [])
    todo.sort(key=lambda x: -len(x[1]))
    at = 0
    while at < len(todo):
        longest = max(1, len(todo[at][1]))
        part = todo[at : at + max(1, min(512, cells // longest))]
        at += len(part)
        lengths = np.array([len(x[1]) for x in part])
        e = np.zeros((longest, len(part), len(m.labels)))
        for b, (_, ids) in enumerate(part):
            e[: len(ids), b] = scores[ids]
        gamma, _ = _marginals(e, lengths, m)
        best = gamma.argmax(axis=2)
        for b, (k, ids) in enumerate(part):
            n = len(ids)
            mean = gamma[:n, b].mean(axis=0)
            y = int(mean.argmax())
            out[k] = (m.labels[y], float(min(1.0, mean[y])), n, int((np.diff(best[:n, b]) != 0).sum()))
    return out


MODEL_BYTES = 64_000_000


def _shared(docs: DataFrame, model: Model | None):
    spark = docs.sparkSession
    ship(spark)
    m = model or fit(sample(docs))
    size = m.grams.nbytes + m.words.nbytes + sum(map(len, m.lexicon)) + 100 * len(m.lexicon)
    return broadcast_value(spark, m, size, MODEL_BYTES, "language model")


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words, switches per row of ``docs``.

    Without a model one is learned from the bounded ``sample``. Only the text is
    an input of a prediction. Null texts and those without a letter (and all, if
    nothing could be learned) are ``und`` with score 0; repeated rows give
    repeated results; an empty table gives no rows.
    """
    shared = _shared(docs, model)

    def run(batches):
        free_caches()
        for b in arrow_slices(batches, 2_000_000):
            got = predict(shared.value, b.column("text").to_pylist(), 400_000, 100_000)
            label, score, words, switches = zip(*got) if got else ((), (), (), ())
            columns = [pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(words, pa.int64()), pa.array(switches, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *columns], ["doc_id", "held_out", "lang_pred", "score", "n_words", "switches"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, n_words long, switches long")


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that ``identify`` gives a language, not ``und``.

    Texts in several languages are kept, however evenly mixed; null and empty
    texts and those without a letter go, and all do if no language could be
    learned. Whole rows, repeated ones too, pass through in their batches, so
    nothing is shuffled; an empty table stays empty.
    """
    shared = _shared(docs, model)
    at = docs.columns.index("text")

    def run(batches):
        free_caches()
        for b in arrow_slices(batches, 1_000_000):
            got = predict(shared.value, b.column(at).to_pylist())
            yield b.filter(pa.array([x[0] != UNKNOWN for x in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
