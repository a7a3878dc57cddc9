"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer reads words and phrases as insult, threat, target,
negation, report, link or other; its insults and threats are fixed ones and
stems learned from labels. Five transducers read the classes, sentence by
sentence, composed into one:

* insult and threat each match a clause of several words: a target and links
  may lead to a head, further heads and few other words may follow, and a
  target or the sentence's end closes it;
* target, negation and reported speech mark what comes within their reach.

Targets also reach back, so the target transducer reads each sentence from
either side. What comes out are clauses, each with the weights of its arcs
(learned log odds of the heads) and its marks. Only clauses are scored, a text
by their sums through weights learned from the labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_slices, broadcast_value, fold, free_caches, sampled, ship

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, LINK, STOP = range(8)
CLASSES = 8
# Fixed words of the classes, in English, French, German and Spanish.
WORDS = {
    INSULT: "idiot moron loser scum trash clown stupid pathetic worthless disgusting imbécile crétin connard minable dummkopf abschaum trottel idiota imbécil escoria",
    THREAT: "kill hurt destroy punish crush tuer frapper détruire töten vernichten schlagen matar destruir golpear",
    TARGET: "you your youre they them he she tu toi vous ils elle du dich ihr euch sie tú usted ustedes ellos ella",
    NEGATION: "not never no isnt arent dont ne pas jamais nicht kein keine nie nunca jamás tampoco",
    REPORT: "said says say told wrote quoted claimed reported dit écrit déclaré sagte sagt schrieb behauptet dijo dice escribió",
    LINK: "are is was were such so very total complete utter a an will shall should going to gonna es est êtes sont un une très si bist ist seid sind ein eine so sehr eres son muy tan voy va van",
}
# Fixed phrases that are heads as a whole.
PHRASES = {
    INSULT: ("piece of trash", "waste of space", "shut up", "go to hell", "ferme ta gueule", "halt die klappe", "vete al infierno"),
    THREAT: ("watch your back", "you will pay", "you will regret", "tu vas le payer", "das wirst du bereuen", "te vas a arrepentir"),
}
EDGE = re.compile(r"^\W+|\W+$")
GAP = re.compile(r"\s")
STEMS = (4, 5, 6, 7)


# -- transducers ------------------------------------------------------------------


NEGATED, REPORTED, AIMED, HEAD, CLOSE = 1, 2, 4, 8, 16


class Transducer(NamedTuple):
    """Deterministic: arcs[state][class] = (next state, marks)."""

    arcs: list[list[tuple[int, int]]]


def reach(opens: int, words: int, mark: int) -> Transducer:
    """Marks what comes within ``words`` words after a class; state: words left."""
    arcs = []
    for left in range(words + 1):
        row = []
        for c in range(CLASSES):
            after = words if c == opens else 0 if c == STOP else max(0, left - 1)
            row.append((after, mark if left else 0))
        arcs.append(row)
    return Transducer(arcs)


def pattern(head: int, lead: int = 2, gap: int = 2) -> Transducer:
    """Clauses around a class of heads.

    States: 0 none; 1.. a target was read and so many other words may still come
    before a head; then, within a clause, so many before its end. Links take
    nothing from either.
    """
    led = lambda left: 1 + left
    within = lambda left: 2 + lead + left
    arcs = []
    for state in range(3 + lead + gap):
        inside = state >= within(0)
        left = state - within(0) if inside else state - 1
        row = []
        for c in range(CLASSES):
            if c == head:
                to, marks = within(gap), HEAD | (AIMED if 1 <= state < within(0) else 0)
            elif c == STOP:
                to, marks = 0, CLOSE * inside
            elif c == TARGET:
                to, marks = led(lead), (CLOSE | AIMED) * inside
            elif c in (LINK, NEGATION):
                to, marks = state, 0
            elif inside:
                to, marks = (within(left - 1), 0) if left else (0, CLOSE)
            else:
                to, marks = (led(left - 1) if left > 0 else 0), 0
            row.append((to, marks))
        arcs.append(row)
    return Transducer(arcs)


def compose(parts: list[Transducer]) -> tuple[list[list[int]], list[list[tuple[int, ...]]]]:
    """The product of transducers that read the same classes: next state and each
    part's marks, by state and class; only states that can be reached."""
    number: dict[tuple[int, ...], int] = {(0,) * len(parts): 0}
    after, marks = [], []
    todo = [(0,) * len(parts)]
    for states in todo:
        to, out = [], []
        for c in range(CLASSES):
            steps = [p.arcs[s][c] for p, s in zip(parts, states)]
            key = tuple(s for s, _ in steps)
            if key not in number:
                number[key] = len(number)
                todo.append(key)
            to.append(number[key])
            out.append(tuple(m for _, m in steps))
        after.append(to)
        marks.append(out)
    return after, marks


KINDS = (INSULT, THREAT)
FORWARD = compose([pattern(INSULT), pattern(THREAT), reach(NEGATION, 3, NEGATED), reach(REPORT, 12, REPORTED), reach(TARGET, 5, AIMED)])
BACKWARD = compose([reach(TARGET, 5, AIMED)])


class Clause(NamedTuple):
    kind: int
    first: int  # place of the first head, among classes
    last: int
    marks: int
    weight: float


def clauses(classes: list[int], weights: list[float] | None = None) -> list[Clause]:
    """The clauses of a text; a sentence's STOP ends them and all reach."""
    w = weights or [1.0] * len(classes)
    after, marks = BACKWARD
    state, behind = 0, [0] * len(classes)
    for k in range(len(classes) - 1, -1, -1):
        behind[k] = marks[state][classes[k]][0]
        state = after[state][classes[k]]
    after, marks = FORWARD
    state, out = 0, []
    current: list[list | None] = [None, None]
    for k, c in enumerate(classes):
        *patterns, negated, reported, aimed = marks[state][c]
        state = after[state][c]
        for i, m in enumerate(patterns):
            if m & HEAD:
                here = current[i] = current[i] or [k, k, 0, 0.0]
                here[1], here[3] = k, here[3] + w[k]
                here[2] |= negated | reported | aimed | behind[k] | m & AIMED
            elif m & CLOSE and current[i]:
                first, last, held, total = current[i]
                out.append(Clause(KINDS[i], first, last, held | m & AIMED, total))
                current[i] = None
    for i, here in enumerate(current):
        if here:
            out.append(Clause(KINDS[i], *here))
    return sorted(out, key=lambda x: (x.first, x.kind))


# -- lexicon ------------------------------------------------------------------------


class Grammar(NamedTuple):
    words: dict[str, tuple[int, float]]  # word to class and weight of its arc
    stems: dict[str, float]  # stems of learned insults
    shape: np.ndarray  # weights of a text's features


def _bare(word: str) -> str:
    return EDGE.sub("", word).replace("'", "").replace("’", "")


def learn_lexicon(texts: list[tuple[str, int]], support: int = 5, share: float = 0.9):
    """Words and stems that hold to toxic texts. A text counts once, and only for
    lines not seen before, so that copies of one text are no further evidence.
    A word or stem must be in ``support`` toxic texts (a sixtieth of them, if
    more) and in toxic ones for a ``share`` of its texts."""
    seen: set[str] = set()
    toxic, total = Counter(), Counter()
    fixed = {w for ws in WORDS.values() for w in ws.split()}
    support = max(support, sum(label for _, label in texts) // 60)
    for text, label in texts:
        found = set()
        for line in text.lower().split("\n"):
            if line in seen:
                continue
            seen.add(line)
            for w in {_bare(x) for x in line.split()}:
                found.add(w)
                if w not in fixed:  # a stem must be of more than a fixed word
                    found.update(w[:n] + "*" for n in STEMS if len(w) >= n)
        total.update(found)
        if label:
            toxic.update(found)
    good = lambda f: toxic[f] >= support and (toxic[f] + 0.5) / (total[f] + 1) >= share
    weight = lambda f: math.log((toxic[f] + 0.5) / (total[f] - toxic[f] + 0.5))
    words = {w: (c, 1.0) for c, ws in WORDS.items() for w in ws.split()}
    # Fixed heads that the labels speak against lose their class.
    for w in [w for w, (c, _) in words.items() if c in KINDS and total[w] >= support]:
        if toxic[w] / total[w] < 0.5:
            del words[w]
        else:
            words[w] = (words[w][0], weight(w))
    stems: dict[str, float] = {}
    for n in STEMS:
        for f in sorted(f for f in total if len(f) == n + 1 and f[-1] == "*" and good(f)):
            if not any(f[:k] in stems for k in STEMS if k < n):
                stems[f[:-1]] = weight(f)
    for f in total:
        if f and f[-1] != "*" and good(f) and f not in words and not any(f[:k] in stems for k in STEMS):
            words[f] = (INSULT, weight(f))
    return words, stems


def _phrases() -> dict[str, list[tuple[tuple[str, ...], int]]]:
    """Phrases by first word, the longest first."""
    out: dict[str, list[tuple[tuple[str, ...], int]]] = {}
    for c, several in PHRASES.items():
        for words in sorted((tuple(x.split()) for x in several), key=len, reverse=True):
            out.setdefault(words[0], []).append((words, c))
    return out


BY_FIRST = _phrases()
#: Words that phrases end in; a text without any, and without heads, has no clause.
ENDS = {words[-1] for several in BY_FIRST.values() for words, _ in several}


def _reader(g: Grammar, most: int = 300_000):
    """Word to (class, weight, ends a sentence, may give a clause), in a bounded cache."""
    cache: dict[str, tuple[int, float, bool, bool]] = {}

    def read(raw: str) -> tuple[int, float, bool, bool]:
        got = cache.get(raw)
        if got is None:
            w = _bare(raw)
            c, x = g.words.get(w, (OTHER, 0.0))
            if c in (OTHER, LINK):
                x = next((g.stems[w[:n]] for n in STEMS if w[:n] in g.stems and len(w) >= n), 0.0)
                c = INSULT if x else c
            got = (c, x, raw[-1] in ".!?", c in KINDS or w in ENDS)
            if len(cache) >= most:
                cache.clear()
            cache[raw] = got
        return got

    return read


def _classes(read, raw: list[str]) -> tuple[list[int], list[float]]:
    """The lexicon transducer: words and phrases to classes and weights."""
    classes, weights, at = [], [], 0
    while at < len(raw):
        c, x, stop, _ = read(raw[at])
        size = 1
        for words, kind in BY_FIRST.get(_bare(raw[at]), ()):
            if tuple(map(_bare, raw[at : at + len(words)])) == words:
                c, x, size, stop = kind, 1.0, len(words), read(raw[at + len(words) - 1])[2]
                break
        classes.append(c)
        weights.append(x)
        if stop:
            classes.append(STOP)
            weights.append(0.0)
        at += size
    return classes, weights


N_FEATURES = 8
#: Characters of a text whose words are held at once.
STRETCH = 1 << 20


def features(read, text: str | None) -> tuple[np.ndarray, int]:
    """A text's features, all from its clauses, and the number of clauses.

    Texts are read in stretches that end where a word does.
    """
    out = np.zeros(N_FEATURES)
    out[0] = 1.0
    n_words = n_clauses = at = 0
    text = text if isinstance(text, str) else ""
    while at < len(text):
        m = GAP.search(text, at + STRETCH) if at + STRETCH < len(text) else None
        end = m.start() if m else len(text)
        raw, at = text[at:end].lower().split(), end
        n_words += len(raw)
        if not any(read(w)[3] for w in raw):
            continue
        for clause in clauses(*_classes(read, raw)):
            x = max(0.2, clause.weight)
            n_clauses += 1
            out[1] += x
            out[2] += x * bool(clause.marks & AIMED)
            out[3] += x * bool(clause.marks & NEGATED)
            out[4] += x * bool(clause.marks & REPORTED)
            out[5] += x * (clause.kind == THREAT)
    if n_clauses:
        out[6] = 1.0
        out[7] = math.log1p(n_clauses / n_words * 100)
        out[1:6] = np.log1p(out[1:6])
    return out, n_clauses


def fit(texts: list[tuple[str, int]], rounds: int = 400, rate: float = 0.3, ridge: float = 1e-4) -> Grammar:
    """The lexicon, and a logistic regression of the labels on clause features."""
    words, stems = learn_lexicon(texts)
    g = Grammar(words, stems, np.zeros(N_FEATURES))
    if texts:
        read = _reader(g)
        x = np.array([features(read, t)[0] for t, _ in texts])
        y = np.array([label for _, label in texts], dtype=float)
        square = np.full(N_FEATURES, 1e-6)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ g.shape, -30, 30)))
            grad = x.T @ (p - y) / len(y) + ridge * g.shape
            square += grad * grad
            g.shape[:] -= rate * grad / np.sqrt(square)
    else:
        g.shape[:] = [-3, 1, 1, -1, -1, 0, 2, 0]
    return g


def sample(docs: DataFrame, labels: DataFrame, rows_bound: int = 6000, bytes_bound: int = 32_000_000) -> list[tuple[str, int]]:
    """The bounded training sample: labelled texts outside the held-out fold, of
    about ``rows_bound`` ids, by a threshold on the id's hash.

    Texts are learned from whole. Where they hold more than ``bytes_bound``
    characters in all, fewer ids are taken, so that what comes to the driver
    keeps its size.
    """
    known = labels.filter("toxic is not null").select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    known = known.filter(fold(F.col("_id"), 4) != 2).withColumn("id", F.col("_id").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("_text"))
    rows = rows.filter((fold(F.col("_doc"), 4) != 2) & F.col("_text").isNotNull())
    wanted = rows_bound
    while True:
        first = sampled(known, wanted, 1.0).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
        # About rows_bound rows of two numbers are broadcast, so no text is shuffled.
        got = rows.join(F.broadcast(first), F.col("_doc") == F.col("_id"))
        size = got.agg(F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()[0]
        if size <= bytes_bound or wanted <= 1:
            break
        wanted = max(1, int(0.9 * wanted * bytes_bound / size))
    return sorted((r["_text"], r["_toxic"]) for r in got.select("_text", "_toxic").distinct().collect())


GRAMMAR_BYTES = 32_000_000


def score(docs: DataFrame, labels: DataFrame | None = None, grammar: Grammar | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, n_clauses for each row of ``docs``.

    Only the text is an input of a score. Null and empty texts have no clause
    and score low; repeated rows give repeated results; an empty table gives no
    rows, and without any label the fixed words and weights stand.
    """
    spark = docs.sparkSession
    ship(spark)
    g = grammar or fit(sample(docs, labels) if labels is not None else [])
    shared = broadcast_value(spark, g, sum(100 + len(w) for w in (*g.words, *g.stems)), GRAMMAR_BYTES, "grammar")

    def run(batches):
        free_caches()
        g = shared.value
        read = _reader(g)
        for b in arrow_slices(batches):
            got = [features(read, t.as_py()) for t in b.column("text")]
            x = np.array([f for f, _ in got]).reshape(-1, N_FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ g.shape, -30, 30)))
            columns = [pa.array(p), pa.array((p >= 0.3).astype(np.int32)), pa.array([n for _, n in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *columns], ["doc_id", "held_out", "score", "predicted", "n_clauses"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_clauses long")
