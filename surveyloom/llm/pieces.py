"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Compiled from a model file and composed with each input:

* the normaliser, a deterministic transducer: the model's character map by
  longest match, white space trimmed and joined, the space written U+2581;
* the lexicon, whose arcs read a piece and write its id, weighing minus its
  score;
* the byte fallback, whose arcs read a character that no piece is and write the
  ids of its bytes, at a weight beyond all pieces';
* for BPE models, neighbours: an acceptor over ids whose state is the last piece
  and that weighs infinity where merging two pieces' text would not end in
  just these two.

Encoding is the shortest path of the composition in the tropical semiring (min,
plus). A unigram model's paths are relaxed position by position. Of a BPE
model's paths only one has a finite weight, the merges' own result, so the
search goes on from the longest arc and ends at the first path that arrives.

Pieces of white space alone are equal in score and merge from the left, which
gives each run its one path. No other piece holds U+2581 after another
character (checked when compiling), so the composition falls apart into runs and
words, whose shortest paths are kept in a cache of bounded bytes.
"""

from __future__ import annotations

import re
import string
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from sys import getsizeof
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HELD, arrow_slices, broadcast_value, free_caches, ship

SPACE = "▁"
#: Letters, and what a word may end in; between the two a part ends if no piece spans them.
LETTER = "[A-Za-zÀ-ÿ]"
ENDS = string.punctuation
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
INFINITY = float("inf")


# -- the model file -------------------------------------------------------


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Model(NamedTuple):
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    unk_id: int
    dummy_prefix: bool
    trim_spaces: bool
    escape_spaces: bool
    character_map: dict[bytes, bytes]


def read_model(data: bytes) -> Model:
    pieces, trainer, normaliser = [], {}, {}
    for k, v in _fields(data):
        if k == 1:
            f = dict(_fields(v))
            pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif k == 2:
            trainer = dict(_fields(v))
        elif k == 3:
            normaliser = dict(_fields(v))
    kind = trainer.get(3, UNIGRAM)
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models have a transducer here")
    return Model(
        pieces, kind, bool(trainer.get(35, 0)), trainer.get(40, 0),
        bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), bool(normaliser.get(5, 1)),
        character_map(normaliser.get(2, b"")),
    )


def character_map(blob: bytes) -> dict[bytes, bytes]:
    """Sources and targets (UTF-8) of a model's compiled character map.

    The file holds the length of a double array, its 32-bit units and the
    zero-ended targets. A unit's child by a byte lies at the unit's offset xor
    that byte, if the unit there has that label; a child by zero holds a value,
    where the target begins.
    """
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units = struct.unpack_from(f"<{size // 4}I", blob, 4)
    targets = blob[4 + size :]
    # Fixed format of a unit: bits 0-7 label, 8 has a value, 9 shift, 10-30 offset, 31 is a value.
    offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
    out: dict[bytes, bytes] = {}
    todo = [(0 ^ offset(units[0]), b"")]
    while todo:
        at, source = todo.pop()
        for label in range(256):
            k = at ^ label
            if k >= len(units):
                continue
            u = units[k]
            if label == 0:
                if u >> 31 and source:
                    start = u & 0x7FFFFFFF
                    out[source] = targets[start : targets.index(b"\0", start)]
            elif u & 0x800000FF == label:
                todo.append((k ^ offset(u), source + bytes([label])))
    return out


# -- transducers --------------------------------------------------------------


class Arc(NamedTuple):
    length: int  # characters read
    out: tuple[int, ...]  # ids written
    weight: float
    state: int  # the piece, or -1 for a character's fallback


class Normaliser:
    """A deterministic transducer from text to normalised text.

    Its first part rewrites the longest source of the character map at each
    place; its second has three states (at the start, after a space, within a
    word) and writes a space only when a word follows.
    """

    def __init__(self, m: Model):
        self.prefix, self.trim = m.dummy_prefix, m.trim_spaces
        self.space = SPACE if m.escape_spaces else " "
        decoded = {k.decode("utf-8", "replace"): v.decode("utf-8", "replace") for k, v in m.character_map.items()}
        self.map = decoded
        # A map of single characters to be kept in no context is a homomorphism.
        self.one = {ord(k): v for k, v in decoded.items()} if all(len(k) == 1 for k in decoded) else None
        self.longest = max(map(len, decoded), default=0)

    def rewrite(self, text: str) -> str:
        if self.one is not None:
            return text.translate(self.one) if self.one else text
        out, at, get = [], 0, self.map.get
        while at < len(text):
            for n in range(min(self.longest, len(text) - at), 0, -1):
                to = get(text[at : at + n])
                if to is not None:
                    out.append(to)
                    at += n
                    break
            else:
                out.append(text[at])
                at += 1
        return "".join(out)

    def __call__(self, text: str) -> str:
        text = self.rewrite(text)
        if self.trim:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (" " + text if self.prefix else text).replace(" ", self.space)


class Lexicon:
    """One state; an arc for each piece and, where no piece is that character, for its
    bytes or as unknown."""

    def __init__(self, m: Model):
        self.ids = {p: i for i, (p, _, k) in enumerate(m.pieces) if k in (NORMAL, USER)}
        scores = [s for _, s, k in m.pieces if k in (NORMAL, USER)]
        self.weight = array("f", [-s for _, s, _ in m.pieces])
        self.worst = 10.0 - min(scores, default=0.0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(m.pieces) if k == BYTE} if m.byte_fallback else {}
        self.unknown = m.unk_id
        self.longest = max(map(len, self.ids), default=1)
        #: The pieces as a tree of characters. Under "" a node has the lengths and ids of
        #: the arcs on the way to it, of which the first reads one character.
        self.tree: dict[str, dict | tuple] = {"": ((1, -1),)}
        for p in sorted(self.ids):
            node = self.tree
            for n, c in enumerate(p, 1):
                if c not in node:
                    k = self.ids.get(p[:n])
                    node[c] = {"": node[""] if k is None else ((n, k),) if n == 1 else (*node[""], (n, k))}
                node = node[c]

    def fallback(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in char.encode("utf-8", "surrogatepass")) if self.bytes else (self.unknown,)

    def arcs(self, text: str, at: int) -> Iterator[Arc]:
        """The arcs that read ``text`` from ``at``, the longest first."""
        get = self.ids.get
        for n in range(min(self.longest, len(text) - at), 0, -1):
            k = get(text[at : at + n])
            if k is not None:
                yield Arc(n, (k,), self.weight[k], k)
            elif n == 1:
                yield Arc(1, self.fallback(text[at]), self.worst, -1)


class Anything:
    """The acceptor of a unigram model: one state, no weight."""

    def weight(self, state: int, arc: Arc) -> tuple[float, int]:
        return 0.0, 0


class Neighbours:
    """The acceptor of a BPE model; its state is the last piece, or -1 after none.

    Compiled pair by pair, as inputs need them, from the model's merges.
    """

    def __init__(self, m: Model, lexicon: Lexicon, pairs: int = 100_000):
        self.text = [p for p, _, _ in m.pieces]
        self.ids, self.rank, self.pairs = lexicon.ids, lexicon.weight, pairs
        self.known: dict[int, bool] = {}
        self.ends: dict[int, list[tuple[float, str, str]] | None] = {}

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short text: the best pair first, of equals the left."""
        return self._merges(text, [])

    def _merges(self, text: str, steps: list[tuple[float, str, str]]) -> list[str]:
        """``merged``; adds each merge's rank and the first and last part after it to ``steps``."""
        parts, ids, rank = list(text), self.ids, self.rank
        while len(parts) > 1:
            best, at = INFINITY, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and rank[i] < best:
                    best, at = rank[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((best, parts[0], parts[-1]))
        return parts

    def _ends(self, x: int) -> list[tuple[float, str, str]] | None:
        """The merges that make a piece of its characters, or None if they don't."""
        steps: list[tuple[float, str, str]] = []
        self.ends[x] = got = steps if len(self._merges(self.text[x], steps)) == 1 else None
        return got

    def _stay_apart(self, x: int, y: int) -> bool:
        """Whether the merges of two pieces' text end in just these two.

        Until a merge takes the last part of one and the first of the other, both
        go on as they would alone, and the better next merge comes first.
        """
        ends, ids, rank = self.ends, self.ids, self.rank
        one = ends[x] if x in ends else self._ends(x)
        other = ends[y] if y in ends else self._ends(y)
        if one is None or other is None:
            return False
        i, j, last, first = 0, 0, self.text[x][-1], self.text[y][0]
        r, q = one[0][0] if one else INFINITY, other[0][0] if other else INFINITY
        while True:
            k = ids.get(last + first)
            if k is not None and rank[k] < r and rank[k] <= q:
                return False
            if r <= q:
                if r == INFINITY:
                    return True
                last, i = one[i][2], i + 1
                r = one[i][0] if i < len(one) else INFINITY
            else:
                first, j = other[j][1], j + 1
                q = other[j][0] if j < len(other) else INFINITY

    def follows(self, x: int, y: int) -> bool:
        key = x << 24 | y
        got = self.known.get(key)
        if got is None:
            if len(self.known) >= self.pairs:
                self.known.clear()
            got = self.known[key] = self._stay_apart(x, y)
        return got

    def weight(self, state: int, arc: Arc) -> tuple[float, int]:
        """The weight of reading an arc's ids, and the state after them."""
        y = arc.state
        return (0.0 if state < 0 or y < 0 or self.follows(state, y) else INFINITY), y


def shortest_path(text: str, lexicon: Lexicon, acceptor, state: int = -1) -> tuple[float, tuple[int, ...]]:
    """Weight and ids of the lightest path of text, lexicon and acceptor composed.

    States are (characters read, acceptor's state); arcs only lead on, so one
    pass over the positions relaxes all. Of equal paths the first found holds,
    which has the longer last arcs.
    """
    best: list[dict[int, tuple[float, int, int, tuple[int, ...]]]] = [{} for _ in range(len(text) + 1)]
    best[0][state] = (0.0, -1, -1, ())
    for at in range(len(text)):
        arcs = list(lexicon.arcs(text, at)) if best[at] else []
        for s, (cost, *_) in best[at].items():
            for arc in arcs:
                w, to = acceptor.weight(s, arc)
                total = cost + arc.weight + w
                if total < best[at + arc.length].get(to, (INFINITY,))[0]:
                    best[at + arc.length][to] = (total, at, s, arc.out)
    if not best[-1]:
        return INFINITY, ()
    at, s = len(text), min(best[-1], key=lambda k: best[-1][k][0])
    total, out = best[at][s][0], []
    while at:
        _, at, s, ids = best[at][s]
        out.append(ids)
    return total, tuple(k for ids in reversed(out) for k in ids)


class Paths(dict):
    """Ids of parts as bytes, made when they are first asked for, within ``held`` bytes.

    Two generations, so that frequent parts outlive a full cache. A part that is
    held is found without a call.
    """

    def __init__(self, path, held: int):
        self.path, self.old = path, {}
        self.room = self.half = held // 2

    def __missing__(self, part: str) -> bytes:
        got = self.old.get(part) or array("i", self.path(part)).tobytes()
        if len(part) <= 48:
            # A string, a bytes object and their place in a table.
            self.room -= 80 + getsizeof(part) + getsizeof(got)
            if self.room < 0:
                self.old = dict(self)
                self.clear()
                self.room = self.half
            self[part] = got
        return got


class Transducer:
    """The composition, with a cache of ``held`` bytes for the paths of its parts."""

    def __init__(self, data: bytes, held: int = 30_000_000):
        self.model = m = read_model(data)
        self.text = [p for p, _, _ in m.pieces]
        self.kinds = [k for _, _, k in m.pieces]
        self.normalise = Normaliser(m)
        self.lexicon = x = Lexicon(m)
        self.bpe = m.kind == BPE
        self.acceptor = Neighbours(m, x) if self.bpe else Anything()
        self.longest_run = max((len(p) for p in x.ids if not p.strip(SPACE)), default=1)
        if any(SPACE in p.lstrip(SPACE) for p in x.ids):
            raise ValueError("a piece holds a space after another character")
        # A character outside all pieces ends a path's part, as no arc spans it.
        inside = set("".join(x.ids))
        loose = "".join(re.escape(c) for c in "\n\t\r" if c not in inside)
        # Nor does one span a letter and any of these characters that no piece has after one.
        after = {c for p in x.ids for c in re.findall(f"(?<={LETTER})[{re.escape(ENDS)}]", p)}
        ends = "".join(re.escape(c) for c in ENDS if c not in after)
        stop = f"{SPACE}*+{LETTER}++(?=[{ends}])|" if ends else ""
        self.parts = re.compile(f"{stop}{SPACE}+[^{SPACE}{loose}]*|[^{SPACE}{loose}]+" + (f"|[{loose}]" if loose else "")).findall
        self.paths = Paths(self.path, held)
        #: What pieces are read back as; None if that isn't told by the piece alone. A
        #: byte below 128 is, as it ends any character begun before it.
        read = lambda p: p.replace(SPACE, " ") if m.escape_spaces else p
        ascii_byte = lambda p: chr(int(p[3:5], 16)) if int(p[3:5], 16) < 128 else None
        self.plain = [
            ascii_byte(p) if k == BYTE else None if k in (CONTROL, UNKNOWN) else read(p) for p, k in zip(self.text, self.kinds)
        ]
        self.plain_arrow = pa.array(self.plain, pa.string())

    # -- encoding -------------------------------------------------------------

    def _only_path(self, word: str) -> list[int]:
        """The one path of finite weight: always the longest arc that leads on.

        A beginning of the word has one such path, too, so a place from which
        none leads to the end is dead for good.
        """
        tree, known, follows = self.lexicon.tree, self.acceptor.known.get, self.acceptor.follows
        n, at, state, left = len(word), 0, -1, None
        dead, trail = bytearray(n + 1), []
        while at < n:
            if left is None:
                node = tree
                for c in word[at:]:
                    longer = node.get(c)
                    if longer is None:
                        break
                    node = longer
                arcs = node[""]
                left = len(arcs)
            while left:
                left -= 1
                size, k = arcs[left]
                if dead[at + size]:
                    continue
                if state >= 0 and k >= 0:
                    follow = known(state << 24 | k)
                    if not (follows(state, k) if follow is None else follow):
                        continue
                trail.append((at, state, arcs, left, k))
                at, state, left = at + size, k, None
                break
            else:
                dead[at] = 1
                at, state, arcs, left, _ = trail.pop()
        out: list[int] = []
        for at, _, _, _, k in trail:
            if k >= 0:
                out.append(k)
            else:
                out.extend(self.lexicon.fallback(word[at]))
        return out

    def path(self, part: str) -> list[int]:
        """Ids of a part: a run of spaces and a word, either of which may be empty."""
        if not self.bpe:
            return list(shortest_path(part, self.lexicon, self.acceptor, 0)[1])
        word = part.lstrip(SPACE)
        run = len(part) - len(word)
        if not run or run == 1 and word:
            return self._only_path(part)
        # The last space of a run belongs to the word if a merge takes it.
        path = self._only_path(SPACE + word) if word else self._only_path(SPACE)
        if path[0] != self.lexicon.ids.get(SPACE):
            run -= 1
        else:
            path = path[1:]
        return self._run_path(run) + path if run else path

    def _run_path(self, n: int) -> list[int]:
        """A run of spaces grows from the left; what is full there stays so."""
        most, ids = self.longest_run, self.lexicon.ids
        full = max(0, n // most - 2) if most > 1 else n
        return [ids[SPACE * most]] * full + [ids[p] for p in self.acceptor.merged(SPACE * (n - most * full))]

    def encode_bytes(self, text: str) -> bytes:
        """The ids as native 32-bit integers in a row."""
        return b"".join(map(self.paths.__getitem__, self.parts(self.normalise(text))))

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_bytes(text)).tolist()

    # -- decoding -------------------------------------------------------------

    def decode(self, ids) -> str:
        """The inverse transducer: pieces, runs of bytes, then spaces."""
        out = list(map(self.plain.__getitem__, ids))
        text = "".join(self._special(ids) if None in out else out)
        if self.model.escape_spaces and None in out:
            text = text.replace(SPACE, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def decode_rows(self, rows: pa.ListArray) -> pa.Array:
        """``decode`` of each row; one that holds pieces not read back by themselves goes alone."""
        read = self.plain_arrow.take(rows.values)
        text = pc.binary_join(pa.ListArray.from_arrays(rows.offsets, read), "")
        if self.model.dummy_prefix:
            text = pc.replace_substring_regex(text, r"\A ", "", max_replacements=1)
        if not text.null_count:
            return text
        alone = pc.is_null(text)
        made = [self.decode(x) for x in rows.filter(alone).to_pylist()]
        return pc.replace_with_mask(text, alone, pa.array(made, pa.string()))

    def _special(self, ids) -> list[str]:
        out, pending = [], bytearray()
        for k in ids:
            if self.kinds[k] == BYTE:
                pending.append(int(self.text[k][3:5], 16))
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            if self.kinds[k] != CONTROL:
                out.append(" ⁇ " if self.kinds[k] == UNKNOWN else self.text[k])
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return out


@lru_cache(1)
def _compiled(data: bytes, held: int) -> Transducer:
    return Transducer(data, held)


HELD["pieces"] = _compiled.cache_clear


# -- the operator -------------------------------------------------------------

#: Bound on a model file that is broadcast.
MODEL_BYTES = 32_000_000


def encode_decode(docs: DataFrame, model: str = DEFAULT_MODEL, held: int = 30_000_000) -> DataFrame:
    """doc_id, n_ids, ids, decoded, reversible for each row of ``docs``.

    ids encode the whole text, decoded is read back from them, and reversible
    says whether it equals the text; what the normaliser changes makes a
    difference (with this model a literal U+2581, which it takes for a space).
    A null or empty text has no ids and is read back empty. Repeated rows give
    repeated results, an empty table none; other columns play no part. The
    model file is read by the driver alone and broadcast, its size checked.
    ``held`` bounds the bytes of paths that a worker keeps; it changes speed alone.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(model, "rb") as f:
        data = f.read()
    shared = broadcast_value(spark, data, len(data), MODEL_BYTES, "model file")

    def run(batches):
        free_caches(keep="pieces")
        t = _compiled(shared.value, held)
        for b in arrow_slices(batches, 1_000_000):
            texts = [x or "" for x in b.column("text").to_pylist()]
            raw = [t.encode_bytes(x) for x in texts]
            offsets = array("i", [0])
            for x in raw:
                offsets.append(offsets[-1] + len(x) // 4)
            values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(raw))])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            decoded = t.decode_rows(ids)
            same = pc.equal(decoded, pc.fill_null(b.column("text"), ""))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) // 4 for x in raw], pa.int64()), ids, decoded, same],
                ["doc_id", "n_ids", "ids", "decoded", "reversible"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, ids array<int>, decoded string, reversible boolean")
