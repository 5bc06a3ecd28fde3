"""SentencePiece encoding and decoding by weighted finite-state transduction.

A model file is compiled to three transducers: the normaliser (space to the
meta symbol, an optional leading one), the pieces (a trie whose arcs read
characters and write a piece), and byte fallback (an arc of every other
character to its UTF-8 byte pieces). An input is composed with them lazily,
position by position, and its encoding is the tropical shortest path of the
lattice.

For unigram models an arc weighs minus the score of its piece. Scores of BPE
models are ranks of merges and do not add up, so there the lattice is composed
with one more machine over pairs of neighbouring pieces, of weight 0 where
merging the two pieces' characters by rank gives back exactly these two, and
infinite otherwise. A sequence is the BPE encoding if and only if all its
neighbouring pairs pass: merges inside a piece do not depend on what stands
beside it until a merge crosses a border, and the first one that would cross
shows in the pair alone. Each position of the lattice then has one live state.

Between two characters that no piece has side by side every path has a border.
Where the pieces allow it (checked when the model is compiled, otherwise texts
stay whole) a text is therefore cut before runs of meta symbols, after runs of
letters and around control characters but the carriage return, and equal parts are composed once a
task, in a cache of bounded size.

Only models whose normaliser is the identity are compiled; others are refused.

Defined results. Null text: null ids. Empty text: no ids. Texts of any length
are encoded whole. Control pieces are never produced from text. Decoding undoes
encoding but for what the model itself loses: a meta symbol in the text becomes
a space. Repeated rows, empty tables and further columns pass unchanged.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: the meta symbol and the kinds of pieces.
META = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Words a generation of the cache holds (two are kept), pairs of pieces kept, and longest word kept. Every Python
#: worker of an executor has caches of its own; fewer words take less memory and more time.
CACHE = 300_000
PAIRS = 300_000
LONGEST_KEPT = 64
#: Documents whose ids are held at once.
SLICE = 128
#: Where the driver finds the model; the file's bytes go along with the tasks.
MODEL_PATH = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, raw[at:at + size]
            at += size


@dataclass
class Transducer:
    """The compiled model; ``encode`` composes and finds the shortest path."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model: int
    dummy: bool = True
    squeeze: bool = False
    ids: dict[str, int] = field(default_factory=dict)
    trie: dict = field(default_factory=dict)
    byte_ids: list[int] = field(default_factory=list)
    unknown: int = 0
    parts: re.Pattern | None = None
    plain: list[bytes] = field(default_factory=list)
    pairs: dict[int, bool] = field(default_factory=dict)
    words: dict[str, bytes] = field(default_factory=dict)
    older: dict[str, bytes] = field(default_factory=dict)
    inner: set[str] = field(default_factory=set)
    halves: dict[str, tuple[str, str]] = field(default_factory=dict)
    edges: tuple[dict, dict] = field(default_factory=lambda: ({}, {}))
    longest: int = 0
    least: float = 0.0
    room: int = CACHE

    @classmethod
    def compile(cls, raw: bytes) -> Transducer:
        pieces, scores, kinds = [], [], []
        model, dummy, squeeze, charsmap = UNIGRAM, True, True, b""
        for number, value in _fields(raw):
            if number == 1:
                part = dict(_fields(value))
                pieces.append(part[1].decode())
                scores.append(float(np.frombuffer(part.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(part.get(3, NORMAL))
            elif number == 2:
                model = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                part = dict(_fields(value))
                dummy, squeeze, charsmap = bool(part.get(3, 1)), bool(part.get(4, 1)), part.get(2, b"")
        if model not in (UNIGRAM, BPE) or charsmap:
            raise ValueError("only unigram and BPE models with the identity normaliser are compiled")
        made = cls(pieces, scores, kinds, model, dummy, squeeze)
        made._build()
        return made

    def _build(self) -> None:
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)]
        self.ids = {self.pieces[i]: i for i in usable}
        self.byte_ids = [-1] * 256
        for i, k in enumerate(self.kinds):
            if k == BYTE:
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
            elif k == UNKNOWN:
                self.unknown = i
        # BPE pieces that merging never reaches from their characters are on no path
        reached = usable if self.model == UNIGRAM else [i for i in usable if len(self.merged(self.pieces[i])) == 1]
        # a node holds its children and, where a piece ends, the piece
        for i in reached:
            kids, chars = self.trie, self.pieces[i]
            for at, char in enumerate(chars, 1):
                below, piece = kids.get(char, ({}, None))
                kids[char] = (below, i if at == len(chars) else piece)
                kids = below
        self.longest = max((len(self.pieces[i]) for i in reached), default=0)
        self.inner = {c for p in self.ids if len(p) > 1 for c in p}
        # where no piece reaches across, texts are cut: the finest rule whose borders all hold
        self.parts = next((r for r in (_FINE, _COARSE) if all(len(r.findall(p)) == 1 for p in self.ids)), None)
        self.plain = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " \u2047 ".encode() if k == UNKNOWN
            else p.replace(META, " ").encode() for p, k in zip(self.pieces, self.kinds)
        ]
        self.least = min((self.scores[i] for i in usable), default=0.0) - 10.0

    # ------------------------------------------------------------- the machines

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (META if self.dummy else "") + text.replace(" ", META)

    def fallback(self, char: str) -> list[int]:
        """What the fallback machine writes for a character without a piece."""
        if self.byte_ids[0] < 0:
            return [self.unknown]
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    def arcs(self, line: str, at: int) -> list[tuple[int, int]]:
        """(end, piece) of the arcs that leave a position; fallback (-1) where its character has none."""
        found, kids, end = [], self.trie, at
        for char in line[at:at + self.longest]:
            node = kids.get(char)
            if node is None:
                break
            end += 1
            kids, piece = node
            if piece is not None:
                found.append((end, piece))
        if not found or found[0][0] != at + 1:
            found.insert(0, (at + 1, -1))
        return found

    def merged(self, line: str) -> list[str]:
        """Characters joined by rank, best first and leftmost of equals: what a pair is tested by."""
        parts: list[str | None] = list(line)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str]] = []
        last = None

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts):
                both = parts[i] + parts[j]
                if both in self.ids:
                    heapq.heappush(queue, (-self.scores[self.ids[both]], i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, both = heapq.heappop(queue)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != both:
                continue
            last = parts[i], parts[j]
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        out = [p for p in parts if p is not None]
        if len(out) == 1 and last:
            self.halves[line] = last
        return out

    def _rank(self, piece: str) -> float:
        """When a piece is merged; never for a character."""
        return -self.scores[self.ids[piece]] if len(piece) > 1 else -float("inf")

    def _edge(self, piece: str, side: int) -> list[tuple[str, float]] | None:
        """What stands at the left (0) or right (1) end of a piece while it is merged, each with the rank that consumes it.

        None if a merge inside has no better rank than a later one: only then are ranks not the order of time.
        """
        known = self.edges[side]
        if piece not in known:
            out = [(piece, float("inf"))]
            todo = [piece]
            while todo:
                whole = todo.pop()
                if len(whole) == 1:
                    continue
                parts = self.halves.get(whole)
                if parts is None or max(map(self._rank, parts)) >= self._rank(whole):
                    out = None
                    break
                todo += parts
                if whole == out[-1][0]:
                    out.append((parts[side], self._rank(whole)))
            known[piece] = out and out[::-1]
        return known[piece]

    def passes(self, left: str, right: str) -> bool:
        """Whether merging the characters of both leaves exactly these two: whether no merge crosses the border in time."""
        a, b = self._edge(left, 1), self._edge(right, 0)
        if a is None or b is None:
            return self.merged(left + right) == [left, right]
        get, i, j = self.ids.get, 0, 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            across = get(x + y)
            # of equal ranks the leftmost comes first: what ends x, the merge across, what ends y
            if across is not None and x_ends > -self.scores[across] <= y_ends:
                return False
            if x_ends <= y_ends:
                if x_ends == float("inf"):
                    return True
                i += 1
            else:
                j += 1

    def _pair(self, line: str, a: int, b: int, c: int, left: int, right: int) -> bool:
        """Whether the pair machine lets ``line[a:b]``, ``line[b:c]`` stand side by side."""
        if left >= 0 and right >= 0:
            key = left * len(self.pieces) + right
            known = self.pairs.get(key)
            if known is None:
                if len(self.pairs) >= PAIRS:
                    self.pairs.clear()
                known = self.pairs[key] = self.passes(line[a:b], line[b:c])
            return known
        if line[a] not in self.inner or line[b] not in self.inner:
            return True  # a character that no longer piece holds never merges
        return self.passes(line[a:b], line[b:c])

    def path(self, line: str) -> list[int]:
        """Piece ids on the shortest path through the composed lattice of a normalised line."""
        n = len(line)
        if not n:
            return []
        out = self._search_bpe(line) if self.model == BPE else self._relax_unigram(line)
        ids: list[int] = []
        for start, piece in out:
            ids += [piece] if piece >= 0 else self.fallback(line[start])
        return ids

    def _relax_unigram(self, line: str) -> list[tuple[int, int]]:
        """Arc weights are minus scores: relaxed position by position, as the lattice is acyclic."""
        n = len(line)
        cost, came = [float("inf")] * (n + 1), [(0, 0)] * (n + 1)
        cost[0] = 0.0
        for at in range(n):
            for end, piece in self.arcs(line, at):
                c = cost[at] - (self.scores[piece] if piece >= 0 else self.least)
                if c < cost[end]:
                    cost[end], came[end] = c, (at, piece)
        out, at = [], n
        while at:
            out.append(came[at])
            at = came[at][0]
        return out[::-1]

    def _search_bpe(self, line: str) -> list[tuple[int, int]]:
        """All weights are 0 or infinite, so the first path to the end is a shortest one.

        Longest pieces are tried first. A prefix has one encoding at most, so
        a position from which no path goes on is dead for good.
        """
        n, at = len(line), 0
        path: list[tuple[int, int]] = []  # start, piece
        tried: list[list[tuple[int, int]]] = []  # arcs left at each start
        dead = set()
        pairs, many, arcs = self.pairs, len(self.pieces), self.arcs
        left, here = -2, arcs(line, 0) if n else []
        while at < n:
            while here:
                end, piece = here.pop()
                if left == -2:
                    break
                fits = pairs.get(left * many + piece) if left >= 0 and piece >= 0 else None
                if fits is None:
                    fits = self._pair(line, path[-1][0], at, end, left, piece)
                if fits and end not in dead:
                    break
            else:
                dead.add(at)
                at, _ = path.pop()
                here = tried.pop()
                left = path[-1][1] if path else -2
                continue
            path.append((at, piece))
            tried.append(here)
            at, left = end, piece
            here = arcs(line, at)
        return path

    # ------------------------------------------------------------------ whole texts

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        if not text:
            return np.zeros(0, np.int32)
        if self.parts is None:
            return np.array(self.path(self.normalise(text)), np.int32)
        if self.squeeze or not self.dummy or text[0] == " " or "  " in text or META in text:
            return np.frombuffer(self._parts(self.normalise(text)), np.int32)
        # single spaces: every word, and every end of a line, begins a part of its own
        get, known = self.words.get, []
        for word in text.replace("\n", " \n").split(" "):
            ids = get(word)
            if ids is None:
                ids = self._kept(word, word if word[:1] == "\n" else META + word)
                get = self.words.get
            known.append(ids)
        return np.frombuffer(b"".join(known), np.int32)

    def _parts(self, line: str) -> bytes:
        """The ids of a normalised line, part by part."""
        parts = self.parts.findall(line)
        if len(parts) == 1:
            return np.array(self.path(line), np.int32).tobytes()
        out = []
        for part in parts:
            # kept like the word it would be, or under a key that no word has
            key = part[1:] if part[0] == META and len(part) > 1 else " " + part
            ids = self.words.get(key)
            out.append(self._kept(key, part) if ids is None else ids)
        return b"".join(out)

    def _kept(self, key: str, line: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self._parts(line)
        if len(key) <= LONGEST_KEPT:
            if len(self.words) >= self.room:  # what is not met for a whole generation is forgotten
                self.older, self.words = self.words, {}
            self.words[key] = ids
        return ids

    def decode(self, ids) -> str:
        """The text of ids: pieces back to characters, runs of byte pieces to UTF-8."""
        plain = self.plain
        text = b"".join([plain[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


_LETTER, _CONTROL = r"[^\W\d_¹²³]", r"[\x00-\x0C\x0E-\x1F]"
_OTHER = rf"(?:(?!{_LETTER})[^{META}\x00-\x0C\x0E-\x1F])"
#: Parts of a line: meta symbols, then other characters, then letters; control characters alone.
_FINE = re.compile(rf"{_CONTROL}|{META}*(?:{_OTHER}*{_LETTER}+|{_OTHER}+)|{META}+")
#: Parts of a line: meta symbols with the characters up to the next one.
_COARSE = re.compile(f"{META}*[^{META}]+|{META}+")
_compiled: dict[int, Transducer] = {}


def transducer(raw: bytes) -> Transducer:
    """The compiled model, once a Python process."""
    key = hash(raw)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer.compile(raw)
    return _compiled[key]


def read_model(path: str = MODEL_PATH) -> bytes:
    """The model file, read by the driver; its size does not depend on the data."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, text: str = "text", out: str = "ids", model: bytes | None = None) -> DataFrame:
    """``docs`` with the piece ids of ``text`` as an array of ints."""
    state = docs.sparkSession.sparkContext.broadcast(model or read_model())

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = transducer(state.value)
        for texts in batches:
            yield pd.Series([None if t is None else machine.encode(t) for t in texts], dtype=object)

    return docs.withColumn(out, encoded(F.col(text)))


def decode(docs: DataFrame, ids: str = "ids", out: str = "decoded", model: bytes | None = None) -> DataFrame:
    """``docs`` with the text that the ids stand for."""
    state = docs.sparkSession.sparkContext.broadcast(model or read_model())

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = transducer(state.value)
        for rows in batches:
            yield pd.Series([None if r is None else machine.decode(r.tolist()) for r in rows], dtype=object)

    return docs.withColumn(out, decoded(F.col(ids)))


def coded(docs: DataFrame, model: bytes | None = None, room: int = CACHE) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of every document: encoded, and decoded again in the same task."""
    state = docs.sparkSession.sparkContext.broadcast(model or read_model())

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(state.value)
        machine.room = room
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = part.column(1).to_pylist()
                ids = [None if t is None else machine.encode(t) for t in texts]
                same = [None if i is None else machine.decode(i.tolist()) == t.replace(META, " ") for i, t in zip(ids, texts)]
                flat = np.concatenate([np.zeros(0, np.int32), *[i for i in ids if i is not None]])
                ends = np.cumsum([0, *[0 if i is None else len(i) for i in ids]])
                nulls = pa.array([i is None for i in ids], pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=nulls)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists, pa.array(np.diff(ends), pa.int32()), pa.array(same, pa.bool_())],
                    names=["doc_id", "ids", "n_tokens", "round_trip"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        both, "doc_id bigint, ids array<int>, n_tokens int, round_trip boolean"
    )


def op9_pieces(spark, sf_dir: str) -> DataFrame:
    """Token counts, digest of the ids and round trip of every document's whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return coded(docs).select(
        "doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens"),
        F.md5(F.concat_ws(",", "ids")).alias("ids_md5"), "round_trip",
    )
