"""Benchmark decontamination over a distributed positional inverted index.

The index is a stored table of segments: each holds the postings of some whole
documents, sorted by term. A term is the 64-bit hash of a word, a posting the
word's place on the segment's axis, on which documents follow each other with
one free place between them, so no phrase crosses a document. A segment is
read by one task and shuffled nowhere; more documents are more segments.

A search broadcasts a block of windows whose size is checked (more items are
more blocks, each a pass over the index) and first adds up how often each test
term occurs in the whole index. In a segment a window whose terms are not all
there is dropped at once; the places of its rarest term, less that term's
offset in the window, are the starts it can have, and they are intersected
with the list of the next rarest term less its offset, and so on. What is left
after the last term is an occurrence; nothing is verified against the texts.

Words. A to Z are lower-cased, then words are runs of digits, a to z and
characters beyond ASCII. Windows are ``width`` consecutive words of an item;
an item of fewer words is one window, one without words none.

Defined results. A null text has no words. Rows that share a doc_id, or have
none, are documents of their own. Items of one id count once; an item without
an id hits but is not listed. Empty tables: no hits, or no rows. A text of any
length is one segment at least, and never cut. Words are told apart by 64
bits: two of a billion words collide with a chance of a few per cent, and a
wrong hit needs such words at every place of a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

WIDTH = 10
#: Bytes of text a segment is closed at.
SEGMENT_BYTES = 2 << 20
#: Bytes that are hashed at once.
CHUNK = 1 << 20
#: Bytes of windows a search broadcasts at once.
BLOCK_BYTES = 16 << 20

# bytes of words with A-Z lowered; 0 is no word
_LOWER = np.zeros(256, np.uint8)
_LOWER[128:] = np.arange(128, 256)
_LOWER[48:58] = np.arange(48, 58)
_LOWER[97:123] = _LOWER[65:91] = np.arange(97, 123)
_random = np.random.default_rng(7)
# one odd number a byte, and an odd base whose powers mod 2^64 have inverses
_CODE = _random.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Word hashes of byte arrays; the powers it needs are kept between calls."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start of every word, its hash) of UTF-8 bytes; a zero byte between texts ends words."""
        low = _LOWER[data]
        found, at = [], 0
        while at < len(low):  # long texts in chunks that end between words
            end = min(at + CHUNK, len(low))
            while end < len(low) and low[end]:
                gap = np.flatnonzero(low[end:end + CHUNK] == 0)
                end = end + int(gap[0]) if len(gap) else min(end + CHUNK, len(low))
            found.append(self._words(low[at:end], at))
            at = end
        if len(found) == 1:
            return found[0]
        none = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        return tuple(np.concatenate(x) for x in zip(*(found or none)))

    def _words(self, low: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        inside = np.concatenate([[False], low != 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        if len(self.up) < len(low):
            n = max(len(low), min(2 * len(low), CHUNK))
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        total = np.zeros(len(low) + 1, np.uint64)
        np.cumsum(_CODE[low] * self.up[:len(low)], out=total[1:])
        h = (total[end] - total[start]) * self.down[start]
        h ^= (end - start).astype(np.uint64) << np.uint64(48)
        h ^= h >> np.uint64(31)
        return start + at, h * np.uint64(0xBF58476D1CE4E5B9)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    return (np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)), offsets


SEGMENTS = "segment bigint, doc_ids array<bigint>, n_words array<bigint>, terms binary, counts binary, places binary"
_SEGMENTS = pa.schema([
    ("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("terms", pa.binary()),
    ("counts", pa.binary()), ("places", pa.binary()),
])


def inverted(hasher: Hasher, parts: list[np.ndarray]) -> tuple[np.ndarray, bytes, bytes, bytes]:
    """(words of each text, terms, postings of each term, places sorted by term) of texts as byte arrays."""
    data = np.zeros(sum(map(len, parts)) + len(parts), np.uint8)
    starts = np.cumsum([0, *[len(p) + 1 for p in parts]])
    for p, at in zip(parts, starts):
        data[at:at + len(p)] = p
    start, h = hasher.words(data)
    doc = np.searchsorted(starts, start, "right") - 1
    n_words = np.bincount(doc, minlength=len(parts))
    place = np.arange(len(h)) + doc  # one free place after each document
    order = np.argsort(h, kind="stable")
    h = h[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    counts = np.diff(np.append(new, len(h)))
    place = place[order].astype(np.int32)
    # differences inside a list compress well
    steps = np.diff(place, prepend=np.int32(0))
    steps[new] = place[new]
    return n_words, h[new].tobytes(), counts.astype(np.int32).tobytes(), steps.tobytes()


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The stored segments of all documents."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, number = Hasher(), TaskContext.get().partitionId() << 32
        ids: list = []
        parts: list[np.ndarray] = []
        size = 0

        def closed() -> pa.RecordBatch:
            n_words, *arrays = inverted(hasher, parts)
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([n_words], pa.list_(pa.int64())), *[pa.array([a], pa.binary()) for a in arrays]],
                schema=_SEGMENTS,
            )

        for batch in batches:
            data, offsets = _bytes_of(batch.column(1))
            for i, key in enumerate(batch.column(0).to_pylist()):
                ids.append(key)
                parts.append(data[offsets[i]:offsets[i + 1]])
                size += len(parts[-1]) + 1
                if size >= segment_bytes:
                    yield closed()
                    ids, parts, size, number = [], [], 0, number + 1
            parts = [p.copy() for p in parts]  # the batch's memory goes
        if ids:
            yield closed()

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return materialise(rows.mapInArrow(build, SEGMENTS), "postings")


class Segment:
    """Postings of one stored row."""

    def __init__(self, n_words, terms: bytes, counts: bytes, places: bytes):
        self.n_words = np.asarray(n_words, np.int64)
        self.bases = np.cumsum(self.n_words + 1) - self.n_words - 1  # first place of each document
        self.length = int((self.n_words + 1).sum())
        self.terms, self.counts = np.frombuffer(terms, np.uint64), np.frombuffer(counts, np.int32).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        steps = np.frombuffer(places, np.int32).astype(np.int64)
        total = np.cumsum(steps)
        before = np.repeat(np.concatenate([[0], total])[self.first], self.counts)
        self.places = total - before
        # sorted: lists follow each other in the order of their terms
        self.keys = np.repeat(np.arange(len(self.terms)), self.counts) * self.length + self.places

    def number(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term in this segment, -1 where it does not occur."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each term, by number, stands at that place."""
        key = term * self.length + place
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (place >= 0) & (place < self.length) & (self.keys[at] == key)

    def lists(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``term``, place) of all postings of the terms."""
        n = self.counts[term]
        owner = np.repeat(np.arange(len(term)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return owner, self.places[self.first[term][owner] + inside]

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bases, place, "right") - 1


class Windows:
    """A block of windows: terms (padded), lengths, and offsets in order of rarity."""

    def __init__(self, words: list[np.ndarray], freq: dict[int, int]):
        self.size = np.array([len(w) for w in words], np.int64)
        most = int(self.size.max()) if len(words) else 0
        self.terms, inverse = np.unique(np.concatenate(words) if words else np.zeros(0, np.uint64), return_inverse=True)
        self.word = np.full((len(words), most), -1, np.int64)
        self.word[np.arange(most)[None, :] < self.size[:, None]] = inverse
        rare = np.array([freq.get(int(t), 0) for t in self.terms] + [np.iinfo(np.int64).max], np.int64)
        self.order = np.argsort(rare[self.word], axis=1, kind="stable")  # padding last

    def exact(self, seg: Segment) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of all occurrences: lists less their offsets intersected from the rarest term on."""
        if not len(seg.terms) or not len(self.size):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        here = np.append(seg.number(self.terms), 0)  # padding is always there
        live = np.flatnonzero((here[self.word] >= 0).all(axis=1))
        offset = self.order[live, 0]
        owner, place = seg.lists(here[self.word[live, offset]])
        window, start = live[owner], place - offset[owner]
        for step in range(1, self.word.shape[1]):
            offset = self.order[window, step]
            keep = (step >= self.size[window]) | seg.has(here[self.word[window, offset]], start + offset)
            window, start = window[keep], start[keep]
        return window, start

    def near(self, seg: Segment, within: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, start, end) of all shortest stretches of at most ``within`` words that hold every word of a window, in any order.

        A stretch begins with one of the words and holds the rarest one, so it
        begins at most ``within`` - 1 places before one of that word's places.
        """
        none = np.zeros(0, np.int64)
        if not len(seg.terms) or not len(self.size):
            return none, none, none
        here = np.append(seg.number(self.terms), 0)
        out = []
        for w in np.flatnonzero((here[self.word] >= 0).all(axis=1)).tolist():
            numbers = here[self.word[w, self.order[w, :self.size[w]]]]
            numbers = numbers[np.sort(np.unique(numbers, return_index=True)[1])]
            lists = [seg.places[seg.first[t]:seg.first[t] + seg.counts[t]] for t in numbers.tolist()]
            rare = lists[0]
            starts = np.unique(np.concatenate(lists))
            nearest = np.searchsorted(rare, starts)
            ok = nearest < len(rare)
            ok[ok] = rare[nearest[ok]] - starts[ok] < within
            starts = starts[ok]
            end = np.zeros(len(starts), np.int64)
            for own in lists:
                at = np.searchsorted(own, starts)
                end = np.maximum(end, np.where(at < len(own), own[np.minimum(at, len(own) - 1)], np.iinfo(np.int64).max // 2))
            ok = (end - starts < within) & (seg.document(starts) == seg.document(np.minimum(end, seg.length - 1)))
            starts, end = starts[ok], end[ok]
            # of stretches with one end only the shortest, the last to begin
            last = np.append(end[1:] != end[:-1], True) if len(end) else np.zeros(0, bool)
            out += [(w, a, b) for a, b in zip(starts[last].tolist(), (end[last] + 1).tolist())]
        return tuple(np.array(out, np.int64).reshape(-1, 3).T)


def windows_of(items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(words, item_ids): the distinct windows of all items as packed hashes, with the sorted ids of their items; stored."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            data, offsets = _bytes_of(batch.column(1))
            keys, words = [], []
            for i, key in enumerate(batch.column(0).to_pylist()):
                h = hasher.words(data[offsets[i]:offsets[i + 1]])[1]
                for a in range(max(len(h) - width, 0) + 1 if len(h) else 0):
                    keys.append(key)
                    words.append(h[a:a + width].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(words, pa.binary())], ["item_id", "words"])

    rows = items.select(F.col(item_id).cast("string").alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return materialise(rows.mapInArrow(cut, "item_id string, words binary").groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")), "windows")


def blocks_of(windows: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The windows in as many blocks as keep each near ``block_bytes``."""
    size = windows.agg(F.sum(F.length("words") + 16 + 24 * F.size("item_ids"))).first()[0] or 0
    n = int(-(-size // block_bytes))
    return [windows.where(F.pmod(F.xxhash64("words"), F.lit(n)) == b) for b in range(n)]


def frequencies(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """Occurrences of each of a bounded number of terms in the whole index; reads terms and counts alone."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(terms), np.int64)
        for part in batches:
            for own, counts in zip(part["terms"], part["counts"]):
                own, counts = np.frombuffer(own, np.uint64), np.frombuffer(counts, np.int32)
                if len(own):
                    at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                    total += np.where(own[at] == terms, counts[at], 0)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at, "n": total[at]})

    sums = index.select("terms", "counts").mapInPandas(counted, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return {int(terms[r["term"]]): r["n"] for r in sums.collect()}


FOUND = "segment bigint, ordinal int, start bigint, end bigint, item_ids array<string>"


def search(index: DataFrame, windows: DataFrame, within: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(segment, ordinal, start, end, item_ids) of matches; places are words of the document, ``end`` is exclusive.

    Without ``within``: occurrences of the windows, those of one document that
    overlap or touch joined to one stretch with the ids of all. With it: the
    shortest stretches of at most so many words that hold all words of a window.
    """
    spark = index.sparkSession
    found = None
    for block in blocks_of(windows, block_bytes):
        held = block.collect()  # at most about block_bytes
        words = [np.frombuffer(r["words"], np.uint64) for r in held]
        items = [r["item_ids"] for r in held]
        freq = frequencies(index, np.unique(np.concatenate(words)))
        packed = Windows(words, freq)

        def run(batches: Iterator[pd.DataFrame], packed=packed, items=items) -> Iterator[pd.DataFrame]:
            for part in batches:
                for segment, n_words, *arrays in zip(part["segment"], part["n_words"], part["terms"], part["counts"], part["places"]):
                    seg = Segment(n_words, *arrays)
                    yield _matches(segment, seg, packed, items, within)

        rows = index.select("segment", "n_words", "terms", "counts", "places").mapInPandas(run, FOUND)
        found = rows if found is None else found.unionByName(rows)
    return found if found is not None else spark.createDataFrame([], FOUND)


def _matches(segment: int, seg: Segment, packed: Windows, items: list, within: int | None) -> pd.DataFrame:
    if within is not None:
        window, start, end = packed.near(seg, within)
    else:
        window, start = packed.exact(seg)
        end = start + packed.size[window] if len(window) else start
    doc = seg.document(start) if len(start) else start
    order = np.lexsort((end, start, doc))
    window, start, end, doc = window[order], start[order], end[order], doc[order]
    base = seg.bases[doc] if len(doc) else doc
    own = [items[w] for w in window.tolist()]
    if within is None and len(start):
        # a stretch ends where the next start lies beyond all ends so far; the free place parts documents
        reach = np.maximum.accumulate(end)
        first = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
        last = np.append(first[1:], len(start))
        own = [sorted(set().union(*own[a:b])) for a, b in zip(first.tolist(), last.tolist())]
        start, end, doc, base = start[first], reach[last - 1], doc[first], base[first]
    return pd.DataFrame({"segment": segment, "ordinal": doc.astype(np.int32), "start": start - base, "end": end - base, "item_ids": pd.Series(own, dtype=object)})


def _hit(spans: Column) -> Column:
    """Words covered by (start, end) spans, which may overlap."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to"))
    return F.aggregate(
        F.array_sort(spans), start,
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("bigint"), x["end"] - F.greatest(x["start"], s["to"]))).alias("n"), F.greatest(s["to"], x["end"]).alias("to")
        ),
        lambda s: s["n"],
    )


def contaminated(index: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids, spans) of every document of the index, from matches of :func:`search`."""
    docs = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("ordinal", "d"))
    hits = found.groupBy("segment", "ordinal").agg(
        F.collect_list(F.struct("start", "end")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids")
    )
    rows = docs.select("segment", "ordinal", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n_words")).join(hits, ["segment", "ordinal"], "left")
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return rows.select(
        "doc_id", "n_words", _hit(F.coalesce("spans", empty)).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("spans", empty).alias("spans"),
    )


def op13_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contract query: documents that hold ten consecutive words of a benchmark item."""
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    windows = windows_of(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = materialise(search(index, windows), "matches")
    return contaminated(index, found).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


#: The contract query in DuckDB SQL.
ORACLE = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id::BIGINT AS doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  b AS (SELECT item_id::VARCHAR AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
  sizes AS (SELECT DISTINCT k FROM wins),
  grams AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - k + 2)) AS u(i)),
  hits AS (SELECT g.r, g.i, g.k, x.item_id FROM grams g JOIN wins x ON x.k = g.k AND x.s = g.s),
  spots AS (SELECT r, count(DISTINCT p) AS n FROM hits, unnest(range(i, i + k)) AS u(p) GROUP BY r),
  ids AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY r)
  SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(spots.n, 0)::BIGINT AS n_hit, coalesce(ids.n, 0)::BIGINT AS n_items,
    sha256(coalesce(ids.ids, '')) AS items_sha256, coalesce(spots.n, 0) > 0 AS contaminated
  FROM d LEFT JOIN spots USING (r) LEFT JOIN ids USING (r)"""
