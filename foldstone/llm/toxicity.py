"""Toxicity by compression distance to two trained zstandard dictionaries.

One dictionary is trained on ordinary text, one on what sets toxic text apart:
the stretches of toxic texts whose six-byte strings are found in many toxic
texts and hardly in ordinary ones (labels are of whole documents, and most of
a toxic document reads like any other). Every text is cut at words into
windows of at most ``WINDOW`` bytes. A window is compressed against the
ordinary dictionary and against both; the bytes saved by the toxic one are the
window's evidence. A document's windows are summed up by their largest
saving, the share of windows above fixed savings, and the mean saving; a
logistic function of these, fitted on documents that trained no dictionary,
drawn for each label and weighted by how many labelled documents they stand
for, gives a calibrated probability.

Training reads a bounded sample: about ``SAMPLE`` toxic and twice as many
ordinary documents, chosen by a hash of the id, and of a long one pieces of ``TAKEN`` bytes in all
spread over the whole text; about ``CALIBRATION`` documents of each label for
the logistic, which are scored whole. A label with fewer than ``FEW`` documents
to calibrate on, or with none to form its dictionary, takes what it lacks from
the other part. Scoring reads every text whole.

Defined results. Null text: empty. Empty text: no savings, the score is the
logistic of that. Labels null: not used. No toxic or no ordinary labelled
document at all: score 0, predicted 0. Repeated rows are scored alike; repeated texts
train once. Empty table: empty result.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of

#: Bytes of a window, of the dictionaries, and of the strings counted.
WINDOW = 48
ORDINARY_BYTES, TOXIC_BYTES = 2048, 1536
GRAM = 6
#: A string is telling if this share of toxic texts has it, this many times the share of ordinary ones.
SHARE, RATIO = 0.02, 30.0
SAMPLE = 1500
CALIBRATION = 5000
#: A label with fewer documents to calibrate on also takes some that formed its dictionary.
FEW = 20
TAKEN = 8192
#: Probability from which a document counts as toxic.
CUT = 0.3


def normal(text: str | None) -> bytes:
    """Lower-cased UTF-8 with white space as single spaces, one at either end."""
    return b" " + b" ".join((text or "").lower().encode("utf-8", "surrogatepass").split()) + b" "


def windows(line: bytes, size: int = WINDOW) -> list[bytes]:
    """The whole line in windows that end at a space where there is one; the space opens the next one too."""
    out, at, end = [], 0, len(line) - 1
    find = line.rfind
    while at < end:
        stop = at + size
        if stop >= len(line):
            out.append(line[at:])
            break
        space = find(b" ", at + 1, stop)
        stop = space if space > at else stop
        out.append(line[at:stop + 1])
        at = stop
    return out or [b" "]


def _grams(line: bytes) -> np.ndarray:
    code = np.frombuffer(line, np.uint8).astype(np.uint64)
    m = len(code) - GRAM + 1
    out = np.zeros(max(m, 0), np.uint64)
    for i in range(GRAM if m > 0 else 0):
        out = (out << np.uint64(8)) | code[i:i + m]
    return out


def _document_counts(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    each = [np.unique(_grams(x)) for x in lines]
    return np.unique(np.concatenate(each) if each else np.zeros(0, np.uint64), return_counts=True)


def telling_stretches(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Maximal stretches of toxic lines covered by strings that set them apart."""
    mine, n_mine = _document_counts(toxic)
    other, n_other = _document_counts(ordinary)
    if len(other):
        at = np.minimum(np.searchsorted(other, mine), len(other) - 1)
        there = np.where(other[at] == mine, n_other[at], 0)
    else:
        there = np.zeros(len(mine))
    ratio = (n_mine / len(toxic)) / ((there + 0.5) / len(ordinary))
    good = mine[(n_mine >= max(min(3, len(toxic)), SHARE * len(toxic))) & (ratio > RATIO)]
    out = []
    for line in toxic:
        hit = np.nonzero(np.isin(_grams(line), good))[0]
        if len(hit):
            cut = np.nonzero(np.diff(hit) > 1)[0]
            for a, b in zip(hit[np.r_[0, cut + 1]].tolist(), hit[np.r_[cut, len(hit) - 1]].tolist()):
                out.append(line[a:b + GRAM])
    return out


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; from too few samples to train on, the most frequent ones themselves."""
    import zstandard

    padded = [s if len(s) >= 8 else s.ljust(8) for s in samples]
    try:
        return zstandard.train_dictionary(size, padded, k=16, d=GRAM, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        kept, room = [], size
        for s, _ in Counter(samples).most_common():
            if len(s) > room:
                break
            kept.append(s)
            room -= len(s)
        return b"".join(reversed(kept))


@dataclass
class Model:
    """The dictionaries and the logistic over a document's features."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def probability(self, features: np.ndarray) -> np.ndarray:
        x = np.c_[(features - self.mean) / self.scale, np.ones(len(features))]
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -40, 40)))


class Meter:
    """Compresses windows against the ordinary dictionary and against both."""

    def __init__(self, model: Model):
        import zstandard

        def compressor(content: bytes):
            params = zstandard.ZstdCompressionParameters.from_level(
                3, min_match=5, strategy=zstandard.STRATEGY_LAZY2, search_log=5, window_log=15, hash_log=14, chain_log=14,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            if len(content) < 8:
                return zstandard.ZstdCompressor(compression_params=params)
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=params)
            return zstandard.ZstdCompressor(dict_data=held, compression_params=params)

        self.sides = compressor(model.ordinary), compressor(model.ordinary + model.toxic)

    def savings(self, parts: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window."""
        lengths = []
        for side in self.sides:
            packed = side.multi_compress_to_buffer(parts, threads=1)
            lengths.append(np.fromiter((len(packed[i]) for i in range(len(packed))), np.int64, len(packed)))
        return lengths[0] - lengths[1]

    def features(self, text: str | None) -> list[float]:
        parts, sums = windows(normal(text)), np.zeros(6)
        top, n = -9, len(parts)
        for at in range(0, n, 4096):  # bounded, however long the text
            g = self.savings(parts[at:at + 4096])
            top = max(top, int(g.max()))
            sums += [(g >= 1).sum(), (g >= 3).sum(), (g >= 4).sum(), (g >= 5).sum(), np.maximum(g - 1, 0).sum(), g.sum()]
        shares = sums / (n + 3)
        return [float(top), *np.sqrt(shares[:5]).tolist(), *shares[1:5].tolist(), float(sums[4] / np.sqrt(n + 3)), float(np.log(n))]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton steps, halved where they overshoot, for a weighted ridge logistic regression."""
    weight = weight / weight.sum()

    def cost(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * w @ w)

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) + ridge * w)
        while cost(w - step) > cost(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() <= 1e-9:
            break
    return w


def _pieces(line: bytes, doc_id: int) -> bytes:
    """The line, or of a long one pieces spread over all of it."""
    if len(line) <= TAKEN:
        return line
    rng, size = random.Random(doc_id), 512
    starts = sorted(rng.sample(range(len(line) // size), TAKEN // size))
    return b" ".join(line[s * size:(s + 1) * size] for s in starts)


def _drawn(salt: str, share) -> F.Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), "doc_id"), 11) / F.lit(float(2**53)) < share


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, calibration: int = CALIBRATION) -> Model | None:
    """A model from texts and (doc_id, toxic) rows; the caller holds out what it wants."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    # three quarters may form the dictionaries, the rest calibrates
    forms = F.pmod(F.xxhash64(F.lit("role"), "doc_id"), F.lit(4)) > 0
    share = F.when(F.col("toxic") == 1, min(1.0, 4 / 3 * sample / counts[1])).otherwise(min(1.0, 8 / 3 * sample / counts[0]))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            lines = [_pieces(normal(t), int(i)) for i, t in zip(part["doc_id"], part["text"])]
            yield pd.DataFrame({"doc_id": part["doc_id"], "toxic": part["toxic"], "line": lines})

    def lines_of(chosen: DataFrame) -> list:
        # the sampled ids are few by construction, so they go to the texts
        return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInPandas(
            taken, "doc_id bigint, toxic int, line binary"
        ).collect()

    chosen = usable.where(forms & _drawn("train", share))
    rows = lines_of(chosen)
    bare = [c for c in (0, 1) if c not in {r["toxic"] for r in rows}]
    if bare:  # only where a label has next to no documents: all of them may form
        others = usable.where(F.col("toxic").isin(bare) & _drawn("train", share))
        rows, chosen = rows + lines_of(others), chosen.where(~F.col("toxic").isin(bare)).unionByName(others)
    lines: dict[bytes, int] = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], bytes(r["line"]))):
        lines.setdefault(bytes(r["line"]), r["toxic"])
    toxic, ordinary = (
        [x for x, v in lines.items() if v == c] or sorted({bytes(r["line"]) for r in rows if r["toxic"] == c}) for c in (1, 0)
    )
    if not toxic or not ordinary:
        return None
    plain = [w for x in ordinary for w in windows(x)]
    plain = random.Random(5).sample(plain, min(len(plain), 40_000))
    model = Model(train_dictionary(plain, ORDINARY_BYTES), train_dictionary(telling_stretches(toxic, ordinary), TOXIC_BYTES))
    state = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        meter = Meter(state.value)
        for part in batches:
            yield pd.DataFrame({
                "doc_id": part["doc_id"], "toxic": part["toxic"], "f": [meter.features(t) for t in part["text"]],
            })

    def features_of(held: DataFrame) -> list:
        return texts.join(F.broadcast(held), "doc_id").select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInPandas(
            measured, "doc_id bigint, toxic int, f array<double>"
        ).collect()

    # drawn for each label: rare toxic documents are not left to chance
    part = F.when(F.col("toxic") == 1, min(1.0, 4 * calibration / counts[1])).otherwise(min(1.0, 4 * calibration / counts[0]))
    seen = features_of(usable.where(~forms & _drawn("calibrate", part)))
    found = Counter(r["toxic"] for r in seen)
    few = [c for c in (0, 1) if found[c] < FEW]
    if few:
        formed = Counter(r["toxic"] for r in rows)
        lacking = F.when(F.col("toxic") == 1, min(1.0, 2 * FEW / max(1, formed[1]))).otherwise(min(1.0, 2 * FEW / max(1, formed[0])))
        already = {r["doc_id"] for r in seen}
        more = chosen.where(F.col("toxic").isin(few) & _drawn("lacking", lacking))
        seen += [r for r in features_of(more) if r["doc_id"] not in already]
    seen.sort(key=lambda r: (r["doc_id"], r["f"]))
    x, y = np.array([r["f"] for r in seen]), np.array([r["toxic"] for r in seen], float)
    n = Counter(r["toxic"] for r in seen)
    weight = np.where(y == 1, counts[1] / max(1, n[1]), counts[0] / max(1, n[0]))
    model.mean = np.average(x, axis=0, weights=weight)
    model.scale = np.sqrt(np.average((x - model.mean) ** 2, axis=0, weights=weight)) + 1e-9
    model.weights = _logistic(np.c_[(x - model.mean) / model.scale, np.ones(len(x))], y, weight)
    return model


def scored(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` of every whole text."""
    state = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = state.value
        meter = Meter(held) if held is not None else None
        for texts in batches:
            if meter is None:
                yield pd.Series(np.zeros(len(texts)))
            else:
                yield pd.Series(held.probability(np.array([meter.features(t) for t in texts]))) if len(texts) else pd.Series([], dtype=float)

    return docs.withColumn("score", judged(F.col(text)))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: the toxicity of every document's whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic")
    model = fit(docs, labels.where(fold_of("doc_id", 4) != 2))
    out = scored(docs.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
