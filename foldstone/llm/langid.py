"""Language identification by averaged hashed subword embeddings.

A text is lower-cased, everything but letters becomes a word boundary, and its
subwords are the character n-grams of one to four that touch a letter,
boundaries included. Each is hashed to a row of an embedding table; the text
is the mean of its rows, and a linear softmax over it gives the language.
Table and softmax are trained together by stochastic gradient descent in
numpy on a bounded sample: about ``per_class`` texts of each language, fewer
where all languages together would pass ``most_rows``, chosen by a hash of the
id; of these only subword counts reach the driver (at most ``buckets`` numbers
a text). Part of the sample calibrates, whole and thinned: the weight of
missing evidence, a temperature on the softmax, and a threshold below which a
prediction is rejected. The threshold is the lowest that rejects all but one
in a hundred of texts in no learned language (random subwords, and languages
scored by models trained without them), but never so high that more than
``loss`` of the well predicted texts would go: then it stands at that share.

Prediction folds table and softmax into one (buckets x languages) matrix,
sends it along once (its size is fixed by the two parameters) and reads every
text whole, in pieces of bounded length.

Defined results. Null text, or one without a letter: ``und``, score 0,
rejected. Rows with null language teach nothing. No labelled row at all: every
text is ``und`` with score 0 and rejected. Repeated rows and ids: each row is
predicted by itself. Columns named like a result (``lang_pred``, ``score``,
``rejected``) are replaced; :func:`accepted` keeps every column. Very long
texts are read whole. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import fold_of

UNKNOWN = "und"
#: Rows of the embedding table, its width, the longest subword.
BUCKETS = 1 << 14
WIDTH = 16
LONGEST = 4
#: Labelled texts of each language in the sample, and of all languages together, about.
PER_CLASS = 300
MOST_ROWS = 6_000
EPOCHS = 20
#: Share of well predicted calibration texts that the rejection threshold may lose.
LOSS = 0.005
#: Share of texts in no learned language that it should reject, and models that each leave a part of the languages out.
REJECTED = 0.99
PARTS = 4
#: Characters hashed at once.
PIECE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> np.ndarray:
    """For each character of the basic plane: itself if a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x10000)], np.uint32)


_letter_table: np.ndarray | None = None


def letters(text: str) -> np.ndarray:
    """Lower-cased code points with everything but letters as 0, boundaries at both ends."""
    global _letter_table
    if _letter_table is None:
        _letter_table = _classes()
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _letter_table[np.minimum(code, 0xFFFF)]
    high = np.nonzero(code > 0xFFFF)[0]
    if len(high):
        out[high] = [c if chr(c).isalpha() else 0 for c in code[high].tolist()]
    return np.concatenate([[np.uint32(0)], out, [np.uint32(0)]])


def subword_counts(text: str, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How often each bucket is hit by the subwords of a text."""
    code = letters(text)
    counts = np.zeros(buckets, np.int64)
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    for at in range(0, len(code), PIECE):  # pieces overlap by what the longest subword needs
        part = code[at:at + PIECE + longest - 1].astype(np.uint64)
        own = min(PIECE, len(code) - at)
        hashed = np.zeros(len(part), np.uint64)
        held = np.zeros(len(part), bool)
        for n in range(1, longest + 1):
            m = len(part) - n + 1
            if m <= 0:
                break
            # one more character: hash and whether a letter is inside
            hashed = hashed[:m] * np.uint64(0x100000001B3) + part[n - 1:] + np.uint64(1)
            held = held[:m] | (part[n - 1:] > 0)
            mine = slice(0, min(own, m))
            rows = ((hashed[mine] * _ODD) >> shift)[held[mine]]
            counts += np.bincount(rows.astype(np.int64), minlength=buckets)
    return counts


@dataclass
class Model:
    """Language names, logits a bucket, and what calibration sets: evidence a text is short of, temperature, threshold."""

    names: list[str]
    logits: np.ndarray
    bias: np.ndarray
    prior: float
    temperature: float
    threshold: float

    def scores(self, counts: np.ndarray) -> np.ndarray:
        total = counts.sum(-1, keepdims=True) + self.prior
        return _softmax((counts @ self.logits / np.maximum(total, 1) + self.bias) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


def _descend(means: list, labels: np.ndarray, learn: np.ndarray, classes: int, buckets: int, width: int, epochs: int,
             seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets x classes logits, bias) by stochastic gradient descent over the rows ``learn``."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 1 / width, (buckets, width)).astype(np.float32)
    out = np.zeros((width, classes), np.float32)
    bias = np.zeros(classes, np.float32)
    rate = 20.0
    steps, step = epochs * len(learn), 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            ids, share = means[i]
            hidden = share @ table[ids]
            err = _softmax(hidden @ out + bias)
            err[labels[i]] -= 1
            pace = rate * (1 - step / steps)
            back = out @ err
            out -= 0.05 * pace * np.outer(hidden, err)
            bias -= 0.01 * pace * err
            table[ids] -= pace * share[:, None] * back
            step += 1
    return (table @ out).astype(np.float64), bias.astype(np.float64)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], buckets: int = BUCKETS, width: int = WIDTH,
          epochs: int = EPOCHS, seed: int = 11, loss: float = LOSS) -> Model | None:
    """Fit on (language, bucket ids, counts) rows; every fifth calibrates."""
    if not rows:
        return None
    names = sorted({r[0] for r in rows})
    place = {n: i for i, n in enumerate(names)}
    labels = np.array([place[r[0]] for r in rows])
    means = [(r[1], (r[2] / r[2].sum()).astype(np.float32)) for r in rows]
    held = np.arange(len(rows)) % 5 == 4
    if len(rows) < 50:
        held[:] = False
    learn = np.nonzero(~held)[0]
    rng = np.random.default_rng(seed + 1)
    model = Model(names, *_descend(means, labels, learn, len(names), buckets, width, epochs, seed), 0.0, 1.0, 0.0)
    check = np.nonzero(held)[0] if held.any() else learn
    # calibrated on whole texts and on thinned ones, so that little evidence gives little confidence
    bags, truth = [], []
    for i in check:
        ids, counts = rows[i][1], rows[i][2]
        for n in (None, 32, 8):
            c = counts if n is None else rng.multinomial(n, counts / counts.sum())
            bags.append((c @ model.logits[ids], c.sum()))
            truth.append(labels[i])
    z, size, truth = np.stack([b[0] for b in bags]), np.array([b[1] for b in bags])[:, None], np.array(truth)

    def probs(prior: float, temperature: float) -> np.ndarray:
        return _softmax((z / (size + prior) + model.bias) / temperature)

    grid = [(k, t) for k in (0, 2, 5, 10, 20, 40) for t in np.geomspace(0.1, 20, 40)]
    cost = [-np.log(np.maximum(probs(*g)[np.arange(len(z)), truth], 1e-12)).mean() for g in grid]
    model.prior, model.temperature = map(float, grid[int(np.argmin(cost))])
    p = probs(model.prior, model.temperature)[::3]
    right = p.max(1)[p.argmax(1) == truth[::3]]
    spare = float(np.quantile(right, loss)) if len(right) else 0.0
    foreign = _foreign_scores(model, rows, means, labels, learn, check, width, max(1, epochs // 4), seed, rng)
    model.threshold = min(spare, float(np.quantile(foreign, REJECTED)))
    return model


def _foreign_scores(model: Model, rows: list, means: list, labels: np.ndarray, learn: np.ndarray, check: np.ndarray, width: int,
                    epochs: int, seed: int, rng: np.random.Generator) -> np.ndarray:
    """Top scores of texts in no learned language.

    Each calibration text gives one of random subwords, as long as itself, and
    one score by a model that never saw its language (with three languages or
    more: a model of one language is always certain).
    """
    buckets, classes = model.logits.shape
    size = np.array([rows[i][2].sum() for i in check])
    noise = [rng.multinomial(min(int(n), 1 << 20), np.full(buckets, 1 / buckets)) for n in size]
    top = [float(model.scores(c).max()) for c in noise]
    for part in range(PARTS if classes > 2 else 0):
        gone = np.arange(classes) % PARTS == part
        left = np.nonzero(~gone)[0]
        theirs = check[gone[labels[check]]]
        if not len(theirs) or len(left) < 2:
            continue
        own = np.full(classes, -1)
        own[left] = np.arange(len(left))
        seen = learn[~gone[labels[learn]]]
        logits, bias = _descend(means, own[labels], seen, len(left), buckets, width, epochs, seed)
        other = Model([model.names[i] for i in left], logits, bias, model.prior, model.temperature, 0.0)
        for i in theirs:
            counts = np.zeros(buckets, np.int64)
            counts[rows[i][1]] = rows[i][2]
            top.append(float(other.scores(counts).max()))
    return np.array(top)


def sample_of(labelled: DataFrame, per_class: int = PER_CLASS, most_rows: int = MOST_ROWS) -> DataFrame:
    """About ``per_class`` rows of each language of (doc_id, text, lang), by a hash of the id; about ``most_rows`` in all."""
    sizes = settle(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    each = min(float(per_class), most_rows / max(1, sizes.count()))
    kept = sizes.select("lang", (F.lit(each) / F.col("n")).alias("share"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id"), 11) / F.lit(float(2**53))
    return labelled.join(kept, "lang").where(draw < F.col("share")).drop("share")


def fit(labelled: DataFrame, per_class: int = PER_CLASS, buckets: int = BUCKETS, **options) -> Model | None:
    """A model from (doc_id, text, lang) rows; see the module for what is sampled."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            ids, counts = [], []
            for text in part["text"]:
                c = subword_counts(text, buckets)
                at = np.nonzero(c)[0]
                ids.append(at.astype(np.int32).tobytes())
                counts.append(c[at].astype(np.int32).tobytes())
            yield pd.DataFrame({"lang": part["lang"], "id": part["doc_id"], "ids": ids, "counts": counts})

    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = sample_of(usable, per_class).select("doc_id", "text", "lang").mapInPandas(
        counted, "lang string, id bigint, ids binary, counts binary"
    ).collect()
    rows.sort(key=lambda r: (r["id"] is None, r["id"] or 0, r["ids"], r["lang"]))
    parsed = [(r["lang"], np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.int32)) for r in rows]
    return train(parsed, buckets, **options)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected`` of every whole text."""
    others = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "rejected")]
    state = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judged(texts: pd.Series) -> pd.DataFrame:
        m = state.value
        names, scores, off = [], [], []
        for t in texts:
            counts = subword_counts(t, len(m.logits)) if t and m is not None else None
            if counts is None or not counts.any():
                names.append(UNKNOWN)
                scores.append(0.0)
                off.append(True)
                continue
            p = m.scores(counts)
            best = int(p.argmax())
            names.append(m.names[best])
            scores.append(float(p[best]))
            off.append(bool(p[best] < m.threshold))
        return pd.DataFrame({"lang_pred": names, "score": scores, "rejected": off})

    return docs.withColumn("_lang", judged(F.col(text))).select(*[F.col(c) for c in others], "_lang.*")


def teachable(fold: Column, docs: DataFrame) -> DataFrame:
    return docs.where(fold).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")


def op3_langid(spark, sf_dir: str) -> DataFrame:
    """Contract query: the predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = fold_of("doc_id", 3) == 1
    model = fit(teachable(~held, docs))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, by a model of their own labelled rows."""
    model = fit(teachable(fold_of("doc_id", 3) != 1, docs))
    out = predict(docs.select(F.struct("*").alias("row"), F.col("text")), model).where(~F.col("rejected"))
    return out.select("row.*")
