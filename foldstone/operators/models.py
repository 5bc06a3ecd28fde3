"""Classifiers fitted per fold.

Moment-based classifiers (centroids, Gaussian NB) get every fold's train side
from per-fold moments in one pass. The rest are MLlib estimators behind one
``fit_predict`` that standardises by train statistics only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import classification as C
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays as A
from ..functions.hashing import hash32
from ..session import materialise, settle
from ..vocab import SEED
from .evaluate import PRED, TRUE, score
from .cells import nearest_in_cells
from .neighbors import knn_vote, nearest
from .ranking import attach, vocabulary
from .vectors import apply_scaler, fit_scaler, leave_out_moments, moments

#: Up to this many classes a fold's centroids travel as one array per fold;
#: above it they are references of a blocked nearest-neighbour search.
CLASS_LIMIT = 2000

# ---------------------------------------------------------------- moment based


def _per_fold_classes(df: DataFrame, vec: str, label: str, fold: str) -> tuple[DataFrame, bool]:
    """Train moments per (fold, class), and whether the classes are few.

    The (fold, class) moments are stored once; every later step reads them.
    """
    parts = settle(moments(df, [fold, label], vec))
    few = parts.select(label).distinct().limit(CLASS_LIMIT + 1).count() <= CLASS_LIMIT
    return leave_out_moments(parts, fold, label), few


def nearest_centroid_oof(
    df: DataFrame, key: str, vec: str, label: str, fold: str = "fold"
) -> DataFrame:
    """``df`` with y_true and y_pred: nearest class mean of the other folds."""
    centres, few = _per_fold_classes(df, vec, label, fold)
    if not few:
        refs = centres.withColumn("_id", F.concat_ws("|", fold, label))
        queries = df.withColumn("_id", F.col(key).cast("string"))
        near = nearest(queries, refs.withColumnRenamed("mean", vec), 1, "_id", vec, label, fold, True)
        near = near.select("_id", F.col(label).alias(PRED))
        return queries.withColumn(TRUE, F.col(label)).join(near, "_id").drop("_id")
    # folds x classes rows, both checked above: a bounded broadcast
    listed = centres.groupBy(F.col(fold).alias("_f")).agg(
        F.collect_list(F.struct(F.col(label).alias("label"), "mean")).alias("_c")
    )
    best = F.array_min(
        F.transform("_c", lambda c: F.struct(A.squared_distance(F.col(vec), c["mean"]).alias("d"), c["label"].alias("l")))
    )
    return (
        df.join(F.broadcast(listed), F.col(fold) == F.col("_f"))
        .withColumn(TRUE, F.col(label))
        .withColumn(PRED, best["l"])
        .drop("_c", "_f")
    )


def gaussian_nb_oof(
    df: DataFrame, key: str, vec: str, label: str, fold: str = "fold", smoothing: float = 1e-9
) -> DataFrame:
    """``df`` with y_true and y_pred from per-class normal densities."""
    classes, few = _per_fold_classes(df, vec, label, fold)
    if not few:
        raise ValueError(f"more than {CLASS_LIMIT} classes")
    whole = leave_out_moments(settle(moments(df, fold, vec)), fold).select(
        F.col(fold).alias("_f"),
        F.col("n").alias("_all"),
        (F.array_max(F.transform("m2", lambda v: v / F.col("n"))) * smoothing).alias("_eps"),
    )
    fitted = classes.join(whole, F.col(fold) == F.col("_f")).select(
        "_f",
        F.struct(
            F.col(label).alias("label"),
            F.col("mean").alias("mean"),
            F.transform("m2", lambda v: v / F.col("n") + F.col("_eps")).alias("var"),
            F.ln(F.col("n") / F.col("_all")).alias("prior"),
        ).alias("c"),
    )
    listed = fitted.groupBy("_f").agg(F.collect_list("c").alias("_c"))

    def loglik(c):
        fit = F.zip_with(
            F.zip_with(F.col(vec), c["mean"], lambda x, m: (x - m) * (x - m)),
            c["var"],
            lambda d, v: d / v + F.ln(v * (2 * math.pi)),
        )
        return c["prior"] - 0.5 * A.total(fit)

    best = F.array_min(F.transform("_c", lambda c: F.struct((-loglik(c)).alias("s"), c["label"].alias("l"))))
    return (
        df.join(F.broadcast(listed), F.col(fold) == F.col("_f"))
        .withColumn(TRUE, F.col(label))
        .withColumn(PRED, best["l"])
        .drop("_c", "_f")
    )


def knn_oof(
    df: DataFrame, key: str, vec: str, label: str, fold: str = "fold", k: int = 5, weights: str = "uniform"
) -> DataFrame:
    """``df`` with y_true and y_pred: vote of the k nearest rows of other folds."""
    votes = knn_vote(nearest_in_cells(df, df, k, key, vec, label, fold), key, label, weights)
    return df.withColumn(TRUE, F.col(label)).join(votes, key)


# ---------------------------------------------------------------- MLlib based


def random_features(vec: Column, dim: int, width: int, gamma: float, seed: int = SEED) -> Column:
    """cos(W x + b) features whose dot products approximate an RBF kernel."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * gamma), (dim, width))
    b = rng.uniform(0.0, 2 * math.pi, width)

    @F.pandas_udf("array<double>")
    def lift(s: pd.Series) -> pd.Series:
        return pd.Series(list(np.sqrt(2.0 / width) * np.cos(np.stack(s.to_numpy()) @ w + b)))

    return lift(vec)


def _logistic(p, n, k):
    c = p.get("C", 1.0)
    return C.LogisticRegression(
        family="multinomial", maxIter=p.get("max_iter", 2000), regParam=1.0 / (c * n),
        standardization=False, featuresCol="_x", labelCol="_y", weightCol="_w",
    )


def _linear_svc(p, n, k):
    base = C.LinearSVC(
        maxIter=p.get("max_iter", 100), regParam=1.0 / (p.get("C", 1.0) * n), standardization=False
    )
    return C.OneVsRest(classifier=base, featuresCol="_x", labelCol="_y", weightCol="_w", parallelism=4)


def _forest(p, n, k):
    return C.RandomForestClassifier(
        numTrees=p.get("n_estimators", 100), maxDepth=p.get("max_depth", 20) or 30,
        minInstancesPerNode=p.get("min_samples_leaf", 1), seed=SEED,
        featuresCol="_x", labelCol="_y", weightCol="_w",
    )


def _boosting(p, n, k):
    base = C.GBTClassifier(maxIter=p.get("n_estimators", 100), maxDepth=p.get("max_depth", 6), stepSize=0.3, seed=SEED)
    return C.OneVsRest(classifier=base, featuresCol="_x", labelCol="_y", weightCol="_w", parallelism=4)


def _naive_bayes(p, n, k):
    return C.NaiveBayes(modelType="gaussian", featuresCol="_x", labelCol="_y", weightCol="_w")


def _perceptron(p, n, k):
    return C.MultilayerPerceptronClassifier(
        layers=[p["dim"], p.get("hidden", 256), k], maxIter=p.get("max_iter", 200), seed=SEED,
        featuresCol="_x", labelCol="_y", **({"initialWeights": p["start"]} if p.get("start") is not None else {}),
    )


#: name -> factory(params, total weight of the train rows, n_classes); users may add their own.
MODELS: dict[str, Callable] = {
    "svm-rbf": _linear_svc,
    "linear-svc": _linear_svc,
    "random-forest": _forest,
    "xgboost": _boosting,
    "logistic-regression": _logistic,
    "gaussian-nb": _naive_bayes,
    "mlp": _perceptron,
}

DEFAULTS: dict[str, dict] = {
    "svm-rbf": {"C": 1.0, "gamma": "scale", "width": 256},
    "linear-svc": {"C": 1.0},
    "random-forest": {"n_estimators": 100, "max_depth": None, "min_samples_leaf": 1},
    "xgboost": {"n_estimators": 100, "max_depth": 6},
    "logistic-regression": {"C": 1.0, "max_iter": 2000},
    "gaussian-nb": {},
    "mlp": {"hidden": 256, "max_iter": 200},
    "knn": {"n_neighbors": 5, "weights": "uniform"},
    "adaboost": {"n_estimators": 50},
}

#: FIXED VALUES -- grids searched inside a training fold
TUNING_GRIDS = {
    "svm-rbf": {"C": [1, 5, 10, 50], "gamma": ["scale", 0.01, 0.001]},
    "random-forest": {
        "n_estimators": [200, 500], "max_depth": [None, 20], "min_samples_leaf": [1, 3],
    },
    "logistic-regression": {"C": [0.1, 1, 10]},
    "knn": {"n_neighbors": [3, 5, 11, 21], "weights": ["uniform", "distance"]},
}


def default_params(name: str) -> dict:
    if name not in DEFAULTS:
        raise ValueError(f"unknown model {name!r}; expected one of {sorted(DEFAULTS)}")
    return dict(sorted(DEFAULTS[name].items()))


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``_w`` = n / (k * n_class)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    whole = sizes.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    factors = sizes.crossJoin(whole).select(label, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("_w"))
    return attach(df, factors, label, "inner")


@dataclass
class Fitted:
    """A fitted pipeline: scaler, optional lift, estimator and label names."""

    scaler: DataFrame | None
    lift: Callable[[Column], Column] | None
    model: object
    labels: list
    vec: str
    extra: dict = field(default_factory=dict)

    def prepare(self, df: DataFrame) -> DataFrame:
        x = apply_scaler(df.withColumn("_v", F.col(self.vec)), self.scaler, "_v")
        if self.lift is not None:
            x = x.withColumn("_v", self.lift(F.col("_v")))
        return x.withColumn("_x", array_to_vector("_v"))

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` + y_pred, and ``probability`` where the estimator has one."""
        out = self.model.transform(self.prepare(df))
        names = F.array(*[F.lit(x) for x in self.labels])
        keep = list(df.columns)
        if "probability" in out.columns:
            out = out.withColumn("probability", vector_to_array("probability"))
            keep.append("probability")
        return out.withColumn(PRED, F.get(names, F.col("prediction").cast("int"))).select(*keep, PRED)


def fit(
    name: str,
    train: DataFrame,
    vec: str,
    label: str,
    params: dict | None = None,
    weight: str | None = None,
    scale: str = "global",
    scaler: DataFrame | None = None,
) -> Fitted:
    """Fit scaler and estimator on train rows only."""
    if name == "adaboost":
        return fit_adaboost(train, vec, label, **(params or {}))
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; expected one of {sorted([*MODELS, 'adaboost', 'knn'])}")
    params = {**DEFAULTS.get(name, {}), **(params or {})}
    if weight:
        train = train.where(F.col(weight) > 0)
    amount = F.sum(F.col(weight).cast("double")) if weight else F.count(F.lit(1))
    sizes = train.groupBy(label).agg(amount.alias("n"), F.max(F.size(vec)).alias("dim"))
    found = sizes.limit(CLASS_LIMIT + 1).collect()
    if len(found) > CLASS_LIMIT:
        raise ValueError(f"more than {CLASS_LIMIT} classes")
    labels = sorted(r[label] for r in found)
    # the penalty is a share of the total weight, so scaled weights fit the same model
    n, dim = sum(r["n"] for r in found), max(r["dim"] for r in found)
    fitted = Fitted(scaler if scaler is not None else fit_scaler(train, vec, scale), None, None, labels, vec)
    if name == "svm-rbf":
        gamma = params.get("gamma", "scale")
        gamma = 1.0 / dim if gamma == "scale" else float(gamma)
        width = params.get("width", 256)
        fitted.lift = lambda v: random_features(v, dim, width, gamma)
    names = F.array(*[F.lit(x) for x in labels])
    rows = fitted.prepare(train).select(
        "_x",
        (F.array_position(names, F.col(label)) - 1).cast("double").alias("_y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"),
    )
    # fitted repeatedly over the same rows: kept in memory, spilling to disk
    rows = rows.persist()
    try:
        fitted.model = MODELS[name]({**params, "dim": dim}, n, len(labels)).fit(rows)
    finally:
        rows.unpersist()
    return fitted


def fit_predict(
    name: str, train: DataFrame, test: DataFrame, vec: str, label: str, key: str, **kwargs
) -> DataFrame:
    """Test rows with y_true, y_pred."""
    truth = test.withColumn(TRUE, F.col(label))
    if name == "knn":
        params = {**DEFAULTS["knn"], **(kwargs.get("params") or {})}
        scaler = fit_scaler(train, vec, kwargs.get("scale", "global"))
        near = nearest_in_cells(
            apply_scaler(truth, scaler, vec), apply_scaler(train, scaler, vec),
            params["n_neighbors"], key, vec, label,
        )
        return truth.join(knn_vote(near, key, label, params["weights"]), key)
    return fit(name, train, vec, label, **kwargs).predict(truth)


class _Ensemble:
    """Weighted vote of fitted stumps, in the shape of an MLlib model."""

    def __init__(self, members, k):
        self.members, self.k = members, k

    def transform(self, df: DataFrame) -> DataFrame:
        votes = F.array_repeat(F.lit(0.0), self.k)
        for alpha, model in self.members:
            model.setPredictionCol("_p").setRawPredictionCol("_r").setProbabilityCol("_q")
            df = model.transform(df).drop("_r", "_q")
            df = df.withColumn(
                "_votes",
                F.transform(
                    F.col("_votes") if "_votes" in df.columns else votes,
                    lambda v, i: v + F.when(F.col("_p") == i, F.lit(alpha)).otherwise(0.0),
                ),
            ).drop("_p")
        return df.withColumn("prediction", A.argmax(F.col("_votes")).cast("double")).drop("_votes")


def fit_adaboost(
    train: DataFrame, vec: str, label: str, n_estimators: int = 50, learning_rate: float = 1.0
) -> Fitted:
    """SAMME: reweighted depth-1 trees, one distributed fit per round."""
    labels = vocabulary(train, label)
    k = len(labels)
    fitted = Fitted(fit_scaler(train, vec, "global"), None, None, labels, vec)
    names = F.array(*[F.lit(x) for x in labels])
    rows = materialise(
        fitted.prepare(train).select(
            "_x", (F.array_position(names, F.col(label)) - 1).cast("double").alias("_y")
        ),
        "boost",
    )
    current = rows.withColumn("_w", F.lit(1.0))
    members: list = []
    for turn in range(n_estimators):
        stump = C.DecisionTreeClassifier(
            maxDepth=1, seed=SEED, featuresCol="_x", labelCol="_y", weightCol="_w"
        ).fit(current)
        scored = stump.transform(current)
        miss = F.col("prediction") != F.col("_y")
        sums = scored.agg(F.sum(F.when(miss, F.col("_w"))).alias("bad"), F.sum("_w").alias("all")).first()
        error = (sums["bad"] or 0.0) / sums["all"]
        if error <= 0:
            members.append((1.0, stump))
            break
        if error >= 1 - 1 / k:
            break
        alpha = learning_rate * (math.log((1 - error) / error) + math.log(k - 1))
        members.append((alpha, stump))
        current = scored.select(
            "_x", "_y", (F.when(miss, F.col("_w") * math.exp(alpha)).otherwise(F.col("_w")) / sums["all"]).alias("_w")
        )
        if turn % 5 == 4:
            current = materialise(current, "boost")
    fitted.model = _Ensemble(members, k)
    return fitted


# ---------------------------------------------------------------- tuning, runs


class MacroF1(Evaluator):
    """Macro-F1 over observed labels, as a selection metric."""

    def __init__(self, label: str = "_y"):
        super().__init__()
        self.label = label

    def _evaluate(self, dataset: DataFrame) -> float:
        pred = dataset.select(F.col(self.label).alias(TRUE), F.col("prediction").alias(PRED))
        return float(score(pred).first()["macro_f1"])

    def isLargerBetter(self) -> bool:
        return True


def _knn_grid(train: DataFrame, vec: str, label: str, key: str, inner: str, combos, n_folds: int) -> DataFrame:
    """Neighbours are searched once per fold at the largest k; every setting votes on them."""
    largest = max(c["n_neighbors"] for c in combos)
    near = None
    for f in range(n_folds):
        fit_rows, held = train.where(F.col(inner) != f), train.where(F.col(inner) == f)
        scaler = fit_scaler(fit_rows, vec, "global")
        part = nearest_in_cells(apply_scaler(held, scaler, vec), apply_scaler(fit_rows, scaler, vec), largest, key, vec, label)
        near = part if near is None else near.unionByName(part)
    # at most ``largest`` rows per key
    place = F.row_number().over(Window.partitionBy(key).orderBy("distance", "ref"))
    near = materialise(near.withColumn("_place", place), "neighbours")
    truth = train.select(key, F.col(inner).alias("_f"), F.col(label).alias(TRUE))
    out = None
    for i, c in enumerate(combos):
        votes = knn_vote(near.where(F.col("_place") <= c["n_neighbors"]), key, label, c.get("weights", "uniform"))
        part = truth.join(votes, key).select(F.lit(i).alias("ordinal"), "_f", TRUE, PRED)
        out = part if out is None else out.unionByName(part)
    return out


def tune(
    name: str,
    train: DataFrame,
    vec: str,
    label: str,
    inner: str,
    grid: dict | None = None,
    n_folds: int = 3,
    key: str = "key",
) -> tuple[dict, DataFrame]:
    """Grid search over the given inner fold column; first best wins ties.

    All held-out predictions are scored in one job.
    """
    grid = TUNING_GRIDS[name] if grid is None else grid
    combos = [dict(zip(grid, values)) for values in product(*grid.values())]
    if name == "knn":
        out = _knn_grid(train, vec, label, key, inner, combos, n_folds)
    else:
        out = None
        for i, params in enumerate(combos):
            for f in range(n_folds):
                part = fit_predict(
                    name, train.where(F.col(inner) != f), train.where(F.col(inner) == f), vec, label, key, params=params
                ).select(F.lit(i).alias("ordinal"), F.lit(f).alias("_f"), TRUE, PRED)
                out = part if out is None else out.unionByName(part)
    means = score(out, ["ordinal", "_f"]).groupBy("ordinal").agg(F.avg("macro_f1").alias("macro_f1"))
    rows = sorted((r["ordinal"], r["macro_f1"]) for r in means.collect())
    best = max(rows, key=lambda r: (r[1], -r[0]))[0]
    table = train.sparkSession.createDataFrame(
        [(i, str(combos[i]), m) for i, m in rows], "ordinal int, params string, macro_f1 double"
    )
    return combos[best], table


def cross_validate(
    estimator, param_maps, rows: DataFrame, fold_column: str, n_folds: int, parallelism: int = 4
):
    """MLlib's own search with our folds and macro-F1."""
    return CrossValidator(
        estimator=estimator, estimatorParamMaps=param_maps, evaluator=MacroF1(),
        numFolds=n_folds, foldCol=fold_column, parallelism=parallelism,
    ).fit(rows)


def logistic_grid(cs: Sequence[float], n: int, max_iter: int = 100):
    """(estimator, param maps) of the logistic grid in MLlib's terms."""
    base = C.LogisticRegression(
        family="multinomial", standardization=False, maxIter=max_iter, featuresCol="_x", labelCol="_y"
    )
    maps = ParamGridBuilder().addGrid(base.regParam, [1.0 / (c * n) for c in cs]).build()
    return base, maps


def run_folds(
    df: DataFrame,
    folds: Sequence[int],
    predict: Callable[[DataFrame, DataFrame], DataFrame],
    keep: Sequence[str],
    fold: str = "fold",
) -> DataFrame:
    """Union of the held-out predictions of every fold.

    ``predict(train, test)`` is any strategy: a model, a two-stage scheme, an
    augmented train side. Folds are few; each is its own distributed job.
    """
    out = None
    for f in folds:
        part = predict(df.where(F.col(fold) != f), df.where(F.col(fold) == f)).select(*keep, fold, TRUE, PRED)
        out = part if out is None else out.unionByName(part)
    return out


def soft_vote(tables: Sequence[DataFrame], key: str, labels: Sequence, probability: str = "probability") -> DataFrame:
    """(key, y_pred) from summed probability arrays of several heads."""
    union = tables[0].select(key, probability)
    for t in tables[1:]:
        union = union.unionByName(t.select(key, probability))
    width = len(labels)
    sums = union.groupBy(key).agg(
        F.array(*[F.sum(F.get(probability, F.lit(i))) for i in range(width)]).alias("_p")
    )
    names = F.array(*[F.lit(x) for x in labels])
    return sums.select(key, F.get(names, A.argmax(F.col("_p"))).alias(PRED))


def two_stage(
    train: DataFrame,
    test: DataFrame,
    vec: str,
    label: str,
    high: Sequence,
    model: str = "svm-rbf",
    params: dict | None = None,
) -> DataFrame:
    """Gate on the superclass, then a specialist per branch.

    A specialist only ever saw its branch's labels, so a prediction can not
    leave the branch the gate chose. Adds ``gate``.
    """
    high = list(high)
    band = F.when(F.col(label).isin(high), "high").otherwise("low")
    gate = fit(model, train.withColumn("_band", band), vec, "_band", params)
    routed = gate.predict(test.withColumn(TRUE, F.col(label))).withColumnRenamed(PRED, "gate")
    routed = routed.drop("probability") if "probability" in routed.columns else routed
    out = None
    for name in ("high", "low"):
        expert = fit(model, train.where(band == name), vec, label, params)
        part = expert.predict(routed.where(F.col("gate") == name))
        part = part.drop("probability") if "probability" in part.columns else part
        out = part if out is None else out.unionByName(part)
    return out


def hidden_layer(weights, dim: int, hidden: int) -> Callable[[Column], Column]:
    """Activations of a fitted perceptron's first layer, as a column function."""
    w = np.asarray(weights[: dim * hidden]).reshape((hidden, dim), order="F")
    b = np.asarray(weights[dim * hidden : (dim + 1) * hidden])

    @F.pandas_udf("array<double>")
    def forward(s: pd.Series) -> pd.Series:
        return pd.Series(list(1.0 / (1.0 + np.exp(-(np.stack(s.to_numpy()) @ w.T + b)))))

    return forward


def warm_start_head(
    stage1: DataFrame, stage2: DataFrame, test: DataFrame, vec: str, label: str, freeze: bool,
    hidden: int = 256, max_iter: int = 100,
) -> DataFrame:
    """Fit on stage 1, then continue on stage 2: all weights, or only the head."""
    dim = len(stage1.select(vec).first()[0])
    settings = {"hidden": hidden, "max_iter": max_iter}
    first = fit("mlp", stage1, vec, label, settings)
    truth = test.withColumn(TRUE, F.col(label))
    if not freeze:
        if vocabulary(stage2, label) != first.labels:
            raise ValueError("both stages need the same labels for a warm start")
        second = fit("mlp", stage2, vec, label, {**settings, "start": first.model.weights}, scaler=first.scaler)
        return second.predict(truth)
    forward = hidden_layer(first.model.weights.toArray(), dim, hidden)

    def embed(df):
        return apply_scaler(df, first.scaler, vec).withColumn(vec, forward(F.col(vec)))

    head = fit("logistic-regression", embed(stage2), vec, label, {"max_iter": max_iter}, scale="none")
    return head.predict(embed(truth))


def probabilities_by_hash(key: str, seed: str, width: int) -> Column:
    """A deterministic probability table for checks of :func:`soft_vote`."""
    raw = [hash32(seed, F.col(key), i) % 1000 for i in range(width)]
    return F.array(*[r / F.lit(1000.0) for r in raw])
