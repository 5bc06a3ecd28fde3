import numpy as np
import pytest
from pyspark.sql import functions as F

from foldstone.functions import arrays as A
from foldstone.functions.hashing import beta_symmetric, normal, uniform
from foldstone.operators import augment as G
from foldstone.operators import models as M
from foldstone.operators import neighbors as K
from foldstone.operators import series as R
from foldstone.operators import transfer as X
from foldstone.operators import vectors as N
from foldstone.operators.evaluate import score
from foldstone.sources import tables as B
from foldstone.session import scratch_path


@pytest.fixture(scope="module")
def points(spark):
    """Skewed: one label holds two thirds, one group most rows."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        label = "big" if i % 3 else f"l{i % 4}"
        rows.append((i, i % 2 if i % 5 else i % 11, label, [float(x) for x in rng.normal(hash(label) % 3, 1, 6)], i % 4))
    return spark.createDataFrame(rows, "key int, grp int, label string, vec array<double>, fold int").cache()


def matrix(df, column="vec"):
    rows = df.orderBy("key").collect()
    return np.array([r[column] for r in rows]), rows


def test_global_scaler_uses_train_rows_and_population_sd(points):
    train = points.where("fold <> 0")
    got, _ = matrix(N.apply_scaler(points, N.fit_scaler(train, "vec"), "vec"))
    x, rows = matrix(points)
    t = np.array([r["vec"] for r in rows if r["fold"] != 0])
    assert np.allclose(got, (x - t.mean(0)) / t.std(0))
    assert N.fit_scaler(train, "vec", "none") is None
    with pytest.raises(ValueError):
        N.fit_scaler(train, "vec", "per_speaker")
    with pytest.raises(ValueError):
        N.fit_scaler(train, "vec", "odd")


def test_constant_dimension_is_left_alone(spark):
    df = spark.createDataFrame([(i, [2.0, float(i)]) for i in range(4)], "key int, vec array<double>")
    got, _ = matrix(N.apply_scaler(df, N.fit_scaler(df, "vec"), "vec"))
    assert np.allclose(got[:, 0], 0.0)


def test_per_group_normalise(points):
    got, rows = matrix(N.per_group_normalise(points, "vec", "grp"))
    grp = np.array([r["grp"] for r in rows])
    x, _ = matrix(points)
    for g in set(grp):
        part = x[grp == g]
        assert np.allclose(got[grp == g], (part - part.mean(0)) / (part.std(0) + 1e-8))
    relabelled, _ = matrix(N.per_group_normalise(points.withColumn("label", F.lit("x")), "vec", "grp"))
    assert np.allclose(got, relabelled)


def test_leave_out_moments(points):
    parts = N.moments(points, "fold", "vec")
    out = {r["fold"]: r for r in N.leave_out_moments(parts, "fold").collect()}
    x, rows = matrix(points)
    fold = np.array([r["fold"] for r in rows])
    for f in range(4):
        t = x[fold != f]
        assert out[f]["n"] == len(t)
        assert np.allclose(out[f]["mean"], t.mean(0)) and np.allclose(np.array(out[f]["m2"]) / len(t), t.var(0))


def brute_knn(x, rows, k):
    keys, folds = [r["key"] for r in rows], np.array([r["fold"] for r in rows])
    out = {}
    for i, key in enumerate(keys):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[folds == folds[i]] = np.inf
        out[key] = [keys[j] for j in np.lexsort((keys, d))[:k]]
    return out


def test_nearest_equals_brute_force(points, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_ROWS", 50)
    x, rows = matrix(points)
    want = brute_knn(x, rows, 4)
    got = {}
    for r in K.nearest(points, points, 4, "key", "vec", "label", "fold").orderBy("key", "distance", "ref").collect():
        got.setdefault(r["key"], []).append(r["ref"])
    assert got == want


def brute_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i, l in enumerate(labels):
        same = labels == l
        if same.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, same].sum() / (same.sum() - 1)
        b = min(d[i, labels == o].mean() for o in set(labels) if o != l)
        out.append((b - a) / max(a, b))
    return np.mean(out)


def test_silhouette_equals_brute_force(spark, points, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_ROWS", 50)
    lone = spark.createDataFrame([(999, 0, "alone", [9.0] * 6, 0)], points.schema)
    df = points.unionByName(lone)
    x, rows = matrix(df)
    want = brute_silhouette(x, np.array([r["label"] for r in rows]))
    assert K.silhouette(df, "key", "vec", "label").first()["silhouette"] == pytest.approx(want)


def test_silhouette_with_many_labels(points, monkeypatch):
    """Labels inside a block are reduced there; a row emits few values per block."""
    monkeypatch.setattr(K, "BLOCK_ROWS", 40)
    df = points.withColumn("label", F.when(F.col("key") < 90, F.lit(-1)).otherwise(F.floor(F.col("key") / 2).cast("int")))
    x, rows = matrix(df)
    want = brute_silhouette(x, np.array([r["label"] for r in rows]))
    assert K.silhouette(df, "key", "vec", "label").first()["silhouette"] == pytest.approx(want)
    emitted = K.distance_sums(df, "key", "vec", "label").groupBy("key").count().agg(F.max("count")).first()[0]
    assert emitted <= 2 + K._block_count(240)


def test_vectors_are_not_copied_for_each_block(points, monkeypatch):
    """Pairs of blocks are a product of stored blocks: only reduced sums are shuffled."""
    monkeypatch.setattr(K, "BLOCK_ROWS", 40)
    plan = K.distance_sums(points, "key", "vec", "label")._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" not in plan and ("CartesianProduct" in plan or "NestedLoopJoin" in plan)


def test_centroids_and_many_class_path_agree(points, monkeypatch):
    few = {r["key"]: r["y_pred"] for r in M.nearest_centroid_oof(points, "key", "vec", "label").collect()}
    monkeypatch.setattr(M, "CLASS_LIMIT", 1)
    many = {r["key"]: r["y_pred"] for r in M.nearest_centroid_oof(points, "key", "vec", "label").collect()}
    assert few == many
    x, rows = matrix(points)
    fold, label = np.array([r["fold"] for r in rows]), np.array([r["label"] for r in rows])
    for i, r in enumerate(rows[:40]):
        names = sorted(set(label[fold != r["fold"]]))
        d = [((x[i] - x[(label == n) & (fold != r["fold"])].mean(0)) ** 2).sum() for n in names]
        assert few[r["key"]] == names[int(np.argmin(d))]


def test_tensor_selection(spark):
    rows = [(f"c{c}", l, s, [float(10 * l + c + j + (100 if s == "std" else 0)) for j in range(6)]) for c in range(4) for l in range(13) for s in ("mean", "std")]
    tensor = spark.createDataFrame(rows, "key string, layer int, stat string, vec array<double>")
    path = scratch_path(spark, "tensor")
    B.write_tensor(tensor, path)
    stored = B.read_tensor(spark, path)

    def pick(*args, **kwargs):
        return {r["key"]: r["vec"] for r in N.select_layer(stored, "key", *args, 13, **kwargs).collect()}

    one_hot = [1.0 if i == 6 else 0.0 for i in range(13)]
    assert pick("weighted", "mean", weights=one_hot) == pick(6, "mean")
    assert pick("last", "mean") == pick(12, "mean") == pick(-1, "mean")
    both = pick(3, "mean_std")
    assert all(v == pick(3, "mean")[k] + pick(3, "std")[k] for k, v in both.items())
    plan = N.select_layer(stored, "key", 6, "mean", 13)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(layer" in plan
    for bad in (13, -14):
        with pytest.raises(ValueError):
            pick(bad, "mean")
    with pytest.raises(ValueError):
        pick("weighted", "mean", weights=[1.0])


def test_pca_and_lda(points):
    x, _ = matrix(points)
    mean, axes, ratio = N.fit_pca(points, "vec", 3)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(mean, x.mean(0)) and np.allclose(ratio, values[:3] / values.sum())
    assert np.allclose(axes.T @ axes, np.eye(3), atol=1e-8)
    _, lda = N.fit_lda(points, "vec", "label")
    assert lda.shape == (6, points.select("label").distinct().count() - 1)


def test_deltas_match_local_fits(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(size=60)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "s string, frame_idx int, x double")
    for order, width in ((1, 9), (2, 7)):
        got = [r["d_x"] for r in R.deltas(df, "s", ["x"], width, order, piece=13).orderBy("frame_idx").collect()]
        h = width // 2
        want = []
        for t in range(60):
            c = min(max(t, h), 59 - h)
            fit = np.polyfit(np.arange(-h, h + 1), y[c - h : c + h + 1], order)
            want.append(fit[0] * (1 if order == 1 else 2))
        assert np.allclose(got, want)


def test_trim_and_masks(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([0.0, 0.1, 1.0, 0.5, 0.0001, 0.9, 0.0])], "s string, frame_idx int, p double")
    row = R.trim_bounds(df, "s", "p", 20).first()
    assert (row["first"], row["last"]) == (1, 5)
    assert R.trim(df, "s", "p", 20).count() == 5
    assert N.real_frames(df.withColumn("n", F.lit(3)), "n").count() == 3
    kept, report = N.cap_frames(df, "s", 4)
    assert kept.count() == 4 and report.first()["n_truncated"] == 1


def test_hash_draws_have_the_right_shape(spark):
    df = spark.range(20000).select(
        uniform("u", F.col("id")).alias("u"), normal("n", F.col("id")).alias("n"), beta_symmetric(0.4, "b", F.col("id")).alias("b")
    )
    r = df.agg(F.avg("u"), F.avg("n"), F.stddev("n"), F.avg("b"), F.variance("b"), F.min("b"), F.max("b")).first()
    assert abs(r[0] - 0.5) < 0.01 and abs(r[1]) < 0.03 and abs(r[2] - 1) < 0.02
    assert abs(r[3] - 0.5) < 0.01 and abs(r[4] - 0.25 / 1.8) < 0.005 and 0 <= r[5] and r[6] <= 1


def test_mixup(points):
    mixed = G.mixup(points, "key", "vec", "label", "grp", 1.5, "s").collect()
    x = {r["key"]: r for r in points.collect()}
    sizes = {r["label"]: r["count"] for r in points.groupBy("label").count().collect()}
    counts = {}
    for r in mixed:
        counts[r["label"]] = counts.get(r["label"], 0) + 1
        a, b = x[r["a"]], x[r["b"]]
        assert a["label"] == b["label"] == r["label"] and r["a"] != r["b"]
        assert np.allclose(r["vec"], r["weight"] * np.array(a["vec"]) + (1 - r["weight"]) * np.array(b["vec"]))
    assert counts == {l: round(n * 1.5) for l, n in sizes.items()}
    cross = np.mean([x[r["a"]]["grp"] != x[r["b"]]["grp"] for r in mixed])
    # small labels have four rows of five in one group: nine partners are all of it with 0.8^9, so 0.955 is expected, sd 0.01
    assert cross > 0.92


def test_mixup_single_group_and_single_row(spark):
    df = spark.createDataFrame([(0, 1, "a", [1.0]), (1, 1, "a", [2.0]), (2, 1, "b", [5.0])], "key int, grp int, label string, vec array<double>")
    rows = G.mixup(df, "key", "vec", "label", "grp", 1.0, "s").collect()
    assert len(rows) == 2 and {r["label"] for r in rows} == {"a"}


def test_noise_hits_the_ratio(spark):
    df = spark.createDataFrame([(1, [float(np.sin(i / 5)) for i in range(4000)]), (2, [0.0] * 10)], "key int, y array<double>")
    rows = {r["key"]: r for r in df.withColumn("z", G.noise_at_snr(F.col("y"), F.col("key"), 20.0, 7)).collect()}
    y, z = np.array(rows[1]["y"]), np.array(rows[1]["z"])
    assert 10 * np.log10((y**2).mean() / ((z - y) ** 2).mean()) == pytest.approx(20, abs=0.5)
    assert rows[2]["z"] == [0.0] * 10


def test_lineage_is_idempotent(spark):
    from foldstone.config import DEFAULT_AUGMENTATIONS

    df = spark.createDataFrame([("a.wav",), ("b.wav",)], "filename string")
    plan = G.materialise_plan(df, DEFAULT_AUGMENTATIONS)
    assert plan.count() == 6
    assert G.materialise_plan(df, DEFAULT_AUGMENTATIONS, plan).count() == 0
    assert G.admit_to_train(plan, df.where("filename = 'a.wav'")).count() == 3
    back = plan.select(G.source_key(F.col("filename")).alias("s"), "source_filename")
    assert back.where("s <> source_filename").count() == 0


# --------------------------------------------------------------------- models


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(0)
    rows = []
    for j, label in enumerate(("angry", "calm", "sad")):
        for i in range(40):
            rows.append((40 * j + i, [float(v) for v in rng.normal(4 * j, 1, 6)], label, i % 8))
    return spark.createDataFrame(rows, "key int, vec array<double>, label string, grp int").withColumn("fold", F.col("grp") % 4).cache()


FAST = {
    "logistic-regression": {"max_iter": 10}, "linear-svc": {"max_iter": 5}, "svm-rbf": {"max_iter": 5, "width": 32},
    "random-forest": {"n_estimators": 5, "max_depth": 4}, "xgboost": {"n_estimators": 2, "max_depth": 2},
    "gaussian-nb": {}, "mlp": {"hidden": 8, "max_iter": 40}, "adaboost": {"n_estimators": 4}, "knn": {"n_neighbors": 3},
}


@pytest.mark.parametrize("name", sorted(FAST))
def test_models_learn_string_labels(toy, name):
    out = M.fit_predict(name, toy.where("fold <> 0"), toy.where("fold = 0"), "vec", "label", "key", params=FAST[name])
    row = score(out).first()
    assert row["n"] == 30 and row["accuracy"] > 0.5


def test_unknown_model(toy):
    with pytest.raises(ValueError):
        M.fit("nope", toy, "vec", "label")
    with pytest.raises(ValueError):
        M.default_params("nope")


def test_oof_models(toy):
    for oof in (M.nearest_centroid_oof, M.gaussian_nb_oof, M.knn_oof):
        out = oof(toy, "key", "vec", "label")
        assert out.count() == 120 and score(out).first()["accuracy"] > 0.9


def test_two_stage_cannot_cross_branches(toy):
    out = M.two_stage(toy.where("fold <> 0"), toy.where("fold = 0"), "vec", "label", ["angry"], "logistic-regression", {"max_iter": 5})
    assert out.count() == 30
    assert out.where("(gate = 'high') <> (y_pred = 'angry')").count() == 0


def test_tuning_picks_first_best(toy):
    best, table = M.tune("knn", toy, "vec", "label", "fold", {"n_neighbors": [3, 5], "weights": ["uniform"]}, n_folds=2)
    rows = table.orderBy("ordinal").collect()
    top = max(r["macro_f1"] for r in rows)
    assert str(best) == next(r["params"] for r in rows if r["macro_f1"] == top)


def test_mllib_search_with_own_folds(toy):
    fitted = M.Fitted(None, None, None, ["angry", "calm", "sad"], "vec")
    names = F.array(*[F.lit(x) for x in fitted.labels])
    rows = fitted.prepare(toy).select("_x", (F.array_position(names, F.col("label")) - 1).cast("double").alias("_y"), (F.col("fold") % 2).cast("int").alias("f"))
    estimator, maps = M.logistic_grid([0.1, 10], 120, 5)
    model = M.cross_validate(estimator, maps, rows, "f", 2)
    assert len(model.avgMetrics) == 2 and max(model.avgMetrics) > 0.9


def test_balanced_weights(toy):
    out = M.balanced_weights(toy.where("label <> 'sad' OR key % 2 = 0"), "label").groupBy("label").agg(F.sum("_w").alias("w")).collect()
    assert all(r["w"] == pytest.approx(100 / 3) for r in out)


def test_weights_and_subsets(toy):
    df = toy.withColumn("source", F.when(F.col("grp") < 4, "base").otherwise("ext"))
    assert X.weighted_train(df, "source", "base", 0.0).count() == 60
    assert X.weighted_train(df, "source", "base", 0.2).agg(F.sum("weight")).first()[0] == pytest.approx(72)
    assert X.subsets(["a", "b", "c"])[:4] == [(), ("a",), ("b",), ("c",)] and len(X.subsets(["a", "b", "c"])) == 8
    w = X.importance_weights(df, "source", "base", "vec", 5)
    assert w.where("source = 'base' AND weight <> 1").count() == 0
    assert w.where("weight < 0 OR weight > 10").count() == 0


def test_array_helpers(spark):
    row = spark.sql("select array(1D, 2D, 5D) a, array(1D, 1D, 1D) b").select(
        A.distance("a", "b").alias("d"), A.argmax(F.col("a")).alias("m"), A.rounded("a", 0).alias("r"), A.concat_all([F.col("a"), F.col("b")]).alias("c"), A.as_double("a").alias("e")
    ).first()
    assert row["d"] == pytest.approx(np.sqrt(17)) and row["m"] == 2 and len(row["c"]) == 6


def test_levers_do_not_see_test_labels(spark):
    from foldstone.catalog.vectors import lever_tables

    rng = np.random.default_rng(2)
    rows = [(i, i % 3, (rng.normal(size=18) + (i % 3)).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "key int, label int, vec array<double>")
    train, test = df.where("key >= 40"), df.where("key < 40")
    moved = test.withColumn("label", (F.col("label") + 1) % 3)

    def projected(rows):
        return {n: sorted((r["key"], [round(x, 9) for x in r["vec"]]) for r in t[1].collect()) for n, t in lever_tables(train, rows).items()}

    assert projected(test) == projected(moved)


def test_weights_fit_as_repeated_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, (rng.normal(size=4) + (i % 2)).tolist(), float(i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "key int, label int, vec array<double>, w double")
    repeated = df.where("w > 0").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    scaler = N.fit_scaler(df, "vec")
    fits = [
        M.fit("logistic-regression", table, "vec", "label", {"max_iter": 200}, weight=w, scaler=scaler).model.coefficientMatrix.toArray()
        for table, w in ((df, "w"), (repeated, None))
    ]
    assert np.allclose(fits[0], fits[1], atol=1e-3)


def test_batch_inference_loads_a_model_once_a_worker(spark, tmp_path):
    from foldstone.operators import vectors as N

    log = str(tmp_path / "loads")

    def load():
        import os

        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda x: np.stack([x.reshape(len(x), 2, 3), -x.reshape(len(x), 2, 3)], axis=1)

    rows = spark.createDataFrame([(i, [float(i + j) for j in range(6)]) for i in range(400)] + [(999, [1.0])], "key long, vec array<double>").coalesce(2)
    out = N.encode_batches(rows, load, "key", "vec", 6, (2, 2, 3), batch_size=16).collect()
    assert len(out) == 400 * 4
    got = {(r["key"], r["layer"], r["frame_idx"]): r["vec"] for r in out}
    assert got[7, 0, 1] == [10.0, 11.0, 12.0] and got[7, 1, 0] == [-7.0, -8.0, -9.0]
    pids = open(log).read().split()
    assert len(pids) == len(set(pids)) <= 8  # 400 rows are 25 batches
