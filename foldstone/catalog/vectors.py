"""Normalisation, stored layers, classifiers and diagnostics over vectors."""

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays as A
from ..functions.hashing import hash32
from ..operators import augment as G
from ..operators import diagnose as D
from ..operators import evaluate as E
from ..operators import boosting as BO
from ..operators import forest as FO
from ..operators import models as M
from ..operators import perceptron as NN
from ..operators import series as R
from ..operators import stacked as ST
from ..operators import splits as S
from ..operators import transfer as X
from ..operators import uncertainty as U
from ..operators import vectors as N
from ..operators import wide as WD
from ..operators.cells import nearest_in_cells
from ..config import DEFAULT_AUGMENTATIONS
from ..vocab import ARMS, N_BOOT, WEIGHT_GRID
from ..session import materialise
from ..plans import merged as PM
from ..plans import scoring as PS
from .base import (
    OBS, PRED, VECS, docs, h, obs, pred, query, read, rounded, score_sql, snake_sql, tidy, vecs,
)
from .evaluation import RESULTS, _boot_sql, results
from .profiling import SERIES, series
from .storage import TENSOR, R6, tensor

K = 5
EL = f"""{VECS}, el AS (SELECT key, grp, label, unnest(vec) AS v, generate_subscripts(vec, 1) AS p FROM vecs),
 z AS (SELECT key, grp, label, p, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-8) AS v FROM el WINDOW w AS (PARTITION BY grp, p)),
 gf AS ({snake_sql('vecs', 'grp', K)})"""


def centroid_sql(src: str, name: str, label: str = "label") -> str:
    """{name}(key, y_true, y_pred, fold) from {src}(key, label, fold, p, v)."""
    return f"""{name}_c AS (SELECT t.f AS fold, {label} AS label, p, avg(v) AS c FROM {src}, range({K}) AS t(f) WHERE {src}.fold <> t.f GROUP BY ALL),
 {name}_d AS (SELECT s.key, s.fold, s.{label} AS y_true, c.label AS y_pred, sum((s.v - c.c) * (s.v - c.c)) AS d FROM {src} s JOIN {name}_c c ON c.fold = s.fold AND c.p = s.p GROUP BY ALL),
 {name} AS (SELECT key, fold, y_true, y_pred FROM {name}_d QUALIFY row_number() OVER (PARTITION BY key ORDER BY d, y_pred) = 1)"""


FLAG = f"{EL}, zf AS (SELECT z.*, gf.fold FROM z JOIN gf USING (grp)), {centroid_sql('zf', 'oof')}"
RAWF = f"{EL}, rf AS (SELECT el.*, gf.fold FROM el JOIN gf USING (grp)), {centroid_sql('rf', 'oof')}"
T = "t AS (SELECT y_true, y_pred, count(*) AS n FROM oof GROUP BY ALL)"
SCORES = ["accuracy", "macro_f1", "weighted_f1", "macro_f1_present"]


def folded(spark, d):
    return S.with_group_fold(vecs(spark, d), "grp", K, "snake")


def flagship_predictions(spark, d):
    return PS.group_safe_predictions(vecs(spark, d), "key", "vec", "label", "grp", K, "snake")


@query("flagship", rounded(f"WITH {FLAG}, {T} {score_sql('t')}", *SCORES))
def flagship(spark, d):
    """Group folds, in-group normalisation, nearest centroid, pooled scores."""
    return tidy(E.score(flagship_predictions(spark, d)))


# --------------------------------------------------------------- normalisation


@query("nrm_01", f"""WITH {EL}, tr AS (SELECT p, avg(v) AS m, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS s FROM el JOIN gf USING (grp) WHERE fold <> 0 GROUP BY p)
SELECT key, list(round((v - m) / s, 6) + 0e0 ORDER BY p) AS vec FROM el JOIN tr USING (p) GROUP BY key""")
def scaler(spark, d):
    rows = folded(spark, d)
    return tidy(N.apply_scaler(rows, N.fit_scaler(rows.where("fold <> 0"), "vec"), "vec").select("key", "vec"))


@query("nrm_02", f"WITH {EL} SELECT key, list(round(v, 6) + 0e0 ORDER BY p) AS vec FROM z GROUP BY key")
def per_group(spark, d):
    return tidy(N.per_group_normalise(vecs(spark, d), "vec", "grp").select("key", "vec"))


@query("nrm_03", rounded(f"WITH {OBS} SELECT key, (x - avg(x) OVER (PARTITION BY grp)) / (stddev_pop(x) OVER (PARTITION BY grp) + 1e-8) AS z FROM obs", "z"))
def frame_norm(spark, d):
    return tidy(N.group_zscore(obs(spark, d), "x", "grp", "z").select("key", "z"))


@query("nrm_04", f"""WITH {VECS}, c AS (SELECT key, vec[1:40] AS vec FROM vecs)
SELECT key, list_transform(vec, lambda x: round(x / list_max(list_transform(vec, lambda y: abs(y))), 6) + 0e0) AS vec FROM c""")
def peak(spark, d):
    rows = vecs(spark, d).withColumn("vec", N.truncate(F.col("vec"), 0.5, 80))
    return tidy(rows.select("key", N.peak_normalise(F.col("vec")).alias("vec")))


# ------------------------------------------------------------------ embeddings


def stub_encoder(signals):
    """Three layers of 16-sample frames, scaled by layer."""
    import numpy as np

    return [np.stack([s.reshape(-1, 16) * (l + 1) for l in range(3)]) for s in signals]


def encoded(spark, d):
    rows = vecs(spark, d).withColumn("sr", F.lit(16000))
    return N.encode_frames(rows, stub_encoder, "key", "vec", "sr", 16000)


@query("emb_01", f"""WITH {VECS}, el AS (SELECT key, unnest(vec) AS v, generate_subscripts(vec, 1) - 1 AS p FROM vecs),
 f AS (SELECT key, l AS layer, p // 16 AS frame, p % 16 AS q, v * (l + 1) AS v FROM el, range(3) AS t(l)),
 s AS (SELECT key, layer, q, avg(v) AS m, stddev_pop(v) AS sd FROM f GROUP BY ALL)
SELECT key, layer, 'mean' AS stat, list(round(m, 6) + 0e0 ORDER BY q) AS vec FROM s GROUP BY ALL
UNION ALL SELECT key, layer, 'std', list(round(sd, 6) + 0e0 ORDER BY q) FROM s GROUP BY ALL""")
def encode(spark, d):
    """Batch inference: the encoder is loaded once a worker."""

    def load():
        import numpy as np

        return lambda x: np.stack([x.reshape(len(x), -1, 16) * (l + 1) for l in range(3)], axis=1)

    return tidy(N.pool_frames(N.encode_batches(vecs(spark, d), load, "key", "vec", 64, (3, 4, 16)), "key"))


@query("emb_02", f"WITH {SERIES} SELECT key, grp, frame_idx FROM series WHERE frame_idx < grp % 50 + 20")
def unpadded(spark, d):
    return N.real_frames(series(spark, d).withColumn("length", F.col("grp") % 50 + 20), "length").select("key", "grp", "frame_idx")


@query("emb_03", f"WITH {TENSOR} SELECT m.key, list_concat({R6.format('m.vec')}, {R6.format('s.vec')}) AS vec FROM tensor m JOIN tensor s USING (key, layer) WHERE layer = 3 AND m.stat = 'mean' AND s.stat = 'std'")
def select_last(spark, d):
    return tidy(N.select_layer(tensor(spark, d), "key", "last", "mean_std", 4))


@query("emb_04", f"""WITH {TENSOR}, el AS (SELECT key, layer, unnest(vec) AS v, generate_subscripts(vec, 1) AS p FROM tensor WHERE stat = 'mean'),
 s AS (SELECT key, p, sum(v * ([0.1, 0.2, 0.3, 0.4]::DOUBLE[])[layer + 1]) AS v FROM el GROUP BY ALL) SELECT key, list(round(v, 6) + 0e0 ORDER BY p) AS vec FROM s GROUP BY key""")
def weighted(spark, d):
    return tidy(N.select_layer(tensor(spark, d), "key", "weighted", "mean", 4, [0.1, 0.2, 0.3, 0.4]))


@query("emb_05", f"""WITH {TENSOR}, c AS (SELECT a.key, list_concat(a.vec, b.vec) AS vec FROM tensor a JOIN tensor b USING (key, stat) WHERE stat = 'mean' AND a.layer = 3 AND b.layer = 1)
SELECT key, {R6.format('vec')} AS vec FROM c""")
def layer_concat(spark, d):
    return tidy(N.concat_layers(tensor(spark, d), "key", [3, 1]))


@query("emb_06", f"""WITH {SERIES}, l AS (SELECT grp, max(frame_idx) + 1 AS n FROM series GROUP BY grp)
SELECT count(*) AS n_series, count(*) FILTER (WHERE n > 60) AS n_truncated, max(n) AS longest, (SELECT count(*) FROM series WHERE frame_idx < 60) AS kept FROM l""")
def capped(spark, d):
    kept, report = N.cap_frames(series(spark, d), "grp", 60)
    return report.crossJoin(kept.agg(F.count(F.lit(1)).alias("kept")))


def _projected(spark, d, fit, out):
    """Every row on the axes of its fold's train side, scaled by that side's statistics."""
    rows = materialise(folded(spark, d), "folded")

    def one(f):
        scaled = N.apply_scaler(rows, N.fit_scaler(rows.where(F.col("fold") != f), "vec"), "vec")
        mean, axes, ratio = fit(scaled.where(F.col("fold") != f))
        held = N.project(scaled.where(F.col("fold") == f), "vec", mean, axes, out)
        return materialise(held.withColumn("ratio", F.array(*[F.lit(float(r)) for r in ratio])), "axes")

    return _at_once(spark, one, range(K))


@query("emb_07")
def pca(spark, d):
    return tidy(_projected(spark, d, lambda train: N.fit_pca(train, "vec", 8), "pcs").select("key", "label", "pcs"))


@query("emb_08")
def lda(spark, d):
    return tidy(_projected(spark, d, lambda train: (*N.fit_lda(train, "vec", "label"), ()), "ldas").select("key", "label", "ldas"))


#: every vector beside its products of two components, i <= j: 64 become 2,144
_LIFTED = f"""{VECS}, gf AS ({snake_sql('vecs', 'grp', K)}), base AS (SELECT key, label, vec, gf.fold FROM vecs JOIN gf USING (grp)),
 wide AS (SELECT key, label, fold, list_concat(vec, flatten(list_transform(range(1, len(vec) + 1), lambda i: list_transform(range(i, len(vec) + 1), lambda j: vec[i] * vec[j])))) AS vec FROM base),
 cells AS (SELECT fold, unnest(vec) AS v, generate_subscripts(vec, 1) AS p FROM wide),
 spread AS (SELECT fold, sum(s) AS total FROM (SELECT t.f AS fold, p, var_samp(v) AS s FROM cells, range({K}) AS t(f) WHERE cells.fold <> t.f GROUP BY ALL) AS _s GROUP BY fold)"""


def lifted(spark, d):
    """Fold rows with all second-order products of their vectors, stored."""
    products = F.flatten(F.transform("vec", lambda x, i: F.transform(F.slice("vec", i + 1, F.size("vec")), lambda y: x * y)))
    return materialise(folded(spark, d).select("key", "label", "fold", F.concat("vec", products).alias("vec")), "lifted")


@query("emb_07_wide", rounded(f"""WITH {_LIFTED} SELECT t.f::INT AS fold, (SELECT count(*) FROM base WHERE fold <> t.f) AS n, (SELECT count(*) FROM base WHERE fold = t.f) AS held,
 (SELECT total FROM spread WHERE fold = t.f) AS total, 8 AS axes, true AS converged, true AS orthonormal, true AS same_variances, true AS uncorrelated FROM range({K}) AS t(f)""", "total"))
def wide_pca(spark, d):
    """Principal axes of 2,144 columns for every fold, with what must hold of them whatever their signs.

    The scores of the train side are projected again and measured by Spark:
    their variances are those reported, and they do not correlate.
    """
    rows = lifted(spark, d)
    fits = WD.fit_pca(rows, "vec", 8, fold="fold")
    parts = []
    for f, fit in fits.items():
        flags = {
            "converged": fit.residual <= 1e-6,
            "orthonormal": bool(abs(fit.axes.T @ fit.axes - np.eye(fit.axes.shape[1])).max() < 1e-9),
        }
        train = WD.project(rows.where(F.col("fold") != f), "vec", {None: fit}, "pcs")
        part = N.scatter(train, [], "pcs").select(
            F.lit(f).alias("fold"), "n", (fit.values.sum() / F.lit(float(fit.ratio.sum()))).alias("total"),
            F.lit(fit.axes.shape[1]).alias("axes"), *[F.lit(v).alias(c) for c, v in flags.items()],
            F.array(*[F.lit(float(v)) for v in fit.values]).alias("_v"), "flat",
        )
        parts.append(part)
    k = F.col("axes")
    # flat holds the sums and then the sums of products, row by row
    cov = F.transform(
        F.sequence(F.lit(0), k * k - 1),
        lambda c: (F.get("flat", k + c) - F.get("flat", (c / k).cast("int")) * F.get("flat", c % k) / F.col("n")) / (F.col("n") - 1),
    )
    out = reduce(DataFrame.unionByName, parts).withColumn("_c", cov)
    top = F.get("_v", F.lit(0))
    same = F.forall(F.sequence(F.lit(0), k - 1), lambda i: F.abs(F.get("_c", i * (k + 1)) - F.get("_v", i)) < 1e-8 * top)
    apart = F.forall(F.sequence(F.lit(0), k * k - 1), lambda c: (c % (k + 1) == 0) | (F.abs(F.get("_c", c)) < 1e-8 * top))
    held = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("held"))
    return tidy(out.join(held, "fold").select("fold", "n", "held", "total", "axes", "converged", "orthonormal", same.alias("same_variances"), apart.alias("uncorrelated")))


@query("emb_08_wide", f"""WITH {VECS}, gf AS ({snake_sql('vecs', 'grp', K)}), base AS (SELECT key, label, fold FROM vecs JOIN gf USING (grp))
SELECT t.f::INT AS fold, count(*) AS n, count(DISTINCT label) - 1 AS axes, true AS solved, true AS unit_within FROM base, range({K}) AS t(f) WHERE fold <> t.f AND label IS NOT NULL GROUP BY ALL""")
def wide_lda(spark, d):
    """Discriminant axes of 2,144 columns for every fold; within a class their scores have at most unit scatter.

    It is exactly one with the ridge counted, whose share is what lies between.
    """
    rows = lifted(spark, d).where("label IS NOT NULL")
    fits = WD.fit_lda(rows, "vec", "label", fold="fold")
    parts = []
    for f, fit in fits.items():
        train = WD.project(rows.where(F.col("fold") != f), "vec", {None: fit}, "lda")
        parts.append(N.moments(train, "label", "lda").select(
            F.lit(f).alias("fold"), "n", "m2", F.lit(fit.axes.shape[1]).cast("bigint").alias("axes"), F.lit(fit.residual <= 1e-8).alias("solved"),
        ))
    table = reduce(DataFrame.unionByName, parts)
    out = table.select("fold", "n", "axes", "solved", F.posexplode("m2").alias("p", "m2")).groupBy("fold", "axes", "solved", "p").agg(
        F.sum("n").alias("n"), F.sum("m2").alias("w"))
    return out.groupBy("fold", "axes", "solved").agg(F.max("n").alias("n"), F.min((F.col("w") > 0) & (F.col("w") <= 1 + 1e-6)).alias("unit_within"))


# ----------------------------------------------------------- frame aggregates


@query("fea_04", rounded(f"""WITH {SERIES}, d AS (SELECT key, grp, frame_idx, count(*) OVER (PARTITION BY grp) AS n,
  (4 * (lead(x, 4) OVER w - lag(x, 4) OVER w) + 3 * (lead(x, 3) OVER w - lag(x, 3) OVER w) + 2 * (lead(x, 2) OVER w - lag(x, 2) OVER w) + (lead(x) OVER w - lag(x) OVER w)) / 60 AS dx
  FROM series WINDOW w AS (PARTITION BY grp ORDER BY frame_idx))
SELECT a.key, b.dx AS d_x FROM d a JOIN d b ON a.grp = b.grp AND b.frame_idx = greatest(4, least(a.frame_idx, a.n - 5))""", "d_x"))
def deltas(spark, d):
    frames = series(spark, d).select("key", "grp", "frame_idx", "x")
    return tidy(R.deltas(frames, "grp", ["x"], 9, 1, piece=16).select("key", "d_x"))


@query("fea_04_second", rounded(f"""WITH {SERIES}, d AS (SELECT key, grp, frame_idx, count(*) OVER (PARTITION BY grp) AS n,
  2e0 * (2 * (lead(x, 2) OVER w + lag(x, 2) OVER w) - (lead(x) OVER w + lag(x) OVER w) - 2 * x) / 14 AS dx
  FROM series WINDOW w AS (PARTITION BY grp ORDER BY frame_idx))
SELECT a.key, b.dx AS dd_x FROM d a JOIN d b ON a.grp = b.grp AND b.frame_idx = greatest(2, least(a.frame_idx, a.n - 3))""", "dd_x"))
def second_deltas(spark, d):
    frames = series(spark, d).select("key", "grp", "frame_idx", "x")
    return tidy(R.deltas(frames, "grp", ["x"], 5, 2, prefix="dd_").select("key", "dd_x"))


@query("fea_05", rounded(f"""WITH {OBS} SELECT grp, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max, quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.25) AS p25,
 quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, quantile_cont(x, 0.9) AS p90 FROM obs GROUP BY grp""", "mean", "std", "min", "max", "p10", "p25", "p50", "p75", "p90"))
def aggregates(spark, d):
    rows = obs(spark, d)
    return tidy(R.aggregate_values(rows, "grp", "x", "mean_std_min_max").join(R.aggregate_values(rows, "grp", "x", "percentiles"), "grp"))


@query("fea_05_vectors", f"""WITH {EL}, s AS (SELECT grp, p, avg(v) AS a, stddev_pop(v) AS b, min(v) AS c, max(v) AS d FROM el GROUP BY ALL)
SELECT grp, list_concat(list_concat(list(round(a, 6) + 0e0 ORDER BY p), list(round(b, 6) + 0e0 ORDER BY p)), list_concat(list(round(c, 6) + 0e0 ORDER BY p), list(round(d, 6) + 0e0 ORDER BY p))) AS features FROM s GROUP BY grp""")
def vector_aggregates(spark, d):
    return tidy(R.aggregate_vectors(vecs(spark, d), "grp", "vec", "mean_std_min_max"))


@query("fea_08", """SELECT n, 'mfcc' || n || '-d-dd-mean_std-trim' || CASE WHEN n = 20 THEN '-per_speaker' ELSE '' END AS name FROM (SELECT DISTINCT CASE WHEN label < 5 THEN 40 ELSE 20 END AS n FROM embeddings) AS _t""")
def config_names(spark, d):
    from ..config import FeatureSettings

    big, small = FeatureSettings(), FeatureSettings(n_mfcc=20, normalisation="per_speaker")
    n = F.when(F.col("label") < 5, big.n_mfcc).otherwise(small.n_mfcc)
    return read(spark, d, "embeddings").select(n.alias("n")).distinct().withColumn("name", F.when(F.col("n") == 40, big.name).otherwise(small.name))


# --------------------------------------------------------------------- models


@query("mdl_06", rounded(f"""WITH {VECS}, gf AS ({snake_sql('vecs', 'grp', K)}), vf AS (SELECT vecs.*, fold FROM vecs JOIN gf USING (grp)),
 nn AS (SELECT a.key, a.label AS y_true, b.label, list_distance(a.vec, b.vec) AS dist FROM vf a JOIN vf b ON a.fold <> b.fold
   QUALIFY row_number() OVER (PARTITION BY a.key ORDER BY list_distance(a.vec, b.vec), b.key) <= 5),
 oof AS (SELECT key, y_true, label AS y_pred FROM (SELECT key, y_true, label, count(*) AS c FROM nn GROUP BY ALL) AS _v
   QUALIFY row_number() OVER (PARTITION BY key ORDER BY c DESC, label) = 1), {T} {score_sql('t')}""", *SCORES))
def knn(spark, d):
    return tidy(E.score(M.knn_oof(folded(spark, d), "key", "vec", "label")))


@query("mdl_06_neighbours", rounded(f"""WITH {VECS}, gf AS ({snake_sql('vecs', 'grp', K)}), vf AS (SELECT vecs.*, fold FROM vecs JOIN gf USING (grp))
SELECT a.key, list_distance(a.vec, b.vec) AS distance, b.key AS ref, b.label FROM vf a JOIN vf b ON a.fold <> b.fold
  QUALIFY row_number() OVER (PARTITION BY a.key ORDER BY list_distance(a.vec, b.vec), b.key) <= 5""", "distance"))
def neighbours(spark, d):
    """The five nearest rows of other folds, through the cell index."""
    rows = folded(spark, d)
    return tidy(nearest_in_cells(rows, rows, 5, "key", "vec", "label", "fold"))


@query("mdl_08", rounded(f"""WITH {EL}, rf AS (SELECT el.*, gf.fold FROM el JOIN gf USING (grp)),
 e AS (SELECT f AS fold, max(vv) * 1e-9 AS eps FROM (SELECT t.f, p, var_pop(v) AS vv FROM rf, range({K}) AS t(f) WHERE fold <> t.f GROUP BY ALL) AS _e GROUP BY f),
 n AS (SELECT t.f AS fold, label, count(DISTINCT key) AS c, sum(count(DISTINCT key)) OVER (PARTITION BY t.f) AS tot FROM rf, range({K}) AS t(f) WHERE fold <> t.f GROUP BY t.f, label),
 s AS (SELECT t.f AS fold, label, p, avg(v) AS m, var_pop(v) AS vv FROM rf, range({K}) AS t(f) WHERE fold <> t.f GROUP BY ALL),
 l AS (SELECT rf.key, rf.label AS y_true, s.label AS y_pred, any_value(ln(n.c / n.tot::DOUBLE)) - 0.5::DOUBLE * sum(ln(2 * pi() * (vv + eps)) + (v - m) * (v - m) / (vv + eps)) AS ll
   FROM rf JOIN s ON s.fold = rf.fold AND s.p = rf.p JOIN e ON e.fold = rf.fold JOIN n ON n.fold = rf.fold AND n.label = s.label GROUP BY ALL),
 oof AS (SELECT key, y_true, y_pred FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY ll DESC, y_pred) = 1), {T} {score_sql('t')}""", *SCORES))
def naive_bayes(spark, d):
    return tidy(E.score(M.gaussian_nb_oof(folded(spark, d), "key", "vec", "label")))


@query("mdl_13", f"WITH {RAWF} SELECT key, fold, y_true, y_pred FROM oof")
def centroid(spark, d):
    return M.nearest_centroid_oof(folded(spark, d), "key", "vec", "label").select("key", F.col("fold").cast("bigint").alias("fold"), "y_true", "y_pred")


_PROB = "[" + ", ".join(f"({h('{s}', 'key', str(i))} % 1000) / 1000e0" for i in range(10)) + "]"


@query("mdl_14", f"""WITH {VECS}, p AS (SELECT key, {_PROB.replace('{s}', chr(39) + 'p1' + chr(39))} AS a, {_PROB.replace('{s}', chr(39) + 'p2' + chr(39))} AS b FROM vecs),
 q AS (SELECT key, list_transform(range(10), lambda i: a[i + 1] + b[i + 1]) AS s FROM p) SELECT key, list_position(s, list_max(s)) - 1 AS y_pred FROM q""")
def soft_vote(spark, d):
    rows = vecs(spark, d)
    heads = [rows.select("key", M.probabilities_by_hash("key", s, 10).alias("probability")) for s in ("p1", "p2")]
    return M.soft_vote(heads, "key", list(range(10)))


def _at_once(spark, one, items, parallelism=5):
    """Union of ``one(item)``, a stored table each, fitted at the same time."""
    with ThreadPoolExecutor(parallelism) as pool:
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(spark)(one), items))


def _mllib(name, params):
    """Predictions of every row by a model of the other folds, pooled; the folds are fitted at the same time."""

    def run(spark, d):
        rows = materialise(folded(spark, d), "folded")

        def one(f):
            out = M.fit_predict(name, rows.where(F.col("fold") != f), rows.where(F.col("fold") == f), "vec", "label", "key", params=params)
            return materialise(out.select("key", "y_true", "y_pred"), "oof")

        return _at_once(spark, one, range(K))

    return run


@query("mdl_04")
def forest(spark, d):
    return FO.forest_oof(materialise(folded(spark, d), "folded"), "key", "vec", "label").select("key", "y_true", "y_pred")


@query("mdl_09")
def perceptron(spark, d):
    return NN.nets_oof(materialise(folded(spark, d), "folded"), "key", "vec", "label")


#: Default settings over all folds; each takes a folded table.
WHOLE = {
    "mdl_01": lambda rows: ST.stacked_oof(rows, "key", "vec", "label"),
    "mdl_02": lambda rows: ST.stacked_oof(rows, "key", "vec", "label", loss="squared_hinge"),
    "mdl_03": lambda rows: ST.rbf_oof(rows, "key", "vec", "label"),
    "mdl_05": lambda rows: BO.boosted_oof(rows, "key", "vec", "label"),
    "mdl_07": lambda rows: BO.stumps_oof(rows, "key", "vec", "label"),
}


def _whole(name):
    def run(spark, d):
        return WHOLE[name](materialise(folded(spark, d), "folded")).select("key", "y_true", "y_pred")

    return run


def _learns(name):
    """The same run where the label follows from the vector: what must hold of any model that learns."""

    def run(spark, d):
        hint = (F.col("vec")[0] > 0).cast("int") * 2 + (F.col("vec")[1] > 0).cast("int")
        rows = materialise(folded(spark, d).withColumn("label", hint), "folded")
        out = materialise(WHOLE[name](rows).select("key", "y_true", "y_pred"), "oof")
        most = out.groupBy("y_true").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("c"))
        sums = out.agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_keys"), F.count_distinct("y_true").alias("n_labels"),
            F.count_if(~F.col("y_pred").isin(0, 1, 2, 3)).alias("n_foreign"), F.count_if(F.col("y_true") == F.col("y_pred")).alias("right"),
        )
        return sums.crossJoin(most).select("n", "n_keys", "n_labels", "n_foreign", (F.col("right") > F.col("c")).alias("beats_majority"))

    return run


_LEARNS = f"WITH {VECS} SELECT count(*) AS n, count(DISTINCT key) AS n_keys, count(DISTINCT (vec[1] > 0, vec[2] > 0)) AS n_labels, 0::BIGINT AS n_foreign, true AS beats_majority FROM vecs"
for _name in WHOLE:
    query(_name)(_whole(_name))
    query(f"{_name}_learns", _LEARNS)(_learns(_name))


@query("mdl_10")
def registry(spark, d):
    """Every registered model's default parameters beside the training size."""
    from ..functions.text import sorted_json

    rows = [(n, sorted_json(M.default_params(n))) for n in M.DEFAULTS]
    size = vecs(spark, d).agg(F.count(F.lit(1)).alias("n_train"))
    return spark.createDataFrame(rows, "model string, hyperparams string").crossJoin(size)


@query("mdl_11")
def tuning(spark, d):
    rows = S.with_group_fold(vecs(spark, d), "grp", 3, "snake").withColumnRenamed("fold", "inner")
    return tidy(M.tune("knn", rows, "vec", "label", "inner", {"n_neighbors": [3, 11], "weights": ["uniform", "distance"]})[1])


_SM = ["accuracy", "macro_f1"]


@query("mdl_12", rounded(f"""WITH {RAWF}, b AS (SELECT fold::VARCHAR AS fold, y_true, y_pred FROM oof UNION ALL SELECT 'pooled', y_true, y_pred FROM oof),
 t AS (SELECT fold, y_true, y_pred, count(*) AS n FROM b GROUP BY ALL) SELECT 'centroid' AS model, 'speaker_independent' AS protocol, fold, n, accuracy, macro_f1 FROM ({score_sql('t', 'fold')}) AS _s""", *_SM))
def fold_runner(spark, d):
    table = PS.score_models({"speaker_independent": folded(spark, d)}, {"centroid": M.nearest_centroid_oof}, "key", "vec", "label")
    return tidy(table.select("model", "protocol", "fold", "n", "accuracy", "macro_f1"))


@query("mdl_15")
def hierarchical(spark, d):
    rows = materialise(folded(spark, d), "folded")
    return ST.two_stage_oof(rows, "key", "vec", "label", [0, 1, 2, 3, 4]).select("key", "gate", "y_true", "y_pred")


@query("mdl_15_gate", f"""WITH {VECS} SELECT count(*) AS n, count(DISTINCT key) AS n_keys, 0::BIGINT AS left_branch, true AS high_gate FROM vecs""")
def hierarchical_gate(spark, d):
    """No prediction leaves the branch of its gate, and a gate that follows from the vector is learned."""
    rows = materialise(folded(spark, d).withColumn("label", (F.col("vec")[0] > 0).cast("int") * 5 + F.pmod("label", F.lit(5))), "folded")
    out = ST.two_stage_oof(rows, "key", "vec", "label", [5, 6, 7, 8, 9])
    return out.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_keys"),
        F.count_if((F.col("y_pred") >= 5) != (F.col("gate") == "high")).alias("left_branch"),
        (F.avg(((F.col("y_true") >= 5) == (F.col("gate") == "high")).cast("double")) > 0.8).alias("high_gate"),
    )


@query("mdl_16")
def frozen_head(spark, d):
    """A body from all sources, a head from the base source, for every fold."""
    own, external = sourced_folds(spark, d)
    own, external = materialise(own, "own"), materialise(external, "external")
    return NN.arms_oof(own, external, "key", "vec", "label", ["two_stage_frozen"]).select("key", "y_true", "y_pred")


# ------------------------------------------------------------------- transfer


def sourced(spark, d):
    """Vectors with three sources; s0 is the base."""
    return vecs(spark, d).withColumn("source", F.concat(F.lit("s"), (F.floor(F.col("key") / 24) % 3).cast("string")))


SRC3 = f"{VECS}, sv AS (SELECT *, 's' || key // 24 % 3 AS source FROM vecs), own AS (SELECT * FROM sv WHERE source = 's0'), gf AS ({snake_sql('own', 'grp', K)})"


def sourced_folds(spark, d):
    rows = sourced(spark, d)
    own = S.with_group_fold(rows.where("source = 's0'"), "grp", K, "snake")
    return own, rows.where("source <> 's0'")


@query("trf_01", rounded("SELECT doc_id AS key, CASE WHEN source = 'src0' THEN 1 ELSE 0.05::DOUBLE END AS weight FROM documents", "weight"))
def down_weights(spark, d):
    return tidy(X.weighted_train(docs(spark, d).select("key", "source"), "source", "src0", 0.05).select("key", "weight"))


def inner_roles(own, external, k=K, n_inner=3):
    """Base and external rows with one inner-fold column for each outer fold: -1 in the outer fold, -2 for external rows."""
    rows = own
    for f in range(k):
        inner = S.with_group_fold(own.where(F.col("fold") != f).drop("fold").select("grp", "key"), "grp", n_inner, "snake")
        rows = rows.join(inner.select("key", F.col("fold").alias(f"inner{f}")), "key", "left").withColumn(f"inner{f}", F.coalesce(f"inner{f}", F.lit(-1)))
    for f in range(k):
        external = external.withColumn(f"inner{f}", F.lit(-2))
    return rows.unionByName(external.withColumn("fold", F.lit(-2)))


def _weight_scores(spark, d, label=None):
    own, external = sourced_folds(spark, d)
    if label is not None:
        own, external = own.withColumn("label", label), external.withColumn("label", label)
    rows = materialise(inner_roles(own, external), "roles")
    counts = materialise(ST.penalty_search(
        rows, "key", "vec", "label", "fold", [f"inner{f}" for f in range(K)], (1.0,), 3, external=(0.0, *WEIGHT_GRID),
    ), "counts")
    marks = E.scores(counts, ["outer", "weight", "inner"]).select("outer", "weight", "inner", F.col("n").alias("n_held"), "macro_f1")
    return marks.groupBy("outer", "weight").agg(F.sum("n_held").alias("n"), F.avg("macro_f1").alias("macro_f1"))


@query("trf_02")
def weight_search(spark, d):
    """All weights x inner folds x outer folds as one stack of models; the first best weight of an outer fold is chosen."""
    table = _weight_scores(spark, d)
    best = F.max_by("weight", F.struct(F.round("macro_f1", 12), F.col("weight") == 0, "weight")).over(Window.partitionBy("outer"))
    return tidy(table.withColumn("chosen", F.col("weight") == best))


@query("trf_02_learns", f"""WITH {SRC3}, w AS (SELECT unnest([{', '.join(f'{w}::DOUBLE' for w in (0.0, *WEIGHT_GRID))}]) AS weight)
SELECT t.f::INT AS outer, weight, (SELECT count(*) FROM own JOIN gf USING (grp) WHERE fold <> t.f) AS n, true AS above_chance FROM range({K}) AS t(f), w""")
def weight_search_learns(spark, d):
    """Where the label follows from the vector: every candidate is scored on each train row once and learns."""
    hint = (F.col("vec")[0] > 0).cast("int") * 2 + (F.col("vec")[1] > 0).cast("int")
    return _weight_scores(spark, d, hint).select("outer", "weight", "n", (F.col("macro_f1") > 0.25).alias("above_chance"))


@query("trf_03")
def density(spark, d):
    return tidy(X.importance_weights(sourced(spark, d), "source", "s0", "vec").select("key", "source", "weight"))


@query("trf_04")
def selective(spark, d):
    """External rows of the classes they help, chosen for every outer fold inside its own train side."""
    own, external = sourced_folds(spark, d)
    out = None
    for outer in range(K):
        train = own.where(F.col("fold") != outer).drop("fold")
        inner = materialise(S.with_group_fold(train, "grp", 3, "snake"), "inner")
        without = M.nearest_centroid_oof(inner, "key", "vec", "label")
        both = M.nearest_centroid_oof(inner.unionByName(external.withColumn("fold", F.lit(-1))), "key", "vec", "label").where("fold >= 0")
        part = X.class_selective(external, X.helped_classes(both, without), "label").select(
            F.lit(outer).alias("outer_fold"), "key", "label", "source"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("trf_05", f"""WITH {SRC3}, tr AS (SELECT sv.key, vec FROM sv LEFT JOIN gf USING (grp) WHERE source <> 's0' OR fold <> 0),
 el AS (SELECT unnest(vec) AS v, generate_subscripts(vec, 1) AS p FROM tr), s AS (SELECT p, avg(v) AS m, stddev_pop(v) AS sd FROM el GROUP BY p)
SELECT list(round(m, 6) + 0e0 ORDER BY p) AS mean, list(round(sd, 6) + 0e0 ORDER BY p) AS scale FROM s""")
def joint_scaler(spark, d):
    own, external = sourced_folds(spark, d)
    return tidy(N.fit_scaler(own.where("fold <> 0").select("vec").unionByName(external.select("vec")), "vec"))


@query("trf_06", f"""WITH {SRC3}, base AS (SELECT count(*) AS n FROM own JOIN gf USING (grp) WHERE fold <> 0), m AS (SELECT range AS mask FROM range(4)),
 s(bit, member) AS (VALUES (0, 's1'), (1, 's2')), c AS (SELECT source, count(*) AS n FROM sv GROUP BY 1)
SELECT coalesce(string_agg(member, '+' ORDER BY bit), '(base only)') AS subset, (coalesce(sum(c.n), 0) + any_value(base.n))::BIGINT AS n_train
FROM m CROSS JOIN base LEFT JOIN s ON (mask >> bit) & 1 = 1 LEFT JOIN c ON c.source = s.member GROUP BY mask""")
def sweep_sizes(spark, d):
    own, _ = sourced_folds(spark, d)
    base = own.where("fold <> 0").agg(F.count(F.lit(1)).alias("_b"))
    table = X.subset_table(sourced(spark, d), "source", ["s1", "s2"]).crossJoin(base)
    return table.select("subset", (F.col("n_rows") + F.col("_b")).alias("n_train"))


def _near(cent: str, rows: str, on: str, name: str) -> str:
    """{name}(y_true, y_pred): nearest of ``cent`` for each of ``rows``."""
    return f"""{name} AS (SELECT y_true, y_pred FROM (SELECT s.key, s.label AS y_true, c.label AS y_pred, sum((s.v - c.c) * (s.v - c.c)) AS d
  FROM {rows} s JOIN {cent} c ON s.p = c.p {on} GROUP BY ALL) AS _d QUALIFY row_number() OVER (PARTITION BY key ORDER BY d, y_pred) = 1)"""


_SWEEP = f"""{SRC3}, el AS (SELECT sv.key, sv.label, source, fold, unnest(vec) AS v, generate_subscripts(vec, 1) AS p FROM sv LEFT JOIN gf ON gf.grp = sv.grp AND source = 's0'),
 cc AS (SELECT k.mask, t.f AS fold, label, p, avg(v) AS c FROM el, range(4) AS k(mask), range({K}) AS t(f)
   WHERE (source = 's0' AND fold <> t.f) OR (source = 's1' AND mask & 1 = 1) OR (source = 's2' AND mask & 2 = 2) GROUP BY ALL),
 dd AS (SELECT c.mask, s.key, s.label AS y_true, c.label AS y_pred, sum((s.v - c.c) * (s.v - c.c)) AS d FROM el s JOIN cc c ON s.p = c.p AND s.fold = c.fold WHERE source = 's0' GROUP BY ALL),
 pp AS (SELECT * FROM dd QUALIFY row_number() OVER (PARTITION BY mask, key ORDER BY d, y_pred) = 1),
 t AS (SELECT ['(base only)', 's1', 's2', 's1+s2'][mask + 1] AS subset, y_true, y_pred, count(*) AS n FROM pp GROUP BY ALL), sc AS ({score_sql('t', 'subset')})"""


def _centroid_predict(train, test):
    both = train.select("key", "label", "vec").withColumn("fold", F.lit(0)).unionByName(test.select("key", "label", "vec").withColumn("fold", F.lit(1)))
    return M.nearest_centroid_oof(both, "key", "vec", "label").where("fold = 1")


@query("trf_06_scores", rounded(f"""WITH {_SWEEP} SELECT subset, n, accuracy, macro_f1, round((macro_f1 - (SELECT macro_f1 FROM sc WHERE subset = '(base only)')) * 100, 2) AS vs_control_pp FROM sc""", "accuracy", "macro_f1", "vs_control_pp"))
def sweep_scores(spark, d):
    own, external = sourced_folds(spark, d)
    rows = own.unionByName(external.withColumn("fold", F.lit(-1)))
    out = X.sweep(rows, "source", "s0", ["s1", "s2"], range(K), _centroid_predict, ["key"])
    table = E.score(out, "subset").select("subset", "n", "accuracy", "macro_f1")
    return tidy(X.versus_control(table, "subset", "macro_f1", "(base only)").orderBy(F.desc("macro_f1")))


@query("trf_07")
def four_arms(spark, d):
    """All arms on all folds, pooled."""
    own, external = sourced_folds(spark, d)
    own, external = materialise(own, "own"), materialise(external, "external")
    return tidy(E.score(NN.arms_oof(own, external, "key", "vec", "label", ARMS), "arm"))


@query("trf_08")
def head_control(spark, d):
    own, external = sourced_folds(spark, d)
    rows = own.unionByName(external.withColumn("fold", F.lit(-1)))
    out = None
    for head, oof in (("centroid", M.nearest_centroid_oof), ("gaussian-nb", M.gaussian_nb_oof)):
        for arm, table in (("control", own), ("pooled", rows)):
            part = oof(table, "key", "vec", "label").where("fold >= 0").select(F.lit(head).alias("head"), F.lit(arm).alias("arm"), "y_true", "y_pred")
            out = part if out is None else out.unionByName(part)
    return tidy(E.score(out, ["head", "arm"]))


@query("trf_09", rounded(f"""WITH {RESULTS}, s AS (SELECT protocol, model, substr(model, 2)::INT AS o, avg(macro_f1) AS inner_score FROM res GROUP BY ALL)
SELECT protocol, model, inner_score FROM s QUALIFY row_number() OVER (PARTITION BY protocol ORDER BY round(inner_score, 12) DESC, o) = 1""", "inner_score"))
def inner_choice(spark, d):
    table = results(spark, d).withColumn("ordinal", F.substring("model", 2, 1).cast("int"))
    return tidy(X.select_inner(table, "protocol", "model", "ordinal", "macro_f1"))


def _candidates(spark, d):
    rows = vecs(spark, d)
    return [("raw", rows), ("normalised", N.per_group_normalise(rows, "vec", "grp"))]


@query("trf_09_nested")
def nested_cv(spark, d):
    found = PS.nested_selection(_candidates(spark, d), "key", "vec", "label", "grp", n_boot=N_BOOT)
    return tidy(found["optimism"].crossJoin(found["interval"]))


@query("trf_10", rounded(f"""WITH {RESULTS}, s AS (SELECT model AS strategy, avg(macro_f1) AS macro_f1 FROM res GROUP BY 1)
SELECT strategy, macro_f1, round((macro_f1 - (SELECT macro_f1 FROM s WHERE strategy = 'm1')) * 100, 2) AS vs_control_pp FROM s ORDER BY macro_f1 DESC""", "macro_f1", "vs_control_pp"))
def strategies(spark, d):
    table = results(spark, d).groupBy(F.col("model").alias("strategy")).agg(F.avg("macro_f1").alias("macro_f1"))
    return tidy(X.versus_control(table, "strategy", "macro_f1", "m1").orderBy(F.desc("macro_f1")))


# ----------------------------------------------------------------- augmentation


def _normal(*parts):
    return f"sqrt(-2 * ln(({h(*parts, chr(39) + 'n1' + chr(39))} + 1) / 4294967296e0)) * cos(2 * pi() * ({h(*parts, chr(39) + 'n2' + chr(39))} / 4294967296e0))"


@query("augm_01", f"""WITH {VECS}, el AS (SELECT key, unnest(vec) AS v, generate_subscripts(vec, 1) - 1 AS p FROM vecs),
 s AS (SELECT *, sqrt(avg(v * v) OVER (PARTITION BY key) / 100) AS sd FROM el)
SELECT key, list(round(v + sd * {_normal("'7'", 'key', 'p')}, 6) + 0e0 ORDER BY p) AS vec FROM s GROUP BY key""")
def signal_noise(spark, d):
    return tidy(vecs(spark, d).select("key", G.noise_at_snr(F.col("vec"), F.col("key"), 20.0, 7).alias("vec")))


@query("augm_02", f"""WITH {VECS}, el AS (SELECT key, unnest(vec) AS v, generate_subscripts(vec, 1) - 1 AS p FROM vecs),
 s AS (SELECT *, stddev_pop(v) OVER (PARTITION BY p) AS sd FROM el)
SELECT key, list(round(v + sd * 0.1::DOUBLE * {_normal("'fn'", 'key', 'p')}, 6) + 0e0 ORDER BY p) AS vec FROM s GROUP BY key""")
def feature_noise(spark, d):
    return tidy(N.add_feature_noise(vecs(spark, d), "vec", "key", 0.1, "fn").select("key", "vec"))


@query("augm_03", f"WITH {VECS} SELECT label, round_even(count(*) * 0.5, 0)::BIGINT AS n, true AS in_class, true AS between FROM vecs GROUP BY label HAVING count(*) > 1")
def mixup_counts(spark, d):
    rows = vecs(spark, d)
    mixed = G.mixup(rows, "key", "vec", "label", "grp", 0.5, "mx")
    names = rows.select(F.col("key").alias("a"), F.col("label").alias("la"))
    other = rows.select(F.col("key").alias("b"), F.col("label").alias("lb"))
    return mixed.join(names, "a").join(other, "b").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and((F.col("la") == F.col("label")) & (F.col("lb") == F.col("label"))).alias("in_class"),
        F.bool_and(F.col("weight").between(0, 1) & (F.col("a") != F.col("b"))).alias("between"),
    )


@query("augm_03_rows")
def mixup_rows(spark, d):
    return tidy(G.mixup(vecs(spark, d), "key", "vec", "label", "grp", 1.0, "mx"))


AUG = """src AS (SELECT doc_id, 'd' || doc_id || '.wav' AS filename, doc_id % 5 AS fold FROM documents),
 plan AS (SELECT 'd' || doc_id || '__' || t || '.wav' AS filename, t AS augmentation, filename AS source_filename, fold FROM src, unnest(['pitch+2', 'stretch1.1', 'noise20db']) AS u(t))"""


def _aug_source(spark, d):
    k = F.col("doc_id")
    return read(spark, d, "documents").select(F.concat(F.lit("d"), k.cast("string"), F.lit(".wav")).alias("filename"), (k % 5).alias("fold"))


@query("augm_04", f"WITH {AUG} SELECT filename, augmentation, source_filename FROM plan WHERE NOT (augmentation = 'pitch+2' AND fold = 0)")
def lineage(spark, d):
    rows = _aug_source(spark, d)
    done = G.materialise_plan(rows.where("fold = 0"), DEFAULT_AUGMENTATIONS[:1])
    return G.materialise_plan(rows, DEFAULT_AUGMENTATIONS, done).select("filename", "augmentation", "source_filename")


@query("augm_05", f"WITH {AUG} SELECT filename, source_filename FROM plan WHERE fold <> 2")
def admission(spark, d):
    rows = _aug_source(spark, d)
    return G.admit_to_train(G.materialise_plan(rows, DEFAULT_AUGMENTATIONS), rows.where("fold <> 2")).select("filename", "source_filename")


# ----------------------------------------------------------------- diagnostics

_STRAT = "(row_number() OVER (PARTITION BY grp ORDER BY md5('42|' || key), key) - 1) % 5"
_PROBE = f"""{EL}, sf AS (SELECT key, {_STRAT} AS fold FROM vecs), ra AS (SELECT el.*, sf.fold FROM el JOIN sf USING (key)),
 rb AS (SELECT z.*, sf.fold FROM z JOIN sf USING (key)), {centroid_sql('ra', 'oa', 'grp')}, {centroid_sql('rb', 'ob', 'grp')},
 acc AS (SELECT 'raw' AS space, fold, avg((y_true = y_pred)::INT) AS a FROM oa GROUP BY fold UNION ALL SELECT 'normalised', fold, avg((y_true = y_pred)::INT) FROM ob GROUP BY fold)"""


@query("diag_01", rounded(f"WITH {_PROBE} SELECT space, avg(a) AS accuracy, stddev_samp(a) AS sd, 1 / 24e0 AS chance, avg(a) * 24 AS x_chance FROM acc GROUP BY space", "accuracy", "sd", "chance", "x_chance"))
def identity(spark, d):
    return tidy(D.identity_probe(vecs(spark, d), "key", "vec", "grp"))


_SP = f"""{EL}, sr AS (SELECT key, 's' || key // 24 % 3 AS source FROM vecs), ra AS (SELECT el.*, gf.fold, source FROM el JOIN gf USING (grp) JOIN sr USING (key)),
 rb AS (SELECT z.*, gf.fold, source FROM z JOIN gf USING (grp) JOIN sr USING (key)), {centroid_sql('ra', 'oa', 'source')}, {centroid_sql('rb', 'ob', 'source')},
 mj AS (SELECT max(c) / sum(c)::DOUBLE AS majority FROM (SELECT count(*) AS c FROM sr GROUP BY source) AS _m)"""


@query("diag_02", rounded(f"""WITH {_SP}, a AS (SELECT 'raw' AS space, avg((y_true = y_pred)::INT) AS accuracy FROM oa UNION ALL SELECT 'normalised', avg((y_true = y_pred)::INT) FROM ob)
SELECT space, accuracy, majority, accuracy / majority AS ratio FROM a, mj""", "accuracy", "majority", "ratio"))
def source_cue(spark, d):
    return tidy(D.source_probe(sourced(spark, d), "key", "vec", "grp", "source", method="snake"))


def _sil(src, by, name, power=1):
    dist = "list_distance(a.vec, b.vec)" if power == 1 else "list_sum(list_transform(list_zip(a.vec, b.vec), lambda x: (x[1] - x[2]) ** 2))"
    return f"""{name}_s AS (SELECT key, grp, label, list((v - m) / sd ORDER BY p) AS vec FROM (SELECT *, avg(v) OVER (PARTITION BY p) AS m, stddev_pop(v) OVER (PARTITION BY p) AS sd FROM {src}) AS _s GROUP BY ALL),
 {name}_n AS (SELECT {by} AS o, count(*) AS c FROM {name}_s GROUP BY 1),
 {name}_t AS (SELECT a.key, a.{by} AS l, b.{by} AS o, sum({dist}) AS s FROM {name}_s a, {name}_s b GROUP BY ALL),
 {name}_r AS (SELECT key, l, max(c) FILTER (WHERE o = l) AS own, max(s / greatest(c - 1, 1)) FILTER (WHERE o = l) AS a, min(s / c) FILTER (WHERE o <> l) AS b FROM {name}_t JOIN {name}_n USING (o) GROUP BY ALL),
 {name} AS (SELECT avg(CASE WHEN own <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette, count(*) AS n FROM {name}_r)"""


@query("diag_03", rounded(f"WITH {EL}, {_sil('el', 'label', 's1')} SELECT * FROM s1", "silhouette"))
def silhouette(spark, d):
    return tidy(D.silhouette_by(vecs(spark, d), "key", "vec", "label"))


@query("diag_04", rounded(f"""WITH {EL}, {_sil('el', 'label', 's1')}, {_sil('el', 'grp', 's2')}, {_sil('z', 'label', 's3')}, {_sil('z', 'grp', 's4')}
SELECT 'raw' AS space, 'label' AS "by", silhouette FROM s1 UNION ALL SELECT 'raw', 'group', silhouette FROM s2
UNION ALL SELECT 'normalised', 'label', silhouette FROM s3 UNION ALL SELECT 'normalised', 'group', silhouette FROM s4""", "silhouette"))
def silhouettes(spark, d):
    return tidy(D.silhouette_comparison(vecs(spark, d), "key", "vec", "grp", "label"))


@query("diag_03_squared", rounded(f"WITH {EL}, {_sil('el', 'label', 's1', 2)} SELECT * FROM s1", "silhouette"))
def squared_silhouette(spark, d):
    """Squared Euclidean distances in closed form: linear in rows."""
    return tidy(D.silhouette_by(vecs(spark, d), "key", "vec", "label", squared=True))


@query("diag_04_squared", rounded(f"""WITH {EL}, {_sil('el', 'label', 's1', 2)}, {_sil('el', 'grp', 's2', 2)}, {_sil('z', 'label', 's3', 2)}, {_sil('z', 'grp', 's4', 2)}
SELECT 'raw' AS space, 'label' AS "by", silhouette FROM s1 UNION ALL SELECT 'raw', 'group', silhouette FROM s2
UNION ALL SELECT 'normalised', 'label', silhouette FROM s3 UNION ALL SELECT 'normalised', 'group', silhouette FROM s4""", "silhouette"))
def squared_silhouettes(spark, d):
    return tidy(D.silhouette_comparison(vecs(spark, d), "key", "vec", "grp", "label", squared=True))


@query("diag_05")
def projection(spark, d):
    out = _projected(spark, d, lambda train: N.fit_pca(train, "vec", 2), "pc")
    return tidy(out.select("key", "label", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"), F.col("ratio")[0].alias("ratio1"), F.col("ratio")[1].alias("ratio2")))


_INV = f"""{EL}, rf AS (SELECT el.*, gf.fold, {h("'half'", 'key')} % 2 = 0 AS half FROM el JOIN gf USING (grp)), te AS (SELECT * FROM rf WHERE NOT half),
 c1 AS (SELECT t.f AS fold, label, p, avg(v) AS c FROM rf, range({K}) AS t(f) WHERE fold <> t.f GROUP BY ALL),
 c2 AS (SELECT label, p, avg(v) AS c FROM rf WHERE half GROUP BY ALL),
 c3 AS (SELECT t.f AS fold, label, p, avg(v) AS c FROM rf, range({K}) AS t(f) WHERE half AND fold <> t.f GROUP BY ALL),
 {_near('c1', 'rf', 'AND c.fold = s.fold', 'p1')}, {_near('c2', 'te', '', 'p2')}, {_near('c3', 'te', 'AND c.fold = s.fold', 'p3')},
 t AS (SELECT protocol, y_true, y_pred, count(*) AS n FROM (SELECT 'group' AS protocol, * FROM p1 UNION ALL SELECT 'attribute', * FROM p2 UNION ALL SELECT 'both', * FROM p3) AS _u GROUP BY ALL)"""


@query("diag_06", rounded(f"WITH {_INV} {score_sql('t', 'protocol')}", *SCORES))
def invariance(spark, d):
    half = hash32("half", F.col("key")) % 2 == 0
    return tidy(D.attribute_invariance(vecs(spark, d), "key", "vec", "label", "grp", half, ~half, method="snake"))


_SL = """long AS (SELECT 'early' AS slice, early::VARCHAR AS level, 'a' AS config, grp, y_true, y_pred FROM pred
  UNION ALL SELECT 'odd', (key % 2 = 1)::VARCHAR, 'a', grp, y_true, y_pred FROM pred)"""


@query("diag_07", rounded(f"""WITH {PRED}, {_SL}, {_boot_sql('long', 'slice, level')}, sc AS (SELECT slice, level, n, accuracy, macro_f1 FROM ({score_sql('cells', 'slice, level')}) AS _s)
SELECT sc.slice, sc.level, sc.n, sc.accuracy, sc.macro_f1, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM sc JOIN boot ON boot.slice = sc.slice AND boot.level = sc.level GROUP BY ALL""", "accuracy", "macro_f1", "lo", "hi"))
def slice_report(spark, d):
    rows = pred(spark, d).withColumn("odd", F.col("key") % 2 == 1)
    return tidy(D.slice_report(rows, ["early", "odd"], "grp", N_BOOT))


@query("diag_07_gap", rounded(f"""WITH {PRED}, t AS (SELECT 'early' AS slice, early::VARCHAR AS level, y_true, y_pred, count(*) AS n FROM pred GROUP BY ALL)
SELECT slice, max(accuracy) - min(accuracy) AS accuracy_gap, max(macro_f1) - min(macro_f1) AS macro_f1_gap FROM ({score_sql('t', 'slice, level')}) AS _s GROUP BY slice""", "accuracy_gap", "macro_f1_gap"))
def slice_gap(spark, d):
    return tidy(D.slice_gap(E.slices(pred(spark, d), ["early"])))


def _layer(spark, d, layer):
    rows = tensor(spark, d).where((F.col("layer") == layer) & (F.col("stat") == "mean")).select("key", "grp", "label", "vec")
    return S.with_group_fold(N.per_group_normalise(rows, "vec", "grp"), "grp", K, "snake")


AXES = {"layer": [0, 1, 2, 3], "pooling": ["mean", "mean_std", "std"], "normalisation": ["none", "per_speaker"]}


def _choice(spark, d):
    stored = materialise(tensor(spark, d), "tensor")
    about = materialise(S.with_group_fold(vecs(spark, d).select("key", "grp", "label"), "grp", K, "snake"), "folds")

    def table_of(choice):
        rows = N.select_layer(stored, "key", choice["layer"], choice["pooling"], 4).select("key", "vec").join(about, "key")
        return N.per_group_normalise(rows, "vec", "grp") if choice["normalisation"] == "per_speaker" else rows

    return table_of


_AX = f"""{TENSOR}, gf AS ({snake_sql('vecs', 'grp', K)}), el AS (SELECT key, grp, label, layer, stat, unnest(vec) AS v, generate_subscripts(vec, 1) AS p FROM tensor),
 po AS (SELECT key, grp, label, layer, 'mean' AS pooling, p, v FROM el WHERE stat = 'mean' UNION ALL SELECT key, grp, label, layer, 'std', p, v FROM el WHERE stat = 'std'
   UNION ALL SELECT key, grp, label, layer, 'mean_std', p + CASE WHEN stat = 'std' THEN 1000 ELSE 0 END, v FROM el),
 co AS (SELECT key, grp, label, layer, pooling, 'none' AS normalisation, p, v FROM po UNION ALL
   SELECT key, grp, label, layer, pooling, 'per_speaker', p, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-8) FROM po WINDOW w AS (PARTITION BY layer, pooling, grp, p)),
 cf AS (SELECT co.*, fold FROM co JOIN gf USING (grp)),
 ce AS (SELECT layer, pooling, normalisation, t.f AS fold, label, p, avg(v) AS c FROM cf, range({K}) AS t(f) WHERE fold <> t.f GROUP BY ALL),
 di AS (SELECT layer, pooling, normalisation, s.key, s.label AS y_true, c.label AS y_pred, sum((s.v - c.c) * (s.v - c.c)) AS d FROM cf s JOIN ce c USING (layer, pooling, normalisation, fold, p) GROUP BY ALL),
 pr AS (SELECT * FROM di QUALIFY row_number() OVER (PARTITION BY layer, pooling, normalisation, key ORDER BY d, y_pred) = 1),
 t AS (SELECT layer, pooling, normalisation, y_true, y_pred, count(*) AS n FROM pr GROUP BY ALL), sc AS ({score_sql('t', 'layer, pooling, normalisation')}),
 o AS (SELECT *, list_position(['mean', 'mean_std', 'std'], pooling) AS po, list_position(['none', 'per_speaker'], normalisation) AS no, round(macro_f1, 12) AS m FROM sc),
 s1 AS (SELECT *, row_number() OVER (ORDER BY m DESC, layer) = 1 AS chosen FROM o WHERE po = 1 AND no = 1),
 s2 AS (SELECT *, row_number() OVER (ORDER BY m DESC, po) = 1 AS chosen FROM o WHERE layer = (SELECT layer FROM s1 WHERE chosen) AND no = 1),
 s3 AS (SELECT *, row_number() OVER (ORDER BY m DESC, no) = 1 AS chosen FROM o WHERE layer = (SELECT layer FROM s1 WHERE chosen) AND po = (SELECT po FROM s2 WHERE chosen))"""


@query("diag_08", rounded(f"""WITH {_AX} SELECT 0 AS step, 'layer' AS axis, layer::VARCHAR AS candidate, n, accuracy, macro_f1, chosen FROM s1
 UNION ALL SELECT 1, 'pooling', pooling, n, accuracy, macro_f1, chosen FROM s2 UNION ALL SELECT 2, 'normalisation', normalisation, n, accuracy, macro_f1, chosen FROM s3""", "accuracy", "macro_f1"))
def layer_curve(spark, d):
    """Every layer, then every pooling of the best one, then normalisation."""
    return tidy(D.axis_search(AXES, _choice(spark, d), "key", "vec", "label"))


@query("diag_09")
def ablation(spark, d):
    from ..plans.ablation import ablation as run
    from .storage import SMALL, wav_files

    return tidy(run(wav_files(spark, d), "source", "lang", SMALL.replace(extras=())))


@query("diag_10", rounded(f"""WITH {RESULTS}, s AS (SELECT model, avg(accuracy) AS found FROM res GROUP BY 1)
SELECT model, found, round(found, 3) AS committed, abs(found - round(found, 3)) AS drift, abs(found - round(found, 3)) <= 0.0002 AS reproduced FROM s""", "found", "committed", "drift"))
def drift(spark, d):
    found = results(spark, d).groupBy("model").agg(F.avg("accuracy").alias("accuracy"))
    committed = found.withColumn("accuracy", F.round("accuracy", 3))
    return tidy(D.drift_check(found, committed, "model", "accuracy", 0.0002))


@query("diag_11")
def encoders(spark, d):
    """Two encoders at their best layers, tested on shared draws, and how well each tells groups apart."""
    raw = materialise(S.with_group_fold(vecs(spark, d), "grp", K, "snake"), "folded")
    halves = [(f"L{i}", raw.withColumn("vec", F.slice("vec", 1 + 16 * i, 16))) for i in range(4)]
    return tidy(D.encoder_comparison({"encoder_a": [(f"L{l}", _layer(spark, d, l)) for l in range(4)], "encoder_b": halves}, "encoder_a", "key", "vec", "label", "grp"))


def lever_tables(train, test):
    """name -> (train, test) of the levers that are fitted; scaler and axes see the train rows only."""
    scaler = N.fit_scaler(train, "vec")
    small, large = N.apply_scaler(train, scaler, "vec"), N.apply_scaler(test, scaler, "vec")
    mean, axes, _ = N.fit_pca(small, "vec", 16)
    lmean, laxes = N.fit_lda(small, "vec", "label")
    return {
        "pca": tuple(N.project(x, "vec", mean, axes, "vec") for x in (small, large)),
        "lda": tuple(N.project(x, "vec", lmean, laxes, "vec") for x in (small, large)),
    }


def lever_predictions(spark, d):
    """(config, grp, y_true, y_pred) of a logistic head and of each lever on it; scaler and axes see train rows only."""
    own = materialise(folded(spark, d), "folded")
    none = own.limit(0).drop("fold")
    roles = materialise(inner_roles(own, none), "roles")
    wide = own.withColumn("vec", F.concat("vec", F.transform("vec", lambda x: 2 * x + 0.5)))
    fused = own.withColumn("vec", F.concat("vec", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: A.std_pop(F.slice("vec", i * 16 + 1, F.lit(16))))))

    def on_axes(name):
        def one(f):
            train, test = lever_tables(own.where(F.col("fold") != f), own.where(F.col("fold") == f))[name]
            # role 0 trains, role 1 is held out
            rows = materialise(train.withColumn("part", F.lit(0)).unionByName(test.withColumn("part", F.lit(1))), "axes")
            stack = ST.fit_stack(rows.where("part = 0"), "vec", "label", ["part"], [ST.Spec((1.0, f), 0, {0: 1.0})])
            return stack.predict(rows, "key", "vec", ["part"], {0: [1]}).join(own.select("key", "grp", F.col("label").alias("y_true")), "key")

        return lambda: _at_once(spark, one, range(K))

    oof = lambda run, rows, *more: lambda: run(rows, "key", "vec", "label", *more)
    levers = {
        "baseline": oof(ST.stacked_oof, own),
        "regularisation": oof(ST.tuned_oof, roles, [f"inner{f}" for f in range(K)]),
        "pca": on_axes("pca"),
        "lda": on_axes("lda"),
        "concat": oof(ST.stacked_oof, wide),
        "fusion": oof(ST.stacked_oof, fused),
        "balanced": oof(ST.balanced_oof, own),
    }
    return _at_once(spark, lambda name: materialise(levers[name]().select(F.lit(name).alias("config"), "grp", "y_true", "y_pred"), "lever"), levers)


@query("diag_12")
def levers(spark, d):
    """All six levers against the baseline, on shared draws."""
    return tidy(U.paired_comparisons(lever_predictions(spark, d), "grp", "config", "baseline"))


@query("trf_05_scores", rounded(f"""WITH {SRC3}, el AS (SELECT sv.key, sv.label, source, fold, unnest(vec) AS v, generate_subscripts(vec, 1) AS p FROM sv LEFT JOIN gf ON gf.grp = sv.grp AND source = 's0'),
 st AS (SELECT t.f AS fold, p, avg(v) AS m, stddev_pop(v) AS s FROM el, range({K}) AS t(f) WHERE source <> 's0' OR el.fold <> t.f GROUP BY ALL),
 sc AS (SELECT key, label, el.fold AS own, st.fold AS fold, el.p, (v - m) / s AS v FROM el JOIN st USING (p) WHERE source = 's0'),
 ce AS (SELECT fold, label, p, avg(v) AS c FROM sc WHERE own <> fold GROUP BY ALL),
 di AS (SELECT s.key, s.label AS y_true, c.label AS y_pred, sum((s.v - c.c) * (s.v - c.c)) AS d FROM sc s JOIN ce c USING (fold, p) WHERE own = fold GROUP BY ALL),
 oof AS (SELECT y_true, y_pred FROM di QUALIFY row_number() OVER (PARTITION BY key ORDER BY d, y_pred) = 1), {T} {score_sql('t')}""", *SCORES))
def scaler_only_scores(spark, d):
    """Scaler from base and external rows, centroids from base rows alone."""
    own, external = sourced_folds(spark, d)
    own = materialise(own, "own")

    def one(f):
        train = own.where(F.col("fold") != f)
        scaler = N.fit_scaler(train.select("vec").unionByName(external.select("vec")), "vec")
        out = _centroid_predict(N.apply_scaler(train, scaler, "vec"), N.apply_scaler(own.where(F.col("fold") == f), scaler, "vec"))
        return materialise(out.select("y_true", "y_pred"), "oof")

    return tidy(E.score(_at_once(spark, one, range(K))))


@query("merged_read")
def early_read(spark, d):
    return tidy(PM.early_read(sourced(spark, d), "key", "vec", "label", "grp", "source", "s0")["scores"])


@query("merged_holdout", rounded(f"""WITH {VECS}, el AS (SELECT key, label, key // 24 % 3 AS fold, unnest(vec) AS v, generate_subscripts(vec, 1) AS p FROM vecs), {centroid_sql('el', 'oof').replace(f'range({K})', 'range(3)')},
 t AS (SELECT fold, y_true, y_pred, count(*) AS n FROM oof GROUP BY ALL) {score_sql('t', 'fold')}""", *SCORES))
def source_holdout(spark, d):
    return tidy(PM.source_holdout(sourced(spark, d), "key", "vec", "label", "source"))
