"""Scores and uncertainty of deterministic predictions over events."""

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import uncertainty as U
from ..operators.splits import with_group_fold
from ..functions.text import sorted_json_column
from ..vocab import N_BOOT
from .base import (
    EVENT_LABELS, HIGH_EVENTS, PRED, h, h60, obs, pred, query, rounded, score_sql, tidy,
)

LABELS_SQL = "labels5(label, o) AS (VALUES ('click',0),('error',1),('purchase',2),('signup',3),('view',4))"
TALLY = "tally AS (SELECT y_true, y_pred, count(*) AS n FROM pred GROUP BY ALL)"
HIGH = "('error', 'purchase')"


@query("eval_01", f"""WITH {PRED}, {LABELS_SQL}
SELECT t.label AS y_true, p.label AS y_pred, count(pred.key) AS n
FROM labels5 t CROSS JOIN labels5 p LEFT JOIN pred ON pred.y_true = t.label AND pred.y_pred = p.label
GROUP BY t.label, p.label""")
def confusion(spark, d):
    return E.confusion(pred(spark, d), EVENT_LABELS)


@query("eval_02", rounded(f"""WITH {PRED}, {LABELS_SQL}, m AS (
  SELECT l.label, (SELECT count(*) FROM pred WHERE y_true = l.label) AS support,
    (SELECT count(*) FROM pred WHERE y_pred = l.label) AS predicted,
    (SELECT count(*) FROM pred WHERE y_true = l.label AND y_pred = l.label) AS hits FROM labels5 l
  UNION ALL SELECT 'zz_absent', 0, 0, 0)
SELECT label, support, predicted, hits, CASE WHEN predicted > 0 THEN hits / predicted::DOUBLE ELSE 0 END AS "precision",
  CASE WHEN support > 0 THEN hits / support::DOUBLE ELSE 0 END AS recall,
  CASE WHEN support + predicted > 0 THEN 2e0 * hits / (support + predicted) ELSE 0 END AS f1 FROM m""", '"precision"', "recall", "f1"))
def per_class(spark, d):
    return tidy(E.per_class(pred(spark, d), [*EVENT_LABELS, "zz_absent"]).drop("label_order"))


@query("eval_03", rounded(f"WITH {PRED}, {TALLY} {score_sql('tally')}", "accuracy", "macro_f1", "weighted_f1", "macro_f1_present"))
def overall(spark, d):
    return tidy(E.score(pred(spark, d)))


_SLICES = f"""WITH {PRED}, long AS (
  SELECT 'early' AS slice, early::VARCHAR AS level, y_true, y_pred FROM pred UNION ALL
  SELECT 'label', label, y_true, y_pred FROM pred UNION ALL
  SELECT 'weekday', (dayofweek(ts) + 1)::VARCHAR, y_true, y_pred FROM pred),
t AS (SELECT slice, level, y_true, y_pred, count(*) AS n FROM long GROUP BY ALL)
SELECT slice, level, n, accuracy, CASE WHEN n_classes > 1 THEN macro_f1 END AS macro_f1 FROM ({score_sql('t', 'slice, level')}) AS _s"""


@query("eval_04", rounded(_SLICES, "accuracy", "macro_f1"))
def slices(spark, d):
    rows = pred(spark, d).withColumn("weekday", F.dayofweek("ts"))
    return tidy(E.slices(rows, ["early", "label", "weekday", "not_there"]))


@query("eval_05", rounded(f"""WITH {PRED}, {TALLY} SELECT 'group_safe' AS protocol, '0' AS fold, 'hashed' AS model,
 '{{"a": 7, "b": [1, 2]}}' AS hyperparams, accuracy, macro_f1 FROM ({score_sql('tally')}) AS _s""", "accuracy", "macro_f1"))
def one_run(spark, d):
    run = E.evaluate(
        pred(spark, d), EVENT_LABELS, "group_safe", 0, "hashed", hyperparams={"b": [1, 2], "a": 7}, slice_columns=["early"]
    )
    return tidy(run.row.select("protocol", "fold", "model", "hyperparams", "accuracy", "macro_f1"))


@query("eval_06", rounded(f"""WITH {PRED}, {TALLY} SELECT 'pooled' AS fold, accuracy, macro_f1 FROM ({score_sql('tally')}) AS _s""", "accuracy", "macro_f1"))
def pooled(spark, d):
    rows = with_group_fold(pred(spark, d), "grp", 5, "snake")
    run = E.evaluate_pooled([rows.where(F.col("fold") == f) for f in range(5)], EVENT_LABELS, "group_safe", model="hashed")
    return tidy(run.row.select("fold", "accuracy", "macro_f1"))


@query("eval_07", rounded(f"""WITH {PRED}, t AS (SELECT early, y_true, y_pred, count(*) AS n FROM pred
  WHERE NOT early OR label IN ('click', 'view') GROUP BY ALL)
SELECT early, n, macro_f1, macro_f1_present FROM ({score_sql('t', 'early')}) AS _s""", "macro_f1", "macro_f1_present"))
def present_classes(spark, d):
    rows = pred(spark, d).where(~F.col("early") | F.col("label").isin("click", "view"))
    return tidy(E.score(rows, "early").select("early", "n", "macro_f1", "macro_f1_present"))


@query("eval_08", rounded(f"""WITH {PRED}, s AS (SELECT * FROM pred WHERE NOT early OR label <> 'click'),
shared AS (SELECT y_true FROM s GROUP BY y_true HAVING count(DISTINCT early) = 2),
t AS (SELECT early, y_true, y_pred, count(*) AS n FROM s WHERE y_true IN (SELECT y_true FROM shared) GROUP BY ALL)
SELECT early, n, accuracy, macro_f1 FROM ({score_sql('t', 'early')}) AS _s""", "accuracy", "macro_f1"))
def shared_classes(spark, d):
    rows = pred(spark, d).where(~F.col("early") | (F.col("label") != "click"))
    return tidy(E.shared_class_slices(rows, "early").select("early", "n", "accuracy", "macro_f1"))


@query("eval_09", rounded(f"""WITH {PRED}, {LABELS_SQL}, c AS (
SELECT t.label AS y_true, p.label AS y_pred, count(pred.key) AS n
FROM labels5 t CROSS JOIN labels5 p LEFT JOIN pred ON pred.y_true = t.label AND pred.y_pred = p.label GROUP BY ALL)
SELECT y_true, y_pred, n / greatest(sum(n) OVER (PARTITION BY y_true), 1)::DOUBLE AS share FROM c""", "share"))
def normalised(spark, d):
    return tidy(E.normalised_confusion(pred(spark, d), EVENT_LABELS))


@query("eval_10", rounded(f"""WITH {PRED}, e AS (
  SELECT count(*) FILTER (WHERE (y_true IN {HIGH}) = (y_pred IN {HIGH})) AS within_errors,
         count(*) FILTER (WHERE (y_true IN {HIGH}) <> (y_pred IN {HIGH})) AS across_errors FROM pred WHERE y_true <> y_pred)
SELECT *, within_errors / (within_errors + across_errors)::DOUBLE AS within_share, 0.4::DOUBLE AS chance_within_share,
  within_errors / (within_errors + across_errors)::DOUBLE / 0.4::DOUBLE AS lift FROM e""", "within_share", "chance_within_share", "lift"))
def error_structure(spark, d):
    return tidy(E.error_structure(pred(spark, d), HIGH_EVENTS, EVENT_LABELS))


@query("eval_11", rounded(f"""WITH {PRED}, r AS (SELECT y_true AS label, avg((y_pred = y_true)::INT) AS recall_a,
  avg((y_pred_b = y_true)::INT) AS recall_b, count(*) AS c FROM pred GROUP BY 1)
SELECT label, recall_a, recall_b, round((recall_a - recall_b) * 100, 2) AS delta_pp,
  round(100e0 * c / sum(c) OVER (), 2) AS share_pct FROM r""", "recall_a", "recall_b"))
def class_deltas(spark, d):
    rows = pred(spark, d)
    return tidy(E.class_deltas(rows, rows.drop("y_pred").withColumnRenamed("y_pred_b", "y_pred")))


RESULTS = f"""{PRED}, res AS (
  SELECT 'm' || ({h("'m'", 'key')} % 3) AS model, CASE WHEN early THEN 'random_stratified' ELSE 'speaker_independent' END AS protocol,
    grp % 5 AS fold, avg((y_true = y_pred)::INT) AS accuracy, avg((y_true = y_pred_b)::INT) AS macro_f1, count(*) AS n
  FROM pred GROUP BY ALL)"""


def results(spark, d):
    """A results log derived from the predictions: model x protocol x fold."""
    from ..functions.hashing import hash32

    right_a, right_b = (F.col("y_true") == F.col("y_pred")), (F.col("y_true") == F.col("y_pred_b"))
    return (
        pred(spark, d)
        .groupBy(
            F.concat(F.lit("m"), (hash32("m", F.col("key")) % 3).cast("string")).alias("model"),
            F.when(F.col("early"), "random_stratified").otherwise("speaker_independent").alias("protocol"),
            (F.col("grp") % 5).alias("fold"),
        )
        .agg(F.avg(right_a.cast("int")).alias("accuracy"), F.avg(right_b.cast("int")).alias("macro_f1"), F.count(F.lit(1)).alias("n"))
    )


@query("eval_12", rounded(f"""WITH {RESULTS}, w AS (SELECT model, max(accuracy) FILTER (WHERE protocol = 'random_stratified') AS leaky,
  max(accuracy) FILTER (WHERE protocol = 'speaker_independent') AS honest FROM res GROUP BY model)
SELECT *, (leaky - honest) * 100 AS gap_pp, (leaky / honest - 1) * 100 AS inflation_pct FROM w""", "leaky", "honest", "gap_pp", "inflation_pct"))
def leakage(spark, d):
    return tidy(E.leakage_gap(results(spark, d), "random_stratified", "speaker_independent"))


@query("eval_13", f"WITH {PRED} SELECT key, y_true, y_pred FROM pred")
def synthetic(spark, d):
    return E.with_synthetic_predictions(obs(spark, d), "label", "key", EVENT_LABELS, 7, "a").select("key", "y_true", "y_pred")


@query("eval_14", f"""WITH {RESULTS} SELECT model, protocol, fold::VARCHAR AS fold,
  '{{"fold":' || fold || ',"n":' || n || '}}' AS hyperparams, left(sha256(model || protocol || fold), 12) AS run_key,
  round(accuracy, 6) AS accuracy FROM res""")
def log_rows(spark, d):
    rows = results(spark, d)
    text = F.concat("model", "protocol", F.col("fold").cast("string"))
    return rows.select(
        "model", "protocol", F.col("fold").cast("string").alias("fold"),
        sorted_json_column(n=F.col("n"), fold=F.col("fold")).alias("hyperparams"),
        F.left(F.sha2(text, 256), F.lit(12)).alias("run_key"), F.round("accuracy", 6).alias("accuracy"),
    )


@query("eval_15", rounded(f"""WITH {RESULTS}, g AS (SELECT model, max(accuracy) FILTER (WHERE protocol = 'random_stratified')
    - max(accuracy) FILTER (WHERE protocol = 'speaker_independent') AS gap_pp, avg(macro_f1) AS macro_f1, count(*) AS cells FROM res GROUP BY model)
SELECT model AS protocol, cells = 10 AS all_classes, macro_f1 < 0.9 AS no_source_cue, gap_pp, macro_f1 FROM g
ORDER BY 2 DESC, 3 DESC, 4, 5 DESC LIMIT 1""", "gap_pp", "macro_f1"))
def protocol_ranking(spark, d):
    res = results(spark, d)
    best = lambda p: F.max(F.when(F.col("protocol") == p, F.col("accuracy")))
    table = res.groupBy(F.col("model")).agg(
        (best("random_stratified") - best("speaker_independent")).alias("gap_pp"), F.avg("macro_f1").alias("macro_f1"),
        F.count(F.lit(1)).alias("cells"),
    ).select(
        F.col("model").alias("protocol"), (F.col("cells") == 10).alias("all_classes"),
        (F.col("macro_f1") < 0.9).alias("no_source_cue"), "gap_pp", "macro_f1",
    )
    return tidy(E.rank_protocols(table).limit(1))


# ---------------------------------------------------------------- uncertainty



def _boot_sql(long: str, by: str = "", metric: str = "macro_f1") -> str:
    """(by, b, value): replicate scores of long(by, config, grp, y_true, y_pred)."""
    b = f"{by}, " if by else ""
    over = f"PARTITION BY {by} " if by else ""
    on = "".join(f" AND d.{c.strip()} = r.{c.strip()}" for c in by.split(",") if c.strip())
    rb = "".join(f"r.{c.strip()}, " for c in by.split(",") if c.strip())
    return f"""cells AS (SELECT {b}config, grp, y_true, y_pred, count(*) AS n FROM {long} GROUP BY ALL),
groups AS (SELECT {b}grp, row_number() OVER ({over}ORDER BY md5(grp::VARCHAR), grp) - 1 AS pos,
   count(*) OVER ({over}) AS g FROM (SELECT DISTINCT {b}grp FROM cells) AS _d),
draws AS (SELECT {b}b, {h60("'42'", 'b', 'pos')} % g AS pick FROM groups, range({N_BOOT}) AS t(b)),
rep AS (SELECT {rb}r.config, d.b, r.y_true, r.y_pred, sum(r.n) AS n FROM draws d
   JOIN (SELECT cells.*, groups.pos FROM cells JOIN groups ON groups.grp = cells.grp{"".join(f" AND groups.{c.strip()} = cells.{c.strip()}" for c in by.split(",") if c.strip())}) r
   ON d.pick = r.pos{on} GROUP BY ALL),
boot AS (SELECT {b}config, b, {metric} AS value FROM ({score_sql('rep', b + 'config, b')}) AS _s),
point AS (SELECT {b}config, {metric} AS value FROM ({score_sql('cells', b + 'config')}) AS _s)"""


@query("stat_01", rounded(f"""WITH {PRED}, long AS (SELECT 'a' AS config, grp, y_true, y_pred FROM pred), {_boot_sql('long')}
SELECT (SELECT value FROM point) AS point, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi,
  stddev_samp(value) AS se, (SELECT count(*) FROM groups) AS n_groups FROM boot""", "point", "lo", "hi", "se"))
def cluster_ci(spark, d):
    return tidy(U.cluster_bootstrap(pred(spark, d), "grp", n_boot=N_BOOT))


_LONG2 = """long AS (SELECT 'a' AS config, grp, y_true, y_pred FROM pred
  UNION ALL SELECT 'b', grp, y_true, y_pred_b FROM pred)"""
_PAIRED = """SELECT x.config, (SELECT value FROM point p WHERE p.config = x.config) AS point,
  (SELECT value FROM point p WHERE p.config = x.config) - (SELECT value FROM point WHERE config = '{c}') AS delta,
  quantile_cont(x.value - y.value, 0.025) AS lo, quantile_cont(x.value - y.value, 0.975) AS hi,
  least(1e0, 2e0 * least(avg((x.value - y.value <= 0)::INT), avg((x.value - y.value >= 0)::INT))) AS p_value,
  quantile_cont(x.value - y.value, 0.025) > 0 OR quantile_cont(x.value - y.value, 0.975) < 0 AS significant
FROM boot x JOIN boot y ON x.b = y.b AND y.config = '{c}' WHERE x.config <> '{c}' GROUP BY x.config"""


@query("stat_02", rounded(f"""WITH {PRED}, {_LONG2}, {_boot_sql('long')} SELECT * EXCLUDE (config, point) FROM ({_PAIRED.format(c='b')}) AS _p""",
    "delta", "lo", "hi", "p_value"))
def paired_ci(spark, d):
    return tidy(U.paired_bootstrap(pred(spark, d), "grp", "y_pred", "y_pred_b", n_boot=N_BOOT))


_MCNEMAR = """SELECT early, only_a_correct, only_b_correct, p AS p_value, p < 0.05 AS significant FROM (
 SELECT *, CASE WHEN only_a_correct = only_b_correct THEN 1e0 ELSE least(1e0, 2e0 * (
   SELECT sum(exp(lgamma(a + b + 1e0) - lgamma(i + 1e0) - lgamma(a + b - i + 1e0) - (a + b) * ln(2e0)))
   FROM (SELECT only_a_correct AS a, only_b_correct AS b, unnest(range(least(only_a_correct, only_b_correct) + 1)) AS i) AS _i)) END AS p FROM {src}) AS _m"""


@query("stat_03", rounded(f"""WITH {PRED}, w AS (SELECT *, CASE WHEN {h("'d'", 'key')} % 10 < 7 THEN label ELSE
    {"['click', 'error', 'purchase', 'signup', 'view']"}[{h("'c'", 'key')} % 5 + 1] END AS other FROM pred),
 s AS (SELECT early, count(*) FILTER (WHERE y_pred = y_true AND other <> y_true) AS only_a_correct,
   count(*) FILTER (WHERE y_pred <> y_true AND other = y_true) AS only_b_correct FROM w GROUP BY early)
{_MCNEMAR.format(src='s')}""", "p_value"))
def sign_test(spark, d):
    rows = pred(spark, d)
    other = E.with_synthetic_predictions(rows.withColumnRenamed("y_pred", "_a"), "label", "key", EVENT_LABELS, 7, "d")
    other = other.withColumnRenamed("y_pred", "other").withColumnRenamed("_a", "y_pred")
    return tidy(U.mcnemar(other, "y_pred", "other", by="early"))


@query("stat_04", rounded(f"""WITH {PRED}, long AS (SELECT 'a' AS config, key AS grp, y_true, y_pred FROM pred),
{_boot_sql('long').replace(f'range({N_BOOT})', 'range(40)')}
SELECT (SELECT value FROM point) AS point, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi,
  stddev_samp(value) AS se, (SELECT count(*) FROM groups) AS n_groups FROM boot""", "point", "lo", "hi", "se"))
def row_ci(spark, d):
    return tidy(U.cluster_bootstrap(pred(spark, d), "key", n_boot=40))


def _draw_sql(n: str, p: str, *key: str) -> str:
    """SQL of a binomial draw from key hashes, as ``functions.binomial`` makes it."""
    text = ", ".join(f"({k})::VARCHAR" for k in key)
    u = lambda t, name: f"(('0x' || substr(md5(concat_ws('|', {text}, {t}::VARCHAR, '{name}')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496"
    tail = lambda k: f"""CASE WHEN {k} < 10 THEN lgamma({k} + 1e0) - (0.5::DOUBLE * ln(2 * pi()) + ({k} + 0.5::DOUBLE) * ln({k} + 1e0) - ({k} + 1e0))
      ELSE (1 / 12e0 - (1 / 360e0 - 1 / 1260e0 / (({k} + 1e0) * ({k} + 1e0))) / (({k} + 1e0) * ({k} + 1e0))) / ({k} + 1e0) END"""  # noqa: E731
    q = f"least({p}, 1e0 - {p})"
    gaps = f"list_transform(range(64), lambda t: floor(ln({u('t', 'g')}) / ln(1e0 - {q}))::BIGINT + 1)"
    few = f"len(list_filter(list_transform([{gaps}], lambda g: list_transform(range(1, 65), lambda i: list_sum(g[1:i])))[1], lambda s: s <= {n}))"
    sd, mode = f"sqrt({n} * {q} * (1e0 - {q}))", f"floor(({n} + 1) * {q})"
    b = f"(1.15::DOUBLE + 2.53::DOUBLE * {sd})"
    a = f"(-0.0873::DOUBLE + 0.0248::DOUBLE * {b} + 0.01::DOUBLE * {q})"
    odds = f"({q} / (1e0 - {q}))"
    rest = f"({n} - {mode} + 1e0)"
    top = f"(({mode} + 0.5::DOUBLE) * ln(({mode} + 1e0) / ({odds} * {rest})) + {tail(mode)} + {tail(f'({n} - {mode})')})"
    tries = f"list_transform(range(48), lambda t: {{'u': {u('t', 'u')} - 0.5::DOUBLE, 'v': {u('t', 'v')}}})"
    placed = f"list_transform({tries}, lambda x: {{'v': x.v, 'us': 0.5::DOUBLE - abs(x.u), 'k': floor((2 * {a} / (0.5::DOUBLE - abs(x.u)) + {b}) * x.u + {n} * {q} + 0.5::DOUBLE)}})"
    bound = f"""{top} + ({n} + 1e0) * ln({rest} / ({n} - x.k + 1e0)) + (x.k + 0.5::DOUBLE) * ln(({n} - x.k + 1e0) * {odds} / (x.k + 1e0)) - ({tail('x.k')}) - ({tail(f'({n} - x.k)')})"""
    good = f"""x.k >= 0 AND x.k <= {n} AND CASE WHEN x.us >= 0.07::DOUBLE AND x.v <= 0.92::DOUBLE - 4.2::DOUBLE / {b} THEN true
      ELSE ln(x.v * ((2.83::DOUBLE + 5.1::DOUBLE / {b}) * {sd}) / ({a} / (x.us * x.us) + {b})) <= {bound} END"""
    # k outside the range must not reach a logarithm
    many = f"list_filter(list_filter({placed}, lambda x: x.k >= 0 AND x.k <= {n}), lambda x: {good})[1].k::BIGINT"
    return f"""CASE WHEN {n} = 0 OR {p} <= 0 THEN 0 WHEN {p} >= 1 THEN {n} ELSE (CASE WHEN {p} > 0.5::DOUBLE THEN {n} ELSE 0 END)
      + (CASE WHEN {p} > 0.5::DOUBLE THEN -1 ELSE 1 END) * (CASE WHEN {n} * {q} < 10 THEN {few} ELSE {many} END) END"""


def _row_boot_sql(by: str = "", level: str = "''", metric: str = "macro_f1") -> str:
    """boot and point of a bootstrap of single rows of long(by, y_true, y_pred); {level} is the text of the level."""
    b, g = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    on = f"USING ({by})" if by else "ON true"
    return f"""cells AS (SELECT {b}y_true, y_pred, count(*) AS n FROM long GROUP BY ALL),
listed AS (SELECT {b}{level} AS lv, list(y_true ORDER BY y_true, y_pred) AS ts, list(y_pred ORDER BY y_true, y_pred) AS ps, list(n ORDER BY y_true, y_pred) AS ns, sum(n)::BIGINT AS total FROM cells {g}),
sums AS (SELECT *, list_transform(range(0, len(ns) + 1), lambda i: coalesce(list_sum(ns[1:i]), 0)::BIGINT) AS w FROM listed),
tree AS (SELECT {b}lv, ts, ps, w, t.b AS b, 0::BIGINT AS lo, len(ns)::BIGINT AS hi, total AS n FROM sums, range({N_BOOT}) AS t(b)
  UNION ALL SELECT {b}lv, ts, ps, w, b, CASE WHEN side = 0 THEN lo ELSE mid END, CASE WHEN side = 0 THEN mid ELSE hi END, CASE WHEN side = 0 THEN x ELSE n - x END
  FROM (SELECT *, {_draw_sql('n', 'p', "'42'", 'lv', 'b', 'lo', 'hi')} AS x
    FROM (SELECT {b}lv, ts, ps, w, b, lo, hi, n, (lo + hi) // 2 AS mid, (w[(lo + hi) // 2 + 1] - w[lo + 1]) / (w[hi + 1] - w[lo + 1])::DOUBLE AS p FROM tree WHERE hi - lo > 1) AS _p) AS _x, range(2) AS z(side)),
rep AS (SELECT {b}b, ts[lo + 1] AS y_true, ps[lo + 1] AS y_pred, n FROM tree WHERE hi - lo = 1 AND n > 0),
boot AS (SELECT {b}{metric} AS value FROM ({score_sql('rep', b + 'b')}) AS _s),
point AS (SELECT {b}{metric} AS value FROM ({score_sql('cells', by)}) AS _s)"""


_ROW_CI = """quantile_cont(boot.value, 0.025) AS lo, quantile_cont(boot.value, 0.975) AS hi, stddev_samp(boot.value) AS se"""


@query("stat_04_cells", rounded(f"""WITH RECURSIVE {PRED}, long AS (SELECT y_true, y_pred FROM pred), {_row_boot_sql()}
SELECT (SELECT value FROM point) AS point, {_ROW_CI}, (SELECT sum(n)::BIGINT FROM cells) AS n FROM boot""", "point", "lo", "hi", "se"))
def row_ci_cells(spark, d):
    """All 2,000 draws of single rows, as multinomial draws over label pairs."""
    return tidy(U.row_bootstrap(pred(spark, d), n_boot=N_BOOT))


@query("stat_05", rounded(f"""WITH {PRED}, long AS (SELECT 'a' AS config, grp, y_true, y_pred FROM pred), {_boot_sql('long', metric='accuracy')}
SELECT (SELECT value FROM point) AS point, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi,
  stddev_samp(value) AS se, (SELECT count(*) FROM groups) AS n_groups FROM boot""", "point", "lo", "hi", "se"))
def custom_metric(spark, d):
    def share_right(true, guess, weight):
        return weight[true == guess].sum() / weight.sum()

    return tidy(U.cluster_bootstrap(pred(spark, d), "grp", U.pandas_metric(share_right), N_BOOT, alpha=0.1))


@query("stat_06", rounded(f"""WITH {PRED}, long AS (SELECT 'a' AS config, grp, y_true, y_pred FROM pred
  UNION ALL SELECT 'b', grp, y_true, y_pred_b FROM pred UNION ALL SELECT 'click', grp, y_true, 'click' FROM pred),
{_boot_sql('long')} {_PAIRED.format(c='a')}""", "point", "delta", "lo", "hi", "p_value"))
def versus_reference(spark, d):
    rows = pred(spark, d).withColumn("always", F.lit("click"))
    long = U.to_long(rows, "grp", {"a": "y_pred", "b": "y_pred_b", "click": "always"})
    return tidy(U.paired_comparisons(long, "grp", "config", "a", n_boot=N_BOOT))


@query("stat_07", rounded(f"""WITH {PRED}, long AS (SELECT early, 'a' AS config, grp, y_true, y_pred FROM pred), {_boot_sql('long', 'early')}
SELECT early, (SELECT value FROM point p WHERE p.early = boot.early) AS point, quantile_cont(value, 0.025) AS lo,
  quantile_cont(value, 0.975) AS hi, stddev_samp(value) AS se,
  (SELECT count(*) FROM groups g WHERE g.early = boot.early) AS n_groups FROM boot GROUP BY early""", "point", "lo", "hi", "se"))
def slice_ci(spark, d):
    return tidy(U.cluster_bootstrap(pred(spark, d), "grp", n_boot=N_BOOT, by="early"))
