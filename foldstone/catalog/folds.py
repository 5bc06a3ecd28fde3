"""Fold tables, arms and joins over events and documents."""

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import joins as J
from ..operators import splits as S
from ..operators.inventory import label_coverage
from ..operators.profile import composition
from ..operators.vectors import fuse
from ..operators.cells import nearest_in_cells
from .base import DOCS, OBS, PRED, VECS, docs, obs, pred, query, rounded, snake_sql, tidy, vecs

K = 5
EARLY, LATE = "early", "NOT early"
_DOC_SOURCES = [f"src{i}" for i in range(20)]

GROUPED = f"gf AS ({snake_sql('obs', 'grp', K)}), grouped AS (SELECT obs.*, gf.fold FROM obs JOIN gf USING (grp))"
STRAT = """strat AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5('42|' || key), key) - 1) % 5 AS fold FROM obs)"""


def _long(src, protocol, key="key"):
    return f"""SELECT '{protocol}' AS protocol, f AS fold, {key}, CASE WHEN fold = f THEN 'test' ELSE 'train' END AS split
      FROM {src}, range({K}) AS t(f)"""


FOLDS = f"""{OBS}, {GROUPED}, {STRAT}, folds AS (
  {_long('grouped', 'speaker_independent')} UNION ALL {_long('strat', 'random_stratified')}
  UNION ALL SELECT 'statement_holdout', 0, key, CASE WHEN early THEN 'train' ELSE 'test' END FROM obs
  UNION ALL SELECT 'statement_holdout_si', f, key, CASE WHEN fold = f THEN 'test' ELSE 'train' END
    FROM grouped, range({K}) AS t(f) WHERE (fold = f AND NOT early) OR (fold <> f AND early))"""


def assigned(spark, d):
    """Observations with their places in all protocols, without the columns that no query reads."""
    rows = obs(spark, d).select("key", "grp", "label", "early")
    return S.assigned_folds(rows, "key", "grp", "label", F.expr(EARLY), F.expr(LATE), K, method="snake")


def folds(spark, d):
    return S.build_folds(obs(spark, d), "key", "grp", "label", F.expr(EARLY), F.expr(LATE), K, method="snake")


def grouped(spark, d):
    return S.with_group_fold(obs(spark, d), "grp", K, "snake")


# documents: the base source is src0, groups are languages within a source
DOCF = f"""{DOCS}, own AS (SELECT *, (row_number() OVER (ORDER BY md5('42|' || key), key) - 1) % 5 AS fold
  FROM docs WHERE source = 'src0'), docfolds AS ({_long('own', 'speaker_independent')})"""


def doc_folds(spark, d):
    base = docs(spark, d).where(F.col("source") == "src0").withColumn("one", F.lit(1))
    return S.long_table(S.stratified_folds(base, "one", "key", K), "speaker_independent", "key", K)


@query("spl_01", f"WITH {OBS}, {GROUPED} SELECT key, grp, fold FROM grouped")
def group_kfold(spark, d):
    return grouped(spark, d).select("key", "grp", F.col("fold").cast("bigint").alias("fold"))


@query("spl_01_greedy", """WITH RECURSIVE sizes AS (SELECT user_id AS grp, count(*) AS n FROM events GROUP BY 1),
 seq AS (SELECT grp, n, row_number() OVER (ORDER BY n DESC, grp) AS i FROM sizes),
 run(i, loads, grp, fold) AS (SELECT 0, [0, 0, 0, 0, 0]::BIGINT[], NULL::BIGINT, NULL::BIGINT
   UNION ALL SELECT seq.i, list_transform(range(5), lambda j: loads[j + 1] + CASE WHEN j = list_position(loads, list_min(loads)) - 1 THEN seq.n ELSE 0 END),
     seq.grp, list_position(loads, list_min(loads)) - 1 FROM run JOIN seq ON seq.i = run.i + 1)
SELECT grp, fold FROM run WHERE i > 0""")
def group_kfold_greedy(spark, d):
    return S.greedy_folds(obs(spark, d), "grp", K).select("grp", F.col("fold").cast("bigint").alias("fold"))


@query("spl_02", f"WITH {OBS}, {STRAT} SELECT key, label, fold FROM strat")
def stratified(spark, d):
    return S.stratified_folds(obs(spark, d), "label", "key", K).select("key", "label", F.col("fold").cast("bigint").alias("fold"))


@query("spl_03", f"WITH {OBS} SELECT 'statement_holdout' AS protocol, 0 AS fold, key, CASE WHEN early THEN 'train' ELSE 'test' END AS split FROM obs")
def holdout(spark, d):
    return S.attribute_holdout(obs(spark, d), "key", F.expr(EARLY), F.expr(LATE))


@query("spl_04", f"WITH {FOLDS} SELECT * FROM folds WHERE protocol = 'statement_holdout_si'")
def holdout_disjoint(spark, d):
    return S.attribute_holdout_disjoint(grouped(spark, d), "key", K, F.expr(EARLY), F.expr(LATE))


@query("spl_05", f"""WITH {DOCS}, src AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS fold FROM (SELECT DISTINCT source FROM docs) AS _d)
SELECT 'corpus_holdout' AS protocol, src.fold, key, CASE WHEN docs.source = src.source THEN 'test' ELSE 'train' END AS split FROM docs, src""")
def source_out(spark, d):
    return S.leave_one_source_out(docs(spark, d), "key")


@query("spl_06", f"WITH {FOLDS} SELECT * FROM folds")
def all_protocols(spark, d):
    return folds(spark, d)


_IN = "(row_number() OVER (PARTITION BY outer_fold ORDER BY n DESC, md5(grp::VARCHAR), grp) - 1) % 6"


@query("spl_07", f"""WITH {OBS}, {GROUPED}, sp AS (SELECT f AS outer_fold, grp, count(*) AS n FROM grouped, range({K}) AS t(f) WHERE fold <> f GROUP BY ALL),
 r AS (SELECT outer_fold, grp, {_IN} AS s FROM sp)
SELECT outer_fold AS "outer", grp, CASE WHEN s < 3 THEN s ELSE 5 - s END AS fold FROM r""")
def nested(spark, d):
    return S.nested_folds(grouped(spark, d), "grp", 3).select("outer", "grp", F.col("fold").cast("bigint").alias("fold"))


ARMS_SQL = f"""{DOCF}, ext AS (SELECT f AS fold, key FROM docs, range({K}) AS t(f) WHERE source <> 'src0'),
 tr AS (SELECT fold, key FROM docfolds WHERE split = 'train'), te AS (SELECT fold, key FROM docfolds WHERE split = 'test'),
 allt AS (SELECT * FROM tr UNION ALL SELECT * FROM ext),
 arms AS (SELECT a AS arm, fold, 'test' AS stage, key FROM te, unnest(['ravdess_only', 'pooled', 'two_stage', 'two_stage_frozen']) AS t(a)
  UNION ALL SELECT a, fold, 'stage2', key FROM tr, unnest(['ravdess_only', 'two_stage', 'two_stage_frozen']) AS t(a)
  UNION ALL SELECT 'pooled', fold, 'stage2', key FROM allt
  UNION ALL SELECT a, fold, 'stage1', key FROM allt, unnest(['two_stage', 'two_stage_frozen']) AS t(a))"""


@query("spl_08", f"""WITH {ARMS_SQL} SELECT arm, fold, count(*) FILTER (WHERE stage = 'stage1') AS stage1,
 count(*) FILTER (WHERE stage = 'stage2') AS stage2, count(*) FILTER (WHERE stage = 'test') AS test,
 arm = 'two_stage_frozen' AS freeze_backbone FROM arms GROUP BY arm, fold""")
def arms(spark, d):
    return S.arm_summary(S.arm_table(doc_folds(spark, d), docs(spark, d), "key", "src0"))


@query("spl_09", "SELECT 0::BIGINT AS added, 0::BIGINT AS missing FROM (SELECT count(*) FROM events) AS _c")
def freeze(spark, d):
    return S.freeze_check_assigned(assigned(spark, d), assigned(spark, d).repartition(3, "key"), "key", K)


# ---------------------------------------------------------------------- joins


@query("jn_01", rounded("""SELECT o.o_orderkey, o.o_totalprice, l.lines, l.quantity FROM orders o LEFT JOIN
 (SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1) l ON o.o_orderkey = l.l_orderkey""", "o_totalprice", "quantity", digits=2))
def left_guarded(spark, d):
    from .base import read

    lines = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity")
    )
    return tidy(J.guarded_left_join(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), lines, "o_orderkey"), 2)


@query("jn_02", f"WITH {FOLDS} SELECT obs.key, obs.label, split FROM obs JOIN folds USING (key) WHERE protocol = 'speaker_independent' AND folds.fold = 2")
def split_rows(spark, d):
    rows = obs(spark, d).select("key", "label")
    train, test = S.get_split(rows, folds(spark, d), "speaker_independent", 2, "key")
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@query("jn_03", f"WITH {OBS} SELECT o.o_orderkey AS key, obs.label FROM orders o JOIN obs ON obs.key = o.o_orderkey")
def lookup(spark, d):
    from .base import read

    keys = read(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    return J.keyed_lookup(obs(spark, d).select("key", "label"), keys, "key")


@query("jn_04", f"""WITH {DOCF} SELECT key, source, 'train' AS side FROM docs WHERE source IN ('src1', 'src2')
 UNION ALL SELECT docs.key, docs.source, f.split FROM docs JOIN docfolds f USING (key) WHERE f.fold = 1""")
def added_train(spark, d):
    train, test = S.augmented_train(docs(spark, d), doc_folds(spark, d), "speaker_independent", 1, "key", ["src1", "src2"], "src0")
    return train.select("key", "source", F.lit("train").alias("side")).unionByName(test.select("key", "source", F.lit("test").alias("side")))


@query("jn_05", f"""WITH {DOCS} SELECT DISTINCT source FROM docs WHERE source <> 'src0' AND label = 1""")
def contamination(spark, d):
    index = docs(spark, d)
    return S.foreign_test_sources(index.where("label = 1"), index.select("key", "source"), "key", "src0")


@query("jn_06", f"""WITH {FOLDS} SELECT grp, bool_or(split = 'train') AND bool_or(split = 'test') AS leaks
 FROM obs JOIN (SELECT * FROM folds WHERE protocol = 'random_stratified' AND fold = 0) USING (key) GROUP BY grp HAVING leaks""")
def overlap(spark, d):
    tagged = S.tag_split(obs(spark, d).select("key", "grp"), folds(spark, d), "random_stratified", 0, "key")
    return J.group_overlap(tagged, "grp").withColumn("leaks", F.lit(True))


@query("jn_07", f"WITH {VECS} SELECT key, list_concat(list_transform(vec, lambda x: round(x, 6) + 0e0), list_transform(vec, lambda x: round(2 * x, 6) + 0e0)) AS vec FROM vecs")
def fusion(spark, d):
    a = vecs(spark, d).select("key", "vec")
    return tidy(fuse(a, a.select("key", F.transform("vec", lambda x: 2 * x).alias("vec")), "key"))


@query("jn_08", f"WITH {PRED} SELECT key, y_true, y_pred AS pred_a, y_pred_b AS pred_b FROM pred")
def paired(spark, d):
    rows = pred(spark, d)
    a = rows.select("key", "y_true", F.col("y_pred").alias("pred_a"))
    return J.aligned(a, rows.select("key", F.col("y_pred_b").alias("pred_b")), "key")


@query("jn_09", f"""WITH {PRED}, l AS (SELECT unnest(['click', 'error', 'never', 'purchase', 'signup', 'view']) AS v)
 SELECT t.v AS y_true, p.v AS y_pred, count(pred.key) AS n FROM l t CROSS JOIN l p
 LEFT JOIN pred ON y_true = t.v AND y_pred = p.v GROUP BY ALL""")
def densify(spark, d):
    return E.confusion(pred(spark, d), ["click", "error", "never", "purchase", "signup", "view"])


@query("jn_10", f"WITH {VECS} SELECT label, count(*) AS n, true AS same_label, true AS cross_group FROM vecs GROUP BY label HAVING count(*) > 1")
def cross_group_pairs(spark, d):
    from ..operators.augment import mixup

    rows = vecs(spark, d)
    a = rows.select(F.col("key").alias("a"), F.col("label").alias("la"), F.col("grp").alias("ga"))
    b = rows.select(F.col("key").alias("b"), F.col("label").alias("lb"), F.col("grp").alias("gb"))
    pairs = mixup(rows, "key", "vec", "label", "grp", 1.0, "jn").select("label", "draw", "a", "b")
    return pairs.join(a, "a").join(b, "b").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and((F.col("la") == F.col("label")) & (F.col("lb") == F.col("label"))).alias("same_label"),
        F.bool_and(F.col("ga") != F.col("gb")).alias("cross_group"),
    )


@query("jn_11", rounded(f"""WITH {VECS} SELECT a.key, b.key AS ref, list_distance(a.vec, b.vec) AS distance FROM vecs a JOIN vecs b ON a.grp <> b.grp
 QUALIFY row_number() OVER (PARTITION BY a.key ORDER BY list_distance(a.vec, b.vec), b.key) <= 3""", "distance"))
def all_pairs(spark, d):
    rows = vecs(spark, d)
    return tidy(nearest_in_cells(rows, rows, 3, "key", "vec", "label", fold="grp").select("key", "ref", "distance"))


@query("jn_12", f"""WITH {FOLDS} SELECT protocol, fold, split, label, count(*) AS n FROM folds JOIN (SELECT key, label FROM obs) USING (key) GROUP BY ALL""")
def fold_composition(spark, d):
    return S.protocol_counts(assigned(spark, d), ["label"], K)


# ---------------------------------------------------- fold-level aggregations


@query("agg_10", rounded(f"""WITH {FOLDS}, j AS (SELECT protocol, folds.fold, split, grp, label, key % 2 = 1 AS odd, label || '_src' AS source FROM folds JOIN obs USING (key)),
 ov AS (SELECT protocol, fold, count(*) FILTER (WHERE a AND b) AS group_overlap FROM
  (SELECT protocol, fold, grp, bool_or(split = 'train') AS a, bool_or(split = 'test') AS b FROM j GROUP BY ALL) AS _g GROUP BY ALL)
SELECT j.protocol, j.fold, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test,
 count(DISTINCT grp) FILTER (WHERE split = 'train') AS train_groups, count(DISTINCT grp) FILTER (WHERE split = 'test') AS test_groups,
 any_value(group_overlap) AS group_overlap, round(100e0 * count(*) FILTER (WHERE split = 'test' AND odd) / count(*) FILTER (WHERE split = 'test'), 1) AS test_pct_attribute,
 count(DISTINCT label) FILTER (WHERE split = 'test') AS test_labels, count(*) FILTER (WHERE split = 'test' AND label = 'click') AS test_click,
 5 AS source_overlap, string_agg(DISTINCT source, ',' ORDER BY source) FILTER (WHERE split = 'test') AS test_sources
FROM j JOIN ov ON ov.protocol = j.protocol AND ov.fold = j.fold GROUP BY j.protocol, j.fold""", "test_pct_attribute"))
def fold_summary(spark, d):
    rows = assigned(spark, d).withColumn("source", F.concat("label", F.lit("_src")))
    return tidy(S.summarise_protocols(rows, "grp", "label", F.col("key") % 2 == 1, ["click"], "source", K))


@query("agg_20", f"""WITH {ARMS_SQL} SELECT arms.fold, {", ".join(f"count(*) FILTER (WHERE stage = 'stage2' AND source = '{s}') AS train_{s}" for s in _DOC_SOURCES)},
 count(*) FILTER (WHERE stage = 'test') AS test_rows, count(*) FILTER (WHERE stage = 'test' AND source <> 'src0') AS test_external
 FROM arms JOIN docs USING (key) WHERE arm = 'pooled' GROUP BY arms.fold""")
def train_composition(spark, d):
    arms_ = S.arm_table(doc_folds(spark, d), docs(spark, d), "key", "src0").where("arm = 'pooled'")
    rows = arms_.join(docs(spark, d).select("key", "source"), "key").withColumn("split", F.when(F.col("stage") == "test", "test").otherwise("train"))
    return composition(rows, "fold", "source", _DOC_SOURCES, "src0")


@query("spl_06_merged", f"""WITH {DOCS}, obs AS (SELECT key, source || '-' || lang AS grp, lang AS label, source FROM docs),
 gf AS ({snake_sql('obs', 'grp', K)}), grouped AS (SELECT obs.*, gf.fold FROM obs JOIN gf USING (grp)), {STRAT},
 src AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS fold FROM (SELECT DISTINCT source FROM docs) AS _d)
{_long('grouped', 'speaker_independent_merged')} UNION ALL {_long('strat', 'random_stratified_merged')}
 UNION ALL SELECT 'corpus_holdout', src.fold, key, CASE WHEN docs.source = src.source THEN 'test' ELSE 'train' END FROM docs, src""")
def merged_protocols(spark, d):
    rows = docs(spark, d).withColumn("grp", F.concat_ws("-", "source", "lang"))
    return S.build_merged_folds(rows, "key", "grp", "lang", method="snake")


_COVERED = [*[f"src{i}" for i in range(20)], "nope"]
_ALL_COVERED = " + ".join(_COVERED)


@query("agg_04_docs", f"""WITH {DOCS}, c AS (SELECT lang, {", ".join(f"count(*) FILTER (WHERE source = '{s}') AS {s}" for s in _COVERED)}
  FROM docs GROUP BY lang UNION ALL SELECT 'xx', {", ".join("0" for _ in _COVERED)})
SELECT *, {_ALL_COVERED} AS "TOTAL", format('{{:.1f}}%', 100e0 * ({_ALL_COVERED}) / sum({_ALL_COVERED}) OVER ()) AS share,
 concat_ws(', ', {", ".join(f"CASE WHEN {s} > 0 THEN '{s}' END" for s in _COVERED)}) AS sources FROM c""")
def coverage(spark, d):
    return label_coverage(docs(spark, d), "lang", "source", ["en", "de", "es", "fr", "xx"], _COVERED)
