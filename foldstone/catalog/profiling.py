"""Aggregates, windows, sorts, set operations over the star schema."""

from pyspark.sql import functions as F

from ..operators import inventory as I
from ..operators import profile as P
from ..operators.evaluate import top_confusions
from ..operators.ranking import hash_rank
from ..operators.series import trim_bounds, frame_index
from ..operators.transfer import subset_table, versus_control
from ..operators.vectors import group_zscore
from .base import DOCS, OBS, PRED, docs, obs, pred, query, read, rounded, tidy
from .evaluation import RESULTS, results

LINE_STATS = ["min", "p25", "median", "mean", "p75", "max", "std"]
_DIST = """min({x}) AS min, quantile_cont({x}, 0.25) AS p25, quantile_cont({x}, 0.5) AS median, avg({x}) AS mean,
 quantile_cont({x}, 0.75) AS p75, max({x}) AS max, stddev_samp({x}) AS std"""


@query("agg_01", """WITH t AS (SELECT o_orderkey, o_custkey % 50 AS grp, o_orderstatus, CASE WHEN o_custkey % 2 = 1 THEN 'male' ELSE 'female' END AS gender,
   o_orderpriority FROM orders), g AS (SELECT grp, count(*) AS n FROM t GROUP BY 1)
SELECT 'row count' AS "check", '7' AS expected, count(*)::VARCHAR AS found FROM t
UNION ALL SELECT 'group count', '51', count(*)::VARCHAR FROM g
UNION ALL SELECT 'rows per group', '300', count(*) FILTER (WHERE n <> 300)::VARCHAR FROM g
UNION ALL SELECT 'rows per label', '5', o_orderstatus || '=' || count(*) FROM t GROUP BY o_orderstatus
UNION ALL SELECT 'rows per label', '0', 'X=0' WHERE false
UNION ALL SELECT 'forbidden combination', '0', count(*)::VARCHAR FROM t WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
UNION ALL SELECT 'groups per attribute', '12', gender || '=' || count(DISTINCT grp) FROM t GROUP BY gender
UNION ALL SELECT 'derived attribute', '0', count(*)::VARCHAR FROM t WHERE gender <> CASE WHEN grp % 3 = 1 THEN 'male' ELSE 'female' END""")
def inventory_checks(spark, d):
    rows = read(spark, d, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 50).alias("grp"), "o_orderstatus",
        F.when(F.col("o_custkey") % 2 == 1, "male").otherwise("female").alias("gender"), "o_orderpriority",
    )
    found = I.inventory_problems(
        rows, "o_orderkey", "grp", "o_orderstatus", 7, 51, 300, {"F": 5, "O": 5, "P": 5},
        (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"), "gender", {"male": 12, "female": 12},
        F.when(F.col("grp") % 3 == 1, "male").otherwise("female"),
    )
    return found


_INDEX = """idx AS (SELECT doc_id, 'f' || doc_id % 900 || '.wav' AS filename, 'p/' || doc_id AS filepath, source, 'g' || doc_id % 30 AS speaker_id,
   CASE WHEN doc_id % 97 = 0 THEN 'bored' ELSE ['neutral','calm','happy','sad','angry','fearful','disgust','surprised'][doc_id % 8 + 1] END AS emotion_label,
   (doc_id % 9 + 1)::INT AS label, (doc_id % 8 + CASE WHEN doc_id % 10 = 3 THEN 1 ELSE 0 END)::INT AS label_idx,
   CASE WHEN doc_id % 50 = 0 THEN NULL ELSE 'male' END AS gender FROM documents)"""


@query("agg_02", f"""WITH {_INDEX}
SELECT 'stray label' AS "check", '0' AS expected, emotion_label || '=' || count(*) AS found FROM idx WHERE emotion_label = 'bored' GROUP BY emotion_label
UNION ALL SELECT 'label range', '0', count(*)::VARCHAR FROM idx WHERE label NOT BETWEEN 1 AND 8
UNION ALL SELECT 'label index drift', '0', count(*)::VARCHAR FROM idx WHERE emotion_label <> 'bored' AND label_idx IS DISTINCT FROM doc_id % 8
UNION ALL SELECT 'shared keys', '0', count(*)::VARCHAR FROM (SELECT filename FROM idx GROUP BY 1 HAVING count(*) > 1) AS _a HAVING count(*) > 0
UNION ALL SELECT 'group spans sources', '0', count(*)::VARCHAR FROM (SELECT speaker_id FROM idx GROUP BY 1 HAVING count(DISTINCT source) > 1) AS _b
UNION ALL SELECT 'published count', '51', source || '=' || count(*) FROM idx WHERE source IN ('src0', 'src1') GROUP BY source HAVING count(*) <> 51
UNION ALL SELECT 'nulls in gender', '0', count(*)::VARCHAR FROM idx WHERE gender IS NULL
UNION ALL SELECT 'missing columns', 'none', 'actor,emotion,intensity,statement,repetition,intensity_label,statement_label,repetition_label'
UNION ALL SELECT 'missing files', '0', count(*)::VARCHAR FROM idx WHERE doc_id % 4 = 0""")
def index_checks(spark, d):
    from ..vocab import LABELS

    k = F.col("doc_id")
    names = F.array(*[F.lit(x) for x in LABELS])
    index = read(spark, d, "documents").select(
        F.concat(F.lit("f"), (k % 900).cast("string"), F.lit(".wav")).alias("filename"),
        F.concat(F.lit("p/"), k.cast("string")).alias("filepath"), "source",
        F.concat(F.lit("g"), (k % 30).cast("string")).alias("speaker_id"),
        F.when(k % 97 == 0, "bored").otherwise(F.get(names, (k % 8).cast("int"))).alias("emotion_label"),
        (k % 9 + 1).cast("int").alias("label"), (k % 8 + F.when(k % 10 == 3, 1).otherwise(0)).cast("int").alias("label_idx"),
        F.when(k % 50 == 0, F.lit(None)).otherwise("male").alias("gender"),
    )
    files = read(spark, d, "documents").where(k % 4 != 0).select(F.concat(F.lit("p/"), k.cast("string")).alias("path"))
    return I.index_problems(index, files, published={"src0": 51, "src1": 51, "absent": 9})


@query("agg_03", rounded(f"""WITH {OBS} SELECT label, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS share,
 max(count(*)) OVER () / sum(count(*)) OVER ()::DOUBLE AS majority FROM obs GROUP BY label""", "share", "majority"))
def shares(spark, d):
    return tidy(P.value_shares(obs(spark, d), "label"))


_DAYS = list(range(1, 31))


@query("agg_04", f"WITH {OBS} SELECT label, " + ", ".join(f'count(*) FILTER (WHERE day(ts) = {i}) AS "{i}"' for i in _DAYS) + " FROM obs GROUP BY label")
def crosstab(spark, d):
    return P.crosstab(obs(spark, d).withColumn("day", F.dayofmonth("ts")), "label", "day", _DAYS)


@query("agg_05", f"""WITH {DOCS} SELECT CASE WHEN grouping(source) = 1 THEN 'TOTAL' ELSE source END AS source, count(*) AS "rows",
 count(DISTINCT n_chars % 37) AS "groups", count(DISTINCT lang) AS labels, count(*) FILTER (WHERE label = 0) AS "0", count(*) FILTER (WHERE label = 1) AS "1"
 FROM docs GROUP BY ROLLUP (source)""")
def source_summary(spark, d):
    rows = docs(spark, d).withColumn("grp", F.col("n_chars") % 37)
    return I.summarise_sources(rows, "source", "grp", "lang", "label", [0, 1])


@query("agg_06", rounded(f"SELECT l_returnflag, {_DIST.format(x='l_extendedprice')} FROM lineitem GROUP BY 1", *LINE_STATS, digits=4))
def distribution(spark, d):
    return tidy(P.distribution(read(spark, d, "lineitem"), "l_extendedprice", "l_returnflag"), 4)


_ATTR = ["l_returnflag", "l_linestatus", "l_linenumber"]


@query("agg_07", rounded(" UNION ALL ".join(f"""SELECT '{a}' AS attribute, {a}::VARCHAR AS level, count(*) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std,
 min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem GROUP BY 2""" for a in _ATTR), "mean", "std"))
def grouped_stats(spark, d):
    return tidy(P.grouped_stats(read(spark, d, "lineitem"), "l_quantity", _ATTR))


@query("agg_08", rounded("""SELECT l_returnflag, count(*) AS clips, list_sort(list(DISTINCT l_linenumber)) AS rates, list_sort(list(DISTINCT l_tax)) AS channels,
 list_sort(list(DISTINCT strftime(l_shipdate, '%Y')))[1:3] AS subtypes, min(l_quantity) AS dur_min, quantile_cont(l_quantity, 0.5) AS dur_med, max(l_quantity) AS dur_max,
 round(sum(l_quantity) / 3600, 2) AS total_hours FROM lineitem GROUP BY 1""", "dur_min", "dur_med", "dur_max", "total_hours"))
def headers(spark, d):
    rows = read(spark, d, "lineitem").withColumn("year", F.date_format("l_shipdate", "yyyy"))
    return tidy(P.header_summary(rows, "l_returnflag", "l_linenumber", "l_tax", "year", "l_quantity"))


@query("agg_09", """WITH g AS (SELECT md5(text) AS h, count(*) AS n, list_sort(list(DISTINCT source)) AS s FROM documents GROUP BY 1 HAVING count(*) > 1),
 f AS (SELECT md5(text) AS h, doc_id::VARCHAR AS k FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id::VARCHAR) <= 4)
SELECT left(g.h, 12) AS md5, n, array_to_string(s, ', ') AS sources, len(s) > 1 AS cross_source,
 (SELECT string_agg(k, ', ' ORDER BY k) FROM f WHERE f.h = g.h) AS files FROM g""")
def duplicates(spark, d):
    rows = read(spark, d, "documents").withColumn("name", F.col("doc_id").cast("string"))
    return I.content_duplicates(rows, "text", "source", "name")


_DOM = "d AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_linenumber QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber) = 1)"


@query("agg_11", f"""WITH {_DOM} SELECT l.l_orderkey, l.l_suppkey, l.l_linenumber, d.l_linenumber AS dominant FROM lineitem l JOIN d USING (l_suppkey)
 WHERE l.l_linenumber <> d.l_linenumber AND l.l_quantity > 10""".replace("FROM lineitem GROUP", "FROM lineitem WHERE l_quantity > 10 GROUP"))
def anomalies(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity")
    return P.off_dominant(rows, "l_suppkey", "l_linenumber", F.col("l_quantity") > 10).drop("l_quantity")


@query("agg_12", rounded(f"""WITH {OBS}, s AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY label, early ORDER BY md5('7|' || key), key) <= 40)
SELECT label, early, count(*) AS n_probed, round(avg(x), 1) AS value_mean, round(stddev_pop(x), 1) AS value_sd FROM s GROUP BY ALL""", "value_mean", "value_sd"))
def sampled_cells(spark, d):
    return tidy(P.sampled_cell_statistic(obs(spark, d), ["label", "early"], "key", "x", 40, 7))


@query("agg_13", f"""WITH {OBS} SELECT label, count(*) FILTER (WHERE early) AS "true", count(*) FILTER (WHERE NOT early) AS "false" FROM obs GROUP BY label""")
def class_balance(spark, d):
    return P.crosstab(obs(spark, d), "label", "early", [True, False])


@query("agg_14", rounded(f"""WITH {OBS}, q AS (SELECT label, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM obs GROUP BY 1),
 j AS (SELECT obs.label, x, q1, median, q3, x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ins FROM obs JOIN q USING (label))
SELECT label, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3, min(x) FILTER (WHERE ins) AS whisker_lo, max(x) FILTER (WHERE ins) AS whisker_hi,
 count(*) FILTER (WHERE NOT ins) AS n_outliers FROM j GROUP BY 1""", "q1", "median", "q3", "whisker_lo", "whisker_hi"))
def boxes(spark, d):
    return tidy(P.box_statistics(obs(spark, d), "label", "x"))


@query("agg_16", rounded("""WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2e0 AS rx,
 rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2e0 AS ry FROM lineitem)
SELECT corr(x, y) AS pearson, corr(rx, ry) AS spearman, count(*) AS n FROM r""", "pearson", "spearman"))
def correlation(spark, d):
    return tidy(P.correlations(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


_RF = ["acc_mean", "acc_sd", "acc_min", "acc_max", "f1_mean", "f1_sd"]


@query("agg_17", rounded(f"""WITH {RESULTS} SELECT model, protocol, avg(accuracy) AS acc_mean, stddev_samp(accuracy) AS acc_sd, min(accuracy) AS acc_min,
 max(accuracy) AS acc_max, avg(macro_f1) AS f1_mean, stddev_samp(macro_f1) AS f1_sd FROM res GROUP BY ALL""", *_RF))
def rollups(spark, d):
    return tidy(P.results_rollup(results(spark, d)))


@query("agg_18", rounded("""WITH c AS (SELECT avg(l_extendedprice) AS v FROM lineitem GROUP BY l_returnflag, l_linenumber, l_suppkey)
SELECT max(v) AS highest, min(v) AS lowest, max(v) / min(v) AS ratio, 20 * log10(max(v) / min(v)) AS decibel FROM c""", "highest", "lowest", "ratio", "decibel", digits=4))
def ratios(spark, d):
    return tidy(P.extreme_ratio(read(spark, d, "lineitem"), ["l_returnflag", "l_linenumber", "l_suppkey"], "l_extendedprice"), 4)


@query("agg_19", rounded(f"""WITH {RESULTS}, r AS (SELECT * FROM res WHERE protocol = 'speaker_independent')
SELECT fold::VARCHAR AS fold, model, accuracy AS value FROM r UNION ALL SELECT 'sd', model, stddev_samp(accuracy) FROM r GROUP BY model
UNION ALL SELECT 'range', model, max(accuracy) - min(accuracy) FROM r GROUP BY model""", "value"))
def fold_table(spark, d):
    return tidy(P.fold_table(results(spark, d).where("protocol = 'speaker_independent'")))


# -------------------------------------------------------------------- windows


@query("win_01", rounded("""SELECT l_orderkey, l_linenumber, l_partkey, (l_extendedprice - avg(l_extendedprice) OVER w) / (stddev_pop(l_extendedprice) OVER w + 1e-8) AS z
 FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)""", "z"))
def zscores(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return tidy(group_zscore(rows, "l_extendedprice", "l_suppkey", "z").select("l_orderkey", "l_linenumber", "l_partkey", "z"))


_MEAN = "mm AS (SELECT model, avg(macro_f1) AS macro_f1 FROM res GROUP BY model)"


def _means(spark, d):
    return results(spark, d).groupBy("model").agg(F.avg("macro_f1").alias("macro_f1"))


@query("win_02", rounded(f"WITH {RESULTS}, {_MEAN} SELECT model, macro_f1, round((macro_f1 - (SELECT macro_f1 FROM mm WHERE model = 'm0')) * 100, 2) AS vs_control_pp FROM mm", "macro_f1", "vs_control_pp"))
def control_delta(spark, d):
    return tidy(versus_control(_means(spark, d), "model", "macro_f1", "m0"))


@query("win_03", f"WITH {OBS} SELECT key, label, early FROM obs QUALIFY row_number() OVER (PARTITION BY label, early ORDER BY md5('s1|' || key), key) <= 25")
def sample(spark, d):
    return P.cell_sample(obs(spark, d), ["label", "early"], "key", 25, "s1").select("key", "label", "early")


@query("win_04", rounded(f"""WITH {RESULTS} SELECT protocol, fold, model, accuracy FROM res QUALIFY row_number() OVER (PARTITION BY protocol, fold ORDER BY accuracy DESC, n) = 1""", "accuracy"))
def best(spark, d):
    return tidy(P.best_per_group(results(spark, d), ["protocol", "fold"], "accuracy", "n", ["model"]))


@query("win_05", rounded(f"""WITH {RESULTS}, r AS (SELECT * FROM res WHERE model <> 'm2' OR fold = 0)
SELECT model || protocol AS run, avg(accuracy) AS mean, coalesce(stddev_samp(accuracy), 0) AS fold_sd, count(*) AS n_folds FROM r GROUP BY 1""", "mean", "fold_sd"))
def dispersion(spark, d):
    rows = results(spark, d).where("model <> 'm2' OR fold = 0").withColumn("run", F.concat("model", "protocol"))
    return tidy(P.fold_dispersion(rows, "run", "accuracy"))


SERIES = f"{OBS}, series AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts, key) - 1 AS frame_idx FROM obs)"


def series(spark, d):
    return frame_index(obs(spark, d), "grp", ["ts", "key"])


@query("win_06", f"""WITH {SERIES}, p AS (SELECT grp, frame_idx, x * x AS power, max(x * x) OVER (PARTITION BY grp) AS peak FROM series)
SELECT grp, min(frame_idx) FILTER (WHERE power >= peak * pow(10, -0.6)) AS first, max(frame_idx) FILTER (WHERE power >= peak * pow(10, -0.6)) AS last,
 count(*) AS n_frames FROM p GROUP BY grp""")
def active(spark, d):
    return trim_bounds(series(spark, d).withColumn("power", F.col("x") * F.col("x")), "grp", "power", 6)


@query("win_07", f"WITH {OBS} SELECT label, key, grp FROM obs QUALIFY row_number() OVER (PARTITION BY label ORDER BY key) = 1")
def representative(spark, d):
    return P.first_rows(obs(spark, d), "label", "key", ["grp"])


@query("win_08", rounded(f"""WITH {RESULTS}, s AS (SELECT model, fold, avg(macro_f1) AS macro_f1 FROM res GROUP BY ALL)
SELECT *, round((macro_f1 - lag(macro_f1) OVER (PARTITION BY model ORDER BY fold)) * 100, 2) AS gain_pp FROM s""", "macro_f1", "gain_pp"))
def gains(spark, d):
    steps = results(spark, d).groupBy("model", "fold").agg(F.avg("macro_f1").alias("macro_f1"))
    return tidy(P.step_gain(steps, "fold", "macro_f1", "model"))


# ------------------------------------------------------- sorts, pivots, sets


_DECLARED = [f"src{i}" for i in (3, 1, 0, 2, *range(4, 20))]


@query("srt_01", f"""WITH {DOCS} SELECT row_number() OVER (ORDER BY list_position({_DECLARED}, source), filepath) AS place, filepath
 FROM (SELECT source, 'd/' || lang || '/' || key AS filepath FROM docs) AS _t""")
def total_order(spark, d):
    rows = docs(spark, d).select("source", F.concat_ws("/", F.lit("d"), "lang", F.col("key").cast("string")).alias("filepath"))
    ordered = I.ordered_index(rows, _DECLARED)
    # the sort leaves rows in partition order; the position follows from it
    from ..operators.ranking import ordered_rank

    place = F.array_position(F.array(*[F.lit(s) for s in _DECLARED]), F.col("source"))
    return ordered_rank(ordered.withColumn("o", place), [], ["o", "filepath"], "place").select("place", "filepath")


@query("srt_02", rounded(f"WITH {RESULTS} SELECT model, protocol, fold, accuracy FROM res ORDER BY accuracy DESC, model, protocol, fold LIMIT 5", "accuracy"))
def top_configs(spark, d):
    keys = [F.desc("accuracy"), "model", "protocol", "fold"]
    return tidy(P.top_k(results(spark, d).select("model", "protocol", "fold", "accuracy"), keys, 5))


@query("srt_03", f"WITH {PRED} SELECT y_true, y_pred, count(*) AS n FROM pred WHERE y_true <> y_pred GROUP BY ALL ORDER BY n DESC, y_true, y_pred LIMIT 6")
def confusions(spark, d):
    return top_confusions(pred(spark, d), 6)


@query("srt_04", """WITH k AS (SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1)
SELECT * FROM k ORDER BY event_id DESC LIMIT 12""")
def last_rows(spark, d):
    return P.last_n(read(spark, d, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id", 12)


@query("srt_05", rounded(f"""WITH {RESULTS} SELECT fold, protocol, max(accuracy) FILTER (WHERE model = 'm0') AS m0, max(accuracy) FILTER (WHERE model = 'm1') AS m1,
 max(accuracy) FILTER (WHERE model = 'm2') AS m2 FROM res GROUP BY ALL""", "m0", "m1", "m2"))
def pivot(spark, d):
    return tidy(P.report_pivot(results(spark, d), ["fold", "protocol"], "model", ["m0", "m1", "m2"], F.max("accuracy")))


@query("set_01", "SELECT c_nationkey AS nation, 'customer' AS kind, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, 'supplier', count(*) FROM supplier GROUP BY 1")
def concat(spark, d):
    a = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.lit("customer").alias("kind"), F.count(F.lit(1)).alias("n"))
    b = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.lit("supplier").alias("kind"), F.count(F.lit(1)).alias("n"))
    return P.union_all([a, b])


@query("set_02", "SELECT n_nationkey AS nation FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def difference(spark, d):
    rich = read(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("nation")).subtract(rich)


@query("set_03", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersection(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("k")).intersect(read(spark, d, "orders").select(F.col("o_custkey").alias("k")))


@query("set_04", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated(spark, d):
    return P.duplicated(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("set_05", """WITH m AS (SELECT range AS mask FROM range(8)), s(bit, member) AS (VALUES (0, 'src1'), (1, 'src2'), (2, 'src3')),
 c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
SELECT coalesce(string_agg(member, '+' ORDER BY bit), '(base only)') AS subset, count(member) AS n_sources, coalesce(sum(n), 0)::BIGINT AS n_rows
FROM m LEFT JOIN s ON (mask >> bit) & 1 = 1 LEFT JOIN c ON c.source = s.member GROUP BY mask""")
def power_set(spark, d):
    return subset_table(read(spark, d, "documents"), "source", ["src1", "src2", "src3"])


@query("set_06", rounded(f"""WITH {OBS}, g AS (SELECT t, b FROM (VALUES (1.0), (10.0), (100.0)) AS _a(t), (VALUES (true), (false)) AS _b(b))
SELECT t::DOUBLE AS threshold, b AS early, count(*) FILTER (WHERE x >= t AND obs.early = b) AS n FROM obs, g GROUP BY ALL""", "threshold"))
def grid(spark, d):
    from pyspark.sql import functions as F

    cells = P.candidate_grid(spark, {"threshold": [1.0, 10.0, 100.0], "early": [True, False]})
    # candidates are few: each becomes one conditional count of a single scan
    rows = obs(spark, d)
    names = [(r["ordinal"], r["threshold"], r["early"]) for r in cells.collect()]
    counted = rows.agg(*[F.count_if((F.col("x") >= t) & (F.col("early") == e)).alias(f"c{i}") for i, t, e in names])
    lines = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(e).alias("early"), F.col(f"c{i}").alias("n")) for i, t, e in names])
    return counted.select(F.explode(lines).alias("e")).select("e.*")


@query("rank_hash", f"WITH {OBS} SELECT key, row_number() OVER (PARTITION BY label ORDER BY md5('9|' || key), key) AS rank FROM obs")
def hash_positions(spark, d):
    return hash_rank(obs(spark, d), "label", "key", 9).select("key", "rank")
