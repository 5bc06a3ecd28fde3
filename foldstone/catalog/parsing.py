"""Parsers, vocabularies and scalar functions over names derived from the tables."""

from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import arrays as A
from ..functions import text as X
from ..functions.hashing import hash32, uniform
from ..operators import augment as G
from ..operators import inventory as I
from ..operators import profile as P
from ..operators import splits as S
from ..operators import vectors as N
from .base import DOCS, VECS, docs, h, obs, query, read, rounded, tidy, vecs
from .evaluation import RESULTS, results
from .folds import FOLDS, folds


def _pad(e):
    return F.lpad(e.cast("string"), 2, "0")


def base_files(spark, d):
    """Base-corpus paths built from order keys; some fields are broken on purpose."""
    k = F.col("o_orderkey")
    parts = [_pad(k % 9 + 1), _pad(k % 2 + 1), _pad(F.floor(k / 2) % 2 + 1), _pad(F.floor(k / 4) % 2 + 1)]
    name = F.when(k % 53 == 0, F.concat_ws("-", *parts)).otherwise(F.concat_ws("-", *parts, _pad(k % 26)))
    folder = F.concat(F.lit("root/Person"), _pad(F.when(k % 100 == 0, 1).otherwise(k % 26)))
    return read(spark, d, "orders").select(k.alias("id"), F.concat(folder, F.lit("/"), name, F.lit(".wav")).alias("path"))


_P = "lpad(({0})::VARCHAR, 2, '0')"


def _p(e):
    return _P.format(e)


BASE = f"""src AS (SELECT o_orderkey AS k, {_p('o_orderkey % 9 + 1')} AS e, {_p('o_orderkey % 2 + 1')} AS i, {_p('o_orderkey // 2 % 2 + 1')} AS s,
  {_p('o_orderkey // 4 % 2 + 1')} AS r, o_orderkey % 26 AS a FROM orders),
 named AS (SELECT *, concat_ws('-', e, i, s, r, CASE WHEN k % 53 <> 0 THEN {_p('a')} END) || '.wav' AS filename,
  'root/Person' || CASE WHEN k % 100 = 0 THEN '01' ELSE {_p('a')} END AS folder FROM src),
 base AS (SELECT *, folder || '/' || filename AS filepath, CASE WHEN k % 53 = 0 THEN 'field count' WHEN k % 9 = 8 THEN 'unknown emotion'
   WHEN a NOT BETWEEN 1 AND 24 THEN 'actor' WHEN k % 100 = 0 AND a <> 1 THEN 'directory' END AS problem FROM named)"""
_LBL = "['neutral','calm','happy','sad','angry','fearful','disgust','surprised']"


@query("prj_01", f"""WITH {BASE} SELECT k AS id, filename, '03' AS modality, '01' AS vocal_channel, e AS emotion, i AS intensity, s AS statement, r AS repetition,
 a::INT AS actor, {_LBL}[e::INT] AS emotion_label, CASE i WHEN '01' THEN 'normal' ELSE 'strong' END AS intensity_label,
 CASE s WHEN '01' THEN 'kids' ELSE 'dogs' END AS statement_label, CASE r WHEN '01' THEN '1st' ELSE '2nd' END AS repetition_label,
 CASE WHEN a % 2 = 1 THEN 'male' ELSE 'female' END AS gender FROM base WHERE problem IS NULL""")
def strict_parse(spark, d):
    return I.strict(I.parse_base(base_files(spark, d)).where("problem IS NULL")).drop("filepath", "path")


@query("prj_02", f"WITH {BASE} SELECT filename, problem, count(*) AS n FROM base WHERE problem IS NOT NULL GROUP BY ALL")
def directory_check(spark, d):
    return I.problems(I.parse_base(base_files(spark, d))).groupBy("filename", "problem").agg(F.count(F.lit(1)).alias("n"))


@query("prj_03", "SELECT event_id, CASE WHEN user_id % 2 = 1 THEN 'male' ELSE 'female' END AS gender FROM events")
def parity(spark, d):
    return read(spark, d, "events").select("event_id", I.parity_gender(F.col("user_id")).alias("gender"))


@query("prj_04", f"""WITH {BASE} SELECT k AS id, 'RAVDESS' AS source, 'RAVDESS_' || {_p('a')} AS speaker_id, e::INT AS label, e::INT - 1 AS label_idx,
 {_LBL}[e::INT] AS emotion_label FROM base WHERE problem IS NULL""")
def base_adapter(spark, d):
    rows = I.base_index(I.parse_base(base_files(spark, d)), keep=["id"]).where("problem IS NULL")
    return rows.select("id", "source", "speaker_id", "label", "label_idx", "emotion_label")


def crema_files(spark, d):
    k = F.col("o_orderkey")
    emotions = F.array(*[F.lit(x) for x in [*V.CREMAD_EMOTION, "BAD"]])
    levels = F.array(*[F.lit(x) for x in V.CREMAD_INTENSITY])
    fields = [(k % 91 + 1001).cast("string"), F.lit("DFA"), F.get(emotions, (k % 7).cast("int")), F.get(levels, (k % 4).cast("int"))]
    name = F.when(k % 61 == 0, F.concat_ws("_", *fields[:3])).otherwise(F.concat_ws("_", *fields))
    return read(spark, d, "orders").select(k.alias("id"), F.concat(F.lit("AudioWAV/"), name, F.lit(".wav")).alias("path"))


def crema_people(spark, d):
    key = F.col("c_custkey")
    return read(spark, d, "customer").where(key < 60).select(
        (key + 1001).alias("ActorID"), F.when(key % 3 == 0, "Male").otherwise("Female").alias("Sex")
    )


@query("prj_05", """SELECT o_orderkey AS id, 'CREMA-D_' || (o_orderkey % 91 + 1001) AS speaker_id,
 CASE WHEN o_orderkey % 91 < 60 THEN CASE WHEN o_orderkey % 91 % 3 = 0 THEN 'male' ELSE 'female' END ELSE 'unknown' END AS gender,
 ['neutral','happy','sad','angry','fearful','disgust'][o_orderkey % 7 + 1] AS emotion_label,
 ['unspecified','low','medium','high'][o_orderkey % 4 + 1] AS intensity_label, 'DFA' AS statement,
 CASE WHEN o_orderkey % 7 = 6 THEN 'unknown emotion' END AS problem FROM orders WHERE o_orderkey % 61 <> 0""")
def cremad(spark, d):
    rows = I.parse_cremad(crema_files(spark, d), crema_people(spark, d), keep=["id"])
    return rows.where("problem IS NULL OR problem <> 'field count'").select(
        "id", "speaker_id", "gender", "emotion_label", "intensity_label", "statement", "problem"
    )


@query("prj_06", """SELECT p_partkey AS id, 'TESS_' || CASE p_partkey % 3 WHEN 0 THEN 'OAF' WHEN 1 THEN 'YAF' ELSE 'OAF' END AS speaker_id,
 'w' || p_size AS statement, ['neutral','happy','sad','angry','fearful','disgust','surprised'][p_partkey % 8 + 1] AS emotion_label, 'female' AS gender,
 CASE WHEN p_partkey % 8 = 7 THEN 'unknown emotion' END AS problem FROM part""")
def tess(spark, d):
    k = F.col("p_partkey")
    who = F.get(F.array(F.lit("oaf"), F.lit("YAF"), F.lit("OA")), (k % 3).cast("int"))
    how = F.get(F.array(*[F.lit(x) for x in [*V.TESS_EMOTION, "shout"]]), (k % 8).cast("int"))
    files = read(spark, d, "part").select(
        k.alias("id"), F.concat(F.lit("TESS/x/"), F.concat_ws("_", who, F.concat(F.lit("w"), F.col("p_size").cast("string")), F.upper(how)), F.lit(".wav")).alias("path")
    )
    return I.parse_tess(files, keep=["id"]).select("id", "speaker_id", "statement", "emotion_label", "gender", "problem")


@query("prj_07", """SELECT p_partkey AS id, 'SAVEE_' || ['DC','JE','JK','KL','XX'][p_partkey % 5 + 1] AS speaker_id,
 ['neutral','happy','sad','angry','fearful','disgust','surprised'][p_partkey % 7 + 1] AS emotion_label, lpad(p_size::VARCHAR, 2, '0') AS statement,
 CASE WHEN p_partkey % 5 = 4 THEN 'speaker' END AS problem FROM part""")
def savee(spark, d):
    k = F.col("p_partkey")
    who = F.get(F.array(*[F.lit(x) for x in ["DC", "JE", "JK", "KL", "XX"]]), (k % 5).cast("int"))
    code = F.get(F.array(*[F.lit(x) for x in V.SAVEE_EMOTION]), (k % 7).cast("int"))
    take = F.concat(F.when(k % 2 == 0, F.upper(code)).otherwise(code), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(".wav"))
    path = F.when(k % 3 == 0, F.concat(F.lower(who), F.lit("/"), take)).otherwise(F.concat(F.lit("flat/"), who, F.lit("_"), take))
    files = read(spark, d, "part").select(k.alias("id"), path.alias("path"))
    return I.parse_savee(files, keep=["id"]).select("id", "speaker_id", "emotion_label", "statement", "problem")


@query("prj_08", """SELECT doc_id AS id, 'd' || doc_id || '.wav' AS filename, 'x/d' || doc_id || '.wav' AS filepath, 'own' AS source, 'own_' || lang AS speaker_id,
 NULL::INT AS actor, 'unknown' AS gender, '03' AS emotion, 'NA' AS intensity, 'NA' AS statement, '01' AS repetition, 'happy' AS emotion_label,
 'unspecified' AS intensity_label, 'NA' AS statement_label, '01' AS repetition_label, 3 AS label, 2 AS label_idx FROM documents""")
def canonical(spark, d):
    rows = read(spark, d, "documents").select(
        F.col("doc_id").alias("id"), "lang", F.concat(F.lit("x/d"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("path")
    )
    return I.to_canonical(rows, source="own", speaker=F.col("lang"), gender=F.lit("unknown"), label=F.lit("happy"), keep=["id"]).drop("problem")


@query("prj_09", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def closed_vocabulary(spark, d):
    return I.stray_labels(read(spark, d, "events"), "event_type", ["click", "view"])


@query("prj_10", rounded("SELECT l_orderkey, l_linenumber, l_partkey, [l_quantity, l_extendedprice, l_discount, l_tax] AS features FROM lineitem", digits=6).replace("SELECT * REPLACE () FROM", "SELECT * FROM"))
def features(spark, d):
    rows = read(spark, d, "lineitem").drop("l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate")
    return N.assemble(rows, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("prj_11", f"WITH {DOCS} SELECT key, lang, n_chars FROM docs WHERE source = 'src0'")
def base_view(spark, d):
    return docs(spark, d).where(F.col("source") == "src0").select("key", "lang", "n_chars")


@query("prj_12", f"WITH {FOLDS} SELECT obs.key, obs.label FROM obs JOIN folds USING (key) WHERE protocol = 'speaker_independent' AND folds.fold = 0 AND split = 'train'")
def training_rows(spark, d):
    return S.training_subset(obs(spark, d).select("key", "label"), folds(spark, d), "key")


@query("prj_13", """SELECT doc_id AS id, 'd' || doc_id || '__' || CASE WHEN doc_id % 2 = 0 THEN 'noise20db' ELSE 'pitch+2' END || '.wav' AS tagged,
 'd' || doc_id || '.wav' AS source_of_tagged, 'd' || doc_id || '.wav' AS source_of_plain FROM documents""")
def tagged_names(spark, d):
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".wav"))
    tag = F.when(F.col("doc_id") % 2 == 0, "noise20db").otherwise("pitch+2")
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("id"), name.alias("plain"), G.augmented_key(name, tag).alias("tagged"))
    return rows.select("id", "tagged", G.source_key(F.col("tagged")).alias("source_of_tagged"), G.source_key(F.col("plain")).alias("source_of_plain"))


@query("prj_14", rounded(f"WITH {VECS}, u AS (SELECT key, unnest(vec) AS value, generate_subscripts(vec, 1) - 1 AS p FROM vecs) SELECT key, 'emb_mean_' || lpad(p::VARCHAR, 3, '0') AS name, value FROM u", "value"))
def element_names(spark, d):
    return tidy(N.named_elements(vecs(spark, d), "vec", "emb_mean", ["key"]))


@query("prj_15", "SELECT l_returnflag, count(*) FILTER (WHERE l_tax > 0.01) AS ok, count(*) FILTER (WHERE l_tax = 0) AS empty FROM lineitem GROUP BY 1")
def error_filters(spark, d):
    rows = read(spark, d, "lineitem").withColumn("load_error", F.when(F.col("l_tax") <= 0.01, "quiet"))
    return rows.groupBy("l_returnflag").agg(
        F.count_if(F.col("load_error").isNull()).alias("ok"), F.count_if((F.col("l_tax") == 0) & (F.col("l_quantity") >= 0)).alias("empty")
    )


@query("prj_16", rounded(f"""WITH {RESULTS} SELECT model, fold::VARCHAR AS fold, accuracy, CASE WHEN protocol = 'random_stratified' THEN 'sweep run' END AS notes FROM res
 WHERE fold = 3 AND protocol = 'random_stratified' AND model IN ('m0', 'm2')""", "accuracy"))
def log_filter(spark, d):
    log = results(spark, d).select(
        "model", F.col("fold").cast("string").alias("fold"), "accuracy", F.when(F.col("protocol") == "random_stratified", "sweep run").alias("notes")
    )
    return tidy(P.log_rows(log, "sweep", ["m0", "m2"], fold="3"))


# -------------------------------------------------------------------- scalars


@query("fn_01", r"""SELECT url, regexp_replace(list_extract(string_split(url, '/'), -1), '\.[^.]*$', '') AS stem, list_extract(string_split(url, '/'), -2) AS parent,
 upper(left(url, 4)) AS scheme, format('{:02d}', page_id % 100) AS padded, contains(url, '?') AS has_query, array_to_string(string_split(url, '/')[3:], '|') AS joined FROM pages""")
def strings(spark, d):
    u = F.col("url")
    return read(spark, d, "pages").select(
        "url", X.stem(u).alias("stem"), X.parent(u).alias("parent"), F.upper(F.left(u, F.lit(4))).alias("scheme"),
        F.format_string("%02d", F.col("page_id") % 100).alias("padded"), F.contains(u, F.lit("?")).alias("has_query"),
        F.array_join(F.slice(F.split(u, "/"), 3, 100), "|").alias("joined"),
    )


@query("fn_02", rounded("""SELECT event_id, CASE WHEN v > 0 THEN 20 * log10(v) END AS db, sqrt(v) AS root, least(greatest(v, 1), 100) AS clipped, pow(10, v / 100) AS power,
 least(greatest((v / 500) / greatest(1 - v / 500, 1e-6), 0), 10) AS ratio FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 0 ELSE value END AS v FROM events) AS _t""", "db", "root", "clipped", "power", "ratio", digits=4))
def numbers(spark, d):
    from ..operators.transfer import density_ratio

    v = F.col("v")
    rows = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 11 == 0, 0.0).otherwise(F.col("value")).alias("v"))
    return tidy(rows.select(
        "event_id", X.decibels(v).alias("db"), F.sqrt(v).alias("root"), F.least(F.greatest(v, F.lit(1.0)), F.lit(100.0)).alias("clipped"),
        F.pow(F.lit(10.0), v / 100).alias("power"), density_ratio(v / 500).alias("ratio"),
    ), 4)


@query("fn_03", rounded(f"""WITH {VECS} SELECT key, list_position(vec, list_max(vec)) - 1 AS top, list_avg(vec) AS mean, list_stddev_pop(vec) AS std,
 len(list_filter(vec, lambda x: x >= 0.1::DOUBLE)) AS high, list_inner_product(vec, vec) AS norm2, list_aggregate(vec[1:8], 'sum') AS head FROM vecs""", "mean", "std", "norm2", "head"))
def arrays(spark, d):
    v = F.col("vec")
    return tidy(vecs(spark, d).select(
        "key", A.argmax(v).alias("top"), A.mean(v).alias("mean"), A.std_pop(v).alias("std"), A.count_at_least(v, 0.1).alias("high"),
        A.dot(v, v).alias("norm2"), A.total(F.slice(v, 1, 8)).alias("head"),
    ))


@query("fn_04", "SELECT event_id, CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' END AS code FROM events")
def maps(spark, d):
    return read(spark, d, "events").select("event_id", X.lookup({"click": "c", "view": "v"}, F.col("event_type")).alias("code"))


@query("fn_05", """SELECT event_id, '{"key":' || (props->>'k') || ',"type":"' || event_type || '"}' AS params, (props->>'k')::INT AS k FROM events""")
def jsons(spark, d):
    k = F.from_json("props", "k INT")["k"]
    return read(spark, d, "events").select(
        "event_id", X.sorted_json_column(type=F.col("event_type"), key=k).alias("params"), k.alias("k")
    )


@query("fn_06", rounded(f"SELECT doc_id, left(sha256(text), 12) AS short, md5(text) AS digest, {h(chr(39) + 's' + chr(39), 'doc_id')} AS h, {h(chr(39) + 's' + chr(39), 'doc_id')} / 4294967296e0 AS u FROM documents", "u"))
def hashes(spark, d):
    k = F.col("doc_id")
    return tidy(read(spark, d, "documents").select(
        "doc_id", X.short_id(F.col("text")).alias("short"), F.md5("text").alias("digest"), hash32("s", k).alias("h"), uniform("s", k).alias("u")
    ))


@query("fn_07", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS stamp, left(md5(event_id::VARCHAR), 8) AS run_id FROM events")
def stamps(spark, d):
    return read(spark, d, "events").select(
        "event_id", X.utc_seconds(F.col("ts")).alias("stamp"), F.left(F.md5(F.col("event_id").cast("string")), F.lit(8)).alias("run_id")
    )


@query("fn_08", """SELECT l_returnflag, printf('%.4f [%.4f, %.4f]', a, lo, hi) AS point_text, printf('%+.2f pp [%+.2f, %+.2f]', (a - 0.05) * 100, (lo - 0.05) * 100, (hi - 0.05) * 100) AS delta_text
 FROM (SELECT l_returnflag, avg(l_tax) AS a, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY 1) AS _t""")
def formats(spark, d):
    rows = read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_tax").alias("a"), F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi"))
    return rows.select(
        "l_returnflag", X.interval_text(F.col("a"), F.col("lo"), F.col("hi")).alias("point_text"),
        X.delta_text(F.col("a") - 0.05, F.col("lo") - 0.05, F.col("hi") - 0.05).alias("delta_text"),
    )
