"""Secret scan with corpus-wide ownership frequency.

Each text is scanned by patterns; every candidate value is hashed, and the
corpus is asked in how many repositories and by how many owners the value is
found. A value that many owners share is a copied example; one that belongs
to few owners looks like a live credential. The frequencies also decide on a
further kind of candidate, opaque tokens without any keyword: they become
spans only where they are specific to one owner.

Everything is DataFrame expressions: spans come from ``regexp_extract_all``
of (gap, match) pairs, whose running lengths are the positions.

Defined results. Null text: empty, no spans. Null owner or repository: one
owner or repository of its own. Repeated rows each get their spans; they
count once in the frequencies when their repository is the same. Texts of any
length are scanned whole. Empty table: empty result. Only the named columns
are read; others pass :func:`redact` unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import let, text_of

#: Base kinds in their order: pattern, group holding the value (0: all), least length of the value, cheap test.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
    r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
KINDS = {
    "assign": (ASSIGN, 2, 8, r"(?i)passw|secret|token|api_?key"),
    "access": (r"AKIA[A-Z0-9]+", 0, 16, r"AKIA"),
    "hex": (r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32}"),
}
BASE = tuple(KINDS)
#: The kind that the method adds: an unkeyed token of letters and digits.
OPAQUE = "opaque"
OPAQUE_RULE = (r"[A-Za-z0-9_-]+", 0, 24, r"[A-Za-z0-9_-]{24}")
#: Distinct characters of an opaque token, at least.
VARIETY = 12
#: A value held by at least this many owners is a widely copied example.
COMMON_OWNERS = 3

_SPAN = "array<struct<start:bigint,rank:int,kind:string,stop:bigint,value:string>>"


def spans_of(text: Column, kind: str, rank: int, rule) -> Column:
    """Leftmost non-overlapping matches as an array of spans in code points."""
    pattern, group, least, test = rule
    # each find takes the gap before a match along; the last one takes the rest of the text
    whole = F.lit(f"(?s)(.*?)(?:({pattern})|\\z)")
    gaps, hits = F.regexp_extract_all(text, whole, F.lit(1)), F.regexp_extract_all(text, whole, F.lit(2))
    values = F.regexp_extract_all(text, whole, F.lit(2 + group)) if group else hits
    # patterns whose least length cannot change where a match begins are tested on the way
    pieces = F.transform(
        F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value")),
        lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.length(p["hit"]).alias("hit"), p["value"].alias("value")),
    )
    spans = F.transform(_placed(pieces), lambda p: F.struct(
        p["at"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (p["at"] + p["hit"]).alias("stop"),
        p["value"].alias("value"),
    ))
    kept = F.filter(spans, lambda s: F.length(s["value"]) >= least)
    return F.when(text.rlike(test), kept).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def _running(items: Column, kind: str, size, out) -> Column:
    """``out(begin, item)`` of every item, where ``begin`` is the sum of ``size`` over the items before it."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))

    def step(state: Column, item: Column) -> Column:
        return F.struct(
            (state["at"] + size(item)).alias("at"), F.concat(state["out"], F.array(out(state["at"], item))).alias("out")
        )

    return F.aggregate(items, start, step)["out"]


def _placed(pieces: Column) -> Column:
    """(at, hit, value) of (gap, hit, value) pieces in a row: where each hit begins.

    A growing array is copied at every step, so the pieces are cut into as many
    runs as each has pieces: positions inside a run first, then those of the runs.
    """
    long = lambda c: c.cast("bigint")
    placed = "struct<at:bigint,hit:int,value:string>"

    def cut(items: Column) -> Column:
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items))).cast("int"))
        runs = F.transform(
            F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(items) - 1) / step).cast("int"))),
            lambda i: F.slice(items, i * step + 1, step),
        )
        return let(runs, both)

    def both(runs: Column) -> Column:
        whole = lambda run: F.aggregate(run, F.lit(0).cast("bigint"), lambda n, p: n + p["gap"] + p["hit"])
        begins = _running(F.transform(runs, whole), "bigint", lambda n: n, lambda at, n: at)
        inside = lambda run: _running(run, placed, lambda p: long(p["gap"] + p["hit"]), lambda at, p: F.struct(
            (at + p["gap"]).alias("at"), p["hit"].alias("hit"), p["value"].alias("value")))
        return F.flatten(F.transform(
            F.arrays_zip(begins.alias("begin"), runs.alias("run")),
            lambda z: let(z["begin"], lambda begin: F.transform(inside(z["run"]), lambda p: F.struct(
                (p["at"] + begin).alias("at"), p["hit"].alias("hit"), p["value"].alias("value")))),
        ))

    return let(pieces, cut)


def _run_rule(rule):
    """The rule with its least length inside the pattern, where a match is one run of a class."""
    pattern, group, least, test = rule
    if pattern.endswith("]+") and pattern.count("[") == 1 and not group:
        head = pattern[: pattern.index("[")]
        return f"{pattern[:-1]}{{{least - len(head)},}}", group, least, test
    return rule


def _opaque(text: Column) -> Column:
    found = spans_of(text, OPAQUE, len(BASE), _run_rule(OPAQUE_RULE))

    def credible(span: Column) -> Column:
        v = span["value"]
        return v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, ""))) >= VARIETY)

    return F.filter(found, credible)


def joined(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    )


def base_spans(text: Column) -> Column:
    """The base spans sorted by start, then by kind as listed."""
    parts = [spans_of(text, k, i, _run_rule(KINDS[k])) for i, k in enumerate(BASE)]
    return F.array_sort(F.concat(*parts))


def scan(docs: DataFrame, doc_id="doc_id", text="text", owner="source", repository="doc_id") -> DataFrame:
    """(doc_id, digest, owner, repo, base, extra): the spans of each row, before any decision.

    ``extra`` are opaque tokens that overlap no base span.
    """
    body = text_of(text)
    found = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("digest"), F.col(owner).cast("string").alias("owner"),
        F.col(repository).cast("string").alias("repo"), base_spans(body).alias("base"), _opaque(body).alias("extra"),
    )
    clear = F.expr("filter(extra, e -> not exists(base, b -> b.start < e.stop and e.start < b.stop))")
    return materialise(found.withColumn("extra", clear), "scan")


def ownership(scanned: DataFrame) -> DataFrame:
    """(value_hash, n_repos, n_owners) of every candidate value in the corpus."""
    values = scanned.select("owner", "repo", F.explode(F.concat("base", "extra")).alias("s")).select(
        F.xxhash64("s.value").alias("value_hash"), "owner", "repo"
    )
    # three partial aggregations: copies inside a repository, repositories of an owner, owners
    return (
        values.groupBy("value_hash", "owner", "repo").agg(F.lit(1).alias("one"))
        .groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
        .groupBy("value_hash").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))
    )


def classified(scanned: DataFrame, common: int = COMMON_OWNERS) -> DataFrame:
    """Every candidate span with the frequencies of its value and ``live``."""
    stats = materialise(ownership(scanned), "owners")
    one = scanned.select("doc_id", "digest", F.explode(F.concat("base", "extra")).alias("s")).withColumn(
        "value_hash", F.xxhash64("s.value")
    )
    return one.join(stats, "value_hash").withColumn("live", F.col("n_owners") < common)


def decisions(scanned: DataFrame, common: int = COMMON_OWNERS) -> DataFrame:
    """One row per (doc_id, digest) with candidates: all spans, live spans, largest frequencies.

    An opaque token is a span only if one owner alone has it.
    """
    rows = classified(scanned, common).where((F.col("s.kind") != OPAQUE) | (F.col("n_owners") == 1))
    span = F.struct("s.*")
    return rows.groupBy("doc_id", "digest").agg(
        F.array_sort(F.collect_set(span)).alias("spans"),
        F.array_sort(F.collect_set(F.when(F.col("live"), span))).alias("live"),
        F.max("n_owners").alias("max_owners"), F.max("n_repos").alias("max_repos"),
    )


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["_id"]) & (left["digest"] == right["_digest"])


def find_secrets(docs: DataFrame, common: int = COMMON_OWNERS, **columns) -> DataFrame:
    """One row per document: its base spans, all spans, and those that look live."""
    scanned = scan(docs, **columns)
    decided = decisions(scanned, common).withColumnsRenamed({"doc_id": "_id", "digest": "_digest"})
    none = F.expr(f"cast(array() as {_SPAN})")
    return scanned.join(decided, _same(scanned, decided), "left").select(
        scanned["doc_id"], "base", F.coalesce("spans", none).alias("spans"), F.coalesce("live", none).alias("live"),
        F.coalesce("max_owners", F.lit(0)).alias("max_owners"), F.coalesce("max_repos", F.lit(0)).alias("max_repos"),
    )


def redact(docs: DataFrame, doc_id="doc_id", text="text", mark="[secret]", common: int = COMMON_OWNERS, **columns) -> DataFrame:
    """The documents with every live-looking span replaced by ``mark``; all rows and columns stay.

    A column ``n_chars`` is set to the new length where the text changed.
    """
    decided = decisions(scan(docs, doc_id, text, **columns), common).where(F.size("live") > 0)
    # overlapping spans (a token that is an assignment and hex) are replaced once
    merge = F.aggregate(
        "live", F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)"),
        lambda out, s: F.when(
            (F.size(out) > 0) & (F.element_at(out, F.greatest(F.size(out), F.lit(1)))["b"] >= s["start"]),
            F.concat(
                F.slice(out, 1, F.size(out) - 1),
                F.array(F.struct(
                    F.element_at(out, F.greatest(F.size(out), F.lit(1)))["a"].alias("a"),
                    F.greatest(F.element_at(out, F.greatest(F.size(out), F.lit(1)))["b"], s["stop"]).alias("b"),
                )),
            ),
        ).otherwise(F.concat(out, F.array(F.struct(s["start"].alias("a"), s["stop"].alias("b"))))),
    )
    cuts = materialise(
        decided.select(F.col("doc_id").alias("_s_id"), F.col("digest").alias("_s_digest"), merge.alias("_s_cuts")), "cuts"
    )
    hit = docs.withColumn("_s_hash", F.xxhash64(text_of(text))).join(
        cuts, F.col(doc_id).eqNullSafe(F.col("_s_id")) & (F.col("_s_hash") == F.col("_s_digest")), "left"
    )
    body = F.col(text)

    def before(i: Column, cut: Column) -> Column:
        last = F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("_s_cuts"), i - 1)["b"])
        return F.concat(body.substr((last + 1).cast("int"), (cut["a"] - last).cast("int")), F.lit(mark))

    end = F.element_at("_s_cuts", -1)["b"]
    new = F.concat(
        F.concat_ws("", F.transform("_s_cuts", lambda c, i: before(i, c))),
        body.substr((end + 1).cast("int"), F.length(body)),
    )
    changed = F.col("_s_cuts").isNotNull()
    out = {text: F.when(changed, new).otherwise(body)}
    hit = hit.withColumn("_s_new", out[text])
    keep = []
    for c in docs.columns:
        if c == text:
            keep.append(F.col("_s_new").alias(c))
        elif c == "n_chars":
            keep.append(F.when(changed, F.length("_s_new").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            keep.append(F.col(c))
    return hit.select(*keep)


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """Contract query: counts of base spans, their digest, and all spans."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    live = F.coalesce(joined(F.col("live")), F.lit("")).alias("live")
    return found.select(
        "doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        live, "max_owners", "max_repos",
    )


def _sql_spans(kind: str, rank: int, rule) -> str:
    pattern, group, least, _ = rule
    pattern = pattern.replace("'", "''")
    whole = f"(?s)(.*?)(?:({pattern})|\\z)"
    return f"""SELECT rid, doc_id, source, '{kind}' AS kind, {rank} AS rank, value,
        upto - length(hit) AS start, upto AS stop
      FROM (SELECT rid, doc_id, source, hit, value,
              sum(length(gap) + length(hit)) OVER (PARTITION BY rid ORDER BY i) AS upto
            FROM (SELECT rid, doc_id, source, generate_subscripts(p.g, 1) AS i, unnest(p.g) AS gap, unnest(p.h) AS hit, unnest(p.v) AS value
                  FROM (SELECT rid, doc_id, source, {{'g': regexp_extract_all(text, '{whole}', 1), 'h': regexp_extract_all(text, '{whole}', 2),
                          'v': regexp_extract_all(text, '{whole}', {2 + group})}} AS p FROM d)))
      WHERE length(value) >= {least}"""


def oracle(common: int = COMMON_OWNERS) -> str:
    """The contract query in DuckDB SQL."""
    base = " UNION ALL ".join(_sql_spans(k, i, KINDS[k]) for i, k in enumerate(BASE))
    span = "string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
      base AS ({base}),
      raw AS ({_sql_spans(OPAQUE, len(BASE), OPAQUE_RULE)}),
      extra AS (SELECT * FROM raw WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
          AND len(list_distinct(string_split(value, ''))) >= {VARIETY}
          AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = raw.rid AND b.start < raw.stop AND raw.start < b.stop)),
      every AS (SELECT * FROM base UNION ALL SELECT * FROM extra),
      owners AS (SELECT value, count(DISTINCT coalesce('0' || source, '1')) AS n_owners,
          count(DISTINCT (coalesce('0' || source, '1'), doc_id)) AS n_repos FROM every GROUP BY value),
      judged AS (SELECT e.*, n_owners, n_repos FROM every e JOIN owners USING (value) WHERE kind <> '{OPAQUE}' OR n_owners = 1),
      per AS (SELECT rid, {counts}, string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank)
            FILTER (WHERE rank < {len(BASE)}) AS base,
          {span} AS spans, string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank)
            FILTER (WHERE n_owners < {common}) AS live,
          max(n_owners) AS max_owners, max(n_repos) AS max_repos FROM judged GROUP BY rid)
      SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256,
        coalesce(spans, '') AS spans, coalesce(live, '') AS live, coalesce(max_owners, 0) AS max_owners,
        coalesce(max_repos, 0) AS max_repos
      FROM d LEFT JOIN per USING (rid)"""
