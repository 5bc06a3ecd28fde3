"""WARC: resolving not-modified revisits to the response that they repeat.

A revisit record says that a server answered "not modified"; its page is the
latest earlier full response of the same URL. Records are joined as of their
date by canonical URL, validators are checked, and the stored headers are
updated by those that a 304 response may change.

The as-of join keeps no URL in one task: records are range-partitioned by
(url, date), each range answers inside itself, and a revisit before the first
response of its range takes the last response of the ranges before, of which
there is one row a URL and range. Ties: a response at the very date of a
revisit counts as earlier; of responses of one date the largest record id is
the latest.

Validators. Strong and weak entity tags match weakly. With tags on both sides
they decide ("etag"); else with dates of modification on both sides those do
("modified"); else nothing can be compared ("none") and the revisit is taken
on trust. A mismatch leaves the revisit unresolved ("changed"), one without an
earlier response too ("missing").

Defined results. Null or empty URL: no canonical URL, its revisits are
"missing". Null date: later than all dates for no record; its revisits are
"missing" and its responses never match. Null headers: none. Repeated rows
each give a result. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise

RESPONSE, REVISIT = "response", "revisit"
#: Headers that a not-modified response never replaces (RFC 9110 and 9111).
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-location", "content-range", "content-type",
    "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer",
    "transfer-encoding", "upgrade",
)
#: Query parameters that only track.
TRACKING = "utm_[a-z]+|gclid|fbclid|sessionid|phpsessid"


def canonical(url: Column) -> Column:
    """Scheme, user, ``www.``, default port, fragment, tracking parameters and a last slash go; host in lower case."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"^[^/?]*", 0)
    host = F.regexp_replace(F.lower(F.regexp_replace(host, r"^.*@", "")), r"^www\.|:(80|443)$", "")
    tail = F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)
    tail = F.regexp_replace(tail, rf"(?i)([?&])(?:(?:{TRACKING})=[^&]*(?:&|$))+", "$1")
    tail = F.regexp_replace(F.regexp_replace(tail, r"[?&]+$", ""), r"/+$", "")
    out = F.concat(host, tail)
    return F.when(F.length(out) > 0, out)


def header_map(block: Column) -> Column:
    """Lower-cased header names to values of a raw header block; the last of equal names stays."""
    lines = F.filter(F.split(block, "\r?\n"), lambda x: x.rlike("^[^:\\s]+:"))
    pairs = F.transform(lines, lambda x: F.struct(
        F.lower(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]+:", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, order: str, values: list[str]) -> DataFrame:
    """Each row of ``left`` with the ``values`` of the latest row of ``right`` at or before it.

    Both have ``key``, ``at`` and ``order``; rows of ``left`` without a match get nulls.
    """
    held = F.struct(*[F.col(v) for v in values])
    names = [c for c in left.columns if c not in (key, at, order)]
    events = left.select(key, at, order, F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in names]).alias("_row"), F.lit(None).cast(right.select(held.alias("x")).schema["x"].dataType).alias("_held")).unionByName(
        right.select(key, at, order, F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*names).alias("x")).schema["x"].dataType).alias("_row"), held.alias("_held"))
    )
    ranged = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).repartitionByRange(key, at, "_side", order)
    ranged = materialise(ranged.withColumn("_p", F.spark_partition_id()), "events")
    inside = Window.partitionBy(key, "_p").orderBy(at, "_side", order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = ranged.withColumn("_near", F.last("_held", ignorenulls=True).over(inside)).where("_side = 1")
    # the last response of each URL and range, and from it what the ranges after take over
    last = ranged.where("_side = 0").groupBy(key, "_p").agg(F.max_by("_held", F.struct(at, order)).alias("_last"))
    every = ranged.select(key, "_p").distinct().join(last, [key, "_p"], "left")
    before = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).select(
        F.col(key).alias("_k"), F.col("_p").alias("_q"), "_carried"
    )
    found = near.join(carried, (F.col(key) == F.col("_k")) & (F.col("_p") == F.col("_q")), "left").select(
        key, at, order, "_row.*", F.coalesce("_near", "_carried").alias("_found")
    )
    lost = left.where(F.col(key).isNull() | F.col(at).isNull()).select(
        key, at, order, *names, F.lit(None).cast(found.schema["_found"].dataType).alias("_found")
    )
    return found.unionByName(lost).select(key, at, order, *names, "_found.*")


def _tag(headers: str) -> Column:
    return F.regexp_replace(F.element_at(F.col(headers), "etag"), "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, url_key, date, response_id, check, status, body_digest, headers) of every revisit.

    ``records`` has record_id, type, url, date, headers (map of lower-case
    names) and digest.
    """
    rows = records.select(
        F.col("record_id").cast("bigint").alias("record_id"), F.lower("type").alias("type"), canonical(F.col("url")).alias("url_key"),
        "date", F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>")).alias("headers"), "digest",
    )
    revisits = rows.where(F.col("type") == REVISIT).select("url_key", "date", "record_id", F.col("headers").alias("sent"))
    responses = rows.where(F.col("type") == RESPONSE).select(
        "url_key", "date", "record_id", F.col("record_id").alias("response_id"), F.col("headers").alias("stored"), F.col("digest").alias("body_digest")
    )
    joined = as_of(revisits, responses, "url_key", "date", "record_id", ["response_id", "stored", "body_digest"])
    tags = _tag("sent").isNotNull() & _tag("stored").isNotNull()
    sent_at, stored_at = F.element_at("sent", "last-modified"), F.element_at("stored", "last-modified")
    dates = sent_at.isNotNull() & stored_at.isNotNull()
    check = (
        F.when(F.col("stored").isNull(), "missing")
        .when(tags, F.when(_tag("sent") == _tag("stored"), "etag").otherwise("changed"))
        .when(dates, F.when(sent_at == stored_at, "modified").otherwise("changed"))
        .otherwise("none")
    )
    fixed = F.array(*[F.lit(h) for h in KEPT_HEADERS])
    allowed = F.map_filter("sent", lambda k, v: ~F.array_contains(fixed, k))
    left = F.map_filter("stored", lambda k, v: ~F.map_contains_key(allowed, k))
    good = ~F.col("check").isin("missing", "changed")
    return joined.withColumn("check", check).select(
        "record_id", "url_key", "date", F.when(good, F.col("response_id")).alias("response_id"), "check",
        F.when(good, F.col("body_digest")).alias("body_digest"), F.when(good, F.map_concat(left, allowed)).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of ``pages``: each page is a response, and is asked for again some time later.

    Dates are seconds in order of ``page_id``; the second request comes a time
    later that depends on the id, and every seventh page has changed its tag.
    """
    page = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    page = page.withColumn("digest", F.md5("html"))
    modified = (F.col("page_id") % 3).cast("string")
    response = page.select(
        (2 * F.col("page_id")).alias("record_id"), F.lit(RESPONSE).alias("type"), "url", (60 * F.col("page_id")).alias("date"),
        header_map(F.concat(
            F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length("html").cast("string"),
            F.when(F.col("page_id") % 5 < 4, F.concat(F.lit("\r\nETag: \""), F.substring("digest", 1, 8), F.lit("\""))).otherwise(""),
            F.lit("\r\nLast-Modified: day "), modified, F.lit("\r\nCache-Control: max-age=60"),
        )).alias("headers"), "digest",
    )
    tag = F.when(F.col("page_id") % 7 == 0, F.lit("stale")).otherwise(F.substring("digest", 1, 8))
    again = page.select(
        (2 * F.col("page_id") + 1).alias("record_id"), F.lit(REVISIT).alias("type"), "url",
        (60 * F.col("page_id") + 30 + 60 * (F.col("page_id") * 37 % 1001)).alias("date"),
        header_map(F.concat(
            F.lit("HTTP/1.1 304 Not Modified\r\nContent-Length: 0\r\nX-Cache: hit\r\nCache-Control: max-age=600\r\nETag: W/\""), tag,
            F.lit("\"\r\nLast-Modified: day "), modified,
        )).alias("headers"), F.lit(None).cast("string").alias("digest"),
    )
    return response.unionByName(again)


def op7_revisits(spark, sf_dir: str) -> DataFrame:
    """Revisits of the captures of all pages, resolved; headers as sorted ``name: value`` lines."""
    found = resolve(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return found.select(
        "record_id", "url_key", "date", "response_id", "check", "body_digest",
        F.when(F.col("headers").isNotNull(), F.concat_ws("\n", lines)).alias("headers"),
    )


#: The contract query in DuckDB SQL.
ORACLE = rf"""WITH p AS (SELECT page_id::BIGINT AS page_id, coalesce(html, '') AS html, md5(coalesce(html, '')) AS digest,
    regexp_replace(regexp_replace(trim(url, ' '), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
  parts AS (SELECT *, regexp_replace(lower(regexp_replace(regexp_extract(rest, '^[^/?]*', 0), '^.*@', '')), '^www\.|:(80|443)$', '', 'g') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*(.*)$', 1), '(?i)([?&])(?:(?:{TRACKING})=[^&]*(?:&|$))+', '\1', 'g') AS tail FROM p),
  keyed AS (SELECT *, nullif(host || regexp_replace(regexp_replace(tail, '[?&]+$', ''), '/+$', ''), '') AS url_key FROM parts),
  response AS (SELECT 2 * page_id AS response_id, url_key, 60 * page_id AS at, digest, strlen(html) AS size, page_id % 3 AS day,
    CASE WHEN page_id % 5 < 4 THEN substr(digest, 1, 8) END AS tag FROM keyed),
  revisit AS (SELECT 2 * page_id + 1 AS record_id, url_key, 60 * page_id + 30 + 60 * (page_id * 37 % 1001) AS date, page_id % 3 AS day,
    CASE WHEN page_id % 7 = 0 THEN 'stale' ELSE substr(digest, 1, 8) END AS tag FROM keyed),
  j AS (SELECT v.*, r.response_id, r.digest, r.size, r.tag AS old_tag, r.day AS old_day
    FROM revisit v LEFT JOIN LATERAL (SELECT * FROM response r WHERE r.url_key = v.url_key AND r.at <= v.date ORDER BY r.at DESC, response_id DESC LIMIT 1) r ON TRUE),
  judged AS (SELECT *, CASE WHEN response_id IS NULL THEN 'missing'
      WHEN old_tag IS NOT NULL THEN CASE WHEN old_tag = tag THEN 'etag' ELSE 'changed' END
      WHEN day = old_day THEN 'modified' ELSE 'changed' END AS "check" FROM j)
  SELECT record_id, url_key, date, CASE WHEN ok THEN response_id END AS response_id, "check", CASE WHEN ok THEN digest END AS body_digest,
    CASE WHEN ok THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10)
      || 'etag: W/"' || tag || '"' || chr(10) || 'last-modified: day ' || day || chr(10) || 'x-cache: hit' END AS headers
  FROM (SELECT *, "check" NOT IN ('missing', 'changed') AS ok FROM judged)"""
