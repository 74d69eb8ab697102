"""WARC: resolution of not-modified revisits.

A revisit record says that a URL's content hadn't changed. It is tied by an as-of join to the latest earlier
full response of the same canonical URL; if the validators agree, it stands for that response's payload, with
the headers that a 304 may update merged over the response's. Payloads are not shuffled, only record fields.

The as-of join is split by time: inside a slice of time a window finds the latest response, and where a slice
has none before the record, the last response of the nearest earlier slice with one is carried in. Slices are
cut at quantiles of the records' times, so that one wrong time far away doesn't widen them; a URL that holds a
third of all records is so spread over all slices. (Records of one URL and one time stay together.)

Defined results: records without URL, or with a null time, resolve to nothing; ties in time go by record id; a
revisit is never tied to itself; records that repeat are each resolved; without any validator in common a
revisit stays unresolved; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, table, written

#: Header fields that a 304 answer may carry for the stored response (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that name the visit, not the page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
#: Slices of time that one URL's records are spread over.
SLICES = 64

RECORD = "record_id long, url string, at long, full boolean, digest string, headers map<string,string>"


def canonical_url(url: Column, scheme: bool = False, www: bool = False) -> Column:
    """Host in lower case and path; no default port, fragment, end slash or tracking; parameters sorted.

    Scheme and a leading www. go too unless they are asked for: archives mostly take such URLs for one resource.
    """
    whole = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(whole, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), ":(80|443)$", "")
    host = host if www else F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    params = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(params), "&")
    named = F.lower(F.regexp_extract(whole, "^[A-Za-z][A-Za-z0-9+.-]*://", 0)) if scheme else F.lit("")
    return F.concat(named, host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _same(a: Column, b: Column) -> Column:
    weak = lambda x: F.regexp_replace(x, '^W/', "")
    return weak(a) == weak(b)


def verdict(revisit: Column, response: Column) -> Column:
    """resolved, validator mismatch, no validator or no earlier response."""
    header = lambda r, k: F.element_at(r["headers"], k)
    agree = F.when(header(revisit, "etag").isNotNull() & header(response, "etag").isNotNull(), _same(header(revisit, "etag"), header(response, "etag")))
    agree = F.coalesce(agree, header(revisit, "last-modified") == header(response, "last-modified"), revisit["digest"] == response["digest"])
    return F.when(response.isNull(), "no earlier response").when(agree.isNull(), "no validator").when(agree, "resolved").otherwise("validator mismatch")


def merge_headers(stored: Column, update: Column) -> Column:
    """The stored headers, with permitted ones of the update in their place."""
    news = F.map_filter(update, lambda k, v: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.coalesce(F.map_contains_key(news, k), F.lit(False))), news)


def resolve_revisits(records: DataFrame, slices: int = SLICES, canonical=canonical_url) -> DataFrame:
    """records as RECORD. One row for each revisit: its fields, canonical_url, response_id, verdict, merged headers and digest.

    canonical: from a URL column to the form under which records are one resource's.
    """
    folder = shared_dir(records.sparkSession, "revisits")
    lower = F.transform_keys("headers", lambda k, v: F.lower(k))
    r = written(records.select("record_id", "at", "full", "digest", lower.alias("headers"), canonical(F.col("url")).alias("canonical_url")), f"{folder}/records")
    # bounds need only be about even: any bounds give the same result
    cuts = r.agg(F.percentile_approx("at", [i / slices for i in range(1, slices)], 100 * slices)).first()[0] or []
    bounds = F.array(*map(F.lit, sorted(set(cuts)))).cast("array<long>")
    r = r.withColumn("slice", F.when(F.col("at").isNotNull(), F.size(F.filter(bounds, lambda b: b <= F.col("at")))))
    response = F.when(F.col("full"), F.struct("at", "record_id", "digest", "headers"))
    here = Window.partitionBy("canonical_url", "slice").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("near", F.last(response, ignorenulls=True).over(here))
    known = F.col("canonical_url").isNotNull() & F.col("at").isNotNull()
    # the last response of each slice, carried to the next slices of its URL: at most `slices` rows a URL
    last = written(records_last(r.where(known & F.col("full"))), f"{folder}/last")
    asked = r.where(~F.col("full") & known & F.col("near").isNull()).select("canonical_url", "slice").distinct()
    both = last.select("canonical_url", "slice", "carry").unionByName(asked.select("canonical_url", "slice", F.lit(None).cast(last.schema["carry"].dataType).alias("carry")))
    both = both.groupBy("canonical_url", "slice").agg(F.first("carry", ignorenulls=True).alias("carry"))
    before = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = written(both.withColumn("far", F.last("carry", ignorenulls=True).over(before)).where("far IS NOT NULL").select("canonical_url", "slice", "far"), f"{folder}/carried")
    revisits = r.where(~F.col("full")).join(carried, ["canonical_url", "slice"], "left")
    found = F.when(known, F.coalesce("near", "far"))
    out = revisits.withColumn("response", found)
    out = out.withColumn("verdict", verdict(F.struct("digest", "headers"), F.col("response")))
    good = F.col("verdict") == "resolved"
    return out.select(
        "record_id", "canonical_url", "at", F.col("response.record_id").alias("response_id"), "verdict",
        F.when(good, F.col("response.digest")).alias("digest"),
        F.when(good, merge_headers(F.col("response.headers"), F.coalesce("headers", F.create_map().cast("map<string,string>")))).otherwise(F.col("headers")).alias("headers"),
    )


def records_last(full: DataFrame) -> DataFrame:
    one = F.struct("at", "record_id", "digest", "headers")
    return full.groupBy("canonical_url", "slice").agg(F.max_by(one, F.struct("at", "record_id")).alias("carry"))


#: In op6 each page is recaptured, as not modified, this many captures later.
RECAPTURE = 1000
#: Of page ids, by their remainder of 20: a revisit that names no validator, one whose validator is another
#: version's, and one captured just before the page itself.
BARE, STALE, EARLY = 3, 7, 11


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Captures as WARC fields: each page is a full response at time page_id and a revisit RECAPTURE later.

    A few revisits carry no validator, a wrong one, or come too early, so that every verdict occurs.
    """
    html = F.coalesce("html", F.lit(""))
    kind = F.col("page_id") % 20
    tag = F.concat(F.lit('"'), F.md5(html.cast("binary")), F.lit('"'))
    later = F.when(kind == EARLY, F.col("page_id") - 1).otherwise(F.col("page_id") + RECAPTURE)
    told = F.when(kind == STALE, F.lit('"stale"')).otherwise(F.concat(F.lit("W/"), tag))
    full = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length(html).cast("string"), F.lit("ETag"), tag, F.lit("Date"), F.col("page_id").cast("string"))
    bare = F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("Date"), later.cast("string"), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Server"), F.lit("cache"))
    bare = F.when(kind == BARE, bare).otherwise(F.map_concat(bare, F.create_map(F.lit("ETag"), told)))
    kinds = F.array(
        F.struct(F.col("page_id").alias("at"), F.lit(True).alias("full"), F.sha2(html, 256).alias("digest"), full.alias("headers")),
        F.struct(later.alias("at"), F.lit(False).alias("full"), F.lit(None).cast("string").alias("digest"), bare.alias("headers")),
    )
    return pages.select(F.col("page_id").alias("record_id"), "url", F.inline(kinds))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(records_of_pages(table(spark, sf_dir, "pages")))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
    return found.select(F.col("record_id").alias("page_id"), "canonical_url", "response_id", "verdict", F.col("digest").alias("payload_sha256"), listed.alias("headers"))


OP6_SQL = f"""
WITH b AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages),
p AS (SELECT page_id, html,
        regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), ':(80|443)$', ''), '^www\\.', '') || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS hp,
        array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))), '&') AS q FROM b),
c AS (SELECT page_id, hp || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical_url, md5(html) AS tag, sha256(html) AS sha, strlen(html) AS n FROM p),
j AS (SELECT v.page_id, v.canonical_url, v.at_, r.page_id AS response_id, r.sha, r.n,
             CASE v.page_id % 20 WHEN {BARE} THEN NULL WHEN {STALE} THEN '"stale"' ELSE 'W/"' || v.tag || '"' END AS etag,
             CASE WHEN r.page_id IS NULL THEN 'no earlier response' WHEN v.page_id % 20 = {BARE} THEN 'no validator'
                  WHEN v.page_id % 20 <> {STALE} AND v.tag = r.tag THEN 'resolved' ELSE 'validator mismatch' END AS verdict
      FROM (SELECT *, CASE WHEN page_id % 20 = {EARLY} THEN page_id - 1 ELSE page_id + {RECAPTURE} END AS at_,
                   CASE WHEN page_id % 20 = {EARLY} THEN page_id - 1 ELSE page_id + {RECAPTURE} - 1 END AS at_or_before FROM c) v
      ASOF LEFT JOIN c r ON v.canonical_url = r.canonical_url AND v.at_or_before >= r.page_id)
SELECT page_id, canonical_url, response_id, verdict, CASE WHEN verdict = 'resolved' THEN sha END AS payload_sha256,
       'cache-control: max-age=60' || chr(10) || 'content-length: ' || CASE WHEN verdict = 'resolved' THEN n ELSE 0 END || CASE WHEN verdict = 'resolved' THEN chr(10) || 'content-type: text/html' ELSE '' END
           || chr(10) || 'date: ' || at_ || coalesce(chr(10) || 'etag: ' || etag, '') || CASE WHEN verdict = 'resolved' THEN '' ELSE chr(10) || 'server: cache' END AS headers
FROM j
"""
