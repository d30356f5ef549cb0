"""WARC revisit resolution: as-of join to the latest earlier full response.

Records are keyed by canonical URL. For a not-modified revisit the latest full
response captured before it under the same key is found, validators are
compared, and the headers that a 304 may update are merged over the stored
ones. Payloads never take part in the search: only ids and headers do, and the
payload is fetched by record id at the end.

The as-of search is in two levels so that a URL with a third of all captures
is no single task: within (key, time bucket) by a window, and across buckets
by a window over one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, read

FEW = 1 << 20  # names of responses that are broadcast
#: headers that a 304 response carries for the stored response (RFC 9111, 3.2); representation
#: metadata of the stored body and connection headers stay as they are
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age", "server")
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|page)"
RECORD = "record_id, url, at, kind ('response' or 'revisit'), status, headers map<string,string> with lower-case names, payload"


def canonical_url(url: Column) -> Column:
    """Scheme, www., user info, default port, fragment, tracking parameters, .html and a
    last slash do not tell two pages apart; the host is lower-cased. Null stays null."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?@]*@)?", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), r"\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^{TRACKING}="))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def latest_before(records: DataFrame, bucket_width: int) -> DataFrame:
    """Adds `found`: struct of the latest full response of the key before the row, in
    the order (at, record_id); a response is never its own answer."""
    is_full = F.col("kind") == "response"
    this = F.when(is_full, F.struct("at", "record_id", "headers"))
    b = records.withColumn("bucket", F.floor(F.col("at") / bucket_width))
    last = b.where(is_full).groupBy("key", "bucket").agg(F.max_by(F.struct("at", "record_id", "headers"), F.struct("at", "record_id")).alias("of_bucket"))
    every = b.select("key", "bucket").distinct().join(last, ["key", "bucket"], "left")
    upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("key", "bucket", F.last("of_bucket", ignorenulls=True).over(upto).alias("carried"))
    inside = Window.partitionBy("key", "bucket").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("inside", F.last(this, ignorenulls=True).over(inside))
    j = b.join(carried, ["key", "bucket"])
    return j.withColumn("found", F.coalesce("inside", "carried")).drop("inside", "carried", "bucket")


def validators_agree(mine: Column, stored: Column) -> Column:
    """Entity tags decide (weak comparison), else Last-Modified; with neither on both
    sides the revisit cannot be checked and is refused."""
    tag = lambda h: F.regexp_replace(F.element_at(h, "etag"), r"^W/", "")
    by_tag = tag(mine) == tag(stored)
    by_date = F.element_at(mine, "last-modified") == F.element_at(stored, "last-modified")
    return F.coalesce(by_tag, by_date, F.lit(False))


def merged_headers(mine: Column, stored: Column) -> Column:
    """Stored headers, with the permitted ones of the revisit put over them."""
    new = F.map_filter(mine, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    old = F.map_filter(stored, lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(old, new)


def resolve_revisits(records: DataFrame, bucket_width: int = 86_400) -> DataFrame:
    """records: record_id, url, at (long seconds), kind, headers, payload; other columns
    are ignored. One row per revisit: record_id, key, at, status, response_id,
    headers, payload.

    status: `resolved`; `no_response` (no earlier full response of the key, or a
    null url or time); `mismatch` (validators differ or are missing; the found
    response is named, headers are the revisit's own, payload null). Captures at
    the same time are ordered by record_id; null headers count as none; repeated
    rows are resolved each; of responses with the same id and time the least payload
    counts; an empty table gives an empty result. Only payloads of responses that
    resolve a revisit are moved."""
    none = F.create_map().cast("map<string,string>")
    slim = records.select("record_id", canonical_url(F.col("url")).alias("key"), F.col("at").cast("long").alias("at"), "kind", F.coalesce("headers", none).alias("headers"))
    lost = slim.where("kind = 'revisit' and (key is null or at is null)").withColumn("found", F.lit(None).cast(f"struct<at:bigint,record_id:{slim.schema['record_id'].dataType.simpleString()},headers:map<string,string>>"))
    live = latest_before(slim.where("key is not null and at is not null"), bucket_width).where("kind = 'revisit'")
    r = live.unionByName(lost)
    agree = validators_agree(F.col("headers"), F.col("found.headers"))
    r = r.select(
        "record_id", "key", "at",
        F.when(F.col("found").isNull(), "no_response").when(agree, "resolved").otherwise("mismatch").alias("status"),
        F.col("found.record_id").alias("response_id"), F.col("found.at").alias("response_at"),
        F.when(F.col("found").isNotNull() & agree, merged_headers(F.col("headers"), F.col("found.headers"))).otherwise(F.col("headers")).alias("headers"),
    )
    r = durable(r)
    wanted = r.where("status = 'resolved'").select(F.col("response_id").alias("_id"), F.col("response_at").alias("_at")).distinct()
    if wanted.limit(FEW + 1).count() <= FEW:  # else the payloads are shuffled to them
        wanted = F.broadcast(wanted)
    full = records.where("kind = 'response'").select(F.col("record_id").alias("_id"), F.col("at").cast("long").alias("_at"), "payload")
    bodies = full.join(wanted, ["_id", "_at"], "left_semi").groupBy("_id", "_at").agg(F.min("payload").alias("payload"))
    resolved = (F.col("status") == "resolved") & (F.col("response_id") == F.col("_id")) & (F.col("response_at") == F.col("_at"))
    return r.join(bodies, resolved, "left").drop("_id", "_at", "response_at")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """WARC-like records of the `pages` table, in order of page_id (one capture a minute).

    A capture through the feed link (utm_source) is a not-modified revisit: it
    carries validators and no payload. Its tag is that of its page's language."""
    lang = F.regexp_extract("html", r'<html lang="([^"]*)"', 1)
    full = ~F.coalesce(F.contains("url", F.lit("utm_source=")), F.lit(False))
    tag = F.concat(F.lit('W/"'), F.md5(F.concat_ws("|", canonical_url(F.col("url")), lang)), F.lit('"'))
    headers = F.when(full, F.create_map(F.lit("etag"), tag, F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.octet_length("html").cast("string"))).otherwise(
        F.create_map(F.lit("etag"), tag, F.lit("date"), F.col("page_id").cast("string"), F.lit("content-length"), F.lit("0"))
    )
    return pages.select(
        F.col("page_id").alias("record_id"), "url", (F.col("page_id") * 60).alias("at"),
        F.when(full, "response").otherwise("revisit").alias("kind"), headers.alias("headers"), F.when(full, F.col("html")).alias("payload"),
    )


def op4_warc_revisits(spark, sf_dir: str) -> DataFrame:
    out = resolve_revisits(records_of_pages(read(spark, sf_dir, "pages")))
    return out.select(
        F.col("record_id").alias("page_id"), "key", "status", F.col("response_id").alias("response_page_id"),
        F.element_at("headers", "content-length").alias("content_length"), F.element_at("headers", "date").alias("header_date"),
        F.when(F.col("payload").isNotNull(), F.md5("payload")).alias("payload_md5"),
    )


OP4_SQL = r"""
with p as (
  select page_id, url, html, regexp_extract(html, '<html lang="([^"]*)"', 1) as lang, coalesce(contains(url, 'utm_source='), false) as revisit,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') as u
  from pages),
k as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '\.html?$', ''), '/+$', '') as stem,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|page)='))), '&') as q
  from p),
c as (select *, stem || case when q <> '' then '?' || q else '' end as key from k),
j as (
  select r.page_id, r.key, r.lang, f.page_id as fid, f.lang as flang, f.html as fhtml,
    row_number() over (partition by r.page_id order by f.page_id desc nulls last) as rn
  from c r left join c f on r.key = f.key and not f.revisit and f.page_id < r.page_id
  where r.revisit)
select page_id, key,
  case when fid is null then 'no_response' when lang = flang then 'resolved' else 'mismatch' end as status,
  fid as response_page_id,
  case when lang = flang then cast(strlen(fhtml) as varchar) else '0' end as content_length,
  cast(page_id as varchar) as header_date,
  case when lang = flang then md5(fhtml) end as payload_md5
from j where rn = 1
"""
