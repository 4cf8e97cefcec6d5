"""Not-modified revisits of web archives, resolved by an as-of join.

A revisit record (status 304) has no body. It belongs to the latest earlier full response of
the same canonical URL, if that response's validators agree; its permitted headers then
update the stored ones. The join is an as-of join in two levels: within time slices of a URL,
and over the last response of each slice, so one URL with very many captures is split
by time. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldcast.llm.common import staged, table

#: Query parameters that don't change what a URL names.
TRACKING = r"^(utm_[a-z]*|ref|fbclid|gclid)(=|$)"
_URL = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#]*)([^?#]*)(?:\?([^#]*))?"
#: Headers of a 304 response that never replace stored ones: they describe the missing body or the connection.
KEPT = ("content-length", "content-encoding", "content-type", "content-range", "transfer-encoding", "connection", "set-cookie")
#: Seconds of a time slice.
SLICE = 6 * 3600


def canonical_url(url: Column) -> Column:
    """Host in lower case, path without a last slash, other than tracking parameters in order.

    Scheme, default port and fragment don't count. A null stays null.
    """
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, _URL, 2), "/+$", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(url, _URL, 3), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.array_join(kept, "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def parse_headers(block: Column) -> Column:
    """A header block as a map: names in lower case, of repeated names the last."""
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[^:\s]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, r"^([^:]+):\s*(.*?)\s*$", 1)).alias("key"), F.regexp_extract(x, r"^([^:]+):\s*(.*?)\s*$", 2).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def _strong(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """Resolve the revisits of ``records``.

    Input columns: record_id long, kind ('response' or 'revisit'), url, at timestamp, status
    int, headers map<string,string> with lower-case names (null: none). Others are ignored.
    Only responses with status 200 can be revisited; of several at one time the one with the
    largest record_id counts, of equal ones any one row; a response at the revisit's own time is not earlier. Rows with
    a null url or time are never matched; a revisit among them is 'unmatched'.

    Returns one row per revisit row, whatever ids repeat: record_id, source_id, outcome and headers. Outcomes:
    'resolved' (a validator agrees and none disagrees; entity tags are compared weakly, dates
    only where a tag is missing), 'changed' (a validator disagrees), 'unverified' (no validator
    on both sides), 'unmatched' (no earlier response). Headers are merged where resolved, else the
    revisit's own.
    """
    r = records.select(F.monotonically_increasing_id().alias("row"), "record_id", "kind", canonical_url(F.col("url")).alias("url"), "at", "status", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"))
    r = staged(r, "records")  # row numbers are made once
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    slim = r.where((F.col("kind") == "revisit") | full).select("row", "record_id", "kind", "url", "at", F.floor(F.unix_timestamp("at") / SLICE).alias("slice"))
    known = slim.where("url is not null and at is not null")
    answer = F.when(F.col("kind") == "response", F.struct("at", F.col("record_id").alias("source_id"), F.col("row").alias("source")))
    marked = known.withColumn("micros", F.unix_micros("at"))
    inside = Window.partitionBy("url", "slice").orderBy("micros").rangeBetween(Window.unboundedPreceding, -1)
    near = marked.withColumn("near", F.max(answer).over(inside)).where("kind = 'revisit'")
    ends = known.groupBy("url", "slice").agg(F.max(answer).alias("end"))
    across = Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    far = ends.withColumn("far", F.max("end").over(across)).select("url", "slice", "far")
    found = near.join(far, ["url", "slice"]).select("row", F.coalesce("near", "far")["source"].alias("source"))
    mine = r.where("kind = 'revisit'").select("row", "record_id", F.col("headers").alias("new"))
    theirs = r.where(full).select(F.col("row").alias("source"), F.col("record_id").alias("source_id"), F.col("headers").alias("old"))
    both = mine.join(found, "row", "left").join(theirs, "source", "left")
    tag = _strong(F.element_at("old", "etag")) == _strong(F.element_at("new", "etag"))
    same = F.coalesce(tag, F.element_at("old", "last-modified") == F.element_at("new", "last-modified"))
    outcome = F.when(F.col("old").isNull(), "unmatched").when(same, "resolved").when(~same, "changed").otherwise("unverified")
    permitted = F.map_filter("new", lambda k, _: ~k.isin(*KEPT))
    merged = F.map_concat(F.map_filter("old", lambda k, _: ~F.map_contains_key(permitted, k)), permitted)
    return both.select("record_id", "source_id", outcome.alias("outcome"), F.when(outcome == "resolved", merged).otherwise(F.col("new")).alias("headers"))


def crawl(pages: DataFrame) -> DataFrame:
    """Capture records of the page table: each page in full, and a later conditional request.

    Pages are a minute apart by their id, revisits ten days after. Every seventh page has
    changed meanwhile, every fifth tag is weak, every third revisit has no tag but a date.
    """
    at = F.timestamp_seconds(F.col("page_id") * 60 + 1_704_067_200)
    tag = F.concat(F.lit('"'), F.md5(F.col("html").cast("binary")), F.lit('"'))
    modified = F.concat(F.lit("day "), F.floor(F.col("page_id") / 1000).cast("string"))
    full = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.length("html").cast("string"), F.lit("etag"), tag, F.lit("last-modified"), modified, F.lit("cache-control"), F.lit("max-age=60"))
    sent = F.when(F.col("page_id") % 7 == 0, F.lit('"new"')).when(F.col("page_id") % 5 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    short = F.map_concat(F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=600"), F.lit("last-modified"), modified), F.when(F.col("page_id") % 3 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("etag"), sent)))
    p = pages.where("page_id is not null").select("page_id", "url", "html")
    first = p.select(F.col("page_id").alias("record_id"), F.lit("response").alias("kind"), "url", at.alias("at"), F.lit(200).alias("status"), full.alias("headers"))
    again = p.select(F.col("page_id").alias("record_id"), F.lit("revisit").alias("kind"), F.concat(F.regexp_replace("url", "^http:", "https:"), F.when(F.instr("url", "#") > 0, "").when(F.instr("url", "?") > 0, "&utm_source=again").otherwise("?utm_source=again")).alias("url"), (at + F.expr("INTERVAL 10 DAYS")).alias("at"), F.lit(304).alias("status"), short.alias("headers"))
    return first.unionByName(again)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the revisits of all pages, resolved."""
    done = resolve(crawl(table(spark, sf_dir, "pages")))
    h = {k: F.element_at("headers", k) for k in ("etag", "last-modified", "cache-control", "content-length")}
    return done.select(F.col("record_id").alias("page_id"), F.col("source_id").alias("source_page_id"), "outcome", h["etag"].alias("etag"), h["last-modified"].alias("last_modified"), h["cache-control"].alias("cache_control"), h["content-length"].alias("content_length"), F.size("headers").cast("long").alias("n_headers"))


SQL = r"""
WITH p AS (
  SELECT page_id, url, length(html) AS n, '"' || md5(html) || '"' AS tag, 'day ' || CAST(page_id // 1000 AS VARCHAR) AS modified,
    regexp_replace(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#]*)', 1)), ':(80|443)$', '')
    || regexp_replace(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#]*)([^?#]*)', 2), '/+$', '') AS head,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]*|ref|fbclid|gclid)(=|$)'))), '&') AS rest
  FROM pages WHERE page_id IS NOT NULL),
k AS (SELECT *, head || CASE WHEN rest <> '' THEN '?' || rest ELSE '' END AS key FROM p),
n AS (SELECT page_id, key, page_id * 60 + 864000 AS at, modified,
    CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '"new"' WHEN page_id % 5 = 0 THEN 'W/' || tag ELSE tag END AS tag FROM k),
j AS (SELECT n.*, o.page_id AS source, o.tag AS old_tag, o.modified AS old_modified, o.n AS size,
    coalesce(replace(o.tag, 'W/', '') = replace(n.tag, 'W/', ''), o.modified = n.modified) AS same
  FROM n ASOF LEFT JOIN (SELECT *, page_id * 60 AS at FROM k) o ON n.key = o.key AND n.at > o.at)
SELECT page_id, source AS source_page_id,
  CASE WHEN source IS NULL THEN 'unmatched' WHEN same THEN 'resolved' ELSE 'changed' END AS outcome,
  CASE WHEN same AND tag IS NULL THEN old_tag ELSE tag END AS etag, modified AS last_modified, 'max-age=600' AS cache_control,
  CASE WHEN same THEN CAST(size AS VARCHAR) ELSE '0' END AS content_length,
  CAST(CASE WHEN same THEN 5 ELSE 3 + CASE WHEN tag IS NULL THEN 0 ELSE 1 END END AS BIGINT) AS n_headers
FROM j
"""
