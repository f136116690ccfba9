"""Resolution of not-modified WARC revisits to the full response they stand for.

A revisit takes the latest earlier full response of its canonical URL (an
as-of join). Its validators must agree with that response's; then the response's
payload stands for the revisit and the headers a 304 may update are merged.

The as-of join works on distinct (URL, time) pairs cut into time ranges at
approximate quantiles: each range carries the last response of the ranges before
it, found from one row per (URL, range), so that a URL that holds a third of
all records is spread over all ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import materialize, require

RANGES = 256
# Headers that a not-modified answer never replaces: those of the connection, and those that describe the stored body.
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
                "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
RECORD = ["record_id", "url", "ts", "kind", "etag", "last_modified", "digest", "length", "headers"]


def canonical_url(url: str | Column) -> Column:
    """One form of a URL: no scheme, fragment, www., default port, utm_ parameters or final slash; host lowered.

    NULL stays NULL; a text without :// is kept from its first character on.
    """
    u = F.col(url) if isinstance(url, str) else url
    rest = F.regexp_replace(F.regexp_replace(u, r"(?s)#.*$", ""), r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"(?s)^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    return F.concat(host, F.when(path == "", F.lit("/")).otherwise(path),
                    F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def opaque(etag: str | Column) -> Column:
    """The tag compared weakly: without its W/ mark."""
    return F.regexp_replace(F.col(etag) if isinstance(etag, str) else etag, r"^\s*W/", "")


def _lowered(headers: Column) -> Column:
    """Headers with lower-case names; of names that clash then, the smallest original counts."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    first = F.filter(entries, lambda e, i: F.array_position(names, F.lower(e["key"])) == (i + 1).cast("long"))
    return F.map_from_entries(F.transform(first, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored response's headers, updated by those of the not-modified answer that may replace them."""
    updates = F.map_filter(fresh, lambda k, v: ~k.isin(*KEPT_HEADERS) & v.isNotNull())
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(updates, k)), updates)


def latest_response(records: DataFrame, ranges: int = RANGES) -> DataFrame:
    """(canonical, ts, found): for each (canonical URL, time) of a revisit, the id of the latest strictly earlier response.

    Responses of one URL and time: the largest id. Without an earlier response there is no row.
    """
    spots = materialize(
        records.groupBy("canonical", "ts").agg(F.max(F.when(F.col("kind") == "response", F.col("record_id"))).alias("own"),
                                               F.max(F.col("kind") == "revisit").alias("asked")), "warc-spots")
    edges = spots.agg(F.percentile_approx("ts", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0]
    # A short literal list of times; its position is the range.
    cuts = F.array(*[F.lit(int(e)).cast("long") for e in sorted(set(edges or []))]) if edges else F.array().cast("array<long>")
    at = spots.withColumn("range", F.size(F.filter(cuts, lambda c: c <= F.col("ts"))))
    last = F.struct("ts", F.col("own").alias("id"))
    held = F.when(F.col("own").isNotNull(), last)
    carried = (at.groupBy("canonical", "range").agg(F.max(held).alias("last"))
               .withColumn("carried", F.max("last").over(
                   Window.partitionBy("canonical").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
               .select("canonical", "range", "carried"))
    inside = (Window.partitionBy("canonical", "range").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1))
    near = at.withColumn("near", F.max(held).over(inside)).filter("asked")
    return (near.join(carried, ["canonical", "range"])
            .select("canonical", "ts", F.coalesce("near", "carried")["id"].alias("found")).filter("found is not null"))


def resolve_revisits(records: DataFrame, ranges: int = RANGES) -> DataFrame:
    """One row per revisit: what it stands for.

    ``records``: record_id, url, ts (epoch seconds), kind (response or revisit),
    etag, last_modified, digest, length, headers (map). Returns record_id,
    canonical_url, ts, response_id, outcome, digest, length, headers. ``outcome``:
    ``resolved``, ``mismatch`` (a validator of the revisit disagrees with the
    response's, or nothing can be compared), or ``no_response``; digest, length
    and merged headers only where resolved. A revisit's entity tag decides (weak
    comparison), without one its last-modified date, without that its digest.
    NULL url or time: no_response. Repeated rows give a row each; repeated response ids
    count as the one with the smallest digest. Other columns are not read.
    """
    require(records, *RECORD)
    known = records.select(*RECORD, canonical_url("url").alias("canonical"))
    placed = known.filter("canonical is not null and ts is not null")
    found = materialize(latest_response(placed, ranges), "warc-found")
    revisits = known.filter("kind = 'revisit'").select(
        "record_id", "canonical", "ts", "etag", "last_modified", "digest", _lowered(F.col("headers")).alias("headers"))
    asked = revisits.join(found, ["canonical", "ts"], "left")
    asked = materialize(asked, "warc-asked")
    stored = (placed.filter("kind = 'response'").groupBy("record_id")
              .agg(F.min(F.struct("digest", "etag", "last_modified", "length",
                                  F.to_json(_lowered(F.col("headers"))).alias("headers"))).alias("r"))
              .select(F.col("record_id").alias("found"), F.col("r.etag").alias("r_etag"),
                      F.col("r.last_modified").alias("r_modified"), F.col("r.digest").alias("r_digest"),
                      F.col("r.length").alias("r_length"),
                      F.from_json("r.headers", "map<string,string>").alias("r_headers")))
    both = asked.join(materialize(stored, "warc-stored"), "found", "left")
    agrees = (F.when(F.col("etag").isNotNull(), opaque("etag") == opaque("r_etag"))
              .when(F.col("last_modified").isNotNull(), F.col("last_modified") == F.col("r_modified"))
              .otherwise(F.col("digest") == F.col("r_digest")))
    outcome = (F.when(F.col("found").isNull(), F.lit("no_response"))
               .when(F.coalesce(agrees, F.lit(False)), F.lit("resolved")).otherwise(F.lit("mismatch")))
    good = F.col("outcome") == "resolved"
    return (both.withColumn("outcome", outcome)
            .select("record_id", F.col("canonical").alias("canonical_url"), "ts", F.col("found").alias("response_id"),
                    "outcome", F.when(good, F.col("r_digest")).alias("digest"), F.when(good, F.col("r_length")).alias("length"),
                    F.when(good, merged_headers(F.col("r_headers"), F.col("headers"))).alias("headers")))


EPOCH, DAY = 1_600_000_000, 86_400


def records_of_pages(pages: DataFrame) -> DataFrame:
    """WARC records derived from ``pages``: each page is a full response, and a later not-modified revisit of its URL.

    Captures come a minute apart in the order of page_id. The revisit spells its URL
    another way and carries, by page_id modulo 4: the page's entity tag, its weak form, its
    last-modified date, or the tag of another content.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(
        F.col("page_id").alias("p"), "url", F.md5(body).alias("digest"), F.length(body).cast("long").alias("length"),
        (F.lit(EPOCH) + F.col("page_id") * 60).alias("ts"))
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    modified = (F.col("ts") - 3600).cast("string")
    text = lambda c: c.cast("string")
    response = base.select(
        (F.col("p") * 2).alias("record_id"), "url", "ts", F.lit("response").alias("kind"), tag.alias("etag"),
        modified.alias("last_modified"), "digest", "length",
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), text(F.col("length")),
                     F.lit("ETag"), tag, F.lit("Date"), text(F.col("ts"))).alias("headers"))
    way = F.pmod("p", F.lit(4))
    sent = (F.when(way == 0, tag).when(way == 1, F.concat(F.lit("W/"), tag)).when(way == 3, F.lit('"other"')))
    later = (F.col("ts") + DAY).alias("ts")
    revisit = base.select(
        (F.col("p") * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", r"(?s)#.*$", ""), F.lit("#again")).alias("url"),
        later, F.lit("revisit").alias("kind"), sent.alias("etag"), F.when(way == 2, modified).alias("last_modified"),
        F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("length"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("connection"), F.lit("close"), F.lit("DATE"),
                     text(F.col("ts") + DAY), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"))
    return response.unionByName(revisit)


def header_text(headers: Column) -> Column:
    """name=value lines in order of the name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


ORACLE = rf"""
with base as (select page_id as p, url, md5(coalesce(html, '')) as digest, cast(length(coalesce(html, '')) as bigint) as length,
    {EPOCH} + page_id * 60 as ts,
    regexp_replace(regexp_replace(url, '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as rest from pages),
cut as (select *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '(?s)^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') as host,
    regexp_replace(regexp_extract(rest, '(?s)^[^/?]*([^?]*)', 1), '/+$', '') as path,
    list_sort([x for x in string_split(regexp_extract(rest, '(?s)^[^?]*\?(.*)$', 1), '&')
        if x <> '' and not starts_with(x, 'utm_')]) as kept from base),
named as (select *, host || case when path = '' then '/' else path end
    || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as canonical,
    '"' || substr(digest, 1, 16) || '"' as tag, cast(ts - 3600 as varchar) as modified from cut),
spots as (select canonical, ts, 2 * p as id, null::bigint as asked from named
    union all select canonical, ts + {DAY}, null, 2 * p + 1 from named),
seen as (select asked, max(case when id is not null then {{'ts': ts, 'id': id}} end)
    over (partition by canonical order by ts range between unbounded preceding and 1 preceding) as f from spots),
joined as (select r.p * 2 + 1 as record_id, r.canonical as canonical_url, r.ts + {DAY} as ts, f.id as response_id, r.p % 4 as way,
    r.tag as sent, r.modified as since, s.tag, s.modified, s.digest, s.length, s.ts as stored_ts
    from seen join named r on seen.asked = 2 * r.p + 1 left join named s on f.id = 2 * s.p where asked is not null),
judged as (select *, case when response_id is null then 'no_response'
    when (way in (0, 1) and sent = tag) or (way = 2 and since = modified) then 'resolved' else 'mismatch' end as outcome from joined)
select record_id, canonical_url, ts, coalesce(response_id, -1) as response_id, outcome,
    case when outcome = 'resolved' then digest end as digest, case when outcome = 'resolved' then length else -1 end as length,
    case when outcome = 'resolved' then 'cache-control=max-age=60;content-length=' || cast(length as varchar)
        || ';content-type=text/html;date=' || cast(ts as varchar) || ';etag=' || tag end as headers
from judged"""
