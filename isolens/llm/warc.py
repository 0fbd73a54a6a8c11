"""Not-modified revisits of a web archive, resolved to the responses they confirm.

A revisit record says that a server answered "not modified".  It is joined as of its time with the latest earlier
full response (status 200) of the same canonical URL.  Validators decide whether it confirms that response: entity tags
(compared weakly) where the revisit has one, else the date of last modification.  If so, the response's headers are
updated with those that a 304 may carry (PERMITTED), and the payload is the response's.

The as-of join is a running last value, over a key of URL and time slice; SLICES slices of all records' times with
about as many records each, so one URL with very many records is dealt out.  The last response of each slice is
then carried over to the next ones through a table with one row for each URL and slice.  Payloads take no part
in it and are fetched afterwards by record id.

Records at the same time are ordered by record_id, and a response with the revisit's own time and a smaller id
counts as earlier.  Null times come first; a null or unparsable URL matches nothing; null headers are none; repeated rows
give a row each; columns besides those named are ignored; an empty table gives no rows; payloads of any length are whole.  record_id must name one response; revisits may
share one or have none, and each is judged by its own headers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 64

# The headers a 304 response may carry (RFC 9110, 15.4.5), and query parameters that only track.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING_PATTERN = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid|sid)(=|$)"
HOST_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PORT_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]+:([0-9]+)"
PATH_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
QUERY_PATTERN = r"^[^?#]*\?([^#]*)"

RECORD = "record_id bigint, url string, ts bigint, kind string, status int, headers map<string,string>, payload string"


def canonical_url(url: Column) -> Column:
    """Host in lower case, port unless usual, path without its last slash, parameters sorted and without tracking; null without a host."""
    host = F.lower(F.regexp_extract(url, HOST_PATTERN, 1))
    port = F.regexp_extract(url, PORT_PATTERN, 1)
    path = F.regexp_replace(F.regexp_extract(url, PATH_PATTERN, 1), "/+$", "")
    params = F.filter(F.split(F.regexp_extract(url, QUERY_PATTERN, 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING_PATTERN))
    query = F.array_join(F.array_sort(params), "&")
    return F.when(host != "", F.concat(host, F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def _headers(headers: Column) -> Column:
    """Names in lower case; of equal names the last in order stands."""
    sorted_ = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    names = F.transform(sorted_, lambda e: F.lower(e["key"]))
    last = F.filter(F.transform(sorted_, lambda e, i: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"), (F.size(F.filter(F.slice(names, i + 2, F.size(names)), lambda n: n == F.lower(e["key"]))) == 0).alias("last"))), lambda e: e["last"])
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, those of PERMITTED replaced by the revisit's."""
    new = F.map_filter(revisit, lambda k, v: k.isin(*PERMITTED))
    old = F.map_filter(response, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(old, new)


def _tag(headers: Column) -> Column:
    return F.regexp_replace(F.try_element_at(headers, F.lit("etag")), "^W/", "")


def resolve_revisits(records: DataFrame, payload: bool = False, slices: int = SLICES) -> DataFrame:
    """For each revisit: record_id, canonical_url, response_id, outcome, headers (merged if resolved), and the payload if wanted.

    outcome: resolved; mismatch (another version was confirmed); no_validator (nothing to compare); no_response.
    """
    named = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", "kind", "status", _headers(F.col("headers")).alias("headers"))
    cuts = F.percentile_approx("ts", [i / slices for i in range(1, slices)], 10_000)
    bounds = F.array(*[F.lit(x) for x in named.agg(cuts).first()[0] or []]).cast("array<bigint>")
    light = named.select("record_id", "canonical_url", "ts", F.when(F.col("kind") == "revisit", F.col("headers")).alias("own_headers"), ((F.col("kind") == "response") & (F.col("status") == 200)).alias("full"), (F.col("kind") == "revisit").alias("again"))
    light = light.filter("full or again").withColumn("slice", F.size(F.filter(bounds, lambda x: x < F.col("ts"))))
    inside = Window.partitionBy("canonical_url", "slice").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    response = F.when(F.col("full"), F.col("record_id"))
    near = light.withColumn("near", F.last(response, ignorenulls=True).over(inside)).filter("again")
    ends = light.filter("full and canonical_url is not null").groupBy("canonical_url", "slice").agg(F.max(F.struct("ts", "record_id"))["record_id"].alias("end"))
    slots = ends.unionByName(near.filter("near is null and canonical_url is not null").select("canonical_url", "slice").distinct().withColumn("end", F.lit(None).cast("bigint")))
    slots = slots.groupBy("canonical_url", "slice").agg(F.max("end").alias("end"))
    carried = slots.withColumn("before", F.last("end", ignorenulls=True).over(Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).select("canonical_url", "slice", "before")
    found = near.join(carried, ["canonical_url", "slice"], "left").select("record_id", "canonical_url", "own_headers", F.when(F.col("canonical_url").isNotNull(), F.coalesce("near", "before")).alias("response_id"))
    of = records.filter("kind = 'response' and status = 200").select(F.col("record_id").alias("response_id"), _headers(F.col("headers")).alias("old_headers"), *(["payload"] if payload else []))
    of = of.groupBy("response_id").agg(*[F.first(c).alias(c) for c in of.columns[1:]])
    both = found.join(of, "response_id", "left")
    tag, date = _tag(F.col("own_headers")), F.try_element_at("own_headers", F.lit("last-modified"))
    same = F.when(tag.isNotNull(), tag == _tag(F.col("old_headers"))).otherwise(date == F.try_element_at("old_headers", F.lit("last-modified")))
    outcome = F.when(F.col("response_id").isNull(), "no_response").when(tag.isNull() & date.isNull(), "no_validator").when(F.coalesce(same, F.lit(False)), "resolved").otherwise("mismatch")
    out = both.withColumn("outcome", outcome)
    good = F.col("outcome") == "resolved"
    columns = ["record_id", "canonical_url", "response_id", "outcome", F.when(good, merged_headers(F.col("old_headers"), F.col("own_headers"))).alias("headers")]
    return out.select(*columns, *([F.when(good, F.col("payload")).alias("payload")] if payload else []))


def header_lines(headers: Column) -> Column:
    """name: value lines, sorted."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


#: The synthetic crawl that records_of lays over pages: for each, how often (a page's id modulo), seconds after the page, and its headers.
REVISITS = (
    ("same tag", 1, 40, "W/tag", None),
    ("other tag", 3, 50, "other", None),
    ("same date", 4, 60, None, "date"),
    ("no validator", 5, 70, None, None),
    ("nowhere", 7, 80, "tag", None),
)


def records_of(pages: DataFrame) -> DataFrame:
    """A crawl over pages: every page a full response at 100 * page_id, then revisits with good, bad or no validators."""
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    date = F.concat(F.lit("day "), F.pmod("page_id", F.lit(30)).cast("string"))
    map_ = lambda *kv: F.map_filter(F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv]), lambda k, v: v.isNotNull())
    number = lambda i: (F.col("page_id") * 8 + i).alias("record_id")
    out = pages.select(number(0), "url", (F.col("page_id") * 100).alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), map_("ETag", tag, "Last-Modified", date, "Content-Type", "text/html", "Date", F.col("page_id").cast("string")).alias("headers"), F.col("html").alias("payload"))
    for i, (name, every, after, etag, modified) in enumerate(REVISITS, 1):
        own = {"W/tag": F.concat(F.lit("W/"), tag), "tag": tag, "other": F.lit('"other"')}.get(etag, F.lit(None).cast("string"))
        url = F.concat(F.lit("https://nowhere.example/"), F.col("page_id").cast("string")) if name == "nowhere" else F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again"))
        headers = map_("etag", own, "last-modified", date if modified else F.lit(None).cast("string"), "Content-Type", "text/plain", "DATE", F.concat(F.lit("again "), F.col("page_id").cast("string")), "Expires", F.lit(name))
        rows = pages.filter(F.col("page_id") % every == 0)
        out = out.unionByName(rows.select(number(i), url.alias("url"), (F.col("page_id") * 100 + after).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), headers.alias("headers"), F.lit(None).cast("string").alias("payload")))
    return out
