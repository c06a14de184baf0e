"""Revisit records resolved to the full responses that they stand for (operator 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lattiq import scratch

#: Fixed lists: tracking parameters that name no page, and headers that a not-modified answer
#: must not replace (they describe the body or the connection).
TRACKING = ("ref", "fbclid", "gclid", "sessionid")
KEPT_HEADERS = (
    "content-length", "content-encoding", "content-type", "content-range", "content-md5",
    "transfer-encoding", "connection", "keep-alive", "te", "trailer", "upgrade",
)
#: Parts of the time axis; a window over one URL has at most so many rows.
BUCKETS = 1024


def canonical(url: str) -> Column:
    """Host without ``www.`` and default port, path without a last slash, sorted parameters
    without tracking; the scheme and the fragment do not count.  Null stays null."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    params = F.array_join(F.array_sort(F.filter(query, lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(*TRACKING))), "&")
    return F.concat(host, path, F.when(params != "", F.concat(F.lit("?"), params)).otherwise(F.lit("")))


def resolve(records: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """As-of join of revisits to the latest earlier response of their canonical URL.

    ``records``: ``record_id long, url string, ts long, kind`` (``response`` or ``revisit``),
    ``etag, last_modified, digest string, headers map<string,string>`` (lower-case names).
    Returns for each revisit ``record_id, canonical, target_id, status, headers``; status is
    ``resolved``, ``missing`` (no earlier response, or no URL or time) or ``changed``: the
    validators differ.  The entity tag decides, weak as strong; without one the date of last
    change; without that the payload digest; a revisit with none is ``changed``.  Of responses at
    one time the largest id counts; a response at the revisit's own time is not earlier.  Other
    columns are not read; repeated revisits are a row each, an empty table gives none.

    A URL with very many records is no single group: windows run within parts of the time axis,
    the last response of each part is reduced with map-side combination, and only those, at most
    ``buckets`` a URL, are met by URL.
    """
    names = ("record_id", "url", "ts", "kind", "etag", "last_modified", "digest", "headers")
    rows = records.select(*names, canonical("url").alias("canonical"))
    span = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    low, width = (span["a"] or 0), max(1, -(-((span["b"] or 0) - (span["a"] or 0) + 1) // buckets))
    timed = rows.where("canonical is not null and ts is not null").withColumn("part", F.floor((F.col("ts") - low) / width))
    answer = F.when(F.col("kind") == "response", F.struct("ts", "record_id"))
    keys = timed.select("canonical", "part", "ts", "record_id", "kind", answer.alias("answer"))
    lasts = keys.where("answer is not null").groupBy("canonical", "part").agg(F.max("answer").alias("last"))
    parts = keys.where("kind = 'revisit'").select("canonical", "part").distinct().join(lasts, ["canonical", "part"], "full")
    before = Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("canonical", "part", F.max("last").over(before).alias("carried"))
    inside = Window.partitionBy("canonical", "part").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = keys.withColumn("inside", F.max("answer").over(inside)).where("kind = 'revisit'")
    found = near.join(carried, ["canonical", "part"], "left")
    found = found.select("record_id", F.coalesce("inside", "carried")["record_id"].alias("target_id"))

    revisits = rows.where("kind = 'revisit'").join(found.withColumnRenamed("record_id", "_id"), F.col("record_id") == F.col("_id"), "left").drop("_id")
    full = rows.where("kind = 'response'").select(F.col("record_id").alias("_target"), *[F.col(c).alias(f"_{c}") for c in ("etag", "last_modified", "digest", "headers")])
    joined = revisits.join(full, F.col("target_id") == F.col("_target"), "left")
    strong = lambda c: F.regexp_replace(c, "^W/", "")
    same = F.when(F.col("etag").isNotNull(), strong("etag").eqNullSafe(strong("_etag")))
    same = same.when(F.col("last_modified").isNotNull(), F.col("last_modified").eqNullSafe(F.col("_last_modified")))
    same = same.when(F.col("digest").isNotNull(), F.col("digest").eqNullSafe(F.col("_digest"))).otherwise(F.lit(False))
    status = F.when(F.col("_target").isNull(), "missing").when(same, "resolved").otherwise("changed")
    none = F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")
    own, old = F.coalesce("headers", none), F.coalesce("_headers", none)
    fresh = F.map_filter(own, lambda k, v: ~k.isin(*KEPT_HEADERS))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    return joined.select(
        "record_id", "canonical",
        F.when(status == "resolved", F.col("target_id")).alias("target_id"),
        status.alias("status"),
        F.when(status == "resolved", merged).alias("headers"),
    )


def recrawl(pages: DataFrame) -> DataFrame:
    """Records of a crawl of ``pages`` and of a later pass that found most of them unchanged.

    Page ``i`` is fetched at ``10 i`` and asked again at ``10 i + 5 + 1000 (i mod 7)``; every
    tenth revisit carries another entity tag.
    """
    i = F.col("page_id")
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    text = lambda x: x.cast("string")
    made = {
        "response": (i * 2, F.col("url"), i * 10, tag, [F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), text(F.length(F.coalesce("html", F.lit("")))), F.lit("etag"), tag, F.lit("date"), text(i * 10)]),
        "revisit": (i * 2 + 1, F.concat("url", F.lit("#again")), i * 10 + 5 + i % 7 * 1000, F.when(i % 10 == 0, F.lit('"new"')).otherwise(F.concat(F.lit("W/"), tag)), [F.lit("content-length"), F.lit("0"), F.lit("date"), text(i * 10 + 5 + i % 7 * 1000), F.lit("cache-control"), F.lit("max-age=60")]),
    }
    none = F.lit(None).cast("string")
    parts = [
        F.struct(rid.alias("record_id"), url.alias("url"), ts.alias("ts"), F.lit(kind).alias("kind"), etag.alias("etag"), none.alias("last_modified"), none.alias("digest"), F.create_map(*headers).alias("headers"))
        for kind, (rid, url, ts, etag, headers) in made.items()
    ]
    return scratch.written(pages.select(F.explode(F.array(*parts)).alias("r")).select("r.*"), "records")
