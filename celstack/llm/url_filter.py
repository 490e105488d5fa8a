"""Temporal URL filter: captures against the list entries that were active when they were fetched.

A list is a history of dated entries: on ``listed_at`` the pattern of a kind gets an ``action``. Kinds are ``host`` (exactly that
host), ``domain`` (the host or any host below it) and ``prefix`` (host and leading path segments). Each entry is valid from its
date until the next entry of the same pattern; an entry whose action is ``remove`` ends the pattern.

As-of join. The validity intervals are cut into time buckets, clipped to the span of the captures, so that a capture meets an
interval by equality of (kind, pattern, bucket) and two comparisons; at most one interval of a pattern holds the moment. Every
capture asks for the patterns that its URL can match (their number is bounded by its labels and segments). The most specific
active pattern decides: prefix before host before domain, longer before shorter.

Everything is DataFrame functions. A pattern that holds a third of the captures is spread over buckets and split by the join;
a pattern with very many entries is ordered inside (pattern, bucket) groups only, and the bucket after it carries its end.

Defined cases: a null or unparsable URL, or a null time, matches nothing and is ``allowed``; of several entries of one pattern at
one moment the larger action in text order counts; null patterns, kinds and dates are left out; repeated captures stay repeated.
Clashing column names do not matter: only the named columns of both inputs are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def patterns_of(url: Column) -> Column:
    """Structs (kind, pattern, specific) that a URL can match; none for a URL without a host."""
    host, path = host_of(url), path_of(url)
    labels, segments = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda s: s != "")

    def entry(kind: str, pattern: Column, specific: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"), specific.cast("int").alias("specific"))

    exact = F.array(entry("host", host, F.lit(1 << 16)))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: entry("domain", F.array_join(F.slice(labels, k, F.size(labels)), "."), F.size(labels) - k))
    known = F.size(segments)
    prefixes = F.when(known > 0, F.transform(F.sequence(F.lit(1), F.greatest(known, F.lit(1))), lambda k: entry(
        "prefix", F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, k), "/")), F.lit(1 << 17) + k))).otherwise(F.slice(exact, 1, 0))
    return F.when(host == "", F.slice(exact, 1, 0)).otherwise(F.concat(exact, domains, prefixes))


def validity(entries: DataFrame, bucket_seconds: int) -> DataFrame:
    """(kind, pattern, action, listed_at, ended_at): entries become intervals; an open one has a null end.

    Inside a (pattern, bucket) group the next entry ends the one before; the last entry of a group ends with the first entry of the
    next group of its pattern, found over one row per group.
    """
    known = entries.where("kind is not null and pattern is not null and listed_at is not null").groupBy("kind", "pattern", "listed_at").agg(F.max("action").alias("action"))
    known = known.withColumn("bucket", F.floor(F.unix_seconds("listed_at") / bucket_seconds))
    group = ["kind", "pattern", "bucket"]
    inside = known.withColumn("next", F.lead("listed_at").over(Window.partitionBy(*group).orderBy("listed_at")))
    heads = known.groupBy(*group).agg(F.min("listed_at").alias("head"))
    after = heads.withColumn("after", F.lead("head").over(Window.partitionBy("kind", "pattern").orderBy("bucket"))).drop("head")
    return inside.join(after, group).select("kind", "pattern", "action", "listed_at", F.coalesce("next", "after").alias("ended_at"))


def filter_captures(captures: DataFrame, entries: DataFrame, bucket_seconds: int = 30 * 86400) -> DataFrame:
    """Every row of (page_id, url, fetched_at) with verdict, kind, pattern and listed_at of the entry that decided it."""
    rows = captures.select("page_id", "url", "fetched_at")
    bucket = F.floor(F.unix_seconds("fetched_at") / bucket_seconds)
    low, high = (F.lit(n).cast("long") for n in rows.agg(F.min(bucket), F.max(bucket)).first())  # two numbers, null without captures
    intervals = validity(entries, bucket_seconds).where("action <> 'remove'")
    first = F.greatest(F.floor(F.unix_seconds("listed_at") / bucket_seconds), low)
    last = F.least(F.coalesce(F.floor(F.unix_seconds("ended_at") / bucket_seconds), high), high)
    cells = intervals.withColumns({"first": first, "last": last}).where("first <= last").select(
        "kind", "pattern", "action", "listed_at", "ended_at", F.explode(F.sequence("first", "last")).alias("bucket"))
    # every capture keeps one row without a pattern, which counts it and carries it when nothing matches
    nothing = F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("pattern"), F.lit(0).alias("specific")))
    asked = rows.withColumn("bucket", bucket).select("page_id", "url", "fetched_at", "bucket", F.explode(F.concat(nothing, patterns_of(F.col("url")))).alias("p"))
    asked = asked.select("page_id", "url", "fetched_at", "bucket", "p.kind", "p.pattern", "p.specific")
    active = (F.col("fetched_at") >= F.col("listed_at")) & (F.col("ended_at").isNull() | (F.col("fetched_at") < F.col("ended_at")))
    hits = asked.where("kind is not null").join(cells, ["kind", "pattern", "bucket"]).where(active)
    hit = F.struct("specific", "kind", "pattern", "action", "listed_at")
    both = hits.select("page_id", "url", "fetched_at", hit.alias("hit"), F.lit(0).alias("one")).unionByName(
        asked.where("kind is null").select("page_id", "url", "fetched_at", F.lit(None).cast(hits.select(hit.alias("h")).schema["h"].dataType).alias("hit"), F.lit(1).alias("one")))
    best = both.groupBy("page_id", "url", "fetched_at").agg(F.max("hit").alias("hit"), F.sum("one").alias("copies"))
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    verdict = F.when(F.col("hit.action") == "block", "blocked").otherwise("allowed")
    return best.select("page_id", "url", "fetched_at", "hit", copies).select(
        "page_id", "url", "fetched_at", verdict.alias("verdict"), "hit.kind", "hit.pattern", "hit.listed_at")


FIRST_DAY = 1704067200
YEAR = 366 * 86400


def _code(*columns) -> Column:
    """A number below 2^32 from the MD5 of the columns."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns).cast("binary")), 1, 8), 16, 10).cast("long")


def listed_from_pages(pages: DataFrame) -> DataFrame:
    """A list history derived from the hosts of ``pages``: four dated entries for every host, domain and path prefix."""
    urls = pages.select(F.explode(patterns_of(F.col("url"))).alias("p")).select("p.kind", "p.pattern").distinct()
    dated = urls.select("kind", "pattern", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("turn"))
    code = _code("kind", "pattern", F.col("turn").cast("string"))
    action = F.when(code % 3 == 0, "block").when(code % 3 == 1, "allow").otherwise("remove")
    return dated.select("kind", "pattern", action.alias("action"), F.timestamp_seconds(FIRST_DAY + (code % YEAR)).alias("listed_at"))


def dated_captures(pages: DataFrame) -> DataFrame:
    """``pages`` with a fetch time derived from id and URL, within one year."""
    code = _code(F.col("page_id").cast("string"), "url")
    return pages.select("page_id", "url", F.timestamp_seconds(FIRST_DAY + (code % YEAR)).alias("fetched_at"))
