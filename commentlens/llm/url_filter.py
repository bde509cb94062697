"""URL filters with a history: every capture is judged by the list entries active when it was fetched.

Dated entries (listed, unlisted) of a key become validity intervals. A key is a host, a parent domain or the beginning
of a path. Intervals are cut at period borders and gathered by key and period, so that a capture meets one row for each of
its keys: the as-of join is an equality join, and a hot host is spread over periods. A capture has all keys that its URL
holds, however deep, a row each while they are joined. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a period: 30 days.
PERIOD = 30 * 86_400
#: Domains above the host, and leading parts of the path, that ``url_keys`` names; captures are judged by all.
PARENTS = 2
PATH_PARTS = 1

_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::[0-9]*)?([^?#]*)"


def _host_and_path(url: Column) -> tuple[Column, Column, Column]:
    host = F.rtrim(F.lower(F.regexp_extract(url, _URL, 1)), F.lit("."))
    host = F.when(F.length(host) > 0, host)
    return host, F.split(host, r"\."), F.filter(F.split(F.regexp_extract(url, _URL, 2), "/"), lambda p: p != "")


def url_keys(url: Column, parents: int = PARENTS, path_parts: int = PATH_PARTS) -> dict[str, Column]:
    """Keys of a URL by name, most special first: host with leading path parts, host, parent domains of two labels or more.

    Hosts are in lower case without a final dot. A URL without scheme and host has no keys.
    """
    host, labels, path = _host_and_path(url)
    out = {}
    for k in range(path_parts, 0, -1):
        out[f"path{k}"] = F.when(F.size(path) >= k, F.concat(host, F.lit("/"), F.array_join(F.slice(path, 1, k), "/")))
    out["host"] = host
    for k in range(1, parents + 1):
        rest = F.size(labels) - k
        out[f"parent{k}"] = F.when(rest >= 2, F.array_join(F.slice(labels, F.lit(k + 1), rest), "."))
    return out


def all_keys(url: Column, path_parts: int) -> Column:
    """Array of the keys of a URL, most special first: with up to ``path_parts`` leading path parts, and every parent domain."""
    host, labels, path = _host_and_path(url)
    deep = F.transform(F.slice(path, 1, path_parts), lambda _, k: F.concat(host, F.lit("/"), F.array_join(F.slice(path, F.lit(1), k + 1), "/")))
    wide = F.transform(labels, lambda _, k: F.array_join(F.slice(labels, k + 1, F.size(labels)), "."))
    return F.concat(F.reverse(deep), F.filter(wide, lambda _, k: (k == 0) | (F.size(labels) - k >= 2)))


def entry_key(key: Column) -> Column:
    """A list entry's key in the form of captures' keys: a host in lower case without a final dot, then path parts.

    A scheme, user, port, query and fragment, white space around it and empty path parts are left out; null without a host. Paths keep their case.
    """
    bare = F.regexp_replace(F.trim(key), "^([A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    host, _, path = _host_and_path(F.concat(F.lit("http://"), bare))
    return F.when(host.isNotNull(), F.array_join(F.concat(F.array(host), path), "/"))


def validity(entries: DataFrame) -> DataFrame:
    """(key, start, end, reason): half-open intervals in seconds in which a key is listed, from entries (key, at, listed, reason).

    Keys in any spelling become ``entry_key``s; spellings of one key are one list.
    An entry holds until the next one of its key (end null: still). Of entries of a key at one time, one that lists wins,
    then the smallest reason. Entries without key, time or listed are left out.
    """
    usable = entries.withColumn("key", entry_key(F.col("key"))).where("key IS NOT NULL AND at IS NOT NULL AND listed IS NOT NULL")
    one = usable.groupBy("key", "at").agg(F.min(F.struct((~F.col("listed")).alias("off"), "reason")).alias("x"))
    ordered = one.withColumn("end", F.lead("at").over(Window.partitionBy("key").orderBy("at")))
    return ordered.where(~F.col("x.off")).select("key", F.col("at").alias("start"), "end", F.col("x.reason").alias("reason"))


def _by_period(intervals: DataFrame, horizon: Column, period: int) -> DataFrame:
    """(key, period, spans): the intervals of a key that touch a period, earliest first."""
    last = F.coalesce(F.col("end") - 1, F.greatest(horizon, F.col("start")))
    periods = F.sequence(F.floor(F.col("start") / period), F.floor(last / period))
    cut = intervals.select("key", F.explode(periods).alias("period"), F.struct("start", "end", "reason").alias("span"))
    return cut.groupBy("key", "period").agg(F.array_sort(F.collect_list("span")).alias("spans"))


def filter_captures(captures: DataFrame, entries: DataFrame, period: int = PERIOD) -> DataFrame:
    """``captures`` (url, fetched: seconds, and any other columns) with blocked, matched_key, listed_since, reason.

    The most special key that is listed at the time decides: leading path parts, most first, then the host, then its parent
    domains, at any depth. A capture without URL, host or time is not blocked. Repeated captures are judged alike; columns named
    like the added ones are replaced. No entries block nothing.
    """
    added = ["blocked", "matched_key", "listed_since", "reason"]
    out = captures.drop(*added)
    names = out.columns
    horizon = out.agg(F.max("fetched")).first()[0]  # intervals without an end are cut off there
    spans = _by_period(validity(entries), F.coalesce(F.lit(horizon).cast("long"), F.col("start")), period)
    deepest = entries.agg(F.max(F.size(F.split(entry_key(F.col("key")), "/")) - 1)).first()[0]  # longer keys of a capture meet no entry
    known = out.where("url IS NOT NULL AND fetched IS NOT NULL").select(F.col("url").alias("__url"), F.col("fetched").alias("__fetched")).distinct()
    keys = F.posexplode(all_keys(F.col("__url"), max(0, deepest or 0))).alias("rank", "key")
    keyed = known.select("__url", "__fetched", F.floor(F.col("__fetched") / period).alias("period"), keys)
    active = F.filter("spans", lambda s: (s["start"] <= F.col("__fetched")) & (s["end"].isNull() | (F.col("__fetched") < s["end"])))
    met = keyed.join(spans, ["key", "period"]).select("__url", "__fetched", "rank", "key", F.get(active, F.lit(0)).alias("span"))
    first = F.min(F.struct("rank", "key", "span")).alias("__hit")
    hits = met.where("span IS NOT NULL").groupBy("__url", "__fetched").agg(first)
    out = out.join(hits, (F.col("url") == F.col("__url")) & (F.col("fetched") == F.col("__fetched")), "left")
    return out.select(
        *names,
        F.col("__hit").isNotNull().alias("blocked"),
        F.col("__hit.key").alias("matched_key"),
        F.col("__hit.span.start").alias("listed_since"),
        F.col("__hit.span.reason").alias("reason"),
    )
