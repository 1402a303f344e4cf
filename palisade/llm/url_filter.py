"""URL filters in time, with DataFrame functions only: dated list entries become validity intervals, and an as-of
join evaluates every capture against the entries that were active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    """Host in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def section_of(url: Column) -> Column:
    """First segment of the path, without slashes; empty if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _HOST + r"[^/?#]*/([^/?#]+)", 2)


def keys_of(url: Column) -> Column:
    """Keys under which a list may name a URL, most specific last: parent domains of two labels or more, host, host/section."""
    labels = F.split(host_of(url), r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.array_join(F.slice(labels, i + 1, n), "."))
    section = F.when(section_of(url) != "", F.array(F.concat_ws("/", host_of(url), section_of(url)))).otherwise(F.array().cast("array<string>"))
    return F.when(host_of(url) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.reverse(parents), section)))


def intervals(entries: DataFrame) -> DataFrame:
    """entries (list, key, verdict, action, at) -> (list, key, verdict, start, end): half open, end null if still active.

    Entries are of one key if only the case of the host differs; the keys that come back are in lower case throughout.

    An `add` holds until the next entry of the same list and key, whatever that is; `remove` only ends one. Entries of
    one instant: the last of remove < add, then the greater verdict, wins. Rows with a null key, list or date are left out.
    """
    host = F.substring_index("key", "/", 1)
    e = entries.where("key is not null and list is not null and at is not null").select("list", F.concat(F.lower(host), F.expr("substr(key, length(substring_index(key, '/', 1)) + 1)")).alias("key"), "verdict", "action", "at").distinct()
    e = e.groupBy("list", "key", "at").agg(F.max(F.struct(F.when(F.col("action") == "add", 1).otherwise(0).alias("add"), "verdict")).alias("s"))
    nxt = F.lead("at").over(W.partitionBy("list", "key").orderBy("at"))
    return e.withColumn("end", nxt).where("s.add = 1").select("list", F.lower("key").alias("key"), "s.verdict", F.col("at").alias("start"), "end")


def as_of(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched_at) -> page_id, url, fetched_at, decision, matched_key, matched_list, n_active.

    Keys match whatever their case. The most specific active key decides (the longest, then the last by code point); within it `allow` beats `block`,
    then the smallest list. Without one the decision is `none`; so it is for a null url or fetch time. Rows that are
    equal come back as one, with the entries counted once. Joins are on the key with the interval as condition, so a
    host with a third of all captures is a skewed join that can be split, not a group.
    """
    c = captures.select("page_id", "url", "fetched_at").distinct().withColumn("key", F.explode_outer(keys_of(F.col("url")))).withColumn("key", F.lower("key"))
    i = intervals(entries)
    hit = c.join(i, (c["key"] == i["key"]) & (i["start"] <= c["fetched_at"]) & (i["end"].isNull() | (c["fetched_at"] < i["end"])), "left").select(c["page_id"], c["url"], c["fetched_at"], i["list"], i["key"].alias("key"), i["verdict"])
    # max of a struct: longest key first, then the greatest key; allow over block; the smallest list through its own pass
    rank = F.when(F.col("key").isNotNull(), F.struct(F.length("key").alias("n"), "key", F.when(F.col("verdict") == "allow", 1).otherwise(0).alias("allow")))
    best = hit.groupBy("page_id", "url", "fetched_at", rank.alias("r")).agg(F.min("list").alias("list"), F.count("list").alias("n"))
    best = best.groupBy("page_id", "url", "fetched_at").agg(F.max(F.struct("r", "list")).alias("m"), F.sum("n").alias("n_active"))
    decision = F.when(F.col("m.r").isNull(), "none").when(F.col("m.r.allow") == 1, "allow").otherwise("block")
    return best.select("page_id", "url", "fetched_at", decision.alias("decision"), F.col("m.r.key").alias("matched_key"), F.col("m.list").alias("matched_list"), F.col("n_active").cast("long").alias("n_active"))
