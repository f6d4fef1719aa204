"""URL filters by a temporal list join: captures are judged by the list entries that were active when they were fetched.

DataFrame functions only. A list is a history of dated ``add`` and ``remove`` entries for domains, hosts and path
prefixes. Entries of one key and category become validity intervals; a capture looks up every key that could cover its
URL (its host, each parent domain, the path prefixes on its host) and keeps those with an interval around its time. Keys
are joined by equality, hot keys of captures are split, and a key's intervals are one row, so a join never multiplies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rateweave.operators.skew import ROWS_PER_SPLIT, split_join

HOST = "^(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """Host in lower case without a trailing dot; null where there is none."""
    host = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when(F.length(host) > 0, host)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def entry_key(key: Column) -> Column:
    """An entry's key: the host in lower case, as in ``host_of``; the path keeps its case and loses empty segments."""
    host = F.rtrim(F.lower(F.regexp_extract(key, "^[^/]*", 0)), F.lit("."))
    return F.array_join(F.concat(F.array(host), segments(F.regexp_extract(key, "/(.*)$", 1))), "/")


def covering_keys(url: Column, host: Column, depths: list[int]) -> Column:
    """What an entry could be listed under to cover a URL: its host, the parent domains, path prefixes on the host.

    Prefixes have the numbers of segments in ``depths``, which are those that occur in the list.
    """
    labels = F.split(host, "\\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract(url, HOST[:-len("([^/?#:]+)")] + "[^/?#]+(/[^?#]*)", 1)
    parts = segments(path)
    fitting = F.filter(F.array(*map(F.lit, depths)).cast("array<int>"), lambda n: n <= F.size(parts))
    paths = F.transform(fitting, lambda n: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
    return F.array_distinct(F.concat(domains, paths))


def validity(entries: DataFrame) -> DataFrame:
    """``(key, intervals)`` from ``entries(key, category, listed_at, action)``: arrays of ``(category, since, until)``.

    Within one key, category and time an ``add`` wins over a ``remove``; an interval ends, exclusively, at the next
    ``remove`` and is open (``until`` null) if there is none. Times are reduced to one row each before they are put in
    order, so a key's window holds as many rows as it has distinct times. Entries with a null key or time are ignored.
    """
    times = (entries.filter(F.col("key").isNotNull() & F.col("listed_at").isNotNull())
             .groupBy(entry_key(F.col("key")).alias("key"), "category", "listed_at")
             .agg(F.max(F.col("action") == "add").alias("added")))
    order = Window.partitionBy("key", "category").orderBy("listed_at")
    changes = times.withColumn("was", F.lag("added", 1, False).over(order)).filter(F.col("added") != F.col("was"))
    spans = changes.withColumn("until", F.lead("listed_at").over(order)).filter("added")
    span = F.struct("category", F.col("listed_at").alias("since"), "until")
    return spans.groupBy("key").agg(F.sort_array(F.collect_list(span)).alias("intervals"))


def judged(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url: str = "url", time: str = "fetched_at",
           rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """``(id, host, n_active, n_categories, closest, allowed)`` for every row of ``captures``.

    ``n_active`` counts the entries (key and category) around the capture's time, ``n_categories`` their distinct
    categories, ``closest`` is the longest such key (the greatest of equally long ones), null if there is none;
    ``allowed`` says that there is none. A capture without a host or a time meets no entry and is allowed; so is
    everything when the list is empty. Repeated rows and rows under one id get an answer each.
    """
    base = captures.select(F.col(id_col).alias("_id"), F.col(url).cast("string").alias("_url"), F.col(time).alias("_time"))
    base = base.withColumn("_host", host_of(F.col("_url")))
    # equal captures are judged once
    asked = base.filter("_host is not null and _time is not null").select("_url", "_host", "_time").distinct()
    # distinct depths only: no more than the longest key has segments
    depth = F.size(F.split(entry_key(F.col("key")), "/")) - 1
    depths = sorted(r.n for r in entries.filter("key is not null").select(depth.alias("n")).distinct().collect() if r.n)
    keys = asked.select("_url", "_time", F.explode(covering_keys(F.col("_url"), F.col("_host"), depths)).alias("key"))
    met = split_join(keys, validity(entries), "key", ["_url", "_time"], rows_per_split=rows_per_split)
    active = F.filter("intervals", lambda x: (x["since"] <= F.col("_time"))
                      & (x["until"].isNull() | (F.col("_time") < x["until"])))
    hit = met.select("_url", "_time", "key", F.transform(active, lambda x: x["category"]).alias("found")).filter(F.size("found") > 0)
    verdict = hit.groupBy("_url", "_time").agg(
        F.sum(F.size("found")).cast("long").alias("n_active"),
        F.size(F.array_distinct(F.flatten(F.collect_list("found")))).cast("long").alias("n_categories"),
        F.max(F.struct(F.length("key").alias("n"), F.col("key").alias("k"))).alias("best"))
    joined = base.join(verdict, ["_url", "_time"], "left")
    return joined.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.coalesce("n_active", F.lit(0)).alias("n_active"),
                         F.coalesce("n_categories", F.lit(0)).alias("n_categories"), F.col("best.k").alias("closest"),
                         F.col("best").isNull().alias("allowed"))
