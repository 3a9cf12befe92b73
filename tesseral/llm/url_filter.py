"""URL filters by a temporal list join.

A list is a log of dated events (list, pattern, date, listed or not). Its events become validity intervals [since, until),
and every capture is held against the intervals that hold on the day it was fetched, for its host and each parent domain; an
address, such as 192.0.2.1 or [2001:db8::1], has no parents. Intervals are cut at month boundaries, so the as-of join is an
equality of (pattern, month) and a comparison of days within a month's few intervals. Both sides of it are written tables: large
keys, such as the top domains, are split by Spark's adaptive skew join.

Defined cases: of a pattern's events on one day, delisting wins; delisting what isn't listed does nothing; rows with a null
list, pattern or date are no events; a null url, one without a host or a null fetch time meets no entry and stays; patterns
and hosts are compared in lower case without a final dot; empty tables give empty results; repeated captures are all
returned; columns of captures other than those named pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_groups

FAR = "9999-12-31"
ADDRESS = r"^\[|^\d+(\.\d+){3}$"


def host(url: str) -> Column:
    """The host of a url, in lower case without user, port and final dot; null if it has none. IPv6 addresses keep their brackets."""
    found = F.lower(F.regexp_extract(F.col(url), r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]+\]|[^/?#:@\[\]]+)", 1))
    return F.nullif(F.rtrim(found, F.lit(".")), F.lit(""))


def intervals(events: DataFrame) -> DataFrame:
    """(list, pattern, since, until): when each pattern was listed. events: list, pattern, day, listed."""
    clean = events.select("list", F.rtrim(F.lower("pattern"), F.lit(".")).alias("pattern"), F.col("day").cast("date").alias("day"), "listed").dropna(subset=["list", "pattern", "day", "listed"])
    daily = clean.groupBy("list", "pattern", "day").agg(F.min("listed").alias("listed"))
    by = Window.partitionBy("list", "pattern").orderBy("day")
    changed = daily.withColumn("was", F.lag("listed", 1, False).over(by)).where("listed <> was")
    ended = changed.withColumn("until", F.lead("day").over(by))
    return ended.where("listed").select("list", "pattern", F.col("day").alias("since"), F.coalesce("until", F.lit(FAR).cast("date")).alias("until"))


def url_filter(captures: DataFrame, events: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """``captures`` with host, lists (of the entries met, sorted and comma-joined), n_entries and blocked.

    key and url together tell captures apart; those equal in key, url and fetch time get equal results.
    """
    day, month = F.col(fetched).cast("date"), F.date_trunc("month", F.col(fetched).cast("date")).cast("date")
    seen = captures.select(F.col(key).alias("k"), F.xxhash64(url).alias("u"), host(url).alias("host"), day.alias("day"), month.alias("month")).where("host is not null and day is not null").distinct()
    labels = F.when(F.col("host").rlike(ADDRESS), F.array("host")).otherwise(F.split("host", r"\."))
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = cut(seen.select("k", "u", "day", "month", F.explode(parents).alias("pattern")))
    span = asked.agg(F.min("month"), F.max("month")).first()
    first, last = (F.lit(x).cast("date") for x in span)

    listed = intervals(events).where(F.col("until") > first).where(F.col("since") < F.add_months(last, 1))
    lo = F.greatest(F.date_trunc("month", "since").cast("date"), first)
    hi = F.least(F.date_trunc("month", F.date_sub("until", 1)).cast("date"), last)
    monthly = listed.withColumn("month", F.explode(F.sequence(lo, hi, F.expr("interval 1 month"))))
    # of one list and pattern at most 16 intervals begin in a month
    entries = monthly.groupBy("pattern", "month").agg(F.collect_list(F.struct("list", "since", "until")).alias("spans"))
    met = join_groups(asked, cut(entries, slim=True), ["pattern", "month"]).select("k", "u", "day", F.filter("spans", lambda s: (s["since"] <= F.col("day")) & (F.col("day") < s["until"])).alias("now")).where(F.size("now") > 0)
    found = met.groupBy("k", "u", "day").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("now", lambda s: s["list"]))))), ",").alias("lists"), F.sum(F.size("now")).alias("n_entries"))
    c, f = captures.alias("c"), found.alias("f")
    on = F.col(f"c.{key}").eqNullSafe(F.col("f.k")) & (F.xxhash64(f"c.{url}") == F.col("f.u")) & (F.col(f"c.{fetched}").cast("date") == F.col("f.day"))
    mine = [x for x in captures.columns if x not in ("host", "lists", "n_entries", "blocked")]
    return c.join(f, on, "left").select(*[f"c.`{x}`" for x in mine], host(f"c.{url}").alias("host"), F.coalesce("f.lists", F.lit("")).alias("lists"), F.coalesce("f.n_entries", F.lit(0)).cast("long").alias("n_entries"), F.col("f.lists").isNotNull().alias("blocked"))
