"""Operator 2, native: temporal list join for URL filters.

A list is a table of dated entries (list name, pattern, date, action add or drop). Entries of one (list, pattern) in
date order become validity intervals: an ``add`` opens one that the next entry of that pattern closes (among
entries of one day the last action in alphabetical order counts, so a drop wins). A capture of a URL on a date is
evaluated against the entries active on that date only.

A URL is looked up under its host, every parent domain, and its host with each leading path segment prefix, up to
the whole path. Captures are first reduced to the distinct (pattern, date) pairs they ask for (a partial aggregate: a
host with a third of all captures asks for at most one pair per day). The as-of join is one window over the pairs and
entries of a pattern in date order, whose size is days + entries and never captures. Active pairs then join back to
the captures on (pattern, date): one row per key on that side, so a hot key is split by adaptive execution, and the
patterns of one capture are put together by a partial aggregate.

User info, port and trailing dots are not part of a host; an address literal has no parents.

Edge cases: a NULL or odd url has the empty host and matches nothing; a NULL date is never active (kept); entries with NULL in
any column are ignored; repeated entries count once; repeated captures are decided alike; empty lists keep all;
empty captures give no rows. ``decide`` ignores extra columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Host in lower case, without user info (up to the last @ of the authority), port and trailing dots."""
    authority = F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), r"^.*@", "")
    return F.lower(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*?)\.*(:.*)?$", 1))


def is_address(host: Column) -> Column:
    """IPv4 or bracketed IPv6 literal: it has no parent domain."""
    return host.rlike(r"^(\d{1,3}(\.\d{1,3}){3}|\[.*\])$")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def patterns_of(url: Column) -> Column:
    """Patterns a URL is looked up under: host, parent domains of two labels or more, host plus leading path segments."""
    host = host_of(url)
    labels = F.when(is_address(host), F.array(host)).otherwise(F.split(host, r"\."))
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                          lambda i: F.array_join(F.slice(labels, i, F.greatest(F.size(labels) - i + 1, F.lit(0))), "."))
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    prefixes = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(segments), F.lit(1))), lambda i: i <= F.size(segments)),
                           lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(host), parents, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, valid_from, valid_to): valid_to is the day it ends, NULL while open."""
    rows = entries.select("list", "pattern", "day", "action").where("list is not null and pattern is not null and day is not null and action is not null")
    daily = rows.groupBy("list", "pattern", "day").agg(F.max("action").alias("action"))
    after = Window.partitionBy("list", "pattern").orderBy("day")
    dated = daily.withColumn("valid_to", F.lead("day").over(after))
    return dated.where("action = 'add'").select("list", "pattern", F.col("day").alias("valid_from"), "valid_to")


def decide(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (id, url, day) to (id, url, day, blocked, lists, pattern): the lists that hold the URL that day and
    the longest pattern that does."""
    asked = captures.select("id", "url", "day", F.explode(patterns_of(F.col("url"))).alias("pattern")).where("day is not null")
    wanted = asked.select("pattern", "day").distinct()

    # as-of: the last event of each (list, pattern) on or before the asked day
    valid = intervals(entries)
    events = valid.select("pattern", "list", F.col("valid_from").alias("day"), F.lit(1).alias("state")).union(
        valid.where("valid_to is not null").select("pattern", "list", F.col("valid_to").alias("day"), F.lit(0)))
    # an interval that ends the day another begins is one event: the opening one
    events = events.groupBy("pattern", "list", "day").agg(F.max("state").alias("state"))
    listed = events.select("pattern", "list").distinct()
    questions = wanted.join(listed, "pattern").select("pattern", "list", "day", F.lit(None).cast("int").alias("state"))
    order = Window.partitionBy("pattern", "list").orderBy("day", F.col("state").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answered = events.withColumn("ask", F.lit(False)).union(questions.withColumn("ask", F.lit(True)))
    active = (answered.withColumn("now", F.last("state", ignorenulls=True).over(order))
              .where("ask and now = 1").groupBy("pattern", "day").agg(F.collect_set("list").alias("lists")))
    hits = asked.join(active, ["pattern", "day"])
    verdict = hits.groupBy("id", "url", "day").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("lists")))).alias("lists"),
                                                   F.max(F.struct(F.length("pattern").alias("n"), "pattern")).alias("best"))
    verdict = verdict.select(*[F.col(c).alias(f"_{c}") for c in ("id", "url", "day")], "lists", F.col("best.pattern").alias("pattern"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("id", "url", "day")]
    out = captures.select("id", "url", "day").join(verdict, same[0] & same[1] & same[2], "left")
    return out.select("id", "url", "day", F.col("pattern").isNotNull().alias("blocked"), F.coalesce(F.array_join("lists", ","), F.lit("")).alias("lists"), "pattern")


# ---- lists and dates derived from pages ------------------------------------------------------------

START = "2024-01-01"


def _number(text: Column, digits: int = 7) -> Column:
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, digits), 16, 10).cast("int")


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages carry no fetch date: one of the 366 days of 2024 by md5 of (page_id, url)."""
    name = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.coalesce("url", F.lit("")))
    return pages.select(F.col("page_id").alias("id"), "url", F.date_add(F.lit(START).cast("date"), F.pmod(_number(name), F.lit(366))).alias("day"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated entries derived from the hosts seen: every pattern of a page may be added, dropped and added again on
    days by md5; one pattern in three is on a list, and lists are ``spam`` and ``adult``."""
    pattern = F.explode(patterns_of(F.col("url")))
    seen = pages.select(pattern.alias("pattern")).distinct().where(F.pmod(_number(F.concat(F.lit("listed:"), "pattern")), F.lit(3)) == 0)
    which = F.when(F.pmod(_number(F.concat(F.lit("list:"), "pattern")), F.lit(2)) == 0, "spam").otherwise("adult")
    day = [F.date_add(F.lit(START).cast("date"), F.pmod(_number(F.concat(F.lit(f"day{i}:"), "pattern")), F.lit(366))) for i in range(3)]
    moves = F.array(*[F.struct(d.alias("day"), F.lit(a).alias("action")) for d, a in zip(day, ("add", "drop", "add"))])
    return seen.select(which.alias("list"), "pattern", F.explode(moves).alias("m")).select("list", "pattern", "m.day", "m.action")


def url_decisions(pages: DataFrame) -> DataFrame:
    """page_id, url, fetch_day, blocked, lists, pattern for every row of ``pages``."""
    out = decide(captures_of(pages), entries_of(pages))
    return out.select(F.col("id").alias("page_id"), "url", F.date_format("day", "yyyy-MM-dd").alias("fetch_day"), "blocked", "lists", "pattern")
