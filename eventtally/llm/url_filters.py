"""URL filters: a temporal join of captures with dated list entries.

A list entry adds or removes a value at a time.  The entries of a list about one
value become validity intervals: each adding entry holds until the next entry
about it.  A capture is evaluated as of its fetch time: its URL gives the keys it
could be listed under (its host, every domain above it, every beginning of its
path), an equality join finds the intervals of those keys, and the one active at
that time with the most specific value decides.

Kinds of values: `host` (that host only), `domain` (it and all below it), `prefix`
(host and beginning of a path, by whole segments: `example.org/a` covers
`example.org/a/b`, not `example.org/ab`).  Hosts are lower case, without user, port
or closing dot; a value's closing slash does not count.

Defined results: entries with a null in any column but the list are ignored; of
entries of one list about one value at one time, adding wins; equal rows count
once.  A longer value decides before a shorter, then prefix before host before
domain, then `block` before `allow`, then the list that sorts first.  A capture without a host has the
verdict `no_url`, one without a time `no_time`, one that nothing covers `none`.
Captures with equal id, URL and time give one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host of a URL with a scheme; empty without one."""
    return F.rtrim(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1), F.lit("."))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(url: Column, domain_depth: Column, prefix_depth: Column) -> Column:
    """(kind, value) of everything that could list the URL, if no listed domain has more labels and no listed
    prefix more segments than these."""
    host = host_of(url)
    labels = F.split(host, r"\.")

    def up_to(most: Column) -> Column:
        return F.slice(F.sequence(F.lit(0), F.greatest(most, F.lit(0))), 2, F.greatest(most, F.lit(1)))

    domains = F.transform(
        up_to(F.least(F.size(labels), domain_depth)),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, -i, i), ".").alias("value")),
    )
    parts = F.filter(F.split(path_of(url), "/"), lambda part: part != "")
    prefixes = F.transform(
        up_to(F.least(F.size(parts), prefix_depth)),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("value")),
    )
    return F.concat(F.array(F.struct(F.lit("host").alias("kind"), host.alias("value"))), domains, prefixes)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, value, verdict, valid_from, valid_to) from entries (list, kind, value, verdict, action, at).

    `action` is add or remove; valid_to is null while nothing has ended the interval.
    """
    used = entries.where(
        F.col("kind").isNotNull() & F.col("value").isNotNull() & F.col("verdict").isNotNull()
        & F.col("action").isin("add", "remove") & F.col("at").isNotNull()
    ).withColumn("value", F.rtrim("value", F.lit("/")))
    last = used.groupBy("list", "kind", "value", "at").agg(F.min(F.struct("action", "verdict")).alias("entry"))
    history = Window.partitionBy("list", "kind", "value").orderBy("at")
    held = last.withColumn("valid_to", F.lead("at").over(history)).where(F.col("entry.action") == "add")
    return held.select("list", "kind", "value", F.col("entry.verdict").alias("verdict"), F.col("at").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, held: DataFrame, id_column: str = "id", url: str = "url", at: str = "fetched_at") -> DataFrame:
    """(id, url, fetched_at, verdict, list, kind, value, listed_at, n_active) of every capture."""
    rows = captures.select(F.col(id_column).alias("id"), F.col(url).cast("string").alias("url"), F.col(at).alias("fetched_at"))
    known = F.coalesce(host_of(F.col("url")) != "", F.lit(False)) & F.col("fetched_at").isNotNull()
    # A URL of thousands of segments is asked about no deeper than the lists go.
    depth = held.agg(
        F.coalesce(F.max(F.when(F.col("kind") == "domain", F.size(F.split("value", r"\.")))), F.lit(0)).alias("domain"),
        F.coalesce(F.max(F.when(F.col("kind") == "prefix", F.size(F.split("value", "/")) - 1)), F.lit(0)).alias("prefix"),
    ).first()
    keys = keys_of(F.col("url"), F.lit(depth["domain"]), F.lit(depth["prefix"]))
    asked = rows.distinct().select("*", F.explode_outer(F.when(known, keys)).alias("key"))
    lists = held.select(
        F.col("list"), F.col("kind").alias("of_kind"), F.col("value").alias("of_value"), "verdict", "valid_from", "valid_to"
    )
    active = (
        (F.col("key.kind") == F.col("of_kind")) & (F.col("key.value") == F.col("of_value"))
        & (F.col("valid_from") <= F.col("fetched_at"))
        & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    )
    found = asked.join(lists, active, "left")
    # The least of these is what decides.
    order = F.when(F.col("of_value").isNotNull(), F.struct(
        (-F.length("of_value")).alias("shorter"),
        F.when(F.col("of_kind") == "prefix", 0).when(F.col("of_kind") == "host", 1).otherwise(2).alias("wider"),
        (F.col("verdict") != "block").alias("allows"), F.col("list"), F.col("verdict"), F.col("of_kind"), F.col("of_value"),
        F.col("valid_from"),
    ))
    decided = found.groupBy("id", "url", "fetched_at").agg(F.min(order).alias("entry"), F.count("of_value").alias("n_active"))
    without = F.when(F.coalesce(host_of(F.col("url")) == "", F.lit(True)), "no_url").when(F.col("fetched_at").isNull(), "no_time")
    return decided.select(
        "id", "url", "fetched_at", F.coalesce("entry.verdict", without, F.lit("none")).alias("verdict"),
        F.col("entry.list").alias("list"), F.col("entry.of_kind").alias("kind"), F.col("entry.of_value").alias("value"),
        F.col("entry.valid_from").alias("listed_at"), "n_active",
    )
