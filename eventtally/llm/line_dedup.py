"""Line dedup by site-relative frequency.

Pages are grouped by host.  The pages of a host that contain a line, divided by
all pages of the host, give the line's ratio; a line above the boilerplate ratio
is dropped from every page of that host.

Defined results: lines are compared without blanks around them; blank lines are
kept and never counted; a line counts once a page; a null text stays null and
counts as a page without lines; pages without a host form one group; a repeated
row is a page of its own.  All other columns pass through unchanged, but one that has the name
of a count is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventtally.llm.tables import stage

#: A line on more than this part of its host's pages is boilerplate ...
BOILERPLATE_RATIO = 0.1
#: ... if it is on at least so many of them.  One leaves it to the ratio alone.
LEAST_PAGES = 1
#: Up to so many lines of boilerplate go to where the pages lie; more meet them by a join on the host.
BROADCAST_LINES = 200_000


def line_key(line: Column) -> Column:
    """What stands for a line in shuffles: 32 bytes however long it is."""
    return F.unhex(F.sha2(F.trim(line), 256))


def boilerplate(
    pages: DataFrame, host: str, text: str, ratio: float, least_pages: int, distinct_pages: bool = False
) -> DataFrame:
    """(host, keys): the boilerplate lines of each host that has any.

    The keys of a host are at most its mean lines a page over `ratio`, whatever
    its number of pages, so an array holds them.
    """
    pages = pages.select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    columns, many = ["host"], F.count(F.lit(1))
    if distinct_pages:
        # Of a text only its digest travels.
        pages = pages.withColumn("digest", F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"")))
        columns, many = ["host", "digest"], F.count_distinct("digest")
    totals = pages.groupBy("host").agg(many.alias("pages"))
    lines = F.filter(F.split("text", "\n"), lambda line: F.trim(line) != "")
    counts = (
        pages.select(*columns, F.explode(F.array_distinct(F.transform(lines, line_key))).alias("key"))
        .groupBy("host", "key").agg(many.alias("found"))
        .where(F.col("found") >= least_pages)
    )
    over = F.col("found") > F.col("pages") * F.lit(ratio)
    both = counts.join(totals.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")))
    return both.where(over).groupBy("host").agg(F.collect_list("key").alias("keys"))


def drop_boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text",
    ratio: float = BOILERPLATE_RATIO, least_pages: int = LEAST_PAGES, distinct_pages: bool = False,
    counts: tuple[str, str] | None = None, broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """`pages` without their boilerplate lines; `counts` names two further columns: lines before, lines dropped.

    With `distinct_pages` equal texts of a host count as one page, so copies do not make each
    other's lines boilerplate.
    """
    found = boilerplate(pages, host, text, ratio, least_pages, distinct_pages)
    marks = stage(found.select(F.col("host").alias("__mark_host"), F.col("keys").alias("__mark_keys")), "boilerplate")
    size = marks.agg(F.sum(F.size("__mark_keys"))).first()[0] or 0
    rows = pages.drop(*(counts or ()))
    joined = rows.join(
        F.broadcast(marks) if size <= broadcast_lines else marks, F.col(f"`{host}`").eqNullSafe(F.col("__mark_host")), "left"
    )
    lines = F.split(F.col(f"`{text}`"), "\n")
    kept = F.filter(lines, lambda line: (F.trim(line) == "") | ~F.array_contains(F.col("__mark_keys"), line_key(line)))
    result = F.when(F.col("__mark_keys").isNull(), F.col(f"`{text}`")).otherwise(F.array_join(kept, "\n"))
    columns = [result.alias(c) if c == text else F.col(f"`{c}`") for c in rows.columns]
    if counts:
        size = F.coalesce(F.size(lines), F.lit(0)).cast("long")
        size = F.when(F.col(f"`{text}`").isNull(), F.lit(0).cast("long")).otherwise(size)
        dropped = F.when(F.col("__mark_keys").isNull() | F.col(f"`{text}`").isNull(), 0).otherwise(size - F.size(kept))
        columns += [size.alias(counts[0]), dropped.cast("long").alias(counts[1])]
    return joined.select(columns)
