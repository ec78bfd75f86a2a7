"""A Bloom filter of the keys of each part of the ledger, as rows that Spark reads.

The filter of a part is an array of bits, cut into buckets of 32,768; a row holds the bits of
a bucket.  The number of buckets is a power of two, so one set of hashes serves filters of all sizes.
A lookup reads the buckets its keys' bits are in, found by the row groups' statistics, and no part
of the ledger; only parts that may hold a key are opened then.

The filter of `data/<commit>/event_date=<day>` lies in `<root>/<commit>/event_date=<day>` under the index's root; it is
written before the commit, so every part in force has one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventtally.sources import folders
from eventtally.sources.commits import Part

#: Bits of a bucket, as Spark's bitmap functions have them.
BUCKET_BITS = 32_768
#: Up to so many buckets a lookup names those it wants, so that row groups without them are skipped.
NAMED_BUCKETS = 1_000
#: Bits that a key sets, and bits that a filter has for each key: some 1 % of absent keys pass.
HASHES, BITS_A_KEY = 7, 10
#: Words of 64 bits that are united in a row; a power of two.
WORDS = 8

_SCHEMA = "buckets INT, bucket BIGINT, bits BINARY, event_date DATE"


def buckets_for(rows: int) -> int:
    """Buckets of a filter: the power of two that gives its keys enough bits."""
    return 1 << max(0, math.ceil(math.log2(max(rows, 1) * BITS_A_KEY / BUCKET_BITS)))


def positions(key: Column) -> Column:
    """The bits a key sets in a filter as large as there can be; smaller ones take the rest."""
    return F.array(*[F.xxhash64(F.lit(i), key) for i in range(HASHES)])


def filters(rows: DataFrame, by: list[str], buckets: Column, key: str = "idempotency_key") -> DataFrame:
    """(*by, buckets, bucket, bits): a filter for each group; `buckets` is constant in a group.

    The bits are those of `bitmap_construct_agg`, which would have a row a key and bit sorted.  Here they are united
    as whole numbers, by hash, a line of WORDS words a row; a bucket has 64 lines.
    """
    bit = F.pmod("position", buckets.cast("bigint") * BUCKET_BITS)
    set_ = rows.withColumn("position", F.explode(positions(F.col(key)))).select(*by, buckets.alias("buckets"), bit.alias("bit"))
    # The first byte of a word is its highest, as in the text of its digits; a byte's first bit is its lowest.
    placed = set_.selectExpr(
        *by, "buckets", f"bit div {BUCKET_BITS} AS bucket", f"cast(bit % {BUCKET_BITS} div {64 * WORDS} AS INT) AS line",
        f"(bit >> 6) & {WORDS - 1} AS word", "shiftleft(1L, cast(56 - (bit & 56) + (bit & 7) AS INT)) AS one",
    )
    words = [f"w{i}" for i in range(WORDS)]
    lines = placed.groupBy(*by, "buckets", "bucket", "line").agg(
        *[F.expr(f"bit_or(if(word = {i}, one, 0L))").alias(name) for i, name in enumerate(words)]
    )
    gathered = lines.groupBy(*by, "buckets", "bucket").agg(F.array_sort(F.collect_list(F.struct("line", *words))).alias("lines"))
    # Lines without a bit are missing.
    empty, last = f"repeat('0', {16 * WORDS})", BUCKET_BITS // (64 * WORDS) - 1
    digits = ", ".join(f"lpad(hex(e.{name}), 16, '0')" for name in words)
    text = (
        f"array_join(transform(lines, (e, i) -> concat(repeat({empty}, e.line - if(i = 0, -1, lines[i - 1].line) - 1), {digits})), '')"
    )
    bits = F.expr(f"unhex(concat({text}, repeat({empty}, {last} - lines[size(lines) - 1].line)))")
    return gathered.select(*by, "buckets", "bucket", bits.alias("bits"))


def _is_set(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, (bit % 8).cast("int")) == 1


def one(spark: SparkSession, key: str) -> DataFrame:
    return spark.range(1).select(F.lit(key).alias("idempotency_key"))


class KeyIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, part: Part) -> str:
        return f"{self.root}/{part.folder.removeprefix('data/')}"

    def add(self, rows: DataFrame, parts: list[Part]) -> None:
        """Write the filters of parts of one commit; `rows` are theirs."""
        if not parts:
            return
        # A number a day: as many as the commit has parts.
        sizes = self.spark.createDataFrame([(p.day, buckets_for(p.rows)) for p in parts], "event_date DATE, size INT")
        keyed = rows.select("idempotency_key", "event_date").join(F.broadcast(sizes), "event_date")
        commit = self._path(parts[0]).rsplit("/", 1)[0]
        (
            filters(keyed, ["event_date"], F.col("size")).hint("rebalance", "event_date")
            .sortWithinPartitions("event_date", "bucket").write.partitionBy("event_date").parquet(commit)
        )

    def read(self, parts: Iterable[Part]) -> DataFrame:
        paths = [self._path(part) for part in parts]
        return self.spark.read.schema(_SCHEMA).option("basePath", self.root).parquet(*paths).select(
            "*", F.regexp_extract(F.col("_metadata.file_path"), r"/(c=[^/]+/event_date=[^/]+)/", 1).alias("part")
        )

    def holding(self, parts: Iterable[Part], keys: DataFrame) -> list[Part]:
        """The parts that may hold one of the keys (idempotency_key)."""
        by_name = {part.folder.removeprefix("data/"): part for part in parts}
        if not by_name:
            return []
        sizes = sorted({buckets_for(part.rows) for part in by_name.values()})
        # Each key asks for its buckets in the filters of each size; there are as many as powers of two.
        asked = keys.select("idempotency_key").distinct().select(
            "idempotency_key", F.explode(positions(F.col("idempotency_key"))).alias("position"),
        ).withColumn("buckets", F.explode(F.array(*[F.lit(size) for size in sizes])))
        bit = F.pmod("position", F.col("buckets").cast("bigint") * BUCKET_BITS)
        asked = asked.select("idempotency_key", "buckets", F.floor(bit / BUCKET_BITS).alias("bucket"), (bit % BUCKET_BITS).alias("bit"))
        index = self.read(by_name.values())
        wanted = [row["bucket"] for row in asked.select("bucket").distinct().limit(NAMED_BUCKETS + 1).collect()]
        if len(wanted) <= NAMED_BUCKETS:
            index = index.where(F.col("bucket").isin(wanted))
        met = index.join(asked, ["buckets", "bucket"])
        found = met.groupBy("part", "idempotency_key").agg(F.bool_and(_is_set(F.col("bits"), F.col("bit"))).alias("all"), F.count("*").alias("met"))
        # Names of parts come back, no keys.
        names = found.where(F.col("all") & (F.col("met") == HASHES)).select("part").distinct().collect()
        return [by_name[row["part"]] for row in names if row["part"] in by_name]

    def vacuum(self, commits: set[str]) -> None:
        """Remove the filters of commits that are gone."""
        for name in folders.child_folders(self.spark, self.root, "c="):
            if name not in commits:
                folders.remove(self.spark, f"{self.root}/{name}")
