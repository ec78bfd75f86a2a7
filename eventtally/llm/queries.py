"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventtally.llm import (
    byte_bpe, embedding_dedup, fill_in_middle, language_id, lexical_search, line_dedup, minhash, packing, pipeline as stages,
    secret_scan, substring_dedup, topk, toxicity, url_filters,
)
from eventtally.llm.tables import table


#: The captures' month: its first second and its length.
MONTH, MONTH_SECONDS = 1704067200, 28 * 86400


def listed_values(pages: DataFrame) -> DataFrame:
    """Dated list entries drawn from the pages' own URLs, by checksums of hosts and URLs.

    A third of the hosts get blocked, half of those for five days only; domains of
    every fifth host get blocked; first path segments of every seventh URL get allowed.
    """
    def checksum(text):
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")

    host = url_filters.host_of(F.col("url"))
    urls = pages.where(F.col("url").isNotNull()).select("url", host.alias("host")).where(F.col("host") != "").distinct()
    hosts = urls.select("host").distinct().withColumn("mark", checksum(F.col("host")))

    def entries(rows, name, kind, value, verdict, action, at):
        return rows.select(
            F.lit(name).alias("list"), F.lit(kind).alias("kind"), value.alias("value"), F.lit(verdict).alias("verdict"),
            F.lit(action).alias("action"), at.alias("at"),
        )

    added = F.lit(MONTH) + F.col("mark") % (MONTH_SECONDS // 2)
    labels = F.split("host", r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    paths = urls.withColumn("mark", checksum(F.col("url"))).withColumn(
        "segment", F.regexp_extract("url", r"^[^:]*://[^/?#]*/([^/?#]+)", 1)
    )
    found = entries(hosts.where(F.col("mark") % 3 == 0), "hosts", "host", F.col("host"), "block", "add", added)
    for more in (
        entries(hosts.where(F.col("mark") % 6 == 0), "hosts", "host", F.col("host"), "block", "remove", added + 5 * 86400),
        entries(hosts.where(F.col("mark") % 5 == 0), "domains", "domain", domain, "block", "add", F.lit(MONTH) + F.col("mark") % MONTH_SECONDS),
        entries(
            paths.where((F.col("mark") % 7 == 0) & (F.col("segment") != "")), "paths", "prefix",
            F.concat("host", F.lit("/"), "segment"), "allow", "add", F.lit(MONTH) + F.col("mark") % MONTH_SECONDS,
        ),
    ):
        found = found.unionByName(more)
    return found


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched at a second that its id gives, against the lists drawn from all URLs."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.lit(MONTH) + F.pmod(F.col("page_id") * 483059, F.lit(MONTH_SECONDS)))
    found = url_filters.evaluate(captures, url_filters.intervals(listed_values(pages)), "page_id")
    return found.withColumnRenamed("id", "page_id").drop("url")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, and its ids decoded again."""
    coded = byte_bpe.encode(table(spark, sf_dir, "documents"), decoded="decoded")
    return coded.select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the rows that are not held out, applied to all."""
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.held_out("doc_id", 4, 2)
    model = language_id.learn(docs.where(~held_out & F.col("doc_id").isNotNull()))
    return language_id.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.weights(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("id") % 20 == 0), 20)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substring_dedup.drop_repeated(docs)
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cleaned = line_dedup.drop_boilerplate(docs, counts=("n_lines", "n_dropped"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the labels of rows that are not held out, applied to all."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~language_id.held_out("doc_id", 5, 0)))
    scored = toxicity.score(docs.select("doc_id", language_id.held_out("doc_id", 5, 0).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    index = lexical_search.build(table(spark, sf_dir, "documents"))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda span: span["kind"].isin(*kinds))

    return found.select(
        F.col("id").alias("doc_id"), *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in secret_scan.KINDS],
        F.sha2(secret_scan.listed(of(*secret_scan.KINDS)), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut and put in its form, and rebuilt from that."""
    cut = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    again = fill_in_middle.restored(F.col("output"), F.col("form"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


QUERIES = {
    query.__name__: query for query in (
        op1_url_filters, op2_embedding_dedup, op3_byte_bpe, op4_language_id, op5_packing, op6_topk, op7_minhash,
        op8_substring_dedup, op9_line_dedup, op10_toxicity, op11_lexical_search, op12_secret_scan, op13_fill_in_middle, pipeline,
    )
}
